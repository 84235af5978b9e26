"""Spelling variants: words one edit apart, by blocked Gram matrices of letter counts.

Words are counted in one aggregation. Those long and frequent enough form blocks by their number of letters of each of CLASSES
classes (and so by length), and blocks form tiles of bounded size. One edit moves a word to its own block or to one where a letter of
one class is replaced by one of another, or where one letter more stands; only such blocks meet. For two tiles a NumPy product of
their letter-count matrices gives all squared distances; pairs of at most two are kept (no edit is further) and verified letter by letter.
What leaves a pair of tiles is, for each word, the number of its near words there and the best of them.

Null and empty texts have no words; a null id is written as nothing before the colon. Rows that repeat count again, as
each is an occurrence. Of near words with equal counts the smallest in code-point order is the form. Texts and words of any length go whole.
Columns of the input other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bound_batches, crc32_sql, join_unique, stored, table

LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A form is at least so many times as frequent.
FORM_RATIO = 5
#: One occurrence in so many loses a letter, chosen by the checksum of document and word.
MISSPELT = 199
RUN = r"[A-Za-zÀ-ÿ]"
CLASSES = 4
#: Words and bytes of a tile, and rows of a product taken at once.
TILE, TILE_BYTES, STRIP = 4096, 1 << 20, 512
_LETTERS = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))] + [chr(c) for c in range(ord("A"), ord("Z") + 1)]
NEAR = "word string, n long, n_near long, best_n long, best string"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, misspelt: int = MISSPELT) -> DataFrame:
    """word, n: maximal runs of letters with A-Z in lower case, one in ``misspelt`` of them without one letter; shorter or rarer ones go."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN + "{" + str(letters) + ",}"), F.lit(0))).alias("_run"))
    lowered = runs.select("_id", ascii_lower(F.col("_run")).alias("_run"))
    coded = lowered.select("_run", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")).alias("_h"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.substr("_run", F.lit(1), at), F.substr("_run", at + 2))
    said = coded.select(F.when(F.col("_h") % misspelt == 0, cut).otherwise(F.col("_run")).alias("word"))
    return said.where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _tiles(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, tiles): key, counts and parts of each block; key, part, letters (all words one after the other) and ns of each tile."""
    counts = [F.length("word") - F.length(F.translate("word", "".join(c for c in _LETTERS if ord(c) % CLASSES == i), "")) for i in range(CLASSES)]
    keyed = words.select("word", "n", F.concat_ws(",", *counts).alias("key"), F.length("word").alias("size"))
    room = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_BYTES) / F.first("size"))))
    blocks = stored(keyed.groupBy("key").agg(F.first("size").alias("size"), F.ceil(F.count(F.lit(1)) / room).cast("int").alias("parts")))
    dealt = join_unique(keyed.drop("size"), blocks.select("key", "parts"), "key").withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    own = F.sort_array(F.collect_list(F.struct("word", "n")))
    tiles = dealt.groupBy("key", "part").agg(own.alias("w"))
    return blocks, stored(tiles.select("key", "part", F.array_join(F.transform("w", lambda x: x["word"]), "").alias("letters"), F.transform("w", lambda x: x["n"]).alias("ns")))


def _neighbours(blocks: DataFrame) -> DataFrame:
    """a, pa, b, pb, longer: each two tiles that may hold words one edit apart, once; ``longer`` if words of b have a letter more."""
    at = F.transform(F.split("key", ","), lambda x: x.cast("int"))
    c = blocks.select("key", "parts", at.alias("c"))

    def moved(*steps: int):
        return F.array_join(F.array(*(F.get("c", F.lit(i)) + s for i, s in enumerate(steps))), ",")

    unit = [[int(i == j) for j in range(CLASSES)] for i in range(CLASSES)]
    replaced = [[y - x for x, y in zip(unit[i], unit[j], strict=True)] for i in range(CLASSES) for j in range(i + 1, CLASSES)]
    met = [(moved(*([0] * CLASSES)), False), *((moved(*s), False) for s in replaced), *((moved(*s), True) for s in unit)]
    asked = c.select(F.col("key").alias("a"), F.col("parts").alias("na"), F.explode(F.array(*(F.struct(k.alias("b"), F.lit(x).alias("longer")) for k, x in met))).alias("m")).select("a", "na", "m.*")
    found = asked.join(blocks.select(F.col("key").alias("b"), F.col("parts").alias("nb")), "b")
    parts = found.select("a", "b", "longer", "nb", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("pa"))
    return parts.select("a", "pa", "b", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("pa")).otherwise(F.lit(0)), F.col("nb") - 1)).alias("pb"), "longer").where("a != b OR pa <= pb")


def _matrix(said: np.ndarray, columns: np.ndarray, width: int, kind: type) -> np.ndarray:
    """Letter counts of the words in the rows of ``said``."""
    out, rows = np.zeros((len(said), width), kind), np.arange(len(said))
    for j in range(said.shape[1]):
        out[rows, columns[said[:, j]]] += 1
    return out


def _close(x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y whose letter counts are at a squared distance of at most two; of one and the same tile each pair once."""
    columns = np.zeros(256, np.int64)
    used = np.union1d(x, y)
    columns[used] = np.arange(len(used))
    kind = np.float32 if max(x.shape[1], y.shape[1]) < 2000 else np.float64  # all sums stay exact
    a, b = _matrix(x, columns, len(used), kind), _matrix(y, columns, len(used), kind)
    # 2 - |a - b|^2 as one product.
    a = np.c_[2 * a, np.ones(len(a), kind), 2 - (a * a).sum(1, keepdims=True)]
    b = np.c_[b, -(b * b).sum(1, keepdims=True), np.ones(len(b), kind)].T.copy()
    left, right = [], []
    for at in range(0, len(a), STRIP):
        first = at if same else 0
        hits = np.flatnonzero(a[at : at + STRIP] @ b[:, first:] >= 0)
        i, j = np.divmod(hits, b.shape[1] - first)
        i, j = i + at, j + first
        if same:
            i, j = i[i < j], j[i < j]
        left.append(i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _one_edit(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether x[i] and y[j] differ by one replaced letter or, where y's words are longer by one, by one inserted letter."""
    size, out = x.shape[1], np.zeros(len(i), bool)
    step = max(1, (16 << 20) // size)
    for at in range(0, len(i), step):
        a, b = x[i[at : at + step]], y[j[at : at + step]]
        if y.shape[1] == size:
            out[at : at + step] = (a != b).sum(1) == 1
            continue
        stop = np.ones((len(a), 1), bool)
        head = np.c_[a != b[:, :-1], stop].argmax(1)
        tail = np.c_[(a != b[:, 1:])[:, ::-1], stop].argmax(1)
        out[at : at + step] = head + tail >= size
    return out


def _best(of: np.ndarray, near: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row of ``of``, how many it is near to, and the one of these with the largest n, the first if several."""
    order = np.lexsort((near, -n[near], of))
    rows, first, counts = np.unique(of[order], return_index=True, return_counts=True)
    return rows, counts, near[order][first]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = [c.split()[0] for c in NEAR.split(", ")]
    for batch in batches:
        for r in range(batch.num_rows):
            tile = {c: batch[c][r] for c in ("x", "y", "nx", "ny")}
            nx, ny = (tile[c].values.to_numpy(zero_copy_only=False) for c in ("nx", "ny"))
            x, y = (np.frombuffer(tile[c].as_py().encode("latin-1"), np.uint8).reshape(len(n), -1) for c, n in (("x", nx), ("y", ny)))
            i, j = _close(x, y, batch["same"][r].as_py())
            ok = _one_edit(x, y, i, j)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            parts = []
            for own, other, w, v, n, m in ((i, j, x, y, nx, ny), (j, i, y, x, ny, nx)):
                rows, counts, best = _best(own, other, m)
                said = [[bytes(t[k]).decode("latin-1") for k in ks] for t, ks in ((w, rows), (v, best))]
                parts.append((said[0], n[rows], counts, m[best], said[1]))
            both = [[*a, *b] for a, b in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(both, kinds, strict=True)], names=names)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, best_n, best of stored ``words`` (word, n): the near words of each, counted, and the most frequent of them."""
    blocks, tiles = _tiles(words)
    pairs = _neighbours(blocks)
    left = tiles.select(F.col("key").alias("a"), F.col("part").alias("pa"), F.col("letters").alias("x"), F.col("ns").alias("nx"))
    right = tiles.select(F.col("key").alias("b"), F.col("part").alias("pb"), F.col("letters").alias("y"), F.col("ns").alias("ny"))
    met = pairs.join(left, ["a", "pa"]).join(right, ["b", "pb"])
    found = met.select("x", "nx", "y", "ny", F.expr("a = b AND pa = pb").alias("same")).mapInArrow(_compare, NEAR)
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))))
    every = found.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return every.select("word", "n", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, ratio: int = FORM_RATIO, misspelt: int = MISSPELT) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word's most frequent near word, if that is ``ratio`` times as frequent, and the end of that chain.

    Counts grow at least ``ratio``-fold along a chain, so a few doublings of its steps follow it to the end.
    """
    bound_batches(docs.sparkSession)
    words = stored(word_counts(docs, id_col, text_col, letters, least, misspelt))
    judged = near_words(words)
    takes = F.col("best_n") >= ratio * F.col("n")
    judged = stored(judged.select("word", "n", "n_near", F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")))
    up = stored(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = stored(join_unique(up, onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    out = judged.join(up.drop("moved"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir):
    return variant_groups(table(spark, sf_dir, "documents"))


_LOWER = "translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{6,}}')) AS r FROM documents),
lowered AS (SELECT id, {_LOWER} AS r, count(*) AS k FROM runs GROUP BY ALL),
coded AS (SELECT r, k, {crc32_sql("id || ':' || r")} AS h FROM lowered),
said AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, CAST(h % length(r) AS INTEGER)) || substr(r, CAST(h % length(r) AS INTEGER) + 2) ELSE r END AS word, k FROM coded),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM said WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
less AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS hole FROM less),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n AS n FROM holes AS a JOIN holes AS b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes AS a JOIN words AS b ON a.hole = b.word
  UNION SELECT b.word, a.word, a.n FROM holes AS a JOIN words AS b ON a.hole = b.word),
ranked AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM pairs),
judged AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN r.b END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
  FROM words AS w LEFT JOIN ranked AS r ON r.a = w.word AND r.place = 1),
chain AS (
  SELECT word, word AS root, 0 AS steps FROM judged
  UNION ALL SELECT c.word, j.form, c.steps + 1 FROM chain AS c JOIN judged AS j ON j.word = c.root WHERE j.form IS NOT NULL)
SELECT j.word, j.form, c.root, j.n, j.n_near, j.form_n FROM judged AS j
JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) AS c USING (word)
"""

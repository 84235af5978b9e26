"""Benchmark decontamination by a distributed positional inverted index.

Every ten consecutive words of a benchmark item are a window (an item of fewer words is one window). Document frequencies of
the windows' words are counted over the whole corpus; windows with a word that occurs nowhere are dropped. For each
remaining window the postings (term, document, position) of its rarest words are stored. The list of the rarest word,
shifted by the word's offset, gives places where the window would start; the lists of the next rarest words are intersected
with what is left, one after another. A place near which all have a posting is a proximity match, and an exact one if
the document has the window's words there. Built-in functions only.

Null and empty texts have no words; items without words have no window. Repeated document rows are each judged; other
columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_small, is_small, maybe_broadcast, stored

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: So many of a window's words, the rarest, have postings.
RAREST = 3
#: Words of a proximity match stand so many words from their places at most.
SLOP = 5
#: Places and postings meet by blocks of so many positions.
BLOCK = 64


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, a hash that tells texts of equal ids apart, words."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_k"), words_of(F.col(text_col)).alias("words"))


def phrase_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """win, words, items: distinct windows with the items that have them."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    rows = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return stored(stored(rows.groupBy("words").agg(F.collect_set("item").alias("items"))).withColumn("win", F.monotonically_increasing_id()))


def frequencies(keyed: DataFrame, windows: DataFrame) -> DataFrame:
    """term, df of the windows' words: in how many documents each occurs."""
    terms = stored(windows.select(F.explode("words").alias("term")).distinct())
    found = keyed.select(F.explode(F.array_distinct("words")).alias("term")).join(maybe_broadcast(terms), "term")
    return stored(found.groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def rarest_terms(windows: DataFrame, df: DataFrame, most: int = RAREST) -> DataFrame:
    """win, terms (off, term of the ``most`` rarest words, from the rarest on) of each window that may occur."""
    places = windows.select("win", F.posexplode("words").alias("off", "term")).join(df, "term", "left")
    of = Window.partitionBy("win")
    ranked = places.withColumn("_least", F.min(F.coalesce("df", F.lit(0))).over(of)).where("_least > 0")
    ranked = ranked.withColumn("k", F.row_number().over(of.orderBy("df", "term", "off")) - 1).where(F.col("k") < most)
    terms = F.transform(F.sort_array(F.collect_list(F.struct("k", "off", "term"))), lambda t: F.struct(t["off"].alias("off"), t["term"].alias("term")))
    return stored(ranked.groupBy("win").agg(terms.alias("terms")))


def postings(keyed: DataFrame, rarest: DataFrame) -> DataFrame:
    """The index: term, doc_id, _k, pos of every occurrence of the terms."""
    terms = stored(rarest.select(F.explode("terms.term").alias("term")).distinct())
    return stored(keyed.select("doc_id", "_k", F.posexplode("words").alias("pos", "term")).join(maybe_broadcast(terms), "term"))


def _by_term(index: DataFrame, windows: DataFrame, salts: int = 64) -> DataFrame:
    """``index`` joined with ``windows`` on their term: by broadcast within the bound of bytes, else with the postings of frequent terms salted."""
    if is_small(windows):
        return index.join(F.broadcast(windows), "term")
    n = stored(index.groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    total = n.agg(F.sum("n")).first()[0] or 0
    # Fewer than 500 terms can each hold over a 500th of all postings.
    often = F.broadcast(n.where(F.col("n") > total // 500).select("term", F.lit(True).alias("_often")))
    salt = F.when(F.col("_often"), F.pmod(F.xxhash64("doc_id", "_k", "pos"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    copies = F.when(F.col("_often"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = index.join(often, "term", "left").withColumn("_salt", salt).drop("_often")
    right = windows.join(often, "term", "left").withColumn("_salt", F.explode(copies)).drop("_often")
    return left.join(right, ["term", "_salt"]).drop("_salt")


def first_places(index: DataFrame, rarest: DataFrame) -> DataFrame:
    """doc_id, _k, win, terms, start: where each window would start by each posting of its rarest word alone."""
    first = stored(rarest.select("win", "terms", F.col("terms")[0]["off"].alias("off"), F.col("terms")[0]["term"].alias("term")))
    return _by_term(index, first).select("doc_id", "_k", "win", "terms", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")


def intersect(places: DataFrame, index: DataFrame, k: int, slop: int) -> DataFrame:
    """Those of ``places`` near which the list of the window's next rarest word, number ``k``, has a posting: within ``slop`` of its place.

    Windows with fewer words stay. Places and postings meet by term, document and block of positions, so that neither a frequent
    term nor a long document is one key.
    """
    done = places.where(F.size("terms") <= k)
    at = F.col("start") + F.col("terms")[k]["off"]
    blocks = F.sequence(F.floor(F.greatest(at - slop, F.lit(0)) / BLOCK), F.floor((at + slop) / BLOCK))
    asked = places.where(F.size("terms") > k).withColumn("_at", at).withColumn("_block", F.explode(blocks))
    lists = index.select(F.col("term").alias("_t"), F.col("doc_id").alias("_d"), F.col("_k").alias("_h"), F.col("pos").alias("_p"), F.floor(F.col("pos") / BLOCK).alias("_b"))
    same = (F.col("terms")[k]["term"] == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_h")) & (F.col("_block") == F.col("_b"))
    met = asked.join(lists, same & (F.abs(F.col("_p") - F.col("_at")) <= slop), "left_semi").select(*places.columns)
    return stored(done.unionByName(met))


def near_places(keyed: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """doc_id, _k, win, terms, start: where a window's rarest words all stand within ``slop`` of their places by the rarest. Exact matches are among them."""
    rarest = rarest_terms(windows, frequencies(keyed, windows))
    index = postings(keyed, rarest)
    places = first_places(index, rarest)
    for k in range(1, RAREST):
        places = intersect(places, index, k, slop)
    return places


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item, start, n_terms: windows whose rarest words (``n_terms`` of them) all stand within ``slop`` of their places.

    ``start`` is where the window would start by its rarest word. Exact matches are among them.
    """
    windows = phrase_windows(items)
    found = near_places(_keyed(docs, id_col, text_col), windows, slop)
    told = found.join(broadcast_small(windows), "win")
    return told.select("doc_id", F.explode("items").alias("item"), "start", F.size("terms").cast("long").alias("n_terms")).distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit (words inside exact matches), hits (start, size, items of each exact match), near (start, items of each
    proximity match, the exact ones included), a row per document row."""
    windows = phrase_windows(items)
    keyed = _keyed(docs, id_col, text_col)
    found = near_places(keyed, windows, slop)
    told = found.join(broadcast_small(windows), "win").groupBy("doc_id", "_k").agg(F.collect_set(F.struct("start", "words", "items")).alias("found"))
    by_doc = broadcast_small(stored(told.select(F.col("doc_id").alias("_d"), F.col("_k").alias("_h"), "found")))
    all_rows = keyed.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_h")), "left")
    # The document's own words at each place are compared with the window's.
    exact = F.filter("found", lambda f: F.slice(F.col("words"), f["start"] + 1, F.size(f["words"])) == f["words"])
    hits = F.transform(exact, lambda f: F.struct(f["start"].alias("start"), F.size(f["words"]).alias("size"), f["items"].alias("items")))
    hits = F.coalesce(hits, F.array().cast("array<struct<start:int,size:int,items:array<string>>>"))
    near = F.coalesce(F.transform("found", lambda f: F.struct(f["start"].alias("start"), f["items"].alias("items"))), F.array().cast("array<struct<start:int,items:array<string>>>"))
    judged = all_rows.select("doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"), near.alias("near"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))
    return judged.select("doc_id", "n_words", F.size(covered).cast("long").alias("n_hit"), "hits", "near")


def op2_decontamination(spark, sf_dir):
    """The digest of ``contamination``, and n_near, the number of items with a proximity match (exact ones included)."""
    from .common import table

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items_of = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda m: m["items"])))
    found = found.withColumn("_items", F.sort_array(items_of("hits")))
    digest = found.select("doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size(items_of("near")).cast("long").alias("n_near"))
    return digest


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT item, array_to_string(list_slice(ws, i, i + 9), ' ') AS g, least(len(ws), 10) AS n
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
p AS (SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), (SELECT DISTINCT n FROM w) WHERE i + n - 1 <= len(ws)),
h AS (SELECT doc_id, i, p.n, item FROM p JOIN w ON w.g = p.g AND w.n = p.n),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM h) GROUP BY doc_id),
f AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(ws)) AS term FROM d) GROUP BY term),
x AS (SELECT g, unnest(string_split(g, ' ')) AS term, unnest(range(0, len(string_split(g, ' ')))) AS off FROM (SELECT DISTINCT g FROM w)),
r AS (SELECT g, term, off, row_number() OVER (PARTITION BY g ORDER BY df, term, off) AS k, count(*) OVER (PARTITION BY g) AS terms, count(df) OVER (PARTITION BY g) AS known FROM x LEFT JOIN f USING (term)),
q AS (SELECT * FROM r WHERE k <= 3 AND known = terms),
o AS (SELECT doc_id, unnest(ws) AS term, unnest(range(0, len(ws))) AS pos FROM d),
l AS (SELECT doc_id, term, pos FROM o WHERE term IN (SELECT term FROM q)),
s AS (SELECT DISTINCT doc_id, g, pos - off AS start FROM l JOIN q ON l.term = q.term AND k = 1 WHERE pos >= off),
m AS (SELECT s.doc_id, s.g FROM s JOIN q ON q.g = s.g JOIN l ON l.doc_id = s.doc_id AND l.term = q.term WHERE abs(l.pos - q.off - s.start) <= 5
  GROUP BY s.doc_id, s.g, s.start, q.terms HAVING count(DISTINCT k) = least(3, q.terms)),
u AS (SELECT m.doc_id, count(DISTINCT item) AS n_near FROM m JOIN w ON w.g = m.g GROUP BY m.doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id
"""

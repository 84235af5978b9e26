"""N-gram Jaccard join by vertical partitioning.

The global order of shingles goes by estimated frequency, then hash. A text's prefix in that order (all that J >= 0.8 needs)
is posted; texts that share a posted shingle are candidates. The order is cut into fragments; a candidate pair's overlap is
counted in each fragment separately and summed per pair. Links make components.

Before that, candidates go whose profiles (sizes of many small fragments) rule a link out.
Frequencies are counted over all documents in a sketch of fixed size, whatever the input; any order gives the same links, a
good one keeps frequent shingles out of the prefixes. Equal sets are one node. Empty and null texts have no shingles and
link with nothing. Repeated rows are copies. Texts without an id count as
nodes only where a copy has one. Only id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, join_hot, maybe_broadcast, stored
from .components import link_lists
from .shingles import digest, shingles, words

#: The sketch has 2**SKETCH_BITS counters (16 MB), in blocks of BLOCK.
SKETCH_BITS, BLOCK, SALTS = 22, 1 << 14, 64
#: Shingles to a counter of a text's profile.
PROFILE = 8
FRAGMENTS = 8
#: J >= PERCENT / 100.
PERCENT = 80
#: 100 * I >= 80 * (na + nb - I), where I is at most what stands from the first shared place on.
BOUND = f"{100 + PERCENT} * least(na - pa, nb - pb) >= {PERCENT} * (na + nb)"

SETS = "doc_id long, n long, key long, profile binary, block int, salt int, counts binary"


def profile(s: np.ndarray) -> bytes | None:
    """How many shingles fall into each of about n / PROFILE ranges of hashes, a byte each; None if a byte won't do."""
    bits = max(0, (max(1, len(s) // PROFILE) - 1).bit_length())
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(s), np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def most_shared(x: bytes, y: bytes) -> int:
    """No overlap is larger than the sum of the smaller counts in each range."""
    a, b = (np.frombuffer(p, np.uint8).astype(np.int64) for p in (x, y))
    k = min(len(a), len(b))
    return int(np.minimum(a.reshape(k, -1).sum(axis=1), b.reshape(k, -1).sum(axis=1)).sum())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, then the task's part of the sketch."""
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("profile", pa.binary()), ("block", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])
    for b in batches:
        ids, sizes, keys, profiles = b[0], [], [], []
        for text in b[1]:
            s = shingles(words(text.as_py() or ""))
            sizes.append(len(s))
            keys.append(digest(s) if len(s) else None)
            profiles.append(profile(s) if len(s) else None)
            np.add.at(sketch, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.int32(1))
        none = pa.nulls(len(ids))
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(profiles, pa.binary()), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
    if sketch.any():
        blocks, salt = sketch.reshape(-1, BLOCK), TaskContext.get().partitionId() % SALTS
        k, none = len(blocks), pa.nulls(len(blocks), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(k, pa.binary()), pa.array(np.arange(k, dtype=np.int32)), pa.array([salt] * k, pa.int32()), pa.array([zlib.compress(x.astype(np.int64).tobytes(), 1) for x in blocks], pa.binary())], schema=schema)


def _add_up(df: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK, np.int64)
    for x in df["counts"]:
        total += np.frombuffer(zlib.decompress(x), dtype=np.int64)
    return pd.DataFrame({"block": [df["block"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def merge_sketch(parts: DataFrame) -> np.ndarray:
    """The counters, 16 MB whatever the input; those that would not fit hold the most that does."""
    once = parts.groupBy("block", "salt").applyInPandas(_add_up, "block int, counts binary")
    rows = once.groupBy("block").applyInPandas(_add_up, "block int, counts binary").collect()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
    for r in rows:
        own = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64)
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.minimum(own, np.iinfo(np.int32).max)
    return out


def _frequency(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]


def _signed(s: np.ndarray) -> pa.Array:
    return pa.array(s.view(np.int64))


POSTINGS = "s long, node long, n int, pos int, frequent boolean"


def postings(docs: DataFrame, sketch, frequent: int) -> DataFrame:
    """A row for each shingle of each text's prefix."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, seen = sketch.value, set()
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []

            def flush(out=out):
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                return pa.RecordBatch.from_arrays([_signed(cols[0]), *map(pa.array, cols[1:])], names=[x.split()[0] for x in POSTINGS.split(", ")])

            held = 0
            for text in b[1]:
                s = shingles(words(text.as_py() or ""))
                n = len(s)
                if not n or (key := digest(s)) in seen:
                    continue
                seen.add(key)
                f = _frequency(s, counters)
                p = n - (n * PERCENT + 99) // 100 + 1
                first = np.lexsort((s, f))[:p] if p < n else np.lexsort((s, f))
                out.append((s[first], np.full(len(first), key, np.int64), np.full(len(first), n, np.int32), np.arange(len(first), dtype=np.int32), f[first] > frequent))
                held += len(first)
                if held > 200_000:
                    yield flush()
                    out.clear()
                    held = 0
            if out:
                yield flush()

    return docs.select("doc_id", "text").mapInArrow(post, POSTINGS)


LISTS = "s long, node long, n int, pos int, m int, other long, n_other int, frequent boolean"
_LIST_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())


def _list_rows(s=None, node=None, n=None, pos=None, m=None, other=None, n_other=None, frequent=False) -> pa.RecordBatch:
    k = len(node)
    given = (s, node, n, pos, m, other, n_other, np.full(k, frequent))
    return pa.RecordBatch.from_arrays([pa.nulls(k, t) if c is None else pa.array(c).cast(t) for c, t in zip(given, _LIST_KINDS, strict=True)], names=[x.split()[0] for x in LISTS.split(", ")])


def shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition dealt by list, what two nodes or more share; frequent lists, dealt by node, as they are.

    A list of two becomes a pair, unless the bound rules it out. Longer lists of the same nodes become one, named by its nodes,
    with each node's first place in any of them. Repeated pairs and rows go.
    """
    rare: list[pa.RecordBatch] = []
    for b in batches:
        often = b.filter(b["frequent"])
        if often.num_rows:
            yield _list_rows(often["s"], often["node"], often["n"], often["pos"], frequent=True)
        if often.num_rows < b.num_rows:
            rare.append(b.filter(pa.compute.invert(b["frequent"])))
    if not rare:
        return
    t = pa.Table.from_batches(rare)
    s, node, n, pos = (t[x].to_numpy() for x in ("s", "node", "n", "pos"))
    order = np.lexsort((pos, node, s))
    s, node, n, pos = s[order], node[order], n[order].astype(np.int64), pos[order].astype(np.int64)
    new = np.r_[True, (s[1:] != s[:-1]) | (node[1:] != node[:-1])]
    s, node, n, pos = s[new], node[new], n[new], pos[new]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    sizes = np.diff(np.r_[starts, len(s)])
    two = starts[sizes == 2]
    fits = (100 + PERCENT) * np.minimum(n[two] - pos[two], n[two + 1] - pos[two + 1]) >= PERCENT * (n[two] + n[two + 1])
    two = two[fits]
    if len(two):
        by = np.lexsort((node[two + 1], node[two]))
        two = two[by]
        two = two[np.r_[True, (node[two[1:]] != node[two[:-1]]) | (node[two[1:] + 1] != node[two[:-1] + 1])]]
        yield _list_rows(node=node[two], n=n[two], other=node[two + 1], n_other=n[two + 1])
    long = np.repeat(sizes > 2, sizes)
    if not long.any():
        return
    mixed = node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    name = np.repeat(np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts), sizes).view(np.int64)
    name, node, n, pos, m = name[long], node[long], n[long], pos[long], np.repeat(sizes, sizes)[long]
    order = np.lexsort((pos, node, name))
    name, node = name[order], node[order]
    keep = np.r_[True, (name[1:] != name[:-1]) | (node[1:] != node[:-1])]
    rows = order[keep]
    yield _list_rows(name[keep], node[keep], n[rows], pos[rows], m[rows])


def collect_lists(posted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lists, pairs) for ``link_lists`` from rows (s, node, n, pos, frequent)."""
    deal = F.when(F.col("frequent"), F.xxhash64("s", "node")).otherwise(F.col("s"))
    dealt = posted.withColumn("_deal", deal).repartition("_deal").drop("_deal")
    return split_lists(stored(dealt.mapInArrow(shared_lists, LISTS)))


def split_lists(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    ordered = F.col("node") < F.col("other")
    pairs = found.where("other IS NOT NULL").select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), F.when(ordered, F.col("n")).otherwise(F.col("n_other")).alias("na"), F.when(ordered, F.col("n_other")).otherwise(F.col("n")).alias("nb")
    )
    long = found.where("other IS NULL")
    rare = long.where("NOT frequent").groupBy("s", "node", "n", "m").agg(F.min("pos").alias("pos"))
    often = long.where("frequent").groupBy("s", "node", "n").agg(F.min("pos").alias("pos"))
    counts = stored(often.groupBy("s").agg(F.count(F.lit(1)).cast("int").alias("m")).where("m > 1"))
    lists = rare.unionByName(often.join(maybe_broadcast(counts), "s").select("s", "node", "n", "m", "pos"))
    return stored(lists), pairs


def may_link(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``pairs`` without those whose profiles rule out a link; loses none that links."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b[c].to_pylist() for c in ("na", "nb", "x", "y")), strict=True)
            yield b.filter(pa.array([x is None or y is None or (100 + PERCENT) * most_shared(x, y) >= PERCENT * (na + nb) for na, nb, x, y in rows], pa.bool_())).select(["a", "b", "na", "nb"])

    x = profiles.select(F.col("node").alias("a"), F.col("profile").alias("x"))
    y = profiles.select(F.col("node").alias("b"), F.col("profile").alias("y"))
    sized = pairs.select("a", "b", F.col("na").cast("long"), F.col("nb").cast("long"))
    return sized.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(keep, "a long, b long, na long, nb long")


def overlaps(pairs: DataFrame, docs: DataFrame, members: DataFrame, sketch, pivots: np.ndarray) -> DataFrame:
    """(a, b, na, nb, overlap) of pairs of nodes: fragment by fragment, then summed.

    ``members``: (node, doc_id) of a document of each node.
    """
    schema = "a long, b long, na long, nb long, fragment int, second boolean, tokens array<long>"

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = sketch.value
        for batch in batches:
            out: list[tuple] = []
            size = 0
            last, parts, name = None, [], None
            for text, *pair, second in zip(*(batch[c].to_pylist() for c in ("text", "a", "b", "na", "nb", "second")), strict=True):
                if last is None or text != last:
                    s = shingles(words(text or ""))
                    name = digest(s)
                    where = np.searchsorted(pivots, _frequency(s, counters), side="right")
                    parts, last = [(f, s[where == f].view(np.int64)) for f in range(FRAGMENTS)], text
                for f, tokens in parts if name == pair[second] else ():
                    if len(tokens):
                        out.append((*pair, f, second, tokens))
                        size += len(tokens)
                if size > 500_000:
                    yield _rows(out)
                    out, size = [], 0
            if out:
                yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(),) * 4 + (pa.int32(), pa.bool_(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(False).alias("second")), F.struct(F.col("b").alias("node"), F.lit(True).alias("second")))).alias("e"), "a", "b", "na", "nb")
    ends = stored(ends.select("e.*", "a", "b", "na", "nb").join(members, "node").drop("node"))
    texts = docs.select("doc_id", "text").join(maybe_broadcast(ends), "doc_id")
    counted = texts.select("text", "a", "b", "na", "nb", "second").mapInArrow(segments, schema)
    met = counted.groupBy("a", "b", "na", "nb", "fragment").agg(F.first(F.when(~F.col("second"), F.col("tokens")), True).alias("x"), F.first(F.when(F.col("second"), F.col("tokens")), True).alias("y"))
    partial = met.select("a", "b", "na", "nb", F.coalesce(F.size(F.array_intersect("x", "y")), F.lit(0)).alias("o"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("overlap"))


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links of J >= 0.8, itself included."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", "text")
    passed = stored(docs.mapInArrow(_sets, SETS))
    sets = passed.where("block IS NULL").select("doc_id", "n", "key", "profile")
    counters = merge_sketch(passed.where("block IS NOT NULL").select("block", "salt", "counts"))
    total = int(counters.sum(dtype=np.int64))
    sketch = spark.sparkContext.broadcast(counters)
    # Fragments: cuts of the order into ranges of estimated frequency with about as many occurrences each.
    by = np.sort(counters)
    pivots = by[np.minimum(np.searchsorted(np.cumsum(by, dtype=np.int64), total * np.arange(1, FRAGMENTS) / FRAGMENTS), len(by) - 1)] if total else np.zeros(FRAGMENTS - 1, np.int64)
    nodes = stored(sets.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("profile").alias("profile")))
    sets = sets.drop("profile")
    copies = sets.where("key IS NOT NULL").join(nodes.select(F.col("doc_id").alias("_first"), F.col("key").alias("_key")), (F.col("key") == F.col("_key")) & (F.col("doc_id") == F.col("_first")), "left_anti")
    rest = stored(copies.select("doc_id").distinct())
    firsts = docs.join(maybe_broadcast(rest), "doc_id", "left_anti")

    # A list is longer than this only if its shingle is marked as frequent; there are few such shingles.
    frequent = max(1000, int(counters.mean() * 2 + total / 100_000))
    posted = postings(firsts, sketch, frequent)
    lists, pairs = collect_lists(posted)
    members = nodes.select(F.col("key").alias("node"), "doc_id")

    def verify(pairs: DataFrame) -> DataFrame:
        likely = stored(may_link(pairs, nodes.select(F.col("key").alias("node"), "profile")))
        return overlaps(likely, docs, members, sketch, pivots).where(f"{100 + PERCENT} * overlap >= {PERCENT} * (na + nb)").select("a", "b")

    labels, _ = link_lists(lists, verify, BOUND, pairs)
    out = nodes.select("key", "doc_id", F.col("copies").alias("n"))
    if labels is not None:
        in_group = labels.join(members, "node")
        smallest = in_group.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        known = stored(in_group.join(smallest, "component").select(F.col("node").alias("key"), "component_id"))
        out = out.join(known, "key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    else:
        out = out.withColumn("component_id", F.col("doc_id"))
    placed = stored(out.select("key", "component_id", "n").where("n > 1 OR component_id != doc_id") if labels is not None else out.select("key", "component_id", "n").where("n > 1"))
    done = join_hot(sets, placed, "key")
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_ngram_jaccard_join(spark, sf_dir):
    from .common import table

    return similar_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, hash(list_slice(ws, i, i + 4)) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
s AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN s ON s.g = a.g JOIN g b ON b.g = a.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""

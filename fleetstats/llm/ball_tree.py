"""Exact top-k inner-product search: ball trees by shard, searched by branch and bound.

A vector's components become floor(256 * x). Rows are dealt to shards of bounded size by their id; each shard is a ball tree over its
distinct vectors, stored as one row. A node's bound for a query is the inner product with its centre plus its radius times the
query's norm; nodes are taken in the order of their bounds until none reaches the kth score. That score is shared: first
every shard gives each query the scores of its most promising leaf; the best of all shards are a floor with which the trees
are then searched. Queries meet shards in blocks.

Vectors that are null, hold a null or a number that isn't finite (also after scaling) take no part; vectors of different length are
not compared. Rows that repeat an id and a vector are one. An id with several vectors is a candidate with each, and as a query its
results are the best over all of them. A query's own id is no candidate of it. A null id is a candidate, last among
ties, and no query. Empty vectors score 0. Scores beyond a long are cut to its range. Columns other than the two named aren't read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, maybe_broadcast, stored, table

SCALE, K = 256, 5
#: Distinct vectors of a leaf; rows of a shard, and queries of a block, about; bytes of their vectors at most, about.
LEAF, SHARD_ROWS, QUERY_ROWS, PACK_BYTES = 96, 8192, 1024, 8 << 20
#: Doubles hold all integers up to here.
EXACT = 2.0**53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
TREE = "dim int, part int, ids array<long>, bounds array<long>, vectors array<double>, starts array<long>, ends array<long>, firsts array<long>, centres array<double>, radii array<double>"
FOUND = "query_id long, vec_id long, score long"


def _batch(columns: dict[str, object]) -> pa.RecordBatch:
    """One row: numbers as they are, arrays as lists."""
    arrays = [pa.array([int(c)], pa.int32()) if isinstance(c, int) else pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c)) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _list(batch: pa.RecordBatch, name: str, r: int) -> pa.Array:
    return batch[name][r].values


def _numbers(batch: pa.RecordBatch, name: str, r: int) -> np.ndarray:
    return _list(batch, name, r).to_numpy(zero_copy_only=False)


def _integers(vectors: pa.Array, rows: int) -> np.ndarray:
    """Vectors as they are compared: whole numbers, kept as doubles."""
    return np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False)).reshape(rows, -1) + 0.0


def packed(rows: DataFrame, most: int) -> DataFrame:
    """dim, part, own: rows (vec_id, embedding and others) dealt by id into parts of about ``most`` vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * SCALE) == float("inf")))
    valid = rows.withColumn("embedding", v).withColumn("dim", F.size(v)).where(F.col("embedding").isNotNull() & whole)
    room = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.lit(PACK_BYTES) / (8 * F.col("dim") + 8))))
    sizes = stored(valid.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", F.ceil(F.col("n") / room).cast("int").alias("parts")))
    dealt = valid.join(maybe_broadcast(sizes), "dim").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    return dealt.groupBy("dim", "part").agg(F.collect_list(F.struct(*rows.columns)).alias("own"))


def ball_tree(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order, starts, ends, firsts, centres, radii): node i holds the rows order[starts[i]:ends[i]]; its children are firsts[i] and the next, none if 0.

    A node is cut in the middle of its rows as they lie between two far ones, so the depth is bounded for any data.
    """
    order, starts, ends, firsts, centres, radii, todo = np.arange(len(x)), [0], [len(x)], [0], [None], [0.0], [0]
    while todo:
        at = todo.pop()
        lo, hi = starts[at], ends[at]
        own = x[order[lo:hi]]
        centres[at] = own.mean(0)
        far = np.linalg.norm(own - centres[at], axis=1)
        radii[at] = float(far.max())
        if hi - lo <= LEAF:
            continue
        a = own[far.argmax()]
        b = own[np.linalg.norm(own - a, axis=1).argmax()]
        order[lo:hi] = order[lo:hi][np.argsort(own @ (b - a), kind="stable")]
        middle, firsts[at] = (lo + hi) // 2, len(starts)
        todo += [len(starts), len(starts) + 1]
        starts += [lo, middle]
        ends += [middle, hi]
        firsts += [0, 0]
        centres += [None, None]
        radii += [0.0, 0.0]
    return order, np.array(starts), np.array(ends), np.array(firsts), np.array(centres), np.array(radii)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tree over the distinct vectors of each part, and the ids of each of these, smallest first, null last."""
    for b in batches:
        for r in range(b.num_rows):
            own = _list(b, "own", r)
            ids = own.field("vec_id")
            x = _integers(own.field("embedding"), len(own))
            distinct, group = np.unique(x, axis=0, return_inverse=True) if x.shape[1] else (x[:1], np.zeros(len(x), np.int64))
            order, starts, ends, firsts, centres, radii = ball_tree(distinct)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at, known, n = place[group.ravel()], np.array(ids.is_valid()), ids.fill_null(_MOST).to_numpy(zero_copy_only=False)
            by = np.lexsort((n, ~known, at))
            same = (np.diff(at[by]) == 0) & (np.diff(n[by]) == 0) & (known[by][1:] == known[by][:-1])
            by = by[np.r_[True, ~same]]
            bounds = np.r_[np.flatnonzero(np.r_[True, np.diff(at[by]) != 0]), len(by)]
            yield _batch({"dim": b["dim"][r].as_py(), "part": b["part"][r].as_py(), "ids": pa.array(n[by], mask=~known[by]), "bounds": bounds, "vectors": distinct[order].ravel(), "starts": starts, "ends": ends, "firsts": firsts, "centres": centres.ravel(), "radii": radii})


class Shard:
    """A part's tree, searched query by query."""

    def __init__(self, batch: pa.RecordBatch, r: int):
        ids = _list(batch, "ids", r)
        self.known, self.ids = np.array(ids.is_valid()), ids.fill_null(_MOST).to_numpy(zero_copy_only=False)
        self.bounds, self.starts, self.ends, self.firsts, self.radii = (_numbers(batch, c, r) for c in ("bounds", "starts", "ends", "firsts", "radii"))
        self.x = _numbers(batch, "vectors", r).reshape(len(self.bounds) - 1, -1)
        self.centres = _numbers(batch, "centres", r).reshape(len(self.starts), -1)
        self.largest = float(np.abs(self.x).max(initial=0)) * max(1, self.x.shape[1])
        self.reach = np.linalg.norm(self.centres, axis=1) + self.radii

    def bound(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of every node for each query, with room for rounding."""
        norms = np.linalg.norm(queries, axis=1)[:, None]
        return queries @ self.centres.T + norms * self.radii + 1e-9 * norms * self.reach + 0.5

    def scores(self, node: int, q: np.ndarray) -> np.ndarray:
        x = self.x[self.starts[node] : self.ends[node]]
        if self.largest * float(np.abs(q).max(initial=0)) < EXACT:
            return x @ q
        whole = [int(c) for c in q]
        return np.array([max(_LEAST, min(_MOST, sum(int(a) * b for a, b in zip(v, whole, strict=True)))) for v in x], dtype=object)

    def offer(self, best: list[tuple], k: int, query: int, row: int, score: int) -> None:
        """The ids of distinct vector ``row``: those after the k smallest, the query's own aside, can't be among the best."""
        taken = 0
        for i in range(self.bounds[row], self.bounds[row + 1]):
            if self.known[i] and self.ids[i] == query:
                continue
            entry = (score, bool(self.known[i]), -int(self.ids[i]))
            if len(best) == k and entry <= best[0] or taken == k:
                return
            (heapq.heappush if len(best) < k else heapq.heapreplace)(best, entry)
            taken += 1

    def search(self, query: int, q: np.ndarray, bounds: np.ndarray, k: int, floor: float, leaves: int | None) -> list[tuple]:
        """The k best (score, id known, -id) of at least ``floor``, from so many leaves only if ``leaves`` is given."""
        best: list[tuple] = []
        todo = [(-bounds[0], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            least = max(floor, best[0][0]) if len(best) == k else floor
            if -bound < least:
                break
            if first := self.firsts[node]:
                heapq.heappush(todo, (max(bound, -bounds[first]), first))
                heapq.heappush(todo, (max(bound, -bounds[first + 1]), first + 1))
                continue
            scores = self.scores(node, q)
            for i in np.flatnonzero(scores >= least):
                self.offer(best, k, query, int(self.starts[node] + i), int(scores[i]))
            if leaves is not None and (leaves := leaves - 1) == 0:
                break
        return best


def _search(k: int, leaves: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                shard, asked, out, seen = Shard(b, r), _list(b, "own", r), [], set()
                queries = _integers(asked.field("embedding"), len(asked))
                rows = zip(asked.field("vec_id").to_pylist(), asked.field("floor").to_pylist(), queries, shard.bound(queries), strict=True)
                for query, floor, q, bounds in rows:
                    if (key := (query, q.tobytes())) not in seen:
                        seen.add(key)
                        out += [(query, -i if known else None, score) for score, known, i in shard.search(query, q, bounds, k, floor, leaves)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 3)], names=["query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, asked: str, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``asked`` (SQL) the k rows of the highest integer inner products, ties to the smaller id."""
    bound_batches(rows.sparkSession)
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.expr(asked).alias("asked"))
    trees = stored(packed(own.drop("asked"), SHARD_ROWS).mapInArrow(_plant, TREE))
    queries = own.where(F.col("asked") & F.col("vec_id").isNotNull()).drop("asked")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))

    def searched(blocks: DataFrame, leaves: int | None = None) -> DataFrame:
        """The stated queries against all rows: each block of queries beside each shard of its dimension."""
        pairs = blocks.select("dim", F.col("part").alias("block")).join(trees.select("dim", "part"), "dim")
        met = pairs.join(blocks.withColumnRenamed("part", "block"), ["dim", "block"]).join(trees, ["dim", "part"])
        ranked = met.mapInArrow(_search(k, leaves), FOUND).withColumn("rank", F.row_number().over(order))
        return ranked.where(F.col("rank") <= k)

    first = stored(packed(queries.withColumn("floor", F.lit(float("-inf"))), QUERY_ROWS))
    kth = searched(first, 1).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    # As a double a large score may be rounded up.
    kth = stored(kth.withColumn("floor", F.when(F.abs("floor") < EXACT / 2, F.col("floor")).otherwise(F.col("floor") - F.abs("floor") * 1e-12)))
    informed = queries.join(maybe_broadcast(kth), "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    return searched(stored(packed(informed, QUERY_ROWS))).select("query_id", "rank", "vec_id", "score")


def op12_exact_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({SCALE} * x)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id))
WHERE rank <= {K}
"""

"""Trie of conversation prefixes, from ternary search trees by range shard.

Turns, (role, text), get numbers from a dictionary. Conversations are sorted by their turns' numbers and cut into ranges; each range is a
shard, which puts its conversations into a ternary search tree, the middle one first and so on in each half, so that it is balanced, and goes
through it without recursion to gather members, leaves and savings. Only nodes on the path of a shard's first or last
conversation can go on in other shards: these leave the shard in parts, named by a hash of their prefix, and are merged. What lies below a
merged node is what its parts counted of whole nodes there, and the merged nodes below it, each counted in the first shard that
has it. Members that end at a merged node are hashed as a stream in the order of their ids.

Turns are ordered by turn (null first), then role, then the hash of role and text; null roles and texts are empty. Rows that repeat are
repeated turns. Rows without a conv_id take no part. An empty table has no nodes, not even a root. Texts don't leave the first
projection, whatever their length; a conversation is one array of numbers. Columns other than the four aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, crc32_sql, join_unique, stored, table

#: Turns (and conversations) of a shard, about; rows sent at once.
SHARD_TURNS, SLICE = 65_536, 8192
SEQUENCE = "array<struct<id:bigint,words:bigint>>"
#: A node of a shard. Whole nodes have no name; parts have one, and what they count is of whole nodes below them alone (n_convs: of the shard's members).
NODE = (
    "shard int, node binary, parent binary, branch int, turn long, words long, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends_first long, ends string"
)
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_FIELDS = [tuple(c.split()) for c in NODE.split(", ")]
COLUMNS = ("turn", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_NONE = hashlib.sha256(b"").hexdigest()


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, seq: for each conversation its turns in order, as numbers of the dictionary with the words of their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = stored(conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), words.alias("words")))
    dictionary = stored(turns.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()))  # stored, so that numbers stay
    numbered = join_unique(turns, dictionary, "digest")
    said = F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "id", "words")))
    return numbered.groupBy("conv_id").agg(F.transform(said, lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("seq"))


class SearchTree:
    """A ternary search tree of sequences of numbers. Node 0 is the root, the empty prefix; each other one is the prefix that ends with its number."""

    def __init__(self):
        self.key, self.lower, self.equal, self.higher = [0], [0], [0], [0]
        self.words, self.members, self.least, self.ends = [0], [0], [None], [None]

    def _new(self, links: list[int], at: int, key: int, words: int) -> int:
        new = links[at] = len(self.key)
        for column, value in ((self.key, key), (self.lower, 0), (self.equal, 0), (self.higher, 0), (self.words, words), (self.members, 0), (self.least, None), (self.ends, None)):
            column.append(value)
        return new

    def insert(self, ids: list[int], words: list[int], n: int, least: int, ends: tuple[int, int]) -> None:
        """A sequence of ``n`` members, of which ``least`` is the smallest; ``ends``: where they stand."""
        at = 0
        for depth in range(len(ids) + 1):
            if depth:
                key, links, up = ids[depth - 1], self.equal, at
                at = links[up]
                while at and self.key[at] != key:
                    links, up = (self.lower if key < self.key[at] else self.higher), at
                    at = links[up]
                if not at:
                    at = self._new(links, up, key, words[depth - 1])
            self.members[at] += n
            if self.least[at] is None or least < self.least[at]:
                self.least[at] = least
        self.ends[at] = ends

    def path(self, ids: list[int]) -> list[int]:
        """The nodes of all prefixes of a sequence that is there."""
        out = [0]
        for key in ids:
            at = self.equal[out[-1]]
            while self.key[at] != key:
                at = self.lower[at] if key < self.key[at] else self.higher[at]
            out.append(at)
        return out

    def walk(self) -> tuple[list[int], list[int], list[int]]:
        """(nodes, parent, depth): nodes so that each comes after its parent; parent and depth by node."""
        parent, depth, order, todo = [0] * len(self.key), [0] * len(self.key), [0], [(self.equal[0], 0, 1)]
        while todo:
            at, up, deep = todo.pop()
            if at:
                order.append(at)
                parent[at], depth[at] = up, deep
                todo += [(self.lower[at], up, deep), (self.higher[at], up, deep), (self.equal[at], at, deep + 1)]
        return order, parent, depth


def _halves(n: int) -> Iterator[int]:
    """0 to n - 1: the middle one, then those of each half."""
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if lo < hi:
            middle = (lo + hi) // 2
            yield middle
            todo += [(lo, middle), (middle + 1, hi)]


def _names(ids: list[int]) -> list[bytes]:
    """A name for each prefix, the empty one first."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for key in ids:
        h.update(key.to_bytes(8, "little", signed=True))
        out.append(h.digest())
    return out


def shard_nodes(convs: list[int], offsets: np.ndarray, ids: np.ndarray, words: np.ndarray, shard: int) -> Iterator[tuple]:
    """Rows of NODE for conversations sorted by sequence, then id; the turns of number i are ids[offsets[i]:offsets[i + 1]]."""
    cut = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    groups = [i for i in range(len(cut)) if not i or cut[i] != cut[i - 1]] + [len(cut)]
    tree = SearchTree()
    for g in _halves(len(groups) - 1):
        lo, hi = groups[g], groups[g + 1]
        tree.insert(cut[lo], words[offsets[lo] : offsets[lo + 1]].tolist(), hi - lo, convs[lo], (lo, hi))
    first, last = tree.path(cut[0]), tree.path(cut[-1])
    name = dict(zip(first, _names(cut[0]))) | dict(zip(last, _names(cut[-1])))
    branch = dict.fromkeys(first, 1) | {t: 0 if t in set(first) else 2 for t in last}
    order, parent, depth = tree.walk()
    children, leaves, saved = ([0] * len(order) for _ in range(3))
    for at in reversed(order[1:]):
        up = parent[at]
        if at not in name:
            leaves[at] += not children[at]
            saved[at] += (tree.members[at] - 1) * tree.words[at]
            children[up] += 1
        leaves[up] += leaves[at]
        saved[up] += saved[at]
    for at in order:
        lo, hi = tree.ends[at] or (0, 0)
        ends = ",".join(map(str, convs[lo:hi]))
        up, part = parent[at], at in name
        above = name.get(up) if at else None
        told = (tree.key[at] if at else None, tree.words[at], depth[at], tree.least[at], None if part or above else tree.least[up], tree.members[at], children[at], leaves[at], saved[at])
        yield (shard, name.get(at), above, branch.get(at), *told, *((None, convs[lo], ends) if part and hi else (None if part else hashlib.sha256(ends.encode()).hexdigest(), None, None)))


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    convs, sizes, ids, words = [], [], [], []
    for b in batches:
        seq = b["seq"]
        convs += b["conv_id"].to_pylist()
        sizes.append(seq.value_lengths().to_numpy(zero_copy_only=False))
        turns = seq.flatten()
        ids.append(turns.field("id").to_numpy(zero_copy_only=False))
        words.append(turns.field("words").to_numpy(zero_copy_only=False))
    if not convs:
        return
    rows = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(zip(*rows), _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

    for row in shard_nodes(convs, np.r_[0, np.cumsum(np.concatenate(sizes))], np.concatenate(ids), np.concatenate(words), TaskContext.get().partitionId()):
        rows.append(row)
        if len(rows) == SLICE:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, ends_sha256 from the parts of each node's list, which come in order; no list is ever whole in memory."""
    node, h = None, None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["node", "ends_sha256"])

    for b in batches:
        rows = []
        for own, ends in zip(b["node"].to_pylist(), b["ends"].to_pylist(), strict=True):
            if own != node:
                if h:
                    rows.append((node, h.hexdigest()))
                node, h = own, hashlib.sha256(ends.encode())
            else:
                h.update(b"," + ends.encode())
        yield batch(rows)
    if h:
        yield batch([(node, h.hexdigest())])


def _merged(edge: DataFrame) -> DataFrame:
    """The nodes whose parts are the rows of ``edge``, with their names."""
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    once = edge.groupBy("node").agg(*(F.max(c).alias(c) for c in ("parent", "turn", "words", "depth")), F.min("conv_id").alias("conv_id"), F.min("shard").alias("home"), *total)
    once = stored(once)
    kids = stored(once.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids")))
    known = join_unique(once, kids, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids")
    known = stored(known.withColumn("own_leaf", (F.col("n_children") == 0).cast("long")).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("words")))
    # Below a part of a node: in its shard, the merged nodes of its path that are deeper, and for the path that first and last share also both others'.
    own = join_unique(edge.select("shard", "branch", "depth", "node"), known.select("node", "home", "own_leaf", "own_saved"), "node")
    here = [F.when(F.col("home") == F.col("shard"), F.col(c)).otherwise(0) for c in ("own_leaf", "own_saved")]
    path = Window.partitionBy("shard", "branch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    shared = Window.partitionBy("shard").orderBy(F.desc("branch"), F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = own.select("node", *(F.when(F.col("branch") == 0, F.sum(c).over(shared)).otherwise(F.sum(c).over(path)).alias(n) for c, n in zip(here, ("leaves", "saved"), strict=True)))
    below = stored(below.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    ends = edge.where("ends IS NOT NULL").select("node", "ends_first", "ends").repartition("node").sortWithinPartitions("node", "ends_first").select("node", "ends")
    hashed = stored(ends.mapInArrow(_hash_ends, "node binary, ends_sha256 string"))
    whole = join_unique(join_unique(known, below, "node"), hashed, "node", "left")
    parents = stored(once.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    whole = join_unique(whole, parents, "parent", "left")
    return whole.withColumn("n_leaves", F.col("n_leaves") + F.col("leaves")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("saved")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE)))


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row for each node: the number of its last turn, depth, smallest member, its parent's, members, children, childless nodes and savings below, hash of the members that end there.

    ``sequences``: conv_id (distinct, not null) and seq.
    """
    bound_batches(sequences.sparkSession)
    rows = stored(sequences.select("conv_id", "seq"))
    turns = rows.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
    sorted_rows = rows.repartitionByRange(max(1, -(-turns // shard_turns)), "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    parts = stored(sorted_rows.mapInArrow(_shard, NODE))
    inner, edge = parts.where("node IS NULL"), parts.where("node IS NOT NULL")
    merged = stored(_merged(edge))
    top = join_unique(inner.where("parent IS NOT NULL").drop("parent_conv_id"), stored(merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))), "parent")
    return inner.where("parent IS NULL").select(*COLUMNS).unionByName(top.select(*COLUMNS)).unionByName(merged.select(*COLUMNS))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """``sequences`` with the first turns, none to three by the checksum of the id, taken from the conversation whose id is the next lower multiple of 20."""
    own = stored(sequences)
    heads = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("seq", 1, 3).alias("head"))
    met = own.withColumn("base", F.expr("conv_id - conv_id % 20")).join(heads, "base", "left").withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int"))
    none = F.array().cast(SEQUENCE)
    kept = F.when(F.size("seq") > F.col("h"), F.slice("seq", F.col("h") + 1, F.size("seq"))).otherwise(none)
    return met.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), kept).alias("seq"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(rebuilt(turn_sequences(table(spark, sf_dir, "conversations")))).drop("turn")


ORACLE = rf"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h, list(id ORDER BY turn NULLS FIRST, role, id) AS ids FROM said GROUP BY conv_id),
built AS (SELECT o.conv_id, list_concat(CASE WHEN b.conv_id IS NULL THEN [] ELSE b.ids[1:o.h] END, o.ids[o.h + 1:]) AS seq FROM own AS o LEFT JOIN own AS b ON b.conv_id = o.conv_id - o.conv_id % 20),
members AS (SELECT conv_id, len(seq) AS size, seq, unnest(range(0, len(seq) + 1)) AS depth FROM built),
nodes AS (
  SELECT seq[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256 FROM members GROUP BY ALL),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
told AS (SELECT DISTINCT id, words FROM said),
counted AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf, (n.n_convs - 1) * coalesce(t.words, 0) AS own
  FROM nodes AS n LEFT JOIN kids AS k ON k.p = n.p LEFT JOIN told AS t ON t.id = n.p[n.depth]),
above AS (SELECT p, leaf, own, unnest(range(0, depth + 1)) AS d FROM counted),
sums AS (SELECT p[1:d] AS p, sum(leaf) AS n_leaves, sum(own) AS saved_tokens FROM above GROUP BY ALL)
SELECT c.conv_id, c.depth, q.conv_id AS parent_conv_id, c.n_convs, c.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted AS c JOIN sums AS s ON s.p = c.p LEFT JOIN nodes AS q ON c.depth > 0 AND q.p = c.p[1:c.depth - 1]
"""

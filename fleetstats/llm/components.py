"""Connected components, and linking of nodes that meet in lists without testing all pairs of a list."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, maybe_broadcast, stored

#: Lists longer than this are dealt to several hubs, so that no node is compared with more members of a list at once.
HUB_MEMBERS = 512
ROUNDS = 3
#: A node in no more lists than this carries their names in the last pass.
MOST_NAMED = 64


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows these pointers, and contracts the graph; the edges left
    shrink at least by half. Minima are combined before the shuffle.
    """
    graph = stored(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = graph.select(F.col("a").alias("node")).union(graph.select("b")).distinct().withColumn("component", F.col("node"))
    while not graph.isEmpty():
        both = graph.union(graph.select("b", "a"))
        parent = stored(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("u"), F.least("a", "p").alias("p")))
        for _ in range(2):
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            parent = stored(parent.join(up, "p").select("u", F.col("pp").alias("p")))
        roots = parent.withColumnRenamed("u", "component")
        nodes = stored(join_unique(nodes, roots, "component", "left").select("node", F.coalesce("p", "component").alias("component")))
        pa, pb = parent.select(F.col("u").alias("a"), F.col("p").alias("pa")), parent.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        graph = join_unique(join_unique(graph, pa, "a"), pb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        graph = stored(graph.where("a != b").distinct())
    return nodes


def link_lists(lists: DataFrame, verify: Callable[[DataFrame], DataFrame], bound: str = "true", pairs: DataFrame | None = None, carry: tuple[str, ...] = ()) -> tuple[DataFrame | None, DataFrame | None]:
    """Components of the nodes that share a list and that ``verify`` links. Exact, without all pairs of a list.

    ``lists``: stored rows (s, node, n, pos, m): list, node, the node's size, the place of the list in the node's order, the
    list's length. ``pairs``: rows (a, b, na, nb), a < b, of lists of two. ``verify`` takes distinct such pairs and returns those (a, b)
    that link. ``bound``: SQL over na, pa, nb, pb that no linking pair fails in the first list that it shares; ``carry``: further columns of
    ``lists`` that it may use, named in the same way.

    First the members of each list are compared with a hub, the member of the lowest place; those of long lists with one of the whole
    list and with one of their share of it. Members known to be connected need
    no further test; of each component in a list only one member is compared with a hub again. What then still stands
    apart within a list is compared pair by pair, in blocks of about HUB_MEMBERS times HUB_MEMBERS. Lists of one component are left
    out from then on. Returns (node, component) of linked nodes, and the links found.
    """
    links: list[DataFrame] = []
    tested: list[DataFrame] = []
    labels: DataFrame | None = None

    def apart(rows: DataFrame) -> DataFrame:
        """The lists that still hold several components."""
        if labels is None:
            return rows.withColumn("component", F.col("node"))
        rows = rows.select("s", "node", "n", "pos", "m", *carry).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = rows.groupBy("s").agg(F.min("component").alias("_x"), F.max("component").alias("_y")).where("_x != _y").select("s")
        return stored(join_unique(rows, stored(several), "s", "left_semi"))

    def pairs_of(left: DataFrame, right: DataFrame, keys: list[str], more: tuple[str, ...] = (), only: str = "true") -> DataFrame:
        def side(rows: DataFrame, node: str, name: str) -> DataFrame:
            own = {"n": "n", "pos": "p", "component": "c"} | {c: c for c in (*carry, *more)}
            return rows.select(*keys, F.col("node").alias(node), *(F.col(c).alias(short + name) for c, short in own.items()))

        met = side(left, "x", "a").join(side(right, "y", "b"), keys).where((F.col("ca") != F.col("cb")) & F.expr(bound) & F.expr(only))
        first = F.col("x") < F.col("y")
        return met.select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("nb")
        ).distinct()

    def test(new: DataFrame) -> bool:
        nonlocal labels
        if tested:
            new = new.join(reduce(DataFrame.unionAll, tested), ["a", "b"], "left_anti")
        new = stored(new)
        if new.isEmpty():
            return False
        tested.append(new.select("a", "b"))
        found = stored(verify(new))
        if found.isEmpty():
            return False
        links.append(found)
        labels = stored(connected_components(reduce(DataFrame.unionAll, links)))
        return True

    rows = lists
    for turn in range(ROUNDS):
        rows = apart(rows)
        members = rows
        if turn:
            one = rows.groupBy("s", "component").agg(F.min(F.struct("pos", "node", "n", *carry)).alias("r"))
            members = one.select("s", "component", "r.*")
            members = stored(members)
            members = join_unique(members, stored(members.groupBy("s").agg(F.count(F.lit(1)).alias("m"))), "s")
        dealt = members.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("m") / HUB_MEMBERS)))
        hubs = dealt.groupBy("s", "salt").agg(F.min(F.struct("pos", "node", "n", "component", *carry)).alias("h")).select("s", "salt", "h.*")
        new = pairs_of(dealt, stored(hubs), ["s", "salt"])
        long = members.where(F.col("m") > HUB_MEMBERS)
        widest = stored(long.groupBy("s").agg(F.min(F.struct("pos", "node", "n", "component", *carry)).alias("h")).select("s", "h.*"))
        new = new.unionByName(pairs_of(long, maybe_broadcast(widest), ["s"])).distinct()
        if turn == 0 and pairs is not None:
            new = new.unionByName(pairs.select("a", "b", "na", "nb")).distinct()
        if not test(new):
            break
    # Of several lists that two nodes share the first gives the pair, once: by place, as the bound holds there. Nodes in very many lists
    # meet in each of them, and their pairs are only made distinct.
    rows = apart(rows)
    named = F.transform(F.sort_array(F.collect_set(F.struct("pos", "s"))), lambda x: x["s"])
    every = rows.groupBy("node").agg(F.when(F.count(F.lit(1)) <= MOST_NAMED, named).alias("every"))
    parts = stored(rows.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / HUB_MEMBERS).cast("int").alias("parts")))
    rows = stored(join_unique(rows.join(every, "node"), parts, "s").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")))
    # Each two parts of a list meet in a block of their own, so that no task holds a whole long list.
    left = rows.withColumn("other", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)))
    right = rows.withColumnRenamed("part", "other").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("other"))))
    once = "(part < other OR x < y) AND coalesce(s = get(array_intersect(everya, everyb), 0), true)"
    test(pairs_of(left, right, ["s", "part", "other"], ("every",), once))
    return labels, reduce(DataFrame.unionAll, links) if links else None

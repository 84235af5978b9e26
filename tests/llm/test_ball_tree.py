"""Exact top-k search against brute force, and its edges."""

import heapq
import random

import numpy as np
import pytest

from fleetstats.llm import ball_tree
from fleetstats.llm.queries import QUERIES

VEC = "vec_id long, embedding array<float>, label int, own string, part int, floor string, dim string"
ASKED = "vec_id % 50 = 0"


def table(spark, rows, schema=VEC):
    return spark.createDataFrame([(i, v, 1, "o", 7, "f", "d") for i, v in rows], schema)


def whole(v):
    if v is None or any(x is None or not np.isfinite(x) or not np.isfinite(np.float64(x) * 256) for x in v):
        return None
    return tuple(int(np.floor(256 * np.float64(x))) for x in v)


def brute(rows, k=5):
    rows = {(i, w) for i, v in rows if (w := whole(v)) is not None}
    best = {}
    for q, a in rows:
        if q is not None and q % 50 == 0:
            for c, b in rows:
                if c != q and len(a) == len(b):
                    score = max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b))))
                    best.setdefault(q, []).append((-score, c is None, c or 0))
    return sorted((q, r + 1, None if none else c, -s) for q, own in best.items() for r, (s, none, c) in enumerate(heapq.nsmallest(k, own)))


def got(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    """Clusters, one vector in a third of the rows, ties, repeated rows, other dimensions and vectors that take no part."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 12))
    out = [(i, np.float32(centres[i % 5] + rng.normal(size=12) * (0.05 if i % 3 else 0.5)).tolist()) for i in range(600)]
    out += [(i, np.float32(centres[0]).tolist()) for i in range(1000, 1300)]
    out += [(i, [float(i % 3), 1.0]) for i in range(2000, 2160)] + [(i, []) for i in range(3000, 3053)]
    out += [(4000, [1.0, None] * 6), (4050, [float("nan")] * 12), (4100, None), (4101, [float("inf")] * 12), (None, np.float32(centres[0]).tolist()), (50, out[50][1]), (0, out[7][1]), (5000, [2.0] * 7)]
    random.Random(1).shuffle(out)
    return out


@pytest.mark.parametrize("shard", [8192, 40])
def test_against_brute_force(spark, rows, shard, monkeypatch):
    monkeypatch.setattr(ball_tree, "SHARD_ROWS", shard)
    monkeypatch.setattr(ball_tree, "QUERY_ROWS", 10 if shard == 40 else 1024)
    assert got(ball_tree.top_k(table(spark, rows), ASKED)) == brute(rows)
    assert got(ball_tree.top_k(table(spark, rows), ASKED, k=30)) == brute(rows, 30)


def test_large_numbers(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1e9, 3e7, -2e8]) * rng.random() for _ in range(3)]) for i in range(60)] + [(100, [1e20, 0.5, 1.0]), (101, [1e20, 0.0, 1.0]), (102, [1e307, 0.0, 0.0])]
    wide = VEC.replace("float", "double")
    assert got(ball_tree.top_k(table(spark, rows, wide), ASKED)) == brute(rows)


def test_registered(spark, duck, sf_dir):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    assert got(QUERIES["op12_exact_topk"](spark, sf_dir)) == brute(rows)


def test_nothing(spark):
    assert ball_tree.top_k(table(spark, []), ASKED).count() == 0
    assert ball_tree.top_k(table(spark, [(1, [1.0]), (50, None)]), ASKED).count() == 0
    assert ball_tree.top_k(table(spark, [(50, [1.0])]), ASKED).count() == 0


def test_bounds_hold_and_prune():
    """No node's bound is under a score in it, and clustered vectors leave most leaves unread."""
    rng = np.random.default_rng(8)
    x = np.floor(np.repeat(rng.normal(size=(40, 16)) * 400, 100, axis=0) + rng.normal(size=(4000, 16)) * 5)
    order, starts, ends, firsts, centres, radii = ball_tree.ball_tree(x)
    assert sorted(order) == list(range(4000)) and (ends - starts)[firsts == 0].max() <= ball_tree.LEAF
    q = x[:20]
    bounds = q @ centres.T + np.linalg.norm(q, axis=1)[:, None] * radii + 0.5
    for node, (lo, hi) in enumerate(zip(starts, ends)):
        assert (bounds[:, node] >= (q @ x[order[lo:hi]].T).max(1)).all()
    kth = np.sort(q @ x.T, axis=1)[:, -5]
    assert (bounds[:, firsts == 0] >= kth[:, None]).mean() < 0.2

"""Labels of values from many overlapping ranges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetstats.functions import intervals
from fleetstats.functions.bins import bin_range_join

RANGE = "pos int, label string, least double, most double"


def brute(x, ranges, open_end, default="none"):
    if x is None:
        return default
    hits = [(p, lab) for p, lab, a, z in ranges if a is not None and x >= a and (z is None or (x < z if open_end else x <= z))]
    return max(hits)[1] if hits else default


def random_ranges(n, seed=5):
    """Nested, touching, equal, empty, endless and wide ranges."""
    rng = random.Random(seed)
    out = []
    for p in range(n):
        a = rng.choice([rng.uniform(-50, 50), float(rng.randrange(-40, 40))])
        z = rng.choice([a, a + rng.random(), a + rng.randrange(4), a - 1, rng.uniform(a, 60), math.inf if rng.random() < 0.1 else a + 2])
        out.append((p, f"r{p % 37}", a, z))
    return [*out, (n, "endless", 55.0, None), (n + 1, "never", None, 3.0), (3, "tie", 0.0, 1.0), (3, "tied", 0.0, 1.0), (-1, "wide", -1e300, 1e300), (n + 5, "top", 30.0, 30.0)]


@pytest.mark.parametrize("open_end", [False, True])
@pytest.mark.parametrize("sent", [intervals.SENT_ROWS, 0])
@pytest.mark.parametrize("ends", [intervals.SLICE_ENDS, 25])
def test_against_brute_force(spark, open_end, sent, ends):
    ranges = random_ranges(400)
    rng = random.Random(6)
    values = [x for _, _, a, z in ranges for e in (a, z) if e is not None for x in (e, np.nextafter(e, math.inf), np.nextafter(e, -math.inf))]
    values += [rng.uniform(-60, 70) for _ in range(300)] + [None, math.inf, -math.inf, 1e301] + [7.25] * 50
    rows = [(i, None if x is None else float(x), "kept") for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, x double, slice string")
    got = intervals.interval_join(df, "x", spark.createDataFrame(ranges, RANGE), "none", open_end, slice_ends=ends, sent_rows=sent, task_values=100)
    assert got.columns == ["i", "x", "slice", "label"]
    assert {r["i"]: r["label"] for r in got.collect()} == {i: brute(x, ranges, open_end) for i, x, _ in rows}


def test_few_ranges_by_expression_and_many_by_search_agree(spark):
    ranges = random_ranges(99)[:99]
    df = spark.range(-500, 500).select((F.col("id") / 8).alias("x"))
    few, many = (bin_range_join(df, "x", spark.createDataFrame(r, RANGE), "none") for r in (ranges, [*ranges, *((1000 + i, "far", 1e6 + i, 1e6 + i) for i in range(200))]))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert many.where("label = 'far'").count() == 0


def test_nothing(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    for sent in (0, 10):
        assert {r["label"] for r in intervals.interval_join(df, "x", spark.createDataFrame([], RANGE), "none", sent_rows=sent).collect()} == {"none"}
    assert intervals.interval_join(df.where("false"), "x", spark.createDataFrame(random_ranges(9), RANGE), "none").count() == 0


def test_a_million_ranges(spark):
    """Exact at every bound: range i is [i, i + 2.5], so the last one that holds x begins at the floor of x."""
    n = 1_000_000
    ranges = spark.range(n).select(F.col("id").cast("int").alias("pos"), F.col("id").cast("string").alias("label"), F.col("id").cast("double").alias("least"), (F.col("id") + 2.5).alias("most"))
    at = [0.0, 0.5, 2.5, 2.500000001, 999_999.0, 1_000_001.5, 1_000_001.4999, 1_000_002.0, -0.1, 123_456.999, 765_432.0]
    df = spark.createDataFrame([(x,) for x in at], "x double").unionByName(spark.range(0, n, 997).select((F.col("id") + 0.25).alias("x")))
    got = {r["x"]: r["label"] for r in intervals.interval_join(df, "x", ranges, "none").collect()}
    want = {x: str(min(int(x), n - 1)) if 0 <= x <= n + 1.5 else "none" for x in got}
    assert got == want

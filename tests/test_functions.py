"""Hand vectors of the column builders."""

import pytest
from pyspark.sql import functions as F

from fleetstats.functions import ages, bins
from fleetstats.functions.ages import DAY_MS, WINDOWS
from fleetstats.functions.bins import Bins, bin_case, bin_of, bin_range_join, bins_table
from fleetstats.functions.compat import js_num, key_text, loose_eq, truthy
from fleetstats.functions.versions import drop_dirty, major, trim_master


def apply(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


def test_major_releases(spark):
    vectors = {"7.5-master-12-gab": "7.x", "7.x-master-3": "7.x", "master": "master.x", "Unknown": "Unknown", "6.3.2": "6.x", "-odd": "-odd.x", "6.x": "6.x", "": ".x", None: None}
    assert apply(spark, list(vectors), lambda v: major(trim_master(v))) == list(vectors.values())


def test_version_texts(spark):
    assert apply(spark, ["7.5-master-12-g", "-master-1", "x-master", "a-master-b-master-c"], trim_master) == ["7.5-master", "-master-1", "x-master", "a-master"]
    assert apply(spark, ["8.0-dirty-x-dirty", "5.5-dirty", "5.5", None], drop_dirty) == ["8.0-x-dirty", "5.5", "5.5", None]


def test_loose_numbers(spark):
    values = ["1", "1.0", "true", "0", "", "false", "x", None, " ", "NaN", "Infinity", "-inf", "1d", "1f", " 2 ", ".5", "1e3"]
    assert apply(spark, values, js_num) == [1, 1, 1, 0, 0, 0, None, None, 0, None, None, None, None, None, 2, 0.5, 1000]
    assert apply(spark, values, lambda v: loose_eq(v, 1)) == [True, True, True] + [False] * 14


def test_keys(spark):
    assert apply(spark, ["1", "1.0", "1000.0", "1e3", "1.5", "abc", "", "-2.0"], key_text) == ["1", "1", "1000", "1000", "1.5", "abc", "", "-2"]


def test_truthiness(spark):
    values = ["true", "false", "0", "1", '""', '"0"', '"false"', "null", "{}", "[]", "0.0", None]
    want = [True, False, False, True, False, True, True, False, True, True, False, None]
    assert apply(spark, values, lambda v: truthy(F.try_parse_json(v))) == want


@pytest.mark.parametrize("name", ["AGE_DAYS", "MEMORY", "STORAGE", "PEERS", "PIXELS", "UNIVERSES", "CHANNELS", "PANELS"])
def test_bin_forms_agree_at_edges(spark, name):
    table = getattr(bins, name)
    edges = sorted({e + d for _, a, b in table.rows for e in (a, b) if e not in (None, bins.INF) for d in (-1, -0.5, 0, 0.5, 1)})

    def plain(x):
        hit = [label for label, a, b in table.rows if a is not None and a <= x and (x < b if table.open_end else x <= b)]
        return hit[-1] if hit else table.default

    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(edges)], "i int, v double")
    got = bin_range_join(rows, "v", bins_table(spark, table), table.default, table.open_end).withColumn("c", bin_case(F.col("v"), table)).withColumn("d", bin_of("v", table)).orderBy("i").collect()
    assert all(r["c"] == r["d"] for r in got)
    assert [r["c"] for r in got] == [r["label"] for r in got] == [plain(x) for x in edges]


def test_bin_quirks(spark):
    assert apply(spark, [500, 249, 8388609, None], lambda v: bin_case(v, bins.CHANNELS), "long") == ["1k-10k", "1k-10k", "1M+", "Zero"]
    assert apply(spark, [249], lambda v: bin_case(v, bins.UNIVERSES), "long") == ["249-500"]
    assert apply(spark, [9_000_000, 50], lambda v: bin_case(v, bins.MEMORY), "long") == ["Unknown", "Unknown"]


def test_age_windows(spark):
    values = [7 * DAY_MS, 7 * DAY_MS - 1, -5, None, 365 * DAY_MS]
    rows = spark.createDataFrame([(v,) for v in values], "age long")
    direct = rows.agg(*ages.counters(F.col("age"))).first()
    assert [direct[w] for w in WINDOWS] == [5, 2, 3, 3, 3, 3, 3]
    counted = rows.withColumn("k", ages.age_class(F.col("age"))).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    twice = counted.agg(*ages.counters_of_classes(F.col("n"), F.col("k"))).first()
    assert list(twice) == [direct[w] for w in WINDOWS]


def test_labels_of_any_text(spark):
    odd = Bins((("it's \\ \"odd\"", 0, 1), ("%{x}", 2, bins.INF)), "'")
    got = spark.createDataFrame([(0.5,), (1.5,)], "v double").select(bin_of("v", odd)).collect()
    assert [r[0] for r in got] == ["it's \\ \"odd\"", "'"]

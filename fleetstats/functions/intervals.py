"""Labels of values from a table of ranges of any size; of overlapping ranges that with the largest pos wins.

Ranges are cut into elementary intervals, which don't overlap: ends of ranges cut the axis into slices of about equal numbers of
them. A range goes as it is to the slices where it begins and ends; of those that it covers whole only the largest pos of each slice counts, found
by blocks of slices in powers of two. Each slice is swept once in order. Values are then searched for: by binary search in each task if
the intervals are few enough to be sent to all, else by one sorted pass over values and intervals, slice by slice.

Ranges hold their least and their most (or not their most, with ``open_end``); a null most has no end; a range without a least, or that ends
before it begins, matches nothing. Equal ranges: the larger pos, then the larger label. Numbers are doubles; NaN is larger than any
number. A null value, or one in no range, gets the default.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Range ends in a slice, about.
SLICE_ENDS = 200_000
#: Intervals, and bytes of their labels, that are sent to all tasks at most.
SENT_ROWS, SENT_BYTES = 2_000_000, 64 << 20
#: Values of one slice that one task goes through, about.
TASK_VALUES = 2_000_000
_RANGE = "slice int, lo double, hi double, pos long, label string"
INTERVAL = "slice int, lo double, label string"


def _after(x: pd.Series) -> pd.Series:
    """The next double."""
    return pd.Series(np.nextafter(x.to_numpy(dtype=np.float64), math.inf))


def _clean(ranges: DataFrame, open_end: bool) -> DataFrame:
    """lo, hi, pos, label: ranges without their hi, each pair of ends once. NaN stands for no end."""
    most = F.col("most").cast("double")
    rows = ranges.select(F.col("least").cast("double").alias("lo"), most.alias("most"), (most if open_end else F.pandas_udf(_after, "double")(most)).alias("after"), F.col("pos").cast("long").alias("pos"), "label")
    endless = F.col("most").isNull() if open_end else F.col("most").isNull() | (F.col("most") == math.inf)
    kept = rows.where(F.col("lo").isNotNull()).select("lo", F.when(endless, F.lit(math.nan)).otherwise(F.col("after")).alias("hi"), "pos", "label").where("lo < hi")
    return kept.groupBy("lo", "hi").agg(F.max(F.struct("pos", "label")).alias("w")).select("lo", "hi", "w.pos", "w.label")


def _cuts(ranges: DataFrame, slice_ends: int) -> list[float]:
    """Where slices begin, but for the first: one number for each ``slice_ends`` ends of ranges."""
    ends = ranges.select(F.explode(F.array("lo", "hi")).alias("x")).where(~F.isnan("x") & (F.abs("x") != math.inf))
    slices = -(-ends.count() // slice_ends)
    if slices < 2:
        return []
    return sorted(set(ends.agg(F.percentile_approx("x", [i / slices for i in range(1, slices)], 10 * slices)).first()[0]))


def _deal(cuts: list[float]):
    """Rows of _RANGE: each range's parts in the slices of its ends, and the blocks of slices that it covers (slice -1 - level, block in lo)."""
    at = np.array(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, hi = (b[c].to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
            first, last = np.searchsorted(at, lo, "right"), np.searchsorted(at, hi, "left")
            on = np.flatnonzero(last > first)
            own_end = hi.copy()
            own_end[on] = at[first[on]]
            parts = [(np.arange(len(lo)), first, lo, own_end), (on, last[on], at[last[on] - 1], hi[on])]
            a, z, level = first[on] + 1, last[on], 0
            while len(on):
                for side, odd in ((a, a & 1 == 1), (z - 1, z & 1 == 1)):
                    took = odd & (a < z)
                    parts.append((on[took], np.full(took.sum(), -1 - level), side[took].astype(float), np.zeros(took.sum())))
                    a, z = (a + took, z) if side is a else (a, z - took)
                more = a < z
                on, a, z, level = on[more], a[more] >> 1, z[more] >> 1, level + 1
            row, part, start, end = (np.concatenate(c) for c in zip(*parts, strict=True))
            told = b.select(["pos", "label"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(start), pa.array(end), *told.columns], names=["slice", "lo", "hi", "pos", "label"])

    return run


def painted(lo: np.ndarray, hi: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, winners): where elementary intervals begin, and the row of the range that wins each, given the rows from the strongest to the weakest.

    Ranges are laid on in this order, each where nothing lies yet; what lies already is stepped over at once.
    """
    starts = np.unique(np.concatenate([lo, hi[~np.isnan(hi)]]))
    first, last = np.searchsorted(starts, lo).tolist(), np.searchsorted(starts, hi).tolist()
    free, winners = list(range(len(starts) + 1)), [-1] * len(starts)

    def next_free(i: int) -> int:
        while free[i] != i:
            free[i] = i = free[free[i]]
        return i

    for r in order.tolist():
        i = next_free(first[r])
        while i < last[r]:
            winners[i], free[i] = r, i + 1
            i = next_free(i + 1)
    return starts, np.array(winners)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _RANGE, slice by slice, become those of INTERVAL: where the winner changes."""

    def of(rows: pa.Table) -> pa.RecordBatch:
        lo, hi = (rows[c].to_numpy() for c in ("lo", "hi"))
        strength = rows.append_column("row", pa.array(np.arange(len(lo)))).sort_by([("pos", "descending"), ("label", "descending")])
        starts, winners = painted(lo, hi, strength["row"].to_numpy())
        kept = winners >= 0
        starts, winners = starts[kept], winners[kept]
        labels = rows["label"].combine_chunks().take(pa.array(winners))
        codes = labels.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(changes), rows["slice"][0].as_py()), pa.int32()), pa.array(starts[changes]), labels.take(pa.array(changes))], names=["slice", "lo", "label"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        slices = b["slice"].to_numpy()
        edges = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1], True]) if len(slices) else [0]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            if held and held[0]["slice"][0] != b["slice"][int(a)]:
                yield of(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(int(a), int(z - a)))
    if held:
        yield of(pa.Table.from_batches(held))


def elementary(ranges: DataFrame, open_end: bool = False, slice_ends: int = SLICE_ENDS) -> tuple[DataFrame, list[float]]:
    """(intervals, cuts): stored rows slice, lo, label, each holding from its lo to the next one's (label null: no range), and the slices' first values but for the first."""
    spark = ranges.sparkSession
    kept = stored(_clean(ranges, open_end))
    cuts = _cuts(kept, slice_ends)
    spine = F.broadcast(spark.createDataFrame(list(zip(range(len(cuts) + 1), [-math.inf, *cuts], [*cuts, math.nan], strict=True)), "slice int, lo double, hi double"))
    dealt = stored(kept.mapInArrow(_deal(cuts), _RANGE))
    blocks = dealt.where("slice < 0").groupBy("slice", "lo").agg(F.max(F.struct("pos", "label")).alias("w"))
    blocks = blocks.withColumn("size", F.expr("shiftleft(1, -1 - slice)")).withColumn("at", F.col("lo").cast("int") * F.col("size"))
    covered = blocks.select(F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("slice"), "w").groupBy("slice").agg(F.max("w").alias("w"))
    whole = spine.join(covered, "slice").select("slice", "lo", "hi", "w.pos", "w.label")
    none = spine.select("slice", "lo", "hi", F.lit(-(1 << 63)).alias("pos"), F.lit(None).cast("string").alias("label"))
    every = dealt.where("slice >= 0").unionByName(whole).unionByName(none)
    return stored(every.repartition("slice").sortWithinPartitions("slice").mapInArrow(_sweep, INTERVAL)), cuts


def _sent(spark: SparkSession, intervals: DataFrame):
    """A function that looks values up in all intervals, which go to every task."""
    rows = intervals.orderBy("lo").toArrow()
    starts, labels = spark.sparkContext.broadcast(rows["lo"].to_numpy()), spark.sparkContext.broadcast(rows["label"].combine_chunks().to_numpy(zero_copy_only=False))

    @F.pandas_udf("string")
    def label(x: pd.Series) -> pd.Series:
        at = np.searchsorted(starts.value, x.to_numpy(dtype=np.float64), "right") - 1
        return pd.Series(labels.value[np.maximum(at, 0)])

    return label


def _merged(df: DataFrame, value: str, intervals: DataFrame, cuts: list[float], out: str, task_values: int) -> DataFrame:
    """``df`` with the label by one sorted pass over values and intervals; a slice with many values is dealt to several tasks."""
    at = np.array(cuts)

    @F.pandas_udf("int")
    def slice_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, x.to_numpy(dtype=np.float64), "right"), dtype="int32")

    kept = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    rows = df.select(kept, F.col(value).cast("double").alias("x")).withColumn("slice", F.when(F.col("x").isNull(), -1).otherwise(slice_of(F.coalesce("x", F.lit(0.0)))))
    sizes = stored(rows.groupBy("slice").agg(F.ceil(F.count(F.lit(1)) / task_values).cast("int").alias("tasks")))  # a row a slice
    sizes = F.broadcast(sizes)
    rows = rows.join(sizes, "slice").withColumn("task", F.floor(F.rand(7) * F.col("tasks")).cast("int")).drop("tasks")
    marks = intervals.join(sizes, "slice").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    marks = marks.select(F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.col("lo").alias("x"), "slice", "task", F.struct("label").alias("mark"))
    both = rows.withColumn("mark", F.lit(None).cast("struct<label:string>")).unionByName(marks)
    order = Window.partitionBy("slice", "task").orderBy("x", F.col("mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("mark", F.last("mark", ignorenulls=True).over(order)).where("row IS NOT NULL")
    return found.select("row.*", F.col("mark.label").alias(out))


def interval_join(df: DataFrame, value: str, ranges: DataFrame, default: str, open_end: bool = False, out: str = "label", slice_ends: int = SLICE_ENDS, sent_rows: int = SENT_ROWS, task_values: int = TASK_VALUES) -> DataFrame:
    """``df`` with column ``out``, the label of ``value`` from ``ranges`` (pos, label, least, most)."""
    intervals, cuts = elementary(ranges, open_end, slice_ends)
    size = intervals.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("label")).alias("b")).first()
    if size["n"] <= sent_rows and (size["b"] or 0) <= SENT_BYTES:
        label = _sent(df.sparkSession, intervals)
        found = F.when(F.col(value).isNotNull(), label(F.coalesce(F.col(value).cast("double"), F.lit(0.0))))
        return df.withColumn(out, F.coalesce(found, F.lit(default)))
    return _merged(df.drop(out) if out != value else df, value, intervals, cuts, out, task_values).withColumn(out, F.coalesce(out, F.lit(default)))

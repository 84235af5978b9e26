"""The most frequent keys of each series where keys are without number (one a device, say), in fixed memory.

Every task keeps a fixed number of counters. When more keys come, all counters give up the same amount, which the task adds up by series: a key's count
is under-stated by no more than that. Keys with a counter left anywhere are candidates and are counted exactly in a second pass. The kth
candidate of a series is certain if it has more than what any other key may have; the few series where none can be certain, since their
keys are all rare, are counted in full. So the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Counters of a task.
COUNTERS = 10_000
#: Candidates that are sent to all tasks at most.
SENT = 200_000
_KEPT = "series string, key string, n long, lost long"


def _count(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = pd.Series([], dtype="int64", index=pd.MultiIndex.from_arrays([[], []]))
        lost: dict[str, int] = {}
        for b in batches:
            rows = b.to_pandas()
            kept = pd.concat([kept, rows.groupby(["series", "key"], sort=False).size()]).groupby(level=[0, 1], sort=False).sum()
            if len(kept) > counters:
                # All give up what the first key without a counter has; that is lost to those that stay, and bounds those that go.
                given = int(np.partition(kept.to_numpy(), len(kept) - counters - 1)[len(kept) - counters - 1])
                for series in kept.index.get_level_values(0).unique():
                    lost[series] = lost.get(series, 0) + given
                kept = kept[kept > given] - given
        series, keys = (kept.index.get_level_values(i).tolist() for i in (0, 1))
        n = kept.tolist() + [0] * len(lost)
        yield pa.RecordBatch.from_arrays([pa.array([*series, *lost], pa.string()), pa.array([*keys, *[None] * len(lost)], pa.string()), pa.array(n, pa.int64()), pa.array([0] * len(keys) + [*lost.values()], pa.int64())], names=["series", "key", "n", "lost"])

    return run


def top_keys(rows: DataFrame, k: int, counters: int = COUNTERS) -> DataFrame:
    """series, rank, key, n: the ``k`` most frequent keys of each series of ``rows`` (series, key), ties by key. Null series or keys aren't counted.

    Series are few, as each task holds a number for each.
    """
    rows = rows.select("series", "key").where("series IS NOT NULL AND key IS NOT NULL")
    kept = stored(rows.mapInArrow(_count(counters), _KEPT))
    bound = kept.groupBy("series").agg(F.sum("lost").alias("bound"))
    candidates = stored(kept.where("key IS NOT NULL").select("series", "key").distinct())
    asked = F.broadcast(candidates) if candidates.count() <= SENT else candidates
    order = Window.partitionBy("series").orderBy(F.desc("n"), "key")

    def ranked(counted: DataFrame) -> DataFrame:
        counts = counted.groupBy("series", "key").agg(F.count(F.lit(1)).alias("n"))
        return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = stored(ranked(rows.join(asked, ["series", "key"], "left_semi")))
    least = first.where(F.col("rank") == k).select("series", F.col("n").alias("least"))
    told = stored(bound.join(least, "series", "left").select("series", (F.coalesce("least", F.lit(0)) > F.col("bound")).alias("certain"), F.col("bound")))
    open_series = F.broadcast(told.where("NOT certain AND bound > 0").select("series"))
    rest = ranked(rows.join(open_series, "series", "left_semi"))
    sure = first.join(open_series, "series", "left_anti")
    return sure.unionByName(rest).select("series", "rank", "key", "n")

"""Labelled ranges. The last matching range of a table wins, so tables may overlap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .intervals import interval_join

#: A maximum without bound.
INF = float("inf")


@dataclass(frozen=True)
class Bins:
    """(label, least, most) rows; ``default`` if none matches; ``open_end``: most itself is outside."""

    rows: tuple[tuple[str, float | None, float | None], ...]
    default: str
    open_end: bool = False

    @property
    def labels(self) -> list[str]:
        return [r[0] for r in self.rows]


# Labels and bounds of the statistics, with their overlaps and gaps.
AGE_DAYS = Bins((
    ("< 24 hrs", 0, 1), ("1-5 days", 1, 5), ("5-14 days", 5, 14), ("14-30 days", 14, 30), ("30-90 days", 30, 90),
    ("90-180 days", 90, 180), ("180-365 days", 180, 365), ("> 1 year", 365, INF)), "> 1 year", open_end=True)
#: KiB. The last row has no least and never matches.
MEMORY = Bins((
    ("Unknown", -1, 1), ("512M", 100, 524288), ("1GB", 524289, 1048576), ("1.1-2GB", 1048577, 2097152),
    ("2.1-4GB", 2097153, 4194304), ("4.1-8GB", 4194305, 8388608), (">8GB", None, INF)), "Unknown")
#: MiB.
STORAGE = Bins((
    ("Unknown", -1, 1), ("4GB", 2, 4096), ("4.1-8GB", 4097, 8192), ("8.1-16GB", 8193, 16384), ("16.1-32GB", 16385, 32768),
    ("32.1-64GB", 32769, 65536), ("64.1-128GB", 65537, 131072), ("128.1-256GB", 131073, 262144), (">256GB", 262145, INF)), "Unknown")
PEERS = Bins((
    ("None", -1, 0), ("1", 1, 1), ("2-3", 2, 3), ("4-5", 4, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("21-50", 21, 50),
    ("51-100", 51, 100), ("101+", 101, INF)), "Unknown")
PIXELS = Bins((
    ("Zero", 0, 0), ("1-499", 1, 499), ("500-1k", 500, 999), ("1k-5k", 1000, 4999), ("5k-10k", 5000, 9999),
    ("10k-20k", 10000, 19999), ("20k+", 20000, INF)), "Zero")
UNIVERSES = Bins((("Zero", 0, 0), ("1-49", 1, 49), ("50-99", 50, 99), ("100-249", 100, 249), ("249-500", 249, 499), ("500+", 500, INF)), "Zero")
CHANNELS = Bins((
    ("Zero", 0, 0), ("1-999", 1, 999), ("1k-10k", 1, 9999), ("10k-100k", 10000, 99999), ("100k-500k", 100000, 499999),
    ("500k-1M", 500000, 999999), ("1M+", 1000000, INF)), "Zero")
PANELS = Bins((("Zero", 0, 0), ("1-4", 1, 4), ("5-8", 5, 8), ("9-16", 9, 16), ("17-32", 17, 32), ("33-64", 33, 64), ("65+", 65, INF)), "Zero")


def _within(value: Column, least: float, most: float, open_end: bool) -> Column:
    ok = value >= least
    if most != INF:
        ok = ok & (value < most if open_end else value <= most)
    return ok


def bin_case(value: Column, bins: Bins) -> Column:
    """The label of ``value`` as one CASE; the default for null."""
    out = None
    for label, least, most in reversed(bins.rows):
        if least is not None:
            hit = _within(value, least, most, bins.open_end)
            out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(bins.default) if out is None else out.otherwise(bins.default)


def quoted(text: str) -> str:
    """A text as SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bin_of(column: str, bins: Bins) -> Column:
    """``bin_case`` of a named column, made as one text: that takes one call into the JVM instead of one for each part."""
    tests = []
    for label, least, most in reversed(bins.rows):
        if least is not None:
            end = "" if most == INF else f" AND `{column}` {'<' if bins.open_end else '<='} {most}"
            tests.append(f"WHEN `{column}` >= {least}{end} THEN {quoted(label)}")
    return F.expr(f"CASE {' '.join(tests)} ELSE {quoted(bins.default)} END" if tests else quoted(bins.default))


def bins_table(spark: SparkSession, bins: Bins) -> DataFrame:
    """pos, label, least, most (null: open)."""
    rows = [(i, label, float(least), None if most == INF else float(most)) for i, (label, least, most) in enumerate(bins.rows) if least is not None]
    return spark.createDataFrame(rows, "pos int, label string, least double, most double")


#: Tables of up to so many ranges are one expression, tried range by range; larger ones are searched.
MOST_BINS = 100


def bin_range_join(df: DataFrame, value: str, table: DataFrame, default: str, open_end: bool = False, out: str = "label") -> DataFrame:
    """``df`` with the label of ``value`` from a table of ranges of any size (pos, label, least, most), the last that matches."""
    rows = table.orderBy("pos").limit(MOST_BINS + 1).collect()
    if len(rows) > MOST_BINS:
        return interval_join(df, value, table, default, open_end, out)
    ranges = F.array(*(F.struct(F.lit(r["label"]).alias("label"), F.lit(r["least"]).alias("least"), F.lit(r["most"]).cast("double").alias("most")) for r in rows))
    v = F.col(value)
    hits = F.filter(ranges, lambda b: (v >= b["least"]) & (b["most"].isNull() | (v < b["most"] if open_end else v <= b["most"])))
    return df.withColumn(out, F.coalesce(F.try_element_at(hits, F.lit(-1))["label"], F.lit(default)))

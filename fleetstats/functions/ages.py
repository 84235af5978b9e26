"""Trailing age windows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: Counters and the days that each looks back; the first counts everything.
WINDOWS: dict[str, int | None] = {"totalCount": None, "last7Days": 7, "last15Days": 15, "last30Days": 30, "last60Days": 60, "last180Days": 180, "last365Days": 365}
DEFAULT_WINDOW = "last365Days"


def to_ms(as_of: int | datetime) -> int:
    return as_of if isinstance(as_of, int) else int(as_of.timestamp() * 1000)


def age_ms(ts: Column, as_of: int | datetime) -> Column:
    """Null where the time is missing, negative where it is in the future."""
    return F.lit(to_ms(as_of)) - ts


def counters(age: Column) -> list[Column]:
    """One count for each window; a missing age counts in the total alone."""
    return [F.count(F.lit(1)).alias(n) if d is None else F.count_if(age < d * DAY_MS).alias(n) for n, d in WINDOWS.items()]


def age_class(age: Column) -> Column:
    """The number of the narrowest window that holds the age: counts by class give all windows by sums."""
    days = [d for d in WINDOWS.values() if d is not None]
    out = F.lit(len(days))
    for i, d in reversed(list(enumerate(days))):
        out = F.when(age < d * DAY_MS, i).otherwise(out)
    return out.cast("int")


def counters_of_classes(n: Column, age_class: Column) -> list[Column]:
    """The windows' counts from the counts ``n`` of age classes."""
    names = list(WINDOWS)
    return [F.sum(n).alias(names[0]), *(F.sum(F.when(age_class <= i, n).otherwise(0)).alias(w) for i, w in enumerate(names[1:]))]

"""Statistics as data: how one latest report becomes (series, key) rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stat:
    """``fixed``: (series, key), or (series, number, bins), one row each, none for a null key. ``each``: an array of strings, or of structs (series,
    key), one row per element. ``drop``: keys left out, by series. ``orders``: display order of labels, by series. ``max_age_days``: older
    reports aren't counted (those without a time are). ``weight``: bin expressions count more towards a family's size. ``of_age``: keys
    come from the report's age alone (column ``age_ms``), so they change without a new report."""

    name: str
    description: str
    fixed: Callable[[], list[tuple]] | None = None
    each: Callable[[], Column] | None = None
    drop: dict[str, tuple[str, ...]] = field(default_factory=dict)
    orders: dict[str, list[str]] = field(default_factory=dict)
    max_age_days: int | None = None
    weight: int = 1
    of_age: bool = False


@dataclass(frozen=True)
class HistoryStat:
    """A statistic of the whole history: ``build(history, current, as_of)`` gives rows population, pos, label, n, a few in all, for display in the
    order of pos. ``columns``: what it reads of the history, besides ``month`` if that has one."""

    name: str
    description: str
    build: Callable[[DataFrame, DataFrame, int], DataFrame]
    columns: tuple[str, ...] = ("uuid", "ts")


STATS: dict[str, Stat] = {}
HISTORY_STATS: dict[str, HistoryStat] = {}


def register(stat: Stat | HistoryStat) -> Stat | HistoryStat:
    (STATS if isinstance(stat, Stat) else HISTORY_STATS)[stat.name] = stat
    return stat


def row(stat: str, series: str | Column, key: Column) -> Column:
    return F.struct(F.lit(stat).alias("stat"), (F.lit(series) if isinstance(series, str) else series).alias("series"), key.cast("string").alias("key"))

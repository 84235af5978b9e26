"""The summary: every statistic of the latest reports, for all devices and for those without Docker.

Statistics form families small enough for their generated code to be compiled. A family is one explode and one
aggregation over the latest reports; counts by age class give all windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ages import DAY_MS, WINDOWS, age_class, age_ms, counters, counters_of_classes
from ..functions.bins import bin_of, quoted
from ..operators import history as _history  # noqa: F401  registers its statistics
from ..operators import stats as _stats  # noqa: F401  registers the statistics
from ..operators.registry import HISTORY_STATS, STATS, HistoryStat, Stat, row
from ..sources.landing import latest_report
from ..sources.shared import stored

#: Fixed expressions to a family, where a bin counts twice.
FAMILY_SIZE = 8


def is_docker() -> Column:
    return (F.coalesce("systemInfo.platform", F.lit("Unknown")) == "Docker") | (F.coalesce("systemInfo.platformVariant", F.lit("Unknown")) == "Docker")


def snapshot(history: DataFrame, as_of: int) -> DataFrame:
    """Latest report of each device with ``is_docker``, ``age_ms`` and ``age_class``."""
    return aged(latest_report(history), as_of)


def aged(current: DataFrame, as_of: int) -> DataFrame:
    out = current.withColumn("is_docker", is_docker()).withColumn("age_ms", age_ms(F.col("ts"), as_of))
    return out.withColumn("age_class", age_class(F.col("age_ms")))


def _young(stat: Stat) -> Column:
    return F.lit(True) if stat.max_age_days is None else F.col("age_ms").isNull() | (F.col("age_ms") <= stat.max_age_days * DAY_MS)


#: What each counted thing has of its report.
CARRIED = ("is_docker", "age_class")


def rows_of(current: DataFrame, family: list[Stat], carry: tuple[str, ...] = CARRIED, gated: bool = True) -> DataFrame:
    """stat, series, key and ``carry``: a row for each thing that a statistic of the family counts; if not ``gated``, at any age."""
    if family[0].each is not None:
        (stat,) = family
        element = F.col("e")
        rows = (current.where(_young(stat)) if gated else current).select(*carry, F.explode(stat.each()).alias("e"))
        nested = dict(rows.dtypes)["e"].startswith("struct")
        rows = rows.select(*carry, row(stat.name, element["series"] if nested else "", element["key"] if nested else element).alias("r"))
    else:
        # Numbers come first, so that the many branches of their bins read a column, not its expression.
        parts = [(s, *entry) for s in family for entry in s.fixed()]
        numbers = {f"_v{i}": p[2] for i, p in enumerate(parts) if len(p) == 4}
        keys, series, structs = {}, {}, []
        for i, p in enumerate(parts):
            key = bin_of(f"_v{i}", p[3]) if len(p) == 4 else p[2]
            keys[f"_k{i}"] = F.when(_young(p[0]), key) if gated and p[0].max_age_days else key
            if not isinstance(p[1], str):
                series[f"_s{i}"] = p[1]
            structs.append(row(p[0].name, p[1] if isinstance(p[1], str) else F.col(f"_s{i}"), F.col(f"_k{i}")))
        named = current.withColumns(numbers).select(*carry, *(c.alias(n) for n, c in {**keys, **series}.items()))
        rows = named.select(*carry, F.explode(F.array(*structs)).alias("r"))
    rows = rows.select("r.*", *carry).where("key IS NOT NULL")
    dropped = [f"(stat = {quoted(s.name)} AND series = {quoted(series)} AND key IN ({', '.join(map(quoted, keys))}))" for s in family for series, keys in s.drop.items()]
    return rows.where(f"NOT ({' OR '.join(dropped)})") if dropped else rows


def families(chosen: list[Stat], size: int = FAMILY_SIZE) -> list[list[Stat]]:
    out: list[list[Stat]] = []
    load = size + 1
    for s in sorted((s for s in chosen if s.fixed), key=lambda s: s.weight):
        weight = s.weight * len(s.fixed())
        if load + weight > size:
            out.append([])
            load = 0
        out[-1].append(s)
        load += weight
    return out + [[s] for s in chosen if s.each]


def counted(current: DataFrame, chosen: list[Stat], carry: tuple[str, ...] = CARRIED, n: Column | None = None, gated: bool = True) -> DataFrame:
    """stat, series, key, ``carry`` and n, the number of things, or the sum of column ``n``, which ``carry`` doesn't have."""
    parts = None
    for family in families(chosen):
        rows = rows_of(current if n is None else current.withColumn("_n", n), family, carry if n is None else (*carry, "_n"), gated)
        part = rows.groupBy("stat", "series", "key", *carry).agg((F.count(F.lit(1)) if n is None else F.sum("_n")).alias("n"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def windows(parts: DataFrame) -> DataFrame:
    """The summary of counts n by stat, series, key, is_docker and age_class."""
    names = list(WINDOWS)
    of_all = counters_of_classes(F.col("n"), F.col("age_class"))
    without = counters_of_classes(F.when(~F.col("is_docker"), F.col("n")).otherwise(0), F.col("age_class"))
    both = parts.groupBy("stat", "series", "key").agg(F.struct(F.lit("all").alias("population"), *[c.alias(w) for c, w in zip(of_all, names, strict=True)]).alias("a"), F.struct(F.lit("noDocker").alias("population"), *[c.alias(w) for c, w in zip(without, names, strict=True)]).alias("b"))
    out = both.select("stat", "series", "key", F.explode(F.array("a", "b")).alias("c")).select("c.population", "stat", "series", "key", *[f"c.{w}" for w in names])
    return out.where("totalCount > 0")


def summary(current: DataFrame, chosen: list[Stat] | None = None) -> DataFrame:
    """population, stat, series, key and the windows' counts. ``current``: from ``snapshot``, best stored, as each family reads it."""
    return windows(counted(current, list(STATS.values()) if chosen is None else chosen))


def history_summary(history: DataFrame, current: DataFrame, as_of: int, chosen: list[HistoryStat] | None = None) -> DataFrame:
    """population, stat, pos, label, n of every registered statistic of the history, for the populations that ``current`` (of ``snapshot``) decides.

    Several statistics share one scan: the columns that they read are stored once.
    """
    stats = list(HISTORY_STATS.values()) if chosen is None else chosen
    if not stats:
        return history.sparkSession.createDataFrame([], "population string, stat string, pos int, label string, n long")
    read = list(dict.fromkeys(c for s in stats for c in s.columns)) + (["month"] if "month" in history.columns else [])
    shared = history.select(*dict.fromkeys(read))
    shared = stored(shared) if len(stats) > 1 else shared
    parts = [s.build(shared, current, as_of).select("population", F.lit(s.name).alias("stat"), F.col("pos").cast("int").alias("pos"), F.col("label").cast("string").alias("label"), F.col("n").cast("long").alias("n")) for s in stats]
    return reduce(DataFrame.unionByName, parts)


def count_by_age(df: DataFrame, keys: list[str], time_ms: str, as_of: int) -> DataFrame:
    """The windows' counts of any table by keys."""
    return df.groupBy(*keys).agg(*counters(age_ms(F.col(time_ms), as_of)))


def population_of(docker: str | None) -> str:
    """The population that a flag asks for: without Docker only if it says "false", in any case."""
    return "noDocker" if (docker or "").lower() == "false" else "all"


def summary_population(rows: DataFrame, docker: str | None) -> DataFrame:
    """The rows of the summary of one population."""
    return rows.where(F.col("population") == population_of(docker))


def summary_for(current: DataFrame, docker: str | None, chosen: list[Stat] | None = None) -> DataFrame:
    """The summary of one population alone: the other one's reports are left out before anything is counted."""
    name = population_of(docker)
    kept = current.where("NOT is_docker") if name == "noDocker" else current
    return summary(kept, chosen).where("population = 'all'").withColumn("population", F.lit(name))

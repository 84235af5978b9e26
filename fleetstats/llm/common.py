"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop_at_exit, shared_dir, stored

__all__ = ["BROADCAST_ROWS", "ascii_lower", "bound_batches", "broadcast_small", "crc32_sql", "drop_at_exit", "is_small", "join_hot", "join_unique", "maybe_broadcast", "shared_dir", "stored", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A side is broadcast only if a count has shown that it has no more rows than this; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: A side with wide rows is broadcast only if it has been measured to have no more bytes than this.
BROADCAST_BYTES = 64 << 20


#: Texts go to Python in batches of about so many bytes.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes for the session, unless it sets a bound itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(key, None):
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def maybe_broadcast(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is known to have at most ``most`` rows (narrow ones); else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def is_small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the stored table ``df`` has at most ``most_bytes`` bytes, measured on its rows as JSON."""
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= most_bytes


def broadcast_small(df: DataFrame) -> DataFrame:
    """The stored table ``df``, of any width, with a broadcast hint if it is small; else as it is."""
    return F.broadcast(df) if is_small(df) else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8, for code points under 2048."""
    table = "list_transform(range(256), lambda k: list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k))"
    data = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END))"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, ({table})[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "left", weight: str = "n", salts: int = 64) -> DataFrame:
    """Join on ``key``, unique in ``right``, where one key may hold a large share of ``left``.

    ``right`` has a column ``weight``, the number of rows of ``left`` with the key. Keys with over a 500th of all rows
    (fewer than 500 keys, so they can be broadcast) are salted on the left and repeated on the right; ``weight`` is
    dropped.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = right.where(F.col(weight) > max(50, total // 500)).select(F.col(key).alias("_hot"))
    hot = F.broadcast(heavy)
    noise = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts))
    salted = left.join(hot, left[key] == hot["_hot"], "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), noise).otherwise(F.lit(0)).cast("int")
    ).drop("_hot")
    spread = right.withColumn(
        "_salt", F.explode(F.when(F.col(weight) > max(50, total // 500), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop(weight)
    return salted.join(spread, [key, "_salt"], how).drop("_salt")


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on ``key``, unique in the stored table ``right``: by broadcast up to BROADCAST_ROWS (narrow) rows, else with hot keys salted."""
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    weights = left.groupBy(key).agg(F.count(F.lit(1)).alias("_weight"))
    return join_hot(left, stored(right.join(weights, key)), key, how, "_weight")

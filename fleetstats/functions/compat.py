"""Coercions of loosely typed JSON scalars, whose leaves are read as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Decimal numbers, with white space around; not NaN, Infinity or a suffix such as d, which a cast takes too.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def js_num(c: Column) -> Column:
    """The number that a loosely typed comparison sees: true is 1, false and blank text are 0, other text its decimal value or null."""
    return F.when(c == "true", 1.0).when((c == "false") | (F.trim(c) == ""), 0.0).when(c.rlike(NUMBER), c.try_cast("double"))


def loose_eq(c: Column, n: int) -> Column:
    """``c == n`` between a loosely typed value and a number; false for null."""
    return F.coalesce(js_num(c) == n, F.lit(False))


def key_text(c: Column) -> Column:
    """Text of a value used as a key: whole numbers without a fraction or exponent, everything else as it is."""
    number = c.try_cast("double")
    numeric = c.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")
    whole = numeric & (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("decimal(38,0)").cast("string")).otherwise(c)


def truthy(v: Column) -> Column:
    """Of a VARIANT: false for false, 0, '' and null; true for everything else, such as '0' and 'false'. Null if absent."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(v.isNull(), F.lit(None).cast("boolean"))
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "VOID", False)
        .when(kind == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), True)
        .otherwise((number != 0) & ~F.isnan(number))
    )

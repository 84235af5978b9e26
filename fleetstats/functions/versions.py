"""Release version texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_master(v: Column) -> Column:
    """Keep up to the first ``-master`` that more text follows, unless it is at the start."""
    return F.regexp_replace(v, r"(?s)^(.+?-master)-.*$", "$1")


def drop_dirty(v: Column) -> Column:
    """Without the first ``-dirty``."""
    return F.regexp_replace(v, r"(?s)^(.*?)-dirty", "$1")


def major(v: Column) -> Column:
    """``7.5-x`` becomes ``7.x``: up to the first hyphen, the major number alone if a minor one follows, then ``.x`` once."""
    head = F.regexp_replace(v, r"(?s)^([^-]+)-.*$", "$1")
    head = F.regexp_replace(head, r"(?s)^([0-9]+)\.[0-9]+.*$", "$1")
    # ".x" goes to everything but "Unknown"; twice, it counts once.
    named = F.regexp_replace(head, r"(?s)^(?!Unknown$)(.*)$", "$1.x")
    return F.regexp_replace(named, r"(?s)^([0-9]+)\.x\.x.*$", "$1.x")

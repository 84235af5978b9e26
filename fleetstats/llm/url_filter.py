"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over ``host + path`` with literal tokens that any fitting URL must contain. A rule
is filed under the one of its tokens that the fewest URLs contain; the tokens of a URL fetch the rules filed under them
and only those run their expression. Built-in functions only.

Null URLs and URLs without ``://`` have an empty host and path; they fit no rule. Repeated rows are each judged. Columns
of the input other than the id and the URL are not carried.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

ARRAY_OF_RULES = "array<struct<length:int,name:string,action:string,pattern:string>>"

#: Rule lists up to this length are compiled into the projection; longer ones become a table that is joined by token.
INLINE_RULES = 500


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is searched in host + path; every URL it fits has all ``tokens``; the largest ``length`` wins."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    length: int


def host_rule(action: str, host: str, path: str = "/") -> UrlRule:
    """A rule for a host with all its subdomains and the paths that begin with ``path``."""
    bounded = re.sub(r"[A-Za-z0-9]+$", "", path)
    tokens = tuple(dict.fromkeys(t.lower() for t in re.findall(r"[A-Za-z0-9]+", host + bounded)))
    return UrlRule(host + path, action, rf"^(?:[^/]*\.)?\Q{host}{path}\E", tokens, len(host + path))


def word_rule(action: str, word: str) -> UrlRule:
    """A rule for hosts that have ``word`` between dots and hyphens."""
    return UrlRule(f"host:{word}", action, rf"^(?:[^/]*[.-])?\Q{word}\E(?:[.:-][^/]*)?(?:/|$)", (word,), 0)


#: What is judged if no host rule fits: hosts whose names have a label of these trades.
SPAM_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")
DEFAULT_PATTERNS = tuple(word_rule("block", w) for w in SPAM_WORDS)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path, both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def _struct(rule: UrlRule) -> Column:
    return F.struct(F.lit(rule.length).alias("length"), F.lit(rule.name).alias("name"), F.lit(rule.action).alias("action"), F.lit(rule.pattern).alias("pattern"))


def token_counts(urls: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many rows have each token of the rules; bounded by the rules' vocabulary."""
    if not vocabulary:
        return {}
    wanted = F.array_intersect(F.col("_tokens"), F.array(*map(F.lit, vocabulary)))
    rows = urls.select(F.explode(wanted).alias("t")).groupBy("t").count().collect()
    return {t: 0 for t in vocabulary} | {r["t"]: r["count"] for r in rows}


def filter_urls(pages: DataFrame, rules: list[UrlRule], patterns: list[UrlRule] = DEFAULT_PATTERNS, id_col: str = "page_id", url_col: str = "url", inline: int = INLINE_RULES) -> DataFrame:
    """``id_col``, host, path, rule (the longest that fits, by name among equals), verdict.

    Where no rule fits, any fitting pattern blocks and everything else is allowed.
    """
    host, path = url_parts(F.col(url_col))
    urls = pages.select(id_col, host.alias("host"), path.alias("path"))
    urls = urls.withColumn("_url", F.concat("host", "path"))
    urls = urls.withColumn("_tokens", F.array_distinct(F.split(F.lower("_url"), "[^a-z0-9]+")))
    every = [*rules, *patterns]
    counts = token_counts(urls, sorted({t for r in every for t in r.tokens}))
    filed: dict[str | None, list[UrlRule]] = {}
    for r in every:
        filed.setdefault(min(r.tokens, key=lambda t: (counts[t], t), default=None), []).append(r)
    always = F.array(*map(_struct, filed.pop(None, []))).cast(ARRAY_OF_RULES)
    if len(every) <= inline:
        index = F.create_map(*[x for t, rs in filed.items() for x in (F.lit(t), F.array(*map(_struct, rs)))]) if filed else F.create_map().cast(f"map<string,{ARRAY_OF_RULES}>")
        fetched = F.flatten(F.transform("_tokens", lambda t: F.coalesce(F.try_element_at(index, t), F.array().cast(ARRAY_OF_RULES))))
        fits = urls.withColumn("_fits", F.filter(F.concat(fetched, always), lambda r: F.regexp_like(F.col("_url"), r["pattern"])))
    else:
        spark = pages.sparkSession
        index = spark.createDataFrame([(t, r.length, r.name, r.action, r.pattern) for t, rs in filed.items() for r in rs], "t string, length int, name string, action string, pattern string")
        distinct = urls.select("_url", "_tokens").distinct()
        hits = distinct.select("_url", F.explode("_tokens").alias("t")).join(index, "t").where(F.regexp_like("_url", F.col("pattern")))
        hits = hits.groupBy("_url").agg(F.collect_set(F.struct("length", "name", "action", "pattern")).alias("_hits"))
        general = F.filter(always, lambda r: F.regexp_like(F.col("_url"), r["pattern"]))
        fits = urls.join(hits, "_url", "left").withColumn("_fits", F.concat(F.coalesce("_hits", F.array().cast(ARRAY_OF_RULES)), general))
    best = F.array_min(F.transform(F.filter("_fits", lambda r: r["length"] > 0), lambda r: F.struct((-r["length"]).alias("o"), r["name"].alias("name"), r["action"].alias("action"))))
    other = F.when(F.exists("_fits", lambda r: (r["length"] == 0) & (r["action"] == "block")), "block").otherwise("allow")
    return fits.withColumn("_best", best).select(id_col, "host", "path", F.col("_best.name").alias("rule"), F.coalesce("_best.action", other).alias("verdict"))


RULES = [host_rule("block", "net"), host_rule("allow", "example.net", "/en/"), host_rule("block", "example.com", "/de/"), host_rule("allow", "org", "/fr/")]


def op10_url_filter(spark, sf_dir):
    from .common import table

    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)


ORACLE = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '(^|[.-])({'|'.join(SPAM_WORDS)})([.:-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

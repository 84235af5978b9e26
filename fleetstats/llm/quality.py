"""Quality rules: a threshold table compiled into one projection, without user functions.

A rule compares one measure of a text with a share of another, in integers: ``100 * measure`` against
``percent * of``. A null or empty text has no words and fails the base rule. Repeated rows are each judged; only the id
and the text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java and RE2 class of what separates words.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of English, French, German and Spanish; also counted with a capital or in capitals.
STOP_WORDS = (
    "the be to of and that have with in is it this was for on as are by an "
    "le la les des et un une en que qui du dans pour par avec "
    "der die das und ist von zu den mit ein eine nicht auf "
    "el los las y es con para del se lo como"
).split()
STOP_FORMS = sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())})


@dataclass(frozen=True)
class Threshold:
    """Holds if ``least <= 100 * measure / of <= most``; a bound of None is open."""

    measure: str
    of: str
    least: int | None = None
    most: int | None = None

    def holds(self) -> Column:
        ok = F.lit(True)
        if self.least is not None:
            ok = ok & (F.col(self.measure) * 100 >= F.col(self.of) * self.least)
        if self.most is not None:
            ok = ok & (F.col(self.measure) * 100 <= F.col(self.of) * self.most)
        return ok

    def sql(self) -> str:
        parts = [f"100 * {self.measure} >= {self.least} * {self.of}"] * (self.least is not None) + [f"100 * {self.measure} <= {self.most} * {self.of}"] * (self.most is not None)
        return " AND ".join(parts)


#: Mean word length 2 to 12; at most a symbol in ten words; a stop word in 25 at least; at most half of the lines repeat an
#: earlier one; at most three exclamation marks in ten words.
THRESHOLDS = (
    Threshold("word_chars", "n_words", 200, 1200),
    Threshold("n_symbols", "n_words", None, 10),
    Threshold("n_stop_words", "n_words", 4, None),
    Threshold("n_dup_lines", "n_lines", None, 50),
    Threshold("n_exclaims", "n_words", None, 30),
)


def _count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


#: Starts of windows that occur twice or more, in order: sort (window, start) and keep those with an equal neighbour.
REPEATED = """
CASE WHEN size(array_distinct(grams)) = size(grams) THEN array() ELSE
transform(array(sort_array(transform(grams, (g, i) -> struct(g AS g, i AS i)))), s ->
  sort_array(transform(filter(s, (e, j) -> e.g <=> get(s, j - 1).g OR e.g <=> get(s, j + 1).g), e -> e.i)))[0] END
"""


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and all measures of each text, as BIGINT."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col), text.alias("_text"))
    out = out.withColumn("words", F.array_remove(F.split("_text", f"{SPACE}+"), "")).withColumn("lines", F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0))
    out = out.withColumn("n", F.size("words"))
    out = out.withColumn("grams", F.expr(f"CASE WHEN n >= {WINDOW} THEN transform(sequence(1, n - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))) ELSE array() END"))
    out = out.withColumn("starts", F.expr(REPEATED))
    repeats = F.expr(f"CASE WHEN size(starts) < 2 THEN 0 ELSE aggregate(sequence(1, size(starts) - 1), {WINDOW}, (a, j) -> a + least({WINDOW}, starts[j] - starts[j - 1])) END")
    return out.select(
        id_col,
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _count_chars(F.col("_text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _count_chars(F.col("_text"), "!").alias("n_exclaims"),
        F.size(F.filter("words", lambda w: w.isin(STOP_FORMS))).cast("long").alias("n_stop_words"),
    )


def judge(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, ``base_failed`` (under 20 words, or over 30 % of the words in repeated windows) and ``kept``."""
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    kept = ~F.col("base_failed")
    for t in thresholds:
        kept = kept & t.holds()
    return measures(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", kept)


def op4_quality(spark, sf_dir):
    from .common import table

    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"))


_STOPS = ", ".join(f"'{w}'" for w in STOP_FORMS)
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
    SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8))),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest(range(0, 8)) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaims,
    CAST(len(list_filter(ws, lambda x: x IN ({_STOPS}))) AS BIGINT) AS n_stop_words
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id)
SELECT *, NOT base_failed AND {' AND '.join(t.sql() for t in THRESHOLDS)} AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
"""

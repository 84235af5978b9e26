"""The corpus pipeline: language ID, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
``documents``, and no others that docs may have. Null, empty and letterless texts go in the first stage; rows that repeat an id and text
are one document to each stage and all stay or all go, except that packing places each. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstats.llm.common import maybe_broadcast, stored, table
from fleetstats.llm.decontamination import contamination
from fleetstats.llm.jaccard_join import similar_groups
from fleetstats.llm.langid import identify
from fleetstats.llm.packing import cut, pack
from fleetstats.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without those whose doc_id is in ``ids``."""
    gone = stored(ids.select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(maybe_broadcast(gone), F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, as no language can be told. A low cosine is no ground: that of a text of one word is low in any language.

    Without a labelled document nothing can be told of any; then, too, those with letters stay.
    """
    known = F.col("lang_pred") != "und"
    return identify(docs.select(*COLUMNS)).where(known | F.col("text").rlike(r"\p{L}")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by J >= 0.8 the smallest doc_id stays."""
    return _without(docs.select(*COLUMNS), similar_groups(docs).where("component_id != doc_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that occur earlier go, and documents of which nothing is left."""
    found = remove_repeats(docs, ("lang", "source", "n_chars"), as_text=True).where("n_removed < n_bytes OR n_bytes = 0")
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", size).withColumnRenamed("kept", "text").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return _without(docs.select(*COLUMNS), contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into sequences."""
    return pack(cut(docs))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: SQL can't express the tokenizer or the language profiles; tests hold each stage and the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the documents are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs

"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` are run one after another; each takes the documents its predecessor kept, writes nothing itself, and all but
the last return the columns of ``documents``. Labels come from the ``labels`` table beside the documents.

Defined cases are those of the operators; a document that is rejected is gone with all its columns, a document whose
lines were all removed stays with an empty text, and columns beyond those of ``documents`` are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greenledger.llm import packing, passages, quality, simhash, toxicity
from greenledger.llm.common import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half."""
    trees = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, trees, keep=tuple(docs.columns), name="_score")
    return scored.where("_score >= 0.5").select(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half.

    The verdicts are joined by id and text hash, so that the texts do not pass through the scoring.
    """
    digest = F.xxhash64("text").alias("_digest")
    scored = toxicity.score_toxicity(docs.select("doc_id", "text", digest), table(spark, sf_dir, "labels"),
                                     keep=("_digest",))
    rejected = scored.where("score >= 0.5").select("doc_id", "_digest").distinct()
    marked = docs.withColumn("_digest", digest)
    same = marked["doc_id"].eqNullSafe(rejected["doc_id"]) & (marked["_digest"] == rejected["_digest"])
    return marked.join(rejected, same, "left_anti").select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of passages; ``n_chars`` follows the text."""
    cleaned = passages.remove_passages(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(kind))
    return cleaned.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_first(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("line_dedup", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


# The trees, the nearest examples and the packing search cannot be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None

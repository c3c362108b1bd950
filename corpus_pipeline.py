"""Clean training corpus: filters, near-duplicates, decontamination and packing over ``documents``.

A doc_id stands for one document: where rows repeat an id, they stay together if one of them
stays, except that of equal rows the near-duplicate stage leaves one. A null doc_id is an id of its
own. Null texts have no language and go in the second stage. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingframe.llm import language, neardup
from filingframe.llm.common import written
from filingframe.llm.queries import as_articles, contamination, language_model, packed, quality_scores

LEAST_QUALITY = 0.7  # calibrated probability of a good label, as in op2_quality
LEAST_LANGUAGE = 0.5  # share of the best language


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose id is among ``url`` of ``kept``."""
    return docs.join(kept.select("url"), docs["doc_id"].eqNullSafe(kept["url"]), "left_semi")


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good."""
    return _only(docs, quality_scores(spark, docs, sf_dir).where(F.col("score") >= LEAST_QUALITY))


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters in a language that is clearly ahead of the others."""
    found = language.identify_language(as_articles(docs), language_model(docs))
    return _only(docs, found.where((F.col("language") != language.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    found = written(neardup.near_duplicates(as_articles(docs)), "components")
    kept = _only(docs, found.where(F.col("url").eqNullSafe(F.col("component"))))
    repeated = found.groupBy("url").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return _only(docs, contamination(spark, docs, sf_dir).where(~F.col("contaminated")))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token sequences of all remaining documents."""
    return packed(docs)


STAGES = [
    ("quality classifier", by_quality), ("language ID", by_language), ("SimHash near-dedup", without_copies), ("benchmark decontamination", without_benchmarks),
    ("best-fit packing", into_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result written to the shared scratch folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The stages one after another against what each must leave."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filingframe.llm import queries

from .test_copies import components, plain_contamination, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and output of every stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = docs.where("n_chars > 300").orderBy("doc_id").first()
    more = [
        (9001, long["text"], long["lang"], "planted", 0), (9002, long["text"], long["lang"], "planted", 0), (9003, None, "en", "planted", 0), (9004, "", "en", "planted", 0),
        (9005, "12 34 56", "en", "planted", 0), (9006, None, None, None, None),
    ]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, sf), "test")
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_order_and_columns(stages):
    assert [n for n, _, _ in stages] == ["quality classifier", "language ID", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert ids(after) <= ids(before)


def test_quality_and_language(spark, sf, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{sf}/labels.parquet").join(before, "doc_id").select("doc_id", "quality").collect()
    kept = ids(after)
    assert np.mean([(r["doc_id"] in kept) == r["quality"] for r in labels]) > 0.95
    _, before, after = stages[1]
    gone = before.where(~F.col("doc_id").isin(sorted(ids(after))))
    assert gone.where(F.col("text").rlike(r"\p{L}")).count() <= 2
    assert after.where(~F.coalesce("text", F.lit("")).rlike(r"\p{L}")).count() == 0


def test_copies(stages):
    _, before, after = stages[2]
    rows = sorted(before.select("doc_id", "text").collect())
    root = components(np.array([plain_fingerprint(r["text"]) for r in rows], np.uint64), 2)
    assert ids(after) == {rows[i]["doc_id"] for i in set(root)}


def test_benchmarks(spark, sf, stages):
    _, before, after = stages[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ids(after) == {r["doc_id"] for r in before.collect() if not plain_contamination(r["text"], items)[3]}


def test_packing(stages):
    _, before, after = stages[4]
    assert ids(after) == ids(before)
    full = after.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.where("n > 4096").count() == 0
    assert full.count() <= np.ceil(after.agg(F.sum("length")).first()[0] / 4096) + 1


def test_repeated_rows_leave_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(5)
    assert corpus_pipeline.without_copies(spark, docs.unionByName(docs), sf).count() == corpus_pipeline.without_copies(spark, docs, sf).count()


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_queries_are_all_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))

"""Stores: same rows as plain tables, and plans that leave the stored side where it is."""

import os
import re

import pytest
from pyspark.sql import functions as F

from filingframe.catalog import prices as CP
from filingframe.catalog import proxies as X
from filingframe.plans import statements as S
from filingframe.session import saved, scratch_path, scratch_scope
from filingframe.sources import readers as R
from filingframe.sources import sinks as SK
from filingframe.sources import store as SO


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    """The plan as made before the query runs."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|Single)", plan(df)))


def test_manifest_stays_where_it_is(spark, no_broadcast):
    """Twenty runs add to the manifest; the join shuffles the new entries once and nothing else."""
    manifest = SO.new_store(spark, scratch_path(spark, "manifest"), keys=["url"], buckets=4)
    for n in range(20):
        SK.append_manifest(spark.range(n * 7, n * 7 + 9).select(F.concat(F.lit("u"), "id").alias("url"), F.lit(1).alias("more")), manifest)
    new = spark.range(100, 200).select(F.concat(F.lit("u"), F.col("id") % 150).alias("url"))
    left = R.skip_already_fetched(new, SO.read(spark, manifest))
    assert {r.url for r in left.collect()} == {f"u{i}" for i in range(142, 150)}
    assert exchanges(left) == 1 and "Bucketed: true" in plan(left)


def test_statement_pivot_on_a_store(spark, sf):
    """Filings of two years: other years are not read, and windows and pivot of a filing need no shuffle."""
    lines = X.lines(spark, sf)
    store = SO.new_store(spark, scratch_path(spark, "lines"), keys=["issuer"], period=["fy"], buckets=4)
    SO.append(lines.where("fq < 3"), store)
    SO.append(lines.where("fq >= 3"), store)
    years = [r.fy for r in lines.select("fy").distinct().orderBy("fy").limit(2).collect()]
    of = lambda table: S.balance_sheets(S.scan_statement_lines(table.where(F.col("fy").isin(years))))
    got, want = of(SO.read(spark, store)), of(lines)
    rows = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    assert rows(got) == rows(want) != []
    assert exchanges(got) == 0 and re.search(r"PartitionFilters: \[fy#\d+L IN", plan(got))


def test_ranges_of_prices(spark, sf, no_broadcast):
    fixed = CP.s7_range(spark, sf)
    assert exchanges(fixed) == 0 and re.search(r"PartitionFilters: \[isnotnull\(week", plan(fixed))


def test_days_from_a_join_prune_the_store(spark, sf):
    assert "dynamicpruning" in plan(CP.s7_as_of(spark, sf))


def test_a_store_is_attached_in_another_session(spark):
    rows = spark.range(50).select((F.col("id") % 7).alias("issuer"), (F.col("id") % 3).alias("fy"), F.col("id").alias("v"))
    store = SO.new_store(spark, scratch_path(spark, "store"), keys=["issuer"], period=["fy"], buckets=3)
    SO.append(rows, store)
    spark.sql(f"DROP TABLE {store.table}")  # the files stay
    again = SO.attach(spark, store, rows.schema)
    assert sorted(tuple(r) for r in again.select("issuer", "fy", "v").collect()) == sorted(tuple(r) for r in rows.collect())
    assert exchanges(again.groupBy("issuer").agg(F.sum("v"))) == 0
    SO.append(rows.where("v = 3"), store)
    assert SO.read(spark, store).where("v = 3").count() == 2


def test_scratch_goes_when_the_result_is_written(spark, tmp_path):
    before = saved(spark.range(3), "kept")
    with scratch_scope(spark):
        inside = saved(spark.range(5), "gone")
        (folder,) = {f.rsplit("/gone", 1)[0] for f in inside.inputFiles()}
        inside.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5 and before.count() == 3
    assert not os.path.exists(folder.removeprefix("file://"))

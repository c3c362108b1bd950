"""Filings in inflated units whose amounts BIGINT does not hold."""

import datetime

import pytest
from pyspark.sql import functions as F

from filingframe import catalog
from filingframe.functions import numbers as N

BIG = 1_300_000_000_000  # won of the one order: a thousand million in cents, times 13


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """One order of issuer 4 in 1996, whose filings are stated a million times too large."""
    folder = str(tmp_path_factory.mktemp("big"))
    spark.createDataFrame([(1, 1, "F", "1-URGENT", 1e9, datetime.date(1996, 2, 1))], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double, o_orderdate date").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(1, 4, "MACHINERY")], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    return folder


def rows(spark, sf, name):
    return [r.asDict() for r in catalog.QUERIES[name](spark, sf).collect()]


def test_exact_amounts(spark):
    texts = ["12,345", "-", "", None, "1.9", "-7", "11,700,000,000,000,000,000", "-9223372036854775809", "1e20", "x", "9" * 39]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] if r[0] is None else int(r[0]) for r in df.select(N.parse_amount_exact("t")).collect()]
    assert got == [12345, None, None, None, 1, -7, 11_700_000_000_000_000_000, -(2**63) - 1, 10**20, None, None]
    short = df.where(F.length("t") < 10).select(N.parse_amount("t").alias("a"), N.parse_amount_exact("t").alias("b"))
    assert short.where("a IS NOT NULL AND a <> b").count() == 0 and short.where("a = b").count() == 3


def test_lines_state_the_whole_amount(spark, big):
    by_ord = {r["ord"]: r for r in rows(spark, big, "s6_scan_statement_lines")}
    assert len(by_ord) == 14 and by_ord[1]["amount"] == f"{9 * BIG * 10**6:,}"
    assert rows(spark, big, "p5_first_present_column")[0]["n"] == 14
    assert len(rows(spark, big, "j9_account_dictionary_join")) > 0


def test_units_are_undone_and_shown(spark, big):
    assert [r["scale"] for r in rows(spark, big, "a3_detect_unit_inflation")] == [1_000_000]
    (income,) = rows(spark, big, "a1_pivot_income")
    assert (income["revenue"], income["operating_income"], income["net_income"]) == (BIG, BIG, 3 * BIG)
    shown = {r["item"]: r["amount"] for r in rows(spark, big, "e6_balance_sheet_rows")}
    assert shown["자산총계"] == f"{9 * BIG // 100:,}" and shown["부채총계"] == f"{5 * BIG // 100:,}"
    (text,) = rows(spark, big, "e13_statement_text")
    assert f"당기 {9 * BIG // 100:,}억원" in text["bs_text"]
    assert [r["revenue_cell"] for r in rows(spark, big, "e7_quarterly_rows")] == [f"{BIG // 10**8:,} (-)"]


def test_whole_numbers_where_they_fit(spark, big):
    (sheet,) = rows(spark, big, "a1_pivot_balance_sheet")
    assert sheet["total_liabilities"] == 5 * BIG * 10**6 and sheet["total_assets"] is None
    (last,) = rows(spark, big, "a1_pivot_last_rule")
    assert last["total_liabilities"] == 5 * BIG * 10**6 and last["total_assets"] is None
    assert [r["borrowings_total"] for r in rows(spark, big, "a2_sum_matching")] == [3 * BIG * 10**6]
    assert len(rows(spark, big, "a5_interest_bearing_debt")) == 1
    assert [(r["n"], r["total"]) for r in rows(spark, big, "p4_prefer_currency")] == [(14, None)]
    catalog.QUERIES["w6_latest_balance_sheet"](spark, big).collect()

"""Known figures of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from filingframe.functions import dates as D
from filingframe.functions import maps as K
from filingframe.functions import metrics as M
from filingframe.functions import numbers as N
from filingframe.operators import predicates as P


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_korean_numbers(spark):
    rows = [("1,932,000,000원",), ("5,370",), ("-",), ("",), (None,), ("12.7",), ("-12.7",), ("abc",), ("1 234주",)]
    got = [r[0] for r in values(spark, rows, "t string", N.parse_korean_int("t"))]
    assert got == [1932000000, 5370, None, None, None, 12, -12, None, 1234]


def test_number_words(spark):
    rows = [("금 삼백억원",), ("오백억원",), ("이십억원",), ("일천오백억원",), ("25,000,000천원",)]
    assert [r[0] for r in values(spark, rows, "t string", N.parse_korean_words("t"))] == [30_000_000_000, 50_000_000_000, 2_000_000_000, 150_000_000_000, None]


@pytest.mark.parametrize("cur,prev,label", [
    (376, 100, "+276%"), (84, 100, "-16%"), (10, -5, "흑자전환"), (-10, 5, "적자전환"), (-5, -10, "적자축소"), (-10, -5, "적자확대"), (-5, -5, "적자지속"),
    (None, 5, "-"), (5, None, "-"), (5, 0, "흑자전환"), (-5, 0, "적자전환"), (0, 0, "-"), (0, -5, "+100%"), (997, 1000, "-0%"), (205, 200, "+2%"), (203, 200, "+2%"),
])
def test_yoy_labels(spark, cur, prev, label):
    assert values(spark, [(cur, prev)], "a bigint, b bigint", M.yoy_label("a", "b"))[0][0] == label


def test_statement_form_has_no_label_without_base(spark):
    assert values(spark, [(5, 0), (None, 1)], "a bigint, b bigint", M.yoy_label("a", "b", display=False)) == [(None,), (None,)]


def test_half_even_display(spark):
    rows = [(250_000_000,), (350_000_000,), (-250_000_000,), (424_500_000_000,)]
    assert [r[0] for r in values(spark, rows, "v bigint", N.to_eok("v"))] == [2, 4, -2, 4245]


def test_reference_dates(spark):
    rows = [("2025년 3분기 분기보고서",), ("2025년 반기보고서",), ("[기재정정]분기보고서 (2025.09)",), ("사업보고서 (2024.12)",), ("기타",)]
    assert [str(r[0]) for r in values(spark, rows, "t string", D.reference_date("t"))] == ["2025-09-30", "2025-06-30", "2025-09-30", "2024-12-31", "None"]


@pytest.mark.parametrize("start,end,month,want", [
    ("2025-01-01", "2025-12-31", 12, (2025, 0, False)), ("2026-01-01", "2026-03-31", 12, (2026, 1, False)), ("2026-01-01", "2026-06-30", 12, (2026, 2, True)),
    ("2026-01-01", "2026-09-30", 12, (2026, 3, True)), ("2026-01-01", "", 12, (0, 0, False)), ("2025-07-01", "2025-12-31", 6, (2025, 2, True)),
])
def test_periods(spark, start, end, month, want):
    p = D.detect_period("a", "b", F.lit(month))
    assert tuple(values(spark, [(start, end)], "a string, b string", p["fy"], p["fq"], p["cumulative"])[0]) == want


@pytest.mark.parametrize("title,kind", [
    ("전환가액의조정(제2회차)", "convert_price_change"), ("신주인수권행사가액의조정", "convert_price_change"), ("전환청구권ㆍ신주인수권ㆍ교환청구권행사", "convert"),
    ("단일판매ㆍ공급계약체결", "contract"), ("매출액또는손익구조30%(대규모법인은15%)이상변동", "performance"), ("주요사항보고서(전환사채권발행결정)", "issue"),
    ("유상증자 결정", "rights_issue"), ("전환 청구권 행사", "convert"), ("임원변동", "unknown"),
])
def test_titles(spark, title, kind):
    assert values(spark, [(title,)], "t string", P.classify_first_match("t"))[0][0] == kind


def test_loose_json(spark):
    schema = "struct<category:string,series:string>"
    rows = [('```json\n[{"category":"CB","series":1}]\n```',), ('{"instruments":[{"category":"BW"}]}',), ("text [ {\"category\":\"SO\"} ] tail",), ("null",), ("broken [",), ('{"a":1}',)]
    got = [r[0] for r in values(spark, rows, "t string", K.parse_json_items("t", schema))]
    assert [g and g[0]["category"] for g in got] == ["CB", "BW", "SO", None, None, None]


def test_exact_floor(spark):
    rows = [(-7, 2), (7, 2), (-9007199254740993, 2), (5, 0)]
    assert [r[0] for r in values(spark, rows, "a bigint, b bigint", N.floor_div(F.col("a"), F.col("b")))] == [-4, 3, -4503599627370497, None]


def test_display_divisor_and_negative_zero(spark):
    assert values(spark, [(2_500_000, "USD")], "v bigint, currency string", N.to_display_unit("v"), N.display_unit_label()) == [(2, "백만 USD")]

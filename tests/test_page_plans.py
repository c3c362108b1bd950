"""Page jobs read every page once and on all tasks."""

import pytest
from pyspark.sql import functions as F

from filingframe import catalog
from filingframe.documents import cells, notes
from filingframe.functions import text as TX


@pytest.mark.parametrize("name", ["h13_performance_records", "h10_price_adjustments"])
def test_pages_are_parsed_once(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"<table\b") == 1


def test_records_are_dealt_before_pages_are_parsed(spark, sf):
    plan = catalog.QUERIES["k2_kv_first"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    dealt = next(n for n, line in enumerate(lines) if "RepartitionByExpression" in line)
    assert next(n for n, line in enumerate(lines) if r"<table\b" in line) < dealt  # inputs stand below


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_mixed_notices_are_parsed_once(spark, sf):
    assert _optimized(catalog.QUERIES["h_dispatch_notices"](spark, sf)).count(r"<table\b") == 1


def test_state_adjustments_keep_pages_without_any(spark):
    from filingframe.documents import exchange as E

    price, share = "array<struct<series:bigint,price_before:bigint,price_after:bigint>>", "array<struct<series:bigint,shares_before:bigint,current_shares:bigint,shares_after:bigint,unconverted:bigint>>"
    records = spark.createDataFrame([(1, [(1, 10, 9)], None), (2, None, None), (3, [], [])], f"ord int, adjustments {price}, share_changes {share}")
    found = lambda **kw: sorted((r["ord"], r["part"], r["price_after"]) for r in E.state_adjustments(records, keys=["ord"], **kw).collect())
    assert found() == [(1, 0, 9)]
    assert sorted(found(outer=True), key=str) == [(1, 0, 9), (2, None, None), (3, None, None)]


def test_cells_are_read_without_chained_conditions(spark):
    """A chain of conditions in a lambda is looked through as a list for every cell."""
    pages = spark.createDataFrame([("<table><tr><td>a</td></tr></table>",)], "html string")
    assert "CASE WHEN" not in _optimized(pages.select(cells.html_tables("html").alias("t")))


def test_note_headings_are_looked_for_once_per_paragraph(spark, sf):
    plan = _optimized(catalog.QUERIES["h17_notes_instruments"](spark, sf))
    assert plan.count(notes.SECTION_HEADINGS["CB"]) == 1
    assert plan.count(notes.SECTION_HEADINGS["BW"]) == 1


@pytest.mark.parametrize("end", ["", "\n", "\r\n", "\r", "\x85", "\u2028", "\n\n", "</tr>", "</td></tr>\n", "<b", "<"])
@pytest.mark.parametrize("body", ["a", "a<b>b</b", "x\ny", "<td>1<TD rowspan=2>2<th>3", "&nbsp;a  b", "<!-- c --><i>t</i>", "<tr ><td >z"])
def test_markup_is_cut_where_a_lazy_pattern_cuts_it(spark, body, end):
    """Unclosed rows and cells too, whatever line end stands last."""
    lazy_row, lazy_cell = r"(?is)<tr\b[^>]*>(.*?)(?:</tr\s*>|(?=<tr\b)|$)", r"(?is)<(t[dh]\b[^>]*>.*?)(?:</t[dh]\s*>|(?=<t[dh]\b)|$)"
    lazy_any = r"(?is)<t[dh]\b([^>]*>.*?)(?:</t[dh]\s*>|(?=<t[dh]\b)|(?=</tr)|$)"
    page = f"<TR a='1'><td>q</td >{body}</TR\n><tr><td>{body}<tr><Th>{body}{end}"
    found = spark.createDataFrame([(page,)], "t string").select(
        *(F.regexp_extract_all("t", F.lit(p), F.lit(1)) for p in (lazy_row, cells._ROW, lazy_cell, cells._CELL, lazy_any, notes._ANY)),
        TX.cell_text(F.col("t")), TX.clean_text(TX.strip_tags("t")),
    ).first()
    assert found[0] == found[1] and found[2] == found[3] and found[4] == found[5] and found[6] == found[7]


@pytest.mark.parametrize("name", ["h9_exercise_balances", "h7_statement_tables", "h10_price_adjustments", "h9_exercise_claims", "h16_forecast_records"])
def test_spans_are_read_only_where_they_are_asked_for(spark, sf, name):
    assert "rowspan" not in _optimized(catalog.QUERIES[name](spark, sf))


@pytest.mark.parametrize("end", ["", "\n", "</tr>", "</td></tr>\n", "<b", "<"])
@pytest.mark.parametrize("body", ["a", "", " a ", "a|b", "a<b>b</b", "x\ny", "a\xa0 b", "<td>1<TD rowspan=2>2<th>3", "&nbsp;a  b", "<!-- c --><i>t</i>", "<tr ><td >z"])
def test_texts_of_cells_are_those_of_the_full_cells(spark, body, end):
    page = f"<TABLE a='1'><tr></tr><TR a='1'><td>q</td >{body}</TR\n><tr><td>{body}<tr><Th> {body}</th><td>&amp; <td/>p{end}</table>"
    found = spark.createDataFrame([(page,), (None,)], "html string").select(cells.html_tables("html").alias("c"), cells.html_texts("html").alias("t")).collect()
    assert found[1]["t"] is None
    assert [[[c["text"] for c in r] for r in t] for t in found[0]["c"]] == found[0]["t"]

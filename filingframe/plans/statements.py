"""Statement plans: from long lines to reconciled, labelled, displayable periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import dates as D
from ..functions import metrics as M
from ..functions import numbers as N
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ordering as O
from ..operators import predicates as P
from ..operators import windows as W
from ..operators import years as Y

MEASURES = ("revenue", "operating_income", "net_income")
FILING = ("issuer", "fy", "report_code")


def prefer_basis(lines: DataFrame, *, keys: Sequence[str] = FILING, basis: str = "fs_div", first: str = "CFS", second: str = "OFS") -> DataFrame:
    """Consolidated rows of a filing, separate ones only where no consolidated row exists.

    One filing is one bounded window; its partitioning serves all later steps on the same keys.
    """
    has_first = F.max(F.col(basis) == first).over(Window.partitionBy(*keys))
    return (
        lines.where(F.col(basis).isin(first, second))
        .withColumn("_has", has_first)
        .where(F.col(basis) == F.when(F.col("_has"), first).otherwise(second))
        .drop("_has")
    )


def scan_statement_lines(lines: DataFrame, *, keys: Sequence[str] = FILING, basis: str = "fs_div", currency: str = "currency") -> DataFrame:
    """Statement lines of the preferred basis and currency, with the basis that gave data."""
    chosen = P.prefer_currency(prefer_basis(lines, keys=keys, basis=basis), keys=keys, currency=currency)
    label = F.when(F.col(basis) == "CFS", F.lit("연결")).otherwise(F.lit("별도"))
    return chosen.withColumn("basis", label)


def income_records(lines: DataFrame, *, keys: Sequence[str] = FILING, amount: str = "amount", extra: Sequence[Column] = ()) -> DataFrame:
    """Income record per filing: comprehensive statement first, inflated units undone."""
    value = N.amount_of(lines, amount)
    return A.pivot_accounts(
        lines, keys=keys, rules=lx.INCOME_LABELS, statements=["CIS", "IS"], amount=amount,
        scale=A.inflation_scale(value, F.col("sj_div")), extra=extra,
    )


def balance_sheets(lines: DataFrame, *, keys: Sequence[str] = FILING, amount: str = "amount") -> DataFrame:
    """Wide balance sheet per filing, with the bare borrowings total, currency and basis."""
    value = N.amount_of(lines, amount)
    borrowings = A.sum_of_label(
        lx.BORROWINGS_LABELS, value, "account_nm", where=F.col("sj_div") == "BS"
    ).alias("borrowings_total")
    return A.pivot_accounts(
        lines, keys=keys, rules=lx.BALANCE_LABELS, statements=["BS"], amount=amount,
        extra=[borrowings, F.max("currency").alias("currency"), F.max("basis").alias("statement_type")],
    )


# -- display -------------------------------------------------------------------------------------


def annual_rows(annual: DataFrame, *, issuer: str = "issuer", fy: str = "fy", measures: Sequence[str] = MEASURES, currency: str = "currency") -> DataFrame:
    """Annual cells with labels against the next-older row."""
    w = Window.partitionBy(issuer).orderBy(fy)
    return annual.select(
        issuer,
        fy,
        *(
            N.format_income_cell(m, M.yoy_label(F.col(m), F.lag(m).over(w)), currency).alias(f"{m}_cell")
            for m in measures
        ),
    )


def quarterly_rows(labelled: DataFrame, *, issuer: str = "issuer", fy: str = "fy", fq: str = "fq", measures: Sequence[str] = MEASURES, currency: str = "currency") -> DataFrame:
    """Quarter cells from records that already carry their labels."""
    return labelled.select(
        issuer,
        D.period_label(F.col(fy), F.col(fq)).alias("period"),
        *(
            N.format_income_cell(m, F.coalesce(F.col(f"{m}_yoy"), F.lit("-")), currency).alias(f"{m}_cell")
            for m in measures
        ),
    )


def balance_sheet_rows(sheets: DataFrame, *, keys: Sequence[str], prior_keys: Sequence[str], fy: str = "fy") -> DataFrame:
    """Five display rows per sheet: assets, cash, liabilities, debt, equity."""
    wide = sheets.select(
        *keys,
        "currency",
        "total_assets",
        N.sum_skip_null("cash_and_equivalents", "short_term_investments", kind=N.EXACT).alias("cash"),
        "total_liabilities",
        A.interest_bearing_debt().alias("debt"),
        "total_equity",
    )
    items = [
        ("자산총계", "total_assets"), ("현금성자산", "cash"), ("부채총계", "total_liabilities"),
        ("이자부부채", "debt"), ("자본총계", "total_equity"),
    ]
    both = J.prior_period_join(wide, keys=prior_keys, fy=fy, measures=[c for _, c in items])

    def row(n: int, item: str, c: str) -> Column:
        cur, prev = F.col(c), F.col(f"prev_{c}")
        return F.struct(
            F.lit(n).cast("bigint").alias("row_no"),
            F.lit(item).alias("item"),
            N.format_thousands(N.to_display_unit(cur)).alias("amount"),
            N.format_thousands(N.to_display_unit(prev)).alias("previous_amount"),
            M.pct_change_note(cur, prev).alias("note"),
        )

    rows = F.array(*(row(n, item, c) for n, (item, c) in enumerate(items, 1)))
    return both.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def with_prior_amount(lines: DataFrame, *, keys: Sequence[str], fy: str = "fy", amount: str = "amount", out: str = "prior_amount") -> DataFrame:
    """Amount text of the same line one filing earlier."""
    return lines.withColumn(out, F.lag(amount).over(Window.partitionBy(*keys).orderBy(fy)))


def statement_text(lines: DataFrame, *, keys: Sequence[str], account: str = "account_nm", amount: str = "amount", prior: str = "prior_amount", order: str = "ord") -> DataFrame:
    """``name: 당기 x억원, 전기 y억원`` lines; comprehensive statement else the plain one.

    A filing has a bounded number of lines, so listing them is bounded too.
    """

    def shown(c: str) -> Column:
        v = N.parse_amount_exact(c)
        return F.coalesce(F.concat(F.format_number(N.to_eok(v), 0), F.lit("억원")), F.trim(c))

    has_prior = (F.coalesce(F.trim(prior), F.lit("")) != "") & (F.col(prior) != F.col(amount))
    line = F.concat(
        F.trim(account), F.lit(": 당기 "), shown(amount),
        F.when(has_prior, F.concat(F.lit(", 전기 "), shown(prior))).otherwise(""),
    )
    usable = (F.trim(account) != "") & (F.trim(amount) != "")

    def section(name: str) -> Column:
        part = F.when(usable & (F.col("sj_div") == name), F.struct(F.col(order).alias("o"), line.alias("t")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "\n")

    texts = lines.groupBy(*keys).agg(*(section(s).alias(f"_{s}") for s in ("BS", "CIS", "IS")))
    return texts.select(
        *keys,
        F.col("_BS").alias("bs_text"),
        F.when(F.col("_CIS") != "", F.col("_CIS")).otherwise(F.col("_IS")).alias("is_text"),
    )


def backlog_series(segments: DataFrame, *, issuer: str = "issuer", period: str = "period", segment: str = "segment", amount: str = "amount", order: str = "ord", n: int | None = None) -> DataFrame:
    """Order backlog per period: unified names, total, breakdown, exact year-over-year; the newest ``n`` if given."""
    named = J.canonical_names(
        segments, keys=[issuer], groups=[period], name=segment, order=order, amounts=[amount]
    )
    totals = A.segment_totals(named, keys=[issuer, period], segment=segment, amount=amount, order=order)
    p = D.parse_period(period)
    dated = totals.select("*", p["fy"].alias("_fy"), p["fq"].alias("_fq"))
    both = J.prior_period_join(dated, keys=[issuer, "_fq"], fy="_fy", measures=["total"])
    top = both if n is None else O.top_n_per_key(both, n, keys=[issuer], order=[F.desc("_fy"), F.desc("_fq")])
    return top.select(
        issuer, period, "total", "breakdown", M.plain_yoy(F.col("total"), F.col("prev_total")).alias("yoy")
    )


# -- reconciliation ------------------------------------------------------------------------------


def performance_statements(notices: DataFrame, *, measures: Sequence[str] = MEASURES, settlement_month: Column | None = None) -> DataFrame:
    """Earnings-change notices as periods in won: one row per (issuer, fy, fq, cumulative).

    Of several notices for a period the first non-empty one counts.
    """
    month = F.lit(12) if settlement_month is None else settlement_month
    factor = N.unit_multiplier("unit", default="원")
    p = D.detect_period("period_start", "period_end", month)
    rows = notices.select(
        "issuer",
        "ord",
        p["fy"].cast("bigint").alias("fy"),
        p["fq"].cast("bigint").alias("fq"),
        p["cumulative"].alias("cumulative"),
        *((F.col(m) * factor).alias(m) for m in measures),
    ).where((F.col("fy") > 0) & ~P.is_empty_statement(measures))
    first = rows.groupBy("issuer", "fy", "fq", "cumulative").agg(
        F.min_by(F.struct(*measures), "ord").alias("_m")
    )
    return first.select("issuer", "fy", "fq", "cumulative", "_m.*")


def preliminary_statements(results: DataFrame, *, measures: Sequence[str] = MEASURES, label: str = "label") -> DataFrame:
    """Preliminary results in won, keyed by the quarter of their label (first non-empty wins)."""
    p = D.parse_period(label)
    factor = N.unit_multiplier("unit", default="백만원")
    rows = results.where(F.col(label).rlike(r"^\d{4}\.\dQ")).select(
        "issuer",
        "ord",
        p["fy"].cast("bigint").alias("fy"),
        p["fq"].cast("bigint").alias("fq"),
        *((F.col(m) * factor).alias(m) for m in measures),
    )
    first = rows.where(~P.is_empty_statement(measures)).groupBy("issuer", "fy", "fq").agg(
        F.min_by(F.struct(*measures), "ord").alias("_m")
    )
    return first.select("issuer", "fy", "fq", "_m.*")


def full_year_results(results: DataFrame, *, start: str = "cum_start", end: str = "cum_end", measures: Sequence[str] = MEASURES) -> DataFrame:
    """Cumulative preliminary results that span a calendar year, as annual records."""
    factor = N.unit_multiplier("unit", default="백만원")
    rows = results.where(F.col(start).endswith("-01-01") & F.col(end).endswith("-12-31")).select(
        "issuer",
        "ord",
        F.substring(start, 1, 4).cast("bigint").alias("fy"),
        *((F.col(m) * factor).alias(m) for m in measures),
    )
    first = rows.where(~P.is_empty_statement(measures)).groupBy("issuer", "fy").agg(
        F.min_by(F.struct(*measures), "ord").alias("_m")
    )
    return first.select("issuer", "fy", "_m.*")


def reconcile_statements(
    quarters: DataFrame, annual: DataFrame, report_ytd: DataFrame, performance: DataFrame, preliminary: DataFrame,
    *, report_quarters: DataFrame | None = None, measures: Sequence[str] = MEASURES, n_quarters: int | None = None, n_years: int | None = None,
) -> DataFrame:
    """The quarterly table of a report.

    Notices, preliminary results, report gap fill, year-to-date differences, Q4 from the year,
    labels, empty rows out; the newest ``n_quarters`` and latest ``n_years`` calendar years if given. Everything up to the
    labels happens inside one row per (issuer, fy), after a single shuffle of the united
    sources. Period is the sort key throughout, never list position.
    """
    sources = {
        **Y.quarter_source("q", quarters),
        **Y.annual_source("a", annual),
        **Y.quarter_source("y", report_ytd, (1, 2, 3)),
        **Y.performance_source(performance),
        **Y.quarter_source("r", preliminary),
    }
    if report_quarters is not None:
        sources |= Y.quarter_source("g", report_quarters, (1, 2, 3))
    wide = Y.year_slots(sources, measures)
    wide = Y.put(wide, "a0", "pa0", measures)
    wide = Y.merge_performance(wide, measures)
    wide = Y.put_quarters(wide, "q", "r", measures)
    if report_quarters is not None:
        wide = Y.put_quarters(wide, "q", "g", measures, (1, 2, 3))
    wide = Y.fill_from_ytd(wide, measures)
    wide = Y.fill_q4(wide, measures)
    q = W.yoy_positional(Y.quarter_rows(wide, measures), measures=measures)
    q = q.where(~P.is_empty_statement(measures))
    if n_quarters is not None:
        q = O.top_n_per_key(q, n_quarters, keys=["issuer"], order=[F.desc("fy"), F.desc("fq")])
    return q if n_years is None else P.display_years(q, years=n_years)

"""Grouped reductions. All of them combine before the shuffle; none keeps a group in memory."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.numbers import EXACT, amount_of, floor_div, parse_amount, sum_skip_null
from .labels import Rules, field_of_label, label_rank


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_match(rank: Column, amount: Column, order: Column | str) -> Column:
    """Amount of the best-ranked row, first by order.

    ``min_by`` keeps a NULL amount of the winning row, so an unreadable amount under the best
    label is NULL and does not fall through to a later label.
    """
    key = F.when(rank.isNotNull(), F.struct(rank.alias("r"), _col(order).alias("o")))
    return F.min_by(amount, key)


def pivot_accounts(
    lines: DataFrame,
    *,
    keys: Sequence[str],
    rules: Rules,
    statements: Sequence[str],
    exclusions: Rules = lx.LABEL_EXCLUSIONS,
    rule: str = "first",
    account: str = "account_nm",
    amount: str = "amount",
    order: str = "ord",
    statement: str = "sj_div",
    scale: Column | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Statement lines -> one wide record per key.

    ``first``: per field the patterns in order, equal before contained, first row by order; the
    statements are tried one after another. ``last``: every row goes to one field and a later
    present amount overwrites. ``scale`` (an aggregate) divides the picked amounts by its floor;
    ``extra`` aggregates come along in the same pass. Amounts given as text are read exactly, as
    ``decimal(38,0)``; with a scale they come back as BIGINT.
    """
    value = amount_of(lines, amount)
    aggs = []
    if rule == "first":
        for field, patterns in rules.items():
            rank = label_rank(account, patterns, exclusions)
            tries = [
                first_match(F.when(F.col(statement) == s, rank), value, order) for s in statements
            ]
            aggs.append(F.coalesce(*tries).alias(field))
    elif rule == "last":
        field_name = F.when(F.col(statement).isin(*statements), field_of_label(account, rules, exclusions))
        lines = lines.withColumn("_field", field_name).withColumn("_value", value)
        for field in rules:
            hit = (F.col("_field") == field) & F.col("_value").isNotNull()
            aggs.append(F.max_by(F.when(hit, F.col("_value")), F.when(hit, F.col(order))).alias(field))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    aggs += extra
    if scale is not None:
        aggs.append(scale.alias("_scale"))
    wide = lines.groupBy(*keys).agg(*aggs)
    if scale is None:
        return wide


    def scaled(f: str) -> Column:
        whole = F.col(f) - F.pmod(F.col(f).cast(EXACT), F.col("_scale").cast(EXACT))
        return F.when(F.col("_scale") > 1, whole / F.col("_scale")).otherwise(F.col(f)).try_cast("bigint").alias(f)

    return wide.select(
        *keys,
        *(scaled(f) for f in rules),
        *(c for c in wide.columns if c not in {*keys, *rules, "_scale"}),
    )


def sum_of_label(labels: Sequence[str], amount: Column, account: Column | str, exclusions: Rules = lx.LABEL_EXCLUSIONS, where: Column | None = None) -> Column:
    """Aggregate: sum of all rows under a label; contained labels count only without an equal one."""
    parts = []
    for label in labels:
        rank = label_rank(account, [label], exclusions)
        if where is not None:
            rank = F.when(where, rank)
        exact, part = F.sum(F.when(rank == 0, amount)), F.sum(F.when(rank == 1, amount))
        parts.append(F.when(F.count_if(rank == 0) > 0, exact).otherwise(part))
    return sum_skip_null(*parts, kind=EXACT)


def sum_matching(
    lines: DataFrame,
    *,
    keys: Sequence[str],
    labels: Sequence[str] = tuple(lx.BORROWINGS_LABELS),
    exclusions: Rules = lx.LABEL_EXCLUSIONS,
    account: str = "account_nm",
    amount: str = "amount",
    out: str = "total",
) -> DataFrame:
    """All rows under a label, added up per key."""
    value = amount_of(lines, amount)
    return lines.groupBy(*keys).agg(sum_of_label(labels, value, account, exclusions).alias(out))


def inflation_scale(amount: Column, statement: Column) -> Column:
    """Aggregate: 1,000,000 when at least two income amounts exceed 100,000 in magnitude and all
    of those divide by 1,000,000, else 1."""
    big = statement.isin("IS", "CIS") & (F.abs(amount) > 100_000)
    whole = F.pmod(amount, F.lit(1_000_000).cast("bigint")) == 0
    inflated = (F.count_if(big) >= 2) & F.bool_and(F.when(big, whole))
    return F.when(inflated, F.lit(1_000_000)).otherwise(F.lit(1)).cast("bigint")


def detect_unit_inflation(
    lines: DataFrame, *, keys: Sequence[str], amount: str = "amount", statement: str = "sj_div", out: str = "scale"
) -> DataFrame:
    """One row per filing with the scale its income amounts are inflated by."""
    value = amount_of(lines, amount)
    return lines.groupBy(*keys).agg(inflation_scale(value, F.col(statement)).alias(out))


def interest_bearing_debt() -> Column:
    """Debt of a wide balance sheet: combined accounts win over components, bare total last; added up exactly."""
    c = F.col
    total = partial(sum_skip_null, kind=EXACT)
    short = F.when(
        c("short_term_debt_and_bonds").isNotNull(),
        total("short_term_debt_and_bonds", "current_long_term_debt", "current_bonds"),
    ).otherwise(total("short_term_borrowings", "current_long_term_debt", "current_bonds"))
    long = F.coalesce(c("long_term_debt_and_bonds"), total("long_term_borrowings", "bonds"))
    return F.coalesce(total(short, long), c("borrowings_total"))


def ytd_sum_with_gap_rule(
    quarters: DataFrame, *, issuer: str = "issuer", fy: str = "fy", fq: str = "fq", measures: Sequence[str]
) -> DataFrame:
    """Q1..Qn of the latest year and the same span of the year before.

    Quarters missing before the first value count as absent, a gap after it makes the sum NULL.
    No row when the latest quarter is the fourth. Quarters and years per issuer are few, so the
    two passes shuffle only those.
    """
    w = Window.partitionBy(issuer)
    latest = F.max(F.struct(F.col(fy), F.col(fq))).over(w)
    n = F.col("_last")[fq]
    in_span = quarters.withColumn("_last", latest).where(
        (n != 4)
        & (F.col(fq) <= n)
        & ((F.col(fy) == F.col("_last")[fy]) | (F.col(fy) == F.col("_last")[fy] - 1))
    )
    aggs = []
    for when, prefix in ((F.col(fy) == F.col("_last")[fy], ""), (F.col(fy) < F.col("_last")[fy], "prev_")):
        for m in measures:
            v = F.when(when, F.col(m))
            first = F.min(F.when(v.isNotNull(), F.col(fq)))
            whole = F.count(v) == F.max(n) - first + 1
            aggs.append(F.when(whole, F.sum(v)).alias(prefix + m))
    return in_span.groupBy(issuer).agg(
        F.max(F.col("_last")[fy]).alias(fy), F.max(n).alias(fq), *aggs
    )


def price_summary(
    bars: DataFrame, *, as_of: Column, years: int = 1, issuer: str = "issuer", day: str = "trade_date", close: str = "close"
) -> DataFrame:
    """First, last, lowest and highest close of the window; ties go to the earliest day."""
    requested = years * 365
    d, p = F.col(day), F.col(close)
    span = F.date_diff(F.col("period_end"), F.col("period_start"))
    return (
        bars.where(d >= F.date_sub(as_of, requested))
        .groupBy(issuer)
        .agg(
            F.min(d).alias("period_start"),
            F.max(d).alias("period_end"),
            F.min_by(p, d).alias("start_price"),
            F.max_by(p, d).alias("current_price"),
            F.min(p).alias("low_price"),
            F.min_by(d, F.struct(p, d)).alias("low_date"),
            F.max(p).alias("high_price"),
            F.min_by(d, F.struct(-p, d)).alias("high_date"),
            F.count("*").alias("n_days"),
        )
        .where((F.col("n_days") >= 2) & (F.col("start_price") > 0) & (F.col("current_price") > 0))
        .withColumn(
            "return_pct", (F.col("current_price") - F.col("start_price")) / F.col("start_price") * 100
        )
        .withColumn(
            "return_label",
            F.when(span < requested * 0.9, F.lit("상장후수익률")).otherwise(F.lit("1년수익률")),
        )
    )


def mean_estimate(estimates: DataFrame, *, keys: Sequence[str], value: str, out: str = "mean_estimate") -> DataFrame:
    """Floor of the mean of the present estimates."""
    return estimates.groupBy(*keys).agg(floor_div(F.sum(value), F.count(value)).alias(out))


def segment_totals(
    amounts: DataFrame, *, keys: Sequence[str], segment: str, amount: str, order: str | None = None
) -> DataFrame:
    """Total per period and its breakdown text.

    Amounts are first summed per segment, so what is listed is the segments of a period.
    """
    per = amounts.groupBy(*keys, segment).agg(
        F.sum(amount).alias("_amount"), (F.min(order) if order else F.min(segment)).alias("_ord")
    )
    part = F.struct(
        F.col("_ord").alias("o"),
        F.col(segment).alias("s"),
        F.concat(F.col(segment), F.lit(" "), F.format_number("_amount", 0)).alias("t"),
    )
    listed = F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"])
    return per.groupBy(*keys).agg(
        F.sum("_amount").alias("total"), F.array_join(listed, " / ").alias("breakdown")
    )


def total_dilutive_shares(
    instruments: DataFrame, *, as_of: Column, total_shares: str, keys: Sequence[str] = ("issuer",),
    shares: str = "convertible_shares", end: str = "exercise_end",
) -> DataFrame:
    """Shares of instruments that have not expired, and their percentage of all shares."""
    live = F.when(F.col(end).isNull() | (F.col(end) >= as_of), F.col(shares)).otherwise(0)
    pct = F.when(
        F.col("total_shares") > 0, F.col("dilutive_shares") / F.col("total_shares") * 100
    ).otherwise(0.0)
    return (
        instruments.groupBy(*keys)
        .agg(F.sum(live).alias("dilutive_shares"), F.max(total_shares).alias("total_shares"))
        .withColumn("dilution_pct", pct)
    )


def sum_funding(columns: Sequence[str]) -> Column:
    """Sum of the fund purposes of a decision; NULL when nothing is stated."""
    return F.nullif(sum_skip_null(*(parse_amount(c) for c in columns)), F.lit(0))


def outcome_counts(outcomes: DataFrame, *, keys: Sequence[str], status: str = "status", output: str = "output") -> DataFrame:
    """Run summary: successes, failures and successes that produced nothing."""
    ok = F.col(status) == "ok"
    return outcomes.groupBy(*keys).agg(
        F.count_if(ok & F.col(output).isNotNull()).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & F.col(output).isNull()).alias("no_output"),
        F.count("*").alias("total"),
    )


def empty_sections(reports: DataFrame, *, keys: Sequence[str], sections: Sequence[str]) -> DataFrame:
    """Names of the report sections that are empty, in section order."""
    names = F.array(*(F.when(F.coalesce(F.trim(s), F.lit("")) == "", F.lit(s)) for s in sections))
    return reports.select(*keys, F.array_join(F.array_compact(names), ",").alias("empty_sections"))


def power_of_ten_fix(
    parts: DataFrame, known: DataFrame, *, keys: Sequence[str], amount: str, known_total: str,
    label: str = "label", divisor: int = lx.DISPLAY_DIVISOR_KRW,
) -> DataFrame:
    """Rescale the components of a breakdown that is off by a power of ten.

    Total rows take no part in the sum but are rescaled with the rest. The check is one sum
    per key, joined back, so a hot key is combined before the shuffle.
    """
    is_total = F.col(label).rlike("합계|총계")
    sums = parts.groupBy(*keys).agg(F.sum(F.when(~is_total, F.col(amount))).alias("_sum"))
    ratio = F.col("_sum") / (F.col(known_total) / F.lit(float(divisor)))
    factor = F.lit(1)
    for f in (1000, 100, 10):
        factor = F.when(ratio.between(0.7 * f, 1.5 * f), F.lit(f)).otherwise(factor)
    usable = (F.col(known_total) > 0) & (F.col("_sum") > 0)
    factors = sums.join(known, list(keys), "left").select(
        *keys, F.when(usable, factor).otherwise(F.lit(1)).alias("factor")
    )
    fixed = F.when(F.col("factor") > 1, F.bround(F.col(amount) / F.col("factor"), 0).cast("bigint"))
    return parts.join(factors, list(keys)).withColumn(amount, F.coalesce(fixed, F.col(amount)))


def validate_face_value(face: Column, price: Column, shares: Column) -> Column:
    """Face value off by a thousand or a million against price x shares becomes that product."""
    expected = price.cast("decimal(38,0)") * shares
    ratio = F.try_divide(face.cast("double"), expected.cast("double"))
    off = ((ratio > 900) & (ratio < 1100)) | ((ratio > 900_000) & (ratio < 1_100_000))
    return F.when((face != 0) & (expected > 0) & off, expected.cast("bigint")).otherwise(face)


def share_of_total(parts: DataFrame, *, keys: Sequence[str], label: str, amount: str, out: str = "share_pct") -> DataFrame:
    """Share of each component in the recomputed total; total rows are dropped.

    One partial sum per key is joined back instead of a window, so no key is sorted whole.
    """
    rows = parts.where(~F.col(label).rlike("합계|총계"))
    totals = rows.groupBy(*keys).agg(F.sum(amount).alias("_total"))
    return rows.join(totals, list(keys)).select(
        *rows.columns, F.round(F.try_divide(F.col(amount) * 100, F.col("_total")), 1).alias(out)
    )

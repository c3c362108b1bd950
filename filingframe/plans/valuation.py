"""Market value, multiples and contract rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import format_period
from ..functions.numbers import floor_div, format_thousands, to_eok, unit_multiplier
from ..operators.predicates import after_reference


def market_cap(market: DataFrame, *, price: str = "stock_price", cap: str = "market_cap", shares: str = "shares_outstanding") -> DataFrame:
    """Missing share count from cap / price, missing cap from price x shares.

    ``value`` is always price x shares: multiples use it, not the reported cap.
    """
    derived = F.when((F.col(cap) > 0) & (F.col(price) > 0), floor_div(F.col(cap), F.col(price)))
    out = market.withColumn(shares, F.coalesce(F.col(shares), derived))
    out = out.withColumn(cap, F.coalesce(F.col(cap), F.col(price) * F.col(shares)))
    positive = (F.col(price) > 0) & (F.col(shares) > 0)
    return out.withColumn("value", F.when(positive, F.col(price) * F.col(shares)))


def _fixed(x: Column, digits: int) -> Column:
    """Decimal text with half-even rounding, as a number is printed."""
    return F.bround(x, digits).cast(f"decimal(30,{digits})").cast("string")


def pbr(value: Column, equity: Column, currency: Column) -> Column:
    """Price to book; statements in another currency are stated as not computable."""
    home = F.concat(
        _fixed(F.try_divide(value, equity), 2), F.lit("배 (시가총액 "), format_thousands(to_eok(value)),
        F.lit(" 억원 / 자본총계 "), format_thousands(to_eok(equity)), F.lit(" 억원)"),
    )
    foreign = F.concat(
        F.lit("산출불가 (재무제표 "), currency, F.lit(" 기준, 시가총액 "), format_thousands(to_eok(value)), F.lit(" 억원)")
    )
    return F.coalesce(
        F.when((value > 0) & (currency == "KRW") & (equity > 0), home).when((value > 0) & (currency != "KRW"), foreign),
        F.lit(""),
    )


def latest_annual_income(annual: DataFrame, *, issuer: str = "issuer", fy: str = "fy", income: str = "net_income") -> DataFrame:
    """Newest annual row whose net income is known."""
    key = F.when(F.col(income).isNotNull(), F.col(fy))
    return annual.groupBy(issuer).agg(F.max(key).alias("income_fy"), F.max_by(income, key).alias("annual_net_income"))


def trailing_per(value: Column, income: Column, fy: Column, currency: Column) -> Column:
    """Price to earnings of the newest full year; losses have none."""
    year = fy.cast("string")
    good = F.concat(
        _fixed(F.try_divide(value, income), 1), F.lit("배 (시가총액 "), format_thousands(to_eok(value)), F.lit(" 억원 / "),
        year, F.lit("년 순이익 "), format_thousands(to_eok(income)), F.lit(" 억원)"),
    )
    home = F.when(income > 0, good).when(income.isNotNull(), F.concat(F.lit("해당없음 ("), year, F.lit("년 순손실)")))
    foreign = F.concat(F.lit("산출불가 (재무제표 "), currency, F.lit(" 기준)"))
    return F.coalesce(F.when((value > 0) & (currency == "KRW"), home).when((value > 0) & (currency != "KRW"), foreign), F.lit(""))


def forward_per(value: Column, consensus: Column, research: Column, year: Column) -> Column:
    """Price to the current year's estimate: consensus when positive, else the research mean."""
    estimate = F.coalesce(F.when(consensus > 0, consensus), F.when(research > 0, research))
    text = F.concat(
        _fixed(F.try_divide(value, estimate), 1), F.lit("배 (시가총액 "), format_thousands(to_eok(value)), F.lit(" 억원 / "),
        year.cast("string"), F.lit("E 순이익 "), format_thousands(to_eok(estimate)), F.lit(" 억원)"),
    )
    return F.coalesce(F.when((value > 0) & estimate.isNotNull(), text), F.lit(""))


def fully_diluted_cap(price: Column, shares: Column, dilutive: Column) -> Column:
    """Market value with all dilutive shares issued."""
    return F.when((price > 0) & (shares > 0), (shares + F.coalesce(dilutive, F.lit(0))) * price)


def contract_rows(contracts: DataFrame, refs: DataFrame | None = None, *, issuer: str = "issuer", keep: Sequence[str] = ("ord",)) -> DataFrame:
    """Supply contracts after the reference date, amounts in 억원 text."""
    rows = contracts if refs is None else after_reference(contracts, refs, issuer=issuer)
    cancel = F.col("type") == "단일판매ㆍ공급계약해지"
    amount = F.when(cancel, F.col("cancel_amount")).otherwise(F.col("contract_amount"))
    won = amount * unit_multiplier("amount_unit", default="원")
    optional = {c: F.col(c) for c in ("description", "detail", "counterparty") if c in contracts.columns}
    return rows.select(
        issuer,
        *keep,
        F.when(cancel, F.lit("해지")).otherwise(F.lit("체결")).alias("contract_type"),
        *(F.coalesce(v, F.lit("")).alias(c) for c, v in optional.items()),
        F.when(amount > 0, format_thousands(to_eok(won))).otherwise("").alias("amount_eok"),
        F.when(F.col("revenue_ratio_pct") != 0, F.concat(_fixed(F.col("revenue_ratio_pct"), 1), F.lit("%"))).alias("revenue_ratio_pct"),
        format_period("period_start", "period_end").alias("contract_period"),
    )

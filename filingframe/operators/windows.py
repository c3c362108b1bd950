"""Ordered computations.

Windows are used only where a partition is bounded by the calendar (quarters, trading days,
lines of one filing). Where a group may be of any size the operator uses a group limit or a
two-level running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import yoy_label


def yoy_positional(periods: DataFrame, *, issuer: str = "issuer", fy: str = "fy", fq: str = "fq", measures: Sequence[str], display: bool = False, suffix: str = "_yoy") -> DataFrame:
    """Label against the previous row of the same quarter, across missing years."""
    w = Window.partitionBy(issuer, fq).orderBy(fy)
    return periods.select(
        "*", *(yoy_label(F.col(m), F.lag(m).over(w), display).alias(m + suffix) for m in measures)
    )


def moving_average(bars: DataFrame, *, issuer: str = "issuer", day: str = "trade_date", close: str = "close", spans: Sequence[int] = (20, 60), last_n: int | None = None) -> DataFrame:
    """Simple moving averages over the whole series, NULL until a window is full; then the last
    ``last_n`` days. A partition is one issuer's trading days."""
    by_day = Window.partitionBy(issuer).orderBy(day)
    cols = []
    for n in spans:
        w = by_day.rowsBetween(-(n - 1), 0)
        cols.append(F.when(F.count(close).over(w) == n, F.sum(close).over(w) / n).alias(f"ma{n}"))
    out = bars.select("*", *cols)
    if last_n is not None:
        newest = Window.partitionBy(issuer).orderBy(F.desc(day))
        out = out.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= last_n).drop("_rn")
    return out


def chain_estimates(actuals: DataFrame, estimates: DataFrame, *, issuer: str = "issuer", fy: str = "fy", measures: Sequence[str]) -> DataFrame:
    """Estimates with labels against the last known earlier value, seeded by the newest actual."""
    cols = [issuer, fy, *measures]
    seed = actuals.groupBy(issuer).agg(F.max_by(F.struct(*cols), fy).alias("_s")).select("_s.*")
    both = seed.select(*cols, F.lit(0).alias("_est")).unionByName(
        estimates.select(*cols, F.lit(1).alias("_est"))
    )
    w = Window.partitionBy(issuer).orderBy("_est", fy).rowsBetween(Window.unboundedPreceding, -1)
    labelled = both.select(
        *cols, "_est", *(yoy_label(F.col(m), F.last(m, ignorenulls=True).over(w)).alias(f"{m}_yoy") for m in measures)
    )
    return labelled.where(F.col("_est") == 1).drop("_est")


def latest_per_issuer(filings: DataFrame, *, issuer: Sequence[str] = ("issuer",), order: Sequence[str] = ("rcept_dt", "rcept_no")) -> DataFrame:
    """Newest filing per key, ties by receipt number; an aggregate, so nothing is sorted."""
    rest = [c for c in filings.columns if c not in issuer]
    best = filings.groupBy(*issuer).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*issuer, "_r.*").select(*filings.columns)


def latest_balance_sheet(sheets: DataFrame, *, as_of: Column, settlement_month: Column, issuer: str = "issuer", fy: str = "fy", fq: str = "fq", assets: str = "total_assets") -> DataFrame:
    """Newest usable balance sheet and the (fy) it is compared with.

    Order: ongoing year Q3, Q2, Q1; completed year annual, then Q3, Q2, Q1; the year before.
    Quarter 0 is the annual sheet. Rows without total assets do not qualify.
    """
    ongoing = F.year(as_of) + F.when(F.month(as_of) <= settlement_month, 0).otherwise(1)
    back = ongoing - F.col(fy)
    rank = (
        F.when((back == 0) & (F.col(fq) > 0), 3 - F.col(fq))
        .when((back == 1) & (F.col(fq) == 0), F.lit(3))
        .when((back == 1) & (F.col(fq) > 0), 7 - F.col(fq))
        .when((back == 2) & (F.col(fq) == 0), F.lit(7))
    )
    compare = F.when(back == 0, F.col(fy) - 1).otherwise(F.col(fy) - 1)
    ranked = sheets.where(F.col(assets).isNotNull() & rank.isNotNull()).select(
        "*", rank.alias("_rank"), compare.alias("prev_fy")
    )
    rest = [c for c in ranked.columns if c not in (issuer, "_rank")]
    best = ranked.groupBy(issuer).agg(F.min_by(F.struct(*rest), "_rank").alias("_r"))
    return best.select(issuer, "_r.*")


def with_comparison_sheet(picked: DataFrame, sheets: DataFrame, *, issuer: str = "issuer", fy: str = "fy", fq: str = "fq", cols: Sequence[str], assets: str = "total_assets") -> DataFrame:
    """Annual sheet of ``prev_fy`` next to the picked one (NULL when it has no total assets)."""
    prior = sheets.where((F.col(fq) == 0) & F.col(assets).isNotNull()).select(
        issuer, F.col(fy).alias("prev_fy"), *(F.col(c).alias(f"prev_{c}") for c in cols)
    )
    return picked.join(prior, [issuer, "prev_fy"], "left")


def running_sum(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: str, slot: Column, out: str = "before") -> DataFrame:
    """Sum of ``value`` over the earlier rows of a key, in two levels.

    ``slot`` is any coarsening of the order (a day, a range of numbers). Rows are sorted only
    within (key, slot); the slots of a key are summed first and their running totals joined
    back, so a key holding a third of all rows is spread over its slots.
    """
    marked = df.withColumn("_slot", slot)
    per_slot = marked.groupBy(*keys, "_slot").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slot.select(*keys, "_slot", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumn("_local", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return local.join(offsets, [*keys, "_slot"]).select(*df.columns, (F.col("_offset") + F.col("_local")).alias(out))


def news_entry(day: str = "date", title: str = "title", content: str = "content", max_body: int | None = None) -> Column:
    """One formatted article: headline, then the body, clipped with dots after ``max_body`` characters."""
    body = F.col(content)
    cut = body
    if max_body is not None:
        cut = F.concat(F.substring(body, 1, max_body), F.when(F.length(body) > max_body, "...").otherwise(""))
    head = F.concat(F.lit("- ["), F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("")), F.lit("] "), F.col(title))
    return F.concat(head, F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit("\n  "), cut)).otherwise(""))


def char_budget(entries: DataFrame, *, keys: Sequence[str], order: Sequence[str], text: str, slot: Column, max_total: int, least: int = 15) -> DataFrame:
    """Entries while the length of all earlier ones is below the budget.

    Entries shorter than ``least`` characters (a headline mark and a date have more) count that
    much, so no more than ``max_total / least`` + 1 entries of a key can start inside the budget:
    a group limit drops the others in every task before lengths are added up.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    few = entries.withColumn("_rank", rank).where(F.col("_rank") <= max_total // least + 1).drop("_rank")
    sized = few.withColumn("_len", F.greatest(F.length(text), F.lit(least)))
    run = running_sum(sized, keys=keys, order=order, value="_len", slot=slot, out="_before")
    return run.where(F.col("_before") < max_total).drop("_before", "_len")


def first_n_with_content(articles: DataFrame, *, keys: Sequence[str], order: str, content: str, n: int = 20) -> DataFrame:
    """Articles up to the n-th one that has a body; all of them when fewer have one.

    The n-th is found with a group limit (each task keeps at most n rows per key).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    has = articles.where(F.coalesce(F.col(content), F.lit("")) != "").select(*keys, order)
    top = has.select(*keys, order, F.row_number().over(w).alias("_rn")).where(F.col("_rn") <= n)
    cut = top.groupBy(*keys).agg(
        F.when(F.count("*") == n, F.max(order)).alias("_cut")
    )
    return (
        articles.join(cut, list(keys), "left")
        .where(F.col("_cut").isNull() | (F.col(order) <= F.col("_cut")))
        .drop("_cut")
    )


def rowspan_carry(cells: DataFrame, *, table: Sequence[str], row: str, label: str, value: str) -> DataFrame:
    """Label fills down over the rows of its span; values of one label are joined by line ends.

    A partition is one table of one document.
    """
    w = Window.partitionBy(*table).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    filled = cells.withColumn(label, F.last(F.nullif(F.col(label), F.lit("")), ignorenulls=True).over(w))
    part = F.struct(F.col(row).alias("r"), F.col(value).alias("v"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["v"]), "\n")
    return filled.where(F.col(label).isNotNull()).groupBy(*table, label).agg(joined.alias(value))

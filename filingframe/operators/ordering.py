"""Display order, top-n and text prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip, clip_at_break

__all__ = ["order_newest_first", "top_n_per_key", "event_order", "order_instruments", "clip", "clip_at_break"]


def order_newest_first(df: DataFrame, *, issuer: str = "issuer", fy: str = "fy", fq: str = "fq") -> DataFrame:
    """By explicit period, newest first; a range sort, so no single task holds everything."""
    return df.orderBy(issuer, F.desc(fy), F.desc(fq))


def top_n_per_key(df: DataFrame, n: int, *, keys: Sequence[str], order: Sequence[Column], rank: str | None = None) -> DataFrame:
    """First n rows per key; Spark's group limit cuts each key to n rows before the shuffle."""
    name = rank or "_rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def event_order(phase: Column, day: Column, order: Column) -> Column:
    """Sort key of state events: exercises, then price adjustments, each by date."""
    return F.struct(phase.alias("phase"), day.alias("day"), order.alias("ord"))


def order_instruments(df: DataFrame, *, issuer: str = "issuer") -> DataFrame:
    """By display category, instrument key within it."""
    return df.orderBy(issuer, "category_label", "instrument_key")

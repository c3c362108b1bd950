"""Year-over-year wording and percentage notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx


def signed_percent(pct: Column) -> Column:
    """``+276%`` / ``-16%``, half-even; the sign is that of the unrounded value."""
    whole = F.abs(F.bround(pct, 0)).cast("bigint").cast("string")
    return F.concat(F.when(pct >= 0, F.lit("+")).otherwise(F.lit("-")), whole, F.lit("%"))


def _ratio(cur: Column, prev: Column) -> Column:
    return F.try_divide((cur - prev).cast("double"), F.abs(prev).cast("double")) * 100


def yoy_label(cur: Column | str, prev: Column | str, display: bool = True) -> Column:
    """Year-over-year label with the turn-around words.

    ``display`` writes ``-`` for unknown and treats a zero base as a turn; the statement
    form (``display=False``) is NULL in both cases.
    """
    cur = F.col(cur) if isinstance(cur, str) else cur
    prev = F.col(prev) if isinstance(prev, str) else prev
    zero_base = (
        F.when(cur > 0, F.lit(lx.TURN_PROFIT)).when(cur < 0, F.lit(lx.TURN_LOSS)).otherwise("-")
        if display
        else F.lit(None).cast("string")
    )
    losses = (
        F.when(F.abs(cur) < F.abs(prev), F.lit(lx.LOSS_NARROWED))
        .when(F.abs(cur) > F.abs(prev), F.lit(lx.LOSS_WIDENED))
        .otherwise(F.lit(lx.LOSS_SAME))
    )
    return (
        F.when(cur.isNull() | prev.isNull(), F.lit("-" if display else None).cast("string"))
        .when((cur > 0) & (prev < 0), F.lit(lx.TURN_PROFIT))
        .when((cur < 0) & (prev > 0), F.lit(lx.TURN_LOSS))
        .when((cur < 0) & (prev < 0), losses)
        .when(prev == 0, zero_base)
        .otherwise(signed_percent(_ratio(cur, prev)))
    )


def pct_change_note(cur: Column, prev: Column) -> Column:
    """Signed percentage without turn-around words; empty when there is no base."""
    return F.coalesce(F.when(prev != 0, signed_percent(_ratio(cur, prev))), F.lit(""))


def plain_yoy(cur: Column, prev: Column) -> Column:
    """Percentage for totals: only over a positive base."""
    return F.when(prev > 0, signed_percent(_ratio(cur, prev)))

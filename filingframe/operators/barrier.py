"""Keeps long expressions from being copied by the optimizer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame) -> DataFrame:
    """Columns computed so far stay computed once.

    A filter or a generator above a projection is pushed below it with the projected expressions
    copied in, so a page would be parsed once for the filter and again for the result. A row
    number that is looked at but never used stops that; it costs one counter per row and no
    shuffle.
    """
    row = "_pinned"
    return df.withColumn(row, F.monotonically_increasing_id()).where(F.col(row) >= 0).drop(row)

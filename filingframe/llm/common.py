"""Small helpers shared by the jobs of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder: computed once, kept when executors go."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_articles(df: DataFrame, url: str, content: str, **more: Column) -> DataFrame:
    """Only ``url``, ``content`` and the named expressions; other columns of ``df`` are left behind."""
    return df.select(F.col(url).alias("url"), F.col(content).cast("string").alias("content"), *(c.alias(n) for n, c in more.items()))


def arrow_schema(df: DataFrame, keep: Iterable[str], *fields: tuple[str, T.DataType]) -> T.StructType:
    """Schema of a mapInArrow step that passes ``keep`` through and adds ``fields``."""
    return T.StructType([T.StructField(k, df.schema[k].dataType) for k in keep] + [T.StructField(n, t) for n, t in fields])


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``column`` (at least one row each)."""
    for batch in batches:
        sizes = np.asarray(batch.column(column).cast(pa.binary()).is_valid(), dtype=np.int64)
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths + sizes) // limit
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def same_text(url: str = "url", content: str = "content") -> list[Column]:
    """Key of an article that also tells apart different texts saved under one url."""
    return [F.col(url), F.xxhash64(F.col(content)).alias("digest"), F.length(content).alias("size")]


def least_count(counted: DataFrame, most: int) -> int:
    """Smallest count such that at most ``most`` rows have it or more."""
    top = 1 << 16
    sizes = sorted(counted.groupBy(F.least("n", F.lit(top)).alias("c")).count().collect(), reverse=True)  # 65,536 rows at most
    total = 0
    for c, rows in sizes:
        total += rows
        if total > most:
            if c == top:  # so many rows above the histogram: the count of the row at the bound
                return counted.orderBy(F.desc("n")).offset(most).first()["n"] + 1
            return c + 1
    return 1

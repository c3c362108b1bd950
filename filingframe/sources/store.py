"""Tables laid out for what reads them: bucketed by key, partitioned by period.

Rows of one key lie in one bucket, so a grouping, a window or a join by that key reads them where
they are, without a shuffle of the stored side, however large it has become. A range of periods
reads its partitions only, also when the range comes from a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Store:
    """Name, folder and layout of a table; ``buckets`` stays as it is for the life of the table."""

    path: str
    keys: tuple[str, ...]
    buckets: int
    period: tuple[str, ...] = ()
    table: str = ""

    def __post_init__(self) -> None:
        if not self.table:
            object.__setattr__(self, "table", f"filingframe_{uuid.uuid4().hex}")


def append(df: DataFrame, store: Store) -> None:
    """Adds rows bucket by bucket: one shuffle of the new rows, none of the old ones.

    A task writes one bucket, and in it one file for each period the new rows have.
    """
    rows = df.repartition(store.buckets, *store.keys).write.mode("append").format("parquet").option("path", store.path)
    rows = rows.bucketBy(store.buckets, *store.keys).sortBy(*store.keys)
    (rows.partitionBy(*store.period) if store.period else rows).saveAsTable(store.table)


def attach(spark: SparkSession, store: Store, schema: T.StructType) -> DataFrame:
    """The table in a session that does not know it yet: its files with the layout they were written in."""
    columns = [f for f in schema.fields if f.name not in store.period] + [schema[p] for p in store.period]
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    names = lambda cols: ", ".join(f"`{c}`" for c in cols)
    parts = f" PARTITIONED BY ({names(store.period)})" if store.period else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {store.table} ({named}) USING parquet{parts}"
        f" CLUSTERED BY ({names(store.keys)}) SORTED BY ({names(store.keys)}) INTO {store.buckets} BUCKETS LOCATION '{store.path}'"
    )
    if store.period:
        spark.catalog.recoverPartitions(store.table)
    return read(spark, store)


def read(spark: SparkSession, store: Store) -> DataFrame:
    """The rows; filter by period first, then group or join by key."""
    return spark.table(store.table)


def buckets_for(spark: SparkSession) -> int:
    """As many buckets as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_store(spark: SparkSession, path: str, *, keys: Sequence[str], period: Sequence[str] = (), buckets: int | None = None) -> Store:
    return Store(path, tuple(keys), buckets or buckets_for(spark), tuple(period))

"""Sinks. Writes are partitioned, replace only what they carry and can be repeated safely."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store, append


def write_dated_json(df: DataFrame, path: str, *, issuer: str = "issuer", day: str = "run_date", url: str = "url", urls_path: str | None = None) -> None:
    """JSON per issuer and day, plus a text copy with the URLs alone."""
    by = [issuer, day]
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)
    if urls_path:
        df.select(*by, url).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).text(urls_path)


def dashed_date(df: DataFrame, column: str) -> DataFrame:
    """``YYYYMMDD`` -> ``YYYY-MM-DD``; other text stays."""
    nice = F.date_format(F.try_to_date(F.col(column), "yyyyMMdd"), "yyyy-MM-dd")
    return df.withColumn(column, F.coalesce(F.when(F.col(column).rlike(r"^\d{8}$"), nice), F.col(column)))


def write_report_rows(reports: DataFrame, path: str, *, partition: Sequence[str] = ("run_date",)) -> None:
    """One nested record per issuer; the partitions of this run replace their former content."""
    reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def append_manifest(done: DataFrame, manifest: Store) -> None:
    """Add fetched entries to the manifest after their data is written; ``manifest`` is bucketed by its keys."""
    append(done.select(*manifest.keys).distinct(), manifest)

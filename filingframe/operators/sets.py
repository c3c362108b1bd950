"""Unions, distincts and keyed merges that respect order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_sources(sources: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """All feeds with their name; columns a feed lacks are NULL."""
    out = None
    for name, df in sources.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def distinct_by_url(df: DataFrame, *, url: str = "url", order: str = "ord") -> DataFrame:
    """One row per URL: the last record's content at the first record's position."""
    rest = [c for c in df.columns if c not in (url, order)]
    one = df.groupBy(url).agg(
        F.max_by(F.struct(*rest), order).alias("_r"), F.min(order).alias(order)
    )
    return one.select(url, order, "_r.*").select(*df.columns)


def ordered_union(a: Column, b: Column, n: int | None = None) -> Column:
    """Existing entries, then unseen new ones."""
    empty = F.array().cast("array<string>")
    out = F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))
    return F.slice(out, 1, n) if n else out


def merge_sections(existing: DataFrame, new: DataFrame, *, keys: Sequence[str], header: str = "header", order: str = "ord", body: str = "body", analysis_headers: Sequence[str] = ()) -> DataFrame:
    """Sections of an updated report.

    Analysis sections keep their existing text when there is some, all other sections of the
    new report replace it, and sections only the old report has stay at its end.
    """
    old = existing.select(*keys, header, F.col(order).alias("_oo"), F.col(body).alias("_ob"))
    add = new.select(*keys, header, F.col(order).alias("_no"), F.col(body).alias("_nb"))
    j = old.join(add, [*keys, header], "full_outer")
    analysis = F.col(header).isin(*analysis_headers) if analysis_headers else F.lit(False)
    keep = analysis & (F.coalesce(F.trim("_ob"), F.lit("")) != "")
    text = F.when(F.col("_no").isNull() | keep, F.col("_ob")).otherwise(F.col("_nb"))
    action = (
        F.when(F.col("_no").isNull(), F.lit("kept_at_end"))
        .when(F.col("_oo").isNull(), F.lit("added"))
        .when(keep, F.lit("kept"))
        .otherwise(F.lit("replaced"))
    )
    return j.select(
        *keys,
        header,
        F.when(F.col("_no").isNull(), F.lit(1)).otherwise(0).alias("part"),
        F.coalesce("_no", "_oo").alias(order),
        text.alias(body),
        action.alias("action"),
    )


def join_sections(sections: DataFrame, *, keys: Sequence[str], order: Sequence[str], body: str, out: str = "text", glue: str = "\n\n") -> DataFrame:
    """Text of a document from its sections, in order (a document is bounded)."""
    part = F.struct(*order, F.col(body).alias("_b"))
    return sections.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["_b"]), glue).alias(out)
    )


def merge_front_matter(existing: Column, new: Column) -> Column:
    """Map merge: new values win, but the creation date stays the first one."""
    merged = F.map_concat(F.map_filter(existing, lambda k, v: ~F.map_contains_key(new, k)), new)
    keep = F.map_contains_key(existing, "created")
    kept = F.map_concat(
        F.map_filter(merged, lambda k, v: k != "created"), F.map_filter(existing, lambda k, v: k == "created")
    )
    return F.when(keep, kept).otherwise(merged)

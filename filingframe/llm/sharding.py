"""Shards of equal size in bytes, tokens and rows at once, by vector bin packing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_articles, written

_KEY = ["digest", "crc", "size", "part"]
_DIMENSIONS = ["bytes", "tokens", "rows"]


def place(units: np.ndarray, residual: np.ndarray, capacity: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Shard of each unit: most bytes first, where the dot product with the residual capacity is highest.

    All figures are taken as shares of ``capacity`` (that of a whole shard); ``weights`` say how much
    a dimension counts in the product. ``residual`` is used up; of equal products the first shard is taken.
    """
    need = units / capacity
    left = residual / capacity
    shards = np.empty(len(units), np.int32)
    for i in np.argsort(-need[:, 0], kind="stable"):
        shard = int((left @ (need[i] * weights)).argmax())
        left[shard] -= need[i]
        shards[i] = shard
    return shards


def shard_articles(
    articles: DataFrame, *, url: str = "url", content: str = "content", shards: int = 24, row_bytes: int = 8, task_units: int = 50_000, split: float = 0.25,
    weights: tuple[float, float, float] = (1.0, 0.3, 0.03),
) -> DataFrame:
    """(url, size, tokens, text_crc32, shard, slot): articles dealt to shards of near equal size.

    ``size`` is the UTF-8 length plus ``row_bytes`` and ``tokens`` counts words. Equal texts form a
    group that is placed as one unit; a group larger than ``split`` of a shard in any dimension is
    dealt into parts of that size first. ``weights`` of bytes, tokens and rows favour bytes, as a
    small unit weighs most as a row. Units above 1/1024 of a shard are placed in one step (there
    are at most 3 x 1024 x ``shards``), the rest in tasks of about ``task_units`` that share out
    what is left of every shard, and a bounded draw of units last, against the loads reached. Only
    loads per shard, 3 numbers each, come to the driver; texts are never shuffled.

    One row per input row; ``slot`` counts from 0 in each shard without a gap. Null texts have no
    bytes and crc32 0 and are one group, empty texts another. An empty table gives no rows.
    """
    text = F.coalesce("content", F.lit(""))
    rows = read_articles(articles, url, content).select(
        "url", (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"),
        F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64("content").alias("digest"),
    )
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "shard_rows")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = np.array([x or 0 for x in rows.agg(*sums).first()], float)
    capacity = np.maximum(total / shards, 1e-9)

    # groups above `split` of a shard: 3 * shards / split of them at most, so they may be broadcast
    groups = rows.groupBy("digest", "crc", "size").agg(*sums)
    most = F.greatest(*(F.col(d) / float(c) for d, c in zip(_DIMENSIONS, capacity, strict=True)))
    parts = groups.where((most > split) & (F.col("rows") > 1)).select("digest", "crc", "size", F.ceil(most / split).alias("parts"))
    rows = rows.join(F.broadcast(parts), ["digest", "crc", "size"], "left")
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)))
    units = rows.groupBy(*_KEY).agg(*sums)
    draw = F.pmod(F.xxhash64(*_KEY, F.lit("last")), F.lit(1 << 20))
    units = written(units.withColumn("heavy", most > 1 / 1024).withColumn("draw", draw).withColumn("deal", F.xxhash64(*_KEY)), "shard_units")

    light = units.where(~F.col("heavy"))
    n_light = light.count()
    last = F.col("draw") < int(min(1.0, task_units / max(1, n_light) / 2) * (1 << 20) / 2)
    free = np.tile(capacity, (shards, 1))
    placed = None
    phases = (("heavy", units.where("heavy"), 1), ("light", light.where(~last), max(1, n_light // task_units)), ("last", light.where(last), 1))
    for name, phase, tasks in phases:
        whole = np.maximum(np.array([x or 0 for x in phase.agg(*(F.sum(d) for d in _DIMENSIONS)).first()], float), 1e-9)

        schema = ", ".join(f"{k} {t}" for k, t in phase.select(*_KEY, *_DIMENSIONS).dtypes) + ", shard int"
        done = written(phase.groupBy(F.pmod("deal", F.lit(tasks)).alias("task")).applyInArrow(_filling(free, whole, capacity, np.array(weights)), schema), f"shard_{name}")
        free = free.copy()
        for r in done.groupBy("shard").agg(*(F.sum(d).alias(d) for d in _DIMENSIONS)).collect():  # a row per shard
            free[r["shard"]] -= [r[d] for d in _DIMENSIONS]
        placed = done if placed is None else placed.unionByName(done)

    out = rows.join(placed.select(*_KEY, "shard"), _KEY)
    return _numbered(out, int(total[2]), shards, task_units).select("url", "size", "tokens", F.col("crc").alias("text_crc32"), "shard", "slot")


def _filling(free: np.ndarray, whole: np.ndarray, capacity: np.ndarray, weights: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """Places the units of one task, which may use its share of the capacity that is ``free``."""

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in _KEY])
        own = np.stack([table[d].to_numpy().astype(float) for d in _DIMENSIONS], axis=1)
        chosen = place(own, free * (own.sum(axis=0) / whole), capacity, weights)
        return table.select([*_KEY, *_DIMENSIONS]).append_column("shard", pa.array(chosen))

    return fill


def _numbered(rows: DataFrame, n: int, shards: int, block_rows: int) -> DataFrame:
    """``slot`` 0, 1, 2, ... in each shard, in blocks small enough for one task."""
    rows = written(rows.withColumn("block", F.pmod(F.xxhash64("row", F.lit("block")), F.lit(max(1, n // (shards * block_rows) + 1)))), "sharded")
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row"))
    return rows.withColumn("rank", rank).join(starts, ["shard", "block"]).withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long"))

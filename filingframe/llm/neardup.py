"""Near-duplicate articles: SimHash fingerprints linked exactly through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, read_articles, small_batches, utf8, written

_SEED = 42
_LEAF = 128  # fingerprints compared without a further split


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit i is set where over half of the shingle hashes have it; no words give 0."""
    words = text.lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, _SEED) for p in parts), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


@dataclass
class Node:
    """Vantage point with the radius that parts its fingerprints; a leaf has a shard number only."""

    shard: int
    point: int = 0
    radius: int = 0
    near: Node | None = None
    far: Node | None = None


def distance(fingerprints: np.ndarray, point: int) -> np.ndarray:
    return np.bitwise_count(fingerprints ^ np.uint64(point)).astype(np.int64)


def split(fingerprints: np.ndarray) -> tuple[int, int]:
    """A vantage point and its median radius: of a few candidates, the one whose distances spread most."""
    tries = fingerprints[:: max(1, len(fingerprints) // 8)][:8]
    spread = [distance(fingerprints, int(v)).std() for v in tries]
    point = int(tries[int(np.argmax(spread))])
    return point, int(np.median(distance(fingerprints, point)))


def grow(sample: np.ndarray, depth: int) -> Node:
    """Tree of at most 2**depth shards over a sample; any fingerprint belongs to exactly one of them."""
    shards = iter(range(1 << depth))

    def node(own: np.ndarray, left: int) -> Node:
        if left == 0 or len(own) < 8:
            return Node(next(shards))
        point, radius = split(own)
        side = distance(own, point) <= radius
        if side.all():
            return Node(next(shards))
        return Node(-1, point, radius, node(own[side], left - 1), node(own[~side], left - 1))

    return node(sample, depth)


def route(tree: Node, fingerprints: np.ndarray, within: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, rows that live there, rows that ask there).

    Where two rows part, the near one asks on the far side if the triangle bound leaves a chance
    of a partner: d(x, v) > r - within. A row that asks goes on to every side the bound allows.
    """
    everyone, nobody = np.arange(len(fingerprints)), np.empty(0, np.int64)
    stack = [(tree, everyone, nobody)]
    while stack:
        node, home, asks = stack.pop()
        if not len(home) and not len(asks):
            continue
        if node.near is None:
            yield node.shard, home, asks
            continue
        d, e = distance(fingerprints[home], node.point), distance(fingerprints[asks], node.point)
        crossing = home[(d <= node.radius) & (d > node.radius - within)]
        stack.append((node.near, home[d <= node.radius], asks[e <= node.radius + within]))
        stack.append((node.far, home[d > node.radius], np.r_[asks[e > node.radius - within], crossing]))


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number reachable over the links, by repeated minima and pointer jumping."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        part = la != lb
        a, b, la, lb = a[part], b[part], la[part], lb[part]
        if not len(a):
            break
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
    return label


def link(fingerprints: np.ndarray, home: np.ndarray, asks: np.ndarray, within: int) -> np.ndarray:
    """Label of each row: the exact links among ``home`` and from ``asks`` to ``home``, closed transitively.

    ``fingerprints`` come in order, so a label is the row of the smallest linked fingerprint.
    """
    links: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    stack = [(home, asks)]
    while stack:
        own, other = stack.pop()
        if not len(own):
            continue
        points = fingerprints[own]
        cut = split(points) if len(own) > _LEAF else None
        d = distance(points, cut[0]) if cut else None
        if cut is None or (d <= cut[1]).all():
            for block in (x[i : i + 4096] for x in (own, other) for i in range(0, len(x), 4096)):
                for at in range(0, len(own), 512):
                    close = np.bitwise_count(fingerprints[block][:, None] ^ points[at : at + 512][None, :]) <= within
                    i, j = np.nonzero(close)
                    links.append((block[i], own[at + j]))
                    held += len(i)
            if held > 1 << 20:  # keep a forest only
                forest = labels(len(fingerprints), *(np.concatenate(x) for x in zip(*links, strict=True)))
                rows = np.flatnonzero(forest != np.arange(len(forest)))
                links, held = [(rows, forest[rows])], len(rows)
            continue
        point, radius = cut
        e = distance(fingerprints[other], point)
        crossing = own[(d <= radius) & (d > radius - within)]
        stack.append((own[d <= radius], other[e <= radius + within]))
        stack.append((own[d > radius], np.r_[other[e > radius - within], crossing]))
    if not links:
        return np.arange(len(fingerprints))
    return labels(len(fingerprints), *(np.concatenate(x) for x in zip(*links, strict=True)))


def _connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every linked node that is not itself the smallest of its component.

    Alternating large and small stars; each round is a written table, and rounds grow with the
    logarithm of the component size. Minima are aggregates, so a node with many neighbours is not
    gathered anywhere.
    """
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("m"))
        large = both.join(least, "node").where(F.col("root") > F.col("node")).select(F.col("root").alias("node"), F.col("m").alias("root"))
        large = large.where(F.col("node") != F.col("root")).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).where(F.col("node") != F.col("root"))
        edges = written(small.unionByName(least.select("node", F.col("m").alias("root"))).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now


def tree_depth(points: int, shard_size: int, least_shards: int) -> int:
    """Levels of the tree: shards of ``shard_size`` points, or ``least_shards`` of them where that leaves at least 4,096 in each."""
    levels = lambda size: int(np.ceil(np.log2(max(1, points) / size)))
    few = min(levels(min(4096, shard_size)), int(np.log2(least_shards)))
    return min(20, max(0, levels(shard_size), few))


def near_duplicates(
    articles: DataFrame, *, url: str = "url", content: str = "content", shingle: int = 3, within: int = 2, shard_size: int = 1 << 18, least_shards: int = 32
) -> DataFrame:
    """(url, fingerprint, component): articles linked by fingerprints that differ in ``within`` bits at most.

    ``fingerprint`` has 16 hexadecimal digits; ``component`` is the smallest url reachable over
    links. Equal fingerprints are one point. Points are dealt to the shards of a vantage-point tree;
    a point near a boundary also asks in the shards beyond it, so no link is lost, and only a
    spanning forest leaves a shard. As every level of the tree adds askers, shards are large, about
    ``shard_size`` points, but at least ``least_shards`` of 4,096 or more. The tree is grown on some
    32 points a shard, drawn by hash: one in 8,192 points, of at most 2^20 shards, which is enough for
    2.7e11 different fingerprints; beyond, the result is the same and shards grow.

    One row per input row; extra columns are left behind and an empty table gives no rows. Texts
    without words have fingerprint zero and link like any other; repeated rows are each returned; a
    null url is never the smallest, and a group of null urls has a null component.
    """
    rows = read_articles(articles, url, content)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "content"):
            values = np.array([fingerprint(t, shingle) for t in utf8(batch.column("content"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array(values.view(np.int64))], names=["url", "fp"])

    marked = written(rows.mapInArrow(hashed, arrow_schema(rows, ["url"], ("fp", T.LongType()))), "fingerprints")
    points = written(marked.groupBy("fp").agg(F.min("url").alias("least")), "points")
    n = points.count()
    depth = tree_depth(n, shard_size, least_shards)
    share = max(1, n // (32 << depth))
    sample = points.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(share)) == 0).select("fp").toArrow()["fp"].to_numpy() if depth else np.empty(0, np.int64)
    tree = articles.sparkSession.sparkContext.broadcast(grow(np.sort(sample.view(np.uint64)), depth))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            for shard, home, asks in route(tree.value, values, within):
                at = np.r_[home, asks]
                yield pa.RecordBatch.from_pydict({
                    "shard": np.full(len(at), shard, np.int32), "fp": values[at].view(np.int64), "home": np.arange(len(at)) < len(home),
                })

    def search(table: pa.Table) -> pa.Table:
        values = table["fp"].to_numpy().view(np.uint64)
        order = np.argsort(values)
        values, home = values[order], table["home"].to_numpy(zero_copy_only=False)[order]
        label = link(values, np.flatnonzero(home), np.flatnonzero(~home), within)
        rows = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"node": values[rows].view(np.int64), "root": values[label[rows]].view(np.int64)})

    dealt = points.select("fp").mapInArrow(deal, "shard int, fp long, home boolean")
    forest = written(dealt.groupBy("shard").applyInArrow(search, "node long, root long"), "links")
    if forest.isEmpty():
        named = points.select("fp", F.col("least").alias("component"))
    else:
        roots = _connected(forest)
        joined = points.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        smallest = joined.groupBy("root").agg(F.min("least").alias("component"))
        named = joined.join(smallest, "root").select("fp", "component")
    return marked.join(named, "fp").select("url", _hex(F.col("fp")).alias("fingerprint"), "component")


def _hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")

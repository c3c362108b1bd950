"""Collected news drawn so that their words are distributed like those of the research texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, read_articles, small_batches, written

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # words are letters a-z, digits and all beyond ASCII
_SUMS = 32  # tasks that add up the counts, and rows of counts the driver reads


class Words:
    """Words of a slice of texts, and the buckets of all runs of them."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")), pattern=_SEPARATORS)
        words, stops = pc.list_flatten(lists), lists.offsets.to_numpy()
        real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        self.stops = np.r_[0, np.cumsum(real)][stops - stops[0]]  # words of text i: stops[i] to stops[i + 1]
        coded = words.filter(pa.array(real)).dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.known = [w.encode() for w in coded.dictionary.to_pylist()]

    def runs(self, shortest: int, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length of run: (bucket of every run, places where the runs of the texts end).

        The code of a longer run is that of the run without its last word, paired with that word;
        only different pairs are hashed, continuing the CRC of the shorter run.
        """
        crc = [zlib.crc32(w) for w in self.known]
        code, stops, size = self.codes, self.stops, np.diff(self.stops)
        for n in range(1, longest + 1):
            if n > 1:
                # a run starts at each word of a text but the last n - 1
                first = np.repeat(self.stops[:-1] - np.r_[0, np.cumsum(np.maximum(size - n + 1, 0))][:-1], np.maximum(size - n + 1, 0))
                start = first + np.arange(len(first))
                held = np.maximum(size - n + 2, 0)  # runs of one word less, of each text
                shorter = np.repeat(np.r_[0, np.cumsum(held)][:-1] - self.stops[:-1], np.maximum(size - n + 1, 0)) + start
                last = self.codes[start + n - 1]
                pairs, code = np.unique(code[shorter] * len(self.known) + last, return_inverse=True)
                crc = [zlib.crc32(b" " + self.known[p % len(self.known)], crc[p // len(self.known)]) for p in pairs.tolist()]
                stops = np.r_[0, np.cumsum(np.maximum(size - n + 1, 0))]
            if n >= shortest:
                table = pa.array(np.array(crc, np.uint32).astype(np.int64) % buckets)
                yield table.take(pa.array(code)).to_numpy(), stops


def _sums(values: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring ``stops``; an empty stretch is 0."""
    full = np.diff(stops) > 0
    out = np.zeros(len(stops) - 1, np.int64)
    if full.any():
        out[full] = np.add.reduceat(values, stops[:-1][full])
    return out


def feature_counts(texts: DataFrame, *, content: str = "content", shortest: int = 1, longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all ``texts`` fall into each bucket.

    A task adds up one vector, ``_SUMS`` tasks add up those as they come, and the driver reads that
    many; each vector has ``buckets`` numbers, whatever the input. Null and empty texts have no
    feature; an empty table gives zeros.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in small_batches(batches, "content"):
            for found, _ in Words(batch.column("content")).runs(shortest, longest, buckets):
                total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for counts in batch.column("counts").to_pylist():
                total += np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    rows = texts.select(F.col(content).cast("string").alias("content"))
    schema = T.StructType([T.StructField("counts", T.BinaryType())])
    sums = rows.mapInArrow(count, schema).repartition(_SUMS).mapInArrow(add, schema).collect()
    return np.sum([np.frombuffer(r["counts"], np.int64) for r in sums], axis=0, dtype=np.int64) if sums else np.zeros(buckets, np.int64)


def bucket_gains(source: np.ndarray, target: np.ndarray, *, scale: int = 1000) -> np.ndarray:
    """``scale`` times the log of a bucket's share in the target over its share in the source, smoothed by one, rounded down."""
    s, t = source.astype(float), target.astype(float)
    n, all_s, all_t = len(s), s.sum(), t.sum()
    return np.floor(scale * np.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n)))).astype(np.int64)


def weigh_articles(
    articles: DataFrame, gains: np.ndarray, *, url: str = "url", content: str = "content", shortest: int = 1, longest: int = 1
) -> DataFrame:
    """(url, n_words, n_features, weight): the sum of the gains of an article's features. No shuffle, one row per row."""
    rows = read_articles(articles, url, content)
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(gains)
        for batch in small_batches(batches, "content"):
            words = Words(batch.column("content"))
            features, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for found, stops in words.runs(shortest, longest, buckets):
                features += np.diff(stops)
                weight += _sums(table.take(pa.array(found)).to_numpy(), stops)
            columns = [batch.column("url"), *(pa.array(x.astype(np.int64)) for x in (np.diff(words.stops), features, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["url", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, arrow_schema(rows, ["url"], *((n, T.LongType()) for n in ("n_words", "n_features", "weight"))))


def draw_articles(weighed: DataFrame, *, percent: int = 10, least_words: int = 20, seed: int = 2024, scale: int = 1000) -> DataFrame:
    """Adds ``score`` and ``rank``: a draw without replacement, in proportion to exp(weight / scale).

    Every article gets a Gumbel number from the SHA-256 of ``seed:url``; of those with at least
    ``least_words`` words, ``percent`` of a hundred with the highest sums are drawn, ties to the
    smaller url, null urls last, equal rows in any order. The rows are sorted by ranges, so no task
    or driver sees more than its range; a rank is the place in a range behind the sizes of those
    before it.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("url").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed.select("*", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("_row")), "weighed_articles")
    fit = F.col("n_words") >= least_words
    order = [F.desc("_fit"), F.desc("score"), F.asc_nulls_last("url"), F.asc("_row")]
    ranged = scored.withColumn("_fit", fit).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranked_articles")
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.where("_fit").groupBy(part.alias("_part")).count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"), F.sum("count").over(Window.partitionBy(F.lit(0))).alias("_all"))
    rank = F.col("_before") + local + 1
    joined = placed.withColumn("_part", part).join(F.broadcast(before), "_part", "left")  # one row a range
    drawn = F.when(F.col("_fit") & (rank <= F.floor(F.col("_all") * percent / F.lit(100))), rank)
    return joined.select(*weighed.columns, "score", drawn.alias("rank"))


def resample_articles(
    news: DataFrame, research: DataFrame, *, url: str = "url", content: str = "content", text: str = "text", shortest: int = 1, longest: int = 1,
    buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """(url, n_words, n_features, weight, score, rank) of every news article; ``rank`` is null where it is not drawn.

    ``news`` are the saved articles (``url``, ``content``), ``research`` the texts of research files
    (``text``) whose distribution is wanted. Features are the runs of ``shortest`` to ``longest``
    consecutive words, repeats counted, hashed into ``buckets``.

    Null and empty contents have no feature and weight 0; long ones are counted whole; equal rows
    weigh the same and are drawn each for itself; extra columns are left behind. Without news there
    are no rows; without research every bucket has the same share in the target.
    """
    size = {"shortest": shortest, "longest": longest}
    source = feature_counts(news, content=content, buckets=buckets, **size)
    target = feature_counts(research, content=text, buckets=buckets, **size)
    return draw_articles(weigh_articles(news, bucket_gains(source, target), url=url, content=content, **size), percent=percent, least_words=least_words, seed=seed)

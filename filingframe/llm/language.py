"""Language of an article by prediction by partial matching."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ppm
from .common import arrow_schema, read_articles, small_batches, utf8, written

UNDETERMINED = "und"
_PLACES = 16  # parts taken of a text that is too long


def letters(content: Column) -> Column:
    """Lower-case letters of a text, everything else one space; empty for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(content, F.lit(""))), r"[^\p{L}]+", " "))


@dataclass
class LanguageModel:
    """One frozen context tree per language, and the code lengths of frequent grams side by side as a cache."""

    order: int
    languages: list[str]
    trees: list[ppm.Contexts]
    known: ppm.Index
    lengths: np.ndarray

    def bits(self, keys: np.ndarray) -> np.ndarray:
        at = self.known.find(keys)
        out = self.lengths[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            out[new] = np.stack([t.bits(keys[new]) for t in self.trees], axis=1)
        return out


def _most_of_a_text(texts: DataFrame, training_bytes: int) -> dict[str, tuple[int, int]]:
    """Language: (bytes to take of a text at most, bytes all its texts then give).

    A 64th of ``training_bytes``, doubled until the texts of the language reach ``training_bytes``
    or are whole.
    """
    least = max(training_bytes // 64, 256)
    step = F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / F.lit(float(least))))).cast("int")  # doublings that leave a text whole
    found: dict[str, list[tuple[int, int, int]]] = {}
    for r in texts.groupBy("language", step.alias("step")).agg(F.count("*").alias("texts"), F.sum("size").alias("size")).collect():
        found.setdefault(r["language"], []).append((r["step"], r["texts"], r["size"]))
    out = {}
    for name, bins in found.items():
        for k in range(max(s for s, _, _ in bins) + 1):
            total = sum(size if s <= k else n * (least << k) for s, n, size in bins)
            if total >= training_bytes:
                break
        # the bytes given are concave in the most of a text, so this much less still reaches the bound
        out[name] = (-(-(least << k) * training_bytes // total) if k and total > training_bytes else least << k, total)
    return out


def _places(content: Column, rank: Column, most: Column) -> Column:
    """``content``, or of a text above ``most`` bytes about so many from hashed places, one in each of equal parts."""
    n = F.length(content)
    width = F.greatest(F.lit(1), F.floor(most * n / F.octet_length(content) / _PLACES)).cast("int")
    part = F.floor(n / _PLACES).cast("int")
    start = lambda i: F.lit(i) * part + F.pmod(F.xxhash64(rank, F.lit(i)), F.greatest(F.lit(1), part - width + 1)).cast("int") + 1
    parts = F.concat_ws(" ", *(F.substring(content, start(i), width) for i in range(_PLACES)))
    return F.when(F.octet_length(content) <= most, content).otherwise(parts)


def fit_language_model(
    articles: DataFrame, *, content: str = "content", language: str = "language", order: int = 4, training_bytes: int = 1 << 20, cache_cells: int = 1 << 24
) -> LanguageModel:
    """Context counts of each language, from about ``training_bytes`` of its different texts.

    Equal texts count once. Texts are taken in the order of a hash until they reach the bound, so
    the draw is the same in every run; a language with less text is used whole. Of a long text only
    ``_PLACES`` hashed parts are read: a 64th of the bound together, more where the language has too
    few texts for that. Rows with a null language or without a letter teach nothing. An empty table
    gives a model without languages.

    The model grows with the languages, by a tree of ``training_bytes`` each. The table of code
    lengths under all languages holds ``cache_cells`` numbers at most, those of the most frequent
    grams; others are looked up in the trees, with the same result.
    """
    rows = articles.select(F.col(content).cast("string").alias("content"), F.col(language).cast("string").alias("language"))
    rows = rows.where(F.col("language").isNotNull() & F.col("content").rlike(r"\p{L}"))
    rows = rows.withColumn("rank", F.shiftrightunsigned(F.xxhash64("content", F.lit("draw")), 1))
    texts = written(rows.groupBy("language", "rank").agg(F.max(F.octet_length("content")).cast("long").alias("size")), "text_sizes")
    most = _most_of_a_text(texts, training_bytes)
    languages = sorted(most)
    if not languages:
        return LanguageModel(order, [], [], ppm.Index(np.empty(0, np.uint64)), np.empty((0, 0)))
    of = lambda i: F.create_map(*(F.lit(x) for k in languages for x in (k, most[k][i])))[F.col("language")]
    # four times the bound is left to put in order; the most of a text is so small a part of it that this holds
    some = texts.where(F.col("rank") / float(1 << 63) < 4.0 * training_bytes / of(1)).withColumn("taken", F.least(F.col("size"), of(0)))
    before = F.sum("taken").over(Window.partitionBy("language").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    last = some.select("language", "rank", F.coalesce(before, F.lit(0)).alias("before")).where(F.col("before") < training_bytes)
    bounds = {r["language"]: r["last"] for r in last.groupBy("language").agg(F.max("rank").alias("last")).collect()}
    bound = F.create_map(*(F.lit(x) for k in languages for x in (k, bounds[k])))[F.col("language")]
    drawn = rows.where(F.col("rank") <= bound).select("language", "rank", _places(F.col("content"), F.col("rank"), of(0)).alias("content"))
    drawn = drawn.dropDuplicates(["language", "rank"]).select(letters(F.col("content")).alias("content"), "language")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "content"):
            names = np.array(batch.column("language").to_pylist(), object)
            texts = utf8(batch.column("content"))
            for name in sorted(set(names)):
                keys, counts = ppm.gram_counts([texts[i] for i in np.flatnonzero(names == name)], order)
                yield pa.RecordBatch.from_pydict({"language": pa.array([name] * len(keys), pa.string()), "gram": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

    counted = drawn.mapInArrow(count, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # bounded by training_bytes per language
    names, grams, counts = np.array(table["language"].to_pylist(), object), table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
    trees = []
    for name in languages:
        own = names == name
        keys, n = ppm.summed(grams[own], counts[own])
        trees.append(ppm.Contexts([ppm.lower_order(keys, n, j) for j in range(order)] + [(keys, n)], exclusion=False))
    known, times = ppm.summed(grams, counts)
    room = cache_cells // len(languages)
    if len(known) > room:
        known = np.sort(known[np.argsort(-times, kind="stable")[:room]])
    lengths = np.stack([t.bits(known) for t in trees], axis=1) if len(known) else np.empty((1, len(trees)))
    return LanguageModel(order, languages, trees, ppm.Index(known), lengths.astype(np.float32))


def identify_language(articles: DataFrame, model: LanguageModel, *, url: str = "url", content: str = "content", keep: Sequence[str] = ()) -> DataFrame:
    """(url, language, score, bits) and ``keep``: the language whose frozen tree codes the whole text shortest.

    ``score`` is the share of that language among the probabilities the trees give the text,
    ``bits`` its code length. One row per input row, in one pass and without a shuffle. Null, empty
    and letterless texts, and all texts under a model without languages, are ``und`` with score 0
    and no bits; of equally short codes the first language in alphabetical order is taken. Columns
    in ``keep`` come along, under names that are none of the result's; all others are left behind.
    """
    rows = read_articles(articles, url, content, **{k: F.col(k) for k in keep}).withColumn("content", letters(F.col("content")))
    model = articles.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in small_batches(batches, "content"):
            texts = utf8(batch.column("content"))
            none = np.array([not t or not m.languages for t in texts], bool)
            if m.languages:
                bits = ppm.text_bits(texts, m.order, m.bits)
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(texts)), best]
                score = 1 / np.exp2(least[:, None] - bits).sum(axis=1)
            else:
                best, least, score = (np.zeros(len(texts), t) for t in (int, float, float))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("url"),
                    pa.array([UNDETERMINED if x else m.languages[b] for x, b in zip(none, best, strict=True)], pa.string()),
                    pa.array(np.where(none, 0.0, score)),
                    pa.array(least, mask=none),
                    *(batch.column(k) for k in keep),
                ],
                names=["url", "language", "score", "bits", *keep],
            )

    kept = arrow_schema(rows, keep).fields
    return rows.mapInArrow(predict, arrow_schema(rows, ["url"], ("language", T.StringType()), ("score", T.DoubleType()), ("bits", T.DoubleType()), *((f.name, f.dataType) for f in kept)))

"""Language-model score of an article: byte contexts for the model, word counts for the base line."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ppm
from .common import arrow_schema, least_count, read_articles, small_batches, utf8, written

_FLUSH = 250_000  # entries a task holds before it hands its counts on


def words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.lower().split()


@dataclass
class ArticleModel:
    """Frozen statistics of the training articles.

    ``vocabulary`` (word, n) is a table, as it grows with the corpus; ``tokens`` and ``types`` are
    its totals, the end of an article being one more token. The words in ``frequent`` have a size
    bound. The context tree is whole: ``contexts`` holds its lowest orders as far as they keep a size
    bound, ``levels`` the orders above as tables (context, n, d, ruled_out, symbols), and ``codes``
    the exact code lengths of the most frequent pairs of the highest order (without ``levels``: none).
    """

    vocabulary: DataFrame
    tokens: int
    types: int
    ends: int
    rare_below: int
    frequent: dict[bytes, float]
    contexts: ppm.Contexts
    order: int
    levels: dict[int, DataFrame]
    codes: ppm.Codes | None

    def code_lengths(self, grams: DataFrame) -> DataFrame:
        """(gram, bits) of distinct pairs of the highest order, from the whole tree.

        Each order in ``levels`` is joined on the context, the longest first; what is still not seen
        escapes to ``contexts``. ``gone_n`` and ``gone_d`` are what the longer context rules out.
        """
        zero = F.lit(0).cast("long")
        state = grams.select("gram", F.lit(0.0).alias("bits"), zero.alias("gone_n"), zero.alias("gone_d"), F.lit(False).alias("seen"))
        for j in sorted(self.levels, reverse=True):
            context = F.shiftrightunsigned(F.col("gram").bitwiseAND(F.lit(_mask(j))), 8)
            joined = state.withColumn("context", context).join(self.levels[j], "context", "left")
            count = F.try_element_at("symbols", F.col("gram").bitwiseAND(F.lit(255)).cast("int"))
            rest = F.col("d") - F.col("gone_d")
            total = F.col("n") - F.col("gone_n") + rest
            cost = F.when(count.isNotNull(), F.log2(total / count)).when(rest > 0, F.log2(total / rest)).otherwise(0.0)
            state = joined.select(
                "gram", F.when(F.col("seen") | F.col("n").isNull(), F.col("bits")).otherwise(F.col("bits") + cost).alias("bits"),
                F.coalesce("ruled_out", "gone_n").alias("gone_n"), F.coalesce("d", "gone_d").alias("gone_d"), (F.col("seen") | count.isNotNull()).alias("seen"),
            )
        low = grams.sparkSession.sparkContext.broadcast(self.contexts)

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, gone_n, gone_d = (batch.column(c).to_numpy() for c in ("gram", "gone_n", "gone_d"))
                bits, left = batch.column("bits").to_numpy().copy(), ~batch.column("seen").to_numpy(zero_copy_only=False)
                bits[left] += low.value.escaped(keys[left].view(np.uint64), gone_n[left], gone_d[left])
                yield pa.RecordBatch.from_arrays([batch.column("gram"), pa.array(bits)], names=["gram", "bits"])

        return state.mapInArrow(finish, "gram long, bits double")


def _mask(order: int) -> int:
    """Bits of a context of ``order`` bytes and its symbol, as a signed integer of 64 bits."""
    return (1 << (8 * (order + 1))) - 1 if order < 7 else -1


def _level(grams: DataFrame, shorter: DataFrame, order: int) -> DataFrame:
    """(context, n, d, ruled_out, symbols) of one order; ``ruled_out`` counts its symbols in the next shorter context."""
    below = shorter.select(F.col("gram").alias("short"), F.col("n").alias("below"))
    pairs = grams.join(below, F.col("gram").bitwiseAND(F.lit(_mask(order - 1))) == F.col("short"))
    symbol = F.col("gram").bitwiseAND(F.lit(255)).cast("int")
    return pairs.groupBy(F.shiftrightunsigned("gram", 8).alias("context")).agg(
        F.sum("n").alias("n"), F.count("*").alias("d"), F.sum("below").alias("ruled_out"), F.map_from_entries(F.collect_list(F.struct(symbol, F.col("n")))).alias("symbols")
    )


def fit_article_model(
    articles: DataFrame, *, content: str = "content", order: int = 5, max_contexts: int = 1 << 20, max_words: int = 200_000
) -> ArticleModel:
    """Word counts and byte-context counts of all ``articles``.

    All texts are counted whole, in one pass; tasks add up their counts before the shuffle. Every
    (context, symbol) pair stays in the tree. ``max_contexts`` only bounds what is sent to the tasks:
    the lowest orders while each has at most so many pairs (order 0 always), and the code lengths of
    so many frequent pairs of the highest; the rest stays in tables that scores are joined with.
    Null texts are empty: they only count an end.
    """
    rows = articles.select(F.col(content).cast("string").alias("content"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def hand_on() -> Iterator[pa.RecordBatch]:
            names = pa.array([None] * len(keys) + list(seen), pa.binary())
            grams = pa.array(np.r_[keys.view(np.int64), np.zeros(len(seen), np.int64)])
            yield pa.RecordBatch.from_arrays([names, grams, pa.array(np.r_[counts, np.fromiter(seen.values(), np.int64, len(seen))])], names=["word", "gram", "n"])

        for batch in small_batches(batches, "content", 4 << 20):
            texts = [words(t) for t in utf8(batch.column("content"))]
            seen[b""] += len(texts)
            for t in texts:
                seen.update(t)
            k, c = ppm.gram_counts([b" ".join(t) for t in texts], order)
            keys, counts = ppm.summed(np.r_[keys, k], np.r_[counts, c])
            if len(seen) > _FLUSH or len(keys) > 4 * _FLUSH:
                yield from hand_on()
                seen.clear()
                keys, counts = keys[:0], counts[:0]
        yield from hand_on()

    counted = rows.mapInArrow(count, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))
    counted = written(counted, "article_model")
    vocabulary = counted.where(F.col("word").isNotNull() & (F.octet_length("word") > 0)).select("word", "n")
    total = counted.where(F.col("word").isNotNull()).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("types"),
        F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("n"))), F.lit(0)).alias("ends"),
    ).first()
    rare_below = least_count(vocabulary, max_words)
    table = vocabulary.where(F.col("n") >= rare_below).toArrow()
    frequent = {w: math.log10(n + 0.1) for w, n in zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True)}

    grams = {order: counted.where(F.col("word").isNull()).select("gram", "n")}
    for j in range(order - 1, -1, -1):
        upper = grams[j + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * (j + 1))) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        grams[j] = written(upper, "byte_contexts")
    low = []
    for j in range(order + 1):
        if j and grams[j].count() > max_contexts:
            break
        table = grams[j].toArrow()
        low.append(ppm.summed(table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()))
    levels = {j: written(_level(grams[j], grams[j - 1], j), "context_level") for j in range(len(low), order + 1)}
    codes = None
    if levels:
        pairs = levels[order].select("context", (F.col("n") + F.col("d")).alias("total"), F.explode("symbols").alias("symbol", "n"))
        pairs = pairs.where(F.col("n") >= least_count(grams[order], max_contexts))
        gram = F.shiftleft("context", 8).bitwiseOR(F.col("symbol").cast("long"))
        table = pairs.select(gram.alias("gram"), F.log2(F.col("total") / F.col("n")).alias("bits")).toArrow()
        codes = ppm.Codes(table["gram"].to_numpy().view(np.uint64), table["bits"].to_numpy())
    return ArticleModel(
        vocabulary, total["tokens"], total["types"] or 0, total["ends"], rare_below, frequent, ppm.Contexts(low), order, levels, codes
    )


def score_articles(articles: DataFrame, model: ArticleModel, *, url: str = "url", content: str = "content") -> DataFrame:
    """(url, n_tokens, n_known, base_score, score): log10 probabilities of each whole article.

    ``score`` is that of the byte-context model for the words of the article, joined by one space
    and ended by an end symbol; ``base_score`` that of add-0.1 word counts over the same tokens. The
    texts are read once. Words outside the size-bounded frequent list go through a join with the
    vocabulary table, after their occurrences in an article are added up, and so do byte contexts
    outside the size-bounded list with the tables of the tree; the articles' texts are never shuffled. One row per input row: null and empty texts are one end token.
    """
    rows = read_articles(articles, url, content)
    order, coded = model.order, model.codes is not None
    known = articles.sparkSession.sparkContext.broadcast((model.frequent, model.codes or model.contexts))
    end = math.log10(model.ends + 0.1) if model.ends else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, tree = known.value
        for batch in small_batches(batches, "content"):
            texts = [words(t) for t in utf8(batch.column("content"))]
            joined = [b" ".join(t) for t in texts]
            if coded:
                bits, text, keys, times = tree.text_bits(joined, order)
            else:
                bits = ppm.text_bits(joined, order, tree.bits)
                text, keys, times = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
            ends = np.searchsorted(text, np.arange(len(texts) + 1))
            grams = pa.StructArray.from_arrays([pa.array(keys.view(np.int64)), pa.array(times)], names=["gram", "tf"])
            n_known, logs, rare = [], [], []
            for t in texts:
                found = [x for x in map(frequent.get, t) if x is not None]
                n_known.append(len(found))
                logs.append(math.fsum(found))
                rare.append(list(Counter(w for w in t if w not in frequent).items()) if len(found) < len(t) else [])
            sizes = np.cumsum([0, *map(len, rare)])
            entries = pa.StructArray.from_arrays(
                [pa.array([w for r in rare for w, _ in r], pa.binary()), pa.array([n for r in rare for _, n in r], pa.int64())], names=["word", "tf"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("url"), pa.array([len(t) + 1 for t in texts], pa.int64()), pa.array(n_known, pa.int64()), pa.array(logs, pa.float64()),
                    pa.array(-bits * math.log10(2)), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), entries),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), grams),
                ],
                names=["url", "n_tokens", "n_frequent", "logs", "score", "rare", "grams"],
            )

    rare_type = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("tf", T.LongType())]))
    grams_type = T.ArrayType(T.StructType([T.StructField("gram", T.LongType()), T.StructField("tf", T.LongType())]))
    fields = [("n_tokens", T.LongType()), ("n_frequent", T.LongType()), ("logs", T.DoubleType()), ("score", T.DoubleType()), ("rare", rare_type), ("grams", grams_type)]
    once = rows.mapInArrow(score, arrow_schema(rows, ["url"], *fields)).withColumn("row", F.monotonically_increasing_id())
    once = written(once, "article_scores")
    rare = once.where(F.size("rare") > 0).select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf")
    counts = model.vocabulary.where(F.col("n") < model.rare_below)
    found = rare.join(counts, "word").groupBy("row").agg(
        F.sum("tf").alias("tf"), F.sum(F.col("tf") * F.log10(F.col("n") + 0.1)).alias("logs_rare")
    )
    denominator = math.log10(model.tokens + 0.1 * (model.types + 1))
    unknown = F.col("n_tokens") - F.col("n_known")
    n_known: Column = F.col("n_frequent") + F.coalesce("tf", F.lit(0)) + (1 if model.ends else 0)
    out = once.drop("rare", "grams").join(found, "row", "left").withColumn("n_known", n_known)
    score_column = F.col("score")
    if model.levels:
        lacking = once.where(F.size("grams") > 0).select("row", F.explode("grams").alias("g")).select("row", "g.gram", "g.tf")
        lengths = written(model.code_lengths(lacking.select("gram").distinct()), "code_lengths")
        out = out.join(lacking.join(lengths, "gram").groupBy("row").agg(F.sum(F.col("tf") * F.col("bits")).alias("bits")), "row", "left")
        score_column = score_column - F.coalesce("bits", F.lit(0.0)) * math.log10(2)
    base = F.col("logs") + F.coalesce("logs_rare", F.lit(0.0)) + (end or 0.0) - unknown - F.col("n_tokens") * denominator
    return out.select("url", "n_tokens", "n_known", base.alias("base_score"), score_column.alias("score"))

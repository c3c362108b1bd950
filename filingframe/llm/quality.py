"""Quality of an article: random Fourier features of text statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, read_articles, small_batches, utf8

_FOLDS = 4
_RIDGES = (1e-3, 1e-2, 1e-1, 1.0)  # per row
_BINS = 2000  # of raw scores between -0.5 and 1.5


def _classes() -> np.ndarray:
    """Kind of each byte, one column a kind."""
    kinds = [
        lambda c: c.islower(), lambda c: c.isupper(), lambda c: c.isdigit(), lambda c: c == "\n", lambda c: c in " \t\r", lambda c: c in ".,;:?'\"-()",
        lambda c: c == "!", lambda c: c in "#$%&*@^~", lambda c: c in "|<>{}[]=+/\\_`", lambda c: ord(c) < 32 and not c.isspace(), lambda c: ord(c) > 126,
    ]
    return np.array([[bool(k(chr(i))) and (i < 127 or n == len(kinds) - 1) for n, k in enumerate(kinds)] for i in range(256)], float)


_KINDS = _classes()


def statistics(text: bytes) -> list[float]:
    """Figures of one text: shares of character kinds, word and line shapes, repetition. No words give zeros."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    p = counts[counts > 0] / n
    words = text.lower().split()
    n_words = max(1, len(words))
    seen = Counter(words)
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2)
    lines = [x for x in text.split(b"\n") if x.strip()]
    sentences = [x.strip() for x in text.split(b".") if len(x) > 8]
    ends = Counter(w[-1:] for w in words)
    marked = sum(v for c, v in ends.items() if not (c.isalnum() or c >= b"\x80"))
    sizes = [len(w) for w in words]
    mean = sum(sizes) / n_words
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(lines)), *(counts @ _KINDS / n).tolist(), float(-(p * np.log2(p)).sum()),
        mean, math.sqrt(max(0.0, sum(s * s for s in sizes) / n_words - mean * mean)), max(sizes, default=0) ** 0.5, sum(s <= 3 for s in sizes) / n_words,
        len(seen) / n_words, sum(v for _, v in seen.most_common(3)) / n_words, triples, len(set(lines)) / max(1, len(lines)),
        len(set(sentences)) / max(1, len(sentences)), marked / n_words, len(ends) / math.sqrt(n_words), text.count(b"http") / n_words,
    ]


def article_statistics(articles: DataFrame, *, url: str = "url", content: str = "content") -> DataFrame:
    """(url, statistics): one row per input row, the whole text read, no shuffle; null is the empty text."""
    rows = read_articles(articles, url, content)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "content"):
            values = [statistics(t) for t in utf8(batch.column("content"))]
            yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array(values, pa.list_(pa.float64()))], names=["url", "statistics"])

    return rows.mapInArrow(measure, arrow_schema(rows, ["url"], ("statistics", T.ArrayType(T.DoubleType()))))


@dataclass
class QualityModel:
    """Scaling, random features, ridge weights and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    calibrated: np.ndarray

    def features(self, statistics: np.ndarray) -> np.ndarray:
        x = np.clip((statistics - self.mean) / self.scale, -5, 5)
        z = np.cos(x @ self.frequencies + self.phases) * math.sqrt(2 / len(self.phases))
        return np.concatenate([z, x, np.ones((len(x), 1))], axis=1)

    def score(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(statistics) @ self.weights, self.raw, self.calibrated), 0.0, 1.0)


def matrix(column: pa.Array) -> np.ndarray:
    width = len(statistics(b""))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def isotonic(positives: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing means of neighbouring bins (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for p, n in zip(positives, counts, strict=True):
        blocks.append([p, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), p / n) for p, n, k in blocks]) if blocks else np.empty(0)


def fit_quality_model(labelled: DataFrame, *, features: int = 256, bandwidth: float = 1.0, seed: int = 7) -> QualityModel:
    """Model of ``label`` (0 or 1) given ``statistics``; rows with another label or null are left out.

    The Gaussian kernel on standardised statistics is approximated by random cosines. Every task
    adds up its own part of the normal equations, by four folds; the sums, of a size that depends
    on ``features`` only, are solved for several ridges, and the one with the least error on left-out
    folds is taken. The calibration curve is fitted to the scores of left-out folds. All labelled
    rows count. Without rows of both labels every score is the mean label, or 0.5 without rows.
    """
    rows = labelled.where(F.col("label").isin(0, 1)).select("statistics", F.col("label").cast("double").alias("label"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("statistics"), F.lit(_FOLDS)).cast("int"))
    width = len(statistics(b""))
    moments = rows.agg(*(f(F.col("statistics")[i]) for f in (F.avg, F.stddev_pop) for i in range(width)), F.avg("label"), F.count("*")).first()
    mean, scale = (np.array([x or 0.0 for x in moments[i * width : (i + 1) * width]]) for i in range(2))
    rng = np.random.default_rng(seed)
    frequencies = rng.normal(0, bandwidth / math.sqrt(width), (width, features))
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), frequencies, rng.uniform(0, 2 * math.pi, features), np.zeros(features + width + 1), np.zeros(1), np.full(1, moments[-2] if moments[-1] else 0.5))
    if not moments[-1] or moments[-2] in (0.0, 1.0):
        return model
    size = features + width + 2  # features, a constant and the label
    upper = np.triu_indices(size)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((_FOLDS, size, size))
        for batch in batches:
            z = np.c_[model.features(matrix(batch.column("statistics"))), batch.column("label").to_numpy()]
            fold = batch.column("fold").to_numpy()
            for k in range(_FOLDS):
                sums[k] += z[fold == k].T @ z[fold == k]
        for k in range(_FOLDS):
            yield pa.RecordBatch.from_pydict({"fold": np.full(len(upper[0]), k, np.int32), "at": np.arange(len(upper[0]), dtype=np.int32), "value": sums[k][upper]})

    table = rows.mapInArrow(equations, "fold int, at int, value double").groupBy("fold", "at").agg(F.sum("value").alias("value")).toArrow()
    sums = np.zeros((_FOLDS, size, size))
    at = table["at"].to_numpy()
    sums[table["fold"].to_numpy(), upper[0][at], upper[1][at]] = table["value"].to_numpy()
    sums = sums + np.transpose(sums, (0, 2, 1)) - np.stack([np.diag(np.diag(s)) for s in sums])
    whole, m = sums.sum(axis=0), size - 1

    def solve(a: np.ndarray, ridge: float) -> np.ndarray:
        penalty = np.full(m, ridge * a[m - 1, m - 1] / m)
        penalty[-1] = 1e-9  # the constant
        return np.linalg.solve(a[:m, :m] + np.diag(penalty), a[:m, m])

    def error(w: np.ndarray, a: np.ndarray) -> float:
        return float(a[m, m] - 2 * w @ a[:m, m] + w @ a[:m, :m] @ w)

    trials = {r: [solve(whole - s, r) for s in sums] for r in _RIDGES}
    ridge = min(_RIDGES, key=lambda r: sum(error(w, s) for w, s in zip(trials[r], sums, strict=True)))
    without = np.stack(trials[ridge])
    model.weights = solve(whole, ridge)

    def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, fold = model.features(matrix(batch.column("statistics"))), batch.column("fold").to_numpy()
            raw = (z * without[fold]).sum(axis=1)
            where = np.clip((raw + 0.5) / 2 * _BINS, 0, _BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"bin": where, "raw": raw, "label": batch.column("label").to_numpy()})

    bins = rows.mapInArrow(curve, "bin int, raw double, label double").groupBy("bin").agg(F.sum("label"), F.count("*"), F.avg("raw")).orderBy("bin").collect()
    positives, counts, raw = (np.array([b[i] for b in bins], float) for i in (1, 2, 3))
    level = isotonic(positives, counts)
    # one knot in the middle of each level, so that the curve rises between levels
    starts = np.flatnonzero(np.r_[True, level[1:] != level[:-1]])
    n = np.add.reduceat(counts, starts)
    model.raw = np.add.reduceat(raw * counts, starts) / n
    model.calibrated = (np.add.reduceat(positives, starts) + moments[-2]) / (n + 1)
    model.calibrated = np.maximum.accumulate(model.calibrated)
    return model


def score_quality(measured: DataFrame, model: QualityModel) -> DataFrame:
    """(url, score): probability of label 1 for each row of ``article_statistics``."""
    model = measured.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array(model.value.score(matrix(batch.column("statistics"))))], names=["url", "score"])

    return measured.mapInArrow(score, arrow_schema(measured, ["url"], ("score", T.DoubleType())))

"""The draw against a plain computation."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from filingframe.llm import resampling

from . import samples


def features(text, shortest, longest):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return words, [" ".join(words[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]


def plainly(news, research, shortest, longest, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    of = [(url, *features(text, shortest, longest)) for url, text in news]
    s = Counter(bucket(f) for _, _, fs in of for f in fs)
    t = Counter(bucket(f) for text in research for f in features(text, shortest, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    rows = []
    for url, words, fs in of:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if url is None else url}".encode()).hexdigest()[:8], 16)
        rows.append([url, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = i + 1
    return rows


@pytest.mark.parametrize("shortest,longest,buckets,percent", [(1, 1, 10_000, 10), (1, 3, 97, 50), (2, 2, 1000, 100), (3, 4, 50, 30)])
def test_draw(spark, shortest, longest, buckets, percent):
    articles = samples.articles(spark)
    research = spark.createDataFrame([(t,) for t, _ in samples.contents(15, seed=9)], "text string")
    got = resampling.resample_articles(articles, research, shortest=shortest, longest=longest, buckets=buckets, percent=percent)
    want = plainly([(r["url"], r["content"]) for r in articles.collect()], [r["text"] for r in research.collect()], shortest, longest, buckets, percent, 20)
    assert sorted(map(repr, ([*r] for r in got.collect()))) == sorted(map(repr, want))


def test_equal_rows_and_empty_tables(spark):
    """A third of the rows are one row; each is drawn for itself, and ranks have no gaps."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text)] * 40 + [(i, text + f" x{i}") for i in range(80)]
    news = spark.createDataFrame(rows, "url long, content string").repartition(5)
    none = spark.createDataFrame([], "text string")
    got = resampling.resample_articles(news, none, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 61))
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [(-r["score"], r["url"]) for r in ranked] == sorted((-r["score"], r["url"]) for r in got)[:60]
    empty = resampling.resample_articles(samples.no_articles(spark), none)
    assert empty.count() == 0 and empty.columns == ["url", "n_words", "n_features", "weight", "score", "rank"]

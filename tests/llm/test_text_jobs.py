"""Language, quality and language-model scores."""

import math
import pickle
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingframe.llm import language, quality, scoring

from . import samples


def test_language(spark):
    articles = samples.articles(spark)
    model = language.fit_language_model(articles)
    assert model.languages == ["de", "en"]
    rows = language.identify_language(articles, model).collect()
    assert len(rows) == articles.count()
    got = {r["url"]: r for r in rows if r["url"] is not None}
    for i, (content, lang) in enumerate(samples.contents()):
        if not content or not any(c.isalpha() for c in content):
            assert (got[i]["language"], got[i]["score"], got[i]["bits"]) == ("und", 0.0, None)
        elif i < 60:
            assert got[i]["language"] == lang
            assert 0.5 < got[i]["score"] <= 1
    assert got[3]["bits"] == got[7]["bits"] == got[11]["bits"]


def test_language_of_unseen_articles(spark):
    rng = random.Random(9)
    new = spark.createDataFrame([(i, samples.text(rng, lang, 30), lang) for i, lang in enumerate(["de", "en"] * 20)], "url int, content string, lang string")
    found = language.identify_language(new, language.fit_language_model(samples.articles(spark))).join(new, "url")
    assert found.where(F.col("language") == F.col("lang")).count() == 40


def test_language_without_articles_or_labels(spark):
    none = language.fit_language_model(samples.no_articles(spark))
    assert {r["language"] for r in language.identify_language(samples.articles(spark), none).collect()} == {"und"}
    some = language.fit_language_model(samples.articles(spark))
    assert language.identify_language(samples.no_articles(spark), some).count() == 0


@pytest.mark.parametrize("cache_cells", [0, 300, 1 << 14])
def test_language_without_the_cache_is_the_same(spark, cache_cells):
    articles = samples.articles(spark)
    rows = lambda m: sorted(map(repr, language.identify_language(articles, m, keep=["label", "digest"]).collect()))
    small = language.fit_language_model(articles, cache_cells=cache_cells)
    assert small.lengths.size <= max(2, cache_cells)
    assert rows(small) == rows(language.fit_language_model(articles))


def test_two_hundred_languages(spark):
    """The cache stays in its bound; every language is told by its own syllables."""
    rng = random.Random(8)
    alphabet = [chr(c) for c in range(0x61, 0x7B)]
    syllables = {f"l{i:03d}": ["".join(rng.choices(alphabet, k=3)) for _ in range(12)] for i in range(200)}
    text = lambda k, n: " ".join("".join(rng.choices(syllables[k], k=rng.randint(1, 3))) for _ in range(n))
    taught = spark.createDataFrame([(text(k, 60), k) for k in syllables for _ in range(3)], "content string, language string")
    model = language.fit_language_model(taught, training_bytes=2_000, cache_cells=1 << 18)
    assert len(model.languages) == 200 and model.lengths.size <= 1 << 18
    assert len(pickle.dumps(model)) < 60 << 20
    asked = spark.createDataFrame([(k, text(k, 25)) for k in syllables], "url string, content string")
    found = language.identify_language(asked, model).collect()
    assert sum(r["url"] == r["language"] for r in found) > 190


def test_language_draws_about_the_stated_amount(spark):
    rng = random.Random(4)
    many = spark.createDataFrame([(samples.text(rng, words=50), "en") for _ in range(400)], "content string, language string")
    model = language.fit_language_model(many, training_bytes=20_000)
    assert 5_000 < model.trees[0].n[0].sum() < 45_000


def test_language_draws_from_few_long_and_from_copied_texts(spark):
    rng = random.Random(3)
    rows = [(samples.text(rng, "en", 20_000), f"long{i}") for i in range(8) for _ in range(3)]
    rows += [(samples.text(rng, words=500), "copied")] * 200 + [(samples.text(rng, words=150), "copied") for _ in range(40)]
    rows += [(samples.text(rng, words=50), "short"), (samples.text(rng, words=50), "short")]
    model = language.fit_language_model(spark.createDataFrame(rows, "content string, language string"), training_bytes=20_000)
    read = {k: int(t.n[0].sum()) for k, t in zip(model.languages, model.trees, strict=True)}
    assert all(15_000 < n < 25_000 for k, n in read.items() if k != "short")
    assert read["short"] == sum(len(re.sub("[^a-z]+", " ", c.lower()).strip()) + 1 for c, k in rows if k == "short")


def _quality_articles(spark, n=400):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        good = i % 3 > 0
        content = samples.text(rng, words=rng.randint(20, 90))
        if not good:
            content = re.sub(r" ", "$$$ ", content.upper()) if i % 2 else (content[:40] + " | ") * 12
        rows.append((i, content, int(good)))
    return spark.createDataFrame(rows, "url long, content string, label int")


def test_quality_separates_left_out_articles(spark):
    measured = quality.article_statistics(_quality_articles(spark)).join(_quality_articles(spark), "url").select("url", "statistics", "label")
    model = quality.fit_quality_model(measured.where("url % 4 <> 2"))
    rows = quality.score_quality(measured, model).join(measured, "url").where("url % 4 = 2").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([(r["score"] >= 0.7) == r["label"] for r in rows]) > 0.97


def test_quality_equations_match_one_machine(spark):
    measured = quality.article_statistics(_quality_articles(spark, 120)).join(_quality_articles(spark, 120), "url").select("statistics", "label").toPandas()
    model = quality.fit_quality_model(spark.createDataFrame(measured, "statistics array<double>, label int"), features=16)
    x, y = np.stack(measured.statistics), measured.label.to_numpy(float)
    assert model.mean == pytest.approx(x.mean(axis=0))
    z = model.features(x)
    errors = []
    for ridge in quality._RIDGES:
        penalty = np.full(z.shape[1], ridge * len(z) / z.shape[1])
        penalty[-1] = 1e-9
        errors.append(np.abs(np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y) - model.weights).max())
    assert min(errors) < 1e-6


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 9, 40).astype(float)
    p = np.floor(n * rng.random(40))
    fit = quality.isotonic(p, n)
    assert (np.diff(fit) >= -1e-12).all()
    for i in range(40):  # min-max formula
        assert fit[i] == pytest.approx(max(min(p[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 40)) for a in range(i + 1)))


def test_quality_of_odd_articles(spark):
    articles = samples.articles(spark)
    measured = quality.article_statistics(articles)
    assert measured.count() == articles.count()
    labels = articles.where("url is not null").select("url", "label").distinct()
    model = quality.fit_quality_model(measured.join(labels, "url"))
    scores = quality.score_quality(measured, model).collect()
    assert len(scores) == articles.count() and all(0 <= r["score"] <= 1 for r in scores)
    one = quality.fit_quality_model(measured.select("statistics", F.lit(1).alias("label")))
    assert {r["score"] for r in quality.score_quality(measured, one).collect()} == {1.0}
    none = quality.fit_quality_model(measured.limit(0).select("statistics", F.lit(None).cast("int").alias("label")))
    assert {r["score"] for r in quality.score_quality(measured, none).collect()} == {0.5}
    assert quality.score_quality(quality.article_statistics(samples.no_articles(spark)), model).count() == 0


def _tokens(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + [None]


@pytest.mark.parametrize("max_words", [5, 200_000])
def test_base_line_is_the_word_model(spark, max_words):
    articles = samples.articles(spark)
    train = articles.where("url % 3 <> 0")
    model = scoring.fit_article_model(train, max_words=max_words)
    count = Counter(t for r in train.collect() for t in _tokens(r["content"]))
    assert (model.tokens, model.types) == (sum(count.values()), len(count))
    rows = scoring.score_articles(articles, model).collect()
    assert len(rows) == articles.count()
    texts = {i: c for i, (c, _) in enumerate(samples.contents())}
    for r in rows:
        if r["url"] is None:
            continue
        tokens = _tokens(texts[r["url"]])
        assert (r["n_tokens"], r["n_known"]) == (len(tokens), sum(t in count for t in tokens))
        want = sum(math.log10((count[t] + 0.1) / (model.tokens + 0.1 * (model.types + 1))) for t in tokens)
        assert r["base_score"] == pytest.approx(want, abs=1e-6)
        assert r["score"] < 0


def test_scores_prefer_what_the_model_has_read(spark):
    rng = random.Random(8)
    own = spark.createDataFrame([(i, samples.text(rng, "en", 60)) for i in range(60)], "url long, content string")
    model = scoring.fit_article_model(own)
    new = spark.createDataFrame([(i, samples.text(rng, ("en", "de")[i % 2], 60)) for i in range(20)], "url long, content string")
    rate = {r["url"]: r["score"] / r["n_tokens"] for r in scoring.score_articles(new, model).collect()}
    assert min(v for k, v in rate.items() if k % 2 == 0) > max(v for k, v in rate.items() if k % 2)


def test_bounded_contexts_stay_a_distribution(spark):
    model = scoring.fit_article_model(samples.articles(spark), order=3, max_contexts=50)
    assert all(len(g.keys) <= 50 for g in model.contexts.grams)
    base = int.from_bytes(b"the", "big") << 8
    assert np.exp2(-model.contexts.bits(np.array([base + s for s in range(255)], np.uint64))).sum() == pytest.approx(1)


@pytest.mark.parametrize("max_contexts", [50, 300, 1000])
def test_scores_come_from_the_whole_tree(spark, max_contexts):
    articles = samples.articles(spark)
    train = articles.where("url % 3 <> 0")
    whole, bounded = (scoring.score_articles(articles, scoring.fit_article_model(train, max_contexts=n)) for n in (1 << 20, max_contexts))
    want, got = ({(r["url"], r["n_tokens"]): r["score"] for r in x.collect()} for x in (whole, bounded))
    assert want.keys() == got.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9)


def test_scores_without_training_or_articles(spark):
    none = scoring.fit_article_model(samples.no_articles(spark))
    rows = scoring.score_articles(samples.articles(spark), none).collect()
    assert all(r["n_known"] == 0 and r["base_score"] == pytest.approx(0) and r["score"] < 0 for r in rows)
    some = scoring.fit_article_model(samples.articles(spark))
    assert scoring.score_articles(samples.no_articles(spark), some).count() == 0

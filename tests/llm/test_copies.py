"""Near-duplicates, fingerprints and benchmark passages against plain readings of their definitions."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from filingframe.llm import decontaminate, fingerprints, neardup

from . import samples


def plain_fingerprint(text, shingle=3):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, within):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= within) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            parent[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprints_follow_the_definition():
    for content, _ in samples.contents():
        assert neardup.fingerprint((content or "").encode()) == plain_fingerprint(content)


def _clustered(rng, singles=1500, chains=60, steps=12):
    """Fingerprints with chains of neighbours one or two bits apart."""
    values = [rng.integers(0, 2**63, singles, dtype=np.int64).astype(np.uint64)]
    at = values[0][:chains]
    for k in range(steps):
        at = at ^ (np.uint64(1) << rng.integers(0, 64, chains).astype(np.uint64))
        if k % 2:
            at = at ^ (np.uint64(1) << rng.integers(0, 64, chains).astype(np.uint64))
        values.append(at)
    return np.unique(np.concatenate(values))


@pytest.mark.parametrize("within", [0, 2, 3])
def test_tree_loses_no_link(within):
    values = _clustered(np.random.default_rng(1))
    want = components(values, within)
    assert neardup.link(values, np.arange(len(values)), np.empty(0, np.int64), within).tolist() == want
    tree = neardup.grow(np.sort(np.random.default_rng(2).choice(values, 512)), 5)
    a, b, homes = [], [], np.zeros(len(values), int)
    for _, home, asks in neardup.route(tree, values, within):
        homes[home] += 1
        at = np.r_[home, asks]
        order = np.argsort(values[at])
        own = neardup.link(values[at[order]], np.flatnonzero(order < len(home)), np.flatnonzero(order >= len(home)), within)
        a += at[order].tolist()
        b += at[order][own].tolist()
    assert (homes == 1).all()
    assert neardup.labels(len(values), np.array(a), np.array(b)).tolist() == want


@pytest.mark.parametrize("points,most", [(10**8, 11), (10**9, 27)])
def test_points_are_dealt_a_few_times(points, most):
    """Rows dealt per point at the depth of so many points, for fingerprints without any order."""
    rng = np.random.default_rng(points % 97)
    depth = neardup.tree_depth(points, 1 << 18, 32)
    tree = neardup.grow(np.sort(rng.integers(0, 2**63, 32 << depth, dtype=np.uint64) * np.uint64(2)), depth)
    asked = rng.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2)
    dealt = sum(len(home) + len(asks) for _, home, asks in neardup.route(tree, asked, 2))
    assert depth >= np.log2(points / 2**18) and dealt < most * len(asked)


@pytest.mark.parametrize("points,depth", [(0, 0), (1, 0), (4096, 0), (4097, 1), (10**5, 5), (10**6, 5), (10**8, 9), (10**12, 20)])
def test_depth_of_the_tree(points, depth):
    assert neardup.tree_depth(points, 1 << 18, 32) == depth


def test_a_full_ball_is_linked_without_all_pairs():
    center = np.uint64(0x0123456789ABCDEF)
    ball = np.unique(np.array([center] + [center ^ np.uint64((1 << i) | (1 << j)) for i in range(64) for j in range(i + 1)], np.uint64))
    assert (neardup.link(ball, np.arange(len(ball)), np.empty(0, np.int64), 2) == 0).all()


def test_long_chain_becomes_one_component(spark):
    order = list(range(300))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(max(order[i], order[i + 1]), min(order[i], order[i + 1])) for i in range(299)] + [(1001, 1000)], "node long, root long")
    got = {(r["node"], r["root"]) for r in neardup._connected(edges).collect()}
    assert got == {(i, 0) for i in range(1, 300)} | {(1001, 1000)}


@pytest.mark.parametrize("shard_size", [8, 4096])
def test_near_duplicates(spark, shard_size):
    rng = random.Random(6)
    articles = samples.articles(spark)
    long_text = samples.text(rng, words=900)
    copies = [(1000 + i, long_text[:-1] + f" end{i}.") for i in range(20)]
    articles = articles.select("url", "content").unionByName(spark.createDataFrame(copies, "url long, content string"))
    rows = articles.collect()
    values = np.array([plain_fingerprint(r["content"]) for r in rows], np.uint64)
    root = components(values, 2)
    least = {}
    for r, c in zip(rows, root, strict=True):
        if r["url"] is not None:
            least[c] = min(least.get(c, r["url"]), r["url"])
    want = sorted(((str(r["url"]), f"{int(v):016x}", least.get(c)) for r, v, c in zip(rows, values, root, strict=True)), key=repr)
    got = neardup.near_duplicates(articles, shard_size=shard_size).collect()
    assert sorted(((str(r["url"]), r["fingerprint"], r["component"]) for r in got), key=repr) == want
    assert len(set(root)) < len(set(values.tolist()))


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(samples.no_articles(spark)).count() == 0


# benchmark passages

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(text, items, window=13):
    words, hit, found = plain_words(text), set(), set()
    for item, content in items:
        own = plain_words(content)
        for piece in {tuple(own[i : i + window]) for i in range(max(1, len(own) - window + 1))} if own else ():
            for i in range(len(words) - len(piece) + 1):
                if tuple(words[i : i + len(piece)]) == piece:
                    hit.update(range(i, i + len(piece)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(words)


def test_contamination(spark):
    rng = random.Random(7)
    passages = [samples.text(rng, words=n) for n in (40, 25, 13, 12, 5, 4, 2, 1)]
    items = [(i, p) for i, p in enumerate(passages)] + [(20, passages[0]), (21, "Éa ΑΣ'Β straße Öl " * 5), (22, None), (23, ""), (24, "--- !!"), (25, "the the the the the the the the the the the the the the")]
    texts = [
        passages[0], samples.text(rng) + " " + passages[1].upper() + "! " + samples.text(rng), passages[0][: len(passages[0]) // 2], "x " * 400 + passages[2], passages[3] + " " + passages[4],
        passages[6] + ", " + passages[7], re.sub(" ", " -- ", passages[0]), "éa ασ'β STRASSE öl " * 5, "ÉA ΑΣ'Β straße öL " * 5, "the " * 30, passages[0] + passages[0], None, "", "?!", samples.text(rng, words=3000),
        " ".join(passages), passages[2].replace(" ", "_"), "a" + passages[2],
    ]
    articles = spark.createDataFrame([(i, t, 1, "s", "x") for i, t in enumerate(texts)] + [(0, texts[0], 1, "s", "x"), (0, "another text", 1, "s", "x"), (None, passages[1], 1, "s", "x")], "url long, content string, shingle int, size string, words string")
    table = spark.createDataFrame([(str(i), t, "w") for i, t in items], "item string, content string, window string")
    want = sorted(((str(r["url"]), *plain_contamination(r["content"], items)) for r in articles.collect()), key=repr)
    got = decontaminate.find_contamination(articles, table).collect()
    assert sorted(((str(r["url"]), r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got), key=repr) == want
    assert sum(w[4] for w in want) > 8


def test_contamination_without_items_or_articles(spark):
    items = spark.createDataFrame([], "item string, content string")
    articles = samples.articles(spark)
    rows = decontaminate.find_contamination(articles, items).collect()
    assert len(rows) == articles.count() and not any(r["contaminated"] or r["n_hit"] or r["items"] for r in rows)
    some = spark.createDataFrame([("1", "a b c")], "item string, content string")
    assert decontaminate.find_contamination(samples.no_articles(spark), some).count() == 0


# I-Match

def test_following_is_the_sorted_order(spark):
    rng = random.Random(1)
    numbers = sorted({rng.choice([rng.randint(0, 5000), rng.randint(0, 1 << 40), -rng.randint(0, 1 << 50), (1 << 62) + i]) for i in range(800)})
    df = spark.createDataFrame([(n, f"t{n}") for n in numbers], "url long, content string")
    got = {r["url"]: r["next_content"] for r in fingerprints.following(df, "url", "content").collect()}
    assert got == {n: f"t{m}" for n, m in zip(numbers, [*numbers[1:], numbers[0]], strict=True)}


def test_following_replaces_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(2, "b", 9, 9, "x", "y"), (1, "a", 9, 9, "x", "y")], "url long, content string, _n int, _rank int, next_content string, _head_content string")
    got = fingerprints.following(df, "url", "content")
    assert sorted(got.columns) == ["_node", "content", "next_content", "url"]
    assert {r["url"]: r["next_content"] for r in got.collect()} == {1: "b", 2: "a"}


def test_revised_text(spark):
    rows = [("abcdefgh", "12345"), ("abcdefgh", "1"), ("abc", "123"), ("", "x"), ("😀é日本abcd", "ßäö")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", fingerprints.revised(F.col("a"), F.col("b")).alias("r"))
    assert [r["r"] for r in df.collect()] == [a[: len(a) - len(a) // 4] + b[: len(a) // 4] for a, b in rows]


def test_lexicon_is_the_band(spark):
    articles = samples.articles(spark)
    got = {r["term"] for r in fingerprints.fit_lexicon(articles, low=0.05, high=0.3).collect()}
    texts = [r["content"] or "" for r in articles.collect()]
    sets = [set(w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower()) if w) for t in texts]
    words = {w for s in sets for w in s}
    band = [w for w in words if 0.05 * len(texts) < sum(w in s for s in sets) <= 0.3 * len(texts)]
    want = {r[0] for r in spark.createDataFrame([(w,) for w in band], "w string").select(F.xxhash64("w")).collect()}
    assert got == want


@pytest.mark.parametrize("cache_terms", [0, 3, 40])
def test_terms_beyond_the_cache_are_looked_up_all_the_same(spark, cache_terms):
    articles = samples.articles(spark)
    lexicon = fingerprints.fit_lexicon(articles, low=0.05, high=0.3)
    assert lexicon.count() > 40
    marks = lambda n: sorted(map(repr, fingerprints.mark_articles(articles, lexicon, {"mark": "content"}, ["url", "content"], cache_terms=n).collect()))
    assert marks(cache_terms) == marks(1 << 18)


def test_fingerprints_of_revisions(spark):
    rng = random.Random(2)
    texts = {i: samples.text(rng, words=rng.randint(60, 400)) for i in range(0, 400, 2)}
    texts[10] = texts[4]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts.items()], "url long, content string, fingerprint string, node string")
    rows = {r["url"]: r for r in fingerprints.fingerprint_revisions(df).collect()}
    order = sorted(texts)
    for i, j in zip(order, [*order[1:], order[0]], strict=True):
        t, n = texts[i], len(texts[i])
        assert rows[i]["n_chars"] == n
        assert rows[i]["revised_sha256"] == hashlib.sha256((t[: n - n // 4] + texts[j][: n // 4]).encode()).hexdigest()
        assert 0 <= rows[i]["near_next"] <= 1 and 0 <= rows[i]["near_revised"] <= 1
    assert rows[10]["fingerprint"] == rows[4]["fingerprint"]
    assert np.mean([r["near_revised"] > r["near_next"] for r in rows.values()]) > 0.95
    assert len({r["fingerprint"] for r in rows.values()}) == len(rows) - 1


@pytest.mark.parametrize("edited", [False, True])
def test_fingerprints_of_a_large_group_of_copies(spark, edited):
    rng = random.Random(6)
    hot = samples.text(rng, words=200).split()
    rows = []
    for i in range(60):  # a third of the rows
        words = list(hot)
        for at in rng.sample(range(200), 10 if edited else 0):
            words[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(i, samples.text(rng, words=200)) for i in range(60, 180)]
    got = {r["url"]: r for r in fingerprints.fingerprint_revisions(spark.createDataFrame(rows, "url long, content string")).collect()}
    assert min(got[i]["near_next"] for i in range(59)) > 0.5
    assert min(got[i]["near_revised"] for i in range(60)) > 0.25
    assert max(got[i]["near_next"] for i in range(59, 180)) < 0.5


def test_likeness_estimates_jaccard(spark):
    rng = random.Random(4)
    rows = []
    for size in (20, 100, 400, 2000):
        for keep in (1.0, 0.75, 0.3, 0.0):
            a = rng.sample(range(10**6), size)
            b = a[: int(size * keep)] + rng.sample(range(10**6, 2 * 10**6), size - int(size * keep))
            rows.append((sorted(a), sorted(b), len(set(a) & set(b)) / len(set(a) | set(b))))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, j double")
    codes = df.select("j", *(fingerprints._mark(F.col(c), F.lit(0).cast("long")).alias(c) for c in "ab"))
    for r in codes.select("j", fingerprints.likeness(F.col("a"), F.col("b")).alias("l")).collect():
        assert abs(r["l"] - r["j"]) < 0.3 and (r["j"] != 1 or r["l"] == 1)


def test_fingerprints_of_odd_articles(spark):
    articles = samples.articles(spark)
    rows = fingerprints.fingerprint_revisions(articles).collect()
    assert len(rows) == articles.count()
    of = {}
    for r in rows:
        if r["url"] is not None:
            of.setdefault(r["url"], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in of.values()) and of[3] == of[7] == of[11]
    one = spark.createDataFrame([(5, "alone here")], "url long, content string")
    r = fingerprints.fingerprint_revisions(one).first()
    assert r["near_next"] == 1.0 and r["n_chars"] == 10
    assert fingerprints.fingerprint_revisions(samples.no_articles(spark)).count() == 0

"""Benchmark passages in articles, by a prefix-filtered set join in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_articles, same_text, written

_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def article_words(content: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters; null has none. Case is kept."""
    return F.array_remove(F.split(F.coalesce(content, F.lit("")), _SEPARATORS), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _shingle(words: Column, at: Column, width: int) -> Column:
    """Hash of ``width`` words from position ``at``; equal for words that differ in case only."""
    return F.xxhash64(F.lit(width), *(F.get(words, at + i) for i in range(width)))


def item_windows(items: DataFrame, *, item: str, content: str, window: int, shingle: int) -> DataFrame:
    """(classes, words, window): every ``window`` consecutive words of an item, or a shorter item whole.

    Items of equal words are one class; ``class`` is their sorted ids.
    """
    words = F.transform(article_words(F.col(content).cast("string")), lower_ascii)
    own = items.select(F.col(item).cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    own = own.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(window - 1), F.lit(1)))
    cut = own.select("items", "words", F.explode(starts).alias("at"))
    return cut.select("items", F.slice("words", F.col("at"), F.lit(window)).alias("words")).groupBy("words").agg(F.collect_set("items").alias("classes"))


def find_contamination(
    articles: DataFrame, items: DataFrame, *, url: str = "url", content: str = "content", item: str = "item", item_content: str = "content",
    window: int = 13, shingle: int = 5, share: int = 20,
) -> DataFrame:
    """(url, n_words, n_hit, items, contaminated): words of each article inside occurrences of item windows.

    A window is a set of shingles of ``shingle`` words (shorter windows: of their own length). The
    shingles that articles and items share are ordered by their number of occurrences in all
    articles; as containment is exact, one shingle, the rarest, is the necessary prefix of a window.
    Articles are joined on prefixes only, start positions and lengths are bounded, and candidates
    are compared word by word in the article itself. ``n_hit`` counts words inside at least one
    occurrence, ``items`` holds the sorted ids of the items that occur, and an article is
    contaminated if it is hit and ``share * n_hit >= n_words``.

    One row per input row, repeated rows included. Null and empty texts have no words and no hit;
    null, empty or wordless items never occur; equal items are all reported. No side is broadcast
    by hint: the planner does so where its size estimate allows.
    """
    rows = read_articles(articles, url, content)
    windows = item_windows(items, item=item, content=item_content, window=window, shingle=shingle)
    windows = written(windows.withColumn("window", F.monotonically_increasing_id()), "item_windows")

    # shingles of the windows, with their place in it
    n = F.size("words")
    width = F.least(n, F.lit(shingle))
    placed = windows.select("window", "words", n.alias("length"), F.explode(F.sequence(F.lit(0), n - width)).alias("offset"))
    pick = lambda words, at, width: F.coalesce(*(F.when(width == w, _shingle(words, at, w)) for w in range(1, shingle + 1)))
    placed = placed.select("window", "length", "offset", pick(F.transform("words", F.lower), F.col("offset"), F.least("length", F.lit(shingle))).alias("shingle"))
    placed = written(placed, "item_shingles")

    # the same shingles in articles; widths below `shingle` only where items are that short
    short = [r[0] for r in placed.where(F.col("length") < shingle).select("length").distinct().collect()]  # shingle - 1 values at most
    words = F.transform(article_words(F.col("content")), F.lower)
    position = rows.select(*same_text(), words.alias("words")).select("url", "digest", "size", "words", F.size("words").alias("n_words"), F.posexplode("words").alias("at", "_"))
    at, found = F.col("at"), None
    for w in sorted([*short, shingle]):
        hashes = position.where(at + w <= F.col("n_words")).select("url", "digest", "size", "n_words", "at", _shingle(F.col("words"), at, w).alias("shingle"))
        hits = hashes.join(placed.select("shingle").distinct(), "shingle")
        found = hits if found is None else found.unionByName(hits)
    found = written(found, "shared_shingles")

    rarity = found.groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = placed.join(rarity, "shingle", "left")
    prefix = ranked.groupBy("window", "length").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("p")
    ).where(F.col("p.n") > 0)
    prefix = prefix.select("window", "length", F.col("p.shingle").alias("shingle"), F.col("p.offset").alias("offset"))

    candidates = found.join(prefix, "shingle").select("url", "digest", "size", "n_words", (at - F.col("offset")).alias("start"), "length", "window")
    candidates = candidates.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
    candidates = candidates.join(windows.select("window", F.col("words").alias("expected")), "window")
    # several articles may be saved under one url with one text: distinct, or their places would be listed twice
    per_article = candidates.groupBy("url", "digest", "size").agg(F.collect_set(F.struct("start", "length", "window", "expected")).alias("candidates"))

    keyed = rows.select(*same_text(), "content")
    a, b = keyed.alias("a"), per_article.alias("b")
    same = F.col("a.url").eqNullSafe(F.col("b.url")) & (F.col("a.digest") == F.col("b.digest")) & F.col("a.size").eqNullSafe(F.col("b.size"))
    joined = a.join(b, same, "left").select("a.url", "a.content", "b.candidates").withColumn("words", article_words(F.col("content")))
    holds = lambda c: F.transform(F.slice(F.col("words"), c["start"] + 1, c["length"]), lower_ascii) == c["expected"]
    spots = F.array_sort(F.filter(F.coalesce("candidates", F.array().cast(per_article.schema["candidates"].dataType)), holds))
    verified = joined.select("url", F.size("words").cast("long").alias("n_words"), F.transform(spots, lambda c: F.struct(c["start"].alias("start"), c["length"].alias("length"), c["window"].alias("window"))).alias("spots"))
    verified = written(verified.withColumn("row", F.monotonically_increasing_id()), "occurrences")

    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(
        "spots", zero,
        lambda acc, c: F.struct(
            (acc["hit"] + F.greatest(F.lit(0), c["start"] + c["length"] - F.greatest(acc["end"], c["start"]))).alias("hit"),
            F.greatest(acc["end"], c["start"] + c["length"]).cast("long").alias("end"),
        ),
        lambda acc: acc["hit"],
    )
    occurring = verified.select("row", F.explode(F.array_distinct(F.transform("spots", lambda c: c["window"]))).alias("window"))
    occurring = occurring.join(windows.select("window", F.explode("classes").alias("class")), "window").groupBy("row").agg(F.collect_set("class").alias("classes"))
    items_of = F.coalesce(F.array_sort(F.array_distinct(F.flatten("classes"))), F.array().cast("array<string>"))
    out = verified.join(occurring, "row", "left").select("url", "n_words", covered.alias("n_hit"), items_of.alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))

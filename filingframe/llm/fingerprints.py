"""I-Match fingerprints of articles, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import least_count, written
from .decontaminate import article_words

SUBSETS = 32  # randomised lexicon subsets of each scale
RATES = (1, 8, 64)  # a subset of scale k holds 1 / (SUBSETS * RATES[k]) of the lexicon
_HEAD = 8  # hexadecimal digits of the number of terms, in front of 4 for each subset


def _successor(numbers: DataFrame, bits: int) -> DataFrame:
    """(n, next): the next larger of distinct integers of ``bits`` bits; the largest gets the smallest.

    Integers with the same upper bits are put in order together, 4,096 at most; the last of such a
    node goes on with the first of the next node, found in the same way among the upper bits.
    """
    if bits <= 16:
        whole = Window.orderBy("n")
        return numbers.select("n", F.coalesce(F.lead("n").over(whole), F.first("n").over(whole)).alias("next"))
    node = F.shiftright("n", 12)
    inside = Window.partitionBy("node").orderBy("n")
    rows = numbers.select("n", node.alias("node")).select("n", "node", F.lead("n").over(inside).alias("next"))
    nodes = written(numbers.groupBy(node.alias("n")).agg(F.min("n").alias("head")), "order_nodes")
    after = _successor(nodes.select("n"), bits - 12).withColumnRenamed("n", "node").withColumnRenamed("next", "n")
    heads = after.join(nodes, "n").select("node", "head")
    return rows.join(heads, "node").select("n", F.coalesce("next", "head").alias("next"))


def following(articles: DataFrame, order: str, *columns: str) -> DataFrame:
    """All columns and ``next_<column>`` of the next row in ascending integer ``order``; the last row gets the first.

    Rows are put in order inside nodes of 1,024 successive numbers, so no task orders the whole
    table; only the first row of each node travels to the node before. A null order comes first;
    rows of one number stand in the order of ``columns``. Columns that have the names of the result
    or of a step (``_n``, ``_node``, ``_last``, ``_rank``, ``_head_<column>``) are replaced; an empty table
    gives no rows.
    """
    articles = articles.drop("_n", "_node", "_last", "_rank", *(f"{p}_{c}" for c in columns for p in ("next", "_head")))
    n = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 62)))
    rows = articles.withColumn("_n", n).withColumn("_node", F.shiftright("_n", 10))
    nodes = written(rows.select(F.col("_node").alias("n")).distinct(), "order_nodes")
    inside = Window.partitionBy("_node").orderBy("_n", *columns)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(inside) for c in columns} | {"_last": F.lead("_n").over(inside).isNull(), "_rank": F.row_number().over(inside)})
    heads = rows.where("_rank = 1").select(F.col("_node").alias("next"), *(F.col(c).alias(f"_head_{c}") for c in columns))
    ends = _successor(nodes, 54).join(heads, "next").drop("next").withColumnRenamed("n", "_node")
    joined = rows.join(ends, "_node", "left")
    joined = joined.withColumns({f"next_{c}": F.when(F.col("_last"), F.col(f"_head_{c}")).otherwise(F.col(f"next_{c}")) for c in columns})
    return joined.drop("_n", "_last", "_rank", *(f"_head_{c}" for c in columns))


def revised(content: Column, after: Column, share: int = 4) -> Column:
    """``content`` whose last 1/``share`` of code points gives way to as many from the start of ``after``."""
    n = F.length(content)
    cut = F.floor(n / share).cast("int")
    return F.concat(F.substring(content, F.lit(1), n - cut), F.substring(after, F.lit(1), cut))


def fit_lexicon(articles: DataFrame, *, content: str = "content", low: float = 0.001, high: float = 0.2, equal_once: bool = False) -> DataFrame:
    """(term, n): hashes of the words found in more than ``low`` and at most ``high`` of all articles, and in how many.

    That is the band of inverse document frequency between ln(1/high) and ln(1/low), the whole of
    it. Document frequencies are counted over every article, or with ``equal_once`` over every
    different text.
    """
    texts = articles.select(F.coalesce(F.col(content), F.lit("")).alias("content"))
    if equal_once:
        texts = texts.distinct()
    # an empty word counts the texts
    words = texts.select(F.explode(F.array_append(F.array_distinct(article_words(F.lower("content"))), "")).alias("word"))
    counted = written(words.groupBy(F.xxhash64("word").alias("term")).agg(F.count("*").alias("n")), "term_counts")
    every = counted.where(F.col("term") == F.xxhash64(F.lit(""))).first()
    total = every["n"] if every else 0
    counted = counted.where(F.col("term") != F.xxhash64(F.lit("")))
    return counted.where((F.col("n") > low * total) & (F.col("n") <= high * total))


def _known(terms: DataFrame, lexicon: DataFrame, cache_terms: int) -> DataFrame:
    """``terms`` with ``known``, true for those of the lexicon.

    The ``cache_terms`` most frequent terms of the lexicon are broadcast; a term that is not among
    them is looked up in the rest, if there is one, by a join.
    """
    least = least_count(lexicon, cache_terms)
    flag = F.lit(True).alias("known")
    cached = terms.join(F.broadcast(lexicon.where(F.col("n") >= least).select("term", flag)), "term", "left")
    rest = lexicon.where(F.col("n") < least)
    if rest.isEmpty():
        return cached
    cached = written(cached, "looked_up_terms")  # both parts must see the same row numbers
    found = cached.where("known is null").drop("known").join(rest.select("term", flag), "term", "left")
    return cached.where("known").unionByName(found)


def _subset_hashes(terms: Column, rate: int) -> Column:
    """16 bits of a hash of the sorted terms in each of the random subsets at one rate.

    The place of a term, a random number below SUBSETS * rate, goes in front of its hash, so one
    sort brings the subsets together; they are picked out in two steps, four groups of eight.
    """
    marked = F.transform(terms, lambda t: F.shiftleft(F.pmod(F.xxhash64(t, F.lit(rate)), F.lit(SUBSETS * rate)), 40).bitwiseOR(t.bitwiseAND(F.lit((1 << 40) - 1))))
    if rate > 1:
        marked = F.filter(marked, lambda x: x < (SUBSETS << 40))
    # the array around the sorted terms names them, so that they are sorted once
    fours = lambda own: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda g: F.filter(own, lambda x: F.shiftright(x, 43) == g))
    groups = F.flatten(F.transform(F.array(F.sort_array(marked)), fours))
    place = lambda x: F.shiftright(x, 40).bitwiseAND(F.lit(7).cast("long"))
    short = lambda subset: F.pmod(F.xxhash64(subset), F.lit(1 << 16)).cast("int")
    eight = F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))
    return F.flatten(F.transform(groups, lambda part: F.transform(eight, lambda i: short(F.filter(part, lambda x: place(x) == i)))))


def _mark(terms: Column, plain: Column) -> Column:
    """Number of terms, the subset hashes of all rates, and without terms a hash of the text."""
    some = F.size(terms) > 0
    hashes = F.when(some, F.concat(*(_subset_hashes(terms, r) for r in RATES))).otherwise(F.array().cast("array<int>"))
    return F.struct(F.size(terms).alias("n"), hashes.alias("hashes"), F.when(~some, plain).alias("text"))


def code(mark: Column) -> Column:
    """A mark as hexadecimal text: the number of terms, then 4 digits for each subset."""
    digits = lambda value, n: F.lpad(F.lower(F.hex(value)), n, "0")
    rest = F.when(mark["n"] == 0, digits(mark["text"], 16)).otherwise(F.array_join(F.transform(mark["hashes"], lambda h: digits(h, 4)), ""))
    return F.concat(digits(mark["n"], _HEAD), rest)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the terms behind two marks, 0 to 1.

    A subset drawn at rate r is equal in both with probability exp(-r d), d being the number of
    terms in only one of them. d is taken from the coarsest scale in which at least a quarter of the
    subsets are equal, else from the finest. Marks without terms are alike only if equal.
    """
    def equal_subsets(scale: int) -> Column:
        own = lambda m: F.slice(m["hashes"], SUBSETS * scale + 1, SUBSETS)
        return F.size(F.filter(F.zip_with(own(a), own(b), lambda x, y: x == y), lambda same: same))

    equal = [equal_subsets(k) for k in range(len(RATES))]
    apart = [-F.log(F.greatest(e, F.lit(0.5)) / SUBSETS) * (SUBSETS * r) for e, r in zip(equal, RATES, strict=True)]
    d = apart[-1]
    for k in reversed(range(len(RATES) - 1)):
        d = F.when(equal[k] >= SUBSETS // 4, apart[k]).otherwise(d)
    total = a["n"] + b["n"]
    estimate = F.greatest(F.lit(0.0), (total - d) / (total + d))
    return F.when(a == b, 1.0).when((a["n"] == 0) | (b["n"] == 0), 0.0).otherwise(estimate).cast("double")


def mark_articles(
    articles: DataFrame, lexicon: DataFrame, texts: dict[str, str], keep: list[str], *, group: list[str] | None = None, cache_terms: int = 1 << 18
) -> DataFrame:
    """``keep`` and one mark for each text column, for ``code`` and ``likeness``; ``texts`` maps new names to columns.

    The distinct words of a text that are in ``lexicon`` are sorted by hash; 96 random subsets of
    the lexicon, 32 at each of three rates, give a 16-bit hash each, so that a short text still
    meets some subsets and a long one leaves some untouched. Equal texts have equal marks;
    null is empty. Of a text with less than a third of its words in ``lexicon`` all words are terms:
    else the texts of a large group of near-copies, whose words are all too frequent, had none, and
    as an edit replaces only part of a text, its edited text mostly falls under the same rule. A
    text without words is identified by its whole text.

    One row per input row; columns that are not named are left behind, and those of ``keep`` may not be
    called term, side or known, nor begin with an underscore. ``group`` names columns by which the rows are already partitioned: then
    terms come together again without a shuffle, as long as ``cache_terms``, the number of frequent
    terms that are broadcast, holds the whole lexicon.
    """
    group = group or []
    rows = articles.withColumn("_row", F.monotonically_increasing_id())
    # an empty word keeps rows without terms
    sides = F.array(*(F.struct(F.lit(i).alias("side"), F.array_append(F.array_distinct(article_words(F.lower(F.col(c)))), "").alias("words")) for i, c in enumerate(texts.values())))
    plain = [F.xxhash64(F.coalesce(F.col(c), F.lit(""))).alias(f"_plain_{i}") for i, c in enumerate(texts.values())]
    rows = rows.select(*group, "_row", *keep, *plain, F.explode(sides).alias("s"))
    whole = [*keep, *(f"_plain_{i}" for i in range(len(texts)))]
    rows = rows.select(*group, "_row", *whole, "s.side", F.explode("s.words").alias("word"))
    # what belongs to the row travels with its empty words only
    rows = rows.select(*group, "_row", *(F.when(F.col("word") == "", F.col(c)).alias(c) for c in whole), "side", F.xxhash64("word").alias("term"))
    terms = _known(rows, lexicon, cache_terms)
    word = F.col("term") != F.xxhash64(F.lit(""))
    own = lambda i, which: F.collect_set(F.when((F.col("side") == i) & word & which, F.col("term")))
    known = F.col("known").isNotNull()
    sets = [c for i in range(len(texts)) for c in (own(i, known).alias(f"_terms_{i}"), own(i, ~known).alias(f"_others_{i}"))]
    firsts = [F.first(c, ignorenulls=True).alias(c) for c in whole]
    grouped = terms.groupBy(*group, "_row").agg(*firsts, *sets)
    few = lambda i: 2 * F.size(f"_terms_{i}") < F.size(f"_others_{i}")
    grouped = grouped.withColumns({f"_terms_{i}": F.sort_array(F.when(few(i), F.concat(f"_terms_{i}", f"_others_{i}")).otherwise(F.col(f"_terms_{i}"))) for i in range(len(texts))})
    return grouped.select(*keep, *(_mark(F.col(f"_terms_{i}"), F.col(f"_plain_{i}")).alias(name) for i, name in enumerate(texts)))


def fingerprint_revisions(
    articles: DataFrame, *, url: str = "url", content: str = "content", low: float = 0.001, high: float = 0.2
) -> DataFrame:
    """(url, n_chars, revised_sha256, fingerprint, revised_fingerprint, near_revised, near_next).

    Each article next to a revision of itself, whose last quarter is overwritten with the start of
    the next article by url (an integer), and next to that article. Null texts are empty; a table of
    one row has itself as the next article. Document frequencies count equal texts once. Texts are
    moved twice, to find equal ones and to bring neighbours together.
    """
    rows = articles.select(F.col(url).alias("url"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("content"))
    lexicon = fit_lexicon(rows, low=low, high=high, equal_once=True)
    pairs = following(rows, "url", "content")
    pairs = pairs.withColumn("revised", revised(F.col("content"), F.col("next_content"))).drop("next_content")
    pairs = pairs.withColumns({"n_chars": F.length("content").cast("long"), "revised_sha256": F.sha2(F.col("revised").cast("binary"), 256)})
    marked = mark_articles(pairs, lexicon, {"mark": "content", "revised_mark": "revised"}, ["url", "n_chars", "revised_sha256"], group=["_node"])
    marked = following(written(marked, "marks"), "url", "mark")
    return marked.select(
        "url", "n_chars", "revised_sha256", code(F.col("mark")).alias("fingerprint"), code(F.col("revised_mark")).alias("revised_fingerprint"),
        likeness(F.col("mark"), F.col("revised_mark")).alias("near_revised"), likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
    )

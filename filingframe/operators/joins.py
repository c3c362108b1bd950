"""Lookups and upserts as equi-joins; fixed rule tables live in expressions, not in joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..session import cut_lineage, saved


def enrich_missing(base: DataFrame, extra: DataFrame, keys: Sequence[str], cols: Sequence[str], *, zero_is_missing: bool = True) -> DataFrame:
    """Fill only what ``base`` lacks (NULL or zero) from the matching row of ``extra``."""
    right = extra.select(*keys, *(F.col(c).alias(f"_x_{c}") for c in cols))
    joined = base.join(right, list(keys), "left")
    types = dict(base.dtypes)

    def fill(c: str) -> Column:
        have = F.col(c)
        if zero_is_missing:
            have = F.nullif(have, F.lit("") if types[c] == "string" else F.lit(0))
        return F.coalesce(have, F.col(f"_x_{c}"), F.col(c)).alias(c)

    return joined.select(*(fill(c) if c in cols else F.col(c) for c in base.columns))


def overwrite_present(base: DataFrame, extra: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Values of ``extra`` win where they are present and not zero."""
    right = extra.select(*keys, *(F.col(c).alias(f"_x_{c}") for c in cols))
    types = dict(base.dtypes)

    def pick(c: str) -> Column:
        new = F.nullif(F.col(f"_x_{c}"), F.lit("") if types[c] == "string" else F.lit(0))
        return F.coalesce(new, F.col(c)).alias(c)

    joined = base.join(right, list(keys), "left")
    return joined.select(*(pick(c) if c in cols else F.col(c) for c in base.columns))


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str], *, policy: str = "replace", measures: Sequence[str] = ()) -> DataFrame:
    """Replace by key or append.

    ``skip_nonempty`` keeps an existing row that has any of its measures and lets a new row
    take the place of a wholly empty one.
    """
    if policy not in ("replace", "skip_nonempty"):
        raise ValueError(f"unknown policy {policy!r}")
    cols = base.columns
    l = base.select(F.struct(*cols).alias("_old"), *keys)
    r = new.select(F.struct(*cols).alias("_new"), *keys)
    joined = l.join(r, list(keys), "full_outer")
    if policy == "replace":
        chosen = F.coalesce("_new", "_old")
    else:
        old_full = F.coalesce(*(F.col("_old")[m] for m in measures)).isNotNull()
        chosen = F.when(old_full, F.col("_old")).otherwise(F.coalesce("_new", "_old"))
    return joined.select(chosen.alias("_row")).select("_row.*")


def prior_period_join(periods: DataFrame, *, keys: Sequence[str], fy: str = "fy", measures: Sequence[str], offset: int = 1, prefix: str = "prev_") -> DataFrame:
    """Exact prior period: the same keys ``offset`` years earlier (no row, no value)."""
    prior = periods.select(
        *keys, (F.col(fy) + offset).alias(fy), *(F.col(m).alias(prefix + m) for m in measures)
    )
    return periods.join(prior, [*keys, fy], "left")


_WINDOWS = tuple(4**k for k in range(7))  # grams of a window, level by level


_SIEVE_BITS = 27  # 16 MiB; more grams than that has bits only let more rows through


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _least_grams(title: str, min_chars: int) -> Iterator[np.ndarray]:
    """The least gram hash of every window of ``_WINDOWS`` grams of a title, for all widths it is long enough for.

    Hashes of two halves make that of a gram, and minima of two halves that of a window, so the work
    is linear in the title.
    """
    c, size = _mix(np.frombuffer(title.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)), 1
    while size < min_chars:  # halves overlap where the length is no power of two
        d = min(size, min_chars - size)
        c, size = _mix(c[:-d] * np.uint64(0xD6E8FEB86659FD93) + c[d:]), size + d
    yield c
    grams, size = len(c), 1
    for width in _WINDOWS[1:]:
        if grams < width:
            return
        while size < width:
            c, size = np.minimum(c[:-size], c[size:]), size * 2
        yield c


def _named(least: np.ndarray, block: int, level: int) -> np.ndarray:
    """Names of the grams of a level in a block; runs of equal ones count once."""
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    return _mix(least[new] ^ _mix(np.array([block], np.int64).view(np.uint64) + np.uint64(level)))


def _own_grams(min_chars: int) -> Callable[..., Column]:
    """(title, block) -> the grams of the widest windows a title has."""

    @F.pandas_udf("array<bigint>")
    def own(titles: pd.Series, blocks: pd.Series) -> pd.Series:
        def of(title: str, block: int) -> np.ndarray:
            *_, (level, least) = enumerate(_least_grams(title, min_chars))
            return np.unique(_named(least, block, level)).view(np.int64)

        return pd.Series(list(map(of, titles, blocks)), dtype=object)

    return own


def _met_grams(min_chars: int, sieve: Broadcast) -> Callable[..., Column]:
    """(title, block) -> the grams of all windows whose bit is set in the sieve."""

    @F.pandas_udf("array<bigint>")
    def met(titles: pd.Series, blocks: pd.Series) -> pd.Series:
        bits = np.frombuffer(sieve.value, np.uint8)

        def of(title: str, block: int) -> np.ndarray:
            found = []
            for level, least in enumerate(_least_grams(title, min_chars)):
                g = _named(least, block, level)
                at = g >> np.uint64(64 - _SIEVE_BITS)
                found.append(g[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0])
            return np.unique(np.concatenate(found)).view(np.int64)

        return pd.Series(list(map(of, titles, blocks)), dtype=object)

    return met


def _sieve(grams: DataFrame, name: str) -> Broadcast:
    """A bit for the first ``_SIEVE_BITS`` bits of every gram: of fixed size, whatever the number of grams."""
    at, page = F.shiftrightunsigned(name, 64 - _SIEVE_BITS), 32768  # bits of a bitmap
    pages = grams.groupBy(F.floor(at / page).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(page))).alias("bits"))
    bits = bytearray(2 ** (_SIEVE_BITS - 3))
    for r in pages.toLocalIterator():
        bits[r.page * page // 8 : (r.page + 1) * page // 8] = r.bits
    return grams.sparkSession.sparkContext.broadcast(bytes(bits))


def containment_pairs(titles: DataFrame, *, block: Sequence[str], order: str, norm: str, min_chars: int = 8, hot: int = 4096) -> DataFrame:
    """Pairs of different titles in a block where one contains the other.

    Exact without comparing all pairs. A window of a short title is a window of every title that
    contains it, and has the same least gram there; so a title is looked up under one such gram of
    the widest windows it has, the one that the fewest titles have. Titles are distinct within a
    block. Of a title's own windows only the least grams travel, and of those only the ones that
    some title is looked up under, as a sieve of fixed size and then a join tell; a phrase shared by a third of all titles is no candidate unless
    a title consists of nothing else, and what ``hot`` titles or more share is dealt over several
    tasks. The titles of the candidates are compared at the end.
    """
    block = list(block)
    tasks = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes, much work: spread over all tasks, where the adaptive planner would take one for them
    t = saved(titles.select(*block, order, norm).where(F.length(norm) >= min_chars).repartition(tasks, order), "titles")
    within = F.xxhash64(*block)
    looked_up = saved(t.select(*block, F.col(order).alias("short"), F.length(norm).alias("_short_len"), F.explode(_own_grams(min_chars)(norm, within)).alias("_g")), "grams")
    wanted = saved(looked_up.select(*block, "_g").distinct(), "wanted_grams")
    met = _met_grams(min_chars, _sieve(wanted, "_g"))
    having = t.select(*block, F.col(order).alias("long"), F.length(norm).alias("_long_len"), F.explode(met(norm, within)).alias("_g"))
    having = saved(having.join(wanted, [*block, "_g"], "left_semi"), "met_grams")
    frequency = saved(having.groupBy(*block, "_g").agg(F.count("*").alias("_n")), "gram_counts")
    rarest = looked_up.join(frequency, [*block, "_g"]).groupBy(*block, "short", "_short_len").agg(F.min_by(F.struct("_g", "_n"), F.struct("_n", "_g")).alias("_r"))
    parts = F.ceil(F.col("_n") / hot).cast("int")
    short = rarest.select(*block, "short", "_short_len", "_r.*").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    long = having.join(frequency, [*block, "_g"]).withColumn("_part", F.pmod(F.xxhash64("long"), parts).cast("int")).drop("_n")
    fits = (F.col("short") != F.col("long")) & (F.col("_short_len") < F.col("_long_len"))
    candidates = short.drop("_n").join(long, [*block, "_g", "_part"]).where(fits).select(*block, "short", "long")
    named = lambda role, text: t.select(*block, F.col(order).alias(role), F.col(norm).alias(text))
    both = candidates.join(named("short", "_s"), [*block, "short"]).join(named("long", "_l"), [*block, "long"])
    return both.where(F.contains(F.col("_l"), F.col("_s"))).select(*block, "short", "long")


def fallback_source(primary: DataFrame, secondary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``secondary`` only for keys ``primary`` does not have."""
    extra = secondary.join(primary.select(*keys).distinct(), list(keys), "left_anti")
    return primary.unionByName(extra.select(*primary.columns))


def first_value_match(probe: DataFrame, instruments: DataFrame, *, keys: Sequence[str], probe_value: str, instrument_value: str, instrument_order: str, instrument_key: str, prefix: str | None = None) -> DataFrame:
    """Keyless records find the first instrument (insertion order) with an equal value.

    The instrument side is reduced to one row per value before the join, so a value held by
    many instruments does not multiply the probes.
    """
    inst = instruments
    if prefix:
        inst = inst.where(F.col(instrument_key).startswith(prefix))
    first = (
        inst.where(F.col(instrument_value).isNotNull())
        .groupBy(*keys, F.col(instrument_value).alias(probe_value))
        .agg(F.min_by(instrument_key, instrument_order).alias("matched_key"))
    )
    return probe.join(first, [*keys, probe_value], "left").select(*probe.columns, "matched_key")


def restrict_to(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(wanted.select(*keys), list(keys), "left_semi")


def canonical_names(df: DataFrame, *, keys: Sequence[str], name: str, order: str, amounts: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Names equal but for white space take their first-seen spelling; amounts are added up.

    ``keys`` is the scope within which a spelling is shared, ``groups`` the finer result key.
    """
    marked = df.withColumn("_norm", squeeze(name))
    spelling = marked.groupBy(*keys, "_norm").agg(F.min_by(name, order).alias("_name"))
    summed = marked.groupBy(*keys, *groups, "_norm").agg(
        *(F.sum(a).alias(a) for a in amounts), F.min(order).alias(order)
    )
    return summed.join(spelling, [*keys, "_norm"]).select(
        *keys, *groups, F.col("_name").alias(name), order, *amounts
    )


def resolve_greedy(pairs: DataFrame, *, block: Sequence[str], save: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Titles dropped by the greedy rule "drop what overlaps an earlier kept title".

    Non-transitive: whether a title stays depends on earlier decisions. A title is dropped if one
    of its conditions holds; at first these are "an earlier neighbour is kept". Each round settles
    the titles whose conditions are all known. A title left with a single condition is that
    condition reversed, so the titles that wait for it take it over, reversed once more: a chain of
    any length shrinks by half in a round. All titles are settled at once and only conditions move.
    """
    block = list(block)
    conditions = save(pairs.select(
        *block, F.greatest("short", "long").alias("late"), F.least("short", "long").alias("early"), F.lit(True).alias("if_kept")
    ).distinct())
    known = conditions.select(*block, F.col("early").alias("title")).distinct().join(
        conditions.select(*block, F.col("late").alias("title")), [*block, "title"], "left_anti"
    ).withColumn("kept", F.lit(True))
    dropped = conditions.where(F.lit(False)).select(*block, "late")
    while not conditions.isEmpty():
        seen = conditions.join(known.withColumnRenamed("title", "early"), [*block, "early"], "left")
        holds = F.col("kept") == F.col("if_kept")  # null while the earlier title is not settled
        open_early = F.when(F.col("kept").isNull(), F.col("early"))
        # kept and not kept of the same title: one of the two holds
        both_ways = F.count(open_early) > F.count_distinct(open_early)
        titles = save(seen.groupBy(*block, "late").agg(
            F.coalesce(F.max(holds), F.lit(False)).alias("sure"), F.count(open_early).alias("n_open"), both_ways.alias("both_ways"),
            F.max(F.when(F.col("kept").isNull(), F.struct("early", "if_kept"))).alias("only"),
        ))
        gone = titles.where(F.col("sure") | F.col("both_ways")).select(*block, "late")
        dropped = dropped.unionByName(gone)
        settled = F.col("sure") | F.col("both_ways") | (F.col("n_open") == 0)
        known = titles.where(settled).select(*block, F.col("late").alias("title"), (~(F.col("sure") | F.col("both_ways"))).alias("kept"))
        waiting = titles.where(~settled).select(*block, "late")
        single = titles.where(~settled & (F.col("n_open") == 1)).select(
            *block, F.col("late").alias("early"), F.col("only.early").alias("_early"), F.col("only.if_kept").alias("_if_kept")
        )
        rest = seen.where(F.col("kept").isNull()).select(*block, "late", "early", "if_kept").join(waiting, [*block, "late"], "left_semi")
        moved = rest.join(single, [*block, "early"], "left")
        conditions = save(moved.select(
            *block, "late", F.coalesce("_early", "early").alias("early"),
            F.when(F.col("_early").isNull(), F.col("if_kept")).otherwise(F.col("if_kept") != F.col("_if_kept")).alias("if_kept"),
        ).distinct())
    return dropped


def containment_dedup(news: DataFrame, *, block: Sequence[str], order: str, title: str, min_chars: int = 8) -> DataFrame:
    """First of each family of near-equal titles, in order.

    Bracketed tags and white space do not count. Equal titles go first with one aggregate (the
    earliest stays when it has at least ``min_chars``; shorter ones never match anything), then
    containment pairs are resolved greedily.
    """
    block = list(block)
    bare = F.regexp_replace(F.coalesce(F.col(title), F.lit("")), r"\[.*?\]|【.*?】", "")
    marked = news.withColumn("_norm", squeeze(bare)).where(F.col("_norm") != "")
    long_enough = F.length("_norm") >= min_chars
    first = (
        marked.where(long_enough).groupBy(*block, "_norm").agg(F.min(order).alias(order))
    )
    first = saved(first, "first_titles")
    pairs = cut_lineage(containment_pairs(first, block=block, order=order, norm="_norm", min_chars=min_chars))
    gone = resolve_greedy(pairs, block=block)
    kept = first.join(gone.withColumnRenamed("late", order), [*block, order], "left_anti")
    keep_keys = kept.select(*block, order).unionByName(
        marked.where(~long_enough).select(*block, order)
    )
    return news.join(keep_keys, [*block, order], "left_semi")

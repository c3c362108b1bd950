"""The sequential part of the state: records that find their instrument by its current figures.

A price adjustment without a series names the old price, and the instrument that has this
price *now* takes it; the next adjustment depends on the outcome. Instruments that such a record
can find are folded in record order, those of one issuer together. Rows reach the fold sorted
within their partition and are read batch by batch, so memory holds these instruments and never
their records. All other instruments, the same issuer's too, take the aggregate path of
:mod:`.state`: the figures they have over time are known without a fold, and if no record looks for
any of them, none can ever find them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import schemas as sc
from .state import STATE, adjusted_values, apply_events, apply_exercises, apply_notes, apply_price_adjustments, series_owners

MIN_PRICE = sc.MIN_PRICE


def adjust(book: dict, record: dict) -> None:
    """Apply one adjustment record to an insertion-ordered book of instruments.

    Shared by the batch fold and the streaming processor; missing values are ``None``.
    """
    if record["part"] == 0:
        price = record["price_after"]
        if price is None:
            return
        hit = _find(book, record["series"], "conversion_price", record["price_before"])
        if hit is not None:
            hit["conversion_price"] = price
            if price >= MIN_PRICE and hit["remaining"]:
                hit["convertible_shares"] = hit["remaining"] // price
        return
    shares, left = record["shares_after"], record["unconverted"]
    if shares is None and left is None:
        return
    before = record["shares_before"] or record["current_shares"]
    hit = _find(book, record["series"], "convertible_shares", before)
    if hit is not None:
        if shares is not None:
            hit["convertible_shares"] = shares
        if left is not None:
            hit["remaining"] = left


def _find(book: dict, series, field: str, value):
    """First instrument of the series, or (without one) the first whose figure equals value."""
    if series is None and not value:
        return None
    for inst in book.values():
        if (inst["series"] == series) if series is not None else (inst[field] == value):
            return inst
    return None


_RECORD = ["series", "price_before", "price_after", "shares_before", "current_shares", "shares_after", "unconverted"]
_TEXT = ["category", "kind", "exercise_start", "exercise_end"]
_OUT = (
    "issuer bigint, instrument_key string, phase int, first_ord bigint, category string, series bigint, kind string,"
    " face_value bigint, remaining bigint, conversion_price bigint, convertible_shares bigint,"
    " exercise_start string, exercise_end string"
)


def fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole issuers in order (instruments first, then records) -> final instruments."""
    columns = [c.split()[0] for c in _OUT.split(", ")]
    numbers = ["series", "face_value", "remaining", "conversion_price", "convertible_shares"]
    issuer, book, done = None, {}, []

    def flush() -> None:
        done.extend([issuer, key, *(inst[c] for c in columns[2:])] for key, inst in book.items())

    for batch in batches:
        for row in batch.to_pylist():
            if row["issuer"] != issuer:
                if issuer is not None:
                    flush()
                issuer, book = row["issuer"], {}
            if row["is_record"]:
                adjust(book, {c: row[c] for c in (*_RECORD, "part")})
            else:
                book[row["instrument_key"]] = {
                    c: row[c] for c in ("phase", "first_ord", *_TEXT, *numbers)
                }
        if len(done) > 10_000:
            yield _frame(done, columns)
            done.clear()
    if issuer is not None:
        flush()
    yield _frame(done, columns)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _frame(rows: list, columns: list) -> pa.RecordBatch:
    types = [_ARROW[c.split()[1]] for c in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=columns)


def _reachable(keyless: DataFrame, named: DataFrame, state: DataFrame) -> DataFrame:
    """(issuer, instrument_key) of the instruments that have, at some time, a price or share count that a keyless record looks for."""
    shares = F.coalesce(F.nullif("shares_before", F.lit(0)), F.nullif("current_shares", F.lit(0)))
    sought = keyless.select("issuer", "part", F.when(F.col("part") == 0, F.nullif("price_before", F.lit(0))).otherwise(shares).alias("value"))
    sought = sought.where(F.col("value").isNotNull()).distinct()
    issuers = sought.select("issuer").distinct()
    own = lambda df: df.join(issuers, "issuer", "left_semi")
    values = adjusted_values(own(named), own(state))
    figures = values.select("issuer", "instrument_key", F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col(c).alias("value")) for i, c in enumerate(("price", "shares"))))).alias("_v"))
    figures = figures.select("issuer", "instrument_key", "_v.*").where(F.col("value").isNotNull()).distinct()
    return figures.join(sought, ["issuer", "part", "value"], "left_semi").select("issuer", "instrument_key").distinct()


def fold_adjustments(adjustments: DataFrame, state: DataFrame) -> DataFrame:
    """Price adjustments and share changes for all issuers.

    Instruments that no keyless record can find go through aggregates; the rest through the fold.
    """
    keyless, named = adjustments.where(F.col("series").isNull()), adjustments.where(F.col("series").isNotNull())
    reachable = cut_lineage(_reachable(keyless, named, state))
    routed = named.join(series_owners(state), ["issuer", "series"])
    keys = ["issuer", "instrument_key"]
    plain_state = state.join(reachable, keys, "left_anti")
    plain = apply_price_adjustments(routed.join(reachable, keys, "left_anti").drop("instrument_key"), plain_state)
    state = state.join(reachable, keys, "left_semi")
    followed = routed.join(reachable, keys, "left_semi").select(*adjustments.columns)
    adjustments = followed.unionByName(keyless.join(reachable.select("issuer").distinct(), "issuer", "left_semi"))
    as_int = [c for c in _RECORD if c != "series"]
    instruments = state.select(
        *(c for c in STATE if c != "inserted"),
        F.col("inserted")["phase"].alias("phase"),
        F.col("inserted")["ord"].alias("first_ord"),
        F.lit(False).alias("is_record"),
        F.lit(None).cast("date").alias("entry_date"),
        F.lit(0).cast("bigint").alias("ord"),
        F.lit(0).alias("part"),
        F.lit(0).cast("bigint").alias("pos"),
        *(F.lit(None).cast("bigint").alias(c) for c in as_int),
    )
    blank = {c: F.lit("") for c in ("instrument_key", *_TEXT)}
    zero = {c: F.lit(0).cast("bigint") for c in ("face_value", "remaining", "conversion_price", "convertible_shares", "first_ord")}
    records = adjustments.select(
        "issuer", "series", "entry_date", "ord", "part", "pos", *as_int,
        F.lit(True).alias("is_record"), F.lit(0).alias("phase"),
        *(v.alias(c) for c, v in {**blank, **zero}.items()),
    )
    # The key of the shuffle is a hash of the issuer on purpose: a plain repartition by issuer
    # is dropped when both sides of the union are already partitioned by it, and the adaptive
    # planner may then coalesce the two sides differently and part instruments from records.
    ordered = (
        instruments.unionByName(records)
        .repartition(F.xxhash64("issuer"))
        .sortWithinPartitions("issuer", "is_record", "phase", "first_ord", "entry_date", "ord", "part", "pos", "instrument_key")
    )
    folded = ordered.mapInArrow(fold_sorted, schema=_OUT)
    inserted = F.struct(F.col("phase"), F.col("first_ord").alias("ord")).alias("inserted")
    return plain.unionByName(folded.select(*(inserted if c == "inserted" else F.col(c) for c in STATE)))


def fold_instruments(notes: DataFrame, events: DataFrame, exercises: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Final instruments: notes, later decisions, exercises by date, adjustments by date.

    Each phase reads the state several times, so it is cut after a phase: one row per
    instrument, against all the records behind it.
    """
    state = cut_lineage(apply_events(events, apply_notes(notes)))
    state = cut_lineage(apply_exercises(exercises, state))
    return fold_adjustments(adjustments, state)

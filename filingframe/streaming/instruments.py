"""Dilution state as a stream: of every record, what still counts, keyed by issuer and series.

Notes, decisions and exercise balances take part by their first or last present value per field
(see :mod:`..dilution.state`), so of each family only the records that hold such a value are
kept, whatever their order of arrival. Price adjustments apply in their order: they are held until
the watermark has passed them and then leave the state for a log. The instruments are the
batch fold of what is kept, held and logged.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..dilution import schemas as sc
from ..dilution.fold import fold_instruments
from ..dilution.state import instrument_key
from ..session import saved

_DATED = {"balance", "adjustment"}  # families with a date of their own
FAMILIES = {"note": sc.NOTE, "decision": sc.EVENT, "balance": sc.BALANCE, "adjustment": sc.ADJUSTMENT}
_FIELDS = {f: [c.split() for c in schema.split(", ") if not c.startswith("issuer ")] for f, schema in FAMILIES.items()}
# dates travel as text, which sorts as they do
_VALUE = {f: ", ".join(f"{n} {'string' if t == 'date' else t}" for n, t in fields) for f, fields in _FIELDS.items()}
_LISTS = {"note": "issues", "decision": "issues", "balance": "balances"}  # state variables of the slots of a series
SETTLED = "issuer bigint, " + _VALUE["adjustment"]


def _present(c: str | Column) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(0)).isNotNull()


def _offers(*offers: tuple[str, bool, Column]) -> Column:
    """Slots a record competes for, by a bar: ``+`` goes before those the latest takes, ``-`` before those the earliest takes."""
    return F.concat_ws("|", *(F.when(fits, F.lit(("+" if latest else "-") + slot)) for slot, latest, fits in offers))


def _rows(df: DataFrame, family: str, time: str, series: Column, target: Column, offers: Column) -> DataFrame:
    """The stream's input: key, place in the order, slots and the record itself, as one text that is cheap to hand over."""
    number = lambda c: F.lpad(F.coalesce(c, F.lit(0)).cast("string"), 19, "0")
    places = [F.col("entry_date").cast("string")] if family in _DATED else []
    places += [number(F.col(c)) for c in ("ord", "part", "pos") if c in [n for n, _ in _FIELDS[family]]]
    record = F.to_json(F.struct(*(F.col(n).cast("string" if t == "date" else t).alias(n) for n, t in _FIELDS[family])))
    return df.select(
        time, "issuer", series.cast("bigint").alias("series"), F.lit(family).alias("family"), F.concat_ws("|", *places).alias("at"),
        target.alias("target"), offers.alias("offers"), record.alias("record"),
    )


def note_rows(notes: DataFrame, *, time: str = "ts") -> DataFrame:
    """Notes: the first record of an instrument gives its place, the last its figures."""
    key = instrument_key(F.col("category"), F.col("series"), F.col("kind"), F.lit(""))
    always = F.lit(True)
    return _rows(notes, "note", time, F.col("series"), key, _offers(("first", False, always), ("last", True, always)))


def decision_rows(decisions: DataFrame, *, time: str = "ts") -> DataFrame:
    """Decisions: bonds keep the first present value of a field, options the last.

    Rights decisions look for one another by share count in their order, so each is kept, under
    the issuer and no series.
    """
    cat = F.col("category")
    rights, option = cat.isin("RIGHTS_ISSUE", "MIXED_ISSUE"), cat == "STOCK_OPTION"
    stated = F.coalesce(F.nullif("shares", F.lit(0)), F.when(option, F.nullif("convertible_shares", F.lit(0))), F.lit(0))
    usable = decisions.where(F.coalesce(~(rights | option), F.lit(False)) | (stated > 0))
    price = F.when(option, F.coalesce(F.nullif("exercise_price", F.lit(0)), F.nullif("conversion_price", F.lit(0)))).otherwise(F.col("conversion_price"))
    values = {
        "price": _present(price), "stated": F.when(option, F.lit(True)).otherwise(_present("convertible_shares")),
        "start": F.col("cv_start") != "", "end": F.col("cv_end") != "",
    }
    first = [(f"first {n}", False, ~rights & ~option & fits) for n, fits in {**values, "face": _present("face_value")}.items()]
    last = [(f"last {n}", True, option & fits) for n, fits in values.items()]
    target = F.when(rights, F.concat(F.lit("RIGHTS "), F.lpad(F.col("ord").cast("string"), 19, "0"))).otherwise(
        instrument_key(cat, F.col("series"), F.col("kind"), F.lit(""))
    )
    offers = _offers(("opening", False, F.lit(True)), *first, *last)
    return _rows(usable, "decision", time, F.when(~rights, F.coalesce("series", F.lit(0))), target, offers)


def balance_rows(balances: DataFrame, *, time: str = "ts") -> DataFrame:
    """Exercise balances: the last present value of each field, and the first that could open an instrument.

    A balance without a series is kept by its price, one of options by issuer.
    """
    option = F.col("type") == sc.OPTION_EXERCISE
    usable = balances.where((option & (F.col("new_shares") > 0)) | (~option & ~F.coalesce("exchangeable", F.lit(False))))
    left = F.when(F.col("has_remaining"), F.col("remaining")).otherwise(F.col("face_value"))
    shares = F.coalesce(F.nullif("convertible_shares", F.lit(0)), F.col("remaining_shares"))
    target = F.when(option, "options").when(F.col("series").isNull(), F.concat(F.lit("price "), F.coalesce(F.col("conversion_price").cast("string"), F.lit("")))).otherwise("series")
    offers = _offers(
        ("option", True, option), ("opening", False, ~option & (_present(left) | _present(shares))),
        ("remaining", True, ~option & left.isNotNull()), ("price", True, ~option & F.col("conversion_price").isNotNull()), ("shares", True, ~option & shares.isNotNull()),
    )
    return _rows(usable, "balance", time, F.when(~option, F.col("series")), target, offers)


def adjustment_rows(adjustments: DataFrame, *, time: str = "ts") -> DataFrame:
    """Price adjustments by series; those without one by issuer."""
    return _rows(adjustments, "adjustment", time, F.col("series"), F.lit(""), _offers())


def state_rows(notes: DataFrame, decisions: DataFrame, balances: DataFrame, adjustments: DataFrame, *, time: str = "ts", reference: str = "reference_date") -> DataFrame:
    """All families as one input. Needs ``time`` and, but for the notes, ``reference`` beside the columns of :mod:`..dilution.schemas`.

    ``reference`` is the date of the issuer's latest periodic report, whose notes the instruments
    start from. Only later decisions count, and none where it is null; only later balances and
    adjustments, and all of them where it is null. Undated ones do not count.
    """
    day, known = F.to_date(time), F.col(reference)
    later = lambda d, c: d.where((known.isNull() & c.isNotNull()) | (c > known))
    parts = [
        note_rows(notes, time=time), decision_rows(decisions.where(day > known), time=time),
        balance_rows(later(balances, F.col("entry_date")), time=time), adjustment_rows(later(adjustments, F.col("entry_date")), time=time),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class RecordKeeper(StatefulProcessor):
    """The records that count of one issuer and series; those without a series have a state of their own.

    A call holds the slots it meets, never the rows: an issuer's events are spread over its
    series, and a series' balances take four slots whatever their number. Every call to the state
    costs far more than a row, so the slots of a series are read and written as two lists, of its
    issues and of its balances; without a series there may be any number of them, so they have a map. Adjustments go straight
    to their map; a timer at the time of the first gives out all that the watermark has passed,
    also when nothing more arrives, and is set again for the next.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._kept = {name: handle.getListState(name, "family string, slot string, at string, record string") for name in dict.fromkeys(_LISTS.values())}
        self._loose = handle.getMapState("loose", "family string, slot string", "at string, record string")
        self._held = handle.getMapState("adjustments", "at string", "due bigint, record string")

    def _take(self, key: tuple, rows: Iterable[Row]) -> None:
        best: dict[str, dict[tuple[str, str], tuple[str, str]]] = {}
        changed: dict[str, set[tuple[str, str]]] = {}
        kept = key[1] is not None  # a series: few slots, as a list
        known = not kept and self._loose.exists()
        first_due = None
        for r in rows:
            family, at, record = r.family, r.at, r.record
            if family == "adjustment":
                due = int(r.due)
                self._held.updateValue((at,), (due, record))
                first_due = due if first_due is None else min(due, first_due)
                continue
            name = _LISTS[family]
            if name not in best:
                best[name] = {(f, s): value for f, s, *value in self._kept[name].get()} if kept else {}
                changed[name] = set()
            slots = best[name]
            for offer in r.offers.split("|") if r.offers else ():
                slot = family, f"{r.target}/{offer[1:]}"
                if known and slot not in slots and self._loose.containsKey(slot):
                    slots[slot] = self._loose.getValue(slot)
                old = slots.get(slot)
                if old is None or (at > old[0] if offer[0] == "+" else at < old[0]):
                    slots[slot] = (at, record)
                    changed[name].add(slot)
        for name, slots in changed.items():
            if kept and slots:
                self._kept[name].put([(*slot, *value) for slot, value in best[name].items()])
            elif slots:
                for slot in slots:
                    self._loose.updateValue(slot, best[name][slot])
        if first_due is not None:
            self._handle.registerTimer(first_due)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._take(key, rows)
        yield from ()

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._take(key, [initialState] if isinstance(initialState, Row) else initialState)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        settled, next_due = [], None
        for at, (due, record) in self._held.iterator():
            if due <= passed:
                settled.append((at, record))
            else:
                next_due = due if next_due is None else min(due, next_due)
        for at, record in settled:
            self._held.removeKey(at)
            fields = json.loads(record)
            yield Row(issuer=key[0], **{n: fields.get(n) for n, _ in _FIELDS["adjustment"]})
        if settled and next_due is not None:
            self._handle.registerTimer(next_due)

    def close(self) -> None:
        pass


def _due(rows: DataFrame, time: str) -> DataFrame:
    return rows.withColumn("due", F.unix_millis(F.col(time).cast("timestamp")) + 1)


def stream_instrument_records(rows: DataFrame, *, time: str = "ts", delay: str = "30 days", start: DataFrame | None = None) -> DataFrame:
    """Settled adjustments (append mode, needs the RocksDB state store); the state holds everything else.

    ``rows`` is :func:`state_rows` of streams. A record may arrive up to ``delay`` after a later
    one. ``start`` is the same of batch tables: the records up to now, from which the stream goes on.
    """
    keyed = _due(rows.withWatermark(time, delay), time).groupBy("issuer", "series")
    first = None if start is None else _due(start, time).drop(time).groupBy("issuer", "series")
    return keyed.transformWithState(
        statefulProcessor=RecordKeeper(), outputStructType=SETTLED, outputMode="Append", timeMode="EventTime", initialState=first
    )


def kept_records(spark: SparkSession, checkpoint: str, settled: DataFrame) -> dict[str, DataFrame]:
    """Notes, decisions, balances and adjustments that count, read from the state of the stream's last batch and its log."""
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    out = {}
    for family, fields in _FIELDS.items():
        if family == "adjustment":
            texts = state("adjustments").select("key.issuer", "user_map_value.record")
        else:
            loose = state("loose").where(F.col("user_map_key.family") == family)
            listed = state(_LISTS[family]).where(F.col("list_element.family") == family)
            texts = listed.select("key.issuer", "list_element.record").unionByName(loose.select("key.issuer", "user_map_value.record"))
        rows = texts.select("issuer", F.from_json("record", _VALUE[family]).alias("r")).select("issuer", *(F.col("r")[n].alias(n) for n, _ in fields))
        if family == "adjustment":
            rows = rows.unionByName(settled.select(*rows.columns))
        # the fold reads its input many times, the state is read once
        out[family] = saved(rows.select("issuer", *(F.col(n).cast(t) for n, t in fields)).distinct(), f"kept_{family}s")
    return out


def instruments_of(records: dict[str, DataFrame]) -> DataFrame:
    """The instruments of kept records, as the batch fold gives them."""
    return fold_instruments(records["note"], records["decision"], records["balance"], records["adjustment"])

"""The streamed state of instruments against a plain reading of the rules."""

import datetime
import json
import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from filingframe.catalog import streams as CS
from filingframe.session import scratch_path
from filingframe.streaming import ingest as I
from filingframe.streaming import instruments as SI

from .test_state import brute, frames, logs, result

DAY = datetime.date(2025, 1, 1)


def rows_of(spark, data, reference="2024-12-31"):
    """Random logs as state rows; a record comes on its day."""
    notes, decisions, balances, adjustments = frames(spark, data)
    ts = lambda day: F.timestamp_seconds(F.unix_timestamp(day) + F.col("ord"))
    first = F.lit(DAY).cast("timestamp")
    more = lambda d, day: d.withColumn("ts", ts(day)).withColumn("reference_date", F.lit(reference).cast("date"))
    dated = F.col("entry_date").cast("timestamp")
    return SI.state_rows(more(notes, first), more(decisions, first), more(balances, dated), more(adjustments, dated))


def streamed(spark, batches, delay, folder=None, start=None):
    source = scratch_path(spark, "rows")
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
    folder = folder or scratch_path(spark, "t2")
    return CS.run_instrument_state(spark, stream, folder, delay, start=start)


@pytest.mark.parametrize("seed,delay", [(2, "400 days"), (3, "400 days"), (4, "1 hour")])
def test_shuffled_records_give_the_batch_state(spark, seed, delay):
    """In any order within the delay, over three batches; with a short delay batches follow the days."""
    data = logs(seed, True)
    rows = rows_of(spark, data)
    part = F.ntile(3).over(Window.orderBy(F.col("ts") if delay == "1 hour" else F.rand(seed)))
    numbered = rows.withColumn("part", part)
    batches = [numbered.where(f"part = {n}").drop("part").orderBy(F.rand(n)) for n in (1, 2, 3)]
    assert result(streamed(spark, batches, delay)) == brute(*data)


def test_quiet_issuer_settles_without_a_new_record(spark):
    """Adjustments leave the state once the watermark has passed them, though nothing of their issuer follows."""
    data = logs(2, True)
    rows = rows_of(spark, data)
    late = rows.where("issuer = 0").limit(1).withColumn("ts", F.lit("2025-06-01").cast("timestamp"))
    folder = scratch_path(spark, "t2")
    assert result(streamed(spark, [rows, late], "2 days", folder)) == brute(*data)
    held = spark.read.format("statestore").option("stateVarName", "adjustments").load(f"{folder}/checkpoint")
    assert held.count() == 0
    assert spark.read.schema(SI.SETTLED).parquet(f"{folder}/settled").count() == len(data[3]) > 0


@pytest.mark.parametrize("cut", [1, 4, 6])
def test_stream_goes_on_from_a_batch_state(spark, cut):
    """Records up to a day are handed over, the later ones arrive; together they give the batch state of all."""
    data = logs(3, True)
    rows = rows_of(spark, data)
    day = F.lit(DAY + datetime.timedelta(cut)).cast("timestamp")
    got = streamed(spark, [rows.where(F.col("ts") >= day)], "30 days", start=rows.where(F.col("ts") < day))
    assert result(got) == brute(*data)


def test_reference_date(spark):
    """Records up to the date of the report do not count; without a date decisions do not."""
    data = logs(4, True)
    cut = DAY + datetime.timedelta(3)
    later = [r for r in data[2] if r["entry_date"] > cut], [r for r in data[3] if r["entry_date"] > cut]
    got = streamed(spark, [rows_of(spark, data, str(cut))], "400 days")
    assert result(got) == brute(data[0], [], *later)
    assert result(streamed(spark, [rows_of(spark, data, None)], "400 days")) == brute(data[0], [], data[2], data[3])


def test_state_does_not_grow_with_the_balances_of_a_series(spark):
    """An issuer with nearly all events: what is kept of a series are a handful of records."""
    ex = lambda i: dict(issuer=1, entry_date=DAY, ord=i, pos=0, type="전환청구권행사", exchangeable=False, series=1 + i % 3, has_remaining=True, remaining=i, face_value=9, conversion_price=500 + i, convertible_shares=i % 7, remaining_shares=None, new_shares=None)
    data = [], [], [ex(i) for i in range(600)], []
    folder = scratch_path(spark, "t2")
    assert result(streamed(spark, [rows_of(spark, data)], "400 days", folder)) == {k: v for k, v in brute(*data).items()}
    kept = spark.read.format("statestore").option("stateVarName", "balances").load(f"{folder}/checkpoint")
    assert sorted(r["n"] for r in kept.groupBy("key").agg(F.count("*").alias("n")).collect()) == [4, 4, 4]


def test_events_in_small_batches(spark, sf):
    """The event table in three batches and in one gives the same instruments."""
    source = scratch_path(spark, "events")
    events = spark.read.parquet(f"{sf}/events.parquet")
    for n in range(3):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == n).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(CS._SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    key = lambda df: {(r["issuer"], r["instrument_key"]): tuple(r) for r in df.collect()}
    assert key(CS.run_instrument_state(spark, CS.record_rows(stream), scratch_path(spark, "t2"), "60 days")) == key(CS.t2(spark, sf))


def test_latest_filing_over_batches(spark):
    """Twelve batches in no order: one state row per issuer, and a repeated batch changes nothing."""
    source, checkpoint = scratch_path(spark, "in"), scratch_path(spark, "checkpoint")
    schema = "issuer string, rcept_dt string, rcept_no string, kind string"
    rng = random.Random(1)
    rows = [(rng.choice("abcde"), f"2024-01-{rng.randint(1, 28):02d}", f"{i:04d}", f"k{i}") for i in range(60)]
    for i in range(0, 60, 5):
        spark.createDataFrame(rows[i : i + 5], schema).coalesce(1).write.mode("append").parquet(source)
    latest = I.stream_latest_filing(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))

    def run():
        writer = latest.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, I.latest_filings(spark, checkpoint, columns=latest.columns).collect()))

    want = sorted(max((r for r in rows if r[0] == i), key=lambda r: r[1:3]) for i in "abcde")
    assert run() == want
    assert spark.read.format("statestore").load(checkpoint).count() == 5
    for name in ("11", ".11.crc"):  # as if the driver had gone before the last batch was noted
        os.remove(checkpoint.removeprefix("file:") + "/commits/" + name)
    assert run() == want


class Counted:
    """A handle whose states live in this process and count the calls that reach them."""

    class State(dict):
        def __init__(self, calls):
            self.calls = calls

        def __getattribute__(self, name):
            if name in ("exists", "get", "put", "containsKey", "getValue", "updateValue", "removeKey", "iterator"):
                self.calls.append(name)
            return super().__getattribute__(name)

        def exists(self): return len(self) > 0
        def get(self): return iter(dict.get(self, "list", []))
        def put(self, rows): self["list"] = list(rows)
        def containsKey(self, key): return key in self
        def getValue(self, key): return dict.get(self, key)
        def updateValue(self, key, value): self[key] = value
        def removeKey(self, key): del self[key]
        def iterator(self): return iter(list(self.items()))

    def __init__(self):
        self.calls, self.timers = [], []

    def getListState(self, name, schema): return self.State(self.calls)
    def getMapState(self, name, *schemas): return self.State(self.calls)
    def registerTimer(self, due): self.timers.append(due)


def test_calls_to_the_state_do_not_grow_with_the_slots():
    """A series' slots are read and written as a list, its adjustments wait for one timer, which is set again for the next."""
    fields = ("family", "at", "target", "offers", "record", "due")
    row = lambda *v: Row(**dict(zip(fields, v, strict=True)))
    keeper, handle = SI.RecordKeeper(), Counted()
    keeper.init(handle)
    note = [row("note", f"{i:03d}", f"t{i % 9}", "-first|+last", f"n{i}", 0) for i in range(90)]
    wait = [row("adjustment", f"{i:03d}", "", "", json.dumps({"ord": i}), 1000 + i) for i in range(20)]
    list(keeper.handleInputRows((1, 2), iter(note + wait), None))
    assert sorted(handle.calls) == ["get", "put"] + ["updateValue"] * 20 and handle.timers == [1000]
    kept = {(slot, record) for _, slot, _, record in keeper._kept["issues"].get()}
    assert kept == {(f"t{i}/first", f"n{i}") for i in range(9)} | {(f"t{i}/last", f"n{81 + i}") for i in range(9)}
    passed = lambda now: SimpleNamespace(getCurrentWatermarkInMs=lambda: now)
    timer = SimpleNamespace(getExpiryTimeInMs=lambda: 1000)
    assert [r.ord for r in keeper.handleExpiredTimer((1, 2), passed(1011), timer)] == list(range(12)) and handle.timers == [1000, 1012]
    assert [r.ord for r in keeper.handleExpiredTimer((1, 2), passed(9999), timer)] == list(range(12, 20)) and handle.timers == [1000, 1012]
    list(keeper.handleInputRows((1, None), iter([row("decision", "7", "r", "-opening", "late", 0)]), None))
    list(keeper.handleInputRows((1, None), iter([row("decision", "5", "r", "-opening", "early", 0), row("decision", "6", "r", "-opening", "later", 0)]), None))
    assert keeper._loose == {("decision", "r/opening"): ("5", "early")}

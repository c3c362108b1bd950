"""Streaming queries, run to completion over the event table, and the assembled report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import report as RP
from ..session import scratch_path
from ..streaming import ingest as I
from ..streaming import instruments as SI
from . import disclosures as CD
from . import proxies as X
from .registry import QUERIES, SQL, query

DISC = "WITH " + X.DISC_SQL
_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, sf):
    return spark.readStream.schema(_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf)


def _finish(spark, writer, path: str | None = None) -> None:
    """Run a stream over all the data there is and wait for it."""
    q = writer.option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start(path)
    q.awaitTermination()


@query("t1_stream_dedup_ingest", "SELECT user_id issuer, event_type kind, strftime(CAST(ts AS DATE),'%Y-%m-%d') AS day, count(*)>0 seen FROM events GROUP BY ALL")
def t1(spark, sf):
    """One entry per issuer, kind and day; the delay covers the day."""
    e = _events(spark, sf)
    entries = e.select(F.col("user_id").alias("issuer"), F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("ts"))
    out = I.stream_dedup_ingest(entries, keys=["issuer", "kind", "day"], delay="2 days")
    path = scratch_path(spark, "t1")
    _finish(spark, out.select("issuer", "kind", "day", F.lit(True).alias("seen")).writeStream.format("parquet").outputMode("append"), path)
    return spark.read.parquet(path)


@query("t3_stream_latest_filing", "SELECT user_id issuer, strftime(ts,'%Y-%m-%d') rcept_dt, lpad(CAST(event_id AS VARCHAR),12,'0') rcept_no, event_type kind FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts,'%Y-%m-%d') DESC, event_id DESC)=1")
def t3(spark, sf):
    f = _events(spark, sf).select(
        F.col("user_id").alias("issuer"), F.date_format("ts", "yyyy-MM-dd").alias("rcept_dt"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("rcept_no"), F.col("event_type").alias("kind")
    )
    checkpoint = scratch_path(spark, "t3")
    writer = I.stream_latest_filing(f).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return I.latest_filings(spark, checkpoint, columns=f.columns)


def reference_date(issuer):
    """Date of the latest periodic report; some issuers have none."""
    return F.when(issuer % 5 != 0, F.date_add(F.lit("2024-01-02").cast("date"), (issuer % 9).cast("int")))


def record_rows(events):
    """State rows of raw events, a table or a stream."""
    d = X.disc_of(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts").withColumn("reference_date", reference_date(F.col("issuer")))
    more = ("ts", "reference_date")
    return SI.state_rows(CD.notes_of(d, *more), CD.decisions_of(d, *more), CD.exercises_of(d, *more), CD.adjustments_of(d, *more))


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_instrument_state(spark, rows, folder: str, delay: str, start=None):
    """The stream of records run to its end, and the instruments of what it has kept.

    The folder holds the stream's checkpoint with its state, and the log of settled adjustments.
    """
    before = spark.conf.get(ROCKSDB[0])
    spark.conf.set(*ROCKSDB)  # read when the stream starts
    try:
        settled = SI.stream_instrument_records(rows, delay=delay, start=start)
        writer = settled.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).start(f"{folder}/settled").awaitTermination()
    finally:
        spark.conf.set(ROCKSDB[0], before)
    log = spark.read.schema(settled.schema).parquet(f"{folder}/settled")
    return SI.instruments_of(SI.kept_records(spark, f"{folder}/checkpoint", log)).select(*CD.OUT)


_REFERENCE = "(issuer%5<>0 AND entry_date > DATE '2024-01-02' + CAST(issuer%9 AS INTEGER)) OR (issuer%5=0 AND kind<>'view')"


@query("t2_stream_instrument_state", CD.walk_sql(_REFERENCE))
def t2(spark, sf):
    """Instruments of the event stream: records kept by issuer and series, adjustments settled in their order."""
    return run_instrument_state(spark, record_rows(_events(spark, sf)), scratch_path(spark, "t2"), delay="30 days")


# tables across the page -> (query they come from, order of their rows, columns shown, fields)
_TABLES = {
    "quarters": ("e7_quarterly_rows", ["period"], 8, ["period", "revenue_cell", "operating_income_cell", "net_income_cell"]),
    "years": ("e7_annual_rows", ["fy"], 5, ["fy", "revenue_cell", "operating_income_cell", "net_income_cell"]),
    "backlog": ("e12_backlog_series", ["period"], 8, ["period", "total", "breakdown", "yoy"]),
}
# tables of any length -> (query, order, coarsening of the order, fields)
_DETAILS = {
    "balance": ("e6_balance_sheet_rows", ["fy", "fq", "row_no"], "fy", ["fy", "fq", "row_no", "item", "amount", "previous_amount", "note"]),
    "overhang": ("v8_overhang_table", ["category_label", "instrument_key"], "category_label", ["instrument_key", "category_label", "remaining_amount", "exercise_price", "dilution_ratio", "exercise_period"]),
    "contracts": ("e8_contract_rows", ["ord"], "floor(ord / 4096)", ["ord", "contract_type", "amount_eok", "revenue_ratio_pct", "contract_period"]),
}
_SCALARS = {
    "pbr": "e2_pbr", "trailing_per": "e3_trailing_per", "forward_per": "e4_forward_per", "fully_diluted": "e5_fully_diluted_cap",
    "low_price": "a7_price_summary_short", "high_price": "a7_price_summary_short", "return_label": "a7_price_summary_short",
}


def _report_sql() -> str:
    parts = [f"SELECT issuer, '{c}' AS section, 1 pos, CAST({c} AS VARCHAR) AS row FROM ({SQL[q]}) s WHERE {c} IS NOT NULL" for c, q in _SCALARS.items()]
    cells = lambda columns: "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in columns) + ")"
    number = lambda order: f"row_number() OVER (PARTITION BY issuer ORDER BY {', '.join(order)})"
    for name, (q, order, n, columns) in _TABLES.items():
        latest = number([f"{c} DESC" for c in order])
        parts.append(f"SELECT issuer, '{name}', {number(order)} pos, {cells(columns)} FROM (SELECT * FROM ({SQL[q]}) t QUALIFY {latest} <= {n}) u")
    for name, (q, order, _, columns) in _DETAILS.items():
        parts.append(f"SELECT issuer, '{name}', {number(order)} pos, {cells(columns)} FROM ({SQL[q]}) t")
    return " UNION ALL ".join(parts)


@query("e15_assemble_report", _report_sql())
def e15(spark, sf):
    """Report of every issuer as lines: the record of scalars, years, quarters and backlog, then all balance items, instruments and contracts."""
    of = lambda q, columns: QUERIES[q](spark, sf).select("issuer", *columns)
    tables = {name: (of(q, columns), order, n) for name, (q, order, n, columns) in _TABLES.items()}
    scalars = [of(q, [c for c in _SCALARS if _SCALARS[c] == q]) for q in dict.fromkeys(_SCALARS.values())]
    ids = [df.select("issuer") for df in (*scalars, *(t[0] for t in tables.values()))]
    issuers = ids[0]
    for other in ids[1:]:
        issuers = issuers.unionByName(other)
    lines = RP.report_rows(RP.assemble_report(issuers.distinct(), scalars, tables), list(_SCALARS), list(tables))
    for name, (q, order, slot, columns) in _DETAILS.items():
        lines = lines.unionByName(RP.detail_lines(of(q, columns), name, order=order, slot=F.expr(slot)))
    return lines

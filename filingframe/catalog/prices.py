"""Queries on daily prices and valuation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import windows as W
from ..plans import valuation as V
from ..session import scratch_path
from ..sources import readers as R
from ..sources import store as SO
from . import proxies as X
from . import sqltext as Q
from .registry import query

PX = "WITH " + X.PX_SQL
BARS = "WITH " + X.BARS_SQL
DAY = "strftime({}, '%Y-%m-%d')"


@query(
    "s7_scan_daily_prices",
    PX + f""" SELECT issuer, {DAY.format('trade_date')} AS day, "open", high, low, "close", volume FROM (
      SELECT *, 2 page FROM px UNION ALL SELECT issuer, trade_date, "open", high, low, "close" + CASE WHEN issuer%3=0 THEN 9 ELSE -9 END, volume, 1 FROM px WHERE issuer%2=0) b
    QUALIFY row_number() OVER (PARTITION BY issuer, trade_date ORDER BY page)=1""",
)
def s7(spark, sf):
    """Half of the issuers have every bar on two pages, the newer one higher for some and lower for others."""
    older = X.px(spark, sf).withColumn("page", F.lit(2))
    moved = F.when(F.col("issuer") % 3 == 0, 9).otherwise(-9)
    newer = older.where("issuer % 2 = 0").withColumns({"close": F.col("close") + moved, "page": F.lit(1)})
    pages = older.unionByName(newer).withColumn("close", F.format_number("close", 0))
    out = R.scan_daily_prices(pages, page="page")
    return out.select("issuer", F.date_format("trade_date", "yyyy-MM-dd").alias("day"), "open", "high", "low", "close", "volume")


def _price_store(spark, sf):
    """Daily bars in a store by issuer, partitioned by week."""
    bars = X.px(spark, sf).select("issuer", "trade_date", "close", "volume", F.date_trunc("week", "trade_date").cast("date").alias("week"))
    store = SO.new_store(spark, scratch_path(spark, "prices"), keys=["issuer"], period=["week"])
    SO.append(bars, store)
    return SO.read(spark, store)


@query(
    "s7_store_price_range",
    PX + """ SELECT issuer, count(*) AS n, CAST(sum("close") AS BIGINT) AS closes, CAST(max("close") AS BIGINT) AS highest FROM px
    WHERE trade_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-19' GROUP BY issuer""",
)
def s7_range(spark, sf):
    """A range of days reads two weeks of the store; the sums by issuer need no shuffle."""
    rows = _price_store(spark, sf).where("week between date_trunc('week', date'2024-01-10') and date'2024-01-19' and trade_date between date'2024-01-10' and date'2024-01-19'")
    return rows.groupBy("issuer").agg(F.count("*").alias("n"), F.sum("close").cast("bigint").alias("closes"), F.max("close").cast("bigint").alias("highest"))


@query(
    "s7_store_price_as_of",
    PX + """, due AS (SELECT DISTINCT issuer, DATE '2024-01-08' + CAST(issuer % 12 AS INTEGER) AS day FROM px WHERE issuer % 4 = 0)
    SELECT issuer, CAST(arg_max("close", trade_date) AS BIGINT) AS last_close, count(*) AS n FROM px JOIN due USING (issuer)
    WHERE trade_date <= day AND trade_date > day - 7 GROUP BY issuer""",
)
def s7_as_of(spark, sf):
    """The last close of the week up to a day that each issuer has of its own: the days due decide which weeks are read."""
    issuers = X.px(spark, sf).select("issuer").distinct().where("issuer % 4 = 0")
    day = F.date_add(F.lit("2024-01-08").cast("date"), (F.col("issuer") % 12).cast("int"))
    first = F.date_trunc("week", F.date_sub(day, 6)).cast("date")
    weeks = F.array_distinct(F.array(first, F.date_trunc("week", day).cast("date")))
    due = issuers.select("issuer", day.alias("day"), F.explode(weeks).alias("week"))
    rows = _price_store(spark, sf).join(due, ["issuer", "week"]).where((F.col("trade_date") <= F.col("day")) & (F.col("trade_date") > F.date_sub("day", 7)))
    return rows.groupBy("issuer").agg(F.max_by("close", "trade_date").cast("bigint").alias("last_close"), F.count("*").alias("n"))


_MA = 'CASE WHEN count("close") OVER w{n}={n} THEN CAST(sum("close") OVER w{n} AS DOUBLE)/{n} END ma{n}'
_WIN = "w{n} AS (PARTITION BY issuer ORDER BY trade_date ROWS BETWEEN {m} PRECEDING AND CURRENT ROW)"


@query(
    "w3_moving_average",
    BARS + f" SELECT issuer, {DAY.format('trade_date')} AS day, \"close\", ma20, ma60 FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY trade_date DESC) rn, {_MA.format(n=20)}, {_MA.format(n=60)} FROM bars"
    f" WINDOW {_WIN.format(n=20, m=19)}, {_WIN.format(n=60, m=59)}) x WHERE rn<=250",
)
def w3(spark, sf):
    out = W.moving_average(X.bars(spark, sf), spans=(20, 60), last_n=250)
    return out.select("issuer", F.date_format("trade_date", "yyyy-MM-dd").alias("day"), "close", "ma20", "ma60")


def _summary(src: str, as_of: str, years: int) -> str:
    return f"""s AS (SELECT issuer, min(trade_date) p0, max(trade_date) p1, arg_min("close", trade_date) start_price, arg_max("close", trade_date) current_price,
    min("close") low_price, max("close") high_price, count(*) n FROM (SELECT * FROM {src} WHERE trade_date >= DATE '{as_of}' - {365 * years}) f GROUP BY issuer)
  SELECT s.issuer, {DAY.format('p0')} period_start, {DAY.format('p1')} period_end, start_price, current_price, low_price,
    (SELECT {DAY.format('min(trade_date)')} FROM {src} x WHERE x.issuer=s.issuer AND x."close"=low_price AND trade_date>=p0) low_date, high_price,
    (SELECT {DAY.format('min(trade_date)')} FROM {src} x WHERE x.issuer=s.issuer AND x."close"=high_price AND trade_date>=p0) high_date,
    round(CAST(current_price-start_price AS DOUBLE)/start_price*100, 6) return_pct,
    CASE WHEN (p1-p0) < {365 * years}*0.9 THEN '상장후수익률' ELSE '1년수익률' END return_label FROM s WHERE n>=2 AND start_price>0 AND current_price>0"""


def _price_summary(bars, as_of: str, years: int = 1):
    out = A.price_summary(bars, as_of=F.lit(as_of).cast("date"), years=years)
    days = {c: F.date_format(c, "yyyy-MM-dd") for c in ("period_start", "period_end", "low_date", "high_date")}
    return out.withColumns({**days, "return_pct": F.round("return_pct", 6)}).drop("n_days")


@query("a7_price_summary", BARS + "," + _summary("bars", "2001-06-30", 1))
def a7(spark, sf):
    return _price_summary(X.bars(spark, sf), "2001-06-30")


@query("a7_price_summary_short", PX + "," + _summary("px", "2024-01-30", 1))
def a7b(spark, sf):
    return _price_summary(X.px(spark, sf), "2024-01-30")


@query("a8_mean_estimate", f"WITH e AS (SELECT user_id issuer, CASE WHEN event_id%6<>0 THEN CAST(round(value*100) AS BIGINT)-3000 END v FROM events) SELECT issuer, {Q.floor_div('CAST(sum(v) AS BIGINT)', 'count(v)')} mean_estimate FROM e GROUP BY ALL")
def a8(spark, sf):
    e = X.table(spark, sf, "events").select(
        F.col("user_id").alias("issuer"), F.when(F.col("event_id") % 6 != 0, X.cents("value") - 3000).alias("v")
    )
    return A.mean_estimate(e, keys=["issuer"], value="v")


# -- valuation -----------------------------------------------------------------------------------

_MARKET = """market0 AS (SELECT issuer%25 issuer, arg_max("close", trade_date*1000+issuer) * 10 stock_price FROM (SELECT issuer, "close", epoch(trade_date)//86400 trade_date FROM px) p GROUP BY ALL),
market AS (SELECT issuer, stock_price, CASE WHEN issuer%5=0 THEN NULL ELSE stock_price*(1000000+issuer*777)+55 END market_cap,
    CASE WHEN issuer%4=0 THEN NULL ELSE 2000000+issuer*1001 END shares_outstanding FROM market0),
valued AS (SELECT issuer, stock_price, s shares_outstanding, coalesce(market_cap, stock_price*s) market_cap, CASE WHEN stock_price>0 AND s>0 THEN stock_price*s END AS value
  FROM (SELECT *, coalesce(shares_outstanding, CASE WHEN market_cap>0 AND stock_price>0 THEN market_cap//stock_price END) s FROM market) m)"""


def _market(spark, sf):
    i = F.col("issuer")
    day = F.date_diff("trade_date", F.lit("1970-01-01").cast("date"))
    last = X.px(spark, sf).groupBy((i % 25).alias("issuer")).agg(
        (F.max_by("close", F.struct(day, i)) * 10).alias("stock_price")
    )
    return last.select(
        "issuer", "stock_price",
        F.when(i % 5 != 0, F.col("stock_price") * (1_000_000 + i * 777) + 55).alias("market_cap"),
        F.when(i % 4 != 0, 2_000_000 + i * 1001).alias("shares_outstanding"),
    )


VALUED = "WITH " + X.PX_SQL + "," + _MARKET


@query("e1_market_cap", VALUED + " SELECT * FROM valued")
def e1(spark, sf):
    return V.market_cap(_market(spark, sf)).select("issuer", "stock_price", "shares_outstanding", "market_cap", "value")


_FULL = VALUED + "," + X.QUARTERS_SQL + "," + X.ANNUAL_SQL
_CCY = "CASE WHEN issuer%7=0 THEN 'USD' ELSE 'KRW' END"


def _valued(spark, sf):
    ccy = F.when(F.col("issuer") % 7 == 0, F.lit("USD")).otherwise(F.lit("KRW"))
    return V.market_cap(_market(spark, sf)).withColumn("currency", ccy)


def _dec(x: str, n: int) -> str:
    return f"CAST(CAST(round_even({x},{n}) AS DECIMAL(30,{n})) AS VARCHAR)"


_EOKV = Q.thousands(Q.eok("value"))


@query(
    "e2_pbr",
    _FULL + f""", q AS (SELECT issuer, CAST(sum(net_income) AS BIGINT)*20 eq FROM annual GROUP BY ALL)
    SELECT v.issuer, coalesce(CASE WHEN value>0 AND c='KRW' AND eq>0 THEN {_dec('CAST(value AS DOUBLE)/eq', 2)}||'배 (시가총액 '||{_EOKV}||' 억원 / 자본총계 '||{Q.thousands(Q.eok('eq'))}||' 억원)'
      WHEN value>0 AND c<>'KRW' THEN '산출불가 (재무제표 '||c||' 기준, 시가총액 '||{_EOKV}||' 억원)' END,'') pbr
    FROM (SELECT *, {_CCY} c FROM valued) v LEFT JOIN q ON q.issuer=v.issuer""",
)
def e2(spark, sf):
    eq = X.annual(spark, sf).groupBy("issuer").agg((F.sum("net_income") * 20).alias("equity"))
    v = _valued(spark, sf).join(eq, "issuer", "left")
    return v.select("issuer", V.pbr(F.col("value"), F.col("equity"), F.col("currency")).alias("pbr"))


@query(
    "e3_trailing_per",
    _FULL + f""", q AS (SELECT issuer, max(fy) FILTER (WHERE net_income IS NOT NULL) y, arg_max(net_income, fy) FILTER (WHERE net_income IS NOT NULL) ni FROM annual GROUP BY ALL)
    SELECT v.issuer, coalesce(CASE WHEN value>0 AND c='KRW' THEN CASE WHEN ni>0 THEN {_dec('CAST(value AS DOUBLE)/ni', 1)}||'배 (시가총액 '||{_EOKV}||' 억원 / '||y||'년 순이익 '||{Q.thousands(Q.eok('ni'))}||' 억원)'
      WHEN ni IS NOT NULL THEN '해당없음 ('||y||'년 순손실)' END WHEN value>0 AND c<>'KRW' THEN '산출불가 (재무제표 '||c||' 기준)' END,'') trailing_per
    FROM (SELECT *, {_CCY} c FROM valued) v LEFT JOIN q ON q.issuer=v.issuer""",
)
def e3(spark, sf):
    inc = V.latest_annual_income(X.annual(spark, sf))
    v = _valued(spark, sf).join(inc, "issuer", "left")
    return v.select(
        "issuer", V.trailing_per(F.col("value"), F.col("annual_net_income"), F.col("income_fy"), F.col("currency")).alias("trailing_per")
    )


@query(
    "e4_forward_per",
    _FULL + f""", q AS (SELECT issuer, net_income ni FROM annual WHERE fy=2000), r AS (SELECT issuer%25 issuer, sum("close")*1000 est FROM px WHERE issuer%3=0 GROUP BY ALL)
    SELECT v.issuer, coalesce(CASE WHEN value>0 AND e IS NOT NULL THEN {_dec('CAST(value AS DOUBLE)/e', 1)}||'배 (시가총액 '||{_EOKV}||' 억원 / 2000E 순이익 '||{Q.thousands(Q.eok('e'))}||' 억원)' END,'') forward_per
    FROM (SELECT v.issuer, value, coalesce(CASE WHEN ni>0 THEN ni END, CASE WHEN est>0 THEN est END) e FROM valued v LEFT JOIN q ON q.issuer=v.issuer LEFT JOIN r ON r.issuer=v.issuer) v""",
)
def e4(spark, sf):
    cons = X.annual(spark, sf).where("fy = 2000").select("issuer", F.col("net_income").alias("consensus"))
    research = X.px(spark, sf).where("issuer % 3 = 0").groupBy((F.col("issuer") % 25).alias("issuer")).agg((F.sum("close") * 1000).alias("research"))
    v = _valued(spark, sf).join(cons, "issuer", "left").join(research, "issuer", "left")
    return v.select("issuer", V.forward_per(F.col("value"), F.col("consensus"), F.col("research"), F.lit(2000)).alias("forward_per"))


@query(
    "e5_fully_diluted_cap",
    VALUED + "," + X.DISC_SQL + """, d AS (SELECT issuer%25 issuer, CAST(sum(shares) AS BIGINT) ds FROM disc WHERE kind='signup' GROUP BY ALL)
    SELECT v.issuer, (shares_outstanding+coalesce(ds,0))*stock_price fully_diluted FROM valued v LEFT JOIN d ON d.issuer=v.issuer""",
)
def e5(spark, sf):
    dil = X.disc(spark, sf).where("kind = 'signup'").groupBy((F.col("issuer") % 25).alias("issuer")).agg(F.sum("shares").alias("ds"))
    v = _valued(spark, sf).join(dil, "issuer", "left")
    return v.select("issuer", V.fully_diluted_cap(F.col("stock_price"), F.col("shares_outstanding"), F.col("ds")).alias("fully_diluted"))



"""Filing-shaped inputs derived from the generic test tables, in Spark and in SQL.

``stmt``   quarterly figures per issuer (orders of a nation's customers), some absent
``annual`` yearly figures, ``cum`` year-to-date figures
``lines``  long statement lines with labels, bases and currencies
``disc``   disclosure log (events), ``px`` daily bars (events), ``bars`` long daily bars (lineitem)
``news``   articles (documents)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEASURES = ["revenue", "operating_income", "net_income"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str | Column) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * 100).cast("bigint")


# -- statements ----------------------------------------------------------------------------------


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(issuer, fy, fq) sums without gaps."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    won = cents("o_totalprice") * 13
    prio = F.substring("o_orderpriority", 1, 1)
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.col("c_nationkey").cast("bigint").alias("issuer"),
            F.year("o_orderdate").cast("bigint").alias("fy"),
            F.quarter("o_orderdate").cast("bigint").alias("fq"),
        )
        .agg(
            F.sum(won).alias("revenue"),
            F.sum(F.when(F.col("o_orderstatus") == "O", -won).otherwise(won)).alias("operating_income"),
            F.sum(F.when(prio.isin("1", "2"), won * 3).otherwise(won * -2)).alias("net_income"),
        )
    )


QUARTERS_SQL = """
quarters AS (
  SELECT CAST(c_nationkey AS BIGINT) issuer, CAST(year(o_orderdate) AS BIGINT) fy,
    CAST(quarter(o_orderdate) AS BIGINT) fq,
    CAST(sum(won) AS BIGINT) revenue,
    CAST(sum(CASE WHEN o_orderstatus='O' THEN -won ELSE won END) AS BIGINT) operating_income,
    CAST(sum(CASE WHEN o_orderpriority[1] IN ('1','2') THEN won*3 ELSE won*-2 END) AS BIGINT) net_income
  FROM (SELECT *, CAST(round(o_totalprice*100) AS BIGINT)*13 won FROM orders) o
  JOIN customer ON o_custkey=c_custkey GROUP BY ALL)"""


def _blank(c: str, when: Column) -> Column:
    return F.when(~when, F.col(c)).alias(c)


def _slot() -> Column:
    return F.col("fy") * 4 + F.col("fq")


def stmt(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Quarterly figures with absent periods, absent fields and wholly empty rows."""
    i, slot = F.col("issuer"), _slot()
    empty = (i + slot) % 23 == 0
    return (base or quarters(spark, sf_dir)).where((i * 11 + slot) % 29 != 0).select(
        "issuer",
        "fy",
        "fq",
        _blank("revenue", empty | ((i * 3 + slot) % 19 == 0)),
        _blank("operating_income", empty | ((i * 7 + slot) % 13 == 0)),
        _blank("net_income", empty | ((i * 5 + slot) % 17 == 0)),
    )


STMT_SQL = QUARTERS_SQL + """,
stmt AS (
  SELECT issuer, fy, fq,
    CASE WHEN (issuer+fy*4+fq)%23=0 OR (issuer*3+fy*4+fq)%19=0 THEN NULL ELSE revenue END revenue,
    CASE WHEN (issuer+fy*4+fq)%23=0 OR (issuer*7+fy*4+fq)%13=0 THEN NULL ELSE operating_income END operating_income,
    CASE WHEN (issuer+fy*4+fq)%23=0 OR (issuer*5+fy*4+fq)%17=0 THEN NULL ELSE net_income END net_income
  FROM quarters WHERE (issuer*11+fy*4+fq)%29<>0)"""


def annual(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    i, fy = F.col("issuer"), F.col("fy")
    sums = (base or quarters(spark, sf_dir)).groupBy("issuer", "fy").agg(*(F.sum(m).alias(m) for m in MEASURES))
    return sums.select(
        "issuer",
        "fy",
        _blank("revenue", (i + fy) % 9 == 0),
        _blank("operating_income", (i * 2 + fy) % 7 == 0),
        _blank("net_income", (i * 3 + fy) % 8 == 0),
    )


ANNUAL_SQL = """
annual AS (
  SELECT issuer, fy,
    CASE WHEN (issuer+fy)%9=0 THEN NULL ELSE revenue END revenue,
    CASE WHEN (issuer*2+fy)%7=0 THEN NULL ELSE operating_income END operating_income,
    CASE WHEN (issuer*3+fy)%8=0 THEN NULL ELSE net_income END net_income
  FROM (SELECT issuer, fy, CAST(sum(revenue) AS BIGINT) revenue,
      CAST(sum(operating_income) AS BIGINT) operating_income, CAST(sum(net_income) AS BIGINT) net_income
    FROM quarters GROUP BY ALL) q)"""


def cum(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Year-to-date figures after 1..4 quarters, with gaps."""
    i, slot = F.col("issuer"), _slot()
    w = Window.partitionBy("issuer", "fy").orderBy("fq").rowsBetween(Window.unboundedPreceding, 0)
    run = (base or quarters(spark, sf_dir)).select(
        "issuer", "fy", "fq", *(F.sum(m).over(w).alias(m) for m in MEASURES)
    )
    empty = (i * 13 + slot) % 31 == 0
    return run.select(
        "issuer",
        "fy",
        "fq",
        _blank("revenue", empty | ((i + slot) % 17 == 0)),
        _blank("operating_income", empty | ((i * 3 + slot) % 11 == 0)),
        _blank("net_income", empty | ((i * 2 + slot) % 9 == 0)),
    )


CUM_SQL = """
cum AS (
  SELECT issuer, fy, fq,
    CASE WHEN (issuer*13+fy*4+fq)%31=0 OR (issuer+fy*4+fq)%17=0 THEN NULL ELSE revenue END revenue,
    CASE WHEN (issuer*13+fy*4+fq)%31=0 OR (issuer*3+fy*4+fq)%11=0 THEN NULL ELSE operating_income END operating_income,
    CASE WHEN (issuer*13+fy*4+fq)%31=0 OR (issuer*2+fy*4+fq)%9=0 THEN NULL ELSE net_income END net_income
  FROM (SELECT issuer, fy, fq,
      CAST(sum(revenue) OVER w AS BIGINT) revenue, CAST(sum(operating_income) OVER w AS BIGINT) operating_income,
      CAST(sum(net_income) OVER w AS BIGINT) net_income
    FROM quarters WINDOW w AS (PARTITION BY issuer, fy ORDER BY fq)) q)"""

# Statement labels by issuer, (ord, sj_div, labels by issuer % 3, factor on revenue).
_LINE_SPEC = [
    (1, "BS", ("자산총계", "자산총계", "자산총계"), 9),
    (2, "BS", ("현금및현금성자산", "현금및현금성자산 ", "현금및현금성자산"), 2),
    (3, "BS", ("단기금융상품", "단기금융상품", "기타금융자산"), 1),
    (4, "BS", ("부채총계", "부채총계", "자본과부채총계"), 5),
    (5, "BS", ("단기차입금", "유동성차입금", "차입금"), 1),
    (6, "BS", ("유동성장기부채", "유동성장기차입금", "차입금"), 2),
    (7, "BS", ("유동성전환사채", "전환사채", "유동성사채"), 1),
    (8, "BS", ("장기차입금", "비유동 차입금", "기타비유동부채"), 3),
    (9, "BS", ("사채", "비유동사채", "전환사채"), 1),
    (10, "BS", ("자본총계", "자본총계", "자본 총계"), 4),
    (11, "CIS", ("매출액", "영업수익", "수익(매출액)"), 1),
    (12, "CIS", ("매출원가", "매출총이익", "매출원가"), 1),
    (13, "CIS", ("영업이익(손실)", "영업이익", "영업손익"), 0),
    (14, "IS", ("당기순이익(손실)", "지배기업 당기순이익", "분기순이익"), 0),
]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long statement lines per (issuer, fy, report_code, fs_div)."""
    base = cum_raw(spark, sf_dir)
    i = F.col("issuer")
    label_no = (i % 3).cast("int")
    items = F.array(
        *(
            F.struct(
                F.lit(o).cast("bigint").alias("ord"),
                F.lit(sj).alias("sj_div"),
                F.element_at(F.array(*(F.lit(x) for x in labels)), label_no + 1).alias("account_nm"),
                (F.col("revenue") * k if k else F.col("operating_income" if o == 13 else "net_income")).alias("v"),
            )
            for o, sj, labels, k in _LINE_SPEC
        )
    )
    out = base.select("issuer", "fy", "fq", F.explode(items).alias("x")).select("issuer", "fy", "fq", "x.*")
    scale = F.when((i + F.col("fy")) % 4 == 0, F.lit(1_000_000)).otherwise(F.lit(1)).cast("decimal(7,0)")
    amount = F.col("v").cast("decimal(20,0)") * scale  # an inflated amount may exceed BIGINT
    report = F.element_at(F.array(*(F.lit(x) for x in ("11013", "11012", "11014", "11011"))), F.col("fq").cast("int"))
    text = F.when((i + F.col("ord") + F.col("fy")) % 37 == 0, F.lit("-")).otherwise(F.format_number(amount, 0))
    bases = F.when(i % 4 == 0, F.array(F.lit("OFS"))).otherwise(F.array(F.lit("CFS"), F.lit("OFS")))
    monies = (
        F.when(i % 7 == 1, F.array(F.lit("USD")))
        .when(i % 7 == 2, F.array(F.lit("KRW"), F.lit("USD")))
        .when(i % 7 == 3, F.array(F.lit("CNY"), F.lit("USD")))
        .otherwise(F.array(F.lit("KRW")))
    )
    return (
        out.select("issuer", "fy", "fq", report.alias("report_code"), "ord", "sj_div", "account_nm", text.alias("t"))
        .select("*", F.explode(bases).alias("fs_div"))
        .select("*", F.explode(monies).alias("currency"))
        .select(
            "issuer", "fy", "fq", "report_code", "fs_div", "currency", "ord", "sj_div", "account_nm",
            # the KRW side of a two-currency filing is a zero placeholder
            F.when((F.col("issuer") % 7 == 2) & (F.col("currency") == "KRW") & (F.col("fy") % 2 == 0), F.lit("0"))
            .otherwise(F.col("t")).alias("amount"),
        )
    )


def cum_raw(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    w = Window.partitionBy("issuer", "fy").orderBy("fq").rowsBetween(Window.unboundedPreceding, 0)
    return (base or quarters(spark, sf_dir)).select("issuer", "fy", "fq", *(F.sum(m).over(w).alias(m) for m in MEASURES))


def _line_values_sql() -> str:
    rows = []
    for o, sj, labels, k in _LINE_SPEC:
        v = f"revenue*{k}" if k else ("operating_income" if o == 13 else "net_income")
        names = ",".join(f"'{x}'" for x in labels)
        rows.append(
            f"SELECT issuer, fy, fq, CAST({o} AS BIGINT) ord, '{sj}' sj_div, [{names}][issuer%3+1] account_nm, {v} v FROM cum_raw"
        )
    return "\n UNION ALL ".join(rows)


LINES_SQL = f"""
cum_raw AS (
  SELECT issuer, fy, fq, CAST(sum(revenue) OVER w AS BIGINT) revenue,
    CAST(sum(operating_income) OVER w AS BIGINT) operating_income, CAST(sum(net_income) OVER w AS BIGINT) net_income
  FROM quarters WINDOW w AS (PARTITION BY issuer, fy ORDER BY fq)),
lines0 AS ({_line_values_sql()}),
lines1 AS (
  SELECT issuer, fy, fq, ['11013','11012','11014','11011'][fq] report_code, ord, sj_div, account_nm,
    CASE WHEN (issuer+ord+fy)%37=0 THEN '-'
      ELSE format('{{:,}}', v * CASE WHEN (issuer+fy)%4=0 THEN 1000000 ELSE 1 END) END t,
    unnest(CASE WHEN issuer%4=0 THEN ['OFS'] ELSE ['CFS','OFS'] END) fs_div
  FROM lines0),
lines AS (
  SELECT issuer, fy, fq, report_code, fs_div, currency, ord, sj_div, account_nm,
    CASE WHEN issuer%7=2 AND currency='KRW' AND fy%2=0 THEN '0' ELSE t END amount
  FROM (SELECT *, unnest(CASE WHEN issuer%7=1 THEN ['USD'] WHEN issuer%7=2 THEN ['KRW','USD']
      WHEN issuer%7=3 THEN ['CNY','USD'] ELSE ['KRW'] END) currency FROM lines1) x)"""

# Amount text -> integer, in SQL.
AMOUNT_SQL = "CAST(trunc(TRY_CAST(nullif(replace(replace({c},',',''),' ',''),'-') AS DOUBLE)) AS BIGINT)"


# -- disclosure log ------------------------------------------------------------------------------


def disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: issuer, ord, entry_date, kind, series, prices, shares, balances."""
    return disc_of(table(spark, sf_dir, "events"))


def disc_of(e: DataFrame, *more: str) -> DataFrame:
    """The same of any event table, a stream too."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    c = cents("value")
    return e.select(
        F.col("user_id").alias("issuer"),
        F.col("event_id").alias("ord"),
        F.to_date("ts").alias("entry_date"),
        F.col("event_type").alias("kind"),
        k.alias("k"),
        c.alias("c"),
        (k % 5 + 1).alias("series"),
        (F.lit(500).cast("bigint") + (c * 7 + k) % 9500).alias("price"),
        (F.lit(1000).cast("bigint") + (c * 3 + k * 11) % 90000).alias("shares"),
        ((c * 17 + k * 1009) % 1000003 * 1000).alias("face"),
        *more,
    )


DISC_SQL = """
disc AS (
  SELECT user_id issuer, event_id ord, CAST(ts AS DATE) entry_date, event_type kind, k, c, k%5+1 series,
    500+(c*7+k)%9500 price, 1000+(c*3+k*11)%90000 shares, (c*17+k*1009)%1000003*1000 face
  FROM (SELECT *, CAST(json_extract(props,'$.k') AS BIGINT) k, CAST(round(value*100) AS BIGINT) c FROM events) e)"""


# -- prices --------------------------------------------------------------------------------------


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per user: at most one row per (issuer, day), whatever the event count."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("issuer"), "event_id", F.to_date("ts").alias("trade_date"), cents("value").alias("p")
    )
    return e.groupBy("issuer", "trade_date").agg(
        F.min_by("p", "event_id").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "event_id").alias("close"),
        F.count("*").alias("volume"),
    )


PX_SQL = """
px AS (
  SELECT user_id issuer, CAST(ts AS DATE) trade_date, arg_min(p, event_id) AS "open", max(p) high, min(p) low,
    arg_max(p, event_id) AS "close", count(*) volume
  FROM (SELECT *, CAST(round(value*100) AS BIGINT) p FROM events) e GROUP BY ALL)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of daily bars: issuer = return flag and line status, close = dearest item of the day."""
    li = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", F.lit("/"), "l_linestatus").alias("issuer"),
        F.to_date("l_shipdate").alias("trade_date"),
        cents("l_extendedprice").alias("p"),
    )
    return li.groupBy("issuer", "trade_date").agg(F.max("p").alias("close"), F.count("*").alias("volume"))


BARS_SQL = """
bars AS (
  SELECT l_returnflag || '/' || l_linestatus issuer, CAST(l_shipdate AS DATE) trade_date,
    max(CAST(round(l_extendedprice*100) AS BIGINT)) AS "close", count(*) volume
  FROM lineitem GROUP BY ALL)"""


# -- news ----------------------------------------------------------------------------------------

NEWS_TAGS = ["", "[속보] ", "[종합]", "【단독】", ""]


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles: issuer, date, title (first line), content, source, url."""
    d = table(spark, sf_dir, "documents")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    n = F.col("doc_id")
    tag = F.element_at(F.array(*(F.lit(t) for t in NEWS_TAGS)), (n % 5 + 1).cast("int"))
    return d.select(
        F.col("source").alias("issuer"),
        F.col("doc_id").alias("ord"),
        F.date_add(F.lit("2024-01-01").cast("date"), (n % 60).cast("int")).alias("date"),
        F.concat(tag, first).alias("title"),
        F.when(n % 4 != 3, F.col("text")).alias("content"),
        F.col("lang"),
        F.concat(F.lit("http://n.example/"), (n % 700).cast("string")).alias("url"),
    )


NEWS_SQL = """
news AS (
  SELECT source issuer, doc_id ord, CAST(DATE '2024-01-01' + CAST(doc_id%60 AS INTEGER) AS DATE) AS "date",
    ['', '[속보] ', '[종합]', '【단독】', ''][doc_id%5+1] || split_part(text, chr(10), 1) title,
    CASE WHEN doc_id%4<>3 THEN text END AS "content", lang,
    'http://n.example/' || CAST(doc_id%700 AS VARCHAR) url
  FROM documents)"""

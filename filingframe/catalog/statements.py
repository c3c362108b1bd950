"""Queries on fiscal statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import dates as D
from ..functions import metrics as M
from ..functions import numbers as N
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ordering as O
from ..operators import predicates as P
from ..operators import windows as W
from ..operators import years as Y
from ..operators.labels import match_accounts
from ..plans import statements as S
from ..session import saved
from . import proxies as X
from . import sqltext as Q
from .registry import query

MS = X.MEASURES
STMT = "WITH " + X.STMT_SQL
FILING = ["issuer", "fy", "fq", "report_code"]


def _each(fmt: str, sep: str = ", ") -> str:
    return sep.join(fmt.replace("{m}", m) for m in MS)


# -- labels, pivots ------------------------------------------------------------------------------


def _rank_sql(account: str, patterns: list[str], exclusions: dict) -> str:
    cases = []
    for n, p in enumerate(patterns):
        no = "".join(f" AND NOT contains({account},'{x}')" for x in exclusions.get(p, []))
        cases.append(f"WHEN {account}='{p}' THEN {2 * n} WHEN contains({account},'{p}'){no} THEN {2 * n + 1}")
    return "CASE " + " ".join(cases) + " END"


def _first_sql(field: str, patterns: list[str], sj: str, value: str = "v") -> str:
    r = _rank_sql("account_nm", patterns, lx.LABEL_EXCLUSIONS)
    # the winning row's amount, NULL included
    return (
        f"(array_agg({value} ORDER BY {r}, ord) FILTER (WHERE sj_div='{sj}' AND ({r}) IS NOT NULL))[1]"
    )


LINES = "WITH " + X.QUARTERS_SQL + "," + X.LINES_SQL + f""",
basis AS (
  SELECT *, {Q.amount('amount')} v,
    max(CASE WHEN fs_div='CFS' THEN 1 ELSE 0 END) OVER (PARTITION BY issuer,fy,fq,report_code) has_cfs
  FROM lines),
picked AS (SELECT * FROM basis WHERE fs_div = CASE WHEN has_cfs=1 THEN 'CFS' ELSE 'OFS' END),
flag AS (
  SELECT *, max(CASE WHEN currency='KRW' AND v<>0 THEN 1 ELSE 0 END) OVER f home,
    max(CASE WHEN v<>0 THEN 1 ELSE 0 END) OVER f any_v,
    min(currency) OVER f = max(currency) OVER f single
  FROM picked WINDOW f AS (PARTITION BY issuer,fy,fq,report_code)),
good AS (
  SELECT issuer,fy,fq,report_code,fs_div,currency,ord,sj_div,account_nm,amount,v FROM flag
  WHERE CASE WHEN home=1 THEN currency='KRW' ELSE any_v=1 AND single END)"""


def _whole(df, *exact):
    """Exact amounts as the BIGINT their SQL states; a figure that BIGINT cannot hold is NULL."""
    return df.withColumns({c: F.col(c).try_cast("bigint") for c in exact})


def _good_lines(spark, sf):
    return S.scan_statement_lines(X.lines(spark, sf), keys=FILING)


@query("s6_scan_statement_lines", LINES + " SELECT issuer,fy,fq,report_code,fs_div,currency,ord,sj_div,account_nm,amount, CASE WHEN fs_div='CFS' THEN '연결' ELSE '별도' END basis FROM good")
def s6(spark, sf):
    return _good_lines(spark, sf)


@query("p4_prefer_currency", LINES + " SELECT issuer,fy,fq,report_code,currency,count(*) n, CAST(sum(v) AS BIGINT) total FROM good GROUP BY ALL")
def p4(spark, sf):
    rows = P.prefer_currency(S.prefer_basis(X.lines(spark, sf), keys=FILING), keys=FILING)
    out = rows.groupBy(*FILING, "currency").agg(
        F.count("*").alias("n"), F.sum(N.parse_amount_exact("amount")).alias("total")
    )
    return _whole(out, "total")


@query("p5_first_present_column", LINES + " SELECT 'account_nm' account_col, 'amount' amount_col, count(*) n FROM lines")
def p5(spark, sf):
    df = X.lines(spark, sf)
    account = P.first_present_column(df, ("account_name", "계정명", "account_nm"))
    amount = P.first_present_column(df, ("thstrm_amount", "당기금액", "amount"), fallback="number")
    return df.agg(
        F.lit(account).alias("account_col"), F.lit(amount).alias("amount_col"), F.count(F.col(amount)).alias("n")
    )


_J9 = " UNION ALL ".join(
    f"SELECT issuer,fy,fq,ord,account_nm,'{f}' field, {_rank_sql('account_nm', p, lx.LABEL_EXCLUSIONS)} match_rank FROM good"
    for f, p in {**lx.BALANCE_LABELS, **lx.INCOME_LABELS}.items()
)


@query("j9_account_dictionary_join", LINES + f" SELECT * FROM ({_J9}) x WHERE match_rank IS NOT NULL")
def j9(spark, sf):
    rules = {**lx.BALANCE_LABELS, **lx.INCOME_LABELS}
    hits = match_accounts(_good_lines(spark, sf), rules, lx.LABEL_EXCLUSIONS)
    return hits.select("issuer", "fy", "fq", "ord", "account_nm", "field", "match_rank")


_A1_BS = ", ".join(f"{_first_sql(f, p, 'BS')} {f}" for f, p in lx.BALANCE_LABELS.items())


@query("a1_pivot_balance_sheet", LINES + f" SELECT issuer,fy,fq,report_code,{_A1_BS} FROM good GROUP BY issuer,fy,fq,report_code")
def a1_bs(spark, sf):
    out = A.pivot_accounts(_good_lines(spark, sf), keys=FILING, rules=lx.BALANCE_LABELS, statements=["BS"])
    return _whole(out, *lx.BALANCE_LABELS)


_SCALE_SQL = """scaled AS (
  SELECT issuer,fy,fq,report_code, CASE WHEN count(*) FILTER (WHERE sj_div IN ('IS','CIS') AND abs(v)>100000)>=2
      AND bool_and(v%1000000=0) FILTER (WHERE sj_div IN ('IS','CIS') AND abs(v)>100000) THEN 1000000 ELSE 1 END AS scale
  FROM good GROUP BY ALL)"""
_IS0 = ", ".join(
    f"coalesce({_first_sql(f, p, 'CIS')},{_first_sql(f, p, 'IS')}) {f}" for f, p in lx.INCOME_LABELS.items()
)
_IS1 = ", ".join(f"CASE WHEN scale>1 THEN {Q.floor_div(f, 'scale')} ELSE {f} END {f}" for f in MS)
INCOME = LINES + f""",
{_SCALE_SQL},
income AS (
  SELECT g.issuer,g.fy,g.fq,g.report_code,{_IS1}
  FROM (SELECT issuer,fy,fq,report_code,{_IS0} FROM good GROUP BY issuer,fy,fq,report_code) g
  JOIN scaled s ON g.issuer=s.issuer AND g.fy=s.fy AND g.fq=s.fq)"""


@query("a1_pivot_income", INCOME + " SELECT * FROM income")
def a1_is(spark, sf):
    return S.income_records(_good_lines(spark, sf), keys=FILING)


def _last_sql(field: str) -> str:
    return f"arg_max(v, ord) FILTER (WHERE fld='{field}' AND v IS NOT NULL) {field}"


def _field_sql(rules: dict, exclusions: dict) -> str:
    exact = " ".join(
        f"WHEN account_nm IN ({','.join(repr(x) for x in p)}) THEN '{f}'" for f, p in rules.items()
    )
    part = []
    for f, pats in rules.items():
        for p in pats:
            no = "".join(f" AND NOT contains(account_nm,'{x}')" for x in exclusions.get(p, []))
            part.append(f"WHEN contains(account_nm,'{p}'){no} THEN '{f}'")
    return f"CASE {exact} {' '.join(part)} END"


@query(
    "a1_pivot_last_rule",
    LINES
    + f" SELECT issuer,fy,fq,report_code,{', '.join(_last_sql(f) for f in lx.PAGE_BALANCE_LABELS)} FROM ("
    + f"SELECT *, CASE WHEN sj_div='BS' THEN {_field_sql(lx.PAGE_BALANCE_LABELS, lx.PAGE_LABEL_EXCLUSIONS)} END fld FROM good) x"
    + " GROUP BY issuer,fy,fq,report_code",
)
def a1_last(spark, sf):
    out = A.pivot_accounts(
        _good_lines(spark, sf), keys=FILING, rules=lx.PAGE_BALANCE_LABELS,
        exclusions=lx.PAGE_LABEL_EXCLUSIONS, statements=["BS"], rule="last",
    )
    return _whole(out, *lx.PAGE_BALANCE_LABELS)


_BR = _rank_sql("account_nm", lx.BORROWINGS_LABELS, lx.LABEL_EXCLUSIONS)


@query(
    "a2_sum_matching",
    LINES + f""" SELECT issuer,fy,fq,report_code,
      CASE WHEN count(*) FILTER (WHERE ({_BR})=0)>0 THEN CAST(sum(v) FILTER (WHERE ({_BR})=0) AS BIGINT)
        ELSE CAST(sum(v) FILTER (WHERE ({_BR})=1) AS BIGINT) END borrowings_total
      FROM good WHERE sj_div='BS' GROUP BY issuer,fy,fq,report_code""",
)
def a2(spark, sf):
    bs = _good_lines(spark, sf).where(F.col("sj_div") == "BS")
    return _whole(A.sum_matching(bs, keys=FILING, out="borrowings_total"), "borrowings_total")


@query("a3_detect_unit_inflation", LINES + "," + _SCALE_SQL + " SELECT issuer,fy,fq,report_code,CAST(scale AS BIGINT) scale FROM scaled")
def a3(spark, sf):
    return A.detect_unit_inflation(_good_lines(spark, sf), keys=FILING)


@query(
    "a4_sum_skip_null",
    STMT + """ SELECT issuer,fy,fq, CASE WHEN coalesce(revenue,operating_income,net_income) IS NOT NULL
      THEN coalesce(revenue,0)+coalesce(operating_income,0)+coalesce(net_income,0) END total FROM stmt""",
)
def a4(spark, sf):
    return X.stmt(spark, sf).select("issuer", "fy", "fq", N.sum_skip_null(*MS).alias("total"))


def _skip(*c: str) -> str:
    return f"(CASE WHEN coalesce({','.join(c)}) IS NOT NULL THEN {'+'.join(f'coalesce({x},0)' for x in c)} END)"


_SHORT = f"CASE WHEN short_term_debt_and_bonds IS NOT NULL THEN {_skip('short_term_debt_and_bonds', 'current_long_term_debt', 'current_bonds')} ELSE {_skip('short_term_borrowings', 'current_long_term_debt', 'current_bonds')} END"
_LONG = f"coalesce(long_term_debt_and_bonds, {_skip('long_term_borrowings', 'bonds')})"
SHEETS = LINES + f""",
sheets AS (SELECT issuer,fy,fq,report_code,any_value(currency) currency,any_value(basis) statement_type,{_A1_BS},
    CASE WHEN count(*) FILTER (WHERE ({_BR})=0 AND sj_div='BS')>0 THEN CAST(sum(v) FILTER (WHERE ({_BR})=0 AND sj_div='BS') AS BIGINT)
        ELSE CAST(sum(v) FILTER (WHERE ({_BR})=1 AND sj_div='BS') AS BIGINT) END borrowings_total
  FROM (SELECT *, CASE WHEN fs_div='CFS' THEN '연결' ELSE '별도' END basis FROM good) g GROUP BY issuer,fy,fq,report_code),
debts AS (SELECT *, CASE WHEN s IS NULL AND l IS NULL THEN borrowings_total ELSE coalesce(s,0)+coalesce(l,0) END debt
  FROM (SELECT *, {_SHORT} s, {_LONG} l FROM sheets) x)"""


@query("a5_interest_bearing_debt", SHEETS + " SELECT issuer,fy,fq,debt FROM debts")
def a5(spark, sf):
    sheets = S.balance_sheets(_good_lines(spark, sf), keys=FILING)
    return _whole(sheets.select("issuer", "fy", "fq", A.interest_bearing_debt().alias("debt")), "debt")


def _ytd(m: str, cond: str, name: str) -> str:
    return (
        f"CASE WHEN count({m}) FILTER (WHERE {cond}) = max(n) - min(fq) FILTER (WHERE {cond} AND {m} IS NOT NULL) + 1"
        f" THEN CAST(sum({m}) FILTER (WHERE {cond}) AS BIGINT) END {name}"
    )


@query(
    "a6_ytd_sum_with_gap_rule",
    STMT + f""", l AS (SELECT issuer, arg_max(fy, fy*4+fq) y, arg_max(fq, fy*4+fq) n FROM stmt GROUP BY ALL)
    SELECT s.issuer, max(y) fy, max(n) fq, {", ".join(_ytd(m, "fy=y", m) for m in MS)},
      {", ".join(_ytd(m, "fy=y-1", "prev_" + m) for m in MS)}
    FROM stmt s JOIN l ON s.issuer=l.issuer WHERE n<>4 AND fq<=n AND fy BETWEEN y-1 AND y GROUP BY s.issuer""",
)
def a6(spark, sf):
    return A.ytd_sum_with_gap_rule(X.stmt(spark, sf), measures=MS)


# -- segments ------------------------------------------------------------------------------------

SEG = """seg AS (
  SELECT CAST(c_nationkey AS BIGINT) issuer, year(o_orderdate) || '.Q' || quarter(o_orderdate) period,
    CASE WHEN o_orderkey%2=0 THEN c_mktsegment ELSE substring(c_mktsegment,1,3)||' '||substring(c_mktsegment,4) END segment,
    o_orderkey ord, CAST(round(o_totalprice*100) AS BIGINT) amount
  FROM orders JOIN customer ON o_custkey=c_custkey)"""


def _segments(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = X.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    spaced = F.concat(F.substring("c_mktsegment", 1, 3), F.lit(" "), F.expr("substring(c_mktsegment, 4)"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("bigint").alias("issuer"),
        F.concat(F.year("o_orderdate"), F.lit(".Q"), F.quarter("o_orderdate")).alias("period"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("c_mktsegment")).otherwise(spaced).alias("segment"),
        F.col("o_orderkey").alias("ord"),
        X.cents("o_totalprice").alias("amount"),
    )


_CANON = SEG + """, nm AS (SELECT issuer, replace(segment,' ','') k, arg_min(segment, ord) nm FROM seg GROUP BY ALL),
canon AS (SELECT s.issuer, period, nm segment, min(ord) ord, CAST(sum(amount) AS BIGINT) amount
  FROM seg s JOIN nm ON s.issuer=nm.issuer AND replace(s.segment,' ','')=nm.k GROUP BY ALL)"""


@query("j11_canonical_names", f"WITH {_CANON} SELECT * FROM canon")
def j11(spark, sf):
    return J.canonical_names(
        _segments(spark, sf), keys=["issuer"], groups=["period"], name="segment", order="ord", amounts=["amount"]
    )


@query(
    "a9_segment_totals",
    f"WITH {SEG}, s AS (SELECT issuer, period, segment, CAST(sum(amount) AS BIGINT) a, min(ord) o FROM seg GROUP BY ALL)"
    " SELECT issuer, period, CAST(sum(a) AS BIGINT) total, string_agg(segment||' '||format('{:,}',a), ' / ' ORDER BY o, segment) breakdown FROM s GROUP BY ALL",
)
def a9(spark, sf):
    return A.segment_totals(_segments(spark, sf), keys=["issuer", "period"], segment="segment", amount="amount", order="ord")


_BACKLOG = f"""WITH {_CANON}, t AS (
  SELECT issuer, period, CAST(period[1:4] AS BIGINT) fy, CAST(period[7:7] AS BIGINT) fq, CAST(sum(amount) AS BIGINT) total,
    string_agg(segment||' '||format('{{:,}}',amount), ' / ' ORDER BY ord, segment) breakdown FROM canon GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY fy DESC, fq DESC) rn FROM t)
SELECT r.issuer, r.period, r.total, r.breakdown, CASE WHEN p.total>0 THEN {Q.pct('r.total', 'p.total')} END yoy
FROM r LEFT JOIN t p ON p.issuer=r.issuer AND p.fy=r.fy-1 AND p.fq=r.fq WHERE rn<=8"""


@query("e12_backlog_series", _BACKLOG)
def e12(spark, sf):
    return S.backlog_series(_segments(spark, sf), n=8)


_PARTS = """comp AS (SELECT issuer, period, segment AS label, CAST(sum(amount) AS DOUBLE) a FROM seg GROUP BY ALL),
parts AS (
  SELECT issuer, period, label, CAST(round_even(a * [1,10,100,1000,37][issuer%5+1] / 100.0, 0) AS BIGINT) amount FROM comp
  UNION ALL SELECT issuer, period, '합계', CAST(round_even(sum(a)/100.0,0) AS BIGINT) FROM comp GROUP BY ALL)"""


def _parts(spark, sf):
    seg = _segments(spark, sf)
    factor = F.element_at(F.array(*(F.lit(x) for x in (1, 10, 100, 1000, 37))), (F.col("issuer") % 5 + 1).cast("int"))
    comp = seg.groupBy("issuer", "period", F.col("segment").alias("label")).agg(F.sum("amount").alias("a"))
    tot = seg.groupBy("issuer", "period").agg(F.sum("amount").alias("a"))
    one = lambda c: F.bround(c / 100.0, 0).cast("bigint").alias("amount")
    return comp.select("issuer", "period", "label", one(F.col("a").cast("double") * factor)).unionByName(
        tot.select("issuer", "period", F.lit("합계").alias("label"), one(F.col("a").cast("double")))
    )


@query(
    "a13_power_of_ten_fix",
    f"""WITH {SEG}, {_PARTS}, known AS (SELECT issuer, period, CAST(sum(amount) AS BIGINT)*1000000 k FROM seg GROUP BY ALL),
    f AS (SELECT p.issuer, p.period, CASE WHEN r BETWEEN 7.0 AND 15.0 THEN 10 WHEN r BETWEEN 70.0 AND 150.0 THEN 100
        WHEN r BETWEEN 700.0 AND 1500.0 THEN 1000 ELSE 1 END factor
      FROM (SELECT p.issuer, p.period, CAST(sum(p.amount) AS DOUBLE)/(any_value(CAST(k AS DOUBLE))/100000000.0) r
        FROM parts p JOIN known n ON p.issuer=n.issuer AND p.period=n.period WHERE label<>'합계' GROUP BY ALL) p)
    SELECT p.issuer, p.period, label, CASE WHEN factor>1 THEN CAST(round_even(CAST(amount AS DOUBLE)/factor,0) AS BIGINT) ELSE amount END amount,
      CAST(factor AS BIGINT) factor FROM parts p JOIN f ON p.issuer=f.issuer AND p.period=f.period""",
)
def a13(spark, sf):
    known = _segments(spark, sf).groupBy("issuer", "period").agg((F.sum("amount") * 1_000_000).alias("known"))
    out = A.power_of_ten_fix(
        _parts(spark, sf), known, keys=["issuer", "period"], amount="amount", known_total="known"
    )
    return out.select("issuer", "period", "label", "amount", F.col("factor").cast("bigint").alias("factor"))


@query(
    "a15_share_of_total",
    f"""WITH {SEG}, {_PARTS}, t AS (SELECT issuer, period, sum(amount) t FROM parts WHERE label<>'합계' GROUP BY ALL)
    SELECT p.issuer, p.period, label, amount, round(CAST(amount*100 AS DOUBLE)/CAST(t AS DOUBLE),1) share_pct
    FROM parts p JOIN t ON p.issuer=t.issuer AND p.period=t.period WHERE label<>'합계'""",
)
def a15(spark, sf):
    return A.share_of_total(_parts(spark, sf), keys=["issuer", "period"], label="label", amount="amount")


# -- periods -------------------------------------------------------------------------------------

_LAGGED = _each(f"{Q.yoy('{m}', 'lag({m}) OVER w', False)} {{m}}_yoy")


@query("w1_yoy_positional", STMT + f" SELECT *, {_LAGGED} FROM stmt WINDOW w AS (PARTITION BY issuer,fq ORDER BY fy)")
def w1(spark, sf):
    return W.yoy_positional(X.stmt(spark, sf), measures=MS)


CUM = "WITH " + X.QUARTERS_SQL + "," + X.CUM_SQL
_STAND = _each(
    "CASE WHEN c.fq=1 OR coalesce(e.revenue,e.operating_income,e.net_income) IS NULL THEN c.{m} ELSE c.{m}-e.{m} END {m}"
)
STAND_SQL = f"""
stand AS (SELECT c.issuer,c.fy,c.fq,{_STAND} FROM cum c
  LEFT JOIN cum e ON e.issuer=c.issuer AND e.fy=c.fy AND e.fq=c.fq-1)"""


@query("w2_standalone_from_cumulative", CUM + "," + STAND_SQL + " SELECT * FROM stand")
def w2(spark, sf):
    return Y.standalone_from_cumulative(X.cum(spark, sf), measures=MS)


def _estimates(spark, sf):
    """Three future years per issuer, derived from its last actual year."""
    a = X.annual(spark, sf)
    last = a.groupBy("issuer").agg(F.max("fy").alias("y"), F.max_by("revenue", "fy").alias("r"), F.max("net_income").alias("n"))
    steps = F.array(*(F.lit(x).cast("bigint") for x in (1, 2, 3)))
    return last.select("issuer", "y", "r", "n", F.explode(steps).alias("s")).select(
        "issuer",
        (F.col("y") + F.col("s")).alias("fy"),
        F.when((F.col("issuer") + F.col("s")) % 5 != 0, F.col("r") + F.col("s") * 700_000_000).alias("revenue"),
        F.when((F.col("issuer") + F.col("s")) % 4 != 0, F.col("n") * F.col("s")).alias("operating_income"),
        F.when((F.col("issuer") * 2 + F.col("s")) % 3 != 0, F.col("n") * (2 - F.col("s"))).alias("net_income"),
    )


EST_SQL = """
est AS (SELECT issuer, y+s fy, CASE WHEN (issuer+s)%5<>0 THEN r+s*700000000 END revenue,
    CASE WHEN (issuer+s)%4<>0 THEN n*s END operating_income, CASE WHEN (issuer*2+s)%3<>0 THEN n*(2-s) END net_income
  FROM (SELECT issuer, max(fy) y, arg_max_null(revenue,fy) r, max(net_income) n FROM annual GROUP BY issuer) a,
    (SELECT CAST(unnest([1,2,3]) AS BIGINT) s) k)"""

_CHAIN = _each(
    Q.yoy("{m}", "last_value({m} IGNORE NULLS) OVER w", True) + " {m}_yoy"
)


@query(
    "w4_chain_estimates",
    "WITH " + X.QUARTERS_SQL + "," + X.ANNUAL_SQL + "," + EST_SQL + f""",
    seed AS (SELECT issuer, fy, revenue, operating_income, net_income, 0 e FROM annual
      WHERE (issuer,fy) IN (SELECT (issuer,max(fy)) FROM annual GROUP BY issuer)
      UNION ALL SELECT issuer, fy, revenue, operating_income, net_income, 1 FROM est)
    SELECT issuer, fy, revenue, operating_income, net_income, {_each("{m}_yoy")} FROM (
      SELECT *, {_CHAIN} FROM seed WINDOW w AS (PARTITION BY issuer ORDER BY e, fy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x
    WHERE e=1""",
)
def w4(spark, sf):
    return W.chain_estimates(X.annual(spark, sf), _estimates(spark, sf), measures=MS)


def _sheets(spark, sf):
    """Annual sheet as quarter 0, others as quarters 1..3; some without total assets."""
    rows = S.balance_sheets(_good_lines(spark, sf), keys=FILING)
    fq = F.when(F.col("fq") == 4, 0).otherwise(F.col("fq")).cast("bigint")
    return rows.withColumn("fq", fq)


@query(
    "w6_latest_balance_sheet",
    SHEETS + f""", d AS (SELECT * EXCLUDE (fq), CASE WHEN fq=4 THEN 0 ELSE fq END fq FROM debts),
    r AS (SELECT *, o-fy b FROM (SELECT *, year(DATE '2001-06-15') + CASE WHEN 6<=(CASE WHEN issuer%2=0 THEN 12 ELSE 3 END) THEN 0 ELSE 1 END o FROM d) x),
    k AS (SELECT *, CASE WHEN b=0 AND fq>0 THEN 3-fq WHEN b=1 AND fq=0 THEN 3 WHEN b=1 THEN 7-fq WHEN b=2 AND fq=0 THEN 7 END rk
      FROM r WHERE total_assets IS NOT NULL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY rk) rn FROM k WHERE rk IS NOT NULL) y WHERE rn=1)
    SELECT b.issuer, b.fy, CAST(b.fq AS BIGINT) fq, b.total_assets, b.debt, p.total_assets prev_total_assets
    FROM best b LEFT JOIN d p ON p.issuer=b.issuer AND p.fy=b.fy-1 AND p.fq=0 AND p.total_assets IS NOT NULL""",
)
def w6(spark, sf):
    sheets = _sheets(spark, sf).withColumn("debt", A.interest_bearing_debt())
    settle = F.when(F.col("issuer") % 2 == 0, 12).otherwise(3)
    picked = W.latest_balance_sheet(
        sheets, as_of=F.lit("2001-06-15").cast("date"), settlement_month=settle
    )
    out = W.with_comparison_sheet(picked, sheets, cols=["total_assets"])
    return _whole(out.select("issuer", "fy", "fq", "total_assets", "debt", "prev_total_assets"), "total_assets", "debt", "prev_total_assets")


_Q4SRC = """q4src AS (SELECT issuer, fy, fq, CASE WHEN fq<>4 THEN revenue END revenue,
    CASE WHEN fq<>4 THEN operating_income END operating_income, CASE WHEN fq<>4 THEN net_income END net_income FROM stmt)"""


def q4_sql(src: str, out: str) -> str:
    three = _each(
        "CASE WHEN count({m}) FILTER (WHERE fq<4)=3 THEN CAST(sum({m}) FILTER (WHERE fq<4) AS BIGINT) END s_{m}"
    )
    fill = _each("CASE WHEN ok THEN a_{m}-s_{m} ELSE {m} END {m}")
    return f"""
{out}_s AS (SELECT issuer, fy, count(*) FILTER (WHERE fq<4 AND coalesce(revenue,operating_income,net_income) IS NOT NULL) n,
    coalesce(sum(revenue) FILTER (WHERE fq<4),0) rev3, {three} FROM {src} WHERE fq BETWEEN 1 AND 4 GROUP BY issuer, fy),
{out} AS (SELECT issuer, fy, fq, {fill} FROM (
    SELECT q.*, {_each('s.s_{m}')}, {_each('a.{m} a_{m}')},
      coalesce(q.fq=4 AND coalesce(q.revenue,q.operating_income,q.net_income) IS NULL AND s.n=3 AND a.revenue>0 AND s.rev3<=a.revenue, false) ok
    FROM {src} q LEFT JOIN {out}_s s ON s.issuer=q.issuer AND s.fy=q.fy LEFT JOIN {{annual}} a ON a.issuer=q.issuer AND a.fy=q.fy) x)"""


@query("w7_q4_backfill", STMT + "," + X.ANNUAL_SQL + "," + _Q4SRC + "," + q4_sql("q4src", "filled").format(annual="annual") + " SELECT * FROM filled")
def w7(spark, sf):
    blank = [F.when(F.col("fq") != 4, F.col(m)).alias(m) for m in MS]
    src = X.stmt(spark, sf).select("issuer", "fy", "fq", *blank)
    return Y.q4_backfill(src, X.annual(spark, sf), measures=MS)


def fill_sql(src: str, ytd: str, out: str) -> str:
    q1 = "CASE WHEN o.issuer IS NOT NULL THEN coalesce(o.{m},y1.{m}) END"
    q1_empty = "coalesce(" + ",".join(q1.format(m=m) for m in MS) + ") IS NULL"
    fill = ", ".join(
        f"coalesce(q.{m}, CASE WHEN q.fq=1 THEN y1.{m} WHEN q.fq=2 THEN CASE WHEN {q1_empty} THEN y2.{m} ELSE y2.{m}-({q1.format(m=m)}) END"
        f" WHEN q.fq=3 THEN CASE WHEN coalesce(y2.revenue,y2.operating_income,y2.net_income) IS NOT NULL THEN y3.{m}-y2.{m} END END) {m}"
        for m in MS
    )
    on = "ON {a}.issuer=q.issuer AND {a}.fy=q.fy AND {a}.fq={n}"
    return f"""
{out} AS (SELECT q.issuer, q.fy, q.fq, {fill} FROM {src} q LEFT JOIN {src} o {on.format(a='o', n=1)}
    LEFT JOIN {ytd} y1 {on.format(a='y1', n=1)} LEFT JOIN {ytd} y2 {on.format(a='y2', n=2)} LEFT JOIN {ytd} y3 {on.format(a='y3', n=3)})"""


@query("w8_fill_from_cumulative", STMT + "," + X.CUM_SQL + "," + fill_sql("stmt", "cum", "filled") + " SELECT * FROM filled")
def w8(spark, sf):
    return Y.fill_from_cumulative(X.stmt(spark, sf), X.cum(spark, sf), measures=MS)


# -- joins ---------------------------------------------------------------------------------------


@query(
    "j3_upsert",
    STMT + "," + X.CUM_SQL + f""" SELECT coalesce(s.issuer,c.issuer) issuer, coalesce(s.fy,c.fy) fy, coalesce(s.fq,c.fq) fq,
      {_each("CASE WHEN coalesce(s.revenue,s.operating_income,s.net_income) IS NOT NULL OR c.issuer IS NULL THEN s.{m} ELSE c.{m} END {m}")}
      FROM stmt s FULL JOIN cum c ON s.issuer=c.issuer AND s.fy=c.fy AND s.fq=c.fq""",
)
def j3(spark, sf):
    return J.upsert(
        X.stmt(spark, sf), X.cum(spark, sf), ["issuer", "fy", "fq"], policy="skip_nonempty", measures=MS
    )


@query("j3_upsert_replace", STMT + "," + X.CUM_SQL + f" SELECT coalesce(c.issuer,s.issuer) issuer, coalesce(s.fy,c.fy) fy, coalesce(s.fq,c.fq) fq, {_each('CASE WHEN c.issuer IS NOT NULL THEN c.{m} ELSE s.{m} END {m}')} FROM stmt s FULL JOIN (SELECT * FROM cum WHERE fq<3) c ON s.issuer=c.issuer AND s.fy=c.fy AND s.fq=c.fq")
def j3r(spark, sf):
    return J.upsert(X.stmt(spark, sf), X.cum(spark, sf).where("fq < 3"), ["issuer", "fy", "fq"])


@query(
    "j4_prior_period_join",
    STMT + f" SELECT s.*, {_each('p.{m} prev_{m}')} FROM stmt s LEFT JOIN stmt p ON p.issuer=s.issuer AND p.fq=s.fq AND p.fy=s.fy-1",
)
def j4(spark, sf):
    return J.prior_period_join(X.stmt(spark, sf), keys=["issuer", "fq"], measures=MS)


@query(
    "j6_fallback_source",
    STMT + "," + X.CUM_SQL + " SELECT * FROM stmt UNION ALL SELECT * FROM cum c WHERE NOT EXISTS (SELECT 1 FROM stmt s WHERE s.issuer=c.issuer AND s.fy=c.fy AND s.fq=c.fq)",
)
def j6(spark, sf):
    return J.fallback_source(X.stmt(spark, sf), X.cum(spark, sf), ["issuer", "fy", "fq"])


@query("j8_restrict_to", STMT + " SELECT * FROM stmt WHERE issuer IN (SELECT n_nationkey FROM nation WHERE n_regionkey<>2)")
def j8(spark, sf):
    wanted = X.table(spark, sf, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").cast("bigint").alias("issuer"))
    return J.restrict_to(X.stmt(spark, sf), wanted, ["issuer"])


@query(
    "j10_unit_multiplier",
    STMT + """ SELECT issuer,fy,fq, revenue * CASE issuer%5 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 100000000 END won
      FROM (SELECT issuer,fy,fq, revenue//1000000000 revenue FROM stmt) x""",
)
def j10(spark, sf):
    unit = F.element_at(F.array(*(F.lit(u) for u in ("원", "천원", "백만원", "억원", "?"))), (F.col("issuer") % 5 + 1).cast("int"))
    return X.stmt(spark, sf).select(
        "issuer", "fy", "fq",
        (N.floor_div(F.col("revenue"), 1_000_000_000) * N.unit_multiplier(unit, default="억원")).alias("won"),
    )


# -- filters, order ------------------------------------------------------------------------------


@query("p6_is_empty_statement", STMT + " SELECT issuer,fy,fq FROM stmt WHERE coalesce(revenue,operating_income,net_income) IS NULL")
def p6(spark, sf):
    return X.stmt(spark, sf).where(P.is_empty_statement(MS)).select("issuer", "fy", "fq")


@query("p16_display_years", STMT + " SELECT * FROM stmt QUALIFY fy >= max(fy) OVER (PARTITION BY issuer) - 1")
def p16(spark, sf):
    return P.display_years(X.stmt(spark, sf))


@query("o1_order_newest_first", STMT + " SELECT issuer,fy,fq,revenue FROM stmt ORDER BY issuer, fy DESC, fq DESC")
def o1(spark, sf):
    return O.order_newest_first(X.stmt(spark, sf).select("issuer", "fy", "fq", "revenue"))


@query("o2_top_n_per_key", STMT + " SELECT issuer,fy,fq,revenue FROM stmt QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY fy DESC, fq DESC)<=12")
def o2(spark, sf):
    return O.top_n_per_key(
        X.stmt(spark, sf).select("issuer", "fy", "fq", "revenue"), 12,
        keys=["issuer"], order=[F.desc("fy"), F.desc("fq")],
    )


# -- display -------------------------------------------------------------------------------------


@query(
    "n11_to_display_unit",
    STMT + f""" SELECT issuer,fy,fq, CASE WHEN issuer%3=0 THEN {Q.eok('revenue', '1000000.0')} ELSE {Q.eok('revenue')} END shown,
      CASE WHEN issuer%3=0 THEN '백만 CNY' ELSE '억원' END unit FROM stmt""",
)
def n11(spark, sf):
    ccy = F.when(F.col("issuer") % 3 == 0, F.lit("CNY")).otherwise(F.lit("KRW"))
    return X.stmt(spark, sf).withColumn("currency", ccy).select(
        "issuer", "fy", "fq", N.to_display_unit("revenue").alias("shown"), N.display_unit_label().alias("unit")
    )


@query("n12_format_thousands", STMT + " SELECT issuer,fy,fq, coalesce(format('{:,}', net_income), '-') shown FROM stmt")
def n12(spark, sf):
    return X.stmt(spark, sf).select("issuer", "fy", "fq", N.format_thousands("net_income").alias("shown"))


@query("dt4_fiscal_quarter_end", STMT + """ SELECT issuer, fy, fq, CASE WHEN m>sm THEN fy-1 ELSE fy END cal_year, m cal_month FROM (
  SELECT issuer, fy, q fq, sm, (sm%12 + CASE WHEN q=0 THEN 12 ELSE q*3 END - 1)%12+1 m FROM (SELECT issuer, fy, fq%4 q, issuer%12+1 sm FROM stmt) x) y""")
def dt4(spark, sf):
    q = F.col("fq") % 4
    year, month = D.fiscal_quarter_end(F.col("fy"), q, F.col("issuer") % 12 + 1)
    return X.stmt(spark, sf).select("issuer", "fy", q.alias("fq"), year.alias("cal_year"), month.alias("cal_month"))


_DT5 = """ SELECT issuer, fy s_fy, fq s_fq, CASE WHEN e='' THEN 0 ELSE CAST(e[1:4] AS BIGINT) END fy,
   CASE WHEN e='' OR span>=11 THEN 0 ELSE CAST(ceil(((em-fs+12)%12+1)/3.0) AS BIGINT) END fq,
   CASE WHEN e='' THEN false ELSE span<11 AND sm=fs AND span>4 END cumulative FROM (
   SELECT *, CASE WHEN em-sm+1<=0 THEN em-sm+13 ELSE em-sm+1 END span FROM (
   SELECT *, coalesce(TRY_CAST(s[6:7] AS BIGINT),1) sm, TRY_CAST(e[6:7] AS BIGINT) em, issuer%12+1 set_m, (issuer%12+1)%12+1 fs FROM (
   SELECT issuer, fy, fq, CASE WHEN (issuer+fq)%9=0 THEN '' ELSE fy || '-' || lpad(CAST((fq*3-2) AS VARCHAR),2,'0') || '-01' END s,
     CASE WHEN (issuer+fy)%11=0 THEN '' ELSE fy || '-' || lpad(CAST(least(12, fq*3+(issuer%3)*3) AS VARCHAR),2,'0') || '-30' END e FROM stmt) a) b) c"""


@query("dt5_detect_period", STMT + _DT5)
def dt5(spark, sf):
    i, fy, fq = F.col("issuer"), F.col("fy"), F.col("fq")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    start = F.when((i + fq) % 9 == 0, F.lit("")).otherwise(F.concat(fy, F.lit("-"), two(fq * 3 - 2), F.lit("-01")))
    end = F.when((i + fy) % 11 == 0, F.lit("")).otherwise(
        F.concat(fy, F.lit("-"), two(F.least(F.lit(12), fq * 3 + (i % 3) * 3)), F.lit("-30"))
    )
    p = D.detect_period(start, end, i % 12 + 1)
    return X.stmt(spark, sf).select(
        "issuer", fy.alias("s_fy"), fq.alias("s_fq"), p["fy"].cast("bigint").alias("fy"),
        p["fq"].cast("bigint").alias("fq"), p["cumulative"].alias("cumulative"),
    )


@query(
    "dt6_period_labels",
    STMT + """ SELECT issuer, fy, fq, CASE WHEN fq=4 THEN CAST(fy AS VARCHAR) ELSE fy||'.Q'||fq END internal,
      CASE WHEN fq=4 THEN CAST(fy AS VARCHAR) ELSE fy||'.'||fq||'Q' END display, fy||'(E)' estimate,
      fy||'.Q'||fq from_reference, fy||'.'||fq||'Q' from_end, fy parsed_fy, CASE WHEN fq=4 THEN 0 ELSE fq END parsed_fq FROM stmt""",
)
def dt6(spark, sf):
    fy, fq = F.col("fy"), F.col("fq")
    q0 = F.when(fq == 4, F.lit(0)).otherwise(fq)
    mid = F.concat(fy, F.lpad((fq * 3 - 1).cast("string"), 2, "0"), F.lit("15"))
    end = F.concat(fy, F.lit("-"), F.lpad((fq * 3).cast("string"), 2, "0"), F.lit("-30"))
    display = D.period_label(fy, q0, "display")
    return X.stmt(spark, sf).select(
        "issuer", "fy", "fq", D.period_label(fy, q0).alias("internal"), display.alias("display"),
        D.estimate_label(fy).alias("estimate"), D.quarter_of_reference(mid).alias("from_reference"),
        D.quarter_end_label(end).alias("from_end"),
        D.parse_period(display)["fy"].cast("bigint").alias("parsed_fy"),
        D.parse_period(display)["fq"].cast("bigint").alias("parsed_fq"),
    )


def _prev(spark, sf):
    return J.prior_period_join(X.stmt(spark, sf), keys=["issuer", "fq"], measures=MS)


_PREV = STMT + f", p AS (SELECT s.*, {_each('p.{m} prev_{m}')} FROM stmt s LEFT JOIN stmt p ON p.issuer=s.issuer AND p.fq=s.fq AND p.fy=s.fy-1)"


def _z(m: str) -> str:  # some zeros on both sides
    return f"CASE WHEN (issuer+fy)%6=0 THEN 0 ELSE {m} END"


@query(
    "m1_yoy_label_display",
    _PREV + f" SELECT issuer,fy,fq,{Q.yoy('c', 'b')} label FROM (SELECT *, net_income c, {_z('prev_net_income')} b FROM p) x",
)
def m1(spark, sf):
    base = F.when((F.col("issuer") + F.col("fy")) % 6 == 0, 0).otherwise(F.col("prev_net_income"))
    return _prev(spark, sf).select("issuer", "fy", "fq", M.yoy_label(F.col("net_income"), base).alias("label"))


@query(
    "m2_yoy_label_statement",
    _PREV + f" SELECT issuer,fy,fq,{Q.yoy('c', 'b', False)} label FROM (SELECT *, {_z('net_income')} c, CASE WHEN fq=2 THEN 0 ELSE prev_net_income END b FROM p) x",
)
def m2(spark, sf):
    cur = F.when((F.col("issuer") + F.col("fy")) % 6 == 0, 0).otherwise(F.col("net_income"))
    base = F.when(F.col("fq") == 2, 0).otherwise(F.col("prev_net_income"))
    return _prev(spark, sf).select("issuer", "fy", "fq", M.yoy_label(cur, base, display=False).alias("label"))


@query("m3_pct_change_note", _PREV + f" SELECT issuer,fy,fq,coalesce(CASE WHEN prev_net_income<>0 THEN {Q.pct('net_income', 'prev_net_income')} END,'') note FROM p")
def m3(spark, sf):
    return _prev(spark, sf).select(
        "issuer", "fy", "fq", M.pct_change_note(F.col("net_income"), F.col("prev_net_income")).alias("note")
    )


@query("m4_plain_yoy", _PREV + f" SELECT issuer,fy,fq,CASE WHEN prev_net_income>0 THEN {Q.pct('net_income', 'prev_net_income')} END yoy FROM p")
def m4(spark, sf):
    return _prev(spark, sf).select(
        "issuer", "fy", "fq", M.plain_yoy(F.col("net_income"), F.col("prev_net_income")).alias("yoy")
    )


# -- report rows ---------------------------------------------------------------------------------


def _cell(m: str, yoy: str) -> str:
    return f"CASE WHEN {m} IS NULL THEN '-' ELSE {Q.thousands(Q.eok(m))} || ' (' || {yoy} || ')' END"


_ANN = _each(_cell("{m}", Q.yoy("{m}", "lag({m}) OVER w")) + " {m}_cell")


@query("e7_annual_rows", "WITH " + X.QUARTERS_SQL + "," + X.ANNUAL_SQL + f" SELECT issuer, fy, {_ANN} FROM annual WINDOW w AS (PARTITION BY issuer ORDER BY fy)")
def e7a(spark, sf):
    return S.annual_rows(X.annual(spark, sf).withColumn("currency", F.lit("KRW")), measures=MS)


_QTR = _each(_cell("{m}", "coalesce({m}_yoy,'-')") + " {m}_cell")
FLAG_SQL = INCOME + "," + STAND_SQL.replace("cum ", "income ") + f""",
y AS (SELECT *, {_LAGGED} FROM stand WINDOW w AS (PARTITION BY issuer,fq ORDER BY fy))
SELECT issuer, fy||'.Q'||fq AS period, {_QTR} FROM y"""


@query("e7_quarterly_rows", FLAG_SQL)
def e7q(spark, sf):
    """Statement lines -> income records -> standalone quarters -> labels -> display rows."""
    income = S.income_records(_good_lines(spark, sf), keys=FILING)
    quarters = Y.standalone_from_cumulative(income, measures=MS)
    labelled = W.yoy_positional(quarters, measures=MS)
    return S.quarterly_rows(labelled.withColumn("currency", F.lit("KRW")), measures=MS)


def _bs_row(n: int, item: str, v: str) -> str:
    return (
        f"SELECT issuer, fy, fq, CAST({n} AS BIGINT) row_no, '{item}' item, coalesce({Q.thousands(Q.eok('c.' + v))},'-') amount,"
        f" coalesce({Q.thousands(Q.eok('c.p_' + v))},'-') previous_amount,"
        f" coalesce(CASE WHEN c.p_{v}<>0 THEN {Q.pct('c.' + v, 'c.p_' + v)} END,'') note FROM c"
    )


_BSCOLS = ["total_assets", "cash", "total_liabilities", "debt", "total_equity"]
_E6 = SHEETS + f""", d AS (SELECT *, {_skip('cash_and_equivalents', 'short_term_investments')} cash FROM debts WHERE currency='KRW'),
c AS (SELECT a.issuer, a.fy, a.fq, {", ".join(f"a.{c} {c}, b.{c} p_{c}" for c in _BSCOLS)}
  FROM d a LEFT JOIN d b ON b.issuer=a.issuer AND b.fq=a.fq AND b.fy=a.fy-1)
""" + " UNION ALL ".join(
    _bs_row(n, item, v)
    for n, (item, v) in enumerate(zip(["자산총계", "현금성자산", "부채총계", "이자부부채", "자본총계"], _BSCOLS), 1)
)


@query("e6_balance_sheet_rows", _E6)
def e6(spark, sf):
    sheets = S.balance_sheets(_good_lines(spark, sf), keys=FILING).where("currency = 'KRW'")
    return S.balance_sheet_rows(sheets, keys=["issuer", "fy", "fq"], prior_keys=["issuer", "fq"])


@query(
    "e13_statement_text",
    LINES + f""", t AS (SELECT issuer, fy, fq, sj_div, ord, trim(account_nm) nm, amount, v,
        lag(amount) OVER (PARTITION BY issuer, fq, ord ORDER BY fy) pa FROM good),
    n AS (SELECT *, CASE WHEN v IS NULL THEN amount ELSE {Q.thousands(Q.eok('v'))}||'억원' END ct,
        CASE WHEN {Q.amount('pa')} IS NULL THEN pa ELSE {Q.thousands(Q.eok(Q.amount('pa')))}||'억원' END pt FROM t WHERE nm<>'' AND amount<>''),
    s AS (SELECT issuer, fy, fq, sj_div, string_agg(nm||': 당기 '||ct||CASE WHEN coalesce(pa,'')<>'' AND pa<>amount THEN ', 전기 '||pt ELSE '' END, chr(10) ORDER BY ord) x FROM n GROUP BY ALL)
    SELECT issuer, fy, fq, coalesce(max(x) FILTER (WHERE sj_div='BS'),'') bs_text,
      coalesce(max(x) FILTER (WHERE sj_div='CIS'), max(x) FILTER (WHERE sj_div='IS'), '') is_text FROM s GROUP BY ALL""",
)
def e13(spark, sf):
    return S.statement_text(S.with_prior_amount(_good_lines(spark, sf), keys=["issuer", "fq", "ord"]), keys=["issuer", "fy", "fq"])


# -- reconciliation ------------------------------------------------------------------------------


def _performance(spark, sf, base=None):
    """Earnings-change notices in 백만원 with a period range: quarters, half years, nine months, years."""
    raw = X.cum_raw(spark, sf, base)
    fy, fq = F.col("fy"), F.col("fq")
    single = (F.col("issuer") + fq) % 4 == 0
    start_q = F.when(single, fq).otherwise(F.lit(1))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return raw.where((F.col("issuer") + fy) % 2 == 0).select(
        "issuer",
        (fy * 4 + fq).alias("ord"),
        F.concat(fy, F.lit("-"), two(start_q * 3 - 2), F.lit("-01")).alias("period_start"),
        F.concat(fy, F.lit("-"), two(fq * 3), F.lit("-28")).alias("period_end"),
        F.lit("백만원").alias("unit"),
        *(N.floor_div(F.col(m), 1_000_000).alias(m) for m in MS),
    )


_PERF_SQL = """
cum_raw AS (SELECT issuer, fy, fq, CAST(sum(revenue) OVER w AS BIGINT) revenue,
    CAST(sum(operating_income) OVER w AS BIGINT) operating_income, CAST(sum(net_income) OVER w AS BIGINT) net_income
  FROM quarters WINDOW w AS (PARTITION BY issuer, fy ORDER BY fq)),
perf AS (SELECT issuer, fy, CASE WHEN fq=4 AND NOT one THEN 0 ELSE fq END fq, NOT one AND fq IN (2,3) ytd,
    """ + ", ".join(f"{Q.floor_div(m, '1000000')}*1000000 {m}" for m in MS) + """
  FROM (SELECT *, (issuer+fq)%4=0 one FROM cum_raw WHERE (issuer+fy)%2=0) x)"""

_NE = "coalesce({a}.revenue,{a}.operating_income,{a}.net_income) IS NOT NULL"


def perf_sql(src: str, out: str) -> str:
    """Quarterly statements after performance notices (plain quarters first, then spans)."""
    n2 = _each("p.{m}-a.{m} {m}")
    n3 = _each("p.{m}-(a.{m}+b.{m}) {m}")
    q3_empty = "coalesce(" + ",".join(f"a.{m}+b.{m}" for m in MS) + ") IS NULL"
    n3 = ", ".join(f"CASE WHEN {q3_empty} THEN p.{m} ELSE p.{m}-(a.{m}+b.{m}) END {m}" for m in MS)

    def merge(base: str, new: str, name: str) -> str:
        pick = _each(
            "CASE WHEN coalesce(o.revenue,o.operating_income,o.net_income) IS NOT NULL OR n.issuer IS NULL THEN o.{m} ELSE n.{m} END {m}"
        )
        return (
            f"{name} AS (SELECT coalesce(o.issuer,n.issuer) issuer, coalesce(o.fy,n.fy) fy, coalesce(o.fq,n.fq) fq, {pick}"
            f" FROM {base} o FULL JOIN {new} n ON o.issuer=n.issuer AND o.fy=n.fy AND o.fq=n.fq)"
        )

    key = "p.issuer=a.issuer AND p.fy=a.fy"
    return f"""
{out}_n1 AS (SELECT issuer, fy, fq, {_each('{m}')} FROM perf WHERE fq>0 AND NOT ytd),
{merge(src, out + '_n1', out + '_s1')},
{out}_n2 AS (SELECT * FROM (SELECT p.issuer, p.fy, p.fq, {n2} FROM perf p JOIN {out}_s1 a ON {key} AND a.fq=1 AND {_NE.format(a='a')}
   WHERE p.ytd AND p.fq=2) z WHERE {_NE.format(a='z')}),
{merge(out + '_s1', out + '_n2', out + '_s2')},
{out}_n3 AS (SELECT * FROM (SELECT p.issuer, p.fy, p.fq, {n3} FROM perf p JOIN {out}_s2 a ON {key} AND a.fq=1 AND {_NE.format(a='a')}
   JOIN {out}_s2 b ON p.issuer=b.issuer AND p.fy=b.fy AND b.fq=2 AND {_NE.format(a='b')} WHERE p.ytd AND p.fq=3) z WHERE {_NE.format(a='z')}),
{merge(out + '_s2', out + '_n3', out)}"""


@query("e9_integrate_performance", STMT + "," + _PERF_SQL + "," + perf_sql("stmt", "merged") + " SELECT * FROM merged")
def e9(spark, sf):
    perf = S.performance_statements(_performance(spark, sf), measures=MS)
    return Y.integrate_performance(X.stmt(spark, sf), perf, measures=MS)


def _preliminary(spark, sf, base=None):
    raw = base or X.quarters(spark, sf)
    return raw.where((F.col("issuer") * 3 + F.col("fy") + F.col("fq")) % 3 == 0).select(
        "issuer",
        (F.col("fy") * 4 + F.col("fq")).alias("ord"),
        F.concat(F.col("fy"), F.lit("."), F.col("fq"), F.lit("Q")).alias("label"),
        F.when(F.col("issuer") % 2 == 0, F.lit("백만원")).otherwise(F.lit("천원")).alias("unit"),
        *(N.floor_div(F.col(m), 1_000_000).alias(m) for m in MS),
    )


_PRE = f"""pre AS (SELECT issuer, fy, fq, {_each(Q.floor_div('{m}', '1000000') + '*CASE WHEN issuer%2=0 THEN 1000000 ELSE 1000 END {m}')}
  FROM quarters WHERE (issuer*3+fy+fq)%3=0)"""
_PREPICK = _each("CASE WHEN coalesce(s.revenue,s.operating_income,s.net_income) IS NOT NULL OR p.issuer IS NULL THEN s.{m} ELSE p.{m} END {m}")


@query(
    "e10_integrate_preliminary",
    STMT + f", {_PRE} SELECT coalesce(s.issuer,p.issuer) issuer, coalesce(s.fy,p.fy) fy, coalesce(s.fq,p.fq) fq, {_PREPICK} FROM stmt s FULL JOIN pre p ON s.issuer=p.issuer AND s.fy=p.fy AND s.fq=p.fq",
)
def e10(spark, sf):
    pre = S.preliminary_statements(_preliminary(spark, sf), measures=MS)
    return Y.integrate_preliminary(X.stmt(spark, sf), pre, measures=MS)


_E11 = (
    STMT + "," + X.ANNUAL_SQL + "," + X.CUM_SQL + "," + _PERF_SQL + "," + perf_sql("stmt", "m1") + f", {_PRE},"
    + f" m2 AS (SELECT coalesce(s.issuer,p.issuer) issuer, coalesce(s.fy,p.fy) fy, coalesce(s.fq,p.fq) fq, {_PREPICK} FROM m1 s FULL JOIN pre p ON s.issuer=p.issuer AND s.fy=p.fy AND s.fq=p.fq),"
    + fill_sql("m2", "cum", "m3")
    + f""", ann2 AS (SELECT coalesce(o.issuer,n.issuer) issuer, coalesce(o.fy,n.fy) fy,
      {_each("CASE WHEN coalesce(o.revenue,o.operating_income,o.net_income) IS NOT NULL OR n.issuer IS NULL THEN o.{m} ELSE n.{m} END {m}")}
      FROM annual o FULL JOIN (SELECT * FROM perf WHERE fq=0) n ON o.issuer=n.issuer AND o.fy=n.fy),"""
    + q4_sql("m3", "m4").format(annual="ann2")
    + f""", lab AS (SELECT *, {_LAGGED} FROM m4 WINDOW w AS (PARTITION BY issuer,fq ORDER BY fy)),
    top AS (SELECT * FROM lab WHERE coalesce(revenue,operating_income,net_income) IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY fy DESC, fq DESC)<=8)
    SELECT * FROM top QUALIFY fy >= max(fy) OVER (PARTITION BY issuer) - 1"""
)


@query("e11_reconcile_statements", _E11)
def e11(spark, sf):
    """Five sources derived from quarterly sums, which are computed once."""
    base = saved(X.quarters(spark, sf), "quarters")
    return S.reconcile_statements(
        X.stmt(spark, sf, base),
        X.annual(spark, sf, base),
        X.cum(spark, sf, base),
        S.performance_statements(_performance(spark, sf, base), measures=MS),
        S.preliminary_statements(_preliminary(spark, sf, base), measures=MS),
        measures=MS, n_quarters=8, n_years=2,
    )

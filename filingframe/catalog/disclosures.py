"""Queries on the disclosure log and the dilution state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..dilution import fold as FD
from ..dilution import schemas as sc
from ..dilution import state as ST
from ..documents import events as EV
from ..functions import dates as D
from ..functions import numbers as N
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ordering as O
from ..operators import predicates as P
from ..operators import windows as W
from ..plans import valuation as V
from ..session import cut_lineage
from . import proxies as X
from . import sqltext as Q
from .registry import query

DISC = "WITH " + X.DISC_SQL
AS_OF = "2024-01-20"


def _as_of():
    return F.lit(AS_OF).cast("date")


def _pick(expr, values):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (expr + 1).cast("int"))


# -- inputs of the state -------------------------------------------------------------------------


def notes(spark, sf):
    return notes_of(X.disc(spark, sf))


def notes_of(disc, *more):
    d = disc.where("kind = 'signup'")
    k = F.col("k")
    return d.select(
        "issuer", "ord", _pick(k % 4, ["CB", "BW", "SO", "전환우선주"]).alias("category"), "series",
        F.concat(F.lit("제 "), F.col("series").cast("string"), F.lit("종")).alias("kind"),
        F.when(k % 8 == 0, 0).otherwise(F.col("face")).cast("bigint").alias("face_value"),
        F.when(k % 3 == 0, None).when(k % 7 == 0, 0).otherwise(N.floor_div(F.col("face"), 2)).cast("bigint").alias("remaining_balance"),
        F.when(k % 5 == 0, 0).otherwise(F.col("shares")).cast("bigint").alias("convertible_shares"),
        F.when(k % 6 == 0, 0).otherwise(F.col("price")).cast("bigint").alias("conversion_price"),
        F.when(k % 9 == 0, "").otherwise("2023.01.05").alias("exercise_start"),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("2024.01."), (k % 19 + 10).cast("string"))).alias("exercise_end"),
        *more,
    )


NOTES_SQL = """
notes AS (SELECT issuer, ord, ['CB','BW','SO','전환우선주'][k%4+1] category, series, '제 '||series||'종' kind,
    CASE WHEN k%8=0 THEN 0 ELSE face END face_value,
    CASE WHEN k%3=0 THEN NULL WHEN k%7=0 THEN 0 ELSE face//2 END remaining_balance,
    CASE WHEN k%5=0 THEN 0 ELSE shares END convertible_shares, CASE WHEN k%6=0 THEN 0 ELSE price END conversion_price,
    CASE WHEN k%9=0 THEN '' ELSE '2023.01.05' END exercise_start,
    CASE WHEN k%11=0 THEN '' ELSE '2024.01.'||(k%19+10) END exercise_end
  FROM disc WHERE kind='signup')"""

def _receipt():
    return F.concat(F.date_format("entry_date", "yyyyMMdd"), F.lpad(F.col("ord").cast("string"), 6, "0"))



def decisions(spark, sf):
    return decisions_of(X.disc(spark, sf))


def decisions_of(disc, *more):
    d = disc.where("kind = 'view'")
    k = F.col("k")
    day = F.date_format("entry_date", "yyyyMMdd")
    cat = _pick(k % 6, ["CB", "BW", "PERPETUAL", "STOCK_OPTION", "RIGHTS_ISSUE", "MIXED_ISSUE"])
    return d.select(
        "issuer", "ord", cat.alias("category"), "series", F.lit("kind").alias("kind"),
        F.when(k % 8 == 1, 0).otherwise(F.col("face")).cast("bigint").alias("face_value"),
        F.when(k % 7 == 1, 0).otherwise(F.col("price")).cast("bigint").alias("conversion_price"),
        F.when(k % 5 == 1, 0).otherwise(F.col("shares")).cast("bigint").alias("convertible_shares"),
        F.when(k % 10 == 4, 0).otherwise(F.col("shares")).cast("bigint").alias("shares"),
        F.lit(700).cast("bigint").alias("issue_price"),
        F.when(k % 4 == 1, 0).otherwise(F.col("price") + 1).cast("bigint").alias("exercise_price"),
        F.when(k % 9 == 1, "").otherwise(F.concat(day, F.lit("s"))).alias("cv_start"),
        F.when(k % 9 == 2, "").otherwise(F.concat(day, F.lit("e"))).alias("cv_end"),
        _receipt().alias("rcept_no"),
        F.lit(sc.RIGHTS_CATEGORY).alias("share_type"),
        day.alias("pdf_date"),
        *more,
    )


DECISIONS_SQL = """
decisions AS (SELECT issuer, ord, ['CB','BW','PERPETUAL','STOCK_OPTION','RIGHTS_ISSUE','MIXED_ISSUE'][k%6+1] category, series,
    CASE WHEN k%8=1 THEN 0 ELSE face END face_value, CASE WHEN k%7=1 THEN 0 ELSE price END conversion_price,
    CASE WHEN k%5=1 THEN 0 ELSE shares END convertible_shares, CASE WHEN k%10=4 THEN 0 ELSE shares END shares,
    CASE WHEN k%4=1 THEN 0 ELSE price+1 END exercise_price,
    CASE WHEN k%9=1 THEN '' ELSE strftime(entry_date,'%Y%m%d')||'s' END cv_start,
    CASE WHEN k%9=2 THEN '' ELSE strftime(entry_date,'%Y%m%d')||'e' END cv_end,
    strftime(entry_date,'%Y%m%d')||lpad(CAST(ord AS VARCHAR),6,'0') rcept_no
  FROM disc WHERE kind='view')"""


def exercises(spark, sf, keyless: bool = False):
    return exercises_of(X.disc(spark, sf), keyless=keyless)


def exercises_of(disc, *more, keyless: bool = True):
    d = disc.where("kind = 'click'")
    k = F.col("k")
    nothing = F.lit(None).cast("bigint")
    return d.select(
        "issuer", "entry_date", "ord", F.lit(0).cast("bigint").alias("pos"),
        F.when(k % 12 == 11, F.lit(sc.OPTION_EXERCISE)).when(k % 2 == 0, F.lit("신주인수권행사")).otherwise(F.lit("전환청구권행사")).alias("type"),
        (k % 15 == 14).alias("exchangeable"),
        F.when((k % 10 == 9) & F.lit(keyless), nothing).otherwise(F.col("series") + k % 2).alias("series"),
        (k % 3 != 0).alias("has_remaining"),
        F.when(k % 6 == 1, nothing).when(k % 6 == 2, 0).otherwise(N.floor_div(F.col("face"), 3)).cast("bigint").alias("remaining"),
        F.when(k % 9 == 0, nothing).otherwise(F.col("face")).alias("face_value"),
        F.when(k % 8 == 3, nothing).otherwise(F.col("price") + 7).alias("conversion_price"),
        F.when(k % 4 == 3, 0).when(k % 4 == 2, nothing).otherwise(F.col("shares") + 3).cast("bigint").alias("convertible_shares"),
        F.when(k % 7 == 5, F.col("shares") + 9).alias("remaining_shares"),
        F.when(k % 12 == 11, F.col("shares") + 11).alias("new_shares"),
        *more,
    )


EXERCISES_SQL = """
exer AS (SELECT issuer, entry_date, ord, CASE WHEN k%2=0 THEN '신주인수권행사' ELSE '전환청구권행사' END AS type, k%12=11 is_option, k%15=14 exchangeable,
    series + k%2 series, k%3<>0 has_remaining,
    CASE WHEN k%6=1 THEN NULL WHEN k%6=2 THEN 0 ELSE face//3 END remaining, CASE WHEN k%9=0 THEN NULL ELSE face END face_value,
    CASE WHEN k%8=3 THEN NULL ELSE price+7 END conversion_price,
    CASE WHEN k%4=3 THEN 0 WHEN k%4=2 THEN NULL ELSE shares+3 END convertible_shares,
    CASE WHEN k%7=5 THEN shares+9 END remaining_shares, CASE WHEN k%12=11 THEN shares+11 END new_shares
  FROM disc WHERE kind='click')"""


def adjustments(spark, sf, keyless: bool = False):
    return adjustments_of(X.disc(spark, sf), keyless=keyless)


def adjustments_of(disc, *more, keyless: bool = True):
    d = disc.where("kind = 'purchase'")
    k = F.col("k")
    nothing = F.lit(None).cast("bigint")
    series = F.when((k % 10 == 7) & F.lit(keyless), nothing).otherwise(F.col("series"))
    return d.select(
        "issuer", "entry_date", "ord", (k % 2).cast("int").alias("part"), F.lit(0).cast("bigint").alias("pos"),
        series.alias("series"),
        F.col("price").alias("price_before"),
        F.when(k % 16 == 0, nothing).when(k % 14 == 0, 90).otherwise(F.col("price") - 13).cast("bigint").alias("price_after"),
        F.col("shares").alias("shares_before"), nothing.alias("current_shares"),
        F.when(k % 3 == 0, nothing).otherwise(F.col("shares") + 21).alias("shares_after"),
        F.when(k % 5 == 0, nothing).when(k % 5 == 1, 0).otherwise(F.col("face")).cast("bigint").alias("unconverted"),
        *more,
    )


ADJ_SQL = """
adj AS (SELECT issuer, entry_date, ord, k%2 part, series,
    CASE WHEN k%16=0 THEN NULL WHEN k%14=0 THEN 90 ELSE price-13 END price_after,
    CASE WHEN k%3=0 THEN NULL ELSE shares+21 END shares_after,
    CASE WHEN k%5=0 THEN NULL WHEN k%5=1 THEN 0 ELSE face END unconverted
  FROM disc WHERE kind='purchase')"""

_KEY = "CASE WHEN category IN ('CB','BW','SO') THEN category||'_'||series ELSE 'PREF_'||replace(kind,' ','_') END"
V4_SQL = NOTES_SQL + f""",
base AS (SELECT issuer, key instrument_key, first_ord, category, series, kind, face_value,
    CASE WHEN category='SO' THEN 0 ELSE coalesce(remaining_balance, face_value) END remaining, conversion_price,
    CASE WHEN category='SO' OR coalesce(remaining_balance, face_value)>0 THEN convertible_shares ELSE 0 END convertible_shares,
    exercise_start, exercise_end
  FROM (SELECT *, {_KEY} key, row_number() OVER (PARTITION BY issuer, {_KEY} ORDER BY ord DESC) rn,
      min(ord) OVER (PARTITION BY issuer, {_KEY}) first_ord FROM notes) x WHERE rn=1)"""
_COLS = "issuer, instrument_key, category, series, kind, face_value, remaining, conversion_price, convertible_shares, exercise_start, exercise_end"
OUT = [c.strip() for c in _COLS.split(",")]


def _q(sql: str) -> str:
    return DISC + "," + sql


@query("v4_apply_notes", _q(V4_SQL) + f" SELECT {_COLS} FROM base")
def v4(spark, sf):
    return ST.apply_notes(notes(spark, sf)).select(*OUT)


@query(
    "v0_instrument_key",
    _q(DECISIONS_SQL) + """ SELECT ord, CASE WHEN category IN ('CB','BW','PERPETUAL') THEN category||'_'||series
      WHEN category='STOCK_OPTION' THEN 'SO_'||series ELSE 'RIGHTS_'||rcept_no END instrument_key FROM decisions""",
)
def v0(spark, sf):
    d = decisions(spark, sf)
    return d.select("ord", ST.instrument_key(F.col("category"), F.col("series"), F.col("kind"), F.col("rcept_no")).alias("instrument_key"))


_ISS = """iss AS (SELECT issuer, ord, series, ['제1회 전환사채','교환사채','신주인수권부사채',''][k%4+1] kind, face,
   CASE WHEN k%7=0 THEN 90 ELSE price END price, CASE WHEN k%3=0 THEN 0 ELSE shares END shares FROM disc WHERE kind='error')"""


def issuances(spark, sf):
    k = F.col("k")
    return X.disc(spark, sf).where("kind = 'error'").select(
        "issuer", "ord", "series", _pick(k % 4, ["제1회 전환사채", "교환사채", "신주인수권부사채", ""]).alias("kind"),
        F.col("face").alias("face_value"), F.when(k % 7 == 0, 90).otherwise(F.col("price")).cast("bigint").alias("conversion_price"),
        F.when(k % 3 == 0, 0).otherwise(F.col("shares")).cast("bigint").alias("convertible_shares"),
        F.lit("2024.01.01").alias("exercise_start"), F.lit("").alias("exercise_end"),
    )


@query(
    "v1_apply_issuance",
    _q(_ISS) + """ SELECT issuer, c||'_'||series instrument_key, c category, series, kind, face face_value, face remaining, price conversion_price,
      CASE WHEN shares<>0 THEN shares WHEN price>=100 THEN face//price ELSE 0 END convertible_shares, '2024.01.01' exercise_start, '' exercise_end
      FROM (SELECT *, CASE WHEN kind='신주인수권부사채' THEN 'BW' ELSE 'CB' END c FROM iss WHERE kind<>'교환사채') x
      QUALIFY row_number() OVER (PARTITION BY issuer, c, series ORDER BY ord DESC)=1""",
)
def v1(spark, sf):
    return ST.apply_issuance(issuances(spark, sf)).select(*OUT)


def _nz(c: str) -> str:
    return f"nullif({c},0)"


_FIRST = "(list({v} ORDER BY ord) FILTER (WHERE ({v}) IS NOT NULL))[1]"
_LAST = "(list({v} ORDER BY ord DESC) FILTER (WHERE ({v}) IS NOT NULL))[1]"
V2_SQL = V4_SQL + "," + DECISIONS_SQL + f""",
ev AS (SELECT *, CASE WHEN category IN ('CB','BW','PERPETUAL') THEN category||'_'||series WHEN category='STOCK_OPTION' THEN 'SO_'||series ELSE 'RIGHTS_'||rcept_no END key,
    category='STOCK_OPTION' opt, category LIKE '%ISSUE' rts FROM decisions WHERE category IN ('CB','BW','PERPETUAL') OR
      CASE WHEN category='STOCK_OPTION' THEN coalesce({_nz('shares')},{_nz('convertible_shares')},0) ELSE shares END > 0),
ev2 AS (SELECT *, CASE WHEN opt THEN coalesce({_nz('exercise_price')},{_nz('conversion_price')}) WHEN rts THEN coalesce({_nz('conversion_price')},700) ELSE {_nz('conversion_price')} END p,
    CASE WHEN opt THEN coalesce({_nz('shares')},{_nz('convertible_shares')}) WHEN rts THEN shares ELSE {_nz('convertible_shares')} END s,
    CASE WHEN NOT opt THEN {_nz('face_value')} END f, nullif(cv_start,'') a, nullif(cv_end,'') b FROM ev),
g AS (SELECT issuer, key, min(ord) first_ord, bool_or(opt) opt, any_value(rts) rts, any_value(category) category, any_value(series) series,
    {_FIRST.format(v='p')} fp, {_LAST.format(v='p')} lp, {_FIRST.format(v='s')} fs, {_LAST.format(v='s')} ls, {_FIRST.format(v='f')} ff,
    {_FIRST.format(v='a')} fa, {_LAST.format(v='a')} la, {_FIRST.format(v='b')} fb, {_LAST.format(v='b')} lb,
    nullif(arg_min(CASE WHEN coalesce(s,0)<>0 THEN s WHEN coalesce(p,0)>=100 THEN coalesce(f,0)//p ELSE 0 END, ord),0) os FROM ev2 GROUP BY issuer, key),
known AS (SELECT b.issuer, b.instrument_key, 1 ph, b.first_ord, b.category, b.series, b.kind,
    CASE WHEN b.face_value=0 AND NOT coalesce(opt,false) AND ff IS NOT NULL THEN ff ELSE b.face_value END face_value,
    CASE WHEN b.face_value=0 AND NOT coalesce(opt,false) AND ff IS NOT NULL THEN ff ELSE remaining END remaining,
    CASE WHEN opt THEN coalesce(lp,conversion_price) ELSE coalesce({_nz('conversion_price')},fp,0) END conversion_price,
    CASE WHEN opt THEN coalesce(ls,convertible_shares) ELSE coalesce({_nz('convertible_shares')},fs,0) END convertible_shares,
    CASE WHEN opt THEN coalesce(la,exercise_start) ELSE coalesce(nullif(exercise_start,''),fa,'') END exercise_start,
    CASE WHEN opt THEN coalesce(lb,exercise_end) ELSE coalesce(nullif(exercise_end,''),fb,'') END exercise_end
  FROM base b LEFT JOIN g ON g.issuer=b.issuer AND g.key=b.instrument_key),
fresh AS (SELECT issuer, key instrument_key, 2 ph, first_ord, CASE WHEN rts THEN '전환우선주' WHEN opt THEN '주식매수선택권' WHEN category='PERPETUAL' THEN '영구채' ELSE category END category,
    CASE WHEN rts THEN 0 ELSE series END series, CASE WHEN rts THEN '전환우선주' ELSE 'kind' END kind, coalesce(ff,0) face_value, coalesce(ff,0) remaining,
    coalesce(CASE WHEN opt THEN lp ELSE fp END,0) conversion_price,
    coalesce(CASE WHEN opt THEN ls WHEN rts THEN fs ELSE coalesce(os,fs) END,0) convertible_shares,
    coalesce(CASE WHEN opt THEN la ELSE fa END,'') exercise_start, coalesce(CASE WHEN opt THEN lb ELSE fb END,'') exercise_end
  FROM g WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.issuer=g.issuer AND b.instrument_key=g.key)),
s2 AS (SELECT * FROM known UNION ALL SELECT * FROM fresh)"""


@query("v2_apply_events", _q(V2_SQL) + f" SELECT {_COLS} FROM s2")
def v2(spark, sf):
    return ST.apply_events(decisions(spark, sf), ST.apply_notes(notes(spark, sf))).select(*OUT)


def _state2(spark, sf):
    """State before exercises; later steps read it several times, so its lineage is cut."""
    return cut_lineage(ST.apply_events(decisions(spark, sf), ST.apply_notes(notes(spark, sf))))


_EO = "entry_date, ord"
V5_SQL = V2_SQL + "," + EXERCISES_SQL + f""",
ex AS (SELECT *, CASE WHEN has_remaining THEN remaining ELSE face_value END rem, coalesce({_nz('convertible_shares')}, remaining_shares) cs FROM exer WHERE NOT exchangeable),
own AS (SELECT issuer, series, instrument_key FROM s2 QUALIFY row_number() OVER (PARTITION BY issuer, series ORDER BY ph, first_ord)=1),
seen AS (SELECT e.*, o.instrument_key okey FROM ex e LEFT JOIN own o ON o.issuer=e.issuer AND o.series=e.series WHERE NOT is_option),
open1 AS (SELECT * FROM seen WHERE okey IS NULL AND (coalesce(rem,0)<>0 OR coalesce(cs,0)<>0) QUALIFY row_number() OVER (PARTITION BY issuer, series ORDER BY {_EO})=1),
upd AS (SELECT s.issuer, coalesce(s.okey, CASE WHEN o.type='신주인수권행사' THEN 'BW_' ELSE 'CB_' END||s.series) key, s.entry_date, s.ord, s.rem, s.conversion_price cp, s.cs
  FROM seen s LEFT JOIN open1 o ON o.issuer=s.issuer AND o.series=s.series WHERE s.okey IS NOT NULL OR (o.ord IS NOT NULL AND (s.entry_date,s.ord)>=(o.entry_date,o.ord))),
lst AS (SELECT issuer, key, (list(rem ORDER BY entry_date DESC, ord DESC) FILTER (WHERE rem IS NOT NULL))[1] r,
    (list(cp ORDER BY entry_date DESC, ord DESC) FILTER (WHERE cp IS NOT NULL))[1] p, (list(cs ORDER BY entry_date DESC, ord DESC) FILTER (WHERE cs IS NOT NULL))[1] s,
    max(ord) FILTER (WHERE cs IS NOT NULL) tm FROM upd GROUP BY issuer, key),
opts AS (SELECT issuer, max(ord) tm, arg_max(new_shares, ord) n FROM exer WHERE is_option GROUP BY issuer),
both_s AS (SELECT * FROM s2 UNION ALL SELECT issuer, CASE WHEN type='신주인수권행사' THEN 'BW_' ELSE 'CB_' END||series, 4, ord, CASE WHEN type='신주인수권행사' THEN 'BW' ELSE 'CB' END, series, '제'||series||'회',
    coalesce({_nz('face_value')},rem,0), coalesce(rem,0), coalesce(conversion_price,0), coalesce(cs,0), '', '' FROM open1),
s4 AS (SELECT b.issuer, instrument_key, ph, first_ord, category, series, kind, face_value, coalesce(l.r, remaining) remaining, coalesce(l.p, conversion_price) conversion_price,
    CASE WHEN category IN ('SO','주식매수선택권') AND o.n IS NOT NULL AND (l.tm IS NULL OR o.tm>l.tm) THEN o.n ELSE coalesce(l.s, convertible_shares) END convertible_shares, exercise_start, exercise_end
  FROM both_s b LEFT JOIN lst l ON l.issuer=b.issuer AND l.key=b.instrument_key LEFT JOIN opts o ON o.issuer=b.issuer
  UNION ALL SELECT issuer, 'SO_0', 4, tm, '주식매수선택권', 0, '', 0, 0, 0, n, '', '' FROM opts o WHERE NOT EXISTS (SELECT 1 FROM s2 WHERE s2.issuer=o.issuer AND s2.category IN ('SO','주식매수선택권')))"""


@query("v5_apply_exercise", _q(V5_SQL) + f" SELECT {_COLS} FROM s4")
def v5(spark, sf):
    return ST.apply_exercises(exercises(spark, sf), _state2(spark, sf)).select(*OUT)


_AO = "entry_date, ord"
V6_SQL = V2_SQL + "," + ADJ_SQL + f""",
own AS (SELECT issuer, series, instrument_key, remaining r0 FROM s2 QUALIFY row_number() OVER (PARTITION BY issuer, series ORDER BY ph, first_ord)=1),
ad AS (SELECT a.*, o.instrument_key, r0, last_value(CASE WHEN part=1 THEN unconverted END IGNORE NULLS) OVER (PARTITION BY a.issuer, o.instrument_key ORDER BY {_AO} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) lu
  FROM adj a JOIN own o ON o.issuer=a.issuer AND o.series=a.series),
ad2 AS (SELECT *, CASE WHEN part=0 THEN price_after END p, CASE WHEN part=1 THEN unconverted END u,
    CASE WHEN part=1 THEN shares_after WHEN price_after>=100 AND coalesce(lu,r0)<>0 THEN coalesce(lu,r0)//price_after END s FROM ad),
al AS (SELECT issuer, instrument_key, (list(p ORDER BY entry_date DESC, ord DESC) FILTER (WHERE p IS NOT NULL))[1] p,
   (list(u ORDER BY entry_date DESC, ord DESC) FILTER (WHERE u IS NOT NULL))[1] u, (list(s ORDER BY entry_date DESC, ord DESC) FILTER (WHERE s IS NOT NULL))[1] s FROM ad2 GROUP BY ALL),
s5 AS (SELECT b.issuer, b.instrument_key, category, series, kind, face_value, coalesce(u, remaining) remaining, coalesce(p, conversion_price) conversion_price,
    coalesce(s, convertible_shares) convertible_shares, exercise_start, exercise_end FROM s2 b LEFT JOIN al a ON a.issuer=b.issuer AND a.instrument_key=b.instrument_key)"""


@query("v6_apply_price_adjustment", _q(V6_SQL) + f" SELECT {_COLS} FROM s5")
def v6(spark, sf):
    return ST.apply_price_adjustments(adjustments(spark, sf), _state2(spark, sf)).select(*OUT)


@query("v6_fold_series_only", _q(V6_SQL) + f" SELECT {_COLS} FROM s5")
def v6_fold(spark, sf):
    """The general entry gives the same instruments when every record names a series."""
    return FD.fold_adjustments(adjustments(spark, sf), _state2(spark, sf)).select(*OUT)


_RD = """rdoc AS (SELECT issuer, ord, strftime(entry_date,'%Y%m%d') d, CASE WHEN k%4=0 THEN 0 ELSE shares END oth, 500+(price%20)*10 p, CASE WHEN k%3=0 THEN 0 ELSE shares*2 END cs,
   CASE WHEN k%5=0 THEN NULL ELSE 'a'||k END a, CASE WHEN k%6=0 THEN NULL ELSE 'b'||k END b FROM disc WHERE kind='error'),
 rbase AS (SELECT issuer, 'RIGHTS_B'||ord instrument_key, ord, 500+(price%20)*10 price, shares, CASE WHEN k%2=0 THEN 0 ELSE face END face FROM disc WHERE kind='signup')"""


def _rights_inputs(spark, sf):
    k = F.col("k")
    d = X.disc(spark, sf)
    p = F.lit(500).cast("bigint") + (F.col("price") % 20) * 10
    docs = d.where("kind = 'error'").select(
        "issuer", "ord", F.date_format("entry_date", "yyyyMMdd").alias("disclosure_date"),
        F.when(k % 4 == 0, 0).otherwise(F.col("shares")).cast("bigint").alias("other_shares"), p.alias("conversion_price"),
        F.when(k % 3 == 0, 0).otherwise(F.col("shares") * 2).cast("bigint").alias("conversion_shares"),
        F.lit(0).cast("bigint").alias("issue_price"), F.lit(0).cast("bigint").alias("funding"), F.lit("우선주").alias("share_type"),
        F.when(k % 5 != 0, F.concat(F.lit("a"), k.cast("string"))).alias("exercise_start"),
        F.when(k % 6 != 0, F.concat(F.lit("b"), k.cast("string"))).alias("exercise_end"),
    )
    face = F.when(k % 2 == 0, 0).otherwise(F.col("face")).cast("bigint")
    state = d.where("kind = 'signup'").select(
        "issuer", F.concat(F.lit("RIGHTS_B"), F.col("ord").cast("string")).alias("instrument_key"),
        F.struct(F.lit(2).alias("phase"), F.col("ord")).alias("inserted"), F.lit("전환우선주").alias("category"),
        F.lit(0).cast("bigint").alias("series"), F.lit("").alias("kind"), face.alias("face_value"), face.alias("remaining"),
        p.alias("conversion_price"), F.col("shares").alias("convertible_shares"), F.lit("").alias("exercise_start"), F.lit("").alias("exercise_end"),
    )
    return docs, state


@query(
    "v3_apply_rights_document",
    _q(_RD) + """, fb AS (SELECT issuer, price, arg_min(instrument_key, ord) key FROM rbase GROUP BY ALL),
    fd AS (SELECT issuer, p, arg_min(d, ord) d FROM rdoc WHERE oth>0 GROUP BY ALL),
    k AS (SELECT r.*, CASE WHEN cs<>0 THEN cs ELSE oth END s, coalesce(fb.key, 'RIGHTS_'||fd.d) key FROM rdoc r LEFT JOIN fb ON fb.issuer=r.issuer AND fb.price=r.p
       LEFT JOIN fd ON fd.issuer=r.issuer AND fd.p=r.p WHERE oth>0),
    g AS (SELECT issuer, key, arg_max(s, ord) s, arg_min(s*p, ord) f, arg_max(p, ord) p, (list(a ORDER BY ord) FILTER (WHERE a IS NOT NULL))[1] a, (list(b ORDER BY ord) FILTER (WHERE b IS NOT NULL))[1] b FROM k GROUP BY ALL)
    SELECT b.issuer, instrument_key, CASE WHEN b.face=0 AND f IS NOT NULL THEN f ELSE b.face END remaining, price conversion_price, coalesce(s, shares) convertible_shares, coalesce(a,'') exercise_start, coalesce(g.b,'') exercise_end
      FROM rbase b LEFT JOIN g ON g.issuer=b.issuer AND g.key=b.instrument_key
    UNION ALL SELECT issuer, key, f, p, s, coalesce(a,''), coalesce(b,'') FROM g WHERE key NOT LIKE 'RIGHTS_B%'""",
)
def v3(spark, sf):
    docs, state = _rights_inputs(spark, sf)
    return ST.apply_rights_documents(docs, state).select(
        "issuer", "instrument_key", "remaining", "conversion_price", "convertible_shares", "exercise_start", "exercise_end"
    )


@query(
    "v7_default_options",
    _q(V4_SQL) + f" SELECT {_COLS} FROM base UNION ALL SELECT issuer,'SO_0','주식매수선택권',0,'',0,0,0,5000,'','' FROM (SELECT DISTINCT issuer FROM disc) d WHERE issuer NOT IN (SELECT issuer FROM base WHERE instrument_key LIKE 'SO!_%' ESCAPE '!')",
)
def v7(spark, sf):
    everyone = X.disc(spark, sf).select("issuer").distinct().withColumn("shares", F.lit(5000).cast("bigint"))
    return ST.default_options(ST.apply_notes(notes(spark, sf)), everyone).select(*OUT)


_LIVE = f"(exercise_end='' OR TRY_CAST(replace(exercise_end,'.','-') AS DATE) IS NULL OR TRY_CAST(replace(exercise_end,'.','-') AS DATE)>=DATE '{AS_OF}')"
_AMT = "CASE WHEN conversion_price>0 AND convertible_shares>0 THEN conversion_price*convertible_shares ELSE remaining END"
_LABEL = "CASE category WHEN 'CB' THEN n||'전환사채(CB)' WHEN 'BW' THEN n||'신주인수권부사채(BW)' WHEN 'SO' THEN '주식매수선택권' ELSE n||category END"
V8_SQL = V4_SQL + f""",
v8 AS (SELECT issuer, instrument_key, {_LABEL} category_label,
    CASE WHEN amt>0 THEN {Q.thousands(Q.eok('amt'))}||' 억원 ('||{Q.thousands('convertible_shares')}||'주)' WHEN convertible_shares>0 THEN {Q.thousands('convertible_shares')}||'주' END remaining_amount,
    CASE WHEN conversion_price>0 THEN {Q.thousands('conversion_price')}||'원' END exercise_price,
    CASE WHEN convertible_shares>0 THEN CAST(CAST(round_even(CAST(convertible_shares AS DOUBLE)/1000000*100,2) AS DECIMAL(30,2)) AS VARCHAR)||'%' END dilution_ratio,
    CASE WHEN exercise_start='' AND exercise_end='' THEN '' ELSE exercise_start||'~'||exercise_end END exercise_period
  FROM (SELECT *, '제'||series||'회 ' n, {_AMT} amt FROM base) b WHERE (convertible_shares>0 OR remaining>0) AND {_LIVE})"""


def _table(spark, sf):
    return ST.overhang_table(
        ST.apply_notes(notes(spark, sf)), as_of=_as_of(), total_shares=F.lit(1_000_000).cast("bigint")
    )


@query("v8_overhang_table", _q(V8_SQL) + " SELECT * FROM v8")
def v8(spark, sf):
    return _table(spark, sf)


@query("o4_instrument_output_order", _q(V8_SQL) + " SELECT issuer, row_number() OVER (PARTITION BY issuer ORDER BY category_label, instrument_key) pos, instrument_key, category_label FROM v8")
def o4(spark, sf):
    """Positions in display order (an issuer's live instruments are few)."""
    w = Window.partitionBy("issuer").orderBy("category_label", "instrument_key")
    return O.order_instruments(_table(spark, sf)).select(
        "issuer", F.row_number().over(w).cast("bigint").alias("pos"), "instrument_key", "category_label"
    )


# The whole state, one record after the other: a book per issuer, a list in the order of opening.
# Written from the stated rules; the operators use aggregates instead.
_BOOK = {"key": "VARCHAR", "category": "VARCHAR", "series": "BIGINT", "kind": "VARCHAR", "face": "BIGINT", "rem": "BIGINT", "price": "BIGINT", "shares": "BIGINT", "a": "VARCHAR", "b": "VARCHAR"}


def walk_sql(counts: str = "true", more: str = "") -> str:
    """Instruments of every issuer after notes, decisions, exercises and adjustments; ``counts`` says which of the last three do."""
    book = "STRUCT(" + ", ".join(f"{n} {t}" for n, t in _BOOK.items()) + ")"
    none = {"key": "NULL", "category": "NULL", "series": "NULL", "kind": "''", "face": "NULL", "rem": "NULL", "price": "NULL", "shares": "NULL", "a": "''", "b": "''", "q": "NULL", "old": "NULL"}

    def rec(phase: int, mode: str, source: str, day: str = "NULL", **values: str) -> str:
        cols = ", ".join(f"{values.get(n, v)} AS {n}" for n, v in none.items())
        return f"SELECT issuer, {phase} AS phase, {mode} AS mode, {day} AS day, ord, {cols} FROM {source}"

    parts = [
        rec(1, "'note'", "notes", key=_KEY, category="category", series="series", kind="kind", face="face_value", price="conversion_price", a="exercise_start", b="exercise_end",
            rem="CASE WHEN category='SO' THEN 0 ELSE coalesce(remaining_balance, face_value) END",
            shares="CASE WHEN category='SO' OR coalesce(remaining_balance, face_value) > 0 THEN convertible_shares ELSE 0 END"),
        rec(2, "'bond'", f"decisions SEMI JOIN later USING (ord) WHERE category IN ('CB','BW','PERPETUAL')", key="category||'_'||series", category="CASE category WHEN 'PERPETUAL' THEN '영구채' ELSE category END",
            series="series", kind="'kind'", face="face_value", rem="face_value", price="conversion_price", a="cv_start", b="cv_end", shares="convertible_shares"),
        rec(2, "'option'", f"decisions SEMI JOIN later USING (ord) WHERE category='STOCK_OPTION' AND coalesce(nullif(shares,0), convertible_shares) > 0", key="'SO_'||series", category="'주식매수선택권'",
            series="series", kind="'kind'", face="0", rem="0", price="coalesce(nullif(exercise_price,0), conversion_price)", a="cv_start", b="cv_end", shares="coalesce(nullif(shares,0), convertible_shares)"),
        rec(2, "'rights'", f"decisions SEMI JOIN later USING (ord) WHERE category LIKE '%ISSUE' AND shares > 0", key="'RIGHTS_'||rcept_no", category="'전환우선주'", series="0", kind="'전환우선주'",
            face="face_value", rem="face_value", price="coalesce(nullif(conversion_price,0), 700)", a="cv_start", b="cv_end", shares="shares"),
        rec(3, "'grant'", "exer SEMI JOIN later USING (ord) WHERE is_option AND new_shares > 0", day="entry_date", key="'SO_0'", category="'주식매수선택권'", series="0", face="0", rem="0", price="0", shares="new_shares"),
        rec(3, "'balance'", "keyless SEMI JOIN later USING (ord) WHERE NOT is_option AND NOT exchangeable", day="entry_date",
            key="CASE WHEN type='신주인수권행사' THEN 'BW_' ELSE 'CB_' END||series", category="CASE WHEN type='신주인수권행사' THEN 'BW' ELSE 'CB' END", series="series",
            kind="'제'||series||'회'", face="face_value", rem="CASE WHEN has_remaining THEN remaining ELSE face_value END", price="conversion_price", shares="coalesce(nullif(convertible_shares,0), remaining_shares)"),
        rec(4, "CASE part WHEN 0 THEN 'price' ELSE 'shares' END", "changes SEMI JOIN later USING (ord) WHERE CASE part WHEN 0 THEN price_after IS NOT NULL ELSE coalesce(shares_after, unconverted) IS NOT NULL END",
            day="entry_date", series="series", price="price_after", rem="CASE part WHEN 1 THEN unconverted END", shares="CASE part WHEN 1 THEN shares_after END", old="CASE part WHEN 0 THEN price0 ELSE shares0 END"),
    ]
    named = "mode IN ('note', 'bond', 'option', 'rights')"
    place = f"""CASE WHEN {named} THEN list_position(list_transform(book, lambda x: x.key = r.key), true)
        WHEN mode = 'grant' THEN list_position(list_transform(book, lambda x: x.category IN ('SO', '주식매수선택권')), true)
        WHEN r.series IS NOT NULL THEN list_position(list_transform(book, lambda x: x.series = r.series), true)
        WHEN mode = 'balance' THEN list_position(list_transform(book, lambda x: r.price <> 0 AND starts_with(x.key, 'RIGHTS_') AND x.price = r.price), true)
        WHEN mode = 'price' THEN list_position(list_transform(book, lambda x: r.old <> 0 AND x.price = r.old), true)
        ELSE list_position(list_transform(book, lambda x: r.old <> 0 AND x.shares = r.old), true) END"""
    lacks = lambda f, blank="0": f"CASE WHEN x.{f} = {blank} THEN coalesce(nullif(s.{f}, {blank}), x.{f}) ELSE x.{f} END"
    newer = lambda f, blank="0": f"coalesce(nullif(s.{f}, {blank}), x.{f})"
    no_face = "s.mode = 'bond' AND x.face = 0 AND coalesce(s.face, 0) <> 0"
    term = lambda f: f"CASE WHEN s.mode IN ('bond', 'rights') THEN {lacks(f, chr(39) * 2)} WHEN s.mode = 'option' THEN {newer(f, chr(39) * 2)} ELSE x.{f} END"
    merged = {
        "key": "x.key", "category": "x.category", "series": "x.series", "kind": "x.kind", "face": f"CASE WHEN {no_face} THEN s.face ELSE x.face END",
        "rem": f"CASE WHEN s.mode IN ('balance', 'shares') THEN coalesce(s.rem, x.rem) WHEN {no_face} THEN s.face ELSE x.rem END",
        "price": f"CASE WHEN s.mode IN ('bond', 'rights') THEN {lacks('price')} WHEN s.mode = 'option' THEN {newer('price')} WHEN s.mode IN ('balance', 'price') THEN coalesce(s.price, x.price) ELSE x.price END",
        "shares": f"CASE WHEN s.mode = 'bond' THEN {lacks('shares')} WHEN s.mode IN ('option', 'grant') THEN s.shares WHEN s.mode IN ('balance', 'shares') THEN coalesce(s.shares, x.shares)"
        " WHEN s.mode = 'price' AND s.price >= 100 AND x.rem <> 0 THEN x.rem // s.price ELSE x.shares END",
        "a": term("a"), "b": term("b"),
    }
    zero = lambda f: f"coalesce(s.{f}, 0)"
    opened = {
        **{n: f"s.{n}" for n in ("key", "category", "series", "kind", "a", "b")}, "rem": zero("rem"), "price": zero("price"),
        "face": "CASE WHEN s.mode = 'balance' THEN coalesce(nullif(s.face, 0), s.rem, 0) ELSE coalesce(s.face, 0) END",
        "shares": "CASE WHEN s.mode = 'bond' AND coalesce(s.shares, 0) = 0 AND coalesce(s.price, 0) >= 100 THEN coalesce(s.face, 0) // s.price ELSE coalesce(s.shares, 0) END",
    }
    fields = lambda d: "{" + ", ".join(f"'{n}': {v}" for n, v in d.items()) + "}"
    hit = "i = s.place OR (s.mode = 'grant' AND x.category IN ('SO', '주식매수선택권'))"
    opens = f"s.{named} OR s.mode = 'grant' OR (s.mode = 'balance' AND s.series IS NOT NULL AND (coalesce(s.rem, 0) <> 0 OR coalesce(s.shares, 0) <> 0))"
    return DISC.replace("WITH ", "WITH RECURSIVE ", 1) + more + f""", {NOTES_SQL}, {DECISIONS_SQL}, {EXERCISES_SQL}, {ADJ_SQL},
keyless AS (SELECT e.* REPLACE (CASE WHEN d.k%10=9 THEN NULL ELSE e.series END AS series) FROM exer e JOIN disc d USING (ord)),
changes AS (SELECT a.* REPLACE (CASE WHEN d.k%10=7 THEN NULL ELSE a.series END AS series), d.price AS price0, d.shares AS shares0 FROM adj a JOIN disc d USING (ord)),
later AS (SELECT ord FROM disc WHERE {counts}),
recs AS (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY phase, day, ord) AS n FROM ({" UNION ALL ".join(parts)}) p),
walk AS (
  SELECT DISTINCT issuer, CAST(0 AS BIGINT) AS n, CAST([] AS {book}[]) AS book FROM recs
  UNION ALL
  SELECT issuer, n, CASE WHEN s.place > 0 THEN
      list_transform(book, lambda x, i: CASE WHEN NOT ({hit}) THEN x WHEN s.mode = 'note' THEN {fields(opened)} ELSE {fields(merged)} END)
    WHEN {opens} THEN list_append(book, {fields(opened)}) ELSE book END AS book
  FROM (SELECT r.*, w.book, coalesce({place}, 0) AS place FROM walk w JOIN recs r ON r.issuer = w.issuer AND r.n = w.n + 1) s),
ends AS (SELECT issuer, unnest(book) AS x FROM walk QUALIFY n = max(n) OVER (PARTITION BY issuer))
SELECT issuer, x.key AS instrument_key, x.category AS category, x.series AS series, x.kind AS kind, x.face AS face_value, x.rem AS remaining, x.price AS conversion_price,
  x.shares AS convertible_shares, x.a AS exercise_start, x.b AS exercise_end FROM ends"""


@query("v9_fold_instruments", walk_sql())
def v9(spark, sf):
    """The whole fold with keyless records."""
    return FD.fold_instruments(
        notes(spark, sf), decisions(spark, sf), exercises(spark, sf, keyless=True), adjustments(spark, sf, keyless=True)
    ).select(*OUT)


@query("p3c_infer_bond_category", _q(_ISS) + " SELECT ord, CASE WHEN kind='신주인수권부사채' THEN 'BW' ELSE 'CB' END category FROM iss WHERE kind<>'교환사채'")
def p3c(spark, sf):
    c = P.infer_bond_category("kind")
    return issuances(spark, sf).select("ord", c.alias("category")).where("category is not null")


# -- filters -------------------------------------------------------------------------------------


@query("p7_since_cutoff", DISC + f" SELECT issuer, ord FROM disc WHERE entry_date >= DATE '{AS_OF}' - 7")
def p7(spark, sf):
    return X.disc(spark, sf).where(P.since_cutoff("entry_date", _as_of(), 7)).select("issuer", "ord")


@query(
    "p8_after_reference",
    DISC + ", r AS (SELECT issuer, min(entry_date)+10 reference_date FROM disc WHERE issuer%3<>0 GROUP BY ALL), d2 AS (SELECT issuer, ord, CASE WHEN k%13<>0 THEN entry_date END entry_date FROM disc)"
    " SELECT d.issuer, ord FROM d2 d LEFT JOIN r ON r.issuer=d.issuer WHERE reference_date IS NULL OR entry_date>reference_date",
)
def p8(spark, sf):
    d = X.disc(spark, sf)
    refs = d.where("issuer % 3 <> 0").groupBy("issuer").agg(F.date_add(F.min("entry_date"), 10).alias("reference_date"))
    undated = d.withColumn("entry_date", F.when(F.col("k") % 13 != 0, F.col("entry_date")))
    return P.after_reference(undated, refs).select("issuer", "ord")


_API = """api AS (SELECT issuer, ord, k, CASE WHEN k%5=0 THEN '-' WHEN k%5=1 THEN '0' ELSE format('{:,}',shares) END o, CASE WHEN k%3=0 THEN '' ELSE format('{:,}',shares*2) END e FROM disc)"""


def _api(spark, sf):
    k = F.col("k")
    return X.disc(spark, sf).select(
        "issuer", "ord", "k",
        F.when(k % 5 == 0, "-").when(k % 5 == 1, "0").otherwise(F.format_number("shares", 0)).alias("o"),
        F.when(k % 3 == 0, "").otherwise(F.format_number(F.col("shares") * 2, 0)).alias("e"),
    )


@query(
    "p9_only_preferred_issues",
    _q(_API) + """ SELECT ord, k%3<>0 AS event_keeps, k%5<2 AND k%3<>0 AS decision_keeps, k%5>=2 AND k%3=0 AS document_drops FROM api""",
)
def p9(spark, sf):
    o, e = N.parse_amount("o"), N.parse_amount("e")
    return _api(spark, sf).select(
        "ord", P.preferred_issue_event(e).alias("event_keeps"),
        P.preferred_issue_decision(o, e).alias("decision_keeps"), P.common_only_document(o, e).alias("document_drops"),
    )


@query("p10_not_expired", _q(V4_SQL) + f" SELECT issuer, instrument_key FROM base WHERE {_LIVE}")
def p10(spark, sf):
    s = ST.apply_notes(notes(spark, sf))
    return s.where(P.not_expired("exercise_end", _as_of())).select("issuer", "instrument_key")


@query("p11_has_position", _q(V4_SQL) + " SELECT issuer, instrument_key FROM base WHERE convertible_shares>0 OR remaining>0")
def p11(spark, sf):
    s = ST.apply_notes(notes(spark, sf))
    return s.where(P.has_position("convertible_shares", "remaining")).select("issuer", "instrument_key")


@query(
    "p12_is_sparse",
    DISC + """ SELECT ord, CASE kind WHEN 'click' THEN k%2=0 AND k%3=0 WHEN 'purchase' THEN k%2=0 WHEN 'view' THEN k%4=0 OR k%5=0 WHEN 'signup' THEN k%6=0 ELSE true END sparse,
      (CASE WHEN k%2=0 THEN 0 ELSE 1 END)+(CASE WHEN k%3=0 THEN 0 ELSE 1 END)+(CASE WHEN k%5=0 THEN 0 ELSE 1 END)<2 sparse_rights, k%2=0 AND k%3=0 sparse_bond FROM disc""",
)
def p12(spark, sf):
    k = F.col("k")
    absent = lambda n: F.when(k % n != 0, k)
    cat = F.create_map(*(F.lit(x) for x in ("click", "exercise", "purchase", "price_adj", "view", "backlog", "signup", "sales")))[F.col("kind")]
    sparse = P.is_sparse_exchange(
        cat, balances=absent(2), claims=absent(3), adjustments=absent(2), amount=absent(4),
        description=F.when(k % 5 != 0, F.lit("x")), income=absent(6),
    )
    return X.disc(spark, sf).select(
        "ord", sparse.alias("sparse"), P.is_sparse_rights([absent(2), absent(3), absent(5)]).alias("sparse_rights"),
        P.is_sparse_bond(absent(2), absent(3)).alias("sparse_bond"),
    )


# -- joins ---------------------------------------------------------------------------------------

_BASEX = """b AS (SELECT issuer, series, CASE WHEN k%3=0 THEN 0 ELSE price END price, CASE WHEN k%4=0 THEN NULL ELSE shares END shares, CASE WHEN k%5=0 THEN '' ELSE 'n'||k END note
    FROM disc WHERE kind='signup' QUALIFY row_number() OVER (PARTITION BY issuer, series ORDER BY ord)=1),
  x AS (SELECT issuer, series, CASE WHEN k%2=0 THEN 0 ELSE price END price, shares, CASE WHEN k%7=0 THEN '' ELSE 'x'||k END note
    FROM disc WHERE kind='view' QUALIFY row_number() OVER (PARTITION BY issuer, series ORDER BY ord)=1)"""


def _base_extra(spark, sf):
    k = F.col("k")
    d = X.disc(spark, sf)

    def first(kind, cols):
        rows = d.where(F.col("kind") == kind).select("issuer", "series", "ord", *cols)
        return rows.groupBy("issuer", "series").agg(F.min_by(F.struct("price", "shares", "note"), "ord").alias("_r")).select("issuer", "series", "_r.*")

    text = lambda p, n: F.when(k % n == 0, F.lit("")).otherwise(F.concat(F.lit(p), k.cast("string"))).alias("note")
    base = first("signup", [F.when(k % 3 == 0, 0).otherwise(F.col("price")).cast("bigint").alias("price"), F.when(k % 4 != 0, F.col("shares")).alias("shares"), text("n", 5)])
    extra = first("view", [F.when(k % 2 == 0, 0).otherwise(F.col("price")).cast("bigint").alias("price"), "shares", text("x", 7)])
    return base, extra


@query("j1_enrich_missing", _q(_BASEX) + " SELECT b.issuer, b.series, coalesce(nullif(b.price,0),x.price,b.price) price, coalesce(nullif(b.shares,0),x.shares,b.shares) shares, coalesce(nullif(b.note,''),x.note,b.note) note FROM b LEFT JOIN x ON x.issuer=b.issuer AND x.series=b.series")
def j1(spark, sf):
    base, extra = _base_extra(spark, sf)
    return J.enrich_missing(base, extra, ["issuer", "series"], ["price", "shares", "note"])


@query("j2_overwrite_present", _q(_BASEX) + " SELECT b.issuer, b.series, coalesce(nullif(x.price,0),b.price) price, coalesce(nullif(x.shares,0),b.shares) shares, coalesce(nullif(x.note,''),b.note) note FROM b LEFT JOIN x ON x.issuer=b.issuer AND x.series=b.series")
def j2(spark, sf):
    base, extra = _base_extra(spark, sf)
    return J.overwrite_present(base, extra, ["issuer", "series"], ["price", "shares", "note"])


@query(
    "j7_match_by_value",
    DISC + """, i AS (SELECT issuer, price%50 p, arg_min('RIGHTS_'||ord, ord) key FROM disc WHERE kind='signup' GROUP BY ALL)
      SELECT d.issuer, d.ord, d.price%50 price, i.key matched_key FROM disc d LEFT JOIN i ON i.issuer=d.issuer AND i.p=d.price%50 WHERE kind='click'""",
)
def j7(spark, sf):
    d = X.disc(spark, sf).withColumn("price", F.col("price") % 50)
    probe = d.where("kind = 'click'").select("issuer", "ord", "price")
    inst = d.where("kind in ('signup', 'error')").select(
        "issuer", F.col("price").alias("p"), "ord",
        F.concat(F.when(F.col("kind") == "signup", "RIGHTS_").otherwise("PREF_"), F.col("ord").cast("string")).alias("instrument_key"),
    )
    return J.first_value_match(
        probe, inst, keys=["issuer"], probe_value="price", instrument_value="p", instrument_order="ord",
        instrument_key="instrument_key", prefix="RIGHTS_",
    )


# -- aggregates ----------------------------------------------------------------------------------


@query(
    "a10_total_dilution",
    _q(V4_SQL) + f""" SELECT issuer, CAST(sum(CASE WHEN {_LIVE} THEN convertible_shares ELSE 0 END) AS BIGINT) dilutive_shares, any_value(t) total_shares,
      CASE WHEN any_value(t)>0 THEN CAST(sum(CASE WHEN {_LIVE} THEN convertible_shares ELSE 0 END) AS DOUBLE)/any_value(t)*100 ELSE 0 END dilution_pct
      FROM (SELECT *, CASE WHEN issuer%10=0 THEN 0 ELSE 1000000+issuer END t FROM base) b GROUP BY issuer""",
)
def a10(spark, sf):
    s = ST.apply_notes(notes(spark, sf)).select(
        "issuer", "convertible_shares", D.parse_any_date("exercise_end", compact=False).alias("exercise_end"),
        F.when(F.col("issuer") % 10 == 0, 0).otherwise(F.col("issuer") + 1_000_000).cast("bigint").alias("t"),
    )
    return A.total_dilutive_shares(s, as_of=_as_of(), total_shares="t")


_FUND = """fund AS (SELECT ord, CASE WHEN k%2=0 THEN '-' ELSE format('{:,}',price) END fdpp_fclt, CASE WHEN k%3=0 THEN '' ELSE format('{:,}',shares) END fdpp_op, CASE WHEN k%5=0 THEN '0' ELSE CAST(face AS VARCHAR) END fdpp_dtrp, CASE WHEN k%7=0 THEN '77' ELSE '-' END fdpp_dae FROM disc)"""


def _fund(spark, sf):
    k = F.col("k")
    empty = ["fdpp_bsninh", "fdpp_etc", "fdpp_ocsa"]
    return X.disc(spark, sf).select(
        "ord",
        F.when(k % 2 == 0, "-").otherwise(F.format_number("price", 0)).alias("fdpp_fclt"),
        F.when(k % 3 == 0, "").otherwise(F.format_number("shares", 0)).alias("fdpp_op"),
        F.when(k % 5 == 0, "0").otherwise(F.col("face").cast("string")).alias("fdpp_dtrp"),
        F.when(k % 7 == 0, "77").otherwise("-").alias("fdpp_dae"),
        *(F.lit("-").alias(c) for c in empty),
    )


def _amt(c: str) -> str:
    return f"coalesce({Q.amount(c)},0)"


@query("a11_sum_funding", _q(_FUND) + f" SELECT ord, nullif({_amt('fdpp_fclt')}+{_amt('fdpp_op')}+{_amt('fdpp_dae')},0) by_event, nullif({_amt('fdpp_fclt')}+{_amt('fdpp_op')}+{_amt('fdpp_dtrp')},0) by_decision FROM fund")
def a11(spark, sf):
    return _fund(spark, sf).select(
        "ord", A.sum_funding(lx.FUNDING_EVENT).alias("by_event"), A.sum_funding(lx.FUNDING_DECISION).alias("by_decision")
    )


@query(
    "a12_outcome_counts",
    DISC + """ SELECT kind, count(*) FILTER (WHERE k%4<>0 AND k%3<>0) succeeded, count(*) FILTER (WHERE k%4=0) failed, count(*) FILTER (WHERE k%4<>0 AND k%3=0) no_output, count(*) total FROM disc GROUP BY ALL""",
)
def a12(spark, sf):
    k = F.col("k")
    runs = X.disc(spark, sf).select("kind", F.when(k % 4 == 0, "error").otherwise("ok").alias("status"), F.when(k % 3 != 0, k).alias("output"))
    return A.outcome_counts(runs, keys=["kind"])


@query("a12_empty_sections", DISC + " SELECT ord, concat_ws(',', CASE WHEN k%2=0 THEN 'business' END, CASE WHEN k%3=0 THEN 'risks' END, CASE WHEN k%5=0 THEN 'outlook' END) empty_sections FROM disc")
def a12b(spark, sf):
    k = F.col("k")
    col = lambda n, name: F.when(k % n == 0, F.lit(" ")).otherwise(F.lit("text")).alias(name)
    rows = X.disc(spark, sf).select("ord", col(2, "business"), col(3, "risks"), col(5, "outlook"))
    return A.empty_sections(rows, keys=["ord"], sections=["business", "risks", "outlook"])


_A14 = "CASE WHEN face<>0 AND e>0 AND ((r>900 AND r<1100) OR (r>900000 AND r<1100000)) THEN e ELSE face END"


@query(
    "a14_validate_face_value",
    DISC + f""" SELECT ord, {_A14} face_value FROM (SELECT *, CAST(face AS DOUBLE)/nullif(e,0) r FROM (
      SELECT ord, price*shares e, CASE WHEN k%3=0 THEN price*shares*1000 WHEN k%3=1 THEN price*shares*1000000+k ELSE face END face FROM disc) a) b""",
)
def a14(spark, sf):
    k, e = F.col("k"), F.col("price") * F.col("shares")
    face = F.when(k % 3 == 0, e * 1000).when(k % 3 == 1, e * 1_000_000 + k).otherwise(F.col("face"))
    return X.disc(spark, sf).select("ord", A.validate_face_value(face, F.col("price"), F.col("shares")).alias("face_value"))


# -- order, latest -------------------------------------------------------------------------------

_PH = "CASE WHEN kind='click' THEN 1 ELSE 2 END"


@query(
    "o3_event_apply_order",
    DISC + f" SELECT issuer, ord, row_number() OVER (PARTITION BY issuer ORDER BY {_PH}, entry_date, ord) pos FROM disc WHERE kind IN ('click','purchase')",
)
def o3(spark, sf):
    """Positions of the records of an issuer in the order they apply."""
    d = X.disc(spark, sf).where("kind in ('click', 'purchase')")
    phase = F.when(F.col("kind") == "click", 1).otherwise(2)
    key = O.event_order(phase, F.col("entry_date"), F.col("ord"))
    pos = F.row_number().over(Window.partitionBy("issuer").orderBy(key))
    return d.select("issuer", "ord", pos.cast("bigint").alias("pos"))


@query("w5_latest_per_issuer", DISC + " SELECT issuer, CAST(ord AS VARCHAR) rcept_no, strftime(entry_date,'%Y-%m-%d') rcept_dt, kind FROM disc QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY entry_date DESC, CAST(ord AS VARCHAR) DESC)=1")
def w5(spark, sf):
    f = X.disc(spark, sf).select(
        "issuer", F.col("ord").cast("string").alias("rcept_no"), F.date_format("entry_date", "yyyy-MM-dd").alias("rcept_dt"), "kind"
    )
    return W.latest_per_issuer(f)


@query("s5_scan_filing_index", DISC + " SELECT issuer, ord, kind FROM disc WHERE entry_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND (contains(lower(kind),'view') OR contains(lower(kind),'purch'))")
def s5(spark, sf):
    from ..sources import readers as R

    idx = X.disc(spark, sf)
    out = R.scan_filing_index(
        idx, start=F.lit("2024-01-05").cast("date"), end=F.lit("2024-01-20").cast("date"), keywords=["VIEW", "Purch"], day="entry_date", name="kind"
    )
    return out.select("issuer", "ord", "kind")


@query("dt8_format_period", DISC + " SELECT ord, CASE WHEN k%2=0 AND k%3=0 THEN '' ELSE CASE WHEN k%2=0 THEN '' ELSE 'a'||k END||'~'||CASE WHEN k%3=0 THEN '' ELSE 'b'||k END END period FROM disc")
def dt8(spark, sf):
    k = F.col("k")
    a = F.when(k % 2 != 0, F.concat(F.lit("a"), k.cast("string")))
    b = F.when(k % 3 != 0, F.concat(F.lit("b"), k.cast("string")))
    return X.disc(spark, sf).select("ord", D.format_period(a, b).alias("period"))


# -- decoding, contracts -------------------------------------------------------------------------

_H21 = """raw AS (SELECT ord, k, strftime(entry_date,'%Y%m%d')||lpad(CAST(ord AS VARCHAR),6,'0') rcept_no, ['CB','BW','PERPETUAL','STOCK_OPTION','RIGHTS_ISSUE'][k%5+1] category, series, price, shares, face FROM disc)"""


def _raw_api(spark, sf):
    k = F.col("k")
    cat = _pick(k % 5, ["CB", "BW", "PERPETUAL", "STOCK_OPTION", "RIGHTS_ISSUE"])
    n = lambda c: F.format_number(c, 0)
    return X.disc(spark, sf).select(
        "issuer", "ord", cat.alias("category"), _receipt().alias("rcept_no"), F.col("series").cast("string").alias("bd_tm"), F.lit("무기명식").alias("bd_knd"),
        n("face").alias("bd_fta"), n("price").alias("cv_prc"), n("shares").alias("cvisstk_cnt"), F.lit("s1").alias("cvrqpd_bgd"), F.lit("e1").alias("cvrqpd_edd"),
        n(F.col("price") + 1).alias("ex_prc"), n(F.col("shares") + 1).alias("nstk_isstk_cnt"), F.lit("s2").alias("expd_bgd"), F.lit("e2").alias("expd_edd"),
        F.when(k % 2 == 0, F.lit("-")).otherwise(n(F.col("shares") + 2)).alias("stk_ostk_cnt"), F.when(k % 3 == 0, F.lit("")).otherwise(n(F.col("shares") + 3)).alias("stk_isstk_ostk_cnt"),
        F.when(k % 4 == 0, F.lit("5")).otherwise("-").alias("nstk_ostk_cnt"), F.when(k % 7 == 0, F.lit("-")).otherwise(n(F.col("shares") + 4)).alias("nstk_estk_cnt"),
        n(F.col("price") + 5).alias("stk_estk_issu_prc"), F.lit("1,000").alias("fdpp_fclt"), F.lit("-").alias("fdpp_bsninh"), n("face").alias("fdpp_op"),
        F.lit("7").alias("fdpp_dtrp"), F.lit("-").alias("fdpp_ocsa"), F.lit("").alias("fdpp_etc"), F.lit("9").alias("fdpp_dae"),
    )


def _h21_sql(rights_keep: str, so: str, funding: str, cats: str) -> str:
    return f""" SELECT ord, category, CASE WHEN category IN ('CB','BW','PERPETUAL') THEN series END series,
      CASE WHEN category='RIGHTS_ISSUE' THEN nullif({funding},0) WHEN category IN ('CB','BW','PERPETUAL') THEN face END face_value,
      CASE category WHEN 'BW' THEN price+1 WHEN 'CB' THEN price WHEN 'PERPETUAL' THEN price END conversion_price,
      CASE category WHEN 'BW' THEN shares+1 WHEN 'CB' THEN shares WHEN 'PERPETUAL' THEN shares WHEN 'STOCK_OPTION' THEN {so} END convertible_shares,
      CASE category WHEN 'STOCK_OPTION' THEN {so} WHEN 'RIGHTS_ISSUE' THEN shares+4 END shares,
      CASE WHEN category='RIGHTS_ISSUE' THEN price+5 END issue_price, CASE WHEN category='STOCK_OPTION' THEN price+1 END exercise_price,
      CASE WHEN category IN ('BW','STOCK_OPTION') THEN 's2' WHEN category<>'RIGHTS_ISSUE' THEN 's1' END cv_start,
      CASE WHEN category IN ('BW','STOCK_OPTION') THEN 'e2' WHEN category<>'RIGHTS_ISSUE' THEN 'e1' END cv_end, rcept_no, rcept_no[1:8] disclosure_date
      FROM raw WHERE category IN ({cats}) AND (category<>'RIGHTS_ISSUE' OR ({rights_keep})) AND (category<>'STOCK_OPTION' OR {so} IS NOT NULL)"""


_H21_OUT = ["ord", "category", "series", "face_value", "conversion_price", "convertible_shares", "shares", "issue_price", "exercise_price", "cv_start", "cv_end", "rcept_no", "disclosure_date"]
_SO_EV = "CASE WHEN k%2<>0 THEN shares+2 WHEN k%3<>0 THEN shares+3 WHEN k%4=0 THEN 5 END"
_SO_DEC = "CASE WHEN k%2<>0 THEN shares+2 WHEN k%3<>0 THEN shares+3 END"


@query("h21_decode_events", _q(_H21) + _h21_sql("k%7<>0", _SO_EV, "1000+face+9", "'CB','BW','PERPETUAL','STOCK_OPTION','RIGHTS_ISSUE'"))
def h21a(spark, sf):
    return EV.decode_events(_raw_api(spark, sf)).select(*_H21_OUT)


@query("h21_decode_decisions", _q(_H21) + _h21_sql("k%7<>0 AND k%4<>0", _SO_DEC, "1000+face+7", "'CB','BW','STOCK_OPTION','RIGHTS_ISSUE'"))
def h21b(spark, sf):
    return EV.decode_decisions(_raw_api(spark, sf)).select(*_H21_OUT)


@query(
    "e8_contract_rows",
    DISC + f""", r AS (SELECT issuer, min(entry_date)+5 ref FROM disc WHERE issuer%2=0 GROUP BY ALL),
    c AS (SELECT d.*, k%4=0 cancel, CASE k%3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END m FROM disc d LEFT JOIN r ON r.issuer=d.issuer WHERE ref IS NULL OR entry_date>ref)
    SELECT issuer, ord, CASE WHEN cancel THEN '해지' ELSE '체결' END contract_type,
      CASE WHEN amt>0 THEN {Q.thousands(Q.eok('amt*m'))} ELSE '' END amount_eok, CASE WHEN k%5=0 THEN NULL ELSE CAST(CAST(k/4.0 AS DECIMAL(10,1)) AS VARCHAR)||'%' END revenue_ratio_pct,
      CASE WHEN k%6=0 THEN '' ELSE 's'||k END||CASE WHEN k%6=0 AND k%7=0 THEN '' ELSE '~' END||CASE WHEN k%7=0 THEN '' ELSE 'e'||k END contract_period
      FROM (SELECT *, CASE WHEN cancel THEN price*100000 ELSE face END amt FROM c) x""",
)
def e8(spark, sf):
    k = F.col("k")
    d = X.disc(spark, sf)
    refs = d.where("issuer % 2 = 0").groupBy("issuer").agg(F.date_add(F.min("entry_date"), 5).alias("reference_date"))
    contracts = d.select(
        "issuer", "ord", "entry_date", F.when(k % 4 == 0, "단일판매ㆍ공급계약해지").otherwise("단일판매ㆍ공급계약체결").alias("type"),
        F.col("face").alias("contract_amount"), (F.col("price") * 100_000).alias("cancel_amount"),
        _pick(k % 3, ["원", "천원", "백만원"]).alias("amount_unit"),
        # tenths that are exact in binary keep the rounding out of the comparison
        F.when(k % 5 != 0, F.round(k / 4, 1)).alias("revenue_ratio_pct"),
        F.when(k % 6 != 0, F.concat(F.lit("s"), k.cast("string"))).alias("period_start"),
        F.when(k % 7 != 0, F.concat(F.lit("e"), k.cast("string"))).alias("period_end"),
    )
    rows = V.contract_rows(contracts, refs)
    return rows.select("issuer", "ord", "contract_type", "amount_eok", "revenue_ratio_pct", "contract_period")


# -- model replies -------------------------------------------------------------------------------


@query(
    "k4_normalize_instrument",
    DISC + f""" SELECT ord, category, series, {_A14.replace('face', 'f')} face_value,
      CASE WHEN s=0 AND category<>'SO' AND price<>0 AND ff<>0 THEN ff//price ELSE s END convertible_shares, price conversion_price, '2024.01.0'||series exercise_start
      FROM (SELECT *, CAST(f AS DOUBLE)/nullif(e,0) r, {_A14.replace('face', 'f').replace('r>', 'CAST(f AS DOUBLE)/nullif(e,0)>').replace('r<', 'CAST(f AS DOUBLE)/nullif(e,0)<')} ff FROM (SELECT ord, series, price, CASE WHEN k%3=0 THEN 0 ELSE shares END s, price*CASE WHEN k%3=0 THEN 0 ELSE shares END e,
         CASE WHEN k%5=4 THEN 0 WHEN k%2=0 THEN price*shares*1000 ELSE face END f, ['CB','BW','전환우선주','SO',NULL][k%5+1] category FROM disc) a) b
      WHERE category IS NOT NULL AND CASE WHEN category='SO' THEN s<>0 ELSE ff<>0 OR s<>0 END""",
)
def k4(spark, sf):
    """Instruments as a model writes them, in JSON, read back and normalised."""
    k = F.col("k")
    name = _pick(k % 5, ["제1회 무기명식 전환사채", "BW", "상환전환우선주", "스톡옵션", "회사채"])
    face = F.when(k % 5 == 4, 0).when(k % 2 == 0, F.col("price") * F.col("shares") * 1000).otherwise(F.col("face"))
    body = F.to_json(F.struct(
        name.alias("category"), F.concat(F.col("series").cast("string"), F.lit("회")).alias("series"), face.cast("bigint").alias("face_value"),
        F.concat(F.format_number("price", 0), F.lit("원")).alias("conversion_price"),
        F.when(k % 3 == 0, 0).otherwise(F.col("shares")).cast("bigint").alias("convertible_shares"),
        F.concat(F.lit("2024년 1월 "), F.col("series").cast("string"), F.lit("일")).alias("exercise_start"),
    ))
    # series text such as "3회" is not a number and reads as zero; use the plain number
    body = F.regexp_replace(body, "회\"", "\"")
    reply = F.when(k % 2 == 0, F.concat(F.lit("```json\n["), body, F.lit("]\n```"))).otherwise(
        F.concat(F.lit('{"instruments": ['), body, F.lit("]}"))
    )
    items = EV.instrument_items(X.disc(spark, sf).select("ord", reply.alias("content")), keys=["ord"])
    return items.select("ord", "category", "series", "face_value", "convertible_shares", "conversion_price", "exercise_start")


@query(
    "k3_parse_json_lenient",
    DISC + """ SELECT ord, k%4 AS form, CASE WHEN k%4 IN (0,1) THEN price END price FROM disc""",
)
def k3(spark, sf):
    from ..functions import maps as K

    k = F.col("k")
    body = F.concat(F.lit('{"price": '), F.col("price").cast("string"), F.lit("}"))
    text = (
        F.when(k % 4 == 0, body).when(k % 4 == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```")))
        .when(k % 4 == 2, F.lit("null")).otherwise(F.concat(F.lit("["), body))
    )
    return X.disc(spark, sf).select("ord", (k % 4).alias("form"), K.parse_json_object(text, "price bigint")["price"].alias("price"))

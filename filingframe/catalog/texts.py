"""Round trips of scalar functions: text written from table rows, read back, compared with the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..documents import cells as C
from ..functions import dates as D
from ..functions import maps as K
from ..functions import numbers as N
from ..operators import predicates as P
from ..operators.barrier import pin
from . import proxies as X
from .registry import query

DISC = "WITH " + X.DISC_SQL


def pick(i: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (i + 1).cast("int"))


def comma(c) -> Column:
    return F.format_number(c, 0)


def cat(*parts) -> Column:
    """Concatenate columns and plain text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def table(*rows) -> Column:
    """HTML table from rows of columns and plain text."""
    out = ["<table>"]
    for r in rows:
        out.append("<tr>")
        for c in r:
            out += ["<td>", c, "</td>"]
        out.append("</tr>")
    out.append("</table>")
    return cat(*out)


def c(name: str) -> Column:
    return F.col(name)


K_ = lambda: F.col("k")


def _number_text():
    k = K_()
    return (
        F.when(k % 7 == 0, cat(comma("face"), "원")).when(k % 7 == 1, cat("-", comma("price"), " 주"))
        .when(k % 7 == 2, F.lit("-")).when(k % 7 == 3, cat(c("price"), ".7")).when(k % 7 == 4, cat(c("shares"), "%"))
        .when(k % 7 == 5, F.lit("해당없음")).otherwise(cat("-", c("price"), ".9"))
    )


@query("n1_parse_korean_int", DISC + " SELECT ord, CASE k%7 WHEN 0 THEN face WHEN 1 THEN -price WHEN 3 THEN price WHEN 4 THEN shares WHEN 6 THEN -price END n FROM disc")
def n1(spark, sf):
    return X.disc(spark, sf).select("ord", N.parse_korean_int(_number_text()).alias("n"))


@query("n2_parse_korean_float", DISC + " SELECT ord, CASE k%7 WHEN 0 THEN CAST(face AS DOUBLE) WHEN 1 THEN CAST(-price AS DOUBLE) WHEN 3 THEN CAST(price||'.7' AS DOUBLE) WHEN 4 THEN CAST(shares AS DOUBLE) WHEN 6 THEN CAST('-'||price||'.9' AS DOUBLE) END n FROM disc")
def n2(spark, sf):
    return X.disc(spark, sf).select("ord", N.parse_korean_float(_number_text()).alias("n"))


@query("n3_parse_amount", DISC + " SELECT ord, CASE k%5 WHEN 0 THEN face WHEN 1 THEN -price WHEN 4 THEN shares END n FROM disc")
def n3(spark, sf):
    k = K_()
    t = F.when(k % 5 == 0, comma("face")).when(k % 5 == 1, cat("-", c("price"), ".5")).when(k % 5 == 2, F.lit("N/A")).when(k % 5 == 3, F.lit(" - ")).otherwise(cat(" ", c("shares"), " "))
    return X.disc(spark, sf).select("ord", N.parse_amount(t).alias("n"))


_REPORT = "CASE k%5 WHEN 0 THEN '('||format('{:,}',face)||')' WHEN 1 THEN format('{:,}',price) WHEN 2 THEN '4,5,6,32' WHEN 3 THEN '-' ELSE '0' END"


def _report_text():
    k = K_()
    return F.when(k % 5 == 0, cat("(", comma("face"), ")")).when(k % 5 == 1, comma("price")).when(k % 5 == 2, F.lit("4,5,6,32")).when(k % 5 == 3, F.lit(" - ")).otherwise("0")


@query("n4_parse_report_amount", DISC + " SELECT ord, CASE k%5 WHEN 0 THEN -face WHEN 1 THEN price WHEN 2 THEN 45632 WHEN 4 THEN 0 END n FROM disc")
def n4(spark, sf):
    return X.disc(spark, sf).select("ord", N.parse_report_amount(_report_text()).alias("n"))


@query("n5_is_amount_cell", DISC + " SELECT ord, k%5<>2 AS amount, k%2=0 AND shares<10000 AS note FROM disc")
def n5(spark, sf):
    short = F.when(K_() % 2 == 0, c("shares").cast("string")).otherwise(cat(c("shares"), ","))
    return X.disc(spark, sf).select("ord", N.is_amount_cell(_report_text()).alias("amount"), N.is_note_reference(short).alias("note"))


@query("n6_extract_amount", DISC + " SELECT ord, price plain, CASE k%4 WHEN 0 THEN price*1000 WHEN 1 THEN price*1000000 WHEN 2 THEN price*100000000 ELSE price END with_unit FROM disc")
def n6(spark, sf):
    unit = pick(K_() % 4, ["천원", " 백만원", "억원", "원"])
    return X.disc(spark, sf).select(
        "ord", N.extract_amount(cat("1주당 ", comma("price"), "원 (*1)")).alias("plain"),
        N.extract_amount_with_unit(cat("(*2) ", comma("price"), unit)).alias("with_unit"),
    )


_DIGITS = ["일", "이", "삼", "사", "오", "육", "칠", "팔", "구"]


@query("n7_parse_korean_words", DISC + " SELECT ord, CASE k%3 WHEN 0 THEN (k%9+1)*10000000000+series*1000000000 WHEN 1 THEN series*1000*100000000+(k%9+1)*100*10000 ELSE NULL END n FROM disc")
def n7(spark, sf):
    k = K_()
    a, b = pick(k % 9, _DIGITS), pick(c("series") - 1, _DIGITS)
    t = F.when(k % 3 == 0, cat("금 ", a, "백", b, "십억원")).when(k % 3 == 1, cat(b, "천억", a, "백만원")).otherwise(cat(c("price"), "천원"))
    return X.disc(spark, sf).select("ord", N.parse_korean_words(t).alias("n"))


@query("n8_parse_jo_eok", DISC + " SELECT ord, CASE k%4 WHEN 0 THEN (series*10000+price)*100000000 WHEN 1 THEN series*1000000000000 WHEN 2 THEN price*100000000 END n FROM disc")
def n8(spark, sf):
    k = K_()
    t = F.when(k % 4 == 0, cat(c("series"), "조 ", comma("price"), "억")).when(k % 4 == 1, cat(c("series"), "조")).when(k % 4 == 2, cat(comma("price"), "억")).otherwise("N/A")
    return X.disc(spark, sf).select("ord", N.parse_jo_eok(t).alias("n"))


@query("n9_parse_eok_float", DISC + " SELECT ord, CASE WHEN k%5=0 THEN NULL ELSE CAST(round_even(price+0.5,0) AS BIGINT)*100000000 END n FROM disc")
def n9(spark, sf):
    t = F.when(K_() % 5 == 0, F.lit("-")).otherwise(cat(comma("price"), ".50"))
    return X.disc(spark, sf).select("ord", N.parse_eok_float(t).alias("n"))


@query("n10_detect_unit", DISC + " SELECT ord, ['백만원','천원','억원','원'][k%4+1] report, ['천원','백만원','백만CNY','백만원'][k%4+1] revenue, ['천원','억원','백만원','원'][k%4+1] performance FROM disc")
def n10(spark, sf):
    k = K_() % 4
    rep = pick(k, ["재무상태표 (단위 : 백 만원)", "(단위:천원)", "단위: 억원", "(단위: 원)"])
    rev = pick(k, ["매출 (단위: 천원)", "(단위 : 백만원)", "단위 : 백만CNY", "no unit"])
    perf = pick(k, ["단위:억원 3. 손익구조변동내용(단위:천원)", "(단위:억원)", "손익구조변동 단위: 백만원", "none"])
    return X.disc(spark, sf).select("ord", N.report_header_unit(rep).alias("report"), N.revenue_unit(rev).alias("revenue"), N.performance_unit(perf).alias("performance"))


@query("n13_normalize_label", DISC + " SELECT ord, ['자산총계','매출액','영업이익'][k%3+1]||k label, ['매출액','영업이익','지배주주당기순이익','법인세비용차감전계속사업이익','당기순이익'][k%5+1] item FROM disc")
def n13(spark, sf):
    k = K_()
    raw = pick(k % 3, ["Ⅰ. 자산 총계", "1. 매출액 ", " III. 영업 이익"])
    item = pick(k % 5, ["- 매출액", "영업이익(손실)", "지배기업 소유주지분 당기순이익", "법인세비용차감전 순이익(당기순이익)", " 당기순이익"])
    return X.disc(spark, sf).select("ord", N.normalize_label(cat(raw, k)).alias("label"), N.canonical_item(item).alias("item"))


@query("n14_conversion_ratio", DISC + " SELECT ord, CASE WHEN k%3=0 THEN 1.0 ELSE series/2.0 END ratio, CASE WHEN k%3=0 THEN shares ELSE CAST(trunc(shares*(series/2.0)) AS BIGINT) END shares, CASE WHEN k%3=0 THEN price ELSE CAST(trunc(price/(series/2.0)) AS BIGINT) END price FROM disc")
def n14(spark, sf):
    t = F.when(K_() % 3 == 0, F.lit("없음")).otherwise(cat("우선주 2주당 보통주 ", c("series"), "주"))
    r = N.conversion_ratio(t)
    return X.disc(spark, sf).select("ord", r.alias("ratio"), N.shares_after_ratio("shares", r).alias("shares"), N.price_after_ratio("price", r).alias("price"))


# -- dates ---------------------------------------------------------------------------------------

_ISO = lambda x: F.date_format(x, "yyyy-MM-dd")


@query("dt1_parse_any_date", DISC + " SELECT ord, CASE WHEN k%7=6 THEN NULL ELSE strftime(entry_date,'%Y-%m-%d') END AS day, CASE WHEN k%7=5 THEN strftime(entry_date,'%Y-%m-%d') END short_day FROM disc")
def dt1(spark, sf):
    d, k = c("entry_date"), K_()
    f = lambda p: F.date_format(d, p)
    t = (
        F.when(k % 7 == 0, f("yyyyMMdd")).when(k % 7 == 1, f("yyyy-MM-dd")).when(k % 7 == 2, f("yyyy.M.d")).when(k % 7 == 3, f("yyyy/MM/dd"))
        .when(k % 7 == 4, cat(F.year(d), "년 ", F.month(d), "월 ", F.dayofmonth(d), "일")).when(k % 7 == 5, cat("기준 ", f("yyyy-MM-dd"))).otherwise("2024-13-45")
    )
    return X.disc(spark, sf).select("ord", _ISO(D.parse_any_date(t)).alias("day"), _ISO(D.parse_short_date(F.when(k % 7 == 5, f("yy.MM.dd")).otherwise("x"))).alias("short_day"))


@query("dt2_date_from_receipt", DISC + " SELECT ord, CASE WHEN k%3=0 THEN strftime(entry_date,'%Y-%m-%d') END strict, strftime(entry_date,'%Y-%m-%d') loose, CASE WHEN k%2=0 THEN strftime(entry_date,'%Y-%m-%d') END url FROM disc")
def dt2(spark, sf):
    k = K_()
    day = F.date_format("entry_date", "yyyyMMdd")
    no = F.when(k % 3 == 0, cat(day, "000123")).otherwise(cat(day, "99"))
    url = F.when(k % 2 == 0, cat("https://x/main.do?rcpNo=", day, "900123")).otherwise("https://x/main.do?no=1")
    return X.disc(spark, sf).select("ord", _ISO(D.date_from_receipt(no)).alias("strict"), _ISO(D.date_from_receipt(no, strict=False)).alias("loose"), _ISO(D.date_from_url(url)).alias("url"))


@query("dt3_reference_date", DISC + " SELECT ord, CASE k%6 WHEN 0 THEN '2024-12-31' WHEN 1 THEN '2025-06-30' WHEN 2 THEN strftime(last_day(make_date(2025,CAST((k%4+1)*3 AS INTEGER),1)),'%Y-%m-%d') WHEN 3 THEN '2025-09-30' WHEN 4 THEN '2024-02-29' END AS day FROM disc")
def dt3(spark, sf):
    k = K_()
    t = (
        F.when(k % 6 == 0, F.lit("2024년 사업보고서")).when(k % 6 == 1, F.lit("[기재정정]2025년 반기보고서"))
        .when(k % 6 == 2, cat("2025년 ", k % 4 + 1, "분기 분기보고서")).when(k % 6 == 3, F.lit("분기보고서 (2025.09)")).when(k % 6 == 4, F.lit("[첨부]사업보고서 (2024/02)")).otherwise("주요사항보고서")
    )
    return X.disc(spark, sf).select("ord", _ISO(D.reference_date(t)).alias("day"))


@query("dt7_relative_period", DISC + """ SELECT ord, CASE WHEN k%4<>3 THEN strftime(entry_date + to_years(CAST(series AS INTEGER)),'%Y-%m-%d') END start_day,
  CASE k%4 WHEN 0 THEN strftime(m - to_months(CAST(series AS INTEGER)),'%Y-%m-%d') WHEN 3 THEN NULL ELSE strftime(m,'%Y-%m-%d') END end_day,
  strftime(entry_date + to_years(1),'%Y-%m-%d') opens, strftime(entry_date + to_years(CAST(series AS INTEGER)),'%Y-%m-%d') closes
  FROM (SELECT *, entry_date + to_years(5) m FROM disc) d""")
def dt7(spark, sf):
    k, s, d = K_(), c("series"), c("entry_date")
    tail = pick(k % 4, ["개월 전까지", "", "", ""])
    t = F.when(k % 4 == 0, cat("발행일로부터 ", s, "년이 경과하는 날부터 만기 ", s, tail)).when(k % 4 == 1, cat("발행일 후 ", s, "년 만기 직전일")).when(k % 4 == 2, cat("발행일 ", s, "년 만기일")).otherwise(F.lit("미정"))
    a, b = D.relative_period(t, d, F.add_months(d, 60))
    o, e = D.preferred_period(cat("발행일 후 1년이 경과한 날부터 ", s, "년이 되는 날"), d)
    return X.disc(spark, sf).select("ord", _ISO(a).alias("start_day"), _ISO(b).alias("end_day"), _ISO(o).alias("opens"), _ISO(e).alias("closes"))


# -- maps and labels -----------------------------------------------------------------------------


def _kv():
    k = K_()
    return table(
        ["매출액대비(%) 최근 매출액(원) 합계", "merged"], ["최근 매출액(원)", comma("face")], ["계약상대", F.when(k % 3 == 0, F.lit(" ")).otherwise(cat("회사", k))],
        ["조건", "주식수", comma("shares")], ["전환가액", F.when(k % 2 == 0, F.lit("")).otherwise(comma("price"))], ["행사가액", cat(c("price") + 1)],
    )


@query("k1_kv_get", DISC + " SELECT ord, format('{:,}',face) revenue, CASE WHEN k%3<>0 THEN '회사'||k END counterparty, format('{:,}',shares) shares FROM disc")
def k1(spark, sf):
    d = X.disc(spark, sf).select("ord", C.kv_pairs(C.html_tables(_kv())[0]).alias("p"))
    p = F.col("p")
    return d.select("ord", K.kv_get(p, "매출액(원)").alias("revenue"), K.kv_get(p, "계약상대").alias("counterparty"), K.kv_get(p, "주식수").alias("shares"))


@query("k2_kv_first", DISC + " SELECT ord, CASE WHEN k%2=0 THEN CAST(price+1 AS VARCHAR) ELSE format('{:,}',price) END price, NULL::VARCHAR missing FROM disc")
def k2(spark, sf):
    # a page is far heavier to parse than a record to move, and a file of records gives few tasks
    records = X.disc(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ord")
    d = pin(records.select("ord", C.kv_pairs(C.html_tables(_kv())[0]).alias("p")))
    return d.select("ord", K.kv_first(F.col("p"), "전환가액", "행사가액").alias("price"), K.kv_first(F.col("p"), "없음").alias("missing"))


_EX = ["주식매수선택권행사", "전환청구권ㆍ신주인수권ㆍ교환청구권행사", "신주인수권행사", "전환주식의전환청구권행사", "전환청구권행사", "행사"]
_PA = ["전환가액ㆍ신주인수권행사가액ㆍ교환가액의조정", "신주인수권행사가액의조정", "전환주식의전환가액조정", "전환가액의조정", "가액조정"]


def _sql_list(v: list[str]) -> str:
    return "[" + ",".join(f"'{x}'" for x in v) + "]"


@query("p3b_subtypes", DISC + f" SELECT ord, {_sql_list(_EX)}[k%6+1] exercise, {_sql_list(_PA)}[k%5+1] adjustment FROM disc")
def p3b(spark, sf):
    k = K_()
    ex = pick(k % 6, ["주식매수선택권 행사", "전환청구권ㆍ신주인수권ㆍ교환청구권 행사", "신주인수권 행사", "전환주식의 전환청구권 행사", "전환청구권 행사", "행사"])
    pa = pick(k % 5, ["전환가액ㆍ신주인수권ㆍ교환가액 조정", "신주인수권 가액 조정", "전환주식의 전환가액 조정", "전환가액의 조정", "조정"])
    return X.disc(spark, sf).select("ord", P.exercise_subtype(ex).alias("exercise"), P.price_adj_subtype(pa).alias("adjustment"))


_FOOT = ["전기 중 모두 보통주로 전환", "당기에 전액 상환", "전액 전환됨", "전부 전환", "전환이 모두 완료", "상환 완료", "일부 전환", "잔액 있음"]


@query("p13_text_says_inactive", DISC + " SELECT ord, k%8<6 AS inactive FROM disc")
def p13(spark, sf):
    return X.disc(spark, sf).select("ord", P.text_says_inactive(pick(K_() % 8, _FOOT)).alias("inactive"))

"""Round trips of document jobs: pages written from table rows, parsed, compared with the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..documents import cells as C
from ..documents import consensus as CO
from ..documents import exchange as E
from ..documents import filings as FI
from ..documents import notes as NO
from ..documents import statements as ST
from ..functions import text as TX
from ..operators import aggregates as A
from ..operators import windows as W
from ..operators.barrier import pin
from .. import lexicon as lx
from . import proxies as X
from .registry import query
from .texts import DISC, cat, comma, table

KEY = ["ord"]


def th(c: str) -> str:
    return f"format('{{:,}}',{c})"


def docs(spark, sf, html, *extra):
    """One page per record; records are dealt by their number, as a page is far heavier to parse than a record to move."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return X.disc(spark, sf).repartition(partitions, "ord").select("ord", *extra, html.alias("html"))


def head(text):
    return cat('<span style="font-weight:bold">', text, "</span>")


def k():
    return F.col("k")


# -- cells ---------------------------------------------------------------------------------------


def _cells_html():
    return cat(
        '<div><table class="t"><tr><th colspan="2">k &amp; v</th></tr><tr><td rowspan="2"><b>price</b></td><td>&nbsp;', comma("price"), " </td></tr><tr><td>",
        F.col("shares"), "</td></tr></table><p>x</p><table><tr><td>", F.col("kind"), "<td>", F.col("series"), "</tr></table></div>",
    )


@query(
    "h4_table_cells",
    DISC + f""" SELECT ord, 0 table_no, 0 row_no, 0 col_no, 'k & v' "text", true is_header, 1 rowspan, 2 colspan FROM disc UNION ALL
    SELECT ord,0,1,0,'price',false,2,1 FROM disc UNION ALL SELECT ord,0,1,1,{th('price')},false,1,1 FROM disc UNION ALL SELECT ord,0,2,0,CAST(shares AS VARCHAR),false,1,1 FROM disc
    UNION ALL SELECT ord,1,0,0,kind,false,1,1 FROM disc UNION ALL SELECT ord,1,0,1,CAST(series AS VARCHAR),false,1,1 FROM disc""",
)
def h4(spark, sf):
    return C.table_cells(docs(spark, sf, _cells_html()))


@query(
    "h4_table_cells_nested",
    DISC + f""" SELECT ord, 0 table_no, 0 row_no, 0 col_no, 'a' "text" FROM disc UNION ALL SELECT ord,1,0,0,{th('price')} FROM disc UNION ALL SELECT ord,0,0,1,kind FROM disc""",
)
def h4n(spark, sf):
    html = cat("<table><tr><td>a<table><tr><td>", comma("price"), "</td></tr></table></td><td>", F.col("kind"), "</td></tr></table>")
    return C.table_cells(docs(spark, sf, html), nested=True).select("ord", "table_no", "row_no", "col_no", "text")


def _kv_html():
    return table(["구분", "a"], ["전환가액", comma("price")], ["전환가액", comma(F.col("price") + 1)], ["주식", "주식수", comma("shares")], ["", "주식수", "0"], ["header only"])


@query("h5_kv_pairs", DISC + f" SELECT ord, u.k1 AS \"key\", u.v AS \"value\" FROM (SELECT ord, unnest([{{'k1':'구분','v':'a'}},{{'k1':'전환가액','v':{th('price+1')}}},{{'k1':'주식','v':'주식수'}},{{'k1':'주식수','v':{th('shares')}}}]) u FROM disc) x")
def h5(spark, sf):
    d = docs(spark, sf, _kv_html())
    return d.select("ord", F.explode(C.kv_pairs(C.html_tables("html")[0])).alias("p")).select("ord", "p.key", "p.value")


@query("h6_header_rows", DISC + f" SELECT ord, 0 row_no, '회차' \"key\", CAST(series AS VARCHAR) \"value\" FROM disc UNION ALL SELECT ord,0,'가액',{th('price')} FROM disc UNION ALL SELECT ord,0,'col_2','x' FROM disc UNION ALL SELECT ord,1,'회차',kind FROM disc")
def h6(spark, sf):
    html = cat("<table><tr><td>title</td></tr><tr><th>회차</th><th>가액</th></tr><tr><td>", F.col("series"), "</td><td>", comma("price"), "</td><td>x</td></tr><tr><td>", F.col("kind"), "</td></tr></table>")
    d = pin(docs(spark, sf, html).select("ord", C.headed_rows(C.html_tables("html")[0]).alias("rows")))
    d = d.select("ord", F.posexplode("rows").alias("row_no", "r"))
    return d.select("ord", "row_no", F.explode("r").alias("p")).select("ord", "row_no", "p.key", "p.value")


def _statement_html():
    return cat(
        table(["재무상태표 (단위: USD)"]), table(["과목", "당기"], ["자산총계", "9"]), table(["연결 재무상태표 (단위 : 천원)"]),
        table(["과목", "주석", "당기"], ["I. 자산 총계", "15", comma("face")], ["단기차입금", "", cat("(", comma("price"), ")")], ["사채", "4", "-"]),
        table([F.when(k() % 2 == 0, F.lit("포괄손익계산서 (단위: 원)")).otherwise("(단위: 원)")]),
        table(["과목", "3개월", "3개월", "누적", "누적"], ["매출액", comma("shares"), comma(F.col("price") + 1000), comma(F.col("shares") * 3), "1,000"], ["영업이익(손실)", "12", "", "", "7,000", "8,000"]),
    )


@query("h7_statement_tables", DISC + " SELECT ord, unnest(['BS','IS']) sj_div, unnest(['천원','원']) unit, unnest([4,3]) n_rows FROM disc")
def h7(spark, sf):
    return ST.statement_tables(docs(spark, sf, _statement_html()), keys=KEY).select("ord", "sj_div", "unit", F.size("rows").alias("n_rows"))


@query(
    "h8_nth_amount",
    DISC + """ SELECT ord,'BS' sj_div,0 line,'자산총계' account_nm, face*1000 amount FROM disc UNION ALL SELECT ord,'BS',1,'단기차입금',NULL FROM disc UNION ALL SELECT ord,'BS',2,'사채',NULL FROM disc
    UNION ALL SELECT ord,'IS',0,'매출액',shares*3 FROM disc UNION ALL SELECT ord,'IS',1,'영업이익(손실)',7000 FROM disc""",
)
def h8(spark, sf):
    t = ST.statement_tables(docs(spark, sf, _statement_html()), keys=KEY)
    docs_key = t.withColumnRenamed("ord", "doc")
    out = ST.statement_page_lines(docs_key, keys=["doc"], column=2)
    return out.select(F.col("doc").alias("ord"), "sj_div", F.col("ord").alias("line"), "account_nm", "amount")


@query("h8_page_balance_sheet", DISC + " SELECT ord, face*1000 total_assets, NULL::BIGINT short_term_borrowings FROM disc")
def h8b(spark, sf):
    t = ST.statement_tables(docs(spark, sf, _statement_html()), keys=KEY).withColumnRenamed("ord", "doc")
    lines = ST.statement_page_lines(t, keys=["doc"])
    wide = A.pivot_accounts(lines, keys=["doc"], rules=lx.PAGE_BALANCE_LABELS, exclusions=lx.PAGE_LABEL_EXCLUSIONS, statements=["BS"], rule="last")
    return wide.select(F.col("doc").alias("ord"), "total_assets", "short_term_borrowings")


@query("w11_rowspan_carry", DISC + f" SELECT ord, 'price' label, {th('price')}||chr(10)||CAST(shares AS VARCHAR) AS \"value\" FROM disc UNION ALL SELECT ord, 'kind', kind FROM disc")
def w11(spark, sf):
    html = cat('<table><tr><td rowspan="2">price</td><td>', comma("price"), "</td></tr><tr><td>", F.col("shares"), "</td></tr><tr><td>kind</td><td>", F.col("kind"), "</td></tr></table>")
    rows = C.table_rows(docs(spark, sf, html))
    two = F.size("cells") >= 2
    pairs = rows.select(
        "ord", "table_no", "row_no", F.when(two, F.col("cells")[0]["text"]).alias("label"), F.when(two, F.get("cells", F.lit(1))["text"]).otherwise(F.col("cells")[0]["text"]).alias("value")
    )
    return W.rowspan_carry(pairs, table=["ord", "table_no"], row="row_no", label="label", value="value").select("ord", "label", "value")


# -- exchange disclosures ------------------------------------------------------------------------


def _exercise_html():
    s = F.col("series")
    day = F.date_format("entry_date", "yyyy-MM-dd")
    return cat(
        head("전환청구권행사"),
        table(["1. 전환청구권 행사주식수 누계(주)", comma("shares")], ["-발행주식총수(주)", comma("face")], ["-발행주식총수 대비(%)", cat(s, ".25")]),
        table(["청구일자", "회차", "종류", "금액", "가액", "주식수", "상장일"], [day, s, "전환사채", comma("face"), comma("price"), comma("shares"), day], ["합계", "", "", "", "", "", ""]),
        table(
            ["회차", "권면총액", "통화", "미잔액", "통화", "가액", "주식수"], [s, comma("face"), "KRW : 원", F.when(k() % 3 == 0, F.lit("-")).otherwise(comma("price")), "KRW", comma(F.col("price") + 1), comma("shares")],
            [day, "전환주식", comma("face"), "10", comma("price"), comma("shares")],
        ),
    )


def _parsed(spark, sf, html):
    return E.parsed_documents(docs(spark, sf, html), keys=KEY)


@query("h9_exercise_totals", DISC + " SELECT ord, '전환청구권행사' AS type, shares cumulative_shares, face total_shares, series+0.25 ratio_pct FROM disc")
def h9(spark, sf):
    r = E.exercise_records(_parsed(spark, sf, _exercise_html()), keys=KEY)
    return r.select("ord", "type", "cumulative_shares", "total_shares", "ratio_pct")


@query("h9_exercise_claims", DISC + " SELECT ord, 0 pos, strftime(entry_date,'%Y-%m-%d') AS \"date\", series, '전환사채' bond_type, face amount, price conversion_price, shares FROM disc")
def h9c(spark, sf):
    r = E.exercise_records(_parsed(spark, sf, _exercise_html()), keys=KEY)
    return E.child_rows(r, keys=KEY, column="claims").select("ord", "pos", "date", "series", "bond_type", "amount", "conversion_price", "shares")


@query(
    "h9_exercise_balances",
    DISC + """ SELECT ord, 0 pos, NULL::VARCHAR issue_date, series, face face_value, CASE WHEN k%3=0 THEN 0 ELSE price END remaining, price+1 conversion_price, shares convertible_shares, NULL::BIGINT remaining_shares FROM disc
    UNION ALL SELECT ord, 1, strftime(entry_date,'%Y-%m-%d'), NULL, NULL, NULL, price, NULL, shares FROM disc""",
)
def h9b(spark, sf):
    r = E.exercise_records(_parsed(spark, sf, _exercise_html()), keys=KEY)
    return E.child_rows(r, keys=KEY, column="balances").select("ord", "pos", "issue_date", "series", "face_value", "remaining", "conversion_price", "convertible_shares", "remaining_shares")


def _adjust_html():
    s = F.col("series")
    return cat(
        head("전환가액의조정"),
        table(
            ["1. 조정에 관한 사항 (가액)", "회차", "상장여부", "조정전가액(원)", "조정후가액(원)"], [s, "비상장", comma("price"), comma(F.col("price") - 5)],
            ["2. 전환가능주식수 변동 주식수", "회차", "권면총액", "통화단위", "조정전주식수", "조정후주식수"], [s, comma("face"), "KRW : 원", comma("shares"), comma(F.col("shares") + 7)],
            ["3. 조정사유", cat("사유", k())], ["4. 조정가액 적용일", F.date_format("entry_date", "yyyy-MM-dd")],
        ),
    )


@query("h10_price_adjustments", DISC + """ SELECT ord, 0 part, 0 pos, series, price price_before, price-5 price_after, NULL::BIGINT shares_before, NULL::BIGINT shares_after, NULL::BIGINT unconverted FROM disc
  UNION ALL SELECT ord, 1, 0, series, NULL, NULL, shares, shares+7, face FROM disc""")
def h10(spark, sf):
    r = E.price_adjustment_records(_parsed(spark, sf, _adjust_html()), keys=KEY)
    out = E.state_adjustments(r, keys=KEY)
    return out.select("ord", "part", F.col("pos").cast("int").alias("pos"), "series", "price_before", "price_after", "shares_before", "shares_after", "unconverted")


@query("h10_price_adjustment_heads", DISC + " SELECT ord, '전환가액의조정' AS type, '사유'||k reason, strftime(entry_date,'%Y-%m-%d') effective_date FROM disc")
def h10h(spark, sf):
    return E.price_adjustment_records(_parsed(spark, sf, _adjust_html()), keys=KEY).select("ord", "type", "reason", "effective_date")


def _contract_html():
    cancel = k() % 4 == 0
    return table(
        [F.when(cancel, F.lit("1. 해지 구분")).otherwise("1. 판매ㆍ공급계약 구분"), cat("공사", k())],
        [F.when(cancel, F.lit("2. 해지금액(원)")).otherwise("2. 계약금액(원)"), comma("face")],
        ["최근매출액(원)", comma("shares")], ["매출액대비(%)", cat(F.col("series"), ".5")], ["대규모법인여부", F.when(k() % 3 == 0, F.lit("해당")).otherwise("비해당")],
        ["3. 계약상대", cat("회사", k())], ["시작일", "2024-01-01"], ["종료일", F.when(k() % 5 == 0, F.lit("-")).otherwise("2024-12-31")],
        [F.when(cancel, F.lit("8. 해지일자")).otherwise("8. 계약(수주)일자"), F.date_format("entry_date", "yyyy-MM-dd")],
    )


@query(
    "h11_contract_records",
    DISC + """ SELECT ord, CASE WHEN k%4=0 THEN '단일판매ㆍ공급계약해지' ELSE '단일판매ㆍ공급계약체결' END AS type, CASE WHEN k%4<>0 THEN face END contract_amount, CASE WHEN k%4=0 THEN face END cancel_amount,
    shares recent_revenue, series+0.5 revenue_ratio_pct, k%3=0 is_large_corp, '회사'||k counterparty, CASE WHEN k%5=0 THEN '-' ELSE '2024-12-31' END period_end, strftime(entry_date,'%Y-%m-%d') event_date FROM disc""",
)
def h11(spark, sf):
    r = E.contract_records(_parsed(spark, sf, _contract_html()), keys=KEY)
    return r.select("ord", "type", "contract_amount", "cancel_amount", "recent_revenue", "revenue_ratio_pct", "is_large_corp", "counterparty", "period_end", "event_date")


def _performance_html():
    rows = [
        ["1. 재무제표의 종류", "연결"], ["- 시작일", "2024-01-01"], ["- 종료일", "2024-12-31"],
        ["3. 매출액 또는 손익구조변동내용(단위:천원)", "당해사업연도", "직전사업연도", "증감금액", "증감비율(%)", "흑자적자전환여부"],
        ["- 매출액", comma("face"), comma("price"), "1", "2", "-"], ["- 당기순이익", comma("shares"), cat("-", comma("price")), "1", "-", "흑자전환"],
        ["4. 재무현황(자산)", "당해사업연도", "직전사업연도"], ["- 자산총계", comma("face"), "1"], ["5. 매출액 또는 손익구조 변동 주요원인", cat("원인", k())],
    ]
    return table(*rows)


@query("h13_performance_records", DISC + f""" SELECT ord, '천원' unit, 'income' part, '- 매출액' label, {th('face')} "current", {th('price')} previous, '-' turnaround, '원인'||k reason FROM disc
  UNION ALL SELECT ord,'천원','income','- 당기순이익',{th('shares')},'-'||{th('price')},'흑자전환','원인'||k FROM disc UNION ALL SELECT ord,'천원','status','- 자산총계',{th('face')},'1',NULL,'원인'||k FROM disc""")
def h13(spark, sf):
    r = FI.performance_records(FI.parsed_filings(docs(spark, sf, _performance_html()), keys=KEY), keys=KEY)
    keys = ["ord", "unit", "reason"]
    # both lists of a page in one pass: a union would parse the page for each
    part = lambda c: F.coalesce(F.transform(c, lambda x: F.struct(F.lit(c).alias("part"), x.alias("x"))), F.array())
    r = pin(r).select(*keys, F.concat(part("income"), part("status")).alias("lines"))
    lines = E.child_rows(r, keys=keys, column="lines").select(*keys, "part", "x.*")
    return lines.select("ord", "unit", "part", "label", "current", "previous", "turnaround", "reason")


def _issue_html():
    return cat(
        "<title>신주인수권부사채권 발행결정</title>",
        table(["1. 사채의 종류", "회차", F.col("series")], ["", "종류", "무기명식"], ["2. 사채의 권면(전자등록)총액 (원)", comma("face")], ["행사가액 (원/주)", comma("price")], ["발행할 주식", "주식수", comma("shares")], ["전환청구기간", "시작일", "2024년 1월 5일"]),
    )


@query("h14_bond_issuances", DISC + " SELECT ord, '신주인수권부사채권 발행결정' AS type, series, '무기명식' kind, face face_value, price conversion_price, shares convertible_shares, '2024년 1월 5일' exercise_start FROM disc")
def h14(spark, sf):
    r = FI.bond_issuances(FI.parsed_filings(docs(spark, sf, _issue_html()), keys=KEY), keys=KEY)
    return r.select("ord", "type", "series", "kind", "face_value", "conversion_price", "convertible_shares", "exercise_start")


@query("h14_rights_issues", DISC + " SELECT ord, CASE WHEN k%2=0 THEN price END common_shares, shares other_shares, price issue_price, nullif(price+face,0) funding, '2024-01-05' exercise_start FROM disc")
def h14r(spark, sf):
    html = table(
        ["1. 신주의 종류와 수", "보통주식 (주)", F.when(k() % 2 == 0, comma("price")).otherwise("-")], ["", "기타주식 (주)", comma("shares")], ["6. 신주 발행가액", "기타주식 (원)", comma("price")],
        ["시설자금 (원)", comma("price")], ["운영자금 (원)", comma("face")], ["전환청구기간", "시작일", "2024년 1월 5일"],
    )
    r = FI.rights_issues(FI.parsed_filings(docs(spark, sf, html), keys=KEY), keys=KEY)
    return r.select("ord", "common_shares", "other_shares", "issue_price", "funding", "exercise_start")


@query("h14_rights_text", DISC + " SELECT ord, shares other_shares, nullif(face,0) fund_operation, price conversion_price, CASE WHEN k%3=0 THEN NULL ELSE '2024-01-05' END payment_date, series+0.5 discount_rate_pct FROM disc")
def h14t(spark, sf):
    text = cat(
        "1. 신주의 종류와 수\n보통주식 (주) -\n기타주식 (주) ", comma("shares"), "\n운영자금 (원) ", comma("face"), "\n전환가액 (원/주) ", comma("price"), "\n할인율 또는 할증률 (%) ", F.col("series"), ".5\n",
        F.when(k() % 3 == 0, F.lit("")).otherwise("9. 납입일 2024년 1월 5일"),
    )
    d = X.disc(spark, sf).select("ord", text.alias("text"))
    return FI.rights_issues_from_text(d, keys=KEY).select("ord", "other_shares", "fund_operation", "conversion_price", "payment_date", "discount_rate_pct")


def _prelim_html():
    return cat(
        head("연결재무제표기준영업(잠정)실적"), table(["당기실적", "2024-10-01", "~", "2024-12-31"], ["당기누계실적", "2024-01-01", "~", "2024-12-31"]),
        "<table><tr><td>구분(단위:억원, %)</td><td>당기</td></tr><tr><td rowspan=\"2\">매출액</td><td>당해실적</td><td>", comma("face"), "</td><td>", comma("price"), "</td><td>4.5</td><td>-</td><td>", comma("shares"),
        "</td><td>-8.5</td><td>", F.when(k() % 4 == 0, F.lit("적자전환")).otherwise("-"), "</td></tr><tr><td>누계실적</td><td>", comma("shares"), "</td><td>-</td><td>-</td><td>-</td><td>", comma("price"), "</td><td>3.5</td><td>-</td></tr></table>",
    )


@query(
    "h15_preliminary_records",
    DISC + """, v AS (SELECT ord, k, 'quarter' basis, unnest(['당해실적','전분기실적','전분기대비증감율','전년동기실적','전년동기대비증감율']) measure, unnest([CAST(face AS DOUBLE),price,4.5,shares,-8.5]) "value", NULL::VARCHAR note FROM disc
    UNION ALL SELECT ord, k, 'cumulative', unnest(['당해실적','전년동기실적','전년동기대비증감율']), unnest([CAST(shares AS DOUBLE),price,3.5]), NULL FROM disc
    UNION ALL SELECT ord, k, 'quarter', '흑자적자전환', NULL, '적자전환' FROM disc WHERE k%4=0)
    SELECT ord, '매출액' item, basis, measure, "value", note, '억원' unit FROM v""",
)
def h15(spark, sf):
    return E.preliminary_records(_parsed(spark, sf, _prelim_html()), keys=KEY).select("ord", "item", "basis", "measure", "value", "note", "unit")


@query("h15_preliminary_periods", DISC + " SELECT ord, '당해실적' period, '2024-10-01' AS start, '2024-12-31' AS \"end\", '2024.4Q' label FROM disc UNION ALL SELECT ord, '누적당해실적', '2024-01-01', '2024-12-31', NULL FROM disc")
def h15p(spark, sf):
    return E.preliminary_periods(_parsed(spark, sf, _prelim_html()), keys=KEY)


def _forecast_html():
    return cat(
        head("영업실적등에대한전망(공정공시)"),
        table(["전망(단위:백만원)", "2025", "2026"], ["시작일", "2025-01-01", "2026-01-01"], ["종료일", "2025-12-31", "2026-12-31"], ["매출액", comma("face"), comma("shares")], ["영업이익", comma("price"), "-"]),
        table(["대상기간", "2024-01-01", "2024-12-31"], ["구분", "전망", "실적", "괴리율"], ["매출액", comma("price"), comma("shares"), cat("-", F.col("series"), ".5")]),
    )


@query(
    "h16_forecast_records",
    DISC + """ SELECT ord, 2025 AS year, '매출액' item, face AS "value", '2025-12-31' period_end FROM disc UNION ALL SELECT ord,2026,'매출액',shares,'2026-12-31' FROM disc
    UNION ALL SELECT ord,2025,'영업이익',price,'2025-12-31' FROM disc UNION ALL SELECT ord,2026,'영업이익',NULL,'2026-12-31' FROM disc""",
)
def h16(spark, sf):
    return E.forecast_records(_parsed(spark, sf, _forecast_html()), keys=KEY).select("ord", "year", "item", "value", "period_end")


@query("h16_forecast_deviation", DISC + " SELECT ord, '매출액' item, price forecast, shares actual, -(series+0.5) deviation_pct, '2024-12-31' period_end FROM disc")
def h16d(spark, sf):
    return E.forecast_deviation(_parsed(spark, sf, _forecast_html()), keys=KEY).select("ord", "item", "forecast", "actual", "deviation_pct", "period_end")


# -- notes ---------------------------------------------------------------------------------------


def _notes_html():
    s = F.col("series")
    return cat(
        "<p>13. 전환사채</p><p>① 제", s, "회 무기명식 전환사채</p>",
        table(["발행총액", cat(comma("face"), "원")], ["전환시 전환 주식수", cat(comma("shares"), "주")], ["전환에 관한 사항", cat("전환가격: ", comma("price"), "원 / 주 전환청구가능기간: 2023년 09월 28일 부터 2027년 08월 28일 까지")]),
        F.when(k() % 3 == 0, F.lit("<p>(*1) 당기 중 전액 상환되었습니다.</p>")).otherwise(""),
        "<p>14. 주식기준보상</p>", table(["구분", "행사가격", "잔여수량", "행사기간"], [cat(s, "차"), cat(comma("price"), "원"), comma("shares"), "2024.01.01~2028.12.31"], ["합계", "", comma("shares"), ""]), "<p>15. 기타</p>",
    )


@query(
    "h17_notes_instruments",
    DISC + """ SELECT ord, 'CB' category, series, face face_value, shares convertible_shares, price conversion_price, '2023.09.28' exercise_start, '2027.08.28' exercise_end, k%3<>0 active FROM disc
    UNION ALL SELECT ord, 'SO', series, 0, shares, price, '2024.01.01', '2028.12.31', true FROM disc""",
)
def h17(spark, sf):
    r = NO.notes_instruments(docs(spark, sf, _notes_html()), keys=KEY)
    return r.select("ord", "category", "series", "face_value", "convertible_shares", "conversion_price", "exercise_start", "exercise_end", "active")


@query("h18_keyword_context", DISC + " SELECT ord, 2 n_passages, k%3=0 redeemed FROM disc")
def h18(spark, sf):
    r = NO.keyword_context(docs(spark, sf, _notes_html()), keys=KEY)
    return r.select("ord", "n_passages", F.contains("context", F.lit("전액 상환")).alias("redeemed"))


@query("h20_consensus_rows", DISC + " SELECT ord, 2025 fy, CAST(round_even(price+0.5,0) AS BIGINT)*100000000 revenue, shares*100000000 operating_income, CASE WHEN k%2=0 THEN series*100000000 END net_income FROM disc")
def h20(spark, sf):
    def row(label, *v):
        out = [f'<tr><th class="title">{label}</th>']
        for x in v:
            out += ['<td title="', x, '">x</td>']
        return [*out, "</tr>"]

    html = cat(
        "<table>2020/12(E)</table><table><tr><th>2024/12</th><th>2025/12(E)</th></tr>", *row("매출액", "1", cat(comma("price"), ".50")), *row("영업이익", "1", "2"), *row("영업이익(발표기준)", "1", comma("shares")),
        *row("당기순이익", "1", F.when(k() % 2 == 0, F.col("series").cast("string")).otherwise("")), "</table>",
    )
    return CO.consensus_rows(docs(spark, sf, html), keys=KEY)


# -- pages and documents -------------------------------------------------------------------------

STRIP = r"<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
ENT = "replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({x},'&nbsp;|&#160;|&#xa0;',' ','g'),'&lt;','<','g'),'&gt;','>'),'&quot;','\"'),'&#39;',''''),'&apos;',''''),'&middot;','·'),'&amp;','&')"
CLEAN = "trim(regexp_replace(regexp_replace({x},'[\\x{{A0}}\\x{{3000}}\\t\\r\\n]+',' ','g'),' {{2,}}',' ','g'))"


def strip_sql(x: str, gap: str) -> str:
    return ENT.format(x=f"regexp_replace(regexp_replace({x},'{STRIP}','{gap}','gis'),'<[^>]+>','{gap}','gs')")


def clean_sql(x: str) -> str:
    return CLEAN.format(x=x)


@query("h1_clean_text", f"SELECT doc_id, {clean_sql('text')} t FROM documents")
def h1(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", TX.clean_text("text").alias("t"))


_TITLE = "regexp_extract(html,'(?is)<title[^>]*>(.*?)</title',1)"


@query("h2_html_to_text", f"SELECT page_id, {clean_sql(strip_sql('html', ' '))} body, {clean_sql(strip_sql(_TITLE, ''))} title FROM pages")
def h2(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", TX.html_to_text("html").alias("body"), TX.page_title("html").alias("title"))


_NOISE = "html"
for _tag in ("script", "style", "nav", "header", "footer", "aside", "iframe", "figure", "figcaption"):
    _NOISE = f"regexp_replace({_NOISE},'<{_tag}\\b.*?</{_tag}\\s*>','','gis')"
_ART = f"regexp_extract(regexp_replace({_NOISE},'<!--.*?-->','','gs'),'(?is)<article[^>]*>(.*?)</article\\s*>',1)"


_PIECE = "split_part(p, '</p', 1)"
_PIECES = f"list_filter(list_transform(regexp_split_to_array(regexp_replace({_NOISE},'<!--.*?-->','','gs'),'<p\\b[^>]*>')[2:], lambda p: trim({strip_sql(_PIECE, '')})), lambda p: length(p)>30)"


@query(
    "h3_article_body",
    f"WITH a AS (SELECT page_id, trim(regexp_replace({strip_sql(_ART, chr(10))},'[\\s\\x{{A0}}\\x{{3000}}]*\\n[\\s\\x{{A0}}\\x{{3000}}]*',chr(10),'g'), chr(10)||' ') t, array_to_string({_PIECES}, chr(10)) p FROM pages) SELECT page_id, CASE WHEN length(t)>80 THEN t ELSE p END body FROM a",
)
def h3(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", TX.article_body("html").alias("body"))


"""Document jobs on small pages with known figures."""

import datetime
import random
import re

import pytest

from filingframe import lexicon as lx
from filingframe.documents import cells as C
from filingframe.documents import consensus, exchange, filings, news, notes, sections, statements
from filingframe.sources import readers


def page(*tables, heading="", body=""):
    span = f'<span style="font-weight:bold">{heading}</span>' if heading else ""
    return f"<html><head><title>t</title></head><body>{span}{body}{''.join(tables)}</body></html>"


def table(*rows, tag="td"):
    return "<table>" + "".join("<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in r) + "</tr>" for r in rows) + "</table>"


def docs(spark, *pages):
    return spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "doc_id bigint, html string")


def parsed(spark, *pages):
    return exchange.parsed_documents(docs(spark, *pages), keys=["doc_id"])


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict(recursive=True)


def test_nested_and_plain_cells_agree(spark):
    html = '<table><tr><th rowspan="2">k</th><td>v&nbsp;1</td></tr><tr><td>a</td><td> 87 </td></tr></table>'
    d = docs(spark, html)
    order = ["row_no", "col_no"]
    a = C.table_cells(d).orderBy(*order).collect()
    b = C.table_cells(d, nested=True).orderBy(*order).collect()
    assert a == b and len(a) == 4
    inner = "<table><tr><td>x<table><tr><td>y</td></tr></table></td><td>z</td></tr></table>"
    got = {(r.table_no, r.text) for r in C.table_cells(docs(spark, inner), nested=True).collect()}
    assert got == {(0, "x"), (0, "z"), (1, "y")}


def test_kv_pairs_keep_the_last_value_and_never_override_with_side_cells(spark):
    t = table(["전환가액", "1"], ["전환가액", "2"], ["섹션", "주식수", "877,346"], ["", "주식수", "9"], ["only"])
    pairs = one(docs(spark, t).select(C.kv_pairs(C.html_tables("html")[0]).alias("p")))["p"]
    assert {p["key"]: p["value"] for p in pairs} == {"전환가액": "2", "섹션": "주식수", "주식수": "877,346"}


def test_exercise_notice(spark):
    summary = table(["1. 행사주식수 누계(주)", "359,766"], ["-발행주식총수(주)", "7,000,000"], ["-발행주식총수 대비(%)", "5.13"])
    claims = table(["청구일자", "회차", "종류", "청구금액", "전환가액", "발행주식수", "상장일"], ["2025-01-02", "2", "전환사채", "1,000,000", "13,844", "72", "2025-01-20"])
    balance = table(
        ["회차", "권면총액", "통화", "미잔액", "통화", "전환가액", "전환가능주식수"],
        ["2", "10,000,000,000", "KRW : 원", "8,500,000,000", "KRW : 원", "13,844", "613,984"],
        ["3", "5,000,000,000", "KRW", "-", "KRW", "9,691", "0"],
    )
    r = one(exchange.exercise_records(parsed(spark, page(summary, claims, balance, heading="전환청구권행사")), keys=["doc_id"]))
    assert r["type"] == "전환청구권행사"
    assert (r["cumulative_shares"], r["total_shares"], r["ratio_pct"]) == (359766, 7000000, 5.13)
    assert r["claims"][0]["series"] == 2 and r["claims"][0]["conversion_price"] == 13844
    a, b = r["balances"]
    assert (a["remaining"], a["conversion_price"], a["convertible_shares"]) == (8_500_000_000, 13844, 613984)
    assert b["has_remaining"] and b["remaining"] == 0 and b["currency"] == "KRW"


def test_option_notice(spark):
    kv = table(["총발행주식수", "행사주식수", "비율"], ["10,000,000", "5,000", "0.05"])
    days = table(["행사일"] + ["x"] * 8, ["2025-02-03", "임직원", "홍", "1,000", "500", "5,000", "0", "0", "5,000"])
    left = table(["잔여", "신주", "자기", "차액", "기타"], ["120,000", "100,000", "20,000", "0", "0"])
    r = one(exchange.exercise_records(parsed(spark, page(kv, days, left, heading="주식매수선택권행사")), keys=["doc_id"]))
    assert r["option_remaining"]["new_shares"] == 100_000 and r["total_shares"] == 10_000_000
    assert r["option_exercises"][0]["shares_new"] == 5000 and r["claims"] is None
    bal = one(exchange.state_balances(exchange.exercise_records(parsed(spark, page(kv, days, left, heading="주식매수선택권행사")), keys=["doc_id"]), keys=["doc_id"]))
    assert bal["new_shares"] == 100_000 and bal["series"] is None


def test_price_adjustment_sections(spark):
    t = table(
        ["1. 조정에 관한 사항(가액)", "회차", "상장여부", "조정전가액(원)", "조정후가액(원)"],
        ["2", "비상장", "13,844", "9,691"],
        ["2. 주식수 변동", "회차", "권면총액", "통화단위", "조정전주식수", "조정후주식수"],
        ["2", "8,500,000,000", "KRW : 원", "613,984", "877,102"],
        ["3. 조정사유", "시가하락"],
        ["4. 조정가액 적용일", "2025-03-04"],
    )
    r = one(exchange.price_adjustment_records(parsed(spark, page(t, heading="전환가액의조정")), keys=["doc_id"]))
    assert r["adjustments"] == [{"series": 2, "listed": "비상장", "price_before": 13844, "price_after": 9691}]
    assert r["share_changes"][0]["shares_after"] == 877102 and r["share_changes"][0]["unconverted"] == 8_500_000_000
    assert r["reason"] == "시가하락" and r["effective_date"] == "2025-03-04"


def test_price_adjustment_without_series(spark):
    t = table(["가액", "상장여부", "조정전", "조정후"], ["비상장", "10,000", "9,000"], ["주식수 현재", "조정전", "조정후"], ["500", "400", "450"])
    r = one(exchange.price_adjustment_records(parsed(spark, page(t, heading="전환주식의 전환가액 조정")), keys=["doc_id"]))
    assert r["type"] == "전환주식의전환가액조정"
    assert r["adjustments"][0] == {"series": None, "listed": "비상장", "price_before": 10000, "price_after": 9000}
    assert r["share_changes"][0]["current_shares"] == 500 and r["share_changes"][0]["shares_after"] == 450


def test_contract_notice(spark):
    t = table(["1. 판매ㆍ공급계약 구분", "공사수주"], ["- 체결계약명", "장비"], ["계약금액(원)", "20,319,210,726"], ["최근매출액(원)", "1,000"], ["매출액대비(%)", "12.5"], ["대규모법인여부", "미해당"], ["계약상대", "A사"], ["시작일", "2025-01-01"], ["종료일", "2025-12-31"], ["계약(수주)일자", "2025-01-02"])
    cancel = table(["해지금액(원)", "300"], ["해지일자", "2025-05-05"], ["주요사유", "철회"])
    rows = {r.doc_id: r for r in exchange.contract_records(parsed(spark, page(t), page(cancel)), keys=["doc_id"]).collect()}
    assert rows[0].contract_amount == 20_319_210_726 and rows[0].revenue_ratio_pct == 12.5 and rows[0].event_date == "2025-01-02"
    assert rows[1].type == "단일판매ㆍ공급계약해지" and rows[1].cancel_amount == 300 and rows[1].event_date == "2025-05-05"


PRELIM = (
    "<table><tr><td>당기실적</td><td>2025-10-01</td><td>~</td><td>2025-12-31</td></tr>"
    "<tr><td>당기누계실적</td><td>2025-01-01</td><td>~</td><td>2025-12-31</td></tr></table>"
    "<table><tr><td>구분(단위:백만원, %)</td><td>당기</td></tr>"
    '<tr><td rowspan="2">매출액</td><td>당해실적</td><td>86,643</td><td>82,833</td><td>4.60</td><td>-</td><td>79,596</td><td>8.85</td><td>-</td></tr>'
    "<tr><td>누계실적</td><td>322,467</td><td>-</td><td>-</td><td>-</td><td>310,715</td><td>3.78</td><td>-</td></tr>"
    '<tr><td rowspan="2">당기순이익</td><td>당해실적</td><td>14,084</td><td>5,000</td><td>1</td><td>-</td><td>-439</td><td>-</td><td>흑자전환</td></tr>'
    "<tr><td>누계실적</td><td>20,000</td><td>-</td><td>-</td><td>-</td><td>1</td><td>-</td><td>-</td></tr></table>"
)


def test_preliminary_result(spark):
    p = parsed(spark, page(heading="연결재무제표기준영업(잠정)실적", body=PRELIM))
    assert one(exchange.route(p).select("category"))["category"] == "preliminary"
    rows = {(r["item"], r.basis, r.measure): r for r in exchange.preliminary_records(p, keys=["doc_id"]).collect()}
    assert rows["매출액", "quarter", "당해실적"]["value"] == 86643 and rows["매출액", "quarter", "전년동기대비증감율"]["value"] == 8.85
    assert rows["매출액", "cumulative", "전년동기실적"]["value"] == 310715
    assert rows["당기순이익", "quarter", "흑자적자전환"].note == "흑자전환" and rows["매출액", "quarter", "당해실적"].unit == "백만원"
    periods = {r.period: r for r in exchange.preliminary_periods(p, keys=["doc_id"]).collect()}
    assert periods["당해실적"].label == "2025.4Q" and periods["누적당해실적"].end == "2025-12-31"


def test_forecast(spark):
    t = table(["전망(단위:억원)", "2026", "2027", "2028"], ["시작일", "2026-01-01", "2027-01-01", "2028-01-01"], ["종료일", "2026-12-31", "2027-12-31", "2028-12-31"], ["매출액", "6,122", "7,000", "8,000"], ["2. 전망 근거", "수주잔고"])
    dev = table(["대상기간", "2025-01-01", "2025-12-31"], ["구분", "전망", "실적", "괴리율"], ["매출액", "5,329", "4,912", "-7.8"])
    p = parsed(spark, page(t, dev, heading="영업실적등에대한전망"))
    rows = {(r.year, r["item"]): r for r in exchange.forecast_records(p, keys=["doc_id"]).collect()}
    assert rows[2026, "매출액"]["value"] == 6122 and rows[2028, "매출액"].period_end == "2028-12-31" and rows[2027, "매출액"].unit == "억원"
    d = one(exchange.forecast_deviation(p, keys=["doc_id"]))
    assert (d["forecast"], d["actual"], d["deviation_pct"], d["period_start"]) == (5329, 4912, -7.8, "2025-01-01")
    assert one(exchange.forecast_assumptions(p, keys=["doc_id"]))["assumptions"] == "수주잔고"


def filing(spark, *pages):
    return filings.parsed_filings(docs(spark, *pages), keys=["doc_id"])


@pytest.mark.parametrize("merged", [False, True])
def test_performance_notice(spark, merged):
    kv = [["1. 재무제표의 종류", "연결"], ["- 시작일", "2025-01-01"], ["- 종료일", "2025-12-31"]]
    income = [["3. 매출액 또는 손익구조변동내용(단위:천원)", "당해사업연도", "직전사업연도", "증감금액", "증감비율(%)", "흑자적자전환여부"], ["- 매출액", "95,639,307", "80,000,000", "15,639,307", "19.5", "-"], ["- 당기순이익", "5", "-3", "8", "-", "흑자전환"]]
    status = [["4. 재무현황(자산)", "당해사업연도", "직전사업연도"], ["- 자산총계", "100", "90"]]
    tail = [["5. 매출액 또는 손익구조 변동 주요원인", "수출 증가"]]
    body = page(table(*kv, *income, *status, *tail)) if merged else page(table(*kv, *tail), table(*income), table(*status), body="손익구조변동내용(단위:천원)")
    r = filings.performance_records(filing(spark, body), keys=["doc_id"])
    got = one(r)
    assert got["unit"] == "천원" and got["period_end"] == "2025-12-31" and got["reason"] == "수출 증가"
    assert {x["label"]: x["current"] for x in got["income"]} == {"- 매출액": "95,639,307", "- 당기순이익": "5"}
    assert got["status"][0]["previous"] == "90"
    m = one(filings.performance_measures(r, keys=["doc_id"]))
    assert (m["revenue"], m["net_income"], m["operating_income"]) == (95639307, 5, None)


def test_filing_forms(spark):
    claims = table(["청구일자", "회차", "종류", "청구금액", "전환가액", "발행한 주식수"], ["2025-01-02", "2", "전환사채", "1,000", "10", "100"])
    f = filing(spark, page(claims))
    assert one(filings.filing_claims(f, keys=["doc_id"]))["shares"] == 100
    bal = table(["회차", "권면총액", "미전환사채 잔액", "전환가액(원)", "전환가능 주식수"], ["2", "10,000", "7,000", "13,844", "5"])
    assert one(filings.filing_balances(filing(spark, page(bal)), keys=["doc_id"]))["remaining"] == 7000
    adj = table(["회차", "상장여부", "조정전 전환가액 (원)", "조정후 전환가액 (원)"], ["2", "비상장", "13,844", "9,691"])
    r = one(filings.filing_price_changes(filing(spark, page(table(["회사명", "가나"], ["공시일", "2025-01-01"]), adj)), keys=["doc_id"]))
    assert (r["series"], r["price_before"], r["price_after"], r["company"]) == (2, 13844, 9691, "가나")
    con = table(["1. 판매ㆍ공급계약 내용", "장비"], ["계약금액 합계(원)", "20,319,210,726"], ["4. 판매ㆍ공급지역국가", "해외"], ["10. 기타 투자판단에 참고할 사항", "a • b ※ c"])
    r = one(filings.filing_contracts(filing(spark, page(con)), keys=["doc_id"]))
    assert r["total_amount"] == 20_319_210_726 and r["region"] == "해외" and r["notes"] == ["a", "b", "c"]
    bond = table(["1. 사채의 종류", "회차", "2"], ["", "종류", "무기명식"], ["2. 사채의 권면(전자등록)총액 (원)", "10,000,000,000"], ["전환가액 (원/주)", "13,956"], ["전환에 따라 발행할 주식", "주식수", "716,537"])
    r = one(filings.bond_issuances(filing(spark, page(bond)), keys=["doc_id"]))
    assert (r["series"], r["face_value"], r["conversion_price"], r["convertible_shares"]) == (2, 10_000_000_000, 13956, 716537)
    rights = table(["1. 신주의 종류와 수", "보통주식 (주)", "-"], ["", "기타주식 (주)", "592,655"], ["시설자금 (원)", "1,000"], ["운영자금 (원)", "500"], ["전환가액 (원/주)", "18,233"], ["시작일", "2023년 9월 28일"])
    r = one(filings.rights_issues(filing(spark, page(rights)), keys=["doc_id"]))
    assert (r["other_shares"], r["common_shares"], r["funding"], r["exercise_start"]) == (592655, None, 1500, "2023-09-28")


def test_rights_text(spark):
    text = "1. 신주의 종류와 수\n보통주식 (주) -\n기타주식 (주) 246,361\n운영자금 (원) 5,000,000\n전환가액 (원/주) 20,295\n9. 납입일 2023년 12월 13일\n이사회결의일(결정일) 2023년 12월 5일\n1개월간의 가중산술평균주가(A) 1 2 3,456.5"
    r = one(filings.rights_issues_from_text(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), keys=["doc_id"]))
    assert (r["other_shares"], r["common_shares"], r["fund_operation"], r["conversion_price"]) == (246361, None, 5_000_000, 20295)
    assert r["payment_date"] == "2023-12-13" and r["board_decision_date"] == "2023-12-05" and r["vwap_month"] == 3456.5


def test_statement_tables(spark):
    html = (
        table(["재무상태표 (단위: USD)"]) + table(["과목", "당기"], ["자산총계", "9"])
        + table(["연결 재무상태표 (단위 : 천원)"]) + table(["과목", "주석", "당기", "전기"], ["Ⅰ. 자산총계", "15", "1,234,567", "1"], ["단기차입금", "", "(5,000)", "2"])
        + table(["(단위 : 원)"]) + table(["과목", "3개월", "누적", "a", "b"], ["매출액", "100,000", "90,000", "250,000", "200,000"], ["영업이익", "4,5,6", "1,000", "2,000", "3,000"])
    )
    t = statements.statement_tables(docs(spark, page(html)), keys=["doc_id"])
    assert {(r.sj_div, r.unit) for r in t.collect()} == {("BS", "천원"), ("IS", "원")}
    rows = {(r.sj_div, r.account_nm): r.amount for r in statements.statement_page_lines(t, keys=["doc_id"]).collect()}
    assert rows["BS", "자산총계"] == 1_234_567_000 and rows["IS", "매출액"] == 100_000
    ytd = {(r.sj_div, r.account_nm): r.amount for r in statements.statement_page_lines(t, keys=["doc_id"], column=2).collect()}
    assert ytd["IS", "매출액"] == 250_000 and ytd["BS", "자산총계"] == 1_234_567_000 and ytd["IS", "영업이익"] == 3_000


def test_consensus(spark):
    row = lambda label, *v: f'<tr><th class="title">{label}</th>' + "".join(f'<td title="{x}">x</td>' for x in v) + "</tr>"
    html = "<table>decoy 2020/12(E)</table><table><tr><th>2024/12</th><th>2025/12(E)</th><th>2026/12(E)</th></tr>" + row("매출액", "1", "1,877.50", "") + row("영업이익", "1", "2", "") + row("영업이익(발표기준)", "1", "", "") + row("당기순이익", "1", "10.4", "") + "</table>"
    r = one(consensus.consensus_rows(docs(spark, html), keys=["doc_id"]))
    assert (r["fy"], r["revenue"], r["operating_income"], r["net_income"]) == (2025, 187_800_000_000, None, 1_000_000_000)
    body = '{"financeInfo":{"trTitleList":[{"key":"202412","title":"2024.12.","isConsensus":"N"},{"key":"202512","title":"2025.12.","isConsensus":"Y"}],"rowList":[{"title":"매출액","columns":{"202512":{"value":"1,234"}}}]}}'
    j = one(consensus.consensus_json(spark.createDataFrame([(1, body)], "doc_id bigint, body string"), keys=["doc_id"]))
    assert (j["fy"], j["revenue"], j["net_income"]) == (2025, 123_400_000_000, None)


def test_news_listings(spark):
    html = '<ul><li><h4><a href="/n/1">제목 <b>하나</b></a></h4><em>2025.01.02 10:00</em></li><li><a href="https://x/2">둘</a><span>2025-02-03</span></li><li><a href="/3">no date</a></li></ul>'
    rows = news.listing_rows(docs(spark, html), keys=["doc_id"], base="https://n.example", source="feed").orderBy("pos").collect()
    assert [(str(r.date), r.title, r.url) for r in rows] == [("2025-01-02", "제목 하나", "https://n.example/n/1"), ("2025-02-03", "둘", "https://x/2")]
    payload = '{"REPORT_TITLE":"a","OFFICE_NAME":"b증권","REPORT_DATE":"2025-03-04"}{"REPORT_TITLE":"c","OFFICE_NAME":"d","REPORT_DATE":"2025-03-05"}'
    d = spark.createDataFrame([(1, payload, "u"), (2, payload + '{"REPORT_TITLE":"x"}', "u")], "doc_id bigint, html string, url string")
    got = news.payload_rows(d, keys=["doc_id"]).collect()
    assert [(r.doc_id, r.title) for r in got] == [(1, "[b증권] a"), (1, "[d] c")]
    xml = "<rss><item><title><![CDATA[T &amp; U]]></title><link>http://a/b</link><pubDate>Thu, 02 Jan 2025 00:00:00 GMT</pubDate></item></rss>"
    f = one(news.feed_rows(spark.createDataFrame([(1, xml)], "doc_id bigint, xml string"), keys=["doc_id"]))
    assert (str(f["date"]), f["title"], f["url"]) == ("2025-01-02", "T & U", "http://a/b")
    t = "<table><tr><th>번호</th><th>제목</th><th>제공사</th><th>작성일</th></tr><tr><td>1</td><td>리포트</td><td>가나증권</td><td>25.01.02</td></tr></table>"
    r = one(news.research_rows(docs(spark, t), keys=["doc_id"]))
    assert (r["title"], r["broker"], r["date"]) == ("리포트", "가나증권", datetime.date(2025, 1, 2))


def test_sections(spark):
    md = "---\ncreated: 2024-01-01\n---\nintro\n## 1. 기본사항\nbody\n## 5. 투자 아이디어\nideas\n"
    d = spark.createDataFrame([(1, md)], "doc_id bigint, text string")
    rows = sections.split_sections(d, keys=["doc_id"]).orderBy("ord").collect()
    assert [(r.header, r.body) for r in rows][1:] == [("__preamble__", "intro"), ("## 1. 기본사항", "body"), ("## 5. 투자 아이디어", "ideas\n")]
    b = spark.createDataFrame([(1, "[요약]\nx\n[other]\ny\n[전망]\nz")], "doc_id bigint, text string")
    got = {r.header: r.body for r in sections.bracket_sections(b, keys=["doc_id"], known=["요약", "전망"]).collect()}
    assert got == {"요약": "x\n[other]\ny", "전망": "z"}
    a = "## 5. 투자 아이디어\n좋다\n## 6. 리스크 (Bear Case)\n- **구조적 위험**: 경기\n- **반론**: 반박\n- **Tail Risk**: 전쟁\n## 7. 결론\n매수\n---"
    r = one(sections.analysis_sections(spark.createDataFrame([(1, a)], "doc_id bigint, text string"), keys=["doc_id"]))
    assert (r["investment_ideas"], r["risk_structural"], r["risk_counter"], r["risk_tail"], r["conclusion"]) == ("좋다", "경기", "반박", "전쟁", "매수")
    t = spark.createDataFrame([("x\n소계\n1\n합계\n2\n나. 다음\n3",), ("가\n다. 수주상황 본문",)], "t string")
    got = [tuple(r) for r in t.select(sections.strip_summary("t"), sections.backlog_subsection("t")).collect()]
    assert got[0][0] == "x\n소계\n1\n나. 다음\n3" and got[1][1] == "다. 수주상황 본문"


CB = """
<p>13. 전환사채</p><p>① 제1회 무기명식 사모 전환사채</p>
<table><tr><td>발행총액</td><td>10,000,000,000원</td></tr><tr><td>전환시 전환 주식수</td><td>877,346주</td></tr>
<tr><td rowspan="3">전환에 관한 사항</td><td>전환가격: 11,398원 / 주</td></tr><tr><td>전환비율: 100%</td></tr>
<tr><td>전환청구가능기간: 2023년 09월 28일 부터 2027년 08월 28일 까지</td></tr></table>
<p>② 제2회 전환사채</p>
<table><tr><td>발행총액</td><td>금 삼백억원</td></tr><tr><td>전환시 전환 주식수</td><td>50,000주</td></tr></table>
<p>(*1) 당분기 중 전액 상환되었습니다.</p><p>14. 기타</p>
"""


def test_notes_bonds(spark):
    rows = {r.series: r for r in notes.notes_instruments(docs(spark, CB), keys=["doc_id"]).collect()}
    a, b = rows[1], rows[2]
    assert (a.category, a.face_value, a.convertible_shares, a.conversion_price) == ("CB", 10_000_000_000, 877_346, 11_398)
    assert (a.exercise_start, a.exercise_end, a.active) == ("2023.09.28", "2027.08.28", True)
    assert b.face_value == 30_000_000_000 and b.active is False


def test_notes_columns_and_relative_period(spark):
    html = """<p>13. 전환사채</p><p>내역</p><table>
    <tr><td>구분</td><td>제1회 전환사채</td><td>제2회 전환사채</td></tr>
    <tr><td>발행일</td><td>2022-03-01</td><td>2023-03-01</td></tr><tr><td>만기일</td><td>2027-03-01</td><td>2028-03-01</td></tr>
    <tr><td>권면총액</td><td>25,000,000천원</td><td>5,000,000천원</td></tr><tr><td>전환가액</td><td>10,000원</td><td>5,000원</td></tr>
    <tr><td>전환청구기간</td><td>발행일로부터 1년이 경과하는 날부터 만기 1개월 전까지</td><td>2024.03.01 ~ 2028.02.01</td></tr></table><p>14. 기타</p>"""
    rows = {r.series: r for r in notes.notes_instruments(docs(spark, html), keys=["doc_id"]).collect()}
    assert (rows[1].face_value, rows[1].convertible_shares) == (25_000_000_000, 2_500_000)
    assert (rows[1].exercise_start, rows[1].exercise_end) == ("2023.03.01", "2027.02.01")
    assert (rows[2].convertible_shares, rows[2].exercise_start) == (1_000_000, "2024.03.01")


def test_notes_preferred_options_embedded(spark):
    html = """<p>20. 자본</p><p>(2) 전환우선주</p><p>① 2024년 12월 14일 발행 전환우선주</p>
    <table><tr><td>발행주식수</td><td>592,655주</td></tr><tr><td>1주당 발행금액</td><td>16,672원</td></tr><tr><td>총발행가액</td><td>9,880,744,160원</td></tr>
    <tr><td>발행일</td><td>2024년 12월 14일</td></tr><tr><td>전환기간</td><td>최초발행일 후 1년이 경과한 날부터 5년이 되는 날</td></tr><tr><td>전환조건</td><td>전환우선주 1주당 보통주 1주</td></tr></table>
    <p>21. 주식기준보상</p><table><tr><td>구분</td><td>행사가격</td><td>잔여수량</td><td>행사기간</td></tr>
    <tr><td>1차</td><td>5,000원</td><td>30,000</td><td>2024.01.01~2028.12.31</td></tr><tr><td>합계</td><td>-</td><td>30,000</td><td>-</td></tr></table>
    <p>22. 차입금</p><p>(3) 전환사채 발행내역</p><table><tr><td>구분</td><td>9회차 전환사채</td></tr><tr><td>권면총액</td><td>1,000,000,000</td></tr><tr><td>전환가액</td><td>2,000</td></tr></table>"""
    rows = {r.category: r for r in notes.notes_instruments(docs(spark, html), keys=["doc_id"]).collect()}
    p, so, cb = rows["전환우선주"], rows["SO"], rows["CB"]
    assert (p.convertible_shares, p.conversion_price, p.face_value) == (592_655, 16_672, 9_880_744_160)
    assert (p.exercise_start, p.exercise_end) == ("2025.12.14", "2029.12.14")
    assert (so.series, so.convertible_shares, so.conversion_price, so.exercise_end, so.kind) == (1, 30_000, 5_000, "2028.12.31", "주식매수선택권 1차")
    assert (cb.series, cb.convertible_shares) == (9, 500_000)


def test_keyword_context(spark):
    html = CB + "<p>15. 기타</p><p>무관</p><table><tr><td style=\"a\">주식매수선택권 현황</td></tr></table>"
    r = one(notes.keyword_context(docs(spark, html), keys=["doc_id"]))
    assert r["n_passages"] == 2 and "<p>무관</p>" in r["context"] and "style=" not in r["context"] and "14. 기타" not in r["context"]


def plain_context(blocks, reach):
    """Passages of a page, read block by block from each mention to its end."""
    words = lx.OVERHANG_KEYWORDS
    bare = lambda b: re.sub(r"\s+", "", b["text"])
    top = lambda b: not b["is_table"] and re.match(r"\d+\.\s+\S", b["text"])
    sub = lambda b: not b["is_table"] and re.match(r"\(\d+\)", b["text"])
    covered, parts, n = set(), [], len(blocks)
    for i, b in enumerate(blocks):
        if i in covered or b["is_table"] or not any(w in bare(b) for w in words):
            continue
        if re.match(r"\d+\.", bare(b)):
            end = next((j for j in range(i + 1, n) if top(blocks[j])), n)
        elif sub(b) or reach is None:
            end = next((j for j in range(i + 1, n) if top(blocks[j]) or sub(blocks[j])), n)
        else:
            paragraphs = [j for j in range(i, n) if not blocks[j]["is_table"]]
            end = paragraphs[reach] if reach < len(paragraphs) else n
        covered |= set(range(i, end))
        parts.append("\n".join(x["html"] for x in blocks[i:end]))
    for i, b in enumerate(blocks):
        if b["is_table"] and i not in covered and any(w in bare(b) for w in words):
            before = [x for x in blocks[:i] if not x["is_table"]]
            parts.append((f"<p>{before[-1]['text']}</p>\n" if before else "") + b["html"])
    return len(parts), f"\n\n{notes.BREAK}\n\n".join(parts)


@pytest.mark.parametrize("reach", [None, 1, 3, 15])
def test_keyword_context_of_any_page(spark, reach):
    rng = random.Random(reach or 0)
    lines = ["1. 일반사항", "2. 전환사채", "(1) 사채 내역", "(2) 전환사채의 내역", "본문 글", "전환사채를 발행", "신주인수권부사채 관련 본문", "12. 주식매수선택권 부여", "3.제목"]
    block = lambda t: f"<p>{t}</p>" if rng.random() < 0.75 else f"<table><tr><td>{t}</td><td>1</td></tr></table>"
    pages = docs(spark, "", *("".join(block(rng.choice(lines)) for _ in range(rng.randint(0, 40))) for _ in range(60)))
    want = {r["doc_id"]: plain_context([b.asDict() for b in r["blocks"] or []], reach) for r in notes.note_blocks(pages, keys=["doc_id"]).collect()}
    got = {r["doc_id"]: (r["n_passages"], r["context"]) for r in notes.keyword_context(pages, keys=["doc_id"], reach=reach).collect()}
    assert got == want


def test_newer_page_of_prices_wins(spark):
    """Whatever the figures; a day on one page only is kept, a close that is no number is not."""
    bars = [("a", 1, "9,000", 1, 2), ("a", 1, "100", 5, 1), ("a", 2, "7", 1, 2), ("a", 3, "x", 1, 1), ("b", 1, "1", 1, 1), ("b", 1, "2", 9, 3), ("b", 1, "2", 9, 3)]
    df = spark.createDataFrame(bars, "issuer string, trade_date int, close string, volume int, page int")
    assert sorted(tuple(r) for r in readers.scan_daily_prices(df, page="page").collect()) == [("a", 1, 100, 5), ("a", 2, 7, 1), ("b", 1, 1, 1)]
    assert sorted(tuple(r) for r in readers.scan_daily_prices(df.drop("page")).collect()) == [("a", 1, 9000, 1), ("a", 2, 7, 1), ("b", 1, 2, 9)]

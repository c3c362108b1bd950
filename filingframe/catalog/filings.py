"""Filing forms, mixed notices and further feeds: pages in two layouts each, parsed and compared with the rows they were written from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..documents import consensus as CO
from ..documents import exchange as E
from ..documents import filings as FI
from ..documents import news as NW
from ..functions import text as TX
from ..operators.barrier import pin
from . import proxies as X
from .pages import KEY, _adjust_html, _contract_html, _exercise_html, docs, head, k
from .registry import query
from .texts import DISC, cat, comma, table

DAY = "strftime(entry_date,'%Y-%m-%d')"


def _day():
    return F.date_format("entry_date", "yyyy-MM-dd")


def _either(one, other):
    """The first layout for even records, the second for odd ones."""
    return F.when(k() % 2 == 0, one).otherwise(other)


def _filings(spark, sf, html):
    return FI.parsed_filings(docs(spark, sf, html), keys=KEY)


# -- forms ---------------------------------------------------------------------------------------


@query("h9_filing_totals", DISC + " SELECT ord, shares cumulative_shares, face total_shares, series+0.25 ratio_pct FROM disc")
def h9_totals(spark, sf):
    html = _either(
        table(["1. 전환청구권 행사주식수 누계 (주) (기 신고된 주식수량 제외)", comma("shares")], ["-발행주식총수(주)", comma("face")], ["-발행주식총수 대비(%)", cat(F.col("series"), ".25")]),
        table(["행사주식수 누계", cat(comma("shares"), "주")], ["발행주식총수", comma("face")], ["발행주식총수 대비", cat(F.col("series"), ".25%")]),
    )
    return FI.filing_exercises(_filings(spark, sf, html), keys=KEY)


@query(
    "h9_filing_claims",
    DISC + f""" SELECT ord, i row_no, {DAY} AS "date", series, '전환사채' bond_type, face+i amount, price conversion_price, shares+i shares, '2030-01-0'||(i+1) listing_date
    FROM disc, (SELECT unnest([0,1,2]) i) r""",
)
def h9_claims(spark, sf):
    rows = [[_day(), F.col("series"), "전환사채", comma(F.col("face") + i), comma("price"), comma(F.col("shares") + i), f"2030-01-0{i + 1}"] for i in range(3)]
    html = _either(
        table(["청구일자", "회차", "종류", "청구금액", "전환가액", "발행한 주식수", "상장일 또는 예정일"], *rows),
        cat(table(["머리", "다른 표"]), table(["행사일자", "회차", "종류", "행사금액", "행사가액", "주식수", "상장예정일"], *rows)),
    )
    return FI.filing_claims(_filings(spark, sf, html), keys=KEY).drop("table_no")


@query("h9_filing_balances", DISC + " SELECT ord, i row_no, series+i series, face face_value, 'KRW' currency, price remaining, price+1 conversion_price, shares convertible_shares FROM disc, (SELECT unnest([0,1]) i) r")
def h9_balances(spark, sf):
    rows = [[F.col("series") + i, comma("face"), "KRW", comma("price"), comma(F.col("price") + 1), comma("shares")] for i in range(2)]
    html = _either(
        table(["회차", "발행당시 사채의 권면(전자등록)총액", "통화단위", "신고일 현재 미전환사채 잔액", "전환가액(원)", "전환가능 주식수"], *rows),
        table(["회차", "권면총액", "통화단위", "미전환사채 잔액", "전환가액", "전환가능주식수"], *rows),
    )
    return FI.filing_balances(_filings(spark, sf, html), keys=KEY).drop("table_no")


@query(
    "h10_filing_price_changes",
    DISC + f""" SELECT ord, i pos, '회사'||k company, {DAY} disclosure_date, series+i series, price+i price_before, price-5 price_after, face unconverted, shares shares_before, shares+7+i shares_after
    FROM disc, (SELECT unnest([0,1]) i) r""",
)
def h10_filing(spark, sf):
    """Two adjustments in every filing, in one table or in a table each."""
    price_head = ["회차", "상장여부", "조정전 전환가액 (원)", "조정후 전환가액 (원)"]
    prices = [[F.col("series") + i, "비상장", comma(F.col("price") + i), comma(F.col("price") - 5)] for i in range(2)]
    share_head = ["회차", "미전환사채의 권면(전자등록)총액", "조정전 전환가능 주식수 (주)", "조정후 전환가능 주식수 (주)"]
    shares = [[F.col("series") + i, comma("face"), comma("shares"), comma(F.col("shares") + 7 + i)] for i in range(2)]
    top = table(["회사명", cat("회사", k())], ["공시일", _day()])
    html = _either(
        cat(top, table(price_head, *prices), table(share_head, *shares)),
        cat(top, *(t for i in range(2) for t in (table(price_head, prices[i]), table(share_head, shares[i])))),
    )
    return FI.filing_price_changes(_filings(spark, sf, html), keys=KEY).drop("listed")


@query(
    "h11_filing_contracts",
    DISC + f""" SELECT ord, CASE WHEN k%2=1 THEN '단일판매ㆍ공급계약해지' ELSE '단일판매ㆍ공급계약체결' END AS type, '장비'||k description, face total_amount, shares recent_revenue, series+0.5 revenue_ratio_pct,
    '회사'||k counterparty, '해외' region, '2024-01-01' period_start, {DAY} contract_date, 'a|b|c' notes FROM disc""",
)
def h11_filing(spark, sf):
    def page(title, *captions):
        values = [cat("장비", k()), comma("face"), comma("shares"), cat(F.col("series"), ".5"), cat("회사", k()), "해외", "2024-01-01", _day(), "a • b ※ c"]
        return cat("<title>", title, "</title>", table(*([c, v] for c, v in zip(captions, values, strict=True))))

    html = _either(
        page("단일판매ㆍ공급계약 체결", "1. 판매ㆍ공급계약 내용", "계약금액 합계(원)", "최근 매출액(원)", "매출액 대비(%)", "3. 계약상대방", "4. 판매ㆍ공급지역국가", "시작일", "8. 계약(수주)일자", "10. 기타 투자판단에 참고할 사항"),
        page("단일판매ㆍ공급계약 해지", "계약 내용", "계약금액 합계", "최근 매출액", "매출액 대비", "계약상대방", "지역국가", "계약 시작일", "계약일자", "기타 투자판단에 참고할 사항"),
    )
    r = FI.filing_contracts(_filings(spark, sf, html), keys=KEY)
    return r.select("ord", "type", "description", "total_amount", "recent_revenue", "revenue_ratio_pct", "counterparty", "region", "period_start", "contract_date", F.array_join("notes", "|").alias("notes"))


# -- one table of mixed notices --------------------------------------------------------------------


@query(
    "h_dispatch_notices",
    DISC + """ SELECT ord, 'exercise' category, shares n, face amount FROM disc WHERE k%3=0
    UNION ALL SELECT ord, 'price_adj', price, price-5 FROM disc WHERE k%3=1
    UNION ALL SELECT ord, 'backlog', shares, face FROM disc WHERE k%3=2""",
)
def dispatch(spark, sf):
    """Every notice goes to the job of its category, by heading or by the rows of its table.

    One pass: a job sees the tables of its own notices only, and what the jobs before it have read comes along.
    """
    html = F.when(k() % 3 == 0, _exercise_html()).when(k() % 3 == 1, _adjust_html()).otherwise(_contract_html())
    parsed = pin(E.route(E.parsed_documents(docs(spark, sf, html), keys=KEY)).withColumnsRenamed({"tables": "_tables", "texts": "_texts"}))
    page = [*KEY, "category", "heading", "_tables", "_texts"]
    is_a = lambda category: F.col("category") == category
    own = lambda df, category: pin(df.withColumns({c: F.when(is_a(category), F.col(f"_{c}")) for c in ("tables", "texts")}))
    read = E.exercise_records(own(parsed, "exercise"), keys=page)
    read = read.select(*page, F.struct(F.col("cumulative_shares").alias("n"), F.col("total_shares").alias("amount")).alias("exercise"))
    read = E.contract_records(own(read, "backlog"), keys=[*page, "exercise"])
    read = read.select(*page, "exercise", F.struct(F.col("recent_revenue").alias("n"), F.coalesce("contract_amount", "cancel_amount").alias("amount")).alias("backlog"))
    keys = [*KEY, "category", "exercise", "backlog"]
    read = E.state_adjustments(E.price_adjustment_records(own(read, "price_adj"), keys=keys), keys=keys, outer=True)
    price = F.struct(F.col("price_before").alias("n"), F.col("price_after").alias("amount"))
    found = F.when(is_a("exercise"), F.col("exercise")).when(is_a("backlog"), F.col("backlog")).when(is_a("price_adj") & (F.col("part") == 0), price)
    return read.select(*KEY, "category", found.alias("_r")).where(F.col("_r").isNotNull()).select(*KEY, "category", "_r.*")


@query("h_page_headings", DISC + " SELECT ord, CASE WHEN k%3=0 THEN '공시'||k WHEN k%3=1 THEN '제목'||k ELSE '' END heading FROM disc")
def headings(spark, sf):
    """The first bold line that is not a correction notice, else the title; a plain heading is neither."""
    html = F.when(k() % 3 == 0, cat(head("정정신고(보고)"), head(cat("공시", k())))).when(k() % 3 == 1, cat("<title>제목", k(), "</title><p>x</p>")).otherwise(cat("<body><h2>머리", k(), "</h2></body>"))
    return docs(spark, sf, html).select("ord", TX.page_heading("html").alias("heading"))


@query("h15_company_info", DISC + " SELECT ord, '회사'||k company, '사업'||series business FROM disc")
def company(spark, sf):
    html = cat(head("영업실적 전망"), table(["1. 해당회사", "회사명", cat("회사", k())], ["주요사업", cat("사업", F.col("series"))]))
    return E.company_info(E.parsed_documents(docs(spark, sf, html), keys=KEY), keys=KEY).select("ord", "company", "business")


# -- feeds -----------------------------------------------------------------------------------------


@query("h19_feed_rows", DISC + f" SELECT ord, i pos, {DAY} AS \"day\", 'T'||i||' & '||k title, 'http://a/'||ord||'/'||i url FROM disc, (SELECT unnest(range(3)) i) r")
def feed(spark, sf):
    stamp = cat("Thu, ", F.date_format("entry_date", "dd MMM yyyy"), " 00:00:00 GMT")
    item = lambda i, title: ["<item>", title, "<link>http://a/", F.col("ord"), f"/{i}</link><pubDate>", stamp, "</pubDate></item>"]
    cdata = lambda i: cat(f"<title><![CDATA[T{i} &amp; ", k(), "]]></title>")
    plain = lambda i: cat(f"<title>T{i} &amp; ", k(), "</title>")
    xml = _either(cat("<rss>", *(p for i in range(3) for p in item(i, cdata(i))), "</rss>"), cat("<rss><channel>", *(p for i in range(3) for p in item(i, plain(i))), "</channel></rss>"))
    rows = NW.feed_rows(docs(spark, sf, xml).withColumnRenamed("html", "xml"), keys=KEY)
    return rows.select("ord", F.col("pos").cast("bigint").alias("pos"), F.date_format("date", "yyyy-MM-dd").alias("day"), "title", "url")


@query("h19_payload_rows", DISC + f" SELECT ord, i pos, {DAY} AS \"day\", '[증권'||series||'] 보고'||i title FROM disc, (SELECT unnest(range(2)) i) r WHERE k%4<>3")
def payload(spark, sf):
    """Lists of unequal length give nothing."""
    entry = lambda i: ['{"REPORT_TITLE":"보고', str(i), '","OFFICE_NAME":"증권', F.col("series"), '","REPORT_DATE":"', _day(), '"}']
    whole = cat("<script>", *entry(0), ",", *entry(1), "</script>")
    html = F.when(k() % 4 == 3, cat(whole, '{"REPORT_TITLE":"allein"}')).otherwise(whole)
    rows = NW.payload_rows(docs(spark, sf, html).withColumn("url", F.lit("u")), keys=KEY)
    return rows.select("ord", F.col("pos").cast("bigint").alias("pos"), F.date_format("date", "yyyy-MM-dd").alias("day"), "title")


@query("h19_research_rows", DISC + f" SELECT ord, {DAY} AS \"day\", '리포트'||k title, '가나증권' broker FROM disc")
def research(spark, sf):
    html = _either(
        table(["번호", "제목", "제공사", "작성일"], ["1", cat("리포트", k()), "가나증권", F.date_format("entry_date", "yy.MM.dd")]),
        table(["1", cat("리포트", k()), "가나증권", _day()]),
    )
    rows = NW.research_rows(docs(spark, sf, html), keys=KEY)
    return rows.select("ord", F.date_format("date", "yyyy-MM-dd").alias("day"), "title", "broker")


@query("h20_consensus_json", DISC + " SELECT ord, 2025 fy, price*100000000 revenue, CASE WHEN k%2=0 THEN shares*100000000 END operating_income, NULL::BIGINT net_income FROM disc")
def consensus(spark, sf):
    second = F.when(k() % 2 == 0, cat(',{"title":"영업이익","columns":{"202512":{"value":"', comma("shares"), '"}}}')).otherwise("")
    body = cat(
        '{"financeInfo":{"trTitleList":[{"key":"202412","title":"2024.12.","isConsensus":"N"},{"key":"202512","title":"2025.12.","isConsensus":"Y"}],"rowList":[{"title":"매출액","columns":{"202512":{"value":"',
        comma("price"), '"}}}', second, "]}}",
    )
    return CO.consensus_json(docs(spark, sf, body).withColumnRenamed("html", "body"), keys=KEY)

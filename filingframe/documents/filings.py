"""Filing forms: exercises, price changes, contracts, earnings changes, issuances, rights issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import maps as K
from ..functions.numbers import parse_korean_float, parse_korean_int, performance_unit
from ..functions.text import clean_text, let, page_title, strip_tags
from ..operators.barrier import pin
from . import cells as C
from .exchange import at, first_of, has, joined


def parsed_filings(docs: DataFrame, *, keys: Sequence[str], html: str = "html") -> DataFrame:
    """(keys, title, body, tables, texts, pairs) of filing pages."""
    step = pin(
        docs.select(*keys, page_title(html).alias("title"), clean_text(strip_tags(html, " ")).alias("body"), C.html_tables(html).alias("tables"))
    )
    return pin(
        step.select(
            "*",
            F.transform("tables", lambda t: F.filter(F.transform(t, C.row_texts), lambda r: F.size(r) > 0)).alias("texts"),
            C.merge_pairs(F.col("tables")).alias("pairs"),
        )
    )


def headed_table_rows(parsed: DataFrame, *, keys: Sequence[str], keep) -> DataFrame:
    """Data rows of the tables whose first row passes ``keep``: (table_no, row_no, pairs)."""
    tables = parsed.select(*keys, F.posexplode("tables").alias("table_no", "_t"))
    tables = tables.where(F.size("_t") > 0).where(keep(joined(C.row_texts(at(F.col("_t"), 0)))))
    return tables.select(*keys, "table_no", F.posexplode(C.headed_rows(F.col("_t"))).alias("row_no", "row"))


def _captioned(pairs: Column, job: str, field: str) -> Column:
    """Value under the first caption of a field that the form has."""
    return K.kv_first(pairs, *lx.FILING_CAPTIONS[job][field])


def _int_or_null(c: Column) -> Column:
    return F.trim(c).try_cast("bigint")


def filing_exercises(parsed: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Totals of an exercise filing."""
    p = F.col("pairs")
    return parsed.select(
        *keys,
        parse_korean_int(_captioned(p, "filing_exercises", "cumulative_shares")).alias("cumulative_shares"),
        parse_korean_int(_captioned(p, "filing_exercises", "total_shares")).alias("total_shares"),
        parse_korean_float(_captioned(p, "filing_exercises", "ratio_pct")).alias("ratio_pct"),
    )


def filing_claims(parsed: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Claims of exercise filings, columns found by header."""
    rows = headed_table_rows(parsed, keys=keys, keep=lambda t: has(t, "청구일자", "행사일자"))
    r = F.col("row")
    return rows.select(
        *keys, "table_no", "row_no",
        _captioned(r, "filing_claims", "date").alias("date"),
        _int_or_null(_captioned(r, "filing_claims", "series")).alias("series"),
        _captioned(r, "filing_claims", "bond_type").alias("bond_type"),
        parse_korean_int(_captioned(r, "filing_claims", "amount")).alias("amount"),
        parse_korean_int(_captioned(r, "filing_claims", "conversion_price")).alias("conversion_price"),
        parse_korean_int(_captioned(r, "filing_claims", "shares")).alias("shares"),
        _captioned(r, "filing_claims", "listing_date").alias("listing_date"),
    )


def filing_balances(parsed: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Bond balances of exercise filings."""
    rows = headed_table_rows(parsed, keys=keys, keep=lambda t: has(t, "미전환사채", "전환사채 잔액"))
    r = F.col("row")
    return rows.select(
        *keys, "table_no", "row_no",
        _int_or_null(_captioned(r, "filing_balances", "series")).alias("series"),
        parse_korean_int(_captioned(r, "filing_balances", "face_value")).alias("face_value"),
        _captioned(r, "filing_balances", "currency").alias("currency"),
        parse_korean_int(_captioned(r, "filing_balances", "remaining")).alias("remaining"),
        parse_korean_int(_captioned(r, "filing_balances", "conversion_price")).alias("conversion_price"),
        parse_korean_int(_captioned(r, "filing_balances", "convertible_shares")).alias("convertible_shares"),
    )


def filing_price_changes(parsed: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Every adjustment of a price-change filing, numbered by ``pos``; the head data comes from the other tables.

    A filing without an adjustment gives one row without prices.
    """
    sides = lambda t: F.contains(t, F.lit("조정전")) & F.contains(t, F.lit("조정후"))
    # a table of share numbers may have both sides too: it names no price
    share = lambda t: has(t, "전환가능") & has(t, "조정전", "조정후") & ~has(t, "가액")
    pair = lambda t: sides(t) & ~share(t)
    rows_of = lambda tables: F.flatten(F.transform(tables, C.headed_rows))
    price_rows = rows_of(F.filter("tables", lambda t: pair(joined(C.row_texts(at(t, 0))))))
    share_rows = rows_of(F.filter("tables", lambda t: share(joined(C.row_texts(at(t, 0))))))
    other = F.filter("tables", lambda t: ~pair(joined(C.row_texts(at(t, 0)))) & ~share(joined(C.row_texts(at(t, 0)))))
    step = pin(parsed.select(*keys, price_rows.alias("_prices"), share_rows.alias("_shares"), C.merge_pairs(other).alias("_p")))
    n = F.greatest(F.size("_prices"), F.size("_shares"), F.lit(1))
    step = step.select(*keys, "_prices", "_shares", "_p", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    step = step.select(*keys, "pos", F.get("_prices", F.col("pos")).alias("_a"), F.get("_shares", F.col("pos")).alias("_s"), "_p")
    a, s, p = F.col("_a"), F.col("_s"), F.col("_p")
    return step.select(
        *keys,
        "pos",
        _captioned(p, "filing_price_changes", "company").alias("company"),
        _captioned(p, "filing_price_changes", "disclosure_date").alias("disclosure_date"),
        _int_or_null(_captioned(a, "filing_price_changes", "series")).alias("series"),
        _captioned(a, "filing_price_changes", "listed").alias("listed"),
        parse_korean_int(_captioned(a, "filing_price_changes", "price_before")).alias("price_before"),
        parse_korean_int(_captioned(a, "filing_price_changes", "price_after")).alias("price_after"),
        parse_korean_int(_captioned(s, "filing_price_changes", "unconverted")).alias("unconverted"),
        parse_korean_int(_captioned(s, "filing_price_changes", "shares_before")).alias("shares_before"),
        parse_korean_int(_captioned(s, "filing_price_changes", "shares_after")).alias("shares_after"),
    )


def filing_contracts(parsed: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Supply contract filings by exact keys."""
    p = F.col("pairs")
    notes = K.kv_first(p, "10. 기타 투자판단에 참고할 사항", "기타 투자판단에 참고할 사항")
    lines = F.filter(F.transform(F.split(notes, r"[\n•·※]+"), clean_text), lambda t: t != "")

    def group(number: str, word: str) -> Column:
        picked = F.filter(p, lambda e: e["key"].startswith(number) | has(e["key"], word))
        return F.when(F.size(picked) > 0, F.map_from_entries(picked))

    return parsed.select(
        *keys,
        F.when(has(F.col("title"), "해지"), F.lit("단일판매ㆍ공급계약해지")).otherwise(F.lit("단일판매ㆍ공급계약체결")).alias("type"),
        _captioned(p, "filing_contracts", "description").alias("description"),
        _captioned(p, "filing_contracts", "conditional").alias("conditional"),
        parse_korean_int(_captioned(p, "filing_contracts", "confirmed_amount")).alias("confirmed_amount"),
        parse_korean_int(_captioned(p, "filing_contracts", "disclosed_amount")).alias("disclosed_amount"),
        parse_korean_int(_captioned(p, "filing_contracts", "total_amount")).alias("total_amount"),
        parse_korean_int(_captioned(p, "filing_contracts", "recent_revenue")).alias("recent_revenue"),
        parse_korean_float(_captioned(p, "filing_contracts", "revenue_ratio_pct")).alias("revenue_ratio_pct"),
        _captioned(p, "filing_contracts", "counterparty").alias("counterparty"),
        _captioned(p, "filing_contracts", "relationship").alias("relationship"),
        _captioned(p, "filing_contracts", "region").alias("region"),
        _captioned(p, "filing_contracts", "period_start").alias("period_start"),
        _captioned(p, "filing_contracts", "period_end").alias("period_end"),
        group("6.", "계약조건").alias("conditions"),
        F.struct(*(K.kv_first(p, k).alias(n) for n, k in (("own", "자체생산"), ("outsourced", "외주생산"), ("other", "기타")))).alias("supply"),
        _captioned(p, "filing_contracts", "contract_date").alias("contract_date"),
        group("9.", "변경처리").alias("change_info"),
        lines.alias("notes"),
    )


# -- earnings changes ----------------------------------------------------------------------------

# --- fixed values: columns and labels of earnings-change notices -------------------------------
_COLUMNS = [("current", "당해사업연도"), ("previous", "직전사업연도"), ("change", "증감금액"), ("ratio", "증감비율(%)"), ("turnaround", "흑자적자전환여부")]
_INCOME = ("- 매출액", "- 영업이익", "- 당기순이익")
_STATUS = ("- 자산총계", "- 부채총계", "- 자본총계", "- 자본금")


def _is_income(t: Column) -> Column:
    return has(t, "당해사업연도") & has(t, "증감금액")


def _is_status(t: Column) -> Column:
    return has(t, "당해사업연도") & has(t, "자산", "재무현황")


def _line(label: Column, value) -> Column:
    return F.struct(label.alias("label"), *(value(caption).alias(name) for name, caption in _COLUMNS))


def _section_lines(rows: Column, opens, closes) -> Column:
    """Lines of the last section of a merged table that ``opens`` starts and ``closes`` ends."""
    heads = F.filter(F.transform(rows, lambda r, i: F.when(let(joined(r), opens), i.cast("int"))), lambda i: i.isNotNull())

    def value(r: Column, n: Column) -> Column:
        return F.when(n > 0, F.get(r, n.cast("int") - 1))

    def lines(start: Column, stop: Column, places: Column) -> Column:
        body = F.filter(rows, lambda r, i: (i > start) & (i < stop) & (at(r, 0) != ""))
        return F.transform(body, lambda r: _line(at(r, 0), lambda caption: value(r, places[caption])))

    def section(start: Column) -> Column:
        ends = F.filter(
            F.transform(rows, lambda r, i: F.when((i > start) & (let(joined(r), closes) | at(r, 0).rlike(r"^\d+\.")), i.cast("int"))),
            lambda i: i.isNotNull(),
        )
        stop = F.coalesce(F.array_min(ends), F.size(rows))
        places = let(
            F.get(rows, start),
            lambda head: F.struct(*(F.array_position(head, F.lit(caption)).alias(caption) for _, caption in _COLUMNS)),
        )
        return F.when(start.isNotNull(), let(stop, lambda e: let(places, lambda at_: lines(start, e, at_))))

    return let(F.array_max(heads), section)


def performance_records(parsed: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Earnings-change notices: period, unit, income lines and status lines.

    Sections come from their own tables, else from sections of a merged table, else from
    composite keys. The result keeps them as arrays; explode with ``child_rows``.
    """
    first = lambda t: joined(at(t, 0))

    def dedicated(test) -> Column:
        found = F.filter("tables", lambda t: let(joined(C.row_texts(at(t, 0))), test))

        def lines(f: Column) -> Column:
            rows = C.headed_rows(F.try_element_at(f, F.lit(-1)))
            listed = F.transform(rows, lambda r: _line(at(r, 0)["value"], lambda caption: K.kv_value_where(r, lambda k: k == caption)))
            return F.when(F.size(f) > 0, F.filter(listed, lambda x: x["label"] != ""))

        return let(found, lines)

    def merged(opens, closes) -> Column:
        plain = F.filter("texts", lambda t: let(first(t), lambda line: ~_is_income(line) & ~_is_status(line)))
        return first_of(F.transform(plain, lambda t: _section_lines(t, opens, closes)))

    step = pin(parsed).withColumns(
        {
            "_i": F.coalesce(dedicated(_is_income), merged(_is_income, _is_status)),
            "_s": F.coalesce(
                dedicated(lambda t: _is_status(t) & ~_is_income(t)),
                merged(lambda t: _is_status(t) & ~_is_income(t), lambda t: F.lit(False)),
            ),
        }
    )
    step = pin(step)
    p = F.col("pairs")

    def composite(labels: Sequence[str]) -> Column:
        lines = [
            _line(F.lit(label), lambda caption, label=label: K.kv_first(p, f"{label}_{caption}", f"{label} {caption}")) for label in labels
        ]
        return F.filter(F.array(*lines), lambda x: F.coalesce(*(x[n] for n, _ in _COLUMNS)).isNotNull())

    return step.select(
        *keys,
        _captioned(p, "performance_records", "statement_type").alias("statement_type"),
        performance_unit("body").alias("unit"),
        _captioned(p, "performance_records", "period_start").alias("period_start"),
        _captioned(p, "performance_records", "period_end").alias("period_end"),
        F.coalesce("_i", composite(_INCOME)).alias("income"),
        F.coalesce("_s", composite(_STATUS)).alias("status"),
        _captioned(p, "performance_records", "reason").alias("reason"),
    )


def performance_measures(records: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Income lines as measures, ready for the reconciliation."""

    def current(word: str) -> Column:
        line = at(F.filter("income", lambda x: has(x["label"], word)), 0)
        return parse_korean_int(line["current"])

    return records.select(
        *keys, "period_start", "period_end", "unit", current("매출액").alias("revenue"),
        current("영업이익").alias("operating_income"), current("당기순이익").alias("net_income"),
    )


# -- issuances -----------------------------------------------------------------------------------


def bond_issuances(parsed: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Bond issuance decisions: type, series, face value and conversion terms."""
    p = F.col("pairs")
    return parsed.select(
        *keys,
        F.when(has(F.col("title"), "신주인수권부사채"), F.lit("신주인수권부사채권 발행결정")).otherwise(F.lit("전환사채권 발행결정")).alias("type"),
        _int_or_null(_captioned(p, "bond_issuances", "series")).alias("series"),
        _captioned(p, "bond_issuances", "kind").alias("kind"),
        parse_korean_int(_captioned(p, "bond_issuances", "face_value")).alias("face_value"),
        parse_korean_int(_captioned(p, "bond_issuances", "conversion_price")).alias("conversion_price"),
        parse_korean_int(_captioned(p, "bond_issuances", "convertible_shares")).alias("convertible_shares"),
        parse_korean_float(_captioned(p, "bond_issuances", "share_ratio_pct")).alias("share_ratio_pct"),
        _captioned(p, "bond_issuances", "exercise_start").alias("exercise_start"),
        _captioned(p, "bond_issuances", "exercise_end").alias("exercise_end"),
    )


def _dashed(c: Column) -> Column:
    pattern = r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"
    y, m, d = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(F.trim(c))


def rights_issues(parsed: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Rights issue decisions from key-value tables, in the form the dilution state takes."""
    p = F.col("pairs")
    positive = lambda *k: F.nullif(parse_korean_int(K.kv_first(p, *k)), F.lit(0))
    purposes = ("시설자금", "영업양수자금", "운영자금", "채무상환자금", "기타자금")
    amounts = [F.coalesce(positive(f"{w} (원)", f"{w}(원)", w), F.lit(0).cast("bigint")) for w in purposes]
    funding = amounts[0]
    for a in amounts[1:]:
        funding = funding + a
    return parsed.select(
        *keys,
        positive("보통주식 (주)", "보통주식(주)").alias("common_shares"),
        positive("기타주식 (주)", "기타주식(주)").alias("other_shares"),
        parse_korean_int(_captioned(p, "rights_issues", "issue_price")).alias("issue_price"),
        positive("전환가액 (원/주)", "전환가액", "전환가액(원/주)").alias("conversion_price"),
        positive("주식수", "전환주식수").alias("conversion_shares"),
        parse_korean_float(_captioned(p, "rights_issues", "conversion_ratio_pct")).alias("conversion_ratio_pct"),
        F.nullif(funding, F.lit(0)).alias("funding"),
        _captioned(p, "rights_issues", "share_type").alias("share_type"),
        _dashed(_captioned(p, "rights_issues", "exercise_start")).alias("exercise_start"),
        _dashed(_captioned(p, "rights_issues", "exercise_end")).alias("exercise_end"),
    )


# --- fixed values: fields of a rights issue in running text: (field, type, patterns in order) ---
_KDATE = r"(\d{4}년\s*\d{1,2}월\s*\d{1,2}일)"
RIGHTS_TEXT_RULES = [
    ("common_shares", "int", [r"(?s)1\.\s*신주의\s*종류와\s*수\s*\n?.*?보통주식\s*\(주\)\s*([\d,\-]+)"]),
    ("other_shares", "int", [r"(?s)1\.\s*신주의\s*종류와\s*수\s*\n?.*?기타주식\s*\(주\)\s*([\d,\-]+)", r"기타주식\s*\(주\)\s*([\d,]+)"]),
    ("par_value", "int", [r"1주당\s*액면가액\s*\(원\)\s*([\d,]+)"]),
    ("pre_common_shares", "int", [r"증자전\s*보통주식\s*\(주\)\s*([\d,]+)", r"(?s)3\.\s*증자전\s*\n?.*?보통주식\s*\(주\)\s*([\d,]+)"]),
    ("pre_other_shares", "int", [r"발행주식총수\s*\(주\)\s*기타주식\s*\(주\)\s*([\d,]+)"]),
    ("fund_facility", "int", [r"시설자금\s*\(원\)\s*([\d,\-]+)"]),
    ("fund_acquisition", "int", [r"영업양수자금\s*\(원\)\s*([\d,\-]+)"]),
    ("fund_operation", "int", [r"운영자금\s*\(원\)\s*([\d,\-]+)"]),
    ("fund_repayment", "int", [r"채무상환자금\s*\(원\)\s*([\d,\-]+)"]),
    ("issue_method", "text", [r"5\.\s*증자방식\s+(.+?)(?:\n|$)"]),
    ("share_type", "text", [r"주식의\s*내용\s+(.+?)(?:\n|기타)"]),
    ("conversion_ratio_pct", "float", [r"전환비율\s*\(%\)\s*([\d,.]+)"]),
    ("conversion_price", "int", [r"전환가액\s*\(원/주\)\s*([\d,]+)"]),
    ("conversion_share_kind", "text", [r"종류\s+(.+?기명식\s*보통주)"]),
    ("conversion_shares", "int", [r"(?:전환에\s*따라|발행할\s*주식)\s*주식수\s*([\d,]+)", r"발행할\s*주식\s*주식수\s*([\d,]+)", r"(?s)주식수\s+([\d,]+)\s*\n.*?대비\s*비율"]),
    ("share_ratio_pct", "float", [r"대비\s*비율\s*\(%?\)?\s*([\d,.]+)", r"주식총수\s*\n?\s*([\d,.]+)\s*\n?\s*대비\s*비율"]),
    ("exercise_start", "date", [r"전환청구기간\s*\n?.*?시작일\s+" + _KDATE, r"시작일\s+" + _KDATE]),
    ("exercise_end", "date", [r"종료일\s+" + _KDATE]),
    ("issue_price", "int", [r"6\.\s*신주\s*발행가액\s*\n?.*?기타주식\s*\(원\)\s*([\d,]+)", r"신주\s*발행가액.*?기타주식\s*\(원\)\s*([\d,]+)"]),
    ("reference_price", "int", [r"7\.\s*기준주가\s*\n?.*?기타주식\s*\(원\)\s*([\d,]+)", r"기준주가\s*\n?.*?기타주식\s*\(원\)\s*([\d,]+)"]),
    ("discount_rate_pct", "float", [r"할인율\s*또는\s*할증률?\s*\(%\)\s*([\d,.]+)", r"할인율.*?\(%\)\s*([\d,.]+)"]),
    ("payment_date", "date", [r"9\.\s*납입일\s+" + _KDATE, r"납입일\s+" + _KDATE]),
    ("dividend_base_date", "date", [r"배당기산일\s+" + _KDATE]),
    ("board_decision_date", "date", [r"이사회결의일\s*\(결정일\)\s*" + _KDATE]),
    ("vwap_month", "float", [r"1개월간의\s*가중산술평균주가\s*\(A\)\s*[\d,]+\s+[\d,]+\s+([\d,.]+)"]),
    ("vwap_week", "float", [r"1주일간의\s*가중산술평균주가\s*\(B\)\s*[\d,]+\s+[\d,]+\s+([\d,.]+)"]),
    ("vwap_last", "float", [r"최근일\s*가중산술평균주가\s*\(C\)\s*[\d,]+\s+[\d,]+\s+([\d,.]+)"]),
    ("vwap_mean", "float", [r"산술평균주가\s*\(D\)\s*([\d,.]+)"]),
    ("vwap_reference", "float", [r"기준주가\s*:\s*\(C\)와\s*\(D\)\s*중\s*낮은\s*가액\s*([\d,.]+)"]),
    ("securities_registration", "text", [r"증권신고서\s*제출대상\s*여부\s+(\S+)"]),
]


def rights_issues_from_text(docs: DataFrame, *, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Rights issue fields by a table of (field, type, patterns); the first pattern that hits counts."""
    readers = {"int": parse_korean_int, "float": parse_korean_float, "date": _dashed, "text": F.trim}

    def field(kind: str, patterns: Sequence[str]) -> Column:
        tries = [readers[kind](F.nullif(F.regexp_extract(text, p, 1), F.lit(""))) for p in patterns]
        return F.coalesce(*(F.nullif(t, F.lit(0)) if kind == "int" else t for t in tries))

    allocation = F.regexp_extract_all(text, F.lit(r"([\w\s]+(?:주식회사|㈜).*?)\s*(?:1년간|의무보유).*?(\d[\d,]+)\s*(?:주|$)"), F.lit(1))
    counts = F.regexp_extract_all(text, F.lit(r"([\w\s]+(?:주식회사|㈜).*?)\s*(?:1년간|의무보유).*?(\d[\d,]+)\s*(?:주|$)"), F.lit(2))
    allocated = F.zip_with(allocation, counts, lambda n, c: F.struct(F.trim(n).alias("name"), parse_korean_int(c).alias("shares")))
    return docs.select(
        *keys, *(field(kind, patterns).alias(name) for name, kind, patterns in RIGHTS_TEXT_RULES), allocated.alias("allocations")
    )

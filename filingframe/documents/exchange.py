"""Exchange disclosures: exercises, price adjustments, contracts, preliminary results, forecasts.

Every job works on one document per row. Tables are arrays of rows of cell texts, sections are
positions inside those arrays, and child records are exploded at the end, so nothing is
shuffled and no document can make a partition heavy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maps as K
from ..functions.dates import quarter_end_label
from ..functions.numbers import canonical_item, parse_korean_float, parse_korean_int
from ..functions.text import let, page_heading
from ..operators.barrier import pin
from ..operators.predicates import classify_heading, exercise_subtype, price_adj_subtype
from . import cells as C

_DAY = r"^\d{4}-\d{2}-\d{2}$"
_MONEY = r"^[A-Z]{3}"


def has(c: Column, *words: str) -> Column:
    """Any of the words occurs."""
    out = F.contains(c, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(c, F.lit(w))
    return out


def at(row: Column, i: int | Column) -> Column:
    """Cell text, NULL beyond the row."""
    return F.get(row, F.lit(i) if isinstance(i, int) else i)


def joined(row: Column) -> Column:
    return F.array_join(row, " ")


def first_of(values: Column) -> Column:
    return at(F.filter(values, lambda v: v.isNotNull()), 0)


def last_index(flags: Column) -> Column:
    return F.array_max(F.transform(flags, lambda f, i: F.when(f, i)))


def first_index(flags: Column) -> Column:
    return F.array_min(F.transform(flags, lambda f, i: F.when(f, i)))


def parsed_documents(docs: DataFrame, *, keys: Sequence[str], html: str = "html") -> DataFrame:
    """(keys, heading, tables, texts): the form all record jobs start from.

    ``tables`` keeps header and span marks, ``texts`` is the same as plain cell texts. Most jobs need
    texts only, so each is read from the rows on its own; the one that is not asked for is not read.
    """
    parsed = pin(docs.select(*keys, page_heading(html).alias("heading"), C.markup_rows(html).alias("_rows")))
    tables = F.transform("_rows", lambda t: F.transform(t, C.row_cells))
    texts = F.transform("_rows", lambda t: F.filter(F.transform(t, C.row_cell_texts), lambda r: F.size(r) > 0))
    # both are read inside many lambdas, where a copied expression would be computed once per element
    return pin(parsed.select(*keys, "heading", tables.alias("tables"), texts.alias("texts")))


def route(parsed: DataFrame) -> DataFrame:
    """Category of each document, by heading or by the first rows of its first table."""
    sample = F.transform(at(F.col("texts"), 0), joined)
    return parsed.withColumn("category", classify_heading("heading", sample))


def find_notes(pairs: Column) -> Column:
    return F.nullif(F.trim(K.kv_value_where(pairs, lambda k: has(k, "기타 투자판단"))), F.lit(""))


def find_history(pairs: Column) -> Column:
    return F.nullif(F.trim(K.kv_value_where(pairs, lambda k: has(k, "공시이력", "관련공시"))), F.lit(""))


# -- exercises -----------------------------------------------------------------------------------


def _claim(r: Column) -> Column:
    dated = at(r, 1).rlike(_DAY)
    return F.struct(
        at(r, 0).alias("date"),
        F.when(dated, at(r, 1)).alias("issue_date"),
        F.when(~dated, parse_korean_int(at(r, 1))).alias("series"),
        at(r, 2).alias("bond_type"),
        parse_korean_int(at(r, 3)).alias("amount"),
        parse_korean_int(at(r, 4)).alias("conversion_price"),
        parse_korean_int(at(r, 5)).alias("shares"),
        at(r, 6).alias("listing_date"),
    )


def _balance(r: Column) -> Column:
    """Balance row, dated (share classes) or by series (bonds).

    The remaining amount stands between two currency marks, where a dash is zero; with a single
    mark it stands before it. Price and shares follow the last mark.
    """
    marks = F.filter(F.transform(r, lambda t, i: F.when(t.rlike(_MONEY), i)), lambda i: i.isNotNull())

    def placed(m: Column) -> Column:
        one, two, last = at(m, 0), at(m, 1), F.try_element_at(m, F.lit(-1))
        between = F.when(two.isNotNull(), F.slice(r, one + 2, F.greatest(two - one - 1, F.lit(0))))
        inside = let(
            between,
            lambda b: F.coalesce(
                first_of(F.transform(b, parse_korean_int)),
                F.when(F.exists(b, lambda t: F.trim(t) == "-"), F.lit(0).cast("bigint")),
            ),
        )
        return F.struct(
            at(r, 0).rlike(_DAY).alias("dated"), one.alias("one"), two.alias("two"), inside.alias("inside"),
            F.when(two.isNull() & (one >= 3), parse_korean_int(at(r, one - 1))).alias("before"),
            F.when(last.isNotNull(), F.filter(F.slice(r, last + 2, F.size(r)), lambda t: t != "")).alias("after"),
        )

    return let(let(marks, placed), lambda p: _balance_fields(r, p))


def _balance_fields(r: Column, p: Column) -> Column:
    dated, by_series = p["dated"], ~p["dated"]
    one, two, inside, before, after = (p[c] for c in ("one", "two", "inside", "before", "after"))
    return F.struct(
        F.when(dated, at(r, 0)).alias("issue_date"),
        F.when(by_series, parse_korean_int(at(r, 0))).alias("series"),
        F.when(dated, at(r, 1)).alias("bond_type"),
        F.when(by_series, parse_korean_int(at(r, 1))).alias("face_value"),
        F.when(by_series, F.regexp_extract(at(r, one), r"([A-Z]{3})", 1)).alias("currency"),
        F.coalesce(by_series & (inside.isNotNull() | (two.isNull() & (one >= 3))), F.lit(False)).alias("has_remaining"),
        F.when(by_series, F.coalesce(inside, before)).alias("remaining"),
        F.when(dated, parse_korean_int(at(r, 4))).otherwise(parse_korean_int(at(after, 0))).alias("conversion_price"),
        F.when(by_series & (F.size(after) >= 2), parse_korean_int(at(after, 1))).alias("convertible_shares"),
        F.when(dated, parse_korean_int(at(r, 2))).alias("total_shares"),
        F.when(dated, parse_korean_int(at(r, 3))).alias("converted_shares"),
        F.when(dated, parse_korean_int(at(r, 5))).alias("remaining_shares"),
    )


def _table_kind(t: Column) -> Column:
    summary = let(joined(F.flatten(t)), lambda whole: has(whole, "행사주식수 누계") & has(whole, "발행주식총수"))
    return let(
        joined(at(t, 0)),
        lambda first: F.when(has(first, "청구일자", "행사일자"), F.lit("claims"))
        .when(has(first, "회차") & has(first, "권면", "미잔액", "미전환", "전환가능"), F.lit("balance"))
        .when(summary, F.lit("summary"))
        .otherwise(F.lit("")),
    )


def exercise_records(parsed: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Exercise notices: totals, claims, balances; option notices: exercises and remaining shares.

    Tables are recognised by content; where that fails the tables after the summary count.
    """
    kinds = F.transform("texts", _table_kind)
    step = parsed.select(*keys, exercise_subtype("heading").alias("type"), "texts", kinds.alias("_k"))
    find = lambda kind: last_index(F.transform("_k", lambda k: k == kind))
    step = step.withColumns(
        {
            "_s": F.coalesce(find("summary"), F.lit(0)),
            "_option": F.col("type") == "주식매수선택권행사",
        }
    )
    step = pin(step)
    later = F.filter("texts", lambda t, i: (i > F.when(F.col("_option"), 0).otherwise(F.col("_s"))) & (F.size(t) >= 2))
    # a table that is recognised is read without looking for the later ones
    step = step.withColumns(
        {
            "_later": later,
            "_claims": F.coalesce(at(F.col("texts"), find("claims")), at(later, 0)),
            "_balance": F.coalesce(at(F.col("texts"), find("balance")), at(later, 1)),
            "_pairs": C.text_pairs(at(F.col("texts"), F.col("_s"))),
        }
    )
    step = pin(step)
    pairs, option = F.col("_pairs"), F.col("_option")
    big = F.filter("_claims", lambda r: at(r, 0).rlike(_DAY))
    rows = F.filter("_balance", lambda r: at(r, 0).rlike(_DAY) | parse_korean_int(at(r, 0)).isNotNull())
    cumulative = F.coalesce(
        parse_korean_int(K.kv_value_where(pairs, lambda k: has(k, "누계") & has(k, "행사", "청구"))),
        parse_korean_int(K.kv_value_where(pairs, lambda k: has(k, "누계"))),
    )
    # option summary: the last row that starts with a positive count
    counts = F.filter(at(F.col("texts"), 0), lambda r: parse_korean_int(at(r, 0)) > 0)
    last = F.try_element_at(counts, F.lit(-1))
    left = at(F.filter(at(F.col("_later"), 1), lambda r: parse_korean_int(at(r, 0)).isNotNull()), 0)
    n = lambda i: F.coalesce(parse_korean_int(at(left, i)), F.lit(0).cast("bigint"))
    exercised = F.transform(
        F.filter(at(F.col("_later"), 0), lambda r: at(r, 0).rlike(_DAY)),
        lambda r: F.struct(
            at(r, 0).alias("date"), at(r, 1).alias("relation"), at(r, 2).alias("name"),
            parse_korean_int(at(r, 3)).alias("exercise_price"), parse_korean_int(at(r, 4)).alias("par_value"),
            parse_korean_int(at(r, 5)).alias("shares_new"), parse_korean_int(at(r, 6)).alias("shares_treasury"),
            parse_korean_int(at(r, 7)).alias("shares_cash"), parse_korean_int(at(r, 8)).alias("shares_total"),
        ),
    )
    return step.select(
        *keys,
        "type",
        F.when(~option, cumulative).otherwise(parse_korean_int(at(last, 1))).alias("cumulative_shares"),
        F.when(
            ~option, parse_korean_int(K.kv_value_where(pairs, lambda k: has(k, "발행주식총수") & ~has(k, "대비")))
        ).otherwise(parse_korean_int(at(last, 0))).alias("total_shares"),
        F.when(
            ~option, parse_korean_float(K.kv_value_where(pairs, lambda k: has(k, "발행주식") & has(k, "대비")))
        ).otherwise(first_of(F.transform(F.reverse(last), parse_korean_float))).alias("ratio_pct"),
        F.when(~option, F.transform(big, _claim)).alias("claims"),
        F.when(~option, F.transform(rows, _balance)).alias("balances"),
        F.when(option, exercised).alias("option_exercises"),
        F.when(
            option & left.isNotNull(),
            F.struct(n(0).alias("total"), n(1).alias("new_shares"), n(2).alias("treasury_shares"), n(3).alias("cash_settlement"), n(4).alias("other")),
        ).alias("option_remaining"),
        find_notes(pairs).alias("notes"),
        find_history(pairs).alias("history"),
    )


def child_rows(records: DataFrame, *, keys: Sequence[str], column: str) -> DataFrame:
    """Child table of an array column, in document order (``pos``)."""
    return pin(records.select(*keys, column)).select(*keys, F.posexplode(column).alias("pos", "_c")).select(*keys, "pos", "_c.*")


def state_balances(records: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Exercise records as input of the dilution state."""
    exchangeable = (
        F.coalesce(F.exists("claims", lambda c: has(F.coalesce(c["bond_type"], F.lit("")), "교환")), F.lit(False))
        | F.coalesce(has(F.col("notes"), "교환사채", "교환청구권"), F.lit(False))
    )
    rows = pin(records).select(
        *keys, "type", exchangeable.alias("exchangeable"), F.col("option_remaining")["new_shares"].alias("new_shares"),
        F.posexplode_outer("balances").alias("pos", "_b"),
    )
    return rows.select(
        *keys, F.coalesce("pos", F.lit(0)).cast("bigint").alias("pos"), "type", "exchangeable",
        *(F.col("_b")[c].alias(c) for c in ("series", "has_remaining", "remaining", "face_value", "conversion_price", "convertible_shares", "remaining_shares")),
        "new_shares",
    )


# -- price adjustments ---------------------------------------------------------------------------


def _section_heads(rows: Column) -> Column:
    """Header rows of a table: position, kind and which columns the section has."""

    def head(r: Column, i: Column) -> Column:
        return let(joined(r), lambda t: marks(r, i, t))

    def marks(r: Column, i: Column, t: Column) -> Column:
        pair = (F.size(r) >= 3) & has(t, "조정전") & has(t, "조정후")
        kind = (
            F.when(pair & has(t, "가액") & ~has(t, "주식수"), F.lit("price"))
            .when(pair & has(t, "주식수"), F.lit("shares"))
            .when(pair | at(r, 0).rlike(r"^\d+\."), F.lit("other"))
        )
        return F.struct(
            i.cast("int").alias("i"), kind.alias("kind"), has(t, "상장여부").alias("listed"),
            has(t, "회차").alias("series"), has(t, "통화단위").alias("money"),
        )

    return F.filter(F.transform(rows, head), lambda h: h["kind"].isNotNull())


def _with_section(rows: Column, heads: Column) -> Column:
    """Rows with the header they stand under (a header stands under itself)."""
    return F.transform(
        rows,
        lambda r, i: F.struct(
            r.alias("r"),
            F.try_element_at(F.filter(heads, lambda h: h["i"] <= i), F.lit(-1)).alias("h"),
            F.exists(heads, lambda h: h["i"] == i).alias("is_head"),
        ),
    )


def _price_row(x: Column) -> Column:
    r, h = x["r"], x["h"]
    n = lambda i: parse_korean_int(at(r, i))
    wide = h["listed"] & (F.size(r) >= 4)
    return F.struct(
        F.when(h["series"], n(0)).alias("series"),
        F.when(h["series"] & wide, at(r, 1)).when(~h["series"] & (F.coalesce(n(0), F.lit(0)) == 0), at(r, 0)).alias("listed"),
        F.when(h["series"] & wide, n(2)).otherwise(n(1)).alias("price_before"),
        F.when(h["series"] & wide, n(3)).otherwise(n(2)).alias("price_after"),
    )


def _share_row(x: Column) -> Column:
    r, h = x["r"], x["h"]
    n = lambda i: parse_korean_int(at(r, i))
    place = first_index(F.transform(r, lambda t: t.rlike(_MONEY)))
    return let(
        place,
        lambda mark: let(
            F.when(mark.isNotNull(), F.filter(F.slice(r, mark + 2, F.size(r)), lambda t: t != "")),
            lambda after: _share_fields(x, mark, after),
        ),
    )


def _share_fields(x: Column, mark: Column, after: Column) -> Column:
    r, h = x["r"], x["h"]
    n = lambda i: parse_korean_int(at(r, i))
    a = lambda i: parse_korean_int(at(after, i))
    before_m = F.when(mark.isNull(), n(3)).when(F.size(after) >= 2, a(0))
    after_m = F.when(mark.isNull(), n(4)).when(F.size(after) >= 2, a(1)).otherwise(a(0))
    return F.struct(
        F.when(h["series"], n(0)).alias("series"),
        F.when(h["series"], n(1)).alias("unconverted"),
        F.when(h["series"] & h["money"], F.regexp_extract(at(r, mark), r"([A-Z]{3})", 1)).alias("currency"),
        F.when(~h["series"], n(0)).alias("current_shares"),
        F.when(~h["series"], n(1)).when(h["money"], before_m).otherwise(n(2)).alias("shares_before"),
        F.when(~h["series"], n(2)).when(h["money"], after_m).otherwise(n(3)).alias("shares_after"),
    )


def price_adjustment_records(parsed: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Adjustments and share changes; both live in sections of the first table."""
    step = parsed.select(*keys, price_adj_subtype("heading").alias("type"), at(F.col("texts"), 0).alias("_rows"))
    step = pin(step.withColumn("_heads", _section_heads(F.col("_rows"))))
    step = pin(step.withColumn("_x", _with_section(F.col("_rows"), F.col("_heads"))))

    def data(kind: str, usable) -> Column:
        return F.filter(
            "_x",
            lambda x: ~x["is_head"] & (x["h"]["kind"] == kind) & ~at(x["r"], 0).isin("회차", "") & usable(x),
        )

    number = lambda x: parse_korean_int(at(x["r"], 0)).isNotNull()
    prices = data("price", lambda x: F.when(x["h"]["series"], number(x)).otherwise(at(x["r"], 0) != "상장여부"))
    shares = data("shares", number)
    plain = F.filter("_x", lambda x: (x["h"].isNull() | (x["h"]["kind"] == "other")) & (at(x["r"], 0) != ""))
    entries = F.transform(plain, lambda x: F.struct(at(x["r"], 0).alias("key"), F.coalesce(at(x["r"], 1), F.lit("")).alias("value")))
    step = step.select(
        *keys, "type", F.transform(prices, _price_row).alias("adjustments"), F.transform(shares, _share_row).alias("share_changes"),
        K.kv_upsert(entries).alias("_pairs"),
    )
    pairs = F.col("_pairs")
    return step.select(
        *keys, "type", "adjustments", "share_changes",
        K.kv_get(pairs, "조정사유").alias("reason"),
        K.kv_any(pairs, "조정근거 및 내용", "조정근거").alias("detail"),
        K.kv_any(pairs, "조정가액 적용일", "가액 적용일").alias("effective_date"),
        find_notes(pairs).alias("notes"), find_history(pairs).alias("history"),
    )


def state_adjustments(records: DataFrame, *, keys: Sequence[str], outer: bool = False) -> DataFrame:
    """Adjustment records as input of the dilution state: prices first, then share changes.

    ``outer`` keeps pages without any, as one row of nulls.
    """
    none = F.lit(None).cast("bigint")
    fields = ("series", "price_before", "price_after", "shares_before", "current_shares", "shares_after", "unconverted")

    def rows(column: str, part: int, has_field: Sequence[str]) -> Column:
        return F.transform(
            column,
            lambda x, i: F.struct(
                F.lit(part).alias("part"), i.cast("bigint").alias("pos"),
                *((x[f] if f in has_field else none).alias(f) for f in fields),
            ),
        )

    both = [rows("adjustments", 0, fields[:3]), rows("share_changes", 1, (fields[0], *fields[3:]))]
    # both lists of a page in one pass: a union would parse the page for each
    present = F.filter(F.array(*both), lambda x: x.isNotNull())
    listed = pin(pin(records).select(*keys, F.flatten(present).alias("_all")))
    each = F.explode_outer if outer else F.explode
    return listed.select(*keys, each("_all").alias("_c")).select(*keys, "_c.*")


# -- contracts -----------------------------------------------------------------------------------


def contract_records(parsed: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Supply contracts concluded or cancelled; keys are found by fragments."""
    step = pin(parsed.select(*keys, C.merge_pairs(F.col("texts"), C.text_pairs).alias("_p")))
    p = F.col("_p")
    step = step.withColumn(
        "_cancel", K.kv_has(p, "해지금액") | K.kv_has(p, "해지일자") | K.kv_has(p, "해지 내용")
    )
    cancel = F.col("_cancel")

    def either(a: Sequence[str], b: Sequence[str]) -> Column:
        return F.when(cancel, K.kv_any(p, *a)).otherwise(K.kv_any(p, *b))

    large = K.kv_get(p, "법인여부")
    amount = F.when(~cancel, parse_korean_int(K.kv_any(p, "계약금액 총액", "계약금액 합계", "계약금액(원)", "계약금액")))
    terms = F.filter(p, lambda e: e["key"].isin("계약금ㆍ선급금 유무", "선급금 지급 시", "대금결제조건"))
    return step.select(
        *keys,
        F.when(cancel, F.lit("단일판매ㆍ공급계약해지")).otherwise(F.lit("단일판매ㆍ공급계약체결")).alias("type"),
        either(("해지 구분", "해지 내용", "공급계약 내용", "공급계약 구분"), ("공급계약 내용", "공급계약 구분")).alias("description"),
        either(("해지계약명", "계약내용", "해지내용상세"), ("체결내용", "체결계약명")).alias("detail"),
        amount.alias("contract_amount"),
        F.when(cancel, parse_korean_int(K.kv_get(p, "해지금액"))).alias("cancel_amount"),
        parse_korean_int(K.kv_get(p, "매출액(원)")).alias("recent_revenue"),
        parse_korean_float(K.kv_any(p, "매출액대비", "매출액 대비")).alias("revenue_ratio_pct"),
        F.when(has(large, "비해당", "해당없음"), F.lit(False)).when(has(large, "해당"), F.lit(True)).alias("is_large_corp"),
        K.kv_get(p, "계약상대").alias("counterparty"),
        K.kv_get(p, "회사와의 관계").alias("relationship"),
        F.when(~cancel, K.kv_any(p, "지역", "공급지역")).alias("region"),
        K.kv_get(p, "시작일").alias("period_start"),
        K.kv_get(p, "종료일").alias("period_end"),
        F.when(cancel, K.kv_any(p, "주요사유", "주요내용", "주요 내용")).alias("cancel_reason"),
        F.when(~cancel & (F.size(terms) > 0), F.map_from_entries(terms)).alias("conditions"),
        either(("해지일자",), ("수주)일자", "계약일자")).alias("event_date"),
        find_notes(p).alias("notes"),
        find_history(p).alias("history"),
    )


# -- preliminary results -------------------------------------------------------------------------

# --- fixed values: period captions and item words of result tables -----------------------------
_PERIODS = [
    ("당기실적", "당해실적"), ("전기실적", "전분기실적"), ("전년동기실적", "전년동기실적"),
    ("당기누계", "누적당해실적"), ("전년동기누적", "누적전년동기실적"),
]
_RESULT_ITEMS = ("매출액", "영업이익", "법인세비용", "당기순이익", "지배", "소유주지분")
_FORECAST_ITEMS = ("매출액", "영업이익", "법인세비용", "당기순이익")
_QUARTER_COLUMNS = [("당해실적", 0), ("전분기실적", 1), ("전분기대비증감율", 2), ("전년동기실적", 4), ("전년동기대비증감율", 5)]
_YTD_COLUMNS = [("당해실적", 0), ("전년동기실적", 4), ("전년동기대비증감율", 5)]


def preliminary_periods(parsed: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Periods of a preliminary result: name, start, end and the quarter label."""
    name = lambda t: _first_caption(t)
    rows = F.filter(at(F.col("texts"), 0), lambda r: (F.size(r) >= 4) & name(at(r, 0)).isNotNull())
    found = F.transform(
        rows, lambda r: F.struct(name(at(r, 0)).alias("period"), F.trim(at(r, 1)).alias("start"), F.trim(at(r, 3)).alias("end"))
    )
    out = parsed.select(*keys, F.explode(found).alias("_p")).select(*keys, "_p.*")
    single = F.col("period").isin("당해실적", "전분기실적", "전년동기실적")
    return out.withColumn("label", F.when(single, quarter_end_label("end")))


def _first_caption(t: Column) -> Column:
    out = None
    for words, name in _PERIODS:
        out = (F if out is None else out).when(has(t, words), F.lit(name))
    return out


def result_unit(rows: Column, order: Sequence[str], default: str) -> Column:
    """Unit of the first row that states one."""
    captions = F.filter(F.transform(rows, joined), lambda t: has(t, "단위"))

    def unit(t: Column) -> Column:
        out = F.lit(default)
        for label in reversed(order):
            out = F.when(has(t, label), F.lit(label)).otherwise(out)
        return out

    return let(at(captions, 0), unit)


def preliminary_records(parsed: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Long results: (item, basis, measure, value, note).

    An item row spans two rows; the row after it holds the cumulative figures. Columns count
    by position.
    """
    t = F.filter(at(F.col("tables"), 1), lambda r: F.size(r) > 0)
    step = parsed.select(*keys, F.col("heading"), t.alias("_t"))
    rows = F.transform(
        "_t",
        lambda r, i: F.struct(
            i.cast("int").alias("i"),
            C.row_texts(r).alias("r"),
            ((r[0]["rowspan"] >= 2) & has(r[0]["text"], *_RESULT_ITEMS)).alias("item"),
            ((r[0]["rowspan"] < 2) & (F.size(r) >= 2)).alias("cont"),
        ),
    )
    step = step.select(*keys, "heading", rows.alias("_r"), result_unit(F.transform("_t", C.row_texts), ("억원", "백만원", "천원"), "백만원").alias("unit"))

    step = pin(step)

    def last_before(flag: str, i: Column) -> Column:
        return F.array_max(F.transform(F.filter("_r", lambda x: x[flag] & (x["i"] < i)), lambda x: x["i"]))

    quarter = F.filter("_r", lambda x: x["item"] & (F.size(x["r"]) >= 3) & has(at(x["r"], 1), "당해"))
    ytd = F.filter(
        "_r",
        lambda x: x["cont"] & has(at(x["r"], 0), "누계", "누적")
        & (last_before("item", x["i"]) > F.coalesce(last_before("cont", x["i"]), F.lit(-1))),
    )

    def values(r: Column, shift: int, columns: list, item: Column, basis: str) -> Column:
        cells = []
        for measure, n in columns:
            raw = at(r, n + shift)
            number = parse_korean_float(raw) if measure.endswith("율") else parse_korean_int(raw).cast("double")
            cells.append(F.struct(item.alias("item"), F.lit(basis).alias("basis"), F.lit(measure).alias("measure"), number.alias("value"), F.lit(None).cast("string").alias("note")))
        turn = F.trim(at(r, 6 + shift))
        mark = F.when((turn != "") & (turn != "-"), turn)
        cells.append(F.struct(item.alias("item"), F.lit(basis).alias("basis"), F.lit("흑자적자전환").alias("measure"), F.lit(None).cast("double").alias("value"), mark.alias("note")))
        return F.array(*cells)

    q = F.flatten(
        F.transform(quarter, lambda x: let(canonical_item(at(x["r"], 0)), lambda item: values(x["r"], 2, _QUARTER_COLUMNS, item, "quarter")))
    )
    owner = lambda x: at(F.get(F.col("_r"), last_before("item", x["i"]))["r"], 0)
    y = F.flatten(
        F.transform(ytd, lambda x: let(canonical_item(owner(x)), lambda item: values(x["r"], 1, _YTD_COLUMNS, item, "cumulative")))
    )
    statement = F.when(has(F.col("heading"), "연결"), F.lit("연결")).otherwise(F.lit("별도"))
    out = step.select(*keys, statement.alias("statement_type"), "unit", F.explode(F.concat(q, y)).alias("_v"))
    return out.select(*keys, "statement_type", "unit", "_v.*").where(F.col("value").isNotNull() | F.col("note").isNotNull())


# -- forecasts -----------------------------------------------------------------------------------


def forecast_records(parsed: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Forecast years with period and items, long: (year, item, value)."""
    step = parsed.select(*keys, "heading", at(F.col("texts"), 0).alias("_t"))
    # the years stand in one of the first rows; a page with a longer head is searched row by row
    in_row = lambda r: F.filter(F.transform(r, lambda t: F.trim(t)), lambda t: t.rlike(r"^\d{4}$"))
    first = in_row(F.flatten(F.slice("_t", 1, 5)))
    later = F.get(F.filter(F.transform("_t", in_row), lambda y: F.size(y) > 0), F.lit(0))
    years = let(first, lambda y: F.when(F.size(y) > 0, y).otherwise(F.coalesce(later, y)))
    step = step.select(*keys, "heading", "_t", years.alias("_years"), result_unit(F.col("_t"), ("백만원", "억원", "천원"), "억원").alias("unit"))

    def dates(word: str) -> Column:
        rows = F.filter("_t", lambda r: has(joined(r), word) & (F.lit(word == "시작일") | ~has(joined(r), "시작일")))
        row = F.try_element_at(rows, F.lit(-1))
        return F.filter(F.transform(row, lambda t: F.trim(t)), lambda t: t.rlike(_DAY))

    items = F.filter(
        "_t", lambda r: ~has(joined(r), "시작일", "종료일") & (F.size(r) >= 2) & has(at(r, 0), *_FORECAST_ITEMS)
    )
    named = F.transform(
        items,
        lambda r: F.struct(
            canonical_item(at(r, 0)).alias("item"),
            F.transform(F.filter(F.slice(r, 2, F.size(r)), lambda t: ~F.trim(t).isin("", "년사업연도")), parse_korean_int).alias("values"),
        ),
    )
    # arrays first: beside a generator a select loses the field names of new structs
    out = step.select(
        *keys, "unit", dates("시작일").alias("_from"), dates("종료일").alias("_to"), named.alias("_items"), "_years"
    )
    out = out.select(*keys, "unit", "_from", "_to", "_items", F.posexplode("_years").alias("_n", "year"))
    out = out.select(
        *keys, "unit", F.col("year").cast("int").alias("year"), at(F.col("_from"), F.col("_n")).alias("period_start"),
        at(F.col("_to"), F.col("_n")).alias("period_end"), "_n", F.posexplode("_items").alias("_row", "_i"),
    )
    return out.select(
        *keys, "unit", "year", "period_start", "period_end", "_row", F.col("_i")["item"].alias("item"),
        at(F.col("_i")["values"], F.col("_n")).alias("value"),
    ).withColumnRenamed("_row", "row_no")


def forecast_deviation(parsed: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Earlier forecast against the outcome: (item, forecast, actual, deviation_pct)."""
    t = at(F.col("texts"), 1)
    period = lambda r: has(joined(r), "대상기간") | has(at(r, 0), "기간")
    span = F.filter(F.transform(F.try_element_at(F.filter(t, period), F.lit(-1)), lambda x: F.trim(x)), lambda x: x.rlike(_DAY))
    items = F.filter(t, lambda r: ~period(r) & has(at(r, 0), *_FORECAST_ITEMS))
    out = parsed.where(F.size(t) >= 3).select(*keys, at(span, 0).alias("period_start"), at(span, 1).alias("period_end"), F.explode(items).alias("_r"))
    r = F.col("_r")
    return out.select(
        *keys, "period_start", "period_end", canonical_item(at(r, 0)).alias("item"), parse_korean_int(at(r, 1)).alias("forecast"),
        parse_korean_int(at(r, 2)).alias("actual"), parse_korean_float(at(r, 3)).alias("deviation_pct"),
    )


def forecast_assumptions(parsed: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Stated basis of a forecast, from the numbered rows of its first table."""
    plain = F.filter(at(F.col("texts"), 0), lambda r: (F.size(r) >= 2) & (at(r, 0) != "") & ~has(at(r, 0), *_FORECAST_ITEMS))
    entries = F.transform(
        plain,
        lambda r: F.struct(
            F.trim(at(r, 0)).alias("key"), joined(F.filter(F.slice(r, 2, F.size(r)), lambda t: F.trim(t) != "")).alias("value")
        ),
    )
    step = parsed.select(*keys, K.kv_upsert(entries).alias("_p"))
    return step.select(*keys, K.kv_any(F.col("_p"), "근거", "구체적 근거", "전망 또는").alias("assumptions"), find_notes(F.col("_p")).alias("notes"))


def company_info(parsed: DataFrame, *, keys: Sequence[str], table: int = 0) -> DataFrame:
    """Company and business named in a table: the last telling cell of the captioned row."""
    rows = at(F.col("texts"), table)

    def value(words: Sequence[str], numbered: bool) -> Column:
        row = F.try_element_at(F.filter(rows, lambda r: has(joined(r), *words)), F.lit(-1))
        keep = lambda t: (t != "") & ~has(t, *words) & (F.lit(not numbered) | ~t.rlike(r"^\d+\."))
        return F.try_element_at(F.filter(F.transform(row, lambda t: F.trim(t)), keep), F.lit(-1))

    return parsed.select(
        *keys, value(("회사명", "해당회사"), True).alias("company"), value(("사업내용", "주요사업"), False).alias("business")
    )

"""Instruments and keyword passages from the notes to financial statements.

A page becomes an array of blocks (paragraphs and tables in page order). Sections are index
ranges between headings, sub-sections are circled numbers, and every table that describes an
instrument is exploded with its key/value pairs before fields are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import dates as D
from ..functions import numbers as N
from ..functions.text import choose, clip_at_break, let, squeeze, strip_tags, text_lines, upto
from ..operators.barrier import pin
from ..operators.predicates import text_says_inactive
from .cells import _ROW, PAIR_TYPE
from .exchange import at, has

_BLOCK = r"(?i)(<table\b[^>]*>(?:[^<]+|<(?!/table\s*>))*+</table\s*>|<p\b[^>]*>(?:[^<]+|<(?!/p\s*>))*+</p\s*>)"
_TOP = r"^\d+\.\s+\S"
_SUB = r"^\(\d+\)"
_CIRCLED = r"^[①-⑳㉑-㉟㊱-㊿]"

# --- fixed values: section headings (white space removed) --------------------------------------
SECTION_HEADINGS = {
    "CB": r"^\d+\.전환사채",
    "BW": r"^\d+\.신주인수권부사채",
    "전환우선주": r"\(\d+\)(?:전환우선주|상환전환우선주|전환상환우선주)",
    "SO": r"^\d+\.주식기준보상",
}
_FACE_KEYS = ("발행총액", "권면총액", "총발행", "총액")
_PRICE_KEYS = ("전환가격", "전환가액", "행사가격", "행사가액", "발행가액")
_PRICE_KEYS_BW = ("행사가격", "행사가액", "전환가격", "전환가액", "발행가액")
_SHARE_KEYS = ("전환에따라발행할주식수", "전환시전환주식수", "행사시발행주식수")
_PERIOD_KEYS = ("전환청구기간", "행사기간", "신주인수권행사기간", "행사가능기간")


def note_blocks(docs: DataFrame, *, keys: Sequence[str], html: str = "html", table_text: bool = True) -> DataFrame:
    """(keys, blocks): ``{is_table, text, html}`` in page order; without ``table_text`` only paragraphs have a text."""
    raw = F.regexp_extract_all(html, F.lit(_BLOCK), F.lit(1))

    def block(b: Column) -> Column:
        is_table, text = F.lower(F.substring(b, 2, 5)).startswith("table"), F.trim(strip_tags(b))
        return F.struct(
            is_table.alias("is_table"),
            (text if table_text else choose(is_table, F.lit(None).cast("string"), text)).alias("text"),
            b.alias("html"),
        )

    blocks = F.transform(raw, block)
    return pin(docs.select(*keys, blocks.alias("blocks")))


_ROW_END, _NEXT = "/[tT][rR]", r"[tT][dDhH]\b"


def _cells_of(kind: str) -> str:
    return rf"<{kind}\b([^>]*>{upto(rf'/{kind}\s*>', _NEXT, _ROW_END)})(?:</{kind}\s*>|(?=<{_NEXT})|(?=<{_ROW_END})|$)"


_TD, _ANY, _TR = _cells_of("[tT][dD]"), _cells_of("[tT][dDhH]"), _ROW


def _rows(table: Column, cell: str) -> Column:
    """Rows of cells ``{text, span}``; line breaks inside a cell stay."""
    return F.transform(
        F.regexp_extract_all(table, F.lit(_TR), F.lit(1)),
        lambda tr: F.transform(
            F.regexp_extract_all(tr, F.lit(cell), F.lit(1)),
            lambda c: F.struct(
                text_lines(F.substring(c, F.instr(c, ">") + 1, F.length(c))).alias("text"),
                # a tag that is too short for a span is not searched
                choose(F.instr(c, ">") < 9, F.lit(1), _stated_span(c)).alias("span"),
            ),
        ),
    )


def _stated_span(c: Column) -> Column:
    found = F.coalesce(F.regexp_extract(c, r"(?is)^[^>]*rowspan\s*=\s*[\"']?(\d+)", 1).try_cast("int"), F.lit(1))
    return choose(F.contains(F.lower(F.substring_index(c, ">", 1)), F.lit("rowspan")), found, F.lit(1))


def _label(c: Column) -> Column:
    return let(squeeze(c), lambda t: choose(F.contains(t, F.lit("(*")), F.regexp_replace(t, r"\(\*\d+\)", ""), t))


def join_pairs(entries: Column) -> Column:
    """Values of one key joined by line ends, keys in order of first sight."""

    def put(acc: Column, e: Column) -> Column:
        known = F.exists(acc, lambda q: q["key"] == e["key"])
        grown = F.transform(
            acc,
            lambda q: F.when(
                q["key"] == e["key"],
                F.struct(q["key"].alias("key"), F.concat(q["value"], F.lit("\n"), e["value"]).alias("value")),
            ).otherwise(q),
        )
        return F.when(known, grown).otherwise(F.concat(acc, F.array(e)))

    return F.aggregate(entries, F.array().cast(PAIR_TYPE), put)


def span_entries(rows: Column) -> Column:
    """Key/value entries of a note table; a label reaches over the rows of its span."""
    return F.transform(
        rows,
        lambda r, i: F.when(
            F.size(r) >= 2, F.struct(_label(r[0]["text"]).alias("key"), r[1]["text"].alias("value"))
        ).otherwise(
            F.struct(
                _label(
                    F.try_element_at(
                        F.filter(rows, lambda q, j: (j < i) & (F.size(q) >= 2) & (i - j < q[0]["span"])), F.lit(-1)
                    )[0]["text"]
                ).alias("key"),
                r[0]["text"].alias("value"),
            )
        ),
    )


def column_entries(rows: Column, column: Column, first_row: Column) -> Column:
    """Key/value entries of one series column."""
    return F.transform(
        F.filter(rows, lambda r, i: (i >= first_row) & (F.size(r) > column)),
        lambda r: F.struct(_label(r[0]["text"]).alias("key"), F.get(r, column)["text"].alias("value")),
    )


def _holding(pairs: Column, fragment: str, usable=None) -> Column:
    """Pairs whose key holds the fragment."""
    return F.filter(pairs, lambda p: has(p["key"], fragment) & (usable(fragment, p["key"]) if usable else F.lit(True)))


def _values(pairs: Column, fragments: Sequence[str], read, usable=None) -> Column:
    """First usable reading: fragments in order, then keys in order."""
    tries = [F.transform(_holding(pairs, f, usable), lambda p: read(p["value"])) for f in fragments]
    return at(F.filter(F.concat(*tries), lambda v: v.isNotNull()), 0)


def _exact(pairs: Column, key: str) -> Column:
    return at(F.filter(pairs, lambda p: p["key"] == key), 0)["value"]


def _pair_value(pairs: Column, *keys: str) -> Column:
    """Value of the first exact key that is there."""
    return F.coalesce(*(_exact(pairs, k) for k in keys))


_RANGE = (
    r"(?s)(\d{4})\s*[년.\-/]\s*(\d{1,2})\s*[월.\-/]\s*(\d{1,2})\s*일?.*?"
    r"(\d{4})\s*[년.\-/]\s*(\d{1,2})\s*[월.\-/]\s*(\d{1,2})"
)


def _dotted(y: Column, m: Column, d: Column) -> Column:
    return F.when(y != "", F.concat_ws(".", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def _range(t: Column, pattern: str = _RANGE) -> Column:
    g = lambda i: F.regexp_extract(t, pattern, i)
    return F.when(
        g(1) != "", F.struct(_dotted(g(1), g(2), g(3)).alias("start"), _dotted(g(4), g(5), g(6)).alias("end"))
    )


def _positive(c: Column) -> Column:
    return F.nullif(N.extract_amount(c), F.lit(0))


def _credible(c: Column) -> Column:
    """A price below par is a reading error."""
    n = N.extract_amount(c)
    return F.when(n >= 100, n)


def _fit_price(fragment: str, key: Column) -> Column:
    """An issue price per share or in total is no conversion price."""
    return ~has(key, "총", "1주당", "주당") if fragment == "발행가액" else F.lit(True)


def _day(c: Column) -> Column:
    return D.parse_any_date(F.regexp_extract(c, r"(\d{4}\s*[년.\-/]\s*\d{1,2}\s*[월.\-/]\s*\d{1,2})", 1), compact=False)


def read_fields(candidates: DataFrame) -> DataFrame:
    """Face value, price, shares and period from the ``pairs`` of candidate instruments."""
    p, bw = F.col("pairs"), F.col("category") == "BW"
    # texts first, each picked once; numbers are read from them afterwards
    texts = {
        "_face_text": _values(p, _FACE_KEYS, lambda v: v),
        "_about": F.coalesce(_pair_value(p, "전환에관한사항", "신주인수권에관한사항"), F.lit("")),
        "_period_text": _values(p, _PERIOD_KEYS, lambda v: v),
        "_range": _values(p, _PERIOD_KEYS, _range),
        "_issued": _values(p, ("발행일",), _day),
        "_matures": _values(p, ("만기일",), _day),
        "_price": F.when(bw, _values(p, _PRICE_KEYS_BW, _credible, _fit_price)).otherwise(_values(p, _PRICE_KEYS, _credible, _fit_price)),
        "_shares": _values(p, _SHARE_KEYS, _positive),
    }
    candidates = pin(candidates.withColumns(texts))
    word = F.when(bw, F.regexp_extract("_about", r"(?s)(행사가격[^:：]*[:：].*)", 1)).otherwise(
        F.regexp_extract("_about", r"(?s)(전환가격[^:：]*[:：].*)", 1)
    )
    price = F.coalesce("_price", _credible(F.regexp_extract(word, r"^[^:：]*[:：]\s*([\d,]+)\s*원", 1)))
    face = N.extract_amount_with_unit("_face_text")
    shares = F.col("_shares")
    inline = _range(
        F.when(bw, F.regexp_extract("_about", r"(?s)((?:행사기간|신주인수권행사기간)[^:：]*[:：].*)", 1)).otherwise(
            F.regexp_extract("_about", r"(?s)(전환청구가능기간[^:：]*[:：].*)", 1)
        )
    )
    rel_start, rel_end = D.relative_period("_period_text", F.col("_issued"), F.col("_matures"))
    dot = lambda d: F.date_format(d, "yyyy.MM.dd")
    period = F.coalesce("_range", F.when(rel_start.isNotNull(), F.struct(dot(rel_start).alias("start"), dot(rel_end).alias("end"))), inline)
    out = candidates.withColumns({"_face": face, "_price": price, "_shares": shares, "_period": period})
    out = pin(out)
    derived = F.when(
        F.col("derive") & F.col("_shares").isNull() & (F.col("_face") > 0) & (F.col("_price") >= 100),
        N.floor_div(F.col("_face"), F.col("_price")),
    )
    return out.withColumns(
        {
            "face_value": F.coalesce("_face", F.lit(0).cast("bigint")),
            "conversion_price": F.coalesce("_price", F.lit(0).cast("bigint")),
            "convertible_shares": F.coalesce("_shares", derived, F.lit(0).cast("bigint")),
            "exercise_start": F.coalesce(F.col("_period")["start"], F.lit("")),
            "exercise_end": F.coalesce(F.col("_period")["end"], F.lit("")),
        }
    )


def _marks() -> Column:
    """Per block what its text says: which heading, sub-section or circled number it is; NULL for tables."""

    def marks(b: Column) -> Column:
        text = b["text"]
        own = {"inner": r"\(\d+\)\s*.*전환사채", "top": _TOP, "sub": _SUB, "circled": _CIRCLED}
        return let(
            squeeze(text),
            lambda bare: F.struct(
                *(bare.rlike(p).alias(c) for c, p in SECTION_HEADINGS.items()), *(text.rlike(p).alias(n) for n, p in own.items())
            ),
        )

    return F.transform("blocks", lambda b: choose(b["is_table"], F.lit(None), marks(b)))


def _sections(blocks: DataFrame) -> DataFrame:
    """Adds ``_marks`` and the sections of a page, ``{category, a, b}`` as block ranges.

    Bond pages without a section of their own may describe bonds under a ``(N) … 전환사채``
    heading elsewhere; such a sub-section is marked ``embedded``.
    """

    def first(mark: str) -> Column:
        return F.array_min(F.transform("_marks", lambda m, i: F.when(m[mark], i.cast("int"))))

    def until(start: Column, *marks: str) -> Column:
        ends = lambda m: F.greatest(*(m[x] for x in marks)) if len(marks) > 1 else m[marks[0]]
        after = F.array_min(F.transform("_marks", lambda m, i: F.when((i > start) & ends(m), i.cast("int"))))
        return F.coalesce(after, F.size("blocks"))

    def section(category: str, start: Column, end: Column, embedded: bool) -> Column:
        return F.struct(F.lit(category).alias("category"), start.alias("a"), end.alias("b"), F.lit(embedded).alias("embedded"))

    categories = [c for c in SECTION_HEADINGS if c != "SO"]
    step = pin(blocks.withColumn("_marks", _marks()))
    step = pin(step.withColumns({f"_at_{n}": first(c) for n, c in enumerate(categories)} | {"_inner": F.when(first("CB").isNull(), first("inner"))}))
    out = [section(c, F.col(f"_at_{n}"), until(F.col(f"_at_{n}"), "top"), False) for n, c in enumerate(categories)]
    out.append(section("CB", F.col("_inner"), until(F.col("_inner"), "sub", "top"), True))
    return step.withColumn("_secs", F.filter(F.array(*out), lambda s: s["a"].isNotNull()))


def _footnote(table_at: Column, stop: Column) -> Column:
    """Paragraphs after a table up to the next table, sub-section or section."""
    blocks = F.col("blocks")
    end = F.array_min(
        F.transform("_marks", lambda m, i: F.when((i > table_at) & (m.isNull() | m["circled"] | m["top"]), i.cast("int")))
    )
    bound = F.least(F.coalesce(end, F.size(blocks)), stop)
    inside = lambda e: F.filter(blocks, lambda b, i: (i > table_at) & (i < e))
    return let(bound, lambda e: F.array_join(F.transform(inside(e), lambda b: b["text"]), "\n"))


def _candidates() -> Column:
    """Instruments of the section in ``_sec``.

    Sub-sections under circled numbers own the next table. Without them the first table with
    one column per series is split into its columns, else the first table is one instrument.
    """
    blocks, sec = F.col("blocks"), F.col("_sec")
    bond = sec["category"] != "전환우선주"
    bond_title = r"^[①②③④⑤⑥⑦⑧⑨⑩]\s*(제\s*(\d+)\s*회.+)"
    share_title = r"^[①②③④⑤⑥⑦⑧⑨⑩]\s*(.*(?:전환우선주|상환전환).*)"
    within = lambda i: (i > sec["a"]) & (i < sec["b"])
    no_column = F.lit(None).cast("int")

    def sub(b: Column, i: Column) -> Column:
        nxt = F.array_min(F.transform("_marks", lambda m, j: F.when((j > i) & (m.isNull() | m["circled"]), j.cast("int"))))
        kind = F.when(bond, F.regexp_extract(b["text"], bond_title, 1)).otherwise(F.regexp_extract(b["text"], share_title, 1))
        series = F.when(bond, F.regexp_extract(b["text"], bond_title, 2).try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        found = F.struct(
            series.alias("series"), F.trim(kind).alias("kind"), nxt.alias("table_at"), no_column.alias("column"),
            F.lit(0).alias("first_row"), F.lit(True).alias("titled"),
        )
        return F.when(within(i) & ~b["is_table"] & (kind != "") & F.get(blocks, nxt)["is_table"], found)

    subs = F.filter(F.transform(blocks, sub), lambda x: x.isNotNull())

    def columns(t: Column) -> Column:
        rows = t["rows"]
        caption = squeeze(rows[0][0]["text"]) == "구분"
        wide0 = caption & (F.size(rows[0]) > 2)
        wide1 = caption & (F.size(F.get(rows, F.lit(1))) > 2)
        head = F.when(wide0, rows[0]).when(wide1, F.get(rows, F.lit(1)))
        cols = F.transform(
            head,
            lambda c, j: F.struct(
                F.regexp_extract(c["text"], r"(?:제\s*)?(\d+)\s*회", 1).try_cast("bigint").alias("series"), F.trim(c["text"]).alias("kind"),
                t["i"].alias("table_at"), j.cast("int").alias("column"), F.when(wide0, 1).otherwise(2).alias("first_row"), F.lit(False).alias("titled"),
            ),
        )
        return F.when(F.size(rows) >= 3, F.filter(cols, lambda c: (c["column"] > 0) & c["series"].isNotNull()))

    tables = F.col("_tables")
    split = F.when(bond, at(F.filter(F.transform(tables, columns), lambda x: F.size(x) > 0), 0))
    first = at(tables, 0)
    named = at(F.filter(F.transform(first["rows"][0], lambda c: c["text"]), lambda t: t.rlike(r"(?:제\s*)?\d+\s*회")), 0)
    heading = F.regexp_replace(F.get(blocks, sec["a"])["text"], r"^\(\d+\)\s*", "")
    whole = F.array(
        F.struct(
            F.when(bond, F.coalesce(F.regexp_extract(named, r"(?:제\s*)?(\d+)\s*회", 1).try_cast("bigint"), F.lit(1).cast("bigint"))).otherwise(F.lit(0).cast("bigint")).alias("series"),
            F.when(bond, F.coalesce(F.trim(named), F.lit(""))).otherwise(heading).alias("kind"),
            first["i"].alias("table_at"), no_column.alias("column"), F.lit(0).alias("first_row"), F.lit(False).alias("titled"),
        )
    )
    return F.when(F.size(subs) > 0, subs).otherwise(F.coalesce(split, F.when(first.isNotNull(), whole)))


def section_instruments(blocks: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Bonds and convertible preferred stock of all sections of all pages."""
    step = pin(_sections(blocks)).select(*keys, "blocks", "_marks", F.explode("_secs").alias("_sec"))
    sec = F.col("_sec")
    inside = F.filter(
        F.transform("blocks", lambda b, i: F.struct(i.cast("int").alias("i"), b["is_table"].alias("is_table"), b["html"].alias("html"))),
        lambda b: b["is_table"] & (b["i"] > sec["a"]) & (b["i"] < sec["b"]),
    )
    step = pin(step.withColumn("_tables", F.transform(inside, lambda t: F.struct(t["i"].alias("i"), _rows(t["html"], _ANY).alias("rows")))))
    step = pin(step.withColumn("_found", _candidates())).select(*keys, "blocks", "_marks", "_sec", F.explode("_found").alias("_c"))
    c = F.col("_c")
    html = F.get("blocks", c["table_at"])["html"]
    step = step.withColumns(
        {
            "_rows": F.filter(F.when(c["column"].isNull(), _rows(html, _TD)).otherwise(_rows(html, _ANY)), lambda r: F.size(r) > 0),
            "_inactive": text_says_inactive(_footnote(c["table_at"], F.col("_sec")["b"])),
        }
    )
    step = pin(step)
    entries = F.when(c["column"].isNull(), span_entries(F.col("_rows"))).otherwise(
        column_entries(F.col("_rows"), c["column"], c["first_row"])
    )
    category = F.col("_sec")["category"]
    bond = category != "전환우선주"
    cand = step.select(
        *keys, category.alias("category"), F.col("_sec")["embedded"].alias("embedded"), c["series"].alias("series"), c["kind"].alias("kind"),
        c["titled"].alias("titled"), (bond & ~c["titled"]).alias("derive"),
        # a series column carries no footnote of its own
        (c["column"].isNotNull() | ~F.coalesce("_inactive", F.lit(False))).alias("active"),
        F.filter(entries, lambda e: F.coalesce(e["key"], F.lit("")) != "").alias("_e"),
    )
    cand = pin(cand.withColumn("pairs", join_pairs(F.col("_e")))).where(F.size("pairs") > 0)
    out = _preferred_terms(read_fields(cand))
    # a bond inside another section names its series in the caption row
    p = F.col("pairs")
    out = out.withColumn("_caption", F.when(F.col("embedded") & (F.col("kind") == ""), F.trim(_values(p, ("구분",), lambda v: v))))
    named = F.regexp_extract("_caption", r"(\d+)\s*회", 1).try_cast("bigint")
    out = out.withColumns({"series": F.coalesce(named, "series"), "kind": F.coalesce("_caption", "kind")})
    empty = ~F.col("titled") & (F.col("face_value") == 0) & (F.col("convertible_shares") == 0)
    return _shape(pin(out).where(~empty), keys)


def _preferred_terms(records: DataFrame) -> DataFrame:
    """Preferred stock: shares and price follow the conversion ratio, the period the issue date."""
    p, share = F.col("pairs"), F.col("category") == "전환우선주"
    fit = lambda f, key: has(key, "발행", "금액", "가액")
    step = pin(records).withColumns(
        {
            "_count": F.when(share, _values(p, ("발행주식수", "발행수량"), _positive)),
            "_each": F.when(share, _values(p, ("1주당",), _positive, fit)),
            "_total": F.when(share, _values(p, ("총발행가액",), _positive)),
            "_terms": F.when(share, _values(p, ("전환조건", "전환비율"), lambda v: v)),
            "_when": F.when(share, _values(p, ("전환기간", "전환청구기간", "행사가능기간"), lambda v: v)),
            "_dates": F.when(share, _values(p, ("전환청구기간", "전환기간", "행사가능기간"), _range)),
        }
    )
    step = pin(step).withColumn("_ratio", N.conversion_ratio(F.coalesce("_terms", F.lit(""))))
    start, end = D.preferred_period("_when", F.col("_issued"))
    dot = lambda d: F.date_format(d, "yyyy.MM.dd")
    price = F.coalesce(F.nullif(F.col("conversion_price"), F.lit(0)), N.price_after_ratio("_each", F.col("_ratio")), F.lit(0).cast("bigint"))
    step = step.withColumns(
        {
            "face_value": F.coalesce("_total", "face_value"),
            "conversion_price": F.when(share, price).otherwise(F.col("conversion_price")),
            "exercise_start": F.coalesce(F.col("_dates")["start"], F.when(share, dot(start)), F.col("exercise_start")),
            "exercise_end": F.coalesce(F.col("_dates")["end"], F.when(share, dot(end)), F.col("exercise_end")),
        }
    )
    shares = F.coalesce(N.shares_after_ratio("_count", F.col("_ratio")), N.floor_div(F.col("face_value"), F.col("conversion_price")), F.lit(0).cast("bigint"))
    return step.withColumn("convertible_shares", F.when(share, shares).otherwise(F.col("convertible_shares")))


def option_instruments(blocks: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Stock options: rows of grant tables with shares left, columns found by caption."""
    start = F.array_min(F.transform("blocks", lambda b, i: F.when(~b["is_table"] & squeeze(b["text"]).rlike(SECTION_HEADINGS["SO"]), i.cast("int"))))
    stop = F.array_min(F.transform("blocks", lambda b, i: F.when((i > F.col("_a")) & ~b["is_table"] & b["text"].rlike(_TOP), i.cast("int"))))
    step = pin(blocks.withColumn("_a", start)).where(F.col("_a").isNotNull()).withColumn("_b", F.coalesce(stop, F.size("blocks")))
    tables = F.filter(F.transform("blocks", lambda b, i: F.when(b["is_table"] & (i > F.col("_a")) & (i < F.col("_b")), b["html"])), lambda x: x.isNotNull())
    step = pin(step.select(*keys, tables.alias("_tables"))).select(*keys, F.posexplode("_tables").alias("table_no", "_h"))
    texts = F.transform(_rows(F.col("_h"), _ANY), lambda r: F.transform(r, lambda c: c["text"]))
    step = pin(step.select(*keys, "table_no", texts.alias("_t")))
    head = F.transform(at(F.col("_t"), 0), squeeze)

    def kind(h: Column) -> Column:
        return (
            F.when(has(h, "행사가격", "행사가액"), F.lit("price")).when(has(h, "잔여", "미행사"), F.lit("left"))
            .when(has(h, "부여수량", "부여주식"), F.lit("granted")).when(has(h, "행사기간"), F.lit("period"))
            .when(has(h, "구분", "차수"), F.lit("series"))
        )

    col_of = lambda name: F.array_max(F.transform(head, lambda h, i: F.when(kind(h) == name, i.cast("int"))))
    step = step.withColumns({f"_{n}": col_of(n) for n in ("price", "left", "granted", "period", "series")})
    step = step.where((F.coalesce("_price", F.lit(0)) > 0) | (F.coalesce("_left", F.lit(0)) > 0))
    need = F.greatest(*(F.coalesce(f"_{n}", F.lit(0)) for n in ("price", "left", "granted", "period", "series")))
    rows = step.withColumn("_need", need).select(
        *keys, "_price", "_left", "_granted", "_period", "_series", "_need",
        F.posexplode(F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0)))).alias("row_no", "_r"),
    )
    r = F.col("_r")
    first = squeeze(at(r, 0))
    rows = rows.where((F.size(r) > F.col("_need")) & ~first.isin("", "합계", "계", "총계"))
    cell = lambda n: F.get(r, F.col(n))
    series = F.coalesce(F.regexp_extract(cell("_series"), r"(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    left = F.when(F.col("_left").isNotNull(), N.extract_amount(cell("_left"))).otherwise(N.extract_amount(cell("_granted")))
    period = _range(cell("_period"))
    out = rows.select(
        *keys, F.lit("SO").alias("category"), series.alias("series"), F.lit(0).cast("bigint").alias("face_value"), left.alias("convertible_shares"),
        F.coalesce(N.extract_amount(cell("_price")), F.lit(0).cast("bigint")).alias("conversion_price"),
        F.coalesce(period["start"], F.lit("")).alias("exercise_start"), F.coalesce(period["end"], F.lit("")).alias("exercise_end"), F.lit(True).alias("active"),
    ).where(F.col("convertible_shares") > 0)
    name = F.when(F.col("series") != 0, F.concat(F.lit("주식매수선택권 "), F.col("series").cast("string"), F.lit("차"))).otherwise(F.lit("주식매수선택권"))
    return _shape(out.withColumn("kind", name), keys)


_FIELDS = ["category", "series", "kind", "face_value", "convertible_shares", "conversion_price", "exercise_start", "exercise_end", "active"]


def _shape(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, *_FIELDS)


def notes_instruments(docs: DataFrame, *, keys: Sequence[str], html: str = "html") -> DataFrame:
    """All instruments of the notes of every document, with their ``active`` mark."""
    blocks = note_blocks(docs, keys=keys, html=html, table_text=False)
    return section_instruments(blocks, keys=keys).unionByName(option_instruments(blocks, keys=keys))


# -- keyword passages ----------------------------------------------------------------------------

BREAK = "<!-- section break -->"
_ATTRIBUTES = r'\s+(?:style|class|width|height|align|valign|bgcolor|border|cellpadding|cellspacing|rowspan|colspan)="[^"]*"'


_TO_TOP, _TO_HEADING, _TO_PARAGRAPH = 1, 2, 3  # what ends a passage


def keyword_context(docs: DataFrame, *, keys: Sequence[str], html: str = "html", limit: int | None = None, reach: int | None = None) -> DataFrame:
    """Passages that mention a dilution keyword, joined with break marks.

    A section heading takes its section, a sub-heading its sub-section, a mention in running
    text what follows up to the next heading, or ``reach`` paragraphs; tables with a keyword that
    no passage covers come with the paragraph before them. ``limit`` cuts the result at a break.

    One fold over the blocks of a page notes where passages begin and end; their blocks are then
    cut out by place, so the work grows with the page, not with its mentions.
    """
    words = "|".join(lx.OVERHANG_KEYWORDS)
    step = note_blocks(docs, keys=keys, html=html)
    bare = lambda b: squeeze(b["text"])
    sub = lambda b: b["text"].rlike(_SUB)
    until = lambda b: F.when(bare(b).rlike(r"^\d+\."), _TO_TOP).when(sub(b) | F.lit(reach is None), _TO_HEADING).otherwise(_TO_PARAGRAPH)
    marked = F.transform(
        "blocks",
        lambda b, i: F.struct(
            i.cast("int").alias("i"), b["is_table"].alias("is_table"), b["text"].alias("text"), b["html"].alias("html"), bare(b).rlike(words).alias("hit"),
            (~b["is_table"] & b["text"].rlike(_TOP)).alias("top"), (~b["is_table"] & sub(b)).alias("sub"), until(b).alias("until"),
        ),
    )
    step = step.select(*keys, marked.alias("_m")).withColumn("_f", _passages(F.col("_m"), reach))
    last = F.when(F.col("_f")["a"].isNotNull(), F.array(F.struct(F.col("_f")["a"].alias("a"), F.size("_m").alias("b")))).otherwise(F.array().cast(_RANGES))
    cut_out = lambda r: F.array_join(F.transform(F.slice("_m", r["a"] + 1, r["b"] - r["a"]), lambda m: m["html"]), "\n")

    def with_header(t: Column) -> Column:
        header = F.concat(F.lit("<p>"), F.get("_m", t["p"])["text"], F.lit("</p>\n"))
        return F.concat(F.coalesce(header, F.lit("")), F.get("_m", t["i"])["html"])

    parts = F.concat(F.transform(F.concat(F.col("_f")["ranges"], last), cut_out), F.transform(F.col("_f")["tables"], with_header))
    text = F.regexp_replace(F.array_join(parts, f"\n\n{BREAK}\n\n"), _ATTRIBUTES, "")
    return step.select(*keys, F.size(parts).alias("n_passages"), (text if limit is None else clip_at_break(text, limit, BREAK)).alias("context"))


_RANGES, _TABLES = "array<struct<a:int,b:int>>", "array<struct<i:int,p:int>>"


def _passages(blocks: Column, reach: int | None) -> Column:
    """(a, until, left, p, ranges, tables) after the last block.

    ``a`` is the first block of an open passage, ``until`` what ends it, ``left`` the paragraphs it
    still takes, ``p`` the last paragraph; ``ranges`` are the closed passages, ``tables`` the tables
    with a keyword outside of them, each with the paragraph before.
    """
    none = F.lit(None).cast("int")
    start = F.struct(
        none.alias("a"), none.alias("until"), none.alias("left"), none.alias("p"), F.array().cast(_RANGES).alias("ranges"), F.array().cast(_TABLES).alias("tables")
    )

    def step(s: Column, m: Column) -> Column:
        left = F.when(m["is_table"], s["left"]).otherwise(s["left"] - 1)
        ends = s["a"].isNotNull() & (
            ((s["until"] == _TO_TOP) & m["top"]) | ((s["until"] == _TO_HEADING) & (m["top"] | m["sub"])) | ((s["until"] == _TO_PARAGRAPH) & ~m["is_table"] & (left < 0))
        )
        free = s["a"].isNull() | ends
        opens = free & m["hit"] & ~m["is_table"]
        alone = free & m["hit"] & m["is_table"]
        closed = F.array(F.struct(s["a"].alias("a"), m["i"].alias("b")))
        found = F.array(F.struct(m["i"].alias("i"), s["p"].alias("p")))
        return F.struct(
            F.when(opens, m["i"]).when(~ends, s["a"]).alias("a"), F.when(opens, m["until"]).otherwise(s["until"]).alias("until"),
            F.when(opens, F.lit((reach or 0) - 1)).otherwise(left).alias("left"), F.when(m["is_table"], s["p"]).otherwise(m["i"]).alias("p"),
            F.when(ends, F.concat(s["ranges"], closed)).otherwise(s["ranges"]).alias("ranges"), F.when(alone, F.concat(s["tables"], found)).otherwise(s["tables"]).alias("tables"),
        )

    return F.aggregate(blocks, start, step)

"""Filters and classifiers; all are per-row expressions unless a function says otherwise."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.dates import parse_any_date
from ..functions.numbers import amount_of
from ..functions.text import squeeze


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_keyword(c: Column | str, words: Sequence[str], ci: bool = True) -> Column:
    """Text holds any of the literal words."""
    quoted = "|".join(re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", w) for w in words)
    return _col(c).rlike(("(?iu)" if ci else "") + f"(?:{quoted})")


def classify_first_match(title: Column | str, rules: Sequence[tuple[str, str]] = tuple(lx.TITLE_RULES), default: str = "unknown") -> Column:
    """Label of the first rule whose words occur; white space is ignored on both sides."""
    bare = squeeze(title)
    out = None
    for words, label in rules:
        out = (F if out is None else out).when(F.contains(bare, F.lit("".join(words.split()))), F.lit(label))
    return out.otherwise(F.lit(default))


def _has(c: Column, *words: str) -> Column:
    out = F.contains(c, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(c, F.lit(w))
    return out


def classify_heading(heading: Column | str, sample: Column | None = None) -> Column:
    """Route an exchange disclosure by its heading, else by the rows of its first table.

    ``sample`` is the text of each row, in order; the first row that says something decides.
    """
    h = _col(heading)
    by_heading = (
        F.when(_has(h, "가액의조정", "가액의 조정", "조정(안내공문)"), F.lit("price_adj"))
        .when(_has(h, "행사", "잔액변경"), F.lit("exercise"))
        .when(_has(h, "조정"), F.lit("price_adj"))
        .when(_has(h, "계약체결", "계약해지", "수주계약"), F.lit("backlog"))
        .when(_has(h, "잠정") & _has(h, "실적", "영업"), F.lit("preliminary"))
        .when(_has(h, "전망"), F.lit("forecast"))
        .when(_has(h, "매출액또는손익", "손익구조"), F.lit("sales"))
    )
    if sample is None:
        return F.coalesce(by_heading, F.lit("unknown"))

    def by_row(t: Column) -> Column:
        return (
            F.when(_has(t, "해지금액", "해지일자", "계약금액"), F.lit("backlog"))
            .when(_has(t, "조정전") & _has(t, "조정후"), F.lit("price_adj"))
            .when(_has(t, "청구일자", "행사일자", "미잔액", "전환가능주식수"), F.lit("exercise"))
            .when(_has(t, "매출액") & _has(t, "손익"), F.lit("sales"))
        )

    hits = F.filter(F.transform(sample, by_row), lambda x: x.isNotNull())
    return F.coalesce(by_heading, F.get(hits, F.lit(0)), F.lit("unknown"))


def exercise_subtype(heading: Column | str) -> Column:
    """Six exercise labels; the combined form is tested before its parts."""
    h = _col(heading)
    return (
        F.when(_has(h, "주식매수선택권"), F.lit("주식매수선택권행사"))
        .when(_has(h, "신주인수권") & _has(h, "전환") & _has(h, "교환"), F.lit("전환청구권ㆍ신주인수권ㆍ교환청구권행사"))
        .when(_has(h, "신주인수권"), F.lit("신주인수권행사"))
        .when(_has(h, "전환주식") & _has(h, "전환청구권"), F.lit("전환주식의전환청구권행사"))
        .when(_has(h, "전환청구권"), F.lit("전환청구권행사"))
        .otherwise(F.lit("행사"))
    )


def price_adj_subtype(heading: Column | str) -> Column:
    """Five price-adjustment labels; the combined form is tested before its parts."""
    h = _col(heading)
    return (
        F.when(_has(h, "교환가액") & _has(h, "전환") & _has(h, "신주인수권"), F.lit("전환가액ㆍ신주인수권행사가액ㆍ교환가액의조정"))
        .when(_has(h, "신주인수권행사가액") | (_has(h, "신주인수권") & _has(h, "조정")), F.lit("신주인수권행사가액의조정"))
        .when(_has(h, "전환주식") & _has(h, "전환가액"), F.lit("전환주식의전환가액조정"))
        .when(_has(h, "전환가액"), F.lit("전환가액의조정"))
        .otherwise(F.lit("가액조정"))
    )


def infer_bond_category(kind: Column | str) -> Column:
    """NULL for exchangeable bonds (no dilution), else CB or BW; CB when the kind is silent."""
    k = F.coalesce(_col(kind), F.lit(""))
    return (
        F.when(_has(k, "교환"), F.lit(None).cast("string"))
        .when(_has(k, "전환"), F.lit("CB"))
        .when(_has(k, "신주인수권"), F.lit("BW"))
        .otherwise(F.lit("CB"))
    )


def category_of_exercise(exercise_type: Column | str) -> Column:
    return F.when(_has(_col(exercise_type), "신주인수권"), F.lit("BW")).otherwise(F.lit("CB"))


def prefer_currency(lines: DataFrame, *, keys: Sequence[str], currency: str = "currency", amounts: Sequence[str] = ("amount",), home: str = "KRW") -> DataFrame:
    """Home-currency rows of a filing if any has a non-zero amount; else everything when the
    filing has exactly one currency and a non-zero amount; else nothing. One filing is one
    bounded window, and later steps on the same keys reuse its partitioning."""
    nonzero = F.lit(False)
    for a in amounts:
        v = amount_of(lines, a)
        nonzero = nonzero | F.coalesce(v != 0, F.lit(False))
    w = Window.partitionBy(*keys)
    is_home = F.col(currency) == home
    flagged = lines.select(
        "*",
        F.max(is_home & nonzero).over(w).alias("_home"),
        F.max(nonzero).over(w).alias("_any"),
        (F.min(currency).over(w) == F.max(currency).over(w)).alias("_single"),
    )
    keep = F.when(F.col("_home"), is_home).otherwise(F.col("_any") & F.col("_single"))
    return flagged.where(keep).drop("_home", "_any", "_single")


def first_present_column(df: DataFrame, candidates: Sequence[str], fallback: str = "string") -> str:
    """Name of the first candidate the frame has; else its first string or last numeric column.

    Reads the schema only.
    """
    for c in candidates:
        if c in df.columns:
            return c
    if fallback == "string":
        texts = [n for n, t in df.dtypes if t == "string"]
        return texts[0] if texts else df.columns[0]
    numbers = [n for n, t in df.dtypes if t in ("int", "bigint", "double", "float") or t.startswith("decimal")]
    return numbers[-1] if numbers else df.columns[-1]


def is_empty_statement(measures: Sequence[str]) -> Column:
    return F.coalesce(*(F.col(m) for m in measures)).isNull()


def since_cutoff(day: Column | str, as_of: Column, days: int) -> Column:
    """On or after ``as_of`` minus ``days`` (kept within 1..365)."""
    return _col(day) >= F.date_sub(as_of, min(max(days, 1), 365))


def after_reference(entries: DataFrame, refs: DataFrame, *, issuer: str = "issuer", day: str = "entry_date", ref: str = "reference_date") -> DataFrame:
    """Entries after their issuer's reference date; undated ones go, issuers without one keep all."""
    joined = entries.join(refs.select(issuer, ref), issuer, "left")
    return joined.where(F.col(ref).isNull() | (F.col(day) > F.col(ref))).drop(ref)


def preferred_issue_event(preferred: Column) -> Column:
    """Event source: preferred shares are issued."""
    return F.coalesce(preferred > 0, F.lit(False))


def preferred_issue_decision(common: Column, preferred: Column) -> Column:
    """Decision source: preferred shares are issued and no common ones (NULL counts as none)."""
    return F.coalesce((F.coalesce(common, F.lit(0)) == 0) & (preferred > 0), F.lit(False))


def common_only_document(common: Column, other: Column) -> Column:
    """Document source: common shares and nothing else (such issues are dropped)."""
    return (F.coalesce(common, F.lit(0)) > 0) & (F.coalesce(other, F.lit(0)) == 0)


def not_expired(end: Column | str, as_of: Column) -> Column:
    """Still exercisable; an end that cannot be read keeps the row."""
    end = _col(end)
    day = parse_any_date(end.cast("string"), compact=False)
    return day.isNull() | (day >= as_of)


def has_position(shares: Column | str, remaining: Column | str) -> Column:
    return (F.coalesce(_col(shares), F.lit(0)) > 0) | (F.coalesce(_col(remaining), F.lit(0)) > 0)


def filled_count(cols: Sequence[Column | str]) -> Column:
    """How many of the columns hold something."""
    out = F.lit(0)
    for c in cols:
        out = out + F.when(_col(c).isNotNull(), 1).otherwise(0)
    return out


def is_sparse_rights(cols: Sequence[Column | str]) -> Column:
    """Fewer than two key fields were read."""
    return filled_count(cols) < 2


def is_sparse_bond(face_value: Column, terms: Column) -> Column:
    return face_value.isNull() & terms.isNull()


def is_sparse_exchange(category: Column, *, balances: Column, claims: Column, adjustments: Column, amount: Column, description: Column, income: Column) -> Column:
    """Weak parse per category; counts are numbers of child records (NULL = none)."""

    def none(n: Column) -> Column:
        return F.coalesce(n, F.lit(0)) == 0

    return (
        F.when(category == "exercise", none(balances) & none(claims))
        .when(category == "price_adj", none(adjustments))
        .when(category == "backlog", none(amount) | (F.coalesce(description, F.lit("")) == ""))
        .when(category == "sales", none(income))
        .otherwise(F.lit(True))
    )


def text_says_inactive(footnote: Column | str) -> Column:
    return _col(footnote).rlike("|".join(lx.INACTIVE_PATTERNS))


def periodic_reports(name: Column | str, kinds: Sequence[str] = ("사업보고서", "반기보고서", "분기보고서"), drop: Sequence[str] = ()) -> Column:
    keep = _col(name).rlike("|".join(kinds))
    return keep & ~_col(name).rlike("|".join(drop)) if drop else keep


def core_section_name(title: Column | str) -> Column:
    """Section title without white space, numbering and a leading ``(segment)``."""
    bare = squeeze(title)
    return F.regexp_replace(F.regexp_replace(bare, r"^\d+\.", ""), r"^\([^)]*\)", "")


def find_section(sections: DataFrame, *, keys: Sequence[str], title: str, order: str, keywords: Sequence[str], value: str) -> DataFrame:
    """Per document, the section of the first keyword that any title holds."""
    bare = core_section_name(title)
    rank = None
    for n, word in enumerate(keywords):
        rank = (F if rank is None else rank).when(F.contains(bare, F.lit(word)), F.lit(n))
    key = F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col(order).alias("o")))
    found = sections.groupBy(*keys).agg(
        F.min_by(title, key).alias("section_title"), F.min_by(value, key).alias(value)
    )
    return found.where(F.col("section_title").isNotNull())


def display_years(quarters: DataFrame, *, issuer: str = "issuer", fy: str = "fy", years: int = 2) -> DataFrame:
    """Quarters of the latest calendar years of an issuer."""
    last = quarters.groupBy(issuer).agg(F.max(fy).alias("_last"))
    return quarters.join(last, issuer).where(F.col(fy) > F.col("_last") - years).drop("_last")


def min_size(c: Column | str, n: int) -> Column:
    """Longer than a placeholder."""
    return F.length(_col(c)) > n

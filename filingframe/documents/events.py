"""Decision and event records of the filing API, and instruments from model replies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..dilution import schemas as sc
from ..functions import maps as K
from ..functions.numbers import floor_div, parse_amount
from ..operators.barrier import pin
from ..operators.aggregates import sum_funding, validate_face_value
from ..operators.predicates import preferred_issue_decision, preferred_issue_event

_COLUMNS = [c.split()[0] for c in sc.EVENT.split(", ")] + ["disclosure_date"]
_TYPES = dict(c.split() for c in sc.EVENT.split(", ")) | {"disclosure_date": "string"}


def _shape(df: DataFrame, **cols: Column) -> DataFrame:
    """The common event schema, NULL where a category has no such field."""
    return df.select(*(cols.get(c, F.lit(None)).cast(_TYPES[c]).alias(c) for c in _COLUMNS))


def _amount(name: str) -> Column:
    return parse_amount(name)


def _present(name: str) -> Column:
    return F.nullif(parse_amount(name), F.lit(0))


def _receipt_date(strict: bool) -> Column:
    pattern = r"^(\d{8})\d{6}$" if strict else r"^(\d{8})"
    return F.regexp_extract(F.coalesce("rcept_no", F.lit("")), pattern, 1)


def _bonds(rows: DataFrame, category: str, strict: bool) -> DataFrame:
    warrant = category == "BW"
    price, shares = ("ex_prc", "nstk_isstk_cnt") if warrant else ("cv_prc", "cvisstk_cnt")
    start, end = ("expd_bgd", "expd_edd") if warrant else ("cvrqpd_bgd", "cvrqpd_edd")
    return _shape(
        rows.where(F.col("category") == category),
        issuer=F.col("issuer"), ord=F.col("ord"), category=F.lit(category),
        series=F.coalesce(_amount("bd_tm"), F.lit(0)), kind=F.col("bd_knd"), face_value=_amount("bd_fta"),
        conversion_price=_amount(price), convertible_shares=_amount(shares),
        cv_start=F.col(start), cv_end=F.col(end), rcept_no=F.col("rcept_no"), disclosure_date=_receipt_date(strict),
    )


def _options(rows: DataFrame, count_columns: Sequence[str], strict: bool) -> DataFrame:
    shares = F.coalesce(*(_present(c) for c in count_columns))
    return _shape(
        rows.where((F.col("category") == "STOCK_OPTION") & (shares > 0)),
        issuer=F.col("issuer"), ord=F.col("ord"), category=F.lit("STOCK_OPTION"), shares=shares,
        convertible_shares=shares, exercise_price=F.coalesce(_amount("ex_prc"), F.lit(0)),
        cv_start=F.col("expd_bgd"), cv_end=F.col("expd_edd"), rcept_no=F.col("rcept_no"), disclosure_date=_receipt_date(strict),
    )


def _rights(rows: DataFrame, category: str, keep: Column, funding: Sequence[str], strict: bool) -> DataFrame:
    return _shape(
        rows.where((F.col("category") == category) & keep),
        issuer=F.col("issuer"), ord=F.col("ord"), category=F.lit(category), shares=_amount("nstk_estk_cnt"),
        share_type=F.lit(sc.RIGHTS_CATEGORY), issue_price=_present("stk_estk_issu_prc"), face_value=sum_funding(funding),
        rcept_no=F.col("rcept_no"), disclosure_date=_receipt_date(strict),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def decode_events(rows: DataFrame) -> DataFrame:
    """Event records, one column mapping per category, in the common schema."""
    keep = preferred_issue_event(_amount("nstk_estk_cnt"))
    return _union(
        [_bonds(rows, c, True) for c in ("CB", "BW", "PERPETUAL")]
        + [_options(rows, ["stk_ostk_cnt", "stk_isstk_ostk_cnt", "nstk_ostk_cnt"], True)]
        + [_rights(rows, c, keep, lx.FUNDING_EVENT, True) for c in ("RIGHTS_ISSUE", "MIXED_ISSUE")]
    )


def decode_decisions(rows: DataFrame) -> DataFrame:
    """Decision records: no perpetual or mixed issues, rights only without common shares."""
    keep = preferred_issue_decision(_amount("nstk_ostk_cnt"), _amount("nstk_estk_cnt"))
    return _union(
        [_bonds(rows, c, False) for c in ("CB", "BW")]
        + [_options(rows, ["stk_ostk_cnt", "stk_isstk_ostk_cnt"], False)]
        + [_rights(rows, "RIGHTS_ISSUE", keep, lx.FUNDING_DECISION, False)]
    )


_ITEM = (
    "struct<category:string,series:string,kind:string,face_value:string,remaining_balance:string,"
    "conversion_price:string,convertible_shares:string,exercise_start:string,exercise_end:string,active:string>"
)


def _safe_int(c: str) -> Column:
    text = F.regexp_replace(F.col(c), r"(?U)[,\s원주]", "")
    number = F.coalesce(text.try_cast("bigint"), F.when(text.rlike(r"^-?\d+\.\d+$"), text.try_cast("double").try_cast("bigint")))
    return F.coalesce(number, F.lit(0).cast("bigint"))


def _instrument_category() -> Column:
    c = F.col("category")
    return (
        F.when(c.isin("CB", "BW", "전환우선주", "SO"), c)
        .when(F.contains(c, F.lit("전환사채")), F.lit("CB"))
        .when(F.contains(c, F.lit("신주인수권")), F.lit("BW"))
        .when(c.rlike("전환우선주|전환상환|상환전환|RCPS"), F.lit("전환우선주"))
        .when(c.rlike("주식매수선택권|주식기준보상|스톡옵션"), F.lit("SO"))
    )


def _dotted_date(c: str) -> Column:
    pattern = r"^(\d{4})(?:[.\-/]|\s*년\s*)(\d{1,2})(?:[.\-/]|\s*월\s*)(\d{1,2})"
    y, m, d = (F.regexp_extract(F.coalesce(F.col(c), F.lit("")), pattern, i) for i in (1, 2, 3))
    return F.when(y != "", F.concat_ws(".", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise("")


def normalize_instruments(items: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Categories, numbers and dates of loose instrument records; empty ones are dropped.

    A face value off by a power of ten is replaced by price x shares, and missing shares are
    derived from it (not for options).
    """
    option = F.col("category") == "SO"
    typed = items.withColumn("category", _instrument_category()).where(F.col("category").isNotNull())
    typed = typed.withColumns({c: _safe_int(c) for c in ("series", "face_value", "conversion_price", "convertible_shares")})
    face = validate_face_value(F.col("face_value"), F.col("conversion_price"), F.col("convertible_shares"))
    typed = typed.withColumn("face_value", face)
    derived = (F.col("convertible_shares") == 0) & (F.col("face_value") != 0) & (F.col("conversion_price") != 0) & ~option
    typed = typed.withColumn(
        "convertible_shares",
        F.when(derived, floor_div(F.col("face_value"), F.col("conversion_price"))).otherwise(F.col("convertible_shares")),
    )
    usable = F.when(option, F.col("convertible_shares") != 0).otherwise(
        (F.col("face_value") != 0) | (F.col("convertible_shares") != 0)
    )
    typed = pin(typed)
    remaining = F.when(F.col("remaining_balance").isNotNull(), _safe_int("remaining_balance"))
    return typed.where(usable).select(
        *keys, "category", "series", F.trim(F.coalesce("kind", F.lit(""))).alias("kind"), "face_value",
        remaining.alias("remaining_balance"), "convertible_shares", "conversion_price",
        _dotted_date("exercise_start").alias("exercise_start"), _dotted_date("exercise_end").alias("exercise_end"),
        F.coalesce(~F.lower("active").isin("false", "0", ""), F.lit(True)).alias("active"),
    )


def instrument_items(replies: DataFrame, *, keys: Sequence[str], content: str = "content") -> DataFrame:
    """Instrument records of model replies, one row each, normalised."""
    parsed = pin(replies.select(*keys, K.parse_json_items(content, _ITEM).alias("_items")))
    items = parsed.select(*keys, F.explode("_items").alias("_i")).select(*keys, "_i.*")
    return normalize_instruments(items, keys=keys)

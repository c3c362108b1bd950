"""Dates, fiscal periods and period labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOOSE = r"(\d{4})\D+(\d{1,2})\D+(\d{1,2})"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _parts_to_date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(F.when(year != "", text), "yyyy-MM-dd")


def parse_any_date(c: Column | str, compact: bool = True) -> Column:
    """First year/month/day found, whatever stands between; compact ``YYYYMMDD`` on request."""
    text = _col(c)
    loose = _parts_to_date(*(F.regexp_extract(text, _LOOSE, i) for i in (1, 2, 3)))
    if not compact:
        return loose
    solid = F.nullif(F.regexp_extract(text, r"^(\d{8})$", 1), F.lit(""))
    return F.coalesce(loose, F.try_to_date(solid, "yyyyMMdd"))


def parse_short_date(c: Column | str) -> Column:
    """``YY.MM.DD`` of listing pages."""
    pattern = r"^(\d{2})\.(\d{2})\.(\d{2})$"
    year = F.regexp_extract(_col(c), pattern, 1)
    return _parts_to_date(
        F.when(year != "", F.concat(F.lit("20"), year)),
        F.regexp_extract(_col(c), pattern, 2),
        F.regexp_extract(_col(c), pattern, 3),
    )


def compact_period_date(c: Column | str) -> Column:
    """Display form ``YYYY.MM.DD``; text without a date is returned trimmed."""
    text = _col(c)
    y, m, d = (F.regexp_extract(text, _LOOSE, i) for i in (1, 2, 3))
    return F.when(y == "", F.trim(text)).otherwise(
        F.concat_ws(".", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    )


def date_from_receipt(rcept_no: Column | str, strict: bool = True) -> Column:
    """Filing date inside a receipt number: exactly 14 digits, or (loose) at least eight."""
    pattern = r"^(\d{8})\d{6}$" if strict else r"^(\d{8})"
    return F.try_to_date(
        F.nullif(F.regexp_extract(_col(rcept_no), pattern, 1), F.lit("")), "yyyyMMdd"
    )


def date_from_url(url: Column | str) -> Column:
    """Filing date of a viewer URL (``rcpNo=``)."""
    return F.try_to_date(
        F.nullif(F.regexp_extract(_col(url), r"rcpNo=(\d{8})", 1), F.lit("")), "yyyyMMdd"
    )


def reference_date(report_name: Column | str) -> Column:
    """Period end of a periodic report, from its name."""
    name = _col(report_name)
    year = F.regexp_extract(name, r"(\d{4})\s*년", 1)
    quarter = F.regexp_extract(name, r"(\d)\s*분기", 1)
    month_a = F.when(
        year != "",
        F.when(F.contains(name, F.lit("사업보고서")), F.lit(12))
        .when(F.contains(name, F.lit("반기보고서")), F.lit(6))
        .when(
            F.contains(name, F.lit("분기보고서")) & (quarter != ""),
            quarter.try_cast("int") * 3,
        ),
    )
    paren = r"\((\d{4})[./](\d{2})\)"
    year_any = F.when(month_a.isNotNull(), year).otherwise(F.regexp_extract(name, paren, 1))
    month_any = F.coalesce(month_a, F.regexp_extract(name, paren, 2).try_cast("int"))
    return F.last_day(_parts_to_date(year_any, month_any.cast("string"), F.lit("01")))


def fiscal_quarter_end(fy: Column, fq: Column, settlement_month: Column) -> tuple[Column, Column]:
    """(calendar year, month) in which a fiscal quarter ends; quarter 0 is the full year."""
    span = F.when(fq == 0, F.lit(12)).otherwise(fq * 3)
    month = F.pmod(F.pmod(settlement_month, F.lit(12)) + span - 1, F.lit(12)) + 1
    return F.when(month > settlement_month, fy - 1).otherwise(fy), month


def detect_period(start: Column | str, end: Column | str, settlement_month: Column) -> Column:
    """Struct (fy, fq, cumulative) of a start/end range; no end gives (0, 0, false)."""
    pattern = r"(\d{4})\D?(\d{2})"
    end_year = F.regexp_extract(_col(end), pattern, 1).try_cast("int")
    end_month = F.regexp_extract(_col(end), pattern, 2).try_cast("int")
    start_month = F.coalesce(F.regexp_extract(_col(start), pattern, 2).try_cast("int"), F.lit(1))
    raw_span = end_month - start_month + 1
    span = F.when(raw_span <= 0, raw_span + 12).otherwise(raw_span)
    fy_start = F.pmod(settlement_month, F.lit(12)) + 1
    quarter = F.ceil((F.pmod(end_month - fy_start, F.lit(12)) + 1) / 3).cast("int")
    annual = span >= 11
    return F.struct(
        F.coalesce(end_year, F.lit(0)).alias("fy"),
        F.when(end_year.isNull() | annual, F.lit(0)).otherwise(quarter).alias("fq"),
        F.coalesce(~annual & (start_month == fy_start) & (span > 4), F.lit(False)).alias("cumulative"),
    )


def period_label(fy: Column, fq: Column, style: str = "internal") -> Column:
    """``2025``, ``2025.Q3`` (internal) or ``2025.3Q`` (display)."""
    part = F.concat(F.lit(".Q"), fq) if style == "internal" else F.concat(F.lit("."), fq, F.lit("Q"))
    return F.when(fq == 0, fy.cast("string")).otherwise(F.concat(fy.cast("string"), part))


def estimate_label(fy: Column) -> Column:
    return F.concat(fy.cast("string"), F.lit("(E)"))


def parse_period(c: Column | str) -> Column:
    """Struct (fy, fq, is_estimate) of any of the period spellings."""
    text = _col(c)
    fq = F.coalesce(
        F.regexp_extract(text, r"^\d{4}\.Q(\d)$", 1).try_cast("int"),
        F.regexp_extract(text, r"^\d{4}\.(\d)Q$", 1).try_cast("int"),
        F.lit(0),
    )
    return F.struct(
        F.regexp_extract(text, r"^(\d{4})", 1).try_cast("int").alias("fy"),
        fq.alias("fq"),
        text.endswith("(E)").alias("is_estimate"),
    )


def quarter_of_reference(ref: Column | str) -> Column:
    """``YYYYMMDD`` -> ``YYYY.Qn`` by the quarter end at or after the month."""
    text = _col(ref)
    quarter = F.ceil(F.substring(text, 5, 2).try_cast("int") / 3)
    return F.when(
        F.length(text) == 8, F.concat(F.substring(text, 1, 4), F.lit(".Q"), quarter)
    ).otherwise("")


def quarter_end_label(end_date: Column | str) -> Column:
    """``2025-12-31`` -> ``2025.4Q``; NULL unless the month closes a quarter."""
    pattern = r"^(\d{4})-(\d{2})-\d{2}"
    month = F.regexp_extract(_col(end_date), pattern, 2).try_cast("int")
    return F.when(
        month.isin(3, 6, 9, 12),
        F.concat(F.regexp_extract(_col(end_date), pattern, 1), F.lit("."), (month / 3).cast("int"), F.lit("Q")),
    )


def relative_period(text: Column | str, issued: Column, matures: Column) -> tuple[Column, Column]:
    """Exercise period stated relative to issue and maturity.

    ``add_months`` moves 29 February to the 28th where a plain year shift has no such day.
    """
    t = _col(text)
    years = F.regexp_extract(t, r"(?s)발행일.*?(\d+)\s*년", 1).try_cast("int")
    months = F.regexp_extract(t, r"(?s)만기.*?(\d+)\s*개월\s*전", 1).try_cast("int")
    start = F.add_months(issued, years * 12)
    end = F.when(F.contains(t, F.lit("만기")), F.add_months(matures, -F.coalesce(months, F.lit(0))))
    known = start.isNotNull() & end.isNotNull()
    return F.when(known, start), F.when(known, end)


def preferred_period(text: Column | str, issued: Column) -> tuple[Column, Column]:
    """Preferred stock: "N years passed" opens, "N years reached" closes."""
    t = _col(text)
    opens = F.regexp_extract(t, r"(\d+)\s*년이\s*경과한\s*날", 1).try_cast("int")
    closes = F.regexp_extract(t, r"(\d+)\s*년이\s*되는\s*날", 1).try_cast("int")
    return F.add_months(issued, opens * 12), F.add_months(issued, closes * 12)


def format_period(start: Column | str, end: Column | str) -> Column:
    """``a~b``, ``a~``, ``~b`` or empty."""
    a = F.coalesce(_col(start), F.lit(""))
    b = F.coalesce(_col(end), F.lit(""))
    return F.when((a == "") & (b == ""), F.lit("")).otherwise(F.concat(a, F.lit("~"), b))

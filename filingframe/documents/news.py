"""Rows of news and research listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, strip_tags, unescape
from . import cells as C
from .exchange import at, has

_LINK = r"(?is)<a\b[^>]*href\s*=\s*[\"']([^\"']*)[\"'][^>]*>"


def absolute(url: Column, base: str) -> Column:
    """Site-relative address -> full one."""
    return F.when((url != "") & ~url.startswith("http"), F.concat(F.lit(base), url)).otherwise(url)


def _text(html: Column, pattern: str, group: int = 1) -> Column:
    return clean_text(strip_tags(F.regexp_extract(html, pattern, group)))


def listing_rows(
    pages: DataFrame, *, keys: Sequence[str], html: str = "html", item: str = "li", base: str = "", source: str = "",
    date: str = r"(\d{4})[.-](\d{2})[.-](\d{2})", limit: int | None = None,
) -> DataFrame:
    """(date, title, url, source) of the ``item`` elements of a listing page, in page order.

    Items without a link or a date are skipped; ``limit`` is the number of entries a feed shows.
    """
    blocks = F.regexp_extract_all(html, F.lit(rf"(?is)<{item}\b[^>]*>(.*?)</{item}\s*>"), F.lit(1))
    if limit is not None:
        blocks = F.slice(blocks, 1, limit)
    rows = pages.select(*keys, F.posexplode(blocks).alias("pos", "_b"))
    b = F.col("_b")
    after_link = F.regexp_replace(strip_tags(b, " "), r"\s+", " ")
    y, m, d = (F.regexp_extract(after_link, date, i) for i in (1, 2, 3))
    day = F.try_to_date(F.when(y != "", F.concat_ws("-", y, m, d)), "yyyy-MM-dd")
    url = absolute(unescape(F.regexp_extract(b, _LINK, 1)), base)
    out = rows.select(
        *keys, "pos", day.alias("date"), _text(b, _LINK[:-1] + r">(.*?)</a\s*>", 2).alias("title"), url.alias("url"), F.lit(source).alias("source")
    )
    return out.where(F.col("date").isNotNull() & (F.col("title") != "") & (F.col("url") != ""))


def payload_rows(pages: DataFrame, *, keys: Sequence[str], body: str = "html", url: str = "url", source: str = "consensus") -> DataFrame:
    """Reports from parallel lists in a page payload, zipped only when all lists are equally long."""
    field = lambda n: rf'"{n}"\s*:\s*"((?:[^"\\]|\\.)*)"'
    titles, brokers = (F.regexp_extract_all(body, F.lit(field(n)), F.lit(1)) for n in ("REPORT_TITLE", "OFFICE_NAME"))
    dates = F.regexp_extract_all(body, F.lit(r'"REPORT_DATE"\s*:\s*"(\d{4}-\d{2}-\d{2})"'), F.lit(1))
    step = pages.select(*keys, url, titles.alias("t"), brokers.alias("b"), dates.alias("d"))
    step = step.where((F.size("t") == F.size("b")) & (F.size("t") == F.size("d")))
    rows = step.select(*keys, url, F.posexplode(F.arrays_zip("t", "b", "d")).alias("pos", "_z"))
    z = F.col("_z")
    return rows.select(
        *keys, "pos", F.try_to_date(z["d"], "yyyy-MM-dd").alias("date"), F.concat(F.lit("["), z["b"], F.lit("] "), z["t"]).alias("title"),
        F.col(url).alias("url"), F.lit(source).alias("source"),
    ).where(F.col("date").isNotNull())


def feed_rows(feeds: DataFrame, *, keys: Sequence[str], xml: str = "xml", limit: int | None = None, source: str = "feed") -> DataFrame:
    """Entries of an RSS feed, the first ``limit`` of each if one is given."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<item\b[^>]*>(.*?)</item\s*>"), F.lit(1))
    blocks = F.slice(blocks, 1, limit) if limit else blocks
    rows = feeds.select(*keys, F.posexplode(blocks).alias("pos", "_b"))
    b = F.col("_b")
    stamp = F.regexp_extract(b, r"(?is)<pubDate>\s*(?:\w{3},\s*)?(\d{1,2} \w{3} \d{4})", 1)
    return rows.select(
        *keys, "pos", F.try_to_date(F.nullif(stamp, F.lit("")), "d MMM yyyy").alias("date"), _text(b, r"(?is)<title>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</title>").alias("title"),
        F.trim(unescape(F.regexp_extract(b, r"(?is)<link>(.*?)</link>", 1))).alias("url"), F.lit(source).alias("source"),
    )


def research_rows(pages: DataFrame, *, keys: Sequence[str], html: str = "html", caption: str = "제공사") -> DataFrame:
    """Research listing: broker from the captioned column, else the first cell that looks like a
    name. Dates are ``YY.MM.DD`` or full ones."""
    rows = pages.select(*keys, F.posexplode(C.html_tables(html)).alias("table_no", "_t"))
    head = F.get("_t", C.header_index(F.col("_t")))
    at_caption = F.array_min(F.transform(head, lambda c, i: F.when(has(c["text"], caption), i.cast("int"))))
    data = rows.select(*keys, "table_no", at_caption.alias("_n"), F.posexplode(F.transform("_t", C.row_texts)).alias("row_no", "_r"))
    r = F.col("_r")
    short = F.filter(r, lambda t: t.rlike(r"^(\d{2}|\d{4})[.-]\d{2}[.-]\d{2}$"))
    raw = F.regexp_replace(at(short, 0), r"\.", "-")
    day = F.try_to_date(F.when(F.length(raw) == 8, F.concat(F.lit("20"), raw)).otherwise(raw), "yyyy-MM-dd")
    guess = F.filter(
        r, lambda t, i: (i > 1) & (t != "") & ~t.rlike(r"^\d") & (~has(t, ",") | t.rlike("(증권|투자|자산운용)$"))
    )
    broker = F.coalesce(F.nullif(F.get(r, F.col("_n")), F.lit("")), at(guess, 0), F.lit(""))
    return data.select(*keys, "table_no", "row_no", day.alias("date"), at(r, 1).alias("title"), broker.alias("broker")).where(
        F.col("date").isNotNull()
    )

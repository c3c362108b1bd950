"""Source bundle and the report of each issuer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import containment_dedup
from ..operators.ordering import top_n_per_key
from ..operators.windows import char_budget, news_entry, running_sum

# --- fixed values: headings of the bundle ------------------------------------------------------
REPORT_HEADING = "### 자동 생성된 재무 분석 보고서 (섹션 1~4)"
RESEARCH_HEADING = "### 리서치 리포트: "
NEWS_HEADING = "### 최근 뉴스"
RULE = "\n\n---\n\n"  # between sections

_LEAST_ENTRY = 6  # characters of the shortest news entry: "- [] x"


def source_sections(reports: DataFrame, research: DataFrame, news: DataFrame, *, issuer: str = "issuer") -> DataFrame:
    """(issuer, part, key, body): report text (0), research texts (1, by file) and news entries (2, by date and number).

    One row per text, so an issuer may have any number of them; ``part`` and ``key`` give their
    order. Empty texts are left out.
    """
    have = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    r = reports.where(have("report_text")).select(issuer, F.lit(0).alias("part"), F.lit("").alias("key"), F.col("report_text").alias("body"))
    s = research.where(have("text")).select(issuer, F.lit(1).alias("part"), F.col("file").alias("key"), F.col("text").alias("body"))
    number = F.lpad(F.col("ord").cast("string"), 19, "0")
    n = news.where(have("entry")).select(issuer, F.lit(2).alias("part"), F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" "), number).alias("key"), F.col("entry").alias("body"))
    return r.unionByName(s).unionByName(n)


def news_digest(news: DataFrame, *, issuer: str = "issuer", order: str = "ord", title: str = "title", max_body: int = 800, max_total: int = 15_000) -> DataFrame:
    """(issuer, order, entry): the news of a bundle.

    Near-equal titles leave their first article, articles without a title go, a body is clipped
    after ``max_body`` characters, and entries follow in ``order`` while the ones before them have
    fewer than ``max_total`` characters. Needs ``date`` and ``content`` beside the named columns.
    """
    # clipped first, so that no whole body travels to the join with the titles that stay
    clipped = news.select(issuer, order, title, news_entry(title=title, max_body=max_body).alias("entry"))
    single = containment_dedup(clipped, block=[issuer], order=order, title=title).where(F.coalesce(title, F.lit("")) != "")
    entries = single.select(issuer, order, "entry")
    return char_budget(entries, keys=[issuer], order=[order], text="entry", slot=F.lit(0), max_total=max_total, least=_LEAST_ENTRY)


def bundle_rows(reports: DataFrame, research: DataFrame, digest: DataFrame, *, issuer: str = "issuer", order: str = "ord") -> DataFrame:
    """(issuer, part, key, joint, text): the bundle of an issuer as rows in the order of ``part`` and ``key``.

    The bundle is the ``text`` of all rows, each but the first behind its ``joint``. Report and
    research texts are whole, whatever their number; ``digest`` is :func:`news_digest`. Without a
    shuffle but for the first news entry of an issuer, which carries the heading.
    """
    have = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    columns = lambda part, key, joint, text: (issuer, F.lit(part).alias("part"), key.alias("key"), joint.alias("joint"), text.alias("text"))
    rule, blank = F.lit(RULE), "\n\n"
    r = reports.where(have("report_text")).select(*columns(0, F.lit(""), rule, F.concat(F.lit(REPORT_HEADING + blank), "report_text")))
    s = research.where(have("text")).select(*columns(1, F.col("file"), rule, F.concat(F.lit(RESEARCH_HEADING), "file", F.lit(blank), "text")))
    first = F.row_number().over(Window.partitionBy(issuer).orderBy(order)) == 1  # the budget bounds the entries of an issuer
    headed = digest.withColumn("_first", first)
    number = F.lpad(F.col(order).cast("string"), 19, "0")
    joint, text = F.when(F.col("_first"), rule).otherwise("\n"), F.concat(F.when(F.col("_first"), NEWS_HEADING + blank).otherwise(""), "entry")
    return r.unionByName(s).unionByName(headed.select(*columns(2, number, joint, text)))


def source_bundle(rows: DataFrame, *, issuer: str = "issuer", slot: Column | None = None) -> DataFrame:
    """(issuer, sources_content): the rows of :func:`bundle_rows` as one text.

    Joined in two steps, first the rows of a ``slot`` (any coarsening of the order within a part,
    by default the first ten characters of the key), then the slots; only the text of the result
    itself stands in one row. Where that must not be, use the rows.
    """
    marked = rows.withColumn("_slot", slot if slot is not None else F.substring("key", 1, 10))
    entry = F.struct("part", "key", "joint", "text")
    sorted_rows = F.array_sort(F.collect_list(entry))
    joined = lambda a: F.array_join(F.transform(a, lambda x, i: F.concat(F.when(i == 0, "").otherwise(x["joint"]), x["text"])), "")
    small = marked.groupBy(issuer, "part", "_slot").agg(sorted_rows.alias("_rows"))
    slots = small.select(issuer, F.struct("part", F.col("_slot").alias("key"), F.col("_rows")[0]["joint"].alias("joint"), joined(F.col("_rows")).alias("text")).alias("_s"))
    return slots.groupBy(issuer).agg(joined(F.array_sort(F.collect_list("_s"))).alias("sources_content"))


def nest(rows: DataFrame, name: str, *, issuer: str = "issuer", order: Sequence[str], n: int) -> DataFrame:
    """Display rows of an issuer as one array: the last ``n`` in ``order``, as many as a report has columns for."""
    cols = [c for c in rows.columns if c != issuer]
    last = top_n_per_key(rows, n, keys=[issuer], order=[F.desc(c) for c in order])
    keyed = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.struct(*cols).alias("row"))
    return last.groupBy(issuer).agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["row"]).alias(name))


def assemble_report(issuers: DataFrame, scalars: Sequence[DataFrame], tables: Mapping[str, tuple], *, issuer: str = "issuer") -> DataFrame:
    """One nested record per issuer: scalar columns and arrays of display rows.

    ``tables`` maps a name to (rows, order, number of columns a report shows): the tables that go
    across the page by year, quarter or period. Tables an issuer may have any number of rows of
    (contracts, instruments, balance items) stay beside the record, see :func:`detail_lines`.
    Missing inputs give NULL scalars and empty arrays, never a lost issuer.
    """
    out = issuers
    for df in scalars:
        out = out.join(df, issuer, "left")
    for name, (df, order, n) in tables.items():
        out = out.join(nest(df, name, issuer=issuer, order=order, n=n), issuer, "left")
    types = dict(out.dtypes)
    filled = {n: F.coalesce(F.col(n), F.array().cast(types[n])) for n in tables}
    return out.withColumns(filled) if filled else out


def report_rows(reports: DataFrame, scalars: Sequence[str], tables: Sequence[str], *, issuer: str = "issuer") -> DataFrame:
    """(issuer, section, pos, row): the record as lines, cells joined by a bar; missing scalars have no line."""
    parts = []
    if scalars:
        single = F.array(*(_line(c, F.lit(1), F.col(c).cast("string")) for c in scalars))
        parts.append(F.filter(single, lambda x: x["row"].isNotNull()))
    for name in tables:
        parts.append(_lines(name, reports.schema[name].dataType.elementType.fieldNames()))
    return reports.select(issuer, F.explode(F.concat(*parts)).alias("l")).select(issuer, "l.*")


def detail_lines(rows: DataFrame, section: str, *, issuer: str = "issuer", order: Sequence[str], slot: Column) -> DataFrame:
    """(issuer, section, pos, row): every row of a table as a line, numbered in ``order``; none is left out.

    Numbered in two levels: ``slot`` is a coarsening of ``order``, so an issuer with very many rows
    is spread over its slots.
    """
    cells = _cells(F.col(c) for c in rows.columns if c != issuer)
    counted = running_sum(rows.withColumn("_one", F.lit(1)), keys=[issuer], order=order, value="_one", slot=slot, out="_before")
    return counted.select(issuer, F.lit(section).alias("section"), (F.col("_before") + 1).cast("bigint").alias("pos"), cells.alias("row"))


def _line(section: str, pos: Column, row: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), pos.cast("bigint").alias("pos"), row.alias("row"))


def _lines(name: str, fields: Sequence[str]) -> Column:
    """The rows of one table as lines."""
    return F.transform(name, lambda r, i: _line(name, i + 1, _cells(r[f] for f in fields)))


def _cells(values) -> Column:
    return F.concat_ws("|", *(v.cast("string") for v in values))


def summary_counts(reports: DataFrame, tables: Sequence[str]) -> Column:
    """How many of the tables of a report are empty."""
    total = F.lit(0)
    for t in tables:
        total = total + F.when(F.size(t) == 0, 1).otherwise(0)
    return total

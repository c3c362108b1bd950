"""HTML tables as nested columns and as long tables.

Parsing stays inside the row of its document (nested arrays and higher-order functions), so
no shuffle is needed before records are exploded, however many documents one issuer has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cell_text, cell_texts, choose, clean_text, let, upto

_TR, _TD = "[tT][rR]", "[tT][dDhH]"
_TABLE = r"(?i)<table\b[^>]*>([^<]*+(?:<(?!/table\s*>)[^<]*+)*+)</table\s*>"
_ROW = rf"<{_TR}\b[^>]*>({upto(rf'/{_TR}\s*>', rf'{_TR}\b')})(?:</{_TR}\s*>|(?=<{_TR}\b)|$)"
_CELL = rf"<({_TD}\b[^>]*>{upto(rf'/{_TD}\s*>', rf'{_TD}\b')})(?:</{_TD}\s*>|(?=<{_TD}\b)|$)"
_CONTENT = rf"<{_TD}\b[^>]*>({upto(rf'/{_TD}\s*>', rf'{_TD}\b')})(?:</{_TD}\s*>|(?=<{_TD}\b)|$)"

CELL_TYPE = "struct<text:string,is_header:boolean,rowspan:int,colspan:int>"


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def _span(c: Column, end: Column, name: str) -> Column:
    """Span stated in the opening tag, which ends at ``end``; most cells state none."""
    tag = F.substring(c, F.lit(1), end)
    found = F.coalesce(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']?(\d+)", 1).try_cast("int"), F.lit(1))
    # a tag that is too short for any span is not searched
    return choose(end < len(name) + 4, F.lit(1), choose(F.contains(F.lower(tag), F.lit(name)), found, F.lit(1)))


def _cell(c: Column) -> Column:
    """One cell, from ``td …>content``; the tag is short, so that its end is looked up where it is needed."""
    end = F.instr(c, ">")
    return F.struct(
        cell_text(F.substring(c, end + 1, F.length(c))).alias("text"),
        F.contains(F.lit("hH"), F.substring(c, 2, 1)).alias("is_header"),
        _span(c, end, "rowspan").alias("rowspan"),
        _span(c, end, "colspan").alias("colspan"),
    )


def markup_rows(html: Column | str) -> Column:
    """``array<array<string>>``: the markup of the rows of the tables (not nested in each other)."""
    html = F.col(html) if isinstance(html, str) else html
    return F.transform(_all(html, _TABLE), lambda t: _all(t, _ROW))


def row_cells(row: Column) -> Column:
    """``array<cell>`` of the markup of a row."""
    return F.transform(_all(row, _CELL), _cell)


def row_cell_texts(row: Column) -> Column:
    """The texts of :func:`row_cells`, without looking at headers and spans."""
    return cell_texts(_all(row, _CONTENT))


def html_tables(html: Column | str) -> Column:
    """``array<array<array<cell>>>``: tables, rows, cells (tables not nested in each other)."""
    return F.transform(markup_rows(html), lambda t: F.transform(t, row_cells))


def html_texts(html: Column | str) -> Column:
    """``array<array<array<string>>>``: the same with texts only."""
    return F.transform(markup_rows(html), lambda t: F.transform(t, row_cell_texts))


def row_texts(row: Column) -> Column:
    return F.transform(row, lambda c: c["text"])


def table_rows(docs: DataFrame, html: str = "html") -> DataFrame:
    """One row per table row: the document's other columns, ``table_no``, ``row_no``, ``cells``."""
    keep = [c for c in docs.columns if c != html]
    tables = docs.select(*keep, F.posexplode(html_tables(html)).alias("table_no", "_rows"))
    return tables.select(*keep, "table_no", F.posexplode("_rows").alias("row_no", "cells")).where(
        F.size("cells") > 0
    )


def table_cells(docs: DataFrame, html: str = "html", nested: bool = False) -> DataFrame:
    """Long cell table; ``nested=True`` reads pages whose tables hold tables."""
    if nested:
        return _nested_cells(docs, html)
    rows = table_rows(docs, html)
    keep = [c for c in rows.columns if c != "cells"]
    return rows.select(*keep, F.posexplode("cells").alias("col_no", "c")).select(*keep, "col_no", "c.*")


class _TableReader(HTMLParser):
    """Collects cells of nested tables; text belongs to the innermost open cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[list] = []
        self._open: list[list] = []  # per table: [table_no, row_no, col_no, current cell]
        self._count = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self._open.append([self._count, -1, -1, None])
            self._count += 1
        elif self._open and tag == "tr":
            frame = self._open[-1]
            frame[1], frame[2], frame[3] = frame[1] + 1, -1, None
        elif self._open and tag in ("td", "th"):
            frame = self._open[-1]
            frame[2] += 1
            given = dict(attrs)
            spans = [int(given.get(k) or 1) if str(given.get(k) or 1).isdigit() else 1 for k in ("rowspan", "colspan")]
            frame[3] = [frame[0], max(frame[1], 0), frame[2], "", tag == "th", *spans]
            self.cells.append(frame[3])

    def handle_endtag(self, tag: str) -> None:
        if self._open and tag == "table":
            self._open.pop()
        elif self._open and tag in ("td", "th"):
            self._open[-1][3] = None

    def handle_data(self, data: str) -> None:
        if self._open and self._open[-1][3] is not None:
            self._open[-1][3][3] += data


def _nested_cells(docs: DataFrame, html: str) -> DataFrame:
    keep = [f for f in docs.schema.fields if f.name != html]
    names = [f.name for f in keep]
    columns = ["table_no", "row_no", "col_no", "text", "is_header", "rowspan", "colspan"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record in batch.itertuples(index=False):
                row = dict(zip(batch.columns, record))
                reader = _TableReader()
                reader.feed(row[html] or "")
                out += [[row[n] for n in names] + cell for cell in reader.cells]
            yield pd.DataFrame(out, columns=names + columns)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    tail = "table_no int, row_no int, col_no int, text string, is_header boolean, rowspan int, colspan int"
    cells = docs.mapInPandas(read, schema=f"{schema}, {tail}" if schema else tail)
    return cells.withColumn("text", clean_text("text"))


# -- key/value and header forms ------------------------------------------------------------------

PAIR_TYPE = "array<struct<key:string,value:string>>"


def kv_pairs(rows: Column) -> Column:
    """Ordered key/value pairs of a table given as ``array<array<cell>>``.

    The first two cells of a row are key and value, a later row overwriting an earlier one.
    Rows with three or more cells also give their last two, which never override a key that
    the table has already shown.
    """
    return _pairs(rows, lambda c: c["text"])


def text_pairs(rows: Column) -> Column:
    """:func:`kv_pairs` of a table given as ``array<array<string>>``."""
    return _pairs(rows, lambda c: c)


def _pairs(rows: Column, text: Callable[[Column], Column]) -> Column:
    entries = F.flatten(
        F.transform(
            rows,
            lambda r, i: F.when(
                F.size(r) >= 2,
                F.concat(
                    F.array(_entry(text(r[0]), text(r[1]), i, True)),
                    F.when(
                        F.size(r) >= 3,
                        F.array(
                            _entry(
                                text(F.get(r, F.size(r) - 2)), text(F.get(r, F.size(r) - 1)), i, False
                            )
                        ),
                    ).otherwise(F.array().cast("array<struct<key:string,value:string,i:int,main:boolean>>")),
                ),
            ).otherwise(F.array().cast("array<struct<key:string,value:string,i:int,main:boolean>>")),
        )
    )
    return _put_all(F.filter(entries, lambda e: e["key"] != ""))


def _entry(key: Column, value: Column, i: Column, main: bool) -> Column:
    return F.struct(
        key.alias("key"), value.alias("value"), i.cast("int").alias("i"), F.lit(main).alias("main")
    )


def _put_all(entries: Column) -> Column:
    """Apply entries in order: main ones insert or overwrite, side ones only insert."""

    def put(acc: Column, e: Column) -> Column:
        pair = F.struct(e["key"].alias("key"), e["value"].alias("value"))
        known = F.exists(acc, lambda q: q["key"] == e["key"])
        swapped = F.transform(acc, lambda q: F.when(q["key"] == e["key"], pair).otherwise(q))
        return (
            F.when(~known, F.concat(acc, F.array(pair)))
            .when(e["main"], swapped)
            .otherwise(acc)
        )

    return F.aggregate(entries, F.array().cast(PAIR_TYPE), put)


def merge_pairs(tables: Column, pairs: Callable[[Column], Column] = kv_pairs) -> Column:
    """Pairs of several tables, a later table overwriting an earlier one; ``pairs`` reads one table."""
    every = F.flatten(F.transform(tables, pairs))
    as_entries = F.transform(
        every, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"), F.lit(0).alias("i"), F.lit(True).alias("main"))
    )
    return _put_all(as_entries)


def header_index(rows: Column) -> Column:
    """Position of the first row with a header cell, else 0."""
    marks = F.transform(rows, lambda r: F.exists(r, lambda c: c["is_header"]))
    at = F.array_position(marks, F.lit(True))
    return F.when(at > 0, at.cast("int") - 1).otherwise(F.lit(0))


def headed_rows(rows: Column) -> Column:
    """Data rows as ordered ``(header, text)`` pairs; surplus cells are ``col_<i>``."""

    def head_texts(head: Column) -> Column:
        marked = F.filter(head, lambda c: c["is_header"])
        return row_texts(F.when(F.size(marked) > 0, marked).otherwise(head))

    def pairs(data: Column, head: Column) -> Column:
        return F.transform(
            data,
            lambda r: F.transform(
                r,
                lambda c, j: F.struct(
                    F.coalesce(F.get(head, j), F.concat(F.lit("col_"), j.cast("string"))).alias("key"),
                    c["text"].alias("value"),
                ),
            ),
        )

    def after(table: Column, at: Column) -> Column:
        data = F.filter(F.slice(table, at + 2, F.greatest(F.size(table) - at - 1, F.lit(0))), lambda r: F.size(r) > 0)
        return let(head_texts(F.get(table, at)), lambda head: pairs(data, head))

    return let(rows, lambda table: let(header_index(table), lambda at: after(table, at)))


def html_table(rows: Column, header: list[str] | None = None) -> Column:
    """Write ``array<array<string>>`` as one HTML table (round-trip checks, fixtures)."""
    head = ""
    if header:
        head = "<tr>" + "".join(f"<th>{h}</th>" for h in header) + "</tr>"
    body = F.array_join(
        F.transform(
            rows,
            lambda r: F.concat(
                F.lit("<tr>"),
                F.array_join(F.transform(r, lambda t: F.concat(F.lit("<td>"), t, F.lit("</td>"))), ""),
                F.lit("</tr>"),
            ),
        ),
        "",
    )
    return F.concat(F.lit("<table>" + head), body, F.lit("</table>"))

"""Sources. Each reader takes the session and a path and returns a DataFrame with a fixed schema."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predicates import any_keyword


def pad_code(c: Column) -> Column:
    """Left-pad an issuer code to six characters; longer codes stay whole."""
    t = F.trim(c)
    return F.when(F.length(t) < 6, F.lpad(t, 6, "0")).otherwise(t)


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """JSON object {code: name} per file -> (code, name)."""
    return code_map_rows(spark.read.text(path, wholetext=True))


def code_map_rows(docs: DataFrame, value: str = "value") -> DataFrame:
    """(code, name) of JSON objects."""
    entries = docs.select(F.explode(F.from_json(value, "map<string,string>")).alias("code", "name"))
    return entries.select(pad_code(F.col("code")).alias("code"), F.trim("name").alias("name"))


def named_encoding(raw: bytes) -> str | None:
    """Encoding a page says it has."""
    text = raw.lower()
    if b"euc-kr" in text or b"ks_c_5601" in text or b"cp949" in text:
        return "cp949"
    return "utf-8" if b"utf-8" in text else None


def decode_korean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes -> text: the encoding named in the head, else UTF-8 if clean, else one named anywhere, else EUC-KR.

    Bad bytes become replacement characters.
    """
    for batch in batches:
        texts, names = [], []
        for blob in batch["content"]:
            raw = bytes(blob or b"")
            name = named_encoding(raw[:2048])
            if name is None:
                try:
                    raw.decode("utf-8")
                    name = "utf-8"
                except UnicodeDecodeError:
                    name = named_encoding(raw) or "cp949"
            texts.append(raw.decode(name, errors="replace"))
            names.append(name)
        yield batch.drop(columns=["content"]).assign(text=texts, encoding=names)


def decode_documents(df: DataFrame, content: str = "content") -> DataFrame:
    """Binary documents -> text; a codec is the one thing column expressions cannot do here."""
    keep = [f for f in df.schema.fields if f.name != content]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    src = df if content == "content" else df.withColumnRenamed(content, "content")
    return src.select(*(f.name for f in keep), "content").mapInPandas(
        decode_korean, schema=schema + "text string, encoding string"
    )


def read_documents(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """HTML files of a folder as (path, text, encoding)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return decode_documents(files.select("path", "content"))


def read_legacy_csv(spark: SparkSession, path: str, columns: tuple = (2, 3)) -> DataFrame:
    """CP949 list by column position -> (code, name); quotes stripped, blank rows dropped.

    The file is decoded first and then split by the CSV expression, because the CSV source
    takes standard charsets only.
    """
    return legacy_csv_rows(decode_documents(spark.read.format("binaryFile").load(path).select("content")), columns)


def legacy_csv_rows(files: DataFrame, columns: tuple = (2, 3)) -> DataFrame:
    """The same from decoded files (column ``text``); the first line of each is its header."""
    lines = files.select(F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).where(
        (F.col("n") > 0) & (F.trim("line") != "")
    )
    width = max(columns) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    row = F.from_csv("line", schema, {"mode": "PERMISSIVE"})
    code, name = (row[f"c{i}"] for i in columns)
    return (
        lines.select(F.regexp_replace(code, "'", "").alias("code"), name.alias("name"))
        .where(F.col("code").isNotNull() & F.col("name").isNotNull())
        .select(pad_code(F.col("code")).alias("code"), "name")
    )


def read_disclosure_entries(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of {date, title, url, source}; entries without a URL are dropped."""
    rows = spark.read.schema("date string, title string, url string, source string").json(path, multiLine=True)
    return with_url(rows)


def with_url(rows: DataFrame, url: str = "url") -> DataFrame:
    return rows.where(F.coalesce(F.col(url), F.lit("")) != "")


def read_url_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines that are web addresses, trimmed."""
    return url_lines(spark.read.text(path))


def url_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    t = F.regexp_replace(F.col(value), r"(?U)^\s+|\s+$", "")
    return lines.select(t.alias("url")).where(F.col("url").startswith("http"))


def scan_filing_index(index: DataFrame, *, start: Column, end: Column, keywords: Sequence[str], day: str = "rcept_dt", name: str = "report_nm") -> DataFrame:
    """Filings of a date range whose name holds any keyword; of a store partitioned by ``day`` the range reads its partitions only."""
    rows = index.where(F.col(day).between(start, end))
    return rows.where(any_keyword(name, keywords)) if keywords else rows


def scan_daily_prices(bars: DataFrame, *, issuer: str = "issuer", day: str = "trade_date", close: str = "close", page: str | None = None) -> DataFrame:
    """Daily closes as numbers, one row per issuer and day.

    Pages overlap and come newest first, counted from 1 in ``page``: of two bars of a day the one
    on the newer page counts, whatever its figures. Bars of one page, or without pages, are ordered
    by their figures. Order is the day, never the file.
    """
    price = F.regexp_replace(F.col(close).cast("string"), ",", "").try_cast("bigint")
    rows = bars.withColumn(close, price).where(F.col(close).isNotNull())
    bar = F.struct(*(c for c in bars.columns if c not in (issuer, day, page)))
    best = F.max(bar) if page is None else F.max_by(bar, F.struct(-F.col(page), bar))
    return rows.groupBy(issuer, day).agg(best.alias("_r")).select(issuer, day, "_r.*")


def files_from_names(files: DataFrame, pattern: str, *, name: str = "name", groups: Sequence[str] = ("date", "rcept_no", "kind"), distinct: str = "rcept_no") -> DataFrame:
    """Fields read from file names; of equal receipt numbers the first name stays."""
    found = [F.regexp_extract(F.col(name), pattern, i).alias(g) for i, g in enumerate(groups, 1)]
    rows = files.where(F.col(name).rlike(pattern)).select("*", *found)
    rest = [c for c in rows.columns if c != distinct]
    return rows.groupBy(distinct).agg(F.min_by(F.struct(*rest), name).alias("_r")).select(distinct, "_r.*")


def latest_file(files: DataFrame, *, keys: Sequence[str], name: str = "name", newest: bool = True) -> DataFrame:
    """Lexicographically last (news) or first (disclosures) file per key."""
    return files.groupBy(*keys).agg((F.max if newest else F.min)(name).alias(name))


def skip_already_fetched(new: DataFrame, manifest: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """Entries the manifest does not know yet, each once.

    With a manifest that is bucketed by ``keys`` (:func:`.sinks.append_manifest`) only the new entries move.
    """
    return new.dropDuplicates(list(keys)).join(manifest.select(*keys), list(keys), "left_anti")

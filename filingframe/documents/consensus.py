"""Consensus tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_eok_float
from ..functions.text import strip_tags


def consensus_rows(docs: DataFrame, *, keys: Sequence[str], html: str = "html") -> DataFrame:
    """Estimates per year: the first table is a decoy, columns ending in ``(E)`` count, values
    stand in cell titles. Operating income as announced wins over the plain line."""
    real = F.regexp_extract(html, r"(?s)</table>(.*)$", 1)
    heads = F.regexp_extract_all(real, F.lit(r"(20\d{2}/\d{2}(?:\(E\))?)"), F.lit(1))
    trs = F.regexp_extract_all(real, F.lit(r"(?s)<tr>(.*?)</tr>"), F.lit(1))
    step = docs.select(*keys, heads.alias("_h"), trs.alias("_trs"))
    label = lambda r: F.trim(F.replace(strip_tags(F.regexp_extract(r, r"(?s)<th[^>]*class=\"[^\"]*title[^\"]*\"[^>]*>(.*?)</th>", 1)), F.lit(" "), F.lit("")))
    rows = F.transform(
        "_trs",
        lambda r: F.struct(label(r).alias("label"), F.regexp_extract_all(r, F.lit(r"<td[^>]*title=\"([^\"]*)\""), F.lit(1)).alias("values")),
    )
    step = step.select(*keys, "_h", F.filter(rows, lambda r: (r["label"] != "") & (F.size(r["values"]) > 0)).alias("_r"))
    step = step.select(*keys, "_r", F.posexplode("_h").alias("_n", "_head"))

    def known(name: str) -> Column:
        return F.exists("_r", lambda r: r["label"] == name)

    def value(name: Column | str) -> Column:
        # a repeated label: the last row counts
        row = F.try_element_at(F.filter("_r", lambda r: r["label"] == name), F.lit(-1))
        return parse_eok_float(F.get(row["values"], F.col("_n")))

    income = F.when(known("영업이익(발표기준)"), F.lit("영업이익(발표기준)")).otherwise(F.lit("영업이익"))
    out = step.where(F.col("_head").endswith("(E)")).select(
        *keys, F.substring("_head", 1, 4).cast("bigint").alias("fy"), value("매출액").alias("revenue"),
        value(income).alias("operating_income"), value("당기순이익").alias("net_income"),
    )
    return out.where(F.coalesce("revenue", "operating_income", "net_income").isNotNull())


_ANNUAL = (
    "struct<financeInfo:struct<trTitleList:array<struct<key:string,title:string,isConsensus:string>>,"
    "rowList:array<struct<title:string,columns:map<string,struct<value:string>>>>>>"
)


def consensus_json(docs: DataFrame, *, keys: Sequence[str], body: str = "body") -> DataFrame:
    """The same from the JSON form of the annual finance page."""
    info = F.from_json(body, _ANNUAL)["financeInfo"]
    step = docs.select(*keys, info["rowList"].alias("_rows"), F.explode(info["trTitleList"]).alias("_c"))

    def value(name: str) -> Column:
        row = F.try_element_at(F.filter("_rows", lambda r: r["title"] == name), F.lit(-1))
        return parse_eok_float(F.try_element_at(row["columns"], F.col("_c")["key"])["value"])

    return step.where(F.col("_c")["isConsensus"] == "Y").select(
        *keys, F.regexp_extract(F.col("_c")["title"], r"^(\d{4})", 1).try_cast("bigint").alias("fy"),
        value("매출액").alias("revenue"), value("영업이익").alias("operating_income"), value("당기순이익").alias("net_income"),
    )

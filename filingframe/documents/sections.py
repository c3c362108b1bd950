"""Sections of Markdown notes and of running text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRONT = "__frontmatter__"
PREAMBLE = "__preamble__"


def split_sections(notes: DataFrame, *, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Front matter, preamble and ``## `` sections, one row each with their position."""
    front = F.regexp_extract(text, r"(?s)^(---\s*\r?\n.*?\r?\n---\s*\r?\n?)", 1)
    rest = F.substring(F.col(text), F.length(front) + 1, F.length(text))
    # a line feed in front lets the first line be a header too
    parts = F.split(F.concat(F.lit("\n"), rest), r"\n(?=## )")
    body = F.transform(
        parts,
        lambda p, i: F.when(
            i == 0, F.struct(F.lit(PREAMBLE).alias("header"), F.substring(p, F.lit(2), F.length(p)).alias("body"))
        ).otherwise(
            F.struct(
                F.trim(F.regexp_extract(p, r"^([^\n]*)", 1)).alias("header"), F.regexp_replace(p, r"^[^\n]*\n?", "").alias("body")
            )
        ),
    )
    first = F.array(F.struct(F.lit(FRONT).alias("header"), front.alias("body")))
    return notes.select(*keys, F.posexplode(F.concat(first, body)).alias("ord", "_s")).select(*keys, "ord", "_s.*")


def bracket_sections(notes: DataFrame, *, keys: Sequence[str], known: Sequence[str], text: str = "text") -> DataFrame:
    """``[header]`` sections; only known names open a section, a repeated one counts last."""
    names = "|".join(known)
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), rf"\n(?=\[(?:{names})\]\s*(?:\n|$))")
    named = F.transform(
        F.filter(parts, lambda p, i: p.rlike(rf"^\[(?:{names})\]")),
        lambda p: F.struct(
            F.regexp_extract(p, r"^\[([^\]]*)\]", 1).alias("header"), F.trim(F.regexp_replace(p, r"^\[[^\]]*\][^\n]*\n?", ""), F.lit(" \n")).alias("body")
        ),
    )
    rows = notes.select(*keys, F.posexplode(named).alias("ord", "_s")).select(*keys, "ord", "_s.*")
    last = rows.groupBy(*keys, "header").agg(F.max_by("body", "ord").alias("body"), F.max("ord").alias("ord"))
    return last.select(*keys, "ord", "header", "body")


def tidy_section(c: Column) -> Column:
    """Section without a closing rule or code fence."""
    t = F.trim(c, F.lit(" \n\t\r"))
    t = F.trim(F.regexp_replace(t, r"\n---\s*$", ""), F.lit(" \n\t\r"))
    return F.trim(F.regexp_replace(t, r"\n```\s*$", ""), F.lit(" \n\t\r"))


# --- fixed values: analysis headings ------------------------------------------------------------
_ANALYSIS = {
    "investment_ideas": r"(?s)## 5\.\s*투자 아이디어\s*\n(.*?)(?=## 6\.|$)",
    "conclusion": r"(?s)## 7\.\s*결론\s*\n(.*?)$",
    "value_driver": r"(?s)Value Driver[^\n]*?:[ \t]*(.*?)(?=\n\s*(?:-?\s*\*{0,2}|#{1,4}\s+)경쟁사 비교|\n## 5\.|\Z)",
    "competitors": r"(?s)경쟁사 비교[^\n:]*:?\s*(.*?)(?=\n## 5\.|\Z)",
}
_VALUE_DRIVER_LINE = r"(?s)Value Driver[^\n]*\n(.*?)(?=\n\s*(?:-?\s*\*{0,2}|#{1,4}\s+)경쟁사 비교|\n## 5\.|\Z)"
_RISKS = {
    "risk_structural": r"(?s)\*{0,2}구조적 (?:위험|리스크)\*{0,2}[:\s]*(.+?)(?=\n-?\s*\*{0,2}반론|\n-?\s*\*{0,2}Tail|$)",
    "risk_counter": r"(?s)\*{0,2}반론[^\n:]*\*{0,2}[:\s]*(.+?)(?=\n-?\s*\*{0,2}Tail|$)",
    "risk_tail": r"(?s)\*{0,2}Tail Risk\*{0,2}[:\s]*(.+?)$",
}


def analysis_sections(notes: DataFrame, *, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Ideas, three kinds of risk, conclusion, value driver and competitors of an analysis text."""
    t = F.trim(F.col(text), F.lit(" \n\t\r"))
    t = F.regexp_replace(F.regexp_replace(t, r"^```(?:markdown)?\s*\n", ""), r"\n```\s*$", "")
    step = notes.select(*keys, t.alias("_t"))
    one = {name: tidy_section(F.regexp_extract("_t", p, 1)) for name, p in _ANALYSIS.items()}
    direct = one["value_driver"]
    one["value_driver"] = F.when(F.length(direct) > 5, direct).otherwise(tidy_section(F.regexp_extract("_t", _VALUE_DRIVER_LINE, 1)))
    for name in ("value_driver", "competitors"):
        one[name] = F.when(F.length(one[name]) > 5, one[name]).otherwise("")
    risk = F.trim(F.regexp_extract("_t", r"(?s)## 6\.\s*리스크[^\n]*?\n(.*?)(?=## 7\.|$)", 1), F.lit(" \n\t\r"))
    risk = F.regexp_replace(F.regexp_replace(risk, r"^>\s*\[!warning\][^\n]*\n?", ""), r"^>\s*[^\n]*\n?", "")
    step = step.withColumns({**one, "_risk": F.trim(risk, F.lit(" \n\t\r"))})

    def item(p: str) -> Column:
        found = F.regexp_replace(F.trim(F.regexp_extract("_risk", p, 1), F.lit(" \n\t\r")), r"^- ", "")
        return tidy_section(F.regexp_replace(found, r"\n-\s*$", ""))

    risks = {n: item(p) for n, p in _RISKS.items()}
    none = (risks["risk_structural"] == "") & (risks["risk_counter"] == "")
    risks["risk_structural"] = F.when(none, tidy_section(F.col("_risk"))).otherwise(risks["risk_structural"])
    return step.withColumns(risks).select(*keys, "investment_ideas", *_RISKS, "conclusion", "value_driver", "competitors")


def backlog_subsection(c: Column | str, limit: int | None = None) -> Column:
    """Order-backlog part of a sales section, else from the table caption on, else the section.

    ``limit`` keeps so many characters from the start of the part, or from the end of the section.
    """
    t = F.col(c) if isinstance(c, str) else c
    tries = [
        F.nullif(F.regexp_extract(t, rf"(?s)({p}.*)", 1), F.lit("")) for p in (r"다\.\s*수주", r"다\)\s*수주", r"[Cc]\.\s*수주")
    ]
    caption = F.nullif(F.regexp_extract(t, r"(?s)(.{0,500}수주잔[고량].*)", 1), F.lit(""))
    if limit is None:
        return F.coalesce(*tries, caption, t)
    end = F.when(F.length(t) > limit, F.right(t, F.lit(limit))).otherwise(t)
    return F.coalesce(*(F.substring(x, 1, limit) for x in tries), F.substring(caption, 1, limit + 500), end)


def strip_summary(c: Column | str) -> Column:
    """Revenue text without the aggregate block after the last subtotal."""
    t = F.col(c) if isinstance(c, str) else c
    lines = F.split(t, "\n")
    last = F.array_max(F.transform(lines, lambda x, i: F.when(F.trim(x) == "소계", i.cast("int"))))
    start = F.array_min(F.transform(lines, lambda x, i: F.when((i > last) & F.trim(x).rlike(r"(?U)^합계\b"), i.cast("int"))))
    end = F.coalesce(
        F.array_min(F.transform(lines, lambda x, i: F.when((i > start) & F.trim(x).rlike(r"^[가-힣]\.\s"), i.cast("int")))), F.size(lines)
    )
    kept = F.filter(lines, lambda x, i: (i < start) | (i >= end))
    return F.when(start.isNotNull(), F.array_join(kept, "\n")).otherwise(t)

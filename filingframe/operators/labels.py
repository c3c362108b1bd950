"""Account label rules as column expressions.

A rule table holds a few dozen labels, so it is compiled into the expression itself: no join,
no shuffle, and the match stays inside code generation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Mapping[str, Sequence[str]]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _part_match(account: Column, pattern: str, exclusions: Rules) -> Column:
    hit = F.contains(account, F.lit(pattern))
    for word in exclusions.get(pattern, ()):
        hit = hit & ~F.contains(account, F.lit(word))
    return hit


def label_rank(account: Column | str, patterns: Sequence[str], exclusions: Rules) -> Column:
    """Rank of the best match (lower wins), NULL without one.

    Pattern order comes first; within one pattern an equal label beats a contained one.
    """
    account = _col(account)
    out = None
    for n, pattern in enumerate(patterns):
        exact = account == pattern
        part = _part_match(account, pattern, exclusions)
        out = (F if out is None else out).when(exact, F.lit(2 * n)).when(part, F.lit(2 * n + 1))
    return out


def field_of_label(account: Column | str, rules: Rules, exclusions: Rules) -> Column:
    """Field of a row: equal labels of any field come before contained ones."""
    account = _col(account)
    out = None
    for field, patterns in rules.items():
        out = (F if out is None else out).when(account.isin(*patterns), F.lit(field))
    for field, patterns in rules.items():
        for pattern in patterns:
            out = out.when(_part_match(account, pattern, exclusions), F.lit(field))
    return out


def match_accounts(lines: DataFrame, rules: Rules, exclusions: Rules, *, account: str = "account_nm") -> DataFrame:
    """Long form of the label match: one row per (line, field) with its ``match_rank``."""
    hits = F.array(
        *(
            F.struct(F.lit(f).alias("field"), label_rank(account, p, exclusions).alias("match_rank"))
            for f, p in rules.items()
        )
    )
    hits = F.filter(hits, lambda h: h["match_rank"].isNotNull())
    return lines.select("*", F.explode(hits).alias("_h")).select(*lines.columns, "_h.*")

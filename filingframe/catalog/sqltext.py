"""SQL fragments shared by the check queries."""

from __future__ import annotations


def yoy(cur: str, prev: str, display: bool = True) -> str:
    none = "'-'" if display else "NULL"
    zero = f"CASE WHEN {cur}>0 THEN '흑자전환' WHEN {cur}<0 THEN '적자전환' ELSE '-' END" if display else "NULL"
    return (
        f"CASE WHEN ({cur}) IS NULL OR ({prev}) IS NULL THEN {none} WHEN {cur}>0 AND {prev}<0 THEN '흑자전환'"
        f" WHEN {cur}<0 AND {prev}>0 THEN '적자전환'"
        f" WHEN {cur}<0 AND {prev}<0 THEN CASE WHEN abs({cur})<abs({prev}) THEN '적자축소'"
        f" WHEN abs({cur})>abs({prev}) THEN '적자확대' ELSE '적자지속' END"
        f" WHEN {prev}=0 THEN {zero} ELSE {pct(cur, prev)} END"
    )


def pct(cur: str, prev: str) -> str:
    r = f"(CAST(({cur})-({prev}) AS DOUBLE)/abs({prev})*100)"
    return (
        f"(CASE WHEN {r}>=0 THEN '+' ELSE '-' END || CAST(CAST(abs(round_even({r},0)) AS BIGINT) AS VARCHAR) || '%')"
    )


def eok(v: str, unit: str = "100000000.0") -> str:
    return f"CAST(round_even(CAST({v} AS DOUBLE)/{unit},0) AS BIGINT)"


def thousands(v: str) -> str:
    return f"format('{{:,}}', {v})"


def amount(c: str) -> str:
    """Statement amount text as an integer."""
    return (
        f"CAST(trunc(TRY_CAST(nullif(nullif(replace(replace({c},',',''),' ',''),'-'),'') AS DOUBLE)) AS BIGINT)"
    )


def num(c: str) -> str:
    """Korean number text as an integer."""
    return (
        f"CAST(trunc(TRY_CAST(nullif(nullif(regexp_replace({c},'[원주%,\\s]','','g'),'-'),'') AS DOUBLE)) AS BIGINT)"
    )


def floor_div(a: str, b: str) -> str:
    """Exact floor for a positive divisor."""
    return f"((({a}) - ((({a}) % ({b})) + ({b})) % ({b})) // ({b}))"

"""Fiscal-year rows: all quarters and sources of a year side by side.

Rules between quarters and sources (gap fill, differences, fourth quarters) need no self-joins
in this form: the sources are united, shuffled once by (issuer, fy) and combined while they
are grouped; each rule is then an expression over the columns of its row.

A slot such as ``q2`` owns the columns ``q2_has`` and ``q2_<measure>``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUARTERS = (1, 2, 3, 4)


def quarter_source(tag: str, df: DataFrame, quarters: Sequence[int] = QUARTERS) -> dict:
    """Source of quarters: the rows, the slot of each row and all slots."""
    rows = df.where(F.col("fq").isin(*quarters))
    return {tag: (rows, F.concat(F.lit(tag), F.col("fq").cast("string")), [f"{tag}{n}" for n in quarters])}


def annual_source(tag: str, df: DataFrame) -> dict:
    return {tag: (df, F.lit(f"{tag}0"), [f"{tag}0"])}


def performance_source(perf: DataFrame) -> dict:
    """Notices as full years (``pa``), plain quarters (``p``) and spans (``c``), read once."""
    fq = F.col("fq")
    number = fq.cast("string")
    slot = F.when(fq == 0, F.lit("pa0")).when(~F.col("cumulative"), F.concat(F.lit("p"), number)).when(fq.isin(2, 3), F.concat(F.lit("c"), number))
    return {"p": (perf.where(slot.isNotNull()), slot, ["pa0", *(f"p{n}" for n in QUARTERS), "c2", "c3"])}


def year_slots(sources: Mapping[str, tuple], measures: Sequence[str]) -> DataFrame:
    """One row per (issuer, fy) with the slots of every source."""
    united = None
    for df, slot, _ in sources.values():
        part = df.select("issuer", "fy", slot.alias("_slot"), *measures)
        united = part if united is None else united.unionByName(part)
    aggs = []
    for slot in (s for _, _, slots in sources.values() for s in slots):
        here = f"_slot = '{slot}'"
        aggs.append(F.expr(f"max({here}) AS {slot}_has"))
        aggs += [F.expr(f"max(CASE WHEN {here} THEN `{m}` END) AS `{slot}_{m}`") for m in measures]
    return united.groupBy("issuer", "fy").agg(*aggs)


def _full(slot: str, measures: Sequence[str]) -> Column:
    return F.coalesce(*(F.col(f"{slot}_{m}") for m in measures)).isNotNull()


def put(wide: DataFrame, old: str, new: str, measures: Sequence[str], when: Column | None = None) -> DataFrame:
    """Take the new slot where the old one is wholly empty or absent."""
    arrives = F.col(f"{new}_has") if when is None else F.col(f"{new}_has") & when
    arrives = F.coalesce(arrives, F.lit(False))
    take = arrives & ~_full(old, measures)
    return wide.withColumns(
        {
            f"{old}_has": F.col(f"{old}_has") | arrives,
            **{f"{old}_{m}": F.when(take, F.col(f"{new}_{m}")).otherwise(F.col(f"{old}_{m}")) for m in measures},
        }
    )


def put_quarters(wide: DataFrame, old: str, new: str, measures: Sequence[str], quarters: Sequence[int] = QUARTERS) -> DataFrame:
    for n in quarters:
        wide = put(wide, f"{old}{n}", f"{new}{n}", measures)
    return wide


def merge_performance(wide: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Notices into quarters: plain ones, then half year - Q1, then nine months - (Q1 + Q2)."""
    wide = put_quarters(wide, "q", "p", measures)
    # a half year needs a non-empty Q1
    wide = wide.withColumns({f"c2_{m}": F.col(f"c2_{m}") - F.col(f"q1_{m}") for m in measures})
    wide = put(wide, "q2", "c2", measures, _full("q1", measures) & _full("c2", measures))
    both = {m: F.col(f"q1_{m}") + F.col(f"q2_{m}") for m in measures}
    none = F.coalesce(*both.values()).isNull()
    known = _full("q1", measures) & _full("q2", measures)
    wide = wide.withColumns(
        {f"c3_{m}": F.when(none, F.col(f"c3_{m}")).otherwise(F.col(f"c3_{m}") - both[m]) for m in measures}
    )
    return put(wide, "q3", "c3", measures, known & _full("c3", measures))


def fill_from_ytd(wide: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Absent fields of existing quarters: Q1 from the report, Q2 = H1 - Q1, Q3 = 9M - H1.

    The subtraction uses Q1 as filled; without any Q1 figure the half year stands as is, and
    Q3 needs a non-empty half year.
    """
    wide = wide.withColumns(
        {f"q1_{m}": F.when(F.col("q1_has"), F.coalesce(f"q1_{m}", f"y1_{m}")) for m in measures}
    )
    alone, half = ~_full("q1", measures), _full("y2", measures)
    second = {
        f"q2_{m}": F.coalesce(
            F.col(f"q2_{m}"),
            F.when(
                F.col("q2_has"),
                F.when(alone, F.col(f"y2_{m}")).otherwise(F.col(f"y2_{m}") - F.col(f"q1_{m}")),
            ),
        )
        for m in measures
    }
    third = {
        f"q3_{m}": F.coalesce(
            F.col(f"q3_{m}"), F.when(F.col("q3_has") & half, F.col(f"y3_{m}") - F.col(f"y2_{m}"))
        )
        for m in measures
    }
    return wide.withColumns({**second, **third})


def fill_q4(wide: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Empty fourth quarter = annual - Q1 - Q2 - Q3.

    All four records must be non-empty, annual revenue positive and Q1..Q3 revenue within it; a
    field is filled only from four present values.
    """
    revenue = measures[0]
    zero = F.lit(0).cast("bigint")
    part = zero
    for n in (1, 2, 3):
        part = part + F.coalesce(F.col(f"q{n}_{revenue}"), zero)
    usable = F.col("q4_has") & ~_full("q4", measures)
    for slot in ("q1", "q2", "q3"):
        usable = usable & _full(slot, measures)
    usable = F.coalesce(usable & (F.col(f"a0_{revenue}") > 0) & (part <= F.col(f"a0_{revenue}")), F.lit(False))
    return wide.withColumns(
        {
            f"q4_{m}": F.when(
                usable, F.col(f"a0_{m}") - F.col(f"q1_{m}") - F.col(f"q2_{m}") - F.col(f"q3_{m}")
            ).otherwise(F.col(f"q4_{m}"))
            for m in measures
        }
    )


def quarter_rows(wide: DataFrame, measures: Sequence[str], tag: str = "q") -> DataFrame:
    """Back to one row per existing quarter."""
    rows = F.array(
        *(
            F.when(
                F.col(f"{tag}{n}_has"),
                F.struct(F.lit(n).cast("bigint").alias("fq"), *(F.col(f"{tag}{n}_{m}").alias(m) for m in measures)),
            )
            for n in QUARTERS
        )
    )
    return wide.select("issuer", "fy", F.explode(F.array_compact(rows)).alias("_r")).select("issuer", "fy", "_r.*")


def annual_rows(wide: DataFrame, measures: Sequence[str], slot: str = "a0") -> DataFrame:
    return wide.where(F.col(f"{slot}_has")).select(
        "issuer", "fy", *(F.col(f"{slot}_{m}").alias(m) for m in measures)
    )


# -- the rules on their own ----------------------------------------------------------------------


def integrate_performance(quarters: DataFrame, perf: DataFrame, *, measures: Sequence[str]) -> DataFrame:
    """Quarters with earnings notices merged in; existing non-empty records stay."""
    wide = year_slots({**quarter_source("q", quarters), **performance_source(perf)}, measures)
    return quarter_rows(merge_performance(wide, measures), measures)


def integrate_performance_annual(annual: DataFrame, perf: DataFrame, *, measures: Sequence[str]) -> DataFrame:
    """Annual records with full-year notices merged in."""
    wide = year_slots({**annual_source("a", annual), **quarter_source("pa", perf, (0,))}, measures)
    return annual_rows(put(wide, "a0", "pa0", measures), measures)


def integrate_preliminary(quarters: DataFrame, preliminary: DataFrame, *, measures: Sequence[str]) -> DataFrame:
    """Quarters with preliminary results merged in."""
    wide = year_slots({**quarter_source("q", quarters), **quarter_source("r", preliminary)}, measures)
    return quarter_rows(put_quarters(wide, "q", "r", measures), measures)


def fill_from_cumulative(quarters: DataFrame, ytd: DataFrame, *, measures: Sequence[str]) -> DataFrame:
    wide = year_slots({**quarter_source("q", quarters), **quarter_source("y", ytd, (1, 2, 3))}, measures)
    return quarter_rows(fill_from_ytd(wide, measures), measures)


def q4_backfill(quarters: DataFrame, annual: DataFrame, *, measures: Sequence[str]) -> DataFrame:
    wide = year_slots({**quarter_source("q", quarters), **annual_source("a", annual)}, measures)
    return quarter_rows(fill_q4(wide, measures), measures)


def standalone_from_cumulative(ytd: DataFrame, *, measures: Sequence[str]) -> DataFrame:
    """Standalone quarters from year-to-date figures (4 = full year).

    A wholly empty or absent earlier span lets the later figure stand as is; a single missing
    earlier field makes only that field NULL.
    """
    wide = year_slots(quarter_source("y", ytd), measures)
    out = {}
    for n in QUARTERS:
        for m in measures:
            later = F.col(f"y{n}_{m}")
            if n == 1:
                out[f"q1_{m}"] = later
            else:
                alone = ~_full(f"y{n - 1}", measures)
                out[f"q{n}_{m}"] = F.when(alone, later).otherwise(later - F.col(f"y{n - 1}_{m}"))
        out[f"q{n}_has"] = F.col(f"y{n}_has")
    return quarter_rows(wide.withColumns(out), measures)

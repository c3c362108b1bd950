"""Instrument state from notes, decisions, exercises and price adjustments, for all issuers.

Every rule of the state machine that routes a record by key, series or an unchanging price is
an aggregate: the first or last present value per (instrument, field). Aggregates combine
before the shuffle, so an issuer with a third of all records is no heavier than its handful of
instruments. Only price adjustments without a series depend on the running state; those go
through :mod:`.fold`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import compact_period_date, format_period
from ..functions.numbers import floor_div, format_thousands, to_eok
from ..operators.joins import enrich_missing, overwrite_present
from ..operators.predicates import category_of_exercise, has_position, infer_bond_category, not_expired
from . import schemas as sc

STATE = ["issuer", "instrument_key", "inserted", *sc.FIELDS]


def _zero(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("bigint")


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _at(phase: int, order: Column | str = "ord") -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.struct(F.lit(phase).alias("phase"), order.cast("bigint").alias("ord"))


def _present(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def _first(value: Column, order: Column) -> Column:
    """First value that is present, by order."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def _last(value: Column, order: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), order))


def _derived_shares(shares: Column, face: Column, price: Column) -> Column:
    """Stated shares, else face / price where the price is credible."""
    return F.when(shares != 0, shares).when(price >= sc.MIN_PRICE, floor_div(face, price)).otherwise(0).cast("bigint")


def instrument_key(category: Column, series: Column, kind: Column, receipt: Column) -> Column:
    """``CB_n``, ``BW_n``, ``PERPETUAL_n``, ``SO_n``, ``RIGHTS_<receipt>``, ``PREF_<kind>``."""
    n = F.coalesce(series, F.lit(0)).cast("string")
    return (
        F.when(category.isin("CB", "BW", "PERPETUAL"), F.concat(category, F.lit("_"), n))
        .when(category.isin("SO", "STOCK_OPTION"), F.concat(F.lit("SO_"), n))
        .when(category.isin("RIGHTS_ISSUE", "MIXED_ISSUE"), F.concat(F.lit("RIGHTS_"), _text(receipt)))
        .otherwise(F.concat(F.lit("PREF_"), F.regexp_replace(_text(kind), " ", "_")))
    )


def empty_state(spark) -> DataFrame:
    return spark.createDataFrame([], sc.INSTRUMENT)


def replace_by_key(state: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Rows take the place of equal keys; a replaced key keeps its position."""
    if state is None:
        return rows.select(*STATE)
    both = state.select(*STATE, F.lit(0).alias("_v")).unionByName(rows.select(*STATE, F.lit(1).alias("_v")))
    return (
        both.groupBy("issuer", "instrument_key")
        .agg(F.min("inserted").alias("inserted"), F.max_by(F.struct(*sc.FIELDS), "_v").alias("_f"))
        .select("issuer", "instrument_key", "inserted", "_f.*")
    )


def apply_notes(notes: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Baseline from the notes, the authoritative source: the last record of a key wins.

    Options carry no balance. Others show their balance, else the face value, and hold shares
    only while something remains.
    """
    option = F.col("category") == "SO"
    left = F.when(option, F.lit(0).cast("bigint")).otherwise(F.coalesce("remaining_balance", _zero("face_value")))
    shares = F.when(option | (left > 0), _zero("convertible_shares")).otherwise(0)
    key = instrument_key(F.col("category"), F.col("series"), F.col("kind"), F.lit(""))
    rows = notes.select(
        "issuer",
        "ord",
        key.alias("instrument_key"),
        F.struct(
            F.col("category"),
            _zero("series").alias("series"),
            _text("kind").alias("kind"),
            _zero("face_value").alias("face_value"),
            left.alias("remaining"),
            _zero("conversion_price").alias("conversion_price"),
            shares.cast("bigint").alias("convertible_shares"),
            _text("exercise_start").alias("exercise_start"),
            _text("exercise_end").alias("exercise_end"),
        ).alias("_f"),
    )
    latest = rows.groupBy("issuer", "instrument_key").agg(
        _at(1, F.min("ord")).alias("inserted"), F.max_by("_f", "ord").alias("_f")
    )
    return replace_by_key(state, latest.select("issuer", "instrument_key", "inserted", "_f.*"))


def apply_issuance(issuances: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Bond issuance documents: replace the key; exchangeable bonds and unnumbered ones are out."""
    category = infer_bond_category("kind")
    price, face = _zero("conversion_price"), _zero("face_value")
    rows = issuances.where(F.col("series").isNotNull() & category.isNotNull()).select(
        "issuer",
        "ord",
        F.concat(category, F.lit("_"), F.col("series").cast("string")).alias("instrument_key"),
        F.struct(
            category.alias("category"),
            F.col("series").cast("bigint").alias("series"),
            _text("kind").alias("kind"),
            face.alias("face_value"),
            face.alias("remaining"),
            price.alias("conversion_price"),
            _derived_shares(_zero("convertible_shares"), face, price).alias("convertible_shares"),
            _text("exercise_start").alias("exercise_start"),
            _text("exercise_end").alias("exercise_end"),
        ).alias("_f"),
    )
    latest = rows.groupBy("issuer", "instrument_key").agg(
        _at(0, F.min("ord")).alias("inserted"), F.max_by("_f", "ord").alias("_f")
    )
    return replace_by_key(state, latest.select("issuer", "instrument_key", "inserted", "_f.*"))


def _rights_keys(rights: DataFrame, state: DataFrame | None) -> DataFrame:
    """Key of each rights decision, and ``first_ord``, the position of the record that opened it.

    With a receipt number the key is the receipt. Without one the record joins the earliest
    rights instrument of the same issuer and share count, a known one first, or opens one under its
    document date. If another share count opens the same date again, it takes the place of the
    former instrument: only the records from there on count.
    """
    has = _text("rcept_no") != ""
    own = F.concat(F.lit("RIGHTS_"), F.when(has, F.col("rcept_no")).otherwise(_text("pdf_date")))
    keyed = rights.withColumn("_own", own).withColumn("_has", has)
    at = lambda known, phase, ord_: F.struct(F.lit(known).alias("k"), phase.cast("int").alias("p"), ord_.cast("bigint").alias("o"))
    opened = keyed.groupBy("issuer", "shares", "_own").agg(F.min(at(1, F.lit(2), F.col("ord"))).alias("_at"))
    if state is not None:
        known = state.where(F.col("instrument_key").startswith("RIGHTS_") & (F.col("convertible_shares") > 0))
        opened = opened.unionByName(known.select(
            "issuer", F.col("convertible_shares").alias("shares"), F.col("instrument_key").alias("_own"),
            at(0, F.col("inserted")["phase"], F.col("inserted")["ord"]).alias("_at"),
        ))
    earliest = opened.groupBy("issuer", "shares").agg(F.min_by("_own", "_at").alias("_match"))
    keyed = keyed.join(earliest, ["issuer", "shares"]).withColumn("instrument_key", F.when(F.col("_has"), F.col("_own")).otherwise(F.col("_match")))
    dated = ~F.col("_has") & (F.col("instrument_key") == F.col("_own"))
    whole = Window.partitionBy("issuer", "instrument_key")  # the decisions of one date, or of one receipt
    keyed = keyed.withColumn("first_ord", F.min("ord").over(whole)).withColumn("_last", F.max_by(F.when(dated, F.col("shares")), F.when(dated, F.col("ord"))).over(whole))
    keyed = keyed.withColumn("_cut", F.max(F.when(dated & (F.col("shares") != F.col("_last")), F.col("ord"))).over(whole))
    return keyed.where(F.col("_cut").isNull() | (F.col("ord") > F.col("_cut")))


def apply_events(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Decisions after the notes: enrich what a known instrument lacks, open unknown ones.

    Bonds and rights keep the first present value of each field. Options are the other way
    round: the decision is newer than the notes, so the last present value wins.
    """
    cat = F.col("category")
    rights_like = cat.isin("RIGHTS_ISSUE", "MIXED_ISSUE")
    share_based = rights_like | (cat == "STOCK_OPTION")
    shares = F.coalesce(
        _present(F.col("shares")), F.when(cat == "STOCK_OPTION", _present(F.col("convertible_shares"))), F.lit(0)
    )
    usable = events.withColumn("shares", shares.cast("bigint")).where(~share_based | (F.col("shares") > 0))
    rights = _rights_keys(usable.where(rights_like), state).select(*usable.columns, "instrument_key", "first_ord")
    others = usable.where(cat.isin("CB", "BW", "PERPETUAL", "STOCK_OPTION")).withColumn(
        "instrument_key", instrument_key(cat, F.col("series"), F.col("kind"), F.lit(""))
    ).withColumn("first_ord", F.col("ord"))
    o = F.col("ord")
    option = cat == "STOCK_OPTION"
    price = F.coalesce(
        F.when(option, F.coalesce(_present(F.col("exercise_price")), _present(F.col("conversion_price")))).otherwise(
            F.coalesce(_present(F.col("conversion_price")), F.when(rights_like, _present(F.col("issue_price"))))
        )
    )
    face = F.when(~option, _present(F.col("face_value")))
    stated = F.when(share_based, F.col("shares")).otherwise(_present(F.col("convertible_shares")))
    start, end = F.nullif(F.col("cv_start"), F.lit("")), F.nullif(F.col("cv_end"), F.lit(""))
    rows = others.unionByName(rights).withColumns(
        {
            "_price": price, "_face": face, "_stated": stated, "_start": start, "_end": end,
            # the record that opens an unknown bond may derive its shares
            "_open": F.when(
                ~share_based, _present(_derived_shares(_zero(stated), _zero(face), _zero(price)))
            ).otherwise(stated),
            "_rights": rights_like,
            "_cat": F.when(rights_like, F.lit(sc.RIGHTS_CATEGORY)).when(option, F.lit(sc.OPTION_CATEGORY))
            .when(cat == "PERPETUAL", F.lit(sc.EVENT_CATEGORY["PERPETUAL"])).otherwise(cat),
            "_kind": F.when(rights_like, _text("share_type")).otherwise(_text("kind")),
            "_series": F.when(rights_like, F.lit(0)).otherwise(_zero("series")).cast("bigint"),
        }
    )
    per = rows.groupBy("issuer", "instrument_key").agg(
        F.min("first_ord").alias("ord"),
        F.min_by(F.struct("_cat", "_kind", "_series"), "ord").alias("_new"),
        F.max(option).alias("_option"),
        *(_first(F.col(f"_{n}"), o).alias(f"f_{n}") for n in ("price", "face", "stated", "start", "end")),
        *(_last(F.col(f"_{n}"), o).alias(f"l_{n}") for n in ("price", "stated", "start", "end")),
        F.min_by("_open", "ord").alias("_open"),
        F.min_by("_face", "ord").alias("_open_face"),
        F.max("_rights").alias("_rights"),
    )
    pick = lambda n: F.when(F.col("_option"), F.col(f"l_{n}")).otherwise(F.col(f"f_{n}"))
    found = per.select(
        "issuer",
        "instrument_key",
        "ord",
        "_new",
        "_option",
        pick("price").alias("e_price"),
        # a later rights record adds terms but no face value
        F.when(F.col("_rights"), F.col("_open_face")).otherwise(F.col("f_face")).alias("e_face"),
        pick("stated").alias("e_shares"),
        F.when(F.col("_option"), F.col("l_stated")).otherwise(F.coalesce("_open", "f_stated")).alias("e_open_shares"),
        pick("start").alias("e_start"),
        pick("end").alias("e_end"),
    )
    opened = found.select(
        "issuer",
        "instrument_key",
        _at(2).alias("inserted"),
        F.col("_new")["_cat"].alias("category"),
        F.col("_new")["_series"].alias("series"),
        F.col("_new")["_kind"].alias("kind"),
        _zero("e_face").alias("face_value"),
        _zero("e_face").alias("remaining"),
        _zero("e_price").alias("conversion_price"),
        _zero("e_open_shares").alias("convertible_shares"),
        _text("e_start").alias("exercise_start"),
        _text("e_end").alias("exercise_end"),
    )
    if state is None:
        return opened
    known = state.select(*STATE).join(found, ["issuer", "instrument_key"], "left")
    opt = F.coalesce(F.col("_option"), F.lit(False))

    def merged(field: str, new: str, blank: Column) -> Column:
        have, fresh = F.col(field), F.col(new)
        return F.when(opt, F.coalesce(fresh, have)).otherwise(F.coalesce(F.nullif(have, blank), fresh, have))

    no_face = (F.col("face_value") == 0) & F.col("e_face").isNotNull() & ~opt
    enriched = known.select(
        "issuer",
        "instrument_key",
        "inserted",
        "category",
        "series",
        "kind",
        F.when(no_face, F.col("e_face")).otherwise(F.col("face_value")).alias("face_value"),
        F.when(no_face, F.col("e_face")).otherwise(F.col("remaining")).alias("remaining"),
        merged("conversion_price", "e_price", F.lit(0)).alias("conversion_price"),
        merged("convertible_shares", "e_shares", F.lit(0)).alias("convertible_shares"),
        merged("exercise_start", "e_start", F.lit("")).alias("exercise_start"),
        merged("exercise_end", "e_end", F.lit("")).alias("exercise_end"),
    )
    fresh = opened.join(state.select("issuer", "instrument_key"), ["issuer", "instrument_key"], "left_anti")
    return enriched.unionByName(fresh)


def apply_rights_documents(documents: DataFrame, state: DataFrame) -> DataFrame:
    """Rights documents: enrich the first rights instrument with the same price, else open one.

    Columns: issuer, ord, disclosure_date, other_shares, conversion_price, conversion_shares,
    issue_price, funding, share_type, exercise_start, exercise_end.
    """
    price = F.coalesce(_present(F.col("conversion_price")), _present(F.col("issue_price")), F.lit(0)).cast("bigint")
    shares = F.coalesce(_present(F.col("conversion_shares")), F.col("other_shares")).cast("bigint")
    rows = documents.where(F.col("other_shares") > 0).select(
        "issuer", "ord", "disclosure_date", "share_type", price.alias("price"), shares.alias("shares"),
        F.when(price > 0, shares * price).otherwise(_zero("funding")).alias("face"),
        F.nullif(F.col("exercise_start"), F.lit("")).alias("start"),
        F.nullif(F.col("exercise_end"), F.lit("")).alias("end"),
    )
    by_price = (
        state.where(F.col("instrument_key").startswith("RIGHTS_") & (F.col("conversion_price") != 0))
        .groupBy("issuer", F.col("conversion_price").alias("price"))
        .agg(F.min_by("instrument_key", "inserted").alias("_known"))
    )
    own = F.concat(F.lit("RIGHTS_"), F.col("disclosure_date"))
    # documents of one price open a single instrument, that of the first; without a price each
    # document date is its own instrument
    per_price = rows.where("price != 0").groupBy("issuer", "price").agg(F.min_by("disclosure_date", "ord").alias("_d"))
    keyed = (
        rows.join(by_price, ["issuer", "price"], "left")
        .join(per_price, ["issuer", "price"], "left")
        .withColumn("instrument_key", F.coalesce("_known", F.concat(F.lit("RIGHTS_"), F.col("_d")), own))
    )
    o = F.col("ord")
    per = keyed.groupBy("issuer", "instrument_key").agg(
        F.min("ord").alias("ord"),
        F.min_by("share_type", "ord").alias("d_kind"),
        F.max_by("price", "ord").alias("d_price"),
        F.max_by("shares", "ord").alias("d_shares"),
        _first(_present(F.col("face")), o).alias("d_face"),
        _first(F.col("start"), o).alias("d_start"),
        _first(F.col("end"), o).alias("d_end"),
    )
    keys = ["issuer", "instrument_key"]
    joined = state.select(*STATE).join(per, keys, "left")
    bare = F.col("d_face").isNotNull() & (F.col("remaining") == 0)
    enriched = joined.select(
        *keys, "inserted", "category", "series", "kind",
        F.when(bare, F.col("d_face")).otherwise(F.col("face_value")).alias("face_value"),
        F.when(bare, F.col("d_face")).otherwise(F.col("remaining")).alias("remaining"),
        "conversion_price",
        F.coalesce("d_shares", "convertible_shares").alias("convertible_shares"),
        F.coalesce(F.nullif(F.col("exercise_start"), F.lit("")), F.col("d_start"), F.lit("")).alias("exercise_start"),
        F.coalesce(F.nullif(F.col("exercise_end"), F.lit("")), F.col("d_end"), F.lit("")).alias("exercise_end"),
    )
    fresh = per.join(state.select(*keys), keys, "left_anti").select(
        *keys, _at(3).alias("inserted"), F.lit(sc.RIGHTS_CATEGORY).alias("category"),
        F.lit(0).cast("bigint").alias("series"), _text("d_kind").alias("kind"),
        _zero("d_face").alias("face_value"), _zero("d_face").alias("remaining"),
        _zero("d_price").alias("conversion_price"), _zero("d_shares").alias("convertible_shares"),
        _text("d_start").alias("exercise_start"), _text("d_end").alias("exercise_end"),
    )
    return enriched.unionByName(fresh)


def _series_owner(state: DataFrame) -> DataFrame:
    """First instrument of each (issuer, series), whatever its category."""
    return state.groupBy("issuer", "series").agg(F.min_by("instrument_key", "inserted").alias("instrument_key"))


def apply_exercises(balances: DataFrame, state: DataFrame) -> DataFrame:
    """Balances of exercise notices, the latest present value of each field winning.

    Routing does not depend on earlier notices: a series belongs to its first instrument, a
    price to the first rights instrument that has it (a price-matched notice restates that
    price). Unknown series open an instrument with their first non-zero balance. Option
    notices set all option rows. Exchangeable bonds are skipped.
    """
    order = F.struct("entry_date", "ord", "pos")
    rows = balances.select(
        "*",
        order.alias("_o"),
        F.when(F.col("has_remaining"), F.col("remaining")).otherwise(F.col("face_value")).alias("_rem"),
        F.coalesce(_present(F.col("convertible_shares")), F.col("remaining_shares")).alias("_cs"),
    )
    options = rows.where((F.col("type") == sc.OPTION_EXERCISE) & (F.col("new_shares") > 0))
    bonds = rows.where((F.col("type") != sc.OPTION_EXERCISE) & ~F.coalesce(F.col("exchangeable"), F.lit(False)))

    owner = _series_owner(state).withColumn("_known", F.lit(True))
    by_series = bonds.where(F.col("series").isNotNull())
    # opening record of series nobody holds yet
    weight = (_zero("_rem") != 0) | (_zero("_cs") != 0)
    opening = (
        by_series.where(weight)
        .groupBy("issuer", "series")
        .agg(
            F.min("_o").alias("_from"),
            F.min_by(F.struct("type", "_rem", "_cs", "face_value", "conversion_price", "ord"), "_o").alias("_n"),
        )
        .join(owner, ["issuer", "series"], "left_anti")
    )
    new_category = category_of_exercise(F.col("_n")["type"])
    opened = opening.select(
        "issuer",
        F.concat(new_category, F.lit("_"), F.col("series").cast("string")).alias("instrument_key"),
        _at(4, F.col("_n")["ord"]).alias("inserted"),
        new_category.alias("category"),
        "series",
        F.concat(F.lit("제"), F.col("series").cast("string"), F.lit("회")).alias("kind"),
        F.coalesce(_present(F.col("_n")["face_value"]), _zero(F.col("_n")["_rem"])).alias("face_value"),
        _zero(F.col("_n")["_rem"]).alias("remaining"),
        _zero(F.col("_n")["conversion_price"]).alias("conversion_price"),
        _zero(F.col("_n")["_cs"]).alias("convertible_shares"),
        F.lit("").alias("exercise_start"),
        F.lit("").alias("exercise_end"),
    )
    # routing tables are one row per series or price, not per notice
    route = owner.select("issuer", "series", "instrument_key", F.lit(None).cast("struct<entry_date:date,ord:bigint,pos:bigint>").alias("_from")).unionByName(
        opening.select(
            "issuer", "series", F.concat(new_category, F.lit("_"), F.col("series").cast("string")).alias("instrument_key"), "_from"
        )
    )
    values = F.struct("_o", "_rem", F.col("conversion_price").alias("_cp"), "_cs")
    series_updates = by_series.join(route, ["issuer", "series"]).where(
        F.col("_from").isNull() | (F.col("_o") >= F.col("_from"))
    ).select("issuer", "instrument_key", values.alias("_u"))
    by_price = (
        state.where(F.col("instrument_key").startswith("RIGHTS_"))
        .groupBy("issuer", "conversion_price")
        .agg(F.min_by("instrument_key", "inserted").alias("instrument_key"))
    )
    price_updates = (
        bonds.where(F.col("series").isNull() & (_zero("conversion_price") != 0))
        .join(by_price, ["issuer", "conversion_price"])
        .select("issuer", "instrument_key", values.alias("_u"))
    )
    u = F.col("_u")
    latest = (
        series_updates.unionByName(price_updates)
        .groupBy("issuer", "instrument_key")
        .agg(
            _last(u["_rem"], u["_o"]).alias("u_rem"),
            _last(u["_cp"], u["_o"]).alias("u_price"),
            _last(u["_cs"], u["_o"]).alias("u_shares"),
            F.max(F.when(u["_cs"].isNotNull(), u["_o"])).alias("u_at"),
        )
    )
    option = options.groupBy("issuer").agg(F.max("_o").alias("o_at"), F.max_by("new_shares", "_o").alias("o_shares"))
    is_option = F.col("category").isin(*sc.OPTION_CATEGORIES)
    all_rows = state.select(*STATE).unionByName(opened.select(*STATE))
    j = all_rows.join(latest, ["issuer", "instrument_key"], "left").join(option, "issuer", "left")
    later_option = is_option & F.col("o_at").isNotNull() & (F.col("u_at").isNull() | (F.col("o_at") > F.col("u_at")))
    updated = j.select(
        "issuer", "instrument_key", "inserted", "category", "series", "kind", "face_value",
        F.coalesce("u_rem", "remaining").alias("remaining"),
        F.coalesce("u_price", "conversion_price").alias("conversion_price"),
        F.when(later_option, F.col("o_shares")).otherwise(F.coalesce("u_shares", "convertible_shares")).alias("convertible_shares"),
        "exercise_start", "exercise_end",
    )
    holders = state.where(is_option).select("issuer").distinct()
    zero = F.lit(0).cast("bigint")
    first_option = option.join(holders, "issuer", "left_anti").select(
        "issuer", F.lit("SO_0").alias("instrument_key"), _at(4, F.col("o_at")["ord"]).alias("inserted"),
        F.lit(sc.OPTION_CATEGORY).alias("category"), zero.alias("series"), F.lit("").alias("kind"),
        zero.alias("face_value"), zero.alias("remaining"), zero.alias("conversion_price"),
        F.col("o_shares").alias("convertible_shares"), F.lit("").alias("exercise_start"), F.lit("").alias("exercise_end"),
    )
    return updated.unionByName(first_option)


def running_last(df: DataFrame, *, keys: Sequence[str], slot: str, order: Column, value: Column, out: str) -> DataFrame:
    """Last present value among the earlier rows of a key, in two levels.

    The slots (days) of a key are reduced to their last value first and carried over with a
    window of one row per slot; rows are ordered only within their slot.
    """
    marked = df.withColumn("_v", value).withColumn("_ord", order)
    per_slot = marked.groupBy(*keys, slot).agg(_last(F.col("_v"), F.col("_ord")).alias("_s"))
    carry = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slot.select(*keys, slot, F.last("_s", ignorenulls=True).over(carry).alias("_carried"))
    inner = Window.partitionBy(*keys, slot).orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumn("_local", F.last("_v", ignorenulls=True).over(inner))
    return local.join(carried, [*keys, slot]).select(*df.columns, F.coalesce("_local", "_carried").alias(out))


def _adjusted(adjustments: DataFrame, state: DataFrame) -> DataFrame:
    """Adjustments that name a series, with their instrument and what they set: ``_p`` price, ``_s`` shares, ``_o`` place.

    The balance that counts is the one in force at that moment, so each adjustment first looks
    up the latest stated balance before it (``running_last``).
    """
    owner = _series_owner(state)
    base = state.select("issuer", "instrument_key", F.col("remaining").alias("_start"))
    # dates are not needed in the state; the slot is the day of the notice
    rows = (
        adjustments.where(F.col("series").isNotNull())
        .join(owner, ["issuer", "series"])
        .join(base, ["issuer", "instrument_key"])
    )
    order = F.struct("entry_date", "ord", "part", "pos")
    seen = running_last(
        rows, keys=["issuer", "instrument_key"], slot="entry_date", order=order,
        value=F.when(F.col("part") == 1, F.col("unconverted")), out="_stated",
    )
    balance = F.coalesce("_stated", "_start")
    price = F.when(F.col("part") == 0, F.col("price_after"))
    derived = F.when((price >= sc.MIN_PRICE) & (balance != 0), floor_div(balance, price))
    shares = F.coalesce(derived, F.when(F.col("part") == 1, F.col("shares_after")))
    return seen.withColumns({"_p": price, "_s": shares, "_o": order})


def adjusted_values(adjustments: DataFrame, state: DataFrame) -> DataFrame:
    """(issuer, instrument_key, price, shares): every figure an instrument has over time, one to a row, the other null or repeated."""
    first = state.select("issuer", "instrument_key", F.col("conversion_price").alias("price"), F.col("convertible_shares").alias("shares"))
    later = _adjusted(adjustments, state).select("issuer", "instrument_key", F.col("_p").alias("price"), F.col("_s").alias("shares"))
    return first.unionByName(later)


def series_owners(state: DataFrame) -> DataFrame:
    """(issuer, series, instrument_key): the instrument that records of a series belong to."""
    return _series_owner(state)


def apply_price_adjustments(adjustments: DataFrame, state: DataFrame) -> DataFrame:
    """Adjustments that name a series: new price, shares = balance / price, stated counts last; the last value wins."""
    per = _adjusted(adjustments, state).groupBy("issuer", "instrument_key").agg(
        _last(F.col("_p"), F.col("_o")).alias("a_price"),
        _last(F.col("_s"), F.col("_o")).alias("a_shares"),
        _last(F.when(F.col("part") == 1, F.col("unconverted")), F.col("_o")).alias("a_rem"),
    )
    return state.select(*STATE).join(per, ["issuer", "instrument_key"], "left").select(
        "issuer", "instrument_key", "inserted", "category", "series", "kind", "face_value",
        F.coalesce("a_rem", "remaining").alias("remaining"),
        F.coalesce("a_price", "conversion_price").alias("conversion_price"),
        F.coalesce("a_shares", "convertible_shares").alias("convertible_shares"),
        "exercise_start", "exercise_end",
    )


def default_options(state: DataFrame, options: DataFrame) -> DataFrame:
    """``SO_0`` with the given shares for issuers without any option instrument."""
    have = state.where(F.col("instrument_key").startswith("SO_")).select("issuer").distinct()
    zero = F.lit(0).cast("bigint")
    fresh = options.join(have, "issuer", "left_anti").select(
        "issuer", F.lit("SO_0").alias("instrument_key"), _at(5, F.lit(0)).alias("inserted"),
        F.lit(sc.OPTION_CATEGORY).alias("category"), zero.alias("series"), F.lit("").alias("kind"),
        zero.alias("face_value"), zero.alias("remaining"), zero.alias("conversion_price"),
        F.col("shares").alias("convertible_shares"), F.lit("").alias("exercise_start"), F.lit("").alias("exercise_end"),
    )
    return state.select(*STATE).unionByName(fresh)


def overhang_table(state: DataFrame, *, as_of: Column, total_shares: Column | str, currency: str = "KRW") -> DataFrame:
    """Display rows of live instruments: label, amount, price, dilution, period."""
    total = F.col(total_shares) if isinstance(total_shares, str) else total_shares
    live = state.where(
        has_position("convertible_shares", "remaining") & not_expired("exercise_end", as_of)
    )
    shares, price, left = F.col("convertible_shares"), F.col("conversion_price"), F.col("remaining")
    category = F.col("category")
    numbered = F.when(F.col("series") != 0, F.concat(F.lit("제"), F.col("series").cast("string"), F.lit("회 "))).otherwise("")
    label = (
        F.when(category == "CB", F.concat(numbered, F.lit("전환사채(CB)")))
        .when(category == "BW", F.concat(numbered, F.lit("신주인수권부사채(BW)")))
        .when(category.isin(*sc.OPTION_CATEGORIES), F.lit(sc.OPTION_CATEGORY))
        .otherwise(F.concat(numbered, category))
    )
    amount = F.when((price > 0) & (shares > 0), price * shares).otherwise(left)
    unit = "억원" if currency == "KRW" else f"백만 {currency}"
    shown = to_eok(amount) if currency == "KRW" else F.bround(amount / F.lit(1e6), 0).cast("bigint")
    count = F.concat(format_thousands(shares), F.lit("주"))
    remaining_text = F.when(
        amount > 0, F.concat(format_thousands(shown), F.lit(f" {unit} ("), count, F.lit(")"))
    ).when(shares > 0, count)
    suffix = "원" if currency == "KRW" else f" {currency}"
    pct = F.when((shares > 0) & (total > 0), shares / total * 100)
    # two decimals, half-even, never in exponent form
    pct_text = F.concat(F.bround(pct, 2).cast("decimal(30,2)").cast("string"), F.lit("%"))
    return live.select(
        "issuer",
        "instrument_key",
        label.alias("category_label"),
        remaining_text.alias("remaining_amount"),
        F.when(price > 0, F.concat(format_thousands(price), F.lit(suffix))).alias("exercise_price"),
        pct_text.alias("dilution_ratio"),
        format_period(compact_period_date("exercise_start"), compact_period_date("exercise_end")).alias("exercise_period"),
    )


__all__ = [
    "apply_events", "apply_exercises", "apply_issuance", "apply_notes", "apply_price_adjustments",
    "adjusted_values", "apply_rights_documents", "default_options", "enrich_missing", "instrument_key", "overhang_table",
    "overwrite_present", "replace_by_key", "running_last", "series_owners",
]

"""Key-value maps and loose JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _present(c: Column) -> Column:
    """Blank text is NULL; the text is computed once."""
    return let(F.trim(c), lambda v: F.when(v != "", v))


def kv_get(pairs: Column, fragment: str) -> Column:
    """Value of the shortest key holding the fragment (first on ties); blank is NULL.

    ``pairs`` is an ordered ``array<struct<key, value>>``; a map has no key order.
    """
    hits = F.filter(pairs, lambda p: F.contains(p["key"], F.lit(fragment)))
    ranked = F.transform(
        hits, lambda p, i: F.struct(F.length(p["key"]).alias("n"), i.alias("i"), p["value"].alias("value"))
    )
    return _present(F.array_min(ranked)["value"])


def kv_any(pairs: Column, *fragments: str) -> Column:
    """First fragment that yields a value."""
    return F.coalesce(*(kv_get(pairs, f) for f in fragments))


def kv_has(pairs: Column, fragment: str) -> Column:
    return F.exists(pairs, lambda p: F.contains(p["key"], F.lit(fragment)))


def kv_first(pairs: Column, *keys: str) -> Column:
    """First non-empty value among exact keys."""
    return let(
        F.map_from_entries(pairs),
        lambda as_map: F.coalesce(*(_present(F.try_element_at(as_map, F.lit(k))) for k in keys)),
    )


def kv_value_where(pairs: Column, keep) -> Column:
    """Value of the first key (document order) that passes ``keep``."""
    return F.get(F.filter(pairs, lambda p: keep(p["key"])), F.lit(0))["value"]


def kv_upsert(pairs: Column) -> Column:
    """Duplicate keys: the last value at the place of the first occurrence."""

    def put(acc: Column, p: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda q: q["key"]), p["key"])
        replaced = F.transform(acc, lambda q: F.when(q["key"] == p["key"], p).otherwise(q))
        return F.when(at > 0, replaced).otherwise(F.concat(acc, F.array(p)))

    empty = F.filter(pairs, lambda p: F.lit(False))
    return F.aggregate(pairs, empty, put)


def unfence(c: Column | str) -> Column:
    """Content of the first fenced block, else the text itself; ``null`` and blank are NULL."""
    text = F.trim(_col(c))
    fenced = F.trim(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1))
    body = F.when(fenced != "", fenced).otherwise(text)
    return F.when(~F.lower(body).isin("", "null"), body)


def parse_json_object(c: Column | str, schema: str) -> Column:
    """Loose reply -> struct; arrays, scalars and broken text are NULL."""
    text = unfence(c)
    good = text.rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json(text).isNotNull()
    return F.when(good, F.from_json(text, schema))


def parse_json_items(
    c: Column | str,
    item_schema: str,
    wrappers: tuple = ("instruments", "data", "results", "items"),
) -> Column:
    """Loose reply -> array of structs: a bare array, a wrapped one, or the first ``[...]``."""
    text = F.trim(_col(c))
    array_type = f"array<{item_schema}>"

    def as_array(t: Column) -> Column:
        good = t.rlike(r"(?s)^\s*\[.*\]\s*$") & F.try_parse_json(t).isNotNull()
        return F.when(good, F.from_json(t, array_type))

    valid = F.try_parse_json(text).isNotNull()
    is_object = text.rlike(r"(?s)^\s*\{.*\}\s*$") & valid
    wrapped = [F.when(is_object, as_array(F.get_json_object(text, f"$.{w}"))) for w in wrappers]
    inner = as_array(F.when(~valid, F.regexp_extract(text, r"(?s)(\[.*\])", 1)))
    return F.coalesce(as_array(text), *wrapped, inner)

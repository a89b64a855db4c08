"""Free-form properties as VARIANT columns: parsed once, stored as such, read by typed paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(c: Column) -> Column:
    """The properties that a JSON text holds; null where it isn't JSON."""
    return F.try_parse_json(c)


def at(v: Column | str, path: str, kind: str) -> Column:
    """The value at ``path`` as ``kind``; null where it isn't there or is something else."""
    return F.try_variant_get(v, path, kind)


def holds(v: Column | str, wanted: dict[str, object]) -> Column:
    """Whether the properties have all the values of ``wanted`` by path: texts, numbers or truth values."""
    out = F.lit(True)
    for path, value in wanted.items():
        kind = "boolean" if isinstance(value, bool) else "double" if isinstance(value, int | float) else "string"
        out &= F.coalesce(at(v, path, kind) == F.lit(float(value) if kind == "double" else value), F.lit(False))
    return out


def shape(v: Column | str) -> Column:
    """The properties' names and types, as text."""
    return F.schema_of_variant(v)


def updated(v: Column, new: Column) -> Column:
    """The properties of ``v`` with those of ``new`` added or put in their place, one level deep."""
    text = lambda x: F.from_json(F.coalesce(F.to_json(x), F.lit("{}")), "map<string,variant>")
    old, more = text(v), text(new)
    return F.parse_json(F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(more, k)), more)))

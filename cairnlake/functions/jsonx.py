"""Json payloads as text and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(payload: Column, path: str) -> Column:
    """A number at a path, or null if there is none or it isn't one."""
    return F.get_json_object(payload, path).try_cast("double")


def strings(payload: Column, path: str) -> Column:
    return F.from_json(F.get_json_object(payload, path), "array<string>")


def has(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, path).isNotNull()


def entries(payload: Column) -> Column:
    return F.from_json(payload, "map<string,string>")


def keep_keys(m: Column, *keys: str) -> Column:
    """Only these keys, and only where there is a value."""
    return F.map_filter(m, lambda k, v: k.isin(*keys) & v.isNotNull() & (v != ""))


def without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull())


def put(m: Column, key: str, value: Column) -> Column:
    """Set one key, in place of the value that it has."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), value))


def compact_provenance(m: Column) -> Column:
    """A map of field to source with the most frequent source under ``_`` and only the exceptions beside it.

    A source that is already under ``_`` stays the default.  Ties go to the source of the first field.
    """
    fields = F.filter(F.map_entries(m), lambda e: e["key"] != "_")
    values = F.transform(fields, lambda e: e["value"])
    ranked = F.array_sort(
        F.transform(values, lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), F.array_position(values, v).alias("i"), v.alias("v")))
    )
    default = F.coalesce(F.try_element_at(m, F.lit("_")), F.get(ranked, 0)["v"])
    odd = F.filter(fields, lambda e: e["value"] != default)
    return F.when(default.isNull(), F.create_map().cast("map<string,string>")).otherwise(
        F.map_concat(F.create_map(F.lit("_"), default), F.map_from_entries(odd))
    )

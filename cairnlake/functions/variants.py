"""Typed JSON: payloads parsed once as variants, members by path with the type they should have."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names that schema_of_variant() has for each kind of value, as beginnings.
_KINDS = {
    "number": ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL"), "string": ("STRING",), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",),
}
#: The kind of value that a column of a type takes.
_TAKES = {"long": "number", "int": "number", "double": "number", "string": "string", "boolean": "boolean"}


def parsed(text: Column) -> Column:
    """A payload as a variant; null if it isn't JSON."""
    return F.try_parse_json(text)


def kind(payload: Column, path: str) -> Column:
    """What is at a path: number, string, boolean, array, object or null; missing if there is nothing."""
    found = F.schema_of_variant(F.try_variant_get(payload, path, "variant"))
    out = F.lit("missing")
    for name, starts in _KINDS.items():
        out = F.when(found.rlike(f"^(?:{'|'.join(starts)})"), name).otherwise(out)
    return F.when(payload.isNull(), None).otherwise(out)


def member(payload: Column, path: str, as_type: str) -> Column:
    """The value at a path if it is of the kind that the type takes, else null; a number is never made of a string."""
    takes = _TAKES.get(as_type, "array" if as_type.startswith("array") else "object")
    return F.when(kind(payload, path) == takes, F.try_variant_get(payload, path, as_type))


def members(payload: Column, fields: Mapping[str, tuple[str, str]]) -> tuple[dict[str, Column], Column]:
    """Columns by name for (path, type), and the sorted names of those whose value is there but of another kind, or out of range."""
    columns = {name: member(payload, path, as_type) for name, (path, as_type) in fields.items()}
    wrong = F.array(*(F.when(~kind(payload, path).isin("missing", "null") & columns[name].isNull(), F.lit(name)) for name, (path, _) in sorted(fields.items())))
    return columns, F.array_compact(wrong)

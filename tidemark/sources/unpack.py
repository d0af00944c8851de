"""Lists of JSON objects out of text, one bad element at a time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def members(text: Column, schema: str = "map<string, string>") -> Column:
    """A JSON object as a map; of a repeated member the last value counts."""
    return unrepeated(F.from_json(text, schema))


def unrepeated(parsed: Column) -> Column:
    """The map that a parser returned, rebuilt so that the session's rule for repeated keys applies."""
    return F.map_from_entries(F.map_entries(parsed))


def object_list(text: Column, fields: list[str]) -> Column:
    """A JSON list to an array of structs of text; elements that are no objects become empty structs.

    The whole list is parsed at once. Only when that fails, because some element
    is not an object, is it taken apart into texts and parsed element by element.
    """
    whole = F.from_json(text, f"array<struct<{_struct(fields)}>>")
    unpacked = F.coalesce(whole, _each(F.from_json(text, "array<string>"), fields))
    return F.when(text.rlike(r"^\s*\["), unpacked)


def object_lists(text: Column, name: str, fields: list[str]) -> Column:
    """The member ``name`` of a JSON object, a map from keys to lists of objects."""
    whole = F.from_json(text, f"`{name}` map<string, array<struct<{_struct(fields)}>>>")[name]
    parts = F.from_json(text, f"`{name}` map<string, array<string>>")[name]
    return unrepeated(F.coalesce(whole, F.transform_values(parts, lambda _, texts: _each(texts, fields))))


def _each(texts: Column, fields: list[str]) -> Column:
    ddl = ", ".join(f"`{f}` string" for f in fields)
    return F.transform(texts, lambda t: F.from_json(t, ddl))


def _struct(fields: list[str]) -> str:
    return ", ".join(f"`{f}`: string" for f in fields)

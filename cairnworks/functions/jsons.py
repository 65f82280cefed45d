"""Containment and key predicates on JSON columns, by Spark's VARIANT type."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant(text: Column) -> Column:
    """A JSON text as VARIANT; null for what is no JSON."""
    return F.try_parse_json(text)


def _at(value: Column, key: str) -> Column:
    # A path has no escapes: a key with both quotes is looked up in a map.
    for quote in "'\"":
        if quote not in key:
            return F.try_variant_get(value, f"$[{quote}{key}{quote}]", "variant")
    return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(key))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def has_key(value: Column, key: str) -> Column:
    """Whether an object has the key, also with the value null, or an array or a string the element; null for null."""
    element = F.when(_kind(value).startswith("ARRAY"), F.exists(F.try_variant_get(value, "$", "array<variant>"), lambda e: _equals(e, key)))
    return F.when(value.isNotNull(), F.when(_kind(value).startswith("OBJECT"), _at(value, key).isNotNull()).otherwise(F.coalesce(element, _equals(value, key))))


def _equals(value: Column, scalar) -> Column:
    if scalar is None:
        return F.coalesce(F.is_variant_null(value), F.lit(False))
    if isinstance(scalar, bool):
        found = (_kind(value) == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(scalar))
    elif isinstance(scalar, int | float):
        found = ~_kind(value).rlike("^(STRING|BOOLEAN|ARRAY|OBJECT|VOID)") & (F.try_variant_get(value, "$", "double") == F.lit(float(scalar)))
    else:
        found = (_kind(value) == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(scalar))
    return F.coalesce(found, F.lit(False))


def contains(value: Column, wanted) -> Column:
    """Whether a VARIANT contains a JSON value (or its text): objects each key with what it must contain, arrays each element in some
    element, an array also a scalar that is one of its elements; null for null."""
    wanted = json.loads(wanted) if isinstance(wanted, str) and wanted[:1] in "[{" else wanted
    return F.when(value.isNotNull(), _contains(value, wanted, True))


def _contains(value: Column, wanted, top: bool) -> Column:
    if isinstance(wanted, dict):
        parts = [F.coalesce(_contains(_at(value, k), w, False), F.lit(False)) for k, w in wanted.items()]
        return functools.reduce(Column.__and__, parts, _kind(value).startswith("OBJECT"))
    if isinstance(wanted, list):
        elements = F.try_variant_get(value, "$", "array<variant>")
        some = lambda w: F.exists(elements, lambda e: _contains(e, w, False))
        parts = [F.coalesce(some(w), F.lit(False)) for w in wanted]
        return functools.reduce(Column.__and__, parts, _kind(value).startswith("ARRAY"))
    if not top:
        return _equals(value, wanted)
    inside = F.exists(F.try_variant_get(value, "$", "array<variant>"), lambda e: _equals(e, wanted))
    return _equals(value, wanted) | F.coalesce(F.when(_kind(value).startswith("ARRAY"), inside), F.lit(False))

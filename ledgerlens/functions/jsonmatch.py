"""JSON containment: does a JSON text hold all of a given object or array?"""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F


def contains(c: Column, wanted) -> Column:
    """True where the JSON text contains ``wanted``; false for null and malformed text.

    The literal is taken apart into one test per leaf: a key path with a value for objects,
    membership of each element for arrays. A missing path or another value fails.
    """
    doc = F.try_parse_json(c)
    return F.coalesce(_holds(doc, "$", wanted), F.lit(False))


def _step(path: str, key: str) -> str:
    return f'{path}["{key}"]'


def _holds(doc: Column, path: str, wanted) -> Column:
    if isinstance(wanted, dict):
        here = F.schema_of_variant(F.try_variant_get(doc, path, "variant")).startswith("OBJECT")
        for key, value in wanted.items():
            here = here & F.coalesce(_holds(doc, _step(path, key), value), F.lit(False))
        return here
    if isinstance(wanted, list):
        items = F.try_variant_get(doc, path, "array<variant>")
        here = items.isNotNull()
        for value in wanted:
            here = here & F.coalesce(F.exists(items, _equals(value)), F.lit(False))
        return here
    return F.coalesce(_scalar(F.try_variant_get(doc, path, "variant"), wanted), F.lit(False))


def _equals(wanted):
    return lambda item: _member(item, wanted)


def _member(item: Column, wanted) -> Column:
    if isinstance(wanted, (dict, list)):
        return F.coalesce(_holds(item, "$", wanted), F.lit(False))
    return F.coalesce(_scalar(item, wanted), F.lit(False))


def _scalar(item: Column, wanted) -> Column:
    """Equality of a JSON scalar by value and kind: 1 equals 1.0 but not "1"."""
    kind = F.schema_of_variant(item)
    text = F.try_variant_get(item, "$", "string")
    if wanted is None:
        return F.is_variant_null(item)
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (text == json.dumps(wanted))
    if isinstance(wanted, (int, float)):
        number = F.try_variant_get(item, "$", "double")
        return ~kind.isin("STRING", "BOOLEAN") & (number == F.lit(float(wanted)))
    return (kind == "STRING") & (text == F.lit(wanted))

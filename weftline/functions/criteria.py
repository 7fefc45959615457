"""Criteria: JSON predicates over records, compiled to Columns.

{path: value} asks for equality, {path: {op: value, ...}} for all its operators; everything is ANDed. Equality compares text
forms, of numbers their values ("5", 5, 5.0 and 5e0 are equal); numeric operators read numbers from text; $ne holds where the path is
missing; unknown operators never hold.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.paths import json_text
from weftline.functions.values import as_text, literal

NUMERIC = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def comparable(c: Column) -> Column:
    """The text that a value is compared by: a number in the grammar of JSON as its double, anything else (and what no double
    holds) as it is."""
    number = F.when(c.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"), c.try_cast("double"))
    return F.when(number.isNotNull() & (F.abs(number) < float("inf")), (number + F.lit(0.0)).cast("string")).otherwise(c)


def _equal(c: Column, x: object) -> Column:
    if x is None:
        return c.isNull()
    if isinstance(x, bool | str | int | float):
        return F.coalesce(comparable(c) == comparable(as_text(literal(x))), F.lit(False))
    return F.coalesce(c == json.dumps(x, separators=(",", ":")), F.lit(False))


def _operator(c: Column, op: str, x: object) -> Column:
    if op == "$eq":
        return _equal(c, x)
    if op == "$ne":
        return ~_equal(c, x)
    if op == "$in":
        return _any([_equal(c, y) for y in x]) if isinstance(x, list) else F.lit(False)
    if op == "$contains":
        items = F.from_json(c, "array<string>")
        text = as_text(literal(x))
        return F.coalesce(F.when(c.startswith("["), F.exists(items, lambda i: F.coalesce(comparable(i) == comparable(text), F.lit(False)))).otherwise(c.contains(text)), F.lit(False))
    if op == "$exists":
        return c.isNotNull() if x else c.isNull()
    if op in NUMERIC:
        try:
            limit = float(x)
        except (TypeError, ValueError):
            return F.lit(False)
        return F.coalesce(getattr(c.try_cast("double"), NUMERIC[op])(F.lit(limit)), F.lit(False))
    return F.lit(False)


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def matches(data: Column, criteria: dict) -> Column:
    """Whether JSON text ``data`` meets the criteria; empty criteria are met by all."""
    out = F.lit(True)
    for path, want in criteria.items():
        c = json_text(data, path, fold_case=False)
        if isinstance(want, dict) and want and all(k.startswith("$") for k in want):
            for op, x in want.items():
                out = out & _operator(c, op, x)
        else:
            out = out & _equal(c, want)
    return out


def split(criteria: dict) -> tuple[dict, dict]:
    """(equalities that a source can be asked for, the rest)."""
    simple = {k: v for k, v in criteria.items() if not isinstance(v, dict | list) and "." not in k and v is not None}
    return simple, {k: v for k, v in criteria.items() if k not in simple}


def canonical(criteria: dict) -> str:
    return json.dumps(criteria, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def criteria_hash(criteria: dict) -> str:
    """SHA-256 of the key-sorted JSON."""
    return hashlib.sha256(canonical(criteria).encode()).hexdigest()


def canonical_text(c: Column) -> Column:
    """``c`` as key-sorted JSON without white space, numbers by value (5.0 and 5 are one; one with an exponent stays a double), so that
    criteria which ask for the same read the same. Null for null, for what is no JSON object, and for repeated keys."""
    return F.to_json(F.when(F.ltrim(c).startswith("{"), F.try_parse_json(c)))


def hash_of(c: Column) -> Column:
    """criteria_hash of a column of criteria: SHA-256 of canonical_text, in lowercase hex."""
    return F.sha2(canonical_text(c), 256)


def split_texts(c: Column) -> Column:
    """split of a column of criteria: a struct of the texts asked and rest, both canonical; null as there."""
    entries = F.from_json(canonical_text(c), "map<string,variant>")

    def simple(path: Column, want: Column) -> Column:
        return ~F.schema_of_variant(want).rlike("^(OBJECT|ARRAY|VOID)") & ~path.contains(".")

    asked = F.to_json(F.map_filter(entries, simple))
    rest = F.to_json(F.map_filter(entries, lambda path, want: ~simple(path, want)))
    return F.when(entries.isNotNull(), F.struct(asked.alias("asked"), rest.alias("rest")))

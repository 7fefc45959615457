"""Paths into nested data as Columns, for typed columns (struct, array, map) and for JSON text.

Mapping paths (``a.b[2].c``, ``items[*].x``): a name is looked up exactly and then without regard to case; a name on an array
collects that name from every element and flattens one level; an index beyond the end fails. Record paths are case-sensitive
and give null beyond the end.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = str | int


class PathError(ValueError):
    """The path does not exist in the type."""


def parse_path(path: str) -> list[Step]:
    """Names and indexes; [*] is no step."""
    out: list[Step] = []
    for part in path.split(".") if path else []:
        m = re.fullmatch(r"([^\[\]]*)((?:\[(?:\d+|\*)\])*)", part)
        if not m:
            raise PathError(f"bad path {path!r}")
        if m[1]:
            out.append(m[1])
        out += [int(i) for i in re.findall(r"\[(\d+)\]", m[2])]
    return out


def typed(col: Column, data_type: T.DataType, path: str, fold_case: bool = True) -> tuple[Column, T.DataType]:
    """(column, type) of a path in a typed column. Raises PathError for a name that a struct lacks."""
    for step in parse_path(path):
        col, data_type = _typed_step(col, data_type, step, fold_case)
    return col, data_type


def _typed_step(col: Column, t: T.DataType, step: Step, fold_case: bool) -> tuple[Column, T.DataType]:
    if isinstance(step, int):
        if not isinstance(t, T.ArrayType):
            raise PathError(f"[{step}] on {t.simpleString()}")
        return F.get(col, F.lit(step)), t.elementType
    if isinstance(t, T.StructType):
        names = t.fieldNames()
        name = step if step in names else next((n for n in names if fold_case and n.lower() == step.lower()), None)
        if name is None:
            raise PathError(f"unable to find the key {step!r}")
        return col.getField(name), t[name].dataType
    if isinstance(t, T.MapType):
        exact = F.try_element_at(col, F.lit(step))
        if not fold_case:
            return exact, t.valueType
        folded = F.try_element_at(F.map_values(F.map_filter(col, lambda k, v: F.lower(k) == step.lower())), F.lit(1))
        return F.when(F.map_contains_key(col, step), exact).otherwise(folded), t.valueType
    if isinstance(t, T.ArrayType):
        inner = t.elementType
        _, found = _typed_step(F.lit(None).cast(inner), inner, step, False if not fold_case else True)
        each = F.transform(col, lambda x: _typed_step(x, inner, step, fold_case)[0])
        return (F.flatten(each), found) if isinstance(found, T.ArrayType) else (each, T.ArrayType(found))
    raise PathError(f"unable to find the key {step!r}")


def bind(c: Column, f) -> Column:
    """f(c) with c computed once: nested look-ups would otherwise repeat it at every use."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def json_text(col: Column, path: str, fold_case: bool = True) -> Column:
    """The value at a path of JSON text: texts unquoted, anything else as JSON; null if it isn't there."""
    for i, step in enumerate(parse_path(path)):
        if isinstance(step, int):
            col = F.get(F.from_json(col, "array<string>"), F.lit(step))
        elif i == 0:
            col = _json_key(col, step, fold_case)
        else:
            col = bind(col, _json_step(step, fold_case))
    return col


def _json_step(name: str, fold_case: bool):
    """On an array the name is collected from the elements, and one level of arrays is flattened."""

    def step(c: Column) -> Column:
        each = F.array_compact(F.transform(F.from_json(c, "array<string>"), lambda x: _json_key(x, name, fold_case)))
        flat = F.flatten(F.transform(each, lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))))
        listed = F.concat(F.lit("["), F.array_join(F.transform(flat, json_literal), ","), F.lit("]"))
        return F.when(c.startswith("["), listed).otherwise(_json_key(c, name, fold_case))

    return step


def json_literal(x: Column) -> Column:
    """JSON text of what from_json gave as a string: numbers, words, objects and arrays as they are, others quoted."""
    bare = x.rlike(r"^(-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null|\{.*\}|\[.*\])$")
    quoted = F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    return F.when(bare, x).otherwise(quoted)


def object_json(m: Column, encoded: bool = False) -> Column:
    """JSON object of a map of from_json texts: nested JSON, numbers and words stay as they are, keys sorted. ``encoded``: the
    values are JSON already."""
    entries = F.array_sort(F.map_entries(m))
    pairs = F.transform(entries, lambda e: F.concat(F.regexp_replace(F.to_json(F.array(e["key"])), r"^\[|\]$", ""), F.lit(":"), F.coalesce(e["value"] if encoded else json_literal(e["value"]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _json_key(c: Column, name: str, fold_case: bool) -> Column:
    m = F.from_json(c, "map<string,string>")
    if not fold_case:
        return F.try_element_at(m, F.lit(name))
    folded = lambda x: F.try_element_at(F.map_values(F.map_filter(x, lambda k, v: F.lower(k) == name.lower())), F.lit(1))
    return bind(m, lambda x: F.coalesce(F.try_element_at(x, F.lit(name)), folded(x)))


def record_array(col: Column, how: str, key: str | None = None, value: str | None = None, separator: str = ",") -> Column:
    """Array handling of record paths: first, last, join, or the first element whose ``key`` equals ``value`` (filter)."""
    if how == "first":
        return F.get(col, F.lit(0))
    if how == "last":
        return F.try_element_at(col, F.lit(-1))
    if how == "join":
        return F.array_join(F.transform(col, lambda x: x.cast("string")), separator)
    if how == "filter":
        return F.get(F.filter(col, lambda x: x[key].cast("string") == value), F.lit(0))
    raise ValueError(f"unknown array handling {how!r}")


#: Private characters around a number that travels as a text.
MARK, UNMARK = "\ue000", "\ue001"


def marked_numbers(c: Column) -> Column:
    """JSON with its numbers as marked texts: from_json would write 1.50 as 1.5 and 1e400 as Infinity."""
    text, number = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")', r"(-?[0-9][0-9.eE+\-]*+)"
    # What isn't in a text is a number or a word; the group that has not matched is empty.
    split = F.regexp_replace(c, f"{text}|{number}", f"$1{MARK}$2{MARK}")
    return F.regexp_replace(F.replace(split, F.lit(MARK + MARK), F.lit("")), f"{MARK}([^{MARK}]*+){MARK}", f'"{MARK}$1{UNMARK}"')

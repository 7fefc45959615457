"""Validation of records against entity schemas: a column with all errors, computed in the projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the formats.
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "date-time": r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?$",
    "uri": r"^(https?|ftp)://[^\s/$.?#].[^\s]*$",
    "url": r"^(https?|ftp)://[^\s/$.?#].[^\s]*$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
}
_TYPES = {
    "number": lambda t: t.isin("BIGINT", "DOUBLE") | t.startswith("DECIMAL"),
    "boolean": lambda t: t == "BOOLEAN",
    "string": lambda t: t == "STRING",
    "object": lambda t: t.startswith("OBJECT"),
    "array": lambda t: t.startswith("ARRAY"),
}
ERRORS = "array<struct<field:string,message:string>>"


def _fits(text: Column, form: str) -> Column | None:
    if form == "phone":  # any characters: only their number counts, separators aside
        return F.octet_length(F.translate(text, " -()", "")).between(7, 15)
    return text.rlike(PATTERNS[form]) if form in PATTERNS else None


def _errors(*found: tuple[Column, Column, str]) -> Column:
    """Array of the errors (condition, field, message) that hold."""
    return F.array_compact(F.array(*[F.when(bad, F.struct(field.alias("field"), F.lit(message).alias("message"))) for bad, field, message in found])).cast(ERRORS)


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f'$["{name}"]', "variant")


def _value(v: Column, rule: dict, label: Column) -> list[Column]:
    """Arrays of errors of one value; null and missing values have none."""
    kind, form = rule.get("type"), rule.get("format")
    present, t = v.isNotNull() & ~F.is_variant_null(v), F.schema_of_variant(v)
    right = F.lit(True)
    if kind == "integer":
        number = F.try_variant_get(v, "$", "double")
        right = F.coalesce(_TYPES["number"](t), F.lit(False)) & F.coalesce(number == F.floor(number), F.lit(False))
    elif kind in _TYPES:
        right = F.coalesce(_TYPES[kind](t), F.lit(False))
    found = [(present & ~right, label, f"expected {kind}")]
    fits = _fits(F.try_variant_get(v, "$", "string"), form) if form else None
    if fits is not None:  # a format applies to texts only
        found.append((present & right & (t == "STRING") & ~fits, label, f"invalid {form} format"))
    out, none = [_errors(*found)], F.array().cast(ERRORS)
    if kind == "object" and rule.get("properties"):
        inner = _object(v, rule, F.concat(label, F.lit(".")))
        out.append(F.when(present & right, F.concat(*inner)).otherwise(none))
    if kind == "array" and rule.get("items"):
        items = F.try_variant_get(v, "$", "array<variant>")
        each = F.transform(items, lambda x, i: F.concat(*_value(x, rule["items"], F.concat(label, F.lit("["), i.cast("string"), F.lit("]")))))
        out.append(F.coalesce(F.flatten(each), none))
    return out


def _object(v: Column, schema: dict, prefix: Column) -> list[Column]:
    name_of = lambda name: F.concat(prefix, F.lit(name))
    missing = [(_at(v, name).isNull(), name_of(name), "required field is missing") for name in dict.fromkeys(schema.get("required") or [])]
    out = [_errors(*missing)] if missing else []
    for name, rule in (schema.get("properties") or {}).items():
        out += _value(_at(v, name), rule, name_of(name))
    return out or [F.array().cast(ERRORS)]


def validation_errors(data: Column, schema: dict) -> Column:
    """Array of {field, message} for JSON text ``data``: required fields, types, formats, nested objects, array items.

    A required field must be there, null will do; a value of a wrong type isn't looked into; items keep their JSON types.
    Unknown fields and types are allowed; null data counts as {}.
    """
    return F.concat(*_object(F.try_parse_json(F.coalesce(data, F.lit("{}"))), schema, F.lit("")))

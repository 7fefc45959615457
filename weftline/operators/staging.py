"""Staged records: keyed upserts of JSON, fingerprints and change detection."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.paths import MARK, marked_numbers, object_json

KEY = ["tenant_id", "entity_type", "source_id", "integration", "source_key", "config_id"]


def merge_objects(order: Column, data: Column) -> Column:
    """Aggregate: right-biased shallow merge of maps in the order of ``order``. Each key keeps its last value."""
    entries = F.array_sort(F.collect_list(F.struct(order.alias("o"), data.alias("d"))))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda acc, e: F.map_from_entries(F.concat(F.map_entries(F.map_filter(acc, lambda k, v: ~F.map_contains_key(e["d"], k))), F.map_entries(e["d"]))))


def upsert(changes: DataFrame, key: list[str], order: list[str], data: str = "data", current: DataFrame | None = None) -> DataFrame:
    """(key..., data, n_changes, last_order): per key the shallow merge of all its JSON objects, later keys over earlier ones.

    Done per (key, field): the objects are exploded to fields, each keeps its last value by ``order`` (max_by folds before the
    shuffle), and the fields of a key are put together. ``current``: rows (key..., data) that the changes come on top of.
    Rows of deleted keys come back simply by being sent again. Null and empty data add no fields but keep their key.
    """
    o = F.struct(*[F.col(c) for c in order])
    rows = changes.select(*key, o.alias("_o"), F.lit(1).alias("_n"), F.explode(_marked_fields(data)).alias("_x"))
    if current is not None:
        old = current.select(*key, F.lit(None).cast(rows.schema["_o"].dataType).alias("_o"), F.lit(0).alias("_n"), F.explode(_marked_fields(data)).alias("_x"))
        rows = rows.unionByName(old)
    own = F.col("_x.field").isNull()
    last = rows.groupBy(*key, F.col("_x.field").alias("_k")).agg(F.max_by(F.struct("_x.value"), F.struct(F.col("_o").isNotNull(), "_o")).alias("_v"), F.max("_o").alias("_last"), F.sum(F.when(own, F.col("_n")).otherwise(0)).alias("_n"))
    whole = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_v.value")))))
    merged = last.groupBy(*key).agg(whole.alias("_m"), F.max("_last").alias("_last"), F.sum("_n").alias("n_changes"))
    return merged.select(*key, object_json(F.col("_m"), encoded=True).alias(data), "n_changes", *[F.col("_last")[c].alias(f"last_{c}") for c in order])


def _marked_fields(data: str) -> Column:
    """(field, value as JSON) of an object's members, after one row without a field that stands for the change itself: so one pass over
    the changes gives both, and a change without members is not lost."""
    marker = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")))
    members = F.transform(F.map_entries(F.from_json(data, "map<string,variant>")), lambda e: F.struct(e["key"].alias("field"), F.to_json(e["value"]).alias("value")))
    return F.concat(marker, F.coalesce(members, F.array().cast("array<struct<field:string,value:string>>")))


def field_changes(changes: DataFrame, key: list[str], order: list[str], data: str = "data") -> DataFrame:
    """(key..., field, value, at, n): of each key's JSON fields the last value by ``order``, and one row with a null field that
    holds the number of changes. Such tables merge: fold_changes over the union of several equals one over all changes, in
    whatever order they come, so late older changes never win."""
    at = F.struct(*[F.col(c) for c in order])
    rows = changes.select(*key, at.alias("at"), F.explode(_marked_fields(data)).alias("_x")).select(*key, "at", "_x.*")
    n = F.sum(F.when(F.col("field").isNull(), 1).otherwise(0))
    return rows.groupBy(*key, "field").agg(F.max_by(F.struct("value"), "at")["value"].alias("value"), F.max("at").alias("at"), n.alias("n"))


def merged_changes(parts: DataFrame, key: list[str]) -> DataFrame:
    """One row for each (key, field) of the union of several field_changes tables."""
    return parts.groupBy(*key, "field").agg(F.max_by(F.struct("value"), "at")["value"].alias("value"), F.max("at").alias("at"), F.sum("n").alias("n"))


def fold_changes(parts: DataFrame, key: list[str], order: list[str], data: str = "data") -> DataFrame:
    """(key..., data, n_changes, last_order) of field_changes tables."""
    fields = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "value")))))
    rows = merged_changes(parts, key).groupBy(*key).agg(fields.alias("_m"), F.max("at").alias("_last"), F.sum("n").alias("n_changes"))
    return rows.select(*key, object_json(F.col("_m"), encoded=True).alias(data), "n_changes", *[F.col("_last")[c].alias(f"last_{c}") for c in order])


#: Characters that canonical JSON escapes in texts, besides those that JSON itself does.
ESCAPED = "<>&\u2028\u2029"


def _escape(text: str) -> str:
    for c in ESCAPED:
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def canonical_json(data: str | None, exclude: tuple[str, ...] = ()) -> str | None:
    """Key-sorted compact JSON without the excluded dotted paths (a path excludes all below it); <, > and & are escaped."""
    if data is None:
        return None

    def walk(x: object, path: str) -> object:
        if isinstance(x, dict):
            return {k: walk(v, f"{path}.{k}" if path else k) for k, v in x.items() if not any((f"{path}.{k}" if path else k) == e for e in exclude)}
        return [walk(v, path) for v in x] if isinstance(x, list) else x

    def number(s: str) -> object:
        f = float(s)
        return int(f) if f.is_integer() and abs(f) < 1e21 else f

    try:
        got = json.loads(data, parse_float=number)
    except ValueError:
        return data
    return _escape(json.dumps(walk(got, ""), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _number(t: Column) -> Column:
    """The text of a JSON number: whole numbers without point and exponent below 1e21, others in their shortest form."""
    d = t.cast("double")
    size = F.abs(d)
    plain = lambda scale: F.regexp_replace(d.cast("string").cast(f"decimal(38,{scale})").cast("string"), r"\.?0+$", "")
    mantissa, exponent = F.regexp_replace(F.regexp_extract(d.cast("string"), r"^(-?[0-9.]+)E", 1), r"\.0$", ""), F.regexp_extract(d.cast("string"), r"E(-?[0-9]+)$", 1).cast("int")
    power = F.concat(mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    whole = F.when(t.rlike(r"^-?[0-9]+$"), F.when(t == "-0", "0").otherwise(t)).when((d == F.floor(d).cast("double")) & (size < 1e18), F.floor(d).cast("string")).when((size < 1e21) & (size >= 1e18), F.format_string("%.0f", d))
    return F.coalesce(whole, F.when(size >= 1, F.when(size < 1e21, plain(16))).when(size >= 1e-4, plain(24)), F.when(size < float("inf"), power), t)


def _without(text: Column, paths: list[list[str]], arrays: int = 2) -> Column:
    """JSON text without the members at ``paths``; elements of arrays (and of arrays in them) are under their array's path."""
    gone = [p[0] for p in paths if len(p) == 1]
    deeper = {p[0]: [q[1:] for q in paths if q[0] == p[0] and len(q) > 1] for p in paths if len(p) > 1 and p[0] not in gone}

    def value(e: Column) -> Column:
        own = F.to_json(e["value"])
        for k, rest in deeper.items():
            own = F.when(e["key"] == k, _without(F.to_json(e["value"]), rest)).otherwise(own)
        return own

    entries = F.filter(F.map_entries(F.from_json(text, "map<string,variant>")), lambda e: ~e["key"].isin(gone))
    whole = object_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), value(e).alias("value")))), encoded=True)
    out = F.when(text.startswith("{"), whole)
    if arrays:
        items = F.transform(F.try_parse_json(text).cast("array<variant>"), lambda x: _without(F.to_json(x), paths, arrays - 1))
        out = out.when(text.startswith("["), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
    return out.otherwise(text)


def canonical(data: Column, exclude: tuple[str, ...] = ()) -> Column:
    """canonical_json as a Column: a variant keeps the members of objects in the order of their keys; numbers travel as marked texts
    and get one form at the end. What a variant can't hold (no JSON, a repeated key) stays as it is."""
    text = F.to_json(F.try_parse_json(marked_numbers(data)))
    if exclude:
        text = F.to_json(F.try_parse_json(_without(text, [e.split(".") for e in exclude])))
    tokens = F.regexp_extract_all(text, F.lit(r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++)'), F.lit(1))

    def token(x: Column) -> Column:
        out = x
        for c in ESCAPED:
            out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
        return F.when(x.startswith(f'"{MARK}'), _number(F.substring(x, 3, F.length(x) - 4))).otherwise(out)

    return F.coalesce(F.array_join(F.transform(tokens, token), ""), data)


def fingerprint(data: Column, exclude: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the canonical form of free-form JSON text, in the JVM; null for null."""
    return F.sha2(canonical(data, exclude), 256)


def struct_fingerprint(names: list[str]) -> Column:
    """SHA-256 over typed columns, by name: stays in the JVM."""
    return F.sha2(F.to_json(F.struct(*[F.col(n) for n in sorted(names)])), 256)


def detect_changes(history: DataFrame, key: list[str], order: list[str], fingerprint_col: str = "fingerprint") -> DataFrame:
    """``history`` with previous_fingerprint and change: new, changed or unchanged against the row of the key before it."""
    by = Window.partitionBy(*key).orderBy(*order)
    before = F.lag(fingerprint_col).over(by)
    out = history.withColumn("previous_fingerprint", before)
    first = F.row_number().over(by) == 1
    same = F.col(fingerprint_col).eqNullSafe(F.col("previous_fingerprint"))
    return out.withColumn("change", F.when(first, "new").when(same, "unchanged").otherwise("changed"))


def latest_changes(feed: DataFrame, key: list[str], ts: str = "ts_ms", op: str = "op") -> DataFrame:
    """A change feed's last row of each key (by ``ts``); keys whose last change is a delete ("d") are left out."""
    rest = [c for c in feed.columns if c not in key]
    last = feed.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(ts), F.col(op))).alias("_x")).select(*key, "_x.*")
    return last.where(F.col(op) != "d")

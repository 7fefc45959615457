"""Queries over the driver's tables, one or more for each operator, with DuckDB SQL of the same result."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline import api
from weftline.functions import criteria as crit
from weftline.functions import normalize as norm
from weftline.functions import similarity as sim
from weftline.functions.actions import apply_action
from weftline.functions.jaro_batches import jaro_scores
from weftline.functions.paths import record_array
from weftline.functions.validation import validation_errors
from weftline.functions.values import BOOL, NUMBER, OBJECT, STRING, Value, array_of
from weftline.operators import deletion, graph, hotkeys, matching, merging, pairs, relations, routing, scheduling, staging
from weftline.plans.mapping import apply_mapping, latest_definitions
from weftline.plans.storage import shared_dir
from weftline.sources import datasource
from weftline.sources.feeds import file_stream
from weftline.streaming import pipeline as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _act(key: str, *ins: Value, **args) -> F.Column:
    return apply_action(key, list(ins), args).col


def _s(name: str) -> Value:
    return Value(F.col(name), STRING)


def _n(name: str) -> Value:
    return Value(F.col(name).cast("double"), NUMBER)


# -- mapping ------------------------------------------------------------------------------------------------------------

CUSTOMER_MAPPING = {
    "id": "customer",
    "source_fields": [
        {"id": "key", "path": "c_custkey", "type": "number"},
        {"id": "name", "path": "C_Name", "type": "string"},
        {"id": "segment", "path": "c_mktsegment", "type": "string"},
        {"id": "balance", "path": "c_acctbal", "type": "number"},
        {"id": "nick", "path": "nickname", "type": "string", "default": "none"},
    ],
    "target_fields": [
        {"id": "o_id", "path": "id", "type": "number"},
        {"id": "o_type", "path": "entity_type", "type": "string"},
        {"id": "o_label", "path": "label", "type": "string"},
        {"id": "o_segment", "path": "profile.segment", "type": "string"},
        {"id": "o_credit", "path": "profile.credit", "type": "number"},
        {"id": "o_good", "path": "profile.good_balance", "type": "number"},
        {"id": "o_nick", "path": "profile.nick", "type": "string"},
    ],
    "steps": [
        {"id": "upper", "type": "transformer", "action": {"key": "text_to_upper"}},
        {"id": "label", "type": "transformer", "action": {"key": "text_concat", "arguments": {"separator": " / "}}},
        {"id": "short", "type": "transformer", "action": {"key": "text_substring", "arguments": {"start": 0, "end": 4}}},
        {"id": "twice", "type": "transformer", "action": {"key": "number_multiply", "arguments": {"multiplier": 2}}},
        {"id": "good", "type": "condition", "action": {"key": "number_max", "arguments": {"max": 0}}},
    ],
    "links": [
        {"priority": 0, "source": {"field_id": "key"}, "target": {"field_id": "o_id"}},
        {"priority": 1, "source": {"constant": "person"}, "target": {"field_id": "o_type"}},
        {"priority": 2, "source": {"field_id": "name"}, "target": {"step_id": "upper"}},
        {"priority": 3, "source": {"step_id": "upper"}, "target": {"step_id": "label"}},
        {"priority": 4, "source": {"field_id": "segment"}, "target": {"step_id": "label"}},
        {"priority": 5, "source": {"step_id": "label"}, "target": {"field_id": "o_label"}},
        {"priority": 6, "source": {"field_id": "segment"}, "target": {"step_id": "short"}},
        {"priority": 7, "source": {"step_id": "short"}, "target": {"field_id": "o_segment"}},
        {"priority": 8, "source": {"field_id": "balance"}, "target": {"step_id": "twice"}},
        {"priority": 9, "source": {"step_id": "twice"}, "target": {"field_id": "o_credit"}},
        {"priority": 10, "source": {"field_id": "balance"}, "target": {"step_id": "good"}},
        {"priority": 11, "source": {"step_id": "good"}, "target": {"field_id": "o_good"}},
        {"priority": 12, "source": {"field_id": "nick"}, "target": {"field_id": "o_nick"}},
    ],
}


@query("""SELECT CAST(c_custkey AS DOUBLE) AS id, 'person' AS entity_type, concat(upper(c_name), ' / ', c_mktsegment) AS label, substr(c_mktsegment, 1, 4) AS segment,
round(c_acctbal * 2, 2) AS credit, CASE WHEN c_acctbal > 0 THEN round(c_acctbal, 2) END AS good_balance, 'none' AS nick FROM customer""")
def map_customer(spark: SparkSession, sf: str) -> DataFrame:
    out = apply_mapping(t(spark, sf, "customer"), CUSTOMER_MAPPING).where("error is null")
    return out.select("data.id", "data.entity_type", "data.label", "data.profile.segment", F.round("data.profile.credit", 2).alias("credit"), F.round("data.profile.good_balance", 2).alias("good_balance"), "data.profile.nick")


@query("""SELECT l_orderkey, l_linenumber, 1.5 + l_quantity + l_tax AS number_add, l_extendedprice - l_discount - 2 AS number_subtract, 3 * l_quantity * l_discount AS number_multiply,
l_extendedprice / l_quantity AS number_divide, abs(l_quantity - 25) AS number_abs, CASE WHEN l_quantity < 10 THEN 10 WHEN l_quantity > 40 THEN 40 ELSE l_quantity END AS number_clamp, CAST(sign(l_quantity - 25) AS DOUBLE) AS number_sign,
CAST(ceil(l_extendedprice) AS DOUBLE) AS number_ceiling, CAST(floor(l_extendedprice) AS DOUBLE) AS number_floor, round(cbrt(l_quantity), 6) AS number_cube_root, l_quantity * l_quantity * l_quantity AS number_cube, l_quantity * l_quantity AS number_square,
round(sqrt(l_quantity), 6) AS number_square_root, round(pow(l_quantity, 1.5), 4) AS number_exponent, round(pow(l_quantity, 1.0 / 3), 6) AS number_root, l_quantity % 7 AS number_modulus, l_quantity > 30 AS number_max, l_quantity < 10 AS number_min,
l_quantity = 17 AS number_equals, l_quantity % 2 = 0 AS number_is_even, l_quantity % 2 <> 0 AS number_is_odd, -l_quantity AS number_to_negative, abs(-l_quantity) AS number_to_positive,
floor(l_extendedprice * 10 + 0.5) / 10 AS number_round, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS number_to_string, l_quantity AS number_parse FROM lineitem""")
def action_numbers(spark: SparkSession, sf: str) -> DataFrame:
    q, p, d, x = _n("l_quantity"), _n("l_extendedprice"), _n("l_discount"), _n("l_tax")
    off = Value(F.col("l_quantity") - 25, NUMBER)
    r = lambda c, k: F.round(c, k)
    return t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        _act("number_add", q, x, value=1.5).alias("number_add"), _act("number_subtract", p, d, value=2).alias("number_subtract"), _act("number_multiply", q, d, multiplier=3).alias("number_multiply"),
        _act("number_divide", p, q).alias("number_divide"), _act("number_abs", off).alias("number_abs"), _act("number_clamp", q, min=10, max=40).alias("number_clamp"), _act("number_sign", off).alias("number_sign"),
        _act("number_ceiling", p).alias("number_ceiling"), _act("number_floor", p).alias("number_floor"), r(_act("number_cube_root", q), 6).alias("number_cube_root"), _act("number_cube", q).alias("number_cube"), _act("number_square", q).alias("number_square"),
        r(_act("number_square_root", q), 6).alias("number_square_root"), r(_act("number_exponent", q, exponent=1.5), 4).alias("number_exponent"), r(_act("number_root", q, root=3), 6).alias("number_root"), _act("number_modulus", q, denominator=7).alias("number_modulus"),
        _act("number_max", q, max=30).alias("number_max"), _act("number_min", q, min=10).alias("number_min"), _act("number_equals", q, value=17).alias("number_equals"), _act("number_is_even", q).alias("number_is_even"), _act("number_is_odd", q).alias("number_is_odd"),
        _act("number_to_negative", q).alias("number_to_negative"), _act("number_to_positive", Value(-F.col("l_quantity"), NUMBER)).alias("number_to_positive"), _act("number_round", p, precision=1).alias("number_round"),
        _act("number_to_string", q).alias("number_to_string"), _act("number_parse", Value(F.col("l_quantity").cast("string"), STRING)).alias("number_parse"),
    )


@query("""SELECT c_custkey, upper(c_name) AS text_to_upper, lower(c_name) AS text_to_lower, concat(c_name, '-', c_mktsegment) AS text_concat, contains(c_mktsegment, 'BUILD') AS text_contains, ends_with(c_mktsegment, 'ING') AS text_ends_with,
starts_with(lower(c_mktsegment), 'mach') AS text_starts_with, c_mktsegment = 'MACHINERY' AS text_equals, CAST(instr(c_name, '#') - 1 AS DOUBLE) AS text_index_of, CAST(strlen(c_name) AS DOUBLE) AS text_length,
strlen(c_name) <= 12 AS text_max_length, strlen(c_name) >= 12 AS text_min_length, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS text_pad, replace(c_name, '0', 'o') AS text_replace, regexp_matches(c_name, '[5-9]$') AS text_regex_match,
regexp_extract(c_name, '([0-9]+)$', 1) AS text_regex_extract, regexp_replace(c_name, '0+', '_', 'g') AS text_regex_replace, reverse(c_name) AS text_reverse, array_to_string(string_split(c_name, '#'), '|') AS text_split,
substr(c_name, 3, 4) AS text_substring, CAST(len(string_split(c_name, '')) AS BIGINT) AS text_to_array, c_nationkey % 2 = 1 AS text_to_bool, CAST(c_nationkey AS DOUBLE) AS text_to_number, trim(c_name, 'C') AS text_trim,
len(regexp_replace(c_name, '[^0-9]', '', 'g')) <= 5 AND len(regexp_replace(c_name, '[^A-Z]', '', 'g')) <= 1 AS text_allowed_char_count, len(regexp_replace(c_name, '[^0-9]', '', 'g')) >= 5 AS text_required_char_count FROM customer""")
def action_texts(spark: SparkSession, sf: str) -> DataFrame:
    n, s = _s("c_name"), _s("c_mktsegment")
    return t(spark, sf, "customer").select(
        "c_custkey", _act("text_to_upper", n).alias("text_to_upper"), _act("text_to_lower", n).alias("text_to_lower"), _act("text_concat", n, s, separator="-").alias("text_concat"), _act("text_contains", s, substring="BUILD").alias("text_contains"),
        _act("text_ends_with", s, substring="ING").alias("text_ends_with"), _act("text_starts_with", s, substring="mach", case_insensitive=True).alias("text_starts_with"), _act("text_equals", s, value="MACHINERY").alias("text_equals"),
        _act("text_index_of", n, substring="#").alias("text_index_of"), _act("text_length", n).alias("text_length"), _act("text_max_length", n, max_length=12).alias("text_max_length"), _act("text_min_length", n, min_length=12).alias("text_min_length"),
        _act("text_pad", Value(F.col("c_custkey").cast("string"), STRING), length=9, char="0", side="left").alias("text_pad"), _act("text_replace", n, old="0", new="o").alias("text_replace"), _act("text_regex_match", n, pattern="[5-9]$").alias("text_regex_match"),
        _act("text_regex_extract", n, pattern="([0-9]+)$", group=1).alias("text_regex_extract"), _act("text_regex_replace", n, pattern="0+", replacement="_").alias("text_regex_replace"), _act("text_reverse", n).alias("text_reverse"),
        F.array_join(_act("text_split", n, separator="#"), "|").alias("text_split"), _act("text_substring", n, start=2, end=6).alias("text_substring"), F.size(_act("text_to_array", n)).cast("long").alias("text_to_array"),
        _act("text_to_bool", Value((F.col("c_nationkey") % 2).cast("string"), STRING)).alias("text_to_bool"), _act("text_to_number", Value(F.col("c_nationkey").cast("string"), STRING)).alias("text_to_number"), _act("text_trim", n, chars="C").alias("text_trim"),
        _act("text_allowed_char_count", n, number=5, upper=1, lower=99, special=9, alpha=9).alias("text_allowed_char_count"), _act("text_required_char_count", n, number=5).alias("text_required_char_count"),
    )


@query("""WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS s, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts FROM orders)
SELECT o_orderkey, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date_parse, strftime(ts, '%Y/%m/%d %H:%M') AS date_format, date_diff('second', TIMESTAMP '1995-01-01', ts) / 86400.0 AS date_diff,
strftime(CAST(CAST(date_trunc('month', ts) AS TIMESTAMP) + INTERVAL 1 MONTH + to_days(CAST(day(ts) - 1 AS INTEGER)) + INTERVAL 30 HOUR AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS date_add,
strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS tokyo FROM d""")
def action_dates(spark: SparkSession, sf: str) -> DataFrame:
    orders = t(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("s"))
    d = _s("s")
    return orders.select(
        "o_orderkey", _act("date_parse", d).alias("date_parse"), _act("date_format", d, format="2006/01/02 15:04").alias("date_format"), _act("date_diff", Value(F.lit("1995-01-01"), STRING), d, unit="days").alias("date_diff"),
        _act("date_add", d, months=1, hours=30).alias("date_add"), _act("date_parse", d, timezone="Asia/Tokyo", output_format="datetime").alias("tokyo"),
    )


@query("""WITH w AS (SELECT doc_id, string_split(regexp_replace(text, '[\\n\\r\\t ]+', ' ', 'g'), ' ') AS a FROM documents)
SELECT doc_id, CAST(len(a) AS DOUBLE) AS array_length, list_contains(a, 'the') OR list_contains(a, 'der') AS array_contains, CAST(len(list_distinct(a)) AS DOUBLE) AS distinct_length, CAST(len(list_filter(a, lambda x: strlen(x) >= 8)) AS DOUBLE) AS filtered,
len(list_filter(a, lambda x: strlen(x) > 30)) = 0 AS array_every, CAST(coalesce(list_position(a, 'the'), 0) - 1 AS DOUBLE) AS array_index_of, array_to_string(a[1:3], ' ') AS array_take, array_to_string(a[4:5], ' ') AS skip_take,
array_to_string(list_reverse(a[1:3]), ' ') AS array_reverse, CAST(len(a) + 2 AS DOUBLE) AS array_push FROM w""")
def action_arrays(spark: SparkSession, sf: str) -> DataFrame:
    docs = t(spark, sf, "documents").select("doc_id", F.split(F.regexp_replace("text", "[\\n\\r\\t ]+", " "), " ", -1).alias("a"))
    a = Value(F.col("a"), array_of(STRING))
    of = lambda c: Value(c, array_of(STRING))
    return docs.select(
        "doc_id", _act("array_length", a).alias("array_length"), _act("array_contains", a, searchItems=["the", "der"]).alias("array_contains"), _act("array_length", of(_act("array_distinct", a))).alias("distinct_length"),
        _act("array_length", of(_act("array_filter", a, actionKey="text_min_length", args={"min_length": 8}))).alias("filtered"), _act("array_every", a, actionKey="text_max_length", args={"max_length": 30}).alias("array_every"),
        _act("array_index_of", a, item="the").alias("array_index_of"), F.array_join(_act("array_take", a, count=3), " ").alias("array_take"), F.array_join(_act("array_take", of(_act("array_skip", a, count=3)), count=2), " ").alias("skip_take"),
        F.array_join(_act("array_reverse", of(_act("array_take", a, count=3))), " ").alias("array_reverse"), _act("array_length", of(_act("array_push", a, items=["x", "y"]))).alias("array_push"),
    )


@query("""SELECT c_custkey, array_to_string(list_sort(string_split(c_name, '0')), ',') AS items, CAST(len(string_split(c_name, '0')) AS BIGINT) AS n FROM customer""")
def action_array_randomize(spark: SparkSession, sf: str) -> DataFrame:
    """The items in any order: compared sorted."""
    a = _act("array_randomize", Value(F.split("c_name", "0"), array_of(STRING)))
    return t(spark, sf, "customer").select("c_custkey", F.array_join(F.array_sort(a), ",").alias("items"), F.size(a).cast("long").alias("n"))


@query("""SELECT s_suppkey, CAST(factorial(CAST(s_suppkey % 15 AS INTEGER)) AS DOUBLE) AS factorial FROM supplier""")
def action_factorial(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "supplier").select("s_suppkey", _act("number_factorial", Value((F.col("s_suppkey") % 15).cast("double"), NUMBER)).alias("factorial"))


@query("""SELECT c_custkey, array_to_string(flatten([string_split(c_name, '#'), string_split(c_mktsegment, 'I')]), ',') AS items FROM customer""")
def action_flatten(spark: SparkSession, sf: str) -> DataFrame:
    a = Value(F.array(F.split("c_name", "#"), F.split("c_mktsegment", "I")), array_of(array_of(STRING)))
    return t(spark, sf, "customer").select("c_custkey", F.array_join(_act("array_flatten", a), ",").alias("items"))


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS object_get, array_to_string(list_sort(json_keys(props)), ',') AS object_keys, CAST(len(json_keys(props)) AS BIGINT) AS n_values,
CAST(len(list_filter(json_keys(props), lambda k: k = 'k')) AS BIGINT) AS picked, CAST(len(list_filter(json_keys(props), lambda k: k <> 'k')) AS BIGINT) AS omitted, CAST(len(list_distinct(list_append(json_keys(props), 'added'))) AS BIGINT) AS merged FROM events""")
def action_objects(spark: SparkSession, sf: str) -> DataFrame:
    events = t(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    m = Value(F.col("m"), OBJECT)
    extra = Value(F.create_map(F.lit("added"), F.lit("1")), OBJECT)
    return events.select(
        "event_id", _act("object_get", m, path="k", default="none").alias("object_get"), F.array_join(_act("object_keys", m, sorted=True), ",").alias("object_keys"), F.size(_act("object_values", m)).cast("long").alias("n_values"),
        F.size(_act("object_pick", m, keys=["k"])).cast("long").alias("picked"), F.size(_act("object_omit", m, keys=["k"])).cast("long").alias("omitted"), F.size(_act("object_merge", m, extra)).cast("long").alias("merged"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE o_orderpriority END AS any_coalesce, CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE o_orderstatus END AS any_default,
CASE WHEN o_totalprice > 100000 THEN o_orderpriority ELSE 'small' END AS any_if_else, o_orderstatus = 'F' AS any_is_nil, o_orderstatus = 'F' AS any_is_empty, CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END AS any_to_string FROM orders""")
def action_any(spark: SparkSession, sf: str) -> DataFrame:
    status = Value(F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")), STRING)
    prio = Value(F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")), STRING)
    blank = Value(F.lit(""), STRING)
    big = Value(F.col("o_totalprice") > 100000, BOOL)
    return t(spark, sf, "orders").select(
        "o_orderkey", _act("any_coalesce", blank, prio, default="none").alias("any_coalesce"), _act("any_default", status, default="none").alias("any_default"), _act("any_if_else", big, _s("o_orderpriority"), **{"else": "small"}).alias("any_if_else"),
        _act("any_is_nil", status).alias("any_is_nil"), _act("any_is_empty", status).alias("any_is_empty"), _act("any_to_string", big).alias("any_to_string"),
    )


FAN_IN = {
    "source_fields": [
        {"id": "o", "path": "o_orderkey", "type": "number"},
        {"id": "lines", "path": "lines", "type": "array", "items": {"id": "line", "type": "object", "fields": [{"id": "part", "path": "l_partkey", "type": "number"}, {"id": "qty", "path": "l_quantity", "type": "number"}]}},
    ],
    "target_fields": [
        {"id": "t_order", "path": "order", "type": "number"},
        {"id": "t_total", "path": "total", "type": "number"},
        {"id": "t_rels", "path": "rels", "type": "array", "items": {"id": "t_rel", "type": "object", "fields": [{"id": "t_type", "path": "_relationship_type", "type": "string"}, {"id": "t_from", "path": "_from_source_id", "type": "number"}, {"id": "t_to", "path": "_to_source_id", "type": "number"}]}},
    ],
    "steps": [{"id": "sum", "type": "transformer", "action": {"key": "number_add"}}],
    "links": [
        {"source": {"field_id": "o"}, "target": {"field_id": "t_order"}},
        {"source": {"field_id": "qty"}, "target": {"step_id": "sum"}},
        {"source": {"step_id": "sum"}, "target": {"field_id": "t_total"}},
        {"source": {"constant": "holds"}, "target": {"field_id": "t_type"}},
        {"source": {"field_id": "o"}, "target": {"field_id": "t_from"}},
        {"source": {"field_id": "part"}, "target": {"field_id": "t_to"}},
    ],
}


def _orders_with_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    return lines


@query("""SELECT CAST(l_orderkey AS DOUBLE) AS "order", 'holds' AS rel, CAST(l_orderkey AS DOUBLE) AS from_id, CAST(l_partkey AS DOUBLE) AS to_id, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total FROM lineitem""")
def map_array_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Array fan-in into a step, aligned array-of-object output, and scalars broadcast into its items."""
    out = apply_mapping(_orders_with_lines(spark, sf), FAN_IN)
    return out.select("data.order", "data.total", F.explode("data.rels").alias("r")).select("order", F.col("r._relationship_type").alias("rel"), F.col("r._from_source_id").alias("from_id"), F.col("r._to_source_id").alias("to_id"), "total")


@query("""SELECT l_orderkey AS o_orderkey, 'holds' AS relationship_type, CAST(l_partkey AS DOUBLE) AS to_id FROM lineitem""")
def explode_batch_records(spark: SparkSession, sf: str) -> DataFrame:
    out = routing.explode_records(apply_mapping(_orders_with_lines(spark, sf), FAN_IN).drop("lines"))
    return out.select("o_orderkey", F.get_json_object("record", "$._relationship_type").alias("relationship_type"), F.get_json_object("record", "$._to_source_id").cast("double").alias("to_id"))


def _gate(kind: str, invert: bool = False) -> dict:
    return {
        "source_fields": [{"id": "a", "path": "o_custkey", "type": "number"}, {"id": "b", "path": "o_orderkey", "type": "number"}],
        "target_fields": [{"id": "r", "path": "result", "type": "number"}, {"id": "g", "path": "gated", "type": "number"}],
        "steps": [{"id": "even", "type": kind, "action": {"key": "number_is_even", "invert": invert}}, {"id": "add", "type": "transformer", "action": {"key": "number_add"}}],
        "links": [
            {"priority": 0, "source": {"field_id": "a"}, "target": {"step_id": "even"}},
            {"priority": 1, "source": {"step_id": "even"}, "target": {"step_id": "add"}},
            {"priority": 2, "source": {"field_id": "b"}, "target": {"step_id": "add"}},
            {"priority": 3, "source": {"step_id": "add"}, "target": {"field_id": "r"}},
            {"priority": 4, "source": {"step_id": "even"}, "target": {"field_id": "g"}},
        ],
    }


@query("""SELECT o_orderkey, CAST(o_orderkey + CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE 0 END AS DOUBLE) AS result, CAST(CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS DOUBLE) AS gated FROM orders""")
def gate_condition(spark: SparkSession, sf: str) -> DataFrame:
    return apply_mapping(t(spark, sf, "orders"), _gate("condition")).select("o_orderkey", "data.result", "data.gated")


@query("""SELECT o_orderkey, CAST(o_orderkey + CASE WHEN o_custkey % 2 <> 0 THEN o_custkey ELSE 0 END AS DOUBLE) AS result, CAST(CASE WHEN o_custkey % 2 <> 0 THEN o_custkey END AS DOUBLE) AS gated FROM orders""")
def gate_validator(spark: SparkSession, sf: str) -> DataFrame:
    return apply_mapping(t(spark, sf, "orders"), _gate("validator", True)).select("o_orderkey", "data.result", "data.gated")


@query("""SELECT CASE WHEN c_acctbal < 0 THEN 'dead' ELSE 'good' END AS route, count(*) AS n FROM customer GROUP BY 1""")
def error_routing(spark: SparkSession, sf: str) -> DataFrame:
    d = {
        "source_fields": [{"id": "b", "path": "c_acctbal", "type": "number"}], "target_fields": [{"id": "r", "path": "root", "type": "number"}],
        "steps": [{"id": "root", "type": "transformer", "action": {"key": "number_square_root"}}],
        "links": [{"source": {"field_id": "b"}, "target": {"step_id": "root"}}, {"source": {"step_id": "root"}, "target": {"field_id": "r"}}],
    }
    good, dead = routing.split_errors(apply_mapping(t(spark, sf, "customer"), d))
    return good.select(F.lit("good").alias("route")).unionByName(dead.select(F.lit("dead").alias("route"))).groupBy("route").agg(F.count("*").alias("n"))


# -- routing ------------------------------------------------------------------------------------------------------------

BINDINGS = [
    ("b1", 1, True, "m1", {"integration": "web", "keys": [], "status_codes": [], "min": 0, "max": 0, "prefix": "", "url": ""}),
    ("b2", 2, True, "m2", {"integration": "web", "keys": ["click", "view"], "status_codes": [], "min": 0, "max": 0, "prefix": "", "url": ""}),
    ("b3", 3, True, "m3", {"integration": "web", "keys": [], "status_codes": [200, 201], "min": 0, "max": 0, "prefix": "root.1", "url": ""}),
    ("b4", 4, True, "m4", {"integration": "web", "keys": [], "status_codes": [], "min": 200, "max": 299, "prefix": "", "url": "/7"}),
    ("b5", 5, False, "m5", {"integration": "web", "keys": [], "status_codes": [], "min": 0, "max": 0, "prefix": "", "url": ""}),
    ("b6", 6, True, "m6", {"integration": "app", "keys": [], "status_codes": [], "min": 0, "max": 0, "prefix": "", "url": ""}),
]


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").select(
        F.col("event_id").alias("message_id"), F.lit("t").alias("tenant_id"), F.lit("web").alias("integration"), F.col("event_type").alias("plan_key"),
        (F.lit(200) + F.col("event_id") % 3 * 100).cast("int").alias("status_code"), F.concat(F.lit("root."), F.col("user_id").cast("string")).alias("step_path"), F.concat(F.lit("http://x/"), F.col("user_id").cast("string")).alias("request_url"),
    )


def _bindings(spark: SparkSession) -> DataFrame:
    rows = [(i, o, e, "t", m, "out", (f["integration"], f["keys"], f["status_codes"], f["prefix"], f["url"], f["min"], f["max"])) for i, o, e, m, f in BINDINGS]
    schema = "id string, ord int, is_enabled boolean, tenant_id string, mapping_id string, output_topic string, filter struct<integration:string, keys:array<string>, status_codes:array<int>, step_path_prefix:string, request_url_contains:string, min_status_code:int, max_status_code:int>"
    return spark.createDataFrame(rows, schema)


_BIND_SQL = """WITH m AS (SELECT event_id AS message_id, event_type, 200 + event_id % 3 * 100 AS sc, 'root.' || user_id AS sp, 'http://x/' || user_id AS url FROM events),
r AS (SELECT message_id, 'b1' AS binding_id, 1 AS ord, 1 AS score FROM m UNION ALL SELECT message_id, 'b2', 2, 11 FROM m WHERE event_type IN ('click', 'view')
UNION ALL SELECT message_id, 'b3', 3, 11 FROM m WHERE sc IN (200, 201) AND starts_with(sp, 'root.1') UNION ALL SELECT message_id, 'b4', 4, 8 FROM m WHERE sc BETWEEN 200 AND 299 AND contains(url, '/7'))
"""


@query(_BIND_SQL + "SELECT message_id, binding_id, score FROM r")
def route_bindings(spark: SparkSession, sf: str) -> DataFrame:
    return routing.match_bindings(_messages(spark, sf), _bindings(spark)).select("message_id", "binding_id", "score")


@query(_BIND_SQL + "SELECT message_id, binding_id, score FROM r QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY score DESC, ord) = 1")
def route_first(spark: SparkSession, sf: str) -> DataFrame:
    return routing.match_bindings(_messages(spark, sf), _bindings(spark), first=True).select("message_id", "binding_id", "score")


@query("""SELECT conv_id, 'root[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ']' AS step_path, role, turn FROM conversations""")
def explode_pages(spark: SparkSession, sf: str) -> DataFrame:
    conv = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("response_body")).withColumn("step_path", F.lit("root"))
    return routing.explode_pages(conv).select("conv_id", "step_path", "response_body.role", "response_body.turn")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'delete' WHEN event_id % 3 = 0 THEN 'relationship' ELSE 'entity' END AS message_class, 'user' AS entity_type,
CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'bind:' || event_id END AS source_id, 'crm' AS integration FROM events""")
def classify_messages(spark: SparkSession, sf: str) -> DataFrame:
    null = F.lit(None).cast("string")
    data = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(x) for x in ("_entity_type", "_source_id", "_relationship_type")]), F.array(F.lit("user"), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(""), F.when(F.col("event_id") % 3 == 0, "knows"))),
        lambda k, v: v.isNotNull(),
    )
    cols = routing.classify(data, null, null, F.when(F.col("event_id") % 5 == 0, "delete"), F.lit("bind"), F.col("event_id").cast("string"), F.lit("crm"))
    return t(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in cols.items()])


@query("""SELECT event_id FROM events WHERE event_type IN ('purchase', 'refund', 'click') AND value > 10 AND value <= 90 AND contains(event_type, 'c')""")
def criteria_filter(spark: SparkSession, sf: str) -> DataFrame:
    data = F.to_json(F.struct("event_type", "value", "user_id"))
    return t(spark, sf, "events").where(crit.matches(data, {"event_type": {"$in": ["purchase", "refund", "click"], "$contains": "c"}, "value": {"$gt": "10", "$lte": "90"}, "user_id": {"$exists": True}, "missing": {"$ne": "x"}})).select("event_id")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END AS n_errors FROM customer""")
def schema_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Missing and null required fields, formats, and items of mixed types."""
    email = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("a"), F.col("c_custkey").cast("string"), F.lit("@x.org"))).otherwise("no mail")
    own = F.to_json(F.struct(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), email.alias("email")))
    tags = F.when(F.col("c_custkey") % 3 == 0, F.lit('[1, "2", null, 1.5]')).otherwise("[1, null, 2]")
    data = F.concat(F.regexp_replace(own, r"\}$", ', "note": null, "tags": '), tags, F.lit("}"))
    schema = {"required": ["balance", "note"], "properties": {"balance": {"type": "number"}, "email": {"type": "string", "format": "email"}, "tags": {"type": "array", "items": {"type": "integer"}}}}
    return t(spark, sf, "customer").select("c_custkey", F.size(validation_errors(data, schema)).alias("n_errors"))


# -- record linkage -----------------------------------------------------------------------------------------------------


def _people(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size"))


@query("""WITH p AS (SELECT p_partkey AS id, lower(p_name) AS n, p_brand AS b, p_type AS ty, CAST(p_size AS VARCHAR) AS s FROM part),
x AS (SELECT a.id AS a, b.id AS b, (2 + CASE WHEN a.n = b.n THEN 1 ELSE 0 END) / 3.0 AS score FROM p a JOIN p b ON a.b = b.b AND a.s = b.s AND a.id < b.id)
SELECT a, b, round(score, 6) AS score, score >= 0.95 AS auto_merge FROM x WHERE score >= 0.5""")
def match_exact(spark: SparkSession, sf: str) -> DataFrame:
    rule = matching.Rule("brand", (matching.Condition("brand", required=True), matching.Condition("size", required=True), matching.Condition("name", normalizer="lowercase")))
    name_free = matching.Rule("brand", tuple(c for c in rule.conditions if c.required))
    index = matching.build_index(_people(spark, sf), [rule])
    return matching.matched_pairs(index, [rule], [name_free], digits=6).select("a", "b", "score", "auto_merge")


_SOUNDEX_SQL = """rpad(left(concat(left(w, 1), replace(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
translate(concat(left(w, 1), regexp_replace(substr(w, 2), '[^A-Z]', '', 'g')), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000'), '0+', '0', 'g'), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g'), 2), '0', '')), 4), 4, '0')"""


@query(f"""WITH p AS (SELECT p_partkey, upper(p_name) AS w FROM part) SELECT p_partkey, {_SOUNDEX_SQL} AS token FROM p""")
def match_phonetic_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", sim.soundex(F.col("p_name")).alias("token"))


_TRI_SQL = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@query(f"""WITH p AS (SELECT DISTINCT p_name AS v, {_TRI_SQL.format(c="p_name")} AS g FROM part)
SELECT a.v AS a, b.v AS b, round(len(list_intersect(a.g, b.g)) / CAST(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) AS DOUBLE), 6) AS similarity FROM p a JOIN p b ON a.v < b.v
WHERE len(list_intersect(a.g, b.g)) / CAST(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) AS DOUBLE) >= 0.5""")
def match_trigram(spark: SparkSession, sf: str) -> DataFrame:
    values = t(spark, sf, "part").select(F.col("p_name").alias("v")).distinct()
    pairs = matching.trigram_pairs(values, 0.5)
    return pairs.select("a", "b", F.round(sim.trigram_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


_RULES_SQL = f"""WITH p AS (SELECT p_partkey AS id, p_name AS n, p_brand AS b, p_size AS s, upper(p_type) AS w FROM part), q AS (SELECT id, n, b, s, {_SOUNDEX_SQL} AS ty FROM p),
g AS (SELECT DISTINCT p_name AS v, {_TRI_SQL.format(c="p_name")} AS g FROM part), sim AS (SELECT a.v AS x, b.v AS y, len(list_intersect(a.g, b.g)) / CAST(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) AS DOUBLE) AS sim FROM g a, g b),
c AS (SELECT a.id AS i, b.id AS j, CAST(a.n = b.n AS INTEGER) AS ne, CAST(a.b = b.b AS INTEGER) AS be, CAST(a.ty = b.ty AS INTEGER) AS te, sim, a.s <> b.s AS blocked FROM q a JOIN q b ON a.id < b.id JOIN sim ON x = a.n AND y = b.n),
d AS (SELECT i, j, blocked, (ne + be) / CAST(2 AS DOUBLE) AS s1, CASE WHEN sim >= 0.8 THEN sim * CAST(0.8 AS DOUBLE) ELSE -1 END AS s2, (be + te) / CAST(2 AS DOUBLE) AS s3 FROM c WHERE ne + be = 2 OR sim >= 0.8 OR be + te = 2),
e AS (SELECT i, j, blocked, greatest(s1, s2, s3) AS score, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 'strict' WHEN s2 >= s3 THEN 'fuzzy' ELSE 'veto' END AS rule FROM d), f AS (SELECT * FROM e WHERE score >= 0.5 OR blocked),
h AS (SELECT i AS source, j AS candidate, score, rule, blocked FROM f UNION ALL SELECT j, i, score, rule, blocked FROM f)
SELECT source, candidate, score, rule, blocked, score >= 0.95 AND NOT blocked AS auto_merge FROM h QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, candidate) <= 100"""


@query(_RULES_SQL)
def match_rules_top(spark: SparkSession, sf: str) -> DataFrame:
    """Several rules with a veto, fuzzy anchors, and the best candidates of each record."""
    C = matching.Condition
    rules = [
        matching.Rule("strict", (C("name", "exact", normalizer="nname"), C("brand")), priority=2),
        matching.Rule("fuzzy", (C("name", "fuzzy", 1.0, True, 0.8),), priority=1, score_weight=0.8),
        matching.Rule("veto", (C("size", "exact", no_merge=True, invert=True), C("brand"), C("type", "phonetic"))),
    ]
    return hotkeys.class_matches(_people(spark, sf), rules)


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, round(1.0 - levenshtein(a.p_name, b.p_name) / CAST(greatest(len(a.p_name), len(b.p_name)) AS DOUBLE), 6) AS similarity FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def lev_similarity(spark: SparkSession, sf: str) -> DataFrame:
    own = pairs.fold(t(spark, sf, "part"), ["p_brand", "p_size", "p_name"], "p_partkey")
    first = [F.array_min(f"{s}.ids") for s in ("x", "y")]
    met = pairs.meet(own, own, ["p_brand", "p_size"], "ids", F.size("ids")).where(first[0] <= first[1])
    found = met.select(F.round(sim.levenshtein_similarity(F.col("x.p_name"), F.col("y.p_name")), 6).alias("similarity"), F.col("x.ids").alias("i"), F.col("y.ids").alias("j"), (first[0] == first[1]).alias("one"))
    return pairs.expand(found, "i", "j", F.col("one")).select("a", "b", "similarity")


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(jaro_similarity(a.s_name, b.s_name), 6) AS jaro, round(jaro_winkler_similarity(a.s_name, b.s_name), 6) AS jaro_winkler FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def jaro_similarity(spark: SparkSession, sf: str) -> DataFrame:
    own = pairs.fold(t(spark, sf, "supplier"), ["s_nationkey", "s_name"], "s_suppkey")
    # Jaro may change when texts change places, so names meet both ways, as far as some supplier of one comes before one of the other.
    met = pairs.meet(own, own, ["s_nationkey"], "ids", F.size("ids")).where(F.array_min("x.ids") < F.array_max("y.ids"))
    scored = jaro_scores(met.select(F.col("x.s_name").alias("p"), F.col("y.s_name").alias("q"), F.col("x.ids").alias("i"), F.col("y.ids").alias("j")), "p", "q", whole=True)
    return pairs.ordered(scored.select("i", "j", F.round("jaro", 6).alias("jaro"), F.round("jaro_winkler", 6).alias("jaro_winkler")), "i", "j")


@query("""SELECT a.o_orderkey AS o_orderkey, greatest(0, 1 - CAST(abs(date_diff('microsecond', TIMESTAMP '1996-01-01', a.o_orderdate)) AS DOUBLE) / CAST(86400000000 AS DOUBLE) / 365) AS date_score, greatest(0, 1 - abs(a.o_totalprice - 150000) / 100000) AS number_score,
(greatest(0, 1 - CAST(abs(date_diff('microsecond', TIMESTAMP '1996-01-01', a.o_orderdate)) AS DOUBLE) / CAST(86400000000 AS DOUBLE) / 365) + greatest(0, 1 - abs(a.o_totalprice - 150000) / 100000) * 3) / 4 AS weighted FROM orders a""")
def proximity_scores(spark: SparkSession, sf: str) -> DataFrame:
    d = sim.date_proximity(F.col("o_orderdate").cast("timestamp"), F.lit("1996-01-01").cast("timestamp"), 365)
    n = sim.numeric_proximity(F.col("o_totalprice"), F.lit(150000.0), 100000)
    return t(spark, sf, "orders").select("o_orderkey", d.alias("date_score"), n.alias("number_score"), sim.weighted([(d, 1.0), (n, 3.0)]).alias("weighted"))


@query(r"""SELECT c_custkey, lower(c_name) AS lowercase, upper(c_name) AS uppercase, regexp_replace(c_name, '[^0-9]', '', 'g') AS nphone, lower(trim(c_name)) AS nemail, replace(c_name, ' ', '') AS remove_whitespace,
regexp_replace(c_name, '[#]', '', 'g') AS remove_punctuation, regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') AS alphanumeric, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS nname FROM customer""")
def normalizers(spark: SparkSession, sf: str) -> DataFrame:
    names = ("lowercase", "uppercase", "nphone", "nemail", "remove_whitespace", "remove_punctuation", "alphanumeric", "nname")
    return t(spark, sf, "customer").select("c_custkey", *[norm.normalize(F.col("c_name"), n).alias(n) for n in names])


def _metaphone_sql(c: str) -> str:
    """The rules of the simplified Metaphone as SQL. RE2 looks neither ahead nor behind, so what follows is captured and put back; runs
    of a letter are folded letter by letter."""
    w = f"regexp_replace(upper({c}), '[^A-Z]', '', 'g')"
    w = f"regexp_replace({w}, '^(?:K(N)|G(N)|P(N)|W(R)|A(E))', '\\1\\2\\3\\4\\5')"
    for old, new in (
        ("^X", "S"), ("^WH", "W"), ("MB$", "M"), ("SCH", "SK"), ("TI[AO]", "X"), ("CIA", "X"), ("SI[AO]", "X"), ("TCH", "CH"), ("TH", "0"), ("[CS]H", "X"), ("PH", "F"), ("GH", ""),
        ("DG([EIY])", r"J\1"), ("C([EIY])", r"S\1"), ("[CQ]", "K"), ("G([EIY])", r"J\1"), ("G", "K"), ("D", "T"), ("V", "F"), ("Z", "S"),
        ("([AEIOU])H([^AEIOU]|$)", r"\1\2"), ("W+([^AEIOUW]|$)", r"\1"), ("W+(W[AEIOU])", r"\1"), ("Y+([^AEIOUY]|$)", r"\1"), ("Y+(Y[AEIOU])", r"\1"), *((f"{x}+", x) for x in "0ABDEFGHIJKLMNOPQRSTUVWXYZ"),
    ):
        w = f"regexp_replace({w}, '{old}', '{new}', 'g')"
    return f"left(left({w}, 1) || regexp_replace(substr({w}, 2), '[AEIOU]', '', 'g'), 6)"


@query(f"""WITH n AS (SELECT DISTINCT p_name FROM part), m AS (SELECT p_name, {_metaphone_sql("p_name")} AS token FROM n) SELECT p_partkey, token FROM part JOIN m USING (p_name)""")
def metaphone_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", sim.metaphone(F.col("p_name")).alias("token"))


# -- staging, merging ---------------------------------------------------------------------------------------------------


def _order_records(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster_id"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderstatus").alias("integration"),
        F.col("o_orderpriority").alias("prio"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("note"), F.lit(None).cast("double").alias("nothing"),
    )


STRATEGIES = ("most_recent", "first", "most_trusted", "longest", "shortest", "prefer_non_empty")
_TRUST = {"F": 3, "O": 2, "P": 1}


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS cluster_id, o_orderdate AS u, o_orderpriority AS prio, o_totalprice AS price, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS note, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS trust FROM orders)
SELECT cluster_id, first(prio ORDER BY u DESC, id DESC) AS most_recent, first(prio ORDER BY u, id) AS "first", first(prio ORDER BY trust DESC, u, id) AS most_trusted, first(prio ORDER BY strlen(prio) DESC, u, id) AS longest,
first(note ORDER BY strlen(note), u, id) FILTER (WHERE note <> '') AS shortest, first(note ORDER BY note = '', u, id) AS prefer_non_empty, max(price) AS max_price, min(price) AS min_price, round(sum(price), 2) AS sum_price, round(avg(price), 6) AS avg_price,
CAST(0 AS DOUBLE) AS sum_nothing, array_to_string(list_distinct(list(prio)).list_sort(), ',') AS collected, count(*) AS source_count FROM o GROUP BY cluster_id""")
def merge_strategies(spark: SparkSession, sf: str) -> DataFrame:
    rec = _order_records(spark, sf)
    types = dict(rec.dtypes)
    m = lambda f, s: merging.merged_value(merging.FieldRule(f, s), types[f], _TRUST)
    cols = [m("note" if s in ("shortest", "prefer_non_empty") else "prio", s).alias(s) for s in STRATEGIES]
    return rec.groupBy("cluster_id").agg(
        *cols, m("price", "max").alias("max_price"), m("price", "min").alias("min_price"), F.round(m("price", "sum"), 2).alias("sum_price"), F.round(m("price", "average"), 6).alias("avg_price"),
        m("nothing", "sum").alias("sum_nothing"), F.array_join(F.array_sort(m("prio", "collect_all")), ",").alias("collected"), F.count("*").alias("source_count"),
    )


@query("""SELECT o_custkey AS cluster_id, count(*) AS n_values, first(o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS resolved_value FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1""")
def merge_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    out = merging.conflicts(_order_records(spark, sf), [merging.FieldRule("prio", "most_recent")])
    return out.select("cluster_id", F.size("values").cast("long").alias("n_values"), "resolved_value")


@query("""SELECT min(p_partkey) AS cluster_id, count(*) AS source_count, max(p_retailprice) AS price FROM part GROUP BY p_brand, p_size""")
def golden_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Match by exact rule, connected components, golden records. Matches are links of a record to its group's first."""
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size", F.col("p_retailprice").alias("price"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"), F.lit("x").alias("integration"))
    first = F.lag("id").over(Window.partitionBy("p_brand", "p_size").orderBy("id"))
    links = p.select(F.col("id").alias("a"), first.alias("b"), F.lit(1.0).alias("score"), F.lit(False).alias("blocked")).where("b is not null")
    members = merging.cluster_records(p, links)
    return merging.golden_records(members, [merging.FieldRule("price", "max")]).select("cluster_id", "source_count", "price")


@query("""SELECT user_id, count(*) AS n_changes, last(event_type ORDER BY ts, event_id) AS last_type, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS has_purchase FROM events GROUP BY user_id""")
def staged_upsert(spark: SparkSession, sf: str) -> DataFrame:
    ev = t(spark, sf, "events").select("user_id", "ts", "event_id", F.to_json(F.map_from_arrays(F.array(F.lit("type"), F.concat(F.lit("seen_"), "event_type")), F.array(F.col("event_type"), F.lit("1")))).alias("data"))
    out = staging.upsert(ev, ["user_id"], ["ts", "event_id"])
    return out.select("user_id", "n_changes", F.get_json_object("data", "$.type").alias("last_type"), F.coalesce(F.get_json_object("data", "$.seen_purchase").cast("int"), F.lit(0)).alias("has_purchase"))


@query("""SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS fingerprint FROM events""")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    data = F.to_json(F.struct("user_id", F.named_struct(F.lit("secret"), F.lit(1)).alias("meta"), "event_type"))
    return t(spark, sf, "events").select("event_id", data.alias("data")).select("event_id", staging.fingerprint(F.col("data"), ("meta",)).alias("fingerprint"))


@query("""SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN lag(event_type) OVER w = event_type THEN 'unchanged' ELSE 'changed' END AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def change_detection(spark: SparkSession, sf: str) -> DataFrame:
    h = t(spark, sf, "events").withColumn("fingerprint", F.sha2("event_type", 256))
    return staging.detect_changes(h, ["user_id"], ["ts", "event_id"]).select("event_id", "change")


@query("""SELECT user_id, last(event_type ORDER BY ts, event_id) AS event_type FROM events GROUP BY user_id HAVING last(event_type ORDER BY ts, event_id) <> 'purchase'""")
def cdc_latest(spark: SparkSession, sf: str) -> DataFrame:
    feed = t(spark, sf, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("ts_ms"), F.when(F.col("event_type") == "purchase", "d").otherwise("u").alias("op"))
    return staging.latest_changes(feed, ["user_id"]).select("user_id", "event_type")


# -- relationships, deletion, graph -------------------------------------------------------------------------------------


@query("""SELECT n.n_name, r.r_name, count(*) AS edges FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2""")
def edges_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Order → customer edges resolved late, then golden edges between the nations and regions the ends belong to."""
    cust = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = lambda v: F.lit(v)
    edges = t(spark, sf, "orders").select(x("t").alias("tenant_id"), x("placed_by").alias("relationship_type"), x("order").alias("from_entity_type"), F.col("o_orderkey").cast("string").alias("from_source_id"), x("s").alias("from_integration"), x("customer").alias("to_entity_type"), F.col("o_custkey").cast("string").alias("to_source_id"), x("s").alias("to_integration"))
    people = cust.select(x("t").alias("tenant_id"), x("customer").alias("entity_type"), F.col("c_custkey").cast("string").alias("source_id"), x("s").alias("integration"), F.concat(F.lit("c"), "c_custkey").alias("entity_id"), "n_name", "r_name")
    bought = t(spark, sf, "orders").select(x("t").alias("tenant_id"), x("order").alias("entity_type"), F.col("o_orderkey").cast("string").alias("source_id"), x("s").alias("integration"), F.concat(F.lit("o"), "o_orderkey").alias("entity_id"))
    entities = people.drop("n_name", "r_name").unionByName(bought)
    done = relations.resolve_ends(relations.stage(edges), entities).where("from_entity_id is not null and to_entity_id is not null")
    return done.join(people.select(F.col("entity_id").alias("to_entity_id"), "n_name", "r_name"), "to_entity_id").groupBy("n_name", "r_name").agg(F.count("*").alias("edges"))


@query("""SELECT o_custkey % 50 AS cluster_id, count(DISTINCT o_orderkey % 20) AS n_edges, count(*) AS sources FROM orders GROUP BY 1""")
def golden_edges(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders")
    resolved = o.select(F.lit("r").alias("relationship_type"), F.concat(F.lit("c"), "o_custkey", F.lit("-"), "o_orderkey").alias("from_entity_id"), F.concat(F.lit("o"), "o_orderkey").alias("to_entity_id"))
    member = o.select(F.concat(F.lit("c"), "o_custkey", F.lit("-"), "o_orderkey").alias("entity_id"), (F.col("o_custkey") % 50).alias("cluster_id")).unionByName(o.select(F.concat(F.lit("o"), "o_orderkey").alias("entity_id"), (1000 + F.col("o_orderkey") % 20).alias("cluster_id")))
    out = relations.golden_edges(resolved, member)
    return out.groupBy(F.col("from_id").alias("cluster_id")).agg(F.count("*").alias("n_edges"), F.sum("source_count").alias("sources"))


@query("""SELECT 'k' || n AS criteria_id, CAST(c_custkey AS VARCHAR) AS to_entity_id FROM customer, (VALUES (0), (1)) v(n) WHERE (n = 0 AND c_mktsegment = 'BUILDING' AND c_acctbal > 5000) OR (n = 1 AND c_nationkey IN (3, 5))""")
def criteria_edges(spark: SparkSession, sf: str) -> DataFrame:
    ent = t(spark, sf, "customer").select(F.lit("t").alias("tenant_id"), F.lit("customer").alias("entity_type"), F.lit("crm").alias("integration"), F.col("c_custkey").cast("string").alias("entity_id"), F.to_json(F.struct("c_mktsegment", "c_acctbal", "c_nationkey")).alias("data"))
    rules = [
        {"id": "k0", "tenant_id": "t", "relationship_type": "watches", "from_entity_id": "w0", "to_entity_type": "customer", "to_integration": "crm", "criteria": {"c_mktsegment": "BUILDING", "c_acctbal": {"$gt": 5000}}},
        {"id": "k1", "tenant_id": "t", "relationship_type": "watches", "from_entity_id": "w1", "to_entity_type": "customer", "criteria": {"c_nationkey": {"$in": [3, 5]}}},
    ]
    return relations.criteria_edges(rules, ent).select("criteria_id", "to_entity_id")


NOW = "1998-01-01"


def _stageable(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster_id"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("run"), (F.col("o_orderkey") % 3).cast("string"))).alias("execution_id"), F.col("o_orderstatus").alias("integration"))


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 1""")
def delete_execution(spark: SparkSession, sf: str) -> DataFrame:
    return deletion.not_seen(_stageable(spark, sf), "run1").select("id")


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 900 DAY AND o_orderstatus = 'F' OR o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 2000 DAY""")
def delete_composite(spark: SparkSession, sf: str) -> DataFrame:
    s = {"strategy_type": "composite", "config": {"operator": "OR", "strategies": [{"strategy_type": "staleness", "config": {"max_age_days": 900, "integration": "F"}}, {"strategy_type": "retention", "config": {"max_age_days": 2000}}]}}
    return _stageable(spark, sf).where(deletion.policy_predicate(s, F.lit(NOW).cast("timestamp"))).select("id")


@query("""WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01'), kept AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone)),
e AS (SELECT DISTINCT o_custkey AS f, (o_custkey * 7) % 100 AS t FROM orders)
SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone)) AS members, (SELECT count(*) FROM kept) AS golden, (SELECT count(*) FROM e WHERE f IN (SELECT c FROM kept) AND t IN (SELECT c FROM kept)) AS edges""")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    rec = _stageable(spark, sf)
    golden = rec.groupBy("cluster_id").agg(F.count("*").alias("source_count"))
    edges = rec.select(F.col("cluster_id").alias("from_id"), (F.col("cluster_id") * 7 % 100).alias("to_id")).distinct()
    members, gold, left = deletion.cascade(rec, golden, edges, rec.where("updated_at < timestamp '1996-06-01'"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(members, "members").crossJoin(n(gold, "golden")).crossJoin(n(left, "edges"))


@query("""SELECT o_orderstatus AS integration, CASE o_orderstatus WHEN 'F' THEN 'p2' ELSE 'p1' END AS policy_id FROM orders GROUP BY 1""")
def deletion_precedence(spark: SparkSession, sf: str) -> DataFrame:
    scopes = t(spark, sf, "orders").select(F.lit("t").alias("tenant_id"), F.lit("order").alias("entity_type"), F.col("o_orderstatus").alias("integration"), F.lit("k").alias("source_key")).distinct()
    rows = [("p1", None, None, 1, True), ("p2", "F", None, 0, True), ("p3", "F", "k", 9, False), ("p4", None, None, 0, True)]
    policies = spark.createDataFrame([(i, "t", "order", a, b, p, e, "staleness", "{}", "2020-01-01") for i, a, b, p, e in rows], "id string, tenant_id string, entity_type string, integration string, source_key string, priority int, enabled boolean, strategy_type string, config string, created_at string")
    return deletion.applicable(policies, scopes).select("integration", "policy_id")


def _nation_graph(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("in").alias("type"))
    c = t(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("lives").alias("type"))
    return n.unionByName(c)


@query("""SELECT 'r1' AS start, 'n' || n_nationkey AS node FROM nation WHERE n_regionkey = 1 UNION SELECT 'r1', 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""")
def neighbours_2hop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(_nation_graph(spark, sf), spark.createDataFrame([("r1",)], "id string"), 2)


@query("""WITH a AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey), f AS (SELECT * FROM a WHERE c_custkey = 1)
SELECT 'c1' AS src, 'c' || a.c_custkey AS dst, CASE WHEN a.c_nationkey = f.c_nationkey THEN 2 ELSE 4 END AS hops FROM a, f WHERE a.c_custkey <> 1 AND a.n_regionkey = f.n_regionkey""")
def shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    pairs = t(spark, sf, "customer").where("c_custkey <> 1").select(F.lit("c1").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    return graph.shortest_paths(_nation_graph(spark, sf), pairs, 6).select("src", "dst", "hops")


@query("""SELECT 'n3' AS id, 'out' AS direction, 'in' AS type, 'r' || n_regionkey AS other FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'n3', 'in', 'lives', 'c' || c_custkey FROM customer WHERE c_nationkey = 3""")
def relationships_of_node(spark: SparkSession, sf: str) -> DataFrame:
    return graph.relationships_of(_nation_graph(spark, sf), spark.createDataFrame([("n3",)], "id string"))


# -- scheduling, streaming, extraction ----------------------------------------------------------------------------------


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1), m AS (SELECT max(ts) AS mx FROM events)
SELECT 'p' || u.user_id AS plan_key, s.last AS last_execution_at FROM u LEFT JOIN s USING (user_id), m WHERE s.last IS NULL OR s.last + INTERVAL 1 HOUR <= m.mx""")
def due_plans(spark: SparkSession, sf: str) -> DataFrame:
    ev = t(spark, sf, "events")
    users = ev.select("user_id").distinct()
    plans = users.select(F.lit("t").alias("tenant_id"), F.concat(F.lit("p"), "user_id").alias("plan_key"), F.lit("i").alias("integration_id"), F.lit(True).alias("enabled"), F.lit(3600).alias("wait_seconds"))
    configs = spark.createDataFrame([("t", "c", "i", True), ("t", "d", "i", False)], "tenant_id string, config_id string, integration_id string, enabled boolean")
    integrations = spark.createDataFrame([("t", "i", "crm")], "tenant_id string, integration_id string, name string")
    stats = ev.where("event_type = 'purchase'").groupBy(F.concat(F.lit("p"), "user_id").alias("plan_key")).agg(F.max(F.col("ts").cast("timestamp")).alias("last_execution_at")).select(F.lit("t").alias("tenant_id"), "plan_key", F.lit("c").alias("config_id"), "last_execution_at")
    now = ev.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return scheduling.due_plans(plans, configs, integrations, stats, F.lit(now)).select("plan_key", F.col("last_execution_at").cast("timestamp_ntz").alias("last_execution_at"))


@query("""SELECT event_type AS plan_key, count(*) AS total_executions, count(*) FILTER (WHERE value > 5) AS total_successes, count(*) FILTER (WHERE NOT value > 5) AS total_failures, round(avg(value), 6) AS average_execution_ms, max(ts) AS last_execution_at FROM events GROUP BY 1""")
def plan_stats(spark: SparkSession, sf: str) -> DataFrame:
    runs = t(spark, sf, "events").select(F.lit("t").alias("tenant_id"), F.col("event_type").alias("plan_key"), F.lit("c").alias("config_id"), F.when(F.col("value") > 5, "completed").otherwise("failed").alias("status"), F.col("value").alias("duration_ms"), F.lit(1).alias("api_calls"), F.col("ts").alias("started_at"))
    return scheduling.plan_statistics(runs).select("plan_key", "total_executions", "total_successes", "total_failures", F.round("average_execution_ms", 6).alias("average_execution_ms"), "last_execution_at")


@query("""SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def rate_limit_window(spark: SparkSession, sf: str) -> DataFrame:
    ev = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return scheduling.rate_limited(ev, ["event_type"], 20, 600).select("event_id", "in_window")


@query("""SELECT user_id, count(*) AS n_changes, last(event_type ORDER BY ts, event_id) AS event_type FROM events GROUP BY user_id""")
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of six files, one a micro-batch, not in the order of their times; compacted half-way."""
    base = f"{shared_dir(spark)}/weftline-stream-{uuid.uuid4().hex}"
    source = t(spark, sf, "events").select("user_id", "ts", "event_id", F.to_json(F.struct("event_type")).alias("data"))
    key, order = ["user_id"], ["ts", "event_id"]
    for n in (2, 1):
        source.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == n - 1).repartition(3).write.mode("append").parquet(f"{base}/in")
        stream = file_stream(spark, f"{base}/in", source.schema, files_per_trigger=1)
        streaming.start_upserts(stream, f"{base}/out", f"{base}/state", key, order, available_now=True).awaitTermination()
        if n == 2:
            streaming.compact_upserts(spark, f"{base}/out", key)
    return streaming.upserted(spark, f"{base}/out", key, order).select("user_id", "n_changes", F.get_json_object("data", "$.event_type").alias("event_type"))


@query("""SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation""")
def extract_plans(spark: SparkSession, sf: str) -> DataFrame:
    """The nations as the paged APIs of four tenants: a plan pages through each one's recorded responses, which the task that runs it
    reads from the shared folder, and the pages are exploded."""
    base, keys, page = f"{shared_dir(spark)}/weftline-pages-{uuid.uuid4().hex}", 4, 5
    rows = t(spark, sf, "nation").withColumns({"config_id": F.format_string("c%d", F.expr(f"n_nationkey % {keys}")), "page": F.expr(f"n_nationkey div {keys * page}")})
    pages = rows.groupBy("config_id", "page").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("items"))
    # The first page has no number in its URL; each names the one after it.
    following = Window.partitionBy("config_id").orderBy("page")
    pages = pages.withColumns({"next": F.lead("page").over(following), "first": F.row_number().over(following) == 1})
    url = F.concat(F.lit("http://api/"), "config_id", F.lit("/nations"), F.when(F.col("first"), "").otherwise(F.concat(F.lit("?page="), "page")))
    pages.select("config_id", url.alias("url"), F.to_json(F.struct("items", "next"), {"ignoreNullFields": "false"}).alias("body")).write.parquet(base)
    plan = {"key": "nations", "step": {"url": "{{ config.base }}/nations", "params": {"page": "{{ prev.next }}"}, "while": "response.next", "set_context": {"last": "response.items[-1].n_name"}}}
    configs = [{"id": f"c{n}", "base": f"http://api/c{n}"} for n in range(keys)]
    datasource.register(spark)
    got = spark.read.format("plan_responses").options(plans=json.dumps([plan]), configs=json.dumps(configs), recorded_path=base).load()
    items = got.where("error is null").select(F.explode(F.from_json(F.get_json_object("response_body", "$.items"), "array<struct<n_nationkey:int,n_name:string,n_regionkey:int>>")).alias("n"))
    return items.select(F.col("n.n_nationkey").alias("id"), F.col("n.n_name").alias("name"), F.col("n.n_regionkey").alias("region"))


# -- reads, lists, events -----------------------------------------------------------------------------------------------


JSON_MAPPING = {
    "source_fields": [{"id": "k", "path": "order.key", "type": "number"}, {"id": "p", "path": "Order.Priority", "type": "string"}, {"id": "ps", "path": "order.parts", "type": "array", "items": {"id": "p1", "type": "number"}}],
    "target_fields": [{"id": "tk", "path": "key", "type": "number"}, {"id": "tp", "path": "priority", "type": "string"}, {"id": "tn", "path": "n_parts", "type": "number"}, {"id": "tm", "path": "total", "type": "number"}],
    "steps": [{"id": "len", "type": "transformer", "action": {"key": "array_length"}}, {"id": "sum", "type": "transformer", "action": {"key": "number_add"}}, {"id": "rank", "type": "transformer", "action": {"key": "text_substring", "arguments": {"start": 2}}}],
    "links": [
        {"source": {"field_id": "k"}, "target": {"field_id": "tk"}}, {"source": {"field_id": "p"}, "target": {"step_id": "rank"}}, {"source": {"step_id": "rank"}, "target": {"field_id": "tp"}},
        {"source": {"field_id": "ps"}, "target": {"step_id": "len"}}, {"source": {"step_id": "len"}, "target": {"field_id": "tn"}}, {"source": {"field_id": "p1"}, "target": {"step_id": "sum"}}, {"source": {"step_id": "sum"}, "target": {"field_id": "tm"}},
    ],
}


@query("""SELECT CAST(o_orderkey AS DOUBLE) AS key, substr(o_orderpriority, 3) AS priority, CAST(3 AS DOUBLE) AS n_parts, CAST(3 * o_orderkey + 3 AS DOUBLE) AS total FROM orders""")
def map_json_body(spark: SparkSession, sf: str) -> DataFrame:
    """A mapping over JSON text, with case-insensitive paths, array length and array fan-in."""
    body = F.to_json(F.struct(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"), F.array("o_orderkey", F.col("o_orderkey") + 1, F.col("o_orderkey") + 2).alias("parts")).alias("order")))
    return apply_mapping(t(spark, sf, "orders").select(body.alias("body")), JSON_MAPPING, "body").select("data.key", "data.priority", "data.n_parts", "data.total")


@query("""SELECT o_orderkey AS id FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10""")
def record_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rec = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"), F.to_json(F.struct(F.col("o_custkey").alias("source_id"))).alias("data"))
    return api.find_records(rec, "source_id", "7").select("id")


@query("""SELECT o_custkey AS cluster_id, min(o_orderdate) AS created_at FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'P') > 0""")
def cluster_memberships(spark: SparkSession, sf: str) -> DataFrame:
    members = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster_id"), "o_orderdate", "o_orderstatus")
    golden = members.groupBy("cluster_id").agg(F.min("o_orderdate").alias("created_at"))
    return api.memberships(members, golden, members.where("o_orderstatus = 'P'").select("id"))


@query("""SELECT l_orderkey AS o, first(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS first_part, last(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS last_part, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS parts,
coalesce(first(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) FILTER (WHERE l_linenumber = 2), -1) AS second FROM lineitem GROUP BY 1""")
def extract_arrays(spark: SparkSession, sf: str) -> DataFrame:
    lines = _orders_with_lines(spark, sf)
    parts = F.transform("lines", lambda x: x["l_partkey"])
    a = record_array
    return lines.select(F.col("o_orderkey").alias("o"), a(parts, "first").alias("first_part"), a(parts, "last").alias("last_part"), a(parts, "join").alias("parts"), F.coalesce(a(F.col("lines"), "filter", "l_linenumber", "2")["l_partkey"], F.lit(-1)).alias("second"))


@query("""SELECT p_partkey AS id, 'name' AS field, 'exact' AS match_type, 'lowercase' AS normalizer, lower(p_name) AS value FROM part UNION ALL SELECT p_partkey, 'size', 'numeric', '', CAST(CAST(p_size AS DOUBLE) AS VARCHAR) FROM part""")
def match_index_tall(spark: SparkSession, sf: str) -> DataFrame:
    rule = matching.Rule("r", (matching.Condition("name", normalizer="lowercase"), matching.Condition("size", "numeric")))
    return matching.tall_index(matching.build_index(_people(spark, sf), [rule]))


@query("""WITH p AS (SELECT a.p_partkey AS entity_a, b.p_partkey AS entity_b, (1 + greatest(0, 1 - abs(a.p_size - b.p_size) / 5.0) * 3) / 4.0 AS score FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_partkey < b.p_partkey)
SELECT entity_a, entity_b, round(score, 9) AS score, CASE WHEN score >= 0.95 THEN 'auto_merged' ELSE 'pending' END AS status FROM p WHERE score >= 0.5""")
def match_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Exact blocking with a numeric proximity condition, as a candidate table with statuses."""
    brand, name = matching.Condition("brand", weight=0.5, required=True), matching.Condition("name", weight=0.5, required=True)
    rule = matching.Rule("r", (brand, name, matching.Condition("size", "numeric", 3.0, threshold=5.0)))
    index = matching.build_index(_people(spark, sf), [rule])
    return matching.candidate_table(matching.matched_pairs(index, [rule], digits=9), once=True)


@query("""WITH b AS (SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), a AS (SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1993-01-01' GROUP BY 1)
SELECT coalesce(a.c, b.c) AS cluster_id, CASE WHEN b.c IS NULL THEN 'entity.created' WHEN a.c IS NULL THEN 'entity.deleted' ELSE 'entity.updated' END AS event_type FROM a FULL JOIN b ON a.c = b.c WHERE a.n IS DISTINCT FROM b.n""")
def golden_events(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders")
    state = lambda df: df.groupBy(F.col("o_custkey").alias("cluster_id")).agg(F.sha2(F.count("*").cast("string"), 256).alias("fingerprint"))
    return merging.golden_events(state(o.where("o_orderdate < timestamp_ntz '1997-01-01'")), state(o.where("o_orderdate >= timestamp_ntz '1993-01-01'")))


@query("""SELECT o_orderkey, (SELECT count(*) FROM orders) AS total_count FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""")
def list_page(spark: SparkSession, sf: str) -> DataFrame:
    return scheduling.page(t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 3).select("o_orderkey", "total_count")


@query("""SELECT count(*) AS pending FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")
def edges_pending(spark: SparkSession, sf: str) -> DataFrame:
    x = F.lit
    o = t(spark, sf, "orders")
    edges = o.select(x("t").alias("tenant_id"), x("r").alias("relationship_type"), x("o").alias("from_entity_type"), F.col("o_orderkey").cast("string").alias("from_source_id"), x("s").alias("from_integration"), x("c").alias("to_entity_type"), F.col("o_custkey").cast("string").alias("to_source_id"), x("s").alias("to_integration"))
    ent = lambda kind, col, df: df.select(x("t").alias("tenant_id"), x(kind).alias("entity_type"), F.col(col).cast("string").alias("source_id"), x("s").alias("integration"), F.col(col).cast("string").alias("entity_id")).distinct()
    found = relations.resolve_ends(edges, ent("o", "o_orderkey", o).unionByName(ent("c", "c_custkey", t(spark, sf, "customer").where("c_acctbal >= 0"))))
    return relations.pending(found).agg(F.count("*").alias("pending"))


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000)""")
def delete_messages(spark: SparkSession, sf: str) -> DataFrame:
    rec = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice")
    msg = rec.where("o_totalprice > 100000").select("id", F.when(F.col("o_orderstatus") == "F", "delete").otherwise("upsert").alias("action"))
    return deletion.apply_deletes(rec, msg, ["id"]).select("id")


@query("""SELECT user_id AS id, last(event_type ORDER BY event_id) AS p FROM events GROUP BY 1 HAVING last(event_type ORDER BY event_id) <> 'error'""")
def graph_upsert(spark: SparkSession, sf: str) -> DataFrame:
    ev = t(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ts"), F.col("event_type").alias("p"), (F.col("event_type") == "error").alias("deleted"), "value")
    return graph.merge_nodes(ev.where("value < 10").drop("value"), ev.where("value >= 10").drop("value")).select("id", "p")


@query("""SELECT user_id AS id, last(event_type ORDER BY event_id) AS p FROM events GROUP BY 1 HAVING last(event_type ORDER BY event_id) <> 'error'""")
def stream_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of nodes as a stream of three files, one a micro-batch, not in their order; errors delete their node."""
    base = f"{shared_dir(spark)}/weftline-stream-{uuid.uuid4().hex}"
    source = t(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ts"), F.col("event_type").alias("p"), (F.col("event_type") == "error").alias("deleted"))
    source.repartition(3, "ts").write.parquet(f"{base}/in")
    stream = file_stream(spark, f"{base}/in", source.schema, files_per_trigger=1)
    streaming.start_graph(stream, f"{base}/out", f"{base}/state", ["id"], ["ts"], available_now=True).awaitTermination()
    return streaming.graph_rows(spark, f"{base}/out", ["id"], ["ts"]).select("id", "p")


@query(_BIND_SQL + "SELECT message_id, binding_id, score FROM r WHERE message_id % 2 = 0 OR binding_id <> 'b1'")
def stream_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of even ids come first; then binding b1 is disabled, which the batches after that see."""
    base = f"{shared_dir(spark)}/weftline-stream-{uuid.uuid4().hex}"
    source, bindings = _messages(spark, sf), _bindings(spark)
    for n in (0, 1):
        source.where(F.col("message_id") % 2 == n).repartition(2).write.parquet(f"{base}/in/part={n}")
        bindings.withColumn("is_enabled", F.col("is_enabled") & (F.lit(n == 0) | (F.col("id") != "b1"))).write.mode("overwrite").parquet(f"{base}/bindings")
        stream = file_stream(spark, f"{base}/in/part=*", source.schema, files_per_trigger=1)
        run = streaming.route_batches(lambda: spark.read.parquet(f"{base}/bindings"), f"{base}/out")
        stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("message_id", "binding_id", "score")


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey IN (3, 4) THEN 'load_mapping' WHEN c_acctbal < 0 THEN 'execute_mapping' WHEN c_mktsegment = 'BUILDING' THEN 'output_topic_missing' END AS error_stage FROM customer)
SELECT error_stage, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE c_custkey % 3 < 2) AS BIGINT) AS again FROM c WHERE error_stage IS NOT NULL GROUP BY 1""")
def dead_letter_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Dead letters of three stages, and how many of them are sent again: those that failed less than three times."""
    rows = t(spark, sf, "customer").withColumn("attempts", (F.col("c_custkey") % 3 + 1).cast("int"))
    missing = F.when(F.col("c_nationkey").isin(3, 4), "no mapping")
    dead = routing.dead_letters(rows, {"load_mapping": missing, "execute_mapping": F.when(F.col("c_acctbal") < 0, "negative"), "output_topic_missing": F.when(F.col("c_mktsegment") == "BUILDING", "no topic")})[1]
    again = routing.replay_dead_letters(dead)[0].select("c_custkey", F.lit(1).alias("x"))
    return dead.join(again, "c_custkey", "left").groupBy("error_stage").agg(F.count("*").alias("n"), F.count("x").alias("again"))


@query("""SELECT event_id, CAST(least(power(2, event_id % 8), 60) AS DOUBLE) AS exponential, CAST(least(event_id % 8 + 1, 60) AS DOUBLE) AS linear, CAST([1, 1, 2, 3, 5, 8, 13, 21][CAST(event_id % 8 + 1 AS INTEGER)] AS DOUBLE) AS fibonacci FROM events""")
def backoff_delays(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 8 + 1
    return t(spark, sf, "events").select("event_id", *[scheduling.backoff_seconds(k, kind).alias(kind) for kind in ("exponential", "linear", "fibonacci")])


@query("""SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Event-time windows over the events as a file stream, complete when the input is read."""
    base = f"{shared_dir(spark)}/weftline-windows-{uuid.uuid4().hex}"
    source = t(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    source.write.parquet(f"{base}/in")
    counts = streaming.windowed_counts(file_stream(spark, f"{base}/in", source.schema), "ts", ["event_type"])
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out")
    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT 'p' || p_partkey % 7 AS id, max(p_partkey) AS version FROM part WHERE p_size > 10 GROUP BY 1""")
def mapping_versions(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "part").select(F.lit("t").alias("tenant_id"), F.concat(F.lit("p"), (F.col("p_partkey") % 7).cast("string")).alias("id"), F.col("p_partkey").alias("version"), (F.col("p_size") > 10).alias("is_active"), F.lit(None).cast("string").alias("deleted_at"))
    return latest_definitions(rows).select("id", "version")


@query("""SELECT count(*) AS processed, count(*) FILTER (WHERE c_acctbal >= 0) AS mapped, count(*) FILTER (WHERE c_acctbal < 0) AS failed FROM customer""")
def mapping_counters(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "customer").select(F.when(F.col("c_acctbal") < 0, "bad").alias("error"))
    seen = Observation("counters")
    counted = rows.observe(seen, F.count(F.lit(1)).alias("processed"), F.count_if(F.col("error").isNull()).alias("mapped"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    counted.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[k] for k in ("processed", "mapped", "failed"))], "processed long, mapped long, failed long")


# -- consolidation, stored criteria, lifecycle, reviews ------------------------------------------------------------------


def _consolidated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Golden records of single customers that grow together by the remainder of their number; every ninth order is new."""
    o = t(spark, sf, "orders").where("o_custkey is not null")
    members = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("golden_id"), (F.col("o_custkey") % 40).alias("cluster_id"))
    golden = o.groupBy(F.col("o_custkey").alias("golden_id")).agg(F.min("o_orderdate").alias("created_at"), F.count("*").alias("version"))
    edges = o.select(F.lit("r").alias("type"), F.col("o_custkey").alias("from_id"), (F.col("o_custkey") * 7 % 100).alias("to_id")).distinct()
    return merging.consolidate(members, golden, edges)


_CONSOLIDATED_SQL = """WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS golden_id, o_custkey % 40 AS cluster_id FROM orders WHERE o_custkey IS NOT NULL),
g AS (SELECT o_custkey AS golden_id, min(o_orderdate) AS created_at, count(*) AS version FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1),
h AS (SELECT DISTINCT cluster_id, golden_id FROM m WHERE golden_id IS NOT NULL), s AS (SELECT cluster_id, first(golden_id ORDER BY created_at, golden_id) AS survivor FROM h JOIN g USING (golden_id) GROUP BY 1),
x AS (SELECT h.golden_id, s.survivor FROM h JOIN s USING (cluster_id)), grown AS (SELECT DISTINCT survivor FROM m JOIN s USING (cluster_id) WHERE golden_id IS NULL OR golden_id <> survivor),
gone AS (SELECT golden_id, survivor AS merged_into FROM x WHERE golden_id <> survivor)
"""


@query(_CONSOLIDATED_SQL + """SELECT golden_id, version + CASE WHEN golden_id IN (SELECT survivor FROM grown) THEN 1 ELSE 0 END AS version, CAST(merged_into AS VARCHAR) AS merged_into FROM g LEFT JOIN gone USING (golden_id)""")
def golden_consolidated(spark: SparkSession, sf: str) -> DataFrame:
    """The oldest golden record of a cluster stays, with its version raised; the others say what they went into."""
    return _consolidated(spark, sf)[1].select("golden_id", "version", F.col("merged_into").cast("string").alias("merged_into"))


@query(_CONSOLIDATED_SQL + """, e AS (SELECT DISTINCT o_custkey AS f, o_custkey * 7 % 100 AS t FROM orders WHERE o_custkey IS NOT NULL),
r AS (SELECT e.f = e.t AS loop, coalesce(a.merged_into, e.f) AS from_id, coalesce(b.merged_into, e.t) AS to_id FROM e LEFT JOIN gone a ON a.golden_id = e.f LEFT JOIN gone b ON b.golden_id = e.t)
SELECT DISTINCT from_id, to_id FROM r WHERE loop OR from_id <> to_id""")
def edges_rewired(spark: SparkSession, sf: str) -> DataFrame:
    """Edges follow the golden records that were merged."""
    return _consolidated(spark, sf)[2].select("from_id", "to_id")


@query(_CONSOLIDATED_SQL + """SELECT id, coalesce(survivor, cluster_id) AS golden_id FROM m LEFT JOIN s USING (cluster_id)""")
def members_consolidated(spark: SparkSession, sf: str) -> DataFrame:
    return _consolidated(spark, sf)[0].select("id", "golden_id")


@query("""WITH b AS (SELECT o_custkey AS id, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), a AS (SELECT o_custkey AS id, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1993-01-01' GROUP BY 1),
j AS (SELECT coalesce(a.id, b.id) AS id, a.id AS ai, b.id AS bi, a.n AS an, b.n AS bn, a.s AS sa, b.s AS sb FROM a FULL JOIN b ON a.id = b.id)
SELECT id, 'created' AS action, NULL AS field, NULL AS old_value, NULL AS new_value FROM j WHERE bi IS NULL UNION ALL SELECT id, 'deleted', NULL, NULL, NULL FROM j WHERE ai IS NULL
UNION ALL SELECT id, 'updated', 'n', CAST(bn AS VARCHAR), CAST(an AS VARCHAR) FROM j WHERE ai IS NOT NULL AND bi IS NOT NULL AND an <> bn UNION ALL SELECT id, 'updated', 's', sb, sa FROM j WHERE ai IS NOT NULL AND bi IS NOT NULL AND sa IS DISTINCT FROM sb""")
def audit_entries(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").where("o_custkey is not null")
    state = lambda df: df.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.max("o_orderstatus").alias("s"))
    return merging.audit_log(state(o.where("o_orderdate < timestamp_ntz '1997-01-01'")), state(o.where("o_orderdate >= timestamp_ntz '1993-01-01'")), "id", ["n", "s"])


@query("""SELECT k.id AS criteria_id, CAST(c_custkey AS VARCHAR) AS to_entity_id FROM customer, (VALUES ('k0'), ('k1'), ('k2'), ('k3'), ('k4'), ('k5')) k(id) WHERE (id = 'k0' AND c_mktsegment = 'BUILDING' AND c_acctbal > 5000)
OR (id = 'k1' AND c_nationkey IN (3, 5) AND c_acctbal <= 1000) OR (id = 'k2' AND c_acctbal < -900) OR (id = 'k3' AND contains(c_mktsegment, 'HOUSE') AND c_acctbal >= 9000) OR (id = 'k4' AND c_nationkey <> 7 AND c_nationkey = 8)
OR (id = 'k5' AND c_custkey % 2 = 0 AND c_nationkey = 4)""")
def criteria_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Criteria from a table; a key that's missing for odd customers, and a rule of another integration that meets nobody."""
    body = F.to_json(F.struct("c_mktsegment", "c_acctbal", "c_nationkey", F.struct(F.when(F.col("c_custkey") % 2 == 0, 1).alias("even")).alias("x")))
    ent = t(spark, sf, "customer").select(F.lit("t").alias("tenant_id"), F.lit("customer").alias("entity_type"), F.lit("crm").alias("integration"), F.col("c_custkey").cast("string").alias("entity_id"), body.alias("data"))
    wanted = [
        ("crm", {"c_mktsegment": "BUILDING", "c_acctbal": {"$gt": 5000}}), (None, {"c_nationkey": {"$in": [3, 5]}, "c_acctbal": {"$lte": 1000}}), (None, {"c_acctbal": {"$lt": -900}}),
        (None, {"c_mktsegment": {"$contains": "HOUSE"}, "c_acctbal": {"$gte": 9000}}), (None, {"c_nationkey": {"$ne": 7, "$eq": 8}}), (None, {"x.even": {"$exists": True}, "c_nationkey": 4}), ("erp", {"c_nationkey": 4}),
    ]
    rows = [(f"k{n}", "t", "watches", f"w{n}", "customer", i, json.dumps(c)) for n, (i, c) in enumerate(wanted)]
    rules = spark.createDataFrame(rows, "criteria_id string, tenant_id string, relationship_type string, from_entity_id string, to_entity_type string, to_integration string, criteria string")
    return relations.stored_criteria_edges(rules, ent).select("criteria_id", "to_entity_id")


@query("""WITH e AS (SELECT DISTINCT o_custkey AS f, o_orderstatus AS s FROM orders) SELECT 'one_to_one' AS relationship_type, 'from' AS side, CAST(f AS VARCHAR) AS entity_id, count(*) AS n FROM e GROUP BY f HAVING count(*) > 1
UNION ALL SELECT 'one_to_one', 'to', s, count(*) FROM e GROUP BY s HAVING count(*) > 1 UNION ALL SELECT 'many_to_one', 'from', CAST(f AS VARCHAR), count(*) FROM e GROUP BY f HAVING count(*) > 1 UNION ALL SELECT 'one_to_many', 'to', s, count(*) FROM e GROUP BY s HAVING count(*) > 1""")
def edge_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    kinds = spark.createDataFrame([(k, k) for k in relations.CARDINALITY], "relationship_type string, cardinality string")
    edges = t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("from_id"), F.col("o_orderstatus").alias("to_id")).distinct()
    edges = edges.withColumn("relationship_type", F.explode(F.array(*[F.lit(k) for k in relations.CARDINALITY])))
    return relations.cardinality_violations(edges, kinds)


@query("""WITH d AS (SELECT event_type, max(ts) AS at, max_by(user_id % 5, (ts, user_id % 5)) AS run FROM events WHERE value > 5 GROUP BY 1)
SELECT e.event_id FROM events e JOIN d USING (event_type) WHERE e.user_id % 5 <> d.run AND e.ts <= d.at""")
def delete_completed(spark: SparkSession, sf: str) -> DataFrame:
    """Events as records and, where their value is large, as the completion of a run: what the last one of a type didn't send goes."""
    ev = t(spark, sf, "events").select("event_id", "event_type", F.concat(F.lit("run"), (F.col("user_id") % 5).cast("string")).alias("execution_id"), F.col("ts").alias("updated_at"), "ts", F.when(F.col("value") > 5, "execution.completed").otherwise("execution.failed").alias("type"))
    runs = deletion.completed_runs(ev, ["event_type"])
    return deletion.unseen_by_last_run(ev, runs, ["event_type"]).select("event_id")


@query("""SELECT CASE WHEN event_type IN ('click', 'view') THEN 'lifecycle' ELSE 'message' END AS kind, count(*) AS n FROM events GROUP BY 1""")
def lifecycle_split(spark: SparkSession, sf: str) -> DataFrame:
    ev = t(spark, sf, "events").select("event_id", F.when(F.col("event_type").isin("click", "view"), "execution.completed").otherwise(F.col("event_type")).alias("type"))
    parts = [part.select(F.lit(kind).alias("kind")) for kind, part in zip(("lifecycle", "message"), routing.split_lifecycle(ev), strict=True)]
    return parts[0].unionByName(parts[1]).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN 'has' ELSE 'holds' END AS relationship_type, CAST(l_orderkey AS VARCHAR) AS from_id, CAST(l_partkey AS VARCHAR) AS to_id, 'shop' AS from_integration,
CAST(l_quantity AS VARCHAR) AS qty, l_linenumber <> 3 AS valid FROM lineitem""")
def parse_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Standalone relationship messages; a third line lacks its entity type and isn't valid."""
    lit = F.lit
    even = F.when(F.col("l_linenumber") % 2 == 0, "has")
    data = F.create_map(lit("_relationship_type"), even, lit("_from_entity_type"), F.when(F.col("l_linenumber") != 3, "order"), lit("_from_source_id"), F.col("l_orderkey").cast("string"), lit("_to_entity_type"), lit("part"), lit("_to_source_id"), F.col("l_partkey").cast("string"), lit("qty"), F.col("l_quantity").cast("string"))
    got = relations.parse_relationship(data, lit("holds"), lit("shop"))
    rows = t(spark, sf, "lineitem")
    return rows.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), got["relationship_type"].alias("relationship_type"), got["from_source_id"].alias("from_id"), got["to_source_id"].alias("to_id"), got["from_integration"].alias("from_integration"), got["properties"]["qty"].alias("qty"), got["valid"].alias("valid"))


@query("""SELECT o_orderkey, sha256(concat_ws('|', CAST(o_custkey AS VARCHAR), o_orderstatus, 'r')) AS id FROM orders""")
def edge_ids(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select("o_orderkey", relations.edge_id("o_custkey", "o_orderstatus", F.lit("r")).alias("id"))


@query("""SELECT o_orderstatus AS tenant_id, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 UNION ALL SELECT 'live F', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000""")
def tenant_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows left when a tenant is purged, and a tenant's rows that aren't soft-deleted."""
    o = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("tenant_id"), F.when(F.col("o_totalprice") >= 100000, F.col("o_orderdate")).alias("deleted_at"))
    left = api.purge_tenant(o, "P").groupBy("tenant_id").agg(F.count("*").alias("n"))
    return left.unionByName(api.tenant(o, "F").agg(F.count("*").alias("n")).select(F.lit("live F").alias("tenant_id"), "n"))


@query("""SELECT 'c' || c_custkey AS id, CASE WHEN c_nationkey < 10 THEN 'graph' ELSE 'store' END AS found_in FROM customer WHERE c_custkey % 3 = 0""")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes by id, from the graph or else from the record store."""
    c = t(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), "c_nationkey", "c_custkey")
    named = lambda df, name: df.select("id", F.lit(name).alias("found_in"))
    return graph.get_nodes(named(c.where("c_nationkey < 10"), "graph"), named(c, "store"), c.where("c_custkey % 3 = 0").select("id"))


@query("""SELECT o_custkey AS entity_a, o_orderkey + 1000000 AS entity_b, o_totalprice AS score FROM orders WHERE o_orderstatus = 'O' ORDER BY score DESC, entity_a, entity_b LIMIT 100""")
def review_pending(spark: SparkSession, sf: str) -> DataFrame:
    """The best hundred pending candidates (a top-k report); approved and rejected ones aren't shown."""
    o = t(spark, sf, "orders")
    table = o.select(F.col("o_custkey").alias("entity_a"), (F.col("o_orderkey") + 1000000).alias("entity_b"), F.col("o_totalprice").alias("score"), F.lit("pending").alias("status"), "o_orderstatus")
    verdict = F.when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected")
    decisions = table.where("o_orderstatus <> 'O'").select("entity_a", "entity_b", verdict.alias("decision"), F.lit(1).alias("ts"))
    return matching.review_queue(matching.decide(table.drop("o_orderstatus"), decisions)).select("entity_a", "entity_b", "score")


@query("""WITH s AS (SELECT s_suppkey AS k, lpad(CAST(s_suppkey AS VARCHAR), 9, '1') AS d FROM supplier) SELECT k, d AS ssn, CAST(k AS VARCHAR) || '-1' AS ssn_bad, substr(d, 1, 5) AS zip, CAST(k AS VARCHAR) || ' n main st ste 5' AS address FROM s""")
def normalizers_places(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    d = F.lpad(k, 9, "1")
    number = F.concat(F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 2), F.lit("-"), F.substring(d, 6, 4))
    return t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), norm.normalize(number, "ssn").alias("ssn"), norm.normalize(F.concat(k, F.lit("-1")), "ssn").alias("ssn_bad"), norm.normalize(number, "zip").alias("zip"), norm.normalize(F.concat(k, F.lit(" North  Main Street, Suite #5")), "address").alias("address"))


from weftline import catalog_state  # noqa: E402, F401  registers its queries here

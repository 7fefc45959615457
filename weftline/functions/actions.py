"""The action library: key -> Column builder, with input rules and output kind.

Every action is a composition of built-in functions and stays inside whole-stage code generation. Where inputs make an action
fail, its value is null and ``error`` says why; the mapping turns that into a dead letter. Actions follow their documented
intent; where a well-known implementation is known to differ, the docstring of the builder says so.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import dates
from weftline.functions.paths import object_json
from weftline.functions.values import ANY, BOOL, NUMBER, OBJECT, STRING, Kind, Value, array_of, as_text, is_empty, literal, number_text, spark_type, zero

MANY = 1 << 30
Rule = tuple[str, int, int]  # kind, least and most inputs of it


@dataclass(frozen=True)
class Action:
    key: str
    build: Callable[[list[Value], dict], Value]
    rules: tuple[Rule, ...]
    out: str  # a kind, "same" (as the first input), "item" (of the first input) or "array:kind"
    text: str


REGISTRY: dict[str, Action] = {}


def action(key: str, rules: list[Rule], out: str, text: str):
    def register(build: Callable[[list[Value], dict], Value]):
        REGISTRY[key] = Action(key, build, tuple(rules), out, text)
        return build

    return register


def get_action(key: str) -> Action:
    if key not in REGISTRY:
        raise KeyError(f"unknown action {key!r}")
    return REGISTRY[key]


def output_kind(key: str, inputs: list[Kind], args: dict | None = None) -> Kind:
    out = get_action(key).out
    if out == "same":
        return inputs[0] if inputs else ANY
    if out == "item":
        return (inputs[0].items or ANY) if inputs else ANY
    if out.startswith("array:"):
        return array_of(Kind(out[6:]))
    return Kind(out)


def check_inputs(key: str, inputs: list[Kind]) -> list[str]:
    """Errors if the inputs' kinds and number don't fit the rules; an input counts for the first rule that takes it."""
    rules = get_action(key).rules
    left = [most for _, _, most in rules]
    used = [0] * len(rules)
    errors = []
    for k in inputs:
        for i, (name, _, _) in enumerate(rules):
            if left[i] and Kind(name).accepts(k if name != "array" else Kind(k.name)):
                left[i] -= 1
                used[i] += 1
                break
        else:
            errors.append(f"{key}: input of type {k} isn't allowed")
    errors += [f"{key}: needs {least} input(s) of type {name}, got {n}" for (name, least, _), n in zip(rules, used, strict=True) if n < least]
    return errors


def apply_action(key: str, inputs: list[Value], args: dict | None = None) -> Value:
    """The action's value; inputs that may be absent and are count as not given."""
    got = get_action(key).build(inputs, dict(args or {}))
    errors = [v.error for v in inputs if v.error is not None] + ([got.error] if got.error is not None else [])
    return replace(got, error=F.coalesce(*errors) if errors else None)


# -- helpers -----------------------------------------------------------------------------------------------------------


def _one(v: Value, kind: Kind) -> Column:
    """A single input as its kind; a null that isn't an absence becomes the type's zero, any text is read as asked."""
    c = v.col
    if kind == NUMBER and v.kind.name in ("any", "string"):
        c = c.try_cast("double")
    elif kind == STRING and v.kind.name not in ("string", "date", "any"):
        c = as_text(v)
    elif kind == BOOL and v.kind.name in ("any", "string"):
        c = c.try_cast("boolean")
    return c if v.absent else F.coalesce(c, zero(kind))


def _list(ins: list[Value], kind: Kind) -> Column:
    """All inputs as one array, absences left out."""
    parts = []
    for v in ins:
        if v.many:
            parts.append(_each(v, kind))
        elif v.absent:
            parts.append(F.array_compact(F.array(_one(v, kind))))
        else:
            parts.append(F.array(_one(v, kind)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _each(v: Value, kind: Kind) -> Column:
    return F.transform(v.col, lambda x: _one(replace(v, col=x, many=False, absent=False), kind))


def _plain(ins: list[Value]) -> bool:
    return not any(v.many or v.absent for v in ins)


def _fold(ins: list[Value], kind: Kind, op: Callable[[Column, Column], Column], start: Column | None = None) -> Column:
    """Left fold over all inputs; plain scalars become nested expressions, others an aggregate over an array."""
    if _plain(ins):
        cols = [_one(v, kind) for v in ins]
        return reduce(op, cols if start is None else [start, *cols])
    xs = _list(ins, kind)
    if start is not None:
        return F.when(F.size(xs) > 0, F.aggregate(xs, start, op))
    return F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.get(xs, F.lit(0)), op)


def _second(ins: list[Value], kind: Kind, args: dict, *names: str, default: object = None) -> Column:
    """The second input if given, else the argument."""
    if len(ins) > 1:
        return _one(ins[1], kind)
    found = next((args[n] for n in names if args.get(n) is not None), default)
    return F.lit(None).cast(spark_type(kind)) if found is None else literal(found).col.cast(spark_type(kind))


def _failed(bad: Column, message: str) -> Column:
    return F.when(bad, F.lit(message))


def _clean(c: Column, bad: Column) -> Column:
    return F.when(~F.coalesce(bad, F.lit(False)), c)


# -- conditional -------------------------------------------------------------------------------------------------------


@action("any_coalesce", [("any", 1, MANY)], "same", "first input that is not empty, else the default")
def any_coalesce(ins: list[Value], args: dict) -> Value:
    kind = ins[0].kind
    last = literal(args["default"]).col if args.get("default") is not None else F.lit(None)
    if any(v.many for v in ins):
        xs = F.filter(_list(ins, kind), lambda x: ~is_empty(Value(x, kind)))
        return Value(F.coalesce(F.get(xs, F.lit(0)), last), kind)
    same = all(v.kind == kind for v in ins)
    cols = [v.col if same else as_text(v) for v in ins]
    kind = kind if same else STRING
    return Value(F.coalesce(*[F.when(~is_empty(v), c) for v, c in zip(ins, cols, strict=True)], last), kind, absent=True)


@action("any_default", [("any", 1, 1)], "same", "the value, or the default if it is empty")
def any_default(ins: list[Value], args: dict) -> Value:
    other = literal(args.get("default"))
    return Value(F.when(is_empty(ins[0]), other.col).otherwise(ins[0].col), ins[0].kind, struct=ins[0].struct)


@action("any_if_else", [("bool", 1, 1), ("any", 1, 1)], "any", "the second input where the first is true, else the argument else")
def any_if_else(ins: list[Value], args: dict) -> Value:
    test = next((v for v in ins if v.kind == BOOL), ins[0])
    then = next((v for v in ins if v is not test), test)
    other = literal(args.get("else"))
    kind = then.kind if args.get("else") is None or other.kind == then.kind else STRING
    pick = (lambda v: v.col) if kind == then.kind else as_text
    return Value(F.when(F.coalesce(test.col, F.lit(False)), pick(then)).otherwise(other.col if args.get("else") is None else pick(other)), kind)


@action("any_is_nil", [("any", 1, 1)], "bool", "whether the value is null")
def any_is_nil(ins: list[Value], args: dict) -> Value:
    return Value(ins[0].col.isNull(), BOOL)


@action("any_is_empty", [("any", 1, 1)], "bool", 'whether the value is null, "", [] or {}')
def any_is_empty(ins: list[Value], args: dict) -> Value:
    return Value(is_empty(ins[0]), BOOL)


@action("any_to_string", [("any", 1, 1)], "string", "text form; null is the empty string")
def any_to_string(ins: list[Value], args: dict) -> Value:
    return Value(as_text(ins[0]), STRING)


# -- arrays ------------------------------------------------------------------------------------------------------------


def _items(v: Value) -> Kind:
    return v.kind.items or ANY


def _extra(ins: list[Value], given: list | None, kind: Kind) -> Column:
    """Arguments and extra inputs as an array of the item kind."""
    parts = [literal(x).col.cast(spark_type(kind)) for x in given or []] + [v.col.cast(spark_type(kind)) for v in ins]
    return F.array(*parts) if parts else F.array().cast(T.ArrayType(spark_type(kind)))


def _array(v: Value) -> Column:
    return v.col if v.absent else F.coalesce(v.col, F.array().cast(T.ArrayType(spark_type(_items(v)))) if not isinstance(v.struct, T.ArrayType) else F.array().cast(v.struct))


@action("array_contains", [("array", 1, 1), ("any", 0, MANY)], "bool", "whether any search item is in the array")
def array_contains(ins: list[Value], args: dict) -> Value:
    return Value(F.coalesce(F.arrays_overlap(_array(ins[0]), _extra(ins[1:], args.get("searchItems"), _items(ins[0]))), F.lit(False)), BOOL)


@action("array_distinct", [("array", 1, 1)], "same", "first occurrences, in order")
def array_distinct(ins: list[Value], args: dict) -> Value:
    return Value(F.array_distinct(_array(ins[0])), ins[0].kind)


def _test(args: dict, kind: Kind, invert: bool) -> Callable[[Column], Column]:
    def test(x: Column) -> Column:
        got = F.coalesce(apply_action(args["actionKey"], [Value(x, kind)], args.get("args")).col, F.lit(False))
        return ~got if invert else got

    return test


@action("array_filter", [("array", 1, 1)], "same", "items for which a boolean action holds, or doesn't if inverted")
def array_filter(ins: list[Value], args: dict) -> Value:
    return Value(F.filter(_array(ins[0]), _test(args, _items(ins[0]), bool(args.get("invert")))), ins[0].kind)


@action("array_every", [("array", 1, 1)], "bool", "whether a boolean action holds for all items; true for none")
def array_every(ins: list[Value], args: dict) -> Value:
    return Value(F.forall(_array(ins[0]), _test(args, _items(ins[0]), bool(args.get("invert")))), BOOL)


@action("array_flatten", [("array", 1, 1)], "item", "one level less of nesting")
def array_flatten(ins: list[Value], args: dict) -> Value:
    return Value(F.flatten(ins[0].col), _items(ins[0]))


@action("array_index_of", [("array", 1, 1), ("any", 0, 1)], "number", "place of the first equal item from 0, -1 if absent")
def array_index_of(ins: list[Value], args: dict) -> Value:
    item = ins[1].col if len(ins) > 1 else literal(args.get("item")).col.cast(spark_type(_items(ins[0])))
    return Value((F.coalesce(F.array_position(_array(ins[0]), item), F.lit(0)) - 1).cast("double"), NUMBER)


@action("array_length", [("array", 1, 1)], "number", "number of items")
def array_length(ins: list[Value], args: dict) -> Value:
    return Value(F.size(_array(ins[0])).cast("double"), NUMBER)


@action("array_push", [("array", 1, 1), ("any", 0, MANY)], "same", "the array with arguments and extra inputs appended")
def array_push(ins: list[Value], args: dict) -> Value:
    return Value(F.concat(_array(ins[0]), _extra(ins[1:], args.get("items"), _items(ins[0]))), ins[0].kind)


@action("array_randomize", [("array", 1, 1)], "same", "a random order (not deterministic)")
def array_randomize(ins: list[Value], args: dict) -> Value:
    return Value(F.shuffle(_array(ins[0])), ins[0].kind)


@action("array_reverse", [("array", 1, 1)], "same", "reverse order")
def array_reverse(ins: list[Value], args: dict) -> Value:
    return Value(F.reverse(_array(ins[0])), ins[0].kind)


def _count(ins: list[Value], args: dict) -> Column:
    given = args.get("count") or 0
    n = F.lit(int(given)) if given or len(ins) < 2 else _one(ins[1], NUMBER).cast("int")
    return F.least(F.greatest(n, F.lit(0)), F.size(_array(ins[0])))


@action("array_skip", [("array", 1, 1), ("number", 0, 1)], "same", "without the first count items")
def array_skip(ins: list[Value], args: dict) -> Value:
    n = _count(ins, args)
    return Value(F.slice(_array(ins[0]), n + 1, F.size(_array(ins[0])) - n), ins[0].kind)


@action("array_take", [("array", 1, 1), ("number", 0, 1)], "same", "the first count items")
def array_take(ins: list[Value], args: dict) -> Value:
    return Value(F.slice(_array(ins[0]), 1, _count(ins, args)), ins[0].kind)


# -- dates -------------------------------------------------------------------------------------------------------------


@action("date_now", [], "string", "the current time by format (RFC 3339) and timezone (not deterministic)")
def date_now(ins: list[Value], args: dict) -> Value:
    return Value(dates.show(F.current_timestamp(), args.get("format"), args.get("timezone") or "UTC"), STRING)


def _unread(c: Column, ts: Column) -> Column:
    return F.when(c.isNotNull() & ts.isNull(), F.concat(F.lit("unable to parse date: "), c))


@action("date_parse", [("string", 1, 1)], "string", "a date by input_format or the usual layouts, shown by output_format")
def date_parse(ins: list[Value], args: dict) -> Value:
    c = _one(ins[0], STRING)
    ts = dates.parse(c, args.get("input_format"))
    return Value(dates.show(ts, args.get("output_format"), args.get("timezone"), c), STRING, error=_unread(c, ts))


@action("date_format", [("string", 1, 1)], "string", "a date in the usual layouts, shown by format")
def date_format(ins: list[Value], args: dict) -> Value:
    c = _one(ins[0], STRING)
    ts = dates.parse(c, short=True)
    return Value(dates.show(ts, args.get("format"), args.get("timezone"), c), STRING, error=_unread(c, ts))


#: Microseconds of a unit.
UNITS = {"milliseconds": 1e3, "seconds": 1e6, "minutes": 6e7, "hours": 3.6e9, "days": 8.64e10}


@action("date_diff", [("string", 2, 2)], "number", "second date minus first, in unit (seconds)")
def date_diff(ins: list[Value], args: dict) -> Value:
    a, b = _one(ins[0], STRING), _one(ins[1], STRING)
    x, y = dates.parse(a, short=True), dates.parse(b, short=True)
    return Value((F.unix_micros(y) - F.unix_micros(x)) / F.lit(UNITS.get(args.get("unit") or "", 1e6)), NUMBER, error=F.coalesce(_unread(a, x), _unread(b, y)))


@action("date_add", [("string", 1, 1)], "string", "a date plus years … seconds; days beyond a month's end roll over")
def date_add(ins: list[Value], args: dict) -> Value:
    c = _one(ins[0], STRING)
    ts = dates.parse(c, short=True)
    moved = dates.add(ts, **{k: args.get(k) or 0 for k in ("years", "months", "days", "hours", "minutes", "seconds")})
    return Value(dates.show(moved, args.get("format"), None, c), STRING, error=_unread(c, ts))


# -- numbers -----------------------------------------------------------------------------------------------------------


def _unary(key: str, text: str, op: Callable[[Column], Column], out: str = "number", bad: Callable[[Column], Column] | None = None) -> None:
    @action(key, [("number", 1, 1)], out, text)
    def build(ins: list[Value], args: dict) -> Value:
        c = _one(ins[0], NUMBER)
        kind = Kind(out)
        if bad is None:
            return Value(op(c), kind, absent=ins[0].absent)
        return Value(_clean(op(c), bad(c)), kind, absent=ins[0].absent, error=_failed(bad(c), f"{key}: no such value"))


def _whole(c: Column) -> Column:
    return c == F.floor(c)


def _gamma(c: Column) -> Column:
    """Gamma(x + 1): exact products for whole 0..20, Lanczos' series (g = 7, n = 9) elsewhere, by reflection below -0.5."""
    #: Coefficients of Lanczos' approximation.
    g = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]

    def series(x: Column) -> Column:
        total = reduce(lambda a, b: a + b, [F.lit(g[0])] + [F.lit(g[i]) / (x + i) for i in range(1, 9)])
        t = x + 7.5
        return F.lit(2.5066282746310002) * F.pow(t, x + 0.5) * F.exp(-t) * total

    exact = F.factorial(F.when(_whole(c) & (c >= 0) & (c <= 20), c).cast("int")).cast("double")
    reflected = F.pi() / (F.sin(F.pi() * (c + 1)) * series(-c - 1))
    return F.coalesce(exact, F.when(c < -0.5, reflected).otherwise(series(c)))


_unary("number_abs", "absolute value", F.abs)
_unary("number_sign", "1, -1 or 0", F.signum)
_unary("number_factorial", "Gamma(x + 1)", _gamma, bad=lambda c: F.isnan(c) | (c.isin(float("inf"), float("-inf"))) | ((c < 0) & _whole(c)))
_unary("number_ceiling", "smallest whole number not below", lambda c: F.ceil(c).cast("double"))
_unary("number_floor", "largest whole number not above", lambda c: F.floor(c).cast("double"))
_unary("number_cube_root", "cube root", F.cbrt)
_unary("number_cube", "third power", lambda c: c * c * c)
_unary("number_square", "second power", lambda c: c * c)
_unary("number_square_root", "square root; negative numbers fail", F.sqrt, bad=lambda c: c < 0)
_unary("number_to_negative", "negation", lambda c: -c)
_unary("number_to_positive", "absolute value", F.abs)
_unary("number_to_string", "shortest decimal text without exponent", number_text, "string")
_unary("number_is_even", "whole and divisible by 2", lambda c: _whole(c) & (F.pmod(c, F.lit(2.0)) == 0), "bool")
_unary("number_is_odd", "whole and not divisible by 2", lambda c: _whole(c) & (F.pmod(c, F.lit(2.0)) != 0), "bool")


@action("number_clamp", [("number", 1, 1)], "number", "bound to min … max, min first")
def number_clamp(ins: list[Value], args: dict) -> Value:
    c, lo, hi = _one(ins[0], NUMBER), float(args.get("min") or 0), float(args.get("max") or 0)
    return Value(F.when(c < lo, lo).when(c > hi, hi).otherwise(c), NUMBER)


@action("number_parse", [("string", 1, 1)], "number", "a number read from text, else default (0)")
def number_parse(ins: list[Value], args: dict) -> Value:
    return Value(F.coalesce(_one(ins[0], STRING).try_cast("double"), F.lit(float(args.get("default") or 0))), NUMBER)


@action("number_add", [("number", 1, MANY)], "number", "sum of the inputs and value")
def number_add(ins: list[Value], args: dict) -> Value:
    return Value(_fold(ins, NUMBER, lambda a, b: a + b, F.lit(float(args.get("value") or 0))), NUMBER, absent=not _plain(ins))


@action("number_subtract", [("number", 1, MANY)], "number", "first input minus the others and value")
def number_subtract(ins: list[Value], args: dict) -> Value:
    return Value(_fold(ins, NUMBER, lambda a, b: a - b) - float(args.get("value") or 0), NUMBER, absent=not _plain(ins))


@action("number_multiply", [("number", 1, MANY)], "number", "product of the inputs and multiplier")
def number_multiply(ins: list[Value], args: dict) -> Value:
    m = args.get("multiplier")
    return Value(_fold(ins, NUMBER, lambda a, b: a * b, F.lit(1.0 if m is None else float(m))), NUMBER, absent=not _plain(ins))


@action("number_divide", [("number", 1, MANY)], "number", "first input divided by the others and denominator; zero fails")
def number_divide(ins: list[Value], args: dict) -> Value:
    c = _fold(ins, NUMBER, lambda a, b: F.try_divide(a, b))
    if args.get("denominator") is not None:
        c = F.try_divide(c, F.lit(float(args["denominator"])))
    given = F.coalesce(*[v.col.cast("string") if not v.many else F.to_json(v.col) for v in ins]).isNotNull()
    return Value(c, NUMBER, absent=not _plain(ins), error=_failed(c.isNull() & given, "number_divide: division by zero"))


@action("number_equals", [("number", 1, MANY)], "bool", "whether all inputs, and value if given, are equal")
def number_equals(ins: list[Value], args: dict) -> Value:
    value = [F.lit(float(args["value"]))] if args.get("value") is not None else []
    if _plain(ins):
        cols = [_one(v, NUMBER) for v in ins] + value
        return Value(reduce(lambda a, b: a & b, [cols[0] == c for c in cols[1:]], F.lit(True)), BOOL)
    xs = F.concat(_list(ins, NUMBER), F.array(*value)) if value else _list(ins, NUMBER)
    return Value(F.size(F.array_distinct(xs)) <= 1, BOOL)


@action("number_exponent", [("number", 1, 2)], "number", "power by the second input or exponent")
def number_exponent(ins: list[Value], args: dict) -> Value:
    return Value(F.pow(_one(ins[0], NUMBER), _second(ins, NUMBER, args, "exponent", default=0.0)), NUMBER)


@action("number_max", [("number", 1, 2)], "bool", "whether the number is above max")
def number_max(ins: list[Value], args: dict) -> Value:
    return Value(_one(ins[0], NUMBER) > _second(ins, NUMBER, args, "max", default=0.0), BOOL)


@action("number_min", [("number", 1, 2)], "bool", "whether the number is below min")
def number_min(ins: list[Value], args: dict) -> Value:
    return Value(_one(ins[0], NUMBER) < _second(ins, NUMBER, args, "min", default=0.0), BOOL)


@action("number_modulus", [("number", 1, 2)], "number", "remainder with the dividend's sign; zero fails")
def number_modulus(ins: list[Value], args: dict) -> Value:
    d = _second(ins, NUMBER, args, "denominator", default=0.0)
    return Value(F.when(d != 0, _one(ins[0], NUMBER) % F.when(d != 0, d)), NUMBER, error=_failed(d == 0, "number_modulus: division by zero"))


@action("number_root", [("number", 1, 2)], "number", "root by the second input or root; 0 and what isn't finite fail")
def number_root(ins: list[Value], args: dict) -> Value:
    r = _second(ins, NUMBER, args, "root", default=0.0)
    c = F.pow(_one(ins[0], NUMBER), 1.0 / F.when(r != 0, r))
    bad = (r == 0) | F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return Value(_clean(c, bad), NUMBER, error=_failed(bad, "number_root: no such root"))


@action("number_round", [("number", 1, 1)], "number", "half away from zero at precision digits")
def number_round(ins: list[Value], args: dict) -> Value:
    c, p = _one(ins[0], NUMBER), 10.0 ** int(args.get("precision") or 0)
    return Value(F.signum(c) * F.floor(F.abs(c) * p + 0.5) / p, NUMBER)


# -- objects -----------------------------------------------------------------------------------------------------------


def _map(v: Value) -> Column:
    """An object as a map of texts (typed ones through their JSON; nested values stay JSON text)."""
    if isinstance(v.struct, T.StructType):
        return F.from_json(F.to_json(v.col), "map<string,string>")
    if v.kind.name in ("any", "string"):
        return F.from_json(v.col, "map<string,string>")
    return v.col


@action("object_get", [("object", 1, 1)], "any", "the value at a dotted, case-sensitive path, else the default")
def object_get(ins: list[Value], args: dict) -> Value:
    c = _map(ins[0])
    path = str(args.get("path") or "").split(".")
    for i, name in enumerate(path):
        c = F.try_element_at(c, F.lit(name))
        if i < len(path) - 1:
            c = F.from_json(c, "map<string,string>")
    default = args.get("default")
    return Value(c if default is None else F.coalesce(c, as_text(literal(default))), ANY)


@action("object_pick", [("object", 1, 1)], "object", "only the keys, as far as they exist")
def object_pick(ins: list[Value], args: dict) -> Value:
    keys = list(map(str, args.get("keys") or []))
    return Value(F.map_filter(_map(ins[0]), lambda k, v: k.isin(keys)), OBJECT)


@action("object_omit", [("object", 1, 1)], "object", "all but the keys")
def object_omit(ins: list[Value], args: dict) -> Value:
    keys = list(map(str, args.get("keys") or []))
    return Value(F.map_filter(_map(ins[0]), lambda k, v: ~k.isin(keys)), OBJECT)


def _merged(a: Column, b: Column, deep: bool) -> Column:
    """Right-biased merge of two maps; deep: where both sides hold JSON objects, one level further down."""
    if not deep:
        return F.map_from_entries(F.concat(F.map_entries(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))), F.map_entries(b)))

    def both(k: Column, x: Column, y: Column) -> Column:
        inner = lambda s: F.from_json(s, "map<string,string>")
        objects = x.startswith("{") & y.startswith("{")
        return F.when(objects, object_json(_merged(inner(x), inner(y), False))).otherwise(F.coalesce(y, x))

    return F.map_zip_with(a, b, both)


@action("object_merge", [("object", 1, MANY)], "object", "right-biased merge, recursive for nested objects if deep")
def object_merge(ins: list[Value], args: dict) -> Value:
    empty = F.create_map().cast("map<string,string>")
    return Value(reduce(lambda a, b: _merged(a, b, bool(args.get("deep"))), [F.coalesce(_map(v), empty) for v in ins]), OBJECT)


@action("object_keys", [("object", 1, 1)], "array:string", "the keys, sorted if asked")
def object_keys(ins: list[Value], args: dict) -> Value:
    keys = F.map_keys(_map(ins[0]))
    return Value(F.array_sort(keys) if args.get("sorted") else keys, array_of(STRING))


@action("object_values", [("object", 1, 1)], "array:any", "the values")
def object_values(ins: list[Value], args: dict) -> Value:
    return Value(F.map_values(_map(ins[0])), array_of(ANY))


# -- text --------------------------------------------------------------------------------------------------------------


def _text(ins: list[Value]) -> Column:
    return _one(ins[0], STRING)


def _cased(c: Column, args: dict) -> Column:
    return F.lower(c) if args.get("case_insensitive") else c


def _classes(c: Column) -> dict[str, Column]:
    n = lambda p: F.length(F.regexp_replace(c, f"[^{p}]", ""))
    return {"upper": n(r"\p{Lu}"), "lower": n(r"\p{Ll}"), "number": n(r"\p{N}"), "special": n(r"\p{S}"), "alpha": n(r"\p{Lt}\p{Lm}\p{Lo}")}


#: What belongs to no class above and isn't punctuation.
_REST = r"[\p{Lu}\p{Ll}\p{N}\p{S}\p{P}\p{Lt}\p{Lm}\p{Lo}]"


@action("text_allowed_char_count", [("string", 1, 1)], "bool", "whether no class of characters passes its limit")
def text_allowed_char_count(ins: list[Value], args: dict) -> Value:
    c = _text(ins)
    ok = reduce(lambda a, b: a & b, [n <= int(args.get(k) or 0) for k, n in _classes(c).items()])
    rest = F.split(F.regexp_replace(c, _REST, ""), "")
    limits = {str(k): int(v) for k, v in (args.get("chars") or {}).items()}
    allowed = lambda x: reduce(lambda e, kv: e.when(x == kv[0], kv[1]), limits.items(), F.when(x == "", 0)).otherwise(0)
    return Value(ok & F.forall(F.filter(rest, lambda x: x != ""), lambda x: F.size(F.filter(rest, lambda y: y == x)) <= allowed(x)), BOOL)


@action("text_required_char_count", [("string", 1, 1)], "bool", "whether every class of characters reaches its limit")
def text_required_char_count(ins: list[Value], args: dict) -> Value:
    c = _text(ins)
    ok = reduce(lambda a, b: a & b, [n >= int(args.get(k) or 0) for k, n in _classes(c).items()])
    for k, least in (args.get("chars") or {}).items():
        ok = ok & (F.length(c) - F.length(F.replace(c, F.lit(str(k)), F.lit(""))) >= int(least))
    return Value(ok, BOOL)


@action("text_concat", [("string", 1, MANY)], "string", "inputs and value joined by separator")
def text_concat(ins: list[Value], args: dict) -> Value:
    parts = [_list([v], STRING) if v.many else _one(v, STRING) for v in ins]
    if args.get("value"):
        parts.append(F.lit(str(args["value"])))
    return Value(F.concat_ws(str(args.get("separator") or ""), *parts), STRING)


def _search(key: str, text: str, op: Callable[[Column, Column], Column]) -> None:
    @action(key, [("string", 1, 2)], "bool", text)
    def build(ins: list[Value], args: dict) -> Value:
        return Value(op(_cased(_text(ins), args), _cased(_second(ins, STRING, args, "substring", default=""), args)), BOOL)


_search("text_contains", "whether the text holds the substring", F.contains)
_search("text_ends_with", "whether the text ends with the substring", F.endswith)
_search("text_starts_with", "whether the text starts with the substring", F.startswith)


@action("text_equals", [("string", 1, MANY)], "bool", "whether all inputs, and value if given, are equal")
def text_equals(ins: list[Value], args: dict) -> Value:
    given = args.get("value", args.get("compare_to"))
    value = [_cased(F.lit(str(given)), args)] if given is not None else []
    if _plain(ins):
        cols = [_cased(_one(v, STRING), args) for v in ins] + value
        return Value(reduce(lambda a, b: a & b, [cols[0] == c for c in cols[1:]], F.lit(True)), BOOL)
    xs = F.transform(_list(ins, STRING), lambda x: _cased(x, args))
    return Value(F.size(F.array_distinct(F.concat(xs, F.array(*value)) if value else xs)) <= 1, BOOL)


@action("text_index_of", [("string", 1, 2)], "number", "place of the substring in bytes from 0, -1 if absent")
def text_index_of(ins: list[Value], args: dict) -> Value:
    c, s = _cased(_text(ins), args), _cased(_second(ins, STRING, args, "substring", default=""), args)
    at = F.call_function("locate", s, c)
    return Value(F.when(at > 0, F.octet_length(F.substring(c, F.lit(1), at - 1))).otherwise(-1).cast("double"), NUMBER)


@action("text_length", [("string", 1, 1)], "number", "length in bytes")
def text_length(ins: list[Value], args: dict) -> Value:
    return Value(F.octet_length(_text(ins)).cast("double"), NUMBER)


@action("text_max_length", [("string", 1, 1), ("number", 0, 1)], "bool", "whether the text has max_length bytes or fewer")
def text_max_length(ins: list[Value], args: dict) -> Value:
    return Value(F.octet_length(_text(ins)) <= _second(ins, NUMBER, args, "max_length", default=0.0), BOOL)


@action("text_min_length", [("string", 1, 1), ("number", 0, 1)], "bool", "whether the text has min_length bytes or more")
def text_min_length(ins: list[Value], args: dict) -> Value:
    return Value(F.octet_length(_text(ins)) >= _second(ins, NUMBER, args, "min_length", default=0.0), BOOL)


@action("text_pad", [("string", 1, 1)], "string", "char repeated on a side up to length bytes; never shortens")
def text_pad(ins: list[Value], args: dict) -> Value:
    c, char, side = _text(ins), str(args.get("char") or " "), args.get("side") or "left"
    n = F.greatest(F.lit(int(args.get("length") or 0)) - F.octet_length(c), F.lit(0))
    left = n if side == "left" else F.floor(n / 2).cast("int") if side == "both" else F.lit(0)
    return Value(F.concat(F.repeat(F.lit(char), left), c, F.repeat(F.lit(char), n - left)), STRING)


def _java(replacement: str) -> str:
    """$1 and ${name} as the regular expressions of the JVM write them."""
    return re.sub(r"\$\{(\w+)\}", lambda m: f"${m[1]}" if m[1].isdigit() else m[0], replacement.replace("\\", "\\\\"))


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


@action("text_replace", [("string", 1, 3)], "string", "old, a regular expression if it is one, replaced by new")
def text_replace(ins: list[Value], args: dict) -> Value:
    c, new = _text(ins), str(args.get("new") or "")
    if len(ins) > 1:
        return Value(F.replace(c, _one(ins[1], STRING), _one(ins[2], STRING) if len(ins) > 2 else F.lit(new)), STRING)
    old = str(args.get("old") or "")
    return Value(F.regexp_replace(c, old, _java(new)) if _compiles(old) else F.replace(c, F.lit(old), F.lit(new)), STRING)


@action("text_regex_match", [("string", 1, 1)], "bool", "whether the pattern occurs")
def text_regex_match(ins: list[Value], args: dict) -> Value:
    return Value(_text(ins).rlike(str(args.get("pattern") or "")), BOOL)


@action("text_regex_extract", [("string", 1, 1)], "string", "a group of the first match, or of all matches")
def text_regex_extract(ins: list[Value], args: dict) -> Value:
    p, g = str(args.get("pattern") or ""), int(args.get("group") or 0)
    if args.get("all"):
        return Value(F.regexp_extract_all(_text(ins), F.lit(p), F.lit(g)), array_of(STRING))
    return Value(F.regexp_extract(_text(ins), p, g), STRING)


@action("text_regex_replace", [("string", 1, 1)], "string", "all matches replaced; $1 names a group")
def text_regex_replace(ins: list[Value], args: dict) -> Value:
    return Value(F.regexp_replace(_text(ins), str(args.get("pattern") or ""), _java(str(args.get("replacement") or ""))), STRING)


@action("text_reverse", [("string", 1, 1)], "string", "characters in reverse")
def text_reverse(ins: list[Value], args: dict) -> Value:
    return Value(F.reverse(_text(ins)), STRING)


def _characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


@action("text_split", [("string", 1, 2)], "array:string", "parts between separators; characters without a separator")
def text_split(ins: list[Value], args: dict) -> Value:
    if len(ins) > 1:
        s = _one(ins[1], STRING)
        quoted = F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        return Value(F.when(s == "", _characters(_text(ins))).otherwise(F.split(_text(ins), quoted, -1)), array_of(STRING))
    s = str(args.get("separator") or "")
    return Value(F.split(_text(ins), re.escape(s), -1) if s else _characters(_text(ins)), array_of(STRING))


@action("text_substring", [("string", 1, 1)], "string", "bytes start … end, negative from the end, end 0 the end")
def text_substring(ins: list[Value], args: dict) -> Value:
    b = F.encode(_text(ins), "UTF-8")
    n, start, end = F.octet_length(b), int(args.get("start") or 0), int(args.get("end") or 0)
    s = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    e = n if end == 0 else F.least(F.lit(end), n) if end > 0 else n + end
    return Value(F.when((s < n) & (e > s), F.decode(F.substring(b, s + 1, e - s), "UTF-8")).otherwise(F.when(b.isNotNull(), "")), STRING)


@action("text_to_array", [("string", 1, 1)], "array:string", "the characters")
def text_to_array(ins: list[Value], args: dict) -> Value:
    return Value(_characters(_text(ins)), array_of(STRING))


@action("text_to_bool", [("string", 1, 1)], "bool", "1 t T TRUE true True and 0 f F FALSE false False; else fails")
def text_to_bool(ins: list[Value], args: dict) -> Value:
    c = _text(ins)
    got = F.when(c.isin("1", "t", "T", "TRUE", "true", "True"), True).when(c.isin("0", "f", "F", "FALSE", "false", "False"), False)
    return Value(got, BOOL, error=_failed(c.isNotNull() & got.isNull(), "text_to_bool: not a bool"))


@action("text_to_number", [("string", 1, 1)], "number", "a number read from text; else fails")
def text_to_number(ins: list[Value], args: dict) -> Value:
    c = _text(ins)
    got = c.try_cast("double")
    return Value(got, NUMBER, error=_failed(c.isNotNull() & got.isNull(), "text_to_number: not a number"))


@action("text_to_lower", [("string", 1, 1)], "string", "lower case")
def text_to_lower(ins: list[Value], args: dict) -> Value:
    return Value(F.lower(_text(ins)), STRING)


@action("text_to_upper", [("string", 1, 1)], "string", "upper case")
def text_to_upper(ins: list[Value], args: dict) -> Value:
    return Value(F.upper(_text(ins)), STRING)


@action("text_trim", [("string", 1, 1)], "string", "without white space, or chars, on a side or both")
def text_trim(ins: list[Value], args: dict) -> Value:
    c, side = _text(ins), args.get("side") or "both"
    if args.get("chars"):
        chars = F.lit(str(args["chars"]))
        return Value({"left": F.ltrim, "right": F.rtrim}.get(side, F.trim)(c, chars), STRING)
    if side == "left":
        return Value(F.regexp_replace(c, r"^[ \t\n\r]+", ""), STRING)
    if side == "right":
        return Value(F.regexp_replace(c, r"[ \t\n\r]+$", ""), STRING)
    return Value(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), STRING)

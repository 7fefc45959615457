"""Each action on literal inputs, against the documented result."""

import math

import pytest
from pyspark.sql import functions as F

from weftline.functions.actions import REGISTRY, apply_action, check_inputs, output_kind
from weftline.functions.values import ANY, BOOL, NUMBER, OBJECT, STRING, Value, array_of, literal

OBJ = {"b": 1, "a": "x", "c": {"d": {"e": "deep"}}}
NULL = object()  # columns need a session, so it is made when a case runs
CASES = [
    ("any_coalesce", ["", "x"], {}, "x"),
    ("any_coalesce", [NULL, ""], {"default": "d"}, "d"),
    ("any_coalesce", [0, 5], {}, 0.0),
    ("any_default", [""], {"default": "d"}, "d"),
    ("any_default", [0], {"default": 4}, 0.0),
    ("any_if_else", [True, "yes"], {"else": "no"}, "yes"),
    ("any_if_else", [False, "yes"], {"else": "no"}, "no"),
    ("any_is_nil", [NULL], {}, True),
    ("any_is_empty", [[]], {}, True),
    ("any_is_empty", [0], {}, False),
    ("any_to_string", [12.0], {}, "12"),
    ("any_to_string", [0.000001], {}, "0.000001"),
    ("any_to_string", [True], {}, "true"),
    ("any_to_string", [NULL], {}, ""),
    ("array_contains", [["a", "b"]], {"searchItems": ["z", "b"]}, True),
    ("array_contains", [["a"], "q"], {}, False),
    ("array_distinct", [["b", "a", "b"]], {}, ["b", "a"]),
    ("array_filter", [[1, 2, 4]], {"actionKey": "number_is_even"}, [2.0, 4.0]),
    ("array_filter", [[1, 2, 4]], {"actionKey": "number_is_even", "invert": True}, [1.0]),
    ("array_every", [[2, 4]], {"actionKey": "number_is_even"}, True),
    ("array_every", [[]], {"actionKey": "text_min_length", "args": {"min_length": 3}}, True),
    ("array_flatten", [[[1], [2, 3]]], {}, [1.0, 2.0, 3.0]),
    ("array_index_of", [["a", "b"]], {"item": "b"}, 1.0),
    ("array_index_of", [["a", "b"], "q"], {}, -1.0),
    ("array_length", [["a", "b"]], {}, 2.0),
    ("array_push", [["a"], "z"], {"items": ["b"]}, ["a", "b", "z"]),
    ("array_reverse", [[1, 2]], {}, [2.0, 1.0]),
    ("array_skip", [[1, 2, 3]], {"count": 2}, [3.0]),
    ("array_skip", [[1, 2, 3]], {"count": 9}, []),
    ("array_take", [[1, 2, 3]], {"count": -1}, []),
    ("array_take", [[1, 2, 3], 2], {}, [1.0, 2.0]),
    ("date_parse", ["2024-03-01"], {}, "2024-03-01T00:00:00Z"),
    ("date_parse", ["2024-03-01T10:00:00.5+02:00"], {}, "2024-03-01T10:00:00+02:00"),
    ("date_parse", ["Fri, 01 Mar 2024 10:00:00 UTC"], {"output_format": "date"}, "2024-03-01"),
    ("date_parse", ["03/01/2024"], {"input_format": "01/02/2006", "output_format": "Jan 2, 2006"}, "Mar 1, 2024"),
    ("date_parse", ["2024-07-01T00:00:00Z"], {"timezone": "America/New_York"}, "2024-06-30T20:00:00-04:00"),
    ("date_format", ["2024-03-01 10:20:30"], {"format": "2006/01/02 15h04"}, "2024/03/01 10h20"),
    ("date_diff", ["2024-03-01", "2024-03-02T12:00:00Z"], {"unit": "days"}, 1.5),
    ("date_diff", ["2024-03-02", "2024-03-01"], {}, -86400.0),
    ("date_add", ["2024-01-31"], {"months": 1}, "2024-03-02T00:00:00Z"),
    ("date_add", ["2023-12-31T23:00:00Z"], {"hours": 2, "format": "datetime"}, "2024-01-01 01:00:00"),
    ("number_abs", [-3], {}, 3.0),
    ("number_clamp", [7], {"min": 1, "max": 5}, 5.0),
    ("number_parse", ["1.5"], {}, 1.5),
    ("number_parse", ["x"], {"default": 7}, 7.0),
    ("number_sign", [-2], {}, -1.0),
    ("number_factorial", [5], {}, 120.0),
    ("number_factorial", [0.5], {}, math.gamma(1.5)),
    ("number_add", [1, 2, 3], {"value": 4}, 10.0),
    ("number_ceiling", [1.2], {}, 2.0),
    ("number_cube_root", [27], {}, 3.0),
    ("number_cube", [3], {}, 27.0),
    ("number_divide", [12, 3], {"denominator": 2}, 2.0),
    ("number_equals", [2, 2], {"value": 2}, True),
    ("number_equals", [2, 3], {}, False),
    ("number_exponent", [2], {"exponent": 3}, 8.0),
    ("number_exponent", [2, 4], {"exponent": 3}, 16.0),
    ("number_floor", [-1.2], {}, -2.0),
    ("number_max", [5], {"max": 4}, True),
    ("number_min", [5], {"min": 4}, False),
    ("number_modulus", [-7], {"denominator": 3}, -1.0),
    ("number_multiply", [5, 12.99], {}, 64.95),
    ("number_root", [27], {"root": 3}, 27 ** (1 / 3)),
    ("number_round", [12.345], {"precision": 2}, 12.35),
    ("number_round", [-2.5], {}, -3.0),
    ("number_square_root", [16], {}, 4.0),
    ("number_square", [4], {}, 16.0),
    ("number_subtract", [10, 3], {"value": 2}, 5.0),
    ("number_to_negative", [-5], {}, 5.0),
    ("number_to_positive", [-5], {}, 5.0),
    ("number_to_string", [1e-7], {}, "0.0000001"),
    ("number_is_even", [2.5], {}, False),
    ("number_is_odd", [-3], {}, True),
    ("object_get", [OBJ], {"path": "c.d.e"}, "deep"),
    ("object_get", [OBJ], {"path": "c.z", "default": "n"}, "n"),
    ("object_pick", [OBJ], {"keys": ["a", "q"]}, {"a": "x"}),
    ("object_omit", [OBJ], {"keys": ["c", "b"]}, {"a": "x"}),
    ("object_merge", [{"a": 1, "b": 2}, {"b": 3}], {}, {"a": "1", "b": "3"}),
    ("object_merge", [{"a": {"x": 1}}, {"a": {"y": 2}}], {"deep": True}, {"a": '{"x":1,"y":2}'}),
    ("object_keys", [OBJ], {"sorted": True}, ["a", "b", "c"]),
    ("object_values", [{"a": 1}], {}, ["1"]),
    ("text_allowed_char_count", ["Ab1"], {"upper": 1, "lower": 1, "number": 1}, True),
    ("text_allowed_char_count", ["Ab12"], {"upper": 1, "lower": 1, "number": 1}, False),
    ("text_required_char_count", ["Ab1"], {"upper": 1, "number": 2}, False),
    ("text_concat", ["a", "b"], {"separator": "-", "value": "c"}, "a-b-c"),
    ("text_contains", ["Hello", "ELL"], {"case_insensitive": True}, True),
    ("text_ends_with", ["Hello"], {"substring": "lo"}, True),
    ("text_equals", ["a", "A"], {"case_insensitive": True}, True),
    ("text_equals", ["a"], {"value": "b"}, False),
    ("text_index_of", ["éa"], {"substring": "a"}, 2.0),
    ("text_index_of", ["a"], {"substring": "z"}, -1.0),
    ("text_length", ["é"], {}, 2.0),
    ("text_max_length", ["foo"], {"max_length": 2}, False),
    ("text_min_length", ["foo bar"], {"min_length": 7}, True),
    ("text_pad", ["7"], {"length": 3, "char": "0", "side": "left"}, "007"),
    ("text_pad", ["ab"], {"length": 5, "char": "*", "side": "both"}, "*ab**"),
    ("text_pad", ["abcdef"], {"length": 3, "char": "*"}, "abcdef"),
    ("text_replace", ["a.b.c"], {"old": "[.]", "new": "-"}, "a-b-c"),
    ("text_regex_match", ["abc123"], {"pattern": "\\d+"}, True),
    ("text_regex_extract", ["a1b22"], {"pattern": "\\d+", "all": True}, ["1", "22"]),
    ("text_regex_extract", ["a1b22"], {"pattern": "([a-z])(\\d)", "group": 2}, "1"),
    ("text_regex_replace", ["john smith"], {"pattern": "(\\w+) (\\w+)", "replacement": "${2} $1"}, "smith john"),
    ("text_reverse", ["abc"], {}, "cba"),
    ("text_split", ["test,test,test"], {"separator": ","}, ["test"] * 3),
    ("text_split", ["apple"], {}, list("apple")),
    ("text_split", ["a.b", "."], {}, ["a", "b"]),
    ("text_starts_with", ["Hello"], {"substring": "He"}, True),
    ("text_substring", ["hello"], {"start": 1, "end": -1}, "ell"),
    ("text_substring", ["hello"], {"start": -3}, "llo"),
    ("text_substring", ["hello"], {"start": 9}, ""),
    ("text_to_array", ["ab"], {}, ["a", "b"]),
    ("text_to_bool", ["T"], {}, True),
    ("text_to_number", ["2.5"], {}, 2.5),
    ("text_to_lower", ["AB"], {}, "ab"),
    ("text_to_upper", ["ab"], {}, "AB"),
    ("text_trim", ["  a "], {}, "a"),
    ("text_trim", ["xxaxx"], {"chars": "x", "side": "left"}, "axx"),
]
FAILS = [
    ("number_square_root", [-1], {}),
    ("number_modulus", [1], {"denominator": 0}),
    ("number_divide", [1, 0], {}),
    ("number_root", [8], {"root": 0}),
    ("text_to_bool", ["yes"], {}),
    ("text_to_number", ["x"], {}),
    ("date_parse", ["never"], {}),
    ("date_diff", ["2024-01-01", "x"], {}),
]


def value(x):
    return Value(F.lit(None).cast("string"), STRING) if x is NULL else literal(x)


def evaluate(spark, values):
    cols = [c for v in values for c in (v.col, v.error if v.error is not None else F.lit(None).cast("string"))]
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_all_actions(spark):
    for at in range(0, len(CASES), 30):
        part = CASES[at : at + 30]
        got = evaluate(spark, [apply_action(k, [value(x) for x in ins], args) for k, ins, args, _ in part])
        for i, (k, ins, args, want) in enumerate(part):
            if isinstance(want, float) and not isinstance(want, bool):
                assert math.isclose(got[2 * i], want, rel_tol=1e-12), (k, ins, args, got[2 * i])
            else:
                assert got[2 * i] == want, (k, ins, args, got[2 * i])
            assert got[2 * i + 1] is None, (k, ins, args)


def test_failures_are_errors_of_the_row(spark):
    got = evaluate(spark, [apply_action(k, [value(x) for x in ins], args) for k, ins, args in FAILS])
    for i, case in enumerate(FAILS):
        assert got[2 * i] is None and got[2 * i + 1], case


def test_registry_is_complete_and_tested():
    assert len(REGISTRY) == 81
    assert {k for k, *_ in CASES} >= set(REGISTRY) - {"date_now", "array_randomize"}


def test_random_ones(spark):
    row = spark.range(1).select(apply_action("date_now", [], {"format": "2006"}).col.alias("d"), apply_action("array_randomize", [literal([1, 2, 3])], {}).col.alias("a")).first()
    assert row.d.isdigit() and sorted(row.a) == [1.0, 2.0, 3.0]


def test_input_rules():
    assert check_inputs("number_add", [NUMBER, NUMBER]) == []
    assert check_inputs("number_abs", [NUMBER, NUMBER]) and check_inputs("text_to_upper", [NUMBER]) and check_inputs("date_diff", [STRING])
    assert check_inputs("array_skip", [array_of(STRING), NUMBER]) == [] and check_inputs("object_get", [OBJECT]) == [] and check_inputs("any_if_else", [BOOL, STRING]) == []
    assert output_kind("array_filter", [array_of(NUMBER)]) == array_of(NUMBER) and output_kind("object_get", [OBJECT]) == ANY


@pytest.mark.parametrize("key", ["number_add", "number_multiply", "text_concat", "number_equals"])
def test_array_items_fan_in(spark, key):
    items = Value(F.array(*[F.lit(float(i)) for i in (1, 2, 3, 4, 5)]), NUMBER, many=True) if key != "text_concat" else Value(F.array(F.lit("a"), F.lit("b")), STRING, many=True)
    got = evaluate(spark, [apply_action(key, [items], {})])[0]
    assert got == {"number_add": 15.0, "number_multiply": 120.0, "text_concat": "ab", "number_equals": False}[key]

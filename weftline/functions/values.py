"""Value types of mappings, their Spark types, emptiness and defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("string", "number", "bool", "array", "object", "date", "any")


@dataclass(frozen=True)
class Kind:
    """A value type: one of KINDS; ``items`` for arrays."""

    name: str
    items: Kind | None = None

    def __str__(self) -> str:
        return f"array<{self.items}>" if self.name == "array" else self.name

    def accepts(self, other: Kind) -> bool:
        """Whether a value of ``other`` may be assigned; any goes both ways."""
        if "any" in (self.name, other.name):
            return True
        if self.name != other.name:
            return self.name == "date" and other.name == "string"
        return self.name != "array" or self.items is None or other.items is None or self.items.accepts(other.items)


STRING, NUMBER, BOOL, OBJECT, DATE, ANY = (Kind(k) for k in ("string", "number", "bool", "object", "date", "any"))


def array_of(items: Kind | None = None) -> Kind:
    return Kind("array", items or ANY)


def spark_type(kind: Kind) -> T.DataType:
    """Numbers are doubles, dates strings at the edge, free objects maps of strings, any a string."""
    if kind.name == "array":
        return T.ArrayType(spark_type(kind.items or ANY))
    simple = {"number": T.DoubleType(), "bool": T.BooleanType(), "object": T.MapType(T.StringType(), T.StringType())}
    return simple.get(kind.name, T.StringType())


def kind_of(data_type: T.DataType) -> Kind:
    if isinstance(data_type, T.NumericType):
        return NUMBER
    if isinstance(data_type, T.BooleanType):
        return BOOL
    if isinstance(data_type, T.ArrayType):
        return array_of(kind_of(data_type.elementType))
    if isinstance(data_type, T.StructType | T.MapType):
        return OBJECT
    if isinstance(data_type, T.TimestampType | T.TimestampNTZType | T.DateType):
        return DATE
    return STRING


@dataclass(frozen=True)
class Value:
    """A column with its kind. ``absent``: null means that nothing was produced, so it is no input at all.

    ``many``: the column is an array whose elements are separate inputs. ``error``: a message where the value failed, else
    null. ``struct`` is the Spark type of typed objects.
    """

    col: Column
    kind: Kind
    absent: bool = False
    many: bool = False
    error: Column | None = None
    struct: T.DataType | None = None


def zero(kind: Kind) -> Column:
    """The type's default as a column."""
    if kind.name == "string" or kind.name == "date":
        return F.lit("")
    if kind.name == "number":
        return F.lit(0.0)
    if kind.name == "bool":
        return F.lit(False)
    if kind.name == "array":
        return F.array().cast(spark_type(kind))
    if kind.name == "object":
        return F.create_map().cast("map<string,string>")
    return F.lit(None).cast("string")


def is_empty(v: Value) -> Column:
    """Null, "", [] or {}; 0 and false are not empty."""
    if v.kind.name in ("string", "date", "any"):
        return v.col.isNull() | (v.col == "")
    if v.kind.name == "array" or (v.kind.name == "object" and not isinstance(v.struct, T.StructType)):
        return v.col.isNull() | (F.size(v.col) <= 0)
    return v.col.isNull()


def number_text(c: Column) -> Column:
    """Whole numbers without decimals, others in the shortest decimal form, never with an exponent."""
    plain = c.cast("string")
    wide = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", "")
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("long").cast("string")).when(plain.contains("E"), wide).otherwise(plain)


def as_text(v: Value) -> Column:
    """String form of any value: null is "", composites are JSON."""
    if v.kind.name == "number":
        out = number_text(v.col)
    elif v.kind.name == "bool":
        out = v.col.cast("string")
    elif v.kind.name in ("array", "object"):
        out = F.to_json(v.col)
    else:
        out = v.col.cast("string")
    return F.coalesce(out, F.lit(""))


def literal(x: object) -> Value:
    """A constant: bool, number, string, array or object."""
    if isinstance(x, bool):
        return Value(F.lit(x), BOOL)
    if isinstance(x, int | float):
        return Value(F.lit(float(x)), NUMBER)
    if isinstance(x, list | tuple):
        parts = [literal(y) for y in x]
        kind = parts[0].kind if parts else ANY
        if any(p.kind != kind for p in parts):
            parts, kind = [Value(as_text(p), STRING) for p in parts], STRING
        return Value(F.array(*[p.col for p in parts]) if parts else F.array().cast("array<string>"), array_of(kind))
    if isinstance(x, dict):
        pairs = [c for k, v in x.items() for c in (F.lit(str(k)), as_text(literal(v)))]
        return Value(F.create_map(*pairs).cast("map<string,string>"), OBJECT)
    if x is None:
        return Value(F.lit(None).cast("string"), ANY)
    return Value(F.lit(str(x)), STRING)

"""Mappings: JSON definitions of fields, steps and links, compiled once on the driver to one projection.

A definition is checked (``validate``), its links are ordered by priority, and every target field becomes a Column over the
message; ``apply_mapping`` adds them as one struct in a single select, which Catalyst prunes, folds and compiles. Array item
fields stay index-aligned through ``transform``; scalars that target array items are captured in its lambda; array items that
feed a step all become inputs of it. Where a step or a required field fails the row carries an error and no data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.actions import REGISTRY, apply_action, check_inputs, output_kind
from weftline.functions.paths import PathError, json_text, typed
from weftline.functions.values import ANY, Kind, Value, is_empty, kind_of, literal, spark_type, zero


@dataclass
class Field:
    id: str
    path: str
    kind: Kind
    required: bool = False
    default: object = None
    fields: list[Field] = field(default_factory=list)
    items: Field | None = None
    parent: Field | None = None
    is_item: bool = False

    @staticmethod
    def read(d: dict, parent: Field | None = None, is_item: bool = False) -> Field:
        own = Field(d["id"], d.get("path", ""), ANY, bool(d.get("required")), d.get("default"), parent=parent, is_item=is_item)
        own.fields = [Field.read(x, own) for x in d.get("fields") or []]
        own.items = Field.read(d["items"], own, True) if d.get("items") else None
        own.kind = Kind(d.get("type", "any"), own.items.kind if own.items else None)
        return own

    def walk(self):
        yield self
        for x in self.fields:
            yield from x.walk()
        if self.items:
            yield from self.items.walk()

    @property
    def array(self) -> Field | None:
        """The array field that this field is an item of, or lies inside an item of."""
        x = self
        while x is not None:
            if x.is_item:
                return x.parent
            x = x.parent
        return None


@dataclass
class Link:
    priority: int
    source: dict
    target: dict


@dataclass
class Definition:
    """A mapping: source_fields, target_fields, steps {id, type, action{key, arguments, invert}} and links."""

    id: str
    sources: list[Field]
    targets: list[Field]
    steps: dict[str, dict]
    links: list[Link]

    @staticmethod
    def read(d: dict) -> Definition:
        links = [Link(int(x.get("priority") or 0), x["source"], x["target"]) for x in d.get("links") or []]
        links.sort(key=lambda x: x.priority)  # stable: ties keep their place
        return Definition(d.get("id", ""), [Field.read(x) for x in d.get("source_fields") or []], [Field.read(x) for x in d.get("target_fields") or []], {s["id"]: s for s in d.get("steps") or []}, links)

    def source(self, name: str) -> Field | None:
        return next((f for x in self.sources for f in x.walk() if f.id == name), None)

    def target(self, name: str) -> Field | None:
        return next((f for x in self.targets for f in x.walk() if f.id == name), None)


def validate(d: dict | Definition) -> list[str]:
    """All errors of a definition: endpoints, actions, types, input rules, cycles. An empty list means that it compiles."""
    m = d if isinstance(d, Definition) else Definition.read(d)
    errors: list[str] = []
    for what, fields in (("source", m.sources), ("target", m.targets)):
        ids = [f.id for x in fields for f in x.walk()]
        errors += [f"{what} field {i!r} is defined twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
    for s in m.steps.values():
        key = s.get("action", {}).get("key")
        if key not in REGISTRY:
            errors.append(f"step {s['id']!r}: unknown action {key!r}")
        if s.get("type") not in ("transformer", "validator", "condition"):
            errors.append(f"step {s['id']!r}: unknown type {s.get('type')!r}")
    for i, x in enumerate(m.links):
        given = [k for k in ("field_id", "step_id") if x.source.get(k)] + (["constant"] if "constant" in x.source and x.source["constant"] is not None else [])
        to = [k for k in ("field_id", "step_id") if x.target.get(k)]
        if len(given) != 1 or len(to) != 1:
            errors.append(f"link {i}: needs one source and one target")
            continue
        if x.source.get("field_id") and not m.source(x.source["field_id"]):
            errors.append(f"link {i}: source field {x.source['field_id']!r} is not defined")
        if x.target.get("field_id") and not m.target(x.target["field_id"]):
            errors.append(f"link {i}: target field {x.target['field_id']!r} is not defined")
        errors += [f"link {i}: step {s!r} is not defined" for s in (x.source.get("step_id"), x.target.get("step_id")) if s and s not in m.steps]
    if errors:
        return errors
    kinds: dict[str, Kind] = {}

    def step_kind(name: str, path: tuple = ()) -> Kind:
        if name in path:
            raise RecursionError(f"step {name!r} depends on itself")
        if name not in kinds:
            own = [source_kind(x, (*path, name)) for x in m.links if x.target.get("step_id") == name]
            step = m.steps[name]
            key = step["action"]["key"]
            errors.extend(f"step {name!r}: {e}" for e in check_inputs(key, own))
            out = output_kind(key, own, step["action"].get("arguments"))
            if step["type"] != "transformer":
                if out.name not in ("bool", "any"):
                    errors.append(f"step {name!r}: {step['type']} actions must return a boolean, got {out}")
                out = own[0] if own else ANY
            kinds[name] = out
        return kinds[name]

    def source_kind(x: Link, path: tuple) -> Kind:
        if x.source.get("field_id"):
            return m.source(x.source["field_id"]).kind
        return step_kind(x.source["step_id"], path) if x.source.get("step_id") else literal(x.source["constant"]).kind

    try:
        for name in m.steps:
            step_kind(name)
        for i, x in enumerate(m.links):
            if x.target.get("field_id"):
                got, want = source_kind(x, ()), m.target(x.target["field_id"]).kind
                if not want.accepts(got):
                    errors.append(f"link {i}: {got} can't be assigned to {want}")
    except RecursionError as e:
        errors.append(str(e))
    return errors


class Compiled:
    """``columns``: {target path: Column}; ``error``: the first error of a row as text, else null."""

    def __init__(self, d: dict | Definition, body: Column, body_type: T.DataType, parsed: Column | None = None):
        """``parsed``: the column of ``first_parse`` for JSON bodies, whose fields are tried before the general look-up."""
        self.parsed, self.known = parsed, parse_schema(d if isinstance(d, Definition) else Definition.read(d))[1]
        self.m = d if isinstance(d, Definition) else Definition.read(d)
        if errors := validate(self.m):
            raise ValueError("; ".join(errors))
        self.json = isinstance(body_type, T.StringType)
        self.body, self.type = body, body_type
        self.errors: list[Column] = []
        self.values: dict[str, Value] = {}  # of fields that aren't inside array items
        self.inner: dict[str, tuple] = {}  # of fields inside array items: (array field, element -> Value)
        for f in self.m.sources:
            if self._used(f):
                self._source(f, body, body_type)
        self.steps: dict[str, Value] = {}
        self.error: Column | None = None
        self.columns = self._targets()
        if self.errors:
            self.error = F.coalesce(*self.errors)

    def _used(self, f: Field) -> bool:
        ids = {x.source.get("field_id") for x in self.m.links}
        return any(x.id in ids or x.required for x in f.walk())

    # -- source fields

    def _extract(self, f: Field, col: Column, t: T.DataType) -> Value:
        """The field's value: required, default or the type's default where the key is missing."""
        try:
            if isinstance(t, T.StringType):
                text = json_text(col, f.path) if f.path else col
                if self.parsed is not None and col is self.body and f.path in self.known:
                    quick = self.parsed
                    for name in f.path.split("."):
                        quick = quick.getField(name)
                    want = spark_type(f.kind)
                    if f.kind.name == "array":
                        text = quick, text
                    else:
                        text = F.coalesce(quick, text.try_cast(want) if f.kind.name in ("number", "bool") else text)
                want = spark_type(f.kind)
                if f.kind.name == "array":
                    listed = lambda x: F.from_json(x, "array<string>")
                    t, c = T.ArrayType(T.StringType()), F.coalesce(text[0], listed(text[1])) if isinstance(text, tuple) else listed(text)
                    if f.items and f.items.kind.name not in ("object", "any", "string", "date", "array"):
                        c = F.transform(c, lambda x: x.try_cast(spark_type(f.items.kind)))
                        t = T.ArrayType(spark_type(f.items.kind))
                elif f.kind.name == "object":
                    t, c = T.StringType(), text
                else:
                    t, c = want, text.try_cast(want) if f.kind.name in ("number", "bool") else text  # a no-op after the first parse
            else:
                c, t = typed(col, t, f.path) if f.path else (col, t)
                if f.kind.name == "number" and isinstance(t, T.NumericType):
                    c, t = c.cast("double"), T.DoubleType()
        except PathError:
            if f.required:
                self.errors.append(F.lit(f"{f.id}: field is required but missing value"))
            v = literal(f.default) if f.default not in (None, "", [], {}) else Value(zero(f.kind), f.kind)
            return replace(v, struct=spark_type(f.kind) if f.kind.name == "array" else None)
        missing = literal(f.default).col if f.default not in (None, "", [], {}) else None
        if self.json or missing is not None:
            # JSON can't tell a missing key from null here, so both take the default.
            fallback = missing if missing is not None else zero(f.kind) if f.kind.name not in ("array", "object") else F.lit(None)
            if f.required:
                self.errors.append(F.when(c.isNull(), F.lit(f"{f.id}: field is required but missing value")))
            c = F.coalesce(c, fallback.cast(t) if not isinstance(t, T.StructType) else c)
        elif f.required and f.array is None:
            self.errors.append(F.when(c.isNull(), F.lit(f"{f.id}: field is required but missing value")))
        kind = f.kind if f.kind != ANY else kind_of(t)
        if kind.name == "string" and not isinstance(t, T.StringType):
            c = c.cast("string")
        if kind.name == "date":
            c = c.cast("string")
        return Value(c, kind, struct=t)

    def _source(self, f: Field, col: Column, t: T.DataType) -> None:
        v = self._extract(f, col, t)
        self.values[f.id] = v
        for x in f.fields:
            self._source(x, v.col, v.struct)
        if f.items:
            element = v.struct.elementType if isinstance(v.struct, T.ArrayType) else T.StringType()
            self._inner(f, f.items, element, lambda x: x)

    def _inner(self, array: Field, f: Field, t: T.DataType, get) -> None:
        probe = self._extract(f, F.lit(None).cast(t), t)
        value = lambda x, f=f, t=t, get=get: self._extract(f, get(x), t)
        self.inner[f.id] = (array, value, probe.kind)
        for y in f.fields:
            self._inner(array, y, probe.struct, lambda x, value=value: value(x).col)

    # -- links

    def _inputs(self, x: Link) -> Value | None:
        if "constant" in x.source and x.source["constant"] is not None:
            return literal(x.source["constant"])
        if x.source.get("step_id"):
            return self._step(x.source["step_id"])
        name = x.source["field_id"]
        if name in self.inner:
            array, value, kind = self.inner[name]
            return Value(F.transform(self.values[array.id].col, lambda e: value(e).col), kind, many=True)
        return self.values[name]

    def _step(self, name: str) -> Value:
        if name in self.steps:
            return self.steps[name]
        step = self.m.steps[name]
        ins = [self._inputs(x) for x in self.m.links if x.target.get("step_id") == name]
        act = step["action"]
        got = apply_action(act["key"], ins, act.get("arguments"))
        # A step whose inputs are all absent isn't executed.
        absent = [v for v in ins if v.absent or v.many]
        if len(absent) == len(ins):
            given = [F.size(F.array_compact(v.col)) > 0 if v.many else v.col.isNotNull() for v in ins]
            got = replace(got, col=F.when(_any(given), got.col), error=None if got.error is None else F.when(_any(given), got.error))
        if step["type"] == "transformer":
            got = replace(got, absent=True)
            if got.error is not None:
                self.errors.append(F.when(got.error.isNotNull(), F.concat(F.lit(f"{name}: "), got.error)))
                got = replace(got, error=None)
        else:
            # Validators and conditions pass their first input on, or nothing; a failed validator is no error of the row.
            holds = F.coalesce(got.col, F.lit(False))
            holds = ~holds if act.get("invert") else holds
            first = ins[0]
            col = F.when(holds, F.get(first.col, F.lit(0)) if first.many else first.col)
            got = Value(col, first.kind, absent=True, struct=first.struct)
        self.steps[name] = got
        return got

    # -- target fields

    def _written(self, f: Field, v: Value) -> Column:
        """A value as a target's: an empty one takes the default or the type's default, or fails if required."""
        c, kind = v.col, f.kind if f.kind != ANY else v.kind
        want = v.struct if isinstance(v.struct, T.StructType) else spark_type(kind)
        if kind.name == "array" and isinstance(v.struct, T.ArrayType):
            want = v.struct
        if kind != v.kind and kind.name in ("string", "number", "bool", "date"):
            c = c.cast(spark_type(kind))
        empty = is_empty(replace(v, col=c, kind=kind))
        if v.absent:
            empty = empty & v.col.isNotNull()
        if f.required:
            self.errors.append(F.when(empty, F.lit(f"{f.id}: field is required but missing value")))
            return c
        default = literal(f.default).col.cast(want) if f.default not in (None, "", [], {}) else None if isinstance(want, T.StructType) else zero(kind).cast(want)
        return c if default is None else F.when(empty, default).otherwise(c)

    def _links_to(self, f: Field) -> list[Link]:
        return [x for x in self.m.links if x.target.get("field_id") == f.id]

    def _target(self, f: Field) -> Column | None:
        """The last write wins, as far as it produced something; None if nothing is ever written."""
        out = None
        for x in self._links_to(f):
            v = self._inputs(x)
            if v.many:
                v = Value(F.try_element_at(v.col, F.lit(-1)), v.kind, absent=True)
            c = self._written(f, v)
            out = c if out is None or not v.absent else F.coalesce(c, out)
        if f.items is not None and (own := self._items(f)) is not None:
            out = own
        if f.fields:
            parts = {x.path or x.id: c for x in f.fields if (c := self._target(x)) is not None}
            if parts:
                out = assemble(parts)
        return out

    def _items(self, f: Field) -> Column | None:
        """An array of which items, or fields of items, are written: aligned by index to the longest source array."""
        leaves = [x for x in f.items.walk() if self._links_to(x)]
        sources: dict[str, Field] = {}
        for leaf in leaves:
            for x in self._links_to(leaf):
                if x.source.get("field_id") in self.inner:
                    array = self.inner[x.source["field_id"]][0]
                    sources[array.id] = array
        if not sources:
            return None  # scalars alone find no items to go to
        arrays = [self.values[a].col for a in sources]
        order = list(sources)
        errors, self.errors = self.errors, []  # an item's required field can't be told per row here

        def leaf_value(leaf: Field, at) -> Column | None:
            out = None
            for x in self._links_to(leaf):
                name = x.source.get("field_id")
                v = self.inner[name][1](at(self.inner[name][0].id)) if name in self.inner else self._inputs(x)
                c = self._written(leaf, v)
                out = c if out is None or not v.absent else F.coalesce(c, out)
            return out

        def build(node: Field, at) -> Column | None:
            if node.fields:
                parts = {x.path or x.id: c for x in node.fields if (c := build(x, at)) is not None}
                return assemble(parts) if parts else None
            return leaf_value(node, at)

        if len(arrays) == 1:
            out = F.transform(arrays[0], lambda e: build(f.items, lambda _: e))
        else:
            zipped = F.arrays_zip(*[a.alias(f"a{i}") for i, a in enumerate(arrays)])
            out = F.transform(zipped, lambda e: build(f.items, lambda name: e[f"a{order.index(name)}"]))
        self.errors = errors
        return out

    def _targets(self) -> dict[str, Column]:
        return {f.path or f.id: c for f in self.m.targets if (c := self._target(f)) is not None}


def parse_schema(m: Definition) -> tuple[T.StructType | None, set[str]]:
    """(schema, paths) of one typed parse for the source fields of plain dotted paths: scalars, and arrays as text items."""
    tree: dict = {}
    paths: set[str] = set()
    for f in m.sources:
        names = f.path.split(".")
        if not f.path or f.kind.name == "object" or not all(re.fullmatch(r"[^\[\].]+", n) for n in names):
            continue
        node, clash = tree, False
        for n in names:
            clash |= any(k != n and k.lower() == n.lower() for k in node)  # such names would be ambiguous in one struct
            if n is names[-1] or clash:
                break
            node = node.setdefault(n, {})
            clash |= not isinstance(node, dict)
            if clash:
                break
        if not clash and names[-1] not in node:
            node[names[-1]] = T.ArrayType(T.StringType()) if f.kind.name == "array" else spark_type(f.kind)
            paths.add(f.path)

    def build(node: dict) -> T.StructType:
        return T.StructType([T.StructField(k, build(v) if isinstance(v, dict) else v) for k, v in node.items()])

    return (build(tree) if paths else None), paths


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def assemble(parts: dict[str, Column]) -> Column:
    """A struct of dotted paths."""
    tree: dict = {}
    for path, c in parts.items():
        node, names = tree, path.split(".")
        for name in names[:-1]:
            node = node.setdefault(name, {})
            if not isinstance(node, dict):
                raise ValueError(f"{path!r} runs through a value")
        node[names[-1]] = c

    def build(node: dict) -> Column:
        return F.named_struct(*[x for k, v in node.items() for x in (F.lit(k), build(v) if isinstance(v, dict) else v)])

    return build(tree)


def apply_mapping(df: DataFrame, definition: dict | Definition, body: str | None = None, output: str = "data", error: str = "error") -> DataFrame:
    """``df`` with the struct ``output`` (null where the row failed; fields that nothing was written to are null) and the
    text ``error``. ``body``: the column that paths start from, typed or JSON text; None: the row itself.

    Columns named like ``output`` or ``error`` are replaced. An empty table gives an empty table with the same columns.
    """
    held = None
    if body is None:
        root, t = F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema
    else:
        root, t = F.col(body), df.schema[body].dataType
        schema = parse_schema(definition if isinstance(definition, Definition) else Definition.read(definition))[0]
        if isinstance(t, T.StringType) and schema is not None:
            # A column of its own, so that the text is parsed once however many fields are taken from it.
            held = "_parsed"
            while held in df.columns:
                held += "_"
            df = df.withColumn(held, F.from_json(body, schema))
    if body is None:  # paths of a row are its columns, with no struct built around them
        compiled = _RowCompiled(definition, root, t)
    else:
        compiled = Compiled(definition, root, t, F.col(held) if held else None)
    data = assemble(compiled.columns) if compiled.columns else F.struct()
    if compiled.error is None:
        out = df.withColumns({output: data, error: F.lit(None).cast("string")})
    else:
        out = df.withColumns({error: compiled.error}).withColumn(output, F.when(F.col(error).isNull(), data))
    return out.drop(held) if held else out


class _RowCompiled(Compiled):
    """Paths start from the row's columns."""

    def _extract(self, f: Field, col: Column, t: T.DataType) -> Value:
        if col is self.body and f.path:
            head, *rest = f.path.replace("[", ".[").split(".")
            names = t.fieldNames()
            name = head if head in names else next((n for n in names if n.lower() == head.lower()), None)
            if name is not None:
                tail = ".".join(rest).replace(".[", "[")
                return super()._extract(replace(f, path=tail), F.col(f"`{name}`"), t[name].dataType)
        return super()._extract(f, col, t)


def latest_definitions(definitions: DataFrame) -> DataFrame:
    """The newest active version of each (tenant_id, id); deleted and inactive ones don't count."""
    live = definitions.where("deleted_at is null and is_active")
    rest = [c for c in live.columns if c not in ("tenant_id", "id")]
    return live.groupBy("tenant_id", "id").agg(F.max_by(F.struct(*rest), "version").alias("_x")).select("tenant_id", "id", "_x.*")

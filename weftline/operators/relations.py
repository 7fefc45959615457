"""Relationships: staging (direct, embedded, by criteria), late resolution of their ends, and golden edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.criteria import comparable, matches
from weftline.operators.pairs import meet
from weftline.operators.ranges import counted, stabbed
from weftline.plans.storage import Spill


def edge_id(*parts: Column | str) -> Column:
    """A stable id of a natural key."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")).cast("string") for p in parts]), 256)


def parse_relationship(data: Column, schema_type: Column, integration: Column) -> dict[str, Column]:
    """Columns of a standalone relationship message (``data``: map of texts); properties are the keys without underscore.

    ``valid`` is false where the type, an entity type or an id is missing; such messages are skipped.
    """
    at = lambda n: F.when(F.try_element_at(data, F.lit(n)) != "", F.try_element_at(data, F.lit(n)))
    out = {
        "relationship_type": F.coalesce(at("_relationship_type"), schema_type),
        "from_entity_type": at("_from_entity_type"),
        "from_source_id": at("_from_source_id"),
        "from_integration": F.coalesce(at("_from_integration"), integration),
        "to_entity_type": at("_to_entity_type"),
        "to_source_id": at("_to_source_id"),
        "to_integration": F.coalesce(at("_to_integration"), integration),
        "to_criteria": at("_to_criteria"),
        "properties": F.map_filter(data, lambda k, v: ~k.startswith("_")),
    }
    need = ("relationship_type", "from_entity_type", "from_source_id", "to_entity_type")
    valid = F.coalesce(out["to_source_id"], out["to_criteria"]).isNotNull()
    for n in need:
        valid = valid & out[n].isNotNull()
    return out | {"valid": valid}


def embedded_relationships(messages: DataFrame, relationships: str = "relationships") -> DataFrame:
    """One row for each embedded relationship: from the message's own entity to (to_entity_type, to_source_id)."""
    rows = messages.select("tenant_id", F.col("entity_type").alias("from_entity_type"), F.col("source_id").alias("from_source_id"), "integration", F.explode(relationships).alias("r"))
    own = [F.col("r.data").alias("properties")] if "data" in rows.schema["r"].dataType.fieldNames() else []
    return rows.select("tenant_id", F.col("r.type").alias("relationship_type"), "from_entity_type", "from_source_id", F.col("integration").alias("from_integration"), F.col("r.to_entity_type").alias("to_entity_type"), F.col("r.to_source_id").alias("to_source_id"), F.col("integration").alias("to_integration"), *own)


NATURAL = ["tenant_id", "relationship_type", "from_entity_type", "from_source_id", "from_integration", "to_entity_type", "to_source_id", "to_integration"]


def _merged(properties: str, order: list[str]) -> Column:
    """Aggregate: maps of texts in one, later keys over earlier ones by ``order`` (then by content), null values left out."""
    entries = F.array_sort(F.collect_set(F.struct(*[F.col(c) for c in order], F.to_json(properties).alias("_j"))))
    maps = F.transform(F.filter(entries, lambda e: e["_j"].isNotNull()), lambda e: F.from_json(e["_j"], "map<string,string>"))
    whole = F.aggregate(maps, F.create_map().cast("map<string,string>"), lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, v: ~F.map_contains_key(m, k)), m))
    return F.map_filter(whole, lambda k, v: v.isNotNull())


def stage(edges: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Edges once for each natural key, with their id. If there is a column properties (map of texts), those of a key are merged:
    later ones (by the columns ``order``) over earlier ones, without nulls."""
    if "properties" not in edges.columns:
        return edges.select(NATURAL).distinct().withColumn("id", edge_id(*NATURAL))
    return edges.groupBy(NATURAL).agg(_merged("properties", order or []).alias("properties")).withColumn("id", edge_id(*NATURAL))


def resolve_ends(edges: DataFrame, entities: DataFrame, scope: bool = True) -> DataFrame:
    """Edges with from_entity_id and to_entity_id, null where an end isn't there yet; one row for each matching pair of ends.

    ``entities``: (tenant_id, entity_type, source_id, integration, entity_id). ``scope``: integrations must agree. The order
    in which edges and entities arrived doesn't matter.
    """
    out = edges
    for side in ("from", "to"):
        on = ["tenant_id", f"{side}_entity_type", f"{side}_source_id"] + ([f"{side}_integration"] if scope else [])
        e = entities.select("tenant_id", F.col("entity_type").alias(f"{side}_entity_type"), F.col("source_id").alias(f"{side}_source_id"), F.col("integration").alias(f"{side}_integration"), F.col("entity_id").alias(f"{side}_entity_id"))
        e = e if scope else e.drop(f"{side}_integration")
        out = out.join(e, on, "left")
    return out


def pending(edges: DataFrame) -> DataFrame:
    """Resolved edges of which an end is still missing."""
    return edges.where("from_entity_id is null or to_entity_id is null")


def criteria_edges(criteria: list[dict], entities: DataFrame, data: str = "data") -> DataFrame:
    """(criteria_id, relationship_type, from_entity_id, to_entity_id): stored criteria against entities, in either order of arrival.

    criteria: {id, tenant_id, relationship_type, from_entity_id, to_entity_type, to_integration?, criteria}. Criteria of the same
    predicate and scope share one pass: their entities are found once and joined to all of their sources.
    """
    spark = entities.sparkSession
    groups: dict[tuple, list[dict]] = {}
    for c in criteria:
        groups.setdefault((c["tenant_id"], c["to_entity_type"], c.get("to_integration"), repr(sorted(c["criteria"].items(), key=str))), []).append(c)
    tests = []
    for n, ((tenant, kind, integration, _), own) in enumerate(groups.items()):
        test = (F.col("tenant_id") == tenant) & (F.col("entity_type") == kind) & matches(F.col(data), own[0]["criteria"])
        if integration:
            test = test & (F.col("integration") == integration)
        tests.append(F.when(F.coalesce(test, F.lit(False)), n))
    rows = [(n, c["id"], c["relationship_type"], c["from_entity_id"]) for n, own in enumerate(groups.values()) for c in own]
    sources = spark.createDataFrame(rows, "g int, criteria_id string, relationship_type string, from_entity_id string")
    found = entities.select(F.col("entity_id").alias("to_entity_id"), F.explode(F.array_compact(F.array(*tests)) if tests else F.array().cast("array<int>")).alias("g"))
    # The rules were given as a driver-side list, so their number is known and small.
    return found.join(F.broadcast(sources), "g").where(F.col("from_entity_id") != F.col("to_entity_id").cast("string")).select("criteria_id", "relationship_type", "from_entity_id", "to_entity_id")


def _conditions(criteria: Column) -> Column:
    """The array of (path, op, x) that a criteria object in JSON text asks for; x is text, or JSON where it's no text."""
    one = lambda path, op, x: F.struct(path.alias("path"), op.alias("op"), x.alias("x"))
    operators = lambda e: F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda o: one(e["key"], o["key"], o["value"]))
    is_operator = lambda e: F.coalesce(e["value"].rlike(r'^\{\s*"\$'), F.lit(False))
    listed = F.transform(F.map_entries(F.from_json(criteria, "map<string,string>")), lambda e: F.when(is_operator(e), operators(e)).otherwise(F.array(one(e["key"], F.lit("$eq"), e["value"]))))
    return F.flatten(listed)


def _holds(v: Column, c: Column) -> Column:
    """Whether condition ``c`` (path, op, x) holds for the value ``v`` at its path; an unknown operator never does."""
    op, x = c["op"], c["x"]
    number, limit = v.try_cast("double"), x.try_cast("double")
    among = lambda items, y: F.exists(F.from_json(items, "array<string>"), lambda i: F.coalesce(comparable(i) == comparable(y), F.lit(False)))
    equal = F.when(x.isNull(), v.isNull()).otherwise(comparable(v) == comparable(x))
    inside = F.when(v.startswith("["), among(v, x)).otherwise(v.contains(x))
    test = F.when(op == "$eq", equal).when(op == "$ne", ~F.coalesce(equal, F.lit(False))).when(op == "$in", among(x, v))
    test = test.when(op == "$contains", inside).when(op == "$exists", F.when(x == "true", v.isNotNull()).otherwise(v.isNull()))
    test = test.when(op == "$gt", number > limit).when(op == "$gte", number >= limit).when(op == "$lt", number < limit).when(op == "$lte", number <= limit)
    return F.coalesce(test, F.lit(False))


#: Operators of ranges: whether they bound from below, and whether the bound itself is outside.
RANGES = {"$gt": (True, True), "$gte": (True, False), "$lt": (False, True), "$lte": (False, False)}


def _range_of(conditions: Column) -> Column:
    """(bounds, path, lo, lo_open, hi, hi_open) of one path of ``conditions`` that has ranges, one with both bounds if there is; null
    if there is none."""
    is_range = lambda c: c["op"].isin(list(RANGES))

    def along(path: Column) -> Column:
        bound = lambda ops, sign: F.array_max(F.transform(F.filter(conditions, lambda c: (c["path"] == path) & c["op"].isin(ops)), lambda c: F.struct((c["x"].try_cast("double") * sign).alias("v"), (c["op"].isin(["$gt", "$lt"])).alias("open"))))
        lo, hi = bound(["$gt", "$gte"], 1.0), bound(["$lt", "$lte"], -1.0)
        both = lo.isNotNull().cast("int") + hi.isNotNull().cast("int")
        return F.struct(both.alias("bounds"), path.alias("path"), lo["v"].alias("lo"), lo["open"].alias("lo_open"), (-hi["v"]).alias("hi"), hi["open"].alias("hi_open"))

    return F.array_max(F.transform(F.array_distinct(F.transform(F.filter(conditions, is_range), lambda c: c["path"])), along))


def _rules(criteria: DataFrame) -> DataFrame:
    """``criteria`` with their conditions _c, and what they are found by: _first, an equality or list, and _range."""
    rules = criteria.withColumn("_c", _conditions(F.col("criteria"))).drop("criteria")
    # A bound that is no number is never met.
    rules = rules.where(~F.exists("_c", lambda c: c["op"].isin(list(RANGES)) & c["x"].try_cast("double").isNull()))
    choices = F.filter("_c", lambda c: (c["op"] == "$in") | ((c["op"] == "$eq") & c["x"].isNotNull()))
    return rules.withColumns({"_first": F.get(choices, F.lit(0)), "_range": _range_of(F.col("_c"))})


def stored_criteria_edges(criteria: DataFrame, entities: DataFrame, data: str = "data") -> DataFrame:
    """criteria_edges for a table of criteria, of any number: (criteria_id, relationship_type, from_entity_id, to_entity_id).

    ``criteria``: (criteria_id, tenant_id, relationship_type, from_entity_id, to_entity_type, to_integration or null, criteria:
    JSON text). A criterion that asks for equality, or for one of a list, meets only the entities that have one of these values at
    that path (an equi-join). One that has ranges instead meets those whose number is in the range of one of its paths (an interval
    index, operators/ranges.py). Only one that has neither ($ne, $exists, $contains, or nothing) meets all entities of its type. All
    conditions are tested afterwards. Paths are keys joined by dots. Either table may be new.
    """
    rules = _rules(criteria)
    at = lambda p: F.call_function("get_json_object", F.col(data), F.concat(F.lit("$."), p))
    ent = entities.select("tenant_id", F.col("entity_type").alias("to_entity_type"), "integration", F.col("entity_id").alias("to_entity_id"), data)
    scope = ["tenant_id", "to_entity_type"]
    about = ["criteria_id", "relationship_type", "from_entity_id", "to_integration", "_c"]
    columns = [*scope, "integration", "to_entity_id", data, *about]

    def along(own: DataFrame) -> DataFrame:
        # Few: the paths that criteria of a type are anchored at. Spark broadcasts them if their measured size is small.
        return ent.join(own.select(*scope, "_path").distinct(), scope).withColumn("_value", at(F.col("_path"))).where("_value is not null")

    values = F.when(F.col("_first.op") == "$in", F.from_json("_first.x", "array<string>")).otherwise(F.array("_first.x"))
    equal = rules.where("_first is not null").withColumn("_path", F.col("_first.path"))
    equal = equal.withColumn("_value", F.explode(F.array_distinct(F.transform(values, comparable)))).where("_value is not null")
    found = along(equal).withColumn("_value", comparable(F.col("_value"))).join(equal.select(*scope, "_path", "_value", *about), [*scope, "_path", "_value"]).select(columns)
    # Whether there are rules of the other kinds is looked up, so a plan has no join that nobody needs.
    ranged = rules.where("_first is null and _range is not null")
    if not ranged.isEmpty():
        ranged = ranged.select(*scope, F.col("_range.path").alias("_path"), *[f"_range.{c}" for c in ("lo", "lo_open", "hi", "hi_open")], *about)
        numbers = along(ranged).withColumn("x", F.col("_value").try_cast("double")).where("x is not null").drop("_value")
        found = found.unionByName(stabbed(ranged, numbers, [*scope, "_path"]).select(columns))
    rest = rules.where("_first is null and _range is null")
    if not rest.isEmpty():
        found = found.unionByName(ent.join(rest.select(*scope, *about), scope).select(columns))
    both = found.where(F.col("to_integration").isNull() | (F.col("to_integration") == F.col("integration")))
    both = both.where(F.forall("_c", lambda c: _holds(at(c["path"]), c)) & (F.col("from_entity_id") != F.col("to_entity_id").cast("string")))
    return both.select("criteria_id", "relationship_type", "from_entity_id", "to_entity_id")


def stored_criteria_counts(criteria: DataFrame, entities: DataFrame, data: str = "data") -> DataFrame:
    """(to_entity_id, n): how many edges of stored_criteria_edges lead to each entity that has any, without these edges.

    Criteria that read the same and entities that hold the same are folded with their numbers. Ranges are counted at the nodes of the
    interval index, apart by what else their criteria ask for, so rows follow the different conditions beside a range and not the
    criteria that an entity meets.
    """
    scope = ["tenant_id", "to_entity_type"]
    named = criteria.where("from_entity_id is not null").groupBy(*scope, "to_integration", "from_entity_id", "criteria").agg(F.count("*").alias("n"))
    named = Spill(named, "named").df
    rules = Spill(_rules(named.groupBy(*scope, "to_integration", "criteria").agg(F.sum("n").alias("n"))), "rules").df
    at = lambda p: F.call_function("get_json_object", F.col(data), F.concat(F.lit("$."), p))
    ent = entities.select("tenant_id", F.col("entity_type").alias("to_entity_type"), "integration", F.col("entity_id").alias("to_entity_id"), data).where("to_entity_id is not null")
    kinds = Spill(ent.select(*scope, "integration", data).distinct(), "kinds").df
    about = ["to_integration", "_c"]
    of_kind = [*scope, "integration", data]
    columns = [*of_kind, *about, "n"]

    def along(own: DataFrame) -> DataFrame:
        return kinds.join(own.select(*scope, "_path").distinct(), scope).withColumn("_value", at(F.col("_path"))).where("_value is not null")

    def met(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        return meet(x, y, keys, data).select(*[f"x.{c}" for c in of_kind], *[f"y.{c}" for c in (*about, "n")])

    values = F.when(F.col("_first.op") == "$in", F.from_json("_first.x", "array<string>")).otherwise(F.array("_first.x"))
    equal = rules.where("_first is not null").withColumn("_path", F.col("_first.path"))
    equal = equal.withColumn("_value", F.explode(F.array_distinct(F.transform(values, comparable)))).where("_value is not null")
    found = met(along(equal).withColumn("_value", comparable(F.col("_value"))), equal, [*scope, "_path", "_value"])
    ranged = rules.where("_first is null and _range is not null")
    if not ranged.isEmpty():
        # A range of the index says all that the conditions it was made of do.
        ranged = ranged.withColumns({"_path": F.col("_range.path"), "_c": F.filter("_c", lambda c: ~((c["path"] == F.col("_range.path")) & c["op"].isin(list(RANGES))))})
        ranged = ranged.select(*scope, "_path", *[f"_range.{c}" for c in ("lo", "lo_open", "hi", "hi_open")], *about, "n")
        numbers = along(ranged).withColumn("x", F.col("_value").try_cast("double")).where("x is not null").drop("_value")
        sums = Spill(counted(ranged, numbers, [*scope, "_path"], about, "n"), "sums").df
        found = found.unionByName(met(numbers, sums, [*scope, "_path", "x"]))
    rest = rules.where("_first is null and _range is null")
    if not rest.isEmpty():
        found = found.unionByName(met(kinds, rest, scope))
    holds = (F.col("to_integration").isNull() | (F.col("to_integration") == F.col("integration"))) & F.forall("_c", lambda c: _holds(at(c["path"]), c))
    sums = found.where(holds).groupBy(*of_kind).agg(F.sum("n").alias("n"))
    on = (F.col("e.integration").eqNullSafe(F.col("s.integration"))) & (F.col(f"e.{data}").eqNullSafe(F.col(f"s.{data}")))
    for c in scope:
        on = on & (F.col(f"e.{c}") == F.col(f"s.{c}"))
    every = ent.alias("e").join(sums.alias("s"), on).select(F.col("e.to_entity_id"), "s.n")
    # An entity's own criteria don't lead to itself.
    own = ent.withColumn("from_entity_id", F.col("to_entity_id").cast("string")).join(_rules(named), [*scope, "from_entity_id"])
    every = every.unionByName(own.where(holds).select("to_entity_id", (-F.col("n")).alias("n")))
    return every.groupBy("to_entity_id").agg(F.sum("n").alias("n")).where("n > 0")


#: How many edges of a type an entity may have on its from and its to side; None: any number.
CARDINALITY = {"one_to_one": (1, 1), "one_to_many": (None, 1), "many_to_one": (1, None), "many_to_many": (None, None)}


def cardinality_violations(edges: DataFrame, types: DataFrame) -> DataFrame:
    """(relationship_type, side, entity_id, n): ends that have more different partners than their type allows.

    ``edges``: (relationship_type, from_id, to_id), ``types``: (relationship_type, cardinality), joined by type; types that aren't
    listed, and unknown cardinalities, allow any number.
    """
    known = edges.select("relationship_type", "from_id", "to_id").distinct().join(types.select("relationship_type", "cardinality"), "relationship_type")
    parts = []
    for n, side in enumerate(("from", "to")):
        single = known.where(F.col("cardinality").isin([k for k, v in CARDINALITY.items() if v[n] == 1]))
        parts.append(single.groupBy("relationship_type", F.lit(side).alias("side"), F.col(f"{side}_id").alias("entity_id")).agg(F.count("*").alias("n")).where("n > 1"))
    return parts[0].unionByName(parts[1])


def golden_edges(resolved: DataFrame, membership: DataFrame) -> DataFrame:
    """(relationship_type, from_id, to_id, source_count): distinct edges between clusters; membership: (entity_id, cluster_id).

    With a column properties, also the properties of an edge's sources, merged by their ids (if there are) and without nulls."""
    m = membership.select("entity_id", "cluster_id")
    out = resolved.join(m.select(F.col("entity_id").alias("from_entity_id"), F.col("cluster_id").alias("from_id")), "from_entity_id")
    out = out.join(m.select(F.col("entity_id").alias("to_entity_id"), F.col("cluster_id").alias("to_id")), "to_entity_id")
    own = [_merged("properties", ["id"] if "id" in out.columns else []).alias("properties")] if "properties" in out.columns else []
    return out.groupBy("relationship_type", "from_id", "to_id").agg(F.count("*").alias("source_count"), *own)

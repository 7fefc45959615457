"""Golden records: clusters of matched records, and per-field merge strategies as aggregate functions.

Every strategy folds before the shuffle except those that must keep all values (collect_all, conflicts). Ties that the
definition leaves open go by (updated_at, id).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import connected_components

ALIASES = {"source_priority": "most_trusted", "prefer_source": "most_trusted", "last": "most_recent", "longest_value": "longest"}


@dataclass(frozen=True)
class FieldRule:
    field: str
    strategy: str = "prefer_non_empty"
    max_items: int = 0
    dedup: bool = True


def _priority(integration: Column, priorities: dict[str, int]) -> Column:
    if not priorities:
        return F.lit(0)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in priorities.items() for x in kv])[integration], F.lit(0))


def merged_value(rule: FieldRule, dtype: str, priorities: dict[str, int] | None = None, updated: str = "updated_at", tie: str = "id", integration: str = "integration") -> Column:
    """Aggregate column of a field's strategy over its non-null values. Unknown strategies are prefer_non_empty."""
    v, s = F.col(f"`{rule.field}`"), ALIASES.get(rule.strategy, rule.strategy)
    t, i = F.col(updated), F.col(tie)
    numeric = dtype in ("double", "float", "int", "bigint", "smallint", "tinyint") or dtype.startswith("decimal")
    order = lambda *c: F.when(v.isNotNull(), F.struct(*c))
    text = F.to_json(v) if dtype.startswith(("array", "map", "struct")) else v.cast("string")
    latest_last = (t, i)
    if s == "most_recent":
        return F.max_by(v, order(*latest_last))
    if s == "first":
        return F.min_by(v, order(*latest_last))
    if s == "most_trusted":
        return F.min_by(v, order((-_priority(F.col(integration), priorities or {})).alias("p"), t, i))
    if s == "longest":
        return F.min_by(v, order((-F.octet_length(text)).alias("n"), t, i))
    if s == "shortest":
        return F.min_by(v, F.when(v.isNotNull() & (text != ""), F.struct(F.octet_length(text).alias("n"), t, i)))
    if s in ("max", "min", "average", "sum"):
        x = v if numeric else F.lit(None).cast("double")
        return {"max": F.max, "min": F.min, "average": F.avg}[s](x) if s != "sum" else F.coalesce(F.sum(x.cast("double")), F.lit(0.0))
    if s == "collect_all":
        # Per element: where it came first; sorted by that, cut after dedup.
        own = v if dtype.startswith("array") else F.array(v)
        listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(t.alias("t"), i.alias("i"), own.alias("v"))))), lambda e: e["v"]))
        listed = F.array_distinct(listed) if rule.dedup else listed
        return F.slice(listed, 1, rule.max_items) if rule.max_items else listed
    empty = F.coalesce(F.size(v) <= 0, F.lit(False)) if dtype.startswith(("array", "map")) else F.coalesce(text == "", F.lit(False))
    return F.min_by(v, order(empty.alias("e"), t, i))


def golden_records(members: DataFrame, rules: list[FieldRule], cluster: str = "cluster_id", priorities: dict[str, int] | None = None, updated: str = "updated_at", tie: str = "id", integration: str = "integration") -> DataFrame:
    """(cluster, fields..., source_count): one aggregation over all fields."""
    types = dict(members.dtypes)
    cols = [merged_value(r, types[r.field], priorities, updated, tie, integration).alias(r.field) for r in rules]
    return members.groupBy(cluster).agg(*cols, F.count("*").alias("source_count"))


def conflicts(members: DataFrame, rules: list[FieldRule], cluster: str = "cluster_id", **kw) -> DataFrame:
    """(cluster, field, values, integrations, resolution, resolved_value) for fields with two or more different text forms."""
    types = dict(members.dtypes)
    tie, integration = kw.get("tie", "id"), kw.get("integration", "integration")
    out = None
    for r in rules:
        text = F.to_json(f"`{r.field}`") if types[r.field].startswith(("array", "map", "struct")) else F.col(f"`{r.field}`").cast("string")
        pairs = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(F.col(tie).alias("o"), text.alias("v"), F.col(integration).alias("i")))))
        got = merged_value(r, types[r.field], **kw)
        got = F.to_json(got) if types[r.field].startswith(("array", "map", "struct")) or r.strategy == "collect_all" else got.cast("string")
        part = members.groupBy(cluster).agg(F.count_distinct(text).alias("_n"), pairs.alias("_p"), got.alias("resolved_value")).where("_n > 1")
        part = part.select(cluster, F.lit(r.field).alias("field"), F.transform("_p", lambda e: e["v"]).alias("values"), F.transform("_p", lambda e: e["i"]).alias("integrations"), F.lit(r.strategy).alias("resolution"), "resolved_value")
        out = part if out is None else out.unionByName(part)
    return out


def cluster_records(records: DataFrame, matches: DataFrame, id_col: str = "id", min_score: float = 0.5) -> DataFrame:
    """``records`` with cluster_id: the smallest id reachable over unblocked matches (a, b, score, blocked) of min_score.

    A veto is of a pair alone: a vetoed pair may still share a cluster through a third record. Ids are longs. Records
    without matches are clusters of one.
    """
    edges = matches.where((F.col("score") >= min_score) & ~F.col("blocked"))
    parts = connected_components(edges, "a", "b").select(F.col("node").alias(id_col), F.col("component").alias("cluster_id"))
    return records.join(parts, id_col, "left").withColumn("cluster_id", F.coalesce("cluster_id", F.col(id_col).cast("long")))


def survivors(members: DataFrame, cluster: str = "cluster_id", created: str = "created_at", tie: str = "id") -> DataFrame:
    """(cluster, survivor): the oldest member."""
    return members.groupBy(cluster).agg(F.min_by(tie, F.struct(created, tie)).alias("survivor"))


def stripped_concat(old: Column, new: Column) -> Column:
    """Right-biased concat of two maps without null values."""
    joined = F.map_from_entries(F.concat(F.map_entries(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))), F.map_entries(new)))
    return F.map_filter(joined, lambda k, v: v.isNotNull())


def golden_events(before: DataFrame, after: DataFrame, key: str = "cluster_id", content: str = "fingerprint") -> DataFrame:
    """(key, event_type): created, updated, deleted, from two snapshots of golden records; unchanged ones give no event."""
    b, a = before.select(F.col(key), F.col(content).alias("_b"), F.lit(True).alias("_in")), after.select(F.col(key), F.col(content).alias("_a"), F.lit(True).alias("_out"))
    both = b.join(a, key, "full_outer")
    kind = F.when(F.col("_in").isNull(), "entity.created").when(F.col("_out").isNull(), "entity.deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "entity.updated")
    return both.select(key, kind.alias("event_type")).where("event_type is not null")


def merged_golden(members: DataFrame, golden: DataFrame, cluster: str = "cluster_id", golden_id: str = "golden_id", created: str = "created_at") -> DataFrame:
    """(cluster, golden_id, survivor): the golden records that the members of a cluster had, and the oldest of them, which stays.

    ``members``: (id, cluster, golden_id or null). Clusters only ever grow: all members of one golden record are in one cluster.
    Ties of age go to the smaller id.
    """
    held = members.where(F.col(golden_id).isNotNull()).select(cluster, golden_id).distinct().join(golden.select(golden_id, created), golden_id)
    first = held.groupBy(cluster).agg(F.min_by(golden_id, F.struct(created, golden_id)).alias("survivor"))
    return held.select(cluster, golden_id).join(first, cluster)


def consolidate(members: DataFrame, golden: DataFrame, edges: DataFrame, cluster: str = "cluster_id", golden_id: str = "golden_id", created: str = "created_at") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, golden, edges) after clusters grew together; see merged_golden.

    Members take the survivor as their golden_id; those of a cluster that had none take the cluster's id. Golden records get
    ``merged_into`` (null: it stays); one that took in another record or a new member has its version raised by one. Clusters that
    had none aren't added here: their records are built anew. Edges (type, from_id, to_id) are moved to the survivors, each once;
    those whose ends fell together go (an edge from a record to itself stays).
    """
    moved = merged_golden(members, golden, cluster, golden_id, created)
    named = members.join(moved.select(cluster, "survivor").distinct(), cluster, "left")
    out = named.withColumn(golden_id, F.coalesce("survivor", F.col(cluster).cast(members.schema[golden_id].dataType))).drop("survivor").select(members.columns)
    grown = named.where(F.col(golden_id).isNull() | (F.col(golden_id) != F.col("survivor"))).select(F.col("survivor").alias(golden_id)).distinct().withColumn("_grown", F.lit(1))
    gone = moved.where(F.col(golden_id) != F.col("survivor")).select(golden_id, F.col("survivor").alias("merged_into"))
    left = golden.join(grown, golden_id, "left").join(gone, golden_id, "left")
    left = left.withColumn("version", F.col("version") + F.coalesce("_grown", F.lit(0))).select(*golden.columns, "merged_into")
    ends = edges.withColumn("_loop", F.col("from_id") == F.col("to_id"))
    for side in ("from_id", "to_id"):
        ends = ends.join(gone.select(F.col(golden_id).alias(side), F.col("merged_into").alias(f"_{side}")), side, "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
    out_edges = ends.where(F.col("_loop") | (F.col("from_id") != F.col("to_id"))).select(edges.columns).distinct()
    return out, left, out_edges


def audit_log(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, action, field, old_value, new_value): created, updated and deleted rows of two snapshots, an update for each field
    that changed (texts); created and deleted rows have one entry without a field."""
    side = lambda df, name: df.select(key, F.struct(*[F.col(f"`{f}`").cast("string").alias(f) for f in fields]).alias(name))
    both = side(before, "_b").join(side(after, "_a"), key, "full_outer")
    entry = lambda action, field, old, new: F.struct(F.lit(action).alias("action"), F.lit(field).cast("string").alias("field"), old.alias("old_value"), new.alias("new_value"))
    none = F.lit(None).cast("string")
    changed = F.filter(F.array(*[F.when(~F.col("_b")[f].eqNullSafe(F.col("_a")[f]), entry("updated", f, F.col("_b")[f], F.col("_a")[f])) for f in fields]), lambda e: e.isNotNull())
    whole = F.when(F.col("_b").isNull(), F.array(entry("created", None, none, none))).when(F.col("_a").isNull(), F.array(entry("deleted", None, none, none))).otherwise(changed)
    return both.select(key, F.explode(whole).alias("_e")).select(key, "_e.*")

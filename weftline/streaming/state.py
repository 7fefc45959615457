"""Keyed state in a store (RocksDB) for what micro-batch tables can't tell a stream: whole records after each change, and edges whose
ends turn up at any time, or never.

Both run in processing time and have no watermark: a row is never dropped for being late. Order is decided by the rows' own order columns,
so the results don't depend on arrival. State can be bounded by a time to live; without one nothing is forgotten.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weftline.operators.relations import edge_id

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TEXT = T.StructType([T.StructField("x", T.StringType())])


def use_state_store(spark: SparkSession) -> None:
    """Queries started from now on keep their state in RocksDB, which map state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # A join's four tables in one store, and commits that write what has changed.
    spark.conf.set("spark.sql.streaming.join.stateFormatVersion", "3")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _mode(*bounds: int | None) -> str:
    """Clocks run only where something expires: with them a stream has micro-batches without data."""
    return "None" if all(b is None for b in bounds) else "ProcessingTime"


# -- records ------------------------------------------------------------------------------------------------------------


class MergedRecord(StatefulProcessor):
    """Fields of a key with their last values and the orders of these; the order and kind of the last change; the number of changes."""

    def __init__(self, key: list[str], order: list[T.StructField], ttl_ms: int | None):
        self.key, self.order, self.ttl = key, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        names = [f.name for f in self.order]
        value = T.StructType([T.StructField("value", T.StringType()), *self.order])
        whole = T.StructType([T.StructField("n", T.LongType()), T.StructField("deleted", T.BooleanType()), *self.order])
        self.fields = handle.getMapState("fields", TEXT, value, self.ttl)
        self.last = handle.getValueState("last", whole, self.ttl)
        self.names = names

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, deleted, at = 0, False, None
        if self.last.exists():
            n, deleted, *before = self.last.get()
            at = tuple(before)
        new: dict[str, tuple] = {}
        for row in rows:
            field, order = row["change_field"], tuple(row[c] for c in self.names)
            if field is None:  # the marker row of a change
                n += 1
                # Of a delete and an upsert in the same place of the order the delete stands.
                if at is None or (order, row["change_gone"]) > (at, deleted):
                    at, deleted = order, row["change_gone"]
            elif field not in new or order >= new[field][1:]:
                new[field] = (row["change_value"], *order)
        merged = {k[0]: v for k, v in self.fields.iterator()}
        for field, v in new.items():
            if field not in merged or v[1:] >= tuple(merged[field][1:]):
                self.fields.updateValue((field,), v)
                merged[field] = v
        self.last.update((n, deleted, *at))
        data = "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{'null' if v[0] is None else v[0]}" for k, v in sorted(merged.items())) + "}"
        yield Row(*self.key, "data", "n_changes", "deleted", *[f"last_{c}" for c in self.names])(*key, data, n, deleted, *at)

    def close(self) -> None:
        pass


def merged_records(changes: DataFrame, key: list[str], order: list[str], data: str = "data", action: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """A stream of (key..., data, n_changes, deleted, last_order...): each key's record after every micro-batch that changes it.

    A record is the shallow merge of its JSON objects; a field keeps its last value by ``order``. Rows whose ``action`` is
    "delete" mark the record as deleted; a change after that (by ``order``) revives it with the fields that it had. Keys and orders
    must not be null. ``ttl_ms``: fields and records that didn't change for so long are forgotten.
    """
    gone = F.coalesce(F.col(action) == "delete", F.lit(False)) if action else F.lit(False)
    # One pass: a change gives a marker row and a row for each field, so the source is read and parsed once a batch.
    fields = F.transform(F.map_entries(F.from_json(data, "map<string,variant>")), lambda e: F.struct(e["key"].alias("f"), F.to_json(e["value"]).alias("v")))
    marker = F.array(F.struct(F.lit(None).cast("string").alias("f"), F.lit(None).cast("string").alias("v")))
    own = F.when(gone, marker).otherwise(F.concat(marker, F.coalesce(fields, F.array().cast("array<struct<f:string,v:string>>"))))
    rows = changes.select(*key, *order, gone.alias("change_gone"), F.explode(own).alias("_x")).select(*key, *order, "change_gone", F.col("_x.f").alias("change_field"), F.col("_x.v").alias("change_value"))
    types = {f.name: f.dataType for f in changes.schema}
    schema = T.StructType([T.StructField(k, types[k]) for k in key] + [T.StructField("data", T.StringType()), T.StructField("n_changes", T.LongType()), T.StructField("deleted", T.BooleanType())] + [T.StructField(f"last_{c}", types[c]) for c in order])
    processor = MergedRecord(key, [T.StructField(c, types[c]) for c in order], ttl_ms)
    return rows.groupBy(*key).transformWithState(processor, schema, "append", _mode(ttl_ms))


def latest_records(history: DataFrame, key: list[str]) -> DataFrame:
    """The last state of each key of what merged_records has written, deleted ones among them."""
    rest = [c for c in history.columns if c not in key]
    last = history.groupBy(*key).agg(F.max_by(F.struct(*rest), "n_changes").alias("_x"))
    return last.select(*key, *[F.col(f"_x.{c}").alias(c) for c in rest])


# -- edges --------------------------------------------------------------------------------------------------------------


IDS = T.ArrayType(T.StringType())
END, PAIR = Row("edge_id", "side", "entity_id"), Row("edge_id", "from_entity_id", "to_entity_id", "status")


class EndsOfEntity(StatefulProcessor):
    """Under the natural key of an entity: the ids it has, and the ends of edges that name it."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        end = T.StructType([T.StructField("edge_id", T.StringType()), T.StructField("side", T.StringType())])
        self.entities = handle.getValueState("entities", T.StructType([T.StructField("ids", IDS)]), self.ttl)
        self.ends = handle.getMapState("ends", end, TEXT, self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ids, ends = set(), set()
        for row in rows:
            if row["entity_id"] is None:
                ends.add((row["edge_id"], row["side"]))
            else:
                ids.add(row["entity_id"])
        held = self.entities.get()
        known = set(held[0]) if held else set()
        ids -= known
        # An end that comes again comes out again; what it is part of has seen it before.
        for e in sorted(ends):
            yield from (END(*e, i) for i in (None, *sorted(known | ids)))
        if ids:
            self.entities.update((sorted(known | ids),))
            for e, _ in self.ends.iterator():  # read through: what waits for an entity isn't held in memory
                if tuple(e) not in ends:
                    yield from (END(*e, i) for i in sorted(ids))
        for e in ends:
            self.ends.updateValue(e, ("",))

    def close(self) -> None:
        pass


class PairsOfEdge(StatefulProcessor):
    """Under an edge: the entities found at either end. A pair comes out once, when its second end is found."""

    def __init__(self, ttl_ms: int | None, remind_ms: int | None):
        self.ttl, self.remind = ttl_ms, remind_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.found = handle.getValueState("found", T.StructType([T.StructField("from", IDS), T.StructField("to", IDS)]), self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.found.get()
        old = {s: set(x) for s, x in zip(("from", "to"), held or ((), ()), strict=True)}
        new: dict[str, set] = {"from": set(), "to": set()}
        for row in rows:
            if row["entity_id"] is not None and row["entity_id"] not in old[row["side"]]:
                new[row["side"]].add(row["entity_id"])
        if held is None or new["from"] or new["to"]:
            self.found.update(tuple(sorted(old[s] | new[s]) for s in ("from", "to")))
        if held is None and self.remind is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.remind)
        pairs = [(f, t) for f in new["from"] for t in old["to"] | new["to"]] + [(f, t) for f in old["from"] for t in new["to"]]
        yield from (PAIR(key[0], f, t, "resolved") for f, t in sorted(pairs))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        some = [min(x, default=None) for x in self.found.get() or ((), ())]
        if None in some:
            yield PAIR(key[0], *some, "pending")

    def close(self) -> None:
        pass


def _joined_edges(named: DataFrame, entities: DataFrame, key: list[str], salts: int) -> DataFrame:
    """resolved_edges without clocks: each edge once, joined with the entities of its first and then of its second end. Nulls meet nothing."""
    # What is kept is keys: sixteen bytes of a hash for an end, an edge's id as bytes.
    of = lambda cols: F.unhex(F.substring(F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in cols])), 256), 1, 32))
    ends = {s: [c if c == "tenant_id" else f"{s}_{c}" for c in key] for s in ("from", "to")}
    out = named.dropna(subset=sorted({*ends["from"], *ends["to"]})).select(F.unhex("edge_id").alias("edge"), *[of(c).alias(f"_{s}") for s, c in ends.items()])
    out = out.dropDuplicates(["edge"]).withColumn("salt", F.pmod(F.xxhash64("edge"), F.lit(salts)).cast("int"))
    there = entities.dropna(subset=[*key, "entity_id"]).select(of(key).alias("end"), F.col("entity_id").cast("string").alias("entity_id"))
    there = there.dropDuplicates(["end", "entity_id"]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    for side in ("from", "to"):
        own = there.select(F.col("end").alias("_end"), "_salt", F.col("entity_id").alias(f"{side}_entity_id"))
        rest = [c for c in out.columns if c != f"_{side}"]
        out = out.join(own, (F.col(f"_{side}") == F.col("_end")) & (F.col("salt") == F.col("_salt"))).select(*rest, f"{side}_entity_id")
    return out.select(F.lower(F.hex("edge")).alias("edge_id"), "from_entity_id", "to_entity_id", F.lit("resolved").alias("status"))


def resolved_edges(edges: DataFrame, entities: DataFrame, scope: bool = True, salts: int = 4, ttl_ms: int | None = None, remind_ms: int | None = None) -> DataFrame:
    """A stream of (edge_id, from_entity_id, to_entity_id, status) over streams of edges and entities, whichever comes first.

    ``edges`` have the natural key of relations.stage, ``entities`` (tenant_id, entity_type, source_id, integration, entity_id); with
    ``scope`` integrations must agree. An edge waits for its ends without a bound (or for ``ttl_ms`` since they last changed); every
    pair of ends comes out once, with status "resolved", so all micro-batches together equal relations.resolve_ends over all rows.
    ``remind_ms`` after an edge came, it is reported once with status "pending" if an end is still missing. Edges and entities
    may repeat; rows with a null in an end's key stay unresolved.

    The ends of an entity that very many edges name are dealt to ``salts`` keys, each of which has the entity. Where nothing expires and
    nobody is reminded, two stream-stream joins do the same in the JVM, with the state store's own operators.
    """
    natural = ["tenant_id", "relationship_type", "from_entity_type", "from_source_id", "from_integration", "to_entity_type", "to_source_id", "to_integration"]
    key = ["tenant_id", "entity_type", "source_id", *(["integration"] if scope else [])]
    named = edges.select(*natural, edge_id(*natural).alias("edge_id"))
    if ttl_ms is None and remind_ms is None:
        return _joined_edges(named, entities, key, salts)
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), *[F.col(f"{s}_{c}" if c != "tenant_id" else c).alias(c) for c in key]) for s in ("from", "to")])).alias("_e")
    ends = named.select("edge_id", sides).select("edge_id", "_e.*")
    # An end whose key isn't whole can't be named by an entity; it waits under its own edge.
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    ends = ends.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in key], F.when(whole, F.pmod(F.xxhash64("edge_id"), F.lit(salts)).cast("string")).otherwise(F.concat(F.lit("!"), "edge_id")).alias("salt"), "edge_id", "side", F.lit(None).cast("string").alias("entity_id"))
    there = entities.where(" and ".join(f"{c} is not null" for c in [*key, "entity_id"]))
    there = there.select(*[F.col(c).cast("string").alias(c) for c in key], F.explode(F.array(*[F.lit(str(i)) for i in range(salts)])).alias("salt"), F.lit(None).cast("string").alias("edge_id"), F.lit(None).cast("string").alias("side"), F.col("entity_id").cast("string").alias("entity_id"))
    found = ends.unionByName(there).groupBy(*key, "salt").transformWithState(EndsOfEntity(ttl_ms), "edge_id string, side string, entity_id string", "append", _mode(ttl_ms))
    return found.groupBy("edge_id").transformWithState(PairsOfEdge(ttl_ms, remind_ms), "edge_id string, from_entity_id string, to_entity_id string, status string", "append", _mode(ttl_ms, remind_ms))


def start_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes a stream's rows to a Parquet table, each micro-batch once. Sets the state store.

    With ``available_now`` the stream ends when its input is read; what expires then is seen with the next input.
    """
    spark, key = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    use_state_store(spark)
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if not available_now:
        return writer.start()
    before = spark.conf.get(key)
    spark.conf.set(key, "false")  # a query takes the settings of its start along
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)

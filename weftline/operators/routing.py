"""Routing messages to mappings, splitting batches, and telling errors and kinds of messages apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.paths import MARK, UNMARK, marked_numbers

#: Rows of a bindings table up to which it is broadcast; larger ones are joined by shuffle on the tenant.
BROADCAST_BINDINGS = 20_000


def binding_score(m: str = "m", b: str = "b") -> Column:
    """The score of binding ``b`` for message ``m``, null if it doesn't match.

    Integration equal (only if the message has one); plan keys +10, status list +5, status range +2, step path prefix +5,
    URL part +5, base 1. A filter that isn't set neither tests nor scores.
    """
    return _score(lambda n: F.col(f"{m}.{n}"), lambda n: F.col(f"{b}.filter.{n}"))


def _score(c: Callable[[str], Column], f: Callable[[str], Column]) -> Column:
    """binding_score over the columns ``c`` of a message and ``f`` of a filter."""
    listed = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    text = lambda x: F.coalesce(x, F.lit("")) != ""
    lo, hi = F.coalesce(f("min_status_code"), F.lit(0)), F.coalesce(f("max_status_code"), F.lit(0))
    ranged = (lo > 0) | (hi > 0)
    status = F.coalesce(c("status_code"), F.lit(0))
    rules = [
        (listed(f("keys")), F.coalesce(F.array_contains(f("keys"), c("plan_key")), F.lit(False)), 10),
        (listed(f("status_codes")), F.coalesce(F.array_contains(f("status_codes"), status), F.lit(False)), 5),
        (ranged, ((lo == 0) | (status >= lo)) & ((hi == 0) | (status <= hi)), 2),
        (text(f("step_path_prefix")), F.coalesce(c("step_path").startswith(f("step_path_prefix")), F.lit(False)), 5),
        (text(f("request_url_contains")), F.coalesce(c("request_url").contains(f("request_url_contains")), F.lit(False)), 5),
    ]
    ok = ~text(c("integration")) | F.coalesce(c("integration") == f("integration"), F.lit(False))
    score = F.lit(1)
    for given, holds, points in rules:
        ok = ok & (~given | holds)
        score = score + F.when(given, points).otherwise(0)
    return F.when(ok, score)


def _best_binding(messages: DataFrame, live: DataFrame, order: str, small: bool) -> DataFrame:
    """Each message row with the best of its tenant's bindings: these come as one array, so rows are told apart by being rows."""
    b = live.select("tenant_id", F.struct(F.col(order).alias("ord"), F.col("id").alias("binding_id"), "mapping_id", "output_topic", "filter").alias("b"))
    by_tenant = b.groupBy("tenant_id").agg(F.collect_list("b").alias("_bindings"))
    own = (F.broadcast(by_tenant) if small else by_tenant).alias("b")
    joined = messages.alias("m").join(own, F.col("m.tenant_id") == F.col("b.tenant_id"))
    scored = F.transform("_bindings", lambda x: F.struct((-_score(lambda n: F.col(f"m.{n}"), lambda n: x["filter"][n])).alias("s"), x["ord"].alias("ord"), x["binding_id"].alias("binding_id"), x["mapping_id"].alias("mapping_id"), x["output_topic"].alias("output_topic")))
    best = F.array_min(F.filter(scored, lambda x: x["s"].isNotNull()))
    out = joined.select("m.*", best.alias("_best")).where("_best is not null")
    return out.select("*", "_best.binding_id", "_best.mapping_id", "_best.output_topic", (-F.col("_best.s")).alias("score")).drop("_best")


def match_bindings(messages: DataFrame, bindings: DataFrame, first: bool = False, id_col: str = "message_id") -> DataFrame:
    """Each message with each enabled binding of its tenant that matches: all columns of the message, binding_id, mapping_id,
    output_topic and score. ``first``: only the best score of each message row, ties to the binding of the lower ``ord`` (or id);
    ids of messages may be null or repeat (``id_col`` is no longer needed).

    Bindings are a small dimension; up to BROADCAST_BINDINGS rows, which is counted, they are broadcast.
    """
    live = bindings.where("is_enabled")
    order = "ord" if "ord" in bindings.columns else "id"
    small = live.limit(BROADCAST_BINDINGS + 1).count() <= BROADCAST_BINDINGS
    if first:
        return _best_binding(messages, live, order, small)
    right = (F.broadcast(live) if small else live).alias("b")
    joined = messages.alias("m").join(right, F.col("m.tenant_id") == F.col("b.tenant_id"))
    out = joined.withColumn("score", binding_score()).where("score is not null")
    return out.select("m.*", F.col("b.id").alias("binding_id"), F.col("b.mapping_id"), F.col("b.output_topic"), "score")


def explode_pages(messages: DataFrame, body: str = "response_body", step_path: str = "step_path") -> DataFrame:
    """One message for each element of an array body, its step path with [i] added; an empty array gives none.

    ``body`` is an array column, or JSON text of which arrays, however deep, are split and all else stays as it is written, but
    texts, which lose their quotes; a text that looks like an array isn't one. Text that begins like an array and isn't JSON gives
    none. All of it is built-in functions: the outer two levels are exploded, deeper ones are unfolded inside their row.
    """
    if dict(messages.dtypes)[body].startswith("array"):
        rows = messages.select(*[c for c in messages.columns if c not in (body, step_path)], step_path, F.posexplode(body).alias("_i", body))
        return rows.withColumn(step_path, F.concat(step_path, F.lit("["), F.col("_i").cast("string"), F.lit("]"))).select(messages.columns)
    listed = F.coalesce(F.ltrim(body).startswith("["), F.lit(False))
    out = messages.withColumns({"_page": listed, "_list": listed, body: F.when(listed, marked_numbers(F.col(body))).otherwise(F.col(body)), step_path: F.coalesce(step_path, F.lit(""))})
    for _ in range(2):
        out = out.withColumn("_x", F.explode(_page_items(F.struct(F.col(step_path).alias("p"), F.col(body).alias("b"), F.col("_list").alias("list")))))
        out = out.withColumns({step_path: F.col("_x.p"), body: F.col("_x.b"), "_list": F.col("_x.list")}).drop("_x")
    whole = F.array(F.struct(F.col(step_path).alias("p"), F.col(body).alias("b"), F.col("_list").alias("list")))
    # As many rounds as there are brackets are enough; what is no array any more passes through.
    brackets = F.length(body) - F.length(F.replace(F.col(body), F.lit("["), F.lit("")))
    deep = F.aggregate(F.sequence(F.lit(1), brackets), whole, lambda acc, _: F.when(F.exists(acc, lambda x: x["list"]), F.flatten(F.transform(acc, _page_items))).otherwise(acc))
    out = out.withColumn("_x", F.explode(F.when(F.col("_list"), deep).otherwise(whole)))
    return out.withColumns({step_path: F.col("_x.p"), body: F.when(F.col("_page"), _unmarked(F.col("_x.b"))).otherwise(F.col("_x.b"))}).select(messages.columns)


def _unmarked(c: Column) -> Column:
    return F.regexp_replace(c, f'"?{MARK}([^{UNMARK}]*+){UNMARK}"?', "$1")


def _page_items(x: Column) -> Column:
    """The elements of the JSON array of ``x`` (p: path, b: text, list: whether it is an array) as such structs, or ``x`` alone."""
    texts = F.from_json(x["b"], "array<string>")
    # from_json takes the quotes off texts, so the kind of an element is asked elsewhere; in a page that no variant can hold (one with
    # a repeated key) it is told by the text.
    kinds = F.try_parse_json(x["b"]).cast("array<variant>")

    def item(text: Column, i: Column) -> Column:
        looks = text.startswith("[") & F.from_json(text, "array<string>").isNotNull()
        listed = F.coalesce(F.schema_of_variant(F.get(kinds, i)).startswith("ARRAY"), looks, F.lit(False))
        return F.struct(F.concat(x["p"], F.lit("["), i.cast("string"), F.lit("]")).alias("p"), F.coalesce(text, F.lit("null")).alias("b"), listed.alias("list"))

    return F.when(x["list"], F.coalesce(F.transform(texts, item), F.array().cast("array<struct<p:string,b:string,list:boolean>>"))).otherwise(F.array(x))


def explode_records(mapped: DataFrame, data: str = "data") -> DataFrame:
    """Mapped rows whose data holds arrays of entity or relationship objects become one row for each object; others stay.

    An array counts if its elements are structs with a field _entity_type or _relationship_type and none of them is null in
    all elements. The result has the columns but ``data`` and ``record``, JSON text.
    """
    t = mapped.schema[data].dataType
    arrays = []
    for f in t.fields:
        inner = getattr(f.dataType, "elementType", None)
        names = inner.fieldNames() if hasattr(inner, "fieldNames") else []
        marks = [n for n in ("_entity_type", "_relationship_type") if n in names]
        if marks:
            arrays.append(_typed_items(F.col(data)[f.name], marks))
    rest = [c for c in mapped.columns if c != data]
    whole = F.array(F.to_json(data))
    if not arrays:
        return mapped.select(*rest, F.to_json(data).alias("record"))
    empty = F.array().cast("array<string>")
    found = F.concat(*[F.coalesce(a, empty) for a in arrays])
    return mapped.select(*rest, F.explode(F.when(F.size(found) > 0, found).otherwise(whole)).alias("record"))


def _typed_items(c: Column, marks: list[str]) -> Column:
    typed = F.forall(c, lambda x: F.coalesce(*[x[n] for n in marks]).isNotNull())
    return F.when(typed & (F.size(c) > 0), F.transform(c, lambda x: F.to_json(x)))


def split_errors(mapped: DataFrame, error: str = "error", stage: str = "execute_mapping") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters): dead letters carry ``error_stage`` beside their error."""
    return mapped.where(F.col(error).isNull()).drop(error), mapped.where(F.col(error).isNotNull()).withColumn("error_stage", F.lit(stage))


def dead_letters(df: DataFrame, stages: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters) by several stages: ``stages`` names them in order, each with the error it gives (null: none).

    Dead letters carry ``error_stage`` and ``error`` of the first stage that failed.
    """
    first = F.coalesce(*[F.when(error.isNotNull(), F.struct(F.lit(name).alias("stage"), error.cast("string").alias("error"))) for name, error in stages.items()])
    marked = df.withColumn("_dead", first)
    dead = marked.where(F.col("_dead").isNotNull()).withColumns({"error_stage": F.col("_dead.stage"), "error": F.col("_dead.error")}).drop("_dead")
    return marked.where(F.col("_dead").isNull()).drop("_dead"), dead


def replay_dead_letters(dead: DataFrame, max_attempts: int = 3, attempts: str = "attempts") -> tuple[DataFrame, DataFrame]:
    """(messages to send again, exhausted dead letters): a message is sent again, its count of ``attempts`` raised and its error
    taken off, until it has failed ``max_attempts`` times. No count, or a null one, is a first failure."""
    before = F.coalesce(F.col(attempts), F.lit(1)) if attempts in dead.columns else F.lit(1)
    counted = dead.withColumn(attempts, before)
    again = counted.where(F.col(attempts) < max_attempts).withColumn(attempts, F.col(attempts) + 1).drop("error", "error_stage")
    return again, counted.where(F.col(attempts) >= max_attempts)


def split_lifecycle(messages: DataFrame, kind: str = "type") -> tuple[DataFrame, DataFrame]:
    """(lifecycle events, other messages): events have a type that begins with "execution."."""
    event = F.coalesce(F.col(kind).startswith("execution."), F.lit(False))
    return messages.where(event), messages.where(~event)


def classify(data: Column, target_type: Column, target_entity: Column, action: Column, binding_id: Column, key: Column, source_integration: Column) -> dict[str, Column]:
    """message_class (delete, relationship, entity), entity_type, source_id and integration of a mapped message.

    ``data`` is a map of texts. A target schema decides first; then keys with an underscore, then bare ones; a source id
    falls back to "binding:key".
    """
    at = lambda n: F.when(F.try_element_at(data, F.lit(n)) != "", F.try_element_at(data, F.lit(n)))
    has = lambda n: F.coalesce(F.map_contains_key(data, n), F.lit(False))
    marked = has("_relationship_type") | has("_from_entity_type") | has("_to_entity_type")
    cls = (
        F.when(action == "delete", "delete")
        .when(target_type.isNotNull(), F.when(target_type == "relationship", "relationship").when(target_type == "entity", "entity").otherwise("other"))
        .when(marked, "relationship")
        .otherwise("entity")
    )
    return {
        "message_class": cls,
        "entity_type": F.coalesce(target_entity, at("_entity_type"), at("entity_type"), F.lit("")),
        "source_id": F.coalesce(at("_source_id"), at("source_id"), F.concat(binding_id, F.lit(":"), key), key),
        "integration": F.coalesce(at("_integration"), at("integration"), source_integration, F.lit("")),
    }

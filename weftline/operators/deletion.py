"""Deletion policies, their precedence, and the cascade from records to clusters to edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.ranges import locate
from weftline.plans.storage import Spill


def applicable(policies: DataFrame, scopes: DataFrame) -> DataFrame:
    """The policy of each scope (tenant_id, entity_type, integration, source_key): of enabled ones whose integration and source
    key are unset or equal, the most specific, then the highest priority, then the oldest."""
    p, s = policies.where("enabled").alias("p"), scopes.alias("s")
    on = (F.col("p.tenant_id") == F.col("s.tenant_id")) & (F.col("p.entity_type") == F.col("s.entity_type"))
    for c in ("integration", "source_key"):
        on = on & (F.col(f"p.{c}").isNull() | (F.col(f"p.{c}") == F.col(f"s.{c}")))
    specific = F.col("p.integration").isNotNull().cast("int") + F.col("p.source_key").isNotNull().cast("int")
    by = Window.partitionBy("s.tenant_id", "s.entity_type", "s.integration", "s.source_key").orderBy(specific.desc(), F.col("p.priority").desc(), F.col("p.created_at"), F.col("p.id"))
    out = s.join(p, on).withColumn("_n", F.row_number().over(by)).where("_n = 1")
    return out.select("s.*", F.col("p.id").alias("policy_id"), F.col("p.strategy_type"), F.col("p.config"))


def not_seen(records: DataFrame, execution_id: str, status: str = "completed", column: str = "execution_id", null_counts: bool = False) -> DataFrame:
    """Records that run ``execution_id`` didn't send. A failed run deletes nothing. A null execution is kept out, as in SQL,
    unless ``null_counts``."""
    if status == "failed":
        return records.where(F.lit(False))
    c = F.col(column)
    return records.where(~c.eqNullSafe(F.lit(execution_id)) if null_counts else c != execution_id)


def completed_runs(events: DataFrame, scope: list[str], kind: str = "type", run: str = "execution_id", ts: str = "ts") -> DataFrame:
    """(scope..., last_run, last_at): the last run of each scope that an event execution.completed reports; failed ones don't count."""
    done = events.where(F.col(kind) == "execution.completed").where(F.col(run).isNotNull())
    return done.groupBy(*scope).agg(F.max_by(run, F.struct(ts, run)).alias("last_run"), F.max(ts).alias("last_at"))


def unseen_by_last_run(records: DataFrame, runs: DataFrame, scope: list[str], run: str = "execution_id", updated: str = "updated_at") -> DataFrame:
    """``records`` that the last completed run of their scope didn't send (completed_runs). What was written after its end, by a
    run that is still going, stays; a null execution stays, as in not_seen."""
    joined = records.join(runs.select(*scope, "last_run", "last_at"), scope)
    return joined.where((F.col(run) != F.col("last_run")) & (F.col(updated) <= F.col("last_at"))).select(records.columns)


def too_old(now: Column, max_age_days: float, check_field: str = "updated_at") -> Column:
    """staleness and retention: ``check_field`` more than max_age_days before ``now``."""
    return F.coalesce(F.col(check_field) < F.timestamp_micros(F.unix_micros(now) - int(max_age_days * 86_400_000_000)), F.lit(False))


def composite(parts: list[Column], operator: str = "OR") -> Column:
    """Parts joined by OR or AND."""
    out = parts[0]
    for p in parts[1:]:
        out = out & p if operator.upper() == "AND" else out | p
    return out


def policy_predicate(strategy: dict, now: Column) -> Column:
    """Which records a staleness, retention, explicit or composite strategy {strategy_type, config} deletes."""
    kind, config = strategy["strategy_type"], strategy.get("config") or {}
    if kind in ("staleness", "retention"):
        default = "updated_at" if kind == "staleness" else "created_at"
        out = too_old(now, float(config.get("max_age_days", config.get("retention_days", 0))), config.get("check_field", default))
        return out & (F.col("integration") == config["integration"]) if config.get("integration") else out
    if kind == "composite":
        return composite([policy_predicate(s, now) for s in config["strategies"]], config.get("operator", "OR"))
    return F.lit(False)  # explicit: only delete messages act; execution_based needs the run, see not_seen


def _standing(records: DataFrame, messages: DataFrame, key: list[str], written: str, at: str) -> DataFrame:
    """``records`` with _at, the time of their key's last delete message, and _gone, whether it stands."""
    gone = messages.where("action = 'delete'").groupBy(*key).agg(F.max(at).alias("_at"), F.max(F.col(at).isNull()).alias("_always"))
    stands = F.col("_always") | (F.col("_at") >= F.col(written)) | (F.col(written).isNull() & F.col("_at").isNotNull())
    return records.join(gone, key, "left").withColumn("_gone", F.coalesce(stands, F.lit(False)))


def mark_deleted(records: DataFrame, messages: DataFrame, key: list[str], written: str = "updated_at", at: str = "ts") -> DataFrame:
    """``records`` with deleted_at: the time (``at``) of the last delete message of their key; null if there is none, or if the record was
    ``written`` after it: what is sent again comes back. Of equal times, and where the record has no time, the delete stands; a delete
    without a time stands against all (deleted_at is then the record's own time). Null keys match nothing."""
    out = _standing(records, messages, key, written, at).withColumn("deleted_at", F.when(F.col("_gone"), F.coalesce("_at", written)))
    return out.select(*[c for c in records.columns if c != "deleted_at"], "deleted_at")


def apply_deletes(records: DataFrame, messages: DataFrame, key: list[str], written: str | None = None, at: str | None = None) -> DataFrame:
    """Records without those that a delete message names; with ``written`` and ``at`` (times of records and messages) only those that
    were written before the delete (see mark_deleted)."""
    if written is None or at is None:
        return records.join(messages.where("action = 'delete'").select(key).distinct(), key, "left_anti")
    return _standing(records, messages, key, written, at).where("not _gone").select(records.columns)


def cascade(members: DataFrame, golden: DataFrame, edges: DataFrame, deleted: DataFrame, id_col: str = "id", cluster: str = "cluster_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, golden, edges) left when the records ``deleted`` go: clusters without members go, and edges with an end gone."""
    left = members.join(deleted.select(id_col).distinct(), id_col, "left_anti")
    alive = left.select(cluster).distinct()
    golden_left = golden.join(alive, cluster, "left_semi")
    ends = edges
    for side in ("from_id", "to_id"):
        ends = ends.join(alive.select(F.col(cluster).alias(side)), side, "left_semi")
    return left, golden_left, ends.select(edges.columns)


def due_deletions(pending: DataFrame, now: Column) -> DataFrame:
    """Scheduled deletions whose time has come and that weren't cancelled."""
    return pending.where((F.col("due_at") <= now) & F.col("cancelled_at").isNull())


def scheduled_deletions(sightings: DataFrame, runs: DataFrame, scope: list[str], grace_seconds: float, now: Column, id_col: str = "id", run: str = "execution_id", at: str = "ts", done: str = "completed_at") -> DataFrame:
    """(scope..., id, last_seen, status, missed_at, scheduled_for, deleted_at) of every record at the time ``now``.

    A completed run schedules the deletion of the records of its scope that it didn't send, ``grace_seconds`` after its end; each
    further run without the record puts it off again, unless it is due by then; a record that is seen again is cancelled, or revived.
    So a record goes by the runs after its last sighting: ``missed_at`` is the end of the first of them that wasn't the run that saw
    it, ``scheduled_for`` the time that holds now, ``deleted_at`` when it came; status is live, pending or deleted.

    ``sightings`` (scope..., id, execution_id, ts): a row each time a record came, in any order; ``runs`` (scope..., execution_id,
    completed_at): completed ones only. What lies after ``now`` doesn't count. Rows without a time or an id are left out.

    Records find the run after their last sighting by their place among the ends of runs (ranges.locate), so neither a scope's records
    nor those of one moment have to fit into one task; only the ends of runs are put in order by scope.
    """
    us, grace = F.unix_micros, int(grace_seconds * 1_000_000)
    time = lambda c: us(F.col(c).cast("timestamp"))
    until = us(now.cast("timestamp"))
    seen = sightings.where(F.col(id_col).isNotNull() & (time(at) <= until))
    last = seen.groupBy(*scope, id_col).agg(F.max(F.struct(time(at).alias("x"), F.col(run).alias("run"))).alias("_l")).select(*scope, id_col, "_l.x", F.col("_l.run").alias("_run"))
    once = runs.where(time(done) <= until).groupBy(*scope, F.col(run).cast("string").alias("_run")).agg(F.max(time(done)).alias("x"))
    ends = once.groupBy(*scope, "x").agg(F.count("*").alias("_runs"))
    points, placed = locate(ends.select(*scope, "x"), last, scope)
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    own = points.alias("p").join(ends.alias("e"), same("p", "e", [*scope, "x"])).select("p.*", "e._runs")
    order = Window.partitionBy(*scope).orderBy("rank")
    own = own.withColumns({"_before": F.lag("x").over(order), "_after": F.lead("x").over(order), "_top": F.max("x").over(Window.partitionBy(*scope))})
    # Of the moments when a deletion that is still scheduled becomes due, the first from this run on.
    fires = F.when(F.col("_after").isNull() | (F.col("_after") - F.col("x") >= grace), F.col("x") + grace)
    own = own.withColumn("_due", F.first(fires, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    own = own.withColumn("_next", F.lead(F.struct("x", "_due")).over(order))
    own = Spill(own, "runs").df
    after = placed.withColumn("rank", F.expr("(segment + 1) div 2 + 1")).withColumn("_run", F.col("_run").cast("string"))
    joined = after.alias("a").join(own.alias("r"), same("a", "r", [*scope, "rank"]), "left")
    # The run that saw the record last may end after the sighting; a moment when it alone ends is none for the record.
    alone = once.alias("o").join(own.where("_runs = 1").alias("r"), same("o", "r", [*scope, "x"])).select(*[F.col(f"o.{c}") for c in scope], "o._run", "r.x", "r._before", "r._after")
    joined = joined.join(alone.alias("o"), [*same("a", "o", scope), F.col("a._run") == F.col("o._run")], "left")
    start = F.when(F.col("r.x") == F.col("o.x"), F.col("r._next")).otherwise(F.when(F.col("r.x").isNotNull(), F.struct("r.x", "r._due")))
    # Later on, the run before it waits for the one after it.
    between = F.col("o.x") > F.col("r.x")
    sooner = between & (F.col("r._due") >= F.col("o.x") + grace) & (F.col("o._after").isNull() | (F.col("o._after") - F.col("o._before") >= grace))
    due = F.when(sooner, F.col("o._before") + grace).otherwise(start["_due"])
    top = F.when(between & F.col("o._after").isNull(), F.col("o._before")).otherwise(F.col("r._top"))
    first = F.when(start.isNotNull(), F.struct(start["x"].alias("x"), due.alias("_due")))
    out = joined.select(*[F.col(f"a.{c}") for c in [*scope, id_col]], F.col("a.x").alias("_seen"), first.alias("_f"), top.alias("_top"))
    deleted = F.when(F.col("_f._due") <= until, F.col("_f._due"))
    moment = lambda c: F.timestamp_micros(c)
    status = F.when(F.col("_f").isNull(), "live").when(deleted.isNotNull(), "deleted").otherwise("pending")
    scheduled = F.when(F.col("_f").isNotNull(), F.coalesce(deleted, F.col("_top") + grace))
    return out.select(*scope, id_col, moment(F.col("_seen")).alias("last_seen"), status.alias("status"), moment(F.col("_f.x")).alias("missed_at"), moment(scheduled).alias("scheduled_for"), moment(deleted).alias("deleted_at"))

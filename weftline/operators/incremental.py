"""Clusters and matches that grow by increments: an increment reads what it touches and writes what changes.

State lies in folders of Parquet parts, one part an increment, and the highest part that is marked as done is what readers see: an
increment that fails leaves nothing behind, and one that is run again overwrites its own part. ``compact`` folds the parts.

Clusters: every record has the label of its cluster, every label its size and smallest member. New matches are contracted to edges
between labels, components of these few edges say which clusters grow together, and the largest of them keeps its label, so a record
changes its label at most log2(records) times however clusters grow.

Matches: records of the same facts are one class. A record has its class, a class its facts and postings (rule, blocking key) -> class,
bucketed by key. The postings of classes that an increment brings in are joined with the buckets of their keys only. How two classes match
depends on their facts alone, so it is found once and stays; which records are meant is what their last rows say. A class stays when its
last record leaves it, and is there again without any work when one comes back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.similarity import jaccard
from weftline.operators.components import connected_components
from weftline.operators.matching import TOP, Rule, best_of, build_index, frequencies, kept, pair_score, postings
from weftline.operators.pairs import CHUNK, expand, meet, tasks
from weftline.plans.storage import Spill, delete_path, finished_parts

BUCKETS = 64
MEMBERS, HEADS = "node long, label long, v long", "label long, size long, smallest long, gone boolean, v long"
PAIRS = "a binary, b binary, score double, rule string, blocked boolean, auto_merge boolean, v long"


# -- parts --------------------------------------------------------------------------------------------------------------


def last_version(spark: SparkSession, path: str) -> int:
    """The last increment that was done; 0 before the first."""
    return max(finished_parts(spark, f"{path}/done"), default=0)


def _read(spark: SparkSession, path: str, kind: str, schema: str | T.StructType, upto: int, buckets: list[int] | None = None, bucketed: bool = False) -> DataFrame:
    """The rows of all parts up to ``upto``; of the given buckets only, if there are."""
    parts = [n for n in finished_parts(spark, f"{path}/{kind}") if n <= upto]
    own = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not parts:
        return spark.createDataFrame([], own)
    full = T.StructType([*own.fields, T.StructField("bucket", T.IntegerType())]) if bucketed else own
    rows = spark.read.schema(full).option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/part={n}" for n in parts])
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    return rows.select(own.fieldNames())


def _write(df: DataFrame, path: str, kind: str, n: int, bucketed: str | None = None, buckets: int = BUCKETS) -> None:
    if bucketed:
        df = df.withColumn("bucket", _bucket(bucketed, buckets))
        # One file a bucket and task at most, and rows of a bucket from few tasks.
        df.repartition(F.col("bucket"), F.pmod(F.xxhash64(*[c for c in df.columns if c != "bucket"][:2]), F.lit(4))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{kind}/part={n}")
    else:
        df.write.mode("overwrite").parquet(f"{path}/{kind}/part={n}")


def _bucket(key: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _done(spark: SparkSession, path: str, n: int) -> None:
    spark.range(0).write.mode("overwrite").parquet(f"{path}/done/part={n}")


def _last(rows: DataFrame, key: list[str]) -> DataFrame:
    """The row of the highest v of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "v").alias("_x")).select(*key, *[F.col(f"_x.{c}").alias(c) for c in rest])


def compact(spark: SparkSession, path: str, tables: dict[str, list[str]]) -> int:
    """Folds the parts of each table (name -> key) to one that holds the last row of each key; returns its number. Bucketed tables
    stay bucketed. Readers that began before may have to begin again."""
    n = last_version(spark, path)
    for kind, key in tables.items():
        parts = [p for p in finished_parts(spark, f"{path}/{kind}") if p <= n]
        if len(parts) < 2:
            continue
        rows = _last(spark.read.option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/part={p}" for p in parts]).drop("part"), key)
        held = Spill(rows, "compact")
        writer = held.df.repartition("bucket").write.mode("overwrite").partitionBy("bucket") if "bucket" in rows.columns else held.df.write.mode("overwrite")
        writer.parquet(f"{path}/{kind}/part={n}")
        for p in parts:
            if p != n:
                delete_path(spark, f"{path}/{kind}/part={p}")
        held.drop()
    return n


# -- clusters -----------------------------------------------------------------------------------------------------------

CLUSTER_TABLES = {"members": ["node"], "heads": ["label"]}


def grown_clusters(members: DataFrame, heads: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members (node, label), heads (label, size, smallest, gone)): the rows that change when ``edges`` (a, b) come to the clusters.

    ``members`` (node, label, v), ``heads`` (label, size, smallest, gone, v): of a node's or label's rows the one of the highest v counts.
    A label is the id of some member. New records get a row, and the members of every cluster but the largest of those that grow
    together; nothing else does. Edges may repeat, and name what they join already; null ends are dropped. Of the stored tables only
    the rows of touched records and labels are shuffled; the rest is filtered out where it is read.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = Spill(ends, "touched").df
    found = ends.join(_last(members.join(ends, "node", "left_semi"), ["node"]).select("node", "label"), "node", "left")
    nodes = Spill(found.select("node", F.coalesce("label", "node").alias("label"), F.col("label").isNull().alias("fresh")), "ends").df
    x = nodes.select(F.col("node").alias("a"), F.col("label").alias("la"))
    y = nodes.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = pairs.join(x, "a").join(y, "b").where("la <> lb").select("la", "lb").distinct()
    parts = connected_components(between, "la", "lb").select(F.col("node").alias("label"), F.col("component").alias("tie"))
    own = nodes.groupBy("label").agg(F.max("fresh").alias("fresh"))
    known = _last(heads.join(nodes.select("label"), "label", "left_semi"), ["label"]).where("not gone").select("label", "size", "smallest")
    labels = own.join(parts, "label", "left").join(known, "label", "left")
    labels = labels.select("label", "fresh", F.coalesce("tie", "label").alias("tie"), F.coalesce("size", F.lit(1)).cast("long").alias("size"), F.coalesce("smallest", "label").alias("smallest"))
    labels = Spill(labels, "labels").df
    ties = labels.groupBy("tie").agg(F.max_by("label", F.struct(~F.col("fresh"), "size", -F.col("label"))).alias("kept"), F.sum("size").alias("size"), F.min("smallest").alias("smallest"), F.count("*").alias("n"), F.max("fresh").alias("fresh"))
    ties = ties.where("n > 1 or fresh")
    moved = labels.join(ties.select("tie", "kept"), "tie").where("label <> kept or fresh").select("label", "kept", "fresh")
    moved = Spill(moved, "moved").df
    # New records are their own labels; of the others all members of a label that goes.
    rows = moved.where("fresh").select(F.col("label").alias("node"), F.col("kept").alias("label"))
    leaving = moved.where("not fresh").select("label", "kept")
    once = members.join(leaving, "label", "left_semi").select("node").distinct()  # some have left that label before
    there = _last(members.join(once, "node", "left_semi"), ["node"]).select("node", "label")
    rows = rows.unionByName(there.join(leaving, "label").select("node", F.col("kept").alias("label")))
    gone = moved.where("not fresh and label <> kept").select("label", F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("smallest"), F.lit(True).alias("gone"))
    return rows, ties.select(F.col("kept").alias("label"), "size", "smallest", F.lit(False).alias("gone")).unionByName(gone)


def extend_clusters(spark: SparkSession, path: str, edges: DataFrame, n: int | None = None) -> int:
    """Adds matches (a, b) to the clusters under ``path``, as increment ``n`` (the next one); returns its number."""
    before = last_version(spark, path)
    n = before + 1 if n is None else n
    upto = min(before, n - 1)
    rows, heads = grown_clusters(_read(spark, path, "members", MEMBERS, upto), _read(spark, path, "heads", HEADS, upto), edges)
    _write(rows.withColumn("v", F.lit(n).cast("long")), path, "members", n)
    _write(heads.withColumn("v", F.lit(n).cast("long")), path, "heads", n)
    _done(spark, path, n)
    return n


def _cluster_members(spark: SparkSession, path: str, upto: int) -> DataFrame:
    return _last(_read(spark, path, "members", MEMBERS, upto), ["node"])


def _cluster_heads(spark: SparkSession, path: str, upto: int) -> DataFrame:
    return _last(_read(spark, path, "heads", HEADS, upto), ["label"]).where("not gone")


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(node, component): every record that has a match, and the smallest record of its cluster."""
    upto = last_version(spark, path)
    return _cluster_members(spark, path, upto).join(_cluster_heads(spark, path, upto), "label").select("node", F.col("smallest").alias("component"))


def touched_members(spark: SparkSession, path: str, since: int) -> DataFrame:
    """(node, component) of all members of the clusters that changed after increment ``since``: what golden records have to be built
    anew from. The golden records of other clusters stand; those whose component is no longer one go."""
    upto = last_version(spark, path)
    heads = _cluster_heads(spark, path, upto).where(F.col("v") > since)
    return _cluster_members(spark, path, upto).join(heads.select("label", "smallest"), "label").select("node", F.col("smallest").alias("component"))


# -- matches ------------------------------------------------------------------------------------------------------------

MATCH_TABLES = {"records": ["id"], "classes": ["class"], "postings": ["rule", "key", "class"], "pairs": ["a", "b"]}
RECORDS, POSTINGS = "id long, class binary, gone boolean, v long", "rule int, key string, class binary, len int, v long"


def _touched(df: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets that the keys of ``df`` are in: at most ``buckets`` numbers."""
    return sorted(r.b for r in df.select(_bucket(key, buckets).alias("b")).distinct().collect())


def _class_of(facts: list[str]):
    """Sixteen bytes of a hash of all facts, nulls among them."""
    named = F.struct(*[F.col(f"`{c}`").cast("string").alias(f"f{i}") for i, c in enumerate(facts)])
    return F.unhex(F.substring(F.sha2(F.to_json(named, {"ignoreNullFields": "false"}) if facts else F.lit(""), 256), 1, 32))


def extend_matches(spark: SparkSession, path: str, records: DataFrame, rules: list[Rule], id_col: str = "id", deleted: DataFrame | None = None, n: int | None = None, buckets: int = BUCKETS) -> int:
    """Adds ``records`` to the match index under ``path``, replacing those of the same id, takes ``deleted`` (ids) out, and finds the
    pairs of the new classes; returns the increment's number.

    Ids are longs and occur once in an increment; ``rules`` and ``buckets`` must stay the same. Only the buckets of postings whose keys
    the new classes have are read, and those of the facts of found classes.
    """
    before = last_version(spark, path)
    n = before + 1 if n is None else n
    upto = min(before, n - 1)
    now = F.lit(n).cast("long")
    index = build_index(records, rules, id_col).withColumn("id", F.col("id").cast("long"))
    facts = [c for c in index.columns if c != "id"]
    index = index.withColumn("class", _class_of([c for c in facts if not c.endswith("#")]))
    own = index.select("id", "class").withColumns({"gone": F.lit(False), "v": now})
    if deleted is not None:
        out = deleted.select(F.col(id_col).cast("long").alias("id")).distinct()
        own = own.unionByName(out.select("id", F.lit(None).cast("binary").alias("class"), F.lit(True).alias("gone"), now.alias("v")))
    _write(own, path, "records", n, "id", buckets)
    came = _read(spark, path, "records", RECORDS, n, bucketed=True).where((F.col("v") == n) & ~F.col("gone"))
    classes = index.drop("id").groupBy("class").agg(*[F.first(f"`{c}`").alias(c) for c in facts]).withColumn("v", now)
    schema = classes.select(F.col("class"), *[F.col(f"`{c}`") for c in facts], "v").schema
    known = _read(spark, path, "classes", schema, upto, _touched(came, "class", buckets), True).select("class")
    _write(classes.join(known, "class", "left_anti").select(schema.fieldNames()), path, "classes", n, "class", buckets)
    fresh = _read(spark, path, "classes", schema, n, bucketed=True).where(F.col("v") == n).withColumnRenamed("class", "id")
    if upto == 0:
        _write(frequencies(fresh, rules), path, "order", n)
    order = _read(spark, path, "order", "rule int, key string, n long", 1 << 60)
    _write(postings(fresh, rules, order).select("rule", "key", F.col("id").alias("class"), "len", now.alias("v")), path, "postings", n, "key", buckets)
    new = _read(spark, path, "postings", POSTINGS, n, bucketed=True).where(F.col("v") == n)
    there = _read(spark, path, "postings", POSTINGS, n, _touched(new, "key", buckets), True)
    about = lambda rows: rows.join(_read(spark, path, "classes", schema, n, _touched(rows, "class", buckets), True).drop("v"), "class")
    # Facts travel with the postings, so two classes are judged where they meet.
    met = meet(about(new), about(there), ["rule", "key"], "class")
    # Two new classes meet on both sides; the smaller one looks for the larger, and every new one for itself.
    ok = (F.col("y.v") < n) | (F.col("x.class") <= F.col("y.class"))
    active = [r for r in rules if r.is_active and (r.blocking or r.anchor)]
    for i, c in ((i, r.anchor) for i, r in enumerate(rules) if r.is_active and r.anchor):
        near = (F.col("x.len") >= F.col("y.len") * c.threshold) & (F.col("y.len") >= F.col("x.len") * c.threshold)
        ok = ok & ((F.col("x.rule") != i) | (near & (jaccard(F.col(f"x.`{c.column}#`"), F.col(f"y.`{c.column}#`")) >= c.threshold)))
    score = pair_score(rules, lambda c: F.col(f"x.`{c}`"), lambda c: F.col(f"y.`{c}`")).alias("s")
    pairs = kept(met.where(ok).select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"), score).select("a", "b", "s.best", "s.blocked"))
    # Several rules, or trigrams of one, may find the same two.
    pairs = pairs.distinct() if len(active) > 1 or any(r.anchor for r in active) else pairs
    _write(pairs.withColumn("v", now), path, "pairs", n)
    _done(spark, path, n)
    return n


def current_pairs(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(a, b, score, rule, blocked, auto_merge): the pairs of records as they are now; what matching.score_pairs gives over all records."""
    upto, k = last_version(spark, path), tasks(spark)
    live = _last(_read(spark, path, "records", RECORDS, upto), ["id"]).where("not gone")
    many = live.groupBy("class").agg(F.ceil(F.count("*") / F.lit(chunk)).alias("k")).where("k > 1")
    dealt = live.join(many, "class", "left").select("class", "id", F.coalesce(F.pmod(F.xxhash64("id"), F.col("k")), F.lit(0)).alias("c"))
    # A class is rows of some ``chunk`` ids; those of one side meet each of the other in a task of its own.
    rows = Spill(dealt.groupBy("class", "c").agg(F.sort_array(F.collect_list("id")).alias("ids")), "members").df
    count = rows.groupBy("class").agg((F.max("c") + 1).alias("k")).where("k > 1")
    x = rows.select(F.col("class").alias("a"), F.col("c").alias("_ca"), F.col("ids").alias("_x"))
    y = rows.select(F.col("class").alias("b"), F.col("c").alias("_cb"), F.col("ids").alias("_y"))
    units = _read(spark, path, "pairs", PAIRS, upto).drop("v").join(count.select(F.col("class").alias("b"), "k"), "b", "left")
    units = units.withColumn("_cb", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("k", F.lit(1)) - 1))).drop("k").join(x, "a")
    units = units.where("a <> b or _ca <= _cb").repartition(k, "b", "_cb").join(y.repartition(k, "b", "_cb").hint("merge"), ["b", "_cb"])
    twins = (F.col("a") == F.col("b")) & (F.col("_ca") == F.col("_cb"))
    rest = ["score", "rule", "blocked", "auto_merge"]
    return expand(units.select("_x", "_y", twins.alias("_one"), *rest), "_x", "_y", F.col("_one")).select("a", "b", *rest)


def current_matches(spark: SparkSession, path: str, top: int | None = TOP) -> DataFrame:
    """What matching.find_matches gives over all records."""
    return best_of(current_pairs(spark, path), top)

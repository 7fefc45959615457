"""Merkle manifest of a dataset: a tree of SHA-256 digests for each group of rows, and one over the groups.

Leaves are ordered inside their group and dealt in blocks of WIDTH ** BLOCK_LEVELS. A block is one row that holds its leaves as
an array; its levels are collapsed by higher-order SQL functions (sequence, slice, transform, aggregate), and the roots of the
blocks are the leaves of the next round, until one node a group is left. The groups' nodes then are the leaves of a last tree.
Each round has a WIDTH ** BLOCK_LEVELS-th of the rows of the one before. On the way back a block joins the path of its root, so no
join has a key of more than one block, however large a group is, and the leaves themselves are shuffled twice, as digests.

All digests are lowercase hexadecimal text, and a node is the digest of its children's texts, concatenated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.plans.storage import Spill, shuffle_partitions

#: Children of a node, and levels that are collapsed in one block (243 leaves).
WIDTH, BLOCK_LEVELS = 3, 5
STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(columns: Sequence[Column]) -> Column:
    """The digest of a row: of each column "-" if it is null, else its length in UTF-8 bytes, ":" and its text."""
    texts = [c.cast("string") for c in columns]
    return digest(*[F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)) for x in texts])


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its path (an array of the siblings on its left and right, bottom first) lead to."""
    return F.aggregate(steps, leaf, lambda acc, s: digest(s["left"], acc, s["right"]))


def proof_digest(steps: Column) -> Column:
    """The digest of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _height(n: Column, width: int) -> Column:
    """Levels over ``n`` nodes: the powers of ``width`` below n."""
    powers = F.array(*[F.lit(width**p) for p in range(64) if width**p < 1 << 63])
    return F.size(F.filter(powers, lambda p: p < n))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b).cast("int")


def _collapse(nodes: Column, width: int) -> Column:
    """The level above ``nodes``: the digest of every ``width`` consecutive ones, the last run may be shorter."""
    runs = F.sequence(F.lit(0), _div(F.size(nodes) - 1, F.lit(width)))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * width + 1, F.lit(width)), ""), 256))


def _path(levels: Column, up: Column, i: Column, width: int) -> Column:
    """The siblings of leaf ``i`` (from 0) on the ``up`` lower ``levels`` of a block."""

    def step(level: Column) -> Column:
        own = _div(i, F.get(F.array(*[F.lit(width**p) for p in range(BLOCK_LEVELS + 1)]), level))
        first = (own - F.pmod(own, F.lit(width))).cast("int")
        nodes = F.get(levels, level)
        return F.struct(F.array_join(F.slice(nodes, first + 1, own - first), "").alias("left"), F.array_join(F.slice(nodes, own + 2, first + width - 1 - own), "").alias("right"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(BLOCK_LEVELS)), F.lit(1), up), step)


def _numbered(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``pos`` (from 0, inside the group) and ``n`` (rows of the group), ordered by ``order``, nulls first; the largest n.

    Rows are dealt by ranges of (group, order), so a large group covers many partitions; numbers inside a partition are
    Spark's increasing ids, and the counts of the partitions before are added. Nothing collects a group.
    """
    spark = rows.sparkSession
    # Written before ranges are sampled, and numbered in one written evaluation. The last key parts equal rows.
    held = Spill(rows.withColumn("_any", F.xxhash64(F.monotonically_increasing_id())), "leaves").df
    keys = [*group, *order, "_any"]
    ranged = held.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    placed = Spill(ranged.drop("_any").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ordered").df
    parts = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    most = parts.groupBy(*group).agg(F.sum("_rows").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "n": F.sum("_rows").over(whole)})
    a, b = placed.alias("a"), parts.alias("b")
    same = F.col("a._part") == F.col("b._part")
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    found = a.join(b, same)
    return found.select("a.*", (F.col("b._before") + F.col("a._at") - F.col("b._first")).alias("pos"), "b.n").drop("_part", "_at"), most


def _climb(nodes: DataFrame, most: int, group: list[str], extra: list[str], width: int, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(group, pos, hash, extra, steps, ...) of ``nodes`` (group, pos, n, hash, extra); ``most`` is the largest n.

    ``finish`` gets (group, hash) of the one node that is left of each group, and gives (group, steps, ...): what is above it.
    """
    if most <= 1:
        top = finish(nodes.select(*group, "hash"))
        rest = [c for c in top.columns if c not in [*group, "hash"]]
        same = F.lit(True)
        for g in group:
            same = same & F.col(f"x.{g}").eqNullSafe(F.col(f"y.{g}"))
        # With no group at all there is one node; else each group has one row on either side.
        return nodes.alias("x").join(top.alias("y"), same).select("x.*", *[f"y.{c}" for c in rest]) if group else nodes.crossJoin(F.broadcast(top.select(rest)))
    size = width**BLOCK_LEVELS
    item = F.struct("pos", "hash", *extra)
    rows = nodes.withColumn("_b", F.floor(F.col("pos") / F.lit(size)).cast("long")).groupBy(*group, "_b").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("n").alias("n"))
    rows = rows.withColumn("up", F.least(_height(F.col("n"), width), F.lit(BLOCK_LEVELS)))
    grown = F.aggregate(
        F.slice(F.sequence(F.lit(1), F.lit(BLOCK_LEVELS)), F.lit(1), F.col("up")),
        F.array(F.transform("items", lambda x: x["hash"])),
        lambda acc, _: F.concat(acc, F.array(_collapse(F.element_at(acc, -1), width))),
    )
    items = F.transform("items", lambda x: F.struct(x["pos"].alias("pos"), *[x[c].alias(c) for c in extra]))
    blocks = Spill(rows.withColumn("levels", grown).withColumn("items", items), "blocks").df
    roots = blocks.select(*group, F.col("_b").alias("pos"), F.ceil(F.col("n") / F.lit(size)).cast("long").alias("n"), F.element_at("levels", -1)[0].alias("hash"))
    above = _climb(roots, -(-most // size), group, [], width, finish)
    rest = [c for c in above.columns if c not in [*group, "pos", "n", "hash", "steps"]]
    same = F.col("x._b") == F.col("y.pos")
    for g in group:
        same = same & F.col(f"x.{g}").eqNullSafe(F.col(f"y.{g}"))
    joined = blocks.alias("x").join(above.alias("y"), same).select("x.*", F.col("y.steps").alias("_above"), *[f"y.{c}" for c in rest])
    own = F.transform("items", lambda x, i: F.struct(x.alias("x"), F.get(F.get("levels", F.lit(0)), i).alias("hash"), _path(F.col("levels"), F.col("up"), i, width).alias("steps")))
    out = joined.select(*group, "n", F.explode(own).alias("_x"), "_above", *rest)
    return out.select(*group, F.col("_x.x.pos").alias("pos"), "n", F.col("_x.hash").alias("hash"), *[F.col(f"_x.x.{c}").alias(c) for c in extra], F.concat("_x.steps", "_above").alias("steps"), *rest)


def merkle_manifest(rows: DataFrame, columns: Sequence[str], group: str, order: str, extra: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """(group, order, pos, leaf, subroot, root, steps, extra...), one row for each row of ``rows``.

    A leaf is the digest of ``columns`` (leaf_digest). Leaves ascend by ``order`` inside ``group``, nulls first, equal ones by
    their digest; ``pos`` counts them from 0. While a group has several nodes, every ``width`` consecutive ones become one.
    The groups' last nodes (``subroot``), null group first, then by the bytes of their text, make ``root`` in the same way.
    ``steps`` is the path of a leaf to the root: the siblings on its left and right, concatenated, level by level; fold(leaf,
    steps) gives the root. ``extra`` columns of ``rows`` are carried along. A null group is a group of its own; repeated rows are
    leaves of their own; an empty table gives an empty table; other columns are ignored. Columns may have any names.
    """
    leaf = leaf_digest([F.col(f"`{c}`") for c in columns])
    own = {f"e{i}": c for i, c in enumerate(extra)}
    base = rows.select(F.col(f"`{group}`").cast("string").alias("g"), F.col(f"`{order}`").alias("o"), leaf.alias("hash"), *[F.col(f"`{c}`").alias(n) for n, c in own.items()])
    nodes, most = _numbered(base, ["g"], ["o", "hash"])

    def over_groups(tops: DataFrame) -> DataFrame:
        def whole(last: DataFrame) -> DataFrame:
            return last.select(F.col("hash").alias("root"), F.array().cast(STEP).alias("steps"))

        subroots, groups = _numbered(tops, [], ["g"])
        return _climb(subroots, groups, [], ["g"], width, whole).select("g", F.col("hash").alias("subroot"), "root", "steps")

    done = _climb(nodes, most, ["g"], ["o", *own], width, over_groups)
    return done.select(F.col("g").alias(group), F.col("o").alias(order), "pos", F.col("hash").alias("leaf"), "subroot", "root", "steps", *[F.col(n).alias(c) for n, c in own.items()])


def verified(manifest: DataFrame, claimed: str = "leaf") -> DataFrame:
    """``manifest`` with folded_root, recomputed from the leaf in column ``claimed`` and the path, and whether it equals the root."""
    folded = manifest.withColumn("folded_root", fold(F.col(claimed), F.col("steps")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))

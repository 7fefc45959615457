import hashlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from weftline.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos string, g int"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row[:5]])


def climb(nodes, width):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + width]) for i in range(0, len(levels[-1]), width)])
    return levels


def siblings(levels, i, width):
    out = []
    for level in levels[:-1]:
        first = i // width * width
        out.append((level[first:i], level[i + 1 : first + width]))
        i //= width
    return out


def brute(rows, width):
    """Sorted (doc_id, leaf, subroot, root, path) of a plain tree."""
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    groups = [sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for _, g in groupby(sorted(rows, key=key), key=key)]
    trees = [climb([leaf(r) for r in g], width) for g in groups]
    top = climb([t[-1][0] for t in trees], width) if trees else []
    out = []
    for n, (g, t) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(g):
            path = siblings(t, i, width) + siblings(top, n, width)
            out.append((str(r[0]), leaf(r), t[-1][0], top[-1][0], [("".join(a), "".join(b)) for a, b in path]))
    return sorted(out)


def manifest(spark, rows, width=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return M.merkle_manifest(df, COLUMNS, "source", "doc_id", width=width)


def rows_of(sizes, **kw):
    return [(100 * i + k, s, "en", k, f"text\n{k} é") for i, (s, n) in enumerate(sizes) for k in range(n)]


@pytest.mark.parametrize("width", [2, 3])
def test_equals_a_plain_tree(spark, width):
    rows = rows_of([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 10), ("f", 28), ("é", 27), ("Z", 5)])
    rows += [(None, None, None, None, None), (7, None, "en", 1, ""), (None, "a", "en", 1, "-"), (3, "", "en", 1, "x"), (1, "a", "en", 1, "same"), (1, "a", "en", 1, "same"), (1, "a", "en", 1, "other")]
    got = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps]) for r in manifest(spark, rows, width).collect())
    assert got == brute(rows, width)


def test_large_group_takes_several_rounds(spark):
    rows = rows_of([("hot", 800), ("one", 1), ("few", 250)])
    got = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps]) for r in manifest(spark, rows).collect())
    assert got == brute(rows, 3)


def test_one_group_one_leaf_and_empty(spark):
    one = manifest(spark, [(1, "s", None, 2, "t")]).collect()
    assert [(r.leaf, r.subroot, r.root, r.steps, r.pos) for r in one] == [(leaf((1, "s", None, 2, "t")),) * 3 + ([], 0)]
    assert manifest(spark, []).collect() == []
    three = manifest(spark, rows_of([("s", 3)])).collect()
    assert {r.subroot for r in three} == {r.root for r in three} == {h(*[r.leaf for r in sorted(three, key=lambda r: r.pos)])}


def test_tampering_is_found(spark):
    rows = rows_of([("a", 20), ("b", 7)])
    held = manifest(spark, rows)
    assert held.count() == M.verified(held).where("verified").count() == 27
    bad = M.verified(held.withColumn("claimed", F.when(F.col("doc_id") == 5, F.lit("0" * 64)).otherwise(F.col("leaf"))), "claimed")
    assert [r.doc_id for r in bad.where("not verified").collect()] == [5]


def test_very_long_text_and_carried_columns(spark):
    text = "é" * 2_000_000
    df = spark.createDataFrame([(1, "s", "en", 1, text, "p", 4)], SCHEMA)
    row = M.merkle_manifest(df, COLUMNS, "source", "doc_id", ["g", "pos"]).select(F.col("g"), "leaf").first()
    assert (row.g, row.leaf) == (4, leaf((1, "s", "en", 1, text)))

import random

from weftline.operators.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_chain_star_and_random(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)]
    edges += [(-5, -9), (-9, 7_000_000_000)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(16)
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}


def test_empty_null_and_loops(spark):
    df = spark.createDataFrame([(None, 1), (2, 2), (3, None)], "src long, dst long")
    assert connected_components(df).collect() == []

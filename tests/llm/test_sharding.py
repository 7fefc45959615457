import zlib
from collections import defaultdict

from weftline.llm.sharding import assign_shards, rendezvous


def test_contract(spark):
    rows = [(i, None if i == 3 else "té" * (i % 7), "s", 1) for i in range(3000)] + [(None, "", "s", 1)] * 2 + [(5, "again", "s", 1)] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int").repartition(7)
    got = assign_shards(df, [1.0] * 40, [1.0] * 41).collect()
    assert len(got) == len(rows)
    slots, of = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert of.setdefault(r.doc_id, r.shard) == r.shard
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) == set(range(40))
    texts = {i: t or "" for i, t, *_ in rows[:3000]}
    for r in got:
        if r.doc_id is not None and r.doc_id != 5:
            t = texts[r.doc_id].encode()
            assert r.size == len(t) + 16 and r.text_crc32 == zlib.crc32(t)
    moved = {r.doc_id for r in got if r.grown_shard == 40}
    assert 30 < len(moved) < 130


def test_weights_and_removal(spark):
    keys = spark.range(6000)
    got = keys.select("id", rendezvous(keys.id, [1.0, 3.0]).alias("a"), rendezvous(keys.id, [1.0, 3.0, 2.0]).alias("b")).collect()
    share = sum(r.a for r in got) / len(got)
    assert 0.72 < share < 0.78
    assert all(r.b == 2 or r.b == r.a for r in got)
    assert assign_shards(spark.createDataFrame([], "doc_id long, text string"), [1.0]).collect() == []


def test_main_path_is_native(spark, capsys):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assign_shards(df, [1.0] * 40, [1.0] * 41).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Arrow", "Pandas"))

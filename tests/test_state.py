import itertools
import random

from weftline.operators import relations
from weftline.sources.feeds import file_stream
from weftline.streaming import pipeline as P
from weftline.streaming import state as S

CHANGE = "id string, ts long, data string, action string"
NATURAL = "tenant_id string, relationship_type string, from_entity_type string, from_source_id string, from_integration string, to_entity_type string, to_source_id string, to_integration string"
ENTITY = "tenant_id string, entity_type string, source_id string, integration string, entity_id string"


def test_records_are_merged_deleted_and_revived_in_event_order(spark, tmp_path):
    base = f"file://{tmp_path}"
    steps = [
        [("a", 1, '{"x":1,"y":"q"}', "upsert"), ("b", 5, '{"x":null}', "upsert")],
        [("a", 3, None, "delete"), ("b", 2, '{"x":7,"z":[1,{"k":2}]}', "upsert")],
        [("a", 2, '{"x":2,"é\\"":"w"}', "upsert"), ("c", 1, None, "upsert"), ("c", 1, "{}", "delete")],
        [("a", 4, '{"w":true}', "upsert"), ("b", 6, '{"x":9}', "delete")],
    ]
    want = [
        {("a", '{"x":1,"y":"q"}', 1, False, 1), ("b", '{"x":null}', 1, False, 5)},
        {("a", '{"x":1,"y":"q"}', 2, True, 3), ("b", '{"x":null,"z":[1,{"k":2}]}', 2, False, 5)},
        {("a", '{"x":2,"y":"q","é\\"":"w"}', 3, True, 3), ("b", '{"x":null,"z":[1,{"k":2}]}', 2, False, 5), ("c", "{}", 2, True, 1)},
        {("a", '{"w":true,"x":2,"y":"q","é\\"":"w"}', 4, False, 4), ("b", '{"x":null,"z":[1,{"k":2}]}', 3, True, 6), ("c", "{}", 2, True, 1)},
    ]
    for rows, expected in zip(steps, want, strict=True):  # every step is a restart
        spark.createDataFrame(rows, CHANGE).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = S.merged_records(file_stream(spark, f"{base}/in", CHANGE), ["id"], ["ts"], action="action")
        S.start_table(stream, f"{base}/out", f"{base}/cp", True).awaitTermination()
        got = S.latest_records(spark.read.parquet(f"{base}/out"), ["id"]).select("id", "data", "n_changes", "deleted", "last_ts")
        assert {tuple(r) for r in got.collect()} == expected


def test_edges_wait_for_their_ends(spark, tmp_path):
    base, rnd = f"file://{tmp_path}", random.Random(1)
    edges = [("t", rnd.choice("rs"), "o", str(rnd.randrange(12)), "s", "c", rnd.choice([None, *map(str, range(12))]), rnd.choice("su")) for _ in range(60)]
    entities = [("t", k, str(i), g, f"{k}{i}{g}") for k in "oc" for i in range(10) for g in "su"] + [("t", "c", "3", "s", "second"), ("t", None, "3", "s", "x"), ("t", "c", "4", "s", None)]
    rnd.shuffle(entities)
    steps = [(edges[:30], []), (edges[30:40], entities[:15]), ([], entities[15:30]), (edges[20:60], entities[25:40]), (edges[:3], entities[40:])]
    for n, (e, v) in enumerate(steps):
        spark.createDataFrame(e, NATURAL).coalesce(1).write.mode("append").parquet(f"{base}/e")
        spark.createDataFrame(v, ENTITY).coalesce(1).write.mode("append").parquet(f"{base}/v")
        if n in (2, 4):  # a restart between the third and the fourth
            both = (file_stream(spark, f"{base}/{d}", s, files_per_trigger=1) for d, s in (("e", NATURAL), ("v", ENTITY)))
            S.start_table(S.resolved_edges(*both, salts=3, remind_ms=0), f"{base}/out", f"{base}/cp", True).awaitTermination()
        if n not in (2, 4):
            continue
        got = [tuple(r) for r in spark.read.parquet(f"{base}/out").where("status = 'resolved'").select("edge_id", "from_entity_id", "to_entity_id").collect()]
        seen = relations.stage(spark.createDataFrame([x for s in steps[: n + 1] for x in s[0]], NATURAL))
        there = spark.createDataFrame(sorted(set(itertools.chain(*[s[1] for s in steps[: n + 1]])), key=str), ENTITY)
        want = relations.resolve_ends(seen, there).where("from_entity_id is not null and to_entity_id is not null")
        assert sorted(got) == sorted(tuple(r) for r in want.select("id", "from_entity_id", "to_entity_id").collect()) and got
    reminded = spark.read.parquet(f"{base}/out").where("status = 'pending'")
    assert reminded.count() == reminded.select("edge_id").distinct().count() > 0
    assert reminded.where("from_entity_id is not null and to_entity_id is not null").count() == 0


def test_graph_tables_are_compacted(spark, tmp_path):
    path, schema = f"file://{tmp_path}", "id string, ts int, p string, deleted boolean"
    write = P.graph_batches(path, ["id"], ["ts"])
    rows = lambda: sorted((r.id, r.p) for r in P.graph_rows(spark, path, ["id"], ["ts"]).collect())
    for n, step in enumerate([[("a", 1, "x", False), ("b", 5, "y", True)], [("a", 3, "z", False)], [("b", 4, "late", False), ("a", 2, "old", False)], [("b", 6, "new", None)]]):
        write(spark.createDataFrame(step, schema), n)
        before = rows()
        if n in (1, 2):
            assert P.compact_graph(spark, path, ["id"], ["ts"]) == n and rows() == before
            assert len(list(tmp_path.glob("changes/v=*"))) == 0 and len(list(tmp_path.glob("base/v=*"))) == 1
    assert before == [("a", "z"), ("b", "new")]


def test_edges_without_clocks_are_joined_in_the_jvm(spark, tmp_path):
    base, rnd = f"file://{tmp_path}", random.Random(2)
    edges = [("t", rnd.choice("rs"), "o", str(rnd.randrange(8)), "s", "c", rnd.choice([None, *map(str, range(8))]), rnd.choice("su")) for _ in range(40)]
    entities = [("t", k, str(i), g, f"{k}{i}{g}") for k in "oc" for i in range(7) for g in "su"] + [("t", "c", "3", "s", "second"), ("t", None, "3", "s", "x"), ("t", "c", "4", "s", None)]
    rnd.shuffle(entities)
    for e, v in [(edges[:20], entities[:15]), (edges[10:], entities[10:])]:  # a restart between both
        spark.createDataFrame(e, NATURAL).coalesce(1).write.mode("append").parquet(f"{base}/e")
        spark.createDataFrame(v, ENTITY).coalesce(1).write.mode("append").parquet(f"{base}/v")
        both = (file_stream(spark, f"{base}/{d}", s, files_per_trigger=1) for d, s in (("e", NATURAL), ("v", ENTITY)))
        found = S.resolved_edges(*both, salts=2)
        assert "TransformWithState" not in found._jdf.queryExecution().analyzed().toString()
        S.start_table(found, f"{base}/out", f"{base}/cp", True).awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{base}/out").select("edge_id", "from_entity_id", "to_entity_id").collect()]
    there = spark.createDataFrame(sorted(set(entities), key=str), ENTITY)
    want = relations.resolve_ends(relations.stage(spark.createDataFrame(edges, NATURAL)), there).where("from_entity_id is not null and to_entity_id is not null")
    assert sorted(got) == sorted(tuple(r) for r in want.select("id", "from_entity_id", "to_entity_id").collect()) and got

"""The queries op1 to op13 over the tables of a folder, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontamination, embeddings, html, kmeans, language, merkle, nearest, packing, quality, sharding, simhash, substring, token_scan

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    return quality.quality_by_perplexity(table(spark, sf_dir, "documents"), trusted)


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.fit_profiles(docs.where(~language.is_held_out()))
    rows = docs.select("doc_id", language.is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return language.predict_language(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(table(spark, sf_dir, "embeddings"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.document_token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kmeans.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", kmeans.centroid_digest(F.col("centroid")).alias("centroid_sha256"))


LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(LEAF)
    tampered = merkle.leaf_digest([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in LEAF])
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = merkle.merkle_manifest(docs.withColumn("claimed", F.when(picked, tampered)), LEAF, "source", "doc_id", ["claimed"])
    rows = merkle.verified(rows.withColumn("claimed", F.coalesce("claimed", "leaf")), "claimed")
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_packing, op2_quality, op3_substring, op4_simhash, op5_sharding, op6_language, op7_embeddings, op8_html, op9_token_counts, op10_decontamination, op11_nearest, op12_clusters, op13_merkle)
    return {f.__name__: f for f in own}


_WORDS = r"""string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+', ' ', 'g')), ' ')"""

ORACLE_OP10 = rf"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
d AS (SELECT doc_id, r, CASE WHEN w = [''] THEN [] ELSE w END AS w FROM dw),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, w, least(10, len(w)) AS m FROM iw WHERE w <> ['']),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM i)),
ms AS (SELECT DISTINCT m FROM win),
dwin AS (SELECT r, m, k, array_to_string(w[k : k + m - 1], ' ') AS s FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, ms WHERE len(w) >= m)),
found AS (SELECT dwin.r, dwin.k, dwin.m, win.item_id FROM dwin JOIN win ON win.m = dwin.m AND win.s = dwin.s),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

ORACLE_OP7 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT r, vec_id, label, e FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
link AS (SELECT a.r AS x, b.r AS y, a.vec_id AS i, b.vec_id AS j FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(i, j) AS (SELECT DISTINCT i, j FROM link UNION SELECT reach.i, link.j FROM reach JOIN link ON link.i = reach.j),
n AS (SELECT x AS r, count(*) AS n FROM link GROUP BY x),
c AS (SELECT i, min(j) AS c FROM reach GROUP BY i)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.c, vec_id)) AS kept
FROM v LEFT JOIN n USING (r) LEFT JOIN c ON c.i = vec_id
"""




def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and floored means, written out one after the other."""
    out = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k}))"""]
    near = "SELECT r, any_value(kept.vec_id) AS vec_id, any_value(kept.v) AS v, min(struct_pack(d := list_sum(list_transform(list_zip(kept.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := c.c)) AS b FROM kept, c{n} c GROUP BY r"
    for n in range(rounds):
        out.append(f"""a{n} AS MATERIALIZED ({near.format(n=n)}),
m{n} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (SELECT b.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (c))""")
    out.append(f"done AS MATERIALIZED ({near.format(n=rounds)})")
    return "WITH " + ",\n".join(out) + f"""
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM done JOIN c{rounds} c ON c.c = done.b.c"""


def _leaf_sql(text: str) -> str:
    parts = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({p} AS VARCHAR)) || ':' || CAST({p} AS VARCHAR), '-')" for p in parts) + ")"


def _levels_sql(name: str) -> str:
    """All levels of a list of digests, three to one, by recursion."""
    return f"""{name}(g, l, a) AS (SELECT g, 0, a FROM {name}0 UNION ALL SELECT g, l + 1, list_transform(range(0, len(a), 3), lambda i: sha256(array_to_string(a[i + 1 : i + 3], ''))) FROM {name} WHERE len(a) > 1)"""


def _siblings_sql(pos: str) -> str:
    first = f"({pos} // p.w - ({pos} // p.w) % 3)"
    own = f"({pos} // p.w)"
    return f"struct_pack(a := array_to_string(t.a[{first} + 1 : {own}], ''), b := array_to_string(t.a[{own} + 2 : {first} + 3], ''))"


ORACLE_OP13 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '') AS g, {_leaf_sql("text")} AS leaf, {_leaf_sql(r"replace(text, chr(10), '')")} AS other,
  list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, CASE WHEN (4294967295 - crc) % 2 = 0 THEN other ELSE leaf END AS claimed FROM d),
lv0 AS (SELECT g, list(leaf ORDER BY pos) AS a FROM n GROUP BY g),
{_levels_sql("lv")},
s AS (SELECT g, a[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM lv WHERE len(a) = 1),
tv0 AS (SELECT '' AS g, list(subroot ORDER BY pos) AS a FROM s),
{_levels_sql("tv")},
p AS (SELECT i AS l, CAST(pow(3, i) AS BIGINT) AS w FROM range(0, 30) x(i)),
s1 AS (SELECT s.g, list({_siblings_sql("s.pos")} ORDER BY t.l) FILTER (WHERE len(t.a) > 1) AS steps FROM s, tv t JOIN p ON p.l = t.l GROUP BY s.g),
s0 AS (SELECT n.r, list({_siblings_sql("n.pos")} ORDER BY t.l) FILTER (WHERE len(t.a) > 1) AS steps FROM n JOIN lv t ON t.g = n.g JOIN p ON p.l = t.l GROUP BY n.r),
x AS (SELECT n.*, s.subroot, (SELECT a[1] FROM tv WHERE len(a) = 1) AS root, list_concat(coalesce(s0.steps, []), coalesce(s1.steps, [])) AS steps FROM n JOIN s USING (g) JOIN s0 ON s0.r = n.r JOIN s1 ON s1.g = n.g),
f(r, k, h) AS (SELECT r, 0, claimed FROM x UNION ALL SELECT f.r, k + 1, sha256(x.steps[k + 1].a || h || x.steps[k + 1].b) FROM f JOIN x ON x.r = f.r WHERE k < len(x.steps)),
e AS (SELECT r, max_by(h, k) AS folded_root FROM f GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda y: y.a || y.b), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM x JOIN e USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_decontamination": ORACLE_OP10, "op7_embeddings": ORACLE_OP7, "op12_clusters": _clusters_sql(), "op13_merkle": ORACLE_OP13}

"""The thin queries: columns and types of their contracts, whole tables, and SQL where there is some."""

import os

import duckdb
import pytest

from weftline.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
COLUMNS = {
    "op1_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op2_quality": "doc_id bigint, lang string, n_chars bigint, perplexity double, threshold double, kept boolean",
    "op3_substring": "doc_id bigint, text_hash bigint, start_word bigint, end_word bigint, rep_doc_id bigint, rep_start bigint, rep_end bigint, identity double",
    "op4_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op5_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_embeddings": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8_html": "page_id bigint, url string, text string, n_chars bigint",
    "op9_token_counts": "doc_id bigint, file_id bigint, doc_index bigint, start_token bigint, n_tokens bigint",
    "op10_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op11_nearest": "query_id bigint, rank int, vec_id bigint, score double",
    "op12_clusters": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op13_merkle": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    df = Q.queries()[name](spark, SF)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]
    rows = df.collect()
    source = {"op7_embeddings": "embeddings", "op8_html": "pages", "op11_nearest": "embeddings", "op12_clusters": "embeddings"}.get(name, "documents")
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").collect()}
    got = [r[0] for r in rows]
    if name == "op3_substring":
        assert set(got) <= ids
    elif name == "op1_packing":
        assert set(got) == ids
    elif name == "op11_nearest":
        assert sorted(got) == sorted(i for i in ids if i % 20 == 0 for _ in range(20))
    else:
        assert sorted(got) == sorted(ids)
    if name in Q.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.execute(Q.oracle_sql()[name]).df()[df.columns]
        assert sorted(map(tuple, rows)) == sorted(map(tuple, want.itertuples(index=False)))


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in Q.op6_language(spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.95 * len(rows) > 0

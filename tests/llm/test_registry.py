import duckdb
import pytest

from crawlloom.llm import registry

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op2_nearest_neighbors": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op3_syncmer_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op4_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op6_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_url_filters": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op9_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.mark.parametrize("name", CONTRACT)
def test_columns(spark, name):
    df = registry.queries()[name](spark, SF)
    assert {c: t for c, t in df.dtypes if c in CONTRACT[name]} == CONTRACT[name]
    table = {"op2": "embeddings", "op7": "pages", "op9": "pages"}.get(name.split("_")[0], "documents")
    if name not in ("op2_nearest_neighbors", "op6_best_fit_packing"):
        assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())

"""Every registered query: names, rows, and its SQL where there is one, on the smallest tables."""

import os

import pytest

import __spark_entry__
import corpus_pipeline
from pingpath.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")

COLUMNS = {
    "op2_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op3_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op5_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op6_url_filters": "page_id host path rule verdict",
    "op7_toxicity": "doc_id held_out score predicted",
    "op8_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9_ngram_join": "doc_id n_shingles component_id",
    "op11_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op12_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13_quality_classifier": "doc_id held_out score predicted",
}


def test_one_query_for_each_operator_and_the_pipeline():
    found = __spark_entry__.queries()
    assert [sum(q.startswith(f"op{n}_") for q in found) for n in range(1, 14)] == [1] * 13 and "pipeline" in found
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_whole_table_and_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS.get(name, "").split()) <= set(got.columns)
    table = "pages" if name.startswith("op6") else "documents"
    rows = got.collect()
    if not name.startswith("op10"):
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in queries.ORACLE:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        want = con.sql(queries.ORACLE[name])
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        order = [want.columns.index(c) for c in cols]
        assert sorted(tuple(str(r[c]) for c in cols) for r in rows) == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())

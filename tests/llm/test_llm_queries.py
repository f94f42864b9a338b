"""Every registered training-data query runs over a small table, and the pipeline from end to end."""

import hashlib
import re

import duckdb
import pytest

import corpus_pipeline
from flowharbor.llm.common import table
from flowharbor.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": "doc_id fingerprint component_id", "op2_language_id": "doc_id held_out lang_pred score", "op3_quality": "doc_id held_out score predicted", "op4_html": "page_id url text n_chars", "op5_topk": "query_id rank vec_id score",
    "op6_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op7_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op8_mixing": "doc_id size source_size target taken", "op9_toxicity": "doc_id severity score predicted",
    "op11_url_reputation": "page_id host path rule verdict", "op12_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256", "op13_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op10_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and set(COLUMNS[name].split()) <= set(rows[0].asDict())
    if "doc_id" in COLUMNS[name] and name != "op7_packing":
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect())
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        rel = con.sql(ORACLES[name])
        columns = COLUMNS[name].split()
        assert sorted(tuple(map(str, (r[c] for c in columns))) for r in rows) == sorted(tuple(str(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall())
    if name == "op8_mixing":
        words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in table(spark, SF, "documents").collect()}
        assert all(r["size"] == words[r.doc_id] and 0 <= r.taken <= 3 * r["size"] for r in rows)
    if name == "op10_chat":
        forged = next(r for r in rows if r.conv_id == -7)
        assert forged.loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest() and forged.n_turns == 2


def test_pipeline_runs_from_end_to_end(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "piece", "ids", "sequence_id", "offset"} <= set(rows[0].asDict())
    ids = {r.doc_id for r in table(spark, SF, "documents").collect()}
    assert {r.doc_id for r in rows} <= ids and all(len(r.ids) == 4 * r.length and r.offset + r.length <= 2048 for r in rows)

"""Registered queries on the smallest tables: against SQL where there is one, else their promised columns."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import connect, differences  # noqa: E402

from quarry.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_html_template": "page_id url text n_chars", "op2_chat_trees": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op3_toxicity_zstd": "doc_id held_out score predicted",
    "op4_fm_index": "doc_id n_words n_hit n_items items_sha256 contaminated", "op5_token_files": "doc_id start n_tokens ids_crc32", "op6_simhash_bk": "doc_id fingerprint component_id",
    "op7_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op8_bpe_forced_boundaries": "doc_id n_tokens ids_sha256 decoded_sha256", "op9_license_tfidf": "doc_id license", "op10_language_kn": "doc_id held_out lang_pred score",
}


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_sql(spark, name):
    assert not differences(spark, connect(SF), Q.QUERIES[name], Q.ORACLE[name], SF)[:3]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = Q.QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    source = "pages" if name.startswith("op1_") else "conversations" if name.startswith("op2_") else "documents"
    if source != "conversations":
        assert df.count() == spark.read.parquet(f"{SF}/{source}.parquet").count() + len(Q.LICENSE_PROBE) * name.startswith("op9_")


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
            rows = {r["doc_id"]: r for r in after.collect()}
            assert all(before[i] == r for i, r in rows.items()) and len(rows) > 0.5 * len(before)
            before, docs = rows, spark.createDataFrame(list(rows.values()), docs.schema)
        else:
            assert {r["doc_id"] for r in after.collect()} == set(before)


def test_license_probe_inherits(spark):
    got = {r["doc_id"]: (r["license"], r["inherited_from"]) for r in Q.op9_license_tfidf(spark, SF).where("doc_id < 0").collect()}
    assert got == {-1: ("MIT", None), -2: ("Apache-2.0", None), -3: ("MIT", "probe/LICENSE"), -4: ("Apache-2.0", "probe/lib/COPYING"), -5: (None, None)}

"""The registered queries and the pipeline on the smallest tables."""

import pytest
from oracle import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from meterglass.llm import langid, minhash, quality, queries

CONTRACT = {
    "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_telephony_audio": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"},
    "op3_separator_scan": {"doc_id", "n_tokens", "ended"},
    "op4_html_main_text": {"page_id", "url", "text", "n_chars"},
    "op5_quality": {"doc_id", "held_out", "score", "predicted"},
    "op6_vector_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op7_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op8_rotated_codes": {"vec_id", "n_links", "component_id", "kept"},
    "op9_bpe_tree": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op10_minhash": {"doc_id", "n_shingles", "component_id", "kept"},
    "op11_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op12_merkle_manifest": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    "op13_periodic_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_and_rows(spark, sf, name):
    got = entry.queries()[name](spark, sf)
    assert CONTRACT[name] <= set(got.columns)
    table = {"op4_html_main_text": "pages", "op8_rotated_codes": "embeddings"}.get(name, "documents")
    rows = got.count()
    there = spark.read.parquet(f"{sf}/{table}.parquet").count()
    assert rows == there if name != "op6_vector_packing" else rows >= there


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf), sf, queries.SQL[name]) == ""


def test_scanned_counts_are_those_of_the_encoder(spark, sf):
    found, known = (sorted((r.doc_id, r.n_tokens) for r in entry.queries()[q](spark, sf).collect()) for q in ("op3_separator_scan", "op9_bpe_tree"))
    assert found == known


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf).cache()
        assert after.columns == docs.columns and after.join(docs, "doc_id", "left_anti").count() == 0, name
        docs = after
    groups = minhash.near_duplicates(docs, F.col("doc_id"), F.col("text"))
    assert groups.where(~F.col("kept")).count() == 0
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_stages_keep_what_their_operators_keep(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    network = langid.train(docs, F.col("doc_id"), F.col("text"), F.col("lang"))
    kept = {r.doc_id for r in langid.keep_known(docs, F.col("text"), network).collect()}
    assert kept == {r.doc_id for r in langid.identify(docs, F.col("text"), network, "doc_id").where(f"lang_pred <> 'und' AND score >= {langid.least_score(network)}").collect()}
    ranking = quality.train(docs, F.col("doc_id"), F.col("text"), spark.read.parquet(f"{sf}/labels.parquet"), F.col("doc_id"), F.col("quality"))
    good = {r.doc_id for r in quality.keep_good(docs, F.col("text"), ranking).collect()}
    assert good == {r.doc_id for r in quality.score_quality(docs, F.col("text"), ranking, "doc_id").where("predicted = 1").collect()}

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_decontaminate, test_lines, test_packing, test_simhash
from tidemark.llm import common

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Every stage's rows, each stage run on what the one before wrote."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = common.table(spark, sf, "documents")
    out["input"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect()
    return out


def pairs(rows):
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_columns_stay(spark, sf, stages):
    docs = common.table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == COLUMNS


def test_language_id_keeps_clean_documents(stages):
    kept = {r.doc_id for r in stages["language_id"]}
    gone = [r for r in stages["input"] if r.doc_id not in kept]
    assert len(gone) <= 0.01 * len(stages["input"])


def test_line_dedup_against_brute_force(stages):
    assert pairs(stages["line_dedup"]) == sorted(test_lines.brute(sorted(pairs(stages["language_id"]))), key=str)
    assert all(r.n_chars == len(r.text) for r in stages["line_dedup"])


def test_near_dedup_against_brute_force(stages):
    rows = pairs(stages["line_dedup"])
    assert corpus_pipeline.SHINGLE_WORDS == 5
    assert pairs(stages["near_dedup"]) == sorted(test_simhash.brute_similar(rows), key=str)


def test_decontamination_against_brute_force(spark, sf, stages):
    items = [(str(r.item_id), r.text) for r in common.table(spark, sf, "benchmark").collect()]
    hits = {k: n for k, _, n, _ in test_decontaminate.brute(pairs(stages["near_dedup"]), items)}
    assert {r.doc_id for r in stages["decontamination"]} == {k for k, n in hits.items() if not n}


def test_packing_of_what_is_left(stages):
    test_packing.check(pairs(stages["decontamination"]), stages["packing"])


def test_run_gives_the_last_stage(spark, sf, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = sorted(tuple(r[k] for k in key) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == sorted(tuple(r[k] for k in key) for r in stages["packing"])


def test_messy_and_empty_documents(spark, sf, messy, empty):
    for docs in (messy.withColumn("lang", F.lit("en")).withColumn("_found", F.lit(1)), empty):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "packing":
                assert out.columns == docs.columns and out.count() <= n
                docs = out
        assert out.columns[1:] == ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() >= 0

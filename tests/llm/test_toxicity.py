import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.conftest import MESSY
from tidemark.llm import toxicity
from tidemark.llm.catalog import QUERIES


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = QUERIES["op7_toxicity"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    found = sum(t and p for t, p in held)
    assert found >= 0.75 * sum(t for t, _ in held)
    assert found >= 0.95 * sum(p for _, p in held)


def test_a_pair_matters_where_neither_term_does():
    rng = np.random.default_rng(1)
    texts, label = [], []
    for i in range(1200):
        a, b = rng.integers(0, 2, 2)
        own = [*(10 + rng.integers(0, 30, 4)), *([1] if a else [2]), *([3] if b else [4])]
        texts.append(np.unique(own))
        label.append(int(a == b))  # an exclusive or: no additive weights can tell
    machine = toxicity.train(texts, np.array(label), 0.5)
    at = [np.searchsorted(machine.buckets, t) for t in texts]
    logits = machine.logits(np.repeat(np.arange(len(at)), [len(x) for x in at]), np.concatenate(at), len(at))
    assert ((logits > 0) == np.array(label)).mean() > 0.9


def test_terms_are_a_set_by_row():
    row, bucket = toxicity.terms(pa.array(["Ab ab AB", None, "", "wordier words"]))
    assert np.bincount(row, minlength=4).tolist() == [1, 0, 0, 2 + 1 + 2]


def test_messy_rows(spark, messy, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (6, None), (99, 1), (None, 1), (3, 1)], "doc_id long, toxic int")
    got = toxicity.classify(messy, labels, F.lit(True))
    assert got.columns == [*messy.columns, "toxicity"]
    rows = got.collect()
    assert len(rows) == len(MESSY) and all(0 <= r.toxicity <= 1 for r in rows)
    assert toxicity.classify(empty, labels, F.lit(True)).count() == 0
    none = toxicity.classify(messy, labels.limit(0), F.lit(True)).select("toxicity").distinct().collect()
    assert [r.toxicity for r in none] == [0.5]


def test_a_key_with_most_rows_is_bounded_in_rows(spark, monkeypatch):
    seen = {}

    def train(texts, toxic, share, seed=5):
        seen["rows"], seen["toxic"] = len(texts), int(toxic.sum())
        return toxicity.Machine(np.empty(0, np.int64), np.empty(0), np.empty((0, toxicity.FACTORS)), 0.0)

    monkeypatch.setattr(toxicity, "train", train)
    rows = [(1, "words " + "".join(chr(97 + int(d)) for d in f"{i:03d}") * 2) for i in range(500)] + [(1, "the same")] * 300 + [(k, f"text {k}") for k in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(k, 1 if k < 20 else 0) for k in range(1, 30)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, sample=40)
    assert seen == {"rows": 40 + 10, "toxic": 40}

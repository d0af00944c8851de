import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.conftest import MESSY
from tidemark.llm import langid
from tidemark.llm.catalog import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op1_langid"](spark, folder).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 12):
        code = langid.codewords(n)
        least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert code.shape[0] == n and least >= (code.shape[1] // 4 or 1)
    assert langid.codewords(1).shape == (1, 1)


def test_grams_stay_in_their_row_and_follow_the_piece(monkeypatch):
    data, offsets = langid.normal(pa.array(["Ab, c", None, "", "xyz 1!! w"]))
    assert data.tobytes() == b"ab cxyz w" and offsets.tolist() == [0, 4, 4, 4, 9]
    tally = lambda: sorted((int(r), int(b)) for row, bucket in langid.grams(data, offsets) for r, b in zip(row, bucket))
    whole = tally()
    assert len(whole) == (4 + 3 + 2 + 1) + (5 + 4 + 3 + 2)
    monkeypatch.setattr(langid, "_PIECE", 2)
    assert tally() == whole


def test_unknown_texts(messy, empty, documents):
    model = langid.fit(documents)
    got = {(r.doc_id, r.text): r.p for r in messy.select("doc_id", "text", langid.predict(F.col("text"), model).alias("p")).collect()}
    for key, text in MESSY:
        p = got[key, text]
        assert (p.lang == "und") == (text is None or not any(c.isalpha() for c in text))
        assert 0 <= p.score <= 1
    assert langid.identify(empty, F.lit(True)).count() == 0
    untaught = langid.identify(documents, F.lit(False)).select("language.lang").distinct().collect()
    assert [r.lang for r in untaught] == ["und"]


def test_one_language_and_a_tie(spark):
    one = spark.createDataFrame([(1, "alpha beta", "xx"), (2, "gamma", None)], "doc_id long, text string, lang string")
    assert {r.l for r in langid.identify(one, F.lit(True)).select(F.col("language.lang").alias("l")).collect()} == {"xx"}
    same = spark.createDataFrame([(1, "alpha", "a"), (2, "alpha", "b")], "doc_id long, text string, lang string")
    got = langid.identify(same, F.lit(True)).select("language.*").collect()
    assert {(r.lang, r.ambiguous) for r in got} == {("a", True)}


def test_loss_weighted_decoding_follows_the_trusted_bits():
    model = langid.Model(["a", "b"], np.array([[1, 1, 1], [-1, -1, -1]]), np.zeros((langid.BUCKETS, 3)),
                         np.array([[1.0, 0.01, 0.01], [1.0, 0.01, 0.01]]))
    best, score, close = model.decode(np.array([[1.0, -1.0, -1.0], [0.0, 0.0, 0.0]]))
    assert best.tolist() == [0, 0] and score[0] > 0.9 and close.tolist() == [False, True]

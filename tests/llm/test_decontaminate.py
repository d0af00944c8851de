import hashlib
import re

from tests.llm.conftest import MESSY
from tidemark.llm import common, decontaminate
from tidemark.llm.catalog import QUERIES

ITEMS = [("a", "fox jumps over the lazy dog near the river bank"), ("b", "quick brown"), ("c", None), ("d", "..."),
         ("e", "漢字"), (None, "brown fox"), ("f", "quick BROWN"), ("g", "ipsum dolor sit amet lorem ipsum dolor sit amet lorem")]


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    out = []
    for key, text in docs:
        own, hit, ids = words(text), set(), set()
        for item, body in items:
            w = words(body)
            n = min(10, len(w))
            grams = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
            at = [i for i in range(len(own) - n + 1) if n and tuple(own[i:i + n]) in grams]
            if at:
                ids.add(item)
                hit.update(p for i in at for p in range(i, i + n))
        out.append((key, len(own), len(hit), sorted(i for i in ids if i is not None)))
    return sorted(out, key=str)


def found(docs, items):
    got = decontaminate.contamination(docs, items).collect()
    assert all(r.n_hit == sum(h.end - h.start for h in r.hits) for r in got)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str)


def items_frame(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id string, text string")


def test_messy_rows(spark, messy, empty):
    assert found(messy, items_frame(spark)) == brute(MESSY, ITEMS)
    assert found(messy, items_frame(spark, [])) == brute(MESSY, [])
    assert found(empty, items_frame(spark)) == []


def test_a_benchmark_in_shards(spark, messy, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WINDOWS", 2)
    assert found(messy, items_frame(spark)) == brute(MESSY, ITEMS)
    # Each shard's findings are stored, so the last scan holds the last shard's matcher alone.
    plan = decontaminate.contamination(messy, items_frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    kept = decontaminate.clean(messy, items_frame(spark))
    assert kept.columns == messy.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((k for k, _, n, _ in brute(MESSY, ITEMS) if not n), key=str)


def test_query_rows(spark, sf, texts):
    items = [(str(r.item_id), r.text) for r in common.table(spark, sf, "benchmark").collect()]
    want = [(k, n, hit, len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), hit > 0)
            for k, n, hit, ids in brute(texts, items)]
    assert sorted(tuple(r) for r in QUERIES["op8_decontaminate"](spark, sf).collect()) == sorted(want)

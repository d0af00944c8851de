import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import MESSY
from tidemark.llm import common, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, part=80, top=2000):
    """Every phrase counted on its own."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0a-\\x0d]", (text or "").translate(LOWER)):
            words = tuple(w for w in re.split("[ \\t]+", piece) if w)
            total[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, words[i:i + k]) for i in range(len(words) - k + 1))
    often = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= least}
    out = []
    for lang in total:
        own = {w: n for (x, w), n in often.items() if x == lang}
        held = Counter()
        for w, n in own.items():
            for inner in {w[i:j] for i in range(len(w)) for j in range(i + 2, len(w) + 1)} - {w}:
                held[inner] = max(held[inner], n)
        best = []
        for w, a in own.items():
            if w in held and 100 * held[w] >= part * a:
                continue
            cuts = [(2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            best.append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def found(df, **kw):
    return sorted(tuple(r) for r in phrases.collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(n, seed=3):
    rnd = random.Random(seed)
    words = ["the", "New", "york", "Stock", "exchange", "of", "a", "naïve", "漢字", "x\u00a0y", "-", "\x0b", "rain."]
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(words[:3 + i % 11]) + rnd.choice([" ", "  ", "\t", " ", ", ", ".", "\n"]) for _ in range(rnd.randint(0, 40)))
        rows.append((rnd.choice(["en", "de", None, "und", ""]), text))
    return rows + [("en", "New York Stock Exchange opens " * 30)] * 4


@pytest.mark.parametrize("budget", [10**6, 400, 40])
def test_counts_scores_and_order(spark, budget):
    """Small budgets make groups of few prefixes, and extend the prefixes that are over the budget alone."""
    rows = made(250)
    df = common.prepare(spark).createDataFrame(rows, "lang string, text string").repartition(5)
    want = brute(rows, least=4)
    assert found(df, budget=budget, least=4) == want and len(want) > 60


def test_parameters(spark):
    rows = made(120, 9)
    df = spark.createDataFrame(rows, "lang string, text string")
    for kw in ({"least": 5, "part": 50, "top": 7}, {"least": 2, "part": 101, "top": 40}):
        assert found(df, **kw) == brute(rows, **kw)


def test_bit_maps_only_save_work(spark, monkeypatch):
    rows = made(120, 5)
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "WORD_BITS", 16)
    monkeypatch.setattr(phrases, "PREFIX_BITS", 16)
    monkeypatch.setattr(phrases, "CELL_BITS", 3)
    assert found(df, budget=300) == brute(rows)


def test_flushing_and_folding_keep_the_counts(spark, monkeypatch):
    rows = made(200, 6)
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    want = brute(rows)
    monkeypatch.setattr(phrases, "_HELD", 50)
    assert found(df, budget=100) == want


def test_messy_rows(spark, messy, empty):
    rows = [(None if k is None else "a", t) for k, t in MESSY]
    df = messy.withColumn("lang", F.when(F.col("doc_id").isNotNull(), "a")).withColumnsRenamed({"row": "key", "body": "word", "copy": "f"})
    assert found(df) == brute(rows)
    assert found(empty) == []
    assert found(messy.withColumn("lang", F.lit(None).cast("string")).filter("doc_id IN (3, 4, 5)")) == []


def test_one_language_and_word_with_most_rows(spark):
    rows = [("en", "hot hot hot hot cold"), ("de", "hot hot")] * 400 + made(50)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(df, budget=200) == brute(rows)

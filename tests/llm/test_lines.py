import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import MESSY
from tidemark.llm import common, lines
from tidemark.llm.corpus import Corpus


def word_set(line):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", lower))


def brute(rows):
    """Texts after removal; rows are in the documents' order, repeats of a row share its fate."""
    places, out = [], {}
    for at, (_, text) in enumerate(rows):
        for number, line in enumerate((text or "").split("\n")):
            if word_set(line):
                places.append((at, number, word_set(line)))
    gone = set()
    for i, (at, number, own) in enumerate(places):
        if any(5 * len(own & w) >= 4 * len(own | w) for _, _, w in places[:i]):
            gone.add((at, number))
    for at, (key, text) in enumerate(rows):
        if text is not None:
            text = "\n".join(line for n, line in enumerate(text.split("\n")) if (at, n) not in gone)
        out[at] = (key, text)
    return list(out.values())


def ordered(spark, rows):
    """Distinct rows in the order that the operator gives documents."""
    df = spark.createDataFrame(list(dict.fromkeys(rows)), "doc_id long, text string")
    return [tuple(r) for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS h").orderBy("doc_id", "h").select("doc_id", "text").collect()]


def found(df, **more):
    return sorted({(r.doc_id, r.text) for r in lines.dedup(df, **more).select("doc_id", "text").collect()}, key=str)


def near_lines(seed, docs=30):
    rng = np.random.default_rng(seed)
    pool = [" ".join(f"w{int(x)}" for x in rng.integers(0, 60, int(rng.integers(1, 25)))) for _ in range(25)]
    rows = []
    for i in range(docs):
        own = []
        for _ in range(int(rng.integers(0, 8))):
            words = pool[int(rng.integers(len(pool)))].split()
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = f"w{int(rng.integers(0, 60))}"
            own.append(" ".join(words) if rng.random() > 0.1 else "")
        rows.append((i, "\n".join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_near_lines(spark, seed):
    rows = near_lines(seed)
    got = found(common.prepare(spark).createDataFrame(rows, "doc_id long, text string"))
    assert got == sorted(brute(rows), key=str)


def test_messy_rows(spark, messy, empty):
    assert found(messy) == sorted(set(brute(ordered(spark, MESSY))), key=str)
    kept = lines.dedup(messy)
    assert kept.columns == messy.columns and kept.count() == len(MESSY)
    assert lines.dedup(empty).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(11)
    base = [f"t{i}" for i in range(30)]

    def variant():
        words = list(base)
        for at in rng.integers(0, 30, int(rng.integers(0, 7))):
            words[at] = f"v{int(rng.integers(0, 400))}"
        return " ".join(words)

    rows = [(i, variant() + "\n" + variant() + f"\nonly here {i} {i + 1000}") for i in range(120)]
    df = common.prepare(spark).createDataFrame(rows, "doc_id long, text string")
    corpus = Corpus(df)
    own = lines.survey(corpus)
    counts = lines.rarity(own)
    firsts = own.filter("slice IS NULL").groupBy("doc", "copy").agg(F.collect_list("line").alias("lines"))
    assert lines.candidates(corpus, firsts, counts).filter("cluster IS NOT NULL").count() > 0
    corpus.drop()
    assert found(df) == sorted(brute(rows), key=str)


def test_first_matches_drop_out_in_order():
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 25, int(rng.integers(3, 20)))) for _ in range(150)]
    turn = rng.permutation(150)
    want = [any(turn[j] < turn[i] and 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert lines.first_matches(sets, turn).tolist() == want


def rows_of(texts):
    import pyarrow as pa

    found_ = lines.Lines(pa.array(texts))
    counts = np.bincount(lines._slots(found_.hashes), minlength=lines.TABLE)
    n = len(texts)
    return lines.prefixes(found_, np.ones(len(found_.row), bool), lines.rarity_codes(counts), np.arange(n), np.zeros(n, np.int32)), counts


def named(rows, later, earlier):
    return {(int(rows["doc"][i]), int(rows["doc"][j])) for i, j in zip(later, earlier)}


def test_large_groups_and_hot_words_give_the_same_pairs(monkeypatch):
    texts = [t.split("\n")[0] for _, t in near_lines(5, 120)]
    rows, counts = rows_of(texts)
    monkeypatch.setattr(lines, "CLUSTER", 1000)
    want = named(rows, *lines.pairs_of(rows)[:2])
    assert want and all(a > b for a, b in want)
    monkeypatch.setattr(lines, "GROUP_ROWS", 3)
    assert named(rows, *lines.pairs_of(rows)[:2]) == want
    got, shards = set(), -(-counts[lines._token_slots(rows["tok"])] // 4)
    for _, blob in lines.deal(rows, shards, 5):
        part = lines._rows(blob)
        got |= named(part, *lines.pairs_of(part)[:2])
    assert got == want


def test_a_crowded_word_reports_its_lines_instead(monkeypatch):
    texts = [t.split("\n")[0] for _, t in near_lines(5, 120)]
    rows, _ = rows_of(texts)
    monkeypatch.setattr(lines, "CLUSTER", 1000)
    every = named(rows, *lines.pairs_of(rows)[:2])
    for size in (2, 1500):
        monkeypatch.setattr(lines, "GROUP_ROWS", size)
        monkeypatch.setattr(lines, "CLUSTER", 1)
        later, earlier, crowd = lines.pairs_of(rows)
        together = {}
        for i in crowd:
            together.setdefault(int(rows["tok"][i]), set()).add(int(rows["doc"][i]))
        assert crowd.size and every <= named(rows, later, earlier) | {(a, b) for own in together.values() for a in own for b in own}
    assert [len(x) for x in lines.pairs_of(rows[:0])] == [0, 0, 0]


def test_every_match_is_a_candidate(monkeypatch):
    texts = [t.split("\n")[0] for _, t in near_lines(6, 150)]
    rows, _ = rows_of(texts)
    monkeypatch.setattr(lines, "CLUSTER", 1000)
    got = named(rows, *lines.pairs_of(rows)[:2])
    sets = [word_set(t) for t in texts]
    same = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and 5 * len(a & b) >= 4 * len(a | b)}
    assert same <= got


def test_line_numbers():
    import pyarrow as pa

    got = lines.Lines(pa.array(["a\n\nb c\n", "", None, "\n", "d", "e\r\nf"]))
    assert list(zip(got.row.tolist(), got.number.tolist())) == [(0, 0), (0, 2), (4, 0), (5, 0), (5, 1)]

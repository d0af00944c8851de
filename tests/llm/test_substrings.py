import numpy as np
import pyarrow as pa

from tests.llm.conftest import MESSY
from tests.llm.test_lines import ordered
from tidemark.llm import common, substrings


def brute(rows):
    seen, out = set(), []
    for key, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            window = raw[p:p + 100]
            if window in seen:
                gone[p:p + 100] = True
            seen.add(window)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((key, len(raw), spans, bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.key, r.n_bytes, [(s.low, s.high) for s in r.spans], bytes(r.kept)) for r in
                   substrings.dedup(df).withColumnRenamed("doc_id", "key").collect()), key=str)


def frame(spark, rows):
    return common.prepare(spark).createDataFrame(rows, "doc_id long, text string")


def test_query_rows(documents, texts):
    assert found(documents) == brute(sorted(texts))


def test_messy_rows(spark, messy, empty):
    got = found(messy)
    assert len(got) == len(MESSY)
    assert sorted({str(g) for g in got}) == sorted({str(w) for w in brute(ordered(spark, MESSY))})
    assert found(empty) == []


def test_periodic_and_overlapping_texts(spark):
    rng = np.random.default_rng(2)
    letters = lambda n: "".join(rng.choice(list("abcdé "), n))
    a, b = letters(300), letters(150)
    rows = [(1, "ab" * 200), (2, "a" * 99), (3, "a" * 100), (4, "a" * 101), (5, a + b), (6, b + a), (7, a[:99] + "#" + a[99:]),
            (8, a[50:180]), (9, "x" + "ab" * 120 + "y"), (10, (a[:60] + b[:60]) * 4), (11, letters(1000) + a[20:260] + letters(1000))]
    assert found(frame(spark, rows)) == brute(rows)


def test_many_copies_of_a_short_passage(spark):
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    line, passage = letters(80), letters(130)
    rows = [(i, letters(int(rng.integers(0, 200))) + (line if i % 2 else passage) + letters(int(rng.integers(0, 200)))) for i in range(300)]
    assert found(frame(spark, rows)) == brute(rows)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 4, 400).astype(np.uint8)
    for anchor in substrings.ANCHORS:
        marks = []
        for before in (0, 137):
            data = np.concatenate((rng.integers(0, 4, before).astype(np.uint8), shared, rng.integers(0, 4, 50).astype(np.uint8)))
            own = {}
            for token, _, at, windows in substrings.records(data, anchor, [(0, len(data) - 99)]):
                for t, p, n in zip(token.tolist(), at.tolist(), windows.tolist()):
                    own |= {p + i - before: t for i in range(n)}
            assert sorted(own) == list(range(-before, len(data) - 99 - before))
            marks.append([own[p] for p in range(301)])
        assert marks[0] == marks[1]


def test_pieces_of_long_texts_cover_all_windows(monkeypatch):
    data = np.random.default_rng(5).integers(0, 3, 2000).astype(np.uint8)
    monkeypatch.setattr(substrings, "_PIECE", 70)
    covered = np.zeros(1901, int)
    for _, _, at, windows in substrings.records(data, 32, [(0, 1901)]):
        for p, n in zip(at, windows):
            covered[p:p + n] += 1
    assert (covered == 1).all()


def random_records(n, seed):
    rng = np.random.default_rng(seed)
    rows = np.zeros(n, substrings._RECORD)
    for name, high in (("token", 6), ("tail", 3), ("doc", 9), ("copy", 2), ("at", 5)):
        rows[name] = rng.integers(0, high, n)
    rows["windows"] = 1
    return np.unique(rows)


def test_multikey_order():
    rows = random_records(800, 6)
    np.random.default_rng(7).shuffle(rows)
    keys = [rows[k] for k in substrings._ORDER]
    want = np.lexsort(keys[::-1])
    assert (rows[substrings.multikey(keys)] == rows[want]).all()
    assert len(substrings.multikey([k[:0] for k in keys])) == 0


def test_ranges_compared_across_boundaries_judge_like_one():
    """Cut into any number of ranges, every record gets the verdict it gets in one range."""
    rows = random_records(400, 8)

    def judged(splitters):
        part = substrings.ranges(rows, splitters)
        tables = [pa.Table.from_batches([substrings._judge(rows[part == p], p)]) for p in np.unique(part).tolist()]
        every = pa.concat_tables(tables).to_pylist()

        class Row:
            def __init__(self, fields):
                self.__dict__.update(fields)

        verdict = {(p, t, h): v for p, t, h, v in substrings._verdicts([Row(r) for r in every if r["kind"] >= 3])}
        out = {}
        for r in every:
            if r["kind"] < 3:
                kind = r["kind"] if r["kind"] < 2 else verdict[r["part"], r["token"], r["tails"] < 0]
                if kind >= 0:
                    out[r["token"], r["tail"], r["doc"], r["copy"], r["at"]] = kind
        return out

    whole = judged(rows[:0])
    assert set(whole.values()) == {0, 1}
    for cuts in ([200], [5, 6, 7, 8], list(range(0, len(rows), 3)), [17, 17, 300]):
        assert judged(np.sort(rows, order=list(substrings._ORDER))[cuts]) == whole

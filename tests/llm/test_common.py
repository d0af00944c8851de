import numpy as np
import pyarrow as pa

from tidemark.llm import common, hashing
from tidemark.llm.catalog import ORACLES, QUERIES


def brute_components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(3)
    for n, m in ((30, 20), (200, 150), (50, 200)):
        edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b]
        edges += [(n + i, n + i + 1) for i in range(40)]  # a long path
        got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.node: r.component for r in got} == brute_components(edges)
        assert len(got) == len({r.node for r in got})


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert common.components(spark.createDataFrame([(1, 1), (2, None)], "a long, b long")).count() == 0


def test_local_roots():
    assert common.local_roots(5, np.array([3, 1]), np.array([4, 3])).tolist() == [0, 1, 2, 1, 1]


def test_split_hot_shows_every_pair_once(spark):
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 50), ("b", 3)) for i in range(n)], "k string, m int")
    dealt = common.split_hot(rows, ["k"], "m", 10).collect()
    seen = {}
    for r in dealt:
        seen.setdefault((r.k, r.left, r.right), []).append((r.m, r.shard))
    pairs = [(k, *sorted((a, b))) for (k, left, right), own in seen.items() for a, s in own for b, t in own
             if a < b and {s, t} == {left, right}]
    assert sorted(pairs) == [(k, i, j) for k, n in (("a", 50), ("b", 3)) for i in range(n) for j in range(i + 1, n)]
    assert max(len(own) for own in seen.values()) < 40


def test_grouped_crosses_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": v}) for k, v in (([1, 1], [1, 2]), ([1, 2], [3, 4]), ([2], [5]), ([3], [6]))]
    got = [(t.column("k")[0].as_py(), t.column("v").to_pylist()) for t in common.grouped(iter(batches), 1)]
    assert got == [(1, [1, 2, 3]), (2, [4, 5]), (3, [6])]


def test_words_and_hashes():
    column = pa.array(["ab cd", None, "", "cd", "ab" * 300000 + " cd"])
    data, offsets = common.utf8(column)
    starts, ends = hashing.word_bounds(data, offsets, hashing.NOT_SPACE)
    assert [data[a:b].tobytes() for a, b in zip(starts[:3], ends[:3])] == [b"ab", b"cd", b"cd"]
    h = hashing.word_hashes(data, starts, ends)
    assert h[1] == h[2] == h[4] and len(set(h.tolist())) == 3
    sliced = common.utf8(column.slice(3, 2))
    assert sliced[1][1] == 2 and sliced[0][:2].tobytes() == b"cd"


def test_every_operator_has_its_query():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)

import numpy as np

from tests.llm.test_common import brute_components
from tidemark.llm import common, vectors


def brute(rows):
    sound = [i for i, (k, v, l) in enumerate(rows) if k is not None and l is not None and v
             and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    edges, links = [], {i: 0 for i in range(len(rows))}
    for i in sound:
        for j in sound:
            if j < i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float64), np.array(rows[j][1], np.float64)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                    edges.append((i, j))
                    links[i] += 1
                    links[j] += 1
    group = brute_components(edges)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            g = group.get(i, i)
            least[g] = min(k, least.get(g, k))
    out = []
    for i, (k, _, _) in enumerate(rows):
        low = least.get(group.get(i, i)) if k is not None else None
        out.append((k, links[i], low, None if k is None else k == low))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in vectors.near_duplicates(df).collect()), key=str)


def frame(spark, rows):
    return common.prepare(spark).createDataFrame(
        [(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")


def clustered(rng, groups, size, dims, noise):
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dims)
        for _ in range(size):
            rows.append((len(rows), (centre + noise * rng.normal(size=dims)).astype(np.float32).tolist(), g % 3))
    return rows


def test_clusters_against_brute_force(spark):
    rows = clustered(np.random.default_rng(4), 40, 8, 64, 0.25)
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(5)] + [(2000, rows[0][1], 99)]
    want, got = brute(rows), found(frame(spark, rows))
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert sum(a == b for a, b in zip(got, want)) >= 0.98 * len(want)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(6)
    x, z = (vectors.unit(rng.normal(size=(2000, 64))) for _ in range(2))
    z = vectors.unit(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.93 * x + np.sqrt(1 - 0.93 ** 2) * z
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(vectors.filters(x), vectors.filters(y))]
    assert np.mean(met) >= 0.995


def test_unsound_vectors_link_with_nothing(spark):
    v = [1.0] * 8
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, None, 1), (4, [0.0] * 8, 1), (5, [float("nan")] + v[1:], 1), (6, [None] + v[1:], 1),
            (7, [float("inf")] + v[1:], 1), (8, v, None), (None, v, 1), (9, [], 1), (10, [2.0] * 8, 1), (11, v[:4], 1), (12, [-1.0] * 8, 1),
            (13, [1e38] * 8, 1), (14, [1e-38] * 8, 1)]
    assert found(frame(spark, rows)) == brute(rows)
    assert found(frame(spark, [])) == []


def test_recall_on_the_table(spark):
    df = common.table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    by = {}
    for k, v, l in rows:
        by.setdefault(l, []).append((k, np.array(v, np.float64)))
    want = 0
    for own in by.values():
        m = np.stack([v / np.linalg.norm(v) for _, v in own])
        want += int((m @ m.T >= 0.93).sum()) - len(own)
    got = sum(r.n_links for r in vectors.near_duplicates(df).collect())
    assert 0.98 * want <= got <= want


def test_shards_of_a_bucket_add_up():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    points = rng.normal(size=(4, 8)).repeat(10, axis=0) + 0.1 * rng.normal(size=(40, 8))
    passed = [sorted([7, *rng.choice([x for x in range(12) if x != 7], 3, replace=False).tolist()]) for _ in range(40)]
    whole, parts = {}, {}
    for into, pairs, shard in ((whole, [(0, 0)], np.zeros(40, int)), (parts, [(0, 0), (0, 1), (1, 1)], np.arange(40) % 2)):
        for left, right in pairs:
            own = np.flatnonzero((shard == left) | (shard == right))
            table = pa.table({"space": [0] * len(own), "filter": [7] * len(own), "left": [left] * len(own), "right": [right] * len(own),
                              "shard": shard[own], "node": own, "copies": np.ones(len(own), np.int64),
                              "vector": pa.array(points[own].tolist()), "filters": pa.array([passed[i] for i in own], pa.list_(pa.int32()))})
            for node, links, _ in zip(*(vectors._bucket(table, 0.93) or ((), (), ()))):
                into[int(node)] = into.get(int(node), 0) + int(links)
    assert whole and whole == parts

import random
import re

import xxhash

from tests.llm.conftest import MESSY
from tests.llm.test_common import brute_components
from tidemark.llm import simhash


def brute_fingerprint(text, words=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not own:
        return 0
    grams = [" ".join(own[i:i + words]) for i in range(max(1, len(own) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, words=4, radius=4):
    prints = [brute_fingerprint(t, words) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    group = brute_components(edges)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            g = group.get(i, i)
            least[g] = min(k, least.get(g, k))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    return sorted(((k, s, least.get(group.get(i, i))) for i, ((k, _), s) in enumerate(zip(rows, signed))), key=str)


def found(df, **more):
    return sorted((tuple(r)[:3] for r in simhash.near_duplicates(df, **more).collect()), key=str)


def test_query_rows(documents, texts):
    assert found(documents) == brute(texts)


def test_messy_rows(messy, empty):
    assert found(messy) == brute(MESSY)
    assert found(messy, words=5) == brute(MESSY, 5)
    assert found(empty) == []


def test_one_row_of_each_group_stays(messy, empty):
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns
    groups = {}
    for k, _, c in brute(MESSY):
        groups.setdefault(c, []).append(k)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    # Texts without words are one group, the row without a key but with words one of its own.
    assert sorted(rows, key=str) == sorted(
        [(1, MESSY[0][1]), (3, None), (6, "word"), (None, "a row without a key"), (7, MESSY[9][1]), (8, MESSY[10][1]), (10, MESSY[12][1]),
         (11, MESSY[13][1]), (12, MESSY[14][1])], key=str)
    assert simhash.keep_one(empty).count() == 0


def test_majority_over_many_hashes():
    rng = random.Random(1)
    import numpy as np

    for n in (1, 2, 255, 256, 255 * 256 + 3):
        hashes = [rng.getrandbits(64) for _ in range(n)]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)
        assert simhash.majority(np.array(hashes, np.uint64)) == want


def test_tree_finds_all_within_the_radius():
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(100)]
    values += [v ^ sum(1 << rng.randrange(64) for _ in range(k)) for v in values[:50] for k in (0, 2, 4, 5)]
    tree = simhash.Tree()
    for v in values:
        tree.add(v)
    for v in values:
        want = [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 4]
        assert sorted(tree.near(v, 4)) == want
    assert simhash.Tree().near(1, 4) == []


def test_shards_of_a_large_group_find_the_links_of_the_whole():
    rng = random.Random(3)
    own = [(i, rng.getrandbits(64) if i % 3 else 1 << (i % 60), i % 2) for i in range(60)]
    edges = [(a, b) for a, x, _ in own for b, y, _ in own if b < a and (x ^ y).bit_count() <= 4]
    got = []
    for left, right in ((0, 0), (0, 1), (1, 1)):
        got += simhash._forest([r for r in own if r[2] in (left, right)], left, right, 4)
    assert brute_components(got) == brute_components(edges)


def shingles(text, words=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(own[i:i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_similar(rows):
    """The rows that stay: of each group linked by a similarity of 0.8 or more that with the smallest key, then any one."""
    sets = [shingles(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    group, kept = brute_components(edges), {}
    for i, (k, _) in enumerate(rows):
        kept.setdefault(group.get(i, i), []).append((k is None, k or 0, i))
    return [rows[min(g)[2]] for g in kept.values()]


def edited(rng, own, changes):
    own = list(own)
    for _ in range(changes):
        own[rng.randrange(len(own))] = f"new{rng.randrange(10**9)}"
    return own


def test_similar_texts_are_found_in_every_band(spark):
    rng = random.Random(4)
    rows, pairs = [], []
    for length in (60, 100, 300, 1000):
        for k in range(150):
            own = [f"w{rng.randrange(20000)}" for _ in range(length)]
            # Each change takes up to five shingles away on both sides.
            other = edited(rng, own, 1 + rng.randrange(max(1, length // 30)))
            a, b = len(rows), len(rows) + 1
            rows += [(a, " ".join(own)), (b, " ".join(other))]
            pairs.append((a, b, jaccard(shingles(rows[a][1]), shingles(rows[b][1]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.keep_one_similar(docs).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        own = [(a, b) for a, b, j in pairs if low <= j < high]
        assert len(own) >= 30
        found = sum(b not in kept for _, b in own) / len(own)
        print(low, len(own), found)
        assert found >= 0.97
    assert all(a in kept for a, _, _ in pairs)
    assert all(b in kept for _, b, j in pairs if j < 0.8)


def test_one_row_of_each_similar_group_stays(spark, messy, empty, texts):
    kept = simhash.keep_one_similar(messy)
    assert kept.columns == messy.columns
    rows = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert rows == sorted(brute_similar(MESSY), key=str)
    assert simhash.keep_one_similar(empty).columns == empty.columns and simhash.keep_one_similar(empty).count() == 0


def test_groups_in_several_shards_are_one(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_SHINGLES", 500)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 7)
    rng = random.Random(5)
    rows = []
    for group in range(3):
        own = [f"g{group}w{i}" for i in range(100)]
        rows += [" ".join(edited(rng, own, 1)) for _ in range(40)] + [" ".join(own)] * 20
    # A chain: neighbours are alike, its ends are not.
    chain = [f"c{i}" for i in range(100)]
    for k in range(10):
        rows.append(" ".join(chain))
        chain[10 * k] = f"changed{k}"
    rows = list(enumerate(rows)) + [(None, rows[0])] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one_similar(docs).collect()) == sorted(brute_similar(rows))
    classes = simhash.similar(docs).groupBy("class").count().count()
    assert classes == len(brute_similar(rows))


def test_alike_is_exact():
    rng = random.Random(6)
    import numpy as np

    sets = []
    for _ in range(100):
        a = {rng.randrange(60) for _ in range(1 + rng.randrange(40))}
        sets += [a, {x for x in a if rng.random() < 0.9} | {rng.randrange(60) for _ in range(1 + rng.randrange(3))}]
    group = simhash.Alike([np.array(sorted(s), np.uint64) for s in sets])
    for i, a in enumerate(sets):
        want = [j for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)]
        assert group.among(i, np.arange(len(sets))).tolist() == want
    assert group.among(0, np.empty(0, np.int64)).tolist() == []

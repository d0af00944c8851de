import itertools
import time
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.conftest import MESSY
from tidemark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference_pieces(rows):
    own = Tokenizer.from_file(PATH)
    out = []
    for key, text in rows:
        ids = np.array(own.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        out += [(key, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return sorted(out, key=str)


def check(rows, got):
    assert sorted((tuple(r)[:5] for r in got), key=str) == reference_pieces(rows)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins)


def test_query_rows(documents, texts):
    got = packing.pack(documents, PATH).collect()
    bins = check(texts, got)
    assert bins <= 1.01 * sum(r.length for r in got) / 1024 + 1


def test_messy_rows(messy, empty):
    got = packing.pack(messy, PATH).collect()
    check(MESSY, got)
    assert packing.pack(empty, PATH).count() == 0


def test_tokens_are_the_tokenizers(texts):
    own = Tokenizer.from_file(PATH)
    for text in [t for _, t in texts] + ["<|endoftext|> a", "\u0085 x y z", "don't  stop\n\n it's 3²  ½", "漢字かな\U0001f600", "a" * 50000]:
        assert packing.encode(text, PATH).tolist() == own.encode(text, add_special_tokens=False).ids


def best(sizes, room):
    """Fewest bins, by search."""
    sizes = sorted(sizes, reverse=True)
    for n in range(1, len(sizes) + 1):
        def place(i, bins):
            if i == len(sizes):
                return True
            for b in range(len(bins)):
                if bins[b] + sizes[i] <= room and bins[b] not in bins[:b]:
                    if place(i + 1, bins[:b] + [bins[b] + sizes[i]] + bins[b + 1:]):
                        return True
            return False
        if place(0, [0] * n):
            return n
    return 0


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(8)
    for _ in range(250):
        room = int(rng.integers(6, 25))
        sizes = rng.integers(1, room + 1, int(rng.integers(1, 9))).tolist()
        counts = np.bincount(sizes, minlength=room + 1)
        plan = packing.Plan()
        packing.reduce(counts, room, plan)
        rest = list(itertools.chain.from_iterable([s] * int(n) for s, n in enumerate(counts) if s))
        assert plan.bins + best(rest, room) == best(sizes, room), (sizes, room)


def test_plans_place_every_piece_once():
    rng = np.random.default_rng(9)
    for _ in range(200):
        room = int(rng.integers(4, 80))
        sizes = rng.integers(1, room + 1, int(rng.integers(0, 300)))
        counts = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
        plan, seen = packing.plan_bins(counts, room), {}
        for n, content in plan.groups:
            assert n > 0 and sum(s * m for s, m in content) <= room
            for s, m in content:
                seen[s] = seen.get(s, 0) + n * m
        assert seen == counts
        ranks = [(s, r) for s, r, *_ in plan.places().tolist()]
        assert ranks == sorted(ranks) and {s for s, r in ranks if r == 0} == set(counts)


def test_the_planner_is_bounded_by_the_histogram():
    for counts in ({400: 10**9}, {400: 10**9 + 1, 90: 3}, {1024: 10**10, 300: 10**9, 500: 7}, {s: 10**8 + s for s in range(1, 1025)}):
        began = time.perf_counter()
        plan = packing.plan_bins(counts)
        assert time.perf_counter() - began < 5 and len(plan.groups) < 6000
        assert sum(n * m * s for n, content in plan.groups for s, m in content) == sum(s * n for s, n in counts.items())
    plan = packing.plan_bins({400: 10**9})
    assert plan.bins == 5 * 10**8 and len(plan.groups) <= 3


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)] and packing.cut(2048) == [(0, 1024), (1024, 1024)]
    assert packing.cut(2050) == [(0, 2), (2, 1024), (1026, 1024)]


def test_added_tokens_are_the_tokenizers_own(spark):
    own = Tokenizer.from_file(PATH)
    rows = [(0, "a <|endoftext|> b"), (1, "<|endoftext|>" * 3), (2, "漢 <|endoftext|>\n<|endoftext"), (3, "a <|endoftext| > b")]
    for _, text in rows:
        assert packing.encode(text, PATH).tolist() == own.encode(text, add_special_tokens=False).ids
    assert 50256 in packing.encode(rows[0][1], PATH)
    got = {r.doc_id: r.length for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    assert got == {k: len(own.encode(t, add_special_tokens=False).ids) + 1 for k, t in rows}

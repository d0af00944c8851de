import itertools

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import MESSY
from tidemark.llm import mixing


def goals(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by resharing the excess until no source is over its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in full}
        left = total - sum(full.values())
        got = full | {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s for s in rest if got[s] > most * sizes[s]}
        if not over:
            return got
        full |= {s: float(most * sizes[s]) for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 7, None: 500, "é": 0}, {"x": 5}, {None: 3},
    {f"s{i}": (i * 7919) % 500 for i in range(40)}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(goals(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))


def check(served, rows):
    served = sorted(served, key=lambda r: r.place)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    goal = goals(sizes)
    budget = int(1.5 * sum(sizes.values()))
    assert [r.place for r in served] == list(itertools.accumulate((r.words for r in served[:-1]), initial=0))
    assert sorted(served, key=lambda r: r.finish) == served
    assert [r.taken for r in served] == [max(0, min(r.words, budget - r.place)) for r in served]
    own = {}
    for r in served:
        own.setdefault(r.row, []).append(r)
    assert len(own) == len(rows)
    for parts in own.values():
        assert sum(r.words for r in parts) == 2 * parts[0].size
        assert sum(r.taken for r in parts) <= 2 * parts[0].size
        first = {}
        for r in sorted(parts, key=lambda r: (r.serving, r.first)):
            assert r.first == first.get(r.serving, 0)
            first[r.serving] = r.first + r.words
    for source, size in sizes.items():
        taken = sum(r.taken for r in served if r.source == source)
        assert abs(taken - goal[source]) <= len(sizes) and {r.source_size for r in served if r.source == source} == {size}
    return {k: sum(r.taken for r in v) for k, v in own.items()}


def test_query_rows(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    served = mixing.mix(documents)
    check(served.collect(), rows)
    total = mixing.taken(served).agg(F.sum("taken"), F.count("*")).first()
    assert total[1] == len(rows) and total[0] == int(1.5 * sum(len(t.encode().split()) for _, t, _ in rows))


def test_messy_rows(spark, messy, empty):
    sources = ["a", None, "b", "", "é"]
    rows = [(k, t, sources[i % 5]) for i, (k, t) in enumerate(MESSY)] + [(1, "one two three", "hot")] * 40 + [(None, "x y", None)] * 40
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id long, text string, source string, row int, size int, place string")
    check(mixing.mix(df).collect(), rows)
    assert mixing.mix(empty).count() == 0 and mixing.taken(mixing.mix(empty)).count() == 0
    blank = mixing.taken(mixing.mix(messy.filter("doc_id = 3").withColumn("source", F.lit(None).cast("string")))).collect()
    assert [tuple(r) for r in blank] == [(3, None, 0, 0, 0.0, 0)]


def test_reruns_and_layout_agree(documents):
    def got(df):
        return sorted(map(tuple, mixing.taken(mixing.mix(df)).collect()))

    assert got(documents) == got(documents.repartition(13, "text"))


def test_other_weights(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    got = mixing.taken(mixing.mix(df, weights=(1,), share=0.5, most=1)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 3 for r in got)

import itertools
import random

import pytest

from tidemark.operators import vote


def brute(closes: dict[str, float], tol: float):
    """Largest mutually agreeing strict majority by exhaustive search."""

    def scale(a, b):
        return max(abs(a), abs(b), 1e-9)

    def spread(group):
        values = [closes[s] for s in group]
        return (max(values) - min(values)) / scale(max(values), min(values))

    names = sorted(closes)
    for size in range(len(names), len(names) // 2, -1):
        good = [g for g in itertools.combinations(names, size)
                if all(abs(closes[a] - closes[b]) <= tol * scale(closes[a], closes[b]) for a, b in itertools.combinations(g, 2))]
        if good:
            winner = min(good, key=lambda g: (spread(g), g))
            price = sorted(closes[s] for s in winner)[len(winner) // 2]
            return ("ok" if size == len(names) else "majority"), price, winner
    return "quarantined", None, None


def frame(spark, groups):
    data = [(symbol, source, close) for symbol, closes in groups.items() for source, close in closes.items()]
    return spark.createDataFrame(data, "symbol string, source string, close double").selectExpr("*", "date'2024-01-02' AS ts")


@pytest.mark.parametrize("closes, status, price", [
    ({"a": 100.0, "b": 100.05}, "ok", 100.05),
    ({"a": 100.0}, "ok", 100.0),
    ({"a": 100.0, "b": 90.0}, "quarantined", None),
    ({"a": 100.0, "b": 100.01, "c": 90.0}, "majority", 100.01),
    ({"a": 100.0, "b": 110.0, "c": 120.0}, "quarantined", None),
    ({"a": 0.0, "b": 0.0}, "ok", 0.0),
    ({"a": 1000.0, "b": 999.0}, "ok", 1000.0),  # exactly at the tolerance
    ({"a": 1000.0, "b": 998.9}, "quarantined", None),
    ({"a": 100.0, "b": float("nan"), "c": None, "d": float("inf")}, "ok", 100.0),
    ({"a": None}, "quarantined", None),
])
def test_single_day(spark, closes, status, price):
    row = vote.ballots(frame(spark, {"X": closes})).first()
    assert (row["status"], row["close"]) == (status, price)


def test_unreported_day_has_no_sources(spark):
    assert vote.ballots(frame(spark, {"X": {"a": float("nan")}})).first()["n_sources"] == 0


def test_random_votes_equal_exhaustive_search(spark):
    rnd = random.Random(20240102)
    groups = {}
    for i in range(1500):
        base = rnd.choice([1.0, -1.0]) * rnd.uniform(0.5, 500)
        n = rnd.randint(1, 6)
        groups[f"S{i}"] = {
            f"v{j}": rnd.choice([base, base * (1 + rnd.uniform(-0.02, 0.02)), base * rnd.uniform(0.5, 1.5), 0.0])
            for j in range(n)
        }
    got = {r["symbol"]: r for r in vote.ballots(frame(spark, groups), 0.01).collect()}
    statuses = set()
    for symbol, closes in groups.items():
        status, price, winner = brute(closes, 0.01)
        row = got[symbol]
        statuses.add(status)
        assert (row["status"], row["close"], row["n_sources"]) == (status, price, len(closes)), closes
        if winner:
            assert sorted(w["source"] for w in row["winners"]) == list(winner)
    assert statuses == set(vote.STATUSES)


def test_dissent_events(spark):
    v = vote.ballots(frame(spark, {"M": {"a": 1.0, "b": 1.0, "c": 2.0}, "Q": {"a": 1.0, "b": 2.0}, "K": {"a": 1.0}}))
    e = {r["symbol"]: r for r in vote.dissent_events(v).collect()}
    assert set(e) == {"M", "Q"}
    assert (e["M"]["kind"], e["M"]["agreeing"], e["M"]["dissenting"]) == ("reconcile.majority", ["a", "b"], ["c"])
    assert (e["Q"]["kind"], e["Q"]["agreeing"], e["Q"]["closes"]) == ("reconcile.quarantine", None, {"a": 1.0, "b": 2.0})


def test_counts_are_zero_filled(spark):
    row = vote.verdict_counts(vote.ballots(frame(spark, {"K": {"a": 1.0}}))).first()
    assert (row["ok"], row["majority"], row["quarantined"], row["quarantine_rate"]) == (1, 0, 0, 0.0)


@pytest.mark.parametrize("tol", [-0.1, 1.0, float("nan")])
def test_bad_tolerance(tol):
    with pytest.raises(ValueError):
        vote.check_tolerance(tol)

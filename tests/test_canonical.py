import datetime as dt
import random

import pytest

from tidemark.operators import canonical


def series(spark, closes, sources=2, status="ok"):
    """closes: list of (symbol, day number, close)."""
    data = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=d), c, sources, status, dt.datetime(2024, 1, 1)) for s, d, c in closes]
    return spark.createDataFrame(data, "symbol string, ts date, close double, n_sources long, status string, batch_ts timestamp")


@pytest.mark.parametrize("closes, kept", [
    ([10, 11, 12], 3),
    ([10, 60, 61], 2),          # up more than five times
    ([60, 10, 11], 2),          # down
    ([10, 50, 51], 3),          # exactly five times is no break
    ([50, 10, 11], 3),
    ([10, 60, 61, 400, 401], 2),  # the last break decides
    ([10, 0, 11], 3),           # an unusable close forms no ratio
])
def test_break_truncation(spark, closes, kept):
    df = series(spark, [("X", i, float(c)) for i, c in enumerate(closes)])
    assert canonical.read_canonical(df).count() == kept


def test_newest_verdict_wins_before_status_filter(spark):
    first = series(spark, [("X", 0, 10.0), ("X", 1, 10.0)])
    later = series(spark, [("X", 1, None)], status="quarantined").selectExpr(
        "symbol", "ts", "close", "n_sources", "status", "batch_ts + interval 1 day AS batch_ts")
    assert [r["ts"].day for r in canonical.read_canonical(first.union(later)).collect()] == [1]


def test_min_sources(spark):
    df = series(spark, [("X", 0, 10.0)], sources=1)
    assert canonical.read_canonical(df).count() == 0
    assert canonical.read_canonical(df, min_sources=1).count() == 1


def test_window_equals_filter_of_full_read(spark, day, rows):
    rnd = random.Random(3)
    data, level = [], 20.0
    for i in range(60):
        level *= rnd.choice([1.0, 1.01, 0.99]) if i not in (5, 31, 50) else rnd.choice([7.0, 1 / 7.0])
        data.append(("X", i, level))
    df = series(spark, data)
    cols = ("symbol", "ts", "close")
    for start, end in [(10, 40), (31, 45), (32, 49), (0, 59), (45, 55)]:
        full = [r for r in rows(canonical.read_canonical(df, end=day(end)), *cols) if r[1] >= day(start)]
        assert rows(canonical.read_canonical(df, start=day(start), end=day(end)), *cols) == full


def test_panel_equals_truncation_at_each_date(spark, day, rows):
    rnd = random.Random(11)
    data = []
    for s in range(20):
        level = 20.0
        for i in range(40):
            level *= rnd.choice([1.0, 1.02, 0.98, 1.0, 6.0, 1 / 6.0] if rnd.random() < 0.2 else [1.0, 1.01])
            if rnd.random() < 0.9:
                data.append((f"S{s}", i, level))
    df = series(spark, data).cache()
    panel = canonical.canonical_panel(df).collect()
    for asof in (0, 7, 20, 39):
        seen = sorted((r["symbol"], r["ts"]) for r in panel
                      if r["ts"] <= day(asof) and (r["next_break"] is None or r["next_break"] > day(asof)))
        assert seen == rows(canonical.read_canonical(df, end=day(asof)), "symbol", "ts")


def test_later_rows_change_nothing_before(spark, day, rows):
    df = series(spark, [("X", i, 10.0 + i) for i in range(5)])
    more = df.union(series(spark, [("X", 9, 1000.0)]))
    cols = ("symbol", "ts", "close")
    assert rows(canonical.read_canonical(df, end=day(4)), *cols) == rows(canonical.read_canonical(more, end=day(4)), *cols)


@pytest.mark.parametrize("kwargs", [{"min_sources": 0}, {"max_jump": 1.0}, {"max_jump": float("inf")}])
def test_bad_arguments(spark, kwargs):
    with pytest.raises(ValueError):
        canonical.read_canonical(series(spark, []), **kwargs)


def test_empty_symbol_list_matches_nothing(spark):
    df = series(spark, [("X", 0, 1.0)])
    assert canonical.read_canonical(df, symbols=[]).count() == 0
    assert canonical.read_canonical(df, symbols=None).count() == 1

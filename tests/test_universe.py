"""Windowed medians of the liquidity screen."""

import datetime as dt
import random
import statistics as st

import pytest

from tidemark.operators import signals, universe

DAY = dt.date(2020, 1, 1)


def on(n):
    return DAY + dt.timedelta(days=n)


def made(spark, seed, days=400, symbols=5):
    rnd = random.Random(seed)
    closes, volumes = [], []
    for s in range(symbols):
        marks = sorted(rnd.sample(range(30, days), 3)) if s % 2 else []
        for d in range(days):
            if rnd.random() < 0.3:
                continue
            following = next((m for m in marks if m > d), None)
            value = rnd.choice([None, float("nan"), rnd.uniform(4, 7)]) if rnd.random() < 0.1 else rnd.uniform(4, 7)
            closes.append((f"S{s}", on(d), value, None if following is None else on(following)))
            for _ in range(rnd.randint(0, 3)):
                volumes.append((f"S{s}", on(d), rnd.choice([None, 150_000.0, 200_000.0, 250_000.0, rnd.uniform(1e5, 4e5)])))
    return (closes, volumes, spark.createDataFrame(closes, "symbol string, ts date, close double, next_break date").repartition(3),
            spark.createDataFrame(volumes, "symbol string, ts date, volume double").repartition(3))


def usable(x):
    return x is not None and x == x


def brute(closes, volumes, asofs, lookback, min_price=5.0, min_adv=1_000_000.0):
    out = {}
    for a in asofs:
        low = a - dt.timedelta(days=lookback)
        for s in {c[0] for c in closes}:
            c = [v for x, t, v, b in closes if x == s and low <= t <= a and (b is None or a < b) and usable(v)]
            v = [v for x, t, v in volumes if x == s and low <= t <= a and usable(v)]
            if c and v and st.median(c) > min_price and st.median(c) * st.median(v) > min_adv:
                out[a, s] = (st.median(c), st.median(v))
    return out


@pytest.mark.parametrize("lookback, step", [(63, 30), (63, 1), (1, 7), (10, 3), (500, 90)])
def test_medians_of_all_windows(spark, lookback, step):
    closes, volumes, panel, bars = made(spark, lookback + step)
    asofs = [on(d) for d in range(-5, 470, step)]
    got = universe.liquid_at(panel, bars, signals.asof_frame(spark, asofs * 2), lookback_days=lookback).collect()
    assert len({(r["asof"], r["symbol"]) for r in got}) == len(got)
    want = brute(closes, volumes, asofs, lookback)
    assert {(r["asof"], r["symbol"]): (r["med_close"], r["med_vol"]) for r in got} == {k: pytest.approx(v) for k, v in want.items()}
    assert want


def moved(spark, frame):
    """Rows that go through the exchanges by symbol."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if name == "Exchange" and "symbol" in node.simpleString(100):
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_what_is_shuffled_does_not_grow_with_the_dates(spark):
    _, _, panel, bars = made(spark, 1)
    monthly = universe.liquid_at(panel, bars, signals.asof_frame(spark, [on(d) for d in range(0, 400, 30)]))
    daily = universe.liquid_at(panel, bars, signals.asof_frame(spark, [on(d) for d in range(400)]))
    few, many = moved(spark, monthly), moved(spark, daily)
    assert 0 < few == many


def test_empty_frames(spark):
    _, _, panel, bars = made(spark, 2, days=40, symbols=1)
    dates = signals.asof_frame(spark, [on(10)])
    assert universe.liquid_at(panel.limit(0), bars, dates).count() == 0
    assert universe.liquid_at(panel, bars.limit(0), dates).count() == 0
    assert universe.liquid_at(panel, bars, dates.limit(0)).count() == 0

import datetime as dt
import math
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tidemark.functions import costs
from tidemark.operators import longshort, lots, portfolio, statistics
from tidemark.operators.market import cost_inputs, market_frame

D = dt.date


def closes(spark, data):
    return spark.createDataFrame([(s, d, float(c)) for s, d, c in data], "symbol string, ts date, close double")


def scores(spark, data):
    return spark.createDataFrame([(a, s, None if v is None else float(v)) for a, s, v in data], "asof date, symbol string, score double")


JAN, FEB, MAR = D(2020, 1, 31), D(2020, 2, 28), D(2020, 3, 31)


def test_long_short_with_exit_dividend_and_missing_price(spark):
    data = [("A", JAN, 10), ("A", FEB, 11), ("B", JAN, 10), ("B", FEB, 10), ("C", JAN, 10), ("D", JAN, 10),
            ("D", D(2020, 2, 10), 0.5), ("X", JAN, 10), ("X", FEB, 10), ("Y", JAN, 10), ("Y", FEB, 10)]
    s = scores(spark, [(JAN, "A", 6), (JAN, "C", 5), (JAN, "X", 3), (JAN, "Y", 3), (JAN, "D", 2), (JAN, "B", 1),
                       (JAN, "NOPRICE", 99), (JAN, "A", 0), (JAN, "NAN", float("nan")), (JAN, "NULL", None)])
    paid = spark.createDataFrame([("B", JAN, 5.0), ("B", D(2020, 2, 3), 1.0), ("B", FEB, 1.0), ("B", D(2020, 3, 1), 7.0)],
                                 "symbol string, ex_date date, rate double")
    got = longshort.monthly_longshort(closes(spark, data), s, 3, dividends=paid).collect()
    long = 11 / 10 - 1  # C vanished right after formation and is dropped
    short = ((10 + 2) / 10 - 1 + 0.5 * 0.7 / 10 - 1) / 2
    assert [(r["month"], pytest.approx(r["ret_ls"])) for r in got] == [(D(2020, 2, 1), long - short)]


def test_too_few_names_or_an_empty_leg_skip_the_month(spark):
    data = [("A", JAN, 10), ("A", FEB, 11), ("B", JAN, 10), ("A", MAR, 11)]
    s = scores(spark, [(JAN, "A", 2), (JAN, "B", 1)])
    assert longshort.monthly_longshort(closes(spark, data), s, 3).count() == 0
    assert longshort.monthly_longshort(closes(spark, data), s, 2).count() == 0


def test_universe_filter_and_ties_by_symbol(spark, rows):
    s = scores(spark, [(JAN, c, 1) for c in "DCBA"])
    assert rows(longshort.bucket_legs(longshort.clean_scores(s), 2), "symbol", "leg") == [
        ("A", "short"), ("B", "short"), ("C", "long"), ("D", "long")]
    data = [(c, d, 10 + i) for i, c in enumerate("ABCD") for d in (JAN, FEB)]
    only = spark.createDataFrame([(JAN, "A"), (JAN, "D")], "asof date, symbol string")
    members = longshort.leg_members(closes(spark, data), s, 2, universe=only)
    assert rows(members, "symbol", "leg") == [("A", "short"), ("D", "long")]


def test_sharpe(spark):
    def of(values):
        df = spark.createDataFrame([(v,) for v in values], "r double")
        return statistics.sharpe(df, "r").first()["sharpe"]

    assert of([0.01, 0.02, None, float("nan"), 0.03]) == pytest.approx(0.02 / 0.01 * math.sqrt(12))
    assert of([0.01] * 12) == 0.0 and of([0.01]) == 0.0 and of([]) == 0.0
    with pytest.raises(ValueError):
        statistics.sharpe(spark.createDataFrame([], "r double"), "r", 0)


def test_pearson(spark):
    def frame(name, values):
        return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"month int, {name} double")

    a = frame("ret_ls", [1.0, 2.0, 3.0, 4.0, float("nan")])
    assert statistics.pearson(a, frame("ret", [2.0, 4.0, 6.0, 8.0, 1.0])).first().asDict() == {"rho": pytest.approx(1.0), "n": 4}
    assert statistics.pearson(a, frame("ret", [1.0] * 5)).first().asDict() == {"rho": 0.0, "n": 4}
    assert statistics.pearson(a, frame("ret", [1.0, 2.0])).first().asDict() == {"rho": 0.0, "n": 2}
    twice = frame("ret", [1.0, 2.0, 3.0])
    with pytest.raises(Exception, match="duplicate month"):
        statistics.pearson(a, twice.union(twice)).collect()
    report = statistics.calibration_report(a, frame("ret", [2.0, 4.0, 6.0, 8.0]), "Mom").first()
    assert (report["n_months"], report["pass"], report["mean_ours"]) == (4, True, 2.5)


def test_equity_returns(spark, rows):
    df = spark.createDataFrame([(1, 100.0), (2, 110.0), (3, 0.0), (4, 5.0)], "ts int, equity double")
    got = [r["ret_net"] for r in statistics.equity_returns(df).orderBy("ts").collect()]
    assert got == [None, pytest.approx(0.1), -1.0, None]


def test_costs(spark):
    df = spark.createDataFrame([(100.0, -50.0, 1e6, 0.02), (100.0, 0.0, 1e6, 0.02), (10.0, 10.0, 0.0, 0.5)], "p double, q double, adv double, s double")
    model = costs.CostModel("v1", 0.1, 5.0)
    got = [r[0] for r in df.select(model.estimate(F.col("p"), F.col("q"), F.col("adv"), F.col("s"))).collect()]
    assert got == [pytest.approx(5000 * (2.5e-4 + 0.1 * 0.02 * math.sqrt(5000 / 1e6))), 0.0, pytest.approx(100 * (2.5e-4 + 0.05 * 10))]
    with pytest.raises(ValueError):
        costs.CostModel(" ")
    assert costs.current_model().version == costs.COST_VERSION


@pytest.mark.parametrize("st, lt, due", [(-100, 50, 0), (100, 0, 35), (0, 100, 15), (-50, 100, 7.5), (100, -50, 17.5), (10, 20, 6.5)])
def test_tax(spark, st, lt, due):
    df = spark.createDataFrame([(float(st), float(lt))], "st double, lt double")
    assert df.select(costs.tax_due(F.col("st"), F.col("lt"))).first()[0] == pytest.approx(due)


def fills(spark, data):
    """data: (account, symbol, day, seq, side, qty, price)."""
    return spark.createDataFrame([(a, s, d, i, side, float(q), float(p)) for a, s, d, i, side, q, p in data],
                                 "account int, symbol string, day date, seq int, side string, qty double, price double")


def test_lots_and_holding_period(spark):
    data = [(1, "X", D(2020, 1, 1), 0, "buy", 100, 10), (1, "X", D(2021, 6, 1), 0, "buy", 100, 20), (1, "X", D(2021, 7, 1), 0, "sell", 150, 30),
            (2, "Y", D(2021, 1, 1), 0, "buy", 1, 1), (2, "Y", D(2022, 1, 1), 0, "sell", 0.5, 2), (2, "Y", D(2022, 1, 2), 0, "sell", 0.5, 2)]
    tax = {(r["account"], r["year"]): (r["st"], r["lt"]) for r in lots.annual_tax(lots.match_lots(fills(spark, data))).collect()}
    assert tax == {(1, 2021): (500.0, 2000.0), (2, 2022): (0.5, 0.5)}  # 365 days is short-term, 366 long-term
    assert [(r["account"], r["qty"]) for r in lots.held(fills(spark, data)).collect()] == [(1, 50.0)]


@pytest.mark.parametrize("rows_per_bucket", [100_000, 7])
def test_lots_equal_a_queue(spark, rows_per_bucket):
    rnd = random.Random(17)
    data, want, queues = [], defaultdict(float), defaultdict(deque)
    for i in range(1500):
        # One book holds most of the fills.
        book = (1, "HOT") if rnd.random() < 0.7 else (rnd.randint(1, 3), rnd.choice("AB"))
        day = D(2020, 1, 1) + dt.timedelta(days=i // 10)
        queue, qty = queues[book], rnd.choice([1, 2.5, 10, 0.3, 400])
        held = sum(q[1] for q in queue)
        side = "sell" if held > qty and rnd.random() < 0.5 else "buy"
        price = rnd.randint(1, 100)
        data.append((*book, day, i, side, qty, price))
        if side == "buy":
            queue.append([i, qty])
            continue
        while qty > 1e-9:
            take = min(qty, queue[0][1])
            want[(*book, i, queue[0][0])] += take
            qty -= take
            queue[0][1] -= take
            if queue[0][1] <= 1e-9:
                queue.popleft()
    got = {(r["account"], r["symbol"], r["sell_seq"], r["buy_seq"]): r["qty"]
           for r in lots.match_lots(fills(spark, data), rows_per_bucket).collect()}
    big = {k: v for k, v in want.items() if v > 1e-6}
    assert {k for k, v in got.items() if v > 1e-6} == set(big)
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in big.items())


def test_oversell_and_order_are_reported(spark):
    data = [(1, "X", D(2020, 1, 5), 0, "buy", 10, 1), (1, "X", D(2020, 1, 1), 0, "sell", 4, 1), (1, "X", D(2020, 1, 9), 0, "sell", 8, 1)]
    df = fills(spark, data)
    assert sorted((r["qty"], r["out_of_order"]) for r in lots.match_lots(df).collect()) == [(4.0, True), (6.0, False)]
    assert [(r["day"], r["unmatched_qty"]) for r in lots.unmatched_sells(df).collect()] == [(D(2020, 1, 9), 2.0)]


def test_market_frame(spark):
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    c = closes(spark, [("X", d, 10 + i) for i, d in enumerate(days)])
    bars = spark.createDataFrame([("X", d, v) for i, d in enumerate(days[1:], 1) for v in (float(i), 3.0 * i, float("nan"))], "symbol string, ts date, volume double")
    got = {r["ts"]: r for r in cost_inputs(market_frame(c, bars)).collect()}
    assert got[days[0]]["adv"] == 1e6 and got[days[0]]["sigma"] == 0.02
    dollars = [(10 + i) * 2.0 * i for i in range(30)]
    window = sorted(dollars[10:30])
    assert got[days[29]]["adv"] == pytest.approx((window[9] + window[10]) / 2)
    rets = [(10 + i) / (9 + i) - 1 for i in range(10, 30)]
    mean = sum(rets) / 20
    assert got[days[29]]["sigma"] == pytest.approx(max(0.001, math.sqrt(sum((r - mean) ** 2 for r in rets) / 19)))


def test_targets_promote_the_next_name(spark, rows):
    days = [D(2020, 1, 30), JAN, D(2020, 2, 3), FEB, D(2020, 3, 2)]
    c = closes(spark, [(s, d, 10) for s in "ABC" for d in days if (s, d) != ("A", FEB)])
    s = scores(spark, [(d, x, v) for d in days for x, v in (("A", 3), ("B", 2), ("C", 1))])
    book = portfolio.targets(s, c, portfolio.Strategy("s", 2))
    assert rows(book, "asof", "fill_ts", "symbol", "weight") == [
        (days[0], JAN, "A", 0.5), (days[0], JAN, "B", 0.5), (JAN, days[2], "A", 0.5), (JAN, days[2], "B", 0.5),
        (FEB, days[4], "B", 0.5), (FEB, days[4], "C", 0.5)]


def test_rebalanced_series(spark):
    d0, d1, d2 = D(2020, 1, 2), D(2020, 2, 3), D(2020, 3, 2)
    c = closes(spark, [("A", d0, 10), ("A", d1, 20), ("A", d2, 20), ("B", d0, 10), ("B", D(2020, 1, 20), 5), ("C", d1, 10), ("C", d2, 11)])
    book = spark.createDataFrame([(d0, "A", 0.5), (d0, "B", 0.5), (d1, "A", 0.5), (d1, "C", 0.5)], "fill_ts date, symbol string, weight double")
    free = costs.CostModel("free", 0.0, 0.0)
    got = portfolio.rebalanced_series(book, c, free).orderBy("fill_ts").collect()
    assert [(r["fill_ts"], r["next_fill"], pytest.approx(r["gross"])) for r in got] == [(d0, d1, 0.25), (d1, d2, 0.05)]
    # The first book drifted to A 1.0/1.25 and B 0.25/1.25.
    assert got[1]["turnover"] == pytest.approx(abs(0.5 - 0.8) + 0.2 + 0.5)
    assert got[1]["nav"] == pytest.approx(1.25 * 1.05)
    paid = portfolio.rebalanced_series(book, c, costs.current_model()).orderBy("fill_ts").collect()
    assert paid[0]["net"] < got[0]["net"] and paid[0]["cost_model_version"] == costs.COST_VERSION


def test_drift_orders(spark):
    holdings = spark.createDataFrame([(1, "A", 10.0), (1, "B", 5.0), (1, "GONE", 3.0)], "account int, symbol string, qty double")
    book = spark.createDataFrame([(1, "A", 0.5), (1, "C", 0.5)], "account int, symbol string, weight double")
    cash = spark.createDataFrame([(1, 50.0)], "account int, cash double")
    prices = spark.createDataFrame([("A", 10.0), ("B", 10.0), ("C", 5.0)], "symbol string, close double")
    got = portfolio.drift_orders(holdings, book, cash, prices, 0.01).orderBy("side_rank", "symbol").collect()
    assert [(r["symbol"], r["side_rank"], r["delta"]) for r in got] == [("B", 0, -5.0), ("C", 1, 20.0)]


def test_left_panel(spark, rows):
    c = closes(spark, [("A", D(2020, 1, 1), 1), ("A", D(2020, 1, 2), 2), ("B", D(2020, 1, 3), 3)])
    h = spark.createDataFrame([(i, s, D(2020, 1, d), 1.0) for i in (1, 2) for s, d in (("A", 5), ("A", 2), ("B", 2), ("B", 9))],
                              "account int, symbol string, day date, qty double")
    assert rows(portfolio.left_panel(h, c), "account", "symbol", "day", "last_ts", "price") == [
        r for i in (1, 2) for r in ((i, "A", D(2020, 1, 5), D(2020, 1, 2), 2.0), (i, "B", D(2020, 1, 2), None, None),
                                    (i, "B", D(2020, 1, 9), D(2020, 1, 3), 3.0))]


@pytest.mark.parametrize("kwargs", [{"n_long": 0}, {"rebalance": "yearly"}, {"n_long": True}, {"name": " "}])
def test_strategy_is_checked(kwargs):
    with pytest.raises(ValueError):
        portfolio.Strategy(**({"name": "s", "n_long": 1} | kwargs))

import datetime as dt
import math
import statistics

import pytest

from tidemark.operators import canonical, facts, signals, universe
from tidemark.operators.calendar import holds, rebalance_days, trading_days

D = dt.date
FACTS = ("cik long, taxonomy string, tag string, unit string, start date, end date, val double, accn string, "
         "form string, filed date, seq long")


def fact(spark, data):
    """data: (cik, tag, start, end, val, accn, form, filed)."""
    return spark.createDataFrame(
        [(c, "us-gaap", t, "USD", s, e, None if v is None else float(v), a, f, d, i) for i, (c, t, s, e, v, a, f, d) in enumerate(data)], FACTS)


def tickers(spark, *pairs):
    return spark.createDataFrame(list(pairs), "cik long, symbol string")


def score(df):
    return {(r["asof"], r["symbol"]): r["score"] for r in df.collect()}


def panel(spark, closes):
    df = spark.createDataFrame(closes, "symbol string, ts date, close double").selectExpr("*", "2L AS n_sources", "'ok' AS status")
    return canonical.canonical_panel(df, newest=None)


def weekdays(n, first=D(2018, 1, 1)):
    out, d = [], first
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


def test_momentum_offsets(spark):
    days = weekdays(260)
    closes = [("UP", d, 100.0 + i) for i, d in enumerate(days)] + [("FLAT", d, 50.0) for d in days]
    closes += [("LATE", d, 10.0) for d in days[100:]] + [("GONE", d, 10.0) for d in days[:150]]
    asofs = signals.asof_frame(spark, [days[-1], days[250]])
    got = score(signals.momentum(panel(spark, closes), asofs, last=days[-1]))
    assert got == {
        (days[-1], "UP"): pytest.approx((100 + 260 - 21) / (100 + 260 - 252) - 1), (days[-1], "FLAT"): 0.0}
    # 251 days are one short of the lookback.
    assert all(asof == days[-1] for asof, _ in got)


def test_momentum_between_trading_days_and_past_only(spark):
    days = weekdays(300)
    closes = [("UP", d, 100.0 + i) for i, d in enumerate(days)]
    friday = next(d for d in days[255:] if d.weekday() == 4)
    saturday = friday + dt.timedelta(days=1)
    asofs = signals.asof_frame(spark, [friday, saturday])
    late = [c for c in closes if c[1] <= friday]
    a = score(signals.momentum(panel(spark, closes), asofs, last=days[-1]))
    b = score(signals.momentum(panel(spark, late), asofs, last=days[-1]))
    assert a == b and a[(friday, "UP")] == a[(saturday, "UP")]


def test_a_break_hides_the_far_price(spark):
    days = weekdays(260)
    closes = [("X", d, 10.0 if i < 200 else 100.0) for i, d in enumerate(days)] + [("Y", d, 5.0) for d in days]
    got = score(signals.momentum(panel(spark, closes), signals.asof_frame(spark, [days[-1]]), last=days[-1]))
    assert set(s for _, s in got) == {"Y"}


def test_days_that_a_break_hides_leave_the_grid(spark):
    day = {n: D(2021, 3, n) for n in range(1, 9)}
    # A is cut off from day 6 on; days 2 and 4 are A's alone.
    closes = [("A", day[n], 10.0 if n < 6 else 100.0) for n in day] + [("B", day[n], float(n)) for n in (1, 3, 5, 6, 7, 8)]
    df = spark.createDataFrame(closes, "symbol string, ts date, close double").selectExpr(
        "*", "CASE WHEN symbol = 'A' AND ts < DATE '2021-03-06' THEN DATE '2021-03-06' END AS next_break")
    asofs = signals.asof_frame(spark, [day[5], day[8]])
    got = score(signals.momentum(df, asofs, 6, 1, last=day[8]))
    assert got == {(day[8], "B"): pytest.approx(7.0)}
    # Before the break is known, all days count.
    got = score(signals.momentum(df, asofs, 5, 1, last=day[8]))
    assert got[day[5], "B"] == pytest.approx(4.0) and got[day[5], "A"] == 0.0
    assert got[day[8], "B"] == pytest.approx(8 / 3 - 1)


A, B = signals.SHARE_TAGS


def test_issuance(spark):
    then, now = D(2019, 6, 30), D(2020, 6, 29)
    data = [
        (1, A, None, D(2019, 3, 31), 100, "a", "10-Q", D(2019, 5, 1)), (1, A, None, D(2020, 3, 31), 110, "b", "10-Q", D(2020, 5, 1)),
        # only the second tag has both ends
        (2, A, None, D(2020, 3, 31), 7, "c", "10-Q", D(2020, 5, 1)), (2, B, None, D(2019, 3, 31), 50, "d", "10-Q", D(2019, 5, 1)),
        (2, B, None, D(2020, 3, 31), 40, "e", "10-Q", D(2020, 5, 1)),
        # stale at the later end: filed 401 days before
        (3, A, None, D(2019, 3, 31), 50, "f", "10-Q", now - dt.timedelta(days=401)),
        # exactly 400 days old
        (4, A, None, D(2019, 3, 31), 50, "g", "10-Q", now - dt.timedelta(days=400)),
        # zero shares
        (5, A, None, D(2019, 3, 31), 0, "h", "10-Q", D(2019, 5, 1)), (5, A, None, D(2020, 3, 31), 10, "i", "10-Q", D(2020, 5, 1)),
        # not public yet
        (1, A, None, D(2020, 6, 30), 999, "j", "10-Q", D(2020, 8, 1)),
    ]
    t = tickers(spark, (1, "ONE"), (1, "ONEB"), (2, "TWO"), (3, "THREE"), (4, "FOUR"), (5, "FIVE"))
    got = score(signals.issuance(fact(spark, data), t, signals.asof_frame(spark, [now]), last=D(2021, 1, 1)))
    assert then == now - dt.timedelta(days=365)
    assert got == {(now, "ONE"): pytest.approx(-math.log(1.1)), (now, "ONEB"): pytest.approx(-math.log(1.1)),
                   (now, "TWO"): pytest.approx(-math.log(0.8)), (now, "FOUR"): 0.0}


def sheet(cik, end, ca, cash, cl, ta, filed, accn="x", form="10-K"):
    tags = signals.BALANCE_TAGS
    return [(cik, tags[k], None, end, v, accn, form, filed) for k, v in zip(("ca", "cash", "cl", "ta"), (ca, cash, cl, ta)) if v is not None]


def test_accruals(spark):
    y18, y19 = D(2018, 12, 31), D(2019, 12, 31)
    data = sheet(1, y18, 100, 20, 50, 1000, D(2019, 3, 1)) + sheet(1, y19, 150, 30, 60, 1200, D(2020, 3, 1))
    data += sheet(2, D(2017, 12, 31), 1, 1, 1, 10, D(2018, 3, 1)) + sheet(2, y19, 1, 1, 1, 10, D(2020, 3, 1))  # a year missing
    data += sheet(3, y18, 1, 1, 1, None, D(2019, 3, 1)) + sheet(3, y19, 1, 1, 1, 10, D(2020, 3, 1))  # a line missing
    data += sheet(4, y18, 1, 1, 1, 10, D(2019, 3, 1), form="10-Q") + sheet(4, y19, 1, 1, 1, 10, D(2020, 3, 1))
    data += sheet(5, y18, 1, 1, 1, 0, D(2019, 3, 1)) + sheet(5, y19, 2, 1, 1, 0, D(2020, 3, 1))  # no assets
    t = tickers(spark, *[(i, f"S{i}") for i in range(1, 6)])
    asofs = [D(2020, 2, 28), D(2020, 3, 1), D(2020, 6, 30)]
    got = score(signals.accruals(fact(spark, data), t, signals.asof_frame(spark, asofs), last=D(2021, 1, 1)))
    want = pytest.approx(-((50 - 10 - 10) / 1100))
    assert got == {(asofs[1], "S1"): want, (asofs[2], "S1"): want}


def test_accruals_restatement_and_history(spark):
    data = []
    for year in range(2010, 2020):
        data += sheet(1, D(year, 12, 31), 100 + year, 10, 10, 1000, D(year + 1, 3, 1))
    # an old year is restated late, the newest one too
    data += [(1, "AssetsCurrent", None, D(2012, 12, 31), 5000, "z", "10-K/A", D(2020, 5, 1))]
    data += [(1, "AssetsCurrent", None, D(2019, 12, 31), 3000, "z", "10-K", D(2020, 5, 1))]
    asofs = [D(2015, 6, 30), D(2020, 4, 30), D(2020, 5, 31)]
    got = score(signals.accruals(fact(spark, data), tickers(spark, (1, "S")), signals.asof_frame(spark, asofs), last=D(2021, 1, 1)))
    assert got == {(asofs[0], "S"): pytest.approx(-0.001), (asofs[1], "S"): pytest.approx(-0.001),
                   (asofs[2], "S"): pytest.approx(-(3000 - 2118) / 1000)}


def quarter(i):
    """Start and end of the i-th quarter from 2018."""
    year, q = 2018 + i // 4, i % 4
    start = D(year, 3 * q + 1, 1)
    end = (D(year + (q == 3), (3 * q + 3) % 12 + 1, 1)) - dt.timedelta(days=1)
    return start, end


def quarters(cik, values, accn="q"):
    out = []
    for i, v in enumerate(values):
        start, end = quarter(i)
        out.append((cik, "NetIncomeLoss", start, end, v, f"{accn}{i:02d}", "10-Q", end + dt.timedelta(days=45)))
        if i % 4:  # the year-to-date twin ends the same day and has a higher accession
            out.append((cik, "NetIncomeLoss", quarter(i - i % 4)[0], end, 10_000 + i, f"z{i:02d}", "10-Q", end + dt.timedelta(days=45)))
    return out


def test_earnings_surprise(spark):
    base = [100, 100, 100, 100, 110, 108, 112, 110]
    data = quarters(1, base + [165]) + quarters(2, base + [55]) + quarters(3, base) + quarters(4, [100] * 9)
    asof = quarter(8)[1] + dt.timedelta(days=50)
    scale = statistics.stdev([10, 8, 12, 10])
    t = tickers(spark, *[(i, f"S{i}") for i in range(1, 5)])
    frame = signals.asof_frame(spark, [asof, quarter(8)[1] + dt.timedelta(days=44), quarter(8)[1] + dt.timedelta(days=106)])
    got = score(signals.earnings_surprise(fact(spark, data), t, frame, last=D(2022, 1, 1)))
    # Not before the filing day, and not once the drift window is over.
    assert got == {(asof, "S1"): pytest.approx(55 / scale), (asof, "S2"): pytest.approx(-55 / scale)}


def test_a_skipped_quarter_breaks_the_seasonal_difference(spark):
    rows = quarters(1, [100, 101, 103, 102, 110, 115, 108, 111, 120, 130, 119, 140])
    gone = quarter(5)[1]
    data = [r for r in rows if r[3] != gone]
    asof = quarter(11)[1] + dt.timedelta(days=50)
    got = score(signals.earnings_surprise(fact(spark, data), tickers(spark, (1, "S")), signals.asof_frame(spark, [asof]), last=D(2022, 1, 1)))
    # Four rows back is a year back only for the rows before the gap and, five quarters on, not yet again.
    ends = sorted({r[3]: r[4] for r in data if r[4] < 1000}.items())
    diffs = [(e, v - ends[i - 4][1]) for i, (e, v) in enumerate(ends) if i >= 4 and 330 <= (e - ends[i - 4][0]).days <= 400]
    want = {}
    if len(diffs) > 4 and diffs[-1][0] + dt.timedelta(days=45) >= asof - dt.timedelta(days=60):
        want = {(asof, "S"): pytest.approx(diffs[-1][1] / statistics.stdev([d for _, d in diffs[:-1]][-8:]))}
    assert got == want


def brute_surprise(data, asof):
    """The score per filer straight from the definition, on the whole history."""
    out = {}
    for cik in {r[0] for r in data}:
        best = {}
        for r in data:
            if r[0] == cik and r[7] <= asof and 80 <= (r[3] - r[2]).days <= 100:
                best[r[3]] = max(best.get(r[3], (dt.date.min, "", 0)), (r[7], r[5], r[4]))
        ends = sorted(best)
        diffs = [(best[e][2] - best[ends[i - 4]][2], best[e][0]) for i, e in enumerate(ends)
                 if i >= 4 and 330 <= (e - ends[i - 4]).days <= 400]
        prior = [d for d, _ in diffs[:-1]][-8:]
        if len(prior) >= 4 and diffs[-1][1] >= asof - dt.timedelta(days=60) and statistics.stdev(prior) > 0:
            out[f"S{cik}"] = diffs[-1][0] / statistics.stdev(prior)
    return out


def test_surprise_equals_the_definition_with_gaps_and_restatements(spark):
    import random

    rnd = random.Random(23)
    data = []
    for cik in range(1, 31):
        for i in range(36):
            if rnd.random() < 0.06 * (cik % 3):
                continue  # a quarter never filed
            start, end = quarter(i)
            # Some filers are so late that quarters become known out of order.
            filed = end + dt.timedelta(days=rnd.randint(20, 80 if cik % 5 else 200))
            data.append((cik, "NetIncomeLoss", start, end, rnd.randint(50, 150), f"a{i:02d}", "10-Q", filed))
            if rnd.random() < 0.15:
                again = filed + dt.timedelta(days=rnd.randint(1, 400))
                data.append((cik, "NetIncomeLoss", start, end, rnd.randint(50, 150), f"b{i:02d}", "10-Q", again))
    asofs = [D(2018, 1, 31) + dt.timedelta(days=83 * i) for i in range(45)]
    t = tickers(spark, *[(i, f"S{i}") for i in range(1, 31)])
    got = score(signals.earnings_surprise(fact(spark, data), t, signals.asof_frame(spark, asofs), last=D(2029, 1, 1)))
    want = {(a, s): pytest.approx(v) for a in asofs for s, v in brute_surprise(data, a).items()}
    assert len(want) > 300 and got == want


def test_later_filings_change_no_score(spark):
    data = quarters(1, [100, 100, 100, 100, 110, 108, 112, 110, 165])
    asof = quarter(8)[1] + dt.timedelta(days=50)
    late = [(1, "NetIncomeLoss", *quarter(i), 1e6 * i, "zz", "10-Q", asof + dt.timedelta(days=1)) for i in range(12)]
    t, frame = tickers(spark, (1, "S")), signals.asof_frame(spark, [asof])
    args = dict(last=D(2022, 1, 1))
    assert score(signals.earnings_surprise(fact(spark, data), t, frame, **args)) == score(
        signals.earnings_surprise(fact(spark, data + late), t, frame, **args))


def test_versions_equal_the_single_date_read(spark):
    import random

    rnd = random.Random(5)
    data = []
    for i in range(400):
        end = D(2018, 1, 1) + dt.timedelta(days=30 * rnd.randint(0, 30))
        data.append((rnd.randint(1, 8), "T", None, end, i, f"a{rnd.randint(1, 4)}", "10-Q", end + dt.timedelta(days=rnd.randint(0, 300))))
    df = fact(spark, data).cache()
    asofs = [D(2018, 6, 30), D(2019, 3, 31), D(2019, 12, 31), D(2021, 6, 30)]
    got = {(r["asof"], r["cik"]): r["val"] for r in facts.facts_at(df, ["T"], signals.asof_frame(spark, asofs), "asof", D(2022, 1, 1)).collect()}
    want = {(a, r["cik"]): r["val"] for a in asofs for r in facts.latest_facts(df, "T", a).collect()}
    assert got == want


def test_naming_the_first_date_changes_nothing(spark):
    asof = quarter(8)[1] + dt.timedelta(days=50)
    t, frame = tickers(spark, (1, "S")), signals.asof_frame(spark, [asof])
    for signal, data in (
        (signals.earnings_surprise, quarters(1, [100, 100, 100, 100, 110, 108, 112, 110, 165])),
        (signals.accruals, sheet(1, D(2018, 12, 31), 100, 20, 50, 1000, D(2019, 3, 1)) + sheet(1, D(2019, 12, 31), 150, 30, 60, 1200, D(2020, 3, 1))),
        (signals.issuance, [(1, A, None, D(2019, 3, 31), 100, "a", "10-Q", D(2019, 5, 1)), (1, A, None, D(2020, 3, 31), 110, "b", "10-Q", D(2020, 4, 1))]),
    ):
        df = fact(spark, data)
        wide = score(signal(df, t, frame, last=D(2030, 1, 1)))
        assert len(wide) == 1 and score(signal(df, t, frame, last=asof, first=asof)) == wide


def test_alive_bounds(spark):
    asof = D(2020, 6, 30)
    data = [(1, "10-K", asof), (2, "10-Q", asof - dt.timedelta(days=456)), (3, "10-Q", asof - dt.timedelta(days=457)),
            (4, "10-K", asof + dt.timedelta(days=1)), (5, "8-K", asof), (6, "10-K/A", asof)]
    df = spark.createDataFrame(data, "cik long, form string, filed date")
    assert sorted(r["cik"] for r in facts.alive(df, asof).collect()) == [1, 2]
    assert sorted(r["cik"] for r in facts.alive_at(df, signals.asof_frame(spark, [asof])).collect()) == [1, 2]


def test_universe(spark):
    asof = D(2020, 6, 30)
    days = [asof - dt.timedelta(days=i) for i in range(63)]
    prices = {"ALIVE": 50.0, "DEAD": 50.0, "PENNY": 1.0, "EDGE": 5.0, "THIN": 50.0, "NAN": 50.0}
    volume = {"THIN": 20_000.0, "NAN": float("nan")}
    verdicts = spark.createDataFrame([(s, d, p, 2, "ok") for s, p in prices.items() for d in days],
                                     "symbol string, ts date, close double, n_sources long, status string")
    bars = spark.createDataFrame([(s, d, volume.get(s, 1e6)) for s in prices for d in days], "symbol string, ts date, volume double")
    filings = spark.createDataFrame([(i, "10-Q", D(2020, 5, 1) if s != "DEAD" else D(2018, 5, 1)) for i, s in enumerate(prices)],
                                    "cik long, form string, filed date")
    names = tickers(spark, *[(i, s) for i, s in enumerate(prices)])
    got = universe.build(verdicts, bars, filings, names, asof, newest=None)
    assert [(r["symbol"], r["cik"]) for r in got.collect()] == [("ALIVE", 0)]
    many = universe.build_at(canonical.mark_breaks(verdicts), bars, filings, names, signals.asof_frame(spark, [asof, D(2019, 1, 1)]))
    assert [(r["asof"], r["symbol"]) for r in many.collect()] == [(asof, "ALIVE")]
    with pytest.raises(FileNotFoundError):
        universe.check_tickers(names.limit(0))


def test_rebalance_days_and_holds(spark, rows):
    days = weekdays(45, D(2020, 1, 15))
    df = trading_days(spark.createDataFrame([(d,) for d in days * 2], "ts date"))
    daily = rows(rebalance_days(df, "daily"), "ts", "fill_ts")
    assert daily == list(zip(days, days[1:]))
    weekly = [r[0] for r in rows(rebalance_days(df, "weekly"), "ts")]
    assert weekly == sorted({days[0]} | {a for a, b in zip(days, days[1:]) if a.isocalendar()[:2] != b.isocalendar()[:2]})
    ends = [a for a, b in zip(days, days[1:]) if a.month != b.month] + [days[-1]]
    assert rows(holds(df), "formed", "held_to") == list(zip(ends, ends[1:]))

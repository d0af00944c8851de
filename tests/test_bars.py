import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.session import scratch
from tidemark.sources import bars
from tidemark.sources.tables import newest_wins

INPUT = "symbol string, ts date, open double, high double, low double, close double, volume double, n int"


def batch(spark, data):
    """data: (symbol, day, close, arrival)."""
    full = [(s, dt.date(2020, 1, d), c, c, c, c, 100.0, n) for s, d, c, n in data]
    return spark.createDataFrame(full, INPUT)


def test_correction_and_isolation(spark, rows):
    path = scratch(spark, "bars")
    bars.write_bars(batch(spark, [("A", 2, 10.0, 0), ("B", 2, 20.0, 0)]), path, "one")
    bars.write_bars(batch(spark, [("A", 2, 11.0, 0)]), path, "two")
    bars.write_bars(batch(spark, [("A", 2, 12.0, 0)]), path, "one")
    bars.write_bars(batch(spark, [("A", 2, 99.0, 0)]), path, "one", "1h")
    got = rows(bars.read_bars(spark, path), "symbol", "source", "close")
    assert got == [("A", "one", 12.0), ("A", "two", 11.0), ("B", "one", 20.0)]
    assert rows(bars.read_bars(spark, path, source="two"), "symbol", "close") == [("A", 11.0)]
    assert rows(bars.read_bars(spark, path, resolution="1h"), "close") == [(99.0,)]


def test_windowed_read_is_filter_of_full_read(spark, rows):
    path = scratch(spark, "bars")
    days = [(s, d, 10.0 * d, 0) for s in "ABC" for d in range(1, 9)]
    bars.write_bars(batch(spark, days), path, "one")
    bars.write_bars(batch(spark, [("B", 4, 99.0, 0)]), path, "one")
    full = rows(bars.read_bars(spark, path), "symbol", "ts", "close")
    part = rows(bars.read_bars(spark, path, symbols=["A", "B"], start="2020-01-03", end="2020-01-05"), "symbol", "ts", "close")
    assert part == [r for r in full if r[0] in "AB" and 3 <= r[1].day <= 5]


def test_last_of_a_batch_by_arrival(spark, rows):
    out = bars.stamp_bars(batch(spark, [("A", 2, 50.0, 1), ("A", 2, 10.0, 2)]), "x", arrival=["n"])
    assert rows(out, "close") == [(10.0,)]


def test_missing_folder_is_empty(spark):
    assert bars.read_bars(spark, scratch(spark, "none")).count() == 0


def test_rejections(spark):
    good = batch(spark, [("A", 2, 1.0, 0)])
    with pytest.raises(ValueError):
        bars.stamp_bars(good.drop("volume"), "x")
    with pytest.raises(ValueError):
        bars.stamp_bars(good, "../x")
    with pytest.raises(TypeError):
        bars.stamp_bars(good.withColumn("ts", F.lit(20200102)), "x")
    with pytest.raises(Exception, match="may not be null"):
        bars.stamp_bars(good.withColumn("symbol", F.lit(None).cast("string")), "x").count()


def test_dates_as_text_or_timestamp(spark):
    good = batch(spark, [("A", 2, 1.0, 0)])
    for form in ("string", "timestamp"):
        assert bars.stamp_bars(good.withColumn("ts", F.col("ts").cast(form)), "x").first()["ts"] == dt.date(2020, 1, 2)


def test_filters_and_partitions_reach_the_scan(spark):
    path = scratch(spark, "bars")
    bars.write_bars(batch(spark, [("A", 2, 10.0, 0)]), path, "one")
    df = bars.read_bars(spark, path, symbols=["A"], start="2020-01-01", source="one")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(resolution" in plan or "PartitionFilters: [isnotnull(source" in plan
    assert "GreaterThanOrEqual(ts,2020-01-01)" in plan and "EqualTo(symbol,A)" in plan


def test_newest_wins_reduces_a_hot_key_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("if(id < 990, 1L, id) AS k", "id AS v")
    out = newest_wins(df, ["k"], ["v"])
    assert out.filter("k = 1").first()["v"] == 989
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_vendor_json(spark, rows):
    text = ('{"bars": {" aapl ": [{"t": "2020-01-02T05:00:00Z", "o": 1, "h": 2.5, "l": "1", "c": 2, "v": 10},'
            '{"t": "2020-01-03T05:00:00Z", "o": 1, "h": 2, "l": 1, "v": 10}, {"t": "bad", "o": 1, "h": 2, "l": 1, "c": 1, "v": 1},'
            '{"t": "2020-01-06T05:00:00Z", "o": "NaN", "h": 2, "l": 1, "c": 1, "v": 1}, 7]}, "next_page_token": null}')
    df = spark.createDataFrame([(text,), ("{}",), ("garbage",)], "payload string")
    assert rows(bars.parse_bar_json(df), "symbol", "ts", "high", "close") == [("AAPL", dt.date(2020, 1, 2), 2.5, 2.0)]


def test_dump_lines(spark, rows):
    lines = [
        "<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>",
        "zeta.us,D,20200102,000000,8.25,9.5,8,9.125,4100,0",
        "AAPL.US,W,20200103,000000,1,1,1,1,1,0", "AAPL.US,D,2020010,000000,1,1,1,1,1,0", "AAPL.US,D,20200231,000000,1,1,1,1,1,0",
        "AAPL.US,D,20200106,000000,1,1,1,nan,1,0", "AAPL.US,D,20200106,000000,1,1,1", "", ".US,D,20200107,000000,1,1,1,1,1,0",
        "  MSFT,d,20200108,000000, 1 ,1,1,2,1,0  ",
    ]
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    assert rows(bars.parse_dump(df), "symbol", "ts", "close") == [
        ("MSFT", dt.date(2020, 1, 8), 2.0), ("ZETA", dt.date(2020, 1, 2), 9.125)]


def test_history_takes_the_session_day_of_the_exchange(spark, rows):
    df = spark.createDataFrame(
        [("spy", dt.datetime(2020, 1, 3, 4, 59), 1.0, 1.0, 1.0, 1.0, 1.0), ("spy", dt.datetime(2020, 1, 3, 5, 0), 1.0, 1.0, 1.0, 2.0, 1.0),
         ("spy", dt.datetime(2020, 1, 6, 5, 0), 1.0, float("nan"), 1.0, 2.0, 1.0)],
        "symbol string, at timestamp, Open double, High double, Low double, Close double, Volume double")
    assert rows(bars.reshape_history(df, "America/New_York"), "symbol", "ts", "close") == [
        ("SPY", dt.date(2020, 1, 2), 1.0), ("SPY", dt.date(2020, 1, 3), 2.0)]

"""Filings kept current at load time."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.facts import alive, read_filings
from tidemark.plans import jobs
from tidemark.session import scratch
from tidemark.sources import filings

COLUMNS = "cik long, accn string, form string, filed date, primary_doc string, seq long, loaded_at timestamp"


@pytest.fixture
def house(spark):
    return jobs.Warehouse(scratch(spark, "house"))


def batch(spark, rows, load):
    stamp = dt.datetime(2024, 1, 1) + dt.timedelta(hours=load)
    return spark.createDataFrame([(*r, i, stamp) for i, r in enumerate(rows)], COLUMNS)


def current(house, spark, *window):
    return sorted(tuple(r) for r in house.filings(spark, *window).collect())


def files_read(df):
    return {f.split("/rows/")[1].split("/")[1] for f in df.inputFiles()}


def test_the_newest_load_wins_wherever_its_date_is(spark, house):
    day = dt.date
    jobs.store_filings(house, batch(spark, [(1, "a", "10-K", day(2019, 1, 5), "x"), (1, "b", "10-Q", day(2020, 5, 1), "x"),
                                            (2, "a", "10-K", day(2020, 5, 2), "x")], 1))
    assert len(current(house, spark)) == 3
    # One is restated to another month, one is repeated, one is new, one appears twice.
    jobs.store_filings(house, batch(spark, [(1, "a", "10-K", day(2020, 6, 5), "y"), (1, "b", "10-Q", day(2020, 5, 1), "x"),
                                            (3, "c", "8-K", day(2021, 1, 1), "p"), (3, "c", "8-K", day(2021, 1, 2), "q")], 2))
    assert current(house, spark) == [
        (1, "a", "10-K", day(2020, 6, 5), "y"), (1, "b", "10-Q", day(2020, 5, 1), "x"),
        (2, "a", "10-K", day(2020, 5, 2), "x"), (3, "c", "8-K", day(2021, 1, 2), "q")]
    assert [r[1] for r in current(house, spark, day(2020, 5, 2), day(2020, 6, 5))] == ["a", "a"]
    months = house.current_filings().months(spark)[1]
    assert sorted(months) == [day(2020, 5, 1), day(2020, 6, 1), day(2021, 1, 1)]  # nothing is left in 2019
    # The month of what was only repeated keeps its files; an older load changes nothing.
    assert months[day(2020, 5, 1)].startswith("rows/000000001")
    jobs.store_filings(house, batch(spark, [(3, "c", "8-K", day(2018, 1, 1), "old")], 0))
    assert len(current(house, spark)) == 4 and (3, "c", "8-K", day(2021, 1, 2), "q") in current(house, spark)


def test_random_loads_read_like_the_ranked_table(spark, house):
    rnd = random.Random(7)
    for load in range(4):
        rows = [(rnd.randint(1, 6), rnd.choice("abcde"), rnd.choice(["10-K", "10-Q"]), dt.date(2020, rnd.randint(1, 5), rnd.randint(1, 28)),
                 rnd.choice(["x", "y"])) for _ in range(25)]
        jobs.store_filings(house, batch(spark, rows, load))
        ranked = filings.current_filings(spark.read.parquet(house.path("filings")))
        assert current(house, spark) == sorted(tuple(r) for r in ranked.collect())
        low, high = dt.date(2020, 2, 10), dt.date(2020, 4, 3)
        assert current(house, spark, low, high) == sorted(tuple(r) for r in read_filings(ranked, None, low, high).collect())


def test_a_window_reaches_the_scan(spark, house):
    rows = [(i, f"f{i}", "10-K", dt.date(2015, 1, 1) + dt.timedelta(days=20 * i), "x") for i in range(100)]
    jobs.store_filings(house, batch(spark, rows, 1))
    living = alive(house.filings(spark), "2019-06-30", days=90)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = living._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(filed,2019-04-01)" in plan and "LessThanOrEqual(filed,2019-06-30)" in plan
    assert "Window" not in plan  # nothing is ranked above the filter
    window = house.filings(spark, dt.date(2019, 4, 1), dt.date(2019, 6, 30))
    assert files_read(window) == {"_month=2019-04", "_month=2019-05", "_month=2019-06"}
    assert alive(window, "2019-06-30", days=90).count() == living.count() == 5


def test_empty_and_missing_tables(spark, house):
    assert house.filings(spark).count() == 0
    jobs.store_filings(house, batch(spark, [], 1))
    assert house.current_filings().exists(spark) and house.filings(spark).count() == 0
    jobs.store_filings(house, batch(spark, [(1, "a", "10-K", dt.date(2020, 1, 1), None)], 1))
    assert current(house, spark) == [(1, "a", "10-K", dt.date(2020, 1, 1), None)]


def test_tables_written_otherwise_are_ranked(spark, house):
    batch(spark, [(1, "a", "10-K", dt.date(2020, 1, 1), "x"), (1, "a", "10-K", dt.date(2020, 2, 1), "x")], 1).write.parquet(house.path("filings"))
    assert [r[3] for r in current(house, spark)] == [dt.date(2020, 2, 1)]
    assert current(house, spark, None, dt.date(2020, 1, 15)) == []


def test_a_merge_reads_and_ranks_its_rows_once(spark, house):
    seen = spark.sparkContext.accumulator(0)

    def count(form):
        seen.add(1)
        return form

    def load(n, at):
        rows = batch(spark, [(i, "a", "10-K", dt.date(2020, 1 + i % 3, 1), "x") for i in range(n)], at)
        house.current_filings().merge(rows.withColumn("form", F.udf(count, "string")("form")))

    load(30, 1)
    assert seen.value == 30
    load(40, 2)  # ten are new
    assert seen.value == 70 and len(current(house, spark)) == 40


def test_a_merge_that_fails_is_not_seen(spark, house):
    jobs.store_filings(house, batch(spark, [(1, "a", "10-K", dt.date(2020, 1, 1), "x")], 1))
    bad = batch(spark, [(2, "b", "10-K", dt.date(2020, 1, 2), "x")], 2).withColumn("form", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        house.current_filings().merge(bad)
    assert len(current(house, spark)) == 1


def test_loaded_documents_are_current(spark, house, tmp_path):
    def document(cik, *rows):
        return json.dumps({"cik": cik, "filings": {"recent": dict(zip(
            ["accessionNumber", "form", "filingDate", "primaryDocument"], map(list, zip(*rows))))}})

    folder = tmp_path / "subs"
    folder.mkdir()
    (folder / "1.json").write_text(document(1, ("a", "10-K", "2020-01-02", "x"), ("b", "10-Q", "2020-03-03", "y")))
    jobs.load_filings(spark, house, str(folder))
    (folder / "1.json").write_text(document(1, ("a", "10-K/A", "2020-01-02", "x"), ("b", "10-Q", "2020-03-03", "y")))
    jobs.load_filings(spark, house, str(folder))
    assert current(house, spark) == [(1, "a", "10-K/A", dt.date(2020, 1, 2), "x"), (1, "b", "10-Q", dt.date(2020, 3, 3), "y")]
    months = house.current_filings().months(spark)[1]
    assert months[dt.date(2020, 3, 1)].startswith("rows/000000001") and months[dt.date(2020, 1, 1)].startswith("rows/000000002")

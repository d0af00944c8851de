"""Facts published by filer."""

import datetime as dt
import json
import re

import pytest

from tidemark.operators import facts as fact_ops, signals
from tidemark.plans import jobs, standins
from tidemark.session import scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture
def house(spark):
    return jobs.Warehouse(scratch(spark, "house"))


def documents(folder, **filers):
    for name, rows in filers.items():
        entries = [{"start": str(e - dt.timedelta(days=90)), "end": str(e), "val": v, "accn": f"a{i}", "fy": e.year, "fp": "Q", "form": "10-Q",
                    "filed": str(e + dt.timedelta(days=45))} for i, (e, v) in enumerate(rows)]
        (folder / f"{name}.json").write_text(json.dumps(
            {"cik": int(name[1:]), "facts": {"us-gaap": {t: {"units": {"USD": entries}} for t in ("NetIncomeLoss", "Assets")}}}))


def quarters(n, *odd):
    ends = [dt.date(2014 + q // 4, 3 * (q % 4) + 3, 28) for q in range(n)]
    return [(e, 100.0 + (i * 37) % 11 + (50 if i in odd else 0)) for i, e in enumerate(ends)]


def exchanges_of_facts(df):
    """Exchanges by the filer number that the scan of the facts gives; the ticker map may have one of its own."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    scanned = set(re.findall(r"FileScan parquet .*?\[(?:.*?,)?(cik#\d+)", plan))
    assert scanned
    return [line.strip() for line in plan.splitlines() if "Exchange" in line and any(re.search(rf"{c}\D", line) for c in scanned)], plan


def test_signals_over_published_facts_move_no_fact(spark, house, tmp_path):
    documents(tmp_path, c1=quarters(20), c2=quarters(20, 3, 9), c3=quarters(15), c4=quarters(3))
    jobs.load_facts(spark, house, str(tmp_path))
    tickers = spark.createDataFrame([(i, f"S{i}") for i in range(1, 5)], "cik long, symbol string")
    asofs = signals.asof_frame(spark, [dt.date(2017, m, 28) for m in range(1, 13)])

    def scores(rows):
        return signals.earnings_surprise(rows, tickers, asofs, "2017-12-31")

    loaded = sorted(tuple(r) for r in scores(house.facts(spark)).collect())
    published = jobs.publish_facts(spark, house, buckets=3)
    over = scores(published)
    moved, plan = exchanges_of_facts(over)
    assert "Bucketed: true" in plan and moved == []
    assert sorted(tuple(r) for r in over.collect()) == loaded and len(loaded) > 12
    assert exchanges_of_facts(fact_ops.fact_versions(published, ["Assets"]))[0] == []
    # A filter on a tag still reaches the scan.
    assert "EqualTo(tag,NetIncomeLoss)" in plan


def test_a_newer_load_is_seen_before_it_is_published(spark, house, tmp_path):
    documents(tmp_path, c1=quarters(4))
    jobs.load_facts(spark, house, str(tmp_path))
    assert jobs.publish_facts(spark, house, buckets=2).count() == 8
    assert all("facts_published" in f for f in house.facts(spark).inputFiles())
    documents(tmp_path, c1=quarters(5), c2=quarters(1))
    jobs.load_facts(spark, house, str(tmp_path))
    assert house.facts(spark).count() == 12 and not any("facts_published" in f for f in house.facts(spark).inputFiles())
    assert jobs.publish_facts(spark, house, buckets=5).count() == 12
    # Another session, which has never heard of the table, reads it by its folder.
    other = spark.newSession()
    assert jobs.Warehouse(house.root).facts(other).filter("tag = 'Assets'").count() == 6


def test_an_empty_warehouse(spark, house):
    assert house.facts(spark).count() == 0
    assert jobs.publish_facts(spark, house, buckets=2).count() == 0


def test_surprises_agree_with_the_joined_form(spark):
    """Versions, expiry and the drift window, against a plain reading of one date at a time."""
    facts = standins.facts_total(spark, SF)
    tickers = standins.tickers(spark, SF)
    dates = [dt.date(1996, 1, 31), dt.date(1997, 3, 31), dt.date(1998, 6, 30)]
    many = signals.earnings_surprise(facts, tickers, signals.asof_frame(spark, dates), "1998-12-31", tag="TOTAL").collect()
    one = [r for d in dates for r in signals.earnings_surprise(
        facts.filter(facts.filed <= d), tickers, signals.asof_frame(spark, [d]), d, tag="TOTAL").collect()]
    assert sorted((r.asof, r.symbol) for r in many) == sorted((r.asof, r.symbol) for r in one)
    want = {(r.asof, r.symbol): r.score for r in one}
    assert all(r.score == pytest.approx(want[r.asof, r.symbol]) for r in many) and many

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import canonical, signals, vote
from tidemark.plans import jobs, queries_sources
from tidemark.session import scratch
from tidemark.sources import bars, events
from tidemark.streaming.revote import revote_new_bars, touched_bars

SF = "/root/testdata/sf0.001"
INPUT = "symbol string, ts date, open double, high double, low double, close double, volume double"


@pytest.fixture
def house(spark):
    return jobs.Warehouse(scratch(spark, "house"))


def frame(spark, *data):
    """data: (symbol, day of January 2020, close)."""
    return spark.createDataFrame([(s, dt.date(2020, 1, d), c, c, c, c, 1e6) for s, d, c in data], INPUT)


def current(spark, house):
    return {(r["symbol"], r["ts"].day): (r["status"], r["close"])
            for r in canonical.newest_wins(house.verdicts(spark), ["symbol", "ts"], ["batch_ts", "batch"]).collect()}


def test_daily_run(spark, house):
    landed = {"one": frame(spark, ("A", 2, 10.0), ("A", 3, 11.0), ("B", 3, 5.0), ("NOT", 3, 1.0)),
              "two": frame(spark, ("A", 3, 11.0), ("B", 3, 6.0))}
    summary = jobs.daily_run(spark, house, "2020-01-04", landed, ["A", "B", "C"])
    assert summary == {"asof": "2020-01-04", "day": "2020-01-03", "symbols": 3, "symbol_source": "argument", "empty_universe": False,
                       "one_rows": 2, "two_rows": 2, "ok": 1, "majority": 0, "quarantined": 1}
    logged = events.read_events(spark, house.path("events")).collect()
    assert sorted(e["kind"] for e in logged) == ["job.daily", "reconcile.quarantine"]
    assert json.loads(next(e for e in logged if e["kind"] == "job.daily")["payload"]) == summary
    assert current(spark, house) == {("A", 3): ("ok", 11.0), ("B", 3): ("quarantined", None)}


def test_daily_run_without_tickers_fails_and_logs_nothing(spark, house):
    with pytest.raises(FileNotFoundError):
        jobs.daily_run(spark, house, "2020-01-04", {})
    assert events.read_events(spark, house.path("events")).count() == 0


def test_daily_run_over_the_universe(spark, house):
    days = [(s, d, p) for s, p in (("LIQUID", 84.0), ("CHEAP", 0.4)) for d in range(1, 30)]
    for source in ("one", "two"):
        bars.write_bars(frame(spark, *days), house.path("bars"), source)
    jobs.vote_range(spark, house, "2020-01-01", "2020-01-31")
    tickers = json.dumps({"0": {"cik_str": 1, "ticker": "LIQUID"}, "1": {"cik_str": 2, "ticker": "CHEAP"}})
    jobs.load_tickers(house, spark.createDataFrame([(tickers,)], "payload string"))
    listed = spark.createDataFrame([(c, f"a{c}", "10-K", dt.date(2019, 12, 1), "d", 0, dt.datetime(2020, 1, 1)) for c in (1, 2)],
                                   "cik long, accn string, form string, filed date, primary_doc string, seq long, loaded_at timestamp")
    listed.write.parquet(house.path("filings"))
    landed = {"one": frame(spark, ("LIQUID", 30, 83.5), ("CHEAP", 30, 0.4))}
    summary = jobs.daily_run(spark, house, "2020-01-31", landed)
    assert (summary["symbols"], summary["symbol_source"], summary["one_rows"], summary["ok"]) == (1, "universe", 1, 1)
    empty = jobs.daily_run(spark, house, "2021-01-31", {})
    assert empty["empty_universe"] is True and empty["symbols"] == 0


def test_a_later_vote_retracts_an_earlier_one(spark, house):
    bars.write_bars(frame(spark, ("A", 2, 10.0)), house.path("bars"), "one")
    jobs.vote_range(spark, house, "2020-01-01", "2020-01-31")
    assert current(spark, house) == {("A", 2): ("ok", 10.0)}
    bars.write_bars(frame(spark, ("A", 2, 20.0)), house.path("bars"), "two")
    stored = jobs.vote_range(spark, house, "2020-01-01", "2020-01-31")
    assert current(spark, house) == {("A", 2): ("quarantined", None)}
    assert [tuple(r) for r in jobs.yearly_counts(stored).collect()] == [(2020, 0, 0, 1, 1.0)]
    with pytest.raises(ValueError):
        jobs.vote_range(spark, house, "2020-02-01", "2020-01-01")


def test_streaming_votes_only_what_was_touched(spark, house):
    bars.write_bars(frame(spark, ("A", 2, 10.0), ("B", 2, 5.0), ("A", 3, 10.0)), house.path("bars"), "one")
    revote_new_bars(spark, house, house.path("checkpoint"))
    bars.write_bars(frame(spark, ("A", 2, 20.0), ("C", 2, 7.0)), house.path("bars"), "two")
    revote_new_bars(spark, house, house.path("checkpoint"))
    assert current(spark, house) == {("A", 2): ("quarantined", None), ("A", 3): ("ok", 10.0), ("B", 2): ("ok", 5.0), ("C", 2): ("ok", 7.0)}
    per_batch = sorted(r["count"] for r in house.verdicts(spark).groupBy("batch").count().collect())
    assert per_batch == [2, 3]
    revote_new_bars(spark, house, house.path("checkpoint"))  # nothing new
    assert house.verdicts(spark).count() == 5


def scanned(df):
    """Files that the scans of an executed plan have read."""
    df.collect()
    files, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        else:
            if node.nodeName().startswith("Scan parquet"):
                files += node.metrics().apply("numFiles").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return files


def test_late_bars_read_no_month_but_theirs(spark, house):
    days = [dt.date(1965 + m // 12, m % 12 + 1, 5) for m in range(0, 720, 12)]
    history = spark.createDataFrame([("A", d, 10.0, 10.0, 10.0, 10.0, 1.0) for d in days], schemas.BAR_INPUT)
    bars.write_bars(history, house.path("bars"), "one")
    late = spark.createDataFrame([("A", days[0]), ("A", days[-1])], "symbol string, ts date")
    got = touched_bars(spark, house, late)
    # Two of sixty months; the pairs are no files.
    assert scanned(got) == 2 and sorted(r["ts"] for r in got.collect()) == [days[0], days[-1]]
    assert touched_bars(spark, house, late.limit(0)).count() == 0
    # A window passes folders by as well.
    assert scanned(bars.read_bars(spark, house.path("bars"), start=dt.date(1970, 1, 1), end=dt.date(1974, 12, 31))) == 5
    revote_new_bars(spark, house, house.path("checkpoint"))
    bars.write_bars(history.filter(F.col("ts").isin(days[0], days[-1])), house.path("bars"), "two")
    revote_new_bars(spark, house, house.path("checkpoint"))
    per_batch = sorted(r["count"] for r in house.verdicts(spark).groupBy("batch").count().collect())
    assert per_batch == [2, 60]


def test_bars_without_month_folders_are_read(spark, house):
    days = [("A", dt.date(2020, m, 2), *[10.0] * 5) for m in (1, 2)]
    old = bars.stamp_bars(spark.createDataFrame(days, INPUT), "one")
    old.write.partitionBy("source", "resolution").parquet(house.path("bars"))
    assert bars.read_bars(spark, house.path("bars"), start="2020-01-01", end="2020-01-31").count() == 1
    assert bars.read_bars(spark, house.path("bars"), ["2020-01"]).count() == 2


def test_repeating_a_batch_replaces_it(spark, house):
    bars.write_bars(frame(spark, ("A", 2, 10.0), ("B", 2, 1.0)), house.path("bars"), "one")
    bars.write_bars(frame(spark, ("B", 2, 2.0)), house.path("bars"), "two")
    for _ in range(2):
        jobs.vote_range(spark, house, "2020-01-01", "2020-01-31", batch="b1")
    assert house.verdicts(spark).count() == 2
    # The events of the repeated batch carry the same ids and are read once.
    assert events.read_events(spark, house.path("events")).count() == 1


def test_loading_documents(spark, house, tmp_path):
    def facts(cik, *vals):
        entries = [{"end": "2019-12-31", "val": v, "accn": "a", "fy": 2019, "form": "10-K", "filed": "2020-02-01"} for v in vals]
        return json.dumps({"cik": cik, "facts": {"us-gaap": {"Assets": {"units": {"USD": entries}}}}}, indent=1)

    first = tmp_path / "facts"
    first.mkdir()
    (first / "1.json").write_text(facts(1, 10, 11))
    (first / "2.json").write_text(facts(2))
    (first / "3.json").write_text("{broken")
    got = {r["document"].rsplit("/", 1)[1]: (r["rows"], r["status"]) for r in jobs.load_facts(spark, house, str(first)).collect()}
    assert got == {"1.json": (2, "loaded"), "2.json": (0, "empty"), "3.json": (0, "failed")}
    (first / "1.json").write_text(facts(1, 12))
    jobs.load_facts(spark, house, str(first))
    assert [r["val"] for r in house.facts(spark).collect()] == [12.0]

    # A filter on tags reaches the one scan of the facts; the load stamps come from their own table.
    plan = house.facts(spark).filter("tag = 'Assets'")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) == 2 and sum("EqualTo(tag,Assets)" in line for line in scans) == 1

    folder = tmp_path / "subs"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"cik": 1, "filings": {"recent": {
        "accessionNumber": ["a", "b"], "form": ["10-K", "10-Q"], "filingDate": ["2020-01-02", "2020-01-03"], "primaryDocument": ["x", "y"]}}}))
    assert [(r["rows"], r["status"]) for r in jobs.load_filings(spark, house, str(folder)).collect()] == [(2, "loaded")]
    assert sorted(r["accn"] for r in house.filings(spark).collect()) == ["a", "b"]


def test_packed_documents_load_like_their_files(spark, house, tmp_path):
    def facts(cik, n):
        entries = [{"end": "2019-12-31", "val": v, "accn": "a", "fy": 2019, "form": "10-K", "filed": "2020-02-01"} for v in range(n)]
        return json.dumps({"cik": cik, "facts": {"us-gaap": {"Assets": {"units": {"USD": entries}}}}}, indent=1)

    folder = tmp_path / "facts"
    for i in range(60):
        (folder / f"d{i % 7}").mkdir(parents=True, exist_ok=True)
        (folder / f"d{i % 7}" / f"{i}.json").write_text("{broken" if i % 20 == 19 else facts(i, i % 4))
    files = sorted(tuple(r) for r in jobs.load_facts(spark, house, str(folder)).collect())
    packed = jobs.Warehouse(scratch(spark, "packed"))
    archive = jobs.pack_documents(spark, str(folder), packed.path("archive"))
    assert archive.count() == 60 and len(archive.inputFiles()) <= 4
    assert sorted(tuple(r) for r in jobs.load_facts(spark, packed, packed.path("archive"), packed=True).collect()) == files
    key = ["cik", "tag", "end", "val"]
    assert sorted(map(tuple, packed.facts(spark).select(key).collect())) == sorted(map(tuple, house.facts(spark).select(key).collect()))
    assert {r["status"] for r in spark.createDataFrame(files, "document string, rows long, skipped long, status string").collect()} == {
        "loaded", "empty", "failed"}


def test_bundled_documents_load_like_their_files(spark, house, tmp_path):
    def facts(cik, n):
        entries = [{"end": "2019-12-31", "val": v, "accn": "é", "fy": 2019, "form": "10-K", "filed": "2020-02-01"} for v in range(n)]
        return json.dumps({"cik": cik, "facts": {"us-gaap": {"Assets": {"units": {"USD": entries}}}}}, indent=1)

    texts = {f"{i}.json": "{broken" if i % 20 == 19 else facts(i, i % 4) for i in range(60)}
    folder, bundles = tmp_path / "facts", tmp_path / "bundles" / "2020"
    folder.mkdir()
    bundles.mkdir(parents=True)
    for name, text in texts.items():
        (folder / name).write_text(text)
    for k in range(2):
        lines = [json.dumps({"document": n, "payload": t}) for i, (n, t) in enumerate(texts.items()) if i % 2 == k]
        # A member cut short, an empty line, and a document without a name.
        lines += ['{"document": "cut.json", "payl', "", json.dumps(json.loads(facts(100, 3)))] if k else []
        (bundles / f"{k}.json").write_text("\n".join(lines))
    archive = jobs.pack_documents(spark, str(tmp_path / "bundles"), house.path("archive"), bundled=True)
    assert archive.count() == 62
    got = {r["document"].rsplit("/", 1)[-1]: tuple(r)[1:] for r in jobs.load_facts(spark, house, house.path("archive"), packed=True).collect()}
    one = jobs.Warehouse(scratch(spark, "files"))
    files = {r["document"].rsplit("/", 1)[-1]: tuple(r)[1:] for r in jobs.load_facts(spark, one, str(folder)).collect()}
    assert {n: got[n] for n in texts} == files
    assert sorted(v for n, v in got.items() if n not in texts) == [(0, 0, "failed"), (3, 0, "loaded")]
    key = ["cik", "tag", "end", "val", "accn"]
    assert sorted(map(tuple, house.facts(spark).filter("cik < 100").select(key).collect())) == sorted(
        map(tuple, one.facts(spark).select(key).collect()))


def test_bulk_load_writes_no_file_per_document(spark, monkeypatch):
    folders = []
    pack = jobs.pack_documents
    monkeypatch.setattr(jobs, "pack_documents", lambda s, path, *a, **k: folders.append(path) or pack(s, path, *a, **k))
    documents = queries_sources.company_documents(spark, SF).count()
    queries_sources.job_load_facts(spark, SF)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders[0]).count()
    assert 0 < files <= 4 < documents


def test_calibration_runs_its_signal_once(spark, house):
    ends = [dt.date(2020, m, 28) for m in range(1, 7)]
    data = [(f"S{i:02d}", d, 100.0 + i * (1 + j % 2), src) for i in range(20) for j, d in enumerate(ends) for src in ("x", "y")]
    jobs.write_verdicts(vote.ballots(spark.createDataFrame(data, "symbol string, ts date, close double, source string")), house, "b1")
    seen = spark.sparkContext.accumulator(0)

    def score(symbol):
        seen.add(1)
        return float(symbol[1:])

    def rank(panel, asofs):
        last = panel.join(F.broadcast(asofs), panel.ts == asofs.asof)
        return signals.finalise(last.withColumn("score", F.udf(score, "double")("symbol")))

    published = spark.createDataFrame([(dt.date(2020, m, 1), 0.01 * m) for m in range(2, 7)], "month date, ret double")
    report = jobs.calibration_run(spark, house, "Rank", rank, published, "2020-01-01", "2020-06-30")
    ran, row = seen.value, report.first()
    assert row["n_months"] == 5 and 0 < ran == seen.value


def test_calibration_from_stored_tables(spark, house, rows):
    names = [f"S{i:02d}" for i in range(20)]
    ends = [dt.date(2020, m, 28) for m in range(1, 7)]
    data = [(s, d, 100.0 * (1 + 0.002 * i * (1 + j % 2)) ** j) for i, s in enumerate(names) for j, d in enumerate(ends)]
    bars_in = spark.createDataFrame([(s, d, c, src) for s, d, c in data for src in ("x", "y")], "symbol string, ts date, close double, source string")
    jobs.write_verdicts(vote.ballots(bars_in), house, "b1")
    page = json.dumps({"corporate_actions": {"cash_dividends": [{"symbol": "S19", "ex_date": "2020-02-10", "rate": 1.0}],
                                             "forward_splits": [{"symbol": "S19", "ex_date": "2020-03-10", "old_rate": 1, "new_rate": 2}]}})
    jobs.load_actions(house, spark.createDataFrame([(page,)], "payload string"))

    def rank(panel, asofs):
        last = panel.join(F.broadcast(asofs), panel.ts == asofs.asof)
        return signals.finalise(last.withColumn("score", F.substring("symbol", 2, 2).cast("double")))

    published = spark.createDataFrame([(dt.date(2020, m, 1), 0.01 * m) for m in range(2, 7)], "month date, ret double")
    report = jobs.calibration_run(spark, house, "Rank", rank, published, "2020-01-01", "2020-06-30", cut="2020-05-01").first()
    assert report["n_months"] == 4 and -1 <= report["rho"] <= 1

    def spread(j):
        def ret(i, extra=0.0):
            p = [100.0 * (1 + 0.002 * i * (1 + k % 2)) ** k for k in (j - 1, j)]
            return (p[1] + extra) / p[0] - 1

        # Half the declared dividend: it was paid before a two-for-one split.
        return (ret(19, 0.5 if j == 1 else 0.0) + ret(18)) / 2 - (ret(0) + ret(1)) / 2

    assert report["mean_ours"] == pytest.approx(sum(spread(j) for j in range(1, 5)) / 4)
    payload = json.loads(events.read_events(spark, house.path("events"), "replication.calibration").first()["payload"])
    assert payload["start"] == "2020-01-01" and payload["n_months"] == 4

import datetime as dt
import json

import pytest

from tidemark.sources import actions, events, filings, published
from tidemark.session import scratch


def documents(spark, *payloads, **columns):
    return spark.createDataFrame([(p if isinstance(p, str) else json.dumps(p),) for p in payloads], "payload string")


def entry(**changes):
    base = {"start": "2019-10-01", "end": "2019-12-31", "val": 100, "accn": "a1", "fy": 2019, "fp": "Q4", "form": "10-Q", "filed": "2020-01-29"}
    return {k: v for k, v in (base | changes).items() if v is not None}


def facts_doc(*entries, cik=41, **more):
    return {"cik": cik, "facts": {"us-gaap": {"NetIncomeLoss": {"units": {"USD": list(entries)}}, **more}}}


def test_company_facts(spark, rows):
    doc = facts_doc(
        entry(), entry(start=None, accn=None, fy=None), entry(start="nonsense", val="7.5"), entry(filed=None), entry(end="x"),
        entry(val=None), entry(val="NaN"), entry(val=True), 5, "text", Broken=5, AlsoBroken={"units": 3}, cik="CIK0000000041")
    df = filings.parse_company_facts(documents(spark, doc, "{broken", {"facts": {}}))
    got = rows(df, "cik", "taxonomy", "tag", "unit", "start", "val", "accn", "fy")
    day = dt.date(2019, 10, 1)
    assert got == [
        (41, "us-gaap", "NetIncomeLoss", "USD", None, 7.5, "a1", 2019), (41, "us-gaap", "NetIncomeLoss", "USD", None, 100.0, "", 0),
        (41, "us-gaap", "NetIncomeLoss", "USD", day, 100.0, "a1", 2019)]


def test_facts_keep_document_order(spark):
    df = filings.parse_company_facts(documents(spark, facts_doc(*[entry(val=i) for i in range(20)])))
    assert [r["val"] for r in df.orderBy("seq").collect()] == [float(i) for i in range(20)]


def test_newer_document_replaces_the_filer(spark, rows):
    old = filings.parse_company_facts(documents(spark, facts_doc(entry(), entry(val=1)), facts_doc(entry(), cik=5)).selectExpr("payload", "1 AS loaded_at"))
    new = filings.parse_company_facts(documents(spark, facts_doc(entry(val=9)), {"cik": 5, "facts": {}}).selectExpr("payload", "2 AS loaded_at"))
    assert rows(filings.current_facts(old.union(new)), "cik", "val") == [(5, 100.0), (41, 9.0)]


def submissions(**changes):
    recent = {"accessionNumber": ["a", "b", " ", "d"], "form": ["10-Q", "10-K", "8-K", "8-K"],
              "filingDate": ["2020-01-02", "2020-01-03", "2020-01-04", "bad"], "primaryDocument": ["x.htm", "y.htm", "z.htm", "w.htm"]}
    recent |= changes
    return {"cik": "0000000007", "filings": {"recent": {k: v for k, v in recent.items() if v is not None}}}


def test_submissions(spark, rows):
    df = filings.parse_submissions(documents(spark, submissions()))
    assert rows(df, "cik", "accn", "form", "primary_doc") == [(7, "a", "10-Q", "x.htm"), (7, "b", "10-K", "y.htm")]


@pytest.mark.parametrize("broken", [None, "not a list", ["x.htm"]])
def test_a_missing_array_drops_no_filings(spark, rows, broken):
    df = filings.parse_submissions(documents(spark, submissions(primaryDocument=broken)))
    assert [r[0] for r in rows(df, "accn")] == ["a", "b"]


def test_submissions_of_another_filer_fail(spark):
    df = documents(spark, submissions()).selectExpr("payload", "8L AS cik")
    with pytest.raises(Exception, match="loaded for 8"):
        filings.parse_submissions(df, expected="cik").collect()


def test_shards_merge_and_incoming_wins(spark, rows):
    one = filings.parse_submissions(documents(spark, submissions()).selectExpr("payload", "1 AS loaded_at"))
    two = filings.parse_submissions(documents(spark, submissions(accessionNumber=["b", "c"], form=["10-K/A", "10-Q"])).selectExpr("payload", "2 AS loaded_at"))
    got = rows(filings.current_filings(one.union(two)), "accn", "form")
    assert got == [("a", "10-Q"), ("b", "10-K/A"), ("c", "10-Q")]


def test_tickers(spark, rows):
    doc = {"0": {"cik_str": 41, "ticker": " zeta "}, "1": {"cik_str": "CIK0000000005", "ticker": "KAPA"}, "2": {"cik_str": 5.0, "ticker": "KAPB"},
           "3": {"cik_str": 5, "ticker": "KAPA"}, "4": {"cik_str": 0, "ticker": "ZERO"}, "5": {"cik_str": "x", "ticker": "X"},
           "6": {"cik_str": 6, "ticker": " "}, "7": {"cik_str": True, "ticker": "T"}, "8": 7, "9": {"cik_str": 6}}
    assert rows(filings.parse_tickers(documents(spark, doc)), "cik", "symbol") == [(5, "KAPA"), (5, "KAPB"), (41, "ZETA")]


def test_rejects_and_summary(spark, rows):
    df = documents(spark, facts_doc(entry(), entry()), "{broken", "[1]", {"facts": {}}, {"cik": 9, "facts": {}}).selectExpr(
        "payload", "cast(crc32(payload) AS string) AS document").withColumn("reason", filings.reject_reason())
    entries = filings.fact_entries(df, every=True)
    got = sorted((r["rows"], r["skipped"], r["status"]) for r in filings.load_summary(entries, "document").collect())
    assert got == [(0, 0, "empty"), (0, 0, "failed"), (0, 0, "failed"), (0, 0, "failed"), (2, 0, "loaded")]
    assert entries.filter("ok").count() == filings.parse_company_facts(df).count() == 2


def test_of_a_repeated_member_the_last_counts(spark, rows):
    tag = '{"units": {"USD": [{"end": "2020-01-01", "filed": "2020-02-01", "val": %d}]}}'
    text = '{"cik": 7, "facts": {"t": {"A": %s, "B": %s, "A": %s}}}' % (tag % 1, tag % 2, tag % 3)
    df = spark.createDataFrame([(text,)], "payload string")
    assert rows(filings.parse_company_facts(df), "tag", "val") == [("A", 3.0), ("B", 2.0)]


def test_filer_zero_is_no_filer(spark):
    assert filings.parse_company_facts(documents(spark, facts_doc(entry(), cik=0))).count() == 0


def test_positions_keep_their_order_and_never_wrap(spark, rows):
    df = spark.createDataFrame([(0, 0, 0, 5), (0, 0, 1, 0), (0, 1, 0, 0), (1, 0, 0, 0), (1, 999_999, 4_000, 8_000_000)], "a int, b int, c int, d int")
    got = [r[0] for r in df.select(filings._position("a", "b", "c", "d")).collect()]
    assert got == sorted(got) and len(set(got)) == 5 and got[-1] > 0
    with pytest.raises(Exception, match="too many members"):
        spark.createDataFrame([(0, 1 << 20, 0, 0)], "a int, b int, c int, d int").select(filings._position("a", "b", "c", "d")).collect()


def test_corporate_actions(spark, rows):
    page = {"corporate_actions": {
        "cash_dividends": [{"symbol": "zeta", "ex_date": "2011-03-04", "rate": 0.31, "special": False}, {"symbol": "X", "ex_date": "bad", "rate": 1},
                           {"symbol": "X", "ex_date": "2011-03-04", "rate": "NaN"}, {"ex_date": "2011-03-04", "rate": 1}, 3,
                           {"symbol": "X", "ex_date": "2011-03-07T00:00:00Z", "rate": 1, "special": True}],
        "forward_splits": [{"symbol": "ZETA", "ex_date": "2012-05-07", "old_rate": 1, "new_rate": 3}],
        "reverse_splits": [{"symbol": "R", "ex_date": "2012-05-07", "old_rate": 10, "new_rate": 1}, {"symbol": "R", "ex_date": "2020-09-01", "old_rate": 0, "new_rate": 1}]}}
    df = documents(spark, page, {"corporate_actions": {}}, "{}")
    assert rows(actions.parse_dividends(df), "symbol", "ex_date", "rate", "special") == [
        ("X", dt.date(2011, 3, 7), 1.0, True), ("ZETA", dt.date(2011, 3, 4), 0.31, False)]
    assert rows(actions.parse_splits(df), "symbol", "new_rate") == [("R", 1.0), ("ZETA", 3.0)]


def csv(spark, *lines, columns="date string, ret string"):
    return spark.createDataFrame([tuple(line.split(",")) for line in lines], columns)


def test_published_percent_and_decimal(spark, rows):
    got = rows(published.parse_published(csv(spark, "2020-01,2.25", "2020-02,-4.0", "2020-03-31,8.5", "2020-04,NA"), "Mom12m"), "month", "ret")
    assert got == [(dt.date(2020, 1, 1), 0.0225), (dt.date(2020, 2, 1), -0.04), (dt.date(2020, 3, 1), 0.085)]
    got = rows(published.parse_published(csv(spark, "2020-01,0.015", columns="date string, Mom12m string"), "Mom12m"), "ret")
    assert got == [(0.015,)]


@pytest.mark.parametrize("lines, message", [
    (["2020-02-31,1.0"], "cannot read date"), (["January,1.0"], "cannot read date"), (["2020-01,1.0", "2020-01-31,2.0"], "more than one row"),
    (["2020-01,NA"], "holds no numbers"),
])
def test_published_errors(spark, lines, message):
    with pytest.raises(Exception, match=message):
        published.parse_published(csv(spark, *lines), "x").collect()


def test_published_file(spark, tmp_path, rows):
    (tmp_path / "x.csv").write_text("date,Mom12m,other\n2020-01,1.5,9\n2020-02,2.5,9\n")
    assert rows(published.read_published(spark, str(tmp_path / "x.csv"), "Mom12m"), "ret") == [(0.015,), (0.025,)]
    with pytest.raises(ValueError):
        published.read_published(spark, str(tmp_path / "x.csv"), "Absent").collect()


def test_event_log(spark, rows):
    path = scratch(spark, "events")
    df = spark.createDataFrame([(1, 2.5, None), (2, None, "x")], "n int, v double, s string")
    events.log_events(events.as_events(df, "first"), path)
    events.log_events(events.as_events(df.limit(1), "second"), path)
    log = events.read_events(spark, path)
    assert log.count() == 3 and len({r["event_id"] for r in log.collect()}) == 3
    payloads = sorted(r["payload"] for r in events.read_events(spark, path, "first").collect())
    assert [json.loads(p) for p in payloads] == [{"n": 1, "v": 2.5, "s": None}, {"n": 2, "v": None, "s": "x"}]


@pytest.mark.parametrize("value", [float("nan"), float("inf")])
def test_event_payloads_are_strict_json(spark, value):
    df = spark.createDataFrame([(value,)], "v double")
    with pytest.raises(Exception, match="NaN or infinity"):
        events.as_events(df, "x").collect()
    nested = spark.createDataFrame([({"a": value},)], "m map<string, double>")
    with pytest.raises(Exception, match="NaN or infinity"):
        events.as_events(nested, "x").collect()


def test_compaction_is_idempotent_and_drops_copies(spark, rows):
    path = scratch(spark, "events")
    data = [(f"e{i}", f"2024-01-0{1 + i % 3}T00:00:00", "k", "{}") for i in range(30)]
    df = spark.createDataFrame(data, "event_id string, ts string, kind string, payload string")
    events.log_events(df, path)
    events.log_events(df.filter("event_id < 'e2'"), path)  # copies, as an interrupted run leaves them
    before = rows(events.read_events(spark, path), "event_id", "ts")
    first = rows(events.compact(spark, path, scratch(spark, "w"), "2024-01-03"), "day", "files_removed", "events")
    assert [(d, e) for d, _, e in first] == [("2024-01-01", 10), ("2024-01-02", 10)]
    assert events.compact(spark, path, scratch(spark, "w"), "2024-01-03").count() == 0
    assert rows(events.read_events(spark, path), "event_id", "ts") == before
    assert rows(events.mergeable(spark, path, "2024-01-04"), "day") == [("2024-01-03",)]


def test_a_large_day_is_written_in_parts(spark, rows):
    path = scratch(spark, "events")
    data = [(f"e{i}", "2024-01-01T00:00:00", "k", "x" * 50 + str(i)) for i in range(2000)]
    df = spark.createDataFrame(data, "event_id string, ts string, kind string, payload string")
    for part in range(6):
        events.log_events(df.filter(f"crc32(event_id) % 6 = {part}"), path)
    events.compact(spark, path, scratch(spark, "w"), "2024-01-02", file_bytes=20_000)
    files = spark.read.parquet(path).selectExpr("_metadata.file_path AS f").distinct().count()
    assert files < 6 and events.read_events(spark, path).count() == 2000
    assert events.compact(spark, path, scratch(spark, "w"), "2024-01-02", file_bytes=1_000_000).isEmpty() == (files == 1)

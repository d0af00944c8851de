"""Queries over parsers, stored tables and the jobs that fill them.

Payloads are built by Spark out of the benchmark tables and parsed back. Queries
that need a stored table write it to the shared scratch folder first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import canonical, signals, universe, vote
from tidemark.plans import jobs, standins
from tidemark.plans.queries_facts import LAST, SUPPLIER_FILINGS, UNIVERSE, _SCREEN
from tidemark.plans.queries_portfolio import HOLDS_M, _legs_sql
from tidemark.plans.queries_prices import JUMP_M, PANEL_M, TOL_D, TOL_M, VERDICTS_D, VERDICTS_M
from tidemark.plans.registry import BARS_D, BARS_M, DIVIDENDS, FACTS_T, SPLITS, TICKERS, R, panel_sql, query, rounded
from tidemark.session import scratch, store
from tidemark.sources import actions, bars, events, filings, published
from tidemark.streaming.revote import revote_new_bars


def ohlcv(rows: DataFrame) -> DataFrame:
    """Bars with the close in all four prices."""
    return rows.select("symbol", "ts", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], "volume", "source")


# --- parsers ------------------------------------------------------------------------


def _by_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly bars of all vendors; a symbol carries its vendor's name."""
    return standins.bars_monthly(spark, sf_dir).withColumn("symbol", F.concat_ws("-", "symbol", "source"))


def _vendor_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vendor page per symbol and year, with a bad bar for the months divisible by five."""
    b = _by_vendor(spark, sf_dir)
    price = F.when(F.month("ts") % 5 == 0, F.lit("n/a")).otherwise(F.col("close").cast("string"))
    bar = F.struct(F.concat(F.col("ts").cast("string"), F.lit("T05:00:00Z")).alias("t"), price.alias("o"), price.alias("h"),
                   price.alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    pages = b.groupBy("symbol", F.year("ts")).agg(F.collect_list(bar).alias("series"))
    body = F.create_map(F.concat(F.lit(" "), F.lower("symbol")), F.col("series"))
    return pages.select(F.to_json(F.struct(body.alias("bars"))).alias("payload"))


@query(f"WITH {BARS_M} SELECT symbol || '-' || source AS symbol, ts, close, volume FROM bars_m WHERE month(ts) % 5 <> 0")
def parse_bar_json(spark, sf_dir):
    return bars.parse_bar_json(_vendor_payloads(spark, sf_dir)).select("symbol", "ts", "close", "volume")


@query(f"""WITH {BARS_M} SELECT symbol || '-' || source AS symbol, ts - 1 AS ts, close, volume FROM bars_m WHERE month(ts) <> 7""")
def reshape_history(spark, sf_dir):
    b = _by_vendor(spark, sf_dir)
    price = F.when(F.month("ts") != 7, F.col("close")).otherwise(F.lit(float("nan")))
    history = b.select(F.lower("symbol").alias("symbol"), F.col("ts").cast("timestamp").alias("at"), price.alias("Open"),
                       price.alias("High"), price.alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    # Midnight UTC is still the evening before in New York.
    return bars.reshape_history(history, "America/New_York").select("symbol", "ts", "close", "volume")


@query(f"""WITH {BARS_M} SELECT symbol || '-' || source AS symbol, ts, close, volume FROM bars_m WHERE month(ts) NOT IN (3, 6, 9)""")
def parse_dump(spark, sf_dir):
    b = _by_vendor(spark, sf_dir)
    day = F.date_format("ts", "yyyyMMdd")
    month = F.month("ts")
    line = F.concat_ws(
        ",", F.concat("symbol", F.lit(".US")), F.when(month == 3, "W").otherwise("D"),
        F.when(month == 6, F.substring(day, 1, 7)).otherwise(day), F.lit("000000"), "close", "close",
        F.when(month == 9, F.lit("nan")).otherwise(F.col("close").cast("string")), "close", "volume", F.lit("0"))
    header = F.lit("<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>")
    lines = b.select(F.explode(F.array(header, line, F.lit(""), F.concat(line, F.lit(",1")))).alias("value"))
    return bars.parse_dump(lines).select("symbol", "ts", "close", "volume")


def company_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One company-facts document per supplier, restatements included; some entries unusable."""
    f = standins.facts_total(spark, sf_dir)
    entry = F.struct(
        F.when(F.quarter("end") != 2, F.col("start").cast("string")).otherwise("unknown").alias("start"),
        F.col("end").cast("string").alias("end"), F.col("val"), "accn", F.year("end").alias("fy"), F.lit("Q").alias("fp"), "form",
        F.when(F.year("end") == 1997, F.lit("")).otherwise(F.col("filed").cast("string")).alias("filed"))
    units = F.create_map(F.lit("USD"), F.sort_array(F.collect_list(entry)))
    return f.groupBy("cik", "tag").agg(units.alias("u")).select(
        "cik", F.to_json(F.struct(
            F.concat(F.lit("CIK000"), F.col("cik")).alias("cik"),
            F.create_map(F.lit("us-gaap"), F.create_map(F.col("tag"), F.struct(F.col("u").alias("units")))).alias("facts"),
        )).alias("payload"))


@query(f"""WITH {FACTS_T}
SELECT cik, 'us-gaap' AS taxonomy, 'TOTAL' AS tag, 'USD' AS unit, CASE WHEN quarter("end") <> 2 THEN start END AS start, "end", val,
       accn, CAST(year("end") AS BIGINT) AS fy, 'Q' AS fp, '10-Q' AS form, filed
FROM facts_t WHERE cik > 0 AND year("end") <> 1997""")
def parse_company_facts(spark, sf_dir):
    return filings.parse_company_facts(company_documents(spark, sf_dir).select("payload")).drop("seq")


def submission_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions documents in shards, one per customer and quarter; the documents array is missing for some."""
    o = standins.table(spark, sf_dir, "orders")
    row = F.struct(F.col("o_orderkey"), F.concat(F.lit(" A-"), F.col("o_orderkey")).alias("accn"), F.col("o_orderstatus"),
                   F.when(F.month("o_orderdate") == 2, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("filed"))
    per = o.groupBy("o_custkey", F.trunc("o_orderdate", "quarter").alias("shard")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    docs = F.when(F.col("o_custkey") % 4 != 0, F.transform("r", lambda x: F.concat(F.lit("d"), x["o_orderkey"].cast("string"))))
    recent = F.struct(F.col("r.accn").alias("accessionNumber"), F.col("r.o_orderstatus").alias("form"),
                      F.col("r.filed").alias("filingDate"), docs.alias("primaryDocument"))
    return per.select(F.col("o_custkey").alias("cik"), F.to_json(F.struct(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))).alias("payload"))


@query("""SELECT o_custkey AS cik, 'A-' || o_orderkey AS accn, o_orderstatus AS form, CAST(o_orderdate AS DATE) AS filed,
       CASE WHEN o_custkey % 4 <> 0 THEN 'd' || o_orderkey ELSE '' END AS primary_doc
FROM orders WHERE o_custkey > 0 AND month(o_orderdate) <> 2""")
def parse_submissions(spark, sf_dir):
    return filings.parse_submissions(submission_documents(spark, sf_dir), expected="cik").drop("seq")


@query("""SELECT o_custkey AS cik, 'A-' || o_orderkey AS accn,
       CASE WHEN month(o_orderdate) <> 2 THEN o_orderstatus ELSE o_orderstatus || '/A' END AS form,
       CAST(o_orderdate AS DATE) + CASE WHEN month(o_orderdate) <> 2 THEN 1 ELSE 0 END AS filed FROM orders""")
def filings_merge(spark, sf_dir):
    """A second, amended load of every filing outside February replaces the first."""
    o = standins.filings(spark, sf_dir).withColumn("accn", F.concat(F.lit("A-"), "accn")).withColumn("seq", F.lit(0))
    first = o.withColumn("form", F.concat("form", F.lit("/A"))).withColumn("loaded_at", F.lit(1))
    second = o.filter(F.month("filed") != 2).withColumn("filed", F.date_add("filed", 1)).withColumn("loaded_at", F.lit(2))
    return filings.current_filings(first.unionByName(second)).select("cik", "accn", "form", "filed")


@query("""SELECT DISTINCT s_suppkey AS cik, upper(trim(s_name)) AS symbol FROM supplier WHERE s_suppkey > 0 AND s_suppkey % 5 <> 4""")
def parse_tickers(spark, sf_dir):
    s = standins.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    cik = F.when(k % 5 == 0, k.cast("string")).when(k % 5 == 1, F.concat(F.lit("CIK000"), k)).when(
        k % 5 == 2, F.concat(k, F.lit(".0"))).when(k % 5 == 3, F.lpad(k.cast("string"), 10, "0")).otherwise(F.lit("n/a"))
    entry = F.create_map(k.cast("string"), F.struct(cik.alias("cik_str"), F.lower("s_name").alias("ticker"), F.lit("x").alias("title")))
    return filings.parse_tickers(s.select(F.to_json(entry).alias("payload")))


def action_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor pages of a ship date, cut by symbol: dividends, splits split over both lists, some rows unusable."""
    d = standins.dividends(spark, sf_dir).select(
        "ex_date", F.struct(F.lower("symbol").alias("symbol"), F.concat(F.col("ex_date").cast("string"), F.lit("T00:00:00Z")).alias("ex_date"),
                            F.when(F.month("ex_date") == 5, F.lit("NaN")).otherwise(F.col("rate").cast("string")).alias("rate"),
                            (F.month("ex_date") == 6).alias("special")).alias("d"))
    s = standins.splits(spark, sf_dir).select(
        "ex_date", F.struct("symbol", F.col("ex_date").cast("string").alias("ex_date"),
                            F.when(F.month("ex_date") == 4, 0.0).otherwise(F.col("old_rate")).alias("old_rate"), "new_rate").alias("s"))
    both = d.select("ex_date", "d", F.lit(None).cast(s.schema["s"].dataType).alias("s")).unionByName(
        s.select("ex_date", F.lit(None).cast(d.schema["d"].dataType).alias("d"), "s"))
    page = both.groupBy("ex_date", F.pmod(F.xxhash64(F.upper(F.coalesce("d.symbol", "s.symbol"))), F.lit(64))).agg(F.collect_list("d").alias("d"), F.collect_list("s").alias("s"))
    up = F.filter("s", lambda x: x["new_rate"] > 1)
    down = F.filter("s", lambda x: x["new_rate"] <= 1)
    return page.select(F.to_json(F.struct(F.struct(
        F.col("d").alias("cash_dividends"), up.alias("forward_splits"), down.alias("reverse_splits")).alias("corporate_actions"))).alias("payload"))


@query(f"WITH {DIVIDENDS} SELECT symbol, ex_date, rate, month(ex_date) = 6 AS special FROM dividends WHERE month(ex_date) <> 5")
def parse_dividends(spark, sf_dir):
    return actions.parse_dividends(action_pages(spark, sf_dir)).drop("seq")


@query(f"WITH {SPLITS} SELECT symbol, ex_date, 1.0::DOUBLE AS old_rate, ratio AS new_rate FROM splits WHERE month(ex_date) <> 4")
def parse_splits(spark, sf_dir):
    return actions.parse_splits(action_pages(spark, sf_dir)).drop("seq")


@query("""SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ex_date, l_discount AS rate FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate
  ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1""")
def actions_newest_wins(spark, sf_dir):
    li = standins.table(spark, sf_dir, "lineitem")
    batch = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    rows = li.select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.to_date("l_shipdate").alias("ex_date"),
                     F.col("l_discount").alias("rate"), *batch)
    return actions.current_actions(rows, batch)


@query("""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e9 AS raw FROM orders GROUP BY 1),
kept AS (SELECT * FROM m WHERE month(month) <> 8)
SELECT month, round(raw / CASE WHEN (SELECT abs(avg(raw)) FROM kept) > 0.5 THEN 100 ELSE 1 END, 9) AS ret FROM kept""")
def published_series(spark, sf_dir):
    a, _ = standins.monthly_totals(spark, sf_dir)
    raw = a.select(
        F.when(F.month("month") < 7, F.date_format("month", "yyyy-MM")).otherwise(F.date_format(F.last_day("month"), "yyyy-MM-dd")).alias("date"),
        F.when(F.month("month") == 8, F.lit("NA")).otherwise((F.col("ret_ls") * 1e12 / 1e9).cast("string")).alias("Totals"))
    return rounded(published.parse_published(raw, "Totals"), 9)


# --- stored tables and jobs -----------------------------------------------------------


def _house(spark: SparkSession, label: str) -> jobs.Warehouse:
    return jobs.Warehouse(scratch(spark, label))


def _store_daily_bars(spark: SparkSession, sf_dir: str, house: jobs.Warehouse) -> None:
    """The daily bars of all vendors, stored in one job."""
    bars.write_bars(ohlcv(standins.bars_daily(spark, sf_dir)), house.path("bars"))


@query(f"""WITH {BARS_D}
SELECT symbol, ts, source, close + CASE WHEN day(ts) % 3 = 0 THEN 1.0 ELSE 0.0 END AS close FROM bars_d""")
def bars_store(spark, sf_dir):
    """A batch of every source, then corrections of every third day, and a read."""
    house = _house(spark, "bars")
    _store_daily_bars(spark, sf_dir, house)
    some = ohlcv(standins.bars_daily(spark, sf_dir)).filter(F.dayofmonth("ts") % 3 == 0)
    bars.write_bars(some.withColumn("close", F.col("close") + 1.0), house.path("bars"))
    return bars.read_bars(spark, house.path("bars")).select("symbol", "ts", "source", "close")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a log, every fifth event twice."""
    e = standins.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
        F.col("event_type").alias("kind"), F.col("props").alias("payload"))
    return e.unionByName(e.filter(F.col("event_id").cast("bigint") % 5 == 0))


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, event_type AS kind, props AS payload
FROM events WHERE event_type = 'click'""")
def ledger_read(spark, sf_dir):
    return events.distinct_events(_events(spark, sf_dir), "click")


@query("""SELECT 'trade' AS kind, user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def ledger_payloads(spark, sf_dir):
    rows = standins.table(spark, sf_dir, "events").select("user_id", "value", "props")
    e = events.as_events(rows, "trade")
    return e.select(
        "kind", F.get_json_object("payload", "$.user_id").cast("bigint").alias("user_id"),
        F.get_json_object("payload", "$.value").cast("double").alias("value"),
        F.get_json_object(F.get_json_object("payload", "$.props"), "$.k").cast("bigint").alias("k"))


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS events, 1 AS files_after
FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1""")
def ledger_compaction(spark, sf_dir):
    """Three appends to the log, a compaction of the days before the 20th, and a second that finds nothing."""
    house = _house(spark, "events")
    log = _events(spark, sf_dir)
    for part in range(3):
        events.log_events(log.filter(F.col("event_id").cast("bigint") % 3 == part), house.path("events"))
    events.compact(spark, house.path("events"), house.path("work"), "2024-01-20")
    again = events.compact(spark, house.path("events"), house.path("again"), "2024-01-20")
    if not again.isEmpty():
        raise AssertionError("a compacted day was merged again")
    stored = spark.read.schema(events._STORED).parquet(house.path("events")).filter("day < '2024-01-20'")
    return stored.groupBy("day").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("_metadata.file_path").cast("int").alias("files_after"))


@query(f"""WITH {VERDICTS_D} SELECT CAST(year(ts) AS INTEGER) AS year, count(*) FILTER (status = 'ok') AS ok,
  count(*) FILTER (status = 'majority') AS majority, count(*) FILTER (status = 'quarantined') AS quarantined,
  {R("count(*) FILTER (status = 'quarantined') / count(*)")} AS quarantine_rate FROM verdicts GROUP BY 1""")
def job_backfill_vote(spark, sf_dir):
    house = _house(spark, "backfill")
    _store_daily_bars(spark, sf_dir, house)
    stored = jobs.vote_range(spark, house, "2024-01-01", "2024-12-31", TOL_D)
    return rounded(jobs.yearly_counts(stored))


@query(f"WITH {VERDICTS_D} SELECT symbol, ts, n_sources, status, close FROM verdicts")
def job_incremental_vote(spark, sf_dir):
    """Bars of half the symbols are streamed and voted, then the rest and a correction."""
    house = _house(spark, "stream")
    rows = ohlcv(standins.bars_daily(spark, sf_dir))
    wrong = rows.filter(F.dayofmonth("ts") <= 15).withColumn("close", F.col("close") * 1.5)
    bars.write_bars(wrong, house.path("bars"))
    revote_new_bars(spark, house, house.path("checkpoint"), TOL_D)
    bars.write_bars(rows, house.path("bars"))
    revote_new_bars(spark, house, house.path("checkpoint"), TOL_D)
    return canonical.newest_wins(house.verdicts(spark), ["symbol", "ts"], ["batch_ts", "batch"]).select(
        "symbol", "ts", "n_sources", "status", "close")


@query(f"""WITH {VERDICTS_D}, day AS (SELECT * FROM verdicts WHERE ts = DATE '2024-01-17')
SELECT '2024-01-17' AS day, (SELECT count(DISTINCT user_id) FROM events) AS symbols, count(*) FILTER (status = 'ok') AS ok,
       count(*) FILTER (status = 'majority') AS majority, count(*) FILTER (status = 'quarantined') AS quarantined,
       (SELECT count(*) FROM bars_d WHERE ts = DATE '2024-01-17') AS landed FROM day""")
def job_daily_run(spark, sf_dir):
    house = _house(spark, "daily")
    rows = ohlcv(standins.bars_daily(spark, sf_dir))
    names = rows.select("symbol").distinct()
    vendors = [r[0] for r in rows.select("source").distinct().collect()]
    landed = {s: rows.filter(F.col("source") == s).drop("source") for s in vendors}
    summary = jobs.daily_run(spark, house, "2024-01-18", landed, names, TOL_D)
    logged = events.read_events(spark, house.path("events"), "job.daily")
    number = {k: F.get_json_object("payload", f"$.{k}").cast("bigint") for k in summary if isinstance(summary[k], int) and not isinstance(summary[k], bool)}
    landed_rows = sum((v for k, v in number.items() if k.endswith("_rows")), F.lit(0))
    return logged.select(F.get_json_object("payload", "$.day").alias("day"), number["symbols"].alias("symbols"), number["ok"].alias("ok"),
                         number["majority"].alias("majority"), number["quarantined"].alias("quarantined"), landed_rows.alias("landed"))


@query(f"""WITH {FACTS_T}
SELECT cik, count(*) FILTER (cik > 0 AND year("end") <> 1997) AS rows, count(*) FILTER (cik = 0 OR year("end") = 1997) AS skipped,
       CASE WHEN cik = 0 THEN 'failed' WHEN count(*) FILTER (year("end") <> 1997) > 0 THEN 'loaded' ELSE 'empty' END AS status
FROM facts_t GROUP BY 1
UNION ALL SELECT s_suppkey + 1000000, 0, 0, 'failed' FROM supplier WHERE s_suppkey % 7 = 0
UNION ALL SELECT s_suppkey + 2000000, 0, 0, 'empty' FROM supplier WHERE s_suppkey % 7 = 1""")
def load_summary(spark, sf_dir):
    docs = company_documents(spark, sf_dir)
    s = standins.table(spark, sf_dir, "supplier")
    bad = s.filter("s_suppkey % 7 = 0").select((F.col("s_suppkey") + 1000000).alias("cik"), F.lit("{broken").alias("payload"))
    empty = s.filter("s_suppkey % 7 = 1").select((F.col("s_suppkey") + 2000000).alias("cik"), F.lit('{"cik": 5, "facts": {}}').alias("payload"))
    documents = docs.unionByName(bad).unionByName(empty).withColumnRenamed("cik", "document").withColumn("reason", filings.reject_reason())
    return filings.load_summary(filings.fact_entries(documents, every=True), "document").withColumnRenamed("document", "cik")


def _landed_bundles(documents: DataFrame, label: str) -> str:
    """Documents (cik, payload) as a bulk download, files of many members each, under a folder that is returned."""
    folder = scratch(documents.sparkSession, label)
    member = F.concat(F.lit("CIK"), F.lpad(F.col("cik").cast("string"), 10, "0"), F.lit(".json"))
    documents.select(member.alias("document"), "payload").write.json(folder)
    return folder


@query(f"""WITH {FACTS_T}
SELECT cik, tag, start, "end", val, filed, rows, skipped FROM (
  SELECT cik, 'TOTAL' AS tag, CASE WHEN quarter("end") <> 2 THEN start END AS start, "end", val, filed FROM facts_t WHERE year("end") <> 1997 AND cik > 0)
CROSS JOIN (SELECT count(*) FILTER (cik > 0 AND year("end") <> 1997) AS rows, count(*) FILTER (cik = 0 OR year("end") = 1997) AS skipped FROM facts_t)""")
def job_load_facts(spark, sf_dir):
    """A bulk download of company facts packed and loaded twice, read back by tag, with the summary of the second load.

    The documents land as in the vendor's bulk archive, many members a file. A folder of a file per document
    is for :func:`jobs.pack_documents` without ``bundled``.
    """
    house = _house(spark, "facts")
    bundles = _landed_bundles(company_documents(spark, sf_dir), "facts-bundles")
    archive = house.path("facts-archive")
    jobs.pack_documents(spark, bundles, archive, bundled=True)
    jobs.load_facts(spark, house, archive, packed=True)
    total = jobs.load_facts(spark, house, archive, packed=True).agg(F.sum("rows"), F.sum("skipped")).first()
    facts = house.facts(spark).filter("tag = 'TOTAL'").select("cik", "tag", "start", "end", "val", "filed")
    return facts.withColumns({"rows": F.lit(total[0]), "skipped": F.lit(total[1])})


@query("""SELECT o_custkey AS cik, 'A-' || o_orderkey AS accn, o_orderstatus AS form, CAST(o_orderdate AS DATE) AS filed
FROM orders WHERE o_custkey > 0 AND month(o_orderdate) <> 2""")
def job_load_filings(spark, sf_dir):
    """Files of submissions shards, a shard a line, loaded and read back."""
    house = _house(spark, "filings")
    folder = scratch(spark, "filings-files")
    submission_documents(spark, sf_dir).select("payload").write.text(folder)
    jobs.load_filings(spark, house, folder, lines=True)
    return house.filings(spark).select("cik", "accn", "form", "filed")


@query(f"""WITH {PANEL_M}, {HOLDS_M},
scores AS (SELECT h.formed AS asof, p.symbol, p.close AS score FROM holds h JOIN panel p ON p.ts = h.formed),
{_legs_sql('scores', 10, None)},
pub AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_discount) AS ret FROM lineitem GROUP BY 1)
SELECT 'Level' AS anomaly, {R('corr(ret_ls, ret)', 7)} AS rho, count(*) AS n_months, {R('avg(ret_ls)', 8)} AS mean_ours,
       {R('avg(ret)', 8)} AS mean_ref, corr(ret_ls, ret) > 0.9 AS pass FROM series JOIN pub USING (month)""")
def job_calibration(spark, sf_dir):
    """Stored verdicts to report: the close itself is the signal."""
    house = _house(spark, "calibration")
    jobs.write_verdicts(vote.ballots(standins.bars_monthly(spark, sf_dir), TOL_M), house, "all")

    def level(panel: DataFrame, asofs: DataFrame) -> DataFrame:
        return signals.finalise(panel.join(F.broadcast(asofs), panel.ts == asofs.asof).withColumn("score", F.col("close")))

    li = standins.table(spark, sf_dir, "lineitem")
    pub = li.groupBy(F.trunc(F.to_date("l_shipdate"), "MM").alias("month")).agg(F.avg("l_discount").alias("ret"))
    report = jobs.calibration_run(spark, house, "Level", level, pub, "1990-01-01", LAST, max_jump=JUMP_M)
    return report.select("anomaly", F.round("rho", 7).alias("rho"), "n_months", F.round("mean_ours", 8).alias("mean_ours"),
                         F.round("mean_ref", 8).alias("mean_ref"), "pass")


@query(f"""WITH {UNIVERSE}, {HOLDS_M},
scores AS (SELECT h.formed AS asof, p.symbol, p.close AS score FROM holds h JOIN panel p ON p.ts = h.formed),
{_legs_sql('scores', 3, None, 'universe')},
pub AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_discount) AS ret FROM lineitem GROUP BY 1)
SELECT 'Level' AS anomaly, {R('corr(ret_ls, ret)', 7)} AS rho, count(*) AS n_months, {R('avg(ret_ls)', 8)} AS mean_ours,
       {R('avg(ret)', 8)} AS mean_ref, corr(ret_ls, ret) > 0.9 AS pass
FROM series JOIN pub USING (month) WHERE month <= DATE '2000-12-01'""")
def job_calibration_universe(spark, sf_dir):
    """Calibration over the screened universe, with a longer panel than is reported."""
    house = _house(spark, "calibration")
    jobs.write_verdicts(vote.ballots(standins.bars_monthly(spark, sf_dir), TOL_M), house, "all")

    def level(panel: DataFrame, asofs: DataFrame) -> DataFrame:
        return signals.finalise(panel.join(F.broadcast(asofs), panel.ts == asofs.asof).withColumn("score", F.col("close")))

    def screened(panel: DataFrame, asofs: DataFrame) -> DataFrame:
        return universe.build_at(
            panel, standins.bars_monthly(spark, sf_dir), standins.supplier_filings(spark, sf_dir), standins.tickers(spark, sf_dir),
            asofs, **_SCREEN, forms=("F",), alive_days=30)

    li = standins.table(spark, sf_dir, "lineitem")
    pub = li.groupBy(F.trunc(F.to_date("l_shipdate"), "MM").alias("month")).agg(F.avg("l_discount").alias("ret"))
    report = jobs.calibration_run(
        spark, house, "Level", level, pub, "1990-01-01", LAST, cut="2000-12-01", n_buckets=3, universe_panel=screened, max_jump=JUMP_M)
    return report.select("anomaly", F.round("rho", 7).alias("rho"), "n_months", F.round("mean_ours", 8).alias("mean_ours"),
                         F.round("mean_ref", 8).alias("mean_ref"), "pass")


_DAY = "1998-07-01"


@query(f"""WITH {VERDICTS_M}, {panel_sql(JUMP_M, 2, "ts BETWEEN DATE '1998-07-02' - 103 AND DATE '1998-06-30'")}, {TICKERS}, {SUPPLIER_FILINGS},
asofs AS (SELECT DATE '1998-07-02' AS asof),
seen AS (SELECT asof, symbol, close FROM asofs JOIN truncated ON ts <= asof AND ts >= asof - 93),
med_close AS (SELECT symbol, median(close) AS c FROM seen GROUP BY 1),
med_volume AS (SELECT symbol, median(volume) AS v FROM bars_m WHERE ts BETWEEN DATE '1998-07-02' - 93 AND DATE '1998-06-30' GROUP BY 1),
alive AS (SELECT DISTINCT cik FROM filings WHERE form = 'F' AND filed BETWEEN DATE '1998-07-02' - 30 AND DATE '1998-07-02'),
names AS (SELECT DISTINCT t.symbol FROM med_close JOIN med_volume USING (symbol) JOIN tickers t USING (symbol) SEMI JOIN alive USING (cik)
          WHERE c > 104.5 AND c * v > 5500.0),
day AS (SELECT v.* FROM verdicts v JOIN names USING (symbol) WHERE v.ts = DATE '{_DAY}')
SELECT '{_DAY}' AS day, (SELECT count(*) FROM names) AS symbols, false AS empty, count(*) FILTER (status = 'ok') AS ok,
       count(*) FILTER (status = 'majority') AS majority, count(*) FILTER (status = 'quarantined') AS quarantined,
       (SELECT count(*) FROM bars_m JOIN names USING (symbol) WHERE ts = DATE '{_DAY}') AS landed FROM day
UNION ALL SELECT '2010-01-01', 0, true, 0, 0, 0, 0""")
def job_daily_universe(spark, sf_dir):
    """A daily run over the screened universe, and one on a day on which it is empty."""
    house = _house(spark, "daily")
    # Read for the history, the vendors and each vendor's landed bars.
    rows = store(ohlcv(standins.bars_monthly(spark, sf_dir)), "daily-bars")
    bars.write_bars(rows.filter(F.col("ts") < _DAY), house.path("bars"))
    jobs.vote_range(spark, house, "1990-01-01", "1998-06-30", TOL_M)
    standins.tickers(spark, sf_dir).write.parquet(house.path("tickers"))
    jobs.store_filings(house, standins.supplier_filings(spark, sf_dir).select(
        "cik", F.concat_ws("-", "cik", "form", "filed").alias("accn"), "form", "filed", F.lit("d").alias("primary_doc"),
        F.lit(0).cast("bigint").alias("seq"), F.lit("2024-01-01").cast("timestamp").alias("loaded_at")))
    vendors = [r[0] for r in rows.select("source").distinct().collect()]
    landed = {s: rows.filter(F.col("source") == s).drop("source") for s in vendors}
    screen = dict(_SCREEN, forms=("F",), alive_days=30, max_jump=JUMP_M)
    jobs.daily_run(spark, house, "1998-07-02", landed, tol=TOL_M, **screen)
    jobs.daily_run(spark, house, "2010-01-02", {}, tol=TOL_M, **screen)
    logged = events.read_events(spark, house.path("events"), "job.daily")
    number = {k: F.coalesce(F.get_json_object("payload", f"$.{k}").cast("bigint"), F.lit(0)) for k in
              ["symbols", "ok", "majority", "quarantined", *[f"{s}_rows" for s in vendors]]}
    return logged.select(
        F.get_json_object("payload", "$.day").alias("day"), number["symbols"].alias("symbols"),
        F.get_json_object("payload", "$.empty_universe").cast("boolean").alias("empty"), number["ok"].alias("ok"), number["majority"].alias("majority"),
        number["quarantined"].alias("quarantined"), sum((number[f"{s}_rows"] for s in vendors), F.lit(0)).alias("landed"))

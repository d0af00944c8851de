"""Queries over the price operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import calendar, canonical, dividends, market, vote
from tidemark.plans import standins
from tidemark.plans.registry import (
    BARS_D, BARS_M, DIVIDENDS, SPLITS, R, panel_sql, query, rounded, vote_sql,
)
from tidemark.session import store
from tidemark.sources.bars import select_bars

# Parameters that make every branch of the operators occur on the stand-in data.
TOL_D, TOL_M = 0.01, 0.02
JUMP_D, JUMP_M = 1.02, 1.06


def daily_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.ballots(standins.bars_daily(spark, sf_dir), TOL_D)


def monthly_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.ballots(standins.bars_monthly(spark, sf_dir), TOL_M)


def monthly_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.verdicts(monthly_votes(spark, sf_dir))


def stored_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts as a stored table, the form in which later jobs read them.

    For plans that look at the closes several times; the vote runs once.
    """
    return store(monthly_verdicts(spark, sf_dir), "verdicts")


def closes_of(verdicts: DataFrame) -> DataFrame:
    return canonical.read_canonical(verdicts, max_jump=JUMP_M, newest=None)


def panel_of(verdicts: DataFrame) -> DataFrame:
    return canonical.canonical_panel(verdicts, max_jump=JUMP_M, newest=None)


def monthly_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closes_of(monthly_verdicts(spark, sf_dir))


def monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_of(monthly_verdicts(spark, sf_dir))


VERDICTS_D = f"{BARS_D}, {vote_sql('bars_d', TOL_D)}"
VERDICTS_M = f"{BARS_M}, {vote_sql('bars_m', TOL_M)}"
PANEL_D = f"{VERDICTS_D}, {panel_sql(JUMP_D)}"
PANEL_M = f"{VERDICTS_M}, {panel_sql(JUMP_M)}"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with a correction of every third day and a second correction of every ninth."""
    bars = standins.bars_daily(spark, sf_dir).select(
        "symbol", "ts", F.lit("1d").alias("resolution"), "close", "volume", "source")

    def batch(step: int, bump: float, at: str) -> DataFrame:
        some = bars.filter(F.dayofmonth("ts") % step == 0)
        return some.withColumn("close", F.col("close") + bump).withColumn(
            "ingested_at", F.to_timestamp(F.lit(at))).withColumn("batch", F.lit(at))

    return batch(1, 0.0, "2024-02-01").unionByName(batch(3, 1.0, "2024-02-02")).unionByName(batch(9, 2.0, "2024-02-03"))


@query(f"""WITH {BARS_D}
SELECT symbol, ts, source, volume,
       close + CASE WHEN day(ts) % 9 = 0 THEN 2.0 WHEN day(ts) % 3 = 0 THEN 1.0 ELSE 0.0 END AS close
FROM bars_d WHERE ts BETWEEN DATE '2024-01-03' AND DATE '2024-01-27'""")
def bars_newest_wins(spark, sf_dir):
    rows = select_bars(_history(spark, sf_dir), start="2024-01-03", end="2024-01-27")
    return rows.select("symbol", "ts", "source", "volume", "close")


@query(f"WITH {VERDICTS_D} SELECT symbol, ts, close, n_sources, status FROM verdicts")
def vote_verdicts(spark, sf_dir):
    return vote.verdicts(daily_votes(spark, sf_dir))


@query(f"WITH {VERDICTS_M} SELECT symbol, ts, close, n_sources, status FROM verdicts")
def vote_verdicts_monthly(spark, sf_dir):
    return monthly_verdicts(spark, sf_dir)


@query(f"""WITH {VERDICTS_M}
SELECT CAST(year(ts) AS INTEGER) AS year, count(*) FILTER (status = 'ok') AS ok,
       count(*) FILTER (status = 'majority') AS majority, count(*) FILTER (status = 'quarantined') AS quarantined,
       {R("count(*) FILTER (status = 'quarantined') / count(*)")} AS quarantine_rate
FROM verdicts GROUP BY 1""")
def vote_counts_by_year(spark, sf_dir):
    rows = monthly_verdicts(spark, sf_dir).withColumn("year", F.year("ts"))
    return rounded(vote.verdict_counts(rows, "year"))


@query(f"""WITH {VERDICTS_D},
others AS (
  SELECT v.symbol, v.ts, sum(b.close) AS total,
         list_sort(coalesce(list(b.source) FILTER (NOT list_contains(v.agreeing, b.source)), [])) AS dissenting
  FROM verdicts v JOIN bars_d b ON v.symbol = b.symbol AND v.ts = b.ts GROUP BY v.symbol, v.ts)
SELECT CASE WHEN v.status = 'majority' THEN 'reconcile.majority' ELSE 'reconcile.quarantine' END AS kind,
       v.symbol, v.ts, v.n_sources, array_to_string(v.agreeing, ',') AS agreeing,
       CASE WHEN v.agreeing IS NOT NULL THEN array_to_string(o.dissenting, ',') END AS dissenting,
       {R('o.total')} AS sum_closes, v.close
FROM verdicts v JOIN others o ON v.symbol = o.symbol AND v.ts = o.ts WHERE v.status <> 'ok'""")
def vote_dissent_events(spark, sf_dir):
    e = vote.dissent_events(daily_votes(spark, sf_dir), TOL_D)
    total = F.aggregate(F.map_values("closes"), F.lit(0.0), lambda a, x: a + x)
    return rounded(e.select(
        "kind", "symbol", "ts", "n_sources", F.array_join("agreeing", ",").alias("agreeing"),
        F.array_join("dissenting", ",").alias("dissenting"), total.alias("sum_closes"), "close"), exact=("close",))


@query(f"WITH {PANEL_M} SELECT t.symbol, t.ts, t.close, v.n_sources, v.status "
       "FROM truncated t JOIN verdicts v ON t.symbol = v.symbol AND t.ts = v.ts")
def canonical_read(spark, sf_dir):
    return monthly_closes(spark, sf_dir)


@query(f"""WITH {VERDICTS_M}, {panel_sql(JUMP_M, 1, "ts >= DATE '1997-12-22' AND ts <= DATE '2000-06-30'")}
SELECT symbol, ts, close FROM truncated WHERE ts >= DATE '1998-01-01'""")
def canonical_window(spark, sf_dir):
    rows = canonical.read_canonical(
        monthly_verdicts(spark, sf_dir), start="1998-01-01", end="2000-06-30", min_sources=1, max_jump=JUMP_M, newest=None)
    return rows.select("symbol", "ts", "close")


@query(f"WITH {PANEL_D} SELECT symbol, ts, close FROM truncated")
def level_break_tail(spark, sf_dir):
    rows = canonical.vetted(vote.verdicts(daily_votes(spark, sf_dir)), newest=None)
    return canonical.drop_before_break(rows, JUMP_D).select("symbol", "ts", "close")


@query(f"""WITH {PANEL_D}
SELECT p.symbol, p.ts, p.close, min(b.ts) AS next_break
FROM panel p LEFT JOIN breaks b ON p.symbol = b.symbol AND b.ts > p.ts GROUP BY p.symbol, p.ts, p.close""")
def level_break_panel(spark, sf_dir):
    return canonical.canonical_panel(vote.verdicts(daily_votes(spark, sf_dir)), max_jump=JUMP_D, newest=None)


@query(f"""WITH {BARS_M}, {vote_sql('bars_m', TOL_M)},
again AS (
  SELECT symbol, ts, n_sources, status, close, 1 AS batch FROM verdicts
  UNION ALL SELECT symbol, ts, n_sources, 'quarantined', NULL, 2 FROM verdicts WHERE year(ts) = 1997 AND status = 'ok')
SELECT symbol, ts, close, n_sources, status FROM (
  SELECT * FROM again QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY batch DESC) = 1)
WHERE status <> 'quarantined' AND n_sources >= 2""")
def canonical_retraction(spark, sf_dir):
    v = monthly_verdicts(spark, sf_dir)
    first = v.withColumn("batch_ts", F.to_timestamp(F.lit("2024-01-01")))
    later = v.filter((F.year("ts") == 1997) & (F.col("status") == "ok")).select(
        "symbol", "ts", F.lit(None).cast("double").alias("close"), "n_sources", F.lit("quarantined").alias("status"),
        F.to_timestamp(F.lit("2024-01-02")).alias("batch_ts"))
    return canonical.vetted(first.unionByName(later))


_ADJUSTED = f"""{DIVIDENDS}, {SPLITS},
adjusted AS (
  SELECT d.symbol, d.ex_date, d.rate / coalesce(product(s.ratio), 1.0) AS rate
  FROM dividends d LEFT JOIN splits s ON d.symbol = s.symbol AND s.ex_date > d.ex_date
  GROUP BY d.symbol, d.ex_date, d.rate)"""


def adjusted_dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dividends.read_dividends(standins.dividends(spark, sf_dir), standins.splits(spark, sf_dir))


@query(f"WITH {_ADJUSTED} SELECT symbol, ex_date, {R('rate', 10)} AS rate FROM adjusted")
def dividends_split_adjusted(spark, sf_dir):
    return rounded(adjusted_dividends(spark, sf_dir).drop("special"), 10)


@query(f"""WITH {DIVIDENDS} SELECT symbol, ex_date, rate FROM dividends
WHERE ex_date BETWEEN DATE '1996-03-01' AND DATE '1999-02-28'""")
def dividends_declared(spark, sf_dir):
    return dividends.read_dividends(
        standins.dividends(spark, sf_dir), None, start="1996-03-01", end="1999-02-28").drop("special")


_MARKET = f"""{PANEL_D},
vol AS (SELECT symbol, ts, median(volume) AS volume FROM bars_d GROUP BY 1, 2),
joined AS (
  SELECT p.symbol, p.ts, p.close, p.close * v.volume AS dollars,
         p.close / lag(p.close) OVER (PARTITION BY p.symbol ORDER BY p.ts) - 1 AS ret
  FROM truncated p LEFT JOIN vol v ON p.symbol = v.symbol AND p.ts = v.ts),
market AS (
  SELECT symbol, ts, close, quantile_cont(dollars, 0.5) OVER w AS adv, stddev_samp(ret) OVER w AS sigma
  FROM joined WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def daily_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    closes = canonical.read_canonical(vote.verdicts(daily_votes(spark, sf_dir)), max_jump=JUMP_D, newest=None)
    return market.market_frame(closes, standins.bars_daily(spark, sf_dir), "2024-01-05")


@query(f"""WITH {_MARKET}
SELECT symbol, ts, close, {R('adv')} AS adv, {R('sigma', 9)} AS sigma
FROM market WHERE ts >= DATE '2024-01-05'""")
def market_frame(spark, sf_dir):
    m = daily_market(spark, sf_dir)
    return m.select("symbol", "ts", "close", F.round("adv", 6).alias("adv"), F.round("sigma", 9).alias("sigma"))


@query(f"""WITH {_MARKET}
SELECT symbol, ts, {R('coalesce(adv, 1e6)')} AS adv, {R('coalesce(greatest(sigma, 0.001), 0.02)', 9)} AS sigma
FROM (SELECT symbol, ts, adv, CASE WHEN sigma IS NULL THEN NULL ELSE sigma END AS sigma FROM market)
WHERE ts >= DATE '2024-01-05' AND sigma IS NOT NULL
UNION ALL
SELECT symbol, ts, {R('coalesce(adv, 1e6)')}, 0.02 FROM market WHERE ts >= DATE '2024-01-05' AND sigma IS NULL""")
def cost_inputs(spark, sf_dir):
    m = market.cost_inputs(daily_market(spark, sf_dir))
    return m.select("symbol", "ts", F.round("adv", 6).alias("adv"), F.round("sigma", 9).alias("sigma"))


_DAYS = "days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS ts FROM lineitem)"


def _ship_days(spark, sf_dir):
    return calendar.trading_days(standins.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("ts")))


def _rebalance_sql(key: str) -> str:
    return f"""WITH {_DAYS},
n AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS fill_ts, row_number() OVER (ORDER BY ts) AS pos FROM days)
SELECT ts, fill_ts FROM n WHERE fill_ts IS NOT NULL
  AND (pos = 1 OR date_trunc('{key}', ts) <> date_trunc('{key}', fill_ts))"""


@query(_rebalance_sql("week"))
def rebalance_days_weekly(spark, sf_dir):
    return calendar.rebalance_days(_ship_days(spark, sf_dir), "weekly")


@query(_rebalance_sql("month"))
def rebalance_days_monthly(spark, sf_dir):
    return calendar.rebalance_days(_ship_days(spark, sf_dir), "monthly")


@query(_rebalance_sql("day"))
def rebalance_days_daily(spark, sf_dir):
    return calendar.rebalance_days(_ship_days(spark, sf_dir), "daily")


@query(f"""WITH {_DAYS}, ends AS (SELECT max(ts) AS ts FROM days GROUP BY date_trunc('month', ts))
SELECT ts AS formed, lead(ts) OVER (ORDER BY ts) AS held_to FROM ends QUALIFY held_to IS NOT NULL""")
def holding_periods(spark, sf_dir):
    return calendar.holds(_ship_days(spark, sf_dir))


@query(f"""WITH {PANEL_M},
liquid AS (SELECT symbol, median(close * volume) AS dollar_volume, count(*) AS n FROM bars_m WHERE source = 'A'
           GROUP BY 1 HAVING count(*) >= 24),
history AS (SELECT symbol, count(*) AS n_closes FROM truncated GROUP BY 1),
top AS (SELECT * FROM liquid JOIN history USING (symbol) ORDER BY dollar_volume DESC, symbol LIMIT 50)
SELECT symbol, {R('dollar_volume')} AS dollar_volume, n, n_closes FROM top WHERE n_closes >= 27""")
def liquidity_ranking(spark, sf_dir):
    bars = standins.bars_monthly(spark, sf_dir).filter(F.col("source") == "A")
    return rounded(market.liquidity_ranking(bars, monthly_closes(spark, sf_dir), 50, 24, 27))


@query(f"""WITH {VERDICTS_M}
SELECT CAST(year(ts) AS INTEGER) AS year, count(*) AS symbol_days, count(*) FILTER (n_sources = 1) AS single_source,
       count(*) FILTER (status = 'quarantined') AS quarantined,
       {R('count(*) FILTER (n_sources = 1) / count(*)')} AS single_source_share,
       {R("count(*) FILTER (status = 'quarantined') / count(*)")} AS quarantine_rate
FROM verdicts GROUP BY 1""")
def quality_by_year(spark, sf_dir):
    return rounded(market.quality_by_year(monthly_verdicts(spark, sf_dir)))


@query(f"WITH {PANEL_M} SELECT symbol, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM truncated GROUP BY 1")
def rows_per_symbol(spark, sf_dir):
    return market.rows_per_symbol(monthly_closes(spark, sf_dir))

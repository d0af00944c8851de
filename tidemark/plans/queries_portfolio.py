"""Queries over long-short series, statistics, lots, portfolios and volatility."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import costs
from tidemark.operators import canonical, longshort, lots, portfolio, statistics, volatility, vote
from tidemark.operators.calendar import holds, trading_days
from tidemark.plans import standins
from tidemark.plans.queries_facts import MOMENTUM, UNIVERSE, momentum_scores, universe_frame
from tidemark.plans.queries_prices import (
    JUMP_D, PANEL_D, PANEL_M, _ADJUSTED, adjusted_dividends, closes_of, daily_votes, monthly_closes,
    monthly_panel, stored_verdicts,
)
from tidemark.plans.registry import R, query, rounded
from tidemark.session import store

# --- long-short ---------------------------------------------------------------------

HOLDS_M = """ends AS (SELECT max(ts) AS ts FROM truncated GROUP BY date_trunc('month', ts)),
holds AS (SELECT ts AS formed, lead(ts) OVER (ORDER BY ts) AS held_to FROM ends QUALIFY held_to IS NOT NULL),
finals AS (SELECT symbol, max(ts) AS last_ts, arg_max(close, ts) AS last_close FROM truncated GROUP BY 1),
priced AS (
  SELECT h.formed, h.held_to, a.symbol, a.close AS p0,
         CASE WHEN b.close IS NOT NULL THEN b.close
              WHEN f.last_ts > h.formed AND f.last_ts < h.held_to
              THEN f.last_close * CASE WHEN f.last_close < 1.0 THEN 0.7 ELSE 1.0 END END AS p1
  FROM holds h JOIN truncated a ON a.ts = h.formed
  LEFT JOIN truncated b ON b.ts = h.held_to AND b.symbol = a.symbol
  JOIN finals f ON f.symbol = a.symbol)"""


def _legs_sql(scores: str, n_buckets: int, dividends: str | None, universe: str | None = None) -> str:
    income = "SELECT h.formed, d.symbol, sum(d.rate) AS income FROM holds h JOIN {} d ON d.ex_date > h.formed AND d.ex_date <= h.held_to GROUP BY 1, 2"
    member = f"SEMI JOIN {universe} u ON u.symbol = s.symbol AND u.asof = s.asof" if universe else ""
    return f"""income AS ({income.format(dividends) if dividends else 'SELECT formed, NULL AS symbol, 0.0 AS income FROM holds'}),
ranked AS (
  SELECT s.asof, s.symbol, p.held_to, p.p0, p.p1, row_number() OVER (PARTITION BY s.asof ORDER BY s.score, s.symbol) AS r,
         count(*) OVER (PARTITION BY s.asof) AS n
  FROM {scores} s JOIN priced p ON p.formed = s.asof AND p.symbol = s.symbol {member}),
legs AS (
  SELECT asof, symbol, held_to, p0, p1, CASE WHEN r <= n // {n_buckets} THEN 'short' ELSE 'long' END AS leg FROM ranked
  WHERE n // {n_buckets} > 0 AND (r <= n // {n_buckets} OR r > n - n // {n_buckets})),
members AS (
  SELECT l.*, (l.p1 + coalesce(i.income, 0)) / l.p0 - 1 AS ret
  FROM legs l LEFT JOIN income i ON i.formed = l.asof AND i.symbol = l.symbol),
series AS (
  SELECT CAST(date_trunc('month', held_to) AS DATE) AS month,
         avg(ret) FILTER (leg = 'long') - avg(ret) FILTER (leg = 'short') AS ret_ls
  FROM members GROUP BY asof, held_to HAVING avg(ret) FILTER (leg = 'long') IS NOT NULL AND avg(ret) FILTER (leg = 'short') IS NOT NULL)"""


SERIES = f"{MOMENTUM}, {HOLDS_M}, {_ADJUSTED}, {_legs_sql('momentum', 10, 'adjusted')}"


def momentum_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = stored_verdicts(spark, sf_dir)
    return longshort.monthly_longshort(
        closes_of(verdicts), momentum_scores(spark, sf_dir, verdicts), dividends=adjusted_dividends(spark, sf_dir))


@query(f"WITH {PANEL_M}, {HOLDS_M} SELECT formed, held_to, symbol, p0, p1 FROM priced")
def priced_holds(spark, sf_dir):
    return longshort.priced_holds(closes_of(stored_verdicts(spark, sf_dir)))


@query(f"""WITH {MOMENTUM},
ranked AS (SELECT *, row_number() OVER (PARTITION BY asof ORDER BY score, symbol) AS r, count(*) OVER (PARTITION BY asof) AS n
           FROM momentum)
SELECT asof, symbol, CASE WHEN r <= n // 5 THEN 'short' ELSE 'long' END AS leg FROM ranked
WHERE n // 5 > 0 AND (r <= n // 5 OR r > n - n // 5)""")
def bucket_legs(spark, sf_dir):
    return longshort.bucket_legs(longshort.clean_scores(momentum_scores(spark, sf_dir, stored_verdicts(spark, sf_dir))), 5)


@query(f"""WITH {PANEL_M}, {HOLDS_M}, {_ADJUSTED}
SELECT h.formed, d.symbol, {R('sum(d.rate)')} AS income FROM holds h
JOIN adjusted d ON d.ex_date > h.formed AND d.ex_date <= h.held_to GROUP BY 1, 2""")
def hold_income(spark, sf_dir):
    periods = holds(trading_days(monthly_closes(spark, sf_dir)))
    return rounded(longshort.hold_income(adjusted_dividends(spark, sf_dir), periods))


@query(f"WITH {SERIES} SELECT month, {R('ret_ls', 9)} AS ret_ls FROM series")
def longshort_monthly(spark, sf_dir):
    return rounded(momentum_series(spark, sf_dir), 9)


@query(f"""WITH {UNIVERSE}, scores AS (SELECT asof, symbol, CAST(-cik AS DOUBLE) AS score FROM universe),
{HOLDS_M}, {_legs_sql('scores', 3, None, 'universe')}
SELECT month, {R('ret_ls', 9)} AS ret_ls FROM series""")
def longshort_universe(spark, sf_dir):
    verdicts = stored_verdicts(spark, sf_dir)
    names = universe_frame(spark, sf_dir, verdicts)
    scores = names.select("asof", "symbol", (-F.col("cik")).cast("double").alias("score"))
    return rounded(longshort.monthly_longshort(closes_of(verdicts), scores, 3, universe=names), 9)


# --- statistics ---------------------------------------------------------------------

MONTHLY = """a AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
                 CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e12 AS ret_ls FROM orders GROUP BY 1),
b AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
             CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 1e12 AS ret FROM lineitem GROUP BY 1)"""


@query(f"""WITH {SERIES}
SELECT count(*) AS n, coalesce(CASE WHEN min(ret_ls) <> max(ret_ls)
       THEN {R('avg(ret_ls) / stddev_samp(ret_ls) * sqrt(12)', 7)} END, 0.0) AS sharpe FROM series""")
def sharpe_longshort(spark, sf_dir):
    return rounded(statistics.sharpe(momentum_series(spark, sf_dir), "ret_ls"), 7)


@query(f"""SELECT l_returnflag AS source, count(*) AS n,
       {R('avg(l_discount) / stddev_samp(l_discount) * sqrt(12)', 7)} AS sharpe FROM lineitem GROUP BY 1
UNION ALL SELECT 'constant', count(*), 0.0 FROM orders""")
def sharpe_grouped(spark, sf_dir):
    li = standins.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_discount").alias("r"))
    flat = standins.table(spark, sf_dir, "orders").select(F.lit("constant").alias("source"), F.lit(0.01).alias("r"))
    return rounded(statistics.sharpe(li.unionByName(flat), "r", by=("source",)), 7)


@query(f"WITH {MONTHLY} SELECT {R('corr(ret_ls, ret)', 8)} AS rho, count(*) AS n FROM a JOIN b USING (month)")
def pearson_monthly(spark, sf_dir):
    return rounded(statistics.pearson(*standins.monthly_totals(spark, sf_dir)), 8)


@query(f"""WITH {MONTHLY}
SELECT 'Totals' AS anomaly, {R('corr(ret_ls, ret)', 8)} AS rho, count(*) AS n_months, {R('avg(ret_ls)', 8)} AS mean_ours,
       {R('avg(ret)', 8)} AS mean_ref, corr(ret_ls, ret) > 0.9 AS pass FROM a JOIN b USING (month)""")
def calibration_report(spark, sf_dir):
    a, b = standins.monthly_totals(spark, sf_dir)
    return rounded(statistics.calibration_report(a, b, "Totals"), 8)


@query(f"""WITH {MONTHLY}, curve AS (SELECT 'a' AS id, month AS ts, ret_ls AS equity FROM a UNION ALL SELECT 'b', month, ret FROM b)
SELECT id, ts, {R('equity', 8)} AS equity, {R('equity / lag(equity) OVER (PARTITION BY id ORDER BY ts) - 1', 7)} AS ret_net FROM curve""")
def equity_returns(spark, sf_dir):
    a, b = standins.monthly_totals(spark, sf_dir)
    curve = a.select(F.lit("a").alias("id"), F.col("month").alias("ts"), F.col("ret_ls").alias("equity")).unionByName(
        b.select(F.lit("b").alias("id"), F.col("month").alias("ts"), F.col("ret").alias("equity")))
    out = statistics.equity_returns(curve, ("id",))
    return out.select("id", "ts", F.round("equity", 8).alias("equity"), F.round("ret_net", 7).alias("ret_net"))


# --- costs, lots, tax ---------------------------------------------------------------

_NOTIONAL = "abs(l_extendedprice)"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey,
       {_NOTIONAL} * (5.0 / 2 / 1e4 + 0.1 * l_tax * sqrt({_NOTIONAL} / greatest(l_quantity * 100, 1.0))) AS cost
FROM lineitem""")
def trade_costs(spark, sf_dir):
    li = standins.table(spark, sf_dir, "lineitem")
    cost = costs.current_model().estimate(
        F.col("l_extendedprice"), F.lit(-1.0), F.col("l_quantity") * 100, F.col("l_tax"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", cost.alias("cost"))


FILLS = """fills AS (
  SELECT l_suppkey % 10 AS account, CAST(l_partkey % 50 AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS day,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linestatus = 'O' AS is_buy, l_quantity AS qty,
         l_extendedprice / l_quantity AS price
  FROM lineitem),
placed AS (
  SELECT *, sum(qty) OVER (PARTITION BY account, symbol, is_buy
    ORDER BY day, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS hi FROM fills),
edges AS (
  SELECT account, symbol, is_buy, hi - qty AS lo, hi,
         {'day': day, 'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'price': price, 'hi': hi} AS fill FROM placed),
carried AS (
  SELECT account, symbol, lo, coalesce(lead(lo) OVER book, 'infinity'::DOUBLE) AS upto,
         last_value(CASE WHEN NOT is_buy THEN fill END IGNORE NULLS) OVER so_far AS s,
         last_value(CASE WHEN is_buy THEN fill END IGNORE NULLS) OVER so_far AS b
  FROM edges
  WINDOW book AS (PARTITION BY account, symbol ORDER BY lo, hi, is_buy),
         so_far AS (PARTITION BY account, symbol ORDER BY lo, hi, is_buy ROWS UNBOUNDED PRECEDING)),
lots AS (
  SELECT account, symbol, s.day AS sell_day, s.l_orderkey AS sell_order, s.l_linenumber AS sell_line,
         b.day AS buy_day, b.l_orderkey AS buy_order, b.l_linenumber AS buy_line,
         least(upto, s.hi, b.hi) - lo AS qty, s.price AS sell_price, b.price AS buy_price
  FROM carried WHERE s IS NOT NULL AND b IS NOT NULL AND least(upto, s.hi, b.hi) > lo)"""


@query(f"""WITH {FILLS}
SELECT account, symbol, sell_day, sell_order, sell_line, buy_day, buy_order, buy_line, qty,
       qty * (sell_price - buy_price) AS gain, sell_day - buy_day > 365 AS long_term, sell_day < buy_day AS out_of_order
FROM lots""")
def fifo_lots(spark, sf_dir):
    m = lots.match_lots(standins.fills(spark, sf_dir))
    return m.select(
        "account", "symbol", "sell_day", F.col("sell_seq.l_orderkey").alias("sell_order"),
        F.col("sell_seq.l_linenumber").alias("sell_line"), "buy_day", F.col("buy_seq.l_orderkey").alias("buy_order"),
        F.col("buy_seq.l_linenumber").alias("buy_line"), "qty", "gain", "long_term", "out_of_order")


@query(f"""WITH {FILLS}, bought AS (SELECT account, symbol, sum(qty) AS b FROM fills WHERE is_buy GROUP BY 1, 2)
SELECT account, symbol, day, l_orderkey, l_linenumber, {R('hi - greatest(hi - qty, coalesce(b, 0))', 4)} AS unmatched_qty
FROM placed LEFT JOIN bought USING (account, symbol) WHERE NOT is_buy AND hi - greatest(hi - qty, coalesce(b, 0)) > 1e-9""")
def unmatched_sells(spark, sf_dir):
    u = lots.unmatched_sells(standins.fills(spark, sf_dir))
    return u.select("account", "symbol", "day", "seq.l_orderkey", "seq.l_linenumber", F.round("unmatched_qty", 4).alias("unmatched_qty"))


@query(f"""WITH {FILLS}
SELECT account, symbol, {R('greatest(sum(CASE WHEN is_buy THEN qty ELSE -qty END), 0.0)', 4)} AS qty
FROM fills GROUP BY 1, 2 HAVING sum(CASE WHEN is_buy THEN qty ELSE -qty END) > 1e-9""")
def shares_held(spark, sf_dir):
    return rounded(lots.held(standins.fills(spark, sf_dir)), 4)


@query(f"""WITH {FILLS},
years AS (
  SELECT account, CAST(year(sell_day) AS INTEGER) AS year,
         coalesce(sum(qty * (sell_price - buy_price)) FILTER (NOT sell_day - buy_day > 365), 0) AS st,
         coalesce(sum(qty * (sell_price - buy_price)) FILTER (sell_day - buy_day > 365), 0) AS lt
  FROM lots GROUP BY 1, 2)
SELECT account, year, {R('st', 1)} AS st, {R('lt', 1)} AS lt,
       {R('''CASE WHEN st + lt <= 0 THEN 0 WHEN st < 0 THEN (st + lt) * 0.15 WHEN lt < 0 THEN (st + lt) * 0.35
            ELSE st * 0.35 + lt * 0.15 END''', 1)} AS tax_paid FROM years""")
def annual_tax(spark, sf_dir):
    return rounded(lots.annual_tax(lots.match_lots(standins.fills(spark, sf_dir))), 1)


# --- portfolios ---------------------------------------------------------------------

_STRATEGY = portfolio.Strategy("momentum", 7, "monthly")

TARGETS = f"""{MOMENTUM},
caldays AS (SELECT DISTINCT ts FROM truncated),
decisions AS (
  SELECT ts AS asof, fill_ts FROM (
    SELECT ts, lead(ts) OVER (ORDER BY ts) AS fill_ts, row_number() OVER (ORDER BY ts) AS pos FROM caldays)
  WHERE fill_ts IS NOT NULL AND (pos = 1 OR date_trunc('month', ts) <> date_trunc('month', fill_ts))),
picked AS (
  SELECT m.asof, d.fill_ts, m.symbol FROM momentum m JOIN decisions d ON d.asof = m.asof
  SEMI JOIN truncated t ON t.ts = m.asof AND t.symbol = m.symbol
  QUALIFY row_number() OVER (PARTITION BY m.asof ORDER BY m.score DESC, m.symbol) <= 7),
targets AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY asof) AS weight FROM picked)"""


def momentum_targets(spark: SparkSession, sf_dir: str, verdicts: DataFrame) -> DataFrame:
    return portfolio.targets(momentum_scores(spark, sf_dir, verdicts), closes_of(verdicts), _STRATEGY)


@query(f"WITH {TARGETS} SELECT asof, fill_ts, symbol, {R('weight')} AS weight FROM targets")
def target_holdings(spark, sf_dir):
    return rounded(momentum_targets(spark, sf_dir, stored_verdicts(spark, sf_dir)))


_FEE = "(abs(delta) * 1e6) * (5.0 / 2 / 1e4 + 0.1 * 0.02 * sqrt(abs(delta) * 1e6 / 1e6))"


@query(f"""WITH {TARGETS},
stops AS (SELECT DISTINCT fill_ts FROM (SELECT fill_ts FROM targets UNION ALL SELECT max(ts) FROM truncated)),
periods AS (SELECT fill_ts, lead(fill_ts) OVER (ORDER BY fill_ts) AS next_fill FROM stops QUALIFY next_fill IS NOT NULL),
entry AS (SELECT p.fill_ts, p.next_fill, t.symbol, t.close AS p_in FROM periods p JOIN truncated t ON t.ts = p.fill_ts),
outs AS (
  SELECT e.fill_ts, e.next_fill, e.symbol, e.p_in, arg_max(t.close, t.ts) AS p_out
  FROM entry e JOIN truncated t ON t.symbol = e.symbol AND t.ts >= e.fill_ts AND t.ts <= e.next_fill GROUP BY 1, 2, 3, 4),
grown AS (SELECT o.fill_ts, o.next_fill, o.symbol, g.weight, g.weight * o.p_out / o.p_in AS value
          FROM targets g JOIN outs o ON o.fill_ts = g.fill_ts AND o.symbol = g.symbol),
gross AS (SELECT fill_ts, next_fill, sum(value - weight) AS gross FROM grown GROUP BY 1, 2),
drifted AS (SELECT g.next_fill AS fill_ts, g.symbol, g.value / (1 + r.gross) AS w FROM grown g JOIN gross r USING (fill_ts)
            SEMI JOIN periods p ON p.fill_ts = g.next_fill),
trades AS (SELECT coalesce(g.fill_ts, d.fill_ts) AS fill_ts, coalesce(g.weight, 0) - coalesce(d.w, 0) AS delta
           FROM grown g FULL JOIN drifted d ON d.fill_ts = g.fill_ts AND d.symbol = g.symbol),
traded AS (SELECT fill_ts, sum(abs(delta)) AS turnover, sum({_FEE}) AS cost FROM trades GROUP BY 1)
SELECT fill_ts, next_fill, {R('gross', 8)} AS gross, {R('turnover', 8)} AS turnover, {R('cost', 4)} AS cost,
       {R('gross - cost / 1e6', 8)} AS net,
       {R('exp(sum(ln(1 + gross - cost / 1e6)) OVER (ORDER BY fill_ts))', 8)} AS nav
FROM gross JOIN traded USING (fill_ts)""")
def rebalanced_series(spark, sf_dir):
    verdicts = stored_verdicts(spark, sf_dir)
    book = store(momentum_targets(spark, sf_dir, verdicts), "targets")
    s = portfolio.rebalanced_series(book, closes_of(verdicts), costs.current_model())
    return s.select("fill_ts", "next_fill", F.round("gross", 8).alias("gross"), F.round("turnover", 8).alias("turnover"),
                    F.round("cost", 4).alias("cost"), F.round("net", 8).alias("net"), F.round("nav", 8).alias("nav"))


_SNAPSHOT = """snapshot AS (SELECT l_suppkey % 20 AS account, 'S' || (l_partkey % 40) AS symbol, sum(l_quantity) AS qty
  FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
book AS (SELECT l_suppkey % 20 AS account, 'S' || (l_partkey % 30 + 5) AS symbol, 1.0 / 30 AS weight FROM lineitem GROUP BY 1, 2),
cash AS (SELECT l_suppkey % 20 AS account, sum(l_quantity) AS cash FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
prices AS (SELECT 'S' || (l_partkey % 40) AS symbol, round(100 + sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*), 4) AS close
           FROM lineitem GROUP BY 1 HAVING symbol NOT IN ('S38', 'S39'))"""


def _snapshot(spark, sf_dir):
    li = standins.table(spark, sf_dir, "lineitem")
    account = (F.col("l_suppkey") % 20).alias("account")
    holdings = li.filter("l_linestatus = 'F'").groupBy(
        account, F.concat(F.lit("S"), F.col("l_partkey") % 40).alias("symbol")).agg(F.sum("l_quantity").alias("qty"))
    book = li.select(account, F.concat(F.lit("S"), F.col("l_partkey") % 30 + 5).alias("symbol")).distinct().withColumn(
        "weight", F.lit(1.0) / 30)
    cash = li.filter("l_linenumber = 1").groupBy(account).agg(F.sum("l_quantity").alias("cash"))
    mean = 100 + F.sum(standins.cents(F.col("l_discount"))).cast("double") / F.count(F.lit(1))
    prices = li.groupBy(F.concat(F.lit("S"), F.col("l_partkey") % 40).alias("symbol")).agg(
        F.round(mean, 4).alias("close")).filter("symbol NOT IN ('S38', 'S39')")
    return holdings, book, cash, prices


@query(f"""WITH {_SNAPSHOT},
lines AS (SELECT account, symbol, coalesce(qty, 0) AS qty, coalesce(weight, 0) AS weight FROM snapshot FULL JOIN book USING (account, symbol)),
priced AS (SELECT l.*, p.close FROM lines l JOIN prices p USING (symbol)),
val AS (SELECT account, sum(qty * close) + coalesce(any_value(cash), 0) AS v FROM priced LEFT JOIN cash USING (account) GROUP BY 1)
SELECT account, symbol, CASE WHEN weight * v / close - qty > 0 THEN 1 ELSE 0 END AS side_rank, close,
       {R('weight', 8)} AS target_weight, {R('qty * close / v', 8)} AS current_weight, {R('weight * v / close - qty', 5)} AS delta
FROM priced JOIN val USING (account)
WHERE abs(weight - qty * close / v) >= 0.004 AND abs(weight * v / close - qty) * close >= 1e-6""")
def drift_orders(spark, sf_dir):
    o = portfolio.drift_orders(*_snapshot(spark, sf_dir), 0.004)
    return o.select("account", "symbol", "side_rank", "close",
                    F.round("target_weight", 8).alias("target_weight"), F.round("current_weight", 8).alias("current_weight"),
                    F.round("delta", 5).alias("delta"))


@query(f"""WITH {PANEL_D},
holdings AS (SELECT user_id % 7 AS account, 'U' || user_id AS symbol, DATE '2024-01-01' + CAST(event_id % 30 AS INTEGER) AS day,
                    count(*) AS qty FROM events GROUP BY 1, 2, 3)
SELECT h.account, h.symbol, h.day, h.qty, max(t.ts) AS last_ts, arg_max(t.close, t.ts) AS price
FROM holdings h LEFT JOIN truncated t ON t.symbol = h.symbol AND t.ts < h.day
WHERE NOT EXISTS (SELECT 1 FROM truncated c WHERE c.symbol = h.symbol AND c.ts = h.day) GROUP BY 1, 2, 3, 4""")
def left_panel(spark, sf_dir):
    e = standins.table(spark, sf_dir, "events")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("event_id") % 30).cast("int"))
    holdings = e.groupBy((F.col("user_id") % 7).alias("account"), F.concat(F.lit("U"), F.col("user_id")).alias("symbol"),
                         day.alias("day")).agg(F.count(F.lit(1)).alias("qty"))
    return portfolio.left_panel(holdings, _daily_closes(spark, sf_dir))


def _daily_closes(spark, sf_dir):
    return canonical.read_canonical(vote.verdicts(daily_votes(spark, sf_dir)), max_jump=JUMP_D, newest=None)


# --- volatility ---------------------------------------------------------------------

_W, _H = 24, 3

WALK = f"""{PANEL_M},
num AS (
  SELECT symbol, ts, close, row_number() OVER s - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n,
         ln(close) - ln(lag(close) OVER s) AS ret
  FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
steps AS (
  SELECT DISTINCT symbol, n, unnest(generate_series(0, (n - {_W}) // {_H} - 1)) AS step FROM num WHERE n >= {_W} + {_H}),
actuals AS (
  SELECT s.symbol, s.step, coalesce(stddev_samp(r.ret), 0) * sqrt(252) AS actual
  FROM steps s JOIN num r ON r.symbol = s.symbol AND r.pos > {_W} + s.step * {_H} AND r.pos < {_W} + (s.step + 1) * {_H}
  GROUP BY 1, 2),
contexts AS (
  SELECT s.symbol, s.step, {_W} + s.step * {_H} - 1 - r.pos AS age, r.ret
  FROM steps s JOIN num r ON r.symbol = s.symbol AND r.pos > s.step * {_H} AND r.pos < {_W} + s.step * {_H}),
forecasts AS (
  SELECT 'ewma' AS forecaster, symbol, step, sqrt(252 * sum(pow(0.94, age) * CASE WHEN age = {_W - 2} THEN 1 ELSE 0.06 END * ret * ret)) AS pred
  FROM contexts GROUP BY symbol, step
  UNION ALL
  SELECT 'slow', symbol, step, sqrt(252 * sum(pow(0.97, age) * CASE WHEN age = {_W - 2} THEN 1 ELSE 0.03 END * ret * ret))
  FROM contexts GROUP BY symbol, step
  UNION ALL
  SELECT 'trailing', symbol, step, stddev_samp(ret) * sqrt(252) FROM contexts GROUP BY symbol, step)"""

_LAMBDAS = {"ewma": volatility.LAMBDA, "slow": 0.97}


def _walk_bars(spark, sf_dir):
    return monthly_panel(spark, sf_dir).select("symbol", "ts", "close")


def _forecasts(bars):
    return volatility.built_in_forecasts(bars, _LAMBDAS, _W, _H)


@query(f"""WITH {WALK} SELECT symbol, {R('coalesce(stddev_samp(ret), 0) * sqrt(252)', 9)} AS realized_vol FROM num GROUP BY 1""")
def realized_vol(spark, sf_dir):
    return rounded(volatility.realized_vol(_walk_bars(spark, sf_dir)), 9)


@query(f"WITH {WALK} SELECT symbol, step, {R('actual', 9)} AS actual FROM actuals")
def realized_targets(spark, sf_dir):
    return rounded(volatility.realized_targets(_walk_bars(spark, sf_dir), _W, _H), 9)


@query(f"WITH {WALK} SELECT forecaster, symbol, step, {R('pred', 9)} AS pred FROM forecasts")
def ewma_forecasts(spark, sf_dir):
    return rounded(_forecasts(_walk_bars(spark, sf_dir)), 9)


@query(f"""WITH {WALK}, joined AS (SELECT f.*, a.actual FROM forecasts f JOIN actuals a USING (symbol, step)),
spread AS (SELECT stddev_samp(pred) AS sd FROM joined GROUP BY symbol, step)
SELECT forecaster, count(*) AS n, {R('avg(abs(pred - actual))', 8)} AS mae FROM joined GROUP BY 1
UNION ALL SELECT 'absent', 0, NULL
UNION ALL SELECT 'disagreement', count(*), {R('avg(sd)', 8)} FROM spread""")
def forecast_scores(spark, sf_dir):
    wide = volatility.walk_forward(_walk_bars(spark, sf_dir), _LAMBDAS, _W, _H)
    return rounded(volatility.score_walk(wide, [*_LAMBDAS, "trailing", "absent"]), 8)


@query(f"""WITH {WALK}, p AS (SELECT symbol, step, sqrt(252 * avg(ret * ret)) AS pred FROM contexts GROUP BY 1, 2)
SELECT 'mean square' AS forecaster, symbol, step, {R('pred', 9)} AS pred FROM p""")
def custom_forecasts(spark, sf_dir):
    def mean_square(context: pd.DataFrame) -> float:
        logs = np.diff(np.log(context["close"].to_numpy()))
        return float(math.sqrt(252 * np.mean(logs * logs)))

    return rounded(volatility.custom_forecasts(_walk_bars(spark, sf_dir), "mean square", mean_square, _W, _H), 9)


@query("""WITH raw AS (
  SELECT 'U' || user_id AS symbol, CASE WHEN event_id % 997 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS ts,
         CASE WHEN value > 95 THEN -value ELSE value END AS close FROM events),
days AS (SELECT symbol, ts, count(*) AS n, count(*) FILTER (NOT close > 0) AS bad FROM raw GROUP BY 1, 2)
SELECT symbol, CAST(sum(bad) AS BIGINT) AS bad_close, CAST(coalesce(sum(n) FILTER (ts IS NULL), 0) AS BIGINT) AS null_ts,
       count(*) FILTER (ts IS NOT NULL AND n > 1) AS duplicate_ts
FROM days GROUP BY 1 HAVING sum(bad) > 0 OR coalesce(sum(n) FILTER (ts IS NULL), 0) > 0 OR count(*) FILTER (ts IS NOT NULL AND n > 1) > 0""")
def bar_violations(spark, sf_dir):
    e = standins.table(spark, sf_dir, "events")
    raw = e.select(
        F.concat(F.lit("U"), F.col("user_id")).alias("symbol"),
        F.when(F.col("event_id") % 997 != 0, F.to_date("ts")).alias("ts"),
        F.when(F.col("value") > 95, -F.col("value")).otherwise(F.col("value")).alias("close"))
    return volatility.bar_violations(raw)

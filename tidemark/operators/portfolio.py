"""Target portfolios, their return series, and orders against a holdings snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.costs import CostModel
from tidemark.functions.values import positive
from tidemark.operators.calendar import FREQUENCIES, rebalance_days, trading_days
from tidemark.operators.longshort import clean_scores
from tidemark.operators.market import DEFAULT_ADV, DEFAULT_SIGMA

# Fixed values.
QTY_EPS = 1e-9
MIN_TRADE_NOTIONAL = 1e-6


@dataclass(frozen=True)
class Strategy:
    """What to hold: the ``n_long`` best names, looked at ``rebalance``. Orders have a drift band of their own."""

    name: str
    n_long: int
    rebalance: str = "monthly"

    def __post_init__(self) -> None:
        label, rhythm = str(self.name).strip(), str(self.rebalance).strip().lower()
        unmet = [rule for rule, met in {
            "a name that is not blank": isinstance(self.name, str) and label,
            "n_long, a whole number from 1": type(self.n_long) is int and self.n_long > 0,
            f"rebalance, one of {', '.join(FREQUENCIES)}": isinstance(self.rebalance, str) and rhythm in FREQUENCIES,
        }.items() if not met]
        if unmet:
            raise ValueError(f"a strategy needs {'; '.join(unmet)}")
        object.__setattr__(self, "name", label)
        object.__setattr__(self, "rebalance", rhythm)


def targets(scores: DataFrame, closes: DataFrame, strategy: Strategy, days: DataFrame | None = None) -> DataFrame:
    """The ``n_long`` best names priced on each decision day, equally weighted.

    A name without a close that day makes room for the next one. A day with no
    picks has no rows, which leaves the previous book in force. Columns: asof,
    fill_ts, symbol, weight.
    """
    usable = closes.filter(positive(F.col("close")))
    decisions = rebalance_days(trading_days(usable) if days is None else days, strategy.rebalance)
    ranked = (
        clean_scores(scores)
        .join(F.broadcast(decisions.withColumnRenamed("ts", "asof")), "asof")
        .join(usable.select(F.col("ts").alias("asof"), "symbol"), ["asof", "symbol"], "left_semi")
    )
    best = W.partitionBy("asof").orderBy(F.col("score").desc(), "symbol")
    picked = ranked.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= strategy.n_long)
    size = F.count(F.lit(1)).over(W.partitionBy("asof"))
    return picked.select("asof", "fill_ts", "symbol", (1.0 / size).alias("weight"))


def rebalanced_series(
    book: DataFrame, closes: DataFrame, model: CostModel, capital: float = 1_000_000.0, quotes: DataFrame | None = None
) -> DataFrame:
    """Return series of a portfolio rebalanced to ``book`` in full on each fill day.

    This is a closed form, not a cash-and-shares simulation: there is no drift
    band and no scaling of orders to the cash at hand, and costs are charged on
    trades of a fixed reference ``capital``. Between fills each name is bought
    and held; a name that stops trading is carried at its last close, and one
    without a close on its fill day stays in cash.

    ``quotes`` (symbol, ts, adv, sigma) feeds the cost model; without it the
    defaults apply. Columns: fill_ts, next_fill, gross, turnover, cost, net, nav.
    """
    usable = closes.filter(positive(F.col("close"))).select("symbol", "ts", "close")
    # The last day of the panel closes the last period.
    final = usable.agg(F.max("ts").alias("fill_ts"))
    periods = (
        book.select("fill_ts").unionByName(final).distinct()
        .select("fill_ts", F.lead("fill_ts").over(W.orderBy("fill_ts")).alias("next_fill"))
        .filter(F.col("next_fill").isNotNull())
    )
    each = F.sequence(F.col("fill_ts"), F.col("next_fill"))
    spans = F.broadcast(periods.select("fill_ts", "next_fill", F.explode(each).alias("ts")))
    prices = (
        usable.join(spans, "ts")
        .groupBy("fill_ts", "next_fill", "symbol")
        .agg(F.max(F.when(F.col("ts") == F.col("fill_ts"), F.col("close"))).alias("_in"),
             F.max_by("close", "ts").alias("_out"))
        .filter(F.col("_in").isNotNull())
    )
    grown = book.select("fill_ts", "symbol", "weight").join(prices, ["fill_ts", "symbol"]).withColumn(
        "_value", F.col("weight") * F.col("_out") / F.col("_in"))
    gross = grown.groupBy("fill_ts", "next_fill").agg(F.sum(F.col("_value") - F.col("weight")).alias("gross"))
    # What the previous book has drifted to by the next fill day.
    drifted = grown.join(gross, ["fill_ts", "next_fill"]).select(
        F.col("next_fill").alias("fill_ts"), "symbol", (F.col("_value") / (1 + F.col("gross"))).alias("_from"))
    trades = (
        grown.select("fill_ts", "symbol", F.col("weight").alias("_to"))
        .join(drifted.join(F.broadcast(periods.select("fill_ts")), "fill_ts", "left_semi"), ["fill_ts", "symbol"], "full")
        .withColumn("_delta", F.coalesce("_to", F.lit(0.0)) - F.coalesce("_from", F.lit(0.0)))
    )
    if quotes is None:
        trades = trades.withColumn("adv", F.lit(DEFAULT_ADV)).withColumn("sigma", F.lit(DEFAULT_SIGMA))
    else:
        trades = trades.join(
            quotes.select("symbol", F.col("ts").alias("fill_ts"), "adv", "sigma"), ["fill_ts", "symbol"], "left")
        trades = trades.withColumn("adv", F.coalesce("adv", F.lit(DEFAULT_ADV))).withColumn(
            "sigma", F.coalesce("sigma", F.lit(DEFAULT_SIGMA)))
    fee = model.estimate(F.lit(float(capital)), F.col("_delta"), F.col("adv"), F.col("sigma"))
    traded = trades.groupBy("fill_ts").agg(F.sum(F.abs("_delta")).alias("turnover"), F.sum(fee).alias("cost"))
    by_fill = W.orderBy("fill_ts").rowsBetween(W.unboundedPreceding, 0)
    return (
        gross.join(traded, "fill_ts")
        .withColumn("net", F.col("gross") - F.col("cost") / F.lit(float(capital)))
        .withColumn("nav", F.exp(F.sum(F.log1p("net")).over(by_fill)))
        .withColumn("cost_model_version", F.lit(model.version))
    )


def drift_orders(
    holdings: DataFrame, book: DataFrame, cash: DataFrame, prices: DataFrame, drift_band: float = 0.0
) -> DataFrame:
    """Orders that move accounts to their targets where the drift reaches the band.

    ``holdings``: account, symbol, qty. ``book``: account, symbol, weight.
    ``cash``: account, cash. ``prices``: symbol, close. A name without a price
    cannot be traded. ``side_rank`` is 0 for sells and 1 for buys, which are
    funded by them; order by it within an account.
    """
    lines = holdings.select("account", "symbol", "qty").join(
        book.select("account", "symbol", "weight"), ["account", "symbol"], "full")
    quoted = prices.filter(positive(F.col("close"))).select("symbol", "close")
    priced = lines.join(quoted, "symbol").select(
        "account", "symbol", "close", F.coalesce("qty", F.lit(0.0)).alias("qty"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"))
    worth = priced.groupBy("account").agg(F.sum(F.col("qty") * F.col("close")).alias("_worth"))
    value = worth.join(cash, "account", "left").select(
        "account", (F.col("_worth") + F.coalesce("cash", F.lit(0.0))).alias("portfolio"))
    current = F.try_divide(F.col("qty") * F.col("close"), F.col("portfolio"))
    delta = F.try_divide(F.col("weight") * F.col("portfolio"), F.col("close")) - F.col("qty")
    return (
        priced.join(value.filter(F.col("portfolio") > 0), "account")
        .filter(F.abs(F.col("weight") - current) >= drift_band)
        .withColumn("delta", delta)
        .filter(F.abs(F.col("delta")) * F.col("close") >= MIN_TRADE_NOTIONAL)
        .select("account", "symbol", F.when(F.col("delta") > 0, 1).otherwise(0).alias("side_rank"), "close",
                F.col("weight").alias("target_weight"), current.alias("current_weight"), "delta")
    )


def left_panel(holdings: DataFrame, closes: DataFrame) -> DataFrame:
    """Holdings without a close on their day, with the last close before it.

    ``holdings``: account, symbol, day, qty. Adds last_ts and price; the exit is
    dated at ``last_ts``. Many accounts ask about the same (symbol, day), so the
    question is reduced to distinct pairs before it meets the closes; the as-of
    lookup is then a fill-forward over at most two rows per symbol and day.
    """
    usable = closes.filter(positive(F.col("close"))).select("symbol", "ts", "close")
    asked = holdings.select("symbol", F.col("day").alias("ts")).distinct().join(usable, ["symbol", "ts"], "left_anti")
    stacked = usable.withColumn("_ask", F.lit(False)).unionByName(
        asked.select("symbol", "ts", F.lit(None).cast("double").alias("close"), F.lit(True).alias("_ask")))
    before = W.partitionBy("symbol").orderBy("ts").rowsBetween(W.unboundedPreceding, -1)
    seen = F.last(F.when(~F.col("_ask"), F.struct("ts", "close")), ignorenulls=True).over(before)
    answers = stacked.withColumn("_seen", seen).filter("_ask").select(
        "symbol", F.col("ts").alias("day"), F.col("_seen.ts").alias("last_ts"), F.col("_seen.close").alias("price"))
    return holdings.join(answers, ["symbol", "day"])

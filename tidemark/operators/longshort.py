"""Equal-weight long-short series from a signal panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.values import finite, positive
from tidemark.operators.calendar import days_of_holds, holds, trading_days

# Fixed values.
DELIST_RETURN = -0.30
DELIST_PRICE_FLOOR = 1.0


def clean_scores(scores: DataFrame) -> DataFrame:
    """Usable scores, the best one per (asof, symbol)."""
    return (
        scores.select("asof", F.col("symbol").cast("string").alias("symbol"), F.col("score").cast("double").alias("score"))
        .filter(F.col("symbol").isNotNull() & finite(F.col("score")))
        .groupBy("asof", "symbol").agg(F.max("score").alias("score"))
    )


def bucket_legs(scores: DataFrame, n_buckets: int, carry: Sequence[str] = ()) -> DataFrame:
    """Top and bottom ``floor(n / n_buckets)`` names per date: asof, symbol, leg and the ``carry`` columns.

    Ties go by symbol. ``ntile`` would not do: it spreads the remainder over the
    buckets. A date's cross-section is one row per listed symbol, which bounds
    what a task ranks, however long the study is.
    """
    if isinstance(n_buckets, bool) or not isinstance(n_buckets, int):
        raise TypeError("n_buckets must be an int")
    if n_buckets < 2:
        raise ValueError("n_buckets must be at least 2")
    section = W.partitionBy("asof")
    ranked = scores.select(
        "asof", "symbol", *carry,
        F.row_number().over(section.orderBy("score", "symbol")).alias("_rank"),
        F.count(F.lit(1)).over(section).alias("_n"),
    )
    width = F.floor(F.col("_n") / n_buckets)
    leg = F.when(F.col("_rank") <= width, "short").when(F.col("_rank") > F.col("_n") - width, "long")
    return ranked.select("asof", "symbol", *carry, leg.alias("leg")).filter(F.col("leg").isNotNull())


def holding_periods(closes: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """The holds of ``days``, by default the days with a usable close."""
    return holds(trading_days(closes.filter(positive(F.col("close")))) if days is None else days)


def priced_holds(closes: DataFrame, days: DataFrame | None = None, periods: DataFrame | None = None) -> DataFrame:
    """Formation and exit price of every symbol in every holding period.

    Columns: formed, held_to, symbol, p0, p1. ``p1`` is the close at the end of
    the hold or, for a symbol whose very last close lies strictly inside it,
    that close (cut by 30 percent below one dollar); otherwise null.

    All windows partition by symbol, the key the closes already arrive on, and
    the calendar is broadcast, so pricing adds no shuffle.
    """
    usable = closes.filter(positive(F.col("close"))).select("symbol", "ts", "close")
    periods = (holding_periods(closes, days) if periods is None else periods).select(F.col("formed").alias("ts"), "held_to")
    final = periods.groupBy().agg(F.max("held_to").alias("ts")).select("ts", F.lit(None).cast("date").alias("held_to"))
    wanted = F.broadcast(periods.unionByName(final))

    whole = W.partitionBy("symbol")
    last = F.max(F.struct("ts", "close")).over(whole)
    by_day = whole.orderBy("ts")
    inside = (F.col("_last.ts") > F.col("ts")) & (F.col("_last.ts") < F.col("held_to"))
    sold = F.col("_last.close") * F.when(F.col("_last.close") < DELIST_PRICE_FLOOR, 1 + DELIST_RETURN).otherwise(1.0)
    return (
        usable.withColumn("_last", last)
        .join(wanted, "ts")
        .withColumn("_next", F.lead(F.struct("ts", "close")).over(by_day))
        .filter(F.col("held_to").isNotNull())
        .select(
            F.col("ts").alias("formed"), "held_to", "symbol", F.col("close").alias("p0"),
            F.when(F.col("_next.ts") == F.col("held_to"), F.col("_next.close"))
            .when(inside, sold).alias("p1"),
        )
    )


def hold_income(dividends: DataFrame, periods: DataFrame) -> DataFrame:
    """Cash per share with ex-dates in ``(formed, held_to]``: formed, symbol, income."""
    return (
        dividends.filter(finite(F.col("rate")))
        .join(F.broadcast(days_of_holds(periods)), F.col("ex_date") == F.col("day"))
        .groupBy("formed", "symbol").agg(F.sum("rate").alias("income"))
    )


def leg_members(
    closes: DataFrame, scores: DataFrame, n_buckets: int = 10, universe: DataFrame | None = None,
    dividends: DataFrame | None = None, days: DataFrame | None = None,
) -> DataFrame:
    """Each leg member with its total return over the hold (null when it vanished).

    Names outside the universe or without a close at formation are not ranked.
    """
    periods = holding_periods(closes, days)
    priced = priced_holds(closes, periods=periods)
    ranked = clean_scores(scores)
    if universe is not None:
        ranked = ranked.join(universe.select("asof", "symbol").distinct(), ["asof", "symbol"], "left_semi")
    prices = ["held_to", "p0", "p1"]
    buyable = ranked.join(priced.select(F.col("formed").alias("asof"), "symbol", *prices), ["asof", "symbol"])
    legs = bucket_legs(buyable, n_buckets, prices)
    if dividends is None:
        legs = legs.withColumn("income", F.lit(0.0))
    else:
        paid = hold_income(dividends, periods).withColumnRenamed("formed", "asof")
        legs = legs.join(paid, ["asof", "symbol"], "left").withColumn("income", F.coalesce("income", F.lit(0.0)))
    return legs.withColumn("ret", (F.col("p1") + F.col("income")) / F.col("p0") - 1)


def monthly_longshort(
    closes: DataFrame, scores: DataFrame, n_buckets: int = 10, universe: DataFrame | None = None,
    dividends: DataFrame | None = None, days: DataFrame | None = None,
) -> DataFrame:
    """Gross long-short return per month: month, ret_ls.

    ``closes`` is the truncated, vetted panel of the whole study. A symbol whose
    history runs past the panel looks like one that left in the final hold, so
    load a month more than is reported and cut the series.

    A month is missing, not zero, when there are fewer names than buckets or one
    leg lost all its names.
    """
    members = leg_members(closes, scores, n_buckets, universe, dividends, days)
    legs = members.groupBy("asof", "held_to").agg(
        F.avg(F.when(F.col("leg") == "long", F.col("ret"))).alias("_long"),
        F.avg(F.when(F.col("leg") == "short", F.col("ret"))).alias("_short"),
    )
    return legs.filter(finite(F.col("_long")) & finite(F.col("_short"))).select(
        F.trunc("held_to", "MM").alias("month"), (F.col("_long") - F.col("_short")).alias("ret_ls"))

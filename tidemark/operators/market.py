"""Market inputs of the cost model, liquidity ranking and data-quality profile."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.values import as_date, finite, positive

# Fixed values.
TRAILING_ROWS = 20
WARMUP_DAYS = 90
DEFAULT_ADV = 1e6
DEFAULT_SIGMA = 0.02
SIGMA_FLOOR = 0.001


def median_volume(bars: DataFrame) -> DataFrame:
    """Median of the usable volumes of all sources per symbol-day."""
    usable = finite(F.col("volume")) & (F.col("volume") >= 0)
    return bars.filter(usable).groupBy("symbol", "ts").agg(F.median("volume").alias("volume"))


def market_frame(closes: DataFrame, bars: DataFrame, start=None, rows: int = TRAILING_ROWS) -> DataFrame:
    """Closes with trailing dollar volume (``adv``) and return volatility (``sigma``).

    The windows count rows of the symbol's own series. Inputs are narrowed to 90
    days before ``start`` so the windows are warm, then cut to ``start``.
    """
    usable = closes.filter(positive(F.col("close"))).select("symbol", "ts", "close")
    first = None if start is None else as_date(start, "start")
    if first is not None:
        warm = F.lit(first - dt.timedelta(days=WARMUP_DAYS))
        usable, bars = usable.filter(F.col("ts") >= warm), bars.filter(F.col("ts") >= warm)
    by_day = W.partitionBy("symbol").orderBy("ts")
    trailing = by_day.rowsBetween(1 - rows, 0)
    out = (
        usable.join(median_volume(bars), ["symbol", "ts"], "left")
        .withColumn("_dollars", F.col("close") * F.col("volume"))
        .withColumn("_ret", F.try_divide(F.col("close"), F.lag("close").over(by_day)) - 1)
        .select(
            "symbol", "ts", "close",
            # median() is not allowed in a framed window; percentile is.
            F.percentile("_dollars", 0.5).over(trailing).alias("adv"),
            F.stddev_samp("_ret").over(trailing).alias("sigma"),
        )
    )
    return out if first is None else out.filter(F.col("ts") >= F.lit(first))


def cost_inputs(frame: DataFrame) -> DataFrame:
    """Replace missing estimates by defaults and floor an unbelievably calm series."""
    adv = F.when(finite(F.col("adv")) & (F.col("adv") >= 0), F.col("adv")).otherwise(DEFAULT_ADV)
    sigma = F.when(finite(F.col("sigma")), F.greatest("sigma", F.lit(SIGMA_FLOOR))).otherwise(DEFAULT_SIGMA)
    return frame.withColumn("adv", adv).withColumn("sigma", sigma)


def liquidity_ranking(bars: DataFrame, closes: DataFrame, top: int, min_rows: int = 200, min_history: int = 273) -> DataFrame:
    """The ``top`` symbols by median dollar volume that also have enough vetted history.

    The history test follows the cut to ``top``, so a liquid but young symbol
    uses up a place.
    """
    liquid = (
        bars.groupBy("symbol")
        .agg(F.median(F.col("close") * F.col("volume")).alias("dollar_volume"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_rows)
    )
    history = closes.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_closes"))
    return (
        liquid.join(history, "symbol")
        .orderBy(F.col("dollar_volume").desc(), "symbol")
        .limit(top)
        .filter(F.col("n_closes") >= min_history)
    )


def quality_by_year(verdicts: DataFrame) -> DataFrame:
    """Symbol-days, single-source share and quarantine rate per year."""
    n = F.count(F.lit(1))
    return verdicts.groupBy(F.year("ts").alias("year")).agg(
        n.alias("symbol_days"),
        F.count_if(F.col("n_sources") == 1).alias("single_source"),
        F.count_if(F.col("status") == "quarantined").alias("quarantined"),
        F.try_divide(F.count_if(F.col("n_sources") == 1), n).alias("single_source_share"),
        F.try_divide(F.count_if(F.col("status") == "quarantined"), n).alias("quarantine_rate"),
    )


def rows_per_symbol(closes: DataFrame) -> DataFrame:
    """Rows, first and last day per symbol."""
    return closes.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )

"""Dividends on the split-adjusted price basis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.values import among, as_date, symbol_list


def split_adjusted(dividends: DataFrame, splits: DataFrame) -> DataFrame:
    """Divide each rate by the product of the same symbol's later splits.

    A split on the ex-date itself does not count. Both tables hold at most one
    row per (symbol, date); stacked in one window ordered from the newest day
    back, the running product over strictly later days is the factor. No
    dividend meets a split in a join, so nothing is paired.
    """
    day = F.unix_date("ex_date")
    stacked = dividends.select(
        "symbol", "ex_date", "rate", "special", F.lit(None).cast("double").alias("_ratio"), F.lit(True).alias("_dividend")
    ).unionByName(
        splits.select(
            "symbol", "ex_date", F.lit(None).cast("double").alias("rate"), F.lit(None).cast("boolean").alias("special"),
            (F.col("new_rate") / F.col("old_rate")).alias("_ratio"), F.lit(False).alias("_dividend"),
        )
    )
    later = W.partitionBy("symbol").orderBy(-day).rangeBetween(W.unboundedPreceding, -1)
    return (
        stacked.withColumn("_factor", F.product("_ratio").over(later))
        .filter("_dividend")
        .select("symbol", "ex_date", (F.col("rate") / F.coalesce("_factor", F.lit(1.0))).alias("rate"), "special")
    )


def read_dividends(dividends: DataFrame, splits: DataFrame | None, symbols=None, start=None, end=None) -> DataFrame:
    """Dividends of some symbols and ex-dates; adjusted when ``splits`` is given."""
    rows = dividends.filter(among(F.col("symbol"), symbol_list(symbols)))
    if start is not None:
        rows = rows.filter(F.col("ex_date") >= F.lit(as_date(start, "start")))
    if end is not None:
        rows = rows.filter(F.col("ex_date") <= F.lit(as_date(end, "end")))
    if splits is None:
        return rows.select("symbol", "ex_date", "rate", "special")
    return split_adjusted(rows, splits.filter(among(F.col("symbol"), symbol_list(symbols))))

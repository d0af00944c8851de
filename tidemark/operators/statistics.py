"""Statistics of return series and the calibration report."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.values import finite
from tidemark.schemas import require

# Fixed values.
MIN_OVERLAP = 3
RHO_GATE = 0.9


def _usable(x: Column) -> Column:
    return F.when(finite(x), x)


def sharpe(series: DataFrame, returns: str, periods_per_year: int = 12, by: tuple[str, ...] = ()) -> DataFrame:
    """Annualised mean over sample deviation; 0.0 where it is undefined.

    Constancy is tested by min = max: the deviation of equal numbers can come
    out as rounding residue instead of zero.
    """
    if isinstance(periods_per_year, bool) or not isinstance(periods_per_year, int):
        raise TypeError("periods_per_year must be an int")
    if periods_per_year < 1:
        raise ValueError("periods_per_year must be at least 1")
    require(series, returns, *by)
    r = _usable(F.col(returns).cast("double"))
    stats = series.groupBy(*by).agg(
        F.count(r).alias("n"), F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_sd"),
        F.min(r).alias("_lo"), F.max(r).alias("_hi"))
    ratio = F.try_divide("_mean", "_sd") * math.sqrt(periods_per_year)
    defined = (F.col("n") >= 2) & (F.col("_lo") != F.col("_hi")) & finite(ratio)
    return stats.select(*by, "n", F.when(defined, ratio).otherwise(0.0).alias("sharpe"))


def _unique(series: DataFrame, on: str, value: str, name: str) -> DataFrame:
    """One row per key; a repeated key fails the query instead of multiplying rows."""
    require(series, on, value)
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit(f"duplicate {on}: "), F.col(on).cast("string"))).cast("double"))
    return series.groupBy(on).agg(once.otherwise(F.first(F.col(value).cast("double"))).alias(name))


def matched(a: DataFrame, b: DataFrame, on: str = "month", col_a: str = "ret_ls", col_b: str = "ret") -> DataFrame:
    """Inner join of two series on their key, finite pairs only: key, a, b."""
    pairs = _unique(a, on, col_a, "a").join(_unique(b, on, col_b, "b"), on)
    return pairs.filter(finite(F.col("a")) & finite(F.col("b")))


def _correlation(pairs: DataFrame) -> DataFrame:
    raw = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.covar_samp("a", "b").alias("_cov"),
        F.stddev_samp("a").alias("_sa"), F.stddev_samp("b").alias("_sb"),
        (F.min("a") == F.max("a")).alias("_flat_a"), (F.min("b") == F.max("b")).alias("_flat_b"),
        F.avg("a").alias("_mean_a"), F.avg("b").alias("_mean_b"))
    rho = F.try_divide(F.col("_cov"), F.col("_sa") * F.col("_sb"))
    defined = (F.col("n") >= MIN_OVERLAP) & ~F.col("_flat_a") & ~F.col("_flat_b") & finite(rho)
    return raw.withColumn("rho", F.when(defined, rho).otherwise(0.0))


def pearson(a: DataFrame, b: DataFrame, on: str = "month", col_a: str = "ret_ls", col_b: str = "ret") -> DataFrame:
    """One row: rho, n. Rho is 0.0 below three pairs or when a side is constant."""
    return _correlation(matched(a, b, on, col_a, col_b)).select("rho", "n")


def calibration_report(ours: DataFrame, published: DataFrame, anomaly: str) -> DataFrame:
    """One row: anomaly, rho, n_months, mean_ours, mean_ref, pass."""
    if not isinstance(anomaly, str) or not anomaly.strip():
        raise ValueError("anomaly must be a non-empty string")
    return _correlation(matched(ours, published)).select(
        F.lit(anomaly).alias("anomaly"), "rho", F.col("n").alias("n_months"),
        F.coalesce("_mean_a", F.lit(0.0)).alias("mean_ours"), F.coalesce("_mean_b", F.lit(0.0)).alias("mean_ref"),
        (F.col("rho") > RHO_GATE).alias("pass"))


def equity_returns(equity: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Row-to-row returns of equity curves; null on the first row and after zero equity.

    A curve has one row per day, so the window of a curve is bounded by the calendar.
    """
    prior = F.lag("equity").over(W.partitionBy(*by).orderBy("ts"))
    return equity.withColumn("ret_net", F.try_divide("equity", prior) - 1)

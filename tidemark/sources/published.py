"""A published monthly return series from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.functions.values import finite, number
from tidemark.schemas import require

# Fixed value.
PERCENT_MEAN = 0.5


def read_published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The series of a CSV file with a ``date`` column; see :func:`parse_published`."""
    return parse_published(spark.read.option("header", True).csv(path), name)


def parse_published(raw: DataFrame, name: str) -> DataFrame:
    """Text columns ``date`` and ``ret`` (or one called ``name``) to month, ret.

    Dates are ``YYYY-MM`` or ``YYYY-MM-DD``. Months without a number are dropped.
    A mean beyond one half can only be percent, so the series is divided by 100;
    that is decided after the unusable rows are gone. An unreadable date, a
    repeated month or a file without a single number fails the query. One row
    per month: the windows over the series are small by nature.
    """
    if not isinstance(name, str) or not name.strip():
        raise ValueError("name must be a non-empty string")
    require(raw, "date")
    column = "ret" if "ret" in raw.columns else name
    require(raw, column)
    text = F.trim(F.col("date").cast("string"))
    day = F.when(text.rlike(r"^\d{4}-\d{1,2}$"), F.concat(text, F.lit("-01"))).when(
        text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text).try_cast("date")
    month = F.when(day.isNull(), F.raise_error(F.concat(
        F.lit("cannot read date "), F.coalesce(text, F.lit("null")))).cast("date")).otherwise(F.trunc(day, "MM"))
    cells = raw.select(month.alias("month"), number(F.col(column).cast("string")).alias("ret"))
    usable = F.when(finite(F.col("ret")), F.col("ret"))
    monthly = cells.groupBy("month").agg(F.count(usable).alias("_n"), F.max(usable).alias("ret"))
    everything = W.partitionBy()
    total, months = F.sum("_n").over(everything), F.count(F.lit(1)).over(everything)
    checked = monthly.select(
        "month", "_n", "ret", F.avg("ret").over(everything).alias("_mean"),
        F.when((total == 0) & (months > 0), F.raise_error(F.lit(f"column {column} holds no numbers")).cast("double")).alias("_none"))
    repeated = F.raise_error(F.concat(F.lit("more than one row for "), F.col("month").cast("string"))).cast("double")
    scaled = F.when(F.col("_n") > 1, repeated).when(F.abs("_mean") > PERCENT_MEAN, F.col("ret") / 100).otherwise(F.col("ret"))
    return checked.filter((F.col("_n") > 0) | F.col("_none").isNotNull()).select("month", scaled.alias("ret"))

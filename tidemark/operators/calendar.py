"""Trading calendars, rebalance days and holding periods.

A calendar holds one row per trading day, a few thousand rows for decades of
history, and is found by a partially aggregated distinct. The windows without a
partition key in this module run over calendars only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

FREQUENCIES = ("daily", "weekly", "monthly")


def trading_days(rows: DataFrame) -> DataFrame:
    """Distinct ``ts``."""
    return rows.select("ts").distinct()


def numbered_days(days: DataFrame) -> DataFrame:
    """Trading days with their 1-based position and the following day."""
    order = W.orderBy("ts")
    return days.select("ts", F.row_number().over(order).alias("pos"), F.lead("ts").over(order).alias("next_ts"))


def month_ends(days: DataFrame) -> DataFrame:
    """Last trading day of each month; the last one is the last day of the calendar."""
    return days.groupBy(F.trunc("ts", "MM").alias("_m")).agg(F.max("ts").alias("ts")).select("ts")


def holds(days: DataFrame) -> DataFrame:
    """Consecutive month ends as holding periods: formed, held_to."""
    order = W.orderBy("ts")
    return (
        month_ends(days)
        .select(F.col("ts").alias("formed"), F.lead("ts").over(order).alias("held_to"))
        .filter(F.col("held_to").isNotNull())
    )


def rebalance_days(days: DataFrame, frequency: str) -> DataFrame:
    """Decision days and their fill days (the next trading day).

    The first day always decides; the last day never does, because its fill
    would fall outside the calendar.
    """
    if frequency not in FREQUENCIES:
        raise ValueError(f"frequency must be one of {FREQUENCIES}, got {frequency!r}")
    period = {"daily": F.col("ts"), "weekly": F.trunc("ts", "week"), "monthly": F.trunc("ts", "MM")}[frequency]
    following = {"daily": F.col("next_ts"), "weekly": F.trunc("next_ts", "week"),
                 "monthly": F.trunc("next_ts", "MM")}[frequency]
    return (
        numbered_days(days)
        .filter(F.col("next_ts").isNotNull() & ((F.col("pos") == 1) | (period != following)))
        .select("ts", F.col("next_ts").alias("fill_ts"))
    )


def days_of_holds(periods: DataFrame) -> DataFrame:
    """One row per calendar day in ``(formed, held_to]``: day, formed, held_to.

    Holds do not overlap, so this is at most one row per calendar day. It turns
    "which hold does this date fall in" into an equality join.
    """
    each = F.sequence(F.date_add("formed", 1), F.col("held_to"))
    return periods.select(F.explode(each).alias("day"), "formed", "held_to")


def at_dates(rows: DataFrame, points: DataFrame, point: str, first: str, last: str, since=None) -> DataFrame:
    """Rows valid at each date: ``first <= point <= last``.

    A range join written as an equality join on the month plus a residual range
    test. The rows are repeated only for the months they are valid in, which for
    monthly points is also the size of the result.

    ``points`` hold dates and at most a small fixed label beside them. Made
    distinct, they have a few rows per calendar day whatever is passed in, and
    are broadcast: shuffling the rows by month would pile them onto as many
    tasks as there are months.

    ``since``, a date no point lies before, keeps long spans from being repeated
    for months that nobody asks about.
    """
    kinds = [kind for _, kind in points.dtypes]
    if any(kind not in ("date", "string") for kind in kinds) or kinds.count("string") > 1:
        raise ValueError(f"points may hold dates and one label, got {points.dtypes}")
    lower = F.col(first) if since is None else F.greatest(F.col(first), F.lit(since))
    months = F.sequence(F.trunc(lower, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))
    keyed = points.distinct().withColumn("_month", F.trunc(point, "MM"))
    return (
        rows.filter((F.col(first) <= F.col(last)) & (lower <= F.col(last)))
        .withColumn("_month", F.explode(months))
        .join(F.broadcast(keyed), "_month")
        .filter((F.col(point) >= F.col(first)) & (F.col(point) <= F.col(last)))
        .drop("_month")
    )

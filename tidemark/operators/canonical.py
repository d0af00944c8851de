"""Reading the vetted close series: newest verdict, confirmation, level breaks."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.values import among, as_date, positive, symbol_list
from tidemark.sources.tables import newest_wins

# Fixed values.
MIN_SOURCES = 2
MAX_JUMP = 5.0
LOOKBACK_DAYS = 10


def _check(min_sources: int, max_jump: float | None) -> None:
    if isinstance(min_sources, bool) or not isinstance(min_sources, int):
        raise TypeError("min_sources must be an int")
    if min_sources < 1:
        raise ValueError("min_sources must be at least 1")
    if max_jump is not None:
        if isinstance(max_jump, bool) or not isinstance(max_jump, (int, float)):
            raise TypeError("max_jump must be a number or None")
        if not math.isfinite(max_jump) or max_jump <= 1:
            raise ValueError("max_jump must be a finite ratio above 1")


def _is_break(max_jump: float) -> Column:
    by_day = W.partitionBy("symbol").orderBy("ts")
    prev = F.lag("close").over(by_day)
    ratio = F.try_divide(F.col("close"), prev)
    return F.coalesce(
        positive(F.col("close")) & positive(prev) & ((ratio > max_jump) | (ratio < 1.0 / max_jump)),
        F.lit(False),
    )


def mark_breaks(closes: DataFrame, max_jump: float = MAX_JUMP) -> DataFrame:
    """Add ``next_break``: the first level break strictly after each row, else null.

    A break is a close-to-close ratio above ``max_jump`` or below its inverse. A
    reader standing at ``asof`` sees a row when ``ts <= asof`` and no break lies
    in ``(ts, asof]``, so one pass serves every ``asof``.

    Rows are unique per (symbol, ts), so a symbol's window holds at most one row
    per calendar day however large the table is.
    """
    later = W.partitionBy("symbol").orderBy(F.col("ts").desc()).rowsBetween(W.unboundedPreceding, -1)
    return (
        closes.withColumn("_break", _is_break(max_jump))
        .withColumn("next_break", F.min(F.when(F.col("_break"), F.col("ts"))).over(later))
        .drop("_break")
    )


def drop_before_break(closes: DataFrame, max_jump: float = MAX_JUMP) -> DataFrame:
    """Per symbol, the rows from the last level break on (all rows if there is none)."""
    cut = F.max(F.when(F.col("_break"), F.col("ts"))).over(W.partitionBy("symbol"))
    return (
        closes.withColumn("_break", _is_break(max_jump))
        .withColumn("_cut", cut)
        .filter(F.col("_cut").isNull() | (F.col("ts") >= F.col("_cut")))
        .drop("_break", "_cut")
    )


def vetted(
    verdicts: DataFrame,
    symbols=None,
    start=None,
    end=None,
    min_sources: int = MIN_SOURCES,
    newest: str | None = "batch_ts",
) -> DataFrame:
    """Newest verdict per key, then quarantines and unconfirmed closes removed.

    The newest verdict is chosen before the status filter, so a later quarantine
    retracts an earlier close. ``newest`` is None when keys are already unique.
    """
    rows = verdicts.filter(among(F.col("symbol"), symbol_list(symbols)))
    if start is not None:
        rows = rows.filter(F.col("ts") >= F.lit(as_date(start, "start")))
    if end is not None:
        rows = rows.filter(F.col("ts") <= F.lit(as_date(end, "end")))
    if newest is not None:
        rows = newest_wins(rows, ["symbol", "ts"], [newest, "n_sources", "status", "close"])
    return rows.filter((F.col("status") != "quarantined") & (F.col("n_sources") >= min_sources)).select(
        "symbol", "ts", "close", "n_sources", "status"
    )


def read_canonical(
    verdicts: DataFrame,
    symbols=None,
    start=None,
    end=None,
    *,
    min_sources: int = MIN_SOURCES,
    max_jump: float | None = MAX_JUMP,
    newest: str | None = "batch_ts",
) -> DataFrame:
    """The vetted close series over ``[start, end]``.

    A filter on ``ts`` cannot pass a window that partitions by symbol alone, so
    the scan is narrowed here: ten days before ``start`` are enough to form the
    first ratio, and they are cut off again after the break test.
    """
    _check(min_sources, max_jump)
    first = None if start is None else as_date(start, "start")
    margin = None if first is None else first - dt.timedelta(days=LOOKBACK_DAYS)
    rows = vetted(verdicts, symbols, margin, end, min_sources, newest)
    if max_jump is not None:
        rows = drop_before_break(rows, max_jump)
    return rows if first is None else rows.filter(F.col("ts") >= F.lit(first))


def canonical_panel(
    verdicts: DataFrame,
    end=None,
    *,
    min_sources: int = MIN_SOURCES,
    max_jump: float = MAX_JUMP,
    newest: str | None = "batch_ts",
) -> DataFrame:
    """Usable closes with ``next_break``, for signals evaluated at many dates at once."""
    _check(min_sources, max_jump)
    rows = vetted(verdicts, end=end, min_sources=min_sources, newest=newest)
    return mark_breaks(rows, max_jump).filter(positive(F.col("close"))).select("symbol", "ts", "close", "next_break")

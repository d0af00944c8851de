"""The investable universe: alive filers with liquid, vetted prices."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.values import as_date, finite
from tidemark.operators.canonical import read_canonical
from tidemark.operators.facts import ALIVE_DAYS, PERIODIC_FORMS, alive, alive_at

# Fixed values.
MIN_PRICE = 5.0
MIN_ADV = 1_000_000.0
LOOKBACK_DAYS = 63


def check_screen(min_price: float, min_adv: float, lookback_days: int) -> None:
    for label, value in (("min_price", min_price), ("min_adv", min_adv)):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise TypeError(f"{label} must be a number")
        if not math.isfinite(value) or value < 0:
            raise ValueError(f"{label} must be finite and not negative")
    if isinstance(lookback_days, bool) or not isinstance(lookback_days, int):
        raise TypeError("lookback_days must be an int")
    if lookback_days < 1:
        raise ValueError("lookback_days must be at least 1")


def check_tickers(tickers: DataFrame) -> DataFrame:
    """Fail when the ticker map is empty: the universe would look merely empty."""
    if tickers.isEmpty():
        raise FileNotFoundError("the ticker map holds no entries; load it before building a universe")
    return tickers


def _dear(closes: DataFrame, key: list[str], min_price: float) -> DataFrame:
    by_close = closes.filter(finite(F.col("close"))).groupBy(*key).agg(F.median("close").alias("med_close"))
    return by_close.filter(F.col("med_close") > min_price)


def _liquid(dear: DataFrame, bars: DataFrame, key: list[str], min_adv: float) -> DataFrame:
    by_volume = bars.filter(finite(F.col("volume"))).groupBy(*key).agg(F.median("volume").alias("med_vol"))
    # No usable volume means no turnover to screen on: the inner join fails the name.
    return dear.join(by_volume, key).filter(F.col("med_close") * F.col("med_vol") > min_adv)


def liquid(
    verdicts: DataFrame, bars: DataFrame, asof, min_price: float = MIN_PRICE, min_adv: float = MIN_ADV,
    lookback_days: int = LOOKBACK_DAYS, **canonical,
) -> DataFrame:
    """Symbols whose median close and turnover over the window are above both bounds."""
    check_screen(min_price, min_adv, lookback_days)
    end = as_date(asof, "asof")
    start = end - dt.timedelta(days=lookback_days)
    closes = read_canonical(verdicts, start=start, end=end, **canonical)
    dear = _dear(closes, ["symbol"], min_price)
    # Volumes are looked at for the names that passed on price alone.
    window = bars.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(end))).join(dear.select("symbol"), "symbol", "left_semi")
    return _liquid(dear, window, ["symbol"], min_adv)


def build(
    verdicts: DataFrame, bars: DataFrame, filings: DataFrame, tickers: DataFrame, asof,
    min_price: float = MIN_PRICE, min_adv: float = MIN_ADV, lookback_days: int = LOOKBACK_DAYS,
    forms=PERIODIC_FORMS, alive_days: int = ALIVE_DAYS, **canonical,
) -> DataFrame:
    """The universe on one date: symbol, cik."""
    names = liquid(verdicts, bars, asof, min_price, min_adv, lookback_days, **canonical)
    return (
        names.join(tickers, "symbol")
        .join(alive(filings, asof, forms, alive_days), "cik", "left_semi")
        .select("symbol", "cik")
    )


def _by_block(rows: DataFrame, value: str, span: int, *more: str) -> DataFrame:
    """(symbol, block, rows): the usable rows of every stretch of ``span`` days and the stretch before it.

    A window of ``span`` days that ends in a block lies in these rows, so each row is
    in two groups however many windows it is in, and a group is bounded by the calendar.
    """
    block = F.floor(F.unix_date("ts") / span)
    return (
        rows.filter(finite(F.col(value)))
        .select("symbol", F.explode(F.array(block, block + 1)).alias("block"), F.struct("ts", value, *more).alias("r"))
        .groupBy("symbol", "block").agg(F.collect_list("r").alias("rows"))
    )


def _with_median(groups: DataFrame, value: str, lookback_days: int, name: str, broken: bool = False) -> DataFrame:
    """``groups`` (asof, rows, ...) with the exact median of the rows in the window that ends at ``asof``; groups
    without a row in it are left out."""
    low = F.date_sub("asof", lookback_days)

    def seen(r):
        inside = (r["ts"] >= low) & (r["ts"] <= F.col("asof"))
        return inside & (r["next_break"].isNull() | (F.col("asof") < r["next_break"])) if broken else inside

    ordered = groups.withColumn("_v", F.sort_array(F.transform(F.filter("rows", seen), lambda r: r[value]))).drop("rows")
    n = F.size("_v")
    middle = F.get("_v", F.floor((n - 1) / 2).cast("int")) * 0.5 + F.get("_v", F.floor(n / 2).cast("int")) * 0.5
    return ordered.filter(n > 0).withColumn(name, middle).drop("_v")


def liquid_at(
    panel: DataFrame, bars: DataFrame, asofs: DataFrame, min_price: float = MIN_PRICE, min_adv: float = MIN_ADV,
    lookback_days: int = LOOKBACK_DAYS,
) -> DataFrame:
    """:func:`liquid` for many dates; ``panel`` carries ``next_break``.

    A close counts for the dates from its own day until the window has passed it
    or a level break hides it. Rows travel by symbol and stretch of time, twice
    each, and the windows of all dates are cut out of the stretches where they lie:
    what is shuffled depends neither on the number of dates nor on the window.
    """
    check_screen(min_price, min_adv, lookback_days)
    span = lookback_days + 1
    # Made distinct, the dates are a row per calendar day at most, and are broadcast.
    dates = asofs.select("asof").distinct().withColumn("block", F.floor(F.unix_date("asof") / span))
    closes = _by_block(panel, "close", span, "next_break").join(F.broadcast(dates), "block")
    dear = _with_median(closes, "close", lookback_days, "med_close", broken=True).filter(F.col("med_close") > min_price)
    # Volumes are looked at for what passed on price alone. No usable volume means no turnover to screen on.
    traded = dear.join(_by_block(bars, "volume", span), ["symbol", "block"])
    return _with_median(traded, "volume", lookback_days, "med_vol").filter(
        F.col("med_close") * F.col("med_vol") > min_adv).select("asof", "symbol", "med_close", "med_vol")


def build_at(
    panel: DataFrame, bars: DataFrame, filings: DataFrame, tickers: DataFrame, asofs: DataFrame,
    min_price: float = MIN_PRICE, min_adv: float = MIN_ADV, lookback_days: int = LOOKBACK_DAYS,
    forms=PERIODIC_FORMS, alive_days: int = ALIVE_DAYS,
) -> DataFrame:
    """The universe on many dates: asof, symbol, cik."""
    return (
        liquid_at(panel, bars, asofs, min_price, min_adv, lookback_days)
        .join(tickers, "symbol")
        .join(alive_at(filings, asofs, forms, alive_days), ["asof", "cik"], "left_semi")
        .select("asof", "symbol", "cik")
    )

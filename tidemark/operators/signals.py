"""Cross-sectional signals, evaluated for all formation dates in one plan.

Every signal takes a DataFrame ``asofs`` with one row per formation date and
returns asof, symbol, score. Nothing dated after a formation date can change its
scores. ``last``, and ``first`` if given, bound the formation dates; they keep facts
from being carried over months in which there are none.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.values import as_date, finite
from tidemark.operators.calendar import at_dates
from tidemark.operators.facts import PERIODIC_FORMS, QUARTER_DAYS, facts_at
from tidemark.sources.tables import newest_wins

# Fixed values.
MOMENTUM_LOOKBACK = 252
MOMENTUM_SKIP = 21
SHARE_TAGS = ("CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding")
ISSUANCE_DAYS = 365
MAX_FACT_AGE = 400
BALANCE_TAGS = {
    "ca": "AssetsCurrent",
    "cash": "CashAndCashEquivalentsAtCarryingValue",
    "cl": "LiabilitiesCurrent",
    "ta": "Assets",
}
ANNUAL_FORM = "10-K"
YEAR_GAP_DAYS = (330, 400)
EARNINGS_TAG = "NetIncomeLoss"
SEASONAL_LAG = 4
HISTORY = 8
MIN_HISTORY = 4
DRIFT_DAYS = 60


def asof_frame(spark, dates: Iterable) -> DataFrame:
    """Formation dates given on the driver as an ``asofs`` DataFrame."""
    return spark.createDataFrame([(as_date(d, "asof"),) for d in dates], "asof date")


def finalise(scored: DataFrame) -> DataFrame:
    """The signal contract: asof, symbol, score with usable scores only."""
    return scored.select("asof", F.col("symbol").cast("string"), F.col("score").cast("double")).filter(
        finite(F.col("score"))
    )


def per_date(signal: Callable[[object], DataFrame], dates: Iterable) -> DataFrame:
    """Union of a caller's own ``signal(date) -> symbol, score`` over some dates."""
    frames = [
        signal(d).select(F.lit(as_date(d)).alias("asof"), F.col("symbol"), F.col("score")) for d in dates
    ]
    if not frames:
        raise ValueError("no dates given")
    return finalise(reduce(DataFrame.unionByName, frames))


def momentum(
    panel: DataFrame, asofs: DataFrame, lookback: int = MOMENTUM_LOOKBACK, skip: int = MOMENTUM_SKIP, last=None
) -> DataFrame:
    """Return from the ``lookback``-th to the ``skip``-th most recent trading day.

    ``panel`` holds closes with ``next_break``. The trading days of a formation date
    are the days on which some row is visible then: a day all of whose rows lie
    before a level break no longer counts once the break is known. Both prices have
    to exist and be visible at the formation date. Days and the two wanted ones per
    formation date are calendar-sized; the panel is scanned once for the days and
    once for the prices, already reduced to the wanted days.
    """
    end = F.current_date() if last is None else F.lit(as_date(last, "last"))
    days = panel.groupBy("ts").agg(
        F.max("next_break").alias("_gone"), F.max(F.col("next_break").isNull()).alias("_stays"))
    # A day is out of reach once ``lookback`` days that stay visible have followed it.
    order = W.orderBy("ts")
    days = days.withColumn("_n", F.sum(F.col("_stays").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    beyond = days.filter("_stays").select((F.col("_n") - lookback).alias("_n"), F.date_sub("ts", 1).alias("_beyond"))
    spans = days.join(F.broadcast(beyond), "_n", "left").select("ts", F.least(
        F.greatest(end, F.col("ts")), F.when(~F.col("_stays"), F.date_sub("_gone", 1)), F.col("_beyond")).alias("_until"))
    recent = at_dates(spans, asofs.select("asof"), "asof", "ts", "_until").withColumn(
        "_back", F.row_number().over(W.partitionBy("asof").orderBy(F.col("ts").desc())))
    marked = recent.filter(F.col("_back").isin(lookback, skip)).withColumn(
        "_ends", F.array_compact(F.array(F.when(F.col("_back") == lookback, "far"), F.when(F.col("_back") == skip, "near"))))
    grid = marked.select("asof", "ts", F.explode("_ends").alias("end"))
    prices = panel.join(F.broadcast(grid), "ts").filter(
        F.col("next_break").isNull() | (F.col("next_break") > F.col("asof"))
    )
    ends = prices.groupBy("asof", "symbol").agg(
        F.max(F.when(F.col("end") == "near", F.col("close"))).alias("near"),
        F.max(F.when(F.col("end") == "far", F.col("close"))).alias("far"),
    )
    return finalise(ends.withColumn("score", F.try_divide("near", "far") - 1))


def issuance(
    facts: DataFrame, tickers: DataFrame, asofs: DataFrame, last, tags: Sequence[str] = SHARE_TAGS,
    lookback_days: int = ISSUANCE_DAYS, max_age: int = MAX_FACT_AGE, first=None,
) -> DataFrame:
    """Minus the log growth of the share count over a year.

    Both counts come from the same tag; a filer uses the first tag of ``tags``
    that has usable counts at both ends.
    """
    ends = F.explode(F.array(
        F.struct(F.lit("now").alias("end"), F.col("asof").alias("point")),
        F.struct(F.lit("then").alias("end"), F.date_sub("asof", lookback_days).alias("point")),
    ))
    points = asofs.select("asof", ends.alias("p")).select("asof", F.col("p.end").alias("at"), "p.point")
    since = None if first is None else as_date(first, "first") - dt.timedelta(days=lookback_days)
    counts = facts_at(facts, tags, points, "point", last, max_age, since).filter(
        finite(F.col("val")) & (F.col("val") > 0)
    )
    pairs = (
        counts.groupBy("asof", "cik", "tag")
        .agg(F.max(F.when(F.col("at") == "now", F.col("val"))).alias("now"),
             F.max(F.when(F.col("at") == "then", F.col("val"))).alias("then"))
        .filter(F.col("now").isNotNull() & F.col("then").isNotNull())
        .withColumn("_prefer", -F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag")))
    )
    chosen = newest_wins(pairs, ["asof", "cik"], ["_prefer"])
    return finalise(chosen.withColumn("score", -F.ln(F.try_divide("now", "then"))).join(tickers, "cik"))


def accruals(
    facts: DataFrame, tickers: DataFrame, asofs: DataFrame, last, tags: dict[str, str] = BALANCE_TAGS,
    form: str = ANNUAL_FORM, year_gap: tuple[int, int] = YEAR_GAP_DAYS, first=None,
) -> DataFrame:
    """Minus the change in non-cash working capital over average total assets.

    A balance sheet is the four lines of one period end as known after each
    filing day; restatements replace single lines. Only the two latest complete
    period ends matter at a date, so each one is carried forward no further than
    the day two later ones are complete. The dates it is repeated for are then a
    few years at most, whatever the length of the study.
    """
    lines = facts.filter(
        F.col("tag").isin(*tags.values()) & (F.col("form") == form) & finite(F.col("val"))
        & (F.col("filed") <= F.lit(as_date(last, "last"))))
    daily = newest_wins(lines, ["cik", "end", "tag", "filed"], ["accn", "taxonomy", "unit", "seq"])
    wide = daily.groupBy("cik", "end", "filed").agg(
        *[F.max(F.when(F.col("tag") == tag, F.col("val"))).alias(name) for name, tag in tags.items()]
    )
    by_filed = W.partitionBy("cik", "end").orderBy("filed")
    known = by_filed.rowsBetween(W.unboundedPreceding, 0)
    sheets = wide.select("cik", "end", "filed", *[F.last(n, ignorenulls=True).over(known).alias(n) for n in tags])
    sheets = sheets.na.drop(subset=list(tags)).withColumn("_next", F.lead("filed").over(by_filed))

    by_end = W.partitionBy("cik").orderBy("end")
    complete = sheets.groupBy("cik", "end").agg(F.min("filed").alias("_complete"))
    second = F.lead("_complete", 2).over(by_end)
    # A sheet with fewer than two successors never expires.
    expiry = complete.select("cik", "end", F.when(
        second.isNotNull(), F.greatest(F.lead("_complete", 1).over(by_end), second)).alias("_expiry"))
    spans = sheets.join(expiry, ["cik", "end"]).withColumn(
        "_until", F.least(F.date_sub("_next", 1), F.date_sub("_expiry", 1), F.lit(as_date(last, "last"))))

    since = None if first is None else as_date(first, "first")
    seen = at_dates(spans, asofs.select("asof"), "asof", "filed", "_until", since)
    newest = W.partitionBy("asof", "cik").orderBy(F.col("end").desc())
    prior = F.lead(F.struct("end", *tags)).over(newest)
    pairs = (
        seen.select("asof", "cik", "end", *tags, prior.alias("p"), F.row_number().over(newest).alias("_rank"))
        .filter((F.col("_rank") == 1) & F.datediff("end", "p.end").between(*year_gap))
    )
    change = {n: F.col(n) - F.col(f"p.{n}") for n in tags}
    base = (F.col("ta") + F.col("p.ta")) / 2
    scored = pairs.filter(finite(base) & (base > 0)).withColumn(
        "score", -F.try_divide(change["ca"] - change["cash"] - change["cl"], base))
    return finalise(scored.join(tickers, "cik"))


def earnings_surprise(
    facts: DataFrame, tickers: DataFrame, asofs: DataFrame, last, window_days: int = DRIFT_DAYS,
    tag: str = EARNINGS_TAG, forms: Sequence[str] = PERIODIC_FORMS,
    year_gap: tuple[int, int] = YEAR_GAP_DAYS, first=None,
) -> DataFrame:
    """Newest seasonal difference over the spread of the up to eight before it.

    A date is only evaluated for filers with a filing inside the drift window,
    which any scored filer needs. All steps group by filer and something else, so over
    facts that are stored by filer (``jobs.publish_facts``) none of them moves a fact. A regular filer (no quarter missing, filed in
    order) has a difference for every quarter from the fifth on, so its score
    rests on the newest thirteen quarters; each is carried forward until thirteen
    later ones are known, and the repetition does not grow with the length of
    the history. Other filers keep their whole history, since a gap can push the
    differences any distance back.
    """
    if isinstance(window_days, bool) or not isinstance(window_days, int) or window_days < 1:
        raise ValueError("window_days must be a positive int")
    quarters = facts.filter(
        (F.col("tag") == tag) & F.col("form").isin(*forms) & finite(F.col("val"))
        & F.datediff("end", "start").between(*QUARTER_DAYS) & (F.col("filed") <= F.lit(as_date(last, "last")))
    )
    daily = newest_wins(quarters, ["cik", "end", "filed"], ["accn", "taxonomy", "unit", "seq"])
    # A row a quarter with all its versions, so that what concerns quarters needs no join with what concerns versions.
    by_quarter = daily.groupBy("cik", "end").agg(
        F.array_sort(F.collect_list(F.struct("filed", "val"))).alias("_versions"), F.min("filed").alias("_known"))
    by_end = W.partitionBy("cik").orderBy("end")
    gap = F.datediff("end", F.lag("end", SEASONAL_LAG).over(by_end))
    odd = (gap.isNotNull() & ~gap.between(*year_gap)) | (F.col("_known") < F.lag("_known").over(by_end))
    needed = SEASONAL_LAG + HISTORY + 1
    marked = by_quarter.select("cik", "end", "_versions", F.coalesce(odd, F.lit(False)).alias("_odd"),
                               F.lead("_known", needed).over(by_end).alias("_later"))
    expiring = marked.select(
        "cik", "end", "_versions", F.when(~F.max("_odd").over(W.partitionBy("cik")), F.col("_later")).alias("_expiry"))
    each = expiring.select("cik", "end", "_versions", "_expiry", F.posexplode("_versions").alias("_i", "_v"))
    spans = each.select(
        "cik", "end", "_v.val", "_v.filed",
        F.least(F.date_sub(F.get("_versions", F.col("_i") + 1)["filed"], 1), F.date_sub("_expiry", 1),
                F.lit(as_date(last, "last"))).alias("_until"))

    dates, since = asofs.select("asof"), None if first is None else as_date(first, "first")
    visible = at_dates(spans, dates, "asof", "filed", "_until", since)
    newest = F.max("filed").over(W.partitionBy("asof", "cik"))
    history = visible.withColumn("_newest", newest).filter(F.col("_newest") >= F.date_sub("asof", window_days)).drop("_newest")
    scored = (
        _surprises(history, year_gap)
        .filter((F.col("_n") >= MIN_HISTORY) & (F.col("filed") >= F.date_sub("asof", window_days))
                & finite(F.col("scale")) & (F.col("scale") > 0))
        .withColumn("score", F.try_divide("diff", "scale"))
    )
    return finalise(scored.join(tickers, "cik"))


def _surprises(history: DataFrame, year_gap: tuple[int, int]) -> DataFrame:
    """The newest seasonal difference per (asof, cik) with the scale and number of those before it.

    Null differences leave before the second window, so its eight rows are the
    eight previous usable differences. A group has one row per quarter end.
    """
    by_end = W.partitionBy("asof", "cik").orderBy("end")
    gap = F.datediff("end", F.lag("end", SEASONAL_LAG).over(by_end))
    diff = F.when(gap.between(*year_gap), F.col("val") - F.lag("val", SEASONAL_LAG).over(by_end))
    before = by_end.rowsBetween(-HISTORY, -1)
    return (
        history.withColumn("diff", diff)
        .filter(F.col("diff").isNotNull())
        .select("asof", "cik", "filed", "diff", F.stddev_samp("diff").over(before).alias("scale"),
                F.count("diff").over(before).alias("_n"), F.lead("end").over(by_end).alias("_later"))
        .filter(F.col("_later").isNull()).drop("_later")
    )

"""Point-in-time fundamentals: what a reader of the filings knew on a date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.values import as_date
from tidemark.operators.calendar import at_dates
from tidemark.sources.tables import newest_wins

# Fixed values.
PERIODIC_FORMS = ("10-K", "10-Q")
ALIVE_DAYS = 456
QUARTER_DAYS = (80, 100)
ANNUAL_DAYS = (340, 400)

#: Which fact is the current one, most significant column first.
RECENCY = ("end", "filed", "accn", "taxonomy", "unit", "seq")


def latest_facts(facts: DataFrame, tag: str, asof) -> DataFrame:
    """Per filer the latest fact of a tag that was public on ``asof`` (inclusive)."""
    cutoff = F.lit(as_date(asof, "asof"))
    known = facts.filter((F.col("tag") == tag) & (F.col("filed") <= cutoff))
    return newest_wins(known, ["cik"], RECENCY)


def fact_versions(facts: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Successive answers to "latest fact of this tag" per filer.

    Columns: cik, tag, end, val, filed, valid_to; a version answers for dates in
    ``[filed, valid_to]`` and ``valid_to`` is null for the current one.

    Only the best fact filed on a day can ever be the answer, so facts are first
    reduced to one per (cik, tag, filed); a window then holds at most one row per
    filing day. A version starts where the running maximum changes.
    """
    wanted = facts.filter(F.col("tag").isin(*tags))
    daily = newest_wins(wanted, ["cik", "tag", "filed"], [c for c in RECENCY if c != "filed"])
    by_filed = W.partitionBy("cik", "tag").orderBy("filed")
    fact = F.struct(*RECENCY, "val")
    running = F.max(fact).over(by_filed.rowsBetween(W.unboundedPreceding, 0))
    return (
        daily.select("cik", "tag", F.col("filed").alias("_day"), running.alias("_best"))
        # A day on which an older period was filed changes nothing.
        .filter(F.col("_best.filed") == F.col("_day"))
        .withColumn("_next", F.lead("_day").over(W.partitionBy("cik", "tag").orderBy("_day")))
        .select("cik", "tag", "_best.end", "_best.val", F.col("_day").alias("filed"),
                F.date_sub("_next", 1).alias("valid_to"))
    )


def facts_at(
    facts: DataFrame, tags: Sequence[str], points: DataFrame, point: str, last, max_age: int | None = None, since=None
) -> DataFrame:
    """:func:`latest_facts` for many dates at once.

    ``last`` is the final date of the study and closes the open versions;
    ``since``, if given, is its first date.
    ``max_age`` drops an answer filed more than that many days before the date.
    """
    final = F.lit(as_date(last, "last"))
    versions = fact_versions(facts.filter(F.col("filed") <= final), tags)
    until = F.coalesce("valid_to", final)
    if max_age is not None:
        until = F.least(until, F.date_add("filed", max_age))
    return at_dates(versions.withColumn("_until", until), points, point, "filed", "_until", since).drop("_until", "valid_to")


def restated(facts: DataFrame, key: Sequence[str] = ("cik", "tag", "end")) -> DataFrame:
    """The last restatement per period: greatest (filed, accn), then document order."""
    return newest_wins(facts, list(key), ["filed", "accn", "taxonomy", "tag", "unit", "seq", "val"])


def alive(filings: DataFrame, asof, forms: Sequence[str] = PERIODIC_FORMS, days: int = ALIVE_DAYS) -> DataFrame:
    """Filers with a periodic report filed in ``[asof - days, asof]``."""
    end = as_date(asof, "asof")
    start = end - dt.timedelta(days=days)
    return filings.filter(
        F.col("form").isin(*forms) & (F.col("filed") <= F.lit(end)) & (F.col("filed") >= F.lit(start))
    ).select("cik").distinct()


def alive_at(filings: DataFrame, asofs: DataFrame, forms: Sequence[str] = PERIODIC_FORMS, days: int = ALIVE_DAYS) -> DataFrame:
    """:func:`alive` for many dates: asof, cik.

    Each filing keeps its filer alive until the next one or the window runs out.
    Those spans do not overlap, so each (asof, cik) comes out once.
    """
    filed = filings.filter(F.col("form").isin(*forms)).select("cik", "filed").distinct()
    following = F.lead("filed").over(W.partitionBy("cik").orderBy("filed"))
    spans = filed.withColumn("_until", F.least(F.date_sub(following, 1), F.date_add("filed", days)))
    return at_dates(spans, asofs.select("asof"), "asof", "filed", "_until").select("asof", "cik")


def form_matched_durations(facts: DataFrame) -> DataFrame:
    """Duration rows as long as their form reports: a year for 10-K, else a quarter."""
    days = F.datediff("end", "start")
    fits = F.when(F.col("form") == "10-K", days.between(*ANNUAL_DAYS)).otherwise(days.between(*QUARTER_DAYS))
    return facts.filter(F.col("start").isNotNull() & fits)


def read_facts(facts: DataFrame, tags=None) -> DataFrame:
    """Facts of some tags; None means all, an empty collection none."""
    return facts if tags is None else facts.filter(F.col("tag").isin(*tags) if tags else F.lit(False))


def read_filings(filings: DataFrame, forms=None, filed_from=None, filed_to=None) -> DataFrame:
    """Filings of some forms and filing dates, both ends inclusive."""
    rows = filings
    if forms is not None:
        rows = rows.filter(F.col("form").isin(*forms) if forms else F.lit(False))
    if filed_from is not None:
        rows = rows.filter(F.col("filed") >= F.lit(as_date(filed_from, "filed_from")))
    if filed_to is not None:
        rows = rows.filter(F.col("filed") <= F.lit(as_date(filed_to, "filed_to")))
    return rows

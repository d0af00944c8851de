"""Voting on a close when several vendors report the same symbol and day."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.values import finite

# Fixed values.
TOLERANCE = 0.001
SCALE_FLOOR = 1e-9
STATUSES = ("ok", "majority", "quarantined")


def check_tolerance(tol: float) -> float:
    if isinstance(tol, bool) or not isinstance(tol, (int, float)):
        raise TypeError("tol must be a number")
    if not (math.isfinite(tol) and 0 <= tol < 1):
        raise ValueError("tol must be a fraction in [0, 1)")
    return float(tol)


def _scale(a: Column, b: Column) -> Column:
    return F.greatest(F.abs(a), F.abs(b), F.lit(SCALE_FLOOR))


def ballots(bars: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """Every symbol-day with its ballot and verdict.

    ``bars`` holds one row per (symbol, ts, source). The closes of a symbol-day
    become one array sorted by (close, source); its length is the number of
    vendors, which is the number of ``source`` folders of the bar table and does
    not grow with the data. All later steps work inside the row, so the whole
    vote is one aggregation: no self-join, no second pass over the bars.

    In sorted order a set of closes agrees mutually exactly when its two ends
    do. Each close therefore opens one candidate, the run of closes from it up
    to the furthest one it agrees with, and the winner is the longest run; equal
    lengths go to the tightest run and then to the alphabetically first list of
    sources. A unanimous ballot is the run that spans the array.

    Columns: symbol, ts, ballot, winners, n_sources, status, close. ``winners``
    is null for a quarantined day.
    """
    tol = check_tolerance(tol)
    entry = F.when(finite(F.col("close")), F.struct(F.col("close").alias("close"), F.col("source").alias("source")))
    grouped = bars.groupBy("symbol", "ts").agg(F.sort_array(F.collect_list(entry)).alias("ballot"))

    def run_from(low: Column) -> Column:
        members = F.filter(
            "ballot",
            lambda b: (b["close"] >= low["close"])
            & (b["close"] - low["close"] <= tol * _scale(b["close"], low["close"])),
        )
        top = F.element_at(members, -1)["close"]
        return F.struct(
            (-F.size(members)).alias("rank"),
            ((top - low["close"]) / _scale(top, low["close"])).alias("spread"),
            F.array_sort(F.transform(members, lambda m: m["source"])).alias("sources"),
            members.alias("members"),
        )

    n = F.size("ballot")
    low, high = F.get("ballot", F.lit(0))["close"], F.try_element_at("ballot", F.lit(-1))["close"]
    unanimous = F.coalesce(high - low <= tol * _scale(low, high), F.lit(False))
    best = F.when(~unanimous, F.array_min(F.transform("ballot", run_from)))
    winners = F.when(F.col("_all"), F.col("ballot")).when(-2 * F.col("_best.rank") > n, F.col("_best.members"))
    # Upper middle: always a price that some vendor printed.
    middle = F.get("winners", F.floor(F.size("winners") / 2).cast("int"))["close"]
    return (
        grouped.withColumn("_all", unanimous)
        .withColumn("_best", best)
        .withColumn("winners", winners)
        .select(
            "symbol", "ts", "ballot", "winners",
            n.cast("bigint").alias("n_sources"),
            F.when(F.col("_all"), "ok").when(F.col("winners").isNotNull(), "majority")
            .otherwise("quarantined").alias("status"),
            middle.alias("close"),
        )
    )


def verdicts(voted: DataFrame) -> DataFrame:
    """The canonical rows of :func:`ballots`, quarantined days included."""
    return voted.select("symbol", "ts", "close", "n_sources", "status")


def dissent_events(voted: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """One row per day that was not unanimous, for the event log.

    ``closes`` maps source to close; ``agreeing`` and ``dissenting`` are sorted
    source lists (``agreeing`` is null when nobody won).
    """
    names = F.transform("ballot", lambda b: b["source"])
    agreeing = F.array_sort(F.transform("winners", lambda b: b["source"]))
    return voted.filter(F.col("status") != "ok").select(
        F.concat(F.lit("reconcile."), F.when(F.col("status") == "majority", "majority").otherwise("quarantine")).alias("kind"),
        "symbol", "ts",
        F.map_from_entries(F.transform("ballot", lambda b: F.struct(b["source"], b["close"]))).alias("closes"),
        F.lit(check_tolerance(tol)).alias("tol"),
        "n_sources",
        agreeing.alias("agreeing"),
        F.when(F.col("winners").isNotNull(), F.array_sort(F.array_except(names, agreeing))).alias("dissenting"),
        "close",
    )


def verdict_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Counts per status, zero-filled, in total or per column of ``by``, with the quarantine rate."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    out = rows.groupBy(*by).agg(*counts, F.count(F.lit(1)).alias("_n"))
    rate = F.coalesce(F.try_divide(F.col("quarantined"), F.col("_n")), F.lit(0.0))
    return out.select(*by, *STATUSES, rate.alias("quarantine_rate"))

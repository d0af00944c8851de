"""Re-voting the symbol-days touched by newly landed bars."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import vote
from tidemark.plans.jobs import Warehouse, log_dissent, write_verdicts
from tidemark.schemas import STORED_BARS
from tidemark.session import store
from tidemark.sources.bars import month_of, read_bars


def touched_bars(spark: SparkSession, house: Warehouse, touched: DataFrame) -> DataFrame:
    """All stored bars of the (symbol, ts) pairs in ``touched``; only folders of their months are read.

    One late bar of long ago costs its month, and not the years since. The months are
    a few values a year at most; within them the span of days lets the scan skip row groups.
    """
    months = [r[0] for r in touched.select(month_of("ts")).distinct().collect()]
    if not months:
        return read_bars(spark, house.path("bars")).limit(0)
    span = touched.agg(F.min("ts"), F.max("ts")).first()
    rows = read_bars(spark, house.path("bars"), months, start=span[0], end=span[1])
    return rows.join(touched, ["symbol", "ts"], "left_semi")


def revote_new_bars(spark: SparkSession, house: Warehouse, checkpoint: str, tol: float = vote.TOLERANCE) -> None:
    """Process every bar file landed since the last call, then stop.

    Each micro-batch votes again on the (symbol, ts) pairs it touched, over all
    stored bars of those pairs, and stores a batch of verdicts; the newest
    verdict wins on read. The batch name is made of the checkpoint and the
    micro-batch number, so one that is run again after a failure replaces itself.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def revote(new: DataFrame, number: int) -> None:
        # Stored, as the months and the vote both need the keys.
        touched = store(new.filter(F.col("resolution") == "1d").select("symbol", "ts").distinct(), "touched")
        if touched.isEmpty():
            return
        voted = vote.ballots(touched_bars(new.sparkSession, house, touched), tol)
        batch = f"stream-{stream}-{number:09d}"
        log_dissent(write_verdicts(voted, house, batch), house, batch, tol)

    query = (
        spark.readStream.schema(STORED_BARS).parquet(house.path("bars"))
        .writeStream.foreachBatch(revote)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

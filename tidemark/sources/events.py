"""The append-only event log: strict JSON payloads, deduplicated reads, compaction."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidemark.functions.values import as_date
from tidemark.schemas import EVENTS
from tidemark.sources.tables import append, read

_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
_STORED = T.StructType(EVENTS.fields + [T.StructField("day", T.StringType())])

#: Aimed-at size of a compacted file.
FILE_BYTES = 128 * 1024 * 1024


def _numbers(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]


def as_events(rows: DataFrame, kind: str | None = None, event_id: Column | None = None) -> DataFrame:
    """One event per row; the columns become the payload.

    ``kind`` names the event, or a column of that name does. A NaN or an infinity
    has no JSON form and fails the job, also inside a map of numbers. A writer
    that may be run again gives an ``event_id`` of its own, so that a repeated
    append is dropped by the reader.
    """
    if kind is not None and not kind.strip():
        raise ValueError("kind must be a non-empty string")
    if kind is None and "kind" not in rows.columns:
        raise ValueError("give a kind or a kind column")
    columns = [c for c in rows.columns if kind is not None or c != "kind"]
    bad = F.lit(False)
    limit = F.lit(math.inf)
    for name in _numbers(rows, columns):
        bad = bad | (F.col(name).isNotNull() & ~(F.abs(name) < limit))
    for name in columns:
        dtype = rows.schema[name].dataType
        if isinstance(dtype, T.MapType) and isinstance(dtype.valueType, T.DoubleType):
            bad = bad | F.exists(F.map_values(name), lambda v: v.isNotNull() & ~(F.abs(v) < limit))
    payload = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    strict = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a payload may not hold NaN or infinity")).cast("string")).otherwise(payload)
    now = dt.datetime.now(dt.timezone.utc)
    return rows.select(
        (F.regexp_replace(F.uuid(), "-", "") if event_id is None else event_id).alias("event_id"),
        F.date_format(F.lit(now).cast("timestamp"), _TS).alias("ts"),
        (F.lit(kind) if kind is not None else F.col("kind")).alias("kind"), strict.alias("payload"))


def log_events(events: DataFrame, path: str) -> None:
    """Append a batch under ``day=`` folders."""
    append(events.withColumn("day", F.substring("ts", 1, 10)), path, ["day"])


def distinct_events(events: DataFrame, kind: str | None = None) -> DataFrame:
    """Each event once. Copies of an id are identical, so any of them will do."""
    once = events.dropDuplicates(["event_id"])
    return once if kind is None else once.filter(F.col("kind") == kind)


def read_events(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The log, oldest first."""
    stored = read(spark, path, _STORED)
    return distinct_events(stored.select(*EVENTS.fieldNames()), kind).orderBy("ts", "event_id")


def mergeable(spark: SparkSession, path: str, before=None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Finished days with more files than their size calls for: day, files, parts.

    ``before`` defaults to today (UTC), the only day a writer appends to.
    """
    cutoff = dt.datetime.now(dt.timezone.utc).date() if before is None else as_date(before, "before")
    files = (
        read(spark, path, _STORED).filter(F.col("day") < cutoff.isoformat())
        .groupBy("day", F.col("_metadata.file_path").alias("_file"))
        .agg(F.max("_metadata.file_size").alias("_bytes"))
    )
    return (
        files.groupBy("day")
        .agg(F.count(F.lit(1)).alias("files"), F.ceil(F.sum("_bytes") / file_bytes).alias("parts"))
        .filter(F.col("files") > F.col("parts"))
    )


def compact(spark: SparkSession, path: str, work: str, before=None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Rewrite each mergeable day in as few files as its size allows, each event once.

    The merged days are written to ``work`` and only then replace their
    partitions, since a job cannot overwrite what it is reading. ``work`` is a
    folder the whole cluster sees; the caller drops it. An interruption leaves
    copies at worst, and reads drop those. A day that was compacted has nothing
    left to merge, so a second run does nothing. Returns day, files_removed,
    events.

    A day with most of the events is cut into ``parts`` by a hash of the event
    id, so no task has to write a whole day.
    """
    mergeable(spark, path, before, file_bytes).write.mode("overwrite").parquet(f"{work}/plan")
    plan = spark.read.parquet(f"{work}/plan")
    part = F.pmod(F.xxhash64("event_id"), F.col("parts"))
    merged = (
        # One row per day of the log: bounded by the calendar.
        spark.read.schema(_STORED).parquet(path).join(F.broadcast(plan.select("day", "parts")), "day")
        .dropDuplicates(["event_id"]).repartition("day", part)
    ) if not plan.isEmpty() else None
    if merged is None:
        return plan.select("day", F.col("files").alias("files_removed"), F.lit(0).cast("bigint").alias("events"))
    merged.write.mode("overwrite").partitionBy("day", "parts").parquet(f"{work}/days")
    staged = spark.read.schema(T.StructType(_STORED.fields + [T.StructField("parts", T.LongType())])).parquet(f"{work}/days")
    (staged.repartition("day", part).drop("parts").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))
    counts = staged.groupBy("day").agg(F.count(F.lit(1)).alias("events"))
    return plan.join(counts, "day").select("day", F.col("files").alias("files_removed"), "events")

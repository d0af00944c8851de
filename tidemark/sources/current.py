"""The current row of every key, kept at load time, so that a read neither ranks nor sees replaced rows.

Rows live in folders by the month of a date column, each written whole by one merge and named
after it; a list of the folder in force for every month is written last, as one file, and the
newest complete list is the table. A reader therefore sees a merge entirely or not at all, and
one that failed leaves folders that no list names. Merges of a table are run one at a time.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidemark.session import store
from tidemark.sources.tables import newest_wins

_LIST = "version bigint, month date, folder string"


class CurrentTable:
    """A table of the newest row per key under a folder.

    ``by`` is the date column whose windows reads ask for; a newer row may move its key to
    another date. ``newest`` orders the rows of a key as in :func:`newest_wins`; columns in
    ``stamps`` do nothing but that.
    """

    def __init__(
        self, path: str, schema: T.StructType, key: Sequence[str], newest: Sequence[str], by: str, stamps: Sequence[str]
    ) -> None:
        self.path, self.schema, self.by = path.rstrip("/"), schema, by
        self.key, self.newest, self.stamps = list(key), list(newest), list(stamps)

    def months(self, spark: SparkSession) -> tuple[int, dict[dt.date, str]]:
        """The version and its folder for every month, a few entries a year; version 0 is no table."""
        try:
            lists = spark.read.schema(_LIST).parquet(f"{self.path}/lists")
            version = lists.agg(F.max("version")).first()[0] or 0
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, {}
        rows = lists.filter((F.col("version") == version) & F.col("month").isNotNull()).collect()
        return version, {r["month"]: r["folder"] for r in rows}

    def exists(self, spark: SparkSession) -> bool:
        return self.months(spark)[0] > 0

    def read(self, spark: SparkSession, low: dt.date | None = None, high: dt.date | None = None) -> DataFrame:
        """Current rows with ``by`` from ``low`` to ``high`` (inclusive); only those months' folders are listed.

        Any filter on ``by`` reaches the scan, and files are sorted by it.
        """
        rows = self._scan(spark, self.months(spark)[1], low, high)
        if low is not None:
            rows = rows.filter(F.col(self.by) >= F.lit(low))
        return rows if high is None else rows.filter(F.col(self.by) <= F.lit(high))

    def _scan(self, spark: SparkSession, months: dict[dt.date, str], low: dt.date | None = None, high: dt.date | None = None) -> DataFrame:
        chosen = [f for m, f in sorted(months.items()) if (low is None or m >= low.replace(day=1)) and (high is None or m <= high)]
        if not chosen:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in chosen])

    def merge(self, rows: DataFrame) -> None:
        """Take in ``rows``, which may repeat keys; a month is written again only if one of its rows changes.

        Rows equal to the current one but for the stamps change nothing, so a document that
        repeats a filer's history costs a look at its keys and the months of what is new.
        """
        spark = rows.sparkSession
        version, months = self.months(spark)
        names = self.schema.fieldNames()
        told = [c for c in names if c not in self.stamps]
        now = self._scan(spark, months)
        best = newest_wins(rows.select(names), self.key, self.newest)
        # Ranked and compared once; the months, the rewrite and its range bounds are taken from the stored result.
        changed = store(best.alias("n").join(now.select(told).alias("c"), reduce(
            and_, (F.col(f"n.{c}").eqNullSafe(F.col(f"c.{c}")) for c in told)), "left_anti") if months else best, "changed")
        month = F.trunc(self.by, "MM")
        gained = changed.select(month.alias("_month"))
        if months:
            left = now.select(*self.key, month.alias("_month")).join(changed.select(self.key), self.key, "left_semi").select("_month")
            gained = gained.union(left)
        touched = sorted(r[0] for r in gained.distinct().collect())  # months
        if not touched:
            if not version:
                self._publish(spark, 1, {})
            return
        kept = {m: f for m, f in months.items() if m in set(touched)}
        # Keys of new rows are unique already: only kept rows can compete with them.
        merged = newest_wins(self._scan(spark, kept).unionByName(changed), self.key, self.newest) if kept else changed
        folder = f"rows/{version + 1:09d}-{uuid.uuid4().hex[:8]}"
        (merged.withColumn("_month", F.date_format(self.by, "yyyy-MM")).repartitionByRange("_month", self.by, *self.key)
         .sortWithinPartitions("_month", self.by, *self.key).write.partitionBy("_month").parquet(f"{self.path}/{folder}"))
        written = spark.read.parquet(f"{self.path}/{folder}").select(F.col("_month").cast("string").alias("m")).distinct().collect()
        after = {m: f for m, f in months.items() if m not in set(touched)}
        after |= {dt.date.fromisoformat(f"{r['m'][:7]}-01"): f"{folder}/_month={r['m'][:7]}" for r in written}
        self._publish(spark, version + 1, after)

    def _publish(self, spark: SparkSession, version: int, months: dict[dt.date, str]) -> None:
        rows = [(version, m, f) for m, f in sorted(months.items())] or [(version, None, None)]
        spark.createDataFrame(rows, _LIST).coalesce(1).write.mode("append").parquet(f"{self.path}/lists")

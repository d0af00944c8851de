"""Append-only tables in which the newest row of a key wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql import types as T


def newest_wins(df: DataFrame, key: Sequence[str], newest: Sequence[str | Column]) -> DataFrame:
    """One row per key: the largest by ``newest``, compared left to right.

    ``newest`` has to be a total order within a key. Spark runs the
    ``row_number() = 1`` filter as a group limit on both sides of the exchange,
    so each map task sends at most one row per key however many copies of it
    there are.
    """
    order = [(F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in newest]
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def append(df: DataFrame, path: str, partition_by: Sequence[str] = (), cluster_by: Sequence[str] = ()) -> None:
    """Append a batch of files.

    With ``cluster_by`` the rows are range-partitioned and sorted, so the
    statistics of each file cover a narrow range and later filters on those
    columns skip files; a partition value that holds most of the batch is cut
    into ranges too. Without it the adaptive planner just sizes the files.
    """
    keys = [*partition_by, *cluster_by]
    if cluster_by:
        out = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    else:
        out = df.hint("rebalance", *partition_by)
    writer = out.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a stored table with its declared schema; a missing folder is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)

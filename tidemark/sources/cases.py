"""The labelled-case table and its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.replies import SPLITS, split_of
from tidemark.schemas import require
from tidemark.sources.tables import newest_wins


def new_cases(rows: DataFrame) -> DataFrame:
    """Rows of case_id, doc_text, field, expected with their split.

    A blank id or field fails the job.
    """
    require(rows, "case_id", "doc_text", "field", "expected")
    keep = [c for c in rows.columns if c not in ("case_id", "doc_text", "field", "expected", "split")]
    blank = (F.coalesce(F.trim("case_id"), F.lit("")) == "") | (F.coalesce(F.trim("field"), F.lit("")) == "")
    case_id = F.when(blank, F.raise_error(F.lit("case_id and field may not be blank")).cast("string")).otherwise(F.trim("case_id"))
    return rows.select(case_id.alias("case_id"), "doc_text", F.trim("field").alias("field"),
                       F.col("expected").cast("string").alias("expected"), *keep).withColumn("split", split_of(F.col("case_id")))


def upsert_cases(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored cases with incoming ones added; an incoming id replaces the stored one."""
    columns = ["case_id", "doc_text", "field", "expected", "split"]
    both = stored.select(*columns, F.lit(0).alias("_age")).unionByName(incoming.select(*columns, F.lit(1).alias("_age")))
    return newest_wins(both, ["case_id"], ["_age", "field", "expected", "doc_text"]).select(*columns)


def read_cases(cases: DataFrame, split: str | None = None) -> DataFrame:
    """All cases or those of one split; an unknown split is an error."""
    if split is not None and split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, got {split!r}")
    rows = cases if split is None else cases.filter(F.col("split") == split)
    return rows.orderBy("case_id")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Manifest rows as CSV, sorted by case_id over all files."""
    require(manifest, "case_id")
    manifest.orderBy("case_id").write.mode("overwrite").option("header", True).csv(path)

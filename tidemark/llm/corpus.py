"""Documents kept once, compressed and bucketed, for operators that come back to the texts.

A document is named by (doc, copy): its key as a long and, should several texts share the key,
their number in the order of a hash. Rows equal in key and text are repeats of one document and
are treated alike. Texts are compressed with Zstandard and the table is bucketed by (doc, copy),
so they cross the network once however often findings are joined back to them, and the texts of
a key that very many rows share, or of the null key, are spread over all buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import slices
from tidemark.session import scratch, store


@lru_cache(maxsize=1)
def _packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3)


@lru_cache(maxsize=1)
def _unpacker() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _packed(text: Column) -> Column:
    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        pack = _packer().compress
        return pa.array([None if t is None else pack(t) for t in texts.cast(pa.large_binary()).to_pylist()], pa.binary())

    return run(text)


def texts(bodies: pa.Array) -> pa.Array:
    """The UTF-8 bytes behind a column of bodies; a null stays null."""
    unpack = _unpacker().decompress
    return pa.array([None if b is None else unpack(b) for b in bodies.to_pylist()], pa.large_binary())


def _copies(marks: DataFrame) -> DataFrame:
    """(doc, mark, copy) of keys with several texts. Stored, so that a small table, as it mostly is, is
    broadcast and the texts aren't dealt out for the join. A key's rows are ranked as 16 bytes each."""
    shared = marks.groupBy("doc").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).filter("low < high")
    several = marks.join(shared.select("doc"), "doc", "left_semi").distinct()
    order = Window.partitionBy("doc").orderBy("mark")
    return store(several.withColumn("copy", (F.row_number().over(order) - 1).cast("int")), "copies")


class Corpus:
    """``docs`` as a bucketed table (doc, copy, body, row): ``row`` holds all columns but the text."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        spark = docs.sparkSession
        self.name = f"corpus_{uuid.uuid4().hex}"
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        doc = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("doc")
        mark = F.xxhash64(text).alias("mark")
        rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")
        rows = docs.select(doc, mark, _packed(F.col(text)).alias("body"), rest)
        dealt = rows.join(_copies(docs.select(doc, mark)), ["doc", "mark"], "left").withColumn(
            "copy", F.coalesce("copy", F.lit(0))).drop("mark").repartition(self.buckets, "doc", "copy")
        (dealt.write.bucketBy(self.buckets, "doc", "copy").sortBy("doc", "copy")
         .option("path", scratch(spark, "corpus")).format("parquet").saveAsTable(self.name))
        self.frame = spark.table(self.name)

    def drop(self) -> None:
        """Forget the table's name; its files belong to the scratch folder."""
        self.frame.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")

    def joined(self, found: DataFrame, how: str = "inner", row: bool = False) -> DataFrame:
        """(doc, copy, body, [row,] and the columns of ``found``), joined by (doc, copy)."""
        own = self.frame if row else self.frame.drop("row")
        return own.join(found.withColumn("copy", F.col("copy").cast("int")), ["doc", "copy"], how)


def by_document(run: Callable[[list, pa.Array, pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """A ``mapInArrow`` function over (doc, copy, body, ...) whose texts are unpacked; null texts come as null."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield from run(texts(batch.column("body")), batch)

    return over

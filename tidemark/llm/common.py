"""Bounded batches, scratch tables and skew helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.session import configure, store

#: Rows and bytes that a function over Arrow batches works on at a time. Texts can be long, so both are small.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """The package's settings; the text operators have none of their own."""
    return configure(spark)


def _cuts(columns: list[pa.Array], rows: int) -> Iterator[tuple[int, int]]:
    """(start, length) of parts of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes, or a row if that has more."""
    todo = [(low, min(BATCH_ROWS, rows - low)) for low in range(0, rows, BATCH_ROWS)][::-1]
    while todo:
        low, n = todo.pop()
        if n > 1 and sum(c.slice(low, n).nbytes for c in columns) > BATCH_BYTES:
            todo += [(low + n // 2, n - n // 2), (low, n // 2)]
        else:
            yield low, n


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in bounded parts, whatever batches the session sends; empty batches are left out."""
    for batch in batches:
        for low, n in _cuts(batch.columns, batch.num_rows):
            yield batch.slice(low, n)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Spark itself sends batches of that size while the block runs; for actions whose executors are short of
    memory, as a batch is held on both sides of the pipe. The session's own settings come back with the end."""
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {name: spark.conf.get(name, None) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def by_slice(run: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """``run`` over bounded parts of equally long columns, put together again."""
    if not len(columns[0]):
        return run(*columns)
    return pa.concat_arrays([run(*(c.slice(low, n) for c in columns)) for low, n in _cuts(list(columns), len(columns[0]))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row; a null is an empty row."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def split_hot(rows: DataFrame, key: list[str], member: str, limit: int, weight: str | None = None) -> DataFrame:
    """Deal every group of ``key`` to tasks of at most about ``2 * limit`` rows that together see all pairs.

    A group of more than ``limit`` rows, or of more than ``limit`` in the sum of ``weight``, is cut into
    shards by a hash of ``member`` and each pair of shards (a shard with itself too) becomes a task of its own.
    Adds ``left`` and ``right``, the pair, and ``shard``, the row's own. The table
    of hot keys has a row per ``limit`` rows at most.
    """
    size = F.count("*") if weight is None else F.sum(weight)
    hot = rows.groupBy(*key).agg(size.alias("count")).filter(F.col("count") > limit).select(
        *key, F.ceil(F.col("count") / limit).cast("int").alias("shards"))
    dealt = rows.join(hot, key, "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(member), F.col("shards")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other")
    return dealt.select("*", other).withColumn("left", F.least("shard", "other")).withColumn(
        "right", F.greatest("shard", "other")).drop("other", "shards")


def draw(rows: DataFrame, key: str, by: str, sample: int) -> DataFrame:
    """At most ``sample`` distinct (key, by) of every value of ``by``, drawn by a hash of the key; stored.

    The values are classes to learn, so their counts fit the driver. A share of
    each class that gives the sample with some to spare passes by hash, and only
    that is ranked.
    """
    pairs = rows.select(F.col(key).alias("key"), F.col(by).alias("by")).filter(F.col("by").isNotNull())
    counts = [(r["by"], r["count"]) for r in pairs.groupBy("by").count().collect()]
    if not counts:
        return pairs.limit(0)
    shares = F.create_map(*[F.lit(x) for value, n in counts for x in (value, min(1.0, 1.5 * sample / n + 0.0))])
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    order = Window.partitionBy("by").orderBy(F.xxhash64("key"), "key")
    some = pairs.filter(place < shares[F.col("by")]).distinct().withColumn("n", F.row_number().over(order))
    return store(some.filter(F.col("n") <= sample).drop("n"), "drawn")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): (node, component), component the smallest node.

    Alternates the two star steps of the usual distributed algorithm: first every
    node hooks its larger neighbours, then its smaller ones, to its smallest
    neighbour. Each step is an aggregation with map-side combining and an
    equality join, each round is written to the shared folder. A pair with a null
    end or equal ends adds nothing; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    stars = store(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "stars")
    seen = None
    while (mark := _mark(stars)) != seen:
        seen = mark
        both = stars.union(stars.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).filter(a != b).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(a.alias("a"), F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e"))
        stars = store(small.select("e.a", "e.b").filter(a != b).distinct(), "stars")
    return stars.select(a.alias("node"), b.alias("component")).union(stars.select(b, b).distinct())


def _mark(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 linked by pairs (i, j): the smallest node each one reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of rows with equal values in the first ``keys`` (integer) columns; input sorted by them.

    One group is held at a time.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        if held and (columns[0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        for low, high in zip(cuts, cuts[1:]):
            if low:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
        last = columns[-1]
    if held:
        yield pa.Table.from_batches(held)

"""Near-duplicate vectors found through spherical-cap filters.

A filter is a direction, and a vector passes those whose spherical cap it lies deep enough
in. Directions come from random product codes: after a random rotation the dimensions are cut
into four blocks with a small random codebook each, and a direction is one codeword per block.
The number of directions above one fixed height varies a thousandfold from vector to vector,
so the height is each vector's own, the one that ``LIST`` directions of a code exceed. They are
list-decoded: only the best sums over the first two blocks and over the last two can be part
of them, the other combinations are pruned. Vectors that pass a common filter are compared in
double precision; a pair counts at its smallest common filter, so it counts once.

The directions are fixed by a seed, so the index is fitted on nothing and holds every row.
Equal vectors are one node. A filter's bucket of more than ``BUCKET_ROWS`` is cut into pairs
of shards. Buckets report sums and a spanning forest, not their links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common
from tidemark.session import store

COSINE = 0.93
CODEWORDS = 24
#: Independent codes, and the directions of each that a vector passes.
CODES = 8
LIST = 5
BUCKET_ROWS = 4000

_BLOCKS = 4


@lru_cache(maxsize=8)
def _code(size: int, number: int) -> tuple[np.ndarray, list[np.ndarray], list[slice]]:
    """Rotation, codebooks by block and the blocks' dimensions."""
    rng = np.random.default_rng((size, number, 97))
    rotation = np.linalg.qr(rng.normal(size=(size, size)))[0]
    edges = [size * k // _BLOCKS for k in range(_BLOCKS + 1)]
    books = []
    for low, high in zip(edges, edges[1:]):
        words = rng.normal(size=(CODEWORDS, high - low))
        length = np.linalg.norm(words, axis=1, keepdims=True)
        books.append(words / np.where(length > 0, length, 1) / np.sqrt(_BLOCKS))
    return rotation, books, [slice(a, b) for a, b in zip(edges, edges[1:])]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision."""
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors ** 2).sum(1, keepdims=True))


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Positions of the ``n`` largest scores of each row."""
    n = min(n, scores.shape[1])
    return np.argpartition(-scores, n - 1, axis=1)[:, :n]


def filters(vectors: np.ndarray) -> np.ndarray:
    """(vectors, CODES * LIST): the filters each unit vector passes, in order."""
    n, size = vectors.shape
    found = []
    for number in range(CODES):
        rotation, books, blocks = _code(size, number)
        turned = vectors @ rotation
        parts = [turned[:, b] @ book.T for b, book in zip(blocks, books)]
        head = (parts[0][:, :, None] + parts[1][:, None, :]).reshape(n, -1)
        tail = (parts[2][:, :, None] + parts[3][:, None, :]).reshape(n, -1)
        first, second = _best(head, LIST), _best(tail, LIST)
        total = np.take_along_axis(head, first, 1)[:, :, None] + np.take_along_axis(tail, second, 1)[:, None, :]
        at = _best(total.reshape(n, -1), LIST)
        a, b = np.take_along_axis(first, at // LIST, 1), np.take_along_axis(second, at % LIST, 1)
        found.append((number * CODEWORDS ** 2 + a) * CODEWORDS ** 2 + b)
    return np.sort(np.concatenate(found, axis=1), axis=1)


def _valid(vector: str) -> F.Column:
    sound = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """List column of equal lengths as rows."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
    return flat.reshape(len(column), -1).astype(dtype, copy=False)


def _bucket(own: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Nodes with links in a bucket (or pair of its shards): node, linked copies, local root."""
    here, left, right = (own.column(k)[0].as_py() for k in ("filter", "left", "right"))
    shard = own.column("shard").to_numpy()
    a, b = np.flatnonzero(shard == left), np.flatnonzero(shard == right)
    if not len(a) or not len(b) or own.num_rows < 2:
        return None
    points, passed = unit(_matrix(own.column("vector"), np.float64)), _matrix(own.column("filters"), np.int64)
    pairs = []
    for low in range(0, len(a), 1024):
        rows = a[low:low + 1024]
        i, j = np.nonzero(points[rows] @ points[b].T >= cosine)
        i, j = rows[i], b[j]
        keep = i < j if left == right else i != j
        i, j = i[keep], j[keep]
        for at in range(0, len(i), 4096):
            x, y = passed[i[at:at + 4096]], passed[j[at:at + 4096]]
            both = (x[:, :, None] == y[:, None, :]).any(2)
            mine = np.where(both, x, np.iinfo(np.int64).max).min(1) == here
            pairs.append((i[at:at + 4096][mine], j[at:at + 4096][mine]))
    if not pairs:
        return None
    i, j = (np.concatenate(p) for p in zip(*pairs))
    if not len(i):
        return None
    copies, node = own.column("copies").to_numpy(), own.column("node").to_numpy()
    n = own.num_rows
    links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
    at = np.flatnonzero(links)
    return node[at], links[at].astype(np.int64), node[common.local_roots(n, i, j)[at]]


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = COSINE) -> DataFrame:
    """One row per input row: ``key``, ``n_links``, ``component_id`` (smallest key reachable) and ``kept``.

    Vectors are compared when their labels are equal and not null and they have the
    same length. A vector that is null, zero, or holds a null or non-finite component
    links with nothing, as does a row with a null key or label. Equal vectors link;
    repeated rows count as vectors of their own. An empty table gives no rows. Other
    columns are not read.
    """
    own = rows.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    sound = F.col("key").isNotNull() & F.col("label").isNotNull() & _valid("vector")
    own = own.withColumn("node", F.when(sound, F.xxhash64("label", "vector")))
    nodes = own.filter(F.col("node").isNotNull()).groupBy("label", "vector", "node").agg(
        F.count("*").alias("copies"), F.min("key").alias("least"))
    nodes = nodes.select("node", "copies", "least", F.xxhash64("label", F.size("vector")).alias("space"), "vector")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sizes = batch.column(4).value_lengths().to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.take(np.flatnonzero(sizes == size))
                points = unit(_matrix(pa.chunked_array([part.column(4)]), np.float64))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(filters(points).astype(np.int32)), pa.list_(pa.int32()))],
                    ["node", "copies", "least", "space", "vector", "filters"])

    kind = dict(nodes.dtypes)["vector"]
    nodes = store(nodes.mapInArrow(
        decode, f"node long, copies long, least long, space long, vector {kind}, filters array<int>"), "caps")
    passes = nodes.select("node", "space", F.explode("filters").alias("filter"))
    dealt = common.split_hot(passes, ["space", "filter"], "node", BUCKET_ROWS)
    group = ["space", "filter", "left", "right"]
    full = dealt.join(nodes.select("node", "copies", "vector", "filters"), "node").select(
        *group, "shard", "node", "copies", "vector", "filters")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in common.grouped(batches, 4):
            if (got := _bucket(bucket, cosine)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["node", "links", "root"])

    found = store(full.repartition(*group).sortWithinPartitions(*group, "node").mapInArrow(
        compare, "node long, links long, root long"), "links")
    merged = common.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("node", "copies", "least")
    classes = merged.join(named, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    linked = merged.join(classes, "component").select("node", "component_id")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    facts = named.join(linked, "node", "left").join(counts, "node", "left").select(
        "node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"))
    return own.drop("vector").join(facts, "node", "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "key").alias("component_id"),
        (F.col("key") == F.coalesce("component_id", "key")).alias("kept"))

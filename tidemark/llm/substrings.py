"""Removal of repeated byte strings with a sampled, distributed suffix array.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier. A full suffix
array has a suffix for every byte; here only sampled suffixes are sorted. Of the ``k``-byte
strings inside a window of ``LENGTH`` bytes the one with the least hash is the window's anchor,
so equal windows have equal anchors at equal offsets. Consecutive windows with one anchor are a
record: its leading token is the anchor's hash, its tail the hash of all bytes its windows
cover, then its place. Splitters sampled from the records cut their order into ranges (the
place is part of the order, so even one very frequent string spreads over ranges); each range
is sorted by a multikey quicksort and neighbours are compared, as are the ends of adjacent
ranges.

A record equal to an earlier one in token and tail repeats it whole: all its windows go. A
record whose token occurs elsewhere with another tail may repeat a part: its windows enter the
next level with longer anchors (``ANCHORS``), where fewer of them meet. At the last level an
anchor is a whole window and the answer is exact. Records travel packed, as byte planes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common
from tidemark.llm.corpus import Corpus, texts
from tidemark.llm.hashing import mix, prefix, signed, spans
from tidemark.session import store

LENGTH = 100
#: Bytes of an anchor, level by level; the last is the window itself.
ANCHORS = (32, 90, 100)
#: Documents, and one in so many of their records, that the splitters are drawn from.
SAMPLE_DOCUMENTS = 4000
SAMPLE_STEP = 8

_PIECE = 1 << 18
_RECORD = np.dtype([("token", "<u8"), ("tail", "<u8"), ("doc", "<i8"), ("copy", "<u4"), ("at", "<u4"), ("windows", "u1")])
_ORDER = ("token", "tail", "doc", "copy", "at")


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, have = values, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[:len(out) - (width - have)], out[width - have:]) if have < width else out


def records(data: np.ndarray, anchor: int, runs: list[tuple[int, int]], length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(token, tail, first window, windows) of a text, for the window starts in ``runs`` (half-open)."""
    width = length - anchor + 1
    for begin, end in runs:
        for low in range(begin, end, _PIECE):
            high = min(end, low + _PIECE)
            sums = prefix(data[low:high + length - 1])
            n = high - low
            grams = spans(sums, slice(0, n + width - 1), slice(anchor, anchor + n + width - 1))
            token = _least(grams, width)
            if width == 1:
                yield token, np.zeros(n, np.uint64), np.arange(low, high), np.ones(n, np.int64)
                continue
            # A new record where the least hash changes, or its place has left the window.
            fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (grams[:n - 1] == token[:-1])))
            first = np.flatnonzero(fresh)
            size = np.diff(np.concatenate((first, [n])))
            tail = spans(sums, first, first + size + length - 1) + size.astype(np.uint64)
            yield token[first], tail, first + low, size


def multikey(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the first key; runs of equal keys are ordered by the next one, and so on."""
    order = np.argsort(keys[0], kind="quicksort")
    fixed = keys[0][order]
    same = np.concatenate(([False], fixed[1:] == fixed[:-1], [False])) if len(fixed) else np.zeros(1, bool)
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = edges[::2], edges[1::2] + 1
    if len(keys) == 1 or not len(starts):
        return order
    # All runs of equal keys are ordered together: the run's number leads, the remaining keys follow.
    inside = np.zeros(len(order) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    run = np.searchsorted(starts, at, side="right")
    own = order[at]
    order[at] = own[np.lexsort([*(k[own] for k in keys[:0:-1]), run])]
    return order


def _after(rows: np.ndarray, splitter: np.void) -> np.ndarray:
    """Which records come at or after a splitter, by tail and place (their tokens are equal)."""
    out = np.zeros(len(rows), bool)
    open_ = np.ones(len(rows), bool)
    for name in _ORDER[1:]:
        out |= open_ & (rows[name] > splitter[name])
        open_ &= rows[name] == splitter[name]
    return out | open_


def ranges(rows: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """The range each record falls into."""
    low = np.searchsorted(splitters["token"], rows["token"], side="left")
    high = np.searchsorted(splitters["token"], rows["token"], side="right")
    for s in np.unique(np.concatenate([np.arange(a, b) for a, b in {*zip(low[low < high].tolist(), high[low < high].tolist())}] or [np.empty(0, int)])).tolist():
        some = np.flatnonzero((rows["token"] == splitters["token"][s]))
        low[some] += _after(rows[some], splitters[s])
    return low


def _pack(rows: np.ndarray) -> bytes:
    return rows.view(np.uint8).reshape(len(rows), _RECORD.itemsize).T.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(_RECORD.itemsize, -1).T).view(_RECORD).ravel()


def _of_batch(batch: pa.RecordBatch, bodies: pa.Array, anchor: int) -> np.ndarray:
    """All records of a batch (doc, copy, body[, runs])."""
    out = []
    doc, copy = batch.column("doc").to_pylist(), batch.column("copy").to_pylist()
    chosen = batch.column("runs").to_pylist() if "runs" in batch.schema.names else None
    for i, raw in enumerate(bodies.to_pylist()):
        if raw is None or len(raw) < LENGTH:
            continue
        data = np.frombuffer(raw, np.uint8)
        runs = [(0, len(data) - LENGTH + 1)] if chosen is None else _merged([(r["low"], r["high"]) for r in chosen[i]])
        for token, tail, at, windows in records(data, anchor, runs):
            rows = np.empty(len(token), _RECORD)
            rows["token"], rows["tail"], rows["at"], rows["windows"] = token, tail, at, windows
            rows["doc"], rows["copy"] = doc[i], copy[i]
            out.append(rows)
    return np.concatenate(out) if out else np.empty(0, _RECORD)


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _splitters(source: DataFrame, documents: int, anchor: int, parts: int) -> np.ndarray:
    """Quantiles of a bounded sample of the records, in their order."""
    step = max(1, documents // SAMPLE_DOCUMENTS)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows = _of_batch(batch, texts(batch.column("body")), anchor)
            rows = rows[mix(rows["token"] ^ rows["doc"].astype(np.uint64) ^ rows["at"]) % np.uint64(SAMPLE_STEP) == 0]
            yield pa.RecordBatch.from_pydict({"rows": pa.array([_pack(rows)], pa.binary())})

    drawn = source.filter(F.pmod(F.xxhash64("doc", "copy"), F.lit(step)) == 0).mapInArrow(draw, "rows binary").collect()
    every = np.concatenate([_unpack(bytes(r.rows)) for r in drawn] or [np.empty(0, _RECORD)])
    every = every[multikey([every[k] for k in _ORDER])]
    return every[[len(every) * k // parts for k in range(1, parts)]] if len(every) else every


#: What a sorted range says: windows to remove, windows to look at again, undecided ones, and its ends.
_REPEAT, _PARTLY, _PENDING, _FIRST, _LAST = range(5)
_SCHEMA = "kind int, part int, doc long, copy int, at long, windows int, token long, tail long, tails long"


def _judge(rows: np.ndarray, part: int) -> pa.RecordBatch:
    """Compare neighbours in one sorted range."""
    rows = rows[multikey([rows[k] for k in _ORDER])]
    n = len(rows)
    new_token = np.concatenate(([True], rows["token"][1:] != rows["token"][:-1]))
    new_tail = new_token | np.concatenate(([True], rows["tail"][1:] != rows["tail"][:-1]))
    group = np.cumsum(new_token) - 1
    tails = np.bincount(group, new_tail).astype(np.int64)
    kind = np.full(n, -1)
    kind[~new_tail] = _REPEAT
    kind[new_tail & (tails[group] > 1)] = _PARTLY
    ends = new_tail & ((group == 0) | (group == group[-1]))
    kind[ends] = _PENDING
    keep = np.flatnonzero(kind >= 0)
    edge = np.array([0, n - 1])
    at = np.concatenate((keep, edge))
    own = rows[at]
    # The head of a range is marked, as it may continue the last record of the range before.
    head = np.concatenate((np.where(keep == 0, -1, tails[group[keep]]), tails[group[edge]]))
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate((kind[keep], [_FIRST, _LAST])).astype(np.int32)), pa.array(np.full(len(at), part, np.int32)),
        pa.array(own["doc"].copy()), pa.array(own["copy"].astype(np.int32)), pa.array(own["at"].astype(np.int64)),
        pa.array(own["windows"].astype(np.int32)), pa.array(signed(own["token"].copy())), pa.array(signed(own["tail"].copy())),
        pa.array(head)], ["kind", "part", "doc", "copy", "at", "windows", "token", "tail", "tails"])


def _verdicts(ends: list) -> list[tuple[int, int, bool, int]]:
    """(part, token, whether it is the head, verdict) for undecided records, from the ends of all ranges."""
    first = {r.part: r for r in ends if r.kind == _FIRST}
    last = {r.part: r for r in ends if r.kind == _LAST}
    total: dict[int, int] = {}
    continued: dict[int, bool] = {}
    before = None
    for part in sorted(first):
        a, b = first[part], last[part]
        continued[part] = before is not None and (before.token, before.tail) == (a.token, a.tail)
        total[a.token] = total.get(a.token, 0) + a.tails - continued[part]
        if b.token != a.token:
            total[b.token] = total.get(b.token, 0) + b.tails
        before = b
    out = []
    for part, a in first.items():
        for token in {a.token, last[part].token}:
            several = _PARTLY if total[token] > 1 else -1
            out.append((part, token, False, several))
            if token == a.token:
                out.append((part, token, True, _REPEAT if continued[part] else several))
    return out


def _level(source: DataFrame, documents: int, anchor: int) -> DataFrame:
    """(kind, doc, copy, at, windows): the windows of ``source`` (doc, copy, body[, runs]) that repeat or partly repeat."""
    spark = source.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters = _splitters(source, documents, anchor, parts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(held)
            part = ranges(every, splitters)
            order = np.argsort(part, kind="stable")
            every, part = every[order], part[order]
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist()
            return pa.RecordBatch.from_pydict({
                "part": part[cut].astype(np.int32),
                "rows": pa.array([_pack(every[a:b]) for a, b in zip(cut, [*cut[1:], len(every)])], pa.binary())})

        for batch in common.slices(batches):
            rows = _of_batch(batch, texts(batch.column("body")), anchor)
            held.append(rows)
            size += len(rows)
            if size > 400_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in common.grouped(batches, 1):
            yield _judge(np.concatenate([_unpack(b) for b in own.column("rows").to_pylist()]), own.column("part")[0].as_py())

    sorted_ = store(source.mapInArrow(emit, "part int, rows binary").repartition("part").sortWithinPartitions("part").mapInArrow(
        sort, _SCHEMA), "suffixes")
    verdicts = _verdicts(sorted_.filter(F.col("kind") >= _FIRST).select("kind", "part", "token", "tail", "tails").collect())
    known = spark.createDataFrame(verdicts or [(0, 0, False, -1)], "part int, token long, head boolean, verdict int")
    columns = ["doc", "copy", "at", "windows"]
    # The verdicts are a few rows for every range.
    pending = sorted_.filter(F.col("kind") == _PENDING).withColumn("head", F.col("tails") < 0).join(
        F.broadcast(known), ["part", "token", "head"]).select(F.col("verdict").alias("kind"), *columns)
    return sorted_.filter(F.col("kind") < _PENDING).select("kind", *columns).union(pending.filter("kind >= 0"))


def repeats(corpus: Corpus) -> DataFrame:
    """(doc, copy, spans): byte ranges, per document, of the windows that start earlier elsewhere."""
    documents = corpus.frame.count()
    source = corpus.frame.select("doc", "copy", "body")
    found = None
    for anchor in ANCHORS:
        judged = store(_level(source, documents, anchor), "judged")
        here = judged.filter(F.col("kind") == _REPEAT).select(
            "doc", "copy", F.col("at").alias("low"), (F.col("at") + F.col("windows") - 1 + LENGTH).alias("high"))
        found = here if found is None else found.union(here)
        runs = judged.filter(F.col("kind") == _PARTLY).groupBy("doc", "copy").agg(F.collect_list(
            F.struct(F.col("at").alias("low"), (F.col("at") + F.col("windows")).alias("high"))).alias("runs"))
        source = corpus.joined(runs).select("doc", "copy", "body", "runs")
    return found.groupBy("doc", "copy").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


RESULT = "struct<n_bytes:long,spans:array<struct<low:long,high:long>>,kept:binary>"


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``n_bytes``, removed ``spans`` (maximal byte ranges) and the ``kept`` bytes.

    Texts are UTF-8 bytes, null is empty; a text shorter than the window has no
    repeats. Matches don't cross documents. Documents are ordered by key, a null key
    first, then by a hash of the text; rows with equal key and text are one document
    and come back as often. What repeats is judged on the input, so kept bytes need
    not be valid UTF-8. An empty table gives no rows. Other columns are not read.
    """
    with common.small_batches(docs.sparkSession):
        done = _dedup(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return done.withColumnRenamed("key", key)


def _dedup(docs: DataFrame) -> DataFrame:
    corpus = Corpus(docs, "key", "text")
    own = corpus.joined(repeats(corpus), "left", row=True)

    def kept(bodies: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for raw, gone in zip(texts(bodies).to_pylist(), removed.to_pylist()):
            raw = raw or b""
            runs = _merged([(g["low"], g["high"]) for g in gone or []])
            edges = [0, *(x for run in runs for x in run), len(raw)]
            out.append({"n_bytes": len(raw), "spans": [{"low": a, "high": b} for a, b in runs],
                        "kept": b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))})
        span = pa.struct([("low", pa.int64()), ("high", pa.int64())])
        return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())]))

    @F.arrow_udf(RESULT)
    def cut(bodies: pa.Array, removed: pa.Array) -> pa.Array:
        return common.by_slice(kept, bodies, removed)

    done = store(own.select(F.col("row.key").alias("key"), cut("body", "spans").alias("cut")).select("key", "cut.*"), "kept")
    corpus.drop()
    return done

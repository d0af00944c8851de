"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Piece lengths are small integers, so a packing is decided on their histogram: at most
``length`` numbers reach the driver, whatever the corpus. The reduction fixes bins whose
content provably dominates every alternative (a piece nothing else fits with; two pieces
that fill a sequence; the largest fitting partner where at most one more, or no better pair,
could join) for all pieces of the lengths at once and shrinks the instance; best-fit
decreasing packs what remains. The plan says which ranks of each length go where; pieces are
ranked by Spark, in sub-ranks by a hash so that a very common length is many tasks, and look
their place up.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import store

SEQUENCE_TOKENS = 1024
END_ID = 2

# The pre-tokenizer's pattern; a fixed value of the vocabulary.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes no two Unicode tables disagree on.
_PLAIN = re.compile("[\\x09-\\x0d\\x20-\\x7e\\xa1-\\u024f\\u2013\\u2014\\u2018\\u2019\\u201c\\u201d\\u2026\\u20ac]*")


@lru_cache(maxsize=2)
def _tokenizers(path: str):
    """The file's own tokenizer, and the same vocabulary as merge ranks, which encode several times
    as fast, and a pattern of the added tokens, which only the former knows."""
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    vocabulary = content["model"]["vocab"]
    added = re.compile("|".join(re.escape(t["content"]) for t in content.get("added_tokens") or []) or "(?!)")
    # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in printable}
    alphabet |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(alphabet[c] for c in token): rank for token, rank in vocabulary.items() if not token.startswith("<|")}
    return own, tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}), added


def encode(text: str, path: str) -> np.ndarray:
    """Ids of a text as the tokenizer in ``path`` gives them with ``add_special_tokens=False``."""
    own, fast, added = _tokenizers(path)
    if _PLAIN.fullmatch(text) and not added.search(text):
        return np.array(fast.encode_ordinary(text), "<u4")
    return np.array(own.encode(text, add_special_tokens=False).ids, "<u4")


def cut(total: int, length: int = SEQUENCE_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones but for the first."""
    first = total % length or length
    return [(0, first)] + [(at, length) for at in range(first, total, length)] if total > length else [(0, total)]


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = SEQUENCE_TOKENS) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document; a null text is empty and is its end token alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or "", path), np.uint32(END_ID)).astype("<u4")
                rows += [(key, number, start, size, zlib.crc32(ids[start:start + size].tobytes()))
                         for number, (start, size) in enumerate(cut(len(ids), length))]
            yield pa.RecordBatch.from_arrays([
                pa.array(c, t) for c, t in zip(zip(*rows), (batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64()))
            ] if rows else [pa.array([], t) for t in (batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64())],
                ["key", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("body")).mapInArrow(
        run, f"key {kind}, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Groups of equal bins: (number of bins, ((size, how many), ...))."""

    groups: list[tuple[int, tuple[tuple[int, int], ...]]] = field(default_factory=list)

    @property
    def bins(self) -> int:
        return sum(n for n, _ in self.groups)

    def places(self) -> np.ndarray:
        """Rows (size, first rank, pieces a bin, first bin, offset), by size and rank."""
        rank: dict[int, int] = {}
        rows, bin_ = [], 0
        for n, content in self.groups:
            offset = 0
            for size, many in content:
                rows.append((size, rank.get(size, 0), many, bin_, offset))
                rank[size] = rank.get(size, 0) + n * many
                offset += size * many
            bin_ += n
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def reduce(counts: np.ndarray, length: int, plan: Plan) -> None:
    """Fix dominating bins and take their pieces out of ``counts`` (pieces by size), until no rule applies."""
    changed = True
    while changed:
        changed = False
        for size in range(length, 0, -1):
            while counts[size]:
                fixed = _dominant(counts, size, length)
                if fixed is None:
                    break
                partner, n = fixed
                counts[size] -= n
                if partner:
                    counts[partner] -= n
                plan.groups.append((n, ((size, 1), (partner, 1)) if partner and partner != size else
                                    ((size, 2),) if partner else ((size, 1),)))
                changed = True


def _dominant(counts: np.ndarray, size: int, length: int) -> tuple[int, int] | None:
    """(partner or 0, number of bins) that dominate every bin with a piece of ``size``; None if no rule tells."""
    counts[size] -= 1  # the piece itself is no partner
    room = length - size
    sizes = np.flatnonzero(counts[:room + 1])
    try:
        if not len(sizes):
            # Nothing fits beside it. While that holds for its equals too, they go alone together.
            return 0, int(counts[size]) + 1 if size > room else 1
        best = int(sizes[-1])
        if best != room:
            least = np.repeat(sizes[:3], np.minimum(counts[sizes[:3]], 3))[:3]
            two = int(least[:2].sum()) if len(least) > 1 else room + 1
            three = int(least.sum()) if len(least) > 2 else room + 1
            if two <= room and (three <= room or best < _best_pair(counts, sizes, room)):
                return None
        # The rule holds for the next equal bin as well as long as both lengths last: smaller sizes don't change, and
        # with fewer pieces of these lengths the least sums only grow and the best pair only shrinks.
        return best, int((counts[size] + 1) // 2 if size == best else min(counts[size] + 1, counts[best]))
    finally:
        counts[size] += 1


def _best_pair(counts: np.ndarray, sizes: np.ndarray, room: int) -> int:
    """Largest total of two pieces that fit in ``room``."""
    best = 0
    for a in sizes.tolist():
        own = sizes[: np.searchsorted(sizes, room - a, side="right")]
        if len(own) and own[-1] == a and counts[a] < 2:
            own = own[:-1]
        if len(own):
            best = max(best, a + int(own[-1]))
    return best


def best_fit(counts: np.ndarray, length: int, plan: Plan) -> None:
    """Best-fit decreasing of all pieces in ``counts``, equal bins as one group."""
    open_: list[list[tuple[int, tuple]]] = [[] for _ in range(length + 1)]
    for size in range(length, 0, -1):
        n = int(counts[size])
        while n:
            room = next((r for r in range(size, length) if open_[r]), length)
            bins, content = open_[room].pop() if room < length else (n, ())
            fit = room // size
            full = min(bins, n // fit)
            if full:
                open_[room - fit * size].append((full, (*content, (size, fit))))
                n -= full * fit
            left = bins - full
            if left and n and n < fit:
                open_[room - n * size].append((1, (*content, (size, n))))
                left, n = left - 1, 0
            if left and room < length:
                open_[room].append((left, content))
    plan.groups += [group for groups in open_ for group in groups]


def plan_bins(counts: dict[int, int], length: int = SEQUENCE_TOKENS) -> Plan:
    """Pack pieces, counted by length, into bins of ``length``."""
    held = np.zeros(length + 1, np.int64)
    for size, n in counts.items():
        held[size] = n
    plan = Plan()
    reduce(held, length, plan)
    best_fit(held, length, plan)
    return plan


def ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 within each length."""
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", "piece"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "part").orderBy("key", "piece", "start", "ids_crc32")
    return rows.withColumn("own", F.row_number().over(own) - 1).join(counts, ["length", "part"]).withColumn(
        "rank", F.col("before") + F.col("own")).drop("part", "own", "before")


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = SEQUENCE_TOKENS) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids_crc32, sequence_id and offset.

    Every document, empty and null texts included, ends in the end token, so there is
    always a piece; a text of more than ``length`` tokens is cut, the first piece
    being the short one. Repeated rows are packed each; ties are broken by key and
    piece; an empty table gives no rows. Other columns are not read.
    """
    rows = store(pieces(docs, path, key, text, length), "pieces")
    counts = {r.length: r["count"] for r in rows.groupBy("length").count().collect()}
    places = plan_bins(counts, length).places()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = places[:, 0] << 40 | places[:, 1]
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, size << 40 | rank, side="right") - 1
            _, first, many, bin_, offset = places[at].T
            sequence, slot = np.divmod(rank - first, many)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(bin_ + sequence), pa.array(offset + slot * size)],
                ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(rows.dtypes)["key"]
    order = ["key", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked(rows).select(order).mapInArrow(
        place, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ).withColumnRenamed("key", key)

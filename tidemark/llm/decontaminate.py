"""Benchmark decontamination: an exact containment join behind a prefix filter.

Each benchmark item becomes item-sized windows of consecutive words. A window occurs
in a document only if its rarest word does, so that one word is its necessary prefix
(for full containment the prefix of the rarity order is one token). Documents are
scanned for prefix words only; a hit is placed by the word's position in the window,
must fit between the ends of the document (the positional and length bounds), and the
window is verified word by word.

Word frequencies come from a pass over all documents. The windows are shipped to the
tasks in shards of at most ``SHARD_WINDOWS`` windows; a larger benchmark takes as many
scans as it has shards, so what is shipped never grows with the data.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common
from tidemark.llm.hashing import LOWER, signed, word_bounds, word_hashes
from tidemark.session import store

WINDOW_WORDS = 10
#: Windows shipped at once: at most about 100 bytes each.
SHARD_WINDOWS = 200_000

#: Word bytes after lower-casing: digits, a-z and everything beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True

FOUND = "struct<n_words:long,hits:array<struct<start:long,end:long>>,items:array<string>>"
_FOUND_ARROW = pa.struct([
    ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.string()))])


@dataclass
class Words:
    """The words of a batch of texts: bytes, bounds, hashes and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        data, offsets = common.utf8(column)
        data = LOWER[data]
        starts, ends = word_bounds(data, offsets, WORD_BYTES)
        return cls(data, starts, ends, word_hashes(data, starts, ends), np.searchsorted(starts, offsets))

    def text(self, at: int) -> bytes:
        return self.data[self.starts[at]:self.ends[at]].tobytes()


def windows(items: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(item, word_count, window array<binary>): the distinct windows of every item; a shorter item is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = Words.of(batch.column(1))
            for row, item in enumerate(batch.column(0).to_pylist()):
                own = [found.text(i) for i in range(found.first[row], found.first[row + 1])]
                size = min(words, len(own))
                got = list(dict.fromkeys(tuple(own[i:i + size]) for i in range(len(own) - size + 1) if size))
                for at in range(0, len(got), 1000):
                    part = got[at:at + 1000]
                    yield pa.RecordBatch.from_pydict(
                        {"item": pa.array([item] * len(part), pa.string()), "words": pa.array(part, pa.list_(pa.binary()))})

    return items.select(F.col(key).cast("string"), F.col(text)).mapInArrow(cut, "item string, words array<binary>")


def word_counts(docs: DataFrame, text: str, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each word hash of the (bounded) vocabulary occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in common.slices(batches):
            at, known = _find(vocabulary, Words.of(batch.column(0)).hashes)
            total += np.bincount(at[known], minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"word": signed(vocabulary), "n": total})

    sums = docs.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word & (2**64 - 1): r.n for r in sums.toLocalIterator()}


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each value in the sorted table, and whether it is there."""
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return at, (table[at] == values) if len(table) else np.zeros(len(values), bool)


class Matcher:
    """Finds all occurrences of a bounded set of windows in texts."""

    def __init__(self, rows: list[tuple[str, tuple[bytes, ...]]], hashes: dict[bytes, int], counts: dict[int, int]) -> None:
        self.items: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
        for item, window in rows:
            self.items[window].append(item)
        #: prefix word -> (its position in the window, window length) pairs that occur
        self.places: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for window in self.items:
            at = min(range(len(window)), key=lambda i: (counts.get(hashes[window[i]], 0), window[i]))
            self.places[hashes[window[at]]].add((at, len(window)))
        self.prefixes = np.array(sorted(self.places), np.uint64)

    def scan(self, column: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int]], list[str]]]:
        """Per text: number of words, merged hit ranges of word positions, items with occurring windows."""
        found = Words.of(column)
        _, known = _find(self.prefixes, found.hashes)
        hot = np.flatnonzero(known)
        cut = np.searchsorted(hot, found.first)
        for row in range(len(column)):
            low, high = int(found.first[row]), int(found.first[row + 1])
            spans, items = [], set()
            for at in hot[cut[row]:cut[row + 1]].tolist():
                for place, size in self.places[int(found.hashes[at])]:
                    start = at - place
                    if start < low or start + size > high:
                        continue
                    window = tuple(found.text(i) for i in range(start, start + size))
                    if window in self.items:
                        spans.append((start - low, start - low + size))
                        items.update(i for i in self.items[window] if i is not None)
            yield row, high - low, merge(spans), sorted(items)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching half-open ranges as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _matchers(docs: DataFrame, items: DataFrame, text: str, item_key: str, item_text: str, words: int) -> Iterator[Matcher]:
    """One matcher per shard of the benchmark; a shard is brought to the driver, the benchmark isn't."""
    rows = windows(items, item_key, item_text, words)
    rows = store(rows, "windows")
    shards = max(1, -(-rows.count() // SHARD_WINDOWS))
    for shard in range(shards):
        own = rows.filter(F.pmod(F.xxhash64("words"), F.lit(shards)) == shard) if shards > 1 else rows
        got = [(r.item, tuple(bytes(w) for w in r.words)) for r in own.toLocalIterator()]
        vocabulary = sorted({w for _, window in got for w in window})
        hashes = dict(zip(vocabulary, Words.of(pa.array(vocabulary, pa.binary())).hashes.tolist()))
        counts = word_counts(docs, text, np.unique(np.array(list(hashes.values()), np.uint64))) if got else {}
        yield Matcher(got, hashes, counts)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", words: int = WINDOW_WORDS) -> DataFrame:
    """Per document row: ``key``, ``n_words``, ``hits`` (half-open word ranges), ``n_hit`` and ``items`` (sorted ids).

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII
    characters. Null and empty texts have no words and no hits; an item without
    words has no windows; equal items all count; a null item id is left out of
    ``items`` though its words are hit. Repeated rows are judged each; an empty
    benchmark hits nothing. Other columns are not read.
    """
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    found = _searched(own, own, items, item_key, item_text, words)
    return found.select(
        F.col("key").alias(key), "found.n_words", "found.hits",
        F.aggregate("found.hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"]).alias("n_hit"),
        F.col("found.items").alias("items"))


def _searched(own: DataFrame, counted: DataFrame, items: DataFrame, item_key: str, item_text: str, words: int) -> DataFrame:
    """``own``, which has the text as ``body``, with ``found``, what all shards of the benchmark have found.

    A shard's findings are stored before the next shard is brought to the driver, so however large the
    benchmark is, one shard is held by the driver and by a task at any time.
    """
    out = None
    for matcher in _matchers(counted, items, "body", item_key, item_text, words):
        if out is None:
            out = own.withColumn("found", _searcher(matcher)(F.col("body"), F.lit(None).cast(FOUND)))
        else:
            out = store(out, "found")
            out = out.withColumn("found", _searcher(matcher)(F.col("body"), F.col("found")))
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
          words: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of any item occurs."""
    own = docs.select(F.col(text).alias("body"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"))
    found = _searched(own, own.select("body"), items, item_key, item_text, words).filter(F.size("found.hits") == 0)
    return found.select(*[F.col("body").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _searcher(matcher: Matcher):
    def scan(texts: pa.Array, before: pa.Array) -> pa.Array:
        rows = [{"n_words": n, "hits": spans, "items": ids}
                for _, n, spans, ids in matcher.scan(texts)]
        for row, old in zip(rows, before.to_pylist()):
            spans = row["hits"]
            if old is not None:
                spans = merge(spans + [(h["start"], h["end"]) for h in old["hits"]])
                row["items"] = sorted({*row["items"], *old["items"]})
            row["hits"] = [{"start": s, "end": e} for s, e in spans]
        return pa.array(rows, _FOUND_ARROW)

    @F.arrow_udf(FOUND)
    def search(texts: pa.Array, before: pa.Array) -> pa.Array:
        return common.by_slice(scan, texts, before)

    return search

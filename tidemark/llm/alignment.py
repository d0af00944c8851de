"""Two tokenizers aligned by the bytes their tokens end at, and how often each pair of ids is linked in the corpus.

A text is encoded once by a byte-level tokenizer (A) and a sentence-piece one (B); the ids are
stored, two bytes each, and later passes align them again from the lengths of the tokens. Where
an A and a B token end together a group ends, and the two are linked.

Counting: tasks gather their distinct pairs of ids, Spark makes them distinct over all tasks,
and a minimal perfect hash gives each pair a slot. A task counts into one dense vector over the
slots, vectors are added up along a tree, and the last pass looks counts up, each slot verified
by the key it holds. Linked tokens end together, so the bytes of one are the end of the other's:
a vocabulary has at most as many pairs as its tokens have ends (:func:`most_pairs`; half a
million for the vocabularies of the query), however large the corpus. That bounds the keys that
reach the driver, the vectors and the broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common
from tidemark.llm.packing import _PATTERN, _PLAIN
from tidemark.llm.perfect import PerfectHash
from tidemark.session import store

#: Slots of a part of a count vector, vectors added up by one task, and tokens written out at a time.
BLOCK = 1 << 16
FAN = 16
_WRITTEN = 400_000

_SPACE_MARK = "▁"


class Vocabularies:
    """Both tokenizers of a worker, their tokens' bytes, and the bytes' lengths."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(a_path)
        self.own.encode_special_tokens = True  # their strings in a text are plain text
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in printable}
        alphabet |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        vocabulary = self.own.get_vocab(with_added_tokens=False)
        self.a = [b""] * self.own.get_vocab_size()
        for token, number in vocabulary.items():
            if all(c in alphabet for c in token):
                self.a[number] = bytes(alphabet[c] for c in token)
        special = {t.content for t in self.own.get_added_tokens_decoder().values()}
        ranks = {self.a[number]: number for token, number in vocabulary.items() if token not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in table], np.int64) for table in (self.a, self.b))
        self.kind = "<u2" if max(len(self.a), len(self.b)) <= 1 << 16 else "<u4"

    def _piece(self, number: int) -> bytes:
        if self.pieces.is_control(number) or self.pieces.is_unknown(number):
            return b""
        piece = self.pieces.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(number) else piece.replace(_SPACE_MARK, " ").encode()

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space + text by A and of the text by B; none if either's bytes aren't space + text."""
        none = np.empty(0, self.kind), np.empty(0, self.kind)
        if not text:
            return none
        spaced = " " + text
        a = self.fast.encode_ordinary(spaced) if _PLAIN.fullmatch(text) else self.own.encode(spaced, add_special_tokens=False).ids
        b = self.pieces.encode(text)
        want = spaced.encode()
        if b"".join([self.b[i] for i in b]) != want or b"".join([self.a[i] for i in a]) != want:
            return none
        return np.array(a, self.kind), np.array(b, self.kind)


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of tokens can end together: one's bytes are the end of the other's."""
    def ends(tokens: list[bytes], others: list[bytes], whole: bool) -> int:
        held: dict[bytes, int] = {}
        for t in others:
            held[t] = held.get(t, 0) + 1
        return sum(held.get(t[i:], 0) for t in tokens for i in range(0 if whole else 1, len(t)))

    return ends(a, b, True) + ends(b, a, False)


@dataclass
class Aligned:
    """Rows of ids laid end to end, aligned: ``a_last`` and ``b_last`` are the last tokens of each group."""

    a: np.ndarray
    b: np.ndarray
    a_rows: np.ndarray
    b_rows: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray
    #: First group of each row, and the number of groups.
    rows: np.ndarray

    @classmethod
    def of(cls, a: pa.Array, b: pa.Array, words: Vocabularies) -> Aligned:
        (a_ids, a_rows), (b_ids, b_rows) = (_ids(c, words.kind) for c in (a, b))
        # Both sides of a row have the same bytes, so running lengths agree over all rows.
        a_ends, b_ends = np.cumsum(words.a_sizes[a_ids]), np.cumsum(words.b_sizes[b_ids])
        token = np.zeros((int(a_ends[-1]) if len(a_ends) else 0) + 1, np.int32)
        token[b_ends] = np.arange(1, len(b_ends) + 1)
        met = token[a_ends]
        a_last = np.flatnonzero(met)
        return cls(a_ids, b_ids, a_rows, b_rows, a_last, met[a_last].astype(np.int64) - 1, np.searchsorted(a_last, a_rows))

    def pairs(self) -> np.ndarray:
        """The linked ids, A's in the upper half; one link for each group."""
        return self.a[self.a_last].astype(np.int64) << 32 | self.b[self.b_last].astype(np.int64)

    def written(self, row: int) -> Iterator[bytes]:
        """A row's groups, ``a1,a2|b1;a3|b2,b3``, in parts of bounded length."""
        low, high = int(self.rows[row]), int(self.rows[row + 1])
        a_at, b_at = int(self.a_rows[row]), int(self.b_rows[row])
        while low < high:
            # As many groups as fit, one at least.
            to = max(low + 1, min(high, int(np.searchsorted(self.a_last, a_at + _WRITTEN)), int(np.searchsorted(self.b_last, b_at + _WRITTEN))))
            a_last, b_last = self.a_last[low:to] - a_at, self.b_last[low:to] - b_at
            a_to, b_to = a_at + int(a_last[-1]) + 1, b_at + int(b_last[-1]) + 1
            part = _written(self.a[a_at:a_to], self.b[b_at:b_to], a_last, b_last)
            yield part[:-1] if to == high else part
            low, a_at, b_at = to, a_to, b_to


def _ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = common.utf8(column)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data.tobytes(), kind), offsets // size


_digits: tuple[np.ndarray, np.ndarray] | None = None


def _decimal(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 to ``most`` and a place for a separator in rows of bytes, and the numbers of digits."""
    global _digits
    if _digits is None or len(_digits[1]) <= most:
        texts = [str(i).encode() for i in range(most + 1)]
        wide = len(texts[-1]) + 1
        _digits = np.frombuffer(b"".join(t.ljust(wide) for t in texts), np.uint8).reshape(-1, wide), np.array([len(t) for t in texts])
    return _digits


def _written(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> bytes:
    """Whole groups as text; each ends in a semicolon."""
    a_group, b_group = np.searchsorted(a_last, np.arange(len(a))), np.searchsorted(b_last, np.arange(len(b)))
    b_before, a_upto = np.concatenate(([0], b_last[:-1] + 1)), a_last + 1
    a_place, b_place = np.arange(len(a)) + b_before[a_group], np.arange(len(b)) + a_upto[b_group]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[a_place], ids[b_place] = a, b
    mark[a_place[a_last]], mark[b_place[b_last]] = ord("|"), ord(";")
    digits, sizes = _decimal(int(ids.max()))
    rows, sizes = digits[ids], sizes[ids]
    rows[np.arange(len(ids)), sizes] = mark
    return rows[np.arange(rows.shape[1]) <= sizes[:, None]].tobytes()


def tokens(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored (key, a, b, pairs): a row per row of ``docs`` with both id sequences as bytes, and rows that hold
    nothing but distinct linked pairs that a task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabularies(a_path, b_path)
        seen, held = np.empty(0, np.int64), []
        for batch in common.slices(batches):
            both = [words.encode(t.as_py()) for t in batch.column(1)]
            a, b = (pa.array([x[side].tobytes() for x in both], pa.binary()) for side in (0, 1))
            held.append(np.unique(Aligned.of(a, b, words).pairs()))
            if sum(map(len, held)) > 1 << 20:
                seen, held = np.unique(np.concatenate([seen, *held])), []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), a, b, pa.nulls(len(both), pa.binary())], ["key", "a", "b", "pairs"])
        seen = np.unique(np.concatenate([seen, *held]))
        if len(seen):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), *(pa.nulls(1, pa.binary()) for _ in "ab"), pa.array([seen.tobytes()], pa.binary())],
                ["key", "a", "b", "pairs"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    kind = pa.schema([_arrow_field(rows)]).types[0]
    return store(rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, a binary, b binary, pairs binary"), "tokens")


def _arrow_field(rows: DataFrame) -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.field("key", to_arrow_type(rows.schema["key"].dataType))


def distinct_pairs(stored: DataFrame) -> np.ndarray:
    """All linked pairs of the corpus, sorted; their number is bounded by the vocabularies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(held, np.int64))], ["pair"])

    found = stored.filter("pairs IS NOT NULL").select("pairs").mapInArrow(run, "pair long").distinct().toArrow()
    return np.sort(found.column("pair").to_numpy())


@dataclass
class Counts:
    """Pairs by their slots, the links of each, and the most links that a B id has with one A id."""

    slot: PerfectHash
    keys: np.ndarray
    links: np.ndarray
    best: np.ndarray

    def slots(self, pairs: np.ndarray) -> np.ndarray:
        at = self.slot.slots(pairs)
        if len(at) and not np.array_equal(self.keys[at], pairs):
            raise ValueError("a pair that the first pass has not seen")
        return at


def count(stored: DataFrame, a_path: str, b_path: str) -> Counts:
    """The links of every pair, counted in dense vectors by slot that are added up along a tree."""
    spark = stored.sparkSession
    pairs = distinct_pairs(stored)
    slot = PerfectHash(pairs)
    keys = np.empty(len(pairs), np.int64)
    keys[slot.slots(pairs)] = pairs
    table = Counts(slot, keys, np.zeros(len(keys), np.int64), np.empty(0, np.int64))
    if len(keys):
        sent = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, known, total = vocabularies(a_path, b_path), sent.value, np.zeros(len(sent.value.keys), np.int64)
            for batch in common.slices(batches):
                found = Aligned.of(batch.column(0), batch.column(1), words).pairs()
                if len(found):
                    total += np.bincount(known.slots(found), minlength=len(total))
            parts = [(i, total[at:at + BLOCK]) for i, at in enumerate(range(0, len(total), BLOCK))]
            parts = [(i, p) for i, p in parts if p.any()]
            if parts:
                yield pa.RecordBatch.from_arrays([
                    pa.array([i for i, _ in parts], pa.int32()), pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32()),
                    pa.array([p.tobytes() for _, p in parts], pa.binary())], ["block", "task", "links"])

        def add(group: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(v, np.int64) for v in group.column("links").to_pylist()], axis=0)
            return pa.table({"block": group.column("block").slice(0, 1), "task": group.column("task").slice(0, 1),
                             "links": pa.array([total.tobytes()], pa.binary())})

        source = stored.filter("pairs IS NULL").select("a", "b")
        schema = "block int, task int, links binary"
        vectors, tasks = source.mapInArrow(run, schema), source.rdd.getNumPartitions()
        while tasks > 1:
            vectors = vectors.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("block", "task").applyInArrow(add, schema)
            tasks = -(-tasks // FAN)
        for r in vectors.collect():  # a row a block
            part = np.frombuffer(r.links, np.int64)
            table.links[r.block * BLOCK:r.block * BLOCK + len(part)] += part
        sent.unpersist()
    b = keys & 0xFFFFFFFF
    table.best = np.zeros(int(b.max()) + 1 if len(b) else 0, np.int64)
    np.maximum.at(table.best, b, table.links)
    return table


_SUMMARY = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_GROUPS = "groups string, links array<struct<a:int,b:int,count:long,best:boolean>>"


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", summary: bool = False) -> DataFrame:
    """Per row of ``docs``: ``key``, ``groups`` (``a1,a2|b1;a3|b2,b3``, ids in order) and ``links``, one for each
    group: the ids that end it, the pair's count in the corpus, and whether no pair of that B id has a higher one.

    ``summary`` gives counts and a digest instead: n_a, n_b (tokens), n_groups, n_links, n_best,
    count_sum and groups_sha256. Null and empty texts, and texts that either tokenizer's bytes
    don't give back (a literal U+2581, for example), have no tokens: no links, empty strings, zeros.
    Repeated rows count and come back each, null keys stay, an empty table gives no rows. Other
    columns are not read. No token that a tokenizer gives may be without bytes.
    """
    stored = tokens(docs, a_path, b_path, key, text)
    sent = docs.sparkSession.sparkContext.broadcast(count(stored, a_path, b_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = vocabularies(a_path, b_path), sent.value
        for batch in common.slices(batches):
            found = Aligned.of(batch.column(1), batch.column(2), words)
            pairs = found.pairs()
            links = table.links[table.slots(pairs)]
            best = links == table.best[pairs & 0xFFFFFFFF]
            if summary:
                yield _summed(batch, found, links, best)
            else:
                each = pa.StructArray.from_arrays(
                    [pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(links), pa.array(best)],
                    ["a", "b", "count", "best"])
                text = [b"".join(found.written(i)).decode() for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(text, pa.string()), pa.ListArray.from_arrays(pa.array(found.rows.astype(np.int32)), each)],
                    ["key", "groups", "links"])

    kind = dict(stored.dtypes)["key"]
    return stored.filter("pairs IS NULL").select("key", "a", "b").mapInArrow(
        run, f"key {kind}, {_SUMMARY if summary else _GROUPS}").withColumnRenamed("key", key)


def _summed(batch: pa.RecordBatch, found: Aligned, links: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    def by_row(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return sums[found.rows[1:]] - sums[found.rows[:-1]]

    digests = []
    for i in range(batch.num_rows):
        if found.rows[i] == found.rows[i + 1]:
            digests.append("")
            continue
        own = hashlib.sha256()
        for part in found.written(i):
            own.update(part)
        digests.append(own.hexdigest())
    groups = np.diff(found.rows)
    columns = [np.diff(found.a_rows), np.diff(found.b_rows), groups, groups, by_row(best), by_row(links)]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(digests, pa.string())],
        ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

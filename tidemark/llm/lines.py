"""Line deduplication: an exact set-similarity self-join of lines.

A line is the set of its words (ASCII lower case, between ASCII white space). Two lines match
when the Jaccard similarity of their sets reaches 4/5. Words are ordered by rarity in the
corpus; two matching lines must share a word within their prefixes of that order, so only
prefix words are joined. Pairs must pass the length filter, the positional bound (the words
behind the shared one must suffice for the overlap) and a parity bitmap (each bit that differs
needs a word in only one of the lines), and are then verified word by word. A line goes when
an earlier one (smaller document, or earlier in the same one) matches it.

Rarity is the count of a word's hash in a table of fixed size; any fixed order gives the same
matches. Each distinct line takes part once, with its first occurrence. Words with more than
``HOT_COUNT`` occurrences are cut into pairs of shards. A word whose lines yield more than
``CLUSTER`` candidates each on average belongs to a group of near copies: it reports its lines
instead of their pairs, and the lines are compared with their earlier ones in order, each
dropping out at its first match, so such groups stay linear and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common
from tidemark.llm.corpus import Corpus, by_document, texts
from tidemark.llm.hashing import LOWER, NOT_SPACE, mix, signed, word_bounds, word_hashes
from tidemark.session import store

#: The rarity table: fixed, whatever the corpus.
TABLE = 1 << 20
SLICES = 64
HOT_COUNT = 100_000
#: Candidates per line from which a word reports its lines instead of pairs.
CLUSTER = 16
_PLACE = ["doc", "copy", "line"]
#: Groups beyond this size are compared block by block.
GROUP_ROWS = 1500
#: Words gathered before they are counted.
_COUNTED = 1 << 22

_WORD_BITS = np.uint64(40)
_ROW = [("tok", "<u8"), ("doc", "<i8"), ("copy", "<u4"), ("line", "<u4"), ("size", "<u4"), ("pos", "<u4"), ("even", "<u8"), ("odd", "<u8")]


class Lines:
    """Words of a batch of texts by line. Lines are numbered by splitting at line feeds; blank ones have no words."""

    def __init__(self, texts: pa.Array) -> None:
        data, offsets = common.utf8(texts)
        self.data = LOWER[data]
        self.starts, self.ends = word_bounds(self.data, offsets, NOT_SPACE)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        breaks = np.flatnonzero(data == 10)
        rows = np.arange(len(offsets) - 1)
        begin = np.concatenate((offsets[:-1], breaks + 1))
        owner = np.concatenate((rows, np.searchsorted(offsets, breaks, side="right") - 1))
        order = np.lexsort((begin, owner))
        begin, owner = begin[order], owner[order]
        at = np.searchsorted(begin, self.starts, side="right") - 1
        number = np.arange(len(owner)) - np.searchsorted(owner, owner)
        #: Per word the position of its line among the batch's lines with words.
        self.first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.empty(0, np.int64)
        self.word_line = np.repeat(np.arange(len(self.first)), np.diff(np.concatenate((self.first, [len(at)]))))
        self.row, self.number = owner[at[self.first]], number[at[self.first]]

    def signatures(self) -> np.ndarray:
        """A hash of each line's words in order."""
        if not len(self.first):
            return np.empty(0, np.uint64)
        place = (np.arange(len(self.hashes)) - self.first[self.word_line]).astype(np.uint64)
        return mix(np.add.reduceat(mix(self.hashes + place * np.uint64(0x9E3779B97F4A7C15)), self.first))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def _token_slots(tokens: np.ndarray) -> np.ndarray:
    """The slot of a word from the 40 bits of its hash that a token keeps."""
    return ((tokens & np.uint64((1 << 40) - 1)) >> np.uint64(20)).astype(np.int64)


def survey(corpus: Corpus) -> DataFrame:
    """One pass: a row per line with words (doc, copy, line, signature), and the task's rarity counts in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(TABLE, np.int32), [], 0
        names = ["doc", "copy", "line", "signature", "slice", "counts"]

        def count() -> None:
            nonlocal counts, held, size
            if held:
                counts += np.bincount(np.concatenate(held), minlength=TABLE).astype(np.int32)
            held, size = [], 0

        def rows(own: pa.Array, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal size
            found = Lines(own)
            held.append(_slots(found.hashes))
            size += len(found.hashes)
            if size > _COUNTED:
                count()
            n = len(found.row)
            doc, copy = (batch.column(k).to_numpy()[found.row] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(copy), pa.array(found.number.astype(np.int32)), pa.array(signed(found.signatures())),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)

        yield from by_document(rows)(batches)
        count()
        if counts.any():
            parts = counts.reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SLICES, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64())]
                + [pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names)

    return store(corpus.frame.select("doc", "copy", "body").mapInArrow(
        run, "doc long, copy int, line int, signature long, slice int, counts binary"), "lines")


def rarity(surveyed: DataFrame) -> np.ndarray:
    """The summed rarity table."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in common.grouped(batches, 1):
            total = np.zeros(TABLE // SLICES, np.int64)
            for counts in own.column("counts").to_pylist():
                total += np.frombuffer(counts, np.int32)
            yield pa.RecordBatch.from_pydict({"slice": own.column("slice")[:1].combine_chunks(), "counts": [total.tobytes()]})

    sums = surveyed.filter("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice").sortWithinPartitions(
        "slice").mapInArrow(add, "slice int, counts binary").collect()
    table = np.zeros((SLICES, TABLE // SLICES), np.int64)
    for r in sums:
        table[r.slice] = np.frombuffer(r.counts, np.int64)
    return table.ravel()


def rarity_codes(counts: np.ndarray) -> np.ndarray:
    """The table in eighths of a doubling, which is order enough; zero stands for a word seen once."""
    return np.minimum(8 * np.log2(np.maximum(counts, 1)), 255).astype(np.uint8)


def prefix_length(size):
    """Words of a set of ``size`` among which a match must share one."""
    return size - (4 * size + 4) // 5 + 1


def prefixes(found: Lines, wanted: np.ndarray, codes: np.ndarray, doc: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """The joined rows of the ``wanted`` lines: a row per prefix word that some other line has."""
    out = []
    chosen = np.flatnonzero(wanted)
    for low in range(0, len(chosen), 1 << 16):
        part = chosen[low:low + (1 << 16)]
        local = np.full(len(found.first), -1, np.int32)
        local[part] = np.arange(len(part), dtype=np.int32)
        of_word = local[found.word_line]
        hashes = found.hashes
        if len(part) < len(found.first):
            words = np.flatnonzero(of_word >= 0)
            of_word, hashes = of_word[words], hashes[words]
        # Rarest first, ties go by hash.
        rare = codes[_slots(hashes)].astype(np.uint64)
        keys = np.sort(of_word.astype(np.uint64) << np.uint64(48) | rare << _WORD_BITS | hashes >> np.uint64(24))
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
        line = (keys >> np.uint64(48)).astype(np.int32)
        token = keys & np.uint64((1 << 48) - 1)
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        size = np.diff(np.concatenate((first, [len(keys)])))
        place = np.arange(len(keys)) - first[line]
        bit = np.uint64(1) << (token & np.uint64(63))
        low_half = ((token >> np.uint64(6)) & np.uint64(1)) - np.uint64(1)  # all ones or none
        even = np.bitwise_xor.reduceat(bit & low_half, first)
        odd = np.bitwise_xor.reduceat(bit & ~low_half, first)
        keep = (place < prefix_length(size)[line]) & (token >> _WORD_BITS > 0)
        own = line[keep]
        rows = np.empty(len(own), _ROW)
        rows["tok"], rows["size"], rows["pos"] = token[keep], size[own], place[keep]
        rows["doc"], rows["copy"] = doc[found.row[part[own]]], copy[found.row[part[own]]]
        rows["line"] = found.number[part[own]]
        rows["even"], rows["odd"] = even[own], odd[own]
        out.append(rows)
    return np.concatenate(out) if out else np.empty(0, _ROW)


# Flags above the size of a row.
_RIGHT = np.uint32(1 << 30)
_CROSS = np.uint32(1 << 29)
_SIZE_BITS = np.uint32((1 << 29) - 1)


def deal(rows: np.ndarray, shards: np.ndarray, targets: int) -> Iterator[tuple[int, bytes]]:
    """Rows by target task, as byte planes (which compress); words of several shards go to a task per pair of shards."""
    parts = [rows[shards <= 1]]
    hot = np.flatnonzero(shards > 1)
    if len(hot):
        own, n = rows[hot], shards[hot].astype(np.int64)
        shard = (mix(own["doc"].astype(np.uint64) * np.uint64(31) + own["line"]) % n.astype(np.uint64)).astype(np.int64)
        for other in range(int(n.max())):
            some = other < n
            left, right = np.minimum(shard[some], other), np.maximum(shard[some], other)
            copy = own[some].copy()
            # The pair of shards joins the word in the group's name: 48 bits of word mix with the pair.
            copy["tok"] = mix(copy["tok"] + (1 + left * 2048 + right).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)
            copy["size"] |= np.where(shard[some] > other, _RIGHT, np.uint32(0))
            copy["size"] |= np.where(shard[some] != other, _CROSS, np.uint32(0))
            parts.append(copy)
    every = np.concatenate(parts)
    target = (mix(every["tok"]) % np.uint64(targets)).astype(np.uint16 if targets < 1 << 16 else np.int64)
    order = np.argsort(target, kind="stable")
    every, target = every[order], target[order]
    cuts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else []
    for low, high in zip(cuts, [*cuts[1:], len(target)]):
        yield int(target[low]), every[low:high].view(np.uint8).reshape(high - low, -1).T.tobytes()


def _rows(blob: bytes) -> np.ndarray:
    width = np.dtype(_ROW).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(_ROW).ravel()


class _Sorted:
    """Rows of one task as columns, by word and size."""

    def __init__(self, rows: np.ndarray) -> None:
        size = rows["size"] & _SIZE_BITS
        # A word has 48 bits; sizes beyond 16 bits share the last place, which the filters know of.
        key = rows["tok"] << np.uint64(16) | np.minimum(size, 0xFFFF).astype(np.uint64)
        self.order = np.argsort(key)
        self.tok = key[self.order] >> np.uint64(16)
        self.size = size[self.order].astype(np.int64)
        self.pos = rows["pos"][self.order].astype(np.int64)
        self.even, self.odd = rows["even"][self.order], rows["odd"][self.order]
        self.place = [rows[k][self.order] for k in _PLACE]
        flags = rows["size"][self.order]
        self.cross, self.right = (flags & _CROSS) != 0, (flags & _RIGHT) != 0
        self.crossed = bool(self.cross.any())

    def candidates(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs may match: the length and positional bounds, then the bitmap."""
        both = self.size[i] + self.size[j]
        need = (4 * both + 8) // 9
        fits = (self.pos[i] <= self.size[i] - need) & (self.pos[j] <= self.size[j] - need)
        if self.crossed:
            fits &= ~self.cross[i] | (self.right[i] != self.right[j])
        ok = np.flatnonzero(fits)
        i, j = i[ok], j[ok]
        apart = np.bitwise_count(self.even[i] ^ self.even[j]).astype(np.int64) + np.bitwise_count(self.odd[i] ^ self.odd[j])
        return ok[apart <= (both - 2 * need)[ok]]

    def later(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether line i comes after line j in the documents' order."""
        out, open_ = np.zeros(len(i), bool), np.ones(len(i), bool)
        for column in self.place:
            out |= open_ & (column[i] > column[j])
            open_ &= column[i] == column[j]
        return out


def pairs_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (later, earlier) of one task's rows, as positions, and the rows of clusters, which have no pairs."""
    if not len(rows):
        return (np.empty(0, np.int64),) * 3
    own = _Sorted(rows)
    cut = np.flatnonzero(np.concatenate(([True], own.tok[1:] != own.tok[:-1], [True])))
    sizes = np.diff(cut)
    group = np.repeat(np.arange(len(sizes)), sizes)
    end = cut[1:][group]
    clipped = np.minimum(own.size, 0xFFFF)

    found, crowded = [], np.zeros(len(sizes), bool)
    active, step = np.flatnonzero((sizes <= GROUP_ROWS)[group]), 1
    while len(active):
        active = active[active + step < end[active]]
        # Sizes ascend in a group: once they are too far apart they stay so.
        active = active[5 * clipped[active] >= 4 * clipped[active + step]]
        ok = active[own.candidates(active, active + step)]
        if len(ok):
            found.append((ok, ok + step))
        step += 1
    for g in np.flatnonzero(sizes > GROUP_ROWS).tolist():
        got, total = [], 0
        for pair in _blocks(own, clipped, int(cut[g]), int(cut[g + 1])):
            got.append(pair)
            total += len(pair[0])
            if total > CLUSTER * sizes[g]:
                crowded[g], got = True, []
                break
        found += got
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
    crowded |= np.bincount(group[i], minlength=len(sizes)) > CLUSTER * sizes
    keep = ~crowded[group[i]]
    i, j = i[keep], j[keep]
    after = own.later(i, j)
    return (own.order[np.where(after, i, j)], own.order[np.where(after, j, i)], own.order[np.flatnonzero(crowded[group])])


def _blocks(own: _Sorted, clipped: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of a large group, block by block; a row meets the ones behind it up to its size's reach."""
    reach = low + np.searchsorted(clipped[low:high], 5 * clipped[low:high] // 4, side="right")
    at = low
    while at < high:
        # As many rows as make about two million pairs.
        upto = at + max(1, int(np.searchsorted(np.cumsum(reach[at - low:] - np.arange(at, high)), 1 << 21)))
        i = np.arange(at, min(upto, high))
        many = np.maximum(reach[i - low] - i - 1, 0)
        left = np.repeat(i, many)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
        ok = own.candidates(left, right)
        yield left[ok], right[ok]
        at = upto


def first_matches(sets: list[np.ndarray], turn: np.ndarray) -> np.ndarray:
    """Which of some lines (word sets) match a line with a smaller ``turn``; each drops out at its first match."""
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    order = np.argsort(turn, kind="stable")
    matched = np.zeros(len(sets), bool)
    has = np.zeros(len(words), bool)
    active, member = order, None
    for t in order.tolist():
        if member is None or len(member) > 2 * max(1, (~matched[active]).sum()):
            active = active[~matched[active]]
            member = active
            spots = np.concatenate([flat[start[i]:start[i] + size[i]] for i in member]) if len(member) else flat[:0]
            edge = np.cumsum(size[member]) - size[member]
        if not len(member):
            break
        own = flat[start[t]:start[t] + size[t]]
        has[own] = True
        shared = np.add.reduceat(has[spots].astype(np.int64), edge)
        has[own] = False
        alike = (turn[member] > turn[t]) & (5 * shared >= 4 * (size[member] + size[t] - shared))
        matched[member[alike]] = True
    return matched


def _chosen(found: Lines, lists: pa.Array) -> np.ndarray:
    """Which lines of a batch are named in its rows' lists of line numbers."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    named = np.repeat(np.arange(len(lists)), sizes) << 32 | lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.isin(found.row << 32 | found.number, named)


_PAIR = [f"{by}{k}" for by in ("", "by_") for k in _PLACE]


def candidates(corpus: Corpus, firsts: DataFrame, counts: np.ndarray) -> DataFrame:
    """Candidate pairs (doc, copy, line, by_doc, by_copy, by_line), ``by`` the earlier line; a line of a
    cluster comes alone, with the cluster's word in ``cluster``.

    ``firsts`` (doc, copy, lines) names the lines that take part.
    """
    spark = firsts.sparkSession
    targets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    codes = rarity_codes(counts)
    hot = np.minimum(-(-counts // HOT_COUNT), 2048).astype(np.uint16)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(held)
            got = list(deal(every, hot[_token_slots(every["tok"])], targets))
            return pa.RecordBatch.from_pydict({
                "target": pa.array([t for t, _ in got], pa.int32()), "rows": pa.array([b for _, b in got], pa.binary())})

        def run(own: pa.Array, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            found = Lines(own)
            held.append(prefixes(found, _chosen(found, batch.column("lines")), codes, batch.column("doc").to_numpy(), batch.column("copy").to_numpy()))
            size += len(held[-1])
            if size > 400_000:
                yield flush()
                held, size = [], 0

        yield from by_document(run)(batches)
        if size:
            yield flush()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in common.grouped(batches, 1):
            every = np.concatenate([_rows(b) for b in own.column("rows").to_pylist()])
            later, earlier, crowd = pairs_of(every)
            pair = np.unique(np.stack([every[k][at].astype(np.int64) for at in (later, earlier) for k in _PLACE], axis=1), axis=0)
            for at in range(0, len(pair), 100_000):
                part = pair[at:at + 100_000].T
                yield pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in part] + [pa.nulls(part.shape[1], pa.int64())], [*_PAIR, "cluster"])
            for at in range(0, len(crowd), 100_000):
                part = every[crowd[at:at + 100_000]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[k].astype(np.int64)) for k in _PLACE] + [pa.nulls(len(part), pa.int64())] * 3 + [pa.array(signed(part["tok"].copy()))],
                    [*_PAIR, "cluster"])

    dealt = corpus.joined(firsts).select("doc", "copy", "body", "lines").mapInArrow(emit, "target int, rows binary")
    pairs = dealt.repartition("target").sortWithinPartitions("target").mapInArrow(
        search, ", ".join(f"{c} long" for c in [*_PAIR, "cluster"]))
    return store(pairs.distinct(), "candidates")


def verified(corpus: Corpus, found: DataFrame) -> DataFrame:
    """(doc, copy, line) of lines with a verified earlier match among the candidates ``found``."""
    needed = found.select(*_PLACE).union(found.filter("cluster IS NULL").select("by_doc", "by_copy", "by_line")).groupBy(
        "doc", "copy").agg(F.collect_set("line").alias("lines"))

    def run(own: pa.Array, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lines = Lines(own)
        at = np.flatnonzero(_chosen(lines, batch.column("lines")))
        after = np.concatenate((lines.first[1:], [len(lines.starts)]))
        if len(at):
            words = [signed(np.unique(lines.hashes[a:b])) for a, b in zip(lines.first[at], after[at])]
            row = lines.row[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(row)), batch.column("copy").take(pa.array(row)), pa.array(lines.number[at].astype(np.int64)),
                 pa.array(words, pa.list_(pa.int64()))], [*_PLACE, "words"])

    own = corpus.joined(needed).select("doc", "copy", "body", "lines")
    sets = store(own.mapInArrow(by_document(run), "doc long, copy int, line long, words array<long>").dropDuplicates(_PLACE), "sets")
    by = sets.select(*[F.col(c).alias(f"by_{c}") for c in sets.columns])
    both = found.filter("cluster IS NULL").join(sets, _PLACE).join(by, ["by_doc", "by_copy", "by_line"])
    shared = F.size(F.array_intersect("words", "by_words"))
    alike = 5 * shared >= 4 * (F.size("words") + F.size("by_words") - shared)
    pairs = both.filter(alike).select(*_PLACE)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.grouped(batches, 1):
            if group.num_rows > 1:
                # Lines arrive in the documents' order.
                words = [w.values.to_numpy() for w in group.column("words").combine_chunks()]
                at = pa.array(np.flatnonzero(first_matches(words, np.arange(len(words)))))
                yield group.select(_PLACE).take(at).combine_chunks().to_batches()[0] if len(at) else _nothing(group)

    def _nothing(group: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in group.select(_PLACE).schema], _PLACE)

    crowd = found.filter("cluster IS NOT NULL").select("cluster", *_PLACE).join(sets, _PLACE).select("cluster", *_PLACE, "words")
    clusters = crowd.repartition("cluster").sortWithinPartitions("cluster", *_PLACE).mapInArrow(resolve, "doc long, copy long, line long")
    return pairs.union(clusters).distinct()


def removals(corpus: Corpus) -> DataFrame:
    """(doc, copy, lines, removed): per document with words, its number of worded lines and the numbers of those that go."""
    surveyed = survey(corpus)
    counts = rarity(surveyed)
    lines = surveyed.filter("slice IS NULL").select("doc", "copy", "line", "signature")
    place = F.struct(*_PLACE)
    firsts = store(lines.groupBy("signature").agg(F.min(place).alias("at"), F.count("*").alias("n")), "firsts")
    own = store(firsts.groupBy("at.doc", "at.copy").agg(F.collect_list("at.line").alias("lines")), "first_lines")
    matched = store(verified(corpus, candidates(corpus, own, counts)), "matched")
    gone = matched.select(F.struct("doc", F.col("copy").cast("int").alias("copy"), F.col("line").cast("int").alias("line")).alias("at"), F.lit(True).alias("gone"))
    decided = firsts.join(gone, "at", "left").filter("gone OR n > 1").select("signature", "at", F.coalesce("gone", F.lit(False)).alias("gone"))
    out = lines.join(decided, "signature").filter(F.col("gone") | (place != F.col("at")))
    removed = out.groupBy("doc", "copy").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    return removed


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", report: str | None = None) -> DataFrame:
    """``docs`` without the lines that an earlier line matches.

    ``report`` names a column to add: (lines with words, numbers of the removed lines).

    Lines end at line feeds and are numbered from 0 in each text; blank lines have no
    words, never match and stay. Null and empty texts stay as they are. Documents are
    ordered by key, a null key before all, then by a hash of the text; rows with equal
    key and text are one document, so its lines are removed from all of them or none.
    Equal lines match, so the first of a group stays unless an earlier similar line
    removes it. An empty table stays empty; other columns, whatever their names, come
    through.
    """
    corpus = Corpus(docs, key, text)
    own = corpus.joined(removals(corpus), "left", row=True).select("doc", "copy", "body", "removed", "row")

    def kept(bodies: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for raw, gone in zip(texts(bodies).to_pylist(), removed.to_pylist()):
            if raw is None:
                out.append({"text": None, "lines": 0, "removed": []})
                continue
            parts = raw.split(b"\n")
            drop = set(gone or [])
            kept = raw if not drop else b"\n".join(p for i, p in enumerate(parts) if i not in drop)
            out.append({"text": kept.decode(), "lines": sum(1 for p in parts if p.split()), "removed": sorted(drop)})
        return pa.array(out, pa.struct([("text", pa.string()), ("lines", pa.int64()), ("removed", pa.list_(pa.int32()))]))

    @F.arrow_udf("struct<text:string,lines:long,removed:array<int>>")
    def cut(bodies: pa.Array, removed: pa.Array) -> pa.Array:
        return common.by_slice(kept, bodies, removed)

    done = store(own.select("row", cut("body", "removed").alias("cut")).select(
        "row", F.col("cut.text").alias("text"), F.struct("cut.lines", "cut.removed").alias("report")), "deduped")
    corpus.drop()
    rebuilt = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return done.select(*rebuilt, *([F.col("report").alias(report)] if report else []))

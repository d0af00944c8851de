"""Phrases of a corpus by vertical partitioning of its word suffixes into subtrees that fit in memory.

The corpus is read three times. The first pass counts words. The second counts prefixes of two
words, of which only those with enough occurrences can begin a phrase. The third cuts the
suffixes that begin with such a prefix at four words, or where two words are no such prefix,
and deals them to groups: prefixes are put into groups in the order of their hash, by their
counts, so that no group has more suffixes than the memory budget; a prefix that has more is
extended by its third word and dealt to groups of its own. Groups are built independently:
equal suffixes are folded, sorted, and the runs of equal leading words are the nodes of the
depth-truncated suffix subtree, whose counts are the totals of their leaves.

Words are 64-bit hashes, with their language in the hash, until the phrases are known; two
words of the corpus that share a hash would be taken for one. What tasks need to know about the
corpus has a fixed size: two bit maps that no frequent word or prefix is missing from (others may be
in them, which costs work and changes nothing) and the group of each range of prefix hashes. Prefixes
beyond the budget are at most as many as budgets fit into the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm import common
from tidemark.llm.hashing import LOWER, mix, signed, word_bounds, word_hashes
from tidemark.session import store

LEAST = 30
#: Percentage of a phrase's occurrences that, inside a longer one, make it a part of that.
PART = 80
TOP = 2000
#: Most suffixes of a group.
BUDGET = 1_000_000
#: Bits of the maps of frequent words and prefixes, and of the ranges of prefix hashes.
WORD_BITS, PREFIX_BITS, CELL_BITS = 26, 27, 20
UNKNOWN = "und"

_DEPTH = 4
_HELD = 1_000_000
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_WORD = ~_BREAK
_WORD[[32, 9]] = False
_SUFFIX = np.dtype([("words", "<u8", _DEPTH), ("n", "<u4")])


def _chain(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word; a single word is its own hash."""
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


class Words:
    """The words of a batch (lang, text) in order: hashes, and whether the next word follows in the same piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        data, offsets = common.utf8(texts)
        data = LOWER[data]
        self.data, (self.starts, self.ends) = data, word_bounds(data, offsets, _WORD)
        per_row = np.diff(np.searchsorted(self.starts, offsets))
        self.row = np.repeat(np.arange(len(per_row)), per_row)
        names, at = common.utf8(langs)
        own = np.zeros(len(langs), np.uint64)
        filled = np.flatnonzero(at[1:] > at[:-1])
        own[filled] = word_hashes(names, at[:-1][filled], at[1:][filled])
        self.hashes = mix(word_hashes(data, self.starts, self.ends) ^ mix(own)[self.row])
        self.hashes[self.hashes == 0] = 1  # zero stands for no word
        piece = np.cumsum(_BREAK[data], dtype=np.int32)[self.starts]
        self.next = np.zeros(len(self.starts), bool)
        self.next[:-1] = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])

    def text(self, at: int) -> bytes:
        return self.data[self.starts[at]:self.ends[at]].tobytes()


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    size = len(bits).bit_length() + 2  # the map is a power of two
    at = hashes >> np.uint64(64 - size)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def _bit_map(keys: DataFrame, size: int) -> np.ndarray:
    """A map of ``size`` bits, as a power of two, with the leading bits of every ``key`` set."""
    block = 16

    def fill(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << block, np.uint8)
        bits[group.column("bit").to_numpy() & ((1 << block) - 1)] = 1
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()),
                         "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    rows = keys.select(F.shiftrightunsigned("key", 64 - size).alias("bit")).distinct().withColumn(
        "block", F.shiftright("bit", block).cast("int"))
    out = np.zeros(1 << size >> 3, np.uint8)
    for r in rows.groupBy("block").applyInArrow(fill, "block int, bits binary").collect():  # as many bytes as the map
        at = r.block << block >> 3
        out[at:at + (1 << block >> 3)] = np.frombuffer(r.bits, np.uint8)
    return out


def _own(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("body"))


def word_counts(rows: DataFrame) -> DataFrame:
    """Stored (lang, word, key, f) of every word of ``rows`` (lang, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush() -> pa.RecordBatch:
            keys = np.fromiter(held, np.uint64, len(held))
            langs, words, counts = zip(*held.values())
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(signed(keys)), pa.array(counts, pa.int64())],
                ["lang", "word", "key", "n"])

        for batch in common.slices(batches):
            found = Words(batch.column(0), batch.column(1))
            keys, first, counts = np.unique(found.hashes, return_index=True, return_counts=True)
            for key, at, n in zip(keys.tolist(), first.tolist(), counts.tolist()):
                if key in held:
                    held[key][2] += n
                else:
                    held[key] = [batch.column(0)[int(found.row[at])].as_py(), found.text(at), n]
            if len(held) > _HELD // 2:
                yield flush()
                held = {}
        if held:
            yield flush()

    return store(rows.mapInArrow(run, "lang string, word string, key long, n long").groupBy("lang", "word", "key").agg(
        F.sum("n").alias("f")), "words")


def _folded(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their totals, and the place of the first of each."""
    if not len(keys):
        return keys, counts, np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first), order[first]


def _prefixes(found: Words, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a frequent word is followed by one in its piece, and the hashes of the two."""
    often = _has(words, found.hashes)
    at = np.flatnonzero(found.next[:-1] & often[:-1] & often[1:])
    return at, _chain(found.hashes[at], found.hashes[at + 1])


def prefix_counts(rows: DataFrame, sent, least: int, parts: int) -> DataFrame:
    """Stored (key, f) of the prefixes of two words with ``least`` occurrences; ``sent`` has the frequent words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def fold() -> None:
            nonlocal keys, counts, size
            k, n, _ = _folded(np.concatenate(keys), np.concatenate(counts))
            keys, counts, size = [k], [n], len(k)

        def flush() -> pa.RecordBatch:
            k, n = keys[0], counts[0].astype("<u4")
            part = ((k >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array(part[cut]), *(pa.array([c[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(k)])], pa.binary()) for c in (k, n))],
                ["part", "keys", "counts"])

        for batch in common.slices(batches):
            _, found = _prefixes(Words(batch.column(0), batch.column(1)), sent.value)
            keys.append(found)
            counts.append(np.ones(len(found), np.int64))
            size += len(found)
            if size > 2 * _HELD:
                fold()
                if size > _HELD:
                    yield flush()
                    keys, counts, size = [], [], 0
        if size:
            fold()
            yield flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.grouped(batches, 1):
            k, n, _ = _folded(*(np.concatenate([np.frombuffer(x, kind) for x in group.column(c).to_pylist()])
                                for c, kind in (("keys", "<u8"), ("counts", "<u4"))))
            n = n.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(k[n >= least])), pa.array(n[n >= least])], ["key", "f"])

    return store(rows.mapInArrow(emit, "part int, keys binary, counts binary").repartition("part").sortWithinPartitions(
        "part").mapInArrow(total, "key long, f long"), "prefixes")


class Groups:
    """Which group a suffix belongs to."""

    def __init__(self, prefixes: DataFrame, budget: int, parts: int) -> None:
        """``prefixes`` (key, f); a group for each of ``parts``, or as many as the budget asks for."""
        hot = sorted((r.key & (2**64 - 1), r.f) for r in prefixes.filter(F.col("f") > budget).collect())  # at most total / budget
        cells = np.zeros(1 << CELL_BITS, np.int64)
        sums = prefixes.filter(F.col("f") <= budget).groupBy(F.shiftrightunsigned("key", 64 - CELL_BITS).alias("cell")).agg(F.sum("f").alias("f"))
        got = sums.toArrow()  # at most a row a cell
        cells[got.column("cell").to_numpy()] = got.column("f").to_numpy()
        every = int(cells.sum())
        n = max(parts, -(-every // budget))
        self.cell = ((np.cumsum(cells) - cells) * float(n) / max(every, 1)).astype(np.int32)
        self.hot = np.array([k for k, _ in hot], np.uint64)
        self.hot_f = np.array([f for _, f in hot], np.int64)
        own = -(-self.hot_f // budget) * 2
        self.hot_first, self.hot_groups = n + np.cumsum(own) - own, own

    def of(self, prefix: np.ndarray, longer: np.ndarray) -> np.ndarray:
        """``longer`` is the hash of the prefix and the next word, or of the prefix alone where it ends."""
        group = self.cell[(prefix >> np.uint64(65 - len(self.cell).bit_length())).astype(np.int64)].copy()
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, prefix), len(self.hot) - 1)
            own = self.hot[at] == prefix
            at = at[own]
            group[own] = self.hot_first[at] + (mix(longer[own]) % self.hot_groups[at].astype(np.uint64)).astype(np.int64)
        return group


def _suffixes(found: Words, words: np.ndarray, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes that begin with a prefix, cut at four words or where the next two words are none:
    words (rows of four, zero where cut), the hash of the prefix and that of one word more."""
    at, key = _prefixes(found, words)
    known = _has(prefixes, key)
    at, key = at[known], key[known]
    begins = np.zeros(len(found.hashes) + _DEPTH, bool)
    begins[at] = True
    hashes = np.concatenate((found.hashes, np.zeros(_DEPTH, np.uint64)))
    rows = np.zeros((len(at), _DEPTH), np.uint64)
    rows[:, 0], rows[:, 1] = hashes[at], hashes[at + 1]
    third = begins[at + 1]
    fourth = third & begins[at + 2]
    rows[third, 2], rows[fourth, 3] = hashes[at + 2][third], hashes[at + 3][fourth]
    return rows, key, np.where(third, _chain(key, rows[:, 2]), key)


def _fold(rows: np.ndarray) -> np.ndarray:
    """Equal suffixes as one, in the order of their words."""
    order = np.lexsort([rows["words"][:, k] for k in range(_DEPTH - 1, -1, -1)])
    rows = rows[order]
    new = np.concatenate(([True], (rows["words"][1:] != rows["words"][:-1]).any(axis=1)))
    first = np.flatnonzero(new)
    out = rows[first]
    out["n"] = np.minimum(np.add.reduceat(rows["n"].astype(np.int64), first), 2**32 - 1)
    return out


#: A phrase: its hash, length and count, its words, the counts of its first two and three words, the hashes of what is
#: left after one, two and three words, and of the phrases of two words or more in it.
_PHRASE = ("key long, size int, a long, words array<long>, lead array<long>, rest array<long>, inner array<long>")


def _subtree(rows: np.ndarray, least: int, groups: Groups) -> Iterator[pa.RecordBatch]:
    """The nodes of two words or more with ``least`` occurrences, their counts the totals of their leaves."""
    w = np.ascontiguousarray(rows["words"])
    n = rows["n"].astype(np.int64)
    changed = np.ones((len(rows), _DEPTH), bool)
    changed[1:] = np.logical_or.accumulate(w[1:] != w[:-1], axis=1)
    pair = _chain(w[:, 0], w[:, 1])
    totals = {}
    for depth in range(2, _DEPTH + 1):
        first = np.flatnonzero(changed[:, depth - 1])
        total = np.add.reduceat(n, first)
        if depth == 2 and len(groups.hot):
            # The subtree of an extended prefix is one of several; its count is known.
            at = np.minimum(np.searchsorted(groups.hot, pair[first]), len(groups.hot) - 1)
            total = np.where(groups.hot[at] == pair[first], groups.hot_f[at], total)
        node = np.cumsum(changed[:, depth - 1]) - 1
        totals[depth] = total[node]  # of every row
        here = first[(w[first, depth - 1] != 0) & (total >= least)]
        if not len(here):
            continue
        words = w[here, :depth]
        ends = {}  # hash of the words from i to j
        for i in range(depth):
            ends[i, i + 1] = words[:, i]
            for j in range(i + 1, depth):
                ends[i, j + 1] = _chain(ends[i, j], words[:, j])
        rest = [ends[i, depth] for i in range(1, depth)]
        inner = [h for (i, j), h in ends.items() if 2 <= j - i < depth]
        lead = [totals[k][here] for k in range(2, depth)]
        size = len(here)

        def lists(columns: list[np.ndarray]) -> pa.Array:
            flat = np.stack(columns, axis=1).astype(np.uint64).view(np.int64).ravel() if columns else np.empty(0, np.int64)
            return pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * len(columns)), pa.array(flat))

        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(ends[0, depth])), pa.array(np.full(size, depth, np.int32)), pa.array(totals[depth][here]),
             lists([words[:, i] for i in range(depth)]), lists(lead), lists(rest), lists(inner)],
            ["key", "size", "a", "words", "lead", "rest", "inner"])


def phrase_counts(rows: DataFrame, words: DataFrame, least: int, budget: int) -> DataFrame:
    """Stored phrases of two to four words with ``least`` occurrences, columns as in ``_PHRASE``."""
    spark = rows.sparkSession
    parts = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    often = spark.sparkContext.broadcast(_bit_map(words.filter(F.col("f") >= least).select("key"), WORD_BITS))
    prefixes = prefix_counts(rows, often, least, parts)
    begin = spark.sparkContext.broadcast(_bit_map(prefixes.select("key"), PREFIX_BITS))
    groups = spark.sparkContext.broadcast(Groups(prefixes, budget, parts))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def fold() -> None:
            nonlocal held, size
            held = [_fold(np.concatenate(held))]
            size = len(held[0])

        def flush() -> pa.RecordBatch:
            every = held[0]
            prefix = _chain(every["words"][:, 0], every["words"][:, 1])
            third = every["words"][:, 2]
            group = groups.value.of(prefix, np.where(third != 0, _chain(prefix, third), prefix))
            order = np.argsort(group, kind="stable")
            every, group = every[order], group[order]
            cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array(group[cut].astype(np.int32)), pa.array([every[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(every)])], pa.binary())],
                ["group", "rows"])

        for batch in common.slices(batches):
            found, _, _ = _suffixes(Words(batch.column(0), batch.column(1)), often.value, begin.value)
            own = np.empty(len(found), _SUFFIX)
            own["words"], own["n"] = found, 1
            held.append(own)
            size += len(own)
            if size > _HELD:
                fold()
                if size > _HELD // 2:
                    yield flush()
                    held, size = [], 0
        if size:
            fold()
            yield flush()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.grouped(batches, 1):
            held, size = [], 0
            for blob in group.column("rows"):
                held.append(np.frombuffer(blob.as_buffer(), _SUFFIX))
                size += len(held[-1])
                if size > 2 * budget:
                    held = [_fold(np.concatenate(held))]
                    size = len(held[0])
            yield from _subtree(_fold(np.concatenate(held)), least, groups.value)

    dealt = rows.mapInArrow(emit, "group int, rows binary").repartition("group").sortWithinPartitions("group")
    # An extended prefix is in each of its subtrees, with the same count.
    return store(dealt.mapInArrow(build, _PHRASE).dropDuplicates(["key"]), "phrases")


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(2000000 a / (l + r)), exactly."""
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(2000000), (l + r).cast("decimal(20,0)")).cast("long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, part: int = PART,
                 top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """The ``top`` phrases of two to four words of each language: lang, rank, phrase, a, l, r, n, score.

    Letters A-Z are lower-cased; words are what is between spaces and tabs, and don't hold, nor phrases
    span, the characters ``.,;:!?`` and ends of line. A phrase with ``a`` (``least`` or more) occurrences,
    overlaps included, is scored by its weakest cut, floor(2000000 a / (l + r)) with the counts of both
    sides (ties: the earliest cut), unless some longer phrase that holds its words has ``part`` percent
    of its occurrences. ``n`` is the language's number of words. Ties in score go to the higher count,
    then by the bytes of the phrase. Null languages are ``und``; null and empty texts have no words;
    repeated rows count each; a language without such phrases, and an empty table, has no rows. Other
    columns are not read.
    """
    rows = _own(docs, text, lang)
    words = word_counts(rows)
    phrases = phrase_counts(rows, words, least, budget)
    often = words.filter(F.col("f") >= least)
    counts = often.select("key", "f").union(phrases.select("key", F.col("a").alias("f")))

    # What is asked for: the count of the first word (at 0) and of what is left after each cut.
    asked = phrases.select(F.col("key").alias("phrase"), F.posexplode(F.concat(F.slice("words", 1, 1), "rest")).alias("at", "key"))
    told = asked.join(counts, "key").groupBy("phrase").agg(*[F.max(F.when(F.col("at") == k, F.col("f"))).alias(f"f{k}") for k in range(_DEPTH)])
    held = phrases.select(F.explode("inner").alias("phrase"), "a").groupBy("phrase").agg(F.max("a").alias("most"))
    own = phrases.select(F.col("key").alias("phrase"), "a", "size", "words", "lead").join(held, "phrase", "left").filter(
        F.col("most").isNull() | (F.col("most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * part)).join(told, "phrase")
    cuts = [F.when(F.col("size") > k, F.struct(
        _score(F.col("a"), left, F.col(f"f{k}")).alias("score"), F.lit(k).alias("cut"), left.alias("l"), F.col(f"f{k}").alias("r")))
        for k, left in ((1, F.col("f0")), (2, F.get("lead", F.lit(0))), (3, F.get("lead", F.lit(1))))]
    scored = own.select("phrase", "a", "words", F.array_min(F.array(*cuts)).alias("c")).select(
        "phrase", "a", "words", "c.score", "c.l", "c.r")

    # Ties at the end of the report are told apart by the words themselves, so they are kept until those are known.
    named = scored.join(often.select(F.col("key").alias("first"), "lang"), F.get("words", F.lit(0)) == F.col("first")).drop("first")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = store(named.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top).drop("place"), "near")
    each = near.select("phrase", F.posexplode("words").alias("at", "key")).join(often.select("key", "word"), "key")
    spelled = each.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w")).select(
        F.col("phrase").alias("of"), F.array_join(F.col("w.word"), " ").alias("spelling"))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    final = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("spelling"))
    return near.join(spelled, F.col("phrase") == F.col("of")).withColumn("rank", F.row_number().over(final).cast("long")).filter(
        F.col("rank") <= top).join(total, "lang").select(
        "lang", "rank", F.col("spelling").alias("phrase"), "a", "l", "r", "n", "score")

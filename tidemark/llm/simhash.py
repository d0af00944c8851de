"""SimHash near-duplicates, searched with BK-trees.

A fingerprint has a bit for each bit position set in more than half of the
document's shingle hashes. Two fingerprints at most ``radius`` bits apart agree in
at least one of ``radius + 1`` bands, so fingerprints are dealt to shards by band;
a shard is a BK-tree (children keyed by their integer Hamming distance to the
parent) that is searched by following only edges within the radius. Documents with
equal fingerprints are one node throughout, and shards report a spanning forest
instead of all their links, so neither copies nor large groups of near copies make
quadratic output. A shard that grows beyond ``SHARD_ROWS`` is cut into several trees,
each of which is searched by the whole shard.

Similar texts (:func:`similar`) differ in more bits than bands can bear: at a shingle
similarity of 0.8 about 10 of 64, at times 18, for which bands would be 3 bits wide. Their
trees are therefore dealt by least shingle hashes: texts of similarity s have each of
``DRAWS`` least hashes in common with probability s, however large the corpus is, so shards
hold texts that share passages and nothing else. What the trees find within ``WIDE_RADIUS``
falls into loose groups; within each, the trees are searched again and each pair found is
verified by the exact Jaccard similarity of the shingle sets, unless the two are linked already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import common
from tidemark.llm.hashing import LOWER, NOT_SPACE, mix, signed, word_bounds, word_hashes
from tidemark.session import store

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Fingerprints of one tree; larger shards are cut into several trees.
SHARD_ROWS = 4000
#: Least similarity of texts, as a fraction, and the differing bits that fingerprints of such texts may show.
SIMILARITY = (4, 5)
SIMILAR_WORDS = 5
WIDE_RADIUS = 18
#: Least shingle hashes that deal a text to shards.
DRAWS = 4
#: Shingles of the sets that one tree of a loose group holds, 8 bytes each.
GROUP_SHINGLES = 4 << 20

_LOWER = LOWER.tobytes()


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of UTF-8 text over word shingles, repeats included; zero without words."""
    got = text.translate(_LOWER).split()
    if not got:
        return 0
    joined = b" ".join(got)
    ends = np.cumsum([len(w) + 1 for w in got]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(got) - words + 1)
    last = ends[min(words, len(got)) - 1:]
    digest = xxhash.xxh64_intdigest
    return majority(np.array(
        [digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist())], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the 64-bit ``hashes``."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 255 * 256):  # byte-wide counters hold 255 additions
        part = hashes[at:at + 255 * 256].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        full = np.zeros((-(-len(part) // 255) * 255, 8), np.uint64)
        full[:len(part)] = bits
        sums = full.reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)
        counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Adds ``fingerprint`` (long, the 64 bits as they are). Null and empty texts get zero."""

    @F.pandas_udf("long")
    def of(texts):
        return texts.map(lambda t: np.uint64(fingerprint((t or "").encode(), words)).astype(np.int64))

    return docs.withColumn("fingerprint", of(F.col(text)))


class Tree:
    """A BK-tree of integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            below = self.children[at].setdefault(d, new)
            if below == new:
                return
            at = below

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of the values within ``radius``, in order of insertion."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found


def _bands(radius: int) -> list[tuple[int, int]]:
    """Shift and width of each of the ``radius + 1`` bands of 64 bits."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _forest(own: list[tuple[int, int, int]], left: int, right: int, radius: int) -> list[tuple[int, int]]:
    """Edges (node, smaller node) that connect what one pair of shards links.

    ``own`` holds (node, value, shard). With one shard the tree is searched
    before each insertion; with two, the right one searches the left one's tree.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = up = parent.get(up, up)
            x = up
        return x

    tree, nodes = Tree(), []
    for node, value, shard in sorted(own, key=lambda r: (r[2], r[0])):
        if left == right or shard == right:
            for at in tree.near(value, radius):
                a, b = root(node), root(nodes[at])
                if a != b:
                    parent[max(a, b)] = min(a, b)
        if left == right or shard == left:
            tree.add(value)
            nodes.append(node)
    return [(node, low) for node, _, _ in own if (low := root(node)) != node]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) whose components are those of all links between ``nodes`` (node, fingerprint), both unique."""
    bands = F.explode(F.array(*[
        F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fingerprint", s).bitwiseAND((1 << w) - 1).alias("value"))
        for k, (s, w) in enumerate(_bands(radius))])).alias("at")
    rows = nodes.select("node", "fingerprint", bands).select("node", "fingerprint", "at.band", "at.value")
    return _tree_links(rows, "band", radius)


def _tree_links(rows: DataFrame, table: str, radius: int) -> DataFrame:
    """Edges (a, b) that connect what ``radius`` links in each shard (``table``, value) of ``rows`` (node, fingerprint)."""
    dealt = common.split_hot(rows, [table, "value"], "node", SHARD_ROWS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards arrive sorted; one is held at a time."""
        held, own = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(own) > 1:
                found = _forest(own, held[2], held[3], radius)
                if found:
                    yield pa.RecordBatch.from_pydict({"a": [a for a, _ in found], "b": [b for _, b in found]})

        for batch in batches:
            for band, value, left, right, shard, node, bits in zip(*(c.to_pylist() for c in batch.columns)):
                if held != (key := (band, value, left, right)):
                    yield from done()
                    held, own = key, []
                own.append((node, bits & (2**64 - 1), shard))
        yield from done()

    key = [table, "value", "left", "right"]
    return (dealt.select(*key, "shard", "node", "fingerprint").repartition(*key).sortWithinPartitions(*key)
            .mapInArrow(search, "a long, b long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS,
                    words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: ``key``, ``fingerprint`` (long), ``component_id``, ``class`` and ``mark``.

    ``component_id`` is the smallest key reachable by links of at most ``radius``
    differing bits; ``class`` names the same group by its smallest fingerprint, and
    ``mark`` is a hash of the text. Null and empty texts have fingerprint zero and
    link like any other; repeated rows come back as often; an empty table gives no
    rows; a null key takes part in links and is never the smallest unless a group
    has no other (then ``component_id`` is null). Other columns, whatever their
    names, are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("body"), F.xxhash64(text).alias("mark"))
    found = store(fingerprints(rows, "body", words).drop("body"), "fingerprints")
    nodes = store(found.groupBy("fingerprint").agg(F.min("key").alias("least")), "nodes")
    merged = common.components(links(nodes.select(F.col("fingerprint").alias("node"), "fingerprint"), radius))
    classes = merged.withColumnRenamed("node", "fingerprint").join(nodes, "fingerprint").groupBy("component").agg(
        F.min("least").alias("component_id"))
    linked = merged.withColumnRenamed("node", "fingerprint").join(classes, "component")
    own = nodes.join(linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component", "fingerprint").alias("class"))
    return found.join(own, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id", "class", "mark")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their near-duplicate groups.

    Of a group the row with the smallest key stays, one with a key before one
    without, then the one with the smallest hash of its text; of repeated rows one.
    """
    found = near_duplicates(docs, key, text, radius, words)
    # One row per group, after combining on the map side.
    return _rows_of(docs, found.groupBy("class").agg(_first(key)), key, text)


def _first(key: str) -> Column:
    """Of rows with ``key`` and ``mark``: the smallest key, one with a key before one without, then the smallest mark."""
    return F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "mark")).alias("first")


def _rows_of(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` that ``first`` of ``chosen`` names; of repeated rows one."""
    chosen = chosen.select(
        F.coalesce("first.key", F.lit(-(2**63))).alias("kept key"), F.col("first.mark").alias("kept mark"))
    named = docs.withColumns({"kept key": F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))), "kept mark": F.xxhash64(text)})
    names = ["kept key", "kept mark"]
    return named.join(chosen, names, "left_semi").dropDuplicates(names).drop(*names)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its word shingles (fewer words: the whole sequence; none: empty)."""
    data, offsets = common.utf8(column)
    data = LOWER[data]
    starts, ends = word_bounds(data, offsets, NOT_SPACE)
    own = mix(word_hashes(data, starts, ends))
    first = np.searchsorted(starts, offsets)
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        width = min(words, high - low)
        total = np.full(high - low - width + 1 if width else 0, width, np.uint64)
        for k in range(width):
            total = mix(total + own[low + k:high - width + 1 + k])
        yield np.unique(total)


def _least(shingles: np.ndarray) -> list[int]:
    """The least hash of a set under each of ``DRAWS`` orders; none of an empty set."""
    orders = np.arange(1, DRAWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [int(signed(mix(shingles ^ o).min(keepdims=True))[0]) for o in orders] if len(shingles) else []


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """Of ``rows`` (key, mark, body): (key, mark, node, fingerprint, least), ``node`` a hash of the shingle set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            nodes, prints, least = [], [], []
            for own in shingle_sets(batch.column(2), words):
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                prints.append(majority(own))
                least.append(_least(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(signed(np.array(nodes, np.uint64))),
                 pa.array(signed(np.array(prints, np.uint64))), pa.array(least, pa.list_(pa.int64()))],
                ["key", "mark", "node", "fingerprint", "least"])

    return rows.mapInArrow(sketch, "key long, mark long, node long, fingerprint long, least array<long>")


class Alike:
    """Tells for a group of sets, sorted arrays each, which have a Jaccard similarity of ``SIMILARITY`` or more."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        every, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.sets = np.split(at, np.cumsum(self.sizes)[:-1])
        self.own = np.zeros(len(every), bool)

    def among(self, one: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that are like ``one``, all counted at once; sets are not empty."""
        top, bottom = SIMILARITY
        n, sizes = self.sizes[one], self.sizes[others]
        able = np.minimum(n, sizes) * bottom >= np.maximum(n, sizes) * top
        others, sizes = others[able], sizes[able]
        if not len(others):
            return others
        self.own[self.sets[one]] = True
        hits = self.own[np.concatenate([self.sets[k] for k in others.tolist()])]
        self.own[self.sets[one]] = False
        both = np.add.reduceat(hits, np.cumsum(sizes) - sizes, dtype=np.int64)
        return others[both * bottom >= (n + sizes - both) * top]


def _similar_forest(own: list[tuple[int, int, int, np.ndarray]], left: int, right: int) -> list[tuple[int, int]]:
    """As :func:`_forest`, of (node, value, shard, set); a pair that the tree finds is a link if the sets are alike."""
    own = sorted(own, key=lambda r: (r[2], r[0]))
    alike, values = Alike([r[3] for r in own]), np.array([r[1] for r in own], np.uint64)
    parent = list(range(len(own)))

    def root(x: int) -> int:
        while (up := parent[x]) != x:
            parent[x] = up = parent[up]
            x = up
        return x

    tree, held = Tree(), []
    for i, (_, value, shard, _) in enumerate(own):
        if left == right or shard == right:
            near = np.array([held[at] for at in tree.near(value, WIDE_RADIUS)], np.int64)
            near = near[np.argsort(np.bitwise_count(values[near] ^ values[i]), kind="stable")]
            # The nearest first, then more and more: who is linked to a whole group needs no other comparison with it.
            some = 1
            while len(near):
                for k in alike.among(i, near[:some]).tolist():
                    a, b = root(i), root(k)
                    parent[max(a, b)] = min(a, b)
                near, mine, some = near[some:], root(i), 4 * some
                near = near[np.fromiter((root(k) != mine for k in near.tolist()), bool, len(near))]
        if left == right or shard == left:
            tree.add(value)
            held.append(i)
    # The least node of each tree of the forest, as edges run from a node to a smaller one.
    least: dict[int, int] = {}
    for i, r in enumerate(own):
        least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return [(r[0], low) for i, r in enumerate(own) if (low := least[root(i)]) != r[0]]


def _verified(sets: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the alike ones of each group of ``sets`` (component, node, fingerprint, size, shingles)."""
    key = ["component", "left", "right"]
    dealt = common.split_hot(sets, ["component"], "node", GROUP_SHINGLES, "size")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.grouped((b for batch in batches for b in common.slices([batch])), len(key)):
            own = [(node, bits & (2**64 - 1), shard, np.frombuffer(own, np.uint64)) for shard, node, bits, own in zip(
                *(part.column(c).to_pylist() for c in ("shard", "node", "fingerprint", "shingles")))]
            found = _similar_forest(own, part.column("left")[0].as_py(), part.column("right")[0].as_py())
            if found:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in found], "b": [b for _, b in found]})

    return (dealt.select(*key, "shard", "node", "fingerprint", "shingles").repartition(*key).sortWithinPartitions(*key)
            .mapInArrow(search, "a long, b long"))


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SIMILAR_WORDS) -> DataFrame:
    """The distinct shingle sets of ``docs``: ``node``, ``class`` and ``first``.

    Two texts are linked if their sets of word shingles have a Jaccard similarity of
    ``SIMILARITY`` or more; ``class`` names what links connect. Fingerprints here are of the
    distinct shingles, as the similarity is. ``first`` is the struct (none, key, mark) of
    the set's row with the smallest key, ``mark`` a hash of its text. Null and empty texts and those
    without words share the empty set, which is like itself alone; repeated rows
    share theirs; a null key comes after all others; an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("body"))
    nodes = store(_sketches(rows, words).groupBy("node").agg(
        _first("key"), F.first("fingerprint").alias("fingerprint"), F.first("least").alias("least")), "sets")
    dealt = nodes.select("node", "fingerprint", F.posexplode("least").alias("draw", "value"))
    loose = common.components(_tree_links(dealt, "draw", WIDE_RADIUS))

    # The sets of grouped texts only, made again from one row of each.
    wanted = store(loose.join(nodes, "node").select(
        "component", "node", "fingerprint", F.col("first.key").alias("k"), F.col("first.mark").alias("m")), "grouped")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            own = list(shingle_sets(batch.column(3), words))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())],
                ["component", "node", "fingerprint", "size", "shingles"])

    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m"))
    sets = rows.join(wanted, same).select("component", "node", "fingerprint", "body").mapInArrow(
        expand, "component long, node long, fingerprint long, size long, shingles binary").dropDuplicates(["node"])
    merged = common.components(_verified(store(sets, "shingles")))
    return nodes.join(merged, "node", "left").select("node", F.coalesce("component", "node").alias("class"), "first")


def keep_one_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SIMILAR_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their groups of :func:`similar` texts; chosen
    as :func:`keep_one` does."""
    return _rows_of(docs, similar(docs, key, text, words).groupBy("class").agg(F.min("first").alias("first")), key, text)

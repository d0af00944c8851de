"""Toxicity: a factorization machine over hashed terms.

A text is the set of its words and of their leading four and five bytes (which catch
inflected forms), hashed into ``BUCKETS``. The machine adds a weight per term and an
interaction per pair of terms, the product of their latent vectors, so that two terms
together can say what neither says alone. Interactions are scaled by the number of known
terms, weights aren't, so one strong word counts the same in a long text.

It is fitted on at most ``SAMPLE_ROWS`` labelled texts of each class, drawn by a hash of
the key. Terms take part when they are in ``LEAST_TEXTS`` of them and their share of toxic
texts is off by more than chance allows (``SIGNIFICANT`` standard deviations), or when they
are among the ``FREQUENT`` most frequent ones, which leaves the machine to find pairs of
terms that say nothing alone. A score is a probability among texts mixed like the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm import common
from tidemark.llm.hashing import word_bounds, word_hashes
from tidemark.session import store

#: Bound on the labelled texts of one class that the fit sees.
SAMPLE_ROWS = 3000
LEAST_TEXTS = 5
SIGNIFICANT = 3.5
FREQUENT = 400
BUCKETS = 1 << 22
FACTORS = 6
EPOCHS = 12
RATE = 0.1
THRESHOLD = 0.7

_PREFIXES = (4, 5)
_LETTERS = np.zeros(256, bool)
_LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) of a batch of texts, sorted by row."""
    data, offsets = common.utf8(pc.utf8_lower(column.cast(pa.large_string())))
    starts, ends = word_bounds(data, offsets, _LETTERS)
    row = np.searchsorted(offsets, starts, side="right") - 1
    found = [row.astype(np.uint64) << np.uint64(22) | word_hashes(data, starts, ends) >> np.uint64(42)]
    for n in _PREFIXES:
        long = np.flatnonzero(ends - starts >= n)
        cut = word_hashes(data, starts[long], starts[long] + n) * np.uint64(2 * n + 1)
        found.append(row[long].astype(np.uint64) << np.uint64(22) | cut >> np.uint64(42))
    keys = np.unique(np.concatenate(found))
    return (keys >> np.uint64(22)).astype(np.int64), (keys & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Machine:
    """Buckets in order with their weights and latent vectors."""

    buckets: np.ndarray
    weights: np.ndarray
    latent: np.ndarray
    bias: float

    def logits(self, row: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
        """For known terms ``at`` (positions in ``buckets``) of each row, sorted by row."""
        out = np.full(rows, self.bias)
        if len(row):
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            own, n = row[first], np.diff(np.concatenate((first, [len(row)])))
            latent = self.latent[at]
            sums = np.add.reduceat(latent, first, axis=0)
            alone = np.add.reduceat((latent ** 2).sum(1), first)
            out[own] += np.add.reduceat(self.weights[at], first) + ((sums ** 2).sum(1) - alone) / (2 * n)
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        row, bucket = terms(column)
        if not len(self.buckets):
            return np.full(len(column), 1 / (1 + np.exp(-self.bias)))
        at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        known = self.buckets[at] == bucket
        logits = self.logits(row[known], at[known], len(column))
        return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))


def informative(texts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """The buckets that take part in the fit, in order."""
    if not texts:
        return np.empty(0, np.int64)
    every, which, seen = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    hits = np.bincount(which, np.repeat(toxic, [len(t) for t in texts]), len(every))
    share = toxic.mean()
    off = np.abs(hits - share * seen) / np.sqrt(seen * share * (1 - share) + 1)
    common = np.zeros(len(every), bool)
    common[np.argsort(-seen, kind="stable")[:FREQUENT]] = True
    return every[(seen >= LEAST_TEXTS) & (common | (off >= SIGNIFICANT))]


def train(texts: list[np.ndarray], toxic: np.ndarray, share: float, seed: int = 5) -> Machine:
    """Fit by AdaGrad on logistic loss; ``share`` of toxic texts is the score where no term takes part."""
    toxic = np.asarray(toxic, np.float64)
    buckets = informative(texts, toxic)
    rng = np.random.default_rng(seed)
    machine = Machine(buckets, np.zeros(len(buckets)), rng.normal(0, 0.05, (len(buckets), FACTORS)), 0.0)
    odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    if len(buckets) and 0 < toxic.mean() < 1:
        known = []
        for t in texts:
            at = np.minimum(np.searchsorted(buckets, t), len(buckets) - 1)
            known.append(at[buckets[at] == t])
        _descend(machine, known, toxic, rng)
    if not len(buckets):
        machine.bias = odds
    return machine


def _descend(machine: Machine, known: list[np.ndarray], toxic: np.ndarray, rng: np.random.Generator) -> None:
    weights, latent = machine.weights, machine.latent
    past_w, past_v, past_b = np.full(len(weights), 1e-6), np.full(latent.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(known))
        for low in range(0, len(order), 128):
            own = order[low:low + 128]
            sizes = np.array([len(known[i]) for i in own])
            at, row = np.concatenate([known[i] for i in own]), np.repeat(np.arange(len(own)), sizes)
            miss = 1 / (1 + np.exp(-np.clip(machine.logits(row, at, len(own)), -50, 50))) - toxic[own]
            past_b += miss.mean() ** 2
            machine.bias -= 0.1 * miss.mean() / np.sqrt(past_b)
            if not len(at):
                continue
            terms_, inverse = np.unique(at, return_inverse=True)
            sums = np.zeros((len(own), FACTORS))
            np.add.at(sums, row, latent[at])
            slope = np.bincount(inverse, miss[row]) / len(own) + 1e-4 * weights[terms_]
            past_w[terms_] += slope ** 2
            weights[terms_] -= RATE * slope / np.sqrt(past_w[terms_])
            pull = (miss / np.maximum(sizes, 1))[row]
            for f in range(FACTORS):
                slope = np.bincount(inverse, pull * (sums[row, f] - latent[at, f])) / len(own) + 1e-4 * latent[terms_, f]
                past_v[terms_, f] += slope ** 2
                latent[terms_, f] -= 0.05 * slope / np.sqrt(past_v[terms_, f])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
        sample: int = SAMPLE_ROWS) -> Machine:
    """Fit on at most ``sample`` labelled keys, and as many rows, of each class. Null labels, null texts and keys without a text teach
    nothing; without rows of both classes every text scores the share of toxic labels (half without any)."""
    known = labels.select(F.col(key), F.col(toxic).cast("int").alias("toxic")).filter("toxic IN (0, 1)")
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    # The labels are drawn first, so the texts are joined with a sample of bounded size.
    drawn = common.draw(known, key, "toxic", sample).withColumnRenamed("by", "toxic")
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("body")).filter("body IS NOT NULL").join(
        F.broadcast(drawn), "key").select("key", "toxic", "body")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            row, bucket = terms(batch.column(2))
            parts = np.split(bucket.astype(np.uint32), np.searchsorted(row, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(1), pa.array([p.tobytes() for p in parts], pa.binary())],
                ["key", "toxic", "terms"])

    # A key may have any number of rows: equal ones are folded, and rows are ranked by a hash and not only keys.
    rows = store(chosen.mapInArrow(gather, "key string, toxic int, terms binary"), "toxicity").withColumn(
        "mark", F.xxhash64("terms")).dropDuplicates(["key", "toxic", "mark"])
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("key"), "key", "mark")
    got = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample).drop("n").orderBy(
        F.xxhash64("key"), "key", "toxic", "mark").toArrow()
    texts = [np.frombuffer(t, np.uint32).astype(np.int64) for t in got.column("terms").to_pylist()]
    total = sum(counts.values())
    return train(texts, got.column("toxic").to_numpy(), counts.get(1, 0) / total if total else 0.5)


def score(text: Column, machine: Machine) -> Column:
    """Probability of toxicity, 0 to 1. A null or empty text has no terms and scores the prior."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return common.by_slice(lambda part: pa.array(machine.score(part), pa.float64()), texts)

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, train_on: Column, key: str = "doc_id", text: str = "text",
             toxic: str = "toxic", name: str = "toxicity") -> DataFrame:
    """``docs`` with the score ``name``, learned from the labels for which ``train_on``, a condition on the key, holds.

    A key labelled both ways teaches both; labels of unknown keys teach nothing;
    equal texts score equally; an empty table stays empty. A column called
    ``name`` is replaced.
    """
    return docs.withColumn(name, score(F.col(text), fit(docs, labels.filter(train_on), key, text, toxic)))

"""Language identification with error-correcting output codes.

Every language has a binary codeword. For each bit a naive-Bayes classifier over hashed
byte n-grams tells the languages whose codeword has a one there from the others. A text's
margins, one per bit, are compared with all codewords by a loss that weighs each bit by how
often its classifier was right on that language (loss-weighted decoding); the codeword with
the least loss wins, and a text about as close to a second codeword is flagged ambiguous.

The classifiers are fitted on at most ``SAMPLE_ROWS`` labelled texts of each language; the
counts are summed by Spark, and what reaches the driver is ``BUCKETS`` numbers a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import common
from tidemark.session import store

#: Bound on the labelled texts of one language that the classifiers see.
SAMPLE_ROWS = 1500
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: Evidence (log odds) at which a bit's margin reaches tanh(1).
EVIDENCE = 12.0
#: Difference of normalised loss below which two codewords are too close to call.
AMBIGUITY = 0.05
UNKNOWN = "und"

_PIECE = 1 << 19
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """(languages, bits) of -1 and 1. Few languages get every distinct split, many a random code of wide distance."""
    if languages <= 5:
        bits = max(1, 2 ** (languages - 1) - 1)
        return np.array([[1 if lang == 0 or not (bit >> (lang - 1)) & 1 else -1 for bit in range(1, bits + 1)]
                         for lang in range(languages)], np.int8)
    rng, size = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages)))
    tries = [rng.choice(np.array([-1, 1], np.int8), (languages, size)) for _ in range(64)]
    return max(tries, key=lambda m: min((m[i] != m[j]).sum() for i in range(languages) for j in range(i)))


def normal(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of each text with single spaces for the rest: bytes and row offsets."""
    data, offsets = common.utf8(pc.utf8_lower(column.cast(pa.large_string())))
    data = _LETTERS[data]
    blank = data == 32
    keep = ~(blank & np.concatenate(([False], blank[:-1]))) if len(data) else np.zeros(0, bool)
    kept = np.concatenate(([0], np.cumsum(keep)))
    return data[keep], kept[offsets]


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of (row, bucket) of all n-grams; an n-gram lies in one row."""
    end = np.repeat(offsets[1:], np.diff(offsets))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for low in range(0, len(data), _PIECE):
        high = min(len(data), low + _PIECE)
        held = np.zeros(high - low + max(ORDERS), np.uint32)
        own = data[low:high + max(ORDERS)]
        held[:len(own)] = own
        value = np.zeros(high - low, np.uint32)
        for n in range(1, max(ORDERS) + 1):
            value = (value << np.uint32(8)) | held[n - 1:n - 1 + high - low]
            if n in ORDERS:
                inside = np.arange(low, high) + n <= end[low:high]
                bucket = ((value ^ np.uint32(0x51ED27 * n)) * np.uint32(0x9E3779B1)) >> np.uint32(16)
                yield row[low:high][inside], bucket[inside]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, column: pa.Array) -> np.ndarray:
        """(rows, bits): each bit's evidence squashed into -1..1."""
        data, offsets = normal(column)
        total = np.zeros((len(column), self.code.shape[1]))
        for row, bucket in grams(data, offsets):
            if len(row):
                first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                total[row[first]] += np.add.reduceat(self.weights[bucket], first, axis=0)
        return np.tanh(total / EVIDENCE)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's number, score and whether a second one is about as near."""
        loss = (1 - margins[:, None, :] * self.code[None]) / 2
        far = (loss * self.trust[None]).sum(2) / self.trust.sum(1)
        best = far.argmin(1)
        low = far[np.arange(len(far)), best]
        if len(self.languages) == 1:
            return best, 1 - low, np.zeros(len(far), bool)
        second = np.partition(far, 1, axis=1)[:, 1]
        return best, np.clip(1 - low, 0, 1), second - low < AMBIGUITY


def has_letter(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_ROWS) -> Model | None:
    """Fit on at most ``sample`` rows of each language, dealt by a hash of ``key``; None without labelled text."""
    # The draw ranks keys alone; texts are read for the drawn keys, which the sample bounds.
    drawn = common.draw(rows.filter(F.col(text).isNotNull()), key, lang, sample)
    labelled = rows.select(F.col(key).alias("key"), F.col(lang).alias("by"), F.col(text).alias("body"))
    chosen = store(labelled.join(F.broadcast(drawn), ["key", "by"], "left_semi").filter(has_letter(F.col("body"))).select(
        F.col("by").alias("lang"), "body"), "langid")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in common.slices(batches):
            langs = np.array(batch.column(0).to_pylist(), object)
            data, offsets = normal(batch.column(1))
            for row, bucket in grams(data, offsets):
                for name in set(langs[np.unique(row)].tolist()):
                    sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    sums[name] += np.bincount(bucket[langs[row] == name], minlength=BUCKETS)
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([name] * len(at), pa.string()), "bucket": at.astype(np.int32), "n": counts[at]})

    counts = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy(
        "lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    if not languages:
        return None
    number = {name: i for i, name in enumerate(languages)}
    table = np.zeros((len(languages), BUCKETS))
    table[[number[x] for x in counts.column("lang").to_pylist()], counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    share = (table + 0.1) / (table + 0.1).sum(1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        ones, rest = share[code[:, bit] > 0], share[code[:, bit] < 0]
        if len(ones) and len(rest):
            weights[:, bit] = np.log(ones.mean(0) / rest.mean(0))
    model = Model(languages, code, weights, np.ones(code.shape))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            at = np.array([number[x] for x in batch.column(0).to_pylist()])
            right = (model.margins(batch.column(1)) * model.code[at] > 0).astype(np.int64)
            for i in np.unique(at):
                yield pa.RecordBatch.from_pydict({
                    "lang": np.full(code.shape[1], i, np.int32), "bit": np.arange(code.shape[1], dtype=np.int32),
                    "right": right[at == i].sum(0), "n": np.full(code.shape[1], (at == i).sum(), np.int64)})

    judged = chosen.mapInArrow(judge, "lang int, bit int, right long, n long").groupBy("lang", "bit").agg(
        F.sum("right").alias("right"), F.sum("n").alias("n"))
    for r in judged.collect():  # languages times bits
        model.trust[r.lang, r.bit] = (r.right + 1) / (r.n + 2)
    return model


PREDICTION = "struct<lang:string,score:double,ambiguous:boolean>"
_PREDICTION_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def predict(text: Column, model: Model | None) -> Column:
    """Struct of ``lang`` (``und`` for null and for texts without a letter), ``score`` in 0..1 and ``ambiguous``."""
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    if model is None:
        return unknown
    names = np.array(model.languages, object)

    def decoded(texts: pa.Array) -> pa.Array:
        best, score, close = model.decode(model.margins(texts))
        return pa.StructArray.from_arrays(
            [pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(close)], fields=list(_PREDICTION_ARROW))

    @F.arrow_udf(PREDICTION)
    def scored(texts: pa.Array) -> pa.Array:
        return common.by_slice(decoded, texts)

    return F.when(has_letter(text), scored(text)).otherwise(unknown)


def identify(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
             name: str = "language") -> DataFrame:
    """``docs`` with the prediction struct ``name``, fitted on the rows for which ``train`` holds.

    Null texts and texts without a letter are ``und``, score 0; so is everything if
    no labelled text is left to learn from. Repeated rows get equal predictions,
    ties go to the first language by name, an empty table stays empty. A column
    called ``name`` is replaced.
    """
    return docs.withColumn(name, predict(F.col(text), fit(docs.filter(train), key, text, lang)))

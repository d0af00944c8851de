import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import MESSY
from tidemark.llm import alignment
from tidemark.llm.perfect import PerfectHash

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (20, "a <|endoftext|> b"), (21, "a▁b"), (22, " leading  and   inner \t\r\n\x00 spaces "), (23, "ﬁ é 　 \xa0 ½"),
    (24, "<s> <unk> </s> <0x41>"), (25, "don't we'll  3²\n\n\n漢字かな"), (26, " "), (27, " \u0085"),
]


def reference(rows):
    """The same by the tokenizers' own calls, byte by byte."""
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    alphabet = {chr(b): b for b in printable} | {
        chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}

    def piece(i):
        got = pieces.id_to_piece(i)
        return bytes([int(got[3:-1], 16)]) if pieces.is_byte(i) else got.replace("▁", " ").encode()

    linked, out = [], []
    for key, text in rows:
        a, b = [], []
        if text:
            a = [(i, bytes(alphabet[c] for c in own.id_to_token(i))) for i in own.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, piece(i)) for i in pieces.encode(text)]
            if not b"".join(t for _, t in a) == b"".join(t for _, t in b) == (" " + text).encode():
                a, b = [], []
        a_ends, b_ends = ({int(e): i for (i, _), e in zip(side, np.cumsum([len(t) for _, t in side]))} for side in (a, b))
        both = sorted(a_ends.keys() & b_ends.keys())
        groups, low = [], 0
        for end in both:
            groups.append("|".join(",".join(str(i) for e, i in ends.items() if low < e <= end) for ends in (a_ends, b_ends)))
            low = end
        linked.append([(a_ends[e], b_ends[e]) for e in both])
        out.append((key, len(a), len(b), ";".join(groups)))
    counts = Counter(pair for row in linked for pair in row)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(key, n_a, n_b, text, [(*p, counts[p], counts[p] == best[p[1]]) for p in row]) for (key, n_a, n_b, text), row in zip(out, linked)]


def summed(row):
    key, n_a, n_b, text, links = row
    digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
    return key, n_a, n_b, len(links), len(links), sum(x[3] for x in links), sum(x[2] for x in links), digest


def test_query_rows(documents, texts):
    got = alignment.align(documents, A, B, summary=True).collect()
    assert sorted(map(tuple, got)) == sorted(map(summed, reference(texts)))


def test_messy_rows(spark, messy, empty):
    rows = MESSY + ODD
    extra = spark.createDataFrame([(k, t, "a", "b", 1, 2, 3.0) for k, t in ODD], messy.schema)
    docs = messy.union(extra).withColumnRenamed("row", "pairs").withColumnRenamed("copy", "links")
    want = reference(rows)
    got = alignment.align(docs, A, B, summary=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(summed, want), key=str)
    groups = alignment.align(docs, A, B).collect()
    assert sorted(((r.doc_id, r.groups, [tuple(x) for x in r.links]) for r in groups), key=str) == sorted(
        ((key, text, links) for key, _, _, text, links in want), key=str)
    assert alignment.align(empty, A, B, summary=True).count() == 0
    assert alignment.align(messy.filter("doc_id = 3"), A, B, summary=True).first()[1:] == (0, 0, 0, 0, 0, 0, "")


def test_parts_of_a_long_row_join(monkeypatch, texts):
    words = alignment.vocabularies(A, B)
    import pyarrow as pa

    both = [words.encode(t) for _, t in texts[:20]]
    found = alignment.Aligned.of(*(pa.array([x[s].tobytes() for x in both], pa.binary()) for s in (0, 1)), words)
    whole = [b"".join(found.written(i)) for i in range(20)]
    monkeypatch.setattr(alignment, "_WRITTEN", 7)
    assert [b"".join(found.written(i)) for i in range(20)] == whole


def test_pairs_are_bounded_by_the_vocabularies(texts):
    words = alignment.vocabularies(A, B)
    assert alignment.most_pairs([b"ab", b"b"], [b"b", b"cab"]) == 4  # ab-b, b-b, ab-cab, b-cab
    assert alignment.most_pairs(words.a, words.b) < 1_000_000


def test_perfect_hash():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 63, 1000, 200_000):
        keys = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        hashed = PerfectHash(keys)
        assert np.array_equal(np.sort(hashed.slots(keys)), np.arange(len(keys)))
        other = hashed.slots(rng.integers(-(2**63), 2**63 - 1, 1000))
        assert ((other >= -1) & (other < max(len(keys), 1))).all()

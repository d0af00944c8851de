import hashlib
import re

from tests.llm.conftest import MESSY
from tidemark.llm import pii
from tidemark.llm.catalog import QUERIES


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    text = text or ""
    out = {}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
                 if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
                   if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def listed(kinds):
    return ",".join(f"{k}:{a}:{b}" for k, spans in kinds.items() for a, b in spans)


TRICKY = [
    "mail a@b.c_x@d.e.f, .%+-@x.y and a@b a@b. a@b.c. @no.where x@y..z a.b@c-d.e-", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 9.9.9.9999",
    "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111  1111 1111 1111 4111111111111111 5 12 41111111111111111 4111 1111 1111 1111-",
    "+1 (555) 010-9999 +49 30 123456 ++12345678 +1 2 +123456789012345678 +44.20.7946.0958.",
    "é漢\U0001f600 é@x.yz a\U0001f600b@c.de  12 41111111 1111 1111 1111", "1 " * 9000, "a@b" + ".c" * 9000, "+" * 9000 + "1" * 9000,
    "9" * 20000, "x" * 40000 + "@", "0.0.0.0 255.255.255.255 300.300.300.300 0000000255.1.1.1",
]


def test_base_spans(spark, texts):
    rows = list(enumerate(TRICKY)) + [(100 + k, t) for k, t in MESSY if k] + [(1000 + k, t) for k, t in texts]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.base, r.md) for r in got.selectExpr("doc_id", "base", "mark AS md").collect()}
    for key, text in rows:
        want = brute(text)
        assert {k: [(s.start, s.end) for s in got[key][0][k]] for k in want} == want, text[:100]


def test_query_digest(spark, sf, texts):
    got = {r.doc_id: r for r in QUERIES["op9_pii"](spark, sf).collect()}
    for key, text in texts:
        want, r = brute(text), got[key]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(v) for v in want.values())
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("term:")] == [s for s in listed(want).split(",") if s]


def test_messy_rows(messy, empty):
    assert sorted((r.doc_id for r in pii.find(messy).collect()), key=str) == sorted((k for k, _ in MESSY), key=str)
    assert pii.find(empty).count() == 0
    assert pii.sanitise(empty).count() == 0


def test_a_word_that_gives_an_entity_away_is_masked(spark):
    # "zorblax" is seen only beside one address; "call" is seen everywhere.
    rows = [(i, f"call zorblax at joe{1}@mail.example now, number {i}") for i in range(4)]
    rows += [(10 + i, "call the office now, number " + "abc"[i % 3]) for i in range(30)]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].sanitised == "call  at [EMAIL] now, number 0"
    assert got[10].sanitised == rows[4][1]
    assert [(t.start, t.end) for t in got[0].terms] == [(5, 12)]


def test_rare_pairs_say_nothing(spark):
    rows = [(i, f"unique{i}word near u{i}@mail.example") for i in range(5)]
    assert all(not r.terms for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_entities_of_one_document_are_disclosed_too(spark):
    # Every address has a document and a word of its own.
    names = ["".join(chr(97 + i // 26 ** k % 26) for k in range(4)) for i in range(40)]
    rows = [(i, f"call zor{name} at {name}@mail.example now") for i, name in enumerate(names)]
    rows += [(100 + i, "call the office at noon, not now") for i in range(40)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for key, text in rows:
        assert [(t.start, t.end) for t in got[key].terms] == ([(5, 12)] if key < 100 else []), text


def test_a_word_far_away_is_masked_in_every_document(spark):
    far = "and then the caller went on for a good while about nothing at all before "
    rows = [(i, f"mail joe@mail.example {far} Zorblax, nothing") for i in range(4)]
    rows += [(9, f"nothing {far} mail zorblax")] + [(10 + i, f"nothing {far} mail") for i in range(195)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for key, text in rows:
        at = text.lower().find("zorblax")
        assert [(t.start, t.end) for t in got[key].terms] == ([(at, at + 7)] if at >= 0 else []), text


def test_disclosing_words_against_brute_force(spark, documents, texts):
    import math

    words = [{w.lower() for w in re.findall(r"[^\W\d_]{3,}", t or "")} for _, t in texts]
    own = [{t[a:b] for k, spans in brute(t).items() for a, b in spans} for _, t in texts]
    n_term, n_entity, n_both = {}, {}, {}
    for ws, es in zip(words, own):
        for w in ws:
            n_term[w] = n_term.get(w, 0) + 1
        for e in es:
            n_entity[e] = n_entity.get(e, 0) + 1
            for w in ws:
                n_both[w, e] = n_both.get((w, e), 0) + 1
    named = set()
    for (w, e), n in n_both.items():
        bits = math.log2(len(texts) * n / (n_term[w] * n_entity[e]))
        chance = math.exp(n * (1 - 2 ** -bits - bits * math.log(2))) if bits > 0 else 1
        if bits * (1 - chance) >= 0.8 * math.log2(len(texts) / n_entity[e]) > 0:
            named.add(w)
    got = {r.doc_id: [(t.start, t.end) for t in r.terms] for r in pii.find(documents).collect()}
    for key, text in texts:
        masked = [s for spans in brute(text).values() for s in spans]
        want = [m.span() for m in re.finditer(r"[^\W\d_]{3,}", text or "") if m[0].lower() in named]
        assert got[key] == [(a, b) for a, b in want if not any(a < d and c < b for c, d in masked)]
    assert sum(map(len, got.values())) > 0

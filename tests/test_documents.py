import datetime as dt
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import markup, replies
from tidemark.operators import labelled, renderings
from tidemark.sources import cases
from tidemark.session import scratch


def text_of(spark, html):
    return spark.createDataFrame([(html,)], "html string").select(markup.html_to_text(F.col("html"))).first()[0]


@pytest.mark.parametrize("html, text", [
    ("<table><tr><td>27,300</td><td>19,100</td></tr><tr><td>x</td></tr></table>", "27,300 19,100\n\nx"),
    ("<p>a</p><script>1,234</script><style>p{}</style>b", "a\nb"),
    ("<div style='display: NONE'><div>hidden</div>still</div>seen", "seen"),
    ("<ix:header><ix:hidden>99</ix:hidden></ix:header>ok &amp; fine&nbsp; now", "ok & fine now"),
    ("a<br/>b<br>c", "a\nb\nc"),
    ("a < b and <p>unclosed", "a < b and\nunclosed"),
    ("<p>a</p><p></p><p></p><p>b</p>", "a\n\nb"),
    ("", ""),
])
def test_html_to_text(spark, html, text):
    assert text_of(spark, html) == text


def test_null_markup(spark):
    assert text_of(spark, None) is None


def find(spark, text, value, field=""):
    df = spark.createDataFrame([(1, text, float(value), field)], "id int, text string, value double, field string")
    got = renderings.find_renderings(df, ["id"]).collect()
    return (got[0]["token"], got[0]["scale"], got[0]["start"], got[0]["end"]) if got else None


@pytest.mark.parametrize("text, value, token, scale", [
    ("Revenue was 27,300 thousand", 27_300_000, "27,300", "thousands"),
    ("Revenue was 27,300,000 flat", 27_300_000, "27,300,000", "units"),
    ("Revenue 27300000 and 27,300", 27_300_000, "27300000", "units"),
    ("total 1,234.50 end", 1234.5, "1,234.50", "units"),
    ("in millions 668.9 here", 668_900_000, "668.9", "millions"),
])
def test_renderings(spark, text, value, token, scale):
    got = find(spark, text, value)
    assert got == (token, scale, text.index(token), text.index(token) + len(token))


@pytest.mark.parametrize("text, value", [
    ("27,300,456", 27_300), ("1,27,300", 27_300), ("27,300.5", 27_300), ("127,300", 27_300),  # part of another number
    ("loss of (415)", 415), ("gain of 415", -415), ("-  415", 415),  # wrong sign
    ("it was 27.3 million", 27_349_000),  # rounded, not exact
    ("5 and 12", 5), ("nothing", 1234),
])
def test_no_rendering(spark, text, value):
    assert find(spark, text, value) is None


@pytest.mark.parametrize("text", ["a loss of (415) now", "a loss of $(415)", "change -415", "change − $ 415"])
def test_negative_values(spark, text):
    assert find(spark, text, -415)[0] == "415"


def test_context_then_first(spark):
    filler = "x" * 6000
    text = f"4,321 {filler} net income per share 4,321 {filler} 4,321"
    assert find(spark, text, 4321, "net income")[2] == text.index("share 4,321") + 6
    assert find(spark, text, 4321)[2] == 0


def test_occurrences_past_any_count_are_considered(spark):
    text = " ".join(["4,321"] * 200) + "x" * 6000 + " net income 4,321"
    assert find(spark, text, 4321, "net income")[2] == text.rindex("4,321")


def test_the_work_grows_with_the_numbers_and_not_their_square(spark):
    n = 100_000
    text = " ".join(f"({1000 + i})" if i % 3 == 0 else f"{1000 + i:,}" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "doc int, text string")
    values = spark.range(0, n, 997).selectExpr("1 AS doc", "id", "CAST(IF(id % 3 = 0, -1000 - id, 1000 + id) AS DOUBLE) AS value", "'' AS field")
    began = time.perf_counter()
    got = {r["id"]: (r["token"], r["start"], r["end"]) for r in renderings.locate(values, docs, ["id"], ["doc"]).collect()}
    took = time.perf_counter() - began
    spots = [m.span() for m in re.finditer(r"[0-9,]+", text)]
    assert got == {i: (text[slice(*spots[i])], *spots[i]) for i in range(0, n, 997)}
    assert took < 30  # seconds; two or three alone on a machine


def test_a_text_is_read_once_for_all_its_values(spark):
    docs = spark.createDataFrame([("a", "sales 5,412 and (777) or 5,412"), ("b", "5412"), ("unasked", "5,412")], "doc string, text string")
    values = spark.createDataFrame(
        [(1, "a", 5412.0, ""), (2, "a", -777.0, ""), (3, "a", 777.0, ""), (4, "b", 5412.0, ""), (5, "c", 5412.0, ""), (6, "b", None, "")],
        "id int, doc string, value double, field string")
    found = renderings.locate(values, docs, ["id"], ["doc"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == plan.count("Generate posexplode") == 1
    assert {(r["id"], r["token"], r["start"]) for r in found.collect()} == {(1, "5,412", 6), (2, "777", 17), (4, "5412", 0)}


def test_excerpt(spark):
    rnd = random.Random(4)

    def brute(text, start, end, limit):
        if len(text) <= limit:
            return text.strip()
        low = max(0, min(start - limit // 2, len(text) - limit))
        high = min(len(text), low + limit)
        if low > 0:
            at = text.find("\n", low, min(start, low + 200))
            low = low if at < 0 else at + 1
        if high < len(text):
            at = text.rfind("\n", max(end, high - 200), high)
            high = high if at < 0 else at
        return text[low:high].strip()

    data = []
    for _ in range(300):
        n = rnd.randint(1, 2000)
        text = "".join(rnd.choice("abcdefgh é\n" if rnd.random() < 0.1 else "abcdefgh") for _ in range(n))
        start = rnd.randint(0, n - 1)
        data.append((text, start, min(n, start + 5)))
    df = spark.createDataFrame(data, "text string, s int, e int")
    got = [r[0] for r in df.select(renderings.excerpt(F.col("text"), F.col("s"), F.col("e"), 600)).collect()]
    assert got == [brute(*row, 600) for row in data]


def test_resolving_candidates(spark):
    pad = "x " * 1500
    docs = spark.createDataFrame(
        [("d1", f"net sales 5,412 {pad}"), ("d2", f"5,412 and 6,000 {pad}"), ("d3", f"nothing {pad}"), ("d4", "5,412"), ("d6", " \n"), ("d7", None)],
        "doc_key string, text string")
    cands = spark.createDataFrame([(f"c{i}", f"d{i}", "revenue", [5412.0, 6000.0]) for i in range(1, 8)],
                                  "case_id string, doc_key string, field string, values array<double>")
    resolved = renderings.resolve_values(cands, docs)
    got = {r["case_id"]: (r["expected"], r["reason"]) for r in resolved.collect()}
    # However short a text is, it is searched.
    assert got == {"c1": (5412.0, None), "c2": (None, "ambiguous_xbrl_value"), "c3": (None, "no_rendering_in_text"), "c4": (5412.0, None),
                   "c5": (None, "fetch_failed"), "c6": (None, "empty_document"), "c7": (None, "empty_document")}
    counts = {r["reason"]: r["n"] for r in renderings.skip_counts(renderings.with_excerpts(resolved, docs)).collect()}
    assert counts == {"ambiguous_xbrl_value": 1, "no_rendering_in_text": 1, "fetch_failed": 1, "empty_document": 2}


def test_every_candidate_is_a_case_or_has_one_reason(spark):
    docs = spark.createDataFrame([("d1", "sales 5,412 up"), ("d2", "x " * 50 + "5,412 y" + " z" * 50)], "doc_key string, text string")
    cands = spark.createDataFrame([("c1", "d1", "revenue", [5412.0]), ("c2", "d2", "revenue", [5412.0]), ("c3", "d3", "revenue", [1.0])],
                                  "case_id string, doc_key string, field string, values array<double>")
    closed = renderings.with_excerpts(renderings.resolve_values(cands, docs), docs, max_chars=3)
    assert {r["case_id"]: r["reason"] for r in closed.collect()} == {"c1": "excerpt_lost_figure", "c2": "excerpt_lost_figure", "c3": "fetch_failed"}
    kept = renderings.case_excerpts(renderings.resolve_values(cands, docs), docs, max_chars=40)
    assert {r["case_id"] for r in kept.collect()} == {"c1", "c2"}


def test_numbers_beyond_exact_doubles_and_short_ones(spark):
    assert find(spark, "id 12345678901234567890 end", 12345678901234567890) is None
    assert find(spark, "5 and 12", 12) is None
    df = spark.createDataFrame([(1, "5 and 12", 12.0, "")], "id int, text string, value double, field string")
    assert renderings.find_renderings(df, ["id"], min_digits=2).first()["token"] == "12"


def test_splits(spark):
    ids = [f"case-{i}" for i in range(50)]
    df = spark.createDataFrame([(i,) for i in ids], "case_id string")
    got = [r[0] for r in df.select(replies.split_of(F.col("case_id"))).collect()]
    assert got == [("dev", "holdout")[zlib.crc32(i.encode()) % 2] for i in ids]


@pytest.mark.parametrize("prediction, expected, ok", [
    ("5000000.4", "5000000", True), ("5001000", "5000000", False), ("0", "0.0", True), ("1e-8", "0", False), (" Acme ", "acme", True),
    ("nan", "nan", True), ("nan", "5", False), (None, "5", False), ("5e6", "5000000", True), ("1d", "1", False), ("9" * 400, "9" * 400, True),
])
def test_answer_match(spark, prediction, expected, ok):
    df = spark.createDataFrame([(prediction, expected)], "p string, e string")
    assert replies.match_answers(df, "p", "e").first()["correct"] is ok


@pytest.mark.parametrize("text, value", [
    ("$668,857,000", 668857000.0), ("(415)", -415.0), ("-(415)", -415.0), ("(-$415)", -415.0), ("5e6", 5e6), (" .5 ", 0.5), ("( $ 1,000 )", -1000.0),
    ("((7))", -7.0), ("the answer is 5", None), ("415)", None), ("(415", None), ("", None), ("nan", None), ("1.2.3", None), ("4 15", None),
    ("- - 3", -3.0), ("12 million", None), ("5.", 5.0), ("()", None), ("$", None),
])
def test_bare_numbers(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert replies.bare_numbers(df, "t", "n").first()["n"] == value


@pytest.mark.parametrize("reply, prediction, fallback, error", [
    ('{"value": 5}', "5", False, None), ('{"value": "a b"}', "a b", False, None), ("668857000", "6.68857E8", True, None),
    ("(415)", "-415.0", True, None), ('{"k": 1}', None, False, "no value key"), ("[1]", None, False, "no value key"),
    ("prose", None, False, "not JSON"), (None, None, False, "no content"), ('{"value": null}', "None", False, None),
])
def test_replies(spark, reply, prediction, fallback, error):
    df = spark.createDataFrame([(reply,)], "reply string")
    row = replies.parse_replies(df).first()
    assert (row["prediction"], row["fallback"], row["error"]) == (prediction, fallback, error)


def test_scores_count_silence_as_wrong(spark):
    known = spark.createDataFrame([("a", "dev", "1"), ("b", "dev", "2"), ("c", "dev", "3")], "case_id string, split string, expected string")
    preds = spark.createDataFrame([("m", "a", "1.0"), ("m", "b", "9")], "model string, case_id string, prediction string")
    got = {(r["model"], r["split"]): (r["n"], r["correct"], r["accuracy"]) for r in labelled.score_predictions(known, preds).collect()}
    assert got == {("m", "dev"): (3, 1, pytest.approx(1 / 3)), ("m", "holdout"): (0, 0, 0.0)}


def test_content_label(spark):
    import hashlib

    df = spark.createDataFrame([(" known ",), ("other",)], "t string")
    got = [r[0] for r in df.select(replies.content_label(F.col("t"), {"known": "v1"})).collect()]
    assert got == ["v1", "sha256:" + hashlib.sha256(b"other").hexdigest()[:12]]


def test_cases(spark, rows, tmp_path):
    def make(*data):
        return cases.new_cases(spark.createDataFrame(list(data), "case_id string, doc_text string, field string, expected string"))

    table = cases.upsert_cases(make(("a", "t", "revenue", "5.0"), ("b", "", "revenue", "6")), make(("a", "t2", "revenue", "7")))
    assert rows(table, "case_id", "expected") == [("a", "7"), ("b", "6")]
    assert cases.read_cases(table, "dev").count() + cases.read_cases(table, "holdout").count() == 2
    with pytest.raises(ValueError):
        cases.read_cases(table, "Dev")
    with pytest.raises(Exception, match="may not be blank"):
        make((" ", "t", "revenue", "1")).collect()
    path = scratch(spark, "manifest")
    cases.write_manifest(table.select("case_id", "expected"), path)
    assert [r["case_id"] for r in spark.read.option("header", True).csv(path).collect()] == ["a", "b"]


def test_field_candidates(spark):
    schema = ("cik long, taxonomy string, tag string, unit string, start date, end date, val double, accn string, fy long, form string, filed date")
    q3, last = (dt.date(2020, 7, 1), dt.date(2020, 9, 30)), (dt.date(2019, 7, 1), dt.date(2019, 9, 30))
    filed = dt.date(2020, 11, 1)

    def row(tag, span, val, fy=2020, tax="us-gaap", unit="USD", accn="a"):
        return (1, tax, tag, unit, *span, float(val), accn, fy, "10-Q", dt.date(1999, 1, 1))

    first, second = labelled.REVENUE_TAGS
    data = [
        row(first, q3, 100), row(second, q3, 110), row(first, last, 90), row(first, (dt.date(2020, 1, 1), q3[1]), 300),  # ytd
        row("NetIncomeLoss", q3, 7), row("NetIncomeLoss", q3, 7), row("NetIncomeLoss", last, 5, accn="b"),  # only a comparative
        row(labelled.SHARES_TAG, (None, dt.date(2020, 10, 20)), 1000, tax="dei", unit="shares"), row(first, q3, 1, unit="EUR"),
        row(first, q3, 5, fy=2014, accn="c")]
    filings = spark.createDataFrame([(1, a, "10-Q", filed, "x.htm") for a in "abc"], "cik long, accn string, form string, filed date, primary_doc string")
    got = {(r["accn"], r["field"]): r["values"] for r in labelled.field_candidates(spark.createDataFrame(data, schema), filings).collect()}
    assert got == {("a", "revenue"): [100.0, 110.0], ("a", "net income"): [7.0], ("a", "shares outstanding"): [1000.0]}
    assert labelled.eligible_filings(filings).count() == 3


def test_sample_respects_its_caps(spark):
    data = [(i % 40, f"a{i}", labelled.FIELDS[i % 3], ("10-K", "10-Q")[i % 2], 2015 + i % 11) for i in range(2000)]
    df = spark.createDataFrame(data, "cik int, accn string, field string, form string, fy int")
    one = [tuple(r) for r in labelled.stratified_sample(df, 30, 1).collect()]
    assert one == [tuple(r) for r in labelled.stratified_sample(df.orderBy(F.rand(3)), 30, 1).collect()]
    assert one != [tuple(r) for r in labelled.stratified_sample(df, 30, 2).collect()]
    assert 0 < len(one) <= 30
    for key, cap in (((0,), 2), ((0, 1), 1), ((2,), 10), ((2, 3), 5), ((4,), 5)):
        groups = [tuple(r[i] for i in key) for r in one]
        assert max(groups.count(g) for g in groups) <= cap


def test_document_url(spark):
    df = spark.createDataFrame([(320193, "0000320193-20-000010", "a.htm")], "cik long, accn string, doc string")
    url = df.select(labelled.document_url(F.col("cik"), F.col("accn"), F.col("doc"))).first()[0]
    assert re.fullmatch(r"https://.*/320193/000032019320000010/a\.htm", url)


def test_predictions_survive_a_failing_model(spark, rows):
    df = cases.new_cases(spark.createDataFrame(
        [("a", "5", "revenue", "5.0"), ("b", "boom", "revenue", "5"), ("c", "", "revenue", "x")],
        "case_id string, doc_text string, field string, expected string"))

    def predict(text, field):
        if text == "boom":
            raise RuntimeError("no")
        return float(text) if text else None

    got = labelled.predict_cases(df, "m", predict)
    assert rows(got, "case_id", "prediction", "error") == [("a", "5.0", None), ("b", None, "RuntimeError: no"), ("c", None, None)]
    total = labelled.score_predictions(df, got).agg({"n": "sum", "correct": "sum"}).first()
    assert sorted(total) == [1, 3]

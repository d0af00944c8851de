"""Queries over documents, replies and labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import markup, replies
from tidemark.functions.values import number
from tidemark.operators import labelled, renderings
from tidemark.plans import standins
from tidemark.plans.registry import FACTS_Q, R, query, rounded
from tidemark.session import scratch
from tidemark.sources import cases


_BLOCKS = "|".join(sorted(markup.BREAKS, key=len, reverse=True))


def _replaced(expression: str, *steps: tuple[str, str]) -> str:
    for pattern, replacement in steps:
        expression = f"regexp_replace({expression}, '{pattern}', {replacement}, 'g')"
    return expression


# Scripts and styles stand only inside the head. The hidden elements that the query adds
# leave no trace, so the twin reads the pages as they are.
_UNSEEN = ('<div class="x" style="color:red; Display : none">a<div>b</div><br>c</div>'
           "<ix:header>7<ix:hidden>8</ix:hidden><p>9</ix:header>")
_TEXT = _replaced(
    "html", ("(?is)<head[ >].*?</head>", "''"), ("(?s)<!.*?>", "''"), ("(?i)</?(td|th)( [^>]*)?/?>", "' '"),
    (f"(?i)</?({_BLOCKS})( [^>]*)?/?>", "chr(10)"), ("<[a-zA-Z/][^>]*>", "''"))
_UNESCAPED = _replaced(_TEXT, ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&quot;", "chr(34)"), ("&amp;?", "'&'"))
_CLEAN = _replaced(_UNESCAPED, ("[ \\t\\f\\v\u00a0\u2000-\u200b]+", "' '"), (" *\\n *", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"), ("^\\s+|\\s+$", "''"))


@query(f"SELECT page_id, url, {_CLEAN} AS text FROM pages")
def html_text(spark, sf_dir):
    pages = standins.table(spark, sf_dir, "pages").withColumn("html", F.replace(F.col("html"), F.lit("</p>"), F.lit(_UNSEEN + "</p>")))
    return pages.select("page_id", "url", markup.html_to_text(F.col("html")).alias("text"))


def _printed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of digits in a document as a value to find again.

    By document, the run is the value itself, its thousands or its millions, the
    value is negative, or has a decimal; fields take turns too.
    """
    d = standins.table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), 0))
    kind, n = F.col("doc_id") % 6, F.col("digits").cast("double")
    value = F.when(kind == 1, n * 1000).when(kind == 2, n * 1000000).when(kind == 3, -n).when(kind == 4, n / 10).otherwise(n)
    turn = (F.col("doc_id") % 4).cast("int")
    names = F.array(F.lit("revenue"), F.lit("net income"), F.lit("shares outstanding"), F.lit("other"))
    return d.withColumn("digits", F.explode(runs)).withColumn("value", value).withColumn("field", F.element_at(names, turn + 1))


def _keyword_score(window: str) -> str:
    cases = [f"WHEN '{field}' THEN " + " + ".join(f"contains({window}, '{w}')::INTEGER" for w in words)
             for field, words in renderings.KEYWORDS.items()]
    return f"(CASE field {' '.join(cases)} ELSE 0 END)"


# All numbers of a text with their places, from the pieces between them; then the forms of each value by equality.
_SPOTS = """numbers AS (
  SELECT doc_id, text, unnest(range(1, len(nums) + 1)) AS i, nums, pieces FROM (
    SELECT doc_id, text, regexp_extract_all(text, '[0-9]+(?:[,.][0-9]+)*') AS nums,
           regexp_split_to_array(text, '[0-9]+(?:[,.][0-9]+)*') AS pieces FROM documents)),
spots AS (
  SELECT doc_id, text, nums[i] AS token,
         CAST(sum(length(pieces[i])) OVER w + sum(length(nums[i])) OVER w - length(nums[i]) AS INTEGER) AS start
  FROM numbers WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
signed AS (
  SELECT doc_id, token, start, text,
         regexp_matches(rtrim(substring(text, greatest(0, start - 6) + 1, start - greatest(0, start - 6)), ' 	 $*'), '[(\\-−]$') AS negative
  FROM spots)"""


def _forms(source: str) -> str:
    """CTE ``forms``: (keys of ``source``, ord, scale, token) for every exact form of ``value``."""
    rows, order = [], 0
    for scale, unit in renderings.SCALES.items():
        for places in renderings.PLACES:
            scaled = f"(abs(value) / {unit:.1f})"
            rounded = f"round_even({scaled}, {places})"
            grouped = f"format('{{:,.{places}f}}', {rounded})"
            for token in (grouped, f"replace({grouped}, ',', '')"):
                rows.append(f"SELECT *, {order} AS ord, '{scale}' AS scale, {token} AS token FROM {source} "
                            f"WHERE abs({rounded} - {scaled}) <= {scaled} * 1e-12 + 1e-9 AND abs(value) < 9007199254740992")
                order += 1
    return f"forms AS (SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE length(regexp_replace(token, '[^0-9]', '', 'g')) >= 3)"


def _found(values: str) -> str:
    """CTE ``found``: the best occurrence of every (doc_id, digits) of a CTE of values."""
    window = "lower(substring(text, greatest(0, start - 2500) + 1, start + 2500 - greatest(0, start - 2500)))"
    return f"""{_forms(values)},
hits AS (SELECT f.doc_id, f.digits, f.value, f.field, f.ord, f.scale, f.token, s.start, {_keyword_score(window)} AS score
         FROM forms f JOIN signed s ON f.doc_id = s.doc_id AND f.token = s.token AND s.negative = (f.value < 0)),
found AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, digits ORDER BY ord, score DESC, start) = 1)"""


_RUNS = "runs AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS digits FROM documents)"
_VALUES = """vals AS (
  SELECT doc_id, digits, CASE doc_id % 6 WHEN 1 THEN n * 1000 WHEN 2 THEN n * 1000000 WHEN 3 THEN -n WHEN 4 THEN n / 10 ELSE n END AS value,
         ['revenue', 'net income', 'shares outstanding', 'other'][doc_id % 4 + 1] AS field
  FROM (SELECT *, CAST(digits AS DOUBLE) AS n FROM runs))"""


@query(f"""WITH {_RUNS}, {_VALUES}, {_SPOTS}, {_found('vals')}
SELECT doc_id, digits, token, scale, start, CAST(start + length(token) AS INTEGER) AS "end" FROM found""")
def number_renderings(spark, sf_dir):
    documents = standins.table(spark, sf_dir, "documents").select("doc_id", "text")
    return renderings.locate(_printed_numbers(spark, sf_dir).drop("text"), documents, ["doc_id", "digits"], ["doc_id"])


_EXCERPT = 400


def _excerpt_sql(source: str) -> str:
    """CTE ``cut`` with the excerpt around [s, e) of each row of a CTE with doc_id, text, n, s, e."""
    return f"""w AS (SELECT *, greatest(0, least(s - {_EXCERPT // 2}, n - {_EXCERPT})) AS low FROM {source}),
x AS (SELECT *, least(n, low + {_EXCERPT}) AS high FROM w),
y AS (SELECT *, instr(substring(text, low + 1, least(s, low + 200) - low), chr(10)) AS first_break,
             substring(text, greatest(e, high - 200) + 1, high - greatest(e, high - 200)) AS tail FROM x),
z AS (SELECT * REPLACE (CASE WHEN low > 0 AND first_break > 0 THEN low + first_break ELSE low END AS low,
             CASE WHEN high < n AND contains(tail, chr(10)) THEN high - instr(reverse(tail), chr(10)) ELSE high END AS high) FROM y),
cut AS (SELECT *, regexp_replace(CASE WHEN n <= {_EXCERPT} THEN text ELSE substring(text, low + 1, high - low) END,
                                 '^\\s+|\\s+$', '', 'g') AS excerpt FROM z)"""


# The numbers of a document as rival values of one case; equal numbers are one value.
_RESOLVED = f"""{_RUNS},
rivals AS (SELECT doc_id, CAST(n AS VARCHAR) AS digits, n AS value, 'revenue' AS field
           FROM (SELECT DISTINCT doc_id, CAST(digits AS DOUBLE) AS n FROM runs)),
{_SPOTS}, {_found('rivals')},
docs AS (SELECT DISTINCT doc_id FROM runs),
counted AS (SELECT doc_id, count(*) AS n, min(value) AS expected, arg_min(token, value) AS token, arg_min(scale, value) AS scale,
                   arg_min(start, value) AS start FROM found GROUP BY 1),
resolved AS (
  SELECT doc_id, c.*, d.text, CASE WHEN NOT regexp_matches(d.text, '\\S') THEN 'empty_document' WHEN coalesce(c.n, 0) = 0 THEN 'no_rendering_in_text'
                          WHEN c.n > 1 THEN 'ambiguous_xbrl_value' END AS reason
  FROM docs JOIN documents d USING (doc_id) LEFT JOIN counted c USING (doc_id)),
c AS (SELECT doc_id, text, length(text) AS n, start AS s, start + length(token) AS e, token, scale, expected FROM resolved WHERE reason IS NULL),
{_excerpt_sql('c')},
closed AS (SELECT doc_id, reason FROM resolved WHERE reason IS NOT NULL
           UNION ALL SELECT doc_id, CASE WHEN NOT contains(excerpt, token) THEN 'excerpt_lost_figure' END FROM cut)"""


@query(f"""WITH {_RESOLVED}
SELECT 'case-' || doc_id AS case_id, doc_id AS doc_key, 'revenue' AS field, CASE WHEN reason IS NULL THEN expected END AS expected,
       CASE WHEN reason IS NULL THEN token END AS token, CASE WHEN reason IS NULL THEN scale END AS scale,
       CASE WHEN reason IS NULL THEN start END AS start, CASE WHEN reason IS NULL THEN CAST(start + length(token) AS INTEGER) END AS "end", reason FROM resolved""")
def resolved_cases(spark, sf_dir):
    """Documents with their numbers as rival candidate values."""
    found = _printed_numbers(spark, sf_dir).withColumn("value", F.col("digits").cast("double"))
    candidates = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("value")).alias("values")).select(
        F.concat(F.lit("case-"), F.col("doc_id")).alias("case_id"), F.col("doc_id").alias("doc_key"),
        F.lit("revenue").alias("field"), "values")
    return renderings.resolve_values(candidates, _documents(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), "text")


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renderings.with_excerpts(resolved_cases(spark, sf_dir), _documents(spark, sf_dir), _EXCERPT)


@query(f"WITH {_RESOLVED} SELECT reason, count(*) AS n FROM closed WHERE reason IS NOT NULL GROUP BY 1")
def skip_counts(spark, sf_dir):
    return renderings.skip_counts(_closed(spark, sf_dir))


@query(f"""WITH c AS (
  SELECT doc_id, text, length(text) AS n, length(text) // 2 AS s, least(length(text) // 2 + 9, length(text)) AS e FROM documents),
{_excerpt_sql('c')}
SELECT doc_id, sha256(excerpt) AS digest FROM cut""")
def excerpts(spark, sf_dir):
    d = standins.table(spark, sf_dir, "documents")
    n = F.length("text")
    start = F.floor(n / 2).cast("int")
    cut = renderings.excerpt(F.col("text"), start, F.least(start + 9, n), _EXCERPT)
    return d.select("doc_id", F.sha2(F.encode(cut, "UTF-8"), 256).alias("digest"))


@query(f"""WITH {_RESOLVED}
SELECT 'case-' || doc_id AS case_id, excerpt AS doc_text, 'revenue' AS field, expected, scale FROM cut WHERE contains(excerpt, token)""")
def seeded_cases(spark, sf_dir):
    return renderings.case_excerpts(resolved_cases(spark, sf_dir), _documents(spark, sf_dir), _EXCERPT).drop("doc_key")


# CRC-32 bit by bit: each byte enters as itself followed by seven zero steps.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(id, '')])),
  lambda acc, x: xor(xor(acc, x) >> 1, 3988292384 * (xor(acc, x) & 1))), 4294967295::BIGINT)"""


@query(f"""WITH c AS (SELECT doc_id, 'case-' || doc_id AS id FROM documents)
SELECT doc_id, CASE WHEN {_CRC} % 2 = 0 THEN 'dev' ELSE 'holdout' END AS split FROM c""")
def case_splits(spark, sf_dir):
    d = standins.table(spark, sf_dir, "documents")
    return d.select("doc_id", replies.split_of(F.concat(F.lit("case-"), F.col("doc_id"))).alias("split"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model replies in eight shapes; the model is the event type."""
    v = F.col("value")
    text = F.format_string("%.2f", v)
    shape = F.col("event_id") % 8
    reply = (
        F.when(shape == 0, F.concat(F.lit('{"value": '), text, F.lit("}")))
        .when(shape == 1, F.concat(F.lit("$"), F.format_number(v * 1000, 2)))
        .when(shape == 2, F.concat(F.lit(" ("), text, F.lit(") ")))
        .when(shape == 3, F.concat(F.lit("-($ "), text, F.lit(")")))
        .when(shape == 4, F.concat(F.lit("the answer is "), text))
        .when(shape == 5, F.col("props"))
        .when(shape == 6, text)
        .otherwise(F.concat(F.lit('{"value": "'), F.upper("event_type"), F.lit(' "}')))
    )
    return standins.table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("model"), reply.alias("reply"), text.alias("text"),
        F.when(shape == 7, F.col("event_type")).when(shape == 2, F.concat(F.lit("-"), text)).otherwise(text).alias("expected"))


_V = "CAST(round(value, 2) AS DOUBLE)"


@query(f"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN {R('value', 2)} WHEN 1 THEN {R('value * 1000', 2)} WHEN 2 THEN {R('-value', 2)}
         WHEN 3 THEN {R('-value', 2)} WHEN 6 THEN {R('value', 2)} END AS answer,
       CASE WHEN event_id % 8 = 7 THEN upper(event_type) || ' ' END AS words,
       event_id % 8 IN (1, 2, 3, 6) AS fallback,
       CASE event_id % 8 WHEN 4 THEN 'not JSON' WHEN 5 THEN 'no value key' END AS error FROM events""")
def reply_normalise(spark, sf_dir):
    parsed = replies.parse_replies(_replies(spark, sf_dir))
    value = number(F.col("prediction"))
    return parsed.select("event_id", (F.round(value, 2) + 0.0).alias("answer"),
                         F.when(value.isNull(), F.col("prediction")).alias("words"), "fallback", "error")


@query("""SELECT event_type AS model, count(*) AS n, count(*) FILTER (event_id % 8 IN (1, 2, 3, 6)) AS parsed_fallback,
       count(*) FILTER (event_id % 8 IN (4, 5)) AS errors, min(CASE event_id % 8 WHEN 4 THEN 'not JSON' WHEN 5 THEN 'no value key' END) AS first_error
FROM events GROUP BY 1""")
def reply_diagnostics(spark, sf_dir):
    return labelled.reply_diagnostics(replies.parse_replies(_replies(spark, sf_dir)))


@query("""WITH cases AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'holdout' ELSE 'dev' END AS split FROM events),
sizes AS (SELECT split, count(*) AS n FROM cases GROUP BY 1),
models AS (SELECT DISTINCT event_type AS model FROM events UNION ALL SELECT 'silent'),
good AS (SELECT event_type AS model, split, count(*) AS correct FROM events JOIN cases USING (event_id)
         WHERE event_id % 8 IN (0, 2, 6, 7) OR (value = 0 AND event_id % 8 IN (1, 3)) GROUP BY 1, 2)
SELECT m.model, s.split, s.n, coalesce(g.correct, 0) AS correct, coalesce(g.correct, 0) / s.n AS accuracy
FROM models m CROSS JOIN sizes s LEFT JOIN good g ON g.model = m.model AND g.split = s.split""")
def answer_match_score(spark, sf_dir):
    r = _replies(spark, sf_dir).withColumn("case_id", F.col("event_id").cast("string"))
    split = F.when(F.col("event_id") % 3 == 0, "holdout").otherwise("dev")
    known = r.select("case_id", "expected", split.alias("split"))
    predictions = replies.parse_replies(r.select("model", "case_id", "reply")).select("model", "case_id", "prediction")
    silent = spark.createDataFrame([("silent",)], "model string")
    return labelled.score_predictions(known, predictions, silent)


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'english' ELSE 'sha256:' || substring(sha256(trim(lang)), 1, 12) END AS lang_label,
       'sha256:' || substring(sha256(trim(text, ' ')), 1, 12) AS text_label FROM documents""")
def content_labels(spark, sf_dir):
    d = standins.table(spark, sf_dir, "documents")
    return d.select("doc_id", replies.content_label(F.col("lang"), {"en": "english"}).alias("lang_label"),
                    replies.content_label(F.col("text"), {}).alias("text_label"))


@query("""WITH m AS (SELECT lang AS field, source AS form, n_chars % 7 AS fy, CASE WHEN n_chars > 1000 THEN 'thousands' ELSE 'units' END AS u FROM documents)
SELECT 'field' AS grouping, field, NULL AS form, NULL AS fy, NULL AS units_in_excerpt, count(*) AS n FROM m GROUP BY field
UNION ALL SELECT 'form', NULL, form, NULL, NULL, count(*) FROM m GROUP BY form
UNION ALL SELECT 'field x form', field, form, NULL, NULL, count(*) FROM m GROUP BY field, form
UNION ALL SELECT 'fiscal year', NULL, NULL, fy, NULL, count(*) FROM m GROUP BY fy
UNION ALL SELECT 'units', NULL, NULL, NULL, u, count(*) FROM m GROUP BY u""")
def coverage_summary(spark, sf_dir):
    d = standins.table(spark, sf_dir, "documents")
    return labelled.coverage(d.select(
        F.col("lang").alias("field"), F.col("source").alias("form"), (F.col("n_chars") % 7).alias("fy"),
        F.when(F.col("n_chars") > 1000, "thousands").otherwise("units").alias("units_in_excerpt")))


@query("""SELECT 'case-' || doc_id AS case_id, text AS doc_text, 'lang' AS field,
       CASE WHEN doc_id % 4 = 0 THEN upper(lang) ELSE lang END AS expected FROM documents WHERE doc_id % 5 <> 1 OR doc_id % 4 = 0""")
def cases_upsert(spark, sf_dir):
    d = standins.table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.concat(F.lit("case-"), F.col("doc_id"), F.lit(" ")).alias("case_id"), F.col("text").alias("doc_text"),
                    F.lit("lang").alias("field"), F.col("lang").alias("expected"))
    stored = cases.new_cases(rows.filter("doc_id % 5 <> 1"))
    incoming = cases.new_cases(rows.filter("doc_id % 4 = 0").withColumn("expected", F.upper("expected")))
    return cases.upsert_cases(stored, incoming).drop("split")


@query("""SELECT 'case-' || doc_id AS case_id, source AS form, CAST(n_chars % 7 AS VARCHAR) AS fy, lang AS field FROM documents""")
def manifest_csv(spark, sf_dir):
    """A manifest written as CSV files in the order of its cases, and read back."""
    d = standins.table(spark, sf_dir, "documents")
    folder = scratch(spark, "manifest")
    cases.write_manifest(d.select(F.concat(F.lit("case-"), F.col("doc_id")).alias("case_id"), F.col("source").alias("form"),
                                  (F.col("n_chars") % 7).alias("fy"), F.col("lang").alias("field")), folder)
    return spark.read.schema("case_id string, form string, fy string, field string").option("header", True).csv(folder)


# A model that answers with the first word and refuses texts without one.
@query("""SELECT 'first word' AS model, 'case-' || doc_id AS case_id,
       CASE WHEN lang <> 'de' THEN nullif(regexp_extract(text, '^[^ ]+'), '') END AS prediction,
       CASE WHEN lang = 'de' THEN 'ValueError: no German' END AS error FROM documents""")
def predicted_cases(spark, sf_dir):
    def first_word(text: str, field: str) -> str | None:
        if field == "de":
            raise ValueError("no German")
        return text.split(" ")[0] or None

    d = standins.table(spark, sf_dir, "documents")
    rows = d.select(F.concat(F.lit("case-"), F.col("doc_id")).alias("case_id"), F.col("text").alias("doc_text"), F.col("lang").alias("field"))
    return labelled.predict_cases(rows, "first word", first_word)


_YEARS = (1995, 2001)

CANDIDATES = f"""{FACTS_Q},
joined AS (
  SELECT cik, accn, tag, val, "end", start, filed, year("end") AS fy,
         CASE WHEN tag IN ('1-URGENT', '2-HIGH') THEN 'revenue' WHEN tag = '3-MEDIUM' THEN 'net income' ELSE 'shares outstanding' END AS field
  FROM facts_q WHERE tag <> '4-NOT SPECIFIED' AND year("end") BETWEEN 1995 AND 2001
    AND (tag = '5-LOW' OR "end" - start BETWEEN 80 AND 100)),
latest AS (SELECT * FROM joined QUALIFY "end" = max("end") OVER (PARTITION BY cik, accn, field)),
candidates AS (
  SELECT cik, accn, field, list_sort(list(DISTINCT val)) AS vals, CAST(min(fy) AS BIGINT) AS fy, '10-Q' AS form, min(filed) AS filed
  FROM latest GROUP BY 1, 2, 3)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = standins.facts_quarterly(spark, sf_dir)
    shares = F.col("tag") == "5-LOW"
    rows = f.withColumn("taxonomy", F.when(shares, "dei").otherwise(F.col("taxonomy"))).withColumn(
        "unit", F.when(shares, "shares").otherwise(F.col("unit"))).withColumn("start", F.when(~shares, F.col("start")))
    listed = f.select("cik", "accn", "form", F.date_add("end", 45).alias("filed"), F.lit("d.htm").alias("primary_doc")).distinct()
    return labelled.field_candidates(rows, listed, ("1-URGENT", "2-HIGH"), "3-MEDIUM", "5-LOW", _YEARS)


@query(f"""WITH {CANDIDATES}
SELECT cik, accn, field, array_to_string([CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR) FOR v IN vals], ',') AS vals, form, filed, fy FROM candidates""")
def field_candidates(spark, sf_dir):
    cents = F.transform("values", lambda v: standins.cents(v).cast("string"))
    return candidates(spark, sf_dir).select("cik", "accn", "field", F.array_join(cents, ",").alias("vals"), "form", "filed", "fy")


def _caps(budget: int) -> str:
    per_field = -(-budget // 3)
    steps = [("cik, accn", 1), ("cik", 2), ("fy", -(-budget // 11) + 2), ("field, form", -(-per_field // 2)), ("field", per_field)]
    sql, prior = [], "d0"
    for i, (stratum, cap) in enumerate(steps, 1):
        sql.append(f"d{i} AS (SELECT * FROM {prior} QUALIFY row_number() OVER (PARTITION BY {stratum} ORDER BY draw) <= {cap})")
        prior = f"d{i}"
    return ",\n".join(sql)


@query(f"""WITH {CANDIDATES},
d0 AS (SELECT *, sha256('7:' || cik || ':' || accn || ':' || field) AS draw FROM candidates),
{_caps(60)}
SELECT cik, accn, field, form, fy FROM d5 ORDER BY draw LIMIT 60""")
def stratified_sample(spark, sf_dir):
    return labelled.stratified_sample(candidates(spark, sf_dir), 60, 7).select("cik", "accn", "field", "form", "fy")


@query(f"""WITH {FACTS_Q}
SELECT DISTINCT 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || accn || '/d.htm' AS url FROM facts_q""")
def document_urls(spark, sf_dir):
    f = standins.facts_quarterly(spark, sf_dir).select("cik", "accn").distinct()
    return f.select(labelled.document_url(F.col("cik"), F.col("accn"), F.lit("d.htm")).alias("url")).distinct()

"""One query per text operator, over its whole table and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import alignment, decontaminate, langid, lines, mixing, packing, phrases, pii, simhash, substrings, toxicity, vectors, warc
from tidemark.llm.common import table
from tidemark.llm.registry import query
from tidemark.session import store


@query()
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query(sql=r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, list_aggregate(w[i:i + least(10, len(w)) - 1], 'string_agg', ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
gram AS (
  SELECT r, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT r, n, i, item FROM gram JOIN win USING (n, gram)),
pos AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)""")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window, and the items found."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query()
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document and the words that give it away."""
    found = pii.find(table(spark, sf_dir, "documents"))
    base = {k: F.col(f"base.{k}") for k in pii.KINDS}
    return found.select(
        "doc_id", *[F.size(c).cast("long").alias(f"n_{k}") for k, c in base.items()],
        F.sha2(pii.span_list(base), 256).alias("base_sha256"),
        pii.span_list(base | {pii.TERM: F.col("terms")}).alias("spans"))


def _remainder(key: str, of: int):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of))


@query()
def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a quarter of the documents is never learned from."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False))
    found = langid.identify(docs.select("doc_id", "text", "lang"), ~held_out, name="found")
    return found.select("doc_id", held_out.alias("held_out"), F.col("found.lang").alias("lang_pred"),
                        F.col("found.score").alias("score"), F.col("found.ambiguous").alias("ambiguous"))


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a third of the documents is never learned from."""
    held_out = F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False))
    found = toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"),
                              ~held_out, name="score")
    return found.select("doc_id", held_out.alias("held_out"), "score",
                        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query(sql="""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.r AS a, b.r AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT r, r AS o FROM v UNION SELECT reach.r, link.b FROM reach JOIN link ON reach.o = link.a),
comp AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.o GROUP BY reach.r),
deg AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v LEFT JOIN comp USING (r) LEFT JOIN deg USING (r)""")
def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every vector."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query(sql="""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
first AS (SELECT body, max(page_id) AS response FROM p GROUP BY body),
d AS (SELECT p.page_id, p.body, first.response, sha1(p.body) AS h FROM p JOIN first USING (body))
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
         ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM d""")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a WARC archive and read back."""
    archives = store(warc.write(table(spark, sf_dir, "pages")), "warc")
    sound = F.when(F.col("problem").isNull(), F.col("payload_digest")).otherwise(F.raise_error("problem").cast("string"))
    return warc.read(archives, payloads=False).select(
        "page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(sql="""
WITH line AS (
  SELECT doc_id, text, i - 1 AS line, parts[i] AS raw
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
        FROM documents)),
words AS (
  SELECT doc_id, text, line, raw,
         list_distinct(regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\\x20\\x09-\\x0D]+')) AS w
  FROM line),
own AS (SELECT doc_id, line, list_sort(w) AS w FROM words WHERE len(w) > 0),
sets AS (SELECT row_number() OVER () AS s, w, len(w) AS n, min(doc_id * 1000000 + line) AS at FROM own GROUP BY w),
tok AS (SELECT s, n, unnest(w) AS t FROM sets),
df AS (SELECT t, count(*) AS c FROM tok GROUP BY t),
ranked AS (SELECT s, n, t, row_number() OVER (PARTITION BY s ORDER BY c, t) AS p FROM tok JOIN df USING (t)),
pre AS (SELECT s, n, t FROM ranked WHERE p <= n - ((4 * n + 4) // 5) + 1),
pair AS (SELECT DISTINCT a.s AS a, b.s AS b FROM pre a JOIN pre b USING (t) WHERE a.s < b.s AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
hit AS (
  SELECT a, b, x.at AS xa, y.at AS ya FROM pair JOIN sets x ON x.s = a JOIN sets y ON y.s = b
  WHERE 5 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n - len(list_intersect(x.w, y.w)))),
gone AS (SELECT CASE WHEN xa < ya THEN b ELSE a END AS s FROM hit GROUP BY 1),
out AS (
  SELECT own.doc_id, own.line FROM own JOIN sets USING (w) LEFT JOIN gone USING (s)
  WHERE gone.s IS NOT NULL OR own.doc_id * 1000000 + own.line <> sets.at),
n AS (SELECT doc_id, count(*) AS n_lines FROM own GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n_removed FROM out GROUP BY doc_id),
kept AS (
  SELECT line.doc_id, string_agg(raw, chr(10) ORDER BY line.line) AS body FROM line ANTI JOIN out USING (doc_id, line) GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that an earlier similar line removes."""
    found = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), report="_lines")
    return found.select(
        "doc_id", F.col("_lines.lines").alias("n_lines"), F.size("_lines.removed").cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query(sql="""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS g
  FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS p FROM d)),
later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM win) WHERE n > 1),
step AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM later),
run AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM step),
span AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b, r FROM run GROUP BY doc_id, r),
gap AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y, a FROM span
  UNION ALL SELECT doc_id, max(b), NULL, max(b) FROM span GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(CASE WHEN y IS NULL THEN substr(h, 2 * x + 1) ELSE substr(h, 2 * x + 1, 2 * (y - x)) END, '' ORDER BY a) AS k
  FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat a string of 100 bytes from earlier."""
    found = substrings.dedup(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query(sql=r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS shuffled
  FROM documents),
src AS (
  SELECT source, source_size, 2 * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM doc GROUP BY source)),
weighed AS (SELECT *, CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM src),
leveled AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM weighed),
told AS (SELECT *, cap * weight_left <= (budget - full_before) * weight AS is_full FROM leveled),
goal AS (
  SELECT source, number, source_size, budget, CASE WHEN is_full THEN cap::DOUBLE ELSE
         (budget - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)) / sum(weight) FILTER (WHERE NOT is_full) OVER () * weight
         END AS target
  FROM told),
queued AS (
  SELECT doc.*, goal.* EXCLUDE (source), coalesce(sum(size) OVER (
           PARTITION BY number ORDER BY shuffled, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM doc JOIN goal ON doc.source IS NOT DISTINCT FROM goal.source),
serving AS (
  SELECT *, start + s * source_size AS low, start + s * source_size + size AS high, floor(target)::BIGINT AS met
  FROM queued, (VALUES (0), (1)) AS v(s) WHERE s = 0 OR size > 0),
part AS (
  SELECT r, number, target, budget, low, CASE WHEN met > low AND met < high THEN met ELSE high END AS high FROM serving
  UNION ALL
  SELECT r, number, target, budget, met, high FROM serving WHERE met > low AND met < high),
placed AS (
  SELECT *, high - low AS words, coalesce(sum(high - low) OVER (
           ORDER BY CASE WHEN target > 0 THEN high / target ELSE 0 END, number, high, r, low
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM part),
mixed AS (SELECT r, sum(greatest(0, least(words, floor(budget)::BIGINT - place))) AS taken FROM placed GROUP BY r)
SELECT doc_id, source, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM queued JOIN mixed USING (r)
""")
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of all sources by weights takes."""
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


@query()
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document, with the links' counts over all documents."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), *paths, summary=True)


@query(sql=r"""
WITH piece AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')),
           '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
gram AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS phrase
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, range(1, 5) AS t(k) WHERE len(w) >= k))
  GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM gram WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM gram WHERE k > 1 AND f >= 30),
inside AS (
  SELECT lang, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM cand, range(2, 4) AS t(m) WHERE m < k) GROUP BY ALL),
side AS (
  SELECT lang, phrase, a, cut, list_aggregate(w[1:cut], 'string_agg', ' ') AS lead, list_aggregate(w[cut + 1:], 'string_agg', ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand)),
cut AS (
  SELECT s.lang, s.phrase, s.a, cut, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * s.a) // (x.f + y.f) AS BIGINT) AS score
  FROM side s JOIN gram x ON x.lang = s.lang AND x.phrase = lead JOIN gram y ON y.lang = s.lang AND y.phrase = rest),
weakest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM weakest w LEFT JOIN inside i USING (lang, phrase) WHERE i.most IS NULL OR 100 * i.most < 80 * w.a)
JOIN total USING (lang) WHERE rank <= 2000
""")
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most telling phrases of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))

"""Personal data and what gives it away: information-theoretic sanitisation with built-in functions only.

Base spans are emails, IP addresses, card and phone numbers. Over the whole corpus,
documents are counted per entity e (a base value), per word t and per pair (t and e
anywhere in one document). Pointwise mutual information ``PMI(t; e) = log2(N n(t,e) /
(n(t) n(e)))`` says how many bits t reveals about e, out of ``IC(e) = log2(N / n(e))`` that
e holds. A word that reveals at least ``GENERALISE`` of an entity's information is replaced
by a general term wherever it stands, in documents without the entity too; at ``REMOVE``
and above it is removed. The share ``PMI / IC`` is weighted by the significance of the pair,
one less a Chernoff bound on the chance that words strewn at random meet the entity in
n(t,e) documents or more. The weight is smooth: entities of a single document count, unless
the corpus is so small that a meeting says little.

Everything is a DataFrame expression. A regular expression's matches come from
``regexp_extract_all``, their places from the lengths of the pieces that ``split`` leaves
between them, both of which walk the text as one matcher does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import store

GENERALISE = 0.8
REMOVE = 0.95
#: The most frequent words that disclose nothing, left out before words are joined by themselves; saves work alone.
FREQUENT = 10_000

KINDS = ("email", "ip", "card", "phone")
#: Added by the co-occurrence statistics, after the base kinds.
TERM = "term"

# A run that starts anywhere but at its first character could only repeat a failed try, so
# each pattern starts where no run is under way (or where the last match ended, \G) and never
# backtracks into a run. This keeps the scan linear in texts without white space.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A single space or hyphen between two digits stands as this character (private use), so that a
#: card number is one run of a character class; the character itself is blanked beforehand.
_JOINT = "\ue000"
_CARD = rf"(?<![0-9])[0-9][0-9{_JOINT}]++"
_WORD = r"\p{L}{3,}+"

_SPANS = "array<struct<start:int,end:int,share:double>>"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern that can't be empty: array of (start, end, value), code points, end exclusive."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)
    kind = "array<struct<start:int,end:int,value:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def step(state: Column, pair: Column) -> Column:
        low = state["at"] + pair["gap"]
        high = low + F.length(pair["value"])
        one = F.struct(low.alias("start"), high.alias("end"), pair["value"].alias("value"))
        return F.struct(high.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(values)), values,
                       lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    return F.when(F.size(values) > 0, F.aggregate(pairs, start, step, lambda s: s["found"])).otherwise(
        F.array().cast(kind))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(back, i, F.lit(1))) - 48
        return total + F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the array of (start, end, value) found in ``text`` (not null)."""
    joined = F.regexp_replace(F.translate(text, _JOINT, "x"), r"(?<=[0-9])[\x20-](?=[0-9])", _JOINT)

    def is_card(m: Column) -> Column:
        digits = _digits(m["value"])
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)

    return {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, _EMAIL)).otherwise(matches(F.lit(""), _EMAIL)),
        "ip": F.filter(matches(text, _IP), lambda m: F.rlike(m["value"], F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))),
        "card": F.transform(
            F.filter(matches(joined, _CARD), is_card),
            lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _digits(m["value"]).alias("value"))),
        "phone": F.filter(
            F.when(F.contains(text, F.lit("+")), matches(text, _PHONE)).otherwise(matches(F.lit(""), _PHONE)),
            lambda m: F.length(_digits(m["value"])).between(9, 15)),
    }


def _words(body: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(_WORD), F.lit(0)), F.lower))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row (key, mark of the text, body)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("mark"), body.alias("body"))


def _found(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row (id, key, mark, base spans, entities), and the words of rows with an entity; computed once and stored."""
    spans = _rows(docs, key, text).select(
        "key", "mark", "body", F.struct(*[c.alias(k) for k, c in base_spans(F.col("body")).items()]).alias("base"))

    def named(kind: str) -> Column:
        return F.transform(F.col(f"base.{kind}"), lambda s: F.concat(F.lit(f"{kind}:"), s["value"]))

    entities = F.array_distinct(F.flatten(F.array(*[named(k) for k in KINDS])))
    some = F.greatest(*[F.size(f"base.{k}") for k in KINDS]) > 0
    words = F.when(some, _words(F.col("body"))).otherwise(F.array().cast("array<string>"))
    return store(spans.select(F.monotonically_increasing_id().alias("id"), "key", "mark", "base",
                              entities.alias("entities"), words.alias("words")), "pii")


def significance(n: Column, bits: Column) -> Column:
    """One less the Chernoff bound on ``n`` or more chance meetings where ``n / 2 ** bits`` are expected, 0 to 1."""
    expected = F.pow(F.lit(2.0), -bits)
    return F.when(bits > 0, 1 - F.exp(n * (1 - expected + F.log(expected)))).otherwise(0.0)


def disclosing(found: DataFrame, vocabulary: DataFrame, threshold: float = GENERALISE) -> DataFrame:
    """(term, share): words that reveal at least ``threshold`` of some entity's information, and the largest such share.

    ``vocabulary`` counts the documents of every word (term, n_term).
    """
    total = float(found.count())
    # Entities of the same documents have the same statistics and are counted as one.
    held = found.select("id", F.explode("entities").alias("entity"))
    same = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("of")).alias("same")
    groups = store(held.join(held.groupBy("entity").agg(same), "entity").select("id", "same").distinct(), "entities")
    # The largest n(t) at which a word can reach the threshold: n(t,e) is n(e) at most, the weight one.
    most = F.col("same.n") * F.pow(F.lit(total) / F.col("same.n"), F.lit(1 - threshold)) * (1 + 1e-9)
    reach = groups.groupBy("id").agg(F.max(most).alias("most"))
    beside = found.filter(F.size("entities") > 0).select("id", "words").join(reach, "id").select(
        "most", F.explode("words").alias("term")).groupBy("term").agg(F.max("most").alias("most"))
    rare = store(beside.join(vocabulary, "term").filter(F.col("n_term") <= F.col("most")).select("term", "n_term"), "rare")
    words = _uncommon(found.select("id", F.explode("words").alias("term")), vocabulary, rare)
    pairs = words.join(rare, "term").join(groups, "id").filter(F.col("n_term") <= most).groupBy("same", "term").agg(
        F.count("*").alias("n_both"), F.first("n_term").alias("n_term"))
    bits = F.log2(F.lit(total) * F.col("n_both") / (F.col("n_term") * F.col("same.n")))
    information = F.log2(F.lit(total) / F.col("same.n"))
    share = F.when(information > 0, bits / F.when(information > 0, information)).otherwise(0.0)
    share = share * significance(F.col("n_both"), bits)
    return pairs.select("term", share.alias("share")).filter(F.col("share") >= threshold).groupBy("term").agg(
        F.max("share").alias("share"))


def _uncommon(words: DataFrame, vocabulary: DataFrame, wanted: DataFrame) -> DataFrame:
    """``words`` without the ``FREQUENT`` most frequent ones that aren't ``wanted``; a fixed number is shipped."""
    common = vocabulary.join(wanted.select("term"), "term", "left_anti").orderBy(F.desc("n_term"), "term").limit(FREQUENT)
    return words.join(F.broadcast(common.select("term")), "term", "left_anti")


def _places(body: Column, terms: Column) -> Column:
    """Spans (start, end, share), sorted, of the words of ``body`` that are in ``terms``, an array of (term, share)."""
    values = F.regexp_extract_all(body, F.lit(_WORD), F.lit(0))
    gaps = F.slice(F.transform(F.split(body, _WORD, -1), F.length), F.lit(1), F.size(values))
    named = F.map_from_entries(terms)
    pairs = F.zip_with(gaps, values, lambda gap, value: F.struct(
        gap.alias("gap"), F.length(value).alias("size"), F.element_at(named, F.lower(value)).alias("share")))

    def step(state: Column, pair: Column) -> Column:
        low = state["at"] + pair["gap"]
        high = low + pair["size"]
        one = F.struct(low.alias("start"), high.alias("end"), pair["share"].alias("share"))
        return F.struct(high.alias("at"), F.when(
            pair["share"].isNotNull(), F.concat(state["found"], F.array(one))).otherwise(state["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))
    return F.aggregate(pairs, start, step, lambda s: s["found"])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``mark`` (hash of the text), ``base`` (a struct of arrays by kind) and ``terms``.

    ``terms`` are the spans (start, end, share) of the disclosing words, wherever they
    stand outside base spans, sorted. Null texts count as empty and have no spans; repeated rows come back as
    often, each counted as a document; a null key is a key like any other; an empty
    table gives no rows. Other columns are not read.
    """
    found = _found(docs, key, text)
    rows = _rows(docs, key, text)
    vocabulary = store(rows.select(F.explode(_words(F.col("body"))).alias("term")).groupBy("term").agg(
        F.count("*").alias("n_term")), "vocabulary")
    named = store(disclosing(found, vocabulary), "disclosing")
    # Which documents have which of the words; then their places, from the texts of these documents only.
    words = _uncommon(rows.select("key", "mark", F.explode(_words(F.col("body"))).alias("term")), vocabulary, named)
    hits = words.join(named, "term").groupBy(F.col("key").alias("k"), F.col("mark").alias("m")).agg(
        F.collect_set(F.struct("term", "share")).alias("named"))
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m"))
    spans = rows.join(store(hits, "hits"), same).select("k", "m", _places(F.col("body"), F.col("named")).alias("terms")).groupBy(
        "k", "m").agg(F.first("terms").alias("terms"))
    masked = F.concat(*[F.transform(f"base.{k}", lambda s: F.struct(s["start"], s["end"])) for k in KINDS])
    # A word within a base span is masked with it.
    bare = F.filter("terms", lambda t: ~F.exists(masked, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return found.select("key", "mark", "base").join(spans, same, "left").select(
        F.col("key").alias(key), "mark", "base", F.coalesce(bare, F.array().cast(_SPANS)).alias("terms"))


def span_list(kinds: dict[str, Column]) -> Column:
    """``kind:start:end`` of all spans, by kind as given, then start, comma-joined."""

    def named(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.concat_ws(",", *[named(k, spans) for k, spans in kinds.items()])


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``sanitised`` text and its spans (``base``, ``terms``).

    Base spans become ``[KIND]``. A disclosing word becomes ``[TERM]``, or nothing if
    it reveals nearly all of its entity. Where spans overlap, the first one's
    replacement stands for all of them.
    """
    found = find(docs, key, text).withColumnsRenamed({key: "k", "mark": "m"}).dropDuplicates(["k", "m"])
    kind = "array<struct<start:int,end:int,by:string>>"

    def tagged(name: str) -> Column:
        return F.transform(F.col(f"base.{name}"), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{name.upper()}]").alias("by"))).cast(kind)

    every = F.concat(*[tagged(k) for k in KINDS], F.transform("terms", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.when(s["share"] >= REMOVE, "").otherwise(f"[{TERM.upper()}]").alias("by"))).cast(kind))
    body = F.coalesce(F.col("body"), F.lit(""))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(body, state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, s["by"])).otherwise(state["out"]).alias("out"))

    done = F.aggregate(
        F.sort_array(every), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda s: F.concat(s["out"], F.substring(body, s["at"] + 1, F.length(body))))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body")).withColumn(
        "mark", F.xxhash64(F.coalesce(F.col("body"), F.lit(""))))
    return rows.join(found, F.col("key").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m"))).select(
        F.col("key").alias(key), done.alias("sanitised"), "base", "terms")

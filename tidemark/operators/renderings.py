"""Finding how a document prints a number, and cutting an excerpt around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Fixed values.
SCALES = {"units": 1.0, "thousands": 1e3, "millions": 1e6}
PLACES = (0, 1, 2)
MIN_DIGITS = 3  # default of a parameter: shorter forms match anything
CONTEXT_CHARS = 2500
EXCERPT_CHARS = 6000
SNAP_CHARS = 200
SIGN_CHARS = 6
KEYWORDS = {
    "revenue": ["revenue", "net sales", "total revenue", "statements of operations", "statements of income", "cost of"],
    "net income": ["net income", "net loss", "net earnings", "statements of operations", "per share", "income tax"],
    "shares outstanding": ["shares outstanding", "shares of common stock", "outstanding", "registrant", "par value"],
}


#: Beyond this a double is no exact whole number any more.
EXACT_BELOW = 2.0**53


def scaled_tokens(value: Column, min_digits: int = MIN_DIGITS) -> Column:
    """Every exact way to print a number: array of (order, scale, token).

    Units, thousands, millions; zero to two decimals; grouped, then plain. A
    rounded form is not exact and is left out, as are tokens of fewer than
    ``min_digits`` digits and numbers too large for a double to hold exactly.
    """
    forms, order = [], 0
    for scale, unit in SCALES.items():
        scaled = F.abs(value) / unit
        for places in PLACES:
            rounded = F.bround(scaled, places)
            exact = (F.abs(rounded - scaled) <= F.abs(scaled) * 1e-12 + 1e-9) & (F.abs(value) < EXACT_BELOW)
            grouped = F.format_number(rounded, places)
            for token in (grouped, F.regexp_replace(grouped, ",", "")):
                long_enough = F.length(F.regexp_replace(token, "[^0-9]", "")) >= min_digits
                forms.append(F.when(exact & long_enough, F.struct(
                    F.lit(order).alias("order"), F.lit(scale).alias("scale"), token.alias("token"))))
                order += 1
    return F.filter(F.array(*forms), lambda t: t.isNotNull())


_NUMBER = r"[0-9]++(?:[,.][0-9]++)*+"


def printed_numbers(documents: DataFrame, doc: list[str], text: str = "text") -> DataFrame:
    """Every number that the documents print: ``doc``, token, start (0-based) and negative.

    A number is a run of digits with single commas or points inside, so each one
    stands alone. It is negative behind a minus sign or an opening parenthesis,
    with blanks, a currency sign or an asterisk between. One pass finds the
    numbers and one the pieces between them; a number starts where the lengths of
    all earlier ones end, a running sum, so the work grows with the text and not
    with the square of its numbers. What is summed up is a few bytes a number.
    """
    found = documents.select(
        *doc, F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)).alias("_numbers"), F.split(text, _NUMBER, -1).alias("_pieces"))
    n = F.size("_numbers")
    each = found.select(*doc, F.posexplode(F.arrays_zip(
        F.slice("_pieces", F.lit(1), n).alias("piece"), F.col("_numbers").alias("token"),
        F.slice(F.concat(F.array(F.lit("")), "_numbers"), F.lit(1), n).alias("last"))).alias("_i", "_n"))
    # What stands before: the piece, or a number and a short piece.
    before = F.right(F.concat(F.right("_n.last", F.lit(SIGN_CHARS)), F.col("_n.piece")), F.lit(SIGN_CHARS))
    negative = F.regexp_replace(before, "[ \\t\\u00A0$*]+$", "").rlike("[(\\-\\u2212]$")
    placed = each.select(*doc, "_i", F.length("_n.piece").alias("_gap"), F.col("_n.token").alias("token"), negative.alias("negative"))
    so_far = W.partitionBy(*doc).orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    start = F.sum(F.col("_gap") + F.length("token")).over(so_far) - F.length("token")
    return placed.select(*doc, "token", start.cast("int").alias("start"), "negative")


def locate(values: DataFrame, documents: DataFrame, key: list[str], doc: list[str], text: str = "text", value: str = "value",
           field: str = "field", min_digits: int = MIN_DIGITS) -> DataFrame:
    """Where a document prints a value with its sign, one row per value that is found.

    ``values`` has ``key``, which names a row, ``doc``, ``field`` and ``value``; ``documents`` has
    ``doc``, which names a row, and ``text``. Result: ``key``, token, scale, start and end (0-based,
    end exclusive). The first form with a correctly signed occurrence wins; among its
    occurrences the one with most of the field's keywords around it, then the earliest.

    The numbers of every document are read once and listed by (document, token);
    the forms of the values meet them in an equality join, so all occurrences in the
    whole text are considered and no text is searched for a form.
    """
    forms = values.select(*dict.fromkeys([*key, *doc]), field, value, F.explode(scaled_tokens(F.col(value), min_digits)).alias("_t"))
    wanted = forms.withColumn("token", F.col("_t.token")).withColumn("negative", F.col(value) < 0)
    hits = wanted.join(printed_numbers(documents, doc, text), [*doc, "token", "negative"])
    first = hits.withColumn("_rank", F.rank().over(W.partitionBy(*key).orderBy("_t.order"))).filter(F.col("_rank") == 1)
    # The text is met once more by the occurrences of the winning form, for their surroundings.
    near = first.join(documents.select(*doc, F.col(text).alias("_text")), doc)
    window_from = F.greatest(F.lit(0), F.col("start") - CONTEXT_CHARS)
    window = F.lower(F.substr(F.col("_text"), window_from + 1, F.col("start") + CONTEXT_CHARS - window_from))
    score = F.lit(0)
    for name, words in KEYWORDS.items():
        seen = sum((F.when(F.contains(window, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
        score = F.when(F.col(field) == name, seen).otherwise(score)
    best = W.partitionBy(*key).orderBy(F.col("_score").desc(), "start")
    return (
        # The text stays behind: the ranking carries positions only.
        near.select(*key, "token", F.col("_t.scale").alias("scale"), "start", score.alias("_score"))
        .withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") == 1)
        .select(*key, "token", "scale", "start", (F.col("start") + F.length("token")).alias("end"))
    )


def find_renderings(cases: DataFrame, key: list[str], text: str = "text", value: str = "value", field: str = "field",
                    min_digits: int = MIN_DIGITS) -> DataFrame:
    """:func:`locate` for cases that each bring their own text."""
    return locate(cases.select(*key, value, field), cases.select(*key, text), key, key, text, value, field, min_digits)


def excerpt(text: Column, start: Column, end: Column, max_chars: int = EXCERPT_CHARS) -> Column:
    """At most ``max_chars`` around ``[start, end)``, snapped to nearby newlines."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    n = F.length(text)
    low = F.greatest(F.lit(0), F.least(start - max_chars // 2, n - max_chars))
    high = F.least(n, low + max_chars)
    head = F.substr(text, low + 1, F.least(start, low + SNAP_CHARS) - low)
    first_break = F.instr(head, "\n")
    low_snapped = F.when((low > 0) & (first_break > 0), low + first_break).otherwise(low)
    tail_from = F.greatest(end, high - SNAP_CHARS)
    tail = F.substr(text, tail_from + 1, high - tail_from)
    last_break = F.length(F.substring_index(tail, "\n", -1))
    high_snapped = F.when((high < n) & F.contains(tail, F.lit("\n")), high - last_break - 1).otherwise(high)
    cut = F.substr(text, low_snapped + 1, high_snapped - low_snapped)
    whole = F.when(n <= max_chars, text).otherwise(cut)
    return F.regexp_replace(whole, r"^\s+|\s+$", "")


def resolve_values(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Which of a filing's candidate values its document prints.

    ``candidates``: case_id, doc_key, field, values (array). ``documents``:
    doc_key, text. Exactly one printed value makes a case; otherwise ``reason``
    says why not. Every document with any text is searched, however short.
    Columns: case_id, doc_key, field, expected, token, scale, start, end, reason.
    """
    each = candidates.withColumn("value", F.explode("values")).select("case_id", "doc_key", "field", "value")
    blank = ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    texts = documents.select("doc_key", "text", blank.alias("_blank"))
    # Only texts that some candidate names are read.
    read = texts.filter(~F.col("_blank")).join(candidates.select("doc_key").distinct(), "doc_key", "left_semi").drop("_blank")
    found = locate(each, read, ["case_id", "value"], ["doc_key"])
    per_case = found.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct("value", "token", "scale", "start", "end")).alias("hit"))
    reason = (
        F.when(F.col("_blank").isNull(), "fetch_failed").when(F.col("_blank"), "empty_document")
        .when(F.coalesce("_n", F.lit(0)) == 0, "no_rendering_in_text").when(F.col("_n") > 1, "ambiguous_xbrl_value")
    )
    hit = F.when(reason.isNull(), F.col("hit"))
    return (
        candidates.select("case_id", "doc_key", "field")
        .join(texts.select("doc_key", "_blank"), "doc_key", "left").join(per_case, "case_id", "left")
        .select("case_id", "doc_key", "field", hit["value"].alias("expected"), hit["token"].alias("token"),
                hit["scale"].alias("scale"), hit["start"].alias("start"), hit["end"].alias("end"), reason.alias("reason"))
    )


def with_excerpts(resolved: DataFrame, documents: DataFrame, max_chars: int = EXCERPT_CHARS) -> DataFrame:
    """All rows of :func:`resolve_values` with ``doc_text``, the excerpt around the figure.

    A case whose excerpt lost the figure at its trimmed edges gets the reason
    ``excerpt_lost_figure``, so every candidate ends as a case or with one reason.
    """
    cut = excerpt(F.col("text"), F.col("start"), F.col("end"), max_chars)
    # Only resolved cases need their text; the others pass by.
    cases = resolved.filter(F.col("reason").isNull()).join(documents.select("doc_key", "text"), "doc_key").withColumn("doc_text", cut)
    kept = F.contains("doc_text", "token")
    cases = cases.select(
        *[c for c in resolved.columns if c != "reason"], F.when(~kept, "excerpt_lost_figure").alias("reason"), F.when(kept, F.col("doc_text")).alias("doc_text"))
    return cases.unionByName(resolved.filter(F.col("reason").isNotNull()).withColumn("doc_text", F.lit(None).cast("string")))


def case_excerpts(resolved: DataFrame, documents: DataFrame, max_chars: int = EXCERPT_CHARS) -> DataFrame:
    """The cases of :func:`with_excerpts`: case_id, doc_key, doc_text, field, expected, scale."""
    return with_excerpts(resolved, documents, max_chars).filter(F.col("reason").isNull()).select(
        "case_id", "doc_key", "doc_text", "field", "expected", "scale")


def skip_counts(resolved: DataFrame) -> DataFrame:
    """Cases per skip reason; give it the rows of :func:`with_excerpts` for all of them."""
    return resolved.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))

"""Reading and judging answers given as text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.values import finite, number

# Fixed values.
RELATIVE_TOLERANCE = 1e-4
ABSOLUTE_FLOOR = 1e-9
SPLITS = ("dev", "holdout")


def split_of(case_id: Column) -> Column:
    """``dev`` when the CRC-32 of the id is even, else ``holdout``."""
    return F.when(F.crc32(F.encode(F.trim(case_id), "UTF-8")) % 2 == 0, SPLITS[0]).otherwise(SPLITS[1])


def match_answers(rows: DataFrame, prediction: str, expected: str, out: str = "correct") -> DataFrame:
    """Add ``out``: is the prediction the expected answer? A null prediction is wrong.

    Numbers agree within a relative tolerance; anything else by trimmed,
    case-insensitive text. Parsing and comparing are separate projections, so
    each text is parsed once per row.
    """
    parsed = rows.withColumns({"_p": number(F.col(prediction)), "_e": number(F.col(expected))})
    p, e = F.col("_p"), F.col("_e")
    close = F.abs(p - e) <= RELATIVE_TOLERANCE * F.greatest(F.abs(e), F.lit(ABSOLUTE_FLOOR))
    same = F.lower(F.trim(prediction)) == F.lower(F.trim(expected))
    verdict = F.when(finite(p) & finite(e), close).otherwise(same)
    return parsed.withColumn(out, F.coalesce(verdict, F.lit(False))).drop("_p", "_e")


def bare_numbers(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: a number in the shapes a filing prints and nothing else, or null.

    Currency sign, grouping commas, and a loss as a minus or in parentheses (or
    both, which is still one loss). Text around the number makes it null. Any
    nesting of ``(``, ``-`` and ``$`` may stand in front, closed by as many ``)``.
    """
    trimmed = rows.withColumn("_t", F.trim(F.regexp_replace(text, r"\s+", " ")))
    ends = trimmed.withColumns({
        "_head": F.regexp_extract("_t", r"^([($\- ]*)", 1), "_tail": F.regexp_extract("_t", r"([) ]*)$", 1)})
    inner = F.substr(F.col("_t"), F.length("_head") + 1, F.length("_t") - F.length("_head") - F.length("_tail"))
    digits = ends.withColumn("_d", F.regexp_replace(inner, ",", ""))
    balanced = F.regexp_count("_head", F.lit(r"\(")) == F.regexp_count("_tail", F.lit(r"\)"))
    shaped = F.col("_d").rlike(r"^(\d+(\.\d*)?([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$")
    sign = F.when(F.col("_head").rlike(r"[(\-]"), -1.0).otherwise(1.0)
    value = F.when(balanced & shaped, F.col("_d")).try_cast("double")
    return digits.withColumn(out, sign * value).drop("_t", "_head", "_tail", "_d")


def parse_replies(replies: DataFrame, content: str = "reply") -> DataFrame:
    """Add prediction (text), fallback and error to a table of model replies.

    A JSON object with a ``value`` key supplies the prediction. Otherwise a bare
    number is taken and marked as a fallback, and anything else is an error.
    """
    rows = bare_numbers(replies, content, "_bare").withColumns({
        "_json": F.try_parse_json(content).isNotNull(),
        "_keys": F.json_object_keys(content),
    })
    has_value = F.coalesce(F.col("_json") & F.array_contains("_keys", "value"), F.lit(False))
    # JSON null is an answer too; its text matches nothing but itself.
    given = F.coalesce(F.get_json_object(content, "$.value"), F.lit("None"))
    why = F.when(F.col(content).isNull(), "no content").when(F.col("_json"), "no value key").otherwise("not JSON")
    return (
        rows.withColumn("_has", has_value)
        .withColumn("prediction", F.when(F.col("_has"), given).otherwise(F.col("_bare").cast("string")))
        .withColumn("fallback", ~F.col("_has") & F.col("_bare").isNotNull())
        .withColumn("error", F.when(~F.col("_has") & F.col("_bare").isNull(), why))
        .drop("_bare", "_json", "_keys", "_has")
    )


def content_label(text: Column, known: Mapping[str, str]) -> Column:
    """Short name of a known text, else ``sha256:`` and twelve hex digits."""
    label = F.concat(F.lit("sha256:"), F.substring(F.sha2(F.encode(F.trim(text), "UTF-8"), 256), 1, 12))
    out = label
    for content, name in known.items():
        out = F.when(F.trim(text) == content, name).otherwise(out)
    return out

"""Company facts, filing lists and the ticker map, from JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.values import cik_number, finite, iso_day, number, ticker, whole
from tidemark.sources.tables import newest_wins
from tidemark.sources.unpack import members, object_lists, unrepeated

_ENTRY = ["start", "end", "val", "accn", "fy", "fp", "form", "filed"]
_RECENT = (
    "cik string, filings struct<recent: struct<accessionNumber: array<string>, form: array<string>, "
    "filingDate: array<string>, primaryDocument: array<string>>>"
)


# Bits of a position in a document, level by level: taxonomy, tag, unit, entry.
_POSITION_BITS = (8, 20, 12, 23)


def _position(*levels: str) -> Column:
    """One number that orders positions; a document too wide for it fails instead of wrapping."""
    packed = F.lit(0).cast("bigint")
    wide = F.lit(False)
    for name, bits in zip(levels, _POSITION_BITS):
        packed = F.shiftleft(packed, bits) + F.col(name)
        wide = wide | (F.col(name) >= 1 << bits)
    return F.when(wide, F.raise_error(F.lit("a company-facts document has too many members")).cast("bigint")).otherwise(packed)


def fact_entries(documents: DataFrame, column: str = "payload", every: bool = False) -> DataFrame:
    """Entries of company-facts documents, usable ones marked ``ok``.

    With ``every``, a document or branch without entries leaves a row with
    ``entry`` false, so one pass serves rows, counts and reasons.
    """
    explode = F.posexplode_outer if every else F.posexplode
    keep = [c for c in documents.columns if c != column]
    doc = documents.select(*keep, F.from_json(F.col(column), "cik string, facts map<string, string>").alias("d"))
    named = doc.select(*keep, cik_number(F.col("d.cik")).alias("cik"), unrepeated(F.col("d.facts")).alias("facts"))
    if not every:
        named = named.filter(F.col("cik") > 0)
    by_taxonomy = named.select(*keep, "cik", explode("facts").alias("_p0", "taxonomy", "tags"))
    by_tag = by_taxonomy.select(*keep, "cik", "taxonomy", "_p0", explode(members(F.col("tags"))).alias("_p1", "tag", "body"))
    units = object_lists(F.col("body"), "units", _ENTRY)
    by_unit = by_tag.select(*keep, "cik", "taxonomy", "tag", "_p0", "_p1", explode(units).alias("_p2", "unit", "list"))
    entries = by_unit.select(*keep, "cik", "taxonomy", "tag", "unit", "_p0", "_p1", "_p2", explode("list").alias("_p3", "e"))
    rows = entries.select(
        *keep, "cik", "taxonomy", "tag", "unit",
        iso_day(F.col("e.start")).alias("start"), iso_day(F.col("e.end")).alias("end"),
        number(F.col("e.val")).alias("val"), F.coalesce("e.accn", F.lit("")).alias("accn"),
        F.coalesce(whole(F.col("e.fy")), F.lit(0)).alias("fy"), F.coalesce("e.fp", F.lit("")).alias("fp"),
        F.coalesce("e.form", F.lit("")).alias("form"), iso_day(F.col("e.filed")).alias("filed"),
        _position("_p0", "_p1", "_p2", "_p3").alias("seq"), F.col("_p3").isNotNull().alias("entry"))
    ok = (F.col("cik") > 0) & F.col("entry") & F.col("filed").isNotNull() & F.col("end").isNotNull() & finite(F.col("val"))
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False)))


def parse_company_facts(documents: DataFrame, column: str = "payload") -> DataFrame:
    """Company-facts documents to fact rows.

    The nesting is unpacked level by level with the rest kept as text, so a
    malformed branch or entry is skipped without losing the document. Entries
    without a readable filing date, period end or value are dropped, as are
    documents without a positive filer number; an unreadable start becomes null
    (an instant); missing text is ``""`` and a missing year 0. Of a repeated tag
    the last one counts. ``seq`` numbers the entries of a document in order,
    which is what breaks the last ties between facts. Extra columns of
    ``documents``, such as a load stamp, are kept.
    """
    return fact_entries(documents, column).filter("ok").drop("ok", "entry")


def current_facts(facts: DataFrame, loaded: str = "loaded_at", loads: DataFrame | None = None) -> DataFrame:
    """Facts of each filer's newest document.

    A document is the whole record of a filer, so a newer one replaces the older
    one entirely; one that yielded no rows is not in the table and replaces
    nothing. The newest stamp per filer is found with map-side partials, and a
    filer with very many facts is split by the adaptive skew join. ``loads``, a
    table of (cik, load stamp), spares the look over all facts for the stamps.
    """
    newest = (facts if loads is None else loads).groupBy("cik").agg(F.max(loaded).alias(loaded))
    return facts.join(newest, ["cik", loaded], "left_semi")


def filing_entries(documents: DataFrame, column: str = "payload", expected: str | None = None, every: bool = False) -> DataFrame:
    """Entries of submissions documents, usable ones marked ``ok``; ``every`` as in :func:`fact_entries`."""
    keep = [c for c in documents.columns if c not in (column, expected)]
    parsed = documents.select(
        *keep, F.from_json(F.col(column), _RECENT).alias("d"),
        *([cik_number(F.col(expected).cast("string")).alias("_want")] if expected else []))
    cik = cik_number(F.col("d.cik"))
    if expected:
        differs = cik.isNotNull() & (cik != F.col("_want"))
        message = F.concat(F.lit("submissions document of filer "), cik.cast("string"), F.lit(" loaded for "),
                           F.col("_want").cast("string"))
        cik = F.when(differs, F.raise_error(message).cast("bigint")).otherwise(F.coalesce(cik, F.col("_want")))
    recent = F.col("d.filings.recent")
    names = ["accessionNumber", "form", "filingDate", "primaryDocument"]
    empty = F.expr("cast(array() as array<string>)")
    zipped = F.arrays_zip(*[F.coalesce(recent[n], empty).alias(n) for n in names])
    explode = F.posexplode_outer if every else F.posexplode
    each = parsed.select(*keep, cik.alias("cik"), explode(zipped).alias("seq", "f"))
    rows = each.select(
        *keep, "cik", F.trim("f.accessionNumber").alias("accn"), F.coalesce("f.form", F.lit("")).alias("form"),
        iso_day(F.col("f.filingDate")).alias("filed"), F.coalesce("f.primaryDocument", F.lit("")).alias("primary_doc"), "seq",
        F.col("seq").isNotNull().alias("entry"))
    ok = (F.col("cik") > 0) & (F.col("accn") != "") & F.col("filed").isNotNull()
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False)))


def parse_submissions(documents: DataFrame, column: str = "payload", expected: str | None = None) -> DataFrame:
    """Submissions documents to filing rows.

    The parallel arrays are matched by position; one that is missing or short
    leaves nulls instead of dropping filings. Filings without an accession number,
    a readable date or a positive filer number are dropped. With ``expected``, a
    column of filer numbers, a document of another filer fails the job.
    """
    return filing_entries(documents, column, expected).filter("ok").drop("ok", "entry")


#: Which row of a filing is the current one, most significant column first.
NEWEST_FILING = ["loaded_at", "seq", "filed", "form", "primary_doc"]


def current_filings(rows: DataFrame, loaded: str | None = "loaded_at") -> DataFrame:
    """One row per (cik, accn): the newest load, then the last in its document."""
    newest = ([loaded] if loaded else []) + NEWEST_FILING[1:]
    return newest_wins(rows, ["cik", "accn"], newest).select("cik", "accn", "form", "filed", "primary_doc")


def reject_reason(column: str = "payload") -> Column:
    """Why a text is no document: not a JSON object, or without a filer number; else null."""
    keys = F.json_object_keys(F.col(column))
    cik = cik_number(F.get_json_object(F.col(column), "$.cik"))
    return F.when(F.coalesce(keys, F.expr("cast(null as array<string>)")).isNull(), "not a JSON object").when(
        cik.isNull() | (cik <= 0), "no filer number")


def rejected(documents: DataFrame, column: str = "payload") -> DataFrame:
    """Documents that are not JSON objects with a filer number."""
    return documents.withColumn("reason", reject_reason(column)).filter(F.col("reason").isNotNull())


def load_summary(entries: DataFrame, name: str) -> DataFrame:
    """One row per document: rows loaded, entries skipped and status (loaded, empty or failed).

    ``entries`` come from :func:`fact_entries` or :func:`filing_entries` with
    ``every``, with a ``reason`` beside them; ``name`` identifies a document.
    """
    counts = entries.groupBy(name).agg(
        F.sum(F.col("ok").cast("bigint")).alias("rows"), F.sum((F.col("entry") & ~F.col("ok")).cast("bigint")).alias("skipped"),
        F.max("reason").alias("_reason"))
    status = F.when(F.col("_reason").isNotNull(), "failed").when(F.col("rows") > 0, "loaded").otherwise("empty")
    return counts.select(name, "rows", "skipped", status.alias("status"))


def parse_tickers(documents: DataFrame, column: str = "payload") -> DataFrame:
    """A JSON object of ``{cik_str, ticker}`` entries to distinct (cik, symbol) pairs.

    Malformed entries are skipped. The pair is the key: a filer may list several
    share classes.
    """
    texts = documents.select(F.explode(F.from_json(F.col(column), "map<string, string>")).alias("k", "text"))
    each = texts.select(F.from_json("text", "cik_str string, ticker string").alias("e"))
    rows = each.select(cik_number(F.col("e.cik_str")).alias("cik"), ticker(F.col("e.ticker")).alias("symbol"))
    return rows.filter((F.col("cik") > 0) & F.col("symbol").isNotNull()).distinct()

"""Composite jobs over a warehouse of stored tables."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions.values import as_date
from tidemark.operators import canonical, longshort, statistics, universe, vote
from tidemark.operators.calendar import holds, trading_days
from tidemark.operators.dividends import read_dividends
from tidemark.operators.facts import ALIVE_DAYS, read_filings
from tidemark.session import store
from tidemark.sources import actions, bars as bar_table, events, filings
from tidemark.sources.current import CurrentTable
from tidemark.sources.tables import append, read

_VERDICTS = T.StructType(schemas.CANONICAL.fields + [T.StructField("batch_ts", T.TimestampType()), T.StructField("batch", T.StringType())])
_LOADED = [T.StructField("loaded_at", T.TimestampType())]
_FILED = T.StructType(schemas.FILINGS.fields + [T.StructField("seq", T.LongType()), *_LOADED])


_PUBLISHED = T.StructType([
    T.StructField("number", T.LongType()), T.StructField("stamp", T.LongType()), T.StructField("buckets", T.IntegerType()),
    T.StructField("folder", T.StringType())])


def _by_filer(spark: SparkSession, folder: str, buckets: int) -> str:
    """The catalog name of published facts; known by its folder, so any session can read them by bucket."""
    name = f"facts_{hashlib.sha256(folder.encode()).hexdigest()[:16]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.FACTS)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (cik) SORTED BY (tag, cik, `end`) "
              f"INTO {buckets} BUCKETS LOCATION '{folder}'")
    return name


@dataclass(frozen=True)
class Warehouse:
    """Folders of the stored tables under one root."""

    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def verdicts(self, spark: SparkSession) -> DataFrame:
        return read(spark, self.path("canonical"), _VERDICTS)

    def facts(self, spark: SparkSession) -> DataFrame:
        """Facts of each filer's newest document; as published by filer, if nothing was loaded since."""
        published = self._published(spark)
        return self._stored_facts(spark) if published is None else published

    def _published(self, spark: SparkSession) -> DataFrame | None:
        notes = read(spark, self.path("facts_published/notes"), _PUBLISHED)
        note = notes.orderBy(F.desc("number")).limit(1).collect()
        if not note or note[0]["stamp"] != self.facts_stamp(spark):
            return None
        return spark.table(_by_filer(spark, note[0]["folder"], note[0]["buckets"]))

    def facts_stamp(self, spark: SparkSession) -> int | None:
        """The newest load, in microseconds."""
        loads = read(spark, self.path("facts_loads"), T.StructType([schemas.FACTS["cik"], *_LOADED]))
        return loads.agg(F.unix_micros(F.max("loaded_at"))).first()[0]

    def _stored_facts(self, spark: SparkSession) -> DataFrame:
        stored = read(spark, self.path("facts"), T.StructType(schemas.FACTS.fields + _LOADED))
        # The stamps have a table of their own, so a filter on tags reaches the only scan of the facts.
        loads = read(spark, self.path("facts_loads"), T.StructType([schemas.FACTS["cik"], *_LOADED]))
        return filings.current_facts(stored, loads=loads).drop("loaded_at")

    def filings(self, spark: SparkSession, filed_from: dt.date | None = None, filed_to: dt.date | None = None) -> DataFrame:
        """Current filings, of a window of filing dates (inclusive) if given.

        Loads keep the current rows in a table of their own, which is scanned as it is: a window reaches the
        scan. A warehouse whose filings were written otherwise is ranked on every read.
        """
        current = self.current_filings()
        if current.exists(spark):
            return current.read(spark, filed_from, filed_to).select(*schemas.FILINGS.fieldNames())
        ranked = filings.current_filings(read(spark, self.path("filings"), _FILED))
        return read_filings(ranked, None, filed_from, filed_to)

    def current_filings(self) -> CurrentTable:
        return CurrentTable(self.path("filings_current"), _FILED, ["cik", "accn"], filings.NEWEST_FILING, "filed", ["loaded_at", "seq"])

    def tickers(self, spark: SparkSession) -> DataFrame:
        return read(spark, self.path("tickers"), schemas.TICKERS)

    def dividends(self, spark: SparkSession) -> DataFrame:
        extra = [T.StructField("batch_ts", T.TimestampType()), T.StructField("seq", T.LongType())]
        return actions.current_actions(read(spark, self.path("dividends"), T.StructType(schemas.DIVIDENDS.fields + extra)), ["batch_ts", "seq"])

    def splits(self, spark: SparkSession) -> DataFrame:
        extra = [T.StructField("batch_ts", T.TimestampType()), T.StructField("seq", T.LongType())]
        return actions.current_actions(read(spark, self.path("splits"), T.StructType(schemas.SPLITS.fields + extra)), ["batch_ts", "seq"])


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def write_verdicts(voted: DataFrame, house: Warehouse, batch: str) -> DataFrame:
    """Store a batch of verdicts, quarantined days included, and return it as stored.

    The ballot of a disputed day is kept beside its verdict for audit; the event
    log is derived from the stored batch, so the vote runs once. Writing the same
    batch name again replaces it, which makes a repeated run harmless.
    """
    disputed = F.col("status") != "ok"
    rows = voted.select(
        "symbol", "ts", "close", "n_sources", "status", F.lit(_now()).cast("timestamp").alias("batch_ts"),
        F.when(disputed, F.col("ballot")).alias("ballot"), F.when(disputed, F.col("winners")).alias("winners"),
        F.lit(batch).alias("batch"))
    # Clustered by day, so a read of a date window skips the other files.
    (rows.repartitionByRange("ts", "symbol").sortWithinPartitions("ts", "symbol")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(house.path("canonical")))
    spark = voted.sparkSession
    return spark.read.schema(rows.schema).parquet(house.path("canonical")).filter(F.col("batch") == batch)


def log_dissent(stored: DataFrame, house: Warehouse, batch: str, tol: float) -> None:
    """Append the events of a stored batch; their ids repeat when the batch does."""
    key = F.concat_ws("|", F.lit(batch), F.col("symbol"), F.col("ts").cast("string"))
    rows = events.as_events(vote.dissent_events(stored, tol), event_id=F.sha2(key, 256))
    events.log_events(rows, house.path("events"))


def vote_range(spark: SparkSession, house: Warehouse, start, end, tol: float = vote.TOLERANCE, batch: str | None = None) -> DataFrame:
    """Vote on every symbol-day of a range, store and log it; returns the stored batch.

    One plan for the whole range, however many years it spans; yearly counts are
    ``verdict_counts`` of the result grouped by year.
    """
    first, last = as_date(start, "start"), as_date(end, "end")
    if first > last:
        raise ValueError(f"start {first} is after end {last}")
    rows = bar_table.read_bars(spark, house.path("bars"), start=first, end=last)
    name = batch or f"{_now():%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    stored = write_verdicts(vote.ballots(rows, tol), house, name)
    log_dissent(stored, house, name, tol)
    return stored


def yearly_counts(stored: DataFrame) -> DataFrame:
    """Verdict counts and quarantine rate per year of a voted batch."""
    return vote.verdict_counts(stored.withColumn("year", F.year("ts")), "year")


def daily_run(
    spark: SparkSession, house: Warehouse, asof, landed: Mapping[str, DataFrame], symbols=None,
    tol: float = vote.TOLERANCE, **screen,
) -> dict:
    """Load and vote the session before ``asof``; returns and logs a summary.

    ``landed`` maps a source to its landed bars (symbol, ts, open .. volume), as
    the parsers return them. Symbols, a frame or a collection, default to the
    universe as of ``asof``. A failure anywhere leaves no summary behind.
    """
    end = as_date(asof, "asof")
    day = end - dt.timedelta(days=1)
    if symbols is None:
        tickers = universe.check_tickers(house.tickers(spark))
        rows = bar_table.read_bars(spark, house.path("bars"), start=end - dt.timedelta(days=120), end=end)
        since = end - dt.timedelta(days=screen.get("alive_days", ALIVE_DAYS))
        names = universe.build(
            house.verdicts(spark), rows, house.filings(spark, since, end), tickers, end, **screen).select("symbol")
        source = "universe"
    else:
        if isinstance(symbols, (str, bytes)):
            raise TypeError("symbols must be a frame or a collection of strings, not a bare string")
        if isinstance(symbols, DataFrame):
            names = symbols.select("symbol")
        else:
            names = spark.createDataFrame([(str(s),) for s in symbols], "symbol string")
        source = "argument"
    # One row per listed symbol; stored so that every source sees the same names.
    folder = f"{house.path('runs')}/{end.isoformat()}-{uuid.uuid4().hex[:8]}"
    names.distinct().write.parquet(folder)
    names = spark.read.schema("symbol string").parquet(folder)
    n_symbols = names.count()
    counts = dict.fromkeys((f"{source_}_rows" for source_ in sorted(landed)), 0)
    if landed:
        every = reduce(DataFrame.unionByName, [
            frame.select(*schemas.BAR_INPUT.fieldNames(), F.lit(bar_table.folder_name(name, "source")).alias("source"))
            for name, frame in sorted(landed.items())])
        wanted = every.filter(F.col("ts") == F.lit(day)).join(names, "symbol", "left_semi")
        batch = bar_table.write_bars(wanted, house.path("bars"))
        written = read(spark, house.path("bars"), schemas.STORED_BARS).filter(F.col("batch") == batch)
        counts |= {f"{r['source']}_rows": r["count"] for r in written.groupBy("source").count().collect()}
    stored = vote_range(spark, house, day, day, tol)
    verdicts = vote.verdict_counts(stored).first()
    summary = {
        "asof": end.isoformat(), "day": day.isoformat(), "symbols": n_symbols, "symbol_source": source,
        "empty_universe": source == "universe" and n_symbols == 0, **counts,
        **{status: verdicts[status] for status in vote.STATUSES},
    }
    row = spark.createDataFrame([summary])
    events.log_events(events.as_events(row, "job.daily"), house.path("events"))
    return summary


def calibration_run(
    spark: SparkSession, house: Warehouse, anomaly: str,
    signal: Callable[[DataFrame, DataFrame], DataFrame], published: DataFrame, start, end, cut=None,
    n_buckets: int = 10, universe_panel: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    source: str = "", log: bool = True, **read_options,
) -> DataFrame:
    """Score a reproduced factor against a published series: the report, one row.

    ``signal(panel, asofs)`` and ``universe_panel(panel, asofs)`` get the
    canonical panel up to ``end`` and all formation dates. Let ``end`` lie a
    month past the last month reported and ``cut`` name that month, so that the
    panel's end is not mistaken for delistings.
    """
    first, last = as_date(start, "start"), as_date(end, "end")
    if first > last:
        raise ValueError(f"start {first} is after end {last}")
    # The newest verdicts are ranked once, for the closes and the panel; the closes also give the calendar.
    ranking = {k: read_options.pop(k) for k in ("newest",) if k in read_options}
    sources = {k: read_options[k] for k in ("min_sources",) if k in read_options}
    verdicts = store(canonical.vetted(house.verdicts(spark), end=last, **sources, **ranking), "vetted")
    closes = store(canonical.read_canonical(verdicts, start=first, end=last, newest=None, **read_options), "closes")
    panel = canonical.canonical_panel(verdicts, end=last, newest=None, **read_options)
    asofs = holds(trading_days(closes)).select(F.col("formed").alias("asof"))
    names = None if universe_panel is None else universe_panel(panel, asofs)
    dividends = read_dividends(house.dividends(spark), house.splits(spark), start=first, end=last)
    series = longshort.monthly_longshort(closes, signal(panel, asofs), n_buckets, names, dividends)
    if cut is not None:
        series = series.filter(F.col("month") <= F.lit(as_date(cut, "cut")))
    # One row, logged and returned: the study runs once for both.
    report = store(statistics.calibration_report(series, published, anomaly), "report")
    if log:
        window = report.select("*", F.lit(first.isoformat()).alias("start"), F.lit(last.isoformat()).alias("end"),
                               F.lit(source).alias("source"))
        events.log_events(events.as_events(window, "replication.calibration"), house.path("events"))
    return report


_PACKED = "document string, payload string"


def pack_documents(spark: SparkSession, path: str, archive: str, bundled: bool = False) -> DataFrame:
    """Put the documents of a folder, a file each, into an archive of (document, payload); returns it.

    The files are listed and opened once; loads then read a few large files that
    split evenly, however many documents there are. Packing another folder adds to
    the archive. Documents keep the name of their file.

    With ``bundled`` the folder holds a bulk download instead: files of many members, a
    JSON object ``{"document": name, "payload": text}`` a line. Such files are split like
    any text, so the cost follows their bytes and not the number of documents. A line
    without a payload is kept as a document of its own, which a load accepts or rejects.
    """
    if bundled:
        lines = spark.read.text(path, recursiveFileLookup=True).filter(F.trim("value") != "")
        member = F.from_json("value", _PACKED)
        texts = lines.withColumn("m", member).select(
            F.coalesce("m.document", F.concat_ws("#", F.input_file_name(), F.sha2("value", 256))).alias("document"),
            F.coalesce("m.payload", "value").alias("payload"))
    else:
        text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        texts = text.select(F.input_file_name().alias("document"), F.col("value").alias("payload"))
    append(texts, archive)
    return spark.read.schema(_PACKED).parquet(archive)


def _documents(spark: SparkSession, path: str, lines: bool, packed: bool) -> DataFrame:
    if packed:
        return spark.read.schema(_PACKED).parquet(path)
    text = spark.read.text(path, wholetext=not lines, recursiveFileLookup=True)
    name = F.concat_ws("#", F.input_file_name(), F.sha2("value", 256)) if lines else F.input_file_name()
    return text.select(F.col("value").alias("payload"), name.alias("document"))


def _load(
    spark: SparkSession, house: Warehouse, table: str, path: str, entries: Callable[[DataFrame], DataFrame], cluster_by: list[str],
    lines: bool, packed: bool, then: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Parse every document once into a staged table; rows, rejects, stamps and the summary come out of that."""
    documents = _documents(spark, path, lines, packed).withColumn("loaded_at", F.lit(_now()).cast("timestamp"))
    documents = documents.withColumn("reason", filings.reject_reason())
    staged = store(entries(documents), f"staged-{table}")
    rows = staged.filter(F.col("ok") & F.col("reason").isNull())
    append(rows.drop("reason", "entry", "ok"), house.path(table), cluster_by=cluster_by)
    if then is not None:
        then(rows)
    append(rows.select("cik", "loaded_at").distinct(), house.path(f"{table}_loads"))
    append(staged.filter(F.col("reason").isNotNull()).select("document", "reason", "loaded_at").distinct(), house.path(f"{table}_rejects"))
    return filings.load_summary(staged, "document")


def load_facts(spark: SparkSession, house: Warehouse, path: str, lines: bool = False, packed: bool = False) -> DataFrame:
    """Load a folder of company-facts documents; returns rows, skipped entries and status per document.

    A document is a file, a line with ``lines``, or a row of an archive with ``packed`` (:func:`pack_documents`). Facts are stored in ranges of tags, the filter that every signal reads them
    by. Bad documents are listed under ``facts_rejects`` and do not stop the load.
    """
    return _load(spark, house, "facts", path, lambda d: filings.fact_entries(d, every=True), ["tag", "cik", "end"], lines, packed)


def publish_facts(spark: SparkSession, house: Warehouse, buckets: int | None = None) -> DataFrame:
    """Write the current facts bucketed by filer and sorted by tag, for the signals; returns them.

    For after a bulk load. Groups and windows by filer then need no exchange, and a
    filter on tags skips row groups. Reads go back to the loaded table once a newer
    load has come in, until facts are published again. ``buckets`` defaults to the
    session's shuffle partitions; a bucket is a file.
    """
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stamp = house.facts_stamp(spark)
    folder = f"{house.path('facts_published')}/{uuid.uuid4().hex}"
    name = _by_filer(spark, folder, n)
    rows = house._stored_facts(spark).select(*schemas.FACTS.fieldNames())
    rows.repartition(n, "cik").write.bucketBy(n, "cik").sortBy("tag", "cik", "end").format("parquet").mode("append").saveAsTable(name)
    notes = house.path("facts_published/notes")
    number = read(spark, notes, _PUBLISHED).agg(F.max("number")).first()[0] or 0
    # The note comes last: before it, nobody reads the folder.
    spark.createDataFrame([(number + 1, stamp, n, folder)], _PUBLISHED).coalesce(1).write.mode("append").parquet(notes)
    return house.facts(spark)


def load_filings(spark: SparkSession, house: Warehouse, path: str, lines: bool = False, packed: bool = False) -> DataFrame:
    """Load a folder of submissions documents; returns rows, skipped entries and status per document."""
    return _load(spark, house, "filings", path, lambda d: filings.filing_entries(d, every=True), ["filed", "cik"], lines, packed,
                 lambda rows: house.current_filings().merge(_as_filed(rows)))


def _as_filed(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _FILED])


def store_filings(house: Warehouse, rows: DataFrame) -> None:
    """Append filing rows (columns of the stored table, ``loaded_at`` their load stamp) and bring the current ones up to date."""
    staged = store(_as_filed(rows), "staged-filings")
    append(staged, house.path("filings"), cluster_by=["filed", "cik"])
    house.current_filings().merge(staged)


def load_actions(house: Warehouse, pages: DataFrame) -> None:
    """Append the dividends and splits of vendor pages (column ``payload``)."""
    stamped = pages.select("payload", F.lit(_now()).cast("timestamp").alias("batch_ts"))
    actions.parse_dividends(stamped).write.mode("append").parquet(house.path("dividends"))
    actions.parse_splits(stamped).write.mode("append").parquet(house.path("splits"))


def load_tickers(house: Warehouse, documents: DataFrame) -> None:
    """Replace the ticker map."""
    filings.parse_tickers(documents).write.mode("overwrite").parquet(house.path("tickers"))

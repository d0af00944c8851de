"""The price-bar table: vendor payloads in, newest-wins reads out."""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.values import among, as_date, finite, iso_day, number, symbol_list, ticker
from tidemark.schemas import BAR_INPUT, BARS, STORED_BARS, conform, require
from tidemark.sources.tables import append, newest_wins, read
from tidemark.sources.unpack import object_list

# Fixed values.
BAR_KEY = ["symbol", "ts", "resolution", "source"]
DUMP_FIELDS = 10
DUMP_PERIOD = "D"
DUMP_SUFFIX = ".US"

_SAFE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
_VALUES = ["open", "high", "low", "close", "volume"]


def folder_name(value: str, label: str) -> str:
    """A value that becomes a partition folder: letters, digits, ``._-``."""
    if not isinstance(value, str):
        raise TypeError(f"{label} must be a string, got {type(value).__name__}")
    if not _SAFE.fullmatch(value.strip()):
        raise ValueError(f"{label} may hold letters, digits and ._- only, got {value!r}")
    return value.strip()


def batch_name() -> str:
    """A name that sorts by time of writing."""
    return f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex}"


def stamp_bars(
    df: DataFrame, source: str | None = None, resolution: str = "1d", arrival: list[str] | None = None, batch: str | None = None
) -> DataFrame:
    """A batch in the stored schema, one row per key.

    Without ``source`` the column of that name says whose bar each row is, so the
    bars of all vendors are stamped, and written, together.

    Extra columns are dropped. A null symbol or day fails the job, since both
    are part of the key. Of duplicates inside the batch the last one by
    ``arrival`` stays; the values themselves break remaining ties.
    """
    resolution = folder_name(resolution, "resolution")
    require(df, *BAR_INPUT.fieldNames(), *([] if source else ["source"]), *(arrival or []))
    order = [F.col(c).alias(f"_a{i}") for i, c in enumerate(arrival or [])]
    owner = F.lit(folder_name(source, "source")) if source else F.when(
        F.coalesce(F.trim("source").rlike(f"^{_SAFE.pattern}$"), F.lit(False)), F.trim("source")).otherwise(
        F.raise_error(F.lit("source may hold letters, digits and ._- only")).cast("string"))
    typed = conform(df, BAR_INPUT, owner.alias("_source"), *order)
    broken = F.col("symbol").isNull() | F.col("ts").isNull()
    checked = typed.withColumn("symbol", F.when(
        broken, F.raise_error(F.lit("symbol and ts may not be null")).cast("string")).otherwise(F.col("symbol")))
    now = dt.datetime.now(dt.timezone.utc)
    unique = newest_wins(checked, ["_source", "symbol", "ts"], [f"_a{i}" for i in range(len(order))] + _VALUES)
    return conform(
        unique.withColumns({
            "resolution": F.lit(resolution), "source": F.col("_source"),
            "ingested_at": F.lit(now).cast("timestamp"), "batch": F.lit(batch or batch_name()),
        }), BARS)


def write_bars(df: DataFrame, path: str, source: str | None = None, resolution: str = "1d", arrival: list[str] | None = None) -> str:
    """Append a batch under ``source=/resolution=/month=`` folders, of one vendor or of all; returns its name."""
    batch = batch_name()
    stamped = stamp_bars(df, source, resolution, arrival, batch).withColumn("month", month_of("ts"))
    append(stamped, path, ["source", "resolution", "month"], ["symbol", "ts"])
    return batch


def month_of(day: str | Column) -> Column:
    """The month folder of a day."""
    return F.date_format(day, "yyyy-MM")


def read_bars(spark: SparkSession, path: str, months: list[str] | None = None, **window) -> DataFrame:
    """Stored bars; see :func:`select_bars`. Folders of months outside the window, or not among ``months``, aren't read."""
    stored = read(spark, path, STORED_BARS)
    # Bars written before there were such folders have no month.
    undated = F.col("month").isNull()
    if window.get("start") is not None:
        stored = stored.filter(undated | (F.col("month") >= f"{as_date(window['start'], 'start'):%Y-%m}"))
    if window.get("end") is not None:
        stored = stored.filter(undated | (F.col("month") <= f"{as_date(window['end'], 'end'):%Y-%m}"))
    if months is not None:
        stored = stored.filter(undated | F.col("month").isin(*months) if months else undated)
    return select_bars(stored.drop("month"), **window)


def select_bars(
    bars: DataFrame, symbols=None, start=None, end=None, resolution: str = "1d", source: str | None = None
) -> DataFrame:
    """The newest row per key inside a window, both ends inclusive.

    Every filter is on a key column, so a row and its correction pass or fail
    together and all of them reach the scan: source and resolution as partition
    pruning, the rest as parquet filters.
    """
    rows = bars.filter(F.col("resolution") == folder_name(resolution, "resolution"))
    if source is not None:
        rows = rows.filter(F.col("source") == folder_name(source, "source"))
    rows = rows.filter(among(F.col("symbol"), symbol_list(symbols)))
    if start is not None:
        rows = rows.filter(F.col("ts") >= F.lit(as_date(start, "start")))
    if end is not None:
        rows = rows.filter(F.col("ts") <= F.lit(as_date(end, "end")))
    return newest_wins(rows, BAR_KEY, ["ingested_at", "batch"])


def _usable(rows: DataFrame) -> DataFrame:
    ok = F.col("symbol").isNotNull() & F.col("ts").isNotNull()
    for name in _VALUES:
        ok = ok & finite(F.col(name))
    return rows.filter(ok).select(*BAR_INPUT.fieldNames())


def parse_bar_json(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Vendor JSON ``{"bars": {SYMBOL: [{t,o,h,l,c,v}, ...]}}`` to bars.

    The session is the date part of ``t``. Each level is unpacked on its own and
    the values are read as text, so a malformed bar or symbol is skipped without
    losing its neighbours.
    """
    by_symbol = payloads.select(F.explode(F.from_json(F.col(column), "bars map<string, string>")["bars"]).alias("symbol", "series"))
    one = by_symbol.select("symbol", F.explode(object_list(F.col("series"), list("tohlcv"))).alias("b"))
    return _usable(one.select(
        ticker(F.col("symbol")).alias("symbol"), iso_day(F.substring("b.t", 1, 10)).alias("ts"),
        *[number(F.col(f"b.{key}")).alias(name) for key, name in zip("ohlcv", _VALUES)]))


def reshape_history(history: DataFrame, zone: str, symbol: str = "symbol", at: str = "at") -> DataFrame:
    """OHLCV history with an instant per row to bars.

    The session is the calendar day of the instant in the exchange's ``zone``.
    """
    columns = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}
    require(history, symbol, at, *columns)
    values = [F.col(old).cast("double").alias(new) for old, new in columns.items()]
    return _usable(history.select(
        ticker(F.col(symbol)).alias("symbol"), F.to_date(F.from_utc_timestamp(F.col(at), zone)).alias("ts"), *values))


def parse_dump(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of a delimited daily dump to bars.

    Ten comma-separated fields: ticker, period, date, time, open, high, low,
    close, volume, open interest. Headers, other periods and lines that do not
    parse are skipped.
    """
    parts = F.split(F.trim(F.col(column)), ",", -1)

    def part(i: int) -> Column:
        return F.trim(F.get(F.col("p"), F.lit(i)))

    rows = lines.select(parts.alias("p")).filter(
        (F.size("p") == DUMP_FIELDS) & ~F.startswith(F.get(F.col("p"), F.lit(0)), F.lit("<"))
        & (F.upper(part(1)) == DUMP_PERIOD) & part(2).rlike(r"^\d{8}$"))
    name = F.upper(part(0))
    bare = F.when(F.endswith(name, F.lit(DUMP_SUFFIX)), F.substr(name, F.lit(1), F.length(name) - len(DUMP_SUFFIX))).otherwise(name)
    return _usable(rows.select(
        F.when(bare != "", bare).alias("symbol"), iso_day(part(2)).alias("ts"),
        *[number(part(i)).alias(n) for i, n in zip((4, 5, 6, 7, 8), _VALUES)]))

"""Declared schemas of the stored tables. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "date": T.DateType(), "double": T.DoubleType(), "bigint": T.LongType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def _schema(columns: str) -> T.StructType:
    """``"name type, ..."`` without a session, unlike ``StructType.fromDDL``."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


BARS = _schema(
    "symbol string, ts date, resolution string, open double, high double, low double, "
    "close double, volume double, source string, ingested_at timestamp, batch string"
)
#: Bars lie in folders by source, resolution and month; the month is that of ``ts``, for reads to pass folders by.
STORED_BARS = T.StructType([*BARS.fields, T.StructField("month", T.StringType())])
BAR_INPUT = _schema(
    "symbol string, ts date, open double, high double, low double, close double, volume double"
)
CANONICAL = _schema("symbol string, ts date, close double, n_sources bigint, status string")
FACTS = _schema(
    "cik bigint, taxonomy string, tag string, unit string, start date, end date, val double, "
    "accn string, fy bigint, fp string, form string, filed date, seq bigint"
)
FILINGS = _schema("cik bigint, accn string, form string, filed date, primary_doc string")
DIVIDENDS = _schema("symbol string, ex_date date, rate double, special boolean")
SPLITS = _schema("symbol string, ex_date date, old_rate double, new_rate double")
TICKERS = _schema("cik bigint, symbol string")
UNIVERSE = _schema("asof date, symbol string, cik bigint")
SIGNAL = _schema("asof date, symbol string, score double")
SERIES = _schema("month date, ret_ls double")
PUBLISHED = _schema("month date, ret double")
SCORES = _schema("forecaster string, n bigint, mae double")
CASES = _schema("case_id string, doc_text string, field string, expected string, split string")
EVENTS = _schema("event_id string, ts string, kind string, payload string")


def require(df: DataFrame, *columns: str) -> None:
    """Raise when a named column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def conform(df: DataFrame, schema: T.StructType, *extra: Column) -> DataFrame:
    """Project to a declared schema, in its order and with its types, plus extra columns.

    Dates given as a number are refused: they would silently be read as days
    since 1970.
    """
    require(df, *schema.fieldNames())
    have = {f.name: f.dataType for f in df.schema.fields}
    for field in schema.fields:
        if isinstance(field.dataType, T.DateType) and isinstance(have[field.name], T.NumericType):
            raise TypeError(f"{field.name} must be a date, timestamp or string column")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], *extra)

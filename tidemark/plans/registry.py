"""Registry of named queries over the benchmark tables and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the equivalent SQL if there is one."""

    def add(fn: Query) -> Query:
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} is registered twice")
        QUERIES[fn.__name__] = fn
        if sql is not None:
            # ASOF is a keyword of the checking engine.
            ORACLES[fn.__name__] = re.sub(r'(?<!")\basof\b(?!")', '"asof"', sql)
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, exact: tuple[str, ...] = ()) -> DataFrame:
    """Round the double columns: sums differ in the last bits between engines.

    Columns in ``exact`` are left alone. They come from whole cents by the same
    few operations in both engines, so they are equal to the last bit, and
    rounding could only split a tie two ways.
    """
    return df.select(*[
        F.round(f.name, digits).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) and f.name not in exact else F.col(f.name)
        for f in df.schema.fields
    ])


def R(expression: str, digits: int = 6) -> str:
    """SQL twin of :func:`rounded`; adding zero turns -0.0 into 0.0."""
    return f"(round({expression}, {digits}) + 0.0)"


# --- SQL twins of the stand-in views ------------------------------------------------

BARS_D = """bars_d AS (
  SELECT 'U' || user_id AS symbol, CAST(ts AS DATE) AS ts, event_type AS source,
         100 + CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 5000) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2, 3)"""

BARS_M = """bars_m AS (
  SELECT 'S' || l_suppkey AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, l_returnflag AS source,
         100 + CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2, 3)"""

FACTS_Q = """facts_q AS (
  SELECT l_suppkey AS cik, o_orderpriority AS tag, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS start,
         CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end",
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS val,
         CAST(max(o_orderkey) AS VARCHAR) AS accn,
         CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) + 45 AS filed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""

FACTS_T = f"""{FACTS_Q},
quarters_t AS (
  SELECT cik, start, "end", sum(CAST(round(val * 100) AS BIGINT)) AS c, max(accn) AS accn FROM facts_q GROUP BY ALL),
facts_t AS (
  SELECT cik, start, "end", CAST(c AS DOUBLE) / 100.0 AS val, accn, "end" + 45 AS filed FROM quarters_t
  UNION ALL
  SELECT cik, start, "end", CAST(c * 101 AS DOUBLE) / 10000.0, accn, "end" + 85 FROM quarters_t WHERE cik % 3 = 0)"""

FACTS_Y = """facts_y AS (
  SELECT l_suppkey AS cik, o_orderpriority AS tag, make_date(year(o_orderdate), 12, 31) AS "end",
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS val,
         CAST(max(o_orderkey) AS VARCHAR) AS accn, make_date(year(o_orderdate), 12, 31) + 60 AS filed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""

TICKERS = "tickers AS (SELECT s_suppkey AS cik, 'S' || s_suppkey AS symbol FROM supplier)"

DIVIDENDS = """dividends AS (
  SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ex_date, l_discount AS rate FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate
    ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1)"""

SPLITS = """splits AS (
  SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ex_date, 1.0 + l_tax AS ratio FROM lineitem
  WHERE l_quantity = 50
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate
    ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1)"""


def vote_sql(bars: str, tol: float) -> str:
    """CTEs ``runs`` and ``verdicts`` over a CTE of bars."""
    scale = "greatest(abs(a.close), abs(b.close), 1e-9)"
    return f"""runs AS (
  SELECT a.symbol, a.ts, a.close AS lo, max(b.close) AS hi, count(*) AS size,
         list_sort(list(b.source)) AS sources, list_sort(list(b.close)) AS closes
  FROM {bars} a JOIN {bars} b ON a.symbol = b.symbol AND a.ts = b.ts AND b.close >= a.close
       AND b.close - a.close <= {tol} * {scale}
  GROUP BY a.symbol, a.ts, a.source, a.close),
totals AS (SELECT symbol, ts, count(*) AS n, min(close) AS lo, max(close) AS hi FROM {bars} GROUP BY 1, 2),
best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY symbol, ts
    ORDER BY size DESC, (hi - lo) / greatest(abs(lo), abs(hi), 1e-9), sources) = 1),
verdicts AS (
  SELECT t.symbol, t.ts, t.n AS n_sources,
         CASE WHEN t.hi - t.lo <= {tol} * greatest(abs(t.lo), abs(t.hi), 1e-9) THEN 'ok'
              WHEN 2 * b.size > t.n THEN 'majority' ELSE 'quarantined' END AS status,
         CASE WHEN 2 * b.size > t.n THEN b.closes[b.size // 2 + 1] END AS close,
         CASE WHEN 2 * b.size > t.n THEN b.sources END AS agreeing
  FROM totals t JOIN best b ON t.symbol = b.symbol AND t.ts = b.ts)"""


def panel_sql(max_jump: float, min_sources: int = 2, where: str = "true") -> str:
    """CTEs ``panel`` (vetted closes) and ``breaks`` over ``verdicts``."""
    return f"""panel AS (
  SELECT symbol, ts, close FROM verdicts
  WHERE status <> 'quarantined' AND n_sources >= {min_sources} AND close > 0 AND {where}),
breaks AS (
  SELECT symbol, ts FROM (
    SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS ratio FROM panel)
  WHERE ratio > {max_jump} OR ratio < 1.0 / {max_jump}),
cuts AS (SELECT symbol, max(ts) AS cut FROM breaks GROUP BY 1),
truncated AS (
  SELECT p.symbol, p.ts, p.close FROM panel p LEFT JOIN cuts c ON p.symbol = c.symbol
  WHERE c.cut IS NULL OR p.ts >= c.cut)"""

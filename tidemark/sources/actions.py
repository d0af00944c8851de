"""Corporate actions: dividends and splits from vendor JSON, newest-wins reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.values import among, as_date, finite, iso_day, number, positive, symbol_list, ticker
from tidemark.sources.tables import newest_wins
from tidemark.sources.unpack import object_list

_ACTIONS = "corporate_actions struct<cash_dividends: string, forward_splits: string, reverse_splits: string>"
_DIVIDEND = ["symbol", "ex_date", "rate", "special"]
_SPLIT = ["symbol", "ex_date", "old_rate", "new_rate"]
_KEY = ["symbol", "ex_date"]


def _pages(pages: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    keep = [c for c in pages.columns if c != column]
    return pages.select(*keep, F.from_json(F.col(column), _ACTIONS)["corporate_actions"].alias("a")), keep


def parse_dividends(pages: DataFrame, column: str = "payload") -> DataFrame:
    """Cash dividends of vendor pages; rows without symbol, date or rate are dropped.

    Rows are unpacked as text first, so a malformed one costs only itself.
    ``seq`` is the position in the page. Columns of ``pages`` other than the
    payload (a load stamp, a page number) are kept for :func:`current_actions`.
    """
    parsed, keep = _pages(pages, column)
    each = parsed.select(*keep, F.posexplode(object_list(F.col("a.cash_dividends"), _DIVIDEND)).alias("seq", "d"))
    rows = each.select(
        *keep, "seq", ticker(F.col("d.symbol")).alias("symbol"), iso_day(F.substring("d.ex_date", 1, 10)).alias("ex_date"),
        number(F.col("d.rate")).alias("rate"), F.coalesce(F.lower("d.special") == "true", F.lit(False)).alias("special"))
    return rows.filter(F.col("symbol").isNotNull() & F.col("ex_date").isNotNull() & finite(F.col("rate")))


def parse_splits(pages: DataFrame, column: str = "payload") -> DataFrame:
    """Forward and reverse splits of vendor pages with positive rates."""
    parsed, keep = _pages(pages, column)
    lists = [object_list(F.col(f"a.{name}"), _SPLIT) for name in ("forward_splits", "reverse_splits")]
    both = F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))
    each = parsed.select(*keep, F.posexplode(both).alias("seq", "s"))
    rows = each.select(
        *keep, "seq", ticker(F.col("s.symbol")).alias("symbol"), iso_day(F.substring("s.ex_date", 1, 10)).alias("ex_date"),
        number(F.col("s.old_rate")).alias("old_rate"), number(F.col("s.new_rate")).alias("new_rate"))
    return rows.filter(
        F.col("symbol").isNotNull() & F.col("ex_date").isNotNull() & positive(F.col("old_rate")) & positive(F.col("new_rate")))


def current_actions(rows: DataFrame, newest: list[str], symbols=None, start=None, end=None) -> DataFrame:
    """The newest row per (symbol, ex_date), ``newest`` naming the batch order.

    Remaining columns break ties, so the choice does not depend on file order.
    """
    rows = rows.filter(among(F.col("symbol"), symbol_list(symbols)))
    if start is not None:
        rows = rows.filter(F.col("ex_date") >= F.lit(as_date(start, "start")))
    if end is not None:
        rows = rows.filter(F.col("ex_date") <= F.lit(as_date(end, "end")))
    values = [c for c in rows.columns if c not in _KEY + newest]
    return newest_wins(rows, _KEY, newest + values).drop(*newest)

"""First-in first-out tax lots over a table of fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.costs import LONG_TERM_DAYS, TAX_LONG, TAX_SHORT, tax_due

# Fixed value.
QTY_EPS = 1e-9

#: Target number of fills in one window of the sweep; the lots are the same for any number.
ROWS_PER_BUCKET = 100_000

BOOK = ["account", "symbol"]


def running_total(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Running sum of ``value`` per key, in ``chunk`` then ``order``.

    A key may hold most of the table, so its rows are never brought together:
    each (key, chunk) is summed on its own and the totals of the earlier chunks,
    one row per chunk, are added.
    """
    within = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_total"))
    offsets = totals.select(*keys, chunk, F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)).alias("_offset"))
    return (
        df.withColumn("_local", F.sum(value).over(within))
        .join(offsets, [*keys, chunk])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset")
    )


def quantity_intervals(fills: DataFrame) -> DataFrame:
    """Place each fill on the share axis of its side: ``[lo, hi)``.

    The first share ever bought is share 0 of the buys, and likewise for sells;
    FIFO means share x of the sells is share x of the buys.
    """
    valid = fills.filter(F.col("qty") > QTY_EPS)
    placed = running_total(valid, [*BOOK, "side"], "day", ["seq"], "qty", "hi")
    return placed.withColumn("lo", F.col("hi") - F.col("qty"))


def match_lots(fills: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Every (sell, buy) pair that FIFO matches, with quantity and gain.

    ``fills``: account, symbol, day, seq, side (buy or sell), qty, price, with
    ``seq`` unique and ordered inside a day. A holding of more than 365 days is
    long-term. A sell dated before its buy is kept and flagged ``out_of_order``.

    Pairs come from one sweep along the share axis instead of an interval join,
    whose work would be quadratic in the fills of a busy book: at each start of
    a buy or a sell interval the buy and the sell in force are carried forward,
    and the stretch to the next start belongs to that pair. The axis of a book
    is cut into buckets in proportion to its number of fills, and an interval is
    split where it crosses a cut, so buckets are independent and a book of any
    size spreads over many tasks.
    """
    placed = quantity_intervals(fills)
    books = placed.groupBy(*BOOK).agg(
        F.max("hi").alias("_extent"), F.ceil(F.count(F.lit(1)) / rows_per_bucket).alias("_buckets"))
    width = F.col("_extent") / F.col("_buckets")
    first = F.floor(F.col("lo") / F.col("_width"))
    final = F.greatest(first, F.ceil(F.col("hi") / F.col("_width")) - 1)
    pieces = (
        placed.join(books.select(*BOOK, width.alias("_width")), BOOK)
        .withColumn("_bucket", F.explode(F.sequence(first, final)))
        .withColumn("_at", F.greatest("lo", F.col("_bucket") * F.col("_width")))
        .withColumn("_to", F.least("hi", (F.col("_bucket") + 1) * F.col("_width")))
    )
    fill = F.struct("day", "seq", "price", F.col("_to").alias("to"))
    # Of two pieces starting together on one side, one is a rounding sliver: the longer comes last.
    axis = W.partitionBy(*BOOK, "_bucket").orderBy("_at", "_to")
    so_far = axis.rowsBetween(W.unboundedPreceding, 0)
    swept = pieces.select(
        *BOOK, "_at",
        F.last(F.when(F.col("side") == "buy", fill), ignorenulls=True).over(so_far).alias("b"),
        F.last(F.when(F.col("side") == "sell", fill), ignorenulls=True).over(so_far).alias("s"),
        F.lead("_at").over(axis).alias("_next"),
    )
    length = F.least("_next", "b.to", "s.to") - F.col("_at")
    matched = swept.filter(F.col("b").isNotNull() & F.col("s").isNotNull()).withColumn("_qty", length)
    return (
        matched.filter(F.col("_qty") > 0)
        # Pieces of one pair on two sides of a cut come back together here; only then is a sliver told from a lot.
        .groupBy(*BOOK, F.col("s.day").alias("sell_day"), F.col("s.seq").alias("sell_seq"),
                 F.col("b.day").alias("buy_day"), F.col("b.seq").alias("buy_seq"),
                 F.col("s.price").alias("sell_price"), F.col("b.price").alias("buy_price"))
        .agg(F.sum("_qty").alias("qty"))
        .filter(F.col("qty") > QTY_EPS)
        .withColumn("gain", F.col("qty") * (F.col("sell_price") - F.col("buy_price")))
        .withColumn("long_term", F.datediff("sell_day", "buy_day") > LONG_TERM_DAYS)
        .withColumn("out_of_order", F.col("sell_day") < F.col("buy_day"))
    )


def unmatched_sells(fills: DataFrame) -> DataFrame:
    """Sells of more shares than were ever bought: account, symbol, day, seq, unmatched_qty."""
    placed = quantity_intervals(fills)
    bought = fills.filter((F.col("side") == "buy") & (F.col("qty") > QTY_EPS)).groupBy(*BOOK).agg(
        F.sum("qty").alias("_bought"))
    excess = F.col("hi") - F.greatest("lo", F.coalesce("_bought", F.lit(0.0)))
    return (
        placed.filter(F.col("side") == "sell").join(bought, BOOK, "left")
        .withColumn("unmatched_qty", excess).filter(F.col("unmatched_qty") > QTY_EPS)
        .select(*BOOK, "day", "seq", "unmatched_qty")
    )


def held(fills: DataFrame) -> DataFrame:
    """Open shares per account and symbol, never below zero."""
    signed = F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    return fills.groupBy(*BOOK).agg(F.greatest(F.sum(signed), F.lit(0.0)).alias("qty")).filter(F.col("qty") > QTY_EPS)


def annual_tax(lots: DataFrame, short_rate: float = TAX_SHORT, long_rate: float = TAX_LONG) -> DataFrame:
    """Realised gains and tax per account and year of sale."""
    long = F.col("long_term")
    return (
        lots.groupBy("account", F.year("sell_day").alias("year"))
        .agg(F.coalesce(F.sum(F.when(~long, F.col("gain"))), F.lit(0.0)).alias("st"),
             F.coalesce(F.sum(F.when(long, F.col("gain"))), F.lit(0.0)).alias("lt"))
        .withColumn("tax_paid", tax_due(F.col("st"), F.col("lt"), short_rate, long_rate))
    )

"""Market-shaped views over the generic benchmark tables.

Each view is derived by Spark from the parquet tables of a folder, so the work
of a query over it grows with those tables. Sums that later meet a threshold are
taken over whole cents, which makes them exact whatever the summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.sources.tables import newest_wins


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("bigint")


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as daily bars: symbol = user, source = event type."""
    e = table(spark, sf_dir, "events")
    n = F.count(F.lit(1))
    return (
        e.groupBy(F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), F.to_date("ts").alias("ts"),
                  F.col("event_type").alias("source"))
        .agg((100 + F.sum(cents(F.col("value"))).cast("double") / (n * 5000)).alias("close"),
             n.cast("double").alias("volume"))
    )


def bars_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as monthly bars: symbol = supplier, source = return flag."""
    li = table(spark, sf_dir, "lineitem")
    n = F.count(F.lit(1))
    return (
        li.groupBy(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
                   F.trunc(F.to_date("l_shipdate"), "MM").alias("ts"), F.col("l_returnflag").alias("source"))
        .agg((100 + F.sum(cents(F.col("l_discount"))).cast("double") / n).alias("close"),
             F.sum("l_quantity").alias("volume"))
    )


def facts_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and lineitem as quarterly facts: filer = supplier, tag = order priority."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    day = F.to_date("o_orderdate")
    start = F.trunc(day, "quarter")
    end = F.date_sub(F.add_months(start, 3), 1)
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .groupBy(F.col("l_suppkey").alias("cik"), F.col("o_orderpriority").alias("tag"),
                 start.alias("start"), end.alias("end"))
        .agg((F.sum(cents(F.col("l_extendedprice"))) / F.lit(100.0)).alias("val"),
             F.max("o_orderkey").cast("string").alias("accn"))
        .select("cik", F.lit("us-gaap").alias("taxonomy"), "tag", F.lit("USD").alias("unit"), "start", "end",
                "val", "accn", F.year("end").cast("bigint").alias("fy"),
                F.concat(F.lit("Q"), F.quarter("end")).alias("fp"), F.lit("10-Q").alias("form"),
                F.date_add("end", 45).alias("filed"), F.lit(0).cast("bigint").alias("seq"))
    )


def facts_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly facts summed over tags, restated 40 days later with one percent more."""
    q = facts_quarterly(spark, sf_dir).groupBy("cik", "start", "end").agg(
        F.sum(cents(F.col("val"))).alias("c"), F.max("accn").alias("accn"))
    first = q.select("cik", "start", "end", (F.col("c") / F.lit(100.0)).alias("val"), "accn",
                     F.date_add("end", 45).alias("filed"))
    again = q.filter(F.col("cik") % 3 == 0).select(
        "cik", "start", "end", (F.col("c") * 101 / F.lit(10000.0)).alias("val"), "accn",
        F.date_add("end", 85).alias("filed"))
    return first.unionByName(again).select(
        "cik", F.lit("us-gaap").alias("taxonomy"), F.lit("TOTAL").alias("tag"), F.lit("USD").alias("unit"),
        "start", "end", "val", "accn", F.year("end").cast("bigint").alias("fy"), F.lit("").alias("fp"),
        F.lit("10-Q").alias("form"), "filed", F.lit(0).cast("bigint").alias("seq"))


def facts_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-end facts for the balance-sheet lines: instants, form 10-K."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    end = F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31))
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .groupBy(F.col("l_suppkey").alias("cik"), F.col("o_orderpriority").alias("tag"), end.alias("end"))
        .agg((F.sum(cents(F.col("l_extendedprice"))) / F.lit(100.0)).alias("val"),
             F.max("o_orderkey").cast("string").alias("accn"))
        .select("cik", F.lit("us-gaap").alias("taxonomy"), "tag", F.lit("USD").alias("unit"),
                F.lit(None).cast("date").alias("start"), "end", "val", "accn",
                F.year("end").cast("bigint").alias("fy"), F.lit("FY").alias("fp"), F.lit("10-K").alias("form"),
                F.date_add("end", 60).alias("filed"), F.lit(0).cast("bigint").alias("seq"))
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as filings: filer = customer, form = order status."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cik"), F.col("o_orderkey").cast("string").alias("accn"),
        F.col("o_orderstatus").alias("form"), F.to_date("o_orderdate").alias("filed"),
        F.concat(F.lit("d"), F.col("o_orderkey"), F.lit(".htm")).alias("primary_doc"))


def supplier_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filing per order line's supplier, for screens that meet the monthly bars."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_suppkey").alias("cik"), F.col("o_orderkey").cast("string").alias("accn"),
        F.col("o_orderstatus").alias("form"), F.to_date("o_orderdate").alias("filed"),
        F.lit("d.htm").alias("primary_doc"))


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as the ticker map, symbols matching :func:`bars_monthly`."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("cik"), F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"))


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as dividends: rate = discount on the ship date, last line wins."""
    li = newest_wins(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_discount", *_LINE_ORDER),
                     ["l_suppkey", "l_shipdate"], _LINE_ORDER)
    return li.select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
                     F.to_date("l_shipdate").alias("ex_date"), F.col("l_discount").alias("rate"),
                     F.lit(False).alias("special"))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-quantity lines as splits with ratio one plus tax, last line wins."""
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") == 50)
    li = newest_wins(li.select("l_suppkey", "l_shipdate", "l_tax", *_LINE_ORDER), ["l_suppkey", "l_shipdate"], _LINE_ORDER)
    return li.select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
                     F.to_date("l_shipdate").alias("ex_date"), F.lit(1.0).alias("old_rate"),
                     (1.0 + F.col("l_tax")).alias("new_rate"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as fills of ten accounts in fifty symbols."""
    li = table(spark, sf_dir, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select(
        (F.col("l_suppkey") % 10).alias("account"), (F.col("l_partkey") % 50).cast("string").alias("symbol"),
        F.to_date("l_shipdate").alias("day"), order.alias("seq"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
        F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


def monthly_totals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two monthly series, from orders and from lineitem."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = o.groupBy(F.trunc(F.to_date("o_orderdate"), "MM").alias("month")).agg(
        (F.sum(cents(F.col("o_totalprice"))) / F.lit(1e12)).alias("ret_ls"))
    b = li.groupBy(F.trunc(F.to_date("l_shipdate"), "MM").alias("month")).agg(
        (F.sum(cents(F.col("l_extendedprice"))) / F.lit(1e12)).alias("ret"))
    return a, b

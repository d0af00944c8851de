"""Mixing sources to target weights by weighted fair queueing, with built-in functions only.

Every source is a queue of its documents in the order of a hash, served ``most`` times over. A
document's virtual finish time is the number of words its source has served by its end, divided
by the source's target. All documents are sorted by that time over the whole cluster and the
mix is what comes before the budget is used up: while every queue is served, a source's share
of any stretch of virtual time is its target. The document in service when its source's target
is reached (time 1; one per source) is queued as two parts, so sources meet their targets to
the word and not to the document.

Running sums over a sorted table are taken in two levels: the sort leaves a number that holds
the range and the place in it, ranges are summed up, and rows within their range. A hot source
is as many ranges as its rows need; repeated rows are told apart by an input number at the end
of the sort key, so they are spread as well, and are alike in what is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import store

#: Weights of the sources in their order, repeating; words of the mix as a share of all words; a document's most servings.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2

# Runs of anything but ASCII white space.
_WORD = r"[^\x20\x09-\x0D]+"

_BEFORE = (Window.unboundedPreceding, -1)


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``totals`` (source, source_size) with ``number``, the source's place by code point (null last), and ``target``.

    The weights share ``share`` of all words, no source gets more than ``most`` times its own,
    and what it can't take goes to the others by weight. In the order of limit to weight, a
    source is full exactly if all from it on can be raised to its level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = totals.withColumn("number", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("number", F.lit(len(weights))) + 1)).withColumn(
        "limit", most * F.col("source_size"))
    level = Window.orderBy(F.col("limit") / F.col("weight"), "number")
    leveled = numbered.withColumn("full_before", F.coalesce(F.sum("limit").over(level.rowsBetween(*_BEFORE)), F.lit(0))).withColumn(
        "weight_left", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing))).withColumn(
        "budget", share * F.sum("source_size").over(Window.partitionBy()))
    told = leveled.withColumn(
        "full", F.col("limit") * F.col("weight_left") <= (F.col("budget") - F.col("full_before")) * F.col("weight"))
    every = Window.partitionBy()
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(every), F.lit(0))
    open_ = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return told.withColumn("target", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(
        rest / open_ * F.col("weight"))).select("source", "number", "source_size", "target")


def _sorted(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` sorted over all tasks and stored with ``range``, the sorted range, and ``at``, a number in sorted order."""
    told = rows.withColumn("tie", F.monotonically_increasing_id()).orderBy(*order, "tie").drop("tie")
    told = store(told.withColumn("at", F.monotonically_increasing_id()), "sorted")
    return told.withColumn("range", F.shiftright("at", 33))


def _running(ranges: DataFrame, value: str, name: str, within: list[str]) -> DataFrame:
    """``ranges``, from :func:`_sorted`, with ``name``: the sum of ``value`` over the earlier rows of their ``within``."""
    totals = ranges.groupBy(*within, "range").agg(F.sum(value).alias("total"))
    earlier = Window.partitionBy(*within).orderBy("range").rowsBetween(*_BEFORE)
    totals = totals.select(*within, "range", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*within, "range").orderBy("at").rowsBetween(*_BEFORE)
    return ranges.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(totals, [*within, "range"]).withColumn(
        name, F.col("_before") + F.col("_own")).drop("_before", "_own", "range")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The queue in the order of service, a row per document row and serving, or part of one.

    ``row`` numbers the rows of ``docs``; ``key``, ``source``, ``size`` (words), ``source_size`` and
    ``target`` are the row's; ``serving`` counts from 0, ``first`` is the part's first word,
    ``words`` its words, ``finish`` its virtual finish time, ``place`` the words of the mix before
    it and ``taken`` how many of its words the mix takes, in the order of the text: all, none, or
    some of the part at which the budget ends. A row without words (null and blank texts) has one
    part of no words. Null sources are a source, null keys a key. Repeated rows are queued each.
    The order is a hash of key and text, so reruns agree. An empty table gives no rows. Other
    columns are not read.
    """
    hashed = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    sized = store(docs.select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"),
        F.unhex(F.md5(hashed.cast("binary"))).alias("shuffled")), "sized")
    totals = store(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    every = totals.agg(F.sum("source_size")).first()[0]
    budget = F.lit(int(share * every) if every is not None else 0)
    named = totals.withColumnRenamed("source", "of")
    queued = sized.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # In the queue of its source each row starts after the words of the earlier ones.
    queued = _running(_sorted(queued, "number", "shuffled"), "size", "start", ["number"]).drop("shuffled")

    serving = queued.withColumnRenamed("at", "row").withColumn(
        "serving", F.explode(F.sequence(F.lit(0), F.when(F.col("size") > 0, F.lit(most - 1)).otherwise(F.lit(0)))))
    low = F.col("start") + F.col("serving") * F.col("source_size")
    high, met = low + F.col("size"), F.floor("target")
    whole = (met <= low) | (met >= high)
    parts = F.when(whole, F.array(F.struct(low.alias("low"), high.alias("high")))).otherwise(
        F.array(F.struct(low.alias("low"), met.alias("high")), F.struct(met.alias("low"), high.alias("high"))))
    entries = serving.withColumn("begin", low).withColumn("part", F.explode(parts)).select(
        "row", "key", "source", "number", "size", "source_size", "target", "serving",
        (F.col("part.low") - F.col("begin")).alias("first"), (F.col("part.high") - F.col("part.low")).alias("words"),
        F.col("part.high").alias("served"),
        F.when(F.col("target") > 0, F.col("part.high") / F.col("target")).otherwise(F.lit(0.0)).alias("finish"))
    placed = _running(_sorted(entries, "finish", "number", "served"), "words", "place", [])
    return placed.withColumn("taken", F.greatest(F.lit(0), F.least("words", budget - F.col("place")))).select(
        "row", F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "serving",
        "first", "words", "finish", "place", "taken")


def taken(served: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Per row of the documents behind :func:`mix`: ``key``, ``source``, size, source_size, target and the words taken."""
    return served.groupBy("row", key, source, "size", "source_size", "target").agg(F.sum("taken").alias("taken")).drop("row")

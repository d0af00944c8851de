"""Walk-forward scoring of volatility forecasts."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.values import finite
from tidemark.schemas import require

# Fixed values.
TRADING_DAYS = 252
WINDOW = 252
HORIZON = 21
MIN_HORIZON = 3
LAMBDA = 0.94
DISAGREEMENT = "disagreement"

#: Steps whose contexts one Python group slices out of one stretch of bars.
STEPS_PER_GROUP = 64


def check_walk(window: int, horizon: int) -> None:
    for label, value, low in (("window", window, 2), ("horizon", horizon, MIN_HORIZON)):
        if isinstance(value, bool) or not isinstance(value, int):
            raise TypeError(f"{label} must be an int")
        if value < low:
            raise ValueError(f"{label} must be at least {low}")


def bar_violations(bars: DataFrame) -> DataFrame:
    """Symbols whose bars cannot be walked: symbol, bad_close, null_ts, duplicate_ts."""
    require(bars, "symbol", "ts", "close")
    bad = ~(finite(F.col("close")) & (F.col("close") > 0))
    days = bars.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("_bad"))
    return (
        days.groupBy("symbol")
        .agg(F.sum("_bad").alias("bad_close"),
             F.sum(F.when(F.col("ts").isNull(), F.col("_n")).otherwise(0)).alias("null_ts"),
             F.count_if(F.col("ts").isNotNull() & (F.col("_n") > 1)).alias("duplicate_ts"))
        .filter((F.col("bad_close") > 0) | (F.col("null_ts") > 0) | (F.col("duplicate_ts") > 0))
    )


def check_bars(bars: DataFrame) -> DataFrame:
    """Fail when any bar is unusable, naming a symbol; returns the bars."""
    worst = bar_violations(bars).head(1)
    if worst:
        raise ValueError(f"bars of {worst[0]['symbol']} have unusable rows: {worst[0].asDict()}")
    return bars


def _numbered(bars: DataFrame) -> DataFrame:
    """Bars with their 0-based position, the series length and the log return into them.

    A symbol has one bar per day, so these windows are bounded by the calendar.
    """
    by_day = W.partitionBy("symbol").orderBy("ts")
    return bars.select(
        "symbol", "ts", "close",
        (F.row_number().over(by_day) - 1).alias("pos"),
        F.count(F.lit(1)).over(W.partitionBy("symbol")).alias("_n"),
        (F.ln("close") - F.ln(F.lag("close").over(by_day))).alias("ret"),
    )


def _realized(ret: Column) -> Column:
    # One return has no sample deviation; the convention is 0.0.
    return F.coalesce(F.stddev_samp(ret), F.lit(0.0)) * math.sqrt(TRADING_DAYS)


def realized_vol(bars: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Annualised deviation of log returns per series; 0.0 below three closes."""
    logs = F.ln("close") - F.ln(F.lag("close").over(W.partitionBy(*by).orderBy("ts")))
    return bars.withColumn("_ret", logs).groupBy(*by).agg(_realized(F.col("_ret")).alias("realized_vol"))


def realized_targets(bars: DataFrame, window: int = WINDOW, horizon: int = HORIZON) -> DataFrame:
    """What is to be forecast: symbol, step, actual.

    Step k looks at rows ``[window + k*horizon, window + (k+1)*horizon)``; a
    partial last stretch is dropped. The return into the first of those rows
    comes from outside and does not count. Each row is in at most one stretch,
    so no rows are repeated.
    """
    check_walk(window, horizon)
    offset = F.col("pos") - window
    step = F.floor(offset / horizon)
    rows = _numbered(bars).filter((offset >= 0) & (window + (step + 1) * horizon <= F.col("_n")))
    inner = F.when(offset % horizon > 0, F.col("ret"))
    return rows.groupBy("symbol", step.alias("step")).agg(_realized(inner).alias("actual"))


def _checked(lambdas: Mapping[str, float] | None) -> dict[str, float]:
    chosen = {"ewma": LAMBDA} if lambdas is None else dict(lambdas)
    for name, lam in chosen.items():
        if isinstance(lam, bool) or not isinstance(lam, (int, float)):
            raise TypeError(f"{name}: lambda must be a number")
        if not 0 < lam < 1:
            raise ValueError(f"{name}: lambda must be strictly between 0 and 1")
    return chosen


#: Number, mean and sum of squared deviations of some returns.
_SPREAD = "struct<n:bigint,mean:double,m2:double>"


def _spread_of(where: Column) -> Column:
    ret = F.when(where, F.col("ret"))
    n = F.count(ret)
    return F.struct(n.alias("n"), F.coalesce(F.avg(ret), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(ret) * n, F.lit(0.0)).alias("m2"))


def _pooled(spreads: Column) -> Column:
    """Annualised deviation of all returns behind an array of spreads; 0.0 for fewer than two."""
    n = F.aggregate(spreads, F.lit(0).cast("bigint"), lambda total, s: total + s["n"])
    mean = F.aggregate(spreads, F.lit(0.0), lambda total, s: total + s["n"] * s["mean"]) / n
    m2 = F.aggregate(spreads, F.lit(0.0), lambda total, s: total + s["m2"] + s["n"] * (s["mean"] - mean) * (s["mean"] - mean))
    return F.when(n > 1, F.sqrt(m2 / (n - 1))).otherwise(0.0) * math.sqrt(TRADING_DAYS)


def walk_forward(
    bars: DataFrame, lambdas: Mapping[str, float] | None = None, window: int = WINDOW, horizon: int = HORIZON,
    trailing: str | None = "trailing",
) -> DataFrame:
    """All built-in forecasts and the outcome of every step: symbol, step, a column per forecaster, actual.

    Contexts overlap ``window / horizon`` times, so returns are not repeated for them:
    blocks of ``horizon`` rows are summed up once, and step k is put together from
    blocks k to ``k + window / horizon``. The recursion ``var = lam*var + (1-lam)*r^2``
    seeded with the first squared return is a weighted sum, to which a block that ends
    n rows before the forecast adds its own sum times ``lam^n``. At the edges, a context
    leaves out the first row of block k, whose return comes from outside, and takes the
    first ``window % horizon`` rows, the head, of its last block. ``trailing`` is
    the realised volatility of the context, pooled from the blocks' means and squared
    deviations. Everything follows one exchange by symbol.
    """
    chosen = _checked(lambdas)
    check_walk(window, horizon)
    whole, head = divmod(window, horizon)
    row, square = F.col("pos") % horizon, F.col("ret") * F.col("ret")
    # Without a whole block, the head lies in block k itself, of which the first row is left out.
    in_head = (row < head) & (row > 0) if whole == 0 else row < head

    def decayed(lam: float, where: Column, last: int) -> Column:
        return F.coalesce(F.sum(F.when(where, square * F.pow(F.lit(lam), last - row))), F.lit(0.0))

    sums = [c for i, lam in enumerate(chosen.values()) for c in (
        decayed(lam, row >= 0, horizon - 1).alias(f"all{i}"), decayed(lam, row > 0, horizon - 1).alias(f"rest{i}"),
        decayed(lam, in_head, head - 1).alias(f"head{i}"))]
    blocks = _numbered(bars).withColumn("step", F.floor(F.col("pos") / horizon)).groupBy("symbol", "step").agg(
        F.max("_n").alias("_n"), F.coalesce(F.max(F.when(row == 1, square)), F.lit(0.0)).alias("seed"), *sums,
        _spread_of(row >= 0).alias("all"), _spread_of(row > 0).alias("rest"), _spread_of(in_head).alias("head"),
        _spread_of(row < head).alias("lead"), _spread_of(row > head).alias("tail"))
    # Blocks of a symbol follow each other without gaps: b[j] is block k + j.
    names = [c for c in blocks.columns if c not in ("symbol", "step", "_n")]
    ahead = W.partitionBy("symbol").orderBy("step").rowsBetween(0, whole + 1)
    steps = blocks.select("symbol", "step", "_n", F.collect_list(F.struct(*names)).over(ahead).alias("b")).filter(
        window + (F.col("step") + 1) * horizon <= F.col("_n"))

    def variance(i: int, lam: float) -> Column:
        parts = [F.col("b")[j][f"{'rest' if j == 0 else 'all'}{i}"] * lam ** (window - (j + 1) * horizon) for j in range(whole)]
        if head:
            parts.append(F.col("b")[whole][f"head{i}"])
        return (1 - lam) * sum(parts[1:], parts[0]) + lam ** (window - 1) * F.col("b")[0]["seed"]

    context = [F.col("b")[j]["rest" if j == 0 else "all"] for j in range(whole)] + ([F.col("b")[whole]["head"]] if head else [])
    context = F.array(*[c.cast(_SPREAD) for c in context])
    known = F.aggregate(context, F.lit(0).cast("bigint"), lambda total, s: total + s["n"]) > 0
    preds = [F.when(known, F.sqrt(variance(i, lam) * TRADING_DAYS)).alias(name) for i, (name, lam) in enumerate(chosen.items())]
    if trailing:
        preds.append(_pooled(context).alias(trailing))
    # The return into the first row of a stretch comes from outside it.
    outcome = [F.col("b")[whole]["tail"]] + ([F.col("b")[whole + 1]["lead"]] if head else [])
    return steps.select("symbol", "step", *preds, _pooled(F.array(*[c.cast(_SPREAD) for c in outcome])).alias("actual"))


def _long(wide: DataFrame, names: list[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("forecaster"), F.col(n).alias("pred")) for n in names]))
    return wide.select("symbol", "step", each.alias("f")).select("f.forecaster", "symbol", "step", "f.pred")


def ewma_forecasts(
    bars: DataFrame, lambdas: Mapping[str, float] | None = None, window: int = WINDOW, horizon: int = HORIZON
) -> DataFrame:
    """Exponentially weighted volatility of each context: forecaster, symbol, step, pred."""
    return _long(walk_forward(bars, lambdas, window, horizon, None), list(_checked(lambdas)))


def trailing_forecasts(bars: DataFrame, window: int = WINDOW, horizon: int = HORIZON, name: str = "trailing") -> DataFrame:
    """Realised volatility of the context as the forecast."""
    return _long(walk_forward(bars, {}, window, horizon, name), [name])


def built_in_forecasts(
    bars: DataFrame, lambdas: Mapping[str, float] | None = None, window: int = WINDOW, horizon: int = HORIZON, trailing: str = "trailing"
) -> DataFrame:
    """Both of the above out of one pass."""
    return _long(walk_forward(bars, lambdas, window, horizon, trailing), [*_checked(lambdas), trailing])


def score_walk(wide: DataFrame, names: list[str]) -> DataFrame:
    """:func:`forecast_scores` of the built-in forecasters, straight from :func:`walk_forward` in one aggregation."""
    if not names or DISAGREEMENT in names:
        raise ValueError("name at least one forecaster, none of them by the reserved label")
    have = [n for n in names if n in wide.columns]
    preds = F.array_compact(F.array(*[F.col(n) for n in have]))
    mean = F.aggregate(preds, F.lit(0.0), lambda total, x: total + x) / F.size(preds)
    spread = F.when(F.size(preds) > 1, F.sqrt(
        F.aggregate(preds, F.lit(0.0), lambda total, x: total + (x - mean) * (x - mean)) / (F.size(preds) - 1)))
    sums = [F.struct(F.lit(n).alias("forecaster"), F.count(n).alias("n"), F.avg(F.abs(F.col(n) - F.col("actual"))).alias("mae")) for n in have]
    sums += [F.struct(F.lit(n).alias("forecaster"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("mae"))
             for n in names if n not in have]
    if len(names) > 1:
        sums.append(F.struct(F.lit(DISAGREEMENT).alias("forecaster"), F.count("_spread").alias("n"), F.avg("_spread").alias("mae")))
    rows = wide.withColumn("_spread", spread).agg(F.array(*sums).alias("_rows")).select(F.explode("_rows").alias("r")).select("r.*")
    return rows.filter((F.col("forecaster") != DISAGREEMENT) | (F.col("n") > 0))


def custom_forecasts(
    bars: DataFrame, name: str, forecast: Callable[[pd.DataFrame], float], window: int = WINDOW, horizon: int = HORIZON,
    steps_per_group: int = STEPS_PER_GROUP,
) -> DataFrame:
    """Forecasts of a caller's ``forecast(context) -> float``.

    ``context`` is a pandas frame (ts, close) of the ``window`` bars before a
    step, in order. A group is the stretch of bars that some consecutive steps
    look at, ``window + steps_per_group * horizon`` rows at most; its contexts
    are slices of it, so a bar travels about once instead of once per context.
    """
    if not isinstance(name, str) or not name.strip() or name == DISAGREEMENT:
        raise ValueError("a forecaster needs a name other than the reserved one")
    check_walk(window, horizon)
    stride = steps_per_group * horizon
    steps = F.floor((F.col("_n") - window) / horizon)
    # Group g needs rows [g * stride, window + (g + 1) * stride - horizon).
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - window + horizon) / stride))
    final = F.least(F.floor(F.col("pos") / stride), F.floor((steps - 1) / steps_per_group))
    stretches = (
        _numbered(bars).withColumn("steps", steps).filter((F.col("steps") >= 1) & (first <= final))
        .withColumn("group", F.explode(F.sequence(first, final)))
        .select("symbol", "group", "pos", "steps", "ts", "close")
    )

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        symbol, group = key
        rows = rows.sort_values("pos").reset_index(drop=True)
        bars = rows[["ts", "close"]]
        mine = range(group * steps_per_group, min((group + 1) * steps_per_group, int(rows["steps"].iloc[0])))
        preds = []
        for step in mine:
            at = step * horizon - group * stride
            value = forecast(bars.iloc[at:at + window].reset_index(drop=True))
            where = f"forecaster {name!r} at {symbol} step {step}"
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise TypeError(f"{where} returned {type(value).__name__}, expected a float")
            if not math.isfinite(value) or value < 0:
                raise ValueError(f"{where} returned {value}, expected a finite volatility")
            preds.append(float(value))
        return pd.DataFrame({"forecaster": name, "symbol": symbol, "step": list(mine), "pred": preds})

    # The adaptive planner sizes tasks by bytes and would put these small, slow groups into a few.
    tasks = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = stretches.repartition(tasks, "symbol", "group")
    return spread.groupBy("symbol", "group").applyInPandas(walk, "forecaster string, symbol string, step bigint, pred double")


def forecast_scores(forecasts: DataFrame, actuals: DataFrame, names: list[str]) -> DataFrame:
    """Mean absolute error per forecaster over all steps: forecaster, n, mae.

    A forecaster without a step has n = 0 and a null error. With two or more
    forecasters a last row holds their mean disagreement per step.

    Forecasts and outcomes meet in one grouping by step, whose exchange does not
    depend on how either frame, a union for example, says it is partitioned.
    """
    if not names or DISAGREEMENT in names:
        raise ValueError("name at least one forecaster, none of them by the reserved label")
    steps = _steps(forecasts, actuals)
    errors = F.transform(
        F.filter("preds", lambda p: p["forecaster"] != DISAGREEMENT),
        lambda p: F.struct(p["forecaster"].alias("forecaster"), F.abs(p["pred"] - F.col("actual")).alias("error")))
    spread = F.when(F.size("preds") > 1, F.array(F.struct(F.lit(DISAGREEMENT).alias("forecaster"), _spread().alias("error"))))
    every = F.concat(errors, F.coalesce(spread, F.array().cast("array<struct<forecaster:string,error:double>>")))
    sums = steps.select(F.explode(every).alias("e")).groupBy("e.forecaster").agg(
        F.count(F.lit(1)).alias("n"), F.avg("e.error").alias("mae"))
    labels = names if len(names) < 2 else [*names, DISAGREEMENT]
    # A row a forecaster on both sides.
    listed = forecasts.sparkSession.createDataFrame([(n,) for n in labels], "forecaster string")
    return listed.join(sums, "forecaster", "left").select(
        "forecaster", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "mae").filter(
        (F.col("forecaster") != DISAGREEMENT) | (F.col("n") > 0))


def _steps(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """Steps that have an outcome: symbol, step, actual and ``preds``, an array of (forecaster, pred)."""
    made = F.struct(F.col("forecaster").cast("string").alias("forecaster"), F.col("pred").cast("double").alias("pred")).alias("made")
    known = F.struct(F.col("actual").cast("double").alias("actual")).alias("known")
    rows = forecasts.select("symbol", "step", made, F.lit(None).cast("struct<actual:double>").alias("known")).union(
        actuals.select("symbol", "step", F.lit(None).cast("struct<forecaster:string,pred:double>"), known))
    # One prediction a forecaster and step: the array has as many entries as there are forecasters.
    return (
        rows.filter(F.col("symbol").isNotNull() & F.col("step").isNotNull()).groupBy("symbol", "step")
        .agg(F.collect_list("made").alias("preds"), F.max("known").alias("known"))
        .filter(F.col("known").isNotNull()).select("symbol", "step", "preds", F.col("known.actual").alias("actual"))
    )


def _spread() -> Column:
    """Sample deviation of the predictions in ``preds`` that are there; null for fewer than two."""
    values = F.filter(F.transform("preds", lambda p: p["pred"]), lambda x: x.isNotNull())
    mean = F.aggregate(values, F.lit(0.0), lambda total, x: total + x) / F.size(values)
    squares = F.aggregate(values, F.lit(0.0), lambda total, x: total + (x - mean) * (x - mean))
    return F.when(F.size(values) > 1, F.sqrt(squares / (F.size(values) - 1)))


def disagreement(forecasts: DataFrame) -> DataFrame:
    """Mean over steps of the forecasters' sample deviation, as one labelled row."""
    steps = forecasts.groupBy("symbol", "step").agg(F.stddev_samp("pred").alias("_sd"), F.count(F.lit(1)).alias("_k"))
    return (
        steps.filter(F.col("_k") > 1)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_sd").alias("mae"))
        .filter(F.col("n") > 0)
        .select(F.lit(DISAGREEMENT).alias("forecaster"), "n", "mae")
    )

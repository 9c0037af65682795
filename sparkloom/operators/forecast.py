"""Baselines, features, rolling origins, scores and residual bands; all folds and models are columns of one plan."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.panel import interval_of


def z_of(level: float) -> float:
    return NormalDist().inv_cdf(0.5 + level / 2)


def steps_before(ts: Column, step: str, n: Column | int) -> Column:
    number, unit = interval_of(step).split()
    count = F.lit(n) if isinstance(n, int) else n
    if unit.startswith("month"):
        return F.add_months(ts, -(count * int(number)).cast("int")).cast("timestamp_ntz")
    if unit.startswith("year"):
        return F.add_months(ts, -(count * 12 * int(number)).cast("int")).cast("timestamp_ntz")
    minutes = {"minute": 1, "hour": 60, "day": 1440}[unit.rstrip("s")] * int(number)
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), (count * minutes).cast("int"))


def cutoffs(panel: DataFrame, step: str, horizon: int, folds: int) -> DataFrame:
    """(fold, cutoff): fold 1 ends horizon * folds steps before the latest time of the panel."""
    end = panel.agg(F.max("ds").alias("z"))
    return end.select("z", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")).select("fold", steps_before(F.col("z"), step, (F.lit(folds + 1) - F.col("fold")) * horizon).alias("cutoff"))


def folded(panel: DataFrame, cuts: DataFrame) -> DataFrame:
    """panel rows of every fold: (fold, series, ds, y, y_was_filled, is_train, step); step counts the rows after the cutoff."""
    # a row for each fold, so literals
    each = [F.struct(F.lit(r["fold"]).alias("fold"), F.lit(r["cutoff"]).cast("timestamp_ntz").alias("cutoff")) for r in cuts.collect()]
    rows = panel.select("*", F.explode(F.array(*each)).alias("__f")).select(*panel.columns, "__f.*")
    marked = rows.withColumn("is_train", F.col("ds") <= F.col("cutoff"))
    order = Window.partitionBy("fold", "series", "is_train").orderBy("ds")
    return marked.withColumn("step", F.when(~F.col("is_train"), F.row_number().over(order))).drop("cutoff")


def training(rows: DataFrame) -> DataFrame:
    return rows.filter("is_train")


def scales(rows: DataFrame, m: int) -> DataFrame:
    """(fold, series, scale): mean |y_t - y_t-m| of the training rows; a series of up to m rows takes m = 1."""
    order = Window.partitionBy("fold", "series").orderBy("ds")
    size = F.count("*").over(Window.partitionBy("fold", "series"))
    d = training(rows).select("fold", "series", F.when(size > m, F.abs(F.col("y") - F.lag("y", m).over(order))).otherwise(F.abs(F.col("y") - F.lag("y", 1).over(order))).alias("d"))
    return d.groupBy("fold", "series").agg(F.avg("d").alias("scale"))


def baselines(rows: DataFrame, horizon: int, m: int = 1, level: float = 0.90) -> DataFrame:
    """(model, fold, series, step, yhat, lo, hi) of Naive, Drift and, for m > 1, SeasonalNaive.

    Per fold and series only the last m values and moments of differences are needed, so
    the training rows are reduced by one aggregate.
    """
    z = z_of(level)
    order = Window.partitionBy("fold", "series").orderBy("ds")
    size = F.count("*").over(Window.partitionBy("fold", "series"))
    train = training(rows).select(
        "fold", "series", "ds", "y", (F.col("y") - F.lag("y", 1).over(order)).alias("d1"),
        F.when(size > m, F.col("y") - F.lag("y", m).over(order)).otherwise(F.col("y") - F.lag("y", 1).over(order)).alias("dm"),
        F.row_number().over(order).alias("at"), size.alias("size"),
    )
    by = train.groupBy("fold", "series").agg(
        F.count("*").alias("n"), F.max_by("y", "ds").alias("last"), F.min_by("y", "ds").alias("first"), F.stddev_pop("d1").alias("s1"), F.stddev_pop("dm").alias("sm"),
        F.array_sort(F.collect_list(F.when(F.col("at") > F.col("size") - m, F.struct("at", "y")))).alias("tail"),
    )
    many = by.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    h, n = F.col("step").cast("double"), F.col("n").cast("double")
    slope = (F.col("last") - F.col("first")) / F.greatest(n - 1, F.lit(1.0))
    short = F.col("n") <= m
    cycle = F.when(short, 1).otherwise(m)
    models = [
        F.struct(F.lit("Naive").alias("model"), F.col("last").alias("yhat"), (F.lit(z) * F.col("s1") * F.sqrt(h)).alias("w")),
        F.struct(F.lit("Drift").alias("model"), (F.col("last") + slope * h).alias("yhat"), (F.lit(z) * F.col("s1") * F.sqrt(h * (1 + h / F.greatest(n - 1, F.lit(1.0))))).alias("w")),
    ]
    if m > 1:
        value = F.when(short, F.col("last")).otherwise(F.element_at("tail", (F.pmod(F.col("step") - 1, F.lit(m)) + 1).cast("int"))["y"])
        models.append(F.struct(F.lit("SeasonalNaive").alias("model"), value.alias("yhat"), (F.lit(z) * F.col("sm") * F.sqrt(F.floor((F.col("step") - 1) / cycle) + 1)).alias("w")))
    out = many.select("fold", "series", "step", F.explode(F.array(*models)).alias("p"))
    return out.select("p.model", "fold", "series", "step", "p.yhat", (F.col("p.yhat") - F.col("p.w")).alias("lo"), (F.col("p.yhat") + F.col("p.w")).alias("hi"))


def scored(rows: DataFrame, predictions: DataFrame, horizon: int, m: int) -> DataFrame:
    """(model, fold, series, n, mase, smape, wape, rmse, mae, coverage) over actual, not filled, values of the first horizon steps."""
    actual = rows.filter(~F.col("is_train") & (F.col("step") <= horizon) & ~F.col("y_was_filled")).select("fold", "series", "step", "y")
    both = actual.join(predictions, ["fold", "series", "step"]).join(scales(rows, m), ["fold", "series"], "left")
    e, size = F.abs(F.col("y") - F.col("yhat")), F.abs("y") + F.abs("yhat")
    return both.groupBy("model", "fold", "series").agg(
        F.count("*").alias("n"), F.try_divide(F.avg(e), F.max("scale")).alias("mase"), F.avg(F.when(size > 0, 2 * e / size)).alias("smape"), F.try_divide(F.sum(e), F.sum(F.abs("y"))).alias("wape"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mae"), F.avg(F.when(F.col("lo").isNotNull(), ((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("int"))).alias("coverage"),
    )


METRICS = ("mase", "smape", "wape", "rmse", "mae", "coverage")


def leaderboard(scores: DataFrame) -> DataFrame:
    """(model, metrics): the mean over series, then over folds."""
    by_fold = scores.groupBy("model", "fold").agg(*[F.avg(c).alias(c) for c in METRICS])
    return by_fold.groupBy("model").agg(*[F.avg(c).alias(c) for c in METRICS])


def blended(predictions: DataFrame, members: list[str], name: str = "Blend") -> DataFrame:
    """The members' mean as a model of its own, without an interval."""
    of = predictions.filter(F.col("model").isin(members))
    none = F.lit(None).cast("double")
    return of.groupBy("fold", "series", "step").agg(F.avg("yhat").alias("yhat")).select(F.lit(name).alias("model"), "fold", "series", "step", "yhat", none.alias("lo"), none.alias("hi"))


def residuals(rows: DataFrame, predictions: DataFrame, horizon: int) -> DataFrame:
    """(model, fold, series, step, error) of values that were not filled; a filled one leaves its step out, later steps keep their number."""
    actual = rows.filter(~F.col("is_train") & (F.col("step") <= horizon) & ~F.col("y_was_filled")).select("fold", "series", "step", "y")
    return actual.join(predictions, ["fold", "series", "step"]).select("model", "fold", "series", "step", F.abs(F.col("y") - F.col("yhat")).alias("error"))


def half_widths(errors: DataFrame, level: float = 0.90, horizon: int | None = None) -> DataFrame:
    """(model, series, step, n, width, attainable): the quantile of a series' errors at a step, no smaller than at steps before; attainable is n / (n + 1).

    A series with fewer errors than the horizon (the largest step, unless given) takes the
    quantiles over all series. Errors without a series are of one.
    """
    if "series" not in errors.columns:
        by = errors.groupBy("model", "step").agg(F.count("*").alias("n"), F.percentile("error", F.lit(level)).alias("q"))
        up = Window.partitionBy("model").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        return by.select("model", "step", "n", F.max("q").over(up).alias("width"), (F.col("n") / (F.col("n") + 1)).alias("attainable"))
    horizon = horizon or errors.agg(F.max("step")).first()[0] or 1
    of = lambda *by: errors.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("error", F.lit(level)).alias("q"))
    own = of("model", "series", "step")
    totals = own.groupBy("model", "series").agg(F.sum("n").alias("total"))
    pooled = of("model", "step").withColumnsRenamed({"n": "all_n", "q": "all_q"})
    every = totals.join(pooled, "model").join(own, ["model", "series", "step"], "left")
    enough = F.col("total") >= horizon
    used = every.select("model", "series", "step", F.when(enough, F.coalesce("n", F.lit(0))).otherwise(F.col("all_n")).alias("n"), F.when(enough, F.col("q")).otherwise(F.col("all_q")).alias("q"))
    up = Window.partitionBy("model", "series").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return used.select("model", "series", "step", "n", F.max("q").over(up).alias("width"), F.when(F.col("n") > 0, F.col("n") / (F.col("n") + 1)).alias("attainable"))


def feature_plan(m: int) -> tuple[list[int], list[int]]:
    """(lags, windows) for a season of m."""
    lags = sorted({1, 2, 3} | ({m, 2 * m} if m > 1 else {7}))
    return lags, sorted({max(m, 3), max(2 * m, 7)}) if m > 1 else [7, 28]


def lag_features(panel: DataFrame, lags: list[int], windows: list[int], by: list[str] = ("series",)) -> DataFrame:
    """panel with y_lag<l>, and y_mean<w> and y_sd<w> of the w values before a row (null unless all are there)."""
    order = Window.partitionBy(*by).orderBy("ds")
    out = panel.select("*", *[F.lag("y", k).over(order).alias(f"y_lag{k}") for k in lags])
    for w in windows:
        frame = order.rowsBetween(-w, -1)
        whole = F.count("y").over(frame) == w
        out = out.withColumn(f"y_mean{w}", F.when(whole, F.avg("y").over(frame))).withColumn(f"y_sd{w}", F.when(whole, F.stddev_samp("y").over(frame)))
    return out


def banded(forecast: DataFrame, widths: DataFrame) -> DataFrame:
    """forecast (model, series, step, yhat) with lo and hi; beyond the last known step its width holds."""
    of = [c for c in ("model", "series") if c in widths.columns]
    last = widths.groupBy(*of).agg(F.max("step").alias("last"), F.max("width").alias("top"))
    both = forecast.drop("lo", "hi").join(widths.select(*of, "step", "width"), [*of, "step"], "left").join(last, of, "left")
    w = F.coalesce("width", F.when(F.col("step") > F.col("last"), F.col("top")))
    return both.withColumn("lo", F.col("yhat") - w).withColumn("hi", F.col("yhat") + w).drop("width", "last", "top")

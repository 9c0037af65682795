"""One boosted model for all series of a panel, on lags and calendar; forecasts feed on themselves step by step."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.scalars import date_parts, holiday_flags, us_holidays
from sparkloom.operators.forecast import feature_plan, lag_features
from sparkloom.operators.panel import codes, interval_of, step_of, with_future
from sparkloom.session import settled


def calendar(df: DataFrame, step: str, years: tuple[int, int]) -> DataFrame:
    """df with the parts of its times: day of week, month, day and day of year, the hour of steps under a day, holidays and their neighbours of steps up to a day."""
    parts, (alias, _) = date_parts(F.col("ds")), step_of(step)
    names = ["dayofweek", "month", "day", *(["hour"] if alias in ("min", "h") else [])]
    out = df.select("*", *[parts[p].cast("double").alias(f"c_{p}") for p in names], F.dayofyear("ds").cast("double").alias("c_dayofyear"))
    if alias in ("min", "h", "D"):
        flags = ("is_holiday", "day_before_holiday", "day_after_holiday")
        out = holiday_flags(out.withColumn("__day", F.to_date("ds")), "__day", us_holidays(*years)).withColumnsRenamed({c: f"c_{c}" for c in flags}).drop("__day")
    return out


def forecast(train: DataFrame, step: str, horizon: int, m: int = 1, trees: int = 30, depth: int = 4, regressors: list[str] = (), future: DataFrame | None = None) -> DataFrame:
    """(series, step, ds, yhat) after training rows (series, ds, y[, regressors]); future has the regressors of the steps ahead."""
    regressors = list(regressors)
    if regressors and future is None:
        raise ValueError("regressors need their future values")
    lags, windows = feature_plan(m)
    first, last = train.agg(F.year(F.min("ds")), F.year(F.max("ds"))).first()
    years = (first, last + 1 + horizon * int(interval_of(step).split()[0]) // {"minute": 525600, "hour": 8760, "day": 365, "month": 12, "year": 1}[interval_of(step).split()[1].rstrip("s")])
    # a series' number, by its name; what a short series has no lag for is taken as its mean, in training as ahead
    number = codes(train.select("series").distinct(), "series", ["series"]).withColumnRenamed("code", "c_series")
    means = train.groupBy("series").agg(F.avg("y").alias("__mean"))
    known = settled(number.join(means, "series"))
    past = [f"y_lag{k}" for k in lags] + [f"y_mean{w}" for w in windows]

    def features(rows: DataFrame) -> DataFrame:
        out = calendar(lag_features(rows, lags, windows), step, years).join(known, "series")
        return out.withColumns({c: F.coalesce(c, "__mean") for c in past}).na.fill(0.0, [f"y_sd{w}" for w in windows]).drop("__mean")

    made = features(train.select("series", "ds", "y", *regressors))
    names = [f"y_lag{k}" for k in lags] + [x for w in windows for x in (f"y_mean{w}", f"y_sd{w}")] + [c for c in made.columns if c.startswith("c_")] + regressors
    made = made.na.drop(subset=["y", *names])
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), GBTRegressor(labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=7)]).fit(made)
    keep = max(lags + windows) + 1
    order = Window.partitionBy("series").orderBy(F.desc("ds"))
    history = train.select("series", "ds", "y", *regressors).withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= keep).drop("__r")
    out = None
    for k in range(1, horizon + 1):
        ends = history.groupBy("series").agg((F.max("ds") + F.expr(f"interval {interval_of(step)}")).cast("timestamp_ntz").alias("ds"))
        if regressors:
            ends = with_future(ends, future, regressors)
        asked = history.unionByName(ends.select("series", "ds", F.lit(None).cast("double").alias("y"), *regressors))
        new = model.transform(features(asked).filter("y is null")).select("series", "ds", F.col("prediction").alias("y"), *regressors)
        new = settled(new)  # the next step reads it many times
        history = history.unionByName(new)
        part = new.select("series", F.lit(k).alias("step"), "ds", F.col("y").alias("yhat"))
        out = part if out is None else out.unionByName(part)
    return out

"""What kind of target a column is: task, statistics, metric, objective, classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.association import quantiles


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(class, n, imbalance): imbalance is the commonest class's size over this one's."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class")).agg(F.count("*").alias("n"))
    top = Window.partitionBy(F.lit(1))
    return counts.withColumn("imbalance", F.max("n").over(top) / F.col("n"))


def without_rare(df: DataFrame, column: str, least: int) -> DataFrame:
    """Rows of the classes that have least rows or more."""
    rare = df.groupBy(column).agg(F.count("*").alias("__n")).filter(F.col("__n") < least).select(column)
    return df.join(rare, column, "left_anti")


def labelled(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """df with codes 0, 1, ... for the sorted classes. Classes are few; their table is small by the task, and its size is checked."""
    classes = df.select(column).distinct().filter(F.col(column).isNotNull())
    if classes.limit(10_001).count() > 10_000:
        raise ValueError(f"{column} has more than 10,000 classes")
    codes = classes.withColumn(name, F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(F.broadcast(codes), column, "left")


def statistics(df: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, median, sd, skew (bias-corrected), outlier_share (3 x IQR), zero_share, positive, whole, distinct."""
    y = F.col(column).cast("double")
    rows = df.filter(F.col(column).isNotNull()).select(y.alias("y"))
    edge = quantiles(rows, "y", [0.25, 0.5, 0.75])
    q1, middle, q3 = edge or [0.0, None, 0.0]
    low, high = q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)
    n = F.count("y")
    corrected = F.skewness("y") * F.sqrt(n * (n - 1)) / (n - 2)
    return rows.agg(
        n.alias("n"), F.avg("y").alias("mean"), F.lit(middle).cast("double").alias("median"), F.stddev_pop("y").alias("sd"), corrected.alias("skew"),
        (F.count_if((F.col("y") < low) | (F.col("y") > high)) / n).alias("outlier_share"),
        (F.count_if(F.col("y") == 0) / n).alias("zero_share"), (F.min("y") > 0).alias("positive"), F.every(F.col("y") == F.floor("y")).alias("whole"),
        F.count_distinct("y").alias("n_distinct"), F.min("y").alias("low"),
    )


def decided(stats: DataFrame) -> DataFrame:
    """stats with metric and objective, by rules on a row of statistics."""
    heavy = (F.abs("skew") > 2) | (F.col("outlier_share") > 0.01)
    few = F.least(F.lit(100.0), F.greatest(F.lit(10.0), F.col("n") * 0.05))
    counts = F.col("whole") & (F.col("low") >= 0) & (F.col("n_distinct") <= few)
    objective = (
        F.when(counts, "poisson")
        .when((F.col("zero_share") > 0.05) & (F.col("skew") > 1) & (F.col("low") >= 0), "tweedie")
        .when(F.col("positive") & (F.col("skew") > 2), "gamma")
        .when(F.col("positive") & (F.col("skew") > 1), "log_target")
        .otherwise("squared")
    )
    return stats.withColumn("metric", F.when(heavy, "MAE").otherwise("RMSE")).withColumn("objective", objective)


def task(df: DataFrame, column: str) -> str:
    """classification or regression: not numeric, two values, or up to twenty whole ones are classes."""
    from sparkloom.functions.scalars import is_number

    if not is_number(df.schema[column].dataType):
        return "classification"
    values = df.select(F.col(column).cast("double").alias("y")).filter("y is not null").distinct().limit(21).collect()
    if len(values) <= 2 or (len(values) <= 20 and all(r.y == int(r.y) for r in values)):
        return "classification"
    return "regression"

"""Which model to deploy: the simplest one that the best does not beat for certain."""

from __future__ import annotations

import math
from statistics import mean, stdev

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def band(best: list[float], other: list[float]) -> float:
    """One standard error of the paired differences by fold; without pairs, of the best's own scores."""
    if len(best) == len(other) and len(best) > 1:
        return stdev([a - b for a, b in zip(best, other)]) / math.sqrt(len(best))
    return stdev(best) / math.sqrt(len(best)) if len(best) > 1 else 0.0


def picked(scores: dict[str, list[float]], complexity: dict[str, int]) -> str:
    """scores by fold, higher better: of the models within a band of the best, the simplest, then the best of these."""
    top = max(scores, key=lambda s: (mean(scores[s]), -complexity.get(s, 0)))
    near = [s for s in scores if s == top or mean(scores[top]) - mean(scores[s]) <= band(scores[top], scores[s])]
    return min(near, key=lambda s: (complexity.get(s, 0), -mean(scores[s]), s))


def picked_table(scores: DataFrame, lower_is_better: bool = True) -> DataFrame:
    """(model, complexity, mean, band, is_best, is_picked) of a table (model, complexity, fold, score)."""
    sign = F.lit(-1.0 if lower_is_better else 1.0)
    s = scores.select("model", "complexity", "fold", (F.col("score") * sign).alias("s"))
    means = s.groupBy("model", "complexity").agg(F.avg("s").alias("m"))
    best = means.orderBy(F.desc("m"), "complexity", "model").limit(1).select(F.col("model").alias("best"))
    top = s.join(F.broadcast(best), s.model == best.best).select(F.col("fold").alias("tf"), F.col("s").alias("ts"))
    pairs = s.join(top, s.fold == top.tf)
    bands = pairs.groupBy("model", "complexity").agg(F.avg("s").alias("m"), F.avg("ts").alias("tm"), (F.stddev_samp(F.col("ts") - F.col("s")) / F.sqrt(F.count("*"))).alias("band"))
    near = (F.col("tm") - F.col("m")) <= F.coalesce("band", F.lit(0.0))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("near"), "complexity", F.desc("m"), "model")
    out = bands.crossJoin(F.broadcast(best)).withColumn("near", near)  # a row for each model
    return out.select("model", "complexity", (F.col("m") * sign).alias("mean"), "band", (F.col("model") == F.col("best")).alias("is_best"), (F.row_number().over(order) == 1).alias("is_picked"))

"""Strength of seasons, and which of them count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONFIRMED, SHORT = 0.10, 60


def strength(panel: DataFrame, m: int) -> DataFrame:
    """(series, n, strength) of season m in a regular panel.

    The share of the detrended variance that means by phase explain, shrunk by what m means
    explain by chance; the trend is a centred mean of m points. 0 under three seasons or
    without variance.
    """
    order = Window.partitionBy("series").orderBy("ds")
    ahead, back = (m + 1) // 2 - 1, m // 2
    frame = order.rowsBetween(-back, ahead)
    rows = panel.select("series", "y", (F.row_number().over(order) - 1).alias("at"), F.avg("y").over(frame).alias("trend"), F.count("y").over(frame).alias("in_frame"))
    least = max(3, m // 2)
    flat = rows.select("series", "at", "y", F.when(F.col("in_frame") >= least, F.col("y") - F.col("trend")).alias("d"))
    by_phase = Window.partitionBy("series", F.pmod("at", F.lit(m)))
    both = flat.withColumn("r", F.col("d") - F.avg("d").over(by_phase))
    by = both.groupBy("series").agg(F.count("*").alias("n"), F.count("d").alias("ok"), F.var_pop("d").alias("vd"), F.var_pop("r").alias("vr"), F.stddev_pop("y").alias("sd"))
    raw = F.greatest(F.lit(0.0), 1 - F.col("vr") / F.col("vd"))
    bias = F.lit(float(m)) / F.col("ok")
    usable = (F.col("n") >= 3 * m) & (F.col("sd") > 0) & (F.col("ok") >= (3 * m) // 2) & (F.col("vd") > 0) & (bias < 1)
    return by.select("series", "n", F.when(usable, F.greatest(F.lit(0.0), (raw - bias) / (1 - bias))).otherwise(0.0).alias("strength"))


def detected(panel: DataFrame, candidates: list[int]) -> DataFrame:
    """(m, strength, confirmed, is_primary): the median strength over series long enough, and the strongest confirmed season of up to 60 steps, else the strongest."""
    spark = panel.sparkSession
    rows = []
    for m in candidates:
        got = strength(panel, m).filter(F.col("n") >= 3 * m).agg(F.percentile("strength", F.lit(0.5)).alias("s")).first()["s"]
        rows.append((m, float(got or 0.0), bool(got is not None and got >= CONFIRMED)))
    good = [r for r in rows if r[2]]
    short = [r for r in good if r[0] <= SHORT] or good
    primary = max(short, key=lambda r: (r[1], -r[0]))[0] if short else 1
    return spark.createDataFrame([(*r, r[0] == primary) for r in rows], "m int, strength double, confirmed boolean, is_primary boolean")


def primary(found: DataFrame) -> int:
    row = found.filter("is_primary").first()
    return row["m"] if row else 1

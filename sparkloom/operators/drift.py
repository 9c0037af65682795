"""Population stability: reference bins of features, and the index of new data against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS, MODERATE, MAJOR, LEVELS = 1e-4, 0.10, 0.25, 20


def numeric_bins(df: DataFrame, column: str, bins: int = 10) -> list[float]:
    """Distinct decile edges; under three the feature has too little spread to be watched."""
    from sparkloom.operators.association import quantile_edges

    return quantile_edges(df.filter(F.col(column).isNotNull()), column, bins)


def numeric_shares(df: DataFrame, column: str, edges: list[float], name: str) -> DataFrame:
    """(bin, name): shares of the non-null values in [e_i, e_i+1), the last bin closed; values beyond the edges count as at them."""
    v = F.least(F.greatest(F.col(column).cast("double"), F.lit(edges[0])), F.lit(edges[-1]))
    at = F.lit(0)
    for e in edges[1:-1]:
        at = at + (v >= e).cast("int")
    counts = df.filter(F.col(column).isNotNull()).groupBy(at.cast("string").alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias(name))  # a row for each bin


def level_shares(df: DataFrame, column: str, name: str, kept: DataFrame | None = None, top: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """((bin, name), levels kept): shares of the commonest levels, null as "missing", all else as "other"."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("v")).agg(F.count("*").alias("n"))
    if kept is None:
        kept = counts.orderBy(F.desc("n"), "v").limit(top).select("v")
    marked = counts.join(F.broadcast(kept.withColumn("k", F.lit(1))), "v", "left")  # top levels
    pooled = marked.groupBy(F.when(F.col("k") == 1, F.col("v")).otherwise("other").alias("bin")).agg(F.sum("n").alias("n"))
    return pooled.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias(name)), kept


def index(reference: DataFrame, new: DataFrame, bins: DataFrame | None = None) -> DataFrame:
    """(psi) of (bin, ref) against (bin, new): shares are clipped from below and scaled to one on both sides."""
    both = reference.join(new, "bin", "full" if bins is None else "left").na.fill(0.0, ["ref", "new"])
    clipped = both.select(F.greatest("ref", F.lit(EPS)).alias("p"), F.greatest("new", F.lit(EPS)).alias("q"))
    one = Window.partitionBy(F.lit(1))
    scaled = clipped.select((F.col("p") / F.sum("p").over(one)).alias("p"), (F.col("q") / F.sum("q").over(one)).alias("q"))
    return scaled.agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def status(psi):
    return F.when(psi.isNull(), "SKIPPED").when(psi < MODERATE, "OK").when(psi < MAJOR, "MODERATE DRIFT").otherwise("MAJOR DRIFT")


def numeric_psi(reference: DataFrame, new: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(feature, psi, status) of one numeric column."""
    spark = reference.sparkSession
    if column not in new.columns:
        return spark.createDataFrame([(column, None, "MISSING COLUMN")], "feature string, psi double, status string")
    edges = numeric_bins(reference, column, bins)
    if len(edges) < 3:
        return spark.createDataFrame([(column, None, "SKIPPED")], "feature string, psi double, status string")
    if new.filter(F.col(column).isNotNull()).limit(1).count() == 0:
        return spark.createDataFrame([(column, None, "ALL MISSING")], "feature string, psi double, status string")
    every = spark.createDataFrame([(str(i),) for i in range(len(edges) - 1)], "bin string")
    ref = every.join(numeric_shares(reference, column, edges, "ref"), "bin", "left")
    psi = index(ref, numeric_shares(new, column, edges, "new"), every)
    return psi.select(F.lit(column).alias("feature"), "psi", status(F.col("psi")).alias("status"))


def level_psi(reference: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """(feature, psi, status) of one column of levels."""
    ref, kept = level_shares(reference, column, "ref")
    now, _ = level_shares(new, column, "new", kept)
    return index(ref, now).select(F.lit(column).alias("feature"), "psi", status(F.col("psi")).alias("status"))


def report(reference: DataFrame, new: DataFrame, numeric: list[str], levels: list[str]) -> DataFrame:
    """(feature, psi, status) of all watched columns, the largest first, unknown ones before."""
    parts = [numeric_psi(reference, new, c) for c in numeric] + [level_psi(reference, new, c) for c in levels]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc_nulls_first("psi"), "feature")

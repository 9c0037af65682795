"""Learned preprocessing: pooling, coding, out-of-fold target means, text hashes and weights, imputing and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.association import medians

RARE = "__rare"


def rare_limit(rows: int) -> int:
    return min(10, max(2, rows // 200))


def rare_pooled(df: DataFrame, column: str, least: int | None = None, name: str = "level") -> DataFrame:
    """df with the column's levels, those of fewer than least rows pooled."""
    least = least if least is not None else rare_limit(df.count())
    often = df.groupBy(F.col(column).alias("__l")).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least)
    return df.join(often, F.col(column) == F.col("__l"), "left").withColumn(name, F.when(F.col(column).isNotNull(), F.coalesce("__l", F.lit(RARE)))).drop("__l", "__n")


def one_hot(df: DataFrame, column: str, levels: list[str]) -> list[Column]:
    """A 0/1 column for each level; unknown levels give zeros."""
    return [F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}={v}") for v in levels]


def target_means(df: DataFrame, level: str, target: str, fold: str, smooth: float = 10.0) -> DataFrame:
    """df with encoded: the smoothed mean target of the row's level over the other folds.

    Sums by (level, fold) are joined, so a hot level is one row for each fold.
    """
    y = F.col(target).cast("double")
    by = df.groupBy(F.col(level).alias("__l"), F.col(fold).alias("__f")).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
    per_fold = by.groupBy("__f").agg(F.sum("__s").alias("fs"), F.sum("__n").alias("fn"))
    alls, alln = per_fold.agg(F.sum("fs"), F.sum("fn")).first()
    prior = per_fold.select(F.col("__f").alias("__pf"), ((F.lit(alls) - F.col("fs")) / (F.lit(alln) - F.col("fn"))).alias("__prior"))
    level_sum = Window.partitionBy("__l")
    others = by.join(prior, F.col("__f") == F.col("__pf")).select(
        "__l", "__f",
        ((F.sum("__s").over(level_sum) - F.col("__s") + smooth * F.col("__prior")) / (F.sum("__n").over(level_sum) - F.col("__n") + smooth)).alias("encoded"),
    )
    return df.join(others, F.col(level).eqNullSafe(F.col("__l")) & (F.col(fold) == F.col("__f"))).drop("__l", "__f")


def hashed_words(df: DataFrame, key: str, text: str, buckets: int = 256) -> DataFrame:
    """(key, bucket, weight): words by hash bucket, scaled to unit length for each row."""
    words = df.select(key, F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+")).alias("w")).filter("w <> ''")
    bucket = F.pmod(F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    counts = words.groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("c"))
    length = F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("c") / length).alias("weight"))


def term_weights(df: DataFrame, key: str, text: str, grams: int = 2, top: int | None = None) -> DataFrame:
    """(term, df, idf) of 1- to grams-word terms, idf = ln((1 + n) / (1 + df)) + 1; the top commonest if given."""
    n = df.count()
    words = df.select(key, F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), "").alias("w"))

    def joined(g: int) -> Column:
        starts = F.slice("w", F.lit(1), F.greatest(F.size("w") - (g - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.concat_ws(" ", x, *[F.get("w", i + j) for j in range(1, g)]))

    lists = [joined(g) for g in range(1, grams + 1)]
    terms = words.select(key, F.explode(F.array_distinct(F.concat(*lists))).alias("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("df"))
    out = counts.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)
    return out.orderBy(F.desc("df"), "term").limit(top) if top else out


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(class, n, weight): n_rows / (n_classes * n)."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"))
    rows = counts.agg(F.sum("n").alias("a"), F.count("*").alias("k")).first()
    return counts.withColumn("weight", F.lit(float(rows["a"] or 0)) / (F.lit(rows["k"]) * F.col("n")))


def imputed_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each column's nulls set to its median and the result scaled by its mean and population sd; adds name__missing."""
    middle = medians(df, columns)
    filled = df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}__missing") for c in columns])
    for c in columns:
        filled = filled.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(middle[c])))
    stats = filled.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))]).first()
    for c in columns:
        sd = stats[f"{c}__s"]
        filled = filled.withColumn(c, (F.col(c) - F.lit(stats[f"{c}__m"])) / F.lit(sd if sd else 1.0))
    return filled

"""Holdouts, folds and samples, all by hashed orders so that any engine and any run draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.scalars import hashed
from sparkloom.session import settled

#: Buckets up to which those of a sample are broadcast.
FEW = 100_000


def ranked(df: DataFrame, parts: list[str], bucket: Column, order: list, name: str = "__rank") -> DataFrame:
    """df with the rank (from 1) of each row within parts, by bucket and then order; bucket must not contradict order.

    Rows are ranked within (parts, bucket) and shifted by the sizes of the buckets before, so
    that no task sorts a whole part, however large.
    """
    with_bucket = df.withColumn("__bucket", bucket)
    counts = with_bucket.groupBy(*parts, "__bucket").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*parts).orderBy(F.asc_nulls_last("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(parts)], F.col("__bucket").alias("__b"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__shift"))
    on = F.col("__bucket").eqNullSafe(F.col("__b"))
    for i, p in enumerate(parts):
        on = on & F.col(p).eqNullSafe(F.col(f"__p{i}"))
    own = F.row_number().over(Window.partitionBy(*parts, "__bucket").orderBy(*order))
    joined = with_bucket.withColumn("__own", own).join(shifts, on)
    return joined.withColumn(name, F.col("__own") + F.col("__shift")).drop("__own", "__shift", "__b", "__bucket", *[f"__p{i}" for i in range(len(parts))])


def hash_ranked(df: DataFrame, key: Column, order: list, parts: list[str], salt: str | int) -> DataFrame:
    h = hashed(key, salt)
    return ranked(df, parts, F.substring(h, 1, 3), [h, *order])


def sizes(df: DataFrame, parts: list[str], name: str = "__size") -> DataFrame:
    """df with the number of rows of each part; counted by partial sums and joined."""
    counts = df.groupBy(*[F.col(p).alias(f"__q{i}") for i, p in enumerate(parts)]).agg(F.count("*").alias(name))
    on = F.lit(True)
    for i, p in enumerate(parts):
        on = on & F.col(p).eqNullSafe(F.col(f"__q{i}"))
    return df.join(counts, on).drop(*[f"__q{i}" for i in range(len(parts))])


def stratified_holdout(df: DataFrame, key: str, stratum: str, share: float = 0.2, salt: str | int = 42) -> DataFrame:
    """df with split: of each stratum the first round(n * share) rows in hashed order are the holdout."""
    rows = sizes(hash_ranked(df, F.col(key), [key], [stratum], salt), [stratum])
    return rows.withColumn("split", F.when(F.col("__rank") <= F.round(F.col("__size") * share), "holdout").otherwise("train")).drop("__rank", "__size")


def time_holdout(df: DataFrame, ts: str, key: str, share: float = 0.2) -> DataFrame:
    """df with split: the last max(1, floor(n * share)) rows by time, then key; rows without a time count as the latest."""
    n = df.count()
    rows = ranked(df, [], F.col(ts).cast("date"), [F.asc_nulls_last(ts), key])
    return rows.withColumn("split", F.when(F.col("__rank") <= n - max(1, int(n * share)), "train").otherwise("holdout")).drop("__rank")


def group_holdout(df: DataFrame, group: str, share: float = 0.2, salt: str | int = 42) -> DataFrame:
    """df with split: whole groups, taken in hashed order, round(n_groups * share) of them."""
    groups = df.select(group).distinct()
    n = groups.count()
    order = hash_ranked(groups, F.col(group), [group], [], salt).select(F.col(group).alias("__g"), (F.col("__rank") <= int(n * share + 0.5)).alias("__held"))
    return df.join(order, F.col(group).eqNullSafe(F.col("__g"))).withColumn("split", F.when(F.col("__held"), "holdout").otherwise("train")).drop("__held", "__g")


def folds(df: DataFrame, key: str, k: int = 5, stratum: str | None = None, salt: str | int = 42) -> DataFrame:
    """df with fold 0 to k - 1, dealt in turn in hashed order, within strata if given."""
    rows = hash_ranked(df, F.col(key), [key], [stratum] if stratum else [], salt)
    return rows.withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank")


def group_folds(df: DataFrame, group: str, k: int = 5, salt: str | int = 42) -> DataFrame:
    """df with fold: a group is in one fold, by its hash."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(hashed(F.col(group), salt), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def time_folds(df: DataFrame, ts: str, key: str, k: int = 3) -> DataFrame:
    """df with block: 0 for the rows that only train, i for the rows that test fold i, in order of time; n // (k + 1) rows each.

    Fold i trains on all rows of lower blocks.
    """
    n = df.count()
    size = max(1, n // (k + 1))
    rows = ranked(df, [], F.col(ts).cast("date"), [F.asc_nulls_last(ts), key])
    return rows.withColumn("block", F.greatest(F.lit(0), F.ceil((F.col("__rank") - (n - k * size)) / size)).cast("int")).drop("__rank")


def stratified_sample(df: DataFrame, key: list[str], stratum: str, rows: int, salt: str | int = 42) -> DataFrame:
    """About rows rows: of each stratum ceil(rows * its share), the first in hashed order."""
    n = df.count()
    code = F.substring(hashed(F.concat_ws("-", *key), salt), 1, 3)
    by = df.withColumn("__code", code)
    # only the buckets that the first rows of a stratum lie in are ranked: the others are counted, and go no further
    counts = by.groupBy(F.col(stratum).alias("__s"), F.col("__code").alias("__k")).agg(F.count("*").alias("__c"))
    before = Window.partitionBy("__s").orderBy(F.asc_nulls_last("__k")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    wanted = F.ceil(F.sum("__c").over(Window.partitionBy("__s")) * rows / F.lit(max(1, n)))
    first = counts.select("__s", "__k", wanted.alias("__wanted"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before")).filter(F.col("__before") < F.col("__wanted"))
    first = settled(first)
    if first.limit(FEW + 1).count() <= FEW:
        first = F.broadcast(first)
    some = by.join(first, F.col(stratum).eqNullSafe(F.col("__s")) & F.col("__code").eqNullSafe(F.col("__k"))).drop("__s", "__k", "__code", "__before")
    return hash_ranked(some, F.concat_ws("-", *key), list(key), [stratum], salt).filter(F.col("__rank") <= F.col("__wanted")).drop("__rank", "__wanted")

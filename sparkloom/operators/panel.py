"""Panels of time series: one long table (series, ds, y), regular grids, gaps, guardrails, hierarchies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Steps that panels can have, as Spark intervals, and candidate season lengths by step.
STEPS = {"min": "1 minute", "h": "1 hour", "D": "1 day", "W": "7 days", "MS": "1 month", "QS": "3 months", "YS": "1 year"}
OTHER_NAMES = {"t": "min", "min": "min", "h": "h", "d": "D", "w": "W", "ms": "MS", "m": "MS", "me": "MS", "qs": "QS", "q": "QS", "qe": "QS", "ys": "YS", "y": "YS", "ye": "YS", "a": "YS", "as": "YS"}
SEASONS = {"min": [60, 1440], "h": [24, 168], "D": [7, 365], "B": [5], "W": [52], "MS": [12], "QS": [4], "YS": []}


def step_of(name: str) -> tuple[str, int]:
    """(step, multiple) of a name such as D, 30min, 2h or W-SUN; what has no such name is an error."""
    found = re.fullmatch(r"(\d*)([A-Za-z]+)(-[A-Za-z]+)?", name)
    alias = found and (found[2] if found[2] in STEPS else OTHER_NAMES.get(found[2].lower()))
    if not alias or found[1] == "0":
        raise ValueError(f"no step {name}; there are {', '.join(STEPS)} and multiples of them")
    return alias, int(found[1] or 1)


def interval_of(name: str) -> str:
    """The Spark interval of a step by name."""
    alias, multiple = step_of(name)
    number, unit = STEPS[alias].split()
    return f"{int(number) * multiple} {unit}"


def season_candidates(step: str, multiple: int = 1) -> list[int]:
    """Season lengths to test, in steps; a multiple of a step divides them."""
    return [m // multiple for m in SEASONS.get(step, []) if m % multiple == 0 and m // multiple >= 2]


def wide_to_long(df: DataFrame, ds: str, series: list[str]) -> DataFrame:
    return df.unpivot([ds], series, "series", "y")


def long_to_wide(panel: DataFrame, series: list[str]) -> DataFrame:
    return panel.groupBy("ds").pivot("series", series).agg(F.first("y"))


def merged_times(panel: DataFrame, policy: str = "mean") -> DataFrame:
    """panel (series, ds, y) with one row a time: the mean of those that share it, or an error."""
    if policy == "error" and panel.groupBy("series", "ds").count().filter("count > 1").limit(1).count():
        raise ValueError("a series has two rows at one time")
    return panel.groupBy("series", "ds").agg(F.avg("y").alias("y"))


def inferred_steps(panel: DataFrame) -> DataFrame:
    """(series, seconds): the commonest distance between neighbouring times, of equal ones the smallest."""
    gaps = panel.select("series", (F.unix_seconds(F.col("ds").cast("timestamp")) - F.unix_seconds(F.lag("ds").over(Window.partitionBy("series").orderBy("ds")).cast("timestamp"))).alias("seconds")).filter("seconds > 0")
    counts = gaps.groupBy("series", "seconds").agg(F.count("*").alias("n"))
    return counts.groupBy("series").agg(F.min_by("seconds", F.struct(-F.col("n"), F.col("seconds"))).alias("seconds"))


def regular(panel: DataFrame, step: str) -> DataFrame:
    """(series, ds, y, y_was_filled) on every step from a series' first to its last time.

    A missing value is interpolated by time between its known neighbours; nothing lies beyond
    the first or the last.
    """
    ends = panel.filter("y is not null").groupBy("series").agg(F.min("ds").alias("a"), F.max("ds").alias("z"))
    grid = ends.select("series", F.explode(F.sequence("a", "z", F.expr(f"interval {interval_of(step)}"))).alias("ds"))
    seen = grid.join(panel.filter("y is not null").select("series", "ds", "y"), ["series", "ds"], "left")
    back = Window.partitionBy("series").orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("series").orderBy("ds").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("y").isNotNull(), F.col("ds"))
    marked = seen.select(
        "series", "ds", "y", F.last("y", True).over(back).alias("y0"), F.last(known, True).over(back).alias("t0"), F.first("y", True).over(ahead).alias("y1"), F.first(known, True).over(ahead).alias("t1")
    )
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp")).cast("double")
    between = F.col("y0") + (F.col("y1") - F.col("y0")) * (at("ds") - at("t0")) / (at("t1") - at("t0"))
    return marked.select("series", "ds", F.coalesce("y", between).alias("y"), F.col("y").isNull().alias("y_was_filled"))


def summary(panel: DataFrame) -> DataFrame:
    """(series, n, first, last, mean, filled_pct)."""
    return panel.groupBy("series").agg(
        F.count("*").alias("n"), F.min("ds").alias("first"), F.max("ds").alias("last"), F.avg("y").alias("mean"), (F.avg(F.col("y_was_filled").cast("int")) * 100).alias("filled_pct")
    )


def guarded(panel: DataFrame, step: str, horizon: int, max_gap: float = 0.10) -> DataFrame:
    """(series, n, n_grid, gap, sd, reason): why a series is dropped, null if it stays. panel is not yet regular."""
    by = panel.filter("y is not null").groupBy("series").agg(F.count_distinct("ds").alias("n"), F.min("ds").alias("a"), F.max("ds").alias("z"), F.stddev_pop("y").alias("sd"))
    sized = by.withColumn("n_grid", F.size(F.sequence("a", "z", F.expr(f"interval {interval_of(step)}"))))
    gap = 1 - F.col("n") / F.col("n_grid")
    least = max(2 * horizon + 10, 30)
    reason = F.when(F.col("n") < 3, "too few times").when(gap > max_gap, "too many gaps").when(F.col("n_grid") < least, "too short").when(F.col("sd") == 0, "constant")
    return sized.select("series", "n", "n_grid", gap.alias("gap"), "sd", reason.alias("reason"))


def kept(panel: DataFrame, verdict: DataFrame) -> DataFrame:
    return panel.join(verdict.filter("reason is not null").select("series"), "series", "left_anti")


def closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, leaf) of edges (parent, child): every leaf below a node, and each leaf itself."""
    edges.createOrReplaceTempView("__edges")
    return spark.sql("""
      with recursive down(node, at) as (
        select distinct parent, parent from __edges
        union all
        select d.node, e.child from down d join __edges e on d.at = e.parent)
      select distinct d.node, d.at as leaf from down d left anti join __edges e on d.at = e.parent
      union
      select child, child from (select distinct child from __edges) c left anti join __edges e on c.child = e.parent""")


def with_parents(panel: DataFrame, edges: DataFrame) -> DataFrame:
    """panel (series, ds, y) with a series for each parent: the sum of its leaves at times where all of them are there."""
    spark = panel.sparkSession
    leaves = closure(spark, edges)
    parents = leaves.join(edges.select(F.col("parent").alias("node")).distinct(), "node")
    need = parents.groupBy("node").agg(F.count("*").alias("need"))
    sums = panel.join(parents, panel.series == parents.leaf).groupBy("node", "ds").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    whole = sums.join(need, "node").filter("n = need").select(F.col("node").alias("series"), "ds", "y")
    return panel.select("series", "ds", "y").unionByName(whole)


def phase(position: Column, m: int) -> Column:
    return F.pmod(position, F.lit(m))


def codes(panel: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(column, code): levels in the order of their first row. Levels are few: a row for each is ranked, not the panel."""
    first = panel.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("__at"))
    return first.select(column, (F.row_number().over(Window.orderBy("__at", column)) - 1).alias("code"))


def filled_regressors(panel: DataFrame, columns: list[str]) -> DataFrame:
    """panel with each regressor's last known value carried forward, and the first one back to the start."""
    back = Window.partitionBy("series").orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("series").orderBy("ds").rowsBetween(0, Window.unboundedFollowing)
    filled = {c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead)) for c in columns}
    return panel.select(*[(filled[c].alias(c) if c in filled else F.col(c)) for c in panel.columns])


def with_future(asked: DataFrame, future: DataFrame, columns: list[str]) -> DataFrame:
    """asked (series, ds) with the regressors of future; a step without one is an error."""
    out = asked.join(future.select("series", "ds", *columns), ["series", "ds"], "left")
    for c in columns:
        if out.filter(F.col(c).isNull()).limit(1).count():
            raise ValueError(f"{c} is not known for every future step")
    return out

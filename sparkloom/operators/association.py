"""Associations between columns, leakage decisions and pruning of correlated features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import settled

#: Parts that a column's values are dealt in for running sums; rows up to which a quantile is left to one aggregate.
BUCKETS, AT_ONCE = 64, 200_000
#: Distinct values of a column up to which its ranks are broadcast; rows in a part where they are not.
RANKED, PART_ROWS = 200_000, 2_000_000


def running(counts: DataFrame, parts: list[str], value: str, sums: list[str]) -> DataFrame:
    """counts with before_<c> of each column c of sums: its sum over the rows of the part with a smaller value. A value has one row in a part.

    Values are dealt in buckets by approximate quantiles; a window runs within a bucket and is
    shifted by the buckets before, so that no task sorts a whole part.
    """
    shares = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    edges = counts.groupBy(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(parts)]).agg(F.percentile_approx(value, shares, F.lit(1000)).alias("__edges"))
    on = F.lit(True)
    for i, p in enumerate(parts):
        on = on & F.col(p).eqNullSafe(F.col(f"__p{i}"))
    keys = [f"__p{i}" for i in range(len(parts))]
    met = counts.join(edges, on) if parts else counts.crossJoin(F.broadcast(edges))  # one row
    dealt = met.withColumn("__bucket", F.size(F.filter("__edges", lambda e: e < F.col(value)))).drop("__edges")
    own = Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.select("*", *[F.sum(c).over(own).alias(f"__own_{c}") for c in sums])
    totals = dealt.groupBy(*keys, "__bucket").agg(*[F.sum(c).alias(f"__all_{c}") for c in sums])
    earlier = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    shifts = totals.select(*[F.col(k).alias(f"{k}s") for k in keys], F.col("__bucket").alias("__b"), *[F.sum(f"__all_{c}").over(earlier).alias(f"__shift_{c}") for c in sums])
    on = F.col("__bucket") == F.col("__b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}s"))
    zero = F.lit(0)
    return within.join(shifts, on).select(*counts.columns, *[(F.coalesce(f"__own_{c}", zero) + F.coalesce(f"__shift_{c}", zero)).alias(f"before_{c}") for c in sums])


def average_ranks(long: DataFrame, parts: list[str], value: str) -> DataFrame:
    """long with rank: the mean rank of a value's ties within parts. Ranks come from counts by value, so ties are one row there."""
    counts = long.groupBy(*parts, value).agg(F.count("*").alias("__c"))
    ranks = running(counts, parts, value, ["__c"]).select(*parts, value, (F.col("before___c") + (F.col("__c") + 1) / 2).alias("rank"))
    return long.join(ranks, [*parts, value])


def correlation(a: str, b: str) -> Column:
    """Pearson's; null without spread."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _of_pairs(df: DataFrame, pairs: list[tuple[str, str]], least: int) -> DataFrame:
    """(f1, f2, n, rho): each pair ranked over its own rows, for pairs of which one or the other is missing in places."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])).alias("p"),
    ).select("p.*").filter("x is not null and y is not null")
    x = average_ranks(long, ["f1", "f2"], "x").withColumnRenamed("rank", "rx")
    both = average_ranks(x, ["f1", "f2"], "y").withColumnRenamed("rank", "ry")
    out = both.groupBy("f1", "f2").agg(F.count("*").alias("n"), correlation("rx", "ry").alias("rho"))
    return out.withColumn("rho", F.when((F.col("n") >= least) & ~F.isnan("rho"), F.col("rho")))


def _of_whole(df: DataFrame, pairs: list[tuple[str, str]], least: int, n: int) -> DataFrame:
    """(f1, f2, n, rho) of pairs of columns without a missing value: each column is ranked once.

    Ranks are by distinct value. The rows meet the ranks by the value, column after column: few values are broadcast, for
    many the rows are dealt in parts of PART_ROWS, however many rows there are. Nothing is dealt by row.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    place = {c: i for i, c in enumerate(columns)}
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for c, i in place.items()])
    for c, i in place.items():
        counts = rows.groupBy(F.col(f"x{i}").alias("v")).agg(F.count("*").alias("c"))
        ranks = settled(running(counts, [], "v", ["c"]).select(F.col("v").alias(f"v{i}"), (F.col("before_c") + (F.col("c") + 1) / 2).alias(f"r{i}")))
        if ranks.limit(RANKED + 1).count() <= RANKED:
            ranks = F.broadcast(ranks)
        elif n > PART_ROWS:
            parts = -(-n // PART_ROWS)
            rows, ranks = rows.repartition(parts, f"x{i}"), ranks.repartition(parts, f"v{i}")
        rows = rows.join(ranks, F.col(f"x{i}") == F.col(f"v{i}")).drop(f"v{i}", f"x{i}")
    moments = rows.agg(*[correlation(f"r{place[a]}", f"r{place[b]}").alias(f"{place[a]}_{place[b]}") for a, b in pairs])
    values = [F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.lit(n).cast("long").alias("n"), F.when(F.lit(n >= least) & ~F.isnan(f"{place[a]}_{place[b]}"), F.col(f"{place[a]}_{place[b]}")).alias("rho")) for a, b in pairs]
    return moments.select(F.explode(F.array(*values)).alias("x")).select("x.*")


def _spearman(df: DataFrame, pairs: list[tuple[str, str]], least: int) -> DataFrame:
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    gaps = df.agg(F.count("*").alias("__rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"__{i}") for i, c in enumerate(columns)]).first()
    missing = {c for i, c in enumerate(columns) if gaps[f"__{i}"]}
    rest = [p for p in pairs if missing & set(p)]
    whole = [p for p in pairs if not missing & set(p)]
    names = ("f1", "f2", "n", "rho")
    out = _of_pairs(df, rest, least).select(*names) if rest else None
    if whole:
        found = _of_whole(df, whole, least, gaps["__rows"]).select(*names)
        out = found if out is None else out.unionByName(found)
    return out


def spearman_with(df: DataFrame, columns: list[str], target: str, least: int = 10) -> DataFrame:
    """(f1, f2, n, rho) of every column with the target; each column is ranked once if neither has a gap."""
    return _spearman(df, [(c, target) for c in columns], least)


def spearman_pairs(df: DataFrame, columns: list[str], least: int = 10) -> DataFrame:
    """(f1, f2, n, rho) of every pair of columns over the rows where both are there; null under least rows or without spread.

    Columns without a missing value are ranked once each, and one pass over the rows' ranks gives
    the moments of all their pairs; only pairs with a gap are ranked by themselves.
    """
    return _spearman(df, [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]], least)


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Exact quantiles by linear interpolation, over all rows that have a value; none gives none.

    Many rows are counted by value and dealt in buckets; only the buckets that hold a wanted
    place are looked through.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    n = rows.count()
    if n <= AT_ONCE:
        return rows.agg(F.percentile("v", F.array(*[F.lit(float(s)) for s in shares])).alias("e")).first()["e"] or []
    counts = settled(running(rows.groupBy("v").agg(F.count("*").alias("c")), [], "v", ["c"]))
    places = [(s * (n - 1)) for s in shares]
    wanted = sorted({x for p in places for x in (int(p), min(int(p) + 1, n - 1))})
    hit = F.lit(False)
    for w in wanted:
        hit = hit | ((F.col("before_c") <= w) & (F.col("before_c") + F.col("c") > w))
    found = [(r.before_c, r.c, r.v) for r in counts.filter(hit).collect()]  # two values at most for each share
    value = {w: next(v for b, c, v in found if b <= w < b + c) for w in wanted}
    return [value[int(p)] + (p - int(p)) * (value[min(int(p) + 1, n - 1)] - value[int(p)]) for p in places]


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The exact median of each column: all in one aggregate if rows are few, else column by column in buckets."""
    if df.count() <= AT_ONCE:
        return df.agg(*[F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(c) for c in columns]).first().asDict()
    return {c: next(iter(quantiles(df, c, [0.5])), None) for c in columns}


def quantile_edges(df: DataFrame, column: str, bins: int = 10) -> list[float]:
    """The distinct edges of bins equal shares, by linear interpolation; exact, over all rows."""
    return sorted(set(quantiles(df, column, [i / bins for i in range(bins + 1)])))


def quantile_bins(df: DataFrame, column: str, bins: int = 10, name: str = "bin") -> DataFrame:
    """df with the bin (from 0) of each value: right-closed, the first with its lower edge."""
    edges = quantile_edges(df, column, bins)
    c = F.col(column).cast("double")
    at = F.lit(0)
    for e in edges[1:-1]:
        at = at + F.when(c > e, 1).otherwise(0)
    return df.withColumn(name, F.when(c.isNotNull(), at))


def association(df: DataFrame, feature: str, target: str) -> DataFrame:
    """(n, levels, eta2): the share of the target's variance that the feature's levels explain."""
    y = F.col(target).cast("double")
    by = df.filter(F.col(target).isNotNull()).groupBy(feature).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    return _eta(by)


def explained(df: DataFrame, numbers: list[str], levels: list[str], target: str, bins: int = 64) -> DataFrame:
    """(feature, n, levels, eta2) of all features in two passes: numbers by their values, or by bins of about equal size if they have more."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    looks = [x for i, c in enumerate(numbers) for x in (F.percentile_approx(F.col(c).cast("double"), shares, F.lit(1000)).alias(f"e{i}"), F.approx_count_distinct(c).alias(f"d{i}"))]
    seen = df.agg(*looks).first() if looks else None
    sides = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in levels]
    for i, c in enumerate(numbers):
        x = F.col(c).cast("double")
        edges = sorted(set(seen[f"e{i}"] or []))
        level = x if seen[f"d{i}"] <= bins or not edges else F.when(x.isNotNull(), F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e, x=x: e < x)))
        sides.append(F.struct(F.lit(c).alias("feature"), level.cast("string").alias("level")))
    y = F.col(target).cast("double")
    long = df.filter(F.col(target).isNotNull()).select(y.alias("y"), F.explode(F.array(*sides)).alias("s")).select("y", "s.*")
    by = long.groupBy("feature", "level").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    return _eta(by, "feature")


def _eta(by: DataFrame, *parts: str) -> DataFrame:
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / total
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) / total - mean * mean
    within = F.sum(F.col("n") * F.col("v")) / total
    return by.groupBy(*parts).agg(total.alias("n"), F.count("*").alias("levels"), F.when(between + within > 0, between / (between + within)).alias("eta2"))


def leakage(scores: DataFrame, force: list[str], score_limit: float = 0.95, spearman_limit: float = 0.98) -> DataFrame:
    """scores (feature, score, spearman) with flag: leak, protected (a leak that is kept by force) or ok."""
    leak = (F.coalesce("score", F.lit(0.0)) >= score_limit) | (F.coalesce(F.abs("spearman"), F.lit(0.0)) >= spearman_limit)
    return scores.withColumn("flag", F.when(leak & F.col("feature").isin(force), "protected").when(leak, "leak").otherwise("ok"))


def pruned(pairs: list[tuple[str, str, float]], strength: dict[str, float | None], force: list[str] = (), limit: float = 0.95) -> list[tuple[str, str]]:
    """(dropped, kept) by going through the pairs of features from the closest: the one with the weaker link to the target goes.

    Features kept by force stay; a pair of them is passed over. The pairs are a row for each
    pair of columns, so the walk is on the driver.
    """
    gone: dict[str, str] = {}
    for a, b, rho in sorted((p for p in pairs if p[2] is not None and abs(p[2]) >= limit), key=lambda p: (-abs(p[2]), p[0], p[1])):
        if a in gone or b in gone:
            continue
        sa, sb = ((strength.get(x) if strength.get(x) is not None else float("-inf")) for x in (a, b))
        loser, winner = (a, b) if sa <= sb else (b, a)
        if loser in force:
            loser, winner = winner, loser
        if loser not in force:
            gone[loser] = winner
    return list(gone.items())

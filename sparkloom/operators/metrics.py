"""Scores of predictions, as aggregates: regression, classes, curves, lift, calibration, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scalars import hashed
from sparkloom.operators.association import average_ranks, quantiles, running

EPS = 1e-15


def regression(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """(by, n, rmse, mae, median_ae, r2)."""
    e = F.col(y).cast("double") - F.col(p).cast("double")
    rows = df.select(*by, F.col(y).cast("double").alias("y"), e.alias("e"))
    middle = F.percentile(F.abs("e"), F.lit(0.5))
    if not by:  # over all rows, no task holds all errors
        found = quantiles(rows.select(F.abs("e").alias("a")), "a", [0.5])
        middle = F.lit(found[0] if found else None).cast("double")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), middle.alias("median_ae"),
        (1 - F.avg(F.col("e") * F.col("e")) / F.var_pop("y")).alias("r2"),
    )


def auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """(auc): the chance that a positive row has the higher score, ties half."""
    rows = average_ranks(df.select(F.col(y).alias("y"), F.col(p).alias("p")), [], "p")
    pos, n = F.sum("y"), F.count("*")
    return rows.agg(((F.sum(F.when(F.col("y") == 1, F.col("rank"))) - pos * (pos + 1) / 2) / (pos * (n - pos))).alias("auc"))


def binary(df: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """(n, logloss, brier, accuracy, precision, recall, f1, balanced_accuracy)."""
    q = F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
    hit = (F.col(p) >= threshold).cast("int")
    rows = df.select(F.col(y).alias("y"), q.alias("q"), F.col(p).alias("p"), hit.alias("h"))
    tp, fp = F.sum(F.col("h") * F.col("y")), F.sum(F.col("h") * (1 - F.col("y")))
    fn, tn = F.sum((1 - F.col("h")) * F.col("y")), F.sum((1 - F.col("h")) * (1 - F.col("y")))
    return rows.agg(
        F.count("*").alias("n"), F.avg(-(F.col("y") * F.log("q") + (1 - F.col("y")) * F.log(1 - F.col("q")))).alias("logloss"),
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), ((tp + tn) / F.count("*")).alias("accuracy"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        ((F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)) + F.coalesce(F.try_divide(tn, tn + fp), F.lit(0.0))) / 2).alias("balanced_accuracy"),
    )


def log_loss(df: DataFrame, y: str, shares: str) -> DataFrame:
    """(logloss) of rows with a class number and an array of chances; 0 at least."""
    own = F.least(F.greatest(F.get(shares, F.col(y).cast("int")), F.lit(EPS)), F.lit(1 - EPS))
    return df.agg(F.avg(-F.log(own)).alias("logloss"))


def confusion(df: DataFrame, y: str, p: str, classes: list) -> DataFrame:
    """(actual, a column n_<class> for each predicted class)."""
    return df.groupBy(F.col(y).alias("actual")).agg(*[F.count_if(F.col(p) == c).alias(f"n_{c}") for c in classes])


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """(class, support, precision, recall, f1)."""
    long = df.select(F.explode(F.array(F.struct(F.col(y).alias("class"), F.lit(1).alias("is_y"), (F.col(y) == F.col(p)).cast("int").alias("hit"), F.lit(0).alias("is_p")),
                                       F.struct(F.col(p).alias("class"), F.lit(0).alias("is_y"), F.lit(0).alias("hit"), F.lit(1).alias("is_p")))).alias("x")).select("x.*")
    by = long.groupBy("class").agg(F.sum("is_y").alias("support"), F.sum("hit").alias("tp"), F.sum("is_p").alias("said"))
    zero = F.lit(0.0)
    return by.select(
        "class", "support", F.coalesce(F.try_divide("tp", "said"), zero).alias("precision"), F.coalesce(F.try_divide("tp", "support"), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), F.col("said") + F.col("support")), zero).alias("f1"),
    )


def score_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """(score, pos, neg) of each distinct score: what curves are made of."""
    return df.groupBy(F.col(p).alias("score")).agg(F.sum(F.col(y)).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))


def roc(df: DataFrame, y: str, p: str) -> DataFrame:
    """(score, tpr, fpr) at each distinct score as threshold."""
    counts = score_counts(df, y, p)
    pos, neg = counts.agg(F.sum("pos"), F.sum("neg")).first()
    below = running(counts, [], "score", ["pos", "neg"])
    return below.select("score", ((F.lit(pos) - F.col("before_pos")) / F.lit(pos)).alias("tpr"), ((F.lit(neg) - F.col("before_neg")) / F.lit(neg)).alias("fpr"))


def thresholds(low: int = 5, high: int = 95) -> list[int]:
    """Percent."""
    return list(range(low, high + 1))


def sweep(df: DataFrame, y: str, p: str) -> DataFrame:
    """(threshold, tp, fp, fn, tn, f1, balanced_accuracy) for thresholds .05 to .95 by .01.

    Rows are counted by the number of thresholds they reach, once; running sums give each threshold.
    """
    grid = thresholds()
    reached = F.lit(0)
    for t in grid:
        reached = reached + (F.col(p) >= F.lit(t / 100)).cast("int")
    counts = df.groupBy(reached.alias("r")).agg(F.sum(F.col(y)).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    steps = df.sparkSession.range(len(grid)).select((F.col("id") + 1).alias("need"), (F.col("id") + grid[0]).alias("t"))
    both = steps.crossJoin(F.broadcast(counts))  # 91 x 92 rows at most
    tp, fp = F.sum(F.when(F.col("r") >= F.col("need"), F.col("pos")).otherwise(0)), F.sum(F.when(F.col("r") >= F.col("need"), F.col("neg")).otherwise(0))
    by = both.groupBy("t").agg(tp.alias("tp"), fp.alias("fp"), (F.sum("pos") - tp).alias("fn"), (F.sum("neg") - fp).alias("tn"))
    zero = F.lit(0.0)
    return by.select(
        (F.col("t") / 100).alias("threshold"), "tp", "fp", "fn", "tn", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero).alias("f1"),
        ((F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero) + F.coalesce(F.try_divide("tn", F.col("tn") + F.col("fp")), zero)) / 2).alias("balanced_accuracy"),
    )


def best_threshold(swept: DataFrame, metric: str = "f1") -> DataFrame:
    """The row with the best metric, of equal ones the smallest threshold."""
    return swept.orderBy(F.desc(metric), "threshold").limit(1)


def lift(df: DataFrame, y: str, p: str, key: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_predicted, mean_actual) of equal shares in order of the score, the largest first; the first bins take what is over."""
    from sparkloom.operators.split import ranked

    n = df.count()
    if n < 10:
        return df.sparkSession.createDataFrame([], "bin int, n long, mean_predicted double, mean_actual double")
    bins = max(2, min(bins, n // 5))
    size, over = divmod(n, bins)
    rows = ranked(df, [], -F.floor(F.col(p) * 1000), [F.desc(p), key])
    at = F.col("__rank") - 1
    number = F.when(at < over * (size + 1), F.floor(at / (size + 1))).otherwise(over + F.floor((at - over * (size + 1)) / size)) + 1
    return rows.groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(y).alias("mean_actual"))


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """(bin, n, predicted, observed) by quantile bins of the score."""
    from sparkloom.operators.association import quantile_bins

    return quantile_bins(df, p, bins).groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("observed"))


def weight_of(key: Column, b: Column) -> Column:
    """How often a row is drawn in resample b: Poisson with mean 1, inverted at a hashed uniform number."""
    u = F.conv(F.substring(hashed(F.concat_ws(":", key.cast("string"), b.cast("string")), "boot"), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))
    edges = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    out = F.lit(0)
    for e in edges:
        out = out + (u >= e).cast("int")
    return out


def bootstrap(df: DataFrame, key: str, value: Column, resamples: int = 100) -> DataFrame:
    """(point, low, high, n_resamples): the mean of value and its 2.5 and 97.5 percentiles over resamples.

    Each row is weighted in every resample; partial sums by resample leave one row for each
    resample and task.
    """
    rows = df.select(F.col(key).alias("k"), value.alias("v")).filter("v is not null")
    many = rows.select("k", "v", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    w = weight_of(F.col("k"), F.col("b"))
    means = many.select("b", "v", w.alias("w")).filter("w > 0").groupBy("b").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
    point = rows.agg(F.avg("v").alias("point"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.count("*").alias("n_resamples"))
    return point.crossJoin(ends)  # one row each


def multiclass(df: DataFrame, y: str, shares: str, classes: list) -> DataFrame:
    """(n, logloss, accuracy, macro_auc) of rows with a label and an array of chances, in the order of classes.

    The area under the curve is the mean over classes of one against the rest; a class that all or no rows have is left out.
    """
    at = F.coalesce(*[F.when(F.col(y) == c, F.lit(i)) for i, c in enumerate(classes)])
    rows = df.select(at.alias("i"), F.col(shares).alias("s"))
    own = F.least(F.greatest(F.get("s", F.col("i")), F.lit(EPS)), F.lit(1 - EPS))
    top = F.array_position("s", F.array_max("s")) - 1
    base = rows.agg(F.count("*").alias("n"), F.avg(-F.log(own)).alias("logloss"), F.avg((top == F.col("i")).cast("double")).alias("accuracy"))
    long = rows.select("i", F.posexplode("s").alias("c", "p")).select("c", "p", (F.col("i") == F.col("c")).cast("int").alias("y"))
    ranked_ = average_ranks(long, ["c"], "p")
    pos, n = F.sum("y"), F.count("*")
    by = ranked_.groupBy("c").agg(F.try_divide(F.sum(F.when(F.col("y") == 1, F.col("rank"))) - pos * (pos + 1) / 2, pos * (n - pos)).alias("a"))
    return base.crossJoin(by.agg(F.avg("a").alias("macro_auc")))  # one row each

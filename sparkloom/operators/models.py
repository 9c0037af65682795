"""Model families of spark.ml on one blueprint, scored on given folds; search, blends, calibration, explanation.

Trees of spark.ml read no missing values, so numbers are imputed and flagged. There is no
forest with random thresholds, no boosting with Poisson or Tweedie loss and no tree SHAP in
spark.ml; the roster says what it has by its own names.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import HashingTF, Imputer, Normalizer, OneHotEncoder, RegexTokenizer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import metrics


@dataclass
class Columns:
    """Which columns are read how."""

    numbers: list[str] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)


def blueprint(columns: Columns, scaled: bool = False) -> list:
    """Stages to a vector column features: imputed numbers with flags, one-hot levels (unknown ones kept), hashed texts."""
    stages, parts = [], []
    if columns.numbers:
        stages.append(Imputer(strategy="median", inputCols=columns.numbers, outputCols=[f"{c}__i" for c in columns.numbers], relativeError=0.0001))
        parts += [f"{c}__i" for c in columns.numbers] + [f"{c}__missing" for c in columns.numbers]
    if columns.levels:
        index, hot = [f"{c}__x" for c in columns.levels], [f"{c}__h" for c in columns.levels]
        stages += [StringIndexer(inputCols=columns.levels, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=index, outputCols=hot, handleInvalid="keep")]
        parts += hot
    for c in columns.texts:
        stages += [RegexTokenizer(inputCol=c, outputCol=f"{c}__w", pattern=r"\s+"), HashingTF(inputCol=f"{c}__w", outputCol=f"{c}__t", numFeatures=256), Normalizer(inputCol=f"{c}__t", outputCol=f"{c}__n", p=2.0)]
        parts.append(f"{c}__n")
    stages.append(VectorAssembler(inputCols=parts, outputCol="raw" if scaled else "features", handleInvalid="keep"))
    if scaled:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=False))
    return stages


def flagged(df: DataFrame, columns: Columns) -> DataFrame:
    """df with the flags and filled levels that the blueprint reads."""
    out = df.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}__missing") for c in columns.numbers])
    for c in columns.numbers:
        out = out.withColumn(c, F.col(c).cast("double"))
    return out.na.fill("__missing", columns.levels).na.fill("", columns.texts)


class Family(NamedTuple):
    """make: the last stages for given parameters. weighted: classes weigh the same; logged: fits log(1 + label)."""

    make: Callable[[dict], object]
    scaled: bool
    complexity: int = 0
    weighted: bool = False
    logged: bool = False


#: Variants with equal class weights compete from this ratio of the largest to the smallest class on.
IMBALANCED = 5


def roster(task: str, classes: int = 2, objective: str = "squared", rows: int = 1000, absolute: bool = False, imbalance: float = 1.0) -> dict[str, Family]:
    """The families of a task by name."""
    if task == "classification":
        boosted = lambda p: GBTClassifier(labelCol="label", maxIter=p.get("trees", 40), stepSize=p.get("rate", 0.1), maxDepth=p.get("depth", 4), seed=7)
        logistic = lambda p: LogisticRegression(labelCol="label", maxIter=200, regParam=p.get("reg", 1.0 / max(rows, 1)), standardization=False)
        found = {
            "LogisticRegression": Family(logistic, True),
            "RandomForest": Family(lambda p: RandomForestClassifier(labelCol="label", numTrees=p.get("trees", 60), maxDepth=p.get("depth", 10), seed=7), False),
            "GradientBoosting": Family(boosted if classes == 2 else (lambda p: OneVsRest(classifier=boosted(p), labelCol="label")), False),
        }
        if imbalance > IMBALANCED:
            found["LogisticRegression_weighted"] = Family(lambda p: logistic(p).setWeightCol("__weight"), True, 0, True)
            if classes == 2:
                found["GradientBoosting_weighted"] = Family(lambda p: boosted(p).setWeightCol("__weight"), False, 0, True)
        return found
    boosted = lambda p: GBTRegressor(labelCol="label", maxIter=p.get("trees", 40), stepSize=p.get("rate", 0.1), maxDepth=p.get("depth", 4), lossType="absolute" if absolute else "squared", seed=7)
    found = {
        "Ridge": Family(lambda p: LinearRegression(labelCol="label", regParam=p.get("reg", 1.0 / max(rows, 1)), elasticNetParam=0.0), True),
        "ElasticNet": Family(lambda p: LinearRegression(labelCol="label", regParam=p.get("reg", 0.1), elasticNetParam=p.get("mix", 0.5)), True),
        "RandomForest": Family(lambda p: RandomForestRegressor(labelCol="label", numTrees=p.get("trees", 60), maxDepth=p.get("depth", 10), seed=7), False),
        "GradientBoosting": Family(boosted, False),
    }
    glm = {"poisson": {"family": "poisson", "link": "log"}, "gamma": {"family": "gamma", "link": "log"}, "tweedie": {"family": "tweedie", "variancePower": 1.5, "linkPower": 0.0}}
    if objective in glm:
        found[f"{objective.title()}GLM"] = Family(lambda p, g=glm[objective]: GeneralizedLinearRegression(labelCol="label", regParam=p.get("reg", 1e-3), maxIter=50, **g), True)
    if objective == "log_target":
        # scored on the label's own scale
        for name in ("GradientBoosting", "Ridge"):
            base = found[name]
            found[f"{name}_logy"] = Family(lambda p, m=base.make: m(p).setLabelCol("__log").setPredictionCol("__log_p"), base.scaled, 0, False, True)
    return found


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """df with __weight: rows over classes times the class's rows. Counts are a row for each class."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    total = sum(counts.values())
    return df.withColumn("__weight", F.coalesce(*[F.when(F.col(label) == c, F.lit(total / (len(counts) * n))) for c, n in counts.items()]))


def fitted(df: DataFrame, columns: Columns, family: Family, params: dict | None = None) -> PipelineModel:
    family = Family(*family)
    stages = [*blueprint(columns, family.scaled), family.make(params or {})]
    if family.weighted:
        df = balanced(df)
    if family.logged:
        df = df.withColumn("__log", F.log1p("label"))
        stages.append(SQLTransformer(statement="SELECT *, expm1(__log_p) AS prediction FROM __THIS__"))
    return Pipeline(stages=stages).fit(flagged(df, columns))


def predicted(model: PipelineModel, df: DataFrame, columns: Columns, task: str) -> DataFrame:
    """df with p and prediction: the chance of class 1, or the predicted value; for classes also s, the chances of all of them.

    One-against-the-rest boosting has margins; their logistic values, brought to a sum of 1, are its chances.
    """
    out = model.transform(flagged(df, columns))
    if task != "classification":
        return out.select(*df.columns, F.col("prediction").cast("double").alias("p"), "prediction")
    if "probability" in out.columns:
        shares = vector_to_array("probability")
    else:
        each = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x)))
        out = out.select(*df.columns, "prediction", each.alias("__each"))
        shares = F.transform("__each", lambda x: x / F.aggregate("__each", F.lit(0.0), lambda a, b: a + b))
    out = out.select(*df.columns, shares.alias("s"), "prediction")
    return out.select(*df.columns, F.get("s", F.lit(1)).alias("p"), "s", "prediction")


def score(df: DataFrame, task: str, metric: str = "RMSE") -> float:
    """Higher is better: minus log loss, or minus RMSE or MAE."""
    if task == "classification":
        loss = metrics.log_loss(df, "label", "s") if "s" in df.columns else metrics.binary(df, "label", "p").select("logloss")
        return -loss.first()[0]
    e = F.col("label") - F.col("p")
    return -df.agg((F.avg(F.abs(e)) if metric == "MAE" else F.sqrt(F.avg(e * e))).alias("e")).first()[0]


def trials_of(df: DataFrame, k: int, ahead: bool = False) -> list[tuple[DataFrame, DataFrame]]:
    """(train, test) of k folds 0 to k - 1; ahead: fold i = 1 to k is tested by a model of the folds before it, from 0 on."""
    if ahead:
        return [(df.filter(F.col("fold") < i), df.filter(F.col("fold") == i)) for i in range(1, k + 1)]
    return [(df.filter(F.col("fold") != f), df.filter(F.col("fold") == f)) for f in range(k)]


def screened(df: DataFrame, columns: Columns, families: dict, task: str, k: int, params: dict[str, dict] | None = None, metric: str = "RMSE", ahead: bool = False) -> dict[str, list[float]]:
    """Scores by fold of each family; one that fails on a fold is left out. df has label and fold."""
    found: dict[str, list[float]] = {}
    for name, family in families.items():
        try:
            found[name] = [score(predicted(fitted(train, columns, family, (params or {}).get(name)), test, columns, task), task, metric) for train, test in trials_of(df, k, ahead)]
        except Exception as error:  # a family that cannot be fitted is off the board, and says why
            print(f"{name} is left out: {str(error).splitlines()[0]}")
    return found


def probed_trees(df: DataFrame, columns: Columns, task: str, key: str, most: int = 100, patience: float = 0.001, time: str | None = None, params: dict | None = None) -> int:
    """How many trees to fit: a tenth more than a boosted model keeps that stops when a held-out tenth no longer gains, 10 at least. The tenth is the latest where time names a column."""
    from sparkloom.operators.split import stratified_holdout, time_holdout

    rows = df.drop("split")
    if time:
        rows = time_holdout(rows, time, key, 0.1)
    else:
        rows = stratified_holdout(rows.withColumn("__one", F.lit(1)), key, "__one", 0.1, "probe").drop("__one")
    rows = rows.withColumn("__held", F.col("split") == "holdout").drop("split")
    p = params or {}
    made = {"classification": GBTClassifier, "regression": GBTRegressor}[task](labelCol="label", maxIter=most, maxDepth=p.get("depth", 4), stepSize=p.get("rate", 0.1), seed=7, validationIndicatorCol="__held", validationTol=patience)
    model = Pipeline(stages=[*blueprint(columns), made]).fit(flagged(rows, columns))
    return max(10, int(1.1 * model.stages[-1].getNumTrees))


#: Ranges of the search: (low, high, log) or a list to choose from.
SPACES = {
    "LogisticRegression": {"reg": (1e-5, 1.0, True)},
    "Ridge": {"reg": (1e-5, 1.0, True)},
    "ElasticNet": {"reg": (1e-4, 10.0, True), "mix": (0.05, 0.95, False)},
    "RandomForest": {"trees": [40, 80, 120], "depth": [6, 10, 14]},
    "GradientBoosting": {"rate": (0.03, 0.3, True), "depth": [3, 4, 5, 6], "trees": [20, 40, 80]},
}


def drawn(space: dict, rng: random.Random) -> dict:
    out = {}
    for name, r in space.items():
        if isinstance(r, list):
            out[name] = rng.choice(r)
        else:
            low, high, log = r
            out[name] = math.exp(rng.uniform(math.log(low), math.log(high))) if log else rng.uniform(low, high)
    return out


def tuned(df: DataFrame, columns: Columns, name: str, family, task: str, k: int, trials: int, seed: int = 42, metric: str = "RMSE", ahead: bool = False) -> tuple[dict, float]:
    """(parameters, mean score): seeded random search; the defaults are scored the same way and stay unless beaten."""
    rng = random.Random(seed)
    best, top = {}, sum(screened(df, columns, {name: family}, task, k, None, metric, ahead)[name]) / k
    for _ in range(trials):
        params = drawn(SPACES.get(name.split("_")[0], {}), rng)
        scores = screened(df, columns, {name: family}, task, k, {name: params}, metric, ahead).get(name)
        if scores and sum(scores) / k > top:
            best, top = params, sum(scores) / k
    return best, top


def out_of_fold(df: DataFrame, columns: Columns, family, task: str, k: int, params: dict | None = None, ahead: bool = False) -> DataFrame:
    """df with p (and s): each row predicted by the model that did not see its fold; ahead: the first block is only learned from and has no row."""
    out = None
    for train, test in trials_of(df, k, ahead):
        part = predicted(fitted(train, columns, family, params), test, columns, task).drop("prediction")
        out = part if out is None else out.unionByName(part)
    return out


def voted(parts: list[DataFrame], key: str, classes: int = 0) -> DataFrame:
    """(key, p[, s]): the mean of the members' predictions, and of their chances of classes."""
    columns = [key, "p", *(["s"] if classes else [])]
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    shares = [F.array(*[F.avg(F.get("s", F.lit(i))) for i in range(classes)]).alias("s")] if classes else []
    return out.groupBy(key).agg(F.avg("p").alias("p"), *shares)


def side_by_side(parts: dict[str, DataFrame], key: str, classes: int = 2, carried: list[str] = ()) -> DataFrame:
    """(key, carried, features): the members' predictions as a vector; with more than two classes their chances of each."""
    wide, names = None, []
    for name, p in parts.items():
        mine = {name: F.col("p")} if classes <= 2 else {f"{name}__{i}": F.get("s", F.lit(i)) for i in range(classes)}
        names += mine
        one = p.select(key, *[c.alias(n) for n, c in mine.items()], *(carried if wide is None else []))
        wide = one if wide is None else wide.join(one, key)
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide)


def stacked(parts: dict[str, DataFrame], key: str, label: str, task: str, classes: int = 2, carried: list[str] = ()):
    """(model, frame with a column for each member): a linear model over out-of-fold predictions."""
    table = side_by_side(parts, key, classes, [label, *carried])
    return _meta(label, task).fit(table), table


def _meta(label: str, task: str):
    return LogisticRegression(labelCol=label, regParam=0.01) if task == "classification" else LinearRegression(labelCol=label, regParam=0.01)


def stack_predicted(model, table: DataFrame, task: str, *columns: str) -> DataFrame:
    """(columns, p[, s]) of a frame of members' predictions."""
    out = model.transform(table)
    if task != "classification":
        return out.select(*columns, F.col("prediction").alias("p"))
    return out.select(*columns, vector_to_array("probability").alias("s")).select(*columns, F.get("s", F.lit(1)).alias("p"), "s")


def stacked_out_of_fold(table: DataFrame, key: str, label: str, task: str, k: int) -> DataFrame:
    """(key, label, fold, p[, s]): the linear model over members, each fold by one that did not see it."""
    out = None
    for train, test in trials_of(table, k):
        part = stack_predicted(_meta(label, task).fit(train), test, task, key, label, "fold")
        out = part if out is None else out.unionByName(part)
    return out


def calibrated(oof: DataFrame, key: str) -> tuple[str, object | None, float, float]:
    """(kind, model, log loss before, after) on out-of-fold (key, label, p): fitted on one half, judged on the other; kept if 1% better."""
    from sparkloom.operators.split import folds

    halves = folds(oof.select(key, "label", "p"), key, 2, None, "calibration")
    kind = "isotonic" if halves.count() > 5000 else "platt"
    judge = halves.filter("fold = 1")
    model = calibrator(halves.filter("fold = 0"), kind)
    raw, new = metrics.binary(judge, "label", "p").first()["logloss"], metrics.binary(recalibrated(model, judge), "label", "p").first()["logloss"]
    return (kind, model, raw, new) if new < 0.99 * raw else ("none", None, raw, new)


def calibrator(rows: DataFrame, kind: str) -> PipelineModel:
    """A model of label by p: isotonic, or logistic (platt)."""
    last = IsotonicRegression(labelCol="label", featuresCol="score", predictionCol="__c") if kind == "isotonic" else LogisticRegression(labelCol="label", featuresCol="score", probabilityCol="__c", predictionCol="__cp", rawPredictionCol="__cr")
    return Pipeline(stages=[VectorAssembler(inputCols=["p"], outputCol="score"), last]).fit(rows)


def recalibrated(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with p (and s, of two classes) as the calibrator has them."""
    out = model.transform(rows)
    new = F.get(vector_to_array("__c"), F.lit(1)) if out.schema["__c"].dataType.typeName() == "vectorudt" else F.col("__c")
    p = F.least(F.greatest(new, F.lit(1e-6)), F.lit(1 - 1e-6))
    shares = [F.array(1 - p, p).alias("s")] if "s" in rows.columns else []
    return out.select(*[c for c in rows.columns if c not in ("p", "s")], p.alias("p"), *shares)


def permuted(df: DataFrame, key: str, column: str, salt: str | int) -> DataFrame:
    """df with the column's values dealt anew among the rows, in hashed order."""
    from sparkloom.operators.split import hash_ranked

    own = hash_ranked(df.drop(column), F.col(key), [key], [], "own")
    other = hash_ranked(df.select(key, column), F.col(key), [key], [], salt).select("__rank", column)
    return own.join(other, "__rank").drop("__rank")


def permutation_importance(model: PipelineModel, df: DataFrame, columns: Columns, task: str, key: str, repeats: int = 3, metric: str = "RMSE") -> list[tuple[str, float]]:
    """(feature, mean loss of score) when a column is dealt anew among the rows."""
    base = score(predicted(model, df, columns, task), task, metric)
    out = []
    for c in [*columns.numbers, *columns.levels, *columns.texts]:
        losses = [base - score(predicted(model, permuted(df, key, c, f"{c}{r}"), columns, task), task, metric) for r in range(repeats)]
        out.append((c, sum(losses) / repeats))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def partial_dependence(model: PipelineModel, df: DataFrame, columns: Columns, task: str, feature: str, points: int = 10) -> DataFrame:
    """(x, mean_prediction) with the feature set to each of its deciles in turn."""
    from sparkloom.operators.association import quantile_edges

    many = df.drop(feature).select("*", F.explode(F.array(*[F.lit(x) for x in quantile_edges(df, feature, points)])).alias(feature))
    return predicted(model, many, columns, task).groupBy(F.col(feature).alias("x")).agg(F.avg("p").alias("mean_prediction"))


def contributions(model: PipelineModel, df: DataFrame, columns: Columns, top: int = 15) -> list[tuple[str, float]]:
    """(feature, mean absolute contribution) to a linear model's margin, the largest first: coefficient times distance from the mean, which is exact for a linear model. Features that a column makes (levels, flags, hashes) are summed under it."""
    last = next(s for s in reversed(model.stages) if hasattr(s, "coefficients") or hasattr(s, "coefficientMatrix"))
    rows = model.transform(flagged(df, columns))
    meta = rows.schema["raw" if "raw" in rows.columns else "features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name", "") for group in meta.values() for a in group}
    matrix = last.coefficientMatrix.toArray() if hasattr(last, "coefficientMatrix") else [last.coefficients.toArray()]
    owners = sorted([*columns.numbers, *columns.levels, *columns.texts], key=len, reverse=True)
    weights = [max((abs(float(r[i])) for r in matrix), default=0.0) for i in range(len(matrix[0]))]
    x = rows.select(vector_to_array("features").alias("x"))
    means = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    apart = x.select(F.posexplode("x").alias("i", "v")).join(F.broadcast(means), "i").groupBy("i").agg(F.avg(F.abs(F.col("v") - F.col("m"))).alias("d"))
    found: dict[str, float] = {}
    for r in apart.collect():  # a row for each feature
        name = next((c for c in owners if names.get(r.i, "").startswith(f"{c}__")), names.get(r.i) or f"feature {r.i}")
        found[name] = found.get(name, 0.0) + weights[r.i] * r.d
    return sorted(found.items(), key=lambda t: (-t[1], t[0]))[:top]

"""A tabular run: load, split, screen for leaks, prune, compare families, tune, pick, explain, export, score."""

from __future__ import annotations

import json
import platform
from dataclasses import asdict, dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scalars import is_number, stable_key
from sparkloom.operators import association, drift, metrics, models, profile, select, split, target
from sparkloom.session import settled
from sparkloom.sources.tables import read_metadata, without_nan, write_metadata


@dataclass
class TabularSpec:
    """What a run is asked for."""

    target: str = "target"
    task: str = "auto"
    drop: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)
    holdout: float = 0.20
    folds: int = 5
    seed: int = 42
    time_column: str | None = None
    group_column: str | None = None
    rare_class: str = "drop"
    correlation: float = 0.95
    leak_score: float = 0.95
    leak_spearman: float = 0.98
    trials: int = 4
    finalists: int = 3
    policy: str = "best_score"
    stack: bool = True
    calibrate: bool = True
    explain: bool = True
    screen_rows: int = 20_000
    leak_rows: int = 20_000
    limits: profile.Limits = field(default_factory=profile.Limits)

    def checked(self) -> TabularSpec:
        if not 0.05 <= self.holdout <= 0.5:
            raise ValueError("holdout is from .05 to .5")
        if self.time_column and self.group_column:
            raise ValueError("time_column and group_column exclude each other")
        if self.task not in ("auto", "classification", "regression") or self.policy not in ("best_score", "parsimonious") or self.rare_class not in ("drop", "error"):
            raise ValueError("task, policy or rare_class is unknown")
        return replace(self, drop=list(self.drop), keep=list(self.keep))


class TabularRun:
    """Stages in order; each leaves an inspectable result, and log says what was decided."""

    def __init__(self, spec: TabularSpec):
        self.spec, self.log = spec.checked(), []

    def note(self, stage: str, text: str) -> None:
        self.log.append({"stage": stage, "decision": text})

    def load(self, df: DataFrame) -> TabularRun:
        s = self.spec
        df = without_nan(df)
        self.raw = df
        held = [c for c in (s.time_column, s.group_column) if c]
        self.recipe, self.profile = profile.prepared(df, s.target, [*s.drop, *held], s.keep, s.limits)
        self.task = target.task(df.filter(F.col(s.target).isNotNull()), s.target) if s.task == "auto" else s.task
        rows = df.filter(F.col(s.target).isNotNull()).dropDuplicates()
        if self.task == "classification":
            least = max(2 * s.folds, 10)
            left = target.without_rare(rows, s.target, least)
            if s.rare_class == "error" and left.count() < rows.count():
                raise ValueError(f"a class has fewer than {least} rows")
            rows = left
            self.classes = [r[0] for r in rows.select(F.col(s.target).cast("string")).distinct().orderBy(s.target).limit(1001).collect()]
            if len(self.classes) < 2:
                raise ValueError("fewer than two classes are left")
            code = F.coalesce(*[F.when(F.col(s.target).cast("string") == c, F.lit(float(i))) for i, c in enumerate(self.classes)])
        else:
            if not is_number(rows.schema[s.target].dataType) and rows.filter(F.expr(f"try_cast(`{s.target}` as double)").isNull()).limit(1).count():
                raise ValueError(f"the regression target {s.target} is not numeric: run it as a classification, or clean it")
            self.classes, code = [], F.expr(f"try_cast(`{s.target}` as double)")
            low, high = rows.agg(F.min(code), F.max(code)).first()
            if low == high:
                raise ValueError(f"the target {s.target} has one value: nothing to learn")
        self.rows = stable_key(rows).select("__rid", *held, code.alias("label"), *self.recipe.columns())
        self.columns = self._columns()
        self.note("load", f"{self.task}, {len(self.recipe.features)} features kept")
        return self

    def _columns(self) -> models.Columns:
        r = self.recipe
        numbers = [f"{f}__{p}" for f, parts in r.dates.items() if f in r.features for p in parts]
        numbers += [f for f in r.features if f not in r.dates and f not in r.texts and f not in r.levels]
        return models.Columns(numbers, [f for f in r.features if f in r.levels], [f for f in r.features if f in r.texts])

    @property
    def ahead(self) -> bool:
        """Whether folds are blocks of time, each tested by a model of those before it."""
        return self.spec.time_column is not None

    def folds(self, rows: DataFrame, seed: int) -> DataFrame:
        """Training rows with fold: blocks of time from 0 on, whole groups, or strata."""
        s = self.spec
        if s.time_column:
            return split.time_folds(rows, s.time_column, "__rid", s.folds).withColumnRenamed("block", "fold")
        if s.group_column:
            return split.group_folds(rows, s.group_column, s.folds, seed)
        if self.task == "classification":
            return split.folds(rows, "__rid", s.folds, "label", seed)
        return split.folds(association.quantile_bins(rows, "label", 10, "__bin"), "__rid", s.folds, "__bin", seed).drop("__bin")

    def split(self) -> TabularRun:
        s = self.spec
        if s.time_column:
            held = split.time_holdout(self.rows, s.time_column, "__rid", s.holdout)
        elif s.group_column:
            held = split.group_holdout(self.rows, s.group_column, s.holdout, s.seed)
        else:
            stratum = "label" if self.task == "classification" else "__bin"
            binned = self.rows if self.task == "classification" else association.quantile_bins(self.rows, "label", 10, "__bin")
            held = split.stratified_holdout(binned, "__rid", stratum, s.holdout, s.seed).drop("__bin")
        self.rows = settled(held)  # every fit reads it
        self.train, self.holdout = settled(self.folds(self.rows.filter("split = 'train'"), s.seed)), self.rows.filter("split = 'holdout'")
        self.imbalance = 1.0
        if self.task == "regression":
            self.stats = target.decided(target.statistics(self.train, "label")).first().asDict()
        else:
            self.stats = {"metric": "LogLoss", "objective": "logloss"}
            sizes = [r["count"] for r in self.train.groupBy("label").count().collect()]
            self.imbalance = max(sizes) / min(sizes)
        self.note("split", f"metric {self.stats['metric']}, objective {self.stats['objective']}")
        return self

    def sampled(self, rows: int) -> DataFrame:
        """Training rows to look at: all of them, or about rows of them, by class where there are classes."""
        if self.train.count() <= rows:
            return self.train
        by = self.train if self.task == "classification" else self.train.withColumn("__one", F.lit(1))
        return settled(split.stratified_sample(by, ["__rid"], "label" if self.task == "classification" else "__one", rows, self.spec.seed).drop("__one"))

    def scan(self) -> TabularRun:
        """Leaks and correlated features, on training rows alone."""
        s, numbers = self.spec, self.columns.numbers
        seen = self.sampled(s.leak_rows)
        rho = {r.f1: abs(r.rho) for r in association.spearman_with(seen, numbers, "label").collect() if r.rho is not None} if numbers else {}
        eta = {r.feature: r.eta2 for r in association.explained(seen, numbers, self.columns.levels, "label").collect()}
        strength = {c: rho.get(c) for c in numbers}
        rows = [(c, eta.get(c), strength.get(c) if self.task == "regression" else None) for c in [*numbers, *self.columns.levels]]
        spark = self.rows.sparkSession
        self.leaks = association.leakage(spark.createDataFrame(rows, "feature string, score double, spearman double"), s.keep, s.leak_score, s.leak_spearman) if rows else None
        gone = {r["feature"] for r in self.leaks.filter("flag = 'leak'").collect()} if rows else set()
        left = [c for c in numbers if c not in gone]
        pairs = [(r.f1, r.f2, r.rho) for r in association.spearman_pairs(seen, left).collect()] if len(left) > 1 else []
        gone |= {a for a, _ in association.pruned(pairs, strength, s.keep, s.correlation)}
        self.columns = models.Columns([c for c in numbers if c not in gone], [c for c in self.columns.levels if c not in gone], self.columns.texts)
        if not (self.columns.numbers or self.columns.levels or self.columns.texts):
            raise ValueError(f"every feature leaks or is redundant: {', '.join(sorted(gone))}")
        self.note("scan", f"dropped {', '.join(sorted(gone)) or 'nothing'}")
        return self

    def screen(self) -> TabularRun:
        """All families on the training rows, or a sample of them; those that lead go on."""
        s = self.spec
        seen = self.sampled(s.screen_rows)
        if self.ahead and seen is not self.train:
            seen = settled(self.folds(seen.drop("fold"), s.seed))
        self.families = models.roster(self.task, max(2, len(self.classes)), self.stats["objective"], self.train.count(), self.stats["metric"] == "MAE", self.imbalance)
        self.screening = models.screened(seen, self.columns, self.families, self.task, s.folds, None, self.stats["metric"], self.ahead)
        if not self.screening:
            raise ValueError("no family could be fitted")
        return self

    def tune(self) -> TabularRun:
        """Parameters of the finalists; a boosted one gets as many trees as a held-out part of the training rows bears."""
        s = self.spec
        order = sorted(self.screening, key=lambda n: -sum(self.screening[n]))[: s.finalists]
        self.params = {n: models.tuned(self.train, self.columns, n, self.families[n], self.task, s.folds, s.trials, s.seed, self.stats["metric"], self.ahead)[0] for n in order}
        if "GradientBoosting" in self.params and (self.task == "regression" or len(self.classes) == 2):
            p = self.params["GradientBoosting"]
            p["trees"] = models.probed_trees(self.train, self.columns, self.task, "__rid", time=s.time_column, params=p)
            self.note("tune", f"GradientBoosting stops at {p['trees']} trees")
        return self

    def decide(self) -> TabularRun:
        """Finalists, their vote and their stack on fresh folds; the pick within one standard error is always worked out."""
        s, k = self.spec, len(self.classes)
        fresh = self.train if self.ahead else settled(self.folds(self.train.drop("fold"), s.seed + 1000))
        shares = ["s"] if k else []
        parts = {n: settled(models.out_of_fold(fresh, self.columns, self.families[n], self.task, s.folds, p, self.ahead).select("__rid", "label", "fold", "p", *shares)) for n, p in self.params.items()}
        self.stacking = None
        if len(parts) > 1:
            members = dict(parts)
            vote = models.voted(list(members.values()), "__rid", k)
            parts["Vote"] = next(iter(members.values())).drop("p", "s").join(vote, "__rid")
            if s.stack and not self.ahead:
                self.stacking, table = models.stacked(members, "__rid", "label", self.task, max(2, k), ["fold"])
                parts["Stack"] = models.stacked_out_of_fold(settled(table), "__rid", "label", self.task, s.folds)
        tested = range(1, s.folds + 1) if self.ahead else range(s.folds)
        self.scores = {n: [models.score(d.filter(F.col("fold") == f), self.task, self.stats["metric"]) for f in tested] for n, d in parts.items()}
        complexity = {n: len(self.params) if n in ("Vote", "Stack") else 0 for n in parts}
        self.pick = select.picked(self.scores, complexity)
        best = max(self.scores, key=lambda n: sum(self.scores[n]))
        self.champion = best if s.policy == "best_score" else self.pick
        self.board = sorted(((n, sum(self.screening[n]) / len(self.screening[n]) if n in self.screening else None, sum(v) / len(v), "fresh folds") for n, v in self.scores.items()), key=lambda r: -r[2])
        self.calibration = None
        if s.calibrate and k == 2:
            kind, model, raw, new = models.calibrated(parts[self.champion], "__rid")
            if model is not None:
                self.calibration = models.calibrator(parts[self.champion], kind)
            self.note("decide", f"calibration {kind}: log loss {raw:.4f}, then {new:.4f}")
        self.note("decide", f"champion {self.champion}, parsimonious pick {self.pick}")
        return self

    def finish(self) -> TabularRun:
        """Holdout scores by models fitted on training rows, then a refit on all rows."""
        k = len(self.classes)
        members = list(self.params) if self.champion in ("Vote", "Stack") else [self.champion]
        fits = {n: models.fitted(self.train, self.columns, self.families[n], self.params[n]) for n in members}
        found = combined({n: models.predicted(m, self.holdout, self.columns, self.task) for n, m in fits.items()}, self.task, k, self.stacking if self.champion == "Stack" else None, self.calibration)
        joined = settled(self.holdout.select("__rid", "label").join(found, "__rid"))
        if k > 2:
            self.result = metrics.multiclass(joined, "label", "s", [float(i) for i in range(k)]).first().asDict()
        else:
            self.result = (metrics.binary(joined, "label", "p") if k else metrics.regression(joined, "label", "p")).first().asDict()
        if k == 2:
            self.result["auc"] = metrics.auc(joined, "label", "p").first()["auc"]
        suspicious = self.result.get("r2", 0) >= 0.99 or (self.result.get("auc") or self.result.get("macro_auc") or 0) >= 0.995
        self.note("finish", "scores are too good to be true: look for a leak" if suspicious else "holdout scored")
        self.importance, self.dependence, self.linear = [], {}, []
        if self.spec.explain:
            one = fits[members[0]]
            self.importance = models.permutation_importance(one, self.holdout, self.columns, self.task, "__rid", 1, self.stats["metric"])[:20]
            for f, _ in [x for x in self.importance if x[0] in self.columns.numbers][:2]:
                self.dependence[f] = [(r.x, r.mean_prediction) for r in models.partial_dependence(one, self.holdout, self.columns, self.task, f).orderBy("x").collect()]
            if any(hasattr(x, "coefficients") or hasattr(x, "coefficientMatrix") for x in one.stages):
                self.linear = models.contributions(one, self.holdout, self.columns)
        self.models = {n: models.fitted(self.rows, self.columns, self.families[n], self.params[n]) for n in members}
        return self

    def run(self, df: DataFrame) -> TabularRun:
        return self.load(df).split().scan().screen().tune().decide().finish()

    def export(self, path: str) -> None:
        """Models, recipe, reference of numeric columns and metadata in a folder; read back before it counts."""
        spark = self.rows.sparkSession
        for n, m in self.models.items():
            m.write().overwrite().save(f"{path}/models/{n}")
        if self.champion == "Stack":
            PipelineModel(stages=[self.stacking]).write().overwrite().save(f"{path}/stack")
        if self.calibration is not None:
            self.calibration.write().overwrite().save(f"{path}/calibration")
        self.rows.select(*[c for c in self.rows.columns if c not in ("label", "split", "fold", "block")]).write.mode("overwrite").parquet(f"{path}/reference")
        meta = {"task": self.task, "classes": self.classes, "members": list(self.models), "stack": self.champion == "Stack", "calibrated": self.calibration is not None, "champion": self.champion, "metric": self.stats["metric"], "objective": self.stats["objective"], "params": self.params, "screening": self.screening, "board": self.board, "importance": self.importance, "dependence": self.dependence, "contributions": self.linear, "pick": self.pick, "scores": self.scores, "holdout": self.result, "recipe": json.loads(self.recipe.to_json()), "columns": asdict(self.columns), "log": self.log, "target": self.spec.target, "versions": {"spark": spark.version, "python": platform.python_version()}}
        write_metadata(spark, meta, f"{path}/metadata")
        few = settled(self.raw.drop(self.spec.target).limit(20))
        if Scorer.load(spark, path).score(few).count() != few.count():
            raise ValueError("the exported run does not score raw rows")


def combined(parts: dict[str, DataFrame], task: str, classes: int, stack=None, calibration=None) -> DataFrame:
    """(__rid, p[, s]) of the members' predictions: their stack or their mean, recalibrated if there is a calibrator."""
    if stack is not None:
        out = models.stack_predicted(stack, models.side_by_side(parts, "__rid", max(2, classes)), task, "__rid")
    else:
        out = models.voted(list(parts.values()), "__rid", classes)
    return out if calibration is None else models.recalibrated(calibration, out)


class MissingColumns(ValueError):
    def __init__(self, missing: list[str], expected: list[str]):
        super().__init__(f"missing columns: {', '.join(missing)}")
        self.missing, self.expected = missing, expected


class Scorer:
    """An exported run: health, scores and drift of new rows."""

    def __init__(self, meta: dict, members: dict[str, PipelineModel], reference: DataFrame, stack=None, calibration=None):
        self.meta, self.members, self.reference, self.stack, self.calibration = meta, members, reference, stack, calibration
        self.recipe, self.columns = profile.Recipe(**meta["recipe"]), models.Columns(**meta["columns"])

    @classmethod
    def load(cls, spark, path: str) -> Scorer:
        meta = read_metadata(spark, f"{path}/metadata")
        stack = PipelineModel.load(f"{path}/stack").stages[0] if meta["stack"] else None
        calibration = PipelineModel.load(f"{path}/calibration") if meta["calibrated"] else None
        return cls(meta, {n: PipelineModel.load(f"{path}/models/{n}") for n in meta["members"]}, spark.read.parquet(f"{path}/reference"), stack, calibration)

    def health(self) -> dict:
        return {"ready": bool(self.members), "champion": self.meta["champion"], "features": self.recipe.features}

    def score(self, df: DataFrame, prepared: bool = False) -> DataFrame:
        """(__rid, p[, label, proba_<class> of each class]): extra columns are ignored, missing ones are named in the error. The label is the likeliest class, of equal ones the last."""
        if not prepared:
            if missing := self.recipe.missing(df):
                raise MissingColumns(missing, self.recipe.features)
            df = stable_key(without_nan(df)).select("__rid", *self.recipe.columns())
        task, classes = self.meta["task"], self.meta["classes"]
        out = combined({n: models.predicted(m, df, self.columns, task) for n, m in self.members.items()}, task, len(classes), self.stack, self.calibration)
        if not classes:
            return out
        names = F.array(*[F.lit(c) for c in classes])
        best = F.size("s") - F.array_position(F.reverse("s"), F.array_max("s"))
        return out.select("__rid", "p", F.get(names, best.cast("int")).alias("label"), *[F.get("s", F.lit(i)).alias(f"proba_{c}") for i, c in enumerate(classes)])

    def drift(self, df: DataFrame) -> DataFrame:
        new = df.select(*self.recipe.columns())
        return drift.report(self.reference, new, self.columns.numbers, self.columns.levels)


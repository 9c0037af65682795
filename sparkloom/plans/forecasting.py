"""A forecasting run: regular panel, season, backtest of all models, blend, pick, forecast with bands, reconciliation."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import forecast, globalml, panel, reconcile, season, select, statmodels
from sparkloom.session import settled
from sparkloom.sources.tables import read_metadata, write_metadata


@dataclass
class ForecastSpec:
    horizon: int = 14
    step: str = "D"
    period: int | None = None
    folds: int = 3
    level: float = 0.90
    max_gap: float = 0.10
    duplicates: str = "mean"
    models: list[str] = field(default_factory=lambda: ["ETS", "Theta", "ARIMA", "Harmonic"])
    trees: bool = True
    blend: int = 3
    hierarchy: list[tuple[str, str]] = field(default_factory=list)
    reconciliation: str = "auto"
    policy: str = "best_score"
    min_length: int | None = None
    regressors: list[str] = field(default_factory=list)

    def checked(self) -> ForecastSpec:
        if self.horizon < 1 or self.folds < 1 or not 0.5 <= self.level < 1:
            raise ValueError("horizon and folds are 1 or more, level from .5 to under 1")
        if self.reconciliation not in ("auto", "none", *reconcile.METHODS):
            raise ValueError(f"no reconciliation {self.reconciliation}")
        if self.regressors and self.hierarchy:
            raise ValueError("parents of a hierarchy have no regressors")
        return self


BASELINES = ("Naive", "SeasonalNaive", "Drift")


class ForecastRun:
    def __init__(self, spec: ForecastSpec):
        self.spec, self.log = spec.checked(), []

    def load(self, rows: DataFrame) -> ForecastRun:
        """rows (series, ds, y); a series that a guardrail drops is logged with its reason."""
        s = self.spec
        merged = panel.merged_times(rows.filter("y is not null"), s.duplicates)
        verdict = panel.guarded(merged, s.step, s.horizon, s.max_gap)
        for r in verdict.filter("reason is not null").limit(100).collect():
            self.log.append({"stage": "load", "decision": f"{r.series} is dropped: {r.reason}"})
        self.panel = panel.regular(panel.kept(merged, verdict), s.step)
        if s.regressors:
            known = rows.groupBy("series", "ds").agg(*[F.avg(c).alias(c) for c in s.regressors])
            self.panel = panel.filled_regressors(self.panel.join(known, ["series", "ds"], "left"), s.regressors)
        if s.hierarchy:
            edges = rows.sparkSession.createDataFrame(s.hierarchy, "parent string, child string")
            whole = panel.with_parents(self.panel, edges)
            filled = self.panel.select("series", "ds", "y_was_filled")
            self.panel = whole.join(filled, ["series", "ds"], "left").na.fill(False, ["y_was_filled"])
        if self.panel.limit(1).count() == 0:
            raise ValueError("no series is left")
        return self

    def seasons(self) -> ForecastRun:
        s = self.spec
        if s.period:
            self.m = s.period
        else:
            self.found = season.detected(self.panel, panel.season_candidates(*panel.step_of(s.step)))
            self.m = season.primary(self.found)
        self.log.append({"stage": "season", "decision": f"season {self.m}"})
        return self.long_enough()

    def long_enough(self) -> ForecastRun:
        """Series with three seasons, and room for all folds, stay."""
        s = self.spec
        least = s.min_length or max(3 * self.m, 2 * s.horizon + 10, 30)
        sizes = settled(self.panel.groupBy("series").agg(F.count("*").alias("n")))
        short = sizes.filter(F.col("n") < least)
        for r in short.orderBy("series").limit(100).collect():
            self.log.append({"stage": "season", "decision": f"{r.series} is dropped: {r.n} rows, a season of {self.m} needs {least}"})
        self.panel = settled(self.panel.join(short.select("series"), "series", "left_anti"))
        left = sizes.filter(F.col("n") >= least).agg(F.min("n")).first()[0]
        if left is None:
            raise ValueError(f"no series has {least} rows: name a shorter season, or give more of the past")
        if left <= s.horizon * (s.folds + 1):
            raise ValueError(f"{s.folds} folds of {s.horizon} steps need more than {s.horizon * (s.folds + 1)} rows a series; the shortest has {left}")
        return self

    def backtest(self) -> ForecastRun:
        s = self.spec
        self.rows = forecast.folded(self.panel, forecast.cutoffs(self.panel, s.step, s.horizon, s.folds))
        found = forecast.baselines(self.rows, s.horizon, self.m, s.level)
        train, beside = forecast.training(self.rows), self.panel.select("series", "ds", *s.regressors)
        for name in s.models:
            one = settled(statmodels.forecasts(train, name, s.horizon, self.m, s.level, s.regressors, beside))  # each is fitted once
            fell = one.filter("fallback").select("series").distinct().count()
            if fell:
                self.log.append({"stage": "backtest", "decision": f"{name} could not be fitted to {fell} series, which take their seasonal last values"})
            found = found.unionByName(one.drop("fallback"))
        if s.trees:
            none = F.lit(None).cast("double")
            for k in range(1, s.folds + 1):
                g = globalml.forecast(train.filter(F.col("fold") == k), s.step, s.horizon, self.m, regressors=s.regressors, future=beside)
                found = found.unionByName(g.select(F.lit("Trees").alias("model"), F.lit(k).alias("fold"), "series", "step", "yhat", none.alias("lo"), none.alias("hi")))
        found = settled(found)
        self.predictions = found
        board = forecast.leaderboard(forecast.scored(self.rows, found, s.horizon, self.m)).orderBy("mase").collect()
        if s.blend > 1 and len(board) >= s.blend:
            self.members = [r.model for r in board[: s.blend]]
            self.predictions = found.unionByName(forecast.blended(found, self.members))
        self.scores = forecast.scored(self.rows, self.predictions, s.horizon, self.m)
        self.board = forecast.leaderboard(self.scores).orderBy("mase")
        return self

    def decide(self) -> ForecastRun:
        size = F.when(F.col("model") == "Blend", self.spec.blend).when(F.col("model").isin(*BASELINES), 0).otherwise(1)
        table = self.scores.groupBy("model", "fold").agg(F.avg("mase").alias("score")).withColumn("complexity", size)
        picks = select.picked_table(table).filter("is_best or is_picked").collect()
        self.best, self.pick = next(r.model for r in picks if r.is_best), next(r.model for r in picks if r.is_picked)
        self.champion = self.best if self.spec.policy == "best_score" else self.pick
        if self.champion in BASELINES:
            self.log.append({"stage": "decide", "decision": "a baseline won: the panel may hold nothing to learn"})
        else:
            means = {r.model: r.mase for r in forecast.leaderboard(self.scores).collect()}
            base = min((v for k, v in means.items() if k in BASELINES and v is not None), default=None)
            if base is not None and means.get(self.champion) is not None and means[self.champion] > 0.95 * base:
                self.log.append({"stage": "decide", "decision": f"{self.champion} is less than 5% better than a baseline ({means[self.champion]:.3f}, {base:.3f})"})
        self.widths = forecast.half_widths(forecast.residuals(self.rows, self.predictions.filter(F.col("model") == self.champion), self.spec.horizon), self.spec.level, self.spec.horizon)
        low = self.widths.agg(F.min("attainable")).first()[0]
        if low is not None and low < self.spec.level:
            self.log.append({"stage": "decide", "decision": f"bands can cover {low:.0%} at most with these residuals"})
        return self

    def forecast(self, future: DataFrame | None = None) -> DataFrame:
        """(series, ds, step, yhat, lo, hi) after the panel's end, reconciled if a hierarchy is given; future has the regressors (series, ds) of those steps."""
        s = self.spec
        if s.regressors and future is None:
            raise ValueError("regressors need their future values")
        train = self.panel.withColumn("fold", F.lit(0)).withColumn("is_train", F.lit(True)).withColumn("step", F.lit(None).cast("int"))
        names = self.members if self.champion == "Blend" else [self.champion]
        parts = None
        for name in names:
            if name in BASELINES:
                p = forecast.baselines(train, s.horizon, self.m, s.level).filter(F.col("model") == name).select("series", "step", "yhat")
            elif name == "Trees":
                p = globalml.forecast(train, s.step, s.horizon, self.m, regressors=s.regressors, future=future).select("series", "step", "yhat")
            else:
                p = statmodels.forecasts(train, name, s.horizon, self.m, s.level, s.regressors, future).select("series", "step", "yhat")
            parts = p if parts is None else parts.unionByName(p)
        mean = parts.groupBy("series", "step").agg(F.avg("yhat").alias("yhat")).withColumn("model", F.lit(self.champion))
        out = forecast.banded(mean, self.widths)
        if s.hierarchy and s.reconciliation != "none":
            order = sorted(r.series for r in self.panel.select("series").distinct().collect())
            leaves, matrix = reconcile.summing(s.hierarchy, order)
            method = self._method(order, leaves, matrix) if s.reconciliation == "auto" else s.reconciliation
            self.log.append({"stage": "reconcile", "decision": method})
            errors = self._errors(order) if method == "mint_shrink" else None
            out = reconcile.applied(out, reconcile.projection(matrix, leaves, order, method, errors), order)
        ends = self.panel.groupBy("series").agg(F.max("ds").alias("z"))
        ds = forecast.steps_before(F.col("z"), s.step, -F.col("step")).alias("ds")
        return out.join(ends, "series").select("series", ds, "step", "yhat", "lo", "hi")

    def _signed(self) -> DataFrame:
        p = self.predictions.filter(F.col("model") == self.champion)
        actual = self.rows.filter(~F.col("is_train") & (F.col("step") <= self.spec.horizon) & ~F.col("y_was_filled")).select("fold", "series", "step", "y")
        return actual.join(p, ["fold", "series", "step"]).select("fold", "step", "series", (F.col("y") - F.col("yhat")).alias("error"))

    def _errors(self, order: list[str], without: int | None = None):
        rows = self._signed()
        return reconcile.error_matrix(rows.filter(F.col("fold") != without) if without is not None else rows, order)

    def _method(self, order, leaves, matrix) -> str:
        """The method with the lowest MASE on the champion's folds; MinT leaves the scored fold out."""
        found = {}
        for method in reconcile.METHODS:
            p = None
            for k in range(1, self.spec.folds + 1):
                errors = self._errors(order, k if self.spec.folds > 1 else None) if method == "mint_shrink" else None
                one = reconcile.applied(self.predictions.filter((F.col("model") == self.champion) & (F.col("fold") == k)), reconcile.projection(matrix, leaves, order, method, errors), order)
                p = one if p is None else p.unionByName(one)
            found[method] = forecast.leaderboard(forecast.scored(self.rows, p, self.spec.horizon, self.m)).first()["mase"]
        return min(found, key=lambda k: (found[k], k))

    def export(self, path: str, forecast_: DataFrame, future: DataFrame | None = None) -> None:
        """The forecast, the panel, the widths and what was decided, in a folder; load() forecasts anew from it."""
        spark = self.panel.sparkSession
        forecast_.write.mode("overwrite").parquet(f"{path}/forecast")
        self.panel.write.mode("overwrite").parquet(f"{path}/panel")
        self.widths.write.mode("overwrite").parquet(f"{path}/widths")
        meta = {"spec": asdict(self.spec), "season": self.m, "champion": self.champion, "pick": self.pick, "members": getattr(self, "members", []), "log": self.log}
        write_metadata(spark, meta, f"{path}/metadata")
        if not ForecastRun.loaded(spark, path).forecast(future).limit(1).count():
            raise ValueError("the exported run gives no forecast")

    @classmethod
    def loaded(cls, spark, path: str, horizon: int | None = None) -> ForecastRun:
        """An exported run, to forecast with; it is not reconciled again. Beyond the horizon it was scored for, the last width holds."""
        meta = read_metadata(spark, f"{path}/metadata")
        spec = {**meta["spec"], "hierarchy": [], "reconciliation": "none", "horizon": horizon or meta["spec"]["horizon"]}
        run = cls(ForecastSpec(**spec))
        run.panel, run.widths = spark.read.parquet(f"{path}/panel"), spark.read.parquet(f"{path}/widths")
        run.m, run.champion, run.pick, run.members = meta["season"], meta["champion"], meta["pick"], meta["members"]
        return run

    def run(self, rows: DataFrame, future: DataFrame | None = None) -> DataFrame:
        return self.load(rows).seasons().backtest().decide().forecast(future)

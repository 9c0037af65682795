"""Whole runs of several classes, in time and by groups; bands by series; exact quantiles in buckets."""

import math

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import association, forecast, metrics, models, panel, split
from sparkloom.plans.forecasting import ForecastRun, ForecastSpec
from sparkloom.plans.tabular import Scorer, TabularRun, TabularSpec


def few(monkeypatch, *names):
    every = models.roster
    monkeypatch.setattr(models, "roster", lambda *a: {n: f for n, f in every(*a).items() if n in names})


def test_a_run_of_three_classes(spark, tmp_path, monkeypatch):
    few(monkeypatch, "LogisticRegression", "RandomForest")
    rows = spark.range(360).select(F.randn(1).alias("x1"), F.randn(2).alias("x2"), (F.col("id") % 3).alias("k"))
    rows = rows.select((F.col("x1") + 2.5 * F.col("k")).alias("x1"), "x2", F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("top")), (F.col("k") + 1).cast("int")).alias("y"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    run = TabularRun(TabularSpec(target="y", folds=2, trials=0, finalists=2, explain=False)).run(rows)
    assert all(s < 0 for scores in run.scores.values() for s in scores) and {"Vote", "Stack"} <= set(run.scores)
    assert run.result["logloss"] >= 0 and run.result["accuracy"] > 0.75 and run.result["macro_auc"] > 0.85
    run.export(str(tmp_path / "a"))
    got = Scorer.load(spark, str(tmp_path / "a")).score(rows)
    assert {"label", "proba_low", "proba_mid", "proba_top"} <= set(got.columns)
    for r in got.limit(20).collect():
        shares = {c: r[f"proba_{c}"] for c in ("low", "mid", "top")}
        assert sum(shares.values()) == pytest.approx(1) and shares[r.label] == max(shares.values())


def test_boosting_of_three_classes_has_chances(spark):
    rows = spark.range(90).select(F.col("id").cast("string").alias("__rid"), (F.col("id") % 3).cast("double").alias("label"), ((F.col("id") % 3) + F.rand(1) * 0.5).alias("x"))
    columns = models.Columns(["x"])
    got = models.predicted(models.fitted(rows, columns, models.roster("classification", 3)["GradientBoosting"], {"trees": 3}), rows, columns, "classification")
    assert all(sum(r.s) == pytest.approx(1) and len(r.s) == 3 for r in got.collect()) and 0 <= metrics.log_loss(got, "label", "s").first()[0] < 0.7


def test_a_run_in_time_learns_from_the_past_alone(spark, monkeypatch):
    few(monkeypatch, "Ridge")
    rows = spark.range(300).select(F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("t"), F.randn(1).alias("x"), "id")
    rows = rows.withColumn("y", 3 * F.col("x") + F.randn(2) * 1.5).drop("id")
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    run = TabularRun(TabularSpec(target="y", task="regression", time_column="t", folds=3, trials=0, finalists=1, explain=False)).load(rows).split()
    assert run.holdout.agg(F.min("t")).first()[0] > run.train.agg(F.max("t")).first()[0]
    for train, test in models.trials_of(run.train, 3, run.ahead):
        assert train.agg(F.max("t")).first()[0] < test.agg(F.min("t")).first()[0]
    run.scan().screen().tune().decide().finish()
    assert len(run.scores["Ridge"]) == 3 and run.result["rmse"] < 2.5


def test_groups_are_whole_on_fresh_folds(spark):
    rows = spark.range(200).select((F.col("id") % 40).alias("g"), F.randn(1).alias("x"), F.randn(2).alias("y"))
    run = TabularRun(TabularSpec(target="y", group_column="g", folds=3)).load(spark.createDataFrame(rows.collect(), rows.schema)).split()
    fresh = run.folds(run.train.drop("fold"), 1042)
    for df in (run.train, fresh):
        assert df.groupBy("g").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    assert run.train.join(run.holdout, "g", "left_semi").count() == 0


def test_the_decided_metric_is_used(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0), (0.0, 9.0)], "label double, p double")
    assert models.score(rows, "regression", "MAE") == pytest.approx(-3) and models.score(rows, "regression") == pytest.approx(-math.sqrt(27))


def test_a_regression_target_has_to_be_numeric(spark):
    rows = spark.createDataFrame([(float(i), "abc" if i == 7 else str(i)) for i in range(30)], "x double, y string")
    with pytest.raises(ValueError, match="not numeric"):
        TabularRun(TabularSpec(target="y", task="regression")).load(rows)
    with pytest.raises(ValueError, match="one value"):
        TabularRun(TabularSpec(target="y", task="regression")).load(rows.withColumn("y", F.lit(2.0)))


def test_variants_that_compete(spark):
    rows = spark.range(300).select(F.randn(1).alias("x"), F.lit("a").alias("c"), (F.col("id") % 12 == 0).cast("double").alias("label"))
    assert "LogisticRegression_weighted" in models.roster("classification", 2, "logloss", 300, False, 11.0)
    columns = models.Columns(["x"])
    plain, heavy = (models.predicted(models.fitted(rows, columns, models.roster("classification", 2, "logloss", 300, False, 11.0)[n]), rows, columns, "classification").agg(F.avg("p")).first()[0] for n in ("LogisticRegression", "LogisticRegression_weighted"))
    assert plain == pytest.approx(1 / 12, abs=0.01) and heavy == pytest.approx(0.5, abs=0.05)
    skewed = rows.select("x", F.exp(2 + F.col("x")).alias("label"))
    family = models.roster("regression", 2, "log_target")["Ridge_logy"]
    p = models.predicted(models.fitted(skewed, columns, family), skewed, columns, "regression")
    assert metrics.regression(p, "label", "p").first()["r2"] > 0.95


@pytest.mark.parametrize("ties", [1, 7])
def test_quantiles_and_ranks_in_buckets(spark, monkeypatch, ties):
    rows = spark.range(500).select((F.floor(F.rand(3) * 1000 / ties) * 0.37 - 50).alias("v"), (F.col("id") % 2).alias("g"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    shares = [0.0, 0.1, 0.333, 0.5, 0.99, 1.0]
    plain = association.quantiles(rows, "v", shares)
    monkeypatch.setattr(association, "AT_ONCE", 10)
    assert association.quantiles(rows, "v", shares) == pytest.approx(plain) and association.quantiles(rows.filter("false"), "v", shares) == []
    got = sorted((r.g, r.v, r["rank"]) for r in association.average_ranks(rows, ["g"], "v").collect())
    for g in (0, 1):
        v = sorted(x for a, x, _ in got if a == g)
        assert [r for a, _, r in got if a == g] == [pytest.approx((v.index(x) + 1 + len(v) - v[::-1].index(x)) / 2) for x in v]


def test_spearman_with_gaps(spark):
    rows = spark.createDataFrame([(float(i), float(i * i), None if i % 4 == 0 else float(-i), 5.0) for i in range(40)], "a double, b double, c double, d double")
    got = {(r.f1, r.f2): (r.n, r.rho) for r in association.spearman_pairs(rows, ["a", "b", "c", "d"]).collect()}
    assert got[("a", "b")] == (40, pytest.approx(1)) and got[("a", "c")] == (30, pytest.approx(-1)) and got[("a", "d")] == (40, None)
    assert {r.f1: r.n for r in association.spearman_with(rows, ["b", "c"], "a").collect()} == {"b": 40, "c": 30}


def test_bands_follow_their_series(spark):
    errors = [("m", f, s, k, size * k) for f in (1, 2) for s, size in (("small", 1.0), ("large", 100.0)) for k in (1, 2, 3)] + [("m", 1, "new", 1, 7.0)]
    w = forecast.half_widths(spark.createDataFrame(errors, "model string, fold int, series string, step int, error double"), 0.9)
    got = {(r.series, r.step): (r.n, r.width) for r in w.collect()}
    assert got[("small", 3)] == (2, 3.0) and got[("large", 1)] == (2, 100.0)
    assert got[("new", 1)][0] == 5 and got[("new", 3)][1] == pytest.approx(300.0)  # too few of its own: over all series
    ahead = spark.createDataFrame([("m", "small", k, 10.0) for k in (1, 3, 5)], "model string, series string, step int, yhat double")
    assert {r.step: r.hi for r in forecast.banded(ahead, w).collect()} == {1: 11.0, 3: 13.0, 5: 13.0}


def test_names_of_steps():
    assert panel.step_of("30min") == ("min", 30) and panel.step_of("W-SUN") == ("W", 1) and panel.step_of("2H") == ("h", 2) and panel.step_of("ME") == ("MS", 1) and panel.step_of("MS") == ("MS", 1)
    assert panel.interval_of("15T") == "15 minute" and panel.interval_of("2QS") == "6 months" and panel.season_candidates(*panel.step_of("30min")) == [2, 48]
    with pytest.raises(ValueError):
        panel.step_of("fortnight")


def test_series_need_three_seasons(spark):
    rows = spark.range(120).select(F.explode(F.array(F.lit("long"), F.lit("short"))).alias("series"), "id").filter("series = 'long' or id >= 70")
    rows = rows.select("series", F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("ds"), (F.sin(F.col("id") * 2 * math.pi / 21) + F.col("id") % 5).alias("y"))
    run = ForecastRun(ForecastSpec(horizon=3, folds=2, period=21)).load(rows).seasons()
    assert [r.series for r in run.panel.select("series").distinct().collect()] == ["long"] and any("short is dropped" in x["decision"] for x in run.log)
    with pytest.raises(ValueError, match="folds of"):
        ForecastRun(ForecastSpec(horizon=30, folds=4, period=2)).load(rows.filter("series = 'long'")).seasons()


def test_folds_of_time_have_no_row_after_them(spark):
    rows = spark.range(60).select(F.col("id").cast("string").alias("k"), F.timestamp_seconds(F.col("id") * 86400).alias("t"))
    made = split.time_folds(rows, "t", "k", 3)
    assert {r.block: r.n for r in made.groupBy("block").agg(F.count("*").alias("n")).collect()} == {0: 15, 1: 15, 2: 15, 3: 15}


def test_a_run_with_a_regressor(spark, tmp_path):
    rows = spark.range(150).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("series"), "id")
    rows = rows.select("series", F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("ds"), (F.hash("id") % 5 == 0).cast("double").alias("promo"), "id")
    rows = rows.withColumn("y", 10 + F.sin(F.col("id") * 2 * math.pi / 7) + 8 * F.col("promo")).drop("id")
    past, future = rows.filter(F.col("ds") < F.lit("1970-05-24").cast("timestamp_ntz")), rows.filter(F.col("ds") >= F.lit("1970-05-24").cast("timestamp_ntz")).drop("y")
    run = ForecastRun(ForecastSpec(horizon=7, folds=2, period=7, models=["Theta", "Harmonic"], trees=False, blend=2, regressors=["promo"]))
    got = {(r.series, r.ds): r.yhat for r in run.run(past, future).collect()}
    truth = {(r.series, r.ds): r.y for r in rows.collect()}
    assert run.best == "Harmonic" and len(got) == 14 and max(abs(v - truth[k]) for k, v in got.items()) < 0.5
    with pytest.raises(ValueError, match="future"):
        run.forecast()

"""Acceptance checks of the modelling and forecasting operators."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.scalars import clean_names, holiday_flags, us_holidays
from sparkloom.operators import association, drift, encode, forecast, metrics, panel, profile, reconcile, season, select, split, statmodels, target


def series(spark, n=300, names=("s0",), f=lambda i, s: 10 + 3 * math.sin(2 * math.pi * i / 7), start=dt.datetime(2023, 1, 1)):
    rows = [(s, start + dt.timedelta(days=i), float(f(i, k))) for k, s in enumerate(names) for i in range(n)]
    return spark.createDataFrame(rows, "series string, ds timestamp_ntz, y double")


def test_names():
    assert clean_names(["x[1]<weird>", "x,2", "y:"]) == {"x[1]<weird>": "x_1__weird_", "x,2": "x_2", "y:": "y_"}
    with pytest.raises(ValueError):
        clean_names(["a", "A"])


def test_band_and_pick():
    same = {"Blend": [0.9, 0.9, 0.9], "One": [0.8, 0.8, 0.8]}
    assert select.band(same["Blend"], same["One"]) == pytest.approx(0)
    assert select.picked(same, {"Blend": 3, "One": 1}) == "Blend"
    erratic = {"Blend": [0.95, 0.6, 0.9], "One": [0.7, 0.9, 0.8]}
    assert select.picked(erratic, {"Blend": 3, "One": 1}) == "One"


def test_season_candidates():
    got = [panel.season_candidates(*a) for a in (("D",), ("W",), ("MS",), ("min",), ("min", 30), ("h", 2))]
    assert got == [[7, 365], [52], [12], [60, 1440], [2, 48], [12, 84]]


def test_season_is_found_and_noise_is_not(spark):
    rng = random.Random(1)
    found = season.detected(panel.regular(series(spark), "D"), [7])
    assert season.primary(found) == 7
    walk, steps = 0.0, []
    for _ in range(300):
        walk += rng.gauss(0, 1)
        steps.append(walk)
    assert season.primary(season.detected(panel.regular(series(spark, f=lambda i, s: steps[i]), "D"), [7])) == 1


def test_grid_fills_by_time_and_marks(spark):
    rows = series(spark, 10, f=lambda i, s: i).filter(F.dayofmonth("ds") != 4)
    got = panel.regular(rows, "D").orderBy("ds").collect()
    assert [r.y for r in got] == list(map(float, range(10)))
    assert [r.y_was_filled for r in got].count(True) == 1


def test_guardrails(spark):
    rows = series(spark, 40, ("a", "b", "c"), lambda i, s: i if s else 5.0).filter((F.col("series") != "b") | (F.dayofmonth("ds") % 2 == 0))
    got = {r.series: r.reason for r in panel.guarded(rows, "D", 5).collect()}
    assert got == {"a": "constant", "b": "too many gaps", "c": None}


def test_filled_rows_are_not_scored(spark):
    rows = series(spark, 40, f=lambda i, s: float(i % 5)).filter(F.col("ds") != dt.datetime(2023, 2, 8))
    p = panel.regular(rows, "D")
    folds = forecast.folded(p, forecast.cutoffs(p, "D", 4, 1))
    hit = folds.filter("not is_train").select(F.lit("M").alias("model"), "fold", "series", "step", F.when(F.col("y_was_filled"), 1e9).otherwise(F.col("y")).alias("yhat"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    got = forecast.scored(folds, hit, 4, 1).first()
    assert got.n == 3 and got.mae < 1 and got.coverage is None
    steps = {r.step for r in forecast.residuals(folds, hit, 4).collect()}
    assert len(steps) == 3


def test_attainable(spark):
    rows = spark.createDataFrame([("m", 1, float(i)) for i in range(9)] + [("m", 2, 1.0)], "model string, step int, error double")
    got = {r.step: (r.attainable, r.width) for r in forecast.half_widths(rows).collect()}
    assert got[1][0] == pytest.approx(0.9) and got[2][0] == pytest.approx(0.5)
    assert got[2][1] == got[1][1]


def test_hierarchy_and_reconciliation(spark):
    edges = [("TOTAL", "A"), ("TOTAL", "B"), ("A", "A1"), ("A", "A2")]
    names = ["A", "A1", "A2", "B", "TOTAL"]
    leaves, matrix = reconcile.summing(edges, names)
    assert leaves == ["A1", "A2", "B"] and matrix.tolist() == [[1, 1, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 1]]
    rows = spark.createDataFrame([(s, 1, v) for s, v in zip(names, (50.0, 20.0, 25.0, 55.0, 90.0))], "series string, step int, yhat double")
    errors = np.random.default_rng(0).normal(size=(20, 5))
    for method in reconcile.METHODS:
        got = {r.series: r.yhat for r in reconcile.applied(rows, reconcile.projection(matrix, leaves, names, method, errors), names).collect()}
        assert got["A"] == pytest.approx(got["A1"] + got["A2"], rel=1e-8) and got["TOTAL"] == pytest.approx(got["A"] + got["B"], rel=1e-8)
    low = spark.createDataFrame([("A1", dt.datetime(2023, 1, 1), 38.0), ("B", dt.datetime(2023, 1, 1), 55.0)], "series string, ds timestamp_ntz, y double")
    one = spark.createDataFrame([("TOTAL", "A"), ("TOTAL", "B"), ("A", "A1")], "parent string, child string")
    assert {r.series: r.y for r in panel.with_parents(low, one).collect()} == {"A1": 38, "B": 55, "A": 38, "TOTAL": 93}


def test_holidays(spark):
    days = spark.createDataFrame([(d,) for d in ("2023-12-24", "2023-12-25", "2023-12-26", "2024-01-01", "2024-03-05")], "d string").select(F.to_date("d").alias("ds"))
    got = {str(r.ds): (r.is_holiday, r.day_before_holiday, r.day_after_holiday) for r in holiday_flags(days, "ds", us_holidays(2023, 2024)).collect()}
    assert got == {"2023-12-24": (0, 1, 0), "2023-12-25": (1, 0, 0), "2023-12-26": (0, 0, 1), "2024-01-01": (1, 0, 0), "2024-03-05": (0, 0, 0)}


def test_drift(spark):
    rows = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"))
    got = {r.feature: r.status for r in drift.report(rows, rows.withColumn("x", F.col("x") + 10), ["x"], ["c"]).collect()}
    assert got == {"x": "MAJOR DRIFT", "c": "OK"}
    flat = rows.withColumn("x", F.lit(1.0))
    assert drift.numeric_psi(flat, rows, "x").first().status == "SKIPPED"
    assert drift.numeric_psi(rows, rows.drop("x"), "x").first().status == "MISSING COLUMN"
    assert drift.numeric_psi(rows, rows.withColumn("x", F.lit(None).cast("double")), "x").first().status == "ALL MISSING"


def test_pruning_and_leaks():
    pairs = [("a", "b", 0.99), ("b", "c", 0.97), ("a", "c", 0.5)]
    assert association.pruned(pairs, {"a": 0.9, "b": 0.1, "c": 0.3}) == [("b", "a")]
    assert association.pruned(pairs, {"a": 0.9, "b": 0.1, "c": 0.3}, ["a", "b"]) == [("c", "b")]
    assert association.pruned([("a", "b", 0.99)], {"a": 0.5, "b": 0.5}) == [("a", "b")]


def test_targets(spark):
    skewed = spark.range(500).select(F.exp((F.col("id") % 100) / 12).alias("y"))
    got = target.decided(target.statistics(skewed, "y")).first()
    assert got.metric == "MAE" and got.objective in ("gamma", "log_target")
    counts = spark.range(500).select((F.col("id") % 5).cast("double").alias("y"))
    assert target.decided(target.statistics(counts, "y")).first().objective == "poisson"
    assert target.task(counts, "y") == "classification" and target.task(skewed, "y") == "regression"


def test_splits(spark):
    rows = spark.range(600).select("id", (F.col("id") % 60).alias("g"), F.when(F.col("id") != 7, F.timestamp_seconds(F.col("id") * 86400)).alias("ts"), (F.col("id") % 2).alias("y"))
    by_group = split.group_holdout(rows, "g").groupBy("g").agg(F.count_distinct("split").alias("n")).agg(F.max("n")).first()[0]
    assert by_group == 1
    timed = split.time_holdout(rows, "ts", "id")
    assert timed.count() == 600 and timed.filter("split = 'holdout'").count() == 120
    ends = timed.groupBy("split").agg(F.min("ts").alias("a"), F.max("ts").alias("z")).collect()
    ends = {r.split: r for r in ends}
    assert ends["train"].z <= ends["holdout"].a and timed.filter("id = 7").first().split == "holdout"
    sizes = [r["count"] for r in split.folds(rows, "id", 5, "y").groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 2


def test_encoders(spark):
    rows = spark.createDataFrame([("a", 1.0, 0), ("a", 3.0, 1), ("b", 5.0, 0), ("b", 7.0, 1)], "l string, y double, fold int")
    got = {(r.l, r.fold): r.encoded for r in encode.target_means(rows, "l", "y", "fold", 0.0).collect()}
    assert got == {("a", 0): 3, ("a", 1): 1, ("b", 0): 7, ("b", 1): 5}


def test_profile_flags_and_recipe(spark):
    rows = spark.range(300).select("id", F.lit(1).alias("const"), (F.col("id") * 1.5).alias("x"), F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("when"), (F.rand(1) > 0.5).cast("int").alias("y"))
    recipe, found = profile.prepared(rows, "y")
    assert recipe.features == ["x", "when"] and list(recipe.dates) == ["when"]
    again = profile.Recipe.from_json(recipe.to_json())
    assert rows.select(*again.columns()).columns[0] == "x" and again.missing(rows.drop("x")) == ["x"]
    with pytest.raises(ValueError, match="no feature is left"):
        profile.prepared(rows.select("id", "const", "y"), "y")


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, p double")
    assert metrics.auc(rows, "y", "p").first()[0] == pytest.approx(0.625)


@pytest.mark.parametrize("name", sorted(statmodels.FITS))
def test_forecasters_follow_a_season(name):
    t = np.arange(120)
    y = 20 + 0.05 * t + 5 * np.sin(2 * np.pi * t / 7)
    means, sds = statmodels.FITS[name](y, 7, 7)
    truth = 20 + 0.05 * np.arange(120, 127) + 5 * np.sin(2 * np.pi * np.arange(120, 127) / 7)
    assert np.abs(means - truth).mean() < 1.5 and (sds >= 0).all()


def test_constant_series_does_not_break_forecasters(spark):
    rows = series(spark, 40, f=lambda i, s: 5.0).withColumn("fold", F.lit(1))
    for name in statmodels.FITS:
        got = statmodels.forecasts(rows, name, 3, 7).collect()
        assert [round(r.yhat, 3) for r in got] == [5.0] * 3


def test_sources(spark, tmp_path):
    from sparkloom.sources import tables

    rows = spark.createDataFrame([(1, float("nan"), "a"), (2, 2.0, None)], "i int, x double, s string")
    for name in ("t.csv", "t.parquet"):
        tables.write_table(rows, str(tmp_path / name))
        assert tables.read_table(spark, str(tmp_path / name)).filter("x is null").count() == 1
    with pytest.raises(tables.SourceError):
        tables.read_table(spark, str(tmp_path / "none.parquet"))
    assert tables.from_rows(spark, [{"a": 1}, {"a": 2, "b": "x"}]).count() == 2
    tables.write_metadata(spark, {"a": [1]}, str(tmp_path / "m"))
    assert tables.read_metadata(spark, str(tmp_path / "m")) == {"a": [1]}


def test_stream(spark, tmp_path):
    from sparkloom.streaming import windows

    rows = spark.range(48).select(F.timestamp_seconds(F.col("id") * 1800).alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.event_stream(spark, str(tmp_path / "in"), rows.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert {r.n for r in spark.sql("select n from hours").collect()} == {2}


def test_tabular_run(spark, tmp_path, monkeypatch):
    from sparkloom.operators import models
    from sparkloom.plans.tabular import MissingColumns, Scorer, TabularRun, TabularSpec

    every = models.roster
    monkeypatch.setattr(models, "roster", lambda *a: {"LogisticRegression": every(*a)["LogisticRegression"]})

    rows = spark.range(400).select(
        (F.randn(1)).alias("x1"), F.randn(2).alias("x2"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("cat"), "id"
    )
    rows = rows.withColumn("y", ((1.5 * F.col("x1") + (F.col("cat") == "a").cast("int") + F.randn(3) * 0.5) > 0).cast("int")).withColumn("leak", F.col("y") * 1.0)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    run = TabularRun(TabularSpec(target="y", folds=2, trials=0, finalists=1)).load(rows).split().scan()
    assert "leak" not in run.columns.numbers and "x1" in run.columns.numbers and "id" not in run.recipe.features
    run.screen().tune().decide().finish()
    assert run.champion == "LogisticRegression" and run.result["accuracy"] > 0.75
    run.export(str(tmp_path / "artifact"))
    from sparkloom.plans import report

    text = report.tabular_report(run)
    assert "LogisticRegression" in text and "<table>" in text
    report.save(spark, text, str(tmp_path / "report"))
    scorer = Scorer.load(spark, str(tmp_path / "artifact"))
    assert scorer.health()["ready"] and scorer.score(rows.limit(20)).count() == 20
    with pytest.raises(MissingColumns):
        scorer.score(rows.drop("x1"))
    assert {r.feature: r.status for r in scorer.drift(rows.withColumn("x1", F.col("x1") + 10)).collect()}["x1"] == "MAJOR DRIFT"


def test_regressors_reach_the_global_model(spark):
    from sparkloom.operators import globalml

    rows = series(spark, 120, f=lambda i, s: 10 + 20 * (i % 5 == 0)).withColumn("promo", F.when(F.datediff("ds", F.lit("2023-01-01").cast("date")) % 5 == 0, 1.0).otherwise(0.0))
    train, future = rows.filter(F.col("ds") < dt.datetime(2023, 4, 21)), rows.filter(F.col("ds") >= dt.datetime(2023, 4, 21))
    got = {r.step: r.yhat for r in globalml.forecast(train, "D", 5, 1, trees=10, depth=3, regressors=["promo"], future=future).collect()}
    truth = {k + 1: r.y for k, r in enumerate(future.orderBy("ds").limit(5).collect())}
    assert all(abs(got[k] - truth[k]) < 5 for k in truth)
    with pytest.raises(ValueError):
        globalml.forecast(train, "D", 30, 1, trees=2, depth=2, regressors=["promo"], future=future.limit(1))


def test_regressor_codes_and_fill(spark):
    rows = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, 5.0, "y"), ("a", 3, None, "x")], "series string, ds int, r double, c string")
    assert [x.r for x in panel.filled_regressors(rows, ["r"]).orderBy("ds").collect()] == [5.0, 5.0, 5.0]
    assert {x.c: x.code for x in panel.codes(rows, "c", ["ds"]).collect()} == {"x": 0, "y": 1}


def test_forecast_run(spark, tmp_path):
    from sparkloom.plans.forecasting import ForecastRun, ForecastSpec

    rows = series(spark, 120, ("a", "b"), lambda i, s: 20 + 10 * s + 4 * math.sin(2 * math.pi * i / 7) + 0.1 * (i * 7919 % 13))
    run = ForecastRun(ForecastSpec(horizon=7, folds=2, models=["Theta"], trees=False, blend=2, hierarchy=[("T", "a"), ("T", "b")], reconciliation="bottom_up"))
    got = run.run(rows).collect()
    assert run.m == 7 and len(got) == 21
    from sparkloom.plans import report

    assert "<svg" in report.forecast_report(run, spark.createDataFrame(got))
    by = {(r.series, r.step): r.yhat for r in got}
    assert by[("T", 3)] == pytest.approx(by[("a", 3)] + by[("b", 3)])
    run.export(str(tmp_path / "run"), spark.createDataFrame(got))
    assert ForecastRun.loaded(spark, str(tmp_path / "run"), 9).forecast().count() == 27


def test_model_helpers(spark):
    from sparkloom.operators import models

    rows = spark.range(300).select(F.col("id").cast("string").alias("__rid"), F.randn(1).alias("x"), F.lit("a").alias("c"))
    rows = rows.withColumn("label", (F.col("x") > 0).cast("double"))
    rows = split.folds(spark.createDataFrame(rows.collect(), rows.schema), "__rid", 2, "label")
    columns, family = models.Columns(["x"], ["c"]), models.roster("classification")["LogisticRegression"]
    assert models.probed_trees(rows, columns, "classification", "__rid", 12) >= 10
    fitted = models.fitted(rows, columns, family)
    assert [f for f, _ in models.permutation_importance(fitted, rows, columns, "classification", "__rid", 1)] == ["x", "c"]
    curve = [r.mean_prediction for r in models.partial_dependence(fitted, rows, columns, "classification", "x", 4).orderBy("x").collect()]
    assert curve == sorted(curve) and curve[0] < 0.1 < 0.9 < curve[-1]
    oof = models.out_of_fold(rows, columns, family, "classification", 2)
    assert oof.count() == 300 and models.calibrated(oof, "__rid")[0] in ("platt", "none")
    meta, _ = models.stacked({"A": oof, "B": oof}, "__rid", "label", "classification")
    assert all(c > 0 for c in meta.coefficients)
    best, _ = models.tuned(rows, columns, "LogisticRegression", family, "classification", 2, 1)
    assert set(best) <= {"reg"}


def test_a_sample_ranks_only_the_buckets_that_it_takes(spark, monkeypatch):
    """All rows are counted; those of buckets behind the last row taken are not ranked. The sample is that of ranks over all rows."""
    df = spark.range(20000).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("s"))
    ranked, work = [], split.hash_ranked
    monkeypatch.setattr(split, "hash_ranked", lambda rows, *a: ranked.append(rows.count()) or work(rows, *a))
    got = {r.id for r in split.stratified_sample(df, ["id"], "s", 100).collect()}
    everything = split.sizes(work(df, F.concat_ws("-", "id"), ["id"], ["s"], 42), ["s"])
    assert got == {r.id for r in everything.filter(F.col("__rank") <= F.ceil(F.col("__size") * 100 / 20000)).collect()}
    assert len(got) == 101 and ranked[0] < 400


def test_rank_correlations_deal_nothing_by_row(spark, monkeypatch):
    """The rows are grouped by value alone, not once for each column and again by row; ranks are the same where they are not broadcast."""
    df = spark.range(3000).select((F.col("id") % 7).alias("a"), (F.col("id") * 37 % 1000).alias("b"), (F.col("id") * 11 % 13 - F.col("id") % 7).alias("c"))
    columns = ["a", "b", "c"]
    few = {(r.f1, r.f2): (r.n, r.rho) for r in association.spearman_pairs(df, columns).collect()}
    ranks = df.toPandas()[columns].rank()
    assert all(n == 3000 and abs(rho - ranks[a].corr(ranks[b])) < 1e-9 for (a, b), (n, rho) in few.items()) and len(few) == 3
    assert "__rid" not in association.spearman_pairs(df, columns)._jdf.queryExecution().toString()
    monkeypatch.setattr(association, "RANKED", 0)
    monkeypatch.setattr(association, "PART_ROWS", 500)
    found = association.spearman_with(df, ["a", "b"], "c")
    assert all(abs(few[r.f1, "c"][1] - r.rho) < 1e-9 for r in found.collect())

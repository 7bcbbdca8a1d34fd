"""The fitted models against dense formulas, loops and series whose future is known."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from demandspark.operators import evaluate, models, segments, statistical, trees
from demandspark.types import MONTHLY, WEEKLY
from pyspark.sql import functions as F


def month(k, start=2018):
    return dt.date(start + k // 12, k % 12 + 1, 1)


def frame(spark, series):
    """series: product -> values by month."""
    return spark.createDataFrame([(p, month(k), float(v)) for p, values in series.items() for k, v in enumerate(values)], "product string, date date, y double")


def days(n, rows=1):
    return np.tile(np.array([(month(k) - dt.date(1970, 1, 1)).days for k in range(n)], float), (rows, 1))


@pytest.mark.parametrize("c", [(0.4, -0.3, 0.5, 0.2), (-0.7, 0.6, 0.0, -0.8), (0.0, 0.0, 0.0, 0.0)])
def test_likelihood_and_prediction_by_the_dense_covariance(c):
    season, n = 4, 30
    x = np.arctanh(np.array([c]) / statistical.EDGE)
    (ar,), (ma,) = statistical._coefficients(x, season)
    psi = np.zeros(6000)
    psi[0] = 1
    for k in range(1, len(psi)):
        psi[k] = (ma[k - 1] if k <= season + 1 else 0) + ar[: min(k, season + 1)] @ psi[k - 1 :: -1][: min(k, season + 1)]
    auto = np.array([psi[: len(psi) - h] @ psi[h:] for h in range(n + 1)])
    cov = auto[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    w = np.random.default_rng(0).normal(size=n)
    for pad in (0, 5):  # what stands before the history changes nothing
        squares, logs, state = statistical.kalman(np.concatenate([np.full(pad, np.nan), w])[None, :], x, season)
        assert squares[0] == pytest.approx(w @ np.linalg.solve(cov, w)) and logs[0] == pytest.approx(np.linalg.slogdet(cov)[1])
        assert state[0, 0] == pytest.approx(auto[1:][::-1] @ np.linalg.solve(cov, w))


def test_simplex_search_finds_the_least():
    target = np.array([[1.0, -2.0, 0.5, 3.0], [0.0, 0.0, 0.0, 0.0], [-4.0, 2.0, 2.0, 1.0]])
    found = statistical.simplex_search(lambda x: ((x - target) ** 2 * [1, 2, 3, 4]).sum(axis=1), np.zeros((3, 4)), 0.5, 400)
    assert np.abs(found - target).max() < 1e-3


def test_a_series_that_repeats_goes_on():
    line = np.array([50 + 2.0 * k + 10 * (k % 12 == 3) for k in range(60)])
    both = np.stack([line, np.concatenate([np.full(20, np.nan), line[20:]])])
    told = statistical.sarima(both[:, :-6], days(54, 2), MONTHLY, 6, days(60, 2)[:, -6:])
    assert np.abs(told - line[-6:]).max() < 1e-6
    told = statistical.additive(both[:, :-6], days(54, 2), MONTHLY, 6, days(60, 2)[:, -6:])
    assert np.abs(told - line[-6:]).max() < 3
    short = np.concatenate([np.full((1, 54 - 27), np.nan), line[None, :27]], axis=1)
    assert np.isnan(statistical.sarima(short, days(54), MONTHLY, 3, days(57)[:, -3:])).all()
    assert np.isnan(statistical.additive(np.full((1, 5), np.nan), days(5), MONTHLY, 3, days(8)[:, -3:])).all()


def test_the_trend_bends_where_the_data_does():
    values = np.concatenate([np.arange(30.0), 30 + 4 * np.arange(30.0)])
    told = statistical.additive(values[None, :], days(60), MONTHLY, 6, days(66)[:, -6:])[0]
    assert np.abs(told - (30 + 4 * np.arange(30, 36))).max() < 8


def test_models_over_products(spark):
    rng = np.random.default_rng(4)
    wave = [100 + 30 * np.sin(2 * np.pi * k / 12) for k in range(54)]
    df = frame(spark, {**{f"p{i}": [v + rng.normal() for v in wave] for i in range(5)}, "short": [5] * 20, "one": [4]})
    sarima = models.statistical_forecast(df, "sarima", horizon=4).collect()
    assert {r["product"] for r in sarima} == {f"p{i}" for i in range(5)} and len(sarima) == 20
    additive = models.statistical_forecast(df, "prophet", horizon=4).collect()
    assert {r["product"] for r in additive} == {"short", *(f"p{i}" for i in range(5))}
    true = {month(k): 100 + 30 * np.sin(2 * np.pi * k / 12) for k in range(54, 58)}
    assert all(abs(r.forecast - true[r.date]) < 8 for r in [*sarima, *additive] if r["product"] != "short")
    assert all(r.forecast == pytest.approx(5, abs=0.2) for r in additive if r["product"] == "short")
    weekly = df.where("product = 'p0'").withColumn("date", F.date_add(F.lit(dt.date(2020, 1, 5)), (F.row_number().over(__import__("pyspark").sql.Window.orderBy("date")) * 7).cast("int")))
    assert models.statistical_forecast(weekly, "prophet", WEEKLY, 2).count() == 2 and models.statistical_forecast(weekly, "sarima", WEEKLY, 2).count() == 0
    assert models.statistical_forecast(df.limit(0), "sarima").count() == 0


def test_fitted_models_reach_the_leaderboard(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, {"big": [200 + 40 * np.sin(2 * np.pi * k / 12) + rng.normal(0, 9) for k in range(60)], "small": [9] * 60}).cache()
    run = {m: (lambda p, h, m=m: models.statistical_forecast(p, m, horizon=h)) for m in ("sarima", "prophet")}
    board, rows = evaluate.leaderboard(df, advanced=evaluate.validate_advanced(df, run))
    mine = {r.model_name: r for r in board.where("product = 'big'").collect()}
    assert {m: mine[m].status for m in ("sarima", "prophet", "xgboost")} == {"sarima": "ok", "prophet": "ok", "xgboost": "skipped"}
    assert mine["prophet"].wmape < mine["naive"].wmape and mine["sarima"].seconds > 0


@pytest.mark.parametrize("boosted", [False, True])
def test_exported_trees_predict_as_spark_does(spark, boosted):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(*map(float, rng.integers(0, 9, 4)),) for _ in range(300)], "a double, b double, c double, y double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.withColumn("y", F.col("y") + F.col("a") * F.col("b")))
    for maker in [GBTRegressor(maxIter=6, labelCol="y", seed=1)] if boosted else [RandomForestRegressor(numTrees=7, labelCol="y", seed=1), DecisionTreeRegressor(labelCol="y", maxDepth=0), DecisionTreeRegressor(labelCol="y")]:
        fitted = maker.fit(df)
        rows = fitted.transform(df).select("a", "b", "c", "prediction").collect()
        told = trees.exported(fitted).predict(np.array([r[:3] for r in rows]))
        assert np.abs(told - [r.prediction for r in rows]).max() < 1e-9


@pytest.mark.parametrize("g", [MONTHLY, WEEKLY])
def test_features_in_tasks_are_those_of_the_panel(spark, g):
    """What the recursion computes for the next period is what the feature panel holds for it."""
    from demandspark.operators.panel import temporal_features

    rng = np.random.default_rng(7)
    for n in (1, 2, 4, 13, 60):
        values = rng.integers(0, 5, n).astype(float)
        start = dt.date(2020, 1, 5)
        date = (lambda k: start + dt.timedelta(7 * k)) if g is WEEKLY else month
        df = spark.createDataFrame([("p", date(k), float(v)) for k, v in enumerate([*values, 0.0])], "product string, date date, y double")
        want = temporal_features(df, g).orderBy("date").collect()[-1].asDict()
        padded = np.concatenate([np.full(60, np.nan), values])[None, :]
        for name, got in trees.demand_features(padded, g).items():
            assert (np.isnan(got[0]) and want[name] is None) or got[0] == pytest.approx(want[name]), name


def test_steps_look_back_on_predictions(spark):
    """A tree that copies the last value, forecast in one task, against a loop."""
    from pyspark.ml.regression import DecisionTreeRegressor

    df = frame(spark, {p: [float((k * k + i) % 7) for k in range(40)] for i, p in enumerate("abc")})
    got = {(r["product"], r.horizon_step): r.forecast for r in models.tree_forecast(df, "random_forest", horizon=6, regressor=DecisionTreeRegressor(labelCol="y", seed=1, maxDepth=8)).collect()}
    assert len(got) == 18
    # one step at a time over the history grown by hand gives the same
    one = models.tree_forecast(df, "random_forest", horizon=1, regressor=DecisionTreeRegressor(labelCol="y", seed=1, maxDepth=8)).collect()
    assert all(got[r["product"], 1] == pytest.approx(r.forecast) for r in one)


def test_fold_cuts_by_hand(spark):
    want = {5: [], 7: [4], 9: [4], 10: [4, 7], 16: [10, 13], 17: [14], 24: [14, 17, 20], 36: [14, 20, 26], 42: [14, 22, 30], 60: [14, 28, 42]}
    rows = segments.fold_cutoffs(spark.createDataFrame([(n,) for n in want], "n_points long")).collect()
    assert {n: [r.cut for r in sorted(rows, key=lambda r: r.fold) if r.n_points == n] for n in want} == want


def test_prefixes_against_a_plain_loop(spark):
    """All products of a batch go forward together: the same as one value after another, with histories of every length and no lambda in the plan."""
    import random

    from demandspark.operators.models import prefixes
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(f"p{k}", [0.0 if rng.random() < 0.4 else rng.random() * 90 for _ in range(n)]) for k, n in enumerate((0, 1, 2, 5, 11, 12, 13, 40, 90, 3))] + [("zero", [0.0] * 20)]
    cuts = lambda ys: sorted({1, len(ys) // 2, len(ys), len(ys) + 3})
    df = spark.createDataFrame([(p, ys, cuts(ys)) for p, ys in rows], "product string, y array<double>, cuts array<int>")
    told = df.select("product", prefixes(F.col("y"), F.col("cuts"), horizon=3).alias("told"))
    assert "aggregate(" not in told._jdf.queryExecution().executedPlan().toString()
    got = {r.product: r.told for r in told.collect()}
    for p, ys in rows:
        want = []
        for cut in (c for c in cuts(ys) if 1 <= c <= len(ys)):
            level = size = gap = None
            since = 1.0
            for y in ys[:cut]:
                level = y if level is None else 0.3 * y + 0.7 * level
                if y:
                    size, gap = (y, since) if size is None else (0.1 * y + 0.9 * size, 0.1 * since + 0.9 * gap)
                since = 1.0 if y else since + 1
            recent = ys[max(0, cut - 3) : cut]
            season = ys[cut - 12 : cut - 9] if cut >= 12 else None
            want.append((cut, ys[cut - 1], sum(recent) / len(recent), level, size / gap if size is not None else 0.0, season))
        assert [tuple(x) for x in got[p]] == want


def test_metrics_count_folds_without_a_distinct(spark):
    from demandspark.operators.evaluate import product_metrics

    rows = spark.createDataFrame([("a", "naive", 0, f, s, 2.0, 1.0) for f in (0, 2, 3) for s in (1, 2, 3)], "product string, model_name string, cand_ord int, fold int, horizon_step int, actual double, validation_prediction double")
    found = product_metrics(rows)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(r.n_folds, r.n_rows) for r in found.collect()] == [(3, 9)]

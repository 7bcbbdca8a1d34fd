"""The whole run: what it reads once, sums up once, and fits on few parts."""

from __future__ import annotations

import datetime as dt

from demandspark.operators import evaluate, insights, intake, models, quality
from demandspark.types import MONTHLY, WEEKLY
from pyspark.sql import functions as F


def odd_rows(spark):
    """Upload rows with gaps, several records of a day and of a month, no date, no quantity, negative ones and two spellings."""
    rows = [(p, dt.datetime(2020 + k // 12, k % 12 + 1, 1 + k % 27), float((k * s) % 5)) for p, s in (("a", 1), ("b ", 2), ("b", 3)) for k in range(40) if s != 3 or k % 7 == 0]
    rows += [("a", dt.datetime(2020, 3, 3), -4.0), ("a", dt.datetime(2020, 3, 3), None), ("b", dt.datetime(2020, 1, 30), 2.0), ("old", dt.datetime(2019, 5, 1), 7.0), ("none", None, 3.0), (None, dt.datetime(2020, 1, 1), 9.0)]
    return spark.createDataFrame(rows, "product string, date timestamp_ntz, qty double")


def test_facts_of_products_are_those_of_the_single_checks(spark):
    rows = odd_rows(spark)
    for g in (MONTHLY, WEEKLY):
        facts = quality.product_facts(rows, g)
        told = {r["product"]: r for r in facts.collect()}
        assert set(told) == {"a", "b ", "b", "old", "none"}
        gaps = {r["product"]: (r["n_periods"], r["missing_periods"]) for r in quality.missing_periods(rows, g).collect()}
        assert gaps == {p: (r["n_periods"], r["n_periods"] - r["seen"]) for p, r in told.items() if (r["n_periods"] or 0) >= 2}
        several = quality.product_period_multiplicity(rows, g).first()
        assert (several["n_groups"], several["extra_rows"]) == (sum(r["several"] for r in told.values()), sum(r["extra"] for r in told.values()))
        assert several["share_differing"] == sum(r["differing"] for r in told.values()) / several["n_groups"]
        shares = quality.dominance(rows, "product").first()
        assert shares["n_groups"] == len(told) and shares["total"] == sum(r["demand"] for r in told.values())
        panel = quality.build_panel(rows, g)
        runs = {r["product"]: r["longest_run"] for r in quality.longest_zero_run(panel).collect()}
        assert runs == {p: r["longest_run"] for p, r in told.items() if r["seen"]}
        kinds = quality.zero_classification(panel).groupBy("product").agg(F.count_if(F.coalesce(F.col("zero_kind").isin("structural", "unclassified"), F.lit(False))).alias("s"), F.count_if(F.coalesce(F.col("zero_kind") == "unclassified", F.lit(False))).alias("u"))
        assert {r["product"]: (r["s"], r["u"]) for r in kinds.collect()} == {p: (r["structural"], r["unclassified"]) for p, r in told.items() if r["seen"]}
    facts = quality.product_facts(rows)
    assert intake.history_of(facts).first().asDict() == intake.history_summary(rows).first().asDict()


def test_zeros_of_a_product_are_told_without_windows(spark):
    """NULLs between zeros, and a value that is no number."""
    rows = [("a", dt.date(2020 + k // 12, k % 12 + 1, 1), 0.0 if k % 12 == 0 and k < 36 else None if k in (14, 16) else 0.0 if 13 <= k <= 18 else 5.0) for k in range(48)]
    rows += [("z", dt.date(2020 + k // 12, k % 12 + 1, 1), None if k % 12 < 4 else float(k % 3)) for k in range(30)] + [("n", dt.date(2020, 1, 1), float("nan"))]
    found = quality.product_history(spark.createDataFrame(rows, "product string, date date, y double"))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["product"]: (r["n_points"], r["structural"], r["unclassified"], r["longest_run"], r["zeros"]) for r in found.collect()}
    assert got == {"a": (48, 6, 0, 2, 7), "z": (30, 12, 0, 1, 4), "n": (1, 0, 0, 0, 0)}


def test_trees_train_on_few_parts_without_a_plan(spark):
    from pyspark.ml.regression import DecisionTreeRegressor

    seen = []

    class Watched:
        def fit(self, df):
            seen.append((df.rdd.getNumPartitions(), df._jdf.queryExecution().optimizedPlan().toString(), df.count()))
            return DecisionTreeRegressor(labelCol="y", seed=1).fit(df)

    rows = [(p, dt.date(2018 + k // 12, k % 12 + 1, 1), float((k * k + i) % 7)) for i, p in enumerate("abc") for k in range(40)]
    df = spark.createDataFrame(rows, "product string, date date, y double").repartition(7)
    assert models.tree_forecast(df, "random_forest", horizon=2, regressor=Watched()).count() == 6
    (parts, plan, n), = seen
    assert parts == 1 and n == 3 * 28 and plan.startswith("LogicalRDD")


def test_folds_read_the_products_that_ask_for_them_once(spark):
    rows = [(p, dt.date(2018 + k // 12, k % 12 + 1, 1), v + k % 5) for p, v in (("big", 900.0), ("small", 9.0), ("tiny", 1.0)) for k in range(48)]
    files, products = set(), set()

    def told(panel, horizon):
        files.add(tuple(sorted(panel.select("product", "date").inputFiles())))
        products.update(r["product"] for r in panel.select("product").distinct().collect())
        return models.forecast(panel, "naive", horizon=horizon)

    out = evaluate.validate_advanced(spark.createDataFrame(rows, "product string, date date, y double"), {"sarima": told, "prophet": told})
    assert products == {"big"} and len({f.rsplit("/", 2)[-2] for fs in files for f in fs}) <= 2
    assert {(r["model_name"], r["fold"]) for r in out.rows.select("model_name", "fold").distinct().collect()} == {(m, k) for m in ("sarima", "prophet") for k in range(3)}


def test_recent_means_by_series(spark):
    rows = [(p, dt.date(2020 + k // 12, k % 12 + 1, 1), float(k * s)) for p, s, n in (("a", 1, 30), ("b", 2, 3)) for k in range(n)]
    panel = spark.createDataFrame(rows, "product string, date date, y double")
    ahead = spark.createDataFrame([(p, dt.date(2022, 7 + k, 1), 5.0) for p in ("a", "b", "new") for k in range(6)], "product string, date date, forecast double")
    held = models.series(panel)
    same = lambda f: sorted(map(repr, f(panel, ahead).collect())) == sorted(map(repr, f(panel, ahead, held).collect()))
    assert same(insights.recent_means) and same(insights.growth_ranking) and same(insights.total_direction)

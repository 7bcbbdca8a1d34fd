from __future__ import annotations

import datetime as dt
import json

import pytest
from demandspark.functions import names
from demandspark.functions.coerce import date_format_of, normalized, to_date, to_number
from demandspark.operators import analysis, evaluate, external, features, forecast, insights, intake, models, panel, quality, quantiles, remediation, segments
from demandspark.plans.pipeline import Halt, resume, run_pipeline, run_scenario
from demandspark.sources import memory, tables
from demandspark.types import MONTHLY, WEEKLY, CoreMapping, RunConfig
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def months(start, values, product="P1"):
    y, m = start
    return [(product, dt.date(y + (m - 1 + i) // 12, (m - 1 + i) % 12 + 1, 1), float(v)) for i, v in enumerate(values)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "product string, date date, y double")


@pytest.fixture(scope="module")
def sales(spark):
    """36 months of a summer product, a steady one and an intermittent one."""
    rows = []
    for i in range(36):
        d = dt.datetime(2022 + i // 12, i % 12 + 1, 1)
        rows += [("P1", d, 1000.0 + 400 * (d.month in (6, 7, 8)) + (i * 7) % 50), ("P2", d, 500.0 + (i * 11) % 30), ("P3", d, 0.0 if i % 5 in (1, 3) else 40.0 + i % 20)]
    return spark.createDataFrame(rows, "product string, date timestamp_ntz, qty double")


def test_coercion(spark):
    df = spark.createDataFrame([(" 1.5 ", "2024/01/31", " A-b_C. d/"), ("x", "2024/13/01", None), (None, None, ""), ("NaN", "2024/02/01", "É")], "a string, b string, c string")
    assert date_format_of(df, "b") == "yyyy/MM/dd"
    got = df.select(to_number(F.col("a")).alias("a"), to_date(df, "b", "yyyy/MM/dd").alias("b"), normalized(F.col("c")).alias("c")).collect()
    assert [r.a for r in got] == [1.5, None, None, None]
    assert [r.b and r.b.date() for r in got] == [dt.date(2024, 1, 31), None, None, dt.date(2024, 2, 1)]
    assert [r.c for r in got] == ["abcd", None, "", "é"]


def test_period_labels(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 7),), (dt.date(2024, 1, 8),)], "date date")
    assert [r[0] for r in days.select(panel.period_of(F.col("date"), WEEKLY)).collect()] == [dt.date(2024, 1, 7), dt.date(2024, 1, 14)]
    with pytest.raises(ValueError):
        panel.granularity("daily")


def test_panel_has_no_gaps_and_nulls_are_zero(spark):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 5), None), ("a", dt.datetime(2024, 4, 5), 2.0), (None, dt.datetime(2024, 1, 1), 9.0), ("b", None, 9.0), ("c", dt.datetime(2024, 2, 1), 1.0)], "product string, date timestamp_ntz, qty double")
    got = [(r.product, r.date.month, r.y) for r in panel.panel(rows).orderBy("product", "date").collect()]
    assert got == [("a", 1, 0.0), ("a", 2, 0.0), ("a", 3, 0.0), ("a", 4, 2.0), ("c", 2, 1.0)]
    assert panel.panel(rows.limit(0)).count() == 0


def test_features_look_back_only(spark):
    values = [5, 7, 1, 0, 8, 2, 9, 4, 3, 6, 5, 5, 8, 1, 7, 2]
    base = panel.temporal_features(frame(spark, months((2022, 1), values))).orderBy("date").collect()
    changed = panel.temporal_features(frame(spark, months((2022, 1), [*values[:10], 99, *values[11:]]))).orderBy("date").collect()
    keys = [c for c in base[0].asDict() if c != "y"]
    for i in range(11):
        assert [base[i][k] for k in keys] == [changed[i][k] for k in keys]
    assert base[3].lag_3 == 5 and base[3].rolling_mean_3 == pytest.approx(13 / 3) and base[1].rolling_std_3 is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=30))
def test_models_against_loops(spark, values):
    df = frame(spark, months((2020, 1), values))

    def ses(xs, a):
        level = None
        for x in xs:
            level = x if level is None else a * x + (1 - a) * level
        return level

    where = [i + 1 for i, v in enumerate(values) if v]
    gaps = [b - a for a, b in zip([0, *where], where, strict=False)]
    want = {"naive": [values[-1]] * 3, "seasonal_naive": [values[len(values) - 12 + k] if len(values) >= 12 else values[-1] for k in range(3)], "moving_average": [sum(values[-3:]) / len(values[-3:])] * 3, "exponential_smoothing": [ses(values, 0.3)] * 3, "croston": [ses([values[i - 1] for i in where], 0.1) / ses(gaps, 0.1) if where else 0.0] * 3}
    for m, w in want.items():
        got = [r.forecast for r in models.forecast(df, m, horizon=3).orderBy("horizon_step").collect()]
        assert got == pytest.approx(w), m


def test_segments_by_hand(spark):
    rows = months((2022, 1), [100] * 24, "big") + months((2022, 1), [30] * 24, "mid") + months((2022, 1), [20] * 24, "mid2") + months((2022, 1), [2] * 24, "low") + months((2024, 1), [50] * 5, "new") + months((2022, 1), [0, 0, 9] * 8, "rare")
    got = {r.product: r.segment for r in segments.product_segments(frame(spark, rows)).collect()}
    assert got == {"big": "high_volume", "mid": "normal", "mid2": "normal", "low": "low_volume", "new": "short_history", "rare": "intermittent"}


def test_exact_performance(spark):
    rows = [("P1", "m", 0, 1, dt.date(2025, 1, 1), 100.0, 110.0), ("P1", "m", 0, 2, dt.date(2025, 2, 1), 200.0, 180.0), ("P2", "m", 0, 1, dt.date(2025, 1, 1), 0.0, 5.0), ("P2", "m", 0, 2, dt.date(2025, 2, 1), 50.0, 50.0)]
    v = spark.createDataFrame(rows, "product string, model_name string, fold int, horizon_step int, date date, actual double, validation_prediction double")
    got = [(r.error, r.error_pct, r.direction) for r in analysis.performance_per_period(v).orderBy("product", "date").collect()]
    assert got == [(10, 10, "over"), (-20, -10, "under"), (5, None, "over"), (0, 0, "exact")]
    first = analysis.performance_totals(v).orderBy("date").first()
    assert (first.total_actual, first.total_predicted, first.error, first.direction, first.n_products) == (100, 115, 15, "over", 2)
    s = analysis.performance_summary(v).first()
    assert (s.n_over, s.n_under, s.n_exact, s.n_rows, s.n_products, s.n_periods) == (2, 1, 1, 4, 2, 2)


def test_hybrid_needs_two_models(spark):
    one = spark.createDataFrame([("p", "naive", 0, 0.5)], "product string, model_name string, cand_ord int, wmape double")
    assert evaluate.hybrid_weights(one).count() == 0
    two = spark.createDataFrame([("p", "naive", 0, 0.5), ("p", "ma", 1, 0.25), ("p", "x", 2, 0.0)], "product string, model_name string, cand_ord int, wmape double")
    assert {r.model_name: r.weight for r in evaluate.hybrid_weights(two).collect()} == {"naive": 0.3333, "ma": 0.6667}


def test_seasonality(spark):
    summer = [10 + 20 * (i % 12 in (5, 6, 7, 4)) for i in range(24)]
    got = {r.product: r for r in features.seasonal_detection(frame(spark, months((2022, 1), summer, "s") + months((2022, 1), [5] * 24, "flat") + months((2022, 1), [5] * 6, "new"))).collect()}
    assert got["s"].pattern_type == "summer_peak" and got["s"].peak_months == [5, 6, 7, 8]
    assert got["flat"].pattern_type == "year_round" and got["new"].pattern_type == "undetected"
    assert features.seasonal_detection(frame(spark, months((2024, 1), [1] * 3)), "HVAC").first().detection_source == "sector_default"
    assert features.seasonal_detection(frame(spark, months((2024, 1), [1] * 3)), "HVAC").first().low_months == [11, 12, 1, 2]


def test_leakage(spark):
    words = ("Revenue_Q1", "Earnings", "الأرباح", "profitMargin", "إيراد 2024", "Net Sales")
    assert all(any(names.matches(w, k) for k in features.LEAKAGE) for w in words) and not any(names.matches("backorder_qty", k) or names.matches("Marginal_Notes", k) for k in features.LEAKAGE)
    good = features.build_features(frame(spark, months((2021, 1), [5 + i % 7 for i in range(30)]) + months((2021, 1), [3] * 20, "P2")))
    failed = lambda df, meta=(): {c["check"] for c in features.leakage_audit(df, MONTHLY, meta) if not c["passed"]}
    columns = [c for c in good.columns if c not in ("product", "date", "y")]
    assert failed(good, features.feature_metadata(columns)) == set()
    assert failed(good.withColumn("lag_1", F.col("y"))) == {"lags_computed_per_product"}
    assert failed(good.withColumn("rolling_mean_3", F.col("y"))) == {"rolling_excludes_current"}
    assert failed(good.withColumn("Earnings", F.lit(1.0)).withColumn("when", F.col("date")).withColumn("Demand", F.col("y"))) == {"post_sale_metrics_excluded", "no_raw_date_in_tree_features", "no_target_in_features"}
    assert failed(good, features.feature_metadata(columns[1:])) == {"future_availability_classified"}


def test_names():
    assert not names.matches("Holiday", "id") and names.name_score("Last Update", ["date"]) == 0
    assert names.tokens("LeadTime") == {"lead", "time"} and "تاريخ" in names.tokens("التاريخ")
    assert names.name_score("order_id", ["id"]) == names.name_score("id", ["id"]) == names.name_score("Value", ["value"]) == 0.45
    assert names.name_score("Quantity", ["quantity"]) == 1.0 and names.name_score("Sold Units", ["units"]) == 0.85 and names.name_score("Stock", ["safety stock"]) == 0
    assert names.parts("orderID no.7/الكمية،x") == ["order", "id", "no", "7", "الكمية", "x"] and names.normalize(" A-b_C. d/") == "abcd"
    assert names.fingerprint(["B", "a"]) == names.fingerprint(["A ", "b"])


def test_intake(spark):
    rows = [(f"2024-{m:02d}-01", f"AC-{p}", str(10 * m + p), str(5.0 + m / 10), str(m % 2), 100 * m, 3 + p) for m in range(1, 13) for p in range(3)]
    df = spark.createDataFrame(rows, "Date string, Product string, Quantity string, Unit_Price string, Promo string, Revenue long, LeadTime int")
    found = intake.run_intake(df)
    assert found.mapping == CoreMapping("Date", "Product", "Quantity")
    meant = {i["column"]: i["detected_meaning"] for i in found.inputs}
    assert meant == {"Unit_Price": "price", "Promo": "promotion", "Revenue": "revenue", "LeadTime": "lead_time"}
    assert {"demand_forecasting", "scenario_simulation", "reorder_planning"} <= set(found.capabilities)
    assert intake.route(found.inputs) == {"features": ["Unit_Price", "Promo"], "passthrough": ["LeadTime"], "excluded": ["Revenue"]}
    moved = intake.correct(found, {"Revenue": "qty"})
    assert moved.mapping.qty == "Revenue" and any(i["column"] == "Quantity" and i["detected_meaning"] == "unknown" for i in moved.inputs)
    with pytest.raises(ValueError):
        intake.correct(found, {"Promo": "nonsense"})
    assert intake.propose(lambda p: json.dumps({"Promo": {"meaning": "price"}, "zzz": {"meaning": "price"}, "LeadTime": {"meaning": "bogus"}}), [{"column": "Promo"}, {"column": "LeadTime"}]) == {"Promo": {"meaning": "price", "confidence": 0.0, "reason": ""}}
    held = intake.propose(lambda p: json.dumps({"a": {"meaning": "price", "confidence": 0.99, "reason": "x" * 300}, "b": {"meaning": "price", "confidence": -1}, "c": {"meaning": "price", "confidence": "?"}}), [{"column": c} for c in "abc"])
    assert {c: p["confidence"] for c, p in held.items()} == {"a": 0.70, "b": 0.0, "c": 0.0} and len(held["a"]["reason"]) == 200
    assert intake.propose(lambda p: "no json", []) == {}


def test_memory(spark, tmp_path):
    path = str(tmp_path / "m")
    assert memory.load(spark, path) == {"schemas": {}, "columns": {}}
    memory.save_confirmed(spark, path, ["Tag", "Menge"], {"Tag": "date", "Menge": "qty"})
    store = memory.save_confirmed(spark, path, ["Tag", "Menge"], {"Tag": "date", "Menge": "product"})
    assert store["columns"]["tag"]["count"] == 2 and store["columns"]["menge"] == {"role": "product", "count": 1}
    assert memory.lookup(store, ["MENGE", "tag"]) == ({"MENGE": "product", "tag": "date"}, 0.95)
    assert memory.lookup(store, ["tag", "x"])[1] == 0.90
    store = memory.save_confirmed(spark, path, ["Tag", "Menge"], {"Tag": "date"})  # the newest confirmation of a schema stands for it
    assert list(store["schemas"].values()) == [{"tag": "date"}]


def test_memory_of_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "m")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: memory.save_confirmed(spark, path, ["Tag", f"c{k}"], {"Tag": "date", f"c{k}": "qty"}), range(12)))
    store = memory.load(spark, path)
    assert store["columns"]["tag"] == {"role": "date", "count": 12} and len(store["schemas"]) == 12
    # a table that was never moved into the log doesn't count
    spark.range(1).write.parquet(f"{path}/open-x")
    assert memory.load(spark, path) == store


def test_quality_and_repairs(spark):
    rows = [(p, dt.datetime(2022 + i // 12, i % 12 + 1, 1), 10.0 + i % 3) for p in ("A", "a ", "B") for i in range(24) if not (p == "B" and i == 5)] + [("A", dt.datetime(2022, 1, 1), 10.0), ("B", dt.datetime(2022, 2, 1), 9999.0)]
    df = spark.createDataFrame(rows, "product string, date timestamp_ntz, qty double")
    kinds = {i.issue_type for i in quality.issues(df)}
    assert {"exact_duplicate_rows", "missing_periods", "multiple_records_same_product_period", "unusual_demand_observations", "inconsistent_product_identifiers"} <= kinds
    found = quality.issues(df)
    plan = remediation.build_plan(found)
    assert [x["action"] for x in plan["auto"]] == ["trim_whitespace", "remove_empty_rows", "standardize_date_format"]
    out, audit = remediation.execute_plan(df, plan, ("insert_missing_periods",))
    log = {r.action: r.status for r in audit.collect()}
    assert log["insert_missing_periods"] == "applied" and "not_applied" in log.values()
    assert out.count() == 72  # trimmed, but not folded: A, a and B
    same, audit = remediation.execute_plan(df.withColumn("qty", -F.col("qty")), {"auto": [], "review": [], "advisory": []}, (), override=("remove_negative_demand",))
    assert same.count() == 0 and audit.first().detail == "manual override"
    assert quality.readiness(found)["forecast"] < 100


def test_external(spark, tmp_path):
    (tmp_path / "weather_riyadh_monthly.csv").write_text("date,temperature\n2024-01-01,10\n2024-02-01,x\n2024-03-01,30\n")
    frame_, notes, missing = external.build_external(spark, "2024-01-01", "2024-03-31", str(tmp_path), city="Nowhere", industry="HVAC")
    got = frame_.orderBy("date").collect()
    assert [r.temperature for r in got] == [10, 10, 30] and got[2].cooling_degree_days == 12 and len(notes) == 1
    assert missing == ["ahri_shipments", "construction_activity"]
    assert tables.read_side_series(spark, str(tmp_path / "none.csv"), ["x"]) is None
    assert "ahri_shipments" not in {x["feature"] for x in external.recommend()} and len(external.get_registry()) == 10
    told = external.get_registry()
    assert (told["humidity"]["source"], told["humidity"]["required_columns"], told["humidity"]["by_city"], told["humidity"]["scenario_capable"]) == ("side_file", ["date", "humidity"], True, True)
    assert told["cooling_degree_days"]["required_columns"] == ["temperature"] and told["month"]["source"] == "generated" and not told["ahri_shipments"]["scenario_capable"]


def test_scenarios(spark):
    base = spark.createDataFrame([("P1", dt.date(2025, k, 1), float(v), float(v) - 5, float(v) + 5, k) for k, v in enumerate([10, 20, 60], 1)] + [("P2", dt.date(2025, k, 1), 10.0, None, None, k) for k in (1, 2, 3)], "product string, date date, forecast double, lower_bound double, upper_bound double, horizon_step int")

    def run(asked):
        s, notes = analysis.resolve(asked, {"P1", "P2"})
        return {(r.product, r.horizon_step): r for r in analysis.run_scenario(base, s).collect()}, notes

    same, _ = run({})
    assert [same["P1", k].forecast for k in (1, 2, 3)] == [10, 20, 60]
    up, _ = run({"demand_change_pct": 10, "per_product_change_pct": {"P1": 20, "zz": 3}})
    assert up["P1", 1].forecast == pytest.approx(12) and up["P2", 1].forecast == pytest.approx(11) and up["P1", 1].lower_bound == pytest.approx(7) and up["P2", 1].lower_bound is None
    moved, _ = run({"peak_shift_periods": 1})
    assert [moved["P1", k].forecast for k in (1, 2, 3)] == pytest.approx([60, 10, 20])
    strong, _ = run({"seasonal_strength_factor": 2})
    assert [strong["P1", k].forecast for k in (1, 2, 3)] == pytest.approx([0, 10, 90])
    _, notes = run({"seasonal_strength_factor": -2, "demand_change_pct": "abc", "bogus": 1, "per_product_change_pct": {"zz": 1}})
    assert len(notes) == 5 and notes[0] == analysis.DISCLAIMER


def test_tree_forecast(spark):
    from pyspark.ml.regression import RandomForestRegressor

    df = frame(spark, months((2021, 1), [10 + 5 * (i % 12) for i in range(36)]) + months((2021, 1), [3] * 36, "P2"))
    df = df.withColumn("heat", F.month("date").cast("double"))
    out = models.tree_forecast(df, "random_forest", horizon=3, fill=("heat",), regressor=RandomForestRegressor(numTrees=5, seed=1, labelCol="y"))
    rows = out.collect()
    assert len(rows) == 6 and {(r.horizon_step, r.date) for r in rows} == {(k, dt.date(2024, k, 1)) for k in (1, 2, 3)}
    assert all(r.forecast == pytest.approx(3, abs=1) if r.product == "P2" else 5 <= r.forecast <= 70 for r in rows)
    with pytest.raises(ValueError):
        models.tree_forecast(df.where("date >= '2023-01-01'"), "random_forest", horizon=1)


def test_model_validation_joins_the_leaderboard(spark):
    df = frame(spark, months((2021, 1), [100 + 5 * (i % 12) for i in range(36)], "big") + months((2021, 1), [9] * 36, "small"))
    extra = evaluate.model_validation(df, "random_forest", lambda p, h: models.forecast(p, "naive", horizon=h))
    assert extra.count() == 9 and {r.product for r in extra.collect()} == {"big"}
    board, _ = evaluate.leaderboard(df, extra=extra)
    status = {(r.product, r.model_name): r.status for r in board.where("scope = 'product'").collect()}
    assert status["big", "random_forest"] == "ok" and status["big", "xgboost"] == "skipped"
    told = board.where("model_name = 'lstm'").first()
    assert (told.scope, told.status, told.selected) == ("ALL", "future_extension", False)


def test_advanced_models_are_selected_and_may_fail(spark):
    from pyspark.ml.regression import RandomForestRegressor

    df = frame(spark, months((2021, 1), [100 + (i * i * 7) % 53 for i in range(36)], "big") + months((2021, 1), [9] * 36, "small")).cache()

    def truth(p, h):
        ends = p.groupBy("product").agg(F.max("date").alias("_e"))
        ahead = df.join(ends, "product").where("date > _e").withColumn("horizon_step", F.months_between("date", "_e").cast("int")).where(F.col("horizon_step") <= h)
        return ahead.select("product", "date", F.col("y").alias("forecast"), "horizon_step")

    def broken(p, h):
        raise RuntimeError("no fit")

    done = evaluate.validate_advanced(df, {"random_forest": truth, "xgboost": broken, "nobody_asks": broken})
    assert done.failures == {"xgboost": "no fit"} and set(done.seconds) == {"random_forest", "xgboost"} and done.rows.count() == 9
    board, _ = evaluate.leaderboard(df, advanced=done)
    mine = {r.model_name: r for r in board.where("scope = 'product' AND product = 'big'").collect()}
    assert mine["random_forest"].selected and mine["random_forest"].wmape == 0 and mine["random_forest"].seconds > 0
    assert (mine["xgboost"].status, mine["xgboost"].reason) == ("failed", "no fit") and mine["sarima"].status == "skipped"
    tree = lambda p, h: models.tree_forecast(p, "random_forest", horizon=h, regressor=RandomForestRegressor(numTrees=5, seed=1, labelCol="y"))
    used = forecast.used_models(board)
    others, notes = forecast.advanced_forecasts(df, used, {"random_forest": tree}, 4)
    out = forecast.product_forecasts(df, board, horizon=4, others=others).collect()
    assert notes == [] and len(out) == 8 and {r.model_used for r in out if r.product == "big"} == {"random_forest"}
    assert all(r.forecast > 0 and r.lower_bound is not None for r in out)
    others, notes = forecast.advanced_forecasts(df, used, {"random_forest": broken}, 4)
    out = [r for r in forecast.product_forecasts(df, board, horizon=4, others=others).collect() if r.product == "big"]
    assert len(notes) == 1 and {(r.model_used, r.forecast) for r in out} == {("naive", 142.0)}


def test_direct_total_needs_a_history(spark):
    assert forecast.direct_total(frame(spark, months((2024, 1), [5] * 16))).count() == 0
    out = forecast.direct_total(frame(spark, months((2023, 1), [5] * 17) + months((2023, 1), [7] * 17, "P2"))).collect()
    assert len(out) == 12 and {r.direct_total_forecast for r in out} == {12.0}


def test_metric_labels(spark):
    rows = [("P1", "m", 0, 0, k, dt.date(2025, k, 1), 100.0, 100.0 + e) for k, e in ((1, 20), (2, 10), (3, -27))]
    v = spark.createDataFrame(rows, "product string, model_name string, cand_ord int, fold int, horizon_step int, date date, actual double, validation_prediction double")
    board = evaluate.selected(evaluate.product_metrics(v)).withColumn("scope", F.lit("product"))
    cards = {r.metric: r for r in forecast.metric_cards(board, v, frame(spark, months((2024, 1), [100, 100], "P1"))).collect()}
    assert {m: r.label for m, r in cards.items()} == {"wMAPE": "good", "Forecast Bias": "excellent", "MAPE": "good", "MAE": "good", "RMSE": "good"}
    assert cards["Forecast Bias"].direction == "balanced"
    empty = {r.metric: r.label for r in forecast.metric_cards(board, v.limit(0), frame(spark, [])).collect()}
    assert empty == {"wMAPE": "poor", "Forecast Bias": "poor", "MAPE": "poor", "MAE": "needs_attention", "RMSE": "needs_attention"}


def test_quantiles(spark):
    for values in ([3.0], [1.0, 2.0], [-5.0, -5.0, 0.0, 0.5, 1e6, 7.0, 7.0], list(range(-50, 51))):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for q in (0.0, 0.2, 0.5, 0.9, 1.0):
            want = df.agg(F.percentile("v", F.lit(q))).first()[0]
            assert quantiles.exact_quantile(df, "v", q).first()[0] == pytest.approx(want)
    assert quantiles.exact_quantile(df.limit(0), "v", 0.5).first()[0] is None


def test_presence_readiness():
    whole = CoreMapping("d", "p", "q")
    inputs = lambda *m, level="high": [{"column": x, "detected_meaning": x, "confidence": level, "stockout_signal": False, "category": "advisory"} for x in m]
    assert intake.presence_readiness(whole, [], 10, 5, 0.25) == {"forecast": 80, "inventory": 30, "scenario": 40}
    assert intake.presence_readiness(whole, inputs("price", "stock_on_hand", "lead_time", "safety_stock", "promotion"), 10, 10) == {"forecast": 100, "inventory": 100, "scenario": 100}
    assert intake.presence_readiness(CoreMapping("d", None, "q"), inputs("price", level="low")) == {"forecast": 53, "inventory": 0, "scenario": 27}


def test_capabilities_and_readiness_tell_why():
    whole, part = CoreMapping("d", "p", "q"), CoreMapping("d", None, "q")
    inputs = [{"column": c, "detected_meaning": m, "confidence": level, "stockout_signal": m == "stock_on_hand", "category": "advisory", "needs_confirmation": level == "low", "alternatives": []} for c, m, level in (("Preis", "price", "high"), ("Lager", "stock_on_hand", "medium"), ("x", "lead_time", "low"), ("y", "unknown", "low"))]
    told = intake.capability_report(whole, inputs)
    assert told["demand_forecasting"]["reason"]["code"] == "core_complete" and told["forecast_improvement"]["available_inputs"] == ["price"] and told["forecast_improvement"]["missing_inputs"] == []
    assert not told["reorder_planning"]["unlocked"] and told["reorder_planning"]["missing_inputs"] and told["reorder_planning"]["reason"]["code"] in ("locked_without", "locked_without_all")
    assert intake.capabilities(whole, inputs) == [c for c, t in told.items() if t["unlocked"]]
    assert {t["reason"]["text"] for t in intake.capability_report(part, inputs).values()} == {"Still to be found: product."} and intake.capabilities(part, inputs) == []
    report = intake.readiness_report(whole, inputs, 10, 5, 0.25)
    assert [(r["code"], r["points"]) for r in report["forecast"]["reasons"]] == [("core_columns", 50), ("sufficient_products", 15), ("periods_with_demand", 15), ("demand_drivers", 5)] and report["forecast"]["score"] == 85
    assert [r["code"] for r in report["inventory"]["reasons"]] == ["input_there", "input_there", "input_missing", "input_missing"]
    seen = intake.overviews(intake.Intake(whole, inputs, capabilities=intake.capabilities(whole, inputs)))
    assert seen["stockout"] == {"signals": [{"column": "Lager", "detected_meaning": "stock_on_hand", "confidence": "medium"}], "ready": True}
    assert seen["contract"]["required"] == {"date": "d", "product": "p", "qty": "q"} and seen["contract"]["advisory"]["y"] == "y"
    assert [c["column"] for c in seen["context"]["needs_review"]] == ["x"] and [i["key"] for i in seen["context"]["detected_inputs"]][:2] == ["demand_history", "product_catalog"]
    assert len(seen["extra_columns"]) == 4


def test_performance_echoes_and_empty_results_have_columns(spark):
    v = spark.createDataFrame([("P2", "m", 0, 1, dt.date(2025, 2, 1), 0.0, 5.0), ("P1", "m", 1, 1, dt.date(2025, 1, 1), 100.0, 110.0), ("P1", "m", 0, 1, dt.date(2025, 1, 1), 100.0, 90.0)], "product string, model_name string, fold int, horizon_step int, date date, actual double, validation_prediction double")
    cards = [{"metric": "wMAPE", "label": "good"}]
    out = analysis.performance(spark, v, {"portfolio_wmape": 0.1, "bias_direction": "balanced", "confidence_label": "excellent", "other": 1}, cards)
    assert [(r["product"], r.fold) for r in out["per_period"].collect()] == [("P1", 0), ("P1", 1), ("P2", 0)] and [str(r.date) for r in out["totals"].collect()] == ["2025-01-01", "2025-02-01"]
    s = out["summary"]
    assert (s["portfolio_wmape"], s["bias_direction"], s["confidence_label"], s["n_over"], s["n_rows"]) == (0.1, "balanced", "excellent", 2, 3) and "other" not in s
    assert s["metric_cards"] == cards and s["metric_cards"][0] is not cards[0] and out["warnings"] == []
    for nothing in (None, v.limit(0)):
        out = analysis.performance(spark, nothing)
        assert out["per_period"].count() == out["totals"].count() == 0 and out["summary"]["n_rows"] == 0 and out["summary"]["portfolio_wmape"] is None
        assert out["per_period"].columns == ["product", "date", "fold", "horizon_step", "model_name", "actual", "predicted", "error", "error_pct", "direction"] and [w["code"] for w in out["warnings"]] == ["no_validation"]
    told = analysis.simulate(spark, None, {"demand_change_pct": 10, "per_product_change_pct": {"P1": 5}})
    assert told["forecast"].count() == told["comparison"].count() == told["peaks"].count() == 0 and told["forecast"].columns[:3] == ["product", "date", "forecast"]
    assert told["warnings"][0] == analysis.DISCLAIMER and len(told["warnings"]) == 3 and told["impact"].first().total_demand_delta is None
    base = spark.createDataFrame([("A", dt.date(2025, k, 1), float(f), k) for k, f in ((1, 5), (2, 9), (3, 9))], "product string, date date, forecast double, horizon_step int")
    peaks = analysis.simulate(spark, base, {"peak_shift_periods": 2})["peaks"].first()
    assert (str(peaks.peak_baseline), str(peaks.peak_scenario)) == ("2025-02-01", "2025-01-01")
    many = analysis.simulate(spark, base, {"per_product_change_pct": {"A": 10} | {f"p{i}": 1 for i in range(3000)}})
    assert len(many["warnings"]) == 3001 and many["forecast"].agg(F.sum("forecast")).first()[0] == pytest.approx(25.3)


def test_meaning_levels():
    shape = {"dtype": "double", "n": 10, "n_null": 0, "n_unique": 9, "date_share": 1.0, "numeric_share": 1.0, "non_negative_share": 1.0, "binary": False, "zero_share": 0.0, "unit_share": 0.0}
    told = lambda column, steady, **more: intake.business_inputs([shape | {"column": column} | more], {column: {"constant_per_product": steady, "same_across_products": 0.0}}, CoreMapping("d", "p", "q"))[0]
    assert (told("price", 0.0)["detected_meaning"], told("price", 0.0)["confidence"]) == ("price", "high")
    assert told("price", 1.0)["confidence"] == "high" and told("price", 1.0, non_negative_share=0.5)["confidence"] == "medium"  # shape 0.5, then 0.25
    assert told("unit price code", 1.0, non_negative_share=0.0)["confidence"] == "medium"
    assert told("zzz", 0.0)["detected_meaning"] == "unknown" and told("zzz", 0.0)["hint"] is not None
    assert told("سعةإنتاج", 0.0)["detected_meaning"] == "capacity" and told("معلّق", 0.0)["detected_meaning"] == "backorders"


def test_issues_by_category(spark):
    one = lambda kind, severity="warning", confidence=0.5, n=1: quality.Issue(kind, severity, confidence, n, "x")
    business = [one(k) for k in ("negative_demand", "unusual_demand_observations", "suspicious_constant_demand", "inconsistent_product_identifiers")]
    assert quality.readiness(business) == {"forecast": 100, "inventory": 0, "scenario": 50}
    assert quality.readiness(business, {"lead_time", "price"}) == {"forecast": 100, "inventory": 92, "scenario": 100}
    assert quality.readiness([one("missing_periods"), one("seasonal_coverage_gap", "info", 0.1)])["forecast"] == 91
    assert quality.ready_for_features(business) and not quality.ready_for_features([one("invalid_dates", "critical")])
    assert [i.issue_type for i in quality.missing_columns(CoreMapping("d", None, None))] == ["missing_product_column", "missing_qty_column"]
    rows = [("A", dt.datetime(2024, 1, 1 + i), 1.0, i) for i in range(20)]
    df = spark.createDataFrame(rows + rows[:5], "product string, date timestamp_ntz, qty double, ticket int")
    found = quality.issues(df)
    dup = next(i for i in found if i.issue_type == "exact_duplicate_rows")
    assert (dup.severity, dup.confidence, dup.recommended_action) == ("warning", 0.4, "review_duplicates")  # 20 of 25 tickets differ: no identifier
    more = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), 1.0, i) for i in range(99)] + [("A", dt.datetime(2024, 1, 1), 1.0, 5)], df.schema)
    dup = next(i for i in quality.issues(more) if i.issue_type == "exact_duplicate_rows")
    assert (dup.severity, dup.confidence, dup.recommended_action, dup.detail) == ("warning", 0.85, "remove_exact_duplicates", "ticket")
    assert [(quality.SEVERITY[i.severity], -i.affected_records) for i in found] == sorted((quality.SEVERITY[i.severity], -i.affected_records) for i in found)


def test_repairs_are_counted(spark):
    df = spark.createDataFrame([(" A ", "2024-01-05", "1"), ("A", "bad", "x"), ("A", "2024-01-05", "-2"), (None, None, None), ("A", "2024-01-05", "-2")], "product string, date string, qty string")
    plan = remediation.build_plan([quality.Issue("exact_duplicate_rows", "info", 0.6, 1, "remove_exact_duplicates")], df)
    assert {x["action"]: x["impact"]["rows_affected"] for x in plan["auto"] + plan["review"]} == {"trim_whitespace": 1, "remove_empty_rows": 1, "standardize_date_format": 5, "remove_exact_duplicates": 1}
    out, audit = remediation.execute_plan(df, plan, ("remove_exact_duplicates",))
    got = {r.action: (r.records_affected, r.records_removed, r.values_modified) for r in audit.collect()}
    assert got == {"trim_whitespace": (1, 0, 1), "remove_empty_rows": (1, 1, 0), "standardize_date_format": (4, 0, 4), "remove_exact_duplicates": (1, 1, 0)} and out.count() == 3 and df.count() == 5


def test_findings(spark):
    made = spark.createDataFrame([(p, dt.date(2025, k, 1), float(v)) for p, vs in (("A", (100, 110, 120)), ("B", (20, 18, 22))) for k, v in enumerate(vs, 1)], "product string, date date, forecast double")
    past = frame(spark, months((2024, 10), [90, 95, 100], "A") + months((2024, 10), [19, 21, 20], "B"))
    board = spark.createDataFrame([("A", "m", "product", 0.12, 1.0, -0.05, "ok", True), ("B", "m", "product", 0.55, 1.0, 0.40, "ok", True)], "product string, model_name string, scope string, wmape double, mae double, forecast_bias double, status string, selected boolean")
    kinds = spark.createDataFrame([("A", "high_volume"), ("B", "intermittent")], "product string, segment string")
    summary = {"portfolio_wmape": 0.18, "bias_direction": "under-forecasting", "confidence_label": "good", "n_products_evaluated": 2, "n_products_forecasted": 2}
    clean = insights.generate(past, made, board, kinds, [], None, summary)
    assert clean["status"] == "success" and clean["confidence"] == "High" and clean["direction"]["direction"] == "up"
    assert clean["growth_leaders"][0]["product"] == "A" and clean["growth_leaders"][0]["basis"] == "growth_vs_history"
    assert [(r["product"], r["level"]) for r in clean["risk_alerts"]] == [("B", "high")]
    severe = [quality.Issue("missing_periods", "warning", 0.7, 3, "x"), quality.Issue("large_temporal_gaps", "warning", 0.6, 2, "x"), quality.Issue("invalid_dates", "critical", 0.9, 1, "x")]
    low = insights.generate(past, made, board, kinds, severe, {"delta_pct": 10.0, "products": ["A"]}, summary)
    assert low["confidence"] == "Low" and {r["product"]: r["drivers"] for r in low["risk_alerts"]}["A"] == ["scenario_sensitive", "large_with_low_confidence"]
    assert [f["source"] for f in low["key_findings"]] == ["performance", "quality", "scenario", "forecast", "explainability"] and len(low["recommended_actions"]) == 6
    assert [(f["code"], f["n"]) for f in low["data_limitations"][:3]] == [("missing_periods", 3), ("large_temporal_gaps", 2), ("invalid_dates", 1)]
    assert low["data_limitations"][0]["text"] == "3 periods are missing between first and last ones."
    assert {r["product"]: r["action"] for r in low["risk_alerts"]} == {"A": "prepare_for_scenario", "B": "check_error"}
    side = insights.generate(past, made, board, kinds, [], None, summary, {"n_rows": 0, "n_over": 0, "n_under": 0}, ["no weather file for X", "second"])
    assert [f["code"] for f in side["data_limitations"]] == ["no_product_validation", "side_table", "no_stock_columns", "no_feature_effects"] and side["data_limitations"][1]["detail"] == "no weather file for X"
    assert [f["code"] for f in side["executive_summary"]] == ["demand_up", "trust", "products_at_high_risk"] and side["chatbot_context"]["executive_summary"].startswith("Total demand goes up (+")
    volume = insights.top_growth(insights.growth_ranking(past.limit(0), made)).collect()
    assert [(r.product, r.basis) for r in volume] == [("A", "highest_forecasted_volume"), ("B", "highest_forecasted_volume")]
    assert insights.generate(past, made.drop("forecast"), board, kinds)["status"] in ("partial", "failed")


def test_future_availability():
    meta = features.feature_metadata(["month", "lag_1", "temperature", "ahri_shipments", "promo"], {"promo": "promotion"}, {"temperature": "requires_future_values", "ahri_shipments": "historical_context"})
    assert features.partition_future(meta) == (["month", "lag_1", "temperature"], ["temperature"], ["ahri_shipments", "promo"])


def test_confidence():
    assert insights.model_confidence("good") == "High" and insights.model_confidence("good", n_critical=1) == "Low" and insights.model_confidence("good", n_warnings=3, n_failed=1) == "Low"


def test_pipeline_pause_resume_and_halts(spark, sales):
    assert run_pipeline(sales, RunConfig(granularity="daily")).status == "halted"
    bare = run_pipeline(spark.createDataFrame([("a", "b")], "x string, y string"))
    assert bare.status == "halted" and {i.severity for i in bare.results["issues"]} == {"critical"}
    paused = run_pipeline(sales.union(sales.limit(2)), RunConfig(evaluation_mode="fast"))
    assert paused.status == "awaiting_quality_review" and "forecasts" not in paused.results
    done = resume(paused, tuple(p["action"] for p in paused.results["plan"]["review"]))
    assert done.status == "ok", done.errors
    assert done.results["forecasts"].count() == 36 and done.results["insights"]["status"] == "success", done.results["insights"]["errors"]
    assert done.results["direct_total"].count() == 12 and done.results["summary"].first().n_products_forecasted == 3 and done.results["presence"]["forecast"] > 50
    assert [x["stage"] for x in done.log].count("intake") == 1
    with pytest.raises(Halt):
        resume(done)
    what = run_scenario(done, {"demand_change_pct": 10, "per_product_change_pct": {"nobody": 5}})
    assert len(what["warnings"]) == 2 and what["impact"].first().total_demand_delta_pct == pytest.approx(10)


def test_run_with_client_and_side_features(spark, tmp_path):
    rows = [(p, dt.datetime(2022 + i // 12, i % 12 + 1, 1), 100.0 + 10 * (i % 12) + 5 * k, 20.0 + (i % 12) if i != 7 else None, 9.5, 50 + i) for k, p in enumerate("ABC") for i in range(30)]
    df = spark.createDataFrame(rows, "product string, date timestamp_ntz, qty double, Temperature double, Unit_Price double, Revenue long")
    (tmp_path / "ahri_shipments.csv").write_text("date,ahri_shipments\n" + "".join(f"{2022 + i // 12}-{i % 12 + 1:02d}-01,{i}\n" for i in range(30)))
    calls = []

    def flat(p, h):
        calls.append(sorted(p.columns))
        return models.forecast(p.select("product", "date", "y"), "naive", horizon=h)

    config = RunConfig(auto_approve_quality=True, sector="hvac", extra={"external_folder": str(tmp_path), "forecasters": {"random_forest": flat, "xgboost": flat}})
    done = run_pipeline(df, config)
    assert done.status == "ok", done.errors
    full = done.results["features"]
    assert {"Temperature", "Unit_Price", "cooling_degree_days", "ahri_shipments"} <= set(full.columns) and "Revenue" not in full.columns
    assert full.where("Temperature IS NULL").count() == 0  # carried over the gap
    assert calls and calls[0] == sorted(["product", "date", "y", "Temperature", "cooling_degree_days", "heating_degree_days"])  # price and shipments can't be known ahead
    assert {m["feature_name"]: m["future_availability"] for m in done.results["metadata"]}["Unit_Price"] == "scenario_only"
    assert all(c["passed"] for c in done.results["leakage_audit"]) and done.results["relevance"].first().verdict == "strong"
    assert done.results["leaderboard"].where("model_name = 'random_forest' AND status = 'ok' AND scope = 'product'").count() > 0


def test_optional_stage_may_fail(spark, sales):
    from demandspark.plans import pipeline as pl

    def broken(x):
        raise RuntimeError("no")

    stages = [(n, broken if n == "insights" else f, o) for n, f, o in pl.STAGES]
    done = run_pipeline(sales, RunConfig(auto_approve_quality=True, evaluation_mode="fast"), stages)
    assert done.status == "ok" and any("insights" in w for w in done.warnings)
    stages = [(n, broken if n == "features" else f, o) for n, f, o in pl.STAGES]
    assert run_pipeline(sales, RunConfig(auto_approve_quality=True, evaluation_mode="fast"), stages).status == "error"


def test_json_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), dt.date(2024, 1, 1)), (2, 1.5, None)], "a int, b double, c date")
    assert [json.loads(r.json) for r in tables.json_rows(df).collect()] == [{"a": 1, "b": None, "c": "2024-01-01"}, {"a": 2, "b": 1.5, "c": None}]
    tables.write_csv(df, str(tmp_path / "o"), single=True)
    assert tables.read_csv(spark, str(tmp_path / "o")).count() == 2


def test_stream(spark, tmp_path):
    from demandspark.streaming.ingest import run_available

    kind = "event_type string, ts timestamp_ntz, value double"
    df = spark.createDataFrame([("e", dt.datetime(2024, 1, d), 1.0) for d in range(1, 29)], kind)
    folder, run = str(tmp_path / "in"), lambda: run_available(spark, folder, str(tmp_path / "out"), str(tmp_path / "cp"), df.schema)
    df.limit(0).write.parquet(folder)
    assert run().count() == 0
    df.write.mode("append").parquet(folder)
    out = run()
    assert out.agg(F.sum("y")).first()[0] == 28 and out.where("NOT finished").count() in (1, 2)
    before = {(r.period_start, r.y) for r in out.collect()}
    # nothing new: nothing changes. Then a late event corrects its window, an open one goes on; the first files aren't read again
    assert {(r.period_start, r.y) for r in run().collect()} == before
    for f in (tmp_path / "in").glob("part-*"):
        f.write_bytes(b"")
    spark.createDataFrame([("e", dt.datetime(2024, 1, 1, 5), 10.0), ("e", dt.datetime(2024, 1, 29), 1.0), ("new", dt.datetime(2024, 1, 30), None)], kind).write.mode("append").parquet(folder)
    late = {(r["product"], r.period_start): (r.y, r.n) for r in run().collect()}
    assert sum(y for y, _ in late.values()) == 39 and sum(n for _, n in late.values()) == 31
    first = min(p for p, _ in before)
    assert late["e", first][0] == next(y for p, y in before if p == first) + 10 and len(late) == len(before) + 1

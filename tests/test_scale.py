"""What queries order and read again: plans, sizes of tasks, and results on odd rows."""

from __future__ import annotations

import datetime as dt

from demandspark.operators import panel as P
from demandspark.operators import quality
from demandspark.sources import tables


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def odd_panel(spark):
    """Product a: January zero in 3 of 4 years, NULLs between zeros. Product b: one year. Product c: no zero."""
    rows = []
    for k in range(48):
        y = 0.0 if k % 12 == 0 and k < 36 else None if k in (14, 16) else 0.0 if 13 <= k <= 18 else 5.0
        rows.append(("a", dt.date(2020 + k // 12, k % 12 + 1, 1), y))
    rows += [("b", dt.date(2021, m, 1), float(m % 2)) for m in range(1, 9)] + [("c", dt.date(2021, 1, 1), 1.0)]
    return spark.createDataFrame(rows, "product string, date date, y double")


def test_zeros_are_told_in_one_order_without_joins(spark, capsys):
    out = quality.zero_classification(odd_panel(spark))
    plan = plan_of(out, capsys)
    assert "Join" not in plan and plan.count("Sort [") == 1
    found = {(r["product"], r["date"].isoformat()): r["zero_kind"] for r in out.collect()}
    assert len(found) == 57
    assert [found["a", f"{y}-01-01"] for y in (2020, 2021, 2022, 2023)] == ["seasonal"] * 3 + [None]
    assert found["a", "2021-02-01"] == "structural" and found["b", "2021-02-01"] == "unclassified" and found["c", "2021-01-01"] is None


def test_zero_runs_take_one_order(spark, capsys):
    out = quality.longest_zero_run(odd_panel(spark))
    assert plan_of(out, capsys).count("Sort [") == 1
    # a: 2021-02 (k = 13), NULL, 2021-04, NULL, 2021-06 and 07: a NULL ends a run
    assert {r["product"]: r["longest_run"] for r in out.collect()} == {"a": 2, "b": 1, "c": 0}


def test_tasks_grow_with_the_files(spark, tmp_path, capsys, monkeypatch):
    path = str(tmp_path / "a [b] {c}%20.parquet")
    spark.range(40000).selectExpr("CAST(id % 500 AS STRING) AS product", "date_add(DATE'2020-01-01', CAST(id % 900 AS INT)) AS date", "CAST(id AS DOUBLE) AS qty").write.parquet(path)
    rows = spark.read.parquet(path.replace("[", "\\[").replace("]", "\\]").replace("{", "\\{").replace("}", "\\}"))
    assert "REPARTITION_BY_NUM" not in plan_of(P.panel(rows), capsys)
    want = {(r["product"], r["date"], r["y"]) for r in P.panel(rows).collect()}
    size = sum(f.stat().st_size for f in (tmp_path / "a [b] {c}%20.parquet").glob("part-*"))
    monkeypatch.setattr(tables, "TASK_BYTES", size // 20)
    many = P.panel(rows)
    assert "REPARTITION_BY_NUM" in plan_of(many, capsys) and many.rdd.getNumPartitions() in (20, 21)
    assert {(r["product"], r["date"], r["y"]) for r in many.collect()} == want


def test_issues_build_one_panel(spark, monkeypatch):
    made, per = [], quality.build_panel
    ids = [(f"p{i % 3}", dt.datetime(2020 + k // 12, k % 12 + 1, 1), float(i + 1)) for i in range(3) for k in range(30) if i != 1 or k % 9 in (0, 1)]
    df = spark.createDataFrame(ids, "product string, date timestamp, qty double")
    panel = quality.build_panel(df)
    found = {r["product"]: r for r in quality.product_history(panel).collect()}
    zeros = quality.zero_classification(panel).where("zero_kind IN ('structural', 'unclassified')").groupBy("product").count()
    assert {r["product"]: r["count"] for r in zeros.collect()} == {p: r["structural"] for p, r in found.items() if r["structural"]}
    assert {r["product"]: r["longest_run"] for r in quality.longest_zero_run(panel).collect()} == {p: r["longest_run"] for p, r in found.items()}

    class Counted:
        def __call__(self, rows, g):
            out = per(rows, g)
            run = out.sparkSession.sparkContext.accumulator(0)
            made.append(run)

            def seen(batches):
                run.add(1)
                yield from batches

            return out.coalesce(1).mapInArrow(seen, out.schema)

    monkeypatch.setattr(quality, "build_panel", Counted())
    issues = {i.issue_type: i for i in quality.issues(df)}
    assert [m.value for m in made] == [1]
    assert issues["large_temporal_gaps"].affected_records == 1 and issues["large_temporal_gaps"].affected_products == ["p1"]


def test_folds_order_only_products_that_ask(spark):
    from demandspark.operators import evaluate, models

    rows = [(p, dt.date(2020 + k // 12, k % 12 + 1, 1), float(k + 1)) for p in ("asks", "other") for k in range(36)]
    panel = spark.createDataFrame(rows, "product string, date date, y double")
    asked = spark.createDataFrame([("asks", 36, "high_volume", "sarima", 4)], "product string, n_points long, segment string, model_name string, cand_ord int")
    told = lambda p, h: models.forecast(p, "naive", horizon=h)
    out = evaluate.fold_validation(panel, "sarima", told, 0, asked=asked)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    ordered = [part for part in plan.split("Window")[1:] if "row_number" in part.split("\n")[0]]
    assert ordered and all("LeftSemi" in part for part in ordered)
    rows = out.orderBy("horizon_step").collect()
    assert [(r["product"], r["actual"], r["validation_prediction"]) for r in rows] == [("asks", 15.0, 14.0), ("asks", 16.0, 14.0), ("asks", 17.0, 14.0)]


def test_ways_to_the_peak_are_found_for_a_product(spark, capsys):
    """Below the join with the panel, for twelve months of a product; not for each row of the panel."""
    import datetime as dt

    from demandspark.operators import features

    seasons = spark.createDataFrame([("a", "irregular", [3, 11], [6], "data_driven"), ("b", "undetected", [], [], "undetected")], "product string, pattern_type string, peak_months array<int>, low_months array<int>, detection_source string")
    rows = spark.createDataFrame([(p, dt.date(2021, m, 1), 1.0) for p in "abc" for m in range(1, 13)], "product string, date date, y double")
    out = features.seasonal_features(rows, seasons)
    plan = plan_of(out, capsys)
    assert "transform(" not in plan[: plan.index("Join")]
    found = {(r["product"], r["date"].month): r["months_to_peak"] for r in out.collect()}
    assert [found["a", m] for m in range(1, 13)] == [2, 1, 0, 7, 6, 5, 4, 3, 2, 1, 0, 3]
    assert found["b", 5] is None and found["c", 5] is None


def test_products_are_judged_where_they_lie(spark, tmp_path, capsys):
    """From the written series on, no row of a product is shuffled. A part may bear a brand's name, have no brand, or stand twice in its table."""
    from demandspark.operators import evaluate, forecast
    from demandspark.plans import bindings as B

    items = [(k, dt.datetime(2020 + m // 12, m % 12 + 1, 3 + m % 9), float((k * 7 + m * m) % 13)) for k in range(6) for m in range(40) if (k + m) % (k + 1) == 0]
    items += [(9, dt.datetime(2021, 1, 5), None), (None, dt.datetime(2021, 1, 5), 2.0), (1, None, 2.0)]
    spark.createDataFrame(items, "l_partkey long, l_shipdate timestamp_ntz, l_quantity double").selectExpr("*", "1L AS l_orderkey", "1L AS l_suppkey", "1D AS l_extendedprice", "0D AS l_discount").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(0, "3"), (1, "B"), (2, "B"), (2, "B"), (4, None), (9, "B"), (77, "C")], "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    held, panel = B.mixed_series(spark, str(tmp_path)), B.mixed_panel(spark, str(tmp_path))
    triples = lambda df: sorted((r["product"], r["date"], r["y"]) for r in df.collect())
    assert triples(P.rows_of(held)) == triples(panel) and held.count() == panel.select("product").distinct().count()
    told = evaluate.judged(held)
    board, rows = evaluate.board_of(told)
    ahead = forecast.product_forecasts(None, None, used=forecast.used_of(told))
    for df in (rows, ahead, board.where("scope = 'product' AND selected")):
        assert "Exchange hashpartitioning" not in plan_of(df, capsys)
    want = evaluate.product_metrics(rows).select("product", "model_name", "wmape", "rmse", "n_rows", "n_folds")
    got = board.where("scope = 'product' AND status = 'ok'").select(*want.columns)
    near = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.fillna(-1.0).collect())
    assert near(got) == near(want)
    assert near(ahead.select("product", "horizon_step", "forecast")) == near(forecast.product_forecasts(panel, board).select("product", "horizon_step", "forecast"))


def test_what_is_read_once_is_judged_once_and_not_written(spark, monkeypatch):
    """A filter on the models would have run the judging a second time, were it not written; the rows of validation are left out."""
    from demandspark.operators import evaluate, forecast, models
    from demandspark.sources.tables import materialized

    rows = [(p, dt.date(2020 + k // 12, k % 12 + 1, 1), float((k * s) % 7 + s)) for p, s in (("a", 3), ("b", 5)) for k in range(36)] + [("c", dt.date(2020, 1, 1), 1.0)]
    held = materialized(models.series(spark.createDataFrame(rows, "product string, date date, y double")))
    written = evaluate.judged(held, every=False)
    monkeypatch.setattr(evaluate, "materialized", lambda df: (_ for _ in ()).throw(AssertionError("written")))
    once = evaluate.judged(held, every=None, once=True)
    assert once.where("rows IS NOT NULL").count() == 0
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    for part in ("scope = 'ALL'", "scope = 'product' AND selected", "scope = 'product' AND status != 'ok'"):
        got, want = (evaluate.board_of(t)[0].where(part) for t in (once, written))
        assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
        assert same(got, want)
    ahead = [forecast.product_forecasts(None, None, used=forecast.used_of(t)) for t in (once, written)]
    assert ahead[0].count() == 36 and same(*ahead)


def test_portfolio_needs_no_validation_rows(spark):
    """The sums of the selected models add up to the metrics over their rows."""
    from demandspark.operators import evaluate, forecast, models
    from demandspark.sources.tables import materialized

    rows = [(p, dt.date(2020 + k // 12, k % 12 + 1, 1), float((k * s) % 7 * (k % 3 > 0))) for p, s in (("a", 3), ("b", 5), ("d", 2)) for k in range(36)] + [("c", dt.date(2020, 1, 1), 1.0)]
    held = materialized(models.series(spark.createDataFrame(rows, "product string, date date, y double")))
    board, shown = evaluate.board_of(evaluate.judged(held))
    none = evaluate.judged(held, every=None, once=True)
    plain = lambda df: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]
    want = evaluate.portfolio_metrics(board, shown)
    assert plain(evaluate.portfolio_of(none).select(*want.columns)) == plain(want) and plain(want)[0][-1] == 3
    means = held.select("product", "mean")
    assert plain(forecast.metric_cards(None, None, None, means, evaluate.portfolio_of(none))) == plain(forecast.metric_cards(board, shown, None, means))
    empty = evaluate.portfolio_of(none.where("product = 'c'"))
    assert plain(empty.select(*want.columns)) == plain(evaluate.portfolio_metrics(board, shown.where("product = 'c'")).drop("n_products").selectExpr("*", "0L AS n_products"))


def test_totals_of_products_are_built_once(spark):
    """Every figure that decides on a segment reads the written totals, not the panel. NULL demand, a product without name, equal rows, no row."""
    from demandspark.operators import segments

    run = spark.sparkContext.accumulator(0)

    def seen(batches):
        run.add(1)
        yield from batches

    rows = [(p, dt.date(2020 + k // 12, k % 12 + 1, 1), y) for p, n, y in (("a", 24, 9.0), ("b", 24, 2.0), ("c", 5, 4.0), ("d", 20, 0.0), (None, 14, 3.0)) for k in range(n)]
    rows += [("b", dt.date(2021, 12, 1), 2.0), ("b", dt.date(2022, 1, 1), None), ("c", dt.date(2020, 6, 1), -4.0)]
    panel = spark.createDataFrame(rows, "product string, date date, y double")
    out = segments.product_segments(panel.coalesce(1).mapInArrow(seen, panel.schema))
    found = {tuple(r) for r in out.collect()}
    assert run.value == 1
    assert found == {("a", 24, 216.0, 0.0, "high_volume"), ("b", 26, 50.0, 0.0, "normal"), ("c", 6, 20.0, 0.0, "short_history"), ("d", 20, 0.0, 1.0, "intermittent"), (None, 14, 42.0, 0.0, "normal")}
    assert segments.product_segments(panel.limit(0)).collect() == []
    assert [r["n_points"] for r in segments.fold_cutoffs(out).where("product = 'b'").collect()] == [26] * 3


def test_seasons_read_the_panel_once(spark):
    """Span and months come from one pass. Rows without product, date or demand, equal months, repeated rows, no row."""
    from demandspark.operators import features

    run = spark.sparkContext.accumulator(0)

    def seen(batches):
        run.add(1)
        yield from batches

    rows = [(p, dt.date(2020 + k // 12, k % 12 + 1, 1), float(y(k))) for p, n, y in (("hot", 24, lambda k: 9 if 4 <= k % 12 <= 7 else 1), ("even", 24, lambda k: 5), ("new", 17, lambda k: k), (None, 24, lambda k: k % 12)) for k in range(n)]
    rows += [("tie", dt.date(2020 + k // 6, k % 6 + 1, 1), float(k % 2)) for k in range(12)] + [("tie", dt.date(2020, 1, 1), 0.0), ("tie", dt.date(2022, 6, 1), None), ("tie", None, 8.0), ("undated", None, 1.0)]
    panel = spark.createDataFrame(rows, "product string, date date, y double")
    out = features.seasonal_detection(panel.coalesce(1).mapInArrow(seen, panel.schema))
    found = {r["product"]: (r["pattern_type"], r["peak_months"], r["low_months"], r["detection_source"]) for r in out.collect()}
    none = ("undetected", [], [], "undetected")
    assert found == {"hot": ("summer_peak", [5, 6, 7, 8], [1, 2, 3, 4], "data_driven"), "even": ("year_round", [], [], "data_driven"), "tie": ("winter_peak", [2], [1, 3], "data_driven"), "new": none, "undated": none}
    assert run.value == 1
    assert features.seasonal_detection(panel.limit(0)).collect() == []


def test_a_dealt_table_is_not_shuffled_again(spark, capsys, monkeypatch, tmp_path):
    """A panel written by product: seasons, features and their join find each product in one task. Keys without value and repeated rows are kept."""
    from demandspark.operators import features

    path = str(tmp_path / "items.parquet")
    spark.range(20000).selectExpr("IF(id % 50 = 0, NULL, CAST(id % 50 AS STRING)) AS product", "add_months(DATE'2020-01-01', CAST(id DIV 50 % 40 AS INT)) AS date", "CAST(id % 7 AS DOUBLE) AS y").write.parquet(path)
    rows = spark.read.parquet(path)
    before = spark.conf.get(tables.WRITERS)
    held = tables.materialized(rows, by="product")
    listed = lambda df: sorted(map(repr, df.collect()))
    assert listed(held) == listed(rows) and listed(held.where("product IS NULL")) == listed(rows.where("product IS NULL"))
    assert spark.conf.get(tables.WRITERS) == before and not [t for t in spark.catalog.listTables() if t.name.startswith("kept_")]
    assert tables.materialized(rows.limit(0), by="product").count() == 0

    p = tables.materialized(P.panel(rows.withColumnRenamed("y", "qty")), by="product")
    assert tables.spread_again(p, "product", p) is p
    seasons = features.seasonal_detection(p)
    assert "Exchange" not in plan_of(seasons, capsys)
    monkeypatch.setattr(tables, "TASK_BYTES", 1 << 30)  # the seasons' own files are few
    told, plain = tables.materialized(seasons), tables.materialized(p.select("*"))
    level = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        whole = features.build_features(p, detected=told)
        plan = plan_of(whole, capsys)
        assert plan.count("Exchange") <= 1 and "Exchange" not in plan[: plan.index("Bucketed: true")]  # none above the panel
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", level)
    assert listed(whole) == listed(features.build_features(plain, detected=features.seasonal_detection(plain)))
    tables.dropped(p)


def test_buckets_grow_with_the_files(spark, monkeypatch, tmp_path):
    path = tmp_path / "rows.parquet"
    spark.range(40000).selectExpr("id % 500 AS product", "id").write.parquet(str(path))
    rows, size = spark.read.parquet(str(path)), sum(f.stat().st_size for f in path.glob("part-*"))
    cores = spark.sparkContext.defaultParallelism
    found = []
    for tasks in (cores * 5, cores * 10):
        monkeypatch.setattr(tables, "TASK_BYTES", -(-size // tasks))
        found.append(tables.buckets(rows))
        dealt = tables.spread(rows, "product")
        held = tables.materialized(dealt, by="product")
        assert held.groupBy("product").count().rdd.getNumPartitions() == found[-1] == 2 * dealt.rdd.getNumPartitions()
        assert len(held.inputFiles()) <= found[-1]  # a task's files are its own
    assert found[1] > 1.5 * found[0]
    monkeypatch.setattr(tables, "TASK_BYTES", 1 << 30)
    assert tables.buckets(rows) == 2 and tables.buckets(spark.range(3)) == 1

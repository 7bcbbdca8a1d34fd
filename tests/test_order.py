"""The order of the upload, grouped order statistics, and counts taken on the write."""

from __future__ import annotations

import random
import statistics

import pytest
from demandspark.operators import intake, panel, quality, quantiles, remediation
from demandspark.sources import tables
from pyspark.sql import functions as F


def test_ordinals_follow_files_and_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 5000, 1, 7).selectExpr("id", "id % 3 AS k").write.parquet(path)
    spark.range(5000, 5010, 1, 1).selectExpr("id", "id % 3 AS k").write.mode("append").parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # several splits to a file, and files in no order
    try:
        got = tables.with_ordinal(spark.read.parquet(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    by_file = spark.read.parquet(path).select("id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).orderBy("f", "r").collect()
    assert [r.id for r in sorted(got, key=lambda r: r._row)] == [r.id for r in by_file] and sorted(r._row for r in got) == list(range(5010))
    text = str(tmp_path / "c")
    spark.createDataFrame([(i, "x" * 30) for i in range(800)], "a int, b string").coalesce(1).write.option("header", True).csv(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = tables.with_ordinal(spark.read.option("header", True).csv(text)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(int(r.a) == r._row for r in rows) and len(rows) == 800
    assert tables.with_ordinal(spark.read.parquet(path).where("id < 0")).count() == 0


def test_head_and_sample(spark):
    df = spark.range(500).withColumnRenamed("id", "_row").withColumn("v", F.col("_row") * 2)
    got = {r._row for r in tables.head_and_sample(df, "_row", 50, 120).collect()}
    assert len(got) == 120 and set(range(50)) <= got
    assert got == {r._row for r in tables.head_and_sample(df.repartition(9), "_row", 50, 120).collect()}
    assert tables.head_and_sample(df, "_row", 50, 1000).count() == 500
    assert {r._row for r in tables.head_and_sample(df, "_row", 50, 30).collect()} == set(range(30))


def test_profile_of_the_head_and_a_draw(spark):
    """What stands at the head of a long upload is always seen."""
    df = spark.range(30_000).select(F.when(F.col("id") < 1000, "word").otherwise(F.lit("1")).alias("a"), F.col("id").alias("place"))
    (shape,) = intake.value_shape(df, ordinal="place").collect()
    assert shape["n"] == intake.SAMPLE_ROWS and shape.numeric_share == pytest.approx(1 - intake.HEAD_ROWS / intake.SAMPLE_ROWS)
    found = intake.run_intake(df.select("place", F.lit("2024-01-01").alias("Date"), F.col("a").alias("Product"), F.lit(1.5).alias("Quantity")), ordinal="place")
    assert (found.mapping.date, found.mapping.product, found.mapping.qty) == ("Date", "Product", "Quantity") and found.inputs == []


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 1, None, 3), ("a", 1, "x", 1), (None, 2, "y", 2), (None, 2, "z", 0)], "k string, j int, v string, _row int")
    assert sorted((r.k or "", r.v) for r in remediation.keep_first(df, ["k", "j"], "_row").collect()) == [("", "z"), ("a", "x")]


def test_grouped_quantiles(spark):
    rng = random.Random(1)
    groups = {"few": [3.0], "two": [1.0, 2.0], "signs": [-5.0, -5.0, 0.0, 0.5, 1e6, 7.0, 7.0], "many": [rng.uniform(-100, 100) for _ in range(4001)], "even": [rng.gauss(0, 1e4) for _ in range(600)], "same": [2.5] * 50}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("few", None), (None, 1.0)], "g string, v double")
    per, middle = quantiles.medians(df, "g", "v")
    assert {r.g: (r["median"], r.n) for r in middle.collect()} == {g: (pytest.approx(statistics.median(vs)), len(vs)) for g, vs in groups.items()}
    top = {r.g: r["quantile"] for r in quantiles.grouped_quantile(per, "g", "v", 0.9).collect()}
    for g, vs in groups.items():
        place, s = 0.9 * (len(vs) - 1), sorted(vs)
        low = int(place)
        assert top[g] == pytest.approx(s[low] + (place - low) * (s[min(low + 1, len(s) - 1)] - s[low]))
    plan = middle._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()


def test_no_row_is_expanded(spark):
    df = spark.createDataFrame([("p", "2024-01-01", 1.0, 1, "a", None), ("p", "2024-01-02", 2.0, 1, "b", None), ("q", "2024-01-01", 3.0, 5, "c", 2.0)], "product string, date string, qty double, c1 int, c2 string, c3 double").withColumn("date", F.to_date("date"))
    out = intake.structure(df, "product", "date", ["c1", "c2", "c3"])
    assert "Expand" not in out._jdf.queryExecution().toString()
    assert {r.column: (r.constant_per_product, r.same_across_products) for r in out.collect()} == {"c1": (1.0, 0.5), "c2": (0.5, 0.5), "c3": (1.0, 1.0)}
    assert quality.identifier_columns(df) == ["c2", "c3"]
    binary = panel.period_features(df.withColumn("c4", F.col("qty")), ["c1", "c4"])
    assert {(r["product"], r.c1, r.c4) for r in binary.collect()} == {("p", 1.0, 1.5), ("q", 5.0, 3.0)}


def test_repairs_are_counted_on_their_write(spark):
    rows = [(" p", "2024-01-05", " 3"), ("p", "2024-01-05", "x"), ("p", "2024-01-05", "x"), (None, None, None), ("p", "2024-04-01", "-1"), ("q", "n/a", "2"), ("q", "2024-02-01", None)]
    df = tables.materialized(spark.createDataFrame(rows, "product string, date string, qty string"))
    tracker, told = spark.sparkContext.statusTracker(), {}
    for action in ("trim_whitespace", "remove_empty_rows", "remove_invalid_dates", "standardize_date_format", "remove_exact_duplicates", "remove_invalid_demand", "fill_missing_demand", "remove_negative_demand", "aggregate_duplicate_product_date"):
        want = remediation.impact(df, [action])[action]
        spark.sparkContext.setJobGroup(action, action)
        df, told[action] = remediation.apply_counted(df, action)
        if action in ("trim_whitespace", "remove_empty_rows", "remove_invalid_demand", "fill_missing_demand"):
            assert len(tracker.getJobIdsForGroup(action)) == 1
        assert told[action] == want, action
    assert {a: t["rows_affected"] for a, t in told.items()} == {"trim_whitespace": 2, "remove_empty_rows": 1, "remove_invalid_dates": 1, "standardize_date_format": 5, "remove_exact_duplicates": 1, "remove_invalid_demand": 1, "fill_missing_demand": 1, "remove_negative_demand": 1, "aggregate_duplicate_product_date": 0}
    df, made = remediation.apply_counted(df.unionByName(df.withColumn("date", F.add_months("date", 4))), "insert_missing_periods")
    assert made["new_periods_created"] > 0 and df.columns == ["product", "date", "qty"]
    assert all(remediation.apply_counted(df.limit(0), a)[1]["rows_affected"] == 0 for a in remediation.EXECUTORS)

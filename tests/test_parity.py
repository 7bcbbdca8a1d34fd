"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest
from demandspark.plans import catalog, catalog_more  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
CHECKED = [
    "monthly_demand", "dense_panel", "panel_monthly", "panel_weekly", "calendar_cyclical", "bounded_ffill_demand", "binary_feature_max", "column_profile", "column_structure", "infer_frequency", "q_invalid_counts", "q_missing_periods", "q_zero_classification", "q_intermittent", "q_longest_zero_run", "q_mad_outliers", "q_seasonal_coverage_gap", "q_irregular_frequency", "r_dedupe", "r_aggregate_duplicates", "r_invalid_dates", "seasonal_detection", "seasonal_features", "external_alignment", "climatology", "feature_relevance_lags", "product_segments", "fold_cutoffs", "fold_golden_values", "candidate_matrix", "fc_seasonal_naive", "fc_ses", "fc_croston", "hybrid_weights", "best_model", "product_forecasts", "chart_data_union", "perf_per_period", "scenario_seasonal_shift", "scenario_impact_top5", "growth_vs_history", "risk_scores",
    "csv_round_trip", "json_round_trip", "external_frame", "external_by_product", "detect_roles", "history_summary", "q_unusual_inventory", "q_unusual_lead_times", "q_issue_records", "repair_impact", "repair_audit", "feature_panel", "feature_ranking", "metric_cards", "leaderboard_all", "direct_total_forecast", "scenario_bounds", "scenario_known_products", "top_growth_products", "high_volume_cut", "risk_alerts", "direction_total", "stream_period_sums", "calendar_grid", "r_first_by_order", "r_keep_first", "head_plus_sample", "scenario_product_peaks", "scenario_impact_summary", "validation_predictions", "direct_total_series"]


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "year"):
        return str(v)[:10]
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, FOLDER), duck.sql(catalog.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


def test_every_query_is_listed():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES

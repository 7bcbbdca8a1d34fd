"""More registered queries: sources and sinks, side tables, findings, and what the catalog's first part leaves out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import band, normalized
from ..functions.scalar import pattern_code
from ..operators import analysis, evaluate, external, features, forecast, insights, intake, models, quality, remediation, segments
from ..operators import panel as P
from ..sources import tables
from ..sources.tables import materialized
from ..types import BIAS_BANDS, ERROR_BANDS, MONTHLY
from . import bindings as B
from .catalog import _ALL, _FC, _FOLD, _M, _SCEN, _SEASON, _SERIES, _SHIFT, _SN, _VAL, _ZERO, MPANEL, PANEL, _baseline, _told, _told_once, _w, _weather, query, r

PPANEL = B.panel_sql(B.PART)


def _folder(spark, name: str) -> str:
    return f"{tables.shared_folder(spark)}/{uuid.uuid4().hex}/{name}"


# --- sources and sinks


@query(f"WITH {PANEL} SELECT product, date, {r('y')} FROM demand")
def csv_round_trip(spark, d):
    """Demand written as CSV and read again as text, then typed."""
    path = _folder(spark, "demand.csv")
    tables.write_csv(P.aggregate_demand(B.brand_rows(spark, d)), path)
    back = tables.read_csv(spark, path)
    return back.select("product", F.to_date("date").alias("date"), F.col("y").try_cast("double").alias("y"))


@query(f"WITH {PANEL} SELECT product, date, CASE WHEN month(date) != 3 THEN round(y, 6) + 0.0 END AS y FROM demand")
def json_round_trip(spark, d):
    """Demand as JSON rows and parsed again: dates as ISO text, values that are no finite number as null."""
    rows = P.aggregate_demand(B.brand_rows(spark, d)).withColumn("y", F.when(F.month("date") != 3, F.col("y")).otherwise(F.lit(float("nan"))))
    read = F.from_json("json", "product string, date string, y double")
    return tables.json_rows(rows).select(read.alias("x")).select("x.product", F.to_date("x.date").alias("date"), "x.y")


_GRID = """sp AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders),
grid AS (SELECT CAST(unnest(generate_series(CASE WHEN date_trunc('month', a) < a THEN date_trunc('month', a) + INTERVAL 1 MONTH ELSE date_trunc('month', a) END, b, INTERVAL 1 MONTH)) AS DATE) AS date FROM sp)"""


def _side_files(spark, d) -> tuple[str, str, str]:
    """(folder, first day, last day): side files made of the orders, by month: their mean price stands for the temperature and their number for the
    humidity, without every fourth month; their summed price for an industry series of every second one."""
    orders = B.read_table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    first, last = (str(x) for x in orders.agg(F.min("day"), F.max("day")).first())
    months = orders.groupBy(F.trunc("day", "month").cast("date").alias("date")).agg(F.round(F.avg("o_totalprice") / 8000, 3).alias("temperature"), F.count("*").cast("double").alias("humidity"), F.round(F.sum("o_totalprice"), 0).alias("ahri_shipments"))
    months, path = materialized(months), _folder(spark, "side")
    tables.write_csv(months.where(F.month("date") % 4 != 0).drop("ahri_shipments"), f"{path}/weather_riyadh_monthly.csv", single=True)
    tables.write_csv(months.where(F.month("date") % 2 == 0).select("date", "ahri_shipments"), f"{path}/ahri_shipments.csv", single=True)
    return path, first, last


@query(f"""WITH {_GRID}, mo AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, round(avg(o_totalprice) / 8000, 3) AS t0, count(*)::DOUBLE AS h0, round(sum(o_totalprice), 0) AS a0 FROM orders GROUP BY 1),
s AS (SELECT date, CASE WHEN month(date) % 4 != 0 THEN t0 END AS t, CASE WHEN month(date) % 4 != 0 THEN h0 END AS h, CASE WHEN month(date) % 2 = 0 THEN a0 END AS a FROM grid LEFT JOIN mo USING (date)),
f AS (SELECT date, coalesce(t, lag(t, 1) OVER (ORDER BY date), lag(t, 2) OVER (ORDER BY date)) AS temperature, coalesce(h, lag(h, 1) OVER (ORDER BY date), lag(h, 2) OVER (ORDER BY date)) AS humidity, coalesce(a, lag(a, 1) OVER (ORDER BY date), lag(a, 2) OVER (ORDER BY date)) AS ahri_shipments FROM s)
SELECT date, CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter, CAST(year(date) AS INT) AS year, {r('temperature', 'humidity', digits=2)}, round(greatest(temperature - 18, 0.0), 2) + 0.0 AS cooling_degree_days,
round(greatest(18 - temperature, 0.0), 2) + 0.0 AS heating_degree_days, {r('ahri_shipments', digits=2)} FROM f""", digits=2)
def external_frame(spark, d):
    """Calendar, weather and industry side by side on the months of the orders; a city without a file falls back to the default one."""
    path, first, last = _side_files(spark, d)
    return external.build_external(spark, first, last, path, city="Nowhere", industry="HVAC")[0].select("date", "month", "quarter", "year", "temperature", "humidity", "cooling_degree_days", "heating_degree_days", "ahri_shipments")


@query(f"""WITH {PANEL}, e AS (SELECT product, date, round(y / 7, 4) AS shelf FROM panel WHERE month(date) % 3 = 0), j AS (SELECT p.*, shelf AS x FROM panel p LEFT JOIN e USING (product, date))
SELECT product, date, {r('y', digits=4)}, round(coalesce(x, lag(x, 1) OVER {_w}, lag(x, 2) OVER {_w}), 4) + 0.0 AS shelf FROM j""", digits=4)
def external_by_product(spark, d):
    """A side table by product and date; its column y is in the panel already, its empty column has no value: both are left out."""
    p = B.brand_panel(spark, d)
    side = p.where(F.month("date") % 3 == 0).select("product", "date", F.lit(-1.0).alias("y"), F.round(F.col("y") / 7, 4).alias("shelf"), F.lit(None).cast("double").alias("blank"))
    return features.align_external(p, side)[0]


# --- intake


@query("SELECT * FROM (VALUES ('date', 'date'), ('product', 'product'), ('qty', 'qty')) AS t(role, found)")
def detect_roles(spark, d):
    """role, found: what intake finds in the dirty upload."""
    m = intake.run_intake(B.dirty_rows(spark, d)).mapping
    return spark.createDataFrame([("date", m.date), ("product", m.product), ("qty", m.qty)], "role string, found string")


@query(f"""WITH {PPANEL}, pt AS (SELECT product, count(DISTINCT date) AS p FROM base GROUP BY 1), g AS (SELECT p.product, bool_or(d.date IS NULL) AS gap, avg(CASE WHEN p.y = 0 THEN 1.0 ELSE 0.0 END) AS z FROM panel p LEFT JOIN demand d ON p.product = d.product AND p.date = d.date GROUP BY 1)
SELECT count(*) AS n_products, round(avg(p), 6) AS points_avg, min(p) AS points_min, max(p) AS points_max, count(*) FILTER (p >= 12) AS n_sufficient, count(*) FILTER (p < 12) AS n_sparse, (SELECT count(*) FROM g WHERE gap) AS products_with_gaps, (SELECT round(avg(z), 6) FROM g) AS avg_zero_period_ratio FROM pt""")
def history_summary(spark, d):
    return intake.history_summary(B.part_rows(spark, d))


@query(f"WITH {B.DIRTY} SELECT DISTINCT product AS name, regexp_replace(lower(trim(product)), '[\\s_\\-./]+', '', 'g') AS normalized FROM base WHERE product IS NOT NULL")
def normalized_names(spark, d):
    return B.dirty_rows(spark, d).where("product IS NOT NULL").select(F.col("product").alias("name"), normalized(F.col("product")).alias("normalized")).distinct()


# --- quality and repairs


@query(f"WITH {B.BRAND} SELECT count(*) FILTER (qty - 20 < 0) AS n_negative, count(qty) AS n_values FROM base")
def q_unusual_inventory(spark, d):
    return quality.negative_values(B.brand_rows(spark, d).withColumn("stock", (F.col("qty") - 20).cast("string")), "stock")


@query(f"""WITH {B.BRAND}, v AS (SELECT round(price / 100, 0) - 11 AS v FROM base), m AS (SELECT median(v) AS med FROM v), dv AS (SELECT v, abs(v - med) AS dev FROM v, m), s AS (SELECT median(dev) AS mad FROM dv)
SELECT count(*) FILTER (v <= 0) AS n_not_positive, count(*) FILTER (mad > 0 AND dev > 1.5 * mad) AS outliers FROM dv, s""")
def q_unusual_lead_times(spark, d):
    return quality.lead_time_figures(B.brand_rows(spark, d).withColumn("days", F.round(F.col("price") / 100, 0) - 11), "days", factor=1.5)


_ISSUES = f"""WITH {PPANEL}, {_ZERO},
dup AS (SELECT sum(n) AS n, sum(n - 1) AS k FROM (SELECT count(*) AS n FROM base GROUP BY product, date, qty)),
len AS (SELECT product, count(*) AS n FROM panel GROUP BY 1), low AS (SELECT count(*) AS n, min(n) AS m FROM len WHERE n < 12),
mis AS (SELECT sum(n - seen) AS k FROM (SELECT product, datediff('month', min(p), max(p)) + 1 AS n, count(*) AS seen FROM (SELECT DISTINCT product, {B.MONTH} AS p FROM base) GROUP BY 1)),
mul AS (SELECT sum(n - 1) AS k, avg(CASE WHEN d > 1 THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT product, {B.MONTH} AS p, count(*) AS n, count(DISTINCT qty) AS d FROM base GROUP BY 1, 2) WHERE n > 1),
itm AS (SELECT count(*) AS k FROM (SELECT product FROM zeros GROUP BY 1 HAVING avg(CASE WHEN zero_kind IN ('structural', 'unclassified') THEN 1.0 ELSE 0.0 END) > 0.3 AND count(*) >= 6)),
uns AS (SELECT count(*) AS k FROM zeros WHERE zero_kind = 'unclassified'),
run AS (SELECT product FROM (SELECT product, y, row_number() OVER {_w} - row_number() OVER (PARTITION BY product, y = 0 ORDER BY date) AS i FROM panel) WHERE y = 0 GROUP BY product, i HAVING count(*) >= 4),
gap AS (SELECT count(DISTINCT product) AS k FROM run WHERE product IN (SELECT product FROM zeros WHERE zero_kind != 'seasonal' GROUP BY 1 HAVING count(*) >= 4)),
frq AS (SELECT count(DISTINCT CAST(date AS DATE)) AS k, median(g) AS g FROM (SELECT date, CAST(date AS DATE) - lag(CAST(date AS DATE)) OVER (ORDER BY date) AS g FROM base)),
med AS (SELECT product, median(qty) AS m FROM base GROUP BY 1 HAVING count(*) >= 8), dev AS (SELECT b.product, abs(qty - m) AS dev FROM base b JOIN med USING (product)),
far AS (SELECT count(*) AS k FROM dev JOIN (SELECT product, median(dev) AS mad FROM dev GROUP BY 1 HAVING median(dev) > 0) USING (product) WHERE dev > 5 * mad),
con AS (SELECT sum(n) AS k, max(n) / sum(n) AS share FROM (SELECT count(*) AS n FROM base WHERE qty != 0 GROUP BY qty)),
cov AS (SELECT count(*) AS k, max(t) / sum(t) AS share FROM (SELECT sum(greatest(qty, 0)) AS t FROM base GROUP BY product)),
sea AS (SELECT datediff('day', min(date), max(date)) AS span, count(DISTINCT month(date)) AS m FROM base),
old AS (SELECT count(*) AS k FROM (SELECT product, max(date) AS l FROM base GROUP BY 1) WHERE datediff('day', l, (SELECT max(date) FROM base)) > 90),
iss(issue_type, severity, confidence, affected_records, recommended_action) AS (
  SELECT 'exact_duplicate_rows', CASE WHEN k / n < 0.02 THEN 'info' ELSE 'warning' END, CASE WHEN k / n < 0.02 THEN 0.6 ELSE 0.4 END, k, CASE WHEN k / n < 0.02 THEN 'remove_exact_duplicates' ELSE 'review_duplicates' END FROM dup WHERE k > 0
  UNION ALL SELECT 'insufficient_history', CASE WHEN m < 6 THEN 'warning' ELSE 'info' END, 0.9, n, 'collect_more_history' FROM low WHERE n > 0
  UNION ALL SELECT 'missing_periods', 'warning', 0.7, k, 'insert_missing_periods' FROM mis WHERE k > 0
  UNION ALL SELECT 'multiple_records_same_product_period', CASE WHEN share >= 0.5 THEN 'info' ELSE 'warning' END, CASE WHEN share >= 0.5 THEN 0.85 ELSE 0.5 END, k, CASE WHEN share >= 0.5 THEN 'aggregate_duplicate_product_date' ELSE 'review_duplicates' END FROM mul WHERE k > 0
  UNION ALL SELECT 'intermittent_demand', 'info', CASE WHEN uns.k > 0 THEN 0.4 ELSE 0.8 END, itm.k, 'review_intermittent' FROM itm, uns WHERE itm.k > 0
  UNION ALL SELECT 'large_temporal_gaps', 'warning', 0.6, k, 'review_coverage' FROM gap WHERE k > 0
  UNION ALL SELECT 'irregular_frequency', 'warning', 0.6, k, 'review_coverage' FROM frq WHERE k >= 10 AND g > 90
  UNION ALL SELECT 'unusual_demand_observations', 'info', 0.5, k, 'review_outliers' FROM far WHERE k > 0
  UNION ALL SELECT 'suspicious_constant_demand', 'info', 0.6, k, 'review_coverage' FROM con WHERE k >= 50 AND share > 0.95
  UNION ALL SELECT 'product_coverage_imbalance', 'info', 0.8, k, 'review_coverage' FROM cov WHERE k >= 3 AND share > 0.6
  UNION ALL SELECT 'seasonal_coverage_gap', 'warning', 0.8, 12 - m, 'review_coverage' FROM sea WHERE span >= 365 AND m < 12
  UNION ALL SELECT 'recent_history_gap', 'warning', 0.7, k, 'review_coverage' FROM old WHERE k > 0)"""


def _issues(spark, d) -> list[quality.Issue]:
    return quality.issues(B.part_rows(spark, d))


@query(f"""{_ISSUES} SELECT CAST(row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, affected_records DESC) AS INT) AS place, issue_type, severity, CAST(confidence AS DOUBLE) AS confidence, CAST(affected_records AS BIGINT) AS affected_records, recommended_action FROM iss""")
def q_issue_records(spark, d):
    rows = [(k, i.issue_type, i.severity, i.confidence, int(i.affected_records), i.recommended_action) for k, i in enumerate(_issues(spark, d), 1)]
    return spark.createDataFrame(rows, "place int, issue_type string, severity string, confidence double, affected_records long, recommended_action string")


@query(f"""{_ISSUES}, pen AS (SELECT issue_type, CASE severity WHEN 'critical' THEN 40 WHEN 'warning' THEN 15 ELSE 4 END * greatest(confidence, 0.3) AS p FROM iss),
s AS (SELECT round_even(greatest(0, 100 - coalesce(sum(p), 0)), 0) AS f FROM pen WHERE issue_type NOT IN ('unusual_demand_observations', 'suspicious_constant_demand'))
SELECT 'forecast' AS area, CAST(f AS INT) AS score FROM s UNION ALL SELECT 'inventory', 0 FROM s UNION ALL SELECT 'scenario', CAST(round_even(least(100, 0.5 * f + 50), 0) AS INT) FROM s""")
def value_readiness(spark, d):
    return spark.createDataFrame(list(quality.readiness(_issues(spark, d), {"price"}).items()), "area string, score int")


_CHANGES = ("trim_whitespace", "remove_empty_rows", "fill_missing_demand", "remove_invalid_dates", "remove_invalid_demand", "remove_negative_demand", "standardize_product_identifiers", "remove_exact_duplicates", "aggregate_duplicate_product_date")


@query(f"""WITH {B.DIRTY}, t AS (SELECT *, TRY_CAST(date AS DATE) AS dd, TRY_CAST(qty AS DOUBLE) AS q FROM base), c(action, k, removes) AS (
SELECT 'trim_whitespace', count(*) FILTER (product != trim(product)) + count(*) FILTER (date != trim(date)) + count(*) FILTER (qty != trim(qty)), FALSE FROM t
UNION ALL SELECT 'remove_empty_rows', count(*) FILTER (product IS NULL AND date IS NULL AND qty IS NULL AND order_id IS NULL), TRUE FROM t
UNION ALL SELECT 'fill_missing_demand', count(*) FILTER (q IS NULL), FALSE FROM t
UNION ALL SELECT 'remove_invalid_dates', count(*) FILTER (dd IS NULL AND date IS NOT NULL), TRUE FROM t
UNION ALL SELECT 'remove_invalid_demand', count(*) FILTER (q IS NULL AND qty IS NOT NULL), TRUE FROM t
UNION ALL SELECT 'remove_negative_demand', count(*) FILTER (q < 0), TRUE FROM t
UNION ALL SELECT 'standardize_product_identifiers', count(*) FILTER (product != trim(product)), FALSE FROM t
UNION ALL SELECT 'remove_exact_duplicates', sum(n - 1), TRUE FROM (SELECT count(*) AS n FROM t GROUP BY product, date, qty, order_id)
UNION ALL SELECT 'aggregate_duplicate_product_date', sum(n - 1), TRUE FROM (SELECT count(*) AS n FROM t WHERE product IS NOT NULL AND dd IS NOT NULL GROUP BY product, dd))
SELECT action, CAST(k AS BIGINT) AS rows_affected, CAST(CASE WHEN removes THEN k ELSE 0 END AS BIGINT) AS records_removed, CAST(CASE WHEN removes THEN 0 ELSE k END AS BIGINT) AS values_modified FROM c""")
def repair_impact(spark, d):
    told = remediation.impact(B.dirty_rows(spark, d), list(_CHANGES))
    return spark.createDataFrame([(a, told[a]["rows_affected"], told[a]["records_removed"], told[a]["values_modified"]) for a in _CHANGES], "action string, rows_affected long, records_removed long, values_modified long")


@query(f"""WITH {B.DIRTY}, t AS (SELECT trim(product) AS product, TRY_CAST(trim(date) AS DATE) AS date, trim(qty) AS qty, order_id FROM base), c AS (SELECT count(*) FILTER (product != trim(product)) + count(*) FILTER (date != trim(date)) + count(*) FILTER (qty != trim(qty)) AS k, count(*) AS n FROM base),
u AS (SELECT sum(n - 1) AS k FROM (SELECT count(*) AS n FROM t GROUP BY product, date, qty, order_id))
SELECT * FROM (SELECT 'trim_whitespace' AS action, 'applied' AS status, CAST(k AS BIGINT) AS records_affected, CAST(0 AS BIGINT) AS records_removed FROM c UNION ALL SELECT 'remove_empty_rows', 'applied', 0, 0 UNION ALL SELECT 'standardize_date_format', 'applied', n, 0 FROM c
UNION ALL SELECT 'remove_exact_duplicates', 'applied', CAST(k AS BIGINT), CAST(k AS BIGINT) FROM u UNION ALL SELECT 'remove_invalid_demand', 'not_applied', 0, 0 UNION ALL SELECT 'review_outliers', 'not_applied', 0, 0)""")
def repair_audit(spark, d):
    plan = {"auto": [{"action": a} for a in ("trim_whitespace", "remove_empty_rows", "standardize_date_format")], "review": [{"action": a} for a in ("remove_exact_duplicates", "remove_invalid_demand")], "advisory": [{"action": "review_outliers"}]}
    _, audit = remediation.execute_plan(B.dirty_rows(spark, d), plan, ("remove_exact_duplicates",))
    return audit.select("action", "status", "records_affected", "records_removed")


# --- features


def _over(n: int) -> str:
    return f"(PARTITION BY product ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


_FEATURES = f"""{MPANEL}, {_SEASON}, ftr AS (SELECT product, date, y, CAST(row_number() OVER {_w} - 1 AS INT) AS time_index, {', '.join(f'lag(y, {k}) OVER {_w} AS lag_{k}' for k in MONTHLY.lags)},
{', '.join(f'CASE WHEN count(y) OVER {_over(n)} >= {max(1, n // 2)} THEN avg(y) OVER {_over(n)} END AS rolling_mean_{n}' for n in MONTHLY.windows)}, CASE WHEN count(y) OVER {_over(3)} >= 2 THEN stddev_samp(y) OVER {_over(3)} END AS rolling_std_3 FROM panel),
ftp AS (SELECT f.*, CASE WHEN lag_1 IS NOT NULL AND lag_3 IS NOT NULL THEN CASE WHEN lag_3 > 0 THEN lag_1 / lag_3 - 1 ELSE 0.0 END END AS pop_growth, peak_list, low_list, pattern_type FROM ftr f JOIN det USING (product))"""
_FCOLS = f"""product, date, {r('y', digits=4)}, CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter, CAST(year(date) AS INT) AS year, round(sin(2 * pi() * (month(date) - 1) / 12), 4) + 0.0 AS month_sin, round(cos(2 * pi() * (month(date) - 1) / 12), 4) + 0.0 AS month_cos,
time_index, {r('lag_1', 'lag_3', 'lag_12', 'rolling_mean_3', 'rolling_mean_6', 'rolling_std_3', 'pop_growth', digits=4)}"""
def _seasoned(spark, d) -> tuple[DataFrame, DataFrame]:
    """(panel, its seasons), each written once; the panel stays dealt by product."""
    p = materialized(B.mixed_panel(spark, d), by="product")
    return tables.spread_again(p, "product", p), materialized(features.seasonal_detection(p))


_TO_PEAK = "CAST(list_min(list_transform(peak_list, lambda k: (k - month(date) + 12) % 12)) AS INT)"


@query(f"WITH {_FEATURES} SELECT {_FCOLS}, list_contains(peak_list, month(date)) AS is_peak_season, list_contains(low_list, month(date)) AS is_low_season, {_TO_PEAK} AS months_to_peak, pattern_type AS seasonal_pattern_type FROM ftp", digits=4)
def feature_panel(spark, d):
    p, seasons = _seasoned(spark, d)
    return features.build_features(p, detected=seasons).withColumn("months_to_peak", F.col("months_to_peak").cast("int"))


@query(f"""WITH {_FEATURES} SELECT {_FCOLS}, CAST(list_contains(peak_list, month(date)) AS INT) AS is_peak_season, CAST(list_contains(low_list, month(date)) AS INT) AS is_low_season, {_TO_PEAK} AS months_to_peak,
CAST(CASE pattern_type WHEN 'summer_peak' THEN 0 WHEN 'winter_peak' THEN 1 WHEN 'shoulder_peak' THEN 2 WHEN 'year_round' THEN 3 WHEN 'irregular' THEN 4 ELSE 5 END AS INT) AS seasonal_pattern_type FROM ftp""", digits=4)
def tree_matrix(spark, d):
    p, seasons = _seasoned(spark, d)
    return features.numeric_features(p, detected=seasons).withColumn("months_to_peak", F.col("months_to_peak").cast("int"))


@query(f"WITH {MPANEL}, {_SEASON} SELECT product, CAST(CASE pattern_type WHEN 'summer_peak' THEN 0 WHEN 'winter_peak' THEN 1 WHEN 'shoulder_peak' THEN 2 WHEN 'year_round' THEN 3 WHEN 'irregular' THEN 4 ELSE 5 END AS INT) AS code FROM det")
def pattern_codes(spark, d):
    return features.seasonal_detection(B.mixed_panel(spark, d)).select("product", pattern_code(F.col("pattern_type")).alias("code"))


_RANK = [("root", "sqrt(y)"), ("late", "CASE WHEN year(date) >= 2001 THEN y END"), ("flat", "1.0"), ("month", "CAST(month(date) AS DOUBLE)")]


@query(f"""WITH {PANEL}, {', '.join(f"x_{n} AS (SELECT product, date, y, CAST({e} AS DOUBLE) AS x FROM panel), l_{n} AS (SELECT y, x, {', '.join(f'lag(x, {k}) OVER {_w} AS x{k}' for k in range(4))} FROM x_{n}), c_{n} AS (SELECT '{n}' AS feature, count(*) AS n, count(x) AS n_obs, stddev_samp(x) AS s, stddev_samp(y) AS sy, [{', '.join(f'corr(x{k}, y)' for k in range(4))}] AS c FROM l_{n})" for n, e in _RANK)},
a AS ({' UNION ALL '.join(f'SELECT * FROM c_{n}' for n, _ in _RANK)}), b AS (SELECT *, n_obs < 8 OR coalesce(s, 0) = 0 OR coalesce(sy, 0) = 0 AS bare, list_filter([1, 2, 3, 4], lambda k: abs(c[k]) = list_max(list_transform(c, lambda z: abs(z))))[1] AS pos FROM a)
SELECT feature, CASE WHEN NOT bare THEN round(coalesce(c[1], 0.0), 3) + 0.0 END AS correlation_now, CAST(CASE WHEN NOT bare THEN pos - 1 END AS INT) AS best_lag, CASE WHEN NOT bare THEN round(c[pos], 3) + 0.0 END AS best_lag_correlation, round(n_obs / n, 3) + 0.0 AS coverage, n_obs,
CASE WHEN bare THEN 'insufficient_history' WHEN abs(c[pos]) >= 0.5 THEN 'strong' WHEN abs(c[pos]) >= 0.25 THEN 'moderate' ELSE 'weak' END AS verdict FROM b""", digits=3)
def feature_ranking(spark, d):
    p = B.brand_panel(spark, d).withColumns({"root": F.sqrt("y"), "late": F.when(F.year("date") >= 2001, F.col("y")), "flat": F.lit(1.0), "month": F.month("date")})
    return features.ranked_relevance(p, [n for n, _ in _RANK])


# --- leaderboard and forecasts


@query(f"""{_ALL} SELECT product, model_name, CASE WHEN wmape IS NULL THEN 'poor' WHEN wmape <= 0.10 THEN 'excellent' WHEN wmape <= 0.20 THEN 'good' WHEN wmape <= 0.35 THEN 'needs_attention' ELSE 'poor' END AS error_label,
CASE WHEN forecast_bias IS NULL THEN 'poor' WHEN abs(forecast_bias) <= 0.05 THEN 'excellent' WHEN abs(forecast_bias) <= 0.15 THEN 'good' WHEN abs(forecast_bias) <= 0.30 THEN 'needs_attention' ELSE 'poor' END AS bias_label FROM sel WHERE selected""")
def label_bands(spark, d):
    best = evaluate.board_of(_told_once(spark, d))[0].where("scope = 'product' AND selected")
    return best.select("product", "model_name", band(F.col("wmape"), ERROR_BANDS, "poor").alias("error_label"), band(F.abs("forecast_bias"), BIAS_BANDS, "poor").alias("bias_label"))


_BEST = "best AS (SELECT product, model_name AS model_used FROM sel WHERE selected)"
_PORT = "port AS (SELECT avg(abs(e.validation_prediction - actual)) AS mae, sqrt(avg((e.validation_prediction - actual) ** 2)) AS rmse, avg(CASE WHEN actual != 0 THEN abs(e.validation_prediction - actual) / abs(actual) END) AS mape, sum(abs(e.validation_prediction - actual)) / sum(abs(actual)) AS wmape, sum(e.validation_prediction - actual) / sum(abs(actual)) AS bias, count(DISTINCT e.product) AS n_products FROM every e JOIN best b ON e.product = b.product AND e.model_name = b.model_used)"
_MEAN = "mdm AS (SELECT avg(m) AS md FROM (SELECT avg(y) AS m FROM panel GROUP BY product))"


@query(f"WITH {MPANEL}, {_MEAN} SELECT {r('md').replace('AS md', 'AS mean_demand')} FROM mdm")
def portfolio_mean_demand(spark, d):
    return forecast.mean_demand(B.mixed_panel(spark, d))


@query(f"""{_ALL}, {_BEST}, {_PORT}, {_MEAN}, crd AS (SELECT md, unnest(['wMAPE', 'Forecast Bias', 'MAPE', 'MAE', 'RMSE']) AS metric, unnest([wmape, bias, mape, mae, rmse]) AS value FROM port, mdm),
lab AS (SELECT metric, value, CASE WHEN metric = 'Forecast Bias' THEN abs(value) WHEN metric IN ('MAE', 'RMSE') THEN value / md ELSE value END AS x, CASE WHEN metric = 'Forecast Bias' THEN [0.05, 0.15, 0.30] WHEN metric IN ('MAE', 'RMSE') THEN [0.15, 0.30, 0.50] ELSE [0.10, 0.20, 0.35] END AS b FROM crd)
SELECT metric, {r('value', digits=4)}, CASE WHEN x <= b[1] THEN 'excellent' WHEN x <= b[2] THEN 'good' WHEN x <= b[3] THEN 'needs_attention' ELSE 'poor' END AS label, CASE WHEN metric = 'Forecast Bias' THEN CASE WHEN value > 0.05 THEN 'over-forecasting' WHEN value < -0.05 THEN 'under-forecasting' ELSE 'balanced' END END AS direction FROM lab""", digits=4)
def metric_cards(spark, d):
    held = B.mixed_series(spark, d)
    told = evaluate.judged(held, every=None, once=True)
    return forecast.metric_cards(None, None, None, held.select("product", "mean"), evaluate.portfolio_of(told))


@query(f"""{_ALL} SELECT model_name, status, count(*) AS n FROM (SELECT product, model_name, CASE WHEN model_name IN ('sarima', 'prophet', 'random_forest', 'xgboost') THEN 'skipped' ELSE 'insufficient_history' END AS status FROM (SELECT product, model_name FROM seg JOIN cand USING (segment)) a
WHERE NOT EXISTS (SELECT 1 FROM emet WHERE emet.product = a.product AND emet.model_name = a.model_name)) GROUP BY 1, 2""")
def unvalidated_run_counts(spark, d):
    return evaluate.board_of(_told_once(spark, d))[0].where("scope = 'product' AND status != 'ok'").groupBy("model_name", "status").agg(F.count("*").alias("n"))


_TOTAL = MPANEL.replace("panel AS (", "prd AS (") + ", panel AS (SELECT '__TOTAL__' AS product, date, sum(y) AS y FROM prd GROUP BY date), seg AS (SELECT product, count(*) AS n_points, 'normal' AS segment FROM panel GROUP BY 1)"


@query(f"""WITH {_TOTAL}, {_VAL[_VAL.index(_FOLD):]}, fas AS (SELECT *, validation_prediction - actual AS e FROM val WHERE model_name IN ('naive', 'seasonal_naive', 'moving_average', 'exponential_smoothing')),
met AS (SELECT model_name, cand_ord, sqrt(avg(e ** 2)) AS rmse, avg(abs(e)) AS mae, sum(abs(e)) / sum(abs(actual)) AS wmape, sum(e) / sum(abs(actual)) AS bias FROM fas GROUP BY 1, 2), sel AS (SELECT * FROM met ORDER BY round(wmape, 9), round(abs(bias), 9), round(mae, 9), cand_ord LIMIT 1),
stp AS (SELECT ys AS tr_ys, last, step, model_name, rmse FROM ser, sel, range(1, 13) t(step)), one AS (SELECT *, greatest(CASE model_name {' '.join(f"WHEN '{m}' THEN {s}" for m, s in _M.items() if m != 'croston')} END, 0.0) AS f FROM stp)
SELECT CAST(last + to_months(CAST(step AS INT)) AS DATE) AS date, round(f, 3) + 0.0 AS direct_total_forecast, round(greatest(f - 1.28 * rmse, 0.0), 3) + 0.0 AS lower_bound, round(f + 1.28 * rmse, 3) + 0.0 AS upper_bound, model_name AS model_used, CAST(step AS INT) AS horizon_step FROM one""", digits=3)
def direct_total_forecast(spark, d):
    return forecast.direct_total(B.mixed_panel(spark, d))


@query(f"""{_FC}, act AS (SELECT date, sum(y) AS actual FROM panel GROUP BY 1), tot AS (SELECT date, sum(forecast) AS forecast FROM fc GROUP BY 1) SELECT date, {r('actual', 'forecast', digits=6)} FROM act FULL JOIN tot USING (date)""", digits=6)
def actual_forecast_overlay(spark, d):
    held, told = _told(spark, d)
    return forecast.overlay(P.rows_of(held), forecast.total_forecast(forecast.product_forecasts(None, None, used=forecast.used_of(told))))


@query(f"""{_FC}, {_PORT}, tot AS (SELECT date, sum(forecast) AS t FROM fc GROUP BY 1), whl AS (SELECT sum(t) AS total_expected_demand, arg_max(date, (round(t, 6), -datediff('day', DATE '1970-01-01', date))) AS peak_forecast_period, count(*) AS forecast_horizon FROM tot),
pool AS (SELECT model_name, cand_ord, avg(abs(validation_prediction - actual)) AS mae, sum(abs(validation_prediction - actual)) / sum(abs(actual)) AS wmape, sum(validation_prediction - actual) / sum(abs(actual)) AS bias FROM every GROUP BY 1, 2)
SELECT round(round(wmape, 4), 6) + 0.0 AS portfolio_wmape, round(bias, 6) + 0.0 AS forecast_bias, CASE WHEN bias > 0.05 THEN 'over-forecasting' WHEN bias < -0.05 THEN 'under-forecasting' ELSE 'balanced' END AS bias_direction,
CASE WHEN wmape <= 0.10 THEN 'excellent' WHEN wmape <= 0.20 THEN 'good' WHEN wmape <= 0.35 THEN 'needs_attention' ELSE 'poor' END AS confidence_label, n_products AS n_products_evaluated, round(total_expected_demand, 6) AS total_expected_demand, peak_forecast_period, forecast_horizon,
(SELECT model_name FROM pool ORDER BY round(wmape, 9), round(abs(bias), 9), round(mae, 9), cand_ord LIMIT 1) AS best_overall_model, (SELECT count(DISTINCT product) FROM fc) AS n_products_forecasted FROM port, whl""", digits=6)
def forecast_summary(spark, d):
    told = evaluate.judged(B.mixed_series(spark, d), every=None)
    out = forecast.product_forecasts(None, None, used=forecast.used_of(told))
    return forecast.forecast_summary(evaluate.board_of(told)[0], None, out, forecast.total_forecast(out), evaluate.portfolio_of(told))


# --- scenarios and findings


@query(f"""{_SHIFT} SELECT product, date, round(forecast, 4) + 0.0 AS forecast, CASE WHEN month(date) != 5 THEN round(greatest(0.9 * base + forecast - base, 0.0), 4) + 0.0 END AS lower_bound, round(1.1 * base + forecast - base, 4) + 0.0 AS upper_bound, CAST(horizon_step AS INT) AS horizon_step FROM sc""", digits=4)
def scenario_bounds(spark, d):
    """Bounds move with the forecast, from 0; a missing one stays missing."""
    base = _baseline(spark, d).withColumns({"lower_bound": F.when(F.month("date") != 5, 0.9 * F.col("forecast")), "upper_bound": 1.1 * F.col("forecast")})
    return analysis.run_scenario(base, analysis.resolve(_SCEN)[0])


@query("SELECT DISTINCT p_brand AS product FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_brand IN ('Brand#11', 'Brand#23', 'nobody')")
def scenario_known_products(spark, d):
    asked = {"per_product_change_pct": {"Brand#11": 5, "Brand#23": -5, "nobody": 1}}
    return spark.createDataFrame([(p,) for p in sorted(analysis.known_products(_baseline(spark, d), asked))], "product string")


@query(f"""WITH {_SN}, f AS (SELECT product, avg(forecast) AS fm, sum(forecast) AS volume, count(*) AS n FROM bl GROUP BY 1), b AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY date DESC) AS k FROM panel), c AS (SELECT product, avg(y) AS rm FROM b JOIN f USING (product) WHERE k <= n GROUP BY 1),
g AS (SELECT product, volume, round_even((fm - rm) / rm, 4) AS growth FROM f JOIN c USING (product) WHERE rm > 0) SELECT product, 'growth_vs_history' AS basis, round(growth, 4) + 0.0 AS growth, round(volume, 4) + 0.0 AS volume FROM g ORDER BY g.growth DESC, g.volume DESC, product LIMIT 8""", digits=4)
def top_growth_products(spark, d):
    return insights.top_growth(insights.growth_ranking(B.brand_panel(spark, d), _baseline(spark, d)))


@query(f"WITH {_SN}, v AS (SELECT product, sum(forecast) AS v, row_number() OVER (ORDER BY sum(forecast) DESC) - 1 AS i, count(*) OVER () AS n FROM bl GROUP BY 1) SELECT round(v, 6) + 0.0 AS cut FROM v WHERE i = greatest(0, n // 5 - 1)")
def high_volume_cut(spark, d):
    return spark.createDataFrame([(insights.volume_cut(_baseline(spark, d)),)], "cut double")


@query(f"""{_FC}, vol AS (SELECT product, sum(forecast) AS volume FROM fc GROUP BY 1), ord AS (SELECT volume, row_number() OVER (ORDER BY volume DESC) - 1 AS i, count(*) OVER () AS n FROM vol), cut AS (SELECT volume AS cut FROM ord WHERE i = greatest(0, n // 5 - 1)),
q AS (SELECT product, segment, wmape, forecast_bias, volume FROM seg FULL JOIN (SELECT product, wmape, forecast_bias FROM sel WHERE selected) USING (product) FULL JOIN vol USING (product)),
s AS (SELECT *, CASE WHEN wmape > 0.35 THEN 2 WHEN wmape > 0.20 THEN 1 ELSE 0 END + CASE WHEN abs(forecast_bias) > 0.30 THEN 2 WHEN abs(forecast_bias) > 0.15 THEN 1 ELSE 0 END + CASE WHEN segment IN ('intermittent', 'short_history') THEN 1 ELSE 0 END + CASE WHEN round(coalesce(volume, 0), 6) >= round(cut, 6) THEN 1 ELSE 0 END AS score FROM q, cut)
SELECT product, CAST(score AS INT) AS score, CASE WHEN score >= 3 THEN 'high' WHEN score >= 1 THEN 'medium' ELSE 'low' END AS level, round(volume, 6) + 0.0 AS volume FROM s WHERE score > 0""", digits=6)
def risk_alerts(spark, d):
    """The products with any risk, under low confidence: large forecast volumes count as well."""
    told = _told(spark, d)[1]
    out = materialized(forecast.product_forecasts(None, None, used=forecast.used_of(told)))
    return insights.risk_scores(evaluate.board_of(told)[0], told.select("product", "segment"), None, True, out).where("score > 0").select("product", "score", "level", "volume")


# --- the order of the upload

_ORD = "ord AS (SELECT *, row_number() OVER () - 1 AS _row FROM lineitem)"


def _ordered(spark, d) -> DataFrame:
    """Line items with their place in the file."""
    items = B.read_table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    return tables.with_ordinal(items)


@query(f"""WITH {_ORD} SELECT CAST(l_partkey AS VARCHAR) AS product, l_shipdate AS date, CAST(sum(l_quantity) AS DOUBLE) AS qty, arg_min(l_discount, CASE WHEN l_discount > 0.02 THEN _row END) FILTER (l_discount > 0.02) AS discount,
arg_min(l_tax, _row) AS tax, min(_row) AS _row FROM ord GROUP BY 1, 2""")
def r_first_by_order(spark, d):
    """Records of one product and date as one: other columns keep their first value that isn't NULL, in the order of the upload."""
    discount = F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("discount")
    rows = _ordered(spark, d).select(F.col("l_partkey").cast("string").alias("product"), F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("qty"), discount, F.col("l_tax").alias("tax"), "_row")
    return remediation.aggregate_duplicates(rows, order="_row")


@query(f"""WITH {_ORD} SELECT l_partkey, l_discount, _row FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_discount ORDER BY _row) AS k FROM ord) WHERE k = 1""")
def r_keep_first(spark, d):
    """Of the records of a key the first of the upload."""
    return remediation.keep_first(_ordered(spark, d).select("l_partkey", "l_discount", "_row"), ["l_partkey", "l_discount"], "_row")


@query(f"""WITH {_ORD} SELECT _row, l_partkey, l_quantity FROM ord ORDER BY CASE WHEN _row < 1000 THEN '' ELSE md5('0:' || _row::VARCHAR) END, _row LIMIT 10000""")
def head_plus_sample(spark, d):
    """The rows that column understanding looks at: the first thousand and a draw from the rest."""
    return tables.head_and_sample(_ordered(spark, d).select("_row", "l_partkey", "l_quantity"), "_row", intake.HEAD_ROWS, intake.SAMPLE_ROWS)


# --- the stream


@query("""SELECT event_type AS product, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS period_start, round(sum(value), 3) + 0.0 AS y, count(*) AS n FROM events GROUP BY 1, 2""", digits=3)
def stream_period_sums(spark, d):
    """The sums of the event stream, run once over what there is."""
    from ..streaming.ingest import run_available

    rows = materialized(B.read_table(spark, d, "events").select("event_type", "ts", "value").repartition(4))
    path = rows._written_at
    return run_available(spark, path, path + "-sums", path + "-progress", rows.schema).select("product", "period_start", "y", "n")

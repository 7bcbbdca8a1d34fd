"""The registered queries of the demand engine, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import to_date, to_number
from ..operators import analysis, evaluate, external, features, forecast, insights, intake, models, quality, remediation, segments
from ..operators import panel as P
from ..sources.tables import materialized
from ..types import FOLDS, MONTHLY, WEEKLY, RunConfig
from . import bindings as B
from . import pipeline

FLAGSHIP = "panel_monthly"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, so that sums in another order compare equal."""
    return df.select(*((F.round(f.name, digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields))


def query(sql: str | None = None, digits: int = 6):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c.split('.')[-1]}" for c in columns)


PANEL, MPANEL, WPANEL = B.panel_sql(), B.panel_sql(B.MIXED), B.panel_sql(*B.WEEKLY_SQL)
W = "(PARTITION BY product ORDER BY date{})"
_w = W.format("")


# --- demand and panels


@query(f"WITH {B.panel_sql()} SELECT product, date, {r('y')} FROM demand")
def monthly_demand(spark, d):
    return P.aggregate_demand(B.brand_rows(spark, d))


@query(f"WITH {WPANEL} SELECT product, date, {r('y')} FROM demand")
def weekly_demand(spark, d):
    return P.aggregate_demand(B.brand_rows(spark, d), WEEKLY)


@query(f"WITH {PANEL} SELECT product, date, {r('y')} FROM panel")
def dense_panel(spark, d):
    return B.brand_panel(spark, d)


@query(f"WITH {B.panel_sql(B.PART)} SELECT product, date, {r('y')} FROM panel")
def sparse_panel_zero_fill(spark, d):
    return P.panel(B.part_rows(spark, d))


@query(f"WITH {B.panel_sql(B.EVENT, B.WEEK, 'INTERVAL 7 DAY')} SELECT product, date, {r('y', digits=3)} FROM panel", digits=3)
def event_panel_weekly(spark, d):
    return P.panel(B.event_rows(spark, d), WEEKLY)


@query(f"""WITH {B.panel_sql(B.PART)}, p AS (SELECT *, CASE WHEN y > 0 THEN y END AS x FROM panel)
SELECT product, date, {r('y')}, round(coalesce(x, lag(x, 1) OVER {_w}, lag(x, 2) OVER {_w}), 6) + 0.0 AS x FROM p""")
def bounded_ffill_demand(spark, d):
    return P.bounded_ffill(P.panel(B.part_rows(spark, d)).withColumn("x", F.when(F.col("y") > 0, F.col("y"))), "x")


@query(f"""WITH {B.panel_sql(B.PART)}, p AS (SELECT *, CASE WHEN y > 0 THEN y END AS x FROM panel)
SELECT product, date, {r('y')}, round(last_value(x IGNORE NULLS) OVER (PARTITION BY product ORDER BY date ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS x FROM p""")
def unbounded_ffill_demand(spark, d):
    return P.ffill(P.panel(B.part_rows(spark, d)).withColumn("x", F.when(F.col("y") > 0, F.col("y"))), "x", ["product"])


@query(f"WITH {B.BRAND} SELECT product, {B.MONTH} AS date, round(avg(price), 4) + 0.0 AS price FROM base GROUP BY 1, 2", digits=4)
def continuous_feature_mean(spark, d):
    return P.period_feature(B.brand_rows(spark, d), "price")


@query(f"WITH {B.BRAND} SELECT product, {B.MONTH} AS date, CAST(max(CASE WHEN discount > 0.09 THEN 1 ELSE 0 END) AS DOUBLE) AS promo FROM base GROUP BY 1, 2")
def binary_feature_max(spark, d):
    return P.period_feature(B.brand_rows(spark, d).withColumn("promo", (F.col("discount") > 0.09).cast("int")), "promo")


# --- temporal features


def _temporal_sql(panel: str, lags, windows) -> str:
    near, far = f"lag(y, {lags[0]}) OVER {_w}", f"lag(y, {lags[1]}) OVER {_w}"
    cols = [f"CAST(row_number() OVER {_w} - 1 AS INT) AS time_index"] + [f"round(lag(y, {k}) OVER {_w}, 6) + 0.0 AS lag_{k}" for k in lags]
    for n in windows:
        over = W.format(f" ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING")
        cols.append(f"round(CASE WHEN count(y) OVER {over} >= {max(1, n // 2)} THEN avg(y) OVER {over} END, 6) + 0.0 AS rolling_mean_{n}")
    n = windows[0]
    over = W.format(f" ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING")
    cols.append(f"round(CASE WHEN count(y) OVER {over} >= {max(2, n // 2)} THEN stddev_samp(y) OVER {over} END, 6) + 0.0 AS rolling_std_{n}")
    cols.append(f"round(CASE WHEN {near} IS NOT NULL AND {far} IS NOT NULL THEN CASE WHEN {far} > 0 THEN {near} / {far} - 1 ELSE 0.0 END END, 6) + 0.0 AS pop_growth")
    return f"WITH {panel} SELECT product, date, {r('y')}, {', '.join(cols)} FROM panel"


@query(_temporal_sql(PANEL, MONTHLY.lags, MONTHLY.windows))
def panel_monthly(spark, d):
    return P.temporal_features(B.brand_panel(spark, d))


@query(_temporal_sql(WPANEL, WEEKLY.lags, WEEKLY.windows))
def panel_weekly(spark, d):
    return P.temporal_features(B.brand_panel(spark, d, WEEKLY), WEEKLY)


@query(f"""WITH {WPANEL} SELECT product, date, {r('y')}, CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter, CAST(year(date) AS INT) AS year,
round(sin(2 * pi() * (month(date) - 1) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * (month(date) - 1) / 12), 6) + 0.0 AS month_cos, CAST(weekofyear(date) AS INT) AS weekofyear,
round(sin(2 * pi() * (weekofyear(date) - 1) / 52), 6) + 0.0 AS week_sin, round(cos(2 * pi() * (weekofyear(date) - 1) / 52), 6) + 0.0 AS week_cos FROM panel""")
def calendar_cyclical(spark, d):
    return P.calendar_features(B.brand_panel(spark, d, WEEKLY), True)


# --- intake


@query(f"WITH {B.BRAND} SELECT count(*) AS n_rows, count(DISTINCT product) AS n_products, CAST(min(date) AS DATE) AS first_date, CAST(max(date) AS DATE) AS last_date, {r('sum(qty)').replace('AS sum(qty)', 'AS total_qty')}, round(avg(qty), 6) + 0.0 AS mean_qty FROM base")
def dataset_summary(spark, d):
    return intake.summary(B.brand_rows(spark, d)).withColumns({c: F.to_date(c) for c in ("first_date", "last_date")})


@query(f"""WITH {B.BRAND}, t AS (SELECT product, sum(qty) AS total FROM base GROUP BY 1)
(SELECT 'top' AS kind, product, round(total, 6) + 0.0 AS total FROM t ORDER BY t.total DESC, product LIMIT 5) UNION ALL (SELECT 'bottom', product, round(total, 6) + 0.0 FROM t ORDER BY t.total, product LIMIT 5)""")
def top_bottom_products(spark, d):
    return intake.extremes(B.brand_rows(spark, d))


@query(f"""WITH {MPANEL}, c AS (SELECT product, count(*) AS n FROM panel GROUP BY 1)
SELECT min(n) AS min_points, max(n) AS max_points, round(avg(n), 6) AS mean_points, count(*) FILTER (n >= 12) AS n_sufficient, count(*) AS n_products FROM c""")
def history_sufficiency(spark, d):
    return intake.sufficiency(B.mixed_panel(spark, d))


@query(f"""WITH {B.DIRTY}, u AS (
  SELECT 'product' AS "column", count(*) AS n, count(*) - count(product) AS n_null, count(DISTINCT product) AS n_unique, avg(CASE WHEN product IS NOT NULL THEN CASE WHEN TRY_CAST(trim(product) AS DOUBLE) IS NULL THEN 0.0 ELSE 1.0 END END) AS numeric_share FROM base
  UNION ALL SELECT 'qty', count(*), count(*) - count(qty), count(DISTINCT qty), avg(CASE WHEN qty IS NOT NULL THEN CASE WHEN TRY_CAST(trim(qty) AS DOUBLE) IS NULL THEN 0.0 ELSE 1.0 END END) FROM base
  UNION ALL SELECT 'order_id', count(*), count(*) - count(order_id), count(DISTINCT order_id), 1.0 FROM base)
SELECT "column", n, n_null, n_unique, round(numeric_share, 6) + 0.0 AS numeric_share, round(n_null / n, 6) + 0.0 AS null_rate, round(n_unique / (n - n_null), 6) + 0.0 AS unique_ratio,
  CASE WHEN "column" = 'order_id' THEN 'numeric' WHEN numeric_share > 0.8 THEN 'numeric_like' ELSE 'categorical' END AS inferred_dtype FROM u""")
def column_profile(spark, d):
    return intake.column_profile(B.dirty_rows(spark, d).select("product", "qty", "order_id")).select("column", "n", "n_null", "n_unique", "numeric_share", "null_rate", "unique_ratio", "inferred_dtype")


@query(f"""WITH {B.BRAND}, p AS (SELECT product, count(DISTINCT discount) AS a, count(DISTINCT l_suppkey) AS b FROM base GROUP BY 1), t AS (SELECT date, count(DISTINCT discount) AS a, count(DISTINCT l_suppkey) AS b FROM base GROUP BY 1)
SELECT 'discount' AS "column", round(avg(CASE WHEN p.a <= 1 THEN 1.0 ELSE 0.0 END), 6) AS constant_per_product, (SELECT round(avg(CASE WHEN a <= 1 THEN 1.0 ELSE 0.0 END), 6) FROM t) AS same_across_products FROM p
UNION ALL SELECT 'l_suppkey', round(avg(CASE WHEN p.b <= 1 THEN 1.0 ELSE 0.0 END), 6), (SELECT round(avg(CASE WHEN b <= 1 THEN 1.0 ELSE 0.0 END), 6) FROM t) FROM p""")
def column_structure(spark, d):
    return intake.structure(B.brand_rows(spark, d), "product", "date", ["discount", "l_suppkey"])


@query(f"""WITH {B.BRAND}, d AS (SELECT DISTINCT CAST(date AS DATE) AS d FROM base), g AS (SELECT d - lag(d) OVER (ORDER BY d) AS gap FROM d)
SELECT (SELECT count(*) FROM d) AS n_dates, round(CAST(median(gap) AS DOUBLE), 6) AS median_gap, CASE WHEN median(gap) <= 2 THEN 'daily' WHEN median(gap) <= 10 THEN 'weekly' WHEN median(gap) <= 45 THEN 'monthly' WHEN median(gap) <= 135 THEN 'quarterly' ELSE 'yearly' END AS frequency FROM g""")
def infer_frequency(spark, d):
    return intake.infer_frequency(B.brand_rows(spark, d))


# --- quality


@query(f"""WITH {B.DIRTY}, t AS (SELECT *, TRY_CAST(date AS DATE) AS dd, TRY_CAST(qty AS DOUBLE) AS q FROM base)
SELECT count(*) AS n_rows, count(*) FILTER (dd IS NULL AND date IS NOT NULL) AS invalid_dates, count(*) FILTER (date IS NULL) AS null_dates, count(*) FILTER (q IS NULL AND qty IS NOT NULL) AS non_numeric_qty,
count(*) FILTER (q IS NULL) AS invalid_demand, count(*) FILTER (q < 0) AS negative_demand, count(*) FILTER (product IS NULL OR trim(product) = '') AS invalid_products,
count(*) FILTER (product IS NULL AND date IS NULL AND qty IS NULL AND order_id IS NULL) AS empty_rows FROM t""")
def q_invalid_counts(spark, d):
    b = B.dirty_rows(spark, d)
    return quality.invalid_counts(b, to_date(b, "date", "yyyy-MM-dd"), to_number(F.col("qty")), F.col("date"), F.col("qty"), F.col("product"))


@query(f"""WITH {B.BRAND}, x AS (SELECT product, date, qty, count(*) AS n FROM base GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM x""")
def q_exact_duplicates(spark, d):
    return quality.exact_duplicates(B.brand_rows(spark, d).select("product", "date", "qty"))


@query(f"""WITH {B.PART}, s AS (SELECT DISTINCT product, {B.MONTH} AS p FROM base), x AS (SELECT product, CAST(datediff('month', min(p), max(p)) + 1 AS INT) AS n_periods, count(*) AS seen FROM s GROUP BY 1)
SELECT product, n_periods, CAST(n_periods - seen AS INT) AS missing_periods FROM x WHERE n_periods >= 2""")
def q_missing_periods(spark, d):
    return quality.missing_periods(B.part_rows(spark, d))


@query(f"""WITH {B.PART}, x AS (SELECT product, {B.MONTH} AS p, count(*) AS n, count(DISTINCT qty) AS d FROM base GROUP BY 1, 2)
SELECT count(*) AS n_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows, round(avg(CASE WHEN d > 1 THEN 1.0 ELSE 0.0 END), 6) AS share_differing FROM x WHERE n > 1""")
def q_product_period_multiplicity(spark, d):
    return quality.product_period_multiplicity(B.part_rows(spark, d))


_ZERO = """yrs AS (SELECT product, month(date) AS m, year(date) AS yr, bool_and(y = 0) AS z FROM panel GROUP BY 1, 2, 3),
mon AS (SELECT product, m, avg(CASE WHEN z THEN 1.0 ELSE 0.0 END) AS share FROM yrs GROUP BY 1, 2), spn AS (SELECT product, count(DISTINCT year(date)) AS n FROM panel GROUP BY 1),
zeros AS (SELECT p.*, CASE WHEN y != 0 THEN NULL WHEN n < 2 THEN 'unclassified' WHEN share >= 0.7 THEN 'seasonal' ELSE 'structural' END AS zero_kind FROM panel p JOIN mon ON p.product = mon.product AND month(p.date) = mon.m JOIN spn ON p.product = spn.product)"""


@query(f"WITH {MPANEL}, {_ZERO} SELECT product, date, {r('y')}, zero_kind FROM zeros")
def q_zero_classification(spark, d):
    return quality.zero_classification(B.mixed_panel(spark, d))


@query(f"""WITH {B.panel_sql(B.PART)}, {_ZERO}, x AS (SELECT product, count(*) AS n_points, avg(CASE WHEN zero_kind IN ('structural', 'unclassified') THEN 1.0 ELSE 0.0 END) AS structural_ratio FROM zeros GROUP BY 1)
SELECT product, n_points, {r('structural_ratio')}, structural_ratio > 0.30 AND n_points >= 6 AS intermittent FROM x""")
def q_intermittent(spark, d):
    return quality.intermittent(quality.zero_classification(P.panel(B.part_rows(spark, d))))


@query(f"""WITH {B.panel_sql(B.PART)}, x AS (SELECT *, row_number() OVER {_w} - row_number() OVER (PARTITION BY product, y = 0 ORDER BY date) AS i FROM panel), s AS (SELECT product, y = 0 AS z, i, count(*) AS n FROM x GROUP BY 1, 2, 3)
SELECT product, CAST(max(CASE WHEN z THEN n ELSE 0 END) AS BIGINT) AS longest_run FROM s GROUP BY 1""")
def q_longest_zero_run(spark, d):
    return quality.longest_zero_run(P.panel(B.part_rows(spark, d)))


@query(f"""WITH {B.BRAND}, m AS (SELECT product, median(price) AS med, count(*) AS n FROM base GROUP BY 1 HAVING count(*) >= 8), a AS (SELECT b.product, abs(price - med) AS dev FROM base b JOIN m USING (product)),
s AS (SELECT product, median(dev) AS mad FROM a GROUP BY 1 HAVING median(dev) > 0) SELECT a.product, count(*) AS n, count(*) FILTER (dev > 1.5 * mad) AS outliers FROM a JOIN s USING (product) GROUP BY 1""")
def q_mad_outliers(spark, d):
    return quality.mad_outliers(B.brand_rows(spark, d), value="price", factor=1.5)


@query(f"WITH {B.BRAND}, x AS (SELECT qty, count(*) AS n FROM base WHERE qty != 0 GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_rows, round(max(n) / sum(n), 6) AS top_share FROM x")
def q_constant_demand(spark, d):
    return quality.constant_demand(B.brand_rows(spark, d))


@query(f"WITH {B.DIRTY}, x AS (SELECT DISTINCT lower(trim(product)) AS key, product FROM base WHERE product IS NOT NULL) SELECT key, count(*) AS n_spellings FROM x GROUP BY 1 HAVING count(*) > 1")
def q_identifier_variants(spark, d):
    return quality.identifier_variants(B.dirty_rows(spark, d))


@query(f"WITH {B.BRAND}, x AS (SELECT product, sum(greatest(qty, 0)) AS t FROM base GROUP BY 1) SELECT count(*) AS n_groups, round(sum(t), 6) AS total, round(max(t) / sum(t), 6) AS top_share FROM x")
def q_coverage_imbalance(spark, d):
    return quality.dominance(B.brand_rows(spark, d), "product")


@query("""WITH x AS (SELECT r_name, sum(greatest(l_quantity, 0)) AS t FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT count(*) AS n_groups, round(sum(t), 6) AS total, round(max(t) / sum(t), 6) AS top_share FROM x""")
def q_segment_imbalance(spark, d):
    read = lambda t: B.read_table(spark, d, t)
    places = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("region"))
    rows = read("lineitem").select("l_suppkey", F.col("l_quantity").alias("qty")).join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    return quality.dominance(rows, "region")


@query(f"""WITH {B.EVENT}, x AS (SELECT list_sort(list(DISTINCT month(date))) AS m, datediff('day', min(date), max(date)) AS span FROM base)
SELECT CAST(span AS INT) AS span_days, CAST(len(m) AS INT) AS n_months, array_to_string(list_filter(range(1, 13), lambda k: NOT list_contains(m, k)), ',') AS missing_months FROM x""")
def q_seasonal_coverage_gap(spark, d):
    return quality.seasonal_coverage(B.event_rows(spark, d))


@query(f"""WITH {B.PART}, x AS (SELECT product, max(date) AS l FROM base GROUP BY 1), y AS (SELECT product, CAST(datediff('day', l, (SELECT max(l) FROM x)) AS INT) AS days_behind FROM x) SELECT * FROM y WHERE days_behind > 90""")
def q_stale_products(spark, d):
    return quality.stale_products(B.part_rows(spark, d))


@query(f"""WITH {B.BRAND}, g AS (SELECT CAST(date AS DATE) - lag(CAST(date AS DATE)) OVER (ORDER BY date) AS gap FROM base), d AS (SELECT DISTINCT CAST(date AS DATE) AS d FROM base), h AS (SELECT d - lag(d) OVER (ORDER BY d) AS gap FROM d)
SELECT (SELECT count(*) FROM d) AS n_dates, (SELECT round(CAST(median(gap) AS DOUBLE), 6) FROM h) AS median_gap, round(CAST(median(gap) AS DOUBLE), 6) AS median_gap_rows FROM g""")
def q_irregular_frequency(spark, d):
    return quality.median_gap(B.brand_rows(spark, d))


@query(f"WITH {MPANEL} SELECT product, count(*) AS n_points FROM panel GROUP BY 1 HAVING count(*) < 12")
def q_insufficient_history(spark, d):
    return quality.insufficient_history(B.mixed_panel(spark, d))


# --- repairs


_T = f"{B.DIRTY}, t AS (SELECT product, date, qty, order_id, TRY_CAST(date AS DATE) AS dd, TRY_CAST(qty AS DOUBLE) AS q FROM base)"


@query(f"WITH {B.DIRTY} SELECT trim(product) AS product, trim(date) AS date, trim(qty) AS qty, order_id FROM base")
def r_trim(spark, d):
    return remediation.trim_whitespace(B.dirty_rows(spark, d))


@query(f"WITH {B.DIRTY} SELECT DISTINCT product, date, qty FROM base")
def r_dedupe(spark, d):
    return remediation.remove_exact_duplicates(B.dirty_rows(spark, d).select("product", "date", "qty"))


@query(f"WITH {_T} SELECT product, date, coalesce(q, 0.0) AS qty, order_id FROM t")
def r_fill_missing(spark, d):
    return remediation.fill_missing_demand(B.dirty_rows(spark, d))


@query(f"WITH {_T} SELECT product, date, coalesce(sum(q), 0.0) AS qty, min(order_id) AS order_id FROM t WHERE product IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2")
def r_aggregate_duplicates(spark, d):
    return remediation.aggregate_duplicates(B.dirty_rows(spark, d))


@query(f"WITH {_T} SELECT product, date, qty, order_id FROM t WHERE NOT (dd IS NULL AND date IS NOT NULL)")
def r_invalid_dates(spark, d):
    return remediation.remove_invalid_dates(B.dirty_rows(spark, d))


@query(f"WITH {_T} SELECT product, date, qty, order_id FROM t WHERE NOT (q IS NULL AND qty IS NOT NULL)")
def r_invalid_demand(spark, d):
    return remediation.remove_invalid_demand(B.dirty_rows(spark, d))


@query(f"WITH {_T} SELECT product, date, qty, order_id FROM t WHERE q IS NULL OR q >= 0")
def r_negative(spark, d):
    return remediation.remove_negative_demand(B.dirty_rows(spark, d))


@query(f"WITH {_T} SELECT trim(product) AS product, date, qty, order_id FROM t")
def r_standardize_products(spark, d):
    return remediation.standardize_products(B.dirty_rows(spark, d))


@query(f"WITH {_T} SELECT product, dd AS date, qty, order_id FROM t")
def r_standardize_dates(spark, d):
    return remediation.standardize_date_format(B.dirty_rows(spark, d)).withColumn("date", F.to_date("date"))


@query(f"WITH {B.DIRTY} SELECT * FROM base WHERE NOT (product IS NULL AND date IS NULL AND qty IS NULL AND order_id IS NULL)")
def r_empty_rows(spark, d):
    return remediation.remove_empty_rows(B.dirty_rows(spark, d))


@query(f"WITH {B.panel_sql(B.PART)} SELECT product, date, {r('y').replace('AS y', 'AS qty')} FROM panel")
def r_insert_periods(spark, d):
    return remediation.insert_missing_periods(B.part_rows(spark, d))


# --- seasonality and side tables


@query(f"WITH {PANEL} SELECT product, CAST(month(date) AS INT) AS month, round(avg(y), 6) AS mean_y FROM panel GROUP BY 1, 2")
def seasonal_profile(spark, d):
    return features.seasonal_profile(B.brand_panel(spark, d))


_SEASON = """spn AS (SELECT product, (year(max(date)) - year(min(date))) * 12 + month(max(date)) - month(min(date)) + 1 AS span FROM panel GROUP BY 1),
prof AS (SELECT product, month(date) AS month, avg(y) AS v FROM panel GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY v DESC, month) AS hi, row_number() OVER (PARTITION BY product ORDER BY v, month) AS lo, count(*) OVER (PARTITION BY product) AS n FROM prof),
ag AS (SELECT product, max(n) AS n, max(v) AS mx, min(v) AS mn, avg(v) AS av, list_sort(list(month) FILTER (hi <= greatest(1, round_even(n * 0.33, 0)))) AS peaks, list_sort(list(month) FILTER (lo <= greatest(1, round_even(n * 0.33, 0)))) AS lows FROM rk GROUP BY 1),
hit AS (SELECT ag.*, span, len(list_intersect(peaks, [5, 6, 7, 8, 9])) AS s, len(list_intersect(peaks, [11, 12, 1, 2, 3])) AS w, span < 18 OR n < 6 OR mx <= 0 AS bare, CASE WHEN av > 0 THEN (mx - mn) / av ELSE 0 END < 0.35 AS flat FROM ag JOIN spn USING (product)),
det AS (SELECT product, CASE WHEN bare THEN 'undetected' WHEN flat THEN 'year_round' WHEN s > w AND s >= len(peaks) / 2 THEN 'summer_peak' WHEN w > s AND w >= len(peaks) / 2 THEN 'winter_peak' WHEN s = 0 AND w = 0 THEN 'shoulder_peak' ELSE 'irregular' END AS pattern_type,
  CASE WHEN bare OR flat THEN [] ELSE peaks END AS peak_list, CASE WHEN bare OR flat THEN [] ELSE lows END AS low_list, CASE WHEN bare THEN 'undetected' ELSE 'data_driven' END AS detection_source FROM hit)"""


@query(f"WITH {MPANEL}, {_SEASON} SELECT product, pattern_type, array_to_string(peak_list, ',') AS peak_months, array_to_string(low_list, ',') AS low_months, detection_source FROM det")
def seasonal_detection(spark, d):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return features.seasonal_detection(B.mixed_panel(spark, d)).select("product", "pattern_type", text("peak_months"), text("low_months"), "detection_source")


@query(f"""WITH {MPANEL}, {_SEASON} SELECT p.product, p.date, {r('y')}, list_contains(peak_list, month(date)) AS is_peak_season, list_contains(low_list, month(date)) AS is_low_season,
CAST(list_min(list_transform(peak_list, lambda k: (k - month(date) + 12) % 12)) AS INT) AS months_to_peak, pattern_type AS seasonal_pattern_type FROM panel p JOIN det USING (product)""")
def seasonal_features(spark, d):
    p = B.mixed_panel(spark, d)
    return features.seasonal_features(p, features.seasonal_detection(p)).withColumn("months_to_peak", F.col("months_to_peak").cast("int"))


_TEMP = "round(20 + 15 * sin(2 * pi() * (month(date) - 4) / 12), 6)"


def _weather(df: DataFrame) -> DataFrame:
    return df.withColumn("temperature", F.round(F.expr("20 + 15 * sin(2 * pi() * (month(date) - 4) / 12)"), 6))


@query(f"""WITH {PANEL}, t AS (SELECT DISTINCT date, {_TEMP} AS temperature FROM panel)
SELECT date, {r('temperature', digits=5)}, round(greatest(temperature - 18, 0.0), 5) + 0.0 AS cooling_degree_days, round(greatest(18 - temperature, 0.0), 5) + 0.0 AS heating_degree_days FROM t""", digits=5)
def degree_days(spark, d):
    return features.with_degree_days(_weather(B.brand_panel(spark, d).select("date").distinct()))


@query(f"""WITH {PANEL}, e AS (SELECT DISTINCT date, {_TEMP} AS temperature FROM panel WHERE month(date) % 4 = 0), j AS (SELECT p.*, temperature AS x FROM panel p LEFT JOIN e USING (date))
SELECT product, date, {r('y', digits=5)}, round(coalesce(x, lag(x, 1) OVER {_w}, lag(x, 2) OVER {_w}), 5) + 0.0 AS temperature FROM j""", digits=5)
def external_alignment(spark, d):
    p = B.brand_panel(spark, d)
    side = _weather(p.where(F.month("date") % 4 == 0).select("date").distinct())
    return features.align_external(p, side)[0]


@query("""WITH s AS (SELECT min(l_shipdate)::DATE AS a, max(l_shipdate)::DATE AS b FROM lineitem), f AS (SELECT CASE WHEN date_trunc('month', a) < a THEN date_trunc('month', a) + INTERVAL 1 MONTH ELSE date_trunc('month', a) END AS a, b FROM s)
SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS date FROM f""")
def calendar_grid(spark, d):
    """The periods that the line items span."""
    span = B.read_table(spark, d, "lineitem").agg(F.min("l_shipdate").cast("date").cast("string"), F.max("l_shipdate").cast("date").cast("string")).first()
    return external.period_grid(spark, span[0], span[1])


@query(f"""WITH {B.panel_sql(B.PART)}, m AS (SELECT DISTINCT product, unnest(range(1, 13)) AS month FROM panel), a AS (SELECT product, month(date) AS month, avg(y) AS v FROM panel GROUP BY 1, 2), w AS (SELECT product, avg(y) AS v FROM panel GROUP BY 1)
SELECT m.product, CAST(m.month AS INT) AS month, round(coalesce(a.v, w.v), 6) + 0.0 AS value FROM m LEFT JOIN a USING (product, month) JOIN w ON m.product = w.product""")
def climatology(spark, d):
    return features.climatology(P.panel(B.part_rows(spark, d)), "y")


@query(f"""WITH {PANEL}, x AS (SELECT y, sqrt(y) AS x0, lag(sqrt(y), 1) OVER {_w} AS x1, lag(sqrt(y), 2) OVER {_w} AS x2, lag(sqrt(y), 3) OVER {_w} AS x3 FROM panel), c AS ({' UNION ALL '.join(f'SELECT {k} AS lag, corr(x{k}, y) AS correlation, count(x{k}) AS n FROM x' for k in range(4))})
SELECT CAST(lag AS INT) AS lag, round(correlation, 6) AS correlation, n, CASE WHEN n < 8 OR correlation IS NULL THEN 'insufficient_history' WHEN abs(correlation) >= 0.5 THEN 'strong' WHEN abs(correlation) >= 0.25 THEN 'moderate' ELSE 'weak' END AS strength FROM c""")
def feature_relevance_lags(spark, d):
    return features.relevance(B.brand_panel(spark, d).withColumn("x", F.sqrt("y")), "x")


# --- segments and folds

_SEG = """per AS (SELECT product, count(*) AS n_points, sum(greatest(y, 0)) AS total_demand, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS zero_ratio FROM panel GROUP BY 1),
cum AS (SELECT *, sum(total_demand) OVER (ORDER BY total_demand DESC, product ROWS UNBOUNDED PRECEDING) - total_demand AS before, (SELECT sum(total_demand) FROM per) AS whole, (SELECT quantile_cont(total_demand, 0.2) FROM per) AS p20, (SELECT count(*) FROM per) AS np FROM per),
seg AS (SELECT product, n_points, total_demand, zero_ratio, CASE WHEN n_points < 12 THEN 'short_history' WHEN zero_ratio > 0.35 THEN 'intermittent' WHEN before < 0.5 * whole THEN 'high_volume' WHEN np >= 5 AND total_demand <= p20 THEN 'low_volume' ELSE 'normal' END AS segment FROM cum)"""


@query(f"WITH {MPANEL}, {_SEG} SELECT product, n_points, {r('total_demand', 'zero_ratio')}, segment FROM seg")
def product_segments(spark, d):
    return segments.product_segments(B.mixed_panel(spark, d))


_FOLD = """len AS (SELECT *, CASE WHEN n_points >= 17 THEN 14 ELSE greatest(4, n_points - 6) END AS tr FROM seg), spl AS (SELECT *, least(3, (n_points - tr) // 3) AS sp FROM len WHERE n_points >= tr + 3),
fol AS (SELECT product, n_points, segment, CAST(f AS INT) AS fold, CAST(tr + f * greatest(3, (n_points - tr - 3) // greatest(sp, 1)) AS INT) AS cut FROM (SELECT *, unnest(range(0, CAST(sp AS BIGINT))) AS f FROM spl WHERE sp >= 1) WHERE tr + f * greatest(3, (n_points - tr - 3) // greatest(sp, 1)) + 3 <= n_points)"""


@query(f"WITH {MPANEL}, {_SEG}, {_FOLD} SELECT product, n_points, fold, cut FROM fol")
def fold_cutoffs(spark, d):
    return segments.fold_cutoffs(segments.product_segments(B.mixed_panel(spark, d))).select("product", "n_points", "fold", "cut")


@query(f"""WITH {MPANEL}, n AS (SELECT DISTINCT count(*) AS n_points FROM panel GROUP BY product), t AS (SELECT *, CASE WHEN n_points >= 17 THEN 14 ELSE greatest(4, n_points - 6) END AS tr FROM n), s AS (SELECT *, least(4, (n_points - tr) // 3) AS sp FROM t WHERE n_points >= tr + 3)
SELECT n_points, CAST(f AS INT) AS fold, CAST(tr + f * greatest(3, (n_points - tr - 3) // sp) AS INT) AS cut FROM (SELECT *, unnest(range(0, CAST(sp AS BIGINT))) AS f FROM s WHERE sp >= 1) WHERE tr + f * greatest(3, (n_points - tr - 3) // sp) + 3 <= n_points""")
def fold_golden_values(spark, d):
    """The cuts of full mode for every length of history that there is."""
    lengths = B.mixed_panel(spark, d).groupBy("product").agg(F.count("*").alias("n_points")).select("n_points").distinct()
    return segments.fold_cutoffs(lengths, folds=FOLDS["full"])


_CAND = [(s, m, k) for s, models_ in {"short_history": ("naive", "moving_average"), "intermittent": ("naive", "seasonal_naive", "moving_average", "croston"), "low_volume": ("naive", "seasonal_naive", "moving_average"), "normal": segments.FAST, "high_volume": segments.FAST + segments.ADVANCED}.items() for k, m in enumerate(models_)]
_CAND_SQL = "cand(segment, model_name, cand_ord) AS (VALUES " + ", ".join(f"('{s}', '{m}', {k})" for s, m, k in _CAND) + ")"


@query(f"WITH {MPANEL}, {_SEG}, {_CAND_SQL} SELECT product, n_points, segment, model_name, CAST(cand_ord AS INT) AS cand_ord FROM seg JOIN cand USING (segment)")
def candidate_matrix(spark, d):
    """Which models each product is validated with."""
    return evaluate.asked_of(materialized(B.mixed_panel(spark, d)))


# --- models


def _model_sql(ys: str, step: str) -> dict[str, str]:
    """The closed forms over a list of demands."""
    n = f"len({ys})"
    where = f"list_filter(range(1, CAST({n} AS BIGINT) + 1), lambda i: {ys}[i] != 0)"
    gaps = f"list_transform(range(1, CAST(len({where}) AS BIGINT) + 1), lambda j: CAST({where}[j] - coalesce({where}[j - 1], 0) AS DOUBLE))"
    sizes = f"list_filter({ys}, lambda x: x != 0)"
    return {
        "naive": f"{ys}[-1]",
        "seasonal_naive": f"CASE WHEN {n} >= 12 THEN {ys}[{n} - 12 + ({step} - 1) % 12 + 1] ELSE {ys}[-1] END",
        "moving_average": f"list_avg({ys}[-3:])",
        "exponential_smoothing": f"list_reduce({ys}, lambda a, x: 0.3 * x + 0.7 * a)",
        "croston": f"CASE WHEN len({sizes}) = 0 THEN 0.0 ELSE list_reduce({sizes}, lambda a, x: 0.1 * x + 0.9 * a) / list_reduce({gaps}, lambda a, x: 0.1 * x + 0.9 * a) END",
    }


_SERIES = "ser AS (SELECT product, list(y ORDER BY date) AS ys, list(date ORDER BY date) AS ds, max(date) AS last FROM panel GROUP BY 1)"


def _forecast_sql(model: str, panel: str) -> str:
    return f"""WITH {panel}, {_SERIES}, st AS (SELECT *, unnest(range(1, 13)) AS s FROM ser)
SELECT product, CAST(last + to_months(CAST(s AS INT)) AS DATE) AS date, round(greatest({_model_sql('ys', 's')[model]}, 0.0), 6) + 0.0 AS forecast, CAST(s AS INT) AS horizon_step FROM st"""


for _model, _key in (("naive", "fc_naive"), ("seasonal_naive", "fc_seasonal_naive"), ("moving_average", "fc_moving_average"), ("exponential_smoothing", "fc_ses"), ("croston", "fc_croston")):
    QUERIES[_key] = lambda spark, d, m=_model: rounded(models.forecast(P.panel(B.part_rows(spark, d)) if m == "croston" else B.brand_panel(spark, d), m))
    ORACLE_SQL[_key] = _forecast_sql(_model, B.panel_sql(B.PART) if _model == "croston" else PANEL)


@query()
def fc_random_forest(spark, d):
    return models.tree_forecast(B.brand_panel(spark, d), "random_forest", horizon=MONTHLY.horizon)


@query()
def fc_gradient_boosting(spark, d):
    return models.tree_forecast(B.brand_panel(spark, d), "xgboost", horizon=MONTHLY.horizon)


@query()
def fc_sarima(spark, d):
    return models.statistical_forecast(B.brand_panel(spark, d), "sarima", horizon=MONTHLY.horizon)


@query()
def fc_additive(spark, d):
    return models.statistical_forecast(B.brand_panel(spark, d), "prophet", horizon=MONTHLY.horizon)


# --- validation and selection

_M = _model_sql("tr_ys", "step")
_VAL = f"""{_SEG}, {_FOLD}, {_SERIES}, {_CAND_SQL},
cutd AS (SELECT f.product, model_name, cand_ord, fold, step, ys[1:cut] AS tr_ys, ds[cut + step] AS date, ys[cut + step] AS actual FROM fol f JOIN ser USING (product) JOIN cand USING (segment), range(1, 4) t(step) WHERE model_name IN ('naive', 'seasonal_naive', 'moving_average', 'exponential_smoothing', 'croston')),
val AS (SELECT product, model_name, CAST(cand_ord AS INT) AS cand_ord, CAST(fold AS INT) AS fold, CAST(step AS INT) AS horizon_step, date, actual, greatest(CASE model_name {' '.join(f"WHEN '{m}' THEN {s}" for m, s in _M.items())} END, 0.0) AS validation_prediction FROM cutd)"""
_METRICS = """avg(abs(validation_prediction - actual)) AS mae, sqrt(avg((validation_prediction - actual) ** 2)) AS rmse, avg(CASE WHEN actual != 0 THEN abs(validation_prediction - actual) / abs(actual) END) AS mape,
CASE WHEN sum(abs(actual)) != 0 THEN sum(abs(validation_prediction - actual)) / sum(abs(actual)) END AS wmape, CASE WHEN sum(abs(actual)) != 0 THEN sum(validation_prediction - actual) / sum(abs(actual)) END AS forecast_bias, count(*) AS n_rows"""
_MET = f"met AS (SELECT product, model_name, cand_ord, {_METRICS}, count(DISTINCT fold) AS n_folds FROM val GROUP BY 1, 2, 3)"
_HYB = f"""top3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY round(wmape, 9), cand_ord) AS k FROM met WHERE wmape > 0) WHERE k <= 3), cnt AS (SELECT *, count(*) OVER (PARTITION BY product) AS nc, sum(1 / wmape) OVER (PARTITION BY product) AS inv FROM top3),
wgt AS (SELECT product, model_name, round((1 / wmape) / inv + 1e-9, 4) AS weight, nc AS n_components FROM cnt WHERE nc >= 2),
hyb AS (SELECT product, 'hybrid_ensemble' AS model_name, 99 AS cand_ord, fold, horizon_step, date, first(actual) AS actual, sum(weight * validation_prediction) AS validation_prediction FROM val JOIN wgt USING (product, model_name) GROUP BY product, fold, horizon_step, date HAVING count(*) = max(n_components)),
every AS (SELECT * FROM val UNION ALL BY NAME SELECT * FROM hyb),
emet AS (SELECT product, model_name, cand_ord, {_METRICS}, count(DISTINCT fold) AS n_folds FROM every GROUP BY 1, 2, 3),
sel AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY round(wmape, 9) NULLS LAST, round(abs(forecast_bias), 9) NULLS LAST, round(mae, 9) NULLS LAST, cand_ord) = 1 AND wmape IS NOT NULL AS selected FROM emet)"""
_ALL = f"WITH {MPANEL}, {_VAL}, {_MET}, {_HYB}"


@query(f"WITH {MPANEL}, {_VAL} SELECT product, model_name, cand_ord, fold, horizon_step, date, {r('actual', 'validation_prediction', digits=6)} FROM val", digits=6)
def validation_predictions(spark, d):
    return evaluate.validation_predictions(materialized(B.mixed_panel(spark, d)))


@query(f"WITH {MPANEL}, {_VAL}, {_MET} SELECT product, model_name, cand_ord, {r('mae', 'rmse')}, {r('mape', 'wmape', 'forecast_bias', digits=10)}, n_rows, n_folds FROM met", digits=10)
def metrics_by_product_model(spark, d):
    found = evaluate.product_metrics(evaluate.validation_predictions(materialized(B.mixed_panel(spark, d))))
    return found.withColumns({c: F.round(c, 6) for c in ("mae", "rmse")})


@query(f"{_ALL} SELECT product, model_name, weight, n_components FROM wgt", digits=6)
def hybrid_weights(spark, d):
    return evaluate.hybrid_weights(evaluate.product_metrics(evaluate.validation_predictions(materialized(B.mixed_panel(spark, d)))))


@query(f"{_ALL} SELECT product, model_name, CAST(cand_ord AS INT) AS cand_ord, CAST(fold AS INT) AS fold, CAST(horizon_step AS INT) AS horizon_step, date, {r('actual', 'validation_prediction', digits=6)} FROM hyb", digits=6)
def hybrid_validation(spark, d):
    rows = materialized(evaluate.validation_predictions(materialized(B.mixed_panel(spark, d))))
    return evaluate.hybrid_validation(rows, evaluate.hybrid_weights(evaluate.product_metrics(rows)))


@query(f"{_ALL} SELECT product, model_name, {r('wmape', digits=10)}, selected FROM sel", digits=10)
def best_model(spark, d):
    board = evaluate.board_of(_told_once(spark, d))[0]
    return board.where("scope = 'product' AND status = 'ok'").select("product", "model_name", "wmape", "selected")


@query(f"""{_ALL}, pool AS (SELECT model_name, cand_ord, {_METRICS}, count(DISTINCT product) AS n_products FROM every GROUP BY 1, 2)
SELECT model_name, {r('mae', 'rmse', 'mape', 'wmape', 'forecast_bias', digits=6)}, n_rows, n_products, row_number() OVER (ORDER BY round(wmape, 9) NULLS LAST, round(abs(forecast_bias), 9), round(mae, 9), cand_ord) = 1 AS selected FROM pool
UNION ALL SELECT 'lstm', NULL, NULL, NULL, NULL, NULL, NULL, NULL, FALSE""", digits=6)
def leaderboard_all(spark, d):
    board = evaluate.board_of(_told_once(spark, d))[0]
    return board.where("scope = 'ALL'").select("model_name", "mae", "rmse", "mape", "wmape", "forecast_bias", "n_rows", "n_products", "selected")


@query(f"""{_ALL}, ask AS (SELECT product, model_name FROM seg JOIN cand USING (segment)) SELECT product, model_name, CASE WHEN model_name IN ('sarima', 'prophet', 'random_forest', 'xgboost') THEN 'skipped' ELSE 'insufficient_history' END AS status FROM ask
WHERE NOT EXISTS (SELECT 1 FROM emet WHERE emet.product = ask.product AND emet.model_name = ask.model_name)""")
def leaderboard_unvalidated(spark, d):
    board = evaluate.board_of(_told_once(spark, d))[0]
    return board.where("scope = 'product' AND status != 'ok'").select("product", "model_name", "status")


# --- forecasts

_FC = f"""{_ALL}, best AS (SELECT product, model_name AS model_used, rmse FROM sel WHERE selected), parts AS (SELECT b.product, model_used, rmse, w.model_name, w.weight FROM best b JOIN wgt w USING (product) WHERE model_used = 'hybrid_ensemble' UNION ALL SELECT product, model_used, rmse, model_used, 1.0 FROM best WHERE model_used != 'hybrid_ensemble'),
used AS (SELECT s.product, ys, last, coalesce(model_used, 'naive') AS model_used, rmse, coalesce(model_name, 'naive') AS model_name, coalesce(weight, 1.0) AS weight FROM ser s LEFT JOIN parts USING (product)),
stp AS (SELECT used.*, ys AS tr_ys, step FROM used, range(1, 13) t(step)),
one AS (SELECT product, last, model_used, rmse, step, sum(weight * greatest(CASE model_name {' '.join(f"WHEN '{m}' THEN {s}" for m, s in _M.items())} END, 0.0)) AS forecast FROM stp GROUP BY 1, 2, 3, 4, 5),
fc AS (SELECT product, CAST(last + to_months(CAST(step AS INT)) AS DATE) AS date, forecast, CASE WHEN rmse IS NOT NULL THEN greatest(forecast - 1.28 * rmse, 0.0) END AS lower_bound, forecast + 1.28 * rmse AS upper_bound, model_used, CAST(step AS INT) AS horizon_step, CAST(last + INTERVAL 1 MONTH AS DATE) AS forecast_start_date FROM one)"""


def _told(spark, d) -> tuple[DataFrame, DataFrame]:
    """(series, what validation tells of them), a row for each product, each written once."""
    held = B.mixed_series(spark, d)
    return held, evaluate.judged(held, every=False)


def _told_once(spark, d) -> DataFrame:
    """What validation tells, without its rows, for queries that read it a single time: it is never written."""
    return evaluate.judged(B.mixed_series(spark, d), every=None, once=True)


def _board(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(series, leaderboard, validation rows of the selected models)."""
    held, told = _told(spark, d)
    return held, *evaluate.board_of(told)


def _forecasts(spark, d) -> DataFrame:
    return forecast.product_forecasts(None, None, used=forecast.used_of(_told_once(spark, d)))


@query(f"{_FC} SELECT product, date, {r('forecast', 'lower_bound', 'upper_bound', digits=6)}, model_used, horizon_step, forecast_start_date FROM fc", digits=6)
def product_forecasts(spark, d):
    return _forecasts(spark, d)


@query(f"""{_FC} SELECT date, round(sum(forecast), 6) + 0.0 AS total_forecast, round(coalesce(sum(lower_bound), 0), 6) + 0.0 AS total_lower, round(coalesce(sum(upper_bound), 0), 6) + 0.0 AS total_upper, count(lower_bound) AS n_bounded, CAST(row_number() OVER (ORDER BY date) AS INT) AS horizon_step FROM fc GROUP BY date""", digits=6)
def total_forecast(spark, d):
    return forecast.total_forecast(_forecasts(spark, d))


@query(f"""WITH {MPANEL}, tot AS (SELECT '__TOTAL__' AS product, date, sum(y) AS y FROM panel GROUP BY date) SELECT product, date, {r('y')} FROM tot""")
def direct_total_series(spark, d):
    return forecast.total_panel(B.mixed_panel(spark, d))


@query(f"""{_FC}, shown AS (SELECT e.product, e.date, e.validation_prediction AS v FROM every e JOIN best ON e.product = best.product AND e.model_name = best.model_used),
rws AS (SELECT product, date, 'history' AS kind, y AS value FROM panel UNION ALL SELECT product, date, 'validation', v FROM shown UNION ALL SELECT product, date, 'forecast', forecast FROM fc)
SELECT product, date, kind, {r('value', digits=6)} FROM (SELECT * FROM rws UNION ALL SELECT 'ALL', date, kind, sum(value) FROM rws WHERE kind != 'validation' GROUP BY date, kind)""", digits=6)
def chart_data_union(spark, d):
    held, told = _told(spark, d)
    board, rows = evaluate.board_of(told)
    return forecast.chart_data(P.rows_of(held), rows, board, forecast.product_forecasts(None, None, used=forecast.used_of(told)))


# --- performance and scenarios

_DIR = "CASE WHEN {0} > 0 THEN 'over' WHEN {0} < 0 THEN 'under' WHEN {0} = 0 THEN 'exact' END"
_NAIVE = "val2 AS (SELECT * FROM val WHERE model_name = 'naive')"


def _naive_rows(spark, d) -> DataFrame:
    return evaluate.validation_predictions(materialized(B.mixed_panel(spark, d))).where("model_name = 'naive'").drop("cand_ord")


@query(f"""WITH {MPANEL}, {_VAL}, {_NAIVE}, e AS (SELECT *, validation_prediction - actual AS error FROM val2) SELECT product, model_name, fold, horizon_step, date, {r('actual', digits=4)}, round(validation_prediction, 4) AS predicted, {r('error', digits=4)}, round(CASE WHEN actual != 0 THEN error / actual * 100 END, 4) + 0.0 AS error_pct, {_DIR.format('error')} AS direction FROM e""", digits=4)
def perf_per_period(spark, d):
    return analysis.performance_per_period(_naive_rows(spark, d))


@query(f"""WITH {MPANEL}, {_VAL}, {_NAIVE}, t AS (SELECT date, sum(actual) AS total_actual, sum(validation_prediction) AS total_predicted, count(DISTINCT product) AS n_products FROM val2 GROUP BY 1), e AS (SELECT *, total_predicted - total_actual AS error FROM t)
SELECT date, {r('total_actual', 'total_predicted', digits=4)}, n_products, {r('error', digits=4)}, round(CASE WHEN total_actual != 0 THEN error / total_actual * 100 END, 4) + 0.0 AS error_pct, {_DIR.format('error')} AS direction FROM e""", digits=4)
def perf_totals(spark, d):
    return analysis.performance_totals(_naive_rows(spark, d))


@query(f"""WITH {MPANEL}, {_VAL}, {_NAIVE} SELECT count(*) AS n_rows, count(DISTINCT product) AS n_products, count(DISTINCT date) AS n_periods, count(*) FILTER (validation_prediction > actual) AS n_over, count(*) FILTER (validation_prediction < actual) AS n_under, count(*) FILTER (validation_prediction = actual) AS n_exact FROM val2""")
def perf_summary(spark, d):
    return analysis.performance_summary(_naive_rows(spark, d))


_SN = f"""{PANEL}, {_SERIES}, st AS (SELECT ser.*, s FROM ser, range(1, 13) t(s)), bl AS (SELECT product, CAST(last + to_months(CAST(s AS INT)) AS DATE) AS date, greatest({_model_sql('ys', 's')['seasonal_naive']}, 0.0) AS forecast, s AS horizon_step FROM st),
lv AS (SELECT *, avg(forecast) OVER (PARTITION BY product) AS level FROM bl)"""
_SCEN = {"demand_change_pct": 10, "per_product_change_pct": {"Brand#11": -20}, "seasonal_strength_factor": 1.5, "peak_shift_periods": 2}
_SHIFT = f"""WITH {_SN}, sc AS (SELECT a.product, a.date, a.forecast AS base, greatest((1 + CASE WHEN a.product = 'Brand#11' THEN -20 ELSE 10 END / 100.0) * (a.level + 1.5 * (b.forecast - b.level)), 0.0) AS forecast, a.horizon_step
  FROM lv a JOIN lv b ON a.product = b.product AND b.horizon_step = (a.horizon_step - 1 - 2 + 12) % 12 + 1)"""


def _baseline(spark, d) -> DataFrame:
    return models.forecast(B.brand_panel(spark, d), "seasonal_naive")


def _scenario(spark, d, asked: dict) -> tuple[DataFrame, DataFrame]:
    base = _baseline(spark, d)
    return base, analysis.run_scenario(base, analysis.resolve(asked)[0])


@query(f"WITH {_SN} SELECT product, date, round(forecast, 4) + 0.0 AS forecast, CAST(horizon_step AS INT) AS horizon_step FROM bl", digits=4)
def scenario_identity(spark, d):
    return _scenario(spark, d, {})[1]


@query(f"WITH {_SN} SELECT product, date, round(forecast * 0.85, 4) + 0.0 AS forecast, CAST(horizon_step AS INT) AS horizon_step FROM bl", digits=4)
def scenario_demand_pct(spark, d):
    return _scenario(spark, d, {"demand_change_pct": -15})[1]


@query(f"{_SHIFT} SELECT product, date, round(forecast, 4) + 0.0 AS forecast, CAST(horizon_step AS INT) AS horizon_step FROM sc", digits=4)
def scenario_seasonal_shift(spark, d):
    return _scenario(spark, d, _SCEN)[1]


_CMP = f"{_SHIFT}, cmp AS (SELECT date, sum(base) AS baseline_total, sum(forecast) AS scenario_total FROM sc GROUP BY 1)"


@query(f"{_CMP} SELECT date, {r('baseline_total', 'scenario_total', digits=3)}, round(scenario_total - baseline_total, 3) + 0.0 AS delta, round((scenario_total - baseline_total) / baseline_total * 100, 3) + 0.0 AS delta_pct FROM cmp", digits=3)
def scenario_comparison(spark, d):
    return analysis.scenario_comparison(*_scenario(spark, d, _SCEN))


@query(f"""{_SHIFT}, pp AS (SELECT product, sum(base) AS baseline_total, sum(forecast) AS scenario_total, sum(forecast) - sum(base) AS delta FROM sc GROUP BY 1)
SELECT product, {r('baseline_total', 'scenario_total', 'delta', digits=3)}, round(delta / baseline_total * 100, 3) + 0.0 AS delta_pct FROM pp ORDER BY round(abs(pp.delta), 6) DESC, product LIMIT 5""", digits=3)
def scenario_impact_top5(spark, d):
    return analysis.most_affected(*_scenario(spark, d, _SCEN))


@query(f"""{_SHIFT} SELECT product, arg_max(date, (round(base, 6), -datediff('day', DATE '1970-01-01', date))) AS peak_baseline, arg_max(date, (round(forecast, 6), -datediff('day', DATE '1970-01-01', date))) AS peak_scenario FROM sc GROUP BY 1""")
def scenario_product_peaks(spark, d):
    base, new = (df.withColumn("forecast", F.round("forecast", 6)) for df in _scenario(spark, d, _SCEN))
    return analysis.product_peaks(base, new)


@query(f"""{_CMP} SELECT round(sum(baseline_total), 3) AS total_demand_baseline, round(sum(scenario_total), 3) AS total_demand_scenario, arg_max(date, (baseline_total, -datediff('day', DATE '1970-01-01', date))) AS peak_period_baseline, arg_max(date, (scenario_total, -datediff('day', DATE '1970-01-01', date))) AS peak_period_scenario,
round(sum(scenario_total) - sum(baseline_total), 3) AS total_demand_delta, round((sum(scenario_total) - sum(baseline_total)) / sum(baseline_total) * 100, 3) AS total_demand_delta_pct FROM cmp""", digits=3)
def scenario_impact_summary(spark, d):
    return analysis.impact_summary(analysis.scenario_comparison(*_scenario(spark, d, _SCEN)))


# --- findings


@query(f"""WITH {_SN}, f AS (SELECT product, avg(forecast) AS forecast_mean, sum(forecast) AS volume, count(*) AS n FROM bl GROUP BY 1), b AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY date DESC) AS k FROM panel), c AS (SELECT product, avg(y) AS recent_mean FROM b JOIN f USING (product) WHERE k <= n GROUP BY 1)
SELECT product, {r('forecast_mean', 'recent_mean', digits=3)}, round(CASE WHEN recent_mean > 0 THEN round_even((forecast_mean - recent_mean) / recent_mean, 4) END, 3) + 0.0 AS growth, {r('volume', digits=3)} FROM f LEFT JOIN c USING (product)""", digits=3)
def growth_vs_history(spark, d):
    return insights.growth_ranking(B.brand_panel(spark, d), _baseline(spark, d))


@query(f"""WITH {_SN}, v AS (SELECT product, sum(forecast) AS v FROM bl GROUP BY 1), t AS (SELECT sum(v) AS t FROM (SELECT v FROM v ORDER BY v.v DESC, product LIMIT 3)) SELECT count(*) AS n_products, round(max(t) / sum(v), 6) AS top_share, count(*) > 3 AND max(t) / sum(v) > 0.6 AS concentrated FROM v, t""")
def demand_concentration(spark, d):
    return insights.concentration(_baseline(spark, d))


@query(f"""{_ALL}, q AS (SELECT product, segment, wmape, forecast_bias FROM seg FULL JOIN (SELECT product, wmape, forecast_bias FROM sel WHERE selected) USING (product)),
s AS (SELECT *, CASE WHEN wmape > 0.35 THEN 2 WHEN wmape > 0.20 THEN 1 ELSE 0 END + CASE WHEN abs(forecast_bias) > 0.30 THEN 2 WHEN abs(forecast_bias) > 0.15 THEN 1 ELSE 0 END + CASE WHEN segment IN ('intermittent', 'short_history') THEN 1 ELSE 0 END AS score FROM q)
SELECT product, segment, {r('wmape', 'forecast_bias', digits=6)}, CAST(score AS INT) AS score, CASE WHEN score >= 3 THEN 'high' WHEN score >= 1 THEN 'medium' ELSE 'low' END AS level FROM s""", digits=6)
def risk_scores(spark, d):
    told = _told(spark, d)[1]
    return insights.risk_scores(evaluate.board_of(told)[0], told.select("product", "segment")).drop("drivers", "volume")


@query(f"""WITH {_SN}, n AS (SELECT count(DISTINCT date) AS periods, sum(forecast) AS forecast_total FROM bl), t AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY date DESC) AS k FROM panel),
c AS (SELECT product, avg(y) * max(periods) AS m FROM t, n WHERE k <= periods GROUP BY 1), g AS (SELECT forecast_total, recent_total, CASE WHEN recent_total > 0 THEN (forecast_total - recent_total) / recent_total END AS change FROM n, (SELECT sum(m) AS recent_total FROM c))
SELECT {r('forecast_total', 'recent_total', 'change', digits=3)}, CASE WHEN change > 0.05 THEN 'up' WHEN change < -0.05 THEN 'down' WHEN change IS NOT NULL THEN 'stable' END AS direction FROM g""", digits=3)
def direction_total(spark, d):
    return insights.total_direction(B.brand_panel(spark, d), _baseline(spark, d))


# --- the whole run, and the stream


@query()
def pipeline_end_to_end(spark, d):
    """The whole run in balanced mode: closed forms, trees and the statistical models, three folds."""
    done = pipeline.run_pipeline(B.mixed_rows(spark, d).select("product", "date", "qty", "price"), RunConfig(auto_approve_quality=True))
    if done.status != "ok":
        raise RuntimeError("; ".join(done.errors))
    return done.results["forecasts"]

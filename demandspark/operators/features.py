"""Seasonality, external alignment, model matrices, relevance and the leakage audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import degree_days, duration_months, months_to_peak, pattern_code
from ..types import MONTHLY, Granularity
from .panel import bounded_ffill, calendar_features, temporal_features

#: Fixed values.
SUMMER, WINTER = (5, 6, 7, 8, 9), (11, 12, 1, 2, 3)
SECTOR_DEFAULTS = {"hvac": ("summer_peak", (5, 6, 7, 8, 9), (11, 12, 1, 2))}
LEAKAGE = ("revenue", "profit", "margin", "turnover", "grosssales", "netsales", "income", "earnings", "إيراد", "ربح", "هامش", "عائد", "أرباح")
#: What can be known ahead, by meaning; the rest of the uploaded and side columns need future values.
FUTURE = {"temperature": "requires_future_values", "holiday": "safe_for_future", "price": "scenario_only", "promotion": "scenario_only", "discount": "scenario_only"}
FUTURE_DEFAULT = "requires_future_values"


def seasonal_profile(panel: DataFrame, **more: Column) -> DataFrame:
    """(product, month, mean_y), with further aggregates of a product's calendar month."""
    return panel.groupBy("product", F.month("date").alias("month")).agg(F.avg("y").alias("mean_y"), *(c.alias(n) for n, c in more.items()))


def seasonal_detection(panel: DataFrame, sector: str | None = None, least_span: int = 18) -> DataFrame:
    """(product, pattern_type, peak_months, low_months, detection_source).

    Peaks: the third of the calendar months with the largest mean demand (ties: the earlier month); lows likewise. A relative range
    below 0.35 is year_round. Under 18 months of history the sector's default counts, if there is one."""
    prof = seasonal_profile(panel, first=F.min("date"), last=F.max("date")).where("product IS NOT NULL")
    down, up = Window.partitionBy("product").orderBy(F.desc("mean_y"), "month"), Window.partitionBy("product").orderBy("mean_y", "month")
    whole = Window.partitionBy("product")
    ranked = prof.withColumns({"hi": F.row_number().over(down), "lo": F.row_number().over(up), "n": F.count("*").over(whole)})
    k = F.greatest(F.lit(1), F.bround(F.col("n") * 0.33).cast("int"))
    per = ranked.groupBy("product").agg(
        F.max("n").alias("n"), F.max("mean_y").alias("mx"), F.min("mean_y").alias("mn"), F.avg("mean_y").alias("av"),
        F.sort_array(F.collect_list(F.when(F.col("hi") <= k, F.col("month")))).alias("peaks"), F.sort_array(F.collect_list(F.when(F.col("lo") <= k, F.col("month")))).alias("lows"),
        (duration_months(F.min("first"), F.max("last")) + 1).alias("span"),
    )
    hits = lambda months: F.size(F.array_intersect("peaks", F.array(*map(F.lit, months))))
    s, w, n = hits(SUMMER), hits(WINTER), F.size("peaks")
    shape = F.when((s > w) & (s >= n / 2), "summer_peak").when((w > s) & (w >= n / 2), "winter_peak").when((s == 0) & (w == 0), "shoulder_peak").otherwise("irregular")
    short, bare = F.col("span") < least_span, (F.col("n") < 6) | (F.col("mx") <= 0)
    flat = F.when(F.col("av") > 0, (F.col("mx") - F.col("mn")) / F.col("av")).otherwise(0) < 0.35
    none = F.array().cast("array<int>")
    default = SECTOR_DEFAULTS.get((sector or "").lower())
    told = (lambda i, blank: F.lit(default[0]) if i == 0 and default else F.array(*map(F.lit, default[i])).cast("array<int>") if default else blank)
    return per.select(
        "product",
        F.when(short, told(0, F.lit("undetected"))).when(bare, "undetected").when(flat, "year_round").otherwise(shape).alias("pattern_type"),
        F.when(short, told(1, none)).when(bare | flat, none).otherwise(F.col("peaks")).alias("peak_months"),
        F.when(short, told(2, none)).when(bare | flat, none).otherwise(F.col("lows")).alias("low_months"),
        F.when(short, F.lit("sector_default" if default else "undetected")).when(bare, "undetected").otherwise("data_driven").alias("detection_source"),
    )


def seasonal_features(panel: DataFrame, detected: DataFrame) -> DataFrame:
    # the way to the peak is found for twelve months of a product, not for each of its periods
    ways = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: months_to_peak(m, F.col("peak_months")))
    met = panel.join(detected.withColumn("_ways", ways), "product", "left")
    m = F.month("date")
    return met.select(
        *panel.columns,
        F.coalesce(F.array_contains("peak_months", m), F.lit(False)).alias("is_peak_season"),
        F.coalesce(F.array_contains("low_months", m), F.lit(False)).alias("is_low_season"),
        F.get("_ways", m - 1).alias("months_to_peak"),
        F.coalesce("pattern_type", F.lit("undetected")).alias("seasonal_pattern_type"),
    )


def align_external(panel: DataFrame, external: DataFrame, limit: int = 2) -> tuple[DataFrame, list[str]]:
    """(panel with the external columns by date, or by product and date if it has products; notes). Existing columns are kept, gaps of up to two periods
    carried over, columns without any value dropped."""
    keys = ["product", "date"] if "product" in external.columns else ["date"]
    notes = [f"{c}: already in the panel" for c in external.columns if c in panel.columns and c not in keys]
    new = [c for c in external.columns if c not in panel.columns]
    side = external.select(*keys, *new)
    out = panel.join(side, keys, "left")
    for c in new:
        out = bounded_ffill(out, c, limit)
    seen = out.agg(*(F.count(c).alias(c) for c in new)).first() if new else {}
    empty = [c for c in new if not seen[c]]
    return out.drop(*empty).select(*panel.columns, *(c for c in new if c not in empty)), notes + [f"{c}: no value in the panel's range" for c in empty]


def with_degree_days(df: DataFrame, column: str = "temperature") -> DataFrame:
    cool, heat = degree_days(F.col(column))
    return df.withColumns({"cooling_degree_days": cool, "heating_degree_days": heat})


def climatology(panel: DataFrame, column: str) -> DataFrame:
    """(product, month, value): the month's mean, where there is none the product's overall mean."""
    months = panel.select("product").distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    per = panel.groupBy("product", F.month("date").alias("month")).agg(F.avg(column).alias("_m"))
    whole = panel.groupBy("product").agg(F.avg(column).alias("_all"))
    return months.join(per, ["product", "month"], "left").join(whole, "product").select("product", "month", F.coalesce("_m", "_all").alias("value"))


def _corr(x: str) -> Column:
    """Pearson's correlation of a column with y over the rows that have both; NULL without variance."""
    y = F.when(F.col(x).isNotNull(), F.col("y"))
    return F.try_divide(F.covar_pop(x, "y"), F.stddev_pop(x) * F.stddev_pop(y))


def relevance(panel: DataFrame, column: str) -> DataFrame:
    """(lag, correlation, n) of a feature, 0 to 3 periods earlier, with demand over all products, in one pass."""
    w = Window.partitionBy("product").orderBy("date")
    rows = panel.select("y", *(F.lag(column, k).over(w).alias(f"x{k}") for k in range(4)))
    wide = rows.agg(*(_corr(f"x{k}").alias(f"c{k}") for k in range(4)), *(F.count(f"x{k}").alias(f"n{k}") for k in range(4)))
    out = wide.select(F.expr("stack(4, 0, c0, n0, 1, c1, n1, 2, c2, n2, 3, c3, n3) AS (lag, correlation, n)"))
    strength = F.when((F.col("n") < 8) | F.col("correlation").isNull(), "insufficient_history").when(F.abs("correlation") >= 0.5, "strong").when(F.abs("correlation") >= 0.25, "moderate").otherwise("weak")
    return out.withColumn("strength", strength)


def ranked_relevance(panel: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, correlation_now, best_lag, best_lag_correlation, coverage, n_obs, verdict), strongest first: verdict, then size of the best
    correlation, then name. A feature with fewer than eight values, or without variance, is insufficient_history. One pass for all features."""
    if not columns:
        return panel.sparkSession.createDataFrame([], "feature string, correlation_now double, best_lag int, best_lag_correlation double, coverage double, n_obs long, verdict string")
    w = Window.partitionBy("product").orderBy("date")
    rows = panel.select("y", *(F.lag(F.col(f"`{c}`").try_cast("double"), k).over(w).alias(f"x{i}_{k}") for i, c in enumerate(columns) for k in range(4)))
    figures = [F.count("*").alias("n"), F.stddev_samp("y").alias("sy")]
    for i in range(len(columns)):
        figures += [F.count(f"x{i}_0").alias(f"n{i}"), F.stddev_samp(f"x{i}_0").alias(f"s{i}"), *(_corr(f"x{i}_{k}").alias(f"c{i}_{k}") for k in range(4))]
    wide = rows.agg(*figures)
    one = lambda i, c: F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n_obs"), F.col(f"s{i}").alias("s"), F.array(*(F.col(f"c{i}_{k}") for k in range(4))).alias("c"))
    each = wide.select("n", "sy", F.explode(F.array(*(one(i, c) for i, c in enumerate(columns)))).alias("f")).select("n", "sy", "f.*")
    # the earliest lag of the largest absolute correlation
    best = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.struct(F.lit(0.0).alias("r"), F.lit(0).alias("k")), lambda a, k: F.when(F.abs(F.get("c", k)) > F.abs(a["r"]), F.struct(F.get("c", k).alias("r"), k.alias("k"))).otherwise(a))
    each = each.withColumn("b", best)
    bare = (F.col("n_obs") < 8) | (F.coalesce("sy", F.lit(0.0)) == 0) | (F.coalesce("s", F.lit(0.0)) == 0)
    size = F.abs("b.r")
    verdict = F.when(bare, "insufficient_history").when(size >= 0.5, "strong").when(size >= 0.25, "moderate").otherwise("weak")
    shown = lambda c: F.when(~bare, c)
    out = each.select("feature", shown(F.round(F.coalesce(F.get("c", F.lit(0)), F.lit(0.0)), 3)).alias("correlation_now"), shown(F.col("b.k")).alias("best_lag"), shown(F.round("b.r", 3)).alias("best_lag_correlation"), F.round(F.col("n_obs") / F.col("n"), 3).alias("coverage"), "n_obs", verdict.alias("verdict"))
    rank = F.when(F.col("verdict") == "strong", 0).when(F.col("verdict") == "moderate", 1).when(F.col("verdict") == "weak", 2).otherwise(3)
    return out.orderBy(rank, F.desc(F.abs(F.coalesce("best_lag_correlation", F.lit(0.0)))), "feature")


def build_features(panel: DataFrame, g: Granularity = MONTHLY, sector: str | None = None, detected: DataFrame | None = None) -> DataFrame:
    """The whole feature panel: calendar, lags, rolling values, growth and seasonality (found in the panel unless it is given)."""
    base = panel.select("product", "date", "y", *(c for c in panel.columns if c not in ("product", "date", "y")))
    full = temporal_features(calendar_features(base, g.name == "weekly"), g)
    return seasonal_features(full, seasonal_detection(panel, sector) if detected is None else detected)


def numeric_features(panel: DataFrame, g: Granularity = MONTHLY, detected: DataFrame | None = None) -> DataFrame:
    """build_features as numbers, for tree models."""
    return as_numbers(build_features(panel, g, detected=detected))


def as_numbers(f: DataFrame) -> DataFrame:
    """The seasonal features as numbers."""
    return f.withColumns({"seasonal_pattern_type": pattern_code(F.col("seasonal_pattern_type")), "is_peak_season": F.col("is_peak_season").cast("int"), "is_low_season": F.col("is_low_season").cast("int")})


def matrices(features: DataFrame) -> dict[str, DataFrame]:
    """The projections that the model families take."""
    extra = [c for c in features.columns if c not in ("product", "date", "y")]
    return {
        "baseline": features.select("product", "date", "y"),
        "sarima": features.select("product", "date", "y"),
        "prophet": features.select("product", F.col("date").alias("ds"), "y", *(c for c in ("is_peak_season", "is_low_season") if c in extra)),
        "xgboost": features.select("product", "date", "y", *extra),
        "random_forest": features.select("product", "date", "y", *extra),
    }


def leakage_audit(features: DataFrame, g: Granularity = MONTHLY, metadata: list[dict] = (), excluded: list[str] = ()) -> list[dict]:
    """Checks of a feature panel, its rows included: lags and rolling values are computed anew, per product and from earlier rows only, and
    compared; no raw date, demand or post-sale column is among the tree features; every feature says what of it can be known ahead."""
    from ..functions.names import matches

    w = Window.partitionBy("product").orderBy("date")
    lags = {f"lag_{k}": F.lag("y", k).over(w) for k in g.lags if f"lag_{k}" in features.columns}
    rolling = {f"rolling_mean_{n}": F.avg("y").over(w.rowsBetween(-n, -1)) for n in g.windows if f"rolling_mean_{n}" in features.columns}
    checked = features.select(*(F.col(c).alias(f"a_{c}") for c in (lags | rolling)), *(x.alias(f"b_{c}") for c, x in (lags | rolling).items()))
    differs = lambda c: F.col(f"a_{c}").isNotNull() & ~F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= 1e-6 * (1 + F.abs(f"b_{c}")), F.lit(False))
    lost = lambda c: F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNotNull()
    found = checked.agg(F.count("*").alias("_n"), *(F.count_if(differs(c) | (lost(c) if c in lags else F.lit(False))).alias(c) for c in lags | rolling)).first().asDict()
    wrong = lambda names: [f"{c}: {found[c]} rows" for c in names if found[c]]
    tree = [c for c in features.columns if c not in ("product", "date", "y")]
    told = {m["feature_name"] for m in metadata if m.get("future_availability")}
    leaks, targets = [c for c in tree if any(matches(c, k) for k in LEAKAGE)], [c for c in tree if c.lower() in ("y", "qty", "quantity", "demand")]
    raw = [f.name for f in features.schema.fields if f.name in tree and f.dataType.typeName().startswith(("date", "timestamp"))]
    open_ = [c for c in tree if c not in told] if metadata else []
    skew = [m["feature_name"] for m in metadata if m["future_availability"] in ("requires_future_values", "historical_context")]
    check = lambda name, bad, detail="": {"check": name, "passed": not bad, "detail": ", ".join(bad) or detail}
    return [
        check("rolling_excludes_current", wrong(rolling)),
        check("lags_computed_per_product", wrong(lags)),
        check("no_raw_date_in_tree_features", raw),
        check("post_sale_metrics_excluded", leaks, "excluded: " + ", ".join(excluded) if excluded else ""),
        check("no_target_in_features", targets),
        check("future_availability_classified", open_),
        check("future_value_features_flagged", [], ", ".join(skew)),
    ]


CALENDAR = {"month": "temporal", "quarter": "temporal", "year": "temporal", "weekofyear": "temporal", "month_sin": "cyclical", "month_cos": "cyclical", "week_sin": "cyclical", "week_cos": "cyclical", "time_index": "trend"}
SEASONAL = ("is_peak_season", "is_low_season", "months_to_peak", "seasonal_pattern_type")
TREES = ["xgboost", "random_forest"]


def _source(column: str) -> str:
    for start, source in (("lag_", "lag"), ("rolling_mean_", "rolling"), ("rolling_std_", "volatility"), ("pop_growth", "growth")):
        if column.startswith(start):
            return source
    return CALENDAR.get(column) or ("seasonal_detected" if column in SEASONAL else "degree_days" if column.endswith("_degree_days") else "external")


def feature_metadata(columns: list[str], client: dict[str, str] | None = None, external: dict[str, str] | None = None) -> list[dict]:
    """feature_name, source, leakage_safe, future_availability and models of each feature. client: uploaded column -> its meaning; external:
    side column -> its future availability, which overrides the default (future values are needed)."""
    out = []
    for c in columns:
        mine = c in (client or {}) or c in (external or {})
        source = "external" if mine else _source(c)
        if c in (external or {}):
            future = external[c]
        elif source in ("degree_days", "external"):
            future = FUTURE.get((client or {}).get(c), FUTURE_DEFAULT)
        else:
            future = "safe_for_future"
        out.append({"feature_name": c, "source": source, "leakage_safe": True, "future_availability": future, "models": TREES + (["prophet"] if c in ("is_peak_season", "is_low_season") else [])})
    return out


def partition_future(metadata: list[dict]) -> tuple[list[str], list[str], list[str]]:
    """(features to train on, those of them to be filled by climatology later, excluded): scenario-only and historical context can't be known ahead."""
    shut = [m["feature_name"] for m in metadata if m["future_availability"] in ("scenario_only", "historical_context")]
    keep = [m["feature_name"] for m in metadata if m["feature_name"] not in shut]
    return keep, [m["feature_name"] for m in metadata if m["future_availability"] == "requires_future_values"], shut

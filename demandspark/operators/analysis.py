"""Measured forecast performance and what-if scenarios."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import direction, error_pct
from ..functions.wording import say

DISCLAIMER = "Scenario figures follow from the stated assumptions; they are not a prediction of the model."


def _errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    return df.withColumns({"error": e, "error_pct": error_pct(e, F.col(actual)), "direction": direction(e)})


def performance_per_period(validation: DataFrame) -> DataFrame:
    """Validation rows with error, error_pct (NULL where nothing was sold) and direction."""
    return _errors(validation.withColumnRenamed("validation_prediction", "predicted"), "actual", "predicted")


def performance_totals(validation: DataFrame) -> DataFrame:
    """Per date: total actual and prediction, products, and the same error columns."""
    per = validation.groupBy("date").agg(F.sum("actual").alias("total_actual"), F.sum("validation_prediction").alias("total_predicted"), F.countDistinct("product").alias("n_products"))
    return _errors(per, "total_actual", "total_predicted")


def performance_summary(validation: DataFrame) -> DataFrame:
    """One row: rows, products, periods, and how many were over, under and exact."""
    d = direction(F.col("validation_prediction") - F.col("actual"))
    return validation.agg(F.count("*").alias("n_rows"), F.countDistinct("product").alias("n_products"), F.countDistinct("date").alias("n_periods"), *(F.count_if(d == k).alias(f"n_{k}") for k in ("over", "under", "exact")))


#: The columns of results that are empty.
PER_PERIOD = "product string, date date, fold int, horizon_step int, model_name string, actual double, predicted double, error double, error_pct double, direction string"
TOTALS = "date date, total_actual double, total_predicted double, n_products long, error double, error_pct double, direction string"
FORECASTS = "product string, date date, forecast double, lower_bound double, upper_bound double, model_used string, horizon_step int, forecast_start_date date"
COMPARISON = "date date, baseline_total double, scenario_total double, delta double, delta_pct double"
ECHOED = ("portfolio_wmape", "bias_direction", "confidence_label")


def performance(spark: SparkSession, validation: DataFrame | None, summary: dict | None = None, cards: list[dict] | None = None) -> dict:
    """Measured performance as a whole: per_period (by product, date and fold), totals (by date), summary and warnings.

    summary counts the rows and repeats what the model has told (its portfolio figures and metric cards, as copies), computing none of it again.
    Without validation rows the frames are empty, with their columns, and a warning says so."""
    empty = validation is None or validation.isEmpty()
    rows = spark.createDataFrame([], PER_PERIOD) if empty else performance_per_period(validation).select(*(c.split()[0] for c in PER_PERIOD.split(", ")))
    totals = spark.createDataFrame([], TOTALS) if empty else performance_totals(validation)
    counts = dict.fromkeys(("n_rows", "n_products", "n_periods", "n_over", "n_under", "n_exact"), 0) if empty else performance_summary(validation).first().asDict()
    told = {k: (summary or {}).get(k) for k in ECHOED} | {"metric_cards": [dict(c) for c in cards or []]}
    warnings = [say("no_validation") | {"level": "warning"}] if empty else []
    return {"analysis_type": "measured", "per_period": rows.orderBy("product", "date", "fold", "horizon_step"), "totals": totals.orderBy("date"), "summary": told | counts, "warnings": warnings}


@dataclass
class Scenario:
    name: str = "scenario"
    demand_change_pct: float = 0.0
    per_product_change_pct: dict[str, float] = field(default_factory=dict)
    seasonal_strength_factor: float = 1.0
    peak_shift_periods: int = 0


def resolve(asked: dict | None, products: set[str] | None = None) -> tuple[Scenario, list[str]]:
    """(scenario, warnings): values that aren't numbers, negative factors, unknown keys and products are replaced by neutral ones, with a warning."""
    asked, notes, out = dict(asked or {}), [DISCLAIMER], Scenario()

    def number(key: str, value, default: float) -> float:
        try:
            return float(value)
        except (TypeError, ValueError):
            notes.append(f"{key}: not a number, left out")
            return default

    for key, value in asked.items():
        if key == "name":
            out.name = str(value)
        elif key == "demand_change_pct":
            out.demand_change_pct = number(key, value, 0.0)
        elif key == "per_product_change_pct":
            for p, v in dict(value or {}).items():
                if products is not None and p not in products:
                    notes.append(f"{p}: not among the products, left out")
                else:
                    out.per_product_change_pct[p] = number(p, v, out.demand_change_pct)
        elif key == "seasonal_strength_factor":
            f = number(key, value, 1.0)
            if f < 0:
                notes.append(f"{key}: negative, taken as 1")
            out.seasonal_strength_factor = f if f >= 0 else 1.0
        elif key == "peak_shift_periods":
            out.peak_shift_periods = int(number(key, value, 0))
        else:
            notes.append(f"{key}: unknown, left out")
    return out, notes


def known_products(forecasts: DataFrame, asked: dict | None) -> set[str]:
    """Which of the products that a scenario names exist: a semi join, of the scenario's size."""
    names = [(str(p),) for p in (asked or {}).get("per_product_change_pct") or {}]
    if not names:
        return set()
    named = forecasts.sparkSession.createDataFrame(names, "product string").distinct()
    return {r["product"] for r in named.join(forecasts.select("product"), "product", "left_semi").collect()}


def run_scenario(forecasts: DataFrame, s: Scenario) -> DataFrame:
    """forecasts with `forecast` and bounds changed: deviations from the product's horizon mean are strengthened, shifted cyclically by
    peak_shift_periods, then all is multiplied by the percentage; bounds move in parallel. Nothing falls below 0."""
    per = Window.partitionBy("product")
    rows = forecasts.withColumn("_n", F.count("*").over(per)).withColumn("_level", F.avg("forecast").over(per)).withColumn("_ord", F.row_number().over(per.orderBy("horizon_step")) - 1)
    deviation = s.seasonal_strength_factor * (F.col("forecast") - F.col("_level"))
    if s.peak_shift_periods:
        all_ = F.collect_list(F.struct("_ord", deviation.alias("d"))).over(per)
        moved = F.element_at(F.array_sort(all_)["d"], (F.pmod(F.col("_ord") - s.peak_shift_periods, F.col("_n")) + 1).cast("int"))
    else:
        moved = deviation
    pct = F.lit(float(s.demand_change_pct))
    if s.per_product_change_pct:  # however many products are named, the plan stays as it is
        named = forecasts.sparkSession.createDataFrame([(str(p), float(v)) for p, v in s.per_product_change_pct.items()], "product string, _pct double")
        rows, pct = rows.join(named, "product", "left"), F.coalesce("_pct", pct)
    rows = rows.withColumn("_new", F.greatest((1 + pct / 100) * (F.col("_level") + moved), F.lit(0.0)))
    delta = F.col("_new") - F.col("forecast")
    bounds = {}
    if "lower_bound" in forecasts.columns:
        low = F.col("lower_bound") + delta
        bounds = {"lower_bound": F.when(low.isNotNull(), F.greatest(low, F.lit(0.0))), "upper_bound": F.col("upper_bound") + delta}
    return rows.withColumns(bounds).withColumn("forecast", F.col("_new")).select(*forecasts.columns)


def scenario_comparison(baseline: DataFrame, scenario: DataFrame) -> DataFrame:
    """Totals of both per date, their difference and its percentage."""
    b = baseline.groupBy("date").agg(F.sum("forecast").alias("baseline_total"))
    s = scenario.groupBy("date").agg(F.sum("forecast").alias("scenario_total"))
    out = b.join(s, "date", "full_outer").withColumn("delta", F.col("scenario_total") - F.col("baseline_total"))
    return out.withColumn("delta_pct", F.when(F.col("baseline_total") != 0, F.col("delta") / F.col("baseline_total") * 100))


def most_affected(baseline: DataFrame, scenario: DataFrame, k: int = 5) -> DataFrame:
    """The k products whose totals change most (ties by product)."""
    b = baseline.groupBy("product").agg(F.sum("forecast").alias("baseline_total"))
    s = scenario.groupBy("product").agg(F.sum("forecast").alias("scenario_total"))
    out = b.join(s, "product", "left").withColumn("delta", F.col("scenario_total") - F.col("baseline_total"))
    out = out.withColumn("delta_pct", F.when(F.col("baseline_total") != 0, F.col("delta") / F.col("baseline_total") * 100))
    return out.orderBy(F.desc(F.bround(F.abs("delta"), 6)), "product").limit(k)


def product_peaks(baseline: DataFrame, scenario: DataFrame) -> DataFrame:
    """(product, peak_baseline, peak_scenario): the period of each product's largest forecast in either, the earlier of equal ones."""
    peak = lambda df, name: df.groupBy("product").agg(F.max_by("date", F.struct("forecast", -F.datediff("date", F.lit("1970-01-01")))).alias(name))
    return peak(baseline, "peak_baseline").join(peak(scenario, "peak_scenario"), "product", "full_outer")


def simulate(spark: SparkSession, forecasts: DataFrame | None, asked: dict | None) -> dict:
    """A scenario as a whole: scenario, forecast, comparison, impact, most_affected, peaks and warnings, the disclaimer always among them.

    Without a forecast the frames are empty, with their columns, the impact has no figures, and a warning says so."""
    base = spark.createDataFrame([], FORECASTS) if forecasts is None else forecasts
    s, notes = resolve(asked, known_products(base, asked))
    new = run_scenario(base, s)
    if forecasts is None or forecasts.isEmpty():
        notes = [*notes, say("no_forecast")["text"]]
    comparison = scenario_comparison(base, new)
    return {"analysis_type": "assumed", "scenario": s, "warnings": notes, "forecast": new, "comparison": comparison, "impact": impact_summary(comparison), "most_affected": most_affected(base, new), "peaks": product_peaks(base, new)}


def impact_summary(comparison: DataFrame) -> DataFrame:
    """One row: totals, their difference (also in percent), and the first peak period of either."""
    peak = lambda c: F.max_by("date", F.struct(F.col(c), -F.datediff("date", F.lit("1970-01-01"))))
    out = comparison.agg(F.sum("baseline_total").alias("total_demand_baseline"), F.sum("scenario_total").alias("total_demand_scenario"), peak("baseline_total").alias("peak_period_baseline"), peak("scenario_total").alias("peak_period_scenario"))
    out = out.withColumn("total_demand_delta", F.col("total_demand_scenario") - F.col("total_demand_baseline"))
    return out.withColumn("total_demand_delta_pct", F.when(F.col("total_demand_baseline") != 0, F.col("total_demand_delta") / F.col("total_demand_baseline") * 100))

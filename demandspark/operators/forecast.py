"""Final forecasts with intervals, totals, chart rows and metric cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import band
from ..sources.tables import dropped, materialized, side_by_side
from ..types import BIAS_BANDS, ERROR_BANDS, MONTHLY, RELATIVE_BANDS, VALIDATION_HORIZON, Granularity
from . import evaluate
from .evaluate import HYBRID, INTERVAL_Z, hybrid_weights, product_metrics, selected, validation_predictions
from .models import CLOSED_FORM, histories, predicted, predicted_by, step_date


def used_models(board: DataFrame) -> DataFrame:
    """(product, model_used, rmse, model_name, weight): the selected model of each product, or the components of its hybrid."""
    mine = board.where("scope = 'product'")
    best = mine.where("selected").select("product", F.col("model_name").alias("model_used"), "rmse")
    weights = hybrid_weights(mine.where((F.col("status") == "ok") & (F.col("model_name") != HYBRID)))
    parts = best.where(F.col("model_used") == HYBRID).join(weights, "product").select("product", "model_used", "rmse", "model_name", "weight")
    single = best.where(F.col("model_used") != HYBRID).select("product", "model_used", "rmse", F.col("model_used").alias("model_name"), F.lit(1.0).alias("weight"))
    return parts.unionByName(single)


def advanced_forecasts(panel: DataFrame, used: DataFrame, forecasters: dict, horizon: int) -> tuple[DataFrame | None, list[str]]:
    """((product, model_name, horizon_step, forecast) of the models in use that aren't closed forms, warnings). A model that fails has no rows. The models
    are fitted side by side, on the rows of their products, which are written once."""
    fitted = used.where(~F.col("model_name").isin(*CLOSED_FORM)).select("product", "model_name")
    wanted = sorted(r["model_name"] for r in fitted.select("model_name").distinct().collect())
    if not wanted:
        return None, []
    few = materialized(panel.join(fitted.select("product").distinct(), "product", "left_semi"))

    def told(model: str) -> tuple[DataFrame | None, str]:
        try:
            mine = few.join(fitted.where(F.col("model_name") == model).select("product").distinct(), "product", "left_semi")
            rows = forecasters[model](mine, horizon).select("product", F.lit(model).alias("model_name"), F.col("horizon_step").cast("int").alias("horizon_step"), F.col("forecast").alias("_told"))
            return materialized(rows), ""
        except Exception as e:  # noqa: BLE001  its products fall back to naive
            return None, f"{model}: the final forecast failed ({type(e).__name__}: {str(e)[:150]}); naive is used"

    found = side_by_side(panel.sparkSession, [lambda m=m: told(m) for m in wanted])
    dropped(few)
    made = [rows for rows, _ in found if rows is not None]
    return (reduce(DataFrame.unionByName, made) if made else None), [note for _, note in found if note]


def used_parts(told: DataFrame) -> DataFrame:
    """(product, model_name, weight) as of used_models, of evaluate.judged(): no row is shuffled."""
    return told.select("product", F.inline("parts"))


def used_by(panel: DataFrame, board: DataFrame, g: Granularity, horizon: int) -> DataFrame:
    """(product, last_date, whole, model_used, rmse, parts): a row for each product, parts: array of (model_name, weight)."""
    parts = F.collect_list(F.struct("model_name", F.col("weight").cast("double").alias("weight"))).alias("parts")
    return histories(panel, g, horizon).withColumnRenamed("prefix", "whole").join(used_models(board).groupBy("product", "model_used", "rmse").agg(parts), "product", "left")


def used_of(told: DataFrame) -> DataFrame:
    """used_by, of evaluate.judged(): no row is shuffled."""
    return told.select("product", "last_date", "whole", F.col("best.model_name").alias("model_used"), F.col("best.rmse").alias("rmse"), "parts")


def product_forecasts(panel: DataFrame | None, board: DataFrame | None, g: Granularity = MONTHLY, horizon: int | None = None, others: DataFrame | None = None, used: DataFrame | None = None) -> DataFrame:
    """(product, date, forecast, lower_bound, upper_bound, model_used, horizon_step, forecast_start_date).

    The selected model, or the weighted sum of the hybrid's components, over the whole history; naive where none was validated, and for a
    product for which any part has no forecast (others: those of models that aren't closed forms, see advanced_forecasts). Bounds:
    1.28 validation RMSE to either side, from 0; NULL without validation. used: used_of(), in place of panel and board."""
    horizon = horizon or g.horizon
    rows = used_by(panel, board, g, horizon) if used is None else used
    plain = F.array(F.struct(F.lit("naive").alias("model_name"), F.lit(1.0).alias("weight")))
    rows = rows.withColumns({"model_used": F.coalesce("model_used", F.lit("naive")), "parts": F.coalesce("parts", plain)})
    if others is not None:
        rows = rows.join(others.groupBy("product").agg(F.collect_list(F.struct("model_name", "horizon_step", "_told")).alias("_others")), "product", "left")

    steps = F.sequence(F.lit(1), F.lit(horizon))

    def other(part, step):
        """A part's forecast that isn't a closed form's."""
        if others is None:
            return F.lit(None).cast("double")
        mine = F.get(F.filter("_others", lambda o: (o["model_name"] == part["model_name"]) & (o["horizon_step"] == step)), F.lit(0))["_told"]
        return F.when(mine.isNotNull() & ~F.isnan(mine), F.greatest(mine, F.lit(0.0)))

    def weighed(value):
        return F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + value(p))

    # all but the seasonal parts are level: they are added up once for a product. A part without a forecast makes the whole product naive
    level = [m for m in CLOSED_FORM if m != "seasonal_naive"]
    no_closed_form = lambda p: ~p["model_name"].isin(*CLOSED_FORM)
    rows = rows.withColumns({
        "_level": weighed(lambda p: F.when(p["model_name"].isin(*level), p["weight"] * predicted_by(p["model_name"], F.col("whole"), F.lit(1), g)).otherwise(0.0)),
        "_turn": weighed(lambda p: F.when(p["model_name"] == "seasonal_naive", p["weight"]).otherwise(0.0)),
        "_lost": F.exists("parts", lambda p: no_closed_form(p) & (F.lit(True) if others is None else F.exists(steps, lambda k: other(p, k).isNull()))),
    })
    rows = rows.withColumn("horizon_step", F.explode(steps))
    step = F.col("horizon_step")
    beyond = F.lit(0.0) if others is None else weighed(lambda p: F.when(no_closed_form(p), p["weight"] * other(p, step)).otherwise(0.0))
    summed = F.col("_level") + F.when(F.col("_turn") > 0, F.col("_turn") * predicted("seasonal_naive", F.col("whole"), step, g)).otherwise(0.0) + beyond
    rows = rows.withColumns({"forecast": F.when(F.col("_lost"), predicted("naive", F.col("whole"), step, g)).otherwise(summed), "model_used": F.when(F.col("_lost"), F.lit("naive")).otherwise(F.col("model_used"))})
    date = step_date(F.col("last_date"), F.col("horizon_step"), g)
    spread = INTERVAL_Z * F.col("rmse")
    lower = F.when(F.col("rmse").isNotNull() & F.col("forecast").isNotNull(), F.greatest(F.col("forecast") - spread, F.lit(0.0)))
    return rows.select("product", date.alias("date"), "forecast", lower.alias("lower_bound"), (F.col("forecast") + spread).alias("upper_bound"), "model_used", "horizon_step", step_date(F.col("last_date"), F.lit(1), g).alias("forecast_start_date"))


def total_forecast(forecasts: DataFrame) -> DataFrame:
    """Sums per date; missing bounds count as 0, n_bounded tells how many products have them."""
    out = forecasts.groupBy("date").agg(F.sum("forecast").alias("total_forecast"), F.coalesce(F.sum("lower_bound"), F.lit(0.0)).alias("total_lower"), F.coalesce(F.sum("upper_bound"), F.lit(0.0)).alias("total_upper"), F.count("lower_bound").alias("n_bounded"))
    return out.withColumn("horizon_step", F.row_number().over(Window.orderBy("date")))


def total_panel(panel: DataFrame) -> DataFrame:
    """The summed demand of all products as one series."""
    return panel.groupBy("date").agg(F.sum("y").alias("y")).select(F.lit("__TOTAL__").alias("product"), "date", "y")


def direct_total(panel: DataFrame, g: Granularity = MONTHLY, mode: str = "balanced", horizon: int | None = None) -> DataFrame:
    """(date, direct_total_forecast, lower_bound, upper_bound, model_used, horizon_step): the total series forecast by the best of the four
    fast closed forms, validated on it; no rows if it is shorter than a season, two periods and a validation window."""
    total = total_panel(panel)
    n = total.groupBy("product").agg(F.count("*").alias("n_points")).where(F.col("n_points") >= g.season + 2 + VALIDATION_HORIZON)
    rows = validation_predictions(total, g, mode, VALIDATION_HORIZON, n.withColumn("segment", F.lit("normal")))
    best = selected(product_metrics(rows)).where("selected").select("product", F.col("model_name").alias("model_used"), "rmse")
    horizon = horizon or g.horizon
    used = histories(total, g, horizon).join(n.select("product"), "product").join(best, "product", "left").fillna({"model_used": "naive"})
    steps = used.withColumn("horizon_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    value = predicted_by(F.col("model_used"), F.col("prefix"), F.col("horizon_step"), g)
    spread = INTERVAL_Z * F.col("rmse")
    lower = F.when(F.col("rmse").isNotNull(), F.greatest(F.col("f") - spread, F.lit(0.0)))
    return steps.withColumn("f", value).select(step_date(F.col("last_date"), F.col("horizon_step"), g).alias("date"), F.col("f").alias("direct_total_forecast"), lower.alias("lower_bound"), (F.col("f") + spread).alias("upper_bound"), "model_used", "horizon_step")


def chart_data(panel: DataFrame, validation: DataFrame, board: DataFrame, forecasts: DataFrame) -> DataFrame:
    """(product, date, kind, value): history, validation of the selected model and forecast, by product and for ALL."""
    shown = evaluate.of_selected(board, validation)
    parts = [panel.select("product", "date", F.lit("history").alias("kind"), F.col("y").alias("value")), shown.select("product", "date", F.lit("validation").alias("kind"), F.col("validation_prediction").alias("value")), forecasts.select("product", "date", F.lit("forecast").alias("kind"), F.col("forecast").alias("value"))]
    rows = reduce(DataFrame.unionByName, parts)
    whole = rows.where("kind != 'validation'").groupBy("date", "kind").agg(F.sum("value").alias("value"))
    return rows.unionByName(whole.select(F.lit("ALL").alias("product"), "date", "kind", "value"))


def mean_demand(panel: DataFrame) -> DataFrame:
    """One row: the mean over products of their mean demand a period."""
    return overall_mean(panel.groupBy("product").agg(F.avg("y").alias("mean")))


def overall_mean(held: DataFrame) -> DataFrame:
    """mean_demand, of the `mean` of each product."""
    return held.agg(F.coalesce(F.avg("mean"), F.lit(0.0)).alias("mean_demand"))


def overlay(panel: DataFrame, total: DataFrame) -> DataFrame:
    """(date, actual, forecast): all products' demand and their total forecast side by side; either is NULL where the other stands alone."""
    actual = panel.groupBy("date").agg(F.sum("y").alias("actual"))
    return actual.join(total.select("date", F.col("total_forecast").alias("forecast")), "date", "full_outer")


def metric_cards(board: DataFrame | None, rows: DataFrame | None, panel: DataFrame | None, means: DataFrame | None = None, portfolio: DataFrame | None = None) -> DataFrame:
    """(metric, value, label, direction): five cards over the validation rows of the selected models. MAE and RMSE are labelled by their share of
    mean demand; an undefined value is poor, of these two needs_attention. direction is the bias's, beyond 5 %. means: (product, mean), in place of the panel.
    portfolio: evaluate.portfolio_of(), in place of board and rows."""
    one = (evaluate.portfolio_metrics(board, rows) if portfolio is None else portfolio).crossJoin(mean_demand(panel) if means is None else overall_mean(means))  # one row each
    cards = one.select("mean_demand", F.expr("stack(5, 'wMAPE', wmape, 'Forecast Bias', forecast_bias, 'MAPE', mape, 'MAE', mae, 'RMSE', rmse) AS (metric, value)"))
    relative = F.when(F.col("mean_demand") > 0, F.col("value") / F.col("mean_demand"))
    label = F.when(F.col("metric").isin("wMAPE", "MAPE"), band(F.col("value"), ERROR_BANDS, "poor")).when(F.col("metric") == "Forecast Bias", band(F.abs("value"), BIAS_BANDS, "poor")).otherwise(band(relative, RELATIVE_BANDS, "needs_attention"))
    way = F.when(F.col("value") > 0.05, "over-forecasting").when(F.col("value") < -0.05, "under-forecasting").otherwise("balanced")
    return cards.select("metric", "value", label.alias("label"), F.when(F.col("metric") == "Forecast Bias", way).alias("direction"))


def forecast_summary(board: DataFrame, rows: DataFrame | None, forecasts: DataFrame, total: DataFrame, portfolio: DataFrame | None = None) -> DataFrame:
    """One row: portfolio wMAPE and bias, their label and direction, the whole expected demand, its first peak period, steps, products
    forecast and validated, and the best pooled model. portfolio: evaluate.portfolio_of(), in place of rows."""
    bias = F.col("forecast_bias")
    way = F.when(bias > 0.05, "over-forecasting").when(bias < -0.05, "under-forecasting").otherwise("balanced")
    own = (evaluate.portfolio_metrics(board, rows) if portfolio is None else portfolio).select(F.round("wmape", 4).alias("portfolio_wmape"), "forecast_bias", way.alias("bias_direction"), band(F.col("wmape"), ERROR_BANDS, "poor").alias("confidence_label"), F.col("n_products").alias("n_products_evaluated"))
    peak = F.max_by("date", F.struct("total_forecast", -F.datediff("date", F.lit("1970-01-01"))))
    whole = total.agg(F.coalesce(F.sum("total_forecast"), F.lit(0.0)).alias("total_expected_demand"), peak.alias("peak_forecast_period"), F.count("*").alias("forecast_horizon"))
    best = board.where("scope = 'ALL' AND selected").agg(F.first("model_name").alias("best_overall_model"))
    return own.crossJoin(whole).crossJoin(best).crossJoin(forecasts.agg(F.count_if(F.col("horizon_step") == 1).alias("n_products_forecasted")))  # one row each

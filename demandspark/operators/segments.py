"""Product segments, candidate models and expanding-window folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import materialized
from ..types import FOLDS, MONTHLY, VALIDATION_HORIZON
from .quantiles import exact_quantile

FAST = ("naive", "seasonal_naive", "moving_average", "exponential_smoothing")
ADVANCED = ("sarima", "prophet", "random_forest", "xgboost")
INTERMITTENT_RATIO = 0.35


def product_totals(panel: DataFrame) -> DataFrame:
    """(product, n_points, total_demand, zero_ratio): negative demand counts as 0."""
    y = F.greatest("y", F.lit(0.0))
    return panel.groupBy("product").agg(F.count("*").alias("n_points"), F.sum(y).alias("total_demand"), F.avg((F.col("y") == 0).cast("double")).alias("zero_ratio"))


def product_segments(panel: DataFrame, season: int = MONTHLY.season) -> DataFrame:
    """(product, n_points, total_demand, zero_ratio, segment), the first that holds: short_history (shorter than a season), intermittent
    (zero ratio over 0.35), high_volume (largest products up to half of all demand, the one that crosses included), low_volume (up to
    the 20th percentile, with five products or more), normal. Ties of totals go by product.

    The totals are written: each of the figures that decide reads them, and would build the panel anew."""
    return segmented(materialized(product_totals(panel)), season)


def _largest(per: DataFrame) -> DataFrame:
    """One row (_cut, _last): total and name of the last product, by falling totals and then by name, that less than half of all demand stands
    before; NULL without any. Sums by bucket of similar totals find the bucket that holds it, then only its distinct totals are ordered, then
    the names of one total."""
    rows = per.select("product", "total_demand", F.floor(-16 * F.log2(F.col("total_demand") + 1)).cast("int").alias("_bucket"))
    sums = rows.groupBy("_bucket").agg(F.sum("total_demand").alias("_sum"))  # a double has 2^1024 at most: 16,385 buckets
    falling = Window.orderBy("_bucket")
    before, all_of = falling.rowsBetween(Window.unboundedPreceding, -1), falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = sums.select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_larger"), (0.5 * F.sum("_sum").over(all_of)).alias("_half"))
    edge = held.where("_larger < _half").agg(F.max("_bucket").alias("_bucket"), F.max("_larger").alias("_larger"), F.max("_half").alias("_half"))
    totals = rows.join(F.broadcast(edge), "_bucket").groupBy("total_demand").agg(F.count("*").alias("_w"), F.first("_larger").alias("_larger"), F.first("_half").alias("_half"))  # one row
    before = Window.orderBy(F.desc("total_demand")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_upto", F.col("_larger") + F.coalesce(F.sum(F.col("total_demand") * F.col("_w")).over(before), F.lit(0.0))).where("_upto < _half")
    at = totals.agg(F.min("total_demand").alias("_cut"), F.min_by(F.ceil((F.col("_half") - F.col("_upto")) / F.col("total_demand")), "total_demand").alias("_taken"))
    tied = rows.join(F.broadcast(at), F.col("total_demand") == F.col("_cut")).withColumn("_k", F.row_number().over(Window.partitionBy("total_demand").orderBy("product")))  # one row
    return tied.where("_k <= _taken").agg(F.max("_cut").alias("_cut"), F.max("product").alias("_last"))


def segmented(per: DataFrame, season: int = MONTHLY.season) -> DataFrame:
    """per (product_totals, with any other columns) with `segment`: a few figures of all products decide, no product's row is moved."""
    whole = per.agg(F.sum("total_demand").alias("_all"), F.count("*").alias("_n")).crossJoin(exact_quantile(per, "total_demand", 0.2, "_p20")).crossJoin(_largest(per))  # one row each
    total = F.col("total_demand")
    large = F.coalesce((total > F.col("_cut")) | ((total == F.col("_cut")) & (F.col("product") <= F.col("_last"))), F.lit(False))
    segment = (
        F.when(F.col("n_points") < season, "short_history")
        .when(F.col("zero_ratio") > INTERMITTENT_RATIO, "intermittent")
        .when(large, "high_volume")
        .when((F.col("_n") >= 5) & (total <= F.col("_p20")), "low_volume")
        .otherwise("normal")
    )
    return per.crossJoin(F.broadcast(whole)).select(*(F.col(c) for c in per.columns), segment.alias("segment"))  # one row


def candidates(spark: SparkSession, mode: str = "balanced") -> DataFrame:
    """(segment, model_name, cand_ord): which models a segment is validated with, in order."""
    short = {"short_history": ("naive", "moving_average"), "intermittent": ("naive", "seasonal_naive", "moving_average", "croston"), "low_volume": ("naive", "seasonal_naive", "moving_average")}
    wide = {s: FAST + (ADVANCED if mode == "full" or (mode == "balanced" and s == "high_volume") else ()) for s in ("high_volume", "normal")}
    rows = [(s, m, k) for s, models in (short | wide).items() for k, m in enumerate(models)]
    return spark.createDataFrame(rows, "segment string, model_name string, cand_ord int")


def fold_cuts(n: Column, season: int = MONTHLY.season, horizon: int = VALIDATION_HORIZON, folds: int = FOLDS["balanced"]) -> Column:
    """Of a history of n periods the array of cuts: how many periods each fold may see. Empty if it is too short."""
    train = F.when(n >= season + 2 + horizon, season + 2).otherwise(F.greatest(F.lit(4), n - 2 * horizon))
    splits = F.least(F.lit(folds), F.floor((n - train) / horizon))
    step = F.greatest(F.lit(horizon), F.floor((n - train - horizon) / F.greatest(splits, F.lit(1))))
    fits = (n >= train + horizon) & (splits >= 1)
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(splits, F.lit(1)).cast("int") - 1), lambda k: (train + k * step).cast("int"))
    return F.when(fits, F.filter(cuts, lambda c: c + horizon <= n)).otherwise(F.array().cast("array<int>"))


def fold_cutoffs(lengths: DataFrame, season: int = MONTHLY.season, horizon: int = VALIDATION_HORIZON, folds: int = FOLDS["balanced"]) -> DataFrame:
    """lengths(product, n_points, ...) with a row for each fold: fold, cut (rows before the test window). None if the history is too short."""
    return lengths.select("*", F.posexplode(fold_cuts(F.col("n_points"), season, horizon, folds)).alias("fold", "cut"))

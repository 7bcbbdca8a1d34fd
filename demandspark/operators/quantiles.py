"""Exact quantiles without gathering all values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialized


def exact_quantile(rows: DataFrame, value: str, q: float, alias: str = "quantile") -> DataFrame:
    """One row: the q-quantile of a numeric column by linear interpolation; NULL if there is no value.

    Distinct values are counted, and put in buckets that follow their order (16 to an octave of their size, 33,000 at most); running counts over
    the buckets find the one or two that hold the places asked for, and only inside a bucket are values ordered."""
    v = F.col(value).cast("double")
    per = rows.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count("*").alias("w"))
    per = per.withColumn("b", (F.signum("v") * F.floor(16 * F.log2(F.abs("v") + 1))).cast("int"))
    sums = per.groupBy("b").agg(F.sum("w").alias("bw"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    held = sums.select("b", F.coalesce(F.sum("bw").over(before), F.lit(0)).alias("start"), "bw")
    place = sums.agg(F.sum("bw").alias("n")).select(((F.col("n") - 1) * F.lit(q)).alias("place"))
    low, high = F.floor("place"), F.ceil("place")
    wanted = held.crossJoin(F.broadcast(place)).where((F.col("start") <= high) & (F.col("start") + F.col("bw") > low))  # place: one row
    inside = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = per.join(F.broadcast(wanted), "b").withColumn("at", F.col("start") + F.coalesce(F.sum("w").over(inside), F.lit(0)))
    holds = lambda p: (F.col("at") <= p) & (F.col("at") + F.col("w") > p)
    ends = placed.agg(F.max(F.when(holds(low), F.col("v"))).alias("l"), F.max(F.when(holds(high), F.col("v"))).alias("h"), F.max(F.col("place") - low).alias("part"))
    return ends.select((F.col("l") + F.col("part") * (F.col("h") - F.col("l"))).alias(alias))


def grouped_quantile(per: DataFrame, by: str, value: str, q: float, alias: str = "quantile") -> DataFrame:
    """(by, alias, n): the q-quantile of each group of per(by, value, w), w: how often a value occurs; n: their sum. By linear interpolation.

    As in exact_quantile, for every group at once: a group's values fall in ordered buckets (33,000 at most), running counts over the buckets find
    those that hold the places, and only inside such a bucket are values ordered. No task holds the values of a group."""
    rows = per.select(F.col(by), F.col(value).cast("double").alias("_v"), F.col("w").alias("_w"))
    rows = rows.withColumn("_b", (F.signum("_v") * F.floor(16 * F.log2(F.abs("_v") + 1))).cast("int"))
    sums = rows.groupBy(by, "_b").agg(F.sum("_w").alias("_bw"))
    every, before = Window.partitionBy(by), Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    held = sums.withColumns({"_n": F.sum("_bw").over(every), "_start": F.coalesce(F.sum("_bw").over(before), F.lit(0))}).withColumn("_place", (F.col("_n") - 1) * F.lit(q))
    low, high = F.floor("_place"), F.ceil("_place")
    wanted = held.where((F.col("_start") <= high) & (F.col("_start") + F.col("_bw") > low)).select(F.col(by).alias("_by"), F.col("_b").alias("_bb"), "_n", "_start", "_place")
    inside = Window.partitionBy(by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.join(wanted, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_bb")))
    placed = met.withColumn("_at", F.col("_start") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    holds = lambda p: (F.col("_at") <= p) & (F.col("_at") + F.col("_w") > p)
    ends = placed.groupBy(by).agg(F.max(F.when(holds(low), F.col("_v"))).alias("_l"), F.max(F.when(holds(high), F.col("_v"))).alias("_h"), F.max(F.col("_place") - low).alias("_part"), F.max("_n").alias("n"))
    return ends.select(by, (F.col("_l") + F.col("_part") * (F.col("_h") - F.col("_l"))).alias(alias), "n")


def medians(rows: DataFrame, by: str, value: str) -> tuple[DataFrame, DataFrame]:
    """((by, value, w), (by, median, n)): the counts of each group's distinct values, written, and its median over these counts."""
    per = materialized(rows.where(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(by, value).agg(F.count("*").alias("w")))
    return per, grouped_quantile(per, by, value, 0.5, "median")

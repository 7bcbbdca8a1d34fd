"""Demand per product and period on a gap-free calendar grid, and its temporal features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cyclical
from ..sources.tables import spread
from ..types import GRANULARITIES, MONTHLY, Granularity


def period_of(date: Column, g: Granularity = MONTHLY) -> Column:
    """The period's label: first day of the month, or the Sunday that ends the week."""
    if g.name == "weekly":
        return (F.date_trunc("week", date) + F.expr("INTERVAL 6 DAY")).cast("date")
    return F.trunc(date.cast("date"), "month")


def aggregate_demand(df: DataFrame, g: Granularity = MONTHLY, **more: Column) -> DataFrame:
    """(product, date, qty) -> (product, date, y): sums per product and period. Rows without product or date don't count; a sum of NULLs is 0."""
    rows = df.where(F.col("product").isNotNull() & F.col("date").isNotNull()).withColumn("date", period_of(F.col("date"), g))
    return rows.groupBy(F.col("product").cast("string").alias("product"), "date").agg(F.coalesce(F.sum("qty"), F.lit(0.0)).cast("double").alias("y"), *(c.alias(n) for n, c in more.items()))


def densify(demand: DataFrame, g: Granularity = MONTHLY) -> DataFrame:
    """Every period between a product's first and last one; missing demand is 0, other columns are NULL there.

    The gaps after each row are generated from the next row's date, so that one window does it and no join is needed."""
    by_date = Window.partitionBy("product").orderBy("date")
    others = [c for c in demand.columns if c not in ("product", "date", "y")]
    rows = demand.withColumn("_until", F.to_date(F.coalesce(F.lead("date").over(by_date), F.expr(f"date + {g.step}"))))
    grid = F.filter(F.sequence(F.col("date"), F.col("_until"), F.expr(g.step)), lambda d: (d < F.col("_until")) | (d == F.col("date")))
    rows = rows.select("*", F.posexplode(grid).alias("_at", "_date"))
    here = F.col("_at") == 0
    return rows.select("product", F.col("_date").alias("date"), F.when(here, F.col("y")).otherwise(0.0).alias("y"), *(F.when(here, F.col(c)).alias(c) for c in others))


def panel(df: DataFrame, g: Granularity = MONTHLY, **more: Column) -> DataFrame:
    return densify(spread(aggregate_demand(df, g, **more), "product", df), g)


def _dense(demand: pa.Array, monthly: bool) -> pa.Array:
    """demand_series of a batch of products, of their lists of (period label, quantity)."""
    sizes, flat = pc.list_value_length(demand).to_numpy(zero_copy_only=False).astype(np.int64), demand.flatten()
    day = flat.field("date").cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64)
    at = day.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64) if monthly else day // 7
    starts, row = sizes.cumsum() - sizes, np.repeat(np.arange(len(sizes)), sizes)
    low, high = (f.reduceat(at, starts) if len(sizes) else at for f in (np.minimum, np.maximum))
    n = high - low + 1
    ends = n.cumsum()
    first, whole = ends - n, int(n.sum())
    y = np.bincount(first[row] + at - low[row], weights=flat.field("qty").to_numpy(zero_copy_only=False), minlength=whole).astype(np.float64)
    label = np.arange(whole) - np.repeat(first - low, n)
    label = label.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) if monthly else 7 * label + (day[0] % 7 if len(day) else 0)
    total, zeros, net = (np.add.reduceat(v, first) if len(sizes) else np.zeros(0) for v in (np.maximum(y, 0), (y == 0).astype(np.float64), y))
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    dates = pa.array(label.astype(np.int32)).cast(pa.date32())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(y)), pa.ListArray.from_arrays(offsets, dates), pa.array(total), pa.array(zeros / n), pa.array(net / n)], ["y", "dates", "total_demand", "zero_ratio", "mean"])


def demand_series(rows: DataFrame, g: Granularity = MONTHLY, *more: Column) -> DataFrame:
    """panel() of rows(product, date: a period's label, qty) as models.series gives it: a row for each product, with the aggregates in `more`. rows
    may hold a period several times; dealt by product, nothing is shuffled, and no period without demand is ever a row. Rows without date count in
    `more` only."""
    monthly = g.name == "monthly"

    def dense(demand: pa.Array) -> pa.Array:
        return _dense(demand, monthly)

    pair = F.struct(F.col("date").cast("date").alias("date"), F.coalesce(F.col("qty").cast("double"), F.lit(0.0)).alias("qty"))
    held = rows.where(F.col("product").isNotNull()).groupBy("product").agg(F.collect_list(F.when(F.col("date").isNotNull(), pair)).alias("_d"), *more).where(F.size("_d") > 0)
    beside = [c for c in held.columns if c not in ("product", "_d")]
    kind = "struct<y:array<double>,dates:array<date>,total_demand:double,zero_ratio:double,mean:double>"
    held = held.select("product", *beside, F.arrow_udf(dense, kind)("_d").alias("_s")).select("product", *beside, "_s.*")
    return held.select("product", "y", F.element_at("dates", -1).alias("last_date"), "dates", F.size("y").cast("long").alias("n_points"), "total_demand", "zero_ratio", "mean", *beside)


def rows_of(held: DataFrame) -> DataFrame:
    """(product, date, y): the panel that a table of series holds."""
    return held.select("product", "dates", F.posexplode("y").alias("_k", "y")).select("product", F.get("dates", "_k").alias("date"), "y")


def bounded_ffill(df: DataFrame, column: str | list[str], limit: int = 2) -> DataFrame:
    """Carries the values of one column, or of several, forward over at most `limit` NULLs of a product."""
    w = Window.partitionBy("product").orderBy("date")
    columns = [column] if isinstance(column, str) else column
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), *(F.lag(F.col(f"`{c}`"), k).over(w) for k in range(1, limit + 1))) for c in columns}) if columns else df


def ffill(df: DataFrame, column: str, by: list[str] | None = None, order: str = "date") -> DataFrame:
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def period_features(df: DataFrame, columns: list[str], g: Granularity = MONTHLY) -> DataFrame:
    """(product, date, columns) by period: the largest value of a column that has two distinct values at most, else the mean. One aggregate for all."""
    # two distinct values at most: nothing but the smallest and the largest. Two plain aggregates instead of distinct counts
    ends = df.agg(*(x for i, c in enumerate(columns) for x in (F.min(F.col(f"`{c}`")).alias(f"l{i}"), F.max(F.col(f"`{c}`")).alias(f"h{i}"))))
    inner = [F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`") != F.col(f"_ends.l{i}")) & (F.col(f"`{c}`") != F.col(f"_ends.h{i}")) for i, c in enumerate(columns)]
    held = df.crossJoin(F.broadcast(ends.select(F.struct("*").alias("_ends"))))  # one row
    binary = held.agg(*((F.count_if(x) == 0).alias(f"b{i}") for i, x in enumerate(inner))).first()
    rows = df.where(F.col("product").isNotNull() & F.col("date").isNotNull()).withColumn("date", period_of(F.col("date"), g))
    value = lambda c: F.col(f"`{c}`").try_cast("double") if dict(df.dtypes)[c] == "string" else F.col(f"`{c}`").cast("double")
    return rows.groupBy("product", "date").agg(*((F.max(value(c)) if binary[i] else F.avg(value(c))).alias(c) for i, c in enumerate(columns)))


def period_feature(df: DataFrame, column: str, g: Granularity = MONTHLY) -> DataFrame:
    return period_features(df, [column], g)


def with_period_features(panel: DataFrame, df: DataFrame, columns: list[str], g: Granularity = MONTHLY) -> DataFrame:
    """panel with the columns by period, carried forward over gaps of up to two periods."""
    if not columns:
        return panel
    return bounded_ffill(panel.join(period_features(df, columns, g), ["product", "date"], "left"), columns)


def calendar_features(df: DataFrame, weekly: bool = False) -> DataFrame:
    sin, cos = cyclical(F.month("date"), 12)
    cols = {"month": F.month("date"), "quarter": F.quarter("date"), "year": F.year("date"), "month_sin": sin, "month_cos": cos}
    if weekly:
        wsin, wcos = cyclical(F.weekofyear("date"), 52)
        cols |= {"weekofyear": F.weekofyear("date"), "week_sin": wsin, "week_cos": wcos}
    return df.withColumns(cols)


def temporal_features(df: DataFrame, g: Granularity = MONTHLY) -> DataFrame:
    """time_index, lags, rolling mean and std of earlier rows only, and growth: one shuffle by product.

    A rolling value needs half its window (std: and two rows); growth compares lag 1 with the second lag."""
    w = Window.partitionBy("product").orderBy("date")
    cols = {"time_index": F.row_number().over(w) - 1} | {f"lag_{k}": F.lag("y", k).over(w) for k in g.lags}
    for n in g.windows:
        before = w.rowsBetween(-n, -1)
        cols[f"rolling_mean_{n}"] = F.when(F.count("y").over(before) >= max(1, n // 2), F.avg("y").over(before))
    n = g.windows[0]
    before = w.rowsBetween(-n, -1)
    cols[f"rolling_std_{n}"] = F.when(F.count("y").over(before) >= max(2, n // 2), F.stddev_samp("y").over(before))
    near, far = f"lag_{g.lags[0]}", f"lag_{g.lags[1]}"
    out = df.withColumns(cols)
    return out.withColumn("pop_growth", F.when(F.col(near).isNotNull() & F.col(far).isNotNull(), F.when(F.col(far) > 0, F.col(near) / F.col(far) - 1).otherwise(0.0)))


def granularity(name: str) -> Granularity:
    if name not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {sorted(GRANULARITIES)}")
    return GRANULARITIES[name]

"""Fitted tree models as flat arrays, and the recursion that forecasts all steps of a block of products inside one task."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import drop_path, shared_folder
from ..types import Granularity

#: Products whose features are held at a time.
BLOCK = 1024


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees one after the other: a leaf has feature -1. roots: each tree's first node. weights: what its prediction counts."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions for the rows of x; all trees go down together, a level at a time."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return self.value[at] @ self.weights
            down = np.where(x[rows, np.maximum(feature, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(inner, down, at)


def exported(model) -> Forest:
    """The arrays of a fitted pyspark.ml forest, boosted trees or single tree, read from the form in which Spark saves it.

    Their size follows from the number of trees and their depth, not from the data."""
    from pyspark.ml.regression import GBTRegressionModel
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    nodes = saved.select("treeID", "nodeData.*") if "treeID" in saved.columns else saved.withColumn("treeID", F.lit(0))
    rows = nodes.select("treeID", "id", "prediction", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("split.numCategories").alias("kinds"))
    table = rows.orderBy("treeID", "id").toPandas()
    drop_path(spark, path)
    if (table["kinds"] > 0).any():
        raise ValueError("categorical splits are not exported")
    tree, leaf = table["treeID"].to_numpy(), table["leftChild"].to_numpy() < 0
    _, roots, place = np.unique(tree, return_index=True, return_inverse=True)
    down = lambda c: np.where(leaf, -1, table[c].to_numpy() + roots[place])
    weights = np.array(getattr(model, "treeWeights", [1.0]), float)
    weights = weights if isinstance(model, GBTRegressionModel) else weights / weights.sum()
    return Forest(np.where(leaf, -1, table["feature"].to_numpy()), table["threshold"].fillna(0.0).to_numpy(), down("leftChild"), down("rightChild"), table["prediction"].to_numpy(), roots, weights)


def demand_features(y: np.ndarray, g: Granularity) -> dict[str, np.ndarray]:
    """The lags, rolling values and growth of the period after y (a row for each product, right-aligned, NaN before its history); NaN: undefined."""
    out = {f"lag_{k}": y[:, -k] for k in g.lags}
    seen = ~np.isnan(y)
    mean = lambda n: np.nansum(y[:, -n:], axis=1) / np.maximum(seen[:, -n:].sum(axis=1), 1)
    for n in g.windows:
        out[f"rolling_mean_{n}"] = np.where(seen[:, -n:].sum(axis=1) >= max(1, n // 2), mean(n), np.nan)
    n = g.windows[0]
    count = seen[:, -n:].sum(axis=1)
    apart = np.nansum((y[:, -n:] - mean(n)[:, None]) ** 2, axis=1)
    out[f"rolling_std_{n}"] = np.where(count >= max(2, n // 2), np.sqrt(apart / np.maximum(count - 1, 1)), np.nan)
    near, far = out[f"lag_{g.lags[0]}"], out[f"lag_{g.lags[1]}"]
    ratio = np.divide(near, far, out=np.ones_like(near), where=far > 0) - 1
    out["pop_growth"] = np.where(np.isnan(near) | np.isnan(far), np.nan, np.where(far > 0, ratio, 0.0))
    return out


def recursive_forecast(ready: DataFrame, forest: Forest, names: list[str], ahead: list[str], g: Granularity, horizon: int) -> DataFrame:
    """(product, last_date, horizon_step, forecast) from ready(product, last_date, tail, ahead): a row for each product with its latest demand,
    oldest first, and for each step the features that are known beforehand, in the order of `ahead`. names: the model's features in its
    order. A product's prediction of a step is the demand that its later steps look back to; undefined features are 0."""
    held = ready.sparkSession.sparkContext.broadcast(forest)
    reach = max(*g.lags, *g.windows)

    def steps(y: np.ndarray, known: np.ndarray) -> Iterator[np.ndarray]:
        trees = held.value
        for k in range(horizon):
            made = demand_features(y, g)
            x = np.stack([np.nan_to_num(made[c]) if c in made else known[:, k, ahead.index(c)] for c in names], axis=1)
            told = np.maximum(trees.predict(x), 0.0)
            y = np.concatenate([y[:, 1:], told[:, None]], axis=1)
            yield told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                y = np.full((b.num_rows, reach), np.nan)
                for i, tail in enumerate(b.column(2)):
                    values = tail.values.to_numpy(zero_copy_only=False)[-reach:]
                    y[i, reach - len(values) :] = values
                known = b.column(3).flatten().flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, horizon, len(ahead))
                told = np.stack(list(steps(y, known)), axis=1)
                again = pa.array(np.repeat(np.arange(b.num_rows), horizon))
                yield pa.RecordBatch.from_arrays([b.column(0).take(again), b.column(1).take(again), pa.array(np.tile(np.arange(1, horizon + 1, dtype=np.int32), b.num_rows)), pa.array(told.ravel())], ["product", "last_date", "horizon_step", "forecast"])

    return ready.select("product", "last_date", "tail", "ahead").mapInArrow(run, "product string, last_date date, horizon_step int, forecast double")


def known_ahead(base: DataFrame, extra: list[str], ahead: Callable[[DataFrame], DataFrame], g: Granularity, horizon: int, step_date) -> tuple[DataFrame, list[str]]:
    """(ready, names): the input of recursive_forecast. ahead adds its features to future rows (product, date, time_index, extra's last values)."""
    pairs = F.sort_array(F.collect_list(F.struct("date", "y")))
    last = base.groupBy("product").agg(pairs.alias("_s"), *(F.max_by(c, "date").alias(c) for c in extra))
    reach = max(*g.lags, *g.windows)
    tail = F.transform(F.slice("_s", F.greatest(F.size("_s") - reach + 1, F.lit(1)), F.lit(reach)), lambda s: s["y"])
    last = last.select("product", F.element_at("_s", -1)["date"].cast("date").alias("last_date"), F.size("_s").alias("_n"), tail.alias("tail"), *extra)
    rows = last.select("product", "last_date", "_n", *extra, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_step"))
    rows = rows.withColumns({"date": step_date(F.col("last_date"), F.col("_step"), g), "time_index": F.col("_n") + F.col("_step") - 1})
    full = ahead(rows.select("product", "date", "_step", "time_index", *extra))
    names = [c for c in full.columns if c not in ("product", "date", "_step")]
    plain = lambda c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")), F.lit(12.0 if c == "months_to_peak" else 0.0))
    steps = full.groupBy("product").agg(F.sort_array(F.collect_list(F.struct("_step", F.array(*map(plain, names)).alias("x")))).alias("_x"))
    return last.select("product", "last_date", "tail").join(steps.select("product", F.col("_x.x").alias("ahead")), "product"), names

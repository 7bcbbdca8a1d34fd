"""Forecasting models. The closed forms take a product's series as an array, a batch of products at a time; trees are fitted by pyspark.ml for all products
together, seasonal ARIMA and the additive model for each product in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread_again
from ..types import MONTHLY, Granularity

ALPHA = 0.3
CROSTON_ALPHA = 0.1
CLOSED_FORM = ("naive", "seasonal_naive", "moving_average", "exponential_smoothing", "croston")
#: The models beyond the closed forms.
FITTED = ("sarima", "prophet", "random_forest", "xgboost")


def series(panel: DataFrame) -> DataFrame:
    """(product, y, last_date, dates, n_points, total_demand, zero_ratio, mean): a row for each product, its demand in order of date (as long as its
    history), and what product_totals tells of it."""
    pairs = F.array_sort(F.collect_list(F.struct("date", "y")))
    rows = spread_again(panel.select("product", "date", "y"), "product", panel)
    y = F.greatest("y", F.lit(0.0))
    held = rows.groupBy("product").agg(pairs.alias("_s"), F.sum(y).alias("total_demand"), F.avg((F.col("y") == 0).cast("double")).alias("zero_ratio"), F.avg("y").alias("mean"))
    return held.select("product", F.col("_s.y").alias("y"), F.element_at("_s", -1)["date"].alias("last_date"), F.col("_s.date").alias("dates"), F.size("_s").cast("long").alias("n_points"), "total_demand", "zero_ratio", "mean")


def _listed(sizes: np.ndarray, values: pa.Array, missing: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate([[0], sizes.cumsum()]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=None if missing is None else pa.array(missing))


def _told(y: pa.Array, cuts: pa.Array, season: int, average: int, ahead: int) -> pa.Array:
    """prefixes() of a batch of products: one pass forward over the periods, each for all products that are so long."""
    lens, asked = (pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (y, cuts))
    flat, cut = y.flatten().to_numpy(zero_copy_only=False), cuts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    starts, order = lens.cumsum() - lens, np.argsort(-lens, kind="stable")
    first, longest = starts[order], int(lens.max(initial=0))
    level, size, gap, since, seen = (np.zeros(len(lens)), np.zeros(len(lens)), np.ones(len(lens)), np.ones(len(lens)), np.zeros(len(lens), bool))
    levels, crostons = np.empty(len(flat)), np.empty(len(flat))
    for t, k in enumerate(np.searchsorted(-lens[order], -np.arange(longest), "left").tolist()):
        at = first[:k] + t
        x, old = flat[at], seen[:k].copy()
        hit = x != 0
        level[:k] = ALPHA * x + (1 - ALPHA) * level[:k] if t else x
        size[:k] = np.where(hit, np.where(old, CROSTON_ALPHA * x + (1 - CROSTON_ALPHA) * size[:k], x), size[:k])
        gap[:k] = np.where(hit, np.where(old, CROSTON_ALPHA * since[:k] + (1 - CROSTON_ALPHA) * gap[:k], since[:k]), gap[:k])
        since[:k], seen[:k] = np.where(hit, 1.0, since[:k] + 1), old | hit
        levels[at], crostons[at] = level[:k], np.where(seen[:k], size[:k] / gap[:k], 0.0)
    row = np.repeat(np.arange(len(lens)), asked)
    fits = (cut >= 1) & (cut <= lens[row])
    row, cut = row[fits], cut[fits]
    end = starts[row] + cut
    n, mean = np.minimum(average, cut), np.zeros(len(cut))
    for k in range(average):
        mean = np.where(k < n, mean + flat[np.minimum(end - n + k, max(len(flat) - 1, 0))], mean)
    whole, repeated = cut >= season, min(ahead, season)
    values = flat[((end - season)[whole][:, None] + np.arange(repeated)).ravel()]
    cols = {"cut": pa.array(cut, pa.int32()), "naive": flat[end - 1], "moving_average": mean / n, "exponential_smoothing": levels[end - 1], "croston": crostons[end - 1], "season": _listed(np.where(whole, repeated, 0), pa.array(values), ~whole)}
    told = pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()], list(cols))
    return _listed(np.bincount(row, minlength=len(lens)), told)


def prefixes(y: Column, cuts: Column, g: Granularity = MONTHLY, horizon: int = 1) -> Column:
    """What the closed forms need to know of the first `cut` values of y, for each of cuts (ascending): array of (cut, naive, moving_average,
    exponential_smoothing, croston, season), season: the values that the next `horizon` periods repeat, NULL where there is less than one season.

    exponential_smoothing is the level; croston the smoothed size of non-zero demands by that of their distance, 0 before the first."""
    season, average = g.season, g.average

    def told(y: pa.Array, cuts: pa.Array) -> pa.Array:
        return _told(y, cuts, season, average, horizon)

    return F.arrow_udf(told, f"array<{PREFIX}>")(y.cast("array<double>"), cuts.cast("array<int>"))


#: A row of validation, as an entry of a product's list of them.
VALIDATED = "struct<model_name:string,cand_ord:int,fold:int,horizon_step:int,date:date,actual:double,validation_prediction:double>"
ROW = [("model_name", pa.string()), ("cand_ord", pa.int32()), ("fold", pa.int32()), ("horizon_step", pa.int32()), ("date", pa.date32()), ("actual", pa.float64()), ("validation_prediction", pa.float64())]
PREFIX = "struct<cut:int,naive:double,moving_average:double,exponential_smoothing:double,croston:double,season:array<double>>"


def batch_tests(y: pa.Array, dates: pa.Array, cuts: pa.Array, asked: pa.Array, season: int, average: int, horizon: int, ahead: int) -> tuple[pa.Array, dict[str, np.ndarray]]:
    """Of a batch of series, (the whole histories as entries of prefixes, columns of the closed forms' validation rows, in order of products):
    asked: lists of (model_name, cand_ord); cuts: of each fold, then the whole length. code: place in CLOSED_FORM."""
    told, lens = _told(y, cuts, season, average, ahead), pc.list_value_length(y).to_numpy(zero_copy_only=False).astype(np.int64)
    counts, entries = pc.list_value_length(told).to_numpy(zero_copy_only=False).astype(np.int64), told.flatten()
    ends = counts.cumsum()
    whole = entries.take(pa.array(ends - 1))
    fold = np.ones(len(entries), bool)
    fold[ends - 1] = False
    product = np.repeat(np.arange(len(lens)), counts)[fold]
    number = (np.arange(len(entries)) - np.repeat(ends - counts, counts))[fold]
    known = entries.filter(pa.array(fold))
    cut = known.field("cut").to_numpy(zero_copy_only=False).astype(np.int64)
    flat, after = y.flatten(), (lens.cumsum() - lens)[product] + cut
    values, steps = flat.to_numpy(zero_copy_only=False), np.arange(horizon)
    guess = np.empty((len(cut), len(CLOSED_FORM), horizon))
    for k, m in enumerate(CLOSED_FORM):
        guess[:, k] = known.field("naive" if m == "seasonal_naive" else m).to_numpy(zero_copy_only=False)[:, None]
    late = cut >= season
    guess[late, CLOSED_FORM.index("seasonal_naive")] = values[after[late][:, None] - season + steps % season]
    wanted, names = pc.list_value_length(asked).to_numpy(zero_copy_only=False).astype(np.int64), asked.flatten()
    codes, ranks = pc.index_in(names.field("model_name"), pa.array(CLOSED_FORM)).to_numpy(zero_copy_only=False), names.field("cand_ord").to_numpy(zero_copy_only=False)
    each = wanted[product]  # a fold has a row for each model that its product asks for, and each step
    of = np.repeat(np.arange(len(cut)), each)
    which = np.arange(len(of)) - np.repeat(each.cumsum() - each, each) + (wanted.cumsum() - wanted)[product][of]
    at, spread_out = (after[of][:, None] + steps).ravel(), lambda v: np.repeat(v.astype(np.int64), horizon)
    held = ~pc.is_null(flat).to_numpy(zero_copy_only=False)
    days = dates.flatten().cast(pa.int32()).to_numpy(zero_copy_only=False)
    return whole, {"product": spread_out(product[of]), "code": spread_out(codes[which]), "cand_ord": spread_out(ranks[which]), "fold": spread_out(number[of]), "horizon_step": np.tile(steps + 1, len(of)), "date": days[at], "actual": values[at], "known": held[at], "guess": np.maximum(guess[of, codes[which].astype(np.int64)], 0).ravel()}


def validated_rows(n: int, rows: dict[str, np.ndarray], names: list[str]) -> pa.Array:
    """Columns as of batch_tests (code: place in names), in order of products, as lists of VALIDATED."""
    small = lambda c: pa.array(rows[c].astype(np.int32))
    told = "told" in rows
    cols = [pa.array(names, pa.string()).take(pa.array(rows["code"])), small("cand_ord"), small("fold"), small("horizon_step"), small("date").cast(pa.date32()), pa.array(rows["actual"], mask=~rows["known"]), pa.array(rows["guess"], mask=~rows["told"] if told else None)]
    return _listed(np.bincount(rows["product"], minlength=n), pa.StructArray.from_arrays(cols, ["model_name", "cand_ord", "fold", "horizon_step", "date", "actual", "validation_prediction"]))


def predicted(model: str, prefix: Column, step: Column, g: Granularity = MONTHLY) -> Column:
    """The closed-form model's prediction `step` periods after a prefix (an entry of prefixes), at least 0.

    naive repeats the last value, seasonal_naive the last season (the last value where there is less than one), the others are level."""
    value = F.coalesce(F.get(prefix["season"], F.pmod(step - 1, F.lit(g.season)).cast("int")), prefix["naive"]) if model == "seasonal_naive" else prefix[model]
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def predicted_by(name: Column, prefix: Column, step: Column, g: Granularity = MONTHLY, otherwise: Column | None = None) -> Column:
    """As predicted, for the model that a column names."""
    out = F.lit(None).cast("double") if otherwise is None else otherwise
    for m in CLOSED_FORM:
        out = F.when(name == m, predicted(m, prefix, step, g)).otherwise(out)
    return out


def histories(panel: DataFrame, g: Granularity = MONTHLY, horizon: int = 1) -> DataFrame:
    """(product, last_date, prefix): the whole history of each product as an entry of prefixes."""
    rows = series(panel)
    return rows.select("product", "last_date", F.get(prefixes(F.col("y"), F.array(F.size("y")), g, horizon), F.lit(0)).alias("prefix"))


def forecast(panel: DataFrame, model: str, g: Granularity = MONTHLY, horizon: int | None = None) -> DataFrame:
    """(product, date, forecast, horizon_step) of one closed-form model for all products."""
    horizon = horizon or g.horizon
    rows = histories(panel, g, horizon).withColumn("horizon_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return rows.select("product", step_date(F.col("last_date"), F.col("horizon_step"), g).alias("date"), predicted(model, F.col("prefix"), F.col("horizon_step"), g).alias("forecast"), "horizon_step")


def step_date(last: Column, step: Column, g: Granularity = MONTHLY) -> Column:
    return F.date_add(last, (7 * step).cast("int")) if g.name == "weekly" else F.add_months(last, step)


def statistical_forecast(panel: DataFrame, model: str, g: Granularity = MONTHLY, horizon: int = 3) -> DataFrame:
    """(product, date, forecast, horizon_step) by seasonal ARIMA ("sarima") or the additive model of trend and season ("prophet"), fitted to each
    product over blocks of products. A product whose history is too short has no rows."""
    from .statistical import block_forecast

    rows = series(panel.select("product", F.col("date").cast("date").alias("date"), F.col("y").cast("double").alias("y")))
    ahead = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: step_date(F.col("last_date"), k, g))
    told = block_forecast(rows.withColumn("ahead", ahead), model, g, horizon)
    return told.select("product", step_date(F.col("last_date"), F.col("horizon_step"), g).alias("date"), "forecast", "horizon_step")


def tree_regressor(model: str):
    """The pyspark.ml counterpart of a tree model: 100 trees, seed 42."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    common = {"featuresCol": "features", "labelCol": "y", "predictionCol": "prediction", "seed": 42}
    return RandomForestRegressor(numTrees=100, maxDepth=10, featureSubsetStrategy="all", **common) if model == "random_forest" else GBTRegressor(maxIter=100, **common)


LEAST_ROWS = 5
#: Of a training table, how many rows a task takes: each of hundreds of small jobs has as many tasks as the table has parts.
TRAIN_ROWS = 8192


def tree_forecast(panel: DataFrame, model: str, g: Granularity = MONTHLY, horizon: int = 3, fill: tuple[str, ...] = (), sector: str | None = None, regressor=None) -> DataFrame:
    """(product, date, forecast, horizon_step) by one tree model over all products.

    panel: product, date, y and numeric columns that may be trained on. The model is fitted by pyspark.ml, then sent to the tasks as flat
    arrays: a task holds a block of products and goes through all their steps, each on what is known or predicted before. Seasonality is
    found once, in the history. Later values of the columns in `fill` are the mean of their calendar month, other columns keep their last
    one. Raises if fewer than five rows have all features. The result is written."""
    from pyspark.ml.feature import VectorAssembler

    from ..sources.tables import checkpointed, dropped, materialized
    from . import trees
    from .features import as_numbers, climatology, numeric_features, seasonal_detection, seasonal_features
    from .panel import calendar_features

    extra = [c for c in panel.columns if c not in ("product", "date", "y")]
    base = materialized(panel.select("product", F.col("date").cast("date").alias("date"), F.col("y").cast("double").alias("y"), *extra))
    seasons = materialized(seasonal_detection(base, sector))
    try:
        known = numeric_features(base, g, seasons)
        names = [c for c in known.columns if c not in ("product", "date", "y")]
        whole = known.dropna(subset=[c for c in names if c != "months_to_peak"] + ["y"])
        rows = whole.fillna(12, ["months_to_peak"]).fillna(0, names).select("product", "date", "y", *(F.col(f"`{c}`").cast("double").alias(c) for c in names))
        # parts by the number of rows and in order, whatever wrote them: the draws of the trees hang on it
        parts = -(-base.count() // TRAIN_ROWS)
        rows = rows.repartitionByRange(parts, "product", "date").sortWithinPartitions("product", "date")
        # every one of the hundreds of jobs carries the lineage of what it trains on, so that it is cut
        train = checkpointed(VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "y"))
        if train.limit(LEAST_ROWS).count() < LEAST_ROWS:
            raise ValueError(f"fewer than {LEAST_ROWS} rows have all features")
        fitted = (regressor or tree_regressor(model)).fit(train)

        def ahead(rows: DataFrame) -> DataFrame:
            for c in fill:
                month = climatology(base, c).select("product", F.col("month").alias("_month"), F.col("value").alias(f"_next_{c}"))
                rows = rows.withColumn("_month", F.month("date")).join(month, ["product", "_month"], "left").withColumn(c, F.col(f"_next_{c}")).drop("_month", f"_next_{c}")
            return as_numbers(seasonal_features(calendar_features(rows, g.name == "weekly"), seasons))

        ready, order = trees.known_ahead(base, extra, ahead, g, horizon, step_date)
        told = trees.recursive_forecast(ready, trees.exported(fitted), names, order, g, horizon)
        return materialized(told.select("product", step_date(F.col("last_date"), F.col("horizon_step"), g).alias("date"), "forecast", "horizon_step"))
    finally:
        for made in (base, seasons):
            dropped(made)

"""Walk-forward validation, leaderboard, hybrid and selection."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import metric_columns
from ..sources.tables import dropped, materialized
from ..types import FOLDS, MONTHLY, VALIDATION_HORIZON, Granularity
from .models import CLOSED_FORM, FITTED, PREFIX, ROW, VALIDATED, batch_tests, series, validated_rows
from .segments import candidates, fold_cuts, fold_cutoffs, product_segments, segmented

INTERVAL_Z = 1.28
HYBRID = "hybrid_ensemble"
HYBRID_ORDER = 99
#: Parts of a hybrid at most.
PARTS = 3


def _asking(held: DataFrame, g: Granularity, mode: str, horizon: int) -> DataFrame:
    """Rows of series and segment with `asked` (array of model_name, cand_ord: the closed forms among the candidates) and `cuts` (of the folds, and the
    length of the history)."""
    names = F.array_sort(F.collect_list(F.struct("cand_ord", "model_name")))
    asked = candidates(held.sparkSession, mode).where(F.col("model_name").isin(*CLOSED_FORM)).groupBy("segment").agg(F.transform(names, lambda c: F.struct(c["model_name"].alias("model_name"), c["cand_ord"].alias("cand_ord"))).alias("asked"))
    cuts = F.concat(fold_cuts(F.col("n_points"), g.season, horizon, FOLDS[mode]), F.array(F.size("y")))
    rows = held.join(F.broadcast(asked), "segment")  # at most five rows
    return rows.withColumns({"cuts": cuts, "y": F.col("y").cast("array<double>"), "dates": F.col("dates").cast("array<date>")})


def validation_predictions(panel: DataFrame, g: Granularity = MONTHLY, mode: str = "balanced", horizon: int = VALIDATION_HORIZON, segments: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """(product, model_name, cand_ord, fold, horizon_step, date, actual, validation_prediction) of the closed-form candidates.

    A product's series is read once, forward, and what each fold may know of it is kept: one shuffle and one scan for all folds, models and
    steps, which are told apart on these few values only. held: the panel's written series (models.series), where there are any."""
    held = (series(panel) if segments is not None else materialized(series(panel))) if held is None else held
    told = segmented(held, g.season) if segments is None else held.join(segments.select("product", "segment"), "product")
    season, average = g.season, g.average

    def tested(y: pa.Array, dates: pa.Array, cuts: pa.Array, asked: pa.Array) -> pa.Array:
        return validated_rows(len(y), batch_tests(y, dates, cuts, asked, season, average, horizon, 1)[1], list(CLOSED_FORM))

    rows = F.arrow_udf(tested, f"array<{VALIDATED}>")("y", "dates", "cuts", "asked")
    return _asking(told, g, mode, horizon).withColumn("_rows", rows).select("product", F.inline("_rows"))


def asked_of(panel: DataFrame, g: Granularity = MONTHLY, mode: str = "balanced", segments: DataFrame | None = None) -> DataFrame:
    """(product, n_points, segment, model_name, cand_ord): which models each product is a candidate of."""
    segments = product_segments(panel, g.season) if segments is None else segments
    return segments.select("product", "n_points", "segment").join(F.broadcast(candidates(panel.sparkSession, mode)), "segment")  # at most 22 rows


def fold_validation(panel: DataFrame, model: str, forecaster, fold: int, g: Granularity = MONTHLY, mode: str = "balanced", horizon: int = VALIDATION_HORIZON, asked: DataFrame | None = None) -> DataFrame:
    """Validation rows of one fold of a model that isn't a closed form: forecaster(panel, horizon) -> (product, date, forecast, horizon_step)
    sees each product that asks for the model up to the fold's cut, in one call for all of them."""
    mine = (asked_of(panel, g, mode) if asked is None else asked).where(F.col("model_name") == model)
    cuts = fold_cutoffs(mine.select("product", "n_points", "cand_ord"), g.season, horizon, FOLDS[mode]).where(F.col("fold") == fold).select("product", "cand_ord", "cut")
    # few products ask for a fitted model: the others' rows are left before anything is ordered
    numbered = panel.join(cuts.select("product"), "product", "left_semi").withColumn("_rn", F.row_number().over(Window.partitionBy("product").orderBy("date")))
    known = numbered.join(cuts, "product")
    made = forecaster(known.where("_rn <= cut").select(*panel.columns), horizon)
    true = known.where((F.col("_rn") > F.col("cut")) & (F.col("_rn") <= F.col("cut") + horizon)).select("product", "date", "cand_ord", F.col("y").alias("actual"))
    rows = true.join(made, ["product", "date"])
    return rows.select("product", F.lit(model).alias("model_name"), "cand_ord", F.lit(fold).alias("fold"), "horizon_step", "date", "actual", F.col("forecast").alias("validation_prediction"))


def model_validation(panel: DataFrame, model: str, forecaster, g: Granularity = MONTHLY, mode: str = "balanced", horizon: int = VALIDATION_HORIZON) -> DataFrame:
    """The rows of all folds, to be given to leaderboard as `extra`."""
    return reduce(DataFrame.unionByName, (fold_validation(panel, model, forecaster, fold, g, mode, horizon) for fold in range(FOLDS[mode])))


@dataclass
class Advanced:
    """What validating the models beyond the closed forms gave: rows (None without any), failures (model, reason), seconds of each model."""

    rows: DataFrame | None = None
    failures: dict[str, str] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)


def validate_advanced(panel: DataFrame, forecasters: dict, g: Granularity = MONTHLY, mode: str = "balanced", horizon: int = VALIDATION_HORIZON, parallel: int = 8, segments: DataFrame | None = None) -> Advanced:
    """Validates each of forecasters (model -> forecaster) for the products that ask for it. Folds and models don't depend on each other: `parallel`
    of them are fitted at a time, the longest first. A fold that fails loses its own rows only; a model without any row is failed, with the first
    reason. A model that no product asks for isn't run. The rows are written, and those of the panel that are asked for: it is read once for all folds.
    segments: product_segments, where they are known."""
    asked = materialized(asked_of(panel, g, mode, segments).where(F.col("model_name").isin(*forecasters)))
    wanted = {r["model_name"] for r in asked.select("model_name").distinct().collect()}
    models, out, made = sorted((m for m in forecasters if m in wanted), key=lambda m: m != "xgboost"), Advanced(), []
    panel = materialized(panel.join(asked.select("product").distinct(), "product", "left_semi")) if models else panel

    def run(model: str, fold: int) -> tuple[DataFrame | None, str, float]:
        began = time.time()
        try:
            rows = materialized(fold_validation(panel, model, forecasters[model], fold, g, mode, horizon, asked))
            return rows, "", time.time() - began
        except Exception as e:  # noqa: BLE001  one failing fold or model must not lose the others
            return None, (str(e).splitlines() or [type(e).__name__])[0][:200], time.time() - began

    with ThreadPoolExecutor(parallel) as pool:
        runs = {m: [pool.submit(inheritable_thread_target(panel.sparkSession)(run), m, fold) for fold in range(FOLDS[mode])] for m in models}
        for model, futures in runs.items():
            found = [f.result() for f in futures]
            rows = [r for r, _, _ in found if r is not None]
            reason = next((why for _, why, _ in found if why), "")
            out.seconds[model] = sum(took for _, _, took in found)
            if reason and not any(r.limit(1).count() for r in rows):
                out.failures[model] = reason
            made += rows
    dropped(asked)
    dropped(panel if models else None)
    out.rows = reduce(DataFrame.unionByName, made) if made else None
    return out


#: Sums over a product's validation rows of a model, which add up to those of all products: absolute and squared errors, errors, their number, shares of
#: the actual and their number, absolute actuals.
SUMS = ("s_abs", "s_square", "s_error", "n_error", "s_share", "n_share", "s_actual")


def _sums(group: np.ndarray, n: int, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """FIGURES of each of n groups of rows, undefined ones NaN."""
    a, known, both = rows["actual"], rows["known"], rows["known"] & rows["told"]
    e, some = rows["guess"] - a, both & (a != 0)
    wrong, size = np.abs(e), np.abs(a)
    add = lambda v, where: np.bincount(group[where], weights=v[where], minlength=n)
    count = lambda where: np.bincount(group[where], minlength=n)
    with np.errstate(all="ignore"):
        out = dict(zip(SUMS, (add(wrong, both), add(e * e, both), add(e, both), count(both), add(wrong / size, some), count(some), add(size, known)), strict=True))
        total = np.where((out["s_actual"] == 0) | (out["n_error"] == 0), np.nan, out["s_actual"])
        out |= {"mae": out["s_abs"] / out["n_error"], "rmse": np.sqrt(out["s_square"] / out["n_error"]), "mape": out["s_share"] / out["n_share"], "wmape": out["s_abs"] / total, "forecast_bias": out["s_error"] / total}
    pairs = np.unique(group * 64 + rows["fold"])
    return out | {"n_rows": np.bincount(group, minlength=n), "n_folds": np.bincount(pairs // 64, minlength=n), "n_bits": np.bincount(pairs // 64, weights=2.0 ** (pairs % 64), minlength=n)}


def pooled_metrics() -> list[Column]:
    """metric_columns and n_rows over the SUMS of rows of models."""
    s = {c: F.sum(c) for c in SUMS}
    size = F.when(s["n_error"] > 0, s["s_actual"])
    means = [F.try_divide(s["s_abs"], s["n_error"]).alias("mae"), F.sqrt(F.try_divide(s["s_square"], s["n_error"])).alias("rmse"), F.try_divide(s["s_share"], s["n_share"]).alias("mape")]
    return [*means, F.try_divide(s["s_abs"], size).alias("wmape"), F.try_divide(s["s_error"], size).alias("forecast_bias"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")]


def _halves_up(v: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(v * 10.0**digits + 0.5) / 10.0**digits


METRICS = ("mae", "rmse", "mape", "wmape", "forecast_bias", "n_rows", "n_folds")
#: n_bits: the folds (below 53) as bits.
FIGURES = (*METRICS, *SUMS, "n_bits")
MODEL = "struct<model_name:string,cand_ord:int," + ",".join(f"{c}:{'bigint' if c.startswith('n_') else 'double'}" for c in FIGURES) + ",selected:boolean,weight:double>"


def _with_more(rows: dict[str, np.ndarray], more: pa.Array) -> tuple[dict[str, np.ndarray], list[str]]:
    """(rows with those of lists of VALIDATED, in order of products; the models' names by code)."""
    flat, sizes = more.flatten(), pc.fill_null(pc.list_value_length(more), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    names = [*CLOSED_FORM, *sorted(set(flat.field("model_name").unique().to_pylist()) - {*CLOSED_FORM})]
    if not len(flat):
        return rows, names
    num = lambda c: flat.field(c).cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64)
    there = lambda c: ~pc.is_null(flat.field(c)).to_numpy(zero_copy_only=False)
    new = {c: num(c) for c in ("cand_ord", "fold", "horizon_step", "date")} | {"product": np.repeat(np.arange(len(more)), sizes), "code": pc.index_in(flat.field("model_name"), pa.array(names)).to_numpy(zero_copy_only=False).astype(np.int64)}
    new |= {"actual": flat.field("actual").to_numpy(zero_copy_only=False), "known": there("actual"), "guess": flat.field("validation_prediction").to_numpy(zero_copy_only=False), "told": there("validation_prediction")}
    both = {c: np.concatenate([v, new[c]]) for c, v in rows.items()}
    order = np.argsort(both["product"], kind="stable")
    return {c: v[order] for c, v in both.items()}, names


def _judge(n: int, rows: dict[str, np.ndarray], names: list[str], every: bool | None) -> tuple[pa.Array, pa.Array]:
    """(lists of MODEL, lists of VALIDATED) of n products, the hybrid included; every: rows of all models, False: of the selected one, None: no rows."""
    product = rows["product"]
    keys, first, group = np.unique((product << 20) + (rows["cand_ord"] << 10) + rows["code"], return_index=True, return_inverse=True)
    own = _sums(group, len(keys), rows)
    whose, rank, code = (rows[c][first] for c in ("product", "cand_ord", "code"))
    with np.errstate(all="ignore"):
        level, fit = _halves_up(own["wmape"], 9), own["wmape"] > 0
        best = np.lexsort((rank, level, ~fit, whose))
        place = np.empty(len(keys), np.int64)
        place[best] = np.arange(len(keys)) - np.searchsorted(whose[best], whose[best])
        top = fit & (place < PARTS)
        parts = np.bincount(whose[top], minlength=n)
        top &= parts[whose] >= 2
        share = 1 / own["wmape"]
        weight = np.where(top, _halves_up(share / np.bincount(whose[top], weights=share[top], minlength=n)[whose] + 1e-9, 4), np.nan)
    # the hybrid's rows: those that all of its parts have
    at = np.flatnonzero(top[group])
    at = at[np.lexsort(tuple(rows[c][at] for c in ("date", "horizon_step", "fold", "product")))]
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = np.any([rows[c][at][1:] != rows[c][at][:-1] for c in ("product", "fold", "horizon_step", "date")], axis=0)
    line, head = new.cumsum() - 1, at[new]
    value = np.bincount(line, weights=(weight[group] * rows["guess"])[at], minlength=len(head))
    whole = np.bincount(line, minlength=len(head)) == parts[product[head]]
    head, value = head[whole], value[whole]
    mixed = np.unique(product[head])
    hybrid = {c: v[head] for c, v in rows.items()} | {"guess": value, "told": np.ones(len(head), bool), "code": np.full(len(head), len(names)), "cand_ord": np.full(len(head), HYBRID_ORDER)}
    joint = _sums(np.searchsorted(mixed, product[head]), len(mixed), hybrid)
    # the models of every product, the hybrid last
    add = lambda v, w: np.concatenate([v, np.full(len(mixed), w)])
    whose, rank, code, weight = np.concatenate([whose, mixed]), add(rank, HYBRID_ORDER), add(code, len(names)), add(weight, np.nan)
    told = {c: np.concatenate([own[c], joint[c]]) for c in FIGURES}
    last = lambda v: np.where(np.isnan(v), np.inf, _halves_up(v, 9))
    best = np.lexsort((rank, last(told["mae"]), last(np.abs(told["forecast_bias"])), last(told["wmape"]), whose))
    chosen = np.zeros(len(whose), bool)
    chosen[best[np.unique(whose[best], return_index=True)[1]]] = True
    chosen &= ~np.isnan(told["wmape"])
    called, order = pa.array([*names, HYBRID], pa.string()), np.lexsort((rank, whose))
    cols = [called.take(pa.array(code)), pa.array(rank.astype(np.int32)), *(pa.array(v.astype(np.int64)) if c.startswith("n_") else pa.array(v, from_pandas=True) for c, v in told.items()), pa.array(chosen), pa.array(weight, from_pandas=True)]
    models = pa.StructArray.from_arrays(cols, ["model_name", "cand_ord", *told, "selected", "weight"]).take(pa.array(order))
    offsets = pa.array(np.concatenate([[0], np.bincount(whose, minlength=n).cumsum()]).astype(np.int32))
    listed = pa.ListArray.from_arrays(offsets, models)
    if every is None:
        return listed, pa.nulls(n, pa.list_(pa.struct(ROW)))
    if not every:
        one = np.full(n, -1)
        one[whose[chosen]] = code[chosen]
        keep = lambda part: {c: v[part["code"] == one[part["product"]]] for c, v in part.items()}
        rows, hybrid = keep(rows), keep(hybrid)
    rows = {c: np.concatenate([v, hybrid[c]]) for c, v in rows.items()}
    order = np.argsort(rows["product"], kind="stable")
    return listed, validated_rows(n, {c: v[order] for c, v in rows.items()}, [*names, HYBRID])


def judged(held: DataFrame, g: Granularity = MONTHLY, mode: str = "balanced", horizon: int = VALIDATION_HORIZON, extra: DataFrame | None = None, every: bool | None = True, once: bool = False, ahead: int | None = None) -> DataFrame:
    """held (written series) as a row for each product, written: what forecasts and leaderboards read. Validation needs nothing but a product's own
    series, so that no row of it is ever shuffled. once: not written, for a caller that reads it a single time.

    (product, segment, last_date, mean, rows: the validation rows with the hybrid's (every=False: of the selected model only, None: NULL), models: the
    metrics of each model, with `selected` and the weight that it has in the hybrid, best: the selected model and its RMSE, parts: it, or the
    parts of the hybrid, with weights, whole: the history
    as an entry of prefixes). extra: rows of models that aren't closed forms. ahead: the steps of the forecast, the granularity's if it isn't told."""
    columns = ("model_name", "cand_ord", "fold", "horizon_step", "date", "actual", "validation_prediction")
    kinds = ("string", "int", "int", "int", "date", "double", "double")
    told = _asking(segmented(held, g.season), g, mode, horizon)
    if extra is not None:
        more = extra.groupBy("product").agg(F.collect_list(F.struct(*(F.col(c).cast(k).alias(c) for c, k in zip(columns, kinds, strict=True)))).alias("more"))
        told = told.join(more, "product", "left")
    else:
        told = told.withColumn("more", F.lit(None).cast(f"array<{VALIDATED}>"))
    season, average, ahead = g.season, g.average, ahead or g.horizon

    def judge(y: pa.Array, dates: pa.Array, cuts: pa.Array, asked: pa.Array, more: pa.Array) -> pa.Array:
        whole, rows = batch_tests(y, dates, cuts, asked, season, average, horizon, ahead)
        rows, names = _with_more(rows | {"told": np.ones(len(rows["guess"]), bool)}, more)
        return pa.StructArray.from_arrays([whole, *_judge(len(y), rows, names, every)], ["whole", "models", "rows"])

    # a filter on what it returns would run a deterministic function a second time
    judge_of = F.arrow_udf(judge, f"struct<whole:{PREFIX},models:array<{MODEL}>,rows:array<{VALIDATED}>>").asNondeterministic()
    told = told.withColumn("_j", judge_of("y", "dates", "cuts", "asked", "more")).select("product", "segment", "last_date", "mean", "_j.*")
    best = F.get(F.filter("models", lambda m: m["selected"]), F.lit(0))
    told = told.withColumn("best", best).withColumn("best", F.struct("best.model_name", "best.rmse"))
    single = F.array(F.struct(F.col("best.model_name").alias("model_name"), F.lit(1.0).alias("weight")))
    mixed = F.transform(F.filter("models", lambda m: m["weight"].isNotNull()), lambda m: F.struct(m["model_name"].alias("model_name"), m["weight"].alias("weight")))
    told = told.withColumn("parts", F.when(F.col("best.model_name") == HYBRID, mixed).when(F.col("best.model_name").isNotNull(), single))
    return told if once else materialized(told)


def product_metrics(validated: DataFrame) -> DataFrame:
    """A row for each product and model: metrics, n_folds."""
    return validated.groupBy("product", "model_name", "cand_ord").agg(*metric_columns(), _folds().alias("n_folds"))


def _folds() -> Column:
    """The count of distinct folds (numbers below 64) as the bits of one number: a distinct count would shuffle every row."""
    return F.bit_count(F.coalesce(F.bit_or(F.expr("shiftleft(1L, fold)")), F.lit(0))).cast("long")


def hybrid_weights(metrics: DataFrame) -> DataFrame:
    """(product, model_name, weight): of each product's up to three best models with a positive wMAPE, by inverse wMAPE, to four decimals (halves up); two at least."""
    best = Window.partitionBy("product").orderBy(F.round("wmape", 9), "cand_ord")
    top = metrics.where(F.col("wmape") > 0).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= PARTS)
    whole = Window.partitionBy("product")
    top = top.withColumn("_n", F.count("*").over(whole)).where("_n >= 2")
    return top.select("product", "model_name", F.round((1 / F.col("wmape")) / F.sum(1 / F.col("wmape")).over(whole) + 1e-9, 4).alias("weight"), F.col("_n").alias("n_components"))


def hybrid_validation(validated: DataFrame, weights: DataFrame) -> DataFrame:
    """The hybrid's validation rows, on the fold rows that all its components have."""
    met = validated.join(weights, ["product", "model_name"])
    out = met.groupBy("product", "fold", "horizon_step", "date").agg(F.first("actual").alias("actual"), F.sum(F.col("weight") * F.col("validation_prediction")).alias("validation_prediction"), F.count("*").alias("_c"), F.max("n_components").alias("_n"))
    return out.where("_c = _n").select("product", F.lit(HYBRID).alias("model_name"), F.lit(HYBRID_ORDER).alias("cand_ord"), "fold", "horizon_step", "date", "actual", "validation_prediction")


def selected(metrics: DataFrame) -> DataFrame:
    """metrics with `selected`: the product's model of least wMAPE, then bias, then MAE (to nine decimals), then candidate order."""
    order = Window.partitionBy("product").orderBy(F.round("wmape", 9).asc_nulls_last(), F.round(F.abs("forecast_bias"), 9).asc_nulls_last(), F.round("mae", 9).asc_nulls_last(), "cand_ord")
    return metrics.withColumn("selected", (F.row_number().over(order) == 1) & F.col("wmape").isNotNull())


#: The row for the model that is only announced.
LSTM = ("lstm", "future_extension", "announced only; there is no such model here")


def leaderboard(panel: DataFrame, g: Granularity = MONTHLY, mode: str = "balanced", horizon: int = VALIDATION_HORIZON, extra: DataFrame | None = None, advanced: Advanced | None = None) -> tuple[DataFrame, DataFrame]:
    """(leaderboard, validation rows, hybrid included, with `selected`: of the product's selected model), read from what judged() writes.

    Scope product: each candidate with its status and reason: ok, failed, skipped (nobody ran it) or
    insufficient_history. Scope ALL: errors pooled over products, the least wMAPE selected, and the row of a model only announced.
    extra, or advanced.rows: validation rows of models that aren't closed forms. seconds: of the whole validation of such a model."""
    advanced = advanced or Advanced(extra)
    return board_of(judged(materialized(series(panel)), g, mode, horizon, advanced.rows), mode, advanced)


def board_of(told: DataFrame, mode: str = "balanced", advanced: Advanced | None = None) -> tuple[DataFrame, DataFrame]:
    """leaderboard, of judged()."""
    advanced = advanced or Advanced()
    rows = told.select("product", F.col("best.model_name").alias("_best"), F.inline("rows")).withColumn("selected", F.coalesce(F.col("model_name") == F.col("_best"), F.lit(False))).drop("_best")
    models = told.select("product", F.inline("models"))
    metrics = models.select("product", "model_name", "cand_ord", *METRICS, "selected")
    rest = told.select("product", "segment", F.col("models.model_name").alias("_have")).join(F.broadcast(candidates(told.sparkSession, mode)), "segment")  # at most 22 rows
    rest = rest.where(~F.array_contains("_have", F.col("model_name")))
    beyond = [m for m in FITTED if m not in advanced.seconds]
    status, reason = F.lit("insufficient_history"), F.lit("the history is too short for a fold")
    for m in beyond:
        status, reason = F.when(F.col("model_name") == m, "skipped").otherwise(status), F.when(F.col("model_name") == m, "not run").otherwise(reason)
    for m, why in advanced.failures.items():
        status, reason = F.when(F.col("model_name") == m, "failed").otherwise(status), F.when(F.col("model_name") == m, why).otherwise(reason)
    blank = rest.select("product", "model_name", "cand_ord", status.alias("status"), reason.alias("reason"), F.lit(False).alias("selected"))
    product = metrics.withColumn("status", F.lit("ok")).unionByName(blank, allowMissingColumns=True).withColumn("scope", F.lit("product"))
    # models: a row for each product and model
    pooled = models.groupBy("model_name", "cand_ord").agg(*pooled_metrics(), F.bit_count(F.bit_or("n_bits")).cast("long").alias("n_folds"), F.count("product").alias("n_products"))
    pooled = selected(pooled.withColumn("product", F.lit("ALL"))).withColumn("status", F.lit("ok"))
    announced = told.sparkSession.createDataFrame([("ALL", *LSTM, False)], "product string, model_name string, status string, reason string, selected boolean")
    pooled = pooled.unionByName(announced, allowMissingColumns=True).withColumn("scope", F.lit("ALL"))
    seconds = F.lit(None).cast("double")
    for m, took in advanced.seconds.items():
        seconds = F.when(F.col("model_name") == m, F.lit(took)).otherwise(seconds)
    return product.unionByName(pooled, allowMissingColumns=True).withColumn("seconds", seconds), rows


def of_selected(board: DataFrame, rows: DataFrame) -> DataFrame:
    """The validation rows of every product's selected model."""
    if "selected" in rows.columns:
        return rows.where("selected")
    return rows.join(board.where("scope = 'product' AND selected").select("product", "model_name"), ["product", "model_name"])


def portfolio_metrics(board: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: the metrics over the validation rows of every product's selected model, and how many products and rows these are of."""
    best = of_selected(board, rows)
    if "selected" not in rows.columns:
        return best.agg(*metric_columns(), F.countDistinct("product").alias("n_products"))
    # the board has one selected row for each product, no distinct count is needed
    return best.agg(*metric_columns()).crossJoin(board.where("scope = 'product' AND selected").agg(F.count("*").alias("n_products")))  # one row each


def portfolio_of(told: DataFrame) -> DataFrame:
    """portfolio_metrics, of judged(): the sums of the selected models are added up, no validation row is read."""
    return told.select(F.inline("models")).where("selected").agg(*pooled_metrics(), F.count("*").alias("n_products"))

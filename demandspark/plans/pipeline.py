"""From an upload to forecasts and findings, in stages, with loud halts, a pause for review and resume."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import date_format_of, to_date, to_number
from ..operators import analysis, evaluate, external, features, forecast, insights, intake, models, quality, remediation, segments
from ..operators.panel import granularity, panel, with_period_features
from ..sources import memory
from ..sources.tables import dropped, materialized
from ..types import RunConfig


class Halt(Exception):
    """The run cannot go on; the message tells why."""


@dataclass
class Context:
    config: RunConfig
    raw: DataFrame
    status: str = "running"
    results: dict[str, Any] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    side_warnings: list[str] = field(default_factory=list)
    log: list[dict] = field(default_factory=list)


def _intake(x: Context) -> None:
    folder = x.config.extra.get("memory_path")
    known = memory.load(x.raw.sparkSession, folder) if folder else x.config.extra.get("memory")
    found = intake.run_intake(x.raw, known, x.config.extra.get("reviewer"))
    if x.config.mapping:
        found = intake.correct(found, {c: r for r, c in vars(x.config.mapping).items() if c})
    x.results |= {"intake": found} | intake.overviews(found)
    x.warnings += found.warnings
    missing = [r for r in ("date", "product", "qty") if getattr(found.mapping, r) is None]
    if missing:
        x.results["issues"] = quality.missing_columns(found.mapping)
        raise Halt(f"no column for {', '.join(missing)}")
    m = found.mapping
    rest = [c for c in x.raw.columns if c not in (m.date, m.product, m.qty)]
    x.results["names"] = {c: f"client_{c}" if c.lower() in ("date", "product", "qty", "y") else c for c in rest}
    x.results["meanings"] = {i["detected_meaning"]: x.results["names"][i["column"]] for i in found.inputs if i["confidence"] in ("high", "medium") and i["column"] in x.results["names"]}
    if folder:
        intake.confirm_mapping(found, folder, x.raw.sparkSession)


def _named(x: Context) -> DataFrame:
    """The upload under the engine's names, values as they are."""
    m = x.results["intake"].mapping
    return x.raw.select(F.col(f"`{m.product}`").cast("string").alias("product"), F.col(f"`{m.date}`").alias("date"), F.col(f"`{m.qty}`").alias("qty"), *(F.col(f"`{c}`").alias(n) for c, n in x.results["names"].items()))


def _typed(rows: DataFrame) -> DataFrame:
    """rows (written) with typed values; written again only if text has to be read."""
    kinds = dict(rows.dtypes)
    if kinds["qty"] != "double" or kinds["date"] == "string":
        return materialized(rows.withColumns({"date": to_date(rows, "date", date_format_of(rows, "date")), "qty": to_number(F.col("qty"))}))
    return rows.withColumns({"date": to_date(rows, "date", None), "qty": F.when(~F.isnan("qty"), F.col("qty"))})


def _quality(x: Context) -> None:
    g = granularity(x.config.granularity)
    named = materialized(_named(x))
    rows = _typed(named)
    meant = x.results["meanings"]
    counts = quality.invalid_counts(named, to_date(named, "date", date_format_of(named, "date")), to_number(F.col("qty")), F.col("date"), F.col("qty"), F.col("product")).first().asDict()
    facts = quality.product_facts(rows, g)
    found = quality.issues(rows, g, meant, counts, facts)
    past = intake.history_of(facts).first().asDict()
    dropped(facts)
    x.results |= {"named": named, "rows": rows, "issues": found, "readiness": quality.readiness(found, set(meant)), "plan": remediation.build_plan(found, named, g), "history": past}
    told = intake.readiness_report(x.results["intake"].mapping, x.results["intake"].inputs, past["n_products"], past["n_sufficient"], past["avg_zero_period_ratio"])
    x.results |= {"presence": {area: t["score"] for area, t in told.items()}, "presence_reasons": told}
    if not quality.ready_for_features(found):
        x.warnings.append("quality: the data is not fully ready for features; going on may fail there")


def _repair(x: Context) -> None:
    plan = x.results["plan"]
    approved = tuple(p["action"] for p in plan["review"]) if x.config.auto_approve_quality else x.config.approved
    rows, audit = remediation.execute_plan(x.results["named"], plan, approved, granularity(x.config.granularity), keep_extras=x.config.keep_extras)
    x.results |= {"rows": _typed(rows), "audit": audit}


def _external(x: Context) -> None:
    """The side tables of the data's own span: a frame that is given, or built from a folder of side files."""
    frame, folder = x.config.extra.get("external"), x.config.extra.get("external_folder")
    if frame is None and folder:
        span = x.results["rows"].agg(F.min("date").cast("date").cast("string").alias("a"), F.max("date").cast("date").cast("string").alias("b")).first()
        if span["a"]:
            frame, notes, missing = external.build_external(x.raw.sparkSession, span["a"], span["b"], folder, granularity(x.config.granularity), x.config.city, x.config.sector)
            x.side_warnings += notes + [f"{c}: no side file" for c in missing]
            x.warnings += x.side_warnings
    x.results["external"] = frame


def _features(x: Context) -> None:
    g = granularity(x.config.granularity)
    rows, names = x.results["rows"], x.results["names"]
    base = materialized(panel(rows, g))
    if base.isEmpty():
        raise Halt("no row has a product, a date and a quantity")
    ways = {k: [names[c] for c in v if names.get(c) in rows.columns] for k, v in intake.route([i for i in x.results["intake"].inputs if i["column"] in names]).items()}
    client = {c: m for m, c in x.results["meanings"].items() if c in ways["features"]} | {c: "" for c in ways["features"] if c not in x.results["meanings"].values()}
    full = with_period_features(base, rows, ways["features"], g)
    side = {}
    if x.results.get("external") is not None:
        full, notes = features.align_external(full, x.results["external"])
        x.side_warnings += notes
        x.warnings += notes
        told = external.get_registry()
        side = {c: told[c]["future_availability"] if c in told else features.FUTURE_DEFAULT for c in full.columns if c not in (*base.columns, *client)}
    heat = next((c for c, m in client.items() if m == "temperature"), None)
    if heat and "cooling_degree_days" not in full.columns:
        full = features.with_degree_days(full, heat)
    inputs = [c for c in full.columns if c not in base.columns and c not in features.CALENDAR]
    full = materialized(features.build_features(full.select(*base.columns, *inputs), g, x.config.sector))
    metadata = features.feature_metadata([c for c in full.columns if c not in ("product", "date", "y")], client, {c: f for c, f in side.items() if c in inputs})
    keep, fill, shut = features.partition_future(metadata)
    x.warnings += [f"{c}: left out of training, its later values are unknown" for c in shut] + [f"{c}: later values are the mean of their calendar month" for c in fill]
    audit = features.leakage_audit(full, g, metadata, ways["excluded"])
    if not all(a["passed"] for a in audit):
        raise Halt("leakage audit failed: " + "; ".join(a["check"] for a in audit if not a["passed"]))
    trained = [c for c in inputs if c in keep]
    x.results |= {"panel": base, "features": full, "routes": ways, "leakage_audit": audit, "metadata": metadata, "matrices": features.matrices(full), "tree_inputs": trained, "tree_fill": tuple(c for c in fill if c in trained), "relevance": features.ranked_relevance(full, inputs)}


def _forecasters(x: Context) -> dict:
    """model -> forecaster(panel, horizon) of the models beyond the closed forms that can run here."""
    g = granularity(x.config.granularity)
    if not x.config.advanced_models:
        return {}
    trees = {m: (lambda p, h, m=m: models.tree_forecast(p, m, g, h, x.results["tree_fill"], x.config.sector)) for m in ("random_forest", "xgboost")}
    return trees | {m: (lambda p, h, m=m: models.statistical_forecast(p, m, g, h)) for m in ("sarima", "prophet")} | x.config.extra.get("forecasters", {})


def _model(x: Context) -> None:
    g, mode = granularity(x.config.granularity), x.config.evaluation_mode
    base, horizon = x.results["panel"], x.config.horizon or g.horizon
    wide = x.results["features"].select("product", "date", "y", *(F.col(f"`{c}`").cast("double").alias(c) for c in x.results["tree_inputs"]))
    # a row for each product from here on: its series, the metrics of its models, the parts of its forecast
    held = materialized(models.series(base))
    known = materialized(segments.segmented(held.select("product", "n_points", "total_demand", "zero_ratio"), g.season))
    forecasters = _forecasters(x)
    advanced = evaluate.validate_advanced(wide, forecasters, g, mode, segments=known) if forecasters else evaluate.Advanced()
    told = evaluate.judged(held, g, mode, extra=advanced.rows, ahead=horizon)
    board, rows = evaluate.board_of(told, mode, advanced)
    board = materialized(board)
    others, notes = forecast.advanced_forecasts(wide, forecast.used_parts(told), forecasters, horizon)
    x.warnings += notes
    out = materialized(forecast.product_forecasts(None, None, g, horizon, others, forecast.used_of(told)))
    if out.isEmpty():
        raise Halt("no forecast was made")
    total = forecast.total_forecast(out)
    x.results |= {"leaderboard": board, "series": held, "validation": rows, "forecasts": out, "total": total, "direct_total": forecast.direct_total(base, g, mode, horizon), "segments": known, "chart_data": forecast.chart_data(base, rows, board, out), "cards": forecast.metric_cards(board, rows, None, held.select("product", "mean")), "summary": forecast.forecast_summary(board, rows, out, total)}


def _performance(x: Context) -> None:
    board, rows = x.results["leaderboard"], x.results["validation"]
    mine = evaluate.of_selected(board, rows).drop("selected")
    cards = [r.asDict() for r in x.results["cards"].collect()]  # a row for each metric
    told = analysis.performance(x.raw.sparkSession, mine, x.results["summary"].first().asDict(), cards)
    x.warnings += [w["text"] for w in told["warnings"]]
    x.results |= {"performance_result": told, "performance": told["per_period"], "performance_totals": told["totals"], "performance_summary": told["summary"]}


def _insights(x: Context) -> None:
    r = x.results
    r["insights"] = insights.generate(r["panel"], r["forecasts"], r["leaderboard"], r["segments"], r["issues"], x.config.extra.get("scenario"), r["summary"].first().asDict(), r.get("performance_summary"), x.side_warnings, r["series"])


#: (name, stage, whether the run goes on without it)
STAGES = [("intake", _intake, False), ("quality", _quality, False), ("repair", _repair, False), ("external", _external, True), ("features", _features, False), ("model", _model, False), ("performance", _performance, True), ("insights", _insights, True)]


def _run(x: Context, stages: list) -> Context:
    for name, stage, optional in stages:
        began = time.time()
        try:
            if name == "repair" and x.status == "running" and not x.config.auto_approve_quality and x.results["plan"]["review"]:
                x.status = "awaiting_quality_review"
                return x
            stage(x)
            x.log.append({"stage": name, "status": "ok", "seconds": time.time() - began})
        except Exception as e:  # noqa: BLE001  the log must tell which stage failed
            x.log.append({"stage": name, "status": "warning" if optional else "halted" if isinstance(e, Halt) else "error", "seconds": time.time() - began})
            if optional:
                x.warnings.append(f"{name}: {str(e)[:300]}")
                continue
            x.status = "halted" if isinstance(e, Halt) else "error"
            x.errors.append(f"{name}: {str(e)[:300]}")
            return x
    x.status = "ok"
    return x


def run_pipeline(df: DataFrame, config: RunConfig | None = None, stages: list | None = None) -> Context:
    """Runs all stages. Without automatic approval it pauses before repairs that need one; see resume."""
    x = Context(config or RunConfig(), df)
    try:
        granularity(x.config.granularity)
    except ValueError as e:
        x.status = "halted"
        x.errors.append(str(e))
        return x
    return _run(x, stages or STAGES)


def resume(x: Context, approved: tuple[str, ...] = (), stages: list | None = None) -> Context:
    """Goes on after the pause with the approved repairs; intake and quality aren't run again."""
    if x.status != "awaiting_quality_review":
        raise Halt(f"nothing to resume: the run is {x.status}")
    x.config.approved, x.status = approved, "resumed"
    names = [s[0] for s in stages or STAGES]
    return _run(x, (stages or STAGES)[names.index("repair") :])


def run_scenario(x: Context, asked: dict | None) -> dict[str, Any]:
    """What-if on a run: see analysis.simulate; the baseline stays as it is. A run without a forecast gives empty frames and a warning."""
    return analysis.simulate(x.raw.sparkSession, x.results.get("forecasts"), asked)

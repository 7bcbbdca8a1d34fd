"""Repairs: each takes rows (product, date, qty, extras) and gives rows; a plan applies approved ones and keeps an audit."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import date_format_of, to_date, to_number
from ..sources.tables import dropped, materialized, side_by_side
from ..types import MONTHLY, Granularity
from .panel import panel

#: What may run by itself, what needs approval, what never runs unasked.
POLICY = {
    "trim_whitespace": "auto", "remove_empty_rows": "auto", "standardize_date_format": "auto",
    "remove_exact_duplicates": "review", "aggregate_duplicate_product_date": "review", "insert_missing_periods": "review", "fill_missing_demand": "review", "remove_invalid_dates": "review", "remove_invalid_demand": "review", "standardize_product_identifiers": "review",
    "remove_negative_demand": "never",
}
ADVISORY = ("review_duplicates", "review_outliers", "collect_more_history", "review_intermittent", "review_inventory_values", "review_lead_times", "review_coverage", "review_negative_demand")


def trim_whitespace(df: DataFrame, g: Granularity = MONTHLY) -> DataFrame:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.trim(f"`{c}`") for c in texts}) if texts else df


def remove_empty_rows(df: DataFrame, g: Granularity = MONTHLY) -> DataFrame:
    return df.na.drop(how="all")


def standardize_date_format(df: DataFrame, g: Granularity = MONTHLY, rows: DataFrame | None = None) -> DataFrame:
    """rows: df itself, watched; the format is told from df."""
    return (df if rows is None else rows).withColumn("date", to_date(df, "date", date_format_of(df, "date")))


def remove_exact_duplicates(df: DataFrame, g: Granularity = MONTHLY, count: str | None = None) -> DataFrame:
    """Every row once. count: a column for how many of each are dropped."""
    if not count:
        return df.dropDuplicates()
    return df.groupBy(*(f"`{c}`" for c in df.columns)).agg((F.count("*") - 1).alias(count))


def fill_missing_demand(df: DataFrame, g: Granularity = MONTHLY) -> DataFrame:
    return df.withColumn("qty", F.coalesce(to_number(F.col("qty")), F.lit(0.0)))


def aggregate_duplicates(df: DataFrame, g: Granularity = MONTHLY, order: str | None = None, count: str | None = None) -> DataFrame:
    """One row for each product and date: qty summed, other columns their first value that isn't NULL (by `order`, else the smallest). count: a
    column for how many rows beyond the first each one stands for."""
    extras = [c for c in df.columns if c not in ("product", "date", "qty")]
    first = [(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order and c != order else F.min(c)).alias(c) for c in extras]
    more = [(F.count("*") - 1).alias(count)] if count else []
    out = df.where("product IS NOT NULL AND date IS NOT NULL").groupBy("product", "date").agg(F.coalesce(F.sum(to_number(F.col("qty"))), F.lit(0.0)).alias("qty"), *first, *more)
    return out.select(*df.columns, *([count] if count else []))


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key, NULLs alike, the one that comes first by `order` (its values are all different); one partial aggregate, no sort."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(order, *rest), order).alias("_first"))
    return first.select(*((F.col(f"`{c}`") if c in keys else F.col(f"_first.`{c}`")) for c in df.columns))


def insert_missing_periods(df: DataFrame, g: Granularity = MONTHLY, keep_extras: bool = False, count: str | None = None) -> DataFrame:
    """Demand per period without gaps (product, date, qty); with keep_extras other columns carry their smallest value of the period. count: a
    column that is 1 for the periods that weren't there."""
    extras = {c: F.min(c) for c in df.columns if c not in ("product", "date", "qty")} if keep_extras else {}
    if not count:
        return panel(df.withColumn("qty", to_number(F.col("qty"))), g, **extras).withColumnRenamed("y", "qty")
    out = panel(df.withColumn("qty", to_number(F.col("qty"))), g, **extras, **{count: F.lit(1)}).withColumnRenamed("y", "qty")
    return out.withColumn(count, F.when(F.col(count).isNull(), 1).otherwise(0))


def remove_invalid_dates(df: DataFrame, g: Granularity = MONTHLY, rows: DataFrame | None = None) -> DataFrame:
    """rows: df itself, watched; the format is told from df."""
    parsed = to_date(df, "date", date_format_of(df, "date"))
    return (df if rows is None else rows).where(~(parsed.isNull() & F.col("date").isNotNull()))


def remove_invalid_demand(df: DataFrame, g: Granularity = MONTHLY) -> DataFrame:
    return df.where(~(to_number(F.col("qty")).isNull() & F.col("qty").isNotNull()))


def standardize_products(df: DataFrame, g: Granularity = MONTHLY) -> DataFrame:
    return df.withColumn("product", F.trim("product"))


def remove_negative_demand(df: DataFrame, g: Granularity = MONTHLY) -> DataFrame:
    value = to_number(F.col("qty"))
    return df.where(value.isNull() | (value >= 0))


EXECUTORS = {
    "trim_whitespace": trim_whitespace, "remove_empty_rows": remove_empty_rows, "standardize_date_format": standardize_date_format, "remove_exact_duplicates": remove_exact_duplicates,
    "fill_missing_demand": fill_missing_demand, "aggregate_duplicate_product_date": aggregate_duplicates, "insert_missing_periods": insert_missing_periods, "remove_invalid_dates": remove_invalid_dates,
    "remove_invalid_demand": remove_invalid_demand, "standardize_product_identifiers": standardize_products, "remove_negative_demand": remove_negative_demand,
}


#: Repairs that count while they go over the rows, and those of them that look for the date format first.
DATED = ("standardize_date_format", "remove_invalid_dates")
REMOVES = ("remove_empty_rows", "remove_exact_duplicates", "remove_invalid_dates", "remove_invalid_demand", "remove_negative_demand", "aggregate_duplicate_product_date")


def _by_row(df: DataFrame, actions: list[str]) -> dict[str, Column]:
    """For the actions that go row by row: how much each would do to a row."""
    hit = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    raw, texts = F.col("qty"), [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    value = to_number(raw)
    parsed = to_date(df, "date", date_format_of(df, "date")) if "remove_invalid_dates" in actions else F.lit(None)
    empty = F.lit(True)
    for c in df.columns:
        empty = empty & F.col(f"`{c}`").isNull()
    trims = sum((hit(F.col(f"`{c}`") != F.trim(F.col(f"`{c}`"))) for c in texts), F.lit(0))
    counted = {
        "trim_whitespace": trims, "remove_empty_rows": hit(empty), "standardize_date_format": F.lit(int(dict(df.dtypes)["date"] == "string")), "fill_missing_demand": hit(value.isNull()),
        "remove_invalid_dates": hit(parsed.isNull() & F.col("date").isNotNull()), "remove_invalid_demand": hit(value.isNull() & raw.isNotNull()), "remove_negative_demand": hit(value < 0), "standardize_product_identifiers": hit(F.col("product").cast("string") != F.trim(F.col("product").cast("string"))),
    }
    return {a: c for a, c in counted.items() if a in actions}


def _told(action: str, k: int) -> dict[str, int]:
    removed, created = action in REMOVES, action == "insert_missing_periods"
    return {"rows_affected": k, "records_removed": k if removed else 0, "values_modified": 0 if removed or created or action not in POLICY else k, "new_periods_created": k if created else 0}


def impact(df: DataFrame, actions: list[str], issues: list = (), g: Granularity = MONTHLY) -> dict[str, dict[str, int]]:
    """action -> rows_affected, records_removed, values_modified, new_periods_created: what each would do to these rows. One aggregate for all
    that are counted by row; duplicates and missing periods each take one of their own."""
    from . import quality

    counted = _by_row(df, actions)
    dated = lambda: df.select("product", to_date(df, "date", date_format_of(df, "date")).alias("date"))
    whole = lambda rows: rows.where("product IS NOT NULL AND date IS NOT NULL").groupBy("product", "date").agg(F.count("*").alias("n"))
    alone = {
        "remove_exact_duplicates": lambda: quality.exact_duplicates(df).first()["duplicate_rows"],
        "insert_missing_periods": lambda: quality.missing_periods(dated(), g).agg(F.coalesce(F.sum("missing_periods"), F.lit(0))).first()[0],
        "aggregate_duplicate_product_date": lambda: whole(dated()).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0],
    }
    asked = [a for a in actions if a in alone and a not in counted]
    found, *ks = side_by_side(df.sparkSession, [lambda: df.agg(F.lit(0).alias("_"), *(F.coalesce(F.sum(c), F.lit(0)).alias(a) for a, c in counted.items())).first().asDict(), *(alone[a] for a in asked)])
    found |= dict(zip(asked, ks, strict=True))
    advised = lambda a: sum(i.affected_records for i in issues if i.recommended_action == a)
    return {a: _told(a, int(found[a] if a in found else advised(a))) for a in actions}


def apply_counted(df: DataFrame, action: str, g: Granularity = MONTHLY, keep_extras: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """(the repaired rows, written; what was done to them), in one pass: the repair is counted by an observation on its own write.

    The observation stands in the stage that writes: row by row before a row is changed or removed, or behind the shuffle on what each kept
    row stands for. There a task that is run again after a lost executor isn't counted twice."""
    seen = Observation()
    by_row = _by_row(df, [action])
    if by_row:
        watched = df.observe(seen, F.coalesce(F.sum(by_row[action]), F.lit(0)).alias("k"))
        new = EXECUTORS[action](df, g, rows=watched) if action in DATED else EXECUTORS[action](watched, g)
    else:
        count = "_beyond"
        while count in df.columns:
            count = "_" + count
        more = {"keep_extras": keep_extras} if action == "insert_missing_periods" else {}
        new = EXECUTORS[action](df, g, count=count, **more)
        new = new.observe(seen, F.coalesce(F.sum(count), F.lit(0)).alias("k")).drop(count)
    out = materialized(new)
    return out, _told(action, int(seen.get["k"]))


def build_plan(issues: list, df: DataFrame | None = None, g: Granularity = MONTHLY) -> dict[str, list[dict]]:
    """auto, review and advisory items, one for each action: hygiene first, then in the issues' order. With the rows given, every item tells
    what it would do (see impact), and hygiene that would do nothing is left out."""
    plan: dict[str, list[dict]] = {"auto": [{"action": a, "issue_type": "hygiene", "affected_records": None} for a, p in POLICY.items() if p == "auto"], "review": [], "advisory": []}
    seen = {x["action"] for x in plan["auto"]}
    for i in issues:
        if i.recommended_action in seen:
            continue
        seen.add(i.recommended_action)
        bucket = {"auto": "auto", "review": "review"}.get(POLICY.get(i.recommended_action), "advisory")
        plan[bucket].append({"action": i.recommended_action, "issue_type": i.issue_type, "affected_records": i.affected_records, "confidence": i.confidence})
    if df is not None:
        told = impact(df, [x["action"] for items in plan.values() for x in items], issues, g)
        plan = {k: [x | {"impact": told[x["action"]]} for x in items] for k, items in plan.items()}
        plan["auto"] = [x for x in plan["auto"] if x["impact"]["rows_affected"] or x["action"] == "standardize_date_format"]
    return plan


AUDIT = "status string, action string, records_affected long, records_removed long, values_modified long, new_periods_created long, timestamp timestamp, detail string"


def execute_plan(df: DataFrame, plan: dict[str, list[dict]], approved: tuple[str, ...], g: Granularity = MONTHLY, override: tuple[str, ...] = (), keep_extras: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, audit frame): automatic items, then approved ones; the rest are listed as not applied, a failing one as failed.

    Each step reads the written rows of the one before and writes its own, in one pass; the audit holds what was counted in it. remove_negative_demand runs by override only, and is marked."""
    log, now = [], datetime.datetime.now
    asked = [(x["action"], "auto") for x in plan["auto"]] + [(x["action"], "review") for x in plan["review"]] + [(a, "override") for a in override if POLICY.get(a) == "never"]
    none, mine = (0, 0, 0, 0), None
    for action, bucket in asked:
        if bucket == "review" and action not in approved or POLICY.get(action) == "never" and bucket != "override":
            log.append(("not_applied", action, *none, now(), "not approved"))
            continue
        try:
            new, told = apply_counted(df, action, g, keep_extras)
        except Exception as e:  # noqa: BLE001  one failing repair must not lose the others
            log.append(("failed", action, *none, now(), str(e)[:200]))
            continue
        log.append(("applied", action, *told.values(), now(), "manual override" if bucket == "override" else ""))
        if mine is not None:
            dropped(mine)
        df = mine = new
    log += [("not_applied", x["action"], *none, now(), "advisory") for x in plan["advisory"]]
    return df, df.sparkSession.createDataFrame(log, AUDIT)

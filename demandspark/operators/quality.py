"""Data-quality checks on (product, date, qty) rows: each gives its evidence as a small DataFrame; `issues` turns it into records."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import normalized
from ..sources.tables import dropped, materialized, side_by_side
from ..types import MONTHLY, Granularity
from .panel import panel as build_panel
from .panel import period_of
from .quantiles import exact_quantile, grouped_quantile, medians

PERIOD_DAYS = {"monthly": 30, "weekly": 7}
#: The category of each kind of issue.
CATEGORY = {
    "missing_date_column": "structural", "missing_product_column": "structural", "missing_qty_column": "structural", "invalid_dates": "structural", "invalid_demand_values": "structural", "invalid_product_identifiers": "structural", "empty_rows": "structural", "exact_duplicate_rows": "structural",
    "insufficient_history": "time_series", "missing_periods": "time_series", "intermittent_demand": "time_series", "large_temporal_gaps": "time_series", "irregular_frequency": "time_series", "multiple_records_same_product_period": "time_series",
    "negative_demand": "business", "unusual_demand_observations": "business", "suspicious_constant_demand": "business", "unusual_inventory_values": "business", "unusual_lead_times": "business", "inconsistent_product_identifiers": "business",
    "product_coverage_imbalance": "representation", "region_imbalance": "representation", "customer_imbalance": "representation", "seasonal_coverage_gap": "representation", "recent_history_gap": "representation",
}
#: The categories that count for forecasts, the kinds that count for inventory, and the meanings that either area asks for.
FORECAST_CATEGORIES = ("structural", "time_series", "representation")
INVENTORY_ISSUES = ("unusual_inventory_values", "unusual_lead_times", "negative_demand")
INVENTORY_MEANINGS = ("stock_on_hand", "available_inventory", "lead_time", "safety_stock")
DRIVER_MEANINGS = ("price", "promotion", "discount")
SEVERITY = {"critical": 0, "warning": 1, "info": 2}


@dataclass
class Issue:
    issue_type: str
    severity: str
    confidence: float
    affected_records: int
    recommended_action: str
    detail: str = ""
    affected_products: list = field(default_factory=list)

    @property
    def category(self) -> str:
        return CATEGORY[self.issue_type]

    def record(self) -> dict:
        return asdict(self) | {"category": self.category}


def invalid_counts(raw: DataFrame, date: Column, qty: Column, date_raw: Column, qty_raw: Column, product: Column) -> DataFrame:
    """One row: unreadable and missing dates, unusable and negative quantities, missing products, empty and all rows: one job."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    empty = F.lit(True)
    for c in raw.columns:
        empty = empty & F.col(f"`{c}`").isNull()
    return raw.agg(
        F.count("*").alias("n_rows"),
        n(date.isNull() & date_raw.isNotNull()).alias("invalid_dates"),
        n(date_raw.isNull()).alias("null_dates"),
        n(qty.isNull() & qty_raw.isNotNull()).alias("non_numeric_qty"),
        n(qty.isNull()).alias("invalid_demand"),
        n(qty < 0).alias("negative_demand"),
        n(product.isNull() | (F.trim(product.cast("string")) == "")).alias("invalid_products"),
        n(empty).alias("empty_rows"),
    )


def exact_duplicates(raw: DataFrame) -> DataFrame:
    """One row: n_rows, duplicate_rows (rows beyond the first of equal ones). Grouped by a digest of the row, so that wide rows don't travel."""
    key = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in raw.columns]), F.sha1(F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns])))
    groups = raw.select(key[0].alias("a"), key[1].alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def product_period_multiplicity(rows: DataFrame, g: Granularity = MONTHLY) -> DataFrame:
    """One row: groups of several records for a product and period, their extra rows, and the share whose quantities differ."""
    groups = rows.where("product IS NOT NULL AND date IS NOT NULL").groupBy("product", period_of(F.col("date"), g).alias("period")).agg(F.count("*").alias("n"), F.coalesce(F.min("qty") != F.max("qty"), F.lit(False)).alias("d"))
    several = groups.where("n > 1")
    return several.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"), F.avg(F.col("d").cast("double")).alias("share_differing"))


def missing_periods(rows: DataFrame, g: Granularity = MONTHLY) -> DataFrame:
    """(product, n_periods, missing_periods) of products with two periods or more: periods without a row between the first and last."""
    seen = rows.where("product IS NOT NULL AND date IS NOT NULL").select("product", period_of(F.col("date"), g).alias("p")).distinct()
    span = F.months_between(F.max("p"), F.min("p")).cast("int") if g.name == "monthly" else (F.datediff(F.max("p"), F.min("p")) / 7).cast("int")
    per = seen.groupBy("product").agg((span + 1).alias("n_periods"), F.count("*").alias("_seen"))
    return per.where("n_periods >= 2").select("product", "n_periods", (F.col("n_periods") - F.col("_seen")).cast("int").alias("missing_periods"))


#: Fixed value: of a calendar month's years, the share without demand from which its zeros are seasonal.
SEASONAL_SHARE = 0.7


def zero_classification(panel: DataFrame, share: float = SEASONAL_SHARE) -> DataFrame:
    """panel with `zero_kind`: seasonal if the product's calendar month is all zero in at least 70 % of its years, else structural; unclassified
    below two observed years; NULL where demand isn't zero."""
    known = panel.where("product IS NOT NULL AND date IS NOT NULL").withColumns({"_m": F.month("date"), "_yr": F.year("date")})
    # one order of a product's rows, by month, year and date, serves all three windows; the widest comes first
    mine = Window.partitionBy("product").orderBy("_m", "_yr", "date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    year = Window.partitionBy("product", "_m", "_yr").orderBy("date")
    met = known.withColumn("_years", F.size(F.collect_set("_yr").over(mine)))
    met = met.withColumns({"_zero": F.bool_and(F.col("y") == 0).over(year.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_at": F.row_number().over(year)})
    met = met.withColumn("_share", F.avg(F.when(F.col("_at") == 1, F.col("_zero").cast("double"))).over(Window.partitionBy("product", "_m")))
    kind = F.when(F.col("y") != 0, F.lit(None)).when(F.col("_years") < 2, "unclassified").when(F.col("_share") >= share, "seasonal").otherwise("structural")
    return met.select(*panel.columns, kind.alias("zero_kind"))


def intermittent(classified: DataFrame) -> DataFrame:
    """(product, n_points, structural_ratio, intermittent): structural (or unclassified) zeros over 30 % of six periods or more."""
    per = classified.groupBy("product").agg(F.count("*").alias("n_points"), F.avg(F.coalesce(F.col("zero_kind").isin("structural", "unclassified"), F.lit(False)).cast("double")).alias("structural_ratio"))
    return per.withColumn("intermittent", (F.col("structural_ratio") > 0.30) & (F.col("n_points") >= 6))


def with_zero_run(panel: DataFrame) -> DataFrame:
    """panel with `_run`: how many periods up to a row have had no demand; 0 where there is some, or no value."""
    w = Window.partitionBy("product").orderBy("date")
    zero = F.coalesce(F.col("y") == 0, F.lit(False))
    numbered = panel.withColumn("_rn", F.row_number().over(w))
    before = F.coalesce(F.max(F.when(~zero, F.col("_rn"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return numbered.withColumn("_run", F.col("_rn") - before).drop("_rn")


def longest_zero_run(panel: DataFrame) -> DataFrame:
    """(product, longest_run)."""
    return with_zero_run(panel).groupBy("product").agg(F.max("_run").cast("long").alias("longest_run"))


def _histories(demand: pa.Array) -> pa.Array:
    """product_history of a batch of products, of their lists of (date, y)."""
    sizes, flat = pc.list_value_length(demand).to_numpy(zero_copy_only=False).astype(np.int64), demand.flatten()
    n, product = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    day, values = flat.field("date").cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64), flat.field("y")
    order = np.lexsort((day, product))
    month = day[order].astype("datetime64[D]").astype("datetime64[M]").astype(np.int64)
    y, known = values.to_numpy(zero_copy_only=False)[order], ~pc.is_null(values).to_numpy(zero_copy_only=False)[order]
    other, zero = known & (y != 0), known & (y == 0)
    starts = sizes.cumsum() - sizes
    new = lambda v: np.concatenate([[True], (v[1:] != v[:-1]) | (product[1:] != product[:-1])]) if len(v) else np.zeros(0, bool)
    years = np.bincount(product[new(month // 12)], minlength=n)
    # a month of a year is zero if all that is known of it is; of a calendar month the share of such years
    first = new(month)
    of, whose = first.cumsum() - 1, product[first] * 12 + month[first] % 12
    some, more = np.bincount(of, weights=known, minlength=first.sum()) > 0, np.bincount(of, weights=other, minlength=first.sum()) > 0
    with np.errstate(all="ignore"):
        share = np.bincount(whose[some], weights=~more[some], minlength=12 * n) / np.bincount(whose[some], minlength=12 * n)
    seasonal = share[product * 12 + month % 12] >= SEASONAL_SHARE
    young = years[product] < 2
    count = lambda where: pa.array(np.bincount(product[where], minlength=n).astype(np.int64))
    at = np.arange(len(y))
    before = np.maximum(np.maximum.accumulate(np.where(zero, -1, at)), starts[product] - 1)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, product, at - before)
    return pa.StructArray.from_arrays([pa.array(sizes), count(~other & (young | ~seasonal)), count(~other & young), pa.array(longest), count(zero)], ["n_points", "structural", "unclassified", "longest_run", "zeros"])


def product_history(panel: DataFrame) -> DataFrame:
    """(product, n_points, structural, unclassified, longest_run, zeros): periods of each product, its zeros that no season explains, those of them that
    are unclassified, its longest run of zeros, and all zeros, as zero_classification and longest_zero_run tell them. A product is one row from the panel on."""
    pair = F.struct(F.col("date").cast("date").alias("date"), F.col("y").cast("double").alias("y"))
    per = panel.where("product IS NOT NULL AND date IS NOT NULL").groupBy("product").agg(F.collect_list(pair).alias("_d"))
    told = F.arrow_udf(_histories, "struct<n_points:bigint,structural:bigint,unclassified:bigint,longest_run:bigint,zeros:bigint>")("_d")
    return per.select("product", told.alias("_h")).select("product", "_h.*")


def mad_outliers(rows: DataFrame, by: str = "product", value: str = "qty", factor: float = 5.0, least: int = 8) -> DataFrame:
    """(by, n, outliers): values further than 5 median absolute deviations from the group's median. Works on counts of distinct values."""
    per, middle = medians(rows, by, value)
    apart = materialized(per.join(middle.where(F.col("n") >= least), by).withColumn("_dev", F.abs(F.col(value) - F.col("median"))))
    spread = grouped_quantile(apart, by, "_dev", 0.5, "_mad").where("_mad > 0").drop("n")
    return apart.join(spread, by).groupBy(by).agg(F.sum("w").alias("n"), F.coalesce(F.sum(F.when(F.col("_dev") > factor * F.col("_mad"), F.col("w"))), F.lit(0)).alias("outliers"))


def negative_values(rows: DataFrame, column: str) -> DataFrame:
    """One row: values of a column that are below 0, and all that are numbers."""
    v = F.col(f"`{column}`").try_cast("double")
    return rows.agg(F.count_if(F.coalesce(v < 0, F.lit(False))).alias("n_negative"), F.count(v).alias("n_values"))


def lead_time_figures(rows: DataFrame, column: str, factor: float = 5.0, least: int = 8) -> DataFrame:
    """One row: values that are 0 or less, and values further than 5 median absolute deviations from the column's median (0 if that deviation is
    0, or of fewer than eight values). The medians of the whole column are found without gathering it."""
    v = rows.select(F.col(f"`{column}`").try_cast("double").alias("v")).where("v IS NOT NULL")
    apart = v.crossJoin(F.broadcast(exact_quantile(v, "v", 0.5, "median"))).withColumn("dev", F.abs(F.col("v") - F.col("median")))  # one row
    far = apart.crossJoin(F.broadcast(exact_quantile(apart, "dev", 0.5, "mad")))  # one row
    counts = far.agg(F.count("*").alias("n"), F.count_if(F.col("v") <= 0).alias("n_not_positive"), F.count_if((F.col("mad") > 0) & (F.col("dev") > factor * F.col("mad"))).alias("_far"))
    return counts.select("n_not_positive", F.when(F.col("n") >= least, F.col("_far")).otherwise(0).alias("outliers"))


def constant_demand(rows: DataFrame) -> DataFrame:
    """One row: non-zero quantities, and the share of the commonest."""
    per = rows.where("qty IS NOT NULL AND qty != 0").groupBy("qty").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), (F.max("n") / F.sum("n")).alias("top_share"))


def identifier_variants(rows: DataFrame, column: str = "product") -> DataFrame:
    """(key, n_spellings): products that differ in case or outer blanks only."""
    c = F.col(column).cast("string")
    spelled = rows.where(F.col(column).isNotNull()).select(F.lower(F.trim(c)).alias("key"), c.alias("raw")).distinct()
    return spelled.groupBy("key").agg(F.count("*").alias("n_spellings")).where("n_spellings > 1")


def dominance(rows: DataFrame, column: str) -> DataFrame:
    """One row: groups of `column`, and the largest one's share of demand (negative demand counts as 0)."""
    per = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum(F.greatest("qty", F.lit(0.0))).alias("t"))
    return per.agg(F.count("*").alias("n_groups"), F.sum("t").alias("total"), F.try_divide(F.max("t"), F.sum("t")).alias("top_share"))


def seasonal_coverage(rows: DataFrame) -> DataFrame:
    """One row: span in days, observed calendar months, months never observed."""
    months = rows.where("date IS NOT NULL").agg(F.datediff(F.max("date"), F.min("date")).alias("span_days"), F.sort_array(F.collect_set(F.month("date"))).alias("months"))
    return months.select("span_days", F.size("months").alias("n_months"), F.array_join(F.array_except(F.sequence(F.lit(1), F.lit(12)), "months"), ",").alias("missing_months"))


def stale_products(rows: DataFrame, g: Granularity = MONTHLY) -> DataFrame:
    """(product, days_behind): products whose last date is over three periods before the data's last."""
    per = rows.where("product IS NOT NULL AND date IS NOT NULL").groupBy("product").agg(F.max("date").alias("_last"))
    newest = per.agg(F.max("_last").alias("_newest"))
    behind = per.crossJoin(F.broadcast(newest)).select("product", F.datediff("_newest", "_last").alias("days_behind"))  # one row
    return behind.where(F.col("days_behind") > 3 * PERIOD_DAYS[g.name])


def median_gap(rows: DataFrame) -> DataFrame:
    """One row: distinct dates, the median gap in days between them, and over all rows (equal dates are gaps of 0).

    Counts per date come first, so that the ordered window sees a row for each date only."""
    per = rows.where("date IS NOT NULL").groupBy(F.to_date("date").alias("d")).agg(F.count("*").alias("n"))
    gaps = per.withColumn("gap", F.datediff("d", F.lag("d").over(Window.orderBy("d"))))
    spread = gaps.select("gap", F.lit(1).cast("long").alias("w"), F.lit(True).alias("first")).union(gaps.select(F.lit(0), F.col("n") - 1, F.lit(False)))
    all_rows = spread.where("gap IS NOT NULL AND w > 0")
    return all_rows.agg((F.count_if("first") + 1).alias("n_dates"), F.percentile(F.when(F.col("first"), F.col("gap")), F.lit(0.5)).alias("median_gap"), F.percentile(F.col("gap"), F.lit(0.5), F.col("w")).alias("median_gap_rows"))


def insufficient_history(panel: DataFrame, least: int = 12) -> DataFrame:
    return panel.groupBy("product").agg(F.count("*").alias("n_points")).where(F.col("n_points") < least)


def product_facts(rows: DataFrame, g: Granularity = MONTHLY) -> DataFrame:
    """What all checks of products ask for, a row for each product, written: product_history (NULL without a dated row), seen and n_periods (periods with
    rows, and from the first to the last of them), points (distinct dates), last (date), demand (negative quantities count as 0), several, extra and
    differing (periods of several records, their records beyond the first, and those of these periods whose quantities differ).

    The rows are summed up by product and date, then by period, once for all of them, and the panel is built from these sums."""
    days = rows.where("product IS NOT NULL").groupBy("product", "date").agg(F.count("*").alias("n"), F.min("qty").alias("low"), F.max("qty").alias("high"), F.sum("qty").alias("qty"), F.sum(F.greatest("qty", F.lit(0.0))).alias("demand"))
    sums = [F.sum("n").alias("n"), F.count("date").alias("days"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("qty").alias("qty"), F.sum("demand").alias("demand"), F.max("date").alias("last")]
    periods = materialized(days.groupBy("product", period_of(F.col("date"), g).alias("period")).agg(*sums))
    known = F.col("period").isNotNull()
    several = known & (F.col("n") > 1)
    span = F.months_between(F.max("period"), F.min("period")).cast("int") if g.name == "monthly" else (F.datediff(F.max("period"), F.min("period")) / 7).cast("int")
    told = periods.groupBy("product").agg(
        F.count("period").alias("seen"), (span + 1).alias("n_periods"), F.sum("days").alias("points"), F.max("last").alias("last"), F.sum("demand").alias("demand"),
        F.count_if(several).alias("several"), F.coalesce(F.sum(F.when(several, F.col("n") - 1)), F.lit(0)).alias("extra"), F.count_if(several & F.coalesce(F.col("low") != F.col("high"), F.lit(False))).alias("differing"),
    )
    history = product_history(build_panel(periods.where(known).select("product", F.col("period").alias("date"), "qty"), g))
    facts = materialized(told.join(history, "product", "left"))
    dropped(periods)
    return facts


def missing_columns(mapping) -> list[Issue]:
    """A critical issue for each of date, product and quantity that no column holds."""
    return [Issue(f"missing_{r}_column", "critical", 1.0, 0, "review_coverage") for r in ("date", "product", "qty") if getattr(mapping, r) is None]


def identifier_columns(rows: DataFrame, least: float = 0.95) -> list[str]:
    """The columns beside product, date and qty whose values are nearly all different: over 95 % distinct among those that are there."""
    extra = [c for c in rows.columns if c not in ("product", "date", "qty")]
    if not extra:
        return []
    # every cell once as (column, digest of its value), summed up before the shuffle; 64 bits tell values apart
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.lit(1), F.col(f"`{c}`"))).alias("v")) for i, c in enumerate(extra)))
    counts = rows.select(F.inline(cells)).where("v IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("w"))
    shares = counts.groupBy("i").agg((F.count("*") / F.sum("w")).alias("share")).where(F.col("share") > least)  # a row for each column
    found = {r["i"] for r in shares.collect()}
    return [c for i, c in enumerate(extra) if i in found]


def issues(rows: DataFrame, g: Granularity = MONTHLY, segments: dict[str, str] | None = None, counts: dict | None = None, facts: DataFrame | None = None) -> list[Issue]:
    """Issue records of clean-typed rows (product, date, qty, extras). counts: the row of invalid_counts, if it was taken on the raw rows. facts:
    product_facts of the rows, if there are any.

    segments: meaning -> column (region, customer). Products are listed up to 20."""
    out: list[Issue] = []
    add = lambda *a, **k: out.append(Issue(*a, **k))
    names = lambda df, k=20: [r["product"] for r in df.select("product").limit(k).collect()]
    if counts:
        n = counts["n_rows"]
        if counts["invalid_dates"]:
            add("invalid_dates", "critical" if counts["invalid_dates"] + counts["null_dates"] == n else "warning", 0.95, counts["invalid_dates"], "remove_invalid_dates")
        if counts["invalid_demand"]:
            add("invalid_demand_values", "critical" if counts["invalid_demand"] == n else "warning", 0.9, counts["invalid_demand"], "remove_invalid_demand")
        if counts["invalid_products"]:
            add("invalid_product_identifiers", "warning", 0.9, counts["invalid_products"], "review_coverage")
        if counts["empty_rows"]:
            add("empty_rows", "info", 1.0, counts["empty_rows"], "remove_empty_rows")
        if counts["negative_demand"]:
            add("negative_demand", "warning", 0.5, counts["negative_demand"], "review_negative_demand")
    meant = segments or {}
    shares = [("product_coverage", "product", 0.60, 3, 0.8), *((k, c, 0.80, 3, 0.7) for k, c in meant.items() if k in ("region", "customer"))]
    stock = [c for m in ("stock_on_hand", "available_inventory") if (c := meant.get(m))]
    sum_of = lambda df, c: df.agg(F.sum(c)).first()[0]

    def duplicates() -> tuple:
        dup = exact_duplicates(rows).first()
        return dup, identifier_columns(rows) if dup["duplicate_rows"] else []

    def products() -> dict:
        per = product_facts(rows, g) if facts is None else facts
        short, rare, runs = F.col("n_points") < 12, (F.col("structural") / F.col("n_points") > 0.30) & (F.col("n_points") >= 6), (F.col("longest_run") >= 4) & (F.col("structural") >= 4)
        lost = F.when(F.col("n_periods") >= 2, F.col("n_periods") - F.col("seen"))
        newest = per.agg(F.max("last").alias("_newest"))
        per_ = per.crossJoin(F.broadcast(newest))  # one row
        old = F.datediff("_newest", "last") > 3 * PERIOD_DAYS[g.name]
        n = per_.agg(
            F.count_if(short).alias("short"), F.min(F.when(short, F.col("n_points"))).alias("least"), F.count_if(rare).alias("rare"), F.count_if(F.col("unclassified") > 0).alias("unsure"), F.count_if(runs).alias("runs"), F.sum(lost).alias("lost"), F.count_if(old).alias("old"),
            F.sum("several").alias("several"), F.sum("extra").alias("extra"), F.sum("differing").alias("differing"), F.count("*").alias("n_groups"), F.try_divide(F.max("demand"), F.sum("demand")).alias("top_share"),
        ).first().asDict()
        listed = {k: names(per_.where(c)) if n[k] else [] for k, c in {"short": short, "rare": rare, "runs": runs, "lost": lost > 0, "old": old}.items()}
        n["spellings"] = sum_of(identifier_variants(per), "n_spellings")
        if facts is None:
            dropped(per)
        return n | {"listed": listed}

    # the checks don't wait for each other; each holds what one of them holds alone
    jobs = {
        "products": products, "duplicates": duplicates, "outliers": lambda: sum_of(mad_outliers(rows), "outliers"),
        "gap": lambda: median_gap(rows).first(), "same": lambda: constant_demand(rows).first(), "cover": lambda: seasonal_coverage(rows).first(),
        **{("share", c): lambda c=c: dominance(rows, c).first().asDict() for _, c, *_ in shares[1:]}, **{("negative", c): lambda c=c: negative_values(rows, c).first()["n_negative"] for c in stock},
        **({"lead": lambda: lead_time_figures(rows, meant["lead_time"]).first()} if meant.get("lead_time") else {}),
    }
    told = dict(zip(jobs, side_by_side(rows.sparkSession, list(jobs.values())), strict=True))
    dup, ids = told["duplicates"]
    if dup["duplicate_rows"]:
        if ids:  # an identifier that repeats with its row is no second sale
            add("exact_duplicate_rows", "warning", 0.85, dup["duplicate_rows"], "remove_exact_duplicates", ids[0])
        elif dup["duplicate_rows"] / dup["n_rows"] < 0.02:
            add("exact_duplicate_rows", "info", 0.6, dup["duplicate_rows"], "remove_exact_duplicates")
        else:
            add("exact_duplicate_rows", "warning", 0.4, dup["duplicate_rows"], "review_duplicates")
    n = told["products"]
    listed = n["listed"]
    if n["short"]:
        add("insufficient_history", "warning" if n["least"] < 6 else "info", 0.9, n["short"], "collect_more_history", affected_products=listed["short"])
    if n["lost"]:
        add("missing_periods", "warning", 0.7, n["lost"], "insert_missing_periods", affected_products=listed["lost"])
    if n["several"]:
        differ = n["differing"] / n["several"] >= 0.5
        add("multiple_records_same_product_period", "info" if differ else "warning", 0.85 if differ else 0.5, n["extra"], "aggregate_duplicate_product_date" if differ else "review_duplicates")
    if n["rare"]:
        add("intermittent_demand", "info", 0.4 if n["unsure"] else 0.8, n["rare"], "review_intermittent", affected_products=listed["rare"])
    if n["runs"]:
        add("large_temporal_gaps", "warning", 0.6, n["runs"], "review_coverage", affected_products=listed["runs"])
    gap = told["gap"]
    if gap["n_dates"] >= 10 and (gap["median_gap_rows"] or 0) > 3 * PERIOD_DAYS[g.name]:
        add("irregular_frequency", "warning", 0.6, gap["n_dates"], "review_coverage")
    if m := told["outliers"]:
        add("unusual_demand_observations", "info", 0.5, m, "review_outliers")
    same = told["same"]
    if same["n_rows"] >= 50 and same["top_share"] > 0.95:
        add("suspicious_constant_demand", "info", 0.6, same["n_rows"], "review_coverage")
    if m := n["spellings"]:
        add("inconsistent_product_identifiers", "warning", 0.8, m, "standardize_product_identifiers")
    for kind, column, most, least, conf in shares:
        d = told.get(("share", column), n)
        if d["n_groups"] >= least and (d["top_share"] or 0) > most:
            add(f"{kind}_imbalance", "info", conf, d["n_groups"], "review_coverage")
    for column in stock:
        if m := told["negative", column]:
            add("unusual_inventory_values", "warning", 0.7, m, "review_inventory_values", detail=column)
    if "lead" in told:
        wrong, odd = told["lead"]
        if wrong or odd:
            add("unusual_lead_times", "warning" if wrong else "info", 0.6, wrong + odd, "review_lead_times", detail=meant["lead_time"])
    cover = told["cover"]
    if (cover["span_days"] or 0) >= 365 and cover["n_months"] < 12:
        add("seasonal_coverage_gap", "warning", 0.8, 12 - cover["n_months"], "review_coverage", detail=cover["missing_months"])
    if n["old"]:
        add("recent_history_gap", "warning", 0.7, n["old"], "review_coverage", affected_products=listed["old"])
    return sorted(out, key=lambda i: (SEVERITY[i.severity], -i.affected_records))


PENALTY = {"critical": 40, "warning": 15, "info": 4}


def readiness(found: list[Issue], meanings: set[str] = frozenset()) -> dict[str, int]:
    """Scores of 0 to 100 by area: 100 less the penalties of the issues that count there, each times its confidence (0.3 at least).

    meanings: what the other columns mean. Without any inventory column that score is 0; half the scenario's score hangs on a driver of demand."""
    score = lambda counts: round(max(0.0, 100 - sum(PENALTY[i.severity] * max(i.confidence, 0.3) for i in found if counts(i))))
    forecast = score(lambda i: i.category in FORECAST_CATEGORIES)
    inventory = score(lambda i: i.issue_type in INVENTORY_ISSUES) if set(meanings) & set(INVENTORY_MEANINGS) else 0
    return {"forecast": forecast, "inventory": inventory, "scenario": round(min(100, 0.5 * forecast + (50 if set(meanings) & set(DRIVER_MEANINGS) else 0)))}


def ready_for_features(found: list[Issue]) -> bool:
    return not any(i.severity == "critical" for i in found) and readiness(found)["forecast"] >= 40


def normalized_products(rows: DataFrame) -> DataFrame:
    return rows.withColumn("product_key", normalized(F.col("product")))

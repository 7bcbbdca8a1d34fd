"""Calendar, weather and industry side tables on a period grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_side_series
from ..types import MONTHLY, Granularity
from .features import with_degree_days
from .panel import bounded_ffill, calendar_features, period_of

#: Name -> (category, future availability, industries that use it, side file).
REGISTRY = {
    "month": ("calendar", "safe_for_future", ("all",), None),
    "quarter": ("calendar", "safe_for_future", ("all",), None),
    "year": ("calendar", "safe_for_future", ("all",), None),
    "weekofyear": ("calendar", "safe_for_future", ("all",), None),
    "temperature": ("weather", "requires_future_values", ("all",), "weather_{city}_monthly.csv"),
    "cooling_degree_days": ("weather", "requires_future_values", ("all",), None),
    "heating_degree_days": ("weather", "requires_future_values", ("all",), None),
    "humidity": ("weather", "requires_future_values", ("all",), "weather_{city}_monthly.csv"),
    "ahri_shipments": ("industry", "historical_context", ("HVAC",), "ahri_shipments.csv"),
    "construction_activity": ("industry", "historical_context", ("manufacturing", "HVAC", "construction"), "construction_activity.csv"),
}
DEFAULT_CITY = "riyadh"


def period_grid(spark: SparkSession, start: str, end: str, g: Granularity = MONTHLY) -> DataFrame:
    """(date): the period labels from the first boundary at or after start up to end; the period of start if there is none."""
    one = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b"))
    first = period_of(F.col("a"), g)
    first = F.when(first < F.col("a"), F.to_date(first + F.expr(g.step))).otherwise(first)
    days = F.when(first <= F.col("b"), F.sequence(first, F.col("b"), F.expr(g.step))).otherwise(F.array(period_of(F.col("a"), g)))
    return one.select(F.explode(days).alias("date"))


def _on_grid(side: DataFrame, g: Granularity) -> DataFrame:
    """Means per period; monthly side files serve every week of their month."""
    cols = [c for c in side.columns if c != "date"]
    return side.groupBy(F.trunc("date", "month").alias("_month")).agg(*(F.avg(c).alias(c) for c in cols))


def build_external(spark: SparkSession, start: str, end: str, folder: str, g: Granularity = MONTHLY, city: str | None = None, industry: str | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """(frame by date, warnings, features that are unavailable). A missing city falls back to the default file, with a warning."""
    notes, missing = [], []
    base = calendar_features(period_grid(spark, start, end, g), g.name == "weekly").select("date", "month", "quarter", "year", *(["weekofyear"] if g.name == "weekly" else []))
    frame = base.withColumn("_month", F.trunc("date", "month"))
    name = (city or DEFAULT_CITY).strip().lower().replace(" ", "")
    weather = read_side_series(spark, f"{folder}/weather_{name}_monthly.csv", ["temperature", "humidity", "rainfall"])
    if weather is None and name != DEFAULT_CITY:
        notes.append(f"no weather file for {city}; the default one is used")
        weather = read_side_series(spark, f"{folder}/weather_{DEFAULT_CITY}_monthly.csv", ["temperature", "humidity", "rainfall"])
    if weather is None:
        missing += ["temperature", "cooling_degree_days", "heating_degree_days", "humidity"]
    else:
        frame = frame.join(_on_grid(weather, g), "_month", "left")
        if "temperature" in weather.columns:
            frame = with_degree_days(frame)
    for feature in ("ahri_shipments", "construction_activity"):
        _, _, fields, file = REGISTRY[feature]
        if (industry or "").upper() in [f.upper() for f in fields]:
            side = read_side_series(spark, f"{folder}/{file}", [feature])
            if side is None:
                missing.append(feature)
            else:
                frame = frame.join(_on_grid(side, g), "_month", "left")
    frame = frame.drop("_month").withColumn("product", F.lit(""))
    for c in [c for c in frame.columns if c not in ("date", "product", "month", "quarter", "year", "weekofyear")]:
        frame = bounded_ffill(frame, c)
    return frame.drop("product"), notes, missing


def get_registry() -> dict:
    """Each feature with all that is known of it. What isn't in the table follows from it: a feature with a side file needs its column there, degree
    days are derived from the temperature, weather is of one city, and only weather can be set in a scenario; nothing here looks at sales."""
    out = {}
    for name, (category, future, fields, file) in REGISTRY.items():
        derived = name.endswith("_degree_days")
        source = "side_file" if file else "derived" if derived else "generated"
        needs = ["date", name] if file else ["temperature"] if derived else []
        out[name] = {"category": category, "future_availability": future, "industries": fields, "file": file, "source": source, "required_columns": needs, "by_city": category == "weather", "scenario_capable": category == "weather", "leakage_risk": "low"}
    return out


def recommend(industry: str | None = None, granularity: str = "monthly", have: set[str] | None = None) -> list[dict]:
    """The registry's features that suit the industry, with a reason and whether their side file is among `have`."""
    out = []
    for name, (category, future, fields, file) in REGISTRY.items():
        if name == "weekofyear" and granularity != "weekly" or not ("all" in fields or (industry or "").upper() in [f.upper() for f in fields]):
            continue
        why = {"calendar": "known for every future period", "weather": "demand may follow the weather; fit for scenarios", "industry": "context of the industry's past"}[category]
        out.append({"feature": name, "category": category, "future_availability": future, "reason": why, "available": file is None or (have is not None and file in have)})
    return out

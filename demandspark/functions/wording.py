"""English for the codes that findings, reasons and warnings carry. The codes are the result; the texts only read them out."""

from __future__ import annotations

import math

TEXTS = {
    # findings
    "few_products_carry_demand": "{share:.0%} of the forecast falls on the three largest products.",
    "errors_beyond_range": "The validated error of {products} products is beyond the accepted range.",
    "issues_lower_trust": "{issues} issues in the data limit how far the figures can be trusted.",
    "scenario_moves_demand": "The scenario moves total demand by {delta_pct:+.1f} percent.",
    "growth_ahead": "{product} grows most against its own last periods.",
    "no_feature_effects": "How much single features contribute is not worked out.",
    # actions
    "plan_for_growth": "Plan capacity for the products that are about to grow.",
    "look_into_errors": "Find out why these products are forecast badly before relying on them.",
    "try_scenarios": "Try further scenarios on the products that react to them.",
    "confirm_by_hand": "Let a planner confirm the figures.",
    "add_stock_columns": "Add columns for stock, delivery times and capacity, to plan inventory as well.",
    "add_feature_effects": "Work out feature contributions for the tree models.",
    # what to do about a product at risk
    "check_error": "Compare its latest demand with what was forecast.",
    "adjust_bias": "Plan with the direction of its past errors in mind.",
    "prepare_for_scenario": "Have a second plan for the scenario.",
    "keep_margin": "Its history is thin: keep a margin.",
    "watch": "Nothing beyond regular watching.",
    # notes on quality
    "portfolio_error": "Over all validated periods the weighted error is {wmape:.1%}.",
    "portfolio_bias": "In sum the validated forecasts show {direction}.",
    "over_and_under": "{over} validated periods came out too high and {under} too low.",
    "models_missing": "Without result, while the run went on: {models}.",
    "validated_not_assumed": "Validated figures come from past periods; scenarios are assumptions.",
    # limits of the data
    "unvalidated_products": "{products} products are too short for a validation.",
    "no_product_validation": "No product could be validated on its own.",
    "side_table": "Side tables: {detail}",
    "no_stock_columns": "There is nothing on stock, delivery times or capacity, hence no inventory plan.",
    # summary
    "demand_up": "Total demand goes up ({change:+.0%}).",
    "demand_down": "Total demand goes down ({change:+.0%}).",
    "demand_stable": "Total demand stays where it is.",
    "demand_total": "Over {horizon} periods {total:,.0f} units are expected.",
    "forecast_made": "A forecast is there.",
    "trust": "Trust in it is {level}.",
    "products_at_high_risk": "{products} products are at high risk.",
    "products_at_risk": "{products} products need a look.",
    # issues
    "invalid_dates": "{n} dates cannot be read.",
    "invalid_demand_values": "{n} quantities are missing or no numbers.",
    "invalid_product_identifiers": "{n} rows name no product.",
    "empty_rows": "{n} rows are empty.",
    "negative_demand": "{n} quantities are below zero.",
    "exact_duplicate_rows": "{n} rows repeat others exactly.",
    "multiple_records_same_product_period": "{n} rows share product and period with others.",
    "insufficient_history": "{n} products have too few periods.",
    "missing_periods": "{n} periods are missing between first and last ones.",
    "intermittent_demand": "{n} products sell now and then only.",
    "large_temporal_gaps": "{n} products stand still for long stretches.",
    "irregular_frequency": "The {n} dates lie far apart for the chosen period.",
    "unusual_demand_observations": "{n} quantities lie far from the usual.",
    "suspicious_constant_demand": "Nearly all of {n} quantities are the same.",
    "inconsistent_product_identifiers": "{n} spellings stand for fewer products.",
    "product_coverage_imbalance": "One of {n} products holds most of the demand.",
    "region_imbalance": "One of {n} regions holds most of the demand.",
    "customer_imbalance": "One of {n} customers holds most of the demand.",
    "unusual_inventory_values": "{n} stock values are below zero.",
    "unusual_lead_times": "{n} delivery times are not possible or far from the usual.",
    "seasonal_coverage_gap": "{n} calendar months never occur.",
    "recent_history_gap": "{n} products end well before the data does.",
    # reasons of capabilities and readiness
    "core_complete": "Date, product and quantity are there.",
    "core_incomplete": "Still to be found: {missing}.",
    "unlocked_by": "Rests on {inputs}.",
    "locked_without": "Needs one of {some}.",
    "locked_without_all": "Needs all of {every}.",
    "core_columns": "{found} of 3 core columns.",
    "sufficient_products": "{found} of {products} products have enough periods.",
    "products_unknown": "The history could not be looked at.",
    "periods_with_demand": "{share:.0%} of the periods have demand.",
    "demand_drivers": "Drivers of demand: {inputs}.",
    "input_there": "{input} is there.",
    "input_missing": "{input} is missing.",
    "half_of_forecast": "Half of the forecast's own readiness.",
    # performance and scenarios
    "no_validation": "There are no validated periods to measure errors on.",
    "no_forecast": "There is no forecast to change.",
}


def say(code: str, **figures) -> dict:
    """{"code", "text", the figures}; a code without a text, or a figure that is no number, reads out plainly."""
    try:
        text = TEXTS.get(code, code.replace("_", " ")).format(**figures)
    except (KeyError, ValueError, TypeError):
        text = code.replace("_", " ")
    return {"code": code, "text": text, **figures}


def number(value) -> float | None:
    """A float from what looks like one; None for the rest, NaN and infinities among it."""
    try:
        out = float(value)
    except (TypeError, ValueError):
        return None
    return out if math.isfinite(out) else None


def figure(of: dict | None, *path: str) -> float | None:
    """The number at a path of nested dicts; None where a part is missing."""
    for key in path:
        if not isinstance(of, dict):
            return None
        of = of.get(key)
    return number(of)

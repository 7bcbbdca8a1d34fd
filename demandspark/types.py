"""Core mapping, granularities and label bands."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CoreMapping:
    """Which column of the upload holds date, product and quantity."""

    date: str | None = None
    product: str | None = None
    qty: str | None = None


@dataclass(frozen=True)
class Granularity:
    name: str
    step: str  # SQL interval
    lags: tuple[int, ...]
    windows: tuple[int, ...]
    season: int
    average: int
    horizon: int


#: Fixed values.
MONTHLY = Granularity("monthly", "INTERVAL 1 MONTH", (1, 3, 12), (3, 6), 12, 3, 12)
WEEKLY = Granularity("weekly", "INTERVAL 7 DAY", (1, 4, 52), (4, 12), 52, 4, 26)
GRANULARITIES = {g.name: g for g in (MONTHLY, WEEKLY)}
FOLDS = {"fast": 2, "balanced": 3, "full": 4}
VALIDATION_HORIZON = 3
#: Fixed values: (upper bound, label) in order; what exceeds all takes the last label. Bias goes by its size, MAE and RMSE by their share of mean demand.
ERROR_BANDS = ((0.10, "excellent"), (0.20, "good"), (0.35, "needs_attention"), (float("inf"), "poor"))
BIAS_BANDS = ((0.05, "excellent"), (0.15, "good"), (0.30, "needs_attention"), (float("inf"), "poor"))
RELATIVE_BANDS = ((0.15, "excellent"), (0.30, "good"), (0.50, "needs_attention"), (float("inf"), "poor"))


@dataclass
class RunConfig:
    granularity: str = "monthly"
    evaluation_mode: str = "balanced"
    horizon: int | None = None
    auto_approve_quality: bool = False
    approved: tuple[str, ...] = ()
    sector: str | None = None
    mapping: CoreMapping | None = None
    keep_extras: bool = True
    #: Whether tree models (and installed packages) are fitted for the products that ask for them.
    advanced_models: bool = True
    city: str | None = None
    extra: dict = field(default_factory=dict)

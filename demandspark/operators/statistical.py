"""Two statistical models over blocks of series: seasonal ARIMA in state-space form, and an additive model of trend and season.

A product's history travels as one array; a task holds a block of products as a matrix, left-padded with NaN, and fits all of them at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..types import Granularity

#: Series that are fitted together.
BLOCK = 64
#: Likelihood evaluations: iterations of the search on the conditional sum of squares, then on the exact likelihood.
ROUGH, FINE = 150, 40
#: Coefficients stay inside (-EDGE, EDGE): stationary and invertible.
EDGE = 0.99
#: Fixed values of the additive model: change points and the share of the history that holds them, Fourier order, days of a year, scales of the priors.
CHANGES, CHANGE_RANGE, ORDER, YEAR = 25, 0.8, 10, 365.25
SLOPE_SCALE, CHANGE_SCALE, SEASON_SCALE, NOISE_SCALE = 5.0, 0.05, 10.0, 0.5


def simplex_search(cost: Callable[[np.ndarray], np.ndarray], start: np.ndarray, width: float, rounds: int) -> np.ndarray:
    """Nelder and Mead's search for each row of start, all rows in step. cost takes points (row, coordinate) and gives a value for each row."""
    rows, dims = start.shape
    points = np.repeat(start[:, None, :], dims + 1, axis=1)
    points[:, range(1, dims + 1), range(dims)] += width
    values = np.stack([cost(points[:, k]) for k in range(dims + 1)], axis=1)
    every = np.arange(rows)
    for _ in range(rounds):
        order = np.argsort(values, axis=1, kind="stable")
        points, values = points[every[:, None], order], np.take_along_axis(values, order, axis=1)
        if (values[:, -1] - values[:, 0]).max() < 1e-9:
            break
        centre, worst = points[:, :-1].mean(axis=1), points[:, -1]
        reflected = 2 * centre - worst
        at_reflected = cost(reflected)
        # further out where the reflection is the best so far; inwards where it stays the worst; else halfway out
        reach = np.where(at_reflected < values[:, 0], 2.0, np.where(at_reflected < values[:, -1], 0.5, -0.5))
        other = centre + reach[:, None] * (centre - worst)
        at_other = cost(other)
        take_other = at_other < at_reflected
        best, value = np.where(take_other[:, None], other, reflected), np.minimum(at_other, at_reflected)
        better = value < values[:, -1]
        points[better, -1], values[better, -1] = best[better], value[better]
        if not better.all():
            stuck = ~better
            points[stuck, 1:] = (points[stuck, 1:] + points[stuck, :1]) / 2
            for k in range(1, dims + 1):
                values[stuck, k] = cost(points[:, k])[stuck]
    return points[every, values.argmin(axis=1)]


def _coefficients(x: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray]:
    """The expanded autoregressive and moving-average coefficients at lags 1 to season + 1 of (1, 1)(1, 1) seasonal models, a row for each."""
    c = EDGE * np.tanh(x)
    ar, ma = np.zeros((2, len(x), season + 1))
    ar[:, 0], ar[:, season - 1], ar[:, season] = c[:, 0], c[:, 2], -c[:, 0] * c[:, 2]
    ma[:, 0], ma[:, season - 1], ma[:, season] = c[:, 1], c[:, 3], c[:, 1] * c[:, 3]
    return ar, ma


def conditional_cost(w: np.ndarray, season: int) -> Callable[[np.ndarray], np.ndarray]:
    """The log of the mean squared one-step error, values and errors before the series taken as 0."""
    seen, filled = ~np.isnan(w), np.nan_to_num(w)
    lags = np.array([1, season, season + 1])
    past = np.concatenate([np.zeros((len(w), season + 1)), filled], axis=1)

    def cost(x: np.ndarray) -> np.ndarray:
        ar, ma = _coefficients(x, season)
        ar, ma = ar[:, lags - 1], ma[:, lags - 1]
        errors = np.zeros_like(past)
        for t in range(season + 1, past.shape[1]):
            errors[:, t] = np.where(seen[:, t - season - 1], past[:, t] - (ar * past[:, t - lags]).sum(axis=1) - (ma * errors[:, t - lags]).sum(axis=1), 0.0)
        return np.log((errors**2).sum(axis=1) / np.maximum(seen.sum(axis=1), 1) + 1e-300)

    return cost


def _stationary(ar: np.ndarray, shock: np.ndarray) -> np.ndarray:
    """The covariance of the state before any observation, by doubling: the sum of T^k R R' T'^k."""
    size = shock.shape[1]
    step = np.zeros((len(ar), size, size))
    step[:, :, 0] = ar
    step[:, range(size - 1), range(1, size)] = 1.0
    total = shock[:, :, None] * shock[:, None, :]
    for _ in range(40):
        more = step @ total @ step.transpose(0, 2, 1)
        total = total + more
        if np.abs(more).max() <= 1e-12 * np.abs(total).max():
            break
        step = step @ step
    return total


def kalman(w: np.ndarray, x: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of squared standardised errors, sum of log variances, predicted state) of each series under the parameters in its row of x.

    The shock's variance is taken as 1. A missing value only moves the state on, so that NaN before a history changes nothing."""
    ar, ma = _coefficients(x, season)
    size = season + 2
    ar = np.concatenate([ar, np.zeros((len(w), 1))], axis=1)
    shock = np.concatenate([np.ones((len(w), 1)), ma], axis=1)
    noise = shock[:, :, None] * shock[:, None, :]
    cov, state = _stationary(ar, shock), np.zeros((len(w), size))
    squares, logs = np.zeros((2, len(w)))
    moved = np.empty_like(cov)
    for t in range(w.shape[1]):
        seen = ~np.isnan(w[:, t])
        spread = cov[:, 0, 0]
        error = np.where(seen, np.nan_to_num(w[:, t]) - state[:, 0], 0.0)
        squares += error**2 / spread
        logs += np.where(seen, np.log(spread), 0.0)
        # what the observation tells, then one step of the companion matrix on both sides
        column = cov[:, :, 0] * np.where(seen, 1 / np.sqrt(spread), 0.0)[:, None]
        state = state + column * (error / np.sqrt(spread))[:, None]
        cov = cov - column[:, :, None] * column[:, None, :]
        np.multiply(ar[:, :, None], cov[:, :1, :], out=moved)
        moved[:, :-1] += cov[:, 1:]
        cov = moved[:, :, :1] * ar[:, None, :] + noise
        cov[:, :, :-1] += moved[:, :, 1:]
        first = state[:, :1].copy()
        state = np.concatenate([state[:, 1:], np.zeros((len(w), 1))], axis=1) + ar * first
    return squares, logs, state


def exact_cost(w: np.ndarray, season: int) -> Callable[[np.ndarray], np.ndarray]:
    """Twice the negative log-likelihood a value, the shock's variance at its best, but for constants."""
    n = np.maximum((~np.isnan(w)).sum(axis=1), 1)

    def cost(x: np.ndarray) -> np.ndarray:
        squares, logs, _ = kalman(w, x, season)
        return np.log(squares / n + 1e-300) + logs / n

    return cost


def sarima(y: np.ndarray, days: np.ndarray, g: Granularity, horizon: int, future: np.ndarray) -> np.ndarray:
    """Forecasts of seasonal ARIMA (1, 1, 1)(1, 1, 1) for the rows of y; NaN for histories under two seasons and four periods.

    The series is differenced once and by season, fitted by exact likelihood from where the conditional sum of squares is least, and summed up again."""
    season = g.season
    told = np.full((len(y), horizon), np.nan)
    fits = (~np.isnan(y)).sum(axis=1) >= 2 * season + 4
    if not fits.any():
        return told
    y = y[fits]
    w = y[:, season + 1 :] - y[:, season:-1] - y[:, 1:-season] + y[:, : -season - 1]
    scale = np.sqrt(np.nanmean(w**2, axis=1, keepdims=True))
    scale[~(scale > 0)] = 1.0
    w = w / scale
    start = np.tile(np.arctanh(np.array([0.1, -0.4, 0.1, -0.4]) / EDGE), (len(y), 1))
    best = simplex_search(exact_cost(w, season), simplex_search(conditional_cost(w, season), start, 0.5, ROUGH), 0.2, FINE)
    ar, _ = _coefficients(best, season)
    ar = np.concatenate([ar, np.zeros((len(w), 1))], axis=1)
    _, _, state = kalman(w, best, season)
    long = y
    for _ in range(horizon):
        ahead = state[:, 0] * scale[:, 0] + long[:, -1] + long[:, -season] - long[:, -season - 1]
        long = np.concatenate([long, ahead[:, None]], axis=1)
        state = np.concatenate([state[:, 1:], np.zeros((len(w), 1))], axis=1) + ar * state[:, :1]
    told[fits] = long[:, -horizon:]
    return told


def additive(y: np.ndarray, days: np.ndarray, g: Granularity, horizon: int, future: np.ndarray) -> np.ndarray:
    """Forecasts of a piecewise-linear trend plus a yearly season (histories of two years and more); NaN for fewer than two values.

    days, future: dates as days, a row for each series. The most probable coefficients under normal priors, and a Laplace prior for the
    changes of slope: penalised normal equations, solved again and again with the penalties and the noise of the last solution."""
    rows, seen = len(y), ~np.isnan(y)
    n = seen.sum(axis=1)
    fits = n >= 2
    last = days[:, -1]
    first = np.where(fits, np.take_along_axis(days, np.minimum(y.shape[1] - n, y.shape[1] - 1)[:, None], axis=1)[:, 0], last - 1)
    span = np.maximum(last - first, 1)
    scale = np.nanmax(np.where(seen, np.abs(y), 0.0), axis=1)
    scale[scale == 0] = 1.0
    time = lambda d: (d - first[:, None]) / span[:, None]
    t = time(days)
    # change points: evenly among the first values, after the first one
    held = np.floor(n * CHANGE_RANGE).astype(int)
    many = np.clip(held - 1, 0, CHANGES)
    place = np.rint(np.arange(1, CHANGES + 1)[None, :] * (held - 1)[:, None] / np.maximum(many, 1)[:, None]).astype(int)
    there = np.arange(1, CHANGES + 1)[None, :] <= many[:, None]
    change = np.take_along_axis(t, np.clip(y.shape[1] - n[:, None] + np.where(there, place, 0), 0, y.shape[1] - 1), axis=1)
    yearly = (span >= 2 * 365)[:, None, None]

    def columns(d: np.ndarray) -> np.ndarray:
        at = time(d)
        hinges = np.where(there[:, None, :], np.maximum(at[:, :, None] - change[:, None, :], 0.0), 0.0)
        angle = 2 * np.pi * np.arange(1, ORDER + 1) * d[:, :, None] / YEAR
        waves = np.where(yearly, np.concatenate([np.sin(angle), np.cos(angle)], axis=2), 0.0)
        return np.concatenate([np.ones_like(at)[:, :, None], at[:, :, None], hinges, waves], axis=2)

    x = columns(days) * seen[:, :, None]
    target = np.nan_to_num(y / scale[:, None])
    gram, right = x.transpose(0, 2, 1) @ x, (x.transpose(0, 2, 1) @ target[:, :, None])[:, :, 0]
    changes = slice(2, 2 + CHANGES)
    penalty = np.concatenate([np.full((rows, 2), SLOPE_SCALE**-2), np.full((rows, CHANGES), 1 / (CHANGE_SCALE * 0.05)), np.full((rows, 2 * ORDER), SEASON_SCALE**-2)], axis=1)
    noise = np.full(rows, 0.01)
    for _ in range(25):
        system = gram / noise[:, None, None]
        system[:, range(penalty.shape[1]), range(penalty.shape[1])] += penalty
        beta = np.linalg.solve(system, (right / noise[:, None])[:, :, None])[:, :, 0]
        left = ((target - (x @ beta[:, :, None])[:, :, 0]) ** 2 * seen).sum(axis=1)
        # the variance at which n log(s) + left / (2 s^2) + s^2 / (2 NOISE_SCALE^2) is least
        noise = np.maximum((np.sqrt(n**2 + 4 * left / NOISE_SCALE**2) - n) * NOISE_SCALE**2 / 2, 1e-8)
        penalty[:, changes] = 1 / (CHANGE_SCALE * np.maximum(np.abs(beta[:, changes]), 1e-5))
    told = (columns(future) @ beta[:, :, None])[:, :, 0] * scale[:, None]
    return np.where(fits[:, None], told, np.nan)


FITS = {"sarima": sarima, "prophet": additive}


def block_forecast(rows: DataFrame, model: str, g: Granularity, horizon: int) -> DataFrame:
    """(product, last_date, horizon_step, forecast), forecasts at least 0, from rows(product, last_date, y, dates, ahead): a series for each product and
    the dates of the steps. Products whose history is too short have no rows. The fits take long, so that products are dealt evenly to all cores."""
    fit = FITS[model]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                length = max(len(v) for v in b.column(2))
                y, days = np.full((b.num_rows, length), np.nan), np.zeros((b.num_rows, length))
                for i in range(b.num_rows):
                    values = b.column(2)[i].values.to_numpy(zero_copy_only=False)
                    y[i, length - len(values) :] = values
                    days[i, length - len(values) :] = b.column(3)[i].values.cast(pa.int32()).to_numpy()
                future = np.stack([b.column(4)[i].values.cast(pa.int32()).to_numpy() for i in range(b.num_rows)]).astype(float)
                told = np.maximum(fit(y, days, g, horizon, future), 0.0)
                row, step = np.nonzero(np.isfinite(told))
                again = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(again), b.column(1).take(again), pa.array((step + 1).astype(np.int32)), pa.array(told[row, step])], ["product", "last_date", "horizon_step", "forecast"])

    dealt = rows.select("product", "last_date", "y", "dates", "ahead").repartition(rows.sparkSession.sparkContext.defaultParallelism, "product")
    return dealt.mapInArrow(run, "product string, last_date date, horizon_step int, forecast double")

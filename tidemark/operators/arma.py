"""Regression with ARMA errors, estimated in two stages for many windows at once.

A window is explained by a level, a trend, waves of its season and lagged
drivers; what is left follows an autoregression and a moving average, with a
seasonal lag of each where the window has a season. The estimate is that of
Hannan and Rissanen: least squares leave residuals, a long autoregression by
Levinson and Durbin's recursion gives their innovations, and a second least
squares on lagged residuals and lagged innovations gives the two parts. Orders
are chosen by the corrected information criterion on the rows all orders share.

Every step is a numpy operation over all windows of one length, so a batch costs
a few small matrices a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import DS, SERIES_ID, Y
from tidemark.functions.dates import add_periods

#: Orders (autoregressive, moving average) a search goes through, simplest first.
ORDERS = ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (2, 1))
#: Waves of a season at most.
HARMONICS = 3
#: Shortest window, and least number of rows for each coefficient.
SHORTEST = 12
ROWS_PER_COEFFICIENT = 3
#: Kept below one, a recursion dies out.
MOST_PERSISTENCE = 0.98


def waves(start: int, stop: int, period: int, harmonics: int) -> np.ndarray:
    """Sines and cosines of a season at places start to stop - 1, one a column.
    Half a period has a cosine only."""
    t = np.arange(start, stop)
    columns = []
    for order in range(1, min(harmonics, period // 2) + 1):
        angle = 2 * np.pi * order * t / period
        columns.append(np.cos(angle))
        if 2 * order < period:
            columns.append(np.sin(angle))
    return np.stack(columns, axis=1) if columns else np.zeros((stop - start, 0))


def least_squares(design: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients per window for designs (windows, rows, columns). Columns are
    measured by their own size; what they share is split evenly by a trace of ridge."""
    size = np.sqrt((design**2).mean(axis=1, keepdims=True))
    size = np.where(size > 0, size, 1.0)
    unit = design / size
    across = np.swapaxes(unit, 1, 2)
    normal = across @ unit
    ridge = 1e-10 * design.shape[1] * np.eye(design.shape[2])
    return (np.linalg.solve(normal + ridge, across @ y[:, :, None])[:, :, 0]) / size[:, 0, :]


def levinson(covariances: np.ndarray) -> np.ndarray:
    """Autoregressive coefficients (windows, order) from autocovariances (windows, order + 1)."""
    rows, order = covariances.shape[0], covariances.shape[1] - 1
    out = np.zeros((rows, order))
    error = covariances[:, 0].copy()
    for k in range(order):
        known = (out[:, :k] * covariances[:, k:0:-1]).sum(axis=1)
        step = np.where(error > 0, (covariances[:, k + 1] - known) / np.where(error > 0, error, 1.0), 0.0)
        turned = out[:, :k][:, ::-1].copy()
        out[:, :k] -= step[:, None] * turned
        out[:, k] = step
        error = error * (1 - step**2)
    return out


def autocovariances(u: np.ndarray, order: int) -> np.ndarray:
    n = u.shape[1]
    centred = u - u.mean(axis=1, keepdims=True)
    return np.stack([(centred[:, k:] * centred[:, : n - k]).sum(axis=1) / n for k in range(order + 1)], axis=1)


def long_order(n: int, longest: int) -> int:
    """Lags of the long autoregression: enough for the orders, few beside the rows."""
    return int(min(max(longest + 1, round(10 * np.log10(n))), n // 4))


def innovations(u: np.ndarray, order: int) -> np.ndarray:
    """What a long autoregression leaves; zero where it has no history."""
    weights = levinson(autocovariances(u, order))
    out = np.zeros_like(u)
    out[:, order:] = u[:, order:]
    for k in range(order):
        out[:, order:] -= weights[:, k, None] * u[:, order - 1 - k : u.shape[1] - 1 - k]
    return out


def _persistence(weights: np.ndarray, lags: Sequence[int]) -> np.ndarray:
    """The largest root of each autoregression, as growth a period."""
    if not lags:
        return np.zeros(len(weights))
    size = max(lags)
    matrix = np.zeros((len(weights), size, size))
    for place, lag in enumerate(lags):
        matrix[:, 0, lag - 1] = weights[:, place]
    matrix[:, np.arange(1, size), np.arange(size - 1)] = 1.0
    return np.abs(np.linalg.eigvals(matrix)).max(axis=1)


def _drawn_in(weights: np.ndarray, lags: Sequence[int]) -> np.ndarray:
    """A recursion that would grow is drawn in, all its roots alike."""
    growth = _persistence(weights, lags)
    shrink = np.where(growth > MOST_PERSISTENCE, MOST_PERSISTENCE / np.where(growth > 0, growth, 1.0), 1.0)
    return weights * shrink[:, None] ** np.array(lags, dtype=float)


@dataclass(frozen=True)
class Errors:
    """The ARMA part of each window: lags of the residuals and of the innovations."""

    ar_lags: tuple[int, ...]
    ma_lags: tuple[int, ...]
    ar: np.ndarray
    ma: np.ndarray
    #: Mean squared innovation of the second stage, and its rows.
    variance: np.ndarray
    rows: int


def fit_errors(u: np.ndarray, e: np.ndarray, ar_lags: Sequence[int], ma_lags: Sequence[int], first: int) -> Errors:
    """Second stage: residuals on their lags and on lagged innovations, from row ``first`` on."""
    n = u.shape[1]
    target = u[:, first:]
    columns = [u[:, first - lag : n - lag] for lag in ar_lags] + [e[:, first - lag : n - lag] for lag in ma_lags]
    if not columns:
        none = np.zeros((len(u), 0))
        return Errors((), (), none, none, (target**2).mean(axis=1), target.shape[1])
    design = np.stack(columns, axis=2)
    weights = least_squares(design, target)
    ar = _drawn_in(weights[:, : len(ar_lags)], ar_lags)
    # The innovations go by a recursion on minus the moving average.
    ma = -_drawn_in(-weights[:, len(ar_lags) :], ma_lags)
    left = target - (design @ np.concatenate([ar, ma], axis=1)[:, :, None])[:, :, 0]
    return Errors(tuple(ar_lags), tuple(ma_lags), ar, ma, (left**2).mean(axis=1), target.shape[1])


def shocks(u: np.ndarray, errors: Errors) -> np.ndarray:
    """The innovations that the fitted recursion itself leaves, from zero on."""
    n = u.shape[1]
    e = np.zeros_like(u)
    for t in range(n):
        value = u[:, t].copy()
        for place, lag in enumerate(errors.ar_lags):
            if t >= lag:
                value -= errors.ar[:, place] * u[:, t - lag]
        for place, lag in enumerate(errors.ma_lags):
            if t >= lag:
                value -= errors.ma[:, place] * e[:, t - lag]
        e[:, t] = value
    return e


def ahead(u: np.ndarray, e: np.ndarray, errors: Errors, horizon: int) -> np.ndarray:
    """The recursion carried on with innovations of zero."""
    n = u.shape[1]
    u = np.concatenate([u, np.zeros((len(u), horizon))], axis=1)
    e = np.concatenate([e, np.zeros((len(e), horizon))], axis=1)
    for t in range(n, n + horizon):
        for place, lag in enumerate(errors.ar_lags):
            u[:, t] += errors.ar[:, place] * u[:, t - lag]
        for place, lag in enumerate(errors.ma_lags):
            u[:, t] += errors.ma[:, place] * e[:, t - lag]
    return u[:, n:]


def regressors(rows: int, n: int, horizon: int, trend: bool, season: int, harmonics: int, drivers: np.ndarray | None) -> np.ndarray:
    """Columns over the window and the steps after it, for every window.

    ``drivers`` (windows, n + horizon, drivers) holds values known or projected
    past the window's end.
    """
    t = np.arange(n + horizon)
    columns = [np.ones(n + horizon)]
    if trend:
        columns.append(t - (n - 1) / 2)
    shared = np.stack(columns, axis=1)
    if season >= 2:
        shared = np.concatenate([shared, waves(0, n + horizon, season, harmonics)], axis=1)
    out = np.broadcast_to(shared, (rows, *shared.shape))
    return out if drivers is None else np.concatenate([out, drivers], axis=2)


def regression_batch(
    y: np.ndarray,
    period: int,
    seasonal: bool,
    trending: bool,
    horizon: int,
    *,
    orders: Sequence[tuple[int, int]] = ORDERS,
    harmonics: int = HARMONICS,
    long: int | None = None,
    drivers: np.ndarray | None = None,
) -> list[np.ndarray | None]:
    """Paths for windows (rows, n) of one length; none for windows too short.

    Of the orders, and with a season of those with a seasonal lag too, each window
    takes the one of lowest corrected information criterion, the first of equals.
    """
    rows, n = y.shape
    season = period if seasonal and 2 <= period and n >= 2 * period + 2 else 0
    if n < SHORTEST:
        return [None] * rows
    design = regressors(rows, n, horizon, trending, season, harmonics, drivers)
    columns = design.shape[2]
    if n < ROWS_PER_COEFFICIENT * columns:
        return [None] * rows
    beta = least_squares(design[:, :n], y)
    u = y - (design[:, :n] @ beta[:, :, None])[:, :, 0]
    plain = [(tuple(range(1, p + 1)), tuple(range(1, q + 1))) for p, q in orders]
    wide = [((*ar, season), ma) for ar, ma in plain if season > max((*ar, *ma, 1))] if season and n >= 3 * season else []
    choices = [choice for choice in plain + wide if n >= ROWS_PER_COEFFICIENT * (columns + len(choice[0]) + len(choice[1]))]
    longest = max((max((*ar, *ma, 0)) for ar, ma in choices), default=0)
    order = long_order(n, longest) if long is None else long
    e = innovations(u, order)
    first = min(max(order, longest) + max((max(ma, default=0) for _, ma in choices), default=0), n // 2)
    choices = [choice for choice in choices if max((*choice[0], *choice[1], 0)) <= first]
    fits, criteria = [], []
    for ar, ma in choices:
        fitted = fit_errors(u, e, ar, ma, first)
        k = columns + len(ar) + len(ma) + 1
        penalty = 2 * k + 2 * k * (k + 1) / (fitted.rows - k - 1) if fitted.rows > k + 1 else np.inf
        fits.append(fitted)
        criteria.append(fitted.rows * np.log(np.maximum(fitted.variance, 1e-12)) + penalty)
    if not fits:
        return [None] * rows
    # Orders that a window is too short to weigh stand back.
    scores = np.stack(criteria)
    best = np.argmin(scores, axis=0)
    base = (design[:, n:] @ beta[:, :, None])[:, :, 0]
    out: list[np.ndarray | None] = [None] * rows
    for place, fitted in enumerate(fits):
        own = np.flatnonzero(best == place)
        if not len(own):
            continue
        part = Errors(fitted.ar_lags, fitted.ma_lags, fitted.ar[own], fitted.ma[own], fitted.variance[own], fitted.rows)
        path = base[own] + ahead(u[own], shocks(u[own], part), part, horizon)
        for spot, i in enumerate(own.tolist()):
            out[i] = path[spot] if np.isfinite(path[spot]).all() else None
    return out


def arma_paths(train: Column, horizon: int, period: int, *, seasonal: bool, trending: bool, orders: Sequence[tuple[int, int]] = ORDERS, long: int | None = None) -> Column:
    """The path of each window's array; windows of one length are fitted together."""
    tried = tuple(orders)

    @F.pandas_udf("array<double>")
    def paths(values: pd.Series) -> pd.Series:
        windows = [np.asarray(held, dtype=float) for held in values]
        out: list[np.ndarray | None] = [None] * len(windows)
        alike: dict[int, list[int]] = {}
        for i, y in enumerate(windows):
            if np.isfinite(y).all():
                alike.setdefault(y.size, []).append(i)
        for places in alike.values():
            y = np.stack([windows[i] for i in places])
            for i, path in zip(places, regression_batch(y, period, seasonal, trending, horizon, orders=tried, long=long)):
                out[i] = path
        return pd.Series(out)

    return paths(train)


def arma_forecast(
    series: DataFrame, frequency: str, horizon: int, period: int, *, seasonal: bool = True, trending: bool = True, orders: Sequence[tuple[int, int]] = ORDERS, long: int | None = None
) -> DataFrame:
    """series_id, step, ds, forecast for every series of an aligned panel (t, ds, y)
    that is long enough and has no hole."""
    packed = series.groupBy(SERIES_ID).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", Y))), lambda p: p[Y]).alias("train"), F.max(DS).alias("_last"), F.count(Y).alias("_n"))
    whole = packed.filter(F.size("train") == F.col("_n"))
    path = arma_paths(F.col("train"), horizon, period, seasonal=seasonal, trending=trending, orders=orders, long=long)
    stepped = whole.select(SERIES_ID, "_last", F.posexplode(path).alias("_i", "forecast"))
    return stepped.select(SERIES_ID, (F.col("_i") + 1).alias("step"), add_periods(F.col("_last"), F.col("_i") + 1, frequency).alias(DS), "forecast")

"""Exponential smoothing and theta forecasts, fitted window by window.

The recursions run from period to period and have no built-in expression, so a
vectorised Arrow function walks all windows of one length and shape at once, for
a whole grid of smoothing weights and then a simplex search around the grid's
best. Windows are rows; Spark spreads them.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np

from tidemark.constants import BOX_COX_GRID, LOG_CEILING
from tidemark.operators.diagnostics import _centred

LEVEL_WEIGHTS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
TREND_WEIGHTS = (0.01, 0.05, 0.1, 0.3)
SEASON_WEIGHTS = (0.05, 0.1, 0.3, 0.5)
DAMPING = (0.8, 0.9, 0.98)


#: Windows times weights carried through a recursion at once.
_WIDTH = 1 << 17


def _opening(y: np.ndarray, period: int, season: str | None, trend: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level, trend and season of each row to start from: the first seasons' means."""
    rows, n = y.shape
    if season is None:
        near = min(n, 5) - 1
        slope = (y[:, near] - y[:, 0]) / max(near, 1) if trend else np.zeros(rows)
        return y[:, 0] - slope, slope, np.zeros((rows, 1))
    first, second = y[:, :period].mean(axis=1), y[:, period : 2 * period].mean(axis=1)
    slope = (second - first) / period if trend else np.zeros(rows)
    cycles = n // period
    table = y[:, : cycles * period].reshape(rows, cycles, period)
    means = table.mean(axis=2, keepdims=True)
    pattern = (table / means if season == "mul" else table - means).mean(axis=1)
    return first - slope * (period - 1) / 2 - slope, slope, pattern


#: Rounds of the simplex, its first reach as a share of a weight's range, and the ranges.
_ROUNDS = 12
_REACH = 0.15
_LOW = np.array([0.001, 0.001, 0.001, 0.8])
_HIGH = np.array([0.999, 0.6, 0.999, 0.995])

#: Level, trend, season and damping, each (rows, candidates) or one for all rows.
Weights = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _run(y: np.ndarray, start: tuple[np.ndarray, np.ndarray, np.ndarray], weights: Weights, trend: bool, season: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The recursion for every window and candidate side by side: squared error,
    and the level, trend and cycle it ends with."""
    a, b, g, phi = weights
    rows, n = y.shape
    width = a.shape[-1]
    level, slope = (np.repeat(held[:, None], width, axis=1) for held in start[:2])
    pattern = start[2]
    # One plane per place in the cycle, so that a step touches one of them.
    cycle = np.repeat(pattern.T[:, :, None], width, axis=2)
    squared = np.zeros((rows, width))
    places = pattern.shape[1]
    with np.errstate(all="ignore"):
        for i in range(n):
            value = y[:, i, None]
            base = level + phi * slope
            held = cycle[i % places]
            if season == "mul":
                fitted, clean = base * held, value / held
            else:
                fitted, clean = base + held, value - held
            squared += (value - fitted) ** 2
            following = a * clean + (1 - a) * base
            if season:
                seen = value / base if season == "mul" else value - base
                cycle[i % places] = g * seen + (1 - g) * held
            slope = b * (following - level) + (1 - b) * phi * slope if trend else slope * 0.0
            level = following
    return np.where(np.isfinite(squared), squared, np.inf), level, slope, cycle


def _refined(y: np.ndarray, start: tuple[np.ndarray, np.ndarray, np.ndarray], best: np.ndarray, least: np.ndarray, active: np.ndarray, trend: bool, season: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A bounded simplex search over the active weights of every window at once,
    from the grid's best: weights (rows, 4) and their squared error, never more."""
    rows, d = len(y), len(active)
    low, high = _LOW[active], _HIGH[active]

    def errors(points: np.ndarray, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Squared errors of (rows, candidates, d) points."""
        full = np.repeat(best[which][:, None, :], points.shape[1], axis=1)
        full[:, :, active] = points
        own = tuple(held[which] for held in start)
        return _run(y[which], own, tuple(np.moveaxis(full, 2, 0)), trend, season)[0]

    centre = np.clip(best[:, active], low, high)
    reach = _REACH * (high - low)
    corners = np.repeat(centre[:, None, :], d + 1, axis=1)
    for j in range(d):
        corners[:, j + 1, j] += np.where(centre[:, j] + reach[j] <= high[j], reach[j], -reach[j])
    values = np.concatenate([least[:, None], errors(corners[:, 1:])], axis=1)
    at = np.arange(rows)
    with np.errstate(all="ignore"):
        for _ in range(_ROUNDS):
            order = np.argsort(values, axis=1, kind="stable")
            corners, values = corners[at[:, None], order], values[at[:, None], order]
            worst = corners[:, -1]
            middle = corners[:, :-1].mean(axis=1)
            move = middle - worst
            tried = np.clip(np.stack([middle + move, middle + 2 * move, middle + move / 2, middle - move / 2], axis=1), low, high)
            reflected, expanded, outside, inside = errors(tried).T
            first, second, last = values[:, 0], values[:, -2], values[:, -1]
            pick = np.full(rows, -1)
            pick[inside < last] = 3
            near = reflected < last
            pick[near] = np.where(outside <= reflected, 2, -1)[near]
            pick[reflected < second] = 0
            ahead = reflected < first
            pick[ahead] = np.where(expanded < reflected, 1, 0)[ahead]
            moved = np.flatnonzero(pick >= 0)
            corners[moved, -1] = tried[moved, pick[moved]]
            values[moved, -1] = np.stack([reflected, expanded, outside, inside])[pick[moved], moved]
            shrunk = np.flatnonzero(pick < 0)
            if len(shrunk):
                corners[shrunk, 1:] = (corners[shrunk, 1:] + corners[shrunk, :1]) / 2
                values[shrunk, 1:] = errors(corners[shrunk, 1:], shrunk)
    found = values.argmin(axis=1)
    better = values[at, found] < least
    out = best.copy()
    out[np.ix_(better, active)] = corners[at, found][better]
    return out, np.where(better, values[at, found], least)


def smooth(y: np.ndarray, period: int, trend: bool, damped: bool, season: str | None, horizon: int, *, refine: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Criterion and path of the best weights for each row of windows of one length.

    All windows and all weights of a grid go through the recursion side by side;
    from the grid's best a bounded simplex search goes on, all windows together.
    Where no weights fit, the criterion is infinite.
    """
    grid = np.array(
        list(
            product(
                LEVEL_WEIGHTS,
                TREND_WEIGHTS if trend else (0.0,),
                SEASON_WEIGHTS if season else (0.0,),
                DAMPING if damped else (1.0,),
            )
        )
    )
    chunk = max(1, _WIDTH // len(grid))
    if len(y) > chunk:
        parts = [smooth(y[i : i + chunk], period, trend, damped, season, horizon, refine=refine) for i in range(0, len(y), chunk)]
        return np.concatenate([part[0] for part in parts]), np.concatenate([part[1] for part in parts])
    n = y.shape[1]
    start = _opening(y, period, season, trend)
    squared = _run(y, start, tuple(grid.T), trend, season)[0]
    best, least = grid[np.argmin(squared, axis=1)], squared.min(axis=1)
    if refine:
        active = np.flatnonzero([True, trend, season is not None, damped])
        best, least = _refined(y, start, best, least, active, trend, season)
    _, level, slope, cycle = _run(y, start, tuple(best.T[:, :, None]), trend, season)
    phi, width = best[:, 3], cycle.shape[0]
    parameters = 2 + 2 * trend + damped + (1 + period if season else 0)
    steps = np.arange(1, horizon + 1)
    with np.errstate(all="ignore"):
        spread = np.maximum(least / n, 1e-12)
        penalty = 2 * parameters + 2 * parameters * (parameters + 1) / (n - parameters - 1) if n > parameters + 1 else np.inf
        criterion = n * np.log(spread) + penalty
        damping = np.cumsum(phi[:, None] ** steps, axis=1)
        path = level + damping * slope
        ahead = cycle[(n + steps - 1) % width][:, :, 0].T
        path = path * ahead if season == "mul" else path + ahead
    sound = np.isfinite(least) & np.isfinite(path).all(axis=1) & (n > parameters + 1)
    return np.where(sound, criterion, np.inf), path


def _best_shape(y: np.ndarray, period: int, shapes: list[tuple[str | None, bool, bool]], horizon: int) -> list[np.ndarray | None]:
    """Per window the path of the shape of lowest criterion, the first of equals;
    a multiplied season is only for windows above zero."""
    criteria = np.full((len(shapes), len(y)), np.inf)
    paths = np.zeros((len(shapes), len(y), horizon))
    positive = np.flatnonzero((y > 0).all(axis=1))
    for place, (season, trend, damped) in enumerate(shapes):
        fit = positive if season == "mul" else np.arange(len(y))
        if len(fit):
            criteria[place, fit], paths[place, fit] = smooth(y[fit], period, trend, damped, season, horizon)
    best = np.argmin(criteria, axis=0)
    return [paths[place, i] if np.isfinite(criteria[place, i]) else None for i, place in enumerate(best)]


def holt_winters_batch(y: np.ndarray, period: int, seasonal: bool, trending: bool, horizon: int) -> list[np.ndarray | None]:
    """The shape of lowest corrected information criterion, and its path."""
    n = y.shape[1]
    if n < 5:
        return [None] * len(y)
    seasons = ["add", "mul", None] if seasonal and period >= 2 and n >= 2 * period + 1 else [None]
    trends = [(True, True), (True, False), (False, False)] if trending else [(False, False), (True, True)]
    return _best_shape(y, period, [(season, *trend) for season in seasons for trend in trends], horizon)


def auto_ets_batch(y: np.ndarray, period: int, seasonal: bool, horizon: int) -> list[np.ndarray | None]:
    """Every admissible trend and season, damped or not, by the same criterion."""
    n = y.shape[1]
    if n < max(10, 3 * (5 + (period if seasonal else 0))):
        return [None] * len(y)
    seasons = [None, "add", "mul"] if seasonal and period >= 2 and n >= 2 * period + 1 else [None]
    trends = [(False, False), (True, False), (True, True)]
    return _best_shape(y, period, [(season, *trend) for season in seasons for trend in trends], horizon)


def theta_batch(y: np.ndarray, period: int, seasonal: bool, horizon: int) -> list[np.ndarray | None]:
    """Simple smoothing plus half the slope of the line through the history."""
    rows, n = y.shape
    if n < 6:
        return [None] * rows
    steps = np.arange(1, horizon + 1)
    index = ahead = None
    if seasonal and period >= 2 and n >= 2 * period + 1:
        multiplied = (y > 0).all(axis=1)[:, None]
        trend = _centred(y, period)
        with np.errstate(all="ignore"):
            rest = np.where(multiplied, y / trend, y - trend)
            pattern = np.stack([np.nanmean(rest[:, phase::period], axis=1) for phase in range(period)], axis=1)
            middle = pattern.mean(axis=1, keepdims=True)
            pattern = np.where(multiplied, pattern / middle, pattern - middle)
            index, ahead = pattern[:, np.arange(n) % period], pattern[:, (n + steps - 1) % period]
            y = np.where(multiplied, y / index, y - index)
    t = np.arange(n) - (n - 1) / 2
    slope = (y @ t / (t @ t))[:, None]
    weights = np.array(LEVEL_WEIGHTS)
    level, squared = np.repeat(y[:, :1], weights.size, axis=1), np.zeros((rows, weights.size))
    for i in range(1, n):
        value = y[:, i, None]
        squared += (value - level) ** 2
        level = weights * value + (1 - weights) * level
    best = np.argmin(squared, axis=1)
    a = weights[best][:, None]
    path = level[np.arange(rows), best][:, None] + slope / 2 * (steps - 1 + (1 - (1 - a) ** n) / a)
    if index is not None:
        path = np.where(multiplied, path * ahead, path + ahead)
    return list(path)


def holt_winters(y: np.ndarray, period: int, seasonal: bool, trending: bool, horizon: int) -> np.ndarray | None:
    return holt_winters_batch(y[None], period, seasonal, trending, horizon)[0]


def auto_ets(y: np.ndarray, period: int, seasonal: bool, horizon: int) -> np.ndarray | None:
    return auto_ets_batch(y[None], period, seasonal, horizon)[0]


def theta(y: np.ndarray, period: int, seasonal: bool, horizon: int) -> np.ndarray | None:
    return theta_batch(y[None], period, seasonal, horizon)[0]


def want_logs(y: np.ndarray, period: int) -> np.ndarray:
    """Whether blocks of each row's history spread in proportion to their level."""
    rows, n = y.shape
    width = period if period >= 2 else 4
    blocks = [y[:, i : i + width] for i in range(0, n, width) if min(width, n - i) >= 2]
    out = (y > 0).all(axis=1)
    if n < 8 or len(blocks) < 2:
        return np.zeros(rows, dtype=bool)
    positive = np.flatnonzero(out)
    means = np.stack([block[positive].mean(axis=1) for block in blocks], axis=1)
    spreads = np.stack([block[positive].std(axis=1, ddof=1) for block in blocks], axis=1)
    rated = np.full((len(positive), len(BOX_COX_GRID)), np.inf)
    for place, power in enumerate(BOX_COX_GRID):
        ratio = spreads / means ** (1 - power)
        middle = ratio.mean(axis=1)
        with np.errstate(all="ignore"):
            rated[:, place] = np.where(middle > 0, ratio.std(axis=1, ddof=1) / middle, np.inf)
    # The lowest power of equals; none where no block spreads at all.
    best = rated.argmin(axis=1)
    out[positive] = np.isfinite(rated.min(axis=1)) & (np.array(BOX_COX_GRID)[best] <= LOG_CEILING)
    return out


def wants_log(y: np.ndarray, period: int) -> bool:
    return bool(want_logs(y[None], period)[0])


def in_logs(y: np.ndarray, fit: Callable[[np.ndarray], list[np.ndarray | None]]) -> list[np.ndarray | None]:
    """Fit on logs; back with half the variance of the log moves, at most 0.5."""
    logged = np.log(y)
    variance = np.minimum(np.var(np.diff(logged, axis=1), axis=1, ddof=1), 1.0)
    return [None if path is None else np.exp(np.clip(path + half / 2, -700, 700)) for path, half in zip(fit(logged), variance)]

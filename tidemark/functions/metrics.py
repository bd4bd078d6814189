"""Error metrics as aggregate expressions over aligned actual and predicted.

A pair counts only where both are known; an empty group gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pair(t: Column, p: Column, value: Column) -> Column:
    return F.when(t.isNotNull() & p.isNotNull(), value)


def mae(t: Column, p: Column) -> Column:
    return F.avg(F.abs(t - p))


def rmse(t: Column, p: Column) -> Column:
    return F.sqrt(F.avg((t - p) * (t - p)))


def smape(t: Column, p: Column) -> Column:
    """For display only: it is undefined where both are zero, counted as 0."""
    scale = (F.abs(t) + F.abs(p)) / 2
    return F.avg(F.when(scale == 0, 0.0).otherwise(F.try_divide(F.abs(t - p), scale))) * 100


def bias(t: Column, p: Column) -> Column:
    return F.avg(p - t)


def relative_bias(t: Column, p: Column) -> Column:
    return F.try_divide(F.sum(p - t), F.sum(_pair(t, p, F.abs(t)))) * 100


def wmape(t: Column, p: Column, w: Column | None = None) -> Column:
    weight = F.lit(1.0) if w is None else F.coalesce(w, F.lit(0.0))
    return F.try_divide(F.sum(weight * F.abs(t - p)), F.sum(_pair(t, p, weight * F.abs(t)))) * 100


def mase(t: Column, p: Column, scale: Column) -> Column:
    """``scale`` is the in-sample seasonal step, one value per group."""
    return F.try_divide(mae(t, p), F.first(F.when(scale > 0, scale), ignorenulls=True))


def pinball(t: Column, p: Column, quantile: float) -> Column:
    q = min(max(float(quantile), 0.0), 1.0)
    return F.avg(F.greatest(q * (t - p), (q - 1) * (t - p)))


def crps(losses: dict[float, Column]) -> Column:
    """Pinball losses of several levels, each weighted by the span it stands for.

    Takes one column per level; a level without a loss is left out.
    """
    levels = sorted(losses)
    if not levels:
        return F.lit(None).cast("double")
    spans = {
        level: ((levels[i + 1] if i + 1 < len(levels) else 1.0) - (levels[i - 1] if i else 0.0)) / 2
        for i, level in enumerate(levels)
    }
    weighted = sum(F.coalesce(losses[q] * F.lit(spans[q]), F.lit(0.0)) for q in levels)
    weight = sum(F.when(losses[q].isNotNull(), F.lit(spans[q])).otherwise(0.0) for q in levels)
    return F.try_divide(weighted, weight) * 2


def coverage(t: Column, low: Column, high: Column) -> Column:
    return F.avg(t.between(low, high).cast("double")) * 100


def winkler_cost(t: Column, low: Column, high: Column, level: float) -> Column:
    """Width plus what a miss costs, for one row."""
    penalty = 2.0 / max(1e-6, 1.0 - float(level))
    miss = F.when(t < low, penalty * (low - t)).when(t > high, penalty * (t - high)).otherwise(0.0)
    return _pair(t, low + high, (high - low) + miss)


def winkler(t: Column, low: Column, high: Column, level: float) -> Column:
    return F.avg(winkler_cost(t, low, high, level))


def value_add(model_error: Column, baseline_error: Column) -> Column:
    """Improvement over a baseline in percent; negative if the baseline is better."""
    return F.try_divide(baseline_error - model_error, F.abs(baseline_error)) * 100


def accuracy(error: Column) -> Column:
    """100 - wMAPE; unmeasured from 100 on."""
    return F.when(error < 100, 100 - error)


def intervals_held(covered: Column, level: Column) -> Column:
    return covered + 1e-9 >= level * 100


def tracking_signal(forecast: Column, actual: Column, error: Column) -> Column:
    return F.when(error > 0, F.round((forecast - actual) / error, 2))

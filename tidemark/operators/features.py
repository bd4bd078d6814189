"""Features of a period that use only what came before it."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import DAILY, DS, SEASON, SERIES_ID, WEEKLY, Y


def feature_spec(n: int, frequency: str, *, seasonal: bool | None = None, period: int | None = None) -> dict:
    """Which lags and windows a history of n periods can carry."""
    p = period if period and period > 1 else SEASON[frequency]
    seasonal = n >= 2 * p + 4 if seasonal is None else seasonal
    lags = {1, 2, 3}
    if seasonal and n >= 2 * p + 4:
        lags |= {p - 1, p, p + 1}
    deep = seasonal and n >= 4 * p
    if deep:
        lags.add(2 * p)
    reach = max(2, n // 4)
    windows = sorted(w for w in ({3, 6, 12, p} if seasonal else {3, 6, 12}) if 2 <= w <= reach)
    return {
        "lags": sorted(lag for lag in lags if 1 <= lag < n) or [1],
        "windows": windows or [max(2, min(3, n // 3))],
        "seasonal_delta": p if deep else None,
    }


def calendar_features(day: Column, frequency: str) -> dict[str, Column]:
    """Month, weekday and week of the year as positions on a circle."""

    def circle(name: str, value: Column, length: float) -> dict[str, Column]:
        angle = F.lit(2 * pi) * value / length
        return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}

    out = {**circle("month", F.month(day), 12.0), "quarter": F.quarter(day).cast("double")}
    if frequency in (DAILY, WEEKLY):
        out |= circle("weekday", F.weekday(day), 7.0)
        out |= circle("week_of_year", F.weekofyear(day), 52.0)
    if frequency == DAILY:
        out["day_of_month"] = F.dayofmonth(day).cast("double")
        out["is_weekend"] = (F.weekday(day) >= 5).cast("double")
    return out


def history_features(
    lags: Sequence[int],
    windows: Sequence[int],
    *,
    seasonal_delta: int | None = None,
    keys: Sequence[str] = (SERIES_ID,),
    value: str = Y,
) -> dict[str, Column]:
    """Lags, trailing means and spreads, all closed before the period itself.

    A window with any hole is null. All share one window order, so a series is
    sorted once.
    """
    order = Window.partitionBy(*keys).orderBy(DS)
    y = F.col(value)
    out = {f"lag_{k}": F.lag(y, k).over(order) for k in lags}
    for k in windows:
        frame = order.rowsBetween(-k, -1)
        full = F.count(y).over(frame) == k
        mean = F.avg(y).over(frame)
        out[f"roll_mean_{k}"] = F.when(full, mean)
        out[f"roll_std_{k}"] = F.when(full, F.stddev_pop(y).over(frame))
        out[f"roll_delta_{k}"] = F.when(full, F.lag(y, 1).over(order) - mean)
    out["trend"] = (F.row_number().over(order) - 1).cast("double")
    if seasonal_delta:
        out["seasonal_delta"] = F.lag(y, seasonal_delta).over(order) - F.lag(y, 2 * seasonal_delta).over(order)
    return out


def design_matrix(
    panel: DataFrame,
    frequency: str,
    lags: Sequence[int],
    windows: Sequence[int],
    *,
    seasonal_delta: int | None = None,
    keys: Sequence[str] = (SERIES_ID,),
    complete: bool = True,
) -> tuple[DataFrame, list[str]]:
    """The panel with its features and their names; incomplete rows left out."""
    features = {
        **history_features(lags, windows, seasonal_delta=seasonal_delta, keys=keys),
        **calendar_features(F.col(DS), frequency),
    }
    names = sorted(features)
    built = panel.select("*", *[features[name].alias(name) for name in names])
    return (built.na.drop(subset=[*names, Y]) if complete else built), names

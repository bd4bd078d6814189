"""Filling and clipping a window of history from that window alone.

``keys`` name the window: a series for the final fit, a series and fold in a
backtest, so a training window never sees a period it is scored on.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import INTERMITTENT_SHARE, MAD_TO_SIGMA, OUTLIER_SIGMAS, SERIES_ID, Y
from tidemark.functions import arrays
from tidemark.functions.columns import ZERO_TOLERANCE, near_zero

MIN_POINTS = 5
FILLS = ("auto", "interpolate", "zero", "none")


def resolve_fill(window, fill: str) -> Column:
    """What ``auto`` means for a window: zero where demand is intermittent."""
    if fill != "auto":
        return F.lit(fill)
    known = F.count(Y).over(window)
    zeros = F.count_if(F.col(Y).isNotNull() & near_zero(F.col(Y))).over(window)
    return F.when((known == 0) | (zeros / known >= INTERMITTENT_SHARE), "zero").otherwise("interpolate")


def fill_gaps(panel: DataFrame, fill: str = "auto", *, keys: Sequence[str] = (SERIES_ID,)) -> DataFrame:
    """Replace null values; ``t`` is the position on the calendar.

    A hole between two readings lies on the line through them, one at either
    end carries the nearest reading.
    """
    if fill not in FILLS:
        raise ValueError(f"Unknown fill {fill!r}; use one of {', '.join(FILLS)}.")
    if fill == "none":
        return panel
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("t")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(Y).isNotNull(), F.struct("t", Y))
    marked = panel.select(
        "*",
        resolve_fill(whole, fill).alias("_fill"),
        F.last(known, ignorenulls=True).over(before).alias("_left"),
        F.first(known, ignorenulls=True).over(after).alias("_right"),
    )
    left, right = F.col("_left"), F.col("_right")
    slope = (right[Y] - left[Y]) / (right["t"] - left["t"])
    between = left[Y] + slope * (F.col("t") - left["t"])
    line = F.coalesce(F.when(left.isNotNull() & right.isNotNull(), between), left[Y], right[Y])
    filled = F.when(F.col("_fill") == "interpolate", F.coalesce(line, F.lit(0.0))).otherwise(F.lit(0.0))
    return marked.withColumn(Y, F.coalesce(F.col(Y), filled)).drop("_fill", "_left", "_right")


def winsorise(
    panel: DataFrame, sigmas: float = OUTLIER_SIGMAS, *, keys: Sequence[str] = (SERIES_ID,)
) -> DataFrame:
    """Clip to the median plus or minus so many robust deviations.

    A window is a series, which its calendar bounds, so its exact median fits
    in a task.
    """
    whole = Window.partitionBy(*keys)
    centred = panel.withColumn("_mid", F.median(Y).over(whole)).withColumn("_held", F.count(Y).over(whole))
    spread = centred.withColumn("_mad", F.median(F.abs(F.col(Y) - F.col("_mid"))).over(whole))
    reach = MAD_TO_SIGMA * F.col("_mad") * sigmas
    clipped = F.greatest(F.least(F.col(Y), F.col("_mid") + reach), F.col("_mid") - reach)
    applies = F.col(Y).isNotNull() & (F.col("_held") >= MIN_POINTS) & (F.col("_mad") > 0)
    return spread.withColumn(Y, F.when(applies, clipped).otherwise(F.col(Y))).drop("_mid", "_held", "_mad")


def filled_matrix(values: np.ndarray, known: np.ndarray, t: np.ndarray, fill: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows of values with their holes filled as `fill_gaps` does, and what is known of them."""
    if fill not in FILLS:
        raise ValueError(f"Unknown fill {fill!r}; use one of {', '.join(FILLS)}.")
    if fill == "none" or known.all():
        return values, known
    zeroed, full = np.where(known, values, 0.0), np.ones_like(known)
    if fill == "zero":
        return zeroed, full
    n = values.shape[1]
    at = np.arange(n)
    left = np.maximum.accumulate(np.where(known, at, -1), axis=1)
    right = np.minimum.accumulate(np.where(known, at, n)[:, ::-1], axis=1)[:, ::-1]
    none_left, none_right = left < 0, right == n
    left, right = np.maximum(left, 0), np.minimum(right, n - 1)
    before, after = np.take_along_axis(values, left, 1), np.take_along_axis(values, right, 1)
    start, end = np.take_along_axis(t, left, 1), np.take_along_axis(t, right, 1)
    with np.errstate(all="ignore"):
        line = before + (after - before) / (end - start) * (t - start)
    line = np.where(known, values, np.where(none_left, after, np.where(none_right, before, line)))
    line = np.where(none_left & none_right, 0.0, line)
    if fill == "interpolate":
        return line, full
    count = known.sum(axis=1)
    zeros = (known & (np.abs(values) <= ZERO_TOLERANCE)).sum(axis=1)
    rare = zeros >= INTERMITTENT_SHARE * np.maximum(count, 1)
    return np.where((rare | (count == 0))[:, None], zeroed, line), full


def clipped_matrix(values: np.ndarray, known: np.ndarray, sigmas: float) -> np.ndarray:
    """Rows of values clipped as `winsorise` does."""
    held = np.where(known, values, np.nan)
    mid = arrays.median(held)[:, None]
    mad = arrays.median(np.abs(held - mid))
    reach = (MAD_TO_SIGMA * mad * sigmas)[:, None]
    clipped = np.maximum(np.minimum(values, mid + reach), mid - reach)
    applies = known & ((known.sum(axis=1) >= MIN_POINTS) & (mad > 0))[:, None]
    return np.where(applies, clipped, values)


def prepared_matrix(values: np.ndarray, known: np.ndarray, t: np.ndarray, fill: str, sigmas: float | None) -> tuple[np.ndarray, np.ndarray]:
    filled, known = filled_matrix(values, known, t, fill)
    return (filled if sigmas is None else clipped_matrix(filled, known, sigmas)), known


def prepare_arrays(aligned: DataFrame, fill: str = "none", sigmas: float | None = None) -> DataFrame:
    """`prepare` for one row per series: adds ``values``, those of ``points``."""

    def made(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        offsets, values, known = arrays.flat(arrays.column(batch, "_y"))
        t = arrays.flat(arrays.column(batch, "_t"))[1]
        for _, places in arrays.by_length(offsets):
            values[places], known[places] = prepared_matrix(values[places], known[places], t[places], fill, sigmas)
        return {"values": arrays.lists(offsets, values, known)}

    sent = aligned.withColumn("_y", F.col(f"points.{Y}")).withColumn("_t", F.col("points.t"))
    return arrays.add_columns(sent, made, "values array<double>", ("_y", "_t"))


def prepare(
    panel: DataFrame,
    fill: str = "none",
    sigmas: float | None = None,
    *,
    keys: Sequence[str] = (SERIES_ID,),
) -> DataFrame:
    """Fill, then clip."""
    filled = fill_gaps(panel, fill, keys=keys)
    return filled if sigmas is None else winsorise(filled, sigmas, keys=keys)

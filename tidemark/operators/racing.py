"""A racing search over a model's settings: draws, rounds of folds, halving.

Settings are drawn from ranges with a seed. In every round the settings still in
the race are measured on one more fold of all series, and the worse part leaves:
costly settings are not carried through folds they have lost already. What
happened is one frame (candidate, fold, error), from which each round's blended
score follows: the mean over the folds so far of the error relative to the best
setting's of that fold, and a share of the worst fold.

A fold's predictions are rows that Spark spreads: windows times the settings
alive, both sides of which are bounded, the settings by the draw and a window's
values by its calendar.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import SERIES_ID
from tidemark.operators import backtest
from tidemark.session import cut_lineage

#: Settings drawn, the share that stays after a round, and the least that go on.
DRAWS = 16
KEEP = 0.5
FEWEST = 2
#: Weight of the worst fold beside the mean over folds.
WORST_WEIGHT = 0.25

Settings = dict[str, float]
#: y (rows, n), period, seasonal, trending, horizon, settings to a path, or none, a row.
Fit = Callable[[np.ndarray, int, bool, bool, int, Settings], Sequence[np.ndarray | None]]


def draw(ranges: Mapping[str, tuple[float, float]], count: int = DRAWS, seed: int = 7) -> list[Settings]:
    """``count`` settings, each value even over its range, or over its logarithm
    where the range spans more than a factor of 100; rounded to four places."""
    source = random.Random(seed)
    out = []
    for _ in range(count):
        settings = {}
        for name, (low, high) in ranges.items():
            if low > 0 and high / low > 100:
                value = float(np.exp(source.uniform(np.log(low), np.log(high))))
            else:
                value = source.uniform(low, high)
            settings[name] = round(value, 4)
        out.append(settings)
    return out


@dataclass(frozen=True)
class Race:
    """``errors``: candidate, fold, error, rows; ``rounds``: candidate, round,
    score, rank, stays; the winner's number and settings."""

    errors: DataFrame
    rounds: DataFrame
    winner: int | None
    settings: Settings | None


def fold_errors(windows: DataFrame, fit: Fit, drawn: Sequence[Settings], alive: Sequence[int], fold: int) -> DataFrame:
    """candidate, fold, error, rows: the weighted absolute error of each setting
    over all series of a fold. A series that some setting alive cannot follow
    counts for none of them."""
    own = windows.filter((F.col("fold") == fold) & F.col("whole"))
    trials = [(number, dict(drawn[number])) for number in alive]

    @F.pandas_udf("array<array<double>>")
    def paths(values: pd.Series, shapes: pd.DataFrame, horizons: pd.Series) -> pd.Series:
        held = [np.asarray(value, dtype=float) for value in values]
        alike: dict[tuple, list[int]] = {}
        for i, (y, period, season, trend, h) in enumerate(zip(held, shapes["period"], shapes["has_season"], shapes["has_trend"], horizons)):
            if y.size >= 2 and np.isfinite(y).all():
                alike.setdefault((y.size, int(period), bool(season), bool(trend), int(h)), []).append(i)
        out: list[list[np.ndarray | None]] = [[None] * len(trials) for _ in held]
        for (_, period, season, trend, h), places in alike.items():
            y = np.stack([held[i] for i in places])
            for at, (_, settings) in enumerate(trials):
                for i, path in zip(places, fit(y, period, season, trend, h, settings)):
                    out[i][at] = path
        return pd.Series(out)

    made = own.withColumn("_paths", paths(F.col("train"), F.col("shape"), F.col("test_horizon")))
    # All settings or none of a series, so that they are compared on the same rows.
    whole = made.filter(~F.exists("_paths", lambda path: path.isNull()))
    numbers = F.array(*[F.lit(number) for number, _ in trials])
    each = whole.select("test", F.explode(F.arrays_zip(numbers.alias("candidate"), F.col("_paths").alias("path"))).alias("_t")).select("test", "_t.*")
    seen = each.select("candidate", "path", F.explode("test").alias("_p")).filter(F.col("_p.y").isNotNull())
    miss = F.abs(F.col("_p.y") - F.get("path", F.col("_p.step") - 1))
    summed = seen.groupBy("candidate").agg(F.sum(miss).alias("_miss"), F.sum(F.abs(F.col("_p.y"))).alias("_size"), F.count("*").alias("rows"))
    return summed.select("candidate", F.lit(fold).alias("fold"), F.try_divide("_miss", "_size").alias("error"), "rows")


def standings(errors: DataFrame, keep: float = KEEP, fewest: int = FEWEST) -> DataFrame:
    """candidate, round, score, rank, stays, from (candidate, fold, error).

    Round r goes by the folds up to the r-th and the settings that have all of
    them. Errors are measured against the best of their fold, so that a hard fold
    weighs no more than an easy one. Of equal scores the earlier draw is ahead.
    """
    fold = Window.partitionBy("fold")
    rated = errors.withColumn("_against", F.coalesce(F.try_divide(F.col("error"), F.min("error").over(fold)), F.lit(1.0)))
    rated = rated.withColumn("round", F.dense_rank().over(Window.partitionBy("candidate").orderBy("fold")))
    so_far = Window.partitionBy("candidate").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    score = (1 - WORST_WEIGHT) * F.avg("_against").over(so_far) + WORST_WEIGHT * F.max("_against").over(so_far)
    scored = rated.withColumn("score", score)
    race = Window.partitionBy("round")
    ranked = scored.withColumn("rank", F.row_number().over(race.orderBy(F.asc_nulls_last("score"), "candidate")))
    left = F.greatest(F.lit(fewest), F.ceil(F.count("*").over(race) * keep))
    last = F.col("round") == F.max("round").over(Window.partitionBy())
    stays = F.when(last, F.col("rank") == 1).otherwise(F.col("rank") <= left)
    return ranked.select("candidate", "round", "score", "rank", stays.alias("stays"))


def race(windows: DataFrame, fit: Fit, drawn: Sequence[Settings], *, keep: float = KEEP, fewest: int = FEWEST) -> Race:
    """Race the settings over the scored folds of ``windows``, oldest first.

    Windows need train, test, shape, whole and test_horizon. The driver holds the
    numbers of the settings alive; without a fold there is no winner.
    """
    folds = [row.fold for row in windows.filter(F.col("fold").between(0, backtest.FINAL_FOLD - 1)).select("fold").distinct().orderBy("fold").collect()]
    alive = list(range(len(drawn)))
    errors: DataFrame | None = None
    for place, fold in enumerate(folds):
        measured = cut_lineage(fold_errors(windows, fit, drawn, alive, fold), "race")
        errors = measured if errors is None else errors.unionByName(measured)
        current = standings(errors, keep, fewest).filter(F.col("round") == place + 1)
        if place + 1 < len(folds):
            left = max(fewest, -int(-len(alive) * keep // 1))
            alive = [row.candidate for row in current.filter(F.col("rank") <= left).select("candidate").collect()] or alive
            alive.sort()
    if errors is None:
        empty = windows.limit(0).select(F.lit(0).alias("candidate"), F.col("fold"), F.lit(0.0).alias("error"), F.lit(0).cast("long").alias("rows"))
        return Race(empty, standings(empty, keep, fewest), None, None)
    rounds = standings(errors, keep, fewest)
    best = rounds.filter(F.col("stays")).orderBy(F.desc("round"), "rank").first()
    return Race(errors, rounds, best.candidate if best else None, dict(drawn[best.candidate]) if best else None)


def smoothing_fit(y: np.ndarray, period: int, seasonal: bool, trending: bool, horizon: int, settings: Settings) -> list[np.ndarray]:
    """Exponential smoothing with given weights: ``level``, ``trend`` and
    ``damping`` of the trend. Starts from the first value and no trend."""
    level, slope = y[:, 0].copy(), np.zeros(len(y))
    a, b, phi = settings["level"], settings.get("trend", 0.0), settings.get("damping", 1.0)
    for i in range(1, y.shape[1]):
        base = level + phi * slope
        following = base + a * (y[:, i] - base)
        slope = phi * slope + b * (following - base)
        level = following
    reach = np.cumsum(phi ** np.arange(1, horizon + 1))
    return list(level[:, None] + slope[:, None] * reach)


__all__ = ["Race", "SERIES_ID", "draw", "fold_errors", "race", "smoothing_fit", "standings"]

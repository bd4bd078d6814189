"""Forecasters as column expressions over a window's array of values.

Each takes the training array and how many steps are wanted and gives the array
of predictions, or null where the window cannot carry the model. They run in
the JVM; models that need an optimiser are in :mod:`tidemark.operators.smoothing`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import DS, SERIES_ID

ALPHAS = (0.05, 0.1, 0.15, 0.2, 0.3)


def _steps(horizon: Column | int) -> Column:
    wanted = F.lit(horizon) if isinstance(horizon, int) else horizon
    return F.sequence(F.lit(1), wanted)


def naive(train: Column, horizon: Column | int, has_trend: Column | None = None) -> Column:
    """The last value, drifting where the series has a trend."""
    n = F.size(train)
    last, first = F.get(train, n - 1), F.get(train, F.lit(0))
    drift = F.lit(0.0)
    if has_trend is not None:
        drift = F.when(has_trend & (n >= 4), (last - first) / (n - 1)).otherwise(0.0)
    return F.when(n >= 1, F.transform(_steps(horizon), lambda s: last + drift * s))


def seasonal_naive(
    train: Column, horizon: Column | int, period: Column, has_trend: Column | None = None
) -> Column:
    """The last season again, drifting from one season to the next."""
    n = F.size(train)
    season = F.slice(train, F.greatest(n - period + 1, F.lit(1)), period)
    drift = F.lit(0.0)
    if has_trend is not None:
        before = F.slice(train, F.greatest(n - 2 * period + 1, F.lit(1)), period)
        move = (_mean(season) - _mean(before)) / period
        drift = F.when(has_trend & (n >= 2 * period), move).otherwise(0.0)
    path = F.transform(_steps(horizon), lambda s: F.get(season, F.pmod(s - 1, period)) + drift * s)
    return F.when(n >= period, path)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def _sizes_and_gaps(hits: Column, opens: Column) -> Column:
    """Array of (size, gap): demands and the periods since the one before."""
    before = F.concat(F.array(opens - 1), F.transform(hits, lambda h: h["t"]))
    return F.zip_with(
        hits,
        F.slice(before, F.lit(1), F.size(hits)),
        lambda h, b: F.struct(h["y"].alias("size"), (h["t"] - b).cast("double").alias("gap")),
    )


def _croston_state(hits: Column, alpha: Column) -> Column:
    rest = F.slice(hits, F.lit(2), F.greatest(F.size(hits) - 1, F.lit(0)))
    first = F.get(hits, F.lit(0))
    floor = F.lit(1e-9)
    return F.aggregate(
        rest,
        F.struct(first["size"].alias("size"), first["gap"].alias("gap"), F.lit(0.0).alias("miss")),
        lambda a, h: F.struct(
            (alpha * h["size"] + (1 - alpha) * a["size"]).alias("size"),
            (alpha * h["gap"] + (1 - alpha) * a["gap"]).alias("gap"),
            (
                a["miss"]
                + F.pow(h["size"] / F.greatest(h["gap"], floor) - a["size"] / F.greatest(a["gap"], floor), F.lit(2))
            ).alias("miss"),
        ),
    )


def add_croston(windows: DataFrame, *, name: str = "croston") -> DataFrame:
    """Adds a struct column (alpha, size, gap, rate), null below two demands.

    Intermittent demand with the bias correction of Syntetos and Boylan: sizes
    and gaps are smoothed apart, by the weight whose one-step rates missed
    least. Only the demands themselves are walked, not the empty periods.
    """
    staged = windows.withColumn("_hits", _sizes_and_gaps(F.col("hits"), F.col("opens")))
    fits = F.transform(
        F.array(*[F.lit(a) for a in ALPHAS]),
        lambda a: F.struct(_croston_state(F.col("_hits"), a).alias("s"), a.alias("alpha")),
    )
    enough = F.size("_hits") >= 2
    staged = staged.withColumn("_fits", F.when(enough, fits))
    ranked = F.transform(
        "_fits",
        lambda f: F.struct(
            f["s"]["miss"].alias("miss"), f["alpha"].alias("alpha"), f["s"]["size"].alias("size"), f["s"]["gap"].alias("gap")
        ),
    )
    best = F.array_min(ranked)
    staged = staged.withColumn("_best", best)
    gap = F.greatest(F.col("_best.gap"), F.lit(1e-9))
    rate = F.col("_best.size") / gap * (1 - F.col("_best.alpha") / 2)
    return staged.withColumn(
        name,
        F.when(
            F.col("_best").isNotNull(),
            F.struct(F.col("_best.alpha").alias("alpha"), F.col("_best.size").alias("size"), gap.alias("gap"), rate.alias("rate")),
        ),
    ).drop("_hits", "_fits", "_best")


def flat(rate: Column, horizon: Column | int) -> Column:
    return F.when(rate.isNotNull(), F.transform(_steps(horizon), lambda s: rate))


def blend(paths: Sequence[Column], weights: Sequence[Column]) -> Column:
    """Weighted mean of several prediction arrays, step by step."""
    total = sum(weights[1:], weights[0])

    def scaled_by(path: Column, weight: Column) -> Column:
        return F.transform(path, lambda p: p * weight / total)

    scaled = [scaled_by(path, weight) for path, weight in zip(paths, weights)]
    out = scaled[0]
    for other in scaled[1:]:
        out = F.zip_with(out, other, lambda a, b: a + b)
    return out


def median_blend(predictions: DataFrame, value: str = "y_pred") -> DataFrame:
    """Median over the models of each series and step."""
    return predictions.groupBy(SERIES_ID, "step").agg(F.median(value).alias(value))


def in_sample(panel: DataFrame, period: int) -> DataFrame:
    """Fitted values of the lag models: the actual one period earlier."""
    from pyspark.sql import Window

    from tidemark.constants import Y

    order = Window.partitionBy(SERIES_ID).orderBy(DS)
    return panel.withColumn("fitted", F.lag(Y, max(1, period)).over(order))


def log_shift(low: Column) -> Column:
    """What to add before taking logs."""
    return F.when(low > 0, 0.0).otherwise(F.abs(low) + 1.0)


def to_log(value: Column, shift: Column) -> Column:
    return F.log(F.greatest(value + shift, F.lit(1e-9)))


def from_log(value: Column, shift: Column, variance: Column) -> Column:
    """Back from logs, corrected by half the variance of the log moves."""
    corrected = value + F.when(variance > 0, variance / 2).otherwise(0.0)
    return F.exp(F.greatest(F.least(corrected, F.lit(700.0)), F.lit(-700.0))) - shift

"""The open interface of forecasters: what a model is called and how it predicts.

A forecaster is a name, the shortest window it takes, the demand classes it may
serve and a way to its paths, one of three:

``expression``
    a Column over the window's own columns, for what the JVM can express;
``batch``
    a function over all windows of one length and shape, (rows, n) to one path
    each, run by one Arrow function for all such forecasters asked for;
``per_cut``
    a function from the windows to rows (series_id, fold, path), for models
    fitted over all series up to a cut.

``register`` adds one. Rosters, routing, backtests, selection and bands go by the
names that are asked for and look everything else up here; their order of
registration is their order of simplicity.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import COMPLEXITY_PENALTY, PARAMETER_BUDGET, SEASON, SERIES_ID
from tidemark.operators import arma, models, regression, smoothing

#: Demand classes (fixed values): those with demand in most periods, those without.
STEADY = ("smooth", "erratic")
RARE = ("intermittent", "lumpy")
EVERY = (*STEADY, *RARE, "no_demand")

Path = Callable[[Column, Column, Column, Column], Column]
#: y (rows, n), period, seasonal, trending, horizon to one path, or none, a row.
Batch = Callable[[np.ndarray, int, bool, bool, int], list[np.ndarray | None]]
#: windows, frequency, steps to rows (series_id, fold, path).
PerCut = Callable[[DataFrame, str, Column], DataFrame]


@dataclass(frozen=True)
class Forecaster:
    """``expression(train, steps, period, has_trend)`` gives a path column; columns
    it needs beside those are added by ``prepare``."""

    name: str
    min_history: int = 1
    classes: tuple[str, ...] = EVERY
    expression: Path | None = None
    prepare: Callable[[DataFrame], DataFrame] | None = None
    batch: Batch | None = None
    #: Whether a batch forecaster is fitted on logs where the window asks for them.
    logs: bool = False
    per_cut: PerCut | None = None
    #: What a selection adds to its score, and how many periods a parameter needs.
    complexity: float = 0.0
    parameters: float = 4.0
    #: Stands in where no candidate could be tested.
    baseline: bool = False

    def __post_init__(self) -> None:
        if sum(way is not None for way in (self.expression, self.batch, self.per_cut)) != 1:
            raise ValueError(f"Forecaster {self.name} needs one way to its paths.")
        if not self.name.isidentifier():
            raise ValueError(f"{self.name!r} cannot name a column.")


_HELD: dict[str, Forecaster] = {}


def register(forecaster: Forecaster, *, replace: bool = False) -> Forecaster:
    if forecaster.name in _HELD and not replace:
        raise ValueError(f"Forecaster {forecaster.name} is registered already.")
    _HELD[forecaster.name] = forecaster
    COMPLEXITY_PENALTY.setdefault(forecaster.name, forecaster.complexity)
    PARAMETER_BUDGET.setdefault(forecaster.name, forecaster.parameters)
    return forecaster


def unregister(name: str) -> None:
    gone = _HELD.pop(name)
    if COMPLEXITY_PENALTY.get(name) == gone.complexity:
        COMPLEXITY_PENALTY.pop(name)
    if PARAMETER_BUDGET.get(name) == gone.parameters:
        PARAMETER_BUDGET.pop(name)


def known() -> tuple[str, ...]:
    return tuple(_HELD)


def named(names: Sequence[str]) -> list[Forecaster]:
    missing = [name for name in names if name not in _HELD]
    if missing or not names:
        raise ValueError(f"Unknown models: {', '.join(missing) or 'none given'}.")
    return [_HELD[name] for name in names]


def allowed(demand_class: Column, names: Sequence[str]) -> Column:
    """The names a demand class may reach, as an array; a baseline always may."""
    asked = named(names)
    out = F.array(*[F.lit(name) for name in names])
    for kind in EVERY:
        may = [one.name for one in asked if kind in one.classes]
        may = may or [one.name for one in asked if one.baseline] or [next(name for name, one in _HELD.items() if one.baseline)]
        out = F.when(demand_class == kind, F.array(*[F.lit(name) for name in may])).otherwise(out)
    return out


def baselines() -> tuple[str, ...]:
    return tuple(name for name, one in _HELD.items() if one.baseline)


def season_of(frequency: str) -> Column:
    """The window's season where it has one, otherwise the calendar's, as far as the window reaches."""
    least = F.least(F.size("train"), F.lit(SEASON[frequency]))
    return F.greatest(F.when(F.col("shape.period") > 1, F.col("shape.period")).otherwise(least), F.lit(1))


def together(windows: DataFrame) -> DataFrame:
    """Windows of one length and shape side by side, in tasks of like numbers of
    windows: a batch then holds few kinds, each of which is fitted at once."""
    tasks = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Seasons are dear to fit, so they come first.
    kind = [F.desc("shape.has_season"), F.desc("shape.has_trend"), F.size("train"), F.col("shape.period")]
    return windows.repartitionByRange(tasks, *kind, F.xxhash64(SERIES_ID, "fold"))


def _batches(asked: Sequence[Forecaster], train: Column, shape: Column, steps: Column) -> Column:
    """struct of one array a forecaster; windows of one length and shape together."""
    fields = ",".join(f"{one.name}:array<double>" for one in asked)
    # Only functions travel to the executors.
    fits = [(one.name, one.min_history, one.logs, one.batch) for one in asked]

    @F.pandas_udf(f"struct<{fields}>")
    def paths(values: pd.Series, shapes: pd.DataFrame, horizons: pd.Series) -> pd.DataFrame:
        windows = [np.asarray(held, dtype=float) for held in values]
        shaped: dict[tuple, list[int]] = {}
        for i, (y, period, season, trend, h) in enumerate(zip(windows, shapes["period"], shapes["has_season"], shapes["has_trend"], horizons)):
            if y.size >= 2 and np.isfinite(y).all():
                shaped.setdefault((y.size, int(period), bool(season), bool(trend), int(h)), []).append(i)
        alike: dict[tuple, list[int]] = {}
        for key, places in shaped.items():
            logs = smoothing.want_logs(np.stack([windows[i] for i in places]), key[1])
            for logged in (False, True):
                own = [i for i, log in zip(places, logs) if log == logged]
                if own:
                    alike[*key, logged] = own
        out = {name: [None] * len(windows) for name, *_ in fits}
        for (n, period, season, trend, h, logged), places in alike.items():
            y = np.stack([windows[i] for i in places])
            for name, least, logs, batch in fits:
                if n < least:
                    continue

                def fit(held: np.ndarray, batch=batch, period=period, season=season, trend=trend, h=h) -> list[np.ndarray | None]:
                    return batch(held, period, season, trend, h)

                for i, path in zip(places, smoothing.in_logs(y, fit) if logged and logs else fit(y)):
                    out[name][i] = path
        return pd.DataFrame(out, columns=[name for name, *_ in fits])

    return paths(train, shape, steps)


def add_paths(windows: DataFrame, names: Sequence[str], frequency: str, steps: Column) -> DataFrame:
    """Adds ``paths``: a struct with one array a name, null where a window cannot
    carry the model. Windows need train, shape and the columns of a window."""
    asked = named(names)
    # The fallback of rare demand needs its rate whatever is asked for.
    staged = windows if "croston" in windows.columns else models.add_croston(windows)
    for prepare in dict.fromkeys(one.prepare for one in asked if one.prepare and one.prepare is not models.add_croston):
        staged = prepare(staged)
    batched = [one for one in asked if one.batch]
    if batched:
        staged = staged.withColumn("_batched", _batches(batched, F.col("train"), F.col("shape"), steps))
    fitted = [one for one in asked if one.per_cut]
    for one in fitted:
        rows = one.per_cut(windows, frequency, steps).select(SERIES_ID, "fold", F.col("path").alias(f"_cut_{one.name}"))
        staged = staged.join(rows, [SERIES_ID, "fold"], "left")
    columns = []
    for one in asked:
        if one.expression:
            path = one.expression(F.col("train"), steps, season_of(frequency), F.col("shape.has_trend"))
        elif one.batch:
            path = F.col(f"_batched.{one.name}")
        else:
            path = F.col(f"_cut_{one.name}")
        columns.append(F.when(F.size("train") >= one.min_history, path).cast("array<double>").alias(one.name))
    dropped = ["_batched", *[f"_cut_{one.name}" for one in fitted]]
    return staged.withColumn("paths", F.struct(*columns)).drop(*dropped)


def paths_of(names: Sequence[str]) -> dict[str, Column]:
    return {one.name: F.col(f"paths.{one.name}") for one in named(names)}


def path_by_name(names: Sequence[str], name: Column) -> Column:
    """The path of the forecaster that ``name`` names in each row."""
    out = F.lit(None).cast("array<double>")
    for one, path in paths_of(names).items():
        out = F.when(name == one, path).otherwise(out)
    return out


def fallback(demand_class: Column, frequency: str, steps: Column) -> tuple[Column, Column]:
    """The baseline for a window no candidate could be tested on: its name and path.

    Rare demand repeats its rate, a history of two seasons its last season, any
    other its last value.
    """
    history = F.transform("train", lambda v: F.coalesce(v, F.lit(0.0)))
    name = F.when(demand_class.isin(*RARE, "no_demand"), "croston").when(F.size("train") >= 2 * SEASON[frequency], "seasonal_naive").otherwise("naive")
    plain = {
        "croston": models.flat(F.col("croston.rate"), steps),
        "seasonal_naive": models.seasonal_naive(history, steps, F.lit(SEASON[frequency])),
        "naive": models.naive(history, steps),
    }
    path = F.lit(None).cast("array<double>")
    for one, column in plain.items():
        path = F.when(name == one, column).otherwise(path)
    return name, path


register(Forecaster("naive", expression=lambda train, steps, period, trend: models.naive(train, steps, trend), baseline=True))
register(Forecaster("seasonal_naive", expression=models.seasonal_naive, baseline=True))
register(Forecaster("holt_winters", 5, STEADY, batch=smoothing.holt_winters_batch, logs=True))
register(Forecaster("ets", 10, STEADY, batch=lambda y, period, seasonal, trending, horizon: smoothing.auto_ets_batch(y, period, seasonal, horizon), logs=True))
register(Forecaster("theta", 6, STEADY, batch=lambda y, period, seasonal, trending, horizon: smoothing.theta_batch(y, period, seasonal, horizon), logs=True))
register(
    Forecaster(
        "croston",
        8,
        RARE,
        expression=lambda train, steps, period, trend: models.flat(F.col("croston.rate"), steps),
        prepare=models.add_croston,
    )
)
register(Forecaster("arma_regression", arma.SHORTEST, STEADY, batch=arma.regression_batch, logs=True, complexity=0.03, parameters=8.0))
# Dear to fit, so it stands in no roster; a run that asks for it gets it.
register(Forecaster("gradient_boosting", 2 * max(regression.LAGS), STEADY, per_cut=regression.trees_per_cut))

#: The candidates of a leaf of a fan-out, and of a single run, simplest first (fixed values).
LEAF_ROSTER = ("naive", "seasonal_naive", "theta", "holt_winters", "croston")
FULL_ROSTER = ("naive", "seasonal_naive", "holt_winters", "ets", "theta", "croston", "arma_regression")

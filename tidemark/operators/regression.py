"""One model for all series: boosted trees and linear regression on features.

The trees learn from the feature rows of every series at once, so the fit is a
distributed job. Forecasts go forward step by step: a series is one row with
its latest values, the next prediction is appended to them, and no step needs
a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Model
from pyspark.ml.base import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import DS, SERIES_ID, Y
from tidemark.functions import metrics
from tidemark.functions.dates import add_periods
from tidemark.operators.features import calendar_features, design_matrix
from tidemark.session import cut_lineage

LAGS = (1, 2, 3, 6, 12)
WINDOWS = (3, 6, 12)


def gradient_boosting(depth: int = 3, rounds: int = 30, rate: float = 0.1) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol=Y, maxDepth=depth, maxIter=rounds, stepSize=rate, seed=7)


def linear(regularisation: float = 0.0) -> LinearRegression:
    return LinearRegression(featuresCol="features", labelCol=Y, regParam=regularisation)


def training_rows(panel: DataFrame, frequency: str, lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS):
    """Feature rows scaled by each series' own level, and the feature names.

    Series of very different size share a model once each is measured against
    its own mean.
    """
    level = panel.groupBy(SERIES_ID).agg(F.avg(F.abs(Y)).alias("_level"))
    scaled = panel.join(level, SERIES_ID).filter(F.col("_level") > 0)
    scaled = scaled.withColumn(Y, F.col(Y) / F.col("_level"))
    return design_matrix(scaled, frequency, lags, windows)


def fit(rows: DataFrame, names: Sequence[str], estimator: Estimator) -> tuple[VectorAssembler, Model]:
    assembler = VectorAssembler(inputCols=list(names), outputCol="features")
    return assembler, estimator.fit(assembler.transform(rows).select("features", Y))


def _latest(panel: DataFrame, keep: int) -> DataFrame:
    """One row per series: its level, last date, length and latest values, and why
    the model cannot follow it, if so."""
    packed = panel.groupBy(SERIES_ID).agg(
        F.array_sort(F.collect_list(F.struct(DS, Y))).alias("_h"), F.avg(F.abs(Y)).alias("_level")
    )
    return packed.select(
        SERIES_ID,
        F.when(F.col("_level").isNull(), "no value")
        .when(F.col("_level") == 0, "all values are zero")
        .when(F.size("_h") < keep, "history is too short")
        .alias("reason"),
        F.element_at(F.filter("_h", lambda p: p[Y].isNotNull()), -1)[Y].alias("_newest"),
        "_level",
        F.element_at("_h", -1)[DS].alias("_last"),
        F.size("_h").alias("_n"),
        F.transform(
            F.slice("_h", F.greatest(F.size("_h") - keep + 1, F.lit(1)), F.lit(keep)), lambda p: p[Y] / F.col("_level")
        ).alias("_v"),
    )


def _walk(
    state: DataFrame, keys: Sequence[str], steps: int, frequency: str, assembler: VectorAssembler, model: Model, lags: Sequence[int], windows: Sequence[int]
) -> DataFrame:
    """Feeds predictions back in, step by step: keys, _last, _level and _p, the
    predictions against the level. ``state`` has keys, _level, _last, _n and the
    latest values _v, against the level."""
    keep = max(*lags, *windows)
    state = state.select(*keys, "_level", "_last", "_n", "_v", F.array().cast("array<double>").alias("_p"))

    def last(k: int) -> Column:
        return F.element_at("_v", -k)

    def tail(k: int) -> Column:
        return F.slice("_v", -k, k)

    for step in range(1, steps + 1):
        day = add_periods(F.col("_last"), step, frequency)
        columns = {f"lag_{k}": last(k) for k in lags}
        for k in windows:
            mean = F.aggregate(tail(k), F.lit(0.0), lambda a, v: a + v) / k
            square = F.aggregate(tail(k), F.lit(0.0), lambda a, v: a + v * v) / k
            columns[f"roll_mean_{k}"] = mean
            columns[f"roll_std_{k}"] = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
            columns[f"roll_delta_{k}"] = last(1) - mean
        columns["trend"] = (F.col("_n") + step - 1).cast("double")
        columns |= calendar_features(day, frequency)
        featured = assembler.transform(state.withColumns({n: columns[n] for n in assembler.getInputCols()}))
        predicted = model.transform(featured)
        grown = F.concat(F.slice("_v", -(keep - 1), keep - 1), F.array("prediction"))
        state = predicted.select(*keys, "_level", "_last", "_n", grown.alias("_v"), F.concat("_p", F.array("prediction")).alias("_p"))
    return state


def forecast(
    panel: DataFrame,
    frequency: str,
    horizon: int,
    assembler: VectorAssembler,
    model: Model,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
) -> DataFrame:
    """series_id, step, ds, forecast, reason by feeding predictions back in.

    A series the model cannot follow repeats its newest value, and reason says
    why it had to; without any value its forecast is null.
    """
    latest = _latest(panel, max(*lags, *windows))
    held = latest.filter(F.col("reason").isNotNull()).select(
        SERIES_ID, "_last", "_newest", "reason", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    )
    state = _walk(latest.filter(F.col("reason").isNull()), [SERIES_ID], horizon, frequency, assembler, model, lags, windows)
    spread = state.select(SERIES_ID, "_last", "_level", F.posexplode("_p").alias("_i", "_y"))
    followed = spread.select(
        SERIES_ID,
        (F.col("_i") + 1).alias("step"),
        add_periods(F.col("_last"), F.col("_i") + 1, frequency).alias(DS),
        (F.col("_y") * F.col("_level")).alias("forecast"),
        F.lit(None).cast("string").alias("reason"),
    )
    repeated = held.select(
        SERIES_ID, "step", add_periods(F.col("_last"), F.col("step"), frequency).alias(DS), F.col("_newest").alias("forecast"), "reason"
    )
    return followed.unionByName(repeated)


#: Share of a fold's windows that may end before the fold's model does.
EARLY = 0.05


def cut_days(windows: DataFrame, early: float = EARLY) -> dict[int, object]:
    """Per fold the day up to which its model learns: the earliest on or before
    which more than ``early`` of the fold's windows end. One row per fold and day
    comes to the driver, which the calendar bounds."""
    counts: dict[int, list] = {}
    for row in windows.filter(F.col("fold") >= 0).groupBy("fold", "last_ds").count().orderBy("fold", "last_ds").collect():
        counts.setdefault(row.fold, []).append((row.last_ds, row["count"]))
    out = {}
    for fold, days in counts.items():
        seen, total = 0, sum(n for _, n in days)
        for day, n in days:
            seen += n
            if seen > early * total:
                out[fold] = day
                break
    return out


def trees_per_cut(
    windows: DataFrame,
    frequency: str,
    steps: Column,
    *,
    estimator: Callable[[], Estimator] = gradient_boosting,
    early: float = EARLY,
    lags: Sequence[int] = LAGS,
    spans: Sequence[int] = WINDOWS,
) -> DataFrame:
    """series_id, fold, path: trees fitted over all series for each fold, and carried on.

    A fold's model knows the training rows of its windows up to one day and
    nothing later; levels, holes and features are those of the windows. Windows
    that end before that day, at most ``early`` of a fold, and those too short
    for the features have no path.
    """
    ended = windows.filter(F.col("fold") >= 0)
    days = cut_days(windows, early)
    keep = max(*lags, *spans)
    known = F.transform(F.slice("train", -keep, keep), lambda v: v / F.col("_level"))
    level = F.aggregate("train", F.lit(0.0), lambda a, v: a + F.abs(v)) / F.size("train")
    fit_for = ended.filter((F.size("train") >= keep) & F.col("whole")).withColumn("_level", level).filter(F.col("_level") > 0)
    state = fit_for.select(SERIES_ID, "fold", "_level", F.col("last_ds").alias("_last"), F.size("train").alias("_n"), known.alias("_v"))
    most = windows.agg(F.max(steps).alias("steps")).first()["steps"] or 0
    out = windows.limit(0).select(SERIES_ID, "fold", F.array().cast("array<double>").alias("path"))
    for fold, day in sorted(days.items()):
        own = ended.filter(F.col("fold") == fold).select(SERIES_ID, "last_ds", F.size("train").alias("_n"), F.posexplode("train").alias("_i", Y))
        panel = own.select(SERIES_ID, add_periods(F.col("last_ds"), F.col("_i") - F.col("_n") + 1, frequency).alias(DS), Y)
        rows, names = training_rows(panel.filter(F.col(DS) <= F.lit(day)), frequency, lags, spans)
        rows = cut_lineage(rows, "features")
        if not rows.limit(1).count():
            continue
        assembler, model = fit(rows, names, estimator())
        asked = state.filter((F.col("fold") == fold) & (F.col("_last") >= F.lit(day)))
        walked = _walk(asked, [SERIES_ID, "fold"], most, frequency, assembler, model, lags, spans)
        paths = walked.select(SERIES_ID, "fold", F.transform("_p", lambda v: v * F.col("_level")).alias("path"))
        out = out.unionByName(cut_lineage(paths, "trees"))
    return out


def tune(
    rows: DataFrame, names: Sequence[str], candidates: dict[str, Callable[[], Estimator]], cuts: Sequence[str]
) -> list[tuple[str, float]]:
    """Candidates by error over time-ordered folds, oldest first.

    After each fold only the better third is carried on, so costly settings are
    not fitted on every cut. Each fold trains before its cut and is scored after.
    The rows are written once; fits and scores only read them.
    """
    rows = cut_lineage(rows, "features")
    alive = {name: [] for name in candidates}
    ordered = sorted(cuts)
    for place, cut in enumerate(ordered):
        until = ordered[place + 1] if place + 1 < len(ordered) else None
        train = rows.filter(F.col(DS) < cut)
        test = rows.filter(F.col(DS) >= cut)
        test = test if until is None else test.filter(F.col(DS) < until)
        for name in alive:
            assembler, model = fit(train, names, candidates[name]())
            scored = model.transform(assembler.transform(test))
            error = scored.agg(metrics.wmape(F.col(Y), F.col("prediction")).alias("e")).first()["e"]
            alive[name].append(float("inf") if error is None else error)
        if place + 1 < len(ordered) and len(alive) > 2:
            ranked = sorted(alive, key=lambda n: sum(alive[n]) / len(alive[n]))
            alive = {name: alive[name] for name in ranked[: max(2, -(-len(ranked) // 3))]}
    return sorted(((name, sum(e) / len(e)) for name, e in alive.items()), key=lambda pair: pair[1])

"""Rolling-origin backtests as rows: series, model, fold, step.

A window of history is one row holding its values as an array, which the
series' calendar bounds. Windows are cut and prepared by expressions over that
array alone, so nothing of a fold's test rows reaches its training values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import (
    CONFIDENCE,
    DIVERGENCE_SIGMAS,
    DS,
    FOLD_CEILING,
    MAD_TO_SIGMA,
    MAX_FOLDS,
    MIN_FOLD_SHARE,
    ROLLING_SEASONS,
    SEASON,
    SERIES_ID,
    Y,
)
from tidemark.functions import arrays, metrics
from tidemark.operators.preparation import prepared_matrix

#: Fold numbers of the two windows that test nothing: the history before the
#: first cut, which scales errors, and the whole history, for the final fit.
SCALE_FOLD, FINAL_FOLD = -1, 1000


def fold_plan(n: Column, horizon: int, period: Column, *, max_folds: int | None = None) -> dict[str, Column]:
    """Column expressions of a series' plan from its length and season."""
    test = F.greatest(F.lit(1), F.least(F.lit(horizon), F.greatest(F.lit(1), F.floor(n / 4).cast("int"))))
    start = F.greatest(F.least(2 * period, n - test), F.greatest(F.lit(3), F.floor(n / 2).cast("int")))
    start = F.least(start, n - test)
    affordable = F.floor((n - start - test) / test).cast("int") + 1
    limit = min(max(max_folds if max_folds is not None else MAX_FOLDS, 1), FOLD_CEILING)
    folds = F.when(start >= 3, F.least(affordable, F.lit(limit))).otherwise(0)
    seasons = F.when(period > 1, n / period).otherwise(n / 12)
    return {
        "test_horizon": test.cast("int"),
        "initial_train": start.cast("int"),
        "n_folds": folds.cast("int"),
        "scheme": F.when(seasons >= ROLLING_SEASONS, "rolling").otherwise("expanding"),
    }


def default_period(frequency: str) -> Column:
    return F.lit(SEASON[frequency])


def plan_rows(
    aligned: DataFrame, horizon: int, frequency: str, *, period: Column | None = None, max_folds: int | None = None
) -> DataFrame:
    """Adds the plan to every row of an aligned panel (needs column n)."""
    plan = fold_plan(
        F.col("n"), horizon, default_period(frequency) if period is None else period, max_folds=max_folds
    )
    staged = aligned
    for name, expression in plan.items():
        staged = staged.withColumn(name, expression)
    return staged


def _folds(extra_windows: bool) -> Column:
    """The folds of a planned series as an array of (fold, cut, reach)."""
    k, test, n = F.col("n_folds"), F.col("test_horizon"), F.col("n")
    folds = F.transform(
        F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("fold"), (n - test * (k - i)).cast("int").alias("cut"), test.alias("reach")),
    )
    if extra_windows:
        none = F.array().cast("array<struct<fold:int,cut:int,reach:int>>")
        scale = F.array(
            F.struct(F.lit(SCALE_FOLD).alias("fold"), (n - test * k).cast("int").alias("cut"), F.lit(0).alias("reach"))
        )
        final = F.array(F.struct(F.lit(FINAL_FOLD).alias("fold"), n.cast("int").alias("cut"), F.lit(0).alias("reach")))
        folds = F.concat(folds, F.when(k > 0, scale).otherwise(none), final)
    return folds


def _opens(fold: Column, cut: Column) -> Column:
    """Position of a fold's first training row."""
    rolling = (F.col("scheme") == "rolling") & fold.between(0, FINAL_FOLD - 1)
    return F.when(rolling, F.greatest(F.lit(0), cut - F.col("initial_train"))).otherwise(0)


def fold_rows(planned: DataFrame, *, extra_windows: bool = True) -> DataFrame:
    """Every row under each fold it trains or tests: fold, cut, role.

    Folds follow from a series' length alone, so a row is expanded in place:
    the range join of rows and cut points needs no join.
    """
    spread = planned.withColumn("_f", F.explode(_folds(extra_windows))).select("*", "_f.*").drop("_f")
    t, cut = F.col("t"), F.col("cut")
    role = F.when((t < cut) & (t >= _opens(F.col("fold"), cut)), "train").when((t >= cut) & (t < cut + F.col("reach")), "test")
    return spread.withColumn("role", role).filter(F.col("role").isNotNull())


def training_windows(
    folds: DataFrame, *, fill: str = "none", sigmas: float | None = None, weight: str | None = None, season: int = 1
) -> DataFrame:
    """One row per series and fold: train and test arrays in calendar order.

    Only training rows are prepared, within their own fold. ``whole`` says no
    hole is left in the training values, ``ceiling`` is the level a prediction
    must not pass, ``move`` and ``step`` are the mean absolute change over a
    season and over one period.
    """
    keys = [SERIES_ID, "fold", "cut", "n", "n_folds", "test_horizon"]
    point = F.struct("t", DS, Y, (F.col(weight) if weight else F.lit(1.0)).alias("w"))

    def of(role: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("role") == role, point)))

    return _described(folds.groupBy(*keys).agg(of("train").alias("_train"), of("test").alias("_test")), fill, sigmas, season)


def fold_windows(
    planned: DataFrame, *, extra_windows: bool = True, fill: str = "none", sigmas: float | None = None, weight: str | None = None, season: int = 1
) -> DataFrame:
    """`training_windows` of a planned panel of one row per series.

    Needs ``points`` as `align_arrays` makes them. A fold is a slice of its
    series' array, so nothing is shuffled, sorted or written once more per fold.
    """
    opened = F.transform(_folds(extra_windows), lambda f: f.withField("opens", _opens(f["fold"], f["cut"])))
    weights = F.col(f"points.{weight}").cast("array<double>") if weight else F.transform("points", lambda p: F.lit(1.0))
    sent = planned.select(
        SERIES_ID, "n", "n_folds", "test_horizon", opened.alias("_folds"), F.col("points.t").alias("_t"), F.col(f"points.{DS}").alias("_ds"), F.col(f"points.{Y}").alias("_y"), weights.alias("_w")
    )
    names = (SERIES_ID, "n", "n_folds", "test_horizon")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, t, placed = arrays.flat(arrays.column(batch, "_t"))
            lists = arrays.column(batch, "_folds")
            fields = {name: lists.flatten().field(name).to_numpy().astype(np.int64) for name in ("fold", "cut", "reach", "opens")}
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            # Positions on one line, series after series; a row without a day lies before all of its series.
            line = np.where(placed, t, -1).astype(np.int64)
            wide = 2 + max(line.max(initial=0), fields["cut"].max(initial=0) + fields["reach"].max(initial=0))
            line += np.repeat(np.arange(batch.num_rows), np.diff(offsets)) * wide
            opens, cut, end = (np.searchsorted(line, row * wide + place) for place in (fields["opens"], fields["cut"], fields["cut"] + fields["reach"]))
            used = cut > opens
            row, opens, cut, end = row[used], opens[used], cut[used], end[used]
            y, ds, w = (arrays.column(batch, name).flatten() for name in ("_y", "_ds", "_w"))
            train, tried = arrays.ranges(opens, cut), arrays.ranges(cut, end)
            values, known = y.to_numpy(zero_copy_only=False), np.array(y.is_valid().to_numpy(zero_copy_only=False))
            starts = np.append(0, np.cumsum(cut - opens))
            tests = np.append(0, np.cumsum(end - cut))
            step = t[tried] - np.repeat(fields["cut"][used], end - cut) + 1
            points = pa.StructArray.from_arrays([pa.array(step.astype(np.int32)), ds.take(pa.array(tried)), y.take(pa.array(tried)), w.take(pa.array(tried))], names=["step", DS, Y, "w"])
            test = pa.ListArray.from_arrays(pa.array(tests, pa.int32()), points, mask=pa.array(end == cut))
            stated = _stated(starts, values[train], known[train], t[train], fill, sigmas, season)
            yield pa.RecordBatch.from_arrays(
                [
                    *[arrays.column(batch, name).take(pa.array(row)) for name in names],
                    *[pa.array(fields[name][used].astype(np.int32)) for name in ("fold", "cut")],
                    test,
                    ds.take(pa.array(cut - 1)),
                    *stated.values(),
                ],
                names=[*names, "fold", "cut", "test", "last_ds", *stated],
            )

    kinds = ", ".join(f"{name} {sent.schema[name].dataType.simpleString()}" for name in names)
    return sent.mapInArrow(cut_up, f"{kinds}, fold int, cut int, test array<struct<step:int,ds:date,y:double,w:double>>, last_ds date, {_STATED}")


_STATED = "train array<double>, whole boolean, ceiling double, move double, step double, typical double, level double, non_negative boolean, hits array<struct<t:int,y:double>>, opens int"


def _stated(offsets: np.ndarray, values: np.ndarray, valid: np.ndarray, t: np.ndarray, fill: str, sigmas: float | None, season: int) -> dict[str, pa.Array]:
    out = {name: np.empty(len(offsets) - 1) for name in ("ceiling", "move", "step", "typical", "level", "low", "size")}
    for rows, places in arrays.by_length(offsets):
        own, known = prepared_matrix(values[places], valid[places], t[places], fill, sigmas)
        values[places], valid[places] = own, known
        held = np.where(known, own, np.nan)
        moves = np.abs(arrays.steps(held))
        typical = arrays.median(moves)
        off = arrays.median(np.abs(moves - typical[:, None]))
        size = known.sum(axis=1)
        level = np.where(size > 0, np.max(np.abs(held), axis=1, initial=-np.inf, where=known), np.nan)
        # The greater of what is known.
        volatility = np.fmax(typical + DIVERGENCE_SIGMAS * off * MAD_TO_SIGMA, arrays.stddev_samp(held))
        wide = np.fmax(np.fmax(level + DIVERGENCE_SIGMAS * volatility, level * 2.0), 1.0)
        out["ceiling"][rows] = np.where(size == 0, np.inf, np.where(size < 3, np.fmax(level * 4.0, 1.0), wide))
        out["move"][rows] = arrays.mean(np.abs(arrays.steps(held, max(1, season))))
        out["step"][rows] = arrays.mean(moves)
        out["typical"][rows], out["level"][rows], out["size"][rows] = typical, level, size
        out["low"][rows] = np.min(held, axis=1, initial=np.inf, where=known)
    sold = valid & (values > 0)
    points = pa.StructArray.from_arrays([pa.array(t[sold].astype(np.int32)), pa.array(values[sold])], names=["t", Y])
    return {
        "train": arrays.lists(offsets, values, valid),
        "whole": pa.array(out["size"] == np.diff(offsets)),
        **{name: pa.array(out[name], from_pandas=True) for name in ("ceiling", "move", "step", "typical", "level")},
        "non_negative": pa.array(out["low"] >= 0),
        "hits": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sold))[offsets], pa.int32()), points),
        "opens": pa.array(t[offsets[:-1]].astype(np.int32)),
    }


def _described(windows: DataFrame, fill: str, sigmas: float | None, season: int) -> DataFrame:
    """What a fold's training values say, from its arrays of (t, ds, y, w)."""

    def made(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return _stated(*arrays.flat(arrays.column(batch, "_y")), arrays.flat(arrays.column(batch, "_t"))[1], fill, sigmas, season)

    kept = windows.filter(F.size("_train") > 0)
    test = F.transform("_test", lambda p: F.struct((p["t"] - F.col("cut") + 1).alias("step"), p[DS].alias(DS), p[Y].alias(Y), p["w"].alias("w")))
    sent = kept.select(
        SERIES_ID, "fold", "cut", "n", "n_folds", "test_horizon",
        F.when(F.size("_test") > 0, test).alias("test"),
        F.array_max(F.col(f"_train.{DS}")).alias("last_ds"),
        F.col("_train.t").alias("_t"),
        F.col(f"_train.{Y}").alias("_y"),
    )
    return arrays.add_columns(sent, made, _STATED, ("_t", "_y"))


def backtest_rows(windows: DataFrame, predictions: dict[str, Column]) -> DataFrame:
    """Long rows of the scored folds; ``predictions`` are array columns by model.

    A fold fails for a model that gives no array, too few steps, or a path
    beyond the divergence ceiling. Only observed periods are scored, each under
    its true step.
    """
    scored = windows.filter(F.col("fold").between(0, FINAL_FOLD - 1) & F.col("whole"))
    scored = scored.filter(F.exists("test", lambda p: p[Y].isNotNull()))
    models = F.array(
        *[F.struct(F.lit(name).alias("model"), path.alias("path")) for name, path in predictions.items()]
    )
    each = scored.select(SERIES_ID, "fold", "n_folds", "test", "ceiling", F.explode(models).alias("_m"))
    path = F.col("_m.path")
    peak = F.array_max(F.transform(path, lambda p: F.abs(p)))
    sound = (
        path.isNotNull()
        & (F.size(path) >= F.size("test"))
        & ~F.exists(path, lambda p: p.isNull() | F.isnan(p))
        & (peak <= F.col("ceiling"))
    )
    kept = each.filter(sound)
    return (
        kept.select(SERIES_ID, F.col("_m.model").alias("model"), "fold", "n_folds", path.alias("_path"), F.explode("test").alias("_t"))
        .select(
            SERIES_ID,
            "model",
            "fold",
            "n_folds",
            F.col("_t.step").alias("step"),
            F.col(f"_t.{DS}").alias(DS),
            F.col(f"_t.{Y}").alias("y_true"),
            F.get("_path", F.col("_t.step") - 1).alias("y_pred"),
            F.col("_t.w").alias("w"),
        )
        .filter(F.col("y_true").isNotNull())
    )


def scale_rows(windows: DataFrame) -> DataFrame:
    """series_id, scale: the seasonal step of the history before the first cut.

    Pairs a season apart by calendar position; without one, neighbours.
    """
    first = windows.filter(F.col("fold") == SCALE_FOLD)
    return first.select(SERIES_ID, F.coalesce("move", "step").alias("scale"))


def score_models(rows: DataFrame, scales: DataFrame | None = None, *, level: float = CONFIDENCE) -> DataFrame:
    """Metrics per series and model, and whether enough folds survived."""
    t, p, w = F.col("y_true"), F.col("y_pred"), F.col("w")
    scored = rows if scales is None else rows.join(scales, SERIES_ID, "left")
    scale = F.lit(None).cast("double") if scales is None else F.col("scale")
    out = scored.groupBy(SERIES_ID, "model").agg(
        metrics.mae(t, p).alias("mae"),
        metrics.rmse(t, p).alias("rmse"),
        metrics.smape(t, p).alias("smape"),
        metrics.wmape(t, p, w).alias("wmape"),
        metrics.bias(t, p).alias("bias"),
        metrics.relative_bias(t, p).alias("relative_bias"),
        metrics.mase(t, p, scale).alias("mase"),
        F.countDistinct("fold").alias("folds"),
        F.first("n_folds").alias("n_folds"),
    )
    costs = interval_cost(rows, level)
    joined = out.join(costs, [SERIES_ID, "model"], "left")
    return joined.withColumn("failed", F.col("folds") < MIN_FOLD_SHARE * F.col("n_folds"))


def interval_cost(rows: DataFrame, level: float = CONFIDENCE) -> DataFrame:
    """series_id, model, winkler: each fold judged by the other folds' spread."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(0.5 + level / 2)
    model = Window.partitionBy(SERIES_ID, "model")
    fold = Window.partitionBy(SERIES_ID, "model", "fold")
    r = F.col("y_true") - F.col("y_pred")
    summed = rows.withColumn("_r", r).select(
        SERIES_ID,
        "model",
        "fold",
        "y_true",
        "y_pred",
        *[
            (F.sum(value).over(model) - F.sum(value).over(fold)).alias(name)
            for name, value in (("_n", F.lit(1)), ("_s", F.col("_r")), ("_q", F.col("_r") * F.col("_r")))
        ],
    )
    mean = F.col("_s") / F.col("_n")
    variance = F.when(F.col("_n") >= 2, F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)))
    # A spread lost in the last bits of its square is no spread.
    sigma = F.when(variance > 1e-12 * F.col("_q") / F.col("_n"), F.sqrt(variance))
    reach = z * sigma
    cost = metrics.winkler_cost(F.col("y_true"), F.col("y_pred") - reach, F.col("y_pred") + reach, level)
    by_fold = summed.withColumn("_cost", cost).groupBy(SERIES_ID, "model", "fold").agg(F.avg("_cost").alias("_cost"))
    return by_fold.groupBy(SERIES_ID, "model").agg(F.when(F.count("*") >= 2, F.avg("_cost")).alias("winkler"))

"""Forecast every series of a panel: route, backtest, choose, band, add up."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import (
    CONFIDENCE,
    DS,
    INTERMITTENT_WEIGHTS,
    METRIC_WEIGHTS,
    SEASON,
    SERIES_ID,
    Y,
)
from tidemark.functions.dates import add_periods
from tidemark.operators import backtest, diagnostics, forecasters, intervals, selection, validation
from tidemark.operators.calendar import align_arrays
from tidemark.operators.hierarchy import bottom_up
from tidemark.operators.preparation import prepare_arrays
from tidemark.session import cut_lineage

ROSTER, FULL_ROSTER, INTERMITTENT = forecasters.LEAF_ROSTER, forecasters.FULL_ROSTER, forecasters.RARE


@dataclass(frozen=True)
class FanOut:
    """What a fan-out leaves: forecasts, parents, errors and its evidence."""

    forecasts: DataFrame
    parents: DataFrame | None
    errors: DataFrame
    candidates: DataFrame
    report: DataFrame


def forecast_windows(
    panel: DataFrame,
    frequency: str,
    horizon: int,
    *,
    fill: str = "none",
    sigmas: float | None = None,
    max_folds: int | None = None,
    roster: Sequence[str] = ROSTER,
    shape: Column | None = None,
) -> DataFrame:
    """Every training window with its shape and ``paths``, one of each of the roster.

    A ``shape`` that is known (period, has_season, has_trend) is not measured.

    A window's season and trend are measured in the window itself; only the
    plan of cuts uses the whole history.
    """
    # One row per series: folds are slices of its array, and nothing is sorted by windows.
    aligned = align_arrays(diagnostics.spread_out(panel, [SERIES_ID]), frequency)
    prepared = prepare_arrays(aligned, fill, sigmas).filter(F.exists("values", lambda v: v.isNotNull()))
    whole = cut_lineage(prepared if shape is not None else prepared.withColumn("s", diagnostics.shape_column(F.col("values"), frequency)), "aligned")
    pattern = diagnostics.demand_pattern(whole.select(SERIES_ID, F.explode("values").alias(Y)).filter(F.col(Y).isNotNull())).select(SERIES_ID, "demand_class")
    measured = F.col("s") if shape is None else shape
    known = cut_lineage(whole.select(SERIES_ID, "n", "points", measured["period"].alias("period"), measured["has_season"].alias("has_season")).join(pattern, SERIES_ID), "shape")
    planned = backtest.plan_rows(known, horizon, frequency, period=_season(frequency), max_folds=max_folds)
    windows = backtest.fold_windows(planned, fill=fill, sigmas=sigmas, season=SEASON[frequency])
    shaped = diagnostics.spread_out(windows, [SERIES_ID, "fold"]).withColumn("shape", diagnostics.shape_column(F.col("train"), frequency) if shape is None else shape)
    fitted = forecasters.add_paths(forecasters.together(cut_lineage(shaped, "shapes")), roster, frequency, F.greatest("test_horizon", F.lit(horizon)))
    described = known.select(SERIES_ID, F.col("period").alias("full_period"), F.col("has_season").alias("full_season"), "demand_class")
    return cut_lineage(fitted.join(described, SERIES_ID), "windows")


def _season(frequency: str) -> Column:
    return F.when(F.col("period") > 1, F.col("period")).otherwise(SEASON[frequency])


def rate_candidates(
    windows: DataFrame, *, roster: Sequence[str] = ROSTER, level: float = CONFIDENCE
) -> tuple[DataFrame, DataFrame]:
    """Backtest rows of all candidates, and their scores with one selected."""
    rows = cut_lineage(backtest.backtest_rows(windows, forecasters.paths_of(roster)), "backtest")
    scores = backtest.score_models(rows, backtest.scale_rows(windows), level=level)
    final = windows.filter(F.col("fold") == backtest.FINAL_FOLD).select(SERIES_ID, "n", "demand_class")
    rated = scores.join(final, SERIES_ID)
    rare = F.col("demand_class").isin(*INTERMITTENT)
    # Error measures that divide by the total say nothing of rare demand.
    steady = selection.select_models(rated.filter(~rare), roster, weights=METRIC_WEIGHTS)
    sparse = selection.select_models(rated.filter(rare), roster, weights=INTERMITTENT_WEIGHTS)
    return rows, cut_lineage(steady.unionByName(sparse), "candidates")


def run_fanout(
    panel: DataFrame,
    frequency: str,
    horizon: int,
    *,
    level: float = CONFIDENCE,
    fill: str = "none",
    sigmas: float | None = None,
    max_folds: int | None = None,
    min_history: int | None = None,
    hierarchy_depth: int = 0,
    roster: Sequence[str] = ROSTER,
) -> FanOut:
    """Forecast rows series_id, ds, y, y_lower, y_upper, model, route.

    Series that fail validation are reported, not forecast; short or mostly
    empty ones, and those no candidate could be tested on, take a baseline
    without a band.
    """
    panel = cut_lineage(panel, "panel")
    report = cut_lineage(validation.validate_panel(panel, frequency, min_history=min_history), "report")
    routes = report.select(SERIES_ID, "status", "route")
    accepted = panel.join(routes.filter(F.col("status") != "reject").select(SERIES_ID), SERIES_ID, "left_semi")
    windows = forecast_windows(accepted, frequency, horizon, fill=fill, sigmas=sigmas, max_folds=max_folds, roster=roster)
    rows, candidates = rate_candidates(windows, roster=roster, level=level)

    final = windows.filter(F.col("fold") == backtest.FINAL_FOLD).join(routes, SERIES_ID)
    winners = candidates.filter("selected").select(SERIES_ID, F.col("model").alias("winner"))
    chosen = forecasters.path_by_name(roster, F.col("winner"))
    needed = diagnostics.minimum_history(F.col("full_season"), F.col("full_period"), frequency)
    fits = (F.col("route") == "model") & F.col("whole") & (F.size("train") >= needed) & (F.col("n_folds") > 0)
    placed = final.join(winners, SERIES_ID, "left").withColumn("_own", F.when(fits, chosen))
    # Holes a run was asked not to fill count as nothing for a baseline.
    fallback, baseline = forecasters.fallback(F.col("demand_class"), frequency, F.lit(horizon))
    settled = placed.select(
        SERIES_ID,
        "last_ds",
        F.coalesce(F.when(F.col("_own").isNotNull(), F.col("winner")), fallback).alias("model"),
        F.when(F.col("_own").isNotNull(), "model").otherwise("fallback").alias("route"),
        F.slice(F.coalesce("_own", baseline), 1, horizon).alias("path"),
        F.coalesce(
            F.when(F.col("typical") > 0, F.col("typical")), F.when(F.col("step") > 0, F.col("step")), F.col("level") * 0.1
        ).alias("volatility"),
        "non_negative",
    )
    settled = cut_lineage(settled, "settled")
    points = settled.filter(F.col("path").isNotNull()).select(
        "*", F.posexplode("path").alias("_i", "forecast")
    ).withColumn("step", F.col("_i") + 1).drop("_i", "path")
    fitted = points.filter("route = 'model'")
    won = rows.join(
        fitted.select(SERIES_ID, "model").distinct(), [SERIES_ID, "model"], "left_semi"
    )
    bands = intervals.build_bands(fitted, intervals.residual_rows(won), level=level)

    def shaped(frame: DataFrame, low: Column, high: Column) -> DataFrame:
        return frame.select(
            SERIES_ID,
            add_periods(F.col("last_ds"), F.col("step"), frequency).alias(DS),
            F.col("forecast").alias(Y),
            low.alias("y_lower"),
            high.alias("y_upper"),
            "model",
            "route",
        )

    none = F.lit(None).cast("double")
    forecasts = shaped(bands, F.col("lower"), F.col("upper")).unionByName(
        shaped(points.filter("route = 'fallback'"), none, none)
    )
    rejected = report.filter("status = 'reject'").select(
        SERIES_ID, F.filter("findings", lambda f: f["severity"] == "severe")[0]["code"].alias("code")
    )
    failed = settled.filter(F.col("path").isNull()).select(SERIES_ID, F.lit("fit_failed").alias("code"))
    parents = bottom_up(forecasts, hierarchy_depth) if hierarchy_depth > 1 else None
    return FanOut(forecasts, parents, rejected.unionByName(failed), candidates, report)

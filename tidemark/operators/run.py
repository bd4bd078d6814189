"""One run end to end: checks, the full roster, the blend, points and facts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.constants import CONFIDENCE, DS, ENSEMBLE_MEMBERS, FREQUENCIES, INTERMITTENT_WEIGHTS, METRIC_WEIGHTS, SERIES_ID, Y
from tidemark.functions.columns import require
from tidemark.functions.dates import add_periods
from tidemark.operators import backtest, fanout, forecasters, intervals, models, selection
from tidemark.operators.aggregate import AGGREGATIONS
from tidemark.session import cut_lineage

RESERVED = (SERIES_ID, DS, Y, "period", "value")


@dataclass(frozen=True)
class RunConfig:
    """What a run is asked to do; checked against the table before any job."""

    time: str
    target: str
    frequency: str
    horizon: int
    group_by: tuple[str, ...] = ()
    weight: str | None = None
    region: str | None = None
    category: str | None = None
    drivers: tuple[str, ...] = ()
    aggregation: str = "sum"
    metric_weights: dict[str, float] | None = None
    models: tuple[str, ...] = forecasters.FULL_ROSTER


def check_config(config: RunConfig, rows: DataFrame) -> RunConfig:
    """Columns exist and fit their role, the grain is sound, models are known."""
    named = [c for c in (config.weight, config.region, config.category) if c]
    require(rows, [config.time, config.target, *config.group_by, *named, *config.drivers])
    roles = [config.time, config.target, *named]
    if len(set(roles)) < len(roles):
        raise ValueError("Time, target, weight, region and category must be different columns.")
    if len(set(config.group_by)) < len(config.group_by):
        raise ValueError("The grain names a column twice.")
    if {config.time, config.target} & set(config.group_by) or set(RESERVED) & set(config.group_by):
        raise ValueError("The grain cannot use the time, the target or a reserved name.")
    kinds = {f.name: f.dataType for f in rows.schema}
    text = [d for d in (*config.drivers, *([config.weight] if config.weight else [])) if not isinstance(kinds[d], T.NumericType)]
    if text:
        raise ValueError(f"Drivers and weights must be numbers: {', '.join(text)}.")
    if isinstance(kinds[config.target], (T.BooleanType, T.DateType, T.TimestampType)):
        raise ValueError("The target must hold numbers.")
    if config.frequency not in FREQUENCIES or config.aggregation not in AGGREGATIONS or config.horizon < 1:
        raise ValueError("Unknown frequency or aggregation, or a horizon below one.")
    forecasters.named(config.models)
    if config.metric_weights is not None:
        selection.check_weights(config.metric_weights)
    return config


@dataclass(frozen=True)
class Run:
    points: DataFrame
    candidates: DataFrame
    metrics: DataFrame
    winner_rows: DataFrame
    #: Series without a forecast, each with the reason.
    errors: DataFrame


def run_forecast(
    panel: DataFrame,
    frequency: str,
    horizon: int,
    *,
    level: float = CONFIDENCE,
    fill: str = "auto",
    sigmas: float | None = None,
    requested: Sequence[str] = forecasters.FULL_ROSTER,
    weights: dict[str, float] | None = None,
    members: int = ENSEMBLE_MEMBERS,
    shape: Column | None = None,
) -> Run:
    """The whole roster and its blend for every series of a panel.

    A series whose demand class rules a model out does not score it. The blend
    stands beside its members, the best ``members`` of a series, and is offered
    only if it beats the best of them.
    """
    windows = fanout.forecast_windows(panel, frequency, horizon, fill=fill, sigmas=sigmas, roster=requested, shape=shape)
    paths = forecasters.paths_of(requested)
    rows = backtest.backtest_rows(windows, paths)
    classes = windows.filter(F.col("fold") == backtest.FINAL_FOLD).select(SERIES_ID, "n", "demand_class")
    allowed = forecasters.allowed(F.col("demand_class"), requested)
    rows = rows.join(classes.select(SERIES_ID, allowed.alias("_allowed")), SERIES_ID)
    rows = cut_lineage(rows.filter(F.array_contains("_allowed", F.col("model"))).drop("_allowed"), "backtest")
    scales = backtest.scale_rows(windows)
    scores = cut_lineage(backtest.score_models(rows, scales, level=level), "scores")
    blended = cut_lineage(selection.blend_backtest(rows, scores, members=members), "blend")
    kept = selection.blend_worth_keeping(backtest.score_models(blended, scales, level=level), scores)
    rated = scores.unionByName(kept).join(classes, SERIES_ID)
    roster = [*requested, "ensemble"]
    rare = F.col("demand_class").isin(*forecasters.RARE)
    if weights is None:
        chosen = selection.select_models(rated.filter(~rare), roster, weights=METRIC_WEIGHTS).unionByName(
            selection.select_models(rated.filter(rare), roster, weights=INTERMITTENT_WEIGHTS)
        )
    else:
        chosen = selection.select_models(rated, roster, weights=selection.check_weights(weights))
    chosen = cut_lineage(chosen, "candidates")
    winners = chosen.filter("selected").select(SERIES_ID, F.col("model").alias("winner"))

    final = windows.filter(F.col("fold") == backtest.FINAL_FOLD).join(winners, SERIES_ID)
    each = final.select(
        SERIES_ID,
        "winner",
        "last_ds",
        F.coalesce(F.when(F.col("typical") > 0, F.col("typical")), F.when(F.col("step") > 0, F.col("step")), F.col("level") * 0.1).alias("volatility"),
        "non_negative",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("model"), F.slice(paths[m], 1, horizon).alias("path")) for m in requested])
        ).alias("m"),
    ).select(SERIES_ID, "winner", "last_ds", "volatility", "non_negative", "m.*").filter(F.col("path").isNotNull())
    stepped = each.select("*", F.posexplode("path").alias("_i", "y")).withColumn("step", F.col("_i") + 1).drop("_i", "path")
    member = scores.select(SERIES_ID, "model", "mae").join(
        selection.blend_members(scores, members), [SERIES_ID, "model"], "left_semi"
    )
    weighed = stepped.join(member, [SERIES_ID, "model"], "left")
    share = 1 / F.greatest(F.col("mae"), F.lit(1e-9))
    forecasts = weighed.groupBy(SERIES_ID, "winner", "last_ds", "volatility", "non_negative", "step").agg(
        F.coalesce(
            F.sum(F.when(F.col("winner") == F.col("model"), F.col("y"))),
            F.sum(F.when(F.col("winner") == "ensemble", F.col("y") * share)) / F.sum(F.when(F.col("mae").isNotNull(), share)),
        ).alias("forecast")
    )
    forecasts = cut_lineage(forecasts.filter(F.col("forecast").isNotNull()), "forecasts")
    won = rows.unionByName(blended).join(
        winners.withColumnRenamed("winner", "model"), [SERIES_ID, "model"], "left_semi"
    )
    bands = intervals.build_bands(forecasts, intervals.residual_rows(won), level=level)
    points = bands.select(
        SERIES_ID,
        add_periods(F.col("last_ds"), F.col("step"), frequency).alias(DS),
        "step",
        F.col("winner").alias("model"),
        "forecast",
        "lower",
        "upper",
        "best_case",
        "base_case",
        "worst_case",
        "method",
    )
    totals = points.groupBy(SERIES_ID).agg(
        F.sum("forecast").alias("forecast_total"), F.sum("best_case").alias("best_total"), F.sum("worst_case").alias("worst_total")
    )
    facts = chosen.filter("selected").join(totals, SERIES_ID).join(
        selection.value_add(chosen).select(SERIES_ID, "value_add"), SERIES_ID, "left"
    )
    left = panel.groupBy(SERIES_ID).agg(F.count(Y).alias("_n")).join(forecasts.select(SERIES_ID).distinct(), SERIES_ID, "left_anti")
    judged = left.join(winners, SERIES_ID, "left")
    reason = F.when(F.col("_n") == 0, "no value").when(F.col("winner").isNull(), "no model could be measured").otherwise("the chosen model gives no value")
    return Run(points, chosen, facts, won, judged.select(SERIES_ID, reason.alias("reason")))


def fitted_values(panel: DataFrame, winners: DataFrame, period: int) -> DataFrame:
    """In-sample values of series won by a lag model, for anomaly checks."""
    lagged = models.in_sample(panel, period).withColumnRenamed("fitted", "_season")
    both = models.in_sample(lagged, 1)
    joined = both.join(winners.select(SERIES_ID, "model"), SERIES_ID)
    one, season = forecasters.baselines()[:2]
    fitted = F.when(F.col("model") == season, F.col("_season")).when(F.col("model") == one, F.col("fitted"))
    return joined.select(SERIES_ID, DS, F.col(Y).alias("actual"), fitted.alias("fitted"))

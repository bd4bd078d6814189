"""Scoring candidates, choosing one per series, and blending the best."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import (
    CLOSE_SCORE,
    COMPLEXITY_PENALTY,
    ENSEMBLE_IMPROVEMENT,
    ENSEMBLE_MEMBERS,
    FORBIDDEN_METRICS,
    INTERVAL_WEIGHT,
    MAX_PENALTY_SCALE,
    METRIC_WEIGHTS,
    OUTLIER_MAD_MULTIPLIER,
    PARAMETER_BUDGET,
    SERIES_ID,
)
from tidemark.functions import metrics
from tidemark.functions.columns import clip

DISPLAY = {"wmape": "wMAPE", "smape": "sMAPE", "rmse": "RMSE", "mae": "MAE", "mase": "MASE", "winkler": "Winkler"}


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    known = {"wmape", "mase", "rmse", "mae"}
    bad = [name for name in weights if name not in known or name in FORBIDDEN_METRICS]
    if bad:
        raise ValueError(f"Not a selection metric: {', '.join(bad)}.")
    if any(value < 0 for value in weights.values()) or not any(weights.values()):
        raise ValueError("Metric weights must not be negative and not all be zero.")
    return weights


def scoring_rule(weights: dict[str, float] = METRIC_WEIGHTS, interval_weight: float = INTERVAL_WEIGHT) -> str:
    terms = " + ".join(f"{value:.2f}*norm({DISPLAY[name]})" for name, value in weights.items())
    return (
        f"score = {terms} + {interval_weight:.2f}*norm(Winkler) where measurable"
        " + complexity_penalty; metrics min-max normalised across candidates, lower is better"
    )


def _lookup(table: dict, key: Column, default: float) -> Column:
    pairs = F.create_map(*[part for name, value in table.items() for part in (F.lit(name), F.lit(float(value)))])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def _normalise(frame: DataFrame, name: str, within) -> DataFrame:
    """Adds norm_<name>; a series has at most a roster of candidates."""
    value = F.col(name)
    staged = frame.withColumn("_k", F.count(value).over(within)).withColumn("_m", F.median(value).over(within))
    staged = staged.withColumn("_d", F.median(F.abs(value - F.col("_m"))).over(within))
    ceiling = F.when((F.col("_k") >= 3) & (F.col("_d") > 0), F.col("_m") + OUTLIER_MAD_MULTIPLIER * F.col("_d"))
    staged = staged.withColumn("_in", F.when(ceiling.isNull() | (value <= ceiling), value))
    low, high = F.min("_in").over(within), F.max("_in").over(within)
    staged = staged.withColumn("_low", low).withColumn("_high", high)
    span = F.col("_high") - F.col("_low")
    same = span <= 1e-9 * F.greatest(F.abs("_low"), F.abs("_high"))
    norm = (
        F.when(F.col("_k") == 0, 0.0)
        .when(value.isNull(), 1.0)
        .when(same, F.when(value <= F.col("_high"), 0.0).otherwise(1.0))
        .otherwise(clip((value - F.col("_low")) / span, 0.0, 1.0))
    )
    return staged.withColumn(f"norm_{name}", norm).drop("_k", "_m", "_d", "_in", "_low", "_high")


def penalty(model: Column, n: Column) -> Column:
    """A model's complexity, dearer the less data there is per parameter."""
    per_parameter = n / _lookup(PARAMETER_BUDGET, model, 4.0)
    scale = F.when(n.isNull() | (n <= 0) | (per_parameter >= 20), 1.0).otherwise(
        F.least(F.lit(MAX_PENALTY_SCALE), 20.0 / F.greatest(per_parameter, F.lit(1.0)))
    )
    return _lookup(COMPLEXITY_PENALTY, model, 0.0) * scale


def select_models(
    scores: DataFrame,
    roster: Sequence[str],
    *,
    weights: dict[str, float] = METRIC_WEIGHTS,
    interval_weight: float = INTERVAL_WEIGHT,
    penalty_scale: float = 1.0,
) -> DataFrame:
    """Adds score, rank and selected to every candidate (needs column n).

    A candidate without any weighted metric, or with too few folds, ranks
    behind the scored ones; if none can be scored the first that ran is taken.
    """
    check_weights(weights)
    order = F.array_position(F.array(*[F.lit(m) for m in roster]), F.col("model"))
    used = [name for name, weight in weights.items() if weight > 0]
    known = F.coalesce(*[F.col(name) for name in used]).isNotNull()
    usable = ~F.coalesce(F.col("failed"), F.lit(True)) & known
    staged = scores.withColumn("_usable", usable).withColumn("_order", order)
    within = Window.partitionBy(SERIES_ID, "_usable")
    for name in (*weights, "winkler"):
        staged = _normalise(staged, name, within)
    composite = sum((F.lit(weight) * F.col(f"norm_{name}") for name, weight in weights.items()), F.lit(0.0))
    comparable = F.count("winkler").over(within) >= 2
    composite = composite + F.when(comparable, interval_weight * F.col("norm_winkler")).otherwise(0.0)
    composite = composite + penalty(F.col("model"), F.col("n")) * penalty_scale
    staged = staged.withColumn("score", F.when(F.col("_usable"), composite))
    series = Window.partitionBy(SERIES_ID)
    ranking = series.orderBy(F.desc("_usable"), F.asc_nulls_last("score"), "_order")
    staged = staged.withColumn("rank", F.row_number().over(ranking)).withColumn("_any", F.max("_usable").over(series))
    fallback = F.row_number().over(series.orderBy(F.coalesce("failed", F.lit(True)), "_order")) == 1
    staged = staged.withColumn("selected", F.when(F.col("_any"), F.col("rank") == 1).otherwise(fallback))
    return staged.drop("_usable", "_order", "_any", *[f"norm_{name}" for name in (*weights, "winkler")])


def rationale(selected: DataFrame) -> DataFrame:
    """series_id, rationale: why the winner won, in its own numbers."""
    series = Window.partitionBy(SERIES_ID).orderBy("rank")
    ahead = selected.withColumn("_next", F.lead(F.struct("model", "score", "wmape")).over(series))
    readable = F.initcap(F.regexp_replace("model", "_", " "))
    error = (
        F.when(F.col("wmape").isNotNull(), F.format_string("off by %.1f%% on average", "wmape"))
        .when(F.col("mae").isNotNull(), F.format_string("off by %.3g on average", "mae"))
        .otherwise("the only candidate that could be scored")
    )
    stretches = F.when(F.col("folds") == 1, "stretch").otherwise("stretches")
    first = F.format_string("%s was %s when tested against %d %s of unseen history.", readable, error, F.col("folds"), stretches)
    other = F.regexp_replace(F.col("_next.model"), "_", " ")
    close = F.col("_next.score") - F.col("score") < CLOSE_SCORE
    second = F.when(
        F.col("_next.score").isNotNull(),
        F.when(close, F.format_string(" %s was so close that the simpler was preferred.", F.initcap(other))).otherwise(
            F.format_string(" Next best was %s, off by %.1f%%.", other, F.col("_next.wmape"))
        ),
    )
    winner = ahead.filter(F.col("selected"))
    return winner.select(SERIES_ID, F.concat(first, F.coalesce(second, F.lit(""))).alias("rationale"))


def value_add(selected: DataFrame, baselines: Sequence[str] = ("naive", "seasonal_naive")) -> DataFrame:
    """series_id, model, baseline_error, value_add of the winner."""
    is_base = F.col("model").isin(list(baselines)) & ~F.col("selected") & ~F.col("failed")
    errors = selected.groupBy(SERIES_ID).agg(
        F.max(F.when(F.col("selected"), F.col("model"))).alias("model"),
        *[F.max(F.when(F.col("selected"), F.col(m))).alias(f"own_{m}") for m in ("wmape", "mase", "mae")],
        *[F.min(F.when(is_base, F.col(m))).alias(f"base_{m}") for m in ("wmape", "mase", "mae")],
    )
    usable = {m: F.col(f"own_{m}").isNotNull() & F.col(f"base_{m}").isNotNull() for m in ("wmape", "mase", "mae")}
    pairs = F.coalesce(
        *[F.when(usable[m], F.struct(F.col(f"own_{m}").alias("own"), F.col(f"base_{m}").alias("base"))) for m in usable]
    )
    staged = errors.withColumn("_p", pairs)
    return staged.select(
        SERIES_ID,
        "model",
        F.col("_p.own").alias("model_error"),
        F.col("_p.base").alias("baseline_error"),
        metrics.value_add(F.col("_p.own"), F.col("_p.base")).alias("value_add"),
    )


def blend_members(scores: DataFrame, members: int = ENSEMBLE_MEMBERS) -> DataFrame:
    """series_id, model: the best ``members`` candidates of each series that could be measured."""
    usable = scores.filter(~F.col("failed") & F.col("wmape").isNotNull())
    place = F.row_number().over(Window.partitionBy(SERIES_ID).orderBy("mae", "model"))
    return usable.withColumn("_r", place).filter(F.col("_r") <= members).select(SERIES_ID, "model")


def blend_backtest(rows: DataFrame, scores: DataFrame, *, members: int = ENSEMBLE_MEMBERS) -> DataFrame:
    """Backtest rows of the blend of each series' best models.

    Members weigh by the inverse of their error. A fold is predicted with the
    weights the other folds give, so the blend is not tuned on what it is
    judged by. Folds a member lost, or scored on fewer periods, are left out.
    """
    series = Window.partitionBy(SERIES_ID)
    chosen = blend_members(scores, members)
    chosen = chosen.withColumn("_count", F.count("*").over(series)).filter(F.col("_count") >= 2)
    kept = rows.join(chosen.select(SERIES_ID, "model", "_count"), [SERIES_ID, "model"])
    fold = Window.partitionBy(SERIES_ID, "fold")
    sized = kept.withColumn("_size", F.count("*").over(Window.partitionBy(SERIES_ID, "fold", "model")))
    shared = sized.withColumn("_present", F.size(F.collect_set("model").over(fold))).withColumn(
        "_same", F.min("_size").over(fold) == F.max("_size").over(fold)
    ).filter((F.col("_present") == F.col("_count")) & F.col("_same"))
    miss = F.abs(F.col("y_true") - F.col("y_pred"))
    model = Window.partitionBy(SERIES_ID, "model")
    own = Window.partitionBy(SERIES_ID, "model", "fold")
    errors = shared.withColumn("_miss", miss)
    errors = errors.withColumn(
        "_error",
        F.try_divide(
            F.sum("_miss").over(model) - F.sum("_miss").over(own),
            (F.count("*").over(model) - F.count("*").over(own)).cast("double"),
        ),
    )
    floor = F.min(F.when(F.col("_error") > 0, F.col("_error"))).over(fold)
    raw = F.when(F.col("_error").isNotNull(), 1 / F.greatest(F.col("_error"), F.coalesce(floor, F.lit(1.0)) * 1e-3)).otherwise(0.0)
    weighed = errors.withColumn("_raw", raw)
    out = weighed.groupBy(SERIES_ID, "fold", "n_folds", "step", "ds").agg(
        F.first("y_true").alias("y_true"),
        F.first("w").alias("w"),
        F.when(F.sum("_raw") > 0, F.sum(F.col("_raw") * F.col("y_pred")) / F.sum("_raw"))
        .otherwise(F.avg("y_pred"))
        .alias("y_pred"),
    )
    return out.select(SERIES_ID, F.lit("ensemble").alias("model"), "fold", "n_folds", "step", "ds", "y_true", "y_pred", "w")


def blend_worth_keeping(blend_scores: DataFrame, scores: DataFrame) -> DataFrame:
    """Blends at least 2% better than the best member they come from."""
    best = scores.filter(~F.col("failed") & F.col("wmape").isNotNull()).groupBy(SERIES_ID).agg(
        F.min("mae").alias("_best")
    )
    kept = blend_scores.join(best, SERIES_ID).filter(F.col("mae") <= F.col("_best") * (1 - ENSEMBLE_IMPROVEMENT))
    return kept.drop("_best")

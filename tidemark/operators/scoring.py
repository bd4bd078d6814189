"""Issued forecasts against what happened, and the log of what was reported."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import DRIFT_WMAPE, POOLED_KEY, TRACKING_LIMIT
from tidemark.functions import metrics
from tidemark.functions.dates import is_settled

DISAGREES_ENTIRELY = 1.0


def settled_points(points: DataFrame, reach: Column, frequency: str) -> DataFrame:
    """Forecast points whose period can no longer grow."""
    return points.filter(is_settled(F.col("period"), reach, frequency))


def with_actuals(
    points: DataFrame, actuals: DataFrame, keys: Sequence[str], *, absent_is_zero: bool = True
) -> DataFrame:
    """Adds the actual of each point; for a SUM a missing one is zero."""
    joined = points.drop("actual").join(actuals.select(*keys, "period", "actual"), [*keys, "period"], "left")
    return joined.withColumn("actual", F.coalesce("actual", F.lit(0.0))) if absent_is_zero else joined


def scorecard(graded: DataFrame, horizon: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """One row per run over its settled top-line points.

    ``graded`` holds keys, period, forecast, lower, upper, actual; ``horizon``
    the number of periods each run forecast.
    """
    t, p = F.col("actual"), F.col("forecast")
    banded = F.col("lower").isNotNull() & F.col("upper").isNotNull()
    card = graded.groupBy(*keys).agg(
        F.count("*").alias("scored_periods"),
        F.sum(p).alias("forecast_total"),
        F.sum(t).alias("actual_total"),
        metrics.wmape(t, p).alias("wmape"),
        metrics.mae(t, p).alias("mae"),
        metrics.relative_bias(t, p).alias("bias"),
        (F.avg(F.when(banded, t.between(F.col("lower"), F.col("upper")).cast("double"))) * 100).alias("coverage"),
    )
    joined = horizon.join(card, list(keys), "left")
    scored = F.coalesce("scored_periods", F.lit(0))
    signal = metrics.tracking_signal(F.col("forecast_total"), F.col("actual_total"), F.col("mae"))
    out = joined.withColumn("scored_periods", scored).withColumn("pending_periods", F.col("horizon") - scored)
    return out.withColumn("tracking_signal", signal).withColumn(
        "drifted", is_drifted(F.col("tracking_signal"), F.col("wmape"))
    )


def is_drifted(signal: Column, error: Column) -> Column:
    """Wrong the same way every period, or simply too far out."""
    return F.coalesce(F.abs(signal) > TRACKING_LIMIT, F.lit(False)) | F.coalesce(error > DRIFT_WMAPE, F.lit(False))


def series_scores(
    graded: DataFrame, keys: Sequence[str], *, absent_is_zero: bool = True, pooled: Column | None = None
) -> DataFrame:
    """Per series: totals, error, periods, miss, and why it was not scored."""
    t, p = F.col("actual"), F.col("forecast")
    scored = graded.groupBy(*keys).agg(
        F.sum(p).alias("forecast_total"),
        F.sum(t).alias("actual_total"),
        metrics.wmape(t, p).alias("wmape"),
        F.count(t).alias("scored_periods"),
    )
    is_pooled = F.lit(False) if pooled is None else pooled
    reason = F.when(is_pooled, "pooled").when(
        F.lit(not absent_is_zero) & F.col("actual_total").isNull(), "not_recorded"
    )
    out = scored.withColumn("unscored_reason", reason)
    known = reason.isNull()
    return out.withColumns(
        {
            "actual_total": F.when(known, F.col("actual_total")),
            "wmape": F.when(known, F.col("wmape")),
            "scored_periods": F.when(known, F.col("scored_periods")).otherwise(0),
            "miss": F.when(known, F.round(F.col("forecast_total") - F.col("actual_total"), 4)),
        }
    )


def is_pooled_key(path: Column) -> Column:
    return F.array_contains(path, POOLED_KEY)


def unforecast_keys(observed: DataFrame, forecast: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with observations that no forecast was made for."""
    return observed.select(*keys).distinct().join(forecast.select(*keys).distinct(), list(keys), "left_anti")


# ---- Choosing the table to score against ------------------------------------
def weigh_sources(history: DataFrame, observed: DataFrame) -> DataFrame:
    """source, shared, disagreement, verdict of each candidate table.

    ``history`` has period and value, ``observed`` source, period, value. A
    table that shares no period proves nothing; one that differs by all of it
    describes something else.
    """
    paired = observed.join(F.broadcast(history.withColumnRenamed("value", "ours")), "period")
    stats = paired.groupBy("source").agg(
        F.count("*").alias("shared"),
        F.sum(F.abs("ours")).alias("_a"),
        F.sum(F.abs("value")).alias("_b"),
        F.sum(F.abs(F.col("ours") - F.col("value"))).alias("_gap"),
    )
    least = F.least("_a", "_b")
    gap = F.when((F.col("_a") == 0) & (F.col("_b") == 0), F.lit(None).cast("double")).when(
        least == 0, F.lit(float("inf"))
    ).otherwise(F.col("_gap") / least)
    every = observed.select("source").distinct().join(stats, "source", "left").withColumn("disagreement", gap)
    verdict = (
        F.when(F.col("disagreement").isNull(), "unproven")
        .when(F.col("disagreement") < DISAGREES_ENTIRELY, "agrees")
        .otherwise("contradicts")
    )
    return every.select("source", F.coalesce("shared", F.lit(0)).alias("shared"), "disagreement", verdict.alias("verdict"))


def choose_source(weighed: DataFrame, newest: DataFrame) -> DataFrame:
    """The newest agreeing source, else the newest unproven one (one row), and how
    many contradicting ones were passed over on the way.

    ``newest`` gives source and created_at; candidates are a handful of tables.
    They are gone through from the newest on, so what is older than the chosen
    one is not counted against it.
    """
    place = F.struct((-F.unix_date("created_at")).alias("age"), "source", "verdict")
    ordered = weighed.join(newest, "source").agg(F.sort_array(F.collect_list(place)).alias("o"))
    verdicts = F.transform("o", lambda one: one["verdict"])
    agrees, unproven = F.array_position(verdicts, "agrees").cast("int"), F.array_position(verdicts, "unproven").cast("int")
    taken = F.when(agrees > 0, agrees).otherwise(unproven)
    passed = F.when(agrees > 0, F.slice(verdicts, F.lit(1), agrees - 1)).otherwise(verdicts)
    return ordered.select(
        F.when(taken > 0, F.get("o", taken - 1)["source"]).alias("source"),
        F.size(F.filter(passed, lambda verdict: verdict == "contradicts")).cast("long").alias("contradicting"),
    )


# ---- The log of actuals -----------------------------------------------------
def as_of(log: DataFrame, moment: Column | None = None) -> DataFrame:
    """series_key, target_date, value, revised_at in force at a moment.

    Only the latest reading of each key and date is kept, as a mergeable
    maximum, so a key revised very often costs one state per task.
    """
    seen = log if moment is None else log.filter(F.col("revised_at") <= moment)
    latest = F.max(F.struct("revised_at", "value")).alias("l")
    return seen.groupBy("series_key", "target_date").agg(latest).select(
        "series_key", "target_date", F.col("l.value").alias("value"), F.col("l.revised_at").alias("revised_at")
    )


def changed_readings(readings: DataFrame, log: DataFrame, stamp: Column) -> DataFrame:
    """Readings that differ from what is in force: what the log gains."""
    current = as_of(log, stamp).select("series_key", "target_date", F.col("value").alias("_held"))
    joined = readings.join(current, ["series_key", "target_date"], "left")
    differs = ~F.col("value").eqNullSafe(F.col("_held"))
    return joined.filter(differs).select("series_key", "target_date", "value", stamp.alias("revised_at"))


def revisions(log: DataFrame, key: str, day: Column) -> DataFrame:
    """Every reading of one key and date, in the order it was reported."""
    chosen = log.filter((F.col("series_key") == key) & (F.col("target_date") == day))
    return chosen.orderBy("revised_at")


def restated_since(log: DataFrame, moment: Column) -> DataFrame:
    return log.filter(F.col("revised_at") > moment).select("series_key", "target_date").distinct()


def series_key(columns: Sequence[str]) -> Column:
    """A key map as compact JSON, names in order; empty for the total."""
    if not columns:
        return F.lit("")
    pairs = [part for name in sorted(columns) for part in (F.lit(name), F.col(name).cast("string"))]
    return F.to_json(F.create_map(*pairs))


def graded_periods(points: DataFrame) -> DataFrame:
    """Top-line forecast rows that have an actual, in order."""
    graded = points.filter((F.col("kind") == "forecast") & F.col("forecast").isNotNull() & F.col("actual").isNotNull())
    return graded.select("run_id", "period", "forecast", "actual", (F.col("forecast") - F.col("actual")).alias("miss"))


def lean_share(bias: Column, error: Column) -> Column:
    """Share of the error that points one way."""
    return F.when(error > 0, F.least(F.abs(bias) / error, F.lit(1.0)) * 100)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)

"""What a forecast supports committing to, and what to do about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import (
    CONCENTRATION_LIFT,
    CONCENTRATION_SHARE,
    DIRECTIONAL_ACCURACY,
    DIRECTIONAL_SHARE,
    MATERIAL_DOWNSIDE,
    PERIOD_WORDS,
    PLANNABLE_ACCURACY,
    RELIABLE_BAND_SHARE,
)

#: Two values of one power of two apart share a bucket; a run has a bounded
#: number of buckets, whatever its number of series.
_STEPS = 16


def grade(accuracy: Column) -> Column:
    return (
        F.when(accuracy >= PLANNABLE_ACCURACY, "plannable")
        .when(accuracy >= DIRECTIONAL_ACCURACY, "directional")
        .otherwise("indicative")
    )


def reliable_horizon(points: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """keys, reliable, periods, through, covers_run.

    Leading periods whose band is at most 0.6 of the forecast.
    """
    order = Window.partitionBy(*keys).orderBy("period")
    size = F.abs("forecast")
    bounded = F.col("lower").isNotNull() & F.col("upper").isNotNull() & (size > 0)
    good = bounded & ((F.col("upper") - F.col("lower")) / size <= RELIABLE_BAND_SHARE)
    ranked = points.select(*keys, "period", F.row_number().over(order).alias("step"), F.coalesce(good, F.lit(False)).alias("good"))
    stats = ranked.groupBy(*keys).agg(F.count("*").alias("periods"), F.min(F.when(~F.col("good"), F.col("step"))).alias("_bad"))
    reliable = F.coalesce(F.col("_bad") - 1, F.col("periods"))
    joined = ranked.join(stats.withColumn("reliable", reliable), list(keys))
    return joined.groupBy(*keys, "periods", "reliable").agg(
        F.max(F.when(F.col("step") == F.col("reliable"), F.col("period"))).alias("through")
    ).withColumn("covers_run", F.col("reliable") == F.col("periods"))


def concentration(at_risk: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """keys, leaders, members, share, lopsided: the fewest series with half the risk.

    ``at_risk`` has keys, label, risk. A run may hold any number of series, so
    they are not sorted in one task: sums by size bucket find the bucket in
    which the half is passed, and only that bucket is sorted.
    """
    keys = list(keys)
    positive = at_risk.filter(F.col("risk") > 0).withColumn(
        "_bucket", F.floor(F.log2("risk") * _STEPS).cast("int")
    )
    sums = positive.groupBy(*keys, "_bucket").agg(F.sum("risk").alias("_s"), F.count("*").alias("_c"))
    whole = Window.partitionBy(*keys)
    above = whole.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.select(
        *keys,
        "_bucket",
        "_s",
        F.sum("_s").over(whole).alias("_total"),
        F.sum("_c").over(whole).alias("members"),
        F.coalesce(F.sum("_s").over(above), F.lit(0.0)).alias("_before"),
        F.coalesce(F.sum("_c").over(above), F.lit(0)).alias("_count"),
    )
    half = F.col("_total") * CONCENTRATION_SHARE
    crossing = placed.filter((F.col("_before") < half) & (F.col("_before") + F.col("_s") >= half * (1 - 1e-12)))
    # The last bits of two summation orders may put the half in two buckets.
    first = Window.partitionBy(*keys).orderBy(F.desc("_bucket"))
    crossing = crossing.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "_s")
    inside = positive.join(crossing, [*keys, "_bucket"])
    order = Window.partitionBy(*keys).orderBy(F.desc("risk"), "label")
    running = inside.select(
        *keys,
        "members",
        "_total",
        (F.col("_count") + F.row_number().over(order)).alias("leaders"),
        (F.col("_before") + F.sum("risk").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("_upto"),
    ).filter(F.col("_upto") >= F.col("_total") * CONCENTRATION_SHARE * (1 - 1e-12))
    found = running.groupBy(*keys, "members").agg(
        F.min("leaders").alias("leaders"), F.min_by(F.col("_upto") / F.col("_total") * 100, "leaders").alias("share")
    )
    lopsided = (F.col("members") > 1) & (F.col("leaders") < F.col("members")) & (
        F.col("share") / 100 >= CONCENTRATION_LIFT * F.col("leaders") / F.col("members")
    )
    return found.withColumn("lopsided", lopsided)


def lean(bias: Column, error: Column) -> Column:
    """The bias, where it is at least half of the error."""
    return F.when((error > 0) & (F.abs(bias) >= error * DIRECTIONAL_SHARE), bias)


def decide(
    points: DataFrame, facts: DataFrame, at_risk: DataFrame, *, level: float, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """One row per run: grade, commit, base, prepare, exposure, horizon, risk.

    ``facts`` has accuracy and, once scored, bias, wmape and coverage. A bound
    of exactly zero is a bound.
    """
    keys = list(keys)
    bounded = F.count(F.when(F.col("lower").isNotNull() & F.col("upper").isNotNull(), 1)) > 0
    base = F.sum("forecast")
    totals = points.groupBy(*keys).agg(
        base.alias("base"),
        F.when(bounded, F.sum(F.coalesce("lower", "forecast"))).otherwise(base).alias("commit"),
        F.when(bounded, F.sum(F.coalesce("upper", "forecast"))).otherwise(base).alias("prepare"),
        F.when(F.count("worst_case") == F.count("*"), F.sum("worst_case")).alias("_worst"),
    )
    worst = F.coalesce("_worst", "commit")
    joined = (
        totals.withColumn("exposure", F.col("base") - worst)
        .withColumn("downside_pct", F.when(F.col("base") != 0, (F.col("base") - worst) / F.abs("base") * 100).otherwise(0.0))
        .withColumn("spread_pct", F.when(F.col("base") != 0, F.abs(F.col("prepare") - F.col("commit")) / F.abs("base") * 100).otherwise(0.0))
        .join(reliable_horizon(points, keys), keys)
        .join(facts, keys, "left")
        .join(concentration(at_risk, keys), keys, "left")
    )
    held = F.col("coverage") + 1e-9 >= level * 100
    return joined.drop("_worst").withColumns(
        {"grade": grade(F.col("accuracy")), "lean_pct": lean(F.col("bias"), F.col("wmape")), "interval_held": held}
    )


def actions(decisions: DataFrame, frequency: str, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """keys, urgency, headline: what a decision calls for, most urgent first."""
    one, _ = PERIOD_WORDS[frequency]
    miss = F.col("lean_pct")
    narrow = ~F.col("covers_run")
    rules = (
        (0, miss.isNotNull(), F.format_string("Correct the plan %.1f%% %s", F.abs(miss), F.when(miss > 0, "down").otherwise("up"))),
        (1, F.col("grade") == "indicative", F.lit("Do not set targets from this run")),
        (2, F.col("grade") == "directional", F.lit("Commit at the total, not period by period")),
        (
            3,
            narrow,
            F.when(
                F.col("reliable") > 0, F.format_string(f"Re-forecast before {one} %d", (F.col("reliable") + 1).cast("int"))
            ).otherwise("Re-forecast before committing"),
        ),
        (4, F.col("downside_pct") >= MATERIAL_DOWNSIDE, F.format_string("Hold cover for a %.0f%% shortfall", "downside_pct")),
        (
            5,
            F.coalesce("lopsided", F.lit(False)),
            F.format_string("Start with %d of %d series", F.col("leaders").cast("int"), F.col("members").cast("int")),
        ),
        (6, F.col("interval_held") == F.lit(False), F.lit("Widen the range you plan against")),
    )
    listed = F.array(
        *[
            F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(urgency).alias("urgency"), headline.alias("headline")))
            for urgency, holds, headline in rules
        ]
    )
    found = F.filter(listed, lambda a: a.isNotNull())
    calm = F.array(F.struct(F.lit(9).alias("urgency"), F.lit("Commit to the plan as it stands").alias("headline")))
    staged = decisions.select(*keys, found.alias("_a"))
    return staged.select(*keys, F.explode(F.when(F.size("_a") > 0, F.col("_a")).otherwise(calm)).alias("a")).select(*keys, "a.*")

"""Bands around a forecast, and whether they keep their promise."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import (
    CONFIDENCE,
    COVERAGE_TOLERANCE,
    MIN_COVERAGE_SAMPLE,
    MIN_EMPIRICAL,
    MIN_RELATIVE_SIGMA,
    MIN_SIDE_SHARE,
    SCENARIO_CONFIDENCE,
    SERIES_ID,
    VOLATILITY_WEIGHT,
)


def residual_rows(rows: DataFrame) -> DataFrame:
    """series_id, step, r: what was missed, by how many steps ahead."""
    return rows.select(SERIES_ID, "step", (F.col("y_true") - F.col("y_pred")).alias("r"))


def step_spread(residuals: DataFrame, horizons: DataFrame, *, volatility: str = "volatility") -> DataFrame:
    """series_id, step, sigma, method for every step of the horizon.

    ``horizons`` has series_id, horizon and the history's own volatility, which
    stands in where no fold left a residual.
    """
    pooled = residuals.groupBy(SERIES_ID).agg(
        F.count("*").alias("_n"), F.stddev_samp("r").alias("_std"), F.avg(F.abs("r")).alias("_abs")
    )
    by_step = residuals.groupBy(SERIES_ID, "step").agg(F.count("*").alias("_sn"), F.stddev_samp("r").alias("_ss"))
    steps = horizons.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("horizon"))))
    joined = steps.join(pooled, SERIES_ID, "left").join(by_step, [SERIES_ID, "step"], "left")
    whole = F.when(F.col("_n") > 1, F.col("_std")).otherwise(F.col("_abs"))
    whole = F.when(whole > 0, whole).when(F.col("_abs") > 0, F.col("_abs")).otherwise(1e-9)
    root = F.sqrt(F.col("step").cast("double"))
    own = F.coalesce(F.col("_sn"), F.lit(0)) >= 3
    raw = (
        F.when(F.coalesce(F.col("_n"), F.lit(0)) == 0, F.col(volatility) * VOLATILITY_WEIGHT * root)
        .when(own, F.col("_ss"))
        .otherwise(whole * root)
    )
    series = Window.partitionBy(SERIES_ID)
    upto = series.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    staged = joined.withColumn("_raw", raw).withColumn("_own", F.count_if(own).over(series))
    method = (
        F.when(F.coalesce(F.col("_n"), F.lit(0)) == 0, "series_volatility")
        .when(F.col("_own") >= F.floor(F.col("horizon") / 2), "empirical_per_step")
        .otherwise("pooled_sqrt_scaled")
    )
    return staged.select(SERIES_ID, "step", "horizon", F.max("_raw").over(upto).alias("sigma"), method.alias("method"))


def quantile_offsets(residuals: DataFrame, horizons: DataFrame, level: float) -> DataFrame:
    """series_id, step, low, high where at least eight residuals were kept."""
    tail = (1 - level) / 2
    ends = [F.percentile("r", tail), F.percentile("r", 1 - tail)]
    pooled = residuals.join(horizons.select(SERIES_ID, "horizon"), SERIES_ID).filter("step <= horizon")
    whole = pooled.groupBy(SERIES_ID).agg(F.count("*").alias("_n"), ends[0].alias("_pl"), ends[1].alias("_ph"))
    by_step = pooled.groupBy(SERIES_ID, "step").agg(F.count("*").alias("_sn"), ends[0].alias("_sl"), ends[1].alias("_sh"))
    steps = horizons.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("horizon"))))
    joined = steps.join(whole, SERIES_ID).filter((F.col("_n") >= MIN_EMPIRICAL) & (F.col("_ph") > F.col("_pl")))
    joined = joined.join(by_step, [SERIES_ID, "step"], "left")
    own = F.coalesce(F.col("_sn"), F.lit(0)) >= MIN_EMPIRICAL
    root = F.sqrt(F.col("step").cast("double"))
    staged = joined.withColumn("_l", F.when(own, F.col("_sl")).otherwise(F.col("_pl") * root)).withColumn(
        "_h", F.when(own, F.col("_sh")).otherwise(F.col("_ph") * root)
    )
    side = (F.col("_h") - F.col("_l")) * MIN_SIDE_SHARE
    upto = Window.partitionBy(SERIES_ID).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return staged.select(
        SERIES_ID,
        "step",
        F.min(F.least(F.col("_l"), -side)).over(upto).alias("low"),
        F.max(F.greatest(F.col("_h"), side)).over(upto).alias("high"),
    )


def build_bands(
    forecasts: DataFrame,
    residuals: DataFrame,
    *,
    level: float = CONFIDENCE,
    scenario: float = SCENARIO_CONFIDENCE,
) -> DataFrame:
    """Adds lower, upper, best_case, base_case, worst_case, method.

    ``forecasts`` has series_id, step, forecast, and per series volatility and
    non_negative.
    """
    horizons = forecasts.groupBy(SERIES_ID).agg(
        F.max("step").cast("int").alias("horizon"), F.first("volatility").alias("volatility")
    )
    held = residuals.join(horizons.select(SERIES_ID, "horizon"), SERIES_ID).filter("step <= horizon").drop("horizon")
    spread = step_spread(held, horizons)
    inner = quantile_offsets(held, horizons, level).withColumnsRenamed({"low": "_il", "high": "_ih"})
    outer = quantile_offsets(held, horizons, scenario).withColumnsRenamed({"low": "_ol", "high": "_oh"})
    joined = (
        forecasts.join(spread.drop("horizon"), [SERIES_ID, "step"], "left")
        .join(inner, [SERIES_ID, "step"], "left")
        .join(outer, [SERIES_ID, "step"], "left")
    )
    empirical = F.col("_il").isNotNull() & F.col("_ol").isNotNull()
    z = {name: NormalDist().inv_cdf(0.5 + value / 2) for name, value in (("i", level), ("o", scenario))}

    def offset(name: str, side: str) -> Column:
        gaussian = (-z[name] if side == "l" else z[name]) * F.col("sigma")
        return F.when(empirical, F.col(f"_{name}{side}")).otherwise(gaussian)

    low, high = offset("i", "l"), offset("i", "h")
    wide_low, wide_high = F.least(offset("o", "l"), low), F.greatest(offset("o", "h"), high)
    point = F.col("forecast")
    staged = joined.select(
        "*",
        (point + low).alias("lower"),
        (point + high).alias("upper"),
        (point + wide_low).alias("worst_case"),
        (point + wide_high).alias("best_case"),
        (high - low).alias("_width"),
    )
    floor = F.max(F.abs(point)).over(Window.partitionBy(SERIES_ID)) * MIN_RELATIVE_SIGMA
    staged = staged.withColumn("_floor", floor)
    collapsed = (F.col("upper") - F.col("lower") <= 0) & (F.abs("_width") > 0) & (F.col("_floor") > 0)
    staged = staged.withColumn("lower", F.when(collapsed, point - F.col("_floor")).otherwise(F.col("lower"))).withColumn(
        "upper", F.when(collapsed, point + F.col("_floor")).otherwise(F.col("upper"))
    )
    positive = F.coalesce(F.col("non_negative"), F.lit(False))

    def floored(name: str) -> Column:
        return F.when(positive, F.greatest(F.col(name), F.lit(0.0))).otherwise(F.col(name))

    staged = staged.withColumn("lower", floored("lower")).withColumn("worst_case", floored("worst_case"))
    return staged.withColumns(
        {
            "worst_case": F.least("worst_case", "lower"),
            "best_case": F.greatest("best_case", "upper"),
            "base_case": point,
            "method": F.when(empirical, "empirical_quantiles").otherwise(F.col("method")),
        }
    ).drop("_il", "_ih", "_ol", "_oh", "_width", "_floor", "sigma")


def conformal_halfwidths(points: DataFrame, level: float, *, keys=(SERIES_ID,), monotone: bool = True) -> DataFrame:
    """keys, step, halfwidth: the residual at rank ceil((n + 1) * level).

    Within a series the folds bound the residuals of a step; pooled over
    series (no keys) the rank is found by counting, not by sorting them all.
    """
    keys = list(keys)
    missed = points.select(*keys, "step", F.abs(F.col("y_true") - F.col("y_pred")).alias("_r"))
    missed = missed.filter(F.col("_r").isNotNull())
    if keys:
        order = Window.partitionBy(*keys, "step").orderBy("_r")
        ranked = missed.select(
            "*", F.row_number().over(order).alias("_rank"), F.count("*").over(Window.partitionBy(*keys, "step")).alias("_n")
        )
        wanted = F.least(F.ceil((F.col("_n") + 1) * level), F.col("_n"))
        found = ranked.filter(F.col("_rank") == wanted).select(*keys, "step", F.col("_r").alias("halfwidth"))
    else:
        from tidemark.functions.ranks import value_at_rank

        found = value_at_rank(
            missed, ["step"], "_r", level, lambda n: F.least(F.ceil((n + 1) * level), n), name="halfwidth"
        ).drop("n")
    if not monotone:
        return found
    series = Window.partitionBy(*keys) if keys else Window.partitionBy()
    upto = series.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("halfwidth", F.max("halfwidth").over(upto))


def apply_halfwidths(predictions: DataFrame, halfwidths: DataFrame, *, keys=(SERIES_ID,)) -> DataFrame:
    """Adds lower and upper; a step nothing was measured for takes the widest."""
    keys = list(keys)
    joined = predictions.join(halfwidths, [*keys, "step"], "left")
    if keys:
        widest = halfwidths.groupBy(*keys).agg(F.max("halfwidth").alias("_widest"))
        joined = joined.join(widest, keys, "left")
    else:
        joined = joined.withColumn("_widest", halfwidths.agg(F.max("halfwidth")).scalar())
    width = F.coalesce("halfwidth", "_widest")
    point = F.col("y_pred")
    return joined.select(
        *predictions.columns, (point - width).alias("lower"), (point + width).alias("upper")
    )


def coverage_report(points: DataFrame, level: float, *, keys=()) -> DataFrame:
    """keys, step, observed, n, gap in points, measurable, holds.

    ``points`` has y_true, lower and upper; unusable rows are left out.
    """
    t, low, high = F.col("y_true"), F.col("lower"), F.col("upper")
    usable = points.filter(t.isNotNull() & low.isNotNull() & high.isNotNull())
    inside = (low - 1e-9 <= t) & (t <= high + 1e-9)
    stats = usable.groupBy(*keys, "step").agg(
        F.avg(inside.cast("double")).alias("observed"), F.count("*").alias("n_observations")
    )
    gap = (F.col("observed") - level) * 100
    return stats.select(
        *keys,
        "step",
        F.lit(level).alias("nominal"),
        "observed",
        gap.alias("gap_pp"),
        "n_observations",
        (F.col("n_observations") >= MIN_COVERAGE_SAMPLE).alias("measurable"),
        (F.abs(gap) <= COVERAGE_TOLERANCE).alias("holds"),
    )


def coverage_summary(report: DataFrame, keys=()) -> DataFrame:
    """keys, holds, worst_gap_pp over the steps with enough evidence."""
    seen = F.when(F.col("measurable"), F.struct(F.abs("gap_pp").alias("size"), (-F.col("step")).alias("s"), "gap_pp"))
    return report.groupBy(*keys).agg(
        F.coalesce(F.bool_and(F.when(F.col("measurable"), F.col("holds"))), F.lit(False)).alias("holds"),
        F.max(seen)["gap_pp"].alias("worst_gap_pp"),
    )


def calibration(points: DataFrame, model_widths: DataFrame, level: float, *, keys=(SERIES_ID,)) -> DataFrame:
    """keys, step, coverage before and after the conformal repair."""
    keys = list(keys)
    conformal = conformal_halfwidths(points, level, keys=keys)

    def measured(widths: DataFrame, name: str) -> DataFrame:
        banded = points.join(widths, [*keys, "step"]).select(
            *keys,
            "step",
            "y_true",
            (F.col("y_pred") - F.col("halfwidth")).alias("lower"),
            (F.col("y_pred") + F.col("halfwidth")).alias("upper"),
        )
        report = coverage_report(banded, level, keys=keys)
        return report.select(*keys, "step", F.col("observed").alias(f"{name}_observed"), F.col("gap_pp").alias(f"{name}_gap_pp"))

    before, after = measured(model_widths, "before"), measured(conformal, "after")
    joined = after.join(before, [*keys, "step"], "left").join(conformal, [*keys, "step"])
    improved = F.abs("after_gap_pp") <= F.abs("before_gap_pp") + 1e-9
    return joined.withColumn("improved", F.coalesce(improved, F.lit(True)))


def transfer_bands(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """Put a run's band offsets around its held-out predictions.

    A step beyond the horizon takes the last offset. A band floored at zero no
    longer says how wide it was, so its steps are skipped.
    """
    reach = bands.groupBy(SERIES_ID).agg(F.max("step").alias("_reach"))
    offsets = bands.select(
        SERIES_ID,
        F.col("step").alias("_step"),
        (F.col("lower") - F.col("forecast")).alias("_below"),
        (F.col("upper") - F.col("forecast")).alias("_above"),
        ((F.col("lower") <= 0) & (F.col("forecast") > 0)).alias("_clipped"),
    )
    placed = rows.join(reach, SERIES_ID).withColumn("_step", F.least("step", "_reach"))
    joined = placed.join(offsets, [SERIES_ID, "_step"]).filter(~F.col("_clipped"))
    return joined.select(
        SERIES_ID,
        "step",
        "y_true",
        "y_pred",
        (F.col("y_pred") + F.col("_below")).alias("lower"),
        (F.col("y_pred") + F.col("_above")).alias("upper"),
    )

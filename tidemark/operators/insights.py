"""Insight rules: each turns run tables into rows of the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import (
    ACCURACY_WARNING,
    ANOMALY_Z,
    DOWNSIDE_SEVERE,
    INSIGHT_LIMIT,
    PLANNABLE_ACCURACY,
    SEVERITY_BONUS,
)

Tables = dict[str, DataFrame]
Rule = Callable[[Tables], DataFrame]


def _insight(frame: DataFrame, kind: Column | str, severity: Column | str, title: Column | str, metric: Column | str, value: Column, weight: Column | float) -> DataFrame:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    return frame.select(
        "run_id",
        lit(kind).alias("type"),
        lit(severity).alias("severity"),
        lit(title).alias("title"),
        lit(metric).alias("metric_name"),
        F.round(value.cast("double"), 2).alias("metric_value"),
        lit(weight).cast("double").alias("weight"),
    )


def accuracy_change(tables: Tables) -> DataFrame:
    """Accuracy against the run before, or against the threshold without one."""
    facts = tables["facts"].filter(F.col("accuracy").isNotNull())
    delta = F.col("accuracy") - F.col("previous_accuracy")
    alone = F.col("previous_accuracy").isNull()
    low = F.col("accuracy") < ACCURACY_WARNING
    kept = facts.filter(alone | (F.abs(delta) >= 0.5))
    severity = F.when(alone, F.when(low, "warning").otherwise("positive")).otherwise(F.when(delta > 0, "positive").otherwise("warning"))
    title = F.when(alone, F.when(low, "Forecast Accuracy Below Target").otherwise("Strong Forecast Accuracy")).otherwise(
        F.when(delta > 0, "Accuracy Improving").otherwise("Accuracy Degrading")
    )
    weight = F.when(alone, F.when(low, 70).otherwise(60)).otherwise(F.when(delta > 0, 65).otherwise(75))
    return _insight(
        kept, "accuracy_change", severity, title, F.when(alone, "accuracy").otherwise("accuracy_delta"),
        F.when(alone, F.col("accuracy")).otherwise(delta), weight,
    )


def forecast_gap(tables: Tables) -> DataFrame:
    """The horizon's total against as many periods just passed."""
    facts = tables["facts"]
    change = F.when(F.col("trailing_total") != 0, (F.col("base") - F.col("trailing_total")) / F.abs("trailing_total") * 100)
    kept = facts.filter(F.abs(change) >= 5)
    growing = change > 0
    return _insight(
        kept, "forecast_gap", F.when(growing, "positive").otherwise("warning"),
        F.when(growing, "High Growth Expected").otherwise("Contraction Expected"), "forecast_vs_trailing_pct", change, 80,
    )


def worst_case_risk(tables: Tables) -> DataFrame:
    facts = tables["facts"]
    downside = F.when(F.col("base") != 0, (F.col("base") - F.col("worst")) / F.abs("base") * 100)
    severe = downside >= DOWNSIDE_SEVERE
    return _insight(
        facts.filter(downside >= 3), "worst_case_risk", F.when(severe, "critical").otherwise("warning"), "Worst Case Scenario",
        "worst_case_downside_pct", downside, F.when(severe, 85).otherwise(70),
    )


def anomaly(tables: Tables) -> DataFrame:
    """A period among the last six far from its fitted value."""
    fitted = tables["fitted"].filter(F.col("actual").isNotNull() & F.col("fitted").isNotNull())
    run = Window.partitionBy("run_id")
    miss = F.col("actual") - F.col("fitted")
    rated = fitted.select(
        "run_id", "period", (miss / F.stddev_pop(miss).over(run)).alias("z"), F.count("*").over(run).alias("n"),
        F.row_number().over(run.orderBy(F.desc("period"))).alias("back"),
    )
    worst = rated.filter((F.col("n") >= 8) & (F.col("back") <= 6)).groupBy("run_id").agg(
        F.max(F.struct(F.abs("z").alias("size"), F.col("back"), F.col("z")))["z"].alias("z")
    )
    return _insight(worst.filter(F.abs("z") >= ANOMALY_Z), "anomaly", "warning", "Anomaly Detected", "anomaly_z_score", F.col("z"), 78)


def _extreme(segments: DataFrame, highest: bool) -> DataFrame:
    order = F.struct(F.col("change") if highest else -F.col("change"), F.col("label"))
    known = segments.filter(F.col("change").isNotNull())
    return known.groupBy("run_id").agg(F.max_by(F.struct("label", "change", "forecast", "share"), order).alias("s")).select("run_id", "s.*")


def regional_growth(tables: Tables) -> DataFrame:
    top = _extreme(tables["regions"], True).filter(F.col("change") >= 3)
    return _insight(top, "regional_growth", "positive", "Top Growth Region", "region_growth_pct", F.col("change"), 72)


def category_decline(tables: Tables) -> DataFrame:
    low = _extreme(tables["categories"], False).filter(F.col("change") <= -3)
    return _insight(low, "category_decline", "warning", "Category Decline", "category_change_pct", F.col("change"), 74)


def _driver(tables: Tables, positive: bool) -> DataFrame:
    value = F.col("impact_value")
    drivers = tables["drivers"].filter(value > 0 if positive else value < 0)
    order = F.struct(value if positive else -value, F.col("driver"))
    top = drivers.groupBy("run_id").agg(F.max_by(F.struct("driver", "impact_value", "impact_pct"), order).alias("d"))
    kept = top.select("run_id", "d.*").filter(F.abs("impact_pct") >= 5)
    if positive:
        return _insight(kept, "driver_positive", "positive", F.concat(F.lit("Top Driver: "), "driver"), "driver_impact", value, 68)
    return _insight(kept, "driver_negative", "warning", F.concat(F.lit("Largest Drag: "), "driver"), "driver_impact", value, 76)


def driver_positive(tables: Tables) -> DataFrame:
    return _driver(tables, True)


def driver_negative(tables: Tables) -> DataFrame:
    return _driver(tables, False)


def confidence_widening(tables: Tables) -> DataFrame:
    """The last band against the first, over a horizon of three or more."""
    points = tables["points"]
    width = F.col("upper") - F.col("lower")
    ends = points.filter(width.isNotNull()).groupBy("run_id").agg(
        F.count("*").alias("n"), F.min_by(width, "period").alias("first"), F.max_by(width, "period").alias("last")
    )
    growth = F.col("last") / F.col("first")
    kept = ends.filter((F.col("n") >= 3) & (F.col("first") > 0)).filter(growth >= 1.8)
    return _insight(kept, "confidence_widening", "info", "Confidence Range Widens Sharply", "interval_growth_ratio", growth, 45)


def recommendation(tables: Tables) -> DataFrame:
    """One recommendation per run: data first, then downside, then the top region."""
    top = tables["regions"].groupBy("run_id").agg(F.max_by("share", F.struct("forecast", "label")).alias("_share"))
    facts = tables["facts"].join(top, "run_id", "left")
    downside = F.when(F.col("base") != 0, (F.col("base") - F.col("worst")) / F.abs("base") * 100).otherwise(0.0)
    poor = F.coalesce(F.col("accuracy") < PLANNABLE_ACCURACY, F.lit(False))
    exposed = downside >= DOWNSIDE_SEVERE
    placed = F.col("_share").isNotNull()

    def choose(a, b, c, d) -> Column:
        return F.when(poor, a).when(exposed, b).when(placed, c).otherwise(d)

    return _insight(
        facts, "recommendation", choose("warning", "warning", "info", "info"),
        choose(
            "Recommendation: Improve Input Data", "Recommendation: Plan for the Downside",
            "Recommendation: Concentrate Investment", "Recommendation: Hold Current Plan",
        ),
        choose("accuracy", "base_worst_spread_pct", "top_region_share_pct", "forecast_total"),
        choose(F.col("accuracy"), downside, F.col("_share"), F.col("base")),
        choose(90, 88, 55, 40),
    )


#: The rules, in order; add a function of the same shape to extend them.
RULES: tuple[Rule, ...] = (
    accuracy_change,
    forecast_gap,
    worst_case_risk,
    anomaly,
    regional_growth,
    category_decline,
    driver_positive,
    driver_negative,
    confidence_widening,
    recommendation,
)


def generate(tables: Tables, rules: tuple[Rule, ...] = RULES, limit: int = INSIGHT_LIMIT) -> DataFrame:
    """The strongest insights of each run, by weight and severity."""
    out = None
    for place, rule in enumerate(rules):
        rows = rule(tables).withColumn("_place", F.lit(place))
        out = rows if out is None else out.unionByName(rows)
    bonus = F.create_map(*[F.lit(x) for pair in SEVERITY_BONUS.items() for x in pair])
    known = out.filter(F.col("metric_value").isNotNull() & ~F.isnan("metric_value"))
    score = F.col("weight") + bonus[F.col("severity")]
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(score.desc(), "_place"))
    return known.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("_place")

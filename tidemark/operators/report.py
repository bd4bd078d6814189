"""Accuracy, breakdowns, dashboards, monitors, lists and exports of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import (
    ACCURACY_WARNING,
    HEADLINE_PERIODS,
    HEADLINE_RUNS,
    POOLED_KEY,
    TOP_LINE,
)
from tidemark.functions import metrics
from tidemark.functions.numbers import change_pct
from tidemark.functions.ranks import nearest_rank
from tidemark.operators.intervals import coverage_report
from tidemark.operators.scoring import is_drifted


# ---- Accuracy ----------------------------------------------------------------
def by_horizon(graded: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """keys, step, wape, bias_pct, observations; a step is a scored period."""
    known = graded.filter(F.col("actual").isNotNull() & F.col("forecast").isNotNull())
    t, p = F.col("actual"), F.col("forecast")
    per_period = known.groupBy(*keys, "period").agg(
        metrics.wmape(t, p).alias("wape"), metrics.relative_bias(t, p).alias("bias_pct"), F.count("*").alias("observations")
    )
    step = F.dense_rank().over(Window.partitionBy(*keys).orderBy("period"))
    return per_period.withColumn("step", step)


def by_demand_class(scores: DataFrame, classes: DataFrame, key: str = "series_id") -> DataFrame:
    """Mean realised error per demand class; a point is not claimed for lumpy."""
    joined = scores.join(classes.select(key, "demand_class"), key, "left").na.fill("unclassified", ["demand_class"])
    return joined.groupBy("demand_class").agg(
        F.avg("wmape").alias("wape"),
        F.count("*").alias("series"),
        F.first(F.col("demand_class") != "lumpy").alias("point_forecast_claimed"),
    )


def realised_coverage(graded: DataFrame, level: float) -> DataFrame:
    """Interval coverage of scored points by step."""
    points = graded.filter(F.col("actual").isNotNull() & F.col("lower").isNotNull() & F.col("upper").isNotNull()).drop("step")
    steps = points.select("period").distinct()
    # The scored periods are as few as the horizon is long.
    ranked = steps.withColumn("step", F.row_number().over(Window.orderBy("period")))
    placed = points.join(F.broadcast(ranked), "period").withColumnRenamed("actual", "y_true")
    return coverage_report(placed, level)


def headline(cards: DataFrame) -> DataFrame:
    """One accuracy over all scored runs, weighted by their periods."""
    scored = cards.filter((F.col("scored_periods") > 0) & F.col("wmape").isNotNull())
    weighted = F.try_divide(F.sum(F.col("wmape") * F.col("scored_periods")), F.sum("scored_periods"))
    out = scored.agg(
        F.greatest(F.lit(0.0), 100 - weighted).alias("accuracy_pct"),
        F.count("*").alias("runs_scored"),
        F.coalesce(F.sum("scored_periods"), F.lit(0)).alias("periods_scored"),
    )
    enough = (F.col("runs_scored") >= HEADLINE_RUNS) & (F.col("periods_scored") >= HEADLINE_PERIODS)
    return out.withColumn("publishable", F.col("accuracy_pct").isNotNull() & enough)


def accuracy_report(horizons: DataFrame, classes: DataFrame, coverage: DataFrame, added: DataFrame) -> DataFrame:
    """The four parts as rows: section, item, value, observations."""

    def part(frame: DataFrame, section: str, item: Column, value: Column, count: Column) -> DataFrame:
        return frame.select(
            F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("double").alias("value"), count.cast("bigint").alias("observations")
        )

    return (
        part(horizons, "by_horizon", F.col("step"), F.col("wape"), F.col("observations"))
        .unionByName(part(classes, "by_class", F.col("demand_class"), F.col("wape"), F.col("series")))
        .unionByName(part(coverage, "coverage", F.col("step"), F.col("observed"), F.col("n_observations")))
        .unionByName(part(added, "value_add", F.col("model"), F.col("value_add"), F.lit(1)))
    )


# ---- Breakdowns --------------------------------------------------------------
def breakdown(leaves: DataFrame, label: Column, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Leaves summed by one grain column, with change, accuracy and share.

    Accuracy weighs each leaf by the size of its forecast; the pooled key is
    left out.
    """
    size = F.when(F.col("wmape").isNotNull(), F.abs("forecast_total"))
    grouped = leaves.withColumn("label", label).filter(F.col("label").isNotNull() & (F.col("label") != POOLED_KEY))
    summed = grouped.groupBy(*keys, "label").agg(
        F.sum("forecast_total").alias("forecast"),
        F.sum("prior_total").alias("prior"),
        F.sum("actual_total").alias("actual"),
        F.sum(size).alias("_w"),
        F.sum(F.col("wmape") * size).alias("_e"),
    )
    totals = summed.groupBy(*keys).agg(F.sum("forecast").alias("_whole"))
    joined = summed.join(totals, list(keys))
    measured = F.coalesce(F.col("_w") > 0, F.lit(False))
    return joined.select(
        *keys,
        "label",
        "forecast",
        F.when(F.col("_whole") != 0, F.round(F.col("forecast") / F.col("_whole") * 100, 2)).otherwise(0.0).alias("share"),
        F.when(F.col("prior") != 0, F.col("prior")).alias("prior"),
        change_pct(F.col("forecast"), F.col("prior")).alias("change"),
        F.when(measured, F.round(F.greatest(F.lit(0.0), 100 - F.col("_e") / F.col("_w")), 2)).alias("accuracy"),
        measured.alias("accuracy_measured"),
        "actual",
    )


def sorted_breakdown(rows: DataFrame, sort: str = "forecast", search: str = "") -> DataFrame:
    """Breakdown rows by a measure, largest first and unmeasured last."""
    if sort not in ("forecast", "change", "accuracy", "label"):
        raise ValueError(f"Cannot sort a breakdown by {sort!r}.")
    found = rows.filter(F.lower("label").contains(search.strip().lower())) if search.strip() else rows
    return found.orderBy("label") if sort == "label" else found.orderBy(F.desc_nulls_last(sort), "label")


def available_breakdowns(leaves: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, cardinality of the grain columns that split a run at all."""
    counts = leaves.agg(*[F.countDistinct(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("cardinality")) for c in columns])
    return counts.select(F.explode(rows).alias("r")).select("r.*").filter("cardinality > 1")


# ---- Dashboard ---------------------------------------------------------------
def dashboard_totals(points: DataFrame, extent: DataFrame, *, start=None, end=None) -> DataFrame:
    """Per run: scenario totals in a range, the year's actuals and the year before.

    ``extent`` gives history_start and history_end. The year before is null
    where the history does not reach it.
    """
    joined = points.join(extent, "run_id")
    year = F.trunc("history_end", "year")
    before = F.add_months(year, -12)
    period = F.col("period")
    inside = F.lit(True)
    if start is not None:
        inside = inside & (period >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (period <= F.lit(end).cast("date"))
    ahead = (F.col("kind") == "forecast") & inside
    known = F.col("kind") == "actual"

    def total(name: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(name))), F.lit(0.0))

    summed = joined.groupBy("run_id").agg(
        total("forecast", ahead).alias("forecast_total"),
        total("best_case", ahead).alias("best_total"),
        total("worst_case", ahead).alias("worst_total"),
        total("actual", known & (period >= year) & (period <= F.col("history_end"))).alias("actual_ytd"),
        F.sum(F.when(known & period.between(before, F.add_months("history_end", -12)), F.col("actual"))).alias("_before"),
        F.first(before >= F.col("history_start")).alias("_reaches"),
    )
    prior = F.when(F.col("_reaches") & (F.col("_before") != 0), F.col("_before"))
    return summed.withColumn("prior_ytd", prior).drop("_before", "_reaches")


def kpi_delta(value: Column, comparison: Column, *, points: bool = False, higher_is_better: bool = True) -> dict[str, Column]:
    """delta, direction and tone of a figure beside what it is compared with."""
    delta = value - comparison if points else F.when(comparison != 0, (value - comparison) / F.abs(comparison) * 100)
    moved = F.abs(delta) >= 0.05
    rising = delta > 0
    good = rising == F.lit(higher_is_better)
    return {
        "delta": F.round(delta, 3),
        "direction": F.when(moved & rising, "up").when(moved, "down").otherwise("flat"),
        "tone": F.when(moved & good, "positive").when(moved, "negative").otherwise("neutral"),
    }


def value_at_risk(forecast: Column, error: Column) -> Column:
    return F.abs(forecast) * error / 100


# ---- Monitor and lists -------------------------------------------------------
def monitor(runs: DataFrame, today: Column) -> DataFrame:
    """Adds alert and alert_level to every run; the first rule that holds."""
    accuracy = metrics.accuracy(F.col("wmape"))
    drifted = is_drifted(F.col("tracking_signal"), F.col("wmape"))
    active = F.col("status").isin("pending", "running")
    elapsed = (F.col("forecast_end") <= today) & (F.coalesce("scored_periods", F.lit(0)) == 0)
    rules = (
        (F.col("status") == "failed", "failed", "critical"),
        (active, "active", "info"),
        (drifted, "drift", "warning"),
        (F.coalesce(accuracy < ACCURACY_WARNING, F.lit(False)), "low_accuracy", "warning"),
        (elapsed, "unscored", "warning"),
    )
    alert, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for holds, name, grade in reversed(rules):
        alert, level = F.when(holds, name).otherwise(alert), F.when(holds, grade).otherwise(level)
    return runs.withColumn("alert", alert).withColumn("alert_level", level)


def monitor_counts(monitored: DataFrame) -> DataFrame:
    return monitored.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("alert").isNull()).alias("healthy"),
        F.count_if(F.col("alert_level") == "warning").alias("attention"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isin("pending", "running")).alias("active"),
    )


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count("*").alias("runs"))


def dataset_counts(datasets: DataFrame) -> DataFrame:
    """One row: datasets, ready ones, rows and bytes."""
    return datasets.agg(
        F.count("*").alias("datasets"),
        F.count_if(F.col("ready")).alias("ready"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def search(frame: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """Rows any of whose columns contains the term, whatever its case."""
    needle = term.strip().lower()
    if not needle:
        return frame
    hits = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(needle) for c in columns]
    found = hits[0]
    for hit in hits[1:]:
        found = found | hit
    return frame.filter(found)


# ---- Lists (fixed values: the names of the orders and states) --------------
#: Named orders of runs and of datasets, the usual one first; a minus sorts down.
RUN_ORDERS = {"newest": "-created_at", "oldest": "created_at", "name": "name", "series": "-series"}
DATASET_ORDERS = {
    "newest": "-created_at", "oldest": "created_at", "name": "name", "name_desc": "-name",
    "rows": "-rows", "rows_asc": "rows", "size": "-bytes", "size_asc": "bytes",
}
RUN_STATES = {"completed": ("completed",), "active": ("pending", "running"), "failed": ("failed",)}


def listed(
    frame: DataFrame,
    orders: dict[str, str],
    identity: str,
    *,
    sort: str = "",
    term: str = "",
    searched: Sequence[str] = ("name",),
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """A page in a named order, in the usual one where the name is not known.

    Rows that tie stand by their id, the latest first, so pages do not overlap.
    """
    order = orders.get(sort) or next(iter(orders.values()))
    column = F.col(order.removeprefix("-"))
    placed = column.desc() if order.startswith("-") else column.asc()
    found = search(frame, term, searched)
    return found.orderBy(placed, F.col(identity).desc()).offset(max(0, offset)).limit(max(1, limit))


def in_state(runs: DataFrame, state: str | None) -> DataFrame:
    """Runs in one of the named states; all of them for any other name."""
    return runs.filter(F.col("status").isin(*RUN_STATES[state])) if state in RUN_STATES else runs


def run_states(runs: DataFrame) -> DataFrame:
    """One row: all runs, and how many are in each named state."""
    return runs.agg(
        F.count("*").alias("all"), *[F.count_if(F.col("status").isin(*held)).alias(name) for name, held in RUN_STATES.items()]
    )


def top_line(points: DataFrame) -> DataFrame:
    """run_id, period, forecast of the stored total of each run."""
    kept = points.filter((F.col("level") == 0) & (F.col("kind") == "forecast"))
    return kept.select("run_id", "period", F.coalesce("forecast", F.lit(0.0)).alias("forecast"))


SERIES_SORTS = ("value_at_risk", "wmape", "forecast_total", "label")


def series_list(
    series: DataFrame, *, sort: str = "value_at_risk", level: int | None = None, term: str = "", limit: int = 50, offset: int = 0
) -> DataFrame:
    """A page of series, worst first, unscored last except by name."""
    if sort not in SERIES_SORTS:
        sort = "value_at_risk"
    found = series if level is None else series.filter(F.col("level") == level)
    found = search(found, term, ["label"])
    risk = F.abs("forecast_total") * F.col("wmape")
    order = {
        "value_at_risk": [F.col("wmape").isNull().asc(), risk.desc()],
        "wmape": [F.col("wmape").isNull().asc(), F.desc("wmape")],
        "forecast_total": [F.col("wmape").isNull().asc(), F.desc("forecast_total")],
        "label": [],
    }[sort]
    return found.orderBy(*order, "label").offset(max(0, offset)).limit(max(1, limit))


def worst_at_risk(series: DataFrame, count: int = 5) -> DataFrame:
    """The few series worth a label."""
    risk = F.abs(value_at_risk(F.col("forecast_total"), F.col("wmape")))
    return series.withColumn("value_at_risk", risk).orderBy(F.desc("value_at_risk"), "label").limit(count)


def compare_runs(metrics_table: DataFrame, left: str, right: str) -> DataFrame:
    """name, left, right, delta, delta_pct of two runs' metrics."""
    if left == right:
        raise ValueError(f"Run {left!r} cannot be compared with itself.")
    one = metrics_table.filter(F.col("run_id") == left).select("name", F.col("value").alias("left"))
    two = metrics_table.filter(F.col("run_id") == right).select("name", F.col("value").alias("right"))
    joined = one.join(two, "name", "full")
    delta = F.col("right") - F.col("left")
    pct = F.when(F.col("left") != 0, F.round(delta / F.abs("left") * 100, 2))
    return joined.select("name", "left", "right", F.round(delta, 4).alias("delta"), pct.alias("delta_pct"))


def previous_metrics(runs: DataFrame, metrics_table: DataFrame) -> DataFrame:
    """Each run's metrics beside those of the completed run before it.

    Runs of a dataset are ordered by completion; the earlier one is the latest
    that completed before.
    """
    order = Window.partitionBy("dataset_id").orderBy("completed_at", "run_id")
    done = runs.filter(F.col("status") == "completed")
    paired = done.withColumn("previous_run", F.lag("run_id").over(order)).select("run_id", "previous_run")
    own = metrics_table.join(paired, "run_id")
    before = metrics_table.select(F.col("run_id").alias("previous_run"), "name", F.col("value").alias("previous_value"))
    joined = own.join(before, ["previous_run", "name"], "left")
    return joined.select(
        "run_id", "previous_run", "name", "value", "previous_value", F.round(F.col("value") - F.col("previous_value"), 6).alias("delta")
    )


# ---- Exports -----------------------------------------------------------------
def export_points(points: DataFrame, series: DataFrame) -> DataFrame:
    """A run's points with their series' label, total first."""
    joined = points.join(series.select("series_id", "label"), "series_id", "left")
    ordered = joined.orderBy(F.asc_nulls_first("label"), "period", "kind")
    return ordered.select(F.coalesce("label", F.lit(TOP_LINE)).alias("series"), *[c for c in points.columns if c != "series_id"])


def export_series(leaves: DataFrame) -> DataFrame:
    """Leaf series with their value at risk, riskiest first."""
    risk = value_at_risk(F.col("forecast_total"), F.col("wmape"))
    rows = leaves.select(
        F.col("label").alias("series"), F.col("forecast_total").alias("forecast"), F.col("wmape").alias("wmape_pct"), risk.alias("value_at_risk"), F.col("wmape").isNotNull().alias("measured")
    )
    return rows.orderBy(F.col("wmape_pct").isNull(), F.desc(F.abs("value_at_risk")), "series")


# ---- Usage -------------------------------------------------------------------
def usage_totals(events: DataFrame) -> DataFrame:
    """One row over an event log: counts by status, tokens, cost, latency.

    The 95th percentile is a value that occurred, at rank ceil(p n).
    """
    p95 = nearest_rank(events, [], "latency_ms", 0.95, name="v").agg(F.first("v")).scalar()
    return events.agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 8).alias("cost"),
        F.round(F.avg("latency_ms"), 2).alias("average_latency_ms"),
    ).withColumn("p95_latency_ms", F.round(p95, 2))


def usage_daily(events: DataFrame, first: Column, days: int) -> DataFrame:
    """day, requests, successful, tokens; days without an event are zero."""
    spark = events.sparkSession
    calendar = spark.range(days).select(F.date_add(first, F.col("id").cast("int")).alias("day"))
    daily = events.groupBy(F.col("created_at").cast("date").alias("day")).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.sum("tokens").alias("tokens"),
    )
    return calendar.join(daily, "day", "left").na.fill(0, ["requests", "successful", "tokens"])


def usage_ranking(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per provider and model, the costliest first."""
    grouped = events.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.sum("tokens").alias("tokens"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 8).alias("cost"),
        F.round(F.avg("latency_ms"), 2).alias("average_latency_ms"),
    )
    return grouped.orderBy(F.desc("cost"), F.desc("tokens"), F.desc("requests"), *keys)


def recent_events(events: DataFrame, count: int = 50, tie: str = "event_id") -> DataFrame:
    return events.orderBy(F.desc("created_at"), F.desc(tie)).limit(count)


def model_mix(winners: DataFrame) -> DataFrame:
    """How many series each model won, by route."""
    return winners.groupBy("model", "route").agg(F.count("*").alias("series"))

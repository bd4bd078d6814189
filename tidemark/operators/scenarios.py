"""What-if re-pricing of an issued forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import SIMULATION_WIDENING


def leverage(drivers: DataFrame) -> DataFrame:
    """run_id, driver, leverage: each driver's share of the movement, 0 to 1."""
    share = F.greatest(F.lit(0.0), F.least(F.coalesce(F.col("impact_pct"), F.lit(0.0)) / 100, F.lit(1.0)))
    return drivers.select("run_id", "driver", share.alias("leverage"))


def unknown_drivers(multipliers: DataFrame, levers: DataFrame) -> DataFrame:
    """Scenario drivers a run does not have."""
    return multipliers.join(levers, ["run_id", "driver"], "left_anti")


def scenario_scale(scenarios: DataFrame, multipliers: DataFrame, levers: DataFrame) -> DataFrame:
    """Adds scale = volume * (1 + shift) * product(1 + leverage * (m - 1)).

    ``scenarios`` has run_id, name, volume, shift_pct; ``multipliers`` run_id,
    name, driver, multiplier. A run has a handful of drivers.
    """
    factors = multipliers.join(levers, ["run_id", "driver"]).select(
        "run_id", "name", (1 + F.col("leverage") * (F.col("multiplier") - 1)).alias("f")
    )
    products = factors.groupBy("run_id", "name").agg(
        F.greatest(F.aggregate(F.array_sort(F.collect_list("f")), F.lit(1.0), lambda a, f: a * f), F.lit(0.0)).alias("_p")
    )
    joined = scenarios.join(products, ["run_id", "name"], "left")
    scale = F.col("volume") * (1 + F.col("shift_pct") / 100) * F.coalesce("_p", F.lit(1.0))
    return joined.withColumn("scale", scale).drop("_p")


def simulate(points: DataFrame, scaled: DataFrame) -> DataFrame:
    """Every point of a run under each of its scenarios.

    Bands move with the point and widen with the size of the intervention: an
    assumption nothing was fitted under is less certain than the forecast.
    """
    joined = points.join(scaled.select("run_id", "name", "scale"), "run_id")
    scale, base = F.col("scale"), F.coalesce("forecast", F.lit(0.0))
    widening = 1 + SIMULATION_WIDENING * F.abs(scale - 1)
    simulated = base * scale

    def moved(name: str) -> Column:
        return simulated + (F.col(name) - base) * scale * widening

    low, high = moved("lower"), moved("upper")
    return joined.select(
        "run_id",
        "name",
        "period",
        base.alias("baseline"),
        simulated.alias("simulated"),
        low.alias("lower"),
        high.alias("upper"),
        F.coalesce(moved("best_case"), high, simulated).alias("best_case"),
        F.coalesce(moved("worst_case"), low, simulated).alias("worst_case"),
        (simulated - base).alias("delta"),
        F.when(base != 0, (simulated - base) / F.abs(base) * 100).otherwise(0.0).alias("delta_pct"),
    )


def scenario_totals(simulated: DataFrame) -> DataFrame:
    """run_id, name and the totals a saved scenario keeps."""
    totals = simulated.groupBy("run_id", "name").agg(
        F.sum("baseline").alias("baseline_total"),
        F.sum("simulated").alias("simulated_total"),
        F.sum("best_case").alias("best_total"),
        F.sum("worst_case").alias("worst_total"),
    )
    delta = F.col("simulated_total") - F.col("baseline_total")
    pct = F.when(F.col("baseline_total") != 0, delta / F.abs("baseline_total") * 100).otherwise(0.0)
    return totals.withColumn("total_delta", delta).withColumn("total_delta_pct", pct)

"""Key paths: roll-ups, parents, and forecasts that add up at every level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import (
    DS,
    KEY_SEPARATOR,
    MAX_STRETCH,
    MIN_TOTAL,
    SCALABLE_FRACTION,
    SERIES_ID,
    TOP_LINE,
    Y,
)
from tidemark.session import cut_lineage


def path_of(label: Column) -> Column:
    return F.split(label, f"\\Q{KEY_SEPARATOR}\\E")


def label_of(path: Column) -> Column:
    return F.when(F.size(path) == 0, TOP_LINE).otherwise(F.array_join(path, KEY_SEPARATOR))


def bottom_up(panel: DataFrame, depth: int, *, value: str = Y) -> DataFrame:
    """level, series_id, ds and the sum of value for every level above the leaves."""
    path = path_of(F.col(SERIES_ID))
    prefixes = F.transform(
        F.sequence(F.lit(1), F.lit(depth - 1)), lambda d: F.struct(d.alias("level"), F.slice(path, F.lit(1), d).alias("p"))
    )
    spread = panel.select(DS, value, F.explode(prefixes).alias("x"))
    return (
        spread.groupBy(F.col("x.level").alias("level"), F.array_join("x.p", KEY_SEPARATOR).alias(SERIES_ID), DS)
        .agg(F.sum(value).alias(value))
    )


def roll_up(leaves: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Leaves with an array ``path``: their sums for every prefix of the path.

    A value no child reported stays null. Adds level; ``path`` is the prefix.
    """
    prefixes = F.transform(F.sequence(F.lit(0), F.size("path")), lambda d: F.slice("path", F.lit(1), d))
    spread = leaves.select(*by, *values, F.explode(prefixes).alias("path"))
    return spread.groupBy("path", *by).agg(*[F.sum(v).alias(v) for v in values]).withColumn("level", F.size("path"))


def attach_parents(nodes: DataFrame) -> DataFrame:
    """Adds the label of the node one level up; the top has none."""
    above = F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))
    return nodes.withColumn("parent_label", F.when(F.size("path") > 0, label_of(above)))


def reconcile_level(
    children: DataFrame, parents: DataFrame, non_negative: Column | bool = True
) -> DataFrame:
    """Scale children so they add to their parent's path, step by step.

    ``children`` has path, step, forecast and share, ``parents`` path, step and
    reconciled. Where the children sum to nothing their shares divide the
    parent. Negatives are clipped only where the histories have none.
    """
    keep = F.lit(non_negative) if isinstance(non_negative, bool) else non_negative
    above = F.slice("path", F.lit(1), F.size("path") - 1)
    placed = children.withColumn("_parent", above)
    totals = parents.select(F.col("path").alias("_parent"), "step", F.col("reconciled").alias("_total"))
    joined = placed.join(totals, ["_parent", "step"])
    point = F.coalesce("forecast", F.col("_total") * F.col("share"))
    joined = joined.withColumn("_point", F.when(keep, F.greatest(point, F.lit(0.0))).otherwise(point))
    # Sums are combined before the shuffle and joined back, so a parent with
    # very many children does not meet in one task.
    sums = joined.groupBy("_parent", "step").agg(
        F.sum("_point").alias("_sum"), F.sum("share").alias("_share"), F.count("*").alias("_children")
    )
    whole = joined.join(sums, ["_parent", "step"])
    fallback = F.when(F.abs("_share") > MIN_TOTAL, F.col("share") / F.col("_share")).otherwise(1 / F.col("_children"))
    weight = F.when(F.abs("_sum") > MIN_TOTAL, F.col("_point") / F.col("_sum")).otherwise(fallback)
    return whole.select("path", "step", "forecast", "share", (weight * F.col("_total")).alias("reconciled"))


def reconcile(nodes: DataFrame, total: DataFrame, depth: int, non_negative: Column | bool = True) -> DataFrame:
    """Top-down over the levels: path, step, forecast, share, reconciled.

    ``nodes`` holds every level below the top; ``total`` has step and forecast.
    One pass per level, as many as the grain has columns; each is written, so that
    the plan of a level holds the one above once.
    """
    nodes = cut_lineage(nodes, "nodes")
    top = total.select(
        F.array().cast("array<string>").alias("path"),
        "step",
        F.col("forecast"),
        F.lit(1.0).alias("share"),
        F.col("forecast").alias("reconciled"),
    )
    out, parents = top, top
    for level in range(1, depth + 1):
        parents = cut_lineage(reconcile_level(nodes.filter(F.size("path") == level), parents, non_negative), "level")
        out = out.unionByName(parents)
    return out


def coherence_gap(leaves: DataFrame, total: DataFrame, *, value: str = "forecast") -> DataFrame:
    """One row: how far the leaves' sum lies from the direct total."""
    implied = leaves.agg(F.sum(value)).scalar()
    direct = total.agg(F.sum(value).alias("direct"))
    gap = F.when(F.abs("direct") < MIN_TOTAL, 0.0).otherwise(F.abs(F.col("implied") - F.col("direct")) / F.abs("direct"))
    return direct.withColumn("implied", implied).select("implied", "direct", gap.alias("gap"))


def leaf_shares(leaves: DataFrame, value: str = "current_total") -> DataFrame:
    """Adds share, by magnitude; equal shares where the whole is nothing.

    The whole is one number, summed before it is shared out.
    """
    whole = leaves.agg(F.struct(F.sum(F.abs(value)).alias("t"), F.count("*").alias("n"))).scalar()
    staged = leaves.withColumn("_w", whole)
    share = F.when(F.col("_w.t") > 0, F.abs(value) / F.col("_w.t")).otherwise(1 / F.col("_w.n"))
    return staged.withColumn("share", share).drop("_w")


def rescale_bands(points: DataFrame) -> DataFrame:
    """Carry a leaf's band onto its reconciled path; null where it cannot be.

    ``points`` has series_id, step, forecast, lower, upper, reconciled. A path
    turned round or more than doubled no longer says what was measured.
    """
    series = Window.partitionBy(SERIES_ID)
    point, target = F.col("forecast"), F.col("reconciled")
    staged = points.withColumn("_own", F.sum(point).over(series)).withColumn("_new", F.sum(target).over(series))
    staged = staged.withColumn("_top", F.max(F.abs(point)).over(series))
    stretch = F.col("_new") / F.col("_own")
    holds = (F.col("_top") > 0) & ((F.col("_own") == 0) | ((stretch > 0) & (stretch <= MAX_STRETCH)))
    scale = F.when(F.abs(point) > F.col("_top") * SCALABLE_FRACTION, target / point).otherwise(1.0)

    def moved(name: str) -> Column:
        return F.when(holds, target + (F.col(name) - point) * scale)

    return staged.select(
        *[c for c in points.columns if c not in ("lower", "upper")], moved("lower").alias("lower"), moved("upper").alias("upper")
    )


def segment_comparison(segments: DataFrame, inherited_accuracy: Column | None = None) -> DataFrame:
    """Adds change against the prior window, share of the forecast, accuracy.

    ``segments`` has label, forecast_value, current_total, prior_total, accuracy.
    """
    total = segments.agg(F.sum("forecast_value")).scalar()
    prior = F.col("prior_total")
    change = F.when(prior != 0, F.round((F.col("current_total") - prior) / F.abs(prior) * 100, 2))
    share = F.when(F.col("_t") != 0, F.round(F.col("forecast_value") / F.col("_t") * 100, 2)).otherwise(0.0)
    own = F.col("accuracy")
    return (
        segments.withColumn("_t", total)
        .withColumn("change_vs_last_year", change)
        .withColumn("share", share)
        .withColumn("accuracy_measured", own.isNotNull())
        .withColumn("accuracy", F.coalesce(own, inherited_accuracy) if inherited_accuracy is not None else own)
        .drop("_t")
    )

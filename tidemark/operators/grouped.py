"""One grouped run: leaves, the direct top line, and every level between that adds up.

The leaves of a grain and the top line are series of one run: they are backtested
on the same plan and chosen by the same rule. The top line is forecast by itself
and taken as the better reading of the whole; the levels below are scaled to it
from the top down, the leaves' bands with them. Paths of the grain are arrays all
the way, so a key may hold any character.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import CONFIDENCE, DS, ENSEMBLE_MEMBERS, SEASON, SERIES_ID, Y
from tidemark.functions import metrics
from tidemark.functions.dates import add_periods
from tidemark.operators import forecasters, hierarchy, run
from tidemark.session import cut_lineage
from tidemark.sources import store

#: What became of a node: forecast by its own model or its children's, or given its share only.
FORECAST, ESTIMATED = "forecast", "estimated"
_NODE = ("path", "label", "parent_label", "level")


@dataclass(frozen=True)
class GroupedRun:
    """The tables of one run, by name as :func:`issue` stores them."""

    #: path, label, parent_label, level, step, ds, own, forecast, lower, upper, model.
    points: DataFrame
    #: One row per node: its model and errors, totals, share, status and reason.
    series: DataFrame
    #: implied, direct, gap: how far the leaves' own forecasts lie from the top line.
    gap: DataFrame
    candidates: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"points": self.points, "series": self.series, "gap": self.gap, "candidates": self.candidates}


def _id_of(path: Column) -> Column:
    """A text that no other path has."""
    return F.to_json(path)


def _totals(leaves: DataFrame, frequency: str) -> DataFrame:
    """path, current_total, prior_total: the last season and the one before."""
    end = leaves.agg(F.max(DS)).scalar()
    season = SEASON[frequency]
    now = F.col(DS) > add_periods(F.col("_end"), -season, frequency)
    before = ~now & (F.col(DS) > add_periods(F.col("_end"), -2 * season, frequency))
    staged = leaves.withColumn("_end", end)
    return staged.groupBy("path").agg(
        F.coalesce(F.sum(F.when(now, F.col(Y))), F.lit(0.0)).alias("current_total"), F.sum(F.when(before, F.col(Y))).alias("prior_total")
    )


def run_grouped(
    leaves: DataFrame,
    frequency: str,
    horizon: int,
    depth: int,
    *,
    level: float = CONFIDENCE,
    fill: str = "auto",
    sigmas: float | None = None,
    requested: Sequence[str] = forecasters.FULL_ROSTER,
    weights: dict[str, float] | None = None,
    members: int = ENSEMBLE_MEMBERS,
    shape: Column | None = None,
) -> GroupedRun:
    """Forecast a grain of ``depth`` keys: ``leaves`` has path (array), ds, y.

    A leaf that no model can follow is given its share of the top line, by the
    size of its last season, and says why. Negative forecasts are clipped before
    scaling only where no leaf's history has a negative value. Depth zero is the
    top line alone.
    """
    leaves = cut_lineage(leaves.select("path", DS, F.col(Y).cast("double").alias(Y)), "leaves")
    top = leaves.groupBy(DS).agg(F.sum(Y).alias(Y)).select(F.lit("[]").alias(SERIES_ID), DS, Y)
    panel = top
    if depth:
        panel = leaves.select(_id_of(F.col("path")).alias(SERIES_ID), DS, Y).unionByName(top)
    out = run.run_forecast(panel, frequency, horizon, level=level, fill=fill, sigmas=sigmas, requested=requested, weights=weights, members=members, shape=shape)
    points = cut_lineage(out.points, "points")
    candidates = cut_lineage(out.candidates, "candidates")
    direct = points.filter(F.col(SERIES_ID) == "[]")
    total = direct.select("step", "forecast")

    shares = cut_lineage(hierarchy.leaf_shares(_totals(leaves, frequency)).withColumn(SERIES_ID, _id_of(F.col("path"))), "shares")
    # One row a step of the horizon.
    steps = total.agg(F.collect_list(F.struct("step", F.col("forecast").alias("_total")))).scalar()
    own = points.select(SERIES_ID, "step", F.col("forecast").alias("_own"))
    grid = shares.select("path", SERIES_ID, "share", F.inline(steps))
    pointed = grid.join(own, [SERIES_ID, "step"], "left").select("path", "step", F.coalesce("_own", F.col("_total") * F.col("share")).alias("forecast"), "share")
    nodes = hierarchy.roll_up(pointed, ["forecast", "share"], ["step"]).filter("level > 0").drop("level")
    positive = leaves.agg(F.coalesce(F.min(Y), F.lit(0.0)) >= 0).scalar()
    if depth:
        tree = hierarchy.reconcile(nodes.withColumn("_keep", positive), total, depth, F.col("_keep"))
    else:
        tree = total.select(F.array().cast("array<string>").alias("path"), "step", "forecast", F.lit(1.0).alias("share"), F.col("forecast").alias("reconciled"))
    tree = cut_lineage(hierarchy.attach_parents(tree).select("path", "parent_label", F.size("path").alias("level"), "step", F.col("forecast").alias("own"), "reconciled"), "tree")

    banded = points.select(SERIES_ID, "step", DS, "forecast", "lower", "upper", "model")
    moved = hierarchy.rescale_bands(
        tree.withColumn(SERIES_ID, _id_of(F.col("path"))).join(banded.drop(DS), [SERIES_ID, "step"])
    ).select(SERIES_ID, "step", "lower", "upper", "model")
    days = direct.select("step", DS)
    label = hierarchy.label_of(F.col("path")).alias("label")
    told = (
        tree.withColumn(SERIES_ID, _id_of(F.col("path")))
        .join(moved, [SERIES_ID, "step"], "left")
        .join(F.broadcast(days), "step")
        .select("path", label, "parent_label", "level", "step", DS, "own", F.col("reconciled").alias("forecast"), "lower", "upper", "model")
    )
    told = cut_lineage(told, "told")

    history = hierarchy.roll_up(shares, ["current_total", "prior_total"]).select("path", "current_total", "prior_total")
    chosen = candidates.filter("selected").select(SERIES_ID, F.col("model").alias("chosen"), "wmape", "mase", "folds")
    blocked = out.errors.select(SERIES_ID, F.col("reason").alias("blocked_reason"))
    summed = told.groupBy(*_NODE).agg(F.sum("forecast").alias("forecast_total"), F.max("model").alias("model"))
    whole = told.filter("level = 0").agg(F.sum("forecast")).scalar()
    described = summed.withColumn(SERIES_ID, _id_of(F.col("path"))).join(history, "path", "left").join(chosen, SERIES_ID, "left").join(blocked, SERIES_ID, "left")
    estimated = (F.col("level") == depth) & F.col("model").isNull()
    series = described.withColumn("_whole", whole).select(
        *_NODE,
        "model",
        F.when(F.col("model").isNotNull(), F.col("wmape")).alias("wmape"),
        F.when(F.col("model").isNotNull(), F.col("mase")).alias("mase"),
        F.when(F.col("model").isNotNull(), metrics.accuracy(F.col("wmape"))).alias("accuracy"),
        F.when(F.col("model").isNotNull(), F.col("folds")).otherwise(0).alias("folds"),
        "forecast_total",
        "current_total",
        "prior_total",
        F.when(F.col("_whole") != 0, F.round(F.col("forecast_total") / F.col("_whole") * 100, 2)).alias("share"),
        F.when(estimated, ESTIMATED).otherwise(FORECAST).alias("status"),
        F.when(estimated, F.col("blocked_reason")).alias("blocked_reason"),
    )
    gap = hierarchy.coherence_gap(told.filter(F.col("level") == depth).select(F.col("own").alias("forecast")), total)
    return GroupedRun(told, cut_lineage(series, "series"), gap, candidates)


def issue(grouped: GroupedRun, path: str, run_id: str) -> None:
    """Store every table of the run at once, or nothing that a reader sees."""
    store.issue_run(grouped.tables(), path, run_id)

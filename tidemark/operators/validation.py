"""Per-series validation, quality reports and the coverage grid."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import (
    DS,
    INTERMITTENT_SHARE,
    LOW_COVERAGE,
    MAD_TO_SIGMA,
    MIN_OBSERVATIONS,
    MIN_PERIODS,
    OUTLIER_SIGMAS,
    PARTIAL_RATIO,
    SERIES_ID,
    SEVERE_COVERAGE,
    Y,
)
from tidemark.functions import arrays
from tidemark.functions.columns import near_zero
from tidemark.functions.dates import add_periods, period_index


def findings_of(*rules: tuple[str, str, Column, Column]) -> Column:
    """Array of (code, severity, count) for the rules that hold, in order."""
    listed = F.array(
        *[
            F.when(
                F.coalesce(holds, F.lit(False)),
                F.struct(
                    F.lit(code).alias("code"),
                    F.lit(severity).alias("severity"),
                    count.cast("bigint").alias("count"),
                ),
            )
            for code, severity, holds, count in rules
        ]
    )
    return F.filter(listed, lambda item: item.isNotNull())


def severity_in(findings: Column, severity: str) -> Column:
    return F.exists(findings, lambda item: item["severity"] == severity)


def worst_severity(findings: Column) -> Column:
    """The gravest severity of a list, null for an empty one."""
    return (
        F.when(severity_in(findings, "severe"), "severe")
        .when(severity_in(findings, "warning"), "warning")
        .when(severity_in(findings, "info"), "info")
    )


def codes_text(findings: Column) -> Column:
    return F.array_join(
        F.transform(findings, lambda f: F.concat_ws(":", f["code"], f["count"].cast("string"))), ","
    )


def _order_facts(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """Days, first and last reading, and values far from the middle, of each series."""
    offsets, values, known = arrays.flat(arrays.column(batch, "_y"))
    days, there = arrays.flat(arrays.column(batch, "_days").cast(pa.list_(pa.int32())))[1:]
    out = {name: np.zeros(batch.num_rows, dtype=np.int64) for name in ("periods", "first_known", "last_known", "far")}
    for rows, places in arrays.by_length(offsets):
        if not places.shape[1]:
            continue
        # Days are in order, so equal ones are neighbours.
        held, seen, day = known[places], there[places], days[places]
        fresh = np.concatenate((seen[:, :1], seen[:, 1:] & ~(seen[:, :-1] & (day[:, 1:] == day[:, :-1]))), axis=1)
        out["periods"][rows] = fresh.sum(axis=1)
        out["first_known"][rows] = held.argmax(axis=1)
        out["last_known"][rows] = places.shape[1] - 1 - held[:, ::-1].argmax(axis=1)
        y = np.where(held, values[places], np.nan)
        off = np.abs(y - arrays.median(y)[:, None])
        mad = arrays.median(off)[:, None]
        out["far"][rows] = ((mad > 0) & (off > MAD_TO_SIGMA * mad * OUTLIER_SIGMAS)).sum(axis=1)
    some = np.add.reduceat(np.append(known, False), offsets[:-1]) > 0 if len(offsets) > 1 else np.zeros(0, dtype=bool)
    return {
        "periods": pa.array(out["periods"]),
        **{name: pa.array(out[name].astype(np.int32), mask=~some) for name in ("first_known", "last_known")},
        "far": pa.array(out["far"]),
    }


def validate_panel(panel: DataFrame, frequency: str, *, min_history: int | None = None) -> DataFrame:
    """One row per series: status, route, observations, extent, findings.

    A null value is a period reported empty; a period without a row is a gap.
    """
    required = MIN_OBSERVATIONS[frequency] if min_history is None else min_history
    known = F.col(Y).isNotNull()
    index = period_index(F.col(DS), frequency)
    gathered = panel.groupBy(SERIES_ID).agg(
        F.count("*").alias("n"),
        F.count_if(known).alias("finite"),
        F.min(DS).alias("start"),
        F.max(DS).alias("end"),
        (F.max(index) - F.min(index) + 1).alias("expected"),
        F.count_if(known & near_zero(F.col(Y))).alias("zeros"),
        F.count_if(F.col(Y) < 0).alias("negatives"),
        (F.max(Y) - F.min(Y)).alias("range"),
        F.sort_array(F.collect_list(F.struct(DS, Y))).alias("_rows"),
    )
    gathered = gathered.withColumn("_days", F.col(f"_rows.{DS}")).withColumn("_y", F.col(f"_rows.{Y}")).drop("_rows")
    stats = arrays.add_columns(gathered, _order_facts, "periods long, first_known int, last_known int, far long", ("_days", "_y"))
    n, finite = F.col("n"), F.col("finite")
    enough = n >= 2
    checked = enough & (finite > 0)
    zero_share = F.try_divide(F.col("zeros"), finite)
    leading = F.col("first_known")
    trailing = n - 1 - F.col("last_known")
    gaps = F.col("expected") - F.col("periods")
    duplicates = n - F.col("periods")
    outliers = F.when(finite >= 5, F.col("far")).otherwise(F.lit(0))
    mixed = zero_share < INTERMITTENT_SHARE
    findings = findings_of(
        ("duplicate_timestamps", "severe", duplicates > 0, duplicates),
        ("no_history", "severe", ~enough, n),
        ("all_null", "severe", enough & (finite == 0), n),
        ("short_history", "warning", checked & (n < required), n),
        ("all_zero", "warning", checked & (zero_share >= 1), finite),
        ("intermittent_demand", "warning", checked & (zero_share >= INTERMITTENT_SHARE) & (zero_share < 1), F.col("zeros")),
        ("constant_target", "warning", checked & mixed & (F.col("range") == 0), finite),
        ("negative_values", "info", checked & (F.col("negatives") > 0), F.col("negatives")),
        ("calendar_gaps", "warning", checked & (gaps > 0), gaps),
        ("leading_nulls", "info", checked & (leading > 0), leading),
        ("trailing_nulls", "warning", checked & (trailing > 0), trailing),
        ("outliers", "info", checked & (outliers > 0), outliers),
    )
    status = (
        F.when(severity_in(F.col("findings"), "severe"), "reject")
        .when(F.size("findings") > 0, "warn")
        .otherwise("ok")
    )
    fallback = (n < required) | (F.coalesce(zero_share, F.lit(0.0)) >= INTERMITTENT_SHARE)
    route = F.when(F.col("status") == "reject", "none").when(fallback, "fallback").otherwise("model")
    return (
        stats.withColumn("findings", findings)
        .withColumn("status", status)
        .select(SERIES_ID, "status", route.alias("route"), n.alias("observations"), "start", "end", "findings")
    )


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("series"))


def reason_counts(report: DataFrame) -> DataFrame:
    """How many series carry each finding, most first."""
    each = report.select(F.explode("findings.code").alias("code"))
    return each.groupBy("code").agg(F.count("*").alias("series")).orderBy(F.desc("series"), "code")


def history_lengths(report: DataFrame, frequency: str, *, width: int = 6) -> DataFrame:
    """Histogram of observations per series, with the required length beside."""
    bucket = (F.floor(F.col("observations") / width) * width).alias("from_periods")
    return report.groupBy(bucket).agg(
        F.count("*").alias("series"),
        F.count_if(F.col("observations") < MIN_OBSERVATIONS[frequency]).alias("below_required"),
    )


def quality_report(
    cells: DataFrame,
    frequency: str,
    *,
    keys: Sequence[str] = (SERIES_ID,),
    fill: str = "auto",
    rows_scanned: str | None = None,
) -> DataFrame:
    """One row per series over its aggregated periods (ds, y, row_count)."""
    series = Window.partitionBy(*keys)
    order = series.orderBy(DS)
    index = period_index(F.col(DS), frequency)
    steps = cells.select(
        *keys,
        DS,
        Y,
        "row_count",
        index.alias("_index"),
        (index - F.lag(index).over(order) - 1).alias("_missing"),
        (F.col(Y) - F.lag(Y).over(order)).alias("_step"),
        F.first(Y).over(order).alias("_first"),
        F.median("row_count").over(series).alias("_typical"),
    )
    centred = steps.withColumn("_off", F.abs(F.col("_step") - F.median("_step").over(series)))
    scaled = centred.withColumn(
        "_mad", MAD_TO_SIGMA * F.median("_off").over(series)
    ).withColumn("_mean_off", F.avg("_off").over(series))
    scale = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.col("_mean_off"))
    jump = (scale > 0) & (F.col("_off") / scale > OUTLIER_SIGMAS)
    same = F.abs(F.col(Y) - F.col("_first")) <= F.lit(1e-8) + F.lit(1e-5) * F.abs("_first")
    stats = scaled.groupBy(*keys).agg(
        F.sum("row_count").alias("rows_usable"),
        F.count("*").alias("periods_present"),
        (F.max("_index") - F.min("_index") + 1).alias("periods_expected"),
        F.coalesce(F.sum("_missing"), F.lit(0)).alias("gap_count"),
        F.coalesce(F.max("_missing"), F.lit(0)).alias("longest_gap"),
        F.count_if((F.col("_typical") > 0) & (F.col("row_count") < F.col("_typical") * PARTIAL_RATIO)).alias(
            "partial_periods"
        ),
        F.count_if(jump).alias("_jumps"),
        F.count_if(F.col(Y) < 0).alias("negative_periods"),
        F.count_if(near_zero(F.col(Y))).alias("zero_periods"),
        F.bool_and(same).alias("_same"),
        F.min(DS).alias("range_start"),
        F.max(DS).alias("range_end"),
    )
    present, expected = F.col("periods_present"), F.col("periods_expected")
    coverage = present / expected
    gaps = F.col("gap_count")
    resolved = F.lit(fill)
    if fill == "auto":
        resolved = F.when(F.col("zero_periods") / present >= INTERMITTENT_SHARE, "zero").otherwise("interpolate")
    out = stats.select(
        *keys,
        "rows_usable",
        present,
        expected,
        coverage.alias("coverage"),
        gaps,
        "longest_gap",
        (F.col("rows_usable") - present).alias("duplicate_rows"),
        "partial_periods",
        F.when(present >= 5, F.col("_jumps")).otherwise(F.lit(0)).alias("outlier_periods"),
        "negative_periods",
        "zero_periods",
        ((present >= 2) & F.col("_same")).alias("constant_target"),
        "range_start",
        "range_end",
        F.when(gaps > 0, resolved).otherwise("none").alias("fill_applied"),
    )
    zero = F.lit(0)
    issues = findings_of(
        ("too_few_periods", "severe", present < MIN_PERIODS, present),
        ("constant_target", "warning", F.col("constant_target"), zero),
        ("calendar_gaps", "warning", (gaps > 0) & (F.col("coverage") >= SEVERE_COVERAGE), gaps),
        ("calendar_gaps", "severe", (gaps > 0) & (F.col("coverage") < SEVERE_COVERAGE), gaps),
        ("low_coverage", "warning", (gaps == 0) & (F.col("coverage") < LOW_COVERAGE), zero),
        ("duplicate_timestamps", "info", F.col("duplicate_rows") > 0, F.col("duplicate_rows")),
        ("partial_periods", "warning", F.col("partial_periods") > 0, F.col("partial_periods")),
        ("outliers", "info", F.col("outlier_periods") > 0, F.col("outlier_periods")),
        ("negative_values", "info", F.col("negative_periods") > 0, F.col("negative_periods")),
    )
    return out.withColumn("issues", issues).withColumn("blocked", severity_in(F.col("issues"), "severe"))


def coverage_grid(
    panel: DataFrame,
    report: DataFrame,
    frequency: str,
    *,
    max_series: int = 150,
    max_periods: int = 120,
) -> DataFrame:
    """The patchiest series over the last periods, one row each.

    Columns: position (first-period order), series_id, observations, gaps,
    zeros, status, route, first_ds and ``values``, one slot per period.
    """
    extent = panel.agg(F.struct(F.min(DS).alias("a"), F.max(DS).alias("b"))).scalar()
    last = period_index(extent["b"], frequency)
    start = F.greatest(period_index(extent["a"], frequency), last - F.lit(max_periods - 1))
    slots = panel.select(
        SERIES_ID, Y, DS, (period_index(F.col(DS), frequency) - start).alias("_slot"), (last - start + 1).alias("_width")
    )
    inside = F.col("_slot") >= 0
    counted = slots.groupBy(SERIES_ID).agg(
        F.count_if(inside & F.col(Y).isNotNull()).alias("observations"),
        F.count_if(inside & (F.col(Y) == 0)).alias("zeros"),
        F.min(F.when(inside & F.col(Y).isNotNull(), F.col("_slot"))).alias("_first"),
        F.first("_width").alias("_width"),
    )
    rows = counted.withColumn("gaps", F.col("_width") - F.col("observations"))
    # At most max_series rows: they are shown on one page.
    head = rows.orderBy(F.desc("gaps"), SERIES_ID).limit(max_series)
    kept = slots.filter(inside & F.col(Y).isNotNull()).join(
        F.broadcast(head.select(SERIES_ID)), SERIES_ID, "left_semi"
    )
    packed = kept.groupBy(SERIES_ID).agg(
        F.map_from_entries(F.collect_list(F.struct("_slot", Y))).alias("_cells")
    )
    joined = head.join(packed, SERIES_ID, "left").join(
        report.select(SERIES_ID, "status", "route"), SERIES_ID, "left"
    )
    slot_values = F.transform(
        F.sequence(F.lit(0), F.col("_width") - 1), lambda i: F.try_element_at(F.col("_cells"), i)
    )
    order = Window.orderBy(F.coalesce("_first", "_width"), SERIES_ID)
    return joined.select(
        F.row_number().over(order).alias("position"),
        SERIES_ID,
        "observations",
        "gaps",
        "zeros",
        F.coalesce("status", F.lit("ok")).alias("status"),
        F.coalesce("route", F.lit("model")).alias("route"),
        F.when(
            F.col("_first").isNotNull(),
            add_periods(extent["b"], F.col("_first") - F.col("_width") + 1, frequency),
        ).alias("first_ds"),
        slot_values.alias("values"),
    )


def coverage_bands(grid: DataFrame) -> DataFrame:
    """Colour band of each grid cell: 0 no row, 1 a zero, 2 to 5 by quartile.

    A cut is the sorted element at floor(q * n), not an interpolated quantile;
    the grid holds at most a page of cells.
    """
    cells = grid.select(SERIES_ID, F.posexplode("values").alias("slot", "value"))
    ordered = F.sort_array(F.collect_list(F.when(F.col("value") > 0, F.col("value"))))
    sorted_values = cells.agg(ordered.alias("v"))

    def at(share: float) -> Column:
        size = F.size("v")
        place = F.least(size - 1, F.floor(F.lit(share) * size)).cast("int")
        return F.when(size > 0, F.get("v", place)).otherwise(F.lit(0.0))

    cuts = sorted_values.select(F.array(at(0.25), at(0.5), at(0.75))).scalar()
    value = F.col("value")
    band = (
        F.when(value.isNull(), 0)
        .when(value == 0, 1)
        .when(value <= F.col("_cuts")[0], 2)
        .when(value <= F.col("_cuts")[1], 3)
        .when(value <= F.col("_cuts")[2], 4)
        .otherwise(5)
    )
    return cells.withColumn("_cuts", cuts).select(SERIES_ID, "slot", "value", band.alias("band"))

"""Regular calendars: alignment, gaps, frequency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import (
    DAYS_PER_PERIOD,
    DS,
    FREQUENCIES,
    GAP_BANDS,
    MIN_GAP_AGREEMENT,
    MIN_GRID_COVERAGE,
    SERIES_ID,
    Y,
)
from tidemark.functions.dates import add_periods, period_index, periods_between


def align_calendar(
    panel: DataFrame,
    frequency: str,
    *,
    keys: Sequence[str] = (SERIES_ID,),
    values: Sequence[str] = (Y,),
    weight: str | None = None,
) -> DataFrame:
    """Put each series on its regular calendar, holes kept as null.

    Every row is stretched over the periods up to the next one, so the whole
    alignment is one window over the series and needs no join. Adds ``t``, the
    position on the calendar from 0, and ``n``, its length. A missing period
    weighs nothing.
    """
    series = Window.partitionBy(*keys)
    following = F.lead(DS).over(series.orderBy(DS))
    first, last = F.min(DS).over(series), F.max(DS).over(series)
    carried = [*values, *([weight] if weight else [])]
    placed = panel.select(
        *keys, DS, *carried, following.alias("_next"), first.alias("_first"), last.alias("_last")
    )
    reach = F.when(
        F.col("_next") > F.col(DS),
        periods_between(F.col(DS), add_periods(F.col("_next"), -1, frequency), frequency),
    ).otherwise(F.array(DS))
    spread = placed.withColumn("_at", F.explode(reach))
    origin = period_index(F.col("_first"), frequency)

    def held(name: str) -> Column:
        kept = F.when(F.col("_at") == F.col(DS), F.col(name))
        return F.coalesce(kept, F.lit(0.0)) if name == weight else kept

    return spread.select(
        *keys,
        (period_index(F.col("_at"), frequency) - origin).alias("t"),
        (period_index(F.col("_last"), frequency) - origin + 1).alias("n"),
        F.col("_at").alias(DS),
        *[held(name).alias(name) for name in carried],
    )


def align_arrays(
    panel: DataFrame,
    frequency: str,
    *,
    keys: Sequence[str] = (SERIES_ID,),
    values: Sequence[str] = (Y,),
    weight: str | None = None,
) -> DataFrame:
    """One row per series: keys, n and ``points``, the rows of `align_calendar`
    as an array of (t, ds, values) in calendar order.

    Only rows that exist are shuffled and sorted; holes are put in afterwards,
    series by series.
    """
    carried = [*values, *([weight] if weight else [])]
    kinds = {name: panel.schema[name].dataType for name in carried}
    gathered = panel.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(DS, *carried))).alias("_rows"),
        F.min(DS).alias("_first"),
        F.max(DS).alias("_last"),
    )
    origin = period_index(F.col("_first"), frequency)

    def stretched(row: Column, following: Column) -> Column:
        reach = F.when(
            following > row[DS], periods_between(row[DS], add_periods(following, -1, frequency), frequency)
        ).otherwise(F.array(row[DS]))

        def held(name: str, at: Column) -> Column:
            kept = F.when(at == row[DS], row[name])
            return F.coalesce(kept, F.lit(0.0).cast(kinds[name])) if name == weight else kept

        return F.transform(
            reach,
            lambda at: F.struct(
                (period_index(at, frequency) - origin).alias("t"), at.alias(DS), *[held(name, at).alias(name) for name in carried]
            ),
        )

    after = F.concat(F.slice(F.col(f"_rows.{DS}"), F.lit(2), F.size("_rows")), F.array(F.lit(None).cast("date")))
    return gathered.select(
        *keys,
        (period_index(F.col("_last"), frequency) - origin + 1).alias("n"),
        F.flatten(F.zip_with("_rows", after, stretched)).alias("points"),
    )


def packed(aligned: DataFrame, *, keys: Sequence[str] = (SERIES_ID,), values: Sequence[str] = (Y,)) -> DataFrame:
    """Aligned rows as `align_arrays` gives them."""
    rows = F.sort_array(F.collect_list(F.struct("t", DS, *values)))
    return aligned.groupBy(*keys, "n").agg(rows.alias("points"))


def future_periods(last: Column, horizon: int, frequency: str) -> Column:
    """Array of (step, ds) for the periods after the last one."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(horizon)),
        lambda step: F.struct(step.alias("step"), add_periods(last, step, frequency).alias(DS)),
    )


def horizon_ceiling(first: Column, last: Column, frequency: str) -> Column:
    """The longest horizon a history can measure: half of its calendar."""
    length = period_index(last, frequency) - period_index(first, frequency) + 1
    return F.floor(length * 0.5).cast("int")


def clamped_horizon(requested: int, first: Column, last: Column, frequency: str) -> Column:
    """A default horizon held to the ceiling, at least one period."""
    ceiling = horizon_ceiling(first, last, frequency)
    return F.when((ceiling < 1) | (ceiling >= requested), F.lit(requested)).otherwise(ceiling)


def check_horizon(panel: DataFrame, requested: int, frequency: str) -> int:
    """Refuse a chosen horizon the history cannot measure."""
    if requested <= 0:
        raise ValueError(f"A horizon of {requested} periods forecasts nothing.")
    row = panel.agg(F.min(DS).alias("a"), F.max(DS).alias("b")).select(
        horizon_ceiling(F.col("a"), F.col("b"), frequency).alias("ceiling")
    ).first()
    ceiling = row["ceiling"]
    if ceiling is not None and 1 <= ceiling < requested:
        raise ValueError(f"A {requested}-period horizon is longer than half the history ({ceiling}).")
    return requested


def infer_frequency(days: DataFrame, *, keys: Sequence[str] = (SERIES_ID,), ds: str = DS) -> DataFrame:
    """The calendar step each series is on, or null where it has none.

    The typical gap must fall in a band most gaps agree with, and the implied
    calendar must be one the series largely fills; failing that, the coarsest
    calendar it can fill.
    """
    # The day of a timestamp: a series then has at most one value per day.
    distinct = days.select(*keys, F.col(ds).cast("date").alias("_d")).filter(F.col("_d").isNotNull()).distinct()
    order = Window.partitionBy(*keys).orderBy("_d")
    gaps = distinct.withColumn("_gap", F.datediff("_d", F.lag("_d").over(order)))

    def in_band(gap: Column, frequency: str) -> Column:
        return gap.between(*GAP_BANDS[frequency])

    # A series has at most one gap per day of its calendar.
    stats = gaps.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.datediff(F.max("_d"), F.min("_d")).alias("_span"),
        F.sort_array(F.collect_list("_gap")).alias("_gaps"),
        *[F.count_if(in_band(F.col("_gap"), f)).alias(f"_in_{f}") for f in FREQUENCIES],
    )
    count = F.col("_n")
    span = F.greatest(F.col("_span"), F.lit(1))
    middle = F.get(F.col("_gaps"), F.floor(F.size("_gaps") / 2).cast("int"))

    def fills(frequency: str) -> Column:
        expected = F.greatest(F.lit(1.0), F.bround(span / DAYS_PER_PERIOD[frequency], 0) + 1)
        return count >= MIN_GRID_COVERAGE * expected

    answer = F.when(count < 3, F.lit(None).cast("string"))
    for frequency in FREQUENCIES:
        agreed = F.col(f"_in_{frequency}") >= MIN_GAP_AGREEMENT * F.size("_gaps")
        answer = answer.when(in_band(middle, frequency) & agreed & fills(frequency), F.lit(frequency))
    for frequency in reversed(FREQUENCIES):
        answer = answer.when(fills(frequency), F.lit(frequency))
    return stats.select(*keys, count.alias("periods"), middle.alias("typical_gap"), answer.alias("frequency"))


def gap_runs(panel: DataFrame, frequency: str, *, keys: Sequence[str] = (SERIES_ID,)) -> DataFrame:
    """Per series: periods present and expected, gaps and the longest run of them.

    The distance between two neighbouring rows says how many periods are
    missing between them, so the gaps need not be written out.
    """
    order = Window.partitionBy(*keys).orderBy(DS)
    index = period_index(F.col(DS), frequency)
    steps = panel.withColumn("_missing", index - F.lag(index).over(order) - 1)
    return steps.groupBy(*keys).agg(
        F.count("*").alias("periods_present"),
        (F.max(index) - F.min(index) + 1).alias("periods_expected"),
        F.coalesce(F.sum("_missing"), F.lit(0)).alias("gap_count"),
        F.coalesce(F.max("_missing"), F.lit(0)).alias("longest_gap"),
        F.min(DS).alias("range_start"),
        F.max(DS).alias("range_end"),
    )

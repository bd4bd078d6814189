"""Rows to periods: the reducers, series, segments and grouped series.

SUM, MEAN, MIN, MAX and LAST keep a small mergeable state, so Spark combines
them before the shuffle and a hot key costs one state per task. MEDIAN has no
such state on raw rows and goes through :mod:`tidemark.functions.ranks`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import (
    KEY_SEPARATOR,
    MAX_SEGMENTS,
    MAX_SERIES,
    PERIODS_PER_YEAR,
    POOLED_KEY,
    POOLED_LABEL,
    SERIES_HARD_LIMIT,
    SERIES_INLINE,
)
from tidemark.functions.columns import col, key_text, require
from tidemark.functions.dates import as_date, as_double, checked, period_start, within
from tidemark.functions.names import natural_aggregation
from tidemark.functions.ranks import exact_quantile

DAY, VALUE, WEIGHT, PERIOD = "_day", "_value", "_weight", "period"


@dataclass(frozen=True)
class Reducer:
    """An aggregate as state, merge and result, each an ordinary expression."""

    state: dict[str, str]
    merge: dict[str, str]
    result: str


#: The reducers a measure can be aggregated with. LAST takes the value on the
#: latest date; among rows of that date the largest, so the answer is one.
REDUCERS: dict[str, Reducer] = {
    "sum": Reducer({"a": f"sum({VALUE})"}, {"a": "sum(a)"}, "a"),
    "mean": Reducer(
        {"a": f"sum({VALUE})", "b": f"count({VALUE})"}, {"a": "sum(a)", "b": "sum(b)"}, "a / b"
    ),
    "min": Reducer({"a": f"min({VALUE})"}, {"a": "min(a)"}, "a"),
    "max": Reducer({"a": f"max({VALUE})"}, {"a": "max(a)"}, "a"),
    "last": Reducer(
        {"a": f"max(named_struct('d', {DAY}, 'v', {VALUE}))"}, {"a": "max(a)"}, "a.v"
    ),
}
AGGREGATIONS = (*REDUCERS, "median")


def _known(aggregation: str) -> str:
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"Unknown aggregation {aggregation!r}; use one of {', '.join(AGGREGATIONS)}.")
    return aggregation


def usable_rows(
    rows: DataFrame,
    time: str,
    target: str,
    *,
    keys: dict[str, Column] | None = None,
    weight: str | None = None,
    start=None,
    end=None,
) -> DataFrame:
    """Rows whose time reads as a date and whose target reads as a number."""
    require(rows, [time, target, *([weight] if weight else [])])
    rows = within(rows, time, start, end)
    chosen = rows.select(
        *[value.alias(name) for name, value in (keys or {}).items()],
        as_date(rows, time).alias(DAY),
        as_double(rows, target).alias(VALUE),
        *([as_double(rows, weight).alias(WEIGHT)] if weight else []),
    )
    return chosen.filter(F.col(DAY).isNotNull() & F.col(VALUE).isNotNull())


def reduce_to_periods(
    usable: DataFrame,
    keys: Sequence[str],
    frequency: str,
    aggregation: str = "sum",
    *,
    weighted: bool = False,
) -> DataFrame:
    """One row per key and period: value, row_count and, if asked, weight."""
    checked(frequency), _known(aggregation)
    grain = [*keys, PERIOD]
    placed = usable.withColumn(PERIOD, period_start(F.col(DAY), frequency))
    extra = [F.count("*").alias("row_count")]
    if weighted:
        extra.append(F.coalesce(F.sum(WEIGHT), F.lit(0.0)).alias("weight"))
    if aggregation == "median":
        middle = exact_quantile(placed, grain, VALUE, 0.5, name="value").drop("n")
        return middle.join(placed.groupBy(*grain).agg(*extra), grain, "inner")
    reducer = REDUCERS[aggregation]
    states = [F.expr(text).alias(name) for name, text in reducer.state.items()]
    out = placed.groupBy(*grain).agg(*states, *extra)
    return out.select(
        *grain,
        F.expr(reducer.result).cast("double").alias("value"),
        "row_count",
        *(["weight"] if weighted else []),
    )


def aggregate_series(
    rows: DataFrame,
    time: str,
    target: str,
    frequency: str,
    *,
    weight: str | None = None,
    start=None,
    end=None,
    aggregation: str = "sum",
) -> DataFrame:
    """The whole table as one series: period, value, row_count, weight."""
    usable = usable_rows(rows, time, target, weight=weight, start=start, end=end)
    return reduce_to_periods(usable, [], frequency, aggregation, weighted=weight is not None)


def scan_counts(rows: DataFrame, time: str, target: str, frequency: str) -> DataFrame:
    """Rows scanned, rows usable and rows sharing a period with another."""
    day, value = as_date(rows, time), as_double(rows, target)
    usable = day.isNotNull() & value.isNotNull()
    by_period = (
        rows.select(
            F.when(usable, period_start(day, frequency)).alias(PERIOD), usable.alias("usable")
        )
        .groupBy(PERIOD)
        .agg(F.count("*").alias("rows"), F.count_if("usable").alias("usable"))
    )
    return by_period.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_scanned"),
        F.coalesce(F.sum("usable"), F.lit(0)).alias("rows_usable"),
        F.coalesce(F.sum(F.greatest(F.col("usable") - 1, F.lit(0))), F.lit(0)).alias("duplicate_rows"),
    )


def comparison_window(count: Column, frequency: str) -> Column:
    """A year of periods where two years are held, otherwise half of them."""
    year = PERIODS_PER_YEAR[checked(frequency)]
    half = F.greatest(F.lit(1), F.floor(count / 2).cast("int"))
    return F.when(count >= 2 * year, F.lit(year)).otherwise(half)


def recency(cells: DataFrame, frequency: str, window: int | None = None) -> DataFrame:
    """Each observed period with its recency rank and the window it falls in.

    The calendar bounds this table, so ranking it in one task is safe. The
    ``value`` total keeps its scan identical to the cells' own, which lets
    Spark reuse their shuffle instead of reading the source again.
    """
    periods = cells.groupBy(PERIOD).agg(F.sum("value").alias("_total"))
    periods = periods.filter(F.col("_total").isNotNull()).drop("_total")
    whole = Window.partitionBy()
    ranked = periods.select(
        PERIOD,
        F.row_number().over(Window.orderBy(F.desc(PERIOD))).alias("recent_rank"),
        F.count("*").over(whole).alias("period_count"),
    )
    width = F.lit(window) if window else comparison_window(F.col("period_count"), frequency)
    return ranked.withColumn("_width", width).select(
        PERIOD,
        "recent_rank",
        "period_count",
        F.col("_width").alias("window_periods"),
        (F.col("recent_rank") <= F.col("_width")).alias("is_current"),
        F.col("recent_rank").between(F.col("_width") + 1, 2 * F.col("_width")).alias("is_prior"),
        (F.col("period_count") > F.col("_width")).alias("has_prior"),
    )


def _window_totals(cells: DataFrame, keys: Sequence[str], frequency: str, window: int | None) -> DataFrame:
    # The calendar bounds the periods table (a day each for 250 years is under
    # 100 000 rows of a few bytes), so it is broadcast.
    placed = cells.join(F.broadcast(recency(cells, frequency, window)), PERIOD)
    return placed.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("is_current"), F.col("value"))), F.lit(0.0)).alias("current_total"),
        F.when(
            F.bool_or("has_prior"),
            F.coalesce(F.sum(F.when(F.col("is_prior"), F.col("value"))), F.lit(0.0)),
        ).alias("prior_total"),
    )


def _leaders(totals: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """The keys that keep their own name: all of them, or the first most - 1.

    Only ``most + 1`` rows ever reach one task: Spark takes that many per
    partition and merges them.
    """
    order = [F.desc("current_total"), *[F.asc(key) for key in keys]]
    head = totals.orderBy(*order).limit(most + 1)
    ranked = head.select(
        *keys,
        F.row_number().over(Window.orderBy(*order)).alias("_rank"),
        F.count("*").over(Window.partitionBy()).alias("_held"),
    )
    kept = (F.col("_held") <= most) | (F.col("_rank") <= most - 1)
    return ranked.filter(kept).select(*keys, F.lit(True).alias("_kept"))


def segment_cells(
    rows: DataFrame,
    time: str,
    target: str,
    segment: str,
    frequency: str,
    *,
    start=None,
    end=None,
    aggregation: str = "sum",
) -> DataFrame:
    """label, period, value; rows without a segment are left out."""
    require(rows, [segment])
    labelled = rows.filter(col(segment).isNotNull())
    usable = usable_rows(
        labelled, time, target, keys={"label": col(segment).cast("string")}, start=start, end=end
    )
    return reduce_to_periods(usable, ["label"], frequency, aggregation).drop("row_count")


def segment_totals(
    cells: DataFrame, frequency: str, *, window: int | None = None, most: int = MAX_SEGMENTS
) -> DataFrame:
    """label, current_total, prior_total, members; the tail pooled as Others."""
    totals = _window_totals(cells, ["label"], frequency, window)
    kept = F.broadcast(_leaders(totals, ["label"], most))
    named = totals.join(kept, "label", "left").withColumn(
        "label", F.when(F.col("_kept"), F.col("label")).otherwise(F.lit(POOLED_LABEL))
    )
    pooled = ~F.coalesce(F.col("_kept"), F.lit(False))
    return named.groupBy("label", pooled.alias("pooled")).agg(
        F.sum("current_total").alias("current_total"),
        F.sum("prior_total").alias("prior_total"),
        F.count("*").alias("members"),
    )


def segment_series(
    cells: DataFrame, frequency: str, *, window: int | None = None, most: int = MAX_SEGMENTS
) -> DataFrame:
    """label, period, value on the calendar all segments share.

    A period a segment has no row for is null; the pooled segment adds up what
    its members did report.
    """
    totals = _window_totals(cells, ["label"], frequency, window)
    kept = F.broadcast(_leaders(totals, ["label"], most))
    named = cells.join(kept, "label", "left").select(
        F.when(F.col("_kept"), F.col("label")).otherwise(F.lit(POOLED_LABEL)).alias("label"),
        (~F.coalesce(F.col("_kept"), F.lit(False))).alias("pooled"),
        PERIOD,
        "value",
    )
    merged = named.groupBy("label", "pooled", PERIOD).agg(F.sum("value").alias("value"))
    return on_shared_calendar(merged, ["label", "pooled"])


def on_shared_calendar(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key on every observed period; a missing cell is null, not zero."""
    calendar = cells.select(PERIOD).distinct().agg(F.array_sort(F.collect_list(PERIOD))).scalar()
    # One row per key carries its cells as a map; the calendar bounds its size.
    packed = cells.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(PERIOD, "value"))).alias("_cells")
    )
    spread = packed.select(*keys, "_cells", F.explode(calendar).alias(PERIOD))
    return spread.select(*keys, PERIOD, F.try_element_at("_cells", F.col(PERIOD)).alias("value"))


def grouped_cells(
    rows: DataFrame,
    time: str,
    target: str,
    group_columns: Sequence[str],
    frequency: str,
    *,
    start=None,
    end=None,
    aggregation: str = "sum",
) -> DataFrame:
    """k0.., period, value per combination of the grouping columns."""
    if not group_columns:
        raise ValueError("Name the columns to group by.")
    require(rows, group_columns)
    keys = {f"k{i}": key_text(name) for i, name in enumerate(group_columns)}
    usable = usable_rows(rows, time, target, keys=keys, start=start, end=end)
    return reduce_to_periods(usable, list(keys), frequency, aggregation).drop("row_count")


#: The longest head of a ranking that goes out with a broadcast hint.
BROADCAST_ROWS = 20_000


def bound_keys(
    cells: DataFrame,
    keys: Sequence[str],
    frequency: str,
    *,
    window: int | None = None,
    max_series: int | None = MAX_SERIES,
) -> DataFrame:
    """Re-key the tail beyond ``max_series`` to one pooled series.

    The pooled value is the sum of its members' period values whatever the
    reducer, so totals are conserved for SUM. With no ``max_series`` every
    series stays its own.
    """
    if max_series is None:
        return cells.groupBy(*keys, PERIOD).agg(F.sum("value").alias("value")).select(
            *keys, F.lit(False).alias("pooled"), PERIOD, "value", F.lit(0).cast("long").alias("pooled_from")
        )
    most = max(1, int(max_series))
    totals = _window_totals(cells, keys, frequency, window)
    kept = _leaders(totals, keys, most)
    # The head has as many rows as were asked for; a long one is left to Spark.
    kept = F.broadcast(kept) if most <= BROADCAST_ROWS else kept
    marked = cells.join(kept, list(keys), "left")
    pooled = ~F.coalesce(F.col("_kept"), F.lit(False))
    # Counted beside the total so that this branch reuses the cells' shuffle.
    tail = totals.join(kept, list(keys), "left").agg(
        F.struct(F.count_if(F.col("_kept").isNull()).alias("n"), F.sum("current_total").alias("t"))
    )
    members = tail.scalar()["n"]
    return (
        marked.select(
            *[F.when(pooled, F.lit(POOLED_KEY)).otherwise(F.col(key)).alias(key) for key in keys],
            pooled.alias("pooled"),
            PERIOD,
            "value",
        )
        .groupBy(*keys, "pooled", PERIOD)
        .agg(F.sum("value").alias("value"))
        .withColumn("pooled_from", F.when(F.col("pooled"), members).otherwise(F.lit(0)))
    )


def grouped_series(
    cells: DataFrame,
    keys: Sequence[str],
    frequency: str,
    *,
    window: int | None = None,
    max_series: int | None = MAX_SERIES,
) -> DataFrame:
    """One row per kept series: key, label, totals of both windows, pooled_from."""
    bounded = bound_keys(cells, keys, frequency, window=window, max_series=max_series)
    totals = _window_totals(bounded, [*keys, "pooled", "pooled_from"], frequency, window)
    label = F.when(F.col("pooled"), F.lit(POOLED_LABEL)).otherwise(
        F.concat_ws(KEY_SEPARATOR, *[F.col(key) for key in keys])
    )
    return totals.select(*keys, label.alias("label"), "current_total", "prior_total", "pooled_from")


def distinct_series(rows: DataFrame, group_columns: Sequence[str]) -> DataFrame:
    """How many series a grain has (one row, column series_count)."""
    if not group_columns:
        return rows.sparkSession.range(1).select(F.lit(1).cast("bigint").alias("series_count"))
    require(rows, group_columns)
    keys = rows.select(*[key_text(name).alias(f"k{i}") for i, name in enumerate(group_columns)])
    return keys.distinct().agg(F.count("*").alias("series_count"))


def admission(series_count: DataFrame) -> DataFrame:
    """Whether a grain is served inline, queued or refused."""
    count = F.col("series_count")
    verdict = (
        F.when(count > SERIES_HARD_LIMIT, "refuse").when(count > SERIES_INLINE, "queue").otherwise("inline")
    )
    return series_count.select("series_count", verdict.alias("admission"))


def observed_window(
    rows: DataFrame,
    time: str,
    target: str,
    frequency: str,
    *,
    start,
    end,
    group_columns: Sequence[str] = (),
    aggregation: str = "sum",
) -> DataFrame:
    """Totals per period and, where asked, per key and period.

    ``is_total`` marks the totals. The key cells are aggregated once and their
    states merged into the totals; only MEDIAN reads the rows a second time.
    """
    keys = {f"k{i}": key_text(name) for i, name in enumerate(group_columns)}
    require(rows, group_columns)
    usable = usable_rows(rows, time, target, keys=keys, start=start, end=end)
    names = list(keys)
    if aggregation == "median" or not names:
        totals = reduce_to_periods(usable, [], frequency, aggregation).drop("row_count")
        totals = totals.select(
            F.lit(True).alias("is_total"), *[F.lit(None).cast("string").alias(k) for k in names], PERIOD, "value"
        )
        if not names:
            return totals
        keyed = reduce_to_periods(usable, names, frequency, aggregation)
        return totals.unionByName(keyed.select(F.lit(False).alias("is_total"), *names, PERIOD, "value"))
    reducer = REDUCERS[_known(aggregation)]
    cells = (
        usable.withColumn(PERIOD, period_start(F.col(DAY), frequency))
        .groupBy(*names, PERIOD)
        .agg(*[F.expr(text).alias(name) for name, text in reducer.state.items()])
    )
    key_columns = [F.col(name) for name in names]
    merged = cells.groupingSets([[F.col(PERIOD)], [*key_columns, F.col(PERIOD)]], *key_columns, F.col(PERIOD)).agg(
        *[F.expr(text).alias(f"s_{name}") for name, text in reducer.merge.items()],
        (F.grouping(names[0]) == 1).alias("is_total"),
    )
    renamed = merged.select("is_total", *names, PERIOD, *[F.col(f"s_{n}").alias(n) for n in reducer.merge])
    return renamed.select("is_total", *names, PERIOD, F.expr(reducer.result).cast("double").alias("value"))


def reach(rows: DataFrame, time: str) -> DataFrame:
    """Earliest and latest date a table holds (one row)."""
    days = rows.select(as_date(rows, time).alias("d"))
    return days.agg(F.min("d").alias("earliest"), F.max("d").alias("latest"))


def driver_series(
    rows: DataFrame,
    time: str,
    columns: Sequence[str],
    frequency: str,
    *,
    per_column: dict[str, str] | None = None,
) -> DataFrame:
    """driver, period, value: each column reduced by what it is.

    A level (a rate, a price, an index) is averaged, a quantity added up.
    """
    require(rows, [time, *columns])
    day = as_date(rows, time)
    chosen = {name: (per_column or {}).get(name) or natural_aggregation(name) for name in columns}
    for aggregation in chosen.values():
        _known(aggregation)
    base = rows.select(
        day.alias(DAY), *[as_double(rows, name).alias(f"c{i}") for i, name in enumerate(columns)]
    ).filter(F.col(DAY).isNotNull()).withColumn(PERIOD, period_start(F.col(DAY), frequency))

    def reduced(i: int, aggregation: str) -> Column:
        value = F.col(f"c{i}")
        if aggregation == "last":
            return F.max(F.when(value.isNotNull(), F.struct(F.col(DAY), value.alias("v"))))["v"]
        return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[aggregation](value)

    direct = [(i, name) for i, name in enumerate(columns) if chosen[name] != "median"]
    parts = []
    if direct:
        wide = base.groupBy(PERIOD).agg(*[reduced(i, chosen[name]).alias(f"c{i}") for i, name in direct])
        pairs = F.array(
            *[F.struct(F.lit(name).alias("driver"), F.col(f"c{i}").alias("value")) for i, name in direct]
        )
        parts.append(wide.select(PERIOD, F.explode(pairs).alias("p")).select("p.driver", PERIOD, "p.value"))
    for i, name in enumerate(columns):
        if chosen[name] == "median":
            middle = exact_quantile(base, [PERIOD], f"c{i}", 0.5, name="value")
            parts.append(middle.select(F.lit(name).alias("driver"), PERIOD, "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def align_drivers(drivers: DataFrame, calendar: DataFrame) -> DataFrame:
    """Drivers on the run's calendar; one present in under half of it is dropped."""
    periods = calendar.select(PERIOD).distinct()
    array = periods.agg(F.array_sort(F.collect_list(PERIOD))).scalar()
    packed = drivers.filter(F.col("value").isNotNull()).groupBy("driver").agg(
        F.map_from_entries(F.collect_list(F.struct(PERIOD, "value"))).alias("_cells")
    )
    spread = packed.withColumn("_calendar", array).withColumn(
        "_present", F.size(F.array_intersect(F.map_keys("_cells"), F.col("_calendar")))
    )
    kept = spread.filter(F.col("_present") >= F.floor(F.size("_calendar") / 2))
    return kept.select("driver", "_cells", F.explode("_calendar").alias(PERIOD)).select(
        "driver", PERIOD, F.try_element_at("_cells", F.col(PERIOD)).alias("value")
    )


def prefix_totals(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Sums over every key prefix per period: level, k0.., period, value.

    Cells hold one row per key and period, so one rollup over them suffices.
    """
    names = [F.col(key) for key in keys]
    sets = [[*names[:depth], F.col(PERIOD)] for depth in range(len(keys) + 1)]
    rolled = cells.groupingSets(sets, *names, F.col(PERIOD)).agg(
        F.sum(value).alias("_sum"),
        *[F.grouping(key).alias(f"_g{i}") for i, key in enumerate(keys)],
    )
    level = F.lit(len(keys)) - sum(F.col(f"_g{i}") for i in range(len(keys)))
    return rolled.select(level.cast("int").alias("level"), *keys, PERIOD, F.col("_sum").alias(value))

"""Queries for calendars, validation, quality and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.constants import DAILY, MONTHLY, QUARTERLY, WEEKLY
from tidemark.operators import calendar, canonical, validation
from tidemark.plans.catalog import query, table
from tidemark.plans.panels import (
    aligned_sql,
    key_cells,
    part_panel,
    part_panel_sql,
    supplier_panel,
    supplier_panel_sql,
    trunc_sql,
)


@query(
    "align_calendar",
    "series_id:str t:int n:int ds:date y:2",
    f"WITH {aligned_sql(part_panel_sql(), MONTHLY)} SELECT series_id, t, n, ds, y FROM aligned",
)
def align_calendar(spark, folder):
    return calendar.align_calendar(part_panel(spark, folder), MONTHLY)


@query(
    "gap_runs",
    "series_id:str periods_present:int periods_expected:int gap_count:int longest_gap:int range_start:date range_end:date",
    f"""WITH {aligned_sql(supplier_panel_sql(WEEKLY), WEEKLY)},
      islands AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t)
          - row_number() OVER (PARTITION BY series_id, y IS NULL ORDER BY t) AS island FROM aligned),
      runs AS (SELECT series_id, island, COUNT(*) AS length FROM islands WHERE y IS NULL GROUP BY ALL)
      SELECT series_id, COUNT(y) AS periods_present, COUNT(*) AS periods_expected, COUNT(*) - COUNT(y) AS gap_count,
        COALESCE((SELECT MAX(length) FROM runs WHERE runs.series_id = aligned.series_id), 0) AS longest_gap,
        MIN(ds) AS range_start, MAX(ds) AS range_end FROM aligned GROUP BY series_id""",
)
def gap_runs(spark, folder):
    return calendar.gap_runs(supplier_panel(spark, folder, WEEKLY), WEEKLY)


def _stepped_sql() -> str:
    parts = [
        f"SELECT '{f} ' || o_orderpriority AS series_id, {trunc_sql('o_orderdate', f)} AS ds FROM orders"
        for f in (DAILY, WEEKLY, MONTHLY, QUARTERLY)
    ]
    parts.append("SELECT 'part ' || l_partkey AS series_id, CAST(l_shipdate AS DATE) AS ds FROM lineitem")
    return " UNION ALL ".join(parts)


@query(
    "infer_frequency_timestamps",
    "series_id:str periods:int typical_gap:int frequency:str",
    f"""WITH days AS (SELECT DISTINCT event_type AS series_id, CAST(ts AS DATE) AS ds FROM events),
      gaps AS (SELECT series_id, ds, date_diff('day', lag(ds) OVER (PARTITION BY series_id ORDER BY ds), ds) AS gap FROM days),
      stats AS (SELECT series_id, COUNT(*) AS c, GREATEST(date_diff('day', MIN(ds), MAX(ds)), 1) AS span,
          list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS g FROM gaps GROUP BY series_id),
      rated AS (SELECT *, len(g) AS m, g[len(g) // 2 + 1] AS mid,
          c >= 0.3 * GREATEST(1, round_even(span / 1.0, 0) + 1) AS fd,
          c >= 0.3 * GREATEST(1, round_even(span / 7.0, 0) + 1) AS fw,
          c >= 0.3 * GREATEST(1, round_even(span / 30.44, 0) + 1) AS fm,
          c >= 0.3 * GREATEST(1, round_even(span / 91.31, 0) + 1) AS fq FROM stats)
      SELECT series_id, c AS periods, mid AS typical_gap, CASE WHEN c < 3 THEN NULL
        WHEN mid = 1 AND len(list_filter(g, lambda x: x = 1)) >= 0.5 * m AND fd THEN 'daily'
        WHEN mid BETWEEN 6 AND 8 AND len(list_filter(g, lambda x: x BETWEEN 6 AND 8)) >= 0.5 * m AND fw THEN 'weekly'
        WHEN mid BETWEEN 27 AND 32 AND len(list_filter(g, lambda x: x BETWEEN 27 AND 32)) >= 0.5 * m AND fm THEN 'monthly'
        WHEN mid BETWEEN 88 AND 93 AND len(list_filter(g, lambda x: x BETWEEN 88 AND 93)) >= 0.5 * m AND fq THEN 'quarterly'
        WHEN fq THEN 'quarterly' WHEN fm THEN 'monthly' WHEN fw THEN 'weekly' WHEN fd THEN 'daily' END AS frequency
      FROM rated""",
)
def infer_frequency_timestamps(spark, folder):
    """Moments count by their day: many readings a day are one step of a day."""
    events = table(spark, folder, "events").select(F.col("event_type").alias("series_id"), F.col("ts").alias("ds"))
    return calendar.infer_frequency(events)


@query(
    "infer_frequency",
    "series_id:str periods:int typical_gap:int frequency:str",
    f"""WITH days AS (SELECT DISTINCT series_id, ds FROM ({_stepped_sql()})),
      gaps AS (SELECT series_id, ds, date_diff('day', lag(ds) OVER (PARTITION BY series_id ORDER BY ds), ds) AS gap FROM days),
      stats AS (SELECT series_id, COUNT(*) AS c, GREATEST(date_diff('day', MIN(ds), MAX(ds)), 1) AS span,
          list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS g FROM gaps GROUP BY series_id),
      rated AS (SELECT *, len(g) AS m, g[len(g) // 2 + 1] AS mid,
          c >= 0.3 * GREATEST(1, round_even(span / 1.0, 0) + 1) AS fd,
          c >= 0.3 * GREATEST(1, round_even(span / 7.0, 0) + 1) AS fw,
          c >= 0.3 * GREATEST(1, round_even(span / 30.44, 0) + 1) AS fm,
          c >= 0.3 * GREATEST(1, round_even(span / 91.31, 0) + 1) AS fq FROM stats)
      SELECT series_id, c AS periods, mid AS typical_gap, CASE WHEN c < 3 THEN NULL
        WHEN mid = 1 AND len(list_filter(g, lambda x: x = 1)) >= 0.5 * m AND fd THEN 'daily'
        WHEN mid BETWEEN 6 AND 8 AND len(list_filter(g, lambda x: x BETWEEN 6 AND 8)) >= 0.5 * m AND fw THEN 'weekly'
        WHEN mid BETWEEN 27 AND 32 AND len(list_filter(g, lambda x: x BETWEEN 27 AND 32)) >= 0.5 * m AND fm THEN 'monthly'
        WHEN mid BETWEEN 88 AND 93 AND len(list_filter(g, lambda x: x BETWEEN 88 AND 93)) >= 0.5 * m AND fq THEN 'quarterly'
        WHEN fq THEN 'quarterly' WHEN fm THEN 'monthly' WHEN fw THEN 'weekly' WHEN fd THEN 'daily' END AS frequency
      FROM rated""",
)
def infer_frequency(spark, folder):
    from tidemark.functions.dates import period_start

    orders = table(spark, folder, "orders").select("o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))
    stepped = orders.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.concat(F.lit(f + " "), "o_orderpriority").alias("series_id"),
                        period_start(F.col("day"), f).alias("ds"),
                    )
                    for f in (DAILY, WEEKLY, MONTHLY, QUARTERLY)
                ]
            )
        ).alias("s")
    ).select("s.*")
    parts = table(spark, folder, "lineitem").select(
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("series_id"),
        F.col("l_shipdate").cast("date").alias("ds"),
    )
    return calendar.infer_frequency(stepped.unionByName(parts))


_VALIDATE = """stats AS (
      SELECT series_id, COUNT(*) AS n, COUNT(y) AS finite, COUNT(DISTINCT ds) AS periods, MIN(ds) AS start_ds,
        MAX(ds) AS end_ds, COUNT(*) FILTER (WHERE abs(y) <= 1e-8) AS zeros, COUNT(*) FILTER (WHERE y < 0) AS negatives,
        MAX(y) - MIN(y) AS spread, quantile_cont(y, 0.5) AS mid,
        MIN(pos) FILTER (WHERE y IS NOT NULL) AS first_known, MAX(pos) FILTER (WHERE y IS NOT NULL) AS last_known,
        date_diff('month', MIN(ds), MAX(ds)) + 1 AS expected
      FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS pos FROM panel) GROUP BY series_id),
    mads AS (SELECT p.series_id, quantile_cont(abs(p.y - s.mid), 0.5) AS mad FROM panel p JOIN stats s USING (series_id)
      GROUP BY p.series_id),
    outs AS (SELECT p.series_id, COUNT(*) FILTER (WHERE m.mad > 0 AND abs(p.y - s.mid) > 1.4826 * m.mad * 3.5) AS far
      FROM panel p JOIN stats s USING (series_id) JOIN mads m USING (series_id) GROUP BY p.series_id),
    checked AS (
      SELECT s.*, CASE WHEN finite >= 5 THEN far ELSE 0 END AS far, zeros / NULLIF(finite, 0) AS share,
        n >= 2 AND finite > 0 AS live FROM stats s JOIN outs USING (series_id)),
    report AS (
      SELECT *, list_filter([
        CASE WHEN n > periods THEN 'duplicate_timestamps:' || (n - periods) END,
        CASE WHEN n < 2 THEN 'no_history:' || n END,
        CASE WHEN n >= 2 AND finite = 0 THEN 'all_null:' || n END,
        CASE WHEN live AND n < 8 THEN 'short_history:' || n END,
        CASE WHEN live AND share >= 1 THEN 'all_zero:' || finite END,
        CASE WHEN live AND share >= 0.3 AND share < 1 THEN 'intermittent_demand:' || zeros END,
        CASE WHEN live AND share < 0.3 AND spread = 0 THEN 'constant_target:' || finite END,
        CASE WHEN live AND negatives > 0 THEN 'negative_values:' || negatives END,
        CASE WHEN live AND expected > periods THEN 'calendar_gaps:' || (expected - periods) END,
        CASE WHEN live AND first_known > 0 THEN 'leading_nulls:' || first_known END,
        CASE WHEN live AND n - 1 - last_known > 0 THEN 'trailing_nulls:' || (n - 1 - last_known) END,
        CASE WHEN live AND far > 0 THEN 'outliers:' || far END], lambda x: x IS NOT NULL) AS codes,
        CASE WHEN n > periods OR n < 2 OR finite = 0 THEN 'reject' END AS rejected FROM checked),
    judged AS (
      SELECT *, COALESCE(rejected, CASE WHEN len(codes) > 0 THEN 'warn' ELSE 'ok' END) AS status,
        CASE WHEN rejected IS NOT NULL THEN 'none' WHEN n < 8 OR share >= 0.3 THEN 'fallback' ELSE 'model' END AS route
      FROM report)"""

# Every fifth quantity stands for an empty reading and every third for a zero,
# so that all findings occur.
_HOLED = f"""SELECT series_id, ds, CASE WHEN y % 5 = 0 THEN NULL WHEN y % 3 = 0 THEN 0 ELSE y - 4 END AS y
  FROM ({part_panel_sql()})"""


def _holed_panel(spark, folder):
    y = F.col("y")
    return part_panel(spark, folder).withColumn(
        "y", F.when(y % 5 == 0, F.lit(None)).when(y % 3 == 0, F.lit(0.0)).otherwise(y - 4)
    )


@query(
    "validate_panel",
    "series_id:str status:str route:str observations:int start:date end:date codes:str",
    f"""WITH panel AS ({_HOLED}), {_VALIDATE}
      SELECT series_id, status, route, n AS observations, start_ds AS start, end_ds AS "end",
        array_to_string(codes, ',') AS codes FROM judged""",
)
def validate_panel(spark, folder):
    report = validation.validate_panel(_holed_panel(spark, folder), MONTHLY)
    return report.withColumn("codes", validation.codes_text(F.col("findings")))


@query(
    "status_counts",
    "status:str series:int",
    f"WITH panel AS ({_HOLED}), {_VALIDATE} SELECT status, COUNT(*) AS series FROM judged GROUP BY status",
)
def status_counts(spark, folder):
    return validation.status_counts(validation.validate_panel(_holed_panel(spark, folder), MONTHLY))


@query(
    "reason_counts",
    "code:str series:int",
    f"""WITH panel AS ({_HOLED}), {_VALIDATE} SELECT code, COUNT(*) AS series
      FROM (SELECT split_part(unnest(codes), ':', 1) AS code FROM judged) GROUP BY code""",
)
def reason_counts(spark, folder):
    return validation.reason_counts(validation.validate_panel(_holed_panel(spark, folder), MONTHLY))


@query(
    "history_lengths",
    "from_periods:int series:int below_required:int",
    f"""WITH panel AS ({_HOLED}), {_VALIDATE} SELECT n // 6 * 6 AS from_periods, COUNT(*) AS series,
      COUNT(*) FILTER (WHERE n < 8) AS below_required FROM judged GROUP BY 1""",
)
def history_lengths(spark, folder):
    return validation.history_lengths(validation.validate_panel(_holed_panel(spark, folder), MONTHLY), MONTHLY)


_WEEK_CELLS = f"""SELECT CAST(l_suppkey AS VARCHAR) AS series_id, {trunc_sql('l_shipdate', WEEKLY)} AS ds,
    SUM(l_quantity) AS y, COUNT(*) AS row_count FROM lineitem GROUP BY ALL"""


@query(
    "quality_report",
    "series_id:str rows_usable:int periods_present:int periods_expected:int coverage:6 gap_count:int longest_gap:int "
    "duplicate_rows:int partial_periods:int outlier_periods:int negative_periods:int zero_periods:int "
    "constant_target:bool range_start:date range_end:date fill_applied:str codes:str blocked:bool",
    f"""WITH cells AS ({_WEEK_CELLS}),
      steps AS (SELECT *, y - lag(y) OVER w AS step, date_diff('day', lag(ds) OVER w, ds) // 7 - 1 AS missing,
          first_value(y) OVER w AS y0, quantile_cont(row_count, 0.5) OVER (PARTITION BY series_id) AS typical
        FROM cells WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
      mids AS (SELECT series_id, quantile_cont(step, 0.5) AS mid FROM steps GROUP BY series_id),
      offs AS (SELECT s.*, abs(step - mid) AS off FROM steps s JOIN mids USING (series_id)),
      scales AS (SELECT series_id, CASE WHEN quantile_cont(off, 0.5) > 0 THEN 1.4826 * quantile_cont(off, 0.5)
          ELSE AVG(off) END AS scale FROM offs GROUP BY series_id),
      stats AS (SELECT series_id, SUM(row_count) AS rows_usable, COUNT(*) AS periods_present,
          date_diff('day', MIN(ds), MAX(ds)) // 7 + 1 AS periods_expected, COALESCE(SUM(missing), 0) AS gap_count,
          COALESCE(MAX(missing), 0) AS longest_gap,
          COUNT(*) FILTER (WHERE typical > 0 AND row_count < typical * 0.35) AS partial_periods,
          CASE WHEN COUNT(*) >= 5 THEN COUNT(*) FILTER (WHERE scale > 0 AND off / scale > 3.5) ELSE 0 END AS outlier_periods,
          COUNT(*) FILTER (WHERE y < 0) AS negative_periods, COUNT(*) FILTER (WHERE abs(y) <= 1e-8) AS zero_periods,
          COUNT(*) >= 2 AND bool_and(abs(y - y0) <= 1e-8 + 1e-5 * abs(y0)) AS constant_target,
          MIN(ds) AS range_start, MAX(ds) AS range_end FROM offs JOIN scales USING (series_id) GROUP BY series_id),
      more AS (SELECT *, periods_present / periods_expected AS coverage, rows_usable - periods_present AS duplicate_rows,
          CASE WHEN gap_count = 0 THEN 'none' WHEN zero_periods / periods_present >= 0.3 THEN 'zero'
            ELSE 'interpolate' END AS fill_applied FROM stats)
      SELECT *, array_to_string(list_filter([
          CASE WHEN periods_present < 2 THEN 'too_few_periods:' || periods_present END,
          CASE WHEN constant_target THEN 'constant_target:0' END,
          CASE WHEN gap_count > 0 THEN 'calendar_gaps:' || CAST(gap_count AS BIGINT) END,
          CASE WHEN duplicate_rows > 0 THEN 'duplicate_timestamps:' || CAST(duplicate_rows AS BIGINT) END,
          CASE WHEN partial_periods > 0 THEN 'partial_periods:' || partial_periods END,
          CASE WHEN outlier_periods > 0 THEN 'outliers:' || outlier_periods END,
          CASE WHEN negative_periods > 0 THEN 'negative_values:' || negative_periods END], lambda x: x IS NOT NULL), ',') AS codes,
        periods_present < 2 OR (gap_count > 0 AND coverage < 0.6) AS blocked FROM more""",
)
def quality_report(spark, folder):
    cells = key_cells(spark, folder, "l_suppkey", WEEKLY, "l_quantity").select(
        F.col("l_suppkey").cast("string").alias("series_id"),
        F.col("period").alias("ds"),
        F.col("value").alias("y"),
        "row_count",
    )
    report = validation.quality_report(cells, WEEKLY)
    return report.withColumn("codes", validation.codes_text(F.col("issues")))


_GRID = f"""WITH panel AS MATERIALIZED ({_HOLED}), {_VALIDATE},
    span AS (SELECT MIN(ds) AS a, MAX(ds) AS b FROM panel),
    bounds AS (SELECT GREATEST(a, CAST(b - INTERVAL 59 MONTH AS DATE)) AS a, b FROM span),
    slots AS MATERIALIZED (SELECT series_id, y, ds, date_diff('month', (SELECT a FROM bounds), ds) AS slot FROM panel),
    width AS (SELECT date_diff('month', a, b) + 1 AS w FROM bounds),
    counted AS MATERIALIZED (
      SELECT series_id, COUNT(*) FILTER (WHERE slot >= 0 AND y IS NOT NULL) AS observations,
        COUNT(*) FILTER (WHERE slot >= 0 AND y = 0) AS zeros,
        MIN(CASE WHEN slot >= 0 AND y IS NOT NULL THEN slot END) AS first_slot FROM slots GROUP BY series_id),
    head AS MATERIALIZED (SELECT *, w - observations AS gaps FROM counted, width ORDER BY gaps DESC, series_id LIMIT 150),
    grid AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY COALESCE(first_slot, w), head.series_id) AS position, head.series_id,
        observations, gaps, zeros, status, route, first_slot, w,
        CAST((SELECT a FROM bounds) + to_months(CAST(first_slot AS INTEGER)) AS DATE) AS first_ds
      FROM head JOIN (SELECT series_id, status, route FROM judged) USING (series_id)),
    gridcells AS MATERIALIZED (
      SELECT g.series_id, i.slot, s.y AS value FROM grid g CROSS JOIN (SELECT unnest(range(CAST(w AS BIGINT))) AS slot FROM width) i
      LEFT JOIN slots s ON s.series_id = g.series_id AND s.slot = i.slot)"""


def _grid(spark, folder):
    panel = _holed_panel(spark, folder)
    return validation.coverage_grid(panel, validation.validate_panel(panel, MONTHLY), MONTHLY, max_periods=60)


@query(
    "coverage_grid",
    "position:int series_id:str observations:int gaps:int zeros:int status:str route:str first_ds:date total:2",
    f"""{_GRID} SELECT position, series_id, observations, gaps, zeros, status, route, first_ds,
      COALESCE(t.total, 0) AS total FROM grid g LEFT JOIN (SELECT series_id, SUM(value) AS total FROM gridcells GROUP BY 1) t USING (series_id)""",
)
def coverage_grid(spark, folder):
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return _grid(spark, folder).withColumn("total", total)


@query(
    "coverage_bands",
    "series_id:str slot:int value:2 band:int",
    f"""{_GRID}, sorted AS (SELECT list_sort(list(value) FILTER (WHERE value > 0)) AS v FROM gridcells),
      cuts AS (SELECT v[LEAST(len(v), len(v) // 4 + 1)] AS c1, v[LEAST(len(v), len(v) // 2 + 1)] AS c2,
        v[LEAST(len(v), 3 * len(v) // 4 + 1)] AS c3 FROM sorted)
      SELECT series_id, slot, value, CASE WHEN value IS NULL THEN 0 WHEN value = 0 THEN 1 WHEN value <= c1 THEN 2
        WHEN value <= c2 THEN 3 WHEN value <= c3 THEN 4 ELSE 5 END AS band FROM gridcells, cuts""",
)
def coverage_bands(spark, folder):
    return validation.coverage_bands(_grid(spark, folder))


@query(
    "canonical_panel",
    "series_id:str ds:date y:4 l_discount:6 l_tax:6",
    f"""SELECT COALESCE(NULLIF(l_returnflag, 'R'), '(none)') || ' · ' || l_suppkey AS series_id,
        {trunc_sql('l_shipdate', WEEKLY)} AS ds, last(l_extendedprice ORDER BY CAST(l_shipdate AS DATE), l_extendedprice) AS y,
        AVG(l_discount) AS l_discount, AVG(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2""",
)
def canonical_panel(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn(
        "flag", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))
    )
    panel = canonical.to_canonical(
        rows,
        "l_shipdate",
        "l_extendedprice",
        WEEKLY,
        series_keys=["flag", "l_suppkey"],
        covariates=["l_discount", "l_tax"],
        aggregation="last",
    )
    problems = canonical.contract_breaches(panel, ["l_discount", "l_tax"])
    if problems:
        raise ValueError(problems)
    return panel


@query(
    "duplicate_grain",
    "series_id:str ds:date rows:int",
    """SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS ds, COUNT(*) AS rows
      FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""",
)
def duplicate_grain(spark, folder):
    rows = table(spark, folder, "lineitem")
    return canonical.duplicate_grain(
        rows.select(F.col("l_suppkey").cast("string").alias("series_id"), F.col("l_shipdate").cast("date").alias("ds"))
    )


@query(
    "horizon_ceiling",
    "series_id:str ceiling:int clamped:int",
    f"""SELECT series_id, (date_diff('month', MIN(ds), MAX(ds)) + 1) // 2 AS ceiling,
        CASE WHEN (date_diff('month', MIN(ds), MAX(ds)) + 1) // 2 < 1
            OR (date_diff('month', MIN(ds), MAX(ds)) + 1) // 2 >= 36 THEN 36
          ELSE (date_diff('month', MIN(ds), MAX(ds)) + 1) // 2 END AS clamped FROM ({part_panel_sql()}) GROUP BY series_id""",
)
def horizon_ceiling(spark, folder):
    extent = part_panel(spark, folder).groupBy("series_id").agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    a, b = F.col("a"), F.col("b")
    return extent.select(
        "series_id",
        calendar.horizon_ceiling(a, b, MONTHLY).alias("ceiling"),
        calendar.clamped_horizon(36, a, b, MONTHLY).alias("clamped"),
    )

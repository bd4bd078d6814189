"""Queries for preparation, features, diagnostics, backtests, selection, bands."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.constants import COMPLEXITY_PENALTY, MONTHLY, PARAMETER_BUDGET, SEASON, SEASON_CANDIDATES, WEEKLY
from tidemark.operators import backtest, calendar, diagnostics, features, intervals, models, preparation, selection
from tidemark.plans.catalog import query
from tidemark.session import cut_lineage
from tidemark.plans.panels import aligned_sql, part_panel, part_panel_sql, supplier_panel, supplier_panel_sql

HORIZON = 6


def zeroed(aligned):
    """A period without sales counts as zero demand."""
    return aligned.withColumn("y", F.coalesce("y", F.lit(0.0)))


def supplier_series(spark, folder):
    return zeroed(calendar.align_calendar(supplier_panel(spark, folder, measure="l_quantity"), MONTHLY))


def part_series(spark, folder):
    return zeroed(calendar.align_calendar(part_panel(spark, folder), MONTHLY))


def aligned_arrays(panel):
    """The panel as one row per series, its shuffle spread over all tasks."""
    return calendar.align_arrays(diagnostics.spread_out(panel, ["series_id"]), MONTHLY)


def zeroed_arrays(panel):
    """`zeroed` of the aligned panel, one row per series."""
    full = F.transform("points", lambda p: p.withField("y", F.coalesce(p["y"], F.lit(0.0))))
    return aligned_arrays(panel).withColumn("points", full)


def _histories(series):
    """Zeroed arrays, which have no holes, as one row of ``values`` per series."""
    return series.select("series_id", F.col("points.y").alias("values"))


def supplier_arrays(spark, folder):
    return zeroed_arrays(supplier_panel(spark, folder, measure="l_quantity"))


def part_arrays(spark, folder):
    return zeroed_arrays(part_panel(spark, folder))


_SUPPLIERS = f"""{aligned_sql(supplier_panel_sql(measure='l_quantity'), MONTHLY)},
    s AS (SELECT series_id, t, n, ds, COALESCE(y, 0) AS y FROM aligned)"""
_PARTS = f"""{aligned_sql(part_panel_sql(), MONTHLY)},
    s AS (SELECT series_id, t, n, ds, COALESCE(y, 0) AS y FROM aligned)"""


# ---- Preparation and features ----------------------------------------------
_FILLED = f"""{aligned_sql(part_panel_sql(), MONTHLY)},
    zeros AS (SELECT series_id, AVG(CAST(abs(y) <= 1e-8 AS INTEGER)) AS share FROM aligned GROUP BY series_id),
    near AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER b AS lt,
        last_value(y IGNORE NULLS) OVER b AS ly, first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER a AS rt,
        first_value(y IGNORE NULLS) OVER a AS ry FROM aligned
      WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    filled AS (SELECT series_id, t, ds, CASE WHEN y IS NOT NULL THEN y WHEN lt IS NULL THEN ry WHEN rt IS NULL THEN ly
        ELSE ly + (ry - ly) / (rt - lt) * (t - lt) END AS y FROM near)"""


def _written_out(prepared):
    """series_id, ds, y: one row per period again."""
    return prepared.select("series_id", F.inline(F.arrays_zip(F.col("points.ds").alias("ds"), F.col("values").alias("y"))))


@query("fill_gaps", "series_id:str ds:date y:4", f"WITH {_FILLED} SELECT series_id, ds, y FROM filled")
def fill_gaps(spark, folder):
    return _written_out(preparation.prepare_arrays(aligned_arrays(part_panel(spark, folder)), "interpolate"))


@query(
    "winsorise",
    "series_id:str ds:date y:4",
    f"""WITH {_FILLED}, mid AS (SELECT series_id, quantile_cont(y, 0.5) AS m, COUNT(*) AS c FROM filled GROUP BY 1),
      dev AS (SELECT series_id, quantile_cont(abs(y - m), 0.5) AS d FROM filled JOIN mid USING (series_id) GROUP BY 1)
      SELECT series_id, ds, CASE WHEN c >= 5 AND d > 0 THEN GREATEST(LEAST(y, m + 1.4826 * d * 2), m - 1.4826 * d * 2)
        ELSE y END AS y FROM filled JOIN mid USING (series_id) JOIN dev USING (series_id)""",
)
def winsorise(spark, folder):
    return _written_out(preparation.prepare_arrays(aligned_arrays(part_panel(spark, folder)), "interpolate", 2.0))


@query(
    "history_features",
    "series_id:str ds:date lag_1:2 lag_12:2 roll_mean_3:4 roll_std_3:4 roll_delta_12:4 trend:0 seasonal_delta:2 "
    "week_of_year_sin:6 month_cos:6 quarter:0",
    f"""WITH {aligned_sql(supplier_panel_sql(WEEKLY, 'l_quantity'), WEEKLY)}
      SELECT * FROM (SELECT series_id, ds, y, lag(y, 1) OVER w AS lag_1, lag(y, 12) OVER w AS lag_12,
        CASE WHEN COUNT(y) OVER w3 = 3 THEN AVG(y) OVER w3 END AS roll_mean_3,
        CASE WHEN COUNT(y) OVER w3 = 3 THEN stddev_pop(y) OVER w3 END AS roll_std_3,
        CASE WHEN COUNT(y) OVER w12 = 12 THEN lag(y, 1) OVER w - AVG(y) OVER w12 END AS roll_delta_12,
        CAST(t AS DOUBLE) AS trend, lag(y, 13) OVER w - lag(y, 26) OVER w AS seasonal_delta,
        sin(2 * pi() * week(ds) / 52.0) AS week_of_year_sin, cos(2 * pi() * month(ds) / 12.0) AS month_cos,
        quarter(ds) AS quarter FROM aligned
        WINDOW w AS (PARTITION BY series_id ORDER BY ds),
          w3 AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
          w12 AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
      WHERE y IS NOT NULL AND lag_1 IS NOT NULL AND lag_12 IS NOT NULL AND roll_mean_3 IS NOT NULL
        AND roll_delta_12 IS NOT NULL AND seasonal_delta IS NOT NULL""",
)
def history_features(spark, folder):
    aligned = calendar.align_calendar(supplier_panel(spark, folder, WEEKLY, "l_quantity"), WEEKLY)
    matrix, _ = features.design_matrix(aligned, WEEKLY, [1, 12], [3, 12], seasonal_delta=13)
    return matrix


# ---- Diagnostics -----------------------------------------------------------
def _decompose_sql(period: int, source: str = "s", tag: str = "") -> str:
    half = period // 2
    if period % 2:
        mean = f"AVG(y) OVER f{tag}"
    else:
        mean = f"(SUM(y) OVER f{tag} - (lag(y, {half}) OVER o{tag} + lead(y, {half}) OVER o{tag}) / 2) / {period}"
    return f"""tr{tag} AS (SELECT *, CASE WHEN COUNT(y) OVER f{tag} = {2 * half + 1} THEN {mean} END AS trend
        FROM {source} WHERE n >= {2 * period}
        WINDOW o{tag} AS (PARTITION BY series_id ORDER BY t),
          f{tag} AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)),
      ph{tag} AS (SELECT series_id, t % {period} AS phase, AVG(y - trend) AS m FROM tr{tag} GROUP BY ALL),
      ce{tag} AS (SELECT series_id, AVG(m) AS c FROM ph{tag} GROUP BY series_id),
      dec{tag} AS (SELECT tr{tag}.*, y - trend AS detrended, m - c AS seasonal, y - trend - (m - c) AS remainder
        FROM tr{tag} JOIN ph{tag} ON tr{tag}.series_id = ph{tag}.series_id AND tr{tag}.t % {period} = ph{tag}.phase
        JOIN ce{tag} ON tr{tag}.series_id = ce{tag}.series_id)"""


@query(
    "decompose",
    "series_id:str t:int trend:4 seasonal:4 remainder:4",
    f"WITH {_SUPPLIERS}, {_decompose_sql(12)} SELECT series_id, t, trend, seasonal, remainder FROM dec",
)
def decompose(spark, folder):
    return diagnostics.decompose(diagnostics.compacted(supplier_series(spark, folder)), 12)


def _evidence_sql() -> str:
    parts, ctes = [], []
    for p in SEASON_CANDIDATES[MONTHLY]:
        tag = str(p)
        ctes.append(f"src{p} AS (SELECT * FROM s WHERE n >= {2 * p + 1}), {_decompose_sql(p, f'src{p}', tag)}")
        ctes.append(
            f"""cc{p} AS (SELECT series_id, t, detrended - AVG(detrended) OVER (PARTITION BY series_id) AS c FROM dec{p} WHERE detrended IS NOT NULL),
            pp{p} AS (SELECT series_id, c, lag(c, {p}) OVER (PARTITION BY series_id ORDER BY t) AS l FROM cc{p}),
            ac{p} AS (SELECT series_id, COUNT(*) AS m, SUM(c * l) AS x, SUM(c * c) AS q FROM pp{p} GROUP BY 1),
            st{p} AS (SELECT series_id, COUNT(remainder) AS m, var_samp(remainder) AS vr, var_samp(CASE WHEN remainder IS NOT NULL THEN seasonal + remainder END) AS vt
              FROM dec{p} GROUP BY 1)"""
        )
        acf = f"CASE WHEN a.m > {p + 2} AND q > 0 THEN x / q ELSE 0 END"
        parts.append(
            f"""SELECT series_id, {p} AS period, CASE WHEN b.m >= 3 AND vt > 0 THEN GREATEST(0, LEAST(1, 1 - vr / vt)) ELSE 0 END AS strength,
            {acf} AS acf, a.m > {p + 2} AND {acf} >= 1.959963984540054 / sqrt(a.m) AS repeats FROM ac{p} a JOIN st{p} b USING (series_id)"""
        )
    return f"WITH {_SUPPLIERS}, {', '.join(ctes)} {' UNION ALL '.join(parts)}"


@query("seasonal_evidence", "series_id:str period:int strength:5 acf:5 repeats:bool", _evidence_sql())
def seasonal_evidence(spark, folder):
    return diagnostics.seasonal_evidence_of(_histories(supplier_arrays(spark, folder)), MONTHLY)


@query("seasonal_profile", "series_id:str period:int seasonal_strength:4 seasonal_floor:4 trend_strength:4 trend_floor:4 has_season:bool has_trend:bool")
def seasonal_profile(spark, folder):
    return diagnostics.seasonal_profile(diagnostics.compacted(supplier_series(spark, folder)), MONTHLY)


_PATTERN = """stats AS (SELECT series_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE y > 0) AS hits, AVG(y) FILTER (WHERE y > 0) AS m,
      stddev_samp(y) FILTER (WHERE y > 0) AS sd, AVG(CAST(abs(y) <= 1e-8 AS INTEGER)) AS zero_share, bool_and(y > 0) AS positive,
      COALESCE(abs(stddev_samp(y) / NULLIF(AVG(y), 0)), 0) AS variation FROM s GROUP BY series_id),
    rated AS (SELECT *, CASE WHEN hits >= 2 THEN n / hits END AS "interval", CASE WHEN hits >= 2 THEN (sd / m) ** 2 ELSE 0 END AS cv2 FROM stats),
    classed AS (SELECT *, CASE WHEN "interval" IS NULL THEN 'no_demand' WHEN "interval" >= 1.32 AND cv2 >= 0.49 THEN 'lumpy'
      WHEN "interval" >= 1.32 THEN 'intermittent' WHEN cv2 >= 0.49 THEN 'erratic' ELSE 'smooth' END AS demand_class FROM rated)"""


@query(
    "demand_pattern",
    "series_id:str n:int interval:5 cv2:5 demand_class:str zero_share:5 positive:bool variation:5 allowed:str "
    "point_meaningful:bool widen:bool",
    f"""WITH {_PARTS}, {_PATTERN} SELECT *, CASE WHEN demand_class IN ('lumpy', 'intermittent') THEN 'croston,naive,seasonal_naive'
        WHEN demand_class = 'no_demand' THEN 'naive,seasonal_naive'
        ELSE 'ets,gradient_boosting,holt_winters,naive,prophet,sarimax,seasonal_naive,theta' END AS allowed,
        demand_class NOT IN ('lumpy', 'no_demand') AS point_meaningful, demand_class <> 'smooth' AS widen FROM classed""",
)
def demand_pattern(spark, folder):
    pattern = diagnostics.demand_pattern(diagnostics.compacted(part_series(spark, folder)))
    return diagnostics.routing(pattern).withColumn("allowed", F.array_join("allowed", ","))


def _box_cox_sql() -> str:
    grid = (0.0, 0.25, 0.5, 0.75, 1.0)
    cols = ", ".join(
        f"CASE WHEN AVG(sd / m ** {1 - g}) > 0 THEN stddev_samp(sd / m ** {1 - g}) / AVG(sd / m ** {1 - g}) END AS r{i}"
        for i, g in enumerate(grid)
    )
    union = " UNION ALL ".join(f"SELECT series_id, r{i} AS d, {i} AS i, {g} AS p FROM ratios" for i, g in enumerate(grid))
    return f"""WITH {_SUPPLIERS}, blocks AS (SELECT series_id, t // 12 AS b, COUNT(*) AS c, AVG(y) AS m, stddev_samp(y) AS sd, MIN(y) AS low FROM s GROUP BY ALL),
      usable AS (SELECT * FROM blocks WHERE c >= 2 AND m > 0), ratios AS (SELECT series_id, {cols} FROM usable GROUP BY series_id),
      sized AS (SELECT series_id, SUM(c) AS n, MIN(low) AS low, COUNT(*) FILTER (WHERE c >= 2 AND m > 0) AS k FROM blocks GROUP BY 1),
      best AS (SELECT series_id, arg_min(p, (d, i)) AS p FROM ({union}) WHERE d IS NOT NULL GROUP BY 1),
      hints AS (SELECT series_id, low, CASE WHEN n >= 8 AND low > 0 AND k >= 2 THEN COALESCE(p, 1.0) ELSE 1.0 END AS box_cox
        FROM sized LEFT JOIN best USING (series_id))
      SELECT series_id, box_cox, CASE WHEN low > 0 AND box_cox <= 0.3 THEN 'log' ELSE 'none' END AS transform FROM hints"""


@query("box_cox_hint", "series_id:str box_cox:2 transform:str", _box_cox_sql())
def box_cox_hint(spark, folder):
    return diagnostics.box_cox_hint(diagnostics.compacted(supplier_series(spark, folder)), F.lit(12))


@query(
    "stationarity",
    "series_id:str d:int kpss:5 stationary:bool",
    f"""WITH {_SUPPLIERS}, lv AS (
        SELECT series_id, 0 AS d, t, y AS v FROM s
        UNION ALL SELECT * FROM (SELECT series_id, 1, t, y - lag(y) OVER w FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)) WHERE t >= 1
        UNION ALL SELECT * FROM (SELECT series_id, 2, t, y - 2 * lag(y) OVER w + lag(y, 2) OVER w FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)) WHERE t >= 2),
      r AS (SELECT *, v - AVG(v) OVER (PARTITION BY series_id, d) AS e, COUNT(*) OVER (PARTITION BY series_id, d) AS n FROM lv),
      base AS (SELECT series_id, d, n, SUM(e * e) AS own, floor(n ** (2.0 / 9)) AS reach FROM r GROUP BY ALL),
      x AS (SELECT a.series_id, a.d, a.t - b.t AS i, SUM(a.e * b.e) AS c FROM r a JOIN r b ON a.series_id = b.series_id AND a.d = b.d
        AND a.t > b.t GROUP BY ALL),
      auto AS (SELECT series_id, d, n, own, own / n + SUM(CASE WHEN i <= reach THEN c / (n / 2) ELSE 0 END) AS s0,
          SUM(CASE WHEN i <= reach THEN i * c / (n / 2) ELSE 0 END) AS s1 FROM base JOIN x USING (series_id, d) GROUP BY series_id, d, n, own, reach),
      lags AS (SELECT *, LEAST(floor(1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3) * n ** (1.0 / 3)), n - 1) AS l FROM auto),
      lr AS (SELECT series_id, d, n, own, (own + 2 * SUM(CASE WHEN i <= l THEN c * (1 - i / (l + 1)) ELSE 0 END)) / n AS v
        FROM lags JOIN x USING (series_id, d) GROUP BY series_id, d, n, own, l),
      cs AS (SELECT series_id, d, SUM(e) OVER (PARTITION BY series_id, d ORDER BY t) AS c FROM r),
      eta AS (SELECT series_id, d, SUM(c * c) AS q FROM cs GROUP BY ALL)
      SELECT series_id, d, q / n ** 2 / v AS kpss, q / n ** 2 / v < 0.463 AS stationary FROM lr JOIN eta USING (series_id, d)""",
)
def stationarity(spark, folder):
    arrays = diagnostics.history_arrays(diagnostics.compacted(supplier_series(spark, folder)))
    lag = "zip_with(slice(v, 2, size(v) - 1), slice(v, 1, size(v) - 1), (a, b) -> a - b)"
    once = arrays.select("series_id", F.col("values").alias("v")).withColumn("v1", F.expr(lag))
    twice = once.select("series_id", "v", "v1", F.expr(lag.replace("(v,", "(v1,").replace("size(v)", "size(v1)")).alias("v2"))
    levels = twice.select("series_id", F.posexplode(F.array("v", "v1", "v2")).alias("d", "v"))
    return diagnostics.level_stationary(levels, "v")


@query(
    "changepoints",
    "series_id:str index:int strength:4 recent:bool",
    f"""WITH {_PARTS.replace("s AS (SELECT", "s0 AS (SELECT")}, s AS (SELECT series_id, t, n,
          y + CASE WHEN CAST(series_id AS BIGINT) % 3 = 0 AND t >= n // 2 THEN 40 ELSE 0 END AS y FROM s0),
      sums AS (SELECT series_id, t, n, GREATEST(4, n // 6) AS w, SUM(y) OVER b AS ls, SUM(y * y) OVER b AS lq,
          SUM(y) OVER (PARTITION BY series_id) AS ts, SUM(y * y) OVER (PARTITION BY series_id) AS tq FROM s WHERE n >= 16
        WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      halves AS (SELECT *, ls / t AS lm, (ts - ls) / (n - t) AS rm FROM sums WHERE t BETWEEN w AND n - w AND n - w > w),
      rated AS (SELECT *, sqrt((GREATEST(lq / t - lm * lm, 0) * t + GREATEST((tq - lq) / (n - t) - rm * rm, 0) * (n - t)) / n) AS within FROM halves),
      found AS (SELECT series_id, t, n, w, abs(lm - rm) / within AS strength FROM rated WHERE within > 0 AND abs(lm - rm) / within > 2.2),
      marked AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY series_id ORDER BY t) < w THEN 0 ELSE 1 END AS o FROM found),
      clustered AS (SELECT *, SUM(o) OVER (PARTITION BY series_id ORDER BY t) AS c FROM marked)
      SELECT series_id, arg_max(t, (strength, -t)) AS "index", MAX(strength) AS strength,
        arg_max(t, (strength, -t)) >= MAX(n) * 0.75 AS recent FROM clustered GROUP BY series_id, c""",
)
def changepoints(spark, folder):
    # A third of the parts are given a step of 40 units halfway.
    series = part_arrays(spark, folder)
    every_third = F.col("series_id").cast("bigint") % 3 == 0
    stepped = F.transform("points.y", lambda y, t: y + F.when(every_third & (t >= F.floor(F.col("n") / 2)), 40.0).otherwise(0.0))
    return diagnostics.changepoints_of(series.select("series_id", stepped.alias("values")))


@query(
    "jump_share",
    "series_id:str outlier_share:6",
    f"""WITH {_PARTS}, st AS (SELECT series_id, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS d, n FROM s),
      mid AS (SELECT series_id, quantile_cont(d, 0.5) AS m FROM st GROUP BY 1),
      off AS (SELECT series_id, n, abs(d - m) AS o FROM st JOIN mid USING (series_id)),
      sc AS (SELECT series_id, CASE WHEN quantile_cont(o, 0.5) > 0 THEN 1.4826 * quantile_cont(o, 0.5) ELSE NULLIF(AVG(o), 0) END AS sc FROM off GROUP BY 1)
      SELECT series_id, CASE WHEN MAX(n) >= 5 THEN COALESCE(COUNT(*) FILTER (WHERE o / sc > 3.5) / NULLIF(COUNT(o), 0), 0) ELSE 0 END AS outlier_share
      FROM off JOIN sc USING (series_id) GROUP BY series_id""",
)
def jump_share(spark, folder):
    return diagnostics.jump_share_of(_histories(part_arrays(spark, folder)))


@query("series_profile", "series_id:str n:int period:int has_season:bool has_trend:bool demand_class:str box_cox:2 transform:str difference_order:int seasonal_difference_order:int outlier_share:4 minimum_history:int")
def series_profile(spark, folder):
    return diagnostics.profile_series(supplier_series(spark, folder), MONTHLY)


# ---- Backtests -------------------------------------------------------------
_PLAN = f"""p1 AS (SELECT series_id, MAX(n) AS n, CAST(LEAST({HORIZON}, GREATEST(1, MAX(n) // 4)) AS INTEGER) AS test FROM s GROUP BY 1),
    p2 AS (SELECT *, LEAST(GREATEST(LEAST(24, n - test), GREATEST(3, n // 2)), n - test) AS start FROM p1),
    plan AS (SELECT *, CASE WHEN start >= 3 THEN LEAST((n - start - test) // test + 1, 5) ELSE 0 END AS k,
      CASE WHEN n / 12.0 >= 8 THEN 'rolling' ELSE 'expanding' END AS scheme FROM p2)"""


def _backtest_sql(source: str) -> str:
    alphas = "(VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.15::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) AS al(a)"
    return f"""{source}, {_PLAN},
    folds AS (SELECT plan.*, f.fold, n - test * (k - f.fold) AS cut FROM plan, (SELECT unnest(range(5)) AS fold) f WHERE f.fold < k
      UNION ALL SELECT plan.*, 1000, n FROM plan),
    train AS (SELECT f.series_id, f.fold, f.cut, s.t, s.y FROM folds f JOIN s ON s.series_id = f.series_id AND s.t < f.cut
      AND (f.scheme = 'expanding' OR f.fold = 1000 OR s.t >= f.cut - f.start)),
    tests AS (SELECT f.series_id, f.fold, f.cut, f.k, s.t - f.cut + 1 AS step, s.ds, s.y AS y_true FROM folds f
      JOIN s ON s.series_id = f.series_id AND s.t >= f.cut AND s.t < f.cut + f.test),
    lasts AS (SELECT series_id, fold, arg_max(y, t) AS last FROM train GROUP BY ALL),
    hits AS (SELECT series_id, fold, y AS size, t - lag(t, 1, -1 + CAST(first_t AS BIGINT)) OVER (PARTITION BY series_id, fold ORDER BY t) AS gap,
        row_number() OVER (PARTITION BY series_id, fold ORDER BY t) AS j
      FROM (SELECT *, MIN(t) OVER (PARTITION BY series_id, fold) AS first_t FROM train) WHERE y > 0),
    ema AS (SELECT series_id, fold, a, j, size, gap,
        (1 - a) ** j * SUM(CASE WHEN j = 1 THEN size ELSE a * size END * (1 - a) ** (-j)) OVER w AS ls,
        (1 - a) ** j * SUM(CASE WHEN j = 1 THEN gap ELSE a * gap END * (1 - a) ** (-j)) OVER w AS lg
      FROM hits, {alphas} WINDOW w AS (PARTITION BY series_id, fold, a ORDER BY j)),
    err AS (SELECT *, (size / gap - lag(ls) OVER v / lag(lg) OVER v) ** 2 AS e FROM ema WINDOW v AS (PARTITION BY series_id, fold, a ORDER BY j)),
    fits AS (SELECT series_id, fold, a, COUNT(*) AS m, COALESCE(SUM(e), 0) AS miss, arg_max(ls, j) AS ls, arg_max(lg, j) AS lg FROM err GROUP BY ALL),
    croston AS (SELECT series_id, fold, arg_min(a, (round(miss, 8), a)) AS alpha, arg_min(ls / lg * (1 - a / 2), (round(miss, 8), a)) AS rate
      FROM fits WHERE m >= 2 GROUP BY ALL),
    preds AS (
      SELECT t.*, 'naive' AS model, last AS y_pred FROM tests t JOIN lasts USING (series_id, fold)
      UNION ALL SELECT t.*, 'seasonal_naive', b.y FROM tests t JOIN train b
        ON b.series_id = t.series_id AND b.fold = t.fold AND b.t = t.cut - 12 + (t.step - 1) % 12
      UNION ALL SELECT t.*, 'croston', rate FROM tests t JOIN croston USING (series_id, fold)),
    tmoves AS (SELECT series_id, fold, y, abs(y - lag(y) OVER (PARTITION BY series_id, fold ORDER BY t)) AS mv FROM train),
    tmid AS (SELECT series_id, fold, quantile_cont(mv, 0.5) AS mid, MAX(abs(y)) AS lvl, stddev_samp(y) AS sd FROM tmoves GROUP BY ALL),
    tmad AS (SELECT series_id, fold, quantile_cont(abs(mv - mid), 0.5) * 1.4826 AS spread FROM tmoves JOIN tmid USING (series_id, fold) GROUP BY ALL),
    ceil AS (SELECT series_id, fold, GREATEST(lvl + 12 * GREATEST(mid + 12 * spread, sd), lvl * 2, 1) AS top FROM tmid JOIN tmad USING (series_id, fold)),
    sound AS (SELECT series_id, fold, model FROM preds JOIN ceil USING (series_id, fold) GROUP BY ALL HAVING MAX(abs(y_pred)) <= MAX(top)),
    bt AS (SELECT p.series_id, model, fold, k AS n_folds, step, ds, y_true, y_pred, 1.0 AS w FROM preds p JOIN sound USING (series_id, fold, model)),
    first_train AS (SELECT series_id, s.t, s.y FROM s JOIN plan USING (series_id) WHERE k > 0 AND s.t < plan.n - test * k),
    moves AS (SELECT series_id, y - lag(y, 12) OVER (PARTITION BY series_id ORDER BY t) AS d12, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS d1 FROM first_train),
    scales AS (SELECT series_id, COALESCE(AVG(abs(d12)), AVG(abs(d1))) AS scale FROM moves GROUP BY series_id),
    z AS (SELECT {NormalDist().inv_cdf(0.9)!r}::DOUBLE AS z),
    sums AS (SELECT *, COUNT(*) OVER m - COUNT(*) OVER f AS rn, SUM(r) OVER m - SUM(r) OVER f AS rs, SUM(r * r) OVER m - SUM(r * r) OVER f AS rq
      FROM (SELECT *, y_true - y_pred AS r FROM bt) WINDOW m AS (PARTITION BY series_id, model), f AS (PARTITION BY series_id, model, fold)),
    sigmas AS (SELECT *, CASE WHEN rn >= 2 AND rq / rn - (rs / rn) ** 2 > 1e-12 * rq / rn THEN sqrt(rq / rn - (rs / rn) ** 2) END * z AS reach FROM sums, z),
    fcost AS (SELECT series_id, model, fold, AVG(2 * reach + CASE WHEN y_true < y_pred - reach THEN 2 / (1.0 - 0.8) * (y_pred - reach - y_true)
        WHEN y_true > y_pred + reach THEN 2 / (1.0 - 0.8) * (y_true - y_pred - reach) ELSE 0 END) AS c FROM sigmas GROUP BY ALL),
    cost AS (SELECT series_id, model, CASE WHEN COUNT(*) >= 2 THEN AVG(c) END AS winkler FROM fcost GROUP BY ALL),
    scores AS (SELECT series_id, model, AVG(abs(y_true - y_pred)) AS mae, sqrt(AVG((y_true - y_pred) ** 2)) AS rmse,
        AVG(CASE WHEN abs(y_true) + abs(y_pred) = 0 THEN 0 ELSE abs(y_true - y_pred) / ((abs(y_true) + abs(y_pred)) / 2) END) * 100 AS smape,
        SUM(abs(y_true - y_pred)) / NULLIF(SUM(abs(y_true)), 0) * 100 AS wmape, AVG(y_pred - y_true) AS bias,
        SUM(y_pred - y_true) / NULLIF(SUM(abs(y_true)), 0) * 100 AS relative_bias,
        AVG(abs(y_true - y_pred)) / NULLIF(MAX(scale), 0) AS mase, COUNT(DISTINCT fold) AS folds, MAX(n_folds) AS n_folds, MAX(winkler) AS winkler
      FROM bt LEFT JOIN scales USING (series_id) LEFT JOIN cost USING (series_id, model) GROUP BY series_id, model)"""


def windows_of(series, frequency=MONTHLY, horizon=HORIZON):
    """Windows of aligned series, one row each (`calendar.align_arrays`)."""
    return backtest.fold_windows(backtest.plan_rows(series, horizon, frequency), season=SEASON[frequency])


def simple_paths(windows):
    """Windows with Croston fitted, and the paths of the JVM-side models."""
    fitted = windows if "croston" in windows.columns else models.add_croston(windows)
    steps = F.greatest(F.col("test_horizon"), F.lit(HORIZON))
    train = F.col("train")
    return fitted, {
        "naive": models.naive(train, steps),
        "seasonal_naive": models.seasonal_naive(train, steps, F.lit(12)),
        "croston": models.flat(F.col("croston.rate"), steps),
    }


ROSTER = ("naive", "seasonal_naive", "croston")


def backtested(series):
    """Backtest rows and fitted windows, each written once: scores, costs,
    residuals and the final forecasts all read them."""
    fitted, _ = simple_paths(windows_of(series))
    fitted = cut_lineage(fitted, "windows")
    _, paths = simple_paths(fitted)
    return cut_lineage(backtest.backtest_rows(fitted, paths), "backtest"), fitted


@query(
    "fold_plan",
    "series_id:str fold:int cut:int n_folds:int test_horizon:int initial_train:int scheme:str train_rows:int test_rows:int",
    f"""WITH {_PARTS}, {_PLAN},
      folds AS (SELECT plan.*, f.fold, n - test * (k - f.fold) AS cut FROM plan, (SELECT unnest(range(5)) AS fold) f WHERE f.fold < k)
      SELECT series_id, fold, cut, k AS n_folds, test AS test_horizon, start AS initial_train, scheme,
        CASE WHEN scheme = 'rolling' THEN LEAST(cut, start) ELSE cut END AS train_rows, LEAST(test, n - cut) AS test_rows FROM folds""",
)
def fold_plan(spark, folder):
    planned = backtest.plan_rows(part_series(spark, folder), HORIZON, MONTHLY)
    rows = backtest.fold_rows(planned, extra_windows=False)
    return rows.groupBy("series_id", "fold", "cut", "n_folds", "test_horizon", "initial_train", "scheme").agg(
        F.count_if(F.col("role") == "train").alias("train_rows"), F.count_if(F.col("role") == "test").alias("test_rows")
    )


@query(
    "prepared_windows",
    "series_id:str fold:int cut:int values:int total:3 highest:3",
    f"""WITH {aligned_sql(part_panel_sql(), MONTHLY)}, s AS (SELECT * FROM aligned), {_PLAN},
      folds AS (SELECT plan.*, f.fold, n - test * (k - f.fold) AS cut FROM plan, (SELECT unnest(range(5)) AS fold) f WHERE f.fold < k),
      rows AS (SELECT f.series_id, f.fold, f.cut, s.t, s.y FROM folds f JOIN s ON s.series_id = f.series_id AND s.t < f.cut),
      near AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER b AS lt, last_value(y IGNORE NULLS) OVER b AS ly,
          first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER a AS rt, first_value(y IGNORE NULLS) OVER a AS ry FROM rows
        WINDOW b AS (PARTITION BY series_id, fold ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          a AS (PARTITION BY series_id, fold ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
      filled AS (SELECT series_id, fold, cut, CASE WHEN y IS NOT NULL THEN y WHEN lt IS NULL THEN ry WHEN rt IS NULL THEN ly
        ELSE ly + (ry - ly) / (rt - lt) * (t - lt) END AS y FROM near),
      mid AS (SELECT series_id, fold, quantile_cont(y, 0.5) AS m, COUNT(*) AS c FROM filled GROUP BY ALL),
      dev AS (SELECT series_id, fold, quantile_cont(abs(y - m), 0.5) AS d FROM filled JOIN mid USING (series_id, fold) GROUP BY ALL),
      done AS (SELECT series_id, fold, cut, CASE WHEN c >= 5 AND d > 0 THEN GREATEST(LEAST(y, m + 1.4826 * d * 2), m - 1.4826 * d * 2) ELSE y END AS y
        FROM filled JOIN mid USING (series_id, fold) JOIN dev USING (series_id, fold))
      SELECT series_id, fold, cut, COUNT(*) AS "values", SUM(y) AS total, MAX(y) AS highest FROM done GROUP BY ALL""",
)
def prepared_windows(spark, folder):
    planned = backtest.plan_rows(aligned_arrays(part_panel(spark, folder)), HORIZON, MONTHLY)
    windows = backtest.fold_windows(planned, extra_windows=False, fill="interpolate", sigmas=2.0)
    return windows.select(
        "series_id",
        "fold",
        "cut",
        F.size("train").alias("values"),
        F.aggregate("train", F.lit(0.0), lambda a, v: a + v).alias("total"),
        F.array_max("train").alias("highest"),
    )


@query(
    "backtest_rows",
    "series_id:str model:str fold:int step:int ds:date y_true:2 y_pred:5",
    f"WITH {_backtest_sql(_SUPPLIERS)} SELECT series_id, model, fold, step, ds, y_true, y_pred FROM bt",
)
def backtest_rows(spark, folder):
    return backtested(supplier_arrays(spark, folder))[0]


@query(
    "croston",
    "series_id:str fold:int alpha:2 rate:5",
    f"WITH {_backtest_sql(_PARTS)} SELECT series_id, fold, alpha, rate FROM croston WHERE fold < 5",
)
def croston(spark, folder):
    windows = windows_of(part_arrays(spark, folder)).filter(F.col("fold").between(0, 4))
    # By the demands, not by the fit, which the filter would carry below itself.
    fitted = models.add_croston(windows.filter(F.size("hits") >= 2))
    return fitted.select("series_id", "fold", "croston.alpha", "croston.rate")


def _scored(series):
    rows, fitted = backtested(series)
    scores = backtest.score_models(rows, backtest.scale_rows(fitted))
    lengths = fitted.filter(F.col("fold") == backtest.FINAL_FOLD).select("series_id", "n")
    return rows, scores.join(lengths, "series_id"), fitted


@query(
    "model_scores",
    "series_id:str model:str mae:5 rmse:5 smape:5 wmape:5 bias:5 relative_bias:5 mase:5 winkler:4 folds:int",
    f"WITH {_backtest_sql(_SUPPLIERS)} SELECT * FROM scores",
)
def model_scores(spark, folder):
    return _scored(supplier_arrays(spark, folder))[1]


def _norm_sql(name: str) -> str:
    return f"""n_{name} AS (SELECT series_id, model, {name} AS v, COUNT({name}) OVER w AS c, quantile_cont({name}, 0.5) OVER w AS m
        FROM ok WINDOW w AS (PARTITION BY series_id)),
      d_{name} AS (SELECT *, quantile_cont(abs(v - m), 0.5) OVER (PARTITION BY series_id) AS d FROM n_{name}),
      i_{name} AS (SELECT *, CASE WHEN NOT (c >= 3 AND d > 0) OR v <= m + 6 * d THEN v END AS u FROM d_{name}),
      l_{name} AS (SELECT *, MIN(u) OVER w AS lo, MAX(u) OVER w AS hi FROM i_{name} WINDOW w AS (PARTITION BY series_id)),
      z_{name} AS (SELECT series_id, model, c, CASE WHEN c = 0 THEN 0 WHEN v IS NULL THEN 1
        WHEN hi - lo <= 1e-9 * GREATEST(abs(lo), abs(hi)) THEN CASE WHEN v <= hi THEN 0 ELSE 1 END
        ELSE GREATEST(LEAST((v - lo) / (hi - lo), 1), 0) END AS x FROM l_{name})"""


def _select_sql(source: str, roster=ROSTER) -> str:
    penalties = ", ".join(
        f"('{m}', {i}, {COMPLEXITY_PENALTY[m]}, {PARAMETER_BUDGET[m]})" for i, m in enumerate(roster)
    )
    return f"""{_backtest_sql(source)}, pen AS (SELECT * FROM (VALUES {penalties}) AS v(model, o, pen, budget)),
    ok AS (SELECT scores.*, plan.n, o, pen, budget FROM scores JOIN plan USING (series_id) JOIN pen USING (model) WHERE folds >= 0.5 * n_folds),
    {', '.join(_norm_sql(m) for m in ('wmape', 'mase', 'rmse', 'winkler'))},
    total AS (SELECT ok.*, 0.5 * a.x + 0.3 * b.x + 0.2 * c.x + CASE WHEN d.c >= 2 THEN 0.15 * d.x ELSE 0 END
        + pen * CASE WHEN n / budget >= 20 THEN 1 ELSE LEAST(3, 20 / GREATEST(n / budget, 1)) END AS score
      FROM ok JOIN z_wmape a USING (series_id, model) JOIN z_mase b USING (series_id, model) JOIN z_rmse c USING (series_id, model)
      JOIN z_winkler d USING (series_id, model)),
    chosen AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(score, 9), o) AS rank FROM total)"""


def chosen_models(series):
    rows, scores, fitted = _scored(series)
    return rows, selection.select_models(scores, ROSTER), fitted


@query(
    "select_models",
    "series_id:str model:str score:5 rank:int selected:bool",
    f"WITH {_select_sql(_SUPPLIERS)} SELECT series_id, model, score, rank, rank = 1 AS selected FROM chosen",
)
def select_models(spark, folder):
    return chosen_models(supplier_arrays(spark, folder))[1]


@query(
    "forecast_value_add",
    "series_id:str model:str model_error:5 baseline_error:5 value_add:5",
    f"""WITH {_select_sql(_SUPPLIERS)}, win AS (SELECT * FROM chosen WHERE rank = 1),
      base AS (SELECT series_id, MIN(wmape) AS b FROM chosen WHERE rank > 1 AND model IN ('naive', 'seasonal_naive') GROUP BY 1)
      SELECT series_id, model, wmape AS model_error, b AS baseline_error, (b - wmape) / abs(b) * 100 AS value_add FROM win JOIN base USING (series_id)""",
)
def forecast_value_add(spark, folder):
    return selection.value_add(chosen_models(supplier_arrays(spark, folder))[1])


def _said(name: str) -> str:
    """A model's name in words, each with a capital."""
    return f"array_to_string(list_transform(string_split({name}, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query(
    "selection_rationale",
    "series_id:str rationale:str",
    f"""WITH {_select_sql(_SUPPLIERS)}, ahead AS (
        SELECT *, lead(model) OVER o AS next_model, lead(score) OVER o AS next_score, lead(wmape) OVER o AS next_wmape
        FROM chosen WINDOW o AS (PARTITION BY series_id ORDER BY rank))
      SELECT series_id, {_said('model')} || ' was ' || printf('off by %.1f%% on average', wmape) || ' when tested against ' || folds || CASE WHEN folds = 1 THEN ' stretch' ELSE ' stretches' END
        || ' of unseen history.' || CASE WHEN next_score IS NULL THEN ''
          WHEN next_score - score < 0.05 THEN ' ' || {_said('next_model')} || ' was so close that the simpler was preferred.'
          ELSE ' Next best was ' || replace(next_model, '_', ' ') || printf(', off by %.1f%%.', next_wmape) END AS rationale
      FROM ahead WHERE rank = 1""",
)
def selection_rationale(spark, folder):
    return selection.rationale(chosen_models(supplier_arrays(spark, folder))[1])


@query(
    "blend_backtest",
    "series_id:str fold:int step:int y_true:2 y_pred:5",
    f"""WITH {_backtest_sql(_SUPPLIERS)},
      miss AS (SELECT *, abs(y_true - y_pred) AS a FROM bt),
      errs AS (SELECT DISTINCT series_id, model, fold, (SUM(a) OVER m - SUM(a) OVER f) / (COUNT(*) OVER m - COUNT(*) OVER f) AS e FROM miss
        WINDOW m AS (PARTITION BY series_id, model), f AS (PARTITION BY series_id, model, fold)),
      wts AS (SELECT *, 1 / GREATEST(e, MIN(CASE WHEN e > 0 THEN e END) OVER (PARTITION BY series_id, fold) * 1e-3) AS w FROM errs)
      SELECT b.series_id, b.fold, b.step, MAX(y_true) AS y_true, SUM(y_pred * wts.w) / SUM(wts.w) AS y_pred
      FROM bt b JOIN wts USING (series_id, model, fold) GROUP BY ALL""",
)
def blend_backtest(spark, folder):
    rows, scores, _ = _scored(supplier_arrays(spark, folder))
    return selection.blend_backtest(rows, scores)


# ---- Bands -----------------------------------------------------------------
_FORECAST = f"""{_select_sql(_SUPPLIERS)},
    win AS (SELECT series_id, model FROM chosen WHERE rank = 1),
    steps AS (SELECT unnest(range(1, {HORIZON + 1})) AS step),
    hist AS (SELECT series_id, arg_max(y, t) AS last, MIN(y) >= 0 AS non_negative, MAX(abs(y)) AS top, MAX(t) + 1 AS n FROM s GROUP BY 1),
    vol AS (SELECT series_id, quantile_cont(d, 0.5) AS md, AVG(d) AS ad FROM
      (SELECT series_id, abs(y - lag(y) OVER (PARTITION BY series_id ORDER BY t)) AS d FROM s) GROUP BY 1),
    fc AS (SELECT win.series_id, model, step, non_negative, CASE WHEN md > 0 THEN md WHEN ad > 0 THEN ad ELSE top * 0.1 END AS volatility,
        CASE model WHEN 'naive' THEN last WHEN 'seasonal_naive' THEN b.y ELSE rate END AS forecast
      FROM win CROSS JOIN steps JOIN hist USING (series_id) JOIN vol USING (series_id)
      LEFT JOIN s b ON b.series_id = win.series_id AND b.t = hist.n - 12 + (step - 1) % 12
      LEFT JOIN croston c ON c.series_id = win.series_id AND c.fold = 1000)"""


def forecast_rows(chosen, fitted, roster_paths):
    """series_id, step, forecast, volatility, non_negative of each winner."""
    final = fitted.filter(F.col("fold") == backtest.FINAL_FOLD)
    paths = F.create_map(*[x for name, path in roster_paths.items() for x in (F.lit(name), path)])
    winners = chosen.filter("selected").select("series_id", "model")
    volatility = F.when(F.col("typical") > 0, F.col("typical")).when(F.col("step") > 0, F.col("step"))
    joined = final.join(winners, "series_id").select(
        "series_id",
        "model",
        "last_ds",
        F.try_element_at(paths, F.col("model")).alias("_path"),
        F.coalesce(volatility, F.col("level") * 0.1).alias("volatility"),
        "non_negative",
    )
    return joined.select(
        "series_id", "model", "last_ds", "volatility", "non_negative", F.posexplode(F.slice("_path", 1, HORIZON)).alias("pos", "forecast")
    ).select("*", (F.col("pos") + 1).alias("step")).drop("pos")


def banded_forecasts(series):
    rows, chosen, fitted = chosen_models(series)
    _, paths = simple_paths(fitted)
    winners = cut_lineage(chosen.filter("selected"), "winners")
    forecasts = cut_lineage(forecast_rows(winners, fitted, paths), "forecasts")
    winner_rows = rows.join(winners.select("series_id", "model"), ["series_id", "model"])
    return intervals.build_bands(forecasts, intervals.residual_rows(winner_rows)), winner_rows


def _offsets_sql(tag: str, level: float) -> str:
    tail = (1 - level) / 2
    return f"""pool{tag} AS (SELECT series_id, COUNT(*) AS c, quantile_cont(r, {tail}) AS pl, quantile_cont(r, {1 - tail}) AS ph FROM res GROUP BY 1),
      own{tag} AS (SELECT series_id, step, COUNT(*) AS sc, quantile_cont(r, {tail}) AS sl, quantile_cont(r, {1 - tail}) AS sh FROM res GROUP BY ALL),
      raw{tag} AS (SELECT fc.series_id, fc.step, CASE WHEN sc >= 8 THEN sl ELSE pl * sqrt(fc.step) END AS l, CASE WHEN sc >= 8 THEN sh ELSE ph * sqrt(fc.step) END AS h
        FROM fc JOIN pool{tag} USING (series_id) LEFT JOIN own{tag} USING (series_id, step) WHERE c >= 8 AND ph > pl),
      off{tag} AS (SELECT series_id, step, MIN(LEAST(l, -(h - l) * 0.1)) OVER w AS lo, MAX(GREATEST(h, (h - l) * 0.1)) OVER w AS hi FROM raw{tag}
        WINDOW w AS (PARTITION BY series_id ORDER BY step))"""


_BANDS = f"""{_FORECAST}, res AS (SELECT bt.series_id, step, y_true - y_pred AS r FROM bt JOIN win USING (series_id, model) WHERE step <= {HORIZON}),
    {_offsets_sql('i', 0.8)}, {_offsets_sql('o', 0.95)},
    banded AS (SELECT fc.*, forecast + i.lo AS lower0, forecast + i.hi AS upper, forecast + LEAST(o.lo, i.lo) AS worst0,
        forecast + GREATEST(o.hi, i.hi) AS best_case FROM fc JOIN offi i USING (series_id, step) JOIN offo o USING (series_id, step)),
    bands AS (SELECT *, CASE WHEN non_negative THEN GREATEST(lower0, 0) ELSE lower0 END AS lower,
        CASE WHEN non_negative THEN LEAST(GREATEST(worst0, 0), GREATEST(lower0, 0)) ELSE worst0 END AS worst_case FROM banded)"""


@query(
    "forecast_bands",
    "series_id:str model:str step:int forecast:4 lower:4 upper:4 best_case:4 worst_case:4 method:str",
    f"""WITH {_BANDS} SELECT series_id, model, step, forecast, lower, upper, best_case, worst_case, 'empirical_quantiles' AS method
      FROM bands""",
)
def forecast_bands(spark, folder):
    return banded_forecasts(supplier_arrays(spark, folder))[0]


@query(
    "conformal_by_series",
    "series_id:str model:str step:int halfwidth:5",
    f"""WITH {_backtest_sql(_SUPPLIERS)}, ranked AS (SELECT series_id, model, step, abs(y_true - y_pred) AS a, row_number() OVER (PARTITION BY series_id, model, step
          ORDER BY abs(y_true - y_pred)) AS rk, COUNT(*) OVER (PARTITION BY series_id, model, step) AS c FROM bt),
      picked AS (SELECT series_id, model, step, a FROM ranked WHERE rk = LEAST(CAST(ceil((c + 1) * 0.8) AS BIGINT), c))
      SELECT series_id, model, step, MAX(a) OVER (PARTITION BY series_id, model ORDER BY step) AS halfwidth FROM picked""",
)
def conformal_by_series(spark, folder):
    rows, _ = backtested(supplier_arrays(spark, folder))
    return intervals.conformal_halfwidths(rows, 0.8, keys=("series_id", "model"))


_POOLED = f"""{_backtest_sql(_SUPPLIERS)}, sn AS (SELECT * FROM bt WHERE model = 'seasonal_naive'),
    ranked AS (SELECT step, abs(y_true - y_pred) AS a, row_number() OVER (PARTITION BY step ORDER BY abs(y_true - y_pred)) AS rk,
      COUNT(*) OVER (PARTITION BY step) AS c FROM sn),
    picked AS (SELECT step, a FROM ranked WHERE rk = LEAST(CAST(ceil((c + 1) * 0.8) AS BIGINT), c)),
    widths AS (SELECT step, MAX(a) OVER (ORDER BY step) AS halfwidth FROM picked)"""


@query("conformal_pooled", "step:int halfwidth:5", f"WITH {_POOLED} SELECT * FROM widths")
def conformal_pooled(spark, folder):
    rows, _ = backtested(supplier_arrays(spark, folder))
    return intervals.conformal_halfwidths(rows.filter("model = 'seasonal_naive'"), 0.8, keys=())


@query(
    "interval_coverage",
    "step:int nominal:2 observed:6 gap_pp:4 n_observations:int measurable:bool holds:bool",
    f"""WITH {_POOLED} SELECT step, 0.8 AS nominal, AVG(CAST(abs(y_true - y_pred) <= halfwidth + 1e-9 AS INTEGER)) AS observed,
        (AVG(CAST(abs(y_true - y_pred) <= halfwidth + 1e-9 AS INTEGER)) - 0.8) * 100 AS gap_pp, COUNT(*) AS n_observations,
        COUNT(*) >= 8 AS measurable, abs(AVG(CAST(abs(y_true - y_pred) <= halfwidth + 1e-9 AS INTEGER)) - 0.8) * 100 <= 5 AS holds
      FROM sn JOIN widths USING (step) GROUP BY step""",
)
def interval_coverage(spark, folder):
    rows, _ = backtested(supplier_arrays(spark, folder))
    points = rows.filter("model = 'seasonal_naive'")
    widths = intervals.conformal_halfwidths(points, 0.8, keys=())
    return intervals.coverage_report(intervals.apply_halfwidths(points, widths, keys=()), 0.8)


@query(
    "calibration",
    "step:int before_observed:6 after_observed:6 halfwidth:5 improved:bool",
    f"""WITH {_POOLED}, gauss AS (SELECT step, {NormalDist().inv_cdf(0.9)!r}::DOUBLE * stddev_samp(y_true - y_pred) AS g FROM sn GROUP BY step),
      m AS (SELECT step, MAX(halfwidth) AS halfwidth, AVG(CAST(abs(y_true - y_pred) <= g + 1e-9 AS INTEGER)) AS before_observed,
        AVG(CAST(abs(y_true - y_pred) <= halfwidth + 1e-9 AS INTEGER)) AS after_observed FROM sn JOIN widths USING (step) JOIN gauss USING (step) GROUP BY step)
      SELECT *, abs(after_observed - 0.8) * 100 <= abs(before_observed - 0.8) * 100 + 1e-9 AS improved FROM m""",
)
def calibration(spark, folder):
    rows, _ = backtested(supplier_arrays(spark, folder))
    points = rows.filter("model = 'seasonal_naive'").select("step", "y_true", "y_pred")
    z = NormalDist().inv_cdf(0.9)
    gauss = points.groupBy("step").agg((z * F.stddev_samp(F.col("y_true") - F.col("y_pred"))).alias("halfwidth"))
    return intervals.calibration(points, gauss, 0.8, keys=())


@query(
    "interval_check",
    "step:int observed:6 n_observations:int measurable:bool holds:bool",
    f"""WITH {_BANDS}, held AS (SELECT bt.*, LEAST(step, {HORIZON}) AS at FROM bt JOIN win USING (series_id, model)),
      moved AS (SELECT held.step, y_true, y_pred + lower - forecast AS lo, y_pred + upper - forecast AS hi FROM held
        JOIN bands b ON b.series_id = held.series_id AND b.step = held.at WHERE NOT (lower <= 0 AND forecast > 0))
      SELECT step, AVG(CAST(y_true BETWEEN lo - 1e-9 AND hi + 1e-9 AS INTEGER)) AS observed, COUNT(*) AS n_observations, COUNT(*) >= 8 AS measurable,
        abs(AVG(CAST(y_true BETWEEN lo - 1e-9 AND hi + 1e-9 AS INTEGER)) - 0.8) * 100 <= 5 AS holds FROM moved GROUP BY step""",
)
def interval_check(spark, folder):
    bands, rows = banded_forecasts(supplier_arrays(spark, folder))
    return intervals.coverage_report(intervals.transfer_bands(rows, bands), 0.8)


@query(
    "quantile_losses",
    "model:str pinball_10:5 pinball_50:5 pinball_90:5 crps:5",
    f"""WITH {_backtest_sql(_SUPPLIERS)}, b AS (SELECT *, y_pred * 0.8 AS q10, y_pred * 1.2 AS q90 FROM bt),
      l AS (SELECT model, AVG(GREATEST(0.1 * (y_true - q10), -0.9 * (y_true - q10))) AS pinball_10,
        AVG(GREATEST(0.5 * (y_true - y_pred), -0.5 * (y_true - y_pred))) AS pinball_50,
        AVG(GREATEST(0.9 * (y_true - q90), -0.1 * (y_true - q90))) AS pinball_90 FROM b GROUP BY model)
      SELECT *, (pinball_10 * 0.25 + pinball_50 * 0.4 + pinball_90 * 0.25) / 0.9 * 2 AS crps FROM l""",
)
def quantile_losses(spark, folder):
    from tidemark.functions import metrics

    rows, _ = backtested(supplier_arrays(spark, folder))
    t, p = F.col("y_true"), F.col("y_pred")
    losses = rows.groupBy("model").agg(
        metrics.pinball(t, p * 0.8, 0.1).alias("pinball_10"),
        metrics.pinball(t, p, 0.5).alias("pinball_50"),
        metrics.pinball(t, p * 1.2, 0.9).alias("pinball_90"),
    )
    return losses.withColumn(
        "crps", metrics.crps({0.1: F.col("pinball_10"), 0.5: F.col("pinball_50"), 0.9: F.col("pinball_90")})
    )


# ---- Transforms and fitted values ----------------------------------------------
@query(
    "log_transform",
    "series_id:str t:int logged:6 restored:3",
    f"""WITH {_SUPPLIERS}, b AS (SELECT *, CASE WHEN MIN(y) OVER w > 0 THEN 0 ELSE abs(MIN(y) OVER w) + 1 END AS shift FROM s WINDOW w AS (PARTITION BY series_id)),
      l AS (SELECT *, ln(GREATEST(y + shift, 1e-9)) AS lg FROM b), m AS (SELECT *, lg - lag(lg) OVER (PARTITION BY series_id ORDER BY t) AS d FROM l),
      v AS (SELECT series_id, LEAST(var_samp(d), 1) AS v FROM m GROUP BY 1)
      SELECT series_id, t, lg AS logged, exp(lg + CASE WHEN v > 0 THEN v / 2 ELSE 0 END) - shift AS restored FROM l JOIN v USING (series_id)""",
)
def log_transform(spark, folder):
    series = supplier_series(spark, folder)
    whole = Window.partitionBy("series_id")
    shifted = series.withColumn("shift", models.log_shift(F.min("y").over(whole)))
    logged = shifted.withColumn("logged", models.to_log(F.col("y"), F.col("shift")))
    moved = logged.withColumn("d", F.col("logged") - F.lag("logged").over(whole.orderBy("t")))
    rated = moved.withColumn("v", F.least(F.var_samp("d").over(whole), F.lit(1.0)))
    return rated.withColumn("restored", models.from_log(F.col("logged"), F.col("shift"), F.col("v")))


@query(
    "in_sample_fit",
    "series_id:str ds:date y:2 fitted:2",
    f"WITH {_SUPPLIERS} SELECT series_id, ds, y, lag(y, 12) OVER (PARTITION BY series_id ORDER BY t) AS fitted FROM s",
)
def in_sample_fit(spark, folder):
    return models.in_sample(supplier_series(spark, folder), 12)


@query(
    "median_blend",
    "series_id:str step:int y_pred:4",
    f"""WITH {_backtest_sql(_SUPPLIERS)}, last AS (SELECT series_id, MAX(fold) AS fold FROM bt GROUP BY 1)
      SELECT series_id, step, quantile_cont(y_pred, 0.5) AS y_pred FROM bt JOIN last USING (series_id, fold) GROUP BY ALL""",
)
def median_blend(spark, folder):
    rows, _ = backtested(supplier_arrays(spark, folder))
    last = rows.withColumn("_last", F.max("fold").over(Window.partitionBy("series_id"))).filter("fold = _last")
    return models.median_blend(last)

"""Queries that fit models: the fan-out, its run tables and global regressors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.constants import MONTHLY
from tidemark.functions.dates import is_settled
from tidemark.operators import arma, backtest, calendar, fanout, forecasters, grouped, racing, regression, report, run
from tidemark.plans.catalog import query, table
from tidemark.plans.forecasting import _SUPPLIERS, _backtest_sql, _select_sql, supplier_arrays, supplier_series, windows_of, zeroed
from tidemark.plans.panels import aligned_sql, supplier_cells, supplier_cells_sql, supplier_panel
from tidemark.session import cut_lineage

HORIZON = 6


def closed_panel(spark, folder):
    """The supplier panel, of months that can no longer grow."""
    return supplier_panel(spark, folder).filter(is_settled(F.col("ds"), _reach(spark, folder), MONTHLY))


def _reach(spark, folder):
    """The last day that any row speaks of."""
    return table(spark, folder, "lineitem").agg(F.max(F.col("l_shipdate").cast("date"))).scalar()


def _fanned(spark, folder):
    return fanout.run_fanout(closed_panel(spark, folder), MONTHLY, HORIZON, fill="auto", hierarchy_depth=3)


@query("fan_out", "series_id:str ds:date y:2 y_lower:2 y_upper:2 model:str route:str")
def fan_out(spark, folder):
    return _fanned(spark, folder).forecasts


@query("fan_out_parents", "level:int series_id:str ds:date y:2")
def fan_out_parents(spark, folder):
    return _fanned(spark, folder).parents


@query("fan_out_candidates", "series_id:str model:str rank:int selected:bool score:4 wmape:4 mase:4 winkler:2 folds:int")
def fan_out_candidates(spark, folder):
    return _fanned(spark, folder).candidates


@query("model_mix", "model:str route:str series:int")
def model_mix(spark, folder):
    winners = _fanned(spark, folder).forecasts.select("series_id", "model", "route").distinct()
    return report.model_mix(winners)


def _ran(spark, folder):
    from tidemark.plans.panels import key_cells

    cells = key_cells(spark, folder, "l_returnflag", MONTHLY, "l_quantity")
    panel = cells.filter(is_settled(F.col("period"), _reach(spark, folder), MONTHLY)).select(
        F.col("l_returnflag").alias("series_id"), F.col("period").alias("ds"), F.col("value").alias("y")
    )
    return run.run_forecast(panel, MONTHLY, HORIZON)


@query("run_points", "series_id:str ds:date step:int model:str forecast:1 lower:1 upper:1 best_case:1 worst_case:1 method:str")
def run_points(spark, folder):
    return _ran(spark, folder).points


@query("run_candidates", "series_id:str model:str rank:int selected:bool score:4 wmape:4 folds:int")
def run_candidates(spark, folder):
    return _ran(spark, folder).candidates


@query("run_metrics", "series_id:str model:str wmape:4 mase:4 forecast_total:1 best_total:1 worst_total:1 value_add:3")
def run_metrics(spark, folder):
    return _ran(spark, folder).metrics


@query(
    "run_coverage",
    "series_id:str forecasts:int errors:int",
    """SELECT DISTINCT l_returnflag AS series_id, 1 AS forecasts, 0 AS errors FROM lineitem
      UNION ALL SELECT 'never reported', 0, 1""",
)
def run_coverage(spark, folder):
    """Every series is forecast or has its reason: the three flags, and one whose
    value was never reported."""
    from tidemark.plans.panels import key_cells

    cells = key_cells(spark, folder, "l_returnflag", MONTHLY, "l_quantity")
    panel = cells.filter(is_settled(F.col("period"), _reach(spark, folder), MONTHLY)).select(
        F.col("l_returnflag").alias("series_id"), F.col("period").alias("ds"), F.col("value").alias("y")
    )
    silent = panel.filter(F.col("series_id") == "N").select(F.lit("never reported").alias("series_id"), "ds", F.lit(None).cast("double").alias("y"))
    out = run.run_forecast(panel.unionByName(silent), MONTHLY, HORIZON, requested=("naive", "seasonal_naive"))
    found = out.points.select("series_id").distinct().withColumn("forecasts", F.lit(1)).withColumn("errors", F.lit(0))
    return found.unionByName(out.errors.select("series_id", F.lit(0).alias("forecasts"), F.lit(1).alias("errors")))


@query("gradient_boosting", "series_id:str step:int ds:date forecast:2")
def gradient_boosting(spark, folder):
    series = supplier_series(spark, folder)
    rows, names = regression.training_rows(series, MONTHLY)
    assembler, model = regression.fit(rows, names, regression.gradient_boosting())
    return regression.forecast(series, MONTHLY, HORIZON, assembler, model)


@query("linear_regression", "series_id:str step:int ds:date forecast:2")
def linear_regression(spark, folder):
    series = supplier_series(spark, folder)
    rows, names = regression.training_rows(series, MONTHLY)
    assembler, model = regression.fit(rows, names, regression.linear(0.01))
    return regression.forecast(series, MONTHLY, HORIZON, assembler, model)


@query("tuned_regression", "candidate:str wmape:3")
def tuned_regression(spark, folder):
    rows, names = regression.training_rows(supplier_series(spark, folder), MONTHLY)
    candidates = {f"ridge {r}": (lambda r=r: regression.linear(r)) for r in (0.0, 0.1, 1.0)}
    ranked = regression.tune(rows, names, candidates, ["1999-01-01", "2000-01-01"])
    return spark.createDataFrame(ranked, "candidate string, wmape double")


# ---- Regression with ARMA errors -------------------------------------------
_ARMA = f"""WITH {_SUPPLIERS},
    line AS (SELECT series_id, MAX(n) AS n, AVG(y) AS base, regr_slope(y, t) AS slope, MAX(ds) AS last FROM s GROUP BY 1 HAVING MAX(n) >= 12),
    res AS (SELECT s.series_id, s.t, line.n, y - base - slope * (t - (line.n - 1) / 2.0) AS u FROM s JOIN line USING (series_id)),
    lagged AS (SELECT *, lag(u, 1) OVER w AS u1, lag(u, 2) OVER w AS u2, lag(u, 3) OVER w AS u3 FROM res WINDOW w AS (PARTITION BY series_id ORDER BY t)),
    cov AS (SELECT series_id, SUM(u * u) / MAX(n) AS c0, SUM(u * u1) / MAX(n) AS c1, SUM(u * u2) / MAX(n) AS c2, SUM(u * u3) / MAX(n) AS c3 FROM lagged GROUP BY 1),
    l1 AS (SELECT *, c1 / c0 AS k1, c0 * (1 - (c1 / c0) ** 2) AS e1 FROM cov),
    l2 AS (SELECT *, (c2 - k1 * c1) / e1 AS k2 FROM l1),
    l3 AS (SELECT *, k1 - k2 * k1 AS p1, k2 AS p2, e1 * (1 - k2 ** 2) AS e2 FROM l2),
    l4 AS (SELECT *, (c3 - p1 * c2 - p2 * c1) / e2 AS k3 FROM l3),
    inn AS (SELECT g.series_id, g.t, g.u, g.u1, CASE WHEN g.t >= 3 THEN g.u - (p1 - k3 * p2) * g.u1 - (p2 - k3 * p1) * g.u2 - k3 * g.u3 ELSE 0 END AS e FROM lagged g JOIN l4 USING (series_id)),
    pairs AS (SELECT *, lag(e) OVER (PARTITION BY series_id ORDER BY t) AS e1 FROM inn),
    sums AS (SELECT series_id, SUM(u1 * u1) AS xx, SUM(u1 * e1) AS xe, SUM(e1 * e1) AS ee, SUM(u * u1) AS xy, SUM(u * e1) AS ey FROM pairs WHERE t >= 4 GROUP BY 1),
    raw AS (SELECT series_id, (xy * ee - ey * xe) / (xx * ee - xe * xe) AS phi, (ey * xx - xy * xe) / (xx * ee - xe * xe) AS theta FROM sums),
    part AS (SELECT series_id, CASE WHEN abs(phi) > 0.98 THEN sign(phi) * 0.98 ELSE phi END AS phi,
      CASE WHEN abs(theta) > 0.98 THEN sign(theta) * 0.98 ELSE theta END AS theta FROM raw),
    held AS (SELECT series_id, list({{'u': u, 'e': u}} ORDER BY t) AS us FROM res GROUP BY 1),
    ended AS (SELECT series_id, phi, theta, list_reduce(us, lambda a, b: {{'u': b.u, 'e': b.u - phi * a.u - theta * a.e}}) AS z FROM held JOIN part USING (series_id)),
    steps AS (SELECT unnest(range(1, {HORIZON} + 1)) AS step)
    SELECT series_id, step, CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS ds,
      base + slope * ((n - 1) / 2.0 + step) + (phi * z.u + theta * z.e) * phi ** (step - 1) AS forecast
    FROM ended JOIN line USING (series_id), steps"""


@query("arma_regression", "series_id:str step:int ds:date forecast:2", _ARMA)
def arma_regression(spark, folder):
    """A line and ARMA(1, 1) errors with a long autoregression of three lags."""
    return arma.arma_forecast(supplier_series(spark, folder), MONTHLY, HORIZON, 12, seasonal=False, orders=((1, 1),), long=3)


# ---- The racing search ------------------------------------------------------
_DRAWN = racing.draw({"level": (0.05, 0.95), "trend": (0.001, 0.4), "damping": (0.8, 0.98)})


def _race_sql() -> str:
    drawn = ", ".join(f"({i}, {d['level']}::DOUBLE, {d['trend']}::DOUBLE, {d['damping']}::DOUBLE)" for i, d in enumerate(_DRAWN))
    ctes = [
        f"draws AS (SELECT * FROM (VALUES {drawn}) AS v(candidate, a, b, p))",
        "lists AS (SELECT series_id, fold, list({'l': y, 's': 0.0::DOUBLE} ORDER BY t) AS ys FROM train WHERE fold < 5 GROUP BY ALL)",
        """walked AS (SELECT series_id, fold, candidate, p, list_reduce(ys, lambda h, x: {'l': h.l + p * h.s + a * (x.l - h.l - p * h.s), 's': p * h.s + b * a * (x.l - h.l - p * h.s)}) AS z
          FROM lists, draws)""",
        """errs AS (SELECT candidate, fold, SUM(abs(y_true - z.l - z.s * p * (1 - p ** step) / (1 - p))) / SUM(abs(y_true)) AS error
          FROM walked JOIN tests USING (series_id, fold) GROUP BY ALL)""",
        "alive0 AS (SELECT candidate FROM draws)",
    ]
    parts = []
    for fold in range(5):
        earlier = "" if not fold else f"UNION ALL SELECT candidate, against FROM seen{fold - 1} JOIN alive{fold} USING (candidate)"
        ctes.append(
            f"""seen{fold} AS (SELECT candidate, error / MIN(error) OVER () AS against FROM errs JOIN alive{fold} USING (candidate) WHERE fold = {fold} {earlier})"""
        )
        stays = "rank = 1" if fold == 4 else f"rank <= GREATEST({racing.FEWEST}, ceil(COUNT(*) OVER () * {racing.KEEP}))"
        ctes.append(
            f"""placed{fold} AS (SELECT *, row_number() OVER (ORDER BY score, candidate) AS rank FROM (
              SELECT candidate, {1 - racing.WORST_WEIGHT} * AVG(against) + {racing.WORST_WEIGHT} * MAX(against) AS score FROM seen{fold} GROUP BY 1))"""
        )
        ctes.append(f"round{fold} AS (SELECT candidate, {fold + 1} AS round, score, rank, {stays} AS stays FROM placed{fold})")
        ctes.append(f"alive{fold + 1} AS (SELECT candidate FROM round{fold} WHERE stays)")
        parts.append(f"SELECT * FROM round{fold}")
    return f"""WITH {_backtest_sql(_SUPPLIERS)}, {', '.join(ctes)}
      SELECT candidate, round, a AS level, b AS trend, p AS damping, score, rank, stays FROM ({' UNION ALL '.join(parts)}) JOIN draws USING (candidate)"""


@query("tuned_candidates", "candidate:int round:int level:4 trend:4 damping:4 score:5 rank:int stays:bool", _race_sql())
def tuned_candidates(spark, folder):
    """Which of sixteen drawn smoothing settings leaves the race in which round."""
    shape = F.struct(F.lit(12).alias("period"), F.lit(False).alias("has_season"), F.lit(True).alias("has_trend"))
    out = racing.race(windows_of(supplier_arrays(spark, folder)).withColumn("shape", shape), racing.smoothing_fit, _DRAWN)
    settings = spark.createDataFrame([(i, d["level"], d["trend"], d["damping"]) for i, d in enumerate(_DRAWN)], "candidate int, level double, trend double, damping double")
    return out.rounds.join(F.broadcast(settings), "candidate")


# ---- Trees at every cut -----------------------------------------------------
#: The trees' error may pass the repeated season's by this factor at most.
TREES_MAY = 1.5


@query(
    "tree_backtest",
    "fold:int rows:int season_error:5 within:bool",
    f"""WITH {_backtest_sql(_SUPPLIERS)}
      , ends AS (SELECT f.series_id, f.fold, s.ds AS last FROM folds f JOIN s ON s.series_id = f.series_id AND s.t = f.cut - 1 WHERE f.fold < 5),
      early AS (SELECT fold, MIN(last) AS day FROM (SELECT fold, last, cume_dist() OVER (PARTITION BY fold ORDER BY last) AS c FROM ends) WHERE c > {regression.EARLY} GROUP BY fold)
      SELECT fold, COUNT(*) AS rows, SUM(abs(y_true - y_pred)) / SUM(abs(y_true)) AS season_error, TRUE AS within
      FROM preds JOIN plan USING (series_id) JOIN ends USING (series_id, fold) JOIN early USING (fold)
      WHERE model = 'seasonal_naive' AND last >= day AND cut - CASE WHEN scheme = 'rolling' THEN GREATEST(cut - start, 0) ELSE 0 END >= {2 * max(regression.LAGS)}
      GROUP BY fold""",
)
def tree_backtest(spark, folder):
    """Boosted trees fitted at every cut, beside the last season, fold by fold."""
    shape = F.struct(F.lit(12).alias("period"), F.lit(False).alias("has_season"), F.lit(False).alias("has_trend"))
    windows = cut_lineage(windows_of(supplier_arrays(spark, folder)).withColumn("shape", shape).filter(F.col("fold").between(0, backtest.FINAL_FOLD - 1)), "windows")
    made = forecasters.add_paths(windows, ("seasonal_naive", "gradient_boosting"), MONTHLY, F.col("test_horizon"))
    both = made.filter(F.col("paths.gradient_boosting").isNotNull()).select("fold", F.explode("test").alias("p"), "paths")
    seen = both.filter(F.col("p.y").isNotNull())

    def error(name: str):
        miss = F.abs(F.col("p.y") - F.get(F.col(f"paths.{name}"), F.col("p.step") - 1))
        return F.sum(miss) / F.sum(F.abs(F.col("p.y")))

    return seen.groupBy("fold").agg(F.count("*").alias("rows"), error("seasonal_naive").alias("season_error"), (error("gradient_boosting") <= TREES_MAY * error("seasonal_naive")).alias("within"))


# ---- The grouped run ---------------------------------------------------------
#: The plain models, whose run SQL can follow: no blend, and a year as the season.
_PLAIN = ("naive", "seasonal_naive")
_CLOSED = """(CAST(period + INTERVAL 1 MONTH AS DATE) - 1 <= (SELECT MAX(CAST(l_shipdate AS DATE)) FROM lineitem)
      OR period < (SELECT date_trunc('month', MAX(CAST(l_shipdate AS DATE))) FROM lineitem))"""
_LEAVES = f"""SELECT region || ' · ' || nation AS series_id, period AS ds, SUM(value) AS y
    FROM ({supplier_cells_sql(MONTHLY, 'l_quantity')}) WHERE {_CLOSED} GROUP BY ALL"""


def _grouped_sql() -> str:
    leaves = f"{aligned_sql(_LEAVES, MONTHLY)}, leaf AS (SELECT series_id, t, n, ds, COALESCE(y, 0) AS y FROM aligned)"
    top = "top AS (SELECT 'Total' AS series_id, ds, SUM(y) AS y FROM leaf GROUP BY ds)"
    series = """s AS (SELECT * FROM leaf UNION ALL SELECT series_id, row_number() OVER (ORDER BY ds) - 1, COUNT(*) OVER (), ds, y FROM top)"""
    source = f"{leaves}, {top}, {series}"
    return f"""{_select_sql(source, _PLAIN)},
      won AS (SELECT series_id, model, wmape, folds FROM chosen WHERE rank = 1),
      ahead AS (SELECT unnest(range(1, {HORIZON} + 1)) AS step),
      own AS (SELECT w.series_id, step, MAX(s.y) AS own FROM won w, ahead JOIN s ON s.series_id = w.series_id
          AND s.t = s.n - CASE WHEN w.model = 'naive' THEN 1 ELSE 12 - (step - 1) % 12 END GROUP BY ALL),
      direct AS (SELECT step, own AS total FROM own WHERE series_id = 'Total'),
      sized AS (SELECT series_id, COALESCE(SUM(y) FILTER (WHERE ds > e - INTERVAL 12 MONTH), 0) AS now,
          SUM(y) FILTER (WHERE ds <= e - INTERVAL 12 MONTH AND ds > e - INTERVAL 24 MONTH) AS prior
        FROM leaf, (SELECT MAX(ds) AS e FROM leaf) GROUP BY series_id),
      shared AS (SELECT *, CASE WHEN SUM(abs(now)) OVER () > 0 THEN abs(now) / SUM(abs(now)) OVER () ELSE 1.0 / COUNT(*) OVER () END AS share FROM sized),
      points AS (SELECT z.series_id, split_part(z.series_id, ' · ', 1) AS region, step, COALESCE(o.own, total * z.share) AS p, o.own IS NULL AS given, total
        FROM shared z CROSS JOIN direct d LEFT JOIN own o USING (series_id, step)),
      nodes AS (SELECT 2 AS level, series_id AS label, region AS parent_label, step, p AS own, p / SUM(p) OVER (PARTITION BY step) * total AS rec FROM points
        UNION ALL SELECT 1, region, 'Total', step, SUM(p), SUM(p) / MAX(w) * MAX(total) FROM (SELECT *, SUM(p) OVER (PARTITION BY step) AS w FROM points) GROUP BY region, step
        UNION ALL SELECT 0, 'Total', NULL, step, total, total FROM direct)"""


def _grouped(spark, folder):
    cells = supplier_cells(spark, folder, MONTHLY, "l_quantity").filter(is_settled(F.col("period"), _reach(spark, folder), MONTHLY))
    leaves = cells.groupBy(F.to_json(F.array("region", "nation")).alias("series_id"), F.col("period").alias("ds")).agg(F.sum("value").alias("y"))
    whole = zeroed(calendar.align_calendar(leaves, MONTHLY)).select(F.from_json("series_id", "array<string>").alias("path"), "ds", "y")
    shape = F.struct(F.lit(12).alias("period"), F.lit(True).alias("has_season"), F.lit(False).alias("has_trend"))
    return grouped.run_grouped(whole, MONTHLY, HORIZON, 2, requested=_PLAIN, members=1, shape=shape)


@query(
    "grouped_run_points",
    "level:int label:str step:int ds:date own:2 forecast:2 model:str",
    f"""WITH {_grouped_sql()} SELECT level, label, step, CAST((SELECT MAX(ds) FROM top) + to_months(CAST(step AS INTEGER)) AS DATE) AS ds, own, rec AS forecast, model
      FROM nodes LEFT JOIN won ON won.series_id = label AND level <> 1""",
)
def grouped_run_points(spark, folder):
    """Nations by region: leaves, the direct top line and what is scaled between."""
    return _grouped(spark, folder).points


@query(
    "grouped_run_series",
    "level:int label:str parent_label:str model:str wmape:4 folds:int forecast_total:2 current_total:2 prior_total:2 share:2 status:str",
    f"""WITH {_grouped_sql()}, past AS (SELECT 2 AS level, series_id AS label, now, prior FROM sized
        UNION ALL SELECT 1, split_part(series_id, ' · ', 1), SUM(now), SUM(prior) FROM sized GROUP BY ALL UNION ALL SELECT 0, 'Total', SUM(now), SUM(prior) FROM sized),
      node_sums AS (SELECT level, label, parent_label, SUM(rec) AS total FROM nodes GROUP BY ALL)
      SELECT level, label, parent_label, model, wmape, COALESCE(folds, 0) AS folds, total AS forecast_total, now AS current_total, prior AS prior_total,
        round(total / (SELECT SUM(total) FROM direct) * 100, 2) AS share, CASE WHEN level = 2 AND model IS NULL THEN 'estimated' ELSE 'forecast' END AS status
      FROM node_sums JOIN past USING (level, label) LEFT JOIN won ON won.series_id = label AND level <> 1""",
)
def grouped_run_series(spark, folder):
    return _grouped(spark, folder).series


@query(
    "grouped_run_gap",
    "implied:2 direct:2 gap:6",
    f"""WITH {_grouped_sql()} SELECT implied, direct, abs(implied - direct) / abs(direct) AS gap
      FROM (SELECT SUM(own) FILTER (WHERE level = 2) AS implied, SUM(own) FILTER (WHERE level = 0) AS direct FROM nodes)""",
)
def grouped_run_gap(spark, folder):
    return _grouped(spark, folder).gap

"""Queries over issued runs: scoring, accuracy, decisions, reports, scenarios.

Each region is one run: its suppliers are the series, its nations the level
between, and the year 2001 is forecast from the year before. The run tables
are derived from the fact table and written, as issued forecasts are.
"""

from __future__ import annotations

import hashlib
from datetime import date

from pyspark.sql import functions as F

from tidemark.constants import MONTHLY
from tidemark.operators import decisions, hierarchy, insights, report, scenarios, scoring
from tidemark.plans.catalog import query, table
from tidemark.plans.panels import supplier_cells, supplier_cells_sql, trunc_sql
from tidemark.functions import metrics
from tidemark.session import cut_lineage, run_dir, scratch_path
from tidemark.sources import store

_LOW, _HIGH, _WORST, _BEST = 0.04, 0.06, 0.05, 0.08
_ISSUED = "2001-01-01"


def _listing(spark, folder):
    """A name for the files a folder's facts lie in: their sizes and times, no row is read."""
    seen = []
    for name in ("lineitem", "supplier", "nation", "region"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        seen += sorted((str(one.getPath()), one.getLen(), one.getModificationTime()) for one in files)
    return hashlib.sha1(repr(seen).encode()).hexdigest()


def _levels(spark, folder):
    """run_id, path, level, label, period, value of every node, issued once for
    each state of the files."""
    path, name = f"{run_dir(spark)}/levels", _listing(spark, folder)
    if name not in {one["run_id"] for one in store.issued_runs(spark, path)}:
        cells = supplier_cells(spark, folder)
        leaves = cells.select(F.col("region").alias("owner"), F.array("nation", "supplier").alias("path"), "period", "value")
        rolled = hierarchy.roll_up(leaves, ["value"], ["owner", "period"])
        store.issue_run({"levels": rolled.withColumn("label", hierarchy.label_of(F.col("path")))}, path, name)
    return store.read_run(spark, path, "levels", [name]).drop("run_id").withColumnRenamed("owner", "run_id")


def issued_points(spark, folder):
    """Forecast points of 2001 for every node."""
    past = _levels(spark, folder).filter(F.col("period").between("2000-01-01", "2000-12-01"))
    f, step = F.col("value"), F.month("period")
    return past.select(
        "run_id",
        "level",
        "label",
        "path",
        F.add_months("period", 12).alias("period"),
        step.alias("step"),
        F.lit("forecast").alias("kind"),
        f.alias("forecast"),
        (f * (1 - _LOW * step)).alias("lower"),
        (f * (1 + _HIGH * step)).alias("upper"),
        (f * (1 + _BEST * step)).alias("best_case"),
        (f * (1 - _WORST * step)).alias("worst_case"),
    )


def outcomes(spark, folder):
    late = _levels(spark, folder).filter(F.col("period") >= _ISSUED)
    return late.select("run_id", "level", "label", "period", F.col("value").alias("actual"))


def graded_points(spark, folder):
    last = table(spark, folder, "lineitem").agg(F.max(F.col("l_shipdate").cast("date"))).scalar()
    settled = scoring.settled_points(issued_points(spark, folder), last, MONTHLY)
    return scoring.with_actuals(settled, outcomes(spark, folder), ["run_id", "level", "label"])


def leaf_series(spark, folder):
    """Leaves with totals of both years, backtest error and realised totals."""
    leaves = _levels(spark, folder).filter("level = 2")
    now = F.col("period").between("2000-01-01", "2000-12-01")
    before = F.col("period").between("1999-01-01", "1999-12-01")
    totals = leaves.groupBy("run_id", "path", "label").agg(
        F.sum(F.when(now, F.col("value"))).alias("current_total"), F.sum(F.when(before, F.col("value"))).alias("prior_total")
    )
    year = leaves.filter(now).select("run_id", "label", F.month("period").alias("m"), F.col("value").alias("y"))
    last = leaves.filter(before).select("run_id", "label", F.month("period").alias("m"), F.col("value").alias("p"))
    miss = year.join(last, ["run_id", "label", "m"]).groupBy("run_id", "label").agg(
        (F.sum(F.abs(F.col("y") - F.col("p"))) / F.sum(F.abs("y")) * 100).alias("wmape")
    )
    happened = graded_points(spark, folder).filter("level = 2").groupBy("run_id", "label").agg(F.sum("actual").alias("actual_total"))
    return (
        totals.filter(F.col("current_total").isNotNull())
        .join(miss, ["run_id", "label"], "left")
        .join(happened, ["run_id", "label"], "left")
        .withColumn("forecast_total", F.col("current_total"))
    )


RUNS = f"""cells AS ({supplier_cells_sql()}),
    lv AS (SELECT region AS run_id, 0 AS level, 'Total' AS label, period, SUM(value) AS value FROM cells GROUP BY ALL
      UNION ALL SELECT region, 1, nation, period, SUM(value) FROM cells GROUP BY ALL
      UNION ALL SELECT region, 2, nation || ' · ' || supplier, period, SUM(value) FROM cells GROUP BY ALL),
    fp AS (SELECT run_id, level, label, CAST(period + INTERVAL 12 MONTH AS DATE) AS period, month(period) AS step, value AS forecast,
        value * (1 - {_LOW}::DOUBLE * month(period)) AS lower, value * (1 + {_HIGH}::DOUBLE * month(period)) AS upper,
        value * (1 + {_BEST}::DOUBLE * month(period)) AS best_case, value * (1 - {_WORST}::DOUBLE * month(period)) AS worst_case
      FROM lv WHERE period BETWEEN DATE '2000-01-01' AND DATE '2000-12-01'),
    oc AS (SELECT run_id, level, label, period, value AS actual FROM lv WHERE period >= DATE '{_ISSUED}'),
    reach AS (SELECT MAX(CAST(l_shipdate AS DATE)) AS r FROM lineitem),
    graded AS (SELECT fp.*, COALESCE(actual, 0) AS actual FROM fp LEFT JOIN oc USING (run_id, level, label, period)
      WHERE CAST(fp.period + INTERVAL 1 MONTH AS DATE) - 1 <= (SELECT r FROM reach)
        OR fp.period < (SELECT date_trunc('month', r) FROM reach)),
    tot AS (SELECT run_id, label, SUM(value) FILTER (WHERE year(period) = 2000) AS current_total,
        SUM(value) FILTER (WHERE year(period) = 1999) AS prior_total FROM lv WHERE level = 2 GROUP BY ALL),
    miss AS (SELECT a.run_id, a.label, SUM(abs(a.value - b.value)) / SUM(abs(a.value)) * 100 AS wmape FROM lv a JOIN lv b
      ON a.run_id = b.run_id AND a.label = b.label AND a.level = 2 AND b.level = 2 AND year(a.period) = 2000 AND year(b.period) = 1999
        AND month(a.period) = month(b.period) GROUP BY ALL),
    real AS (SELECT run_id, label, SUM(actual) AS actual_total FROM graded WHERE level = 2 GROUP BY ALL),
    leaf AS (SELECT tot.*, current_total AS forecast_total, wmape, actual_total FROM tot LEFT JOIN miss USING (run_id, label)
      LEFT JOIN real USING (run_id, label) WHERE current_total IS NOT NULL)"""

_CARD = """top AS (SELECT * FROM graded WHERE level = 0),
    card AS (SELECT run_id, COUNT(*) AS scored_periods, SUM(forecast) AS forecast_total, SUM(actual) AS actual_total,
        SUM(abs(actual - forecast)) / SUM(abs(actual)) * 100 AS wmape, AVG(abs(actual - forecast)) AS mae,
        SUM(forecast - actual) / SUM(abs(actual)) * 100 AS bias,
        AVG(CAST(actual BETWEEN lower AND upper AS INTEGER)) * 100 AS coverage FROM top GROUP BY run_id),
    cards AS (SELECT h.run_id, h.horizon, COALESCE(scored_periods, 0) AS scored_periods, horizon - COALESCE(scored_periods, 0) AS pending_periods,
        forecast_total, actual_total, wmape, mae, bias, coverage, round((forecast_total - actual_total) / mae, 2) AS tracking_signal
      FROM (SELECT run_id, COUNT(*) AS horizon FROM fp WHERE level = 0 GROUP BY 1) h LEFT JOIN card USING (run_id))"""


def run_cards(spark, folder):
    top = issued_points(spark, folder).filter("level = 0")
    horizon = top.groupBy("run_id").agg(F.count("*").alias("horizon"))
    return scoring.scorecard(graded_points(spark, folder).filter("level = 0"), horizon)


@query(
    "scorecard",
    "run_id:str horizon:int scored_periods:int pending_periods:int forecast_total:2 actual_total:2 wmape:4 mae:2 bias:4 "
    "coverage:4 tracking_signal:1 drifted:bool",
    f"""WITH {RUNS}, {_CARD} SELECT *, COALESCE(abs(tracking_signal) > 4, false) OR COALESCE(wmape > 50, false) AS drifted FROM cards""",
)
def scorecard(spark, folder):
    return run_cards(spark, folder)


@query(
    "series_scores",
    "run_id:str level:int label:str forecast_total:2 actual_total:2 wmape:4 scored_periods:int miss:2",
    f"""WITH {RUNS} SELECT run_id, level, label, SUM(forecast) AS forecast_total, SUM(actual) AS actual_total,
        SUM(abs(actual - forecast)) / NULLIF(SUM(abs(actual)), 0) * 100 AS wmape, COUNT(*) AS scored_periods,
        SUM(forecast) - SUM(actual) AS miss FROM graded GROUP BY ALL""",
)
def series_scores(spark, folder):
    return scoring.series_scores(graded_points(spark, folder), ["run_id", "level", "label"])


@query(
    "unforecast_keys",
    "l_partkey:int l_suppkey:int",
    f"""SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate >= DATE '{_ISSUED}'
      EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < DATE '{_ISSUED}'""",
)
def unforecast_keys(spark, folder):
    rows = table(spark, folder, "lineitem")
    day = F.col("l_shipdate").cast("date")
    return scoring.unforecast_keys(rows.filter(day >= _ISSUED), rows.filter(day < _ISSUED), ["l_partkey", "l_suppkey"])


#: Stored candidates and the days they were made on (parameters of the query).
_MADE = {"original": "2001-01-05", "refresh": "2001-12-01", "units": "2001-12-05", "short": "2001-12-07", "lacking": "2001-12-08"}


@query(
    "source_choice",
    "source:str contradicting:int",
    f"""WITH rows AS (SELECT CAST(l_shipdate AS DATE) AS day, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS less, l_quantity AS units FROM lineitem),
      stored(source, made, priced) AS (VALUES {', '.join(f"('{name}', DATE '{day}', {'FALSE' if name == 'lacking' else 'TRUE'})" for name, day in _MADE.items())}),
      cells AS (SELECT date_trunc('month', day) AS m, SUM(price) AS original, SUM(less) AS refresh, SUM(units) AS units,
          SUM(price) FILTER (WHERE day < DATE '{_ISSUED}') AS short FROM rows GROUP BY 1),
      reach AS (SELECT source, CASE source WHEN 'short' THEN (SELECT MAX(day) FROM rows WHERE day < DATE '{_ISSUED}') ELSE (SELECT MAX(day) FROM rows) END AS last FROM stored),
      tall AS (SELECT source, m, CASE source WHEN 'original' THEN original WHEN 'refresh' THEN refresh WHEN 'units' THEN units ELSE short END AS v, original AS ours
        FROM cells, stored WHERE m < DATE '{_ISSUED}'),
      gaps AS (SELECT source, CASE WHEN COUNT(v) > 0 THEN SUM(abs(v - ours)) / LEAST(SUM(abs(v)), SUM(abs(ours))) END AS gap FROM tall GROUP BY 1),
      fit AS (SELECT s.source, made, CASE WHEN gap IS NULL THEN 'unproven' WHEN gap < 1 THEN 'agrees' ELSE 'contradicts' END AS verdict
        FROM stored s JOIN reach USING (source) JOIN gaps USING (source) WHERE priced AND last >= DATE '{_ISSUED}'),
      chosen AS (SELECT source, made FROM fit WHERE verdict <> 'contradicts' ORDER BY verdict = 'agrees' DESC, made DESC, source LIMIT 1)
      SELECT chosen.source, (SELECT COUNT(*) FROM fit WHERE verdict = 'contradicts' AND fit.made > chosen.made) AS contradicting FROM chosen""",
)
def source_choice(spark, folder):
    """Of five stored tables one is too short and one lacks the measure; the newest
    of the others that agrees with the history is taken."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("day"), "l_extendedprice", "l_discount", F.col("l_quantity").cast("double").alias("l_quantity")
    )
    price = F.col("l_extendedprice").cast("double").alias("price")
    frames = {
        "original": rows.select("day", price),
        "refresh": rows.select("day", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("price")),
        "units": rows.select("day", F.col("l_quantity").alias("price")),
        "short": rows.filter(F.col("day") < _ISSUED).select("day", price),
        "lacking": rows.select("day", "l_quantity"),
    }
    paths = {name: scratch_path(spark, name) for name in frames}
    for name, frame in frames.items():
        store.write_table(frame, paths[name])
    fitting = store.fitting_sources(spark, paths, ["price"], "day", date.fromisoformat(_ISSUED))
    month = F.trunc("day", "month").alias("period")
    history = spark.read.parquet(paths["original"]).filter(F.col("day") < _ISSUED).groupBy(month).agg(F.sum("price").alias("value"))
    observed = None
    for name in fitting:
        own = spark.read.parquet(paths[name]).groupBy(month).agg(F.sum("price").alias("value")).withColumn("source", F.lit(name))
        observed = own if observed is None else observed.unionByName(own)
    made = spark.createDataFrame([(name, _MADE[name]) for name in fitting], "source string, created_at string")
    return scoring.choose_source(scoring.weigh_sources(history, observed), made.withColumn("created_at", F.col("created_at").cast("date")))


def _sources(spark, folder):
    rows = table(spark, folder, "lineitem")
    month = F.trunc(F.col("l_shipdate").cast("date"), "month").alias("period")
    history = rows.filter(F.col("l_shipdate").cast("date") < _ISSUED).groupBy(month).agg(F.sum("l_extendedprice").alias("value"))
    priced = rows.groupBy(month).agg(
        F.sum("l_extendedprice").alias("original"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("refresh"),
        F.sum("l_quantity").alias("units"),
    )
    names = ("original", "refresh", "units")
    observed = priced.select(
        "period", F.explode(F.array(*[F.struct(F.lit(n).alias("source"), F.col(n).alias("value")) for n in names])).alias("s")
    ).select("s.source", "period", "s.value")
    later = F.concat(F.col("source"), F.lit(" later"))
    beyond = observed.filter((F.col("source") == "units") & (F.col("period") >= _ISSUED)).withColumn("source", later)
    newest = spark.createDataFrame(
        [("original", "2001-01-05"), ("refresh", "2001-12-01"), ("units", "2001-12-05"), ("units later", "2001-12-06")],
        "source string, created_at string",
    ).withColumn("created_at", F.col("created_at").cast("date"))
    return scoring.weigh_sources(history, observed.unionByName(beyond)), newest


@query(
    "source_disagreement",
    "source:str shared:int disagreement:6 verdict:str",
    f"""WITH m AS (SELECT {trunc_sql('l_shipdate', MONTHLY)} AS period, SUM(l_extendedprice) AS original,
          SUM(l_extendedprice * (1 - l_discount)) AS refresh, SUM(l_quantity) AS units FROM lineitem GROUP BY 1),
      h AS (SELECT * FROM m WHERE period < DATE '{_ISSUED}'),
      g AS (SELECT COUNT(*) AS c, SUM(original) AS o, SUM(refresh) AS r, SUM(units) AS u, SUM(abs(original - refresh)) AS gr,
        SUM(abs(original - units)) AS gu FROM h)
      SELECT 'original' AS source, c AS shared, 0.0 AS disagreement, 'agrees' AS verdict FROM g
      UNION ALL SELECT 'refresh', c, gr / LEAST(o, r), CASE WHEN gr / LEAST(o, r) < 1 THEN 'agrees' ELSE 'contradicts' END FROM g
      UNION ALL SELECT 'units', c, gu / LEAST(o, u), CASE WHEN gu / LEAST(o, u) < 1 THEN 'agrees' ELSE 'contradicts' END FROM g
      UNION ALL SELECT 'units later', 0, NULL, 'unproven'""",
)
def source_disagreement(spark, folder):
    return _sources(spark, folder)[0]


# ---- The log of actuals ------------------------------------------------------
_LOG = f"""log AS (SELECT series_key, target_date, value, CAST(target_date + INTERVAL 1 MONTH AS DATE) + CAST(k * 10 AS INTEGER) AS revised_at FROM (
      SELECT '{{"flag":"' || l_returnflag || '","supplier":"' || l_suppkey || '"}}' AS series_key, {trunc_sql('l_shipdate', MONTHLY)} AS target_date,
        k, SUM(CASE WHEN l_linenumber <= 2 * k THEN l_quantity ELSE 0 END) AS value
      FROM lineitem, (SELECT unnest([1, 2, 3, 4]) AS k) ks GROUP BY ALL))"""


def actuals_log(spark, folder):
    """Four reports of every month: lines come in two by two."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("flag"),
        F.col("l_suppkey").alias("supplier"),
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("target_date"),
        "l_linenumber",
        "l_quantity",
    )
    reports = [F.sum(F.when(F.col("l_linenumber") <= 2 * k, F.col("l_quantity")).otherwise(0.0)) for k in (1, 2, 3, 4)]
    summed = rows.groupBy("flag", "supplier", "target_date").agg(F.array(*reports).alias("r"))
    return summed.select(
        scoring.series_key(["supplier", "flag"]).alias("series_key"),
        "target_date",
        F.posexplode("r").alias("k", "value"),
    ).select("series_key", "target_date", "value", F.date_add(F.add_months("target_date", 1), (F.col("k") + 1) * 10).alias("revised_at"))


_MOMENT = "2001-03-15"


@query(
    "actuals_as_of",
    "series_key:str target_date:date value:1 revised_at:date",
    f"""WITH {_LOG} SELECT series_key, target_date, arg_max(value, revised_at) AS value, MAX(revised_at) AS revised_at
      FROM log WHERE revised_at <= DATE '{_MOMENT}' GROUP BY ALL""",
)
def actuals_as_of(spark, folder):
    return scoring.as_of(actuals_log(spark, folder), F.lit(_MOMENT).cast("date"))


@query(
    "changed_readings",
    "series_key:str target_date:date value:1",
    f"""WITH {_LOG}, held AS (SELECT series_key, target_date, arg_max(value, revised_at) AS value FROM log WHERE revised_at <= DATE '{_MOMENT}' GROUP BY ALL),
      final AS (SELECT series_key, target_date, arg_max(value, revised_at) AS value FROM log GROUP BY ALL)
      SELECT final.* FROM final LEFT JOIN held USING (series_key, target_date) WHERE held.value IS DISTINCT FROM final.value""",
)
def changed_readings(spark, folder):
    log = actuals_log(spark, folder)
    latest = scoring.as_of(log).drop("revised_at")
    seen = log.filter(F.col("revised_at") <= _MOMENT)
    return scoring.changed_readings(latest, seen, F.lit("2001-12-31").cast("date"))


@query(
    "restated_since",
    "series_key:str target_date:date",
    f"WITH {_LOG} SELECT DISTINCT series_key, target_date FROM log WHERE revised_at > DATE '{_MOMENT}'",
)
def restated_since(spark, folder):
    return scoring.restated_since(actuals_log(spark, folder), F.lit(_MOMENT).cast("date"))


# ---- Accuracy ------------------------------------------------------------------
@query(
    "accuracy_by_horizon",
    "run_id:str step:int wape:4 bias_pct:4 observations:int",
    f"""WITH {RUNS} SELECT run_id, dense_rank() OVER (PARTITION BY run_id ORDER BY period) AS step,
        SUM(abs(actual - forecast)) / NULLIF(SUM(abs(actual)), 0) * 100 AS wape,
        SUM(forecast - actual) / NULLIF(SUM(abs(actual)), 0) * 100 AS bias_pct, COUNT(*) AS observations
      FROM graded WHERE level = 2 GROUP BY run_id, period""",
)
def accuracy_by_horizon(spark, folder):
    return report.by_horizon(graded_points(spark, folder).filter("level = 2"))


_CLASSES = """pat AS (SELECT run_id, label, COUNT(*) AS n, COUNT(*) FILTER (WHERE value > 0) AS hits, AVG(value) FILTER (WHERE value > 0) AS m,
      stddev_samp(value) FILTER (WHERE value > 0) AS sd FROM lv WHERE level = 2 AND period < DATE '2001-01-01' GROUP BY ALL),
    cls AS (SELECT run_id, label, CASE WHEN hits < 2 THEN 'no_demand' WHEN n / hits >= 1.32 AND (sd / m) ** 2 >= 0.49 THEN 'lumpy'
      WHEN n / hits >= 1.32 THEN 'intermittent' WHEN (sd / m) ** 2 >= 0.49 THEN 'erratic' ELSE 'smooth' END AS demand_class FROM pat)"""


@query(
    "accuracy_by_class",
    "demand_class:str wape:4 series:int point_forecast_claimed:bool",
    f"""WITH {RUNS}, {_CLASSES}, sc AS (SELECT run_id, label, SUM(abs(actual - forecast)) / NULLIF(SUM(abs(actual)), 0) * 100 AS wmape
        FROM graded WHERE level = 2 GROUP BY ALL)
      SELECT demand_class, AVG(wmape) AS wape, COUNT(*) AS series, demand_class <> 'lumpy' AS point_forecast_claimed
      FROM sc JOIN cls USING (run_id, label) GROUP BY demand_class""",
)
def accuracy_by_class(spark, folder):
    from tidemark.operators.diagnostics import demand_pattern

    key = F.concat_ws("/", "run_id", "label").alias("series_id")
    past = _levels(spark, folder).filter((F.col("level") == 2) & (F.col("period") < _ISSUED))
    classes = demand_pattern(past.select(key, F.col("value").alias("y")))
    scores = scoring.series_scores(graded_points(spark, folder).filter("level = 2"), ["run_id", "label"])
    return report.by_demand_class(scores.withColumn("series_id", key), classes)


@query(
    "realised_coverage",
    "step:int observed:6 gap_pp:4 n_observations:int measurable:bool holds:bool",
    f"""WITH {RUNS}, st AS (SELECT *, dense_rank() OVER (ORDER BY period) AS s FROM graded WHERE level = 2)
      SELECT s AS step, AVG(CAST(actual BETWEEN lower - 1e-9 AND upper + 1e-9 AS INTEGER)) AS observed,
        (AVG(CAST(actual BETWEEN lower - 1e-9 AND upper + 1e-9 AS INTEGER)) - 0.8) * 100 AS gap_pp, COUNT(*) AS n_observations,
        COUNT(*) >= 8 AS measurable, abs(AVG(CAST(actual BETWEEN lower - 1e-9 AND upper + 1e-9 AS INTEGER)) - 0.8) * 100 <= 5 AS holds
      FROM st GROUP BY s""",
)
def realised_coverage(spark, folder):
    return report.realised_coverage(graded_points(spark, folder).filter("level = 2"), 0.8)


@query(
    "headline_accuracy",
    "accuracy_pct:4 runs_scored:int periods_scored:int publishable:bool",
    f"""WITH {RUNS}, {_CARD} SELECT GREATEST(0, 100 - SUM(wmape * scored_periods) / SUM(scored_periods)) AS accuracy_pct, COUNT(*) AS runs_scored,
        SUM(scored_periods) AS periods_scored, COUNT(*) >= 3 AND SUM(scored_periods) >= 26 AS publishable FROM cards WHERE scored_periods > 0""",
)
def headline_accuracy(spark, folder):
    return report.headline(run_cards(spark, folder))


@query(
    "accuracy_report",
    "section:str item:str value:4 observations:int",
    f"""WITH {RUNS}, {_CLASSES}, t AS (SELECT * FROM graded WHERE level = 2), st AS (SELECT *, dense_rank() OVER (ORDER BY period) AS s FROM t),
      sc AS (SELECT run_id, label, SUM(abs(actual - forecast)) / NULLIF(SUM(abs(actual)), 0) * 100 AS wmape FROM t GROUP BY ALL)
      SELECT 'by_horizon' AS section, CAST(s AS VARCHAR) AS item, SUM(abs(actual - forecast)) / SUM(abs(actual)) * 100 AS value, COUNT(*) AS observations FROM st GROUP BY s
      UNION ALL SELECT 'by_class', demand_class, AVG(wmape), COUNT(*) FROM sc JOIN cls USING (run_id, label) GROUP BY demand_class
      UNION ALL SELECT 'coverage', CAST(s AS VARCHAR), AVG(CAST(actual BETWEEN lower - 1e-9 AND upper + 1e-9 AS INTEGER)), COUNT(*) FROM st GROUP BY s
      UNION ALL SELECT 'value_add', 'seasonal_naive', (b - a) / abs(b) * 100, 1 FROM (SELECT SUM(abs(actual - forecast)) AS a, SUM(abs(actual - forecast * 1.2)) AS b FROM t)""",
)
def accuracy_report(spark, folder):
    """All regions as one run; the baseline is the same forecast a fifth higher."""
    graded = graded_points(spark, folder).filter("level = 2").withColumn("all", F.lit("all"))
    added = graded.agg(
        F.sum(F.abs(F.col("actual") - F.col("forecast"))).alias("a"),
        F.sum(F.abs(F.col("actual") - F.col("forecast") * 1.2)).alias("b"),
    ).select(F.lit("seasonal_naive").alias("model"), metrics.value_add(F.col("a"), F.col("b")).alias("value_add"))
    return report.accuracy_report(
        report.by_horizon(graded, ("all",)), accuracy_by_class(spark, folder), realised_coverage(spark, folder), added
    )


# ---- Breakdowns, dashboard, lists ----------------------------------------------
_BREAKDOWN = f"""{RUNS}, bd AS (SELECT run_id, split_part(label, ' · ', 1) AS label, SUM(forecast_total) AS forecast, SUM(prior_total) AS prior,
      SUM(actual_total) AS actual, SUM(CASE WHEN wmape IS NOT NULL THEN abs(forecast_total) END) AS w, SUM(wmape * abs(forecast_total)) AS e FROM leaf GROUP BY ALL),
    bds AS (SELECT run_id, label, forecast, round(forecast / SUM(forecast) OVER (PARTITION BY run_id) * 100, 2) AS share, prior,
      round((forecast - prior) / abs(prior) * 100, 2) AS change, round(GREATEST(0, 100 - e / w), 2) AS accuracy, COALESCE(w > 0, false) AS accuracy_measured, actual FROM bd)"""


def _breakdown(spark, folder):
    return report.breakdown(leaf_series(spark, folder), F.col("path")[0])


@query(
    "breakdown",
    "run_id:str label:str forecast:2 share:1 prior:2 change:1 accuracy:1 accuracy_measured:bool actual:2",
    f"WITH {_BREAKDOWN} SELECT * FROM bds",
)
def breakdown(spark, folder):
    return _breakdown(spark, folder)


@query(
    "breakdown_search",
    "run_id:str label:str change:1",
    f"WITH {_BREAKDOWN} SELECT run_id, label, change FROM bds WHERE contains(lower(label), '_1')",
)
def breakdown_search(spark, folder):
    return report.sorted_breakdown(_breakdown(spark, folder), "change", " _1 ")


@query(
    "dashboard_totals",
    "run_id:str forecast_total:2 best_total:2 worst_total:2 actual_ytd:2 prior_ytd:2 direction:str tone:str delta:2",
    f"""WITH {RUNS}, f AS (SELECT run_id, SUM(forecast) AS forecast_total, SUM(best_case) AS best_total, SUM(worst_case) AS worst_total
        FROM fp WHERE level = 0 AND period BETWEEN DATE '2001-02-01' AND DATE '2001-09-30' GROUP BY 1),
      a AS (SELECT run_id, SUM(value) FILTER (WHERE year(period) = 2000) AS actual_ytd, SUM(value) FILTER (WHERE year(period) = 1999) AS prior_ytd
        FROM lv WHERE level = 0 GROUP BY 1),
      d AS (SELECT *, (actual_ytd - prior_ytd) / abs(prior_ytd) * 100 AS delta FROM f JOIN a USING (run_id))
      SELECT *, CASE WHEN abs(delta) < 0.05 THEN 'flat' WHEN delta > 0 THEN 'up' ELSE 'down' END AS direction,
        CASE WHEN abs(delta) < 0.05 THEN 'neutral' WHEN delta > 0 THEN 'positive' ELSE 'negative' END AS tone FROM d""",
)
def dashboard_totals(spark, folder):
    top = issued_points(spark, folder).filter("level = 0").withColumn("actual", F.lit(None).cast("double"))
    past = _levels(spark, folder).filter((F.col("level") == 0) & (F.col("period") < _ISSUED))
    known = past.select("run_id", "period", F.lit("actual").alias("kind"), F.col("value").alias("actual"))
    points = top.select("run_id", "period", "kind", "actual", "forecast", "best_case", "worst_case").unionByName(
        known, allowMissingColumns=True
    )
    extent = known.groupBy("run_id").agg(F.min("period").alias("history_start"), F.max("period").alias("history_end"))
    totals = report.dashboard_totals(points, extent, start="2001-02-01", end="2001-09-30")
    return totals.withColumns(report.kpi_delta(F.col("actual_ytd"), F.col("prior_ytd")))


def _runs(spark, folder):
    """One row per run, with a status and completion day from its region's key."""
    key = F.col("r_regionkey")
    regions = table(spark, folder, "region").select(
        F.col("r_name").alias("run_id"),
        F.when(key == 2, "failed").when(key == 3, "running").otherwise("completed").alias("status"),
        F.lit("sales").alias("dataset_id"),
        F.date_add(F.lit("2001-01-02").cast("date"), key).alias("completed_at"),
        F.lit("2001-12-31").cast("date").alias("forecast_end"),
    )
    return regions.join(run_cards(spark, folder), "run_id", "left")


_RUN_ROWS = f"""{RUNS}, {_CARD}, runs AS (SELECT r_name AS run_id, CASE r_regionkey WHEN 2 THEN 'failed' WHEN 3 THEN 'running' ELSE 'completed' END AS status,
      DATE '2001-01-02' + r_regionkey AS completed_at, cards.* EXCLUDE (run_id) FROM region LEFT JOIN cards ON r_name = run_id),
    mon AS (SELECT *, CASE WHEN status = 'failed' THEN 'failed' WHEN status = 'running' THEN 'active'
        WHEN abs(tracking_signal) > 4 OR wmape > 50 THEN 'drift' WHEN wmape < 100 AND 100 - wmape < 80 THEN 'low_accuracy'
        WHEN COALESCE(scored_periods, 0) = 0 THEN 'unscored' END AS alert FROM runs)"""


@query(
    "run_monitor",
    "run_id:str status:str alert:str alert_level:str",
    f"""WITH {_RUN_ROWS} SELECT run_id, status, alert, CASE alert WHEN 'failed' THEN 'critical' WHEN 'active' THEN 'info'
      WHEN 'drift' THEN 'warning' WHEN 'low_accuracy' THEN 'warning' WHEN 'unscored' THEN 'warning' END AS alert_level FROM mon""",
)
def run_monitor(spark, folder):
    return report.monitor(_runs(spark, folder), F.lit("2002-01-31").cast("date"))


@query(
    "monitor_counts",
    "total:int healthy:int attention:int failed:int active:int",
    f"""WITH {_RUN_ROWS} SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE alert IS NULL) AS healthy,
      COUNT(*) FILTER (WHERE alert IN ('drift', 'low_accuracy', 'unscored')) AS attention, COUNT(*) FILTER (WHERE status = 'failed') AS failed,
      COUNT(*) FILTER (WHERE status = 'running') AS active FROM mon""",
)
def monitor_counts(spark, folder):
    return report.monitor_counts(report.monitor(_runs(spark, folder), F.lit("2002-01-31").cast("date")))


@query(
    "run_status_counts",
    "status:str runs:int",
    "SELECT CASE r_regionkey WHEN 2 THEN 'failed' WHEN 3 THEN 'running' ELSE 'completed' END AS status, COUNT(*) AS runs FROM region GROUP BY 1",
)
def run_status_counts(spark, folder):
    return report.status_counts(_runs(spark, folder))


@query(
    "series_page",
    "label:str forecast_total:2 wmape:4",
    f"WITH {RUNS} SELECT label, forecast_total, wmape FROM leaf WHERE contains(lower(label), 'supplier') ORDER BY wmape IS NULL, abs(forecast_total) * wmape DESC, label LIMIT 20 OFFSET 5",
)
def series_page(spark, folder):
    return report.series_list(leaf_series(spark, folder), term="Supplier", limit=20, offset=5)


_RUN_ROWS = """job AS (SELECT o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS created_at, o_orderpriority AS name, o_custkey % 50 AS series,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_totalprice AS bytes FROM orders)"""


def _run_rows(spark, folder):
    """Orders stand for runs: placed on a day, done, at work or failed."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").cast("date").alias("created_at"),
        F.col("o_orderpriority").alias("name"),
        (F.col("o_custkey") % 50).alias("series"),
        status.alias("status"),
        F.col("o_totalprice").alias("bytes"),
    )


@query(
    "run_list",
    "run_id:int created_at:date name:str series:int",
    f"WITH {_RUN_ROWS} SELECT run_id, created_at, name, series FROM job WHERE status = 'running' AND contains(lower(name), 'high') ORDER BY series DESC, run_id DESC LIMIT 30 OFFSET 10",
)
def run_list(spark, folder):
    runs = report.in_state(_run_rows(spark, folder), "active")
    return report.listed(runs, report.RUN_ORDERS, "run_id", sort="series", term=" High ", limit=30, offset=10)


@query(
    "run_states",
    "all:int completed:int active:int failed:int",
    f"""WITH {_RUN_ROWS} SELECT COUNT(*) AS "all", COUNT(*) FILTER (WHERE status = 'completed') AS completed,
      COUNT(*) FILTER (WHERE status IN ('pending', 'running')) AS active, COUNT(*) FILTER (WHERE status = 'failed') AS failed FROM job""",
)
def run_states(spark, folder):
    return report.run_states(_run_rows(spark, folder))


@query(
    "dataset_list",
    "run_id:int name:str bytes:2",
    f"WITH {_RUN_ROWS} SELECT run_id, name, bytes FROM job ORDER BY bytes ASC, run_id DESC LIMIT 300",
)
def dataset_list(spark, folder):
    """A page longer than the usual one, smallest first."""
    return report.listed(_run_rows(spark, folder), report.DATASET_ORDERS, "run_id", sort="size_asc", limit=300)


@query(
    "stored_top_line",
    "run_id:str period:date forecast:2 total:2",
    f"WITH {RUNS} SELECT run_id, period, forecast, SUM(forecast) OVER (PARTITION BY run_id) AS total FROM fp WHERE level = 0",
)
def stored_top_line(spark, folder):
    """The total's path and sum, read back from the stored points."""
    path = scratch_path(spark, "stored")
    issued_points(spark, folder).drop("path").write.parquet(path)
    line = report.top_line(store.read_table(spark, path))
    return line.join(line.groupBy("run_id").agg(F.sum("forecast").alias("total")), "run_id")


@query(
    "worst_at_risk",
    "label:str value_at_risk:2",
    f"WITH {RUNS} SELECT label, abs(forecast_total) * wmape / 100 AS value_at_risk FROM leaf ORDER BY value_at_risk DESC NULLS LAST, label LIMIT 5",
)
def worst_at_risk(spark, folder):
    return report.worst_at_risk(leaf_series(spark, folder))


def _metrics(spark, folder):
    cards = run_cards(spark, folder)
    names = ("wmape", "mae", "bias", "coverage", "forecast_total")
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    return cards.select("run_id", F.explode(pairs).alias("m")).select("run_id", "m.*")


_METRICS = f"""{RUNS}, {_CARD}, metrics AS (SELECT run_id, 'wmape' AS name, wmape AS value FROM cards UNION ALL SELECT run_id, 'mae', mae FROM cards
    UNION ALL SELECT run_id, 'bias', bias FROM cards UNION ALL SELECT run_id, 'coverage', coverage FROM cards UNION ALL SELECT run_id, 'forecast_total', forecast_total FROM cards)"""


@query(
    "compare_runs",
    "name:str left:3 right:3 delta:3 delta_pct:1",
    f"""WITH {_METRICS}, l AS (SELECT * FROM metrics WHERE run_id = 'ASIA' AND name <> 'bias'), r AS (SELECT * FROM metrics WHERE run_id = 'EUROPE')
      SELECT name, l.value AS "left", r.value AS "right", round(r.value - l.value, 4) AS delta,
        CASE WHEN l.value <> 0 THEN round((r.value - l.value) / abs(l.value) * 100, 2) END AS delta_pct FROM l FULL JOIN r USING (name)""",
)
def compare_runs(spark, folder):
    held = _metrics(spark, folder).filter(~((F.col("run_id") == "ASIA") & (F.col("name") == "bias")))
    return report.compare_runs(held, "ASIA", "EUROPE")


@query(
    "previous_run_metrics",
    "run_id:str previous_run:str name:str value:3 previous_value:3 delta:3",
    f"""WITH {_METRICS}, done AS (SELECT r_name AS run_id, lag(r_name) OVER (ORDER BY r_regionkey) AS previous_run FROM region WHERE r_regionkey NOT IN (2, 3))
      SELECT m.run_id, previous_run, m.name, m.value, p.value AS previous_value, m.value - p.value AS delta FROM metrics m JOIN done USING (run_id)
      LEFT JOIN metrics p ON p.run_id = previous_run AND p.name = m.name""",
)
def previous_run_metrics(spark, folder):
    return report.previous_metrics(_runs(spark, folder), _metrics(spark, folder))


@query(
    "export_points",
    "run_id:str series:str period:date forecast:2 lower:2 upper:2",
    f"WITH {RUNS} SELECT run_id, label AS series, period, forecast, lower, upper FROM fp",
)
def export_points(spark, folder):
    key = F.when(F.col("level") > 0, F.concat_ws("/", "run_id", "label"))
    points = issued_points(spark, folder).withColumn("series_id", key)
    series = points.filter("level > 0").select("series_id", "label").distinct()
    return report.export_points(points.drop("label", "path"), series)


@query(
    "export_series",
    "series:str forecast:2 wmape_pct:4 value_at_risk:2 measured:bool",
    f"WITH {RUNS} SELECT label AS series, forecast_total AS forecast, wmape AS wmape_pct, abs(forecast_total) * wmape / 100 AS value_at_risk, wmape IS NOT NULL AS measured FROM leaf",
)
def export_series(spark, folder):
    return report.export_series(leaf_series(spark, folder))


@query(
    "graded_periods",
    "run_id:str period:date forecast:2 actual:2 miss:2",
    f"WITH {RUNS} SELECT run_id, period, forecast, actual, forecast - actual AS miss FROM graded WHERE level = 0",
)
def graded_periods(spark, folder):
    return scoring.graded_periods(graded_points(spark, folder).filter("level = 0"))


# ---- Decisions, insights, scenarios ----------------------------------------------
def _facts(spark, folder):
    return run_cards(spark, folder).select("run_id", (100 - F.col("wmape")).alias("accuracy"), "bias", "wmape", "coverage")


def _decision(spark, folder):
    leaves = leaf_series(spark, folder)
    risk = leaves.select("run_id", "label", report.value_at_risk(F.col("forecast_total"), F.col("wmape")).alias("risk"))
    return decisions.decide(
        issued_points(spark, folder).filter("level = 0"), _facts(spark, folder), risk, level=0.8
    )


_DECIDE = f"""{RUNS}, {_CARD}, pts AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY period) AS s, (upper - lower) / abs(forecast) <= 0.6 AS good FROM fp WHERE level = 0),
    base AS (SELECT run_id, SUM(forecast) AS base, SUM(lower) AS "commit", SUM(upper) AS prepare, SUM(worst_case) AS worst, COUNT(*) AS periods,
        COALESCE(MIN(CASE WHEN NOT good THEN s END) - 1, COUNT(*)) AS reliable FROM pts GROUP BY 1),
    risk AS (SELECT run_id, label, abs(forecast_total) * wmape / 100 AS risk FROM leaf WHERE abs(forecast_total) * wmape > 0),
    runsum AS (SELECT *, SUM(risk) OVER w AS upto, SUM(risk) OVER (PARTITION BY run_id) AS total, row_number() OVER w AS pos,
        COUNT(*) OVER (PARTITION BY run_id) AS members FROM risk WINDOW w AS (PARTITION BY run_id ORDER BY risk DESC, label ROWS UNBOUNDED PRECEDING)),
    conc AS (SELECT run_id, members, MIN(pos) AS leaders, arg_min(upto / total * 100, pos) AS share FROM runsum WHERE upto >= total * 0.5 GROUP BY ALL),
    dec AS (SELECT base.*, base - worst AS exposure, (base - worst) / abs(base) * 100 AS downside_pct, abs(prepare - "commit") / abs(base) * 100 AS spread_pct,
        (SELECT MAX(period) FROM pts WHERE pts.run_id = base.run_id AND s = reliable) AS through, reliable = periods AS covers_run, members, leaders, share,
        members > 1 AND leaders < members AND share / 100 >= 2.0 * leaders / members AS lopsided,
        CASE WHEN 100 - wmape >= 75 THEN 'plannable' WHEN 100 - wmape >= 55 THEN 'directional' ELSE 'indicative' END AS grade,
        CASE WHEN abs(bias) >= wmape * 0.5 THEN bias END AS lean_pct, coverage + 1e-9 >= 80 AS interval_held
      FROM base LEFT JOIN cards USING (run_id) LEFT JOIN conc USING (run_id))"""


@query(
    "decisions",
    "run_id:str grade:str commit:2 base:2 prepare:2 exposure:2 downside_pct:4 spread_pct:4 reliable:int through:date covers_run:bool "
    "leaders:int members:int share:4 lopsided:bool lean_pct:4",
    f"WITH {_DECIDE} SELECT * FROM dec",
)
def decide(spark, folder):
    return _decision(spark, folder)


@query(
    "decision_actions",
    "run_id:str urgency:int headline:str",
    f"""WITH {_DECIDE}, acts AS (
        SELECT run_id, 0 AS urgency, 'Correct the plan ' || printf('%.1f', abs(lean_pct)) || '% ' || CASE WHEN lean_pct > 0 THEN 'down' ELSE 'up' END AS headline FROM dec WHERE lean_pct IS NOT NULL
        UNION ALL SELECT run_id, 1, 'Do not set targets from this run' FROM dec WHERE grade = 'indicative'
        UNION ALL SELECT run_id, 2, 'Commit at the total, not period by period' FROM dec WHERE grade = 'directional'
        UNION ALL SELECT run_id, 3, CASE WHEN reliable > 0 THEN 'Re-forecast before month ' || CAST(reliable + 1 AS BIGINT) ELSE 'Re-forecast before committing' END FROM dec WHERE NOT covers_run
        UNION ALL SELECT run_id, 4, 'Hold cover for a ' || printf('%.0f', downside_pct) || '% shortfall' FROM dec WHERE downside_pct >= 5
        UNION ALL SELECT run_id, 5, 'Start with ' || leaders || ' of ' || members || ' series' FROM dec WHERE lopsided
        UNION ALL SELECT run_id, 6, 'Widen the range you plan against' FROM dec WHERE NOT interval_held)
      SELECT * FROM acts UNION ALL SELECT run_id, 9, 'Commit to the plan as it stands' FROM dec WHERE run_id NOT IN (SELECT run_id FROM acts)""",
)
def decision_actions(spark, folder):
    return decisions.actions(_decision(spark, folder), MONTHLY)


@query(
    "concentration",
    "l_returnflag:str leaders:int members:int share:5 lopsided:bool",
    """WITH r AS (SELECT l_returnflag, CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) || '-' || l_partkey AS label, l_extendedprice * l_discount AS risk FROM lineitem WHERE l_extendedprice * l_discount > 0),
      s AS (SELECT *, SUM(risk) OVER w AS upto, SUM(risk) OVER (PARTITION BY l_returnflag) AS total, row_number() OVER w AS pos, COUNT(*) OVER (PARTITION BY l_returnflag) AS members
        FROM r WINDOW w AS (PARTITION BY l_returnflag ORDER BY risk DESC, label ROWS UNBOUNDED PRECEDING)),
      c AS (SELECT l_returnflag, members, MIN(pos) AS leaders, arg_min(upto / total * 100, pos) AS share FROM s WHERE upto >= total * 0.5 GROUP BY ALL)
      SELECT *, members > 1 AND leaders < members AND share / 100 >= 2.0 * leaders / members AS lopsided FROM c""",
)
def concentration(spark, folder):
    risk = table(spark, folder, "lineitem").select(
        "l_returnflag",
        F.concat_ws("-", F.col("l_orderkey") * 8 + F.col("l_linenumber"), "l_partkey").alias("label"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("risk"),
    )
    return decisions.concentration(risk, ["l_returnflag"])


def _insight_tables(spark, folder):
    points = issued_points(spark, folder).filter("level = 0")
    totals = points.groupBy("run_id").agg(F.sum("forecast").alias("base"), F.sum("worst_case").alias("worst"))
    # The year in hand against the year before it stands in for the horizon.
    past = _levels(spark, folder).filter("level = 0")
    trailing = past.groupBy("run_id").agg(F.sum(F.when(F.year("period") == 1999, F.col("value"))).alias("trailing_total"))
    accuracy = run_cards(spark, folder).select("run_id", (100 - F.col("wmape")).alias("accuracy"))
    before = accuracy.select(F.col("accuracy").alias("previous_accuracy"), "run_id").filter("run_id IN ('AFRICA')")
    facts = totals.join(trailing, "run_id").join(accuracy, "run_id", "left").join(
        before.withColumn("previous_accuracy", F.col("previous_accuracy") - 5), "run_id", "left"
    )
    history = past.filter(F.col("period") < _ISSUED)
    lagged = history.select("run_id", F.add_months("period", 12).alias("period"), F.col("value").alias("fitted"))
    fitted = history.select("run_id", "period", F.col("value").alias("actual")).join(lagged, ["run_id", "period"])
    segments = _breakdown(spark, folder)
    impact = segments.select(
        "run_id", F.col("label").alias("driver"), (F.col("forecast") - F.col("prior")).alias("impact_value"), F.col("change").alias("impact_pct")
    )
    return {"facts": facts, "points": points, "fitted": fitted, "regions": segments, "categories": segments, "drivers": impact}


@query(
    "insights",
    "run_id:str type:str severity:str title:str metric_name:str metric_value:1 weight:0 rank:int",
    f"""WITH {_BREAKDOWN}, {_CARD},
      facts AS (SELECT f.run_id, base, worst, trailing_total, 100 - wmape AS accuracy, CASE WHEN f.run_id = 'AFRICA' THEN 100 - wmape - 5 END AS previous_accuracy
        FROM (SELECT run_id, SUM(forecast) AS base, SUM(worst_case) AS worst FROM fp WHERE level = 0 GROUP BY 1) f
        JOIN (SELECT run_id, SUM(value) AS trailing_total FROM lv WHERE level = 0 AND year(period) = 1999 GROUP BY 1) t USING (run_id) LEFT JOIN cards USING (run_id)),
      derived AS (SELECT *, accuracy - previous_accuracy AS d, (base - trailing_total) / abs(trailing_total) * 100 AS gap, (base - worst) / abs(base) * 100 AS down FROM facts),
      z AS (SELECT a.run_id, a.period, (a.value - b.value) / stddev_pop(a.value - b.value) OVER (PARTITION BY a.run_id) AS z, COUNT(*) OVER (PARTITION BY a.run_id) AS n,
          row_number() OVER (PARTITION BY a.run_id ORDER BY a.period DESC) AS back
        FROM lv a JOIN lv b ON a.run_id = b.run_id AND a.level = 0 AND b.level = 0 AND a.period = CAST(b.period + INTERVAL 12 MONTH AS DATE) WHERE a.period < DATE '2001-01-01'),
      an AS (SELECT run_id, arg_max(z, (abs(z), back)) AS z FROM z WHERE n >= 8 AND back <= 6 GROUP BY 1),
      hi AS (SELECT run_id, arg_max(change, (change, label)) AS change FROM bds WHERE change IS NOT NULL GROUP BY 1),
      lo AS (SELECT run_id, arg_max(change, (-change, label)) AS change FROM bds WHERE change IS NOT NULL GROUP BY 1),
      dp AS (SELECT run_id, arg_max(label, (forecast - prior, label)) AS driver, MAX(forecast - prior) AS v, arg_max(change, (forecast - prior, label)) AS pct FROM bds WHERE forecast > prior GROUP BY 1),
      dn AS (SELECT run_id, arg_max(label, (prior - forecast, label)) AS driver, MIN(forecast - prior) AS v, arg_max(change, (prior - forecast, label)) AS pct FROM bds WHERE forecast < prior GROUP BY 1),
      wd AS (SELECT run_id, arg_max(upper - lower, period) / arg_min(upper - lower, period) AS g FROM fp WHERE level = 0 GROUP BY 1 HAVING COUNT(*) >= 3),
      ts AS (SELECT run_id, arg_max(share, (forecast, label)) AS share FROM bds GROUP BY 1),
      alls AS (
        SELECT run_id, 'accuracy_change' AS type, CASE WHEN d IS NULL THEN CASE WHEN accuracy < 80 THEN 'warning' ELSE 'positive' END WHEN d > 0 THEN 'positive' ELSE 'warning' END AS severity,
          CASE WHEN d IS NULL THEN CASE WHEN accuracy < 80 THEN 'Forecast Accuracy Below Target' ELSE 'Strong Forecast Accuracy' END WHEN d > 0 THEN 'Accuracy Improving' ELSE 'Accuracy Degrading' END AS title,
          CASE WHEN d IS NULL THEN 'accuracy' ELSE 'accuracy_delta' END AS metric_name, COALESCE(d, accuracy) AS v, CASE WHEN d IS NULL THEN CASE WHEN accuracy < 80 THEN 70 ELSE 60 END WHEN d > 0 THEN 65 ELSE 75 END AS weight, 0 AS o
          FROM derived WHERE d IS NULL OR abs(d) >= 0.5
        UNION ALL SELECT run_id, 'forecast_gap', CASE WHEN gap > 0 THEN 'positive' ELSE 'warning' END, CASE WHEN gap > 0 THEN 'High Growth Expected' ELSE 'Contraction Expected' END, 'forecast_vs_trailing_pct', gap, 80, 1 FROM derived WHERE abs(gap) >= 5
        UNION ALL SELECT run_id, 'worst_case_risk', CASE WHEN down >= 15 THEN 'critical' ELSE 'warning' END, 'Worst Case Scenario', 'worst_case_downside_pct', down, CASE WHEN down >= 15 THEN 85 ELSE 70 END, 2 FROM derived WHERE down >= 3
        UNION ALL SELECT run_id, 'anomaly', 'warning', 'Anomaly Detected', 'anomaly_z_score', z, 78, 3 FROM an WHERE abs(z) >= 2.5
        UNION ALL SELECT run_id, 'regional_growth', 'positive', 'Top Growth Region', 'region_growth_pct', change, 72, 4 FROM hi WHERE change >= 3
        UNION ALL SELECT run_id, 'category_decline', 'warning', 'Category Decline', 'category_change_pct', change, 74, 5 FROM lo WHERE change <= -3
        UNION ALL SELECT run_id, 'driver_positive', 'positive', 'Top Driver: ' || driver, 'driver_impact', v, 68, 6 FROM dp WHERE abs(pct) >= 5
        UNION ALL SELECT run_id, 'driver_negative', 'warning', 'Largest Drag: ' || driver, 'driver_impact', v, 76, 7 FROM dn WHERE abs(pct) >= 5
        UNION ALL SELECT run_id, 'confidence_widening', 'info', 'Confidence Range Widens Sharply', 'interval_growth_ratio', g, 45, 8 FROM wd WHERE g >= 1.8
        UNION ALL SELECT run_id, 'recommendation', CASE WHEN accuracy < 75 OR down >= 15 THEN 'warning' ELSE 'info' END,
          CASE WHEN accuracy < 75 THEN 'Recommendation: Improve Input Data' WHEN down >= 15 THEN 'Recommendation: Plan for the Downside' ELSE 'Recommendation: Concentrate Investment' END,
          CASE WHEN accuracy < 75 THEN 'accuracy' WHEN down >= 15 THEN 'base_worst_spread_pct' ELSE 'top_region_share_pct' END,
          CASE WHEN accuracy < 75 THEN accuracy WHEN down >= 15 THEN down ELSE share END, CASE WHEN accuracy < 75 THEN 90 WHEN down >= 15 THEN 88 ELSE 55 END, 9 FROM derived JOIN ts USING (run_id)),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY weight + CASE severity WHEN 'critical' THEN 30 WHEN 'warning' THEN 15 WHEN 'positive' THEN 5 ELSE 0 END DESC, o) AS rank FROM alls)
      SELECT run_id, type, severity, title, metric_name, round(v, 2) AS metric_value, weight, rank FROM ranked WHERE rank <= 8""",
)
def insight_rows(spark, folder):
    return insights.generate(_insight_tables(spark, folder))


def _scenarios(spark, folder):
    drivers = _insight_tables(spark, folder)["drivers"].select("run_id", "driver", "impact_pct")
    plans = table(spark, folder, "region").select(
        F.col("r_name").alias("run_id"),
        F.explode(
            F.array(
                F.struct(F.lit("boost").alias("name"), F.lit(1.2).alias("volume"), F.lit(5.0).alias("shift_pct")),
                F.struct(F.lit("cut").alias("name"), F.lit(0.9).alias("volume"), F.lit(-10.0).alias("shift_pct")),
            )
        ).alias("s"),
    ).select("run_id", "s.*")
    levers = scenarios.leverage(drivers)
    multipliers = levers.filter("leverage > 0").select("run_id", "driver", F.lit("boost").alias("name"), F.lit(1.5).alias("multiplier"))
    scaled = scenarios.scenario_scale(plans, multipliers, levers)
    return scenarios.simulate(issued_points(spark, folder).filter("level = 0"), scaled)


_SCENARIO = f"""{_BREAKDOWN}, lev AS (SELECT run_id, GREATEST(0, LEAST(COALESCE(change, 0) / 100, 1)) AS l FROM bds),
    fac AS (SELECT run_id, GREATEST(0, product(1 + l * 0.5)) AS p FROM lev WHERE l > 0 GROUP BY 1),
    sc AS (SELECT r_name AS run_id, 'boost' AS name, 1.2 * 1.05 * COALESCE(p, 1) AS scale FROM region LEFT JOIN fac ON run_id = r_name
      UNION ALL SELECT r_name, 'cut', 0.9 * 0.9 FROM region),
    sim AS (SELECT fp.run_id, name, period, forecast AS baseline, forecast * scale AS simulated, forecast * scale + (lower - forecast) * scale * (1 + 0.5 * abs(scale - 1)) AS lower,
        forecast * scale + (upper - forecast) * scale * (1 + 0.5 * abs(scale - 1)) AS upper, forecast * scale + (best_case - forecast) * scale * (1 + 0.5 * abs(scale - 1)) AS best_case,
        forecast * scale + (worst_case - forecast) * scale * (1 + 0.5 * abs(scale - 1)) AS worst_case FROM fp JOIN sc USING (run_id) WHERE level = 0)"""


@query(
    "what_if",
    "run_id:str name:str period:date baseline:2 simulated:2 lower:2 upper:2 best_case:2 worst_case:2 delta:2 delta_pct:3",
    f"WITH {_SCENARIO} SELECT *, simulated - baseline AS delta, (simulated - baseline) / abs(baseline) * 100 AS delta_pct FROM sim",
)
def what_if(spark, folder):
    return _scenarios(spark, folder)


@query(
    "scenario_totals",
    "run_id:str name:str baseline_total:2 simulated_total:2 best_total:2 worst_total:2 total_delta:2 total_delta_pct:3",
    f"""WITH {_SCENARIO} SELECT run_id, name, SUM(baseline) AS baseline_total, SUM(simulated) AS simulated_total, SUM(best_case) AS best_total, SUM(worst_case) AS worst_total,
      SUM(simulated) - SUM(baseline) AS total_delta, (SUM(simulated) - SUM(baseline)) / abs(SUM(baseline)) * 100 AS total_delta_pct FROM sim GROUP BY ALL""",
)
def scenario_totals(spark, folder):
    return scenarios.scenario_totals(_scenarios(spark, folder))


@query(
    "saved_scenarios",
    "name:str runs:int simulated_total:2",
    f"""WITH {_SCENARIO}, totals AS (SELECT run_id, name, SUM(simulated) AS simulated_total FROM sim GROUP BY ALL)
      SELECT name, COUNT(*) AS runs, SUM(simulated_total) AS simulated_total FROM totals GROUP BY name""",
)
def saved_scenarios(spark, folder):
    """Scenario totals appended under a name and read back by it."""
    path = scratch_path(spark, "scenarios")
    totals = scenarios.scenario_totals(_scenarios(spark, folder))
    store.append_run(totals.withColumnRenamed("name", "scenario"), path, key="scenario")
    kept = store.read_table(spark, path)
    return kept.groupBy(F.col("scenario").alias("name")).agg(
        F.count("*").alias("runs"), F.sum("simulated_total").alias("simulated_total")
    )


# ---- Usage ---------------------------------------------------------------------
_USAGE = """ev AS (SELECT event_id, ts AS created_at, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'rejected' ELSE 'success' END AS status,
    event_type AS model, 'p' || (user_id % 3) AS provider, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, value / 100 AS cost, value AS latency_ms FROM events)"""


def _usage(spark, folder):
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        "event_id",
        F.col("ts").alias("created_at"),
        F.when(kind == "error", "error").when(kind == "signup", "rejected").otherwise("success").alias("status"),
        kind.alias("model"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
        (F.col("value") / 100).alias("cost"),
        F.col("value").alias("latency_ms"),
    )


@query(
    "usage_totals",
    "requests:int successful:int failed:int rejected:int tokens:int cost:4 average_latency_ms:1 p95_latency_ms:2",
    f"""WITH {_USAGE}, r AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS k, COUNT(*) OVER () AS n FROM ev WHERE latency_ms IS NOT NULL)
      SELECT COUNT(*) AS requests, COUNT(*) FILTER (WHERE status = 'success') AS successful, COUNT(*) FILTER (WHERE status = 'error') AS failed,
        COUNT(*) FILTER (WHERE status = 'rejected') AS rejected, SUM(tokens) AS tokens, SUM(cost) AS cost, round(AVG(latency_ms), 2) AS average_latency_ms,
        (SELECT MIN(latency_ms) FROM r WHERE k >= ceil(0.95 * n)) AS p95_latency_ms FROM ev""",
)
def usage_totals(spark, folder):
    return report.usage_totals(_usage(spark, folder))


@query(
    "usage_daily",
    "day:date requests:int successful:int tokens:int",
    f"""WITH {_USAGE}, d AS (SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS requests, COUNT(*) FILTER (WHERE status = 'success') AS successful, SUM(tokens) AS tokens FROM ev GROUP BY 1)
      SELECT c.day, COALESCE(requests, 0) AS requests, COALESCE(successful, 0) AS successful, COALESCE(tokens, 0) AS tokens
      FROM (SELECT DATE '2023-12-28' + CAST(i AS INTEGER) AS day FROM range(40) t(i)) c LEFT JOIN d USING (day)""",
)
def usage_daily(spark, folder):
    return report.usage_daily(_usage(spark, folder), F.lit("2023-12-28").cast("date"), 40)


@query(
    "usage_ranking",
    "provider:str model:str requests:int successful:int tokens:int cost:4 average_latency_ms:1",
    f"""WITH {_USAGE} SELECT provider, model, COUNT(*) AS requests, COUNT(*) FILTER (WHERE status = 'success') AS successful, SUM(tokens) AS tokens,
      SUM(cost) AS cost, round(AVG(latency_ms), 2) AS average_latency_ms FROM ev GROUP BY ALL""",
)
def usage_ranking(spark, folder):
    return report.usage_ranking(_usage(spark, folder), ["provider", "model"])


@query(
    "usage_recent",
    "event_id:int status:str model:str",
    f"WITH {_USAGE} SELECT event_id, status, model FROM ev ORDER BY created_at DESC, event_id DESC LIMIT 50",
)
def usage_recent(spark, folder):
    return report.recent_events(_usage(spark, folder))


# ---- Hierarchy -------------------------------------------------------------------
def _nodes(spark, folder):
    """Path, step, forecast and share of one tree over all regions.

    Levels are region, nation and supplier; supplier forecasts are bent by
    their step so that the children no longer add up.
    """
    points = issued_points(spark, folder)
    path = F.concat(F.array("run_id"), "path")
    bent = F.when(F.col("level") == 2, F.col("forecast") * (1 + F.col("step") / 20)).otherwise(F.col("forecast"))
    placed = points.select(path.alias("path"), "step", bent.alias("forecast"), F.col("forecast").alias("size"))
    steps = points.select("step").distinct().agg(F.array_sort(F.collect_list("step"))).scalar()
    shares = placed.groupBy("path").agg(F.sum("size").alias("size"))
    full = shares.select("path", "size", F.explode(steps).alias("step")).join(placed.drop("size"), ["path", "step"], "left")
    whole = points.filter("level = 0").agg(F.sum("forecast")).scalar()
    nodes = full.withColumn("share", F.col("size") / whole).drop("size")
    total = points.filter("level = 0").groupBy("step").agg((F.sum("forecast") * 1.1).alias("forecast"))
    return nodes, total


_TREE = f"""{RUNS}, pl AS (SELECT CASE level WHEN 0 THEN run_id ELSE run_id || ' · ' || label END AS node, level + 1 AS level, run_id, CASE level WHEN 0 THEN NULL WHEN 1 THEN run_id
        ELSE run_id || ' · ' || split_part(label, ' · ', 1) END AS parent, step, CASE WHEN level = 2 THEN forecast * (1 + step / 20.0) ELSE forecast END AS forecast, forecast AS size FROM fp),
    sh AS (SELECT node, level, parent, SUM(size) / (SELECT SUM(forecast) FROM fp WHERE level = 0) AS share FROM pl GROUP BY ALL),
    st AS (SELECT DISTINCT step FROM fp),
    nd AS (SELECT sh.*, st.step, pl.forecast FROM sh CROSS JOIN st LEFT JOIN pl ON pl.node = sh.node AND pl.step = st.step),
    t0 AS (SELECT step, SUM(forecast) * 1.1 AS total FROM fp WHERE level = 0 GROUP BY step),
    x1 AS (SELECT nd.*, t0.total, GREATEST(COALESCE(forecast, total * share), 0) AS p FROM nd JOIN t0 USING (step) WHERE level = 1),
    r1 AS (SELECT *, CASE WHEN SUM(p) OVER w > 1e-9 THEN p / SUM(p) OVER w ELSE share / SUM(share) OVER w END * total AS rec FROM x1 WINDOW w AS (PARTITION BY step)),
    x2 AS (SELECT nd.*, r1.rec AS total, GREATEST(COALESCE(nd.forecast, r1.rec * nd.share), 0) AS p FROM nd JOIN r1 ON nd.parent = r1.node AND nd.step = r1.step WHERE nd.level = 2),
    r2 AS (SELECT *, CASE WHEN SUM(p) OVER w > 1e-9 THEN p / SUM(p) OVER w ELSE share / SUM(share) OVER w END * total AS rec FROM x2 WINDOW w AS (PARTITION BY parent, step)),
    x3 AS (SELECT nd.*, r2.rec AS total, GREATEST(COALESCE(nd.forecast, r2.rec * nd.share), 0) AS p FROM nd JOIN r2 ON nd.parent = r2.node AND nd.step = r2.step WHERE nd.level = 3),
    r3 AS (SELECT *, CASE WHEN SUM(p) OVER w > 1e-9 THEN p / SUM(p) OVER w ELSE share / SUM(share) OVER w END * total AS rec FROM x3 WINDOW w AS (PARTITION BY parent, step)),
    tree AS (SELECT node, level, step, forecast, rec FROM r1 UNION ALL SELECT node, level, step, forecast, rec FROM r2 UNION ALL SELECT node, level, step, forecast, rec FROM r3)"""


@query(
    "reconcile",
    "level:int node:str step:int forecast:2 reconciled:2",
    f"""WITH {_TREE} SELECT level, node, step, forecast, rec AS reconciled FROM tree
      UNION ALL SELECT 0, 'Total', step, total, total FROM t0""",
)
def reconcile(spark, folder):
    nodes, total = _nodes(spark, folder)
    out = hierarchy.reconcile(nodes, total, 3)
    return out.select(F.size("path").alias("level"), hierarchy.label_of(F.col("path")).alias("node"), "step", "forecast", "reconciled")


@query(
    "rescaled_bands",
    "series_id:str step:int reconciled:2 lower:2 upper:2",
    f"""WITH {_TREE}, lf AS (SELECT node AS series_id, step, forecast, rec, forecast * 0.8 AS lower, forecast * 1.3 AS upper FROM tree WHERE level = 3 AND forecast IS NOT NULL),
      s AS (SELECT *, SUM(forecast) OVER w AS own, SUM(rec) OVER w AS new, MAX(abs(forecast)) OVER w AS top FROM lf WINDOW w AS (PARTITION BY series_id)),
      k AS (SELECT *, top > 0 AND (own = 0 OR (new / own > 0 AND new / own <= 2)) AS holds, CASE WHEN abs(forecast) > top * 1e-6 THEN rec / forecast ELSE 1 END AS scale FROM s)
      SELECT series_id, step, rec AS reconciled, CASE WHEN holds THEN rec + (lower - forecast) * scale END AS lower, CASE WHEN holds THEN rec + (upper - forecast) * scale END AS upper FROM k""",
)
def rescaled_bands(spark, folder):
    nodes, total = _nodes(spark, folder)
    leaves = hierarchy.reconcile(nodes, total, 3).filter((F.size("path") == 3) & F.col("forecast").isNotNull())
    points = leaves.select(
        hierarchy.label_of(F.col("path")).alias("series_id"), "step", "forecast", "reconciled",
        (F.col("forecast") * 0.8).alias("lower"), (F.col("forecast") * 1.3).alias("upper"),
    )
    return hierarchy.rescale_bands(points)


@query(
    "bottom_up",
    "level:int series_id:str ds:date y:2",
    f"""WITH {RUNS} SELECT 1 AS level, region AS series_id, period AS ds, SUM(value) AS y FROM cells GROUP BY ALL
      UNION ALL SELECT 2, region || ' · ' || nation, period, SUM(value) FROM cells GROUP BY ALL""",
)
def bottom_up(spark, folder):
    from tidemark.plans.panels import supplier_panel

    return hierarchy.bottom_up(supplier_panel(spark, folder), 3)


@query(
    "coherence_gap",
    "implied:2 direct:2 gap:6",
    f"""WITH {RUNS}, a AS (SELECT SUM(forecast * (1 + step / 20.0)) AS implied FROM fp WHERE level = 2), b AS (SELECT SUM(forecast) * 1.1 AS direct FROM fp WHERE level = 0)
      SELECT implied, direct, abs(implied - direct) / abs(direct) AS gap FROM a, b""",
)
def coherence_gap(spark, folder):
    nodes, total = _nodes(spark, folder)
    return hierarchy.coherence_gap(nodes.filter(F.size("path") == 3), total)


@query(
    "series_tree",
    "run_id:str level:int label:str parent_label:str forecast_total:2 share:2",
    f"""WITH {RUNS}, n AS (SELECT run_id, level, label, SUM(forecast) AS f FROM fp GROUP BY ALL)
      SELECT n.run_id, n.level, n.label, CASE n.level WHEN 1 THEN 'Total' WHEN 2 THEN split_part(n.label, ' · ', 1) END AS parent_label, n.f AS forecast_total,
        n.f / t.f * 100 AS share FROM n JOIN n t ON t.run_id = n.run_id AND t.level = 0""",
)
def series_tree(spark, folder):
    points = issued_points(spark, folder)
    nodes = points.groupBy("run_id", "level", "label", "path").agg(F.sum("forecast").alias("forecast_total"))
    top = nodes.filter("level = 0").select("run_id", F.col("forecast_total").alias("_top"))
    joined = hierarchy.attach_parents(nodes).join(top, "run_id")
    return joined.withColumn("share", F.col("forecast_total") / F.col("_top") * 100)


@query(
    "segment_comparison",
    "label:str forecast_value:2 change_vs_last_year:1 share:1 accuracy:2 accuracy_measured:bool",
    f"""WITH {RUNS}, n AS (SELECT label, SUM(forecast_total) AS f, SUM(current_total) AS c, SUM(prior_total) AS p, MAX(100 - wmape) AS a FROM leaf GROUP BY label)
      SELECT label, f AS forecast_value, round((c - p) / abs(p) * 100, 2) AS change_vs_last_year, round(f / SUM(f) OVER () * 100, 2) AS share,
        COALESCE(a, 50.0) AS accuracy, a IS NOT NULL AS accuracy_measured FROM n""",
)
def segment_comparison(spark, folder):
    segments = leaf_series(spark, folder).select(
        "label", F.col("forecast_total").alias("forecast_value"), "current_total", "prior_total", (100 - F.col("wmape")).alias("accuracy")
    )
    return hierarchy.segment_comparison(segments, F.lit(50.0))


@query(
    "leaf_shares",
    "label:str share:6",
    f"WITH {RUNS} SELECT label, abs(current_total) / SUM(abs(current_total)) OVER () AS share FROM leaf",
)
def leaf_shares(spark, folder):
    return hierarchy.leaf_shares(leaf_series(spark, folder))


# ---- Text of numbers -----------------------------------------------------------
@query(
    "compact_numbers",
    "l_orderkey:int l_linenumber:int l_partkey:int shown:str",
    """SELECT l_orderkey, l_linenumber, l_partkey, '$' || CASE WHEN v >= 1e6 THEN printf('%.2f', round(v / 1e6, 2)) || 'M' WHEN v >= 1e3 THEN printf('%.1f', round(v / 1e3, 1)) || 'K'
        ELSE printf('%.0f', round_even(v, 0)) END AS shown FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * l_quantity + 0.0001 AS v FROM lineitem)""",
)
def compact_numbers(spark, folder):
    from tidemark.functions.numbers import compact

    rows = table(spark, folder, "lineitem")
    value = F.col("l_extendedprice") * F.col("l_quantity") + F.lit(0.0001)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", compact(value, "$").alias("shown"))


@query(
    "numbers_preserved",
    "doc_id:str numbers:int kept:bool",
    r"""WITH d AS (SELECT doc_id, text, CASE WHEN CAST(doc_id AS BIGINT) % 2 = 0 THEN replace(text, '7', '8') ELSE upper(text) END AS rewritten FROM documents),
      n AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '-?\$?[0-9][0-9,]*\.?[0-9]*[%KMB]?'), lambda x: rtrim(x, '.')))) AS a,
        list_sort(list_distinct(list_transform(regexp_extract_all(rewritten, '-?\$?[0-9][0-9,]*\.?[0-9]*[%KMB]?'), lambda x: rtrim(x, '.')))) AS b FROM d)
      SELECT doc_id, len(a) AS numbers, a = b AS kept FROM n""",
)
def numbers_preserved(spark, folder):
    from tidemark.functions.text import numbers_in, numbers_preserved as same

    docs = table(spark, folder, "documents").select("doc_id", "text")
    even = F.col("doc_id").cast("bigint") % 2 == 0
    rewritten = F.when(even, F.replace("text", F.lit("7"), F.lit("8"))).otherwise(F.upper("text"))
    return docs.select("doc_id", F.size(numbers_in(F.col("text"))).alias("numbers"), same(F.col("text"), rewritten).alias("kept"))

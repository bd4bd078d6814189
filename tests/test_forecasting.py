"""Leakage, calibration, conservation and known answers of the forecasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import month

from tidemark.operators import (
    backtest,
    calendar,
    decisions,
    diagnostics,
    drivers,
    fanout,
    features,
    hierarchy,
    intervals,
    models,
    regression,
    scenarios,
    scoring,
    selection,
    smoothing,
)
from tidemark.constants import SEASON


def panel_of(spark, series):
    rows = [(k, month(i), None if v is None else float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, ds date, y double")


def windows_of(spark, series, horizon=6, **prepared):
    aligned = calendar.align_calendar(panel_of(spark, series), "monthly")
    folds = backtest.fold_rows(backtest.plan_rows(aligned, horizon, "monthly"))
    return backtest.training_windows(folds, season=SEASON["monthly"], **prepared)


def test_training_never_sees_its_test_rows(spark):
    steady = [100.0 + i for i in range(48)]
    spiked = steady[:42] + [1e6] * 6
    options = {"fill": "interpolate", "sigmas": 3.5}
    one = {r["fold"]: r for r in windows_of(spark, {"a": steady}, **options).collect()}
    two = {r["fold"]: r for r in windows_of(spark, {"a": spiked}, **options).collect()}
    assert [one[f]["cut"] for f in range(4)] == [24, 30, 36, 42]
    for fold in range(4):
        assert len(one[fold]["train"]) == one[fold]["cut"]
        assert two[fold]["train"] == one[fold]["train"]
        assert [p["step"] for p in one[fold]["test"]] == [1, 2, 3, 4, 5, 6]
    assert two[3]["test"][0]["y"] == 1e6


def test_a_hole_is_filled_from_the_window_alone(spark):
    values = [10.0 * i for i in range(48)]
    values[35] = None
    rows = {r["fold"]: r for r in windows_of(spark, {"a": values}, fill="interpolate").collect()}
    fold = next(f for f in range(4) if rows[f]["cut"] == 36)
    assert rows[fold]["train"][35] == 340.0
    assert rows[fold + 1]["train"][35] == 350.0


def test_features_do_not_change_when_data_arrives(spark):
    values = [50 + 8 * np.sin(i) + i for i in range(60)]
    built = []
    for n in (40, 60):
        aligned = calendar.align_calendar(panel_of(spark, {"a": values[:n]}), "monthly")
        matrix, names = features.design_matrix(aligned, "monthly", [1, 2, 12], [3, 6], seasonal_delta=12)
        built.append({r["ds"]: tuple(r[n] for n in names) for r in matrix.collect()})
    assert built[0] and all(built[1][day] == row for day, row in built[0].items())


def test_simple_models(spark):
    frame = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "v array<double>")
    row = frame.select(
        models.naive(F.col("v"), 2).alias("n"),
        models.naive(F.col("v"), 2, F.lit(True)).alias("d"),
        models.seasonal_naive(F.col("v"), 4, F.lit(3)).alias("s"),
        models.seasonal_naive(F.col("v"), 2, F.lit(3), F.lit(True)).alias("sd"),
        models.seasonal_naive(F.col("v"), 2, F.lit(7)).alias("short"),
        models.blend([F.array(F.lit(1.0)), F.array(F.lit(4.0))], [F.lit(2.0), F.lit(1.0)]).alias("b"),
    ).first()
    assert row["n"] == [6.0, 6.0] and row["d"] == [7.0, 8.0] and row["s"] == [4.0, 5.0, 6.0, 4.0]
    assert row["sd"] == [5.0, 7.0] and row["short"] is None and row["b"] == [2.0]


def test_croston_matches_the_recursion(spark):
    rng = np.random.default_rng(3)
    values = [float(v) if rng.random() < 0.4 else 0.0 for v in rng.integers(1, 30, 60)]
    fitted = models.add_croston(windows_of(spark, {"a": values}))
    rows = [r for r in fitted.collect() if 0 <= r["fold"] < 5]

    def expected(y):
        at = [i for i, v in enumerate(y) if v > 0]
        sizes, gaps = [y[i] for i in at], np.diff([-1, *at])
        best = None
        for a in models.ALPHAS:
            size, gap, miss = sizes[0], gaps[0], 0.0
            for s, g in zip(sizes[1:], gaps[1:]):
                miss += (s / g - size / gap) ** 2
                size, gap = a * s + (1 - a) * size, a * g + (1 - a) * gap
            if best is None or miss < best[0]:
                best = (miss, size / gap * (1 - a / 2))
        return best[1]

    for row in rows:
        assert row["croston"]["rate"] == pytest.approx(expected(row["train"]))


def test_smoothing_known_answers():
    line = np.arange(40) * 2.0 + 10
    assert smoothing.holt_winters(line, 12, False, True, 3) == pytest.approx([90, 92, 94], rel=0.02)
    season = np.tile([10.0, 20.0, 30.0, 40.0], 12)
    assert smoothing.holt_winters(season, 4, True, False, 4) == pytest.approx([10, 20, 30, 40], rel=0.02)
    assert smoothing.theta(season, 4, True, 4) == pytest.approx([10, 20, 30, 40], rel=0.05)
    assert smoothing.theta(np.full(20, 5.0), 12, False, 2) == pytest.approx([5, 5])
    assert smoothing.holt_winters(np.ones(3), 12, False, False, 2) is None
    assert smoothing.auto_ets(season, 4, True, 4) == pytest.approx([10, 20, 30, 40], rel=0.02)


def test_shape_finds_a_season_and_none_in_noise():
    rng = np.random.default_rng(0)
    t = np.arange(96)
    wave = 100 + 30 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 3, 96)
    found = diagnostics.shape_of(wave, "monthly")
    assert found["period"] == 12 and found["has_season"]
    noise = diagnostics.shape_of(rng.normal(0, 1, 96), "monthly")
    assert not noise["has_season"]
    assert diagnostics.shape_of(t * 3.0 + rng.normal(0, 1, 96), "monthly")["has_trend"]


def test_a_step_is_found_where_it_is(spark):
    rng = np.random.default_rng(1)
    values = [*rng.normal(100, 5, 30), *rng.normal(160, 5, 18)]
    series = diagnostics.compacted(calendar.align_calendar(panel_of(spark, {"a": values}), "monthly"))
    found = diagnostics.changepoints(series).collect()
    assert [r["index"] for r in found] == [30]


def test_conformal_coverage_holds(spark):
    rng = np.random.default_rng(7)
    rows = [(h, 0.0, float(v)) for h in range(1, 6) for v in rng.normal(0, 4 * h, 200)]
    points = spark.createDataFrame(rows, "step int, y_pred double, y_true double")
    widths = intervals.conformal_halfwidths(points, 0.8, keys=())
    values = [r["halfwidth"] for r in widths.orderBy("step").collect()]
    assert values == sorted(values)
    report = intervals.coverage_report(intervals.apply_halfwidths(points, widths, keys=()), 0.8)
    assert report.filter("not holds").count() == 0
    summary = intervals.coverage_summary(report).first()
    assert summary["holds"] and abs(summary["worst_gap_pp"]) <= 5
    beyond = spark.createDataFrame([(9, 1.0)], "step int, y_pred double")
    row = intervals.apply_halfwidths(beyond, widths, keys=()).first()
    assert row["upper"] - row["y_pred"] == pytest.approx(values[-1])


def test_selection_prefers_the_simple_when_equal(spark):
    base = {"rmse": 2.0, "mae": 1.0, "mase": 0.5, "winkler": 4.0, "folds": 5, "n_folds": 5, "n": 200, "failed": False}
    rows = [("a", m, w, *base.values()) for m, w in (("croston", 10.0), ("naive", 10.0), ("theta", 30.0))]
    schema = "series_id string, model string, wmape double, rmse double, mae double, mase double, winkler double, folds int, n_folds int, n int, failed boolean"
    chosen = selection.select_models(spark.createDataFrame(rows, schema), ["naive", "theta", "croston"])
    ranked = {r["model"]: (r["rank"], r["selected"]) for r in chosen.collect()}
    assert ranked["naive"] == (1, True) and ranked["croston"][0] == 2
    assert "so close" in selection.rationale(chosen).first()["rationale"]
    with pytest.raises(ValueError):
        selection.check_weights({"smape": 1.0})
    with pytest.raises(ValueError):
        selection.check_weights({"mae": 0.0})


def test_nothing_scoreable_falls_back_to_the_first(spark):
    schema = "series_id string, model string, wmape double, rmse double, mae double, mase double, winkler double, folds int, n_folds int, n int, failed boolean"
    rows = [("a", "theta", None, None, 1.0, None, None, 1, 5, 40, True), ("a", "naive", None, None, 1.0, None, None, 5, 5, 40, False)]
    chosen = selection.select_models(spark.createDataFrame(rows, schema), ["naive", "theta"])
    assert [r["model"] for r in chosen.filter("selected").collect()] == ["naive"]


def test_every_level_adds_up(spark):
    rows = [(["r1", "a"], 1, 10.0, 0.2), (["r1", "b"], 1, 30.0, 0.3), (["r2", "c"], 1, -5.0, 0.5)]
    rows += [(["r1"], 1, 50.0, 0.5), (["r2"], 1, 20.0, 0.5)]
    nodes = spark.createDataFrame(rows, "path array<string>, step int, forecast double, share double")
    whole = spark.createDataFrame([(1, 100.0)], "step int, forecast double")
    out = hierarchy.reconcile(nodes, whole, 2).collect()
    by_path = {tuple(r["path"]): r["reconciled"] for r in out}
    assert by_path[("r1",)] + by_path[("r2",)] == pytest.approx(100.0)
    assert by_path[("r1", "a")] + by_path[("r1", "b")] == pytest.approx(by_path[("r1",)])
    # A clipped child leaves its parent to the shares.
    assert by_path[("r2", "c")] == pytest.approx(by_path[("r2",)])


def test_leading_driver_is_found(spark):
    rng = np.random.default_rng(5)
    lead = rng.normal(0, 10, 90).cumsum() + 500
    target = [100.0] * 8 + [float(v * 2) for v in lead[:82]]
    rows = [("a", t, 90, float(target[t]), float(lead[t]), float(rng.normal())) for t in range(90)]
    panel = spark.createDataFrame(rows, "series_id string, t int, n int, y double, lead double, noise double")
    found = drivers.leading_drivers(drivers.lag_correlations(panel, ["lead", "noise"], 6, "monthly")).collect()
    assert (found[0]["driver"], found[0]["lag"]) == ("lead", 8) and found[0]["strength"] > 0.95


def test_concentration_on_uneven_and_equal_risk(spark):
    rows = [("u", f"s{i:03d}", 1000.0 if i < 3 else 1.0) for i in range(100)] + [("e", f"s{i:03d}", 2.0) for i in range(100)]
    found = {r["run_id"]: r for r in decisions.concentration(spark.createDataFrame(rows, "run_id string, label string, risk double")).collect()}
    assert (found["u"]["leaders"], found["u"]["lopsided"]) == (2, True)
    assert (found["e"]["leaders"], found["e"]["lopsided"], found["e"]["share"]) == (50, False, 50.0)


def test_a_zero_bound_is_a_bound(spark):
    points = spark.createDataFrame(
        [("r", month(i), 10.0, 0.0, 12.0, 0.0) for i in range(3)],
        "run_id string, period date, forecast double, lower double, upper double, worst_case double",
    )
    facts = spark.createDataFrame([("r", 80.0, None, None, None)], "run_id string, accuracy double, bias double, wmape double, coverage double")
    risk = spark.createDataFrame([("r", "a", 1.0)], "run_id string, label string, risk double")
    row = decisions.decide(points, facts, risk, level=0.8).first()
    assert (row["commit"], row["prepare"], row["grade"], row["reliable"]) == (0.0, 36.0, "plannable", 0)


def test_what_if_widens_around_the_new_point(spark):
    points = spark.createDataFrame(
        [("r", month(0), 100.0, 90.0, 110.0, 115.0, 85.0)],
        "run_id string, period date, forecast double, lower double, upper double, best_case double, worst_case double",
    )
    scaled = spark.createDataFrame([("r", "up", 2.0)], "run_id string, name string, scale double")
    row = scenarios.simulate(points, scaled).first()
    assert (row["simulated"], row["lower"], row["upper"], row["delta_pct"]) == (200.0, 170.0, 230.0, 100.0)


def test_actuals_log_keeps_what_changed(spark):
    log = spark.createDataFrame(
        [("", month(0), 1200.0, month(1)), ("", month(0), 1340.0, month(2))], "series_key string, target_date date, value double, revised_at date"
    )
    moment = lambda day: F.lit(day).cast("date")
    assert scoring.as_of(log, moment("2021-02-15")).first()["value"] == 1200.0
    assert scoring.as_of(log).first()["value"] == 1340.0
    readings = spark.createDataFrame([("", month(0), 1340.0), ("", month(1), 5.0)], "series_key string, target_date date, value double")
    gained = scoring.changed_readings(readings, log, moment("2021-06-01")).collect()
    assert [(r["target_date"], r["value"]) for r in gained] == [(month(1), 5.0)]
    assert scoring.restated_since(log, moment("2021-02-15")).count() == 1


def test_fan_out_routes_and_reports(spark):
    rng = np.random.default_rng(11)
    t = np.arange(60)
    series = {
        "A · steady": 200 + 40 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 4, 60),
        "A · rare": np.where(rng.random(60) < 0.3, rng.integers(1, 9, 60), 0).astype(float),
        "B · short": np.array([5.0, 6.0, 7.0, 6.0, 5.0]),
        "B · once": np.array([3.0]),
    }
    out = fanout.run_fanout(panel_of(spark, series), "monthly", 6, hierarchy_depth=2)
    rows = out.forecasts.collect()
    routes = {r["series_id"]: (r["route"], r["model"]) for r in rows}
    assert routes["A · steady"][0] == "model" and routes["A · rare"] == ("fallback", "croston")
    assert routes["B · short"] == ("fallback", "naive")
    assert len(rows) == 18 and [tuple(r) for r in out.errors.collect()] == [("B · once", "no_history")]
    steady = sorted((r for r in rows if r["series_id"] == "A · steady"), key=lambda r: r["ds"])
    assert all(r["y_lower"] <= r["y"] <= r["y_upper"] for r in steady)
    truth = 200 + 40 * np.sin(2 * np.pi * np.arange(60, 66) / 12)
    assert np.abs(np.array([r["y"] for r in steady]) - truth).mean() < 15
    parents = {(r["series_id"], r["ds"]): r["y"] for r in out.parents.collect()}
    assert parents[("A", steady[0]["ds"])] == pytest.approx(
        sum(r["y"] for r in rows if r["series_id"].startswith("A") and r["ds"] == steady[0]["ds"])
    )


def test_regression_steps_match_the_design_matrix(spark):
    values = {k: [100 * k + 20 * k * np.sin(2 * np.pi * i / 12) for i in range(72)] for k in (1, 2, 3)}
    panel = panel_of(spark, {str(k): v for k, v in values.items()})
    rows, names = regression.training_rows(panel, "monthly")
    assembler, model = regression.fit(rows, names, regression.linear())
    found = regression.forecast(panel, "monthly", 6, assembler, model).orderBy("series_id", "step").collect()
    for r in found:
        k = int(r["series_id"])
        expected = 100 * k + 20 * k * np.sin(2 * np.pi * (71 + r["step"]) / 12)
        assert r["forecast"] == pytest.approx(expected, rel=0.02)


def test_a_series_carries_as_many_drivers_as_asked_for(spark):
    rows = [("a", f"d{i}", 1, 0.9 - i / 100, 200, 200) for i in range(6)]
    found = spark.createDataFrame(rows, "series_id string, driver string, lag int, strength double, pairs long, n long")
    held = [[row.driver for row in drivers.leading_drivers(found, **asked).orderBy("rank").collect()] for asked in ({}, {"most": 1}, {"most": 9})]
    assert held == [["d0", "d1", "d2", "d3"], ["d0"], [f"d{i}" for i in range(6)]]


def test_equal_strengths_go_by_lag_and_name(spark):
    rows = [("s", "b", 6, 0.5, 80, 90), ("s", "b", 8, 0.5 + 1e-13, 80, 90), ("s", "a", 7, -0.5 + 1e-14, 80, 90)]
    found = spark.createDataFrame(rows, "series_id string, driver string, lag int, strength double, pairs long, n long")
    assert [(r["driver"], r["lag"]) for r in drivers.leading_drivers(found).orderBy("rank").collect()] == [("a", 7), ("b", 6)]

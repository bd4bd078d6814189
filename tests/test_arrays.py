"""Panels of one row per series give what their rows give."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_forecasting import panel_of

from tidemark.operators import backtest, calendar, diagnostics, fanout, forecasters, preparation, smoothing, validation

SERIES = {
    "a": [float(i * 7 % 11) for i in range(50)],
    "b": [None if i % 5 == 1 else float(i * i % 23) for i in range(41)],
    "c": [0.0 if i % 4 else 9.0 for i in range(20)],
    "d": [None, 3.0, None],
    "e": [5.0],
}


def rows_of(frame):
    return sorted(map(str, frame.select(*sorted(frame.columns)).collect()))


@pytest.fixture
def panel(spark):
    # One period without a row, one with two.
    return panel_of(spark, SERIES).filter(~((F.col("series_id") == "a") & (F.col("y") == 7.0))).unionByName(panel_of(spark, {"c": [1.0]}))


def test_alignment_is_that_of_the_rows(panel):
    rows = calendar.align_calendar(panel, "monthly")
    arrays = calendar.align_arrays(panel, "monthly")
    assert rows_of(arrays.select("series_id", "n", F.inline("points"))) == rows_of(rows)


@pytest.mark.parametrize("fill, sigmas", [("none", None), ("zero", None), ("interpolate", 2.0), ("auto", 2.0)])
def test_preparation_is_that_of_the_rows(panel, fill, sigmas):
    panel = panel.dropDuplicates(["series_id", "ds"]).localCheckpoint()
    rows = preparation.prepare(calendar.align_calendar(panel, "monthly"), fill, sigmas).select("series_id", "t", F.round("y", 9).alias("y"))
    made = preparation.prepare_arrays(calendar.align_arrays(panel, "monthly"), fill, sigmas)
    each = made.select("series_id", F.inline(F.arrays_zip(F.col("points.t").alias("t"), F.col("values").alias("y"))))
    assert rows_of(each.withColumn("y", F.round("y", 9))) == rows_of(rows)


@pytest.mark.parametrize("fill, sigmas", [("none", None), ("interpolate", 2.0)])
def test_folds_are_cut_without_windows_over_them(panel, fill, sigmas, capsys):
    options = {"fill": fill, "sigmas": sigmas, "season": 12}
    rows = backtest.training_windows(backtest.fold_rows(backtest.plan_rows(calendar.align_calendar(panel, "monthly"), 6, "monthly")), **options)
    whole = backtest.fold_windows(backtest.plan_rows(calendar.align_arrays(panel, "monthly"), 6, "monthly"), **options)
    assert rows_of(whole) == rows_of(rows)
    whole.explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["seasonal_evidence", "changepoints", "jump_share"])
def test_diagnostics_sort_no_windows(spark, panel, name, capsys):
    series = panel.filter(F.col("y").isNotNull()).groupBy("series_id").agg(F.sort_array(F.collect_list("y")).alias("values"))
    made = getattr(diagnostics, f"{name}_of")(series, *(["monthly"] if name == "seasonal_evidence" else []))
    made.collect()
    made.explain()
    assert "Window" not in capsys.readouterr().out


def test_two_breaks_of_one_series(spark):
    # Two plateaus; the steps lie more than the least distance apart.
    steps = [10.0] * 20 + [60.0] * 20 + [10.0] * 20
    series = spark.createDataFrame([("a", [v + i % 2 for i, v in enumerate(steps)]), ("b", [1.0] * 30), ("c", [])], "series_id string, values array<double>")
    found = {(r.series_id, r["index"]) for r in diagnostics.changepoints_of(series).collect()}
    assert {s for s, _ in found} <= {"a"}
    level = spark.createDataFrame([("a", [1.0] * 20 + [2.0] * 20)], "series_id string, values array<double>")
    row = diagnostics.changepoints_of(level).first()
    assert (row["index"], row["strength"], row["recent"]) == (20, float("inf"), False)


def test_validation_sorts_no_windows(spark, panel, capsys):
    report = validation.validate_panel(panel, "monthly")
    got = {r.series_id: {f.code: f["count"] for f in r.findings} for r in report.collect()}
    assert got["c"]["duplicate_timestamps"] == 1 and got["d"] == {"short_history": 3, "constant_target": 1, "leading_nulls": 1, "trailing_nulls": 1}
    report.explain()
    assert "Window" not in capsys.readouterr().out


def test_windows_of_one_length_share_their_shuffles(monkeypatch):
    draw = np.random.default_rng(4)
    t = np.arange(40)
    windows = 50 + draw.normal(size=(30, 40)) + 8 * np.outer(np.arange(30) % 3, np.sin(2 * np.pi * t / 12)) + np.outer(np.arange(30) % 2, t)
    windows[7], seeds, made = 3.0, [], np.random.default_rng
    diagnostics._orders.cache_clear()
    monkeypatch.setattr(np.random, "default_rng", lambda seed: seeds.append(seed) or made(seed))
    shapes = diagnostics.shapes_of(windows, "monthly")
    assert len(seeds) == len(set(seeds)) <= 5
    assert set(shapes["has_season"]) == set(shapes["has_trend"]) == {True, False}
    for i, values in enumerate(windows):
        assert diagnostics.shape_of(values, "monthly") == {name: held[i] for name, held in shapes.items()}


def test_shuffled_strengths_are_those_of_the_general_form():
    values = np.random.default_rng(9).normal(size=(6, 31)).cumsum(axis=1)
    for period in (3, 4, 12):
        assert diagnostics._season_strengths(values, period) == pytest.approx(diagnostics._strengths(*diagnostics._seasonal(values, period)), abs=1e-12)


def test_alike_windows_lie_together(spark):
    rows = [(f"s{i}", 0, [1.0] * (20 + i % 3), (12, i % 2 == 0, False)) for i in range(96)]
    windows = spark.createDataFrame(rows, "series_id string, fold int, train array<double>, shape struct<period:int,has_season:boolean,has_trend:boolean>").repartition(4, "series_id")
    placed = forecasters.together(windows).select(F.spark_partition_id(), "shape", F.size("train"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Six kinds in a row are cut once less than there are tasks.
    assert placed.count() == 96 and placed.distinct().count() <= 6 + tasks - 1


def test_logs_are_wanted_row_by_row():
    draw = np.random.default_rng(2)
    rows = np.exp(draw.normal(size=(40, 30)) * draw.random((40, 1)) + np.arange(30) / 9)
    rows[3, 4], rows[5] = 0.0, 2.0
    logs = smoothing.want_logs(rows, 6)
    assert set(logs) == {True, False} and list(logs) == [smoothing.wants_log(row, 6) for row in rows] and not logs[3] and not logs[5]


def test_the_fan_out_sorts_no_folds(spark, panel, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("Rows were spread over folds.")

    monkeypatch.setattr(backtest, "fold_rows", refused)
    assert fanout.forecast_windows(panel, "monthly", 6, roster=("naive",)).count() > 5

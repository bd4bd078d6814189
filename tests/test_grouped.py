"""A grouped run adds up at every level, and is issued whole or not at all."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import month

from tidemark.operators import grouped, hierarchy
from tidemark.sources import store

PLAIN = ("naive", "seasonal_naive", "croston")


def leaves_of(spark, series):
    rows = [(list(path), month(i), None if v is None else float(v)) for path, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "path array<string>, ds date, y double")


@pytest.fixture(scope="module")
def ran(spark):
    t = np.arange(42)
    series = {
        ("north", "a · b"): 1000 + 60 * t,
        ("north", "b"): 3000 - 55 * t,
        ("south · a", "b"): 500 + 100 * np.cos(2 * np.pi * t / 12),
        ("south · a", "silent"): [None] * 42,
    }
    return grouped.run_grouped(leaves_of(spark, series), "monthly", 6, 2, requested=PLAIN)


def test_every_level_adds_up_to_the_top_line(ran):
    sums = {}
    for row in ran.points.collect():
        sums.setdefault(row.step, {}).setdefault(row.level, []).append(row.forecast)
    assert len(sums) == 6
    for levels in sums.values():
        assert [len(levels[k]) for k in range(3)] == [1, 2, 4]
        assert sum(levels[1]) == pytest.approx(sum(levels[0])) and sum(levels[2]) == pytest.approx(sum(levels[0]))


def test_a_key_that_holds_the_separator_stays_below_its_own_parent(ran):
    paths = {tuple(row.path): row for row in ran.series.collect()}
    assert set(paths) == {(), ("north",), ("south · a",), ("north", "a · b"), ("north", "b"), ("south · a", "b"), ("south · a", "silent")}
    north = sum(row.forecast_total for path, row in paths.items() if len(path) == 2 and path[0] == "north")
    assert north == pytest.approx(paths["north",].forecast_total)
    assert paths["south · a", "b"].parent_label == "south · a" and paths[()].parent_label is None


def test_a_leaf_without_a_model_is_estimated_and_says_why(ran):
    rows = {tuple(row.path): row for row in ran.series.collect()}
    silent = rows["south · a", "silent"]
    assert (silent.status, silent.blocked_reason, silent.model, silent.folds) == ("estimated", "no value", None, 0)
    assert rows["north", "b"].status == "forecast" and rows["north", "b"].blocked_reason is None
    assert sum(row.share for path, row in rows.items() if len(path) == 2) == pytest.approx(100, abs=0.05)


def test_bands_move_with_their_path(ran):
    rows = ran.points.filter("level = 2 AND model IS NOT NULL").collect()
    assert rows and all(row.lower is None or row.lower <= row.forecast <= row.upper for row in rows)
    assert ran.points.filter("level = 1 AND lower IS NOT NULL").count() == 0


def test_the_gap_is_that_of_the_leaves_own_forecasts(ran):
    gap = ran.gap.first()
    own = ran.points.filter("level = 2").agg(F.sum("own")).first()[0]
    direct = ran.points.filter("level = 0").agg(F.sum("forecast")).first()[0]
    assert gap.implied == pytest.approx(own) and gap.direct == pytest.approx(direct) and gap.gap == pytest.approx(abs(own - direct) / abs(direct))


def test_an_issued_run_is_read_whole(spark, ran, tmp_path):
    path = str(tmp_path / "runs")
    grouped.issue(ran, path, "r1")
    assert [one["run_id"] for one in store.issued_runs(spark, path)] == ["r1"]
    assert store.read_run(spark, path, "points").filter("run_id = 'r1'").count() == ran.points.count()
    with pytest.raises(ValueError):
        grouped.issue(ran, path, "r1")
    with pytest.raises(ValueError):
        store.read_run(spark, path, "nothing")
    with pytest.raises(ValueError):
        store.issue_run({}, path, "r2")


def test_of_two_writers_one_passes_and_a_crash_stays_unseen(spark, tmp_path, monkeypatch):
    path, one, two = str(tmp_path / "runs"), spark.range(3), spark.range(5)
    write = store.write_table
    state = {"inside": False}

    def interleaved(frame, where, **options):
        write(frame, where, **options)
        if not state["inside"]:
            # While the first writer is at its tables, another issues the same run.
            state["inside"] = True
            store.issue_run({"points": two}, path, "r1")

    monkeypatch.setattr(store, "write_table", interleaved)
    with pytest.raises(ValueError):
        store.issue_run({"points": one}, path, "r1")
    assert store.read_run(spark, path, "points").count() == 5

    def crashing(frame, where, **options):
        write(frame, where, **options)
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "write_table", crashing)
    with pytest.raises(RuntimeError):
        store.issue_run({"points": one}, path, "r2")
    monkeypatch.setattr(store, "write_table", write)
    assert [held["run_id"] for held in store.issued_runs(spark, path)] == ["r1"]
    # What crashed may be issued anew.
    store.issue_run({"points": one}, path, "r2")
    assert store.read_run(spark, path, "points", ["r2"]).count() == 3


def test_reconciled_levels_read_the_one_above_once(spark):
    nodes = spark.createDataFrame([(["a"], 1, 4.0, 0.5), (["b"], 1, 6.0, 0.5), (["a", "x"], 1, 1.0, 0.5), (["b", "y"], 1, 3.0, 0.5)], "path array<string>, step int, forecast double, share double")
    total = spark.createDataFrame([(1, 20.0)], "step int, forecast double")
    out = hierarchy.reconcile(nodes, total, 2)
    got = {tuple(row.path): row.reconciled for row in out.collect()}
    assert got == {(): 20.0, ("a",): 8.0, ("b",): 12.0, ("a", "x"): 8.0, ("b", "y"): 12.0}
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan") < 10

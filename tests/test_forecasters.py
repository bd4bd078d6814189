"""The open interface of forecasters: what is registered is routed, tested and chosen."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_forecasting import panel_of

from tidemark.operators import backtest, forecasters, run, regression
from tidemark.operators.forecasters import Forecaster


@pytest.fixture
def registered():
    added = []

    def add(forecaster):
        forecasters.register(forecaster)
        added.append(forecaster.name)

    yield add
    for name in added:
        forecasters.unregister(name)


def squares(n):
    return [50.0 + 0.5 * i * i for i in range(n)]


def parabola():
    """A batch function; made here, it travels to the executors by value."""

    def following(y, period, seasonal, trending, horizon):
        t = np.arange(y.shape[1])
        return [np.polyval(np.polyfit(t, row, 2), np.arange(len(t), len(t) + horizon)) for row in y]

    return following


def test_a_registered_model_wins_where_it_is_right(spark, registered):
    registered(Forecaster("parabola", 6, batch=parabola()))
    panel = panel_of(spark, {"a": squares(48), "b": [10.0 + (i * 7) % 5 for i in range(48)]})
    out = run.run_forecast(panel, "monthly", 3, requested=("naive", "seasonal_naive", "parabola"))
    winners = {row.series_id: row.model for row in out.candidates.filter("selected").collect()}
    assert winners["a"] == "parabola"
    points = [row.forecast for row in out.points.filter("series_id = 'a'").orderBy("step").collect()]
    assert points == pytest.approx([50.0 + 0.5 * i * i for i in range(48, 51)], rel=1e-6)
    assert out.points.filter("series_id = 'a' AND lower <= forecast AND forecast <= upper").count() == 3


def test_an_expression_and_a_model_per_cut_stand_beside_it(spark, registered):
    seen = []

    def mean_of_all(windows, frequency, steps):
        seen.append(windows)
        means = windows.groupBy("fold").agg(F.avg(F.aggregate("train", F.lit(0.0), lambda a, v: a + v) / F.size("train")).alias("_m"))
        return windows.join(means, "fold").select("series_id", "fold", F.transform(F.sequence(F.lit(1), steps), lambda s: F.col("_m")).alias("path"))

    registered(Forecaster("first_value", expression=lambda train, steps, period, trend: F.transform(F.sequence(F.lit(1), steps), lambda s: F.get(train, F.lit(0)))))
    registered(Forecaster("grand_mean", 2, per_cut=mean_of_all))
    panel = panel_of(spark, {"a": [float(i) for i in range(40)], "b": [100.0] * 40})
    out = run.run_forecast(panel, "monthly", 2, requested=("naive", "first_value", "grand_mean"))
    models = {(row.series_id, row.model) for row in out.candidates.collect()}
    assert {("a", "first_value"), ("a", "grand_mean"), ("b", "first_value")} <= models and len(seen) == 1


def test_classes_keep_a_model_from_demand_it_is_not_for(spark, registered):
    registered(Forecaster("steady_only", 2, forecasters.STEADY, expression=lambda train, steps, period, trend: F.transform(F.sequence(F.lit(1), steps), lambda s: F.lit(1.0))))
    names = ("naive", "steady_only", "croston")
    frame = spark.createDataFrame([(kind,) for kind in forecasters.EVERY], "kind string")
    got = {row.kind: row.may for row in frame.select("kind", forecasters.allowed(F.col("kind"), names).alias("may")).collect()}
    assert got["smooth"] == ["naive", "steady_only"] and got["lumpy"] == ["naive", "croston"] and got["no_demand"] == ["naive"]
    lone = frame.select("kind", forecasters.allowed(F.col("kind"), ("steady_only",)).alias("may"))
    assert {row.kind: row.may for row in lone.collect()}["lumpy"] == ["naive"]


def test_what_a_forecaster_must_state():
    with pytest.raises(ValueError):
        Forecaster("two_ways", batch=parabola(), expression=lambda *held: held[0])
    with pytest.raises(ValueError):
        Forecaster("no way")
    with pytest.raises(ValueError):
        forecasters.register(Forecaster("naive", batch=parabola()))
    with pytest.raises(ValueError):
        forecasters.named(("naive", "oracle"))


def test_arma_regression_is_in_the_roster_and_backtested_on_the_same_folds(spark):
    draw = np.random.default_rng(5)
    values = [100 + 3 * np.sin(i / 2) + float(draw.normal()) for i in range(60)]
    panel = panel_of(spark, {"a": values})
    out = run.run_forecast(panel, "monthly", 3, requested=("naive", "arma_regression"))
    folds = {row.model: row.folds for row in out.candidates.collect()}
    assert "arma_regression" in forecasters.FULL_ROSTER and folds["arma_regression"] == folds["naive"] > 1
    # What comes after a cut changes nothing before it.
    spiked = panel_of(spark, {"a": [*values[:57], 1e5, 1e5, 1e5]})
    from tidemark.operators import fanout

    held = []
    for frame in (panel, spiked):
        windows = fanout.forecast_windows(frame, "monthly", 3, roster=("arma_regression",))
        held.append({row.fold: row.path for row in windows.select("fold", F.col("paths.arma_regression").alias("path")).collect() if 0 <= row.fold < backtest.FINAL_FOLD})
    assert held[0].keys() == held[1].keys() and all(held[1][fold] == pytest.approx(path) for fold, path in held[0].items())


def test_trees_learn_from_nothing_after_their_cut(spark):
    from tidemark.operators import fanout, regression

    def small():
        return regression.gradient_boosting(2, 3)

    draw = np.random.default_rng(8)
    series = {name: [50 + 10 * np.sin(i / 2 + k) + float(draw.normal()) for i in range(48)] for k, name in enumerate("abc")}
    spiked = {name: [*values[:42], *[1e6] * 6] for name, values in series.items()}
    held = []
    for given in (series, spiked):
        windows = fanout.forecast_windows(panel_of(spark, given), "monthly", 6, roster=("naive",), max_folds=2)
        rows = regression.trees_per_cut(windows, "monthly", F.lit(6), estimator=small).collect()
        held.append({(row.series_id, row.fold): row.path for row in rows if row.fold < backtest.FINAL_FOLD})
    assert len(held[0]) == 6 and held[0].keys() == held[1].keys()
    assert all(len(path) == 6 and held[1][key] == pytest.approx(path) for key, path in held[0].items())


def test_a_race_drops_the_worse_half_each_round(spark):
    from tidemark.operators import racing
    from test_forecasting import windows_of

    drawn = [{"level": level} for level in (0.05, 0.3, 0.6, 0.99)]
    steps = {name: [100.0 * (i // 8 + k) for i in range(48)] for k, name in enumerate("ab")}
    shape = F.struct(F.lit(12).alias("period"), F.lit(False).alias("has_season"), F.lit(False).alias("has_trend"))
    windows = windows_of(spark, steps).withColumn("shape", shape)

    def local_fit(y, period, seasonal, trending, horizon, settings):
        level = y[:, 0].copy()
        for i in range(1, y.shape[1]):
            level += settings["level"] * (y[:, i] - level)
        return list(np.repeat(level[:, None], horizon, axis=1))

    out = racing.race(windows, local_fit, drawn)
    rows = {(row["round"], row.candidate): row for row in out.rounds.collect()}
    assert [sum(key[0] == r for key in rows) for r in range(1, 5)] == [4, 2, 2, 2]
    assert out.winner == 3 and rows[4, 3].stays and not rows[1, 0].stays
    # What left is measured no further.
    assert {row.candidate for row in out.errors.filter("fold = 3").collect()} == {key[1] for key in rows if key[0] == 4}
    assert racing.race(windows.filter("fold > 99"), local_fit, drawn).winner is None
    assert racing.draw({"a": (0.001, 10.0)}, 5) == racing.draw({"a": (0.001, 10.0)}, 5)


def test_tuning_makes_its_rows_once(spark):
    """However many candidates and cuts there are, the feature rows are made once."""
    made = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(60).selectExpr("cast(id % 7 as double) AS x", "cast(id % 7 * 2 + 1 as double) AS y", "date_add(DATE '2000-01-01', cast(id as int)) AS ds")
    candidates = {f"ridge {r}": (lambda r=r: regression.linear(r)) for r in (0.0, 1.0, 5.0)}
    ranked = regression.tune(rows.mapInArrow(pass_on, rows.schema), ["x"], candidates, ["2000-01-30", "2000-02-15"])
    assert made.value == 60
    assert ranked[0][0] == "ridge 0.0" and ranked[0][1] < 1e-6 and len(ranked) == 2

"""Table functions beside the column expressions they stand for."""

from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import dates, tables
from tidemark.operators import backtest, calendar


@pytest.fixture(scope="module")
def session(spark):
    assert tables.register(spark) == ("calendar_periods", "future_periods", "backtest_folds")
    return spark


@pytest.mark.parametrize("frequency", ["daily", "weekly", "monthly", "quarterly"])
def test_calendars_and_futures(session, frequency):
    rows = [(0, date(2023, 11, 30), date(2024, 3, 2)), (1, date(2024, 1, 1), date(2024, 1, 1)), (2, None, date(2024, 1, 1)), (3, date(2024, 2, 1), date(2023, 1, 1))]
    spans = session.createDataFrame(rows, "id int, a date, b date")
    spans.createOrReplaceTempView("spans")
    found = session.sql(f"SELECT id, t, ds FROM spans, LATERAL calendar_periods(a, b, '{frequency}')")
    start = [dates.period_start(F.col(name), frequency) for name in "ab"]
    want = spans.filter("a <= b").select("id", F.posexplode(dates.periods_between(*start, frequency)))
    assert sorted(found.collect()) == sorted(want.collect())
    found = session.sql(f"SELECT id, step, ds FROM spans, LATERAL future_periods(a, id + 2, '{frequency}')")
    want = spans.filter("a IS NOT NULL").select("id", F.inline(calendar.future_periods(F.col("a"), F.col("id") + 2, frequency)))
    assert sorted(found.collect()) == sorted(want.collect())


def test_folds_are_those_of_the_backtest(session):
    lengths = session.range(0, 90).select(F.col("id").cast("int").alias("n"), F.explode(F.array(F.lit(1), F.lit(4), F.lit(12))).alias("season"))
    lengths.createOrReplaceTempView("lengths")
    found = session.sql("SELECT n, season, f.* FROM lengths, LATERAL backtest_folds(n, 6, season) AS f")
    long = lengths.withColumn("t", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)))))
    planned = backtest.plan_rows(long, 6, "monthly", period=F.col("season"))
    rows = backtest.fold_rows(planned, extra_windows=False)
    want = rows.groupBy("n", "season", "fold", "scheme").agg(
        F.min(F.when(F.col("role") == "train", F.col("t"))).alias("opens"), F.first("cut").alias("cut"), F.sum((F.col("role") == "test").cast("int")).cast("int").alias("reach")
    )
    assert sorted(found.collect()) == sorted(want.collect()) and found.count() > 500


def test_no_shuffle_and_no_unknown_frequency(session):
    session.range(3).selectExpr("CAST(id AS INT) AS n").createOrReplaceTempView("few")
    for call in ("backtest_folds(n, 6, 12)", "future_periods(day, n, 'monthly')", "calendar_periods(day, date_add(day, n), 'weekly')"):
        laid = session.sql(f"SELECT n, f.* FROM (SELECT n, date_add(DATE'2024-01-01', n) AS day FROM few), LATERAL {call} AS f")
        plan = laid._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan
    for call in ("backtest_folds(NULL, 6, 12)", "backtest_folds(40, 6, NULL)", "future_periods(DATE'2024-01-01', NULL, 'daily')"):
        assert session.sql(f"SELECT * FROM {call}").count() == 0
    with pytest.raises(PySparkException):
        session.sql("SELECT * FROM few, LATERAL calendar_periods(DATE'2024-01-01', date_add(DATE'2024-01-01', n), 'hourly')").collect()

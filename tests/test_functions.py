"""Dates, names, order statistics and metrics against hand-worked values."""

import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, metrics, names, ranks
from tidemark.functions.numbers import compact
from tidemark.functions.text import (
    fiscal_value,
    iso_week_value,
    number_value,
    numbers_preserved,
    quarter_value,
    serial_value,
    unix_value,
)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {_kind(v)}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def _kind(value):
    return {str: "string", int: "int", float: "double", date: "date", bool: "boolean"}[type(value)]


@pytest.mark.parametrize(
    "day,frequency,start,end",
    [
        (date(2024, 2, 29), "monthly", date(2024, 2, 1), date(2024, 2, 29)),
        (date(2024, 5, 15), "quarterly", date(2024, 4, 1), date(2024, 6, 30)),
        (date(2024, 5, 15), "weekly", date(2024, 5, 13), date(2024, 5, 19)),
        (date(2024, 5, 15), "daily", date(2024, 5, 15), date(2024, 5, 15)),
    ],
)
def test_period_bounds(spark, day, frequency, start, end):
    assert one(spark, dates.period_start(F.col("d"), frequency), d=day) == start
    assert one(spark, dates.period_end(F.col("d"), frequency), d=day) == end


def test_adding_months_clamps_to_the_end(spark):
    assert one(spark, dates.add_periods(F.col("d"), 1, "monthly"), d=date(2024, 1, 31)) == date(2024, 2, 29)
    assert one(spark, dates.add_periods(F.col("d"), 2, "quarterly"), d=date(2023, 8, 31)) == date(2024, 2, 29)


def test_a_period_is_settled_once_over_or_overtaken(spark):
    settled = dates.is_settled(F.col("p"), F.col("r"), "monthly")
    assert one(spark, settled, p=date(2024, 1, 1), r=date(2024, 1, 31))
    assert one(spark, settled, p=date(2024, 1, 1), r=date(2024, 2, 1))
    assert not one(spark, settled, p=date(2024, 1, 1), r=date(2024, 1, 30))


def test_unknown_frequency_is_refused():
    with pytest.raises(ValueError):
        dates.checked("hourly")


def test_names():
    assert names.words("fct_order__netRevUSD") >= {"fct", "order", "rev", "revenue"}
    assert names.name_score("order_date", names.DATE_HINTS) == 1.0
    assert names.name_score("revenu", names.STRONG_TARGET_HINTS) == 0.8
    assert names.name_score("zzz", names.STRONG_TARGET_HINTS) == 0.0
    assert names.is_rate_like("conversion_rate") and not names.is_rate_like("sales price total")
    assert names.currency_symbol("net_eur") == "€" and names.currency_symbol("Betrag €") == "€"
    assert names.guess_segments(["shop", "country", "sku"]) == ("country", "sku")
    assert names.guess_segments(["alpha", "beta"]) == ("alpha", "beta")


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_exact_quantile_of_a_hot_group(spark, share):
    # A coarse sketch and a low bound force the bracketed path; one group
    # holds most rows and every key has repeated values.
    random.seed(4)
    rows = [("hot" if i % 3 else f"k{i % 5}", float(random.choice([random.gauss(0, 100), i % 50]))) for i in range(6000)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(6)
    found = {
        r["k"]: r["q"]
        for r in ranks.exact_quantile(frame, ["k"], "v", share, name="q", accuracy=200, whole=50).collect()
    }
    for key in {k for k, _ in rows}:
        values = [v for k, v in rows if k == key]
        assert found[key] == pytest.approx(np.quantile(values, share), rel=1e-12, abs=1e-12)


def test_nearest_rank_takes_a_value_that_occurred(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(1, 21)], "v double")
    assert ranks.nearest_rank(frame, [], "v", 0.95, name="p").first()["p"] == 19.0


def scored(spark, pairs, expression, **extra):
    frame = spark.createDataFrame(pairs, "t double, p double, w double")
    return frame.agg(expression.alias("x")).first()["x"]


def test_metrics(spark):
    t, p, w = F.col("t"), F.col("p"), F.col("w")
    pairs = [(100.0, 110.0, 1.0), (200.0, 180.0, 2.0), (0.0, 0.0, 1.0), (None, 5.0, 1.0)]
    assert scored(spark, pairs, metrics.mae(t, p)) == pytest.approx(10.0)
    assert scored(spark, pairs, metrics.rmse(t, p)) == pytest.approx(math.sqrt(500 / 3))
    assert scored(spark, pairs, metrics.wmape(t, p)) == pytest.approx(10.0)
    assert scored(spark, pairs, metrics.wmape(t, p, w)) == pytest.approx(10.0)
    assert scored(spark, pairs, metrics.relative_bias(t, p)) == pytest.approx(-10 / 300 * 100)
    assert scored(spark, pairs, metrics.smape(t, p)) == pytest.approx((10 / 105 + 20 / 190) / 3 * 100)
    assert scored(spark, [(0.0, 1.0, 1.0)], metrics.wmape(t, p)) is None
    # The 90% quantile costs nine times as much below as above.
    assert scored(spark, [(10.0, 0.0, 1.0)], metrics.pinball(t, p, 0.9)) == pytest.approx(9.0)
    assert scored(spark, [(0.0, 10.0, 1.0)], metrics.pinball(t, p, 0.9)) == pytest.approx(1.0)
    assert scored(spark, [(12.0, 0.0, 1.0)], metrics.winkler(t, p, p + 10, 0.8)) == pytest.approx(10 + 2 / 0.2 * 2)
    assert scored(spark, [(1.0, 1.0, 1.0)], metrics.value_add(F.max(F.lit(8.0)), F.max(F.lit(10.0)))) == pytest.approx(20.0)


@pytest.mark.parametrize(
    "value,shown",
    [
        (1_234_567.0, "1.23M"),
        (999.4, "999"),
        (12_345.0, "12.3K"),
        (-2_500_000_000.0, "-2.50B"),
        (0.0, "0"),
        (0.123456, "0.123"),
        (0.00512, "0.00512"),
    ],
)
def test_compact_numbers(spark, value, shown):
    assert one(spark, compact(F.col("v")), v=value) == shown


@pytest.mark.parametrize(
    "text,decimal,value",
    [
        ("$1,234.56", ".", 1234.56),
        ("(1,234.50)", ".", -1234.5),
        ("1000-", ".", -1000.0),
        ("1.234,56 €", ",", 1234.56),
        ("1 350", ".", 1350.0),
        ("12.5 %", ".", 12.5),
        ("approx. 40 kg", ".", 40.0),
        ("1.2e3", ".", 1200.0),
        ("-7", ".", -7.0),
        ("n/a", ".", None),
        ("12 monkeys ate 3", ".", None),
    ],
)
def test_number_values(spark, text, decimal, value):
    assert one(spark, number_value(F.col("t"), decimal), t=text) == value


def test_period_labels(spark):
    assert one(spark, quarter_value(F.col("t")), t="2024-Q3") == date(2024, 7, 1)
    assert one(spark, quarter_value(F.col("t")), t="Q1 2024") == date(2024, 1, 1)
    assert one(spark, iso_week_value(F.col("t")), t="2024-W01") == date(2024, 1, 1)
    assert one(spark, iso_week_value(F.col("t")), t="2020-W53") == date(2020, 12, 28)
    assert one(spark, iso_week_value(F.col("t")), t="2021-W53") is None
    assert one(spark, fiscal_value(F.col("t"), 10), t="FY24-P04") == date(2025, 1, 1)
    assert one(spark, fiscal_value(F.col("t")), t="FY2024 P13") is None
    assert one(spark, serial_value(F.col("n")), n=45_292) == date(2024, 1, 1)
    assert one(spark, unix_value(F.col("n")), n=1_704_067_200) == date(2024, 1, 1)


def test_numbers_are_kept_by_a_rewrite(spark):
    same = numbers_preserved(F.col("a"), F.col("b"))
    assert one(spark, same, a="Up 12.5% to $3,400.", b="To $3,400 it rose, 12.5%")
    assert not one(spark, same, a="Up 12.5%", b="Up 13%")

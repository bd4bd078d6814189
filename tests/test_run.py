"""What a run refuses before any job starts."""

from datetime import date

import pytest

from tidemark.operators.run import RunConfig, check_config


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(date(2024, 1, 1), "a", 1.0, 2.0)], "day date, sku string, y_units double, price double")


def config(**changes):
    return RunConfig(**{"time": "day", "target": "y_units", "frequency": "monthly", "horizon": 3, **changes})


def test_a_sound_run_passes(rows):
    assert check_config(config(group_by=("sku",), drivers=("price",), weight="price"), rows).horizon == 3


@pytest.mark.parametrize(
    "changes",
    [
        {"target": "nope"},
        {"target": "day"},
        {"weight": "y_units"},
        {"group_by": ("sku", "sku")},
        {"group_by": ("day",)},
        {"drivers": ("sku",)},
        {"frequency": "hourly"},
        {"horizon": 0},
        {"aggregation": "product"},
        {"models": ("oracle",)},
        {"metric_weights": {"smape": 1.0}},
    ],
)
def test_an_unsound_run_is_refused(rows, changes):
    with pytest.raises(ValueError):
        check_config(config(**changes), rows)

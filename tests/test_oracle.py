"""Every registered query beside its SQL on the smallest tables."""

import os

import pytest
from check_oracle import compare, oracle

from tidemark.plans import CATALOG

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


#: Checked by their own tests: what starts from drawn shuffles or a tree ensemble has no SQL.
WITHOUT_SQL = {
    "fan_out",
    "fan_out_candidates",
    "fan_out_parents",
    "gradient_boosting",
    "linear_regression",
    "model_mix",
    "run_candidates",
    "run_metrics",
    "run_points",
    "seasonal_profile",
    "series_profile",
    "tuned_regression",
}


@pytest.fixture(scope="module")
def connection():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, connection, name):
    _, verdict = compare(spark, connection, FOLDER, CATALOG[name])
    assert verdict == ("rows only" if name in WITHOUT_SQL else "ok"), verdict

"""Table functions for SQL: calendars, future periods and backtest folds.

Their rows follow from their arguments, so a lateral join with them becomes a
projection of the rows it joins: no shuffle, no Python. Null arguments give no rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.constants import DAILY, FOLD_CEILING, MAX_FOLDS, MONTHLY, QUARTERLY, ROLLING_SEASONS, WEEKLY

_UNKNOWN = "raise_error('Unknown frequency ' || frequency)"
_STEP = f"""CASE frequency WHEN '{DAILY}' THEN make_interval(0, 0, 0, 1) WHEN '{WEEKLY}' THEN make_interval(0, 0, 1)
    WHEN '{MONTHLY}' THEN make_interval(0, 1) WHEN '{QUARTERLY}' THEN make_interval(0, 3) ELSE {_UNKNOWN} END"""


def _opening(day: str) -> str:
    return f"""CASE frequency WHEN '{DAILY}' THEN {day} WHEN '{WEEKLY}' THEN trunc({day}, 'week')
      WHEN '{MONTHLY}' THEN trunc({day}, 'month') WHEN '{QUARTERLY}' THEN trunc({day}, 'quarter') ELSE {_UNKNOWN} END"""


def _moved(day: str, steps: str) -> str:
    return f"""CASE frequency WHEN '{DAILY}' THEN date_add({day}, {steps}) WHEN '{WEEKLY}' THEN date_add({day}, 7 * {steps})
      WHEN '{MONTHLY}' THEN add_months({day}, {steps}) WHEN '{QUARTERLY}' THEN add_months({day}, 3 * {steps}) ELSE {_UNKNOWN} END"""


_NONE = "CAST(array() AS array<{kind}>)"

#: Every period from that of the first day to that of the last, numbered from 0.
CALENDAR = f"""CREATE OR REPLACE TEMPORARY FUNCTION calendar_periods(first_day DATE, last_day DATE, frequency STRING)
  RETURNS TABLE (t INT, ds DATE)
  RETURN SELECT t, ds FROM posexplode(CASE WHEN last_day < first_day THEN {_NONE.format(kind="date")}
    ELSE sequence({_opening("first_day")}, {_opening("last_day")}, {_STEP}) END) AS p(t, ds)"""

#: The periods behind a last one, numbered from 1.
FUTURE = f"""CREATE OR REPLACE TEMPORARY FUNCTION future_periods(last_period DATE, horizon INT, frequency STRING)
  RETURNS TABLE (step INT, ds DATE)
  RETURN SELECT step, {_moved("last_period", "step")} FROM explode(CASE WHEN last_period IS NULL OR horizon < 1 THEN {_NONE.format(kind="int")}
    ELSE sequence(1, horizon) END) AS p(step)"""

_TEST = "greatest(1, least(horizon, greatest(1, n DIV 4)))"
_START = f"least(greatest(least(2 * season, n - {_TEST}), greatest(3, n DIV 2)), n - {_TEST})"
_FOLDS = f"least((n - {_START} - {_TEST}) DIV {_TEST} + 1, {min(MAX_FOLDS, FOLD_CEILING)})"
_ROLLING = f"(n / IF(season > 1, season, 12) >= {ROLLING_SEASONS})"

#: The folds of a series of n periods: periods from opens to before cut train, the
#: next reach ones test. The plan is that of ``backtest.fold_plan``.
FOLDS = f"""CREATE OR REPLACE TEMPORARY FUNCTION backtest_folds(n INT, horizon INT, season INT)
  RETURNS TABLE (fold INT, scheme STRING, opens INT, cut INT, reach INT)
  RETURN SELECT fold, IF({_ROLLING}, 'rolling', 'expanding'),
      CAST(IF({_ROLLING}, greatest(0, n - {_TEST} * ({_FOLDS} - fold) - {_START}), 0) AS INT),
      CAST(n - {_TEST} * ({_FOLDS} - fold) AS INT), CAST({_TEST} AS INT)
    FROM explode(CASE WHEN n + horizon + season IS NOT NULL AND {_START} >= 3 THEN sequence(0, CAST({_FOLDS} AS INT) - 1) ELSE {_NONE.format(kind="int")} END) AS p(fold)"""

ALL = {"calendar_periods": CALENDAR, "future_periods": FUTURE, "backtest_folds": FOLDS}


def register(spark: SparkSession) -> tuple[str, ...]:
    """Give the session its table functions; their names."""
    for text in ALL.values():
        spark.sql(text)
    return tuple(ALL)

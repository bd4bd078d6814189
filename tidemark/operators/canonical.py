"""The canonical panel: series_id, ds, y and covariates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.constants import DS, SERIES_ID, Y
from tidemark.functions.columns import require, series_label
from tidemark.functions.dates import as_date, as_double, period_start
from tidemark.functions.ranks import exact_quantile
from tidemark.operators.aggregate import DAY, REDUCERS, VALUE, _known


def to_canonical(
    rows: DataFrame,
    date: str,
    target: str,
    frequency: str,
    *,
    series_keys: Sequence[str] = (),
    covariates: Sequence[str] = (),
    aggregation: str = "sum",
) -> DataFrame:
    """One row per series and period; covariates are averaged."""
    if date == target:
        raise ValueError(f"{date!r} is named as date and as target.")
    overlap = {date, target, *series_keys} & set(covariates)
    if overlap:
        raise ValueError(f"Covariates already used otherwise: {', '.join(sorted(overlap))}.")
    require(rows, [date, target, *series_keys, *covariates])
    _known(aggregation)
    prepared = rows.select(
        series_label(series_keys).alias(SERIES_ID),
        as_date(rows, date).alias(DAY),
        as_double(rows, target).alias(VALUE),
        *[as_double(rows, name).alias(name) for name in covariates],
    ).filter(F.col(DAY).isNotNull() & F.col(VALUE).isNotNull())
    placed = prepared.withColumn(DS, period_start(F.col(DAY), frequency))
    means = [F.avg(name).alias(name) for name in covariates]
    grain = [SERIES_ID, DS]
    if aggregation == "median":
        out = exact_quantile(placed, grain, VALUE, 0.5, name=Y).drop("n")
        if means:
            out = out.join(placed.groupBy(*grain).agg(*means), grain)
        return out.select(*grain, Y, *covariates)
    reducer = REDUCERS[aggregation]
    states = [F.expr(text).alias(f"{name}") for name, text in reducer.state.items()]
    out = placed.groupBy(*grain).agg(*states, *means)
    return out.select(*grain, F.expr(reducer.result).cast("double").alias(Y), *covariates)


def canonical_schema(covariates: Sequence[str] = ()) -> T.StructType:
    fields = [
        T.StructField(SERIES_ID, T.StringType()),
        T.StructField(DS, T.DateType()),
        T.StructField(Y, T.DoubleType()),
    ]
    return T.StructType(fields + [T.StructField(name, T.DoubleType()) for name in covariates])


def contract_breaches(panel: DataFrame, covariates: Sequence[str] = ()) -> list[str]:
    """What is wrong with a panel's columns; needs no job."""
    expected = {field.name: field.dataType for field in canonical_schema(covariates)}
    held = {field.name: field.dataType for field in panel.schema}
    problems = [f"missing column {name}" for name in expected if name not in held]
    problems += [
        f"{name} is {held[name].simpleString()}, not {kind.simpleString()}"
        for name, kind in expected.items()
        if name in held and held[name] != kind
    ]
    return problems + [f"undeclared column {name}" for name in held if name not in expected]


def duplicate_grain(panel: DataFrame) -> DataFrame:
    """Series and periods held more than once."""
    return panel.groupBy(SERIES_ID, DS).agg(F.count("*").alias("rows")).filter("rows > 1")


def assert_canonical(panel: DataFrame, covariates: Sequence[str] = ()) -> DataFrame:
    problems = contract_breaches(panel, covariates)
    if problems:
        raise ValueError(f"Not a canonical panel: {'; '.join(problems)}.")
    if not duplicate_grain(panel).isEmpty():
        raise ValueError("The panel holds more than one row for a series and period.")
    return panel

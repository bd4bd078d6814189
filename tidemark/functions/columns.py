"""Small column helpers used everywhere."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import KEY_SEPARATOR, MISSING_KEY, SINGLE_SERIES


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    if not name or "\x00" in name:
        raise ValueError(f"No column can be called {name!r}.")
    return F.col("`" + name.replace("`", "``") + "`")


def key_text(name: str) -> Column:
    """A grouping key as text, with a label of its own for null."""
    return F.coalesce(col(name).cast("string"), F.lit(MISSING_KEY))


def series_label(names: Sequence[str]) -> Column:
    if not names:
        return F.lit(SINGLE_SERIES)
    return F.concat_ws(KEY_SEPARATOR, *[key_text(name) for name in names])


def finite(value: Column) -> Column:
    """The value, or null where it is not a finite number."""
    unusable = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~unusable, value)


def require(frame: DataFrame, names: Iterable[str]) -> None:
    absent = [name for name in names if name not in frame.columns]
    if absent:
        raise ValueError(f"Unknown column(s): {', '.join(absent)}.")


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(F.least(value, high), low)


#: What counts as nothing beside a sum of floating-point numbers.
ZERO_TOLERANCE = 1e-8


def near_zero(value: Column) -> Column:
    return F.abs(value) <= F.lit(ZERO_TOLERANCE)

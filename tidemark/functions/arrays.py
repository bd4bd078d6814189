"""Arrays of numbers in Arrow batches, taken together by length.

A series' history is bounded by its calendar, so it may travel as one row with
its values in an array. Rows of one length make a matrix; a null is NaN in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets from nought, all values, and which of them are not null."""
    offsets = lists.offsets.to_numpy()
    held = lists.flatten()
    return offsets - offsets[0], held.to_numpy(zero_copy_only=False).astype(float), np.array(held.is_valid().to_numpy(zero_copy_only=False))


def by_length(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length, and the places of their values, one row each."""
    lengths = np.diff(offsets)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, offsets[rows][:, None] + np.arange(length)


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places from each start up to its end, one after the other."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) if len(sizes) else np.arange(0)


def lists(offsets: np.ndarray, values: np.ndarray, valid: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.float64(), mask=~valid))


def median(values: np.ndarray) -> np.ndarray:
    """Of each row, NaN left out."""
    known = (~np.isnan(values)).sum(axis=1)
    if not values.shape[1]:
        return np.full(len(values), np.nan)
    ordered, rows = np.sort(values, axis=1), np.arange(len(values))
    low, high = ordered[rows, np.maximum(known - 1, 0) // 2], ordered[rows, np.minimum(known // 2, values.shape[1] - 1)]
    return np.where(known % 2 == 1, low, 0.5 * low + 0.5 * high)


def mean(values: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.nansum(values, axis=1) / (~np.isnan(values)).sum(axis=1)


def stddev_samp(values: np.ndarray) -> np.ndarray:
    known = (~np.isnan(values)).sum(axis=1)
    with np.errstate(all="ignore"):
        off = np.nansum((values - mean(values)[:, None]) ** 2, axis=1)
        return np.where(known > 1, np.sqrt(off / (known - 1)), np.nan)


def steps(values: np.ndarray, lag: int = 1) -> np.ndarray:
    """Each value less the one ``lag`` before it, from the first that has one."""
    return values[:, lag:] - values[:, :-lag]


def add_columns(frame: DataFrame, made: Callable[[pa.RecordBatch], dict[str, pa.Array]], kinds: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``frame`` but those of ``drop``, and what ``made`` gives for each batch."""
    names = [name for name in frame.columns if name not in drop]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = made(batch)
            yield pa.RecordBatch.from_arrays([*[column(batch, name) for name in names], *new.values()], names=[*names, *new])

    fields = ", ".join(f"`{name}` {frame.schema[name].dataType.simpleString()}" for name in names)
    return frame.mapInArrow(each, f"{fields}, {kinds}")

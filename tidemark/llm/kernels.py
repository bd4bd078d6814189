"""Array kernels over the UTF-8 bytes of a batch of texts.

A piece is a run of rows whose texts lie back to back in one byte array, so
that every step below is a numpy operation over all of them. Texts are never
cut: a text longer than the piece size makes a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text held as arrays at once, so that these stay in the processor's
#: cache; a single longer text is held whole.
PIECE_BYTES = 1 << 18

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(values: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all output bits."""
    out = values + U64(_ODD)
    out = (out ^ (out >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> U64(27))) * U64(0x94D049BB133111EB)
    return out ^ (out >> U64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __reduce__(self) -> tuple:
        # Functions travel to the executors with what they refer to: not the tables.
        return _Powers, (self.base,)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), PIECE_BYTES)
            tables = []
            for factor in (self.base, self.inverse):
                table = np.full(size, factor, dtype=np.uint64)
                table[0] = 1
                tables.append(np.cumprod(table, dtype=np.uint64))
            self.up, self.down = tables
        return self.up, self.down


_POWERS = _Powers(0xD1342543DE82EF95)
#: A random 64-bit value for every byte, from the mixing rule.
_BYTE_VALUE = mix(np.arange(256, dtype=np.uint64) * U64(0x2545F4914F6CDD1D) + U64(77))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column back to back, and n + 1 offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if binary else "")
    wide = pa.large_binary() if binary else pa.large_string()
    if column.type != wide:
        column = column.cast(wide)
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their bytes and offsets, each of at most ``limit``
    bytes unless one text alone is longer."""
    if not batch.num_rows:
        return
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows, at + 50_000)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any byte range follows."""
    _, down = _POWERS.upto(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUE[data] * down[: len(data)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte range, equal for equal bytes."""
    up, _ = _POWERS.upto(len(sums))
    return mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64) * U64(_ODD))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, ASCII letters, and every byte of a non-ASCII character.
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True


@dataclass
class Words:
    """Words of a piece: lower-cased bytes, word bounds, hashes, words per text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    def text(self, word: int) -> bytes:
        return self.data[self.starts[word] : self.ends[word]].tobytes()

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z."""
    inside = _IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lower = _LOWER[data]
    hashes = range_hashes(prefix_sums(lower), starts, ends)
    return Words(lower, starts, ends, hashes, np.searchsorted(starts, offsets))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` consecutive word hashes, by place of the first."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        out = out * U64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mix(out)


def firsts(ordered: np.ndarray) -> np.ndarray:
    """Places where a new value begins in a sorted array."""
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    ordered = np.sort(values)
    return ordered[firsts(ordered)]


def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def repeat_ranges(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... count values for every pair."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(firsts, counts)


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mask of the places inside at least one range."""
    marks = np.zeros(size + 1, dtype=np.int32)
    np.add.at(marks, starts, 1)
    np.subtract.at(marks, ends, 1)
    return np.cumsum(marks[:-1], dtype=np.int32) > 0


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs, broken at row bounds, and the
    first run of each row (n + 1 values)."""
    first, last = mask.copy(), mask.copy()
    if len(mask):
        first[1:] &= ~mask[:-1]
        last[:-1] &= ~mask[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(mask))]
        first[cuts] = mask[cuts]
        last[cuts - 1] = mask[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)

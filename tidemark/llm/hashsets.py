"""Sorted hash sets packed for the shuffle, and tests of membership between them.

A set goes out in ranges of the hash, so that a task gets one range of all
sets. Within a range the top bits become counts per bucket and only the low
bytes of each value are stored, about log2(values / set size) bits apiece.
A set holds each value once, so however often a string occurs, a range gets it
once from each set. The answer to a set is one bit per value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Values of one range that meet in a task: the bound on a task's memory.
RANGE_VALUES = 1 << 21

PACKED = "part long, block long, n long, low binary, counts binary"
ANSWER = "part long, block long, n long, bits binary"


@dataclass(frozen=True)
class Layout:
    """``range_bits`` ranges of values of ``value_bits`` bits, ``low_bytes`` stored."""

    range_bits: int
    value_bits: int
    low_bytes: int

    @property
    def bucket_bits(self) -> int:
        return max(0, self.value_bits - self.range_bits - 8 * self.low_bytes)

    def cut(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.value_bits)


def filter_layout(values: int) -> Layout:
    """Enough bits that under one value in 256 meets another by chance."""
    size = max(1, math.ceil(math.log2(max(2, values))))
    ranges = max(0, math.ceil(math.log2(max(1, values / RANGE_VALUES))))
    return Layout(ranges, min(64, max(ranges + 16, size + 8)), 2)


def exact_layout(values: int) -> Layout:
    """All 64 bits of the hash."""
    ranges = max(0, math.ceil(math.log2(max(1, values / RANGE_VALUES))))
    # The range and the bucket hold the bits that are not stored.
    return Layout(ranges, 64, 6 if ranges <= 16 else 5)


def pack(block: int, values: np.ndarray, layout: Layout) -> pa.RecordBatch:
    """Rows of PACKED for the sorted distinct values of one set."""
    parts, blocks, ns, lows, counts = [], [], [], [], []
    inner = np.uint64(layout.value_bits - layout.range_bits)
    cuts = np.searchsorted(values, np.arange(1, 1 << layout.range_bits, dtype=np.uint64) << inner)
    cuts = np.concatenate(([0], cuts, [len(values)]))
    for part in range(len(cuts) - 1):
        held = values[cuts[part] : cuts[part + 1]]
        if not len(held):
            continue
        held = held & np.uint64((1 << int(inner)) - 1) if inner < 64 else held
        wide = 8 * layout.low_bytes
        tally = np.bincount((held >> np.uint64(wide)).astype(np.int64), minlength=1 << layout.bucket_bits)
        low = held.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : layout.low_bytes]
        parts.append(part)
        blocks.append(block)
        ns.append(len(held))
        lows.append(np.ascontiguousarray(low.T).tobytes())
        counts.append(tally.astype("<u1" if tally.max() < 256 else "<u4").tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int64()), pa.array(blocks, pa.int64()), pa.array(ns, pa.int64()), pa.array(lows, pa.binary()), pa.array(counts, pa.binary())],
        names=["part", "block", "n", "low", "counts"],
    )


def _unpack(n: int, low: bytes, counts: bytes, layout: Layout) -> np.ndarray:
    kind = "<u1" if len(counts) == 1 << layout.bucket_bits else "<u4"
    tally = np.frombuffer(counts, dtype=kind)
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, : layout.low_bytes] = np.frombuffer(low, dtype=np.uint8).reshape(layout.low_bytes, n).T
    high = np.repeat(np.arange(len(tally), dtype=np.uint64), tally)
    return wide.view("<u8").ravel() | high << np.uint64(8 * layout.low_bytes)


def answers(layout: Layout, earlier_only: bool, part_bits: int = 0):
    """For ``groupBy("part").applyInArrow``: which values of each set also lie in
    another set, or in a set of a smaller block only. The last ``part_bits`` of a
    block's number tell parts of one block apart, none of which is the smaller."""

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        part = key[0].as_py()
        blocks, ns = table.column("block").to_pylist(), table.column("n").to_pylist()
        held = [_unpack(n, low.as_py(), counts.as_py(), layout) for n, low, counts in zip(ns, table.column("low"), table.column("counts"), strict=True)]
        values = np.concatenate(held)
        del held
        # Sorted by value and then by block: what is equal stands side by side.
        order = np.argsort(values, kind="stable")
        values = values[order]
        same = values[1:] == values[:-1]
        del values
        found = np.zeros(len(order), dtype=bool)
        found[1:] = same
        if not earlier_only:
            found[:-1] |= same
        elif part_bits:
            # Equal values stand in the order of their blocks: the first of them decides.
            begins = np.flatnonzero(~found)
            place = np.repeat(np.asarray(blocks, dtype=np.int64) >> part_bits, ns)[order]
            found &= place > np.repeat(place[begins], np.diff(np.append(begins, len(order))))
        out = np.empty(len(order), dtype=bool)
        out[order] = found
        cuts = np.cumsum([0, *ns])
        bits = [np.packbits(out[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"part": pa.array([part] * len(ns), pa.int64()), "block": pa.array(blocks, pa.int64()), "n": pa.array(ns, pa.int64()), "bits": pa.array(bits, pa.binary())})

    return answer


def flags(answered: pa.Table, size: int) -> np.ndarray:
    """One flag per value of a set, from its answers (part, n, bits) in any order."""
    held = sorted(zip(*(answered.column(name).to_pylist() for name in ("part", "n", "bits")), strict=True))
    out = [np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=n) for _, n, bits in held]
    found = np.concatenate(out).astype(bool) if out else np.zeros(0, dtype=bool)
    if len(found) != size:
        raise ValueError(f"A set of {size} values got answers for {len(found)}.")
    return found

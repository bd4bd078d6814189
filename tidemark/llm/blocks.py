"""Blocks: consecutive ranges of the document id that hold about as many bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels


def block_of(key: Column, bounds: list[int]) -> Column:
    """The block of an id; rows without an id belong to block -1."""
    edges = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("long")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(dtype=np.int64), side="right"))

    return F.when(key.isNull(), F.lit(-1).cast("long")).otherwise(place(F.coalesce(key, F.lit(0).cast("long"))))


#: Bits of a block's number that tell apart the parts of one id.
PART_BITS = 20


def heavy_blocks(sizes: DataFrame, block_bytes: int) -> tuple[list[int], np.ndarray]:
    """First ids of all blocks but the first, from rows (id long, size long), and of
    every block the parts it falls into.

    An id of two blocks' bytes or more has a block to itself, in parts of about
    ``block_bytes``; any other block is one part. Two numbers a block come to the
    driver, so the block size sets its share: 8 MB a block is 16 bytes in 8 million.
    """

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = 0, True
        for batch in batches:
            bounds, parts = [], []
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                heavy = size >= 2 * block_bytes
                if fresh or heavy or held >= block_bytes:
                    bounds.append(key)
                    parts.append(min(-(-size // block_bytes), 1 << PART_BITS) if heavy else 1)
                    held = 0
                held, fresh = held + size, heavy
            yield pa.RecordBatch.from_arrays([pa.array(bounds, pa.int64()), pa.array(parts, pa.int64())], names=["bound", "parts"])

    totals = sizes.where("id IS NOT NULL").groupBy("id").agg(F.sum("size").alias("size"))
    rows = sorted(totals.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(cuts, "bound long, parts long").collect())
    return [row.bound for row in rows], np.array([1, *(row.parts for row in rows)], dtype=np.int64)


def part_of(block: Column, spread: Column, parts: np.ndarray) -> Column:
    """The number of a block and of a part in it; numbers grow with the block."""
    base = F.shiftleft(block, PART_BITS)
    if parts.max() == 1:
        return base

    @F.pandas_udf("long")
    def share(blocks: pd.Series) -> pd.Series:
        return pd.Series(parts[blocks.to_numpy(dtype=np.int64)])

    return base + F.pmod(F.xxhash64(spread), share(block))


def is_divided(block: Column, parts: np.ndarray) -> Column:
    """Whether a block is one id in several parts; block -1 is not."""

    @F.pandas_udf("boolean")
    def divided(blocks: pd.Series) -> pd.Series:
        return pd.Series(parts[np.maximum(blocks.to_numpy(dtype=np.int64), 0)] > 1)

    return divided(block)


class Texts:
    """The texts of one block in id order, from rows (id, text, block)."""

    def __init__(self, table: pa.Table) -> None:
        order = np.lexsort((np.arange(table.num_rows), table.column("id").fill_null(-(1 << 63)).to_numpy()))
        self.table = table = table.take(pa.array(order)).combine_chunks()
        self.number = table.column("block")[0].as_py() if table.num_rows else -1
        self.data, self.offsets = kernels.text_bytes(table.column("text"))
        self.ids = table.column("id").fill_null(0).to_numpy()
        #: Rows that take no part: all of block -1, whose ids are null.
        self.skip = np.full(table.num_rows, self.number == -1)

    def pieces(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of rows of at most the piece size: first row, end, bytes, offsets."""
        n, at = len(self.offsets) - 1, 0
        while at < n:
            end = int(np.searchsorted(self.offsets, self.offsets[at] + kernels.PIECE_BYTES, side="right")) - 1
            end = min(n, max(end, at + 1))
            yield at, end, self.data[self.offsets[at] : self.offsets[end]], self.offsets[at : end + 1] - self.offsets[at]
            at = end

"""Exact removal of repeated byte strings by a distributed difference cover.

A string of ``min_length`` bytes that starts at i in one text and at j in
another is found without sorting every suffix:

1. *Sample.* Suffixes are sampled at the places of a difference cover modulo
   21: whatever i and j are, some shift under 21 takes both to sampled places.
2. *Name.* A sampled suffix is named by its first ``min_length - 20`` bytes. All
   names are sorted, one range of them to a task, and equal neighbours found.
   Unique names are discarded: no repeat runs over them.
3. *Recurse.* Only suffixes within reach of a name that stayed can begin a
   repeat. Compared prefixes are ``min_length`` bytes long and shift plus name
   cover them, so the recursion on names ends at its first level.
4. *Merge.* The remaining suffixes, sampled or not, are sorted by their first
   ``min_length`` bytes and adjacent prefixes compared: a prefix that also
   stands in a block of smaller ids, or under a smaller id of its own block,
   is a repeat.

Names are 64-bit hashes, not ranks, since only equality is asked for; a chance
meeting of two prefixes is one in 2**64 for each pair. Texts move once, into
blocks of consecutive ids. Blocks send sets of names, each name once however
often it occurs, and get one bit per name back, so a text that a third of the
rows share weighs no more than one row per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashsets, kernels
from tidemark.llm.blocks import PART_BITS, Texts, block_of, heavy_blocks, part_of

#: A perfect difference set: every residue modulo 21 is a difference of two.
PERIOD = 21
COVER = (0, 1, 6, 8, 18)

SCHEMA = "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
#: Flags, answers to the sampled names, answers to the merged prefixes.
_NOTE = "block long, kind int, part long, n long, bits binary, id long, digest binary"


class _Block(Texts):
    """The texts of one block; copies of earlier texts take no part."""

    def __init__(self, table: pa.Table, notes: pa.Table) -> None:
        super().__init__(table)
        self.notes = notes
        flagged = self._of_kind(0)
        copies = set(zip(flagged.column("id").to_pylist(), flagged.column("digest").to_pylist(), strict=True))
        keys = zip(self.table.column("id").to_pylist(), self.table.column("digest").to_pylist(), strict=True) if copies else ()
        self.copy = np.array([key in copies for key in keys], dtype=bool) if copies else np.zeros(table.num_rows, dtype=bool)
        self.skip = self.skip | self.copy

    def _of_kind(self, kind: int) -> pa.Table:
        kinds = self.notes.column("kind").to_numpy()
        return self.notes.filter(pa.array(kinds == kind))

    def answers(self, kind: int, size: int) -> np.ndarray:
        return hashsets.flags(self._of_kind(kind), size)

    def windows(self, at: int, end: int, offsets: np.ndarray, length: int) -> np.ndarray:
        """A mask of the places of a piece where a string of ``length`` bytes starts."""
        sizes = np.diff(offsets)
        room = np.where(self.skip[at:end], 0, np.maximum(sizes - length + 1, 0))
        return kernels.covered(int(offsets[-1]), offsets[:-1], offsets[:-1] + room)

    def names(self, length: int, layout: hashsets.Layout) -> tuple[np.ndarray, np.ndarray]:
        """Places and names of the sampled suffixes."""
        residue = np.zeros(PERIOD, dtype=bool)
        residue[list(COVER)] = True
        places, names = [], []
        for at, end, data, offsets in self.pieces():
            base = self.offsets[at]
            allowed = self.windows(at, end, offsets, length)
            allowed &= np.resize(np.roll(residue, -int(base % PERIOD)), len(data))
            starts = np.flatnonzero(allowed)
            names.append(layout.cut(kernels.range_hashes(kernels.prefix_sums(data), starts, starts + length)))
            places.append(starts + base)
        return kernels.joined(places, np.int64), kernels.joined(names, np.uint64)

    def rows_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, side="right") - 1

    def remaining(self, name_length: int, length: int, layout: hashsets.Layout) -> tuple[np.ndarray, np.ndarray]:
        """Places and prefixes of the suffixes within reach of a repeated name."""
        places, names = self.names(name_length, layout)
        order, firsts, group = _grouped(names)
        rows = self.rows_of(places)
        shared = self.answers(1, len(firsts))
        ids = self.ids[rows[order]]
        shared |= _least(ids, firsts) != -_least(-ids, firsts)
        kept = np.empty(len(order), dtype=bool)
        kept[order] = shared[group]
        near = places[kept]
        reach = kernels.covered(len(self.data), np.maximum(near - (PERIOD - 1), 0), near + 1)
        out_places, out = [], []
        for at, end, data, offsets in self.pieces():
            base = self.offsets[at]
            mask = self.windows(at, end, offsets, length) & reach[base : base + len(data)]
            starts = np.flatnonzero(mask)
            if len(starts):
                out.append(kernels.range_hashes(kernels.prefix_sums(data), starts, starts + length))
                out_places.append(starts + base)
        return kernels.joined(out_places, np.int64), kernels.joined(out, np.uint64)


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts, where in it each value begins, the group of each place in it."""
    order = np.argsort(values)
    begins = kernels.firsts(values[order])
    return order, begins, np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))


def _least(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(values, begins) if len(begins) else values


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 50, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, spans (removed byte ranges, maximal
    and in order) and kept (the remaining bytes).

    A byte goes if it lies in a string of ``min_length`` bytes that also starts in
    a text of a smaller id. Null text counts as empty. Rows that share an id do
    not count against each other. A row without an id has no place in the order:
    it keeps its text and removes nothing elsewhere. An empty table gives an empty
    table; other columns are ignored, whatever their names.
    """
    if min_length < PERIOD + 3:
        raise ValueError(f"min_length must be {PERIOD + 3} bytes or more.")
    name_length = min_length - PERIOD + 1
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    given = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"))
    # Rows without an id go around the blocks.
    rows = given.where("id IS NOT NULL")
    none = F.array().cast("array<struct<start:long,end:long>>").alias("spans")
    around = given.where("id IS NULL").select("id", F.octet_length("text").cast("long").alias("n_bytes"), none, F.col("text").cast("binary").alias("kept"))
    sizes = rows.select("id", F.octet_length("text").cast("long").alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).collect()[0].bytes
    bounds, parts = heavy_blocks(sizes, block_bytes)
    # At most every place is sampled or stays: the layouts hold for that.
    sampled = hashsets.filter_layout(max(2, total * len(COVER) // PERIOD))
    merged = hashsets.exact_layout(max(2, total // 4))

    keyed = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    split = bool(parts.max() > 1)
    place = part_of(block_of(F.col("id"), bounds), F.col("digest"), parts)
    blocks = keyed.withColumn("block", place)
    if split:
        # Rows of a heavy id that are equal in text share one result.
        once = blocks.groupBy("block", "id", "digest").agg(F.first("text").alias("text"), F.count("*").alias("times"))
        blocks = once.select("id", "text", "digest", "block", "times")

    # Whole copies of a text with a smaller id are settled by their digests.
    firsts = keyed.select("id", "digest").where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = keyed.select("id", "digest").join(firsts, "digest").where("id > first").select("id", "digest").distinct()
    copy_notes = copies.select(
        place.alias("block"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("bits"), F.col("id").alias("id"), F.col("digest").alias("digest")
    )

    def notes(frame: DataFrame, kind: int) -> DataFrame:
        return frame.select("block", F.lit(kind).alias("kind"), "part", "n", "bits", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("digest"))

    def send_names(key: tuple[pa.Scalar, ...], table: pa.Table, held: pa.Table) -> pa.Table:
        block = _Block(table, held)
        values = kernels.distinct(block.names(name_length, sampled)[1])
        return pa.Table.from_batches([hashsets.pack(block.number, values, sampled)])

    def send_prefixes(key: tuple[pa.Scalar, ...], table: pa.Table, held: pa.Table) -> pa.Table:
        block = _Block(table, held)
        values = kernels.distinct(block.remaining(name_length, min_length, sampled)[1])
        return pa.Table.from_batches([hashsets.pack(block.number, values, merged)])

    def remove(key: tuple[pa.Scalar, ...], table: pa.Table, held: pa.Table) -> pa.Table:
        block = _Block(table, held)
        places, prefixes = block.remaining(name_length, min_length, sampled)
        order, firsts_, group = _grouped(prefixes)
        doc_ids = block.ids[block.rows_of(places)]
        earlier = block.answers(2, len(firsts_))
        first_id = _least(doc_ids[order], firsts_)
        repeat = np.empty(len(order), dtype=bool)
        repeat[order] = earlier[group] | (first_id[group] < doc_ids[order])
        starts = places[repeat]
        gone = kernels.covered(len(block.data), starts, starts + min_length)
        sizes_ = np.diff(block.offsets)
        whole = block.copy & (sizes_ >= min_length)
        gone |= kernels.covered(len(block.data), block.offsets[:-1][whole], block.offsets[1:][whole])
        return _removed(block, gone)

    def cogrouped(side: DataFrame, work, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(work, schema)

    names = cogrouped(copy_notes, send_names, hashsets.PACKED)
    shared = names.groupBy("part").applyInArrow(hashsets.answers(sampled, earlier_only=False), hashsets.ANSWER)
    with_shared = copy_notes.unionByName(notes(shared, 1))
    prefixes = cogrouped(with_shared, send_prefixes, hashsets.PACKED)
    earlier = prefixes.groupBy("part").applyInArrow(hashsets.answers(merged, earlier_only=True, part_bits=PART_BITS), hashsets.ANSWER)
    answered = with_shared.unionByName(notes(earlier, 2))
    if split:
        told = cogrouped(answered, remove, f"{SCHEMA}, times long").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        return told.drop("time", "times").unionByName(around)
    return cogrouped(answered, remove, SCHEMA).unionByName(around)


def _removed(block: _Block, gone: np.ndarray) -> pa.Table:
    """Rows of SCHEMA for a block and the mask of its removed bytes."""
    starts, ends, cuts = kernels.spans(gone, block.offsets)
    base = np.repeat(block.offsets[:-1], np.diff(cuts))
    pair = pa.StructArray.from_arrays([pa.array(starts - base, pa.int64()), pa.array(ends - base, pa.int64())], names=["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pair)
    kept = block.data[~gone]
    ends_kept = np.concatenate(([0], np.cumsum(~gone)))[block.offsets]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends_kept) - 1, [None, pa.py_buffer(ends_kept.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())])
    out = pa.table({"id": block.table.column("id"), "n_bytes": pa.array(np.diff(block.offsets), pa.int64()), "spans": spans, "kept": column.cast(pa.binary())})
    return out.append_column("times", block.table.column("times")) if "times" in block.table.column_names else out

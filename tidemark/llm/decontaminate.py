"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark's windows of ``window`` words (an item of fewer
words is one shorter window). For every pattern length there is

* a *shift table*: the last two words under the cursor hash to the distance by
  which the cursor may move on without stepping over the end of any pattern;
* *suffix buckets*: where the shift is nought, the patterns that end in these
  two words, picked by the hash of the pair;
* a *direct comparison* of the words, hash by hash and then byte by byte.

Many cursors move at once, each over its own stretch of words, so a step is one
array operation. Texts are read once and nothing is shuffled. The tables of at
most ``pass_words`` benchmark words are broadcast; a larger benchmark is worked
off in several passes of that size, so what is broadcast has a bound.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm import kernels

#: Places that one cursor covers.
STRETCH = 256
_MIX = np.uint64(0x9FB21C651E98DF25)


def _pair(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return kernels.mix(before * _MIX + last)


@dataclass
class Table:
    """Patterns of one length."""

    length: int
    shift_bits: int
    shifts: np.ndarray
    suffixes: np.ndarray
    hashes: np.ndarray
    texts: list[bytes]
    #: Ordinals of the items that hold each pattern.
    items: list[list[int]]

    def keys(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _pair(hashes[at - 1], hashes[at]) if self.length > 1 else kernels.mix(hashes[at])


@dataclass
class Patterns:
    tables: list[Table]
    names: list[str | None]


def compile_patterns(items: list[tuple[str | None, str | None]], window: int) -> Patterns:
    names: list[str | None] = []
    place: dict[str | None, int] = {}
    column = pa.array([text for _, text in items], pa.large_string())
    data, offsets = kernels.text_bytes(column)
    words = kernels.words_of(data, offsets)
    found: dict[int, dict[bytes, tuple[int, set[int]]]] = {}
    for row, (name, _) in enumerate(items):
        if name not in place:
            place[name] = len(names)
            names.append(name)
        first, end = int(words.offsets[row]), int(words.offsets[row + 1])
        length = min(window, end - first)
        tokens = [words.text(at) for at in range(first, end)]
        for at in range(end - first - length + 1) if length else ():
            held = found.setdefault(length, {}).setdefault(b" ".join(tokens[at : at + length]), (first + at, set()))
            held[1].add(place[name])
    tables = []
    for length, held in sorted(found.items()):
        firsts = np.array([first for first, _ in held.values()], dtype=np.int64)
        hashes = words.hashes[firsts[:, None] + np.arange(length)]
        shape = Table(length, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint64), hashes, [], [])
        ends = shape.keys(words.hashes, firsts + length - 1)
        order = np.argsort(ends, kind="stable")
        bits = min(24, max(12, math.ceil(math.log2(len(held) * length + 1)) + 4))
        block = min(2, length)
        shifts = np.full(1 << bits, length - block + 1, dtype=np.uint8)
        for last in range(block - 1, length):
            slots = (shape.keys(words.hashes, firsts + last) >> np.uint64(64 - bits)).astype(np.int64)
            np.minimum.at(shifts, slots, length - 1 - last)
        texts, members = list(held), [sorted(members) for _, members in held.values()]
        tables.append(Table(length, bits, shifts, ends[order], hashes[order], [texts[i] for i in order], [members[i] for i in order]))
    return Patterns(tables, names)


def search(words: kernels.Words, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """First words and pattern numbers of all occurrences in the texts of a piece."""
    hashes, length = words.hashes, table.length
    if len(hashes) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Cursors stand on a window's last word.
    at = np.arange(length - 1, len(hashes), STRETCH)
    ends = np.minimum(at + STRETCH, len(hashes))
    drop, stops, keys = np.uint64(64 - table.shift_bits), [], []
    while len(at):
        key = table.keys(hashes, at)
        shift = table.shifts[(key >> drop).astype(np.int64)]
        stop = shift == 0
        stops.append(at[stop])
        keys.append(key[stop])
        at = at + np.maximum(shift, 1)
        going = at < ends
        at, ends = at[going], ends[going]
    last, key = np.concatenate(stops), np.concatenate(keys)
    low, high = np.searchsorted(table.suffixes, key, "left"), np.searchsorted(table.suffixes, key, "right")
    pattern = kernels.repeat_ranges(low, high - low)
    first = np.repeat(last - length + 1, high - low)
    # Words of one text only.
    row = np.searchsorted(words.offsets, first, "right")
    inside = first + length <= words.offsets[np.minimum(row, len(words.offsets) - 1)]
    first, pattern = first[inside], pattern[inside]
    for step in range(length):
        same = hashes[first + step] == table.hashes[pattern, step]
        first, pattern = first[same], pattern[same]
    sure = [b" ".join(words.text(a + i) for i in range(length)) == table.texts[p] for a, p in zip(first.tolist(), pattern.tolist(), strict=True)]
    keep = np.array(sure, dtype=bool)
    return first[keep], pattern[keep]


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_HITS = "array<struct<start:long,end:long>>"


def _run(patterns: Broadcast, keep_text: bool):
    """For ``mapInArrow``: adds the hits of these patterns to those found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = pickle.loads(patterns.value)
        names = compiled.names
        for batch in batches:
            for rows, data, offsets in kernels.pieces(batch, "text"):
                words = kernels.words_of(data, offsets)
                n = len(words.hashes)
                starts, ends, in_rows, items = [], [], [], []
                for table in compiled.tables:
                    first, pattern = search(words, table)
                    starts.append(first)
                    ends.append(first + table.length)
                    row = np.searchsorted(words.offsets, first, "right") - 1
                    for at, number in zip(row.tolist(), pattern.tolist(), strict=True):
                        in_rows.extend([at] * len(table.items[number]))
                        items.extend(table.items[number])
                old = rows.column(rows.schema.get_field_index("hits"))
                if len(old.flatten()):
                    base = np.repeat(words.offsets[:-1], np.diff(old.offsets.to_numpy()))
                    starts.append(old.flatten().field("start").to_numpy() + base)
                    ends.append(old.flatten().field("end").to_numpy() + base)
                mask = kernels.covered(n, np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*ends, np.zeros(0, np.int64)]))
                first, last, cuts = kernels.spans(mask, words.offsets)
                base = np.repeat(words.offsets[:-1], np.diff(cuts))
                hits = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], fields=list(_SPAN)))
                listed = [set(held) for held in rows.column(rows.schema.get_field_index("items")).to_pylist()]
                for at, item in set(zip(in_rows, items, strict=True)):
                    if names[item] is not None:
                        listed[at].add(names[item])
                out = {
                    "id": rows.column(rows.schema.get_field_index("id")),
                    "n_words": pa.array(np.diff(words.offsets), pa.int64()),
                    "hits": hits,
                    "items": pa.array([sorted(held) for held in listed], pa.list_(pa.string())),
                }
                if keep_text:
                    out["text"] = rows.column(rows.schema.get_field_index("text"))
                yield pa.RecordBatch.from_pydict(out)

    return run


def _passes(benchmark: DataFrame, pass_words: int) -> Iterator[list[tuple[str | None, str | None]]]:
    held, size = [], 0
    for row in benchmark.toLocalIterator():
        held.append((row.item, row.text))
        size += len(row.text or "") // 2 + 1
        if size >= pass_words:
            yield held
            held, size = [], 0
    yield held


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, pass_words: int = 1_000_000, keep_text: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, hits (maximal runs of words inside
    benchmark windows, as word ranges) and items (ids whose windows occur, as
    text, sorted), and the text as well if ``keep_text`` is set.

    Words are maximal runs of ASCII letters, digits and non-ASCII characters after
    lower-casing A-Z. Null text has no words; an item without words has no
    window. Repeated items count once, an item without an id marks words but is
    not listed. An empty table on either side gives rows without hits, or none.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    frame = docs.select(
        docs[id_col].alias("id"),
        docs[text_col].cast("string").alias("text"),
        F.array().cast(_HITS).alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[item_text_col].cast("string").alias("text"))
    passes = _passes(items, pass_words)
    held = next(passes)
    while held is not None:
        after = next(passes, None)
        table = spark.sparkContext.broadcast(cloudpickle.dumps(compile_patterns(held, window)))
        schema = f"id {kind}, n_words long, hits {_HITS}, items array<string>" + ", text string" * (keep_text or after is not None)
        frame = frame.mapInArrow(_run(table, keep_text or after is not None), schema)
        held = after
    return frame


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", share: int = 20, **settings) -> DataFrame:
    """All columns of ``docs`` and contaminated, which replaces a column so named.

    Every row is judged by its own text, in the pass that reads it, so rows need
    no id and ids may repeat.
    """
    whole = docs.drop("contaminated")
    flag = contaminated(F.col("n_words"), hit_words(), share).alias("contaminated")
    # A text goes to the workers once, unless it has to be cast.
    once = whole.schema[text_col].dataType == StringType()
    others = [name for name in whole.columns if name != text_col or not once]
    row = F.struct(F.lit(0).alias("__none"), *(whole[name] for name in others)).alias("row")
    found = find_contamination(whole.select(row, whole[text_col].alias("text")), benchmark, id_col="row", keep_text=once, **settings)
    return found.select(*(F.col("id").getField(name).alias(name) if name in others else F.col("text").alias(name) for name in whole.columns), flag)


def hit_words(hits: str = "hits") -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda total, run: total + run["end"] - run["start"])


def contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    """At least one word in ``share`` lies in a benchmark window."""
    return (n_hit > 0) & (n_hit * share >= n_words)

"""Line dedup: lines that another line, equal or within a few edits, precedes.

Lines are near if a fifth of the longer one's characters may change, and no more
than ``threshold``: none of up to four characters, one of five to nine, two from
ten on. One rule holds for all lengths, and edits are those of characters.

Two lines within k edits share a segment: cut the shorter one into k + 1
segments, and one of them stands unharmed in the other, shifted by no more than
the edits around it allow. So

1. every line sends the hashes of its segments, for each k that a longer line may
   allow, and of the substrings in which segments of lines up to k characters
   shorter may stand, each with that length, k and the segment's number;
2. hashes that occur in one line only are discarded, by packed sets that answer
   one bit per hash; exact copies are found the same way, by whole lines;
3. lines that kept a hash meet by it, segments on one side and substrings on
   the other; pairs whose character counts differ by more than the edits can
   change are passed over;
4. what is left is verified by a banded bit-parallel edit distance.

A line needs one earlier neighbour to go. The earliest candidates are verified
first, and only lines without success go on to the next ones, in rounds, until
no candidate is left: verification of a group of like lines costs its size, not
its square. Lines of a key that many share meet by blocks: no task holds more of a
key than two of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm import hashsets, kernels
from tidemark.llm.blocks import Texts, block_of, heavy_blocks, is_divided, part_of
from tidemark.session import cut_lineage

#: Edits of characters, at most, and characters of the longer line for each.
THRESHOLD = 2
PER_EDIT = 5

#: Parts of the second set are numbered from here on.
_KEYS_FROM = 1 << 32
_BUCKETS = 16
_BUCKET = (kernels.mix(np.arange(256, dtype=np.uint64)) % np.uint64(_BUCKETS)).astype(np.int64)

LINES = "id long, no int, hash long, text binary, bag binary, segments array<long>, probes array<long>"


def allowed(length: int, threshold: int) -> int:
    """Edits that a line of this many characters allows a line no longer than it."""
    return min(threshold, length // PER_EDIT)


def within(left: str, right: str, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions and replacements of
    characters turn one line into the other.

    After what both ends share, vertical differences of the table are kept as
    bits, for a band of 2 * most + 1 rows that moves down with the columns.
    """
    if abs(len(left) - len(right)) > most:
        return False
    size = min(len(left), len(right))
    off = int.from_bytes(left[:size].encode("utf-32-le"), "little") ^ int.from_bytes(right[:size].encode("utf-32-le"), "little")
    head = ((off & -off).bit_length() - 1) // 32 if off else size
    left, right, size = left[head:], right[head:], size - head
    off = int.from_bytes(left[len(left) - size :].encode("utf-32-be"), "big") ^ int.from_bytes(right[len(right) - size :].encode("utf-32-be"), "big")
    tail = ((off & -off).bit_length() - 1) // 32 if off else size
    left, right = left[: len(left) - tail], right[: len(right) - tail]
    if not left or not right:
        return len(left) + len(right) <= most
    rows: dict[str, int] = {}
    for place, letter in enumerate(left):
        rows[letter] = rows.get(letter, 0) | 1 << place
    width, n = 2 * most + 1, len(left)
    whole = (1 << width) - 1
    rises, falls = whole >> most << most, 0
    score = min(most, n)
    for column, letter in enumerate(right, 1):
        shift = column - most - 1
        held = rows.get(letter, 0)
        match = (held >> shift if shift >= 0 else held << -shift) & whole
        level = ((((match & rises) + rises) ^ rises) | match | falls) & whole
        up = (falls | ~(level | rises)) & whole
        down = level & rises
        if column + most <= n:
            score += not level >> (width - 1) & 1
        else:
            row = n - column + most
            score += (up >> row & 1) - (down >> row & 1)
        rises = (down | ~(level >> 1 | up)) & whole
        falls = level >> 1 & up
    return score <= most


def cut_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, row and number in the row of every line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((breaks, offsets[1:])), kind="stable")
    counts = np.diff(np.searchsorted(breaks, offsets)) + 1
    rows = np.repeat(np.arange(len(counts)), counts)
    return starts, ends, rows, kernels.repeat_ranges(np.zeros(len(counts), dtype=np.int64), counts)


def _segment(lengths: np.ndarray, number: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of a segment (from 0) of lines of these lengths; the last
    ones are a character longer where the length does not divide."""
    size, longer = lengths // parts, lengths % parts
    extra = np.maximum(0, number - (parts - longer))
    return size * number + extra, size + (number >= parts - longer)


class Letters:
    """The characters of a piece: where each begins, and the hashes of its ranges."""

    def __init__(self, data: np.ndarray, sums: np.ndarray) -> None:
        self.sums = sums
        self.bytes = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))

    def of(self, places: np.ndarray) -> np.ndarray:
        """The number of the character that begins at a byte."""
        return np.searchsorted(self.bytes, places)

    def keys(self, starts: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, edits: int, number: int) -> np.ndarray:
        hashes = kernels.range_hashes(self.sums, self.bytes[starts], self.bytes[starts + sizes])
        return kernels.mix(hashes ^ kernels.mix(((lengths * 16 + edits) * 64 + number).astype(np.uint64)))


#: Lines and their keys.
Found = tuple[np.ndarray, np.ndarray]


def line_keys(letters: Letters, starts: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[list[Found], list[Found]]:
    """Keys of the segments and of the probes of lines between bytes, by number of edits."""
    first = letters.of(starts)
    lengths = letters.of(ends) - first
    segments, probes = [], []
    for edits in range(1, threshold + 1):
        parts = edits + 1
        # The longer line allows this many edits, and the shorter is that much shorter at most.
        least, most = PER_EDIT * edits, PER_EDIT * (edits + 1) - 1 if edits < threshold else np.iinfo(np.int64).max
        own = np.flatnonzero((lengths >= least - edits) & (lengths <= most))
        for number in range(parts):
            at, size = _segment(lengths[own], number, parts)
            segments.append((own, letters.keys(first[own] + at, size, lengths[own], edits, number)))
        lines = np.flatnonzero((lengths >= least) & (lengths <= most))
        for less in range(edits + 1):
            shorter = lengths[lines] - less
            for number in range(parts):
                at, size = _segment(shorter, number, parts)
                # Edits before the segment move it by their number at most, and so do
                # those behind it, counted from the end.
                low = max(-number, less - (edits - number))
                high = min(number, less + (edits - number))
                for move in range(low, high + 1):
                    start = at + move
                    fits = (start >= 0) & (start + size <= lengths[lines])
                    probes.append((lines[fits], letters.keys(first[lines[fits]] + start[fits], size[fits], shorter[fits], edits, number)))
    return segments, probes


class _Lines(Texts):
    """The lines of a block, piece by piece."""

    def __init__(self, table: pa.Table, notes: pa.Table | None) -> None:
        super().__init__(table)
        self.notes = notes
        #: The number of a row's first line: 0 but for lines of a heavy id, a row each.
        self.base = self.table.column("base").to_numpy() if "base" in self.table.column_names else np.zeros(self.table.num_rows, dtype=np.int64)

    def answers(self, keys: bool, size: int) -> np.ndarray:
        of_keys = self.notes.column("part").to_numpy() >= _KEYS_FROM
        return hashsets.flags(self.notes.filter(pa.array(of_keys == keys)), size)

    def parts(self):
        for at, _, data, offsets in self.pieces():
            starts, ends, rows, numbers = cut_lines(data, offsets)
            sums = kernels.prefix_sums(data)
            yield at, data, sums, starts, ends, rows + at, numbers + self.base[rows + at]

    def line_hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number and hash of the lines that are not empty."""
        out: list[list[np.ndarray]] = [[], [], []]
        for _, _, sums, starts, ends, rows, numbers in self.parts():
            fit = np.flatnonzero((ends > starts) & ~self.skip[rows])
            for held, values in zip(out, (rows[fit], numbers[fit], kernels.range_hashes(sums, starts[fit], ends[fit])), strict=True):
                held.append(values)
        return tuple(kernels.joined(held, kind) for held, kind in zip(out, (np.int64, np.int64, np.uint64), strict=True))

    def key_sets(self, threshold: int, layout: hashsets.Layout) -> tuple[np.ndarray, np.ndarray]:
        """The sorted keys of the block, and whether more than one line text has each."""
        keys, owners = [], []
        for _, data, sums, starts, ends, rows, _ in self.parts():
            fit = np.flatnonzero((ends > starts) & ~self.skip[rows])
            hashes = kernels.range_hashes(sums, starts[fit], ends[fit])
            segments, probes = line_keys(Letters(data, sums), starts[fit], ends[fit], threshold)
            for lines, held in [*segments, *probes]:
                keys.append(held)
                owners.append(hashes[lines])
        cut, owner = layout.cut(kernels.joined(keys, np.uint64)), kernels.joined(owners, np.uint64)
        order = np.argsort(cut)
        cut, owner = cut[order], owner[order]
        first = kernels.firsts(cut)
        if not len(first):
            return cut, np.zeros(0, dtype=bool)
        return cut[first], np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)


def _send(threshold: int, lines: hashsets.Layout, keys: hashsets.Layout):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = _Lines(table, None)
        _, _, hashes = block.line_hashes()
        whole = hashsets.pack(block.number, kernels.distinct(hashes), lines)
        cut, _ = block.key_sets(threshold, keys)
        parts = hashsets.pack(block.number, cut, keys)
        moved = pa.array(parts.column(0).to_numpy() + _KEYS_FROM, pa.int64())
        return pa.Table.from_batches([whole, parts.set_column(0, "part", moved)])

    return send


def _answer(lines: hashsets.Layout, keys: hashsets.Layout):
    first, shared = hashsets.answers(lines, earlier_only=True), hashsets.answers(keys, earlier_only=False)

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return (shared if key[0].as_py() >= _KEYS_FROM else first)(key, table)

    return answer


def _keep(threshold: int, layout: hashsets.Layout):
    """Rows of LINES: lines to drop (without text) and lines that share a key."""

    def keep(key: tuple[pa.Scalar, ...], table: pa.Table, notes: pa.Table) -> pa.Table:
        block = _Lines(table, notes)
        rows, numbers, hashes = block.line_hashes()
        order = np.argsort(hashes)
        first = kernels.firsts(hashes[order])
        group = np.empty(len(hashes), dtype=np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        # Of a text's lines in this block, the first in the order of (id, number).
        place = np.lexsort((numbers, block.ids[rows])) if len(rows) else np.zeros(0, np.int64)
        rank = np.empty(len(rows), dtype=np.int64)
        rank[place] = np.cumsum(np.append(0, (np.diff(block.ids[rows][place]) != 0) | (np.diff(numbers[place]) != 0))[: len(place)])
        least = np.minimum.reduceat(rank[order], first) if len(first) else rank
        earlier = block.answers(False, len(first))
        gone = earlier[group] | (least[group] < rank)
        gone_at = set(zip(rows[gone].tolist(), numbers[gone].tolist(), strict=True))
        cut, twice = block.key_sets(threshold, layout)
        shared = block.answers(True, len(cut)) | twice
        wanted = cut[shared]
        out: dict[str, list] = {name: [] for name in ("id", "no", "hash", "text", "bag", "segments", "probes")}

        def add(**values) -> None:
            for name, held in out.items():
                held.append(values.get(name))

        for at, number, digest in zip(rows[gone].tolist(), numbers[gone].tolist(), hashes[gone].view(np.int64).tolist(), strict=True):
            add(id=int(block.ids[at]), no=number, hash=digest)
        seen: set[tuple[int, int, int]] = set()
        for _, data, sums, starts, ends, own_rows, own_numbers in block.parts():
            fit = np.flatnonzero((ends > starts) & ~block.skip[own_rows])
            stays = [(row, number) not in gone_at for row, number in zip(own_rows[fit].tolist(), own_numbers[fit].tolist(), strict=True)]
            fit = fit[np.array(stays, dtype=bool)]
            letters = Letters(data, sums)
            segments, probes = line_keys(letters, starts[fit], ends[fit], threshold)
            found_segments, found_probes = [[] for _ in fit], [[] for _ in fit]
            for lines, keys, found in [*((*held, found_segments) for held in segments), *((*held, found_probes) for held in probes)]:
                spot = np.minimum(np.searchsorted(wanted, layout.cut(keys)), max(0, len(wanted) - 1))
                hit = np.flatnonzero(wanted[spot] == layout.cut(keys)) if len(wanted) else np.zeros(0, np.int64)
                for line, value in zip(lines[hit].tolist(), keys[hit].view(np.int64).tolist(), strict=True):
                    found[line].append(value)
            some = np.array([i for i in range(len(fit)) if found_segments[i] or found_probes[i]], dtype=np.int64)
            if not len(some):
                continue
            chosen = fit[some]
            first_letter = letters.of(starts[chosen])
            sizes = letters.of(ends[chosen]) - first_letter
            # A character counts by its last byte, so that an edit changes two counts.
            last_bytes = data[letters.bytes[kernels.repeat_ranges(first_letter, sizes) + 1] - 1]
            counts = np.bincount(np.repeat(np.arange(len(chosen)), sizes) * _BUCKETS + _BUCKET[last_bytes], minlength=len(chosen) * _BUCKETS)
            bags = counts.astype(np.uint8).reshape(-1, _BUCKETS)
            digests = kernels.range_hashes(sums, starts[chosen], ends[chosen]).view(np.int64)
            for spot, line in enumerate(chosen.tolist()):
                name = (int(block.ids[own_rows[line]]), int(own_numbers[line]), int(digests[spot]))
                if name not in seen:  # rows that share an id may hold the same line twice
                    seen.add(name)
                    i = int(some[spot])
                    add(id=name[0], no=name[1], hash=name[2], text=data[starts[line] : ends[line]].tobytes(), bag=bags[spot].tobytes(), segments=found_segments[i], probes=found_probes[i])
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds, strict=True)})

    return keep


#: Pairs compared at once.
_PAIRS = 1 << 19
CANDIDATES = "later_id long, later_no int, later_hash long, id long, no int, hash long, more boolean"


def _candidates(threshold: int, low: int, high: int):
    """For ``groupBy(part).applyInArrow``: of every open line, its earlier candidates
    from the ``low``-th to before the ``high``-th, and whether there are more."""

    def candidates(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, probe = table.column("key").to_numpy(), table.column("probe").to_numpy(zero_copy_only=False)
        names = [table.column(name).to_numpy() for name in ("id", "no", "hash")]
        # Lines by number, in the order of (id, number, hash).
        order = np.lexsort(names[::-1])
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([held[order][1:] != held[order][:-1] for held in names], axis=0)
        line = np.empty(len(order), dtype=np.int64)
        line[order] = np.cumsum(new) - 1
        chosen = order[new]
        names, n = [held[chosen] for held in names], len(chosen)
        bags = np.frombuffer(b"".join(table.column("bag").take(pa.array(chosen)).to_pylist()), dtype=np.uint8).reshape(-1, _BUCKETS)
        is_open = table.column("open").to_numpy(zero_copy_only=False)[chosen]
        at = np.flatnonzero(~probe)
        at = at[np.argsort(keys[at], kind="stable")]
        held_keys, held_lines = keys[at], line[at]
        probes = np.flatnonzero(probe)
        first = np.searchsorted(held_keys, keys[probes], "left")
        count = np.searchsorted(held_keys, keys[probes], "right") - first
        # A pair is one number, the later line first.
        kept, begin, totals = np.zeros(0, dtype=np.int64), 0, np.cumsum(count)
        while begin < len(probes):
            before = totals[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(totals, before + _PAIRS, "right")))
            a = np.repeat(line[probes[begin:end]], count[begin:end])
            b = held_lines[kernels.repeat_ranges(first[begin:end], count[begin:end])]
            later = np.maximum(a, b)
            some = np.flatnonzero((a != b) & is_open[later])
            gap = bags[a[some]] - bags[b[some]]
            some = some[np.minimum(gap, -gap).sum(axis=1, dtype=np.int64) <= 2 * threshold]
            kept = kernels.distinct(np.concatenate((kept, later[some] * n + np.minimum(a, b)[some])))
            kept = kept[_ranks(kept // n) <= high]
            begin = end
        rank = _ranks(kept // n)
        inside = (rank >= low) & (rank < high)
        more = np.zeros(n, dtype=bool)
        more[(kept // n)[rank == high]] = True
        later, earlier = (kept // n)[inside], (kept % n)[inside]
        columns = [*(held[later] for held in names), *(held[earlier] for held in names), more[later]]
        kinds = (pa.int64(), pa.int32(), pa.int64()) * 2 + (pa.bool_(),)
        return pa.table([pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)], names=[field.split()[0] for field in CANDIDATES.split(", ")])

    return candidates


def _ranks(sorted_values: np.ndarray) -> np.ndarray:
    first = kernels.firsts(sorted_values)
    return np.arange(len(sorted_values)) - np.repeat(first, np.diff(np.append(first, len(sorted_values))))


def _verify(threshold: int):
    def near(left: str, right: str) -> bool:
        return within(left, right, allowed(max(len(left), len(right)), threshold))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column(batch.schema.get_field_index("later_text")).to_pylist(), batch.column(batch.schema.get_field_index("text")).to_pylist(), strict=True)
            sure = pa.array([near(left.decode(), right.decode()) for left, right in texts], pa.bool_())
            columns = [batch.column(batch.schema.get_field_index(name)) for name in ("later_id", "later_no", "later_hash", "more")]
            yield pa.RecordBatch.from_arrays([*columns, sure], names=["id", "no", "hash", "more", "near"])

    return verify


#: Entries of a key from which it is dealt out, and of a block of such a key.
_HOT_ROWS = 1 << 12
#: Blocks of earlier lines that a round reads at most.
_HOT_BLOCKS = 16


def deal_hot(entries: DataFrame, low: int, high: int) -> DataFrame:
    """Units of hot keys, from entries with their key's number of ``blocks``: every
    block from ``low`` to before ``high`` with the open lines of every block. A
    unit's number takes the place of the key."""
    dealt = entries.withColumn("block", F.pmod(F.xxhash64("id", "no", "hash"), F.col("blocks")).cast("int"))
    asked = dealt.where("open")
    later = asked.where(F.col("blocks") > low).withColumn("first", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.col("blocks")).cast("int") - 1)))
    # An open line of the block itself is there already.
    later = later.where("block <> first").withColumnRenamed("block", "second")
    first = dealt.where(F.col("block") >= low).where(F.col("block") < high).withColumnRenamed("block", "first").withColumn("second", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    # Blocks without open lines ask nothing.
    first = first.join(asked.select("key", F.col("block").alias("second")).distinct(), ["key", "second"], "left_semi")
    columns = ["id", "no", "hash", "bag", "probe", "open", F.xxhash64("key", "first", "second").alias("key")]
    return first.select(*columns).unionByName(later.select(*columns))


def near_lines(lines: DataFrame, threshold: int, part_rows: int = 1 << 19, hot_rows: int = _HOT_ROWS) -> DataFrame:
    """Of the lines that share a key (rows of LINES), those that an earlier line
    within the threshold precedes: id, no, hash.

    Entries of a key meet in one task up to ``hot_rows``. Larger keys are dealt
    out by blocks of lines, and rounds hold the lines that are still open against
    the next blocks.
    """
    pair = F.concat(
        F.transform("segments", lambda value: F.struct(value.alias("key"), F.lit(False).alias("probe"))),
        F.transform("probes", lambda value: F.struct(value.alias("key"), F.lit(True).alias("probe"))),
    )
    entries = lines.select("id", "no", "hash", "bag", F.explode(pair).alias("entry")).select("id", "no", "hash", "bag", "entry.key", "entry.probe")
    total = lines.agg(F.coalesce(F.sum(F.size("segments") + F.size("probes")), F.lit(0)).alias("n")).collect()[0].n
    texts = lines.select("id", "no", "hash", "text")
    name = ["id", "no", "hash"]
    if not total:
        return texts.select(*name).limit(0)
    found: DataFrame | None = None

    def opened(frame: DataFrame) -> DataFrame:
        # Lines that have gone still precede others; they are only not asked about again.
        if found is None:
            return frame.withColumn("open", F.lit(True))
        return frame.join(found.withColumn("gone", F.lit(True)), name, "left").withColumn("open", F.col("gone").isNull()).drop("gone")

    def settle(deal: Callable[[], DataFrame], rows: int) -> None:
        nonlocal found
        part = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-rows // part_rows)))).alias("part")
        low, high = 0, 8
        while True:
            pairs = deal().groupBy(part).applyInArrow(_candidates(threshold, low, high), CANDIDATES)
            once = pairs.groupBy("later_id", "later_no", "later_hash", *name).agg(F.max("more").alias("more"))
            later = texts.select(F.col("id").alias("later_id"), F.col("no").alias("later_no"), F.col("hash").alias("later_hash"), F.col("text").alias("later_text"))
            held = once.join(later, ["later_id", "later_no", "later_hash"]).join(texts, name)
            judged = held.mapInArrow(_verify(threshold), "id long, no int, hash long, more boolean, near boolean")
            verified = cut_lineage(judged.groupBy(*name).agg(F.max("near").alias("near"), F.max("more").alias("more")), "near")
            new = verified.where("near").select(*name)
            found = new if found is None else found.unionByName(new)
            if not verified.where("more AND NOT near").limit(1).count():
                return
            low, high = high, high * 16

    hot = cut_lineage(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("key", "n", F.ceil(F.col("n") / hot_rows).alias("blocks")), "hot")
    most = hot.agg(F.max("blocks").alias("blocks"), F.sum("n").alias("n")).collect()[0]
    if not most.n:
        settle(lambda: opened(entries), total)
        return found
    settle(lambda: opened(entries.join(hot.select("key"), "key", "left_anti")), total - most.n)
    dealt = cut_lineage(entries.join(hot.select("key", "blocks"), "key"), "dealt")
    begin, end = 0, 1
    while begin < most.blocks:
        # The open lines are fixed for the block, so that ranks stay what they are.
        now = cut_lineage(opened(dealt), "open")
        units = cut_lineage(deal_hot(now, begin, end), "units")
        rows = units.count()
        if not rows:
            break
        settle(lambda units=units: opened(units.drop("open")), rows)
        begin, end = end, end + min(4 * (end - begin), _HOT_BLOCKS)
    return found


OCCURRENCES = "id long, digest binary, no int, hash long, line string"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over rows (id, digest, text): every line that is not empty."""
    for batch in batches:
        for rows, data, offsets in kernels.pieces(batch, "text"):
            starts, ends, own, numbers = cut_lines(data, offsets)
            fit = np.flatnonzero(ends > starts)
            hashes = kernels.range_hashes(kernels.prefix_sums(data), starts[fit], ends[fit]).view(np.int64)
            lines = [data[a:b].tobytes().decode("utf-8") for a, b in zip(starts[fit].tolist(), ends[fit].tolist(), strict=True)]
            place = pa.array(own[fit])
            columns = [*(rows.column(rows.schema.get_field_index(name)).take(place) for name in ("id", "digest")), pa.array(numbers[fit], pa.int32()), pa.array(hashes), pa.array(lines, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "no", "hash", "line"])


def _edit(names: list[str], text: str):
    """For ``mapInArrow``: takes the named lines out of the texts."""

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in kernels.pieces(batch, text):
                starts, ends, own, numbers = cut_lines(data, offsets)
                per_row = np.bincount(own, minlength=rows.num_rows)
                base = np.concatenate(([0], np.cumsum(per_row)))
                drops = rows.column(rows.schema.get_field_index("__drops"))
                count = np.diff(drops.offsets.to_numpy()) if drops.null_count == 0 else np.array([len(held or ()) for held in drops.to_pylist()])
                flat = drops.flatten()
                row = np.repeat(np.arange(rows.num_rows), count)
                no = flat.field("no").to_numpy().astype(np.int64)
                inside = no < per_row[row]
                row, no = row[inside], no[inside]
                line = base[row] + no
                # Another row of the same id may hold another line here.
                same = kernels.range_hashes(kernels.prefix_sums(data), starts[line], ends[line]).view(np.int64) == flat.field("hash").to_numpy()[inside]
                near = flat.field("near").to_numpy(zero_copy_only=False)[inside][same]
                line, row, no = line[same], row[same], no[same]
                stays = np.ones(len(starts), dtype=bool)
                stays[line] = False
                place = np.cumsum(stays) - 1
                before = np.concatenate(([0], np.cumsum(stays)))[base[:-1]]
                # With the line break before it, but for the first that stays.
                lead = (place > before[own]).astype(np.int64)[stays]
                mask = kernels.covered(len(data), starts[stays] - lead, ends[stays])
                cuts = np.concatenate(([0], np.cumsum(mask)))[offsets]
                raw = data[mask].tobytes()
                kept = pa.array([raw[a:b].decode("utf-8") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string())
                listed: list[list[int]] = [[] for _ in range(rows.num_rows)]
                for at, number in zip(row.tolist(), no.tolist(), strict=True):
                    listed[at].append(number)
                held = [rows.column(rows.schema.get_field_index(name)) for name in names]
                yield pa.RecordBatch.from_arrays(
                    [*held, pa.array(per_row, pa.int64()), pa.array([sorted(at) for at in listed], pa.list_(pa.int32())), pa.array(np.bincount(row[near], minlength=rows.num_rows), pa.int64()), kept],
                    names=[*names, "n_lines", "dropped", "n_near", "kept"],
                )

    return edit


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, block_bytes: int = 8 << 20) -> DataFrame:
    """All columns of ``docs`` and n_lines, dropped (numbers of the lines taken out,
    from 0), n_near (how many of them have no equal line before them) and kept
    (the text of the others).

    A line goes if an equal line stands under a smaller id or further up, or one
    within ``threshold`` edits of characters and a fifth of the longer line's
    characters; so lines of up to four characters go for equal ones only. The
    order is that of (id, line number). Empty lines stay. Null text is one empty
    line and comes back as empty text. Rows without an id take no part. Columns of
    ``docs`` named like a result are replaced.

    Rows that share an id are one document of several versions: a line goes from all
    of them, and stays where it stands under the same number in each. An id of many
    rows takes part line by line, each different line once, in as many blocks as its
    bytes fill.
    """
    if not 0 < threshold < PER_EDIT - 1:
        raise ValueError(f"The edits must be under {PER_EDIT - 1}.")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    # Rows without an id need no block.
    rows = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text")).where("id IS NOT NULL")
    sizes = rows.select("id", F.octet_length("text").cast("long").alias("size"))
    breaks = F.octet_length("text") - F.octet_length(F.translate("text", "\n", ""))
    total = rows.agg(F.coalesce(F.sum(breaks + 1), F.lit(0)).alias("lines")).collect()[0].lines
    bounds, parts = heavy_blocks(sizes, block_bytes)
    own_block = block_of(F.col("id"), bounds)
    split = bool(parts.max() > 1)
    blocks = rows.withColumn("block", part_of(own_block, F.col("text"), parts))
    if split:
        marked = rows.withColumn("__heavy", is_divided(own_block, parts))
        versions = marked.where("__heavy").groupBy("id", F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.first("text").alias("text"))
        told = cut_lineage(versions.select("id", "digest", "text").mapInArrow(_occurrences, OCCURRENCES), "versions")
        once = told.groupBy("id", "hash").agg(F.min("no").cast("long").alias("base"), F.first("line").alias("text"))
        dealt = once.withColumn("block", part_of(own_block, F.col("hash"), parts))
        light = marked.where("NOT __heavy").withColumn("block", part_of(own_block, F.col("text"), parts))
        blocks = light.select("id", "text", F.lit(0).cast("long").alias("base"), "block").unionByName(dealt.select("id", "text", "base", "block"))
    # A line of ten characters or more has 15 keys with two edits.
    per_line = (threshold + 1) * (threshold + 2) * (threshold + 3) // 4
    lines_layout = hashsets.exact_layout(max(2, total))
    keys_layout = hashsets.filter_layout(max(2, total * per_line))
    sent = blocks.groupBy("block").applyInArrow(_send(threshold, lines_layout, keys_layout), hashsets.PACKED)
    notes = sent.groupBy("part").applyInArrow(_answer(lines_layout, keys_layout), hashsets.ANSWER)
    kept = blocks.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(_keep(threshold, keys_layout), LINES)
    stored = cut_lineage(kept, "lines")
    near = near_lines(stored.where("text IS NOT NULL"), threshold)
    gone = stored.where("text IS NULL").select("id", "no", "hash", F.lit(False).alias("near")).unionByName(near.withColumn("near", F.lit(True)))
    held = F.collect_set(F.struct("no", "hash", "near")).alias("__drops")
    if split:
        # What goes from a heavy id is told by its versions: no list is longer than a text.
        later = told.join(once.select("id", "hash", "base"), ["id", "hash"]).where("no > base").select("id", "digest", "no", "hash", F.lit(False).alias("near"))
        firsts = told.join(gone, ["id", "no", "hash"]).select("id", "digest", "no", "hash", "near")
        of_light = gone.where(~is_divided(own_block, parts)).withColumn("digest", F.lit(b""))
        drops = of_light.unionByName(firsts).unionByName(later).groupBy(F.col("id").alias("__drop_id"), F.col("digest").alias("__drop_digest")).agg(held)
    else:
        drops = gone.groupBy(F.col("id").alias("__drop_id")).agg(held)
    names = [name for name in docs.columns if name not in ("n_lines", "dropped", "n_near", "kept")]
    # A text goes to the workers once, unless it has to be cast.
    read = text_col if text_col in names and docs.schema[text_col].dataType == StringType() else "__text"
    given = docs.select(*(docs[name] for name in names), docs[id_col].cast("long").alias("__id"), *([] if read == text_col else [text.alias(read)]))
    none = F.array().cast("array<struct<no:int,hash:bigint,near:boolean>>")
    same = F.col("__id") == F.col("__drop_id")
    if split:
        version = F.when(is_divided(block_of(F.col("__id"), bounds), parts), F.unhex(F.sha2(F.coalesce(F.col(read).cast("string"), F.lit("")), 256)))
        given = given.withColumn("__digest", F.coalesce(version, F.lit(b"")))
        same = same & (F.col("__digest") == F.col("__drop_digest"))
    joined = given.join(drops, same, "left").withColumn("__drops", F.coalesce("__drops", none)).drop("__id", "__drop_id", "__digest", "__drop_digest")
    fields = ", ".join(f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in names)
    return joined.mapInArrow(_edit(names, read), f"{fields}, n_lines long, dropped array<int>, n_near long, kept string")

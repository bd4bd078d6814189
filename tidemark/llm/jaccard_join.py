"""A Jaccard join on word n-grams through a MinHash forest.

Every text is a set of n-word shingles. Texts of the same set are one node, with
one signature. The forest has ``trees`` label sequences of a signature; texts
whose labels share a prefix in some tree are candidates. Matching starts at the
full depth and is shortened to the depth at which a pair on the threshold is
met with the target recall: that depth follows from threshold, trees and recall.
Fixed bands stand in for the forest: each tree has one key of its first labels at
that depth, without sorted prefix tries, and nothing is shortened by rounds.

Candidates are verified exactly, on their shingles, unless a bound that no pair at
the threshold can fail has settled them: the ratio of their shingle counts, or
the bits in which sketches of parities differ, no more than the sets differ.
Inside a bucket each text is first held against the bucket's most central
member, which joins a group of copies with a pair per member. As long as a
bucket holds texts of several components, its next members lead in turn, and
texts of other components are held against them. In the end every candidate pair
is in one component, or proved or verified to lie below the threshold.

Links are counted when the components are known: two linked texts are in one, so
every pair of nodes of a component is verified once, on shingle sets that meet as
blocks. A large component is dealt out by shingle counts and by hash; its pairs
are compared inside the tasks and make no rows unless they are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import kernels
from tidemark.llm.graph import components
from tidemark.session import cut_lineage

TREES = 24
DEPTH = 8

SIGNED = "id {}, digest long, node binary, n_shingles long, signature binary"


def matched_depth(threshold: float, trees: int, recall: float, depth: int) -> int:
    """The longest prefix at which a pair on the threshold meets in some tree
    with at least this chance; 1 if none is that short."""
    for length in range(depth, 0, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    return 1


def text_shingles(words: kernels.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text of a piece, back to back and sorted
    within each, and n + 1 offsets. A text of fewer words is one shingle."""
    counts = np.diff(words.offsets)
    runs = kernels.run_hashes(words.hashes, size)
    whole = np.maximum(counts - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), whole)
    hashes = runs[kernels.repeat_ranges(words.offsets[:-1], whole)]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        held = np.zeros(len(short), dtype=np.uint64)
        for i in range(size - 1):
            more = i < counts[short]
            at = np.minimum(words.offsets[short] + i, len(words.hashes) - 1)
            held = np.where(more, kernels.mix(held * np.uint64(3) + words.hashes[at]), held)
        rows, hashes = np.concatenate((rows, short)), np.concatenate((hashes, held))
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    rows, hashes = rows[new], hashes[new]
    return hashes, np.searchsorted(rows, np.arange(len(counts) + 1))


def signatures(hashes: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """MinHash values of the texts that have shingles: rows by ``length`` uint16."""
    some = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, length), dtype=np.uint16)
    if not len(some):
        return out
    base = (kernels.mix(hashes) >> np.uint64(32)).astype(np.uint32)
    seeds = kernels.mix(np.arange(2 * length, dtype=np.uint64))
    factors, shifts = (seeds[:length] | np.uint64(1)).astype(np.uint32), seeds[length:].astype(np.uint32)
    held = np.empty_like(base)
    for i in range(length):
        np.multiply(base, factors[i], out=held)
        np.add(held, shifts[i], out=held)
        # The winner's value, mixed, so that 16 bits of it tell winners apart.
        out[some, i] = (np.minimum.reduceat(held, offsets[some]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _sign(size: int, length: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in kernels.pieces(batch, "text"):
                hashes, cuts = text_shingles(kernels.words_of(data, offsets), size)
                counts = np.diff(cuts)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(kernels.mix(hashes ^ np.uint64(seed))))) for seed in (1, 2)]
                first, second = (held[cuts[1:]] - held[cuts[:-1]] for held in sums)
                # Texts without words are alike only if equal.
                none = counts == 0
                whole = kernels.range_hashes(kernels.prefix_sums(data), offsets[:-1], offsets[1:])
                first, second = np.where(none, whole, kernels.mix(first)), np.where(none, kernels.mix(whole), kernels.mix(second + counts.astype(np.uint64)))
                raw = np.column_stack((first, second)).astype("<u8").tobytes()
                signed = signatures(hashes, cuts, length)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(rows.schema.get_field_index("id")),
                        rows.column(rows.schema.get_field_index("digest")),
                        pa.array([raw[16 * i : 16 * i + 16] for i in range(rows.num_rows)], pa.binary()),
                        pa.array(counts, pa.int64()),
                        pa.array([None if skip else held.tobytes() for held, skip in zip(signed, none.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["id", "digest", "node", "n_shingles", "signature"],
                )

    return sign


def _grow(trees: int, depth: int, shown: int):
    """For ``mapInArrow``: the key of each tree's first ``shown`` labels."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(batch.schema.get_field_index("node"))
            raw, _ = kernels.text_bytes(batch.column(batch.schema.get_field_index("signature")))
            labels = np.frombuffer(raw.tobytes(), dtype=np.uint16).reshape(batch.num_rows, trees, depth)
            keys = np.zeros((batch.num_rows, trees), dtype=np.uint64) + kernels.mix(np.arange(trees, dtype=np.uint64))
            for level in range(shown):
                keys = kernels.mix(keys + labels[:, :, level])
            spread = nodes.take(pa.array(np.repeat(np.arange(batch.num_rows), trees)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), spread], names=["key", "node"])

    return grow


#: Bits of a sketch for each shingle, at least, and of all.
_BITS_EACH = 4
_LEAST_BITS, _MOST_BITS = 64, 1 << 17


def parities(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A sketch of each set: bits that tell whether an odd number of its values falls
    on them. The sketches of two sets differ in no more bits than the sets differ
    in values. Sizes are powers of two; the halves of a sketch, one on the other,
    are the sketch of half the size."""
    places = kernels.mix(hashes ^ np.uint64(0x5EED))
    out = []
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        bits = min(_MOST_BITS, max(_LEAST_BITS, 1 << (_BITS_EACH * (end - begin) - 1).bit_length()))
        odd = np.bincount((places[begin:end] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """Sketches, one a row, brought down to ``size`` bytes."""
    while sketches.shape[1] > size:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _sketch(size: int):
    """For ``mapInArrow``: the number of shingles and the sketch of every text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in kernels.pieces(batch, "text"):
                hashes, cuts = text_shingles(kernels.words_of(data, offsets), size)
                columns = [rows.column(rows.schema.get_field_index("node")), pa.array(np.diff(cuts), pa.int64()), pa.array(parities(hashes, cuts), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n_shingles", "sketch"])

    return sketch


def _similar(size: int):
    """For ``mapInArrow``: the Jaccard similarity of pairs of texts."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {name: batch.column(batch.schema.get_field_index(name)) for name in ("a", "b", "a_text", "b_text")}
            at = 0
            while at < batch.num_rows:
                # A slice of pairs, of about a piece of text on either side.
                size_of = [kernels.text_bytes(held[name].slice(at))[1] for name in ("a_text", "b_text")]
                end = max(1, min(int(np.searchsorted(bounds, kernels.PIECE_BYTES, "right")) - 1 for bounds in size_of))
                sets = []
                for name in ("a_text", "b_text"):
                    data, offsets = kernels.text_bytes(held[name].slice(at, end))
                    hashes, cuts = text_shingles(kernels.words_of(data, offsets), size)
                    sets.append((hashes, np.repeat(np.arange(end), np.diff(cuts)), np.diff(cuts)))
                hashes = np.concatenate((sets[0][0], sets[1][0]))
                rows = np.concatenate((sets[0][1], sets[1][1]))
                order = np.lexsort((hashes, rows))
                hashes, rows = hashes[order], rows[order]
                both = np.bincount(rows[1:][(hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])], minlength=end)
                union = sets[0][2] + sets[1][2] - both
                value = both / np.maximum(union, 1)
                yield pa.RecordBatch.from_arrays([held["a"].slice(at, end), held["b"].slice(at, end), pa.array(value)], names=["a", "b", "similarity"])
                at += end

    return similar


#: Members of a bucket that meet its leaders in one group.
_MEMBERS = 4096
#: Rows of members that make a task's part.
_PART = 1 << 15
#: Bytes of their sketches.
_PART_BYTES = 1 << 23


def _close(threshold: float):
    """For cogrouped ``applyInArrow``: pairs of members and leaders of a bucket, of
    different components, but for those whose shingle counts or sketches prove them
    to lie below the threshold."""

    def close(key: tuple[pa.Scalar, ...], members: pa.Table, leaders: pa.Table) -> pa.Table:
        def columns(table: pa.Table) -> tuple[dict[str, np.ndarray], dict[int, np.ndarray]]:
            held = {name: table.column(name).to_numpy() for name in ("key", "salt", "node", "weight", "component", "n_shingles")}
            order = np.lexsort((held["salt"], held["key"]))
            raw, offsets = kernels.text_bytes(table.column("sketch"))
            # The sketches of one size are a table; a row has its place there.
            sizes, place, of_size = np.diff(offsets), np.zeros(table.num_rows, dtype=np.int64), {}
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                place[rows] = np.arange(len(rows))
                of_size[size] = raw[offsets[rows][:, None] + np.arange(size)]
            held |= {"size": sizes, "place": place}
            return {name: values[order] for name, values in held.items()}, of_size

        found = []
        if members.num_rows and leaders.num_rows:
            (own, own_sketches), (led, led_sketches) = columns(members), columns(leaders)
            begins = np.flatnonzero(np.append(True, (np.diff(own["key"]) != 0) | (np.diff(own["salt"]) != 0)))
            ends = dict(zip(zip(own["key"][begins].tolist(), own["salt"][begins].tolist(), strict=True), zip(begins.tolist(), np.append(begins[1:], len(own["key"])).tolist(), strict=True), strict=True))
            for i in range(len(led["node"])):
                first, end = ends.get((int(led["key"][i]), int(led["salt"][i])), (0, 0))
                behind = (own["weight"][first:end] < led["weight"][i]) | ((own["weight"][first:end] == led["weight"][i]) & (own["node"][first:end] > led["node"][i]))
                n, counts = led["n_shingles"][i], own["n_shingles"][first:end]
                # A millionth more room than the threshold leaves, against rounding.
                alike = np.minimum(counts, n) >= (threshold - 1e-6) * np.maximum(counts, n)
                at = first + np.flatnonzero(behind & alike & (own["component"][first:end] != led["component"][i]))
                if not len(at):
                    continue
                room = ((1 - threshold) / (1 + threshold) + 1e-6) * (own["n_shingles"][at] + n)
                sketch = led_sketches[int(led["size"][i])][led["place"][i]][None, :]
                for size in np.unique(own["size"][at]).tolist():
                    which = at[own["size"][at] == size]
                    least = min(size, sketch.shape[1])
                    off = folded(own_sketches[size][own["place"][which]], least) ^ folded(sketch, least)
                    passed = which[np.bitwise_count(off).sum(axis=1, dtype=np.int64) <= room[own["size"][at] == size]]
                    found.append(np.column_stack((own["node"][passed], np.full(len(passed), led["node"][i]))))
        pairs = np.unique(np.concatenate([*found, np.zeros((0, 2), dtype=np.int64)]), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return close


#: Texts, and shingles, of a block of a component.
_BLOCK_TEXTS = 1024
_BLOCK_SHINGLES = 1 << 19
#: Columns of a block's table of shingles that are multiplied at once.
_SHARED = 2048

COUNTS, PAIRS = "node long, n_links long", "a long, b long, similarity double"


def _sets(size: int):
    """For ``mapInArrow``: the shingle hashes of every text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in kernels.pieces(batch, "text"):
                hashes, cuts = text_shingles(kernels.words_of(data, offsets), size)
                held = [hashes[a:b].astype("<u8").tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("node")), pa.array(held, pa.binary())], names=["node", "shingles"])

    return sets


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of one list shares with each of the other."""
    values = np.concatenate([*left, *right])
    rows = np.repeat(np.arange(len(left) + len(right)), [len(held) for held in (*left, *right)])
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    column = np.cumsum(np.append(True, values[1:] != values[:-1])[: len(values)]) - 1
    # Values of one side only are shared with nothing.
    n = int(column[-1]) + 1 if len(column) else 0
    first = rows < len(left)
    common = (np.bincount(column[first], minlength=n) > 0) & (np.bincount(column[~first], minlength=n) > 0)
    kept = common[column]
    rows, column, first = rows[kept], (np.cumsum(common) - 1)[column[kept]], first[kept]
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    cuts = np.searchsorted(column, np.arange(0, int(common.sum()) + _SHARED, _SHARED))
    for low, (begin, end) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        sides = [np.zeros((len(held), _SHARED), dtype=np.float32) for held in (left, right)]
        own, at, is_left = rows[begin:end], column[begin:end] - low * _SHARED, first[begin:end]
        sides[0][own[is_left], at[is_left]] = 1
        sides[1][own[~is_left] - len(left), at[~is_left]] = 1
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _linked(threshold: float, as_pairs: bool):
    """For ``groupBy(part).applyInArrow``: the links inside the units of a part, one
    row per node and unit with their number, or one per link."""

    def linked(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names = ("component", "low", "high", "low_salt", "high_salt")
        unit = np.column_stack([table.column(name).to_numpy() for name in names])
        nodes, second = table.column("node").to_numpy(), table.column("second").to_numpy(zero_copy_only=False)
        order = np.lexsort((nodes, second, *unit.T[::-1]))
        unit, nodes, second = unit[order], nodes[order], second[order]
        raw, offsets = kernels.text_bytes(table.column("shingles"))
        begins = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]).any(axis=1)))
        found: list[list[np.ndarray]] = [[], [], []]
        for begin, end in zip(begins.tolist(), np.append(begins[1:], len(nodes)).tolist(), strict=True):
            sets = [np.frombuffer(raw[offsets[i] : offsets[i + 1]].tobytes(), dtype="<u8") for i in order[begin:end].tolist()]
            middle = int(np.searchsorted(second[begin:end], True))
            alone = bool(unit[begin, 1] == unit[begin, 2] and unit[begin, 3] == unit[begin, 4])
            own, other = (sets, sets) if alone else (sets[:middle], sets[middle:])
            if not own or not other:
                continue
            sizes = [np.array([len(held) for held in side]) for side in (own, other)]
            both = overlaps(own, other)
            value = both / np.maximum(sizes[0][:, None] + sizes[1][None, :] - both, 1)
            if alone:
                value = np.triu(value, 1)
            left, right = np.nonzero(value >= threshold)
            held = nodes[begin:end]
            for out, values in zip(found, (held[left], held[right + (0 if alone else middle)], value[left, right]), strict=True):
                out.append(values)
        a, b = (kernels.joined(out, np.int64) for out in found[:2])
        if as_pairs:
            return pa.table({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b)), "similarity": pa.array(kernels.joined(found[2], np.float64))})
        ends, counts = np.unique(np.concatenate((a, b)), return_counts=True)
        return pa.table({"node": pa.array(ends, pa.int64()), "n_links": pa.array(counts, pa.int64())})

    return linked


def component_links(labels: DataFrame, texts: DataFrame, threshold: float, size: int, as_pairs: bool, block_texts: int = _BLOCK_TEXTS, block_shingles: int = _BLOCK_SHINGLES) -> DataFrame:
    """All links between nodes of one component, from rows (node, component,
    n_shingles) and (node, text): rows of COUNTS, or of PAIRS.

    Shingle counts of linked texts differ by the threshold at most, so that a
    large component's texts meet those of their own and the next class of counts.
    A class is dealt into blocks, and each two blocks that may hold links meet once.
    """

    def blocks(texts: Column, shingles: Column) -> Column:
        return F.ceil(F.greatest(texts / block_texts, shingles / block_shingles)).cast("int")

    whole = labels.groupBy("component").agg(blocks(F.count("*"), F.sum("n_shingles")).alias("blocks"))
    # A little wider than the threshold, against rounding.
    step = max(1e-9, -math.log(threshold) * (1 + 1e-6))
    kind = F.when(F.col("blocks") > 1, F.floor(F.log("n_shingles") / step)).otherwise(0).cast("int").alias("kind")
    placed = labels.join(whole, "component").select("node", "component", "n_shingles", kind)
    dealt = placed.groupBy("component", "kind").agg(blocks(F.count("*"), F.sum("n_shingles")).alias("salts"))
    near = {move: dealt.select("component", (F.col("kind") + move).alias("kind"), F.col("salts").alias(name)) for move, name in ((1, "below"), (-1, "above"))}
    placed = placed.join(dealt, ["component", "kind"]).join(near[1], ["component", "kind"], "left").join(near[-1], ["component", "kind"], "left")
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))

    def units(count: Column, low: Column, high: Column, salts: Callable[[Column], tuple[Column, Column, Column]]) -> Column:
        def unit(other: Column) -> Column:
            low_salt, high_salt, second = salts(other)
            return F.struct(low.alias("low"), high.alias("high"), low_salt.alias("low_salt"), high_salt.alias("high_salt"), second.alias("second"))

        return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), unit)

    own, salt = F.col("kind"), F.col("salt")
    met = F.concat(
        units(F.col("salts"), own, own, lambda other: (F.least(salt, other), F.greatest(salt, other), salt > other)),
        units(F.col("above"), own, own + 1, lambda other: (salt, other, F.lit(False))),
        units(F.col("below"), own - 1, own, lambda other: (other, salt, F.lit(True))),
    )
    unit = placed.select("node", "component", F.explode(met).alias("unit")).select("node", "component", "unit.*")
    parts = max(1, labels.sparkSession.sparkContext.defaultParallelism, -(-(labels.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).collect()[0].n) // _BLOCK_SHINGLES))
    part = F.pmod(F.xxhash64("component", "low", "high", "low_salt", "high_salt"), F.lit(parts)).alias("part")
    sets = texts.join(labels.select("node"), "node").select("node", "text").mapInArrow(_sets(size), "node long, shingles binary")
    found = unit.join(sets, "node").select(part, "node", "component", "low", "high", "low_salt", "high_salt", "second", "shingles").groupBy("part").applyInArrow(_linked(threshold, as_pairs), PAIRS if as_pairs else COUNTS)
    return found if as_pairs else found.groupBy("node").agg(F.sum("n_links").alias("n_links"))


class _Join:
    def __init__(self, members: DataFrame, sketches: DataFrame, texts: DataFrame, threshold: float, size: int) -> None:
        self.members, self.sketches, self.texts, self.threshold, self.size = members, sketches, texts, threshold, size
        held = members.join(sketches, "node").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("sketch")), F.lit(0)).alias("bytes")).collect()[0]
        self.parts = max(1, -(-held.n // _PART), -(-held.bytes // _PART_BYTES))
        self.tested: DataFrame | None = None
        self.labels: DataFrame | None = None

    def verify(self, pairs: DataFrame) -> None:
        """Test pairs (a, b) that have not been tested, and join what holds."""
        if self.tested is not None:
            pairs = pairs.join(self.tested.select("a", "b"), ["a", "b"], "left_anti")
        sides = [self.texts.select(F.col("node").alias(name), F.col("text").alias(f"{name}_text")) for name in ("a", "b")]
        judged = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "a_text", "b_text").mapInArrow(_similar(self.size), "a long, b long, similarity double")
        new = cut_lineage(judged.withColumn("linked", F.col("similarity") >= self.threshold), "pairs")
        self.tested = new if self.tested is None else self.tested.unionByName(new)
        found = new.where("linked").select("a", "b")
        if found.limit(1).count():
            self.relabel(found)

    def relabel(self, found: DataFrame) -> None:
        """Join the components that new links connect."""
        if self.labels is None:
            self.labels = cut_lineage(components(found), "labels")
            return
        # Links run between components: these are the nodes now, few as they are.
        for name in ("a", "b"):
            known = self.labels.select(F.col("node").alias(name), "component")
            found = found.join(known, name, "left").withColumn(name, F.coalesce("component", name)).drop("component")
        moved = cut_lineage(components(found), "moved")
        after = self.labels.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
        fresh = moved.join(self.labels.select("node"), "node", "left_anti")
        self.labels = cut_lineage(after.select("node", F.coalesce("to", "component").alias("component")).unionByName(fresh), "labels")

    def links(self) -> DataFrame:
        return self.tested.where("linked")

    def active(self) -> DataFrame:
        """Members of buckets that hold several components."""
        held = self.members
        if self.labels is not None:
            held = held.join(self.labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        else:
            held = held.withColumn("component", F.col("node"))
        mixed = held.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")).where("least <> most").select("key", "n")
        return cut_lineage(held.join(mixed, "key"), "active")

    def led(self, active: DataFrame, low: int, high: int) -> DataFrame:
        """Pairs of the members that lead from rank ``low + 1`` to ``high`` with later
        members of other components, as far as their sketches leave them a chance.

        A large bucket is dealt out, and its leaders go to every part of it.
        """
        order = Window.partitionBy("key").orderBy(F.desc("weight"), "node")
        leaders = active.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= high).where(F.col("rank") > low).drop("rank")
        salts = F.ceil(F.col("n") / _MEMBERS).cast("int")
        dealt = [
            active.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")),
            leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))),
        ]
        part = F.pmod(F.xxhash64("key", "salt"), F.lit(self.parts)).alias("part")
        # Renamed to themselves, so that the two sides have columns of their own.
        names = [F.col(name).alias(name) for name in ("key", "salt", "node", "weight", "component", "n_shingles", "sketch")]
        sides = [side.join(self.sketches, "node").select(*names, part).groupBy("part") for side in dealt]
        return sides[0].cogroup(sides[1]).applyInArrow(_close(self.threshold), "a long, b long")


def join_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5, trees: int = TREES, depth: int = DEPTH, recall: float = 0.99
) -> tuple[DataFrame, DataFrame]:
    """Members and joining links, as ``join_all`` has them, without the other links."""
    return join_all(docs, id_col, text_col, threshold, size, trees, depth, recall)[:2]


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Members as ``join_all`` has them, with null for n_links: links are not counted."""
    return join_all(docs, id_col, text_col, counted=False)[0]


def join_all(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5, trees: int = TREES, depth: int = DEPTH, recall: float = 0.99, counted: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, joining links and all links of the join.

    Members: one row per row of ``docs``: id, digest (xxhash64 of the text), node
    (the number of its shingle set, null without words), n_shingles, class_id (the
    smallest id of the component), n_links (the other nodes of its component that
    are as similar as the threshold or more). Links: pairs of nodes (a, b) with their
    similarity, at the threshold or above; the joining links are those that
    settled the components, all links every such pair of a component.

    Words are maximal runs of ASCII letters, digits and non-ASCII characters after
    lower-casing A-Z; fewer than ``size`` words are one shingle. Null text counts as
    empty. Texts without words are in one class only if they are equal. Rows
    without an id are left alone, with a null class. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    signed = cut_lineage(rows.mapInArrow(_sign(size, trees * depth), SIGNED.format(kind)), "signed")
    known = signed.where("id IS NOT NULL")
    nodes = known.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("id", "digest")).alias("first"), F.min_by("signature", "id").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    # A number stands for the node from here on; it is fixed once written.
    nodes = cut_lineage(nodes.withColumnRenamed("node", "name").withColumn("node", F.monotonically_increasing_id()), "nodes")
    # Shortened from the full depth until the recall is met.
    shown = matched_depth(threshold, trees, recall, depth)
    keys = nodes.select("node", "signature").mapInArrow(_grow(trees, depth, shown), "key long, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = cut_lineage(keys.join(shared, "key").select("key", "node", "n"), "buckets")
    # Texts that meet many others lead: the origin of a group meets all its copies.
    weights = cut_lineage(buckets.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    members = cut_lineage(buckets.select("key", "node").join(weights, "node"), "members")
    # One text for each node that has a candidate: that of its smallest id.
    drawn = nodes.select("node", "first.id", "first.digest").join(weights.select("node"), "node")
    texts = rows.where("id IS NOT NULL").join(drawn, ["id", "digest"]).groupBy("node").agg(F.first("text").alias("text"))
    texts = cut_lineage(texts, "texts")
    sketches = texts.select("node", "text").mapInArrow(_sketch(size), "node long, n_shingles long, sketch binary")
    held = _Join(members, cut_lineage(sketches, "sketches"), texts, threshold, size)

    active = held.active()
    best = held.led(active, 0, 1).groupBy("a", "b").agg(F.count("*").alias("n")).groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    held.verify(best)
    low, high = 0, 1
    while True:
        active = held.active()
        if low and not active.where(F.col("n") > low).limit(1).count():
            break
        held.verify(held.led(active, low, high).distinct())
        low, high = high, high * 16

    links = held.links().select("a", "b", "similarity")
    joined = held.labels if held.labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    sized = joined.join(nodes.select("node", "n_shingles"), "node")
    sized = cut_lineage(sized, "sized")
    counts, pairs = (component_links(sized, held.texts, threshold, size, as_pairs) for as_pairs in (False, True))
    if not counted:
        counts = counts.limit(0)
    labels = nodes.select("name", "node").join(counts, "node", "left").join(joined, "node", "left")
    labels = labels.select("name", "node", F.coalesce("component", "node").alias("component"), (F.coalesce("n_links", F.lit(0)) if counted else F.lit(None)).cast("long").alias("n_links"))
    firsts = nodes.select("node", F.col("first.id").alias("first"))
    classes = labels.join(firsts, "node").groupBy("component").agg(F.min("first").alias("class_id"))
    named = labels.join(classes, "component").select("name", F.col("node").alias("number"), "class_id", "n_links")
    columns = ["id", "digest", "number", "n_shingles", "class_id", "n_links"]
    out = known.where("n_shingles > 0").join(named, F.col("node") == F.col("name")).select(*columns)
    # Equal texts without words.
    bare = known.where("n_shingles = 0")
    alike = bare.groupBy(F.col("node").alias("name")).agg(F.min("id").alias("class_id"))
    bare = bare.join(alike, F.col("node") == F.col("name"))
    left = signed.where("id IS NULL").withColumn("class_id", F.lit(None).cast(kind))
    none = [F.lit(None).cast("long").alias("number"), F.lit(0 if counted else None).cast("long").alias("n_links")]
    for rest in (bare, left):
        out = out.unionByName(rest.select("id", "digest", "n_shingles", "class_id", *none))
    return out.withColumnRenamed("number", "node"), links, pairs


def one_of_each(docs: DataFrame, members: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class: of each class the smallest
    id, and of rows that repeat it one. Rows without an id stay."""
    chosen = members.where("class_id IS NOT NULL").groupBy("class_id").agg(F.min(F.struct("id", "digest")).alias("row")).select(F.col("row.id").alias("__id"), F.col("row.digest").alias("__digest"))
    given = docs.withColumn("__own", F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    kept = given.join(chosen, (given[id_col] == F.col("__id")) & (F.col("__own") == F.col("__digest")))
    once = kept.withColumn("__row", F.row_number().over(Window.partitionBy("__id", "__digest").orderBy(F.lit(1)))).where("__row = 1")
    return once.select(*docs.columns).unionByName(docs.where(docs[id_col].isNull()))

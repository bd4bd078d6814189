"""Exact top-k search by inner product, by branch and bound over ball trees.

Vectors are dealt out to shards of like size near a pivot, and every shard holds
a ball tree: each node has the centre and radius of its vectors, so the product
of a query with any of them is at most the product with the centre and the
query's length times the radius. Queries travel in blocks. A block first
searches one shard of its own pivot, which gives each query a k-th score; it
then visits the shards whose root may still beat the k-th score of some query,
best bound first, carrying the scores from shard to shard. Within a shard a heap
orders the nodes by their bound; a node is left out for the queries whose k-th
score it cannot beat.

The components are whole numbers, so products are exact: in single precision
while all partial sums stay below 2**24, in double below 2**53, and in whole
numbers of any size beyond. Bounds are raised by more than their rounding.

Nothing is cut: pivots only decide where a vector lies, every shard whose bound
does not rule it out is visited, and copies of one vector are dealt out like any
others. The driver holds the pivots and their counts, at most ``MOST_PIVOTS``.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

SHARD_ROWS = 4096
LEAF_ROWS = 256
BLOCK_QUERIES = 256
#: Pivots are that many vectors of least hash at most; more vectors make more shards a pivot.
MOST_PIVOTS = 1024
#: Shard roots that a block of queries is compared with at once.
_ROOTS = 512
#: Shards of a lane, and lanes of a block of queries: lanes are searched side by side.
_LANE_SHARDS = 64
_MOST_LANES = 64
_NONE = -(1 << 63)


def whole_vectors(frame: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Rows (id, x): floor(scale * component) as longs. Rows without an id, and
    vectors that are null or hold null or non-finite components, are left out."""
    vector = frame[vector_col].cast("array<double>")
    rows = frame.select(frame[id_col].cast("long").alias("id"), vector.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(~bad).select("id", F.transform("v", lambda c: F.floor(c * float(scale)).cast("long")).alias("x"))


@dataclass(frozen=True)
class _Shape:
    size: int
    #: Storage of one component.
    kind: str

    def unpack(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, dtype=self.kind).reshape(-1, self.size)


def _shape(rows: DataFrame) -> tuple[int, _Shape]:
    extent = F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))
    held = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("size"), F.max(extent).alias("most")).collect()[0]
    most = held.most or 0
    kind = next((kind for kind in ("int8", "int16", "int32") if most <= np.iinfo(kind).max), "int64")
    return held.n, _Shape(max(held.size or 0, 1), kind)


def _matrix(column: pa.ChunkedArray | pa.Array, shape: _Shape) -> np.ndarray:
    """Vectors of a column as rows; short ones are filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), shape.size), dtype=shape.kind)
    out[np.arange(shape.size) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors, exact, as longs. Every partial sum is at
    most the product of the lengths."""
    if not len(left) or not len(right):
        return np.zeros((len(left), len(right)), dtype=np.int64)
    size = math.sqrt(float((left.astype(np.float64) ** 2).sum(axis=1).max()) * float((right.astype(np.float64) ** 2).sum(axis=1).max())) * 1.001
    kind = np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else object
    return (left.astype(kind) @ right.astype(kind).T).astype(np.int64)


def _assign(pivots: np.ndarray, shape: _Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    own = pivots.astype(np.float64)
    squares = (own**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), shape)
            nearest = (squares - 2.0 * (x.astype(np.float64) @ own.T)).argmin(axis=1) if len(x) else np.zeros(0, dtype=np.int64)
            packed = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed, pa.array(nearest, pa.int64())], names=["id", "x", "pivot"])

    return run


@dataclass(frozen=True)
class _Tree:
    """A ball tree over the rows of one shard; children of node i are 2i + 1 and 2i + 2."""

    ids: np.ndarray
    x: np.ndarray
    #: Rows of node i; none where there is no such node.
    spans: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    least: np.ndarray


def _grow(ids: np.ndarray, x: np.ndarray, leaf: int) -> _Tree:
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    points = x.astype(np.float64)
    depth = max(0, math.ceil(math.log2(max(1, len(ids)) / leaf)))
    n = (1 << (depth + 1)) - 1
    spans = np.zeros((n, 2), dtype=np.int64)
    centres, radii, least = np.zeros((n, x.shape[1])), np.zeros(n), np.zeros(n, dtype=np.int64)
    place = np.arange(len(ids))
    waiting = [(0, 0, len(ids))]
    while waiting:
        node, low, high = waiting.pop()
        own = points[place[low:high]]
        centre = own.mean(axis=0)
        apart = ((own - centre) ** 2).sum(axis=1)
        spans[node], centres[node], least[node] = (low, high), centre, ids[place[low:high]].min()
        radii[node] = math.sqrt(apart.max()) * (1 + 1e-9)
        if high - low <= leaf or not apart.any() or 2 * node + 2 >= n:
            continue
        # Along the line between two far points, halves are compact.
        far = own[apart.argmax()]
        other = own[((own - far) ** 2).sum(axis=1).argmax()]
        along = np.argsort(own @ (other - far), kind="stable")
        place[low:high] = place[low:high][along]
        middle = (low + high) // 2
        waiting += [(2 * node + 1, low, middle), (2 * node + 2, middle, high)]
    return _Tree(ids[place], x[place], spans, centres, radii, least)


_SHARD = "shard long, ids binary, x binary, spans binary, centres binary, radii binary, least binary"
_PARTS = ("ids", "x", "spans", "centres", "radii", "least")


def _build(shape: _Shape, leaf: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        x = shape.unpack(b"".join(table.column("x").to_pylist()))
        tree = _grow(table.column("id").to_numpy(), x, leaf)
        values = [getattr(tree, name).tobytes() for name in _PARTS]
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), **{name: pa.array([value], pa.binary()) for name, value in zip(_PARTS, values, strict=True)}})

    return run


def _tree(row: dict, shape: _Shape) -> _Tree:
    longs = {name: np.frombuffer(row[name], dtype=np.int64) for name in ("ids", "spans", "least")}
    centres = np.frombuffer(row["centres"], dtype=np.float64).reshape(-1, shape.size)
    return _Tree(longs["ids"], shape.unpack(row["x"]), longs["spans"].reshape(-1, 2), centres, np.frombuffer(row["radii"], dtype=np.float64), longs["least"])


class _Block:
    """Queries and their best so far."""

    def __init__(self, number: int, ids: np.ndarray, x: np.ndarray, scores: np.ndarray, found: np.ndarray) -> None:
        self.number, self.ids, self.x, self.scores, self.found = number, ids, x, scores, found
        self.points = x.astype(np.float64)
        self.lengths = np.sqrt((self.points**2).sum(axis=1))

    def may_beat(self, centre: np.ndarray, radius: float, least: int, rows: np.ndarray) -> tuple[np.ndarray, float]:
        """Which queries a ball may still serve, and its largest bound."""
        bound = self.points[rows] @ centre + self.lengths[rows] * radius
        bound += 1e-9 * (np.abs(bound) + self.lengths[rows] * (radius + math.sqrt(float(centre @ centre)))) + 1e-6
        last, last_id = self.scores[rows, -1], self.found[rows, -1]
        # A product is whole: one that ties needs a smaller id.
        top = np.floor(bound)
        kept = (top > last) | ((top == last) & (least < last_id)) | (last == _NONE)
        return rows[kept], float(bound.max(initial=-math.inf))

    def offer(self, rows: np.ndarray, ids: np.ndarray, products: np.ndarray) -> None:
        last, last_id = self.scores[rows, -1][:, None], self.found[rows, -1][:, None]
        better = ((products > last) | ((products == last) & (ids[None, :] < last_id))) & (ids[None, :] != self.ids[rows][:, None])
        at, which = np.nonzero(better)
        if not len(at):
            return
        k = self.scores.shape[1]
        touched = np.unique(at)
        owner = np.concatenate([np.repeat(touched, k), at])
        scores = np.concatenate([self.scores[rows[touched]].ravel(), products[at, which]])
        found = np.concatenate([self.found[rows[touched]].ravel(), ids[which]])
        # Not by the negative: the least long has none.
        order = np.lexsort((found, ~scores, owner))
        owner, scores, found = owner[order], scores[order], found[order]
        first = np.searchsorted(owner, touched)
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        top = place < k
        self.scores[rows[owner[top]], place[top]] = scores[top]
        self.found[rows[owner[top]], place[top]] = found[top]

    def search(self, tree: _Tree) -> None:
        rows, bound = self.may_beat(tree.centres[0], tree.radii[0], int(tree.least[0]), np.arange(len(self.ids)))
        heap = [(-bound, 0, rows)]
        while heap:
            _, node, rows = heapq.heappop(heap)
            rows, _ = self.may_beat(tree.centres[node], tree.radii[node], int(tree.least[node]), rows)
            if not len(rows):
                continue
            children = [child for child in (2 * node + 1, 2 * node + 2) if child < len(tree.spans) and tree.spans[child, 1] > tree.spans[child, 0]]
            if not children:
                low, high = tree.spans[node]
                self.offer(rows, tree.ids[low:high], _products(self.x[rows], tree.x[low:high]))
            for child in children:
                kept, bound = self.may_beat(tree.centres[child], tree.radii[child], int(tree.least[child]), rows)
                if len(kept):
                    heapq.heappush(heap, (-bound, child, kept))


_BLOCK = "block long, q_ids binary, q_x binary, scores binary, found binary"


def _pack(shape: _Shape, k: int) -> Callable[[pa.Table], pa.Table]:
    """Queries of one block to one row without anything found."""

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        values = {
            "q_ids": table.column("id").to_numpy().tobytes(),
            "q_x": b"".join(table.column("x").to_pylist()),
            "scores": np.full((n, k), _NONE, dtype=np.int64).tobytes(),
            "found": np.full((n, k), (1 << 63) - 1, dtype=np.int64).tobytes(),
        }
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), **{name: pa.array([value], pa.binary()) for name, value in values.items()}})

    return run


def _block(row: dict, shape: _Shape, k: int) -> _Block:
    scores, found = (np.frombuffer(row[name], dtype=np.int64).reshape(-1, k).copy() for name in ("scores", "found"))
    return _Block(row["block"], np.frombuffer(row["q_ids"], dtype=np.int64), shape.unpack(row["q_x"]), scores, found)


def _visit(shape: _Shape, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams blocks of queries, each followed by its shards, best bound first."""

    def packed(block: _Block) -> pa.RecordBatch:
        values = [block.ids.tobytes(), block.x.tobytes(), block.scores.tobytes(), block.found.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([block.number], pa.int64()), *(pa.array([value], pa.binary()) for value in values)], names=["block", "q_ids", "q_x", "scores", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["q_ids"] is not None:
                    if block is not None:
                        yield packed(block)
                    block = _block(row, shape, k)
                else:
                    block.search(_tree(row, shape))
        if block is not None:
            yield packed(block)

    return run


def _needed(shape: _Shape, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of queries beside blocks of shard roots: the shards that may still serve a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = _block(row, shape, k)
                every = np.arange(len(block.ids))
                centres = np.frombuffer(row["centres"], dtype=np.float64).reshape(-1, shape.size)
                for shard, centre, radius, least in zip(row["shards"], centres, row["radii"], row["least"], strict=True):
                    rows, bound = block.may_beat(centre, radius, least, every)
                    if len(rows) and shard != row["home"]:
                        out.append((row["block"], shard, bound))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["block", "shard", "bound"])

    return run


def _roots(shape: _Shape) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        centres = b"".join(value[: 8 * shape.size] for value in table.column("centres").to_pylist())
        radii = [float(np.frombuffer(value[:8])[0]) for value in table.column("radii").to_pylist()]
        least = [int(np.frombuffer(value[:8], dtype=np.int64)[0]) for value in table.column("least").to_pylist()]
        return pa.table(
            {
                "part": pa.array([table.column("part")[0].as_py()], pa.int64()),
                "shards": pa.array([table.column("shard").to_pylist()], pa.list_(pa.int64())),
                "centres": pa.array([centres], pa.binary()),
                "radii": pa.array([radii], pa.list_(pa.float64())),
                "least": pa.array([least], pa.list_(pa.int64())),
            }
        )

    return run


def _merge(k: int) -> Callable[[pa.Table], pa.Table]:
    """The lanes of one block of queries, beside what they began with, to its answers."""

    def run(table: pa.Table) -> pa.Table:
        ids = np.frombuffer(table.column("q_ids")[0].as_py(), dtype=np.int64)
        begun = table.column("begun").to_pylist()
        scores, found = ([np.frombuffer(value, dtype=np.int64).reshape(-1, k).tolist() for value in table.column(name).to_pylist()] for name in ("scores", "found"))
        query, rank, vector, score = [], [], [], []
        for i, own in enumerate(ids.tolist()):
            held = [Counter((-s, f) for s, f in zip(scores[lane][i], found[lane][i], strict=True) if s != _NONE) for lane in range(len(begun))]
            first = held[begun.index(True)]
            best = first.copy()
            for lane, pairs in enumerate(held):
                if not begun[lane]:
                    best += pairs - first
            for place, (s, f) in enumerate(sorted(best.elements())[:k], 1):
                query.append(own)
                rank.append(place)
                vector.append(f)
                score.append(-s)
        return pa.table({"query_id": pa.array(query, pa.int64()), "rank": pa.array(rank, pa.int32()), "vec_id": pa.array(vector, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def _parts(assigned: DataFrame, most: int) -> DataFrame:
    """Per pivot: how many parts of at most about ``most`` rows, and the number of its first one."""
    counts = sorted((row.pivot, -(-row.n // most)) for row in assigned.groupBy("pivot").agg(F.count("*").alias("n")).collect())
    firsts, rows = 0, []
    for pivot, parts in counts:
        rows.append((pivot, parts, firsts))
        firsts += parts
    return F.broadcast(assigned.sparkSession.createDataFrame(rows, "pivot long, parts long, first long"))


def search_top(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    shard_rows: int = SHARD_ROWS,
    leaf_rows: int = LEAF_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The k rows of largest inner product for every query row: query_id, rank
    (from 1), vec_id, score. Components are floor(``scale`` * component).

    ``is_query`` is a condition on the column ``id``. A query's candidates are the
    rows of every other id; equal scores go to the smaller id, and fewer than k
    candidates are all returned. Rows without an id, and vectors that are null or
    hold null or non-finite components, take no part. Vectors shorter than the
    longest count as filled up with zeros. Repeated rows are each a row; a
    repeated query row answers each time. Scores past 64 bits raise an error. An
    empty table gives an empty one; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col, scale)
    n, shape = _shape(rows)
    pivots = rows.orderBy(F.xxhash64("x"), "id").limit(max(1, min(MOST_PIVOTS, -(-n // shard_rows)))).collect()
    places = np.zeros((max(1, len(pivots)), shape.size), dtype=shape.kind)
    for i, row in enumerate(pivots):
        places[i, : len(row.x)] = row.x
    assigned = rows.mapInArrow(_assign(places, shape), "id long, x binary, pivot long").withColumn("row", F.monotonically_increasing_id())
    assigned = cut_lineage(assigned, "vectors")
    part = F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))
    homes = _parts(assigned, shard_rows)
    placed = assigned.join(homes, "pivot").withColumn("shard", part)
    shards = cut_lineage(placed.select("shard", "id", "x").groupBy("shard").applyInArrow(_build(shape, leaf_rows), _SHARD), "shards")

    asked = assigned.where(is_query)
    grouped = asked.join(_parts(asked, block_queries), "pivot").withColumn("block", part)
    blocks = grouped.select("block", "id", "x").groupBy("block").applyInArrow(_pack(shape, k), _BLOCK)
    home = grouped.groupBy("block").agg(F.first("pivot").alias("pivot")).join(homes, "pivot").select("block", F.col("first").alias("home"))
    blocks = blocks.join(home, "block")

    def visited(visits: DataFrame, heads: DataFrame) -> DataFrame:
        """``visits``: block, lane, shard, bound; ``heads``: the blocks, one a lane."""
        both = heads.select("block", "lane", "q_ids", "q_x", "scores", "found").unionByName(visits.join(shards, "shard").drop("shard"), allowMissingColumns=True)
        ordered = both.repartition("block", "lane").sortWithinPartitions(F.col("block"), F.col("lane"), F.col("q_ids").isNull(), F.col("bound").desc())
        return ordered.mapInArrow(_visit(shape, k), _BLOCK)

    alone = F.lit(0).cast("long").alias("lane")
    at_home = blocks.select("block", alone, F.col("home").alias("shard"), F.lit(0.0).alias("bound"))
    begun = visited(at_home, blocks.withColumn("lane", alone)).join(home, "block")
    begun = cut_lineage(begun, "begun")
    n_shards = shards.count()
    parts = max(1, -(-n_shards // _ROOTS))
    roots = shards.select((F.pmod(F.xxhash64("shard"), F.lit(parts))).cast("long").alias("part"), "shard", "centres", "radii", "least").groupBy("part")
    roots = roots.applyInArrow(_roots(shape), "part long, shards array<long>, centres binary, radii array<double>, least array<long>")
    beside = begun.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(roots, "part")
    lanes = min(_MOST_LANES, max(1, -(-n_shards // _LANE_SHARDS)))
    needed = beside.mapInArrow(_needed(shape, k), "block long, shard long, bound double").withColumn("lane", F.pmod(F.xxhash64("shard"), F.lit(lanes)).cast("long"))
    needed = cut_lineage(needed, "visits")
    lanes_of = needed.select("block", "lane").distinct()
    searched = visited(needed, begun.join(lanes_of, "block"))
    # A block whose home shard settled it has no lane.
    ended = searched.withColumn("begun", F.lit(False)).unionByName(begun.drop("home").withColumn("begun", F.lit(True)))
    return ended.groupBy("block").applyInArrow(_merge(k), "query_id long, rank int, vec_id long, score long")

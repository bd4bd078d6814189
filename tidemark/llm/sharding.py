"""Shards by a k-d tree over the metadata of documents.

A node of the tree is split where its weight in bytes divides, along the
dimension in which it is widest, until every leaf holds one shard's bytes. The
weighted medians are found by histograms: one aggregate a round gives every
node of a level the weight per cell of its key range, and the cell that holds
the median is the next round's range. Only cells come to the driver.

Equal texts are one point of the tree, so they stay in one shard. Only a group
heavier than ``tolerance`` of a shard may be divided, by the order of its ids;
there are at most shards / tolerance of those, and only they have a row each at
the driver. Numbers within shards and groups come from range partitions and
their counts, so no shard or group meets in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import cut_lineage

#: Cells of a histogram round.
CELLS = 1024
#: Groups of a cell that may come to the driver one by one.
FEW = 4096
_LEVELS = (1 << 20) - 1


def numbered(frame: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """All columns and ``name``: 0, 1, 2... within each value of ``by``, in order.

    Rows are dealt out by ranges of (by, order); a row's number is its place in
    its range and the counts of the ranges before. ``by`` has few values: the
    counts have one row for each range and value.
    """
    ranged = frame.repartitionByRange(by, *order).withColumn("__part", F.spark_partition_id())
    held = cut_lineage(ranged, "ranges")
    counts = held.groupBy(by, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(by).alias("__by"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy("__part", by).orderBy(*order)) - 1
    placed = held.withColumn("__local", local)
    joined = placed.join(F.broadcast(starts), (F.col("__part") == F.col("__p")) & (F.col(by) == F.col("__by")))
    return joined.withColumn(name, (F.col("__start") + F.col("__local")).cast("long")).drop("__part", "__p", "__by", "__start", "__local")


@dataclass(frozen=True)
class _Piece:
    """Members first to last - 1 of a heavy group, in id order."""

    group: int
    keys: tuple[int, ...]
    first: int
    last: int
    size: int
    node: int

    @property
    def weight(self) -> int:
        return (self.last - self.first) * self.size


@dataclass
class _Node:
    number: int
    shards: int
    #: First of the shards below it.
    shard: int
    weight: int = 0
    dimension: int = 0
    low: int = 0
    high: int = 0
    before: int = 0
    #: Groups in the key range, where known.
    groups: int = FEW + 1
    #: Light groups with a key below this go left.
    cut: int = 0


def _unit(value: Column, low: float, high: float) -> Column:
    return F.lit(0.0) if high <= low else (value - low) / (high - low)


def _group_table(slim: DataFrame, dimensions: list[str]) -> DataFrame:
    """One row per text: group, size, n, keys (one a dimension)."""
    made = slim.groupBy("group", "size").agg(F.count("*").alias("n"), *(F.min(name).alias(name) for name in dimensions))
    extent = slim.agg(F.min(F.log("size")).alias("low"), F.max(F.log("size")).alias("high")).collect()[0]
    low, high = extent.low or 0.0, extent.high or 0.0
    parts = [_unit(F.log("size"), low, high), *(F.when(F.col(name).isNull(), 0.0).otherwise(F.crc32(name) / float(1 << 32)) for name in dimensions)]
    tie = F.col("group").bitwiseAND(F.lit((1 << 32) - 1))
    keys = [F.shiftleft(F.floor(part * _LEVELS).cast("long"), 32) + tie for part in parts]
    return cut_lineage(made.select("group", "size", "n", F.array(*keys).alias("keys")), "groups")


def _spread(key: int) -> int:
    return key >> 32


class _Tree:
    def __init__(self, groups: DataFrame, shards: int, tolerance: float) -> None:
        spark = groups.sparkSession
        self.spark, self.groups = spark, groups
        total = groups.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("w")).collect()[0].w
        least = max(1, int(tolerance * total / shards))
        heavy = groups.where((F.col("size") * F.col("n") > least) & (F.col("n") > 1))
        self.pieces = [_Piece(row.group, tuple(row["keys"]), 0, row.n, row.size, 0) for row in heavy.collect()]
        self.light = groups.where((F.col("size") * F.col("n") <= least) | (F.col("n") == 1)).withColumn("node", F.lit(0))
        self.size = len(groups.select("keys").schema) and (len(groups.first()["keys"]) if total else 1)
        self.nodes = [_Node(0, shards, 0)]
        while any(node.shards > 1 for node in self.nodes):
            self._level()

    def _table(self, nodes: list[_Node]) -> DataFrame:
        """The open nodes as rows; there are fewer of them than shards."""
        rows = [(node.number, node.dimension, node.low, node.high, node.cut) for node in nodes]
        return F.broadcast(self.spark.createDataFrame(rows, "node int, dimension int, low long, high long, cut long"))

    def _measure(self, nodes: list[_Node]) -> None:
        """Weight, widest dimension and its key range of every node."""
        bounds = [f(F.col("keys")[i]).alias(f"{name}{i}") for i in range(self.size) for name, f in (("low", F.min), ("high", F.max))]
        rows = {row.node: row for row in self.light.groupBy("node").agg(F.sum(F.col("size") * F.col("n")).alias("w"), *bounds).collect()}
        for node in nodes:
            row, own = rows.get(node.number), [piece for piece in self.pieces if piece.node == node.number]
            node.weight = (row.w if row else 0) + sum(piece.weight for piece in own)
            ranges = []
            for i in range(self.size):
                keys = [piece.keys[i] for piece in own] + ([row[f"low{i}"], row[f"high{i}"]] if row else [])
                ranges.append((min(keys, default=0), max(keys, default=0)))
            node.dimension = max(range(self.size), key=lambda i: (_spread(ranges[i][1]) - _spread(ranges[i][0]), -i))
            node.low, node.high = ranges[node.dimension]
            node.high += 1
            node.before = 0

    def _level(self) -> None:
        split = [node for node in self.nodes if node.shards > 1]
        self._measure(split)
        goals = {node.number: node.weight * (node.shards // 2) / node.shards for node in split}
        searched = [node for node in split if node.high - node.low > 1]
        while searched:
            few = [node for node in searched if node.groups <= FEW]
            if few:
                self._finish(few, goals)
            many = [node for node in searched if node.groups > FEW]
            if many:
                self._narrow(many, goals)
            searched = [node for node in many if node.high - node.low > 1]
        at_key = {spot: w for spot, (w, _) in self._weights(split, cells=1).items()}
        moves: dict[int, tuple[int, int]] = {}
        for node in split:
            heavy = [piece for piece in self.pieces if piece.node == node.number and piece.keys[node.dimension] == node.low]
            light = at_key.get((node.number, 0), 0)
            missing = goals[node.number] - node.before
            # The light groups on the median go to the nearer side, heavy ones are divided.
            node.cut = node.low + 1 if light and light / 2 <= missing else node.low
            missing -= light if node.cut > node.low else 0
            for piece in sorted(heavy, key=lambda piece: piece.group):
                taken = min(piece.last - piece.first, max(0, round(missing / piece.size)))
                moves[id(piece)] = (taken, 0)
                missing -= taken * piece.size
        self._divide(split, moves)

    def _inside(self, nodes: list[_Node]) -> tuple[DataFrame, Column]:
        """Light groups in the key ranges of the nodes, and their key."""
        key = F.get(F.col("keys"), F.col("dimension"))
        return self.light.join(self._table(nodes), "node").where((key >= F.col("low")) & (key < F.col("high"))), key

    def _weights(self, nodes: list[_Node], cells: int) -> dict[tuple[int, int], tuple[int, int]]:
        """Weight and number of the light groups per node and cell of its key range."""
        inside, key = self._inside(nodes)
        cell = F.floor((key - F.col("low")) * cells / (F.col("high") - F.col("low"))).cast("int") if cells > 1 else F.lit(0)
        rows = inside.groupBy("node", cell.alias("cell")).agg(F.sum(F.col("size") * F.col("n")).alias("w"), F.count("*").alias("n")).collect()
        return {(row.node, row.cell): (row.w, row.n) for row in rows}

    def _finish(self, nodes: list[_Node], goals: dict[int, float]) -> None:
        """The median key itself, where the range holds few groups."""
        inside, key = self._inside(nodes)
        rows = inside.select("node", key.alias("key"), (F.col("size") * F.col("n")).alias("w")).collect()
        for node in nodes:
            held: dict[int, int] = {}
            for row in rows:
                if row.node == node.number:
                    held[row.key] = held.get(row.key, 0) + row.w
            for piece in self.pieces:
                if piece.node == node.number and node.low <= piece.keys[node.dimension] < node.high:
                    held[piece.keys[node.dimension]] = held.get(piece.keys[node.dimension], 0) + piece.weight
            last = max(held, default=node.low)
            for spot in sorted(held):
                if node.before + held[spot] >= goals[node.number] or spot == last:
                    node.low = spot
                    break
                node.before += held[spot]
            node.high = node.low + 1

    def _narrow(self, nodes: list[_Node], goals: dict[int, float]) -> None:
        weights = self._weights(nodes, CELLS)
        for node in nodes:
            width = node.high - node.low
            held = {cell: w for (number, cell), (w, _) in weights.items() if number == node.number}
            counts = {cell: n for (number, cell), (_, n) in weights.items() if number == node.number}
            for piece in self.pieces:
                if piece.node == node.number and node.low <= piece.keys[node.dimension] < node.high:
                    cell = math.floor((piece.keys[node.dimension] - node.low) * CELLS / float(width))
                    held[cell] = held.get(cell, 0) + piece.weight
            before, chosen = node.before, max(held, default=0)
            for cell in sorted(held):
                if before + held[cell] >= goals[node.number]:
                    chosen = cell
                    break
                before += held[cell]
            else:
                before -= held.get(chosen, 0)
            # The keys whose cell, as the executors compute it, is the chosen one.
            low, high = node.low + _first_of(chosen, width), node.low + _first_of(chosen + 1, width)
            node.before, node.low, node.high, node.groups = before, low, min(high, node.high), counts.get(chosen, 0)

    def _divide(self, split: list[_Node], moves: dict[int, tuple[int, int]]) -> None:
        self.light = (
            self.light.join(self._table(split), "node", "left")
            .withColumn("node", F.when(F.col("cut").isNull(), F.col("node") * 2 + 1).when(F.get(F.col("keys"), F.col("dimension")) < F.col("cut"), F.col("node") * 2 + 1).otherwise(F.col("node") * 2 + 2))
            .select("group", "size", "n", "keys", "node")
        )
        by_number = {node.number: node for node in split}
        pieces = []
        for piece in self.pieces:
            node, left = by_number.get(piece.node), 2 * piece.node + 1
            if node is None:
                pieces.append(replace(piece, node=left))
                continue
            key = piece.keys[node.dimension]
            taken = moves[id(piece)][0] if id(piece) in moves else (piece.last - piece.first if key < node.low else 0)
            if taken:
                pieces.append(replace(piece, last=piece.first + taken, node=left))
            if taken < piece.last - piece.first:
                pieces.append(replace(piece, first=piece.first + taken, node=left + 1))
        self.pieces = pieces
        nodes = []
        for node in self.nodes:
            if node.shards > 1:
                half = node.shards // 2
                nodes += [_Node(2 * node.number + 1, half, node.shard), _Node(2 * node.number + 2, node.shards - half, node.shard + half)]
            else:
                nodes.append(_Node(2 * node.number + 1, 1, node.shard))
        self.nodes = nodes


def _first_of(cell: int, width: int) -> int:
    """The least offset whose cell, computed in doubles, is ``cell`` or later."""
    at = max(0, cell * width // CELLS - 2)
    while at < width and math.floor(at * CELLS / float(width)) < cell:
        at += 1
    return at


def shard_documents(
    docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = ("lang", "source"), tolerance: float = 0.005
) -> DataFrame:
    """One row per row of ``docs``: id, size (UTF-8 bytes and one), text_crc32, shard
    and slot (0, 1, 2... within the shard, in id order).

    Shards hold nearly equal bytes. The dimensions are the size and the named
    columns, whose values stand at their hash; a named column that is missing or
    null counts as one value. With ``target_bytes`` the number of shards is that
    of leaves of this size. Null text is empty. Repeated rows each have a slot.
    An empty table gives an empty table; other columns are ignored.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    there = [name for name in dimensions if name in docs.columns]
    slim = docs.select(
        docs[id_col].alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text, F.crc32(text)).alias("group"),
        *(docs[name].cast("string").alias(f"dim_{name}") for name in there),
    )
    slim = cut_lineage(slim, "slim")
    if target_bytes is not None:
        total = slim.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("w")).collect()[0].w
        shards = max(1, -(-total // target_bytes))
    if not shards or shards < 1:
        raise ValueError("Name the number of shards or their bytes.")
    tree = _Tree(_group_table(slim, [f"dim_{name}" for name in there]), shards, tolerance)
    spark = docs.sparkSession
    shard_of = F.broadcast(spark.createDataFrame([(node.number, node.shard) for node in tree.nodes], "node int, shard int"))
    light = tree.light.join(shard_of, "node").select(F.col("group").alias("g"), F.col("size").alias("s"), "shard")
    number_of = {node.number: node.shard for node in tree.nodes}
    pieces = [(piece.group, piece.size, piece.first, piece.last, number_of[piece.node]) for piece in tree.pieces]
    divided = F.broadcast(spark.createDataFrame(pieces, "g long, s long, first long, last long, shard int"))
    same = (F.col("group") == F.col("g")) & (F.col("size") == F.col("s"))
    rows = slim.select("id", "size", "text_crc32", "group")
    whole = rows.join(light, same).select("id", "size", "text_crc32", "shard")
    heavy = numbered(rows.join(divided.select("g", "s").distinct(), same, "left_semi"), "group", ["id"], "place")
    cut = heavy.join(divided, same & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("last"))).select("id", "size", "text_crc32", "shard")
    return numbered(whole.unionByName(cut), "shard", ["id", "text_crc32", "size"], "slot")

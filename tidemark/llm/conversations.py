"""Conversation structure repair by Hirschberg's divide and conquer.

A repaired conversation is an optional system turn and then pairs of a user and
an assistant turn, or nothing. Four states tell how far that is: nothing yet,
after system, after user, after assistant. Every turn is kept, given another
role or deleted, and turns without text may be inserted; the cheapest edits win,
and among equally cheap ones those whose initials, read in order, are least.

Forward from its start and backward from its end, a stretch of turns has a cost
for each state; the two vectors meet in the middle, the crossing that is
cheapest and whose initials are least is chosen, and both halves are done the
same way. Only vectors are held, no table of turns and states. The forward
vectors carry the order of the states' least initials, so ties are settled at
the crossing: initials that lead to different states through the same turns
never start with one another, since a stretch ends with an edit of its last
turn.

On Spark the turns are dealt out by ranges of conversation, turn, role and text
and cut into blocks. A block inside a conversation that goes on elsewhere is
summed up by the costs and orders from each state to each state; the blocks of a
conversation are then crossings of the same kind, and each is rebuilt alone. All
stretches of a batch are done together, one numpy step for the j-th turn of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Turns of a block; a conversation of more has several.
BLOCK_TURNS = 1 << 16
#: Turns rebuilt together.
_BATCH_TURNS = 1 << 20

_BIG = 1 << 40
_BLANKS = " \t\n\x0b\x0c\r"
#: What a turn allows: anything, the cost of a cut-off text unless deleted, deletion only.
_FREE, _TRUNCATED, _DELETED = range(3)
_CLASSES = "sua"
#: The step behind the last turn: it inserts what is missing.
_END = 12
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_LEGAL = np.zeros((4, 4), dtype=bool)
_LEGAL[0, 1] = _LEGAL[1, 2] = _LEGAL[2, 1] = True
_ROLES = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    """What an edit costs; keeping a turn is free. All are above zero."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    #: Added where a truncated turn is not deleted.
    truncated: int = 5


def _wanted(state: int) -> str:
    return "a" if state == 2 else "u"


@dataclass(frozen=True)
class _Steps:
    """Per kind of step: least cost from state to state, and the place of its
    initials among those from the same state."""

    cost: np.ndarray
    order: np.ndarray
    #: (kind, from, to) to initials.
    initials: dict[tuple[int, int, int], str] = field(default_factory=dict)


def _steps(costs: Costs) -> _Steps:
    cost = np.full((13, 4, 4), _BIG, dtype=np.int64)
    order = np.zeros((13, 4, 4), dtype=np.int64)
    held: dict[tuple[int, int, int], str] = {}
    for kind in range(13):
        for start in range(4):
            best: dict[int, tuple[int, str]] = {}
            state = start
            # Two insertions reach every state that insertions reach.
            for inserted in range(3):
                before, lead = inserted * costs.insert, "I" * inserted
                if kind == _END:
                    options = [(0, 0, "")] if state in (0, 3) else []
                else:
                    allows, label = divmod(kind, 4)
                    options = [(state, costs.delete, "D")]
                    if allows != _DELETED:
                        more = costs.truncated if allows == _TRUNCATED else 0
                        options.append((_NEXT[_wanted(state)][state], costs.rerole + more, "R"))
                        kept = _NEXT[_CLASSES[label]].get(state) if label < 3 else None
                        if kept is not None:
                            options.append((kept, more, "K"))
                for end, price, letter in options:
                    found = (before + price, lead + letter)
                    best[end] = min(best.get(end, found), found)
                state = _NEXT[_wanted(state)][state]
            places = sorted(best, key=lambda end: best[end][1])
            for end, (price, letters) in best.items():
                cost[kind, start, end], order[kind, start, end] = price, places.index(end)
                held[kind, start, end] = letters
    return _Steps(cost, order, held)


def _forward(steps: _Steps, kinds: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost of each state behind each stretch, and the order of the states' least initials."""
    n, length = len(low), high - low
    order = np.argsort(-length, kind="stable")
    at, longest = low[order], length[order]
    cost = np.full((n, 4), _BIG, dtype=np.int64)
    cost[np.arange(n), start[order]] = 0
    rank = np.tile(np.arange(4), (n, 1))
    for j in range(int(longest[0]) if n else 0):
        a = int(np.searchsorted(-longest, -j, side="left"))
        kind = kinds[at[:a] + j]
        total = np.minimum(cost[:a, :, None] + steps.cost[kind], _BIG)
        best = ((total << 4) + (rank[:a, :, None] << 2) + steps.order[kind]).min(axis=1)
        cost[:a] = best >> 4
        rank[:a] = np.argsort(np.argsort(best & 15, axis=1, kind="stable"), axis=1)
    back = np.empty(n, dtype=np.int64)
    back[order] = np.arange(n)
    return cost[back], rank[back]


def _backward(steps: _Steps, kinds: np.ndarray, low: np.ndarray, high: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cost from each state in front of each stretch to its end."""
    n, length = len(low), high - low
    order = np.argsort(-length, kind="stable")
    at, longest = high[order] - 1, length[order]
    cost = np.full((n, 4), _BIG, dtype=np.int64)
    cost[np.arange(n), end[order]] = 0
    for j in range(int(longest[0]) if n else 0):
        a = int(np.searchsorted(-longest, -j, side="left"))
        cost[:a] = np.minimum((steps.cost[kinds[at[:a] - j]] + cost[:a, None, :]).min(axis=2), _BIG)
    back = np.empty(n, dtype=np.int64)
    back[order] = np.arange(n)
    return cost[back]


def _crossings(steps: _Steps, kinds: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states in front of and behind every step of the stretches."""
    before = np.zeros(len(kinds), dtype=np.int64)
    behind = np.zeros(len(kinds), dtype=np.int64)
    while len(low):
        single = high - low == 1
        before[low[single]], behind[low[single]] = start[single], end[single]
        wide = high - low > 1
        low, high, start, end = low[wide], high[wide], start[wide], end[wide]
        middle = (low + high) // 2
        ahead, rank = _forward(steps, kinds, low, middle, start)
        total = ahead + _backward(steps, kinds, middle, high, end)
        cheapest = total == total.min(axis=1, keepdims=True) if len(total) else total.astype(bool)
        crossing = np.where(cheapest, rank, 9).argmin(axis=1) if len(total) else start
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        start, end = np.concatenate([start, crossing]), np.concatenate([crossing, end])
    return before, behind


def _key(conv: Column) -> Column:
    """One value per conversation; rows without an id are one conversation."""
    return F.when(conv.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), conv.cast("string")))


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text) damaged by crc32 of ``conv:turn`` modulo 20:
    0 drops a row, 1 empties its text, 2 takes its stops away, 3 repeats it, 4
    makes it the user's. A null is one space in the key, the role and the text.
    Other columns are left out."""
    conv, turn = rows[conv_col], rows[turn_col]
    fate = F.crc32(F.concat(_text(conv), F.lit(":"), _text(turn))) % 20
    slim = rows.select(conv.alias("conv"), turn.alias("turn"), _text(rows[role_col]).alias("role"), _text(rows[text_col]).alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return slim.where("fate <> 0").withColumn("copy", F.explode(copies)).select("conv", "turn", role.alias("role"), text.alias("text"))


def _slim(rows: DataFrame) -> DataFrame:
    """Per different turn: how often it stands there, what its text allows and
    whether no equal turn precedes it. Equal rows stand side by side, so they are
    one row with a count; the first of equal turns is a minimum, not a window."""
    shorn = F.rtrim("text", F.lit(_BLANKS))
    turns = (
        rows.select("key", "turn", "role", F.md5("text").alias("digest"), (shorn == "").alias("blank"), (~F.substring(shorn, -1, 1).isin(".", "!", "?")).alias("truncated"))
        .groupBy("key", "turn", "role", "digest")
        .agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn"), F.lit(0)).alias("turn"))
    firsts = turns.groupBy("key", "role", "digest").agg(F.min(place).alias("first"))
    initial = F.substring("role", 1, 1)
    return turns.join(firsts, ["key", "role", "digest"]).select(
        "key",
        "turn",
        "role",
        "digest",
        "n",
        "blank",
        "truncated",
        (place == F.col("first")).alias("leads"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("label"),
    )


_BLOCK = "key string, turn long, role string, digest string, kinds binary, copies binary, blank long, duplicate long, truncated long, illegal long, turns long, least long, most long, label int, last_label int, last_turn long"


def _cut_blocks(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted turns to blocks: one row with a byte per turn and its counts."""
    schema = pa.schema(
        [("key", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("kinds", pa.binary()), ("copies", pa.binary())]
        + [(name, pa.int64()) for name in ("blank", "duplicate", "truncated", "illegal", "turns", "least", "most")]
        + [("label", pa.int32()), ("last_label", pa.int32()), ("last_turn", pa.int64())]
    )

    def block(table: pa.Table) -> dict:
        n, label = table.column("n").to_numpy(), table.column("label").to_numpy()
        blank, cut, leads = (table.column(name).to_numpy(zero_copy_only=False) for name in ("blank", "truncated", "leads"))
        free = leads & ~blank
        allows = np.where(free, np.where(cut, _TRUNCATED, _FREE), _DELETED)
        known = table.column("turn").combine_chunks().drop_null().to_numpy()
        first = table.slice(0, 1).to_pylist()[0]
        return {
            **{name: first[name] for name in ("key", "turn", "role", "digest", "label")},
            "kinds": (allows * 4 + label).astype(np.uint8).tobytes(),
            "copies": n.tobytes() if (n > 1).any() else None,
            "blank": int(n[blank].sum()),
            "duplicate": int((n - leads)[~blank].sum()),
            "truncated": int((free & cut).sum()),
            "illegal": int((~_LEGAL[label[:-1], label[1:]]).sum() + (n - 1).sum()),
            "turns": int((known[1:] != known[:-1]).sum() + 1) if len(known) else 0,
            "least": int(known[0]) if len(known) else None,
            "most": int(known[-1]) if len(known) else None,
            "last_label": int(label[-1]),
            "last_turn": table.column("turn")[-1].as_py(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < limit and held.num_rows < 4096:
                continue
            made, held = pieces(held, last=False)
            if made:
                yield pa.RecordBatch.from_pylist(made, schema)
        if held is not None:
            made, _ = pieces(held, last=True)
            yield pa.RecordBatch.from_pylist(made, schema)

    def pieces(table: pa.Table, last: bool) -> tuple[list[dict], pa.Table]:
        table = table.combine_chunks()
        keys = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), table.num_rows]
        made = []
        for low, high in zip(starts[:-1], starts[1:], strict=True):
            while high - low >= limit:
                made.append(block(table.slice(low, limit)))
                low += limit
            if high == table.num_rows and not last:
                return made, table.slice(low)
            if high > low:
                made.append(block(table.slice(low, high - low)))
        return made, table.slice(table.num_rows)

    return run


def _sum_up(steps: _Steps) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks to their costs and orders from each state to each state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(kinds) for kinds in batch.column("kinds").to_pylist()], dtype=np.int64)
            kinds = np.frombuffer(b"".join(batch.column("kinds").to_pylist()), dtype=np.uint8)
            high = np.repeat(np.cumsum(lengths), 4)
            start = np.tile(np.arange(4), len(lengths))
            cost, rank = _forward(steps, kinds, high - np.repeat(lengths, 4), high, start)
            kept = [batch.column(name) for name in ("key", "block", "turn", "role", "digest", "label", "last_label", "last_turn")]
            packed = [pa.array([row.tobytes() for row in table.reshape(-1, 16)], pa.binary()) for table in (cost, rank)]
            yield pa.RecordBatch.from_arrays([*kept, *packed], names=["key", "block", "turn", "role", "digest", "label", "last_label", "last_turn", "cost", "ranks"])

    return run


_STATES = "block long, start int, end int, trailing string, crossed long, shared long"


def _join_up(steps: _Steps) -> Callable[[pa.Table], pa.Table]:
    """The blocks of one conversation to the states between them."""

    def run(table: pa.Table) -> pa.Table:
        turns = table.column("turn").to_pylist()
        rows = list(zip([turn is not None for turn in turns], [turn or 0 for turn in turns], table.column("role").to_pylist(), table.column("digest").to_pylist(), strict=True))
        table = table.take(pa.array(sorted(range(len(rows)), key=rows.__getitem__)))
        n = table.num_rows
        cost = np.frombuffer(b"".join(table.column("cost").to_pylist()), dtype=np.int64).reshape(n, 4, 4)
        ranks = np.frombuffer(b"".join(table.column("ranks").to_pylist()), dtype=np.int64).reshape(n, 4, 4)
        whole = _Steps(np.concatenate([cost, steps.cost[_END:]]), np.concatenate([ranks, steps.order[_END:]]))
        one = np.ones(1, dtype=np.int64)
        before, behind = _crossings(whole, np.arange(n + 1), one * 0, one * (n + 1), one * 0, one * 0)
        label, last = table.column("label").to_numpy(), table.column("last_label").to_numpy()
        turn, last_turn = table.column("turn").to_pylist(), table.column("last_turn").to_pylist()
        crossed = [0, *(~_LEGAL[last[:-1], label[1:]]).astype(int).tolist()]
        shared = [0, *(int(a is not None and a == b) for a, b in zip(last_turn[:-1], turn[1:], strict=True))]
        trailing = [""] * (n - 1) + [steps.initials[_END, int(before[n]), 0]]
        columns = [table.column("block"), pa.array(before[:n], pa.int32()), pa.array(behind[:n], pa.int32()), pa.array(trailing, pa.string()), pa.array(crossed, pa.int64()), pa.array(shared, pa.int64())]
        return pa.table(columns, names=["block", "start", "end", "trailing", "crossed", "shared"])

    return run


#: Digits of the ways to edit a turn: insertions in front of it, and its edit.
_WAYS = [lead + letter for lead in ("", "I", "II") for letter in "DKR"]


def _rebuild(steps: _Steps) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks, with the states at their ends where they are not whole
    conversations, to the edits of their turns."""
    way = np.zeros((12, 4, 4), dtype=np.uint8)
    for (kind, start, end), letters in steps.initials.items():
        if kind != _END:
            way[kind, start, end] = _WAYS.index(letters)
    lone = np.frombuffer("".join(_WAYS[:3]).encode(), dtype=np.uint8)
    delete = int(steps.cost[_DELETED * 4, 0, 0])
    insert = int(steps.cost[_END, 2, 0])

    def solve(rows: list[dict]) -> pa.RecordBatch:
        kinds, ends, start, end = [], [], [], []
        for row in rows:
            own = np.frombuffer(row["kinds"], dtype=np.uint8)
            whole = row["start"] is None
            kinds.append(np.append(own, np.uint8(_END)) if whole else own)
            ends.append(len(kinds[-1]))
            start.append(0 if whole else row["start"])
            end.append(0 if whole else row["end"])
        every = np.concatenate(kinds)
        high = np.cumsum(ends)
        low = high - np.array(ends)
        before, behind = _crossings(steps, every, low, high, np.array(start), np.array(end))
        price = steps.cost[every, before, behind]
        out = []
        for i, row in enumerate(rows):
            a, b = int(low[i]), int(low[i]) + len(row["kinds"])
            ways = way[every[a:b], before[a:b], behind[a:b]]
            copies = np.frombuffer(row["copies"], dtype=np.int64) if row["copies"] else None
            trailing = steps.initials[_END, int(before[b]), 0] if row["start"] is None else row["trailing"]
            cost = int(price[a:b].sum()) + insert * len(trailing)
            if copies is None and (ways < 3).all():
                letters = lone[ways].tobytes().decode()
            else:
                times = copies.tolist() if copies is not None else [1] * (b - a)
                letters = "".join(_WAYS[w] + "D" * (n - 1) for w, n in zip(ways.tolist(), times, strict=True))
                cost += delete * (sum(times) - (b - a))
            out.append({"block": row["block"], "cost": cost, "letters": letters + trailing, "ways": (ways + 48).tobytes().decode(), "trailing": trailing})
        return pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int64()), ("cost", pa.int64()), ("letters", pa.string()), ("ways", pa.string()), ("trailing", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                size += len(row["kinds"])
                if size >= _BATCH_TURNS:
                    yield solve(held)
                    held, size = [], 0
        if held:
            yield solve(held)

    return run


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return rows.select(
        _key(rows[conv_col]).alias("key"), rows[conv_col].alias("conv"), rows[turn_col].cast("long").alias("turn"), _text(rows[role_col]).alias("role"), _text(rows[text_col]).alias("text")
    )


@dataclass(frozen=True)
class Repairs:
    """What to do with each conversation, and the turns it is to be done with."""

    plans: DataFrame
    turns: DataFrame


def repair_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs | None = None, block_turns: int = BLOCK_TURNS
) -> Repairs:
    """Faults and cheapest edits of every conversation.

    ``plans`` has one row per conversation: conv, gaps (turn numbers missing
    between the least and the largest), blank, duplicate and truncated (turns
    whose first fault that is), illegal (neighbours whose roles may not follow one
    another), cost, audit (the initials of the edits: Keep, Rerole, Delete, Insert)
    and key. :func:`repaired_turns` and :func:`repair_digests` apply them.

    Turns stand in order of turn number, null first, then of role and of the MD5
    of the text. Null roles and texts are one space; rows without an id are one
    conversation. Equal rows are copies side by side: all but the first are
    duplicates. Texts of any length are read whole. An empty table gives an empty
    one; other columns are ignored.
    """
    turns = _turns(rows, conv_col, turn_col, role_col, text_col)
    steps = _steps(costs or Costs())
    order = ["key", "turn", "role", "digest"]
    sorted_turns = _slim(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = sorted_turns.mapInArrow(_cut_blocks(block_turns), _BLOCK).withColumn("block", F.monotonically_increasing_id())
    blocks = cut_lineage(blocks, "blocks")
    several = blocks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    summed = blocks.join(several, "key", "left_semi").mapInArrow(
        _sum_up(steps), "key string, block long, turn long, role string, digest string, label int, last_label int, last_turn long, cost binary, ranks binary"
    )
    states = summed.groupBy("key").applyInArrow(_join_up(steps), _STATES)
    placed = blocks.join(states, "block", "left")
    solved = placed.select("block", "kinds", "copies", "start", "end", "trailing").mapInArrow(_rebuild(steps), "block long, cost long, letters string, ways string, trailing string")
    counted = placed.drop("kinds", "copies", "trailing").join(solved, "block")
    place = F.struct(F.col("turn").isNotNull(), F.coalesce(F.col("turn"), F.lit(0)), "role", "digest", "letters", "ways")
    plans = counted.groupBy("key").agg(
        F.coalesce(F.max("most") - F.min("least") + 1 - F.sum(F.col("turns") - F.coalesce("shared", F.lit(0))), F.lit(0)).alias("gaps"),
        *(F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated")),
        F.sum(F.col("illegal") + F.coalesce("crossed", F.lit(0))).alias("illegal"),
        F.sum("cost").alias("cost"),
        F.array_sort(F.collect_list(place)).alias("held"),
        F.max("trailing").alias("trailing"),
    )
    names = turns.groupBy("key").agg(F.first("conv", ignorenulls=True).alias("conv"))
    joined = plans.join(names, "key").select(
        "key", "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.array_join("held.letters", "").alias("audit"), F.array_join("held.ways", "").alias("ways"), "trailing"
    )
    return Repairs(cut_lineage(joined, "plans"), turns)


#: Rows of a batch given back.
_ROWS_OUT = 4096


def _batch(rows: list[tuple], names: str, types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(columns, types, strict=True)], names=names.split())


class _Digests:
    """One row per conversation."""

    def __init__(self) -> None:
        self.out: list[tuple[str, str, int]] = []
        self.sha, self.n = hashlib.sha256(), 0

    def turn(self, key: str, role: str, text: str, edit: str) -> None:
        self.sha.update(f"{chr(10) if self.n else ''}{role}:{text}".encode())
        self.n += 1

    def close(self, key: str) -> None:
        self.out.append((key, self.sha.hexdigest(), self.n))
        self.sha, self.n = hashlib.sha256(), 0

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return _batch(rows, "key repaired_sha256 n_turns", [pa.string(), pa.string(), pa.int64()])


class _Turns:
    """One row per repaired turn."""

    def __init__(self) -> None:
        self.out: list[tuple[str, int, str, str, str]] = []
        self.place = 0

    def turn(self, key: str, role: str, text: str, edit: str) -> None:
        self.out.append((key, self.place, role, text, edit))
        self.place += 1

    def close(self, key: str) -> None:
        self.place = 0

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return _batch(rows, "key place role text edit", [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()])


def _apply(make: Callable[[], _Digests | _Turns]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams conversations, each headed by its plan, through a sink."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = make()
        plan: tuple[str, str, str] | None = None
        state, at, last = 0, 0, None

        def insert(times: int) -> None:
            nonlocal state
            for _ in range(times):
                wanted = _wanted(state)
                state = _NEXT[wanted][state]
                sink.turn(plan[0], _ROLES[wanted], "", "I")

        for batch in batches:
            names = ("key", "ways", "trailing", "turn", "role", "digest", "text")
            for key, ways, trailing, turn, role, digest, text in zip(*(batch.column(name).to_pylist() for name in names), strict=True):
                if ways is not None:
                    if plan is not None:
                        insert(len(plan[2]))
                        sink.close(plan[0])
                    plan, state, at, last = (key, ways, trailing), 0, 0, None
                    continue
                if (turn, role, digest) == last:
                    continue
                last = (turn, role, digest)
                letters = _WAYS[ord(plan[1][at]) - 48]
                at += 1
                insert(len(letters) - 1)
                if letters[-1] == "D":
                    continue
                if letters[-1] == "R":
                    role = _ROLES[_wanted(state)]
                state = _NEXT[role[0]][state]
                sink.turn(key, role, text, letters[-1])
            if len(sink.out) >= _ROWS_OUT:
                yield sink.batch()
        if plan is not None:
            insert(len(plan[2]))
            sink.close(plan[0])
        yield sink.batch()

    return run


def _streamed(repairs: Repairs) -> DataFrame:
    """Turns sorted within their conversation behind its plan."""
    turns = repairs.turns.select("key", "turn", "role", F.md5("text").alias("digest"), "text")
    both = repairs.plans.select("key", "ways", "trailing").unionByName(turns, allowMissingColumns=True)
    return both.repartition("key").sortWithinPartitions(F.col("key"), F.col("ways").isNull(), F.col("turn"), F.col("role"), F.col("digest"))


def repaired_turns(repairs: Repairs) -> DataFrame:
    """The repaired conversations: key, place (from 0), role, text, edit (K, R or I)."""
    return _streamed(repairs).mapInArrow(_apply(_Turns), "key string, place long, role string, text string, edit string")


def repair_digests(repairs: Repairs) -> DataFrame:
    """Per key: SHA-256 of the repaired ``role:text`` lines, and their number.

    A digest is a chain over a whole conversation, so its turns pass one task,
    as a stream of which a batch is held."""
    return _streamed(repairs).mapInArrow(_apply(_Digests), "key string, repaired_sha256 string, n_turns long")


def all_conversations(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row (key, conv) per conversation."""
    return rows.select(_key(rows[conv_col]).alias("key"), rows[conv_col].alias("conv")).groupBy("key").agg(F.first("conv", ignorenulls=True).alias("conv"))

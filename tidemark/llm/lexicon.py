"""A minimal acyclic transducer from words to id sequences.

Words share their prefixes and, once minimal, their suffixes. Every edge holds
the number of words that sort before it among those of its state; summed along
a path that is the word's place, and the place leads to its ids. All tables
stand in one byte string that a task writes to an unnamed file and maps, and
many words walk the automaton at once.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterable

import numpy as np

_MAGIC = 0x4C455831


def build(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The automaton of distinct words, as one byte string of tables."""
    held = sorted(dict(words).items())
    # A state is (is a word, edges); equal states are one, looked up in ``known``.
    known: dict[tuple, int] = {}
    states: list[tuple] = []

    def settle(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    # States along the last word, open until a later word leaves them.
    open_states: list[tuple[bool, list]] = [(False, [])]
    before = b""

    def close(depth: int) -> None:
        while len(open_states) > depth + 1:
            final, edges = open_states.pop()
            open_states[-1][1][-1] = (open_states[-1][1][-1][0], settle(final, edges))

    for word, _ in held:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        close(shared)
        for byte in word[shared:]:
            open_states[-1][1].append((byte, -1))
            open_states.append((False, []))
        open_states[-1] = (True, open_states[-1][1])
        before = word
    close(0)
    root = settle(*open_states[0])

    # A state comes after all it leads to, so its number of words is known then.
    sizes = np.zeros(len(states), dtype=np.int64)
    keys, targets, skips = [], [], []
    for number, (final, edges) in enumerate(states):
        total = int(final)
        for byte, target in edges:
            keys.append(number << 8 | byte)
            targets.append(target)
            skips.append(total)
            total += int(sizes[target])
        sizes[number] = total
    counts = np.array([len(ids) for _, ids in held], dtype=np.int64)
    tables = [
        np.array([_MAGIC, root], dtype=np.int64),
        np.array(keys, dtype=np.int64),
        np.array(targets, dtype=np.int64),
        np.array(skips, dtype=np.int64),
        np.array([final for final, _ in states], dtype=np.int64),
        np.concatenate(([0], np.cumsum(counts))).astype(np.int64),
        np.array([i for _, ids in held for i in ids], dtype=np.int64),
    ]
    return b"".join(np.int64(len(table)).tobytes() + table.tobytes() for table in tables)


class Lexicon:
    """The mapped automaton."""

    def __init__(self, blob: bytes) -> None:
        # The file has no name: it goes when the mapping does.
        with tempfile.TemporaryFile() as file:
            file.write(blob)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        whole, tables, at = np.frombuffer(self.map, dtype=np.int64), [], 0
        while at < len(whole):
            tables.append(whole[at + 1 : at + 1 + whole[at]])
            at += 1 + int(whole[at])
        head, self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = tables
        if head[0] != _MAGIC:
            raise ValueError("These bytes hold no lexicon.")
        self.root = int(head[1])

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each word among those of the lexicon, or -1."""
        out = np.full(len(starts), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        alive = np.arange(len(starts))
        states = np.full(len(starts), self.root, dtype=np.int64)
        places = np.zeros(len(starts), dtype=np.int64)
        depth = 0
        while len(alive):
            over = ends[alive] - starts[alive] == depth
            done = over & (self.final[states] == 1)
            out[alive[done]] = places[done]
            alive, states, places = alive[~over], states[~over], places[~over]
            wanted = states << 8 | data[starts[alive] + depth]
            edge = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            there = self.keys[edge] == wanted
            alive, edge = alive[there], edge[there]
            states, places = self.targets[edge], places[there] + self.skips[edge]
            depth += 1
        return out

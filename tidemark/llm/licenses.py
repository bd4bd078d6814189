"""License scans by template-markup matching.

A template is license wording with markup: ``[[...]]`` encloses an optional
region, which may hold further markup, and ``{{n}}`` stands for replaceable text
of up to n words. A template compiles into an automaton over words. A text is
accepted where the automaton reaches its end: all mandatory wording stands
there word by word, optional regions stand there whole or not at all.

Two finds come from a text: places of short *phrases* (a base label each) and
the accepted *templates* with the words they span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import kernels

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label and wording of the templates, in lower-cased words.
TEMPLATES = (
    ("gpl-2.0", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[of the license]]"),
    ("gpl-3.0", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[of the license]]"),
    ("gpl-or-later", "gnu general public license as published by the free software foundation either version {{1}} of the license or [[at your option]] any later version"),
    ("lgpl", "licensed under the [[terms of the]] gnu lesser general public license [[version {{2}}]]"),
    ("lgpl", "licensed under the [[terms of the]] gnu library general public license [[version {{2}}]]"),
    ("apache-2.0", "licensed under the apache license version 2 0 [[the license]] [[you may not use {{4}} except in compliance with the license]]"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by sa 4 0"),
    ("cc-by-nd-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by nd 4 0"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] creative commons attribution 4 0 [[international]] license"),
    ("mit-notice", "released under the [[terms of the]] mit license"),
    ("mit-notice", "licensed under the [[terms of the]] mit license"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of {{8}} to deal in the {{4}} without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the {{4}} "
        "and to permit persons to whom the {{4}} is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the {{4}}",
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
)

_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)\}\}|[^\s\[\]{}]+")


@dataclass
class Automaton:
    """States 0 to n - 1, the last one accepting."""

    label: str
    #: The two mandatory words with which the template begins.
    anchor: tuple[bytes, bytes]
    words: list[dict[bytes, set[int]]] = field(default_factory=list)
    anything: list[set[int]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)

    def state(self) -> int:
        self.words.append({})
        self.anything.append(set())
        self.free.append(set())
        return len(self.words) - 1

    def closed(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for state in self.free[todo.pop()] - out:
                out.add(state)
                todo.append(state)
        return out

    def longest(self, read, start: int, end: int) -> int | None:
        """One past the last word of the longest accepted text from ``start``."""
        final, best = len(self.words) - 1, None
        states = self.closed({0})
        for at in range(start, end + 1):
            if final in states:
                best = at
            if at == end:
                break
            word, after = read(at), set()
            for state in states:
                after |= self.words[state].get(word, set()) | self.anything[state]
            if not after:
                break
            states = self.closed(after)
        return best


def compile_template(label: str, text: str) -> Automaton:
    tokens = [(held[0], held[1]) for held in _MARK.finditer(text)]
    if len(tokens) < 2 or any(word.startswith(("[", "]", "{")) for word, _ in tokens[:2]):
        raise ValueError(f"Template {label} must begin with two mandatory words.")
    out = Automaton(label, (tokens[0][0].encode(), tokens[1][0].encode()))
    at, opened = out.state(), []
    for token, most in tokens:
        if token == "[[":
            opened.append(at)
        elif token == "]]":
            if not opened:
                raise ValueError(f"Template {label} closes a region it has not opened.")
            # Skipped whole: a free way around, to a state nothing else leads into.
            after = out.state()
            out.free[at].add(after)
            out.free[opened.pop()].add(after)
            at = after
        elif most:
            ways = [at]
            for _ in range(int(most)):
                after = out.state()
                out.anything[ways[-1]].add(after)
                ways.append(after)
            at = out.state()
            for state in ways:
                out.free[state].add(at)
        else:
            after = out.state()
            out.words[at].setdefault(token.encode(), set()).add(after)
            at = after
    if opened:
        raise ValueError(f"Template {label} leaves a region open.")
    final = out.state()
    out.free[at].add(final)
    return out


def _hash(words: list[bytes]) -> np.ndarray:
    data, offsets = kernels.text_bytes(pa.array([b" ".join(words).decode()]))
    return kernels.words_of(data, offsets).hashes


def find_runs(words: kernels.Words, phrase: list[bytes]) -> np.ndarray:
    """Places where the words of a phrase stand consecutively in one text."""
    hashes, n = _hash(phrase), len(phrase)
    if len(words.hashes) < n:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(words.hashes[: len(words.hashes) - n + 1] == hashes[0])
    for step in range(1, n):
        at = at[words.hashes[at + step] == hashes[step]]
    row = np.searchsorted(words.offsets, at, "right")
    at = at[at + n <= words.offsets[np.minimum(row, len(words.offsets) - 1)]]
    sure = [all(words.text(a + i) == word for i, word in enumerate(phrase)) for a in at.tolist()]
    return at[np.array(sure, dtype=bool)]


BASE = "array<struct<word:long,label:string>>"
NOTICES = "array<struct<start:long,end:long,label:string>>"


def _lists(rows: list[int], values: list[dict], n: int, kind: pa.DataType) -> pa.Array:
    out: list[list[dict]] = [[] for _ in range(n)]
    for row, value in zip(rows, values, strict=True):
        out[row].append(value)
    return pa.array([sorted(held, key=lambda value: tuple(value.values())) for held in out], kind)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, base (word and label of every place
    of a phrase) and notices (word range and label of every accepted template).

    Words are maximal runs of ASCII letters, digits and non-ASCII characters after
    lower-casing A-Z. Null or empty text has no words and no finds. Of one
    template only the longest text from a place counts; overlaps of different
    templates all count. Repeated rows give equal rows; other columns are ignored.
    """
    automata = [compile_template(label, text) for label, text in templates]
    spelled = [(text.encode().split(), label) for text, label in phrases.items()]
    anchors: dict[tuple[bytes, bytes], list[Automaton]] = {}
    for automaton in automata:
        anchors.setdefault(automaton.anchor, []).append(automaton)
    base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    notice_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in kernels.pieces(batch, "text"):
                words = kernels.words_of(data, offsets)
                n = rows.num_rows
                base_rows, base, notice_rows, notices = [], [], [], []
                for phrase, label in spelled:
                    at = find_runs(words, phrase)
                    row = np.searchsorted(words.offsets, at, "right") - 1
                    base_rows += row.tolist()
                    base += [{"word": word, "label": label} for word in (at - words.offsets[row]).tolist()]
                for anchor, held in anchors.items():
                    at = find_runs(words, list(anchor))
                    row = np.searchsorted(words.offsets, at, "right") - 1
                    for start, own in zip(at.tolist(), row.tolist(), strict=True):
                        first, last = int(words.offsets[own]), int(words.offsets[own + 1])
                        for automaton in held:
                            end = automaton.longest(words.text, start, last)
                            if end is not None:
                                notice_rows.append(own)
                                notices.append({"start": start - first, "end": end - first, "label": automaton.label})
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(rows.schema.get_field_index("id")),
                        pa.array(np.diff(words.offsets), pa.int64()),
                        _lists(base_rows, base, n, base_type),
                        _lists(notice_rows, notices, n, notice_type),
                    ],
                    names=["id", "n_words", "base", "notices"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(scan, f"id {kind}, n_words long, base {BASE}, notices {NOTICES}")

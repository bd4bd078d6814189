import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import kernels, line_dedup

SCHEMA = "doc_id long, text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def expected(rows, threshold=2):
    lines = sorted((key, number, line) for key, text in rows for number, line in enumerate((text or "").split("\n")))
    known, distinct, dropped = set(), [], {}
    for key, number, line in lines:
        if not line:
            continue
        if line in known:
            dropped[key, number] = "equal"
            continue
        known.add(line)
        for other in distinct:
            most = min(threshold, max(len(line), len(other)) // 5)
            if most and abs(len(line) - len(other)) <= most and distance(line, other) <= most:
                dropped[key, number] = "near"
                break
        distinct.append(line)
    return dropped


def compare(spark, rows, **settings):
    random.Random(1).shuffle(rows)
    dropped = expected(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for row in line_dedup.dedup_lines(frame, **settings).collect():
        lines = (row.text or "").split("\n")
        gone = [number for number in range(len(lines)) if (row.doc_id, number) in dropped]
        assert row.dropped == gone and row.n_lines == len(lines)
        assert row.n_near == sum(dropped[row.doc_id, number] == "near" for number in gone)
        assert row.kept == "\n".join(line for number, line in enumerate(lines) if number not in gone)
    return dropped


def edited(draw, line, edits):
    out = list(line)
    for _ in range(edits):
        at = draw.randrange(len(out))
        draw.choice((lambda: out.insert(at, draw.choice("xyé語")), lambda: out.__setitem__(at, draw.choice("xyé語")), lambda: out.pop(at)))()
    return "".join(out)


@pytest.mark.parametrize("block_bytes", [400, 1 << 20])
def test_equals_brute_force(spark, block_bytes):
    draw = random.Random(6)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(18, 60))) for _ in range(25)]
    rows = []
    for key in range(60):
        lines = [edited(draw, draw.choice(base), draw.choice((0, 0, 1, 2, 3, 4))) for _ in range(draw.randrange(6))]
        rows.append((key, "\n".join([*lines, "short", ""][: draw.randrange(8)])))
    dropped = compare(spark, rows, block_bytes=block_bytes)
    assert {"equal", "near"} == set(dropped.values())


def test_short_lines_and_other_scripts(spark):
    draw = random.Random(11)
    letters = "abcdeé學習中文的人很多了ж😀"
    base = ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 26))) for _ in range(60)]
    rows = [(key, "\n".join(edited(draw, line, draw.choice((0, 0, 1, 2, 3))) if len(line) > 3 else line for line in draw.choices(base, k=5))) for key in range(50)]
    rows += [(100, "Click here"), (101, "Click here"), (102, "Click hare"), (103, "12."), (104, "13."), (105, "我在學習中文而且我學了很久了因為我很喜歡這個語言"), (106, "我也在學習中文而且我學了很久了因為我很喜歡這個語言")]
    dropped = compare(spark, rows)
    assert dropped[101, 0] == "equal" and dropped[102, 0] == "near" and dropped[106, 0] == "near"
    assert (103, 0) not in dropped and (104, 0) not in dropped
    assert sum(kind == "near" for kind in dropped.values()) > 40


def test_a_group_of_like_lines_goes_but_for_the_first(spark):
    rows = [(i, f"Page number {i} of this long report, which has a good many pages.") for i in range(150)]
    dropped = compare(spark, rows)
    assert len(dropped) >= 140


def test_lines_that_only_share_much_stay(spark):
    draw = random.Random(2)
    base = "The quick brown fox jumps over the lazy dog while the cat looks on from the wall"
    words = base.split()
    rows = []
    for i in range(120):
        held = list(words)
        held[draw.randrange(len(held))] = f"unlike{i:04d}q"
        rows.append((i, " ".join(held)))
    compare(spark, rows)


def test_nulls_empty_texts_repeated_rows_and_clashing_columns(spark):
    line = "This line is as long as it has to be for both."
    rows = [(1, None, "a"), (2, "", "b"), (3, "\n\n", "c"), (4, line, "d"), (4, line, "e"), (5, f"{line}\n{line}x\nend", "f"), (None, line, "g"), (6, f"top\n{line}", "h")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumnRenamed("kept", "hash")
    got = sorted(((row.doc_id, row.hash, row.text, row.dropped, row.n_lines, row.kept) for row in line_dedup.dedup_lines(frame).collect()), key=lambda row: row[1])
    assert [(row[3], row[4], row[5]) for row in got] == [
        ([], 1, ""),
        ([], 1, ""),
        ([], 3, "\n\n"),
        ([], 1, line),
        ([], 1, line),
        ([0, 1], 3, "end"),
        ([], 1, line),
        ([1], 2, "top"),
    ]
    assert got[0][2] is None and line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_line(spark):
    line = " ".join(str(i * i) for i in range(30_000))
    rows = [(1, line), (2, line[:1000] + "#" + line[1000:]), (3, "###" + line), (4, line)]
    got = {row.doc_id: (row.dropped, row.n_near) for row in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ([], 0), 2: ([0], 1), 3: ([], 0), 4: ([0], 0)}


def test_banded_distance_equals_the_table():
    draw = random.Random(0)
    for _ in range(6_000):
        a = "".join(draw.choice("abcé") for _ in range(draw.randrange(14)))
        b = "".join(draw.choice("abc😀") for _ in range(draw.randrange(14))) if draw.random() < 0.3 else edited(draw, a + "abc", draw.randrange(4))[: len(a) + 2]
        for most in range(5):
            assert line_dedup.within(a, b, most) == (distance(a, b) <= most), (a, b, most)


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    draw = random.Random(8)
    rows = [(i // 3, i % 3, f"Posted on the old board by the user {draw.randrange(10**9):09d}-{draw.randrange(10**4):04d}") for i in range(240)]
    rows += [(100 + i, 0, f"Posted on the old board by the user 123456789-{i:04d}") for i in range(20)]
    texts = {}
    for key, _, line in rows:
        texts.setdefault(key, []).append(line)
    docs = [(key, "\n".join(held)) for key, held in texts.items()]
    dealt, units = [], line_dedup.deal_hot

    def watched(*args):
        out = units(*args)
        dealt.append(out.groupBy("key").count().agg({"count": "max"}).collect()[0][0])
        return out

    # The registered size is for tables far larger than a test's.
    whole = line_dedup.near_lines
    monkeypatch.setattr(line_dedup, "deal_hot", watched)
    monkeypatch.setattr(line_dedup, "near_lines", lambda lines, threshold: whole(lines, threshold, hot_rows=100))
    dropped = compare(spark, docs)
    assert dropped and len(dealt) > 1 and max(held or 0 for held in dealt) <= 2 * 2 * 100


def test_rows_without_an_id_get_no_block(spark, monkeypatch):
    seen, place = [], line_dedup.block_of

    def asserted(key, bounds):
        seen.append(bounds)
        return F.when(key.isNull(), F.raise_error(F.lit("A row without an id got a block.")).cast("long")).otherwise(place(key, bounds))

    monkeypatch.setattr(line_dedup, "block_of", asserted)
    line = "This line is as long as it has to be for both."
    found = line_dedup.dedup_lines(spark.createDataFrame([(None, line), (1, line), (2, line)], SCHEMA)).collect()
    assert seen and sorted((row.doc_id or 0, row.dropped, row.kept) for row in found) == [(0, [], line), (1, [], line), (2, [0], "")]


@pytest.mark.parametrize("block_bytes", [300, 1 << 20])
def test_one_id_on_many_rows(spark, block_bytes):
    """Versions of a heavy id: each different line counts once, at its least number."""
    draw = random.Random(9)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(12, 40))) for _ in range(30)]
    rows = [(50, "\n".join([*draw.choices(base, k=draw.randrange(5)), edited(draw, draw.choice(base), 1), ""])) for _ in range(60)]
    rows += [(50, rows[0][1])] * 30 + [(50, None)]
    rows += [(key, "\n".join([*draw.choices(base, k=2), f"own line of the number {key * 7919}"])) for key in (3, 8, 49, 51, 60, 90)]
    rows += [(None, base[0])]
    digest = {}

    def hashed(line):
        if line not in digest:
            data = np.frombuffer(line.encode(), dtype=np.uint8)
            digest[line] = int(kernels.range_hashes(kernels.prefix_sums(data), np.array([0]), np.array([len(data)])).view(np.int64)[0])
        return digest[line]

    places = {(key, number, line) for key, text in rows if key is not None for number, line in enumerate((text or "").split("\n")) if line}
    distinct, gone, known = [], {}, {}
    for key, number, line in sorted(places, key=lambda place: (*place[:2], hashed(place[2]))):
        if line in known:
            gone[key, number, line] = "equal"
            continue
        known[line] = key, number
        for other in distinct:
            most = min(2, max(len(line), len(other)) // 5)
            if most and abs(len(line) - len(other)) <= most and distance(line, other) <= most:
                gone[key, number, line] = "near"
                break
        distinct.append(line)
    assert {"equal", "near"} <= set(gone.values())

    def kept(key, text):
        lines = list(enumerate((text or "").split("\n")))
        went = [gone[key, number, line] for number, line in lines if (key, number, line) in gone]
        return key or -1, "\n".join(line for number, line in lines if (key, number, line) not in gone), went.count("near"), len(went)

    found = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(5), block_bytes=block_bytes).collect()
    assert sorted((row.doc_id or -1, row.kept, row.n_near, len(row.dropped)) for row in found) == sorted(kept(*row) for row in rows)

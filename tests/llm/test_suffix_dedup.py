import random

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm import suffix_dedup

SCHEMA = "doc_id long, text string"


def result(frame, **settings):
    rows = suffix_dedup.dedup_substrings(frame, **settings).withColumn("digest", F.sha2("kept", 256)).collect()
    return {row.id: (row.n_bytes, sum(span.end - span.start for span in row.spans), len(row.spans), row.digest) for row in rows}, rows


def corpus(seed=7):
    draw = random.Random(seed)
    words = ["alpha", "béta", "gamma", "delta", "ε", "zeta", "eta9", "theta", "ιota"]
    passage = [" ".join(draw.choice(words) for _ in range(30)) for _ in range(4)]
    rows = []
    for key in range(40):
        parts = [" ".join(f"{draw.choice(words)}{draw.randrange(999)}" for _ in range(draw.randrange(25)))]
        parts += draw.sample(passage, draw.randrange(3))
        parts.append(" ".join(f"{draw.choice(words)}{draw.randrange(999)}" for _ in range(draw.randrange(25))))
        rows.append((key * 3, " ".join(parts)))
    # Overlapping repeats, repeats inside one text, copies, and strings on the border.
    rows += [(900, "ab" * 100), (901, "ab" * 60), (902, "x" * 49), (903, "x" * 49), (904, "y" * 50), (905, "y" * 50), (906, "z" + "y" * 50 + "z"), (907, rows[3][1]), (908, rows[3][1])]
    return rows


@pytest.mark.parametrize("block_bytes", [300, 2_000, 1 << 20])
def test_equals_brute_force(spark, block_bytes):
    rows = corpus()
    random.Random(1).shuffle(rows)
    found, _ = result(spark.createDataFrame(rows, SCHEMA).repartition(3), block_bytes=block_bytes)
    assert found == brute.substrings(rows)


def test_nulls_empty_texts_and_clashing_columns(spark):
    rows = [(1, None, 5, "a"), (2, "", 6, "b"), (3, "q" * 60, 7, "c"), (4, "q" * 60, 8, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, block long, kept string")
    found, _ = result(frame)
    assert found == brute.substrings([row[:2] for row in rows])
    assert found[4][1:3] == (60, 1)


def test_rows_without_an_id_take_no_part(spark):
    frame = spark.createDataFrame([(None, "w" * 80), (None, "w" * 80), (5, "w" * 80)], SCHEMA)
    _, rows = result(frame)
    assert sorted((row.id is None, row.n_bytes, len(row.spans)) for row in rows) == [(False, 80, 0), (True, 80, 0), (True, 80, 0)]


def test_rows_that_share_an_id_do_not_count_against_each_other(spark):
    frame = spark.createDataFrame([(1, "v" * 70), (1, "v" * 70), (2, "v" * 70)], SCHEMA)
    _, rows = result(frame)
    assert sorted((row.id, len(row.spans)) for row in rows) == [(1, 0), (1, 0), (2, 1)]


def test_empty_table_and_one_long_text(spark):
    assert suffix_dedup.dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(str(i * i) for i in range(60_000))
    _, rows = result(spark.createDataFrame([(1, text), (2, text[100_000:200_000])], SCHEMA))
    assert {row.id: [(span.start, span.end) for span in row.spans] for row in rows} == {1: [], 2: [(0, 100_000)]}


def test_rows_without_an_id_get_no_block(spark, monkeypatch):
    seen, place = [], suffix_dedup.block_of

    def asserted(key, bounds):
        seen.append(bounds)
        return F.when(key.isNull(), F.raise_error(F.lit("A row without an id got a block.")).cast("long")).otherwise(place(key, bounds))

    monkeypatch.setattr(suffix_dedup, "block_of", asserted)
    rows = [(None, "u" * 70), (None, None), (1, "u" * 70), (2, "u" * 70)]
    _, found = result(spark.createDataFrame(rows, SCHEMA))
    assert seen and sorted((row.id or 0, row.n_bytes, len(row.spans), len(row.kept)) for row in found) == [(0, 0, 0, 0), (0, 70, 0, 70), (1, 70, 0, 70), (2, 70, 1, 0)]


@pytest.mark.parametrize("block_bytes", [300, 1 << 20])
def test_one_id_on_many_rows(spark, block_bytes):
    """Parts of a heavy id do not count against each other; others are as ever."""
    draw = random.Random(3)
    shared = [" ".join(f"{draw.randrange(10**6)}" for _ in range(20)) for _ in range(5)]
    heavy = [(50, f"{draw.choice(shared)} {draw.randrange(10**9)} {draw.choice(shared)}") for _ in range(60)] + [(50, shared[0])] * 40
    light = [(key, f"{key * 7} {draw.choice(shared)}") for key in (3, 8, 49, 51, 60, 90)]
    rows = [*heavy, *light, (None, shared[0])]
    _, found = result(spark.createDataFrame(rows, SCHEMA).repartition(5), block_bytes=block_bytes)

    def cut(key, text):
        data, gone = text.encode(), bytearray(len(text.encode()))
        seen = {t.encode()[at : at + 50] for k, t in rows if k is not None and k < key for at in range(len(t) - 49)}
        for at in range(len(data) - 49):
            if data[at : at + 50] in seen:
                gone[at : at + 50] = b"\1" * 50
        return bytes(b for b, flag in zip(data, gone, strict=True) if not flag)

    want = sorted((key, cut(key, text)) if key is not None else (-1, text.encode()) for key, text in rows)
    assert sorted((-1 if row.id is None else row.id, bytes(row.kept)) for row in found) == want

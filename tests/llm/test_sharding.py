import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string"


def corpus(n=1500, seed=8):
    draw = random.Random(seed)
    texts = ["".join(draw.choice("abcdé ") for _ in range(draw.randrange(10, 200))) for _ in range(n)]
    hot = "h" * 120
    rows = [(i, hot if i % 3 == 0 else draw.choice(texts), draw.choice(("en", "fr", None)), f"s{draw.randrange(5)}") for i in range(n)]
    return rows


def checked(rows, frame, shards=8, **settings):
    got = sharding.shard_documents(frame, shards, **settings).collect()
    texts = {key: text or "" for key, text, *_ in rows}
    assert sorted((row.id is None, row.id) for row in got) == sorted((row[0] is None, row[0]) for row in rows)
    weight, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for row in got:
        if row.id is not None:
            data = texts[row.id].encode()
            assert (row.size, row.text_crc32) == (len(data) + 1, zlib.crc32(data))
            groups[texts[row.id]].add(row.shard)
        weight[row.shard] += row.size
        slots[row.shard].append((row.slot, row.id))
    for held in slots.values():
        held.sort()
        assert [slot for slot, _ in held] == list(range(len(held)))
        ids = [key for _, key in held if key is not None]
        assert ids == sorted(ids)
    return weight, groups


def test_bytes_are_even_and_texts_stay_together(spark):
    rows = corpus()
    weight, groups = checked(rows, spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert sorted(weight) == list(range(8))
    mean = sum(weight.values()) / 8
    assert max(abs(held - mean) for held in weight.values()) < 0.03 * mean
    # A third of the rows are one text: it alone may be divided.
    heavy = {text for text, held in groups.items() if len(held) > 1}
    total = sum(weight.values())
    copies = defaultdict(int)
    for row in rows:
        copies[row[1]] += len(row[1].encode()) + 1
    assert "h" * 120 in heavy and all(copies[text] > 0.005 * total / 8 for text in heavy)


@pytest.mark.parametrize("shards", [1, 3, 5])
def test_any_number_of_shards(spark, shards):
    rows = corpus(400)
    weight, _ = checked(rows, spark.createDataFrame(rows, SCHEMA), shards)
    assert sorted(weight) == list(range(shards)) and max(weight.values()) < 1.1 * min(weight.values())


def test_target_bytes_and_missing_dimensions(spark):
    rows = corpus(300)
    frame = spark.createDataFrame(rows, SCHEMA).drop("lang")
    total = sum(len(row[1].encode()) + 1 for row in rows)
    weight, _ = checked(rows, frame, None, target_bytes=total // 4 + 1)
    assert sorted(weight) == list(range(4))
    with pytest.raises(ValueError):
        sharding.shard_documents(frame, None)


def test_nulls_empty_texts_repeated_rows_and_clashing_columns(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "x", "en", "s"), (2, "", "en", None), (3, "é" * 50_000, "fr", "t"), (3, "y", "fr", "t")]
    frame = spark.createDataFrame([(*row, 1, "n") for row in rows], f"{SCHEMA}, shard int, `group` string")
    got = sharding.shard_documents(frame).collect()
    assert sorted(row.size for row in got) == [1, 1, 1, 2, 2, 100_001]
    assert len({(row.shard, row.slot) for row in got}) == 6


def test_empty_table(spark):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_numbers_are_gapless_within_each_key(spark):
    frame = spark.createDataFrame([(i % 3, i * 7 % 101) for i in range(300)], "k int, v int").repartition(5)
    held = defaultdict(list)
    for row in sharding.numbered(frame, "k", ["v"], "place").collect():
        held[row.k].append((row.place, row.v))
    for rows in held.values():
        rows.sort()
        assert [place for place, _ in rows] == list(range(100)) and [v for _, v in rows] == sorted(v for _, v in rows)

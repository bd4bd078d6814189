import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk_search

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, asked, k, scale=256):
    held = []
    for key, vector, *_ in rows:
        if key is None or vector is None or any(c is None or not math.isfinite(c) for c in vector):
            continue
        held.append((key, [math.floor(scale * float(np.float32(c))) for c in vector]))
    out = []
    for key, own in held:
        if not asked(key):
            continue
        scores = sorted((-sum(a * b for a, b in zip(own, other, strict=False)), i) for i, other in held if i != key)
        out += [(key, rank, i, -score) for rank, (score, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def got(frame, every=50, k=5, **settings):
    return sorted(tuple(row) for row in topk_search.search_top(frame, F.col("id") % every == 0, k, **settings).collect())


def drawn(n, size=8, seed=1, clusters=6):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, size))
    rows = []
    for i in range(n):
        # A third of the rows are one vector.
        vector = centres[0] if i % 3 == 0 else centres[draw.integers(clusters)] + 0.1 * draw.normal(size=size)
        rows.append((i, [float(c) for c in vector], 0))
    return rows


@pytest.mark.parametrize("settings", [{}, {"shard_rows": 64, "leaf_rows": 8, "block_queries": 4}])
def test_equals_all_products(spark, settings):
    rows = drawn(900)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), 10, **settings) == plain(rows, lambda key: key % 10 == 0, 5)


def test_many_lanes_share_what_was_found(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "_LANE_SHARDS", 2)
    monkeypatch.setattr(topk_search, "_ROOTS", 4)
    rows = drawn(400, seed=4)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(frame, 7, 3, shard_rows=20, leaf_rows=4) == plain(rows, lambda key: key % 7 == 0, 3)


def test_nulls_non_finite_ragged_repeated_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [], 1), (6, [1.0], 1), (7, [1.0, -1.0, 9.0], 1), (None, [1.0, 1.0], 1), (8, [2.0, 2.0], 1), (8, [2.0, 2.0], 1)]
    frame = spark.createDataFrame([(*row, 1, "x") for row in rows], f"{SCHEMA}, shard int, x string")
    assert got(frame, 4) == plain(rows, lambda key: key % 4 == 0, 5)
    # Rows of one id in shards of their own are still each a row.
    assert got(frame, 50, shard_rows=1, leaf_rows=1, block_queries=1) == plain(rows, lambda key: key % 50 == 0, 5)


def test_exact_beyond_single_and_double_precision(spark):
    draw = random.Random(2)
    for size in (3e4, 3e6):
        rows = [(i, [draw.uniform(-size, size) for _ in range(4)], 0) for i in range(120)]
        assert got(spark.createDataFrame(rows, SCHEMA), 10, shard_rows=16, leaf_rows=4) == plain(rows, lambda key: key % 10 == 0, 5)


def test_products_of_every_size():
    draw = np.random.default_rng(3)
    for size in (100, 1 << 20, 1 << 28):
        a, b = draw.integers(-size, size, (5, 6)), draw.integers(-size, size, (7, 6))
        want = [[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for y in b] for x in a]
        assert topk_search._products(a, b).tolist() == want


def test_bounds_spare_far_shards():
    draw = np.random.default_rng(5)
    near, far = draw.integers(90, 110, (64, 4)), -draw.integers(90, 110, (64, 4))
    block = topk_search._Block(0, np.array([1000]), np.array([[50, 50, 50, 50]]), np.full((1, 5), -(1 << 63)), np.full((1, 5), (1 << 63) - 1))
    block.search(topk_search._grow(np.arange(64), near, 8))
    tree = topk_search._grow(np.arange(64, 128), far, 8)
    rows, _ = block.may_beat(tree.centres[0], tree.radii[0], 64, np.arange(1))
    assert not len(rows)


def test_empty_table_and_no_query(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, [1.0], 0)], SCHEMA)) == []
    assert got(spark.createDataFrame([(0, [1.0], 0)], SCHEMA)) == []

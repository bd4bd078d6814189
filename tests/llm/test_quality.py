import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def corpus(n=240, seed=9):
    draw = random.Random(seed)
    syllables = ["ba", "de", "lo", "mi", "nu", "ra", "so", "te", "vi", "ka"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randrange(1, 4)))
    rows, labels = [], []
    for key in range(n):
        good = key % 3 != 0
        words = [word() for _ in range(draw.randrange(30, 300))]
        text = " ".join(words).capitalize() + "." if good else " ".join(f"{held.upper()}!!" for held in words) if key % 2 else " ".join([words[0]] * 200)
        rows.append((key, text, "xx"))
        labels.append((key, int(good), 0))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    model = quality.fit(docs, marks)
    assert quality.fit(docs.repartition(2), marks).weights == pytest.approx(model.weights)
    scored = {row.doc_id: row for row in quality.score_quality(docs, model).collect()}
    out = [key for key, *_ in labels if zlib.crc32(str(key).encode()) % 4 == 2]
    assert np.mean([scored[key].predicted == dict((a, b) for a, b, _ in labels)[key] for key in out]) >= 0.95
    assert all(0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7) for row in scored.values())


def test_held_out_labels_do_not_matter(spark):
    rows, labels = corpus(90)
    wrong = [(key, 1 - good if zlib.crc32(str(key).encode()) % 4 == 2 else good, 0) for key, good, _ in labels]
    docs = spark.createDataFrame(rows, DOCS)
    models = [quality.fit(docs, spark.createDataFrame(held, LABELS)) for held in (labels, wrong)]
    assert models[0].good == models[1].good and models[0].weights == pytest.approx(models[1].weights)


def test_accuracy_on_the_test_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    scored = quality.score_quality(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert np.mean([row.predicted == row.quality for row in scored]) >= 0.95


def test_nulls_long_texts_ties_and_clashing_columns(spark):
    rows, labels = corpus(90)
    model = quality.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (5, 7, 0)], LABELS))
    odd = [(1, None, "s"), (2, "", "s"), (None, "Bade lo.", None), (3, rows[1][1], "a"), (4, rows[1][1], "b"), (5, "Balo mide. " * 200_000, "c")]
    got = quality.score_quality(spark.createDataFrame(odd, "doc_id long, text string, score string"), model).collect()
    assert [row.doc_id for row in got] == [1, 2, None, 3, 4, 5]
    assert got[0].score == got[1].score and got[3].score == got[4].score
    assert quality.score_quality(spark.createDataFrame([], DOCS), model).count() == 0


def test_without_two_labels_the_score_is_constant(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (7, "b", "x")], DOCS)
    for labels, score in (([], 1.0), ([(1, 1, 0), (7, 1, 0), (9, 1, 0)], 1.0), ([(key, 0, 0) for key in range(9)], 0.0)):
        model = quality.fit(docs, spark.createDataFrame(labels, LABELS))
        assert [row.score for row in quality.score_quality(docs, model).collect()] == [score, score]


def test_segments_cover_whole_texts():
    for size in (1, 1023, 1024, 1025, 5000):
        cuts = quality.segments(size)
        assert cuts[0][0] == 0 and cuts[-1][1] == size and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
        assert max(b - a for a, b in cuts) <= quality.SEGMENT

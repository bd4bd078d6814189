"""A quality score from compression.

Two zstandard dictionaries are built from labelled text, one of good and one of
bad rows. A text is cut into equal segments and every segment compressed three
ways: with either dictionary and with none. What the dictionaries save differs,
and the normalised difference of the compressed sizes, with the plain
compression ratio and the length beside it, goes through a logistic curve
fitted to other labelled rows: a calibrated probability that the label is 1.

Only the fit reads a sample of labelled rows, of documented size. Scoring is
one pass over whole texts without a shuffle; the broadcast model is bounded by
the size of the dictionaries.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm import kernels

#: Longest segment in bytes.
SEGMENT = 1024
_PLAIN = {"level": 1, "write_content_size": False, "write_checksum": False, "write_dict_id": False}


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    #: A fixed score where one of the two labels is missing.
    constant: float | None = None


def segments(size: int, longest: int = SEGMENT) -> list[tuple[int, int]]:
    """Equal cuts of a text, whole: the last ends at ``size``."""
    n = -(-size // longest)
    return [(size * i // n, size * (i + 1) // n) for i in range(n)]


def build_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Sizes:
    """Compressed sizes with the two dictionaries and with none."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.ways = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(held), **_PLAIN) if held else zstandard.ZstdCompressor(**_PLAIN) for held in (good, bad, b"")]

    def features(self, text: memoryview) -> tuple[float, ...]:
        totals, least = [0, 0, 0], 1.0
        for start, end in segments(len(text)):
            with_good, with_bad, plain = (len(way.compress(text[start:end])) for way in self.ways)
            totals = [totals[0] + with_good, totals[1] + with_bad, totals[2] + plain]
            least = min(least, (with_bad - with_good) / max(with_good, with_bad))
        if not len(text):
            return 0.0, 0.0, 1.2, 0.0
        return (totals[1] - totals[0]) / max(totals[0], totals[1]), least, totals[2] / len(text), float(np.log1p(len(text)))


def design(features: np.ndarray) -> np.ndarray:
    """The terms of the logistic curve from (difference, least difference of a
    segment, plain ratio, log of the length)."""
    gap, least = np.clip(features[:, 0], -0.5, 0.25), np.clip(features[:, 1], -0.5, 0.25)
    ratio, size = np.minimum(features[:, 2], 1.2), features[:, 3]
    terms = (gap, least, np.abs(gap), ratio, ratio**2, size, gap * ratio, gap * size, ratio * size, np.maximum(0, 0.4 - ratio), np.maximum(0, 0.25 - ratio))
    return np.column_stack((np.ones(len(features)), *terms))


def fit_curve(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Damped Newton steps of a weighted logistic regression: weights, centre, scale."""
    terms = design(features)
    centre, scale = terms.mean(axis=0), terms.std(axis=0)
    centre[0], scale[0] = 0.0, 1.0
    scale[scale == 0] = 1.0
    held = (terms - centre) / scale
    out = np.zeros(held.shape[1])
    for _ in range(100):
        chance = _curve(held @ out)
        slope = held.T @ (weights * (labels - chance)) - ridge * out
        step = np.linalg.solve((held * (weights * chance * (1 - chance))[:, None]).T @ held + ridge * np.eye(len(out)), slope)
        out += step * min(1.0, 4.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return out, centre, scale


def _curve(value: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(value, -40, 40)))


def _texts(batch: pa.RecordBatch) -> Iterator[memoryview]:
    data, offsets = kernels.text_bytes(batch.column(batch.schema.get_field_index("text")))
    held = memoryview(np.ascontiguousarray(data))
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield held[start:end]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All segments of every text, for the dictionaries."""
    for batch in batches:
        out, labels = [], []
        for text, label in zip(_texts(batch), batch.column(batch.schema.get_field_index("quality")).to_pylist(), strict=True):
            cuts = segments(len(text))
            out += [bytes(text[start:end]) for start, end in cuts]
            labels += [label] * len(cuts)
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(out, pa.binary())], names=["quality", "segment"])


def held_out(key: Column) -> Column:
    """Rows kept from the fit: crc32 of the id as text is 2 modulo 4."""
    return F.crc32(key.cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", dictionary_bytes: int = 128 << 10, dictionary_rows: int = 2_000, dictionary_segments: int = 8_000, curve_rows: int = 4_000) -> Model:
    """Fit on labelled rows that are not held out.

    Per label, ``dictionary_rows`` rows build the dictionary and other
    ``curve_rows`` the curve, both picked by a hash of the id; with fewer labelled
    rows, one third builds the dictionary. Of all segments of the dictionary's rows,
    wherever they stand in a text, ``dictionary_segments`` are used, picked by a hash
    of their bytes. These bounds size all that reaches the driver: segments of 1 KB,
    four numbers a row. Rows with a null id or label are passed over. Where only one label occurs, or none, the score is constant.
    """
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("quality")).where("id IS NOT NULL AND quality IN (0, 1)")
    known = known.where(~held_out(F.col("id"))).distinct().withColumn("draw", F.xxhash64("id"))
    counts = {row.quality: row["n"] for row in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(b"", b"", np.zeros(0), np.zeros(0), np.zeros(0), 0.0 if 0 in counts else 1.0)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where("id IS NOT NULL")
    first, second = [], []
    for label, n in counts.items():
        cut = min(dictionary_rows, max(1, n // 3))
        own = known.where(F.col("quality") == label).orderBy("draw", "id").limit(cut + curve_rows).collect()
        first += [(row.id, label) for row in own[:cut]]
        second += [(row.id, label) for row in own[cut:]]

    def drawn(pairs: list[tuple]) -> DataFrame:
        spark = docs.sparkSession
        picked = spark.createDataFrame(pairs, known.select("id", "quality").schema)
        return rows.join(F.broadcast(picked), "id").select("id", "text", "quality")

    held: dict[int, list[bytes]] = {0: [], 1: []}
    cuts = drawn(first).mapInArrow(_segments, "quality int, segment binary")
    for label in held:
        own = cuts.where(F.col("quality") == label).orderBy(F.xxhash64("segment"), "segment").limit(dictionary_segments)
        held[label] = sorted(bytes(row.segment) for row in own.collect())
    model = Model(build_dictionary(held[1], dictionary_bytes), build_dictionary(held[0], dictionary_bytes), np.zeros(0), np.zeros(0), np.zeros(0))
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    measured = drawn(second).mapInArrow(_measure(sent), "quality int, gap double, least double, ratio double, size double").sort("quality", "gap", "ratio", "size").collect()
    if len({row.quality for row in measured}) < 2:
        return Model(b"", b"", np.zeros(0), np.zeros(0), np.zeros(0), 0.0 if counts.get(0, 0) > counts.get(1, 0) else 1.0)
    values = np.array([tuple(row)[1:] for row in measured])
    marks = np.array([row.quality for row in measured], dtype=float)
    # The drawn rows weigh as much as the labels they stand for.
    total, share = sum(counts.values()), marks.mean()
    weights = np.where(marks == 1, counts[1] / total / share, counts[0] / total / (1 - share))
    model.weights, model.centre, model.scale = fit_curve(values, marks, weights)
    return model


def _measure(model: Broadcast):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pickle.loads(model.value)
        sizes = Sizes(held.good, held.bad)
        for batch in batches:
            values = np.array([sizes.features(text) for text in _texts(batch)], dtype=float).reshape(-1, 4)
            columns = [batch.column(batch.schema.get_field_index("quality")), *(pa.array(column) for column in values.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["quality", "gap", "least", "ratio", "size"])

    return measure


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` and score (0 to 1) and predicted (1 from the
    threshold on).

    Null text counts as empty, and an empty text gets the score of a text that
    no dictionary helps. Equal texts get equal scores. Columns of ``docs`` named
    score or predicted are replaced.
    """
    names = [name for name in docs.columns if name not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    # A text goes to the workers once, unless it has to be cast.
    read = text_col if text_col in names and docs.schema[text_col].dataType == StringType() else "__text"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pickle.loads(sent.value)
        sizes = Sizes(held.good, held.bad)
        for batch in batches:
            if held.constant is not None:
                chance = np.full(batch.num_rows, held.constant)
            else:
                texts = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(read))], names=["text"])
                values = np.array([sizes.features(text) for text in _texts(texts)], dtype=float).reshape(-1, 4)
                chance = _curve(((design(values) - held.centre) / held.scale) @ held.weights)
            kept = [batch.column(batch.schema.get_field_index(name)) for name in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(chance), pa.array((chance >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    fields = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in docs.schema.fields if field.name in names)
    given = docs.select(*(docs[name] for name in names), *([] if read == text_col else [docs[text_col].cast("string").alias(read)]))
    return given.mapInArrow(score, f"{fields}, score double, predicted int")

"""Media columns: payloads stored as lossless WebP images and read back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels, webp

#: A row of 64 pixels of three samples.
ROW_BYTES = 192
_ROW_PIXELS = ROW_BYTES // 3


def shape_of(payload_bytes: int) -> tuple[int, int]:
    """Width and height for a payload: 64 wide, wider where it would be too high."""
    rows = payload_bytes // ROW_BYTES
    times = -(-rows // webp.LARGEST_SIDE)
    return _ROW_PIXELS * times, -(-rows // times)


def _padded(text: np.ndarray) -> np.ndarray:
    size = max(1, -(-len(text) // ROW_BYTES)) * ROW_BYTES
    out = np.full(size, 32, dtype=np.uint8)
    out[: len(text)] = text
    return out


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, payload_bytes and media.

    The payload is the text's UTF-8 bytes (null: none) filled up with blanks to
    a positive multiple of 192, and media the lossless WebP file of it, three
    bytes a pixel. A payload of over 16 384 rows makes a wider image, filled up
    to whole rows. Equal texts give equal media. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in kernels.pieces(batch, "text"):
                sizes, media = [], []
                for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    payload = _padded(data[start:end])
                    sizes.append(len(payload))
                    width, height = shape_of(len(payload))
                    whole = payload if 3 * width * height == len(payload) else np.concatenate((payload, np.full(3 * width * height - len(payload), 32, dtype=np.uint8)))
                    media.append(webp.encode(whole, width, height))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(rows.schema.get_field_index("id")), pa.array(np.diff(offsets), pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())],
                    names=["id", "n_bytes", "payload_bytes", "media"],
                )

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(store, f"id {kind}, n_bytes long, payload_bytes long, media binary")


def features(width: int, height: int, samples: np.ndarray) -> str:
    """Size, mean of each channel, mean step to the right neighbour, and number
    of colours in thousandths of the pixels, as whole numbers."""
    grid = samples.reshape(height, width, 3)
    means = grid.reshape(-1, 3).sum(axis=0, dtype=np.int64) // (width * height)
    steps = np.abs(np.diff(grid.astype(np.int16), axis=1)).sum(axis=(0, 1), dtype=np.int64) // (height * max(1, width - 1))
    packed = grid.reshape(-1, 3).astype(np.uint32) @ np.array([1, 256, 65536], dtype=np.uint32)
    colours = len(kernels.distinct(packed)) * 1000 // len(packed)
    return f"{width}x{height} mean {'/'.join(map(str, means))} step {'/'.join(map(str, steps))} colours {colours}"


def read_media(stored: DataFrame) -> DataFrame:
    """All columns of ``stored`` (media and, if there, payload_bytes among them) and
    width, height, samples (RGB bytes, cut to payload_bytes), feature and error.

    Bytes that are no lossless WebP image give nulls and the reason in error;
    null media gives nulls only.
    """
    names = [name for name in stored.columns if name not in ("width", "height", "samples", "feature", "error")]
    sized = "payload_bytes" in names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few rows at a time, since an image may be many times its file.
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                held: dict[str, list] = {name: [] for name in ("width", "height", "samples", "feature", "error")}
                limits = rows.column(rows.schema.get_field_index("payload_bytes")).to_pylist() if sized else [None] * rows.num_rows
                for media, limit in zip(rows.column(rows.schema.get_field_index("media")).to_pylist(), limits, strict=True):
                    made: tuple = (None, None, None, None, None)
                    if media is not None:
                        try:
                            width, height, pixels = webp.decode(media)
                            samples = np.ascontiguousarray(pixels.view(np.uint8).reshape(-1, 4)[:, 2::-1]).ravel()
                            made = (width, height, samples[:limit].tobytes(), features(width, height, samples), None)
                        except webp.BadImage as error:
                            made = (None, None, None, None, str(error))
                    for name, value in zip(held, made, strict=True):
                        held[name].append(value)
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
                columns = [rows.column(rows.schema.get_field_index(name)) for name in names]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(values, kind) for values, kind in zip(held.values(), kinds, strict=True))], names=[*names, *held])

    fields = ", ".join(f"`{name}` {stored.schema[name].dataType.simpleString()}" for name in names)
    return stored.select(*names).mapInArrow(read, f"{fields}, width int, height int, samples binary, feature string, error string")


def tail_crc(samples: str = "samples", size: int = 16) -> Column:
    return F.crc32(F.expr(f"substring({samples}, -{size}, {size})"))

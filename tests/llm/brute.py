"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


def substrings(rows: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple]:
    """doc_id to (n_bytes, n_removed, n_spans, sha256 of what is left)."""
    first: dict[bytes, int] = {}
    texts = {key: (text or "").encode() for key, text in rows}
    for key in sorted(texts):
        data = texts[key]
        for at in range(len(data) - length + 1):
            first.setdefault(data[at : at + length], key)
    out = {}
    for key, data in texts.items():
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            if first[data[at : at + length]] < key:
                gone[at : at + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(byte for byte, flag in zip(data, gone, strict=True) if not flag)
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out

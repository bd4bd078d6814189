"""BPE encoding with a lexicon of frequent words, and decoding.

A word's tokens depend on the word alone. One pass counts the words of all
documents; the most frequent ones are encoded once and compiled into a minimal
acyclic transducer. The second pass looks every distinct word of a piece up in
the memory-mapped automaton and merges the unseen ones exactly, rank by rank.

Text is split as the vocabulary's file says: special tokens first, then
normalisation, then words. Texts whose characters all lie in ranges where that
is known to be a table look-up are split as arrays; all others go through the
tokenizers library's own normaliser and splitter, and their words through the
same look-up and merges.
"""

from __future__ import annotations

import json
import pickle
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import kernels, lexicon
from tidemark.session import cut_lineage

#: Bytes of text split at once.
PIECE = 1 << 18
#: Words of the lexicon, which bounds what is broadcast.
LEXICON_WORDS = 50_000

#: The pattern of the vocabulary's splitter.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(5)


def _plain(code: int) -> bool:
    """Characters that no normalisation joins and whose class is stable."""
    return code < 0x300 and code != 0x130 or 0x2010 <= code <= 0x2027 or code == 0x20AC


def _character_tables() -> tuple[np.ndarray, np.ndarray]:
    size = 0x2100
    kinds, lower = np.full(size + 1, _UNKNOWN, dtype=np.uint8), np.arange(size + 1, dtype=np.uint32)
    for code in filter(_plain, range(size)):
        category = unicodedata.category(chr(code))
        space = 9 <= code <= 13 or code in (0x20, 0x85, 0xA0)
        kinds[code] = _SPACE if space else {"L": _LETTER, "N": _NUMBER}.get(category[0], _OTHER)
        lower[code] = ord(chr(code).lower())
    return kinds, lower


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in shown]
    place = {byte: byte for byte in shown} | {byte: 256 + i for i, byte in enumerate(hidden)}
    return [chr(place[byte]) for byte in range(256)]


@dataclass
class Vocabulary:
    """Tables of a word-end BPE vocabulary."""

    source: str
    inner: np.ndarray
    last: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    specials: dict[str, int]
    token_bytes: np.ndarray
    token_offsets: np.ndarray


_PAIR = 1 << 20


def read_vocabulary(path: str) -> Vocabulary:
    """Read a vocabulary file of the tokenizers library; what this module does
    not do, it refuses."""
    source = Path(path).read_text(encoding="utf-8")
    held = json.loads(source)
    model = held["model"]
    end = model["end_of_word_suffix"]
    kinds = [step["type"] for step in held["normalizer"]["normalizers"]], [step["type"] for step in held["pre_tokenizer"]["pretokenizers"]]
    split = held["pre_tokenizer"]["pretokenizers"][0].get("pattern", {}).get("Regex")
    odd = model["dropout"] or model["unk_token"] or model["fuse_unk"] or model["byte_fallback"] or model["continuing_subword_prefix"] or held["post_processor"] or held["decoder"]
    if odd or not end or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or split != SPLIT:
        raise ValueError("This vocabulary is split or merged in ways that are not built here.")
    vocabulary, characters = model["vocab"], _byte_characters()
    rows = []
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        rows.append((vocabulary[left] * _PAIR + vocabulary[right], rank, vocabulary[left + right]))
    pairs, ranks, merged = (np.array(column, dtype=np.int64) for column in zip(*sorted(rows), strict=True))
    specials = {token["content"]: token["id"] for token in held["added_tokens"]}
    by_id = {number: token for token, number in vocabulary.items()} | {number: token for token, number in specials.items()}
    texts = [by_id.get(number, "").encode() for number in range(max(by_id) + 1)]
    return Vocabulary(
        source,
        np.array([vocabulary[c] for c in characters], dtype=np.int64),
        np.array([vocabulary[c + end] for c in characters], dtype=np.int64),
        pairs,
        ranks,
        merged,
        specials,
        np.frombuffer(b"".join(texts), dtype=np.uint8),
        np.concatenate(([0], np.cumsum([len(text) for text in texts]))).astype(np.int64),
    )


def merge_words(vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words back to back, and n + 1 offsets.

    In every round each word takes its merge of lowest rank, leftmost first,
    until no pair of it has a rank.
    """
    n = len(starts)
    sizes = ends - starts
    symbols = vocabulary.inner[data[kernels.repeat_ranges(starts, sizes)]]
    lasts = np.cumsum(sizes) - 1
    symbols[lasts] = vocabulary.last[data[ends - 1]]
    word = np.repeat(np.arange(n), sizes)
    none = len(vocabulary.pairs)
    done_words, done_symbols = [], []
    while len(symbols):
        rank = np.full(len(symbols), none, dtype=np.int64)
        pair = symbols[:-1] * _PAIR + symbols[1:]
        at = np.minimum(np.searchsorted(vocabulary.pairs, pair), none - 1)
        fits = (vocabulary.pairs[at] == pair) & (word[:-1] == word[1:])
        rank[:-1][fits] = vocabulary.ranks[at[fits]]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        least = np.minimum.reduceat(rank, first)
        count = np.diff(np.append(first, len(symbols)))
        open_word = least < none
        over = np.repeat(~open_word, count)
        done_words.append(word[over])
        done_symbols.append(symbols[over])
        # The leftmost place of the least rank in each open word.
        chosen = np.flatnonzero((rank == np.repeat(least, count)) & ~over)
        chosen = chosen[np.append(True, word[chosen][1:] != word[chosen][:-1])] if len(chosen) else chosen
        symbols[chosen] = vocabulary.merged[at[chosen]]
        keep = ~over
        keep[chosen + 1] = False
        symbols, word = symbols[keep], word[keep]
    if not done_words:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    words, ids = np.concatenate(done_words), np.concatenate(done_symbols)
    order = np.argsort(words, kind="stable")
    return ids[order], np.concatenate(([0], np.cumsum(np.bincount(words, minlength=n))))


@dataclass
class Tokens:
    """Words of the texts of a piece, in order: their bytes in ``data``, their
    rows, and the id of a special token or -1."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    special: np.ndarray


class Splitter:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.kinds, self.lower = _character_tables()
        self.specials = vocabulary.specials
        self.library = Tokenizer.from_str(vocabulary.source)
        self.bytes_of = {character: byte for byte, character in enumerate(_byte_characters())}

    def _by_library(self, text: str) -> list[tuple[bytes, int]]:
        """Words and special tokens of one text, by the library's own rules."""
        out: list[tuple[bytes, int]] = []
        while text:
            found = min(((text.find(token), token) for token in self.specials if token in text), default=(len(text), ""))
            part, token = text[: found[0]], found[1]
            normal = self.library.normalizer.normalize_str(part) if part else ""
            for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal) if normal else ():
                out.append((bytes(self.bytes_of[character] for character in word), -1))
            if token:
                out.append((b"", self.specials[token]))
            text = text[found[0] + len(token) :]
        return out

    def split(self, data: np.ndarray, offsets: np.ndarray) -> Tokens:
        raw = data.tobytes()
        codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        bounds = begins[offsets]
        small = np.minimum(codes, len(self.kinds) - 1)
        kinds = self.kinds[small]
        row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        slow = set(np.unique(row_of[kinds == _UNKNOWN]).tolist())
        for token in self.specials:
            at = raw.find(token.encode())
            while at >= 0:
                slow.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(token.encode(), at + 1)
        for row in slow:
            kinds[bounds[row] : bounds[row + 1]] = _SPACE
        lowered = np.where(codes < len(self.lower) - 1, self.lower[small], codes).astype(np.uint32)
        widths = 1 + (lowered > 0x7F) + (lowered > 0x7FF) + (lowered > 0xFFFF)
        places = np.concatenate(([0], np.cumsum(widths)))
        new = np.ones(len(kinds), dtype=bool)
        new[1:] = (kinds[1:] != kinds[:-1]) | (row_of[1:] != row_of[:-1]) | (kinds[1:] == _NUMBER)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(kinds))
        starts, ends = self._contractions(lowered, kinds, starts, ends, row_of)
        worded = kinds[starts] != _SPACE if len(starts) else np.zeros(0, dtype=bool)
        starts, ends = starts[worded], ends[worded]
        text = lowered.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
        parts = [text]
        token_starts, token_ends, rows = [places[starts]], [places[ends]], [row_of[starts]]
        special = [np.full(len(starts), -1, dtype=np.int64)]
        at = len(text)
        for row in sorted(slow):
            words = self._by_library(raw[offsets[row] : offsets[row + 1]].decode("utf-8"))
            sizes = np.array([len(word) for word, _ in words], dtype=np.int64)
            stops = at + np.cumsum(sizes)
            parts.extend(word for word, _ in words)
            token_starts.append(stops - sizes)
            token_ends.append(stops)
            rows.append(np.full(len(words), row))
            special.append(np.array([number for _, number in words], dtype=np.int64))
            at = int(stops[-1]) if len(words) else at
        rows_ = np.concatenate(rows)
        order = np.argsort(rows_, kind="stable")
        return Tokens(np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate(token_starts)[order], np.concatenate(token_ends)[order], rows_[order], np.concatenate(special)[order])

    @staticmethod
    def _contractions(codes: np.ndarray, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Moves the bound after an apostrophe behind the letters it draws in."""
        if not len(starts):
            return starts, ends
        alone = np.flatnonzero((codes[starts] == ord("'")) & (ends - starts == 1))
        alone = alone[alone + 1 < len(starts)]
        after = starts[alone + 1]
        alone = alone[(kinds[after] == _LETTER) & (rows[after] == rows[starts[alone]])]
        first, stop = starts[alone + 1], ends[alone + 1]
        one, two = codes[first], np.where(first + 1 < stop, codes[np.minimum(first + 1, len(codes) - 1)], 0)

        def reads(pair: str) -> np.ndarray:
            return (one == ord(pair[0])) & (two == ord(pair[1]))

        drawn = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(reads("re") | reads("ve") | reads("ll"), 2, 0))
        alone, drawn = alone[drawn > 0], drawn[drawn > 0]
        starts, ends = starts.copy(), ends.copy()
        ends[alone] += drawn
        starts[alone + 1] += drawn
        whole = starts < ends
        return starts[whole], ends[whole]


def _distinct(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First tokens of each distinct word, and of each token its word; a special
    token counts as a word of its own."""
    hashes = kernels.range_hashes(kernels.prefix_sums(tokens.data), tokens.starts, tokens.ends)
    hashes = np.where(tokens.special >= 0, kernels.mix(tokens.special.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)), hashes)
    _, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    return first, inverse, counts


def _count_words(vocabulary: Broadcast, most: int = 200_000):
    """For ``mapInArrow``: words with their counts, summed until a bound is met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(pickle.loads(vocabulary.value))
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for _, data, offsets in kernels.pieces(batch, "text", PIECE):
                tokens = splitter.split(data, offsets)
                first, _, counts = _distinct(tokens)
                raw = tokens.data.tobytes()
                for at, n in zip(first.tolist(), counts.tolist(), strict=True):
                    if tokens.special[at] < 0:
                        word = raw[tokens.starts[at] : tokens.ends[at]]
                        held[word] = held.get(word, 0) + n
                if len(held) >= most:
                    yield out()
        yield out()

    return count


def frequent_words(docs: DataFrame, path: str, text_col: str = "text", words: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words of all documents, at most ``words`` of them.

    Words are taken by bands of frequency, from the top, as long as a whole band
    fits. So the driver gets one row for each band and each word it keeps.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(read_vocabulary(path)))
    counted = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(_count_words(vocabulary), "word binary, n long")
    band = F.floor(F.log2("n") * 16).cast("int").alias("band")
    summed = cut_lineage(counted.groupBy("word").agg(F.sum("n").alias("n")).select("word", "n", band), "words")
    lowest, held = None, 0
    for row in summed.groupBy("band").agg(F.count("*").alias("n")).orderBy(F.desc("band")).collect():
        held += row["n"]
        if held > words:
            break
        lowest = row["band"]
    if lowest is None:
        return []
    kept = summed.where(F.col("band") >= lowest).collect()
    return [bytes(row["word"]) for row in sorted(kept, key=lambda row: (-row["n"], row["word"]))]


def build_lexicon(vocabulary: Vocabulary, words: list[bytes]) -> bytes:
    words = [word for word in words if word]
    sizes = np.array([len(word) for word in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    ids, offsets = merge_words(vocabulary, np.frombuffer(b"".join(words), dtype=np.uint8), ends - sizes, ends)
    return lexicon.build((word, ids[offsets[i] : offsets[i + 1]].tolist()) for i, word in enumerate(words))


class Encoder:
    def __init__(self, vocabulary: Vocabulary, blob: bytes) -> None:
        self.vocabulary, self.splitter, self.lexicon = vocabulary, Splitter(vocabulary), lexicon.Lexicon(blob)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts back to back, and n + 1 offsets."""
        tokens = self.splitter.split(data, offsets)
        first, word_of, _ = _distinct(tokens)
        starts, ends, special = tokens.starts[first], tokens.ends[first], tokens.special[first]
        known = np.where(special < 0, self.lexicon.find(tokens.data, starts, ends), -1)
        unseen = np.flatnonzero((known < 0) & (special < 0))
        ids, cuts = merge_words(self.vocabulary, tokens.data, starts[unseen], ends[unseen])
        # One table of ids for all words: the lexicon's, the merged, the special.
        table = np.concatenate((self.lexicon.ids, ids, special[special >= 0]))
        begin, count = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64)
        seen = known >= 0
        begin[seen] = self.lexicon.offsets[known[seen]]
        count[seen] = self.lexicon.offsets[known[seen] + 1] - begin[seen]
        begin[unseen] = len(self.lexicon.ids) + cuts[:-1]
        count[unseen] = np.diff(cuts)
        set_apart = special >= 0
        begin[set_apart] = len(self.lexicon.ids) + len(ids) + np.arange(int(set_apart.sum()))
        count[set_apart] = 1
        counts = count[word_of]
        out = table[kernels.repeat_ranges(begin[word_of], counts)]
        per_row = np.bincount(tokens.rows, weights=counts, minlength=len(offsets) - 1).astype(np.int64)
        return out, np.concatenate(([0], np.cumsum(per_row)))


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens and ids (little-endian unsigned
    32-bit integers back to back), without added special tokens.

    Special tokens that stand in a text as such keep their ids. Null or empty text
    has no ids. Equal texts get equal ids. Other columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary = read_vocabulary(path)
    blob = build_lexicon(vocabulary, frequent_words(docs, path, text_col, words))
    sent = spark.sparkContext.broadcast(cloudpickle.dumps((vocabulary, blob)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*pickle.loads(sent.value))
        for batch in batches:
            for rows, data, offsets in kernels.pieces(batch, "text", PIECE):
                ids, cuts = encoder.encode(data, offsets)
                raw = ids.astype("<u4").tobytes()
                packed = [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("id")), pa.array(np.diff(cuts), pa.int64()), pa.array(packed, pa.binary())], names=["id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(encode, f"id {kind}, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of ``encoded`` (ids among them) and decoded: the tokens of the
    ids, blanks between them, as the vocabulary without a decoder gives them.

    Null ids decode to the empty text; an id outside the vocabulary is an error.
    """
    names = [name for name in encoded.columns if name != "decoded"]
    sent = encoded.sparkSession.sparkContext.broadcast(cloudpickle.dumps(read_vocabulary(path)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pickle.loads(sent.value)
        # Each token with a blank behind it; the last blank of a text goes.
        sizes = np.diff(vocabulary.token_offsets)
        for batch in batches:
            for rows, data, offsets in kernels.pieces(batch, "ids", PIECE):
                ids = np.frombuffer(data.tobytes(), dtype="<u4").astype(np.int64)
                if len(ids) and ids.max() >= len(sizes):
                    raise ValueError("An id lies outside the vocabulary.")
                count = sizes[ids]
                ends = np.cumsum(count + 1)
                out = np.full(int(ends[-1]) if len(ids) else 0, 32, dtype=np.uint8)
                out[kernels.repeat_ranges(ends - count - 1, count)] = vocabulary.token_bytes[kernels.repeat_ranges(vocabulary.token_offsets[ids], count)]
                stops = np.concatenate(([0], ends))[offsets // 4]
                raw = out.tobytes()
                texts = [raw[a : max(a, b - 1)].decode("utf-8") for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(name)) for name in names), pa.array(texts, pa.string())], names=[*names, "decoded"])

    fields = ", ".join(f"`{name}` {encoded.schema[name].dataType.simpleString()}" for name in names)
    return encoded.select(*names).mapInArrow(decode, f"{fields}, decoded string")

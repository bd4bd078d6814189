"""Lossless WebP: a full decoder and an encoder for byte payloads.

The decoder reads the whole lossless format: simple and canonical prefix codes,
meta prefix images, back-references, the colour cache, and the predictor,
cross-colour, subtract-green and palette transforms. An image of one group of
codes is read as arrays: every bit at which a plain pixel could begin tells where the
next one would, the symbols are those met on the way from the first, and copied
and cached pixels follow their sources. The encoder writes uneven prefix codes,
back-references, and the colour cache and subtract-green where they pay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np

LARGEST_SIDE = 1 << 14

#: Fixed values of the format: the order of code length codes, and the nearby
#: pixels (left, up) that the first 120 distance codes name.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEARBY = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1),
    (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4),
    (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6),
    (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5),
    (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class BadImage(ValueError):
    """The bytes are not a lossless WebP image."""


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise BadImage("The image ends early.")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[first:last], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)

    def peek(self, n: int, at: int | None = None) -> int:
        """The next bits, or those from ``at`` on, noughts behind the end; none is taken."""
        at = self.at if at is None else at
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)


@cache
def _turned(n: int) -> np.ndarray:
    """All numbers of n bits, each with its bits in reverse."""
    out = np.zeros(1, dtype=np.int32)
    for _ in range(n):
        out = np.concatenate((out * 2, out * 2 + 1))
    return out


@dataclass
class Code:
    """A prefix code: its only symbol, or symbols by the bits that follow."""

    only: int | None
    #: 16 times the symbol, and its length, by the next bits, as many as the longest has.
    symbols: np.ndarray
    #: Length shared by all symbols, else None; and the symbols in code order.
    fixed: int | None
    order: np.ndarray

    @property
    def depth(self) -> int:
        return len(self.symbols).bit_length() - 1

    def read(self, bits: Bits) -> int:
        found = int(self.symbols[bits.peek(self.depth)])
        bits.read(found & 15)
        return found >> 4


def _only(symbol: int) -> Code:
    return Code(symbol, np.array([symbol << 4]), 0, np.array([symbol]))


def make_code(lengths: list[int]) -> Code:
    """The canonical code of symbols with these lengths; nought means unused."""
    return _code(bytes(lengths))


@lru_cache(maxsize=64)
def _code(lengths: bytes) -> Code:
    """Two channels of an image often have one code."""
    given = np.frombuffer(lengths, dtype=np.uint8)
    used = given.nonzero()[0]
    if len(used) < 2:
        return _only(int(used[0]) if len(used) else 0)
    order = used[given[used].argsort(kind="stable")]
    sizes = given[order].astype(np.int64)
    depth = int(sizes[-1])
    times = 1 << depth - sizes
    if int(times.sum()) != 1 << depth:
        raise BadImage("A prefix code is not complete.")
    return Code(None, (order << 4 | sizes).repeat(times)[_turned(depth)], depth if sizes[0] == depth else None, order)


@cache
def _length_reader(lengths: tuple[int, ...]) -> tuple[int, list[int]]:
    """Depth and symbols of a code of code lengths."""
    code = make_code(list(lengths))
    return code.depth, code.symbols.tolist()


def _read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        chosen = [bits.read(8 if wide else 1)]
        if two:
            chosen.append(bits.read(8))
        if max(chosen) >= alphabet:
            raise BadImage("A symbol lies outside its alphabet.")
        if len(set(chosen)) == 1:
            return _only(chosen[0])
        held = np.array(sorted(chosen))
        return Code(None, held << 4 | 1, 1, held)
    own = [0] * 19
    n = 4 + bits.read(4)
    word = bits.read(3 * n)
    for i, place in enumerate(LENGTH_ORDER[:n]):
        own[place] = word >> 3 * i & 7
    most = alphabet
    if bits.read(1):
        most = 2 + bits.read(2 + 2 * bits.read(3))
    depth, symbols = _length_reader(tuple(own))
    lengths: list[int] = []
    last, mask, word, left, at, n = 8, (1 << depth) - 1, 0, 0, bits.at, 0
    for _ in range(most):
        if n >= alphabet:
            break
        if left < 14:
            # The next bits, many at a time.
            at -= left
            word = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 64], "little") >> (at & 7)
            left = 512 - (at & 7)
            at += left
        found = symbols[word & mask]
        taken = found & 15
        if found < 256:
            found >>= 4
            lengths.append(found)
            n += 1
            if found:
                last = found
        else:
            base, extra = ((3, 2), (3, 3), (11, 7))[(found >> 4) - 16]
            run = base + (word >> taken & (1 << extra) - 1)
            lengths += [last if found < 272 else 0] * run
            n += run
            taken += extra
        word >>= taken
        left -= taken
    bits.at = at - left
    if bits.at > bits.end:
        raise BadImage("The image ends early.")
    if n > alphabet:
        raise BadImage("Code lengths run past their alphabet.")
    return make_code(lengths + [0] * (alphabet - n))


def _read_codes(bits: Bits, slots: int) -> list[Code]:
    """The five codes of a group: green, lengths and places of the cache, red, blue,
    alpha, distances. Red and blue are often written alike: then blue's is red's."""
    green = _read_code(bits, 280 + slots)
    start = bits.at
    red = _read_code(bits, 256)
    size = bits.at - start
    if size > 64 and bits.at + size <= bits.end and bits.peek(size) == bits.peek(size, start):
        blue = red
        bits.at += size
    else:
        blue = _read_code(bits, 256)
    return [green, red, blue, _read_code(bits, 256), _read_code(bits, 40)]


def _span(bits: Bits, symbol: int) -> int:
    """The length or distance that a prefix symbol and its extra bits stand for."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB pixels in reading order, as the entropy-coded image holds them."""
    total = width * height
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("The colour cache is too large.")
    slots = 1 << cache_bits if cache_bits else 0
    which, block, across = None, 0, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        which = _read_image(bits, across, -(-height >> block), False) >> 8 & 0xFFFF
    groups = [_read_codes(bits, slots) for _ in range(1 if which is None else int(which.max()) + 1)]
    if which is None:
        return _one_group(bits, groups[0], width, total, cache_bits)
    out = [0] * total
    held = [0] * slots
    at = 0
    while at < total:
        codes = groups[0 if which is None else int(which[(at // width >> block) * across + (at % width >> block)])]
        symbol = codes[0].read(bits)
        if symbol < 256:
            red, blue, alpha = (code.read(bits) for code in codes[1:4])
            made = [alpha << 24 | red << 16 | symbol << 8 | blue]
        elif symbol < 280:
            length = _span(bits, symbol - 256)
            code = _span(bits, codes[4].read(bits))
            if code > 120:
                back = code - 120
            else:
                left, up = NEARBY[code - 1]
                back = max(1, left + up * width)
            if back > at or at + length > total:
                raise BadImage("A back-reference leaves the image.")
            made = [out[at - back + i % back] for i in range(length)]
        else:
            made = [held[symbol - 280]]
        for colour in made:
            out[at] = colour
            at += 1
            if slots:
                held[(CACHE_FACTOR * colour & 0xFFFFFFFF) >> (32 - cache_bits)] = colour
    return np.array(out, dtype=np.uint32)


_LEFT, _UP = np.array(NEARBY, dtype=np.int64).T


#: Bits that are looked at together: bounds the memory that reading takes.
WINDOW = 1 << 20


def _one_group(bits: Bits, codes: list[Code], width: int, total: int, cache_bits: int) -> np.ndarray:
    """ARGB pixels of an image whose pixels all take the same codes."""
    if not any(code.depth for code in codes[:4]) and codes[0].only < 256:
        green, red, blue, alpha = (code.only for code in codes[:4])
        return np.full(total, alpha << 24 | red << 16 | green << 8 | blue, dtype=np.uint32)
    widest = max(sum(code.depth for code in codes[:4]), codes[0].depth + 10 + codes[4].depth + 18)
    parts, at, done = [], bits.at, 0
    while done < total:
        if at > bits.end:
            raise BadImage("The image ends early.")
        first = at
        *part, at = _symbols(bits, codes, first, min(bits.end - first + 1, (total - done) * widest + 1, WINDOW), total - done)
        parts.append(part)
        done += int(part[1].sum())
        if at == first and done < total and codes[0].only is not None:
            raise BadImage("The image ends early.")
    symbols, counts, colours, backs, following = parts[0] if len(parts) == 1 else (np.concatenate(held) for held in zip(*parts, strict=True))
    ends = np.cumsum(counts)
    used = int(np.searchsorted(ends, total)) + 1
    bits.at = int(following[used - 1])
    if bits.at > bits.end:
        raise BadImage("The image ends early.")
    symbols, counts, starts = symbols[:used], counts[:used], (ends - counts)[:used]
    copying = np.flatnonzero((symbols > 255) & (symbols < 280))
    distances = backs[copying]
    back = distances - 120
    near = distances <= 120
    back[near] = np.maximum(1, _LEFT[distances[near] - 1] + _UP[distances[near] - 1] * width)
    if ends[used - 1] > total or (back > starts[copying]).any():
        raise BadImage("A back-reference leaves the image.")

    plain = np.flatnonzero(symbols < 256)
    # One more than there are: what an empty place of the cache holds.
    out = np.zeros(total + 1, dtype=np.uint32)
    out[starts[plain]] = colours[plain]
    if len(plain) == total:
        return out[:total]
    source = np.arange(total + 1)
    lengths = counts[copying]
    where = np.repeat(starts[copying] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
    source[where] -= np.repeat(back, lengths)
    source = _followed(source)
    cached = np.flatnonzero(symbols >= 280)
    if len(cached):
        # A place names the newest pixel before that fell into it, however that came.
        place = np.zeros(total + 1, dtype=np.uint16)
        place[starts[plain]] = _place(out[starts[plain]], cache_bits)
        place[starts[cached]] = symbols[cached] - 280
        place = place[source][:total]
        order = np.argsort(place, kind="stable")
        before = np.full(total, total)
        same = place[order[1:]] == place[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        source[starts[cached]] = before[starts[cached]]
        source = _followed(source)
    return out[source][:total]


def _symbols(bits: Bits, codes: list[Code], start: int, n: int, most: int) -> tuple:
    """Of the symbols met from bit ``start`` on that begin within ``n`` bits, ``most``
    at most: green or other, how many pixels it makes, colour, distance code, and
    the bit behind it; and the bit behind the last."""
    masks = [len(code.symbols) - 1 for code in codes]
    # Symbols with their lengths, and lengths alone, in few bytes.
    tables = [code.symbols.astype(np.uint16) for code in codes]
    first, at = start >> 3, start & 7
    n += at
    raw = np.zeros((n >> 3) + 16, dtype=np.uint32)
    given = np.frombuffer(bits.data, dtype=np.uint8, offset=first, count=min(len(bits.data) - first, len(raw)))
    raw[: len(given)] = given
    # The next 16 bits from every bit on.
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    peek = (words[:, None] >> np.arange(8, dtype=np.uint32)).ravel().astype(np.uint16)

    # Behind a plain pixel that begins at a bit; nought where another symbol would.
    held = tables[0].take(peek[:n] & masks[0])
    following = np.arange(n)
    following += held & 15
    last = None
    for code, table, mask in zip(codes[1:4], tables[1:], masks[1:], strict=False):
        if mask:
            if last is not code.symbols:
                # Two channels often have one code.
                sizes, last = (table & 15).astype(np.uint8).take(peek[: n + 48] & mask), code.symbols
            following += sizes.take(following)
    if int(codes[0].order.max()) > 255:
        following[held >= 256 << 4] = 0
    steps, near = memoryview(following), memoryview(peek)
    begins: list[int] = []
    others: list[tuple[int, int, int]] = []
    for _ in range(most):
        if at >= n:
            break
        begins.append(at)
        behind = steps[at]
        if behind:
            at = behind
            continue
        found = int(held[at])
        at += found & 15
        if found >= 280 << 4:
            continue
        length, at = _spanned(near, at, (found >> 4) - 256)
        found = int(tables[4][near[at] & masks[4]])
        distance, at = _spanned(near, at + (found & 15), found >> 4)
        others.append((len(begins) - 1, length, distance))
    spots = np.array(begins, dtype=np.int64)
    symbols = held.take(spots).astype(np.int64)
    place = spots + (symbols & 15)
    symbols >>= 4
    counts, backs = np.ones(len(spots), dtype=np.int64), np.zeros(len(spots), dtype=np.int64)
    if others:
        which, lengths, distances = np.array(others).T
        counts[which], backs[which] = lengths, distances
    colours = symbols << 8
    for kind, shift in ((1, 16), (2, 0), (3, 24)):
        if masks[kind]:
            found = tables[kind].take(peek.take(place) & masks[kind]).astype(np.int64)
            colours |= found >> 4 << shift
            place += found & 15
        else:
            colours |= codes[kind].only << shift
    ends = np.append(spots[1:], at) + 8 * first
    return symbols, counts, colours, backs, ends, at + 8 * first


def _spanned(near: memoryview, at: int, symbol: int) -> tuple[int, int]:
    """`_span` of a symbol whose extra bits begin at ``at``, and the bit behind them."""
    if symbol < 4:
        return symbol + 1, at
    extra = (symbol - 2) >> 1
    more = near[at] | near[at + 16] << 16
    return ((2 + (symbol & 1)) << extra) + (more & (1 << extra) - 1) + 1, at + extra


def _followed(source: np.ndarray) -> np.ndarray:
    """Every place's last source; one that is its own source is a last one."""
    while True:
        further = source[source]
        if (further == source).all():
            return source
        source = further


def _place(colours: np.ndarray, cache_bits: int) -> np.ndarray:
    """Places of ARGB colours (uint32) in the colour cache."""
    return (colours * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)


def _channels(pixel: int) -> tuple[int, int, int, int]:
    return pixel >> 24, pixel >> 16 & 255, pixel >> 8 & 255, pixel & 255


def _joined(channels) -> int:
    alpha, red, green, blue = channels
    return alpha << 24 | red << 16 | green << 8 | blue


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _clamp(value: int) -> int:
    return min(255, max(0, value))


def _half(value: int) -> int:
    """Half, cut towards nought."""
    return -(-value // 2) if value < 0 else value // 2


def predict(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The pixel foretold from its neighbours; ``right`` and ``corner`` stand
    right and left of the one above."""
    if mode in (0, 14, 15):
        return 0xFF000000
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode in (5, 10):
        return _mean(_mean(left, right), top) if mode == 5 else _mean(_mean(left, corner), _mean(top, right))
    if mode in (6, 7, 8, 9):
        return _mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    lefts, tops, corners = _channels(left), _channels(top), _channels(corner)
    if mode == 11:
        # The estimate is left + top - corner: its distance from either one.
        from_left = sum(abs(t - c) for t, c in zip(tops, corners, strict=True))
        from_top = sum(abs(a - c) for a, c in zip(lefts, corners, strict=True))
        return left if from_left < from_top else top
    if mode == 12:
        return _joined(_clamp(a + t - c) for a, t, c in zip(lefts, tops, corners, strict=True))
    return _joined(_clamp(a + _half(a - c)) for a, c in zip(_channels(_mean(left, top)), corners, strict=True))


def _add(a: int, b: int) -> int:
    return (a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00 | (a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF


def _undo_predictor(pixels: np.ndarray, width: int, block: int, modes: np.ndarray) -> np.ndarray:
    out, across = pixels.tolist(), -(-width >> block)
    for at in range(len(out)):
        y, x = divmod(at, width)
        if not at:
            guess = 0xFF000000
        elif not y:
            guess = out[at - 1]
        elif not x:
            guess = out[at - width]
        else:
            mode = int(modes[(y >> block) * across + (x >> block)]) >> 8 & 15
            # Right of the last column stands the first pixel of this row.
            guess = predict(mode, out[at - 1], out[at - width], out[at - width + 1], out[at - width - 1])
        out[at] = _add(out[at], guess)
    return np.array(out, dtype=np.uint32)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint8).view(np.int8).astype(np.int32)


def _undo_cross_colour(pixels: np.ndarray, width: int, block: int, factors: np.ndarray) -> np.ndarray:
    y, x = np.divmod(np.arange(len(pixels)), width)
    held = factors[(y >> block) * -(-width >> block) + (x >> block)]
    green = _signed(pixels >> 8 & 255)
    red = (pixels >> 16 & 255).astype(np.int32) + (_signed(held & 255) * green >> 5) & 255
    blue = (pixels & 255).astype(np.int32) + (_signed(held >> 8 & 255) * green >> 5) + (_signed(held >> 16 & 255) * _signed(red) >> 5) & 255
    return pixels & np.uint32(0xFF00FF00) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def _undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> np.uint32(8) & np.uint32(255)
    both = (pixels & np.uint32(0x00FF00FF)) + (green << np.uint32(16) | green) & np.uint32(0x00FF00FF)
    return pixels & np.uint32(0xFF00FF00) | both


def packed_bits(colours: int) -> int:
    """The palette packs 2 to this power pixels into one."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(pixels: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    pack = packed_bits(len(table))
    green = (pixels >> 8 & 255).reshape(height, -1)
    each = 8 >> pack
    parts = [green >> each * i & (1 << each) - 1 for i in range(1 << pack)]
    index = np.stack(parts, axis=2).reshape(height, -1)[:, :width].ravel()
    whole = np.zeros(256, dtype=np.uint32)
    whole[: len(table)] = table
    return whole[index]


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and ARGB pixels (uint32, row by row) of a lossless WebP file."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise BadImage("This is no WebP file.")
    at = 12
    while at + 8 <= len(data) and data[at : at + 4] != b"VP8L":
        at += 8 + (int.from_bytes(data[at + 4 : at + 8], "little") + 1 & ~1)
    size = int.from_bytes(data[at + 4 : at + 8], "little")
    stream = data[at + 8 : at + 8 + size]
    if not stream or stream[0] != 0x2F or len(stream) < size:
        raise BadImage("The file holds no whole lossless image.")
    bits = Bits(stream)
    bits.at = 8
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise BadImage("The version is not known.")
    undo, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [step[0] for step in undo]:
            raise BadImage("A transform comes twice.")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            undo.append((kind, wide, block, _read_image(bits, -(-wide >> block), -(-height >> block), False)))
        elif kind == PALETTE:
            colours = bits.read(8) + 1
            steps = _read_image(bits, colours, 1, False)
            table = np.cumsum(steps.view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8).view(np.uint32).ravel()
            undo.append((kind, wide, 0, table))
            wide = -(-wide >> packed_bits(colours))
        else:
            undo.append((kind, wide, 0, None))
    pixels = _read_image(bits, wide, height, True)
    for kind, wide, block, held in reversed(undo):
        if kind == PREDICTOR:
            pixels = _undo_predictor(pixels, wide, block, held)
        elif kind == CROSS_COLOUR:
            pixels = _undo_cross_colour(pixels, wide, block, held)
        elif kind == SUBTRACT_GREEN:
            pixels = _undo_subtract_green(pixels)
        else:
            pixels = _undo_palette(pixels, wide, height, held)
    return width, height, pixels


def container(stream: bytes) -> bytes:
    """A file around a lossless stream."""
    chunk = b"VP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


#: Fields that are packed, and pixels among which repeats are sought, together; a power of 2.
BLOCK = 1 << 18


class _Fields:
    """Numbers of up to 56 bits each, put behind one another."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.done = bytearray()

    def put(self, values, sizes) -> None:
        self.values.append(np.asarray(values, dtype=np.int64).ravel())
        self.sizes.append(np.asarray(sizes, dtype=np.int64).ravel())

    def pack(self) -> None:
        """Turns what was put into bytes, but for the bits of the last one begun."""
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        held = sizes.nonzero()[0]
        values, sizes = values[held], sizes[held]
        ends = sizes.cumsum()
        begins = ends - sizes
        # No two fields share a bit, so adding what falls into a byte joins it.
        deep = (int(sizes.max(initial=0)) + 14) >> 3
        parts = (values << (begins & 7)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :deep]
        at = (begins >> 3)[:, None] + np.arange(deep)
        whole, left = divmod(int(sizes.sum()), 8)
        out = np.bincount(at.ravel(), weights=parts.ravel(), minlength=whole + 1)
        self.done += out[:whole].astype(np.uint8).tobytes()
        self.values, self.sizes = [np.array([int(out[whole])])], [np.array([left])]

    def stream(self) -> bytes:
        """All of it, once packed."""
        return bytes(self.done) + self.values[0].astype(np.uint8).tobytes()[: int(self.sizes[0][0] > 0)]


def _code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a complete prefix code, ``most`` at most, of the symbols that
    occur; a symbol alone has length 1. Lengths are rounded up from each
    symbol's share; the room this leaves goes to those that lost most by it."""
    out = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts)
    weights = np.maximum(counts[used], counts.sum() / (1 << most - 1))
    exact = np.log2(weights.sum() / weights)
    sizes = np.maximum(1, np.ceil(exact)).astype(np.int64)
    order = np.argsort(exact - sizes, kind="stable")
    held = sizes[order].tolist()
    room = (1 << most) - sum(1 << most - size for size in held)
    while room and len(held) > 1:
        for i, size in enumerate(held):
            if size > 1 and 1 << most - size <= room:
                held[i] -= 1
                room -= 1 << most - size
    out[used[order]] = held
    return out


def _spellings(lengths: np.ndarray) -> np.ndarray:
    """The bits of every symbol of a canonical code, the first bit the lowest."""
    out = np.zeros(len(lengths), dtype=np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    sizes = lengths[order]
    depth = int(sizes[-1])
    room = 1 << depth - sizes
    out[order] = _turned(depth)[np.cumsum(room) - room]
    return out


#: Lengths of the code in which the lengths of the others are written: those that
#: codes of a text's bytes often have are short.
_OWN = [3, 7, 6, 6, 4, 3, 3, 3, 3, 4, 6, 6, 6, 7, 7, 7, 6, 4, 4]
_OWN_SIZES = np.array(_OWN)
_OWN_WORDS = _spellings(_OWN_SIZES)
_OWN_HEAD = ([0, len(LENGTH_ORDER) - 4, *(_OWN[place] for place in LENGTH_ORDER), 0], [1, 4, *[3] * len(LENGTH_ORDER), 1])


def _write_code(head: _Fields, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a code for symbols that occur so often; the bits of each and their number."""
    used = counts.nonzero()[0]
    if len(used) < 3 and (not len(used) or used[-1] < 256):
        chosen = used.tolist() or [0]
        head.put([1, len(chosen) - 1, 1, *chosen], [1, 1, 1, *[8] * len(chosen)])
        spelled, sizes = np.zeros(len(counts), dtype=np.int64), np.zeros(len(counts), dtype=np.int64)
        spelled[chosen], sizes[chosen] = range(len(chosen)), len(chosen) - 1
        return spelled, sizes
    sizes = _code_lengths(counts, 15)
    # Lengths as runs: a symbol, and from bits 5 and 8 the number of its extra bits and they.
    runs: list[int] = []
    begins = np.append(0, (sizes[1:] != sizes[:-1]).nonzero()[0] + 1)
    for size, run in zip(sizes[begins].tolist(), (np.append(begins[1:], len(sizes)) - begins).tolist(), strict=True):
        if size or run < 3:
            runs.append(size)
            run -= 1
        while run:
            symbol, most, least, extra = (16, 6, 3, 2) if size else (18, 138, 11, 7) if run > 10 else (17, 10, 3, 3)
            taken = min(run, most)
            if run < least:
                runs += [size] * run
            else:
                runs.append(symbol | extra << 5 | taken - least << 8)
            run -= taken
    head.put(*_OWN_HEAD)
    packed = np.array(runs)
    symbols = packed & 31
    widths = _OWN_SIZES[symbols]
    head.put(_OWN_WORDS[symbols] | packed >> 8 << widths, widths + (packed >> 5 & 7))
    return _spellings(sizes), sizes


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols of lengths or distances, their extra bits and the number of these."""
    value = values - 1
    extra = np.maximum(np.frexp(value.astype(np.float64))[1] - 2, 0).astype(np.int64)
    symbol = np.where(value < 4, value, 2 * extra + (value >> extra))
    extra[value < 4] = 0
    return symbol, value & (1 << extra) - 1, extra


#: Pixels of one back-reference at most; its distance is bounded by BLOCK.
LONGEST = 4096


def _matches(colours: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Starts, lengths (3 at least) and distances of repeats, each of the newest
    place that shares its start, taken from left to right."""
    starts: list[int] = []
    lengths: list[int] = []
    backs: list[int] = []
    if len(colours) < 4:
        return starts, lengths, backs
    # Hashes of three pixels with their place below, which is less than BLOCK.
    wide = colours.astype(np.uint64)
    keys = (wide[:-2] | wide[1:-1] << np.uint64(24) | wide[2:] << np.uint64(48)) * np.uint64(0x9E3779B97F4A7C15)
    keys = np.sort(keys & np.uint64(-BLOCK % 2**64) | np.arange(len(keys), dtype=np.uint64))
    order = (keys & np.uint64(BLOCK - 1)).astype(np.int64)
    same = ((keys[1:] ^ keys[:-1]) < BLOCK).nonzero()[0]
    before = np.zeros(len(keys), dtype=np.int64)
    before[order[same + 1]] = order[same] + 1
    spots = before.nonzero()[0]
    at = 0
    for spot, earlier in zip(spots.tolist(), (before[spots] - 1).tolist(), strict=True):
        if spot < at:
            continue
        length, part = 0, 16
        while length < LONGEST:
            here = colours[spot + length : spot + min(LONGEST, length + part)]
            differ = np.flatnonzero(here != colours[earlier + length : earlier + length + len(here)])
            length += int(differ[0]) if len(differ) else len(here)
            if len(differ) or len(here) < part:
                break
            part *= 4
        if length > 2:
            starts.append(spot)
            lengths.append(length)
            backs.append(spot - earlier)
            at = spot + length
    return starts, lengths, backs


_SAVED = np.arange(1 << 16) * np.log2(np.maximum(1, np.arange(1 << 16)))


def _order_in(counts: np.ndarray) -> float:
    """What a code saves of as many symbols of one share each, in bits."""
    if counts.max() < len(_SAVED):
        return float(_SAVED[counts].sum())
    held = counts[counts > 1]
    return float((held * np.log2(held)).sum())


def _cost(*counts: np.ndarray) -> float:
    """Bits of symbols that occur so often, and some five for each one's length."""
    every = np.concatenate(counts)
    whole = (int(held.sum()) for held in counts)
    return sum(n * math.log2(max(1, n)) for n in whole) - _order_in(every) + 5 * np.count_nonzero(every)


@cache
def _near(width: int) -> dict[int, int]:
    """Distances that have a code of their own, in an image of this width."""
    out: dict[int, int] = {}
    for number, (left, up) in enumerate(NEARBY):
        out.setdefault(max(1, left + up * width), number + 1)
    return out


def encode(samples: np.ndarray, width: int, height: int) -> bytes:
    """A lossless WebP file of width x height RGB pixels (uint8, three a pixel)."""
    if not (0 < width <= LARGEST_SIDE and 0 < height <= LARGEST_SIDE and len(samples) == 3 * width * height):
        raise ValueError("The samples do not make an image of this size.")
    red, green, blue = (np.ascontiguousarray(samples[channel::3]) for channel in range(3))
    total = len(green)
    head = _Fields()
    head.put([0x2F, width - 1, height - 1, 0], [8, 14, 14, 4])
    plain = _order_in(np.bincount(red)) + _order_in(np.bincount(blue))
    if _order_in(np.bincount(red - green)) + _order_in(np.bincount(blue - green)) > plain:
        red, blue = red - green, blue - green
        head.put([1, SUBTRACT_GREEN], [1, 2])
    head.put([0], [1])
    colours = red.astype(np.uint32) << np.uint32(16) | green.astype(np.uint32) << np.uint32(8) | blue

    found_in = [(at, _matches(colours[at : at + BLOCK])) for at in range(0, total, BLOCK)]
    starts = np.array([at + start for at, part in found_in for start in part[0]], dtype=np.int64)
    lengths, backs = (np.array([value for _, part in found_in for value in part[i]], dtype=np.int64) for i in (1, 2))
    # One symbol for each pixel that no repeat covers, and one for each repeat.
    change = np.zeros(total + 1, dtype=np.int8)
    change[starts] += 1
    change[starts + lengths] -= 1
    literal = np.cumsum(change[:-1], dtype=np.int8) == 0
    near = _near(width)
    far = [near.get(back, back + 120) for back in backs.tolist()]
    (long, far), (long_more, far_more), (long_extra, far_extra) = (part.reshape(2, -1) for part in _prefixed(np.append(lengths, np.array(far, dtype=np.int64))))

    def counted(literal: np.ndarray, places: np.ndarray, slots: int) -> list[np.ndarray]:
        greens = np.bincount(np.concatenate((green[literal], long + 256, places + 280)), minlength=280 + slots)
        return [greens, np.bincount(red[literal], minlength=256), np.bincount(blue[literal], minlength=256)]

    cache_bits, found = 0, np.zeros(total, dtype=bool)
    counts = counted(literal, long[:0], 0)
    if total > 16:
        tried = min(10, max(1, total.bit_length() - 5))
        places = _place(colours | np.uint32(0xFF000000), tried).astype(np.uint16)
        order = np.argsort(places, kind="stable")
        # Found: the newest pixel before in its place has its colour.
        hit = np.zeros(total, dtype=bool)
        hit[order[1:]] = colours[order[1:]] == colours[order[:-1]]
        hit &= literal
        # A code for places is dear to a small image, so it must spare many pixels.
        if 4 * np.count_nonzero(hit) > np.count_nonzero(literal):
            other = counted(literal & ~hit, places[hit].astype(np.int64), 1 << tried)
            if _cost(*other) < _cost(*counts):
                cache_bits, found, counts = tried, hit, other
                literal = literal & ~hit
    head.put([cache_bits > 0, cache_bits, 0], [1, 4 * (cache_bits > 0), 1])
    greens, green_sizes = _write_code(head, counts[0])
    both, begun = counts[1] + counts[2], len(head.values)
    if _order_in(both) - 2 * int(counts[1].sum()) > 0.98 * (_order_in(counts[1]) + _order_in(counts[2])):
        # Red and blue are much alike, as in texts: their code is made once.
        reds, red_sizes = blues, blue_sizes = _write_code(head, both)
        head.values += head.values[begun:]
        head.sizes += head.sizes[begun:]
    else:
        (reds, red_sizes), (blues, blue_sizes) = (_write_code(head, held) for held in counts[1:])
    # Alpha is always 255: a code of one symbol.
    head.put([1, 0, 1, 255], [1, 1, 1, 8])
    fars, far_sizes = _write_code(head, np.bincount(far, minlength=40))

    # Two fields a pixel: a colour, a place or a length; and a distance.
    for begin in range(0, total, BLOCK):
        block = slice(begin, begin + BLOCK)
        n = min(BLOCK, total - begin)
        fields, sizes = np.zeros((n, 2), dtype=np.int64), np.zeros((n, 2), dtype=np.int64)
        here = literal[block]
        g, r, b = green[block][here], red[block][here], blue[block][here]
        shift = green_sizes[g] + red_sizes[r]
        fields[here, 0] = greens[g] | reds[r] << green_sizes[g] | blues[b] << shift
        sizes[here, 0] = shift + blue_sizes[b]
        if cache_bits:
            here = found[block]
            symbols = places[block][here].astype(np.int64) + 280
            fields[here, 0], sizes[here, 0] = greens[symbols], green_sizes[symbols]
        own = slice(*starts.searchsorted([begin, begin + n]).tolist())
        here, symbols, codes = starts[own] - begin, long[own] + 256, far[own]
        fields[here, 0] = greens[symbols] | long_more[own] << green_sizes[symbols]
        sizes[here, 0] = green_sizes[symbols] + long_extra[own]
        fields[here, 1] = fars[codes] | far_more[own] << far_sizes[codes]
        sizes[here, 1] = far_sizes[codes] + far_extra[own]
        head.put(fields, sizes)
        head.pack()
    return container(head.stream())

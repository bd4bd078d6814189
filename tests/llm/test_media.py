import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import media, webp

SCHEMA = "doc_id long, text string"


class Writer:
    """Bits of a lossless stream, least significant first."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def code(self, lengths):
        """Write a canonical code plainly; returns a function that writes a symbol."""
        used = [symbol for symbol, length in enumerate(lengths) if length]
        if len(used) <= 1:
            self.put(1, 1), self.put(0, 1), self.put(1, 1), self.put(used[0] if used else 0, 8)
            return lambda symbol: None
        self.put(0, 1), self.put(15, 4)
        for place in webp.LENGTH_ORDER:
            self.put(4 if place < 16 else 0, 3)
        self.put(0, 1)
        for length in lengths:
            self.put(int(f"{length:04b}"[::-1], 2), 4)
        codes, code, before = {}, 0, 0
        for length, symbol in sorted((length, symbol) for symbol, length in enumerate(lengths) if length):
            code <<= length - before
            before, codes[symbol] = length, (code, length)
            code += 1

        def write(symbol):
            value, length = codes[symbol]
            self.bits += [value >> (length - 1 - i) & 1 for i in range(length)]

        return write

    def stream(self, width, height, body):
        head = Writer()
        head.put(0x2F, 8), head.put(width - 1, 14), head.put(height - 1, 14), head.put(0, 4)
        bits = head.bits + body
        return webp.container(np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes())


def lengths_for(symbols, size):
    """Uneven complete code lengths: 1, 2, 3, ... with the last two alike."""
    used = sorted(set(symbols))
    out = [0] * size
    if len(used) > 14:
        n = max(1, (len(used) - 1).bit_length())
        for symbol in range(size):
            out[symbol] = 0
        filler = [s for s in range(size) if s not in used][: (1 << n) - len(used)]
        for symbol in used + filler:
            out[symbol] = n
        return out
    for i, symbol in enumerate(used):
        out[symbol] = min(i + 1, max(1, len(used) - 1))
    return out


def prefix(value):
    """Prefix symbol, extra bits and their number for a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    second = value >> (high - 1) & 1
    return 2 * high + second, value & ((1 << (high - 1)) - 1), high - 1


def write_image(out, pixels, width, cache_bits=0, main=True, groups=None, block=2):
    """Entropy-code pixels with runs, cache references and, if asked, two groups."""
    out.put(1, 1) if cache_bits else out.put(0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    height = len(pixels) // width
    across = -(-width >> block)
    if main:
        out.put(int(groups is not None), 1)
        if groups is not None:
            out.put(block - 2, 3)
            write_image(out, [group << 8 for group in groups], across, main=False)
    steps, cache, at = [], {}, 0
    while at < len(pixels):
        best = (0, 0)
        for back in (1, 2, width - 1, width, width + 1, 2 * width, 150):
            run = 0
            while 0 < back <= at and at + run < len(pixels) and run < 300 and pixels[at + run] == pixels[at + run - back]:
                run += 1
            best = max(best, (run, back))
        place = (0x1E35A7BD * pixels[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        spot = at
        if best[0] >= 3:
            steps.append((spot, "run", best))
            count = best[0]
        elif cache_bits and cache.get(place) == pixels[at]:
            steps.append((spot, "cache", place))
            count = 1
        else:
            steps.append((spot, "pixel", pixels[at]))
            count = 1
        for colour in pixels[at : at + count]:
            if cache_bits:
                cache[(0x1E35A7BD * colour & 0xFFFFFFFF) >> (32 - cache_bits)] = colour
        at += count
    plane = {}
    for number, (left, up) in enumerate(webp.NEARBY):
        plane.setdefault(max(1, left + up * width), number + 1)

    def symbols(kind, value):
        if kind == "pixel":
            return [(0, value >> 8 & 255, 0, 0), (1, value >> 16 & 255, 0, 0), (2, value & 255, 0, 0), (3, value >> 24, 0, 0)]
        if kind == "cache":
            return [(0, 280 + value, 0, 0)]
        length, extra, n = prefix(value[0])
        code, more, m = prefix(plane.get(value[1], value[1] + 120))
        return [(0, 256 + length, extra, n), (4, code, more, m)]

    group_of = lambda spot: groups[(spot // width >> block) * across + (spot % width >> block)] if groups is not None else 0
    seen = [[[] for _ in range(5)] for _ in range(1 if groups is None else max(groups) + 1)]
    for spot, kind, value in steps:
        for alphabet, symbol, *_ in symbols(kind, value):
            seen[group_of(spot)][alphabet].append(symbol)
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    writers = [[out.code(lengths_for(held, size)) for held, size in zip(group, sizes, strict=True)] for group in seen]
    for spot, kind, value in steps:
        for alphabet, symbol, extra, n in symbols(kind, value):
            writers[group_of(spot)][alphabet](symbol)
            out.put(extra, n)
    assert height * width == len(pixels)


def picture(width, height, colours, seed=0):
    draw = random.Random(seed)
    palette = [draw.getrandbits(32) for _ in range(colours)]
    out = []
    for at in range(width * height):
        out.append(out[at - draw.choice((1, width))] if at > width and draw.random() < 0.7 else draw.choice(palette))
    return out


def decoded(width, height, out):
    got = webp.decode(out.stream(width, height, out.bits))
    assert got[:2] == (width, height)
    return got[2].tolist()


@pytest.mark.parametrize("cache_bits", [0, 1, 5, 11])
@pytest.mark.parametrize("colours", [1, 2, 9, 200])
def test_codes_back_references_and_cache(colours, cache_bits):
    pixels = picture(17, 13, colours)
    out = Writer()
    out.put(0, 1)
    write_image(out, pixels, 17, cache_bits)
    assert decoded(17, 13, out) == pixels


def test_groups_of_codes():
    pixels = picture(18, 11, 30)
    out = Writer()
    out.put(0, 1)
    write_image(out, pixels, 18, 3, groups=[(i * 7) % 3 for i in range(5 * 3)])
    assert decoded(18, 11, out) == pixels


def subtract(a, b):
    return sum(((a >> s & 255) - (b >> s & 255) & 255) << s for s in (0, 8, 16, 24))


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    width, height = 11, 9
    pixels = picture(width, height, 60, mode)
    left = []
    for at, colour in enumerate(pixels):
        y, x = divmod(at, width)
        if not at:
            guess = 0xFF000000
        elif not y or not x:
            guess = pixels[at - 1] if not y else pixels[at - width]
        else:
            guess = webp.predict(mode, pixels[at - 1], pixels[at - width], pixels[at - width + 1], pixels[at - width - 1])
        left.append(subtract(colour, guess))
    out = Writer()
    out.put(1, 1), out.put(webp.PREDICTOR, 2), out.put(0, 3)
    write_image(out, [mode << 8] * (3 * 3), 3, main=False)
    out.put(0, 1)
    write_image(out, left, width, 4)
    assert decoded(width, height, out) == pixels


def test_predictions_by_hand():
    left, top, right, corner = 0x10203040, 0x30405060, 0x50607081, 0x20304050
    foretold = [webp.predict(mode, left, top, right, corner) for mode in range(14)]
    assert foretold[:5] == [0xFF000000, left, top, right, corner]
    assert foretold[5] == 0x30405060 and foretold[6] == 0x18283848 and foretold[7] == 0x20304050
    assert foretold[8] == 0x28384858 and foretold[9] == 0x40506070 and foretold[10] == 0x2C3C4C5C
    # left + top - corner is 20 30 40 50: as far from either, so the upper one.
    assert foretold[11] == top and foretold[12] == 0x20304050 and foretold[13] == 0x20304050
    assert webp.predict(12, 0xFFFF0000, 0xFF000000, 0, 0x00FFFF00) == 0xFF000000
    assert webp.predict(13, 0, 0, 0, 0x01030507) == 0


def test_cross_colour_and_subtract_green():
    width, height = 10, 7
    pixels = picture(width, height, 40)
    factors = [random.Random(i).getrandbits(24) for i in range(3 * 2)]
    signed = lambda value: value - 256 if value > 127 else value
    coded = []
    for at, colour in enumerate(pixels):
        y, x = divmod(at, width)
        green, red, blue = colour >> 8 & 255, colour >> 16 & 255, colour & 255
        # Green goes first, so that undoing it comes last.
        red, blue = red - green & 255, blue - green & 255
        factor = factors[(y >> 2) * 3 + (x >> 2)]
        to_red, green_blue, red_blue = signed(factor & 255), signed(factor >> 8 & 255), signed(factor >> 16)
        new_red = red - (to_red * signed(green) >> 5) & 255
        new_blue = blue - (green_blue * signed(green) >> 5) - (red_blue * signed(red) >> 5) & 255
        coded.append(colour & 0xFF00FF00 | new_red << 16 | new_blue)
    out = Writer()
    out.put(1, 1), out.put(webp.SUBTRACT_GREEN, 2)
    out.put(1, 1), out.put(webp.CROSS_COLOUR, 2), out.put(0, 3)
    write_image(out, factors, 3, main=False)
    out.put(0, 1)
    write_image(out, coded, width, 2)
    assert decoded(width, height, out) == pixels


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palette(colours):
    width, height = 13, 6
    pixels = picture(width, height, colours, 4)
    table = sorted(set(pixels)) or [0]
    table += [table[-1]] * (colours - len(table))
    pack = webp.packed_bits(len(table))
    across, each = -(-width >> pack), 8 >> pack
    coded = [0] * (across * height)
    for at, colour in enumerate(pixels):
        y, x = divmod(at, width)
        coded[y * across + (x >> pack)] |= table.index(colour) << 8 + each * (x & (1 << pack) - 1)
    out = Writer()
    out.put(1, 1), out.put(webp.PALETTE, 2), out.put(len(table) - 1, 8)
    write_image(out, [table[0], *(subtract(b, a) for a, b in zip(table, table[1:], strict=False))], len(table), main=False)
    out.put(0, 1)
    write_image(out, coded, across)
    assert decoded(width, height, out) == pixels


def test_the_fixed_path_equals_the_general_one(monkeypatch):
    draw = random.Random(1)
    for colours in (1, 2, 3, 5, 17, 90, 256):
        samples = np.array([draw.randrange(colours) for _ in range(3 * 64 * 5)], dtype=np.uint8)
        data = webp.encode(samples, 64, 5)
        fast = webp.decode(data)[2]
        with monkeypatch.context() as patch:
            real = webp.make_code
            patch.setattr(webp, "make_code", lambda lengths: webp.Code(*(lambda code: (code.only, code.symbols, None if code.only is None else 0, code.order))(real(lengths))))
            slow = webp.decode(data)[2]
        assert (fast == slow).all()
        assert (fast.view(np.uint8).reshape(-1, 4)[:, 2::-1].ravel() == samples).all()


@pytest.mark.parametrize("data", [b"", b"RIFF", b"x" * 60, webp.encode(np.zeros(3, np.uint8), 1, 1)[:-4], b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 40])
def test_other_bytes_are_refused(data):
    with pytest.raises(webp.BadImage):
        webp.decode(data)


def test_texts_come_back(spark):
    draw = random.Random(2)
    rows = [(1, None, "a"), (2, "", "b"), (3, "x" * 192, "c"), (4, "y" * 193, "d"), (5, "".join(draw.choice("aé漢😀 \n") for _ in range(900)), None), (5, "y" * 193, "e")]
    rows.append((6, "".join(chr(32 + i % 90) for i in range(192 * (webp.LARGEST_SIDE + 3) + 5)), "f"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = media.read_media(media.store_texts(frame)).withColumn("tail", media.tail_crc()).collect()
    by_size = {row.n_bytes: row for row in got}
    for _, text, _ in rows:
        data = (text or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192)
        row = by_size[len(data)]
        assert row.error is None and bytes(row.samples) == payload and row.payload_bytes == len(payload) and row.tail == zlib.crc32(payload[-16:])
        assert row.width * row.height * 3 >= len(payload) and max(row.width, row.height) <= webp.LARGEST_SIDE
    same = [row for row in got if row.n_bytes == 193]
    assert len(same) == 2 and len({(hashlib.sha256(row.media).hexdigest(), row.feature) for row in same}) == 1


def test_reading_odd_media_and_empty_tables(spark):
    good = webp.encode(np.arange(12, dtype=np.uint8), 2, 2)
    frame = spark.createDataFrame([(1, None, "x"), (2, bytearray(b"junk"), "y"), (3, bytearray(good), None)], "id long, media binary, width string")
    rows = {row.id: row for row in media.read_media(frame).collect()}
    assert rows[1].error is None and rows[1].samples is None
    assert rows[2].samples is None and rows[2].error
    assert (rows[3].width, rows[3].height, bytes(rows[3].samples)) == (2, 2, bytes(range(12)))
    assert media.read_media(media.store_texts(spark.createDataFrame([], SCHEMA))).count() == 0


def one_by_one(seen):
    """A plain reader of one group of codes: a symbol after the other."""

    def read(bits, codes, width, total, cache_bits):
        out, cache = [], {}
        while len(out) < total:
            symbol = codes[0].read(bits)
            if symbol < 256:
                red, blue, alpha = (code.read(bits) for code in codes[1:4])
                made = [alpha << 24 | red << 16 | symbol << 8 | blue]
                seen["pixel"] += 1
            elif symbol < 280:
                length = webp._span(bits, symbol - 256)
                code = webp._span(bits, codes[4].read(bits))
                left, up = webp.NEARBY[code - 1] if code <= 120 else (0, 0)
                back = max(1, left + up * width) if code <= 120 else code - 120
                made = []
                for i in range(length):
                    made.append((out + made)[len(out) + i - back] if i < back else made[i - back])
                seen["copy"] += 1
            else:
                made = [cache.get(symbol - 280, 0)]
                seen["cache"] += 1
            out += made
            for colour in made:
                cache[(webp.CACHE_FACTOR * colour & 0xFFFFFFFF) >> (32 - cache_bits)] = colour
        seen["uneven"] += any(code.fixed is None for code in codes)
        return np.array(out, dtype=np.uint32)

    return read


def payload(text):
    return np.frombuffer(text.ljust(-(-len(text) // 192) * 192), dtype=np.uint8)


def test_stored_texts_take_the_whole_method(monkeypatch):
    """Uneven codes, copies, cached colours and the green transform are written where
    they pay, and a plain reader finds the same pixels as the one of arrays."""
    draw = random.Random(3)
    words = ["".join(draw.choice("eeeeettaoinshrdlu") for _ in range(draw.randrange(1, 9))) for _ in range(60)]
    prose = " ".join(draw.choice(words) for _ in range(1500)).encode()
    grey = bytes(value for _ in range(900) for value in [draw.randrange(64, 128)] * 3)
    texts = [prose, prose[:700] * 4, grey, b"x" * 30000, bytes(range(256)) * 9, b"", b"ab" * 96, "漢字仮名".encode() * 200]
    seen = dict.fromkeys(("pixel", "copy", "cache", "uneven"), 0)
    green = []
    for text in texts:
        samples = payload(text or b" ")
        data = webp.encode(samples, 64, len(samples) // 192)
        width, height, fast = webp.decode(data)
        assert (fast.view(np.uint8).reshape(-1, 4)[:, 2::-1].ravel() == samples).all()
        with monkeypatch.context() as patch:
            patch.setattr(webp, "_one_group", one_by_one(seen))
            undo = webp._undo_subtract_green
            patch.setattr(webp, "_undo_subtract_green", lambda pixels: green.append(1) or undo(pixels))
            assert (webp.decode(data)[2] == fast).all()
    assert all(seen.values()) and green
    # Repeats and uneven shares take less room than a fixed length a symbol.
    assert len(webp.encode(payload(prose[:768] * 4), 64, 16)) < 0.3 * 3072


def test_images_of_many_windows_and_blocks(monkeypatch):
    draw = random.Random(5)
    monkeypatch.setattr(webp, "WINDOW", 300)
    monkeypatch.setattr(webp, "BLOCK", 64)
    for n in (1, 3, 64, 65, 140, 900):
        samples = payload(bytes(draw.choice(b"aaab cde\n") for _ in range(192 * n)))
        data = webp.encode(samples, 64, n)
        assert (webp.decode(data)[2].view(np.uint8).reshape(-1, 4)[:, 2::-1].ravel() == samples).all()


def test_damaged_images_are_refused_or_read():
    draw = random.Random(8)
    good = webp.encode(payload(b"the quick brown fox jumps over the lazy dog " * 30), 64, 7)
    for _ in range(400):
        data = bytearray(good)
        # The sides stay as they are.
        for _ in range(draw.randrange(1, 4)):
            data[draw.randrange(25, len(data))] ^= 1 << draw.randrange(8)
        try:
            width, height, pixels = webp.decode(bytes(data))
            assert len(pixels) == width * height
        except webp.BadImage:
            pass


def test_red_and_blue_written_alike_are_read_once(monkeypatch):
    draw = random.Random(6)
    samples = payload(bytes(draw.choice(b"etaoin shrdlu,.") for _ in range(192 * 20)))
    data = webp.encode(samples, 64, 20)
    read, real = [], webp._read_code
    monkeypatch.setattr(webp, "_read_code", lambda bits, alphabet: read.append(alphabet) or real(bits, alphabet))
    assert (webp.decode(data)[2].view(np.uint8).reshape(-1, 4)[:, 2::-1].ravel() == samples).all()
    assert read == [280, 256, 256, 40]

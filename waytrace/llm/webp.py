"""Media columns: lossless WebP, decoded and written in numpy.

``decode`` reads lossless WebP files (one picture, or the frames of an extended file) into
pixel arrays: prefix codes (simple and normal), several groups of codes chosen by an entropy image,
back-references with the short distances around a pixel, the colour cache, and the inverse of the
four transforms (predictor, cross-colour, subtract-green, palette with bundled pixels).

Many pictures are decoded in lockstep: a step reads one pixel of each picture, all of them
in a few array operations, so the cost of a step is shared; so are predictors undone. Pictures are sorted by size; those that
are done drop out.

Text columns become pictures in ``to_webp``: the payload's bytes are the samples of RGB pixels in rows of
64, so a row is 192 bytes. A picture has at most ``STRIP_ROWS`` rows; a longer payload becomes an
extended file with a frame for each strip, which bounds the steps. The encoder predicts pixels from the left or from above where that pays in some tile of a strip,
copies repeated runs by back-references, takes pixels seen before from a colour
cache, and writes one prefix code per channel (its lengths come from the counts, made complete), for all strips of a
batch at once. So reading a file back needs all of these. Entropy images, cross-colour and palettes occur in files from elsewhere only.

Null text counts as empty: its payload is one row of spaces. Payloads depend on the text alone, so equal
texts have equal files and features, which settles ties. Repeated rows are stored each. An empty table gives an empty result.
Very long texts are many strips. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waytrace.llm.common import runs, table, texts

WIDTH = 64
ROW_BYTES = 3 * WIDTH
STRIP_ROWS = 32
#: Payload bytes whose strips are encoded and decoded together.
BATCH_BYTES = 9 << 19
SIGNATURE = 0x2F
#: The longest code this encoder makes; the format allows 15.
LONGEST = 11
#: The encoder's tiles of one predictor are 2 ** TILE_BITS wide; bits of its colour cache; shortest run it copies, in pixels.
TILE_BITS = 5
CACHE_BITS = 6
SHORTEST = 4

#: The order in which lengths of the code for code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


def near_offsets() -> np.ndarray:
    """(x, y) of the 120 short distances: by distance, then the higher row, then the right one first."""
    found = [(x, y) for y in range(8) for x in range(-7, 9) if (y > 0 or x > 0) and (x < 8 or y < 8)]
    return np.array(sorted(found, key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0])), np.int64)


NEAR = near_offsets()


def reversed_bits(n: int) -> np.ndarray:
    """For each number of n bits the number with these in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate((out * 2, out * 2 + 1))
    return out


_REVERSED = [reversed_bits(n) for n in range(16)]


class Damaged(ValueError):
    """The data isn't a lossless WebP picture."""


def code_tables(codes: list[bytes]) -> list[tuple[np.ndarray, int]]:
    """A table for each canonical prefix code, told by the lengths of its symbols: indexed by the next ``bits`` bits (first bit
    lowest), symbol * 16 + length. All are made at once; a code of one symbol takes no bits."""
    sizes = np.array([len(c) for c in codes], np.int64)
    lengths = np.frombuffer(b"".join(codes), np.uint8)
    owner = np.repeat(np.arange(len(codes)), sizes)
    used = np.flatnonzero(lengths)
    code, length = owner[used], lengths[used].astype(np.int64)
    symbol = used - (np.cumsum(sizes) - sizes)[code]
    count = np.bincount(code, minlength=len(codes))
    bits = np.zeros(len(codes), np.int64)
    np.maximum.at(bits, code, length)
    bits[count < 2] = 0
    length[count[code] == 1] = 0
    spread = np.int64(1) << (bits[code] - length)
    room = np.int64(1) << bits
    if (np.bincount(code, spread, minlength=len(codes)) != room)[count > 0].any():
        raise Damaged("incomplete prefix code")
    order = np.argsort(code << 4 | length, kind="stable")
    high = np.repeat((symbol << 4 | length)[order].astype(np.int32), spread[order])
    room[count == 0] = 0
    base = np.cumsum(room) - room
    within = np.arange(len(high)) - np.repeat(base, room)
    entries = high[np.repeat(base, room) + (_REVERSED[15][within] >> np.repeat(15 - bits, room))]
    ends = (base + room).tolist()
    return [(entries[b:e] if e > b else np.zeros(1, np.int32), n) for b, e, n in zip(base.tolist(), ends, bits.tolist(), strict=True)]


def code_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """One of ``code_tables``."""
    return code_tables([lengths.astype(np.uint8).tobytes()])[0]


class Bits:
    """Reads a byte string from its lowest bits on."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        first = self.at >> 3
        value = int.from_bytes(self.data[first : first + (n + 14) // 8 + 1], "little") >> (self.at & 7)
        self.at += n
        if self.at > 8 * len(self.data):
            raise Damaged("the data ends early")
        return value & ((1 << n) - 1)

    def symbol(self, table: np.ndarray, bits: int) -> int:
        first = self.at >> 3
        value = int.from_bytes(self.data[first : first + 4], "little") >> (self.at & 7)
        entry = int(table[value & ((1 << bits) - 1)])
        self.at += entry & 15
        return entry >> 4


def read_code(bits: Bits, alphabet: int) -> tuple[np.ndarray, int] | bytes:
    """One prefix code: the table of a simple one as ``code_tables`` has it, the lengths of a normal one."""
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        chosen = [first, bits.read(8)] if two else [first]
        if max(chosen) >= alphabet:
            raise Damaged("symbol outside the alphabet")
        low, high = min(chosen), max(chosen)
        return (np.array([low << 4], np.int32), 0) if low == high else (np.array([low << 4 | 1, high << 4 | 1], np.int32), 1)
    return read_lengths(bits, alphabet)


def tables_of(codes: list[tuple[np.ndarray, int] | bytes]) -> list[tuple[np.ndarray, int]]:
    """The tables of codes as ``read_code`` gives them."""
    made = iter(code_tables([c for c in codes if isinstance(c, bytes)]))
    return [next(made) if isinstance(c, bytes) else c for c in codes]


_TABLES: dict[int, tuple[list[int], int]] = {}


def _lengths_code(bits: Bits) -> tuple[list[int], int]:
    """The code for code lengths; files of one writer mostly share it, so tables are kept."""
    n = 4 + bits.read(4)
    raw = bits.read(3 * n) | n << 60
    if raw not in _TABLES:
        own = np.zeros(19, np.int64)
        for i in range(n):
            own[LENGTH_ORDER[i]] = raw >> (3 * i) & 7
        table, width = code_table(own)
        if len(_TABLES) > 1000:
            _TABLES.clear()
        _TABLES[raw] = table.tolist(), width
    return _TABLES[raw]


def read_lengths(bits: Bits, alphabet: int) -> bytes:
    """The code lengths of a normal code, a byte each."""
    steps, width = _lengths_code(bits)
    most = alphabet
    if bits.read(1):
        most = 2 + bits.read(2 + 2 * bits.read(3))
    stream, at, mask, last, i = bits.data, bits.at, (1 << width) - 1, 8, 0
    window = held = 0
    out = bytearray(alphabet)
    while i < alphabet and most > 0:
        if held < 32:
            window, held = int.from_bytes(stream[at >> 3 : (at >> 3) + 16], "little") >> (at & 7), 120
        most -= 1
        entry = steps[window & mask]
        n, symbol = entry & 15, entry >> 4
        if symbol < 16:
            out[i] = symbol
            i += 1
            if symbol:
                last = symbol
        else:
            extra, base = ((2, 3), (3, 3), (7, 11))[symbol - 16]
            times = base + (window >> n & ((1 << extra) - 1))
            n += extra
            if i + times > alphabet:
                raise Damaged("too many code lengths")
            if symbol == 16:
                out[i : i + times] = bytes([last]) * times
            i += times
        window >>= n
        held -= n
        at += n
    if at > 8 * len(stream):
        raise Damaged("the data ends early")
    bits.at = at
    return bytes(out)


class Picture:
    """What stands before the pixels of one entropy-coded picture."""

    def __init__(self, bits: Bits, width: int, height: int, top: bool) -> None:
        self.width, self.height, self.data = width, height, bits.data
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        if self.cache_bits > 11:
            raise Damaged("colour cache too large")
        self.meta, self.meta_bits, groups = None, 0, 1
        if top and bits.read(1):
            self.meta_bits = bits.read(3) + 2
            inner = small_picture(bits, shrink(width, self.meta_bits), shrink(height, self.meta_bits))
            self.meta = ((inner >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.int64)
            groups = int(self.meta.max()) + 1
        sizes = (280 + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, 40)
        self.held = [read_code(bits, n) for _ in range(groups) for n in sizes]  # five to a group
        self.at = bits.at

    @property
    def codes(self) -> list[list[tuple[np.ndarray, int]]]:
        """The tables of each group."""
        made = tables_of(self.held)
        return [made[i : i + 5] for i in range(0, len(made), 5)]


def small_picture(bits: Bits, width: int, height: int) -> np.ndarray:
    """The ARGB pixels of a picture inside another's head. A few plain pixels are read one by one."""
    picture = Picture(bits, width, height, False)
    begun, out = bits.at, []
    green, *rest, _ = picture.codes[0]
    for _ in range(width * height if width * height <= 64 and not picture.cache_bits else 0):
        value = bits.symbol(*green)
        if value >= 256:
            break
        red, blue, alpha = (bits.symbol(*code) for code in rest)
        out.append(alpha << 24 | red << 16 | value << 8 | blue)
    if len(out) == width * height:
        if bits.at > 8 * len(bits.data):
            raise Damaged("the data ends early")
        return np.array(out, np.uint32)
    bits.at = begun
    return decode_pictures([picture], [bits])[0]


def shrink(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def decode_pictures(pictures: list[Picture], readers: list[Bits] | None = None) -> list[np.ndarray]:
    """The ARGB pixels of each picture, in lockstep; ``readers`` are moved behind their pictures."""
    sizes = np.array([p.width * p.height for p in pictures], np.int64)
    order = np.argsort(-sizes, kind="stable")
    lanes = [pictures[i] for i in order]
    sizes = sizes[order]
    n = len(lanes)
    # bytes of all pictures in a row, as the 32 bits from each byte on
    streams, begins, at = [], {}, 0
    base = np.zeros(n, np.int64)
    for i, p in enumerate(lanes):
        if id(p.data) not in begins:
            begins[id(p.data)] = at
            streams.append(np.frombuffer(p.data, np.uint8))
            at += len(p.data)
        base[i] = 8 * begins[id(p.data)]
    raw = np.concatenate([*streams, np.zeros(8, np.uint8)])
    words = raw[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        words |= raw[k : len(raw) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    end = np.array([base[i] + 8 * len(p.data) for i, p in enumerate(lanes)])
    # the tables of all groups of all lanes, five to a group
    groups = np.array([len(p.held) // 5 for p in lanes], np.int64)
    group_base = np.cumsum(groups) - groups
    made = tables_of([c for p in lanes for c in p.held])
    room = np.array([len(entries) for entries, _ in made], np.int64)
    tables = np.concatenate([entries for entries, _ in made])
    starts = [(np.cumsum(room) - room)[which::5].copy() for which in range(5)]
    masks = [np.array([(1 << bits) - 1 for _, bits in made[which::5]], np.uint32) for which in range(5)]
    still = [not held.any() for held in masks]  # codes without bits in all pictures
    pos = base + np.array([p.at for p in lanes])
    width = np.array([p.width for p in lanes])
    out_at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint32)
    many = bool((groups > 1).any())
    if many:
        metas = [p.meta if p.meta is not None else np.zeros(1, np.int64) for p in lanes]
        meta_at = np.cumsum([len(m) for m in metas]) - [len(m) for m in metas]
        meta, meta_bits = np.concatenate(metas), np.array([p.meta_bits if p.meta is not None else 31 for p in lanes])
        meta_width = np.array([shrink(p.width, p.meta_bits) if p.meta is not None else 1 for p in lanes])
    cache_bits = np.array([p.cache_bits for p in lanes])
    cached, all_cached = bool(cache_bits.any()), bool(cache_bits.all())
    if cached:
        down = (32 - cache_bits).astype(np.uint32)
        cache_at = np.cumsum(1 << cache_bits) - (1 << cache_bits)
        cache = np.zeros(int((1 << cache_bits).sum()), np.uint32)
    copy, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    copying = False
    every = np.arange(n)

    def take(lane: np.ndarray, row: np.ndarray, which: int) -> np.ndarray:
        if still[which]:
            return tables.take(starts[which].take(row)) >> 4
        p = pos.take(lane)
        window = (words.take(p >> 3, mode="clip") >> (p & 7).astype(np.uint32)) & masks[which].take(row)
        entry = tables.take(starts[which].take(row) + window)
        pos[lane] = p + (entry & 15)
        return entry >> 4

    def extra(lane: np.ndarray, n_bits: np.ndarray) -> np.ndarray:
        p = pos.take(lane)
        value = (words.take(p >> 3, mode="clip") >> (p & 7).astype(np.uint32)).astype(np.int64) & ((1 << n_bits) - 1)
        pos[lane] = p + n_bits
        return value

    def prefixed(lane: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        symbol = symbol.astype(np.int64)
        more = np.maximum(0, (symbol - 2) >> 1)
        return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << more) + extra(lane, more) + 1)

    alive = n
    for step in range(int(sizes[0]) if n else 0):
        while sizes[alive - 1] <= step:
            alive -= 1
        lane = every[:alive]
        if copying:
            lane = lane[copy[:alive] == 0]
        if len(lane):
            row = group_base[lane]
            if many:
                y, x = np.divmod(step, width[lane])
                row = row + meta[meta_at[lane] + (y >> meta_bits[lane]) * meta_width[lane] + (x >> meta_bits[lane])]
            green = take(lane, row, 0)
            plain = green < 256
            if plain.all():
                out[out_at[lane] + step] = _pixel(green, take(lane, row, 1), take(lane, row, 2), take(lane, row, 3))
            else:
                some, at_row = lane[plain], row[plain]
                if len(some):
                    out[out_at[some] + step] = _pixel(green[plain], take(some, at_row, 1), take(some, at_row, 2), take(some, at_row, 3))
                hit = green >= 280
                if hit.any():
                    some = lane[hit]
                    out[out_at[some] + step] = cache[cache_at[some] + green[hit] - 280]
                back = ~plain & ~hit
                if back.any():
                    some = lane[back]
                    copy[some] = prefixed(some, green[back] - 256)
                    far = prefixed(some, take(some, row[back], 4))
                    close = np.minimum(far, 120) - 1
                    short = np.maximum(1, NEAR[close, 0] + NEAR[close, 1] * width[some])
                    distance[some] = np.where(far > 120, far - 120, short)
                    if (distance[some] > step).any() or (step + copy[some] > sizes[some]).any():
                        raise Damaged("a back-reference leaves the picture")
                    copying = True
        if copying:
            some = every[:alive][copy[:alive] > 0]
            out[out_at[some] + step] = out[out_at[some] + step - distance[some]]
            copy[some] -= 1
            copying = bool((copy[:alive] > 0).any())
        if cached:
            some = every[:alive] if all_cached else every[:alive][cache_bits[:alive] > 0]
            colour = out[out_at[some] + step]
            cache[cache_at[some] + ((np.uint32(0x1E35A7BD) * colour) >> down[some])] = colour
    if (pos > end).any():
        raise Damaged("the data ends early")
    found: list[np.ndarray] = [None] * n
    for i, k in enumerate(order.tolist()):
        found[k] = out[out_at[i] : out_at[i] + sizes[i]]
        if readers:
            readers[k].at = int(pos[i] - base[i])
    return found


def _pixel(green: np.ndarray, red: np.ndarray, blue: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    return (alpha.astype(np.uint32) << np.uint32(24)) | (red.astype(np.uint32) << np.uint32(16)) | (green.astype(np.uint32) << np.uint32(8)) | blue.astype(np.uint32)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per channel, modulo 256."""
    low = np.uint32(0x00FF00FF)
    return (((a >> np.uint32(8)) & low) + ((b >> np.uint32(8)) & low) & low) << np.uint32(8) | ((a & low) + (b & low) & low)


def _channels(p: np.ndarray) -> np.ndarray:
    return np.stack([(p >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)]).astype(np.int64)


def _joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return (c[0] << np.uint32(24)) | (c[1] << np.uint32(16)) | (c[2] << np.uint32(8)) | c[3]


def predicted(mode: int, left: np.ndarray, above: np.ndarray, above_left: np.ndarray, above_right: np.ndarray) -> np.ndarray:
    """The prediction of one mode, of channels [4, n] each."""
    half = lambda a, b: (a + b) >> 1
    if mode == 11:
        from_left = np.abs(above - above_left).sum(0)
        from_above = np.abs(left - above_left).sum(0)
        return np.where(from_left < from_above, left, above)
    black = np.zeros_like(left)
    black[0] = 255
    simple = {
        0: lambda: black,
        1: lambda: left,
        2: lambda: above,
        3: lambda: above_right,
        4: lambda: above_left,
        5: lambda: half(half(left, above_right), above),
        6: lambda: half(left, above_left),
        7: lambda: half(left, above),
        8: lambda: half(above_left, above),
        9: lambda: half(above, above_right),
        10: lambda: half(half(left, above_left), half(above, above_right)),
        12: lambda: np.clip(left + above - above_left, 0, 255),
    }
    if mode in simple:
        return simple[mode]()
    if mode == 13:
        mean = half(left, above)
        rest = mean - above_left
        return np.clip(mean + np.sign(rest) * (np.abs(rest) >> 1), 0, 255)
    return black


def undo_predictor(pixels: np.ndarray, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    height, across = len(pixels) // width, shrink(width, bits)
    off = _channels(pixels).reshape(4, height, width)
    out = np.zeros_like(off)
    black = np.array([255, 0, 0, 0])
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = black if x == 0 else out[:, 0, x - 1]
            elif x == 0:
                guess = out[:, y - 1, 0]
            else:
                mode = int((modes[(y >> bits) * across + (x >> bits)] >> np.uint32(8)) & np.uint32(15))
                right = out[:, y - 1, x + 1] if x + 1 < width else out[:, y, 0]
                guess = predicted(mode, out[:, y, x - 1, None], out[:, y - 1, x, None], out[:, y - 1, x - 1, None], right[:, None])[:, 0]
            out[:, y, x] = (off[:, y, x] + guess) & 255
    return _joined(out.reshape(4, -1))


_BLACK = np.uint32(0xFF000000)


def undo_predictors(pictures: list[tuple[np.ndarray, np.ndarray, int]], width: int) -> list[np.ndarray]:
    """``undo_predictor`` of several (pixels, modes, bits) of one width in lockstep, tallest first."""
    heights = np.array([len(p) // width for p, _, _ in pictures])
    out = np.zeros((int(heights[0]), width, len(pictures)), np.uint32)
    tiles = np.zeros(out.shape, np.uint8)
    y, x = np.divmod(np.arange(width * int(heights[0])), width)
    for i, (pixels, modes, bits) in enumerate(pictures):
        h = int(heights[i])
        out[:h, :, i] = pixels.reshape(h, width)
        own = (((modes >> np.uint32(8)) & np.uint32(15)).astype(np.uint8))[(y[: h * width] >> bits) * shrink(width, bits) + (x[: h * width] >> bits)]
        tiles[:h, :, i] = own.reshape(h, width)
    alive = len(pictures)
    for row in range(int(heights[0])):
        while heights[alive - 1] <= row:
            alive -= 1
        now = out[row, :, :alive]
        if row == 0:
            now[0] = _add(now[0], _BLACK)
            for column in range(1, width):
                now[column] = _add(now[column], now[column - 1])
            continue
        above, modes = out[row - 1, :, :alive], tiles[row, :, :alive]
        now[0] = _add(now[0], above[0])
        # what doesn't look to the left is the same for the whole row
        guess = np.full(now.shape, _BLACK)
        for mode, held in ((2, above), (4, np.roll(above, 1, axis=0))):
            guess = np.where(modes == mode, held, guess)
        if (modes == 3).any():
            guess = np.where(modes == 3, np.concatenate((above[1:], now[:1])), guess)
        plain = (modes == 0) | (modes > 13) | ((modes >= 2) & (modes <= 4))
        plain[0] = False
        now[plain] = _add(now[plain], guess[plain])
        for column in np.flatnonzero(~plain[1:].all(1)) + 1:
            some = np.flatnonzero(~plain[column])
            left, kinds = now[column - 1, some], modes[column, some]
            if (kinds == 1).all():
                now[column, some] = _add(now[column, some], left)
                continue
            right = above[column + 1, some] if column + 1 < width else now[0, some]
            around = [_channels(v) for v in (left, above[column, some], above[column - 1, some], right)]
            found = np.zeros(len(some), np.uint32)
            for mode in np.unique(kinds).tolist():
                here = kinds == mode
                found[here] = _joined(predicted(mode, *[c[:, here] for c in around]))
            now[column, some] = _add(now[column, some], found)
    return [out[: heights[i], :, i].reshape(-1) for i in range(len(pictures))]


def _signed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) ^ 128) - 128


def undo_cross_colour(pixels: np.ndarray, width: int, factors: np.ndarray, bits: int) -> np.ndarray:
    y, x = np.divmod(np.arange(len(pixels)), width)
    f = _channels(factors[(y >> bits) * shrink(width, bits) + (x >> bits)])
    alpha, red, green, blue = _channels(pixels)
    delta = lambda t, c: (_signed(t) * _signed(c)) >> 5
    red = (red + delta(f[3], green)) & 255
    blue = (blue + delta(f[2], green) + delta(f[1], red)) & 255
    return _joined(np.stack([alpha, red, green, blue]))


def undo_green(pixels: np.ndarray) -> np.ndarray:
    green = (pixels >> np.uint32(8)) & np.uint32(255)
    return _add(pixels, green << np.uint32(16) | green)


def undo_palette(pixels: np.ndarray, packed_width: int, width: int, colours: np.ndarray, bits: int) -> np.ndarray:
    index = ((pixels >> np.uint32(8)) & np.uint32(255)).reshape(-1, packed_width)
    if bits:
        each = 8 >> bits
        steps = np.arange(1 << bits, dtype=np.uint32) * np.uint32(each)
        index = ((index[:, :, None] >> steps) & np.uint32((1 << each) - 1)).reshape(len(index), -1)[:, :width]
    held = np.concatenate([colours, np.zeros(256, np.uint32)])
    return held[index.reshape(-1)]


class Stream:
    """A lossless bitstream whose header and transforms have been read."""

    def __init__(self, data: bytes) -> None:
        bits = Bits(data)
        if bits.read(8) != SIGNATURE:
            raise Damaged("no lossless signature")
        self.width, self.height = 1 + bits.read(14), 1 + bits.read(14)
        bits.read(1)
        if bits.read(3):
            raise Damaged("unknown version")
        self.transforms: list[tuple] = []
        width, seen = self.width, set()
        while bits.read(1):
            kind = bits.read(2)
            if kind in seen:
                raise Damaged("a transform stands twice")
            seen.add(kind)
            if kind in (PREDICTOR, CROSS_COLOUR):
                size = bits.read(3) + 2
                tiles = small_picture(bits, shrink(width, size), shrink(self.height, size))
                self.transforms.append((kind, width, tiles, size))
            elif kind == SUBTRACT_GREEN:
                self.transforms.append((kind,))
            else:
                n = 1 + bits.read(8)
                steps = small_picture(bits, n, 1)
                colours = _joined(np.cumsum(_channels(steps), axis=1) & 255)
                bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.transforms.append((kind, shrink(width, bundle), width, colours, bundle))
                width = shrink(width, bundle)
        self.picture = Picture(bits, width, self.height, True)

    def finish(self, pixels: np.ndarray) -> np.ndarray:
        """Undo the transforms, the last first; [row, column] of ARGB."""
        for kind, *args in reversed(self.transforms):
            if kind == PREDICTOR:
                pixels = undo_predictor(pixels, *args)
            elif kind == CROSS_COLOUR:
                pixels = undo_cross_colour(pixels, *args)
            elif kind == SUBTRACT_GREEN:
                pixels = undo_green(pixels)
            else:
                pixels = undo_palette(pixels, *args)
        return pixels.reshape(self.height, self.width)


def bitstreams(file: bytes) -> list[bytes]:
    """The lossless bitstreams of a WebP file, in order."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP" or len(file) < 8 + int.from_bytes(file[4:8], "little"):
        raise Damaged("not a WebP file")
    found, at = [], 12
    while at + 8 <= len(file):
        kind, size = file[at : at + 4], int.from_bytes(file[at + 4 : at + 8], "little")
        body = file[at + 8 : at + 8 + size]
        if kind == b"ANMF":
            kind, body = body[16:20], body[24 : 24 + int.from_bytes(body[20:24], "little")]
        if kind == b"VP8L":
            found.append(body)
        at += 8 + size + (size & 1)
    return found


def decode(files: list[bytes]) -> list[list[np.ndarray]]:
    """The pictures of each file as arrays [row, column] of ARGB."""
    streams = [[Stream(s) for s in bitstreams(f)] for f in files]
    flat = [s for f in streams for s in f]
    found = (p for lo, hi in runs(np.array([3 * s.width * s.height for s in flat]), BATCH_BYTES) for p in _decoded(flat[lo:hi]))
    return [[next(found) for _ in f] for f in streams]


def _decoded(flat: list[Stream]) -> list[np.ndarray]:
    pixels = decode_pictures([s.picture for s in flat])
    only = {}
    for i, s in enumerate(flat):
        if [t[0] for t in s.transforms] == [PREDICTOR]:
            only.setdefault(s.width, []).append(i)
    done: dict[int, np.ndarray] = {}
    for width, rows in only.items():
        rows.sort(key=lambda i: -flat[i].height)
        for i, out in zip(rows, undo_predictors([(pixels[i], *flat[i].transforms[0][2:]) for i in rows], width), strict=True):
            done[i] = out.reshape(flat[i].height, width)
    return [done[i] if i in done else s.finish(pixels[i]) for i, s in enumerate(flat)]


def complete_lengths(counts: np.ndarray) -> np.ndarray:
    """[code, symbol] lengths of complete prefix codes for [code, symbol] counts: at least as long as
    a symbol is rare, then shortened, frequent ones first, until no bit is left over."""
    # a code of one symbol gets a second one, which is never written
    single = np.flatnonzero((counts > 0).sum(1) == 1)
    counts = counts.copy()
    counts[single, (counts[single, 0] > 0).astype(int)] += 1
    used = counts > 0
    floor = -(-counts.sum(1, keepdims=True) // (1 << (LONGEST - 1)))
    weight = np.where(used, np.maximum(counts, floor), 0).astype(np.float64)
    lengths = np.where(used, np.ceil(np.log2(np.maximum(weight.sum(1, keepdims=True), 1) / np.maximum(weight, 1)) - 1e-12), 0).astype(np.int64)
    lengths = np.where(used, np.clip(lengths, 1, LONGEST), 0)
    room = (1 << LONGEST) - np.where(used, np.int64(1) << (LONGEST - lengths), 0).sum(1)
    # whole numbers of few bits are sorted in time linear in their number
    top = int(weight.max()) if weight.size else 0
    ranks = np.argsort((top - weight).astype(np.min_scalar_type(top)), axis=1, kind="stable")
    rows = np.arange(len(counts))
    for rank in range(int(used.sum(1).max()) if len(counts) else 0):
        symbol = ranks[:, rank]
        while True:
            length = lengths[rows, symbol]
            cost = np.int64(1) << (LONGEST - length)
            gain = (length > 1) & (room >= cost)
            if not gain.any():
                break
            lengths[rows[gain], symbol[gain]] -= 1
            room[gain] -= cost[gain]
    return lengths


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """[code, symbol] canonical codes, their first bit lowest."""
    order = np.argsort(np.where(lengths > 0, lengths, 99).astype(np.uint8), axis=1, kind="stable")
    rows = np.arange(len(lengths))[:, None]
    sizes = lengths[rows, order]
    span = np.where(sizes > 0, np.int64(1) << (LONGEST - sizes), 0)
    high = np.cumsum(span, axis=1) - span
    out = np.zeros_like(lengths)
    # reversed as numbers of LONGEST bits, the code's bits are the lowest
    out[rows, order] = np.where(sizes > 0, _REVERSED[LONGEST][high & ((1 << LONGEST) - 1)], 0)
    return out


#: The code for code lengths that this encoder uses: three bits for 0 and for a long run of zeros, four for a short run and the others. Complete.
_OWN = np.array([3] + [4] * LONGEST + [0] * (17 - LONGEST - 1) + [4, 3], np.int64)


def _own_codes() -> np.ndarray:
    table, bits = code_table(_OWN)
    out = np.zeros(19, np.int64)
    for i in range((1 << bits) - 1, -1, -1):
        out[table[i] >> 4] = i & ((1 << (int(table[i]) & 15)) - 1)
    return out


_OWN_CODES = _own_codes()


def _fixed_bits(value: int, n: int) -> list[int]:
    return [(value >> i) & 1 for i in range(n)]


#: A code that is never used, or has the symbol 0 alone.
_UNUSED = [1, 0, 0, 0]
_NO_CODE, _NOTHING = np.array(_UNUSED, np.uint8), np.zeros(0, np.uint8)
_ZERO = np.array(_fixed_bits(int(_OWN_CODES[0]), int(_OWN[0])), np.uint8)
_TEN_BITS = [np.array(_fixed_bits(i, 10), np.uint8) for i in range(400)]
_OWN_HEAD = np.array([0, *_fixed_bits(15, 4), *[b for s in LENGTH_ORDER for b in _fixed_bits(int(_OWN[s]), 3)], 1, *_fixed_bits(4, 3)], np.uint8)


def _code_heads(lengths: np.ndarray) -> list[np.ndarray]:
    """The bits that tell the lengths of each code in [code, symbol]; runs of three zeros or more are told by their length."""
    code, symbol = np.nonzero(lengths)
    first = np.concatenate(([True], code[1:] != code[:-1])) if len(code) else np.zeros(0, bool)
    zeros = symbol - np.where(first, 0, np.concatenate(([0], symbol[:-1] + 1))) if len(code) else symbol
    # before each length: long runs, then a short run or single zeros
    times = np.where(zeros > 10, -(-(zeros - 10) // 138), 0)
    rest = zeros - np.minimum(zeros, 138 * times)
    most = int(times.max()) if len(times) else 0
    size, word = np.zeros((len(code), most + 3), np.int64), np.zeros((len(code), most + 3), np.int64)
    for i in range(most):
        run = np.clip(zeros - 138 * i, 0, 138)
        size[:, i] = np.where(i < times, _OWN[18] + 7, 0)
        word[:, i] = _OWN_CODES[18] | np.maximum(run - 11, 0) << _OWN[18]
    short = rest > 2
    size[:, most] = np.where(short, _OWN[17] + 3, np.where(rest > 0, _OWN[0], 0))
    word[:, most] = np.where(short, _OWN_CODES[17] | np.maximum(rest - 3, 0) << _OWN[17], _OWN_CODES[0])
    size[:, most + 1] = np.where(rest == 2, _OWN[0], 0)
    word[:, most + 1] = _OWN_CODES[0]
    held = lengths[code, symbol]
    size[:, most + 2], word[:, most + 2] = _OWN[held], _OWN_CODES[held]
    tokens = np.bincount(code, (size > 0).sum(1), minlength=len(lengths)).astype(np.int64)
    octets = np.bincount(code, size.sum(1), minlength=len(lengths)).astype(np.int64)
    used = size.reshape(-1) > 0
    size, word = size.reshape(-1)[used], word.reshape(-1)[used]
    bits, at = np.zeros(int(size.sum()), np.uint8), np.cumsum(size) - size
    for k in range(int(_OWN.max()) + 7):
        here = np.flatnonzero(size > k)
        bits[at[here] + k] = (word[here] >> k) & 1
    out, begin = [], 0
    for n, total in zip(tokens.tolist(), octets.tolist(), strict=True):
        if not n:
            out.append(_NO_CODE)
            continue
        pad = _ZERO if n < 2 else _NOTHING
        out.append(np.concatenate((_OWN_HEAD, _TEN_BITS[max(n, 2) - 2], bits[begin : begin + total], pad)))
        begin += total
    return out


def prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, number of further bits and these bits of lengths or distances from 1 on."""
    x = values.astype(np.int64) - 1
    n = np.floor(np.log2(np.maximum(x, 1))).astype(np.int64)
    more = np.maximum(n - 1, 0)
    second = (x >> more) & 1
    return np.where(x < 4, x, 2 * n + second), np.where(x < 4, 0, more), np.where(x < 4, 0, x - ((2 + second) << more))


def _short_distances() -> np.ndarray:
    """The code of each distance up to the largest short one, by pixels; 0 where there is none."""
    far = np.maximum(1, NEAR[:, 0] + NEAR[:, 1] * WIDTH)
    out = np.zeros(int(far.max()) + 1, np.int64)
    out[far[::-1]] = np.arange(len(far), 0, -1)
    return out


_SHORT = _short_distances()


def predict(pixels: np.ndarray, height: int) -> tuple[np.ndarray, list[int]]:
    """What is left of the ARGB pixels of a strip after prediction, and the mode of each tile: black, or the first other mode that
    pays. Without one the pixels themselves, and no modes."""
    rows = pixels.reshape(height, WIDTH)
    left = np.concatenate((np.full((height, 1), _BLACK), rows[:, :-1]), axis=1)
    above = np.concatenate((np.full((1, WIDTH), _BLACK), rows[:-1]))
    size, modes, other = 1 << TILE_BITS, [], 0
    guess = np.full((height, WIDTH), _BLACK)
    for y in range(0, height, size):
        for x in range(0, WIDTH, size):
            tile = np.s_[y : y + size, x : x + size]
            same = [int((held[tile] == rows[tile]).sum()) for held in (left, above)]
            # a tile of another mode has to have a quarter of its pixels right
            mode = 0 if 4 * max(same) < rows[tile].size else 1 + int(same[1] > same[0])
            mode = mode if mode in (0, other or mode) else 0  # the tiles' code has two symbols
            if mode:
                other = mode
                guess[tile] = (left, above)[mode - 1][tile]
            modes.append(mode)
    if not other:
        return pixels, []
    guess[:, 0], guess[0] = above[:, 0], left[0]
    low = np.uint32(0x00FF00FF)
    rest = (((rows >> np.uint32(8)) & low) + np.uint32(0x01000100) - ((guess >> np.uint32(8)) & low)) & low
    return (rest << np.uint32(8) | (((rows & low) + np.uint32(0x01000100) - (guess & low)) & low)).reshape(-1), modes


def _tile_bits(modes: list[int]) -> list[int]:
    """The picture of the tiles' modes, in its green channel."""
    held = sorted(set(modes))[:2]
    head = [0, 1, len(held) - 1, 1, *_fixed_bits(held[0], 8), *(_fixed_bits(held[1], 8) if len(held) > 1 else [])]
    return head + _UNUSED * 4 + ([held.index(m) for m in modes] if len(held) > 1 else [])


def copies(pixels: np.ndarray, strip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and distance of runs of ``SHORTEST`` pixels or more that stand before in their strip, taken from the left."""
    n = len(pixels) - SHORTEST + 1
    if n < 2:
        return (np.zeros(0, np.int64),) * 3
    key = strip[:n].astype(np.uint64) << np.uint64(32)
    for k in range(SHORTEST):
        key = (key ^ pixels[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    before = np.full(n, -1)
    alike = (key[order[1:]] == key[order[:-1]]) & (strip[order[1:]] == strip[order[:-1]])
    before[order[1:][alike]] = order[:-1][alike]
    valid = (before >= 0) & (strip[:n] == strip[SHORTEST - 1 :])
    at = np.flatnonzero(valid)
    for k in range(SHORTEST):
        at = at[pixels[at + k] == pixels[before[at] + k]]
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    away = at - before[at]
    ends = np.append((at[1:] != at[:-1] + 1) | (away[1:] != away[:-1]) | (strip[at[1:]] != strip[at[:-1]]), True)
    last = at[np.flatnonzero(ends)[np.searchsorted(np.flatnonzero(ends), np.arange(len(at)))]]
    length = last - at + SHORTEST
    chosen, i = [], 0
    stops = np.searchsorted(at, at + length)
    stops = stops.tolist()
    while i < len(at):
        chosen.append(i)
        i = stops[i]
    return at[chosen], length[chosen], away[chosen]


def encode_strips(strips: list[np.ndarray]) -> list[bytes]:
    """A lossless bitstream for each array [row, WIDTH, 3] of RGB samples."""
    n = len(strips)
    heights = np.array([len(s) for s in strips])
    pixels = heights * WIDTH
    strip = np.repeat(np.arange(n), pixels)
    rest, modes = [], []
    for s in strips:
        flat = s.reshape(-1, 3).astype(np.uint32)
        left_over, own = predict(_BLACK | flat[:, 0] << np.uint32(16) | flat[:, 1] << np.uint32(8) | flat[:, 2], len(s))
        rest.append(left_over)
        modes.append(own)
    argb = np.concatenate(rest)
    begin, length, away = copies(argb, strip)
    # a colour is in the cache if the last pixel with its key was the same; the cache begins with zeros
    key = ((np.uint32(0x1E35A7BD) * argb) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
    slot = strip << CACHE_BITS | key
    # strips lie in order, so the order of keys brings equal slots together
    order = np.argsort(key.astype(np.min_scalar_type((1 << CACHE_BITS) - 1)), kind="stable")
    held = np.zeros(len(argb), np.uint32)
    same = slot[order[1:]] == slot[order[:-1]]
    held[order[1:][same]] = argb[order[:-1][same]]
    cached = held == argb
    # tokens: a pixel, a cache entry, or a copy
    covered = np.zeros(len(argb) + 1, np.int64)
    np.add.at(covered, begin, 1)
    np.add.at(covered, begin + length, -1)
    starts = np.cumsum(covered[:-1]) == 0
    starts[begin] = True
    at = np.flatnonzero(starts)
    copied = np.zeros(len(argb), np.int64)
    copied[begin] = np.arange(1, len(begin) + 1)
    copied = copied[at] - 1
    is_copy, is_cached = copied >= 0, (copied < 0) & cached[at]
    literal = ~is_copy & ~is_cached
    length_symbol, length_bits, length_more = prefixes(length)
    short = np.where(away < len(_SHORT), _SHORT[np.minimum(away, len(_SHORT) - 1)], 0)
    far_symbol, far_bits, far_more = prefixes(np.where(short > 0, short, away + 120))
    own = strip[at]
    green = ((argb[at] >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    green[is_cached] = 280 + key[at[is_cached]]
    green[is_copy] = 256 + length_symbol[copied[is_copy]]
    sizes = (280 + (1 << CACHE_BITS), 256, 256, 40)
    symbols = [(np.ones(len(at), bool), green), (literal, ((argb[at] >> np.uint32(16)) & np.uint32(255)).astype(np.int64)), (literal, (argb[at] & np.uint32(255)).astype(np.int64)), (is_copy, far_symbol[np.maximum(copied, 0)] if len(begin) else np.zeros(len(at), np.int64))]
    lengths, codes = [], []
    for (some, symbol), alphabet in zip(symbols, sizes, strict=True):
        counts = np.bincount(own[some] * alphabet + symbol[some], minlength=alphabet * n).reshape(n, alphabet)
        lengths.append(complete_lengths(counts))
        codes.append(codes_of(lengths[-1]))
    # what stands before the pixels
    told = [_code_heads(held) for held in lengths]
    heads = []
    for i in range(n):
        head = _fixed_bits(SIGNATURE, 8) + _fixed_bits(WIDTH - 1, 14) + _fixed_bits(int(heights[i]) - 1, 14) + [0] + _fixed_bits(0, 3)
        head += [1, *_fixed_bits(PREDICTOR, 2), *_fixed_bits(TILE_BITS - 2, 3), *_tile_bits(modes[i])] if modes[i] else []
        head += [0, 1, *_fixed_bits(CACHE_BITS, 4), 0]
        # alpha is 255 everywhere, 0 after prediction
        alpha = _UNUSED if modes[i] else [1, 0, 1, *_fixed_bits(255, 8)]
        heads.append(np.concatenate([np.array(head, np.uint8), *[told[c][i] for c in range(3)], np.array(alpha, np.uint8), told[3][i]]))
    # the bits of each token in one word, 45 at most
    size, word = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)

    def put(some: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        word[some] |= value << size[some]
        size[some] += bits

    for c, (some, symbol) in enumerate(symbols):
        here = np.flatnonzero(some)
        put(here, codes[c][own[here], symbol[here]], lengths[c][own[here], symbol[here]])
        if c == 0 and len(begin):
            put(np.flatnonzero(is_copy), length_more, length_bits)
    if len(begin):
        put(np.flatnonzero(is_copy), far_more, far_bits)
    head_bits = np.array([len(h) for h in heads])
    ends = np.cumsum(size)
    tokens = np.bincount(own, minlength=n)
    body_bits = np.diff(ends[np.cumsum(tokens) - 1], prepend=0)
    octets = (head_bits + body_bits + 7) // 8
    first = 8 * (np.cumsum(octets) - octets)
    place = ends - size + np.repeat(first + head_bits - (np.cumsum(body_bits) - body_bits), tokens)
    cells = np.zeros(int(octets.sum()) // 2 + 6, np.int64)
    shift = place & 15
    low = word << shift
    for k in range(4):
        cells += np.bincount((place >> 4) + k, (low >> (16 * k)) & 0xFFFF, minlength=len(cells)).astype(np.int64)
    out = cells.astype("<u2").view(np.uint8)[: int(octets.sum())].copy()
    found = []
    for i in range(n):
        lo = int(first[i]) // 8
        head = np.packbits(heads[i], bitorder="little")
        out[lo : lo + len(head)] |= head
        found.append(out[lo : lo + int(octets[i])].tobytes())
    return found


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _le24(n: int) -> bytes:
    return n.to_bytes(3, "little")


def container(streams: list[bytes], heights: list[int]) -> bytes:
    """A WebP file of one bitstream, or an extended one with a frame for each, one below the other."""
    if len(streams) == 1:
        body = _chunk(b"VP8L", streams[0])
    else:
        body = _chunk(b"VP8X", bytes([2, 0, 0, 0]) + _le24(WIDTH - 1) + _le24(sum(heights) - 1)) + _chunk(b"ANIM", bytes(6))
        y = 0
        for stream, height in zip(streams, heights, strict=True):
            body += _chunk(b"ANMF", _le24(0) + _le24(y // 2) + _le24(WIDTH - 1) + _le24(height - 1) + _le24(0) + b"\2" + _chunk(b"VP8L", stream))
            y += height
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def payload_of(text: bytes) -> bytes:
    """The bytes and spaces up to a positive multiple of a row."""
    return text + b" " * (max(ROW_BYTES, -(-len(text) // ROW_BYTES) * ROW_BYTES) - len(text))


def to_webp(payloads: list[bytes]) -> list[bytes]:
    """A lossless WebP file for each payload (a positive multiple of a row's bytes)."""
    strips, counts = [], []
    for p in payloads:
        rows = np.frombuffer(p, np.uint8).reshape(-1, WIDTH, 3)
        own = [rows[i : i + STRIP_ROWS] for i in range(0, len(rows), STRIP_ROWS)]
        strips += own
        counts.append(len(own))
    streams, at, files = [s for lo, hi in runs(np.array([x.size for x in strips]), BATCH_BYTES) for s in encode_strips(strips[lo:hi])], 0, []
    for n in counts:
        files.append(container(streams[at : at + n], [len(s) for s in strips[at : at + n]]))
        at += n
    return files


def samples(pictures: list[np.ndarray]) -> np.ndarray:
    """The RGB samples [row, column, 3] of the pictures of a file, one below the other."""
    argb = np.concatenate(pictures)
    return np.stack([(argb >> np.uint32(s)).astype(np.uint8) for s in (16, 8, 0)], axis=2)


def feature(rgb: np.ndarray) -> str:
    """Mean and spread of each channel, and a 64-bit gradient hash of an 8 x 9 grid of mean lightness."""
    flat = rgb.reshape(-1, 3)
    n = len(flat)
    sums = flat.sum(0, dtype=np.int64)
    squares = np.einsum("ij,ij->j", flat.astype(np.int64), flat.astype(np.int64))
    spread = np.sqrt(np.maximum(0, squares / n - (sums / n) ** 2))
    light = rgb.sum(2, dtype=np.int64)
    down = np.add.reduceat(light, np.arange(9) * WIDTH // 9, axis=1)
    rows = np.add.reduceat(down, np.unique(np.arange(8) * len(rgb) // 8), axis=0)
    rows = rows[np.arange(8) * len(rows) // 8]
    bits = np.packbits(rows[:, 1:] * np.diff(np.arange(9) * WIDTH // 9)[:8] > rows[:, :-1] * np.diff(np.append(np.arange(9) * WIDTH // 9, WIDTH))[1:])
    return ",".join(f"{x:.3f}" for x in [*(sums / n), *spread]) + "," + bits.tobytes().hex()


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of each row of ``docs`` (doc_id, text): its text as a lossless WebP file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = texts(batch.column(1))
            for lo, hi in runs(np.array([len(t) for t in found]), BATCH_BYTES):
                files = to_webp([payload_of(t) for t in found[lo:hi]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in found[lo:hi]], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What is read back from the files of ``media`` (doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(2).to_pylist()
            for lo, hi in runs(batch.column(1).to_numpy(), BATCH_BYTES):
                out = []
                for key, n, file, pictures in zip(batch.column(0)[lo:hi].to_pylist(), batch.column(1)[lo:hi].to_pylist(), files[lo:hi], decode(files[lo:hi]), strict=True):
                    rgb = samples(pictures)
                    payload = rgb.tobytes()
                    out.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature(rgb)))
                types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])

    return media.mapInArrow(run, RESULT)


def op3_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of ``documents`` as lossless WebP files, read back."""
    return media_features(media_column(table(spark, sf_dir, "documents")))

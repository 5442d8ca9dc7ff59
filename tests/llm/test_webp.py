"""Round trips, and streams with every feature of the format, written by a plain encoder here."""

import hashlib
import zlib

import numpy as np
import pytest

from tests.llm.conftest import ODD
from waytrace.llm import webp


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> i) & 1 for i in range(n)]

    def data(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def huffman(counts, most=15):
    """Code lengths by merging the two rarest."""
    used = [(c, i, [i]) for i, c in enumerate(counts) if c]
    lengths = [0] * len(counts)
    if len(used) == 1:
        lengths[used[0][1]] = 1
    while len(used) > 1:
        used.sort()
        (a, i, left), (b, _, right), *used = used
        for s in left + right:
            lengths[s] += 1
        used.append((a + b, i, left + right))
    return lengths if max(lengths) <= most else huffman([-(-c // 2) for c in counts], most)


def canonical(lengths):
    code, codes = 0, {}
    for n in range(1, 16):
        for s, length in enumerate(lengths):
            if length == n:
                codes[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
                code += 1
        code <<= 1
    return codes


def put_code(out, counts, repeats=True):
    """Write a prefix code for the counts; returns symbol -> (bits, n)."""
    used = [i for i, c in enumerate(counts) if c]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for s in used:
            out.put(s, 8)
        return {used[0]: (0, 0)} if len(used) == 1 else {used[0]: (0, 1), used[1]: (1, 1)}
    lengths = huffman(counts)
    steps, i, last = [], 0, 8
    while i < len(lengths):
        run = 1
        while i + run < len(lengths) and lengths[i + run] == lengths[i]:
            run += 1
        if repeats and lengths[i] == 0 and run >= 11:
            n = min(run, 138)
            steps.append((18, n - 11, 7))
        elif repeats and lengths[i] == 0 and run >= 3:
            n = min(run, 10)
            steps.append((17, n - 3, 3))
        elif repeats and lengths[i] == last and run >= 3:
            n = min(run, 6)
            steps.append((16, n - 3, 2))
        else:
            n = 1
            steps.append((lengths[i], 0, 0))
            last = lengths[i] or last
        i += n
    own = huffman([sum(1 for s, _, _ in steps if s == k) for k in range(19)], 7)
    if sum(1 for x in own if x) == 1:  # one symbol: its code has no bits
        table = {own.index(1): (0, 0)}
    else:
        table = canonical(own)
    out.put(0, 1)
    out.put(15, 4)
    for s in webp.LENGTH_ORDER:
        out.put(own[s], 3)
    out.put(0, 1)
    for s, extra, n in steps:
        out.put(*table[s])
        out.put(extra, n)
    codes = canonical(lengths)
    return {used[0]: (0, 0)} if len(used) == 1 else codes


def prefix(value):
    """Symbol, extra bits and their number for a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    n = value.bit_length() - 1
    half = (value >> (n - 1)) & 1
    return 2 * n + half, value & ((1 << (n - 1)) - 1), n - 1


def put_pixels(out, pixels, width, top, cache_bits=0, copies=False, groups=None):
    """Entropy-code ARGB pixels. ``copies``: use back-references; ``groups``: (bits, group of each tile)."""
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    group_at = lambda i: 0
    n_groups = 1
    if top:
        out.put(1 if groups else 0, 1)
        if groups:
            bits, tiles = groups
            out.put(bits - 2, 3)
            across = webp.shrink(width, bits)
            put_pixels(out, [t << 8 for t in tiles], across, False)
            n_groups = max(tiles) + 1
            group_at = lambda i: tiles[(i // width >> bits) * across + (i % width >> bits)]
    near = {max(1, int(x + y * width)): k + 1 for k, (x, y) in reversed(list(enumerate(webp.NEAR)))}
    cache, tokens, i = {}, [], 0
    key = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(pixels):
        best = (0, 0)
        if copies:
            for d in {*near, 150, 200} & set(range(1, i + 1)):
                n = 0
                while i + n < len(pixels) and pixels[i + n] == pixels[i + n - d]:
                    n += 1
                best = max(best, (n, d))
        if best[0] >= 2:
            n, d = best
            tokens.append((i, "copy", prefix(n), prefix(near.get(d, d + 120))))
        elif cache_bits and cache.get(key(pixels[i])) == pixels[i]:
            n = 1
            tokens.append((i, "cache", key(pixels[i])))
        else:
            n = 1
            p = pixels[i]
            tokens.append((i, "plain", [(p >> 8) & 255, (p >> 16) & 255, p & 255, p >> 24]))
        for p in pixels[i : i + n]:
            if cache_bits:
                cache[key(p)] = p
        i += n
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[[0] * n for n in sizes] for _ in range(n_groups)]
    for at, kind, *rest in tokens:
        c = counts[group_at(at)]
        if kind == "plain":
            for k, s in enumerate(rest[0]):
                c[k][s] += 1
        elif kind == "cache":
            c[0][280 + rest[0]] += 1
        else:
            c[0][256 + rest[0][0]] += 1
            c[4][rest[1][0]] += 1
    codes = [[put_code(out, c) for c in group] for group in counts]
    for at, kind, *rest in tokens:
        c = codes[group_at(at)]
        if kind == "plain":
            for k, s in enumerate(rest[0]):
                out.put(*c[k][s])
        elif kind == "cache":
            out.put(*c[0][280 + rest[0]])
        else:
            (s, extra, n), (ds, dextra, dn) = rest
            out.put(*c[0][256 + s])
            out.put(extra, n)
            out.put(*c[4][ds])
            out.put(dextra, dn)


def header(out, width, height):
    out.put(webp.SIGNATURE, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)


def as_file(out):
    return webp.container([out.data()], [1])


def picture(width, height, colours=40, seed=1):
    rng = np.random.default_rng(seed)
    palette = rng.integers(0, 1 << 32, colours)
    return [int(palette[x]) for x in np.minimum(rng.geometric(0.2, width * height), colours) - 1]


def decoded(out):
    return webp.decode([as_file(out)])[0][0].reshape(-1).tolist()


@pytest.mark.parametrize(("width", "height", "options"), [(7, 5, {}), (33, 20, {"cache_bits": 5}), (33, 20, {"copies": True}), (16, 16, {"copies": True, "cache_bits": 3}), (1, 1, {}), (20, 9, {"groups": (2, [0, 1, 2, 1, 0] * 3)})])
def test_entropy_coding(width, height, options):
    pixels = picture(width, height)
    out = Writer()
    header(out, width, height)
    out.put(0, 1)
    put_pixels(out, pixels, width, True, **options)
    assert decoded(out) == pixels


def test_green():
    pixels = picture(9, 9)
    out = Writer()
    header(out, 9, 9)
    out.put(1, 1)
    out.put(webp.SUBTRACT_GREEN, 2)
    out.put(0, 1)
    less = [(p & 0xFF00FF00) | (((p >> 16) - (p >> 8)) & 255) << 16 | ((p - (p >> 8)) & 255) for p in pixels]
    put_pixels(out, less, 9, True)
    assert decoded(out) == pixels


@pytest.mark.parametrize("colours", [2, 3, 4, 13, 40])
def test_palettes(colours):
    palette = [int(x) for x in np.random.default_rng(2).integers(0, 1 << 32, colours)]
    index = np.random.default_rng(3).integers(0, colours, 13 * 6)
    bundle = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    out = Writer()
    header(out, 13, 6)
    out.put(1, 1)
    out.put(webp.PALETTE, 2)
    out.put(colours - 1, 8)
    steps, before = [], 0
    for p in palette:
        steps.append(sum((((p >> s) - (before >> s)) & 255) << s for s in (0, 8, 16, 24)))
        before = p
    put_pixels(out, steps, colours, False)
    out.put(0, 1)
    across, each, packed = webp.shrink(13, bundle), 8 >> bundle, []
    for y in range(6):
        for x in range(across):
            row = index[13 * y : 13 * y + 13][x << bundle : (x + 1) << bundle]
            packed.append(sum(int(v) << (each * i) for i, v in enumerate(row)) << 8 | 0xFF000000)
    put_pixels(out, packed, across, True)
    assert decoded(out) == [palette[i] for i in index]


def channel(p):
    return [(p >> s) & 255 for s in (24, 16, 8, 0)]


def guess(mode, l, t, tl, tr):
    """One prediction, channel by channel."""
    half = lambda a, b: (a + b) // 2
    clamp = lambda x: min(255, max(0, x))
    if mode == 11:
        to_left = sum(abs(b - c) for b, c in zip(t, tl, strict=True))
        to_top = sum(abs(a - c) for a, c in zip(l, tl, strict=True))
        return l if to_left < to_top else t
    out = []
    for k in range(4):
        a, b, c, d = l[k], t[k], tl[k], tr[k]
        m = half(a, b)
        out.append([255 if k == 0 else 0, a, b, d, c, half(half(a, d), b), half(a, c), m, half(c, b), half(b, d), half(half(a, c), half(b, d)), 0, clamp(a + b - c), clamp(m + int((m - c) / 2))][mode])
    return out


def test_predictors():
    width, height, bits = 30, 19, 2
    pixels = picture(width, height, 300)
    across, down = webp.shrink(width, bits), webp.shrink(height, bits)
    modes = [i % 14 for i in range(across * down)]
    at = lambda x, y: channel(pixels[y * width + x])
    off = []
    for y in range(height):
        for x in range(width):
            if x == y == 0:
                g = [255, 0, 0, 0]
            elif y == 0:
                g = at(x - 1, 0)
            elif x == 0:
                g = at(0, y - 1)
            else:
                right = at(x + 1, y - 1) if x + 1 < width else at(0, y)
                g = guess(modes[(y >> bits) * across + (x >> bits)], at(x - 1, y), at(x, y - 1), at(x - 1, y - 1), right)
            off.append(sum(((p - q) & 255) << s for p, q, s in zip(at(x, y), g, (24, 16, 8, 0), strict=True)))
    out = Writer()
    header(out, width, height)
    out.put(1, 1)
    out.put(webp.PREDICTOR, 2)
    out.put(bits - 2, 3)
    put_pixels(out, [m << 8 for m in modes], across, False)
    out.put(0, 1)
    put_pixels(out, off, width, True)
    assert decoded(out) == pixels


def test_cross_colour_under_a_predictor():
    width, height, bits = 9, 8, 2
    pixels = picture(width, height, 100)
    across = webp.shrink(width, bits)
    factors = picture(across, webp.shrink(height, bits), 100, 9)
    signed = lambda v: (v & 255) - 256 if v & 128 else v & 255
    coded = []
    for i, p in enumerate(pixels):
        f = channel(factors[(i // width >> bits) * across + (i % width >> bits)])
        a, r, g, b = channel(p)
        new_r = (r - (signed(f[3]) * signed(g) >> 5)) & 255
        new_b = (b - (signed(f[2]) * signed(g) >> 5) - (signed(f[1]) * signed(r) >> 5)) & 255
        coded.append(a << 24 | new_r << 16 | g << 8 | new_b)
    out = Writer()
    header(out, width, height)
    out.put(1, 1)
    out.put(webp.CROSS_COLOUR, 2)
    out.put(bits - 2, 3)
    put_pixels(out, factors, across, False)
    out.put(0, 1)
    put_pixels(out, coded, width, True)
    assert decoded(out) == pixels


def test_many_pictures_in_lockstep():
    files, wanted = [], []
    for i in range(12):
        w, h = 1 + i * 3, 1 + (7 * i) % 11
        pixels = picture(w, h, 30, i)
        out = Writer()
        header(out, w, h)
        out.put(0, 1)
        put_pixels(out, pixels, w, True, cache_bits=i % 4, copies=i % 3 == 0)
        files.append(as_file(out))
        wanted.append(pixels)
    assert [p[0].reshape(-1).tolist() for p in webp.decode(files)] == wanted


def test_damage():
    out = Writer()
    header(out, 40, 40)
    out.put(0, 1)
    put_pixels(out, picture(40, 40), 40, True)
    good = out.data()
    for bad in (good[:30], b"\x00" + good[1:], good[: len(good) // 2]):
        with pytest.raises(webp.Damaged):
            webp.decode([webp.container([bad], [1])])
    with pytest.raises(webp.Damaged):
        webp.decode([b"RIFF1234WEBX"])


def test_short_distances_are_fixed():
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:6].tolist() == [[0, 1], [1, 0], [1, 1], [-1, 1], [0, 2], [2, 0]]
    assert webp.NEAR[-2:].tolist() == [[8, 6], [8, 7]]


def test_payloads():
    rng = np.random.default_rng(5)
    texts = [b"", b"a", bytes(range(256)) * 3, b"z" * 192, rng.bytes(40_000), b"one two " * 9000, b"\xff" * 193]
    payloads = [webp.payload_of(t) for t in texts]
    assert all(len(p) and len(p) % 192 == 0 for p in payloads)
    files = webp.to_webp(payloads)
    assert [webp.samples(p).tobytes() for p in webp.decode(files)] == payloads
    assert webp.to_webp(payloads[4:5]) == files[4:5]
    for lengths in webp.complete_lengths(rng.integers(0, 3, (50, 256)) ** 9):
        assert sum(2.0 ** -int(n) for n in lengths if n) == 1


def test_documents(odd, nothing):
    got = sorted(webp.media_features(webp.media_column(odd)).collect(), key=lambda r: (r.doc_id or 0, r.n_bytes))
    for row, (key, text) in zip(got, sorted(ODD, key=lambda r: (r[0] or 0, len((r[1] or "").encode()))), strict=True):
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (row.doc_id, row.n_bytes, row.payload_bytes) == (key, len(raw), len(payload))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert row.tail_crc32 == zlib.crc32(payload[-16:])
    same = [tuple(r)[1:] for r in got if r.doc_id in (5, 6)]
    assert len(same) == 3
    assert len(set(same)) == 1
    assert webp.media_features(webp.media_column(nothing)).count() == 0


def test_encoder_needs_the_features():
    rng = np.random.default_rng(12)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), dtype=np.uint8)) for _ in range(300)]
    prose = b" ".join(words[i] for i in rng.integers(0, 300, 1500))
    texts = [prose, b"one line again and again. " * 400, b" " * 3000 + prose[:500], b"ab" * 96 * 64, prose[:3000] * 2, prose[:3000]]
    payloads = [webp.payload_of(t) for t in texts]
    files = webp.to_webp(payloads)
    assert [webp.samples(p).tobytes() for p in webp.decode(files)] == payloads
    streams = [[webp.Stream(s) for s in webp.bitstreams(f)] for f in files]
    assert all(s.picture.cache_bits == webp.CACHE_BITS for f in streams for s in f)
    kinds = [[t[0] for t in f[0].transforms] for f in streams]
    assert kinds[0] == []
    assert webp.PREDICTOR in kinds[2]
    # of the prefix code of the green channel: literals, lengths and cache entries
    held = [set((table >> 4).tolist()) for table, _ in (f[0].picture.codes[0][0] for f in streams)]
    assert all(any(x >= 280 for x in h) for h in held)
    assert any(256 <= x < 280 for x in held[1])
    assert len(files[4]) < 1.2 * len(files[5])


@pytest.mark.parametrize("seed", range(12))
def test_runs_and_repeats(seed):
    rng = np.random.default_rng(seed)
    parts = [bytes(rng.integers(0, 4, 1, dtype=np.uint8)) * int(rng.integers(1, 900)) if rng.random() < 0.4 else bytes(rng.integers(0, 256, int(rng.integers(1, 400)), dtype=np.uint8)) for _ in range(6)]
    payloads = [webp.payload_of(b"".join(parts[i] for i in rng.integers(0, 6, int(rng.integers(0, 40))))) for _ in range(9)]
    files = webp.to_webp(payloads)
    assert [webp.samples(p).tobytes() for p in webp.decode(files)] == payloads
    # one file alone, and by the predictor of a single picture
    for file, payload in zip(files, payloads, strict=True):
        streams = [webp.Stream(s) for s in webp.bitstreams(file)]
        pixels = [s.finish(webp.decode_pictures([s.picture])[0]) for s in streams]
        assert webp.samples(pixels).tobytes() == payload

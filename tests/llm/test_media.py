"""Lossless WebP: exact round trips of the production encoder, and of streams with every feature of the format from an
encoder that is written here for the tests."""

import hashlib
import zlib

import numpy as np
import pytest

from pulseframe.llm import media, queries, webp

NEAR = [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0)]
ODD = [None, "", "x", "é" * 288, "a" * 576, "b" * 575, "c" * 577, "wörter und 😀 " * 4000, "".join(map(chr, range(1, 3000)))]


def test_near_places():
    assert len(webp.NEAR) == 120 and webp.NEAR[: len(NEAR)] == NEAR and webp.NEAR[-4:] == [(7, 7), (-7, 7), (8, 6), (8, 7)]


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def lengths_of(symbols, size, rng):
    counts = np.bincount(symbols, minlength=size)
    used = np.flatnonzero(counts)
    out = [0] * size
    if len(used) == 1:
        out[used[0]] = 1
        return out
    flat = counts[used] + len(symbols) / 40 + 1  # no code beyond 15 bits
    for s, n in zip(used, webp.huffman(flat.tolist())):
        out[s] = n
    return out


def codes(lengths):
    if sum(1 for n in lengths if n) == 1:
        return {s: [] for s, n in enumerate(lengths) if n}
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = [int(c) for c in f"{code:0{n}b}"]
        code += 1
    return out


def write_lengths(out, lengths, rng):
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and max(used) < 256 and all(lengths[s] == 1 for s in used):
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        short = used[0] < 2
        out.put(int(not short), 1)
        out.put(used[0], 1 if short else 8)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    tokens, i, last = [], 0, 8
    while i < len(lengths):
        run = next((k for k in range(i, len(lengths)) if lengths[k] != lengths[i]), len(lengths)) - i
        if lengths[i] == 0 and run >= 3:
            n = min(run, 138)
            tokens.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
        elif lengths[i] and lengths[i] == last and run >= 3:
            n = min(run, 6)
            tokens.append((16, n - 3, 2))
        else:
            n = 1
            tokens.append((lengths[i], 0, 0))
            last = lengths[i] or last
        i += n
    inner = lengths_of(np.array([t for t, *_ in tokens] + [0, 8]), 19, rng)
    assert max(inner) < 8
    code = codes(inner)
    order = webp.CODE_LENGTH_ORDER
    n = max(4, max(k + 1 for k, s in enumerate(order) if inner[s]))
    out.put(0, 1)
    out.put(n - 4, 4)
    for s in order[:n]:
        out.put(inner[s], 3)
    while tokens and tokens[-1][0] in (0, 17, 18):
        tokens.pop()  # zeros at the end are left to the given number of codes
    out.put(1, 1)
    out.put(4, 3)
    out.put(len(tokens) - 2, 10)
    for s, extra, n in tokens:
        out.bits += code[s]
        out.put(extra, n)


def prefix(value):
    if value < 5:
        return value - 1, 0, 0
    top = (value - 1).bit_length() - 1
    return 2 * top + ((value - 1) >> (top - 1) & 1), (value - 1) & ((1 << (top - 1)) - 1), top - 1


def write_pixels(out, pixels, width, rng, cache_bits=0, top=False, meta=0):
    """Literals, back-references and cache hits; meta: that many bits of a block with its own codes."""
    pixels = [int(p) for p in pixels]
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    groups, group = 1, lambda at: 0
    if top:
        out.put(int(meta > 0), 1)
        if meta:
            out.put(meta - 2, 3)
            across, down = -(-width >> meta), -(-(len(pixels) // width) >> meta)
            of = rng.integers(0, 3, across * down)
            of[-1] = 2
            write_pixels(out, of << 8, across, rng)
            groups, group = 3, lambda at: of[(at // width >> meta) * across + (at % width >> meta)]
    tokens, at, cache = [], 0, {}
    key = lambda p: (p * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < len(pixels):
        best = max(((run_length(pixels, at, d), d) for d in (1, 2, width, width + 1, width - 1, 3 * width, 150) if 0 < d <= at), default=(0, 0))
        if best[0] >= 3:
            n, d = best
            named = next((k + 1 for k, (x, y) in enumerate(NEAR) if max(1, x + y * width) == d), d + 120)
            tokens.append((at, "back", n, named))
        elif cache_bits and cache.get(key(pixels[at])) == pixels[at]:
            tokens.append((at, "cache", key(pixels[at]), 0))
            n = 1
        else:
            tokens.append((at, "pixel", pixels[at], 0))
            n = 1
        if cache_bits:
            for p in pixels[at : at + n]:
                cache[key(p)] = p
        at += n
    seen = [[[] for _ in range(5)] for _ in range(groups)]
    for at, kind, a, b in tokens:
        lists = seen[group(at)]
        if kind == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                lists[k].append(a >> shift & 255)
        elif kind == "cache":
            lists[0].append(280 + a)
        else:
            lists[0].append(256 + prefix(a)[0])
            lists[4].append(prefix(b)[0])
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    tables = []
    for lists in seen:
        lengths = [lengths_of(np.array(x or [0]), n, rng) for x, n in zip(lists, sizes)]
        for x in lengths:
            write_lengths(out, x, rng)
        tables.append([codes(x) for x in lengths])
    for at, kind, a, b in tokens:
        table = tables[group(at)]
        if kind == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                out.bits += table[k][a >> shift & 255]
        elif kind == "cache":
            out.bits += table[0][280 + a]
        else:
            for code, (s, extra, n) in ((0, prefix(a)), (4, prefix(b))):
                out.bits += table[code][s + (256 if code == 0 else 0)]
                out.put(extra, n)


def run_length(pixels, at, d):
    n = 0
    while at + n < len(pixels) and n < 4096 and pixels[at + n] == pixels[at + n - d]:
        n += 1
    return n


def packed(image):
    return image.astype(np.uint32) @ np.array([1, 1 << 8, 1 << 16, 1 << 24], np.uint32)


def guess(image, y, x, mode):
    """The format's predictions, a pixel at a time."""
    if y == 0 or x == 0:
        return np.array([0, 0, 0, 255]) if y == x == 0 else image[y, x - 1] if y == 0 else image[y - 1, x]
    left, top, corner = image[y, x - 1], image[y - 1, x], image[y - 1, x - 1]
    right = image[y - 1, x + 1] if x + 1 < image.shape[1] else image[y, 0]
    half = lambda a, b: (a + b) // 2
    if mode == 11:
        p = left + top - corner
        return left if np.abs(p - left).sum() < np.abs(p - top).sum() else top
    if mode == 13:
        a = half(left, top)
        return np.clip([int(v + int((v - c) / 2)) for v, c in zip(a, corner)], 0, 255)
    return [np.array([0, 0, 0, 255]), left, top, right, corner, half(half(left, right), top), half(left, corner), half(left, top), half(corner, top), half(top, right), half(half(left, corner), half(top, right)), None, np.clip(left + top - corner, 0, 255)][mode]


def encode(image, transforms, rng, cache_bits=0, meta=0, block=2):
    height, width, _ = image.shape
    out = Bits()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    now = image.astype(np.int64)
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        h, w, _ = now.shape
        across, down = -(-w >> block), -(-h >> block)
        if kind == webp.SUBTRACT_GREEN:
            now = now - now[..., [1]] * np.array([1, 0, 1, 0])
        elif kind == webp.CROSS_COLOUR:
            out.put(block - 2, 3)
            by = rng.integers(0, 256, (down, across, 3))
            write_pixels(out, packed(np.dstack((by, np.full((down, across, 1), 255))).reshape(-1, 4)), across, rng)
            signed = lambda v: (v + 128) % 256 - 128
            m = signed(by[np.arange(h) >> block][:, np.arange(w) >> block])
            g, r = signed(now[..., 1]), signed(now[..., 2])
            delta = np.zeros_like(now)
            delta[..., 2] = m[..., 0] * g >> 5
            delta[..., 0] = (m[..., 1] * g >> 5) + (m[..., 2] * r >> 5)
            now = now - delta
        elif kind == webp.PREDICTOR:
            out.put(block - 2, 3)
            modes = rng.integers(0, 14, (down, across))
            write_pixels(out, (modes << 8 | 0xFF000000).ravel(), across, rng)
            now = np.array([[now[y, x] - guess(now, y, x, modes[y >> block, x >> block]) for x in range(w)] for y in range(h)])
        else:
            colours, index = np.unique(now.reshape(-1, 4), axis=0, return_inverse=True)
            out.put(len(colours) - 1, 8)
            steps = np.diff(colours, axis=0, prepend=np.zeros((1, 4), int)) % 256
            write_pixels(out, packed(steps), len(colours), rng)
            bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            index = index.reshape(h, w)
            wide = np.zeros((h, -(-w >> bits) << bits), int)
            wide[:, :w] = index
            parts = wide.reshape(h, -1, 1 << bits)
            green = (parts << (np.arange(1 << bits) * (8 >> bits))).sum(axis=2)
            now = np.dstack((np.zeros_like(green), green, np.zeros_like(green), np.full_like(green, 255)))
        now = now % 256
    out.put(0, 1)
    write_pixels(out, packed(now.reshape(-1, 4)), now.shape[1], rng, cache_bits, True, meta)
    data = out.bytes()
    data += b"\0" * (len(data) % 2)
    return b"RIFF" + (len(data) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data


P, C, G, I = webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN, webp.PALETTE


@pytest.mark.parametrize("transforms", [(), (G,), (C,), (P,), (P, C, G), (G, P), (I,), (I, P)])
@pytest.mark.parametrize("cache_bits, meta", [(0, 0), (1, 0), (6, 2), (0, 3)])
def test_every_feature(transforms, cache_bits, meta):
    rng = np.random.default_rng(len(transforms) * 100 + cache_bits * 10 + meta)
    for colours, height, width in ((2, 9, 13), (4, 6, 7), (13, 11, 5), (200, 10, 24), (0, 12, 17), (3, 1, 1), (5, 7, 1)):
        if not colours and I in transforms:
            continue
        palette = rng.integers(0, 256, (colours or 4000, 4))
        image = palette[rng.integers(0, len(palette), (height, width))]
        image[height // 2 :, : width // 2] = image[0, 0]  # something to refer back to
        image = image.astype(np.uint8)
        assert (webp.decode(encode(image, transforms, rng, cache_bits, meta)) == image).all(), (colours, height, width)


def test_grey_round_trip():
    rng = np.random.default_rng(0)
    for samples in (np.full(576, 255), np.full(5760, 254), rng.integers(0, 256, 576 * 9), np.r_[rng.integers(97, 123, 1000), np.full(152, 255)], np.full(576 * 20, 255)):
        samples = samples.astype(np.uint8)
        image = webp.decode(webp.encode_grey(samples))
        assert image.shape == (len(samples) // 576, 576, 4) and all((image[..., k].ravel() == samples).all() for k in range(3)) and (image[..., 3] == 255).all()


def test_bad_files():
    good = webp.encode_grey(np.zeros(576, np.uint8))
    for bad in (b"", b"RIFF", good.replace(b"VP8L", b"VP8 ")):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)
    with pytest.raises(ValueError):
        webp.Code((1, 2))


def test_several_files(monkeypatch):
    monkeypatch.setattr(webp, "ROWS", 2)
    text = bytes(range(256)) * 11
    stored = media._stored(text)
    assert len(list(media.parts(stored))) == 3 and media.pixels(stored)[..., 1].tobytes()[: len(text)] == text


def test_columns(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD, ODD[4]])], "doc_id long, text string, media string")
    stored = media.encode(df)
    got = {r.doc_id: r for r in media.describe(stored).collect()}
    arrays = {r.doc_id: r for r in media.decode(stored).collect()}
    held = {r.doc_id: r.media for r in stored.collect()}
    for i, t in enumerate([*ODD, ODD[4]]):
        data = (t or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(held[i]), hashlib.sha256(held[i]).hexdigest())
        assert (arrays[i].width, arrays[i].height) == (576, len(payload) // 576) and bytes(arrays[i].pixels)[1::4] == payload
    assert got[4].feature == got[len(ODD)].feature == "576x1 mean=97.0000 contrast=0.0000 step=0.0000 levels=1"
    assert media.describe(media.encode(df.where("false"))).count() == 0 and media.decode(stored.withColumn("media", stored.media.substr(1, 0).cast("binary")).where("false")).count() == 0


def test_query(spark):
    found = queries.op9_media(spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in found.collect():
        data = texts[r.doc_id]
        payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.n_bytes == len(data)

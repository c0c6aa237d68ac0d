"""The lossless WebP bitstream: a decoder of all its features, and an encoder of grey samples."""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

#: Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SIGNATURE, CACHE_FACTOR, LONGEST_CODE, LENGTHS, DISTANCES = 0x2F, 0x1E35A7BD, 15, 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: The 120 short distances name places in the rows above, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if x > 0 or y > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))

ROW, ROWS = 576, 1 << 14  #: samples in a row, and rows in an image, at most the format's limit
#: The encoder's code: letters from frequent to rare, then other bytes. Fixed, so that equal texts have equal files.
FREQUENT = b" enitarosdlhcu\xc3mpg,.bf\nvywk\xa9zqxj-'" + b"EATSIODLCPMRNBHUFGWVKJ0123456789\"()!?:;|_/@QXYZ"


class Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)


def canonical(lengths: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(symbol, length, code with its first bit lowest) of a prefix code."""
    out, code, last = [], 0, 0
    for length, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= length - last
        last = length
        out.append((symbol, length, int(f"{code:0{length}b}"[::-1], 2)))
        code += 1
    return out


class Code:
    """A prefix code: a table by the next bits, and one that takes a byte at a time."""

    def __init__(self, lengths: tuple[int, ...]):
        self.codes, self.lengths = canonical(lengths), np.array(lengths)
        if not self.codes:
            raise ValueError("a prefix code without symbols")
        self.only = self.codes[0][0] if len(self.codes) == 1 else None
        if self.only is None:
            if sum(1 << LONGEST_CODE - n for _, n, _ in self.codes) != 1 << LONGEST_CODE:
                raise ValueError("a prefix code that isn't complete")
            self.width = max(n for _, n, _ in self.codes)
            self.table: list = [None] * (1 << self.width)
            for symbol, n, code in self.codes:
                self.table[code :: 1 << n] = [(symbol, n)] * (1 << self.width - n)

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        symbol, n = self.table[Bits(bits.data, bits.at).read(self.width)]
        bits.at += n
        return symbol

    def automaton(self) -> tuple[list[int], np.ndarray, np.ndarray, int]:
        """States are places in the code's tree. next[state * 256 + byte] is the state after the byte, times 256; the
        tables tell the symbols that it ends. The last state is a trap behind any symbol that isn't a byte."""
        children: list[list[int]] = [[0, 0]]  # a node, or a symbol as -1 - symbol
        for symbol, n, code in self.codes:
            node = 0
            for i in range(n - 1):
                if not children[node][code >> i & 1]:
                    children[node][code >> i & 1] = len(children)
                    children.append([0, 0])
                node = children[node][code >> i & 1]
            children[node][code >> n - 1 & 1] = -1 - symbol
        nodes = len(children)
        children.append([nodes, nodes])
        step = np.array(children)
        state = np.repeat(np.arange(nodes + 1), 256)
        byte = np.tile(np.arange(256), nodes + 1)
        symbols, counts = np.zeros((len(state), 8), np.uint8), np.zeros(len(state), np.uint8)
        for i in range(8):
            to = step[state, byte >> i & 1]
            ended = (to < 0) & (to >= -256)
            symbols[ended, counts[ended]] = -1 - to[ended]
            counts[ended] += 1
            state = np.where(to >= 0, to, np.where(ended, 0, nodes))
        return (state * 256).tolist(), symbols[:, : max(1, counts.max())].copy(), counts, nodes * 256


@lru_cache(maxsize=64)
def code_of(lengths: tuple[int, ...]) -> Code:
    return Code(lengths)


@lru_cache(maxsize=4)
def automaton_of(lengths: tuple[int, ...]) -> tuple:
    return Code(lengths).automaton()


def read_code(bits: Bits, size: int) -> tuple[int, ...]:
    """The lengths of a prefix code of so many symbols."""
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return tuple(lengths)
    inner = [0] * len(CODE_LENGTH_ORDER)
    for k in range(4 + bits.read(4)):
        inner[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code = code_of(tuple(inner))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        n = code.read(bits)
        if n < 16:
            lengths[at] = n
            last = n or last
            at += 1
        else:
            times = 3 + bits.read(2) if n == 16 else 3 + bits.read(3) if n == 17 else 11 + bits.read(7)
            if at + times > size:
                raise ValueError("code lengths run over")
            lengths[at : at + times] = [last if n == 16 else 0] * times
            at += times
    return tuple(lengths)


def read_value(bits: Bits, prefix: int) -> int:
    """The length or distance that a prefix symbol and its extra bits give."""
    if prefix < 4:
        return prefix + 1
    extra = prefix - 2 >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_group(bits: Bits, cache_bits: int) -> list[tuple[int, ...]]:
    return [read_code(bits, n) for n in (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)]


def read_image(bits: Bits, width: int, height: int, top: bool = False, known: tuple | None = None) -> np.ndarray:
    """An entropy-coded image: ARGB pixels as 32-bit integers, row by row."""
    meta = None
    if known:
        cache_bits, groups = known
    else:
        cache_bits = bits.read(4) if bits.read(1) else 0
        n_groups = 1
        if top and bits.read(1):
            block = bits.read(3) + 2
            across = -(-width >> block)
            meta = (read_image(bits, across, -(-height >> block)) >> 8 & 0xFFFF).tolist()
            n_groups = max(meta) + 1
        groups = [read_group(bits, cache_bits) for _ in range(n_groups)]
    codes = [[code_of(lengths) for lengths in group] for group in groups]
    total, cache, hashed = width * height, [0] * (1 << cache_bits if cache_bits else 0), 0
    done = np.empty(0, np.uint32)
    if meta is None and not cache_bits and total >= 64 and codes[0][0].only is None and all(c.only is not None for c in codes[0][1:4]):
        done = _bytewise(bits, groups[0][0], total, codes[0][3].only << 24 | codes[0][1].only << 16 | codes[0][2].only)
        green, distance = codes[0][0], codes[0][4]
        if total - len(done) <= 4096 and len(done) < total and distance.only == 1:  # a run to the end
            before = bits.at
            if read_value(bits, green.read(bits) - 256) == total - len(done):
                return np.concatenate((done, np.full(total - len(done), done[-1] if len(done) else 0, np.uint32)))
            bits.at = before
    at = len(done)
    out = done.tolist() + [0] * (total - at)
    green, red, blue, alpha, distance = codes[0]
    while at < total:
        if meta is not None:
            green, red, blue, alpha, distance = codes[meta[(at // width >> block) * across + (at % width >> block)]]
        symbol = green.read(bits)
        if symbol < 256:
            out[at] = red.read(bits) << 16 | symbol << 8 | blue.read(bits) | alpha.read(bits) << 24
            at += 1
        elif symbol < 256 + LENGTHS:
            n, d = read_value(bits, symbol - 256), read_value(bits, distance.read(bits))
            back = d - len(NEAR) if d > len(NEAR) else max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * width)
            if back > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            if back >= n:
                out[at : at + n] = out[at - back : at - back + n]
            else:
                unit = out[at - back : at]
                out[at : at + n] = (unit * (n // back + 1))[:n]
            at += n
        else:
            while hashed < at:  # pixels since the cache was last asked
                cache[(out[hashed] * CACHE_FACTOR & 0xFFFFFFFF) >> 32 - cache_bits] = out[hashed]
                hashed += 1
            out[at] = cache[symbol - 256 - LENGTHS]
            at += 1
    return np.array(out, np.uint32)


def _bytewise(bits: Bits, lengths: tuple[int, ...], total: int, rest: int) -> np.ndarray:
    """The pixels up to the first symbol that isn't a literal, when only green varies; bits then stands before it."""
    following, symbols, counts, trap = automaton_of(lengths)
    a, shift = bits.at >> 3, bits.at & 7
    data = np.frombuffer(bits.data, np.uint8)[a:]
    if shift:
        data = data >> np.uint8(shift) | np.append(data[1:], np.uint8(0)) << np.uint8(8 - shift)
    state = 0
    states = np.array([0] + [state := following[state + byte] for byte in data.tolist()], np.int32)
    n = min(len(data), max(0, int((states != trap).sum()) - 1))  # whole bytes before the one that ends in the trap
    at = states[:n] + data[:n]
    found = symbols[at][np.arange(symbols.shape[1]) < counts[at][:, None]][:total]  # bits behind the image may look like pixels
    code = code_of(lengths)
    bits.at += int(code.lengths[found].sum())
    more = []
    while len(found) + len(more) < total:  # what that byte still holds
        before = bits.at
        symbol = code.read(bits)
        if symbol > 255:
            bits.at = before
            break
        more.append(symbol)
    return np.append(found, np.array(more, np.uint8)).astype(np.uint32) << np.uint32(8) | np.uint32(rest)


def planes(pixels: np.ndarray, width: int) -> np.ndarray:
    """Rows of (blue, green, red, alpha) bytes."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(-1, width, 4)


def _blocks(image: np.ndarray, size: int, height: int, width: int) -> np.ndarray:
    """A value of each block of 2 ** size pixels, spread over its pixels."""
    return image.repeat(1 << size, 0).repeat(1 << size, 1)[:height, :width]


def undo_cross_colour(image: np.ndarray, data: np.ndarray, size: int) -> None:
    height, width, _ = image.shape
    signed = lambda x: x.astype(np.int8).astype(np.int32)
    by = _blocks(data, size, height, width)
    green = signed(image[..., 1])
    image[..., 2] += (signed(by[..., 0]) * green >> 5).astype(np.uint8)
    image[..., 0] += (signed(by[..., 1]) * green >> 5).astype(np.uint8)
    image[..., 0] += (signed(by[..., 2]) * signed(image[..., 2]) >> 5).astype(np.uint8)


def undo_palette(image: np.ndarray, palette: np.ndarray, width: int, packed: int) -> np.ndarray:
    """packed: 2 ** packed indexes share a pixel's green."""
    index = image[..., 1]
    if packed:
        each = 8 >> packed
        index = (index[..., None] >> (np.arange(1 << packed) * each).astype(np.uint8) & np.uint8((1 << each) - 1)).reshape(len(image), -1)[:, :width]
    colours = np.zeros((256, 4), np.uint8)  # an index behind the palette is transparent black
    colours[: len(palette)] = palette
    return colours[index]


def predicted(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The format's predictors, from the pixels beside, above, above left and above right."""
    mean = lambda a, b: a + b >> 1
    if mode == 11:
        to_left, to_top = np.abs(top - corner).sum(), np.abs(left - corner).sum()
        return left if to_left < to_top else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        half = mean(left, top)
        gap = half - corner
        return np.clip(half + (np.abs(gap) >> 1) * np.sign(gap), 0, 255)
    simple = {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: mean(mean(left, right), top), 6: lambda: mean(left, corner),
        7: lambda: mean(left, top), 8: lambda: mean(corner, top), 9: lambda: mean(top, right), 10: lambda: mean(mean(left, corner), mean(top, right)),
    }
    return simple[mode]() if mode in simple else np.array([0, 0, 0, 255])


def undo_predictor(image: np.ndarray, data: np.ndarray, size: int) -> None:
    height, width, _ = image.shape
    modes = _blocks(data[..., 1] & 15, size, height, width)
    wide = image.astype(np.int32)
    wide[0, 0, 3] += 255
    wide[0] = np.cumsum(wide[0], axis=0) & 255
    for y in range(1, height):
        above = wide[y - 1]
        wide[y, 0] = wide[y, 0] + above[0] & 255
        row = modes[y]
        alone = np.isin(row, (2, 3, 4, 8, 9))  # no need of the pixel beside
        alone[[0, -1]] = False
        for mode in np.unique(row[alone]):
            x = np.flatnonzero(alone & (row == mode))
            wide[y, x] = wide[y, x] + predicted(mode, None, above[x], above[x - 1], above[x + 1]) & 255
        for x in np.flatnonzero(~alone)[1:] if width > 1 else ():
            right = above[x + 1] if x + 1 < width else wide[y, 0]
            wide[y, x] = wide[y, x] + predicted(row[x], wide[y, x - 1], above[x], above[x - 1], right) & 255
    image[:] = wide


#: Transforms and codes of streams that begin with the same bits, if these do not depend on the image's size.
_openings: list[tuple[int, bytes, list, tuple]] = []


def _opening(bits: Bits, width: int, height: int) -> tuple[list, int, tuple | None]:
    """Transforms in order, the coded width, and (cache bits, groups) if known."""
    start = bits.at
    for n, head, transforms, known in _openings:
        if bits.data[start >> 3 : (start >> 3) + len(head)][:-1] == head[:-1] and Bits(bits.data, start + 8 * (len(head) - 1)).read(n % 8) == head[-1]:
            bits.at = start + n
            return transforms, width, known
    transforms, coded, fixed = [], width, True
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            across, down = -(-coded >> size), -(-height >> size)
            transforms.append((kind, planes(read_image(bits, across, down), across), size))
            fixed = False
        elif kind == PALETTE:
            n = bits.read(8) + 1
            palette = np.cumsum(planes(read_image(bits, n, 1), n)[0], axis=0, dtype=np.uint8)
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, palette, coded, packed))
            coded = -(-coded >> packed)
            fixed &= not packed
        else:
            transforms.append((kind,))
    before = Bits(bits.data, bits.at)
    if not fixed or before.read(1) or before.read(1) or start & 7:
        return transforms, coded, None
    known = (0, [read_group(before, 0)])
    n = before.at - start
    head = bits.data[start >> 3 : (start + n) >> 3] + bytes([Bits(bits.data, start + n // 8 * 8).read(n % 8)])
    if len(_openings) < 8:
        _openings.append((n, head, transforms, known))
    bits.at = before.at
    return transforms, coded, known


def decode(file: bytes) -> np.ndarray:
    """One lossless WebP file -> rows of (blue, green, red, alpha)."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L" or file[20] != SIGNATURE:
        raise ValueError("not a lossless WebP file")
    bits = Bits(file[20 : 20 + int.from_bytes(file[16:20], "little")], 8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.at = 40
    transforms, coded, known = _opening(bits, width, height)
    image = planes(read_image(bits, coded, height, True, known), coded)
    for kind, *by in reversed(transforms):
        if kind == PREDICTOR:
            undo_predictor(image, *by)
        elif kind == CROSS_COLOUR:
            undo_cross_colour(image, *by)
        elif kind == SUBTRACT_GREEN:
            image[..., 0] += image[..., 1]
            image[..., 2] += image[..., 1]
        else:
            image = undo_palette(image, by[0], width if known else by[1], by[2])
    return image


def huffman(weights: list[float]) -> tuple[int, ...]:
    """Lengths of a prefix code; the weights must not need more than LONGEST_CODE bits."""
    heap = [(w, i, (i,)) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    lengths = [0] * len(weights)
    while len(heap) > 1:
        a, i, x = heapq.heappop(heap)
        b, _, y = heapq.heappop(heap)
        for symbol in x + y:
            lengths[symbol] += 1
        heapq.heappush(heap, (a + b, i, x + y))
    return tuple(lengths)


class Writer:
    def __init__(self):
        self.value, self.at = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n

    def code(self, lengths: tuple[int, ...]) -> None:
        """A prefix code: two symbols of one bit at most, or the list of all lengths, four bits each."""
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) < 3 and max(used) < 256:
            self.put(1 | len(used) - 1 << 1 | 1 << 2, 3)
            for symbol in used:
                self.put(symbol, 8)
            return
        self.put(0 | 15 << 1, 5)
        for symbol in CODE_LENGTH_ORDER:
            self.put(4 if symbol < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.put(int(f"{n:04b}"[::-1], 2), 4)


def _one(symbol: int, n: int, *more: int) -> tuple[int, ...]:
    return tuple(1 if s == symbol or s in more else 0 for s in range(n))


@lru_cache(maxsize=1)
def _grey() -> tuple[int, int, np.ndarray, np.ndarray]:
    """What all of the encoder's images share: the bits before the pixels and their number, and the code."""
    rank = {byte: i for i, byte in enumerate(FREQUENT)}
    lengths = huffman([1 / (2 + i) ** 1.15 if (i := rank.get(s)) is not None else 1 / 3000 for s in range(256)] + [1 / 3000] * LENGTHS)
    w = Writer()
    w.put(1 | PALETTE << 1 | 255 << 3, 11)
    w.put(0, 1)
    ramp = [0] * (256 + LENGTHS)  # black, one step, and that step 254 times more
    ramp[0] = ramp[1] = 2
    ramp[256 + 15] = 1
    w.code(tuple(ramp))
    for lengths_ in (_one(0, 256, 1), _one(0, 256, 1), _one(255, 256, 0), _one(1, DISTANCES)):
        w.code(lengths_)
    code = {s: (bits, n) for s, n, bits in canonical(tuple(ramp))}
    w.put(*code[0])
    w.put(0, 2)
    w.put(1, 1)  # red 0, blue 0, alpha 255
    w.put(*code[1])
    w.put(3, 2)
    w.put(0, 1)  # one each, alpha 0
    w.put(*code[256 + 15])
    w.put(254 - 193, 6)
    w.put(0, 3)  # no more transforms, no cache, one group
    for lengths_ in (lengths, _one(0, 256), _one(0, 256), _one(255, 256), _one(1, DISTANCES)):
        w.code(lengths_)
    codes = canonical(lengths)
    table = np.zeros((2, 256 + LENGTHS), np.uint64)
    for symbol, n, value in codes:
        table[:, symbol] = value, n
    return w.value, w.at, table[0], table[1]


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a length."""
    if value < 5:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    extra = top - 1
    return 2 * top + (v >> extra & 1), v & (1 << extra) - 1, extra


def encode_grey(samples: np.ndarray, width: int = ROW) -> bytes:
    """Rows of samples -> a lossless WebP file: a grey palette, and a back-reference for a run of 255 at the end."""
    head, n_head, value, length = _grey()
    other = np.flatnonzero(samples[-4096:] != 255)
    run = min(len(samples), 4096) - (int(other[-1]) + 1 if len(other) else 0)
    symbols = samples[: len(samples) - max(0, run - 1)]
    codes, sizes = value[symbols], length[symbols]
    if run > 1:
        symbol, extra, n = _prefix(run - 1)
        codes, sizes = np.append(codes, value[256 + symbol] | np.uint64(extra) << length[256 + symbol]), np.append(sizes, length[256 + symbol] + np.uint64(n))
    height = len(samples) // width
    front = SIGNATURE | width - 1 << 8 | height - 1 << 22 | head << 40
    ends = np.cumsum(sizes) + np.uint64(40 + n_head)
    total = int(ends[-1])
    at = ends - sizes
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    words = np.frombuffer(front.to_bytes((total + 127) // 64 * 8, "little"), np.uint64).copy()
    new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words[word[new]] |= np.bitwise_or.reduceat(codes << shift, new)
    over = np.flatnonzero(shift + sizes > 64)
    words[word[over] + 1] |= codes[over] >> (np.uint64(64) - shift[over])
    data = words.tobytes()[: (total + 7) // 8]
    padded = data + b"\0" * (len(data) % 2)
    return b"RIFF" + (len(padded) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + padded

"""Grey images as baseline JPEG files: cosine transforms of 8 x 8 blocks, quantised, with prefix codes; all blocks at once."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the format's recommendation: quantisation of brightness at quality 50, and how many codes have 1 to 16 bits.
QUANTA = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99],
])
LEVEL_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
CHANGE_BITS = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125)

#: Places of a block along its diagonals, there and back.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
LEVELS = list(range(12))
#: End of block, sixteen zeros, and runs of zeros before a value of some bits; the likelier ones (short, small) first.
CHANGES = sorted([0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))], key=lambda s: (0.5 if s == 0 else 9 if s == 0xF0 else (s & 15) + 0.9 * (s >> 4), s))
COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
END, ZEROS = 0x00, 0xF0


def _codes(counts: tuple[int, ...], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol: its code and the code's bits, in rising order of bits."""
    codes, lengths, code, at = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for bits, count in enumerate(counts, 1):
        for symbol in symbols[at : at + count]:
            codes[symbol], lengths[symbol] = code, bits
            code += 1
        at, code = at + count, code << 1
    return codes, lengths


def _sizes(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(x) + 1)).astype(np.int64)


def _bits(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Values in so many bits; negative ones less one, without their sign."""
    return np.where(x < 0, x + (1 << sizes) - 1, x)


def quantised(grey: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Blocks, in rows, of 64 whole numbers along the diagonals."""
    high, wide = -(-grey.shape[0] // 8), -(-grey.shape[1] // 8)
    full = np.pad(grey, ((0, high * 8 - grey.shape[0]), (0, wide * 8 - grey.shape[1])), "edge").astype(float) - 128
    blocks = full.reshape(high, 8, wide, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    return np.rint(COSINES @ blocks @ COSINES.T / table).astype(np.int64).reshape(-1, 64)[:, ZIGZAG]


def _coded(blocks: np.ndarray) -> bytes:
    first = np.diff(blocks[:, 0], prepend=0)
    code, length = _codes(LEVEL_BITS, LEVELS)
    size = _sizes(first)
    number = np.arange(len(blocks))
    events = [(number * 128, code[size] << size | _bits(first, size), length[size] + size)]
    code, length = _codes(CHANGE_BITS, CHANGES)
    rows, at = np.nonzero(blocks[:, 1:])
    value = blocks[rows, at + 1]
    before = np.where(np.diff(rows, prepend=-1) != 0, -1, np.concatenate(([-1], at[:-1]))) if len(rows) else at
    zeros, size = at - before - 1, _sizes(value)
    symbol = (zeros % 16) << 4 | size
    events.append((rows * 128 + 2 * (at + 1) + 1, code[symbol] << size | _bits(value, size), length[symbol] + size))
    long = np.repeat(rows * 128 + 2 * (at + 1), zeros // 16)
    events.append((long, np.full(len(long), code[ZEROS]), np.full(len(long), length[ZEROS])))
    open_ = number[blocks[:, 63] == 0]
    events.append((open_ * 128 + 127, np.full(len(open_), code[END]), np.full(len(open_), length[END])))
    place, value, bits = (np.concatenate(x) for x in zip(*events))
    order = np.argsort(place, kind="stable")
    value, bits = value[order], bits[order]
    ends = np.cumsum(bits)
    within = np.arange(ends[-1]) - np.repeat(ends - bits, bits)
    stream = (np.repeat(value, bits) >> (np.repeat(bits, bits) - 1 - within)) & 1
    stream = np.concatenate((stream, np.ones(-len(stream) % 8, np.int64)))
    return np.packbits(stream.astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def encode(grey: np.ndarray, quality: int = 95) -> bytes:
    """A grey image (rows of bytes) as a file; quality from 1 to 100."""
    if grey.ndim != 2 or not grey.size or max(grey.shape) > 65_535:
        raise ValueError(f"no image of {' x '.join(map(str, grey.shape))} pixels")
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    table = np.clip(np.floor((QUANTA * scale + 50) / 100), 1, 255)
    part = lambda kind, data: struct.pack(">BBH", 0xFF, kind, len(data) + 2) + data
    codes = lambda kind, counts, symbols: part(0xC4, bytes([kind, *counts, *symbols]))
    head = b"\xff\xd8" + part(0xE0, b"JFIF\0" + struct.pack(">BBBHHBB", 1, 1, 0, 1, 1, 0, 0)) + part(0xDB, b"\0" + table.ravel()[ZIGZAG].astype(np.uint8).tobytes())
    head += part(0xC0, struct.pack(">BHHBBBB", 8, *grey.shape, 1, 1, 0x11, 0)) + codes(0x00, LEVEL_BITS, LEVELS) + codes(0x10, CHANGE_BITS, CHANGES) + part(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return head + _coded(quantised(grey, table)) + b"\xff\xd9"

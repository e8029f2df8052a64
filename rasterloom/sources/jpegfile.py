"""Baseline JPEG files: colour transform, DCT and Huffman coding in numpy.

Samples are not subsampled. The Huffman codes are made from the image's own symbols, so a file holds one
table for DC sizes and one for AC runs, which all components share."""
from __future__ import annotations

import heapq
import struct
from itertools import count

import numpy as np

# Quantization tables of quality 50, row by row.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
#: Places of an 8 x 8 block along its diagonals, in turns upwards and downwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_K, _N = np.arange(8)[:, None], np.arange(8)[None]
_DCT = np.where(_K == 0, np.sqrt(0.125), 0.5 * np.cos((2 * _N + 1) * _K * np.pi / 16))
_EVENTS = 1 << 18  # codes that are turned into bits at a time


def quantization(quality: int, table: tuple[int, ...]) -> np.ndarray:
    quality = min(max(quality, 1), 100)
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255)


def code_lengths(counts: dict[int, int]) -> list[tuple[int, int]]:
    """(symbol, length) of a prefix code of at most 16 bits in which no code is all ones, short codes first."""
    order = count()
    heap = [(n, next(order), [s]) for s, n in counts.items()] + [(0, next(order), [-1])]  # -1 takes the last code
    depth = dict.fromkeys([*counts, -1], 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*x, *y):
            depth[s] += 1
        heapq.heappush(heap, (a + b, next(order), x + y))
    number = [0] * (max(depth.values()) + 1)
    for d in depth.values():
        number[d] += 1
    for d in range(len(number) - 1, 16, -1):  # two codes that are too long move up: one to their parent, one beside a shorter code
        while number[d]:
            k = max(i for i in range(1, d - 1) if number[i])
            for i, n in ((d, -2), (d - 1, 1), (k + 1, 2), (k, -1)):
                number[i] += n
    lengths = [d for d, n in enumerate(number) for _ in range(n)]
    return list(zip(sorted(counts, key=lambda s: (-counts[s], s)), lengths))


def _segment(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def _sizes(v: np.ndarray) -> np.ndarray:
    """Bits of the absolute values."""
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantized coefficients (block, 64) in zigzag order, blocks row by row."""
    h, w = plane.shape
    plane = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128.0
    b = plane.reshape(plane.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    return np.rint((_DCT @ b @ _DCT.T).reshape(-1, 64) / table).astype(np.int64)[:, ZIGZAG]


def encode_jpeg(a: np.ndarray, quality: int = 100) -> bytes:
    """(height, width, 1 or 3) uint8, colour in RGB order."""
    h, w, c = a.shape
    f = a.astype(np.float64)
    if c == 3:
        r, g, b = f[:, :, 0], f[:, :, 1], f[:, :, 2]
        planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    else:
        planes = [f[:, :, 0]]
    tables = [quantization(quality, t) for t in (LUMINANCE, CHROMINANCE)]
    parts = [_blocks(np.clip(np.rint(p), 0, 255), tables[min(k, 1)]) for k, p in enumerate(planes)]
    for p in parts:
        p[1:, 0] = np.diff(p[:, 0])
    coded = np.stack(parts, axis=1).reshape(-1, 64)  # the components of a unit one after the other
    block, at = np.nonzero(coded[:, 1:])
    at += 1
    value = coded[block, at]
    first = np.concatenate([[True], block[1:] != block[:-1]])[: len(block)]
    gap = at - np.where(first, 0, np.concatenate([[0], at[:-1]])[: len(at)]) - 1
    skips = gap >> 4
    last = np.zeros(len(coded), np.int64)
    last[block] = at  # the assignments run forward, so the last one stays
    ends = np.flatnonzero(last < 63)
    skip_block, skip_at = np.repeat(block, skips), np.repeat(at, skips)
    n, none = len(coded), np.zeros
    # Events: sizes of DC, runs of 16 zeros, runs and sizes of AC, ends of blocks.
    place = np.concatenate([np.arange(n) * 256, skip_block * 256 + skip_at * 2, block * 256 + at * 2 + 1, ends * 256 + 255])
    symbol = np.concatenate([_sizes(coded[:, 0]), np.full(len(skip_block), 0xF0), (gap & 15) << 4 | _sizes(value), none(len(ends), np.int64)])
    amount = np.concatenate([coded[:, 0], none(len(skip_block), np.int64), value, none(len(ends), np.int64)])
    table = np.concatenate([none(n, np.int64), np.ones(len(place) - n, np.int64)])
    order = np.argsort(place, kind="stable")
    symbol, amount, table = symbol[order], amount[order], table[order]
    codes, sizes, specs = np.zeros((2, 256), np.int64), np.zeros((2, 256), np.int64), []
    for k in range(2):
        met, times = np.unique(symbol[table == k], return_counts=True)
        lengths = code_lengths(dict(zip(met.tolist(), times.tolist())))
        code, before = 0, 0
        for s, d in lengths:
            code <<= d - before
            codes[k, s], sizes[k, s], before = code, d, d
            code += 1
        specs.append(bytes([k << 4]) + bytes(sum(d == i for _, d in lengths) for i in range(1, 17)) + bytes(s for s, _ in lengths))
    extra = symbol & 15
    bits = codes[table, symbol] << extra | np.where(amount < 0, amount + (1 << extra) - 1, amount)
    width = sizes[table, symbol] + extra
    out = []
    for i in range(0, len(bits), _EVENTS):
        v, k = bits[i : i + _EVENTS], width[i : i + _EVENTS]
        own = np.repeat(np.arange(len(k)), k)
        within = np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k)
        out.append((v[own] >> (k[own] - 1 - within) & 1).astype(np.uint8))
    stream = np.concatenate(out)
    scan = np.packbits(np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")
    frame = struct.pack(">BHHB", 8, h, w, c) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(c))
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")
    head += b"".join(_segment(0xDB, bytes([k]) + bytes(tables[k][ZIGZAG].tolist())) for k in range(min(c, 2)))
    head += _segment(0xC0, frame) + b"".join(_segment(0xC4, s) for s in specs)
    return head + _segment(0xDA, bytes([c]) + b"".join(bytes([k + 1, 0]) for k in range(c)) + bytes([0, 63, 0])) + scan + b"\xff\xd9"

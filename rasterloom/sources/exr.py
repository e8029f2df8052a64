"""OpenEXR scan-line files: half, float and unsigned samples, uncompressed or ZIP (one line or 16)."""
from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = 20000630
KINDS = {0: "<u4", 1: "<f2", 2: "<f4"}
LINES = {0: 1, 2: 1, 3: 16}  # by compression: none, ZIP of one line, ZIP of 16


def _attribute(name: str, kind: str, value: bytes) -> bytes:
    return name.encode() + b"\x00" + kind.encode() + b"\x00" + struct.pack("<i", len(value)) + value


def _pack(raw: bytes) -> bytes:
    """Bytes at even, then at odd places, as differences, deflated; as they are if that is no gain."""
    a = np.frombuffer(raw, np.uint8)
    b = np.concatenate([a[::2], a[1::2]]).astype(np.int16)
    b[1:] = np.diff(b) + 128
    out = zlib.compress((b & 255).astype(np.uint8).tobytes())
    return out if len(out) < len(raw) else raw


def _unpack(data: bytes, size: int) -> bytes:
    if len(data) == size:
        return data
    d = np.frombuffer(zlib.decompress(data), np.uint8).astype(np.int64)
    d[1:] -= 128
    b = (np.cumsum(d) & 255).astype(np.uint8)
    out = np.empty(size, np.uint8)
    half = (size + 1) // 2
    out[::2], out[1::2] = b[:half], b[half:]
    return out.tobytes()


def encode_exr(a: np.ndarray, kind: int = 1, compression: int = 3) -> bytes:
    """(height, width, 3) RGB order."""
    h, w, _ = a.shape
    box = struct.pack("<4i", 0, 0, w - 1, h - 1)
    names = b"".join(n + b"\x00" + struct.pack("<iB3xii", kind, 0, 1, 1) for n in (b"B", b"G", b"R")) + b"\x00"
    head = struct.pack("<ii", MAGIC, 2) + _attribute("channels", "chlist", names) + _attribute("compression", "compression", bytes([compression]))
    head += _attribute("dataWindow", "box2i", box) + _attribute("displayWindow", "box2i", box) + _attribute("lineOrder", "lineOrder", b"\x00")
    head += _attribute("pixelAspectRatio", "float", struct.pack("<f", 1)) + _attribute("screenWindowCenter", "v2f", struct.pack("<2f", 0, 0)) + _attribute("screenWindowWidth", "float", struct.pack("<f", 1)) + b"\x00"
    rows = a[:, :, ::-1].astype(KINDS[kind]).transpose(0, 2, 1)  # line, channel in order of names, pixel
    step, chunks = LINES[compression], []
    for y in range(0, h, step):
        raw = np.ascontiguousarray(rows[y : y + step]).tobytes()
        body = _pack(raw) if compression else raw
        chunks.append(struct.pack("<ii", y, len(body)) + body)
    at = len(head) + 8 * len(chunks)
    offsets = np.cumsum([at, *map(len, chunks)])[:-1].astype("<u8").tobytes()
    return head + offsets + b"".join(chunks)


def decode_exr(data: bytes) -> np.ndarray:
    """(height, width, 3) RGB order, float16 if the channels are half, else float32."""
    magic, version = struct.unpack_from("<ii", data)
    if magic != MAGIC or version & 0x1A00:
        raise ValueError("no single scan-line EXR")
    at, head = 8, {}
    while data[at]:
        name, _, rest = data[at : at + 512].partition(b"\x00")
        kind, _, _ = rest.partition(b"\x00")
        at += len(name) + len(kind) + 2
        (n,) = struct.unpack_from("<i", data, at)
        head[name] = data[at + 4 : at + 4 + n]
        at += 4 + n
    at += 1
    compression = head[b"compression"][0]
    if compression not in LINES:
        raise ValueError(f"EXR compression {compression} is not supported")
    channels, place, spec = [], 0, head[b"channels"]
    while spec[place]:
        name, _, _ = spec[place:].partition(b"\x00")
        kind, _, sx, sy = struct.unpack_from("<iB3xii", spec, place + len(name) + 1)
        if (sx, sy) != (1, 1):
            raise ValueError("subsampled channels are not supported")
        channels.append((name, np.dtype(KINDS[kind])))
        place += len(name) + 17
    x0, y0, x1, y1 = struct.unpack("<4i", head[b"dataWindow"])
    w, h, line = x1 - x0 + 1, y1 - y0 + 1, sum(k.itemsize for _, k in channels) * (x1 - x0 + 1)
    planes = {n: np.zeros((h, w), k) for n, k in channels}
    step = LINES[compression]
    for k in range(-(-h // step)):
        (offset,) = struct.unpack_from("<Q", data, at + 8 * k)
        y, size = struct.unpack_from("<ii", data, offset)
        rows = min(step, h - (y - y0))
        body = data[offset + 8 : offset + 8 + size]
        raw, place = _unpack(body, rows * line) if compression else body, 0
        for r in range(rows):
            for n, kind in channels:
                planes[n][y - y0 + r] = np.frombuffer(raw, kind, w, place)
                place += w * kind.itemsize
    if not {b"R", b"G", b"B"} <= planes.keys():
        raise ValueError("no R, G and B channels")
    out = np.stack([planes[n] for n in (b"R", b"G", b"B")], axis=2)
    return out if out.dtype == np.float16 else out.astype(np.float32)

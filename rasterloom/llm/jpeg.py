"""Baseline JPEG media columns: marker parsing, Huffman decoding, DC-only luminance thumbnails.

``payload_to_jpeg`` stores bytes losslessly as quantized DCT coefficients of a colour JPEG whose
quantization is 1: every coefficient is one of the 256 values of amplitude category 8 (-255..-128,
128..255), whose eight extra bits are the stored byte. A unit (MCU) holds 192 bytes, one block for
each of Y, Cb and Cr in zigzag order, and is its own restart interval, so DC values are not
predicted across units. Units are laid out in a near-square grid; units past the payload are empty.
A comment marker carries the number of bytes.

``decode`` reads any baseline file (SOF0, interleaved scan): it parses the markers, removes byte
stuffing, and decodes the restart intervals of many files in step, one numpy lane each.

Defined results: null text is an empty text (one unit of spaces); equal texts give equal files and
features; a file that is not baseline JPEG raises ``ValueError``; other columns are not touched."""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNIT = 192
CHUNK = 1 << 14  # units that are coded at a time
#: Codes '0' and '10': DC category 8 and 0; AC run 0 category 8 and end of block.
_DHT = bytes([0x00, 1, 1, *[0] * 14, 8, 0]) + bytes([0x10, 1, 1, *[0] * 14, 8, 0])
_EMPTY = bytes([0b10101010, 0b10101111])


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def payloads_to_jpegs(payloads: list[bytes], sizes: list[int]) -> list[bytes]:
    """One file for each payload (a positive multiple of 192 bytes) of originally ``sizes`` bytes."""
    units = np.array([len(p) // UNIT for p in payloads])
    ends = np.cumsum(units)
    index = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - units, units)
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    parts, lengths = [], []
    for a in range(0, len(data), CHUNK):
        block = data[a : a + CHUNK]
        bits = np.zeros((len(block), UNIT, 9), np.uint8)
        bits[:, :, 1:] = np.unpackbits(block.reshape(-1, UNIT, 1), axis=2)
        coded = np.empty((len(block), 218), np.uint8)
        coded[:, :216] = np.packbits(bits.reshape(len(block), -1), axis=1)
        coded[:, 216] = 0xFF
        coded[:, 217] = 0xD0 + index[a : a + CHUNK] % 8
        stuffed = coded == 0xFF
        stuffed[:, 216] = False
        flat = stuffed.ravel()
        out = np.repeat(coded.ravel(), 1 + flat)
        out[np.cumsum(1 + flat)[flat] - 1] = 0
        parts.append(out.tobytes())
        lengths.append(218 + stuffed.sum(axis=1))
    scan = b"".join(parts)
    at = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]) if lengths else np.zeros(1, np.int64)
    files = []
    for n, end, size in zip(units.tolist(), ends.tolist(), sizes):
        cols = max(1, int(np.ceil(np.sqrt(n))))
        rows = -(-n // cols)
        if max(rows, cols) > 8191:
            raise ValueError("payload is too large for one JPEG")
        body = scan[at[end - n] : at[end]]
        rest = rows * cols - n
        body += b"".join(_EMPTY + bytes([0xFF, 0xD0 + k % 8]) for k in range(n, n + rest))
        frame = struct.pack(">BHHB", 8, rows * 8, cols * 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
        head = b"\xff\xd8" + _marker(0xFE, b"bytes=%d units=%d" % (size, n)) + _marker(0xDB, bytes([0] + [1] * 64)) + _marker(0xC0, frame) + _marker(0xC4, _DHT)
        head += _marker(0xDD, struct.pack(">H", 1)) + _marker(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
        files.append(head + body[:-2] + b"\xff\xd9")
    return files


class Header:
    """Markers of a baseline JPEG up to its scan."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        self.comment, self.interval, self.quant, self.huff, self.frame, at = b"", 0, {}, {}, None, 2
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("broken marker")
            code = data[at + 1]
            if code == 0xFF:
                at += 1
                continue
            (n,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if code == 0xFE:
                self.comment = body
            elif code == 0xDB:
                while body:
                    wide, k = body[0] >> 4, body[0] & 15
                    self.quant[k] = struct.unpack_from(">64H", body, 1) if wide else tuple(body[1:65])
                    body = body[129 if wide else 65 :]
            elif code == 0xC0:
                depth, self.height, self.width, c = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise ValueError("only 8-bit samples")
                self.frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(c)]
            elif code == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huff[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif code == 0xDD:
                (self.interval,) = struct.unpack(">H", body)
            elif code == 0xDA:
                if self.frame is None or body[0] != len(self.frame):
                    raise ValueError("only one interleaved baseline scan")
                tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                self.parts = [(h, v, q, tables[c] >> 4, 16 | tables[c] & 15) for c, h, v, q in self.frame]
                break
            elif 0xC1 <= code <= 0xCF and code not in (0xC8, 0xCC):
                raise ValueError("not baseline")
        self.scan = at
        if len(self.parts) == 1:
            self.parts = [(1, 1, *self.parts[0][2:])]
        self.hmax, self.vmax = max(p[0] for p in self.parts), max(p[1] for p in self.parts)
        self.cols, self.rows = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        self.units = self.cols * self.rows
        self.blocks = [k for k, p in enumerate(self.parts) for _ in range(p[0] * p[1])]
        self.key = (tuple(sorted(self.huff.items())), tuple(self.parts), self.interval)


def _table(spec: bytes) -> np.ndarray:
    """For every 16 bits ahead: code length << 8 | symbol; 0 where no code fits."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(spec[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lanes(window: np.ndarray, start: np.ndarray, units: np.ndarray, h: Header) -> np.ndarray:
    """Coefficients (lane, unit, block, 64), zigzag order, DC values as coded plus prediction, of
    restart intervals that start at the given bits. ``window`` has eight bytes from each byte on."""
    tables = {k: _table(v) for k, v in h.huff.items()}
    most = int(units.max())
    out = np.zeros((len(start), most, len(h.blocks), 64), np.int16)
    pos, dc = start.copy(), np.zeros((len(start), len(h.parts)), np.int64)

    def symbol(lanes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next symbols and the amplitudes of their low four bits; moves on."""
        p = pos[lanes]
        ahead = window[p >> 3] << (p & 7).astype(np.uint64)
        found = table[(ahead >> np.uint64(48)).astype(np.int64)]
        if not found.all():
            raise ValueError("broken Huffman code")
        n, sym = found >> 8, found & 255
        size = sym & 15
        bits = ((ahead << n.astype(np.uint64)) >> np.uint64(48)).astype(np.int64) >> (16 - size)
        pos[lanes] = p + n + size
        return sym, np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)

    for u in range(most):
        here = np.flatnonzero(units > u)
        for b, part in enumerate(h.blocks):
            _, _, _, dc_table, ac_table = h.parts[part]
            _, value = symbol(here, tables[dc_table])
            dc[here, part] += value
            out[here, u, b, 0] = dc[here, part]
            lanes, k = here, np.ones(len(here), np.int64)
            while len(lanes):
                sym, value = symbol(lanes, tables[ac_table])
                k = k + (sym >> 4)
                put = (sym & 15) > 0
                if put.all():
                    out[lanes, u, b, np.minimum(k, 63)] = value
                else:
                    out[lanes[put], u, b, np.minimum(k[put], 63)] = value[put]
                k = np.where(sym == 0, 64, k + 1)
                on = k < 64
                if not on.all():
                    lanes, k = lanes[on], k[on]
    return out


def decode(files: list[bytes]) -> list[tuple[Header, np.ndarray]]:
    """Header and coefficients (unit, block, 64) of each file."""
    headers = [Header(x) for x in files]
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, h in enumerate(headers):
        groups[h.key].append(i)
    out: list[tuple[Header, np.ndarray] | None] = [None] * len(files)
    for members in groups.values():
        h = headers[members[0]]
        scans = [files[i][headers[i].scan :] for i in members]
        raw = np.frombuffer(b"".join(scans) + b"\x00", np.uint8)
        ff, nxt = raw[:-1] == 0xFF, raw[1:]
        restart, stuffed = ff & (nxt >= 0xD0) & (nxt <= 0xD7), ff & (nxt == 0)
        end = np.cumsum([len(s) for s in scans])
        begin = end - [len(s) for s in scans]
        keep = np.ones(len(raw), bool)
        keep[np.flatnonzero(stuffed) + 1] = False
        marks = np.flatnonzero(restart)
        keep[marks] = keep[marks + 1] = False
        to = np.cumsum(keep) - keep
        heads = np.sort(np.concatenate([begin, marks + 2]))
        start = to[heads] * 8
        owner = np.searchsorted(end, heads, side="right")
        nth = np.arange(len(heads)) - np.searchsorted(owner, owner)
        clean = np.concatenate([raw[keep], np.zeros(16, np.uint8)])
        window = np.zeros(len(clean) - 8, np.uint64)
        for k in range(8):
            window |= clean[k : k + len(window)].astype(np.uint64) << np.uint64(56 - 8 * k)
        total = np.array([headers[i].units for i in members])
        per = np.array([h.interval or t for t in total])
        units = np.minimum(per[owner], total[owner] - nth * per[owner])
        if (units <= 0).any() or (np.bincount(owner, units, len(members)) != total).any():
            raise ValueError("restart intervals do not cover the image")
        got: list[list[np.ndarray]] = [[] for _ in members]
        for a in range(0, len(heads), CHUNK):
            c = _lanes(window, start[a : a + CHUNK], units[a : a + CHUNK], h)
            own, n = owner[a : a + CHUNK], units[a : a + CHUNK]
            for m in np.unique(own):
                rows = np.flatnonzero(own == m)
                got[m].append(c[rows].reshape(-1, len(h.blocks), 64) if (n[rows] == c.shape[1]).all() else np.concatenate([c[r, : n[r]] for r in range(rows[0], rows[-1] + 1)]))
        for m, i in enumerate(members):
            out[i] = (headers[i], np.concatenate(got[m]))
    return out


def thumbnail(h: Header, coefficients: np.ndarray) -> np.ndarray:
    """Luminance of each 8x8 block from its DC coefficient."""
    ph, pv, q, _, _ = h.parts[0]
    dc = coefficients[:, : ph * pv, 0].astype(np.int64) * h.quant[q][0]
    grid = dc.reshape(h.rows, h.cols, pv, ph).transpose(0, 2, 1, 3).reshape(h.rows * pv, h.cols * ph)
    return np.clip((grid + 1028) // 8, 0, 255).astype(np.uint8)


def feature(h: Header, coefficients: np.ndarray) -> str:
    """Width x height, a 64-bit average hash of the thumbnail and its crc32."""
    t = thumbnail(h, coefficients)
    small = t[np.arange(8) * t.shape[0] // 8][:, np.arange(8) * t.shape[1] // 8]
    bits = np.packbits(small > small.mean()).tobytes().hex()
    return f"{h.width}x{h.height}:{bits}:{zlib.crc32(t.tobytes()):08x}"


def stored_payload(h: Header, coefficients: np.ndarray) -> tuple[bytes, int]:
    """The bytes that ``payloads_to_jpegs`` stored, and their number before padding."""
    said = dict(x.split(b"=") for x in h.comment.split())
    c = coefficients[: int(said[b"units"])].reshape(-1)
    return np.where(c > 0, c, c + 255).astype(np.uint8).tobytes(), int(said[b"bytes"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, media (binary JPEG) of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text", 2 << 20):
            texts = common.texts_of(b)
            padded = [t + b" " * (-len(t) % UNIT or UNIT * (not t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(payloads_to_jpegs(padded, [len(t) for t in texts]), pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def inspect(media: DataFrame) -> DataFrame:
    """Reads the stored files: dimensions, digests of payload and file, and the feature."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("width", pa.int32()), ("height", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "media", 2 << 20):
            rows = []
            files = b.column("media").to_pylist()
            for key, x, (h, c) in zip(b.column("doc_id").to_pylist(), files, decode(files)):
                payload, n = stored_payload(h, c)
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(x), hashlib.sha256(x).hexdigest(), feature(h, c), h.width, h.height))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int")

"""Image files in and out: `spark.read.format("binaryFile")` plus decoders on the executors.

PNG (8 and 16 bit, no interlace), BMP (24 and 32 bit), TIFF (plain, LZW or deflate) and OpenEXR (plain or
ZIP) are read and written, and baseline JPEG written, without imaging libraries; JPEG and others are read
through Spark's ``image`` source (8 bit)."""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.arrays import decode_data, encode_data
from .exr import MAGIC as _EXR
from .exr import decode_exr, encode_exr
from .jpegfile import encode_jpeg

OWN = ("png", "bmp", "tif", "tiff", "exr")
_PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(a: np.ndarray, compression: int = 3) -> bytes:
    """(height, width, 1, 3 or 4) RGB order, uint8 or uint16."""
    h, w, c = a.shape
    depth = 16 if a.dtype.itemsize == 2 else 8
    rows = a.astype(">u2" if depth == 16 else "u1").reshape(h, -1).view(np.uint8).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, depth, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, compression)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) in file order, uint8 or uint16."""
    if data[:8] != _PNG:
        raise ValueError("no PNG")
    at, body, palette, head = 8, b"", None, None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        elif kind == b"IEND":
            break
    w, h, depth, color, _, _, interlace = head
    if interlace or depth not in (8, 16):
        raise ValueError("only whole-byte PNG without interlace")
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    bpp, stride = c * depth // 8, w * c * depth // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    prior = np.zeros(stride, np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 1:
            for k in range(bpp):
                line[k::bpp] = np.cumsum(line[k::bpp], dtype=np.uint8)
        elif kind == 2:
            line += prior
        elif kind in (3, 4):
            cur = line.astype(np.int64)
            up = prior.astype(np.int64)
            for i in range(stride):
                a, b = (cur[i - bpp] if i >= bpp else 0), up[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    d = up[i - bpp] if i >= bpp else 0
                    p = a + b - d
                    pa, pb, pd_ = abs(p - a), abs(p - b), abs(p - d)
                    guess = a if pa <= pb and pa <= pd_ else b if pb <= pd_ else d
                cur[i] = (cur[i] + guess) & 255
            line = cur.astype(np.uint8)
        elif kind:
            raise ValueError("unknown PNG filter")
        out[y] = prior = line
    a = out.reshape(h, w, c) if depth == 8 else out.view(">u2").reshape(h, w, c).astype(np.uint16)
    return palette[a[:, :, 0]] if color == 3 and palette is not None else a


def encode_bmp(a: np.ndarray) -> bytes:
    """(height, width, 3) BGR uint8."""
    h, w, _ = a.shape
    pad = -(w * 3) % 4
    rows = np.concatenate([a[::-1].reshape(h, -1), np.zeros((h, pad), np.uint8)], axis=1).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def decode_bmp(data: bytes) -> np.ndarray:
    """(height, width, 3) BGR uint8."""
    (offset,) = struct.unpack_from("<I", data, 10)
    _, w, h, _, depth, packed = struct.unpack_from("<IiiHHI", data, 14)
    if depth not in (24, 32) or packed:
        raise ValueError("only plain 24- or 32-bit BMP")
    c = depth // 8
    stride = (w * c + 3) // 4 * 4
    a = np.frombuffer(data, np.uint8, stride * abs(h), offset).reshape(abs(h), stride)[:, : w * c].reshape(abs(h), w, c)[:, :, :3]
    return (a[::-1] if h > 0 else a).copy()


def lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from the highest bit, one bit wider one code early, cleared at 4,094."""
    table, bits, word, out, held, n = {bytes([i]): i for i in range(256)}, 9, b"", bytearray(), 256, 9
    fresh = dict(table)

    def put(code: int) -> None:
        nonlocal held, n
        held, n = held << bits | code, n + bits

    for byte in data:
        longer = word + bytes([byte])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table) + 2
        if len(table) + 2 == 4095:
            put(256)
            table, bits = dict(fresh), 9
        elif len(table) + 2 >= (1 << bits):
            bits += 1
        word = bytes([byte])
        while n >= 8:
            n -= 8
            out.append(held >> n)
            held &= (1 << n) - 1
    if word:
        put(table[word])
        if len(table) + 3 >= (1 << bits) and bits < 12:
            bits += 1
    put(257)
    out += (held << -n % 8).to_bytes((n + 7) // 8, "big")
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    table, bits, out, held, n, prior = [], 9, [], 0, 0, None
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < bits:
            continue
        n -= bits
        code, held = held >> n, held & ((1 << n) - 1)
        if code == 257:
            break
        if code == 256:
            table, bits, prior = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if prior is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else prior + prior[:1]
            table.append(prior + word[:1])
        out.append(word)
        prior = word
        if len(table) + 1 >= (1 << bits) and bits < 12:
            bits += 1
    return b"".join(out)


def encode_tiff(a: np.ndarray, compression: int = 5) -> bytes:
    """(height, width, 3) RGB, uint8 or uint16, one strip, little-endian; compression 1 (none), 5 (LZW) or
    8 and 32946 (deflate)."""
    pack = {1: lambda x: x, 5: lzw, 8: zlib.compress, 32946: zlib.compress}
    if compression not in pack:
        raise ValueError(f"TIFF compression {compression} is not supported")
    h, w, c = a.shape
    bits = 8 * a.dtype.itemsize
    body = pack[compression](a.astype(a.dtype.newbyteorder("<")).tobytes())
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, c, None), (259, 3, 1, compression), (262, 3, 1, 2), (273, 4, 1, None), (277, 3, 1, c), (278, 4, 1, h), (279, 4, 1, len(body))]
    extra = 8 + 2 + 12 * len(tags) + 4
    out = b"II*\x00" + struct.pack("<IH", 8, len(tags))
    for tag, kind, n, value in tags:
        value = extra if tag == 258 else extra + 2 * c if tag == 273 else value
        out += struct.pack("<HHII", tag, kind, n, value)
    return out + struct.pack("<I", 0) + struct.pack(f"<{c}H", *[bits] * c) + body


def decode_tiff(data: bytes) -> np.ndarray:
    """(height, width, channels) of a contiguous TIFF in strips."""
    e = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(e + "I", data, 4)
    tags = {}
    for k in range(struct.unpack_from(e + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(e + "HHI", data, at + 2 + 12 * k)
        size = {1: 1, 3: 2, 4: 4}.get(kind, 0) * n
        place = at + 10 + 12 * k
        if size > 4:
            (place,) = struct.unpack_from(e + "I", data, place)
        if size:
            tags[tag] = struct.unpack_from(f"{e}{n}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", data, place)
    unpack = {1: lambda x: x, 5: unlzw, 8: zlib.decompress, 32946: zlib.decompress}.get(tags.get(259, (1,))[0])
    if unpack is None or tags.get(317, (1,))[0] not in (1, 2):
        raise ValueError("this TIFF compression is not supported")
    w, h, c, bits = tags[256][0], tags[257][0], tags.get(277, (1,))[0], tags[258][0]
    body = b"".join(unpack(data[o : o + n]) for o, n in zip(tags[273], tags[279]))
    a = np.frombuffer(body, "u1" if bits == 8 else e + "u2").reshape(h, w, c)
    if tags.get(317, (1,))[0] == 2:  # differences along a line
        a = np.cumsum(a.astype(np.int64), axis=1) & (1 << bits) - 1
    return a.astype(np.uint8 if bits == 8 else np.uint16)


def _bgr(a: np.ndarray) -> np.ndarray:
    """Gray is stacked, alpha dropped, RGB order turned."""
    a = a if a.shape[2] != 2 else a[:, :, :1]
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """(height, width, 3) BGR; raises ``RuntimeError`` for what cannot be decoded."""
    try:
        if data[:8] == _PNG:
            return np.ascontiguousarray(_bgr(decode_png(data)))
        if data[:2] == b"BM":
            return decode_bmp(data)
        if data[:4] in (b"II*\x00", b"MM\x00*"):
            return np.ascontiguousarray(_bgr(decode_tiff(data)))
        if data[:4] == struct.pack("<i", _EXR):
            return np.ascontiguousarray(decode_exr(data)[:, :, ::-1])
    except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
        raise RuntimeError(f"cannot decode image: {e}") from e
    raise RuntimeError("cannot decode image: unknown format")


def imread(spark: SparkSession, path: str, is_rgb: bool = False) -> DataFrame:
    """IMAGE rows of a file or folder, bit depth kept; JPEG and GIF through Spark's own decoder. A
    missing path raises ``FileNotFoundError``. image_id is a hash of the path."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if found is None or not len(found):
        raise FileNotFoundError(path)
    files = spark.read.format("binaryFile").load(path)
    suffix = lambda c: F.lower(F.element_at(F.split(c, r"\."), -1))
    own = suffix("path").isin(*OWN)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                a = decode(r.content)
                if is_rgb:
                    a = a[:, :, ::-1]
                kind = a.dtype.name
                out.append((r.image_id, r.path, a.shape[0], a.shape[1], 3, kind, "rgb" if is_rgb else "bgr", encode_data(a, kind)))
            yield pd.DataFrame(out, columns=S.IMAGE.fieldNames())

    mine = files.where(own).select(F.xxhash64("path").alias("image_id"), "path", "content").mapInPandas(run, S.IMAGE)
    # Names only: the reader takes each other file by its path, so none is opened twice.
    others = [r["path"] for r in files.where(~own).select("path").collect()]
    if not others:
        return mine
    other = spark.read.format("image").option("dropInvalid", "false").load(others).select("image.*")

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                if r.height <= 0:
                    raise RuntimeError(f"cannot decode image: {r.origin}")
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                a = np.repeat(a, 3, axis=2) if r.nChannels == 1 else a[:, :, :3]
                a = a[:, :, ::-1] if is_rgb else a
                out.append((r.image_id, r.origin, r.height, r.width, 3, "uint8", "rgb" if is_rgb else "bgr", encode_data(a, "uint8")))
            yield pd.DataFrame(out, columns=S.IMAGE.fieldNames())

    return mine.unionByName(other.withColumn("image_id", F.xxhash64("origin")).mapInPandas(fix, S.IMAGE))


def encode(data: bytes, height: int, width: int, channels: int, dtype: str, suffix: str, is_rgb: bool = False, param: int = -1) -> bytes:
    """A file of the format of ``suffix``: PNG and TIFF keep 8 bits or take 16, BMP and JPEG take 8, EXR
    takes half floats. ``param`` is the compression of PNG (3), of TIFF (5, LZW) or the quality of JPEG (100)."""
    suffix = suffix.lower().lstrip(".")
    a = decode_data(data, height, width, channels, dtype)
    rgb = a if is_rgb or channels == 1 else a[:, :, 2::-1]
    if suffix in ("png", "tif", "tiff"):
        kind = "uint8" if dtype == "uint8" else "uint16"
        rgb = np.frombuffer(encode_data(np.asarray(rgb, np.float64) if dtype not in ("uint8", "uint16") else rgb, kind), "<u1" if kind == "uint8" else "<u2").reshape(height, width, -1)
        return encode_png(rgb, 3 if param < 0 else param) if suffix == "png" else encode_tiff(np.repeat(rgb, 3, axis=2) if channels == 1 else rgb, 5 if param < 0 else param)
    if suffix == "exr":
        real = a.astype(np.float64) / {"uint8": 255.0, "uint16": 65535.0}.get(dtype, 1.0)
        real = np.repeat(real, 3, axis=2) if channels == 1 else real if is_rgb else real[:, :, 2::-1]
        return encode_exr(real[:, :, :3])
    if suffix in ("bmp", "jpg", "jpeg"):
        unit = decode_data(data, height, width, channels, dtype, unit=True)
        small = a if dtype == "uint8" else np.floor(np.clip(unit * 255.0, 0, 255)).astype(np.uint8)
        if suffix != "bmp":
            return encode_jpeg(small if is_rgb or channels == 1 else small[:, :, 2::-1], 100 if param < 0 else param)
        small = np.repeat(small, 3, axis=2) if channels == 1 else small
        return encode_bmp(small[:, :, ::-1] if is_rgb else small)
    raise ValueError(f"no encoder for .{suffix}")


def imwrite(images: DataFrame, folder: str, suffix: str = "png", param: int = -1) -> DataFrame:
    """Write one file per IMAGE row as ``folder/<image_id>.<suffix>``; returns image_id, path, ok.
    The files are written when the result is computed; a second run writes the same files."""
    from pyarrow import fs as pafs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for rows in batches:
            out = []
            for r in rows.itertuples():
                name = f"{root}/{r.image_id}.{suffix.lower().lstrip('.')}"
                try:
                    body = encode(r.data, r.height, r.width, r.channels, r.dtype, suffix, r.space == "rgb", param)
                    with system.open_output_stream(name) as f:
                        f.write(body)
                    ok = True
                except (OSError, ValueError):
                    ok = False
                out.append((r.image_id, name, ok))
            yield pd.DataFrame(out, columns=["image_id", "path", "ok"])

    return images.mapInPandas(run, "image_id long, path string, ok boolean")


def preview(images: DataFrame, scale: float = 1.0, limit: int = 10) -> DataFrame:
    """What a viewer shows: at most ``limit`` images, scaled bicubically, as BGR uint8."""
    from ..operators.arrays import map_images, resize_array

    def shrink(a: np.ndarray) -> np.ndarray:
        return a if scale == 1.0 else resize_array(a, int(a.shape[1] * scale), int(a.shape[0] * scale), S.CUBIC)

    return map_images(images.limit(limit), shrink, "uint8")

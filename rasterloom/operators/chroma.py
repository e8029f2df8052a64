"""Raw video frames to full-resolution Y, Cb, Cr pixels.

Bytes of a frame are one array; pixels are computed from positions inside the frame's row, so after
an optional gathering of byte rows nothing is shuffled."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .resample import resize


def frames_from_bytes(rows: DataFrame, key: str = "frame_id", pos: str = "p", byte: str = "byte") -> DataFrame:
    """key and ``bytes`` (array of int) from one row a byte."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, byte))), lambda s: s[byte].cast("int")).alias("bytes"))


def frames_from_binary(frames: DataFrame, key: str = "frame_id", data: str = "data") -> DataFrame:
    """The same from a binary column."""
    at = F.sequence(F.lit(1), F.length(data))
    values = F.transform(at, lambda i: F.conv(F.hex(F.substring(F.col(data), i, F.lit(1))), 16, 10).cast("int"))
    return frames.select(key, F.when(F.length(data) > 0, values).otherwise(F.array().cast("array<int>")).alias("bytes"))


def _pixels(frames: DataFrame, key: str, width: int, height: int, cell) -> DataFrame:
    """Rows (key, y, x, c0, c1, c2) of ``cell(get, y, x)``, get(position) being a byte."""
    at = F.sequence(F.lit(0), F.lit(width * height - 1))

    def of(i: Column) -> Column:
        y, x = F.floor(i / width).cast("int"), (i % width).cast("int")
        c = cell(lambda p: F.get(F.col("bytes"), p.cast("int")), y, x)
        return F.struct(y.alias("y"), x.alias("x"), *(v.alias(f"c{k}") for k, v in enumerate(c)))

    return frames.select(key, F.inline(F.transform(at, of)))


def yuv420p_to_ycbcr444(frames: DataFrame, width: int, height: int, interpolation: int = S.LINEAR, key: str = "frame_id") -> DataFrame:
    """Bilinear: chroma at (x/2, y/2) with clamped neighbours, luma as it is. Nearest: chroma at
    (x div 2, y div 2), luma expanded from legal to full range and clamped."""
    if interpolation not in (S.NEAREST, S.LINEAR):
        raise ValueError("nearest or linear")
    w2, h2, u0, v0 = width // 2, height // 2, width * height, width * height + width * height // 4

    def nearest(get, y, x):
        luma = (get(y * width + x) / 255.0 - 64e0 / 1023e0) * (1023e0 / 876e0)
        p = F.floor(y / 2) * w2 + F.floor(x / 2)
        return F.least(F.greatest(luma, F.lit(0.0)), F.lit(1.0)), get(p + u0) / 255.0, get(p + v0) / 255.0

    def linear(get, y, x):
        x0, y0 = F.floor(x / 2), F.floor(y / 2)
        fx, fy = x / 2.0 - x0, y / 2.0 - y0
        x1, y1 = F.least(x0 + 1, F.lit(w2 - 1)), F.least(y0 + 1, F.lit(h2 - 1))

        def plane(base: int) -> Column:
            g = lambda yy, xx: get(yy * w2 + xx + base) / 255.0
            return (g(y0, x0) * (F.lit(1.0) - fx) + g(y0, x1) * fx) * (F.lit(1.0) - fy) + (g(y1, x0) * (F.lit(1.0) - fx) + g(y1, x1) * fx) * fy

        return get(y * width + x) / 255.0, plane(u0), plane(v0)

    return _pixels(frames, key, width, height, nearest if interpolation == S.NEAREST else linear)


def _with_chroma(frames: DataFrame, key: str, width: int, height: int, luma, chroma, cw: int, ch: int, mode: int) -> DataFrame:
    """Luma at full size beside two chroma planes of cw x ch that are resized to it."""
    y = _pixels(frames, key, width, height, lambda get, yy, xx: (luma(get, yy, xx),))
    uv = resize(_pixels(frames, key, cw, ch, chroma), (width, height), interpolation=mode, keys=[key], size=(cw, ch))
    return y.join(uv.withColumnsRenamed({"c0": "u", "c1": "v"}), [key, "y", "x"]).select(key, "y", "x", "c0", F.col("u").alias("c1"), F.col("v").alias("c2"))


def yuv420p_to_ycbcr444_resized(frames: DataFrame, width: int, height: int, interpolation: int = S.LINEAR, key: str = "frame_id") -> DataFrame:
    """Chroma planes brought to size by nearest, linear (corners aligned) or cubic resampling."""
    mode = {0: S.NEAREST, 1: S.LINEAR, 2: S.CUBIC}[interpolation]
    w2, h2, u0, v0 = width // 2, height // 2, width * height, width * height + width * height // 4
    return _with_chroma(frames, key, width, height, lambda get, y, x: get(y * width + x) / 255.0, lambda get, y, x: (get(y * w2 + x + u0) / 255.0, get(y * w2 + x + v0) / 255.0), w2, h2, mode)


def yuv422p10le_to_ycbcr444(frames: DataFrame, width: int, height: int, average: bool = True, key: str = "frame_id") -> DataFrame:
    """10-bit little-endian planes; chroma at x div 2, odd columns averaged with the next sample
    (``average``) or replicated."""
    w2, u0, v0 = width // 2, width * height, width * height + width * height // 2

    def cell(get, y, x):
        ten = lambda p: ((get(p * 2) + get(p * 2 + 1) * 256).bitwiseAND(1023)) / 1023.0
        p = y * w2 + F.floor(x / 2)

        def plane(base: int) -> Column:
            here = ten(p + base)
            if not average:
                return here
            return F.when((x % 2 == 1) & (x < width - 1), (here + ten(p + base + 1)) / 2.0).otherwise(here)

        return ten(y * width + x), plane(u0), plane(v0)

    return _pixels(frames, key, width, height, cell)


def uyvy422_to_ycbcr444(frames: DataFrame, height: int, width: int, key: str = "frame_id") -> DataFrame:
    """Bytes U Y0 V Y1; 8-bit integers out, chroma replicated."""

    def cell(get, y, x):
        p = y * (2 * width) + F.floor(x / 2) * 4
        return get(y * (2 * width) + x * 2 + 1), get(p), get(p + 2)

    return _pixels(frames, key, width, height, cell)


def ndi_uyvy422_to_ycbcr444(frames: DataFrame, height: int, width: int, use_bilinear: bool = True, key: str = "frame_id") -> DataFrame:
    """8-bit integers out. Bilinear: truncated interpolation of neighbouring pairs. Otherwise odd
    columns of the left half take the integer mean with the next pair, the others their own."""
    w2 = width // 2

    def cell(get, y, x):
        row, k = y * (2 * width), F.floor(x / 2)
        if use_bilinear:
            f = x / 2.0 - k
            nxt = F.least(k + 1, F.lit(w2 - 1))
            chroma = [F.floor(get(row + k * 4 + c) * (F.lit(1.0) - f) + get(row + nxt * 4 + c) * f).cast("int") for c in (0, 2)]
        else:
            mean = (x % 2 == 1) & (k * 2 + 1 < w2)
            chroma = [F.when(mean, F.floor((get(row + k * 4 + c) + get(row + k * 4 + 4 + c)) / 2).cast("int")).otherwise(get(row + k * 4 + c)) for c in (0, 2)]
        return get(row + x * 2 + 1), *chroma

    return _pixels(frames, key, width, height, cell)


def ndi_uyvy422_to_ycbcr444_resized(frames: DataFrame, height: int, width: int, key: str = "frame_id") -> DataFrame:
    """Everything in [0, 1]; chroma by cubic resampling."""
    w2 = width // 2
    return _with_chroma(frames, key, width, height, lambda get, y, x: get(y * (2 * width) + x * 2 + 1) / 255.0, lambda get, y, x: (get(y * (2 * width) + x * 4) / 255.0, get(y * (2 * width) + x * 4 + 2) / 255.0), w2, height, S.CUBIC)

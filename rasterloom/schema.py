"""Schemas and constants of the image model.

An image is either one row (``IMAGE``: dimensions, sample type, colour space, row-major bytes) or one
row a pixel (keys, y, x, c0, c1, c2 with samples as doubles). Pixel columns are never null."""
from __future__ import annotations

from pyspark.sql import types as T

# Interpolation modes.
AUTO, NEAREST, LINEAR, CUBIC, AREA, LANCZOS4 = -1, 0, 1, 2, 3, 4
LANCZOS2, LANCZOS3 = 10, 11
MITCHELL, CATMULL_ROM, B_SPLINE = 21, 22, 23
MODES = {"auto": AUTO, "nearest": NEAREST, "linear": LINEAR, "cubic": CUBIC, "area": AREA, "lanczos4": LANCZOS4, "lanczos2": LANCZOS2, "lanczos3": LANCZOS3, "mitchell": MITCHELL, "catmull_rom": CATMULL_ROM, "b_spline": B_SPLINE}

DTYPES = ("uint8", "uint16", "float16", "float32", "float64")
SPACES = ("bgr", "rgb", "hsv", "ycbcr_full", "ycbcr_legal", "gray", "aces2065_1", "acescg", "acescct", "rec709")
PIXEL_FORMATS = ("yuv420p", "yuv422p10le", "uyvy422", "ndi_uyvy422")

IMAGE = T.StructType([
    T.StructField("image_id", T.LongType()), T.StructField("origin", T.StringType()),
    T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("channels", T.IntegerType()),
    T.StructField("dtype", T.StringType()), T.StructField("space", T.StringType()), T.StructField("data", T.BinaryType()),
])
#: Planes of several images of one shape: (n, channels, height, width), row-major.
BATCH = T.StructType([
    T.StructField("image_ids", T.ArrayType(T.LongType())), T.StructField("n", T.IntegerType()), T.StructField("channels", T.IntegerType()),
    T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("dtype", T.StringType()), T.StructField("data", T.BinaryType()),
])
FRAME = T.StructType([
    T.StructField("frame_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("pix_fmt", T.StringType()), T.StructField("data", T.BinaryType()),
])
_BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x1", "y1", "x2", "y2")])
_MATRIX = T.StructType([T.StructField(f"m{i}{j}", T.DoubleType()) for i in range(2) for j in range(3)])
FACE = T.StructType([
    T.StructField("image_id", T.LongType()), T.StructField("face_idx", T.IntegerType()),
    T.StructField("bbox", _BOX), T.StructField("score", T.DoubleType()),
    T.StructField("kps", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))),
    T.StructField("matrix", _MATRIX), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("normed_embedding", T.ArrayType(T.FloatType())), T.StructField("image", IMAGE),
])
LUT = T.StructType([T.StructField(n, T.IntegerType()) for n in ("n", "ri", "gi", "bi")] + [T.StructField(n, T.DoubleType()) for n in "rgb"])


def mode_of(mode: int | str) -> int:
    """Mode number of a name or number; raises ``ValueError`` for others."""
    code = MODES.get(mode, mode) if isinstance(mode, str) else mode
    if code not in MODES.values():
        raise ValueError(f"unknown interpolation {mode!r}")
    return code

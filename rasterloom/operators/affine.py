"""Affine warps, matrix inversion and five-point alignment.

A warp gathers: an output pixel reads up to 64 source pixels. So the pixels of an image come together
once (one exchange by image, or none where they are already), become an array, and numpy gathers by
index; no weight and no product is a row. An image must fit into a worker.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from .pixels import channels
from .warp import warp_array

Matrix = tuple[tuple[float, float, float], tuple[float, float, float]]
# Positions of the five points in a 112-pixel crop.
TEMPLATE = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))


def _rows(m) -> Matrix:
    rows = tuple(tuple(float(v) for v in r) for r in m)
    if len(rows) not in (2, 3) or any(len(r) != 3 for r in rows):
        raise ValueError("an affine matrix has 2 x 3 or 3 x 3 values")
    return rows[:2]


def get_inverse_matrix(m) -> Matrix:
    """Inverse of a 2 x 3 (or 3 x 3) affine matrix."""
    (a, b, c), (d, e, f) = _rows(m)
    det = a * e - b * d
    if det == 0:
        raise ValueError("singular matrix")
    return ((e / det, -b / det, (b * f - c * e) / det), (-d / det, a / det, (c * d - a * f) / det))


def inverse_columns(m: Column) -> Column:
    """The same for a struct column m00..m12."""
    a, b, c, d, e, f = (m[f"m{i}{j}"] for i in range(2) for j in range(3))
    det = a * e - b * d
    parts = (e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det)
    return F.struct(*(v.alias(f"m{i}{j}") for v, (i, j) in zip(parts, [(i, j) for i in range(2) for j in range(3)])))


def matrix_column(m) -> Column:
    rows = _rows(m)
    return F.struct(*(F.lit(rows[i][j]).alias(f"m{i}{j}") for i in range(2) for j in range(3)))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def auto_mode(m) -> int:
    """MITCHELL if the matrix enlarges along an axis, else AREA."""
    (a, b, _), (d, e, _) = _rows(m)
    return S.MITCHELL if math.hypot(a, d) > 1 or math.hypot(b, e) > 1 else S.AREA


def dense(table: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(height, width, channels) of the pixels of one image, and which of them are there."""
    y, x = (table.column(k).to_numpy() for k in ("y", "x"))
    size = (int(y.max()) + 1, int(x.max()) + 1)
    out, there = np.zeros((*size, len(names))), np.zeros(size, bool)
    there[y, x] = True
    for k, c in enumerate(names):
        out[y, x, k] = table.column(c).cast(pa.float64()).to_numpy()
    return out, there


def pixel_table(a: np.ndarray, keys: pa.Table, names: list[str], like: pa.Schema) -> pa.Table:
    """The pixels of one image as rows; ``keys`` holds its key values in the first row."""
    h, w = a.shape[:2]
    y, x = np.divmod(np.arange(h * w), w)
    fixed = [keys.column(k).combine_chunks().take(pa.array(np.zeros(h * w, np.int64))) for k in keys.column_names]
    flat = a.reshape(h * w, -1)
    return pa.Table.from_arrays([*fixed, pa.array(y, pa.int32()), pa.array(x, pa.int32()), *(pa.array(np.ascontiguousarray(flat[:, k])) for k in range(len(names)))], schema=like)


def pixel_schema(px: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([*(px.schema[k] for k in keys), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in channels(px))])


def _mode_for(m: tuple[float, ...], mode: int) -> int:
    return auto_mode((m[:3], m[3:])) if mode == S.AUTO else mode


def _flat(m) -> tuple[float, ...]:
    return tuple(v for r in _rows(m) for v in r)


def affine_transform(px: DataFrame, m, dsize: tuple[int, int], flags: int | str = S.AUTO, keys: list[str] | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """Warp every image by the matrix ``m`` (source to destination) into dsize = (height, width).
    ``size`` = (width, height) of all sources; else an image ends at its last pixel. Positions outside
    are 0; values are neither converted nor clipped."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keys, cs = keys or ["image_id"], channels(px)
    inverse, mode = _flat(get_inverse_matrix(m)), _mode_for(_flat(m), S.mode_of(flags))
    schema = pixel_schema(px, keys)
    like = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        a, there = _sized(*dense(table, cs), size)
        return pixel_table(warp_array(a, inverse, dsize, mode, there), table.select(keys), cs, like)

    return px.select(*keys, "y", "x", *cs).groupBy(*keys).applyInArrow(run, schema)


def _sized(a: np.ndarray, there: np.ndarray, size: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Padded or cut to size = (width, height)."""
    if size is None or a.shape[:2] == size[::-1]:
        return a, there
    out, mask = np.zeros((size[1], size[0], a.shape[2])), np.zeros(size[::-1], bool)
    h, w = min(size[1], a.shape[0]), min(size[0], a.shape[1])
    out[:h, :w], mask[:h, :w] = a[:h, :w], there[:h, :w]
    return out, mask


def affine_transform_by(px: DataFrame, matrices: DataFrame, dsize: tuple[int, int], flags: int | str = S.AUTO, keys: list[str] | None = None) -> DataFrame:
    """The same with a matrix per image: ``matrices`` has the keys and a struct column ``matrix``. Images
    without a matrix and matrices without an image give nothing."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keys, cs, flags = keys or ["image_id"], channels(px), S.mode_of(flags)
    schema = pixel_schema(px, keys)
    like = to_arrow_schema(schema)
    parts = [f"m{i}{j}" for i in range(2) for j in range(3)]

    def run(pixels: pa.Table, own: pa.Table) -> pa.Table:
        if not (pixels.num_rows and own.num_rows):
            return like.empty_table()
        m = own.column("matrix")[0].as_py()
        flat = tuple(m[k] for k in parts)
        a, there = dense(pixels, cs)
        return pixel_table(warp_array(a, _flat(get_inverse_matrix((flat[:3], flat[3:]))), dsize, _mode_for(flat, flags), there), own.select(keys), cs, like)

    # Renamed, since both sides may come from one table.
    left, right = px.select(*keys, "y", "x", *cs).groupBy(*keys), matrices.select(*(F.col(k).alias(k) for k in keys), "matrix").groupBy(*keys)
    return left.cogroup(right).applyInArrow(run, schema)


def template(size: int) -> list[tuple[float, float]]:
    """The five points in a crop of ``size`` pixels."""
    ratio, dx = (size / 112.0, 0) if size % 112 == 0 else (size / 128.0, int(8.0 * size / 128.0))
    return [(x * ratio + dx, y * ratio) for x, y in TEMPLATE]


def crop_matrix(kps: Column, size: int = 512) -> Column:
    """Similarity matrix (struct m00..m12) that takes five points (array of x, y) onto the template.
    The rotation is that of the singular value decomposition, in closed form."""
    dst = template(size)
    mx, my = sum(p[0] for p in dst) / 5, sum(p[1] for p in dst) / 5
    d = [(x - mx, y - my) for x, y in dst]
    d_total = sum(math.hypot(x, y) for x, y in d)
    ks = [F.element_at(kps, i + 1) for i in range(5)]
    sx = sum((k["x"] for k in ks[1:]), ks[0]["x"]) / 5.0
    sy = sum((k["y"] for k in ks[1:]), ks[0]["y"]) / 5.0

    def solve(c: Column) -> Column:
        px, py = [k["x"] - c["x"] for k in ks], [k["y"] - c["y"] for k in ks]
        total = sum((F.sqrt(x * x + y * y) for x, y in zip(px, py)), F.lit(0.0))
        cos = sum((x * dx + y * dy for x, y, (dx, dy) in zip(px, py, d)), F.lit(0.0))
        sin = sum((x * dy - y * dx for x, y, (dx, dy) in zip(px, py, d)), F.lit(0.0))

        def build(v: Column) -> Column:
            a, b = v["scale"] * v["cos"] / v["norm"], v["scale"] * v["sin"] / v["norm"]
            return F.struct(a.alias("m00"), (-b).alias("m01"), (F.lit(mx) - (a * c["x"] - b * c["y"])).alias("m02"), b.alias("m10"), a.alias("m11"), (F.lit(my) - (b * c["x"] + a * c["y"])).alias("m12"))

        return _let(F.struct((F.lit(d_total) / total).alias("scale"), cos.alias("cos"), sin.alias("sin"), F.sqrt(cos * cos + sin * sin).alias("norm")), build)

    return _let(F.struct(sx.alias("x"), sy.alias("y")), solve)


def crop_from_kps(px: DataFrame, kps: DataFrame, size: int = 512, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Aligned square crops and their matrices; ``kps`` has the keys and an array column ``kps``."""
    keys = keys or ["image_id"]
    matrices = kps.select(*keys, crop_matrix(F.col("kps"), size).alias("matrix"))
    return affine_transform_by(px, matrices, (size, size), S.AUTO, keys), matrices

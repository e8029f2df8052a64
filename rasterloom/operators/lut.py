"""Three-dimensional look-up tables.

A table of N^3 colours is bounded (N is checked), so applying it needs no join and no shuffle. Up to CELLS
steps it becomes a constant of the plan that holds the eight corners of each cell: a pixel reads one
entry and the rest is compiled arithmetic. Larger tables (at most 129^3 colours, 52 MB) are a broadcast
array that Arrow batches of pixels are looked up in. Red is the slowest index, blue the fastest."""
from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import color
from ..functions.dtype import clip

TRILINEAR, TETRAHEDRAL = 0, 1
LARGEST = 129
CELLS = 33


def lut_values(lut: DataFrame) -> tuple[int, list[float]]:
    """N and the flat values of a table (ri, gi, bi, r, g, b)."""
    n = (lut.agg(F.max("ri")).first()[0] or 0) + 1
    if not 2 <= n <= LARGEST:
        raise ValueError(f"tables of 2 to {LARGEST} steps are supported, not {n}")
    rows = lut.select("ri", "gi", "bi", "r", "g", "b").limit(n**3 + 1).collect()
    if len(rows) != n**3:
        raise ValueError(f"{len(rows)} colours for {n} steps")
    flat = [0.0] * (3 * n**3)
    for ri, gi, bi, r, g, b in rows:
        at = 3 * ((ri * n + gi) * n + bi)
        flat[at : at + 3] = r, g, b
    return n, flat


def _blend(interpolation: int, at, f: tuple[Column, Column, Column]) -> list[Column]:
    """Three mixed channels; ``at(c, ch)`` is the value of corner c (bits red 4, green 2, blue 1 for high)."""
    x, y, z = f
    if interpolation == TRILINEAR:
        mix = lambda a, b, t: a * (F.lit(1.0) - t) + b * t
        edge = lambda c, ch: mix(at(F.lit(c), ch), at(F.lit(c + 4), ch), x)
        face = lambda c, ch: mix(edge(c, ch), edge(c + 2, ch), y)
        return [mix(face(0, ch), face(1, ch), z) for ch in range(3)]
    # From the low to the high corner along the axes in falling order of their fractions.
    top = F.when((x >= y) & (x >= z), 4).when(y >= z, 2).otherwise(1)
    both = F.lit(7) - F.when((z <= x) & (z <= y), 1).when(y <= x, 2).otherwise(4)
    most, least = F.greatest(x, y, z), F.least(x, y, z)
    mid = x + y + z - most - least
    return [at(F.lit(0), ch) * (F.lit(1.0) - most) + at(top, ch) * (most - mid) + at(both, ch) * (mid - least) + at(F.lit(7), ch) * least for ch in range(3)]


def _cells(n: int, flat: list[float]) -> Column:
    """Constant array: for each cell its eight corners, three channels each."""
    rows = []
    for i in range(n - 1):
        for j in range(n - 1):
            for k in range(n - 1):
                row: list[float] = []
                for c in range(8):
                    p = 3 * (((i + (c >> 2)) * n + j + (c >> 1 & 1)) * n + k + (c & 1))
                    row += flat[p : p + 3]
                rows.append(row)
    return F.from_json(F.lit(json.dumps(rows)), "array<array<double>>")


def apply_lut(px: DataFrame, lut: DataFrame, interpolation: int = TRILINEAR) -> DataFrame:
    """``px`` with c0, c1, c2 (red, green, blue) taken through the table."""
    if interpolation not in (TRILINEAR, TETRAHEDRAL):
        raise ValueError(f"unknown interpolation {interpolation}")
    n, flat = lut_values(lut)
    rest = [c for c in px.columns if c not in ("c0", "c1", "c2")]
    place = [clip(F.col(c)) * float(n - 1) for c in ("c0", "c1", "c2")]
    low = lambda v: F.least(F.floor(v), F.lit(n - 2)).cast("int")
    px = px.select(*rest, *(v.alias(f"_s{i}") for i, v in enumerate(place)))
    i, j, k = (low(F.col(f"_s{i}")) for i in range(3))
    f = tuple(F.col(f"_s{i}") - low(F.col(f"_s{i}")) for i in range(3))
    if n <= CELLS:
        px = px.select(*rest, "_s0", "_s1", "_s2", F.get(_cells(n, flat), (i * (n - 1) + j) * (n - 1) + k).alias("_cell"))
        out = _blend(interpolation, lambda c, ch: F.get(F.col("_cell"), c * 3 + ch), f)
        return px.select(*rest, *(v.alias(f"c{c}") for c, v in enumerate(out)))
    shared = px.sparkSession.sparkContext.broadcast(np.array(flat).reshape(n, n, n, 3))
    schema = T.StructType([*(px.schema[c] for c in rest), *(T.StructField(f"c{c}", T.DoubleType()) for c in range(3))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.stack([b.column(f"_s{i}").to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            out = look_up(shared.value, s, interpolation)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *(pa.array(np.ascontiguousarray(out[:, c])) for c in range(3))], [*rest, "c0", "c1", "c2"])

    return px.mapInArrow(run, schema)


def look_up(table: np.ndarray, place: np.ndarray, interpolation: int) -> np.ndarray:
    """Colours at the places (row, 3), in steps, of a table (n, n, n, 3)."""
    base = np.minimum(np.floor(place), table.shape[0] - 2).astype(np.int64)
    f = place - base
    at = lambda d: table[base[:, 0] + d[0], base[:, 1] + d[1], base[:, 2] + d[2]]
    if interpolation == TRILINEAR:
        out = 0.0
        for c in range(8):
            d = (c >> 2, c >> 1 & 1, c & 1)
            share = np.prod([f[:, i] if d[i] else 1 - f[:, i] for i in range(3)], axis=0)
            out = out + share[:, None] * at(d)
        return out
    # From the low to the high corner along the axes in falling order of their fractions.
    order = np.argsort(-f, axis=1, kind="stable")
    steps = np.take_along_axis(f, order, axis=1)
    corner = np.zeros_like(base)
    out, before = 0.0, np.ones(len(f))
    for k in range(3):
        out = out + (before - steps[:, k])[:, None] * at(corner.T)
        before = steps[:, k]
        np.put_along_axis(corner, order[:, k : k + 1], 1, axis=1)
    return out + before[:, None] * at(corner.T)


def _each(px: DataFrame, f) -> DataFrame:
    return px.withColumns({c: f(F.col(c)) for c in ("c0", "c1", "c2")})


def rec709_to_aces2065_1(px: DataFrame, lut: DataFrame, tonemap: bool = True) -> DataFrame:
    px = _each(px, clip)
    if tonemap:
        px = _each(px, color.tone_log)
    return _each(apply_lut(px, lut), clip)


def aces2065_1_to_rec709(px: DataFrame, lut: DataFrame, tonemap: bool = True) -> DataFrame:
    px = apply_lut(_each(px, clip), lut)
    if tonemap:
        px = _each(px, color.tone_exp)
    return _each(px, clip)

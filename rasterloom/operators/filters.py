"""Gaussian blur and erosion."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dtype import to_float32
from .pixels import channels, sizes


def create_gaussian_kernel(kernel_size: int, sigma: float) -> list[float]:
    """Taps exp(-x^2 / 2 sigma^2), not normalized; an even size grows by one."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    k = kernel_size + 1 if kernel_size % 2 == 0 else kernel_size
    return [math.exp(-((i - k // 2) ** 2) / (2 * sigma * sigma)) for i in range(k)]


def _with_sizes(px: DataFrame, keys: list[str], size: tuple[int, int] | None) -> DataFrame:
    if size:
        return px.withColumns({"h_in": F.lit(size[1]), "w_in": F.lit(size[0])})
    return px.join(sizes(px, keys), keys)


def gaussian_blur(px: DataFrame, kernel_size: int, sigma: float, kernel: list | None = None, keys: list[str] | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """Horizontal, then vertical pass with clamped edges; any number of channels; result in [0, 1].
    A two-dimensional ``kernel`` is read as its first row. A pass is a projection over window frames
    (``lead``/``lag`` at fixed distances), so taps multiply no rows; pixels move once, to their image."""
    keys = keys or ["image_id"]
    taps = list(kernel) if kernel is not None else create_gaussian_kernel(kernel_size, sigma)
    if taps and isinstance(taps[0], (list, tuple)):
        taps = list(taps[0])
    r, total, cs = len(taps) // 2, sum(taps), channels(px)
    px = px.select(*keys, "y", "x", *(to_float32(F.col(c)).alias(c) for c in cs))
    for order, line in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(*keys, line).orderBy(order)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        px = px.withColumns({f"{p}_{c}": f(c).over(whole) for c in cs for p, f in (("lo", F.first), ("hi", F.last))})
        out = {}
        for c in cs:
            terms = []
            for k, t in enumerate(taps):
                d = k - r
                v = F.col(c) if d == 0 else F.coalesce(F.lead(c, d).over(w), F.col(f"hi_{c}")) if d > 0 else F.coalesce(F.lag(c, -d).over(w), F.col(f"lo_{c}"))
                terms.append(v * t)
            out[c] = sum(terms[1:], terms[0]) / total
        px = px.select(*keys, "y", "x", *(v.alias(c) for c, v in out.items()))
    return px.select(*keys, "y", "x", *(to_float32(F.col(c)).alias(c) for c in cs))


class GaussianBlur:
    """Keeps its taps while size and sigma stay the same."""

    def __init__(self) -> None:
        self._made: tuple[tuple[int, float], list[float]] | None = None

    def get(self, px: DataFrame, kernel_size: int, sigma: float, **options) -> DataFrame:
        if self._made is None or self._made[0] != (kernel_size, sigma):
            self._made = (kernel_size, sigma), create_gaussian_kernel(kernel_size, sigma)
        return gaussian_blur(px, kernel_size, sigma, kernel=self._made[1], **options)


def create_erode_kernel(kernel_size: int) -> list[list[int]]:
    return [[1] * kernel_size for _ in range(kernel_size)]


def erode(px: DataFrame, kernel_size: int = 3, kernel: list[list[int]] | None = None, border_value: float = 0.0, keys: list[str] | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """Least value (at most 1) under the mask around each pixel; outside the image counts as
    ``border_value``. A full mask is two window minimums; others take a row of each masked line."""
    keys = keys or ["image_id"]
    cs = channels(px)
    full = kernel is None
    mask = kernel or create_erode_kernel(kernel_size)
    k = len(mask)
    before, after = k // 2, k - 1 - k // 2
    px = _with_sizes(px.select(*keys, "y", "x", *(to_float32(F.col(c)).alias(c) for c in cs)), keys, size)
    border, one = F.lit(float(border_value)), F.lit(1.0)
    rest = ["h_in", "w_in"]
    if full:
        for order, line, n in (("x", "y", "w_in"), ("y", "x", "h_in")):
            w = Window.partitionBy(*keys, line).orderBy(order).rowsBetween(-before, after)
            outside = (F.col(order) < before) | (F.col(order) + after >= F.col(n))
            px = px.select(*keys, "y", "x", *rest, *(F.least(F.min(c).over(w), F.when(outside, border).otherwise(one)).alias(c) for c in cs))
        return px.select(*keys, "y", "x", *cs)
    cells = [(i - before, j - before) for i in range(k) for j in range(len(mask[i])) if mask[i][j] == 1]
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in cells))
    # Every pixel tells its value to the centres whose mask covers it; centres near the edge add the border.
    told = px.select(*keys, *rest, *cs, "y", "x", F.explode(offsets).alias("o")).select(*keys, *rest, *cs, (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"))
    told = told.where("y >= 0 and y < h_in and x >= 0 and x < w_in")
    least = told.groupBy(*keys, *rest, "y", "x").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in cs))
    base = px.select(*keys, "y", "x").join(least, [*keys, "y", "x"], "left")
    missing = F.coalesce(F.col("n"), F.lit(0)) < len(cells)
    return base.select(*keys, "y", "x", *(F.least(F.coalesce(F.col(c), one), F.when(missing, border).otherwise(one), one).alias(c) for c in cs))

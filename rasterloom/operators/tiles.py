"""Overlapping tiles: reflect padding, splitting, Gaussian-weighted merging."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dtype import to_float32
from .pixels import channels, grid


def padded(size: int, tile: int, overlap: int) -> int:
    """Side after padding to a whole number of steps."""
    step = tile - overlap
    pad = step - (size - overlap) % step
    return size if pad == step else size + pad


def _reflected(i: Column, n: int) -> Column:
    """Source index of a position in the padded side; the edge is not repeated."""
    if n == 1:
        return F.lit(0)
    m = i % (2 * (n - 1))
    return F.when(m < n, m).otherwise(F.lit(2 * (n - 1)) - m)


def _sources(spark: SparkSession, n: int, out: int, name: str) -> DataFrame:
    return spark.range(out).select(F.col("id").cast("int").alias(f"to_{name}"), _reflected(F.col("id"), n).cast("int").alias(name))


def add_padding(px: DataFrame, size: tuple[int, int], patch_size: int, overlap: int, keys: list[str] | None = None) -> DataFrame:
    """Pad images of ``size`` = (height, width) at the bottom and right by reflection. The index
    tables are as long as a side and join by broadcast under Catalyst's size check."""
    keys = keys or ["image_id"]
    h, w = size
    ys, xs = _sources(px.sparkSession, h, padded(h, patch_size, overlap), "y"), _sources(px.sparkSession, w, padded(w, patch_size, overlap), "x")
    return px.join(ys, "y").join(xs, "x").select(*keys, F.col("to_y").alias("y"), F.col("to_x").alias("x"), *channels(px))


def _covering(v: str, count: int, tile: int, step: int) -> Column:
    """Numbers of the tiles of one axis that cover a position."""
    low = F.greatest(F.lit(0), F.floor((F.col(v) - tile) / step).cast("int") + 1)
    return F.sequence(low, F.least(F.lit(count - 1), F.floor(F.col(v) / step).cast("int")))


def tile_image(px: DataFrame, size: tuple[int, int], tile_size: int = 128, overlap: int = 16, keys: list[str] | None = None) -> DataFrame:
    """keys, tile_idx (row-major), y and x inside the tile: each pixel goes to the tiles covering it."""
    keys = keys or ["image_id"]
    step = tile_size - overlap
    full = add_padding(px, size, tile_size, overlap, keys)
    rows, cols = ((padded(n, tile_size, overlap) - overlap) // step for n in size)
    cs = channels(px)
    out = full.select(*keys, "y", "x", *cs, F.explode(_covering("y", rows, tile_size, step)).alias("ty")).select(*keys, "y", "x", *cs, "ty", F.explode(_covering("x", cols, tile_size, step)).alias("tx"))
    return out.select(*keys, (F.col("ty") * cols + F.col("tx")).alias("tile_idx"), (F.col("y") - F.col("ty") * step).alias("y"), (F.col("x") - F.col("tx") * step).alias("x"), *cs)


def gaussian_weights(y: Column, x: Column, size: int, sigma: float) -> Column:
    """Unnormalized weight exp(-d^2 / 2 sigma^2) on a grid of [-1, 1] squared."""
    ax = lambda v: F.lit(-1.0) + v * (2.0 / (size - 1)) if size > 1 else F.lit(-1.0)
    d2 = ax(y) * ax(y) + ax(x) * ax(x)
    return F.exp(-d2 / (2.0 * sigma * sigma))


def create_gaussian_weights(spark: SparkSession, size: int, sigma: float) -> DataFrame:
    """(y, x, g), g summing to one."""
    g = grid(spark, size, size).withColumn("g", gaussian_weights(F.col("y"), F.col("x"), size, sigma))
    return g.crossJoin(F.broadcast(g.agg(F.sum("g").alias("t")))).select("y", "x", (F.col("g") / F.col("t")).alias("g"))  # one row


def merge_tiles(tiles: DataFrame, size: tuple[int, int], scale: int = 1, tile_size: int = 128, overlap: int = 16, keys: list[str] | None = None) -> DataFrame:
    """Weighted mean of the tiles (already ``scale`` times larger) of images of original ``size``."""
    keys = keys or ["image_id"]
    h, w = size
    cols = (padded(w, tile_size, overlap) - overlap) // (tile_size - overlap)
    side, step = tile_size * scale, (tile_size - overlap) * scale
    weights = create_gaussian_weights(tiles.sparkSession, side, side // 4)
    cs = channels(tiles)
    rows = tiles.join(weights, ["y", "x"])
    at = rows.select(*keys, (F.col("y") + F.floor(F.col("tile_idx") / cols) * step).cast("int").alias("y"), (F.col("x") + (F.col("tile_idx") % cols) * step).cast("int").alias("x"), "g", *(to_float32(F.col(c)).alias(c) for c in cs))
    at = at.where((F.col("y") < h * scale) & (F.col("x") < w * scale))
    return at.groupBy(*keys, "y", "x").agg(*((F.sum(F.col(c) * F.col("g")) / (F.sum("g") + 1e-8)).alias(c) for c in cs))

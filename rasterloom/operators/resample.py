"""Resizing in two separable passes: join with a generated tap table, weighted mean.

Pixels are partitioned by image once; both aggregates group by image and so reuse that partitioning.
Tap tables are as long as an image side; they join by broadcast under Catalyst's size check."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.dtype import clip
from ..functions.taps import tap_table
from .pixels import channels, sizes


def _pass(px: DataFrame, taps: DataFrame, keys: list[str], axis: str, other: str, rest: list[str]) -> DataFrame:
    """One axis: output position o from source position s."""
    n_in, n_out = ("w_in", "w_out") if axis == "x" else ("h_in", "h_out")
    t = taps.select(F.col("n_in").alias(n_in), F.col("n_out").alias(n_out), F.col("s").alias(axis), "o", "w")
    joined = px.join(t, [n_in, n_out, axis])
    total = F.sum("w")
    mean = [F.when(total > 0, F.sum(F.col("w") * F.col(c)) / F.when(total > 0, total)).otherwise(F.lit(0.0)).alias(c) for c in channels(px)]
    return joined.groupBy(*keys, *rest, other, "o").agg(*mean).withColumnRenamed("o", axis)


def resize(px: DataFrame, dsize: tuple[int, int] | None = None, fx: float | None = None, fy: float | None = None, interpolation: int | str = S.AUTO, keys: list[str] | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """Resize every image of a pixel table to ``dsize`` = (width, height), or by factors ``fx``
    (width) and ``fy`` (height). ``size`` = (width, height) of all images spares measuring them.
    AUTO takes AREA where a side shrinks, else LANCZOS4. Results lie in [0, 1]; NaN becomes 0."""
    keys = keys or ["image_id"]
    mode = S.mode_of(interpolation)
    if dsize is None and (fx is None or fy is None):
        raise ValueError("either dsize or both factors are needed")
    cs = channels(px)
    rest = ["h_in", "w_in", "h_out", "w_out"]
    if size:
        px = px.select(*keys, "y", "x", *cs, F.lit(size[1]).alias("h_in"), F.lit(size[0]).alias("w_in"))
        known = px.sparkSession.range(1).select(F.lit(size[1]).alias("h_in"), F.lit(size[0]).alias("w_in"))
    else:
        of = sizes(px, keys)
        px = px.select(*keys, "y", "x", *cs).join(of, keys)
        known = of.select("h_in", "w_in").distinct()
    out = lambda df: df.withColumns({"h_out": F.lit(dsize[1]) if dsize else F.floor(F.col("h_in") * fy).cast("int"), "w_out": F.lit(dsize[0]) if dsize else F.floor(F.col("w_in") * fx).cast("int")})
    px, known = out(px), out(known)
    shrinks = (F.col("h_out") < F.col("h_in")) | (F.col("w_out") < F.col("w_in"))
    px = px.repartition(*(F.col(k) for k in keys))

    def run(px: DataFrame, known: DataFrame, mode: int) -> DataFrame:
        tx = tap_table(known.select(F.col("w_in").alias("n_in"), F.col("w_out").alias("n_out")), mode)
        ty = tap_table(known.select(F.col("h_in").alias("n_in"), F.col("h_out").alias("n_out")), mode)
        return _pass(_pass(px, tx, keys, "x", "y", rest), ty, keys, "y", "x", rest)

    if mode != S.AUTO:
        done = run(px, known, mode)
    elif size and dsize:
        done = run(px, known, S.AREA if dsize[0] < size[0] or dsize[1] < size[1] else S.LANCZOS4)
    else:
        done = run(px.where(shrinks), known.where(shrinks), S.AREA).unionByName(run(px.where(~shrinks), known.where(~shrinks), S.LANCZOS4))
    return done.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *(clip(F.nanvl(F.col(c), F.lit(0.0))).alias(c) for c in cs))

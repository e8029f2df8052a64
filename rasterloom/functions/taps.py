"""One-dimensional resampling taps: which source samples make an output sample, with which weights.

Every mode is a Column formula, so tap tables of any length are generated by Spark from a table of
size pairs, and the same formulas serve the geometric warps."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

#: B and C of the two-parameter cubics; a of the windowed sincs.
CUBICS = {S.MITCHELL: (1 / 3, 1 / 3), S.CATMULL_ROM: (0.0, 0.5), S.B_SPLINE: (1.0, 0.0)}
SINCS = {S.LANCZOS2: 2, S.LANCZOS3: 3, S.LANCZOS4: 4}


def keys_cubic(d: Column) -> Column:
    t = F.abs(d)
    return F.when(t <= 1, (t * 1.5 - 2.5) * t * t + 1.0).when(t < 2, ((t * -0.5 + 2.5) * t - 4.0) * t + 2.0).otherwise(F.lit(0.0))


def bc_cubic(d: Column, b: float, c: float) -> Column:
    t = F.abs(d)
    near = ((t * (12 - 9 * b - 6 * c) + (-18 + 12 * b + 6 * c)) * t * t + (6 - 2 * b)) / 6.0
    far = (((t * (-b - 6 * c) + (6 * b + 30 * c)) * t + (-12 * b - 48 * c)) * t + (8 * b + 24 * c)) / 6.0
    return F.when(t < 1, near).when(t < 2, far).otherwise(F.lit(0.0))


def sinc_window(d: Column, a: int) -> Column:
    x = F.when(d == 0, F.lit(1.0)).otherwise(d * math.pi)
    return F.when(d == 0, F.lit(1.0)).when(F.abs(d) >= a, F.lit(0.0)).otherwise(F.sin(x) * F.sin(x / a) * a / (x * x))


def weight(mode: int, d: Column) -> Column:
    """Weight at distance ``d`` for the modes that have a kernel."""
    if mode == S.CUBIC:
        return keys_cubic(d)
    if mode in CUBICS:
        return bc_cubic(d, *CUBICS[mode])
    if mode in SINCS:
        return sinc_window(d, SINCS[mode])
    raise ValueError(f"mode {mode} has no kernel")


def _tap(s: Column, w: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), w.cast("double").alias("w"))


def taps_of(mode: int, o: Column, n_in: Column, n_out: Column) -> Column:
    """Array of (s, w) for output position ``o``; taps outside the image are absent or clamped, as
    the mode has it. Weights need not sum to one."""
    o, last = o.cast("double"), n_in - 1
    ratio = n_in.cast("double") / n_out
    if mode == S.NEAREST:
        return F.array(_tap(F.least(F.floor(o * n_in / n_out), last), F.lit(1.0)))
    if mode == S.LINEAR:
        one = n_out == 1
        p = o * last / F.when(one, F.lit(1)).otherwise(n_out - 1)
        low = F.floor(p)
        f = p - low
        alive = F.when(one, F.lit(0.0)).otherwise(F.lit(1.0))
        return F.array(_tap(low, (F.lit(1.0) - f) * alive), _tap(F.least(low + 1, last), f * alive))
    if mode == S.AREA:
        a, z = o * ratio, (o + 1) * ratio
        cover = lambda s: F.greatest(F.least(s + 1.0, z) - F.greatest(s.cast("double"), a), F.lit(0.0))
        reach = F.sequence(F.floor(a).cast("int"), F.least(F.ceil(z).cast("int") - 1, last))
        return F.transform(reach, lambda s: _tap(s, cover(s)))
    if mode == S.CUBIC:
        p = o * ratio
        base = F.floor(p).cast("int")
        return F.transform(F.sequence(base - 1, base + 2), lambda s: _tap(F.least(F.greatest(s, F.lit(0)), last), weight(mode, p - s)))
    if mode in SINCS:
        p, a = o * ratio, SINCS[mode]
        base = F.floor(p).cast("int")
        reach = F.sequence(base - a, base + a)
    elif mode in CUBICS:
        p = (o + 0.5) * ratio - 0.5
        base = F.floor(p - 1).cast("int")
        reach = F.sequence(base, base + 3)
    else:
        raise ValueError(f"unknown mode {mode}")
    return F.transform(F.filter(reach, lambda s: (s >= 0) & (s <= last)), lambda s: _tap(s, weight(mode, p - s)))


def tap_table(sizes: DataFrame, mode: int) -> DataFrame:
    """(n_in, n_out, o, s, w) for each distinct (n_in, n_out) of ``sizes``."""
    rows = sizes.select("n_in", "n_out").distinct().where("n_in > 0 and n_out > 0").select("n_in", "n_out", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("o"))
    return rows.select("n_in", "n_out", "o", F.explode(taps_of(mode, F.col("o"), F.col("n_in"), F.col("n_out"))).alias("t")).select("n_in", "n_out", "o", "t.s", "t.w")

"""Sample types as Column expressions. Integers are truncated, never rounded."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOATS = ("float16", "float32", "float64")


def _known(dtype: str) -> None:
    if dtype not in ("uint8", "uint16", *FLOATS):
        raise ValueError(f"Unsupported dtype {dtype}")


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _unit(c: Column, dtype: str) -> Column:
    _known(dtype)
    c = c.cast("double")
    return c / 255.0 if dtype == "uint8" else c / 65535.0 if dtype == "uint16" else c


def to_uint8(c: Column, dtype: str = "float32") -> Column:
    return c.cast("int") if dtype == "uint8" else F.floor(clip(_unit(c, dtype) * 255.0, 0.0, 255.0)).cast("int")


def to_uint16(c: Column, dtype: str = "float32") -> Column:
    return c.cast("int") if dtype == "uint16" else F.floor(clip(_unit(c, dtype) * 65535.0, 0.0, 65535.0)).cast("int")


def half(c: Column) -> Column:
    """Nearest half-precision value (ties to even), kept in a double; beyond 65504 infinity."""
    size = F.abs(c)
    e = F.when(size > 0, F.greatest(F.floor(F.log2(F.when(size > 0, size))), F.lit(-14))).otherwise(F.lit(-14)).cast("double")
    step = F.pow(F.lit(2.0), e - 10.0)
    near = F.rint(c / step) * step
    return F.when(F.abs(near) > 65504.0, F.signum(c) * F.lit(float("inf"))).otherwise(near)


def to_float16(c: Column, dtype: str = "float32") -> Column:
    return half(_unit(c, dtype))


def to_float32(c: Column, dtype: str = "float32") -> Column:
    """Samples in [0, 1]; float input is clipped too."""
    return clip(_unit(c, dtype))


def to_float64(c: Column, dtype: str = "float32") -> Column:
    return _unit(c, dtype)


def to_dtype(c: Column, target: str, dtype: str = "float32") -> Column:
    table = {"uint8": to_uint8, "uint16": to_uint16, "float16": to_float16, "float32": to_float32}
    if target not in table:
        raise ValueError(f"Unsupported dtype {target}")
    return table[target](c, dtype)

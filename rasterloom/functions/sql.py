"""SQL functions for the point operators. Spark inlines them, so a call costs what the expression does."""
from __future__ import annotations

from pyspark.sql import SparkSession

from . import color as K

_RGB = "r DOUBLE, g DOUBLE, b DOUBLE"
_U = {c: f"least(greatest({c}, 0e0), 1e0)" for c in "rgbhsv"}
_LUMA = f"({K.LUMA[0]}e0 * {_U['r']} + {K.LUMA[1]}e0 * {_U['g']} + {K.LUMA[2]}e0 * {_U['b']})"
_TOP, _LOW = (f"{f}({_U['r']}, {_U['g']}, {_U['b']})" for f in ("greatest", "least"))


def _row(row: tuple[float, ...]) -> str:
    return "(" + " + ".join(f"({w}e0) * {_U[c]}" for w, c in zip(row, "rgb")) + ")"


#: name: (parameters, expression)
FUNCTIONS = {
    "to_uint8": ("v DOUBLE", "cast(floor(least(greatest(v * 255e0, 0e0), 255e0)) AS INT)"),
    "to_uint16": ("v DOUBLE", "cast(floor(least(greatest(v * 65535e0, 0e0), 65535e0)) AS INT)"),
    "uint8_to_float32": ("v INT", "least(greatest(v / 255e0, 0e0), 1e0)"),
    "uint16_to_float32": ("v INT", "least(greatest(v / 65535e0, 0e0), 1e0)"),
    "rgb_luma": (_RGB, _LUMA),
    "rgb_value": (_RGB, _TOP),
    "rgb_saturation": (_RGB, f"CASE WHEN {_TOP} = 0 THEN 0e0 ELSE ({_TOP} - {_LOW}) / {_TOP} END"),
    "rgb_hue": (_RGB, f"CASE WHEN {_TOP} = {_LOW} THEN 0e0 ELSE pmod(CASE WHEN {_TOP} = {_U['r']} THEN ({_U['g']} - {_U['b']}) / ({_TOP} - {_LOW}) WHEN {_TOP} = {_U['g']} THEN ({_U['b']} - {_U['r']}) / ({_TOP} - {_LOW}) + 2 ELSE ({_U['r']} - {_U['g']}) / ({_TOP} - {_LOW}) + 4 END, 6e0) / 6e0 END"),
    "rgb_cb": (_RGB, f"({_U['b']} - {_LUMA}) / {K.CB_SCALE}e0 + 0.5e0"),
    "rgb_cr": (_RGB, f"({_U['r']} - {_LUMA}) / {K.CR_SCALE}e0 + 0.5e0"),
    "ycbcr_red": ("y DOUBLE, cb DOUBLE, cr DOUBLE", f"y + (cr - 0.5e0) * {K.CR_SCALE}e0"),
    "ycbcr_green": ("y DOUBLE, cb DOUBLE, cr DOUBLE", f"y - (cb - 0.5e0) * {K.G_CB}e0 - (cr - 0.5e0) * {K.G_CR}e0"),
    "ycbcr_blue": ("y DOUBLE, cb DOUBLE, cr DOUBLE", f"y + (cb - 0.5e0) * {K.CB_SCALE}e0"),
    "luma_full_to_legal": ("y DOUBLE", "y * 876e0 / 1023e0 + 64e0 / 1023e0"),
    "luma_legal_to_full": ("y DOUBLE", "(y - 64e0 / 1023e0) * 1023e0 / 876e0"),
    "chroma_full_to_legal": ("c DOUBLE", "(c - 0.5e0) * 896e0 / 1023e0 + 0.5e0"),
    "chroma_legal_to_full": ("c DOUBLE", "(c - 0.5e0) * 1023e0 / 896e0 + 0.5e0"),
    **{f"acescg_{c}": (_RGB, _row(K.AP0_TO_AP1[i])) for i, c in enumerate(("red", "green", "blue"))},
    **{f"aces2065_1_{c}": (_RGB, _row(K.AP1_TO_AP0[i])) for i, c in enumerate(("red", "green", "blue"))},
}


def register(spark: SparkSession, prefix: str = "px_") -> list[str]:
    """Create the temporary functions; returns their names."""
    for name, (parameters, body) in FUNCTIONS.items():
        kind = "INT" if name in ("to_uint8", "to_uint16") else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    return [prefix + n for n in FUNCTIONS]

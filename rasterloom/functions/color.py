"""Colour spaces as Column expressions: three columns in, three columns out, no shuffle, no UDF."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dtype import clip

Triple = tuple[Column, Column, Column]

# Luma weights, chroma scales, legal range, colour matrices, log curves.
LUMA = (0.2126, 0.7152, 0.0722)
CB_SCALE, CR_SCALE = 1.8556, 1.5748
G_CB, G_CR = 0.1873, 0.4681
Y_LEGAL, C_LEGAL, Y_BLACK = 876.0 / 1023.0, 896.0 / 1023.0, 64.0 / 1023.0
AP0_TO_AP1 = ((1.4514393161, -0.2365107469, -0.2149285693), (-0.0765537734, 1.1762296998, -0.0996759264), (0.0083161484, -0.0060324498, 0.9977163014))
AP1_TO_AP0 = ((0.6954522414, 0.1406786965, 0.1638690622), (0.0447945634, 0.8596711185, 0.0955343182), (-0.0055258826, 0.0040252103, 1.0015006723))
CCT_CUT, CCT_CUT_LOG = 0.0078125, 0.155251141552511
CCT_A, CCT_B = 10.5402377416545, 0.0729055341958355
TONE_A, TONE_B, TONE_C = 1.186e-3, 12.144, -1.5e-8


def swap(c0: Column, c1: Column, c2: Column) -> Triple:
    """RGB to BGR and back: a renaming that the optimizer removes."""
    return c2, c1, c0


rgb_to_bgr = bgr_to_rgb = swap


def _dot(row: tuple[float, ...], t: Triple) -> Column:
    return sum((F.lit(w) * c for w, c in zip(row[1:], t[1:])), F.lit(row[0]) * t[0])


def matrix(rows: tuple[tuple[float, ...], ...], t: Triple) -> Triple:
    return tuple(_dot(r, t) for r in rows)


def _unit(t: Triple) -> Triple:
    return tuple(clip(c) for c in t)


def rgb_to_grayscale(*t: Column) -> Triple:
    y = _dot(LUMA, _unit(t))
    return y, y, y


def bgr_to_grayscale(*t: Column) -> Triple:
    return rgb_to_grayscale(*swap(*t))


def rgb_to_hsv(*t: Column) -> Triple:
    """Hue, saturation and value, all in [0, 1]."""
    r, g, b = _unit(t)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    safe = F.when(d > 0, d).otherwise(F.lit(1.0))
    sector = F.when(top == r, (g - b) / safe).when(top == g, (b - r) / safe + 2.0).otherwise((r - g) / safe + 4.0)
    degrees = F.when(d > 0, sector * 60.0).otherwise(F.lit(0.0))
    hue = F.when(degrees < 0, degrees + 360.0).otherwise(degrees) / 360.0
    return hue, F.when(top == 0, F.lit(0.0)).otherwise(d / F.when(top == 0, F.lit(1.0)).otherwise(top)), top


def bgr_to_hsv(*t: Column) -> Triple:
    return rgb_to_hsv(*swap(*t))


def hsv_to_rgb(*t: Column) -> Triple:
    h, s, v = _unit(t)
    turn = (h * 360.0) % 360.0 / 60.0
    chroma = v * s
    x = chroma * (F.lit(1.0) - F.abs(turn % 2.0 - 1.0))
    m = v - chroma
    zero = F.lit(0.0)
    rows = ((chroma, x, zero), (x, chroma, zero), (zero, chroma, x), (zero, x, chroma), (x, zero, chroma))
    out = []
    for k, last in enumerate((chroma, zero, x)):
        pick = F.when(turn < 1, rows[0][k])
        for i in range(1, 5):
            pick = pick.when(turn < i + 1, rows[i][k])
        out.append(pick.otherwise(last) + m)
    return tuple(out)


def hsv_to_bgr(*t: Column) -> Triple:
    return swap(*hsv_to_rgb(*t))


def hue_in_range(h: Column) -> Column:
    """Aggregate: true if no hue of the group leaves [0, 1]."""
    return (F.min(h) >= 0) & (F.max(h) <= 1)


def rgb_to_ycbcr(*t: Column) -> Triple:
    r, _, b = t = _unit(t)
    y = _dot(LUMA, t)
    return y, (b - y) / CB_SCALE + 0.5, (r - y) / CR_SCALE + 0.5


def bgr_to_ycbcr(*t: Column) -> Triple:
    return rgb_to_ycbcr(*swap(*t))


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> Triple:
    u, v = cb - 0.5, cr - 0.5
    return y + v * CR_SCALE, y - u * G_CB - v * G_CR, y + u * CB_SCALE


def ycbcr_to_bgr(*t: Column) -> Triple:
    return swap(*ycbcr_to_rgb(*t))


def ycbcr_full_to_legal(y: Column, cb: Column, cr: Column) -> Triple:
    return y * Y_LEGAL + Y_BLACK, (cb - 0.5) * C_LEGAL + 0.5, (cr - 0.5) * C_LEGAL + 0.5


def ycbcr_legal_to_full(y: Column, cb: Column, cr: Column) -> Triple:
    return (y - Y_BLACK) / Y_LEGAL, (cb - 0.5) / C_LEGAL + 0.5, (cr - 0.5) / C_LEGAL + 0.5


def ycbcr_to_grayscale(y: Column, cb: Column, cr: Column) -> Triple:
    return y, y, y


def aces2065_1_to_acescg(*t: Column) -> Triple:
    return matrix(AP0_TO_AP1, _unit(t))


def acescg_to_aces2065_1(*t: Column) -> Triple:
    return matrix(AP1_TO_AP0, _unit(t))


def aces2065_1_to_acescct(*t: Column, spec: bool = False) -> Triple:
    """Log encoding. By default the branches and the scale of the linear part are those that users of
    the original have; ``spec`` gives the published curve."""

    def curve(v: Column) -> Column:
        positive = F.when(v > 0, v).otherwise(F.lit(2.0**-40))
        log = (F.log2(positive) + 9.72) / 17.52
        line = v * CCT_A + CCT_B
        return F.when(v <= CCT_CUT, line).otherwise(log) if spec else F.when(v <= CCT_CUT, log).otherwise(line / 17.52)

    return tuple(curve(v) for v in matrix(AP0_TO_AP1, _unit(t)))


def acescct_to_aces2065_1(*t: Column, spec: bool = False) -> Triple:
    def curve(v: Column) -> Column:
        line = (v if spec else v * 17.52) - CCT_B
        log = F.when(v < math.log2(65504.0), F.pow(F.lit(2.0), v * 17.52 - 9.72)).otherwise(F.lit(65504.0))
        return F.when(v <= CCT_CUT_LOG, line / CCT_A).otherwise(log)

    return matrix(AP1_TO_AP0, tuple(curve(v) for v in _unit(t)))


def tone_log(v: Column) -> Column:
    """Display value to the log domain of the look-up tables."""
    return F.log((v - TONE_C) / TONE_A) / TONE_B


def tone_exp(v: Column) -> Column:
    return F.exp(v * TONE_B) * TONE_A + TONE_C

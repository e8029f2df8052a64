"""Warps of one image as numpy arrays: for every output pixel, the taps of both axes and a weighted mean."""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .. import schema as S
from ..functions.taps import CUBICS, SINCS


#: Taps that are gathered at a time.
CHUNK = 1 << 20


def kernel(mode: int, d: np.ndarray) -> np.ndarray:
    """Weight at distance ``d`` for the modes that have a kernel."""
    d = np.abs(d)
    if mode == S.CUBIC:
        return np.where(d <= 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0))
    if mode in CUBICS:
        b, c = CUBICS[mode]
        near = ((12 - 9 * b - 6 * c) * d + (-18 + 12 * b + 6 * c)) * d * d + (6 - 2 * b)
        far = (((-b - 6 * c) * d + (6 * b + 30 * c)) * d + (-12 * b - 48 * c)) * d + (8 * b + 24 * c)
        return np.where(d < 1, near / 6, np.where(d < 2, far / 6, 0))
    a = SINCS[mode]
    return np.where(d < a, np.sinc(d) * np.sinc(d / a), 0)


def axis_taps(mode: int, t: np.ndarray, n: int, half: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(source position, weight) of each tap for source coordinates ``t``; weight 0 outside the mode's bounds.
    ``half`` is half the extent of an output pixel in the source."""
    if mode == S.NEAREST:
        s = np.rint(t)
        yield s.astype(np.int64), ((s >= 0) & (s < n)).astype(float)
    elif mode == S.LINEAR:
        low, inside = np.floor(t), (t >= 0) & (t < n)
        yield low.astype(np.int64), np.where(inside, 1 - (t - low), 0)
        yield np.minimum(low + 1, n - 1).astype(np.int64), np.where(inside, t - low, 0)
    elif mode == S.AREA:
        # The far cell's weight replaces the near one's where they coincide, and a clamped edge may
        # weigh more than 1 (kept as users know it).
        low, high = t - half, t + half
        first, last = np.maximum(0, np.floor(low)), np.minimum(n, np.ceil(high)) - 1
        for k in range(int(max(1, (last - first).max(initial=-1) + 1))):
            s = first + k
            w = np.where(s == last, 1 - (s + 1 - high), np.where(s == first, 1 - (low - s), 1.0))
            yield s.astype(np.int64), np.where(s <= last, w, 0)
    else:
        reach = SINCS.get(mode)
        base = np.floor(t - 1) if mode in CUBICS else np.floor(t) - (1 if mode == S.CUBIC else reach - 1)
        low, far = (2, 2) if mode == S.CUBIC else (1, 2) if mode in CUBICS else (reach + 1, reach + 1)
        inside = (t >= low) & (t < n - far)
        for k in range(2 * reach if reach else 4):
            s = base + k
            yield s.astype(np.int64), np.where(inside, kernel(mode, t - s), 0)


def _chunks(inverse: tuple[float, ...], dsize: tuple[int, int], mode: int, h: int, w: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index of the source pixel and weight of every tap (taps, output pixels), some output rows at a time."""
    m = inverse
    half_x, half_y = (0.5 * float(np.hypot(m[i], m[i + 1])) for i in (0, 3))
    taps = (2 * half_x + 2) * (2 * half_y + 2) if mode == S.AREA else 64
    rows = max(1, int(CHUNK / taps) // max(1, dsize[1]))
    for top in range(0, dsize[0], rows):
        y, x = np.mgrid[top : min(top + rows, dsize[0]), : dsize[1]].reshape(2, -1) + (0.5 if mode == S.AREA else 0.0)
        sx, wx = (np.stack(v)[None] for v in zip(*axis_taps(mode, m[0] * x + m[1] * y + m[2], w, half_x)))
        sy, wy = (np.stack(v)[:, None] for v in zip(*axis_taps(mode, m[3] * x + m[4] * y + m[5], h, half_y)))
        inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
        yield (np.clip(sy, 0, h - 1) * w + np.clip(sx, 0, w - 1)).reshape(-1, len(x)), np.where(inside, wy * wx, 0).reshape(-1, len(x))


@lru_cache(maxsize=8)
def _kept_chunks(*args) -> list[tuple[np.ndarray, np.ndarray]]:
    """The taps of small images, which many images of one size share."""
    return list(_chunks(*args))


def warp_array(a: np.ndarray, inverse: tuple[float, ...], dsize: tuple[int, int], mode: int, present: np.ndarray | None = None) -> np.ndarray:
    """``a`` (height, width, channels) warped into dsize by the six values of the inverse matrix. Pixels
    without positive weight are 0; those that ``present`` excludes weigh nothing."""
    h, w, c = a.shape
    flat = a.reshape(h * w, c)
    there = None if present is None or present.all() else present.ravel()
    parts = []
    for at, weight in (_kept_chunks if dsize[0] * dsize[1] <= CHUNK // 64 else _chunks)(tuple(inverse), tuple(dsize), mode, h, w):
        if there is not None:
            weight = weight * there[at]
        total = weight.sum(axis=0)[:, None]
        out = np.einsum("tn,tnc->nc", weight, flat[at])
        parts.append(np.divide(out, total, out=np.zeros_like(out), where=total > 0))
    return np.concatenate(parts).reshape(*dsize, c)

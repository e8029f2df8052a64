"""The array path: IMAGE rows as numpy arrays inside Arrow batches. Resampling is two small matrix
products per channel with the weights of the tap table's modes; nothing is shuffled."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.taps import CUBICS, SINCS
from .filters import create_gaussian_kernel
from .pixels import channels
from .warp import kernel

NUMPY = {"uint8": "<u1", "uint16": "<u2", "float16": "<f2", "float32": "<f4", "float64": "<f8"}


def decode_data(data: bytes, height: int, width: int, channels: int, dtype: str, unit: bool = False) -> np.ndarray:
    """(height, width, channels); ``unit`` scales integers to [0, 1] and clips."""
    if dtype not in NUMPY:
        raise ValueError(f"Unsupported dtype {dtype}")
    a = np.frombuffer(data, NUMPY[dtype]).reshape(int(height), int(width), int(channels))
    if unit:
        top = {"uint8": 255.0, "uint16": 65535.0}.get(dtype, 1.0)
        a = np.clip(a.astype(np.float64) / top, 0, 1)
    return a


def encode_data(a: np.ndarray, dtype: str) -> bytes:
    """Row-major little-endian bytes; floats to integers are truncated."""
    if dtype in ("uint8", "uint16") and a.dtype.kind == "f":
        top = 255 if dtype == "uint8" else 65535
        a = np.floor(np.clip(a * float(top), 0, top))
    return np.ascontiguousarray(a.astype(NUMPY[dtype])).tobytes()


def weights(mode: int, n_in: int, n_out: int) -> np.ndarray:
    """(n_out, n_in) row-normalized weights."""
    w = np.zeros((n_out, n_in))
    o = np.arange(n_out)
    ratio = n_in / n_out
    if mode == S.NEAREST:
        w[o, np.minimum(o * n_in // n_out, n_in - 1)] = 1
    elif mode == S.LINEAR:
        if n_out > 1:
            p = o * (n_in - 1) / (n_out - 1)
            low = np.floor(p).astype(int)
            np.add.at(w, (o, low), 1 - (p - low))
            np.add.at(w, (o, np.minimum(low + 1, n_in - 1)), p - low)
    elif mode == S.AREA:
        s = np.arange(n_in)
        w = np.clip(np.minimum(s + 1, ((o + 1) * ratio)[:, None]) - np.maximum(s, (o * ratio)[:, None]), 0, None)
    else:
        half = mode in CUBICS
        p = (o + 0.5) * ratio - 0.5 if half else o * ratio
        a = SINCS.get(mode, 2)
        first = np.floor(p - 1) if half else np.floor(p) - (1 if mode == S.CUBIC else a)
        for k in range(4 if half or mode == S.CUBIC else 2 * a + 1):
            s = (first + k).astype(int)
            v = kernel(mode, p - s)
            if mode == S.CUBIC:
                s = np.clip(s, 0, n_in - 1)
            ok = (s >= 0) & (s < n_in)
            np.add.at(w, (o[ok], s[ok]), v[ok])
    total = w.sum(axis=1, keepdims=True)
    return np.divide(w, total, out=np.zeros_like(w), where=total > 0)


def resize_array(a: np.ndarray, width: int, height: int, mode: int = S.AUTO) -> np.ndarray:
    h, w = a.shape[:2]
    if mode == S.AUTO:
        mode = S.AREA if width < w or height < h else S.LANCZOS4
    out = np.einsum("oy,yxc,px->opc", weights(mode, h, height), a, weights(mode, w, width), optimize=True)
    return np.clip(np.nan_to_num(out), 0, 1)


def blur_array(a: np.ndarray, kernel_size: int, sigma: float) -> np.ndarray:
    taps = np.array(create_gaussian_kernel(kernel_size, sigma))
    r = len(taps) // 2
    for axis in (1, 0):
        n = a.shape[axis]
        a = sum(t * np.take(a, np.clip(np.arange(n) + k - r, 0, n - 1), axis=axis) for k, t in enumerate(taps)) / taps.sum()
    return np.clip(a, 0, 1)


def map_images(images: DataFrame, f, dtype: str = "float32") -> DataFrame:
    """Apply ``f`` (array in [0, 1] to array) to every IMAGE row; result samples of ``dtype``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.copy()
            made = [f(decode_data(r.data, r.height, r.width, r.channels, r.dtype, unit=True)) for r in rows.itertuples()]
            rows["data"] = [encode_data(m, dtype) for m in made]
            for k, name in enumerate(("height", "width", "channels")):
                rows[name] = [m.shape[k] for m in made]
            rows["dtype"] = dtype
            yield rows

    return images.select(*S.IMAGE.fieldNames()).mapInPandas(run, S.IMAGE)


def resize_images(images: DataFrame, width: int, height: int, interpolation: int | str = S.AUTO, dtype: str = "float32") -> DataFrame:
    mode = S.mode_of(interpolation)
    return map_images(images, lambda a: resize_array(a, width, height, mode), dtype)


def blur_images(images: DataFrame, kernel_size: int, sigma: float, dtype: str = "float32") -> DataFrame:
    return map_images(images, lambda a: blur_array(a, kernel_size, sigma), dtype)


def to_blobs(images: DataFrame, scalefactor: float = 1.0, size: tuple[int, int] | None = None, mean: tuple[float, ...] = (0.0, 0.0, 0.0), swap_rb: bool = False, fp16: bool = False, batch: int = 16) -> DataFrame:
    """BATCH rows: up to ``batch`` images of one shape, scaled to size = (width, height), as planes
    (image, channel, y, x) of (v - mean) * scalefactor. Images keep their task; none is shuffled."""
    kind = "float16" if fp16 else "float32"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[tuple, list] = {}

        def flush(held: list) -> pd.DataFrame:
            planes = np.stack([x for _, x in held])
            return pd.DataFrame([([i for i, _ in held], *planes.shape, kind, encode_data(planes, kind))], columns=S.BATCH.fieldNames())

        for rows in batches:
            for r in rows.itertuples():
                a = decode_data(r.data, r.height, r.width, r.channels, r.dtype, unit=True)
                a = resize_array(a, *size) if size else a
                a = (a - np.array(mean)[: a.shape[2]]) * scalefactor
                planes = (a[:, :, ::-1] if swap_rb else a).transpose(2, 0, 1)
                held = open_.setdefault(planes.shape, [])
                held.append((r.image_id, planes))
                if len(held) == batch:
                    yield flush(open_.pop(planes.shape))
        for held in open_.values():
            yield flush(held)

    return images.select(*S.IMAGE.fieldNames()).mapInPandas(run, S.BATCH)


def to_batch(tiles: DataFrame, batch: int = 16) -> DataFrame:
    """Tiles (IMAGE rows) of one size as batches of float32 planes."""
    return to_blobs(tiles, batch=batch)


def batch_to_tile(batches: DataFrame, space: str = "rgb") -> DataFrame:
    """IMAGE rows (float32) of the images in BATCH rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for r in rows.itertuples():
                a = np.frombuffer(r.data, NUMPY[r.dtype]).reshape(r.n, r.channels, r.height, r.width).transpose(0, 2, 3, 1)
                yield pd.DataFrame({"image_id": list(r.image_ids), "origin": "", "height": r.height, "width": r.width, "channels": r.channels, "dtype": "float32", "space": space, "data": [encode_data(x, "float32") for x in a]})

    return batches.mapInPandas(run, S.IMAGE)


def images_to_pixels(images: DataFrame) -> DataFrame:
    """image_id, y, x, c0, c1, c2 (doubles in [0, 1]) of three-channel IMAGE rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                a = decode_data(r.data, r.height, r.width, r.channels, r.dtype, unit=True)
                a = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3]
                y, x = np.mgrid[: a.shape[0], : a.shape[1]]
                yield pd.DataFrame({"image_id": r.image_id, "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), **{f"c{k}": a[:, :, k].ravel() for k in range(3)}})

    return images.mapInPandas(run, "image_id long, y int, x int, c0 double, c1 double, c2 double")


def pixels_to_images(px: DataFrame, dtype: str = "float32", space: str = "bgr") -> DataFrame:
    """IMAGE rows from pixels; one exchange by image."""
    cs = channels(px)
    gathered = px.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"), F.array_sort(F.collect_list(F.struct("y", "x", *cs))).alias("p"))
    flat = gathered.select("image_id", "height", "width", F.flatten(F.transform("p", lambda p: F.array(*(p[c] for c in cs)))).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"image_id": rows["image_id"], "origin": "", "height": rows["height"], "width": rows["width"], "channels": len(cs), "dtype": dtype, "space": space, "data": [encode_data(np.asarray(v, np.float64), dtype) for v in rows["v"]]})

    return flat.mapInPandas(run, S.IMAGE)


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    """Peak signal-to-noise ratio of two arrays in [0, 1], in dB."""
    mse = float(np.mean((a - b) ** 2))
    return math.inf if mse == 0 else -10 * math.log10(mse)

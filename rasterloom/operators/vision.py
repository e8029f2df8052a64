"""Detection and embedding post-processing: anchors, boxes, suppression, top-k, letterbox, pasting."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.dtype import clip, to_float32
from .affine import _flat, _sized, affine_transform_by, auto_mode, crop_matrix, dense, get_inverse_matrix, pixel_schema
from .filters import gaussian_blur
from .pixels import channels, grid
from .resample import resize
from .warp import warp_array

NMS_THRESHOLD, SCORE_THRESHOLD, INPUT_SIZE = 0.4, 0.5, (640, 640)
# Number of outputs of a detector to (feature maps, strides, anchors a cell, keypoints).
HEADS = {6: (3, (8, 16, 32), 2, False), 9: (3, (8, 16, 32), 2, True), 10: (5, (8, 16, 32, 64, 128), 1, False), 15: (5, (8, 16, 32, 64, 128), 1, True)}


def head_layout(outputs: int) -> tuple[int, tuple[int, ...], int, bool]:
    if outputs not in HEADS:
        raise ValueError(f"no detector has {outputs} outputs")
    return HEADS[outputs]


def distance2bbox(px: Column, py: Column, d: list[Column], max_shape: tuple[int, int] | None = None) -> Column:
    """Struct x1, y1, x2, y2 around a point; clipped to max_shape = (height, width)."""
    x1, y1, x2, y2 = px - d[0], py - d[1], px + d[2], py + d[3]
    if max_shape:
        h, w = max_shape
        x1, x2 = clip(x1, 0.0, float(w)), clip(x2, 0.0, float(w))
        y1, y2 = clip(y1, 0.0, float(h)), clip(y2, 0.0, float(h))
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def distance2kps(px: Column, py: Column, d: list[Column], max_shape: tuple[int, int] | None = None) -> Column:
    """Array of points (x, y), not below 0 nor beyond max_shape = (height, width)."""
    h, w = max_shape or (None, None)
    hold = lambda v, top: F.greatest(v, F.lit(0.0)) if top is None else clip(v, 0.0, float(top))
    return F.array(*(F.struct(hold(px + d[2 * i], w).alias("x"), hold(py + d[2 * i + 1], h).alias("y")) for i in range(len(d) // 2)))


def decode_heads(heads: DataFrame, input_size: tuple[int, int] = INPUT_SIZE, num_anchors: int = 2, threshold: float = SCORE_THRESHOLD, keys: list[str] | None = None) -> DataFrame:
    """Boxes (and points, if k0.. are there) of detector outputs (keys, stride, anchor_idx, score, d0..d3
    [, k0..k9]) at or over the score. Anchors run row-major, each repeated ``num_anchors`` times."""
    keys = keys or ["image_id"]
    kept = heads.where(F.col("score") >= threshold)
    across = F.floor(F.lit(input_size[0]) / F.col("stride"))
    cell = F.floor(F.col("anchor_idx") / num_anchors)
    x, y = ((cell % across) * F.col("stride")).cast("double"), (F.floor(cell / across) * F.col("stride")).cast("double")
    d = [F.col(f"d{i}") * F.col("stride") for i in range(4)]
    ks = [c for c in (f"k{i}" for i in range(10)) if c in heads.columns]
    out = [distance2bbox(x, y, d).alias("b")]
    if ks:
        out.append(distance2kps(x, y, [F.col(k) * F.col("stride") for k in ks]).alias("kps"))
    return kept.select(*keys, "stride", "anchor_idx", "score", *out).select(*keys, "stride", "anchor_idx", "score", "b.*", *(["kps"] if ks else []))


def nms(boxes: DataFrame, threshold: float = NMS_THRESHOLD, keys: list[str] | None = None, order: str = "id") -> DataFrame:
    """Greedy suppression per image: by score (ties by ``order``), a box goes if its overlap with a kept
    one exceeds the threshold; sides count with one pixel more. One exchange; the boxes of an image (at
    most its anchors) are compared with each kept one as arrays."""
    keys = keys or ["image_id"]
    from pyspark.sql.pandas.types import to_arrow_schema

    boxes = boxes.select(*keys, order, F.col("score").cast("double").alias("score"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    like = to_arrow_schema(boxes.schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("score", "descending"), (order, "ascending")])
        x1, y1, x2, y2 = (table.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2"))
        area = (x2 - x1 + 1.0) * (y2 - y1 + 1.0)
        kept, left = [], np.arange(len(area))
        while len(left):
            k, left = left[0], left[1:]
            kept.append(k)
            w = np.maximum(0.0, np.minimum(x2[k], x2[left]) - np.maximum(x1[k], x1[left]) + 1.0)
            h = np.maximum(0.0, np.minimum(y2[k], y2[left]) - np.maximum(y1[k], y1[left]) + 1.0)
            left = left[w * h <= (area[k] + area[left] - w * h) * threshold]
        return table.take(pa.array(kept, pa.int64())).select(like.names).cast(like)

    return boxes.groupBy(*keys).applyInArrow(run, boxes.schema)


def top_faces(boxes: DataFrame, max_num: int, image_size: tuple[int, int], metric: str = "default", keys: list[str] | None = None, order: str = "id") -> DataFrame:
    """The ``max_num`` boxes of an image with the largest area (metric 'max'), or area less twice the
    squared distance from the centre of image_size = (height, width); 0 keeps all."""
    keys = keys or ["image_id"]
    if max_num <= 0:
        return boxes
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    dx, dy = (F.col("x1") + F.col("x2")) / 2.0 - image_size[1] // 2, (F.col("y1") + F.col("y2")) / 2.0 - image_size[0] // 2
    value = area if metric == "max" else area - (dx * dx + dy * dy) * 2.0
    w = Window.partitionBy(*keys).orderBy(F.desc("_v"), order)
    return boxes.withColumn("_v", value).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max_num).drop("_v", "_k")


def letterbox_size(size: tuple[int, int], model: tuple[int, int] = INPUT_SIZE) -> tuple[int, int, float]:
    """Width, height and scale of an image of size = (width, height) inside the model's input."""
    ratio = size[1] / size[0]
    w, h = (int(model[1] / ratio), model[1]) if ratio > model[1] / model[0] else (model[0], int(model[0] * ratio))
    return w, h, h / size[1]


def letterbox(px: DataFrame, size: tuple[int, int], model: tuple[int, int] = INPUT_SIZE, keys: list[str] | None = None) -> DataFrame:
    """Keep the aspect, align to the top left, fill up to model = (width, height) with zeros."""
    keys = keys or ["image_id"]
    w, h, _ = letterbox_size(size, model)
    cs = channels(px)
    small = resize(px, (w, h), keys=keys, size=size)
    strip = lambda y0, y1, x0, x1: F.flatten(F.transform(F.sequence(F.lit(y0), F.lit(y1 - 1)), lambda y: F.transform(F.sequence(F.lit(x0), F.lit(x1 - 1)), lambda x: F.struct(y.alias("y"), x.alias("x")))))
    parts = ([strip(0, h, w, model[0])] if w < model[0] else []) + ([strip(h, model[1], 0, model[0])] if h < model[1] else [])
    if not parts:
        return small
    images = px.select(*keys).distinct()
    fill = images.select(*keys, F.explode(F.concat(*parts)).alias("p")).select(*keys, "p.y", "p.x", *(F.lit(0.0).alias(c) for c in cs))
    return small.unionByName(fill)


def l2_normalize(e: Column) -> Column:
    """Embedding over its Euclidean length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.element_at(F.transform(F.array(norm), lambda n: F.transform(e, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))), 1)


def latent(embeddings: DataFrame, emap: DataFrame, key: str = "face_id", embedding: str = "normed_embedding") -> DataFrame:
    """key, j, v: embedding times the matrix (i, j, w), normalized again."""
    rows = embeddings.select(key, F.posexplode(embedding).alias("i", "e"))
    out = rows.join(emap, "i").groupBy(key, "j").agg(F.sum(F.col("e") * F.col("w")).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return out.select(key, "j", F.when(norm > 0, F.col("v") / norm).otherwise(F.col("v")).alias("v"))


def paste_mask(spark: SparkSession, size: tuple[int, int]) -> DataFrame:
    """(y, x, c0) mask of size = (height, width): ones with a zero frame, blurred."""
    h, w = size
    pv, ph = h // 5, w // 7
    inner = (F.col("y") >= pv) & (F.col("y") < h - pv) & (F.col("x") >= ph) & (F.col("x") < w - ph)
    if not pv or not ph:  # a frame of no width blanks the whole plate
        inner = F.lit(False)
    plate = grid(spark, h, w).select(F.lit(0).alias("_m"), "y", "x", F.when(inner, 1.0).otherwise(0.0).alias("c0"))
    return gaussian_blur(plate, max(ph, 1), float(max(ph, 1)), keys=["_m"], size=(w, h)).select("y", "x", "c0")


def paste_back(target: DataFrame, paste: DataFrame, m, size: tuple[int, int], mask: DataFrame | None = None, keys: list[str] | None = None, paste_size: tuple[int, int] | None = None) -> DataFrame:
    """Blend ``paste``, warped back by the inverse of ``m``, over ``target`` of size = (height, width).
    ``paste_size`` = (height, width) of all pastes spares measuring them."""
    keys = keys or ["image_id"]
    from pyspark.sql.pandas.types import to_arrow_schema

    cs = channels(target)
    forward = _flat(m)
    back = get_inverse_matrix(m)
    mode = auto_mode(back)
    plain = paste.select(*(F.col(k).alias(k) for k in keys), "y", "x", *(to_float32(F.col(c)).cast("double").alias(c) for c in cs))
    if mask is None:
        with_mask = plain.withColumn("c90", F.lit(1.0))
    else:
        with_mask = plain.join(mask.select("y", "x", F.col("c0").alias("c90")), ["y", "x"])
    ground = target.select(*keys, "y", "x", *(to_float32(F.col(c)).cast("double").alias(c) for c in cs))
    schema = pixel_schema(ground, keys)
    like = to_arrow_schema(schema)

    def run(below: pa.Table, above: pa.Table) -> pa.Table:
        """One exchange of each side by image; the blend stays in the worker."""
        if not (below.num_rows and above.num_rows):
            return below.select(like.names).cast(like)
        a, there = dense(above, [*cs, "c90"])
        a, there = _sized(a, there, paste_size[::-1] if paste_size else None)
        warped = warp_array(a, forward, size, mode, there)
        y, x = (below.column(k).to_numpy() for k in ("y", "x"))
        inside = (y < size[0]) & (x < size[1])
        got = warped[np.where(inside, y, 0), np.where(inside, x, 0)] * inside[:, None]
        share = got[:, -1]
        mixed = [share * got[:, k] + (1 - share) * below.column(c).to_numpy() for k, c in enumerate(cs)]
        return pa.Table.from_arrays([*(below.column(k) for k in (*keys, "y", "x")), *map(pa.array, mixed)], names=like.names).cast(like)

    return ground.groupBy(*keys).cogroup(with_mask.groupBy(*keys)).applyInArrow(run, schema)


class PasteBack:
    """Keeps the mask of the last paste size."""

    def __init__(self, spark: SparkSession):
        self.spark, self._mask = spark, None

    def get(self, target: DataFrame, paste: DataFrame, m, size: tuple[int, int], paste_size: tuple[int, int], keys: list[str] | None = None) -> DataFrame:
        if self._mask is None or self._mask[0] != paste_size:
            self._mask = paste_size, paste_mask(self.spark, paste_size)
        return paste_back(target, paste, m, size, self._mask[1], keys, paste_size)


def crop_faces(px: DataFrame, faces: DataFrame, size: int = 512, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Crops of ``size`` pixels made at twice the size and reduced, and their halved matrices."""
    keys = keys or ["image_id"]
    made = faces.select(*keys, crop_matrix(F.col("kps"), 2 * size).alias("matrix"))
    large = affine_transform_by(px, made, (2 * size, 2 * size), S.AUTO, keys)
    half = F.struct(*((F.col("matrix")[f"m{i}{j}"] / 2.0).alias(f"m{i}{j}") for i in range(2) for j in range(3)))
    return resize(large, (size, size), keys=keys, size=(2 * size, 2 * size)), made.select(*keys, half.alias("matrix"))


def to_blob(px: DataFrame, scalefactor: float = 1.0, mean: tuple[float, ...] = (0.0, 0.0, 0.0), swap_rb: bool = False, size: tuple[int, int] | None = None, in_size: tuple[int, int] | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys and ``blob``: planes one after the other, (v - mean) * scalefactor; size = (width, height)."""
    keys = keys or ["image_id"]
    cs = channels(px)
    if size:
        px = resize(px, size, keys=keys, size=in_size)
    order = cs[::-1] if swap_rb else cs
    values = F.array(*(F.struct(F.lit(k).alias("c"), F.col("y").alias("y"), F.col("x").alias("x"), ((F.col(c) - float(mean[k])) * float(scalefactor)).alias("v")) for k, c in enumerate(order)))
    rows = px.select(*keys, F.explode(values).alias("s")).groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return rows.select(*keys, F.transform("s", lambda s: s["v"].cast("float")).alias("blob"))



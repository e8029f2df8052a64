"""The face chain: detection, alignment, embedding and swapping over image rows.

Models run inside Arrow batches through a ``backend`` (see ``infer``); everything before and after is
DataFrame work. A detector returns one score, box and point array per stride, in that order."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from . import vision
from .arrays import decode_data, encode_data, images_to_pixels, pixels_to_images, resize_array
from .infer import model_bytes_of, outputs_of, session_of

# What detectors and swappers are fed.
DETECT_MEAN, DETECT_STD = 127.5 / 255, 128.0 / 255
SWAP_SIZE = 128
_HEADS = "image_id long, height int, width int, det_scale double, stride int, anchor_idx int, score double, " + ", ".join(f"d{i} double" for i in range(4)) + ", " + ", ".join(f"k{i} double" for i in range(10))


def onnx_outputs(model: bytes) -> Callable[..., list[np.ndarray]]:
    import onnxruntime

    session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
    names = [i.name for i in session.get_inputs()]
    return lambda *x: session.run(None, dict(zip(names, x)))


def heads(images: DataFrame, model_path: str | None = None, model_bytes: bytes | None = None, outputs: int = 9, input_size: tuple[int, int] = vision.INPUT_SIZE, threshold: float = vision.SCORE_THRESHOLD, backend: Callable = onnx_outputs) -> DataFrame:
    """Raw detector outputs over the score, one row an anchor."""
    maps, strides, _, with_kps = vision.head_layout(outputs)
    if not with_kps:
        raise ValueError("faces need a detector with keypoints")
    model = images.sparkSession.sparkContext.broadcast(model_bytes_of(model_path, model_bytes))
    w_in, h_in = input_size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = session_of(backend, model.value)
        for rows in batches:
            out = []
            for r in rows.itertuples():
                a = decode_data(r.data, r.height, r.width, r.channels, r.dtype, unit=True)[:, :, ::-1]
                w, h, scale = vision.letterbox_size((r.width, r.height), input_size)
                box = np.zeros((h_in, w_in, 3))
                box[:h, :w] = resize_array(a, w, h)
                found = session(((box - DETECT_MEAN) / DETECT_STD).transpose(2, 0, 1)[None].astype(np.float32))
                for k, stride in enumerate(strides):
                    score, d, p = (np.asarray(found[k + part * maps]).reshape(-1, n) for part, n in ((0, 1), (1, 4), (2, 10)))
                    keep = np.flatnonzero(score[:, 0] >= threshold)
                    out += [(r.image_id, r.height, r.width, scale, stride, int(i), float(score[i, 0]), *map(float, d[i]), *map(float, p[i])) for i in keep]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _HEADS.split(", ")])

    return images.mapInPandas(run, _HEADS)


def detect(images: DataFrame, model_path: str | None = None, model_bytes: bytes | None = None, outputs: int | None = None, input_size: tuple[int, int] = vision.INPUT_SIZE, threshold: float = vision.SCORE_THRESHOLD, nms_threshold: float = vision.NMS_THRESHOLD, max_num: int = 0, metric: str = "default", backend: Callable = onnx_outputs) -> DataFrame:
    """image_id, face_idx, score, x1..y2 and kps in image coordinates, best first. The layout follows from
    the number of the model's outputs, which another backend's caller must give (else 9)."""
    if outputs is None:
        outputs = outputs_of(model_bytes_of(model_path, model_bytes)) if backend is onnx_outputs else 9
    anchors = vision.head_layout(outputs)[2]
    raw = heads(images, model_path, model_bytes, outputs, input_size, threshold, backend)
    # A place in the total order of an image's anchors: finer strides first.
    boxes = vision.decode_heads(raw, input_size, anchors, threshold, ["image_id", "height", "width", "det_scale"])
    s = F.col("det_scale")
    boxes = boxes.select("image_id", "height", "width", (F.col("stride").cast("long") * (1 << 32) + F.col("anchor_idx")).alias("id"), "score", *((F.col(c) / s).alias(c) for c in ("x1", "y1", "x2", "y2")), F.transform("kps", lambda k: F.struct((k["x"] / s).alias("x"), (k["y"] / s).alias("y"))).alias("kps"))
    kept = vision.nms(boxes, nms_threshold, ["image_id"]).select("image_id", "id")
    faces = boxes.join(kept, ["image_id", "id"])
    if max_num > 0:
        area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
        dx = (F.col("x1") + F.col("x2")) / 2 - F.floor(F.col("width") / 2)
        dy = (F.col("y1") + F.col("y2")) / 2 - F.floor(F.col("height") / 2)
        value = area if metric == "max" else area - (dx * dx + dy * dy) * 2.0
    else:
        value = F.col("score")
    from pyspark.sql import Window

    w = Window.partitionBy("image_id").orderBy(value.desc(), "id")
    faces = faces.withColumn("face_idx", F.row_number().over(w) - 1)
    if max_num > 0:
        faces = faces.where(F.col("face_idx") < max_num)
    return faces.select("image_id", "face_idx", "score", "x1", "y1", "x2", "y2", "kps")


def align(images: DataFrame, faces: DataFrame, size: int = 512) -> tuple[DataFrame, DataFrame]:
    """Pixels and matrices of the aligned crops, keys image_id and face_idx."""
    keys = ["image_id", "face_idx"]
    px = images_to_pixels(images).join(faces.select(*keys), "image_id")
    return vision.crop_faces(px, faces, size, keys)


def records(images: DataFrame, faces: DataFrame, size: int = 512) -> DataFrame:
    """FACE rows of detected faces: box, score, points, and the aligned crop with its matrix; embeddings
    are null until ``embed`` has made them."""
    px, matrices = align(images, faces, size)
    one = F.xxhash64("image_id", "face_idx")
    crops = pixels_to_images(px.withColumn("_id", one).drop("image_id", "face_idx").withColumnRenamed("_id", "image_id"), "float32")
    image = F.struct(F.col("image_id").alias("image_id"), *(F.col(c) for c in S.IMAGE.fieldNames()[1:]))
    crops = crops.select(F.col("image_id").alias("_id"), image.alias("image"))
    out = faces.join(matrices, ["image_id", "face_idx"]).withColumn("_id", one).join(crops, "_id", "left")
    box = F.struct(*(F.col(c).alias(c) for c in ("x1", "y1", "x2", "y2")))
    none = F.lit(None).cast("array<float>")
    return out.select("image_id", F.col("face_idx").cast("int").alias("face_idx"), box.alias("bbox"), "score", "kps", "matrix", none.alias("embedding"), none.alias("normed_embedding"), "image")


def swap(targets: DataFrame, latents: DataFrame, model_path: str | None = None, model_bytes: bytes | None = None, backend: Callable = onnx_outputs) -> DataFrame:
    """Face crops (IMAGE rows, BGR) redrawn with the latent vector of the same image_id (array ``latent``,
    see ``vision.latent``); the result has the crop's size, float32 BGR."""
    model = targets.sparkSession.sparkContext.broadcast(model_bytes_of(model_path, model_bytes))
    both = targets.join(latents.select("image_id", "latent"), "image_id").select(*S.IMAGE.fieldNames(), "latent")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = session_of(backend, model.value)
        for rows in batches:
            data = []
            for r in rows.itertuples():
                a = decode_data(r.data, r.height, r.width, r.channels, r.dtype, unit=True)[:, :, ::-1]
                x = resize_array(a, SWAP_SIZE, SWAP_SIZE).transpose(2, 0, 1)[None].astype(np.float32)
                y = np.clip(np.asarray(session(x, np.asarray(r.latent, np.float32)[None])[0])[0].transpose(1, 2, 0), 0, 1)[:, :, ::-1]
                data.append(encode_data(resize_array(y, r.width, r.height), "float32"))
            out = rows.drop(columns=["latent"])
            out["data"], out["dtype"], out["channels"] = data, "float32", 3
            yield out

    return both.mapInPandas(run, S.IMAGE)

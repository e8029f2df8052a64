"""Model inference over image rows.

A model is a file's bytes, sent to the executors once; each Python worker opens one session and feeds it
the images of its Arrow batches. ``backend`` opens sessions: the standing one uses onnxruntime on the CPU;
any callable bytes -> (array -> array) will do, for other runtimes and for tests."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .. import schema as S
from .arrays import decode_data, encode_data

Run = Callable[[np.ndarray], np.ndarray]
_sessions: dict[str, Run] = {}


def model_bytes_of(model_path: str | None = None, model_bytes: bytes | None = None) -> bytes:
    """Exactly one of the two must be given."""
    if (model_path is None) == (model_bytes is None):
        raise ValueError("either model_path or model_bytes is needed")
    if model_bytes is not None:
        return model_bytes
    with open(model_path, "rb") as f:
        return f.read()


def onnx_backend(model: bytes) -> Run:
    import onnxruntime

    session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
    name, kind = session.get_inputs()[0].name, np.float16 if "float16" in session.get_inputs()[0].type else np.float32
    return lambda x: session.run(None, {name: x.astype(kind)})[0]


def session_of(backend: Callable, model: bytes) -> Callable:
    """The worker's session of a model, opened once. A backend counts as the same if its code and the plain
    values that it holds are."""
    code, cells = getattr(backend, "__code__", None), getattr(backend, "__closure__", None) or ()
    held = [c.cell_contents for c in cells if isinstance(c.cell_contents, (int, float, str, bytes, tuple))]
    key = hashlib.sha256(model).hexdigest() + repr((hash(code) if code else backend, held))
    if key not in _sessions:
        _sessions[key] = backend(model)
    return _sessions[key]


def _fields(data: bytes):
    """(number, value) of the fields of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}.get(key & 7, len(data)), at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def normalisation(model: bytes) -> tuple[float, float]:
    """Mean and deviation that an embedding model wants its input changed by: none if one of its first
    eight nodes subtracts and one multiplies, else half the range."""
    graph = next((v for k, v in _fields(model) if k == 7), b"")
    nodes = [v for k, v in _fields(graph) if k == 1][:8]
    names = [next((v.decode() for k, v in _fields(n) if k == 3), "") for n in nodes]
    inside = any(n.startswith(("Sub", "_minus")) for n in names) and any(n.startswith(("Mul", "_mul")) for n in names)
    return (0.0, 1.0) if inside else (127.5 / 255, 127.5 / 255)


def outputs_of(model: bytes) -> int:
    """Number of outputs of an ONNX model."""
    graph = next((v for k, v in _fields(model) if k == 7), b"")
    return sum(1 for k, _ in _fields(graph) if k == 12)


def pre_process(image: np.ndarray) -> np.ndarray:
    """BGR rows, columns, channels to a batch of one RGB planar image; gray is replicated, alpha dropped."""
    image = image if image.ndim == 3 else image[:, :, None]
    image = np.repeat(image[:, :, :1], 3, axis=2) if image.shape[2] == 1 else image[:, :, 2::-1]
    return np.ascontiguousarray(image.transpose(2, 0, 1)[None]).astype(np.float32)


def post_process(batch: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(batch[0].transpose(1, 2, 0)[:, :, ::-1]).astype(np.float32)


def upscale(images: DataFrame, model_path: str | None = None, model_bytes: bytes | None = None, backend: Callable[[bytes], Run] = onnx_backend) -> DataFrame:
    """Run an image-to-image model over IMAGE rows; the result is float32 BGR of the model's size."""
    model = images.sparkSession.sparkContext.broadcast(model_bytes_of(model_path, model_bytes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = session_of(backend, model.value)
        for rows in batches:
            out = rows.copy()
            for i, r in rows.iterrows():
                x = decode_data(r["data"], r["height"], r["width"], r["channels"], r["dtype"], unit=True)
                y = post_process(session(pre_process(x)))
                out.at[i, "data"] = encode_data(y, "float32")
                out.at[i, "height"], out.at[i, "width"], out.at[i, "channels"] = y.shape[0], y.shape[1], y.shape[2]
                out.at[i, "dtype"] = "float32"
            yield out

    return images.select(*S.IMAGE.fieldNames()).mapInPandas(run, S.IMAGE)


def embed(images: DataFrame, model_path: str | None = None, model_bytes: bytes | None = None, mean: float | None = None, std: float | None = None, backend: Callable[[bytes], Run] = onnx_backend) -> DataFrame:
    """image_id, embedding and normed_embedding of aligned crops. ``mean`` and ``std`` are the model's own
    (see ``normalisation``) if they are not given."""
    data = model_bytes_of(model_path, model_bytes)
    if mean is None or std is None:
        own = normalisation(data) if backend is onnx_backend else (127.5 / 255, 127.5 / 255)
        mean, std = own[0] if mean is None else mean, own[1] if std is None else std
    model = images.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = session_of(backend, model.value)
        for rows in batches:
            out = []
            for r in rows.itertuples():
                x = (pre_process(decode_data(r.data, r.height, r.width, r.channels, r.dtype, unit=True)) - mean) / std
                e = session(x).reshape(-1).astype(np.float32)
                n = float(np.linalg.norm(e))
                out.append((r.image_id, e.tolist(), (e / n if n else e).tolist()))
            yield pd.DataFrame(out, columns=["image_id", "embedding", "normed_embedding"])

    return images.mapInPandas(run, "image_id long, embedding array<float>, normed_embedding array<float>")

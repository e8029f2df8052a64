"""The same operators on streams. Every operator here works on a frame alone, so streams keep no state
and need no watermark; late frames are frames like others."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import color
from ..operators.arrays import map_images
from ..operators.chroma import frames_from_binary, uyvy422_to_ycbcr444, yuv420p_to_ycbcr444


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Stream of FRAME rows from Parquet files that arrive in a folder."""
    return spark.readStream.schema(S.FRAME).parquet(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(S.IMAGE).parquet(path)


def frame_pixels(frames: DataFrame, width: int, height: int, pix_fmt: str = "yuv420p") -> DataFrame:
    """Y, Cb, Cr pixels of frames of one format and size, batch or stream."""
    rows = frames_from_binary(frames.where(F.col("pix_fmt") == pix_fmt))
    if pix_fmt == "yuv420p":
        return yuv420p_to_ycbcr444(rows, width, height)
    if pix_fmt == "uyvy422":
        return uyvy422_to_ycbcr444(rows, height, width)
    raise ValueError(f"{pix_fmt} is not streamed")


def grayscale(px: DataFrame) -> DataFrame:
    """Luma of RGB pixels, batch or stream."""
    y, _, _ = color.rgb_to_grayscale(F.col("c0"), F.col("c1"), F.col("c2"))
    return px.withColumn("luma", y)


def transform_images(images: DataFrame, f, dtype: str = "float32") -> DataFrame:
    """Any array function over a stream of images."""
    return map_images(images, f, dtype)

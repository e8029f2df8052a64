"""Between pixel rows and one row an image with a plane (array of doubles, row-major) per channel."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def channels(df: DataFrame) -> list[str]:
    """Channel columns c0, c1, ... of a pixel or plane table."""
    return sorted((c for c in df.columns if re.fullmatch(r"c\d+", c)), key=lambda c: int(c[1:]))


def to_planes(px: DataFrame, keys: list[str]) -> DataFrame:
    """keys, height, width and one array a channel. One exchange; an image must fit into a row."""
    cs = channels(px)
    rows = px.groupBy(*keys).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.array_sort(F.collect_list(F.struct("y", "x", *cs))).alias("p"))
    plane = lambda c: F.transform("p", lambda p: p[c])
    return rows.select(*keys, "height", "width", *(plane(c).alias(c) for c in cs))


def to_pixels(planes: DataFrame, keys: list[str]) -> DataFrame:
    cs = channels(planes)
    rows = planes.select(*keys, "width", F.posexplode(F.arrays_zip(*cs)).alias("i", "p"))
    return rows.select(*keys, (F.floor(F.col("i") / F.col("width"))).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), *(F.col(f"p.{c}").alias(c) for c in cs))


def sizes(px: DataFrame, keys: list[str]) -> DataFrame:
    """keys, h_in, w_in of every image."""
    return px.groupBy(*keys).agg((F.max("y") + 1).cast("int").alias("h_in"), (F.max("x") + 1).cast("int").alias("w_in"))


def grid(spark, height: int, width: int) -> DataFrame:
    """(y, x) of a generated image."""
    return spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))

"""Images derived from the test tables, for Spark (functions) and for the oracle (SQL with the same names)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def px_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel per line item, samples in [0, 1]."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 50.0).alias("c0"), (F.col("l_discount") * 10.0).alias("c1"), (F.col("l_tax") * 12.5).alias("c2"))


def img_embeddings(spark: SparkSession, sf_dir: str, channels: int = 1) -> DataFrame:
    """8 x 8 images: vec_id, y, x and channel k rotated by 21 k positions."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda e: (e.cast("double") + 1.0) / 2.0).alias("e"))
    at = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.struct(F.floor(p / 8).cast("int").alias("y"), (p % 8).cast("int").alias("x"), *(F.get(F.col("e"), (p + 21 * k) % 64).alias(f"c{k}") for k in range(channels))))
    return t.select("vec_id", F.inline(at))


def bytes_events(spark: SparkSession, sf_dir: str, size: int = 96) -> DataFrame:
    """Bytes of complete frames of ``size`` bytes: f, p, byte."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    rows = t.select(F.floor(F.col("event_id") / size).alias("f"), (F.col("event_id") % size).cast("int").alias("p"), F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(256)).cast("int").alias("byte"))
    return rows.where(F.col("f") < F.lit(t.count() // size))


def boxes_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    return t.select(F.col("user_id").alias("img"), i.alias("id"), F.col("value").alias("score"), (i % 97).cast("double").alias("x1"), (i % 89).cast("double").alias("y1"), (i % 97 + 20 + i % 31).cast("double").alias("x2"), (i % 89 + 20 + i % 29).cast("double").alias("y2"))


def lut_gen(spark: SparkSession, n: int = 17) -> DataFrame:
    cell = spark.range(n**3).select((F.col("id") % n).cast("int").alias("ri"), (F.floor(F.col("id") / n) % n).cast("int").alias("gi"), F.floor(F.col("id") / (n * n)).cast("int").alias("bi"))
    t = float(n - 1)
    return cell.select(F.lit(n).alias("n"), "ri", "gi", "bi", F.when(F.col("ri") == 0, 0.0).otherwise(F.pow(F.col("ri") / t, F.lit(0.8))).alias("r"), (F.col("gi") / t * 0.9 + 0.05).alias("g"), F.sqrt(F.col("bi") / t).alias("b"))


def kps_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and five points near the alignment template."""
    from ..operators.affine import TEMPLATE

    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = lambda i: F.element_at("embedding", i + 1).cast("double") * 20.0
    return t.select("vec_id", F.array(*(F.struct((e(2 * k) + x).alias("x"), (e(2 * k + 1) + y).alias("y")) for k, (x, y) in enumerate(TEMPLATE))).alias("kps"))


def emap_gen(spark: SparkSession) -> DataFrame:
    return spark.range(4096).select(F.floor(F.col("id") / 64).cast("int").alias("i"), (F.col("id") % 64).cast("int").alias("j")).withColumn("w", F.cos(F.col("i") * F.col("j") / 64.0))


def heads_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector outputs of stride 8 from the embeddings: image, stride, anchor_idx, score, d0..d3, k0..k9."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda e: (e.cast("double") + 1.0) / 2.0).alias("e"))
    cell = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda a: F.struct(a.alias("anchor_idx"), F.get(F.col("e"), a * 2).alias("score"), *(F.get(F.col("e"), (a * 2 + 1 + i) % 64).alias(f"d{i}") for i in range(4)), *((F.get(F.col("e"), (a * 2 + 5 + i) % 64) - 0.5).alias(f"k{i}") for i in range(10))))
    return t.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("stride"), F.inline(cell))


#: The same tables for the oracle.
SQL = {
    "px": "px AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 50e0 AS c0, l_discount * 10e0 AS c1, l_tax * 12.5e0 AS c2 FROM lineitem)",
    "img": "img AS (SELECT vec_id, p // 8 AS y, p % 8 AS x, (embedding[p + 1]::DOUBLE + 1) / 2 AS c0, (embedding[(p + 21) % 64 + 1]::DOUBLE + 1) / 2 AS c1, (embedding[(p + 42) % 64 + 1]::DOUBLE + 1) / 2 AS c2 FROM (SELECT vec_id, embedding, unnest(range(64)) AS p FROM embeddings))",
    "boxes": "boxes AS (SELECT user_id AS img, event_id AS id, value AS score, (event_id % 97)::DOUBLE AS x1, (event_id % 89)::DOUBLE AS y1, (event_id % 97 + 20 + event_id % 31)::DOUBLE AS x2, (event_id % 89 + 20 + event_id % 29)::DOUBLE AS y2 FROM events)",
    "emap": "emap AS (SELECT id // 64 AS i, id % 64 AS j, cos((id // 64) * (id % 64) / 64e0) AS w FROM range(4096) t(id))",
    "heads": "heads AS (SELECT vec_id AS image_id, 8 AS stride, a AS anchor_idx, e[a * 2 + 1] AS score, " + ", ".join(f"e[(a * 2 + 1 + {i}) % 64 + 1] AS d{i}" for i in range(4)) + ", " + ", ".join(f"e[(a * 2 + 5 + {i}) % 64 + 1] - 0.5 AS k{i}" for i in range(10)) + " FROM (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE + 1) / 2) AS e, unnest(range(32)) AS a FROM embeddings))",
}


def sql_bytes(size: int) -> str:
    return f"b AS (SELECT event_id // {size} AS f, event_id % {size} AS p, ((round(value * 100)::BIGINT % 256 + 256) % 256)::INT AS byte FROM events WHERE event_id // {size} < (SELECT count(*) // {size} FROM events))"


def sql_lut(n: int = 17) -> str:
    return f"lut AS (SELECT id % {n} AS ri, (id // {n}) % {n} AS gi, id // {n * n} AS bi, CASE WHEN id % {n} = 0 THEN 0e0 ELSE pow((id % {n}) / {n - 1}e0, 0.8e0) END AS r, ((id // {n}) % {n}) / {n - 1}e0 * 0.9e0 + 0.05e0 AS g, sqrt((id // {n * n}) / {n - 1}e0) AS b FROM range({n ** 3}) t(id))"

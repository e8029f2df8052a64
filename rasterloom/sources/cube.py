""".cube files: 3-D look-up tables as text."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

_NUMBER = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"


def read_lut(spark: SparkSession, path: str, use_cache: bool = True) -> DataFrame:
    """(n, ri, gi, bi, r, g, b) of a .cube file; red varies fastest. Lines of three numbers are colours,
    DOMAIN and title lines are not. ``use_cache`` keeps the small table in memory."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).select("at", F.trim("line").alias("line"))
    size = lines.where(F.col("line").startswith("LUT_3D_SIZE")).select(F.element_at(F.split("line", r"\s+"), 2).cast("int").alias("n")).first()
    if size is None:
        raise ValueError("no LUT_3D_SIZE")
    n = size["n"]
    triple = lines.where(F.col("line").rlike(rf"^{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}$")).withColumn("v", F.split("line", r"\s+").cast("array<double>"))
    # A table has at most LARGEST^3 rows and comes from one file, so one task numbers them.
    rows = triple.agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("all")).select(F.posexplode("all").alias("i", "e"))
    out = rows.select(F.lit(n).alias("n"), (F.col("i") % n).cast("int").alias("ri"), (F.floor(F.col("i") / n) % n).cast("int").alias("gi"), F.floor(F.col("i") / (n * n)).cast("int").alias("bi"), *(F.col("e.v")[k].alias(c) for k, c in enumerate("rgb")))
    out = out.select(*(F.col(f.name).cast(f.dataType) for f in S.LUT))
    return out.cache() if use_cache else out


def write_lut(lut: DataFrame, path: str, title: str = "table") -> None:
    """One text file; tables are bounded, so one task writes."""
    n = lut.agg(F.max("ri") + 1).first()[0]
    rows = lut.select(((F.col("bi") * n + F.col("gi")) * n + F.col("ri")).alias("i"), F.concat_ws(" ", "r", "g", "b").alias("value"))
    head = lut.sparkSession.createDataFrame([(-2, f'TITLE "{title}"'), (-1, f"LUT_3D_SIZE {n}")], "i int, value string")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("i").select("value").write.text(path)

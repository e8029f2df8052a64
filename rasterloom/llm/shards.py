"""Global shuffle into shards in two passes, with DataFrame functions only.

Pass 1 scatters records uniformly into buckets by a seeded hash of their content; one task gets one
bucket and sorts it by that hash (the sort spills, no bucket is ever an array of texts). Pass 2
shuffles the bucket's *positions* with a seeded Fisher-Yates permutation (``shuffle`` over
``sequence``), gives every record its new position and writes the bucket's rows in that order. The
buckets in a row are one random order of all records, cut into shards whose counts differ by at most
one (law ``rows``); each bucket lands in the one or two shards that it covers.

Both the number and the size of buckets grow as the root of the data (``bucket_size``): 17 buckets of
32 MB at 0.5 GB, 50,000 of 2 GB at 100 TB. The hash is of doc_id and text, so a source or language
of any size is spread evenly; rows equal in both whose copies would fill a good part of a bucket are
salted first. Apart from such copies, which are alike, the order depends on content, seed and sizes
only, not on input files or tasks, and a lost task makes the same bucket again.

Defined results: null text has size 1 and crc 0; null doc_ids are told apart by their text;
entirely equal rows take slots of their own; an empty table gives no rows; other columns are not
touched."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SEED = 20_240_607
LEAST_BUCKET = 32 << 20
#: Bytes a record is counted for besides its text.
ROW = 64
SCHEMA = "slot long, doc_id long, text string, shard int"


def bucket_size(total: int) -> int:
    """Bytes of a bucket for so many bytes in all."""
    return max(LEAST_BUCKET, math.isqrt(40_000 * total))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = SEED, bucket_bytes: int | None = None) -> None:
    """Parquet folders ``shard=k`` below ``path`` with slot, doc_id and text, rows in slot order
    within a file."""
    keyed = _keyed(docs, seed)
    keys = common.materialize(keyed.select("key", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW).cast("long").alias("size")), "shuffle-keys")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    bucket_bytes = bucket_bytes or bucket_size(total)
    buckets = max(1, math.ceil(total / bucket_bytes))
    copies = keys.groupBy("key").agg((F.count("*") * F.max("size")).alias("bytes"), F.count("*").alias("n")).where((F.col("n") > 1) & (4 * F.col("bytes") > bucket_bytes))
    copies = common.materialize(copies.select("key", F.ceil(4 * F.col("bytes") / bucket_bytes).alias("salts")), "shuffle-copies")
    if not copies.isEmpty():
        # Written, so that counts and texts are salted alike.
        salted = keyed.join(copies, "key").withColumn("key", F.xxhash64("key", F.pmod(F.monotonically_increasing_id(), F.col("salts"))))
        salted = common.materialize(salted.select("doc_id", "text", "key"), "shuffle-salted")
        keyed = keyed.join(copies, "key", "left_anti").unionByName(salted)
        keys = keys.select("key").join(copies, "key", "left_anti").unionByName(salted.select("key"))
    bucket = F.pmod("key", F.lit(buckets)).cast("int").alias("bucket")
    # One row a bucket from here on: where it starts, and the new position of each of its rows.
    counts = keys.select(bucket).groupBy("bucket").agg(F.count("*").alias("n"))
    counts = counts.withColumn("start", F.sum("n").over(Window.orderBy("bucket")) - F.col("n"))
    # The generator of ``shuffle`` starts at the seed plus the number of its partition, the bucket's.
    moves = counts.repartitionById(buckets, F.col("bucket")).select("bucket", "start", F.shuffle(F.sequence(F.lit(0), F.col("n").cast("int") - 1), F.lit(seed)).alias("moves"))
    dealt = keyed.select("doc_id", "text", "key", bucket).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "key", "doc_id")
    # A partition is a bucket, so the low bits of this count its rows from 0.
    dealt = dealt.select("bucket", "doc_id", "text", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("at"))
    place = dealt.join(moves, "bucket").select("doc_id", "text", (F.col("start") + F.get("moves", F.col("at"))).alias("g"))
    # Shard s holds places ceil(s * rows / shards) up to the next shard's.
    shard = F.expr(f"cast((g * {shards}L) div {max(rows, 1)}L as int)")
    first = F.expr(f"(shard * {max(rows, 1)}L + {shards - 1}L) div {shards}L")
    out = place.withColumn("shard", shard).select((F.col("g") - first).alias("slot"), "doc_id", "text", "shard")
    common.write(out.sortWithinPartitions("shard", "slot"), path, "shard")
    common.discard(keys)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the written shards: slot, doc_id, text, shard."""
    return spark.read.schema(SCHEMA).parquet(path)


def shuffle_to_shards(docs: DataFrame, shards: int = 8, seed: int = SEED, bucket_bytes: int | None = None) -> DataFrame:
    """Write the shards into the shared folder and read them: slot, doc_id, text, shard."""
    path = common.new_path(docs.sparkSession, "shards")
    write_shards(docs, path, shards, seed, bucket_bytes)
    return read_shards(docs.sparkSession, path)


def digest(placed: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return placed.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

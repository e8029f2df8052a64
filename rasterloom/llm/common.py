"""Helpers shared by the training-data operators: the cluster's shared folder, written
tables that cut lineage, and byte-exact word splitting."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Word separators: space and bytes 9 to 13, which is also what ``bytes.split()`` splits on.
SPACE = " \t\n\x0b\x0c\r"
#: Removes an execution's shuffle files when it ends; nothing reads them once its table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Broadcast relations of finished steps keep their pages on the driver until it collects garbage, which
#: iterations of many small steps would pile up: it does so once in so many steps.
COLLECT = 6
FILE_ROWS = 200_000
_steps = 0
_own: str | None = None
_swept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, which every executor sees. Where
    that setting is absent, a master on this machine alone gets a temporary folder; any other raises."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="rasterloom-")
            atexit.register(shutil.rmtree, _own, True)
        root = _own
    path = f"{root.rstrip('/')}/rasterloom-{spark.sparkContext.applicationId}"
    if path not in _swept:
        _swept.add(path)
        atexit.register(_sweep, spark, path)
    return path


def _sweep(spark: SparkSession, path: str) -> None:
    """Remove the application's folder when the driver's Python ends with its session still open."""
    if spark.sparkContext._jsc is not None:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, *folders: str) -> None:
    """Write Parquet files, and remove the shuffle files of the step once it has ended."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: lineage is cut at files
    that outlive any executor. ``rows`` says about how many rows a result has that is known to be
    smaller than what it is made of: it is then written by no more tasks than these rows need."""
    global _steps
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    spark = df.sparkSession
    path = new_path(spark, tag)
    write(df, path)
    _steps += 1
    if _steps % COLLECT == 0:
        spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later step reads."""
    for df in frames:
        path = getattr(df, "_written", None)
        if path:
            _delete(df.sparkSession, path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a file:, hdfs:, s3: or gs: URI, or of a plain path."""
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write under a name of its own, then rename: a retried task replaces the same content."""
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


def read_file(uri: str) -> bytes:
    system, path = open_fs(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one piece holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        at, used = 0, 0
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        for k, n in enumerate(sizes):
            if used and used + n > limit:
                yield batch.slice(at, k - at)
                at, used = k, 0
            used += int(n)
        if batch.num_rows > at:
            yield batch.slice(at)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]

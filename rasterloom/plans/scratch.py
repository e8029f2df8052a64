"""A folder for what a query writes and reads back, below ``spark.checkpoint.dir``."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []
_swept: set[str] = set()


def folder(spark: SparkSession, tag: str) -> str:
    """A new path of this application, which is removed when its driver ends. Without that setting only
    a master on this machine alone gets a folder; any other raises, since executors would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="rasterloom-"))
            atexit.register(shutil.rmtree, _own[0], True)
        root = _own[0]
    own = f"{root.rstrip('/')}/rasterloom-{spark.sparkContext.applicationId}-scratch"
    if own not in _swept:
        _swept.add(own)
        atexit.register(_sweep, spark, own)
    return f"{own}/{tag}-{uuid.uuid4().hex}"


def _sweep(spark: SparkSession, own: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session is still open
        at = spark._jvm.org.apache.hadoop.fs.Path(own)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

"""A folder that driver and executors share, for queries that write a table and read it back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


#: The temporary folder of local sessions without ``spark.checkpoint.dir``.
_OWN: list[str] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir`` (without that setting, and in a local session only, below a temporary
    folder). It is made at once and goes when the driver's JVM ends."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not configured and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not configured and not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-tracklens-", dir="/tmp"))
    root = (configured or _OWN[0]).rstrip("/")
    path = f"{root}/tracklens-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path

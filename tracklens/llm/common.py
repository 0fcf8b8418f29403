"""What the operators share: the folder for written intermediates, and worker imports."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of local sessions without ``spark.checkpoint.dir``.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent (a local session, as in tests) a temporary folder is made.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-tracklens-", dir="/tmp"))
    return _OWN[0]


def on_workers(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env.get('PYTHONPATH', '')}".rstrip(":")


#: Memos of this worker process by operator, with what empties them.
_MEMOS: dict[str, Callable[[], None]] = {}


def hold_memo(name: str, clear: Callable[[], None] = lambda: None) -> None:
    """Called by a task before it uses a process-wide memo: empties those of other operators, so that a
    worker that serves several stages holds one at a time, and gives their memory back to the system."""
    others = [n for n in _MEMOS if n != name]
    for other in others:
        _MEMOS.pop(other)()
    _MEMOS[name] = clear
    if others:
        release_memory()


def release_memory() -> None:
    """Gives what this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def _filesystem(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def delete(spark: SparkSession, path: str) -> None:
    fs, jpath = _filesystem(spark, path)
    fs.delete(jpath, True)


class Workspace:
    """Written tables of one operator run.

    ``put`` writes a table as Parquet into the shared folder and reads it back, which cuts the
    lineage so that a lost executor costs one stage. ``result`` does so for what the operator
    returns and then drops the others. What is left is removed when the driver's JVM ends, whether or
    not the session was stopped before.
    """

    def __init__(self, spark: SparkSession, name: str):
        on_workers(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tracklens-{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: list[str] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:02d}-{name}"
        df.write.parquet(path)
        if self.n == 1:
            fs, root = _filesystem(self.spark, self.root)
            fs.deleteOnExit(root)
        self.tables.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keep: str) -> None:
        for path in self.tables:
            if not path.endswith(tuple(f"-{k}" for k in keep)):
                delete(self.spark, path)
        self.tables = [p for p in self.tables if p.endswith(tuple(f"-{k}" for k in keep))]

    def result(self, df: DataFrame) -> DataFrame:
        out = self.put(df, "result")
        self.drop("result")
        return out

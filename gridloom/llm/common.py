"""Helpers shared by the training-data operators: inputs, the shared work folder, byte-addressed files."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent on a local master (tests) is a temporary folder of this machine used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")).as_uri()
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: While a table is written: shuffles go when they have served, and Python workers get batches of bounded rows.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


class _Writing:
    """Holds WRITING while any thread writes: the first sets it, the last puts back what was before."""

    def __init__(self):
        self.lock, self.sessions = threading.Lock(), {}

    @contextmanager
    def __call__(self, spark: SparkSession) -> Iterator[None]:
        key = spark._jsparkSession.hashCode()
        with self.lock:
            writers, before = self.sessions.get(key) or (0, {k: spark.conf.get(k) for k in WRITING})
            self.sessions[key] = (writers + 1, before)
            for k, v in WRITING.items():
                spark.conf.set(k, v)
        try:
            yield
        finally:
            with self.lock:
                writers, before = self.sessions.pop(key)
                if writers > 1:
                    self.sessions[key] = (writers - 1, before)
                else:
                    for k, v in before.items():
                        spark.conf.set(k, v)


_writing = _Writing()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends at files that all can read.

    The shuffles behind it are of no more use then, so Spark is told to remove them when the write ends. What is only
    needed for a while can be deleted by ``forget``.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    with _writing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of tables that ``stored`` wrote and nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or if a column is called so, the first of ``name_``, ``name__`` ... that is free."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slots(spark: SparkSession) -> int:
    """Shuffle partitions configured for this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def pieces(texts: list, limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` with about ``limit`` characters each, so that a worker holds little at once."""
    start = total = 0
    for k, text in enumerate(texts):
        total += len(text)
        if total >= limit:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(texts):
        yield start, len(texts)

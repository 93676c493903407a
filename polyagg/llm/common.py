"""Helpers shared by the text operators: tables, shared storage, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

WORD_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_one_process(spark: SparkSession) -> bool:
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).  Where that is unset and Spark runs in one process, as in tests, a
    folder of this run; on a cluster that is an error, as its machines do not share their own folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not in_one_process(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        found = f"file://{tempfile.mkdtemp(prefix='polyagg-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store through Hadoop's file system layer."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """Tables written to the shared folder to cut lineage: readable by every executor, so a lost one costs nothing.

    drop() deletes what later steps no longer read; whatever is left goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/polyagg-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._end)

    def stage(self, df: DataFrame, name: str, large: bool = False) -> DataFrame:
        """df as a table; large: what Spark shuffled to make it should go at once."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        schema = df.schema
        df.write.parquet(path)
        if large:
            release(self.spark, 3)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete the tables behind frames that stage() has returned."""
        for df in frames:
            for f in df.inputFiles()[:1]:
                delete_path(self.spark, f.rpartition("/")[0])

    def close(self) -> None:
        """Delete all tables, once nothing that is returned reads them."""
        delete_path(self.spark, self.root)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # at exit the JVM may be gone; the folder is then the cluster's to clean
            self.close()


def release(spark: SparkSession, times: int = 1) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps now, not at some later garbage collection.  What
    Python lets go reaches the JVM's collector by way of the gateway, and its cleaner a little later, so once may not do.
    Where Spark is one process, they go when that ends."""
    for i in range(0 if in_one_process(spark) else times):
        gc.collect()
        spark._jvm.System.gc()
        if i + 1 < times:
            time.sleep(0.3)


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Give memory that a Python worker has freed back to the system: Spark keeps workers, and others need it meanwhile."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that column's bytes stay near limit in each (one row at least)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch
        trim()


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """Each text's UTF-8; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]

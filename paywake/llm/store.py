"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a local session without one gets a temporary folder, a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="paywake-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_CACHE: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps between the tasks of one operator; it drops what another operator has kept."""
    if name not in _CACHE:
        _CACHE.clear()
        _CACHE[name] = make()
    return _CACHE[name]


def released(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one, what the worker has freed goes back to the system.

    Workers are used again by the next stage, and the C library would keep the pages of each stage's arrays.
    """
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim:
        trim(0)


class Scratch:
    """Intermediate tables of one job. A lost executor costs a re-read of files, never of work before them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.folder}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read again."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete everything kept so far, once nothing reads it any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for table in tables:
            folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
            for folder in folders:
                if folder.split("/")[-2] == self.folder.split("/")[-1]:
                    path = jvm.org.apache.hadoop.fs.Path(folder)
                    path.getFileSystem(conf).delete(path, True)

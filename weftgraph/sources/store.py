"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder below the warehouse where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return found.rstrip("/") if found else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """While it holds, the session has this setting."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: computed once, lineage cut, lost executors survived."""
    path = f"{shared_dir(df.sparkSession)}/graph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none if it isn't there."""
    files, at = _system(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(at) if f.isDirectory()) if files.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _system(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder that this library has written; nothing happens if it isn't there."""
    files, at = _system(spark, path)
    files.delete(at, True)


def uri(spark: SparkSession, path: str) -> str:
    """The URI of a path in the shared folder, as Arrow's file systems take it."""
    files, at = _system(spark, path)
    name = files.makeQualified(at).toUri().toString()
    return f"file://{name[5:]}" if name.startswith("file:/") and not name.startswith("file://") else name


def stored_rows(folder: str, columns: list[str], rows: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """In a task: the rows of a table that this library has written to the shared folder, by the URI of its folder; none if it isn't there."""
    system, at = fs.FileSystem.from_uri(folder)
    for file in sorted(f.path for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.path.endswith(".parquet")):
        with system.open_input_file(file) as stream:
            yield from pq.ParquetFile(stream).iter_batches(rows, columns=columns, use_threads=False)


class Tables:
    """The tables of one run, in a folder of its own. ``manifest`` has the live ones; a table is dropped when nothing reads it any more, all of them when the run is closed."""

    def __init__(self, spark: SparkSession, label: str = "run"):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/graph/{label}-{uuid.uuid4().hex}"
        self.manifest: dict[str, str] = {}
        self._of: dict[int, tuple[DataFrame, str]] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and reads it back, as ``store`` does."""
        name = f"{name}-{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.manifest[name] = path
        self._of[id(out)] = out, name  # the frame is held, so its id stays its own
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes the tables that ``put`` gave; frames of other origin are left alone."""
        for df in frames:
            _, name = self._of.pop(id(df), (None, None))
            if name:
                remove(self.spark, self.manifest.pop(name))

    def drop_named(self, label: str, names: set[str]) -> None:
        """Deletes those of ``names`` that were put as ``label``."""
        self.drop(*(df for df, name in list(self._of.values()) if name in names and name.startswith(f"{label}-")))

    def close(self) -> None:
        remove(self.spark, self.folder)
        self.manifest, self._of = {}, {}

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.close()

"""Written intermediate tables.

A staged table cuts lineage and is read back as columns, so each reader takes
only what it needs. It lives in the shared folder named by
``spark.checkpoint.dir`` and therefore survives the loss of any executor. Tables
that only a part of a job needs belong to a ``Scratch``, which removes them.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder.

    In local mode, where driver and tasks are one process, a temporary one that
    goes with it stands in for a folder that is not set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="coursemill-"))
        atexit.register(shutil.rmtree, _local_root[0], ignore_errors=True)
    return _local_root[0]


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table by its path, in whatever file system it lies."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and continue from the written table, which stays."""
    return _written(df, new_path(df.sparkSession, label))


class Scratch:
    """Staged tables of one piece of work, removed when it ends, also by an error.

    What is still needed afterwards has to be staged outside, before the end.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, new_path(spark, label)
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        remove(self.spark, self.root)
        self.paths.clear()

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and continue from the written table."""
        path = f"{self.root}/{label}-{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        table = _written(df, path)
        self.paths[id(table)] = table, path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing unwritten reads any more."""
        for table in tables:
            _, path = self.paths.pop(id(table))
            remove(self.spark, path)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Sorted names in a folder; none if there is no such folder."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(jvm_path)) if files.exists(jvm_path) else []


class Versions:
    """A small table that is replaced as a whole: the newest complete version counts.

    A version is a folder ``<number>.<tag>``, complete when the writer has marked
    it. The tag names the piece of work that made it, so that the same work, done
    again after a failure, starts from what it found the first time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _complete(self) -> list[str]:
        return [n for n in names_in(self.spark, self.path) if "_SUCCESS" in names_in(self.spark, f"{self.path}/{n}")]

    def read(self, before: str | None = None) -> DataFrame:
        """The newest version that work ``before`` has not made; empty if there is none."""
        found = [n for n in self._complete() if n.partition(".")[2] != before]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{found[-1]}")

    def replace(self, table: DataFrame, tag: str) -> None:
        """Write the next version; of the older ones only that which ``read(tag)`` gives stays."""
        names = names_in(self.spark, self.path)
        base = [n for n in self._complete() if n.partition(".")[2] != tag][-1:]
        number = int(names[-1].partition(".")[0]) + 1 if names else 0
        table.write.parquet(f"{self.path}/{number:012d}.{tag}")
        for name in names:
            if name not in base:
                remove(self.spark, f"{self.path}/{name}")

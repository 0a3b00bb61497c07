"""Written stages: tables that cut the lineage of iterative jobs.

They lie in the folder of ``spark.checkpoint.dir``, which all executors of a
cluster share, so that a lost executor loses no stage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one where none is set and the master is this machine."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


#: How many times as large rows are in memory as in a compressed file.  Spark's default of 1 would let the size of a
#: file pass for that of its rows, and broadcast tables several times over the session's threshold.
GROWN = "8.0"
_FACTOR = "spark.sql.sources.fileCompressionFactor"
#: Shuffle files go as soon as their table is written; else they stay until the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: list[Stages] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Stages:
    """Names and drops the written tables of one run of an operator.

    Tables are dropped one by one with ``drop``, all that a result doesn't read with ``result``, and the rest, once results
    have been read, with ``close`` or at the end of a ``scope``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: list[str] = []
        self._n = 0
        _open.append(self)

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
        """The table as written and read again, and its path.

        While it is written, sizes of files count GROWN times, if the session has Spark's default, and its shuffle files are deleted at the
        end; the session's settings come back.
        """
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        writer = df.write.option("compression", "zstd")
        with self._writing():
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def counted(self, df: DataFrame, name: str, which: Column) -> tuple[DataFrame, str, int]:
        """``write``, and how many of the written rows fulfil a condition.

        They are counted from the written column alone; an ``Observation`` would leave the session unfit for Spark ML's closures.
        """
        table, path = self.write(df, name)
        return table, path, table.where(which).count()

    @contextmanager
    def _writing(self) -> Iterator[None]:
        conf = self.spark.conf
        had = {k: conf.get(k, None) for k in (_FACTOR, _CLEAN)}
        conf.set(_CLEAN, "true")
        if float(had[_FACTOR] or "1.0") == 1.0:
            conf.set(_FACTOR, GROWN)
        try:
            yield
        finally:
            for k, v in had.items():
                conf.set(k, v) if v is not None else conf.unset(k)

    def drop(self, *paths: str) -> None:
        for path in paths:
            _delete(self.spark, path)
            if path in self.paths:
                self.paths.remove(path)

    def result(self, df: DataFrame) -> DataFrame:
        """``df``, after the tables of this run that it doesn't read have been dropped."""
        read = "\n".join(df.inputFiles())
        self.drop(*(p for p in list(self.paths) if "/" + "/".join(p.split("/")[-2:]) + "/" not in read))
        return df

    def close(self) -> None:
        """Drops all tables of this run; results that read them can't be read any more."""
        _delete(self.spark, self.root)
        self.paths.clear()
        if self in _open:
            _open.remove(self)


@contextmanager
def scope() -> Iterator[None]:
    """Drops every stage that operators write inside, at the end: ``with scope(): query(...).write.parquet(...)``."""
    before = list(_open)
    try:
        yield
    finally:
        for s in [x for x in _open if x not in before]:
            s.close()

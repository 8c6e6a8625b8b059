"""The folder that the driver and all executors share, and tables written to it to cut lineage."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Most parts into which rows are dealt: for more (spark.shuffle.sort.bypassMergeThreshold) a task first holds all rows that it deals.
PARTS = 200
#: Whether what a query shuffled goes as soon as it is done, not when the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a new folder where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="sleuthframe-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path and the path as it knows it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    filesystem, found = hadoop_path(spark, path)
    return filesystem.exists(found)


def removed(spark: SparkSession, path: str) -> None:
    filesystem, found = hadoop_path(spark, path)
    filesystem.delete(found, True)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What queries run here have shuffled is deleted once they are done."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)


class Written:
    """A table written once and read as often as needed; :meth:`discard` removes its files."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, name)
        with cleaned(self.spark):
            df.write.option("compression", "zstd").parquet(self.path)
        self.table = self.spark.read.schema(df.schema).parquet(self.path)

    def discard(self) -> None:
        removed(self.spark, self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what follows survives lost executors and computes none of it again."""
    return Written(df, name).table


def parts_of(rows: int, size: int) -> int:
    """Parts that leave about ``size`` of ``rows`` for each, but no more than ``PARTS``."""
    return min(PARTS, max(1, math.ceil(rows / size)))

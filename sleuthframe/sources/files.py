"""Files of a shared file system: listed by Spark, opened in tasks.

The driver lists names and sizes through Spark's own reader and opens nothing. A task opens a file by its address where Arrow knows the file
system; of any other file system Spark reads the content (2 GB at most), which then comes with the row.
"""

from __future__ import annotations

import io
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File systems that a task opens by itself.
SCHEMES = {"file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss"}


def local(path: str) -> str:
    """A path of the local file system without its scheme; any other as it is."""
    return re.sub(r"^file:/+", "/", path)


def scheme_of(spark: SparkSession, path: str) -> str:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return found[1].lower() if found else spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()).getScheme()


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, content) of a file, a folder or a glob, several joined by commas; content is null where tasks open files."""
    paths = path.split(",")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    own = all(scheme_of(spark, p) in SCHEMES for p in paths)
    content = F.lit(None).cast("binary") if own else F.col("content")
    return found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", F.col("modificationTime").alias("modified"), content.alias("content"))


def resolved(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path as it knows it."""
    return (pafs.LocalFileSystem(), local(path)) if path.startswith(("/", "file:")) else pafs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))


class Remote(io.RawIOBase):
    """A file of Arrow's with the manners of Python's own."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        place = offset + (0, self.file.tell(), self.size)[whence]
        if place < 0:
            raise OSError("a place before the file")
        self.file.seek(place)
        return place

    def readinto(self, buffer) -> int:
        return self.file.readinto(buffer) if self.file.tell() < self.size else 0


@contextmanager
def opened(path: str, content: bytes | None = None) -> Iterator[BinaryIO]:
    """A file, open for reading at any place."""
    if content is not None:
        yield io.BytesIO(content)
    elif path.startswith(("/", "file:")):
        with open(local(path), "rb") as f:
            yield f
    else:
        filesystem, name = resolved(path)
        with filesystem.open_input_file(name) as f:
            yield io.BufferedReader(Remote(f), 1 << 18)


@contextmanager
def created(path: str) -> Iterator[BinaryIO]:
    """A file to be written by a task from beginning to end; one that is there is replaced, so a task that is tried again does no harm."""
    filesystem, name = resolved(path)
    filesystem.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with filesystem.open_output_stream(name) as f:
        yield f


@contextmanager
def at_hand(path: str, content: bytes | None = None) -> Iterator[str]:
    """A file's path for libraries that read nothing else: its own if it is local, else that of a copy that lasts as long as the block."""
    if content is None and path.startswith("/"):
        yield path
        return
    with tempfile.NamedTemporaryFile() as copy, opened(path, content) as f:
        while piece := f.read(1 << 22):
            copy.write(piece)
        copy.flush()
        yield copy.name

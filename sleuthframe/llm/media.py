"""Media columns: payloads kept as images in archives, and a Spark data source that streams them back.

An archive directory holds ZIP files whose members are stored as they are, so that a member can be read at its offset. The
writer makes archives of bounded size in every task and lists those of committed tasks in an index file of the commit's own, so
that what a lost task left is never read, an append adds to what is there, and an overwrite removes it. The reader plans byte
ranges over the archives (the driver sees one index line per archive), each task reads the archive's own directory, takes the
members that begin in its range, and streams them in Arrow batches of bounded size. A member that can't be read is tried again at
its offset, alone; in the end it becomes a row with an error. A member's file name is its escaped name, so any text can be one.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .tables import new_path

INDEX = "_archives-"
#: Byte ranges that are planned over a directory at most, or so; they are made longer beyond.
MOST_RANGES = 100_000
WIDTH = 64
#: Fixed values of the PNG format.
PNG = b"\x89PNG\r\n\x1a\n"
SCHEMA = "member string, archive string, offset long, media binary, error string"


# The stored form: an 8-bit greyscale PNG, 64 samples wide.


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_payload(data: bytes) -> bytes:
    """``data`` and bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH or (WIDTH if not data else 0))


def to_png(data: bytes) -> bytes:
    """The payload of ``data`` as samples; a text chunk keeps the length without padding."""
    rows = np.frombuffer(to_payload(data), np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    filtered[:, 1:] = rows
    return b"".join((PNG, chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), chunk(b"tEXt", b"Length\0%d" % len(data)), chunk(b"IDAT", zlib.compress(filtered.tobytes(), 1)), chunk(b"IEND", b"")))


def from_png(media: bytes) -> tuple[int, np.ndarray]:
    """The length without padding and the samples of what :func:`to_png` has made."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, length, shape, data = 8, 0, (0, 0), []
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(media[at + 4 : at + 8 + n]) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("not 8-bit greyscale")
            shape = height, width
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            length = int(body[7:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if shape[1] != WIDTH or not shape[0]:
        raise ValueError("no rows, or of another width")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return length, rows[:, 1:]


def features(samples: np.ndarray) -> str:
    """Height, mean, deviation, entropy in bits, distinct samples, and a 64-bit average hash over eight bands of eight columns."""
    n = samples.size
    counts = np.bincount(samples.ravel(), minlength=256)
    values = np.arange(256)
    mean = int((counts * values).sum()) / n
    var = max(0.0, int((counts * values * values).sum()) / n - mean * mean)
    p = counts[counts > 0] / n
    bands = np.linspace(0, len(samples), 9).astype(int)
    columns = samples.reshape(len(samples), 8, WIDTH // 8).sum(axis=2, dtype=np.int64)
    sums = np.add.reduceat(np.vstack([columns, np.zeros((1, 8), np.int64)]), bands[:-1], axis=0)
    sizes = np.maximum(np.diff(bands), 1) * (WIDTH // 8)
    bits = (sums / sizes[:, None] > mean).ravel()
    average = int("".join("01"[int(b)] for b in bits), 2)
    return f"h={len(samples)};mean={mean:.4f};sd={var**0.5:.4f};entropy={max(0.0, float(-(p * np.log2(p)).sum())):.4f};distinct={len(p)};ahash={average:016x}"


# The data source.


def open_dir(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def file_name(member: str | None) -> str:
    """The name of a member in its archive: safe for any text, and apart from that of null."""
    return "null" if member is None else "=" + quote(member, safe="")


def member_name(name: str) -> str | None:
    """Turns :func:`file_name` back; other names, of archives made elsewhere, stand for themselves."""
    return None if name == "null" else unquote(name[1:]) if name.startswith("=") else name


def index_files(filesystem: pafs.FileSystem, base: str) -> list[str]:
    found = filesystem.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith(INDEX) and f.base_name.endswith(".json"))


def listed(filesystem: pafs.FileSystem, index: str) -> list[dict]:
    with filesystem.open_input_stream(index) as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    archives: list


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveWriter(DataSourceArrowWriter):
    """Writes (member, media) rows. Options: path, archiveBytes (where an archive is closed)."""

    def __init__(self, path: str, archive_bytes: int, overwrite: bool):
        self.path, self.archive_bytes, self.overwrite = path, archive_bytes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        filesystem, base = open_dir(self.path)
        filesystem.create_dir(base, recursive=True)
        archives, archive, out = [], None, None
        for batch in iterator:
            for member, media in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist()):
                if archive is None:
                    name = f"part-{uuid.uuid4().hex}.zip"
                    out = filesystem.open_output_stream(posixpath.join(base, name))
                    archive, size, count = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED), 0, 0
                archive.writestr(zipfile.ZipInfo(file_name(member)), media or b"")
                size, count = size + len(media or b""), count + 1
                if size >= self.archive_bytes:
                    archives.append(self.close(archive, out, name, count))
                    archive = None
        if archive is not None:
            archives.append(self.close(archive, out, name, count))
        return Written(archives)

    def close(self, archive: zipfile.ZipFile, out, name: str, count: int) -> dict:
        archive.close()
        end = out.tell()
        out.close()
        return {"name": name, "members": count, "bytes": end, "directory": archive.start_dir}

    def commit(self, messages: list) -> None:
        filesystem, base = open_dir(self.path)
        filesystem.create_dir(base, recursive=True)
        before = index_files(filesystem, base) if self.overwrite else []
        with filesystem.open_output_stream(posixpath.join(base, f"{INDEX}{uuid.uuid4().hex}.json")) as f:
            f.write(json.dumps([a for m in messages if m is not None for a in m.archives]).encode())
        for index in before:
            archives = listed(filesystem, index)
            filesystem.delete_file(index)
            for a in archives:
                filesystem.delete_file(posixpath.join(base, a["name"]))

    def abort(self, messages: list) -> None:
        filesystem, base = open_dir(self.path)
        for a in (a for m in messages if m is not None for a in m.archives):
            filesystem.delete_file(posixpath.join(base, a["name"]))


class ArchiveReader(DataSourceReader):
    """Options: path, rangeBytes (of a partition), batchBytes (of an Arrow batch), retries (of a member)."""

    def __init__(self, path: str, range_bytes: int, batch_bytes: int, retries: int):
        self.path, self.range_bytes, self.batch_bytes, self.retries = path, range_bytes, batch_bytes, retries

    def partitions(self) -> list[Range]:
        filesystem, base = open_dir(self.path)
        archives = [a for index in index_files(filesystem, base) for a in listed(filesystem, index)]
        step = max(self.range_bytes, sum(a["directory"] for a in archives) // MOST_RANGES)
        return [Range(a["name"], start, min(start + step, a["directory"])) for a in archives for start in range(0, a["directory"], step)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        filesystem, base = open_dir(self.path)
        path = posixpath.join(base, partition.archive)
        with filesystem.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            members = [(m.header_offset, m.filename, m.CRC, m.file_size) for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
        rows, size, source = [], 0, None
        for offset, name, crc, length in sorted(members):
            media, error = None, None
            for attempt in range(1 + self.retries):
                try:
                    source = source or filesystem.open_input_file(path)
                    media, error = read_member(source, offset, crc, length), None
                    break
                except (OSError, ValueError, struct.error) as e:
                    error, source = f"{type(e).__name__}: {e}", None
                    time.sleep(0.01 * 2**attempt)
            rows.append((member_name(name), partition.archive, offset, media, error))
            size += len(media or b"")
            if size >= self.batch_bytes:
                yield to_batch(rows)
                rows, size = [], 0
        if rows:
            yield to_batch(rows)


def read_member(source, offset: int, crc: int, length: int) -> bytes:
    source.seek(offset)
    header = source.read(30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {offset}")
    names = sum(struct.unpack_from("<HH", header, 26))
    data = source.read(names + length)[names:]
    if len(data) != length or zlib.crc32(data) != crc:
        raise ValueError(f"damaged member at {offset}")
    return data


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["member", "archive", "offset", "media", "error"])


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(directory)``; writes rows with columns member and media."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        o = self.options
        return ArchiveReader(o["path"], int(o.get("rangeBytes", 16 << 20)), int(o.get("batchBytes", 4 << 20)), int(o.get("retries", 3)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("archiveBytes", 64 << 20)), overwrite)


# The columns.


def encoded(documents: DataFrame) -> DataFrame:
    """(member, media): the doc_id as a string and the image of the UTF-8 text, null being empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, members = batch.column("text"), batch.column("member")
            for k in range(0, len(texts), 500):
                media = [to_png(t.encode() if t else b"") for t in texts.slice(k, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([members.slice(k, 500), pa.array(media, pa.binary())], names=["member", "media"])

    return documents.select(F.col("doc_id").cast("string").alias("member"), "text").mapInArrow(run, "member string, media binary")


def measured(media: DataFrame) -> DataFrame:
    """What is found in the stored bytes; a member that could not be read, or is no image of :func:`to_png`, has nulls and its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, error in zip(batch.column("media").to_pylist(), batch.column("error").to_pylist()):
                if data is None:
                    rows.append((None,) * 7 + (error,))
                    continue
                try:
                    n, samples = from_png(data)
                except (ValueError, struct.error, zlib.error) as e:
                    rows.append((None,) * 7 + (f"{type(e).__name__}: {e}",))
                    continue
                payload = samples.tobytes()
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), features(samples), None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("member"), *columns], names=["member", *NAMES, "error"])

    return media.mapInArrow(run, "member string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


NAMES = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def store(documents: DataFrame, directory: str, mode: str = "append", **options: int) -> None:
    """Write the texts of ``documents`` into an archive directory. Repeated rows are members of their own.

    ``mode``: "append" adds to what the directory holds, "overwrite" takes its place once all is written.
    """
    documents.sparkSession.dataSource.register(MediaArchive)
    encoded(documents).write.format("media_archive").options(path=directory, **options).mode(mode).save()


def load(spark, directory: str, **options: int) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(directory)


def media_columns(documents: DataFrame, directory: str | None = None) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error.

    The texts are stored in ``directory`` (a new one in the shared folder by default) and everything is computed from the bytes
    read back. Null and empty texts are 64 bytes 0; equal texts have equal values; a null doc_id stays null, any other comes back
    as it is; repeated rows are kept; other columns are not read; an empty table gives no rows. A given ``directory`` is overwritten.
    """
    spark = documents.sparkSession
    directory = directory or new_path(spark, "media")
    store(documents, directory, "overwrite")
    kind = documents.schema["doc_id"].dataType
    return measured(load(spark, directory)).select(F.col("member").cast(kind).alias("doc_id"), *NAMES, "error")

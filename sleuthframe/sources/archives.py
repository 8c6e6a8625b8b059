"""Members of extraction archives in a shared file system, read by offset, and searches by file name pattern.

The driver lists archives and opens none. Of a ZIP one task reads the directory at the file's end; of a TAR every range of bytes is a task
that finds what looks like headers by their checksums, and the chain of headers from the first on tells which of them are. Members
are then rows of (archive, offset), dealt over all tasks, each read by itself. A compressed TAR has no places to start from: one task.
"""

from __future__ import annotations

import bz2
import fnmatch
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import files_of, opened

SCHEMA = "archive string, path string, size long, modified timestamp, content binary, error string"
#: Fixed value: the extra field of a ZIP member that holds its time in seconds since 1970.
EXTENDED_TIME = 0x5455
#: How compressed files begin, the size of a TAR's blocks, and where a header has its checksum.
COMPRESSED, BLOCK, CHECKSUM = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00"), 512, slice(148, 156)
#: Bytes of a TAR that one task looks through, members of one task, bytes of contents that a task hands on at once.
RANGE_BYTES, MEMBERS, HANDED = 64 << 20, 500, 32 << 20

ROWS = pa.schema([("archive", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.binary()), ("error", pa.string())])
PLACES = "archive string, kind string, path string, place long, packed long, method int, crc long, size long, modified timestamp"


class Batches:
    """Rows of members in batches of bounded size."""

    def __init__(self):
        self.rows, self.bytes = [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += len(row[4] or b"") + 100
        if self.bytes >= HANDED:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array([r[i] for r in self.rows], f.type) for i, f in enumerate(ROWS)], schema=ROWS)
        self.rows, self.bytes = [], 0
        return found


def fits(name: str, pattern: str) -> bool:
    return not name.endswith("/") and not name.startswith("__MACOSX") and fnmatch.fnmatch("root/" + name, pattern)


def kind_of(f: BinaryIO) -> str:
    f.seek(0)
    begins = f.read(6)
    return "stream" if begins.startswith(COMPRESSED) else "zip" if begins[:2] == b"PK" else "tar"


def utc(seconds: float) -> datetime | None:
    try:
        return datetime.fromtimestamp(seconds, timezone.utc)
    except (ValueError, OverflowError, OSError):
        return None


def zip_time(info: zipfile.ZipInfo) -> datetime | None:
    at, extra = 0, info.extra
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == EXTENDED_TIME and size >= 5 and extra[at + 4] & 1:
            return utc(struct.unpack_from("<i", extra, at + 5)[0])
        at += 4 + size
    try:
        return datetime(*info.date_time, tzinfo=timezone.utc)
    except ValueError:
        return None


def unpacked(f: BinaryIO, place: int, packed: int, method: int, crc: int, size: int) -> bytes:
    """A ZIP member from the offset of its own header."""
    f.seek(place)
    header = f.read(30)
    if header[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no header where the directory says")
    flags, (name, extra) = struct.unpack_from("<H", header, 6)[0], struct.unpack_from("<HH", header, 26)
    if flags & 1:
        raise RuntimeError("the member is encrypted")
    f.seek(place + 30 + name + extra)
    data = f.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    elif method == zipfile.ZIP_BZIP2:
        data = bz2.decompress(data)
    elif method == zipfile.ZIP_LZMA:
        data = zipfile.LZMADecompressor().decompress(data)
    elif method != zipfile.ZIP_STORED:
        raise NotImplementedError(f"compression method {method}")
    if len(data) != size or zlib.crc32(data) != crc:
        raise zipfile.BadZipFile("wrong size or checksum")
    return data


def zip_places(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "kind", "path", "place", "packed", "method", "crc", "size", "modified"]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.timestamp("us", "UTC")]
        for batch in batches:
            for archive in batch["path"].to_pylist():
                found = []
                with opened(archive) as f:
                    if kind_of(f) == "zip":
                        try:
                            with zipfile.ZipFile(f) as z:
                                found = [(archive, "zip", i.filename, i.header_offset, i.compress_size, i.compress_type, i.CRC, i.file_size, zip_time(i)) for i in z.infolist() if fits(i.filename, pattern)]
                        except zipfile.BadZipFile:
                            found = [(archive, "broken", *[None] * 7)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names)

    return run


def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a range of a TAR whose checksum is that of a header, with the place of the header after them."""
    for batch in batches:
        for archive, start, end in zip(*(batch[c].to_pylist() for c in ("archive", "start", "end"))):
            found, end = [], end - end % BLOCK
            with opened(archive) as f:
                if kind_of(f) == "tar":
                    for at in range(start, end, 1 << 22):
                        f.seek(at)
                        blocks = np.frombuffer(f.read(min(1 << 22, end - at)), np.uint8).reshape(-1, BLOCK)
                        sums = blocks.sum(1, dtype=np.int64) - blocks[:, CHECKSUM].sum(1, dtype=np.int64) + 8 * 32
                        # a checksum is octal digits, so its first byte is a digit or a space
                        for k in np.flatnonzero((blocks[:, 0] > 0) & ((blocks[:, 148] == 32) | ((blocks[:, 148] >= 48) & (blocks[:, 148] < 56)))):
                            header = blocks[k].tobytes()
                            try:
                                if tarfile.nti(header[CHECKSUM]) == sums[k]:
                                    size = max(tarfile.nti(header[124:136]), 0) if header[156:157] not in tarfile.DIRTYPE + tarfile.SYMTYPE + tarfile.LNKTYPE + tarfile.CHRTYPE + tarfile.BLKTYPE + tarfile.FIFOTYPE else 0
                                    place = at + int(k) * BLOCK
                                    found.append((place, place + BLOCK + -(-size // BLOCK) * BLOCK, header[156:157] in (tarfile.GNUTYPE_LONGNAME, tarfile.GNUTYPE_LONGLINK, tarfile.XHDTYPE, tarfile.XGLTYPE)))
                            except tarfile.HeaderError:
                                continue
            yield pa.RecordBatch.from_arrays([pa.array([archive] * len(found), pa.string()), *(pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_())))], ["archive", "place", "after", "prefix"])


def chained(table: pa.Table) -> pa.Table:
    """The places of a TAR's members, each that of the first header that tells of it: what is reached from the first header on."""
    known = {p: (n, x) for p, n, x in zip(table["place"].to_pylist(), table["after"].to_pylist(), table["prefix"].to_pylist())}
    places, at, first = [], 0, None
    while at in known:
        first = at if first is None else first
        after, prefix = known[at]
        if not prefix:
            places.append(first)
            first = None
        at = after
    return pa.table({"archive": pa.array([table["archive"][0].as_py()] * len(places), pa.string()), "place": pa.array(places, pa.int64())})


class From:
    """A file from a place on, as if it began there."""

    def __init__(self, f: BinaryIO, start: int):
        self.f, self.start = f, start
        f.seek(start)

    def read(self, n: int = -1) -> bytes:
        return self.f.read(n)

    def seek(self, at: int) -> int:
        self.f.seek(self.start + at)
        return at

    def tell(self) -> int:
        return self.f.tell() - self.start


def read_members(pattern: str, content: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches()
        for batch in batches:
            for r in batch.to_pylist():
                archive, data, error = r["archive"], None, None
                try:
                    with opened(archive) as f:
                        if r["kind"] == "tar":
                            with tarfile.open(fileobj=From(f, r["place"]), mode="r:") as t:
                                member = t.next()
                                if member is None or not member.isfile() or not fits(member.name, pattern):
                                    continue
                                r |= {"path": member.name, "size": member.size, "modified": utc(member.mtime)}
                                data = t.extractfile(member).read() if content else None
                        elif r["kind"] == "broken":
                            raise zipfile.BadZipFile("no directory at the end of the file")
                        elif content:
                            data = unpacked(f, r["place"], r["packed"], r["method"], r["crc"], r["size"])
                except (zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, OSError, EOFError, RuntimeError, ValueError, NotImplementedError) as e:
                    error = f"{type(e).__name__}: {e}"  # one bad member does not end the job
                yield from out.add(archive, r["path"], r["size"], r["modified"], data, error)
        yield out.batch()

    return run


def read_whole(pattern: str, content: bool, kinds: tuple[str, ...]):
    """All members of archives of some kinds, from beginning to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches()
        for batch in batches:
            for archive, given in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                with opened(archive, given) as f:
                    kind = kind_of(f)
                    f.seek(0)
                    if kind not in kinds:
                        continue
                    if kind == "zip":
                        with zipfile.ZipFile(f) as z:
                            for info in z.infolist():
                                if fits(info.filename, pattern):
                                    data = error = None
                                    try:
                                        data = z.read(info) if content else None
                                    except (zipfile.BadZipFile, zlib.error, OSError, RuntimeError, NotImplementedError) as e:
                                        error = f"{type(e).__name__}: {e}"
                                    yield from out.add(archive, info.filename, info.file_size, zip_time(info), data, error)
                        continue
                    try:
                        with tarfile.open(fileobj=f, mode="r|*") as t:
                            for m in t:
                                if m.isfile() and fits(m.name, pattern):
                                    yield from out.add(archive, m.name, m.size, utc(m.mtime), t.extractfile(m).read() if content else None, None)
                    except (tarfile.TarError, zlib.error, EOFError, OSError) as e:  # what was read before stays
                        yield from out.add(archive, None, None, None, None, f"{type(e).__name__}: {e}")
        yield out.batch()

    return run


def read_archive(spark: SparkSession, path: str, pattern: str = "*", content: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """archive, path, size, modified, content and error of the members of ZIP and TAR files whose "root/" and name fit a pattern.

    ``path`` is a file, a folder or a glob, several joined by commas. Members that can't be read have an error and no content.
    """
    files = files_of(spark, path)
    n = max(1, min(files.select("path").count(), 10_000))
    if not files.where("content is not null").select("path").limit(1).isEmpty():
        return files.repartition(n).mapInArrow(read_whole(pattern, content, ("zip", "tar", "stream")), SCHEMA)
    names = files.select("path").repartition(n)
    zips = names.mapInArrow(zip_places(pattern), PLACES)
    step = range_bytes - range_bytes % BLOCK
    pieces = files.select(F.col("path").alias("archive"), "length", F.explode(F.sequence(F.lit(0), F.greatest("length", F.lit(1)) - 1, F.lit(step))).alias("start"))
    pieces = pieces.select("archive", "start", F.least("length", F.col("start") + step).alias("end"))
    looked = pieces.repartition(spread(pieces, 1)).mapInArrow(headers, "archive string, place long, after long, prefix boolean")
    tars = looked.groupBy("archive").applyInArrow(chained, "archive string, place long")
    none = {c: F.lit(None).cast(t) for c, t in (("path", "string"), ("packed", "long"), ("method", "int"), ("crc", "long"), ("size", "long"), ("modified", "timestamp"))}
    tars = tars.withColumns(none | {"kind": F.lit("tar")}).select(*zips.columns)
    places = zips.unionByName(tars)
    members = places.repartition(spread(places, MEMBERS)).mapInArrow(read_members(pattern, content), SCHEMA)
    streams = files.repartition(n).mapInArrow(read_whole(pattern, content, ("stream",)), SCHEMA)
    return members.unionByName(streams)


def spread(rows: DataFrame, each: int) -> int:
    """Tasks for so many rows, ``each`` of them in one."""
    return max(1, min(-(-rows.count() // each), 20_000))


def find_files(spark: SparkSession, folder: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """(path, length, modified[, content]) of files below a folder whose path from it, after "root/", fits a pattern; * crosses folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder if "://" in folder else "file:" + folder
    inside = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + base.removeprefix("file:").rstrip("/") + "/", "root/")
    regex = fnmatch.translate(pattern).replace("\\z", "$").replace("\\Z", "$")
    return files.where(inside.rlike("^" + regex)).select("path", "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def file_histogram(files: DataFrame) -> DataFrame:
    """(extension, n_files, n_bytes) of a listing with path and length."""
    from ..functions.scalars import extension

    return files.groupBy(extension(F.col("path")).alias("extension")).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


# Reports inside archives.

#: Fixed value: the name of the report in an extraction.
REPORT = "report.xml"
#: Lines of a block of a report, which one task looks at.
LINES = 100_000


def report_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, line) of the report in each archive (ZIP); unpacked as a stream, by one task for each archive."""
    files = files_of(spark, path)
    types = (pa.string(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["source", "line_no", "line"])

        for batch in batches:
            for archive, given in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                with opened(archive, given) as f, zipfile.ZipFile(f) as z:
                    names = [n for n in z.namelist() if n.rsplit("/", 1)[-1].lower() == REPORT]
                    if not names:
                        raise ValueError(f"{archive}: no {REPORT}")
                    rows: list[tuple] = []
                    with z.open(min(names, key=len)) as report:
                        for i, line in enumerate(report):
                            rows.append((archive, i, line.decode("utf-8", "replace").rstrip("\r\n")))
                            if len(rows) == 10_000:
                                yield handed(rows)
                                rows = []
                    yield handed(rows)

    return files.repartition(max(1, min(files.select("path").count(), 10_000))).mapInArrow(run, "source string, line_no long, line string")


def path_mapping(report_lines: DataFrame, lines: int = LINES) -> DataFrame:
    """(source, original_path, local_path) of a report's lines (source, line_no, line): each local path belongs to the last file before it.

    Files marked embedded="true" are left out. A report is cut into blocks of lines: the last file of each block is carried to the
    blocks after it, so that no task sees more than a block, or a row for each block.
    """
    file = F.regexp_extract("line", r'<file\b[^>]*\bpath="([^"]*)"', 1)
    local = F.regexp_extract("line", r'name="Local Path"[^>]*>(?:<!\[CDATA\[)?([^<\]]*)', 1)
    marked = report_lines.select("source", "line_no", F.floor(F.col("line_no") / lines).alias("block"), F.when(F.col("line").contains("<file ") & ~F.col("line").contains('embedded="true"'), file).when(F.col("line").contains("<file "), "").alias("file"), F.nullif(local, F.lit("")).alias("local_path"))
    marked = marked.where("file is not null or local_path is not null")
    last = marked.where("file is not null").groupBy("source", "block").agg(F.max_by("file", "line_no").alias("last"))
    blocks = marked.select("source", "block").distinct().join(last, ["source", "block"], "left")
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("source", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    within = Window.partitionBy("source", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    found = marked.withColumn("own", F.last("file", ignorenulls=True).over(within)).where("local_path is not null").join(carried, ["source", "block"])
    return found.select("source", F.coalesce("own", "carried").alias("original_path"), F.trim("local_path").alias("local_path")).where("original_path <> ''")


def extracted_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(source, original_path, local_path, size, modified, content, error) of the files that the reports of .ufdr archives map.

    A file that the report names and the archive lacks has no size.
    """
    mapping = path_mapping(report_lines(spark, path))
    members = read_archive(spark, path, content=content).select(F.col("archive").alias("source"), F.col("path").alias("local_path"), "size", "modified", "content", "error")
    return mapping.withColumn("local_path", F.regexp_replace(F.translate("local_path", "\\", "/"), "^(\\./|/)+", "")).join(members, ["source", "local_path"], "left").select("source", "original_path", "local_path", "size", "modified", "content", "error")

"""SQLite files of a shared file system as tables: a task for each file, or for each range of rowids of a large table.

A first job finds what columns and rowids the files have; the driver sees names and counts only and opens no file. Files are opened
read-only. A file without the table, or one that can't be read, gives no rows; with ``mode`` FAILFAST it raises. Columns are strings
(SQLite types values, not columns), to be cast by the query, behind rowid and source_path.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import at_hand, files_of

#: Rows of a batch that a task hands on; tasks at most; tasks for each core, where a file's ranges are more than that.
BATCH, TASKS, WAVES = 10_000, 20_000, 8
RANGE = "path string, content binary, low long, high long"


@contextmanager
def connect(path: str, content: bytes | None = None) -> Iterator[sqlite3.Connection]:
    """A connection that reads only. A log of changes beside the file is not looked at."""
    with at_hand(path, content) as name:
        db = sqlite3.connect(f"file:{quote(name)}?mode=ro&immutable=1", uri=True)
        db.text_factory = lambda b: b.decode("utf-8", "replace")
        try:
            yield db
        finally:
            db.close()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables and views of each file with their columns."""
    for batch in batches:
        out = []
        for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
            try:
                with connect(path, content) as db:
                    for (table,) in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
                        out.append((path, table, [r[1] for r in db.execute(f"PRAGMA table_info({quoted(table)})")]))
            except (sqlite3.Error, OSError):
                continue
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.list_(pa.string())))], ["path", "table", "columns"])


def tables_in(spark: SparkSession, path: str) -> DataFrame:
    """(path, table, columns) of SQLite files; files that can't be read have none."""
    files = files_of(spark, path)
    return spread(files).mapInArrow(probed, "path string, table string, columns array<string>")


def spread(files: DataFrame) -> DataFrame:
    """A file a task, up to ``TASKS``: opening is what takes time."""
    return files.repartition(max(1, min(files.select("path").count(), TASKS)))


def ranges(table: str, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                low = high = None
                try:
                    with connect(path, content) as db:
                        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(table)}").fetchone()
                except (sqlite3.Error, OSError):
                    pass  # a view, or a table without rowids: one task
                bounds = [(None, None)] if low is None or high - low < rows else [(k, min(k + rows - 1, high)) for k in range(low, high + 1, rows)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(bounds)), pa.array([content] * len(bounds), pa.binary()), pa.array([b[0] for b in bounds], pa.int64()), pa.array([b[1] for b in bounds], pa.int64())], ["path", "content", "low", "high"])

    return run


def text_of(v: object) -> str | None:
    return v.hex() if isinstance(v, bytes) else None if v is None else str(v)


def selected(table: str, names: list[str], strict: bool):
    def rows_of(db: sqlite3.Connection, low: int | None, high: int | None) -> Iterator[tuple]:
        have = {r[1].lower() for r in db.execute(f"PRAGMA table_info({quoted(table)})")}
        if not have and not strict:
            return
        columns = ", ".join(quoted(n) if n.lower() in have else "NULL" for n in names)
        columns = f", {columns}" if columns else ""
        try:
            yield from db.execute(f"SELECT rowid{columns} FROM {quoted(table)}" + (" WHERE rowid BETWEEN ? AND ?" if low is not None else ""), () if low is None else (low, high))
        except sqlite3.OperationalError:
            yield from db.execute(f"SELECT NULL{columns} FROM {quoted(table)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(path: str, rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([path] * len(rows), pa.string()), *(pa.array([text_of(r[i + 1]) for r in rows], pa.string()) for i in range(len(names)))]
            return pa.RecordBatch.from_arrays(columns, ["rowid", "source_path", *names])

        for batch in batches:
            for path, content, low, high in zip(*(batch[c].to_pylist() for c in ("path", "content", "low", "high"))):
                rows: list[tuple] = []
                try:
                    with connect(path, content) as db:
                        for row in rows_of(db, low, high):
                            rows.append(row)
                            if len(rows) == BATCH:
                                yield handed(path, rows)
                                rows = []
                except (sqlite3.Error, OSError):
                    if strict:
                        raise
                yield handed(path, rows)

    return run


def read_sqlite(spark: SparkSession, path: str, table: str, rowsPerPartition: str = "200000", mode: str = "PERMISSIVE") -> DataFrame:
    """rowid, source_path and the columns that a table has in any of the files; ``path``: file, folder or glob, joined by commas."""
    found: dict[str, str] = {}
    for r in tables_in(spark, path).where(F.lower("table") == table.lower()).select(F.posexplode("columns").alias("i", "c")).groupBy("c").agg(F.min("i").alias("i")).orderBy("i", "c").collect():
        found.setdefault(r.c.lower(), r.c)
    names = [c for low, c in found.items() if low not in ("rowid", "source_path")]
    parts = spread(files_of(spark, path).select("path", "content")).mapInArrow(ranges(table, int(rowsPerPartition)), RANGE)
    schema = ", ".join(["rowid long", "source_path string", *(f"{'`' + c.replace('`', '``') + '`'} string" for c in names)])
    # a task takes several ranges, one after another, where there are many: starting it costs more than reading one
    n = max(1, min(parts.select("path").count(), WAVES * spark.sparkContext.defaultParallelism, TASKS))
    return parts.repartition(n).mapInArrow(selected(table, names, mode.upper() == "FAILFAST"), schema)


def register_tables(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Every table of the files as a temporary view, so that joins over attached databases are plain joins of views."""
    names = [r.table for r in tables_in(spark, path).select("table").distinct().orderBy("table").collect()]
    for name in names:
        read_sqlite(spark, path, name).createOrReplaceTempView(prefix + name)
    return [prefix + name for name in names]


def has_column(df: DataFrame, name: str) -> bool:
    return name.lower() in {c.lower() for c in df.columns}

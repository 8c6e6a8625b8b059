"""A store of cases on a shared file system: one commit over all tables of a case, and contents kept once by their hash.

An ingest writes its rows below ``table/run_id=…/attempt=…``. They count once a small file of the case's log says that the attempt is
complete; until then, and if it fails, readers see what was there before. Log files have numbers and are never written twice, so of two
ingests of one case at once the second stops. What is parsed from a file is kept by the file's SHA-256, so a file is parsed once
whatever the number of cases that hold it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Mapping
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import SCHEMAS, TIME_COLUMN, conform, empty
from .shared import exists, hadoop_path
from .sources.files import files_of, opened
from .sources.reports import read_report

#: Tables that an ingest fills; the run itself is the log.
TABLES = ("message", "call", "contact", "media")
LOG = "run_id string, number long, attempt string, status string, user_id string, file_name string, original_file_path string, file_content_hash string, start_time string, end_time string, rows map<string,long>, error string"
INGESTING, COMPLETE, FAILED = "ingesting", "complete", "failed"


def digest_of(spark: SparkSession, path: str) -> str:
    """The SHA-256 of a file, read in pieces by a task; of several, that of theirs in order of name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                h = hashlib.sha256()
                with opened(name, content) as f:
                    while piece := f.read(1 << 22):
                        h.update(piece)
                found.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(found)], ["path", "digest"])

    rows = files_of(spark, path).mapInArrow(run, "path string, digest string").orderBy("path").collect()
    return rows[0].digest if len(rows) == 1 else hashlib.sha256("".join(r.digest for r in rows).encode()).hexdigest()


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, computed and written there unless an earlier call has done so to its end."""
    if not exists(spark, f"{path}/_SUCCESS"):
        found = compute()
        found.write.mode("overwrite").parquet(path)
        return spark.read.schema(found.schema).parquet(path)
    return spark.read.parquet(path)


class CaseStore:
    """Cases below ``root``: :meth:`ingest` adds one, :meth:`load` gives the tables as the catalog has them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # The log.

    def log_name(self, run_id: str) -> str:
        return hashlib.sha256(run_id.encode()).hexdigest()

    def log(self, run_id: str | None = None) -> DataFrame:
        """Entries of all cases or one; a file that is not whole yet counts as not there."""
        filesystem, pattern = hadoop_path(self.spark, f"{self.root}/log/{'*' if run_id is None else self.log_name(run_id) + '-*'}.json")
        if not filesystem.globStatus(pattern):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json(pattern.toString()).where("run_id is not null and number is not null and status is not null")

    def say(self, entry: Mapping) -> None:
        """Write an entry; one of that number that is there already is an error."""
        filesystem, path = hadoop_path(self.spark, f"{self.root}/log/{self.log_name(entry['run_id'])}-{entry['number']:08d}.json")
        out = filesystem.create(path, False)
        try:
            out.write(bytearray((json.dumps(entry) + "\n").encode()))
        finally:
            out.close()

    def latest(self, run_id: str | None = None, status: str | None = None) -> DataFrame:
        """The last entry of each case, of one status if given."""
        entries = self.log(run_id)
        entries = entries if status is None else entries.where(F.col("status") == status)
        return entries.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in entries.columns if c != "run_id"]), "number").alias("x")).select("run_id", "x.*")

    def runs(self, run_id: str | None = None) -> DataFrame:
        """The table of cases, each with the status of its last ingest."""
        time = {c: F.col(c).cast("timestamp_ntz") for c in ("start_time", "end_time")}
        return conform(self.latest(run_id).withColumns(time).withColumn("extraction_metadata", F.to_json("rows")), "run")

    # Tables.

    def write(self, name: str, rows: DataFrame, attempt: str) -> int:
        rows = conform(rows, name).withColumn("attempt", F.lit(attempt))
        if name in TIME_COLUMN:
            rows = rows.sortWithinPartitions(TIME_COLUMN[name])
        rows.write.mode("append").partitionBy("run_id", "attempt").parquet(f"{self.root}/{name}")
        return self.stored(name).where(F.col("attempt") == attempt).count()

    def stored(self, name: str) -> DataFrame:
        """All rows written, those of attempts that don't count too."""
        if not exists(self.spark, f"{self.root}/{name}"):
            return empty(self.spark, name).withColumn("attempt", F.lit(""))
        return self.spark.read.schema(f"{SCHEMAS[name]}, attempt string").parquet(f"{self.root}/{name}")

    def load(self, run_id: str | None = None) -> dict[str, DataFrame]:
        """The tables, of one case if given; attempts that count are joined to the folders' names, so other folders are not read."""
        done = self.latest(run_id, COMPLETE).select("run_id", "attempt")
        if run_id is None:
            found = {n: conform(self.stored(n).join(done, ["run_id", "attempt"], "left_semi"), n) for n in TABLES}
        else:
            attempts = [r.attempt for r in done.collect()]
            found = {n: conform(self.stored(n).where((F.col("run_id") == run_id) & F.col("attempt").isin(attempts)), n) for n in TABLES}
        return found | {"run": self.runs(run_id)}

    # Ingests.

    def parsed(self, path: str, digest: str) -> dict[str, DataFrame]:
        """What a file holds, under its hash as the case, kept by its hash; read again from there."""
        folder = f"{self.root}/parsed/{digest}"
        if exists(self.spark, f"{folder}/complete"):
            return {t: self.spark.read.parquet(f"{folder}/{t}") for t in TABLES if exists(self.spark, f"{folder}/{t}")}
        evidence = read_report(self.spark, path, digest, f"{folder}/report")
        found = {t: cached(self.spark, f"{folder}/{t}", lambda t=t: conform(evidence[t], t)) for t in TABLES if t in evidence}
        filesystem, mark = hadoop_path(self.spark, f"{folder}/complete")
        filesystem.create(mark, True).close()
        return found

    def ingest(self, path: str, run_id: str, user_id: str, now: datetime | None = None, replace: bool = False) -> bool:
        """All tables of a report (.ufdr, .xml, .json, .csv) as one case; whether anything changed.

        The same file again changes nothing. Another file for a complete case is an error unless it is to ``replace`` what is there.
        If anything fails the log says so and what, and readers see no row of it.
        """
        if not user_id:
            raise ValueError("an ingest needs a user")
        entries = self.log(run_id).orderBy("number").collect()
        number, complete = max([e.number for e in entries], default=-1) + 1, [e for e in entries if e.status == COMPLETE]
        digest = digest_of(self.spark, path)
        if complete and complete[-1].file_content_hash == digest:
            return False
        if complete and not replace:
            raise ValueError(f"case {run_id} holds another file")
        at = (now or datetime.now(timezone.utc)).replace(tzinfo=None).isoformat(sep=" ", timespec="seconds")
        entry = {"run_id": run_id, "number": number, "attempt": uuid.uuid4().hex, "status": INGESTING, "user_id": user_id, "file_name": path.rstrip("/").rsplit("/", 1)[-1], "original_file_path": path, "file_content_hash": digest, "start_time": at}
        self.say(entry)
        try:
            counts = {}
            for name, rows in self.parsed(path, digest).items():
                own = rows.withColumns({"run_id": F.lit(run_id), "id": F.sha1(F.concat_ws("|", F.lit(run_id), "id"))})
                counts[name] = self.write(name, own, entry["attempt"])
            end = (now or datetime.now(timezone.utc)).replace(tzinfo=None).isoformat(sep=" ", timespec="seconds")
            self.say(entry | {"number": number + 1, "status": COMPLETE, "end_time": end, "rows": counts})
        except Exception as e:
            self.say(entry | {"number": number + 1, "status": FAILED, "error": f"{type(e).__name__}: {e}"[:2000]})
            raise
        return True

    def sweep(self, run_id: str) -> int:
        """Remove the files of a case's attempts that don't count and are not going on; how many folders went."""
        entries = self.log(run_id).orderBy("number").collect()
        status = {e.attempt: e.status for e in entries}
        kept = {[e.attempt for e in entries if e.status == COMPLETE][-1]} if COMPLETE in status.values() else set()
        gone = 0
        for name in TABLES:
            for attempt, last in status.items():
                if attempt not in kept and last != INGESTING:
                    filesystem, pattern = hadoop_path(self.spark, f"{self.root}/{name}/*/attempt={attempt}")
                    for found in filesystem.globStatus(pattern) or []:
                        gone += filesystem.delete(found.getPath(), True)
        return gone


class ContentStore:
    """Contents below ``root``, each once under its SHA-256, and the references of cases to them."""

    OBJECTS = "digest string, size long, content binary, shard string"
    REFERENCES = "run_id string, media_id string, digest string, original_path string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def objects(self) -> DataFrame:
        """(digest, size, content, shard); the content is read only where it is asked for."""
        return self.table("objects", self.OBJECTS)

    def references(self) -> DataFrame:
        return self.table("references", self.REFERENCES)

    def put(self, files: DataFrame, run_id: str) -> None:
        """Add files (path, content; a path once) to a case. What is there already, content or reference, is found by anti-joins and stays.

        Contents are hashed where they are read; only those that are new are read again, to be written.
        """
        hashed = files.where("content is not null").select("path", F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("size"))
        named = cached(self.spark, f"{self.root}/staged/{uuid.uuid4().hex}", lambda: hashed)
        new = named.groupBy("digest").agg(F.min("path").alias("path")).join(self.objects().select("digest"), "digest", "left_anti")
        if not new.isEmpty():
            rows = files.join(new, "path").select("digest", F.octet_length("content").cast("long").alias("size"), "content", F.substring("digest", 1, 2).alias("shard"))
            rows.write.mode("append").partitionBy("shard").parquet(f"{self.root}/objects")
        refs = named.select(F.lit(run_id).alias("run_id"), F.sha1(F.concat_ws("|", F.lit(run_id), "digest", "path")).alias("media_id"), "digest", F.col("path").alias("original_path")).distinct()
        refs.join(self.references().select("media_id"), "media_id", "left_anti").select("run_id", "media_id", "digest", "original_path").write.mode("append").partitionBy("run_id").parquet(f"{self.root}/references")

    def media(self) -> DataFrame:
        """Every reference with the size of its content and how many references that has in all cases."""
        return media_view(self.references(), self.objects())

    def release(self, run_id: str) -> None:
        """Drop the references of a case; contents that no other case refers to remain until :meth:`collect_garbage`."""
        filesystem, pattern = hadoop_path(self.spark, f"{self.root}/references")
        if filesystem.exists(pattern):
            for found in filesystem.listStatus(pattern):
                escaped = self.spark._jvm.java.net.URLDecoder.decode(found.getPath().getName().replace("+", "%2B"), "UTF-8")
                if escaped == f"run_id={run_id}":
                    filesystem.delete(found.getPath(), True)

    def unreferenced(self) -> DataFrame:
        return self.objects().select("digest", "size").join(self.references().select("digest"), "digest", "left_anti")

    def collect_garbage(self) -> int:
        """Rewrite without contents that nothing refers to; how many went. Not to be run beside :meth:`put`."""
        gone = self.unreferenced().count()
        if gone:
            kept = self.objects().join(self.references().select("digest"), "digest", "left_semi")
            kept.write.partitionBy("shard").parquet(f"{self.root}/objects-{uuid.uuid4().hex[:8]}.new")
            filesystem, at = hadoop_path(self.spark, f"{self.root}/objects")
            (new,) = [s.getPath() for s in filesystem.globStatus(hadoop_path(self.spark, f"{self.root}/objects-*.new")[1])]
            filesystem.delete(at, True)
            filesystem.rename(new, at)
        return gone


def media_view(references: DataFrame, objects: DataFrame) -> DataFrame:
    """(run_id, media_id, digest, original_path, size, n_references): references with their contents' size and counts."""
    counts = references.groupBy("digest").agg(F.count("*").alias("n_references"))
    known = objects.select("digest", "size").join(counts, "digest")
    return references.join(known, "digest").select("run_id", "media_id", "digest", "original_path", "size", "n_references")

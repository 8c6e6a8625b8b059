"""Removal of lines that documents share, with an index of line hashes in levelled sorted runs.

Documents come in batches, the largest doc_ids first. The index holds runs of (hash, number of documents, largest doc_id), each
sorted by hash. A batch is merged against the runs: lines that are already settled, that is found in enough documents with the
document that keeps them known, are anti-joined away, and what is left of the batch becomes a run of its own. When a level has
``FAN_OUT`` runs they are compacted into one of the next level. Everything is DataFrame operations.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import discard, materialize

BLANKS = " \t\n\x0b\x0c\r"
FAN_OUT = 3
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def long_lines(documents: DataFrame, least_length: int) -> DataFrame:
    """(d, t, pos, h1, h2): places and 128-bit hashes of the keys of at least ``least_length`` code points.

    d is the doc_id, the least long for null; t is a hash of the text, so rows that share a doc_id keep their own places.
    """
    lines = documents.select(*identity(documents), F.posexplode(split_lines()).alias("pos", "line"))
    keys = lines.where(F.length("line") >= least_length).select("d", "t", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= least_length).select("d", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))


def identity(documents: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(documents["doc_id"].cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(documents["text"]).alias("t")


def split_lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


class LineIndex:
    """Levelled sorted runs in the shared folder. Add batches in falling order of doc_id."""

    def __init__(self, least_documents: int):
        self.least_documents = least_documents
        self.levels: list[list[DataFrame]] = []

    def merged(self) -> DataFrame | None:
        """(h1, h2, n, last) over all runs."""
        runs = [r for level in self.levels for r in level]
        return merge(union(runs)) if runs else None

    def settled(self) -> DataFrame | None:
        found = self.merged()
        return None if found is None else found.where(F.col("n") >= self.least_documents)

    def add(self, lines: DataFrame) -> None:
        """lines: (d, h1, h2) of documents whose d is less than any before, or of the first batch."""
        own = lines.groupBy(*HASH).agg(F.count_distinct("d").alias("n"), F.max("d").alias("last"))
        if (settled := self.settled()) is not None:
            own = own.join(settled, HASH, "left_anti")
        self.put(0, materialize(own.sortWithinPartitions(*HASH), "run"))

    def put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FAN_OUT:
            runs, self.levels[level] = self.levels[level], []
            compacted = materialize(merge(union(runs)).sortWithinPartitions(*HASH), "run")
            for r in runs:
                discard(r)
            self.put(level + 1, compacted)


def merge(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def index_lines(lines: DataFrame, least_documents: int, batches: int) -> LineIndex:
    """The index of a table of long lines, added in ``batches`` ranges of about as many rows each."""
    index = LineIndex(least_documents)
    cuts = lines.agg(F.percentile_approx("d", [k / batches for k in range(1, batches)], 1000)).first()[0]
    cuts = sorted({*(cuts or [])}, reverse=True)
    for k in range(len(cuts) + 1):
        batch = lines
        if k < len(cuts):
            batch = batch.where(F.col("d") > cuts[k])
        if k:
            batch = batch.where(F.col("d") <= cuts[k - 1])
        index.add(batch)
    return index


def dedup_lines(documents: DataFrame, least_length: int = 20, least_documents: int = 3, batches: int = 4) -> DataFrame:
    """``documents`` with the text that is left, and n_lines (before dropping) and n_dropped as longs.

    A line's key is the line without blanks at its ends, A-Z in lower case. Keys of at least ``least_length`` code points that
    are found in at least ``least_documents`` documents lose all their lines except in the largest doc_id that holds them. Null
    and empty texts are one empty line and come out empty. Rows with one doc_id count as one document, and a null doc_id as the
    smallest; repeated rows are treated alike. Other columns are kept, old n_lines and n_dropped replaced. An empty table stays
    empty. doc_id is an integer, or a text that Spark casts to a long (one that isn't is an error).
    """
    documents = documents.drop("n_lines", "n_dropped")
    lines = materialize(long_lines(documents, least_length), "lines")
    shared = materialize(index_lines(lines, least_documents, batches).settled(), "shared-lines")
    drops = lines.join(shared.drop("n"), HASH).where(F.col("d") != F.col("last")).groupBy("d", "t").agg(F.collect_set("pos").alias("drops"))
    rows = documents.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"), *identity(documents))
    found = rows.join(drops, ["d", "t"], "left").withColumn("lines", F.when(F.col("drops").isNotNull(), split_lines()))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    text = F.when(F.col("drops").isNotNull(), kept).otherwise(F.col("text"))
    dropped = F.when(F.col("drops").isNotNull(), F.size("drops")).otherwise(0)
    columns = (text.alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in documents.columns)
    return found.select(*columns, n_lines.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


def without_shared_lines(documents: DataFrame) -> DataFrame:
    """``documents`` with the text that :func:`dedup_lines` leaves, and n_chars, if there is one, counted anew; other columns as they are.

    No row goes: one that has lost all its lines, or has a null text, has an empty one. Repeated rows are treated alike.
    """
    rows = documents.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    fresh = {"text": F.col("text"), "n_chars": F.length("text")}
    kept = ((fresh.get(f.name.lower(), F.col("row").getField(f.name)).cast(f.dataType).alias(f.name)) for f in documents.schema)
    return dedup_lines(rows).select(*kept)


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that is left."""
    return dedup_lines(documents.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), shared AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, line, pos, coalesce(doc_id <> last, false) AS dropped FROM lines LEFT JOIN shared USING (key)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

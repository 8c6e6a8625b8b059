"""Vector and token indexes over the texts of cases, kept as tables by case; ``maintenance.reindexed`` writes them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that are embedded at once.
BATCH = 256
COLUMNS = ("run_id", "type", "id", "timestamp", "content")


def message_texts(message: DataFrame) -> DataFrame:
    """``COLUMNS`` and the text to embed, which tells who wrote to whom."""
    known = [F.coalesce(c, F.lit("unknown")) for c in ("sender", "receiver")]
    text = F.concat(F.lit("From "), known[0], F.lit(" to "), known[1], F.lit(": "), F.coalesce("content", F.lit("")))
    return message.select("run_id", F.lit("message").alias("type"), "id", "timestamp", "content", text.alias("text"))


def vector_index(texts: DataFrame, encode: Callable[[list[str]], Sequence[Sequence[float]]]) -> DataFrame:
    """``COLUMNS`` of texts (and text) with embedding, made by ``encode`` in batches; a blank text is embedded as one blank.

    An encoder that does not give one vector for each text ends the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):
                batch = whole.slice(k, BATCH)
                found = [t if t and t.strip() else " " for t in batch.column("text").to_pylist()]
                vectors = [list(map(float, v)) for v in encode(found)]
                if len(vectors) != len(found):
                    raise ValueError(f"{len(vectors)} vectors of {len(found)} texts")
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COLUMNS), pa.array(vectors, pa.list_(pa.float32()))], names=[*COLUMNS, "embedding"])

    return texts.select(*COLUMNS, "text").mapInArrow(run, "run_id string, type string, id string, timestamp timestamp_ntz, content string, embedding array<float>")


def token_index(texts: DataFrame, text: str = "text") -> DataFrame:
    """(run_id, type, id, token, n): how often each row has each word, in lower case."""
    tokens = texts.select("run_id", "type", "id", F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))
    return tokens.groupBy("run_id", "type", "id", "token").agg(F.count("*").alias("n"))


def case_folders(spark: SparkSession, path: str, run_id: str) -> list:
    """The folders of a case in a stored index, and their file system: none if there is no index."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(root)] if files.exists(root) else []
    return [(files, p) for p in found if unquote(p.getName()) == f"run_id={run_id}"]


def index_exists(spark: SparkSession, path: str, run_id: str) -> bool:
    return bool(case_folders(spark, path, run_id))


def load_index(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The rows of one case; only its folder is read. Its id is taken as text, never as the number that it may look like."""
    folders = [p.toString() for _, p in case_folders(spark, path, run_id)]
    if not folders:
        raise FileNotFoundError(f"no index of case {run_id}")
    return spark.read.parquet(*folders).withColumn("run_id", F.lit(run_id))


def delete_index(spark: SparkSession, path: str, run_id: str) -> bool:
    """Whether there was an index of the case, which is gone now."""
    found = case_folders(spark, path, run_id)
    for files, folder in found:
        files.delete(folder, True)
    return bool(found)

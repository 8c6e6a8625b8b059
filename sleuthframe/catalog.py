"""Evidence tables: fixed schemas, storage partitioned by case, and views over the benchmark tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import parts_of

SCHEMAS = {
    "run": "run_id string, user_id string, file_name string, status string, start_time timestamp_ntz, end_time timestamp_ntz, extraction_metadata string, file_content_hash string, original_file_path string",
    "message": "run_id string, id string, sender string, receiver string, timestamp timestamp_ntz, content string",
    "call": "run_id string, id string, caller string, receiver string, timestamp timestamp_ntz, duration int",
    "contact": "run_id string, id string, name string, number string",
    "media": "run_id string, id string, original_path string, storage_path string, media_type string",
    "artifact": "run_id string, id string, artifact_type string, filename string, file_path string, category string, row_count int, data string, created_at timestamp_ntz",
    "transcript": "run_id string, media_id string, text string, language string, sha256 string",
    "audit_event": "seq bigint, event_type string, run_id string, user_id string, timestamp string, payload string, prev_hash string, entry_hash string",
    "membership": "run_id string, user_id string, role string",
    "entity_index": "run_id string, identifier_hash string, identifier_type string, first_seen timestamp_ntz, last_seen timestamp_ntz, occurrence_count bigint",
}
#: Tables that a case owns, in the order in which a deletion empties them.
CASE_TABLES = ("transcript", "entity_index", "membership", "artifact", "media", "contact", "call", "message", "run")
#: Rows of a join that one task sorts.
SORTED = 1_000_000
#: Tables of up to this many rows may be sent whole to every executor, if Spark finds them small.
SENT = 2_000_000
TIME_COLUMN = {"message": "timestamp", "call": "timestamp", "artifact": "created_at"}

Evidence = Mapping[str, DataFrame]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the columns of ``table``; columns that it lacks are null."""
    fields = [f.strip().split(" ", 1) for f in SCHEMAS[table].split(",")]
    have = {c.lower() for c in df.columns}
    return df.select(*(F.col(n).cast(t).alias(n) if n.lower() in have else F.lit(None).cast(t).alias(n) for n, t in fields))


def save(evidence: Evidence, path: str, mode: str = "append") -> None:
    """One table a folder, partitioned by case and sorted by time within files, so that case and time filters prune."""
    for name, df in evidence.items():
        df = conform(df, name)
        if name == "audit_event":
            df.write.mode(mode).parquet(f"{path}/{name}")
            continue
        if name in TIME_COLUMN:
            df = df.sortWithinPartitions("run_id", TIME_COLUMN[name])
        df.write.mode(mode).partitionBy("run_id").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, run_id: str | None = None) -> dict[str, DataFrame]:
    """The tables under ``path``; one that was never written is empty."""
    found = {}
    for name, schema in SCHEMAS.items():
        try:
            df = conform(spark.read.schema(schema).parquet(f"{path}/{name}"), name)
        except Exception as e:  # the path of a table without rows does not exist
            if "PATH_NOT_FOUND" not in str(e):
                raise
            df = empty(spark, name)
        found[name] = df if run_id is None or name == "audit_event" else df.where(F.col("run_id") == run_id)
    return found


def comm_events(evidence: Evidence) -> DataFrame:
    """Messages and calls as one table of events: (run_id, kind, id, ts, a, b)."""
    message = evidence["message"].select("run_id", F.lit("message").alias("kind"), "id", F.col("timestamp").alias("ts"), F.col("sender").alias("a"), F.col("receiver").alias("b"))
    call = evidence["call"].select("run_id", F.lit("call").alias("kind"), "id", F.col("timestamp").alias("ts"), F.col("caller").alias("a"), F.col("receiver").alias("b"))
    return message.unionByName(call)


# Views over the benchmark tables.


def number(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.lpad(F.col(column).cast("string"), 7, "0"))


def side_by_side(left: DataFrame, right: DataFrame, left_key: str, right_key: str, rows: int) -> DataFrame:
    """``left`` (about ``rows`` rows) joined to ``right``, both dealt into as many parts as leave about ``SORTED`` rows for each (see
    :func:`parts_of`), which Spark doesn't put together for a task to sort. Where there are no more such parts than cores the join is left to Spark.
    """
    parts = parts_of(rows, SORTED)
    if parts > left.sparkSession.sparkContext.defaultParallelism:
        left, right = left.repartition(parts, left_key), right.repartition(parts, right_key)
    return left.join(right, F.col(left_key) == F.col(right_key))


def benchmark_evidence(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "customer", "nation", "part", "events", "pages", "documents")}
    # rows are counted from the footers of files; few lines have few of the others
    n = {"lineitem": t["lineitem"].count()}
    n |= {k: t[k].count() if n["lineitem"] > SORTED else 0 for k in ("orders", "customer", "part")}
    orders = side_by_side(t["orders"], t["customer"].select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey", n["orders"] if n["customer"] > SENT else 0)
    orders = orders.join(F.broadcast(t["nation"].select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    lines = side_by_side(t["lineitem"], orders, "l_orderkey", "o_orderkey", n["lineitem"])
    lines = side_by_side(lines, t["part"].select("p_partkey", "p_name"), "l_partkey", "p_partkey", n["lineitem"] if n["part"] > SENT else 0)
    message = lines.select(
        F.col("n_regionkey").cast("string").alias("run_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("id"),
        number("+1555", "o_custkey").alias("sender"), number("+1556", "l_suppkey").alias("receiver"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"), F.col("p_name").alias("content"),
    )
    call = t["events"].select(
        F.pmod("user_id", F.lit(5)).cast("string").alias("run_id"), F.col("event_id").cast("string").alias("id"), number("+1555", "user_id").alias("caller"),
        F.concat(F.lit("+1557"), "event_type").alias("receiver"), F.col("ts").cast("timestamp_ntz").alias("timestamp"), F.floor("value").cast("int").alias("duration"),
    )
    contact = t["customer"].join(F.broadcast(t["nation"].select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").cast("string").alias("run_id"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), number("+1555", "c_custkey").alias("number")
    )
    media = t["pages"].select(F.lit("0").alias("run_id"), F.col("page_id").cast("string").alias("id"), F.col("url").alias("original_path"), F.col("url").alias("storage_path"), F.lit(None).cast("string").alias("media_type"))
    artifact = t["documents"].select(F.lit("0").alias("run_id"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("filename"), F.col("source").alias("file_path"), F.col("lang").alias("category"), F.col("text").alias("data"))
    return {"message": message, "call": call, "contact": contact, "media": media, "artifact": artifact}


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as a case of its own: (run_id, kind, id, ts, a, b)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "purchase", "call").otherwise("message")
    return events.select(F.col("user_id").cast("string").alias("run_id"), kind.alias("kind"), F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"), number("+1555", "user_id").alias("a"), F.concat(F.lit("+1557"), "event_type").alias("b"))


def customer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer as sparse events."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_custkey").cast("string").alias("run_id"), F.lit("message").alias("kind"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), number("+1555", "o_custkey").alias("a"), F.lit(None).cast("string").alias("b"))

"""Evidence from report files: UFDR, XML, JSON and CSV, chosen by suffix, as the tables message, contact, call and media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import conform, empty
from ..functions.scalars import media_type
from .archives import extracted_files, report_lines

ROWS = {"message": {"sender": "from", "receiver": "to", "timestamp": "timestamp", "content": "content"}, "call": {"caller": "caller", "receiver": "receiver", "timestamp": "timestamp", "duration": "duration"}, "contact": {"name": "name", "number": "number"}}
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd")


def when(column):
    text = F.regexp_replace(column.cast("string"), r"\.\d+", "")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS)).cast("timestamp_ntz")


def normalized(rows: DataFrame, table: str, run_id: str) -> DataFrame:
    """Rows with a report's names as evidence; the id is a hash of the row and its place among equal rows, so it is the same however the rows are dealt."""
    have = {c.lower(): c for c in rows.columns}
    columns = {}
    for name, source in ROWS[table].items():
        value = F.col(have[source]).cast("string") if source in have else F.lit(None).cast("string")
        columns[name] = when(value) if name == "timestamp" else value.try_cast("int") if name == "duration" else value
    found = rows.select(*(v.alias(k) for k, v in columns.items()))
    row = F.sha1(F.to_json(F.struct(F.lit(run_id).alias("run"), F.lit(table).alias("table"), *found.columns)))
    place = F.row_number().over(Window.partitionBy("row").orderBy("row"))
    found = found.withColumn("row", row).withColumn("id", F.sha1(F.concat_ws("|", "row", place))).drop("row")
    return conform(found.withColumn("run_id", F.lit(run_id)), table)


def read_xml(spark: SparkSession, path: str, run_id: str) -> dict[str, DataFrame]:
    found = {}
    for table, names in ROWS.items():
        schema = ", ".join(f"`{n}` string" for n in names.values())
        found[table] = normalized(spark.read.format("xml").option("rowTag", table).schema(schema).load(path), table, run_id)
    return found


def read_json(spark: SparkSession, path: str, run_id: str) -> dict[str, DataFrame]:
    """Lists under the key report (or extraction); lists at the top are not evidence."""
    lists = {f"{t}s": ", ".join(f"`{n}`:string" for n in names.values()) for t, names in ROWS.items()}
    body = "struct<" + ",".join(f"`{k}`:array<struct<{v}>>" for k, v in lists.items()) + ">"
    raw = spark.read.option("multiLine", "true").schema(f"report {body}, extraction {body}").json(path)
    root = raw.select(F.explode(F.array_compact(F.array("report", "extraction"))).alias("r"))
    return {t: normalized(root.select(F.explode(F.col(f"r.{t}s")).alias("x")).select("x.*"), t, run_id) for t in ROWS}


def read_csv(spark: SparkSession, path: str, run_id: str) -> dict[str, DataFrame]:
    """Messages only; a file without the columns from and content has none."""
    rows = spark.read.option("header", "true").csv(path)
    have = {c.lower() for c in rows.columns}
    message = normalized(rows, "message", run_id) if {"from", "content"} <= have else empty(spark, "message")
    return {"message": message}


def read_ufdr(spark: SparkSession, path: str, run_id: str, staging: str) -> dict[str, DataFrame]:
    """The report of an extraction archive, and as media the files that it maps.

    Reports are unpacked once below ``staging``, each to a file of its own.
    """
    lines = report_lines(spark, path).withColumn("report", F.sha1("source")).sortWithinPartitions("report", "line_no")
    lines.select("report", "line").write.mode("overwrite").partitionBy("report").text(staging)
    files = extracted_files(spark, path)
    media = files.select(F.col("original_path").alias("path"), F.concat_ws("!", "source", "local_path").alias("storage_path")).distinct()
    return read_xml(spark, staging, run_id) | {"media": media_table(media, run_id)}


READERS = {".xml": read_xml, ".json": read_json, ".csv": read_csv}


def read_report(spark: SparkSession, path: str, run_id: str, staging: str | None = None) -> dict[str, DataFrame]:
    """Evidence of a report file or a glob of such files, by suffix; a .ufdr needs a folder to unpack to."""
    suffix = "." + path.rsplit(".", 1)[-1].lower()
    if suffix == ".ufdr":
        if staging is None:
            raise ValueError("a .ufdr needs a folder for its report")
        return read_ufdr(spark, path, run_id, staging)
    if suffix not in READERS:
        raise ValueError(f"unknown kind of report: {path}")
    return READERS[suffix](spark, path, run_id)


def media_table(files: DataFrame, run_id: str) -> DataFrame:
    """Evidence media from a listing (path, and storage_path where files lie elsewhere), with the kind that the extension tells."""
    stored = "storage_path" if "storage_path" in files.columns else "path"
    return conform(files.select(F.lit(run_id).alias("run_id"), F.sha1("path").alias("id"), F.col("path").alias("original_path"), F.col(stored).alias("storage_path"), media_type(F.col("path")).alias("media_type")), "media")

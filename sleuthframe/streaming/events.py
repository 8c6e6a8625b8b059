"""Evidence as it arrives: daily volumes and duplicates over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import hadoop_path


def landing(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_of_each(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events (run_id, id, ts, ...) without repetitions of an id; state is kept as long as events may be late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "id"])


def daily_volumes(events: DataFrame, late: str | None = "1 day") -> DataFrame:
    """(run_id, day, kind, n) of days that no event can join any more; ``late`` is None where the events have their watermark already."""
    dated = events.where("ts is not null")
    days = (dated.withWatermark("ts", late) if late else dated).groupBy("run_id", F.window("ts", "1 day"), "kind").agg(F.count("*").alias("n"))
    return days.select("run_id", F.col("window.start").alias("day"), "kind", "n")


ACCOUNTS = "batch long, events long, without_time long, late long, latest timestamp"


def accounted(events: DataFrame, accounts: str, checkpoint: str, late: str = "1 day"):
    """A writer of one row for each batch of a stream of events (ts, ...): how many it had, how many had no time, and how many came so late
    that :func:`daily_volumes` left them out.

    A batch's watermark is the latest time that batches before it had seen, less the delay. A batch that is done again after a
    failure replaces its own row. Start it on the same source and with the same limits as the volumes.
    """

    def account(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = written_accounts(spark, accounts).where(F.col("batch") < number)
        seen = known.agg(F.max("latest").alias("seen"))
        mark = F.col("seen").cast("timestamp") - F.expr(f"INTERVAL {late}")
        # a day is over for good once its end is not after the watermark
        over = F.date_trunc("day", F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 DAY") <= mark
        row = batch.join(F.broadcast(seen)).agg(F.count("*").alias("events"), F.count_if(F.col("ts").isNull()).alias("without_time"), F.count_if(F.coalesce(over, F.lit(False))).alias("late"), F.max(F.col("ts").cast("timestamp")).alias("latest"))
        row.select("events", "without_time", "late", "latest").coalesce(1).write.mode("overwrite").parquet(f"{accounts}/batch={number}")

    return events.writeStream.foreachBatch(account).option("checkpointLocation", checkpoint)


def written_accounts(spark: SparkSession, accounts: str) -> DataFrame:
    """The rows of all batches so far; none before the first."""
    filesystem, path = hadoop_path(spark, accounts)
    if not filesystem.exists(path):
        return spark.createDataFrame([], ACCOUNTS)
    return spark.read.schema(ACCOUNTS).parquet(accounts).select("batch", "events", "without_time", "late", "latest")


def totals(accounts: DataFrame) -> DataFrame:
    """(batches, events, without_time, late) over all batches."""
    return accounts.agg(F.count("*").alias("batches"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("events", "without_time", "late")))

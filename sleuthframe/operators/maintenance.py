"""Maintenance of evidence stores: deletions, re-indexing, transcripts, caches and samples, as rewrites of tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import CASE_TABLES, Evidence


def without_runs(evidence: Evidence, runs: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given cases (run_id)."""
    return {n: df.join(runs.select("run_id"), "run_id", "left_anti").select(*df.columns) if n in CASE_TABLES else df for n, df in evidence.items()}


def empty_runs(evidence: Evidence, tables: tuple[str, ...] = ("message", "call", "contact", "media", "artifact")) -> DataFrame:
    """Cases without a row in any table: one anti-join a table, so that none multiplies another's rows."""
    runs = evidence["run"].select("run_id")
    for t in tables:
        if t in evidence:
            runs = runs.join(evidence[t].select("run_id"), "run_id", "left_anti")
    return runs


def runs_with_data(evidence: Evidence, tables: tuple[str, ...] = ("message", "call", "contact", "media")) -> DataFrame:
    return evidence["run"].join(empty_runs(evidence, tables), "run_id", "left_anti")


def processed_before(evidence: Evidence, file_hash: str) -> DataFrame:
    """The latest complete case of the same file that has data."""
    same = runs_with_data(evidence).where((F.col("file_content_hash") == file_hash) & (F.col("status") == "complete"))
    return same.orderBy(F.desc_nulls_last("start_time"), "run_id").limit(1)


def counts(evidence: Evidence) -> DataFrame:
    """(table, run_id, n) of all tables that belong to cases."""
    found = None
    for n in CASE_TABLES:
        if n in evidence:
            part = evidence[n].groupBy("run_id").agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "run_id", "n")
            found = part if found is None else found.unionByName(part)
    return found


def upserted(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the rows of ``changes`` in place of those with equal keys."""
    return existing.join(changes.select(*keys).distinct(), keys, "left_anti").select(*existing.columns).unionByName(changes.select(*existing.columns))


def reindexed(index_path: str, index: DataFrame) -> None:
    """Write an index over its cases: their partitions are replaced, others stay, so doing it again changes nothing."""
    index.write.mode("overwrite").partitionBy("run_id").option("partitionOverwriteMode", "dynamic").parquet(index_path)


def transcribed(media: DataFrame, transcripts: DataFrame, transcriber: Callable[[str], str]) -> DataFrame:
    """``transcripts`` with those of all audio files, made by ``transcriber`` from a path; repeated runs replace their own rows."""
    from ..functions.scalars import is_audio

    @F.pandas_udf("string")
    def speak(paths: pd.Series) -> pd.Series:
        return paths.map(transcriber, na_action="ignore")

    audio = media.where(is_audio(F.col("media_type"), F.col("original_path")))
    made = audio.select("run_id", F.col("id").alias("media_id"), speak(F.coalesce("storage_path", "original_path")).alias("text"), F.lit(None).cast("string").alias("language"))
    return upserted(transcripts, made.withColumn("sha256", F.sha2("text", 256)), ["run_id", "media_id"])


def stale(files: DataFrame, now: datetime, days: int) -> DataFrame:
    """Files (path, modified) last changed more than ``days`` days ago."""
    return files.where(F.col("modified") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def sampled(files: DataFrame, limits: dict[str, int], category: str = "category", order: str = "path") -> DataFrame:
    """At most so many rows of each category, the first in order; a category without a limit has none."""
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.col(category)]
    w = Window.partitionBy(category).orderBy(order)
    return files.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= F.coalesce(limit, F.lit(0))).drop("rank_")


def report_rows(results: DataFrame, rules: DataFrame, runs: DataFrame, users: DataFrame) -> DataFrame:
    """Results with the title of their rule, their case's file and its owner, where these are known."""
    return results.join(rules.select("rule_id", F.col("title").alias("rule_title")), "rule_id", "left").join(runs.select("run_id", "file_name", "user_id"), "run_id", "left").join(users.select("user_id", "username"), "user_id", "left")


def counts_by_type(results: DataFrame) -> DataFrame:
    return results.groupBy("result_type").agg(F.count("*").alias("n"))


def report_summary(results: DataFrame, order: str = "result_id", sample: int = 5) -> DataFrame:
    """(result_type, n, sample): counts of each type, and of all results the first few in order, under the types they have."""
    first = results.orderBy(order).limit(sample).select("result_type", F.col(order).alias("first"))
    kept = first.groupBy("result_type").agg(F.array_sort(F.collect_list("first")).alias("sample"))
    return counts_by_type(results).join(kept, "result_type", "left")


def differences(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """The rows, with ``difference`` extra or missing, by which a table is not exactly the expected one; repeated rows count."""
    columns = expected.columns
    found = actual.select(*columns)
    return found.exceptAll(expected).withColumn("difference", F.lit("extra")).unionByName(expected.exceptAll(found).withColumn("difference", F.lit("missing")))


def validated_sample(evidence: Evidence, run_id: str, expected: dict[str, DataFrame]) -> None:
    """Raise unless the case's tables hold exactly the ``expected`` rows, and all its other tables none."""
    for name, table in evidence.items():
        if "run_id" not in table.columns or name == "run" and name not in expected:
            continue
        rows = table.where(F.col("run_id") == run_id)
        wrong = rows if name not in expected else differences(rows, expected[name])
        if not wrong.isEmpty():
            raise ValueError(f"table {name} of case {run_id} is not that of the sample")

"""Identifiers that cases have in common, found by keyed hashes only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Evidence
from ..functions.identifiers import check_key, hmac_sha256, normalize


def mentions(evidence: Evidence) -> DataFrame:
    """(run_id, raw, ts): each identifier of messages, calls and contacts; contacts have no time."""
    none = F.lit(None).cast("timestamp_ntz")
    columns = [("message", "sender", F.col("timestamp")), ("message", "receiver", F.col("timestamp")), ("call", "caller", F.col("timestamp")), ("call", "receiver", F.col("timestamp")), ("contact", "number", none)]
    found = None
    for table, column, ts in columns:
        part = evidence[table].select("run_id", F.col(column).alias("raw"), ts.alias("ts"))
        found = part if found is None else found.unionByName(part)
    return found


def entity_index(evidence: Evidence, key: str) -> DataFrame:
    """(run_id, identifier_hash, identifier_type, first_seen, last_seen, occurrence_count) of phone numbers and addresses."""
    secret = check_key(key)
    known = mentions(evidence).withColumn("known", normalize(F.col("raw"))).where("known is not null")
    # counted by canonical value first, so that a value is hashed once
    counted = known.groupBy("run_id", F.col("known.value").alias("value"), F.col("known.type").alias("identifier_type")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("occurrence_count"))
    return counted.select("run_id", hmac_sha256(F.col("value"), secret).alias("identifier_hash"), "identifier_type", "first_seen", "last_seen", "occurrence_count")


def links(index: DataFrame, run_id: str) -> DataFrame:
    """Identifiers of a case that other cases have too: (identifier_hash, identifier_type, other_runs, case_count)."""
    own = index.where(F.col("run_id") == run_id).select("identifier_hash", "identifier_type").distinct()
    others = index.where(F.col("run_id") != run_id).groupBy("identifier_hash").agg(F.array_sort(F.collect_set("run_id")).alias("other_runs"))
    return own.join(others, "identifier_hash").withColumn("case_count", F.size("other_runs") + 1)


def all_links(index: DataFrame) -> DataFrame:
    """Every identifier of two cases or more: (identifier_hash, identifier_type, runs, case_count)."""
    return index.groupBy("identifier_hash", "identifier_type").agg(F.array_sort(F.collect_set("run_id")).alias("runs")).withColumn("case_count", F.size("runs")).where("case_count >= 2")


ROLES = {"viewer": 1, "editor": 2, "owner": 3}


def visible_runs(runs: DataFrame, membership: DataFrame, user_id: str, least_role: str = "viewer") -> DataFrame:
    """(run_id, role) of the cases that a user owns or is a member of with at least ``least_role``; an unknown role raises."""
    owned = runs.where(F.col("user_id") == user_id).select("run_id", F.lit("owner").alias("role"))
    granted = membership.where(F.col("user_id") == user_id).select("run_id", "role")
    rank = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))[F.col("role")]
    checked = owned.unionByName(granted).withColumn("rank", F.when(rank.isNull(), F.raise_error(F.concat(F.lit("unknown role "), F.coalesce("role", F.lit("null"))))).otherwise(rank))
    best = checked.groupBy("run_id").agg(F.max_by("role", "rank").alias("role"), F.max("rank").alias("rank"))
    return best.where(F.col("rank") >= ROLES[least_role]).select("run_id", "role")


def visible_links(index: DataFrame, visible: DataFrame) -> DataFrame:
    """Links recounted over the cases that a user may see."""
    return all_links(index.join(visible.select("run_id"), "run_id", "left_semi"))

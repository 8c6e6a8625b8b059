"""Queries over the benchmark tables, one for each operator, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog
from .artifacts.chunks import joined_chunks
from .artifacts.registry import artifacts, run_artifact
from .functions import identifiers, scalars
from .operators import crosscase, custody, graph, index, maintenance, patterns, search, temporal
from .plans.compiler import MAPPINGS, matches, preview, run_plan
from .plans.ir import Predicate, QueryPlan, Target
from .plans.questions import plan_of
from .sinks import outputs
from .sources import archives

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

KEY = "benchmark key"
#: All cases of the benchmark views.
CASES = ["0", "1", "2", "3", "4"]
NOW = datetime(2024, 6, 1)
#: HMAC-SHA256 of the benchmark key as SQL text, composed as the engine composes it.
INNER, OUTER = ("".join(f"{b ^ pad:02x}" for b in KEY.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C))

# The evidence views in SQL; each query's SQL names the ones it needs.
VIEWS = {
    "message": """message AS (SELECT CAST(n_regionkey AS VARCHAR) AS run_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS id,
      '+1555' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS sender, '+1556' || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') AS receiver, CAST(o_orderdate AS TIMESTAMP) AS "timestamp", p_name AS content
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)""",
    "call": """call AS (SELECT CAST(user_id % 5 AS VARCHAR) AS run_id, CAST(event_id AS VARCHAR) AS id, '+1555' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS caller, '+1557' || event_type AS receiver,
      CAST(ts AS TIMESTAMP) AS "timestamp", CAST(floor(value) AS INTEGER) AS duration FROM events)""",
    "contact": """contact AS (SELECT CAST(n_regionkey AS VARCHAR) AS run_id, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, '+1555' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS number
      FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "comm": """comm AS (SELECT run_id, 'message' AS kind, id, "timestamp" AS ts, sender AS a, receiver AS b FROM message UNION ALL SELECT run_id, 'call', id, "timestamp", caller, receiver FROM call)""",
    "ue": """ue AS (SELECT CAST(user_id AS VARCHAR) AS run_id, CASE WHEN event_type = 'purchase' THEN 'call' ELSE 'message' END AS kind, CAST(event_id AS VARCHAR) AS id, CAST(ts AS TIMESTAMP) AS ts,
      '+1555' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS a, '+1557' || event_type AS b FROM events)""",
    "ce": """ce AS (SELECT CAST(o_custkey AS VARCHAR) AS run_id, 'message' AS kind, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders)""",
    "series": """days AS (SELECT run_id, CAST(ts AS DATE) AS d, count(*) FILTER (kind = 'message') AS messages, count(*) FILTER (kind = 'call') AS calls FROM ue GROUP BY ALL),
      spans AS (SELECT run_id, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM days GROUP BY run_id),
      series AS (SELECT run_id, d, coalesce(messages, 0) AS messages, coalesce(calls, 0) AS calls, coalesce(messages, 0) + coalesce(calls, 0) AS total FROM spans LEFT JOIN days USING (run_id, d))""",
}


def query(*views: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = ("WITH " + ", ".join(VIEWS[v] for v in views) + "\n" if views else "") + sql.strip()
        return f

    return add


def evidence(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return catalog.benchmark_evidence(spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cites(df: DataFrame) -> DataFrame:
    """One row for each citation."""
    return df.select("source_table", "row_id", "event_time", F.explode("citations").alias("c")).select("source_table", "row_id", "event_time", F.col("c.column").alias("cited_column"), "c.matched_value", F.col("c.char_start").cast("long").alias("char_start"), F.col("c.char_end").cast("long").alias("char_end"))


# Plans.


@query("message", sql="""
SELECT 'message' AS source_table, id AS row_id, strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS event_time, 'content' AS cited_column, substr(content, strpos(lower(content), 'red'), 3) AS matched_value,
  CAST(strpos(lower(content), 'red') - 1 AS BIGINT) AS char_start, CAST(strpos(lower(content), 'red') + 2 AS BIGINT) AS char_end
FROM message WHERE run_id = '1' AND strpos(lower(content), 'red') > 0 ORDER BY event_time DESC, row_id DESC LIMIT 100
""")
def plan_contains_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = QueryPlan((Target.messages,), (Predicate("text", "contains", ("Red",)),))
    return cites(run_plan(plan, evidence(spark, sf_dir), "1"))


@query("message", "call", sql="""
, hits AS (
  SELECT 'message' AS source_table, id AS row_id, CAST((sender IN ('+15550000001', '+15550000007')) AS INTEGER) + CAST((receiver IN ('+15550000001', '+15550000007')) AS INTEGER) + CAST((strpos(lower(content), 'green') > 0) AS INTEGER) AS n
  FROM message WHERE run_id = '2' UNION ALL
  SELECT 'call', id, CAST((caller IN ('+15550000001', '+15550000007')) AS INTEGER) + CAST((receiver IN ('+15550000001', '+15550000007')) AS INTEGER) FROM call WHERE run_id = '2'
)
SELECT source_table, row_id, CAST(n AS BIGINT) AS n_citations FROM hits WHERE n > 0
""")
def plan_in_match_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = QueryPlan((Target.messages, Target.calls), (Predicate("participant", "in", ("+15550000001", "+15550000007")), Predicate("text", "contains", ("green",))), match="any")
    return matches(plan, evidence(spark, sf_dir), "2").select("source_table", "row_id", F.size("citations").cast("long").alias("n_citations"))


@query("message", sql="""
SELECT 'message' AS source_table, id AS row_id FROM message WHERE run_id = '2' AND receiver = '+15560000005' AND strpos(lower(content), 'cold') > 0
""")
def plan_equals_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and media can't hold a text predicate of a message, so they are left out."""
    plan = QueryPlan((Target.messages, Target.calls, Target.media), (Predicate("participant", "equals", ("+15560000005",)), Predicate("text", "contains", ("cold",))))
    return matches(plan, evidence(spark, sf_dir), "2").select("source_table", "row_id")


@query("message", "call", "contact", sql="""
, found AS (
  SELECT 'message' AS source_table, id AS row_id, strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS event_time FROM message WHERE run_id = '3' AND "timestamp" BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2024-01-10' AND (sender = '+15550000003' OR receiver = '+15550000003')
  UNION ALL SELECT 'call', id, strftime("timestamp", '%Y-%m-%dT%H:%M:%S') FROM call WHERE run_id = '3' AND "timestamp" BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2024-01-10' AND (caller = '+15550000003' OR receiver = '+15550000003')
  UNION ALL SELECT 'contact', id, NULL FROM contact WHERE run_id = '3' AND number = '+15550000003'
)
SELECT * FROM found ORDER BY event_time ASC NULLS LAST, source_table, row_id LIMIT 50 OFFSET 2
""")
def plan_time_range_multi_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = QueryPlan((Target.messages, Target.calls, Target.contacts), (Predicate("participant", "equals", ("+15550000003",)),), start=datetime(1996, 1, 1), end=datetime(2024, 1, 10), sort="asc", limit=50, offset=2)
    return run_plan(plan, evidence(spark, sf_dir), "3").select("source_table", "row_id", "event_time")


@query(sql="""
SELECT CAST(doc_id AS VARCHAR) AS row_id, CASE WHEN length(t) > 160 THEN substr(t, 1, 160) || '…' ELSE t END AS preview
FROM (SELECT doc_id, coalesce(nullif(text, ''), nullif(source, ''), 'artifact:' || doc_id) AS t FROM documents)
""")
def preview_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir)["artifact"].select(F.col("id").alias("row_id"), preview("artifact", MAPPINGS[Target.artifacts].searchable).alias("preview"))


@query(sql="""
SELECT CAST(doc_id AS VARCHAR) AS row_id, substr(text, strpos(lower(text), 'tion'), 4) AS matched_value, CAST(strpos(lower(text), 'tion') - 1 AS BIGINT) AS char_start FROM documents WHERE strpos(lower(text), 'tion') > 0
""")
def citations_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifact = evidence(spark, sf_dir)["artifact"].withColumn("filename", F.lit("")).withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    found = matches(QueryPlan((Target.artifacts,), (Predicate("text", "contains", ("tion",)),)), {"artifact": artifact}, "0")
    return cites(found).select("row_id", "matched_value", "char_start")


# Time.


@query("ue", "series", sql="SELECT run_id, strftime(d, '%Y-%m-%d') AS d, CAST(messages AS BIGINT) AS messages, CAST(calls AS BIGINT) AS calls FROM series")
def daily_series_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.daily_series(catalog.user_events(spark, sf_dir)).select("run_id", F.date_format("d", "yyyy-MM-dd").alias("d"), "messages", "calls")


@query("ue", "series", sql="""
, w AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n, sum(total) OVER (PARTITION BY run_id) AS s, sum(total * total) OVER (PARTITION BY run_id) AS q FROM series),
o AS (SELECT run_id, d, total, (s - total) / (n - 1) AS mean, (q - total * total) / (n - 1) AS square FROM w WHERE n >= 3 AND total >= 5)
SELECT run_id, strftime(d, '%Y-%m-%d') AS d, CAST(total AS BIGINT) AS volume, round((total - mean) / sqrt(square - mean * mean), 4) AS z_score FROM o WHERE square - mean * mean > 1e-12 AND (total - mean) / sqrt(square - mean * mean) >= 2
""")
def spike_loo_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.spike_scores(temporal.daily_series(catalog.user_events(spark, sf_dir)))
    return found.select("run_id", F.date_format("d", "yyyy-MM-dd").alias("d"), F.col("total").alias("volume"), F.round("z", 4).alias("z_score"))


@query("ue", sql="""
SELECT run_id, count(*) FILTER (hour(ts) < 5) AS late, count(*) AS n_events, round(count(*) FILTER (hour(ts) < 5) / count(*), 6) AS ratio FROM ue GROUP BY run_id HAVING late >= 6 AND count(*) FILTER (hour(ts) < 5) / count(*) >= 0.25
""")
def late_night_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.late_night_shares(catalog.user_events(spark, sf_dir)).select("run_id", "late", F.col("events").alias("n_events"), F.round("ratio", 6).alias("ratio"))


@query("ce", sql="""
, days AS (SELECT DISTINCT run_id, CAST(ts AS DATE) AS d FROM ce), g AS (SELECT run_id, lag(d) OVER (PARTITION BY run_id ORDER BY d) AS before, d AS after, count(*) OVER (PARTITION BY run_id) AS n FROM days),
r AS (SELECT *, date_diff('day', before, after) AS gap, row_number() OVER (PARTITION BY run_id ORDER BY date_diff('day', before, after) DESC, before DESC) AS k FROM g WHERE before IS NOT NULL AND n >= 3)
SELECT run_id, CAST(gap AS BIGINT) AS gap, strftime(before, '%Y-%m-%d') AS before, strftime(after, '%Y-%m-%d') AS after FROM r WHERE k = 1 AND gap >= 14
""")
def dormancy_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.longest_gaps(catalog.customer_events(spark, sf_dir))
    return found.select("run_id", F.col("gap").cast("long").alias("gap"), F.date_format("before", "yyyy-MM-dd").alias("before"), F.date_format("after", "yyyy-MM-dd").alias("after"))


@query("ue", "series", sql="""
, m AS (SELECT run_id, d, row_number() OVER w AS i, count(*) OVER (PARTITION BY run_id) AS n, avg(total) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS before, avg(total) OVER (w ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS after FROM series WINDOW w AS (PARTITION BY run_id ORDER BY d)),
f AS (SELECT *, (before - after) / before AS fall FROM m WHERE i > 7 AND i <= n - 6 AND before >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(fall, 9) DESC, d) AS k FROM f WHERE fall >= 0.6)
SELECT run_id, strftime(d, '%Y-%m-%d') AS d, round(before, 4) AS before_mean, round(after, 4) AS after_mean FROM r WHERE k = 1
""")
def drop_changepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.change_points(temporal.daily_series(catalog.user_events(spark, sf_dir)))
    return found.select("run_id", F.date_format("d", "yyyy-MM-dd").alias("d"), F.round("before", 4).alias("before_mean"), F.round("after", 4).alias("after_mean"))


BURSTS = """
, a AS (SELECT *, avg(total) OVER (PARTITION BY run_id) AS mean FROM series), u AS (SELECT run_id, d, total, d - CAST(row_number() OVER (PARTITION BY run_id ORDER BY d) AS INTEGER) AS island FROM a WHERE total > mean)
SELECT run_id, strftime(min(d), '%Y-%m-%d') AS first_day, strftime(max(d), '%Y-%m-%d') AS last_day, count(*) AS n_days, CAST(sum(total) AS BIGINT) AS n_events FROM u GROUP BY run_id, island HAVING count(*) >= 3
"""


@query("ue", "series", sql=BURSTS)
def bursts_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.burst_runs(temporal.daily_series(catalog.user_events(spark, sf_dir)))
    return found.select("run_id", F.date_format("first", "yyyy-MM-dd").alias("first_day"), F.date_format("last", "yyyy-MM-dd").alias("last_day"), "n_days", "n_events")


@query("message", "call", "comm", sql="""
, p AS (SELECT run_id, ts, kind, id, 0 AS side, a AS party FROM comm UNION ALL SELECT run_id, ts, kind, id, 1, b FROM comm),
k AS (SELECT *, CASE WHEN length(regexp_replace(party, '[^0-9]', '', 'g')) >= 7 THEN regexp_replace(party, '[^0-9]', '', 'g') ELSE party END AS key FROM p WHERE party IS NOT NULL AND party <> ''),
s AS (SELECT run_id, min(CAST(ts AS DATE)) AS start FROM comm GROUP BY run_id)
SELECT run_id, key, strftime(min(CAST(ts AS DATE)), '%Y-%m-%d') AS emerged, count(*) AS n_events FROM k JOIN s USING (run_id) GROUP BY run_id, key, start HAVING date_diff('day', start, min(CAST(ts AS DATE))) >= 7 AND count(*) >= 8
""")
def new_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.emergences(catalog.comm_events(evidence(spark, sf_dir)))
    return found.select("run_id", "key", F.date_format("emerged", "yyyy-MM-dd").alias("emerged"), "n_events")


@query("ue", "series", sql="""
, w AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n, sum(total) OVER (PARTITION BY run_id) AS s, sum(total * total) OVER (PARTITION BY run_id) AS q FROM series),
o AS (SELECT run_id, d, total, (s - total) / (n - 1) AS mean, (q - total * total) / (n - 1) AS square FROM w WHERE n >= 3 AND total >= 5),
z AS (SELECT run_id, d, total, (total - mean) / sqrt(square - mean * mean) AS z FROM o WHERE square - mean * mean > 1e-12),
night AS (SELECT run_id FROM ue GROUP BY run_id HAVING count(*) FILTER (hour(ts) < 5) >= 6 AND count(*) FILTER (hour(ts) < 5) / count(*) >= 0.25),
night_days AS (SELECT run_id, CAST(ts AS DATE) AS d, count(*) AS n FROM ue JOIN night USING (run_id) WHERE hour(ts) < 5 GROUP BY ALL),
active AS (SELECT run_id, CAST(ts AS DATE) AS d, count(*) AS events FROM ue GROUP BY ALL),
g AS (SELECT run_id, lag(d) OVER v AS before, d AS after, events + lag(events) OVER v AS events, count(*) OVER (PARTITION BY run_id) AS n FROM active WINDOW v AS (PARTITION BY run_id ORDER BY d)),
silent AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY date_diff('day', before, after) DESC, before DESC) AS k FROM g WHERE before IS NOT NULL AND n >= 3),
m AS (SELECT run_id, d, row_number() OVER v AS i, count(*) OVER (PARTITION BY run_id) AS n, avg(total) OVER (v ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS before, avg(total) OVER (v ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS after, sum(total) OVER (v ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS events FROM series WINDOW v AS (PARTITION BY run_id ORDER BY d)),
fallen AS (SELECT *, (before - after) / before AS fall FROM m WHERE i > 7 AND i <= n - 6 AND before >= 2), drops AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(fall, 9) DESC, d) AS k FROM fallen WHERE fall >= 0.6),
a AS (SELECT *, avg(total) OVER (PARTITION BY run_id) AS mean FROM series), u AS (SELECT run_id, d, total, d - CAST(row_number() OVER (PARTITION BY run_id ORDER BY d) AS INTEGER) AS island FROM a WHERE total > mean),
party AS (SELECT run_id, CAST(ts AS DATE) AS d, regexp_replace(a, '[^0-9]', '', 'g') AS key FROM ue UNION ALL SELECT run_id, CAST(ts AS DATE), b FROM ue),
found AS (
  SELECT run_id, 'spike' AS type, CASE WHEN z >= 3 THEN 'high' ELSE 'medium' END AS severity, strftime(d, '%Y-%m-%d') AS dates, total AS n FROM z WHERE z >= 2
  UNION ALL SELECT run_id, 'late_night', 'medium', array_to_string(list_sort(list(strftime(d, '%Y-%m-%d')))[1:10], ','), sum(n) FROM night_days GROUP BY run_id
  UNION ALL SELECT run_id, 'dormancy', 'high', strftime(before, '%Y-%m-%d') || ',' || strftime(after, '%Y-%m-%d'), events FROM silent WHERE k = 1 AND date_diff('day', before, after) >= 14
  UNION ALL SELECT run_id, 'drop', CASE WHEN fall >= 0.8 THEN 'high' ELSE 'medium' END, strftime(d, '%Y-%m-%d'), events FROM drops WHERE k = 1
  UNION ALL SELECT run_id, 'burst', 'low', strftime(min(d), '%Y-%m-%d') || ',' || strftime(max(d), '%Y-%m-%d'), sum(total) FROM u GROUP BY run_id, island HAVING count(*) >= 3
  UNION ALL SELECT run_id, 'new_contact', 'medium', strftime(min(party.d), '%Y-%m-%d'), count(*) FROM party JOIN (SELECT run_id, min(d) AS start FROM active GROUP BY run_id) USING (run_id) GROUP BY run_id, key, start HAVING date_diff('day', start, min(party.d)) >= 7 AND count(*) >= 8
)
SELECT run_id, type, severity, dates, CAST(least(n, 25) AS BIGINT) AS n_citations FROM found
""")
def findings_union_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.analyze(catalog.user_events(spark, sf_dir))
    return found.select("run_id", "type", "severity", F.array_join("dates", ",").alias("dates"), F.size("citations").cast("long").alias("n_citations"))


@query("ue", "series", sql="""
, a AS (SELECT *, avg(total) OVER (PARTITION BY run_id) AS mean FROM series), u AS (SELECT run_id, d, total, d - CAST(row_number() OVER (PARTITION BY run_id ORDER BY d) AS INTEGER) AS island FROM a WHERE total > mean),
b AS (SELECT run_id, min(d) AS f, max(d) AS l FROM u GROUP BY run_id, island HAVING count(*) >= 3),
c AS (SELECT b.run_id, f, kind, id, row_number() OVER (PARTITION BY b.run_id, f ORDER BY ts, kind, id) AS k FROM ue JOIN b ON ue.run_id = b.run_id AND CAST(ts AS DATE) BETWEEN f AND l)
SELECT run_id, strftime(f, '%Y-%m-%d') AS first_day, kind AS source_table, id AS row_id FROM c WHERE k <= 25
""")
def finding_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.bursts(catalog.user_events(spark, sf_dir))
    return found.select("run_id", F.col("dates")[0].alias("first_day"), F.explode("citations").alias("c")).select("run_id", "first_day", "c.source_table", "c.row_id")


# Identifiers and cases.


@query("contact", sql=r"""
, raw AS (SELECT DISTINCT number AS v FROM contact UNION ALL SELECT '+1 (555) 010-' || c_custkey FROM customer UNION ALL SELECT 'Foo' || c_custkey || '@Bar.COM ' FROM customer UNION ALL SELECT c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT v AS raw, CASE WHEN regexp_matches(trim(v), '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN lower(trim(v)) WHEN length(regexp_replace(v, '[^0-9]', '', 'g')) >= 7 THEN regexp_replace(v, '[^0-9]', '', 'g') END AS canonical,
  CASE WHEN regexp_matches(trim(v), '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 'email' WHEN length(regexp_replace(v, '[^0-9]', '', 'g')) >= 7 THEN 'phone' END AS kind FROM raw
""")
def identifier_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, contact = table(spark, sf_dir, "customer"), evidence(spark, sf_dir)["contact"]
    raw = contact.select(F.col("number").alias("raw")).distinct()
    raw = raw.unionByName(customer.select(F.concat(F.lit("+1 (555) 010-"), "c_custkey").alias("raw")))
    raw = raw.unionByName(customer.select(F.concat(F.lit("Foo"), "c_custkey", F.lit("@Bar.COM ")).alias("raw"))).unionByName(customer.select(F.col("c_mktsegment").alias("raw")).distinct())
    found = raw.withColumn("n", identifiers.normalize(F.col("raw")))
    return found.select("raw", F.col("n.value").alias("canonical"), F.col("n.type").alias("kind"))


HMAC = f"sha256(from_hex('{OUTER}') || from_hex(sha256(from_hex('{INNER}') || encode(%s))))"


@query("contact", sql=f"SELECT DISTINCT number, {HMAC % "regexp_replace(number, '[^0-9]', '', 'g')"} AS identifier_hash FROM contact")
def identifier_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir)["contact"].select("number").distinct().select("number", identifiers.identifier_hash(F.col("number"), KEY).alias("identifier_hash"))


MENTIONS = """, mention AS (SELECT run_id, sender AS raw, "timestamp" AS ts FROM message UNION ALL SELECT run_id, receiver, "timestamp" FROM message UNION ALL SELECT run_id, caller, "timestamp" FROM call UNION ALL SELECT run_id, receiver, "timestamp" FROM call UNION ALL SELECT run_id, number, NULL FROM contact),
counted AS (SELECT run_id, regexp_replace(raw, '[^0-9]', '', 'g') AS v, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM mention WHERE length(regexp_replace(raw, '[^0-9]', '', 'g')) >= 7 GROUP BY ALL)"""


@query("message", "call", "contact", sql=MENTIONS + f"""
SELECT run_id, {HMAC % "v"} AS identifier_hash, 'phone' AS identifier_type, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, n AS occurrence_count FROM counted
""")
def occurrence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = crosscase.entity_index(evidence(spark, sf_dir), KEY)
    return index.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")})


@query("message", "call", "contact", sql=MENTIONS + f"""
SELECT {HMAC % "v"} AS identifier_hash, string_agg(run_id, ',' ORDER BY run_id) FILTER (run_id <> '1') AS other_runs, count(*) AS case_count FROM counted GROUP BY v HAVING bool_or(run_id = '1') AND count(*) >= 2
""")
def cross_case_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crosscase.links(crosscase.entity_index(evidence(spark, sf_dir), KEY), "1")
    return found.select("identifier_hash", F.array_join("other_runs", ",").alias("other_runs"), F.col("case_count").cast("long").alias("case_count"))


@query("message", "call", "contact", sql=MENTIONS + f"""
SELECT {HMAC % "v"} AS identifier_hash, string_agg(run_id, ',' ORDER BY run_id) AS runs, count(*) AS case_count FROM counted WHERE run_id IN ('0', '2', '3') GROUP BY v HAVING count(*) >= 2
""")
def rbac_visible_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user owns case 0 and is a member of 2 and 3."""
    runs = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("run_id"), F.concat(F.lit("u"), "r_regionkey").alias("user_id"))
    granted = runs.where("run_id in ('2', '3')").select("run_id", F.lit("u0").alias("user_id"), F.lit("viewer").alias("role"))
    found = crosscase.visible_links(crosscase.entity_index(evidence(spark, sf_dir), KEY), crosscase.visible_runs(runs, granted, "u0"))
    return found.select("identifier_hash", F.array_join("runs", ",").alias("runs"), F.col("case_count").cast("long").alias("case_count"))


# Graphs.

EDGES = """, edge AS (SELECT run_id, least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS weight FROM comm WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL)"""


@query("message", "call", "comm", sql=EDGES + " SELECT * FROM edge")
def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(catalog.comm_events(evidence(spark, sf_dir)))


@query("message", "call", "contact", "comm", sql=EDGES + """
, deg AS (SELECT run_id, node, CAST(sum(weight) AS BIGINT) AS degree FROM (SELECT run_id, lo AS node, weight FROM edge UNION ALL SELECT run_id, hi, weight FROM edge) GROUP BY ALL)
SELECT node, coalesce(label, node) AS label, degree FROM deg LEFT JOIN (SELECT run_id, number AS node, max(name) AS label FROM contact GROUP BY ALL) USING (run_id, node) WHERE run_id = '1'
""")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_graph(evidence(spark, sf_dir), "1")[0]


@query("message", "call", "comm", sql=EDGES + """
, both_ways AS (SELECT lo AS x, hi AS y FROM edge WHERE run_id = '1' UNION SELECT hi, lo FROM edge WHERE run_id = '1'), h1 AS (SELECT y AS node, 1 AS hop FROM both_ways WHERE x = '+15560000001'), h2 AS (SELECT DISTINCT b.y, 2 FROM h1 JOIN both_ways b ON b.x = h1.node)
SELECT node, CAST(min(hop) AS INTEGER) AS hops FROM (SELECT '+15560000001' AS node, 0 AS hop UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY node
""")
def neighborhood_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighborhood(evidence(spark, sf_dir), "1", "+15560000001", 2).select("node", "hops")


def display(value: str) -> str:
    return f"sha256({HMAC % value})"


KEYED = f""", part_key AS (SELECT v, run_id, length(regexp_replace(v, '[^0-9]', '', 'g')) >= 7 AS phone FROM (SELECT DISTINCT a AS v, run_id FROM comm UNION SELECT DISTINCT b, run_id FROM comm) WHERE trim(v) <> ''),
pk AS (SELECT v, run_id, CASE WHEN phone THEN {display("regexp_replace(v, '[^0-9]', '', 'g')")} ELSE {display("'other|' || run_id || '|' || trim(v)")} END AS id, CASE WHEN phone THEN regexp_replace(v, '[^0-9]', '', 'g') ELSE trim(v) END AS value, CASE WHEN phone THEN 'phone' ELSE 'other' END AS type FROM part_key),
keyed AS (SELECT c.run_id, c.kind, c.id, c.ts, x.id AS xid, x.value AS xv, x.type AS xt, y.id AS yid, y.value AS yv, y.type AS yt FROM comm c JOIN pk x ON x.v = c.a AND x.run_id = c.run_id JOIN pk y ON y.v = c.b AND y.run_id = c.run_id WHERE x.id <> y.id)"""


@query("message", "call", "comm", sql=KEYED + """
SELECT least(xid, yid) AS source, greatest(xid, yid) AS target, count(*) AS weight, least(count(*), 50) AS n_citations FROM keyed WHERE run_id IN ('0', '1', '2', '3', '4') GROUP BY ALL
""")
def link_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.link_graph(evidence(spark, sf_dir), CASES, KEY, node_limit=None, edge_limit=None, ordered=False)["edges"]
    return found.select("source", "target", "weight", "n_citations")


@query("message", "call", "comm", sql=KEYED + """
, r AS (SELECT least(xid, yid) AS source, greatest(xid, yid) AS target, run_id, kind AS source_table, id AS row_id, row_number() OVER (PARTITION BY least(xid, yid), greatest(xid, yid) ORDER BY run_id, CASE kind WHEN 'message' THEN 0 ELSE 1 END, ts, id) AS k FROM keyed WHERE run_id IN ('0', '1', '2', '3', '4'))
SELECT source, target, run_id, source_table, row_id FROM r WHERE k <= 50
""")
def link_graph_edges_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.link_graph(evidence(spark, sf_dir), CASES, KEY, node_limit=None, edge_limit=None, ordered=False)["edges"]
    return found.select("source", "target", F.explode("citations").alias("c")).select("source", "target", "c.run_id", "c.source_table", "c.row_id")


@query("message", "call", "comm", sql=KEYED + """
, e AS (SELECT xid AS id, xv AS value, xt AS type, run_id FROM keyed WHERE run_id IN ('0', '1', '2', '3', '4') UNION ALL SELECT yid, yv, yt, run_id FROM keyed WHERE run_id IN ('0', '1', '2', '3', '4'))
SELECT id, min(type) AS type, count(DISTINCT run_id) >= 2 AS redacted, count(*) AS degree, count(DISTINCT run_id) AS case_count, CASE WHEN count(DISTINCT run_id) < 2 THEN min(value) END AS value FROM e GROUP BY id
""")
def link_graph_nodes_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.link_graph(evidence(spark, sf_dir), CASES, KEY, node_limit=None, edge_limit=None, ordered=False)["nodes"]
    return found.select("id", "type", "redacted", "degree", F.col("case_count").cast("long").alias("case_count"), "value")


@query("message", "call", "comm", sql=KEYED + f"""
, k2 AS (SELECT * FROM keyed WHERE run_id IN ('0', '1', '2', '3', '4')), nb AS (SELECT xid AS x, yid AS y FROM k2 UNION SELECT yid, xid FROM k2), near AS (SELECT {display("'15550000001'")} AS id UNION SELECT y FROM nb WHERE x = {display("'15550000001'")})
SELECT least(xid, yid) AS source, greatest(xid, yid) AS target, count(*) AS weight FROM k2 WHERE xid IN (SELECT id FROM near) AND yid IN (SELECT id FROM near) GROUP BY ALL
""")
def link_graph_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.link_graph(evidence(spark, sf_dir), CASES, KEY, seed="+1 555 0000001", max_hops=1, node_limit=None, edge_limit=None, ordered=False)["edges"]
    return found.select("source", "target", "weight")


@query("message", "call", "comm", sql=KEYED + """
, o AS (SELECT *, row_number() OVER (ORDER BY run_id, CASE kind WHEN 'message' THEN 0 ELSE 1 END, ts, id) AS i FROM keyed WHERE run_id IN ('0', '1', '2', '3', '4')),
born AS (SELECT node, min(i) AS i FROM (SELECT xid AS node, i FROM o UNION ALL SELECT yid, i FROM o) GROUP BY node), cut AS (SELECT min(i) AS i FROM (SELECT i, count(*) OVER (ORDER BY i RANGE UNBOUNDED PRECEDING) AS c FROM born) WHERE c > 40)
SELECT least(xid, yid) AS source, greatest(xid, yid) AS target, count(*) AS weight FROM o, cut WHERE o.i < cut.i GROUP BY ALL
""")
def link_graph_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.link_graph(evidence(spark, sf_dir), CASES, KEY, node_limit=40, edge_limit=100_000, ordered=False)["edges"]
    return found.select("source", "target", "weight")


@query("message", "call", "contact", "comm", sql="""
SELECT type, count(*) AS n FROM (SELECT CASE kind WHEN 'message' THEN 'SENT' ELSE 'CALLED' END AS type FROM comm UNION ALL SELECT 'TO' FROM comm UNION ALL SELECT 'CONTAINS' FROM message UNION ALL SELECT 'CONTAINS' FROM call UNION ALL SELECT 'CONTAINS' FROM contact) GROUP BY type
""")
def property_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {k: v for k, v in evidence(spark, sf_dir).items() if k in ("message", "call", "contact")}
    return graph.property_graph(tables)[1].groupBy("type").agg(F.count("*").alias("n"))


# Search.


@query("message", sql="""
SELECT id, round(1.0 + CASE WHEN strpos(lower(content), 'blue') > 0 THEN 0.2 ELSE 0 END + CASE WHEN strpos(lower(content), 'red') > 0 THEN 0.2 ELSE 0 END + CASE WHEN strpos(lower(sender || ' ' || receiver || ' ' || content), '+15560000002') > 0 THEN 0.3 ELSE 0 END
  + greatest(0.0, 1 - floor(epoch(TIMESTAMP '2024-06-01' - "timestamp") / 86400) / 365) * 0.1, 6) AS score
FROM message WHERE run_id = '1' AND (strpos(lower(content), 'blue') > 0 OR strpos(lower(content), 'red') > 0)
""")
def keyword_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = evidence(spark, sf_dir)["message"].where("run_id = '1'")
    found = search.ranked(search.search_messages(message, ["blue", "red"]), ["blue", "red"], ["+15560000002"], NOW)
    return found.select("id", F.round("score", 6).alias("score"))


SIMILARITY = """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v) AS similarity FROM embeddings, q)"""


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


@query(sql=SIMILARITY + " SELECT vec_id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.1 ORDER BY similarity DESC, vec_id LIMIT 20")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.semantic_search(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 20, 0.1)
    return found.select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query(sql=SIMILARITY + """
, k AS (SELECT doc_id AS id, (CAST(strpos(lower(text), 'the') > 0 AS INTEGER) + CAST(strpos(lower(text), 'license') > 0 AS INTEGER)) / 2 AS keyword_score FROM documents WHERE strpos(lower(text), 'the') > 0 OR strpos(lower(text), 'license') > 0),
m AS (SELECT vec_id AS id, similarity FROM s WHERE similarity >= 0.1)
SELECT id, round(0.6 * coalesce(similarity, 0) + 0.4 * coalesce(keyword_score, 0), 6) AS score, CASE WHEN keyword_score IS NULL THEN 'semantic' WHEN similarity IS NULL THEN 'keyword' ELSE 'hybrid' END AS method FROM k FULL JOIN m USING (id)
""")
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), search.term_score(F.col("text"), ["the", "license"]).alias("keyword_score")).where("keyword_score > 0")
    similar = search.similarities(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir)).where("similarity >= 0.1")
    return search.hybrid(scored, similar).select("id", F.round("score", 6).alias("score"), "method")


@query("message", "call", "contact", sql="""
SELECT type, id, source FROM (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY source) AS k FROM (SELECT 'message' AS type, id, 1 AS source FROM message WHERE run_id = '1' AND strpos(lower(content), 'blue') > 0 UNION ALL SELECT 'message', id, 2 FROM message WHERE run_id = '1' AND strpos(lower(content), 'red') > 0)) WHERE k = 1
""")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = evidence(spark, sf_dir)["message"].where("run_id = '1'")
    both = search.search_messages(message, ["blue"]).withColumn("source", F.lit(1)).unionByName(search.search_messages(message, ["red"]).withColumn("source", F.lit(2)))
    return search.deduplicated(both).select("type", "id", "source")


#: Folders that files of apps lie in, and others.
FOLDERS = ("data/com.android.chrome", "Browser", "com.whatsapp", "notes", "Chrome_old")


@query(sql=f"WITH f AS (SELECT c_custkey AS id, list_extract([{', '.join(map(repr, FOLDERS))}], CAST(c_custkey % 5 AS INTEGER) + 1) || '/' || c_name AS path FROM customer) SELECT id FROM f WHERE strpos(lower(path), 'chrome') > 0 OR strpos(lower(path), 'browser') > 0 OR strpos(lower(path), 'com.android.chrome') > 0")
def app_alias_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.get(F.array(*map(F.lit, FOLDERS)), F.pmod("c_custkey", F.lit(5)).cast("int")), F.lit("/"), F.col("c_name"))
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("filename"), F.lit("").alias("category"), path.alias("file_path"))
    return files.where(search.app_filter("chrome")).select("id")


@query("message", "call", sql="""
, found AS (
  SELECT 'message' AS source_table, id AS row_id, "timestamp" AS ts FROM message WHERE run_id = '2' AND (strpos(sender, '+15550000012') > 0 OR strpos(receiver, '+15550000012') > 0)
  UNION ALL SELECT 'call', id, "timestamp" FROM call WHERE run_id = '2' AND (strpos(caller, '+15550000012') > 0 OR strpos(receiver, '+15550000012') > 0)
)
SELECT source_table, row_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS event_time FROM found
""")
def plan_of_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(plan_of("Who did +15550000012 write to, and who called?"), evidence(spark, sf_dir), "2").select("source_table", "row_id", "event_time")


@query("message", "call", sql="""
, m AS (SELECT 'message' AS type, id, 1.0 + CASE WHEN strpos(lower(content), 'blue') > 0 THEN 0.2 ELSE 0 END + CASE WHEN strpos(lower(content), 'red') > 0 THEN 0.2 ELSE 0 END AS relevance, "timestamp", sender || ' ' || receiver || ' ' || content AS searched FROM message WHERE run_id = '1' AND (strpos(lower(content), 'blue') > 0 OR strpos(lower(content), 'red') > 0) ORDER BY "timestamp" DESC, id LIMIT 60 OFFSET 5),
c AS (SELECT 'call' AS type, id, 1.0 AS relevance, "timestamp", caller || ' ' || receiver AS searched FROM call WHERE run_id = '1' ORDER BY "timestamp" DESC, id LIMIT 60 OFFSET 5),
s AS (SELECT type, id, relevance + CASE WHEN strpos(searched, '+15560000002') > 0 THEN 0.3 ELSE 0 END + greatest(0.0, 1 - floor(epoch(TIMESTAMP '2024-06-01' - "timestamp") / 86400) / 365) * 0.1 AS score FROM (SELECT * FROM m UNION ALL SELECT * FROM c))
SELECT type, id, 'keyword' AS method, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, type, id LIMIT 60
""")
def search_executed_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = search.Request(("messages", "calls"), "keyword", ("blue", "red"), ("+15560000002",), limit=60, offset=5)
    return search.execute(evidence(spark, sf_dir), "1", request, NOW).select("type", "id", "method", F.round("score", 6).alias("score"))


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as an index of the artifacts of the same number."""
    return table(spark, sf_dir, "embeddings").select(F.lit("0").alias("run_id"), F.lit("artifact").alias("type"), F.col("vec_id").cast("string").alias("id"), F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit(None).cast("string").alias("content"), "embedding")


@query(sql=SIMILARITY + """
, near AS (SELECT CAST(vec_id AS VARCHAR) AS id, similarity FROM s WHERE similarity >= 0.1 ORDER BY similarity DESC, CAST(vec_id AS VARCHAR) LIMIT 40)
SELECT 'artifact' AS type, id, 'semantic' AS method, round(0.6 * similarity, 6) AS combined, round(similarity, 6) AS score FROM near
""")
def search_executed_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = search.Request(("artifacts",), "semantic", vector=tuple(query_vector(spark, sf_dir)), threshold=0.1, limit=40)
    return search.execute(evidence(spark, sf_dir), "0", request, NOW, vector_index(spark, sf_dir)).select("type", "id", "method", F.round("combined", 6).alias("combined"), F.round("score", 6).alias("score"))


@query(sql=SIMILARITY + """
, near AS (SELECT CAST(vec_id AS VARCHAR) AS id, similarity FROM s WHERE similarity >= 0.1 ORDER BY similarity DESC, CAST(vec_id AS VARCHAR) LIMIT 500),
k AS (SELECT CAST(doc_id AS VARCHAR) AS id, 1.5 + CASE WHEN strpos(lower(source), 'web') > 0 THEN 0.3 ELSE 0 END AS relevance FROM documents WHERE strpos(lower(text), 'the') > 0 OR strpos(lower(source), 'the') > 0 OR strpos(lower(lang), 'the') > 0 ORDER BY id LIMIT 500),
b AS (SELECT id, CASE WHEN relevance IS NULL THEN 'semantic' WHEN similarity IS NULL THEN 'keyword' ELSE 'hybrid' END AS method, 0.6 * coalesce(similarity, 0) + CASE WHEN relevance IS NULL THEN 0 ELSE 0.4 * 1.5 END AS combined, coalesce(relevance, similarity) AS score FROM k FULL JOIN near USING (id))
SELECT 'artifact' AS type, id, method, round(combined, 6) AS combined, round(score, 6) AS score FROM b ORDER BY b.score DESC, b.id LIMIT 500
""")
def search_executed_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = search.Request(("artifacts",), "hybrid", ("the",), ("web",), vector=tuple(query_vector(spark, sf_dir)), threshold=0.1, limit=500)
    return search.execute(evidence(spark, sf_dir), "0", request, NOW, vector_index(spark, sf_dir)).select("type", "id", "method", F.round("combined", 6).alias("combined"), F.round("score", 6).alias("score"))


@query("call", sql="""SELECT id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS called FROM call WHERE run_id = '2' AND (strpos(caller, '0000012') > 0 OR strpos(receiver, '0000012') > 0) ORDER BY "timestamp" DESC, id LIMIT 40 OFFSET 3""")
def call_search_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_calls(evidence(spark, sf_dir)["call"].where("run_id = '2'"), ["0000012"])
    return search.page(found, 40, 3, F.desc("timestamp"), F.asc("id")).select("id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("called"))


# Classification, patterns and files.

EXTENSIONS = ("jpg", "MP4", "ogg", "pdf", "html", "PNG", "docx", "xyz")
PATHS = f"SELECT page_id, regexp_replace(url, '^https?://', '') || '.' || list_extract([{', '.join(repr(e) for e in EXTENSIONS)}], CAST(page_id % 8 AS INTEGER) + 1) AS path FROM pages"


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, EXTENSIONS))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "^https?://", ""), F.lit("."), F.get(kinds, F.pmod("page_id", F.lit(8)).cast("int"))).alias("path"))


@query(sql=f"WITH f AS (SELECT page_id, lower(regexp_extract(path, '[^/.][.]([^./]+)$', 1)) AS e FROM ({PATHS})) SELECT page_id, CASE WHEN e IN ('jpg', 'jpeg', 'png', 'gif', 'bmp', 'tiff') THEN 'image' WHEN e IN ('mp4', 'avi', 'mov', 'wmv', 'flv') THEN 'video' WHEN e IN ('mp3', 'wav', 'aac', 'm4a', 'ogg') THEN 'audio' WHEN e IN ('pdf', 'doc', 'docx', 'txt', 'rtf') THEN 'document' ELSE 'unknown' END AS media_type FROM f")
def media_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_files(spark, sf_dir).select("page_id", scalars.media_type(F.col("path")).alias("media_type"))


@query(sql=f"WITH f AS ({PATHS}) SELECT lower(regexp_extract(path, '[^/.]([.][^./]+)$', 1)) AS extension, count(*) AS n_files, CAST(sum(length(path)) AS BIGINT) AS n_bytes FROM f GROUP BY 1")
def file_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.file_histogram(named_files(spark, sf_dir).withColumn("length", F.length("path")))


@query(sql=f"WITH f AS ({PATHS}) SELECT page_id, CASE WHEN lower(path) LIKE '%.html' THEN 'html_reports' WHEN lower(path) LIKE '%.tsv' THEN 'tsv_exports' WHEN lower(path) LIKE '%.db' THEN 'databases' WHEN lower(path) LIKE 'data%' THEN 'data_extraction' ELSE 'other' END AS category FROM f")
def report_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_files(spark, sf_dir).select("page_id", scalars.report_category(F.col("path")).alias("category"))


@query(sql="SELECT doc_id, CASE WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN format('{:.1f} B', n) WHEN n < 1048576 THEN format('{:.1f} KB', n / 1024) ELSE format('{:.1f} MB', n / 1048576) END AS size FROM (SELECT doc_id, CAST(strlen(text) * 7 + 13 AS DOUBLE) AS n FROM documents)")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.human_size(F.octet_length("text") * 7 + 13).alias("size"))


@query(sql=r"SELECT doc_id, CAST(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')) AS VARCHAR) AS email FROM documents")
def pattern_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.occurrences(table(spark, sf_dir, "documents"), "email", "doc_id").select(F.col("id").alias("doc_id"), F.col("value").alias("email"))


@query(sql=r"SELECT doc_id, CAST(unnest(regexp_extract_all(text, '[13][a-km-zA-HJ-NP-Z1-9]{25,34}')) AS VARCHAR) AS address FROM documents")
def pattern_crypto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.occurrences(table(spark, sf_dir, "documents"), "bitcoin", "doc_id").select(F.col("id").alias("doc_id"), F.col("value").alias("address"))


@query(sql="""
WITH w AS (SELECT doc_id, k AS keyword, CAST(strpos(lower(text), k) AS BIGINT) AS place, text FROM documents, (SELECT unnest(['stupid', 'license', 'copyright']) AS k))
SELECT doc_id, keyword, place - 1 AS place, substr(text, greatest(place - 50, 1), place - greatest(place - 50, 1) + length(keyword) + 50) AS context FROM w WHERE place > 0
""")
def keyword_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.keyword_contexts(table(spark, sf_dir, "documents"), "doc_id", keywords=("stupid", "license", "copyright"))
    return found.select(F.col("id").alias("doc_id"), "keyword", F.col("at").cast("long").alias("place"), "context")


@query(sql=r"SELECT DISTINCT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\x20-\x7E]{40,}')) AS value FROM documents)")
def string_carving(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.carving import printable_strings

    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return printable_strings(files, 40).select(F.col("path").alias("doc_id"), "value")


# Custody and maintenance.


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chained log of events: each entry covers the hash of the payload before it."""
    events = table(spark, sf_dir, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("seq"), F.col("user_id").cast("string").alias("run_id"), "event_type", "props")
    h = F.sha2(F.concat_ws("|", "run_id", "seq", "event_type"), 256)
    return events.withColumn("entry_hash", h).withColumn("prev_hash", F.when(F.col("event_id") % 997 == 0, "broken").otherwise(F.lag("entry_hash", 1, custody.GENESIS).over(Window.partitionBy("run_id").orderBy("seq"))))


@query(sql=f"""
WITH e AS (SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS seq, CAST(user_id AS VARCHAR) AS run_id, event_type FROM events), h AS (SELECT *, sha256(concat_ws('|', run_id, seq, event_type)) AS entry_hash FROM e),
p AS (SELECT *, lag(entry_hash, 1, '{custody.GENESIS}') OVER (PARTITION BY run_id ORDER BY seq) AS expected FROM h)
SELECT run_id, count(*) AS n_entries, min(seq) FILTER (event_id % 997 = 0) AS broken_at_seq, count(*) FILTER (event_id % 997 = 0) = 0 AS ok FROM p GROUP BY run_id
""")
def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of every case; the payloads' hashes stand for the entries' own, since SQL can't make one entry from another in turn."""
    log = audit_log(spark, sf_dir)
    found = custody.verify_chain(log, ["run_id"], F.sha2(F.concat_ws("|", "run_id", "seq", "event_type"), 256))
    return found.select("run_id", F.col("length").alias("n_entries"), "broken_at_seq", "ok")


@query(sql="""SELECT event_id, sha256('{"event_type":"' || event_type || '","payload":' || coalesce('"' || replace(props, '"', '\\"') || '"', 'null') || ',"prev_hash":"x","run_id":null,"seq":' || event_id || ',"timestamp":"t","user_id":"' || user_id || '"}') AS entry_hash FROM events""")
def audit_entry_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("props").alias("payload"), F.lit("x").alias("prev_hash"), F.lit(None).cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.lit("t").alias("timestamp"), F.col("user_id").cast("string").alias("user_id"))
    return rows.select("event_id", custody.entry_hash().alias("entry_hash"))


@query(sql="SELECT o_orderstatus AS result_type, count(*) AS n FROM orders GROUP BY 1")
def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.counts_by_type(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("result_type")))


@query(sql="SELECT CAST(c_custkey AS VARCHAR) AS run_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def empty_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        "run": table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("run_id")),
        "message": table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").cast("string").alias("run_id")),
        "call": table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("run_id")),
    }
    return maintenance.empty_runs(tables)


@query(sql="SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS role FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return maintenance.upserted(customer.where("id % 2 = 0").withColumn("role", F.lit("old")), customer.where("id % 3 = 0").withColumn("role", F.lit("new")), ["id"])


@query(sql="SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= CASE lang WHEN 'en' THEN 7 WHEN 'de' THEN 3 ELSE 0 END")
def category_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.sampled(table(spark, sf_dir, "documents").select("doc_id", "lang"), {"en": 7, "de": 3}, "lang", "doc_id")


# Artifacts, over tables in the shape of the apps' own.


def artifact(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    return run_artifact(spark, artifacts()[name], tables)


@query(sql="""
SELECT strftime(to_timestamp(epoch(ts)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS timestamp, CAST(event_id AS VARCHAR) AS number, CAST(floor(value) AS BIGINT) AS seconds,
  CASE event_id % 8 WHEN 1 THEN 'Incoming' WHEN 2 THEN 'Outgoing' WHEN 3 THEN 'Missed' WHEN 4 THEN 'Voicemail' WHEN 5 THEN 'Rejected' WHEN 6 THEN 'Blocked' WHEN 7 THEN 'Answered elsewhere' ELSE 'Unknown' END AS direction,
  format('{:02d}:{:02d}:{:02d}', CAST(floor(value) AS BIGINT) // 3600, CAST(floor(value) AS BIGINT) % 3600 // 60, CAST(floor(value) AS BIGINT) % 60) AS duration FROM events
""")
def artifact_case_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("number"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("date"), F.floor("value").cast("string").alias("duration"), (F.col("event_id") % 8).cast("string").alias("type"))
    return artifact(spark, "call_log", calls=calls).select("timestamp", "number", "seconds", "direction", "duration")


@query(sql="SELECT event_id, format('${:.2f}', CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100) AS amount, s.c_name AS sender, r.c_name AS recipient FROM events LEFT JOIN customer s ON s.c_custkey = user_id LEFT JOIN customer r ON r.c_custkey = event_id % 100")
def artifact_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    payment = events.select(F.col("user_id").cast("string").alias("sender_id"), (F.col("event_id") % 100).cast("string").alias("recipient_id"), F.to_json(F.struct(F.struct(F.get_json_object("props", "$.k").alias("amount")).alias("amount"))).alias("render_data"), F.col("event_id").cast("string").alias("state"), F.lit("0").alias("display_date"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("customer_display_name"))
    return artifact(spark, "payments", payment=payment, customer=customer).select(F.col("state").cast("long").alias("event_id"), "amount", "sender", "recipient")


@query(sql="SELECT n_name AS name, string_agg('+1555' || c_custkey, ', ' ORDER BY c_custkey) FILTER (c_custkey % 2 = 0) AS numbers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def artifact_group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("_id"), F.col("n_name").alias("display_name"), F.lit("1").alias("times_contacted"))
    data = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rowid"), F.col("c_nationkey").cast("string").alias("raw_contact_id"), (F.col("c_custkey") % 2).cast("string").alias("mimetype_id"), F.concat(F.lit("+1555"), "c_custkey").alias("data1"))
    kinds = spark.createDataFrame([("0", "vnd.android.cursor.item/phone_v2"), ("1", "vnd.android.cursor.item/email_v2")], "_id string, mimetype string")
    return artifact(spark, "contacts", raw_contacts=raw, data=data, mimetypes=kinds).select("name", "numbers")


@query(sql="""
SELECT o_orderkey AS message_id, (SELECT l_suppkey FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber % 2 = 1 ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate LIMIT 1) AS sender, (SELECT l_suppkey FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber % 2 = 0 ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate LIMIT 1) AS receiver FROM orders
""")
def artifact_correlated_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    addr = table(spark, sf_dir, "lineitem").select(order.cast("long").alias("rowid"), F.col("l_orderkey").cast("string").alias("msg_id"), F.col("l_suppkey").cast("string").alias("address"), F.when(F.col("l_linenumber") % 2 == 1, "137").otherwise("151").alias("type"))
    pdu = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("_id"))
    return artifact(spark, "mms", pdu=pdu, addr=addr).select(F.col("message_id").cast("long").alias("message_id"), F.col("sender").cast("long").alias("sender"), F.col("receiver").cast("long").alias("receiver"))


@query(sql="SELECT coalesce(c_custkey, user_id) AS activity_id, c_name AS name, round(c_acctbal / 1000, 2) + 0.0 AS kilometres, calories FROM customer FULL JOIN (SELECT user_id, CAST(count(*) AS DOUBLE) AS calories FROM events GROUP BY user_id) ON c_custkey = user_id")
def artifact_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("activity_id"), F.col("c_name").alias("activity_name"), F.col("c_acctbal").cast("string").alias("distance"))
    details = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("string").alias("calories")).withColumn("activity_id", F.col("user_id").cast("string"))
    return artifact(spark, "activities", activity_summaries=summaries, activity_details=details).select(F.col("activity_id").cast("long").alias("activity_id"), "name", (F.col("kilometres") + 0.0).alias("kilometres"), "calories")


@query(sql="""
SELECT c_name AS title, r_name || '/' || n_name AS folder FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def artifact_recursive_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    entities = region.select(F.concat(F.lit("r"), "r_regionkey").alias("entityId"), F.lit("FOLDER").alias("type"), F.col("r_name").alias("title"))
    entities = entities.unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("entityId"), F.lit("FOLDER").alias("type"), F.col("n_name").alias("title")))
    entities = entities.unionByName(customer.select(F.concat(F.lit("c"), "c_custkey").alias("entityId"), F.lit("BOOKMARK").alias("type"), F.col("c_name").alias("title")))
    relations = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("folderId"), F.concat(F.lit("n"), "n_nationkey").alias("entityId")).unionByName(customer.select(F.concat(F.lit("n"), "c_nationkey").alias("folderId"), F.concat(F.lit("c"), "c_custkey").alias("entityId")))
    return artifact(spark, "bookmark_folders", entities=entities, relations=relations).select("title", "folder")


@query(sql="""
WITH p AS (SELECT s_suppkey AS id, s_nationkey AS conv, s_name AS name FROM supplier)
SELECT a.name AS sender, string_agg(b.name, ', ' ORDER BY b.name) AS recipients FROM p a LEFT JOIN p b ON a.conv = b.conv AND a.id <> b.id GROUP BY a.id, a.name
""")
def artifact_theta_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    messages = supplier.select(key.alias("_id"), F.col("s_nationkey").cast("string").alias("conversation_id"), key.alias("participant_id"), F.lit("0").alias("msg_date"))
    participants = supplier.select(key.alias("_id"), F.col("s_nationkey").cast("string").alias("conversation_id"), key.alias("participant_info_id"))
    info = supplier.select(key.alias("_id"), F.col("s_name").alias("contact_name"), F.col("s_name").alias("number"))
    return artifact(spark, "conversation_messages", messages=messages, participants=participants, participants_info=info).select("sender", "recipients")


@query(sql="""
SELECT v.event_id, CASE v.event_id & 255 WHEN 0 THEN 'Link' WHEN 1 THEN 'Typed' WHEN 2 THEN 'Bookmark' WHEN 3 THEN 'Subframe' WHEN 4 THEN 'Manual subframe' WHEN 5 THEN 'Generated' WHEN 6 THEN 'Top level' WHEN 7 THEN 'Form' WHEN 8 THEN 'Reload' WHEN 9 THEN 'Keyword' WHEN 10 THEN 'Keyword generated' ELSE 'Other' END AS transition,
  concat_ws(', ', CASE WHEN v.t & 8388608 <> 0 THEN 'Blocked' END, CASE WHEN v.t & 16777216 <> 0 THEN 'Forward or back' END, CASE WHEN v.t & 268435456 <> 0 THEN 'Chain start' END) AS qualifiers FROM (SELECT event_id, user_id, event_id + 8388608 * (event_id % 2) + 16777216 * (event_id % 3 % 2) + 268435456 * (event_id % 5 % 2) AS t FROM events) v JOIN customer ON c_custkey = user_id
""")
def artifact_bitmask_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id").cast("long")
    bits = e + 8388608 * (e % 2) + 16777216 * (e % 3 % 2) + 268435456 * (e % 5 % 2)
    visits = table(spark, sf_dir, "events").select(e.cast("string").alias("id"), F.col("user_id").cast("string").alias("url"), F.concat(e.cast("string"), F.lit("000000")).alias("visit_duration"), F.lit("0").alias("from_visit"), bits.cast("string").alias("transition"), F.lit("13350000000000000").alias("visit_time"))
    urls = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("url"))
    return artifact(spark, "browser_visits", visits=visits, urls=urls).select(F.col("seconds").alias("event_id"), "transition", "qualifiers")


@query(sql="""SELECT c_name AS key, 'customers' AS activity, '{"c_name":"' || c_name || '","c_custkey":"' || c_custkey || '","c_mktsegment":"' || c_mktsegment || '"}' AS datalist FROM customer""")
def timeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.timeline_rows(table(spark, sf_dir, "customer").select("c_name", "c_custkey", "c_mktsegment"), "customers")


@query(sql="SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, round(value - 50, 4) AS latitude, CAST(event_id % 90 AS DOUBLE) AS longitude, 'events' AS activity FROM events WHERE value - 50 <> 0 AND event_id % 90 <> 0")
def place_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), (F.col("value") - 50).alias("Latitude"), (F.col("event_id") % 90).alias("Longitude"))
    return outputs.place_rows(rows, "events").withColumn("latitude", F.round("latitude", 4))


@query(sql="""
SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS added_local, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS time, CAST(event_id AS VARCHAR) AS path FROM events WHERE event_type IN ('click', 'purchase')
""")
def artifact_like_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local times of a zone without summer time."""
    kind = F.when(F.col("event_type").isin("click", "purchase"), "IMAGE/jpeg").otherwise("video/mp4")
    files = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("_data"), kind.alias("mime_type"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("date_added"))
    return run_artifact(spark, artifacts()["media_images"], {"files": files}, tz="Asia/Kolkata").select("added_local", "day", "time", "path")


@query(sql="SELECT l_orderkey AS id, string_agg(l_suppkey || ';', '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS body FROM lineitem GROUP BY l_orderkey")
def artifact_chunks_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey")).withColumn("body", F.concat("l_suppkey", F.lit(";")))
    return joined_chunks(pieces, ["id"], F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"), "body")


# Indexes, counts and checks of samples.


@query("message", sql="""
SELECT run_id, id, CAST(length(t) AS DOUBLE) AS length, CAST(length(t) - length(replace(t, 'e', '')) AS DOUBLE) AS n_e FROM (SELECT run_id, id, 'From ' || sender || ' to ' || receiver || ': ' || content AS t FROM message)
""")
def vector_index_of_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An encoder that SQL can follow stands for a model: the length of a text and how many times it has the letter e."""
    found = index.vector_index(index.message_texts(evidence(spark, sf_dir)["message"]), lambda texts: [(len(t), t.count("e")) for t in texts])
    return found.select("run_id", "id", F.col("embedding")[0].cast("double").alias("length"), F.col("embedding")[1].cast("double").alias("n_e"))


@query(sql="SELECT CAST(doc_id AS VARCHAR) AS id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL")
def token_index_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.lit("0").alias("run_id"), F.lit("artifact").alias("type"), F.col("doc_id").cast("string").alias("id"), "text")
    return index.token_index(texts).select("id", "token", "n")


@query("message", "call", "contact", "comm", sql="""
SELECT 'Person' AS type, count(*) AS n FROM (SELECT run_id, a FROM comm UNION SELECT run_id, b FROM comm) UNION ALL SELECT 'Message', count(*) FROM message UNION ALL SELECT 'Call', count(*) FROM call UNION ALL SELECT 'Contact', count(*) FROM contact
""")
def node_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {k: v for k, v in evidence(spark, sf_dir).items() if k in ("message", "call", "contact")}
    return graph.type_counts(graph.property_graph(tables)[0])


@query("call", sql="""
SELECT 'CALLED' AS type, caller AS source, id AS target FROM call UNION ALL SELECT 'TO', id, receiver FROM call
""")
def graph_of_node_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without what cases contain: here the numbers of calls are also those of cases."""
    tables = {k: v for k, v in evidence(spark, sf_dir).items() if k in ("message", "call")}
    nodes, edges = graph.property_graph(tables)
    return graph.of_types(nodes, edges.where("type <> 'CONTAINS'"), ["Call"])[1]


@query("ue", "series", sql="""
, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY total DESC, d) AS k FROM series) SELECT run_id, strftime(d, '%Y-%m-%d') AS d, CAST(total AS BIGINT) AS total FROM r WHERE k = 1
""")
def peak_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.peak_days(temporal.daily_series(catalog.user_events(spark, sf_dir))).select("run_id", F.date_format("d", "yyyy-MM-dd").alias("d"), "total")


@query("message", "call", "comm", sql=EDGES + """
, deg AS (SELECT run_id, node, CAST(sum(weight) AS BIGINT) AS degree FROM (SELECT run_id, lo AS node, weight FROM edge UNION ALL SELECT run_id, hi, weight FROM edge) GROUP BY ALL)
SELECT run_id, node, degree, round(degree * 100 / max(degree) OVER (PARTITION BY run_id), 4) AS share FROM deg
""")
def normalized_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.normalized_degrees(graph.degrees(graph.edges(catalog.comm_events(evidence(spark, sf_dir)))))
    return found.withColumn("share", F.round("share", 4))


@query(sql="SELECT CAST(o_custkey AS VARCHAR) AS run_id, count(*) AS total FROM orders GROUP BY 1")
def history_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.history_total(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("run_id")))


@query(sql="""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderstatus END AS status, 'extra' AS difference FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, 'missing' FROM orders WHERE o_orderkey % 7 = 0
""")
def sample_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return maintenance.differences(expected.withColumn("status", F.when(F.col("id") % 7 == 0, "changed").otherwise(F.col("status"))), expected)


@query(sql="""
SELECT c_custkey AS id, unnest(['a', 'b', 'c', 'd', 'e']) AS key, unnest([CAST(c_custkey AS VARCHAR), c_name, c_mktsegment, repeat('x', 100), CAST(c_nationkey AS VARCHAR)]) AS value FROM customer
""")
def artifact_field_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.to_json(F.struct(F.col("c_custkey").alias("a"), F.col("c_name").alias("b"), F.col("c_mktsegment").alias("c"), F.repeat(F.lit("x"), 150).alias("d"), F.col("c_nationkey").alias("e"), F.lit("left out").alias("f")))
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(search.summarized_fields(data)).alias("x"))
    return found.select("id", "x.key", "x.value")

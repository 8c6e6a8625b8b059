"""Queries over stores, files and graphs: files are made from the benchmark tables by Spark, read back by the engine and held against SQL."""

from __future__ import annotations

import io
import itertools
import sqlite3
import tarfile
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog
from .functions import numbers, scalars
from .operators import custody, graph, index, maintenance, network, search
from .queries import CASES, EDGES, HMAC, KEY, KEYED, NOW, PATHS, artifact, evidence, named_files, query, query_vector, table
from .shared import new_path
from .sinks import outputs
from .sources import archives, sqlite
from .sources.files import created
from .store import CaseStore, ContentStore


def files_from(rows: DataFrame, folder: str, suffix: str, made: Callable[[BinaryIO, Iterator[dict]], None]) -> str:
    """A file ``folder/{file}{suffix}`` for each value of ``file`` in ``rows``, made by a task from its rows in order of ``place``.

    Rows come sorted by Spark and pass through the task in batches, so that a file may be larger than a task's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for batch in batches for k in range(0, batch.num_rows, 500) for r in batch.slice(k, 500).to_pylist())
        for name, own in itertools.groupby(each, lambda r: r["file"]):
            with created(f"{folder}/{name}{suffix}") as f:
                made(f, own)
            yield pa.RecordBatch.from_arrays([pa.array([str(name)])], ["file"])

    rows.repartition("file").sortWithinPartitions("file", "place").mapInArrow(run, "file string").count()
    return folder


# Stores.


@query(sql="""
SELECT 'message' AS kind, '+1555' || o_custkey AS a, 'shop' AS b, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, o_orderpriority AS said FROM orders
UNION ALL SELECT 'call', '+1555' || user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S'), CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) FROM events
UNION ALL SELECT 'contact', '+1555' || c_custkey, c_name, NULL, NULL FROM customer
""")
def ingested_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of all orders, events and customers, ingested as one case (twice: the second changes nothing) and loaded from the store."""
    root = new_path(spark, "store")

    def element(tag: str, /, **parts: Column) -> Column:
        return F.concat(F.lit(f"<{tag}>"), *(F.concat(F.lit(f"<{k}>"), v, F.lit(f"</{k}>")) for k, v in parts.items()), F.lit(f"</{tag}>"))

    stamp, own = "yyyy-MM-dd'T'HH:mm:ss", lambda c: F.concat(F.lit("+1555"), c)
    lines = table(spark, sf_dir, "orders").select(element("message", **{"from": own("o_custkey"), "to": F.lit("shop"), "timestamp": F.date_format("o_orderdate", stamp), "content": F.col("o_orderpriority")}).alias("line"))
    lines = lines.unionByName(table(spark, sf_dir, "events").select(element("call", caller=own("user_id"), receiver=F.col("event_type"), timestamp=F.date_format("ts", stamp), duration=F.floor("value").cast("string")).alias("line")))
    lines = lines.unionByName(table(spark, sf_dir, "customer").select(element("contact", name=F.col("c_name"), number=own("c_custkey")).alias("line")))
    by_file = lines.select(F.pmod(F.xxhash64("line"), F.lit(16)).alias("file"), F.col("line").alias("place"))

    def made(f: BinaryIO, rows: Iterator[dict]) -> None:
        f.write(b"<report>\n")
        f.writelines(f"{r['place']}\n".encode() for r in rows)
        f.write(b"</report>\n")

    files_from(by_file, f"{root}/report.xml", ".xml", made)
    store = CaseStore(spark, f"{root}/cases")
    if not store.ingest(f"{root}/report.xml", "case 007", "u1", NOW) or store.ingest(f"{root}/report.xml", "case 007", "u1", NOW):
        raise AssertionError("the first ingest adds the case and the second changes nothing")
    found, none = store.load("case 007"), F.lit(None).cast("string")
    at = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at")
    return (
        found["message"].select(F.lit("message").alias("kind"), F.col("sender").alias("a"), F.col("receiver").alias("b"), at, F.col("content").alias("said"))
        .unionByName(found["call"].select(F.lit("call").alias("kind"), F.col("caller").alias("a"), F.col("receiver").alias("b"), at, F.col("duration").cast("string").alias("said")))
        .unionByName(found["contact"].select(F.lit("contact").alias("kind"), F.col("number").alias("a"), F.col("name").alias("b"), none.alias("at"), none.alias("said")))
    )


@query(sql="""
SELECT 'contact' AS kind, c_name AS a, '+1555' || c_custkey AS b FROM customer
UNION ALL SELECT 'media', '/sdcard/' || c_custkey || '.jpg', 'image' FROM customer
""")
def ingested_ufdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction archives, one a nation, with a report of its customers and a mapped file for each, ingested as one case."""
    root = new_path(spark, "store")

    def made(f: BinaryIO, rows: Iterator[dict]) -> None:
        with tempfile.NamedTemporaryFile() as report, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            report.write(b"<report>\n")
            for r in rows:
                report.write(f'<contact><name>{r["name"]}</name><number>{r["number"]}</number></contact>\n<file path="/sdcard/{r["place"]}.jpg">\n<item name="Local Path"><![CDATA[files\\{r["place"]}.jpg]]></item>\n</file>\n'.encode())
                z.writestr(f"files/{r['place']}.jpg", r["name"])
            report.write(b"</report>\n")
            report.flush()
            z.write(report.name, "report.xml")

    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("place"), F.col("c_name").alias("name"), F.concat(F.lit("+1555"), "c_custkey").alias("number"))
    files_from(rows, f"{root}/files", ".ufdr", made)
    store = CaseStore(spark, f"{root}/cases")
    store.ingest(f"{root}/files/*.ufdr", "1e3", "u1", NOW)
    found = store.load("1e3")
    return found["contact"].select(F.lit("contact").alias("kind"), F.col("name").alias("a"), F.col("number").alias("b")).unionByName(found["media"].select(F.lit("media").alias("kind"), F.col("original_path").alias("a"), F.col("media_type").alias("b")))


@query(sql="""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(doc_id % 2 AS VARCHAR) AS run_id FROM documents), c AS (SELECT text, count(*) AS n FROM d GROUP BY text)
SELECT run_id, CAST(doc_id AS VARCHAR) AS path, sha256(d.text) AS digest, CAST(strlen(d.text) AS BIGINT) AS size, n AS n_references FROM d JOIN c USING (text)
""")
def contents_kept_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files of two cases, one of them added twice: contents once, every reference with the number of all to its content."""
    store = ContentStore(spark, new_path(spark, "contents"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), (F.col("doc_id") % 2).cast("string").alias("case"))
    for case in ("0", "1", "0"):
        store.put(files.where(F.col("case") == case).drop("case"), case)
    return store.media().select("run_id", F.col("original_path").alias("path"), "digest", "size", "n_references")


@query(sql="SELECT count(*) AS objects, count(*) - count(*) FILTER (even) AS unreferenced FROM (SELECT coalesce(text, '') AS text, bool_or(doc_id % 2 = 0) AS even FROM documents GROUP BY 1)")
def contents_released(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left over once the case of the odd documents is gone."""
    store = ContentStore(spark, new_path(spark, "contents"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), (F.col("doc_id") % 2).cast("string").alias("case"))
    for case in ("0", "1"):
        store.put(files.where(F.col("case") == case).drop("case"), case)
    store.release("1")
    return store.objects().agg(F.count("*").alias("objects")).join(store.unreferenced().agg(F.count("*").alias("unreferenced")))


# Files.

MEMBERS = "SELECT 'docs/' || lang || '/' || doc_id || '.txt' AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, sha256(coalesce(text, '')) AS digest FROM documents"


def documents_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select((F.col("doc_id") % 7).alias("file"), F.col("doc_id").alias("place"), F.concat(F.lit("docs/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def members(spark: SparkSession, folder: str, **options) -> DataFrame:
    found = archives.read_archive(spark, folder, "*/docs/*", **options)
    return found.where("error is null").select("path", "size", F.sha2("content", 256).alias("digest"))


@query(sql=MEMBERS)
def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    def made(f: BinaryIO, rows: Iterator[dict]) -> None:
        with zipfile.ZipFile(f, "w") as z:
            for i, r in enumerate(rows):
                z.writestr(r["name"], r["content"], (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2)[i % 3])

    return members(spark, files_from(documents_by_file(spark, sf_dir), new_path(spark, "zips"), ".zip", made))


@query(sql=MEMBERS)
def tar_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of 64 kB: members and their headers lie across many tasks."""

    def made(f: BinaryIO, rows: Iterator[dict]) -> None:
        with tarfile.open(fileobj=f, mode="w|") as t:
            for r in rows:
                info = tarfile.TarInfo(r["name"])
                info.size = len(r["content"])
                t.addfile(info, io.BytesIO(r["content"]))
                t.members.clear()  # the library keeps all headers else

    return members(spark, files_from(documents_by_file(spark, sf_dir), new_path(spark, "tars"), ".tar", made), range_bytes=1 << 16)


@query(sql="SELECT c_custkey AS id, c_name AS name, c_nationkey || '.db' AS file FROM customer")
def sqlite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQLite file for each nation, read by ranges of rowids."""

    def made(f: BinaryIO, rows: Iterator[dict]) -> None:
        with tempfile.NamedTemporaryFile() as own:
            db = sqlite3.connect(own.name)
            db.execute("CREATE TABLE people (id INTEGER PRIMARY KEY, name TEXT)")
            db.executemany("INSERT INTO people VALUES (?, ?)", ((r["place"], r["name"]) for r in rows))
            db.commit()
            db.close()
            with open(own.name, "rb") as made_:
                while piece := made_.read(1 << 22):
                    f.write(piece)

    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("place"), F.col("c_name").alias("name"))
    found = sqlite.read_sqlite(spark, files_from(rows, new_path(spark, "databases"), ".db", made), "people", rowsPerPartition="500")
    return found.select(F.col("id").cast("long").alias("id"), "name", F.regexp_extract("source_path", "([^/]*)$", 1).alias("file"))


@query(sql="SELECT CAST(user_id AS VARCHAR) AS source, CAST(event_id AS VARCHAR) AS original_path, 'f/' || event_id AS local_path FROM events")
def path_of_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of several blocks: a line with the file's path, lines that say nothing, and the local path as of it."""
    numbers_ = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source"), (numbers_ * 3).alias("n"), F.col("event_id").cast("string").alias("e"))
    lines = rows.select("source", F.explode(F.array(F.struct(F.col("n").alias("line_no"), F.concat(F.lit('<file path="'), "e", F.lit('">')).alias("line")), F.struct((F.col("n") + 1).alias("line_no"), F.lit("<x/>").alias("line")), F.struct((F.col("n") + 2).alias("line_no"), F.concat(F.lit('<item name="Local Path">f/'), "e", F.lit("</item>")).alias("line")))).alias("x"))
    return archives.path_mapping(lines.select("source", "x.line_no", "x.line"), lines=4)


# Graphs.


@query("message", "call", sql="""
, comm AS (SELECT run_id, 'message' AS kind, id, CASE WHEN id LIKE '%7' THEN NULL ELSE "timestamp" END AS ts, sender AS a, receiver AS b FROM message UNION ALL SELECT run_id, 'call', id, "timestamp", caller, receiver FROM call)
""" + KEYED + """
, o AS (SELECT *, row_number() OVER (ORDER BY run_id, CASE kind WHEN 'message' THEN 0 ELSE 1 END, ts, id) AS i FROM comm WHERE ts IS NOT NULL), ok AS (SELECT i, xid, yid FROM keyed k JOIN o ON o.run_id = k.run_id AND o.kind = k.kind AND o.id = k.id WHERE k.ts IS NOT NULL),
born AS (SELECT node, min(i) AS i FROM (SELECT xid AS node, i FROM ok UNION ALL SELECT yid, i FROM ok) GROUP BY node), cut AS (SELECT min(i) AS i FROM (SELECT i, count(*) OVER (ORDER BY i RANGE UNBOUNDED PRECEDING) AS c FROM born) WHERE c > 300)
SELECT (SELECT count(*) FROM o WHERE i <= coalesce((SELECT i FROM cut), i)) AS events_scanned, CAST(100000000 AS BIGINT) AS event_ceiling, (SELECT i FROM cut) IS NOT NULL AS truncated, CASE WHEN (SELECT i FROM cut) IS NOT NULL THEN 'node_limit 300 reached' END AS reason,
  (SELECT count(*) FROM comm WHERE ts IS NULL) AS excluded
""")
def link_graph_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = evidence(spark, sf_dir)
    tables["message"] = tables["message"].withColumn("timestamp", F.when(~F.col("id").endswith("7"), F.col("timestamp")))
    return graph.link_graph(tables, CASES, KEY, node_limit=300, edge_limit=10_000_000, event_ceiling=100_000_000)["verdict"]


@query("message", "call", "contact", "comm", sql=KEYED + """
, e AS (SELECT xid AS id, xv AS value, run_id FROM keyed UNION ALL SELECT yid, yv, run_id FROM keyed), n AS (SELECT id, min(value) AS value FROM e GROUP BY id HAVING count(DISTINCT run_id) < 2)
SELECT value, coalesce(max(c.name), value) AS label FROM n LEFT JOIN contact c ON regexp_replace(c.number, '[^0-9]', '', 'g') = value GROUP BY n.id, value
""")
def link_graph_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of what only one case has."""
    found = graph.link_graph(evidence(spark, sf_dir), CASES, KEY, node_limit=None, edge_limit=None, ordered=False)["nodes"]
    return found.where("not redacted").select("value", "label")


@query("message", "call", "comm", sql=EDGES + """
, w AS (SELECT lo AS x, hi AS y FROM edge WHERE run_id = '1' UNION SELECT hi, lo FROM edge WHERE run_id = '1'), ends AS (SELECT min(lo) AS s FROM edge WHERE run_id = '1'),
h0 AS (SELECT s AS node, [s] AS way FROM ends), h1 AS (SELECT y AS node, min(list_append(way, y)) AS way FROM h0 JOIN w ON x = node WHERE y NOT IN (SELECT node FROM h0) GROUP BY y),
h2 AS (SELECT y AS node, min(list_append(way, y)) AS way FROM h1 JOIN w ON x = node WHERE y NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1) GROUP BY y),
h3 AS (SELECT y AS node, min(list_append(way, y)) AS way FROM h2 JOIN w ON x = node WHERE y NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1 UNION SELECT node FROM h2) GROUP BY y),
h4 AS (SELECT y AS node, min(list_append(way, y)) AS way FROM h3 JOIN w ON x = node WHERE y NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1 UNION SELECT node FROM h2 UNION SELECT node FROM h3) GROUP BY y),
found AS (SELECT way FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4) WHERE node = (SELECT max(lo) FROM edge WHERE run_id = '1'))
SELECT CAST(unnest(range(len(way))) AS INTEGER) AS step, unnest(way) AS node FROM found
""")
def path_between_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first to the last customer of a case."""
    pairs = graph.edges(catalog.comm_events(evidence(spark, sf_dir))).where("run_id = '1'")
    ends = pairs.agg(F.min("lo").alias("s"), F.max("lo").alias("t")).first()
    return network.shortest_path(pairs, ends.s, ends.t, 4)


@query(sql="SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS node, min(lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) OVER (PARTITION BY o_custkey) AS component FROM orders")
def components_of_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, each tied to the customer's order before it."""
    name = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    orders = table(spark, sf_dir, "orders").select(name.alias("hi"), F.lag(name).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("lo"))
    return network.components(orders.where("lo is not null"), orders.select(F.col("hi").alias("node")))


@query("message", "call", "comm", sql=EDGES + """
, w AS (SELECT lo AS x, hi AS y FROM edge WHERE run_id = '1' AND lo <> hi UNION SELECT hi, lo FROM edge WHERE run_id = '1' AND lo <> hi), d AS (SELECT x AS node, count(*) AS d FROM w GROUP BY x), n AS (SELECT count(*) AS n FROM d),
r0 AS (SELECT node, 1.0::DOUBLE / n AS r FROM d, n), r1 AS (SELECT y AS node, 0.15 / any_value(n) + 0.85 * sum(r / d.d) AS r FROM w JOIN r0 ON r0.node = x JOIN d ON d.node = x, n GROUP BY y),
r2 AS (SELECT y AS node, 0.15 / any_value(n) + 0.85 * sum(r / d.d) AS r FROM w JOIN r1 ON r1.node = x JOIN d ON d.node = x, n GROUP BY y), r3 AS (SELECT y AS node, 0.15 / any_value(n) + 0.85 * sum(r / d.d) AS r FROM w JOIN r2 ON r2.node = x JOIN d ON d.node = x, n GROUP BY y)
SELECT node, round(r, 9) AS rank FROM r3
""")
def rank_of_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = graph.edges(catalog.comm_events(evidence(spark, sf_dir))).where("run_id = '1'")
    return network.pagerank(pairs, 3).select("node", F.round("rank", 9).alias("rank"))


@query(sql="""
SELECT r_name AS seed, count(DISTINCT n_nationkey) + count(c_custkey) AS reached, round(count(DISTINCT n_nationkey) + count(c_custkey) / 2.0, 6)::DOUBLE AS closeness FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name
""")
def closeness_of_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    pairs = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("lo"), F.concat(F.lit("n"), "n_nationkey").alias("hi")).unionByName(customer.select(F.concat(F.lit("n"), "c_nationkey").alias("lo"), F.concat(F.lit("c"), "c_custkey").alias("hi")))
    return network.closeness(pairs, region.select(F.col("r_name").alias("node")), 2).withColumn("closeness", F.round("closeness", 6))


@query("message", "call", "contact", "comm", sql="""
SELECT type, count(*) AS n FROM (SELECT CASE kind WHEN 'message' THEN 'SENT' ELSE 'CALLED' END AS type FROM comm UNION ALL SELECT 'TO' FROM comm UNION ALL SELECT 'CONTAINS' FROM message UNION ALL SELECT 'CONTAINS' FROM call UNION ALL SELECT 'CONTAINS' FROM contact
  UNION ALL SELECT 'CONTAINS' FROM pages UNION ALL SELECT 'CONTAINS' FROM documents) GROUP BY type
""")
def property_graph_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of all tables of the cases."""
    return graph.property_graph(evidence(spark, sf_dir))[1].groupBy("type").agg(F.count("*").alias("n"))


@query("message", "call", "contact", "comm", sql="""
SELECT 'Person' AS label, run_id, count(*) AS n FROM (SELECT run_id, a FROM comm UNION SELECT run_id, b FROM comm) GROUP BY 2 UNION ALL SELECT 'Message', run_id, count(*) FROM message GROUP BY 2 UNION ALL SELECT 'Call', run_id, count(*) FROM call GROUP BY 2
UNION ALL SELECT 'Contact', run_id, count(*) FROM contact GROUP BY 2 UNION ALL SELECT 'Media', '0', count(*) FROM pages UNION ALL SELECT 'Artifact', '0', count(*) FROM documents
""")
def property_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.property_graph(evidence(spark, sf_dir))[0].groupBy("label", "run_id").agg(F.count("*").alias("n"))


# Search and its indexes.

UNSOUND = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 11 = 3 THEN NULL ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings), q AS (SELECT v FROM e WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(e.v, q.v) AS similarity FROM e, q WHERE e.v IS NOT NULL)"""


def unsound_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh vector has a component that is null, not a number or infinite."""
    broken = F.transform("embedding", lambda x, i: F.when(i == 5, F.element_at(F.array(F.lit(None).cast("float"), F.lit(float("nan")).cast("float"), F.lit(float("inf")).cast("float")), (F.col("vec_id") % 3 + 1).cast("int"))).otherwise(x))
    return table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 11 == 3, broken).otherwise(F.col("embedding")))


@query(sql=UNSOUND + " SELECT vec_id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.1 ORDER BY similarity DESC, vec_id LIMIT 30")
def semantic_topk_of_unsound_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.semantic_search(unsound_vectors(spark, sf_dir), query_vector(spark, sf_dir), 30, 0.1)
    return found.select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query("contact", sql=", " + UNSOUND.removeprefix("WITH ") + """
, rows AS (SELECT 'artifact' AS type, CAST(vec_id AS VARCHAR) AS id, similarity FROM s UNION ALL SELECT 'contact', CAST(vec_id AS VARCHAR), similarity FROM s WHERE vec_id % 2 = 0),
near AS (SELECT * FROM rows WHERE similarity >= 0.1 ORDER BY similarity DESC, type, id LIMIT 60),
k AS (SELECT 'contact' AS type, id, 1.0 AS relevance FROM contact WHERE run_id = '0' AND strpos(lower(name), '00001') > 0 ORDER BY name || ' ' || number, id LIMIT 60),
b AS (SELECT type, id, CASE WHEN relevance IS NULL THEN 'semantic' WHEN similarity IS NULL THEN 'keyword' ELSE 'hybrid' END AS method, 0.6 * coalesce(similarity, 0) + CASE WHEN relevance IS NULL THEN 0 ELSE 0.4 END AS combined, coalesce(relevance, similarity) AS score FROM k FULL JOIN near USING (type, id))
SELECT type, id, method, round(combined, 6) AS combined, round(score, 6) AS score FROM b ORDER BY b.score DESC, b.type, b.id LIMIT 60
""")
def search_executed_over_two_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index in which artifacts and contacts have the same numbers."""
    rows = unsound_vectors(spark, sf_dir).select(F.lit("0").alias("run_id"), F.explode(F.when(F.col("vec_id") % 2 == 0, F.array(F.lit("artifact"), F.lit("contact"))).otherwise(F.array(F.lit("artifact")))).alias("type"), F.col("vec_id").cast("string").alias("id"), F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit(None).cast("string").alias("content"), "embedding")
    request = search.Request(("contacts",), "hybrid", ("00001",), vector=tuple(query_vector(spark, sf_dir)), threshold=0.1, limit=60)
    return search.execute(evidence(spark, sf_dir), "0", request, NOW, rows).select("type", "id", "method", F.round("combined", 6).alias("combined"), F.round("score", 6).alias("score"))


@query("message", sql="SELECT run_id, id, content FROM (SELECT '0' || run_id AS run_id, id, content FROM message) WHERE run_id IN ('03', '04')")
def index_read_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written for cases whose names look like numbers; two of them read back."""
    path = new_path(spark, "index")
    texts = index.message_texts(evidence(spark, sf_dir)["message"]).withColumn("run_id", F.concat(F.lit("0"), "run_id"))
    maintenance.reindexed(path, index.vector_index(texts, lambda found: [(float(len(t)),) for t in found]))
    return index.load_index(spark, path, "03").unionByName(index.load_index(spark, path, "04")).select("run_id", "id", "content")


@query(sql="SELECT CAST(doc_id AS VARCHAR) AS id, 1.5::DOUBLE AS relevance FROM documents WHERE strpos(lower(lang), 'de') > 0 OR strpos(lower(source), 'de') > 0")
def artifacts_of_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_artifacts(evidence(spark, sf_dir)["artifact"], category="de").select("id", "relevance")


@query(sql=f"SELECT CAST(page_id AS VARCHAR) AS id FROM ({PATHS}) WHERE lower(regexp_extract(path, '[^/.][.]([^./]+)$', 1)) IN ('jpg', 'png')")
def media_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = named_files(spark, sf_dir).select(F.lit("0").alias("run_id"), F.col("page_id").cast("string").alias("id"), F.col("path").alias("original_path"), scalars.media_type(F.col("path")).alias("media_type"))
    return search.search_media(media, "image").select("id")


@query(sql="""
SELECT 'artifact' AS info_type, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE regexp_matches(lower(source), 'system|device|android|version|build')
UNION ALL SELECT 'system_file', CAST(page_id AS VARCHAR) FROM pages WHERE regexp_matches(lower(url), 'system|build|version|android|prop') UNION ALL SELECT 'extraction_metadata', CAST(r_regionkey AS VARCHAR) FROM region
""")
def device_info_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = evidence(spark, sf_dir)
    run = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("run_id"), F.col("r_name").alias("file_name"))
    return search.device_info(tables["artifact"], tables["media"], run).select("info_type", "id")


@query(sql="SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderdate DESC, id LIMIT 5 OFFSET 2")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    first = orders.agg(F.min("o_custkey").cast("string")).first()[0]
    rows = orders.select(F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").alias("created_at"))
    return search.history(rows, first, 5, 2).select("id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


# Maintenance.


def stored_cases(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as cases; those of one nation are all of one file, every third is not complete."""
    customer, orders, events = (table(spark, sf_dir, t) for t in ("customer", "orders", "events"))
    run = customer.select(F.col("c_custkey").cast("string").alias("run_id"), F.concat(F.lit("u"), F.col("c_nationkey") % 3).alias("user_id"), F.col("c_name").alias("file_name"), F.when(F.col("c_custkey") % 3 == 0, "failed").otherwise("complete").alias("status"), F.timestamp_seconds(F.col("c_custkey") % 100).cast("timestamp_ntz").alias("start_time"), F.col("c_nationkey").cast("string").alias("file_content_hash"))
    message = orders.select(F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderkey").cast("string").alias("id"))
    call = events.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").cast("string").alias("id"))
    return {"run": run, "message": message, "call": call}


@query(sql="SELECT 'run' AS \"table\", CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_nationkey <> 7 UNION ALL SELECT 'message', CAST(o_orderkey AS VARCHAR) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 7 UNION ALL SELECT 'call', CAST(event_id AS VARCHAR) FROM events LEFT JOIN customer ON c_custkey = user_id WHERE c_nationkey IS NULL OR c_nationkey <> 7")
def cases_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left once the cases of a nation are deleted."""
    tables = stored_cases(spark, sf_dir)
    left = maintenance.without_runs(tables, tables["run"].where("file_content_hash = '7'"))
    parts = [left[n].select(F.lit(n).alias("table"), F.col("run_id" if n == "run" else "id").alias("id")) for n in ("run", "message", "call")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(sql="SELECT CAST(c_custkey AS VARCHAR) AS run_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) OR c_custkey IN (SELECT user_id FROM events)")
def cases_with_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.runs_with_data(stored_cases(spark, sf_dir)).select("run_id")


@query(sql="""
SELECT CAST(c_custkey AS VARCHAR) AS run_id FROM customer WHERE c_nationkey = 4 AND c_custkey % 3 <> 0 AND (c_custkey IN (SELECT o_custkey FROM orders) OR c_custkey IN (SELECT user_id FROM events)) ORDER BY c_custkey % 100 DESC, CAST(c_custkey AS VARCHAR) LIMIT 1
""")
def case_of_same_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.processed_before(stored_cases(spark, sf_dir), "4").select("run_id")


@query(sql="SELECT 'run' AS \"table\", CAST(c_custkey AS VARCHAR) AS run_id, 1 AS n FROM customer UNION ALL SELECT 'message', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'call', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2")
def rows_of_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.counts(stored_cases(spark, sf_dir))


@query(sql=f"WITH t AS (SELECT page_id, CASE WHEN lower(regexp_extract(path, '[^/.][.]([^./]+)$', 1)) = 'ogg' THEN 'said ' || page_id ELSE 'kept' END AS text FROM ({PATHS}) WHERE page_id % 8 IN (2, 3)) SELECT CAST(page_id AS VARCHAR) AS media_id, text, sha256(text) AS digest FROM t")
def transcripts_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio files have new transcripts in place of their old ones; those of other files stay."""
    media = named_files(spark, sf_dir).select(F.lit("0").alias("run_id"), F.col("page_id").cast("string").alias("id"), F.col("path").alias("original_path"), F.col("page_id").cast("string").alias("storage_path"), F.lit(None).cast("string").alias("media_type"), "page_id")
    old = media.where("page_id % 8 in (2, 3)").select("run_id", F.col("id").alias("media_id"), F.lit("kept").alias("text"), F.lit(None).cast("string").alias("language"), F.sha2(F.lit("kept"), 256).alias("sha256"))
    return maintenance.transcribed(media.drop("page_id"), old, lambda path: f"said {path}").select("media_id", "text", F.col("sha256").alias("digest"))


@query(sql="""
SELECT o_orderkey AS result_id, CASE WHEN o_orderstatus <> 'P' THEN 'rule ' || o_orderstatus END AS rule_title, c_name AS file_name, 'name ' || c_nationkey % 3 AS username FROM orders LEFT JOIN customer ON c_custkey = o_custkey
""")
def report_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, cases = table(spark, sf_dir, "orders"), stored_cases(spark, sf_dir)
    results = orders.select(F.col("o_orderkey").alias("result_id"), F.col("o_orderstatus").alias("rule_id"), F.col("o_custkey").cast("string").alias("run_id"))
    rules = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderstatus").alias("rule_id")).distinct().withColumn("title", F.concat(F.lit("rule "), "rule_id"))
    users = cases["run"].select("user_id").distinct().withColumn("username", F.concat(F.lit("name "), F.substring("user_id", 2, 9)))
    return maintenance.report_rows(results, rules, cases["run"], users).select("result_id", "rule_title", "file_name", "username")


# Outputs.


@query(sql="SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, 'a b c' AS note, CASE WHEN c_custkey % 2 = 0 THEN 'None' ELSE c_mktsegment END AS segment FROM customer")
def tsv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as TSV and read again: line breaks and tabs are spaces, nulls a word."""
    path = new_path(spark, "tsv")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("a\tb\r\nc").alias("note"), F.when(F.col("c_custkey") % 2 == 1, F.col("c_mktsegment")).alias("segment"))
    outputs.write_tsv(rows, path)
    return spark.read.option("sep", "\t").option("header", "true").schema("c_custkey string, c_name string, note string, segment string").csv(path)


@query(sql="SELECT event_id AS event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seen_at, '[1,' || event_id || ']' AS list FROM events")
def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed table, written and read: times are seconds, lists JSON, names plain."""
    path = new_path(spark, "typed")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("Event ID!"), F.col("ts").cast("timestamp").alias("Seen At"), F.array(F.lit(1), F.col("event_id").cast("int")).alias("list"))
    outputs.write_table(rows, path)
    return spark.read.parquet(path).withColumnsRenamed({"event_id": "event_id"})


@query(sql="""SELECT sha1(text) AS media_id, CAST(min(doc_id) AS VARCHAR) AS doc_id, CAST(strlen(text) AS BIGINT) AS size FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY text""")
def media_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("/d/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    media, _ = outputs.media_references(files, "documents")
    return media.select(F.col("id").alias("media_id"), F.regexp_extract("path", "([1-9][0-9]*|0)$", 1).alias("doc_id"), F.col("size").cast("long").alias("size"))


@query(sql="SELECT c_mktsegment AS category, CAST(c_nationkey AS VARCHAR) AS label, string_agg(DISTINCT c_name, ',' ORDER BY c_name) AS found FROM customer GROUP BY 1, 2")
def device_facts_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category"), F.col("c_nationkey").cast("string").alias("label"), F.col("c_name").alias("value"), F.lit("file").alias("source"))
    twice = facts.unionByName(facts)
    return outputs.device_facts(twice).select("category", "label", F.array_join(F.transform("entries", lambda e: e["value"]), ",").alias("found"))


# Artifacts.


@query(sql="""
SELECT o_custkey AS thread_id, count(*) AS messages, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS body, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS timestamp FROM orders GROUP BY o_custkey
""")
def artifact_bare_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each thread beside the number of its rows, the first of equals."""
    sms = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("rowid"), F.col("o_orderkey").cast("string").alias("_id"), F.col("o_custkey").cast("string").alias("thread_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string").alias("date"), F.col("o_orderkey").cast("string").alias("body"))
    return artifact(spark, "latest_of_threads", sms=sms).select(F.col("thread_id").cast("long").alias("thread_id"), "messages", F.col("body").cast("long").alias("body"), "timestamp")


@query(sql="SELECT n_name AS title, '1998-01-02 03:04:05' AS modified, max(c_custkey) AS folder FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def artifact_bare_last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bookmark in several folders is listed once, with its last."""
    entities = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("rowid"), F.col("n_nationkey").cast("string").alias("entityId"), F.lit("Bookmark").alias("type"), F.col("n_name").alias("title"), F.lit("1998-01-02T03:04:05.000Z").alias("lastModified"))
    relations = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("rowid"), F.col("c_custkey").cast("string").alias("folderId"), F.col("c_nationkey").cast("string").alias("entityId"))
    return artifact(spark, "bookmarks", entities=entities, relations=relations).select("title", "modified", F.col("folder_id").cast("long").alias("folder"))


@query(sql="SELECT event_id AS seconds, c_name AS name FROM events, customer WHERE c_custkey = user_id AND event_id > 0")
def artifact_comma_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("number"), F.lit("0").alias("date"), F.col("event_id").cast("string").alias("duration"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("number"), F.col("c_name").alias("name"))
    return artifact(spark, "named_calls", calls=calls, names=names).select("seconds", "name")


@query(sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS concept_id, trim(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.0'), '.0') AS started, CAST(strpos(o_orderpriority || ' x', ' ') AS INTEGER) AS first_space, CAST(o_orderkey % 3 + 1 AS INTEGER) AS splits, round(o_totalprice / 1000, 3) AS kilometres FROM orders
""")
def artifact_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replace, trim of a set of characters, instr, json_valid and json_array_length; every second row has broken JSON besides."""
    value = F.to_json(F.struct(F.concat("o_orderpriority", F.lit(" x")).alias("activityName"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.0").alias("startTimeGMT"), F.col("o_totalprice").alias("distance")).alias("summaryDTO"), F.sequence(F.lit(0), F.col("o_orderkey") % 3).alias("splits")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("concept_id"), F.lit("ACTIVITY_DETAILS").alias("data_type"), F.explode(F.array(value, F.lit('{"activityName": "torn'))).alias("cached_val"))
    return artifact(spark, "cached_activities", json_activities=rows).select("concept_id", "started", "first_space", "splits", "kilometres")


# Numbers and texts.


@query(sql="""
WITH t AS (SELECT o_orderkey AS k, (2 * o_orderkey + 1) * 125 AS thousandths FROM orders)
SELECT k, (thousandths // 10 + CASE WHEN thousandths % 10 > 5 OR thousandths % 10 = 5 AND thousandths // 10 % 2 = 1 THEN 1 ELSE 0 END) / 100.0::DOUBLE AS two, (thousandths // 100 + CASE WHEN thousandths % 100 > 50 OR thousandths % 100 = 50 AND thousandths // 100 % 2 = 1 THEN 1 ELSE 0 END) / 10.0::DOUBLE AS one FROM t
""")
def rounded_half_to_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighths, which are exact: halves of hundredths go to the even one."""
    x = (2 * F.col("o_orderkey") + 1) / F.lit(8.0)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), numbers.python_round(x, 2).alias("two"), numbers.python_round(x, 1).alias("one"))


@query(sql="SELECT doc_id, coalesce(text, '') AS text FROM documents")
def mojibake_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 read as Latin-1 and repaired is the text again; texts that no such mistake can give stay."""
    text = F.coalesce("text", F.lit(""))
    spoiled = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return table(spark, sf_dir, "documents").select("doc_id", scalars.repaired_text(spoiled).alias("text"))


@query(sql="SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, strftime(ts, '%Y-%m-%d %H:%M:%S') AS webkit, strftime(ts, '%Y-%m-%d %H:%M:%S') AS cocoa FROM events")
def epochs_told_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in seconds, milli- and microseconds by their digits; other epochs."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = F.floor(micros / 1_000_000)
    counted = F.element_at(F.array(seconds, seconds * 1000, seconds * 1_000_000), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", scalars.epoch_seconds(counted).alias("s"), scalars.webkit_text((seconds + 11_644_473_600) * 1_000_000).alias("webkit"), scalars.cocoa_text(seconds - 978_307_200).alias("cocoa"))


@query("contact", sql=f"SELECT name, {HMAC % 'lower(trim(mail))'} AS identifier_hash FROM (SELECT name, ' ' || name || '@Example.COM' AS mail FROM contact)")
def identifier_hash_of_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import identifiers

    return evidence(spark, sf_dir)["contact"].select("name", identifiers.identifier_hash(F.concat(F.lit(" "), "name", F.lit("@Example.COM")), KEY).alias("identifier_hash"))


@query(sql="""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS zulu, strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS offset_, strftime(ts, '%Y-%m-%d %H:%M:00') AS minute, strftime(ts + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM events
""")
def times_moved_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO texts with Z, with an offset and without seconds, and local times with their offset."""
    bare, shown = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select(
        "event_id", shown(scalars.iso_utc(F.concat(bare, F.lit(".125Z")))).alias("zulu"), shown(scalars.iso_utc(F.concat(bare, F.lit("+05:30")))).alias("offset_"),
        shown(scalars.strict_human_time(F.date_format("ts", "yyyy-MM-dd HH:mm"))).alias("minute"), shown(scalars.local_to_utc(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("-0400")))).alias("local"),
    )


@query(sql=r"""
SELECT page_id, regexp_replace(url || ' "a|b"', '[\\/*?:"<>|''\r\n]', '_', 'g') AS name, regexp_replace(url || ' "a|b"', '[*?:"<>|''\r\n]', '_', 'g') AS path FROM pages
""")
def names_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("url", F.lit(' "a|b"'))
    return table(spark, sf_dir, "pages").select("page_id", scalars.file_name(name).alias("name"), scalars.file_path(name).alias("path"))


@query(sql="""
WITH f AS (SELECT o_orderstatus AS t, o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 5) SELECT o_orderstatus AS result_type, count(*) AS n, (SELECT string_agg(k, ',' ORDER BY k) FROM f WHERE t = o_orderstatus) AS sample FROM orders GROUP BY o_orderstatus
""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("result_id"), F.col("o_orderstatus").alias("result_type"))
    return maintenance.report_summary(results).withColumn("sample", F.array_join("sample", ","))


# Custody.

CHAINS = f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
chain AS (
  SELECT user_id, event_id, event_type, seq, '{custody.GENESIS}' AS prev_hash FROM e WHERE seq = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.event_type, e.seq, sha256('{{"event_type":"' || c.event_type || '","payload":null,"prev_hash":"' || c.prev_hash || '","run_id":"' || c.user_id || '","seq":' || c.seq || ',"timestamp":"t","user_id":"u"}}')
  FROM chain c JOIN e ON e.user_id = c.user_id AND e.seq = c.seq + 1
)"""


def chained_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of each user's events in which every entry covers the one before, folded over the events in order."""
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = events.select(F.col("user_id").cast("string").alias("run_id"), F.row_number().over(order).cast("long").alias("seq"), "event_id", "event_type")
    entry = F.struct("seq", "event_id", "event_type")

    def text(e: Column, before: Column) -> Column:
        return F.concat(F.lit('{"event_type":"'), e["event_type"], F.lit('","payload":null,"prev_hash":"'), before, F.lit('","run_id":"'), F.col("run_id"), F.lit('","seq":'), e["seq"].cast("string"), F.lit(',"timestamp":"t","user_id":"u"}'))

    def link(done: Column, e: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["entry_hash"], F.lit(custody.GENESIS))
        return F.concat(done, F.array(F.struct(e["seq"].alias("seq"), e["event_id"].alias("event_id"), e["event_type"].alias("event_type"), before.alias("prev_hash"), F.sha2(text(e, before), 256).alias("entry_hash"))))

    start = F.array().cast("array<struct<seq:bigint,event_id:bigint,event_type:string,prev_hash:string,entry_hash:string>>")
    chains = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(entry)).alias("entries")).select("run_id", F.explode(F.aggregate("entries", start, link)).alias("x"))
    return chains.select("run_id", "x.*", F.lit(None).cast("string").alias("payload"), F.lit("t").alias("timestamp"), F.lit("u").alias("user_id"))


@query(sql=CHAINS + """
SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS length, min(seq) FILTER (event_id % 89 = 0) AS broken_at_seq, CASE WHEN min(seq) FILTER (event_id % 89 = 0) IS NOT NULL THEN 'entry_hash mismatch' END AS detail, max_by(prev_hash, seq) AS last_prev_hash FROM chain GROUP BY user_id
""")
def audit_entries_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of real entries, some of them changed afterwards: the hash of such an entry is not that of its text any more."""
    log = chained_log(spark, sf_dir)
    changed = log.withColumn("user_id", F.when(F.col("event_id") % 89 == 0, "mallory").otherwise(F.col("user_id")))
    last = log.groupBy("run_id").agg(F.max_by("prev_hash", "seq").alias("last_prev_hash"))
    return custody.verify_chain(changed, ["run_id"]).join(last, "run_id").select("run_id", "length", "broken_at_seq", "detail", "last_prev_hash")


@query(sql=f"""
WITH h AS (SELECT sha256('{{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}') AS h FROM orders), c AS (SELECT h, count(*) AS n FROM h GROUP BY h), d AS (SELECT CAST(ceil(ln(greatest(1.0, count(*) / {custody.ROWS}.0)) / ln(16)) AS INTEGER) AS digits FROM c),
one AS (SELECT substr(h, 1, digits) AS k, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h || ':' || n)) AS h FROM c, d GROUP BY 1), whole AS (SELECT CASE WHEN digits = 0 THEN max(h) ELSE sha256(string_agg(k || ':' || h, chr(10) ORDER BY k || ':' || h)) END AS content_hash FROM one, d GROUP BY digits)
SELECT content_hash, {HMAC % "content_hash || ':head'"} AS signature FROM whole
""")
def signed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of a table, made in levels, and its signature with the head of a log."""
    content = custody.content_hash(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    row = spark.range(1).select(F.lit(content).alias("content_hash"))
    return row.select("content_hash", custody.signature(F.col("content_hash"), KEY, F.lit("head")).alias("signature"))

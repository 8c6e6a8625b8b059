"""What a review of round 3 found, each with what would have failed before."""

import os
import sqlite3
import time
import tracemalloc
from datetime import datetime

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sleuthframe import catalog, queries, shared, store_queries  # noqa: F401  registers
from sleuthframe.functions import scalars
from sleuthframe.llm import jaccard_join, lm_scoring, tables
from sleuthframe.operators import custody, graph, network
from sleuthframe.sources import sqlite

from .conftest import rows


def test_sizes_are_rounded_half_to_even(spark):
    sizes = [1280, 1792, 1024 * 1024 * 5 // 4, 1331, 1023]
    found = spark.createDataFrame([(n,) for n in sizes], "n long").select(scalars.human_size(F.col("n"))).collect()
    assert [r[0] for r in found] == ["1.2 KB", "1.8 KB", "1.2 MB", "1.3 KB", "1023.0 B"]


def test_hash_of_a_table_with_more_than_two_digits_of_parts(spark, monkeypatch, tmp_path):
    """Three digits: parts, then all of them as one text, as the SQL of the query has it."""
    monkeypatch.setattr(custody, "ROWS", 2)
    table = spark.range(2000).select((F.col("id") + 1).alias("o_orderkey"), F.element_at(F.array(*map(F.lit, "FOP")), (F.col("id") % 3 + 1).cast("int")).alias("o_orderstatus"))
    table.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    sql = queries.ORACLE["signed_content"].replace("/ 10000.0", "/ 2.0")
    assert "/ 2.0" in sql
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert rows(queries.QUERIES["signed_content"](spark, str(tmp_path))) == db.execute(sql).fetchall()


def test_files_are_made_from_a_stream_of_rows(spark, tmp_path):
    """A file's rows come in batches, in order, and are not held together."""
    rows_ = spark.range(3000).select((F.col("id") % 2).alias("file"), (-F.col("id")).alias("place"))

    def made(f, own):
        assert iter(own) is own and not hasattr(own, "__len__")
        for r in own:
            f.write(f"{r['place']}\n".encode())

    folder = store_queries.files_from(rows_, str(tmp_path / "made"), ".txt", made)
    for k in (0, 1):
        with open(f"{folder}/{k}.txt") as f:
            assert [int(x) for x in f] == sorted(-i for i in range(3000) if i % 2 == k)


def test_ranges_of_sqlite_files_share_tasks(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)")
        db.executemany("INSERT INTO t VALUES (?)", [(i,) for i in range(0, 4000, 2)])
    found = sqlite.read_sqlite(spark, path, "t", rowsPerPartition="5")
    assert found.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    assert sorted(r.rowid for r in found.collect()) == list(range(0, 4000, 2))


def test_ngrams_are_not_written_and_answers_are_one_byte(spark, monkeypatch, tmp_path):
    """The way for many shards: several parts of a shard, pieces that lie in several batches, scores as with a broadcast filter."""
    monkeypatch.setattr(lm_scoring, "MOST_BITS", 1 << 14)
    monkeypatch.setattr(lm_scoring, "PROBED", 50)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(i % 40)) if i % 11 else None) for i in range(300)], "doc_id long, text string")
    written = []
    monkeypatch.setattr(lm_scoring, "materialize", lambda df, name: written.append((name, df.columns)) or tables.materialize(df, name))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        far = rows(lm_scoring.score_documents(docs, broadcast=0))
        assert written and all("h" not in columns for name, columns in written if name != "pairs") and "asked" not in dict(written)
        near = rows(lm_scoring.score_documents(docs, broadcast=1000))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r[:6] for r in far] == [r[:6] for r in near] and all(abs(a[6] - b[6]) < 1e-9 for a, b in zip(far, near)) and len(far) == 300


def test_chains_of_a_task_take_one_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(network, "Written", lambda df, name: made.append(name) or shared.Written(df, name))
    chain = spark.range(200).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("lo"), F.lpad((F.col("id") + 1).cast("string"), 4, "0").alias("hi")).coalesce(1)
    assert {r.component for r in network.components(chain).collect()} == {"0000"} and len(made) <= 3
    monkeypatch.setattr(network, "PAIRS", 10)
    assert {(r.component, r.node) for r in network.components(chain.repartition(7)).collect()} == {("0000", f"{i:04d}") for i in range(201)}
    ends = spark.createDataFrame([("b", None), ("c", "c"), ("e", "d")], "lo string, hi string")
    assert rows(network.components(ends)) == [("b", "b"), ("c", "c"), ("d", "d"), ("e", "d")]


def test_limits_are_crossed_in_one_range(spark, monkeypatch):
    births = spark.range(500).select(((F.col("id") * 37) % 500).alias("at"), (F.col("id") % 3 + 1).alias("n"))
    order = sorted(births.collect())
    for few in (10_000, 0):  # in one task, and by ranges
        monkeypatch.setattr(graph, "FEW", few)
        for limit in (0, 7, 400, 998, 999, 2000):
            total, want = 0, []
            for at, n in order:
                total += n
                if total > limit:
                    want = [(at,)]
                    break
            assert rows(graph.crossing(births, limit)) == want


def test_edges_are_grouped_before_they_are_hashed(spark, monkeypatch):
    columns, kinds = [], []
    monkeypatch.setattr(graph, "written", lambda df, name: columns.append(df.columns) or kinds.extend(df.schema[c].dataType.simpleString() for c in "xy") or shared.written(df, name))
    events = [("1", f"m{i}", "+1 555 000 0001", "+15550000002" if i % 2 else " free text ", datetime(2024, 1, 1 + i)) for i in range(4)]
    message = spark.createDataFrame(events, "run_id string, id string, sender string, receiver string, timestamp timestamp_ntz")
    call = spark.createDataFrame([], "run_id string, id string, caller string, receiver string, timestamp timestamp_ntz")
    contact = spark.createDataFrame([("1", "15550000002", "Ann")], "run_id string, number string, name string")
    found = graph.link_graph({"message": message, "call": call, "contact": contact}, ["1"], "a key", node_limit=None, edge_limit=None)
    assert columns == [["run_id", "kind", "id", "ts", "a", "b", "x", "y"]] and kinds == ["string", "string"]  # no hashes yet
    assert {(r.value, r.type, r.degree, r.label, len(r.id)) for r in found["nodes"].collect()} == {("15550000001", "phone", 4, "15550000001", 64), ("15550000002", "phone", 2, "Ann", 64), ("free text", "other", 2, "free text", 64)}
    ids = {r.id for r in found["nodes"].collect()}
    assert {i for r in found["edges"].collect() for i in (r.source, r.target)} == ids and all(r.source < r.target for r in found["edges"].collect())


def test_edges_that_cannot_match_are_left_out_before_joins(spark):
    nodes = spark.createDataFrame([("Call", "1"), ("Message", "a-long-id")], "label string, key string")
    edges = spark.createDataFrame([("SENT", "p", "a-long-id"), ("TO", "1", "p"), ("SENT", "pp", "1"), ("TO", None, "2")], "type string, source string, target string")
    kept, found = graph.of_types(nodes, edges, ["Call"])
    assert rows(found) == [("SENT", "pp", "1"), ("TO", "1", "p")] and "octet_length" in found._jdf.queryExecution().toString().lower()


def test_recipients_are_cut_from_one_text_a_conversation(spark):
    people = [("1", "c", "Zoë"), ("2", "c", "Ann"), ("3", "c", None), ("4", "d", "alone"), ("5", "e", "x"), ("5", "f", "x"), ("6", "e", "E"), ("7", "f", "F"), ("8", None, "nowhere"), ("9", "c", "Ann")]
    participants = spark.createDataFrame([(p, c, f"i{k}") for k, (p, c, _) in enumerate(people)], "_id string, conversation_id string, participant_info_id string")
    info = spark.createDataFrame([(f"i{k}", n, None) for k, (_, _, n) in enumerate(people)], "_id string, contact_name string, number string")
    messages = spark.createDataFrame([(str(k), str(k)) for k in (1, 2, 3, 4, 5, 8, 77)], "_id string, participant_id string")
    found = queries.artifact(spark, "conversation_messages", messages=messages, participants=participants, participants_info=info)
    assert sorted({(r.sender or "", r.recipients) for r in found.collect()}, key=str) == sorted({("Zoë", "Ann, Ann"), ("Ann", "Ann, Zoë"), ("", "Ann, Ann, Zoë"), ("alone", None), ("x", "E, F"), ("nowhere", None), ("", None)}, key=str)
    sql = queries.artifacts()["conversation_messages"].sql
    assert "a.times > 1" in sql and sql.count("LISTAGG") == 1  # pairs only of ids that are there more than once


def test_only_open_groups_of_near_copies_are_put_together(spark, monkeypatch):
    """Copies that are one component already, by several pivots of a task and of all, are led to no group."""
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    put = []

    def spied(hits, f=jaccard_join.grouped):
        put.append(f(hits).count())
        return f(hits)

    monkeypatch.setattr(jaccard_join, "grouped", spied)
    texts = [" ".join(f"w{i}" if i != k else f"x{k}" for i in range(200)) for k in range(60)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), 4, (85, 100))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(k, 0) for k in range(60)}
    assert put == [0]


def test_members_of_open_groups_that_met_a_pivot_in_a_task(spark):
    """Against all ways, written out; two members of one class are one."""
    # 1 and 2 are pivots of tasks, of the groups 1 and 5; 7 is of no group but its own
    more = [(1, 1), (2, 1), (1, 5), (5, 5), (2, 5), (8, 8), (9, 8)]
    near = [(1, 1), (3, 1), (4, 1), (3, 2), (2, 2), (4, 2), (7, 7), (10, 7), (11, 7)]
    component = {4: 4, 10: 10, 8: 8, 9: 8}
    hits = [(d, p, (d, p) in more, (d, p) in near, 3 if d == 11 else d, component.get(d, 1)) for d, p in sorted({*more, *near})]
    got = jaccard_join.grouped(spark.createDataFrame(hits, "d long, pivot long, more boolean, near boolean, member long, component long"))
    member = {h[0]: (h[4], h[5]) for h in hits}
    groups = {d: {p for e, p in more if e == d} or {d} for d, *_ in hits}
    every = {(p, *member[d]) for d, p in more} | {(p, *member[d]) for d, via in near for p in groups[via]}
    several = {p for p, *_ in every if len({c for q, _, c in every if q == p}) > 1}
    assert several == {1, 5, 7}
    assert sorted(map(tuple, got.select("pivot", "d", "component").collect())) == sorted(x for x in every if x[0] in several)


def peak(f) -> float:
    """MB that a call takes at its peak."""
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_probing_holds_little_besides_its_answers():
    bits, h = np.zeros(1 << 21, np.uint8), lm_scoring.mix(np.arange(2_000_000, dtype=np.uint64))
    bits[::3] = 255
    assert len(lm_scoring.Filter(bits, {1: 1}).level(h[:0], 1)) == 0
    assert peak(lambda: lm_scoring.Filter(bits, {1: 1}).level(h, 1)) < 48  # 16 of answers, twice where parts are joined


def test_texts_of_a_batch_become_objects_a_few_at_a_time():
    texts = [f"{i} " * 500 if i % 7 else None for i in range(4 * lm_scoring.TEXTS + 3)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    assert [t for some in lm_scoring.texts_of(batch) for t in some] == texts
    assert max(map(len, lm_scoring.texts_of(batch))) == lm_scoring.TEXTS
    assert [b for _, b in lm_scoring.cut(batch.column("text"), 10**9)] == [len(texts)] and len(list(lm_scoring.cut(batch.column("text"), 1))) > 1000


def test_pairs_are_dealt_in_bounded_parts_before_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART", 100)
    events = spark.range(3000).select((F.col("id") % 2).cast("string").alias("run_id"), F.when(F.col("id") % 50 > 0, (F.col("id") % 1009).cast("string")).alias("a"), (F.col("id") % 13).cast("string").alias("b"))
    found = graph.edges(events)
    sizes = [n for n in found.groupBy(F.spark_partition_id()).agg(F.sum("weight")).toPandas()["sum(weight)"]]
    assert len(sizes) > 20 and max(sizes) < 200 and sum(sizes) == 2940
    expected = duckdb.connect().execute("SELECT least(a, b), greatest(a, b), r, count(*) FROM (SELECT CAST(i % 2 AS VARCHAR) r, CAST(i % 1009 AS VARCHAR) a, CAST(i % 13 AS VARCHAR) b FROM range(3000) t(i) WHERE i % 50 > 0) GROUP BY ALL").fetchall()
    assert sorted(map(tuple, found.select("lo", "hi", "run_id", "weight").collect())) == sorted(expected)


def test_rows_are_dealt_into_so_few_parts_that_none_are_held(spark, monkeypatch):
    """Spark's writers hold the rows of a task from 201 parts on."""
    monkeypatch.setattr(graph, "PART", 10)
    assert graph.dealt(spark.range(3000), "id").rdd.getNumPartitions() == 200


def sizes_of_parts(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_joins_of_the_evidence_are_dealt_in_bounded_parts(spark, monkeypatch):
    d, db = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("customer", "events", "lineitem", "nation", "orders", "part"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    expected = sorted(db.execute(queries.ORACLE["normalized_degrees"]).fetchall())
    monkeypatch.setattr(catalog, "SORTED", 200, raising=False)
    for sent in (10**6, 0):  # with and without the joins to customers and parts
        monkeypatch.setattr(catalog, "SENT", sent, raising=False)
        sizes = sizes_of_parts(catalog.benchmark_evidence(spark, d)["message"])
        assert len(sizes) > 20 and max(sizes) < 600
        assert rows(queries.QUERIES["normalized_degrees"](spark, d)) == expected


def test_no_case_is_brought_to_one_task_for_its_shares(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "10000"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        degrees = spark.range(1, 2001).select((F.col("id") % 1).cast("string").alias("run_id"), F.col("id").cast("string").alias("node"), F.col("id").alias("degree")).repartition(8)
        found = graph.normalized_degrees(degrees)
        assert max(sizes_of_parts(found)) < 1500
        assert sorted(found.select("degree", "share").collect()) == [(i, i * 100 / 2000) for i in range(1, 2001)]
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_signatures_that_are_sent_at_once_take_little_memory():
    n = jaccard_join.FLUSH
    sig, d, one = jaccard_join.mix(np.arange(n, dtype=np.uint64) % np.uint64(n - 1000)), np.arange(n) // 300, np.ones(n, np.int64)
    assert peak(lambda: jaccard_join.held(sig, d, one, jaccard_join.FEW)) < 100 and jaccard_join.BUCKET <= n


def test_a_chunk_is_probed_at_once_for_all_pieces():
    h, asked = np.sort(lm_scoring.mix(np.arange(5000, dtype=np.uint64))), []
    cells = [lm_scoring.packed(h[k : k + 5]) for k in range(0, 5000, 5)] + [b""]
    part = type("Part", (), {"level": lambda self, h, order: asked.append(h) or np.arange(len(h)) % 200})()
    levels = lm_scoring.probed(part, cells).to_pylist()
    assert len(asked) == 1 and [list(x) for x in levels[:3]] == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10, 11, 12, 13, 14]] and levels[-1] == b""
    assert (asked[0] == h >> np.uint64(16) << np.uint64(16)).all() and all(len(c) == 30 for c in cells[:-1])  # 6 bytes of 8 are sent


def test_words_are_told_apart_without_an_object_for_each_token():
    texts = ["One one\tTWO", None, "", " \u00c9t\u00e9 \u0391 one ", "\x1c\x85x\n\nONE"]
    words, token, sizes = lm_scoring.tokens(b"".join(map(lm_scoring.encoded, texts)))
    assert [words[i].as_py() for i in token] == [w for t in texts for w in [*(t or "").encode().lower().split(), b"\n"]] and sizes.tolist() == [4, 1, 1, 4, 3]
    head = lm_scoring.Head(pa.array([b"one", b"two"], pa.binary()), np.array([7, 3]))
    head.hashes[:] = lm_scoring.hashes_of(pa.array([b"\n"], pa.binary()))[0]  # as if hashes met: a word is of the head only if it is the same
    assert (head.counts_of(words, lm_scoring.hashes_of(words)) == -1).all()
    h = lm_scoring.mix(np.arange(3000, dtype=np.uint64) % np.uint64(700))
    found, back = lm_scoring.different(h)
    assert len(found) == 700 and (found[back] == h).all()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(lo")


def test_events_of_edges_are_dealt_once_and_not_at_all_where_only_numbers_are_asked_for(spark, monkeypatch):
    """Also where some pairs have many events, which are cut down before they are dealt."""
    events = spark.range(400).select(
        F.lit("1").alias("run_id"), F.lit("call").alias("kind"), F.lpad(F.col("id").cast("string"), 3, "0").alias("id"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 2 == 0, "p").otherwise(F.concat(F.lit("q"), (F.col("id") % 20).cast("string"))).alias("x"), F.lit("a").alias("y"),
    )
    found = graph.link_edges(events, "a key", 50)
    assert exchanges(found) == 1 and "collect_list" not in found.select("weight", "n_citations")._jdf.queryExecution().optimizedPlan().toString()
    ways = [rows(found)]
    monkeypatch.setattr(graph, "MANY", 100)
    many = graph.link_edges(events, "a key", 50)
    assert "Union" in many._jdf.queryExecution().optimizedPlan().toString() and rows(many) == ways[0]
    assert sorted((r.weight, r.n_citations, [c.row_id for c in r.citations][:2], len(r.citations)) for r in found.collect())[-1] == (200, 50, ["000", "002"], 50)
    assert sorted(r.weight for r in found.collect()) == [20] * 10 + [200]


def test_what_a_written_table_shuffled_is_gone(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager()
    files = lambda: sum("shuffle" in n for d in manager.diskBlockManager().localDirsString() for _, _, names in os.walk(d) for n in names)
    before, table = files(), spark.range(1000).repartition(7, "id")
    assert sorted(r.id for r in shared.written(table, "gone").collect()) == list(range(1000))
    until = time.monotonic() + 10
    while files() > before and time.monotonic() < until:
        time.sleep(0.1)
    assert files() <= before
    assert spark.conf.get(shared.CLEANED) == "false"


def test_probing_of_a_full_segment_ends():
    h = lm_scoring.mix(np.arange(100, dtype=np.uint64))
    assert (lm_scoring.Filter(np.full(1 << 11, 255, np.uint8), {1: 1}).level(h, 1) == len(lm_scoring.VALUES) - 1).all()

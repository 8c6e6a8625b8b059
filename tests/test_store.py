"""Stores, files on shared file systems, graph algorithms, numbers and accounts of streams."""

import hashlib
import io
import json
import random
import sqlite3
import tarfile
import uuid
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sleuthframe import store as stores
from sleuthframe.functions import numbers, scalars
from sleuthframe.operators import custody, graph, index, maintenance, network, search
from sleuthframe.sources import archives, sqlite
from sleuthframe.store import CaseStore, ContentStore, digest_of
from sleuthframe.streaming import events as streaming

NOW = datetime(2024, 5, 1, 12)
XML = "<report>\n<message><from>a</from><to>b</to><timestamp>2024-01-01T10:00:00</timestamp><content>hi</content></message>\n<call><caller>a</caller><receiver>b</receiver><duration>7</duration></call>\n<contact><name>N</name><number>1</number></contact>\n"
FILES = '<file path="/sd/x.jpg">\n<item name="Local Path"><![CDATA[files\\x.jpg]]></item>\n</file>\n<file path="/sd/gone.txt">\n<item name="Local Path">files/gone.txt</item>\n</file>\n</report>\n'


@pytest.fixture
def beyond(spark, tmp_path):
    """The test's folder on a file system that only Spark's readers know."""
    name = f"far{uuid.uuid4().hex}"  # file systems are cached by name
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./in", f"file://{tmp_path}")
    return f"viewfs://{name}/in"


def ufdr(path):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("report.xml", XML + FILES)
        z.writestr("files/x.jpg", "pixels")
    return str(path)


# Files.


def tar_of(members, mode="w", format=tarfile.PAX_FORMAT):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode, format=format) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(data), 1704067200
            t.addfile(info, io.BytesIO(data))
        t.addfile(tarfile.TarInfo("folder/"))
    return out.getvalue()


@pytest.mark.parametrize("format", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_tar_is_split_where_headers_are(spark, tmp_path, format):
    inner = tar_of([("inside/not a member", b"x" * 700), ("inside/other", b"y")])
    members = [(f"data/{i}.bin", bytes([i % 251]) * (i * 37 % 3000)) for i in range(120)] + [("data/nested.tar", inner), ("data/empty", b""), ("data/last", inner[512:])]
    if format != tarfile.USTAR_FORMAT:
        members += [("data/" + "long/" * 60 + "name é.txt", b"deep"), ("data/after", b"z")]
    (tmp_path / "a.tar").write_bytes(tar_of(members, format=format))
    for step in (archives.RANGE_BYTES, 4096, 512):
        got = {r.path: bytes(r.content) for r in archives.read_archive(spark, str(tmp_path / "a.tar"), range_bytes=step).collect()}
        assert got == dict(members)
    pieces = spark.range(1).select(F.lit(str(tmp_path / "a.tar")).alias("archive"), F.explode(F.sequence(F.lit(0), F.lit((tmp_path / "a.tar").stat().st_size - 1), F.lit(8192))).alias("start"))
    found = pieces.withColumn("end", F.col("start") + 8192).repartition(8).mapInArrow(archives.headers, "archive string, place long, after long, prefix boolean")
    assert found.select(F.spark_partition_id()).distinct().count() > 1


def test_members_that_cannot_be_read(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i, method in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)):
            z.writestr(f"m{i}", f"text {i} " * 50, method)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        at = z.getinfo("m1").header_offset + 40
    data[at] ^= 0xFF
    (tmp_path / "a.zip").write_bytes(data)
    (tmp_path / "b.zip").write_bytes(b"PK\x03\x04 but no directory")
    (tmp_path / "c.tgz").write_bytes(tar_of([("one", b"1" * 5000)], "w:gz")[:60])
    got = {(r.archive.rsplit("/", 1)[1], r.path): (r.content and bytes(r.content), r.error) for r in archives.read_archive(spark, str(tmp_path)).collect()}
    assert [got["a.zip", f"m{i}"][0] for i in (0, 2, 3)] == [f"text {i} ".encode() * 50 for i in (0, 2, 3)]
    assert got["a.zip", "m1"][0] is None and got["a.zip", "m1"][1]
    assert got["b.zip", None][1].startswith("BadZipFile") and got["c.tgz", None][1]


def test_archives_on_another_file_system(spark, tmp_path, beyond):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data/one.db", "1")
        z.writestr("data/two.txt", "2")
    (tmp_path / "b.tar").write_bytes(tar_of([("data/three.db", b"3")]))
    got = {(r.archive, r.path): bytes(r.content) for r in archives.read_archive(spark, f"{beyond}/a.zip,{beyond}/b.tar", "*.db").collect()}
    assert got == {(f"{beyond}/a.zip", "data/one.db"): b"1", (f"{beyond}/b.tar", "data/three.db"): b"3"}
    assert digest_of(spark, f"{beyond}/a.zip") == digest_of(spark, str(tmp_path / "a.zip"))


def test_sqlite_on_another_file_system(spark, tmp_path, beyond):
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("PRAGMA journal_mode=WAL")
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"v{i}") for i in range(50)])
    db.close()  # the last connection writes what its log holds into the file
    with sqlite3.connect(tmp_path / "b.db") as db:
        db.execute("CREATE TABLE T (extra TEXT, id INTEGER)")
        db.execute("INSERT INTO T VALUES ('e', 7)")
    for folder in (str(tmp_path), beyond):
        rows = sqlite.read_sqlite(spark, f"{folder}/*.db", "t", rowsPerPartition="20")
        assert rows.columns[:2] == ["rowid", "source_path"] and set(rows.columns[2:]) == {"id", "v", "extra"}
        assert sorted(((int(r.id), r.v, r.extra) for r in rows.collect()), key=str) == sorted([(i, f"v{i}", None) for i in range(50)] + [(7, None, "e")], key=str)
        assert {r.source_path for r in rows.select("source_path").distinct().collect()} == {f"{folder}/a.db", f"{folder}/b.db"}


def test_mapped_files_of_an_extraction(spark, tmp_path):
    path = ufdr(tmp_path / "phone.ufdr")
    got = {r.original_path: (r.local_path, r.size, r.content and bytes(r.content)) for r in archives.extracted_files(spark, path, content=True).collect()}
    assert got == {"/sd/x.jpg": ("files/x.jpg", 6, b"pixels"), "/sd/gone.txt": ("files/gone.txt", None, None)}
    with zipfile.ZipFile(tmp_path / "empty.ufdr", "w") as z:
        z.writestr("other.txt", "x")
    with pytest.raises(Exception, match="no report.xml"):
        archives.report_lines(spark, str(tmp_path / "empty.ufdr")).collect()


# The store of cases.


def shown(store, run_id):
    return {n: df.count() for n, df in store.load(run_id).items()}


def test_one_call_for_each_kind_of_report(spark, tmp_path):
    (tmp_path / "r.xml").write_text(XML + "</report>")
    (tmp_path / "r.json").write_text(json.dumps({"report": {"messages": [{"from": "a", "content": "x"}, {"from": "a", "content": "x"}]}}))
    (tmp_path / "r.csv").write_text("from,to,content,timestamp\na,b,hello,2024-01-01 00:00:00\n")
    store = CaseStore(spark, str(tmp_path / "store"))
    for run_id, name in (("007", "r.xml"), ("1e3", "r.json"), ("a/b=c", "r.csv"), ("ü", None)):
        assert store.ingest(str(tmp_path / name) if name else ufdr(tmp_path / "p.ufdr"), run_id, "u", NOW)
    assert shown(store, "007") == {"message": 1, "call": 1, "contact": 1, "media": 0, "run": 1}
    assert shown(store, "1e3")["message"] == 2 and shown(store, "a/b=c")["message"] == 1
    assert shown(store, "ü") == {"message": 1, "call": 1, "contact": 1, "media": 2, "run": 1}
    every = store.load()
    assert {r.run_id for r in every["message"].collect()} == {"007", "1e3", "a/b=c", "ü"} and every["message"].select("id").distinct().count() == 5
    (row,) = store.runs("007").collect()
    assert (row.status, row.user_id, row.file_name, row.start_time) == ("complete", "u", "r.xml", NOW) and json.loads(row.extraction_metadata)["message"] == 1
    before = {r.id for r in store.load("007")["message"].collect()}
    assert not store.ingest(str(tmp_path / "r.xml"), "007", "u", NOW) and {r.id for r in store.load("007")["message"].collect()} == before
    with pytest.raises(ValueError, match="another file"):
        store.ingest(str(tmp_path / "r.csv"), "007", "u", NOW)
    assert store.ingest(str(tmp_path / "r.csv"), "007", "u", NOW, replace=True) and shown(store, "007") == {"message": 1, "call": 0, "contact": 0, "media": 0, "run": 1}
    assert store.sweep("007") > 0 and shown(store, "007")["message"] == 1
    with pytest.raises(ValueError, match="user"):
        store.ingest(str(tmp_path / "r.csv"), "x", "")


def test_a_failure_half_way_shows_nothing(spark, tmp_path, monkeypatch):
    (tmp_path / "r.xml").write_text(XML + "</report>")
    store, write = CaseStore(spark, str(tmp_path / "store")), CaseStore.write

    def torn(self, name, rows, attempt):
        if name == "contact":
            write(self, name, rows, attempt)
            raise OSError("disk full")
        return write(self, name, rows, attempt)

    monkeypatch.setattr(CaseStore, "write", torn)
    with pytest.raises(OSError):
        store.ingest(str(tmp_path / "r.xml"), "1", "u", NOW)
    assert shown(store, "1") == {"message": 0, "call": 0, "contact": 0, "media": 0, "run": 1} and store.load()["message"].count() == 0
    (row,) = store.runs("1").collect()
    assert row.status == "failed" and store.latest("1").first().error == "OSError: disk full"
    monkeypatch.setattr(CaseStore, "write", write)
    assert store.ingest(str(tmp_path / "r.xml"), "1", "u", NOW) and shown(store, "1")["contact"] == 1
    assert store.stored("contact").count() == 2 and store.sweep("1") > 0 and store.stored("contact").count() == 1 and shown(store, "1")["contact"] == 1


def test_the_same_file_is_parsed_once(spark, tmp_path, monkeypatch):
    (tmp_path / "r.xml").write_text(XML + "</report>")
    (tmp_path / "copy.xml").write_text(XML + "</report>")
    store, parsed, read = CaseStore(spark, str(tmp_path / "store")), [], stores.read_report
    monkeypatch.setattr(stores, "read_report", lambda *a: parsed.append(a[1]) or read(*a))
    for run_id, name in (("1", "r.xml"), ("2", "copy.xml")):
        assert store.ingest(str(tmp_path / name), run_id, "u", NOW)
    assert len(parsed) == 1 and shown(store, "1") == shown(store, "2")
    assert store.load()["message"].select("id").distinct().count() == 2


def test_two_ingests_of_one_case_at_once(spark, tmp_path):
    store = CaseStore(spark, str(tmp_path / "store"))
    entry = {"run_id": "1", "number": 0, "attempt": "a", "status": "ingesting"}
    store.say(entry)
    with pytest.raises(Exception, match="[Ee]xist"):
        store.say(entry | {"attempt": "b"})
    (tmp_path / "store/log/torn.json").write_text('{"run_id": "1", "numb')
    assert store.log().count() == 1 and store.runs().first().status == "ingesting" and store.load("1")["message"].count() == 0


def test_contents_are_kept_once(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path / "contents"))
    rows = [("a", b"same"), ("b", b"same"), ("c", b""), ("d", b"\x00\xff"), ("e", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    for case in ("1", "2/x", "1"):
        store.put(files, case)
    assert store.objects().count() == 3 and store.references().count() == 8
    assert {(r.run_id, r.original_path): r.n_references for r in store.media().collect()}["1", "a"] == 4
    store.release("2/x")
    store.put(files.where("path = 'a'"), "3")
    assert store.references().count() == 5 and store.unreferenced().count() == 0
    store.release("1")
    assert {bytes(r.content) for r in store.objects().join(store.unreferenced(), "digest", "left_semi").collect()} == {b"", b"\x00\xff"}
    assert store.collect_garbage() == 2 and store.objects().count() == 1 and store.media().first().size == 4


def test_hash_of_a_table_of_any_size(spark, monkeypatch):
    rows = [(i, f"v{i % 7}") for i in range(300)] + [(5, "same")] * 500
    tables = [spark.createDataFrame(r, "id long, v string") for r in (rows, rows[::-1], rows[:-1], [*rows[1:], (0, "other")], [])]
    for least in (10_000, 20, 1):
        monkeypatch.setattr(custody, "ROWS", least)
        found = [custody.content_hash(t.repartition(3), ["id"]) for t in tables]
        assert found[0] == found[1] and len(set(found)) == 4 and found[4] == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError, match="columns"):
        custody.content_hash(tables[0], ["other"])


# Graphs.


def comm(spark):
    rows = [("1", "message", f"m{i}", datetime(2024, 1, 1) + timedelta(hours=i) if i != 3 else None, f"+1555000000{i % 4}", f"+1555000100{i % 3}") for i in range(8)]
    rows += [("1", "message", "blank", datetime(2024, 1, 1), "", "+15550001001"), ("1", "message", "loop", datetime(2024, 1, 1), "+15550001001", "+1 555 0001001")]
    message = spark.createDataFrame([(r[0], r[2], r[4], r[5], r[3]) for r in rows], "run_id string, id string, sender string, receiver string, timestamp timestamp_ntz")
    call = spark.createDataFrame([], "run_id string, id string, caller string, receiver string, timestamp timestamp_ntz")
    contact = spark.createDataFrame([], "run_id string, number string, name string")
    return {"message": message, "call": call, "contact": contact}


def test_verdict_on_a_graph(spark):
    case = comm(spark)
    whole = graph.link_graph(case, ["1"], "k", node_limit=None, edge_limit=None)["verdict"].first()
    assert tuple(whole) == (9, None, False, None, 1)
    # the stream: blank, m0 and loop at the first hour, then m1, m2, m4 and so on; m2 would be the sixth node
    cut = graph.link_graph(case, ["1"], "k", node_limit=5, edge_limit=100)
    assert tuple(cut["verdict"].first()) == (5, None, True, "node_limit 5 reached", 1) and cut["edges"].count() == 2
    assert graph.link_graph(case, ["1"], "k", node_limit=None, edge_limit=1)["verdict"].first().reason == "edge_limit 1 reached"
    assert graph.link_graph(case, ["1"], "k", node_limit=2, edge_limit=1)["verdict"].first().reason == "node_limit 2 reached"
    with pytest.raises(ValueError, match="9 events"):
        graph.link_graph(case, ["1"], "k", event_ceiling=8)


def pairs_of(spark, pairs):
    return spark.createDataFrame(pairs, "lo string, hi string")


def test_shortest_paths(spark):
    pairs = pairs_of(spark, [("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d"), ("e", "f"), ("a", "a"), (None, "a")])
    assert [tuple(r) for r in network.shortest_path(pairs, "a", "d").orderBy("step").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert [r.node for r in network.shortest_path(pairs, "a", "a").collect()] == ["a"]
    assert network.shortest_path(pairs, "a", "f").count() == network.shortest_path(pairs, "a", "d", 2).count() == network.shortest_path(pairs, "?", "a").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_agree_with_brute_force(spark, seed):
    pick = random.Random(seed)
    names = [f"n{i:03}" for i in range(150)]
    pairs = [tuple(pick.sample(names, 2)) for _ in range(70)] + [(names[0], n) for n in names[100:130]] + list(zip(names[130:], names[131:])) + [("n005", "n005")]
    parent = {n: n for n in names}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in network.components(pairs_of(spark, pairs), spark.createDataFrame([(n,) for n in names], "node string")).collect()}
    assert got == {n: root(n) for n in names}


def test_components_of_nothing_and_rank(spark):
    assert network.components(pairs_of(spark, [])).count() == 0
    star = pairs_of(spark, [("hub", f"leaf{i}") for i in range(5)])
    rank = {r.node: r.rank for r in network.pagerank(star, 20).collect()}
    assert sum(rank.values()) == pytest.approx(1) and rank["hub"] > 3 * rank["leaf0"]
    near = {r.seed: tuple(r)[1:] for r in network.closeness(star, spark.createDataFrame([("hub",), ("leaf1",), ("none",)], "node string")).collect()}
    assert near == {"hub": (5, 5.0), "leaf1": (5, 3.0), "none": (0, 0.0)}


# Numbers.


def test_numbers_as_python_rounds_and_writes_them(spark):
    pick = random.Random(4)
    values = [0.0, -0.0, 2.25, 2.35, 2.675, -2.675, 2.5, 3.5, 0.125, 0.375, 1.005, 1e-5, 1.5e-7, 123456789.125, 1e16, 1e22, 1.7976931348623157e308, 9007199254740993.0, 0.0001, 0.00012, 12345678.9, 1e7, float("nan"), float("inf"), -float("inf"), 0.5, 1.5, 4503599627370497.5]
    values += [pick.uniform(-1000, 1000) for _ in range(500)] + [pick.randint(-10**6, 10**6) / 1000 for _ in range(500)] + [round(pick.uniform(0, 10), 3) + 0.0005 for _ in range(500)] + [pick.uniform(0, 1) * 10.0 ** pick.randint(-20, 20) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", *(numbers.python_round(F.col("v"), d).alias(f"r{d}") for d in (0, 1, 2, 3)), numbers.python_text(F.col("v")).alias("text")).collect():
        for d in (0, 1, 2, 3):
            if row.v == row.v:
                assert row[f"r{d}"] == (round(row.v, d) if abs(row.v) * 10**d < 2**52 else row.v), (row.v, d)
        assert row.text == repr(row.v)
    assert spark.range(1).select(numbers.python_round(F.lit(None).cast("double"), 2)).first()[0] is None


def test_text_read_in_the_wrong_encoding(spark):
    rows = [("cafÃ©",), ("café",), ("plain",), (None,), ("日本",), ("Ã",), ("",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(scalars.repaired_text(F.col("t"))).collect()] == ["café", "café", "plain", None, "日本", "Ã", ""]


# Search.


def test_vectors_that_are_not_finite_are_not_found(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 1.0]), (5, [0.9, 0.1]), (6, None), (7, [1.0]), (8, [0.0, 0.0]), (9, [-inf, nan])]
    vectors = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    assert [r.id for r in search.semantic_search(vectors, [1.0, 0.0], 3, 0.4).collect()] == [1, 5]
    assert {r.id: r.similarity for r in search.similarities(vectors, [1.0, 0.0]).collect()}[8] == 0.0
    with pytest.raises(ValueError, match="finite"):
        search.similarities(vectors, [nan, 0.0])


def test_a_hit_is_a_type_and_an_id(spark):
    message = spark.createDataFrame([("1", "1", "a", "b", NOW, "blue")], "run_id string, id string, sender string, receiver string, timestamp timestamp_ntz, content string")
    rows = [("1", t, "1", NOW, "x", v) for t, v in (("message", [1.0, 0.0]), ("artifact", [0.8, 0.6]))]
    vectors = spark.createDataFrame(rows, "run_id string, type string, id string, timestamp timestamp_ntz, content string, embedding array<float>")
    request = search.Request(("messages",), "hybrid", ("blue",), vector=(1.0, 0.0))
    got = {(r.type, r.method): round(r.combined, 6) for r in search.execute({"message": message}, "1", request, NOW, vectors).collect()}
    assert got == {("message", "hybrid"): 1.0, ("artifact", "semantic"): 0.48}


def test_an_index_is_read_by_the_name_of_its_case(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(c, "message", "1", [1.0]) for c in ("007", "7", "1e3", "2024-01-01", "a=b c%")], "run_id string, type string, id string, embedding array<float>")
    maintenance.reindexed(path, rows)
    for case in ("007", "7", "1e3", "2024-01-01", "a=b c%"):
        assert index.index_exists(spark, path, case) and [r.run_id for r in index.load_index(spark, path, case).collect()] == [case]
    assert index.delete_index(spark, path, "007") and not index.index_exists(spark, path, "007") and index.index_exists(spark, path, "7")


# Streams.


def test_late_rows_of_a_stream_are_counted(spark, tmp_path):
    schema, source, accounts = "run_id string, id string, kind string, ts timestamp", str(tmp_path / "in"), str(tmp_path / "accounts")

    def arrive(*rows):
        spark.createDataFrame([("1", i, "message", t) for i, t in rows], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = streaming.landing(spark, source, schema, 1)
        streaming.accounted(stream, accounts, str(tmp_path / "c1"), "1 day").trigger(availableNow=True).start().awaitTermination()

    day = datetime(2024, 1, 10, 12)
    arrive(("a", day), ("b", None))
    run()
    arrive(("c", day + timedelta(days=5)), ("d", day - timedelta(days=3)))
    run()
    arrive(("e", day), ("f", None), ("g", day + timedelta(days=4, hours=20)))
    run()
    rows = sorted(tuple(r)[:4] for r in streaming.written_accounts(spark, accounts).collect())
    # d came when the watermark was the ninth of January, e when it was the fourteenth; g's day was not over
    assert rows == [(0, 2, 1, 0), (1, 2, 0, 1), (2, 3, 1, 1)]
    assert tuple(streaming.totals(streaming.written_accounts(spark, accounts)).first()) == (3, 7, 2, 2)

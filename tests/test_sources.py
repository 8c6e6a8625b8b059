"""Sources, sinks, artifacts, scalars and search on files and rows made here."""

import io
import json
import sqlite3
import struct
import tarfile
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sleuthframe import catalog
from sleuthframe.artifacts.registry import Artifact, artifacts, register, run_artifact, run_artifacts
from sleuthframe.functions import scalars
from sleuthframe.operators import patterns, search
from sleuthframe.sinks import outputs
from sleuthframe.sources import archives, carving, reports, sqlite
from sleuthframe.streaming import events as streaming


def value(spark, column):
    return spark.range(1).select(column).first()[0]


# SQLite.


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "mmssms.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE sms (_id INTEGER PRIMARY KEY, thread_id INTEGER, address TEXT, date INTEGER, date_sent INTEGER, read INTEGER, type INTEGER, body TEXT)")
        db.executemany("INSERT INTO sms VALUES (?, 1, ?, ?, 0, ?, ?, ?)", [(1, "+1555", 1704067200000, 1, 1, "hello"), (2, None, 1704067201000, 0, 2, None), (7, "+1556", 1704067202000, 1, 9, "odd\ttext")])
        db.execute("CREATE VIEW senders AS SELECT DISTINCT address FROM sms")
        db.execute("CREATE TABLE blobs (v)")
        db.execute("INSERT INTO blobs VALUES (?)", (b"\x00\xff",))
    return path


def test_sqlite_partitions_by_rowid(spark, database):
    df = sqlite.read_sqlite(spark, database, "sms", rowsPerPartition="3")
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r.rowid, r.address, r.body) for r in df.collect()) == [(1, "+1555", "hello"), (2, None, None), (7, "+1556", "odd\ttext")]
    assert sqlite.read_sqlite(spark, database, "senders").count() == 3
    assert sqlite.read_sqlite(spark, database, "blobs").first().v == "00ff"
    assert sqlite.has_column(df, "BODY") and not sqlite.has_column(df, "other")


def test_sqlite_files_that_cannot_be_read(spark, database, tmp_path):
    (tmp_path / "broken.db").write_bytes(b"not a database at all" * 100)
    both = sqlite.read_sqlite(spark, f"{database},{tmp_path}/broken.db", "sms")
    assert both.count() == 3 and {r.source_path for r in both.collect()} == {database}
    with pytest.raises(Exception):
        sqlite.read_sqlite(spark, f"{database},{tmp_path}/broken.db", "sms", mode="FAILFAST").collect()
    assert sqlite.register_tables(spark, database, "t_") == ["t_blobs", "t_senders", "t_sms"]
    assert spark.sql("SELECT count(*) FROM t_sms a JOIN t_senders b ON a.address <=> b.address").first()[0] == 3


# Artifacts.


def test_artifact_of_a_file(spark, database, tmp_path):
    rows = run_artifact(spark, artifacts()["sms"], database).orderBy("message_id").collect()
    assert [(r.timestamp, r.read, r.direction) for r in rows] == [("2024-01-01 00:00:00", "Read", "Received"), ("2024-01-01 00:00:01", "Unread", "Sent"), ("2024-01-01 00:00:02", "Read", "9")]
    assert rows[0].service_center is None  # a column that this file's version lacks
    done = run_artifacts(spark, {"sms": database, "mms": database}, str(tmp_path / "out"))
    assert done == {"sms": "written", "mms": "written"}
    lines = spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "out/tsv/sms"))
    assert lines.count() == 3 and "odd text" in {r.body for r in lines.collect()}
    assert spark.read.parquet(str(tmp_path / "out/timeline")).where("activity = 'sms'").count() == 3


@pytest.mark.parametrize("name", sorted(artifacts()))
def test_every_artifact_runs_over_empty_tables(spark, name):
    assert run_artifact(spark, artifacts()[name], {}).count() == 0


def test_artifact_names_are_unique():
    with pytest.raises(KeyError):
        register(Artifact("sms", "messages", (), {}, "SELECT 1"))
    assert set(artifacts(["finance"])) == {"payments"}


def test_bookmark_paths(spark):
    entities = spark.createDataFrame([("root", "FOLDER", "Root"), ("sub", "FOLDER", "Sub"), ("x", "BOOKMARK", "Page"), ("y", "BOOKMARK", "Loose")], "entityId string, type string, title string")
    relations = spark.createDataFrame([("root", "sub"), ("sub", "x")], "folderId string, entityId string")
    got = {r.title: r.folder for r in run_artifact(spark, artifacts()["bookmark_folders"], {"entities": entities, "relations": relations}).collect()}
    assert got == {"Page": "Root/Sub", "Loose": None}


# Archives and reports.


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("data/app/one.db", "data/two.txt", "__MACOSX/three.db"):
            z.writestr(name, name)
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("data/four.db")
        info.size, info.mtime = 4, 1704067200
        t.addfile(info, io.BytesIO(b"four"))
    got = {r.path: r for r in archives.read_archive(spark, f"{tmp_path}/a.zip,{tmp_path}/b.tar.gz", "*/data/*.db").collect()}
    assert set(got) == {"data/app/one.db", "data/four.db"} and bytes(got["data/four.db"].content) == b"four"
    (tmp_path / "files/deep").mkdir(parents=True)
    (tmp_path / "files/deep/History").write_text("x")
    (tmp_path / "files/notes.TXT").write_text("abc")
    assert [r.path.rsplit("/", 1)[1] for r in archives.find_files(spark, str(tmp_path / "files"), "*/History").collect()] == ["History"]
    assert {tuple(r) for r in archives.file_histogram(archives.find_files(spark, str(tmp_path / "files"))).collect()} == {("", 1, 1), (".txt", 1, 3)}


def test_path_mapping(spark):
    lines = ['<file path="a/1">', '<item name="Local Path"><![CDATA[ files\\1 ]]></item>', '<file path="b" embedded="true">', '<item name="Local Path">files/2</item>', '<file path="c">', '<item name="Local Path">files/3</item>']
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "source string, line_no int, line string")
    assert [tuple(r)[1:] for r in archives.path_mapping(df).orderBy("original_path").collect()] == [("a/1", "files\\1"), ("c", "files/3")]


def test_reports(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<report><messages><message><from>a</from><to>b</to><timestamp>2024-01-01T10:00:00</timestamp><content>hi</content></message></messages><calls><call><caller>a</caller><receiver>b</receiver><duration>7</duration></call></calls><contacts><contact><name>N</name><number>1</number></contact></contacts></report>")
    (tmp_path / "r.json").write_text(json.dumps({"report": {"messages": [{"from": "a", "content": "x"}], "calls": []}}))
    (tmp_path / "top.json").write_text(json.dumps({"messages": [{"from": "a", "content": "x"}]}))
    (tmp_path / "r.csv").write_text("from,to,content,timestamp\na,b,hello,2024-01-01 00:00:00\n")
    (tmp_path / "bad.csv").write_text("who,what\na,b\n")
    xml = reports.read_report(spark, str(tmp_path / "r.xml"), "r")
    assert xml["message"].first().timestamp == datetime(2024, 1, 1, 10) and xml["call"].first().duration == 7 and xml["contact"].count() == 1
    assert [reports.read_report(spark, str(tmp_path / f), "r")["message"].count() for f in ("r.json", "top.json", "r.csv", "bad.csv")] == [1, 0, 1, 0]
    with pytest.raises(ValueError):
        reports.read_report(spark, "r.exe", "r")


def test_carving(spark):
    files = spark.createDataFrame([("a", b"\x00abcd\x01xy\x02abcd\xffefgh~"), ("b", None)], "path string, content binary")
    assert [(r.pos, r.value) for r in carving.printable_strings(files).collect()] == [(0, "abcd"), (1, "efgh~")]
    kinds = spark.createDataFrame([(b"\x89PNG\r\n\x1a\n..",), (b"PK\x03\x04..",), (b"SQLite format 3\0..",), (b"....ftypmp42",), (b"?",)], "c binary")
    assert [r[0] for r in kinds.select(carving.mime_type(F.col("c"))).collect()] == ["image/png", "application/zip", "application/x-sqlite3", "video/mp4", None]


def test_binary_xml(spark):
    def name(text):
        return struct.pack(">HH", 0xFFFF, len(text)) + text.encode()

    data = b"ABX\0" + bytes([0x10]) + bytes([0x32]) + name("map") + bytes([0x3F]) + name("id") + struct.pack(">H", 3) + b"a<b" * 0
    data = b"ABX\0" + b"\x10" + b"\x32" + name("map") + b"\x2f" + name("id") + struct.pack(">H", 3) + b"a<b" + b"\x6f" + name("n") + struct.pack(">i", 7) + b"\x33" + struct.pack(">H", 0) + b"\x11"
    df = spark.createDataFrame([(data,), (b"<plain/>",), (data[:9],), (None,)], "c binary")
    got = [r[0] for r in df.select(carving.binary_xml("c")).collect()]
    assert got[0] == '<map id="a&lt;b" n="7"></map>' and got[1] is None and got[3] is None


# Scalars.


def test_times(spark):
    assert value(spark, scalars.utc_text(scalars.epoch_seconds(F.lit(1704067200123)))) == "2024-01-01 00:00:00"
    assert value(spark, scalars.webkit_text(F.lit(13348540800000000))) == "2024-01-01 00:00:00"
    assert value(spark, scalars.cocoa_text(F.lit(725760000))) == "2024-01-01 00:00:00"
    assert str(value(spark, scalars.human_time(F.lit("2024/01/01 10:00:00.25")))) == "2024-01-01 10:00:00"
    assert value(spark, scalars.human_time(F.lit("soon"))) is None


def test_what_sqlite_does_otherwise(spark):
    assert value(spark, scalars.integer_division(F.lit(-7), 2)) == -3
    assert [value(spark, scalars.lax_number(F.lit(t))) for t in ("12abc", "x", "-1.5")] == [12.0, 0.0, -1.5]
    assert value(spark, scalars.substr(F.lit("abc|d"), 0, 4)) == "abc" and value(spark, scalars.substr(F.lit("abc|d"), 1, 4)) == "abc|"
    assert value(spark, scalars.flags(F.lit(5), [(1, "one"), (2, "two"), (4, "four")])) == "one, four"


def test_names_and_sizes(spark):
    assert value(spark, scalars.sql_name(F.lit("1 Bad-Name (x)"))) == "_1_badname_x"
    assert value(spark, scalars.slug(F.lit("/a/My Phone (1).ufdr"))) == "my_phone_1"
    short = value(spark, scalars.short_path(F.lit("p/" * 200 + "photo.jpg")))
    assert len(short) == 240 and short.endswith(".jpg") and value(spark, scalars.short_path(F.lit("a/b"))) == "a/b"
    assert [value(spark, scalars.human_size(F.lit(n))) for n in (0, 1023, 1024, 5 * 1024**2)] == ["0 B", "1023.0 B", "1.0 KB", "5.0 MB"]
    assert [value(spark, scalars.media_type(F.lit(p))) for p in ("a.JPG", "b.mp4", "c.m4a", "d.pdf", "e")] == ["image", "video", "audio", "document", "unknown"]


def test_decoders(spark):
    assert value(spark, scalars.repaired_text(F.lit("cafÃ©"))) == "café" and value(spark, scalars.repaired_text(F.lit("café"))) == "café"
    points = value(spark, scalars.polyline(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")))
    assert [(p.latitude, p.longitude) for p in points] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]


# Search and patterns.


def test_search_and_ranking(spark):
    message = spark.createDataFrame([("r", "1", "+1555", "+1556", datetime(2024, 5, 31), "Blue red"), ("r", "2", "+1557", None, None, "a blue one"), ("r", "3", None, None, None, None)], catalog.SCHEMAS["message"])
    found = search.ranked(search.search_messages(message, ["BLUE", "red"]), ["blue", "red"], ["+1555"], datetime(2024, 6, 1))
    assert {r.id: round(r.score, 4) for r in found.collect()} == {"1": round(1 + 0.4 + 0.3 + 0.1 * (1 - 1 / 365), 4), "2": 1.2}
    assert search.search_messages(message, phones=["556"]).count() == 1 and search.search_messages(message).count() == 3
    with pytest.raises(ValueError):
        search.page(message, 501, 0, F.asc("id"))


def test_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0]), (4, None), (5, [1.0]), (6, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.id for r in search.semantic_search(vectors, [3.0, 0.0], 2, 0.5).collect()] == [1, 6]
    keyword = spark.createDataFrame([(1, 0.5), (9, 1.0), (None, 1.0)], "id long, keyword_score double")
    got = {r.id: (round(r.score, 3), r.method) for r in search.hybrid(keyword, search.similarities(vectors, [1.0, 0.0]).where("similarity > 0.9")).collect()}
    assert got == {1: (0.8, "hybrid"), 6: (0.6, "semantic"), 9: (0.4, "keyword")}


def test_patterns(spark):
    rows = spark.createDataFrame([(1, "0x" + "a" * 40), (2, "mail a.b@c.de and d@e.org"), (3, None)], "id long, text string")
    assert {r.id: r.kinds for r in patterns.whole_matches(rows).collect() if r.kinds} == {1: ["ethereum"]}
    assert [r.value for r in patterns.occurrences(rows, "email", "id").collect()] == ["a.b@c.de", "d@e.org"]
    assert patterns.keyword_contexts(rows, "id", keywords=("and",), width=5).first().context == "c.de and d@e."


# Sinks and streams.


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1, 1), 1.5, 2.5, {"a": 1}, None), (datetime(2024, 1, 2), 0.0, 2.5, None, "x")], "Timestamp timestamp, Latitude double, Longitude double, `Some Data!` map<string,int>, text string")
    assert outputs.place_rows(df, "walk").count() == 1 and outputs.place_rows(df.drop("Latitude"), "walk") is None
    assert outputs.table_rows(df).columns == ["timestamp", "latitude", "longitude", "some_data", "text"]
    assert outputs.table_rows(df).first().some_data == '{"a":1}'
    assert json.loads(outputs.timeline_rows(df, "walk").first().datalist)["text"] == "None"
    files = spark.createDataFrame([("a/x.jpg", b"1"), ("b/y.jpg", b"1"), ("c/x.jpg", b"1")], "path string, content binary")
    media, references = outputs.media_references(files, "photos")
    assert media.count() == 1 and references.count() == 2
    facts = spark.createDataFrame([("d", "model", "x", "1"), ("d", "model", "x", "1"), ("d", "model", "y", "2")], "category string, label string, value string, source string")
    assert len(outputs.device_facts(facts).first().entries) == 2


def test_stream_of_events(spark, tmp_path):
    schema = "run_id string, kind string, id string, ts timestamp, a string, b string"
    for i, rows in enumerate([[("r", "call", "1", datetime(2024, 1, 1, 1)), ("r", "call", "1", datetime(2024, 1, 1, 1)), ("r", "message", "2", datetime(2024, 1, 1, 2))], [("r", "call", "9", datetime(2024, 1, 9))]]):
        spark.createDataFrame([(*r, None, None) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        volumes = streaming.daily_volumes(streaming.first_of_each(streaming.landing(spark, str(tmp_path / "in"), schema, 1)), None)
        query = volumes.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(120)
    assert sorted((r.kind, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("call", 1), ("message", 1)]

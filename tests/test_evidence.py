"""Plans, detectors, graphs, identifiers and custody on small cases with known answers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sleuthframe import catalog
from sleuthframe.functions import identifiers
from sleuthframe.operators import crosscase, custody, graph, index, maintenance, search, temporal
from sleuthframe.plans.compiler import matches, rendered, run_cited, run_plan
from sleuthframe.plans.ir import Predicate, QueryPlan, Target
from sleuthframe.plans.questions import plan_of

KEY = "a key for tests"
A, B, C, D = "+15550001000", "+15550002000", "+447700900111", "+15550004000"


def evidence(spark, **rows):
    return {t: spark.createDataFrame(rows[t], catalog.SCHEMAS[t]) if rows.get(t) else catalog.empty(spark, t) for t in catalog.SCHEMAS}


@pytest.fixture(scope="module")
def case(spark):
    return evidence(
        spark,
        message=[("r", "m1", A, B, datetime(2024, 1, 1, 12), "Let's move the Bitcoin tonight"), ("r", "m2", C, A, datetime(2024, 1, 1, 13), "lunch at noon?"), ("r", "m3", C, A, datetime(2024, 1, 3, 12), "ETH wallet ready, eth it is"), ("other", "m4", A, B, datetime(2024, 1, 1), "bitcoin elsewhere"), ("r", "m5", None, B, None, "100% sure_thing")],
        call=[("r", "c1", A, C, datetime(2024, 1, 1, 15), 42)],
        contact=[("r", "k1", "Mr Ghost", C)],
        media=[("r", "x1", "/d/voice1.amr", None, "audio/amr"), ("r", "x2", "/d/pic.jpg", None, "image/jpeg"), ("r", "x3", "/d/voice2.opus", None, None)],
    )


def ids(df):
    return [r.row_id for r in df.collect()]


def test_contains_cites_the_source_as_written(case):
    row = run_cited(QueryPlan((Target.messages,), (Predicate("text", "contains", ("bitcoin",)),)), case, "r").first()
    cite = row.citations[0]
    assert row.row_id == "m1" and cite.matched_value == "Bitcoin" and cite.snippet[cite.char_start : cite.char_end] == "Bitcoin"
    first = run_plan(QueryPlan((Target.messages,), (Predicate("text", "contains", ("eth",)),)), case, "r").first()
    assert first.row_id == "m3" and first.citations[0].char_start == 0


def test_wildcards_are_plain_text(case):
    assert ids(matches(QueryPlan((Target.messages,), (Predicate("text", "contains", ("0% s",)),)), case, "r")) == ["m5"]
    assert ids(matches(QueryPlan((Target.messages,), (Predicate("text", "contains", ("%",)),)), case, "r")) == ["m5"]
    assert ids(matches(QueryPlan((Target.messages,), (Predicate("text", "contains", ("l_nch",)),)), case, "r")) == []


def test_participants_across_tables(case):
    plan = QueryPlan((Target.messages, Target.calls, Target.contacts), (Predicate("participant", "equals", (C,)),), sort="asc")
    assert ids(run_plan(plan, case, "r")) == ["m2", "c1", "m3", "k1"]
    falling = QueryPlan(plan.targets, plan.predicates)
    assert ids(run_plan(falling, case, "r")) == ["k1", "m3", "c1", "m2"]
    paged = QueryPlan(plan.targets, plan.predicates, sort="asc", limit=2, offset=1)
    assert ids(run_plan(paged, case, "r")) == ["c1", "m3"]


def test_windows_leave_tables_without_time_alone(case):
    plan = QueryPlan((Target.messages, Target.contacts), start=datetime(2024, 1, 2), end=datetime(2024, 1, 4), sort="asc")
    assert ids(run_plan(plan, case, "r")) == ["m3", "k1"]


def test_match_all_skips_tables_that_lack_a_field(case):
    both = (Predicate("participant", "equals", (A,)), Predicate("text", "contains", ("bitcoin",)))
    assert ids(run_plan(QueryPlan((Target.messages, Target.calls), both), case, "r")) == ["m1"]
    found = ids(run_plan(QueryPlan((Target.messages, Target.calls), both, match="any"), case, "r"))
    assert set(found) == {"m1", "m2", "m3", "c1"}
    assert ids(run_plan(QueryPlan((Target.calls,), both[1:]), case, "r")) == []


def test_plans_are_checked_and_keep_their_text(case):
    plan = QueryPlan((Target.messages, Target.messages), (Predicate("text", "contains", (" it's ",)),), start=datetime(2024, 1, 1))
    assert plan.targets == (Target.messages,) and QueryPlan.from_json(plan.to_json()) == plan
    assert rendered(plan, "r") == rendered(plan, "r") and "it\\'s" in rendered(plan, "r")[0]
    for bad in (dict(targets=()), dict(targets=("messages",), limit=0), dict(targets=("messages",), start=datetime(2024, 2, 1), end=datetime(2024, 1, 1))):
        with pytest.raises(ValueError):
            QueryPlan(**bad)
    with pytest.raises(ValueError):
        Predicate("text", "contains", (" ",))
    with pytest.raises(ValueError):
        QueryPlan.from_json('{"targets": ["messages"], "sql": "drop"}')


# Time.


def events(spark, rows):
    return spark.createDataFrame([("r", kind, str(i), ts, a, b) for i, (kind, ts, a, b) in enumerate(rows)], "run_id string, kind string, id string, ts timestamp_ntz, a string, b string")


def days(start, counts, kind="message", hour=12, a="x", b="y"):
    return [(kind, start + timedelta(days=d, hours=hour), a, b) for d, n in enumerate(counts) for _ in range(n)]


def test_no_events_give_no_findings(spark):
    assert temporal.analyze(events(spark, [])).count() == 0


def test_spike(spark):
    found = temporal.spikes(events(spark, days(datetime(2024, 1, 1), [1] * 20 + [0, 30]))).collect()
    assert [(r.dates, r.severity) for r in found] == [(["2024-01-22"], "high")] and '"volume":30' in found[0].stats and len(found[0].citations) == 25


def test_late_night(spark):
    found = temporal.late_night(events(spark, days(datetime(2024, 2, 1), [1] * 10, "call", 2.5))).collect()
    assert len(found) == 1 and found[0].dates[0] == "2024-02-01" and '"late_night_events":10' in found[0].stats


def test_drop_and_dormancy(spark):
    df = events(spark, days(datetime(2024, 3, 1), [10] * 10 + [0] * 12 + [1]))
    assert [r.dates for r in temporal.drops(df).collect()] == [["2024-03-11"]]
    assert temporal.dormancy(df).count() == 0  # thirteen days are too few
    longer = events(spark, days(datetime(2024, 3, 1), [10] * 10 + [0] * 13 + [1]))
    assert [r.dates for r in temporal.dormancy(longer).collect()] == [["2024-03-10", "2024-03-24"]]


def test_bursts_are_runs_above_the_mean(spark):
    found = temporal.burst_runs(temporal.daily_series(events(spark, days(datetime(2024, 5, 1), [1, 5, 5, 5, 1, 5, 5, 1])))).collect()
    assert [(str(r["first"]), str(r["last"]), r.n_days, r.n_events) for r in found] == [("2024-05-02", "2024-05-04", 3, 15)]


def test_new_contact(spark):
    rows = days(datetime(2024, 4, 1), [1] * 5, a=A, b=B) + days(datetime(2024, 4, 11), [10], a=A, b=D)
    found = temporal.new_contacts(events(spark, rows)).collect()
    assert [(r.dates, r.stats) for r in found] == [(["2024-04-11"], f'{{"first_seen":"2024-04-11","events":10,"party":"{D}"}}')]


def test_series_fills_quiet_days_and_counts_what_has_no_time(spark):
    df = events(spark, [("message", datetime(2024, 1, 1), A, B), ("call", datetime(2024, 1, 3), A, B), ("call", None, A, B)])
    assert [(str(r.d), r.messages, r.calls) for r in temporal.daily_series(df).orderBy("d").collect()] == [("2024-01-01", 1, 0), ("2024-01-02", 0, 0), ("2024-01-03", 0, 1)]
    assert temporal.excluded(df).first()[1:] == (2, 1)


def test_reports_are_equal_on_every_run(spark):
    df = events(spark, days(datetime(2024, 5, 1), [d % 4 for d in range(15)]))
    assert temporal.analyze(df).collect() == temporal.analyze(df.repartition(3)).collect()


# Identifiers and cases.


def test_identifiers(spark):
    raw = ["+1 (555) 010-2030", "15550102030", "Foo@Bar.com", "hi", None, ""]
    got = [(r.n.value, r.n.type) if r.n else None for r in spark.createDataFrame([(v,) for v in raw], "v string").select(identifiers.normalize(F.col("v")).alias("n")).collect()]
    assert got == [("15550102030", "phone"), ("15550102030", "phone"), ("foo@bar.com", "email"), None, None, None]


def test_hashes_are_hmac(spark):
    import hashlib
    import hmac

    for key in ("short", "k" * 100):
        got = spark.range(1).select(identifiers.identifier_hash(F.lit("+1 555 010 2030"), key)).first()[0]
        assert got == hmac.new(key.encode(), b"15550102030", hashlib.sha256).hexdigest()
    for bad in ("", " ", "CHANGE_ME_please"):
        with pytest.raises(ValueError):
            identifiers.check_key(bad)


def test_cross_case_links(spark, case):
    index = crosscase.entity_index(case, KEY)
    own = {r.identifier_hash: r for r in index.where("run_id = 'r'").collect()}
    a = spark.range(1).select(identifiers.identifier_hash(F.lit(A), KEY)).first()[0]
    assert own[a].occurrence_count == 4 and own[a].first_seen == datetime(2024, 1, 1, 12) and own[a].last_seen == datetime(2024, 1, 3, 12)
    assert {(r.identifier_hash, tuple(r.other_runs), r.case_count) for r in crosscase.links(index, "r").collect()} >= {(a, ("other",), 2)}
    runs = spark.createDataFrame([("r", "u"), ("other", "v")], "run_id string, user_id string")
    nobody = spark.createDataFrame([], "run_id string, user_id string, role string")
    assert crosscase.visible_links(index, crosscase.visible_runs(runs, nobody, "u")).count() == 0
    viewer = spark.createDataFrame([("other", "u", "viewer")], nobody.schema)
    assert crosscase.visible_links(index, crosscase.visible_runs(runs, viewer, "u")).count() == 2
    assert crosscase.visible_runs(runs, viewer, "u", "owner").count() == 1
    with pytest.raises(Exception, match="unknown role"):
        crosscase.visible_runs(runs, spark.createDataFrame([("other", "u", "king")], nobody.schema), "u").collect()


# Graphs.


@pytest.fixture(scope="module")
def network(spark):
    t = datetime(2024, 1, 1)
    return evidence(spark, message=[("r", "1", "A", "B", t, ""), ("r", "2", "B", "A", t, ""), ("r", "3", "C", "D", t, "")], call=[("r", "4", "B", "C", t, 10)], contact=[("r", "5", "Bob", "B"), ("r", "6", "Al", "B")])


def test_entity_graph(network):
    nodes, edges = graph.entity_graph(network, "r")
    assert [tuple(r) for r in edges.collect()] == [("A", "B", 2), ("B", "C", 1), ("C", "D", 1)]
    assert [tuple(r) for r in nodes.collect()] == [("B", "Bob", 3), ("A", "A", 2), ("C", "C", 2), ("D", "D", 1)]


@pytest.mark.parametrize(("seed", "hops", "found"), [("B", 1, "ABC"), ("A", 3, "ABCD"), ("A", 0, "A"), ("nobody", 2, ["nobody"])])
def test_neighborhoods(network, seed, hops, found):
    assert {r.node for r in graph.neighborhood(network, "r", seed, hops).collect()} == set(found)


def test_negative_hops(network):
    with pytest.raises(ValueError):
        graph.neighborhood(network, "r", "A", -1)


P1, P2, P3, P9 = "+1 (555) 010-0001", "+15550100002", "+15550100003", "+15550100009"


@pytest.fixture(scope="module")
def cases(spark):
    return evidence(
        spark,
        message=[("a", "1", P1, P2, datetime(2024, 1, 1), ""), ("a", "2", P2, P1, datetime(2024, 1, 2), ""), ("b", "9", "", P9, datetime(2024, 1, 2), "")],
        call=[("a", "3", P2, P3, datetime(2024, 3, 1), 30), ("b", "4", P1, P9, datetime(2024, 1, 5), 12), ("b", "5", P1, P9, None, 12)],
        contact=[("a", "6", "Alice", P1)],
    )


def test_link_graph(cases):
    found = graph.link_graph(cases, ["a", "b"], KEY)
    edges, nodes = found["edges"].collect(), {r.id: r for r in found["nodes"].collect()}
    assert sorted(r.weight for r in edges) == [1, 1, 2] and all(len(r.citations) == r.weight for r in edges)
    redacted = [r for r in nodes.values() if r.redacted]
    assert len(redacted) == 1 and redacted[0].value is None and redacted[0].label is None and redacted[0].case_count == 2
    assert {r.value for r in nodes.values() if not r.redacted} == {"15550100002", "15550100003", "15550100009"}
    hmacs = {r.identifier_hash for r in crosscase.entity_index(cases, KEY).collect()}
    assert not hmacs & set(nodes)


def test_link_graph_around_a_seed(cases):
    found = graph.link_graph(cases, ["a", "b"], KEY, seed="15550100001", max_hops=1)
    nodes = {r.hops: r for r in found["nodes"].collect() if r.hops == 0}
    assert found["seed_found"] and found["nodes"].count() == 3 and found["edges"].count() == 2
    assert not nodes[0].redacted and nodes[0].label == "Alice"
    assert not graph.link_graph(cases, ["a", "b"], KEY, seed="+19999999999")["seed_found"]
    assert graph.link_graph(cases, ["a", "b"], KEY, seed="+19999999999")["nodes"].count() == 0
    alone = graph.link_graph(cases, ["a", "b"], KEY, seed=P1, max_hops=0)
    assert alone["nodes"].count() == 1 and alone["edges"].count() == 0


def test_link_graph_windows_limits_and_rights(cases):
    late = graph.link_graph(cases, ["a"], KEY, start=datetime(2024, 2, 1))
    assert [r.weight for r in late["edges"].collect()] == [1] and late["nodes"].count() == 2
    cut = graph.link_graph(cases, ["a", "b"], KEY, node_limit=2)
    assert [r.weight for r in cut["edges"].collect()] == [2]
    for args, error in ((([],), ValueError), ((["a", "b"],), PermissionError)):
        with pytest.raises(error):
            graph.link_graph(cases, *args, KEY, authorized=["a"])


# Custody and maintenance.


def test_audit_chain(spark):
    log = catalog.empty(spark, "audit_event")
    for i, payload in enumerate([None, {"b": 1, "a": "é \U0001f600 \"quoted\""}, {"n": None}]):
        log = spark.createDataFrame(custody.record(log, "query", f"2024-01-0{i + 1}T00:00:00", "r", "u", payload).collect(), log.schema)
    assert custody.verify_chain(log).first()[:3] == (True, 3, None)
    assert custody.head(log).first().seq == 3
    changed = log.withColumn("user_id", F.when(F.col("seq") == 2, "mallory").otherwise(F.col("user_id")))
    assert tuple(custody.verify_chain(changed).first()) == (False, 3, 2, "entry_hash mismatch")
    cut = log.where("seq <> 2")
    assert tuple(custody.verify_chain(cut).first()) == (False, 2, 3, "prev_hash mismatch")
    assert custody.verify_chain(log.limit(0)).first()[:2] == (True, 0)


def test_signed_graphs(cases):
    found = graph.link_graph(cases, ["a", "b"], KEY)
    one, two = (custody.signed_artifact(found["nodes"], found["edges"], KEY, h) for h in (None, "0" * 64))
    assert one["content_hash"] == two["content_hash"] and one["signature"] != two["signature"]
    assert custody.signed_artifact(found["nodes"].repartition(3), found["edges"], KEY)["signature"] == one["signature"]
    assert custody.signed_artifact(found["nodes"].where("degree > 1"), found["edges"], KEY)["content_hash"] != one["content_hash"]


def test_stores_round_trip(spark, case, tmp_path):
    path = str(tmp_path / "store")
    catalog.save(case, path)
    back = catalog.load(spark, path, "r")
    assert {n: back[n].count() for n in ("message", "call", "contact", "media", "transcript")} == {"message": 4, "call": 1, "contact": 1, "media": 3, "transcript": 0}
    assert sorted(map(str, back["message"].collect())) == sorted(map(str, case["message"].where("run_id = 'r'").collect()))
    index = crosscase.entity_index(case, KEY)
    for _ in range(2):
        maintenance.reindexed(f"{path}/index", index)
    assert spark.read.parquet(f"{path}/index").count() == index.count()


def test_deletions_and_duplicates(spark, case):
    run = spark.createDataFrame([(r, "u", "f", "complete", datetime(2024, 1, d), None, None, "same", None) for r, d in (("r", 1), ("other", 2), ("bare", 3))], catalog.SCHEMAS["run"])
    stored = case | {"run": run}
    assert [r.run_id for r in maintenance.empty_runs(stored).collect()] == ["bare"]
    assert maintenance.processed_before(stored, "same").first().run_id == "other"
    left = maintenance.without_runs(stored, run.where("run_id = 'r'"))
    assert {n: left[n].count() for n in ("message", "call", "run")} == {"message": 1, "call": 0, "run": 2}


def test_transcripts_replace_their_own_rows(case):
    once = maintenance.transcribed(case["media"], case["transcript"], lambda path: f"said in {path}")
    twice = maintenance.transcribed(case["media"], once, lambda path: "said again")
    assert {r.media_id for r in once.collect()} == {"x1", "x3"}
    assert [r.text for r in twice.collect()] == ["said again"] * 2


def test_questions_become_plans(case):
    asked = plan_of("Any WhatsApp or snap chats about bitcoin with +1 555 000 1000?")
    assert asked.targets == (Target.artifacts, Target.calls, Target.messages) and asked.match.value == "any"
    assert [(p.field.value, p.values) for p in asked.predicates] == [("app", ("whatsapp",)), ("text", ("bitcoin",)), ("participant", ("+1 555 000 1000",))]
    words = plan_of("please show messages from the noon lunch with one two three four five sixth")
    assert words.targets == (Target.messages, Target.artifacts) and words.predicates[0].values == ("noon", "lunch", "three", "four", "five", "sixth")
    assert plan_of("who rang").predicates == (Predicate("text", "contains", ("rang",)),) and plan_of("who rang").targets == (Target.calls,)
    assert plan_of("").predicates == () and plan_of("").targets == (Target.messages, Target.artifacts)
    assert ids(run_plan(plan_of("talk of lunch"), case, "r")) == ["m2"] and ids(run_plan(plan_of("bitcoin?"), case, "r")) == ["m1"]


def test_searches_in_three_modes(spark, case):
    now = datetime(2024, 2, 1)
    index = spark.createDataFrame(
        [("r", "message", "m1", datetime(2024, 1, 1, 12), "the Bitcoin", [1.0, 0.0]), ("r", "message", "m2", datetime(2024, 1, 1, 13), "lunch", [0.8, 0.6]), ("r", "message", "m3", None, None, [0.0, 1.0]), ("other", "message", "m4", None, "x", [1.0, 0.0])],
        "run_id string, type string, id string, timestamp timestamp_ntz, content string, embedding array<double>",
    )

    def found(**parts):
        return [(r.type, r.id, r.method, round(r.combined, 3)) for r in search.execute(case, "r", search.Request(**parts), now, index).collect()]

    every = ("messages", "calls", "contacts", "media", "artifacts", "device_info")
    assert found(tables=("messages",), mode="keyword", keywords=("BITCOIN", "eth")) == [("message", "m3", "keyword", 0.4), ("message", "m1", "keyword", 0.4)]
    assert found(tables=("messages",), mode="semantic", vector=(2.0, 0.0)) == [("message", "m1", "semantic", 0.6), ("message", "m2", "semantic", 0.48)]
    assert found(tables=("messages",), mode="hybrid", keywords=("bitcoin",), vector=(2.0, 0.0)) == [("message", "m1", "hybrid", 1.0), ("message", "m2", "semantic", 0.48)]
    assert found(tables=("messages",), mode="hybrid", keywords=("bitcoin",)) == [("message", "m1", "keyword", 0.4)]
    assert {t for t, *_ in found(tables=every, mode="keyword")} == {"message", "call", "contact", "media"} and len(found(tables=every, mode="keyword")) == 4 + 1 + 1 + 3
    assert len(found(tables=every, mode="keyword", limit=2)) == 2 and found(tables=("calls",), mode="keyword", offset=1) == []
    assert search.execute(case, "none", search.Request(every, "hybrid", vector=(1.0, 0.0)), now, index).count() == 0
    for wrong in ({"tables": (), "mode": "keyword"}, {"tables": ("notes",), "mode": "keyword"}, {"tables": ("calls",), "mode": "exact"}, {"tables": ("calls",), "mode": "keyword", "limit": 501}):
        with pytest.raises(ValueError):
            search.Request(**wrong)


def test_exports_are_logged(spark, monkeypatch):
    log = spark.createDataFrame([], "seq long, event_type string, run_id string, user_id string, timestamp string, payload string, prev_hash string, entry_hash string")
    nodes = spark.createDataFrame([("a", 1), ("b", 1)], "id string, degree int")
    edges = spark.createDataFrame([("a", "b", 1)], "source string, target string, weight int")
    told, artifact = custody.exported_graph(log, nodes, edges, "secret", "t", ["r"])
    entry = told.first()
    assert entry.event_type == "export" and artifact["audit_head_hash"] == entry.entry_hash and artifact["content_hash"] in entry.payload
    assert custody.verify_chain(told).first().ok

    def broken(*_):
        raise OSError("no paper")

    monkeypatch.setattr(custody, "signed_artifact", broken)
    with pytest.raises(custody.ExportFailed) as failed:
        custody.exported_graph(log, nodes, edges, "secret", "t", ["r"])
    assert [r.event_type for r in failed.value.log.orderBy("seq").collect()] == ["export", "export_failed"] and custody.verify_chain(failed.value.log).first().ok


def test_queries_are_logged():
    plan = QueryPlan((Target.messages,), (Predicate("text", "contains", ("x",)),))
    payload = custody.query_payload("who wrote x?", "rules", plan, "1", 2, ["a", "b"])
    assert payload["total"] == 2 and payload["row_ids"] == ["a", "b"] and "instr(lower(content), 'x') > 0" in payload["sql"][0] and payload["plan"]["predicates"]


def test_indexes_by_case(spark, tmp_path):
    rows = [("1", "m1", "a", None, "hello"), ("1", "m2", None, "b", None), ("a/b", "m3", "a", "b", " ")]
    message = spark.createDataFrame(rows, "run_id string, id string, sender string, receiver string, content string").withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    texts = index.message_texts(message)
    assert {r.id: r.text for r in texts.collect()} == {"m1": "From a to unknown: hello", "m2": "From unknown to b: ", "m3": "From a to b:  "}
    path = str(tmp_path / "index")
    assert not index.index_exists(spark, path, "1") and not index.delete_index(spark, path, "1")
    maintenance.reindexed(path, index.vector_index(texts, lambda t: [[len(x), 1.0] for x in t]))
    assert {r.id for r in index.load_index(spark, path, "1").collect()} == {"m1", "m2"} and [r.id for r in index.load_index(spark, path, "a/b").collect()] == ["m3"]
    assert index.delete_index(spark, path, "1") and not index.index_exists(spark, path, "1") and index.index_exists(spark, path, "a/b")
    blank = index.vector_index(texts.withColumn("text", F.lit("\t")), lambda t: [[float(x == " ")] for x in t])
    assert [r.embedding[0] for r in blank.collect()] == [1.0] * 3
    with pytest.raises(Exception, match="0 vectors of"):
        index.vector_index(texts, lambda t: []).collect()


def test_samples_are_exact(spark):
    message = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "z")], "run_id string, content string")
    call = spark.createDataFrame([("2", "c")], "run_id string, caller string")
    expected = message.where("run_id = '1'").select("content")
    maintenance.validated_sample({"message": message, "call": call}, "1", {"message": expected})
    with pytest.raises(ValueError, match="message"):  # repeated rows count
        maintenance.validated_sample({"message": message}, "1", {"message": expected.distinct()})
    with pytest.raises(ValueError, match="call"):
        maintenance.validated_sample({"message": message, "call": call}, "2", {"message": message.where("run_id = '2'").select("content")})

"""Entity graphs: weighted undirected edges, neighbourhoods, and the cited graph over several cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Evidence, comm_events
from ..functions.identifiers import check_key, display_id, hmac_sha256, normalize
from ..shared import parts_of, written

EDGE_CITATIONS = 50
#: Rows that are counted in one task, nearly all of which may be different.
PART = 250_000
#: Up to this limit the first births go through one task.
FEW = 100_000
#: Different lengths of keys that edges are looked through for.
LENGTHS = 1_000
#: Classes of pairs by hash, and events of a class from which on they are cut down before they are dealt.
CLASSES, MANY = 1 << 16, 1_000_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``, written, with equal keys together in as many parts as leave about ``PART`` rows for each (see :func:`parts_of`)."""
    rows = written(rows, "dealt")
    return rows.repartition(parts_of(rows.count(), PART), *keys)


def edges(events: DataFrame) -> DataFrame:
    """(run_id, lo, hi, weight): interactions of two parties, both directions together.

    Most pairs may be different, so none are counted before they are dealt: a task's table of pairs is of its part alone.
    """
    pairs = events.where("a is not null and b is not null").select("run_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    return dealt(pairs, "run_id", "lo", "hi").groupBy("run_id", "lo", "hi").agg(F.count("*").alias("weight"))


def labels(contact: DataFrame) -> DataFrame:
    """(run_id, node, label): of several names of a number, the last in order."""
    return contact.where("number is not null").groupBy("run_id", F.col("number").alias("node")).agg(F.max("name").alias("label"))


def degrees(edges: DataFrame) -> DataFrame:
    """(run_id, node, degree): weights of a node's edges; a loop counts twice."""
    return edges.select("run_id", F.explode(F.array("lo", "hi")).alias("node"), "weight").groupBy("run_id", "node").agg(F.sum("weight").alias("degree"))


def entity_graph(evidence: Evidence, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, label, degree) and edges (lo, hi, weight) of one case, by degree and by ends."""
    found = edges(comm_events(evidence).where(F.col("run_id") == run_id))
    named = labels(evidence["contact"].where(F.col("run_id") == run_id))
    nodes = degrees(found).join(named, ["run_id", "node"], "left").select("node", F.coalesce("label", "node").alias("label"), "degree")
    return nodes.orderBy(F.desc("degree"), "node"), found.drop("run_id").orderBy("lo", "hi")


def hops(pairs: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(node, hops): nodes within ``max_hops`` of the seeds (node) over undirected pairs (lo, hi), the seeds included.

    A frontier grows by one join a hop and never meets a node again; the lineage is cut when a hop is done.
    """
    if max_hops < 0:
        raise ValueError("max_hops must not be negative")
    both = pairs.select(F.col("lo").alias("node"), F.col("hi").alias("next")).unionByName(pairs.select(F.col("hi").alias("node"), F.col("lo").alias("next")))
    reached = seeds.select("node").distinct().withColumn("hops", F.lit(0))
    frontier = reached
    for hop in range(1, max_hops + 1):
        found = both.join(frontier.select("node"), "node", "left_semi").select(F.col("next").alias("node")).distinct()
        frontier = written(found.join(reached, "node", "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def neighborhood(evidence: Evidence, run_id: str, seed: str, max_hops: int = 2) -> DataFrame:
    """(node, hops, label, degree) around a seed, which is always there; degrees are of the whole case."""
    nodes, found = entity_graph(evidence, run_id)
    near = hops(found, found.sparkSession.range(1).select(F.lit(seed).alias("node")), max_hops)
    return near.join(nodes, "node", "left").select("node", "hops", F.coalesce("label", "node").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree")).orderBy("hops", "node")


# The graph over several cases.


def material(value: Column, run_id: Column | None = None) -> Column:
    """What an entity's hash is of (see :func:`identifiers.entity`), short and the same exactly where the hash is; null for blanks."""
    bare = F.trim(value)
    other = bare if run_id is None else F.concat(F.lit("other|"), run_id, F.lit("|"), bare)
    return F.when(F.length(bare) > 0, F.coalesce(normalize(value)["value"], other))


def public_id(found: Column, key: str) -> Column:
    return display_id(hmac_sha256(found, check_key(key)))


def with_parties(events: DataFrame) -> DataFrame:
    """Events with ``x`` and ``y``, the :func:`material` of their parties: rows are grouped by it, and only what is left is hashed."""
    return events.withColumns({"x": material(F.col("a"), F.col("run_id")), "y": material(F.col("b"), F.col("run_id"))})


def keyed_events(events: DataFrame) -> DataFrame:
    """Events with ``x`` and ``y``; blank parties and loops are left out."""
    return with_parties(events).where("x <> y")


def in_order(events: DataFrame) -> DataFrame:
    """Events with ``at``, their place in the stream: by case, messages before calls, by time and id."""
    return events.withColumn("at", F.struct("run_id", F.when(F.col("kind") == "message", 0).otherwise(1).alias("t"), "ts", "id"))


def crossing(births: DataFrame, limit: int) -> DataFrame:
    """One row (at): the first ``at`` with which the running sum of ``births`` (at, n) is more than ``limit``; none if none is.

    Every row has one birth at least, so a small limit is passed within as many rows. For a large one rows are dealt by ranges of
    ``at``, and only the range in which the sum of ranges passes the limit is summed row by row.
    """
    running = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    first = lambda rows, passed: rows.where(passed > limit).agg(F.min("at").alias("at")).where("at is not null")
    if limit < FEW:
        few = births.orderBy("at").limit(limit + 1)
        return first(few.withColumn("total", F.sum("n").over(running)), F.col("total"))
    births = written(births, "births")
    if (births.agg(F.sum("n")).first()[0] or 0) <= limit:
        return births.select("at").limit(0)
    ranged = written(births.repartitionByRange("at").withColumn("part", F.spark_partition_id()), "births")
    sums = ranged.groupBy("part").agg(F.sum("n").alias("n"))
    until = sums.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), "n")
    one = until.where((F.col("before") <= limit) & (F.col("before") + F.col("n") > limit)).first()
    own = ranged.where(F.col("part") == one.part)
    return first(own.withColumn("total", F.sum("n").over(running) + one.before), F.col("total"))


def stop_of(keyed: DataFrame, node_limit: int | None, edge_limit: int | None) -> DataFrame:
    """One row (stop, reason): the first event, in stream order, that would pass a limit of nodes or edges, nulls if none does.

    A node or edge is born with the first event that has it; births are summed in the order of events. Edges are looked at up to where
    the nodes pass their limit. A limit that is None is no limit; where an event passes both, that of nodes is the reason.
    """
    ordered = in_order(keyed)
    stops = ordered.select(F.col("at").alias("stop"), F.lit(0).alias("place"), F.lit("").alias("reason")).limit(0)

    def stopped(place: int, limit: int, name: str, births: DataFrame) -> DataFrame:
        found = crossing(births.groupBy("at").agg(F.count("*").alias("n")), limit)
        return found.select(F.col("at").alias("stop"), F.lit(place).alias("place"), F.lit(f"{name} {limit} reached").alias("reason"))

    if node_limit is not None:
        stops = written(stopped(0, node_limit, "node_limit", ordered.select("at", F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.min("at").alias("at"))), "stop")
    if edge_limit is not None:
        until = ordered.join(F.broadcast(stops.agg(F.min("stop").alias("stop")))).where("stop is null or at <= stop")
        stops = stops.unionByName(stopped(1, edge_limit, "edge_limit", until.groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.min("at").alias("at"))))
    return stops.agg(F.min("stop").alias("stop"), F.min_by("reason", F.struct("stop", "place")).alias("reason"))


def before(keyed: DataFrame, stop: DataFrame) -> DataFrame:
    """Events of the stream before the one at which it stops."""
    return in_order(keyed).join(F.broadcast(stop.select("stop"))).where("stop is null or at < stop").drop("stop", "at")


def cut_stream(keyed: DataFrame, node_limit: int | None, edge_limit: int | None) -> DataFrame:
    """Events up to the first that would pass a limit."""
    return before(keyed, stop_of(keyed, node_limit, edge_limit))


def verdict(events: DataFrame, excluded: DataFrame, stop: DataFrame | None, ceiling: int | None) -> DataFrame:
    """One row on how a graph was built: events_scanned (with the one it stopped at), event_ceiling, truncated, reason, and excluded
    (events of the cases without a time). ``events`` have times; parties that are blank or the same count as scanned.
    """
    if stop is None:
        scanned = events.agg(F.count("*").alias("events_scanned")).withColumns({"truncated": F.lit(False), "reason": F.lit(None).cast("string")})
    else:
        marked = in_order(events).join(F.broadcast(stop))
        counts = marked.agg(F.count_if(F.col("stop").isNull() | (F.col("at") <= F.col("stop"))).alias("events_scanned"))
        scanned = counts.join(F.broadcast(stop.select(F.col("reason").isNotNull().alias("truncated"), "reason")))
    left_out = excluded.agg(F.count("*").alias("excluded"))
    return scanned.join(F.broadcast(left_out)).select("events_scanned", F.lit(ceiling).cast("long").alias("event_ceiling"), "truncated", "reason", "excluded")


def link_edges(keyed: DataFrame, key: str, citations: int = EDGE_CITATIONS) -> DataFrame:
    """(source, target, weight, citations, n_citations): the first ``citations`` events of an edge in stream order, cited by case, table, row and time.

    Events are dealt once, by pairs; where only numbers are asked for, no event is dealt, but counts are. Those of pairs that have very
    many are counted apart, so that the ranking can drop what it does not cite before they are dealt.
    """
    ends = keyed.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "run_id", "kind", "id", "ts")
    w = Window.partitionBy("lo", "hi").orderBy("run_id", F.when(F.col("kind") == "message", 0).otherwise(1), F.asc_nulls_last("ts"), "id")
    cite = F.struct("run_id", F.col("kind").alias("source_table"), F.col("id").alias("row_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    weight, cited = F.count("*").alias("weight"), lambda own: F.array_sort(F.collect_list(own)).alias("citations")
    kind, first = F.pmod(F.xxhash64("lo", "hi"), F.lit(CLASSES)), F.col("rank") <= citations
    many = [r.class_ for r in ends.groupBy(kind.alias("class_")).agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("class_").collect()]
    few = ends.where(~kind.isin(many)) if many else ends
    found = few.withColumn("rank", F.row_number().over(w)).groupBy("lo", "hi").agg(weight, cited(F.when(first, cite)))
    if many:
        rest = ends.where(kind.isin(many))
        ranked = rest.withColumn("rank", F.row_number().over(w)).where(first)
        both = rest.groupBy("lo", "hi").agg(weight).join(ranked.groupBy("lo", "hi").agg(cited(cite)), ["lo", "hi"], "left")
        none = F.array().cast("array<struct<run_id:string,source_table:string,row_id:string,timestamp:string>>")
        found = found.unionByName(both.withColumn("citations", F.coalesce("citations", none)))
    found = found.select(public_id(F.col("lo"), key).alias("l"), public_id(F.col("hi"), key).alias("h"), "weight", "citations")
    return found.select(F.least("l", "h").alias("source"), F.greatest("l", "h").alias("target"), "weight", "citations", F.least("weight", F.lit(citations)).alias("n_citations"))


def link_nodes(keyed: DataFrame, contact: DataFrame, key: str, seed: str | None = None) -> DataFrame:
    """(node, id, type, redacted, degree, cases, case_count, value, label): what two cases or more share is redacted unless it is the seed.

    ``node`` and ``seed`` are :func:`material`; the degree is the number of events, which is the sum of the weights of the node's edges.
    """
    ends = keyed.select("run_id", F.explode(F.array(F.struct(F.col("x").alias("node"), F.col("a").alias("party")), F.struct(F.col("y").alias("node"), F.col("b").alias("party")))).alias("n"))
    parties = ends.groupBy("run_id", "n.node", "n.party").agg(F.count("*").alias("n"))
    known = F.coalesce(normalize(F.col("party")), F.struct(F.trim("party").alias("value"), F.lit("other").alias("type")))
    nodes = parties.withColumn("e", known).groupBy("node").agg(F.min("e.type").alias("type"), F.min("e.value").alias("value"), F.array_sort(F.collect_set("run_id")).alias("cases"), F.sum("n").alias("degree"))
    names = contact.withColumn("node", material(F.col("number"))).where("node is not null and name is not null").groupBy("node").agg(F.max_by("name", F.struct("run_id", "name")).alias("name"))
    found = nodes.join(names, "node", "left").withColumn("case_count", F.size("cases"))
    redacted = (F.col("case_count") >= 2) & ~(F.col("node") == F.lit(seed or ""))
    return found.select("node", public_id(F.col("node"), key).alias("id"), "type", redacted.alias("redacted"), "degree", "cases", "case_count", F.when(~redacted, F.col("value")).alias("value"), F.when(~redacted, F.coalesce("name", "value")).alias("label"))


def link_graph(evidence: Evidence, run_ids: list[str], key: str, seed: str | None = None, max_hops: int = 2, start=None, end=None, node_limit: int | None = 500, edge_limit: int | None = 2000, authorized: list[str] | None = None, event_ceiling: int | None = None, ordered: bool = True) -> dict[str, DataFrame | bool]:
    """nodes, edges, verdict (see :func:`verdict`), and whether the seed was found, over some cases; parts that lie outside the window
    of time are left out.

    Nodes and edges come in order unless ``ordered`` is false. A limit that is None is no limit. Cases that are not ``authorized`` raise, and so does a graph of more events than ``event_ceiling``.
    """
    if not run_ids:
        raise ValueError("no cases given")
    if start is not None and end is not None and start > end:
        raise ValueError("the window of time is reversed")
    if authorized is not None and (extra := set(run_ids) - set(authorized)):
        raise PermissionError(f"not authorized for {sorted(extra)}")
    every = comm_events(evidence).where(F.col("run_id").isin(sorted(set(run_ids))))
    events = every.where(F.col("ts").isNotNull())
    if start is not None:
        events = events.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        events = events.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    # nodes, edges, hops and limits all read what is written here; hashes are made of what they leave
    keyed = written(keyed_events(events), "keyed")
    wanted, near, seed_found = None, None, True
    if seed is not None:
        wanted = keyed.sparkSession.range(1).select(material(F.lit(seed))).first()[0]
        pairs = keyed.select(F.col("x").alias("lo"), F.col("y").alias("hi"))
        seeds = written(pairs.select(F.explode(F.array("lo", "hi")).alias("node")).where(F.col("node") == F.lit(wanted)).distinct(), "seeds")
        seed_found = not seeds.isEmpty()
        near = written(hops(pairs, seeds, max_hops), "near")  # its size is known then, so a small one is broadcast
        for side in ("x", "y"):
            keyed = keyed.join(near.select(F.col("node").alias(f"{side}_near")), F.col(side) == F.col(f"{side}_near"), "left_semi")
        if max_hops == 0:
            keyed = keyed.limit(0)
        keyed = events = written(keyed, "near-events")
    stop = None
    if node_limit is not None or edge_limit is not None:
        stop = written(stop_of(keyed, node_limit, edge_limit), "stop")
        keyed = before(keyed, stop)
    judged = verdict(events, every.where(F.col("ts").isNull()), stop, event_ceiling)
    if event_ceiling is not None and (scanned := judged.first().events_scanned) > event_ceiling:
        raise ValueError(f"the graph has {scanned} events, more than {event_ceiling}: narrow the window of time or give a seed")
    found = link_edges(keyed, key)
    nodes = link_nodes(keyed, evidence["contact"].where(F.col("run_id").isin(sorted(set(run_ids)))), key, wanted)
    if near is not None:
        nodes = near.join(nodes.drop("id"), "node", "left").select(public_id(F.col("node"), key).alias("id"), "hops", *[c for c in nodes.columns if c not in ("node", "id")])
    nodes = nodes.drop("node")
    if ordered:
        nodes, found = nodes.orderBy(F.desc("degree"), "id"), found.orderBy("source", "target")
    return {"nodes": nodes, "edges": found, "verdict": judged, "seed_found": seed_found}


def property_graph(evidence: Evidence) -> tuple[DataFrame, DataFrame]:
    """Typed nodes (label, key, run_id) and relations (type, source, target) of an external property graph."""
    events = comm_events(evidence)
    people = events.select("run_id", F.explode(F.array("a", "b")).alias("key")).where("key is not null").distinct().select(F.lit("Person").alias("label"), "key", "run_id")
    rows = [evidence[t].select(F.lit(t.capitalize()).alias("label"), F.col("id").alias("key"), "run_id") for t in ("message", "call", "contact", "media", "artifact") if t in evidence]
    nodes = people
    for r in rows:
        nodes = nodes.unionByName(r)
    # both relations of an event in one pass
    sent = F.struct(F.when(F.col("kind") == "message", "SENT").otherwise("CALLED").alias("type"), F.col("a").alias("source"), F.col("id").alias("target"))
    to = F.struct(F.lit("TO").alias("type"), F.col("id").alias("source"), F.col("b").alias("target"))
    parts = F.array_compact(F.array(F.when(F.col("a").isNotNull(), sent), F.when(F.col("b").isNotNull(), to)))
    of_events = events.select(F.explode(parts).alias("r")).select("r.*")
    contains = nodes.where("label <> 'Person'").select(F.lit("CONTAINS").alias("type"), F.col("run_id").alias("source"), F.col("key").alias("target"))
    return nodes, of_events.unionByName(contains)


def type_counts(nodes: DataFrame, column: str = "label") -> DataFrame:
    """(type, n) of the nodes of a graph."""
    return nodes.groupBy(F.col(column).alias("type")).agg(F.count("*").alias("n"))


def normalized_degrees(degrees: DataFrame) -> DataFrame:
    """``degrees`` (run_id, node, degree) with share: per cent of the greatest degree of the case."""
    degrees = written(degrees, "degrees")
    # its size is known then, so that of few cases is broadcast and no case is brought to one task
    most = written(degrees.groupBy("run_id").agg(F.max("degree").alias("most")), "most")
    return degrees.join(most, "run_id").select("run_id", "node", "degree", (F.col("degree") * 100 / F.col("most")).alias("share"))


def of_types(nodes: DataFrame, edges: DataFrame, types: list[str], column: str = "label", key: str = "key") -> tuple[DataFrame, DataFrame]:
    """The nodes of some types, and the edges (source, target) that have such a node at either end."""
    kept = nodes.where(F.col(column).isin(types))
    ids = kept.select(F.col(key).alias("end_")).distinct()
    # an end as long as no such node's key is none of them: most edges are left out before they are dealt
    lengths = written(ids.groupBy(F.octet_length("end_").alias("length_")).agg(F.count("*").alias("n_")), "lengths")
    sizes = [r.length_ for r in lengths.orderBy("length_").limit(LENGTHS + 1).collect() if r.length_ is not None]
    found = edges if len(sizes) > LENGTHS else edges.where(F.octet_length("source").isin(sizes) | F.octet_length("target").isin(sizes))
    for end in ("source", "target"):
        found = found.join(ids.withColumn(f"{end}_kept_", F.lit(True)), F.col(end) == F.col("end_"), "left").drop("end_")
    return kept, found.where("source_kept_ or target_kept_").select(*edges.columns)

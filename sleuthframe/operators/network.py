"""Paths, components and rank in undirected graphs given as pairs (lo, hi); what one round finds is written before the next reads it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Written, written

#: Nodes that a task holds at once.
PAIRS = 500_000


def both_ways(pairs: DataFrame) -> DataFrame:
    """(node, next) in both directions, loops and nulls left out, each once."""
    kept = pairs.where("lo is not null and hi is not null and lo <> hi")
    return kept.select(F.col("lo").alias("node"), F.col("hi").alias("next")).unionByName(kept.select(F.col("hi").alias("node"), F.col("lo").alias("next"))).distinct()


def shortest_path(pairs: DataFrame, source: str, target: str, max_hops: int = 6) -> DataFrame:
    """(step, node) of a shortest path of up to ``max_hops``; of several that whose nodes come first; no rows if there is none.

    A frontier carries how it was reached (at most ``max_hops`` names a node), meets the edges by one join a hop and leaves out
    whom an earlier hop has found. The search ends at the target, or when nobody is new.
    """
    if max_hops < 0:
        raise ValueError("max_hops must not be negative")
    spark = pairs.sparkSession
    edges = written(both_ways(pairs), "edges")
    frontier = edges.where(F.col("node") == source).select("node").limit(1).select("node", F.array("node").alias("way"))
    reached, found = frontier.select("node"), None if source != target else frontier
    for _ in range(max_hops):
        if found is not None:
            break
        near = edges.join(frontier, "node").select(F.col("next").alias("node"), F.concat("way", F.array("next")).alias("way"))
        frontier = written(near.groupBy("node").agg(F.min("way").alias("way")).join(reached, "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        if not (hit := frontier.where(F.col("node") == target)).isEmpty():
            found = hit
        reached = reached.unionByName(frontier.select("node"))
    if found is None:
        return spark.createDataFrame([], "step int, node string")
    return found.select(F.posexplode("way").alias("step", "node"))


def contracted(pairs: DataFrame) -> DataFrame:
    """(node, next): stars that hold together what the pairs of a task do, up to ``PAIRS`` at once; ``next`` is the least of its star."""
    kind = pairs.schema["lo"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def stars() -> Iterator[pa.RecordBatch]:
            nodes = [(x, r) for x in up if (r := root(x)) != x]
            up.clear()
            for k in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_pylist([{"node": x, "next": r} for x, r in nodes[k : k + 100_000]])

        for batch in batches:
            for a, b in zip(batch["lo"].to_pylist(), batch["hi"].to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > PAIRS:
                yield from stars()
        yield from stars()

    return pairs.select("lo", "hi").where("lo is not null and hi is not null and lo <> hi").mapInArrow(run, f"node {kind.simpleString()}, next {kind.simpleString()}")


def components(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node that can be reached, for all nodes of the pairs and of ``nodes`` (node).

    Every task first brings its own pairs down to stars. Then rounds of two steps: every node tells its greater neighbours, then its smaller ones, of the least it knows. Pairs shrink to
    stars, in a number of rounds that grows with the logarithm of the graph; a node with many neighbours gets one minimum, computed
    where its edges lie, and never a list of them.
    """
    known = Written(contracted(pairs), "stars")
    while True:
        before = known.table.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("node", "next")), F.lit(0))).first()
        ways = known.table.unionByName(known.table.select(F.col("next").alias("node"), F.col("node").alias("next")))
        least = ways.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("m"))
        large = Written(ways.where("next > node").join(least, "node").select(F.col("next").alias("node"), F.col("m").alias("next")).distinct(), "stars")
        known.discard()
        least = large.table.groupBy("node").agg(F.min("next").alias("m"))
        small = large.table.join(least, "node").where("next <> m").select(F.col("next").alias("node"), F.col("m").alias("next"))
        known = Written(small.unionByName(least.select("node", F.col("m").alias("next"))).distinct(), "stars")
        large.discard()
        if known.table.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("node", "next")), F.lit(0))).first() == before:
            break
    every = pairs.select(F.explode(F.array("lo", "hi")).alias("node")).where("node is not null")
    every = (every if nodes is None else every.unionByName(nodes.select("node"))).distinct()
    return every.join(known.table, "node", "left").select("node", F.coalesce("next", "node").alias("component"))


def pagerank(pairs: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank): how central a node is by its neighbours' ranks, each shared among its own neighbours; ranks sum to 1."""
    edges = both_ways(pairs)
    degree = edges.groupBy("node").agg(F.count("*").alias("degree"))
    edges = written(edges.join(degree, "node"), "edges")
    nodes = written(degree, "nodes")
    n = nodes.count()
    rank = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(rounds):
        # shares are added up where the edges lie before they are dealt
        shares = edges.join(rank, "node").groupBy(F.col("next").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        rank = written(shares.select("node", ((1 - damping) / n + damping * F.col("got")).alias("rank")), "rank")
    return rank


def closeness(pairs: DataFrame, seeds: DataFrame, max_hops: int = 4) -> DataFrame:
    """(seed, reached, closeness): how many nodes each seed (node) reaches within ``max_hops``, and the sum of 1 / distance over them."""
    edges = written(both_ways(pairs), "edges")
    frontier = seeds.select(F.col("node").alias("seed"), "node").distinct()
    reached = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, max_hops + 1):
        near = edges.join(frontier, "node").select("seed", F.col("next").alias("node")).distinct()
        frontier = written(near.join(reached.select("seed", "node"), ["seed", "node"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier.withColumn("hops", F.lit(hop)))
    score = F.coalesce(F.sum(F.when(F.col("hops") > 0, 1 / F.col("hops"))), F.lit(0.0))
    return reached.groupBy("seed").agg(F.count_if(F.col("hops") > 0).alias("reached"), score.alias("closeness"))

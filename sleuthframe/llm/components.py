"""Connected components of a graph given as an edge table.

Rounds of two contractions: within each partition, a union-find turns the edges into stars around the least node; then, over
the whole graph, every node moves to its least neighbour and edges follow. The rounds end when no edge is left, and the moves,
composed, give each node the least node of its component. Nothing but a row for each node and edge is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, materialize

#: Edges for which a round has a partition, up to spark.sql.shuffle.partitions: a small graph is not dealt into many tiny files.
SHARE = 50_000


def stars(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """The least node of its component for every node of ``pairs``."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    return {x: root(x) for x in list(parent)}


def contracted_within_partitions(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = stars(pair for b in batches for pair in zip(b.column("src").to_pylist(), b.column("dst").to_pylist()))
        rows = [(x, top) for x, top in found.items() if x != top]
        for k in range(0, len(rows), 100_000):
            part = rows[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([t for _, t in part], pa.int64())], names=["src", "dst"])

    return edges.mapInArrow(run, "src long, dst long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst as longs; loops are left out); component is its least node."""
    ends = (F.greatest("src", "dst"), F.least("src", "dst"))
    normal = edges.where("src <> dst").select(ends[0].alias("src"), ends[1].alias("dst")).distinct()
    moves: list[DataFrame] = []
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = materialize(contracted_within_partitions(normal), "edges")
    while n := left.count():
        shares = min(most, math.ceil(n / SHARE))
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).repartition(shares, "src")
        move = materialize(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("to")).select(F.col("src").alias("node"), "to"), "moves")
        moves.append(move)
        source, target = move.toDF("src", "a"), move.toDF("dst", "b")
        moved = left.join(source, "src").join(target, "dst").where("a <> b").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).repartition(shares, "src", "dst").distinct()
        before, left = left, materialize(contracted_within_partitions(moved), "edges")
        discard(before)
    if not moves:
        return normal.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    labels = moves[-1]
    for move in reversed(moves[:-1]):
        labels = move.join(labels.toDF("to", "next"), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    return labels.withColumnRenamed("to", "component")

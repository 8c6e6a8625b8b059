"""Hard negatives by a distributed kNN join over Voronoi cells.

The largest inner product becomes the nearest neighbour: a row x gets one more coordinate, sqrt(M - |x|^2) with M the largest squared
length, an anchor gets 0, so that |a - x|^2 = |a|^2 + M - 2<a, x>. Rows are assigned to the nearest of some pivots; a cell is dealt
in chunks of about ``CHUNK`` rows, so one that holds a third of all rows is many tasks. Anchors of neighbouring cells form teams of about
``TEAM``. The distances between pivots and a team's centre, its radius and the least score that its anchors still want bound how far
from its pivot a row of a cell must lie to matter. Rows beyond the bound are replicated to the team, where exact scores decide.

The join runs twice: among rows of one label for the positives of each anchor, then among all rows for the negatives, whose scores have
to fall between bounds that the positives give. Least scores come from these bounds and from a sample of rows, which are rows like
others: what is among the best of the sample can only be bettered.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import materialize

#: Rows in a chunk of a cell, anchors in a team, rows of the sample, pivots at most (sample and pivots bound what is broadcast).
CHUNK, TEAM, SAMPLE, PIVOTS = 4_096, 1_024, 4_096, 1_024
POSITIVES, NEGATIVES = 5, 10
#: Bounds on distances are loosened by this share, so that rounding excludes nothing.
SLACK = 1e-9
#: Whole numbers are exact in double precision up to here; beyond, Python's numbers are used.
EXACT = 2.0**53

PAIR = [("anchor_id", pa.int64()), ("other", pa.int64()), ("score", pa.int64())]
TRIPLE = [("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())]
#: What forming teams returns: anchors (with v) and bounds (with cell) of teams.
TEAMS = [("part", pa.int64()), ("team", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64())), ("cell", pa.int32()), ("beyond", pa.float64())]


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and v (whole numbers) of the rows that take part, one for each vec_id."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    one = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.cast("long").alias("label"), v.alias("v")).alias("x")).groupBy("vec_id").agg(F.min("x").alias("x"))
    return one.select("vec_id", "x.label", "x.v")


def matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, width))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact."""
    if len(a) and len(b) and np.sqrt((a * a).sum(1).max()) * np.sqrt((b * b).sum(1).max()) >= EXACT:
        return np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a], dtype=object).reshape(len(a), len(b))
    return a @ b.T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


class Index:
    """Pivots and sample, both of bounded size, and what is known of each cell."""

    def __init__(self, rows: DataFrame, width: int, chunk: int, team: int):
        length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        n, longest = rows.agg(F.count("*"), F.max(length)).first()
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
        self.width, self.chunk, self.team, self.longest = width, chunk, team, longest or 0.0
        self.ids, self.labels, self.vectors = sample["vec_id"].to_numpy(), sample["label"].to_numpy(), matrix(sample["v"], width)
        self.pivots = self.lifted(self.vectors[: min(PIVOTS, max(1, int(n**0.5 / 8)))])

    def learn(self, placed: DataFrame) -> None:
        """Chunks and radius of each cell; stretches of cells, each the nearest one left, that hold about a team of anchors."""
        n = len(self.pivots)
        self.chunks, self.radius, anchors = np.ones(n, int), np.full(n, -np.inf), np.zeros(n, int)
        for cell, rows, far, own in placed.groupBy("cell").agg(F.count("*"), F.max("far"), F.count_if(is_anchor())).collect():
            self.chunks[cell], self.radius[cell], anchors[cell] = -(-rows // self.chunk), far, own
        between, left, at = distances(self.pivots, self.pivots), set(range(n)), 0
        self.stretch, self.slices, held = np.zeros(n, int), [], 0
        while left:
            left.remove(at)
            if not self.slices or held and held + anchors[at] > self.team:
                self.slices.append(1)
                held = 0
            held += anchors[at]
            self.stretch[at] = len(self.slices) - 1
            self.slices[-1] = max(1, -(-held // self.team))
            if left:
                at = min(left, key=lambda k: (between[at][k], k))

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        return np.hstack([rows, np.sqrt(np.maximum(self.longest - (rows * rows).sum(1), 0))[:, None]])

    def reach(self, anchors: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The distance of an anchor to a row of such a score; infinite for a score of -inf."""
        known = np.isfinite(scores)
        return np.where(known, np.sqrt(np.maximum((anchors * anchors).sum(1) + self.longest - 2 * np.where(known, scores, 0), 0)), np.inf)


def is_anchor() -> Column:
    return F.col("vec_id") % 100 == 0


def assign(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Each row's cell and its distance to the cell's pivot."""
    index = shared.value
    for batch in batches:
        near = distances(index.lifted(matrix(batch["v"].to_pandas(), index.width)), index.pivots)
        cell = near.argmin(1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(near[np.arange(len(near)), cell])], [*batch.schema.names, "cell", "far"])


def wanted_positives(anchors: pd.DataFrame, v: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """The least score that can still be among an anchor's positives, from the sample's other rows of its label, and no greatest."""
    low, scores = np.full(len(anchors), -np.inf), products(v, index.vectors).astype(float)
    for i, (vec, label) in enumerate(zip(anchors["vec_id"], anchors["label"])):
        found = scores[i][(index.labels == label) & (index.ids != vec)]
        if len(found) >= POSITIVES:
            low[i] = np.partition(found, -POSITIVES)[-POSITIVES]
    return low, np.full(len(anchors), np.inf)


def wanted_negatives(anchors: pd.DataFrame, v: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that one of the anchor's negatives can have; the least above the greatest if there is none."""
    low, high = np.full(len(anchors), np.inf), np.full(len(anchors), -np.inf)
    scores = products(v, index.vectors).astype(float)
    for i, (label, positives) in enumerate(zip(anchors["label"], anchors["scores"])):
        others = scores[i][index.labels != label]
        for p in positives:
            if p >= 0:
                inside = others[(100 * others <= 90 * p) & (100 * others >= 30 * p)]
                least = np.partition(inside, -NEGATIVES)[-NEGATIVES] if len(inside) >= NEGATIVES else 0.3 * p
                low[i], high[i] = min(low[i], least), max(high[i], 0.9 * p)
    return low, high


def form_team(table: pa.Table, shared: Broadcast, wanted: Callable) -> pa.Table:
    """A team's anchors and, for each cell that can serve it, the distance from the pivot from which on rows count."""
    index, anchors = shared.value, table.to_pandas().sort_values("vec_id", ignore_index=True)
    part, team, out = table["part"][0].as_py(), table["team"][0].as_py(), []
    v = matrix(anchors["v"], index.width)
    low, high = wanted(anchors, v, index)
    asks = low <= high
    anchors, v, low, high = anchors[asks], v[asks], low[asks], high[asks]
    if len(anchors):
        flat = np.hstack([v, np.zeros((len(v), 1))])
        centre = flat.mean(0, keepdims=True)
        radius, between = distances(flat, centre).max(), distances(centre, index.pivots)[0]
        nearest = 0.0 if np.isinf(high).any() else index.reach(v, high).min()
        beyond = np.maximum(between - radius - index.reach(v, low).max(), nearest - between - radius)
        beyond -= SLACK * (1 + between + radius + nearest + np.sqrt(index.longest))
        out += [(part, team, a.vec_id, a.label, x, a.ids, a.scores, None, None) for a, x in zip(anchors.itertuples(), v)]
        out += [(part, team, None, None, None, None, None, int(cell), beyond[cell]) for cell in np.flatnonzero(index.radius >= beyond)]
    return table_of(out, TEAMS)


def table_of(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


def local_positives(left: pa.Table, right: pa.Table, width: int) -> pa.Table:
    """The best rows of each anchor in a chunk."""
    rows, anchors, out = left.to_pandas(), right.to_pandas(), []
    if len(rows) and len(anchors):
        ids, scores = rows["vec_id"].to_numpy(), products(matrix(anchors["v"], width), matrix(rows["v"], width))
        for a, own in zip(anchors["vec_id"], scores):
            out += [(a, ids[k], int(own[k])) for k in best_first(own, ids)[: POSITIVES + 1] if ids[k] != a]
    return table_of(out, PAIR)


def local_negatives(left: pa.Table, right: pa.Table, width: int) -> pa.Table:
    """The best rows of another label in the window of each anchor and positive in a chunk."""
    rows, anchors, out = left.to_pandas(), right.to_pandas(), []
    if len(rows) and len(anchors):
        ids, labels, scores = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), products(matrix(anchors["v"], width), matrix(rows["v"], width))
        for a, own in zip(anchors.itertuples(), scores):
            other = np.flatnonzero(labels != a.label)
            order = other[best_first(own[other], ids[other])]
            falling = -100 * own[order]
            for positive, p in zip(a.ids.tolist(), a.scores.tolist()):
                at = int(np.searchsorted(falling, -90 * p))
                out += [(a.vec_id, positive, p, ids[k], int(own[k])) for k in order[at : at + NEGATIVES] if 100 * int(own[k]) >= 30 * p]
    return table_of(out, TRIPLE)


def best_first(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places by falling score, equal ones by vec_id."""
    return np.array(sorted(range(len(ids)), key=lambda k: (-scores[k], ids[k])), int) if scores.dtype == object else np.lexsort((ids, -scores))


def ddl(schema: list[tuple[str, pa.DataType]]) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.list_(pa.int64()): "array<long>", pa.list_(pa.float64()): "array<double>"}
    return ", ".join(f"{n} {names[t]}" for n, t in schema)


def of_cell(values: list[int]) -> Column:
    """The value of the row's cell, from a list of one for each cell."""
    return F.element_at(F.array(*map(F.lit, map(int, values))), F.col("cell") + 1)


def knn_join(rows: DataFrame, anchors: DataFrame, index: Index, shared: Broadcast, wanted: Callable, local: Callable, result: list) -> DataFrame:
    """``local`` over the anchors of each team and each chunk of rows that can serve it; only rows and anchors of one part meet."""
    slices = of_cell([index.slices[s] for s in index.stretch])
    team = of_cell(index.stretch) * F.lit(1 << 20) + F.pmod(F.xxhash64("vec_id"), slices)
    teams = anchors.withColumn("team", team.cast("long")).groupBy("part", "team").applyInArrow(lambda own: form_team(own, shared, wanted), ddl(TEAMS))
    teams = materialize(teams, "teams")
    bounds = teams.where("cell is not null").select("part", "team", "cell", "beyond", F.explode(F.sequence(F.lit(0), of_cell(index.chunks) - 1)).alias("chunk"))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), of_cell(index.chunks)).cast("int"))
    key, width = ["part", "team", "cell", "chunk"], index.width
    sent = dealt.join(bounds, ["part", "cell", "chunk"]).where("far >= beyond").select(*key, "vec_id", "label", "v")
    asking = teams.where("v is not null").select("part", "team", "vec_id", "label", "v", "ids", "scores").join(bounds.select(*key), ["part", "team"])
    asking = asking.toDF(*asking.columns)  # both sides come from the same tables; new names keep them apart
    return sent.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(lambda left, right: local(left, right, width), ddl(result))


def mine_width(rows: DataFrame, width: int, chunk: int, team: int) -> DataFrame:
    """Negatives among rows of one width."""
    context = rows.sparkSession.sparkContext
    index = Index(rows, width, chunk, team)
    first = context.broadcast(index)
    placed = materialize(rows.mapInArrow(functools.partial(assign, shared=first), "vec_id long, label long, v array<double>, cell int, far double"), "cells")
    index.learn(placed)
    shared = context.broadcast(index)
    none = F.lit(None).cast("array<long>")
    anchors = placed.where(is_anchor()).drop("far")
    pairs = knn_join(placed.withColumn("part", F.col("label")), anchors.withColumns({"part": F.col("label"), "ids": none, "scores": none}), index, shared, wanted_positives, local_positives, PAIR)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other"))
    best = pairs.withColumn("place", place).where(F.col("place") <= POSITIVES)
    best = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("place", "other", "score"))).alias("found"))
    positives = best.select("vec_id", F.col("found.other").alias("ids"), F.col("found.score").alias("scores"))
    everything = F.lit(0).cast("long")
    asking = materialize(anchors.join(positives, "vec_id").withColumn("part", everything), "positives")
    found = knn_join(placed.withColumn("part", everything), asking, index, shared, wanted_negatives, local_negatives, TRIPLE)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(embeddings: DataFrame, chunk: int = CHUNK, team: int = TEAM) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for every anchor of ``embeddings``
    (vec_id, embedding, label) and each of its positives.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Of rows that share a vec_id the
    one with the least label, then the least vector, counts. Vectors of different lengths don't meet. Scores beyond the range of
    long are an error. Anchors without positives or negatives give no rows, nor does an empty table; other columns are not read.
    """
    rows = materialize(prepared(embeddings.select("vec_id", "embedding", "label")), "vectors")
    widths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    found = [mine_width(rows.where(F.size("v") == w), w, chunk, team) for w in widths]
    return functools.reduce(DataFrame.unionByName, found) if found else nothing(rows.sparkSession)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


ORACLE = f"""
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS other, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM whole a, whole r WHERE a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id AND len(a.v) = len(r.v)
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= {NEGATIVES}
"""

"""Near-duplicate vectors by product quantisation.

Unit vectors are put in coarse inverted lists, and their residuals are coded by subspace. A vector probes the lists whose
border with its own is near enough that a linked vector may lie beyond it; in each it meets the members by asymmetric
table-lookup distances, and what the code error of a member can't rule out is compared by exact cosine. Equal vectors are one
class that enters once with its size. A list is cut into blocks of members and of probing vectors, each pair of blocks being
a task of bounded size that returns numbers of links and a spanning forest, never pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, stars
from .tables import materialize

#: Vectors that the index is fitted on at most, taken by hash.
SAMPLE = 20_000
LIST_SIZE = 200
SUBSPACES = 8
MEMBER_BLOCK, PROBER_BLOCK = 2_048, 4_096
#: A linked vector is at most sqrt(2 - 2 * threshold) away, and its way across a border is random: about 0.056 for 64
#: dimensions and threshold 0.9. Lists whose border is within BORDER of these deviations are probed, and LEAST_PROBES at least.
#: A pair is found from either side, so it is missed only if its way is longer than twice that: three deviations.
BORDER = 1.5
LEAST_PROBES = 4
#: More than two ways to sum a cosine can differ by.
ROUNDING = 1e-9


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T, 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Quantiser:
    """Coarse centres and a code book for each subspace, fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.dim = sample.shape[1]
        self.centres = k_means(sample, min(lists, len(sample)))
        residuals = sample - self.centres[nearest(sample, self.centres)]
        bounds = np.linspace(0, self.dim, min(SUBSPACES, self.dim) + 1).astype(int)
        self.parts = list(zip(bounds[:-1], bounds[1:]))
        self.books = [k_means(residuals[:, a:b], min(256, len(sample))) for a, b in self.parts]
        self.between = np.sqrt(squared(self.centres, self.centres))

    def index(self, unit: np.ndarray, border: float) -> tuple[np.ndarray, list[list[int]], np.ndarray, np.ndarray]:
        """List, lists to probe, codes and code error of each vector."""
        d = squared(unit, self.centres)
        home = d.argmin(1)
        gap = (d - d[np.arange(len(d)), home][:, None]) / np.maximum(2 * self.between[home], 1e-9)
        probed = gap <= border
        few = np.argpartition(d, min(LEAST_PROBES, d.shape[1]) - 1, axis=1)[:, :LEAST_PROBES]
        np.put_along_axis(probed, few, True, axis=1)
        residuals = unit - self.centres[home]
        codes = np.stack([nearest(residuals[:, a:b], book) for (a, b), book in zip(self.parts, self.books)], axis=1).astype(np.uint8)
        decoded = np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)
        return home, [np.flatnonzero(p).tolist() for p in probed], codes, np.sqrt(((residuals - decoded) ** 2).sum(1))

    def distances(self, unit: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances from vectors to the decoded members of a list, by table look-ups."""
        residuals, total = unit - self.centres[number], np.zeros((len(unit), len(codes)), np.float32)
        for j, ((a, b), book) in enumerate(zip(self.parts, self.books)):
            total += squared(residuals[:, a:b], book).astype(np.float32)[:, codes[:, j]]
        return total


def packed(column: pa.Array) -> list[bytes | None]:
    """The bytes of each vector of an Arrow list column as doubles; None for one that is null, 0, or not of finite numbers."""
    lists = column.to_pandas()
    lengths = np.array([0 if v is None else len(v) for v in lists], int)
    out: list[bytes | None] = [None] * len(lists)
    for n in set(lengths.tolist()) - {0}:
        at = np.flatnonzero(lengths == n)
        x = np.array([np.asarray(lists[i], dtype=np.float64) for i in at]) + 0.0  # -0.0 is 0.0
        for i, v, whole in zip(at.tolist(), x, np.isfinite(x).all(1) & (x != 0).any(1)):
            out[i] = v.tobytes() if whole else None
    return out


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def links_between(q: Quantiser, number: int, probers: pd.DataFrame, members: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Numbers of links and spanning stars between the members of a list's block and a block of vectors that probe the list.

    A link is counted for the prober; for the member too unless the member probes the prober's list, where it is counted.
    """
    x = unit(np.stack([np.frombuffer(v, np.float64) for v in members["vec"]]))
    xid, xsize = members["vec_id"].to_numpy(), members["size"].to_numpy()
    codes = np.stack([np.frombuffer(c, np.uint8) for c in members["codes"]])
    reach = (math.sqrt(2 - 2 * threshold) + members["err"].to_numpy() + 1e-4) ** 2
    probes = np.zeros((len(x), len(q.centres)), bool)
    for i, p in enumerate(members["probes"]):
        probes[i, p] = True
    pid, psize, home = (probers[c].to_numpy() for c in ("vec_id", "size", "home"))
    vectors = unit(np.stack([np.frombuffer(v, np.float64) for v in probers["vec"]]))
    links: dict[int, int] = {}
    edges: list[tuple[int, int]] = []
    for k in range(0, len(vectors), 256):
        v, ids = vectors[k : k + 256], pid[k : k + 256]
        near = q.distances(v, number, codes) <= reach
        near &= ids[:, None] != xid
        # where many pairs are near, a product of matrices leaves only what rounding may turn to the sum that decides
        dense = near.mean() > 0.05
        dots = v @ x.T if dense else None
        if dense:
            near &= dots >= threshold - ROUNDING
        a, b = np.nonzero(near)
        sure = dots[a, b] >= threshold + ROUNDING if dense else np.zeros(len(a), bool)
        open_ = np.flatnonzero(~sure)
        sure[open_] = (v[a[open_]] * x[b[open_]]).sum(1) >= threshold
        a, b = a[sure], b[sure]
        if not len(a):
            continue
        forward = np.bincount(a, weights=xsize[b], minlength=len(ids))
        alone = ~probes[b, home[k + a]]
        backward = np.bincount(b[alone], weights=psize[k + a[alone]], minlength=len(x))
        for all_ids, counts in ((ids, forward), (xid, backward)):
            for i in np.flatnonzero(counts).tolist():
                links[int(all_ids[i])] = links.get(int(all_ids[i]), 0) + int(counts[i])
        edges += forest(ids, xid, a, b)
    tops = stars(edges)
    return pd.DataFrame({"node": list(tops), "root": list(tops.values()), "links": [links.get(n, 0) for n in tops]}).astype("int64")


def forest(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stars that connect what the linked pairs (left[a], right[b]) connect."""
    tops_left, tops_right = left.copy(), right.copy()
    while True:
        least = np.minimum(tops_left[a], tops_right[b])
        before = tops_left.copy(), tops_right.copy()
        np.minimum.at(tops_left, a, least)
        np.minimum.at(tops_right, b, least)
        if (tops_left == before[0]).all() and (tops_right == before[1]).all():
            break
    used_left, used_right = np.unique(a), np.unique(b)
    return [*zip(left[used_left].tolist(), tops_left[used_left].tolist()), *zip(right[used_right].tolist(), tops_right[used_right].tolist())]


def links_of(reps: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(node, root, links) of ``reps`` (vec_id, size, vec), vectors of ``dim`` numbers: stars that join what links, and numbers of links."""
    spark = reps.sparkSession
    sample = [np.frombuffer(r["vec"], np.float64) for r in reps.orderBy(F.xxhash64("vec_id"), "vec_id").select("vec").limit(SAMPLE).collect()]
    lists = int(min(max(1, reps.count() // LIST_SIZE), max(1, len(sample) // 32)))
    border = BORDER * math.sqrt((2 - 2 * threshold) / dim)
    quantiser = spark.sparkContext.broadcast(Quantiser(unit(np.stack(sample)), lists))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.frombuffer(v, np.float64) for v in batch.column("vec").to_pylist()])
            home, probes, codes, err = quantiser.value.index(unit(x), border)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(probes, pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err, pa.float64())], names=["vec_id", "size", "vec", "home", "probes", "codes", "err"])

    indexed = materialize(reps.mapInArrow(index, "vec_id long, size long, vec binary, home int, probes array<int>, codes binary, err double"), "index")
    # a row for each list: at most as many as the sample allows
    sizes = indexed.select("home", F.explode("probes").alias("list")).groupBy("list").agg(F.count("*").alias("probers"), F.count_if(F.col("home") == F.col("list")).alias("members"))
    blocks = F.broadcast(sizes.select("list", F.ceil(F.col("members") / MEMBER_BLOCK).cast("int").alias("mb"), F.ceil(F.col("probers") / PROBER_BLOCK).cast("int").alias("pb")).where("mb > 0"))

    def dealt(column: str, blocks: str):
        return F.pmod(F.xxhash64("vec_id"), F.col(blocks)).cast("int").alias(column)

    def all_of(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    members = indexed.withColumnRenamed("home", "list").join(blocks, "list").select("list", dealt("m", "mb"), all_of("pb").alias("p"), "vec_id", "size", "vec", "probes", "codes", "err")
    probers = indexed.select("vec_id", "size", "vec", "home", F.explode("probes").alias("list")).join(blocks, "list").select("list", all_of("mb").alias("m"), dealt("p", "pb"), "vec_id", "size", "vec", "home")

    def meet(key: tuple, probing: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(probing) or not len(block):
            return pd.DataFrame({"node": [], "root": [], "links": []}).astype("int64")
        return links_between(quantiser.value, int(key[0]), probing, block, threshold)

    keys = ["list", "m", "p"]
    probers, members = (side.toDF(*side.columns) for side in (probers, members))
    return materialize(probers.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(meet, "node long, root long, links long"), "links")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors of one length whose cosine in double precision is at least ``threshold`` link; each length has an index of its own.
    Null vectors, zero vectors, and vectors that hold null or non-finite numbers link with nothing. n_links counts the other vec_ids
    linked directly, component_id is the least vec_id reachable, and kept marks it. Rows repeated with one vec_id count once and
    get equal results. A row whose vec_id is null links with nothing and has a null component_id. An empty table stays empty.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed(batch.column("embedding")), pa.binary())], names=["vec_id", "vec"])

    kept = materialize(rows.mapInArrow(pack, "vec_id long, vec binary"), "vectors")
    whole = kept.where("vec_id is not null and vec is not null").withColumn("key", F.sha2("vec", 256))
    classes = materialize(whole.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("size"), (F.max(F.octet_length("vec")) / 8).cast("int").alias("dim")), "classes")
    reps = whole.join(classes.select("key", "size", F.col("rep").alias("vec_id"), "dim"), ["key", "vec_id"]).dropDuplicates(["key"])
    lengths = sorted(r["dim"] for r in classes.select("dim").distinct().collect())
    if not lengths:
        return kept.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    met = functools.reduce(DataFrame.unionByName, [links_of(reps.where(F.col("dim") == n).select("vec_id", "size", "vec"), n, threshold) for n in lengths])
    links = met.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "rep")
    components = connected_components(met.select(F.col("node").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "rep")
    by_class = classes.drop("dim").join(links, "rep", "left").join(components, "rep", "left")
    result = kept.withColumn("key", F.sha2("vec", 256)).join(by_class, "key", "left")
    component = F.coalesce("component", "rep", "vec_id")
    n_links = F.coalesce(F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0)) + F.col("size") - 1), F.lit(0)).cast("long")
    return result.select("vec_id", n_links.alias("n_links"), F.when(F.col("vec_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

"""Similarity join of documents by the Jaccard index of their word shingles, through parity sketches.

A sketch has k blocks; each shingle flips one bit in one block, so sketches differ in at most as many blocks and bits as the
sets differ in shingles. Sets of a size band whose index reaches the threshold differ in at most D shingles, so at most D of the
band's blocks differ: two sets of which either fills more than D blocks agree in a block that is not empty. There are enough
blocks that sets fill more than D of them but for chance; those that don't meet each other under a signature of their own. Equal
blocks meet by a pigeonhole join per size band, and pairs are verified on whole texts.

Equal sets are one class from the start. The holders of a signature are held against the least of them, the pivot. Where a task has
more than a few of them, it holds these against the least of its own, which alone goes on: however many documents hold a signature, a
few rows are sent for each million signatures of a task. All that met one pivot are then a group; where that leaves members
of different components, those are held against each other by whole sketches: a group of up to ``BLOCK`` members directly, a larger
one split by the rarest shingles of its members, of which two linked sets share one (prefix filter; its order only has to be the
same for all, so frequencies in a table of bounded size will do). Only pairs whose sketches allow a link are verified, so no link
between different components is lost, and no bucket is expanded into its pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .hashing import WordHasher, mix
from .tables import column_name, discard, materialize

U = np.uint64
#: Deviations by which a set fills more blocks than its band's sets may differ in, where it can.
SURE = 6
#: Growth of size bands; more than 1 / threshold, so that linked sets are in one band or in neighbouring ones.
BAND = 1.6
#: Bits of every set's sketch; a large set has a wide one besides, of half as many bits as it has shingles at least.
SKETCH_BITS = 1024
#: Signatures that a task gathers before it sends them, and those of one bucket.
FLUSH, BUCKET = 750_000, 500_000
#: A signature with more holders among those that a task sends at once goes as one.
FEW = 8
#: Members of a group in one block of the comparison by sketches, and rows of such blocks in one task's share.
BLOCK, GROUP = 4_000, 100_000
#: Slots of the table of shingle frequencies, and those of one part of it.
SLOTS, SLOT_PART = 1 << 22, 1 << 16
#: Texts of a batch whose words are hashed at once.
TEXTS = 500


class Shingler:
    """Sets of hashed word shingles; the words are what is between blanks, A-Z in lower case."""

    def __init__(self, words: int):
        self.words, self.hasher = words, WordHasher()
        # odd factors: the sum of independent word hashes times these tells their order
        self.factors = (mix(np.arange(1, words + 1, dtype=U)) | U(1)).tolist()
        self.factors = list(map(U, self.factors))

    def sets(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """Distinct hashes of each text, sorted; the whole sequence is one shingle if it is shorter than a shingle."""
        for h in self.hasher.words(texts):
            if not len(h):
                yield np.zeros(0, U)
                continue
            n = min(len(h), self.words)
            last = len(h) - n + 1
            total = np.full(last, n, U)
            for i in range(n):
                total += h[i : i + last] * self.factors[i]
            total = np.sort(mix(total))
            yield total[np.concatenate([[True], total[1:] != total[:-1]])]

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for k in range(0, len(texts), TEXTS):
            yield from self.sets(texts.slice(k, TEXTS).to_pylist())


def sketch(h: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parities of ``bits`` (a power of two) buckets of the set. XOR of the halves of a sketch is the sketch of half as many bits."""
    return np.packbits((np.bincount((h % U(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_sketch(h: np.ndarray) -> bytes | None:
    return sketch(h, 1 << (len(h) // 2).bit_length()) if len(h) >= 2 * SKETCH_BITS else None


def wide_distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches at the size of the smaller."""
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


class Bands:
    """Size bands, and for each the greatest difference of linked sets. ``similarity``: a fraction, as two integers."""

    def __init__(self, similarity: tuple[int, int]):
        self.part, self.whole = similarity
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * max(BAND, 1.01 * self.whole / self.part))))
        self.array = np.array(self.starts)
        self.known: dict[int, int] = {}

    def difference(self, total: int) -> int:
        """The greatest symmetric difference of linked sets of ``total`` elements together."""
        return (self.whole - self.part) * total // (self.whole + self.part)

    def most(self, band: int) -> int:
        """The greatest difference of linked sets that meet in the band."""
        return self.difference(2 * (self.starts[band + 1] - 1))

    def blocks(self, band: int) -> int:
        """Of the band's sketch; 0 if its linked sets are equal."""
        if band not in self.known:
            most, n = self.most(band), max(1, self.starts[band] * self.part // self.whole)
            k = most + 1
            while k < 4 * n:  # the number of blocks that n shingles fill, by mean and deviation
                a = n / k
                filled, deviation = k * (1 - math.exp(-a)), math.sqrt(k * max(0.0, math.exp(-a) - (1 + a) * math.exp(-2 * a)))
                if filled - SURE * deviation > most:
                    break
                k += 1 + k // 50
            self.known[band] = k if most else 0
        return self.known[band]

    def of(self, n: int) -> list[int]:
        """The bands in which a set of ``n`` elements looks for others: its own, and the next if a linked set may be there."""
        own = int(np.searchsorted(self.array, n, side="right")) - 1
        return [own, own + 1] if n * self.whole >= self.starts[own + 1] * self.part else [own]


def signatures(h: np.ndarray, bands: Bands) -> np.ndarray:
    """One for each band and block that the set fills, and one for each band in which it fills no more than linked sets may differ in."""
    out, place, code = [], mix(h ^ U(0x5851F42D4C957F2D)), mix(h)
    for band in bands.of(len(h)):
        k = bands.blocks(band)
        if not k:
            continue
        block = (place % U(k)).astype(np.uint16 if k < 1 << 16 else np.int64)
        order = np.argsort(block, kind="stable")
        counts = np.bincount(block, minlength=k)
        full = np.flatnonzero(counts)
        # XOR of random codes of the set bits: equal exactly when the parities are
        parity = np.bitwise_xor.reduceat(code[order], (np.cumsum(counts) - counts)[full])
        salt = U((band + 1) * 0xDA942042E4DD58B5 & 0xFFFFFFFFFFFFFFFF)
        out.append(mix(parity ^ mix(full.astype(U) + salt)))
        if len(full) <= bands.most(band):
            out.append(mix(np.array([salt], U)))
    return np.concatenate(out) if out else np.zeros(0, U)


def digest(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def measured(rows: DataFrame, words: int) -> DataFrame:
    """(d, n, set, sketch, wide): size, digest and sketches of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            found = [(len(h), digest(h), sketch(h), wide_sketch(h)) for h in shingler.batch(batch.column("text"))]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("d"), *columns], names=["d", "n", "set", "sketch", "wide"])

    return rows.mapInArrow(run, "d long, n long, set binary, sketch binary, wide binary")


def told_apart(rows: DataFrame, sets: DataFrame, words: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``rows`` (d, text) and ``sets`` with one d for each document's set, and the (d, of) that were made where one d had several sets.

    Such a d stays with its least set; each other set has a number that no document has.
    """
    sets = sets.withColumn("doc", F.col("d"))
    several = materialize(sets.where("d is not null").groupBy("d").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low <> high").select("d", "low"), "several")
    if several.isEmpty():
        return rows, sets, None
    low, high = sets.agg(F.min("d"), F.max("d")).first()
    free = high + 1 if high < 1 << 62 else low - (1 << 61)
    twins = sets.join(several, "d").where("set <> low").select(F.col("d").alias("of"), "set").distinct()
    twins = materialize(twins.withColumn("d", F.monotonically_increasing_id() + free), "twins")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(digest, shingler.batch(batch.column("text"))), pa.binary())], names=["of", "text", "set"])

    own = rows.join(several.select("d"), "d", "left_semi").select(F.col("d").alias("of"), "text").mapInArrow(digests, "of long, text string, set binary")
    own = materialize(own.join(twins, ["of", "set"], "left").select(F.coalesce("d", "of").alias("d"), "text"), "twin-texts")
    rows = rows.join(several.select("d"), "d", "left_anti").unionByName(own)
    sets = sets.withColumnRenamed("d", "of").join(twins, ["of", "set"], "left").withColumn("d", F.coalesce("d", "of")).drop("of")
    return rows, materialize(sets, "sets"), twins.select("d", "of")


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def summed(d: np.ndarray, pivot: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, ...]:
    """d, pivot, times and more of each pair of d and pivot."""
    order = np.lexsort((pivot, d))
    d, pivot, more = d[order], pivot[order], more[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (pivot[1:] != pivot[:-1])])) if len(d) else np.zeros(0, np.int64)
    return d[first], pivot[first], np.diff(np.append(first, len(d))), np.logical_or.reduceat(more, first) if len(d) else more


def held(sig: np.ndarray, d: np.ndarray, holders: np.ndarray, few: int) -> tuple[np.ndarray, ...]:
    """(signature, d, holders) to be sent on, and (d, pivot, more) of those that met the least d with their signature.

    A signature of up to ``few`` rows is sent on as it is, one of more as its least d with the sum of its holders. ``more``:
    whether more than two hold it; the least one is then paired with itself.
    """
    order = np.argsort(sig)
    sig, d, holders = sig[order], d[order], holders[order]
    first = starts_of(sig)
    sizes = np.diff(np.append(first, len(sig)))
    least, total = (np.minimum.reduceat(d, first), np.add.reduceat(holders, first)) if len(first) else (d, holders)
    many = sizes > few
    shared = np.repeat(many, sizes)
    x, pivot, more = d[shared], np.repeat(least, sizes)[shared], np.repeat(total > 2, sizes)[shared]
    told = more | (x != pivot)
    rows = np.sort(np.concatenate([np.flatnonzero(~shared), first[many]]))  # by signature, still
    size = np.repeat(total, sizes)
    return sig[rows], np.where(shared, np.repeat(least, sizes), d)[rows], np.where(shared, size, holders)[rows], x[told], pivot[told], more[told]


def met(rows: DataFrame, words: int, similarity: tuple[int, int], buckets: int) -> DataFrame:
    """(d, pivot, times, more, near): documents that share signatures with a pivot, and how many; more: whether three hold one; near: whether they met in a task of their own."""
    bands, shares = Bands(similarity), -(-buckets // 4)
    bounds = np.array([g * (1 << 64) // buckets for g in range(buckets)], U)
    names = ["g", "sig", "d", "holders", "near"]

    def send(sigs: list[np.ndarray], ids: list[int]) -> Iterator[pa.RecordBatch]:
        """Empties ``sigs``."""
        d = np.repeat(np.array(ids, np.int64), list(map(len, sigs)))
        sig = np.concatenate(sigs)
        sigs.clear()
        sig, least, holders, *near = held(sig, d, np.ones(len(d), np.int64), FEW)
        del d
        near = np.stack(summed(*near)).astype(np.int64)
        ends = np.append(np.searchsorted(sig, bounds), len(sig))
        # what met here goes with the signatures, a share with each bucket
        full = np.flatnonzero(ends[1:] > ends[:-1]).tolist()
        cuts = np.linspace(0, near.shape[1], len(full) + 1).astype(int).tolist()
        found = [(g, sig[i:j].tobytes(), least[i:j].tobytes(), holders[i:j].astype(np.uint32).tobytes(), near[:, k:m].tobytes()) for g, k, m in zip(full, cuts, cuts[1:]) for i, j in [ends[g : g + 2]]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int32(), *[pa.binary()] * 4))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, sigs, ids, n = Shingler(words), set(), [], [], 0
        for batch in batches:
            for d, h in zip(batch.column("d").to_pylist(), shingler.batch(batch.column("text"))):
                key = digest(h)
                if key in seen:  # its class is here already
                    continue
                if len(seen) < 1_000_000:
                    seen.add(key)
                sigs.append(signatures(h, bands))
                ids.append(d)
                n += len(sigs[-1])
                if n >= FLUSH:
                    yield from send(sigs, ids)
                    sigs, ids, n = [], [], 0
        if n:
            yield from send(sigs, ids)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of d, pivot, times, more and near, together for all d of a share."""
        sig, d, holders = (np.concatenate([np.frombuffer(x, k) for x in pdf[c]]) for c, k in (("sig", U), ("d", np.int64), ("holders", np.uint32)))
        far = np.stack(summed(*held(sig, d, holders.astype(np.int64), 1)[3:])).astype(np.int64)
        del sig, d, holders
        near = np.concatenate([np.frombuffer(x, np.int64).reshape(4, -1) for x in pdf["near"]], axis=1)
        rows = np.concatenate([np.vstack([far, np.zeros_like(far[:1])]), np.vstack([near[:3], np.zeros_like(near[:1]), np.ones_like(near[:1])])], axis=1)
        share = (mix(rows[0].astype(U)) % U(shares)).astype(np.int64)
        order = np.argsort(share, kind="stable")
        first = starts_of(share[order])
        parts = np.split(rows[:, order], first[1:], axis=1)
        return pd.DataFrame({"share": share[order][first], "rows": [x.tobytes() for x in parts if x.size]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        d, pivot, times, more, near = np.concatenate([np.frombuffer(x, np.int64).reshape(5, -1) for x in pdf["rows"]], axis=1)
        order = np.lexsort((pivot, d))
        d, pivot = d[order], pivot[order]
        first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (pivot[1:] != pivot[:-1])]))
        return pd.DataFrame({"d": d[first], "pivot": pivot[first], "times": np.add.reduceat(times[order], first), "more": np.maximum.reduceat(more[order], first) > 0, "near": np.maximum.reduceat(near[order], first) > 0})

    found = rows.mapInArrow(run, "g int, sig binary, d binary, holders binary, near binary").groupBy("g").applyInPandas(meet, "share long, rows binary")
    return found.groupBy("share").applyInPandas(add, "d long, pivot long, times long, more boolean, near boolean")


def grouped(hits: DataFrame) -> DataFrame:
    """(pivot, d, component): the groups of all that hold a signature which three hold, where they have members of more than one component.

    ``hits``: with the ``member`` that stands for each d's class, and its ``component``. Those that met a pivot in a task of their own
    are of the groups that this pivot is of, or of its own if it is of none. The least and the greatest component that met there tell
    which groups are open, so only to these members are led, and to each once, by however many pivots.
    """
    direct = hits.where("more").select("pivot", "d", "member", "component")
    near = hits.where("near").select(F.col("pivot").alias("via"), "member", "component").distinct()
    ends = near.groupBy("via").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    ways = ends.join(direct.select(F.col("d").alias("via"), "pivot"), "via", "left").withColumn("pivot", F.coalesce("pivot", "via"))
    ends = direct.select("pivot", F.col("component").alias("low"), F.col("component").alias("high")).unionByName(ways.select("pivot", "low", "high"))
    several = ends.groupBy("pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("pivot")
    ways = ways.join(several, "pivot").groupBy("via").agg(F.array_sort(F.collect_set("pivot")).alias("pivots"))
    led = near.join(ways, "via").groupBy("member", "component").agg(F.array_distinct(F.flatten(F.collect_set("pivots"))).alias("pivots"))
    led = led.select(F.explode("pivots").alias("pivot"), "member", "component")
    return direct.join(several, "pivot").select("pivot", "member", "component").unionByName(led).withColumnRenamed("member", "d").distinct()


def linked(rows: DataFrame, pairs: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have an index of at least ``similarity``."""
    part, whole = similarity
    both = pairs.join(rows.toDF("a", "text_a"), "a").join(rows.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, b_set = Shingler(words), None, None
        for batch in batches:
            keep, texts = [], batch.column("text_b")
            for i, a_set in enumerate(shingler.batch(batch.column("text_a"))):
                b = texts[i].as_py()
                if b_set is None or b != last:  # rows come sorted by b
                    last, (b_set,) = b, shingler.sets([b])
                common = len(np.intersect1d(a_set, b_set, assume_unique=True))
                keep.append(common > 0 and whole * common >= part * (len(a_set) + len(b_set) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def possible(pairs: DataFrame, sizes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b, times) whose sizes and sketches allow a link."""
    part, whole = similarity
    both = pairs.join(sizes.toDF("a", "n_a", "sketch_a", "wide_a"), "a").join(sizes.toDF("b", "n_b", "sketch_b", "wide_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), U).reshape(len(n_a), -1) for c in ("sketch_a", "sketch_b"))
            keep = may_link(n_a, n_b, np.bitwise_count(x ^ y).sum(1, dtype=np.int64), part, whole)
            wide = [(i, wide_distance(a, b)) for i in np.flatnonzero(keep).tolist() if (a := batch.column("wide_a")[i].as_py()) is not None and (b := batch.column("wide_b")[i].as_py()) is not None]
            if wide:
                i, distance = np.array(wide).T
                keep[i] = may_link(n_a[i], n_b[i], distance, part, whole)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b", "times")], names=["a", "b", "times"])

    return both.select("a", "b", "times", "n_a", "n_b", "sketch_a", "sketch_b", "wide_a", "wide_b").mapInArrow(run, "a long, b long, times long")


def separate(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are in different components; a node without one is its own."""
    for c in ("a", "b"):
        pairs = pairs.join(components.toDF(c, f"of_{c}"), c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    return pairs.where("of_a <> of_b").select("a", "b")


def may_link(n_a: np.ndarray, n_b: np.ndarray, distance: np.ndarray, part: int, whole: int) -> np.ndarray:
    return (np.minimum(n_a, n_b) * whole >= np.maximum(n_a, n_b) * part) & (distance * (whole + part) <= (whole - part) * (n_a + n_b))


def dealt(members: DataFrame) -> DataFrame:
    """``members`` once for each pair (i, j) of blocks of their pivot's group, of ``size`` members, that their own block is in; g: the share of the pair, of about GROUP rows."""
    members = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = members.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    groups = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / GROUP))
    own = F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int")
    out = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = out.select("pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "d", "component")
    return out.withColumn("g", F.pmod(F.xxhash64("pivot", "i", "j"), F.lit(groups)))


def forest(pairs: np.ndarray, distance: np.ndarray, ends: dict[int, int]) -> np.ndarray:
    """Those of ``pairs``, the nearest first, that join what no nearer one has joined; ends: the component of each member."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    kept = []
    for i in np.argsort(distance, kind="stable").tolist():
        a, b = (root(ends[d]) for d in pairs[i].tolist())
        if a != b:
            parent[a] = b
            kept.append(i)
    return pairs[kept]


def across(members: DataFrame, sizes: DataFrame, similarity: tuple[int, int], sparse: bool = False) -> DataFrame:
    """(a, b, pivot, d): pairs (a, b) of ``members`` (pivot, d, component, size) that share a pivot, are of different components and may link by ``sizes`` (d, n, sketch, wide).

    ``sparse``: of each pair of blocks only a forest of the nearest pairs, fewer than the members, that joins what all would. Where
    that leaves pairs out, the members that pairs were found for are rows (pivot, d) without a and b.
    """
    part, whole = similarity

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        every, rest = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        for (pivot, i, j), rows in pdf.groupby(["pivot", "i", "j"]):
            out, far = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
            own, d, component, n, wide = (rows[c].to_numpy() for c in ("own", "d", "component", "n", "wide"))
            bits = np.frombuffer(b"".join(rows["sketch"]), U).reshape(len(rows), -1)
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            right = right[np.argsort(n[right], kind="stable")]
            least, most = np.searchsorted(n[right], n[left] * part / whole - 1), np.searchsorted(n[right], n[left] * whole / part + 1)
            for k, low, high in zip(left, least, most):
                others = right[low:high]  # of sizes that allow a link
                others = others[(component[others] != component[k]) & (d[others] < d[k])] if i == j else others[component[others] != component[k]]
                apart = np.bitwise_count(bits[others] ^ bits[k]).sum(1, dtype=np.int64)
                fits = may_link(n[k], n[others], apart, part, whole)
                good, apart = others[fits], apart[fits]
                if wide[k] is not None and len(good):
                    distance = np.array([0 if wide[j] is None else wide_distance(wide[k], wide[j]) for j in good])
                    fits = may_link(n[k], n[good], distance, part, whole)
                    good, apart = good[fits], apart[fits]
                far.append(apart)
                out.append(np.stack([np.maximum(d[good], d[k]), np.minimum(d[good], d[k])], axis=1))
            found = np.concatenate(out)
            every.append(forest(found, np.concatenate(far), dict(zip(d.tolist(), component.tolist()))) if sparse else found)
            if len(found) > len(every[-1]):
                open_ = np.unique(found)
                rest.append(np.stack([np.full(len(open_), pivot), open_], axis=1))
        pairs, nodes = np.concatenate(every), np.concatenate(rest)
        rows = np.ma.masked_all((len(pairs) + len(nodes), 4), np.int64)
        rows[: len(pairs), :2], rows[len(pairs) :, 2:] = pairs, nodes
        return pd.DataFrame({c: pd.arrays.IntegerArray(rows.data[:, k].copy(), rows.mask[:, k].copy()) for k, c in enumerate(("a", "b", "pivot", "d"))})

    return dealt(members).join(sizes, "d").groupBy("g").applyInPandas(compare, "a long, b long, pivot long, d long")


def frequencies(texts: DataFrame, words: int) -> np.ndarray:
    """How many shingles of the sets of ``texts`` (text) each slot has; at most ``SLOTS`` numbers, counted in parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(words), np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for h in shingler.batch(batch.column("text")):
                np.add.at(counts, (h % U(SLOTS)).astype(np.int64), 1)
        parts = counts.reshape(-1, min(SLOT_PART, SLOTS))
        full = np.flatnonzero(parts.any(1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([parts[k].tobytes() for k in full], pa.binary())], names=["part", "counts"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = functools.reduce(np.add, (np.frombuffer(x, np.uint32) for x in pdf["counts"]))
        return pd.DataFrame({"part": [int(key[0])], "counts": [total.tobytes()]})

    out = np.zeros((max(1, SLOTS // SLOT_PART), min(SLOT_PART, SLOTS)), np.uint32)
    for r in texts.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary").collect():
        out[r["part"]] = np.frombuffer(r["counts"], np.uint32)
    return out.reshape(-1)


def rarest(texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """(pivot, d): the rarest shingles of each of ``texts`` (d, text) that others may have too, so many that linked sets share one."""
    part, whole = similarity
    known = texts.sparkSession.sparkContext.broadcast(frequencies(texts, words))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            out_h, out_d = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for d, h in zip(batch.column("d").to_pylist(), shingler.batch(batch.column("text"))):
                often = known.value[(h % U(SLOTS)).astype(np.int64)]
                first = np.lexsort((h, often))[: len(h) + 1 - -(-part * len(h) // whole)]
                out_h.append(h[first[often[first] > 1]])
                out_d.append(np.full(len(out_h[-1]), d, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_h).view(np.int64)), pa.array(np.concatenate(out_d))], names=["pivot", "d"])

    return texts.mapInArrow(choose, "pivot long, d long")


def open_groups(member: DataFrame) -> DataFrame:
    """Those of ``member`` (pivot, d, component) whose groups have members of more than one component; size: of the group."""
    found = member.groupBy("pivot").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    return member.join(found.where("low <> high").select("pivot", "size"), "pivot")


def near_duplicates(documents: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``documents``.

    A document's set holds its distinct shingles of ``words`` words; with fewer words it is the whole sequence, and without
    words or text it is empty and links with nothing. Documents link when the Jaccard index of their sets is at least
    ``similarity`` (part, whole), exactly. component_id is the least doc_id reachable by links, the row's own included. Repeated
    rows get equal results; rows of one doc_id with different texts share a component_id and whatever either links with. doc_id
    is an integer, or a text that Spark casts to a long (one that isn't is an error). A null doc_id links with nothing and has a
    null component_id. An empty table stays empty; other columns are not read.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("d"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    first = materialize(measured(rows, words), "sets")
    rows, sets, twins = told_apart(rows, first, words)
    usable = rows.where("d is not null")
    full = sets.where("d is not null and n > 0")
    classes = materialize(full.groupBy("set").agg(F.min("d").alias("rep"), F.max("d").alias("most")).where("rep <> most").select("set", "rep"), "classes")
    copies = materialize(full.join(classes, "set").where("d <> rep").select("d", "rep").distinct(), "copies")
    share = 2 * (similarity[1] - similarity[0]) / (similarity[1] + similarity[0])
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * share * size / 5 / BUCKET))
    hits = materialize(met(usable, words, similarity, buckets), "hits")

    def of_class(frame: DataFrame, *columns: str) -> DataFrame:
        """The columns, moved to the least document of their class."""
        for c in columns:
            frame = frame.join(copies.toDF(c, "moved"), c, "left").withColumn(c, F.coalesce("moved", c)).drop("moved")
        return frame

    sizes = full.select("d", "n", "sketch", "wide").dropDuplicates(["d"])
    shared = of_class(hits.where("d <> pivot").select(F.col("d").alias("a"), F.col("pivot").alias("b"), "times"), "a", "b").where("a <> b")
    shared = shared.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "times").groupBy("a", "b").agg(F.sum("times").alias("times"))
    pairs = materialize(possible(shared, sizes, similarity), "pairs")
    # most documents are linked to the one with which they share most; other pairs only matter where that leaves them apart
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("times", -F.col("b"))).alias("b"))
    links = linked(usable, best, words, similarity)
    if twins is not None:
        links = links.unionByName(of_class(twins.toDF("a", "b"), "a", "b"))
    links = materialize(links, "links")
    components = materialize(connected_components(links.toDF("src", "dst")), "components")
    apart = separate(pairs.join(best, ["a", "b"], "left_anti").select("a", "b"), components)
    links = materialize(links.unionByName(linked(usable, materialize(apart, "pairs"), words, similarity)), "links")
    components = materialize(connected_components(links.toDF("src", "dst")), "components")

    def of_component(member: DataFrame) -> DataFrame:
        return member.join(components.withColumnRenamed("node", "d"), "d", "left").select("pivot", "d", F.coalesce("component", "d").alias("component")).distinct()

    placed = of_class(hits.where("more or near").withColumn("member", F.col("d")), "member")
    placed = placed.join(components.withColumnRenamed("node", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))
    open_members = materialize(open_groups(grouped(materialize(placed, "placed"))), "members")
    direct, large = open_members.where(F.col("size") <= BLOCK), open_members.where(F.col("size") > BLOCK)
    if not large.isEmpty():
        texts = materialize(usable.join(large.select("d").distinct(), "d").dropDuplicates(["d"]), "open-texts")
        direct = direct.unionByName(open_groups(of_component(rarest(texts, words, similarity))))
        direct = materialize(direct, "members")
    # first the nearest pairs that join all that may be one, then what is still apart of the members that had others
    for sparse in (True, False):
        found = materialize(across(direct, sizes, similarity, sparse), "pairs")
        if found.isEmpty():
            break
        links = materialize(links.unionByName(linked(usable, found.where("a is not null").select("a", "b").distinct(), words, similarity)), "links")
        components = materialize(connected_components(links.toDF("src", "dst")), "components")
        if sparse:
            left = found.where("d is not null").select("pivot", "d")
            if left.isEmpty():
                break
            direct = materialize(open_groups(of_component(left)), "members")
    found = sets.select("doc", "d", "n").join(copies, "d", "left").withColumn("rep", F.coalesce("rep", "d")).join(components.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("doc", "n", F.coalesce("component", "rep").alias("component"))
    if twins is not None:  # the least number may be one that was made
        least = found.groupBy("component").agg(F.min("doc").alias("least"))
        found = found.join(least, "component", "left").select("doc", "n", F.col("least").alias("component"))
    discard(hits)
    return found.select(F.col("doc").cast(documents.schema["doc_id"].dataType).alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def without_near_duplicates(documents: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """``documents`` with one row of each component, that of its least doc_id; all columns as they are.

    Of rows that share this doc_id the one with the least text stays, a null text coming first. Rows without a doc_id stay all; so
    do documents without words, which are copies of nothing. An empty table stays empty.
    """
    found = near_duplicates(documents, words, similarity)
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = documents.join(dropped, "doc_id", "left_anti").select(*documents.columns)
    several = materialize(documents.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if several.isEmpty():
        return kept
    place = column_name(documents, "place")
    first = kept.join(several, "doc_id", "left_semi").withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first())))
    return kept.join(several, "doc_id", "left_anti").unionByName(first.where(F.col(place) == 1).drop(place)).select(*documents.columns)

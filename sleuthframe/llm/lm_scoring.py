"""Language-model scores of texts from a log-frequency Bloom filter.

Counts of words and word pairs over all training texts are quantised; for a count of level q the filter holds the n-gram with
each number up to q, so a count is read by probing 1, 2, 3 ... until a number is missing. The filter holds every n-gram, those
seen once too: it grows with the distinct ones, in shards by range of hash, of at most ``MOST_BITS`` bits. Up to ``BROADCAST`` shards
are broadcast; a worker holds one at a time and asks each for all n-grams of some texts. A filter of more stays a table: texts are
cut into pieces, the n-grams of a piece go to the shards that hold them, are probed there, all of a task at once, and what was read
goes back to the piece, so neither the driver nor a worker ever holds more than a shard. A fixed share of the probability after every
context goes to single words.

The base score uses exact counts: those of the most frequent words are broadcast (at most ``HEAD`` words), those of the others
are joined.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import mix
from .tables import discard, materialize, new_path

HEAD = 300_000
MOST_BITS = 1 << 28
#: Segments of a filter, and those that the driver collects at once.
SEGMENTS, GATHERED = 256, 64
BITS_PER_ENTRY = 11
#: Bits set for an entry: as many in each of two words of 64 bits.
HALF = 3
#: Tokens gathered before a task sends its pair counts, and those counted in one group, all of whose pairs are kept.
FLUSH, GROUP = 2_000_000, 3_000_000
#: Characters of texts scored at once, and how many times that at most where shards have to be loaded for them.
PIECE, PIECES = 2_000_000, 2
#: Texts that are Python objects at once, bytes of texts whose words are counted at once, and n-grams probed at once.
TEXTS, COUNTED, LOOKED_UP = 500, 8_000_000, 1 << 17
#: Shards that are broadcast; n-grams that one task probes where there are more.
BROADCAST, PROBED = 4, 4_000_000
#: Share of a pair's relative frequency that is believed.
TRUST = 0.4
#: Neither can be a word, both being white space.
END, START = b"\n", b"\t"
#: What stands for the end where texts are joined: no text has the byte 255.
MARK = b" \xff "
WHITE = b" \t\n\x0b\x0c\r"
LOWER, INK = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"), bytes(c not in WHITE for c in range(256))

U, MASK = np.uint64, (1 << 64) - 1
STEP = 0xD1342543DE82EF95
#: Bytes of a hash that the filter goes by; the last ones, with the bucket, are left out.
KEPT = 6
#: Sets of ``HALF`` different bits of a word of 64: their places, and the words.
SETS = 4096
PLACES = np.stack([U(64 * k // HALF) + (mix(np.arange(SETS, dtype=U)) >> U(16 * k)) % U(64 * (k + 1) // HALF - 64 * k // HALF) for k in range(HALF)])
MASKS = np.bitwise_or.reduce(U(1) << PLACES)
#: Least counts of the levels: exact up to 8, then a quarter more each.
LEVELS = [1, 2, 3, 4, 5, 6, 7, 8]
while LEVELS[-1] < 10**15:
    LEVELS.append(LEVELS[-1] * 5 // 4)
STARTS = np.array(LEVELS)
#: What a level stands for, 0 first.
VALUES = np.concatenate([[0.0], np.sqrt(STARTS[:-1] * np.maximum(STARTS[1:] - 1.0, STARTS[:-1]))])


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(STARTS, counts, side="right")


def pair_hash(first: np.ndarray, second: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """56 bits of hash, and the bucket of the first word."""
    return (mix(first * U(0x9E3779B97F4A7C15) + second) & U(MASK - 255)) | bucket.astype(U)


def encoded(text: str | None) -> bytes:
    """A text as part of joined texts."""
    return (text.encode() if text else b"") + MARK


def tokens(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of joined texts in lower case (A-Z only), the end being one, which of them each token is, and the number of
    tokens of each text.
    """
    ink = np.frombuffer(data.translate(INK), bool)
    edges = np.flatnonzero(np.concatenate([[False], ink]) != np.concatenate([ink, [False]]))
    offsets = np.concatenate([[0], np.cumsum(edges[1::2] - edges[::2])]).astype(np.int32)
    # letters alone, so that each word begins where the one before ends
    found = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data.translate(LOWER, WHITE))]).dictionary_encode()
    words, token = found.dictionary, found.indices.to_numpy()
    if not len(token):
        return words, token, np.zeros(0, np.int64)
    end = int(token[-1])
    words = pa.concat_arrays([words.slice(0, end), pa.array([END], pa.binary()), words.slice(end + 1)])
    return words, token, np.diff(np.flatnonzero(token == end), prepend=-1)


def before_each(token: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """The token before each, ``start`` where a text begins."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.cumsum(sizes) - sizes] = start
    return before


def hashes_of(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_numpy(zero_copy_only=False)), U, len(words))


class Head:
    """The most frequent words, with their counts, in order of their hashes."""

    def __init__(self, words: pa.Array, counts: np.ndarray):
        h = hashes_of(words)
        order = np.argsort(h)
        self.hashes, self.words, self.counts = h[order], words.take(pa.array(order)), counts[order]

    def counts_of(self, words: pa.Array, h: np.ndarray) -> np.ndarray:
        """Exact counts of words, whose hashes are given, that are of the head, -1 for others."""
        found = np.full(len(h), -1)
        at = np.searchsorted(self.hashes, h)
        own = np.flatnonzero(np.append(self.hashes, U(0))[at] == h)
        own = own[at[own] < len(self.counts)]
        same = pc.equal(words.take(pa.array(own)), self.words.take(pa.array(at[own]))).to_numpy(zero_copy_only=False)
        found[own[same]] = self.counts[at[own[same]]]
        return found


def head_of(vocabulary: DataFrame) -> Head:
    counts: dict[bytes, int] = {bytes(r["token"]): r["c"] for r in vocabulary.select("token", "c").toLocalIterator()}
    return Head(pa.array(counts.keys(), pa.binary()), np.fromiter(counts.values(), np.int64, len(counts)))


def levels_of(exact: np.ndarray) -> np.ndarray:
    return np.where(exact > 0, level(exact), 0)


def with_start(words: pa.Array) -> pa.Array:
    return pa.concat_arrays([words, pa.array([START], pa.binary())])


def in_order(h: np.ndarray) -> np.ndarray:
    """Places of hashes in their order, as far as they differ in their first bits: numbers that hold a place each are sorted faster."""
    low = U((1 << len(h).bit_length()) - 1)
    return (np.sort(h & ~low | np.arange(len(h), dtype=U)) & low).view(np.int64)


def different(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order, each once (or, rarely, more often), and where each of ``h`` is among them."""
    order = in_order(h)
    found = h[order]
    first, back = np.append(True, found[1:] != found[:-1])[: len(h)], np.empty(len(h), np.int64)
    back[order] = np.cumsum(first) - 1
    return found[first], back


def texts_of(batch: pa.RecordBatch) -> Iterator[list[str | None]]:
    """The texts of a batch, a few at a time."""
    column = batch.column("text")
    for k in range(0, len(column), TEXTS):
        yield column.slice(k, TEXTS).to_pylist()


def joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[bytes]:
    """The texts of batches, joined up to about so many bytes."""
    parts, n = [], 0
    for text in (text for batch in batches for texts in texts_of(batch) for text in texts):
        parts.append(encoded(text))
        n += len(parts[-1])
        if n >= size:
            yield b"".join(parts)
            parts, n = [], 0
    if parts:
        yield b"".join(parts)


class Filter:
    """A Bloom filter in segments, or some in a row of one of ``shards`` that it is split into; an n-gram's bits all lie in the segment of its hash."""

    def __init__(self, bits: np.ndarray, least: dict[int, int], shards: int = 1, segments: int = SEGMENTS):
        self.bits, self.least, self.shards, self.segments = bits, least, shards, segments  # least: the first level held, by order
        self.size = len(bits) * 8 // segments

    @staticmethod
    def segment(h: np.ndarray, shards: int = 1) -> np.ndarray:
        """Numbers of segments, counted through all shards."""
        return ((h >> U(32)) * U(SEGMENTS * shards) >> U(32)).astype(np.int64)

    @staticmethod
    def spread(h: np.ndarray, number: int) -> np.ndarray:
        """What tells an n-gram's bits for a number: two sets, and the words that they are in."""
        return mix((h >> U(64 - 8 * KEPT)) + U(number * STEP & MASK))

    @staticmethod
    def places(h: np.ndarray, number: int, size: int) -> Iterator[np.ndarray]:
        """Places in its segment, whose size is a power of two (64 at least), of an n-gram with a number."""
        a = Filter.spread(h, number)
        for sets, words in ((a, a >> U(24)), (a >> U(12), a >> U(44))):
            first = (words & U(size // 64 - 1)) * U(64)
            for place in PLACES:
                yield (first + place[(sets & U(SETS - 1)).view(np.int64)]).view(np.int64)

    def level(self, h: np.ndarray, order: int) -> np.ndarray:
        """Levels read by probing; h is of n-grams of one order."""
        return np.concatenate([self.some_levels(h[k : k + LOOKED_UP], order) for k in range(0, max(1, len(h)), LOOKED_UP)])

    def some_levels(self, h: np.ndarray, order: int) -> np.ndarray:
        """A number is given up at its first missing half."""
        words, mask, kept = self.bits.view("<u8"), U(self.size // 64 - 1), U(SETS - 1)
        found, alive, number = np.zeros(len(h), np.int64), np.arange(len(h)), self.least[order]
        base = ((self.segment(h, self.shards) % self.segments) * (self.size // 64)).view(U)
        while len(alive) and number < len(VALUES):  # a small segment may be full
            a = self.spread(h, number)
            bits = MASKS[(a & kept).view(np.int64)]
            held = np.flatnonzero(words[(base + (a >> U(24) & mask)).view(np.int64)] & bits == bits)
            if len(held) < len(alive):
                alive, h, base, a = alive[held], h[held], base[held], a[held]
            bits = MASKS[(a >> U(12) & kept).view(np.int64)]
            held = np.flatnonzero(words[(base + (a >> U(44) & mask)).view(np.int64)] & bits == bits)
            if len(held) < len(alive):
                alive, h, base = alive[held], h[held], base[held]
            found[alive] = number
            number += 1
        return found


class Shards:
    """The broadcast shards of a filter, loaded one after another where there is more than one."""

    def __init__(self, parts: list[Broadcast]):
        self.parts = parts

    def level(self, h: np.ndarray) -> np.ndarray:
        """Levels of n-grams of any order."""
        n = len(self.parts)
        if n == 1:
            return Filter(self.parts[0].value, {1: 1}).level(h, 1)
        found, shard = np.zeros(len(h), np.int64), Filter.segment(h, n) // SEGMENTS
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(n + 1))
        for part, low, high in zip(self.parts, ends, ends[1:]):
            if low < high:
                some = order[low:high]
                found[some] = Filter(part.value, {1: 1}, n).level(h[some], 1)
                if getattr(part, "_path", None):  # can be read again from the worker's disk
                    del part._value
        return found


def is_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 != 0, F.lit(True))


def count_words(texts: DataFrame) -> DataFrame:
    """(token binary, c) over all texts, the end being a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in joined(batches, COUNTED):
            words, token, _ = tokens(data)
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(token, minlength=len(words)), pa.int64())], names=["token", "c"])

    return texts.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def count_pairs(texts: DataFrame, head, groups: int) -> DataFrame:
    """(h, c, bucket) of all word pairs of the texts with their counts, and, with a null h, the tokens of each bucket.

    The bucket of a pair is the level of its first word's count, 0 where that word is not in ``head``.
    """

    bounds = np.array([g * (1 << 64) // groups for g in range(groups)], U)

    def cells(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        """A cell of the bytes of the values from each end to the next, without a copy."""
        offsets = (ends * values.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])

    def send(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Empties ``pairs``."""
        h = np.concatenate(pairs)
        pairs.clear()
        h.sort()
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        counts, h = np.diff(first, append=len(h)).astype(np.uint32), h[first]
        del first
        ends = np.append(np.searchsorted(h, bounds), len(h))
        full = np.flatnonzero(ends[1:] > ends[:-1])
        ends = np.append(ends[full], len(h))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), cells(h, ends), cells(counts, ends)], names=["g", "h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = [], 0
        for data in joined(batches, COUNTED // 2):
            words, token, sizes = tokens(data)
            before, words = before_each(token, sizes, len(words)), with_start(words)
            h = hashes_of(words)
            levels = levels_of(head.value.counts_of(words, h))
            pairs.append(pair_hash(h[before], h[token], levels[before]))
            n += len(token)
            if n >= FLUSH:
                yield from send(pairs)
                n = 0
        if pairs:
            yield from send(pairs)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, U) for x in rows["h"]])
        c = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["c"]]).astype(np.int64)
        order = np.argsort(h)
        h, c = h[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        c, h = np.add.reduceat(c, first), h[first]
        b = (h & U(255)).astype(np.int64)
        tokens = np.bincount(b, weights=c)
        used = np.flatnonzero(tokens)
        out = pd.DataFrame({"h": pd.array(h.view(np.int64), "Int64"), "c": c, "bucket": b.astype(np.int32)})
        return pd.concat([out, pd.DataFrame({"h": pd.array([None] * len(used), "Int64"), "c": tokens[used].astype(np.int64), "bucket": used.astype(np.int32)})])

    sent = texts.select("text").mapInArrow(run, "g int, h binary, c binary")
    return sent.groupBy("g").applyInPandas(add, "h long, c long, bucket int")


def by_size(counts: DataFrame) -> list:
    """(low, high, n): least and greatest count and n-grams of each eighth of a doubling; the counts up to 8 are apart. At most 512 rows."""
    return sorted(tuple(r) for r in counts.groupBy(F.floor(8 * F.log2("c"))).agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).select("low", "high", "n").collect())


def entries_of(counts: DataFrame) -> int:
    """Entries of the filter that hold all ``counts``, one for each level of each n-gram; a few more where counts of two levels are counted together."""
    sizes = by_size(counts)
    return sum(int(top) * n for top, (_, _, n) in zip(level(np.array([high for _, high, _ in sizes], np.int64)), sizes))


def shape(entries: int) -> tuple[int, int]:
    """Shards, and bits of each, that give every entry ``BITS_PER_ENTRY`` at least; one shard has a power of two."""
    shards = max(1, math.ceil(entries * BITS_PER_ENTRY / MOST_BITS))
    return shards, MOST_BITS if shards > 1 else max(1 << 16, 1 << math.ceil(math.log2(max(1, entries * BITS_PER_ENTRY))))


def build_filter(grams: DataFrame, shards: int, bits: int) -> DataFrame:
    """(s, bits, k): the segments of a filter of ``shards`` of ``bits`` bits with all ``grams`` (h, c), in folders of ``GATHERED``."""
    size = bits // SEGMENTS

    def set_bits(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(size, bool)
        h, top, number = rows["h"].to_numpy().view(U), level(rows["c"].to_numpy()), 1
        while len(h):
            for place in Filter.places(h, number, size):
                marks[place] = True
            number += 1
            h, top = h[top >= number], top[top >= number]
        return pd.DataFrame({"s": [int(key[0])], "bits": [np.packbits(marks, bitorder="little").tobytes()]})

    segment = F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * SEGMENTS * shards, 32)
    made = grams.groupBy(segment.alias("s")).applyInPandas(set_bits, "s long, bits binary").withColumn("k", (F.col("s") / GATHERED).cast("int"))
    path = new_path(grams.sparkSession, "filter")
    made.repartition("k").write.partitionBy("k").parquet(path)
    return grams.sparkSession.read.schema("s long, bits binary, k int").parquet(path)


def gathered(table: DataFrame, shards: int, bits: int) -> Iterator[np.ndarray]:
    """The bytes of each shard."""
    for shard in range(shards):
        out, first = np.zeros((SEGMENTS, bits // SEGMENTS // 8), np.uint8), shard * SEGMENTS
        for k in range(first // GATHERED, (first + SEGMENTS) // GATHERED):  # each is a folder
            for r in table.where(F.col("k") == k).select("s", "bits").collect():
                out[r["s"] - first] = np.frombuffer(r["bits"], np.uint8)
        yield out.reshape(-1)


def hashed(vocabulary: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hashes_of(batch.column("token"))
            yield pa.RecordBatch.from_arrays([pa.array(mix(h).view(np.int64)), batch.column("c")], names=["h", "c"])

    return vocabulary.select("token", "c").mapInArrow(run, "h long, c long")


@dataclass
class Totals:
    tokens: int
    words: int
    documents: int

    @property
    def scale(self) -> float:
        return self.tokens + 0.1 * (self.words + 1)


class Piece:
    """Some texts: their tokens, and ``asked``, the hashes of the words, the start and the different pairs that they have."""

    def __init__(self, texts: list[str | None], head: Head):
        words, self.token, self.sizes = tokens(b"".join(map(encoded, texts)))
        self.before, self.words = before_each(self.token, self.sizes, len(words)), with_start(words)
        h = hashes_of(self.words)
        self.exact = head.counts_of(self.words, h)
        self.levels = levels_of(self.exact)
        pairs, self.pair = different(pair_hash(h[self.before], h[self.token], self.levels[self.before]))
        self.asked = np.concatenate([mix(h), pairs])

    def scores(self, levels: np.ndarray, unseen: np.ndarray, totals: Totals) -> tuple[np.ndarray, ...]:
        """n_tokens, known tokens of the head, their base score, model score, and (text, word, count) of the other words.

        ``levels`` are those read of ``asked``; ``unseen`` is the probability left to single words, by level of the context.
        """
        token, values, n = self.token, VALUES[levels], len(self.exact)
        counts, pairs = values[:n], values[n:]
        if counts[-1] == 0:
            counts[-1] = totals.documents
        single, left = (counts + 0.1) / totals.scale, unseen[self.levels]
        base_of = np.where(self.exact >= 0, np.log10((np.maximum(self.exact, 0) + 0.1) / totals.scale), 0)
        model = np.empty(len(token))
        for k in range(0, len(token), LOOKED_UP):
            own = slice(k, k + LOOKED_UP)
            pair, before = pairs[self.pair[own]], self.before[own]
            share = np.minimum(pair / np.maximum(counts[before], np.maximum(pair, 1)), 1)
            model[own] = np.log10(TRUST * share + left[before] * single[token[own]])
        starts = np.cumsum(self.sizes) - self.sizes
        rest = np.flatnonzero((self.exact < 0)[token])
        text = np.searchsorted(starts, rest, side="right") - 1
        keys, times = np.unique(text << 32 | token[rest], return_counts=True)
        return self.sizes, np.add.reduceat((self.exact > 0).astype(np.int64)[token], starts), np.add.reduceat(base_of[token], starts), np.add.reduceat(model, starts), keys >> 32, keys & 0xFFFFFFFF, times


@dataclass
class Model:
    """What every worker has; ``bloom`` where the filter is broadcast."""

    head: Broadcast
    unseen: np.ndarray
    totals: Totals
    bloom: Shards | None = None


def scored_schema(documents: DataFrame) -> str:
    return f"row long, doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens long, known long, base double, score double, others array<struct<token:binary,n:long>>"


def cut(texts: pa.Array, characters: int) -> Iterator[tuple[int, int]]:
    """Begin and end of pieces of about so many characters."""
    begin, sizes = 0, pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    while begin < len(sizes):
        end, size = begin, 0
        while end < len(sizes) and size < characters:
            size += sizes[end]
            end += 1
        yield begin, end
        begin = end


def scored_batch(piece: Piece, levels: np.ndarray, model: Model, row: pa.Array, ids: pa.Array) -> pa.RecordBatch:
    sizes, known, base, score, text, word, count = piece.scores(levels, model.unseen, model.totals)
    offsets = pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32())
    others = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([piece.words.take(pa.array(word, pa.int64())), pa.array(count, pa.int64())], ["token", "n"]))
    return pa.RecordBatch.from_arrays([row, ids, pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score), others], names=["row", "doc_id", "n_tokens", "known", "base", "score", "others"])


def scored_here(batches: Iterator[pa.RecordBatch], model: Model, piece: int) -> Iterator[pa.RecordBatch]:
    """Scores from the filter that this worker has."""
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for begin, end in cut(texts, piece):
            some = Piece(texts.slice(begin, end - begin).to_pylist(), model.head.value)
            yield scored_batch(some, model.bloom.level(some.asked), model, pa.array(np.arange(row, row + end - begin), pa.int64()), ids.slice(begin, end - begin))
            row += end - begin


def packed(h: np.ndarray) -> bytes:
    """Hashes byte by byte, high bytes first: of sorted ones those are nearly the same."""
    return h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEPT].T.tobytes()


def unpacked(cells: list[bytes]) -> np.ndarray:
    """Hashes of packed ones, as far as the filter goes by them."""
    ends = np.cumsum([0, *(len(c) // KEPT for c in cells)])
    out = np.zeros((ends[-1], 8), np.uint8)
    for cell, low, high in zip(cells, ends, ends[1:]):
        out[low:high, :KEPT] = np.frombuffer(cell, np.uint8).reshape(KEPT, -1).T
    return out.view(">u8").reshape(-1).astype(U)


def probed(part: Filter, cells: list[bytes]) -> pa.Array:
    """The levels, a byte each, of each cell's packed hashes. All are read at once: a piece asks a chunk for the fewer, the more chunks there are."""
    levels = part.level(unpacked(cells), 1).astype(np.uint8)
    offsets = np.cumsum([0, *(len(c) // KEPT for c in cells)], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(offsets), pa.py_buffer(levels)])


def scored_by_shard(rows: DataFrame, table: DataFrame, shards: int, model: Model, schema: str) -> tuple[DataFrame, DataFrame]:
    """Scores from a filter that stays a table (s, bits, k), and the pieces, to be discarded once scores are written."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = piece = TaskContext.get().partitionId() << 36
        for batch in batches:
            for begin, end in cut(batch.column("text"), PIECE):
                n = end - begin
                yield pa.RecordBatch.from_arrays([pa.array([piece] * n, pa.int64()), pa.array(np.arange(row, row + n), pa.int64()), batch.column("doc_id").slice(begin, n), batch.column("text").slice(begin, n)], names=["piece", "row", "doc_id", "text"])
                row, piece = row + n, piece + 1

    dealt = materialize(rows.mapInArrow(deal, f"piece long, row long, doc_id {kind}, text string"), "pieces")
    # a shard in parts of whole segments, so that a task's n-grams are bounded and no segment is sent twice
    size = dealt.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = min(SEGMENTS, 1 << max(0, math.ceil(math.log2(max(1, size / 4 / shards / PROBED)))))
    width, chunks = SEGMENTS // parts, shards * parts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n-grams of the texts of a piece that lie in one batch, by chunk; row, n: the first of these texts, and how many."""
        for batch in batches:
            pieces, row, texts = np.array(batch.column("piece").to_pylist(), np.int64), batch.column("row").to_pylist(), batch.column("text").to_pylist()
            for piece in np.unique(pieces).tolist():
                own = np.flatnonzero(pieces == piece)
                h = Piece([texts[i] for i in own], model.head.value).asked
                h = h[in_order(h)]
                ends = np.append(np.searchsorted(Filter.segment(h, shards) // width, np.arange(chunks)), len(h))
                full = np.flatnonzero(ends[1:] > ends[:-1]).tolist()
                kinds = [([piece] * len(full), pa.int64()), ([row[own[0]]] * len(full), pa.int64()), ([len(own)] * len(full), pa.int32()), (full, pa.int32()), ([packed(h[ends[k] : ends[k + 1]]) for k in full], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in kinds], names=["piece", "row", "n", "chunk", "h"])

    asked = dealt.select("piece", "row", "text").mapInArrow(ask, "piece long, row long, n int, chunk int, h binary")
    segments = table.select(F.floor(F.col("s") / width).cast("int").alias("chunk"), "s", "bits")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        found = sorted(zip(right["s"].to_pylist(), right["bits"].to_pylist()))
        size = len(found[0][1]) if found else 8
        bits = np.zeros((width, size), np.uint8)
        for s, b in found:
            bits[s % width] = np.frombuffer(b, np.uint8)
        levels = probed(Filter(bits.reshape(-1), {1: 1}, shards, width), left["h"].to_pylist())
        return left.drop_columns(["h"]).append_column("levels", levels)

    # one byte a number goes back: a piece asks again in the same order
    answers = asked.groupBy("chunk").cogroup(segments.groupBy("chunk")).applyInArrow(probe, "piece long, row long, n int, chunk int, levels binary")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        left, given = left.sort_by("row").combine_chunks(), {}
        rows, texts = left["row"].to_pylist(), left["text"].to_pylist()
        for row, n, chunk, levels in zip(*(right[c].to_pylist() for c in ("row", "n", "chunk", "levels"))):
            given.setdefault((row, n), []).append((chunk, levels))
        out = []
        for (row, n), parts in sorted(given.items()):
            at = bisect_left(rows, row)
            read = np.frombuffer(b"".join(x for _, x in sorted(parts)), np.uint8)
            own, some = left.slice(at, n).combine_chunks(), Piece(texts[at : at + n], model.head.value)
            if len(read) != len(some.asked):
                raise ValueError(f"{len(read)} answers to {len(some.asked)} n-grams")
            levels = np.empty(len(read), np.int64)
            levels[in_order(some.asked)] = read
            out.append(scored_batch(some, levels, model, own["row"].chunk(0), own["doc_id"].chunk(0)))
        if sum(b.num_rows for b in out) != left.num_rows:
            raise ValueError(f"{sum(b.num_rows for b in out)} texts of {left.num_rows} have answers")
        return pa.Table.from_batches(out)

    return dealt.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(score, schema), dealt


def score_documents(documents: DataFrame, training: Callable[[Column], Column] = is_training, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Scores are the same whether the filter is broadcast (up to ``broadcast`` shards) or not.

    Tokens are the words of the text, A-Z in lower case, and one end; counts are over documents for which ``training`` holds
    (a null doc_id trains). Null and empty texts are one end. Repeated rows count and are scored as often as they occur. An empty
    table gives no rows; other columns are not read.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", "text")
    texts = rows.where(training(F.col("doc_id")))
    vocabulary = materialize(count_words(texts), "vocabulary")
    n, v, docs = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("token") == F.lit(END), F.col("c"))), F.lit(0))).first()
    totals = Totals(n, v, docs)
    enough = least_count_for_head(vocabulary)
    head = spark.sparkContext.broadcast(head_of(vocabulary.where(F.col("c") >= enough)))
    pairs = materialize(count_pairs(texts, head, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // GROUP)), "pairs")
    unseen = np.ones(len(LEVELS) + 1)
    for r in pairs.where("h is null").select("bucket").distinct().collect():
        unseen[r["bucket"]] = 1 - TRUST
    held = pairs.where("h is not null")
    shards, bits = shape(entries_of(vocabulary) + entries_of(held))
    table = build_filter(hashed(vocabulary).unionByName(held.select("h", "c")), shards, bits)
    discard(pairs)
    model = Model(head, unseen, totals)
    if shards <= broadcast:
        model.bloom = Shards([spark.sparkContext.broadcast(part) for part in gathered(table, shards, bits)])
        scored = rows.mapInArrow(lambda batches: scored_here(batches, model, PIECE * min(PIECES, shards)), scored_schema(documents))
    else:
        scored, pieces = scored_by_shard(rows, table, shards, model, scored_schema(documents))
    scored = materialize(scored, "scores")
    discard(table)
    if shards > broadcast:
        discard(pieces)
    others = scored.select("row", F.explode("others").alias("o")).select("row", "o.token", "o.n").join(vocabulary, "token", "left")
    c = F.coalesce("c", F.lit(0))
    rest = others.groupBy("row").agg(F.sum(F.col("n") * F.log10((c + 0.1) / totals.scale)).alias("rest"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rest_known"))
    found = scored.drop("others").join(rest, "row", "left")
    return found.select(
        "doc_id", (~training(F.col("doc_id"))).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
    )


def least_count_for_head(vocabulary: DataFrame) -> int:
    """The least count from which on at most HEAD words are left."""
    total, least = 0, LEVELS[-1]
    for low, _, n in reversed(by_size(vocabulary)):
        total += n
        if total > HEAD:
            break
        least = low
    return least

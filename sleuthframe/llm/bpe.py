"""Byte-level BPE: encoding by reuse of content-defined chunks, and decoding.

A rolling hash over bytes cuts texts into chunks at places that depend on the content only, so passages that documents share
fall into equal chunks. Documents that share a line are brought next to each other, and a worker encodes a chunk once for as long
as its table of chunks, of bounded size, holds it; a chunk that other workers meet too is encoded there again. Where two chunks meet, the text between the last place in the one
and the first place in the other at which every pre-tokenization has a boundary is encoded again; if a chunk has no such
place, the stretch grows over further chunks. The result agrees exactly with encoding the whole text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import byte_letters

#: Fixed value: how byte-level vocabularies of this kind split text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Both libraries class these characters alike; a stretch with any other is left to ``tokenizers``.
UNUSUAL = re.compile("[^\x00-ɏͰ-ͳΑ-ΡΣ-ϿЀ-ӿ‐-‧€ぁ-ゖァ-ヺ一-鿌가-힣\U0001f300-\U0001f64f]")
#: A pre-token never crosses from a visible character to white space.
CERTAIN = re.compile(r"\S(?=[ \n\t\r])")

CHUNK_BITS = 9
LEAST_CHUNK = 64
#: Token identifiers that a worker keeps in each of its two generations of chunks, and joins in its table of joins.
KEPT_IDS = 6_000_000
KEPT_JOINS = 200_000


class Vocabulary:
    """Encodes and decodes as the ``tokenizers`` library does with the file at ``path`` and no special tokens added."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding(), self.whole.no_truncation()
        self.fast = tiktoken.Encoding("ordinary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.bytes = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.bytes}

    def ordinary(self, text: str) -> np.ndarray:
        """Identifiers of a stretch without special strings."""
        if UNUSUAL.search(text) is not None:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    def encode(self, text: str, ordinary=None) -> np.ndarray:
        """``ordinary``: encodes the stretches between special strings, by default each as a whole."""
        ordinary = ordinary or self.ordinary
        if not any(s in text for s in self.special):
            return ordinary(text)
        parts = [np.array([self.special[p]], np.uint32) if p in self.special else ordinary(p) for p in self.splitter.split(text) if p]
        return np.concatenate(parts)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def gear(n: int = 256) -> np.ndarray:
    """A random-looking 32-bit number for each byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(n)], np.uint32)


GEAR = gear()


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of UTF-8 text, the last one included; an end depends on the 16 bytes before it and on the end before it."""
    b = np.frombuffer(data, np.uint8)
    h = GEAR[b]
    for w in (1, 2, 4, 8):  # h covers w bytes, and then 2 * w
        wide = h.copy()
        wide[w:] += h[:-w] << np.uint32(w)
        h = wide
    ends, last = [], 0
    for p in (np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + 1).tolist():
        if p - last >= LEAST_CHUNK and p < len(data) and data[p] & 0xC0 != 0x80:
            ends.append(p)
            last = p
    return [*ends, len(data)]


class ChunkEncoder:
    """Encodes text chunk by chunk and keeps what it has encoded."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.new: dict[bytes, tuple[int, int, np.ndarray] | None] = {}
        self.old: dict[bytes, tuple[int, int, np.ndarray] | None] = {}
        self.size = 0
        self.joins: dict[str, np.ndarray] = {}
        self.encoded = self.reused = 0

    def encode(self, text: str) -> np.ndarray:
        return self.vocabulary.encode(text, self.by_chunks)

    def by_chunks(self, text: str) -> np.ndarray:
        data = text.encode()
        if len(data) < 2 * LEAST_CHUNK:
            return self.join(text)
        out, pending, begin = [], [], 0
        for end in chunk_ends(data):
            chunk = data[begin:end]
            begin = end
            found = self.chunk(chunk)
            if found is None:  # no certain boundary: the stretch goes on
                pending.append(chunk)
                continue
            first, last, ids = found
            out += [self.join(b"".join([*pending, chunk[:first]]).decode()), ids]
            pending = [chunk[last:]]
        return np.concatenate([*out, self.join(b"".join(pending).decode())])

    def chunk(self, chunk: bytes) -> tuple[int, int, np.ndarray] | None:
        """Where the first and the last certain boundary are, and the identifiers between them."""
        key = xxhash.xxh3_128_digest(chunk)
        if key in self.new:
            self.reused += 1
            return self.new[key]
        if key in self.old:
            self.reused += 1
            found = self.old[key]
        else:
            self.encoded += 1
            found, text = None, chunk.decode()
            if (m := CERTAIN.search(text)) is not None:
                first, back = m.end(), 64
                while not (later := [x.end() for x in CERTAIN.finditer(text, max(0, len(text) - back))]):
                    back *= 4
                ids = self.vocabulary.ordinary(text[first : later[-1]])
                found = len(text[:first].encode()), len(text[: later[-1]].encode()), ids
        self.size += 20 if found is None else 20 + len(found[2])
        if self.size > KEPT_IDS:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[key] = found
        return found

    def join(self, text: str) -> np.ndarray:
        found = self.joins.get(text)
        if found is None:
            found = self.vocabulary.ordinary(text)
            if len(text) <= 64:
                if len(self.joins) >= KEPT_JOINS:
                    self.joins.clear()
                self.joins[text] = found
        return found


@functools.lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(vocabulary(path))


#: Characters of a line from which on documents that share it may be copies.
TELLING = 20


def near_each_other(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with documents that share the least hash of their lines next to each other.

    Copies and near copies so meet in one worker, and a group of any size is spread over as many partitions as it fills. Blank and
    short lines, which all kinds of texts have, tell nothing; a text without others goes by its own hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    telling = F.filter(F.split(text, "\n"), lambda line: F.length(F.trim(line)) >= TELLING)
    key = F.coalesce(F.array_min(F.transform(telling, lambda line: F.xxhash64(line))), F.xxhash64(text))
    return documents.select("doc_id", text.alias("text"), key.alias("least")).repartitionByRange("least", "doc_id", F.length("text")).drop("least")


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and the token identifiers of ``text`` as array<int>. Null and empty texts have no tokens; repeated rows are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column("text").to_pylist()]
            column = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], names=["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return near_each_other(documents).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of ``ids``; null identifiers give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = vocabulary(path).decode
        for batch in batches:
            texts = pa.array([back(x or []) for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the decimal identifiers joined by commas and of the text decoded from them.

    Null and empty texts have no tokens; repeated rows and null doc_ids are kept; other columns are not read; an empty table gives
    no rows. Texts of any length go chunk by chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocab = chunk_encoder(path), vocabulary(path)
        decimal = vocab.decimal.__getitem__
        for batch in batches:
            counts, digests, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encoder.encode(text).tolist()
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(vocab.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return near_each_other(documents).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Token counts by heap-and-linked-list byte-pair merging.

The number of tokens of a word is its number of initial symbols minus the merges done; no token identifiers are made.
Words repeat, so each worker keeps a bounded table of the counts it has found.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .tables import column_name

#: Words in a worker's table; when it is full it becomes the older table, which is read only, and a new one begins.
REMEMBERED_WORDS = 500_000
#: Longer words are counted each time.
REMEMBERED_LENGTH = 64


class Merges:
    """The merges of a vocabulary, by number: ``rank[a << 20 | b]`` of a pair of symbols, ``pair[rank]`` and the symbol it makes."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.pair = [vocab[a] << 20 | vocab[b] for a, b in merges]
        self.makes = [vocab[a + b] for a, b in merges]
        self.rank = {pair: i for i, pair in enumerate(self.pair)}

    def left(self, symbols: list[int]) -> int:
        """How many symbols are left when the lowest-ranked adjacent pair, leftmost first, is merged until none has a rank.

        The heap holds rank * n + place; an entry is stale if the pair at its place is no longer the pair of its rank.
        """
        n = left = len(symbols)
        rank = self.rank.get
        heap = [r * n + i for i in range(n - 1) if (r := rank(symbols[i] << 20 | symbols[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        symbols, after, before = [*symbols, -1], list(range(1, n + 2)), list(range(-1, n))
        pop, push, pair, makes = heapq.heappop, heapq.heappush, self.pair, self.makes
        while heap:
            r, i = divmod(pop(heap), n)
            j = after[i]
            if j >= n or symbols[i] < 0 or symbols[i] << 20 | symbols[j] != pair[r]:
                continue
            symbols[i], symbols[j] = makes[r], -1
            after[i] = k = after[j]
            before[k] = i
            left -= 1
            if k < n and (r2 := rank(symbols[i] << 20 | symbols[k])) is not None:
                push(heap, r2 * n + i)
            if (k := before[i]) >= 0 and (r2 := rank(symbols[k] << 20 | symbols[i])) is not None:
                push(heap, r2 * n + k)
        return left


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: visible Latin-1 stands for itself, the others follow from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class WordCounter:
    """Counts the tokens of texts for a byte-level vocabulary file whose model marks word ends.

    Special strings inside a text are one token each, the rest is normalized and split as the file's own normalizer and
    pattern say, and each piece is counted by :func:`merged_length`.
    """

    #: Outside these code points str.lower, str.split and the ``regex`` module may differ from the tokenizer's own normalizer and splitter.
    unusual = re.compile("[^\\x00-\\x1b\\x20-\u012f\u0131-\u024f\u2010-\u2027\u20ac]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, letters, suffix = model["vocab"], byte_letters(), model.get("end_of_word_suffix") or ""
        self.merges = Merges(vocab, [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]])
        #: Symbols of each byte inside a piece and at its end, and the byte of each letter.
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + suffix] for c in letters]
        self.byte = {c: b for b, c in enumerate(letters)}
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) or r"(?!)")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.piece = regex.compile(split["pattern"]["Regex"])
        self.seen: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def count_bytes(self, piece: bytes) -> int:
        inner = self.inner
        symbols = [inner[b] for b in piece]
        symbols[-1] = self.last[piece[-1]]
        return self.merges.left(symbols)

    def count_word(self, word: str) -> int:
        """Tokens of a run without white space."""
        found = self.older.get(word)
        if found is None:
            found = self.count_bytes(word.encode()) if word.isalpha() else sum(self.count_bytes(p.encode()) for p in self.piece.findall(word))
        if len(word) <= REMEMBERED_LENGTH:
            if len(self.seen) >= REMEMBERED_WORDS:
                self.older, self.seen = self.seen, {}
            self.seen[word] = found
        return found

    def count_ordinary(self, text: str) -> int:
        if self.unusual.search(text) is None:
            # NFC leaves these code points as they are, and white space ends every piece
            words = text.lower().split()
            get, total, missing = self.seen.get, 0, []
            for w, n in zip(words, map(get, words)):
                if n is None:
                    missing.append(w)
                else:
                    total += n
            return total + sum(map(self.count_word, missing))
        pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return sum(self.count_bytes(bytes(map(self.byte.__getitem__, p))) for p, _ in pieces)

    def count(self, text: str) -> int:
        total = at = 0
        for found in self.special.finditer(text):
            total, at = total + self.count_ordinary(text[at : found.start()]) + 1, found.end()
        return total + self.count_ordinary(text[at:] if at else text)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", output: str = "n_tokens") -> DataFrame:
    """``df`` with a long column ``output``: the tokens of ``text`` under the vocabulary file, no special tokens added.

    A null or empty text has 0 tokens. Repeated rows are kept, other columns stay as they are (an old ``output`` is replaced),
    and an empty table stays empty.
    """
    df = df.drop(output)
    kept = list(df.columns)
    schema = StructType([*df.schema.fields, StructField(output, LongType(), False)])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            counts = pa.array([count(t) if t else 0 for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=[*kept, output])

    return df.mapInArrow(run, schema)


def report(documents: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens and whether there are more than ``limit`` tokens. Null text: empty."""
    size = column_name(documents, "n_bytes")
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = counts_only(documents.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias(size)), vocabulary)
    return counted.select("doc_id", F.col(size).alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def counts_only(df: DataFrame, vocabulary: str) -> DataFrame:
    """As :func:`token_counts`, without sending the text back from the workers."""
    others = [f for f in df.schema.fields if f.name != "text"]
    schema = StructType([*others, StructField("n_tokens", LongType(), False)])
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            counts = pa.array([count(t) if t else 0 for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), counts], names=[*names, "n_tokens"])

    return df.mapInArrow(run, schema)

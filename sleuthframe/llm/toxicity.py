"""Toxicity by gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities of a seed lexicon and of a lexicon learned from labelled rows (words and word beginnings that toxic
documents hold far more often), how near second-person words stand to its words, capitals, punctuation and obfuscation rates.
The lexicon, the trees and the calibration are fitted on bounded samples of the labelled rows of either class, weighted so that
classes count as often as they occur; the rows that calibrate teach neither lexicon nor trees. Scoring is one pass without shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .tables import discard, materialize

#: Labelled rows of each class used at most (clean, toxic), taken by hash of doc_id from those whose documents are there.
SAMPLE = (8_000, 4_000)
#: Entries of the learned lexicon at most.
LEXICON = 5_000
THRESHOLD = 0.3

# Mild insults and second-person words of the four languages.
SEEDS = frozenset("idiot moron stupid dumb loser scum trash clown pathetic worthless disgusting hate ugly fool idiota imbécil estúpido tonto basura dumm blöd trottel abschaum müll stupide imbécile crétin ordure débile".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tú tu te ti tus usted ustedes vosotros du dich dir dein deine euch ihr vous votre vos toi ton ta tes".split())
LEET = str.maketrans("013457@$!", "oieastasi", "*._-#'’")
VOWELS = re.compile("[aeiouáéíóúàèìòùâêîôûäëïöüy]")

WORD = re.compile(r"[^\W\d_]+")
#: Signs inside a word, and letters apart from each other; letters apart always hold what LETTERS_APART_PART finds fast.
SIGNS = re.compile(r"(?<=[^\W\d_])[*@$!#0-9_]+(?=[^\W\d_])")
LETTERS_APART = re.compile(r"(?<!\w)[^\W\d_](?:[.\- ][^\W\d_]){3,}(?!\w)")
LETTERS_APART_PART = re.compile(r"[.\- ][^\W\d_][.\- ][^\W\d_][.\- ]")
LETTERS = re.compile(r"[^\W\d_]*")
TRIPLED = re.compile(r"([^\W\d_])\1\1")
RUN = re.compile(r"(.)\1+")
SHOUTS = re.compile(r"[!?]{2,}")
#: Lengths of the word beginnings that are learned.
STEM_LENGTHS = (4, 5, 6, 8)
#: Capitals and letters of the first plane.
CAPITAL, LETTER = (np.array([f(chr(i)) for i in range(1 << 16)]) for f in (str.isupper, str.isalpha))
REMEMBERED_WORDS = 500_000

NAMES = (
    "log_words", "seed_rate", "seed_hits", "lexicon_hits", "lexicon_rate", "distinct_hits", "highest_weight", "mean_weight", "hits_in_window",
    "second_person_rate", "proximity", "near_hits", "capitals", "shouted_words", "exclamations", "questions", "punctuation", "digits", "shout_marks",
    "obfuscated_rate", "obfuscated_hits", "stretched",
)


def stems(word: str, lengths: tuple[int, ...] = STEM_LENGTHS) -> list[str]:
    """The word, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in lengths if len(word) >= n)]


class Lexicon:
    """Weights of words; a word has the greatest weight of itself and its beginnings."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.lengths = tuple(sorted({len(w) - 1 for w in weights if w[-1] == "*"}))
        self.skeletons = {VOWELS.sub("", s) for s in (*SEEDS, *(w for w in weights if w[-1] != "*")) if len(s) >= 5}
        self.squeezed = {RUN.sub(r"\1", w): v for w, v in weights.items() if w[-1] != "*"}
        self.seen: dict[str, float] = {}

    def __reduce__(self):
        return Lexicon, (self.weights,)

    def weight(self, word: str) -> float:
        found = max((self.weights.get(s, 0.0) for s in stems(word, self.lengths)), default=0.0)
        if TRIPLED.search(word):
            found = max(found, self.squeezed.get(RUN.sub(r"\1", word), 0.0))
        if len(self.seen) >= REMEMBERED_WORDS:
            self.seen.clear()
        if len(word) <= 64:
            self.seen[word] = found
        return found

    def weights_of(self, words: list[str]) -> list[float]:
        found = list(map(self.seen.get, words))
        return [self.weight(w) if v is None else v for w, v in zip(words, found)] if None in found else found

    def hidden(self, token: str) -> bool:
        """Whether an obfuscated token stands for a word of the lexicon."""
        plain = token.lower().replace(" ", "").translate(LEET)
        return plain in SEEDS or self.weight(plain) > 0 or VOWELS.sub("", plain) in self.skeletons


def features(text: str, lexicon: Lexicon) -> list[float]:
    tokens = WORD.findall(text)
    n = len(tokens)
    per = 1 / max(n, 1)
    words = list(map(str.lower, tokens))
    weights = lexicon.weights_of(words)
    hits = [i for i, w in enumerate(weights) if w]
    seeds = sum(map(SEEDS.__contains__, words))
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON] if hits else []
    near = gaps(hits, second)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    data = np.bincount(np.minimum(codes, 255), minlength=256)
    plane = np.minimum(codes, 0xFFFF)
    letters = max(1, int(LETTER[plane].sum()))
    size = max(1, len(text))
    hidden = obfuscated(text)
    same = codes[1:] == codes[:-1]
    stretched = len(TRIPLED.findall(text)) if (same[1:] & same[:-1]).any() else 0
    shouting = (codes == 33) | (codes == 63)
    shouts = len(SHOUTS.findall(text)) if (shouting[1:] & shouting[:-1]).any() else 0
    window = max((j + 1 - k for j, k in windows(hits, 50)), default=0)
    values = [weights[i] for i in hits]
    return [
        math.log1p(n), seeds * per, seeds, len(hits), len(hits) * per, len({words[i] for i in hits}), max(values, default=0.0), sum(values) / len(values) if values else 0.0, window,
        (len(second) if hits else sum(map(SECOND_PERSON.__contains__, words))) * per, 1 / (1 + min(near)) if near else 0.0, sum(g <= 10 for g in near), int(CAPITAL[plane].sum()) / letters, sum(len(t) > 2 for t in compress(tokens, map(str.isupper, tokens))) * per,
        int(data[33]) * per, int(data[63]) * per, int(data[33:48].sum() + data[58:65].sum() + data[91:97].sum()) / size, int(data[48:58].sum()) / size, shouts * per,
        len(hidden) * per, sum(map(lexicon.hidden, hidden)), stretched * per,
    ]


def obfuscated(text: str) -> list[str]:
    """Words with signs or digits among their letters, and letters set apart by dots, hyphens or blanks."""
    found, end = [], -1
    for m in SIGNS.finditer(text):
        after = LETTERS.match(text, m.end()).end()
        if m.start() == end:  # the word goes on
            found[-1] += text[m.start() : after]
        else:
            begin = m.start()
            while begin > 0 and text[begin - 1].isalpha():
                begin -= 1
            found.append(text[begin:after])
        end = after
    return found + LETTERS_APART.findall(text) if LETTERS_APART_PART.search(text) else found


def gaps(hits: list[int], others: list[int]) -> list[int]:
    """For each hit the distance to the nearest of ``others``; both rise."""
    if not hits or not others:
        return []
    at = np.searchsorted(others, hits)
    o, h = np.array(others), np.array(hits)
    return np.minimum(np.abs(h - o[np.minimum(at, len(o) - 1)]), np.abs(h - o[np.maximum(at - 1, 0)])).tolist()


def windows(hits: list[int], width: int) -> Iterator[tuple[int, int]]:
    k = 0
    for j, at in enumerate(hits):
        while at - hits[k] >= width:
            k += 1
        yield j, k


def with_features(df: DataFrame, lexicon: Broadcast, output: str, keep_text: bool) -> DataFrame:
    kept = [f for f in df.schema.fields if keep_text or f.name != "text"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t or "", lexicon.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows, pa.list_(pa.float64()))], names=[*names, output])

    return df.mapInArrow(run, StructType([*kept, StructField(output, ArrayType(DoubleType()))]))


def part(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def held_out(doc_id: Column) -> Column:
    return F.coalesce(part(doc_id, 4) == 2, F.lit(False))


def learn_lexicon(rows: DataFrame, toxic: int, clean: int, weight: float) -> dict[str, float]:
    """Log-odds of words and beginnings that toxic rows (text, toxic) hold far more often.

    Counts are of documents, ``toxic`` and ``clean`` those of all rows; a clean one stands for ``weight`` times as many as a toxic one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = set(map(str.lower, WORD.findall(text or "")))
                counts[label].update({s for w in words if 3 <= len(w) <= 40 for s in stems(w)})
        for stem_counts, label in zip(counts, (0, 1)):
            items = list(stem_counts.items())
            for k in range(0, len(items), 50_000):
                some = items[k : k + 50_000]
                n = pa.array([c for _, c in some], pa.int64())
                zero = pa.array([0] * len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in some], pa.string()), *((zero, n) if label else (n, zero))], names=["stem", "clean", "toxic"])

    counts = rows.select("text", "toxic").mapInArrow(count, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    rare = max(3, toxic // 400)  # a word by chance only in toxic documents has fewer
    found = counts.withColumn("weight", odds).where((F.col("toxic") >= rare) & (F.col("weight") > 2.5) & (F.col("toxic") > weight * F.col("clean")))
    return {r["stem"]: r["weight"] for r in found.orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "stem").limit(LEXICON).collect()}


@dataclass
class Model:
    """Scores texts; where only one class was seen, ``rate`` is the score of every text."""

    lexicon: Broadcast
    trees: Any
    isotonic: Any
    rate: float

    def transform(self, documents: DataFrame, keep_text: bool = True) -> DataFrame:
        """``documents`` with score and predicted; columns of these names are replaced."""
        documents = documents.drop("score", "predicted")
        kept = [c for c in documents.columns if keep_text or c != "text"]
        if self.trees is None:
            scored = documents.select(*kept, F.lit(self.rate).alias("score"))
        else:
            # the row goes through the model in a struct, so its column names can't clash
            found = with_features(documents.select(F.struct(*kept).alias("row"), "text"), self.lexicon, "values", False)
            raw = self.trees.transform(found.select("row", array_to_vector("values").alias("features")))
            raw = raw.select("row", vector_to_array("probability")[1].alias("raw"))
            fitted = self.isotonic.transform(raw).withColumn("score", 0.999 * F.least(F.greatest("fitted", F.lit(0.0)), F.lit(1.0)) + 0.001 * F.col("raw"))
            scored = fitted.select("row.*", "score")
        return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def sampled(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, calibrates) of at most ``SAMPLE`` labelled documents of each class that are not held out, and the numbers of all.

    Every third of a class in order of hash calibrates, from the second on, so two rows of a class are one of each part. A doc_id
    labelled more than once is toxic if any label says so.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).join(documents.select("doc_id"), "doc_id", "left_semi")
    usable = materialize(usable, "usable-labels")
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    clean, toxic = (usable.where(F.col("toxic") == c).orderBy(*by_hash).limit(SAMPLE[c]) for c in (0, 1))
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64(F.lit(3), F.col("doc_id")), "doc_id"))
    chosen = materialize(clean.unionByName(toxic).withColumn("calibrates", place % 3 == 2), "labels")
    discard(usable)
    return chosen, counts


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels.toxic`` from labelled documents that are not held out; without any of one class, every text gets the rate of the other."""
    spark = documents.sparkSession
    chosen, counts = sampled(documents, labels)
    # at most the sum of SAMPLE rows of three short fields
    rows = materialize(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")
    found = {(r["toxic"], r["calibrates"]): r["count"] for r in rows.groupBy("toxic", "calibrates").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    rate = toxic / max(1, toxic + clean)
    if not toxic or not clean:
        return Model(spark.sparkContext.broadcast(Lexicon({})), None, None, rate)
    # what calibrates is never what teaches; a class of one row only teaches, and scores then stay as the trees give them
    teaching = rows.where("not calibrates")
    of = {c: sum(n for (k, calibrates), n in found.items() if k == c and not calibrates) for c in (0, 1)}
    # a row of the sample stands for so many of its class, by the least of the two
    stands = {c: counts[c] / min(counts[c], SAMPLE[c]) for c in (0, 1)}
    lexicon = spark.sparkContext.broadcast(Lexicon(learn_lexicon(teaching, of[1], of[0], stands[0] / stands[1])))
    weight = F.when(F.col("toxic") == 1, stands[1] / min(stands.values())).otherwise(stands[0] / min(stands.values()))
    measured = with_features(rows, lexicon, "values", False).select(F.col("toxic").cast("double").alias("label"), weight.alias("weight"), array_to_vector("values").alias("features"), "calibrates")
    measured = materialize(measured, "features").coalesce(4).cache()
    part, other = measured.where("not calibrates"), measured.where("calibrates")
    least = max(1, min(5, of[1] // 4))
    trees = GBTClassifier(maxIter=25, maxDepth=3, stepSize=0.2, subsamplingRate=0.8, maxBins=32, seed=11, featuresCol="features", labelCol="label", weightCol="weight", minInstancesPerNode=least).fit(part)
    raw = trees.transform(other).select("label", "weight", vector_to_array("probability")[1].alias("raw"))
    if any((c, True) not in found for c in (0, 1)):
        raw = spark.createDataFrame([(float(x), 1.0, float(x)) for x in (0, 1)], raw.schema)
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="fitted").fit(raw)
    measured.unpersist()
    for made in (rows, chosen):
        discard(made)
    return Model(lexicon, trees, isotonic, rate)


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that a model, fitted on the labelled ones among them, does not call toxic, all columns as they are.

    Null and empty texts have no toxic word and are scored as such; repeated rows stay or go together; a null doc_id is scored like
    any other; columns may have any names, those of the model too. An empty table stays empty.
    """
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), "text")
    return fit(documents, labels).transform(rows, keep_text=False).where("predicted = 0").select("row.*")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.3) of every document.

    Null and empty texts are scored by their features, all 0. Labels that are null, neither 0 nor 1, or of no document are not used;
    without labels of both classes every score is the share of toxic ones, 0 without any.

    Repeated rows get equal scores, a null doc_id is not held out, and an empty table stays empty.
    """
    scored = fit(documents, labels).transform(documents.select("doc_id", "text"), keep_text=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

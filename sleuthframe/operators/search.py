"""Keyword, vector and hybrid search with deterministic ranking."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names under which apps are found.
APP_ALIASES = {
    "whatsapp": ("WhatsApp", "WA", "com.whatsapp"), "wa": ("WhatsApp", "WA", "com.whatsapp"),
    "instagram": ("Instagram", "IG", "com.instagram"), "ig": ("Instagram", "IG", "com.instagram"), "insta": ("Instagram", "IG", "com.instagram"),
    "messenger": ("Messenger", "facebook messenger", "com.facebook.orca"), "facebook messenger": ("Messenger", "facebook messenger", "com.facebook.orca"),
    "snapchat": ("Snapchat", "com.snapchat"), "snap": ("Snapchat", "com.snapchat"), "telegram": ("Telegram", "org.telegram"), "signal": ("Signal", "org.thoughtcrime.securesms"),
    "chrome": ("Chrome", "browser", "com.android.chrome"), "browser": ("Chrome", "browser", "com.android.chrome"),
    "sms": ("SMS", "messages", "text messages"), "text": ("SMS", "messages", "text messages"), "messages": ("SMS", "messages", "text messages"),
}
SYSTEM_FILE, DEVICE_FILE = "system|build|version|android|prop", "system|device|android|version|build"


def any_of(tests: Sequence[Column]) -> Column:
    return functools.reduce(operator.or_, tests) if tests else F.lit(True)


def holds(column: Column, value: str) -> Column:
    """Whether the text has the value in it, whatever the case; false for null."""
    return F.coalesce(F.contains(F.lower(column), F.lit(value.lower())), F.lit(False))


def check(limit: int, offset: int) -> None:
    if not 1 <= limit <= 500 or not 0 <= offset <= 100_000:
        raise ValueError("limit or offset out of bounds")


def page(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    check(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


def between(df: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    for bound, test in ((start, operator.ge), (end, operator.le)):
        if bound is not None:
            df = df.where(test(F.col("timestamp"), F.lit(bound).cast("timestamp_ntz")))
    return df


def search_messages(message: DataFrame, keywords: Sequence[str] = (), phones: Sequence[str] = (), start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    found = message.where(any_of([holds(F.col("content"), k) for k in keywords]) & any_of([holds(F.col(c), p) for p in phones for c in ("sender", "receiver")]))
    return between(found, start, end).select(F.lit("message").alias("type"), "id", "run_id", "timestamp", "content", F.concat_ws(" ", "sender", "receiver", "content").alias("searched"), F.lit(1.0).alias("relevance"))


def search_calls(call: DataFrame, phones: Sequence[str] = (), start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    found = between(call.where(any_of([holds(F.col(c), p) for p in phones for c in ("caller", "receiver")])), start, end)
    return found.select(F.lit("call").alias("type"), "id", "run_id", "timestamp", F.lit(None).cast("string").alias("content"), F.concat_ws(" ", "caller", "receiver").alias("searched"), F.lit(1.0).alias("relevance"))


def search_contacts(contact: DataFrame, keywords: Sequence[str] = (), phones: Sequence[str] = ()) -> DataFrame:
    found = contact.where(any_of([holds(F.col("name"), k) for k in keywords]) & any_of([holds(F.col("number"), p) for p in phones]))
    return found.select(F.lit("contact").alias("type"), "id", "run_id", F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit(None).cast("string").alias("content"), F.concat_ws(" ", "name", "number").alias("searched"), F.lit(1.0).alias("relevance"))


def search_media(media: DataFrame, media_type: str | None = None) -> DataFrame:
    found = media if media_type is None else media.where(F.col("media_type") == media_type)
    return found.select(F.lit("media").alias("type"), "id", "run_id", F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit(None).cast("string").alias("content"), F.coalesce("original_path", F.lit("")).alias("searched"), F.lit(1.0).alias("relevance"))


def app_filter(app: str) -> Column:
    """Whether a file belongs to an app, by any of the names it goes by; an unknown app is its own name."""
    names = APP_ALIASES.get(app.lower(), (app,))
    return any_of([holds(F.col(c), n) for n in names for c in ("filename", "category", "file_path")])


def search_artifacts(artifact: DataFrame, keywords: Sequence[str] = (), app: str | None = None, category: str | None = None) -> DataFrame:
    found = artifact.where(any_of([holds(F.col(c), k) for k in keywords for c in ("filename", "category", "data")]))
    if app:
        found = found.where(app_filter(app))
    if category and category != "any":
        found = found.where(any_of([holds(F.col(c), category) for c in ("category", "filename")]))
    return found.select(F.lit("artifact").alias("type"), "id", "run_id", F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit(None).cast("string").alias("content"), F.concat_ws(" ", "filename", "file_path").alias("searched"), F.lit(1.5).alias("relevance"))


def device_info(artifact: DataFrame, media: DataFrame, run: DataFrame) -> DataFrame:
    """What tells of the device: artifacts and files with telling names, and the case itself."""
    parts = [
        artifact.where(F.lower("filename").rlike(DEVICE_FILE)).select("run_id", "id", F.lit("artifact").alias("info_type"), F.col("filename").alias("info")),
        media.where(F.lower("original_path").rlike(SYSTEM_FILE)).select("run_id", "id", F.lit("system_file").alias("info_type"), F.col("original_path").alias("info")),
        run.select("run_id", F.col("run_id").alias("id"), F.lit("extraction_metadata").alias("info_type"), F.col("file_name").alias("info")),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def sampled_rows(data: Column, n: int = 5) -> Column:
    """The first rows of a JSON list of an artifact."""
    return F.slice(F.from_json(data, "array<string>", {"mode": "FAILFAST"}), 1, n)


def summarized_fields(data: Column, n: int = 5, width: int = 100) -> Column:
    """The first fields of a JSON object of an artifact, as (key, value) with values cut to ``width`` characters."""
    fields = F.slice(F.map_entries(F.from_json(data, "map<string,string>", {"mode": "FAILFAST"})), 1, n)
    return F.transform(fields, lambda f: F.struct(f["key"].alias("key"), F.substring(f["value"], 1, width).alias("value")))


def deduplicated(results: DataFrame) -> DataFrame:
    """One row for each type and id, that of the lowest ``source`` number."""
    w = Window.partitionBy("type", "id").orderBy("source")
    return results.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")


def ranked(results: DataFrame, keywords: Sequence[str], entities: Sequence[str], now: datetime) -> DataFrame:
    """``results`` with score: relevance, 0.2 for each keyword in the content, 0.3 for each entity anywhere, and up to 0.1 for a row of the last year."""
    score = F.col("relevance")
    for k in keywords:
        score = score + F.when(holds(F.col("content"), k), 0.2).otherwise(0.0)
    for e in entities:
        score = score + F.when(holds(F.col("searched"), e), 0.3).otherwise(0.0)
    age = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))) / 86_400_000_000)
    recent = F.when(F.col("timestamp").isNotNull(), F.greatest(F.lit(0.0), 1 - age / 365) * 0.1).otherwise(0.0)
    return results.withColumn("score", score + recent)


def term_score(text: Column, keywords: Sequence[str]) -> Column:
    """Share of the keywords that a text has, between 0 and 1: what stands in for the ranking of a search server."""
    return functools.reduce(operator.add, [F.when(holds(text, k), 1.0).otherwise(0.0) for k in keywords]) / len(keywords)


def similarities(vectors: DataFrame, query: Sequence[float], id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, similarity): cosine with the query in double precision, computed a batch at a time.

    Vectors of another length than the query, or with a null, NaN or infinite component, have no similarity and are left out;
    that of a vector of zeros is 0.
    """
    q = np.asarray(query, dtype=np.float64)
    if not np.isfinite(q).all():
        raise ValueError("the query has a component that is not finite")
    q = q / max(np.sqrt((q * q).sum()), 1e-300)
    kind = vectors.schema[id_column].dataType.simpleString()
    sound = (F.size(vector) == len(q)) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            x = np.asarray(lists.flatten(), dtype=np.float64).reshape(-1, len(q))
            norms = np.sqrt((x * x).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((x @ q) / np.maximum(norms, 1e-300))], names=["id", "similarity"])

    return vectors.select(id_column, vector).where(sound).mapInArrow(run, f"id {kind}, similarity double")


def semantic_search(vectors: DataFrame, query: Sequence[float], top_k: int = 10, threshold: float = 0.5, **columns: str) -> DataFrame:
    """The ``top_k`` nearest of those that are near enough."""
    return similarities(vectors, query, **columns).where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "id").limit(top_k)


def hybrid(keyword: DataFrame, semantic: DataFrame, semantic_weight: float = 0.6) -> DataFrame:
    """(id, score, method) of rows (id, keyword_score) and (id, similarity): a weighted sum, a missing side counting 0."""
    both = keyword.where("id is not null").join(semantic.where("id is not null"), "id", "full_outer")
    k, s = F.coalesce("keyword_score", F.lit(0.0)), F.coalesce("similarity", F.lit(0.0))
    method = F.when(F.col("keyword_score").isNull(), "semantic").when(F.col("similarity").isNull(), "keyword").otherwise("hybrid")
    return both.select("id", (semantic_weight * s + (1 - semantic_weight) * k).alias("score"), method.alias("method"))


TABLES, MODES = ("messages", "calls", "contacts", "media", "artifacts", "device_info"), ("keyword", "semantic", "hybrid")
#: Contacts go by name and media by path, all else newest first.
BY_NAME = ("contacts", "media")
RESULT = ("type", "id", "run_id", "timestamp", "content", "searched", "relevance")


@dataclass(frozen=True)
class Request:
    """What to search for: tables, mode, words, entities and filters; ``vector`` is the question as the index embeds it."""

    tables: tuple[str, ...]
    mode: str
    keywords: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    phones: tuple[str, ...] = ()
    start: datetime | None = None
    end: datetime | None = None
    app: str | None = None
    category: str | None = None
    media_type: str | None = None
    vector: tuple[float, ...] = ()
    threshold: float = 0.4
    limit: int = 100
    offset: int = 0

    def __post_init__(self):
        check(self.limit, self.offset)
        if not self.tables or (unknown := set(self.tables) - set(TABLES)):
            raise ValueError(f"tables must be some of {TABLES}" + (f", not {sorted(unknown)}" if self.tables else ""))
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")


def searched_table(evidence: Mapping[str, DataFrame], table: str, request: Request) -> DataFrame:
    words, phones, window = request.keywords, request.phones, (request.start, request.end)
    if table == "messages":
        return search_messages(evidence["message"], words, phones, *window)
    if table == "calls":
        return search_calls(evidence["call"], phones, *window)
    if table == "contacts":
        return search_contacts(evidence["contact"], words, phones)
    if table == "media":
        return search_media(evidence["media"], request.media_type)
    if table == "artifacts":
        return search_artifacts(evidence["artifact"], words, request.app, request.category)
    told = device_info(evidence["artifact"], evidence["media"], evidence["run"])
    return told.select(F.lit("device_info").alias("type"), "id", "run_id", F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit(None).cast("string").alias("content"), F.col("info").alias("searched"), F.lit(1.0).alias("relevance"))


def execute(evidence: Mapping[str, DataFrame], run_id: str, request: Request, now: datetime, index: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` rows of a case: (type, id, run_id, timestamp, content, method, combined, score), best first, then by type and id.

    Each table gives the page of its matches, newest first (contacts and media by name); ``index`` (run_id, type, id, timestamp, content, embedding) gives the
    ``limit`` nearest rows above the threshold. Rows of one type and id that both found are one row, method hybrid, with the relevance of
    the keyword match; ``combined`` weighs the similarity 0.6 and the relevance 0.4. Every side is cut to ``limit`` rows by a
    partial top-k before they meet, so what is merged does not grow with the case. Without a vector only keywords count.
    """
    spark = next(iter(evidence.values())).sparkSession
    case = {n: t.where(F.col("run_id") == run_id) for n, t in evidence.items() if "run_id" in t.columns}
    by_keyword = spark.createDataFrame([], "type string, id string, run_id string, timestamp timestamp_ntz, content string, searched string, relevance double, source int")
    if request.mode != "semantic":
        for i, table in enumerate(dict.fromkeys(request.tables)):
            order = F.asc("searched") if table in BY_NAME else F.desc_nulls_last("timestamp")
            found = page(searched_table(case, table, request), request.limit, request.offset, order, F.asc("id"))
            by_keyword = by_keyword.unionByName(found.select(*RESULT, F.lit(i).alias("source")))
    k = deduplicated(by_keyword).drop("source").withColumn("similarity", F.lit(None).cast("double"))
    if request.mode != "keyword" and request.vector:
        if index is None:
            raise ValueError("a semantic search needs an index")
        rows = index.where(F.col("run_id") == run_id)
        near = semantic_search(rows.withColumn("key", F.struct("type", "id", "timestamp", "content")), request.vector, request.limit, request.threshold, id_column="key")
        s = near.select("id.type", "id.id", F.lit(run_id).alias("run_id"), "id.timestamp", "id.content", F.coalesce("id.content", F.lit("")).alias("searched"), F.col("similarity").alias("relevance"), "similarity")
        row = ["type", "id"]  # tables number their rows each on its own
        both = k.join(s.select(*row, F.col("similarity").alias("near")), row, "left").withColumn("similarity", F.col("near")).drop("near")
        k = both.withColumn("method", F.when(F.col("similarity").isNull(), "keyword").otherwise("hybrid")).unionByName(s.join(k.select(*row), row, "left_anti").withColumn("method", F.lit("semantic")))
    else:
        k = k.withColumn("method", F.lit("keyword"))
    of_keyword = F.when(F.col("method") == "semantic", 0.0).otherwise(F.col("relevance"))
    merged = k.withColumn("combined", 0.6 * F.coalesce("similarity", F.lit(0.0)) + 0.4 * of_keyword)
    best = ranked(merged, request.keywords, request.entities, now).orderBy(F.desc("score"), "type", "id").limit(request.limit)
    return best.select("type", "id", "run_id", "timestamp", "content", "method", "combined", "score")


def history(queries: DataFrame, run_id: str, limit: int, offset: int = 0) -> DataFrame:
    return page(queries.where(F.col("run_id") == run_id), limit, offset, F.desc("created_at"), F.asc("id"))


def history_total(queries: DataFrame) -> DataFrame:
    """(run_id, total): how many queries each case has, for paging."""
    return queries.groupBy("run_id").agg(F.count("*").alias("total"))

"""Sinks of artifact tables: TSV, timeline, places, typed tables, media references and device facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STANDARD = ("tsv", "timeline", "table")


def text_of(df: DataFrame, name: str) -> Column:
    """A column as text; nested ones as JSON, nulls as the word None."""
    kind = df.schema[name].dataType.typeName()
    value = F.to_json(name) if kind in ("struct", "array", "map") else F.col(name).cast("string")
    return F.coalesce(value, F.lit("None"))


def write_tsv(df: DataFrame, path: str) -> None:
    flat = df.select(*(F.regexp_replace(text_of(df, c), r"[\t\r\n]+", " ").alias(c) for c in df.columns))
    flat.write.mode("append").option("sep", "\t").option("header", "true").csv(path)


def timeline_rows(df: DataFrame, activity: str) -> DataFrame:
    """(key, activity, datalist): the first column, and the whole row as JSON of texts."""
    row = F.to_json(F.struct(*(text_of(df, c).alias(c) for c in df.columns)))
    return df.select(text_of(df, df.columns[0]).alias("key"), F.lit(activity).alias("activity"), row.alias("datalist"))


def place_rows(df: DataFrame, activity: str) -> DataFrame | None:
    """(timestamp, latitude, longitude, activity) of rows with both coordinates, neither of them 0; None without such columns."""
    names = {c.lower(): c for c in df.columns}
    if not {"latitude", "longitude"} <= set(names):
        return None
    times = [c for c, t in df.dtypes if t.startswith("timestamp")]
    time = names.get("timestamp") or (times[0] if times else None)
    latitude, longitude = (F.col(names[c]).try_cast("double") for c in ("latitude", "longitude"))
    rows = df.select((F.col(time).cast("string") if time else F.lit(None).cast("string")).alias("timestamp"), latitude.alias("latitude"), longitude.alias("longitude"), F.lit(activity).alias("activity"))
    return rows.where("latitude <> 0 and longitude <> 0")


def write_kml(places: DataFrame, path: str) -> None:
    """A text file of placemarks for each partition."""
    mark = F.format_string("<Placemark><name>%s</name><TimeStamp><when>%s</when></TimeStamp><Point><coordinates>%s,%s</coordinates></Point></Placemark>", F.col("activity"), F.coalesce("timestamp", F.lit("")), F.col("longitude").cast("string"), F.col("latitude").cast("string"))
    places.select(mark.alias("value")).write.mode("append").text(path)


def table_rows(df: DataFrame) -> DataFrame:
    """Rows as a typed table keeps them: clean column names, times as seconds since 1970, nested values as JSON."""
    out, taken = [], set()
    for name, kind in df.dtypes:
        clean = "".join(ch for ch in name if ch.isalnum() or ch in "_ ").strip().replace(" ", "_").lower() or "column"
        clean = clean if clean[0].isalpha() else "_" + clean
        while clean in taken:
            clean += "_"
        taken.add(clean)
        c = F.col(f"`{name}`")
        out.append((F.unix_timestamp(c.cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.to_json(c) if kind.startswith(("struct", "array", "map")) else c).alias(clean))
    return df.select(*out)


def write_table(df: DataFrame, path: str) -> None:
    table_rows(df).write.mode("overwrite").parquet(path)


def media_references(files: DataFrame, artifact: str) -> tuple[DataFrame, DataFrame]:
    """Media by content (id, path, size), each once, and references (id, media_id, artifact, name); files: (path, content)."""
    media = files.select(F.sha1("content").alias("id"), "path", F.octet_length("content").alias("size"))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    references = media.select(F.sha1(F.concat_ws("-", "id", F.lit(artifact), name)).alias("id"), F.col("id").alias("media_id"), F.lit(artifact).alias("artifact"), name.alias("name"))
    return media.groupBy("id").agg(F.min("path").alias("path"), F.first("size").alias("size")), references.dropDuplicates(["id"])


def device_facts(facts: DataFrame) -> DataFrame:
    """(category, label, entries): every value of a fact once with its source; facts: (category, label, value, source)."""
    return facts.groupBy("category", "label").agg(F.array_sort(F.collect_set(F.struct("value", "source"))).alias("entries"))


def write_outputs(df: DataFrame, activity: str, folder: str, outputs: Sequence[str] = STANDARD) -> None:
    """An artifact's rows in all the forms asked for; they are computed once."""
    df = df.persist()
    try:
        if "tsv" in outputs:
            write_tsv(df, f"{folder}/tsv/{activity}")
        if "timeline" in outputs:
            timeline_rows(df, activity).write.mode("append").parquet(f"{folder}/timeline")
        if "places" in outputs and (places := place_rows(df, activity)) is not None:
            places.write.mode("append").parquet(f"{folder}/places")
        if "table" in outputs:
            write_table(df, f"{folder}/tables/{activity}")
    finally:
        df.unpersist()

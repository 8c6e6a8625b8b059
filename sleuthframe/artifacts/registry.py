"""The registry of artifacts and how one is run over files."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.outputs import STANDARD, write_outputs
from ..sources.sqlite import read_sqlite, tables_in

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Artifact:
    """``tables``: the tables that ``sql`` names in braces, each with the columns that it must have; missing ones are null.

    Columns are strings and compare as such: statements cast what they count with. ``{tz}`` is the examiner's time zone.
    """

    name: str
    category: str
    paths: tuple[str, ...]
    tables: Mapping[str, tuple[str, ...]]
    sql: str
    outputs: tuple[str, ...] = STANDARD


REGISTRY: dict[str, Artifact] = {}


def register(artifact: Artifact) -> Artifact:
    if artifact.name in REGISTRY:
        raise KeyError(f"artifact {artifact.name} is registered twice")
    REGISTRY[artifact.name] = artifact
    return artifact


def artifacts(categories: Iterable[str] | None = None) -> dict[str, Artifact]:
    """All artifacts, or those of a profile of categories."""
    from . import catalog  # noqa: F401  registers

    wanted = None if categories is None else set(categories)
    return {n: a for n, a in REGISTRY.items() if wanted is None or a.category in wanted}


def run_artifact(spark: SparkSession, artifact: Artifact, tables: Mapping[str, DataFrame] | str, tz: str = "UTC") -> DataFrame:
    """Rows of an artifact over its tables, given as DataFrames or as the path of SQLite files."""
    if isinstance(tables, str):
        path = tables
        found = {r.table.lower() for r in tables_in(spark, path).select("table").distinct().collect()}
        tables = {t: read_sqlite(spark, path, t) for t in artifact.tables if t.lower() in found}
    views = {}
    for name, columns in artifact.tables.items():
        if name not in tables:
            schema = ", ".join(["rowid long", "source_path string", *(f"`{c}` string" for c in columns)])
            df = spark.createDataFrame([], schema)
        else:
            df = tables[name]
            have = {c.lower() for c in df.columns}
            df = df.select("*", *(F.lit(None).cast("string").alias(c) for c in columns if c.lower() not in have))
            if "rowid" not in have:
                df = df.withColumn("rowid", F.monotonically_increasing_id())
        views[name] = f"{name}_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(views[name])
    try:
        return spark.sql(artifact.sql.format(tz=tz, **views))
    finally:  # the plan holds the tables by now
        for view in views.values():
            spark.catalog.dropTempView(view)


def run_artifacts(spark: SparkSession, files: Mapping[str, str], folder: str, categories: Iterable[str] | None = None) -> dict[str, str]:
    """Run artifacts over files (artifact name → path) and write their outputs; an artifact that fails is logged and the others go on.

    The result says for each what became of it.
    """
    done = {}
    for name, artifact in artifacts(categories).items():
        if name not in files:
            continue
        try:
            write_outputs(run_artifact(spark, artifact, files[name]), name, folder, artifact.outputs)
            done[name] = "written"
        except Exception as e:
            log.exception("artifact %s", name)
            done[name] = f"{type(e).__name__}: {e}"
    return done

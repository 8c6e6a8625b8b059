"""Plans as DataFrames whose rows carry citations of the exact spans that matched.

A citation is struct(source_table, row_id, column, matched_value, snippet, char_start, char_end); source text from char_start to
char_end is matched_value. Values are taken literally: % and _ in them are no wildcards, so filter and citation agree.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Evidence
from .ir import Field, Match, Op, Predicate, QueryPlan, Sort, Target

PREVIEW = 160
CITATION = "array<struct<source_table:string,row_id:string,column:string,matched_value:string,snippet:string,char_start:int,char_end:int>>"


@dataclass(frozen=True)
class Mapping:
    """Where a target's logical fields are stored."""

    table: str
    time: str | None
    fields: dict[Field, tuple[str, ...]]

    @property
    def searchable(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(c for columns in self.fields.values() for c in columns))


MAPPINGS = {
    Target.messages: Mapping("message", "timestamp", {Field.text: ("content",), Field.participant: ("sender", "receiver")}),
    Target.calls: Mapping("call", "timestamp", {Field.participant: ("caller", "receiver")}),
    Target.contacts: Mapping("contact", None, {Field.text: ("name",), Field.participant: ("number",)}),
    Target.media: Mapping("media", None, {Field.text: ("original_path", "storage_path"), Field.category: ("media_type",), Field.media_type: ("media_type",)}),
    Target.artifacts: Mapping("artifact", "created_at", {Field.text: ("data", "filename"), Field.app: ("filename", "file_path", "category"), Field.category: ("category", "filename")}),
}


def lower_contains(column: Column, value: str) -> Column:
    return F.instr(F.lower(column), F.lit(value.lower())) > 0


def holds(predicate: Predicate, columns: tuple[str, ...]) -> Column:
    tests = []
    for c in map(F.col, columns):
        if predicate.op is Op.isin:
            tests.append(c.isin(*predicate.values))
        else:
            tests += [lower_contains(c, v) if predicate.op is Op.contains else c == v for v in predicate.values]
    return functools.reduce(operator.or_, tests)


def applicable(plan: QueryPlan, mapping: Mapping) -> list[tuple[Predicate, tuple[str, ...]]] | None:
    """The plan's predicates with their columns in a table; None where the table can't hold what is asked."""
    found = [(p, mapping.fields[p.field]) for p in plan.predicates if p.field in mapping.fields]
    if plan.predicates and (not found or plan.match is Match.all and len(found) < len(plan.predicates)):
        return None
    return found


def condition(plan: QueryPlan, mapping: Mapping, predicates: list[tuple[Predicate, tuple[str, ...]]]) -> Column:
    """Predicates and window; a table without a time column ignores the window."""
    tests = [holds(*p) for p in predicates]
    found = functools.reduce(operator.and_ if plan.match is Match.all else operator.or_, tests) if tests else F.lit(True)
    for bound, test in ((plan.start, operator.ge), (plan.end, operator.le)):
        if bound is not None and mapping.time is not None:
            found = found & test(F.col(mapping.time), F.lit(bound).cast("timestamp_ntz"))
    return found


def citations(table: str, predicates: list[tuple[Predicate, tuple[str, ...]]]) -> Column:
    """One for each predicate, column and value that matched: the first occurrence, whatever its case."""
    found = []
    for predicate, columns in predicates:
        for name in columns:
            for value in predicate.values:
                text, at = F.col(name), F.instr(F.lower(F.col(name)), F.lit(value.lower()))
                whole = at > 0 if predicate.op is Op.contains else F.lower(text) == value.lower()
                start = at - 1 if predicate.op is Op.contains else F.lit(0)
                cite = F.struct(
                    F.lit(table).alias("source_table"), F.col("id").alias("row_id"), F.lit(name).alias("column"), F.substring(text, start + 1, F.lit(len(value))).alias("matched_value"),
                    text.alias("snippet"), start.cast("int").alias("char_start"), (start + len(value)).cast("int").alias("char_end"),
                )
                found.append(F.when(whole, cite))
    return F.array_compact(F.array(*found)) if found else F.array().cast(CITATION)


def preview(table: str, columns: tuple[str, ...]) -> Column:
    first = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns), F.concat(F.lit(f"{table}:"), F.col("id")))
    return F.when(F.length(first) > PREVIEW, F.concat(F.substring(first, 1, PREVIEW), F.lit("…"))).otherwise(first)


def branch(plan: QueryPlan, target: Target, evidence: Evidence, run_id: str) -> DataFrame | None:
    """Matching rows of one target: source_table, row_id, event_time, preview, citations."""
    mapping = MAPPINGS[target]
    predicates = applicable(plan, mapping)
    if predicates is None or mapping.table not in evidence:
        return None
    rows = evidence[mapping.table].where((F.col("run_id") == run_id) & condition(plan, mapping, predicates))
    time = F.date_format(mapping.time, "yyyy-MM-dd'T'HH:mm:ss") if mapping.time else F.lit(None).cast("string")
    return rows.select(F.lit(mapping.table).alias("source_table"), F.col("id").alias("row_id"), time.alias("event_time"), preview(mapping.table, mapping.searchable).alias("preview"), citations(mapping.table, predicates).alias("citations"))


def ordering(sort: Sort) -> list[Column]:
    """By time as text, rows without one last when rising and first when falling, then by table and row."""
    keys = ["source_table", "row_id"]
    if sort is Sort.ascending:
        return [F.asc_nulls_last("event_time"), *map(F.asc, keys)]
    return [F.desc_nulls_first("event_time"), *map(F.desc, keys)]


def matches(plan: QueryPlan, evidence: Evidence, run_id: str) -> DataFrame:
    """All matching rows of all targets, without order or limit."""
    found = [b for t in plan.targets if (b := branch(plan, t, evidence, run_id)) is not None]
    if not found:
        spark = next(iter(evidence.values())).sparkSession
        return spark.createDataFrame([], f"source_table string, row_id string, event_time string, preview string, citations {CITATION}")
    return functools.reduce(DataFrame.unionByName, found)


def run_plan(plan: QueryPlan, evidence: Evidence, run_id: str) -> DataFrame:
    """The page of a plan. Every target is cut to limit + offset rows before they meet, so that only so many are sorted together."""
    found = [b.orderBy(*ordering(plan.sort)).limit(plan.limit + plan.offset) for t in plan.targets if (b := branch(plan, t, evidence, run_id)) is not None]
    rows = functools.reduce(DataFrame.unionByName, found) if found else matches(plan, evidence, run_id)
    return rows.orderBy(*ordering(plan.sort)).offset(plan.offset).limit(plan.limit)


def run_cited(plan: QueryPlan, evidence: Evidence, run_id: str) -> DataFrame:
    """As :func:`run_plan`, raising where a row matched a predicate without a citation."""
    rows = run_plan(plan, evidence, run_id)
    if not plan.predicates:
        return rows
    return rows.withColumn("citations", F.when(F.size("citations") > 0, F.col("citations")).otherwise(F.raise_error(F.concat(F.lit("no citation for "), "source_table", F.lit(" "), "row_id")).cast(CITATION)))


def rendered(plan: QueryPlan, run_id: str) -> list[str]:
    """The plan as SQL text, one statement a target, for display and audit."""

    def quoted(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    out = []
    for target in plan.targets:
        mapping = MAPPINGS[target]
        predicates = applicable(plan, mapping)
        if predicates is None:
            continue
        tests = []
        for p, columns in predicates:
            if p.op is Op.isin:
                parts = [f"{c} IN ({', '.join(map(quoted, p.values))})" for c in columns]
            elif p.op is Op.equals:
                parts = [f"{c} = {quoted(v)}" for c in columns for v in p.values]
            else:
                parts = [f"instr(lower({c}), {quoted(v.lower())}) > 0" for c in columns for v in p.values]
            tests.append("(" + " OR ".join(parts) + ")")
        where = [f"run_id = {quoted(run_id)}"]
        if tests:
            where.append("(" + (" AND " if plan.match is Match.all else " OR ").join(tests) + ")")
        for bound, sign in ((plan.start, ">="), (plan.end, "<=")):
            if bound is not None and mapping.time is not None:
                where.append(f"{mapping.time} {sign} TIMESTAMP_NTZ {quoted(bound.isoformat(sep=' '))}")
        direction = "ASC NULLS LAST" if plan.sort is Sort.ascending else "DESC NULLS FIRST"
        time = mapping.time or "NULL"
        out.append(f"SELECT id AS row_id, {', '.join(mapping.searchable)}, {time} AS event_time FROM {mapping.table} WHERE {' AND '.join(where)} ORDER BY event_time {direction}, row_id LIMIT {plan.limit + plan.offset}")
    return out

"""Temporal detectors over (run_id, kind, id, ts, a, b) events; every case is a partition, so all cases run in one job.

Each detector returns findings: run_id, type, severity, dates (array of ISO dates), stats (JSON text) and citations, at most
``CITATIONS`` of the events behind the finding in order of time, kind and id. Events without a time are left out and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import normalize
from ..functions.numbers import python_round
from ..shared import written

CITATIONS = 25
SEVERITY = {"high": 0, "medium": 1, "low": 2}
FINDING = ["run_id", "type", "severity", "dates", "stats", "citations"]


def dated(events: DataFrame) -> DataFrame:
    return events.where(F.col("ts").isNotNull()).withColumn("d", F.to_date("ts"))


def excluded(events: DataFrame) -> DataFrame:
    """(run_id, events, excluded): events with a time, and those left out for want of one."""
    return events.groupBy("run_id").agg(F.count("ts").alias("events"), F.count_if(F.col("ts").isNull()).alias("excluded"))


def daily_series(events: DataFrame) -> DataFrame:
    """(run_id, d, messages, calls, total) for every day from the first to the last of a case, quiet days included."""
    days = dated(events).groupBy("run_id", "d").agg(F.count_if(F.col("kind") == "message").alias("messages"), F.count_if(F.col("kind") == "call").alias("calls"))
    spans = days.groupBy("run_id").agg(F.explode(F.sequence(F.min("d"), F.max("d"))).alias("d"))
    filled = spans.join(days, ["run_id", "d"], "left").na.fill(0, ["messages", "calls"])
    return filled.withColumn("total", F.col("messages") + F.col("calls"))


def of_case() -> Window:
    return Window.partitionBy("run_id")


def cited(events: DataFrame, keys: list[str], limit: int = CITATIONS) -> DataFrame:
    """The first ``limit`` events of every key as an array of struct(source_table, row_id)."""
    ranked = events.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "kind", "id"))).where(F.col("rank") <= limit)
    cites = F.array_sort(F.collect_list(F.struct("rank", F.col("kind").alias("source_table"), F.col("id").alias("row_id"))))
    return ranked.groupBy(*keys).agg(F.transform(cites, lambda c: F.struct(c["source_table"].alias("source_table"), c["row_id"].alias("row_id"))).alias("citations"))


def iso(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def finding(df: DataFrame, type_: str, severity: Column, dates: Column, **stats: Column) -> DataFrame:
    return df.select("run_id", F.lit(type_).alias("type"), severity.alias("severity"), dates.alias("dates"), F.to_json(F.struct(*(v.alias(k) for k, v in stats.items()))).alias("stats"), F.coalesce("citations", F.array().cast("array<struct<source_table:string,row_id:string>>")).alias("citations"))


def spike_scores(series: DataFrame) -> DataFrame:
    """Days whose volume is far above the other days' mean, by the other days' deviation: (run_id, d, total, z, mean)."""
    w = of_case()
    n, s, q = F.count("*").over(w), F.sum("total").over(w), F.sum(F.col("total") * F.col("total")).over(w)
    others = series.select("run_id", "d", "total", n.alias("n"), ((s - F.col("total")) / (n - 1)).alias("mean"), ((q - F.col("total") * F.col("total")) / (n - 1)).alias("square"))
    scored = others.where("n >= 3 and total >= 5").withColumn("sd", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))).where("sd > 1e-9")
    return scored.withColumn("z", (F.col("total") - F.col("mean")) / F.col("sd")).where("z >= 2").select("run_id", "d", "total", "z", "mean")


def spikes(events: DataFrame, series: DataFrame | None = None) -> DataFrame:
    found = spike_scores(daily_series(events) if series is None else series)
    cites = cited(dated(events).join(found.select("run_id", "d"), ["run_id", "d"], "left_semi"), ["run_id", "d"])
    rows = found.join(cites, ["run_id", "d"], "left")
    return finding(rows, "spike", F.when(F.col("z") >= 3, "high").otherwise("medium"), F.array(iso(F.col("d"))), volume=F.col("total"), z_score=python_round(F.col("z"), 2), daily_mean=python_round(F.col("mean"), 2))


def late_night_shares(events: DataFrame, least: int = 6, share: float = 0.25) -> DataFrame:
    """Cases with many events before five o'clock: (run_id, late, events, ratio)."""
    counts = dated(events).groupBy("run_id").agg(F.count_if(F.hour("ts") < 5).alias("late"), F.count("*").alias("events"))
    return counts.withColumn("ratio", F.col("late") / F.col("events")).where((F.col("late") >= least) & (F.col("ratio") >= share))


def late_night(events: DataFrame) -> DataFrame:
    found = late_night_shares(events)
    late = dated(events).where(F.hour("ts") < 5).join(found.select("run_id"), "run_id", "left_semi")
    days = late.groupBy("run_id").agg(F.slice(F.array_sort(F.collect_set(iso(F.col("d")))), 1, 10).alias("days"))
    rows = found.join(days, "run_id").join(cited(late, ["run_id"]), "run_id", "left")
    return finding(rows, "late_night", F.lit("medium"), F.col("days"), late_night_events=F.col("late"), ratio=python_round(F.col("ratio"), 3))


def longest_gaps(events: DataFrame, least_days: int = 14) -> DataFrame:
    """The longest silence of each case, the later of equals: (run_id, gap, before, after)."""
    days = dated(events).select("run_id", "d").distinct()
    w = of_case().orderBy("d")
    gaps = days.select("run_id", F.lag("d").over(w).alias("before"), F.col("d").alias("after"), F.count("*").over(of_case()).alias("active"))
    gaps = gaps.where("before is not null and active >= 3").withColumn("gap", F.date_diff("after", "before"))
    best = gaps.groupBy("run_id").agg(F.max(F.struct("gap", "before", "after")).alias("best"))
    return best.select("run_id", "best.gap", "best.before", "best.after").where(F.col("gap") >= least_days)


def dormancy(events: DataFrame) -> DataFrame:
    found = longest_gaps(events)
    around = dated(events).join(found, "run_id").where((F.col("d") == F.col("before")) | (F.col("d") == F.col("after")))
    rows = found.join(cited(around, ["run_id"]), "run_id", "left")
    return finding(rows, "dormancy", F.lit("high"), F.array(iso(F.col("before")), iso(F.col("after"))), gap_days=F.col("gap"))


def change_points(series: DataFrame, days: int = 7, ratio: float = 0.6, baseline: float = 2.0) -> DataFrame:
    """The greatest drop of the mean of ``days`` days to that of the next, the earliest of equals: (run_id, d, before, after, fall)."""
    w = of_case().orderBy("d")
    means = series.select(
        "run_id", "d", F.row_number().over(w).alias("i"), F.count("*").over(of_case()).alias("n"),
        F.avg("total").over(w.rowsBetween(-days, -1)).alias("before"), F.avg("total").over(w.rowsBetween(0, days - 1)).alias("after"),
    )
    falls = means.where((F.col("i") > days) & (F.col("i") <= F.col("n") - days + 1) & (F.col("before") >= baseline)).withColumn("fall", (F.col("before") - F.col("after")) / F.col("before"))
    # rounded, since equal means of different days may differ in their last bit
    best = falls.where(F.col("fall") >= ratio).groupBy("run_id").agg(F.min(F.struct((-F.round("fall", 9)).alias("key"), "d", "before", "after", "fall")).alias("best"))
    return best.select("run_id", "best.d", "best.before", "best.after", "best.fall")


def drops(events: DataFrame, series: DataFrame | None = None, days: int = 7) -> DataFrame:
    found = change_points(daily_series(events) if series is None else series, days)
    after = dated(events).join(found.select("run_id", F.col("d").alias("change")), "run_id").where((F.col("d") >= F.col("change")) & (F.col("d") < F.date_add("change", days)))
    rows = found.join(cited(after, ["run_id"]), "run_id", "left")
    return finding(rows, "drop", F.when(F.col("fall") >= 0.8, "high").otherwise("medium"), F.array(iso(F.col("d"))), before_mean=python_round(F.col("before"), 2), after_mean=python_round(F.col("after"), 2), drop_ratio=python_round(F.col("fall"), 3))


def burst_runs(series: DataFrame, least_days: int = 3) -> DataFrame:
    """Runs of days above the mean of their case: (run_id, first, last, n_days, n_events)."""
    above = series.withColumn("mean", F.avg("total").over(of_case())).where(F.col("total") > F.col("mean"))
    islands = above.withColumn("island", F.date_sub("d", F.row_number().over(of_case().orderBy("d"))))
    return islands.groupBy("run_id", "island").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("n_days"), F.sum("total").alias("n_events")).where(F.col("n_days") >= least_days).drop("island")


def bursts(events: DataFrame, series: DataFrame | None = None) -> DataFrame:
    found = burst_runs(daily_series(events) if series is None else series)
    within = dated(events).join(found, "run_id").where(F.col("d").between(F.col("first"), F.col("last")))
    rows = found.join(cited(within, ["run_id", "first"]), ["run_id", "first"], "left")
    return finding(rows, "burst", F.lit("low"), F.array(iso(F.col("first")), iso(F.col("last"))), days=F.col("n_days"), events=F.col("n_events"))


def parties(events: DataFrame) -> DataFrame:
    """A row for either party of an event, keyed by its canonical form or else as it is written."""
    both = dated(events).select("run_id", "kind", "id", "ts", "d", F.posexplode(F.array("a", "b")).alias("side", "party")).where("party is not null and party <> ''")
    return both.withColumn("key", F.coalesce(normalize(F.col("party"))["value"], F.col("party")))


def emergences(events: DataFrame, after_days: int = 7, least: int = 8) -> DataFrame:
    """Contacts that appear a week into their case or later and are busy from then on: (run_id, key, party, emerged, n_events)."""
    starts = dated(events).groupBy("run_id").agg(F.min("d").alias("start"))
    found = parties(events).groupBy("run_id", "key").agg(F.min("d").alias("emerged"), F.count("*").alias("n_events"), F.min_by("party", F.struct("ts", "kind", "id", "side")).alias("party"))
    return found.join(starts, "run_id").where((F.date_diff("emerged", "start") >= after_days) & (F.col("n_events") >= least)).select("run_id", "key", "party", "emerged", "n_events")


def new_contacts(events: DataFrame) -> DataFrame:
    found = emergences(events)
    theirs = parties(events).join(found.select("run_id", "key"), ["run_id", "key"], "left_semi")
    rows = found.join(cited(theirs, ["run_id", "key"]), ["run_id", "key"], "left")
    return finding(rows, "new_contact", F.lit("medium"), F.array(iso(F.col("emerged"))), first_seen=iso(F.col("emerged")), events=F.col("n_events"), party=F.col("party"))


OF_SERIES, OF_EVENTS = (spikes, drops, bursts), (late_night, dormancy, new_contacts)


def analyze(events: DataFrame) -> DataFrame:
    """All findings, by severity, type and first date; the events and the series of days are made once for all detectors."""
    events = written(events.select("run_id", "kind", "id", "ts", "a", "b").where("ts is not null"), "events")
    series = written(daily_series(events), "series")
    found = [detect(events, series) for detect in OF_SERIES] + [detect(events) for detect in OF_EVENTS]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return every.orderBy("run_id", rank, "type", F.col("dates")[0])


def peak_days(series: DataFrame) -> DataFrame:
    """(run_id, d, total): the day of each case with the most events, of several the first."""
    best = series.groupBy("run_id").agg(F.max_by(F.struct("d", "total"), F.struct("total", -F.unix_date("d"))).alias("x"))
    return best.select("run_id", "x.d", "x.total")

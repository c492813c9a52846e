"""Mergeable partial aggregates: cells of events by session and day, kept by the ingest, from which reports merge.

A cell holds sums, least and greatest values only, so cells of any grain add up to
cells of a coarser one, and a batch that changes a session replaces that session's
cells and no others. Reports take sessions merged from cells (or cells by session
made in one pass over the events) and read each row once, where a report from raw
events reads them again for every part of it.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.sessions import bucketed

#: Counts of canonical events that the ingest keeps: name -> what an event must be.
CANONICAL = {
    "n_user": lambda: (F.col("event_type") == "transcript_message") & (F.col("role") == "user"),
    "n_assistant": lambda: (F.col("event_type") == "transcript_message") & (F.col("role") == "assistant"),
    "n_calls": lambda: F.col("event_type") == "transcript_tool_call",
    "n_results": lambda: F.col("event_type") == "transcript_tool_result",
    "n_failed": lambda: F.coalesce(F.col("is_error"), F.lit(False)) | (F.coalesce(F.col("exit_code"), F.lit(0)) != 0),
    "n_aborted": lambda: F.col("abort_reason").isNotNull(),
}


def cells(events: DataFrame, *, by: list[str], at: str, counts: Mapping[str, Column], sums: Mapping[str, Column] | None = None, daily: bool = True) -> DataFrame:
    """``by`` (and day) with n_events, ``counts``, ``sums`` (null if nothing was measured), first_at and last_at."""
    key = [*by, F.to_date(at).alias("day")] if daily else list(by)
    return events.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_events"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()], *[F.sum(c).alias(n) for n, c in (sums or {}).items()], F.min(at).alias("first_at"), F.max(at).alias("last_at"),
    )


def of_canonical(events: DataFrame) -> DataFrame:
    """Cells of canonical events by session and day, as the ingest keeps them."""
    return cells(events, by=["session_id", "source"], at="occurred_at", counts={n: c() for n, c in CANONICAL.items()})


def merged(cells_: DataFrame, *, by: list[str]) -> DataFrame:
    """Cells of a coarser grain."""
    rest = [c for c in cells_.columns if c not in by and c not in ("day", "first_at", "last_at")]
    numbers = [f.name for f in cells_.schema if f.name in rest and f.dataType.typeName() in ("long", "integer", "double", "decimal")]
    return cells_.groupBy(*by).agg(*[F.sum(c).alias(c) for c in numbers], F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def duration() -> Column:
    return F.unix_millis("last_at") - F.unix_millis("first_at")


def overview(sessions: DataFrame, *, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row: sessions, threads, duration and how many have one, events, ``extra`` counts, distinct projects and sessions by source."""
    by = sessions.groupBy("source").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("thread_kind") == "main").alias("main_sessions"), F.count_if(F.col("thread_kind") == "subagent").alias("subagent_sessions"),
        F.sum(duration()).alias("duration_ms"), F.count("last_at").alias("with_duration"), F.sum("n_events").alias("events"), *[F.sum(c).alias(c) for c in extra],
    )
    sums = [c for c in by.columns if c != "source"]
    total = by.agg(*[F.sum(c).alias(c) for c in sums], F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", F.col("sessions").alias("n"))))).alias("by_source"))
    return total.crossJoin(sessions.select("project_key").distinct().agg(F.count("project_key").alias("projects")))


def facets(sessions: DataFrame, dims: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """facet, key and count in one pass; each facet counts under all conditions but its own. dims: facet -> (key, condition of its own)."""
    each = []
    for name, (key, _) in dims.items():
        fits = F.lit(True)
        for other, (_, condition) in dims.items():
            fits = fits if other == name else fits & F.coalesce(condition, F.lit(False))
        each.append(F.when(fits, F.struct(F.lit(name).alias("facet"), key.cast("string").alias("key"))))
    told = sessions.select(F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("f"))
    return told.groupBy("f.facet", "f.key").agg(F.count(F.lit(1)).alias("count"))


def projects(sessions: DataFrame, *, friction: str) -> DataFrame:
    """Sessions, friction, first and last start, and sessions by source of each project."""
    by_source = sessions.groupBy(bucketed(F.col("project_key")).alias("project"), "source").agg(F.count(F.lit(1)).alias("n"), F.min("first_at").alias("f"), F.max("first_at").alias("l"), F.sum(friction).alias("x"))
    return by_source.groupBy("project").agg(F.sum("n").alias("sessions"), F.min("f").alias("first_started"), F.max("l").alias("last_started"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source"), F.sum("x").alias("friction"))


def windows(start: datetime, end: datetime) -> dict[str, tuple[datetime, datetime]]:
    """[start, end] and the window of equal length that ends a millisecond before it."""
    before = start - timedelta(milliseconds=1)
    return {"now": (start, end), "before": (before - (end - start), before)}


def within(at: str, window: tuple[datetime, datetime]) -> Column:
    return F.col(at).between(F.lit(window[0]), F.lit(window[1]))


def kpis(sessions: DataFrame, *, start: datetime, end: datetime, friction: Mapping[str, str]) -> DataFrame:
    """Each measure now and before, its change and direction; null where nothing was measured. friction: window -> column with the session's friction in it."""
    parts = windows(start, end)
    one = []
    for part, window in parts.items():
        inside = within("first_at", window)
        held = F.count_if(inside) > 0
        rubs = F.sum(friction[part])
        one += [
            F.when(held, F.count_if(inside).cast("double")).alias(f"sessions_{part}"), F.when(held, F.countDistinct(F.when(inside, F.col("project_key"))).cast("double")).alias(f"projects_{part}"),
            F.sum(F.when(inside, duration())).cast("double").alias(f"duration_ms_{part}"), F.when(rubs > 0, rubs.cast("double")).alias(f"friction_{part}"),
        ]
    row = sessions.agg(*one)
    named = ("sessions", "projects", "duration_ms", "friction")
    long = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(f"{k}_now").alias("value"), F.col(f"{k}_before").alias("previous")) for k in named])).alias("r")).select("r.*")
    change = F.col("value") - F.col("previous")
    told = long.filter("value is not null or previous is not null")
    return told.select("kpi", "value", "previous", change.alias("change"), F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "same").alias("direction"))

"""Session filters, the session star, facets, orders, pages, fleets and exports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNRECORDED = "__unrecorded__"


def bucketed(c: Column) -> Column:
    """A missing dimension is a bucket of its own."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(UNRECORDED))


def counted_by_default(sessions: DataFrame) -> DataFrame:
    """Main threads, which an unrecorded thread kind counts as, that are not empty."""
    main = F.col("thread_kind").isNull() | (F.col("thread_kind") == "main")
    empty = F.coalesce(F.col("is_empty").cast("int"), F.lit(0)) if "is_empty" in sessions.columns else F.lit(0)
    return sessions.filter(main & (empty == 0))


def time_bound(text: str, *, now: datetime, upper: bool = False) -> datetime | None:
    """A day, an ISO time, ``7d`` / ``12w`` / ``6m`` back from ``now`` (months by calendar) or ``all``.

    A bare day as upper bound reaches to its last millisecond. Resolved once on
    the driver, so that a query holds a literal.
    """
    text = text.strip()
    if not text or text == "all":
        return None
    if text[:-1].isdigit() and text[-1] in "dwm":
        n = int(text[:-1])
        if text[-1] in "dw":
            return now - timedelta(days=n * (7 if text[-1] == "w" else 1))
        months = now.year * 12 + now.month - 1 - n
        first = now.replace(year=months // 12, month=months % 12 + 1, day=1)
        return first + timedelta(days=now.day - 1)  # a day past the month's end runs on into the next
    if len(text) == 10:
        day = datetime.fromisoformat(text).replace(tzinfo=now.tzinfo)
        return day + timedelta(days=1, milliseconds=-1) if upper else day
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


Predicates = dict[str, Callable[[DataFrame], DataFrame]]


def session_filters(
    *, projects: Sequence[str] = (), sources: Sequence[str] = (), models: Sequence[str] = (), start: datetime | None = None, end: datetime | None = None, parent: str | None = None,
    thread: str = "all", empty: str = "all", role: str | None = None, text: str | None = None, having: Mapping[str, DataFrame] | None = None,
) -> Predicates:
    """The chosen filters by dimension. ``having`` holds keys of sessions (session_id) that each dimension keeps."""
    out: Predicates = {}

    def keep(name: str, c: Column) -> None:
        out[name] = lambda df: df.filter(c)

    if projects:
        keep("project", bucketed(F.col("project_key")).isin(*projects))
    if sources:
        keep("source", F.col("source").isin(*sources))
    if models:
        keep("model", F.col("model").isin(*models))
    if start is not None:
        keep("start", F.col("started_at") >= F.lit(start))
    if end is not None:
        keep("end", F.col("started_at") <= F.lit(end))
    if parent is not None:
        keep("parent", F.col("parent_session_id") == parent)
    if thread == "main":
        keep("thread", F.col("thread_kind").isNull() | (F.col("thread_kind") == "main"))
    elif thread != "all":
        keep("thread", F.col("thread_kind") == thread)
    if empty != "all":
        keep("empty", F.coalesce(F.col("is_empty").cast("int"), F.lit(0)) == int(empty))
    if role is not None:
        keep("role", F.col("agent_role") == role)
    if text:
        keep("text", F.lower(F.concat_ws(" ", "session_id", "project_key", "model")).contains(text.lower()))
    for name, keys in (having or {}).items():
        out[name] = lambda df, keys=keys: df.join(keys.select("session_id"), "session_id", "left_semi")
    return out


def filtered(sessions: DataFrame, filters: Predicates, exclude: Sequence[str] = ()) -> DataFrame:
    """All filters but those of the excluded dimensions."""
    for name, apply in filters.items():
        if name not in exclude:
            sessions = apply(sessions)
    return sessions


def facets(sessions: DataFrame, filters: Predicates, dims: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """facet, key and count; each facet counts under all filters but its own. dims: facet -> (key column, dimension of its filter)."""
    parts = [
        filtered(sessions, filters, exclude=[own]).groupBy(key.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("facet"), "key", "count")
        for name, (key, own) in dims.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def star(sessions: DataFrame, **sides: DataFrame) -> DataFrame:
    """Sessions with the columns of every side, which is unique by session_id, and their parent's model and start."""
    out = sessions
    for side in sides.values():
        out = out.join(side, "session_id", "left")
    parent = sessions.select(F.col("session_id").alias("parent_session_id"), F.col("model").alias("parent_model"), F.col("started_at").alias("parent_started_at"))
    return out.join(parent, "parent_session_id", "left")


def session_order(name: str) -> list[Column]:
    """The orders of a session list: what was not measured sorts last, the id breaks ties."""
    measure = {
        "recent": "started_at", "duration": "duration_ms", "events": "n_events", "friction": "n_friction", "tool_calls": "n_calls",
        "tokens": "work_tokens", "lines_changed": "lines_changed", "active": "active_ms",
    }
    first = F.col("started_at").asc_nulls_last() if name == "oldest" else F.col(measure[name]).desc_nulls_last()
    return [first, F.col("session_id").desc()]


def page(rows: DataFrame, order: Sequence[Column], *, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page with the total and whether more follow. ``page_after`` goes deep without counting past rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    part = rows.orderBy(*order).offset(offset).limit(limit)
    return part.crossJoin(total).withColumn("has_more", F.col("total") > offset + limit)


def page_after(rows: DataFrame, *, at: str, key: str, after: tuple, limit: int = 50) -> DataFrame:
    """The page that follows (at, key) in falling order of both."""
    t, k = F.lit(after[0]), F.lit(after[1])
    return rows.filter((F.col(at) < t) | ((F.col(at) == t) & (F.col(key) < k))).orderBy(F.col(at).desc(), F.col(key).desc()).limit(limit)


def top(rows: DataFrame, count: str, key: str, k: int) -> DataFrame:
    return rows.orderBy(F.col(count).desc(), F.col(key)).limit(k)


def tags_of(tags: DataFrame) -> DataFrame:
    """The distinct (kind, tag) of each session as an ordered list."""
    return tags.groupBy("session_id").agg(F.array_sort(F.collect_set(F.struct("kind", "tag"))).alias("tags"))


def with_parent(sessions: DataFrame) -> DataFrame:
    """Every child with its parent; a parent that was never ingested leaves nulls."""
    up = sessions.select(F.col("session_id").alias("parent_session_id"), F.col("started_at").alias("parent_started_at"), F.lit(True).alias("_there"))
    kids = sessions.filter(F.col("parent_session_id").isNotNull())
    return kids.join(up, "parent_session_id", "left").select("session_id", "parent_session_id", F.coalesce("_there", F.lit(False)).alias("parent_known"), "parent_started_at")


def fleets(sessions: DataFrame, usage: DataFrame) -> DataFrame:
    """Parent and children together: members, those with usage, and sums that are null if none was measured."""
    all_ = sessions.join(usage, "session_id", "left").withColumn("fleet_id", F.coalesce("parent_session_id", "session_id"))
    return all_.groupBy("fleet_id").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("session_id") != F.col("fleet_id")).alias("subagents"),
        F.count("work_tokens").alias("measured"), F.sum("work_tokens").alias("work_tokens"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"),
    )


def previous_fleet(fleets_: DataFrame, *, by: str = "project_key") -> DataFrame:
    """The latest fleet with subagents that began strictly before, in the same project; fleets that begin together share it."""
    own = fleets_.filter(F.col("subagents") > 0)
    starts = own.groupBy(by, "started_at").agg(F.max("fleet_id").alias("_last"))
    before = starts.withColumn("previous_id", F.lag("_last").over(W.partitionBy(by).orderBy("started_at"))).select(F.col(by).alias("_by"), F.col("started_at").alias("_at"), "previous_id")
    return own.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("started_at") == F.col("_at"))).drop("_by", "_at")


def projects(sessions: DataFrame, friction: DataFrame) -> DataFrame:
    """Sessions, friction, first and last start, and sessions by source of each project."""
    key = bucketed(F.col("project_key"))
    by_source = sessions.groupBy(key.alias("project"), "source").agg(F.count(F.lit(1)).alias("n"), F.min("started_at").alias("f"), F.max("started_at").alias("l"))
    rolled = by_source.groupBy("project").agg(
        F.sum("n").alias("sessions"), F.min("f").alias("first_started"), F.max("l").alias("last_started"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source"),
    )
    hits = friction.groupBy(key.alias("project")).agg(F.count(F.lit(1)).alias("friction"))
    return rolled.join(hits, "project", "left").withColumn("friction", F.coalesce("friction", F.lit(0)))


def subagents(sessions: DataFrame, friction: DataFrame, *, role: str = "model") -> DataFrame:
    """Subagent sessions by role: sessions, distinct parents and their share of friction."""
    kids = sessions.filter(F.col("thread_kind") == "subagent")
    hits = friction.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return kids.join(hits, "session_id", "left").groupBy(F.col(role).alias("role")).agg(F.count(F.lit(1)).alias("sessions"), F.countDistinct("parent_session_id").alias("parents"), F.coalesce(F.sum("n"), F.lit(0)).alias("friction"))


def live(sessions: DataFrame, written: DataFrame, *, now: datetime, minutes: int = 10) -> DataFrame:
    """Sessions whose newest transcript was written within ``minutes`` of ``now``; main threads first, then those with most live children."""
    recent = written.groupBy("session_id").agg(F.max("mtime").alias("mtime")).filter(F.col("mtime") > F.lit(now - timedelta(minutes=minutes)))
    there = sessions.join(recent, "session_id")
    kids = there.filter(F.col("parent_session_id").isNotNull()).groupBy(F.col("parent_session_id").alias("session_id")).agg(F.count(F.lit(1)).alias("live_children"))
    return there.join(kids, "session_id", "left").withColumn("live_children", F.coalesce("live_children", F.lit(0))).orderBy((F.coalesce("thread_kind", F.lit("main")) == "main").desc(), F.col("live_children").desc(), F.col("session_id"))


def export(sessions: DataFrame, filters: Predicates, order: Sequence[Column], *, most: int = 5_000) -> tuple[DataFrame, DataFrame]:
    """(rows to write, tags joined by semicolons; one row with matched and exported)."""
    kept = filtered(sessions, filters)
    counts = kept.agg(F.count(F.lit(1)).alias("matched")).withColumn("exported", F.least("matched", F.lit(most)))
    if "tags" in kept.columns:
        kept = kept.withColumn("tags", F.array_join(F.transform("tags", lambda t: t["tag"]), ";"))
    return kept.orderBy(*order).limit(most), counts

"""Friction: failures and interrupts as rows, groups, signatures with a life cycle, and what follows them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators.ordered import asof_backward, range_sum
from tracewell.operators.sessions import bucketed


def base(friction: DataFrame, sessions: DataFrame, events: DataFrame, violations: DataFrame | None = None) -> DataFrame:
    """Friction with its session and event, and violations as further rows; the kinds are flags on one row."""
    named = friction.join(sessions.select("session_id", "thread_kind", "model"), "session_id").join(events.select("session_id", "event_id", "event_type"), ["session_id", "event_id"], "left")
    if violations is not None:
        named = named.unionByName(violations.join(sessions.select("session_id", "thread_kind", "model"), "session_id"), allowMissingColumns=True)
    flag = lambda k: (F.col("kind") == k).cast("int").alias(f"is_{k}")
    return named.select("*", flag("tool_error"), flag("user_interrupt"), flag("violation"))


def matching(rows: DataFrame, *, text: str | None = None, **dims: str | None) -> DataFrame:
    """Rows whose dimensions equal the given values (the unrecorded value meets nulls) and whose text holds ``text`` in any case."""
    for name, value in dims.items():
        if value is not None:
            rows = rows.filter(bucketed(F.col(name)) == value)
    if text:
        rows = rows.filter(F.lower(F.concat_ws(" ", "session_id", "project_key", "tool", "category", "signature")).contains(text.lower()))
    return rows


def collapsed(rows: DataFrame, *, expected: str = "expected_exit") -> tuple[DataFrame, DataFrame]:
    """(one row for each source event with the greatest labels and any of the flags; one row with the expected exits left out)."""
    flags = [c for c in rows.columns if c.startswith("is_")]
    labels = [c for c in ("source", "project_key", "tool", "category", "signature", "ts") if c in rows.columns]
    one = rows.groupBy("session_id", "event_id").agg(*[F.max(c).alias(c) for c in (*labels, *flags)])
    out = F.col("category") == expected
    return one.filter(out.isNull() | ~out), one.agg(F.count_if(out).alias("expected"))


def summary(rows: DataFrame, *, recurring: int = 2) -> DataFrame:
    """One row: totals, distinct sessions and projects, rows without a tool, and signatures seen in ``recurring`` sessions or more."""
    # One fold of the rows: distinct counts are taken on what it leaves.
    per = rows.groupBy("signature", "session_id", bucketed(F.col("project_key")).alias("_p")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "tool_error").alias("e"), F.count_if(F.col("kind") == "user_interrupt").alias("i"), F.count_if(F.col("tool").isNull()).alias("u"),
    )
    many = per.groupBy("signature").agg(F.countDistinct("session_id").alias("s")).agg(F.count_if(F.col("s") >= recurring).alias("recurring"))
    total = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("n", "total"), ("e", "tool_errors"), ("i", "interrupts"), ("u", "tool_unrecorded"))], F.countDistinct("session_id").alias("sessions"), F.countDistinct("_p").alias("projects"))
    return total.crossJoin(many)


def by_dimension(rows: DataFrame, dim: Column, *, name: str, most: int | None = None) -> DataFrame:
    """Records and distinct sessions by a dimension, a missing one being a bucket."""
    got = rows.groupBy(bucketed(dim).alias(name), "session_id").agg(F.count(F.lit(1)).alias("n")).groupBy(name).agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("sessions"))
    return got if most is None else got.orderBy(F.col("records").desc(), name).limit(most)


def groups(rows: DataFrame, dim: list[Column], *, start: datetime | None, end: datetime | None) -> DataFrame:
    """Groups over the full history with counts inside [start, end], first and last time and days active."""
    t = F.col("ts")
    inside = F.lit(True)
    if start is not None:
        inside = inside & (t >= F.lit(start))
    if end is not None:
        inside = inside & (t <= F.lit(end))
    names = [f"g{i}" for i in range(len(dim))]
    # By session and day first: what a hot group shuffles no longer grows with its rows.
    cell = rows.groupBy(*[d.alias(n) for d, n in zip(dim, names, strict=True)], "session_id", F.to_date(t).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("w"), F.count_if(F.col("kind") == "user_interrupt").alias("i"), F.min(t).alias("f"), F.max(t).alias("l"),
    )
    return cell.groupBy(*names).agg(
        F.sum("n").alias("records"), F.sum("i").alias("interrupts"), F.sum("w").alias("window_records"), F.countDistinct("session_id").alias("sessions"),
        F.countDistinct(F.when(F.col("w") > 0, F.col("session_id"))).alias("window_sessions"), F.countDistinct("day").alias("days_active"), F.min("f").alias("first_at"), F.max("l").alias("last_at"),
    )


def lifecycle(rows: DataFrame, *, start: datetime, end: datetime) -> DataFrame:
    """Each signature over its full history: once (one session ever), new (first seen in the window), active (seen in it) or quiet."""
    g = groups(rows, [F.col("signature")], start=start, end=end).withColumnRenamed("g0", "signature")
    status = F.when(F.col("sessions") <= 1, "once").when(F.col("first_at") >= F.lit(start), "new").when(F.col("window_records") > 0, "active").otherwise("quiet")
    return g.withColumn("status", status)


def leading(life: DataFrame, *, most: int = 5) -> DataFrame:
    """The first ``most`` signatures of each status, by window sessions, sessions and name."""
    w = W.partitionBy("status").orderBy(F.col("window_sessions").desc(), F.col("sessions").desc(), "signature")
    return life.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def sessions_where_quiet(life: DataFrame, rows: DataFrame, sessions: DataFrame, *, start: datetime, end: datetime) -> DataFrame:
    """For each quiet signature: sessions that its projects ran in the window, which tells silence from absence."""
    where = rows.join(life.filter("status = 'quiet'").select("signature"), "signature").select("signature", bucketed(F.col("project_key")).alias("project")).distinct()
    ran = sessions.filter((F.col("started_at") >= F.lit(start)) & (F.col("started_at") <= F.lit(end))).groupBy(bucketed(F.col("project_key")).alias("project")).agg(F.count(F.lit(1)).alias("n"))
    return where.join(ran, "project", "left").groupBy("signature").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sessions_run"))


def stuck_loops(rows: DataFrame, *, least: int = 5) -> DataFrame:
    """(signature, session) repeated ``least`` times or more, interrupts aside."""
    return rows.filter(F.col("kind") != "user_interrupt").groupBy("signature", "session_id").agg(F.count(F.lit(1)).alias("repeats"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")).filter(F.col("repeats") >= least)


def what_followed(rows: DataFrame, actions: DataFrame, *, first: int = 5) -> DataFrame:
    """The first actions after the last hit of each signature in a session: signature, session_id, position, kind and label.

    ``actions``: session_id, ts, event_id, kind, label. They are numbered once for
    each session; a hit finds the number of the last one at or before it, and meets
    the ``first`` numbers that follow, no others.
    """
    last = rows.groupBy("signature", "session_id").agg(F.max("ts").alias("hit_at"))
    numbered = actions.withColumn("_n", F.row_number().over(W.partitionBy("session_id").orderBy("ts", "event_id")))
    at = asof_backward(last, numbered, by=["session_id"], left_at="hit_at", right_at="ts", tie="_n", take=["_n"])
    wanted = at.withColumn("position", F.explode(F.sequence(F.lit(1), F.lit(first)))).withColumn("_n", F.coalesce("last__n", F.lit(0)) + F.col("position"))
    return wanted.join(numbered, ["session_id", "_n"]).select("signature", "session_id", "position", "kind", "label")


def resolutions(rows: DataFrame, actions: DataFrame, sessions: DataFrame, *, first: int = 5) -> DataFrame:
    """What came next, over the sessions in which work went on after the last hit: sessions, count and summed position of each action."""
    last = rows.groupBy("signature", "session_id").agg(F.max("ts").alias("hit_at"))
    went_on = last.join(sessions.select("session_id", "ended_at"), "session_id").filter(F.col("ended_at") > F.col("hit_at")).select("signature", "session_id")
    next_ = what_followed(rows.join(went_on, ["signature", "session_id"], "left_semi"), actions, first=first)
    per = next_.groupBy("signature", "kind", "label", "session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("position").alias("p"))
    return per.groupBy("signature", "kind", "label").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("count"), F.sum("p").alias("positions"))


def evidence(rows: DataFrame, *, newest: int = 12, samples: int = 3) -> DataFrame:
    """Up to ``samples`` distinct lines of the newest records of each signature, latest first."""
    w = W.partitionBy("signature").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    recent = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= newest)
    lines = recent.groupBy("signature", "line").agg(F.min("_r").alias("_r"))
    ordered = F.array_sort(F.collect_list(F.struct("_r", "line")))
    return lines.groupBy("signature").agg(F.slice(F.transform(ordered, lambda x: x["line"]), 1, samples).alias("lines"))


def weekly_series(rows: DataFrame, sessions: DataFrame, *, now: datetime, weeks: int = 12, key: str = "signature") -> DataFrame:
    """For each key and each of the last ``weeks`` weeks, empty ones too: records, distinct sessions, and the sessions run that week."""
    start = now - timedelta(days=7 * weeks)
    week = lambda c: F.floor((F.unix_seconds(F.col(c)) - int(start.timestamp())) / (7 * 86_400)).cast("int")
    inside = lambda df, c: df.filter((F.col(c) >= F.lit(start)) & (F.col(c) < F.lit(now)))
    hits = inside(rows, "ts").groupBy(key, week("ts").alias("week"), "session_id").agg(F.count(F.lit(1)).alias("n")).groupBy(key, "week").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("sessions"))
    ran = inside(sessions, "started_at").groupBy(week("started_at").alias("week")).agg(F.count(F.lit(1)).alias("sessions_run"))
    grid = rows.select(key).distinct().withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return grid.join(hits, [key, "week"], "left").join(ran, "week", "left").select(key, "week", zero("records"), zero("sessions"), zero("sessions_run"))


def interrupts(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """Each interrupt with the tool of the last call at or before it."""
    hits = rows.filter(F.col("kind") == "user_interrupt").select("session_id", "event_id", "ts", "project_key")
    return asof_backward(hits, calls, by=["session_id"], left_at="ts", right_at="ts", tie="event_id", take=["tool", "event_id"])


def watches(watched: DataFrame, rows: DataFrame, sessions: DataFrame, *, now: datetime) -> DataFrame:
    """Verdict of each watch (watch_id, signature, project, created_at, days): no_change, watching, unobservable or verified.

    What came in a watch's time is a difference of running counts at its ends.
    """
    hits = rows.select("signature", bucketed(F.col("project_key")).alias("project"), "ts", F.lit(1).alias("one"))
    runs = sessions.select(bucketed(F.col("project_key")).alias("project"), F.col("started_at").alias("ts"), F.lit(1).alias("one"))
    ends = F.col("created_at") + F.make_interval(days=F.col("days"))
    w = watched.withColumn("ends_at", ends).withColumn("until", F.greatest("created_at", F.least("ends_at", F.lit(now))))
    counted = range_sum(w, hits, by=["signature", "project"], start="created_at", end="until", at="ts", value="one", out="post")
    counted = range_sum(counted, runs, by=["project"], start="created_at", end="until", at="ts", value="one", out="ran")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = F.when(zero("post") > 0, "no_change").when(F.col("ends_at") > F.lit(now), "watching").when(zero("ran") == 0, "unobservable").otherwise("verified")
    return counted.select("watch_id", zero("post").alias("post"), zero("ran").alias("ran"), status.alias("status"))

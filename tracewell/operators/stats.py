"""Session statistics, tool, program and file usage, token usage, histograms, periods and data quality."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.sessions import bucketed


def session_stats(sessions: DataFrame, events: DataFrame, friction: DataFrame, *, types: dict[str, str], expected: str = "expected_exit") -> DataFrame:
    """One row for each session: events by type (``types``: column -> event type), friction without and with expected exits apart, span and duration."""
    per = events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_events"), *[F.count_if(F.col("event_type") == t).alias(c) for c, t in types.items()], F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
    )
    out = F.coalesce(F.col("category") == expected, F.lit(False))
    hits = friction.groupBy("session_id", "signature").agg(F.count_if(~out).alias("n"), F.count_if(out).alias("x"), F.count_if(F.col("kind") == "user_interrupt").alias("i"))
    hits = hits.groupBy("session_id").agg(F.sum("n").alias("n_friction"), F.sum("x").alias("n_expected"), F.sum("i").alias("n_interrupts"), F.count_if(F.col("n") > 0).alias("n_signatures"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    counts = ["n_events", *types, "n_friction", "n_expected", "n_interrupts", "n_signatures"]
    joined = sessions.select("session_id").join(per, "session_id", "left").join(hits, "session_id", "left")
    return joined.select("session_id", *map(zero, counts), "first_at", "last_at", (F.unix_millis("last_at") - F.unix_millis("first_at")).alias("duration_ms"))


def projected_stats(sessions: DataFrame, commands: DataFrame, files: DataFrame) -> DataFrame:
    """Commands, failed commands, distinct files and child sessions of each session, and whether it is empty."""
    known_bad = F.coalesce((F.col("exit_code") != 0) & ~F.col("expected_exit"), F.lit(False))
    cmds = commands.groupBy("session_id").agg(F.count(F.lit(1)).alias("commands"), F.count_if(known_bad).alias("failed_commands"))
    paths = files.select("session_id", "path").distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("files"))
    kids = sessions.filter(F.col("parent_session_id").isNotNull()).groupBy(F.col("parent_session_id").alias("session_id")).agg(F.count(F.lit(1)).alias("subagents"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    all_ = sessions.select("session_id").join(cmds, "session_id", "left").join(paths, "session_id", "left").join(kids, "session_id", "left")
    return all_.select("session_id", *[zero(c).alias(c) for c in ("commands", "failed_commands", "files", "subagents")], ((zero("commands") == 0) & (zero("files") == 0)).alias("is_empty"))


def outcomes(known: Column, failed: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("calls"), F.count_if(known).alias("known"), F.count_if(failed).alias("failures")]


def known_outcome() -> Column:
    return F.col("exit_code").isNotNull()


def failed_outcome() -> Column:
    """Expected exits are known but no failures."""
    return F.coalesce((F.col("exit_code") != 0) & ~F.col("expected_exit"), F.lit(False))


def rate(part: Column, whole: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.round(F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0))), 6)


def tool_stats(commands: DataFrame, *, tool: str = "program") -> DataFrame:
    """Calls, known outcomes and failures by session and tool."""
    return commands.groupBy("session_id", tool).agg(*outcomes(known_outcome(), failed_outcome()))


def usage_by_tool(per_session: DataFrame, sessions: DataFrame, *, tool: str = "program") -> DataFrame:
    """Across sessions, by tool and source."""
    joined = per_session.join(sessions.select("session_id", "source"), "session_id")
    return joined.groupBy(tool, "source").agg(F.sum("calls").alias("calls"), F.count(F.lit(1)).alias("sessions"), F.sum("known").alias("known"), F.sum("failures").alias("failures"))


def program_usage(commands: DataFrame, *, families: tuple[str, ...] = (), most: int = 50) -> DataFrame:
    """Top programs with known outcomes, sessions, failures, expected exits and version family."""
    per = commands.groupBy("program", "session_id").agg(*outcomes(known_outcome(), failed_outcome()), F.count_if("expected_exit").alias("expected"))
    bare = F.regexp_replace("program", "[0-9.]+$", "")
    family = F.when(bare.isin(*families), bare).otherwise(F.col("program")) if families else F.col("program")
    got = per.groupBy("program").agg(F.sum("calls").alias("calls"), F.count(F.lit(1)).alias("sessions"), F.sum("known").alias("known"), F.sum("failures").alias("failures"), F.sum("expected").alias("expected"))
    return got.withColumn("family", family).orderBy(F.col("calls").desc(), "program").limit(most)


def failing_programs(commands: DataFrame, *, least_known: int = 30, most: int = 10) -> DataFrame:
    """Programs by failure rate over known outcomes, of which there must be ``least_known``."""
    got = commands.groupBy("program").agg(*outcomes(known_outcome(), failed_outcome())).filter(F.col("known") >= least_known)
    return got.withColumn("failure_rate", rate(F.col("failures"), F.col("known"))).orderBy(F.col("failure_rate").desc(), F.col("known").desc(), "program").limit(most)


def file_usage(files: DataFrame, *, most: int = 50) -> DataFrame:
    """Distinct sessions and counts by action of each path, most changed first."""
    per = files.groupBy("path", "session_id").agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("read", "edit", "write", "delete")], F.max("ts").alias("t"))
    got = per.groupBy("path").agg(F.count(F.lit(1)).alias("sessions"), *[F.sum(a).alias(f"{a}s") for a in ("read", "edit", "write", "delete")], F.max("t").alias("last_at"))
    return got.orderBy((F.col("edits") + F.col("writes")).desc(), F.col("sessions").desc(), "path").limit(most)


def below(files: DataFrame, prefix: str) -> DataFrame:
    """One row: distinct paths at or below a prefix and outside it."""
    inside = (F.col("path") == prefix) | F.col("path").startswith(prefix.rstrip("/") + "/") | (F.col("path").startswith(prefix) if prefix.endswith("/") else F.lit(False))
    return files.select("path").distinct().agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


def reread_files(files: DataFrame, *, least: int = 3, most: int = 8) -> DataFrame:
    """Paths read ``least`` times or more in one session: sessions and reads."""
    many = files.filter(F.col("action") == "read").groupBy("session_id", "path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return many.groupBy("path").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("reads")).orderBy(F.col("sessions").desc(), F.col("reads").desc(), "path").limit(most)


def final_values(records: DataFrame, *, by: list[str], message: str, order: str, measures: list[str]) -> DataFrame:
    """Usage repeated on several records of a message: the last record counts; a record without a message id is its own."""
    own = F.coalesce(F.nullif(F.col(message).cast("string"), F.lit("")), F.concat(F.lit("#"), F.col(order).cast("string")))
    last = records.groupBy(*by, own.alias("_m")).agg(F.max_by(F.struct(*measures), order).alias("_u"))
    return last.groupBy(*by).agg(*[F.sum(f"_u.{m}").alias(m) for m in measures], F.count(F.lit(1)).alias("messages"))


def running_totals(records: DataFrame, *, by: list[str], order: str, total: str, cached: str | None = None, written: str | None = None) -> DataFrame:
    """The last cumulative record is the total; what is neither cached nor written is never below zero."""
    names = [c for c in (total, cached, written) if c]
    last = records.filter(F.col(total).isNotNull()).groupBy(*by).agg(F.max_by(F.struct(*names), order).alias("_u")).select(*by, *[F.col(f"_u.{c}").alias(c) for c in names])
    if cached and written:
        last = last.withColumn("uncached", F.greatest(F.lit(0), F.col(total) - F.coalesce(cached, F.lit(0)) - F.coalesce(written, F.lit(0))))
    return last


def work_tokens(input_: str = "input_tokens", written: str = "cache_write_tokens", output: str = "output_tokens") -> Column:
    """Null if no part was measured."""
    parts = [F.col(c) for c in (input_, written, output)]
    return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)))


def usage_totals(sessions: DataFrame, usage: DataFrame, measures: list[str]) -> DataFrame:
    """One row: sessions in range, those with a record and with each measure, and the sums (null if none was measured)."""
    joined = sessions.select("session_id").join(usage.withColumn("_known", F.lit(True)), "session_id", "left")
    return joined.agg(F.count(F.lit(1)).alias("in_range"), F.count("_known").alias("known"), *[F.count(m).alias(f"{m}_sessions") for m in measures], *[F.sum(m).alias(m) for m in measures])


def usage_by_model(usage: DataFrame, *, model: str = "model", tokens: str = "total_tokens", most: int = 50) -> DataFrame:
    got = usage.groupBy(bucketed(F.col(model)).alias("model")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("turns").alias("turns"), F.sum(tokens).alias("tokens"))
    return got.orderBy(F.col("tokens").desc_nulls_last(), "model").limit(most)


def high_input_no_edit(usage: DataFrame, files: DataFrame, *, tokens: str = "total_tokens", least: int = 5_000_000, most: int = 5) -> DataFrame:
    """Sessions with many tokens and no edited file."""
    edited = files.filter(F.col("action") != "read").select("session_id").distinct()
    return usage.filter(F.col(tokens) >= least).join(edited, "session_id", "left_anti").orderBy(F.col(tokens).desc(), "session_id").limit(most)


def overview_totals(sessions: DataFrame, events: DataFrame, friction: DataFrame) -> DataFrame:
    """One row: sessions, projects, main and subagent threads, events, friction by kind, duration and how many have one, sessions by source."""
    s = sessions.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("thread_kind") == "main").alias("main_sessions"), F.count_if(F.col("thread_kind") == "subagent").alias("subagent_sessions"),
        F.sum(F.unix_millis("ended_at") - F.unix_millis("started_at")).alias("duration_ms"), F.count("ended_at").alias("with_duration"),
    )
    p = sessions.select("project_key").distinct().agg(F.count("project_key").alias("projects"))
    e = events.agg(F.count(F.lit(1)).alias("events"))
    f = friction.agg(F.count_if(F.col("kind") == "tool_error").alias("tool_errors"), F.count_if(F.col("kind") == "user_interrupt").alias("interrupts"))
    by = sessions.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source"))
    return s.crossJoin(p).crossJoin(e).crossJoin(f).crossJoin(by)


def daily(**tables: tuple[DataFrame, str]) -> DataFrame:
    """Rows of each table by day; days that any of them has. tables: name -> (rows, time column)."""
    parts = [df.groupBy(F.to_date(t).alias("day")).agg(F.count(F.lit(1)).alias("n")).select("day", *[(F.col("n") if m == name else F.lit(0)).alias(m) for m in tables]) for name, (df, t) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("day").agg(*[F.sum(m).cast("long").alias(m) for m in tables])


def hour_grid(rows: DataFrame, at: str, *, offset_minutes: int = 0) -> DataFrame:
    """Rows by weekday (Monday 0) and hour, in the viewer's time."""
    if not -840 <= offset_minutes <= 840:
        raise ValueError("an offset reaches 14 hours either way")
    t = F.col(at) + F.make_interval(mins=F.lit(offset_minutes))
    return rows.groupBy(F.weekday(t).alias("weekday"), F.hour(t).alias("hour")).agg(F.count(F.lit(1)).alias("count"))


def weekly(sessions: DataFrame, friction: DataFrame) -> DataFrame:
    """Sessions, duration and friction by the Monday their week begins with."""
    week = lambda c: F.to_date(F.date_trunc("week", c))
    s = sessions.groupBy(week("started_at").alias("week")).agg(F.count(F.lit(1)).alias("sessions"), F.sum(F.unix_millis("ended_at") - F.unix_millis("started_at")).alias("duration_ms"))
    f = friction.groupBy(week("ts").alias("week")).agg(F.count(F.lit(1)).alias("friction"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return s.join(f, "week", "full").select("week", zero("sessions"), zero("duration_ms"), zero("friction"))


def window_kpis(sessions: DataFrame, friction: DataFrame, *, start: datetime, end: datetime) -> DataFrame:
    """Each measure in [start, end] and in the window of equal length that ends a millisecond before it; the change is null if either was not measured."""
    length = end - start
    before_end = start - timedelta(milliseconds=1)
    before_start = before_end - length
    part = lambda c: F.when(F.col(c).between(F.lit(start), F.lit(end)), "now").when(F.col(c).between(F.lit(before_start), F.lit(before_end)), "before")
    s = sessions.withColumn("part", part("started_at")).filter("part is not null")
    one = s.groupBy("part").agg(F.count(F.lit(1)).cast("double").alias("sessions"), F.countDistinct("project_key").cast("double").alias("projects"), F.sum(F.unix_millis("ended_at") - F.unix_millis("started_at")).cast("double").alias("duration_ms"))
    two = friction.withColumn("part", part("ts")).filter("part is not null").groupBy("part").agg(F.count(F.lit(1)).cast("double").alias("friction"))
    both = one.join(two, "part", "full")
    long = both.select("part", F.stack(F.lit(4), *[x for k in ("sessions", "projects", "duration_ms", "friction") for x in (F.lit(k), F.col(k))]).alias("kpi", "value"))
    wide = long.groupBy("kpi").agg(F.max(F.when(F.col("part") == "now", F.col("value"))).alias("value"), F.max(F.when(F.col("part") == "before", F.col("value"))).alias("previous"))
    change = F.col("value") - F.col("previous")
    return wide.select("kpi", "value", "previous", change.alias("change"), F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "same").alias("direction"))


def quality_counts(sessions: DataFrame, friction: DataFrame) -> DataFrame:
    """One row: what is missing where."""
    blank = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    s = sessions.agg(F.count(F.lit(1)).alias("sessions"), blank("project_key").alias("without_project"), blank("model").alias("without_model"), F.count_if(F.col("started_at").isNull()).alias("without_start"), F.count_if(F.col("thread_kind") == "subagent").alias("subagents"))
    f = friction.agg(F.count(F.lit(1)).alias("friction"), blank("tool").alias("without_tool"), blank("category").alias("without_category"))
    return s.crossJoin(f)


def store_counts(**tables: DataFrame) -> DataFrame:
    """table and rows."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spans(rows: DataFrame, *, by: list[str], at: str) -> DataFrame:
    """First and last recorded time and the milliseconds between."""
    return rows.groupBy(*by).agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at")).withColumn("duration_ms", F.unix_millis("ended_at") - F.unix_millis("started_at"))

"""Queries over sessions, their filters, facets, statistics and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import sessions as S
from tracewell.operators import cells, sets, stats
from tracewell.plans.catalog import END, NOW, START, on_activity
from tracewell.sources.activity import Activity


def ms(c: str) -> F.Column:
    return F.unix_millis(c).alias(c)


def entries(c: str) -> F.Column:
    """A map as text, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)


def usage(a: Activity) -> DataFrame:
    """Measured usage of each session that has replies."""
    replies = a.messages.filter("role = 'assistant'")
    return replies.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("total_tokens").alias("total_tokens"), F.sum(F.when(F.col("k") % 2 == 0, F.col("total_tokens"))).alias("input_tokens"), F.sum(F.when(F.col("k") % 3 == 0, F.col("total_tokens"))).alias("output_tokens"), F.sum(F.when(F.col("k") % 5 == 0, F.col("total_tokens"))).alias("cache_write_tokens"))


def session_cells(a: Activity, **counts: F.Column) -> DataFrame:
    """Sessions with counts of their events, in one pass."""
    return cells.cells(a.events, by=["session_id", "source", "project_key", "thread_kind", "model"], at="ts", counts=counts, daily=False)


def is_error() -> F.Column:
    return F.col("event_type") == "error"


USAGE_SQL = """
, usage AS (
    SELECT session_id, count(*) AS turns, sum(total_tokens)::BIGINT AS total_tokens, sum(CASE WHEN k % 2 = 0 THEN total_tokens END)::BIGINT AS input_tokens,
        sum(CASE WHEN k % 3 = 0 THEN total_tokens END)::BIGINT AS output_tokens, sum(CASE WHEN k % 5 = 0 THEN total_tokens END)::BIGINT AS cache_write_tokens
    FROM v_messages WHERE role = 'assistant' GROUP BY session_id
)
"""


def filters(a: Activity) -> S.Predicates:
    return S.session_filters(projects=["p1", "p2", "p5", S.UNRECORDED], sources=["h1", "h2"], start=START, thread="all", having={"program": a.commands.filter("program in ('prog1', 'prog2')"), "file": a.files.filter("path = 'f1'")})


WHERE = "coalesce(project_key, '__unrecorded__') IN ('p1', 'p2', 'p5', '__unrecorded__')"
SOURCE = "source IN ('h1', 'h2')"
REST = "started_at >= TIMESTAMP '2024-01-15' AND session_id IN (SELECT session_id FROM v_commands WHERE program IN ('prog1', 'prog2')) AND session_id IN (SELECT session_id FROM v_files WHERE path = 'f1')"


@on_activity("P1_session_filters", f"SELECT session_id, source, coalesce(project_key, '__unrecorded__') AS project, (epoch_us(started_at) // 1000) AS started_at FROM v_sessions WHERE {WHERE} AND {SOURCE} AND {REST}")
def _(a):
    return S.filtered(a.sessions, filters(a)).select("session_id", "source", S.bucketed(F.col("project_key")).alias("project"), ms("started_at"))


@on_activity("P2_facet_without_own_filter", f"SELECT source, count(*) AS n FROM v_sessions WHERE {WHERE} AND {REST} GROUP BY source")
def _(a):
    return S.filtered(a.sessions, filters(a), exclude=["source"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@on_activity("P4_default_scope", "SELECT session_id, n_events FROM v_sessions WHERE thread_kind IS NULL OR thread_kind = 'main'")
def _(a):
    return S.counted_by_default(a.sessions).select("session_id", "n_events")


@on_activity("P6_missing_bucket", "SELECT coalesce(nullif(trim(project_key), ''), '__unrecorded__') AS project, count(*) AS n FROM v_sessions GROUP BY 1")
def _(a):
    return a.sessions.groupBy(S.bucketed(F.col("project_key")).alias("project")).agg(F.count(F.lit(1)).alias("n"))


@on_activity("P7_aggregate_filter", "SELECT f.category, count(*) AS n FROM v_friction f JOIN v_sessions s USING (session_id) WHERE s.model = 'm1' GROUP BY f.category")
def _(a):
    chosen = S.filtered(a.sessions, S.session_filters(models=["m1"])).select("session_id")
    return a.friction.join(chosen, "session_id", "left_semi").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@on_activity("P3_time_bounds", "SELECT session_id FROM v_sessions WHERE started_at >= TIMESTAMP '2024-01-24' AND started_at <= TIMESTAMP '2024-01-28 23:59:59.999'")
def _(a):
    low, high = S.time_bound("7d", now=NOW), S.time_bound("2024-01-28", now=NOW, upper=True)
    return S.filtered(a.sessions, S.session_filters(start=low, end=high)).select("session_id")


@on_activity("P11_path_prefix", "SELECT count(DISTINCT path) FILTER (starts_with(path, 'prog/f1')) AS inside, count(DISTINCT path) FILTER (NOT starts_with(path, 'prog/f1')) AS outside FROM (SELECT 'prog/' || path || '/x' || k AS path FROM v_files JOIN v_events USING (event_id))")
def _(a):
    paths = a.files.join(a.events.select("event_id", "k"), "event_id").select(F.concat(F.lit("prog/"), F.col("path"), F.lit("/x"), F.col("k").cast("string")).alias("path"))
    return stats.below(paths, "prog/f1")


@on_activity("P13_live_sessions", "SELECT session_id, live_children FROM (SELECT s.session_id, (SELECT count(*) FROM v_sessions c WHERE c.parent_session_id = s.session_id AND c.ended_at > TIMESTAMP '2024-01-30') AS live_children FROM v_sessions s WHERE s.ended_at > TIMESTAMP '2024-01-30')")
def _(a):
    return S.live(a.sessions, a.events.select("session_id", F.col("ts").alias("mtime")), now=NOW, minutes=1440).select("session_id", "live_children")


@on_activity("J1_session_star", USAGE_SQL + """
SELECT s.session_id, s.source, u.turns, u.total_tokens, m.n AS messages, p.model AS parent_model, (epoch_us(p.started_at) // 1000) AS parent_started_at
FROM v_sessions s LEFT JOIN usage u USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n FROM v_messages GROUP BY 1) m USING (session_id)
LEFT JOIN v_sessions p ON s.parent_session_id = p.session_id""")
def _(a):
    messages = a.messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))
    return S.star(a.sessions, usage=usage(a), messages=messages).select("session_id", "source", "turns", "total_tokens", "messages", "parent_model", ms("parent_started_at"))


@on_activity("J14_semi_joins", "SELECT session_id FROM v_sessions WHERE session_id IN (SELECT session_id FROM v_files) AND session_id IN (SELECT session_id FROM v_friction)")
def _(a):
    return a.sessions.join(a.files, "session_id", "left_semi").join(a.friction, "session_id", "left_semi").select("session_id")


@on_activity("J15_anti_joins", "SELECT session_id FROM v_sessions WHERE session_id NOT IN (SELECT session_id FROM v_commands)")
def _(a):
    return a.sessions.join(a.commands, "session_id", "left_anti").select("session_id")


@on_activity("J20_parent_of_child", "SELECT c.session_id, c.parent_session_id, p.session_id IS NOT NULL AS parent_known, (epoch_us(p.started_at) // 1000) AS parent_started_at FROM v_sessions c LEFT JOIN v_sessions p ON c.parent_session_id = p.session_id WHERE c.parent_session_id IS NOT NULL")
def _(a):
    return S.with_parent(a.sessions).select("session_id", "parent_session_id", "parent_known", ms("parent_started_at"))


@on_activity("A1_session_stats", """
, e AS (SELECT session_id, count(*) AS n_events, count(*) FILTER (event_type = 'click') AS n_user, count(*) FILTER (event_type = 'signup') AS n_assistant, count(*) FILTER (event_type = 'purchase') AS n_calls, min(ts) AS f, max(ts) AS l FROM v_events GROUP BY 1),
h AS (SELECT session_id, count(*) FILTER (category <> 'cat3') AS n_friction, count(*) FILTER (category = 'cat3') AS n_expected, count(*) FILTER (kind = 'user_interrupt') AS n_interrupts, count(DISTINCT signature) FILTER (category <> 'cat3') AS n_signatures FROM v_friction GROUP BY 1)
SELECT s.session_id, e.n_events, n_user, n_assistant, n_calls, coalesce(n_friction, 0) AS n_friction, coalesce(n_expected, 0) AS n_expected, coalesce(n_interrupts, 0) AS n_interrupts, coalesce(n_signatures, 0) AS n_signatures,
    (epoch_us(f) // 1000) AS first_at, (epoch_us(l) // 1000) AS last_at, (epoch_us(l) // 1000) - (epoch_us(f) // 1000) AS duration_ms
FROM v_sessions s LEFT JOIN e USING (session_id) LEFT JOIN h USING (session_id)""")
def _(a):
    got = stats.session_stats(a.sessions, a.events, a.friction, types={"n_user": "click", "n_assistant": "signup", "n_calls": "purchase"}, expected="cat3")
    return got.withColumns({"first_at": F.unix_millis("first_at"), "last_at": F.unix_millis("last_at")})


@on_activity("A2_projected_stats", """
SELECT s.session_id, (SELECT count(*) FROM v_commands c WHERE c.session_id = s.session_id) AS commands, (SELECT count(*) FROM v_commands c WHERE c.session_id = s.session_id AND exit_code <> 0 AND NOT expected_exit) AS failed_commands,
    (SELECT count(DISTINCT path) FROM v_files f WHERE f.session_id = s.session_id) AS files, (SELECT count(*) FROM v_sessions k WHERE k.parent_session_id = s.session_id) AS subagents,
    NOT EXISTS (SELECT 1 FROM v_commands c WHERE c.session_id = s.session_id) AND NOT EXISTS (SELECT 1 FROM v_files f WHERE f.session_id = s.session_id) AS is_empty
FROM v_sessions s""")
def _(a):
    return stats.projected_stats(a.sessions, a.commands, a.files)


OUTCOMES = "count(*) AS calls, count(exit_code) AS known, count(*) FILTER (exit_code <> 0 AND NOT expected_exit) AS failures"


@on_activity("A3_session_tool_stats", f"SELECT session_id, program, {OUTCOMES} FROM v_commands GROUP BY ALL")
def _(a):
    return stats.tool_stats(a.commands)


@on_activity("A4_tool_usage", "SELECT program, source, count(*) AS calls, count(DISTINCT session_id) AS sessions, count(exit_code) AS known, count(*) FILTER (exit_code <> 0 AND NOT expected_exit) AS failures FROM v_commands JOIN v_sessions USING (session_id) GROUP BY ALL")
def _(a):
    return stats.usage_by_tool(stats.tool_stats(a.commands), a.sessions)


@on_activity("A5_program_usage", "SELECT program, count(*) AS calls, count(DISTINCT session_id) AS sessions, count(exit_code) AS known, count(*) FILTER (exit_code <> 0 AND NOT expected_exit) AS failures, count(*) FILTER (expected_exit) AS expected, 'prog' AS family FROM v_commands GROUP BY program ORDER BY calls DESC, program LIMIT 5")
def _(a):
    return stats.program_usage(a.commands, families=("prog",), most=5)


@on_activity("A6_file_usage", "SELECT path, count(DISTINCT session_id) AS sessions, count(*) FILTER (action = 'read') AS reads, count(*) FILTER (action = 'edit') AS edits, 0::BIGINT AS writes, 0::BIGINT AS deletes, (epoch_us(max(ts)) // 1000) AS last_at FROM v_files GROUP BY path")
def _(a):
    return stats.file_usage(a.files).withColumn("last_at", F.unix_millis("last_at"))


@on_activity("A7_final_usage", """SELECT session_id, sum(total_tokens)::BIGINT AS total_tokens, count(*) AS messages FROM (
    SELECT session_id, k, arg_max(total_tokens, event_id) AS total_tokens FROM v_messages WHERE role = 'assistant' GROUP BY session_id, k) GROUP BY session_id""")
def _(a):
    return stats.final_values(a.messages.filter("role = 'assistant'"), by=["session_id"], message="k", order="event_id", measures=["total_tokens"])


@on_activity("A8_running_totals", "SELECT session_id, arg_max(total_tokens, event_id) AS total_tokens, arg_max(k::BIGINT, event_id) AS cached, greatest(0, arg_max(total_tokens, event_id) - arg_max(k::BIGINT, event_id) - arg_max(2 * k::BIGINT, event_id)) AS uncached, arg_max(2 * k::BIGINT, event_id) AS written FROM v_messages WHERE role = 'assistant' AND total_tokens IS NOT NULL GROUP BY session_id")
def _(a):
    rows = a.messages.filter("role = 'assistant'").withColumns({"cached": F.col("k").cast("long"), "written": F.col("k").cast("long") * 2})
    return stats.running_totals(rows, by=["session_id"], order="event_id", total="total_tokens", cached="cached", written="written")


@on_activity("A11_work_tokens", USAGE_SQL + "SELECT session_id, CASE WHEN coalesce(input_tokens, cache_write_tokens, output_tokens) IS NOT NULL THEN coalesce(input_tokens, 0) + coalesce(cache_write_tokens, 0) + coalesce(output_tokens, 0) END AS work_tokens FROM usage")
def _(a):
    return usage(a).select("session_id", stats.work_tokens().cast("long").alias("work_tokens"))


@on_activity("A12_usage_totals", USAGE_SQL + "SELECT count(*) AS in_range, count(u.session_id) AS known, count(input_tokens) AS input_tokens_sessions, count(total_tokens) AS total_tokens_sessions, sum(input_tokens)::BIGINT AS input_tokens, sum(total_tokens)::BIGINT AS total_tokens FROM v_sessions s LEFT JOIN usage u USING (session_id)")
def _(a):
    return stats.usage_totals(a.sessions, usage(a), ["input_tokens", "total_tokens"])


@on_activity("A13_usage_by_model", USAGE_SQL + "SELECT model, count(*) AS sessions, sum(turns)::BIGINT AS turns, sum(total_tokens)::BIGINT AS tokens FROM usage JOIN v_sessions USING (session_id) GROUP BY model")
def _(a):
    return stats.usage_by_model(usage(a).join(a.sessions.select("session_id", "model"), "session_id"))


@on_activity("A14_overview_totals", """
SELECT count(*) AS sessions, count(*) FILTER (thread_kind = 'main') AS main_sessions, count(*) FILTER (thread_kind = 'subagent') AS subagent_sessions, sum((epoch_us(ended_at) // 1000) - (epoch_us(started_at) // 1000))::BIGINT AS duration_ms, count(ended_at) AS with_duration,
    count(DISTINCT project_key) AS projects, (SELECT count(*) FROM v_events) AS events, (SELECT count(*) FROM v_friction WHERE kind = 'tool_error') AS tool_errors, (SELECT count(*) FROM v_friction WHERE kind = 'user_interrupt') AS interrupts,
    (SELECT string_agg(source || '=' || n, ',' ORDER BY source) FROM (SELECT source, count(*) AS n FROM v_sessions GROUP BY 1)) AS by_source
FROM v_sessions""")
def _(a):
    kind = F.col("k") % 20 == 0
    rows = session_cells(a, tool_errors=is_error() & ~kind, interrupts=is_error() & kind)
    return cells.overview(rows, extra=("tool_errors", "interrupts")).withColumn("by_source", entries("by_source"))


@on_activity("A15_daily", "SELECT day::VARCHAR AS day, sum(s)::BIGINT AS sessions, sum(e)::BIGINT AS events, sum(f)::BIGINT AS friction FROM (SELECT started_at::DATE AS day, 1 AS s, 0 AS e, 0 AS f FROM v_sessions UNION ALL SELECT ts::DATE, 0, 1, 0 FROM v_events UNION ALL SELECT ts::DATE, 0, 0, 1 FROM v_friction) GROUP BY 1")
def _(a):
    return stats.daily(sessions=(a.sessions, "started_at"), events=(a.events, "ts"), friction=(a.friction, "ts")).withColumn("day", F.col("day").cast("string"))


@on_activity("A16_hour_grid", "SELECT (isodow(t) - 1)::INT AS weekday, hour(t)::INT AS hour, count(*) AS count FROM (SELECT ts + INTERVAL 90 MINUTE AS t FROM v_events) GROUP BY ALL")
def _(a):
    return stats.hour_grid(a.events, "ts", offset_minutes=90)


@on_activity("A17_weekly", """
SELECT week::VARCHAR AS week, sum(s)::BIGINT AS sessions, sum(d)::BIGINT AS duration_ms, sum(f)::BIGINT AS friction FROM (
    SELECT date_trunc('week', started_at)::DATE AS week, 1 AS s, (epoch_us(ended_at) // 1000) - (epoch_us(started_at) // 1000) AS d, 0 AS f FROM v_sessions UNION ALL SELECT date_trunc('week', ts)::DATE, 0, 0, 1 FROM v_friction) GROUP BY 1""")
def _(a):
    return stats.weekly(a.sessions, a.friction).withColumn("week", F.col("week").cast("string"))


@on_activity("A20_facets", f"""
SELECT 'source' AS facet, source AS key, count(*) AS count FROM v_sessions WHERE {WHERE} AND {REST} GROUP BY ALL
UNION ALL SELECT 'project', coalesce(project_key, '__unrecorded__'), count(*) FROM v_sessions WHERE {SOURCE} AND {REST} GROUP BY ALL
UNION ALL SELECT 'model', model, count(*) FROM v_sessions WHERE {WHERE} AND {SOURCE} AND {REST} GROUP BY ALL""")
def _(a):
    k, edits = F.col("k"), (F.col("event_type") == "purchase")
    rows = session_cells(a, ran=edits & (k % 7).isin(1, 2), touched=((F.col("event_type") == "view") | (edits & (k % 4 == 0))) & (k % 5 == 1))
    project = S.bucketed(F.col("project_key"))
    rest = rows.filter((F.col("first_at") >= F.lit(START)) & (F.col("ran") > 0) & (F.col("touched") > 0))
    return cells.facets(rest, {"source": (F.col("source"), F.col("source").isin("h1", "h2")), "project": (project, project.isin("p1", "p2", "p5", S.UNRECORDED)), "model": (F.col("model"), F.lit(True))})


@on_activity("A27_projects", """
, b AS (SELECT coalesce(project_key, '__unrecorded__') AS project, source, count(*) AS n, min(started_at) AS f, max(started_at) AS l FROM v_sessions GROUP BY ALL)
SELECT b.project, sum(n)::BIGINT AS sessions, (epoch_us(min(f)) // 1000) AS first_started, (epoch_us(max(l)) // 1000) AS last_started, string_agg(source || '=' || n, ',' ORDER BY source) AS by_source,
    (SELECT count(*) FROM v_friction x WHERE coalesce(x.project_key, '__unrecorded__') = b.project) AS friction
FROM b GROUP BY b.project""")
def _(a):
    return cells.projects(session_cells(a, friction=is_error()), friction="friction").select("project", "sessions", ms("first_started"), ms("last_started"), entries("by_source"), "friction")


@on_activity("A28_project_page", "SELECT source, count(*) AS sessions, count(DISTINCT model) AS models, sum(n_events)::BIGINT AS events FROM v_sessions WHERE project_key = 'p3' GROUP BY source")
def _(a):
    mine = S.filtered(a.sessions, S.session_filters(projects=["p3"]))
    return mine.groupBy("source").agg(F.count(F.lit(1)).alias("sessions"), F.countDistinct("model").alias("models"), F.sum("n_events").alias("events"))


@on_activity("A30_kpi_change", """
, s AS (SELECT *, CASE WHEN started_at BETWEEN TIMESTAMP '2024-01-23' AND TIMESTAMP '2024-01-31' THEN 'now' WHEN started_at BETWEEN TIMESTAMP '2024-01-14 23:59:59.999' AND TIMESTAMP '2024-01-22 23:59:59.999' THEN 'before' END AS part FROM v_sessions),
f AS (SELECT *, CASE WHEN ts BETWEEN TIMESTAMP '2024-01-23' AND TIMESTAMP '2024-01-31' THEN 'now' WHEN ts BETWEEN TIMESTAMP '2024-01-14 23:59:59.999' AND TIMESTAMP '2024-01-22 23:59:59.999' THEN 'before' END AS part FROM v_friction),
k AS (SELECT 'sessions' AS kpi, part, count(*)::DOUBLE AS v FROM s GROUP BY part UNION ALL SELECT 'projects', part, count(DISTINCT project_key)::DOUBLE FROM s GROUP BY part
    UNION ALL SELECT 'duration_ms', part, sum((epoch_us(ended_at) // 1000) - (epoch_us(started_at) // 1000))::DOUBLE FROM s GROUP BY part UNION ALL SELECT 'friction', part, count(*)::DOUBLE FROM f GROUP BY part)
SELECT kpi, max(v) FILTER (part = 'now') AS value, max(v) FILTER (part = 'before') AS previous, max(v) FILTER (part = 'now') - max(v) FILTER (part = 'before') AS change,
    CASE sign(max(v) FILTER (part = 'now') - max(v) FILTER (part = 'before')) WHEN 1 THEN 'up' WHEN -1 THEN 'down' WHEN 0 THEN 'same' END AS direction
FROM k WHERE part IS NOT NULL GROUP BY kpi""")
def _(a):
    start = START.replace(day=23)
    rubs = {part: is_error() & cells.within("ts", window) for part, window in cells.windows(start, END).items()}
    return cells.kpis(session_cells(a, **rubs), start=start, end=END, friction={part: part for part in rubs})


@on_activity("A31_subagents", "SELECT s.model AS role, count(*) AS sessions, count(DISTINCT s.parent_session_id) AS parents, coalesce(sum(f.n), 0)::BIGINT AS friction FROM v_sessions s LEFT JOIN (SELECT session_id, count(*) AS n FROM v_friction GROUP BY 1) f USING (session_id) WHERE s.thread_kind = 'subagent' GROUP BY s.model")
def _(a):
    return S.subagents(a.sessions, a.friction)


@on_activity("A32_reread_files", "SELECT path, count(*) AS sessions, sum(n)::BIGINT AS reads FROM (SELECT session_id, path, count(*) AS n FROM v_files WHERE action = 'read' GROUP BY ALL HAVING count(*) >= 2) GROUP BY path")
def _(a):
    return stats.reread_files(a.files, least=2)


@on_activity("A34_failing_programs", "SELECT program, calls, known, failures, round(failures::DOUBLE / known, 6) AS failure_rate FROM (SELECT program, " + OUTCOMES + " FROM v_commands GROUP BY program) WHERE known >= 30 ORDER BY failure_rate DESC, known DESC, program LIMIT 5")
def _(a):
    return stats.failing_programs(a.commands, most=5)


@on_activity("A36_tokens_without_edits", USAGE_SQL + "SELECT session_id, total_tokens FROM usage WHERE total_tokens >= 10000 AND session_id NOT IN (SELECT session_id FROM v_files WHERE action <> 'read') ORDER BY total_tokens DESC, session_id LIMIT 5")
def _(a):
    return stats.high_input_no_edit(usage(a), a.files, least=10_000).select("session_id", "total_tokens")


@on_activity("A41_fleets", USAGE_SQL + "SELECT coalesce(parent_session_id, session_id) AS fleet_id, count(*) AS members, count(*) FILTER (parent_session_id IS NOT NULL) AS subagents, count(total_tokens) AS measured, sum(total_tokens)::BIGINT AS work_tokens, (epoch_us(min(started_at)) // 1000) AS started_at, (epoch_us(max(ended_at)) // 1000) AS ended_at FROM v_sessions LEFT JOIN usage USING (session_id) GROUP BY 1")
def _(a):
    return S.fleets(a.sessions, usage(a).select("session_id", F.col("total_tokens").alias("work_tokens"))).withColumns({"started_at": F.unix_millis("started_at"), "ended_at": F.unix_millis("ended_at")})


@on_activity("A47_quality_counts", "SELECT count(*) AS sessions, count(*) FILTER (coalesce(project_key, '') = '') AS without_project, count(*) FILTER (coalesce(model, '') = '') AS without_model, count(*) FILTER (started_at IS NULL) AS without_start, count(*) FILTER (thread_kind = 'subagent') AS subagents, (SELECT count(*) FROM v_friction) AS friction, (SELECT count(*) FROM v_friction WHERE coalesce(tool, '') = '') AS without_tool, (SELECT count(*) FROM v_friction WHERE coalesce(category, '') = '') AS without_category FROM v_sessions")
def _(a):
    return stats.quality_counts(a.sessions, a.friction)


@on_activity("A48_store_counts", "SELECT 'events' AS \"table\", count(*) AS rows FROM v_events UNION ALL SELECT 'sessions', count(*) FROM v_sessions UNION ALL SELECT 'friction', count(*) FROM v_friction")
def _(a):
    return stats.store_counts(events=a.events, sessions=a.sessions, friction=a.friction)


@on_activity("A53_session_spans", "SELECT session_id, (epoch_us(min(ts)) // 1000) AS started_at, (epoch_us(max(ts)) // 1000) AS ended_at, (epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000) AS duration_ms FROM v_events GROUP BY session_id")
def _(a):
    return stats.spans(a.events, by=["session_id"], at="ts").select("session_id", ms("started_at"), ms("ended_at"), "duration_ms")


@on_activity("A55_session_tags", "SELECT session_id, string_agg(kind || ':' || tag, ';' ORDER BY kind, tag) AS tags FROM (SELECT DISTINCT session_id, action AS kind, path AS tag FROM v_files) GROUP BY session_id")
def _(a):
    got = S.tags_of(a.files.select("session_id", F.col("action").alias("kind"), F.col("path").alias("tag")))
    return got.select("session_id", F.array_join(F.transform("tags", lambda t: F.concat_ws(":", t["kind"], t["tag"])), ";").alias("tags"))


@on_activity("O1_session_order", USAGE_SQL + "SELECT session_id, row_number() OVER (ORDER BY total_tokens DESC NULLS LAST, session_id DESC)::INT AS place FROM v_sessions LEFT JOIN usage USING (session_id) ORDER BY total_tokens DESC NULLS LAST, session_id DESC LIMIT 100")
def _(a):
    rows = a.sessions.join(usage(a).select("session_id", F.col("total_tokens").alias("work_tokens")), "session_id", "left").orderBy(*S.session_order("tokens")).limit(100)
    from pyspark.sql import Window as W

    return rows.select("session_id", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*S.session_order("tokens"))).alias("place"))


@on_activity("O2_page", "SELECT session_id, (SELECT count(*) FROM v_sessions) AS total, (SELECT count(*) FROM v_sessions) > 70 AS has_more FROM v_sessions ORDER BY started_at DESC, session_id DESC LIMIT 50 OFFSET 20")
def _(a):
    return S.page(a.sessions, S.session_order("recent"), offset=20).select("session_id", "total", "has_more")


@on_activity("O4_top_k", "SELECT path, count(*) AS n FROM v_files GROUP BY path ORDER BY n DESC, path LIMIT 3")
def _(a):
    return S.top(a.files.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "n", "path", 3)


@on_activity("U1_one_sequence", "SELECT 'command' AS row_kind, event_id, program, NULL AS path FROM v_commands UNION ALL SELECT 'file', event_id, NULL, path FROM v_files")
def _(a):
    return sets.one_sequence(command=a.commands.select("event_id", "program"), file=a.files.select("event_id", "path"))


@on_activity("U2_changed_keys", "SELECT session_id FROM v_commands WHERE event_id > 5000 UNION SELECT session_id FROM v_files WHERE event_id > 6000 UNION SELECT session_id FROM v_friction WHERE event_id > 7000")
def _(a):
    return sets.changed_keys([(a.commands, "event_id", 5000), (a.files, "event_id", 6000), (a.friction, "event_id", 7000)], "session_id")


@on_activity("U3_reconcile", """
, st AS (SELECT DISTINCT session_id, path, k % 3 = 0 AS gone FROM v_files JOIN v_events USING (session_id, event_id) WHERE v_files.event_id % 3 < 2),
stored AS (SELECT session_id, path, bool_and(gone) AS gone FROM st GROUP BY ALL), live AS (SELECT DISTINCT session_id, path FROM v_files WHERE event_id % 3 <> 1)
SELECT s.session_id, s.path, CASE WHEN l.path IS NULL AND NOT gone THEN 'retired' WHEN l.path IS NOT NULL AND gone THEN 'restored' ELSE 'kept' END AS status FROM stored s LEFT JOIN live l ON s.session_id = l.session_id AND s.path = l.path
UNION ALL SELECT l.session_id, l.path, 'new' FROM live l LEFT JOIN stored s ON s.session_id = l.session_id AND s.path = l.path WHERE s.path IS NULL""")
def _(a):
    """Every row lies on a side: stored, live or both."""
    marked = a.files.join(a.events.select("event_id", "k"), "event_id").filter("event_id % 3 < 2").groupBy("session_id", "path").agg(F.when(F.bool_and(F.col("k") % 3 == 0), F.lit(1)).alias("superseded_at"))
    return sets.reconcile(marked, a.files.filter("event_id % 3 <> 1").select("session_id", "path").distinct(), key=["session_id", "path"]).select("session_id", "path", "status")


@on_activity("S11_upsert_sessions", "SELECT session_id, (epoch_us(min(ts)) // 1000) AS started_at, (epoch_us(max(ts)) // 1000) AS ended_at, coalesce(max(n) FILTER (b = 1), max(n) FILTER (b = 0)) AS title, coalesce(max(n) FILTER (b = 0), max(n) FILTER (b = 1)) AS version FROM (SELECT session_id, ts, event_id % 2 AS b, count(*) OVER (PARTITION BY session_id, event_id % 2) AS n FROM v_events) GROUP BY session_id")
def _(a):
    half = lambda b: a.events.filter(F.col("event_id") % 2 == b).groupBy("session_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("title")).withColumn("version", F.col("title"))
    return sets.upsert_sessions(half(0), half(1), newer_wins=["title"], first_wins=["version"]).select("session_id", ms("started_at"), ms("ended_at"), "title", "version")


@on_activity("S12_export", "SELECT count(*) AS matched, least(count(*), 5000) AS exported FROM v_sessions WHERE " + SOURCE)
def _(a):
    return S.export(a.sessions, S.session_filters(sources=["h1", "h2"]), S.session_order("recent"))[1].withColumn("exported", F.col("exported").cast("long"))

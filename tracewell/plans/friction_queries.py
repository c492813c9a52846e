"""Queries over friction, signatures and their life cycle."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import rules
from tracewell.operators import friction as X
from tracewell.operators import ordered
from tracewell.operators import sessions as S
from tracewell.plans.catalog import END, NOW, START, on_activity
from tracewell.sources.activity import Activity

WINDOW = "ts >= TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-31'"


def base(a: Activity) -> DataFrame:
    violations = a.events.filter("event_type = 'view' and k % 25 = 0").select("session_id", "event_id", "ts", "source", "project_key", F.lit("violation").alias("kind"), "event_type")
    return X.base(a.friction, a.sessions, a.events, violations)


BASE_SQL = """
, base AS (
    SELECT f.session_id, f.event_id, f.ts, f.source, f.project_key, f.kind, f.tool, f.category, f.signature, s.thread_kind, s.model, e.event_type,
        (f.kind = 'tool_error')::INT AS is_tool_error, (f.kind = 'user_interrupt')::INT AS is_user_interrupt, 0 AS is_violation
    FROM v_friction f JOIN v_sessions s USING (session_id) LEFT JOIN v_events e ON e.session_id = f.session_id AND e.event_id = f.event_id
    UNION ALL
    SELECT e.session_id, e.event_id, e.ts, e.source, e.project_key, 'violation', NULL, NULL, NULL, s.thread_kind, s.model, e.event_type, 0, 0, 1
    FROM v_events e JOIN v_sessions s USING (session_id) WHERE e.event_type = 'view' AND e.k % 25 = 0
)
"""

LIFE_SQL = f"""
, life AS (
    SELECT signature, count(*) AS records, count(*) FILTER (kind = 'user_interrupt') AS interrupts, count(*) FILTER ({WINDOW}) AS window_records, count(DISTINCT session_id) AS sessions,
        count(DISTINCT session_id) FILTER ({WINDOW}) AS window_sessions, count(DISTINCT ts::DATE) AS days_active, min(ts) AS first_at, max(ts) AS last_at
    FROM v_friction GROUP BY signature
), states AS (
    SELECT *, CASE WHEN sessions <= 1 THEN 'once' WHEN first_at >= TIMESTAMP '2024-01-15' THEN 'new' WHEN window_records > 0 THEN 'active' ELSE 'quiet' END AS status FROM life
)
"""


@on_activity("J4_friction_base", BASE_SQL + "SELECT session_id, event_id, kind, coalesce(tool, '') AS tool, model, event_type, is_tool_error, is_user_interrupt, is_violation FROM base")
def _(a):
    return base(a).select("session_id", "event_id", "kind", F.coalesce("tool", F.lit("")).alias("tool"), "model", "event_type", "is_tool_error", "is_user_interrupt", "is_violation")


@on_activity("P5_friction_filters", BASE_SQL + "SELECT session_id, event_id FROM base WHERE coalesce(tool, '__unrecorded__') = 'tool1' AND coalesce(project_key, '__unrecorded__') = '__unrecorded__' AND contains(lower(concat_ws(' ', session_id, project_key, tool, category, signature)), 'sig4')")
def _(a):
    return X.matching(base(a), tool="tool1", project_key=S.UNRECORDED, text="SIG4").select("session_id", "event_id")


@on_activity("A21_event_collapse", BASE_SQL + """, twice AS (SELECT * FROM base UNION ALL SELECT * REPLACE ('user_interrupt' AS kind, 1 AS is_user_interrupt, 'tool9' AS tool) FROM base WHERE event_id % 5 = 0)
SELECT session_id, event_id, max(tool) AS tool, max(category) AS category, max(is_tool_error) AS is_tool_error, max(is_user_interrupt) AS is_user_interrupt, max(is_violation) AS is_violation
FROM twice GROUP BY session_id, event_id HAVING max(category) IS NULL OR max(category) <> 'cat3'""")
def _(a):
    again = base(a).filter("event_id % 5 = 0").withColumns({"kind": F.lit("user_interrupt"), "is_user_interrupt": F.lit(1), "tool": F.lit("tool9")})
    return X.collapsed(base(a).unionByName(again), expected="cat3")[0].select("session_id", "event_id", "tool", "category", "is_tool_error", "is_user_interrupt", "is_violation")


@on_activity("A22_friction_summary", """
SELECT count(*) AS total, count(*) FILTER (kind = 'tool_error') AS tool_errors, count(*) FILTER (kind = 'user_interrupt') AS interrupts, count(*) FILTER (tool IS NULL) AS tool_unrecorded, count(DISTINCT session_id) AS sessions,
    count(DISTINCT coalesce(project_key, '__unrecorded__')) AS projects, (SELECT count(*) FROM (SELECT signature FROM v_friction GROUP BY 1 HAVING count(DISTINCT session_id) >= 2)) AS recurring FROM v_friction""")
def _(a):
    return X.summary(a.friction)


@on_activity("A22_by_dimension", BASE_SQL + "SELECT coalesce(category, '__unrecorded__') AS category, count(*) AS records, count(DISTINCT session_id) AS sessions FROM base GROUP BY 1")
def _(a):
    return X.by_dimension(base(a), F.col("category"), name="category")


@on_activity("A23_friction_groups", f"""
SELECT coalesce(project_key, '__unrecorded__') AS g0, source AS g1, count(*) AS records, count(*) FILTER (kind = 'user_interrupt') AS interrupts, count(*) FILTER ({WINDOW}) AS window_records, count(DISTINCT session_id) AS sessions,
    count(DISTINCT session_id) FILTER ({WINDOW}) AS window_sessions, count(DISTINCT ts::DATE) AS days_active, (epoch_us(min(ts)) // 1000) AS first_at, (epoch_us(max(ts)) // 1000) AS last_at FROM v_friction GROUP BY 1, 2""")
def _(a):
    g = X.groups(a.friction, [S.bucketed(F.col("project_key")), F.col("source")], start=START, end=END)
    return g.withColumns({"first_at": F.unix_millis("first_at"), "last_at": F.unix_millis("last_at")})


def hinted(a: Activity) -> DataFrame:
    """Friction whose signatures carry evidence lines."""
    k = F.col("event_id") % 6
    line = F.when(k == 0, "bash: foo: command not found").when(k == 1, "permission denied").when(k == 2, "rg exit 2").when(k == 3, "syntax error near line #").when(k == 4, "timed out after # s").otherwise("nothing told")
    return a.friction.withColumn("signature", F.concat_ws("|", "category", "tool", line))


HINT_SQL = """
, hinted AS (SELECT * REPLACE (category || '|' || tool || '|' || CASE event_id % 6 WHEN 0 THEN 'bash: foo: command not found' WHEN 1 THEN 'permission denied' WHEN 2 THEN 'rg exit 2' WHEN 3 THEN 'syntax error near line #' WHEN 4 THEN 'timed out after # s' ELSE 'nothing told' END AS signature) FROM v_friction),
kinds AS (SELECT *, CASE WHEN regexp_matches(signature, '(?i)command not found') THEN 'environment' WHEN regexp_matches(signature, '(?i)permission denied') THEN 'permission' WHEN regexp_matches(signature, '(?i)timed out after') THEN 'timeout'
    WHEN regexp_matches(signature, '(?i)rg exit 2') THEN 'tool_misuse' WHEN regexp_matches(signature, '(?i)syntax ?error') THEN 'build' END AS hint FROM hinted)
"""


@on_activity("J21_signature_hints", HINT_SQL + "SELECT DISTINCT signature, hint FROM kinds")
def _(a):
    return hinted(a).select("signature").distinct().withColumn("hint", rules.hint_kind(F.col("signature")))


@on_activity("A24_hint_distribution", HINT_SQL + "SELECT coalesce(hint, '__unrecorded__') AS hint, count(DISTINCT signature) AS signatures, count(*) AS records, count(DISTINCT session_id) AS sessions FROM kinds GROUP BY 1")
def _(a):
    rows = hinted(a)
    known = rows.select("signature").distinct().withColumn("hint", S.bucketed(rules.hint_kind(F.col("signature"))))
    joined = rows.join(known, "signature")
    per = joined.groupBy("hint", "signature", "session_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("hint").agg(F.countDistinct("signature").alias("signatures"), F.sum("n").alias("records"), F.countDistinct("session_id").alias("sessions"))


@on_activity("A25_signature_lifecycle", LIFE_SQL + "SELECT signature, records, interrupts, window_records, sessions, window_sessions, days_active, (epoch_us(first_at) // 1000) AS first_at, (epoch_us(last_at) // 1000) AS last_at, status FROM states")
def _(a):
    return X.lifecycle(a.friction, start=START, end=END).withColumns({"first_at": F.unix_millis("first_at"), "last_at": F.unix_millis("last_at")})


@on_activity("A25_leading_by_status", LIFE_SQL + "SELECT status, signature, rank FROM (SELECT status, signature, (row_number() OVER (PARTITION BY status ORDER BY window_sessions DESC, sessions DESC, signature))::INT AS rank FROM states) WHERE rank <= 5")
def _(a):
    return X.leading(X.lifecycle(a.friction, start=START, end=END)).select("status", "signature", "rank")


@on_activity("A26_sessions_where_quiet", f"""
, q AS (SELECT signature FROM v_friction GROUP BY 1 HAVING count(DISTINCT session_id) > 1 AND min(ts) < TIMESTAMP '2024-01-27' AND count(*) FILTER (ts >= TIMESTAMP '2024-01-27' AND ts <= TIMESTAMP '2024-01-28') = 0),
p AS (SELECT DISTINCT signature, coalesce(project_key, '__unrecorded__') AS project FROM v_friction JOIN q USING (signature)),
r AS (SELECT coalesce(project_key, '__unrecorded__') AS project, count(*) AS n FROM v_sessions WHERE started_at >= TIMESTAMP '2024-01-27' AND started_at <= TIMESTAMP '2024-01-28' GROUP BY 1)
SELECT signature, coalesce(sum(n), 0)::BIGINT AS sessions_run FROM p LEFT JOIN r USING (project) GROUP BY signature""")
def _(a):
    low, high = START.replace(day=27), START.replace(day=28)
    return X.sessions_where_quiet(X.lifecycle(a.friction, start=low, end=high), a.friction, a.sessions, start=low, end=high)


@on_activity("O3_group_order", LIFE_SQL + "SELECT signature, status, place FROM (SELECT signature, status, (row_number() OVER (ORDER BY status = 'active' DESC, window_sessions DESC, records DESC, signature))::INT AS place FROM states) WHERE place <= 20")
def _(a):
    from pyspark.sql import Window as W

    order = [(F.col("status") == "active").desc(), F.col("window_sessions").desc(), F.col("records").desc(), F.col("signature")]
    first = X.lifecycle(a.friction, start=START, end=END).orderBy(*order).limit(20)
    return first.select("signature", "status", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)).alias("place"))


@on_activity("A37_stuck_loops", "SELECT signature, session_id, count(*) AS repeats, (epoch_us(min(ts)) // 1000) AS first_at, (epoch_us(max(ts)) // 1000) AS last_at FROM v_friction WHERE kind <> 'user_interrupt' GROUP BY signature, session_id HAVING count(*) >= 2")
def _(a):
    return X.stuck_loops(a.friction, least=2).withColumns({"first_at": F.unix_millis("first_at"), "last_at": F.unix_millis("last_at")})


def actions(a: Activity) -> DataFrame:
    commands = a.commands.select("session_id", "ts", "event_id", F.lit("command").alias("kind"), F.col("program").alias("label"))
    return commands.unionByName(a.files.filter("action = 'read'").select("session_id", "ts", "event_id", F.lit("file").alias("kind"), F.col("path").alias("label")))


ACTION_SQL = """
, actions AS (SELECT session_id, ts, event_id, 'command' AS kind, program AS label FROM v_commands UNION ALL SELECT session_id, ts, event_id, 'file', path FROM v_files WHERE action = 'read'),
hits AS (SELECT category AS signature, session_id, max(ts) AS hit_at FROM v_friction GROUP BY ALL),
nexts AS (SELECT signature, h.session_id, kind, label, row_number() OVER (PARTITION BY signature, h.session_id ORDER BY ts, event_id) AS position FROM hits h JOIN actions a ON a.session_id = h.session_id AND a.ts > h.hit_at)
"""


@on_activity("J22_what_followed", ACTION_SQL + "SELECT signature, session_id, kind, label, position::INT AS position FROM nexts WHERE position <= 5")
def _(a):
    return X.what_followed(a.friction.withColumn("signature", F.col("category")), actions(a))


@on_activity("A40_resolutions", ACTION_SQL + "SELECT signature, kind, label, count(DISTINCT session_id) AS sessions, count(*) AS count, sum(position)::BIGINT AS positions FROM nexts JOIN v_sessions s USING (session_id) JOIN hits h USING (signature, session_id) WHERE position <= 5 AND s.ended_at > h.hit_at GROUP BY ALL")
def _(a):
    return X.resolutions(a.friction.withColumn("signature", F.col("category")), actions(a), a.sessions)


@on_activity("A18_weekly_series", """
, f AS (SELECT category AS signature, session_id, floor((epoch(ts) - epoch(TIMESTAMP '2023-11-08')) / 604800)::INT AS week FROM v_friction WHERE ts >= TIMESTAMP '2023-11-08' AND ts < TIMESTAMP '2024-01-31'),
r AS (SELECT floor((epoch(started_at) - epoch(TIMESTAMP '2023-11-08')) / 604800)::INT AS week, count(*) AS n FROM v_sessions WHERE started_at < TIMESTAMP '2024-01-31' GROUP BY 1)
SELECT s.signature, w.week, (SELECT count(*) FROM f WHERE f.signature = s.signature AND f.week = w.week) AS records, (SELECT count(DISTINCT session_id) FROM f WHERE f.signature = s.signature AND f.week = w.week) AS sessions, coalesce(r.n, 0) AS sessions_run
FROM (SELECT DISTINCT category AS signature FROM v_friction) s CROSS JOIN (SELECT range::INT AS week FROM range(12)) w LEFT JOIN r ON r.week = w.week""")
def _(a):
    return X.weekly_series(a.friction.withColumn("signature", F.col("category")), a.sessions, now=NOW)


@on_activity("A50_evidence", """
, n AS (SELECT category AS signature, 'line ' || (event_id % 7) AS line, row_number() OVER (PARTITION BY category ORDER BY ts DESC, event_id DESC) AS r FROM v_friction),
d AS (SELECT signature, line, min(r) AS r FROM n WHERE r <= 12 GROUP BY ALL)
SELECT signature, array_to_string((list(line ORDER BY r))[1:3], ';') AS lines FROM d GROUP BY signature""")
def _(a):
    rows = a.friction.withColumns({"signature": F.col("category"), "line": F.concat(F.lit("line "), (F.col("event_id") % 7).cast("string"))})
    return X.evidence(rows).withColumn("lines", F.array_join("lines", ";"))


@on_activity("A49_top_friction", "SELECT tool, count(*) AS records, count(DISTINCT session_id) AS sessions FROM v_friction GROUP BY tool ORDER BY records DESC, tool LIMIT 2")
def _(a):
    return X.by_dimension(a.friction, F.col("tool"), name="tool", most=2)


@on_activity("J5_tool_before_interrupt", """
, calls AS (SELECT session_id, ts, event_id, program AS tool FROM v_commands)
SELECT f.session_id, f.event_id, c.tool AS last_tool, c.event_id AS last_event_id FROM v_friction f LEFT JOIN LATERAL (SELECT tool, event_id FROM calls c WHERE c.session_id = f.session_id AND c.ts <= f.ts ORDER BY ts DESC, event_id DESC LIMIT 1) c ON true WHERE f.kind = 'user_interrupt'""")
def _(a):
    return X.interrupts(a.friction, a.commands.withColumn("tool", F.col("program"))).select("session_id", "event_id", "last_tool", "last_event_id")


@on_activity("A35_interrupts", """
, calls AS (SELECT session_id, ts, event_id, program AS tool FROM v_commands),
j AS (SELECT f.session_id, f.event_id, c.tool FROM v_friction f LEFT JOIN LATERAL (SELECT tool FROM calls c WHERE c.session_id = f.session_id AND c.ts <= f.ts ORDER BY ts DESC, event_id DESC LIMIT 1) c ON true WHERE f.kind = 'user_interrupt')
SELECT coalesce(tool, '__unrecorded__') AS tool, count(*) AS interrupts, count(DISTINCT session_id) AS sessions FROM j GROUP BY 1""")
def _(a):
    hits = X.interrupts(a.friction, a.commands.withColumn("tool", F.col("program")))
    return hits.groupBy(S.bucketed(F.col("last_tool")).alias("tool")).agg(F.count(F.lit(1)).alias("interrupts"), F.countDistinct("session_id").alias("sessions"))


def turns(a: Activity) -> DataFrame:
    """Friction with the user message that opened its turn."""
    opened = a.messages.filter("role = 'user'")
    return ordered.asof_backward(a.friction.select("session_id", "event_id", "ts"), opened, by=["session_id"], left_at="ts", right_at="ts", tie="event_id", take=["event_id", "ts"])


@on_activity("J6_turn_of_record", "SELECT f.session_id, f.event_id, m.event_id AS last_event_id FROM v_friction f LEFT JOIN LATERAL (SELECT event_id FROM v_messages m WHERE m.session_id = f.session_id AND m.role = 'user' AND m.ts <= f.ts ORDER BY ts DESC, event_id DESC LIMIT 1) m ON true")
def _(a):
    return turns(a).select("session_id", "event_id", "last_event_id")


@on_activity("J7_tokens_since_turn", """
, t AS (SELECT f.session_id, f.event_id, f.ts, m.ts AS start FROM v_friction f LEFT JOIN LATERAL (SELECT ts FROM v_messages m WHERE m.session_id = f.session_id AND m.role = 'user' AND m.ts <= f.ts ORDER BY ts DESC, event_id DESC LIMIT 1) m ON true)
SELECT t.session_id, t.event_id, sum(m.total_tokens)::BIGINT AS cost FROM t LEFT JOIN v_messages m ON m.session_id = t.session_id AND m.role = 'assistant' AND m.ts > t.start AND m.ts <= t.ts WHERE t.start IS NOT NULL GROUP BY t.session_id, t.event_id""")
def _(a):
    spans = turns(a).filter("last_ts is not null")
    replies = a.messages.filter("role = 'assistant'")
    return ordered.range_sum(spans, replies, by=["session_id"], start="last_ts", end="ts", at="ts", value="total_tokens", out="cost").select("session_id", "event_id", "cost")


@on_activity("T9_watches", """
, w AS (SELECT DISTINCT category AS signature, coalesce(project_key, '__unrecorded__') AS project, category || coalesce(project_key, '__unrecorded__') AS watch_id, TIMESTAMP '2024-01-26' AS created_at, TIMESTAMP '2024-01-29' AS ends_at FROM v_friction),
p AS (SELECT watch_id, count(*) AS n FROM w JOIN v_friction f ON f.category = w.signature AND coalesce(f.project_key, '__unrecorded__') = w.project WHERE f.ts > created_at AND f.ts <= ends_at GROUP BY 1),
r AS (SELECT watch_id, count(*) AS n FROM w JOIN v_sessions s ON coalesce(s.project_key, '__unrecorded__') = w.project WHERE started_at > created_at AND started_at <= ends_at GROUP BY 1)
SELECT watch_id, coalesce(p.n, 0) AS post, coalesce(r.n, 0) AS ran, CASE WHEN coalesce(p.n, 0) > 0 THEN 'no_change' WHEN coalesce(r.n, 0) = 0 THEN 'unobservable' ELSE 'verified' END AS status FROM w LEFT JOIN p USING (watch_id) LEFT JOIN r USING (watch_id)""")
def _(a):
    rows = a.friction.withColumn("signature", F.col("category"))
    project = S.bucketed(F.col("project_key"))
    watched = rows.select("signature", project.alias("project"), F.concat("signature", project).alias("watch_id"), F.lit(START + timedelta(days=11)).alias("created_at"), F.lit(3).alias("days")).distinct()
    return X.watches(watched, rows, a.sessions, now=NOW)

"""Queries of as-of, interval and range joins and of windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import ordered as R
from tracewell.operators import sessions as S
from tracewell.plans.catalog import END, on_activity, on_tables


@on_tables("J2_call_result_pairs", """
SELECT r.l_orderkey, r.l_linenumber, c.l_linenumber AS call_event_id, c.l_partkey FROM lineitem r LEFT JOIN (SELECT l_orderkey, arg_min(l_linenumber, l_linenumber) AS l_linenumber, arg_min(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS l_partkey FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey) c USING (l_orderkey) WHERE r.l_linenumber > 2""")
def _(read):
    lines = read("lineitem").withColumns({"link": F.col("l_orderkey"), "_o": F.struct("l_linenumber", "l_partkey")})
    return R.pair_calls(lines.filter("l_linenumber <= 2"), lines.filter("l_linenumber > 2"), by=["l_orderkey"], link="link", order="_o", call_id="l_linenumber", take=["l_partkey"], result_id="l_linenumber").drop("link")


@on_activity("J3_preferred_pairs", "SELECT event_id, program AS tool FROM v_commands WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'by id' FROM v_commands WHERE event_id % 3 <> 0")
def _(a):
    recovered = a.commands.filter("event_id % 3 = 0").select("event_id", F.col("program").alias("tool"))
    return R.prefer(recovered, a.commands.select("event_id", F.lit("by id").alias("tool")), key=["event_id"])


@on_activity("J8_versions_in_force", """
, v AS (SELECT source, path AS asset, ts AS seen, row_number() OVER (PARTITION BY source, path ORDER BY ts, event_id) AS version FROM (SELECT f.*, s.source FROM v_files f JOIN v_sessions s USING (session_id) WHERE action = 'edit')),
m AS (SELECT s.session_id, v.asset, max(v.version) AS version FROM v_sessions s JOIN v ON v.source = s.source AND v.seen <= s.started_at GROUP BY ALL)
SELECT session_id, string_agg(asset || '=' || version, ',' ORDER BY asset) AS bundle FROM m GROUP BY session_id""")
def _(a):
    edits = a.files.filter("action = 'edit'").join(a.sessions.select("session_id", "source"), "session_id")
    seen = R.scan(edits, by=["source", "path"], order=["ts", "event_id"], total={"version": F.lit(1)}).select("source", F.col("path").alias("asset"), F.col("ts").alias("seen"), "version")
    got = R.versions_in_force(a.sessions, seen, session="session_id", at="started_at", asset="asset", seen="seen", version="version", share=["source"])
    return got.select("session_id", F.array_join(F.transform(F.array_sort(F.map_entries("bundle")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("bundle"))


@on_activity("J9_environment_changes", """
, l AS (SELECT session_id, source, model, project_key, lag(model) OVER w AS wm, lag(project_key) OVER w AS wp FROM v_sessions WINDOW w AS (PARTITION BY source ORDER BY started_at, session_id))
SELECT session_id, 'model' AS field, wm AS was, model AS now FROM l WHERE wm <> '' AND model <> '' AND wm <> model UNION ALL SELECT session_id, 'project_key', wp, project_key FROM l WHERE wp <> '' AND project_key <> '' AND wp <> project_key""")
def _(a):
    return R.previous_change(a.sessions, by=["source"], order=["started_at", "session_id"], fields=["model", "project_key"]).select("session_id", "field", "was", "now")


@on_activity("J10_previous_fleet", """
, f AS (SELECT s.session_id AS fleet_id, s.project_key, s.started_at FROM v_sessions s WHERE EXISTS (SELECT 1 FROM v_sessions c WHERE c.parent_session_id = s.session_id))
SELECT fleet_id, (SELECT max(b.fleet_id) FROM f b WHERE b.project_key IS NOT DISTINCT FROM f.project_key AND b.started_at = (SELECT max(started_at) FROM f x WHERE x.project_key IS NOT DISTINCT FROM f.project_key AND x.started_at < f.started_at)) AS previous_id FROM f""")
def _(a):
    kids = a.sessions.filter("parent_session_id is not null").groupBy(F.col("parent_session_id").alias("session_id")).agg(F.count(F.lit(1)).alias("subagents"))
    fleets = a.sessions.join(kids, "session_id").select(F.col("session_id").alias("fleet_id"), "project_key", "started_at", "subagents")
    return S.previous_fleet(fleets).select("fleet_id", "previous_id")


@on_activity("J11_markers_near", "SELECT f.event_id, count(*) AS markers, min(c.event_id) AS first_marker FROM v_friction f JOIN v_commands c USING (session_id) WHERE abs(epoch_us(f.ts) - epoch_us(c.ts)) <= 259200000000 GROUP BY f.event_id")
def _(a):
    met = R.near_in_time(a.friction.select("session_id", "event_id", "ts"), a.commands.select("session_id", F.col("event_id").alias("marker"), F.col("ts").alias("at")), left_at="ts", right_at="at", days=3, by=["session_id"])
    return met.groupBy("event_id").agg(F.count(F.lit(1)).alias("markers"), F.min("marker").alias("first_marker"))


@on_activity("J25_first_after", "SELECT f.event_id, c.event_id AS first_event_id FROM v_friction f LEFT JOIN LATERAL (SELECT event_id FROM v_commands c WHERE c.session_id = f.session_id AND c.ts >= f.ts ORDER BY ts, event_id LIMIT 1) c ON true")
def _(a):
    return R.asof_forward(a.friction.select("session_id", "event_id", "ts"), a.commands, by=["session_id"], left_at="ts", right_at="ts", tie="event_id", take=["event_id"]).select("event_id", "first_event_id")


@on_activity("J13_violation_after_call", "SELECT f.event_id, c.event_id AS last_event_id FROM v_friction f LEFT JOIN LATERAL (SELECT event_id FROM v_commands c WHERE c.session_id = f.session_id AND c.ts < f.ts ORDER BY ts DESC, event_id DESC LIMIT 1) c ON true")
def _(a):
    return R.asof_backward(a.friction.select("session_id", "event_id", "ts"), a.commands, by=["session_id"], left_at="ts", right_at="ts", tie="event_id", take=["event_id"], strict=True).select("event_id", "last_event_id")


@on_activity("W1_active_time", """
, c AS (SELECT user_id, epoch_us(ts) // 1000 AS t, epoch_us(max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) // 1000 AS clock FROM v_events)
SELECT user_id, coalesce(sum(t - clock) FILTER (t > clock AND t - clock <= 21600000), 0)::BIGINT AS active_ms FROM c GROUP BY user_id""")
def _(a):
    return R.active_time(a.events, by=["user_id"], at="ts", tie="event_id", gap_ms=6 * 3_600_000)


@on_activity("W2_peak_parallelism", """
, e AS (SELECT started_at AS moment, 1 AS up, 0 AS down FROM v_sessions UNION ALL SELECT ended_at, 0, 1 FROM v_sessions), g AS (SELECT moment, sum(up) AS up, sum(down) AS down FROM e GROUP BY moment),
n AS (SELECT moment, coalesce(sum(up - down) OVER (ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - down + up AS n FROM g)
SELECT max(n)::BIGINT AS peak, (SELECT epoch_us(min(moment)) // 1000 FROM n WHERE n = (SELECT max(n) FROM n)) AS peak_at, (SELECT count(*) FROM v_sessions) AS considered, 0::BIGINT AS unbounded FROM n""")
def _(a):
    return R.peak_parallelism(a.sessions, start="started_at", end="ended_at").withColumn("peak_at", F.unix_millis("peak_at"))


@on_activity("W3_newest_eight", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 8 AS is_current FROM v_events")
def _(a):
    return R.newest(a.events, by=["user_id"], at="ts", tie="event_id", n=8).select("event_id", "is_current")


@on_activity("W4_latest_shape", "SELECT event_id FROM (SELECT event_id, event_type, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS l FROM v_events) WHERE event_type = l")
def _(a):
    return R.of_latest(a.events, by=["user_id"], at="ts", tie="event_id", field="event_type").select("event_id")


@on_activity("W8_first_filled", "SELECT user_id, arg_min(project_key, struct_pack(ts := ts, id := event_id)) FILTER (project_key <> '') AS project_key, arg_min(k, struct_pack(ts := ts, id := event_id)) AS k FROM v_events GROUP BY user_id")
def _(a):
    return R.first_filled(a.events, by=["user_id"], order=["ts", "event_id"], fields=["project_key", "k"])


@on_activity("W9_last_of_call", "SELECT session_id, program, event_id, CASE WHEN row_number() OVER (PARTITION BY session_id, program ORDER BY ts DESC, event_id DESC) = 1 THEN exit_code END AS exit_code FROM v_commands")
def _(a):
    last = R.newest(a.commands, by=["session_id", "program"], at="ts", tie="event_id", n=1)
    return last.select("session_id", "program", "event_id", F.when(F.col("is_current"), F.col("exit_code")).alias("exit_code"))


@on_activity("W10_even_sample", """
, n AS (SELECT event_id, user_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM v_events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id FROM n WHERE n <= 10 OR list_contains(list_transform(range(10), lambda x: (x * (n - 1) + 4) // 9), i)""")
def _(a):
    return R.even_sample(a.events, by=["user_id"], order=["ts", "event_id"], most=10).select("event_id")


@on_activity("T8_state_intervals", "SELECT event_id, epoch_us(ts) // 1000 AS valid_from, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000 AS valid_to FROM v_events")
def _(a):
    return R.valid_intervals(a.events, by=["user_id"], at="ts", tie="event_id").select("event_id", F.unix_millis("valid_from").alias("valid_from"), F.unix_millis("valid_to").alias("valid_to"))


@on_activity("A9_turn_costs", """
, r AS (SELECT user_id, event_id, event_type, sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM v_events),
t AS (SELECT user_id, event_id, CASE WHEN event_type <> 'view' THEN total END AS total, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM r),
c AS (SELECT user_id, turn, arg_max(total, event_id) FILTER (total IS NOT NULL) AS close FROM t GROUP BY ALL),
o AS (SELECT user_id, turn, close - coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cost FROM c)
SELECT user_id, turn::BIGINT AS turn, (CASE WHEN cost >= 0 THEN cost END)::BIGINT AS turn_tokens FROM o WHERE turn > 0""")
def _(a):
    measured = R.scan(a.events, by=["user_id"], order=["event_id"], total={"total": F.round(F.col("value") * 100).cast("long")})
    rows = measured.withColumn("total", F.when(F.col("event_type") != "view", F.col("total")))
    return R.turn_costs(rows, by=["user_id"], order="event_id", opens=F.col("event_type") == "click", total="total").select("user_id", F.col("turn").cast("long").alias("turn"), "turn_tokens")


@on_activity("T4_live_loops", """
, w AS (SELECT session_id, signature, unnest(list_transform(range(12), lambda i: time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01') - i * INTERVAL 5 MINUTE)) AS s FROM (SELECT session_id, category AS signature, ts FROM v_friction))
SELECT epoch_us(s) // 1000 AS window_start, session_id, signature, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 2""")
def _(a):
    from tracewell.streaming import jobs

    rows = a.friction.select("session_id", F.col("category").alias("signature"), "ts")
    return jobs.loops(rows, least=2).withColumn("window_start", F.unix_millis("window_start"))


@on_activity("T4_live_view", """
, r AS (SELECT e.session_id, e.parent_session_id, e.ts, f.signature FROM v_events e LEFT JOIN v_friction f ON e.event_id = f.event_id),
l AS (SELECT session_id, max(parent_session_id) AS parent_session_id, epoch_us(max(ts) FILTER (signature IS NOT NULL)) // 1000 AS friction_last_at FROM r GROUP BY session_id HAVING max(ts) > TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR),
b AS (SELECT session_id, signature, count(*) AS n FROM r WHERE signature IS NOT NULL AND ts > TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR GROUP BY ALL HAVING count(*) >= 2)
SELECT l.session_id, l.parent_session_id, (SELECT count(*) FROM l c WHERE c.parent_session_id = l.session_id)::INT AS live_children, l.friction_last_at,
    (SELECT signature FROM b WHERE b.session_id = l.session_id ORDER BY n DESC, signature LIMIT 1) AS loop_signature, (SELECT n FROM b WHERE b.session_id = l.session_id ORDER BY n DESC, signature LIMIT 1)::INT AS loop_count
FROM l""")
def _(a):
    from tracewell.streaming import live

    rows = a.events.select("session_id", "parent_session_id", "ts", "event_id").join(a.friction.select("event_id", "signature"), "event_id", "left")
    return live.now_view(rows, END, live_ms=24 * 3_600_000, loop_ms=72 * 3_600_000, least=2).withColumn("friction_last_at", F.unix_millis("friction_last_at"))


@on_activity("T5_idle_gap_sessions", """
, l AS (SELECT user_id, ts, ts > lag(ts) OVER w + INTERVAL 6 HOUR AS new FROM v_events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(coalesce(new, true)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM l)
SELECT user_id, epoch_us(min(ts)) // 1000 AS started_at, (epoch_us(max(ts)) + 21600000000) // 1000 AS ends_at, count(*) AS n FROM g GROUP BY user_id, g""")
def _(a):
    from tracewell.streaming import jobs

    return jobs.idle_gap_sessions(a.events, gap="6 hours").withColumns({"started_at": F.unix_millis("started_at"), "ends_at": F.unix_millis("ends_at")})

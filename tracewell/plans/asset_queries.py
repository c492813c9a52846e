"""Queries over assets: versions, opportunities, participation, detectors and states. Assets are file paths by source."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import assets as A
from tracewell.operators import sets
from tracewell.plans.catalog import END, NOW, START, on_activity
from tracewell.sources.activity import Activity
from tracewell.streaming import jobs
from tracewell.streaming.evaluate import Facts, evaluate


def opportunities(a: Activity, files: DataFrame | None = None) -> DataFrame:
    """A session could have used an asset of its source if it touched it or ran a command."""
    paths = (a.files if files is None else files).select("session_id", F.col("path")).distinct()
    return paths.join(a.sessions.select("session_id", "source", F.col("started_at").alias("detected_at")), "session_id").select(F.concat_ws("/", "source", "path").alias("asset_id"), "session_id", "detected_at")


def participations(a: Activity, files: DataFrame | None = None) -> DataFrame:
    """An edit is an invocation, two or more reads are a load, one read an offer."""
    per = (a.files if files is None else files).groupBy("session_id", "path").agg(F.count_if(F.col("action") == "edit").alias("e"), F.count_if(F.col("action") == "read").alias("r"), F.max("ts").alias("occurred_at"))
    signal = F.when(F.col("e") > 0, "invoked").when(F.col("r") > 1, "loaded")
    rows = per.withColumn("signal", signal).filter("signal is not null").join(a.sessions.select("session_id", "source"), "session_id")
    return rows.select(F.concat_ws("/", "source", "path").alias("asset_id"), "session_id", "signal", F.col("signal").alias("level"), "occurred_at")


FACTS_SQL = """
, o AS (SELECT DISTINCT source || '/' || path AS asset_id, session_id, s.started_at AS detected_at FROM v_files JOIN v_sessions s USING (session_id)),
pp AS (SELECT session_id, path, count(*) FILTER (action = 'edit') AS e, count(*) FILTER (action = 'read') AS r, max(ts) AS occurred_at FROM v_files GROUP BY ALL),
p AS (SELECT source || '/' || path AS asset_id, session_id, CASE WHEN e > 0 THEN 'invoked' ELSE 'loaded' END AS signal, occurred_at FROM pp JOIN v_sessions USING (session_id) WHERE e > 0 OR r > 1),
op AS (SELECT o.*, p.session_id IS NOT NULL AS participated, p.signal, p.occurred_at, row_number() OVER (PARTITION BY o.asset_id ORDER BY detected_at DESC, o.session_id DESC) AS i FROM o LEFT JOIN p ON p.asset_id = o.asset_id AND p.session_id = o.session_id)
"""


@on_activity("W7_asset_versions", """
, f AS (SELECT source || '/' || path AS asset_id, 'c' || (k % 9) AS content_hash, min(v_files.ts) AS observed_at FROM v_files JOIN v_events USING (event_id) GROUP BY ALL)
SELECT asset_id, content_hash, epoch_us(observed_at) // 1000 AS observed_at, (row_number() OVER (PARTITION BY asset_id ORDER BY f.observed_at, content_hash))::INT AS version FROM f""")
def _(a):
    seen = a.files.join(a.events.select("event_id", "k", "source"), "event_id").select(F.concat_ws("/", "source", "path").alias("asset_id"), F.concat(F.lit("c"), (F.col("k") % 9).cast("string")).alias("content_hash"), F.col("ts").alias("observed_at"))
    return A.versions(seen).withColumn("observed_at", F.unix_millis("observed_at"))


@on_activity("A43_participation_rate", FACTS_SQL + "SELECT asset_id, count(*) AS sessions, count(*) FILTER (participated) AS participating, round(count(*) FILTER (participated)::DOUBLE / count(*), 6) AS rate FROM op WHERE detected_at >= TIMESTAMP '2024-01-15' AND detected_at < TIMESTAMP '2024-01-31' GROUP BY asset_id")
def _(a):
    return A.participation_rate(opportunities(a), participations(a), start=START, end=END, by=["asset_id"])


@on_activity("A44_asset_facts", FACTS_SQL + """
SELECT asset_id, count(*) AS sessions, count(*) FILTER (participated) AS participating, epoch_us(max(occurred_at)) // 1000 AS last_at, max(CASE signal WHEN 'invoked' THEN 5 WHEN 'loaded' THEN 3 END) AS strongest,
    count(*) FILTER (i <= 8) AS current_sessions, count(*) FILTER (i <= 8 AND participated) AS current_participating, count(*) FILTER (i > 8) AS baseline_sessions, count(*) FILTER (i > 8 AND participated) AS baseline_participating FROM op GROUP BY asset_id""")
def _(a):
    return A.facts(opportunities(a), participations(a)).withColumn("last_at", F.unix_millis("last_at"))


@on_activity("A45_funnel", FACTS_SQL + ", g AS (SELECT DISTINCT asset_id, unnest(['offered', 'loaded', 'invoked', 'observed-use', 'followed']) AS signal FROM p) SELECT g.asset_id, g.signal, n.sessions FROM g LEFT JOIN (SELECT asset_id, signal, count(DISTINCT session_id) AS sessions FROM p GROUP BY ALL) n ON n.asset_id = g.asset_id AND n.signal = g.signal")
def _(a):
    return A.funnel(participations(a)).select("asset_id", "signal", "sessions")


@on_activity("A46_sparkline", FACTS_SQL + """
, i AS (SELECT asset_id, participated, floor((floor(epoch(detected_at)) - epoch(TIMESTAMP '2024-01-15')) / 1382400.0 * 11)::INT AS bucket FROM op WHERE detected_at BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-31'),
c AS (SELECT asset_id, bucket, count(*) AS n, count(*) FILTER (participated) AS h FROM i GROUP BY ALL)
SELECT g.asset_id, g.bucket, ((h * 100 + n // 2) // n)::BIGINT AS percent FROM (SELECT asset_id, range::INT AS bucket FROM (SELECT DISTINCT asset_id FROM i), range(12)) g LEFT JOIN c ON c.asset_id = g.asset_id AND c.bucket = g.bucket""")
def _(a):
    did = participations(a).select("asset_id", "session_id").distinct().withColumn("did", F.lit(True))
    points = opportunities(a).join(did, ["asset_id", "session_id"], "left")
    return A.sparkline(points, by=["asset_id"], at="detected_at", hit=F.coalesce("did", F.lit(False)), start=START, end=END)


def judged(a: Activity, files: DataFrame | None = None) -> DataFrame:
    did = participations(a, files).select("asset_id", "session_id").distinct().withColumn("did", F.lit(True))
    return opportunities(a, files).join(did, ["asset_id", "session_id"], "left").withColumn("participated", F.coalesce("did", F.lit(False)))


SILENCE_SQL = FACTS_SQL + """
, g AS (SELECT asset_id, count(*) FILTER (i > 8) AS history, count(*) FILTER (i > 8 AND participated) AS history_hits, count(*) FILTER (i <= 8) AS recent, 0::BIGINT AS recent_unknown, count(*) FILTER (i <= 8 AND participated) AS recent_hits FROM op GROUP BY asset_id),
r AS (SELECT *, CASE WHEN history < 5 THEN 'too_little_history' WHEN history_hits < 0.3 * history THEN 'rate_was_low' WHEN recent < 8 THEN 'too_few_recent' WHEN recent_hits > 0 THEN 'took_part' ELSE 'silent' END AS reason FROM g)
SELECT *, reason = 'silent' AS triggered FROM r"""


@on_activity("W5_silence", SILENCE_SQL)
def _(a):
    return A.silence(judged(a))


@on_activity("U2_incremental_verdicts", SILENCE_SQL)
def _(a):
    """Silence by passes: all assets after the first half of the facts, then twice only those with new facts."""
    store = jobs.Store(a.spark, jobs.shared_path(a.spark, "verdicts"), parts=16, key="asset_id")
    touched = a.files.join(a.sessions.select("session_id", "source"), "session_id").withColumn("asset_id", F.concat_ws("/", "source", "path"))
    half = a.files.agg(F.expr("approx_percentile(event_id, array(0.5, 0.98))").alias("at")).first()["at"] or [0, 0]
    for minutes, most in enumerate([F.col("event_id") <= half[0], F.col("event_id") <= half[1], F.lit(True)]):
        rows = touched.filter(most)
        judge = lambda wanted, facts: A.silence(judged(a, facts["files"].drop("source", "asset_id")).join(wanted, "asset_id", "left_semi"))
        evaluate(store, rows.select("asset_id"), {"files": Facts(rows, "event_id")}, judge, as_of=NOW + timedelta(minutes=10 * minutes))
    found = store.load("verdicts")
    return A.silence(judged(a)).limit(0) if found is None else found.drop("_part")


@on_activity("W6_degradation", FACTS_SQL + ", g AS (SELECT asset_id, count(*) FILTER (i <= 5) AS n, count(*) FILTER (i <= 5 AND participated) AS h, count(*) FILTER (i > 5) AS bn, count(*) FILTER (i > 5 AND participated) AS bh FROM op GROUP BY asset_id) SELECT *, n >= 5 AND bn > 0 AND h * bn * 2 < bh * n AS triggered FROM g")
def _(a):
    return A.degradation(judged(a))


@on_activity("T7_dormancy", FACTS_SQL + "SELECT o.asset_id, epoch_us(min(detected_at)) // 1000 AS first_seen, (SELECT count(DISTINCT session_id) FROM p WHERE p.asset_id = o.asset_id) AS sessions, min(detected_at) <= TIMESTAMP '2024-01-29' AND (SELECT count(DISTINCT session_id) FROM p WHERE p.asset_id = o.asset_id) <= 40 AS dormant FROM o GROUP BY o.asset_id")
def _(a):
    first = opportunities(a).groupBy("asset_id").agg(F.min("detected_at").alias("first_seen"))
    return A.dormancy(first, participations(a), now=NOW, days=2, most=40).withColumn("first_seen", F.unix_millis("first_seen"))


@on_activity("W11_resurrection", FACTS_SQL + """
, n AS (SELECT asset_id, participated, row_number() OVER (PARTITION BY asset_id ORDER BY detected_at, session_id) AS j FROM op WHERE detected_at > TIMESTAMP '2024-01-29'),
g AS (SELECT asset_id, min(j) FILTER (participated) AS first_hit, count(*) AS known FROM n GROUP BY asset_id)
SELECT a.asset_id, coalesce(known, 0) AS known, CASE WHEN first_hit <= 8 THEN 'success' WHEN known >= 8 THEN 'failure' WHEN first_hit IS NOT NULL THEN 'success' ELSE 'open' END AS outcome FROM (SELECT DISTINCT asset_id FROM o) a LEFT JOIN g USING (asset_id)""")
def _(a):
    since = opportunities(a).select("asset_id").distinct().withColumn("since", F.lit(START.replace(day=29)))
    return A.resurrection(judged(a), since)


@on_activity("A52_cumulative_participation", FACTS_SQL + "SELECT asset_id, count(DISTINCT session_id) AS sessions FROM p GROUP BY asset_id")
def _(a):
    return participations(a).select("asset_id", "session_id").distinct().groupBy("asset_id").agg(F.count(F.lit(1)).alias("sessions"))


@on_activity("T8_state_history", "SELECT user_id, event_type AS state, epoch_us(ts) // 1000 AS started_at, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000 AS ended_at FROM v_events")
def _(a):
    moves = a.events.select("user_id", F.col("event_type").alias("to_state"), F.col("ts").alias("occurred_at"), F.col("event_id").alias("id"))
    return A.state_history(moves, asset="user_id").select("user_id", "state", F.unix_millis("started_at").alias("started_at"), F.unix_millis("ended_at").alias("ended_at"))


@on_activity("J12_clusters", """
, anchors AS (SELECT event_id AS id, ts FROM v_events), moves AS (SELECT DISTINCT source || '/' || category AS asset_id, ts FROM v_friction),
c AS (SELECT a.id, a.ts, list_sort(list(DISTINCT asset_id)) AS s FROM anchors a JOIN moves m ON abs(epoch_us(a.ts) - epoch_us(m.ts)) <= 5 * 86400000000 GROUP BY a.id, a.ts)
SELECT min(id) AS anchor_id, array_to_string(s, ',') AS assets FROM c WHERE len(s) >= 2 GROUP BY ts, s""")
def _(a):
    anchors = a.events.select(F.col("event_id").alias("id"), "ts")
    moves = a.friction.select(F.concat_ws("/", "source", "category").alias("asset_id"), "ts")
    return A.clusters(anchors, moves).select("anchor_id", F.array_join("assets", ",").alias("assets"))


@on_activity("T13_opportunity_facts", """
, t AS (SELECT session_id, string_agg(path, '|' ORDER BY path) AS shape_class, min(ts) AS detected_at FROM (SELECT session_id, lower(trim(path)) AS path, min(ts) AS ts FROM v_files GROUP BY 1, 2) GROUP BY session_id)
SELECT session_id, shape_class, 'a' || n AS asset_id, epoch_us(detected_at) // 1000 AS detected_at FROM t JOIN (SELECT unnest([1, 2]) AS n) x ON shape_class IN ('f0|f1', 'f2') OR (shape_class = 'f3' AND n = 1)""")
def _(a):
    known = a.spark.createDataFrame([("a1", "f0|f1"), ("a2", "f0|f1"), ("a1", "f2"), ("a2", "f2"), ("a1", "f3")], "asset_id string, shape_class string")
    got = A.opportunity_facts(a.files.select("session_id", F.col("path").alias("tag"), "ts"), known)
    return got.select("session_id", "shape_class", "asset_id", F.unix_millis("detected_at").alias("detected_at"))


@on_activity("T15_rebuilt_tags", "SELECT DISTINCT session_id, 'user' AS kind, path AS tag FROM v_files WHERE action = 'edit' UNION SELECT DISTINCT session_id, 'task', program FROM v_commands")
def _(a):
    stored = a.files.select("session_id", F.when(F.col("action") == "edit", "user").otherwise("task").alias("kind"), F.col("path").alias("tag"))
    return sets.rebuilt_tags(a.commands.select("session_id", F.lit("task").alias("kind"), F.col("program").alias("tag")), stored)


@on_activity("T16_changed_checks", """
, n AS (SELECT session_id, string_agg(DISTINCT path, ',' ORDER BY path) AS items FROM v_files WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT session_id, string_agg(DISTINCT path, ',' ORDER BY path) AS items FROM v_files WHERE event_id % 2 = 1 GROUP BY 1)
SELECT n.session_id, n.items FROM n LEFT JOIN b USING (session_id) WHERE n.items IS DISTINCT FROM b.items""")
def _(a):
    half = lambda b: a.files.filter(F.col("event_id") % 2 == b).select("session_id", "path")
    got = sets.changed_only(half(0), half(1), key=["session_id"], items=["path"])
    return got.select("session_id", F.array_join(F.transform("items", lambda i: i["path"]), ",").alias("items"))


@on_activity("T12_rekeyed_events", "SELECT CASE WHEN event_id % 10 = 0 THEN 'moved' || user_id ELSE session_id END AS session_id, event_id FROM v_events")
def _(a):
    moves = a.events.filter("event_id % 10 = 0").select("session_id", F.col("event_id").alias("raw_ref"), F.concat(F.lit("moved"), F.col("user_id").cast("string")).alias("to_session"))
    return sets.rekeyed(a.events.withColumn("raw_ref", F.col("event_id")), moves).select("session_id", "event_id")

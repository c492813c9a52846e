"""Session-shaped views over an event table: sessions, messages, files, commands and friction.

The event table has event_id, ts, user_id, event_type, value and props (JSON with
an integer ``k``). A session is a user in a week. Times become timestamps once,
here. ``SQL`` states the same views for a SQL engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Activity:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.raw = spark, spark.read.parquet(f"{sf_dir}/events.parquet")

    @cached_property
    def events(self) -> DataFrame:
        user, week = F.col("user_id"), F.to_date(F.date_trunc("week", F.col("ts")))
        base = self.raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
        return base.select(
            "*",
            F.concat_ws(":", user, week).alias("session_id"),
            F.concat(F.lit("h"), (user % 3).cast("string")).alias("source"),
            F.when(user % 12 != 11, F.concat(F.lit("p"), (user % 12).cast("string"))).alias("project_key"),
            F.when(user % 4 == 0, "main").otherwise("subagent").alias("thread_kind"),
            F.when(user % 4 != 0, F.concat_ws(":", user - user % 4, week)).alias("parent_session_id"),
            F.concat(F.lit("m"), (user % 4).cast("string")).alias("model"),
        )

    @cached_property
    def sessions(self) -> DataFrame:
        same = ["session_id", "source", "project_key", "thread_kind", "parent_session_id", "model", "user_id"]
        return self.events.groupBy(*same).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("n_events"))

    @cached_property
    def messages(self) -> DataFrame:
        is_reply = F.col("event_type") == "signup"
        rows = self.events.filter(F.col("event_type").isin("click", "signup"))
        return rows.select("session_id", "event_id", "ts", "k", F.when(is_reply, "assistant").otherwise("user").alias("role"), F.when(is_reply, F.round(F.col("value") * 100).cast("long")).alias("total_tokens"))

    @cached_property
    def files(self) -> DataFrame:
        read, edit = F.col("event_type") == "view", (F.col("event_type") == "purchase") & (F.col("k") % 4 == 0)
        return self.events.filter(read | edit).select("session_id", "event_id", "ts", F.concat(F.lit("f"), (F.col("k") % 5).cast("string")).alias("path"), F.when(read, "read").otherwise("edit").alias("action"))

    @cached_property
    def commands(self) -> DataFrame:
        k, code = F.col("k"), F.when(F.col("k") % 10 != 9, F.col("k") % 3)
        rows = self.events.filter(F.col("event_type") == "purchase")
        return rows.select("session_id", "event_id", "ts", F.concat(F.lit("prog"), (k % 7).cast("string")).alias("program"), code.alias("exit_code"), F.coalesce((code == 1) & (k % 7 < 2), F.lit(False)).alias("expected_exit"))

    @cached_property
    def friction(self) -> DataFrame:
        k = F.col("k")
        tool, category = F.concat(F.lit("tool"), (k % 3).cast("string")), F.concat(F.lit("cat"), (k % 4).cast("string"))
        rows = self.events.filter(F.col("event_type") == "error")
        return rows.select(
            "session_id", "event_id", "ts", "source", "project_key",
            F.when(k % 20 == 0, "user_interrupt").otherwise("tool_error").alias("kind"),
            tool.alias("tool"), category.alias("category"),
            F.concat_ws("|", category, tool, F.concat(F.lit("sig"), (k % 10).cast("string"))).alias("signature"),
        )


SQL = """
WITH v_events AS (
    SELECT event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') AS INT) AS k,
        user_id || ':' || date_trunc('week', ts)::DATE AS session_id, 'h' || (user_id % 3) AS source,
        CASE WHEN user_id % 12 <> 11 THEN 'p' || (user_id % 12) END AS project_key,
        CASE WHEN user_id % 4 = 0 THEN 'main' ELSE 'subagent' END AS thread_kind,
        CASE WHEN user_id % 4 <> 0 THEN (user_id - user_id % 4) || ':' || date_trunc('week', ts)::DATE END AS parent_session_id,
        'm' || (user_id % 4) AS model
    FROM events
), v_sessions AS (
    SELECT session_id, source, project_key, thread_kind, parent_session_id, model, user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_events
    FROM v_events GROUP BY ALL
), v_messages AS (
    SELECT session_id, event_id, ts, k, CASE WHEN event_type = 'signup' THEN 'assistant' ELSE 'user' END AS role,
        CASE WHEN event_type = 'signup' THEN round(value * 100)::BIGINT END AS total_tokens
    FROM v_events WHERE event_type IN ('click', 'signup')
), v_files AS (
    SELECT session_id, event_id, ts, 'f' || (k % 5) AS path, CASE WHEN event_type = 'view' THEN 'read' ELSE 'edit' END AS action
    FROM v_events WHERE event_type = 'view' OR (event_type = 'purchase' AND k % 4 = 0)
), v_commands AS (
    SELECT session_id, event_id, ts, 'prog' || (k % 7) AS program, CASE WHEN k % 10 <> 9 THEN k % 3 END AS exit_code,
        coalesce((CASE WHEN k % 10 <> 9 THEN k % 3 END) = 1 AND k % 7 < 2, false) AS expected_exit
    FROM v_events WHERE event_type = 'purchase'
), v_friction AS (
    SELECT session_id, event_id, ts, source, project_key, CASE WHEN k % 20 = 0 THEN 'user_interrupt' ELSE 'tool_error' END AS kind,
        'tool' || (k % 3) AS tool, 'cat' || (k % 4) AS category, 'cat' || (k % 4) || '|tool' || (k % 3) || '|sig' || (k % 10) AS signature
    FROM v_events WHERE event_type = 'error'
)
"""

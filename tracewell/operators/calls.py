"""Tool calls: their commands and files, launch identities, tool names through pairs, missing and working commands, versions of derived rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.text import absolute, normalized_line, patch_files

#: Programs that only look around.
NAVIGATION = ("cd", "ls", "pwd", "cat", "head", "tail", "echo", "find", "rg", "grep", "sed", "wc", "which")
OPAQUE_ID = r"^(?:call_|toolu_|fc_)[A-Za-z0-9_]+$"


def commands_of(tool_input: Column) -> Column:
    """The commands of a call: a JSON field, else ``cmd:`` literals of a script, else none."""
    field = F.coalesce(*[F.get_json_object(tool_input, f"$.{k}") for k in ("command", "cmd", "script")])
    script = F.regexp_extract_all(tool_input, F.lit(r'cmd:\s*"((?:[^"\\]++|\\.)*+)"'), F.lit(1))
    clean = F.transform(script, lambda c: F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")))
    return F.when(field.isNotNull(), F.array(field)).otherwise(F.coalesce(clean, F.array().cast("array<string>")))


def files_of(tool: Column, tool_input: Column, cwd: Column) -> Column:
    """(path, action) of a call: a path field by tool, or the heads of a patch; relative paths below the working directory."""
    low = F.lower(tool)
    path = F.coalesce(*[F.get_json_object(tool_input, f"$.{k}") for k in ("file_path", "notebook_path", "path")])
    action = F.when(low == "read", "read").when(low.isin("edit", "multiedit", "notebookedit"), "edit").when(low == "write", "write")
    one = F.array(F.struct(absolute(path, cwd).alias("path"), action.alias("action")))
    many = F.transform(patch_files(tool_input), lambda f: F.struct(absolute(f["path"], cwd).alias("path"), f["action"].alias("action")))
    return F.when(path.isNotNull() & action.isNotNull(), one).otherwise(many)


def line_changes(tool: Column, tool_input: Column) -> tuple[Column, Column]:
    """(lines added, lines removed) of an edit or a write."""
    n = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.size(F.split(c, "\n")))
    js = lambda p: F.get_json_object(tool_input, p)
    low = F.lower(tool)
    return F.when(low == "write", n(js("$.content"))).when(low == "edit", n(js("$.new_string"))), F.when(low == "write", 0).when(low == "edit", n(js("$.old_string")))


def launched(subagents: DataFrame, results: DataFrame, calls: DataFrame) -> DataFrame:
    """Subagents without a role take role and description from the call whose result names their id.

    subagents: session_id, agent_id. results: session_id, call_id, output.
    calls: session_id, call_id, tool_input.
    """
    told = results.withColumn("agent_id", F.nullif(F.regexp_extract("output", r"agentId: (\S+)", 1), F.lit(""))).filter("agent_id is not null")
    first = told.groupBy("agent_id").agg(F.min_by(F.struct(F.col("session_id").alias("parent"), "call_id"), F.struct("session_id", "call_id")).alias("_r"))
    by = first.select("agent_id", "_r.parent", "_r.call_id").join(calls.select(F.col("session_id").alias("parent"), "call_id", "tool_input"), ["parent", "call_id"])
    known = by.select("agent_id", "parent", F.get_json_object("tool_input", "$.subagent_type").alias("role"), F.get_json_object("tool_input", "$.description").alias("description"))
    return subagents.join(known, "agent_id", "left")


def tool_identity(friction: DataFrame, pairs: DataFrame, calls: DataFrame) -> DataFrame:
    """The paired call's name beats the stored one, an opaque call id is no name; the input comes from the call.

    friction: session_id, event_id, tool. pairs: session_id, event_id, call_event_id. calls: session_id, call_event_id, tool_name, tool_input.
    """
    joined = friction.join(pairs, ["session_id", "event_id"], "left").join(calls, ["session_id", "call_event_id"], "left")
    stored = F.when(~F.coalesce(F.col("tool").rlike(OPAQUE_ID), F.lit(False)), F.col("tool"))
    return joined.withColumn("tool", F.coalesce("tool_name", stored)).drop("tool_name")


def missing_commands(outputs: DataFrame, probes: DataFrame, *, most: int = 10) -> DataFrame:
    """Commands that were not found, by name: from the not-found line, or a failing ``which X``; unparsed ones last.

    outputs: session_id, ts, output. probes: session_id, ts, name.
    """
    name = F.coalesce(F.nullif(F.regexp_extract("output", r"command not found: ([A-Za-z0-9_.+-]+)", 1), F.lit("")), F.nullif(F.regexp_extract("output", r"(?m)(?:^|[:\s])([A-Za-z0-9_.+-]+): command not found", 1), F.lit("")), F.lit("__unparsed__"))
    every = outputs.filter(F.lower("output").contains("command not found")).select("session_id", "ts", name.alias("name")).unionByName(probes.select("session_id", "ts", "name"))
    per = every.groupBy("name", "session_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("t")).groupBy("name").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("count"), F.max("t").alias("last_at"))
    return per.orderBy(F.col("name") == "__unparsed__", F.col("sessions").desc(), F.col("count").desc(), "name").limit(most)


def working_commands(commands: DataFrame, *, least_runs: int = 3, least_sessions: int = 2, most: int = 30) -> DataFrame:
    """Commands of a project that were run often enough, by normalised label; commands that only look around are left out.

    commands: session_id, ts, program, command, failed.
    """
    kept = commands.filter(~F.col("program").isin(*NAVIGATION)).withColumn("label", normalized_line(F.col("command")))
    per = kept.groupBy("label", "session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("failed", F.lit(False))).alias("f"), F.max("ts").alias("t"))
    got = per.groupBy("label").agg(F.sum("n").alias("runs"), F.count(F.lit(1)).alias("sessions"), F.sum("f").alias("failures"), F.max("t").alias("last_at"))
    return got.filter((F.col("runs") >= least_runs) & (F.col("sessions") >= least_sessions)).orderBy(F.col("runs").desc(), "label").limit(most)


def git_outcomes(commands: DataFrame, sessions: DataFrame) -> DataFrame:
    """Commits, pushes and merges of each fleet, recorded and without a recorded failure."""
    verb = F.nullif(F.regexp_extract("command", r"^git (commit|push|merge)\b", 1), F.lit(""))
    rows = commands.withColumn("verb", verb).filter("verb is not null").join(sessions.select("session_id", F.coalesce("parent_session_id", "session_id").alias("fleet_id")), "session_id")
    return rows.groupBy("fleet_id").agg(*[x for v in ("commit", "push", "merge") for x in (F.count_if(F.col("verb") == v).alias(v), F.count_if((F.col("verb") == v) & (F.coalesce("exit_code", F.lit(0)) == 0)).alias(f"{v}_ok"))])


def printed_failures(results: DataFrame, friction: DataFrame) -> DataFrame:
    """Results without a recorded outcome whose text states one, and which have no friction yet."""
    rx = r"(?m)Process exited with code [1-9]|^\s*exit (?:code|status)\s*[:=]?\s*[1-9]|^Script failed"
    told = results.filter(F.col("is_error").isNull() & F.col("exit_code").isNull() & F.col("output").rlike(rx))
    return told.join(friction.select("session_id", "event_id"), ["session_id", "event_id"], "left_anti")


def turns(messages: DataFrame, *, injected: Column) -> DataFrame:
    """Closing replies by distinct message, and user turns that nobody but the user wrote."""
    closing = F.when((F.col("role") == "assistant") & (F.col("stop_reason") == "end_turn"), F.col("message_id"))
    return messages.groupBy("session_id").agg(F.countDistinct(closing).alias("assistant_turns"), F.count_if((F.col("role") == "user") & ~injected & ~F.col("sidechain")).alias("user_turns"))


def outdated(rows: DataFrame, version: str, *, column: str = "rule_version", key: list[str]) -> DataFrame:
    """Keys of derived rows whose rules are older than ``version``; their rows are to be made again."""
    return rows.filter(~F.col(column).eqNullSafe(F.lit(version))).select(*key).distinct()


def live_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("superseded_at").isNull())


def mapped_events(events: DataFrame, mapping: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with registry asset and version, session ids rejected for naming an unmapped asset).

    events: session_id, event_id, source_asset, content_hash. mapping:
    source_asset, asset_id. versions: asset_id, content_hash, version.
    """
    joined = events.join(mapping, "source_asset", "left")
    bad = joined.filter(F.col("source_asset").isNotNull() & F.col("asset_id").isNull()).select("session_id").distinct()
    latest = versions.groupBy("asset_id").agg(F.max("version").alias("_latest"))
    good = joined.join(bad, "session_id", "left_anti").join(versions, ["asset_id", "content_hash"], "left").join(latest, "asset_id", "left")
    return good.withColumn("version", F.coalesce("version", "_latest")).drop("_latest"), bad


def bounded_fields(rows: DataFrame, columns: list[str], *, most: int = 512) -> DataFrame:
    """Long text fields cut to ``most`` characters, with a flag if any was."""
    cut = F.lit(False)
    for c in columns:
        cut = cut | F.coalesce(F.length(c) > most, F.lit(False))
    return rows.withColumn("truncated", cut).withColumns({c: F.substring(c, 1, most) for c in columns})


def timeline(**tables: DataFrame) -> DataFrame:
    """Rows (id, at) of several tables as one sequence, newest first, with a stable order."""
    from tracewell.operators.sets import one_sequence

    return one_sequence(**tables).orderBy(F.col("at").desc(), F.col("id").desc(), "row_kind")


def audit(raw: DataFrame, derived: DataFrame, *, key: str, fields: list[str]) -> DataFrame:
    """(key, field, raw, derived) wherever a recount from raw rows differs from the derived table."""
    a = raw.select(key, *[F.col(f).cast("long").alias(f"a_{f}") for f in fields])
    b = derived.select(key, *[F.col(f).cast("long").alias(f"b_{f}") for f in fields])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("raw"), F.col(f"b_{f}").alias("derived")) for f in fields]))
    return a.join(b, key, "full").select(key, each.alias("x")).select(key, "x.*").filter(~F.col("raw").eqNullSafe(F.col("derived")))


def adherence(mentions: DataFrame, hits: DataFrame) -> DataFrame:
    """For each rule and the mechanism that its text mentions: records and sessions of the signatures the mechanism explains.

    mentions: asset_id, mechanism, scope, project. hits: signature, mechanism, project,
    session_id; a session lies in one project. A rule of user scope covers all
    projects. Hits are counted before rules meet them, so no rule meets a hit.
    """
    def counts(*key: str) -> DataFrame:
        per = hits.groupBy(*key, "session_id").agg(F.count(F.lit(1)).alias("n"))
        return per.groupBy(*key).agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("sessions"))

    everywhere = mentions.filter(F.col("scope") == "user").select("asset_id", "mechanism").distinct()
    local = mentions.filter(~F.col("scope").eqNullSafe("user")).select("asset_id", "mechanism", "project").distinct().join(everywhere, ["asset_id", "mechanism"], "left_anti")
    met = everywhere.join(counts("mechanism"), "mechanism").unionByName(local.join(counts("mechanism", "project"), ["mechanism", "project"]).drop("project"))
    return met.groupBy("asset_id", "mechanism").agg(F.sum("records").alias("records"), F.sum("sessions").alias("sessions"))


def first_of_keys(rows: DataFrame, *, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")

"""Friction records from events, and whole reports: named frames over one filtered set of sessions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import rules, shell, text
from tracewell.operators import calls, friction, stats
from tracewell.operators.sessions import bucketed, projects

RULE_VERSION = "friction/1"


def friction_records(results: DataFrame, interrupts: DataFrame) -> DataFrame:
    """One row for each failed result and interrupt, with category, rule and signature.

    results: session_id, event_id, ts, tool, command, output, is_error,
    exit_code. interrupts: session_id, event_id, ts, text, abort_reason.
    Programs and expected exits are read once for each distinct command.
    """
    err, code = text.outcome(F.coalesce("output", F.lit("")), F.col("is_error"), F.col("exit_code"))
    told = results.withColumns({"is_error": err, "exit_code": code})
    failed = told.filter(F.coalesce("is_error", F.lit(False)) | (F.coalesce("exit_code", F.lit(0)) != 0)).withColumns({"kind": F.lit("tool_error"), "text": F.lit(""), "abort_reason": F.lit(None).cast("string")})
    stops = interrupts.withColumn("kind", F.lit("user_interrupt"))
    rows = failed.unionByName(stops, allowMissingColumns=True)
    known = rows.select("command", "exit_code").distinct().withColumns({"program": shell.program_udf(F.coalesce("command", F.lit(""))), "expected": shell.expected_udf("command", "exit_code")})
    same = F.col("r.command").eqNullSafe(F.col("k.command")) & F.col("r.exit_code").eqNullSafe(F.col("k.exit_code"))
    rows = rows.alias("r").join(known.alias("k"), same, "left").select("r.*", "k.program", "k.expected")
    name, why = rules.category(text=F.col("text"), output=F.col("output"), command=F.col("command"), tool=F.col("tool"), exit_code=F.col("exit_code"), is_error=F.col("is_error"), abort_reason=F.col("abort_reason"), expected=F.col("expected"))
    literal = F.coalesce(*[rules.first_literal(F.col("output"), r.literals) for r in rules.OUTPUT_RULES], F.lit(""))
    line = F.when(F.col("kind") == "user_interrupt", F.coalesce("abort_reason", "text")).otherwise(text.evidence_line(F.coalesce("output", F.lit("")), literal))
    rows = rows.withColumns({"category": name, "category_rule": why})
    made = rows.withColumn("signature", text.signature(F.col("category"), F.col("tool"), line, program=F.coalesce("program", F.lit("")), exit_code=F.col("exit_code")))
    return made.withColumn("rule_version", F.lit(RULE_VERSION)).dropDuplicates(["session_id", "event_id", "kind"])


def overview(sessions: DataFrame, events: DataFrame, hits: DataFrame, commands: DataFrame, files: DataFrame, *, start: datetime, end: datetime) -> dict[str, DataFrame]:
    """The overview: totals, days, projects, tools, life cycle, programs, files and changes against the window before."""
    inside = lambda df, c: df.filter(F.col(c).between(F.lit(start), F.lit(end)))
    s, e, f = inside(sessions, "started_at"), inside(events, "ts"), inside(hits, "ts")
    return {
        "totals": stats.overview_totals(s, e, f), "days": stats.daily(sessions=(s, "started_at"), events=(e, "ts"), friction=(f, "ts")), "projects": projects(s, f), "tools": friction.by_dimension(f, F.col("tool"), name="tool"),
        "signatures": friction.leading(friction.lifecycle(hits, start=start, end=end)), "programs": stats.program_usage(inside(commands, "ts")), "files": stats.file_usage(inside(files, "ts")), "changes": stats.window_kpis(sessions, hits, start=start, end=end),
    }


def project(key: str, sessions: DataFrame, hits: DataFrame, commands: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """One project: counts, weeks, friction, programs and files."""
    mine = sessions.filter(bucketed(F.col("project_key")) == key)
    of = lambda df: df.join(mine.select("session_id"), "session_id", "left_semi")
    return {"sessions": mine, "weeks": stats.weekly(mine, of(hits)), "friction": friction.summary(of(hits)), "programs": stats.program_usage(of(commands)), "files": stats.file_usage(of(files))}


def insights(sessions: DataFrame, hits: DataFrame, commands: DataFrame, files: DataFrame, outputs: DataFrame, probes: DataFrame, *, repeats: int = 5, rereads: int = 3) -> DataFrame:
    """One row (kind, n) for each kind of insight that has any: interrupts, loops, re-read files, missing commands, failing programs."""
    counted = {
        "interrupts": friction.interrupts(hits, commands.withColumn("tool", F.col("program"))), "stuck_loops": friction.stuck_loops(hits, least=repeats), "reread_files": stats.reread_files(files, least=rereads),
        "missing_commands": calls.missing_commands(outputs, probes), "failing_programs": stats.failing_programs(commands).filter("failures > 0"),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in counted.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("n > 0")


def briefing(key: str, sessions: DataFrame, hits: DataFrame, commands: DataFrame, files: DataFrame, *, most: int = 5) -> dict[str, DataFrame]:
    """What is known of a project: sessions, commands that worked in two of them or more, recurring signatures with the sessions that went on after the last hit, most-read files, and the other projects."""
    mine = sessions.filter(bucketed(F.col("project_key")) == key)
    of = lambda df: df.join(mine.select("session_id"), "session_id", "left_semi")
    worked = of(commands).filter("exit_code = 0").select("command", "session_id").distinct().groupBy("command").agg(F.count(F.lit(1)).alias("sessions"))
    per = of(hits).groupBy("signature", "session_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("hit_at")).join(mine.select("session_id", "ended_at"), "session_id")
    recurring = per.groupBy("signature").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("ended_at") > F.col("hit_at")).alias("corroborated")).filter("sessions >= 2")
    read = of(files).filter("action = 'read'").groupBy("path").agg(F.count(F.lit(1)).alias("reads"))
    others = sessions.groupBy(bucketed(F.col("project_key")).alias("project")).agg(F.count(F.lit(1)).alias("sessions")).filter(F.col("project") != key)
    return {
        "sessions": mine, "commands": worked.filter("sessions >= 2").orderBy(F.col("sessions").desc(), "command").limit(most),
        "signatures": recurring.orderBy(F.col("sessions").desc(), F.col("records").desc(), "signature").limit(most), "files": read.orderBy(F.col("reads").desc(), "path").limit(most), "others": others,
    }


def as_rows(panels: dict[str, DataFrame], wanted: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """A report as rows (panel, key, measure, value). wanted: panel -> (key columns, whole-number measures)."""
    out: DataFrame | None = None
    for name, (keys, measures) in wanted.items():
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("value")) for m in measures]))
        rows = panels[name].select(F.lit(name).alias("panel"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"), each.alias("m")).select("panel", "key", "m.*")
        out = rows if out is None else out.unionByName(rows)
    return out

"""Transcript readers: text files of JSON records, and a relational export, to canonical sessions and events.

Each source is one parse with a given schema; nothing is inferred from the data.
Every event keeps its line and block, which is its place in the transcript and
the final tie-break. Canonical events: session_id, source, source_event_id,
event_type, role, text, truncated, tool_name, call_id, tool_input, tool_output,
is_error, exit_code, abort_reason, occurred_at, line_no, block_no.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.text import bounded, is_noise, is_transcript_role, outcome
from tracewell.operators.ordered import scan

#: Characters kept of a text, a tool payload, a title and a task.
TEXT, PAYLOAD, TITLE, TASK = 4096, 8192, 160, 240
#: Length of the slices in which a session's rows are numbered.
SLICE_MS = 21_600_000

EVENT = {
    "session_id": "string", "source": "string", "source_event_id": "string", "event_type": "string", "role": "string", "text": "string", "truncated": "boolean", "tool_name": "string", "call_id": "string",
    "tool_input": "string", "tool_output": "string", "is_error": "boolean", "exit_code": "int", "abort_reason": "string", "occurred_at": "timestamp", "line_no": "int", "block_no": "int",
}
EVENT_TYPES = ("session_started", "transcript_message", "transcript_tool_call", "transcript_tool_result", "asset_invoked", "asset_loaded", "asset_offered", "asset_observed_use", "asset_violation", "environment_changed")

#: (lines) -> (sessions, events); the lines come from ``lines`` or any frame of its shape.
Parser = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
PARSERS: dict[str, Parser] = {}


def register(name: str, parser: Parser) -> None:
    """A further source. A parser maps DataFrames to DataFrames."""
    PARSERS[name] = parser


def parse(name: str, lines_: DataFrame) -> tuple[DataFrame, DataFrame]:
    return PARSERS[name](lines_)


def lines(spark: SparkSession, roots: Sequence[str], *, subagents: bool = True) -> DataFrame:
    """path, line_no (from 1) and raw of every line of the ``*.jsonl`` files below the roots, up to the first bad record of a file."""
    files = placed(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(list(roots), lineSep="\n"))
    if not subagents:
        files = files.filter(~F.col("path").contains("/subagents/"))
    return numbered_lines(in_order(files))


def placed(files: DataFrame) -> DataFrame:
    """path, block (where in the file a task began to read) and value of every line of a text source, batch or stream."""
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def in_order(lines_: DataFrame) -> DataFrame:
    """path, block, nth and value: within a block, lines come in the order in which a task reads them."""
    return lines_.select("path", "block", F.monotonically_increasing_id().alias("nth"), "value")


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, block, nth, value) to (path, line_no, raw); blank lines are counted but left out, a bad record ends its file.

    Files are read by lines, so no row holds more than one line, and a large file is
    read by several tasks. Its lines are numbered in two levels: within a block,
    which is what one task reads, and from block to block by the counts of those
    before. Whether a bad record came before goes along in the same way.
    """
    rows = files.withColumn("_bad", (F.trim("value") != "") & F.from_json("value", "map<string,string>").isNull())
    counted = scan(rows, by=["path"], order=["block", "nth"], total={"line_no": F.lit(1), "_bads": F.col("_bad").cast("int")}, slice_by=F.col("block"))
    return counted.filter((F.col("_bads") == 0) & (F.trim("value") != "")).select("path", F.col("line_no").cast("int").alias("line_no"), F.col("value").alias("raw"))


def of_file(rows: DataFrame, **first: Column) -> DataFrame:
    """``rows`` (of path and line_no) with the first value of each column in their file that is not null, folded by file and joined back."""
    filled = {k: F.min_by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), F.col("line_no"))).alias(k) for k, c in first.items()}
    return rows.join(rows.groupBy("path").agg(*filled.values()), "path")


def listing(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """path, size and mtime of every transcript below the roots, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(list(roots))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def unseen(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of files that are new or changed since the manifest (path, size, mtime) was written, each row judged by itself; what has no size or time is read."""
    known = manifest.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    same = F.col("path").eqNullSafe(F.col("_path")) & (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    return listed.join(known, same, "left_anti")


def once(listed: DataFrame) -> DataFrame:
    """A transcript under two paths is read once: the smallest path for each file name."""
    w = W.partitionBy(F.element_at(F.split("path", "/"), -1)).orderBy("path")
    return listed.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def rescued(manifest: DataFrame, listed: DataFrame) -> DataFrame:
    """One row: registered files that are listed no more, and their sessions."""
    return manifest.join(listed.select("path"), "path", "left_anti").agg(F.countDistinct("path").alias("files"), F.countDistinct("session_id").alias("sessions"))


def roots_in_force(configured: DataFrame, registered: DataFrame) -> DataFrame:
    """(kind, root): configured and registered roots, less those that are disabled."""
    every = configured.select("kind", "root").unionByName(registered.filter("enabled").select("kind", "root")).distinct()
    return every.join(registered.filter("not enabled").select("kind", "root"), ["kind", "root"], "left_anti")


def within_project(lines_: DataFrame, root: str) -> DataFrame:
    """Lines of transcripts whose first working directory lies in a project."""
    cwd = F.coalesce(F.get_json_object("raw", "$.cwd"), F.get_json_object("raw", "$.payload.cwd"))
    first = lines_.withColumn("_c", cwd).filter("_c is not null").groupBy("path").agg(F.min_by("_c", "line_no").alias("_c"))
    inside = (F.col("_c") == root) | F.col("_c").startswith(root.rstrip("/") + "/")
    return lines_.join(first.filter(inside).select("path"), "path", "left_semi")


def _events(rows: DataFrame, source: str, **columns: Column | str) -> DataFrame:
    """The canonical columns, null where a source has none. ``rows`` has session_id, line_no and block_no."""
    given = {"source": F.lit(source), **{k: (F.col(v) if isinstance(v, str) else v) for k, v in columns.items()}}
    held = lambda c: given.get(c, F.col(c) if c in rows.columns else F.lit(None))
    return rows.select(*[held(c).cast(t).alias(c) for c, t in EVENT.items()])


def _messages(rows: DataFrame, source: str, text: Column, **more: Column | str) -> DataFrame:
    kept = rows.withColumn("_text", text).filter(~is_noise(F.col("_text")) & is_transcript_role(F.col("role")))
    t, cut = bounded(F.col("_text"), TEXT)
    return _events(kept, source, event_type=F.lit("transcript_message"), text=t, truncated=cut, **more)


def _calls(rows: DataFrame, source: str, *, name: Column, call: Column, given: Column, **more: Column | str) -> DataFrame:
    t, cut = bounded(given, PAYLOAD)
    return _events(rows, source, event_type=F.lit("transcript_tool_call"), role=F.lit("assistant"), tool_name=name, call_id=call, tool_input=t, truncated=cut, **more)


def _results(rows: DataFrame, source: str, *, call: Column, output: Column, is_error: Column, exit_code: Column, **more: Column | str) -> DataFrame:
    err, code = outcome(F.coalesce(output, F.lit("")), is_error, exit_code)
    t, cut = bounded(F.coalesce(output, F.lit("")), PAYLOAD)
    return _events(rows, source, event_type=F.lit("transcript_tool_result"), role=F.lit("tool"), call_id=call, tool_output=t, truncated=cut, is_error=err, exit_code=code, **more)


def _first(c: str) -> Column:
    at = F.struct("line_no")
    return F.min_by(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(c)), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", at)).alias(c)


NESTED = """type string, sessionId string, uuid string, timestamp timestamp, cwd string, version string, aiTitle string, isSidechain boolean, agentId string,
    message struct<id: string, role: string, model: string, stop_reason: string, content: string>"""
BLOCK = "type string, id string, text string, name string, input string, content string, tool_use_id string, is_error boolean"


def nested_messages(lines_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that hold a message whose content is a text or a list of blocks. A subagent's file is a session of its own with a parent."""
    agent = F.nullif(F.regexp_extract("path", r"subagents/agent-([^/]+)\.jsonl$", 1), F.lit(""))
    r = lines_.select("path", "line_no", F.from_json("raw", NESTED).alias("r")).select("path", "line_no", "r.*").withColumn("agent", agent)
    own = F.coalesce(F.concat(F.lit("agent-"), F.col("agent")), F.col("sessionId"))
    r = of_file(r, _first=own).withColumn("session_id", F.coalesce(own, "_first"))
    sessions = r.groupBy("session_id").agg(
        _first("cwd"), _first("version"), F.max_by("aiTitle", F.when(F.col("aiTitle").isNotNull(), F.col("line_no"))).alias("title"), F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"),
        F.first("message.model", ignorenulls=True).alias("model"), F.max(F.when(F.col("agent").isNotNull(), F.col("sessionId"))).alias("parent_session_id"),
    ).withColumn("thread_kind", F.when(F.col("parent_session_id").isNotNull(), "subagent").otherwise("main"))
    content = F.col("message.content")
    blocks = F.coalesce(F.when(F.ltrim(content).startswith("["), F.from_json(content, f"array<struct<{BLOCK.replace(' string', ':string').replace(' boolean', ':boolean')}>>")), F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("id"), content.alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("name", "input", "content", "tool_use_id")], F.lit(None).cast("boolean").alias("is_error"))))
    b = r.filter(content.isNotNull()).select("session_id", "line_no", "uuid", "timestamp", F.col("message.role").alias("role"), F.posexplode(blocks).alias("block_no", "b"))
    same = {"source_event_id": F.concat_ws("-", "uuid", "block_no"), "occurred_at": "timestamp"}
    is_ = lambda t: b.filter(F.col("b.type") == t)
    text_of = F.coalesce(F.array_join(F.transform(F.from_json("b.content", "array<struct<type:string,text:string>>"), lambda x: x["text"]), "\n"), F.col("b.content"))
    output = F.when(F.ltrim("b.content").startswith("["), text_of).otherwise(F.col("b.content"))
    events = _messages(is_("text"), "nested", F.col("b.text"), **same)
    events = events.unionByName(_calls(is_("tool_use"), "nested", name=F.col("b.name"), call=F.col("b.id"), given=F.col("b.input"), **same))
    return sessions, events.unionByName(_results(is_("tool_result"), "nested", call=F.col("b.tool_use_id"), output=output, is_error=F.col("b.is_error"), exit_code=F.lit(None).cast("int"), **same))


TYPED = """timestamp timestamp, type string, payload struct<type: string, id: string, parent_thread_id: string, thread_source: string, originator: string, cwd: string, cli_version: string, model: string, name: string,
    call_id: string, input: string, arguments: string, output: string, role: string, content: string, is_error: boolean, exit_code: int, turn_id: string, reason: string,
    info: struct<total_token_usage: struct<input_tokens: bigint, cached_input_tokens: bigint, cache_write_input_tokens: bigint, output_tokens: bigint, reasoning_output_tokens: bigint, total_tokens: bigint>>>"""


def typed_records(lines_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records by type and payload type. A result is a row even when it is empty; an aborted turn is a system message with its reason."""
    r = lines_.select("path", "line_no", F.from_json("raw", TYPED).alias("r")).select("path", "line_no", F.col("r.timestamp").alias("timestamp"), F.col("r.type").alias("type"), F.col("r.payload").alias("p"))
    meta = F.when(F.col("type") == "session_meta", F.col("p.id"))
    r = of_file(r, session_id=meta)
    named = r.select("session_id", "line_no", "timestamp", "type", F.col("p.cwd").alias("cwd"), F.col("p.cli_version").alias("version"), F.when(F.col("type") == "turn_context", F.col("p.model")).alias("model"), F.col("p.parent_thread_id").alias("parent_session_id"), F.when(F.col("p.type") == "token_count", F.col("p.info.total_token_usage.total_tokens")).alias("total"))
    sessions = named.groupBy("session_id").agg(_first("cwd"), _first("version"), _first("model"), F.first("parent_session_id", ignorenulls=True).alias("parent_session_id"), F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), F.max_by("total", F.when(F.col("total").isNotNull(), F.col("line_no"))).alias("running_total"))
    sessions = sessions.withColumn("thread_kind", F.when(F.col("parent_session_id").isNotNull(), "subagent").otherwise("main"))
    ref = F.coalesce("p.id", "p.call_id", F.concat(F.lit("line-"), F.col("line_no").cast("string")))
    item = r.filter(F.col("type").isin("response_item", "response_item_event")).withColumns({"block_no": F.lit(0), "ref": ref, "role": F.col("p.role")})
    same = {"source_event_id": "ref", "occurred_at": "timestamp"}
    kind = F.col("p.type")
    parts = F.from_json("p.content", "array<struct<type:string,text:string>>")
    said = F.when(F.ltrim("p.content").startswith("["), F.array_join(F.transform(parts, lambda x: x["text"]), "\n")).otherwise(F.col("p.content"))
    unwrapped = F.coalesce(F.get_json_object("p.output", "$.output"), F.get_json_object("p.output", "$.content"), F.col("p.output"))
    exit_code = F.coalesce(F.col("p.exit_code"), F.get_json_object("p.output", "$.metadata.exit_code").try_cast("int"))
    events = _messages(item.filter(kind == "message"), "typed", said, **same)
    calls = item.filter(kind.isin("function_call", "custom_tool_call", "local_shell_call"))
    events = events.unionByName(_calls(calls, "typed", name=F.col("p.name"), call=F.col("p.call_id"), given=F.coalesce("p.arguments", "p.input"), **same))
    results = item.filter(kind.isin("function_call_output", "custom_tool_call_output"))
    events = events.unionByName(_results(results, "typed", call=F.col("p.call_id"), output=unwrapped, is_error=F.col("p.is_error"), exit_code=exit_code, **same))
    aborted = r.filter((F.col("type") == "event_msg") & (kind == "turn_aborted") & (F.trim("p.reason") != "")).withColumn("block_no", F.lit(0))
    abort_ref = F.coalesce("p.turn_id", F.concat(F.lit("line-"), F.col("line_no").cast("string")))
    return sessions, events.unionByName(_events(aborted, "typed", source_event_id=abort_ref, event_type=F.lit("transcript_message"), role=F.lit("system"), abort_reason=F.trim("p.reason"), occurred_at="timestamp"))


LOG = "type string, time bigint, time0 bigint, seq bigint, id string, cwd string, createdAt bigint, agentPreset string, delegationDepth int, data string"


def event_log(lines_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of an event log with times in milliseconds. Usage is summed over replies, a total of zero stays null; only turns that did not complete are kept."""
    r = lines_.select("path", "line_no", F.from_json("raw", LOG).alias("r")).select("path", "line_no", "r.*")
    r = r.withColumns({"at": F.timestamp_millis(F.coalesce("time", "time0")), "block_no": F.lit(0), "ref": F.when(F.col("seq").isNotNull(), F.concat(F.lit("seq-"), F.col("seq").cast("string"))).otherwise(F.concat(F.lit("line-"), F.col("line_no").cast("string")))})
    head = F.when(F.col("type") == "session", F.col("id"))
    folder = F.element_at(F.split("path", "/"), -2)
    r = of_file(r, _first=head).withColumn("session_id", F.coalesce("_first", folder))
    js = lambda p: F.get_json_object("data", p)
    on = lambda t, c: F.when(F.col("type") == t, c)
    n = lambda p: on("assistant/message", js(p).try_cast("bigint"))
    flat = r.withColumns({"title": on("session/title", js("$.title")), "model": on("request/context", js("$.model")), "window": on("request/context", js("$.contextWindow").try_cast("bigint")), "head_cwd": on("session", F.col("cwd")), "depth": on("session", F.col("delegationDepth"))})
    total = lambda p, c: F.nullif(F.sum(n(p)), F.lit(0)).alias(c)
    sessions = flat.groupBy("session_id").agg(
        _first("title"), _first("model"), F.first(F.when(F.col("window") > 0, F.col("window")), ignorenulls=True).alias("context_window"), _first("head_cwd"), F.min("at").alias("started_at"), F.max("at").alias("ended_at"),
        F.when(F.max("depth") > 0, "subagent").when(F.max("depth") == 0, "main").alias("thread_kind"),
        total("$.usage.inputTokens", "input_tokens"), total("$.usage.outputTokens", "output_tokens"), total("$.usage.cacheReadTokens", "cached_input_tokens"),
        F.count_if(F.col("type") == "assistant/message").alias("assistant_turns"), F.count_if(F.col("type") == "user/message").alias("user_turns"),
    ).withColumnRenamed("head_cwd", "cwd")
    block = "array<struct<type:string,text:string>>"
    said = lambda t, at, ref, role: r.filter(F.col("type") == t).select("session_id", "line_no", "at", F.coalesce(js(ref), F.col("ref")).alias("ref"), F.lit(role).alias("role"), F.posexplode(F.from_json(js(at), block)).alias("block_no", "b")).filter("b.type = 'text'")
    same = {"source_event_id": "ref", "occurred_at": "at"}
    events = _messages(said("user/message", "$.content", "$.id", "user"), "log", F.col("b.text"), **same)
    events = events.unionByName(_messages(said("assistant/message", "$.message.content", "$.message.id", "assistant"), "log", F.col("b.text"), **same))
    call = r.filter("type = 'tool/call'").withColumn("ref", F.coalesce(js("$.callId"), "ref"))
    events = events.unionByName(_calls(call, "log", name=js("$.name"), call=js("$.callId"), given=js("$.arguments"), **same))
    blocks = F.from_json(js("$.message.content"), "array<struct<toolCallId:string,isError:boolean,content:array<struct<type:string,text:string>>>>")
    told = F.flatten(F.transform(blocks, lambda b: F.transform(F.filter(b["content"], lambda x: x["type"] == "text"), lambda x: x["text"])))
    error = F.nullif(js("$.error"), F.lit("null"))
    output = F.concat_ws("\n", told, error)
    failed = F.when(error.isNotNull(), True).otherwise(F.get(F.filter(F.transform(blocks, lambda b: b["isError"]), lambda x: x.isNotNull()), F.lit(0)))
    call_id = F.coalesce(js("$.message.source.callId"), F.get(blocks, F.lit(0))["toolCallId"])
    result = r.filter("type = 'tool/result'").withColumn("ref", F.coalesce(call_id, js("$.message.id"), "ref"))
    events = events.unionByName(_results(result, "log", call=call_id, output=output, is_error=failed, exit_code=F.lit(None).cast("int"), **same))
    ended = r.filter("type = 'turn/end'").withColumn("why", js("$.reason.kind")).filter("coalesce(why, '') not in ('', 'completed')")
    return sessions, events.unionByName(_events(ended, "log", source_event_id="ref", event_type=F.lit("transcript_message"), role=F.lit("system"), abort_reason="why", occurred_at="at"))


def relational(session: DataFrame, message: DataFrame, part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """session, message (id, session_id, time_created, data) and part (id, message_id, time_created, data) of an export."""
    title = F.when(~F.coalesce(F.col("title"), F.lit("")).rlike(r"^New session - "), F.col("title"))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c.replace("tokens_", "") + "_tokens")
    sessions = session.select(
        F.col("id").alias("session_id"), F.col("parent_id").alias("parent_session_id"), F.when(F.col("parent_id").isNotNull(), "subagent").otherwise("main").alias("thread_kind"), F.col("directory").alias("cwd"), title.alias("title"), "version", "model",
        *[positive(c) for c in ("tokens_input", "tokens_output", "tokens_reasoning", "tokens_cache_read", "tokens_cache_write")], "cost",
        F.col("summary_additions").alias("lines_added"), F.col("summary_deletions").alias("lines_removed"), F.col("summary_files").alias("files_changed"), F.timestamp_millis("time_created").alias("started_at"), F.timestamp_millis("time_updated").alias("ended_at"),
    )
    rows = message.select(F.col("id").alias("m_id"), "session_id", F.col("time_created").alias("m_at"), F.get_json_object("data", "$.role").alias("role"), F.get_json_object("data", "$.time.created").try_cast("bigint").alias("m_created")).join(part.select(F.col("id").alias("p_id"), F.col("message_id").alias("m_id"), F.col("time_created").alias("p_at"), F.col("data").alias("p")), "m_id")
    js = lambda p: F.get_json_object("p", p)
    ms = lambda *c: F.timestamp_millis(F.coalesce(*c))
    start = F.coalesce(js("$.time.start").try_cast("bigint"), js("$.state.time.start").try_cast("bigint"), F.col("m_created"), F.col("m_at"))
    rows = scan(rows, by=["session_id"], order=["m_at", "m_id", "p_at", "p_id"], total={"line_no": F.lit(1)}, slice_by=F.floor(F.col("m_at") / SLICE_MS))
    rows = rows.withColumns({"block_no": F.lit(0), "start": start, "status": js("$.state.status")})
    same = {"source_event_id": F.coalesce("p_id", "m_id"), "occurred_at": ms("start")}
    events = _messages(rows.filter(js("$.type") == "text"), "relational", js("$.text"), **same)
    tools = rows.filter(js("$.type") == "tool")
    events = events.unionByName(_calls(tools, "relational", name=js("$.tool"), call=js("$.callID"), given=js("$.state.input"), **same))
    over = tools.filter(F.col("status").isin("completed", "error"))
    output = F.when(F.col("status") == "error", F.coalesce(F.nullif(js("$.state.error"), F.lit("")), js("$.state.output"))).otherwise(js("$.state.output"))
    end = ms(js("$.state.time.end").try_cast("bigint"), js("$.time.end").try_cast("bigint"), F.col("start"))
    interrupted = F.when(js("$.state.metadata.interrupted") == "true", "interrupted")
    done = _results(over, "relational", call=js("$.callID"), output=output, is_error=F.col("status") == "error", exit_code=js("$.state.metadata.exit").try_cast("int"), source_event_id=F.coalesce("p_id", "m_id"), occurred_at=end, abort_reason=interrupted)
    return sessions, events.unionByName(done)


def envelopes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalised envelopes (raw: one JSON document each) with session, and messages or turns; omissions stay null."""
    item = "array<struct<id:string,timestamp:timestamp,role:string,kind:string,text:string,tool_name:string,call_id:string,tool_use_id:string,tool_input:string,tool_output:string,truncated:boolean,is_error:boolean,exit_code:int,abort_reason:string>>"
    head = "struct<id:string,title:string,task_text:string,started_at:timestamp,ended_at:timestamp,harness_version:string,model:string,cwd:string,thread_kind:string,parent_session_id:string,agent_role:string>"
    r = docs.select(F.from_json("raw", f"session {head}, messages {item}, turns {item}").alias("r")).select("r.*")
    sessions = r.select(F.col("session.id").alias("session_id"), *[F.col(f"session.{c}").alias(c) for c in ("title", "task_text", "started_at", "ended_at", "harness_version", "model", "cwd", "thread_kind", "parent_session_id", "agent_role")])
    b = r.select(F.col("session.id").alias("session_id"), F.posexplode(F.coalesce("messages", "turns")).alias("block_no", "m")).select("session_id", "block_no", "m.*").withColumn("line_no", F.lit(1))
    kind = F.coalesce("kind", F.when(F.col("tool_output").isNotNull(), "tool_result").when(F.col("tool_name").isNotNull(), "tool_call").otherwise("message"))
    call = F.coalesce("call_id", "tool_use_id")
    err, code = outcome(F.coalesce("tool_output", F.lit("")), F.col("is_error"), F.col("exit_code"))
    is_result = kind == "tool_result"
    events = _events(b, "envelope", source_event_id=F.concat_ws(":", F.coalesce("id", F.col("block_no").cast("string")), kind), event_type=F.when(kind == "message", "transcript_message").otherwise(F.concat(F.lit("transcript_"), kind)), call_id=call, occurred_at="timestamp", is_error=F.when(is_result, err).otherwise(F.col("is_error")), exit_code=F.when(is_result, code).otherwise(F.col("exit_code")))
    return sessions, events


register("nested", nested_messages)
register("typed", typed_records)
register("log", event_log)


def headers(lines_: DataFrame) -> DataFrame:
    """session_id and thread fields from the first header record of each transcript, the rest unparsed."""
    only = lines_.filter(F.col("raw").contains("session_meta")).select("path", "line_no", F.from_json("raw", TYPED).alias("r")).filter("r.type = 'session_meta'")
    first = only.groupBy("path").agg(F.min_by("r.payload", "line_no").alias("p"))
    return first.select("path", F.col("p.id").alias("session_id"), "p.parent_thread_id", "p.thread_source", "p.originator")


def valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events of sessions without a bad one, events of the others): a bad event rejects its whole session."""
    bad = F.col("session_id").isNull() | (F.coalesce("source_event_id", F.lit("")) == "") | ~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False))
    judged = events.filter(bad).select(F.col("session_id").alias("_of")).distinct()
    same = F.col("session_id").eqNullSafe(F.col("_of"))
    return events.join(judged, same, "left_anti"), events.join(judged, same, "left_semi")


def assets(files: DataFrame) -> DataFrame:
    """Asset files (path, content) by kind with the hash of their bytes; files of no kind are left out."""
    p = F.col("path")
    kind = F.when(p.endswith("/SKILL.md"), "skill").when(p.endswith("/AGENTS.md"), "agents_md").when(p.rlike(r"/rules/[^/]+\.(md|mdc)$"), "rule").when(p.rlike(r"/hooks/[^/]+$"), "hook")
    return files.withColumns({"kind": kind, "content_hash": F.sha2("content", 256)}).filter("kind is not null")

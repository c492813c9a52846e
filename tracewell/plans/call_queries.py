"""Queries over tool calls, rule coverage, whole reports and the checks between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import calls as C
from tracewell.operators import friction as X
from tracewell.operators import mentions as M
from tracewell.operators import sessions as S
from tracewell.operators import stats
from tracewell.plans import inputs
from tracewell.plans.catalog import END, START, on_activity, on_tables


@on_tables("H10_commands_of_calls", "SELECT conv_id, turn, text AS command FROM conversations WHERE text IS NOT NULL AND turn % 3 <> 2")
def _(read):
    """Texts as commands: in a JSON field, and as a quoted literal of a script."""
    quoted = F.replace(F.replace(F.col("text"), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    given = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.col("text").alias("cmd")))).when(F.col("turn") % 3 == 1, F.concat(F.lit('const r = tools.exec({\n cmd: "'), quoted, F.lit('", x: 1})'))).otherwise("plain")
    return read("conversations").filter("text is not null").select("conv_id", "turn", F.explode(C.commands_of(given)).alias("command"))


#: Tools, fields of a call, heads of a patch and beginnings of a path, known ones and others.
FILE_TOOLS = ["Read", "EDIT", "MultiEdit", "NotebookEdit", "Write", "Bash", "apply_patch", "Reader"]
FIELDS = ["file_path", "notebook_path", "path", "file", "Path"]
PATCHES = ["*** Update File: ", "*** Add File: ", "*** Delete File: ", "** Update File: ", "*** Move File: ", " *** Add File: ", "*** Update File:  "]
ROOTS = ["/abs/", "rel/", "", "./"]


@on_tables("H11_files_of_calls", f"""
WITH c AS (SELECT doc_id, lower({inputs.chosen_sql("doc_id", FILE_TOOLS)}) AS tool, {inputs.chosen_sql("doc_id", FIELDS, 2)} AS field, {inputs.chosen_sql("doc_id", ROOTS, 3)} || coalesce(source, '') || doc_id AS path, doc_id // 8 % 2 = 0 AS one,
    {inputs.chosen_sql("doc_id", PATCHES)} AS head, {inputs.chosen_sql("doc_id", PATCHES, 7)} AS later, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(head || path || chr(10) || text || chr(10) || later || path || '.b', chr(10))) AS line FROM c WHERE NOT one),
f AS (SELECT doc_id, trim(split_part(line, 'File:', 2)) AS path, CASE line[5] WHEN 'U' THEN 'edit' WHEN 'A' THEN 'write' ELSE 'delete' END AS action FROM l WHERE regexp_matches(line, '^[*][*][*] (Update|Add|Delete) File: .')
    UNION ALL SELECT doc_id, path, CASE tool WHEN 'read' THEN 'read' WHEN 'write' THEN 'write' ELSE 'edit' END FROM c WHERE one AND field IN ('file_path', 'notebook_path', 'path') AND tool IN ('read', 'edit', 'multiedit', 'notebookedit', 'write'))
SELECT doc_id, CASE WHEN starts_with(path, '/') THEN path ELSE '/w/' || path END AS path, action FROM f""")
def _(read):
    """Calls with a document's whole text as content or between the heads of a patch."""
    pick, t = inputs.chosen, F.coalesce("text", F.lit(""))
    path = F.concat(pick("doc_id", ROOTS, 3), F.coalesce("source", F.lit("")), F.col("doc_id").cast("string"))
    fields = F.to_json(F.create_map(F.lit("content"), t, pick("doc_id", FIELDS, 2), path))
    patch = F.concat(pick("doc_id", PATCHES), path, F.lit("\n"), t, F.lit("\n"), pick("doc_id", PATCHES, 7), path, F.lit(".b"))
    given = F.when(F.floor(F.col("doc_id") / 8) % 2 == 0, fields).otherwise(patch)
    return read("documents").select("doc_id", F.explode(C.files_of(pick("doc_id", FILE_TOOLS), given, F.lit("/w/"))).alias("f")).select("doc_id", "f.path", "f.action")


@on_tables("H12_line_changes", """
WITH n AS (SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN n ELSE 3 END::INT AS added, CASE WHEN turn % 2 = 0 THEN 0 ELSE n END::INT AS removed FROM n""")
def _(read):
    even = F.col("turn") % 2 == 0
    given = F.when(even, F.to_json(F.struct(F.col("text").alias("content")))).otherwise(F.to_json(F.struct(F.col("text").alias("old_string"), F.lit("a\nb\nc").alias("new_string"))))
    added, removed = C.line_changes(F.when(even, "Write").otherwise("Edit"), given)
    return read("conversations").select("conv_id", "turn", added.alias("added"), removed.alias("removed"))


@on_tables("H18_user_shell", "SELECT conv_id, turn, nullif(trim(text), '') AS command FROM conversations WHERE turn % 2 = 0 AND trim(text) <> ''")
def _(read):
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("  <bash-input> "), F.col("text"), F.lit(" </bash-input>"))).otherwise(F.col("text"))
    return read("conversations").select("conv_id", "turn", text.user_shell_command(t).alias("command")).filter("command is not null")


@on_tables("H20_bounded_fields", "SELECT conv_id, turn, substr(text, 1, 512) AS text, length(text) > 512 AS truncated FROM conversations")
def _(read):
    return C.bounded_fields(read("conversations"), ["text"]).select("conv_id", "turn", "text", "truncated")


@on_tables("P14_display_titles", """
WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN nullif(trim(text), '') END AS ai, CASE WHEN turn % 3 = 1 THEN nullif(trim(text), '') END AS task, nullif(substr(split_part(replace(text, '"', ''), chr(10), 1), 1, 120), '') AS made FROM conversations)
SELECT conv_id, turn, coalesce(ai, task, made) AS title, CASE WHEN ai IS NOT NULL THEN 'ai' WHEN task IS NOT NULL THEN 'task' WHEN made IS NOT NULL THEN 'synthesized' ELSE 'none' END AS title_source FROM t""")
def _(read):
    m = F.col("turn") % 3
    line = F.split_part(F.replace(F.col("text"), F.lit('"'), F.lit("")), F.lit("\n"), F.lit(1))
    title, origin = text.display_title(F.when(m == 0, F.col("text")), F.when(m == 1, F.col("text")).otherwise(" "), F.concat(F.lit('<teammate-message summary="'), line, F.lit('">x')))
    return read("conversations").select("conv_id", "turn", title.alias("title"), origin.alias("title_source"))


@on_activity("P10_live_rows", "SELECT event_id FROM v_friction WHERE event_id % 4 <> 0")
def _(a):
    return C.live_rows(a.friction.withColumn("superseded_at", F.when(F.col("event_id") % 4 == 0, F.col("ts")))).select("event_id")


@on_activity("P16_event_validation", "SELECT session_id, count(*) AS n FROM v_events GROUP BY session_id HAVING NOT bool_or(k = 99)")
def _(a):
    from tracewell.sources.transcripts import valid

    rows = a.events.select("session_id", F.col("event_id").cast("string").alias("source_event_id"), F.when(F.col("k") == 99, "odd").otherwise("transcript_message").alias("event_type"))
    return valid(rows)[0].groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@on_activity("P17_roots_in_force", "SELECT DISTINCT source AS kind, 'r' || (k % 10) AS root FROM v_events WHERE (k % 10 < 4 OR k % 10 = 5) AND k % 10 <> 2")
def _(a):
    from tracewell.sources.transcripts import roots_in_force

    root = F.concat(F.lit("r"), (F.col("k") % 10).cast("string"))
    rows = a.events.select(F.col("source").alias("kind"), root.alias("root"), (F.col("k") % 10).alias("m")).distinct()
    return roots_in_force(rows.filter("m < 4"), rows.filter("m in (2, 5)").withColumn("enabled", F.col("m") == 5))


@on_activity("J23_launch_identity", "SELECT event_id AS agent, 'role' || (k % 3) AS role FROM v_commands JOIN v_events USING (session_id, event_id) WHERE k % 2 = 0 UNION ALL SELECT event_id, NULL FROM v_commands JOIN v_events USING (session_id, event_id) WHERE k % 2 = 1")
def _(a):
    rows = a.commands.join(a.events.select("event_id", "k"), "event_id").withColumns({"agent_id": F.concat(F.lit("ag"), F.col("event_id").cast("string")), "call_id": F.col("event_id").cast("string")})
    results = rows.select("session_id", "call_id", F.when(F.col("k") % 2 == 0, F.concat(F.lit("done\nagentId: "), F.col("agent_id"), F.lit(" ok"))).otherwise("nothing").alias("output"))
    calls = rows.select("session_id", "call_id", F.concat(F.lit('{"subagent_type": "role'), (F.col("k") % 3).cast("string"), F.lit('"}')).alias("tool_input"))
    return C.launched(rows.select("agent_id", F.col("event_id").alias("agent")), results, calls).select("agent", "role")


@on_activity("J28_tool_identity", "SELECT f.event_id, CASE WHEN f.event_id % 2 = 0 THEN 'call' || f.event_id WHEN f.event_id % 3 = 0 THEN NULL ELSE f.tool END AS tool FROM v_friction f")
def _(a):
    stored = a.friction.select("session_id", "event_id", F.when(F.col("event_id") % 3 == 0, "call_abc").otherwise(F.col("tool")).alias("tool"))
    pairs = a.friction.filter("event_id % 2 = 0").select("session_id", "event_id", (F.col("event_id") + 1).alias("call_event_id"))
    calls = pairs.select("session_id", "call_event_id", F.concat(F.lit("call"), F.col("event_id").cast("string")).alias("tool_name"), F.lit("{}").alias("tool_input"))
    return C.tool_identity(stored, pairs, calls).select("event_id", "tool")


@on_activity("J29_mapped_events", """
, e AS (SELECT session_id, event_id, path, action FROM v_files), bad AS (SELECT DISTINCT session_id FROM e WHERE path = 'f4')
SELECT event_id, 'A' || path AS asset_id, CASE WHEN action = 'edit' THEN 2 ELSE 3 END::INT AS version FROM e WHERE session_id NOT IN (SELECT session_id FROM bad)""")
def _(a):
    events = a.files.select("session_id", "event_id", F.col("path").alias("source_asset"), F.col("action").alias("content_hash"))
    mapping = a.files.filter("path <> 'f4'").select(F.col("path").alias("source_asset"), F.concat(F.lit("A"), "path").alias("asset_id")).distinct()
    versions = mapping.select("asset_id", F.explode(F.array(F.struct(F.lit("edit").alias("content_hash"), F.lit(2).alias("version")), F.struct(F.lit("other").alias("content_hash"), F.lit(3).alias("version")))).alias("v")).select("asset_id", "v.*")
    return C.mapped_events(events, mapping, versions)[0].select("event_id", "asset_id", "version")


@on_tables("J17_text_mentions", "SELECT doc_id, 'a' || (doc_id % 20) AS asset_id FROM documents WHERE doc_id % 3 <> 2 AND doc_id % 20 <> 7")
def _(read):
    n = (F.col("doc_id") % 20).cast("string")
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("see /p/x/rules"), n, F.lit("/r.md, now"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("in 'rules"), n, F.lit("/r.md'."))).otherwise("only r.md here")
    rows = read("documents").select("doc_id", said.alias("text"))
    assets = read("documents").filter("doc_id % 20 <> 7").select(F.concat(F.lit("a"), n).alias("asset_id"), F.concat(F.lit("/p/x/rules"), n, F.lit("/r.md")).alias("path")).distinct()
    return M.mentioned(rows, assets, text="text", key="doc_id")


#: How a message may name a hook ({p} its path, {d} its folder, {f} its file, {n} its name), and how it only seems to.
NAMED = ["{p}", "'{p}':", "({p}).", "{d}/./{f}", "{d}//{f}", "{d}/x/../{f},", "{f}", "`{f}`!", "[{f}];", "{p}x", "{n}", "x{f}", "{d}.{f}", "/v{p}", "", "{F}"]
HOOK_ENDS = ["py", "sh", "js", "json", "zsh", "md"]
WRAPS_SQL = inputs.quoted(M.WRAPPING)


def _named_sql(form: str) -> str:
    parts = {"p": "path", "d": "folder", "f": "file", "F": "upper(file)", "n": "name"}
    text = inputs.quoted(form)
    for mark, column in parts.items():
        text = f"replace({text}, '{{{mark}}}', {column})"
    return text


@on_tables("J18_hook_links", f"""
WITH h AS (SELECT asset_id, folder, file, name, folder || '/' || file AS path FROM (SELECT 'h' || p_partkey AS asset_id, '/u/' || lower(p_type) || '/hooks' AS folder, name || '.' || {inputs.chosen_sql("p_partkey", HOOK_ENDS)} AS file, name, p_partkey FROM (SELECT *, replace(p_name, ' ', '-') || CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR ELSE '' END AS name FROM part))),
m AS (SELECT doc_id, {inputs.amid_sql("text", "said")} AS text FROM (SELECT doc_id, text, ({inputs.chosen_sql("doc_id", ["~" + f for f in NAMED]).replace("'~", "'")}) AS form, path, folder, file, name FROM documents JOIN h ON asset_id = 'h' || doc_id), LATERAL (SELECT CASE form {" ".join(f"WHEN {inputs.quoted(f)} THEN {_named_sql(f)}" for f in NAMED)} END AS said)),
t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM (SELECT doc_id, list_transform(regexp_split_to_array(text, '[ \t\n\r"''`]+'), lambda w: trim(w, {WRAPS_SQL})) AS words FROM m)),
f AS (SELECT doc_id, pos, CASE WHEN contains(word, '/') THEN regexp_replace(regexp_replace(regexp_replace(word, '/(\\./)+', '/', 'g'), '//+', '/', 'g'), '[^/]+/\\.\\./', '', 'g') ELSE word END AS ref FROM t WHERE regexp_matches(word, '(?i)\\.({"|".join(M.HOOK_FILES)})$')),
n AS (SELECT lower(name) AS name, min(asset_id) AS asset_id FROM h GROUP BY 1 HAVING count(*) = 1),
p AS (SELECT path, min(asset_id) AS asset_id FROM h GROUP BY 1),
l AS (SELECT doc_id, 0 AS rule, pos, ref, asset_id FROM f JOIN p ON ref = path UNION ALL SELECT doc_id, 1, pos, ref, asset_id FROM f JOIN n ON lower(regexp_replace(regexp_extract(ref, '[^/]*$'), '\\.[^.]*$', '')) = n.name)
SELECT doc_id, asset_id, ref AS reference, CASE rule WHEN 0 THEN 'path' ELSE 'name' END AS rule FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rule, pos) = 1""")
def _(read):
    """Hooks made of the parts, half of them with names of their own; each document names the hook of its number in one of many ways, amid its text."""
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(""))
    hooks = read("part").select(F.concat(F.lit("h"), F.col("p_partkey").cast("string")).alias("asset_id"), name.alias("name"), F.concat(F.lit("/u/"), F.lower("p_type"), F.lit("/hooks")).alias("folder"), F.concat(name, F.lit("."), inputs.chosen("p_partkey", HOOK_ENDS)).alias("file"))
    hooks = hooks.withColumn("path", F.concat_ws("/", "folder", "file"))
    said = inputs.chosen("doc_id", NAMED)
    for mark, column in (("p", F.col("path")), ("d", F.col("folder")), ("f", F.col("file")), ("F", F.upper("file")), ("n", F.col("name"))):
        said = F.replace(said, F.lit(f"{{{mark}}}"), column)
    docs = read("documents").withColumn("asset_id", F.concat(F.lit("h"), F.col("doc_id").cast("string"))).select("doc_id", "text", "asset_id")
    blocked = docs.join(hooks, "asset_id").select("doc_id", inputs.amid("text", said).alias("text"))
    return M.hook_links(blocked, hooks.select("asset_id", "path"), text="text", key="doc_id")


@on_activity("J19_uncovered", """
, p AS (SELECT DISTINCT signature, coalesce(project_key, '__unrecorded__') AS project FROM v_friction)
SELECT signature, project FROM p WHERE NOT contains(signature, 'tool0') AND NOT (contains(signature, 'tool1') AND project = 'p3')""")
def _(a):
    pairs = a.friction.select("signature", S.bucketed(F.col("project_key")).alias("project")).distinct().withColumn("keywords", F.array(F.split_part("signature", F.lit("|"), F.lit(2)), F.lit("never")))
    rules = a.spark.range(1).select(F.explode(F.array(F.struct(F.lit("tool0").alias("keyword"), F.lit("user").alias("scope"), F.lit(None).cast("string").alias("project")), F.struct(F.lit("tool1").alias("keyword"), F.lit("project").alias("scope"), F.lit("p3").alias("project")))).alias("m")).select("m.*")
    return M.uncovered(pairs, rules).select("signature", "project")


@on_activity("A38_coverage_gaps", "SELECT signature, coalesce(project_key, '__unrecorded__') AS project, count(DISTINCT session_id) AS sessions FROM v_friction WHERE NOT contains(signature, 'tool0') GROUP BY ALL HAVING count(DISTINCT session_id) >= 2")
def _(a):
    per = a.friction.groupBy("signature", S.bucketed(F.col("project_key")).alias("project")).agg(F.countDistinct("session_id").alias("sessions")).filter("sessions >= 2")
    pairs = per.withColumn("keywords", F.array(F.split_part("signature", F.lit("|"), F.lit(2))))
    rules = a.spark.range(1).select(F.lit("tool0").alias("keyword"), F.lit("user").alias("scope"), F.lit(None).cast("string").alias("project"))
    return M.uncovered(pairs, rules).select("signature", "project", "sessions")


@on_activity("A19_adherence", """
, h AS (SELECT tool AS mechanism, coalesce(project_key, '__unrecorded__') AS project, session_id FROM v_friction)
SELECT 'r1' AS asset_id, mechanism, count(*) AS records, count(DISTINCT session_id) AS sessions FROM h WHERE mechanism = 'tool0' GROUP BY mechanism
UNION ALL SELECT 'r2', mechanism, count(*), count(DISTINCT session_id) FROM h WHERE mechanism = 'tool1' AND project = 'p3' GROUP BY mechanism""")
def _(a):
    hits = a.friction.select("signature", F.col("tool").alias("mechanism"), S.bucketed(F.col("project_key")).alias("project"), "session_id")
    rules = a.spark.range(1).select(F.explode(F.array(F.struct(F.lit("r1").alias("asset_id"), F.lit("tool0").alias("mechanism"), F.lit("user").alias("scope"), F.lit("").alias("project")), F.struct(F.lit("r2").alias("asset_id"), F.lit("tool1").alias("mechanism"), F.lit("project").alias("scope"), F.lit("p3").alias("project")))).alias("m")).select("m.*")
    return C.adherence(rules, hits)


@on_activity("A10_turns", "SELECT session_id, count(DISTINCT CASE WHEN role = 'assistant' AND k % 2 = 0 THEN k END) AS assistant_turns, count(*) FILTER (role = 'user' AND k % 5 <> 0 AND k % 7 <> 0) AS user_turns FROM v_messages GROUP BY session_id")
def _(a):
    rows = a.messages.withColumns({"stop_reason": F.when(F.col("k") % 2 == 0, "end_turn"), "message_id": F.col("k"), "sidechain": F.col("k") % 7 == 0})
    return C.turns(rows, injected=F.col("k") % 5 == 0)


@on_activity("A33_missing_commands", """
, o AS (SELECT session_id, ts, CASE k % 4 WHEN 0 THEN 'foo' WHEN 1 THEN 'bar' ELSE '__unparsed__' END AS name FROM v_events WHERE event_type = 'error' UNION ALL SELECT session_id, ts, 'jq' FROM v_events WHERE event_type = 'purchase' AND k % 3 = 0)
SELECT name, count(DISTINCT session_id) AS sessions, count(*) AS count, epoch_us(max(ts)) // 1000 AS last_at FROM o GROUP BY name""")
def _(a):
    m = F.col("k") % 4
    outputs = a.events.filter("event_type = 'error'").select("session_id", "ts", F.when(m == 0, "bash: line 1: foo: command not found").when(m == 1, "zsh: command not found: bar").otherwise("Command not found").alias("output"))
    probes = a.events.filter("event_type = 'purchase' and k % 3 = 0").select("session_id", "ts", F.lit("jq").alias("name"))
    return C.missing_commands(outputs, probes).withColumn("last_at", F.unix_millis("last_at"))


@on_activity("A39_working_commands", """
, c AS (SELECT session_id, ts, program, program || ' --n # x.py' AS label, exit_code FROM v_commands WHERE program <> 'prog3')
SELECT label, count(*) AS runs, count(DISTINCT session_id) AS sessions, count(*) FILTER (exit_code > 0) AS failures, epoch_us(max(ts)) // 1000 AS last_at FROM c GROUP BY label HAVING count(*) >= 3 AND count(DISTINCT session_id) >= 2""".replace("program || ' --n # x.py'", "'prog# --n # ' || program || '.py'").replace("|| program ||", "|| 'prog#' ||"))
def _(a):
    command = F.concat("program", F.lit(" --n "), F.col("event_id").cast("string"), F.lit(" /src/a/"), "program", F.lit(".py"))
    rows = a.commands.withColumns({"command": command, "failed": F.col("exit_code") > 0}).withColumn("program", F.when(F.col("program") == "prog3", "ls").otherwise(F.col("program")))
    return C.working_commands(rows).withColumn("last_at", F.unix_millis("last_at"))


@on_activity("A42_git_outcomes", """
SELECT coalesce(parent_session_id, session_id) AS fleet_id, count(*) FILTER (program = 'prog0') AS "commit", count(*) FILTER (program = 'prog0' AND coalesce(exit_code, 0) = 0) AS commit_ok, count(*) FILTER (program = 'prog1') AS push, count(*) FILTER (program = 'prog1' AND coalesce(exit_code, 0) = 0) AS push_ok,
    count(*) FILTER (program = 'prog2') AS merge, count(*) FILTER (program = 'prog2' AND coalesce(exit_code, 0) = 0) AS merge_ok FROM v_commands JOIN v_sessions USING (session_id) WHERE program IN ('prog0', 'prog1', 'prog2') GROUP BY 1""")
def _(a):
    p = F.col("program")
    rows = a.commands.withColumn("command", F.when(p == "prog0", "git commit -m x").when(p == "prog1", "git push").when(p == "prog2", "git merge b").otherwise("git commits"))
    return C.git_outcomes(rows, a.sessions)


@on_activity("T11_outdated_rows", "SELECT DISTINCT session_id FROM v_friction WHERE event_id % 10 <> 0")
def _(a):
    return C.outdated(a.friction.withColumn("rule_version", F.when(F.col("event_id") % 10 == 0, "v2").when(F.col("event_id") % 10 > 5, "v1")), "v2", key=["session_id"])


@on_activity("T3_changed_assets", "SELECT DISTINCT path FROM v_files WHERE session_id IN (SELECT session_id FROM v_files WHERE event_id > 9000 UNION SELECT session_id FROM v_friction WHERE event_id > 9500)")
def _(a):
    from tracewell.operators.sets import changed_keys

    changed = changed_keys([(a.files, "event_id", 9000), (a.friction, "event_id", 9500)], "session_id")
    return a.files.join(changed, "session_id", "left_semi").select("path").distinct()


@on_activity("Q6_timeline", """
SELECT id, row_kind, (row_number() OVER (ORDER BY ts DESC, id DESC, row_kind))::INT AS place FROM (SELECT event_id AS id, ts, 'friction' AS row_kind FROM v_friction UNION ALL SELECT event_id, ts, 'file' FROM v_files) ORDER BY ts DESC, id DESC, row_kind LIMIT 200""")
def _(a):
    from pyspark.sql import Window as W

    rows = C.timeline(friction=a.friction.select(F.col("event_id").alias("id"), F.col("ts").alias("at")), file=a.files.select(F.col("event_id").alias("id"), F.col("ts").alias("at"))).limit(200)
    return rows.select("id", "row_kind", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.col("at").desc(), F.col("id").desc(), "row_kind")).alias("place"))


@on_activity("Q8_audit", "SELECT session_id, 'messages' AS field, count(*)::BIGINT AS raw, (count(*) - 1)::BIGINT AS derived FROM v_messages GROUP BY session_id HAVING count(*) % 5 = 0")
def _(a):
    raw = a.messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("users"))
    derived = raw.withColumn("messages", F.col("messages") - F.when(F.col("messages") % 5 == 0, 1).otherwise(0))
    return C.audit(raw, derived, key="session_id", fields=["messages", "users"])


@on_activity("Q9_report_equalities", "SELECT 'sessions' AS what, 0::BIGINT AS apart UNION ALL SELECT 'friction', 0 UNION ALL SELECT 'active', 0")
def _(a):
    from tracewell.operators.ordered import active_time

    total = stats.overview_totals(a.sessions, a.events, a.friction).select("sessions", (F.col("tool_errors") + F.col("interrupts")).alias("friction"))
    by_day = stats.daily(sessions=(a.sessions, "started_at"), friction=(a.friction, "ts")).agg(F.sum("sessions").alias("s"), F.sum("friction").alias("f"))
    spans = stats.spans(a.events, by=["session_id"], at="ts").join(active_time(a.events, by=["session_id"], at="ts", tie="ts"), "session_id").agg(F.count_if(F.col("active_ms") > F.col("duration_ms") + 1).alias("x"))
    joined = total.crossJoin(by_day).crossJoin(spans)
    return joined.select(F.stack(F.lit(3), F.lit("sessions"), F.col("sessions") - F.col("s"), F.lit("friction"), F.col("friction") - F.col("f"), F.lit("active"), F.col("x")).alias("what", "apart"))


@on_activity("Q4_friction_overview", """
SELECT g.signature, g.records, g.sessions, n.lines FROM (SELECT signature, count(*) AS records, count(DISTINCT session_id) AS sessions FROM v_friction GROUP BY signature HAVING count(DISTINCT session_id) >= 2) g
JOIN (SELECT signature, arg_max('e' || event_id, struct_pack(ts := ts, id := event_id)) AS lines FROM v_friction GROUP BY signature) n USING (signature)""")
def _(a):
    life = X.lifecycle(a.friction, start=START, end=END).filter("sessions >= 2")
    lines = X.evidence(a.friction.withColumn("line", F.concat(F.lit("e"), F.col("event_id").cast("string"))), samples=1)
    return life.join(lines, "signature").select("signature", "records", "sessions", F.array_join("lines", "").alias("lines"))


@on_activity("Q7_cleanup_candidates", "SELECT path FROM v_files GROUP BY path HAVING arg_max(action, struct_pack(ts := ts, id := event_id)) = 'read'")
def _(a):
    from tracewell.operators.assets import state_history

    moves = a.files.select(F.col("path"), F.when(F.col("action") == "read", "dormant").otherwise("healthy").alias("to_state"), F.col("ts").alias("occurred_at"), F.col("event_id").alias("id"))
    return state_history(moves, asset="path").filter("ended_at is null and state = 'dormant'").select("path")


@on_activity("Q5_session_detail", "SELECT session_id, 'command' AS row_kind, event_id FROM v_commands UNION ALL SELECT session_id, 'file', event_id FROM v_files UNION ALL SELECT session_id, 'friction', event_id FROM v_friction UNION ALL SELECT session_id, 'message', event_id FROM v_messages")
def _(a):
    from tracewell.operators.sets import one_sequence

    parts = {"command": a.commands, "file": a.files, "friction": a.friction, "message": a.messages}
    return one_sequence(**{k: v.select("session_id", "event_id") for k, v in parts.items()})


@on_activity("O6_live_order", """
SELECT session_id, place FROM (SELECT s.session_id, (row_number() OVER (ORDER BY thread_kind = 'main' DESC, (SELECT count(*) FROM v_sessions c WHERE c.parent_session_id = s.session_id AND c.ended_at > TIMESTAMP '2024-01-30 12:00:00') DESC, s.session_id))::INT AS place
    FROM v_sessions s WHERE s.ended_at > TIMESTAMP '2024-01-30 12:00:00')""")
def _(a):
    from tracewell.operators.ordered import numbered

    rows = S.live(a.sessions, a.events.select("session_id", F.col("ts").alias("mtime")), now=END, minutes=720)
    placed = numbered(rows, ranks=[F.when(F.col("thread_kind") == "main", 0).otherwise(1), -F.col("live_children")], last="session_id", out="place")
    return placed.select("session_id", F.col("place").cast("int").alias("place"))


@on_activity("S13_rescued", "SELECT count(DISTINCT 'f' || session_id) AS files, count(DISTINCT session_id) AS sessions FROM v_events WHERE user_id % 5 = 0")
def _(a):
    from tracewell.sources.transcripts import rescued

    manifest = a.sessions.select(F.concat(F.lit("f"), "session_id").alias("path"), "session_id", "user_id")
    return rescued(manifest, manifest.filter("user_id % 5 <> 0"))

"""Queries of text functions and joins by text over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import literals, rules, shell, text
from tracewell.operators import calls
from tracewell.operators import mentions as M
from tracewell.operators import search
from tracewell.plans import inputs
from tracewell.plans.catalog import on_activity, on_tables

LINE = r"""substr(trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(lower(trim({c})), '^exit code:?\s*-?[0-9]+\s*[:.\-]?\s*', ''), '\s+', ' ', 'g'), ' '),
    lambda w: regexp_replace(regexp_replace(w, '^(['||chr(39)||'"`,;()\[\]{{}}<>]*)(?:[a-z]:)?[/\\].*[/\\]([^/\\'||chr(39)||'"`,;()\[\]{{}}<>]+[/\\]*['||chr(39)||'"`,;()\[\]{{}}<>]*)$', '\1\2'), '^(['||chr(39)||'"`,;()\[\]{{}}<>]*)(?:[a-z]:)?[/\\]([^/\\]+)$', '\1\2')), ' '), '[0-9]+', '#', 'g')), 1, 120)"""


@on_tables("H1_normalized_urls", "SELECT page_id, " + LINE.format(c="'Exit code 2: at /' || url || ' line ' || page_id") + " AS line FROM pages")
def _(read):
    c = F.concat(F.lit("Exit code 2: at /"), F.col("url"), F.lit(" line "), F.col("page_id").cast("string"))
    return read("pages").select("page_id", text.normalized_line(c).alias("line"))


@on_tables("H2_evidence_lines", """
SELECT doc_id, list_filter(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_matches(x, '(?i)error|fail|fatal|cannot|denied|not found|exception|panic|refused|blocked|rejected|unable to')
    AND NOT (length(x) >= 3 AND (regexp_matches(x, '^(?:[=\\-_*~#!+]| )+$'))) AND NOT regexp_matches(lower(x), '^(chunk id:|wall time|process exited with code|original token count:|output:|script failed|script error:|script completed|total output lines:|warning: truncated output)'))[1] AS line
FROM documents""")
def _(read):
    return read("documents").select("doc_id", text.evidence_line(F.coalesce("text", F.lit("")), F.lit("")).alias("line"))


@on_tables("H13_project_keys", "SELECT page_id, CASE WHEN instr(url, '/en/') > 1 AND split_part(substr(url, instr(url, '/en/') + 4), '/', 1) <> '' THEN substr(url, 1, instr(url, '/en/') - 1) ELSE url END AS project, CASE WHEN instr(url, '/en/') > 1 AND split_part(substr(url, instr(url, '/en/') + 4), '/', 1) <> '' THEN split_part(substr(url, instr(url, '/en/') + 4), '/', 1) END AS worktree FROM pages")
def _(read):
    project, worktree = text.project_key(F.col("url"), marker="/en/")
    return read("pages").select("page_id", project.alias("project"), worktree.alias("worktree"))


@on_tables("H14_labels", "SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '')[-1] AS label FROM pages")
def _(read):
    return read("pages").select("page_id", text.project_label(F.col("url")).alias("label"))


def _tags_sql() -> str:
    parts = []
    for tag, words in text.TASK_TAGS.items():
        any_of = " OR ".join(f"contains(lower(text), '{w}')" for w in words)
        parts.append(f"CASE WHEN {any_of} THEN '{tag}' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


@on_tables("H15_task_tags", f"SELECT conv_id, turn, array_to_string(CASE WHEN len(t) = 0 THEN ['recorded-task'] ELSE list_sort(t) END, ',') AS tags FROM (SELECT conv_id, turn, {_tags_sql()} AS t FROM conversations WHERE role = 'user' AND length(trim(text)) >= 2)")
def _(read):
    rows = read("conversations").filter("role = 'user' and length(trim(text)) >= 2")
    return rows.select("conv_id", "turn", F.array_join(text.task_tags(F.col("text")), ",").alias("tags"))


@on_tables("H16_shape_classes", "SELECT user_id, string_agg(DISTINCT lower(event_type), '|' ORDER BY lower(event_type)) AS shape FROM events GROUP BY user_id")
def _(read):
    tags = read("events").groupBy("user_id").agg(F.collect_set(F.concat(F.lit(" "), F.upper("event_type"))).alias("t"))
    return tags.select("user_id", text.shape_class(F.col("t")).alias("shape"))


#: What a text may begin with: each prefix, indented, missed by a character and after another word.
OPENINGS = [y for p in rules.INJECTED_PREFIXES for y in (p, f"  \n{p}"[2:] if len(p) % 2 else f"   {p}", inputs.near_miss(p), f"x {p}")]


@on_tables("P8_injected", f"""
SELECT conv_id, turn, {" OR ".join(f"starts_with(ltrim(made, ' '), {inputs.quoted(p)})" for p in rules.INJECTED_PREFIXES)} AS injected
FROM (SELECT conv_id, turn, {inputs.chosen_sql("(7 * conv_id + turn)", [p.replace(chr(10), "") for p in OPENINGS])} || coalesce(text, '') AS made FROM conversations)""")
def _(read):
    rows = read("conversations").withColumn("_n", 7 * F.col("conv_id") + F.col("turn"))
    made = F.concat(inputs.chosen("_n", [p.replace("\n", "") for p in OPENINGS]), F.coalesce("text", F.lit("")))
    return rows.select("conv_id", "turn", rules.is_injected(made).alias("injected"))


@on_tables("P9_noise", "SELECT conv_id, turn, trim(coalesce(text, '')) = '' OR contains(text, '<INSTRUCTIONS>') OR starts_with(trim(text), 'File does not exist') AS noise, lower(trim(role)) IN ('user', 'assistant', 'tool') AS counted FROM conversations")
def _(read):
    return read("conversations").select("conv_id", "turn", text.is_noise(F.col("text")).alias("noise"), text.is_transcript_role(F.col("role")).alias("counted"))


@on_tables("H21_bounded_text", "SELECT conv_id, turn, CASE WHEN length(trim(text)) > 160 THEN substr(trim(text), 1, 160) || '…' ELSE trim(text) END AS text, length(trim(text)) > 160 AS cut FROM conversations")
def _(read):
    t, cut = text.bounded(F.col("text"), 160)
    return read("conversations").select("conv_id", "turn", t.alias("text"), cut.alias("cut"))


@on_tables("H5_outcomes", r"""
WITH o AS (SELECT doc_id, concat_ws(chr(10), CASE WHEN doc_id % 3 = 0 THEN 'Script failed' END, coalesce(text, ''), CASE WHEN doc_id % 4 = 1 THEN ' exit code: ' || (doc_id % 7) END) AS output FROM documents)
SELECT doc_id, CASE WHEN contains(output, '<tool_use_error>') OR starts_with(ltrim(output), 'Script failed') THEN 'true' END AS is_error,
    TRY_CAST(coalesce(nullif(regexp_extract(output, '(?im)^\s*exit\s+(?:code|status)\s*[:=]?\s*([0-9]+)\b', 1), ''), nullif(regexp_extract(output, '\bProcess exited with code ([0-9]+)', 1), '')) AS INT) AS exit_code FROM o""")
def _(read):
    out = F.concat_ws("\n", F.when(F.col("doc_id") % 3 == 0, "Script failed"), F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit(" exit code: "), (F.col("doc_id") % 7).cast("string"))))
    err, code = text.outcome(out, F.lit(None).cast("boolean"), F.lit(None).cast("int"))
    return read("documents").select("doc_id", err.cast("string").alias("is_error"), code.alias("exit_code"))


PROBES = inputs.probes(rules.output_literals())
COMMANDS = [None, "grep a b", "pytest -q", "go build ./x", "run it", "diff a b", "make all", "test -f x", "cargo test", "pgrep x"]
CODES, TOOLS, ABORTS = [None, 0, 1, 2, 5, 124, 127, 130, None], ["bash", "Edit", "local_shell", None], [None, None, None, " interrupted ", "other"]
OPENED = ["", "", "", " [Request interrupted by user] x", "a [Request interrupted by user", "", inputs.near_miss("[Request interrupted by user")]


def _categories_sql() -> str:
    """The rules in their order over the columns of ``m``, taken from the tables of the rules."""
    shell_sql = "(coalesce(command, '') <> '' OR " + " OR ".join(f"contains(lower(coalesce(tool, '')), '{t}')" for t in rules.SHELL_TOOLS) + ")"
    steps = ["WHEN trim(coalesce(abort, '')) = 'interrupted' OR starts_with(ltrim(said), '[Request interrupted by user') THEN 'user_interrupt'"]
    for r in rules.OUTPUT_RULES:
        met = "(" + " OR ".join(inputs.holds_sql("output", x) for x in r.literals) + ")"
        met += f" AND {shell_sql}" if r.shell_only else ""
        met += " AND (" + " OR ".join(f"contains(lower(coalesce(command, '')), '{c}')" for c in r.commands) + ")" if r.commands else ""
        steps.append(f"WHEN {met} THEN '{r.category}'")
        steps += [f"WHEN code IN ({', '.join(map(str, r.exit_codes))}) THEN '{r.category}'"] if r.exit_codes else []
    answers = " OR ".join(f"(code = {code} AND split_part(coalesce(command, ''), ' ', 1) IN ({', '.join(map(inputs.quoted, names))}))" for names, code, _ in rules.PROGRAM_EXITS)
    steps += ["WHEN code = 124 THEN 'timeout'", f"WHEN {answers} THEN 'expected_exit'", "WHEN code <> 0 THEN 'nonzero_exit'", "WHEN is_error THEN 'tool_error'"]
    return "CASE " + " ".join(steps) + " END"


@on_tables("H3_categories", f"""
WITH m AS (SELECT doc_id, {inputs.amid_sql("text", inputs.chosen_sql("doc_id", PROBES))} AS output, {inputs.chosen_sql("doc_id", COMMANDS, 3)} AS command, {inputs.chosen_sql("doc_id", CODES, 7)} AS code,
    {inputs.chosen_sql("doc_id", TOOLS, 5)} AS tool, {inputs.chosen_sql("doc_id", ABORTS, 11)} AS abort, {inputs.chosen_sql("doc_id", OPENED, 13)} AS said, doc_id % 17 = 0 AS is_error FROM documents)
SELECT doc_id, {_categories_sql()} AS category FROM m""")
def _(read):
    """Every literal of the rules as it stands, in both cases and missed, amid texts of the table, with commands, codes and tools of all kinds."""
    pick = inputs.chosen
    made = read("documents").select("doc_id", inputs.amid("text", pick("doc_id", PROBES)).alias("output"), pick("doc_id", COMMANDS, 3).alias("command"), pick("doc_id", CODES, 7).cast("int").alias("code"), pick("doc_id", TOOLS, 5).alias("tool"), pick("doc_id", ABORTS, 11).alias("abort"), pick("doc_id", OPENED, 13).alias("said"), (F.col("doc_id") % 17 == 0).alias("is_error"))
    known = made.select("command", "code").distinct().withColumn("expected", shell.expected_udf("command", "code")).withColumnsRenamed({"command": "_c", "code": "_k"})
    made = made.join(known, F.col("command").eqNullSafe(F.col("_c")) & F.col("code").eqNullSafe(F.col("_k")))
    made = made.withColumn("held", literals.found(F.col("output"), rules.output_literals()))
    name, _ = rules.category(text=F.col("said"), output=F.col("output"), command=F.col("command"), tool=F.col("tool"), exit_code=F.col("code"), is_error=F.col("is_error"), abort_reason=F.col("abort"), expected=F.col("expected"), held=F.col("held"))
    return made.select("doc_id", name.alias("category"))


@on_tables("H6_friction_kinds", f"""
WITH m AS (SELECT conv_id, turn, {inputs.chosen_sql("(5 * conv_id + turn)", OPENED)} || coalesce(text, '') AS said, {inputs.chosen_sql("(5 * conv_id + turn)", ABORTS, 3)} AS abort, {inputs.chosen_sql("(5 * conv_id + turn)", CODES, 2)} AS code,
    CASE (5 * conv_id + turn) % 4 WHEN 0 THEN true WHEN 1 THEN false END AS is_error FROM conversations)
SELECT conv_id, turn, CASE WHEN trim(coalesce(abort, ''), ' ') = 'interrupted' OR starts_with(ltrim(said, ' '), '[Request interrupted by user') THEN 'user_interrupt' WHEN coalesce(is_error, false) OR coalesce(code, 0) <> 0 THEN 'tool_error' END AS kind FROM m""")
def _(read):
    n, pick = 5 * F.col("conv_id") + F.col("turn"), inputs.chosen
    made = read("conversations").withColumn("_n", n).select("conv_id", "turn", F.concat(pick("_n", OPENED), F.coalesce("text", F.lit(""))).alias("said"), pick("_n", ABORTS, 3).alias("abort"), pick("_n", CODES, 2).cast("int").alias("code"), F.when(F.col("_n") % 4 == 0, True).when(F.col("_n") % 4 == 1, False).alias("is_error"))
    return made.select("conv_id", "turn", rules.friction_kind(text=F.col("said"), abort_reason=F.col("abort"), is_error=F.col("is_error"), exit_code=F.col("code")).alias("kind"))


#: Lines that say how a command ended, and some that only look like it.
PRINTED = ["Process exited with code 3", "Process exited with code 0", "Process exit with code 3", "exit code: 12", "  exit status = 4", "exit codes 5", "exit code 0", "an exit code 7", "Script failed", "a Script failed", "fine"]


@on_tables("P12_printed_failures", f"""
WITH m AS (SELECT conv_id, turn, {inputs.amid_sql("text", inputs.chosen_sql("(3 * conv_id + turn)", PRINTED))} AS output, CASE (conv_id + turn) % 6 WHEN 0 THEN 0 END AS code, CASE (conv_id + turn) % 7 WHEN 0 THEN false END AS is_error FROM conversations)
SELECT conv_id, turn FROM m WHERE code IS NULL AND is_error IS NULL AND turn % 4 <> 3
    AND (regexp_matches(output, 'Process exited with code [1-9]') OR regexp_matches(output, '(^|\\n)[ \\t\\r\\n]*exit (code|status)[ \\t]*[:=]?[ \\t]*[1-9]') OR regexp_matches(output, '(^|\\n)Script failed'))""")
def _(read):
    """Results that state no outcome but in their text; every fourth turn has its friction already."""
    n, at = 3 * F.col("conv_id") + F.col("turn"), F.col("conv_id") + F.col("turn")
    rows = read("conversations").withColumn("_n", n)
    results = rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("event_id"), inputs.amid("text", inputs.chosen("_n", PRINTED)).alias("output"), F.when(at % 6 == 0, 0).alias("exit_code"), F.when(at % 7 == 0, False).alias("is_error"))
    known = rows.filter("turn % 4 = 3").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("event_id"))
    return calls.printed_failures(results, known).select(F.col("session_id").alias("conv_id"), F.col("event_id").alias("turn"))


CATEGORIES, PROGRAMS = [r.category for r in rules.OUTPUT_RULES], ["Git", None, " rg ", ""]


@on_tables("H4_signatures", f"""
WITH m AS (SELECT page_id, {inputs.chosen_sql("page_id", CATEGORIES)} AS category, {inputs.chosen_sql("page_id", TOOLS, 3)} AS tool, CASE WHEN page_id % 5 <> 0 THEN 'Exit code 2: at /' || url || ' line ' || page_id END AS line, {inputs.chosen_sql("page_id", PROGRAMS, 2)} AS program, {inputs.chosen_sql("page_id", CODES)} AS code FROM pages),
n AS (SELECT *, {LINE.format(c="line")} AS short, lower(coalesce(nullif(trim(program), ''), nullif(trim(tool), ''))) AS subject FROM m)
SELECT page_id, concat_ws('|', category, coalesce(tool, ''), coalesce(short, CASE WHEN coalesce(code, 0) <> 0 THEN concat_ws(' exit ', subject, code::VARCHAR) ELSE concat_ws(' ', subject, 'tool_error') END)) AS signature FROM n""")
def _(read):
    line = F.when(F.col("page_id") % 5 != 0, F.concat(F.lit("Exit code 2: at /"), F.col("url"), F.lit(" line "), F.col("page_id").cast("string")))
    pick = inputs.chosen
    return read("pages").select("page_id", text.signature(pick("page_id", CATEGORIES), pick("page_id", TOOLS, 3), line, program=pick("page_id", PROGRAMS, 2), exit_code=pick("page_id", CODES).cast("int")).alias("signature"))


def found_sql(table: str, key: str, phrase: str, *fields: str) -> str:
    """Matches in all fields, the fields met and the surroundings of the first match, said over each field in turn."""
    one = " UNION ALL ".join(f"SELECT {key}, {i} AS place, '{f}' AS field, {f}::VARCHAR AS v FROM {table}" for i, f in enumerate(fields))
    return f"""f AS ({one}), h AS (SELECT {key}, place, field, (length(v) - length(replace(lower(v), '{phrase}', ''))) // {len(phrase)} AS n, substr(v, greatest(strpos(lower(v), '{phrase}') - 60, 1)::BIGINT, 120) AS s FROM f WHERE contains(lower(v), '{phrase}'))
SELECT {key}, sum(n)::BIGINT AS matches, string_agg(field, ',' ORDER BY place) AS fields, arg_min(s, place) AS snippet FROM h GROUP BY {key}"""


@on_tables("H19_search", "WITH " + found_sql("documents", "doc_id", "license", "text", "source", "lang"))
def _(read):
    return search.scan(read("documents"), "LICENSE", key="doc_id", fields=["text", "source", "lang"]).withColumn("fields", F.array_join("fields", ","))


@on_tables("H19_trigram_search", "WITH " + found_sql("benchmark", "item_id", "the th", "text", "item_id"))
def _(read):
    rows, given = read("benchmark"), {"key": "item_id", "fields": ["text", "item_id"]}
    grams = search.index(rows, **given)
    return search.lookup(grams, search.counts(grams), rows, "The th", **given).withColumn("fields", F.array_join("fields", ","))


@on_activity("H19_session_search", ", " + found_sql("v_sessions", "session_id", "h1", "project_key", "source", "model", "session_id"))
def _(a):
    """Two characters: a scan over the fields of a session list."""
    found = search.scan(a.sessions, "H1", key="session_id", fields=["project_key", "source", "model", "session_id"])
    return found.withColumn("fields", F.array_join("fields", ","))


@on_tables("H17_references", r"""
WITH m AS (SELECT doc_id, coalesce(text, '') || chr(10) || '- Reference: command run' || (doc_id % 3) || chr(10) || 'reference: other x' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || ' reference:  PATH /a/b ' || doc_id ELSE '' END AS made FROM documents),
l AS (SELECT doc_id, unnest(string_split(made, chr(10))) AS line FROM m)
SELECT doc_id, lower(regexp_extract(line, '(?i)^\s*[-*]?\s*reference:\s*(command|path|tool)\s+(\S.*?)\s*$', 1)) AS kind, regexp_extract(line, '(?i)^\s*[-*]?\s*reference:\s*(command|path|tool)\s+(\S.*?)\s*$', 2) AS value
FROM l WHERE regexp_matches(line, '(?i)^\s*[-*]?\s*reference:\s*(command|path|tool)\s+(\S.*?)\s*$')""")
def _(read):
    made = F.concat(F.coalesce("text", F.lit("")), F.lit("\n- Reference: command run"), (F.col("doc_id") % 3).cast("string"), F.lit("\nreference: other x"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n reference:  PATH /a/b "), F.col("doc_id").cast("string"))).otherwise(""))
    return read("documents").select("doc_id", F.explode(text.references(made)).alias("r")).select("doc_id", "r.kind", "r.value")


@on_tables("J16_longest_prefix", """
, r AS (SELECT DISTINCT split_part(url, '/', 1) || '//' || split_part(url, '/', 3) AS root FROM pages UNION SELECT DISTINCT split_part(url, '/', 1) || '//' || split_part(url, '/', 3) || '/' || split_part(url, '/', 4) FROM pages WHERE page_id % 3 = 0)
SELECT p.page_id, arg_max(r.root, length(r.root)) AS root_id FROM pages p LEFT JOIN r ON p.url = r.root OR starts_with(p.url, r.root || '/') OR starts_with(p.url, r.root || '#') GROUP BY p.page_id""".replace(", r AS", "WITH r AS", 1))
def _(read):
    pages, part = read("pages"), lambda n: F.split_part(F.col("url"), F.lit("/"), F.lit(n))
    site = F.concat(part(1), F.lit("//"), part(3))
    roots = pages.select(site.alias("root")).union(pages.filter("page_id % 3 = 0").select(F.concat(site, F.lit("/"), part(4)))).distinct().withColumn("root_id", F.col("root"))
    return M.longest_prefix(pages, roots, path="url", root="root", root_id="root_id").select("page_id", "root_id")


@on_tables("J26_reference_check", "SELECT item_id, kind, (CASE WHEN kind = 'tool' THEN NULL WHEN item_id % 2 = 0 THEN 'true' ELSE 'false' END) AS \"exists\" FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'command' WHEN 1 THEN 'path' ELSE 'tool' END AS kind FROM benchmark)")
def _(read):
    kind = F.when(F.col("item_id") % 3 == 0, "command").when(F.col("item_id") % 3 == 1, "path").otherwise("tool")
    refs = read("benchmark").select("item_id", kind.alias("kind"), F.col("item_id").cast("string").alias("value"))
    return M.reference_check(refs, refs.filter("item_id % 2 = 0 and kind <> 'tool'")).select("item_id", "kind", F.col("exists").cast("string").alias("exists"))


@on_tables("U4_keywords_in_text", "SELECT doc_id, array_to_string(list_filter(['MIT', 'token', 'the '], lambda k: contains(lower(text), lower(k))), ',') AS found FROM documents")
def _(read):
    return read("documents").select("doc_id", F.array_join(text.keywords_in(F.col("text"), ["MIT", "token", "the "]), ",").alias("found"))


@on_tables("J27_locators", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN (SELECT o_orderkey AS l_orderkey, 1 AS l_linenumber FROM orders) USING (l_orderkey, l_linenumber)")
def _(read):
    wanted = read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return read("lineitem").join(wanted, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey")

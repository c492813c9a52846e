"""Queries of the shell rules: whole texts of the tables as arguments, lines and scripts between words that the rules know."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions import rules, shell
from tracewell.plans import inputs
from tracewell.plans.catalog import on_tables

#: Every word that the rules know, in order, as it stands and missed by a character, and words of other kinds.
KNOWN = sorted(shell.PASSED | shell.ENDING | shell.HANDING | shell.RUNNERS | shell.SUBRUNNERS | {"env", "echo", "timeout"})
HEADS = KNOWN + [inputs.near_miss(w) for w in KNOWN if len(w) > 2] + [
    "/usr/bin/tool", "/usr/bin/env", "./run.sh", "\\ls", "A=1", "a/b=c", "R=$(curl -s u)", "R=`date", "(cd", "{git", "$tool", "'quoted", '"name"', "-n", "# note", "#!", "/", "which jq", "which 'rg'", "which a b", "which -a", "timeout 30 rg", "python -m pytest", "uv run mypy",
]
OWNERS = [n for names, _, _ in rules.PROGRAM_EXITS for n in names] + ["make", "sudo rg", "timeout -k 5 30 grep", "python3 -u -m pytest", "py.test x", "poetry run pytest", "X=1 env ag", "/opt/ci/python -m pytest", "cd", "true", "uv", "timeout 9 /usr/bin/diff"]
EXITS = sorted({code for _, code, _ in rules.PROGRAM_EXITS} | set(rules.GENERIC_EXITS) | {0, 2})
JOINS = ["; ", " && ", " | ", "\n", " || ", " & ", " ' ", ' " ', " "]

SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TOKEN = r"""\"[^\"]*\"?|'[^']*'?|`[^`]*`?|&&|\|\||[;&|\n]|[^\"'`;&|\n]+"""


def cut_sql(command: str, separators: tuple[str, ...]) -> str:
    """A list of the pieces of a command between separators outside quotes."""
    known = ", ".join(inputs.quoted(s) for s in separators)
    return f"string_split(array_to_string(list_transform(regexp_extract_all({command}, {inputs.quoted(TOKEN)}), lambda t: CASE WHEN t IN ({known}) THEN chr(1) ELSE t END), ''), chr(1))"


def words_sql(statement: str) -> str:
    return f"list_filter(regexp_split_to_array({statement}, {inputs.quoted(SPACE + '+')}), lambda x: x <> '')"


def among(words) -> str:
    return "(" + ", ".join(inputs.quoted(w) for w in sorted(words)) + ")"


def last_sql(path: str) -> str:
    return f"coalesce(nullif(regexp_extract({path}, '([^/]*)/*$', 1), ''), '/')"


def lines_of(key: str) -> Column:
    """Words that the rules know, the row's whole text in quotes and bare, and separators between, by the key."""
    pick, t = inputs.chosen, F.coalesce("text", F.lit(""))
    return F.concat(pick(key, HEADS), F.lit(" "), pick(key, HEADS, 3), pick(key, JOINS, 5), pick(key, HEADS, 7), F.lit(" '"), t, F.lit("' "), pick(key, JOINS, 2), pick(key, HEADS, 11), pick(key, JOINS), t)


def lines_sql(key: str) -> str:
    pick, t = inputs.chosen_sql, "coalesce(text, '')"
    return f"{pick(key, HEADS)} || ' ' || {pick(key, HEADS, 3)} || {pick(key, JOINS, 5)} || {pick(key, HEADS, 7)} || ' ''' || {t} || ''' ' || {pick(key, JOINS, 2)} || {pick(key, HEADS, 11)} || {pick(key, JOINS)} || {t}"


NAME_SQL = f"""CASE WHEN regexp_matches(word, '^[A-Za-z0-9_].*=(\\$\\(|`)[^)`]') THEN regexp_extract(word, '^[A-Za-z0-9_].*?=(?:\\$\\(|`)([^)`]+)', 1) WHEN regexp_matches(word, '^[A-Za-z0-9_][^/.=]*=') THEN '' ELSE word END"""
PROGRAMS_SQL = f"""
s AS (SELECT id, unnest(cut) AS statement, generate_subscripts(cut, 1) AS i FROM (SELECT id, {cut_sql("command", shell.STATEMENTS)} AS cut FROM c)),
w AS (SELECT id, i, unnest(words) AS word, generate_subscripts(words, 1) AS j, list_position(list_transform(words, lambda x: starts_with(x, '#')), true) AS noted FROM (SELECT id, i, {words_sql("statement")} AS words FROM s)),
b AS (SELECT id, i, j, regexp_replace(ltrim(trim({NAME_SQL}, '"'''), '({{$'), '^\\\\(.)', '\\1') AS word FROM w WHERE coalesce(noted, 0) = 0 OR j < noted),
n AS (SELECT id, i, j, {last_sql("word")} AS name FROM b WHERE word <> '' AND NOT starts_with(word, '-')),
h AS (SELECT id, i, arg_min(name, j) AS first, arg_min(name, j) FILTER (name <> 'env') AS head FROM n WHERE name NOT IN {among(shell.PASSED)} GROUP BY id, i),
p AS (SELECT id, arg_min(head, i) FILTER (head NOT IN {among(shell.ENDING | {"/", "echo"})}) AS hard, arg_min(CASE WHEN first = 'env' THEN 'env' ELSE 'echo' END, i) FILTER (first = 'env' OR head = 'echo') AS soft FROM h GROUP BY id)"""


@on_tables("H8_programs", f"WITH c AS (SELECT doc_id AS id, {lines_sql('doc_id')} AS command FROM documents), {PROGRAMS_SQL} SELECT c.id AS doc_id, coalesce(hard, soft, '') AS program FROM c LEFT JOIN p USING (id)")
def _(read):
    rows = read("documents").select("doc_id", lines_of("doc_id").alias("command"))
    return shell.with_programs(rows).select("doc_id", "program")


#: The start of a command up to the program that owns its exit status.
BEFORE = r"""["']*[({$]*(?:\S*/)?"""
HANDS = rf"""^{SPACE}*(?:(?:["']*[({{$]*[A-Za-z0-9_][^/.=\s]*=\S*|["']+[({{$]*["']*|[({{$]+["']*|["']*[({{$]*-\S*|{BEFORE}(?:{"|".join(sorted(shell.HANDING))})["']*|{BEFORE}timeout["']*(?:\s+["']*-\S*)*(?:\s+\S+)?|{BEFORE}(?:{"|".join(sorted(shell.SUBRUNNERS))})["']*\s+["']*run["']*)(?:{SPACE}+|$))*"""
MODULE = rf"""^{BEFORE}(?:{"|".join(sorted(shell.RUNNERS))})["']*(?:\s+["']*-\S*)*?\s+["']*-m["']*\s+["']*(\S+)"""


def _answers_sql() -> str:
    """What an exit code says of the program ``o``."""
    return "CASE " + " ".join(f"WHEN code = {code} AND o IN {among(names)} THEN {inputs.quoted(said)}" for names, code, said in rules.PROGRAM_EXITS) + " END"


@on_tables("H7_expected_exits", f"""
WITH m AS (SELECT conv_id, turn, 31 * conv_id + turn AS k, text FROM conversations),
c AS (SELECT conv_id, turn, coalesce(text, '') || chr(10) || {inputs.chosen_sql("k", OWNERS)} || ' x' || {inputs.chosen_sql("k", JOINS, 2)} || {inputs.chosen_sql("k", OWNERS, 3)} || {inputs.chosen_sql("k", [" y", " a | ", " && "], 5)} || {inputs.chosen_sql("k", OWNERS, 7)} AS command, {inputs.chosen_sql("k", EXITS)} AS code FROM m),
l AS (SELECT conv_id, turn, code, list_filter({cut_sql("command", shell.LINES)}, lambda x: regexp_matches(x, '[^\\s]'))[-1] AS line FROM c),
k AS (SELECT conv_id, turn, code, unnest(parts) AS link, generate_subscripts(parts, 1) AS i FROM (SELECT conv_id, turn, code, {cut_sql("line", shell.LINKS)} AS parts FROM l)),
r AS (SELECT conv_id, turn, code, i, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM (SELECT conv_id, turn, code, i, {cut_sql("link", ("|",))} AS parts FROM k)),
f AS (SELECT conv_id, turn, code, i, j, regexp_replace(part, {inputs.quoted(HANDS)}, '') AS rest FROM r),
g AS (SELECT conv_id, turn, code, i, j, CASE WHEN regexp_matches(rest, {inputs.quoted(MODULE)}) THEN rtrim(regexp_extract(rest, {inputs.quoted(MODULE)}, 1), '"''') WHEN rest <> '' THEN {last_sql("ltrim(trim(regexp_extract(rest, '^\\S+'), '\"'''), '({$')")} END AS o FROM f),
w AS (SELECT conv_id, turn, code, i, arg_max(o, j) FILTER (o NOT IN ('.', '/')) AS o FROM g GROUP BY ALL),
a AS (SELECT conv_id, turn, count(*) AS n, count({_answers_sql()}) AS told, count(DISTINCT {_answers_sql()}) AS kinds, any_value({_answers_sql()}) AS said FROM w WHERE o IS NOT NULL AND o NOT IN {among(shell.TRANSPARENT)} GROUP BY ALL)
SELECT c.conv_id, c.turn, CASE {" ".join(f"WHEN code = {code} THEN {inputs.quoted(said)}" for code, said in rules.GENERIC_EXITS.items())} WHEN n = told AND kinds = 1 THEN said END AS meaning,
    CASE WHEN code IN ({", ".join(map(str, rules.GENERIC_EXITS))}) THEN 'true' WHEN n = told AND kinds = 1 THEN 'false' END AS failure FROM c LEFT JOIN a ON c.conv_id = a.conv_id AND c.turn = a.turn""")
def _(read):
    """What the code of each command says: programs of the rules in chains, pipes and wrappers after a turn's whole text."""
    pick = inputs.chosen
    made = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), pick("k", OWNERS), F.lit(" x"), pick("k", JOINS, 2), pick("k", OWNERS, 3), pick("k", [" y", " a | ", " && "], 5), pick("k", OWNERS, 7))
    rows = read("conversations").withColumn("k", 31 * F.col("conv_id") + F.col("turn")).select("conv_id", "turn", made.alias("command"), pick("k", EXITS).cast("int").alias("code"))
    known = rows.select("command", "code").distinct().withColumn("m", shell.meaning_udf("command", "code"))
    return rows.join(known, ["command", "code"]).select("conv_id", "turn", "m.meaning", F.col("m.failure").cast("string").alias("failure"))


#: What may stand before and after a probe.
PROBED = ["which ", "/usr/bin/which ", "'which' ", "which -a ", "sudo which ", "which a ", "whic ", " which\t", "echo; which "]
AFTER = ["", " ", "\n", ";", "; ls", " 2>/dev/null", " && x", " | cat", "*", "'"]


@on_tables("H9_probed_commands", f"""
WITH c AS (SELECT p_partkey AS id, {inputs.chosen_sql("p_partkey", PROBED)} || CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE replace(p_name, ' ', '-') END || {inputs.chosen_sql("p_partkey", AFTER, 9)} AS command FROM part),
s AS (SELECT id, list_filter({cut_sql("command", shell.STATEMENTS)}, lambda x: regexp_matches(x, '[^\\s]')) AS said FROM c), w AS (SELECT id, CASE WHEN len(said) = 1 THEN {words_sql("said[1]")} ELSE [] END AS words FROM s)
SELECT id AS p_partkey, CASE WHEN len(words) = 2 AND regexp_matches(trim(words[1], '"'''), '^(.*/)?which$') AND regexp_matches(trim(words[2], '"'''), '^[^-<>$*?][^<>$*?]*$') THEN trim(words[2], '"''') END AS name FROM w""")
def _(read):
    """Probes of the names in a table, with what makes them no probe of one name alone."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    rows = read("part").select("p_partkey", F.concat(inputs.chosen("p_partkey", PROBED), name, inputs.chosen("p_partkey", AFTER, 9)).alias("command"))
    return rows.join(rows.select("command").distinct().withColumn("name", shell.probed_udf("command")), "command").select("p_partkey", "name")

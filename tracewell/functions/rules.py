"""Rule tables as data, and the column expressions generated from them. Callers may pass tables of their own."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of blocks that a harness writes under the user role.
INJECTED_PREFIXES = (
    "<local-command-caveat>", "<command-name>", "<command-message>", "<command-args>", "<local-command-stdout>", "<local-command-stderr>", "<local-command-result>",
    "<system-reminder>", "<task-notification>", "<subagent_notification>", "<environment_context>", "<user_instructions>", "<recommended_plugins>", "<turn_aborted>",
    "<fork-boilerplate>", "<teammate-message", "<bash-input>", "<bash-stdout>", "<bash-stderr>", "# AGENTS.md instructions", "Async agent launched successfully",
    "(Bash completed", "File does not exist",
)


@dataclass(frozen=True)
class OutputRule:
    """A category with the literals that tell it. A literal in lower case is met in any case, another as it stands."""

    category: str
    literals: tuple[str, ...]
    exit_codes: tuple[int, ...] = ()
    commands: tuple[str, ...] = ()  # the command must hold one of these
    shell_only: bool = False


#: Fixed values.
TEST_COMMANDS = ("go test", "pytest", "npm test", "npm run test", "yarn test", "pnpm test", "jest", "cargo test")
BUILD_COMMANDS = ("go build", "go vet", "tsc", "cargo build", "make", "gradle build", "mvn package")
SHELL_TOOLS = ("bash", "shell", "sh", "exec", "run_terminal_cmd", "local_shell", "terminal")
OUTPUT_RULES = (
    OutputRule("permission_denied", ("permission denied", "EACCES", "Operation not permitted", "requires approval")),
    OutputRule("command_not_found", ("command not found", "not recognized as an internal", "is not recognized"), (127,), shell_only=True),
    OutputRule("file_not_found", ("ENOENT", "no such file", "does not exist", "File does not exist")),
    OutputRule("tool_input_invalid", ("InputValidationError", "String to replace not found", "must be absolute", "old_string")),
    OutputRule("timeout", ("timed out", "timeout", "ETIMEDOUT")),
    OutputRule("network_error", ("ECONNREFUSED", "ENOTFOUND", "Could not resolve host", "TLS handshake", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Time")),
    OutputRule("test_failure", ("FAIL", "failed"), commands=TEST_COMMANDS),
    OutputRule("build_error", ("error:",), commands=BUILD_COMMANDS),
)

#: Exit codes by which a program answers (programs, code), and those that hold whatever ran.
PROGRAM_EXITS = (
    (("rg", "ripgrep", "grep", "egrep", "fgrep", "ag", "ack"), 1, "no match"),
    (("diff", "cmp", "colordiff"), 1, "differs"),
    (("pkill", "pgrep"), 1, "no process"),
    (("test", "["), 1, "condition not met"),
    (("pytest", "py.test"), 5, "no tests collected"),
)
GENERIC_EXITS = {124: "timeout", 130: "SIGINT", 137: "SIGKILL", 143: "SIGTERM"}


@dataclass(frozen=True)
class Hint:
    pattern: str
    kind: str
    keywords: tuple[str, ...] = field(default=())


#: Fixed values, the first that matches a signature counts.
HINTS = (
    Hint(r"^user_interrupt\|", "user_stopped"),
    Hint(r"(?i)command not found|not recognized as an internal|is not recognized", "environment"),
    Hint(r"(?i)no module named|modulenotfounderror", "environment"),
    Hint(r"(?i)file has not been read yet", "harness_rule", ("Read before Edit", "read before you edit", "read the file first")),
    Hint(r"(?i)string to replace not found", "tool_misuse"),
    Hint(r"(?i)blocked by .*hook|pretooluse hook", "user_hook"),
    Hint(r"(?i)auto mode classifier", "permission"),
    Hint(r"(?i)auto mode cannot determine", "permission"),
    Hint(r"(?i)the tool use was rejected", "permission"),
    Hint(r"(?i)mcp error -", "environment"),
    Hint(r"(?i)is already used by worktree at", "tool_misuse"),
    Hint(r"(?i)exec cell .*not found|exec cell # not found", "tool_misuse"),
    Hint(r"(?i)unknown process id", "tool_misuse"),
    Hint(r"(?i)failed to find expected lines|verification failed", "tool_misuse"),
    Hint(r"(?i)thread limit", "harness_rule", ("thread limit", "agent thread")),
    Hint(r"(?i)requires approval|permission to (use|run)", "permission"),
    Hint(r"(?i)operation not permitted|permission denied|eacces|eperm", "permission"),
    Hint(r"(?i)timed out after|timeout after|etimedout|deadline exceeded", "timeout"),
    Hint(r"exit 124\b", "timeout"),
    Hint(r"exit (12[89]|1[3-8][0-9]|19[01])\b", "environment"),
    Hint(r"(?i)\brg exit 2\b", "tool_misuse"),
    Hint(r"(?i)\bgit exit 2\b", "tool_misuse"),
    Hint(r"(?i)\bls exit 2\b", "tool_misuse"),
    Hint(r"(?i)\b[ef]?grep exit 2\b|\bpgrep exit 2\b", "tool_misuse"),
    Hint(r"(?i)found (#|\d+) errors?\.", "build"),
    Hint(r"(?i)syntax ?error", "build"),
    Hint(r"(?i)can't read|no such file or directory|does not exist|enoent", "tool_misuse"),
    Hint(r"(?i)inputvalidationerror|must be absolute", "tool_misuse"),
    Hint(r"^test_failure\|", "test"),
    Hint(r"^build_error\|", "build"),
    Hint(r"(?i)\.{8,}\s*failed\b", "build"),
)


def holds(c: Column, literal: str) -> Column:
    return F.lower(c).contains(literal) if literal == literal.lower() else c.contains(literal)


def is_injected(text: Column, prefixes: Sequence[str] = INJECTED_PREFIXES) -> Column:
    t = F.ltrim(text)
    out = F.lit(False)
    for p in prefixes:
        out = out | t.startswith(p)
    return F.coalesce(out, F.lit(False))


def first_literal(c: Column, literals: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(holds(c, x), x) for x in literals])


def output_literals(rules: Sequence[OutputRule] = OUTPUT_RULES) -> list[str]:
    """All literals of the rules, each once, in their order."""
    return list(dict.fromkeys(x for r in rules for x in r.literals))


def category(*, text: Column, output: Column, command: Column, tool: Column, exit_code: Column, is_error: Column, abort_reason: Column, expected: Column, rules: Sequence[OutputRule] = OUTPUT_RULES, held: Column | None = None) -> tuple[Column, Column]:
    """(category or null, rule sentence). ``expected``: whether the exit code is an answer of its program.

    ``held``: numbers of the literals of ``output_literals`` that the output holds,
    found in one pass; without it each literal is looked for by itself.
    """
    out, numbers = F.coalesce(output, F.lit("")), {x: n for n, x in enumerate(output_literals(rules))}
    has_command = F.coalesce(command, F.lit("")) != ""
    shell = F.lit(False)
    for name in SHELL_TOOLS:
        shell = shell | F.lower(F.coalesce(tool, F.lit(""))).contains(name)
    shell = has_command | shell
    steps: list[tuple[Column, str, Column]] = [
        (F.trim(F.coalesce(abort_reason, F.lit(""))) == "interrupted", "user_interrupt", F.lit("the turn was aborted by an interrupt")),
        (F.ltrim(F.coalesce(text, F.lit(""))).startswith("[Request interrupted by user"), "user_interrupt", F.lit("the message says that the user interrupted")),
    ]
    for r in rules:
        literal = first_literal(out, r.literals) if held is None else F.coalesce(*[F.when(F.array_contains(held, numbers[x]), x) for x in r.literals])
        met = literal.isNotNull()
        if r.shell_only:
            met = met & shell
        if r.commands:
            any_of = F.lit(False)
            for c in r.commands:
                any_of = any_of | F.lower(F.coalesce(command, F.lit(""))).contains(c)
            met = met & any_of
        steps.append((met, r.category, F.concat(F.lit("the output contains "), literal)))
        if r.exit_codes:
            steps.append((exit_code.isin(*r.exit_codes), r.category, F.concat(F.lit("exit code "), exit_code.cast("string"))))
    failed = F.coalesce(exit_code != 0, F.lit(False))
    code = F.concat(F.lit("exit code "), exit_code.cast("string"))
    steps += [
        (failed & (exit_code == 124), "timeout", code),
        (failed & F.coalesce(expected, F.lit(False)), "expected_exit", code),
        (failed, "nonzero_exit", code),
        (F.coalesce(is_error, F.lit(False)), "tool_error", F.lit("an error was recorded and no other rule met it")),
    ]
    names, why = F.lit(None).cast("string"), F.lit(None).cast("string")
    for met, name, sentence in reversed(steps):
        ok = F.coalesce(met, F.lit(False))
        names, why = F.when(ok, name).otherwise(names), F.when(ok, sentence).otherwise(why)
    return names, why


def hint_kind(signature: Column, hints: Sequence[Hint] = HINTS) -> Column:
    out = F.lit(None).cast("string")
    for h in reversed(hints):
        out = F.when(signature.rlike(h.pattern), h.kind).otherwise(out)
    return out


def hint_number(signature: Column, hints: Sequence[Hint] = HINTS) -> Column:
    """Place of the first matching rule in the list."""
    out = F.lit(None).cast("int")
    for i, h in reversed(list(enumerate(hints))):
        out = F.when(signature.rlike(h.pattern), i).otherwise(out)
    return out


def friction_kind(*, text: Column, abort_reason: Column, is_error: Column, exit_code: Column) -> Column:
    """user_interrupt, tool_error or null."""
    stopped = (F.trim(F.coalesce(abort_reason, F.lit(""))) == "interrupted") | F.ltrim(F.coalesce(text, F.lit(""))).startswith("[Request interrupted by user")
    failed = F.coalesce(is_error, F.lit(False)) | F.coalesce(exit_code != 0, F.lit(False))
    return F.when(stopped, "user_interrupt").when(failed, "tool_error")

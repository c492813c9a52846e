"""Text as column expressions: evidence lines, outcomes, titles, tags, files and line changes of tool calls, search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.literals import found
from tracewell.functions.rules import is_injected

#: Lines that a harness prints around a program's own output, the characters of dividers, and the words that name a failure.
WRAPPER_PREFIXES = ("chunk id:", "wall time", "process exited with code", "original token count:", "output:", "script failed", "script error:", "script completed", "total output lines:", "warning: truncated output")
DIVIDER = r"[=\-_*~#!+]"
FAILURE_WORDS = r"(?i)error|fail|fatal|cannot|denied|not found|exception|panic|refused|blocked|rejected|unable to"
TRACEBACK = "Traceback (most recent call last)"

#: Task tags and the words that tell them, in the languages met.
TASK_TAGS: dict[str, tuple[str, ...]] = {
    "analysis": ("了解", "分析", "梳理", "排查", "诊断", "审查", "review", "analy", "investigat", "why"),
    "implementation": ("实现", "开发", "修复", "构建", "重做", "实施", "implement", "develop", "fix", "build", "create", "add"),
    "verification": ("测试", "验证", "校验", "截图", "对比", "test", "verify", "check", "qa", "compare", "screenshot"),
    "ui": ("页面", "前端", "界面", "图标", "样式", "布局", "交互", "动画", "动效", "ui", "frontend", "visual", "design", "prototype"),
    "backend": ("后端", "接口", "服务", "daemon", "api", "backend", "server"),
    "data": ("数据库", "sqlite", "sql", "迁移", "schema", "database", "migration"),
    "documentation": ("文档", "规划", "方案", "规范", "说明", "docs", "document", "plan", "spec"),
    "refactor": ("重构", "清理", "refactor", "cleanup"),
    "research": ("研究", "调研", "查找", "research"),
}


def normalized_line(line: Column, *, most: int = 120) -> Column:
    """The stable half of a signature: no exit code in front, lower case, absolute paths cut to their last part, digits as ``#``, ``most`` characters."""
    x = F.regexp_replace(F.lower(F.trim(line)), r"^exit code:?\s*-?[0-9]+\s*[:.\-]?\s*", "")
    x = F.regexp_replace(x, r"\s+", " ")
    marks = "['\"`,;()\\[\\]{}<>]*"
    # Within marks, a path from a root or a drive; what stands before its last part goes.
    last = F.transform(F.split(x, " "), lambda w: F.regexp_replace(w, rf"^({marks})(?:[a-z]:)?[/\\].*[/\\]([^/\\'\"`,;()\[\]{{}}<>]+[/\\]*{marks})$", "$1$2"))
    last = F.transform(last, lambda w: F.regexp_replace(w, rf"^({marks})(?:[a-z]:)?[/\\]([^/\\]+)$", "$1$2"))
    return F.substring(F.trim(F.regexp_replace(F.array_join(last, " "), "[0-9]+", "#")), 1, most)


def content_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def is_divider(line: Column) -> Column:
    t = F.trim(line)
    return (F.length(t) >= 3) & (t.rlike(rf"^(?:{DIVIDER}| )++$") | t.rlike(rf"^({DIVIDER})\1\1.*({DIVIDER})\2\2$"))


def is_wrapper(line: Column) -> Column:
    low, out = F.lower(line), F.lit(False)
    for p in WRAPPER_PREFIXES:
        out = out | low.startswith(p)
    return out


def evidence_line(text: Column, literal: Column) -> Column:
    """The line with the matched literal (no divider), else the last line of a traceback, else the first that names a failure; null for none."""
    lines = content_lines(text)
    phrase = literal == F.lower(literal)
    has = lambda x: F.when(phrase, F.lower(x).contains(F.lower(literal))).otherwise(x.contains(literal))
    plain = F.filter(lines, lambda x: ~is_divider(x) & ~is_wrapper(x))
    told = F.get(F.filter(lines, lambda x: has(x) & ~is_divider(x)), F.lit(0))
    trace = F.when(text.contains(TRACEBACK), F.element_at(F.when(F.size(plain) > 0, plain), -1))
    named = F.get(F.filter(plain, lambda x: x.rlike(FAILURE_WORDS)), F.lit(0))
    return F.coalesce(F.when(F.coalesce(literal, F.lit("")) != "", told), trace, named)


def signature(category: Column, tool: Column, line: Column, *, program: Column, exit_code: Column) -> Column:
    """category, tool and normalised evidence, or what ran and how it ended where no line tells."""
    subject = F.lower(F.coalesce(F.nullif(F.trim(program), F.lit("")), F.nullif(F.trim(tool), F.lit(""))))
    ended = F.when(F.coalesce(exit_code != 0, F.lit(False)), F.concat_ws(" exit ", subject, exit_code.cast("string"))).otherwise(F.concat_ws(" ", subject, F.lit("tool_error")))
    return F.concat_ws("|", category, F.coalesce(tool, F.lit("")), F.coalesce(normalized_line(line), ended))


def outcome(output: Column, is_error: Column, exit_code: Column) -> tuple[Column, Column]:
    """(is_error, exit_code): recorded fields win, else status lines that a harness prints."""
    failed = F.when(output.contains("<tool_use_error>") | F.ltrim(output).startswith("Script failed"), True)
    code = F.coalesce(F.nullif(F.regexp_extract(output, r"(?im)^\s*exit\s+(?:code|status)\s*[:=]?\s*([0-9]+)\b", 1), F.lit("")), F.nullif(F.regexp_extract(output, r"\bProcess exited with code ([0-9]+)", 1), F.lit("")))
    return F.coalesce(is_error, failed), F.coalesce(exit_code, code.try_cast("int"))


def bounded(text: Column, most: int) -> tuple[Column, Column]:
    """(trimmed text cut to ``most`` characters with an ellipsis, whether it was cut)."""
    t = F.trim(text)
    cut = F.length(t) > most
    return F.when(cut, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t), F.coalesce(cut, F.lit(False))


def is_noise(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return (t == "") | is_injected(t) | t.contains("<INSTRUCTIONS>") | t.contains("<permissions instructions>")


def is_task_text(text: Column) -> Column:
    return ~is_noise(text) & (F.length(F.trim(text)) >= 2) & ~F.trim(text).startswith("# AGENTS.md instructions") & ~text.contains("AUTONOMY DIRECTIVE")


def is_transcript_role(role: Column) -> Column:
    return F.lower(F.trim(F.coalesce(role, F.lit("")))).isin("user", "assistant", "tool")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def task_tags(text: Column, cwd: Column | None = None, tags: Mapping[str, Sequence[str]] = TASK_TAGS) -> Column:
    """The tags of a task text in order, ``recorded-task`` if none is told, and its workspace; null for what is no task."""
    low = F.lower(text)
    told = []
    for tag, words in tags.items():
        any_of = F.lit(False)
        for w in words:
            any_of = any_of | low.contains(w)
        told.append(F.when(any_of, tag))
    found = F.array_compact(F.array(*told))
    found = F.when(F.size(found) == 0, F.array(F.lit("recorded-task"))).otherwise(found)
    if cwd is not None:
        place = slug(F.element_at(F.split(F.regexp_replace(cwd, "/+$", ""), "/"), -1))
        found = F.concat(found, F.array_compact(F.array(F.when(F.coalesce(place, F.lit("")) != "", F.concat(F.lit("workspace-"), place)))))
    return F.when(is_task_text(text), F.array_sort(found))


def shape_class(tags: Column) -> Column:
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")))
    return F.when(F.size(clean) > 0, F.array_join(clean, "|"))


def project_key(cwd: Column, *, marker: str = "/.claude/worktrees/") -> tuple[Column, Column]:
    """(project, worktree): a working directory below the marker belongs to the project before it."""
    t = F.nullif(F.trim(cwd), F.lit(""))
    at = F.instr(t, marker)
    name = F.split_part(F.substring(t, at + F.lit(len(marker)), F.length(t)), F.lit("/"), F.lit(1))
    folded = (at > 1) & (name != "")
    return F.when(folded, F.substring(t, F.lit(1), at - 1)).otherwise(t), F.when(folded, name)


def project_label(key: Column) -> Column:
    return F.element_at(F.filter(F.split(key, "/"), lambda x: x != ""), -1)


def references(text: Column) -> Column:
    """Declared references, one a line: ``reference: command|path|tool value``."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    rx = r"(?i)^\s*[-*]?\s*reference:\s*(command|path|tool)\s+(\S.*?)\s*$"
    return F.transform(F.filter(lines, lambda x: x.rlike(rx)), lambda x: F.struct(F.lower(F.regexp_extract(x, rx, 1)).alias("kind"), F.regexp_extract(x, rx, 2).alias("value")))


def user_shell_command(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(F.trim(text), r"(?s)^<bash-input>(.*?)(?:</bash-input>.*)?$", 1)), F.lit(""))


def display_title(title: Column, task: Column, first_text: Column) -> tuple[Column, Column]:
    """(title, its origin): ai, task, synthesized from a wrapped block's summary or first line, or none."""
    summary = F.nullif(F.regexp_extract(first_text, r'summary="([^"]*)"', 1), F.lit(""))
    inner = F.nullif(F.trim(F.regexp_extract(first_text, r"(?s)^\s*<[^>]*>\s*([^\n<]+)", 1)), F.lit(""))
    made = F.substring(F.coalesce(summary, inner), 1, 120)
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    origin = F.when(filled(title).isNotNull(), "ai").when(filled(task).isNotNull(), "task").when(made.isNotNull(), "synthesized").otherwise("none")
    return F.coalesce(filled(title), filled(task), made), origin


def patch_files(text: Column) -> Column:
    """Files of a patch: update is an edit, add is a write, delete is a delete."""
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^\*\*\* ((?:Update|Add|Delete) File: .+)$"), F.lit(1))
    action = lambda h: F.when(h.startswith("Update"), "edit").when(h.startswith("Add"), "write").otherwise("delete")
    return F.transform(heads, lambda h: F.struct(F.trim(F.substring_index(h, "File:", -1)).alias("path"), action(h).alias("action")))


def absolute(path: Column, cwd: Column) -> Column:
    return F.when(path.startswith("/") | F.coalesce(cwd, F.lit("")).eqNullSafe(""), path).otherwise(F.concat_ws("/", F.rtrim(cwd, F.lit("/")), path))


def patch_lines(text: Column) -> tuple[Column, Column]:
    """(lines added, lines removed) of a patch; escaped line ends count."""
    lines = F.split(F.replace(text, F.lit("\\n"), F.lit("\n")), "\n")
    added = F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++")))
    return added, F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---") & ~x.startswith("*** ")))


def keywords_in(text: Column, keywords: Sequence[str]) -> Column:
    """Those of ``keywords`` that a text holds in any case, in their order."""
    held = found(text, [k.lower() for k in keywords])
    return F.when(text.isNotNull(), F.transform(held, lambda n: F.get(F.array(*map(F.lit, keywords)), n)))

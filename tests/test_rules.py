import pytest
from pyspark.sql import functions as F

from tracewell.functions import rules, shell, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("command", "program"),
    [
        ("cd /x && FOO=1 sudo /usr/bin/git status --short | head -3", "git"), ("rg -n 'a && b' src", "rg"), ("", ""), (None, ""), ("echo hi; make", "make"), ("R=$(curl -s u)", "curl"), ("\\ls -l", "ls"),
        ("# only words", ""), ("A=b", ""), ('"quoted tool" x', "quoted"), ("timeout 30 pytest -q", "timeout"),
        # Words that run nothing: the line goes on, or names no program at all.
        ("cd /tmp", ""), ("false; :", ""), ("trap x EXIT\nulimit -n 9\nmake", "make"), ("test -d a && make b", "make"), ("[ -d a ] || mkdir a", "mkdir"), ("type node && node x.js", "node"), ("case $x in\na) jq . ;;\nesac", "a)"),
        ("for x in git make; do curl $x; done", "curl"), ("until false; do nice -n 5 x; done", "nice"), ("if ! grep a b; then rm b; fi", "grep"), ("builtin cd /x; exec /opt/a/run --now", "run"),
        # echo and env stand only for a line that runs nothing else.
        ("echo one", "echo"), ("env", "env"), ("env A=1", "env"), ("env | sort", "sort"), ("env A=1 /opt/b/tool -x", "tool"), ("echo a; env", "echo"), ("env; echo a", "env"), ("echo git", "echo"),
        # Comments, escapes, substitutions, paths and quotes.
        ("make # then rm", "make"), ("A=1 \\\n nohup /v/bin/py run.py", "py"), ("D=`date +%s` && tar cf $D", "date"), ("X=$() ; ls", "ls"), ("/ ; ls", "ls"), ("/usr/bin/", "bin"), ("(cd a; make x)", "make"),
        ("sed 's;a;b;' f", "sed"), ("awk 'open ; | && to the end", "awk"), ("-n x", "x"),
    ],
)
def test_program_of(command, program):
    assert shell.program_of(command) == program


@pytest.mark.parametrize(
    ("command", "got"),
    [
        ("a; b && c | d", ["b", "d"]), ("cd x && grep y z", ["grep"]), ("python -m pytest -q", ["pytest"]), ("uv run mypy .", ["mypy"]), ("X=1 env rg a", ["rg"]), ("", []), (None, []), (" ;\n", []), ("a\nb;", ["b"]), ("a || a", ["a"]),
        ("ls | true", []), ("ls | A=1", ["ls"]), ("timeout --kill-after=5 30s /usr/bin/rg x", ["rg"]), ("timeout", []), ("python3 -u -m mypy.api x", ["mypy.api"]), ("python x.py -m y", ["python"]), ("python -m", ["python"]), ("/v/bin/py -m 'black' .", ["black"]),
        ("poetry install", ["poetry"]), ("uv", ["uv"]), ("hatch run python -m pytest", ["pytest"]), ("sudo -E time nohup make", ["make"]), ("({ make", ["make"]), ("a & b", ["a"]), ("/ && .", []), ("'rg' a", ["rg"]),
    ],
)
def test_exit_candidates(command, got):
    assert shell.exit_candidates(command) == got


@pytest.mark.parametrize(
    ("command", "code", "meaning"),
    [
        ("grep a b", 1, ("no match", False)), ("grep a b && ls", 1, None), ("grep a b || rg c", 1, ("no match", False)), ("any", 124, ("timeout", True)), ("grep a b", 2, None), ("diff a b && grep c", 1, None), (None, 130, ("SIGINT", True)), (None, 1, None),
        ("/ci/python -m pytest x", 5, ("no tests collected", False)), ("[ -e x ]", 1, ("condition not met", False)), ("cd a && cmp b c", 1, ("differs", False)), ("ag a\nls b", 1, None), ("pgrep x || true", 1, ("no process", False)), ("grep a b", 0, None),
    ],
)
def test_exit_meaning(command, code, meaning):
    assert shell.exit_meaning(command, code) == meaning


def test_pieces_keep_every_character():
    for command in ("a && b; 'c ; d' | e", "x &&& y", "||| z", "`a;b`c\n\"d", "", ";;"):
        cut = shell.pieces(command, shell.STATEMENTS)
        rest = command
        for piece in cut[:-1]:
            assert rest.startswith(piece)
            rest = rest[len(piece) :]
            rest = rest[2:] if rest[:2] in ("&&", "||") else rest[1:]
        assert rest == cut[-1]


@pytest.mark.parametrize(("command", "name"), [("which jq", "jq"), ("which jq; ls", None), ("which -a jq", None), ("/usr/bin/which 'rg'", "rg"), ("which a b", None), (None, None)])
def test_probed_command(command, name):
    assert shell.probed_command(command) == name


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Exit code 2: Bad /usr/local/lib/x.py:12", "bad x.py:#"), ("  A\t B  ", "a b"), ("see '/a/b/c.txt', now", "see 'c.txt', now"), ("C:\\a\\b.txt gone", "b.txt gone"), ("plain 42 words", "plain # words"),
        ("/root", "root"), ("a/b/c stays", "a/b/c stays"), ("x" * 200, "x" * 120),
    ],
)
def test_normalized_line(spark, line, want):
    assert one(spark, text.normalized_line(F.lit(line))) == want


def test_evidence_line(spark):
    pick = lambda t, lit: one(spark, text.evidence_line(F.lit(t), F.lit(lit)))
    assert pick("Chunk ID: 1\n=== FAILURES ===\nFAILED tests/x.py\nend", "FAIL") == "FAILED tests/x.py"
    assert pick("x\nTraceback (most recent call last)\n  File a\nValueError: no", "") == "ValueError: no"
    assert pick("fine\nfatal: not a repo\nend", "") == "fatal: not a repo"
    assert pick("fine\nall good", "") is None


def test_categories(spark):
    def name(**given):
        base = {"text": "", "output": "", "command": "", "tool": "bash", "exit_code": None, "is_error": None, "abort_reason": None, "expected": None} | given
        types = {"exit_code": "int", "is_error": "boolean", "expected": "boolean"}
        return one(spark, rules.category(**{k: F.lit(v).cast(types.get(k, "string")) for k, v in base.items()})[0])

    assert name(abort_reason="interrupted", output="ENOENT") == "user_interrupt"
    assert name(text="[Request interrupted by user]") == "user_interrupt"
    assert name(output="Permission Denied") == "permission_denied"
    assert name(output="enoent") is None and name(output="ENOENT") == "file_not_found"
    assert name(exit_code=127) == "command_not_found"
    assert name(output="3 failed", command="pytest -q") == "test_failure" and name(output="3 failed") is None
    assert name(exit_code=1, expected=True) == "expected_exit" and name(exit_code=1) == "nonzero_exit"
    assert name(exit_code=124) == "timeout" and name(is_error=True) == "tool_error" and name(exit_code=0) is None


def test_text_pieces(spark):
    assert one(spark, text.user_shell_command(F.lit(" <bash-input> ls -l </bash-input> rest"))) == "ls -l"
    assert one(spark, F.struct(*[c.alias(n) for n, c in zip("ab", text.project_key(F.lit("/p/x/.claude/worktrees/w1/src")), strict=True)])).asDict() == {"a": "/p/x", "b": "w1"}
    assert one(spark, text.task_tags(F.lit("Fix the API tests"), F.lit("/a/My Repo/"))) == ["backend", "implementation", "verification", "workspace-my-repo"]
    assert one(spark, text.task_tags(F.lit("<system-reminder> x"))) is None
    patch = "*** Begin Patch\n*** Update File: a.go\n-old\n+new\n+more\n*** Add File: b.md\n+hi\n*** Delete File: c\n"
    assert [tuple(r) for r in one(spark, text.patch_files(F.lit(patch)))] == [("a.go", "edit"), ("b.md", "write"), ("c", "delete")]
    assert tuple(one(spark, F.struct(*[c.alias(n) for n, c in zip("ab", text.patch_lines(F.lit(patch)), strict=True)]))) == (3, 1)
    assert tuple(one(spark, F.struct(*[c.alias(n) for n, c in zip("ab", text.display_title(F.lit(None).cast("string"), F.lit(" "), F.lit('<teammate-message summary="do it">x')), strict=True)]))) == ("do it", "synthesized")


def test_hints(spark):
    kind = lambda s: one(spark, rules.hint_kind(F.lit(s)))
    assert kind("user_interrupt|x|command not found") == "user_stopped"
    assert kind("nonzero_exit|bash|rg exit 2") == "tool_misuse" and kind("x|y|exit 137") == "environment" and kind("a|b|c") is None


def test_long_texts_do_not_deepen_the_stack(spark):
    from tracewell.operators import calls

    long = "a b\\" + "n" + "x" * 500_000
    assert one(spark, F.length(F.get(calls.commands_of(F.lit(f'cmd: "{long}" rest')), 0))) == len(long) - 1
    assert one(spark, F.size(calls.commands_of(F.lit(f'cmd: "{long}')))) == 0
    assert one(spark, text.is_divider(F.lit("=- " * 100_000 + "="))) and not one(spark, text.is_divider(F.lit("= " * 100_000 + "a")))

"""Hooks named by messages, and what transitions and watches notify of."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import assets, mentions


@pytest.mark.parametrize(
    ("path", "clean"),
    [("/a//b/./c/", "/a/b/c"), ("/a/../b", "/b"), ("/../a", "/a"), ("a/../../b", "../b"), ("../../a", "../../a"), ("./a", "a"), ("a/..", "."), ("/", "/"), ("", "."), ("/a/b/../../..", "/")],
)
def test_clean_path(spark, path, clean):
    assert spark.range(1).select(mentions.clean_path(F.lit(path)).alias("x")).first().x == clean


@pytest.mark.parametrize(
    ("text", "got"),
    [
        ("blocked by '/u/h/guard.sh': no", ["/u/h/guard.sh"]), ("[Check.PY], then check.py and check.py.", ["Check.PY", "check.py"]), ("see /u/h/./x.json。 a.txt b.md", ["/u/h/x.json"]), ("py .sh x.shx sh.", ["sh"][:0]), ("", []),
        ("a `b/../c.ts`; (d.bash)", ["c.ts", "d.bash"]), ("guard.sh\n/u/guard.sh", ["guard.sh", "/u/guard.sh"]),
    ],
)
def test_hook_references(spark, text, got):
    assert spark.range(1).select(mentions.hook_references(F.lit(text)).alias("x")).first().x == got


def test_hook_links(spark):
    hooks = spark.createDataFrame([("h1", "/u/hooks/guard.sh", None), ("h2", "/u/hooks//check.py", None), ("h3", "/v/hooks/guard.js", None), ("h4", None, "hook:Lint"), ("h5", "", None), ("h6", "/u/hooks/check.py", "x:y")], "asset_id string, path string, name string")
    rows = [(1, "by check.py or /u/hooks/guard.sh"), (2, "by /x/../u/hooks/check.py"), (3, "guard.sh says no"), (4, "see lint.zsh"), (5, None), (6, "nothing"), (7, "/else/LINT.sh, /v/hooks/guard.js"), (7, "lint.py")]
    got = mentions.hook_links(spark.createDataFrame(rows, "id int, text string"), hooks, text="text", key="id")
    assert sorted(map(tuple, got.collect())) == [(1, "h1", "/u/hooks/guard.sh", "path"), (2, "h2", "/u/hooks/check.py", "path"), (4, "h4", "lint.zsh", "name"), (7, "h3", "/v/hooks/guard.js", "path")]
    assert mentions.hook_links(spark.createDataFrame([], "id int, text string"), hooks.drop("name"), text="text", key="id").count() == 0


def test_notices(spark):
    rows = [
        ("awaiting_resurrection", "healthy", False, True, "verification_passed"), ("awaiting_resurrection", "silent", False, True, "verification_failed"), ("healthy", "silent", False, False, "silent"), ("healthy", "silent", True, False, "broken"),
        ("healthy", "bypassed", None, None, "bypassed"), (None, "broken", True, False, "broken"), ("silent", "healthy", False, False, None), (None, "silent", False, False, "silent"), ("healthy", "degraded", False, False, None), ("awaiting_resurrection", "silent", True, True, "verification_failed"),
    ]
    moves = spark.createDataFrame([(i, *r[:4], i) for i, r in enumerate(rows)], "id int, from_state string, to_state string, overlay boolean, resurrection boolean, occurred_at int")
    verdicts = spark.createDataFrame([(100, "verified", 50), (101, "no_change", 51), (102, "unobservable", 52), (103, "watching", 53), (104, "verified", None)], "watch_id int, status string, at int")
    got = assets.notifications(moves, spark.createDataFrame([(2,)], "id int"), verdicts).collect()
    assert [r.id for r in got] == [102, 101, 100, 9, 7, 5, 4, 3, 1, 0]
    assert {r.id: r.kind for r in got if r.id < 100} == {i: r[4] for i, r in enumerate(rows) if r[4] and i != 2}
    assert [(r.kind, r.severity) for r in got[:3]] == [("watch_unobservable", "muted"), ("watch_no_change", "warn"), ("watch_verified", "good")]
    assert {r.severity for r in got if r.kind == "verification_passed"} == {"positive"} and {r.severity for r in got if r.kind in ("broken", "silent")} == {"attention"}

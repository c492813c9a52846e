import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewell.operators.ordered import turn_costs
from tracewell.operators.sets import upsert_events
from tracewell.sources import transcripts as T
from tracewell.streaming import jobs


def write(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def nested(session, n, **more):
    at = lambda s: f"2026-01-01T10:00:{s:02d}Z"
    return [
        {"type": "user", "sessionId": session, "uuid": "u1", "timestamp": at(0), "cwd": "/p", "version": "1", "message": {"role": "user", "content": "do the thing"}, **more},
        {"type": "assistant", "sessionId": session, "uuid": "a1", "timestamp": at(5), "message": {"id": "m1", "role": "assistant", "model": "x", "content": [{"type": "text", "text": "on it"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}]}, **more},
        {"type": "user", "sessionId": session, "uuid": "u2", "timestamp": at(9), "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": f"out {n}\nExit code: 3"}]}]}, **more},
        {"type": "user", "sessionId": session, "uuid": "u3", "timestamp": at(10), "message": {"role": "user", "content": "<system-reminder> no message"}, **more},
    ]


def test_nested_messages(spark, tmp_path):
    write(tmp_path / "p/s1.jsonl", nested("s1", 1))
    write(tmp_path / "p/s1/subagents/agent-q7.jsonl", nested("s1", 2, isSidechain=True, agentId="q7"))
    write(tmp_path / "p/bad.jsonl", [*nested("s2", 1)[:1], "{broken", *nested("s2", 1)[1:]])
    sessions, events = T.parse("nested", T.lines(spark, [str(tmp_path)]))
    s = {r["session_id"]: r for r in sessions.collect()}
    assert (s["agent-q7"]["parent_session_id"], s["agent-q7"]["thread_kind"], s["s1"]["thread_kind"], s["s1"]["model"], s["s1"]["cwd"]) == ("s1", "subagent", "main", "x", "/p")
    got = [(r["event_type"], r["source_event_id"], r["tool_name"], r["exit_code"]) for r in events.filter("session_id = 's1'").orderBy("line_no", "block_no").collect()]
    assert got == [("transcript_message", "u1-0", None, None), ("transcript_message", "a1-0", None, None), ("transcript_tool_call", "a1-1", "Bash", None), ("transcript_tool_result", "u2-0", None, 3)]
    assert events.filter("session_id = 's2'").count() == 1


def test_typed_records(spark, tmp_path):
    meta = {"timestamp": "2026-01-01T10:00:00Z", "type": "session_meta", "payload": {"id": "c1", "cwd": "/p", "cli_version": "9"}}
    item = lambda s, **p: {"timestamp": f"2026-01-01T10:00:{s:02d}Z", "type": "response_item", "payload": p}
    tokens = lambda s, n: {"timestamp": f"2026-01-01T10:00:{s:02d}Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"total_tokens": n}}}}
    records = [
        meta, {"timestamp": "2026-01-01T10:00:01Z", "type": "turn_context", "payload": {"model": "m"}}, item(2, type="message", role="user", content=[{"type": "input_text", "text": "first turn"}]), tokens(3, 1000), tokens(4, 2200),
        item(5, type="function_call", id="f1", name="exec", call_id="k1", arguments='{"cmd": "ls"}'), item(6, type="function_call_output", call_id="k1", output="Process exited with code 127"), item(7, type="function_call_output", call_id="k2", output=""),
        {"timestamp": "2026-01-01T10:00:08Z", "type": "event_msg", "payload": {"type": "turn_aborted", "reason": "interrupted"}},
    ]
    write(tmp_path / "c1.jsonl", records)
    lines = T.lines(spark, [str(tmp_path)])
    sessions, events = T.parse("typed", lines)
    [s] = sessions.collect()
    assert (s["session_id"], s["model"], s["running_total"], s["version"]) == ("c1", "m", 2200, "9")
    got = [(r["event_type"], r["role"], r["call_id"], r["exit_code"], r["abort_reason"]) for r in events.orderBy("line_no").collect()]
    assert got == [
        ("transcript_message", "user", None, None, None), ("transcript_tool_call", "assistant", "k1", None, None), ("transcript_tool_result", "tool", "k1", 127, None),
        ("transcript_tool_result", "tool", "k2", None, None), ("transcript_message", "system", None, None, "interrupted"),
    ]
    assert [r["session_id"] for r in T.headers(lines).collect()] == ["c1"]
    assert T.within_project(lines, "/p").count() == 9 and T.within_project(lines, "/other").count() == 0


def test_event_log(spark, tmp_path):
    at = 1_767_261_600_000
    write(
        tmp_path / "d1/log.jsonl",
        [
            {"type": "session", "id": "d1", "cwd": "/p", "time0": at, "delegationDepth": 1}, {"type": "session/title", "time": at + 1, "data": {"title": "T"}},
            {"type": "user/message", "time": at + 2, "seq": 4, "data": {"content": [{"type": "text", "text": "hello there"}]}},
            {"type": "assistant/message", "time": at + 3, "data": {"message": {"id": "m", "content": [{"type": "text", "text": "yes"}, {"type": "reasoning", "text": "hm"}]}, "usage": {"inputTokens": 5, "outputTokens": 0}}},
            {"type": "tool/call", "time": at + 4, "data": {"callId": "k", "name": "sh", "arguments": "{}"}},
            {"type": "tool/result", "time": at + 5, "data": {"error": None, "message": {"source": {"callId": "k"}, "content": [{"isError": True, "content": [{"type": "text", "text": "bad"}]}]}}},
            {"type": "turn/end", "time": at + 6, "data": {"reason": {"kind": "completed"}}}, {"type": "turn/end", "time": at + 7, "data": {"reason": {"kind": "aborted"}}},
        ],
    )
    sessions, events = T.parse("log", T.lines(spark, [str(tmp_path)]))
    [s] = sessions.collect()
    assert (s["session_id"], s["title"], s["thread_kind"], s["input_tokens"], s["output_tokens"], s["assistant_turns"], s["cwd"]) == ("d1", "T", "subagent", 5, None, 1, "/p")
    assert [(r["event_type"][11:], r["source_event_id"], r["is_error"], r["abort_reason"]) for r in events.orderBy("line_no").collect()] == [("message", "seq-4", None, None), ("message", "m", None, None), ("tool_call", "k", None, None), ("tool_result", "k", True, None), ("message", "line-8", None, "aborted")]


def test_relational_export(spark):
    s = spark.createDataFrame([("s", None, "/p", "New session - 1", "1", "m", 5, 0, 0, 2, 0, 0.5, None, None, 3, 1000, 9000)], "id string, parent_id string, directory string, title string, version string, model string, tokens_input long, tokens_output long, tokens_reasoning long, tokens_cache_read long, tokens_cache_write long, cost double, summary_additions long, summary_deletions long, summary_files long, time_created long, time_updated long")
    m = spark.createDataFrame([("m1", "s", 1000, '{"role":"user"}'), ("m2", "s", 2000, '{"role":"assistant"}')], "id string, session_id string, time_created long, data string")
    tool = lambda **state: json.dumps({"type": "tool", "tool": "bash", "callID": "k", "state": state})
    p = spark.createDataFrame([("p1", "m1", 1000, '{"type":"text","text":"please do"}'), ("p2", "m2", 2000, tool(status="error", input={"command": "x"}, error="boom", metadata={"exit": 2})), ("p3", "m2", 2001, tool(status="running", input={}))], "id string, message_id string, time_created long, data string")
    sessions, events = T.relational(s, m, p)
    [r] = sessions.collect()
    assert (r["title"], r["input_tokens"], r["output_tokens"], r["files_changed"], r["lines_added"]) == (None, 5, None, 3, None)
    got = sorted((r["source_event_id"], r["event_type"], r["is_error"], r["exit_code"], r["tool_output"]) for r in events.collect())
    assert got == [("p1", "transcript_message", None, None, None), ("p2", "transcript_tool_call", None, None, None), ("p2", "transcript_tool_result", True, 2, "boom"), ("p3", "transcript_tool_call", None, None, None)]


def test_envelopes_keep_omissions(spark):
    doc = {"session": {"id": "e1", "started_at": "2026-01-01T10:00:00Z"}, "turns": [{"id": "t1", "role": "user", "text": "hi"}, {"role": "tool", "tool_output": "exit code 4", "call_id": "k"}]}
    sessions, events = T.envelopes(spark.createDataFrame([(json.dumps(doc),)], "raw string"))
    assert sessions.first()["model"] is None
    assert [(r["source_event_id"], r["event_type"], r["exit_code"]) for r in events.orderBy("block_no").collect()] == [("t1:message", "transcript_message", None), ("1:tool_result", "transcript_tool_result", 4)]


def test_manifest_and_validation(spark, tmp_path):
    write(tmp_path / "a/x.jsonl", nested("s1", 1))
    write(tmp_path / "b/x.jsonl", nested("s1", 1))
    listed = T.listing(spark, [str(tmp_path)])
    assert T.once(listed).count() == 1 and T.unseen(listed, listed).count() == 0 and T.unseen(listed, listed.limit(0)).count() == 2
    gone = listed.withColumns({"path": F.concat("path", F.lit(".old")), "session_id": F.lit("z")})
    assert tuple(T.rescued(gone, listed).first()) == (2, 1)
    _, events = T.parse("nested", T.lines(spark, [str(tmp_path / "a")]))
    good, bad = T.valid(events.unionByName(events.limit(1).withColumns({"session_id": F.lit("s9"), "event_type": F.lit("odd")})))
    assert good.count() == 4 and bad.count() == 1


def test_unseen_judges_each_row(spark):
    shape = "path string, size int, mtime long"
    listed = spark.createDataFrame([("a", 1, 5), ("a", 1, 6), ("a", 2, 6), ("b", 1, 5), ("b", 1, 5), (None, 1, 5), (None, 1, 7), ("c", None, 5), ("d", 1, None)], shape)
    manifest = spark.createDataFrame([("a", 1, 6), (None, 1, 5), ("c", None, 5), ("d", 1, None), ("e", 1, 5)], shape)
    got = [tuple(r) for r in T.unseen(listed, manifest).collect()]
    assert sorted(got, key=str) == sorted([("a", 1, 5), ("a", 2, 6), ("b", 1, 5), ("b", 1, 5), (None, 1, 7), ("c", None, 5), ("d", 1, None)], key=str)
    assert T.unseen(listed, listed).count() == 2


def test_turn_costs(spark):
    rows = spark.createDataFrame([("s", 1, "u", None), ("s", 2, "t", 1000), ("s", 3, "t", 2200), ("s", 4, "u", None), ("s", 5, "t", 3400), ("s", 6, "u", None), ("s", 7, "t", 5200), ("q", 1, "u", None)], "sid string, line int, kind string, total int")
    got = turn_costs(rows, by=["sid"], order="line", opens=F.col("kind") == "u", total="total").orderBy("sid", "turn").collect()
    assert [(r["sid"], r["turn_tokens"]) for r in got] == [("q", None), ("s", 2200), ("s", 1200), ("s", 1800)]


def test_streamed_ingest_equals_one_batch_and_may_be_replayed(spark, tmp_path):
    store = jobs.Store(spark, f"file://{tmp_path}/tables", parts=4)
    load = store.load
    run = lambda check: jobs.ingest(spark, "nested", f"{tmp_path}/in", store=store, checkpoint=f"{tmp_path}/{check}").awaitTermination(120)
    write(tmp_path / "in/s1.jsonl", nested("s1", 1)[:2])
    run("c")
    write(tmp_path / "in/s1b.jsonl", nested("s1", 1))
    write(tmp_path / "in/s2.jsonl", nested("s2", 1))
    run("c")
    first = sorted(map(tuple, load("events").drop("line_no").collect()), key=str)
    run("again")  # a new checkpoint reads everything once more
    assert sorted(map(tuple, load("events").drop("line_no").collect()), key=str) == first and len(first) == 8
    whole = T.parse("nested", T.lines(spark, [f"{tmp_path}/in/s1b.jsonl", f"{tmp_path}/in/s2.jsonl"]))[1]
    assert sorted(map(tuple, whole.drop("line_no").collect()), key=str) == first
    assert upsert_events(whole, whole).count() == 8
    assert {r["session_id"]: r["ended_at"].second for r in load("sessions").collect()} == {"s1": 10, "s2": 10}


KILLED = """
import os, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from tracewell.streaming import jobs
folder = sys.argv[2]
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.local.dir", folder).config("spark.sql.session.timeZone", "UTC").getOrCreate()
store = jobs.Store(spark, f"file://{folder}/tables", parts=4)
if sys.argv[3] == "before":
    store._swap = lambda listed: os._exit(9)  # the driver is lost between write and swap
else:
    store._clear = lambda: os._exit(9)  # and between swap and commit of the batch
jobs.ingest(spark, "nested", f"{folder}/in", store=store, checkpoint=f"{folder}/c").awaitTermination(120)
"""


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_driver_lost_in_a_batch_loses_no_rows(spark, tmp_path, when):
    store = jobs.Store(spark, f"file://{tmp_path}/tables", parts=4)
    run = lambda: jobs.ingest(spark, "nested", f"{tmp_path}/in", store=store, checkpoint=f"{tmp_path}/c").awaitTermination(120)
    told = lambda: sorted(map(tuple, store.load("events").drop("line_no").collect()), key=str)
    write(tmp_path / "in/s1.jsonl", nested("s1", 1))
    write(tmp_path / "in/s3.jsonl", nested("s3", 1))
    run()
    first = told()
    write(tmp_path / "in/s1b.jsonl", nested("s1", 7))
    write(tmp_path / "in/s2.jsonl", nested("s2", 2))
    script = tmp_path / "killed.py"
    script.write_text(KILLED)
    root = str(Path(__file__).resolve().parents[1])
    assert subprocess.run([sys.executable, str(script), root, str(tmp_path), when], timeout=300, capture_output=True).returncode == 9
    both = T.parse("nested", T.lines(spark, [f"{tmp_path}/in/{n}.jsonl" for n in ("s1b", "s2", "s3")]))[1]
    want = sorted(map(tuple, both.drop("line_no").collect()), key=str)
    assert told() == (first if when == "before" else want)
    run()
    assert told() == want
    # What no list names has been cleared, and the folders in force hold all rows.
    held = {f for n in store._numbers() for each in store._listed(n).values() for f in each.values()}
    there = {str(p.relative_to(tmp_path / "tables")) for p in (tmp_path / "tables").glob("*/*/_part=*")}
    assert there == held and len(store._numbers()) <= jobs.KEPT


def test_two_writers_of_one_list(spark, tmp_path):
    store = jobs.Store(spark, f"file://{tmp_path}/tables", parts=2)
    rows = spark.createDataFrame([("a", 1)], "session_id string, n int")
    store.save({"events": rows})
    numbers, store._numbers = store._numbers(), lambda: []
    assert numbers == [1]
    with pytest.raises(Exception, match="another writer|exists"):
        store._swap({})
    del store._numbers
    assert store.load("events").collect() == rows.select("session_id", "n").collect() and store.load("other") is None

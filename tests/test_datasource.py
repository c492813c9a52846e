"""Transcripts as a data source: blocks, odd files, growth, and the rows of the registered parsers."""

import json
import os

import pytest

from tests.test_transcripts import nested, write
from tracewell.sources import datasource as D
from tracewell.sources import transcripts as T
from tracewell.streaming import jobs


def block_lines(path, step):
    size = os.path.getsize(path)
    return [x for at in range(0, size, step) for x in D.lines_of(D.Block(str(path), at, min(at + step, size), size))]


@pytest.mark.parametrize("text", ["", "\n", "one", "one\n", "a\n\nbb\nccc", "a\n\n\n", "é\n" * 50 + "last", "x" * 300 + "\n" + "y\n" * 40])
@pytest.mark.parametrize("step", [1, 2, 3, 7, 64, 1000])
def test_each_line_is_read_by_one_block(tmp_path, text, step, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 5)
    f = tmp_path / "f.jsonl"
    f.write_bytes(text.encode())
    want, at = [], 0
    for line in text.encode().split(b"\n")[: None if not text.endswith("\n") else -1]:
        want.append((at, line))
        at += len(line) + 1
    assert block_lines(f, step) == (want if text else [])


def told(df, *drop):
    return sorted(map(tuple, df.drop(*drop).collect()), key=str)


def test_batch_gives_the_rows_of_the_parser(spark, tmp_path):
    for k in range(4):
        write(tmp_path / f"p/s{k}.jsonl", nested(f"s{k}", k) * 10)
    write(tmp_path / "p/bad.jsonl", [*nested("s9", 1)[:1], "{broken", *nested("s9", 1)[1:]])
    (tmp_path / "p/empty.jsonl").write_text("")
    (tmp_path / "p/other.txt").write_text("{}")
    sessions, events = D.parsed(spark, "nested", f"file://{tmp_path}", blockBytes="700")
    want = T.parse("nested", T.lines(spark, [str(tmp_path)]))
    assert told(sessions) == told(want[0]) and told(events) == told(want[1])
    lines = spark.read.format("transcripts").options(path=str(tmp_path), blockBytes="700").load()
    assert lines.rdd.getNumPartitions() > 20
    assert lines.count() == 4 * 40 + 5


def test_registered_source_by_its_name(spark, tmp_path):
    T.register("counted", lambda lines: (lines.select("path").distinct(), lines.selectExpr("path", "line_no", "get_json_object(raw, '$.n') as n")))
    write(tmp_path / "a.jsonl", [{"n": k} for k in range(30)])
    assert sorted((r["line_no"], r["n"]) for r in D.parsed(spark, "counted", str(tmp_path), blockBytes="50")[1].collect()) == [(k + 1, str(k)) for k in range(30)]


def test_stream_follows_files_that_grow(spark, tmp_path):
    store = jobs.Store(spark, f"file://{tmp_path}/tables", parts=2)
    run = lambda: jobs.ingest(spark, "nested", f"{tmp_path}/in", store=store, checkpoint=f"{tmp_path}/c", follow=True).awaitTermination(120)
    records = nested("s1", 1)
    write(tmp_path / "in/s1.jsonl", records[:2])
    (tmp_path / "in/s1.jsonl").open("a").write(json.dumps(records[2])[:40])  # a line under way
    run()
    assert len(told(store.load("events"))) == 3
    write(tmp_path / "in/s1.jsonl", records)
    write(tmp_path / "in/s2.jsonl", nested("s2", 2))
    run()
    want = T.parse("nested", T.lines(spark, [f"{tmp_path}/in"]))[1]
    assert told(store.load("events")) == told(want)
    before = store._numbers()[-1]
    run()  # nothing has changed
    assert store._numbers()[-1] == before

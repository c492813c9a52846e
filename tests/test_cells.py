"""Partial aggregates: cells merge to what a full pass gives, and the ingest keeps them true after late data."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.test_transcripts import nested, write
from tracewell.operators import cells as C
from tracewell.operators import sessions as S
from tracewell.operators import stats
from tracewell.streaming import jobs


def told(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


def activity(spark):
    rng = random.Random(1)
    rows = []
    for i in range(2000):
        s = rng.randrange(40)
        rows.append((f"s{s}" if s else None, f"h{s % 3}", f"p{s % 5}" if s % 5 else None, "main" if s % 4 else "subagent", None if rng.random() < 0.02 else datetime(2026, 1, 1) + timedelta(hours=rng.randrange(900)), rng.choice(["a", "b", "error"]), None if rng.random() < 0.5 else rng.randrange(9)))
    return spark.createDataFrame(rows, "session_id string, source string, project_key string, thread_kind string, ts timestamp, event_type string, v int")


BY = ["session_id", "source", "project_key", "thread_kind"]


def test_cells_by_day_add_up_to_cells_by_session(spark):
    events = activity(spark)
    given = {"at": "ts", "counts": {"n_a": F.col("event_type") == "a", "n_error": F.col("event_type") == "error"}, "sums": {"v": F.col("v")}}
    daily = C.cells(events, by=BY, **given)
    assert daily.count() > 500
    assert told(C.merged(daily, by=BY)) == told(C.cells(events, by=BY, daily=False, **given))
    assert C.cells(events.limit(0), by=BY, **given).count() == 0


def test_reports_of_cells_equal_those_of_events(spark):
    events = activity(spark)
    friction = events.filter("event_type = 'error'").withColumn("kind", F.lit("tool_error"))
    sessions = events.groupBy(*BY).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    start, end = datetime(2026, 1, 20), datetime(2026, 2, 8)
    windows = C.windows(start, end)
    is_error = F.col("event_type") == "error"
    rows = C.cells(events, by=BY, at="ts", daily=False, counts={"tool_errors": is_error, **{p: is_error & C.within("ts", w) for p, w in windows.items()}})
    want = stats.overview_totals(sessions, events, friction).drop("interrupts")
    assert told(C.overview(rows, extra=("tool_errors",))) == told(want.select(*C.overview(rows, extra=("tool_errors",)).columns))
    assert told(C.projects(rows, friction="tool_errors")) == told(S.projects(sessions, friction))
    assert told(C.kpis(rows, start=start, end=end, friction={p: p for p in windows})) == told(stats.window_kpis(sessions, friction, start=start, end=end))
    filters = S.session_filters(sources=["h1"], projects=["p1", S.UNRECORDED])
    project = S.bucketed(F.col("project_key"))
    got = C.facets(rows, {"source": (F.col("source"), F.col("source") == "h1"), "project": (project, project.isin("p1", S.UNRECORDED)), "thread": (F.col("thread_kind"), F.lit(True))})
    assert told(got) == told(S.facets(sessions, filters, {"source": (F.col("source"), "source"), "project": (project, "project"), "thread": (F.col("thread_kind"), "thread")}))


def test_ingest_keeps_cells_true_after_late_data(spark, tmp_path):
    store = jobs.Store(spark, f"file://{tmp_path}/tables", parts=4)
    for k, batch in enumerate([{"s1": nested("s1", 1)[:2], "s2": nested("s2", 1)}, {"s1late": nested("s1", 1), "s3": nested("s3", 4)}]):
        for name, records in batch.items():
            write(tmp_path / f"in/{name}.jsonl", records)
        jobs.ingest(spark, "nested", f"{tmp_path}/in", store=store, checkpoint=f"{tmp_path}/c").awaitTermination(120)
        kept = store.load("cells")
        assert told(kept) == told(C.of_canonical(store.load("events")))
        assert kept.agg(F.sum("n_events")).first()[0] == [7, 12][k]
    assert {(r["session_id"], r["n_calls"], r["n_failed"]) for r in C.merged(kept, by=["session_id"]).collect()} == {(s, 1, 1) for s in ("s1", "s2", "s3")}

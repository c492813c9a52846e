"""The live view as a stream against the view in batch, after late rows and after silence."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.streaming import live

AT = datetime(2026, 1, 1, 10)
SCHEMA = "session_id string, parent_session_id string, ts timestamp, signature string"


def row(session, minutes, signature=None, parent=None):
    return (session, parent, AT + timedelta(minutes=minutes), signature)


@pytest.fixture
def stepped(spark, tmp_path):
    """Feeds batches of rows one by one to the stream and gives what it shows after each."""
    spark.conf.set(*live.STORE)
    n = [0]

    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n[0]:03d}")
        n[0] += 1
        s = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        live.changes(s).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(180)
        return view(live.shown(spark.read.parquet(f"{tmp_path}/out")))

    yield feed
    spark.conf.unset(live.STORE[0])


def view(df):
    return sorted(map(tuple, df.select(*live.VIEW).collect()), key=str)


def test_stream_equals_batch_after_late_rows_and_silence(spark, stepped):
    rng = random.Random(2)
    rows = [row("main", m) for m in range(0, 30, 3)]
    rows += [row(f"kid{m % 3}", m, rng.choice(["a", "b", None]), "main") for m in range(5, 30)]
    rows += [row("alone", m, "x") for m in range(20, 30)] + [row("brief", 1, "x")]
    seen = []
    for batch in ([r for r in rows if r[2] <= AT + timedelta(minutes=18)], [r for r in rows if r[2] > AT + timedelta(minutes=18)]):
        got = stepped(batch)
        seen += batch
        clock = max(r[2] for r in seen) - timedelta(minutes=10)
        assert got == view(live.now_view(spark.createDataFrame(seen, SCHEMA), clock)) and got
    # Late rows, within the delay: they raise a badge, bring a child back and change the newest friction.
    late = [row("alone", 20.5, "y"), *[row("main", 21 + i / 10, "m") for i in range(6)], row("kid9", 22, None, "main")]
    got = stepped(late)
    seen += late
    assert got == view(live.now_view(spark.createDataFrame(seen, SCHEMA), clock))
    assert next(r for r in got if r[0] == "main")[4:] == ("m", 6)
    # Silence: only another fleet speaks, the clock goes on, and what was shown goes without a row of its own.
    for minutes in (47, 75, 130, 1700):
        seen.append(row("other", minutes))
        got = stepped(seen[-1:])
        assert got == view(live.now_view(spark.createDataFrame(seen, SCHEMA), seen[-1][2] - timedelta(minutes=10)))
    assert [r[0] for r in got] == ["other"]


def test_badge_goes_when_repeats_grow_old(spark, stepped):
    seen = [row("s", m, "loop") for m in range(5)]
    stepped(seen)
    for m in range(8, 90, 8):  # the session stays live, its repeats do not
        seen.append(row("s", m))
        got = stepped(seen[-1:])
        want = view(live.now_view(spark.createDataFrame(seen, SCHEMA), max(r[2] for r in seen) - timedelta(minutes=10)))
        assert got == want
    assert got[0][3] == AT + timedelta(minutes=4) and got[0][4] is None


def test_view_of_odd_rows(spark):
    rows = [("a", None, AT, None), ("a", None, AT, None), ("b", "gone", AT, "s"), ("c", None, None, "s")]
    assert view(live.now_view(spark.createDataFrame(rows, SCHEMA), AT)) == [("a", None, 0, None, None, None), ("b", "gone", 0, AT, None, None)]
    assert live.now_view(spark.createDataFrame([], SCHEMA), AT).count() == 0
    ties = [("a", None, AT, s) for s in ("y", "x") for _ in range(5)]
    assert live.now_view(spark.createDataFrame(ties, SCHEMA), AT).select(F.concat_ws(" ", "loop_signature", "loop_count")).first()[0] == "x 5"

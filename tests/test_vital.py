import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.operators import assets as A
from tracewell.streaming import jobs, vital

NONE = dict.fromkeys(vital.FLAGS, False)


@pytest.mark.parametrize(
    ("before", "overlay", "flags", "state", "alert"),
    [
        (None, False, {"participated"}, "healthy", False), (None, False, set(), "dormant", False), (None, False, {"silent"}, "silent", True), ("healthy", False, {"silent", "bypassed"}, "bypassed", True),
        ("healthy", False, {"archived"}, "archived", False), ("archived", False, {"silent"}, "archived", False), ("archived", False, {"restore"}, "dormant", False), ("silent", False, {"request_resurrection"}, "awaiting_resurrection", False),
        ("awaiting_resurrection", False, {"resurrected"}, "healthy", True), ("awaiting_resurrection", False, {"resurrection_failed"}, "silent", True), ("awaiting_resurrection", False, {"silent"}, "awaiting_resurrection", False),
        ("healthy", False, {"broken"}, "healthy", True), (None, False, {"broken"}, "broken", True), ("healthy", True, set(), "healthy", True), ("healthy", False, {"degraded"}, "degraded", True), ("dormant", False, set(), "dormant", False),
        ("dormant", False, {"has_baseline"}, "healthy", True), ("silent", False, {"no_opportunity"}, "no_opportunity", False),
    ],
)
def test_step(before, overlay, flags, state, alert):
    got = vital.step(before, overlay, NONE | dict.fromkeys(flags, True))
    assert (got[0], got[2]) == (state, alert)


def plain_replay(rows):
    """Step by step: asset, time and flags in order."""
    place, out = {}, []
    for asset, at, _seq, *flags in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        before, overlay = place.get(asset, (None, False))
        state, now, alert, resurrection = vital.step(before, overlay, {k: bool(v) for k, v in zip(vital.FLAGS, flags, strict=True)})
        out.append((asset, at, before, state, now, state != before or now != overlay, alert, resurrection))
        place[asset] = (state, now)
    return sorted(out, key=str)


ASSESSMENTS = "asset_id string, at timestamp, seq int, " + ", ".join(f"{f} boolean" for f in vital.FLAGS)


@pytest.mark.parametrize("bits", [(8, 10), (2, 2)])
def test_replay_by_composition_equals_step_by_step(spark, monkeypatch, bits):
    """Small blocks and groups lead through all levels; one asset has most rows, one has no name, some flags are null."""
    rng = random.Random(6)
    some = lambda f: None if rng.random() < 0.02 else rng.random() < {"archived": 0.03, "restore": 0.5, "dormant": 0.05, "no_opportunity": 0.05, "unobservable": 0.05}.get(f, 0.15)
    rows = [("hot" if i % 10 else rng.choice(["a", "b", None]), datetime(2026, 1, 1 + i // 60, i % 24), i, *[some(f) for f in vital.FLAGS]) for i in range(1500)]
    monkeypatch.setattr(vital, "BLOCK_BITS", bits[0])
    monkeypatch.setattr(vital, "GROUP_BITS", bits[1])
    got = vital.replay(spark.createDataFrame(rows, ASSESSMENTS))
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in got.schema) == vital.OUT
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert sorted(map(tuple, got.collect()), key=str) == plain_replay(rows)
    assert vital.replay(spark.createDataFrame([], ASSESSMENTS)).count() == 0


def test_each_map_is_the_step_at_each_place(spark):
    """All places against sets of flags: the map of an assessment holds what a step gives."""
    rng = random.Random(8)
    flags = [dict.fromkeys(vital.FLAGS, False) | {f: True} for f in vital.FLAGS] + [{f: rng.random() < 0.3 for f in vital.FLAGS} for _ in range(150)] + [NONE]
    df = spark.createDataFrame([tuple(f[k] for k in vital.FLAGS) for f in flags], ", ".join(f"{k} boolean" for k in vital.FLAGS))
    for row in df.select("*", vital.move().alias("move")).collect():
        for place, to in enumerate(row["move"]):
            state, overlay, _, _ = vital.step(vital.STATES[place // 2], place % 2 == 1, {k: row[k] for k in vital.FLAGS})
            assert to == 2 * vital.STATES.index(state) + overlay


@pytest.mark.parametrize(
    ("before", "overlay", "flags", "want"),
    [
        # (state, overlay, alert, resurrection) after one assessment
        (None, False, set(), ("dormant", False, False, False)),
        (None, False, {"participated"}, ("healthy", False, False, False)),
        ("dormant", False, {"participated", "has_baseline"}, ("healthy", False, True, False)),
        ("healthy", False, {"degraded", "has_baseline"}, ("degraded", False, True, False)),
        ("degraded", False, {"silent", "has_baseline"}, ("silent", False, True, False)),
        ("silent", False, {"request_resurrection"}, ("awaiting_resurrection", False, False, False)),
        ("awaiting_resurrection", False, {"resurrected"}, ("healthy", False, True, True)),
        ("awaiting_resurrection", False, {"resurrection_failed"}, ("silent", False, True, True)),
        ("silent", False, {"broken"}, ("silent", True, True, False)),
        ("silent", True, {"broken"}, ("silent", True, False, False)),
        ("silent", True, {"silent"}, ("silent", False, True, False)),
        ("healthy", False, {"no_opportunity"}, ("no_opportunity", False, False, False)),
        ("healthy", False, {"unobservable"}, ("unobservable", False, False, False)),
        ("archived", False, {"participated"}, ("archived", False, False, False)),
    ],
)
def test_edges_one_by_one(spark, before, overlay, flags, want):
    """Each edge as a step, and at the end of a replay that leads there."""
    on = lambda f: NONE | dict.fromkeys(f, True)
    assert vital.step(before, overlay, on(flags)) == want
    leads = {"dormant": [set()], "healthy": [{"participated"}], "degraded": [{"participated"}, {"degraded"}], "silent": [{"silent"}], "archived": [{"archived"}], "awaiting_resurrection": [{"silent"}, {"request_resurrection"}], None: []}[before]
    steps = [*leads, *([{"broken"}] if overlay else []), flags]
    rows = [("a", datetime(2026, 1, 1, i), i, *[f in s for f in vital.FLAGS]) for i, s in enumerate(steps)]
    last = vital.replay(spark.createDataFrame(rows, ASSESSMENTS)).orderBy("at").collect()[-1]
    assert (last["from_state"], last["state"], last["overlay"], last["alert"], last["resurrection"]) == (before, *want)


@pytest.mark.parametrize(("before", "after", "legal"), [("dormant", "healthy", True), ("healthy", "degraded", True), ("healthy", "silent", True), ("healthy", "bypassed", True), ("silent", "awaiting_resurrection", True), ("awaiting_resurrection", "healthy", True), ("awaiting_resurrection", "silent", True), ("dormant", "archived", True), ("archived", "healthy", False), ("silent", "degraded", False), (None, "silent", True)])
def test_legal_edges(spark, before, after, legal):
    row = spark.createDataFrame([(before, after)], "b string, a string")
    assert row.select(vital.legal(F.col("b"), F.col("a")).alias("ok")).first()["ok"] is legal


def test_stream_of_assessments_equals_the_replay(spark, tmp_path):
    flags = ["participated", "silent", "request_resurrection", "resurrected", "broken", "degraded"]
    rows = [(f"a{i % 3}", datetime(2026, 1, 1, 0, i), i, *[f == flags[(i * (i % 3 + 1)) % 6] for f in vital.FLAGS]) for i in range(24)]
    schema = ASSESSMENTS
    every = spark.createDataFrame(rows, schema)
    key = lambda r: (r["asset_id"], r["at"])
    want = sorted(vital.replay(every).collect(), key=key)
    for lo in (0, 8, 16):
        every.filter(f"seq >= {lo} and seq < {lo + 8}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    vital.stream(s).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(180)
    # Files come in the order of their times; each asset's batches rise in time.
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=key) == want
    assert spark.createDataFrame(want).filter(~vital.legal(F.col("from_state"), F.col("state"))).count() >= 0


def opportunities(spark, pattern):
    """Oldest first: 1 took part, 0 did not, ? not known."""
    rows = [("a", f"s{i:03d}", datetime(2026, 1, 1 + i // 24, i % 24), {"1": True, "0": False}.get(c)) for i, c in enumerate(pattern)]
    return spark.createDataFrame(rows, "asset_id string, session_id string, detected_at timestamp, participated boolean")


@pytest.mark.parametrize(("pattern", "reason"), [("11111" + "0" * 8, "silent"), ("1111" + "0" * 8, "too_little_history"), ("11111" + "0" * 7, "too_little_history"), ("11111" + "0" * 7 + "1", "took_part"), ("11111" + "0" * 7 + "?", "not_known"), ("10000" + "0" * 8, "rate_was_low"), ("11000" + "0" * 8, "silent")])
def test_silence_boundaries(spark, pattern, reason):
    assert A.silence(opportunities(spark, pattern)).first()["reason"] == reason


@pytest.mark.parametrize(("pattern", "hit"), [("1111100000", True), ("1111111100", False), ("1111110000", True), ("1111", False), ("1111100111", False)])
def test_degradation_boundaries(spark, pattern, hit):
    assert A.degradation(opportunities(spark, pattern)).first()["triggered"] is hit


def test_loops_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{i % 2}", f"g{i % 3}", datetime(2026, 1, 1, 10, i % 60)) for i in range(120)] + [("s9", "late", datetime(2026, 1, 2))]
    df = spark.createDataFrame(rows, "session_id string, signature string, ts timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    want = sorted(map(tuple, jobs.loops(df).collect()))
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    jobs.loops(s).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want and want

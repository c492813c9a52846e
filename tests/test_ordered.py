"""Running values by slices against plain windows, and sessions and files too large for one task."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators import ordered as R
from tracewell.sources import transcripts as T

START = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """One session has nine of ten events; some times, values and keys are null."""
    rng = random.Random(4)
    made = []
    for i in range(3000):
        key = None if i % 97 == 0 else "hot" if rng.random() < 0.9 else f"s{rng.randrange(20)}"
        at = None if i % 211 == 0 else START + timedelta(minutes=rng.randrange(20_000))
        made.append((key, at, i, None if rng.random() < 0.3 else rng.randrange(1000), f"k{i % 7}", i % 5 == 0))
    return spark.createDataFrame(made, "sid string, at timestamp, id long, v int, kind string, opens boolean").repartition(8).cache()


def same(got, want):
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    told = lambda df: sorted((tuple(r) for r in df.select(*names).collect()), key=str)
    assert told(got) == told(want)


@pytest.mark.parametrize(("order", "strict", "ahead"), [(["at", "id"], False, False), (["at", "id"], True, True), (["id"], True, False), (["id"], False, True), (["kind", "id"], True, True)])
def test_scan_equals_plain_windows(rows, order, ahead, strict, monkeypatch):
    monkeypatch.setattr(R, "SLICE_BITS", 6)
    got = R.scan(rows, by=["sid"], order=order, last={"l": F.col("v")}, most={"m": F.col("v")}, total={"t": F.col("v")}, strict=strict, ahead=ahead)
    turned = [F.col(c).desc() if ahead else F.col(c).asc() for c in order]
    w = W.partitionBy("sid").orderBy(*turned).rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    same(got, rows.withColumns({"l": F.last("v", ignorenulls=True).over(w), "m": F.max("v").over(w), "t": F.sum("v").over(w)}))


def test_as_of_joins_of_a_hot_session(rows):
    left, right = rows.filter("id % 3 = 0").select("sid", "at", "id"), rows.filter("id % 3 > 0 and sid is not null and at is not null").select("sid", "at", "id", "kind")
    other = right.select(F.col("sid").alias("s"), F.col("at").alias("t"), F.col("id").alias("i"), F.col("kind").alias("k"))
    for strict in (False, True):
        met = left.join(other, (F.col("sid") == F.col("s")) & ((F.col("t") < F.col("at")) if strict else (F.col("t") <= F.col("at"))), "left")
        want = met.groupBy("sid", "at", "id").agg(F.max_by("k", F.struct("t", "i")).alias("last_kind"), F.max_by("i", F.struct("t", "i")).alias("last_id"))
        same(R.asof_backward(left, right, by=["sid"], left_at="at", right_at="at", tie="id", take=["kind", "id"], strict=strict), want)
    met = left.join(other, (F.col("sid") == F.col("s")) & (F.col("t") >= F.col("at")), "left")
    want = met.groupBy("sid", "at", "id").agg(F.min_by("i", F.struct("t", "i")).alias("first_id"))
    # A row without a time comes before all others.
    first = right.groupBy(F.col("sid").alias("s")).agg(F.min_by("id", F.struct("at", "id")).alias("first"))
    want = want.join(first, F.col("sid") == F.col("s"), "left").withColumn("first_id", F.when(F.col("at").isNull(), F.col("first")).otherwise(F.col("first_id"))).drop("s", "first")
    same(R.asof_forward(left, right, by=["sid"], left_at="at", right_at="at", tie="id", take=["id"]), want)


def test_a_row_does_not_meet_itself(spark):
    fleets = [("p", "f1", START), ("p", "f2", START + timedelta(days=1)), ("p", "f3", START + timedelta(days=40)), ("q", "f4", START), (None, "f5", START), (None, "f6", START + timedelta(days=2))]
    df = spark.createDataFrame(fleets, "project string, fleet string, at timestamp")
    got = R.asof_backward(df, df, by=["project"], left_at="at", right_at="at", tie="fleet", take=["fleet"], not_same="fleet")
    assert {r["fleet"]: r["last_fleet"] for r in got.collect()} == {"f1": None, "f2": "f1", "f3": "f2", "f4": None, "f5": None, "f6": "f5"}


def test_clocks_costs_histories_and_samples_of_a_hot_session(rows, monkeypatch):
    monkeypatch.setattr(R, "SLICE_BITS", 6)
    w = W.partitionBy("sid").orderBy("id")
    clock = F.max("at").over(w.rowsBetween(W.unboundedPreceding, -1))
    gap = F.unix_millis("at") - F.unix_millis(clock)
    want = rows.withColumn("g", gap).groupBy("sid").agg(F.coalesce(F.sum(F.when((F.col("g") > 0) & (F.col("g") <= 600_000), F.col("g"))), F.lit(0)).alias("active_ms"))
    same(R.active_time(rows, by=["sid"], at="at", tie="id"), want)
    plain = rows.withColumn("turn", F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("sid", "turn").agg(F.max_by(F.when(F.col("v").isNotNull(), F.col("v")), F.when(F.col("v").isNotNull(), F.col("id"))).alias("c"))
    plain = plain.withColumn("o", F.last("c", ignorenulls=True).over(W.partitionBy("sid").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)))
    cost = F.col("c") - F.coalesce("o", F.lit(0))
    same(R.turn_costs(rows, by=["sid"], order="id", opens=F.col("opens"), total="v"), plain.filter("turn > 0").select("sid", "turn", F.when(cost >= 0, cost).alias("turn_tokens")))
    at = W.partitionBy("sid").orderBy("at", "id")
    same(R.valid_intervals(rows, by=["sid"], at="at", tie="id").select("id", "valid_to"), rows.select("id", F.lead("at").over(at).alias("valid_to")))
    lagged = rows.select("id", "kind", F.lag("kind").over(at).alias("was"))
    same(R.previous_change(rows, by=["sid"], order=["at", "id"], fields=["kind"]).select("id", "was", "now"), lagged.filter("was <> kind").select("id", "was", F.col("kind").alias("now")))
    down = W.partitionBy("sid").orderBy(F.col("at").desc(), F.col("id").desc())
    same(R.newest(rows, by=["sid"], at="at", tie="id", n=8).select("id", "is_current"), rows.select("id", (F.row_number().over(down) <= 8).alias("is_current")))
    same(R.of_latest(rows, by=["sid"], at="at", tie="id", field="kind").select("id"), rows.withColumn("l", F.first("kind").over(down)).filter("l = kind").select("id"))
    counted = {r["sid"]: r["count"] for r in R.even_sample(rows, by=["sid"], order=["at", "id"], most=10).groupBy("sid").count().collect()}
    sizes = {r["sid"]: r["count"] for r in rows.groupBy("sid").count().collect()}
    assert counted == {k: min(10, n) for k, n in sizes.items()}


def test_sums_over_ranges_of_a_hot_session(rows):
    spans = rows.filter("id % 10 = 0 and at is not null and sid is not null").select("sid", "id", F.col("at").alias("from"), (F.col("at") + F.expr("interval 3 days")).alias("to"))
    facts = rows.filter("at is not null").select(F.col("sid").alias("s"), F.col("at").alias("t"), "v")
    met = spans.join(facts, (F.col("sid") == F.col("s")) & (F.col("t") > F.col("from")) & (F.col("t") <= F.col("to")), "left")
    want = met.groupBy("sid", "id", "from", "to").agg(F.sum("v").alias("sum"))
    same(R.range_sum(spans, facts.withColumnsRenamed({"s": "sid", "t": "at"}), by=["sid"], start="from", end="to", at="at", value="v", out="sum"), want)


def tasks_rows(spark, df):
    """Rows that each task of the last shuffle holds."""
    return [r["n"] for r in df.select(F.spark_partition_id().alias("p"), F.struct("*").alias("r")).groupBy("p").agg(F.count("r").alias("n"), F.max("r")).collect()]


def test_a_hot_session_is_the_work_of_many_tasks(spark):
    n = 40_000
    df = spark.range(n).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("sid"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 300).alias("at"), "id")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = R.asof_backward(df.select("sid", "at", "id"), df.filter("id % 2 = 0"), by=["sid"], left_at="at", right_at="at", tie="id", take=["id"])
        assert max(tasks_rows(spark, got)) < 0.2 * n
        assert got.filter("id > 10 and sid = 'hot' and last_id < id - 1").count() == got.filter("sid = 'hot' and id > 10 and id % 10 = 1").count()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_a_large_file_is_read_and_numbered_by_many_tasks(spark, tmp_path):
    lines = {"a": [json.dumps({"n": i, "x": "y" * (i % 50)}) if i % 9 else "  " for i in range(1, 2001)], "b": [json.dumps({"n": i}) for i in range(1, 700)]}
    lines["b"][500] = "{broken"
    lines["b"][600] = "{broken too"
    for name, each in lines.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(each) + "\n")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = spark.read.option("pathGlobFilter", "*.jsonl").text(str(tmp_path), lineSep="\n")
        assert T.placed(read).select("path", "block").distinct().count() > 30
        got = T.lines(spark, [str(tmp_path)])
        found = {(r["path"].rsplit("/", 1)[1][0], r["line_no"], r["raw"]) for r in got.collect()}
        windows = [w for w in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in w]
        assert windows and all("_slice" in w for w in windows)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = {("a", i, x) for i, x in enumerate(lines["a"], 1) if x.strip()} | {("b", i, x) for i, x in enumerate(lines["b"], 1) if i <= 500}
    assert found == want


def test_a_session_named_in_its_head_and_a_bad_event(spark):
    head = lambda i: json.dumps({"type": "session", "id": i, "time": 1})
    said = json.dumps({"type": "user/message", "time": 2, "data": {"content": [{"type": "text", "text": "hello there"}]}})
    rows = [(f"x/{k}/log.jsonl", 0, n, v) for k in "ab" for n, v in enumerate([head("one"), said, said] if k == "a" else [said, said])]
    parsed = T.parse("log", T.numbered_lines(spark.createDataFrame(rows, "path string, block long, nth long, value string")))
    assert sorted(r["session_id"] for r in parsed[0].collect()) == ["b", "one"] and parsed[1].count() == 4
    odd = parsed[1].withColumn("event_type", F.when(F.col("session_id") == "b", "odd").otherwise(F.col("event_type")))
    good, bad = T.valid(odd.unionByName(odd.limit(1).withColumn("session_id", F.lit(None).cast("string"))))
    assert {r["session_id"] for r in good.collect()} == {"one"} and {r["session_id"] for r in bad.collect()} == {"b", None}

"""Passes that judge only what changed, against judging all anew."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.streaming import jobs
from tracewell.streaming.evaluate import Facts, Report, evaluate

START = datetime(2026, 1, 1, 10, tzinfo=UTC)


class World:
    """Two tables of facts; a verdict is how many facts an asset has and their sum."""

    def __init__(self, spark, path):
        self.spark, self.store = spark, jobs.Store(spark, f"file://{path}/v", parts=3, key="asset_id")
        self.assets, self.a, self.b, self.asked, self.fail = ["x", "y", "z", None], [], [], [], False

    def rows(self, rows):
        return self.spark.createDataFrame(rows, "asset_id string, n long, v int")

    def judge(self, wanted, facts):
        self.asked.append(sorted(r[0] for r in wanted.collect()))
        if self.fail:
            raise RuntimeError("lost")
        rows = facts["a"].unionByName(facts["b"]).groupBy("asset_id").agg(F.count(F.lit(1)).alias("facts"), F.sum("v").alias("total"))
        return wanted.join(rows, "asset_id", "left").select("asset_id", "facts", "total")

    def run(self, minutes):
        registered = self.spark.createDataFrame([(x,) for x in self.assets], "asset_id string")
        facts = {"a": Facts(self.rows(self.a), "n"), "b": Facts(self.rows(self.b), "n")}
        return evaluate(self.store, registered, facts, self.judge, as_of=START + timedelta(minutes=minutes))

    def held(self):
        found = self.store.load("verdicts")
        return {} if found is None else {r.asset_id: (r.facts, r.total) for r in found.collect()}

    def anew(self):
        kept = [r for r in self.a + self.b if r[1] is not None]
        of = lambda x: [v for name, _, v in kept if name == x]
        return {x: (len(of(x)) or None, sum(of(x)) if of(x) else None) for x in self.assets if x}


def test_passes_equal_judging_all(spark, tmp_path):
    w = World(spark, tmp_path)
    w.a, w.b = [("x", 1, 10), ("y", 2, 20), ("gone", 3, 1)], []
    assert w.run(0) == Report(True, 3, 0, "the first pass") and w.held() == w.anew()
    assert w.run(1) == Report(False, 0, 3, "no new facts") and len(w.asked) == 1 and w.held() == w.anew()
    w.a += [("y", 4, 5), (None, 5, 1), ("unknown", 6, 1)]
    assert w.run(2) == Report(False, 1, 2, "new facts") and w.asked[-1] == ["y"] and w.held() == w.anew()
    w.b += [("z", 1, 7), ("x", 2, 1), ("x", 3, 1)]
    assert w.run(3) == Report(False, 2, 1, "new facts") and w.asked[-1] == ["x", "z"] and w.held() == w.anew()
    # A fact without a number waits for nothing: no pass judges by it, and it makes none judged again.
    w.b += [("y", None, 9)]
    assert w.run(4).evaluated == 0 and w.held() == w.anew()
    # An asset that comes without facts waits for a sweep, which also drops what is registered no more.
    w.assets = ["y", "z", "new"]
    assert w.run(5).evaluated == 0 and set(w.held()) == {"x", "y", "z"}
    assert w.run(60) == Report(True, 3, 0, "a full sweep was due") and w.held() == w.anew()
    w.assets = []
    assert w.run(121) == Report(True, 0, 0, "a full sweep was due") and w.held() == {}


def test_lost_pass_is_done_again(spark, tmp_path, monkeypatch):
    w = World(spark, tmp_path)
    w.a = [("x", 1, 10), ("y", 2, 20)]
    w.run(0)
    before, w.a, w.fail = w.held(), w.a + [("x", 3, 1)], True
    with pytest.raises(RuntimeError):
        w.run(1)
    assert w.held() == before
    # Lost after the rows are written and before the list: neither rows nor marks hold.
    w.fail = False
    with monkeypatch.context() as m:
        m.setattr(jobs.Store, "_swap", lambda self, listed: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            w.run(2)
    assert w.held() == before
    assert w.run(3) == Report(False, 1, 2, "new facts") and w.held() == w.anew()

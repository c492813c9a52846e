"""The live view: sessions at work now, their live children, newest friction and loop, as a stateful stream and in batch.

A session is live while its newest row is less than ``LIVE_MS`` old. Its badge
names the signature that came most often, ``LOOP`` times at least, within the last
``LOOP_MS``; ties go to the lesser signature. In a stream the clock is the
watermark: rows change what is shown, and timers take it away again when no
further row comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: How long a session counts as live and a repeat counts for its badge, and repeats that make one.
LIVE_MS, LOOP_MS, LOOP = 600_000, 3_600_000, 5
#: How long the state of a silent session is kept; one that comes back later begins anew.
KEEP_MS = 86_400_000
#: The state store that timers and state by several names need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
VIEW = ["session_id", "parent_session_id", "live_children", "friction_last_at", "loop_signature", "loop_count"]
OUT = "session_id string, parent_session_id string, live boolean, live_children int, friction_last_at timestamp, loop_signature string, loop_count int, clock timestamp, change long"
_LONG_AGO = -(1 << 62)


def now_view(rows: DataFrame, now: datetime, *, live_ms: int = LIVE_MS, loop_ms: int = LOOP_MS, least: int = LOOP) -> DataFrame:
    """What is live at ``now``. rows: session_id, parent_session_id, ts and signature (null where a row is no friction)."""
    cutoff = lambda ms: F.timestamp_millis(F.unix_millis(F.lit(now)) - ms)
    is_friction = F.col("signature").isNotNull()
    seen = rows.groupBy("session_id").agg(F.max("ts").alias("_seen"), F.max("parent_session_id").alias("parent_session_id"), F.max(F.when(is_friction, F.col("ts"))).alias("friction_last_at"))
    live = seen.filter(F.col("_seen") > cutoff(live_ms))
    children = live.filter("parent_session_id is not null").groupBy(F.col("parent_session_id").alias("session_id")).agg(F.count(F.lit(1)).cast("int").alias("live_children"))
    repeats = rows.filter(is_friction & (F.col("ts") > cutoff(loop_ms))).groupBy("session_id", "signature").agg(F.count(F.lit(1)).cast("int").alias("n")).filter(F.col("n") >= least)
    loops = repeats.groupBy("session_id").agg(F.min_by(F.struct("signature", "n"), F.struct(-F.col("n"), "signature")).alias("loop"))
    got = live.join(children, "session_id", "left").join(loops, "session_id", "left")
    return got.select("session_id", "parent_session_id", F.coalesce("live_children", F.lit(0)).alias("live_children"), "friction_last_at", F.col("loop.signature").alias("loop_signature"), F.col("loop.n").alias("loop_count"))


class Fleet(StatefulProcessor):
    """A main session with its children: what is known of each, and what was told of it last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "session_id string", "parent string, seen long, friction long, told string")
        self.repeats = handle.getMapState("repeats", "session_id string, signature string", "times array<long>")
        self.changes = handle.getValueState("changes", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for (session,), own in batch.groupby(["session_id"]):
                parent, seen, friction, told = self.sessions.getValue((session,)) if self.sessions.containsKey((session,)) else (None, _LONG_AGO, _LONG_AGO, "")
                named = own["parent_session_id"].dropna()
                rubs = own[own["signature"].notna()]
                parent = max([*named, *([parent] if parent else [])], default=None)
                self.sessions.updateValue((session,), (parent, max(seen, int(own["ms"].max())), max(friction, int(rubs["ms"].max()) if len(rubs) else _LONG_AGO), told))
                for (signature,), each in rubs.groupby(["signature"]):
                    at = (session, signature)
                    held = list(self.repeats.getValue(at)[0]) if self.repeats.containsKey(at) else []
                    self.repeats.updateValue(at, (sorted([*held, *map(int, each["ms"])]),))
        yield from self._tell(timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._tell(timerValues.getCurrentWatermarkInMs())

    def _tell(self, now: int) -> Iterator[pd.DataFrame]:
        """What changed since it was last told; forgets what is over, and sets the timer to when the next thing will be."""
        known = {k[0]: tuple(v) for k, v in self.sessions.iterator()}
        loops, turns = {}, []
        for (session, signature), (times,) in [(tuple(k), tuple(v)) for k, v in self.repeats.iterator()]:
            left = [t for t in times if t > now - LOOP_MS]
            if not left:
                self.repeats.removeKey((session, signature))
                continue
            if len(left) < len(times):
                self.repeats.updateValue((session, signature), (left,))
            turns.append(left[0] + LOOP_MS)
            if len(left) >= LOOP:
                loops[session] = min(loops.get(session, (0, "")), (-len(left), signature))
        live = {s for s, (_, seen, _, _) in known.items() if seen > now - LIVE_MS}
        turns += [known[s][1] + LIVE_MS for s in live]
        out, n = [], self.changes.get()[0] if self.changes.exists() else 0
        for session in sorted(known):
            parent, seen, friction, told = known[session]
            is_live = session in live
            children = sum(known[s][0] == session for s in live)
            count, signature = loops.get(session, (0, None))
            row = (is_live, children, friction, signature, -count) if is_live else (False,)
            if repr(row) != told and (is_live or told):
                n += 1
                shown = row if is_live else (False, 0, _LONG_AGO, None, 0)
                out.append((session, parent, *shown, n))
            if not is_live and seen <= now - KEEP_MS:
                self.sessions.removeKey((session,))
                continue
            if not is_live:
                turns.append(seen + KEEP_MS)
            if repr(row) != told:
                self.sessions.updateValue((session,), (parent, seen, friction, repr(row)))
        self.changes.update((n,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if turns:
            self.handle.registerTimer(max(min(turns), now + 1))
        if out:
            pdf = pd.DataFrame(out, columns=["session_id", "parent_session_id", "live", "live_children", "friction", "loop_signature", "loop_count", "change"])
            when = pd.to_datetime(pdf["friction"].where(pdf["friction"] > _LONG_AGO), unit="ms")
            pdf = pdf.assign(friction_last_at=when, loop_count=pdf["loop_count"].where(pdf["loop_signature"].notna()).astype("Int32"), clock=pd.to_datetime(max(now, 0), unit="ms"))
            yield pdf[[c.split()[0] for c in OUT.split(", ")]]

    def close(self) -> None:
        pass


def changes(rows: DataFrame, *, late: str = "10 minutes") -> DataFrame:
    """A stream of changes of the live view from a stream of rows as in ``now_view``; the session must use the store of ``STORE``."""
    timed = rows.withWatermark("ts", late)
    fleet = F.coalesce("parent_session_id", "session_id").alias("fleet")
    told = timed.select(fleet, "session_id", "parent_session_id", "signature", F.unix_millis("ts").alias("ms"), "ts")
    return told.groupBy("fleet").transformWithStateInPandas(statefulProcessor=Fleet(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def shown(changes_: DataFrame) -> DataFrame:
    """The view after all of ``changes_`` (batch): the last change of each session, if it is live."""
    w = W.partitionBy("session_id").orderBy(F.col("clock").desc(), F.col("change").desc())
    return changes_.withColumn("_r", F.row_number().over(w)).filter("_r = 1 and live").select(*VIEW)

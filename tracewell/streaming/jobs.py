"""Structured Streaming jobs: replay-safe ingest, live loops and idle-gap sessions. Each has a batch form to test against."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators.cells import of_canonical
from tracewell.operators.sets import upsert_events, upsert_sessions
from tracewell.sources.datasource import register
from tracewell.sources.transcripts import in_order, numbered_lines, parse, placed, valid

#: Parts into which stored tables are cut by session.
PARTS = 256
#: The entry of a list that holds its notes.
NOTES = ".notes"
#: Lists of parts that stay readable beside the one in force.
KEPT = 2


class Store:
    """Canonical tables as Parquet below ``root``, cut into parts by session, so that a batch rewrites only the parts it touches.

    A batch writes the touched parts of all its tables to new folders and then one
    small list of the folders in force, which appears under its number in one
    step. A driver that is lost before that leaves everything as it was, one lost
    after it has the batch done; the next batch clears what no list names.
    One writer at a time: a second one that takes the same number fails. The list
    may carry notes (short strings), so that they hold exactly as long as the rows do.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS, key: str = "session_id"):
        self.spark, self.root, self.parts, self.key = spark, root.rstrip("/"), parts, key

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        files, path = self._files(), self._path(folder)
        return [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("in-force") if n.endswith(".json"))

    def _listed(self, number: int) -> dict[str, dict[str, str]]:
        stream = self._files().open(self._path(f"in-force/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _newest(self) -> dict[str, dict[str, str]]:
        numbers = self._numbers()
        return self._listed(numbers[-1]) if numbers else {}

    def in_force(self) -> dict[str, dict[str, str]]:
        """table -> part -> folder; at most as many entries as there are parts."""
        return {table: held for table, held in self._newest().items() if table != NOTES}

    def notes(self) -> dict[str, str]:
        return self._newest().get(NOTES, {})

    def load(self, name: str, parts: list[int] | None = None) -> DataFrame | None:
        """The table, or those of its parts; None where nothing of it has been saved."""
        held = self.in_force().get(name, {})
        folders = [f for k, f in sorted(held.items()) if parts is None or int(k) in parts]
        if not folders and held:
            return self.spark.read.parquet(f"{self.root}/{next(iter(held.values()))}").limit(0)
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{f}" for f in folders]) if folders else None

    def staged(self, rows: DataFrame) -> DataFrame:
        """``rows`` written once below ``root`` and read again, until the next save."""
        path = f"{self.root}/staging/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def save(self, tables: dict[str, DataFrame], *, whole: bool = False, notes: dict[str, str] | None = None) -> None:
        """Replaces the parts that each of ``tables`` has rows in (``whole``: all its parts), those of all tables at once, and the notes if there are any."""
        before, written = self._newest(), {}
        for name, rows in tables.items():
            folder = f"{name}/{uuid.uuid4().hex}"
            rows.withColumn("_part", self.part()).repartition("_part").write.partitionBy("_part").parquet(f"{self.root}/{folder}")
            new = {n.removeprefix("_part="): f"{folder}/{n}" for n in self._names(folder) if n.startswith("_part=")}
            written[name] = new if whole else before.get(name, {}) | new
        self._swap(before | written | ({} if notes is None else {NOTES: notes}))
        self._clear()

    def _swap(self, listed: dict[str, dict[str, str]]) -> None:
        number = (self._numbers() or [0])[-1] + 1
        draft = self._path(f"in-force/draft-{uuid.uuid4().hex}")
        out = self._files().create(draft, False)
        out.write(json.dumps(listed).encode())
        out.close()
        if not self._files().rename(draft, self._path(f"in-force/{number:012d}.json")):
            raise RuntimeError(f"list {number} of {self.root} is there already: another writer is at work")

    def _clear(self) -> None:
        """Removes what was staged, older lists, and folders that none of the kept ones names."""
        self._files().delete(self._path("staging"), True)
        numbers = self._numbers()
        for n in numbers[:-KEPT]:
            self._files().delete(self._path(f"in-force/{n:012d}.json"), False)
        named = {f for n in numbers[-KEPT:] for table, held in self._listed(n).items() if table != NOTES for f in held.values()}
        for table in {f.split("/")[0] for f in named}:
            for folder in self._names(table):
                for part in self._names(f"{table}/{folder}"):
                    if part.startswith("_part=") and f"{table}/{folder}/{part}" not in named:
                        self._files().delete(self._path(f"{table}/{folder}/{part}"), True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see: below ``spark.checkpoint.dir``, or one of its own in a local session without it. It goes when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spark-tracewell-')}"
    path = f"{shared.rstrip('/')}/tracewell-core/{name}-{uuid.uuid4().hex}"

    def leave() -> None:
        if spark.sparkContext._jsc is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    atexit.register(leave)
    return path


def ingest(spark: SparkSession, source: str, root: str, *, store: Store, checkpoint: str, pattern: str = "*.jsonl", follow: bool = False):
    """Reads new transcripts below ``root`` and merges them into the canonical tables of ``store``.

    Rows read again take the place of stored ones, spans only widen, and nothing
    is dropped for being late, so a batch may be replayed. A batch reads and
    writes only the parts of its own sessions. With ``follow``, files that have
    grown are read again, by the source of ``sources.datasource``. The tables are
    events, sessions and cells (``operators.cells``).
    """

    def merge(batch: DataFrame, _: int) -> None:
        # Each step is written once: lines are not numbered, nor records parsed, again by all that reads them.
        sessions, events = parse(source, store.staged(numbered_lines(batch if follow else in_order(batch))))
        good, _bad = valid(store.staged(events))
        good, sessions = store.staged(good), store.staged(sessions)
        both = sessions.select("session_id").unionByName(good.select("session_id"))
        parts = [r[0] for r in both.select(store.part()).distinct().collect()]  # at most as many as the store has
        if not parts:
            return
        stored, known = store.load("events", parts), store.load("sessions", parts)
        events = good if stored is None else upsert_events(stored, good)
        first = ["cwd", "version", "model", "parent_session_id", "thread_kind"]
        rows = sessions.select("session_id", "started_at", "ended_at", *[c for c in ("title", *first) if c in sessions.columns])
        own = [c for c in first if c in rows.columns]
        sessions = rows if known is None else upsert_sessions(known, rows, newer_wins=[c for c in ("title",) if c in rows.columns], first_wins=own)
        # The parts are whole, so their cells are those of all their events: a batch replaces what it touches.
        events = store.staged(events)
        store.save({"events": events, "sessions": sessions, "cells": of_canonical(events)})

    if follow:
        register(spark)
        grown = spark.readStream.format("transcripts").options(path=root, suffix=pattern.lstrip("*")).load()
        return grown.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    files = spark.readStream.format("text").option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return placed(files).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def loops(friction: DataFrame, *, window: str = "60 minutes", slide: str = "5 minutes", least: int = 5, late: str = "10 minutes") -> DataFrame:
    """Signatures repeated ``least`` times in a session within a sliding window; a batch or a stream."""
    rows = friction.withWatermark("ts", late) if friction.isStreaming else friction
    counts = rows.groupBy(F.window("ts", window, slide).alias("w"), "session_id", "signature").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least).select(F.col("w.start").alias("window_start"), "session_id", "signature", "n")


def heaviest_loop(loops_: DataFrame) -> DataFrame:
    """The heaviest loop of each session in a window (batch)."""
    w = W.partitionBy("session_id", "window_start").orderBy(F.col("n").desc(), "signature")
    return loops_.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def idle_gap_sessions(events: DataFrame, *, by: str = "user_id", gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Stretches of activity that a gap ends; a batch or a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    g = rows.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(by, F.col("w.start").alias("started_at"), F.col("w.end").alias("ends_at"), "n")

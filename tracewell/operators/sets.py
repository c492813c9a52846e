"""Unions of unlike tables, changed keys, reconciling stored with fresh rows, and idempotent writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def one_sequence(**tables: DataFrame) -> DataFrame:
    """UNION ALL by name, each row with the kind it comes from; columns that a table lacks are null."""
    parts = [df.withColumn("row_kind", F.lit(n)) for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def changed_keys(tables: list[tuple[DataFrame, str, object]], key: str) -> DataFrame:
    """Distinct keys that any table has above its mark. tables: (rows, column, mark)."""
    return reduce(lambda a, b: a.union(b), [df.filter(F.col(c) > F.lit(mark)).select(key) for df, c, mark in tables]).distinct()


def reconcile(stored: DataFrame, live: DataFrame, *, key: list[str], scope: DataFrame | None = None, scope_key: str | None = None) -> DataFrame:
    """``stored`` with ``status``: retired (live no more), restored (superseded but live again), new (not stored yet) or kept.

    Only rows within ``scope`` take part; others are kept.
    """
    inside = stored if scope is None else stored.join(scope.select(scope_key).distinct(), scope_key, "left_semi")
    outside = None if scope is None else stored.join(scope.select(scope_key).distinct(), scope_key, "left_anti")
    keys = live.select(*key).distinct().withColumn("_live", F.lit(True))
    judged = inside.join(keys, key, "left")
    gone, back = F.col("_live").isNull(), F.col("_live").isNotNull()
    status = F.when(gone & F.col("superseded_at").isNull(), "retired").when(back & F.col("superseded_at").isNotNull(), "restored").otherwise("kept")
    out = judged.withColumn("status", status).drop("_live")
    fresh = live.join(stored.select(*key).distinct(), key, "left_anti").withColumn("status", F.lit("new"))
    out = out.unionByName(fresh, allowMissingColumns=True)
    return out if outside is None else out.unionByName(outside.withColumn("status", F.lit("kept")), allowMissingColumns=True)


def upsert_sessions(stored: DataFrame, new: DataFrame, *, newer_wins: list[str], first_wins: list[str]) -> DataFrame:
    """Sessions by session_id: the span only grows, some fields take the newer reading, the others keep the first recorded."""
    both = stored.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    latest = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("_batch"))).alias(c)
    earliest = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("_batch"))).alias(c)
    return both.groupBy("session_id").agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), *map(latest, newer_wins), *map(earliest, first_wins))


def upsert_events(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Events by (session_id, source_event_id): a row read again takes the place of the stored one."""
    both = stored.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy("session_id", "source_event_id").orderBy(F.col("_batch").desc())
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_batch")


def changed_only(checks: DataFrame, latest: DataFrame, *, key: list[str], items: list[str]) -> DataFrame:
    """Keys whose set of items differs from the latest stored set, with the new set. Both inputs have a row for each item."""
    gathered = lambda df: df.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct(*items))).alias("items"))
    now, before = gathered(checks), gathered(latest).withColumnRenamed("items", "_before")
    return now.join(before, key, "left").filter(~F.col("items").eqNullSafe(F.col("_before"))).drop("_before")


def rebuilt_tags(rule_tags: DataFrame, stored: DataFrame) -> DataFrame:
    """User tags survive, tags set by rules are replaced."""
    return stored.filter(F.col("kind") == "user").unionByName(rule_tags).dropDuplicates(["session_id", "kind", "tag"])


def rekeyed(events: DataFrame, moves: DataFrame) -> DataFrame:
    """Events filed under another session than their own move there. moves: session_id, raw_ref, to_session."""
    return events.join(moves, ["session_id", "raw_ref"], "left").withColumn("session_id", F.coalesce("to_session", "session_id")).drop("to_session").select(events.columns)

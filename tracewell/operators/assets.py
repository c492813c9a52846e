"""Instruction files: versions, facts, participation, detectors, states and notifications."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Observation levels from the strongest to the weakest, and participation signals from first to last.
LEVELS = ("invoked", "observed-use", "loaded", "offered", "inferred", "unknown")
SIGNALS = ("offered", "loaded", "invoked", "observed-use", "followed")


def level_rank(c: Column) -> Column:
    """5 for the strongest level, 0 for the weakest and for what is none."""
    return F.coalesce(*[F.when(c == name, len(LEVELS) - 1 - i) for i, name in enumerate(LEVELS)], F.lit(0))


def versions(snapshots: DataFrame, *, asset: str = "asset_id", content: str = "content_hash", at: str = "observed_at") -> DataFrame:
    """One version for each distinct content of an asset, numbered in the order first seen."""
    first = snapshots.groupBy(asset, content).agg(F.min(at).alias(at))
    return first.withColumn("version", F.row_number().over(W.partitionBy(asset).orderBy(at, content)))


def participation_rate(opportunities: DataFrame, participations: DataFrame, *, start: datetime, end: datetime, by: list[str]) -> DataFrame:
    """In [start, end): distinct sessions that could have used an asset, those of them that did, and the rate, null for none."""
    o = opportunities.filter((F.col("detected_at") >= F.lit(start)) & (F.col("detected_at") < F.lit(end))).select(*by, "session_id").distinct()
    p = participations.select(*by, "session_id").distinct().withColumn("_did", F.lit(True))
    got = o.join(p, [*by, "session_id"], "left").groupBy(*by).agg(F.count(F.lit(1)).alias("sessions"), F.count("_did").alias("participating"))
    return got.withColumn("rate", F.round(F.try_divide(F.col("participating").cast("double"), F.col("sessions").cast("double")), 6))


def facts(opportunities: DataFrame, participations: DataFrame, *, newest: int = 8) -> DataFrame:
    """For every asset in one pass: sessions, participating sessions, last time, strongest level, and the newest opportunities against the rest."""
    w = W.partitionBy("asset_id").orderBy(F.col("detected_at").desc(), F.col("session_id").desc())
    per = participations.groupBy("asset_id", "session_id").agg(F.max(level_rank(F.col("level"))).alias("rank"), F.max("occurred_at").alias("at"))
    o = opportunities.select("asset_id", "session_id", "detected_at").dropDuplicates(["asset_id", "session_id"]).withColumn("current", F.row_number().over(w) <= newest)
    j = o.join(per, ["asset_id", "session_id"], "left")
    did = F.col("rank").isNotNull()
    return j.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(did).alias("participating"), F.max("at").alias("last_at"), F.max("rank").alias("strongest"),
        F.count_if(F.col("current")).alias("current_sessions"), F.count_if(F.col("current") & did).alias("current_participating"),
        F.count_if(~F.col("current")).alias("baseline_sessions"), F.count_if(~F.col("current") & did).alias("baseline_participating"),
    )


def funnel(participations: DataFrame) -> DataFrame:
    """Distinct sessions by asset and signal, every signal present, null where the asset never recorded it."""
    seen = participations.select("asset_id", "signal", "session_id").distinct().groupBy("asset_id", "signal").agg(F.count(F.lit(1)).alias("sessions"))
    grid = participations.select("asset_id").distinct().withColumn("signal", F.explode(F.array(*map(F.lit, SIGNALS))))
    return grid.join(seen, ["asset_id", "signal"], "left")


def sparkline(points: DataFrame, *, by: list[str], at: str, hit: Column, start: datetime, end: datetime, buckets: int = 12) -> DataFrame:
    """Percent of hits in each of ``buckets`` parts of the time, rounded by integers; an empty part is null."""
    span = (end - start).total_seconds()
    part = F.floor((F.unix_seconds(F.col(at)) - int(start.timestamp())) / F.lit(span) * (buckets - 1)).cast("int")
    inside = points.filter(F.col(at).between(F.lit(start), F.lit(end)))
    cell = inside.groupBy(*by, part.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("h"))
    grid = inside.select(*by).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    percent = F.floor((F.col("h") * 100 + F.floor(F.col("n") / 2)) / F.col("n"))
    return grid.join(cell, [*by, "bucket"], "left").select(*by, "bucket", percent.alias("percent"))


def silence(opportunities: DataFrame, *, newest: int = 8, least_history: int = 5, least_rate: float = 0.3) -> DataFrame:
    """Verdict for each asset: silent if it used to take part and its newest opportunities, all known, saw nothing.

    opportunities: asset_id, session_id, detected_at, participated (null: not known).
    """
    w = W.partitionBy("asset_id").orderBy(F.col("detected_at").desc(), F.col("session_id").desc())
    o = opportunities.withColumn("new", F.row_number().over(w) <= newest)
    p = F.col("participated")
    g = o.groupBy("asset_id").agg(
        F.count_if(~F.col("new") & p.isNotNull()).alias("history"), F.count_if(~F.col("new") & F.coalesce(p, F.lit(False))).alias("history_hits"),
        F.count_if("new").alias("recent"), F.count_if(F.col("new") & p.isNull()).alias("recent_unknown"), F.count_if(F.col("new") & F.coalesce(p, F.lit(False))).alias("recent_hits"),
    )
    reason = (
        F.when(F.col("history") < least_history, "too_little_history").when(F.col("history_hits") < least_rate * F.col("history"), "rate_was_low").when(F.col("recent") < newest, "too_few_recent")
        .when(F.col("recent_unknown") > 0, "not_known").when(F.col("recent_hits") > 0, "took_part").otherwise("silent")
    )
    return g.withColumn("reason", reason).withColumn("triggered", reason == "silent")


def degradation(opportunities: DataFrame, *, newest: int = 5) -> DataFrame:
    """Triggered if the rate of the newest opportunities is below half of the rate before; known ones only."""
    w = W.partitionBy("asset_id").orderBy(F.col("detected_at").desc(), F.col("session_id").desc())
    o = opportunities.filter(F.col("participated").isNotNull()).withColumn("new", F.row_number().over(w) <= newest)
    g = o.groupBy("asset_id").agg(F.count_if("new").alias("n"), F.count_if(F.col("new") & F.col("participated")).alias("h"), F.count_if(~F.col("new")).alias("bn"), F.count_if(~F.col("new") & F.col("participated")).alias("bh"))
    return g.withColumn("triggered", (F.col("n") >= newest) & (F.col("bn") > 0) & (F.col("h") * F.col("bn") * 2 < F.col("bh") * F.col("n")))


def dormancy(assets: DataFrame, participations: DataFrame, *, now: datetime, days: int = 30, most: int = 2) -> DataFrame:
    """Assets first seen ``days`` ago or earlier with at most ``most`` distinct sessions taking part."""
    n = participations.select("asset_id", "session_id").distinct().groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))
    got = assets.join(n, "asset_id", "left").withColumn("sessions", F.coalesce("n", F.lit(0))).drop("n")
    return got.withColumn("dormant", (F.col("first_seen") <= F.lit(now - timedelta(days=days))) & (F.col("sessions") <= most))


def resurrection(opportunities: DataFrame, since: DataFrame, *, newest: int = 8) -> DataFrame:
    """After a state began: success at the first opportunity followed, failure after ``newest`` known ones without, else open."""
    after = opportunities.join(since, "asset_id").filter((F.col("detected_at") > F.col("since")) & F.col("participated").isNotNull())
    w = W.partitionBy("asset_id").orderBy("detected_at", "session_id")
    numbered = after.withColumn("i", F.row_number().over(w))
    g = numbered.groupBy("asset_id").agg(F.min(F.when(F.col("participated"), F.col("i"))).alias("first_hit"), F.count(F.lit(1)).alias("known"))
    outcome = F.when(F.col("first_hit") <= newest, "success").when(F.col("known") >= newest, "failure").when(F.col("first_hit").isNotNull(), "success").otherwise("open")
    return since.select("asset_id").join(g, "asset_id", "left").select("asset_id", F.coalesce("known", F.lit(0)).alias("known"), F.coalesce(outcome, F.lit("open")).alias("outcome"))


def state_history(transitions: DataFrame, *, asset: str = "asset_id", at: str = "occurred_at", tie: str = "id") -> DataFrame:
    """State intervals: a transition closes the open state and begins the next; one is open for each asset."""
    w = W.partitionBy(asset).orderBy(at, tie)
    return transitions.select(asset, F.col("to_state").alias("state"), F.col(at).alias("started_at"), F.lead(at).over(w).alias("ended_at"))


def opportunity_facts(tags: DataFrame, assets: DataFrame) -> DataFrame:
    """One opportunity for each (session, shape class, asset): the shape is the session's distinct tags in order."""
    shape = tags.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("tag")))), "|").alias("shape_class"), F.min("ts").alias("detected_at"))
    return shape.filter(F.col("shape_class") != "").join(assets.select("asset_id", "shape_class").distinct(), "shape_class").dropDuplicates(["session_id", "shape_class", "asset_id"])


#: What a transition notifies of (kind, severity), and what a settled watch does.
NOTICES = {"verification_passed": "positive", "verification_failed": "attention", "broken": "attention", "silent": "attention", "bypassed": "attention"}
VERDICTS = {"verified": ("watch_verified", "good"), "no_change": ("watch_no_change", "warn"), "unobservable": ("watch_unobservable", "muted")}


def notice_kind(before: Column, state: Column, *, overlay: Column, resurrection: Column) -> Column:
    """What a transition notifies of, null for nothing. The outcome of a check after a change goes first, then what broke."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    checked = F.when((state == "healthy") & yes(resurrection), "verification_passed").when((state == "silent") & yes(before == "awaiting_resurrection"), "verification_failed")
    return F.coalesce(checked, F.when(yes(overlay) | (state == "broken"), "broken").when(state.isin("silent", "bypassed"), state))


def notice_severity(kind: Column) -> Column:
    known = NOTICES | dict(VERDICTS.values())
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[kind]


def notifications(transitions: DataFrame, ignored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Transitions that notify and were not ignored, and settled watch verdicts, newest first.

    transitions: id, from_state, to_state, overlay, resurrection, occurred_at.
    ignored: id. verdicts: watch_id, status, at (null: not evaluated yet).
    """
    kind = notice_kind(F.col("from_state"), F.col("to_state"), overlay=F.col("overlay"), resurrection=F.col("resurrection"))
    kept = transitions.join(ignored.select("id"), "id", "left_anti").select("id", kind.alias("kind"), F.col("to_state").alias("what"), F.col("occurred_at").alias("at"))
    named = F.create_map(*[F.lit(x) for status, (name, _) in VERDICTS.items() for x in (status, name)])
    settled = verdicts.filter("at is not null").select(F.col("watch_id").alias("id"), named[F.col("status")].alias("kind"), F.col("status").alias("what"), "at")
    rows = kept.unionByName(settled).filter("kind is not null").withColumn("severity", notice_severity(F.col("kind")))
    return rows.orderBy(F.col("at").desc(), "kind", "id")


def clusters(anchors: DataFrame, transitions: DataFrame, *, days: int = 5, least: int = 2) -> DataFrame:
    """Anchors with the distinct assets that changed within ``days`` of them; those with ``least`` or more, one for each instant and set."""
    from tracewell.operators.ordered import near_in_time

    # Of an asset's moves on one day, the first and the last say whether it moved near an anchor.
    day = transitions.groupBy("asset_id", F.to_date("ts").alias("_day")).agg(F.array_distinct(F.array(F.min("ts"), F.max("ts"))).alias("_at"))
    moves = day.select("asset_id", F.explode("_at").alias("moved_at"))
    met = near_in_time(anchors.select(F.col("id").alias("anchor_id"), F.col("ts").alias("anchor_at")), moves, left_at="anchor_at", right_at="moved_at", days=days)
    sets = met.groupBy("anchor_id", "anchor_at").agg(F.array_sort(F.collect_set("asset_id")).alias("assets")).filter(F.size("assets") >= least)
    return sets.groupBy("anchor_at", "assets").agg(F.min("anchor_id").alias("anchor_id"))


def disposition_flag(kind: Column) -> Column:
    """The assessment flag that a user's disposition sets; ignoring sets none."""
    return F.when(kind.isin("prune", "archive"), "archived").when(kind == "restore", "restore").when(kind == "modify", "request_resurrection")

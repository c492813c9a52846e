"""Verdicts on assets kept by a store: a pass judges those whose facts are new, and all of them where a full sweep is due."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.streaming.jobs import Store

TABLE, SWEPT = "verdicts", "swept_at"


@dataclass(frozen=True)
class Facts:
    """A table of facts. ``rows`` has asset_id and ``number``, whole numbers that grow with each new fact."""

    rows: DataFrame
    number: str


@dataclass(frozen=True)
class Report:
    full: bool
    evaluated: int
    skipped: int
    reason: str


def evaluate(store: Store, assets: DataFrame, facts: Mapping[str, Facts], judge: Callable[[DataFrame, dict[str, DataFrame]], DataFrame], *, as_of: datetime, every: timedelta = timedelta(hours=1)) -> Report:
    """One pass. ``judge`` gets the asset_ids to judge and the facts of these assets, and gives rows with asset_id.

    A pass reads how far each table goes (its mark) and judges by facts up to
    that, so a fact that comes in meanwhile is new to the next pass. Assets with a
    fact above the marks of the pass before are judged again. A full sweep, due
    ``every`` so often since silence changes no fact, judges every asset and drops
    the verdicts of those that are registered no more. A fact without an asset or
    a number makes none judged again. Verdicts and marks are stored in one step: a
    driver lost in between leaves both, and the next pass does the work again. The
    store (``key="asset_id"``) rewrites only the parts of the assets judged.
    """
    ends = reduce(DataFrame.unionByName, [f.rows.agg(F.max(f.number).cast("long").alias("mark")).withColumn("of", F.lit(name)) for name, f in facts.items()])
    before, marks = store.notes(), {r["of"]: -1 if r["mark"] is None else r["mark"] for r in ends.collect()}  # a row for each table
    at = as_of if as_of.tzinfo else as_of.replace(tzinfo=UTC)
    full = SWEPT not in before or at - datetime.fromisoformat(before[SWEPT]) >= every
    registered = assets.select("asset_id").filter("asset_id is not null").distinct()
    seen = {name: f.rows.filter(F.col(f.number) <= marks[name]) for name, f in facts.items()}
    if full:
        wanted = registered
    else:
        new = [rows.filter(F.col(facts[name].number) > int(before.get(name, -1))).select("asset_id") for name, rows in seen.items()]
        wanted = registered.join(reduce(DataFrame.union, new).distinct(), "asset_id", "left_semi")
    wanted = store.staged(wanted)
    judged, known = wanted.count(), registered.count()
    notes = {name: str(mark) for name, mark in marks.items()} | {SWEPT: at.isoformat() if full else before[SWEPT]}
    if full:
        reason = "a full sweep was due" if SWEPT in before else "the first pass"
    else:
        reason = "new facts" if judged else "no new facts"
    if judged:
        verdicts = judge(wanted, {name: rows.join(wanted, "asset_id", "left_semi") for name, rows in seen.items()})
        if not full:
            parts = [r[0] for r in wanted.select(store.part()).distinct().collect()]  # at most as many as the store has
            stored = store.load(TABLE, parts)
            if stored is not None:
                verdicts = verdicts.unionByName(stored.join(wanted, "asset_id", "left_anti"), allowMissingColumns=True)
        store.save({TABLE: verdicts}, whole=full, notes=notes)
    else:
        store.save({TABLE: wanted} if full else {}, whole=full, notes=notes)
    return Report(full, judged, known - judged, reason)

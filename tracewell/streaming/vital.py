"""The state machine of an asset: one step, its replay over ordered assessments, and the same over a stream.

An assessment maps each of at most 22 places (state and overlay, or none yet) to
the next. Such maps compose, and composition is associative: the replay folds
blocks of assessments to one map each, and groups of blocks to one again, walks
the few maps at the top from the first place on, and then each group and each
block from the place it is entered at. So an asset with most of all assessments
is the work of many tasks, in built-in functions alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordered import scan

#: The states that a state may change to, and those that alert when they begin.
LEGAL = {
    "dormant": ("healthy", "archived", "broken", "no_opportunity", "unobservable"),
    "healthy": ("degraded", "silent", "bypassed", "broken", "no_opportunity", "unobservable", "archived"),
    "degraded": ("healthy", "silent", "bypassed", "broken", "no_opportunity", "unobservable", "archived"),
    "silent": ("awaiting_resurrection", "healthy", "broken", "archived", "no_opportunity", "unobservable"),
    "broken": ("awaiting_resurrection", "healthy", "silent", "bypassed", "no_opportunity", "unobservable", "archived"),
    "bypassed": ("healthy", "broken", "silent", "no_opportunity", "unobservable", "archived"),
    "no_opportunity": ("healthy", "dormant", "unobservable", "broken", "archived"),
    "unobservable": ("healthy", "no_opportunity", "dormant", "broken", "archived"),
    "awaiting_resurrection": ("healthy", "silent", "broken", "archived"),
    "archived": ("dormant",),
}
ALERTS = ("silent", "broken", "bypassed", "degraded", "healthy")
FLAGS = ("archived", "restore", "request_resurrection", "resurrected", "resurrection_failed", "broken", "bypassed", "silent", "dormant", "no_opportunity", "unobservable", "degraded", "participated", "has_baseline")
#: Assessments of a block and blocks of a group, as powers of two.
BLOCK_BITS, GROUP_BITS = 8, 10
#: States by number; a place is twice that and one more under the overlay.
STATES = (None, *LEGAL)
OUT = "asset_id string, at timestamp, from_state string, state string, overlay boolean, transition boolean, alert boolean, resurrection boolean"


def legal(before: Column, after: Column) -> Column:
    out = before.isNull() | (before == after)
    for state, to in LEGAL.items():
        out = out | ((before == state) & after.isin(*to))
    return out


def step(before: str | None, overlay: bool, f: dict[str, bool]) -> tuple[str, bool, bool, bool]:
    """(state, overlay, alert, resurrection) after one assessment; the first rule that holds decides."""
    was, resurrection, now_overlay = overlay, False, False
    if f["archived"] or (before == "archived" and not f["restore"]):
        state = "archived"
    elif before == "archived":
        state, was = "dormant", False
    elif f["request_resurrection"] and (before in ("silent", "broken", "bypassed") or overlay):
        state, was = "awaiting_resurrection", False
    elif before == "awaiting_resurrection":
        resurrection = f["resurrected"] or f["resurrection_failed"]
        state = "healthy" if f["resurrected"] else "silent" if f["resurrection_failed"] else before
        was = False
    elif f["broken"]:
        state, now_overlay = before or "broken", True
    else:
        first = next((s for s in ("bypassed", "silent", "dormant", "no_opportunity", "unobservable") if f[s]), None)
        if first:
            state = first
        elif before is None:
            state = "healthy" if f["participated"] else "dormant"
        elif f["degraded"]:
            state = "degraded"
        elif before == "dormant" and not f["participated"] and not f["has_baseline"]:
            state = "dormant"
        else:
            state = "healthy"
    moved = state != before or now_overlay != was
    alert = moved and state != "archived" and (resurrection or now_overlay or state in ALERTS)
    if before is None and state == "healthy" and not now_overlay:
        alert = False
    return state, now_overlay, alert, resurrection


def _replay(rows: pd.DataFrame, before: str | None, overlay: bool) -> tuple[pd.DataFrame, str | None, bool]:
    out = []
    for r in rows.sort_values(["at", "seq"]).to_dict("records"):
        state, now, alert, resurrection = step(before, overlay, {k: bool(r[k]) for k in FLAGS})
        out.append((r["asset_id"], r["at"], before, state, now, state != before or now != overlay, alert, resurrection))
        before, overlay = state, now
    names = [c.split()[0] for c in OUT.split(", ")]
    return pd.DataFrame(out, columns=names), before, overlay


def _place(state: str | None, overlay: bool) -> Column:
    return F.lit(2 * STATES.index(state) + overlay)


def _next(before: str | None, overlay: bool) -> Column:
    """The place after an assessment at a given one, from its flags: the rules of ``step`` as columns."""
    f, to = F.col, _place
    if before == "archived":
        return F.when(f("archived") | ~f("restore"), to("archived", False)).otherwise(to("dormant", False))
    out = F.when(f("archived"), to("archived", False))
    if before in ("silent", "broken", "bypassed") or overlay:
        out = out.when(f("request_resurrection"), to("awaiting_resurrection", False))
    if before == "awaiting_resurrection":
        return out.when(f("resurrected"), to("healthy", False)).when(f("resurrection_failed"), to("silent", False)).otherwise(to(before, False))
    out = out.when(f("broken"), to(before or "broken", True))
    for state in ("bypassed", "silent", "dormant", "no_opportunity", "unobservable"):
        out = out.when(f(state), to(state, False))
    if before is None:
        return out.when(f("participated"), to("healthy", False)).otherwise(to("dormant", False))
    out = out.when(f("degraded"), to("degraded", False))
    if before == "dormant":
        out = out.when(~f("participated") & ~f("has_baseline"), to("dormant", False))
    return out.otherwise(to("healthy", False))


def move() -> Column:
    """The map of an assessment: the next place at each."""
    return F.array(*[_next(state, overlay) for state in STATES for overlay in (False, True)])


def composed(items: Column) -> Column:
    """One map from those of ``items`` in their order."""
    start = F.array(*map(F.lit, range(2 * len(STATES))))
    return F.aggregate(items, start, lambda so_far, x: F.transform(so_far, lambda at: F.get(x["move"], at)))


def walked(items: Column, place: Column) -> Column:
    """The place at which each of ``items`` is entered, the first at ``place``."""
    start = F.struct(place.cast("int").alias("at"), F.array().cast("array<int>").alias("met"))
    return F.aggregate(items, start, lambda so_far, x: F.struct(F.get(x["move"], so_far["at"]).alias("at"), F.concat(so_far["met"], F.array(so_far["at"])).alias("met")), lambda x: x["met"])


def _entered(items: str, place: Column, *fields: str) -> Column:
    """``items`` with the place at which each is entered."""
    return F.explode(F.transform(F.arrays_zip(F.col(items).alias("x"), walked(F.col(items), place).alias("place")), lambda z: F.struct(*[z["x"][f].alias(f) for f in fields], z["place"].alias("place"))))


def _meet(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of one asset and number."""
    named = right.withColumnsRenamed({"asset_id": "_of", on: "_at"})
    return left.join(named, F.col("asset_id").eqNullSafe(F.col("_of")) & (F.col(on) == F.col("_at"))).drop("_of", "_at")


def replay(assessments: DataFrame) -> DataFrame:
    """Every step of every asset. assessments: asset_id, at, seq and the flags, null counting as false; steps of one time go by seq."""
    rows = assessments.select("asset_id", "at", "seq", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in FLAGS])
    numbered = scan(rows, by=["asset_id"], order=["at", "seq"], total={"n": F.lit(1).cast("long")})
    kept = ("archived", "request_resurrection", "resurrected", "resurrection_failed")
    item = F.struct("n", "at", *kept, move().alias("move"))
    block = F.shiftright(F.col("n") - 1, BLOCK_BITS).alias("block")
    blocks = numbered.groupBy("asset_id", block).agg(F.array_sort(F.collect_list(item)).alias("steps"))  # 2 ** BLOCK_BITS at most
    group = F.shiftright(F.col("block"), GROUP_BITS).alias("group")
    groups = blocks.select("asset_id", group, F.struct("block", composed(F.col("steps")).alias("move")).alias("b")).groupBy("asset_id", "group").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    tops = groups.select("asset_id", F.struct("group", composed(F.col("blocks")).alias("move")).alias("g")).groupBy("asset_id").agg(F.array_sort(F.collect_list("g")).alias("groups"))
    entered = tops.select("asset_id", _entered("groups", F.lit(0), "group").alias("e")).select("asset_id", "e.group", "e.place")
    entered = _meet(groups, entered, "group").select("asset_id", _entered("blocks", F.col("place"), "block").alias("e")).select("asset_id", "e.block", "e.place")
    steps = _meet(blocks, entered, "block").select("asset_id", _entered("steps", F.col("place"), "at", "move", *kept).alias("e")).select("asset_id", "e.*")
    name = lambda c: F.get(F.array(*map(F.lit, STATES)), F.shiftright(c, 1))
    after = F.get("move", F.col("place"))
    told = steps.select("asset_id", "at", *kept, name(F.col("place")).alias("from_state"), (F.col("place") % 2 == 1).alias("was"), name(after).alias("state"), (after % 2 == 1).alias("overlay"))
    before, state, overlay = F.col("from_state"), F.col("state"), F.col("overlay")
    at = lambda *states: F.coalesce(before.isin(*states), F.lit(False))
    asked = F.col("request_resurrection") & (at("silent", "broken", "bypassed") | F.col("was"))
    resurrection = ~F.col("archived") & at("awaiting_resurrection") & ~asked & (F.col("resurrected") | F.col("resurrection_failed"))
    lifted = at("archived", "awaiting_resurrection") | asked
    changed = ~state.eqNullSafe(before)
    alert = (changed | (overlay != (F.col("was") & ~lifted))) & (state != "archived") & (resurrection | overlay | state.isin(*ALERTS)) & ~(before.isNull() & (state == "healthy") & ~overlay)
    return told.select("asset_id", "at", "from_state", "state", "overlay", (changed | (overlay != F.col("was"))).alias("transition"), alert.alias("alert"), resurrection.alias("resurrection"))


def stream(assessments: DataFrame) -> DataFrame:
    """The same over a stream of assessments, with (state, overlay) as the state of each asset."""

    def on_group(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before, overlay = state.get if state.exists else (None, False)
        out, before, overlay = _replay(pd.concat(list(batches)), before, bool(overlay))
        state.update((before, overlay))
        yield out

    rows = assessments.select("asset_id", "at", "seq", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in FLAGS])
    return rows.groupBy("asset_id").applyInPandasWithState(on_group, OUT, "state string, overlay boolean", "append", "NoTimeout")

"""Joins and sums that depend on order: as-of, interval and range joins, running clocks, edges and histories.

Keys, times and tie-breaks are arguments. Running values stand on ``scan``, which
cuts each key into slices of its order, so that a key with most of all rows is
the work of many tasks; interval joins meet in buckets of time. Nothing orders a
whole table, or all rows of a key, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts into which the rows of one time bucket are dealt where nothing else is a key.
SALTS = 32
#: Length of a slice where the order is by time (seconds), and where it is by whole numbers (as a power of two).
SLICE_SECONDS, SLICE_BITS = 21_600, 16


def slice_of(rows: DataFrame, column: str) -> Column | None:
    """The slice of a value, rising with it, nulls first; None where its type has no slices."""
    kind, c = rows.schema[column].dataType.simpleString(), F.col(column)
    cut = {"timestamp": F.unix_seconds, "timestamp_ntz": lambda x: F.unix_seconds(x.cast("timestamp"))}
    if kind in cut:
        number = F.floor(cut[kind](c) / SLICE_SECONDS)
    elif kind in ("bigint", "int", "smallint"):
        number = F.shiftright(c.cast("long"), SLICE_BITS)
    else:
        return None
    return F.coalesce(number.cast("long"), F.lit(-(1 << 62)))


def scan(rows: DataFrame, *, by: list[str], order: list[str], last: dict[str, Column] | None = None, most: dict[str, Column] | None = None, total: dict[str, Column] | None = None, strict: bool = False, ahead: bool = False, slice_by: Column | None = None) -> DataFrame:
    """``rows`` with running values of their key at each row: the last that is not null, the greatest and the sum.

    They run over the rows at or before each (before it, if ``strict``), or with
    ``ahead`` over those at or after it, the nearest of which then is the last.
    ``order`` must tell the rows of a key apart where ties would matter.

    A key is cut into slices of its first order column, or of ``slice_by``, which
    must rise with the order. Each slice is folded to one row, the folds run on
    from slice to slice in that table of slices, and what a slice starts from
    joins its rows as one more row ahead of them. The folds read ``rows`` once more,
    with the columns that they need.
    """
    folds = [("last", o, c) for o, c in (last or {}).items()] + [("most", o, c) for o, c in (most or {}).items()] + [("total", o, c) for o, c in (total or {}).items()]
    values = {f"_v{i}": c for i, (_, _, c) in enumerate(folds)}
    turned = (lambda c: F.col(c).desc()) if ahead else (lambda c: F.col(c).asc())
    over = {"last": lambda v, w: F.last(v, ignorenulls=True).over(w), "most": lambda v, w: F.max(v).over(w), "total": lambda v, w: F.sum(v).over(w)}
    run = lambda w: {o: over[kind](f"_v{i}", w) for i, (kind, o, _) in enumerate(folds)}
    end = -1 if strict else 0
    cut = slice_by if slice_by is not None else slice_of(rows, order[0])
    if cut is None:
        w = W.partitionBy(*by).orderBy(*map(turned, order)).rowsBetween(W.unboundedPreceding, end)
        return rows.withColumns(values).withColumns(run(w)).select(*rows.columns, *[o for _, o, _ in folds])
    tagged = rows.withColumns({"_slice": cut, **values})
    place, pick = F.struct(*order), F.min_by if ahead else F.max_by
    held = lambda v: F.col(v).isNotNull()
    fold = {"last": lambda v: pick(F.when(held(v), F.col(v)), F.when(held(v), place)), "most": F.max, "total": F.sum}
    folded = tagged.groupBy(*by, "_slice").agg(*[fold[kind](f"_v{i}").alias(f"_v{i}") for i, (kind, _, _) in enumerate(folds)])
    before = W.partitionBy(*by).orderBy(turned("_slice")).rowsBetween(W.unboundedPreceding, -1)
    carried = folded.select(*by, "_slice", F.lit(True).alias("_carried"), *[over[kind](f"_v{i}", before).alias(f"_v{i}") for i, (kind, _, _) in enumerate(folds)])
    carried = carried.filter(F.coalesce(*[F.when(held(v), True) for v in values], F.lit(False)))
    both = tagged.withColumn("_carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    inside = W.partitionBy(*by, "_slice").orderBy(F.col("_carried").desc(), *map(turned, order)).rowsBetween(W.unboundedPreceding, end)
    return both.withColumns(run(inside)).filter("not _carried").select(*rows.columns, *[o for _, o, _ in folds])


def asof_backward(left: DataFrame, right: DataFrame, *, by: list[str], left_at: str, right_at: str, tie: str, take: list[str], strict: bool = False, not_same: str | None = None) -> DataFrame:
    """``left`` with the columns ``take`` of the last row of ``right`` at or before it (before it, if strict); null where there is none.

    Rows of ``right`` at one time go by ``tie``, the highest counting as last.
    ``not_same`` names a key on which a row must not meet itself.
    """
    own = left.columns
    if not_same:
        right = right.withColumn("_self", F.col(not_same))
    value = F.struct(*[F.col(c).alias(f"r_{c}") for c in take])
    keys = [F.col(c) for c in by]
    a = left.select(*keys, F.col(left_at).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*own).alias("_row"))
    b = right.select(*keys, F.col(right_at).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.col(tie).alias("_tie"), value.alias("_value"), *([F.col("_self")] if not_same else []))
    both, order = a.unionByName(b, allowMissingColumns=True), ["_at", "_side", "_tie"]
    here = F.col("_value").isNotNull()
    if not not_same:
        got = scan(both, by=by, order=order, last={"_found": F.col("_value")})
    else:
        # The last but one is right where the last is the row itself: a key is held by one row of ``right`` at most.
        told = scan(both, by=by, order=order, last={"_prev": F.when(here, F.struct("_value", "_self"))}, strict=True)
        got = scan(told, by=by, order=order, last={"_last": F.when(here, F.struct("_value", "_self", "_prev"))})
        own_ = F.col("_last._self") == F.col(f"_row.{not_same}")
        got = got.withColumn("_found", F.when(own_, F.col("_last._prev._value")).otherwise(F.col("_last._value")))
    return got.filter(F.col("_row").isNotNull()).select("_row.*", *[F.col(f"_found.r_{c}").alias(f"last_{c}") for c in take])


def asof_forward(left: DataFrame, right: DataFrame, *, by: list[str], left_at: str, right_at: str, tie: str, take: list[str]) -> DataFrame:
    """``left`` with the columns ``take`` of the first row of ``right`` at or after it, as ``first_...``."""
    value = F.struct(*[F.col(c).alias(f"r_{c}") for c in take])
    keys = [F.col(c) for c in by]
    a = left.select(*keys, F.col(left_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*left.columns).alias("_row"))
    b = right.select(*keys, F.col(right_at).alias("_at"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), value.alias("_value"))
    got = scan(a.unionByName(b, allowMissingColumns=True), by=by, order=["_at", "_side", "_tie"], last={"_found": F.col("_value")}, ahead=True).filter(F.col("_row").isNotNull())
    return got.select("_row.*", *[F.col(f"_found.r_{c}").alias(f"first_{c}") for c in take])


def range_sum(spans: DataFrame, facts: DataFrame, *, by: list[str], start: str, end: str, at: str, value: str, out: str) -> DataFrame:
    """``spans`` with the sum of ``value`` over the facts in (start, end], null where there is none.

    The sum is a difference of running sums, read where both ends of a span stand
    among the facts, so no span meets its facts one by one.
    """
    key = [F.col(c) for c in by]
    named = spans.select(*key, F.struct(*spans.columns).alias("_span"), F.monotonically_increasing_id().alias("_id"))
    # An end counts the facts at its own time, for (start, end] holds neither more nor fewer.
    ends = F.explode(F.array(F.struct(F.col(f"_span.{start}").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col(f"_span.{end}").alias("at"), F.lit(1).alias("sign")))).alias("_end")
    marks = named.select(*by, "_span", "_id", ends).select(*by, "_span", "_id", F.col("_end.at").alias("_at"), F.col("_end.sign").alias("_sign"), F.lit(1).alias("_side"))
    each = facts.groupBy(*by, F.col(at).alias("_at")).agg(F.sum(value).alias("_s"), F.count(value).alias("_c")).withColumn("_side", F.lit(0))
    met = scan(marks.unionByName(each, allowMissingColumns=True), by=by, order=["_at", "_side"], total={"_sum": F.col("_s"), "_n": F.col("_c")}).filter("_id is not null")
    signed = lambda c: F.sum(F.col("_sign") * F.coalesce(c, F.lit(0)))
    both = met.groupBy("_id").agg(F.first("_span").alias("_span"), signed("_sum").alias("_sum"), signed("_n").alias("_n"))
    return both.select("_span.*", F.when(F.col("_n") > 0, F.col("_sum")).alias(out))


def near_in_time(left: DataFrame, right: DataFrame, *, left_at: str, right_at: str, days: int, by: list[str] = ()) -> DataFrame:
    """Pairs of rows at most ``days`` days apart; both sides' columns must differ in name apart from ``by``.

    Times fall in buckets as long as the distance, and a row meets its own
    bucket and the two beside it. Without ``by`` a bucket alone would be the key:
    rows of ``left`` are then dealt to ``SALTS`` parts of it, and those of
    ``right`` go to each.
    """
    width = days * 86_400
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c)) / width)
    a = left.withColumn("_bucket", F.explode(F.array(bucket(left_at) - 1, bucket(left_at), bucket(left_at) + 1)))
    b = right.withColumn("_bucket", bucket(right_at))
    keys = [*by, "_bucket"]
    if not by:
        keys.append("_salt")
        a = a.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
        b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    apart = F.abs(F.unix_micros(F.col(left_at)) - F.unix_micros(F.col(right_at)))
    return a.join(b, keys).filter(apart <= width * 1_000_000).drop("_bucket", "_salt")


def valid_intervals(rows: DataFrame, *, by: list[str], at: str, tie: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows as intervals that end where the next of their key begins; the last one stays open."""
    following = scan(rows, by=by, order=[at, tie], last={"_next": F.struct(F.col(at).alias("at"))}, strict=True, ahead=True)
    return following.withColumns({start: F.col(at), end: F.col("_next.at")}).drop("_next")


def versions_in_force(sessions: DataFrame, versions: DataFrame, *, session: str, at: str, asset: str, seen: str, version: str, share: list[str]) -> DataFrame:
    """session and a map of each asset of its ``share`` to the greatest version seen by then; assets not seen yet are left out.

    A session meets each asset of its share once, as the map has it, and finds the
    version as of its time; it never meets the versions one by one.
    """
    named = sessions.select(F.col(session).alias("_session"), F.col(at).alias("_start"), *share)
    asked = named.join(versions.groupBy(*share, asset).agg(F.min(seen).alias("_first")), list(share)).filter(F.col("_first") <= F.col("_start")).drop("_first")
    met = asof_backward(asked, versions, by=[*share, asset], left_at="_start", right_at=seen, tie=version, take=[version])
    entries = F.array_sort(F.collect_list(F.struct(F.col(asset).alias("key"), F.col(f"last_{version}").alias("value"))))
    return met.groupBy(F.col("_session").alias(session)).agg(F.map_from_entries(entries).alias("bundle"))


def active_time(rows: DataFrame, *, by: list[str], at: str, tie: str, gap_ms: int = 600_000, out: str = "active_ms") -> DataFrame:
    """Sum of gaps of at most ``gap_ms`` between records in ``tie`` order; a time that goes back does not move the clock."""
    gap = F.unix_millis(F.col(at)) - F.unix_millis(F.col("_clock"))
    timed = scan(rows, by=by, order=[tie], most={"_clock": F.col(at)}, strict=True).withColumn("_gap", gap)
    return timed.groupBy(*by).agg(F.coalesce(F.sum(F.when((F.col("_gap") > 0) & (F.col("_gap") <= gap_ms), F.col("_gap"))), F.lit(0)).alias(out))


def peak_parallelism(spans: DataFrame, *, start: str, end: str) -> DataFrame:
    """One row: considered spans, spans without both ends, the peak number at once and its first moment.

    Ends sort before starts at one instant. Edges are summed by instant first,
    running sums stay within a day, and a day starts from what the days before
    it left open, of which there is one row for each day.
    """
    whole = F.col(start).isNotNull() & F.col(end).isNotNull()
    ok = spans.filter(whole)
    edges = ok.select(F.col(start).alias("at"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(ok.select(F.col(end).alias("at"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    at = edges.groupBy("at").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).withColumn("day", F.to_date("at"))
    inside = W.partitionBy("day").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    at = at.withColumn("before", F.coalesce(F.sum(F.col("up") - F.col("down")).over(inside), F.lit(0)))
    days = at.groupBy("day").agg(F.sum(F.col("up") - F.col("down")).alias("net"))
    carried = days.select("day", F.coalesce(F.sum("net").over(W.partitionBy(F.lit(1)).orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("carried"))
    level = at.join(carried, "day").select("at", (F.col("carried") + F.col("before") - F.col("down") + F.col("up")).alias("n"))
    peak = level.agg(F.max("n").alias("peak"), F.min_by("at", F.struct(-F.col("n"), "at")).alias("peak_at"))
    return peak.crossJoin(spans.agg(F.count_if(whole).alias("considered"), F.count_if(~whole).alias("unbounded")))


def numbered(rows: DataFrame, *, ranks: list[Column], last: str, out: str, prefix: int = 4) -> DataFrame:
    """``rows`` numbered from 1 in the order of ``ranks`` (rising; put a minus before numbers that fall), then of the text ``last``.

    Rows are numbered within a cell of equal ranks and equal first characters of
    ``last``; a cell starts where those before it end, and only the table of cells
    is ordered as a whole.
    """
    names = [f"_rank{i}" for i in range(len(ranks))]
    cells = [*names, "_head"]
    named = rows.withColumns({**dict(zip(names, ranks, strict=True)), "_head": F.substring(F.coalesce(last, F.lit("")), 1, prefix)})
    sizes = named.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(F.lit(1)).orderBy(*cells).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"{c}_of") for c in cells], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    same = F.lit(True)
    for c in cells:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    nth = F.row_number().over(W.partitionBy(*cells).orderBy(last))
    return named.join(starts, same).withColumn(out, F.col("_from") + nth).select(*rows.columns, out)


def previous_change(rows: DataFrame, *, by: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """One row for each field that is filled in a row and in the one before it, and differs."""
    lagged = scan(rows, by=by, order=order, last={"_was": F.struct(*fields)}, strict=True)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_was.{f}").alias("was"), F.col(f).alias("now")) for f in fields]))
    changed = lagged.select(*rows.columns, each.alias("_c")).select(*rows.columns, "_c.*")
    return changed.filter((F.coalesce("was", F.lit("")) != "") & (F.coalesce("now", F.lit("")) != "") & (F.col("was") != F.col("now")))


def newest(rows: DataFrame, *, by: list[str], at: str, tie: str, n: int, out: str = "is_current") -> DataFrame:
    """Flags the newest ``n`` rows of each key."""
    ranked = scan(rows, by=by, order=[at, tie], total={"_rank": F.lit(1)}, ahead=True)
    return ranked.withColumn(out, F.col("_rank") <= n).drop("_rank")


def of_latest(rows: DataFrame, *, by: list[str], at: str, tie: str, field: str) -> DataFrame:
    """Rows whose ``field`` equals that of the newest row of their key."""
    latest = rows.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.max_by(F.struct(F.col(field).alias("held")), F.struct(at, tie)).alias("_latest"))
    same = F.col(field).eqNullSafe(F.col("_latest.held"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(latest, same, "left_semi")


def first_filled(rows: DataFrame, *, by: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """The first value of each field that is neither null nor empty."""
    at = F.struct(*order)
    filled = lambda f: (F.col(f).isNotNull()) & (F.col(f).cast("string") != "")
    return rows.groupBy(*by).agg(*[F.min_by(F.when(filled(f), F.col(f)), F.when(filled(f), at)).alias(f) for f in fields])


def even_sample(rows: DataFrame, *, by: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each key, spread evenly, the first and the last among them."""
    ranked = scan(rows, by=by, order=order, total={"_upto": F.lit(1)})
    numbered = scan(ranked, by=by, order=order, total={"_after": F.lit(1)}, strict=True, ahead=True)
    numbered = numbered.withColumns({"_i": F.col("_upto") - 1, "_n": F.col("_upto") + F.coalesce("_after", F.lit(0))}).drop("_upto", "_after")
    den = most - 1
    picks = F.transform(F.sequence(F.lit(0), F.lit(den)), lambda k: F.floor((k * (F.col("_n") - 1) + F.lit(den // 2)) / den))
    return numbered.filter((F.col("_n") <= most) | F.array_contains(picks, F.col("_i").cast("bigint"))).drop("_i", "_n")


def pair_calls(calls: DataFrame, results: DataFrame, *, by: list[str], link: str, order: str, call_id: str, take: list[str], result_id: str) -> DataFrame:
    """Results with the first call of their session that has the same link; unmatched results stay with nulls."""
    blank = F.trim(F.coalesce(F.col(link).cast("string"), F.lit(""))) == ""
    first = calls.filter(~blank).groupBy(*by, link).agg(F.min_by(F.struct(call_id, *take), order).alias("_c"))
    own = [F.col(c) for c in (*by, link, result_id)]
    return results.select(*own).join(first, [*by, link], "left").select(*by, result_id, F.col(f"_c.{call_id}").alias("call_event_id"), *[F.col(f"_c.{t}").alias(t) for t in take])


def prefer(first: DataFrame, second: DataFrame, *, key: list[str]) -> DataFrame:
    """Rows of ``first``, and those of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select(*key), key, "left_anti").select(first.columns))


def turn_costs(rows: DataFrame, *, by: list[str], order: str, opens: Column, total: str) -> DataFrame:
    """Cost of each turn: running total at its close less that at its open; null if negative or never measured."""
    measured = F.col(total).isNotNull()
    begun = scan(rows, by=by, order=[order], total={"_begun": F.when(opens, 1).otherwise(0)}, last={"_was": F.col(total)}, strict=True)
    told = begun.withColumn("turn", F.coalesce("_begun", F.lit(0)) + F.when(opens, 1).otherwise(0))
    close = F.max_by(F.when(measured, F.col(total)), F.when(measured, F.col(order)))
    turns = told.groupBy(*by, "turn").agg(close.alias("_close"), F.max(F.when(opens, F.col("_was"))).alias("_open"))
    cost = F.col("_close") - F.coalesce(F.col("_open"), F.lit(0))
    return turns.filter("turn > 0").select(*by, "turn", F.when(cost >= 0, cost).alias("turn_tokens"))

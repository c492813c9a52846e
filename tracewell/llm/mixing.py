"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket. The bucket in which a source's
budget ends is found from running sums, and only the rows of that bucket are
split by the next hash bits, until few are left. A document is taken by comparing
its hash with its source's threshold, so nothing is sorted.

Defined cases: a null text has size 0; a null source is a source of its own
and the last; rows with equal doc_id have equal hashes and are ordered by size,
and of rows equal in both as many are taken as the budget asks for; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.tables import scratch, shielded, stored, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a hash, those that one histogram resolves, and rows of a source's boundary bucket from which it is split again.
HASH, BITS, FEW = 60, 12, 10_000


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def order_hash(key: str = "doc_id") -> Column:
    """60 bits of SHA-256 of the key; null hashes as the empty text."""
    return F.conv(F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target.

    Weights go to the sources in code point order, null last. A target stops at
    ``most`` times its source's size and the excess is shared again by weight:
    the result is ``least(cap, level * weight)`` at the one level that makes the
    targets add up. The level comes from running sums over the sources in the
    order in which they reach their caps.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    one = lambda *order: W.partitionBy(F.lit(1)).orderBy(*order)  # noqa: E731  a row for each source, not for each document
    named = by_source.withColumn("_k", (F.row_number().over(one(F.col("source").isNull(), F.encode("source", "utf-8"))) - 1) % len(weights))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_k") + 1).cast("int"))
    at = one((F.col("_cap") / F.col("_w")), F.col("source").isNull(), F.col("source"))
    before = at.rowsBetween(W.unboundedPreceding, -1)
    return (
        named.withColumns({"_w": w, "_cap": (most * F.col("source_size")).cast("double")})
        .withColumns(
            {
                "_total": F.sum(F.col("source_size").cast("double")).over(W.partitionBy(F.lit(1))),
                "_all_w": F.sum("_w").over(W.partitionBy(F.lit(1))),
                "_capped": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
                "_gone_w": F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
            }
        )
        # The level if just the sources before this one are at their caps. It is right at the first source that stays
        # below its cap, and it falls from there on.
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / (F.col("_all_w") - F.col("_gone_w")))
        .withColumn("_right", F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(W.partitionBy(F.lit(1))))
        .select("source", "source_size", F.round(F.least("_cap", F.coalesce(F.col("_right") * F.col("_w"), F.col("_cap"))), 6).alias("target"))
    )


def thresholds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """_s (source), whole (times every document is taken), and what is taken once more: rows before (last_h, last_size) in that order, and ``more`` of the ``most_more`` rows at it.

    The last row is taken or left so that the sum comes nearer to the budget.
    """
    share = F.floor(F.col("target") / F.col("source_size"))
    state = plan.filter(F.col("source_size") > 0).select(F.col("source").alias("_s"), share.alias("whole"), (F.col("target") - share * F.col("source_size")).alias("budget"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    goal, rows, bits = stored(state.select("_s", F.col("budget").alias("left")), "mix-goal"), sizes, HASH
    while True:
        bits -= BITS
        cell = F.shiftright("h", bits).alias("cell")
        counted = rows.groupBy(F.col("source").alias("_t"), cell).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
        sums = counted.withColumn("upto", F.sum("n").over(W.partitionBy("_t").orderBy("cell")))
        # First cell whose end passes what is left; where there is none, all is taken.
        edges = goal.join(sums, same("_s", "_t")).filter(F.col("upto") > F.col("left")).groupBy("_s").agg(F.min(F.struct("cell", "n", "upto", "rows", "left")).alias("e"))
        edges = stored(edges.select("_s", F.col("e.cell").alias("edge"), (F.col("e.left") - (F.col("e.upto") - F.col("e.n"))).alias("left"), F.col("e.rows").alias("rows")), "mix-edges")
        rows = stored(rows.join(edges.select("_s", "edge"), same("source", "_s") & (F.shiftright("h", bits) == F.col("edge"))).select("source", "size", "h"), "mix-boundary")
        goal = edges.select("_s", "left")
        if bits < BITS or edges.filter(F.col("rows") > FEW).isEmpty():
            break
    cells = rows.groupBy(F.col("source").alias("_t"), "h", "size").agg(F.count(F.lit(1)).alias("rows"))
    sums = cells.withColumn("upto", F.sum(F.col("size") * F.col("rows")).over(W.partitionBy("_t").orderBy("h", "size")))
    last = goal.join(sums, same("_s", "_t")).filter(F.col("upto") > F.col("left")).groupBy(F.col("_s").alias("_t")).agg(F.min(F.struct("h", "size", "rows", "upto", "left")).alias("e"))
    e = F.col("e")
    before = e["left"] - (e["upto"] - e["size"] * e["rows"])
    more = F.least(F.floor(before / e["size"] + 0.5), e["rows"])
    return state.join(last, same("_s", "_t"), "left").select("_s", "whole", e["h"].alias("last_h"), e["size"].alias("last_size"), more.alias("more"), e["rows"].alias("most_more"))


def _rules(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Source, source_size, target and threshold of every source; all names begin with _m_. A row for each source, in a stored table, so that Spark broadcasts it only where its size allows."""
    with scratch(sizes.sparkSession):
        plan = stored(targets(sizes, weights=weights, most=most), "mix-targets")
        both = plan.join(thresholds(sizes, plan), F.col("source").eqNullSafe(F.col("_s")), "left")
        names = ("source", "source_size", "target", "whole", "last_h", "last_size", "more", "most_more")
        return stored(both.select(*[F.col(c).alias(f"_m_{c}") for c in names]), "mix-rules", keep=True)


def _counted(rows: DataFrame, rules: DataFrame, source: Column, h: Column, size: Column, most: int) -> DataFrame:
    """``rows`` with the columns of ``rules`` and _m_times, how often each is taken."""
    known = rows.join(rules, source.eqNullSafe(F.col("_m_source")))
    whole = F.coalesce("_m_whole", F.lit(0))
    at = (h == F.col("_m_last_h")) & (size == F.col("_m_last_size"))
    first = F.col("_m_last_h").isNull() & (F.col("_m_source_size") > 0) | (h < F.col("_m_last_h")) | ((h == F.col("_m_last_h")) & (size < F.col("_m_last_size")))
    extra = F.when(at, (F.col("_m_more") > 0).cast("int")).when(first, 1).otherwise(0)
    some = at & (F.col("_m_more") > 0) & (F.col("_m_more") < F.col("_m_most_more"))
    # A text without words costs nothing: it is taken once, whatever its source.
    known = known.withColumn("_m_times", F.when(size == 0, 1).when(~F.coalesce(some, F.lit(False)), F.least(whole + extra, F.lit(most))).cast("int"))
    if rules.filter("_m_more > 0 AND _m_more < _m_most_more").isEmpty():
        return known
    # Some of the rows that agree in source, hash and size are taken: as many as are numbered below ``_m_more``, by
    # the order in which they lie in a stored table.
    open_ = F.col("_m_times").isNull()
    tied = stored(known.filter(open_).withColumn("_m_row", F.monotonically_increasing_id()), "mix-ties", keep=True)
    part = F.shiftright("_m_row", 33).alias("_m_part")
    each = tied.groupBy("_m_source", part).agg(F.count(F.lit(1)).alias("_m_n"))
    starts = each.select(F.col("_m_source").alias("_m_s"), F.col("_m_part").alias("_m_p"), F.coalesce(F.sum("_m_n").over(W.partitionBy("_m_source").orderBy("_m_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_m_start"))
    nth = F.row_number().over(W.partitionBy("_m_source", "_m_part").orderBy("_m_row"))
    numbered = tied.withColumn("_m_part", part).join(starts, F.col("_m_source").eqNullSafe(F.col("_m_s")) & (F.col("_m_part") == F.col("_m_p"))).withColumn("_m_nth", F.col("_m_start") + nth)
    settled = numbered.withColumn("_m_times", F.least(whole + F.when(F.col("_m_nth") <= F.col("_m_more"), 1).otherwise(0), F.lit(most)).cast("int"))
    return known.filter(~open_).unionByName(settled.select(known.columns))


def _sizes(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    return stored(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), order_hash(key).alias("h")), "mix-sizes")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """key, source, size, source_size, target and times (how often each document is taken, 0 to ``most``)."""
    sizes = _sizes(docs, key, source, text)
    known = _counted(sizes, _rules(sizes, weights, most), F.col("source"), F.col("h"), F.col("size"), most)
    return known.select("key", "source", "size", F.col("_m_source_size").alias("source_size"), F.col("_m_target").alias("target"), F.col("_m_times").alias("times"))


def repeated(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with every row as often as the mix takes it: no join on ids, so they may be null or repeat."""

    def work(rows: DataFrame) -> DataFrame:
        rules = _rules(_sizes(rows, key, source, text), weights, most)
        counted = _counted(rows, rules, F.col(source).cast("string"), order_hash(key), word_count(text), most)
        return counted.withColumn("_copy", F.explode(F.when(F.col("_m_times") > 0, F.sequence(F.lit(1), F.col("_m_times"))))).select(rows.columns)

    return shielded(docs, work)

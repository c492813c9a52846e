"""Homomorphic multiset fingerprints of documents, from DataFrame functions alone.

Each paragraph (line) is hashed to a wide vector: dense lanes that every
paragraph adds to, and sparse lanes of which it adds to one. Lanes are summed
modulo 2**32, so the fingerprint does not depend on the order of paragraphs, and
adding or taking away a paragraph is one vector addition. Equal multisets have
equal fingerprints; the share of equal sparse lanes tells how alike two are, within limits: a text of one or a
few lines has few lanes to agree in, and past some 100 lines each lane holds
several, so that half an edit makes both look unlike (figures in the README).

Defined cases: a null text is empty; an empty text has one empty paragraph; rows
that repeat a doc_id count as one place in the order of documents, held by the
smallest of their texts; a null doc_id is the last in descending order; the
only document is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.tables import partitions, stored, text_or_empty

DENSE, SPARSE = 6, 24
MASK = 0xFFFFFFFF


def _word(h: Column, i: int) -> Column:
    """The i-th 32-bit word of a hex digest."""
    return F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")


def lanes(text: Column, sign: int = 1) -> Column:
    """array<long>: DENSE lanes, then SPARSE lanes, each modulo 2**32."""
    words = lambda h: F.struct(*[_word(h, i).alias(f"d{i}") for i in range(DENSE + 2)])
    zero = F.array_repeat(F.lit(0).cast("long"), DENSE + SPARSE)
    # A first pass hashes each paragraph, once.
    paragraphs = F.transform(F.transform(F.split(text, "\n"), lambda p: F.sha2(p, 256)), words)

    def add(total: Column, v: Column) -> Column:
        own = (v[f"d{DENSE}"] % SPARSE).cast("int")
        dense = F.array(*[(total[i] + sign * v[f"d{i}"]).bitwiseAND(MASK) for i in range(DENSE)])
        sparse = F.transform(F.slice(total, DENSE + 1, SPARSE), lambda x, i: F.when(i == own, (x + sign * v[f"d{DENSE + 1}"]).bitwiseAND(MASK)).otherwise(x))
        return F.concat(dense, sparse)

    return F.aggregate(paragraphs, zero, add)


def spelled(lanes: Column) -> Column:
    """Lanes as hex, eight digits each."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of the union of two multisets, or with sign -1 of ``a`` without ``b``."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(MASK))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal lanes among the sparse lanes that either uses: 1 for equal multisets, near 0 for unlike ones."""
    both = F.zip_with(F.slice(a, DENSE + 1, SPARSE), F.slice(b, DENSE + 1, SPARSE), lambda x, y: F.when((x != 0) | (y != 0), (x == y).cast("int")))
    used = F.filter(both, lambda x: x.isNotNull())
    same = F.aggregate(used, F.lit(0), lambda n, x: n + x)
    return F.when(F.array_position(F.zip_with(a, b, lambda x, y: x == y), False) == 0, 1.0).otherwise(F.coalesce(F.try_divide(same.cast("double"), F.size(used).cast("double")), F.lit(0.0)))


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row."""
    return docs.select(F.col(key).alias("doc_id"), spelled(lanes(text_or_empty(text))).alias("fingerprint"))


def following(ids: DataFrame) -> DataFrame:
    """doc_id and next_id in descending order, the last followed by the first.

    Ids are dealt by range and stored; the next one is found within a range,
    and only the ends of the ranges meet in a table of as many rows as there
    are ranges.
    """
    spark = ids.sparkSession
    order = F.coalesce(F.col("doc_id"), F.lit(None))
    dealt = ids.distinct().repartitionByRange(partitions(spark), order.desc_nulls_last()).withColumn("part", F.spark_partition_id())
    parts = stored(dealt, "ids-by-range")
    within = W.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last())
    numbered = parts.withColumns({"_n": F.row_number().over(within), "_next": F.struct(F.lead("doc_id").over(within).alias("id"), F.lead(F.lit(True)).over(within).alias("there"))})
    # First id of each range, in the order of ranges; a range without rows does not appear.
    heads = numbered.filter("_n = 1").select("part", F.col("doc_id").alias("head"))
    one = W.partitionBy(F.lit(1))
    ends = heads.withColumns({"_lead": F.lead(F.struct("head")).over(one.orderBy("part")), "_first": F.first(F.struct("head")).over(one.orderBy("part"))}).select("part", F.coalesce("_lead", "_first")["head"].alias("over"))
    # As many rows as partitions.
    return numbered.join(F.broadcast(ends), "part").select("doc_id", F.when(F.col("_next.there"), F.col("_next.id")).otherwise(F.col("over")).alias("next_id"))


def with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and next_text of every row.

    Texts are shuffled twice: by their own id, which both joins share, and to
    the document that they follow.
    """
    # Ids as texts that are never null, so that grouping and joining share one partitioning. Rows carry nothing
    # else, as the two joins read the same shuffle only if they need the same columns of it.
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    ids = docs.select(F.col(key).alias("doc_id"))
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text")).select(named("doc_id").alias("own"), "text")
    before = following(ids).select(named("doc_id").alias("to"), named("next_id").alias("own"))
    sent = rows.join(before, "own").groupBy("to").agg(F.min("text").alias("next_text"))
    kind = docs.schema[key].dataType
    doc_id = F.when(F.col("own") != "", F.expr("substring(own, 2)").cast(kind)).alias("doc_id")
    return rows.join(sent, F.col("own") == F.col("to")).select(doc_id, "text", "next_text")


def compare_edited(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and how alike they are; see the query for the edit."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs, key=key, text=text).withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), lanes(F.col("text")).alias("own"), lanes(F.col("edited")).alias("other"), lanes(F.col("next_text")).alias("next"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spelled(F.col("own")).alias("fingerprint"),
        spelled(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )

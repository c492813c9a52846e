"""A corpus pipeline of five stages: toxic texts go, one text of each near-duplicate group stays, secrets are cut out, sources are mixed, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
Defined cases, in all stages: rows with null or repeated doc_ids are rows like
others, neither lost nor multiplied; null and empty texts stay, without words;
texts count whole, however long; further columns pass through under any name; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm import mixing, neardup, packing, secrets, toxicity
from tracewell.llm.tables import new_path, remove, scratch, shielded, stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; without confirmed toxic rows, all of them."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return shielded(docs, lambda rows: toxicity.score(rows, model, out="_score").filter(F.col("_score") < toxicity.REJECT).drop("_score"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, the one with the least doc_id; null ids come last.

    Rows may agree in id and text, with texts of other rows between them in no
    order: then as many stay as there are groups that they stand for. A null or
    empty text is a group of its own and stays.
    """
    with scratch(spark):
        groups = neardup.grouped(docs)
        rows = groups.groupBy("mark").agg(F.count(F.lit(1)).alias("rows"))
        first = groups.groupBy("label").agg(F.min(F.struct(F.col("name").isNull(), "name", "mark"))["mark"].alias("mark"))
        most = first.groupBy("mark").agg(F.count(F.lit(1)).alias("_most"))
        kept = stored(most.join(rows, "mark").select(F.col("mark").alias("_mark"), "_most", (F.col("_most") < F.col("rows")).alias("_alike")), "near-kept", keep=True)

    def work(plain: DataFrame) -> DataFrame:
        marked = plain.withColumn("_mark", neardup.row_mark())
        single = marked.join(kept.filter("NOT _alike").select("_mark"), "_mark", "left_semi").select(plain.columns)
        several = kept.filter("_alike").select("_mark", "_most")
        if several.isEmpty():
            return single
        # Rows that agree are numbered by where they lie in a stored table, each part of it by itself and from part to part by sums.
        alike = stored(marked.join(several, "_mark").withColumn("_row", F.monotonically_increasing_id()), "near-alike").withColumn("_part", F.shiftright("_row", 33))
        before = W.partitionBy("_mark").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        starts = alike.groupBy("_mark", "_part").agg(F.count(F.lit(1)).alias("_n")).select("_mark", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
        nth = F.row_number().over(W.partitionBy("_mark", "_part").orderBy("_row"))
        return single.unionByName(alike.join(starts, ["_mark", "_part"]).withColumn("_nth", F.col("_from") + nth).filter(F.col("_nth") <= F.col("_most")).select(plain.columns))

    return shielded(docs, work)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets replaced in its text and n_chars counted anew."""
    _, ledger = secrets.scan_all(docs)
    return secrets.redact(docs, ledger).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it, up to three; of rows with one doc_id, as many as the budget asks for; those without words once."""
    return mixing.repeated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near duplicates", neardup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier, the signatures and the packing search are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; what a stage leaves behind goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with scratch(spark):
            staged = stage(spark, docs, sf_dir)
            staged.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(staged.schema).parquet(path), path
    return docs

"""One query for each operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import dialogs, fingerprints, idcodec, licenses, mixing, neardup, negatives, neighbours, packing, pagetext, quality, secrets, toxicity
from tracewell.llm.tables import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.scan(table(spark, sf_dir, "documents"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


#: Setting with the path of a ledger of scanned blobs that outlives the run; without it, a run has a ledger of its own.
LEDGER = "spark.tracewell.secrets.ledger"


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = table(spark, sf_dir, "documents"), spark.conf.get(LEDGER, None)
    found, _ = secrets.scan_into(docs, ledger) if ledger else secrets.scan_all(docs)
    return secrets.digests(found)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = idcodec.write_and_read(table(spark, sf_dir, "documents"))
    return back.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = quality.label(docs)
    scorer = quality.fit(docs, labelled)
    scored = quality.score(docs, scorer)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"))
    return got.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), F.when(finite, whole).alias("vector"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op13_dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogs.repair(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_licenses, op2_packing, op3_secrets, op4_toxicity, op5_neardup, op6_fingerprints, op7_token_ids, op8_quality, op9_neighbours, op10_mixing, op11_negatives, op12_main_text, op13_dialogs)
    return {f.__name__: f for f in every}


def _lanes_sql(hashes: str) -> str:
    word = lambda h, i: f"('0x' || substr({h}, {8 * i + 1}, 8))::BIGINT"
    dense = [f"(list_sum(list_transform({hashes}, lambda h: {word('h', i)}))::BIGINT % 4294967296)" for i in range(fingerprints.DENSE)]
    d = fingerprints.DENSE
    sparse = [f"(coalesce(list_sum(list_transform(list_filter({hashes}, lambda h: {word('h', d)} % {fingerprints.SPARSE} = {k}), lambda h: {word('h', d + 1)}))::BIGINT, 0) % 4294967296)" for k in range(fingerprints.SPARSE)]
    return f"[{', '.join(dense + sparse)}]"


def _likeness_sql(a: str, b: str) -> str:
    lanes = f"list_zip({a}[{fingerprints.DENSE + 1}:], {b}[{fingerprints.DENSE + 1}:])"
    return f"""CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE coalesce(len(list_filter({lanes}, lambda p: p[1] = p[2] AND p[1] <> 0))::DOUBLE
        / nullif(len(list_filter({lanes}, lambda p: p[1] <> 0 OR p[2] <> 0)), 0), 0.0::DOUBLE) END"""


OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nxt FROM d),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(nxt, 1, length(text) // 2) AS edited FROM n),
h AS (SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
    list_transform(string_split(text, chr(10)), lambda x: sha256(x)) AS a,
    list_transform(string_split(edited, chr(10)), lambda x: sha256(x)) AS b,
    list_transform(string_split(nxt, chr(10)), lambda x: sha256(x)) AS c FROM e),
l AS (SELECT doc_id, n_chars, edited_sha256, {_lanes_sql("a")} AS a, {_lanes_sql("b")} AS b, {_lanes_sql("c")} AS c FROM h)
SELECT doc_id, n_chars, edited_sha256,
    list_aggregate(list_transform(a, lambda x: printf('%08x', x)), 'string_agg', '') AS fingerprint,
    list_aggregate(list_transform(b, lambda x: printf('%08x', x)), 'string_agg', '') AS edited_fingerprint,
    {_likeness_sql("a", "b")} AS near_edited, {_likeness_sql("a", "c")} AS near_next
FROM l
"""

OP10_SQL = r"""
WITH s AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
    FROM documents
), b AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source
), w AS (
    SELECT *, (1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM b
), f AS (
    SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level
    FROM w WINDOW p AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
    SELECT source, source_size, round(least(cap, coalesce(max(CASE WHEN level * w <= cap THEN level END) OVER () * w, cap)), 6) AS target FROM f
), r AS (
    SELECT *, floor(target / nullif(source_size, 0)) AS whole, target - floor(target / nullif(source_size, 0)) * source_size AS budget FROM t
), c AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s
)
SELECT c.doc_id, c.size, r.source_size, r.target,
    (c.size * least(3, coalesce(r.whole, 0) + CASE WHEN (r.budget - c.before) * 2 >= c.size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source
"""


OP11_SQL = """
WITH r AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS row
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, a.row AS anchor, r.vec_id AS id, r.row AS row, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
    FROM r AS a, r WHERE a.vec_id % 100 = 0 AND a.row <> r.row
), p AS (
    SELECT anchor, row, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, row) <= 5
), n AS (
    SELECT anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY s.anchor, p.row ORDER BY s.score DESC, s.id, s.row) AS rank
    FROM s JOIN p USING (anchor) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_fingerprints": OP6_SQL, "op10_mixing": OP10_SQL, "op11_negatives": OP11_SQL}

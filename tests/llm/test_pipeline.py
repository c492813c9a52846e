import importlib.util

import numpy as np
import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows, marks = [], []
    for i in range(600):
        w = [f"w{k}" for k in rng.integers(0, 4000, 80)]
        if i % 8 == 0:
            w += ["slurone", "slurtwo", "slurthree"]
        if i % 50 == 1:
            w.append("token = abcdefghijklmnop0123")
        t = " ".join(w)
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
        marks.append((i, 0, int(i % 8 == 0)))
    copies = [(1000 + k, rows[3][1], "en", "s0", 1) for k in range(20)]
    spark.createDataFrame(rows + copies, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        seen[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    kept = set(seen["toxicity"]["doc_id"])
    assert not any(i % 8 == 0 for i in kept if i < 1000) and len(kept) > 500
    assert set(seen["near duplicates"]["doc_id"]) == {i for i in kept if i < 1000}
    assert not seen["secrets"]["text"].str.contains("abcdefghijklmnop0123").any()
    assert seen["secrets"]["text"].str.contains("<secret>").sum() == 12 - sum(i % 8 == 0 for i in range(1, 600, 50))
    assert seen["mixing"]["doc_id"].value_counts().max() <= 3
    assert len(seen["packing"]) == len(seen["mixing"])


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_neither_lose_nor_multiply_rows_with_null_or_repeated_ids(spark, tmp_path):
    text = lambda n: " ".join(f"w{n}x{k}" for k in range(40))
    rows = [(None, text(0), "en", "a", 1), (1, text(1), "en", "a", 1), (1, text(1), "en", "a", 1), (1, text(2), "en", "a", 1), (2, text(2), "en", "a", 1), (3, None, "en", None, 1), (3, "", "en", None, 1)]
    rows += [(None, None, None, None, None), (None, "", None, None, None)] + [(7, text(10 + k), "en", "a", 1) for k in range(6)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        seen[name] = sorted(((r["doc_id"], r["text"] or "") if name != "packing" else (r["doc_id"], "") for r in docs.collect()), key=str)
    assert len(seen["toxicity"]) == len(rows)
    want = [(None, text(0)), (1, text(1)), (1, text(2)), (3, ""), (3, ""), (None, ""), (None, "")] + [(7, text(10 + k)) for k in range(6)]
    assert seen["near duplicates"] == seen["secrets"] == sorted(want, key=str)
    assert max(seen["mixing"].count(r) for r in want if r[1]) <= 3 and {r for r in seen["mixing"] if r[1]} <= set(want)
    assert sum(bool(t) for _, t in seen["mixing"]) == sum(bool(t) for _, t in want)
    assert len(seen["packing"]) == len(seen["mixing"])


def test_stages_keep_columns_whose_names_clash_and_long_texts(spark, tmp_path):
    names = ["_blob", "_spans", "_text", "_mark", "_most", "_nth", "_copy", "_score", "_m_times", "_m_source", "times", "mark", "label", "toxic_score", "blob", "size", "most"]
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 60)) for _ in range(20)] + ["long " * 60_000, None, "", "token = abcdefghijklmnop0123"]
    rows = [(i, t, "en", "ab"[i % 2], 1, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    schema = SCHEMA + "".join(f", `{n}` string" for n in names)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        if name != "packing":
            assert docs.columns == given.columns
            for r in docs.collect():
                assert all(r[n] == f"{n}{r['doc_id']}" for n in names)

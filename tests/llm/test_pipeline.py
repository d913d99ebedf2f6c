"""The pipeline's stages on a small corpus, and the registered queries."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    en = ["the", "house", "water", "stone", "river", "light", "over", "under", "shall", "which", "there", "other"]
    de = ["straße", "und", "nicht", "wasser", "schön", "über", "zwischen", "größe", "licht", "fluss", "haben", "werden"]
    text = lambda own, n: " ".join(rng.choice(own) + rng.choice(own) for _ in range(n))
    items = [(i, text(en, 20)) for i in range(3)]
    docs = [(i, text(en if i % 2 else de, 80), "en" if i % 2 else "de", "s", 0) for i in range(60)]
    near = docs[1][1].split()
    near[10] = "changed"
    docs += [(100, docs[0][1], "de", "s", 0), (101, " ".join(near), "en", "s", 0), (102, f"{text(en, 30)} {items[1][1]} {text(en, 30)}", "en", "s", 0), (103, "12 34 !!", None, "s", 0), (104, None, "en", "s", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, current = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == frame.columns
        kept.append({r.doc_id for r in current.select("doc_id").collect()})
    every = {d[0] for d in docs}
    assert kept[0] == every - {103, 104}
    assert kept[1] == kept[0] - {100, 101}
    assert kept[2] == kept[1] - {102}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == kept[2] and out.where(~F.col("round_trip")).count() == 0


def test_null_ids_are_judged_by_their_texts(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"before {item} after"), (2, "clean one"), (None, f"null {item} id"), (None, "clean too"), (None, None)]
    out = corpus_pipeline.remove_benchmark_passages(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, ""), (0, "clean too"), (2, "clean one")]


def test_each_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)

from __future__ import annotations

import random

from conftest_llm import make_docs, words


def test_run(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    texts = [words(rng, rng.randint(30, 90)) for _ in range(60)]
    bad = [None, "", "12 34", texts[0], texts[1] + " more", "password=abcdefghijklmnop " + words(rng, 40)]
    docs = make_docs(spark, texts + bad, sources=[rng.choice("abc") for _ in range(66)], langs=["xx"] * 66).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now
        if name != "packing":
            assert now.columns == docs.columns
    ids = {n: {r.doc_id for r in df.collect()} for n, df in seen.items()}
    assert ids["languages"] == set(range(60)) | {63, 64, 65}
    assert ids["near_duplicates"] == set(range(60)) | {65}
    clean = {r.doc_id: r for r in seen["secrets"].collect()}
    assert clean[65].text.startswith("[secret]") and clean[65].n_chars == len(clean[65].text) and clean[5].text == texts[5]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == seen["packing"].columns and whole.count() > 0
    assert sum(r.length for r in whole.collect()) == sum(r.length for r in seen["packing"].collect())


def test_empty(spark, tmp_path):
    import corpus_pipeline

    make_docs(spark, ["a"]).limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

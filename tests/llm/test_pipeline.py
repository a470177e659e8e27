"""The pipeline's stages on a small corpus: decisions take effect, clean documents stay."""

import numpy as np

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(0)
    vocab = [f"{a}{b}{c}" for a in "bdfgklmp" for b in "aeiou" for c in "lmnrst"]
    text = [" ".join(rng.choice(vocab, 60)) for _ in range(40)]
    leak = " ".join(rng.choice(vocab, 25))
    rows = [(i, t) for i, t in enumerate(text)]
    rows += [(100, text[3]), (101, text[4] + " bal"), (102, "12345 67890"), (103, None), (104, text[5][:150] + " " + leak + "\n" + " ".join(rng.choice(vocab, 40)))]
    docs = spark.createDataFrame([(i, t, "xx", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == list(range(40)) and len({(r.slot, r.pos) for r in out}) == 40
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "mix_sources"]
    kept = corpus_pipeline.identify_language(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {102, 103}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.columns == corpus_pipeline.COLUMNS

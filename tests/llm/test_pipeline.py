import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, tmp_path):
    words = [f"q{i * 7919 % 9973}" for i in range(600)]
    text = lambda k: " ".join(words[k : k + 200])
    rows = [(1, text(0)), (2, " " + text(0) + "\n"), (3, text(0) + " ,"), (4, text(250)), (5, None), (6, "12 34"), (7, text(300) + " " + " ".join(f"z{i}" for i in range(20)))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"z{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append((name, sorted(r.doc_id for r in docs.collect())))
    assert left[0] == ("language", [1, 2, 3, 4, 7]) and left[1] == ("exact", [2, 3, 4, 7])
    assert left[2] == ("near", [2, 4, 7]) and left[3] == ("benchmark", [2, 4])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(left[3][1])

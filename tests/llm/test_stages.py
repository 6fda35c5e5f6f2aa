"""The leak stage on its own: what goes, and that all else stays as it is."""

import corpus_pipeline

from palindra.llm import decontamination


def test_leaks_go_and_the_rest_stays(spark, tmp_path, monkeypatch):
    items = [(i, f"Which of the old harbours number {i} was it that the grey ship number {i} left at dawn? The one by mill {i} on the river bend.") for i in range(9)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(1, "Nothing of it.", "a"), (None, None, "b"), (2, "", "c"), (2, "", "c"), (3, "harbours ship dawn river " * 400, "d"), (None, "clean", None)]
    bad = [(None, items[4][1], "e"), (1, "x " * 3000 + items[7][1] + " y" * 50, "f"), (9, items[0][1], None)]
    docs = spark.createDataFrame(clean + bad, "doc_id bigint, text string, score string").repartition(2)
    for part in (decontamination.PART_BYTES, 200):
        monkeypatch.setattr(decontamination, "PART_BYTES", part)
        left = corpus_pipeline.leaks(spark, docs, str(tmp_path))
        assert left.columns == docs.columns
        assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, clean))
        assert corpus_pipeline.leaks(spark, docs.where("false"), str(tmp_path)).collect() == []

"""Builds in several runs: ids left out, places continued, runs that break off."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from palindra.operators import exclusion
from palindra.operators.packing import PackSettings
from palindra.plans import corpus
from palindra.plans.resume import ResumedBuild
from palindra.streaming.build import StreamBuild
from tests.own_tables import conversations, documents

SETTINGS = PackSettings(60_000, Fraction(1, 5), 4_000, 7_000, 64)


def listed(blocks):
    return sorted((r.split, r.stream, r.shard, r.block, r.block_idx, " ".join(r.tokens)) for r in blocks.collect())


@pytest.fixture(scope="module")
def tables(spark):
    return documents(spark, 1200), conversations(spark, 800)


@pytest.mark.parametrize("most", [exclusion.MOST_BYTES, 0])
@pytest.mark.parametrize("bits_per_id", [16, 1])
def test_not_used(spark, most, bits_per_id, monkeypatch):
    monkeypatch.setattr(exclusion, "MOST_BYTES", most)
    monkeypatch.setattr(exclusion, "BITS_PER_ID", bits_per_id)
    monkeypatch.setattr(exclusion, "_ROW_BITS", 1 << 10)  # a full filter holds new ids too
    rows = [(i, f"s{i % 3}", i) for i in range(5000)] + [(None, "s0", -1), (7, None, -2), (6001, "s0", -3), (6001, "s0", -3)]
    all_rows = spark.createDataFrame(rows, "a bigint, b string, c bigint")
    used = spark.createDataFrame([r[:2] for r in rows if r[2] % 2 == 0], "a bigint, b string")
    left = exclusion.not_used(all_rows, used.unionByName(used), ["a", "b"])
    keys = {r[:2] for r in rows if r[2] % 2 == 0 and None not in r[:2]}
    assert sorted(r.c for r in left.collect()) == sorted(r[2] for r in rows if r[:2] not in keys)
    assert exclusion.not_used(all_rows, used.where("false"), ["a", "b"]).count() == len(rows)


def test_filter_holds_all_used_and_few_others(spark):
    used = spark.range(0, 20_000).withColumnRenamed("id", "a")
    bits = exclusion.filter_size(20_000)
    table = exclusion.bloom_filter(used, ["a"], bits)
    held = exclusion.with_hold(spark.range(0, 60_000).withColumnRenamed("id", "a"), table, ["a"], bits, "held")
    assert held.where("held and a < 20000").count() == 20_000
    assert held.where("held and a >= 20000").count() < 0.03 * 40_000


def test_runs_add_up_to_one(spark, tables, tmp_path):
    docs, turns = tables
    whole = corpus.build(docs, turns, SETTINGS)
    job = ResumedBuild(str(tmp_path / "corpus"), SETTINGS)
    for share in (0.3, 0.3, 1.0):  # the second one finds nothing new
        job.run(docs.where(F.col("doc_id") < 1200 * share), turns.where(F.col("conv_id") < 800 * share))
    assert job.is_complete(spark)
    assert listed(job.blocks(spark)) == listed(whole.blocks())
    counts = {r.source: (r.docs, r.tokens, r.val_docs) for r in job.counts(spark).collect()}
    assert counts == {r.source: (r.docs, r.tokens, r.val_docs) for r in whole.counts().collect()}
    files = sorted(map(str, tmp_path.rglob("*")))
    assert not job.run(docs, turns)
    assert sorted(map(str, tmp_path.rglob("*"))) == files


def test_a_run_without_progress_is_done_again(spark, tables, tmp_path):
    docs, turns = tables
    folder = str(tmp_path / "corpus")
    job = ResumedBuild(folder, SETTINGS)
    job.run(docs.where("doc_id < 400"), turns.where("conv_id < 300"))
    # Broken off behind its parts, with rows that no later run has.
    lost = job.parts(spark).limit(5).withColumn("doc", F.lit(10**9).cast("bigint"))
    lost.write.parquet(f"{folder}/parts/run=1")
    job.used(spark).drop("run").where("doc > 0").write.parquet(f"{folder}/used/run=1")
    assert job.parts(spark).where("doc = 1000000000").count() == 0
    job.run(docs, turns)
    assert listed(job.blocks(spark)) == listed(corpus.build(docs, turns, SETTINGS).blocks())


def test_other_settings_are_an_error(spark, tables, tmp_path):
    docs, turns = tables
    ResumedBuild(str(tmp_path), SETTINGS).run(docs.limit(50), turns.where("conv_id < 20"))
    with pytest.raises(ValueError, match="other settings"):
        ResumedBuild(str(tmp_path), PackSettings(60_000, Fraction(1, 5), 4_000, 7_001, 64)).run(docs, turns)


def test_runs_of_nothing(spark, tables, tmp_path):
    docs, turns = tables
    job = ResumedBuild(str(tmp_path), SETTINGS)
    assert job.run(docs.where("false"), turns.where("false"))
    assert not job.is_complete(spark)
    assert job.blocks(spark).count() == 0


def test_ids_only_grow(spark, tables, tmp_path):
    docs, turns = tables
    job = ResumedBuild(str(tmp_path), SETTINGS, ids=True)
    job.run(docs.where("doc_id < 300"), turns.where("conv_id < 100"))
    first = {r.token: r.id for r in job.words(spark).collect()}
    more = docs.withColumn("text", F.concat("text", F.when(F.col("doc_id") % 7 == 0, " quince").otherwise("")))
    job.run(more, turns)
    last = {r.token: r.id for r in job.words(spark).collect()}
    assert first.items() <= last.items() and " quince" in last and sorted(last.values()) == list(range(len(last)))
    spelled = {i: t for t, i in last.items()}
    plain = ResumedBuild(str(tmp_path / "plain"), SETTINGS)
    plain.run(docs.where("doc_id < 300"), turns.where("conv_id < 100"))
    plain.run(more, turns)
    found = sorted((r.split, r.block_idx, " ".join(spelled[i] for i in r.tokens)) for r in job.blocks(spark).collect())
    assert found == sorted((r.split, r.block_idx, " ".join(r.tokens)) for r in plain.blocks(spark).collect())


def test_streams_add_up_to_one_build(spark, tables, tmp_path):
    docs, turns = tables
    job = StreamBuild(str(tmp_path / "job"), SETTINGS)
    for lo, hi in ((0.0, 0.4), (0.4, 1.0)):
        for rows, key, n in ((docs, "doc_id", 1200), (turns, "conv_id", 800)):
            part = rows.where((F.col(key) >= n * lo) & (F.col(key) < n * hi))
            part.write.mode("append").parquet(str(tmp_path / key))
        streams = [spark.readStream.schema(t.schema).parquet(str(tmp_path / k)) for t, k in ((docs, "doc_id"), (turns, "conv_id"))]
        job.start(*streams).awaitTermination()
    whole = listed(corpus.build(docs, turns, SETTINGS).blocks())
    assert listed(job.build.blocks(spark)) == whole
    # A batch that Spark hands out again changes nothing.
    tagged = docs.limit(9).selectExpr("'web' source", "doc_id + 5000 doc", "0L turn", "'' role", "text")
    job.take(tagged, 0)
    assert listed(job.build.blocks(spark)) == whole

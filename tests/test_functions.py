import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palindra.functions import permute, schedule, vectors
from palindra.operators import diagnostics, vocabulary
from palindra.functions import text as txt


def mix_int(x, key):
    x = (x + key) % 2**32
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x = ((x ^ (x >> shift)) * factor) % 2**32
    return x ^ (x >> 16)


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 65537])
def test_permutation_is_a_bijection(n):
    index = np.arange(n)
    image = permute.permute_batch(index, np.full(n, n), np.full(n, 1337))
    assert sorted(image.tolist()) == list(range(n))
    other = permute.permute_batch(index, np.full(n, n), np.full(n, 1338))
    assert n < 10 or (image != other).any()


def test_permutation_in_spark_with_sizes_per_row(spark):
    df = spark.range(300).selectExpr("id % 50 as i", "50 + id div 50 * 7 as n", "id div 50 as seed")
    got = df.select("i", "n", "seed", permute.permuted("i", "n", "seed").alias("p")).collect()
    for r in got:
        assert r.p == permute.permute_batch(np.array([r.i]), np.array([r.n]), np.array([r.seed]))[0]
        assert 0 <= r.p < r.n
    assert len({(r.n, r.p) for r in got}) == 300


def test_mixer_in_both_forms(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2**32), rng.randrange(2**32)) for _ in range(200)] + [(2**32 - 1, 2**32 - 1)]
    got = spark.createDataFrame(rows, "x bigint, k bigint").select("x", "k", permute.mix(F.col("x"), F.col("k")).alias("m"))
    assert all(r.m == mix_int(r.x, r.k) for r in got.collect())
    x, k = (np.array(c, dtype=np.uint64) for c in zip(*rows))
    assert permute._mix_batch(x, k).tolist() == [mix_int(*r) for r in rows]


def test_schedule(spark):
    s = schedule.Schedule(lr=1.0, min_lr=0.1, warmup_steps=4, decay_steps=16)
    df = spark.createDataFrame([(0, None), (3, None), (4, None), (99, None), (9, 10), (10, 10), (14, 10), (26, 10), (50, 10)], "step bigint, d bigint")
    at = (F.col("step"), F.col("d"), s)
    got = df.select(schedule.learning_rate(*at).alias("lr"), schedule.phase(*at).alias("phase"), schedule.snapped_rate(*at).alias("q")).collect()
    assert [round(r.lr, 9) for r in got] == [0.25, 1.0, 1.0, 1.0, 1.0, 1.0, 0.55, 0.1, 0.1]
    assert [r.phase for r in got] == ["warmup", "warmup", *["constant"] * 3, "decay", "decay", "done", "done"]
    assert got[6].q == round(0.55 * 32) / 32
    free = schedule.Schedule(lr=0.0, min_lr=0.0)
    assert df.select(schedule.snapped_rate(F.col("step"), F.col("d"), free).alias("q")).first().q == 0.0


def test_planning_columns(spark):
    h = F.col("h")
    df = spark.createDataFrame([(0.5,), (11.3,)], "h double")
    got = df.select(schedule.train_hours(h).alias("t"), schedule.planned_decay_steps(h).alias("d"), schedule.milestone_minutes(h).alias("m")).collect()
    assert [(round(r.t, 6), r.d, r.m) for r in got] == [(0.4, 200, 15), (10.85, 1302, 81)]
    assert df.select(schedule.disk_gb_needed(F.lit(2e9), F.lit(5e8), F.lit(4)).alias("g")).first().g == 14.0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 17)).round(1)
    df = spark.createDataFrame([(i, v.tolist(), i % 18 - 1) for i, v in enumerate(x)], "i bigint, v array<double>, t int")
    p = vectors.softmax(F.col("v"))
    got = df.select("i", p.alias("p"), vectors.entropy(p).alias("h"), vectors.best(F.col("v")).alias("b"), vectors.top(F.col("v"), 5).alias("top"), vectors.kept_by_top_k(F.col("v"), 4).alias("kept"), vectors.masked_top_k(F.col("v"), 4).alias("masked"), vectors.cross_entropy(F.col("v"), F.col("t")).alias("ce")).collect()
    for r in got:
        v = x[r.i]
        q = np.exp(v - v.max()) / np.exp(v - v.max()).sum()
        assert np.allclose(r.p, q) and math.isclose(r.h, -(q * np.log(q)).sum())
        assert r.b == v.argmax()
        assert [s.id for s in r.top] == np.argsort(-v, kind="stable")[:5].tolist()
        kth = sorted(v)[-4]
        assert r.kept == np.flatnonzero(v >= kth).tolist()
        assert [m == float("-inf") for m in r.masked] == (v < kth).tolist()
        assert (r.ce is None) if r.i % 18 == 0 else math.isclose(r.ce, -math.log(q[r.i % 18 - 1]))
    assert len(df.select(vectors.kept_by_top_k(F.col("v"), 99).alias("k")).first().k) == 17


def test_agreement_and_tolerances(spark):
    a = spark.createDataFrame([(1, [3.0, -4.0]), (2, [0.0, 1.0])], "i bigint, v array<double>")
    b = spark.createDataFrame([(1, [3.0, -4.01]), (2, [0.0, 1.0])], "i bigint, v array<double>")
    kinds = ("float32", "float16", "bfloat16", "other")
    found = {r.dtype: r for r in diagnostics.agreement(a, b, "i", "v", *kinds).collect()}
    assert all(math.isclose(r.relative, 0.0025) for r in found.values())
    assert [found[d].ok for d in kinds] == [False, False, True, False]
    short = b.where("i = 2").withColumn("v", F.slice("v", 1, 1))
    for other, n in ((b.where("i = 2"), 1), (short, 2), (b.limit(0), 2)):
        row = diagnostics.agreement(a, other, "i", "v", "bfloat16").first()
        assert (row.unmatched, row.ok) == (n, False)
        assert not diagnostics.agreement(other, a, "i", "v", "bfloat16").first().ok
    none = diagnostics.agreement(a.limit(0), b.limit(0), "i", "v", "float32").first()
    assert none.ok and none.delta is None


def test_draws_follow_their_probabilities(spark):
    df = spark.range(20_000).select("id", F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2), F.lit(0.0)).alias("p"))
    drawn = df.select(diagnostics.draw(F.col("p"), F.col("id"), 7).alias("d"))
    share = {r.d: r["count"] / 20_000 for r in drawn.groupBy("d").count().collect()}
    assert 3 not in share and all(abs(share[i] - q) < 0.02 for i, q in enumerate((0.5, 0.3, 0.2)))
    assert drawn.exceptAll(df.repartition(3).select(diagnostics.draw(F.col("p"), F.col("id"), 7).alias("d"))).count() == 0


def test_vocabulary_and_both_lookups(spark, monkeypatch):
    texts = [(1, "b a a <|im_end|>"), (2, " a a\nc"), (3, "é <|im_start|>é")]
    docs = spark.createDataFrame(texts, "doc bigint, text string")
    toks = docs.select("doc", txt.tokens(F.col("text")).alias("tokens"))
    words = vocabulary.build(vocabulary.count_tokens(toks))
    table = {r.token: r.id for r in words.collect()}
    assert table[txt.EOS] == 0 and table[txt.IM_START] == 1 and table[txt.IM_END] == 2 and table[" a"] == 3
    assert sorted(table.values()) == list(range(len(table)))
    assert vocabulary.missing_markers(words).count() == 0
    assert vocabulary.missing_markers(words.where("id <> 2")).first().token == txt.IM_END
    assert vocabulary.separator_id(words).first().eos_id == 0
    assert vocabulary.separator_id(words.where("id <> 0")).first().eos_id == 2
    for head, size in ((1 << 18, 256), (4, 256), (1 << 18, 1)):
        monkeypatch.setattr(vocabulary, "HEAD", head)
        monkeypatch.setattr(vocabulary, "HEAD_TOKEN_BYTES", size)
        ids = vocabulary.encode_texts(docs, words)
        back = vocabulary.gather(vocabulary.decode(ids.select("doc", F.posexplode("ids").alias("pos", "id")), words), ["doc"], "token", "t")
        assert {r.doc: "".join(r.t) for r in back.collect()} == dict(texts)
    assert vocabulary.outside(ids, len(table)).count() == 0
    assert vocabulary.outside(ids, 5).count() == 3


def test_unknown_tokens_are_errors_whatever_the_size(spark, monkeypatch):
    rule = "-" * 300
    words = vocabulary.build(spark.createDataFrame([("a", 5), (rule, 4), ("b", 3), ("c", 1)], "token string, n bigint"))
    good = spark.createDataFrame([(1, ["a", rule, "c", rule]), (2, []), (3, None), (4, ["b"])], "doc bigint, tokens array<string>")
    bad = spark.createDataFrame([(1, ["a", "zzz", "b"])], "doc bigint, tokens array<string>")
    seen = []
    for head in (1 << 20, 4, 0):
        monkeypatch.setattr(vocabulary, "HEAD", head)
        got = {r.doc: r.tokens for r in vocabulary.encode_arrays(good, ["doc"], "tokens", words).collect()}
        seen.append({k: v or None for k, v in got.items()})
        assert got[1] == [3, 4, 6, 4] and got[4] == [5]
        back = vocabulary.decode(spark.createDataFrame([(0, 4), (1, 3), (2, 6)], "at bigint, id bigint"), words)
        assert {r["at"]: r.token for r in back.collect()} == {0: rule, 1: "a", 2: "c"}
        with pytest.raises(Exception, match="a token is not in the vocabulary"):
            vocabulary.encode_arrays(bad, ["doc"], "tokens", words).collect()
        with pytest.raises(Exception, match="an id is not in the vocabulary"):
            vocabulary.decode(spark.createDataFrame([(0, 99)], "at bigint, id bigint"), words).collect()
    assert seen[0] == seen[1] == seen[2]


def test_arrays_are_decoded_in_place(spark, monkeypatch):
    """Head, tail, long tokens and unknown ids; no row per token is shuffled."""
    rule = "-" * 300
    words = vocabulary.build(spark.createDataFrame([("a", 5), (rule, 4), ("b", 3), ("c", 1)], "token string, n bigint"))
    ids = spark.createDataFrame([(1, [3, 4, 6, 4, 3]), (2, []), (4, [5])], "doc bigint, ids array<bigint>")
    bad = spark.createDataFrame([(1, [3, 99, 5])], "doc bigint, ids array<bigint>")
    for head in (1 << 20, 4, 0):
        monkeypatch.setattr(vocabulary, "HEAD", head)
        got = {r.doc: r.ids for r in vocabulary.decode_arrays(ids, ["doc"], "ids", words).collect()}
        assert got == {1: ["a", rule, "c", rule, "a"], 2: [], 4: ["b"]}
        with pytest.raises(Exception, match="an id is not in the vocabulary"):
            vocabulary.decode_arrays(bad, ["doc"], "ids", words).collect()


def test_decode_ids_does_not_shuffle_a_row_per_token(spark):
    import __spark_entry__ as entry_point

    df = entry_point.queries()["decode_ids"](spark, "/root/testdata/sf0.001")
    assert "posexplode" not in df._jdf.queryExecution().executedPlan().toString()

import random
import struct

import pytest
from pyspark.sql import functions as F

from palindra.operators import ordered, runlog
from palindra.operators.ordered import Running
from palindra.session import stage


def _naive(rows):
    out, seen = {}, {}
    for key, at, value in sorted(rows):
        past = seen.setdefault(key, [])
        known = [v for v in past if v is not None]
        out[key, at] = (
            sum(known),
            min(known, default=None),
            max(known, default=None),
            known[-1] if known else None,
        )
        past.append(value)
    return out


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_running_matches_a_plain_loop(spark, monkeypatch, limit):
    """Dense, sparse and 62-bit orders; one key holds most rows; both recursions."""
    monkeypatch.setattr(ordered, "ONE_WINDOW", limit)
    rng = random.Random(3)
    rows = [(0, i, rng.choice([None, rng.randrange(100)])) for i in range(600)]
    rows += [(1, at, rng.randrange(100)) for at in rng.sample(range(1 << 62), 200)]
    rows += [(k, 5 * k, rng.randrange(9)) for k in range(2, 40)]
    df = spark.createDataFrame(rows, "k bigint, at bigint, v bigint").repartition(5)
    kinds = ["sum", "min", "max", "last"]
    got = ordered.running(
        df, ["k"], ["at"], [Running(x, F.col("v"), f"r_{x}") for x in kinds], {"at": (4, 5, 18)}
    ).collect()
    want = _naive(rows)
    assert {(r.k, r.at): tuple(r[f"r_{x}"] for x in kinds) for r in got} == want


def test_running_over_two_order_columns(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ONE_WINDOW", 0)
    rng = random.Random(4)
    rows = [(d, p, rng.randrange(1, 9)) for d in rng.sample(range(10_000), 50) for p in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "d bigint, p bigint, n bigint").repartition(4)
    got = ordered.running(
        df, [], ["d", "p"], [Running("sum", F.col("n"), "start")], {"d": (3, 4), "p": (2,)}
    )
    start, want = 0, {}
    for d, p, n in sorted(rows):
        want[d, p] = start
        start += n
    assert {(r.d, r.p): r.start for r in got.collect()} == want


def test_one_window_per_key_starts_at_zero(spark):
    df = spark.createDataFrame([(k, i, 2) for k in range(3) for i in range(4)], "k bigint, i bigint, n bigint")
    got = ordered.running(df, ["k"], ["i"], [Running("sum", F.col("n"), "s")], {"i": ()}).collect()
    assert all(r.s == 2 * r.i for r in got) and len(got) == 12


def test_last_can_carry_a_struct(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 5000, "c")], "k bigint, at bigint, s string")
    prev = ordered.running(df, ["k"], ["at"], [Running("last", F.struct("at", "s"), "p")]).orderBy("at").collect()
    assert [r.p and tuple(r.p) for r in prev] == [None, (1, "a"), (2, None)]


def test_dense_index_numbers_all_rows(spark):
    rows = [(w, n) for n, w in enumerate(["b", "a", "é", "Z", "aa", ""] * 50)]
    df = spark.createDataFrame(rows, "w string, n bigint").repartition(7)
    got = ordered.dense_index(df, [F.asc("w"), F.desc("n")], "i").orderBy("i").collect()
    assert [r.i for r in got] == list(range(len(rows)))
    assert [(r.w, r.n) for r in got] == sorted(rows, key=lambda r: (r[0].encode(), -r[1]))


def test_sort_key_is_the_order_of_doubles(spark):
    rng = random.Random(5)
    values = [0.0, 1.0, 2.0, 0.5, 1.5, 1e-300, 1e300, 4.0 - 2**-51, 2.0 - 2**-52, 3e-9]
    values += [rng.random() * 10 ** rng.randrange(-12, 12) for _ in range(500)]
    values += [struct.unpack("<d", struct.pack("<q", struct.unpack("<q", struct.pack("<d", v))[0] + 1))[0] for v in values[1:50]]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered.sort_key(F.col("v")).alias("k")).collect()
    by_key = sorted(set((r.k, r.v) for r in got))
    assert [v for _, v in by_key] == sorted(set(values))
    assert len({k for k, _ in by_key}) == len(by_key)


def test_upper_median_takes_the_upper_middle(spark):
    rng = random.Random(6)
    groups = {0: [1.0, 2.0, 3.0, 4.0], 1: [7.5], 2: [rng.random() for _ in range(999)], 3: [0.0, 0.0, 0.1, 5.0, 0.1]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [(9, None)]
    got = ordered.upper_median(spark.createDataFrame(rows, "k bigint, v double"), ["k"], "v", "m").collect()
    assert {r.k: r.m for r in got} == {k: sorted(v)[len(v) // 2] for k, v in groups.items()}


def test_newest_and_totals_on_a_hot_key(spark):
    rows = [(0, i) for i in range(3000)] + [(k, 7) for k in range(1, 20)]
    df = spark.createDataFrame(rows, "k bigint, at bigint").repartition(6)
    spread = F.pmod("at", F.lit(64))
    top = ordered.newest(df, ["k"], [F.desc("at")], 3, spread).collect()
    assert {(r.k, r["rank"]): r.at for r in top if r.k == 0} == {(0, 1): 2999, (0, 2): 2998, (0, 3): 2997}
    assert sum(1 for r in top if r.k > 0) == 19
    all_ = ordered.attach_totals(df, ["k"], spread, {"n": F.count("*"), "hi": F.max("at")}).collect()
    assert len(all_) == len(rows)
    assert {(r.k, r.n, r.hi) for r in all_} == {(0, 3000, 2999)} | {(k, 1, 7) for k in range(1, 20)}


@pytest.mark.parametrize("bits", [1, 6])
def test_affine(spark, bits, monkeypatch):
    monkeypatch.setattr(ordered, "MAP_BITS", bits)
    rnd = random.Random(6)
    rows, want = [], {}
    for key, n in (("a", 300), ("b", 1), ("c", 64), ("d", 65)):
        x = 0.0
        for i in sorted(rnd.sample(range(3 * n), n)):
            a, b = rnd.choice([0.5, 0.9, 1.0, 1.1]), rnd.uniform(-1, 1)
            rows.append((key, i, a, b))
            want[key, i] = x
            x = a * x + b
    df = spark.createDataFrame(rows, "k string, i bigint, a double, b double").repartition(5)
    found = {(r.k, r.i): r.x for r in ordered.affine(df, ["k"], "i", F.col("a"), F.col("b"), "x").collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


def test_affine_keeps_infinity(spark):
    rows = [("k", i, 1e-200, float("inf") if i == 3 else 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i bigint, a double, b double")
    found = {r.i: r.x for r in ordered.affine(df, ["k"], "i", F.col("a"), F.col("b"), "x").collect()}
    assert all((found[i] == float("inf")) == (i > 3) for i in found)


def test_average_of_a_million_lines_of_one_run(spark):
    n = 1_000_000
    log = spark.range(n).select(F.lit(1).cast("bigint").alias("run_id"), F.col("id").alias("seq"), (F.col("id") % 97).cast("double").alias("loss"))
    ema = runlog.smoothed_loss(log)
    some = {r.seq: r.ema for r in ema.where("seq % 99991 = 7 or seq = 999999").collect()}
    x, want = None, {}
    for i in range(n):
        x = float(i % 97) if x is None else 0.9 * x + 0.1 * (i % 97)
        if i in some:
            want[i] = x
    assert len(some) == 12 and all(some[i] == pytest.approx(want[i], rel=1e-9) for i in some)


def test_attach_does_not_broadcast_the_repeated_table(spark):
    """The repeated table is ``parts`` times larger than its estimate; it is joined by a shuffle."""
    rows = [(k, at) for k in range(50) for at in range(40)]
    df = spark.createDataFrame(rows, "k bigint, at bigint")
    per_key = stage(df.groupBy("k").agg(F.max("at").alias("hi")), "test-per-key")
    joined = ordered.attach(df, ["k"], F.pmod("at", F.lit(64)), F.lit(64).cast("bigint"), per_key)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert sorted((r.k, r.at, r.hi) for r in joined.collect()) == sorted((k, at, 39) for k, at in rows)

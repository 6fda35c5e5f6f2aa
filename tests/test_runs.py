import json
import math
import random

import pytest
from pyspark.sql import functions as F

from palindra.operators import inventory, ordered, runlog
from palindra.sources import corpora, manifests, registry, runs, shards
from palindra.streaming import runs as live
from palindra.streaming.state import VersionedTable

LOG = "run_id bigint, seq bigint, attempt bigint, step bigint, wall_s double, loss double, val_loss double"


def make_log(rng, n_runs=4, longest=3000):
    rows = []
    for run in range(n_runs):
        step, wall, attempt = 0, 0.0, 0
        for seq in range(longest if run == 0 else rng.randrange(2, 60)):
            if rng.random() < 0.02:
                wall, attempt = 0.0, attempt + 1
                step -= rng.choice([0, 0, 20, 40])
            step, wall = step + 20, wall + rng.random() + 0.01
            loss = None if rng.random() < 0.03 else round(2 + rng.random(), 5)
            val = round(2 + rng.random(), 5) if rng.random() < 0.1 else None
            rows.append((run, 3 * seq, attempt, step, wall, loss, val))
    return rows


@pytest.fixture(autouse=True)
def narrow_chunks(monkeypatch):
    """Chunks so small that a test log has several levels of them."""
    monkeypatch.setattr(ordered, "ID_BITS", (6, 5, 18))


@pytest.fixture(scope="module")
def log_rows():
    return make_log(random.Random(9))


@pytest.fixture(scope="module")
def log(spark, log_rows):
    return spark.createDataFrame(log_rows, LOG).repartition(5).persist()


def by_run(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r)
    return out


def test_restart_verdicts(log, log_rows):
    want = {}
    for run, rows in by_run(log_rows).items():
        pairs = list(zip(rows, rows[1:]))
        calm = sorted(abs(b[5] - a[5]) for a, b in pairs if b[4] >= a[4] and None not in (a[5], b[5]))
        limit = max(0.05, 4 * (calm[len(calm) // 2] if calm else 0.0))
        for a, b in pairs:
            if b[4] < a[4]:
                jump = None if None in (a[5], b[5]) else b[5] - a[5]
                want[run, b[1]] = (b[3] - a[3], jump, limit, b[3] > a[3] and jump is not None and jump <= limit)
    got = runlog.restart_verdicts(log).collect()
    assert {(r.run_id, r.seq): (r.step_gap, r.delta, r.limit, r.ok) for r in got} == want
    summary = {r.run_id: r for r in runlog.restart_summary(log).collect()}
    assert summary[0].restarts == sum(1 for k in want if k[0] == 0)
    assert summary[0].bad == sum(1 for k, v in want.items() if k[0] == 0 and not v[3])
    assert sum(r.log_rows for r in summary.values()) == len(log_rows)


def test_sessions_count_restarts(log, log_rows):
    got = {(r.run_id, r.seq): r.session for r in runlog.attempts(log).collect()}
    for run, rows in by_run(log_rows).items():
        n = 0
        for i, r in enumerate(rows):
            n += i > 0 and r[4] < rows[i - 1][4]
            assert got[run, r[1]] == n


def test_ema_equals_the_fold(log, log_rows):
    got = {(r.run_id, r.seq): r.ema for r in runlog.smoothed_loss(log).collect()}
    assert len(got) == len(log_rows)
    for run, rows in by_run(log_rows).items():
        ema = None
        for r in rows:
            if r[5] is None:
                assert got[run, r[1]] is None
                continue
            ema = r[5] if ema is None else 0.9 * ema + 0.1 * r[5]
            assert math.isclose(got[run, r[1]], ema, rel_tol=1e-11)


def test_throughput_and_evaluations(log, log_rows):
    speed = {(r.run_id, r.seq): r for r in runlog.throughput(log, 1000).collect()}
    evals = log.where("val_loss is not null").select("run_id", "attempt", "seq", "val_loss")
    seen = {(r.run_id, r.seq): r for r in runlog.with_evaluations(log.drop("val_loss"), evals).collect()}
    for run, rows in by_run(log_rows).items():
        best = latest = before = None
        for r in rows:
            if before is None or before[2] != r[2]:
                before = latest = None
            at = seen[run, r[1]]
            assert (at.val_loss, at.best_val) == (latest, best)
            s = speed[run, r[1]]
            if before is None:
                assert s.tok_per_s is None
            else:
                dt, ds = max(1e-6, r[4] - before[4]), max(1, r[3] - before[3])
                assert math.isclose(s.tok_per_s, ds * 1000 / dt) and math.isclose(s.secs_per_step, dt / ds)
            if r[6] is not None:
                latest, best = r[6], r[6] if best is None else min(best, r[6])
            before = r


def test_tail_recent_and_bins(log, log_rows):
    runs_ = by_run(log_rows)
    tail = runlog.tail(log, 7).collect()
    for run, rows in runs_.items():
        assert sorted(r.seq for r in tail if r.run_id == run) == [r[1] for r in rows[-7:]]
    recent = runlog.recent(log, 200).collect()
    assert len(recent) == sum(1 for rows in runs_.values() for r in rows if r[3] >= rows[-1][3] - 200)
    assert runlog.recent(log, 0) is log
    bins = runlog.chart_bins(log, ["loss", "val_loss"], 30, 10).collect()
    rows = runs_[0]
    xs = [r[3] for r in rows if r[5] is not None or r[6] is not None]
    lo, span = min(xs), max(xs) - min(xs)
    want = {}
    for r in rows:
        if r[5] is not None:
            want.setdefault(min(29, int((r[3] - lo) / span * 29)), []).append(r[5])
    got = {r["col"]: r.avg for r in bins if r.run_id == 0 and r.series == "loss"}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[c], sum(v) / len(v)) for c, v in want.items())
    assert all(0 <= r.row <= 9 for r in bins)


def test_liveness_states(spark):
    rows = [(1, 0.0, True, None, False), (2, 0.0, True, None, True), (3, -500.0, True, None, True), (4, -500.0, False, None, False), (5, 0.0, True, "deadline", False), (6, -500.0, False, "done", False)]
    df = spark.createDataFrame(rows, "run_id bigint, heartbeat double, alive boolean, stop_reason string, saving boolean")
    got = {r.run_id: (r.state, r.board_state) for r in runlog.liveness(df, F.lit(10.0)).collect()}
    assert got == {
        1: ("training", "training"),
        2: ("training (checkpointing)", "training"),
        3: ("quiet", "stalled"),
        4: ("stopped", "stalled"),
        5: ("finished (deadline)", "training"),
        6: ("finished (done)", "finished"),
    }
    marked = df.withColumn("exit_code", F.when(F.col("run_id") == 3, "0\n").when(F.col("run_id") == 4, "1"))
    assert {r.run_id: r.clean for r in live.finished(marked).collect()} == {3: True, 4: False, 5: True, 6: True}
    assert {r.run_id for r in live.given_up(df, F.lit(1000.0), F.lit(0.0)).collect()} == {1, 2, 3, 4, 5, 6}
    assert live.given_up(df, F.lit(1000.0), F.lit(500.0)).count() == 0


def test_log_files_keep_their_order(spark, tmp_path, monkeypatch):
    assert runs.read_log(spark, f"{tmp_path}/*/loss.csv").count() == 0
    for run in ("a", "b"):
        (tmp_path / run).mkdir()
        lines = [",".join(runs.LOG_FIELDS)]
        lines += [f"{20 * (i % 500)},{i}.5,,1e-4,2.{i},,{'' if i % 3 else '1.5'},,,,warmup" for i in range(2000)]
        (tmp_path / run / "loss.csv").write_text("\r\n".join(lines) + "\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = runs.read_log(spark, f"{tmp_path}/*/loss.csv").orderBy("run_id", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.run_id, r.wall_s) for r in rows] == [(k, i + 0.5) for k in "ab" for i in range(2000)]
    assert len({(r.run_id, r.seq) for r in rows}) == 4000
    assert rows[1].val_loss is None and rows[0].val_loss == 1.5 and rows[0].tokens is None
    out = f"{tmp_path}/appended/run"
    extra = spark.createDataFrame([(1, 2.5, "x")], "step bigint, loss double, other string")
    runs.append_log(extra, out)
    runs.append_log(extra, out)
    again = runs.read_log(spark, f"{out}/*.csv").collect()
    assert [(r.step, r.loss, r.val_loss, r.phase) for r in again] == [(1, 2.5, None, None)] * 2


def test_runs_in_folders_of_one_name_stay_apart(spark, tmp_path):
    row = spark.createDataFrame([(1, 2.5)], "step bigint, loss double")
    for at in ("a/run", "b/run"):
        runs.append_log(row, f"{tmp_path}/{at}")
        (tmp_path / at / "status.json").write_text('{"step": 3}')
    assert {r.run_id for r in runs.read_log(spark, f"{tmp_path}/*/run/*.csv").collect()} == {"a/run", "b/run"}
    assert {r.run_id for r in runs.read_log(spark, f"{tmp_path}/[ab]/*/*.csv").collect()} == {"a/run", "b/run"}
    assert {r.run_id for r in runs.read_log(spark, f"{tmp_path}/a/run/*.csv").collect()} == {"run"}
    assert {r.run_id for r in runs.read_status(spark, f"{tmp_path}/*/run/status.json").collect()} == {"a/run", "b/run"}


def test_losses_that_are_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    losses = [2.0] * 30 + [nan] + [1.0] * 6000
    rows = [(1, i, 0, 20 * i, float(i % 4000), x, None) for i, x in enumerate(losses)]
    rows += [(2, i, 0, 20 * i, float(i % 3), x, None) for i, x in enumerate([1.0, 1.5, inf, 2.0, 1.0, 1.25, 1.0, 1.1, -inf, 1.0])]
    log = spark.createDataFrame(rows, LOG)
    for keep in (0.9, 0.9999):
        ema = {}
        for r in runlog.smoothed_loss(log, keep).orderBy("run_id", "seq").collect():
            was = ema.get(r.run_id)
            want = r.loss if was is None else keep * was + (1 - keep) * r.loss
            ema[r.run_id] = want
            assert (math.isnan(want) and math.isnan(r.ema)) or want == r.ema or math.isclose(want, r.ema, rel_tol=1e-10), (r, want)
    found = {(r.run_id, r.seq): r.ok for r in runlog.restart_verdicts(log).collect()}
    assert found == {(1, 4000): True, (2, 3): False, (2, 6): True, (2, 9): False}
    assert {(r.run_id, r.bad) for r in runlog.restart_summary(log).collect()} == {(1, 0), (2, 2)}


def test_status_samples_and_listing(spark, tmp_path):
    assert runs.read_status(spark, f"{tmp_path}/*/status.json").count() == 0
    deep = tmp_path / "r1" / "x" / "y"
    deep.mkdir(parents=True)
    (deep / "z").mkdir()
    (tmp_path / "r2").mkdir()
    (tmp_path / "r1" / "status.json").write_text(json.dumps({"step": 5, "alive": True, "heartbeat": 1.5}, indent=1))
    (tmp_path / "r2" / "status.json").write_text('{"step": 5, "alive')
    got = runs.read_status(spark, f"{tmp_path}/*/status.json").collect()
    assert [(r.run_id, r.step, r.alive, r.heartbeat) for r in got] == [("r1", 5, True, 1.5)]
    assert runs.stamped(spark.createDataFrame([(1,)], "step bigint")).first().heartbeat > 1.7e9
    for step in (1, 2):
        runs.write_status(spark.createDataFrame([("r1", step)], "run_id string, step bigint"), f"{tmp_path}/table")
    kept = runs.read_status_table(spark, f"{tmp_path}/table").collect()
    assert [(r.run_id, r.step, r.loss) for r in kept] == [("r1", 2, None)] and kept[0].heartbeat > 1.7e9
    runs.write_status(spark.createDataFrame([("r2", 7), ("r3", 8)], "run_id string, step bigint"), f"{tmp_path}/table")
    runs.write_status(spark.createDataFrame([("r2", 9)], "run_id string, step bigint"), f"{tmp_path}/table")
    kept = runs.read_status_table(spark, f"{tmp_path}/table").collect()
    assert sorted((r.run_id, r.step) for r in kept) == [("r1", 2), ("r2", 9), ("r3", 8)]
    (tmp_path / "r1" / "samples.txt").write_text("step 20\tloss 3.5000\ta\tb c\nbroken line\nstep 40\tloss nan\t\n")
    samples = runs.read_samples(spark, f"{tmp_path}/r1/samples.txt").orderBy("step").collect()
    assert [(r.step, r.text) for r in samples] == [(20, "a\tb c"), (40, "")] and samples[0].loss == 3.5

    files = {"r1/ckpt_step10.pt": 9, "r1/x/weights_step20.pt": 8, "r1/x/y/milestone_step5.pt": 7, "r1/x/y/z/sft_step6.pt": 1, "r2/ckpt_step30.pt": 0, "r2/other.pt": 4, "r2/ckpt_step7.pt.tmp": 4}
    for name, size in files.items():
        (tmp_path / name).write_bytes(b"x" * size)
    (tmp_path / "r2" / "ckpt_step99.pt").mkdir()
    listing = runs.list_checkpoints(spark, str(tmp_path), str(tmp_path / "r1"))
    assert "content" not in listing.columns
    found = inventory.newest_first(inventory.parse_checkpoints(listing)).collect()
    # The second root brings the deepest file within reach; shared files count once.
    assert [(r.step, r.kind) for r in found] == [(20, "weights"), (10, "full"), (6, "sft"), (5, "milestone")]


def test_checkpoint_choices(spark):
    rows = [(1, f"/r/ckpt_step{s}.pt", 1, s) for s in range(1, 6)]
    rows += [(1, "/r/weights_step9.pt", 1, 50), (1, "/r/sft_step8.pt", 1, 99), (2, "/q/milestone_step3.pt", 1, 1), (2, "/q/weights_step4.pt", 1, 0)]
    found = inventory.parse_checkpoints(spark.createDataFrame(rows, "run bigint, path string, length bigint, mtime bigint"))
    assert {r.run: r.path for r in inventory.resume_pick(found, ["run"]).collect()} == {1: "/r/ckpt_step5.pt", 2: "/q/weights_step4.pt"}
    assert {r.run: r.path for r in inventory.export_pick(found, ["run"]).collect()} == {1: "/r/weights_step9.pt", 2: "/q/milestone_step3.pt"}
    gone = {r.path for r in inventory.expired(found, ["run"]).collect()}
    assert gone == {f"/r/ckpt_step{s}.pt" for s in (1, 2, 3)}
    assert inventory.expired(found, ["run"], {"full": 0}).count() == 5


def test_manifests(spark, tmp_path):
    texts = {
        "a": {"tokenizer": "t", "vocab_size": 10, "shards": {"train": ["w"], "val": []}, "total_tokens": 5},
        "b/c": {"base": "B", "base_key": "small", "dtype": "uint32", "direction": "both", "shards": {"train": ["w"]}, "total_tokens": 9, "sources": {"web": {"shards": ["w"], "docs": 2, "tokens": 9, "val_docs": 1}}},
        "d": {"total_tokens": 99},
    }
    for folder, content in texts.items():
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "meta.json").write_text(json.dumps(content, indent=1))
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "meta.json").write_text("{broken")
    rows = manifests.scan(spark, str(tmp_path), "meta.json")
    got = {r.path.rsplit("/", 1)[-1]: r for r in rows.collect()}
    assert set(got) == {"a", "c", "d"}
    assert (got["a"].base, got["a"].dtype, got["a"].direction, got["a"].val_tokens) == ("t", "uint16", "forward", 0)
    assert got["a"].sources["chat"].docs == 0 and got["c"].sources["web"].docs == 2
    assert inventory.largest_corpus(rows).first().path.endswith("b/c")
    assert inventory.largest_corpus(rows, got["a"].path).first().path == got["a"].path
    assert {r.path.rsplit("/", 1)[-1] for r in inventory.usable_corpora(rows).collect()} == {"a", "c"}
    done = inventory.completeness(manifests.source_table(rows.where(F.col("base") == "B")), 9, 0, True).first()
    assert done.complete and done.web_tokens == 9


def test_registry_and_configs(spark):
    table = {r.key: r for r in registry.bases(spark).collect()}
    assert table["small"].dtype == "uint16" and table["large"].dtype == "uint32" and table["large"].token_bytes == 4
    assert table["large-gpu"].hf_name == table["large"].hf_name and table["small"].tokens_per_step == 131_072
    rows = spark.createDataFrame([("large", "Qwen/Qwen3-0.6B-Base"), ("large", "x"), ("none", "x")], "base_key string, base string")
    assert inventory.base_mismatches(rows).count() == 2
    cols = "id bigint, base_key string, hf_name string, block_size bigint, vocab_size bigint"
    a = spark.createDataFrame([(1, "k", "n", 4, None), (2, "k", "n", 4, 5)], cols)
    b = spark.createDataFrame([(1, "k", "m", 4, 7), (2, "k", "n", 4, 5)], cols)
    diff = {(r.id, r.field): (r.saved, r.live) for r in inventory.config_differences(a, b, "id").collect()}
    assert diff == {(1, "hf_name"): ("n", "m"), (1, "vocab_size"): (None, "7")}
    maps = spark.range(1).select(F.create_map(F.lit("module.module._orig_mod.hf.w"), F.lit(1), F.lit("x.module.b"), F.lit(2)).alias("m"))
    assert maps.select(inventory.strip_wrappers(F.col("m")).alias("m")).first().m == {"w": 1, "x.module.b": 2}
    marks = "c string, fingerprint string"
    changed = inventory.fingerprint_changes(spark.createDataFrame([("p", "1"), ("q", "2")], marks), spark.createDataFrame([("p", "1"), ("q", "3")], marks), "c")
    assert [r.c for r in changed.collect()] == ["q"]


def test_binary_shards_round_trip(spark, tmp_path, monkeypatch):
    rows = [("web", 0, 0, [1, 65535, 2]), ("web", 0, 3, [7] * 5), ("web", 1, 0, [9]), ("chat", 0, 0, [4, 5])]
    parts = spark.createDataFrame(rows, "stream string, shard bigint, at bigint, tokens array<bigint>").repartition(3)
    for dtype, width in shards.WIDTH.items():
        out = tmp_path / dtype
        written = shards.write_binary(parts, str(out), dtype)
        assert {(r.stream, r.shard): r.tokens for r in written.collect()} == {("web", 0): 8, ("web", 1): 1, ("chat", 0): 2}
        assert sorted(p.name for p in out.iterdir()) == ["chat_000.bin", "web_000.bin", "web_001.bin"]
        assert (out / "web_000.bin").stat().st_size == 8 * width
        back = shards.read_binary(spark, str(out), dtype).orderBy("stream", "shard", "at").collect()
        assert [(r.stream, r.shard, r.tokens) for r in back] == [("chat", 0, [4, 5]), ("web", 0, [1, 65535, 2, 7, 7, 7, 7, 7]), ("web", 1, [9])]
    with pytest.raises(Exception):
        shards.read_binary(spark, str(tmp_path / "uint16"), "").count()


def test_used_documents_are_skipped_by_id(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, ""), (3, " "), (4, None), (5, "e")], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    read = corpora.web_documents(spark, f"{tmp_path}/docs")
    assert sorted(r.doc_id for r in read.collect()) == [1, 3, 5]
    assert sorted(r.doc_id for r in corpora.not_yet_used(read, spark.createDataFrame([(1,)], "doc_id bigint")).collect()) == [3, 5]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    follower = live.RunFollower(str(tmp_path / "follow"))
    first = spark.createDataFrame([(1, 0, 20, 0.0, 3.0, 1.0), (1, 1, 40, 5.0, 2.0, 2.0)], live.LINE)
    second = spark.createDataFrame([(1, 2, 60, 1.0, 4.0, 3.0), (2, 3, 20, 0.0, 1.0, 4.0)], live.LINE)
    follower.take(first, 0)
    follower.take(second, 1)
    once = [sorted(map(tuple, t.collect())) for t in (follower.restarts(spark), follower.smoothed(spark), follower.status(spark, 1))]
    follower.take(second, 1)
    twice = [sorted(map(tuple, t.collect())) for t in (follower.restarts(spark), follower.smoothed(spark), follower.status(spark, 1))]
    assert once == twice
    assert once[0] == [(1, 2, 40, 60)]
    assert [round(r[2], 9) for r in once[1]] == [3.0, 2.9, 3.01, 1.0]
    assert [(r[0], r[1], r[4]) for r in once[2]] == [(1, 2, 4.0), (2, 3, 1.0)]
    assert live.stalled(follower.status(spark, 1), F.lit(183.5)).select("run_id").collect()[0].run_id == 1
    empty = VersionedTable(str(tmp_path / "none"), "a bigint").before(spark, 0)
    assert empty.count() == 0


def test_a_late_line_is_an_error(spark, tmp_path):
    follower = live.RunFollower(str(tmp_path / "late"))
    follower.take(spark.createDataFrame([(1, 0, 20, 0.0, 3.0, 1.0), (1, 2, 60, 2.0, 2.0, 2.0)], live.LINE), 0)
    with pytest.raises(ValueError, match="line 1 came after line 2"):
        follower.take(spark.createDataFrame([(1, 1, 40, 1.0, 100.0, 3.0)], live.LINE), 1)


def test_a_packing_stream_goes_on_when_its_budget_is_raised(spark, tmp_path):
    from palindra.streaming.pack import PackStream

    def arrive(first, last):
        rows = spark.range(first, last).selectExpr("id as doc_id", "concat('w', id, ' x y') as text").coalesce(1)
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        return spark.readStream.schema("doc_id bigint, text string").parquet(f"{tmp_path}/in")

    def packed():
        return sorted({r.doc for r in PackStream(f"{tmp_path}/pack", 1, 1000).parts(spark).collect()})

    stream = arrive(0, 10)
    assert PackStream(f"{tmp_path}/pack", 20, 1000).run(stream) and packed() == [0, 1, 2, 3, 4]
    stream = arrive(10, 15)
    assert PackStream(f"{tmp_path}/pack", 20, 1000).run(stream) and packed() == [0, 1, 2, 3, 4]
    stream = arrive(15, 18)
    assert not PackStream(f"{tmp_path}/pack", 10_000, 1000).run(stream) and packed() == list(range(18))


def test_newest_line_of_a_running_log(spark, tmp_path):
    schema = "run_id bigint, seq bigint, loss double"
    for rows in ([(1, 0, 3.0), (2, 1, 5.0)], [(1, 2, 2.0), (1, 3, 1.5)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = (
        live.newest_rows(stream).writeStream.outputMode("complete").format("memory").queryName("newest_lines")
        .option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {r.run_id: (r.seq, r.loss) for r in spark.table("newest_lines").collect()} == {1: (3, 1.5), 2: (1, 5.0)}

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from palindra.operators import ordered, packing, sampling
from palindra.operators.packing import PackSettings
from palindra.plans import corpus
from tests import own_tables

PIECES = "source string, doc bigint, piece bigint, tokens array<bigint>, starts_doc boolean, ends_doc boolean"


def random_streams(rng, n_web, n_chat, longest):
    """Per source, documents as lists of pieces; every token is unique."""
    streams, token = {"web": [], "chat": []}, 0
    for source, n in (("web", n_web), ("chat", n_chat)):
        for doc in sorted(rng.sample(range(10_000), n)):
            pieces = []
            for _ in range(1 if source == "web" else rng.randrange(1, 4)):
                size = rng.randrange(1, longest)
                pieces.append(list(range(token, token + size)))
                token += size
            streams[source].append((doc, pieces))
    return streams


def as_pieces(spark, streams):
    rows = [
        (source, doc, 7 * p, tokens, p == 0, p == len(pieces) - 1)
        for source, docs in streams.items()
        for doc, pieces in docs
        for p, tokens in enumerate(pieces)
    ]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, PIECES).repartition(4)


def mixed(streams, frac, target):
    """The validation documents, taken one at a time by the share reached so far."""
    left = {s: [(d, sum(map(len, p))) for d, p in docs] for s, docs in streams.items()}
    used, order = {"web": 0, "chat": 0}, []
    while sum(used.values()) < target and any(left.values()):
        total = sum(used.values())
        low = Fraction(used["chat"], total) < frac if total else frac > 0
        source = "chat" if low else "web"
        if not left[source]:
            source = "web" if source == "chat" else "chat"
        doc, size = left[source].pop(0)
        order.append((source, doc, sum(used.values())))
        used[source] += size
    return order


@pytest.mark.parametrize(
    "frac,val,sizes", [("1/4", 60, (40, 30)), ("0", 40, (5, 9)), ("1", 50, (9, 4)), ("1/3", 10_000, (12, 7)), ("1/2", 0, (4, 4)), ("2/7", 90, (0, 12))]
)
def test_packing_matches_flat_slicing(spark, monkeypatch, frac, val, sizes):
    monkeypatch.setattr(ordered, "ONE_WINDOW", 3)
    rng = random.Random(str((frac, val, sizes)))
    streams = random_streams(rng, *sizes, longest=30)
    settings = PackSettings(600, Fraction(frac), val, shard_tokens=70, block_size=8)
    pieces = as_pieces(spark, streams)
    spans = packing.offsets(pieces).persist()
    held, limits = packing.split_plan(spans, settings)

    want = mixed(streams, settings.chat_frac, val)
    got = held.orderBy("val_start").collect()
    assert [(r.source, r.doc, r.val_start) for r in got] == want

    taken = {(s, d) for s, d, _ in want}
    train = {}
    for source, target in (("web", settings.web_target), ("chat", settings.chat_target)):
        flat, docs = [], []
        for doc, parts in streams[source]:
            if (source, doc) not in taken and len(flat) < target:
                docs.append(doc)
                flat += [t for p in parts for t in p]
        train[source] = (docs, flat)
    spans_train = packing.train_spans(spans, limits)
    got_docs = {(r.source, r.doc) for r in spans_train.collect()}
    assert got_docs == {(s, d) for s, (docs, _) in train.items() for d in docs}

    whole = []
    for source in ("web", "chat"):
        flat = train[source][1]
        for k in range(0, len(flat), 70):
            shard = flat[k : k + 70]
            for b in range((len(shard) - 1) // 8):
                whole.append((source, k // 70, b, shard[8 * b : 8 * b + 9]))
    built = corpus.Corpus(
        settings, pieces, spans, held, limits, packing.corpus_shards(limits, held, settings),
        spans_train, packing.val_spans(spans, held, limits),
    )
    got_blocks = built.blocks().where(F.col("split") == "train").orderBy("block_idx").collect()
    assert [(r.stream, r.shard, r.block, r.tokens) for r in got_blocks] == whole
    assert [r.block_idx for r in got_blocks] == list(range(len(whole)))

    flat_val = [t for s, d, _ in want for doc, parts in streams[s] if doc == d for p in parts for t in p]
    got_val = built.blocks().where(F.col("split") == "val").orderBy("block_idx").collect()
    assert [r.tokens for r in got_val] == [flat_val[8 * b : 8 * b + 9] for b in range(max(0, len(flat_val) - 1) // 8)]

    counts = {r.source: (r.docs, r.tokens, r.val_docs) for r in built.counts().collect()}
    for source, (docs, flat) in train.items():
        n_val = sum(1 for s, _, _ in want if s == source)
        if docs or n_val:
            assert counts[source] == (len(docs), len(flat), n_val)

    split = packing.split_stream(
        spark.createDataFrame([("web", 0, 0, ["a", "b", "<|endoftext|>", "c"]), ("web", 0, 4, ["<|endoftext|>", "<|endoftext|>"]), ("web", 1, 0, ["d", "<|endoftext|>"])], "stream string, shard bigint, at bigint, tokens array<string>"),
        6,
    )
    assert sorted((r.number, r.tokens) for r in split.collect()) == [(0, 2), (1, 1), (2, 0), (3, 1)]


def test_self_test_of_the_pipeline(spark):
    """Generated sources: several shards, a validation split, the share near its goal."""
    settings = PackSettings(400_000, Fraction(1, 4), 20_000, shard_tokens=60_000, block_size=256)
    built = corpus.build(own_tables.documents(spark), own_tables.conversations(spark), settings)
    total = packing.totals(built.counts()).first()
    assert total.total_tokens >= settings.max_tokens
    assert abs(total.chat_share - 0.25) < 0.02
    table = built.shards.collect()
    assert sum(1 for r in table if r.split == "train") > 1
    assert [r.stream for r in table if r.split == "val"] == ["val"]
    lengths = {r.stream: 0 for r in table}
    for r in table:
        lengths[r.stream] += r.tokens
    assert lengths["web"] + lengths["chat"] == total.total_tokens
    again = corpus.build(own_tables.documents(spark), own_tables.conversations(spark), settings)
    assert packing.totals(again.counts()).first() == total


def test_plans_repeat_and_locate_blocks(spark):
    shape = sampling.BatchShape(micro_batch=3, grad_accum=2, world=2, seed=5)
    key = lambda r: (r.step, r.micro, r["rank"], r.j)
    whole = {key(r): (r.epoch, r.block_idx) for r in sampling.plan(spark, shape, 25, 0, 6).collect()}
    late = {key(r): (r.epoch, r.block_idx) for r in sampling.plan(spark, shape, 25, 4, 1).collect()}
    assert late and all(whole[k] == v for k, v in late.items())
    assert len({v for k, v in whole.items() if k[0] == 0}) == shape.per_step
    first = [b for e, b in whole.values() if e == 0]
    assert sorted(first) == list(range(25))
    shown = {r.block_idx: r.shown for r in sampling.times_shown(sampling.plan(spark, shape, 25, 0, 6)).collect()}
    assert sum(shown.values()) == 72 and set(shown.values()) <= {2, 3}
    flat = sampling.plan(spark, sampling.BatchShape(2, 1, 1, shuffle=False), 3, 0, 4).orderBy("step", "j").collect()
    assert [r.block_idx for r in flat] == [0, 1, 2, 0, 1, 2, 0, 1]
    shards = spark.createDataFrame([("web", 0, 0, 10), ("web", 1, 10, 0), ("chat", 0, 10, 90_000)], "stream string, shard bigint, first_block bigint, blocks bigint")
    where = sampling.locate(spark.createDataFrame([(0,), (9,), (10,), (70_000,), (90_009,)], "block_idx bigint"), shards)
    assert sorted((r.block_idx, r.stream, r.shard, r.block) for r in where.collect()) == [
        (0, "web", 0, 0), (9, "web", 0, 9), (10, "chat", 0, 0), (70_000, "chat", 0, 69_990), (90_009, "chat", 0, 89_999)
    ]
    with pytest.raises(ValueError):
        sampling.plan(spark, shape, 0, 0, 1)

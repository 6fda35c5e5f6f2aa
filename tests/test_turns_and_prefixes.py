"""Turns across part ends against a plain parser, prefixes of documents against slices."""

import random
import re

import pytest

from palindra.functions import text as txt
from palindra.operators import ordered, prefixes, turns

HEADER = re.compile(r"<\|im_start\|>([0-9A-Za-z_]+)\n(.*?)(?:<\|im_end\|>|\Z)", re.S)
SHARD = 97


def some_documents(seed):
    rnd = random.Random(seed)
    bits = [txt.IM_START, txt.IM_END, "user", "bot_2", "\n", "\n\n", " ", "<", " said", "é", txt.IM_START + "user\n", txt.IM_END + "\n" + txt.IM_START + "assistant\n"]
    made = ["".join(rnd.choices(bits, k=rnd.randint(0, 14))) for _ in range(60)]
    long = txt.IM_START + "user\n" + "on and on " * 120 + txt.IM_END + txt.IM_START + "assistant\nyes"
    return [*made[:30], long, *made[30:], "", txt.IM_START + "user\n"]


def packed(spark, documents, seed, direction):
    """Parts of the stream, cut anywhere and at the ends of shards."""
    rnd, stream = random.Random(seed), []
    for d in documents:
        toks = re.findall(txt.TOKEN, d)
        stream += [*(reversed(toks) if direction == "reverse" else toks), txt.EOS]
    rows, at = [], 0
    while at < len(stream):
        end = min(at + rnd.randint(1, 9), (at // SHARD + 1) * SHARD)
        rows.append(("chat", at // SHARD, at % SHARD, stream[at:end]))
        at = end
    rows += [("other", s, a, t) for _, s, a, t in rows]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "stream string, shard bigint, at bigint, tokens array<string>").repartition(3)


@pytest.mark.parametrize("direction, bits", [("forward", 2), ("reverse", 6)])
def test_turns(spark, direction, bits, monkeypatch):
    monkeypatch.setattr(ordered, "MAP_BITS", bits)
    documents = some_documents(8)
    found = turns.turns(turns.in_reading_order(packed(spark, documents, 4, direction), SHARD, direction)).persist()
    read = documents if direction == "forward" else documents[::-1]
    want, asked = [], {}
    for i, d in enumerate(read):
        doc = i if direction == "forward" else i + 1  # a reversed document's separator is read first
        for role, content in HEADER.findall(d):
            if role == "user":
                asked.setdefault(doc, content.strip())
            want.append((len(want), doc, role, content.strip()))
    for stream in ("chat", "other"):
        rows = found.where(found.stream == stream).collect()
        assert sorted((r.turn, r.doc, r.role, r.content) for r in rows) == want
        first = turns.questions(found).where(f"stream = '{stream}'").collect()
        assert {r.doc: r.question for r in first} == asked
    found.unpersist()


def test_no_parts(spark):
    none = spark.createDataFrame([], "stream string, shard bigint, at bigint, tokens array<string>")
    assert turns.turns(turns.in_reading_order(none, SHARD, "reverse")).collect() == []


def test_prefixes(spark):
    rnd = random.Random(3)
    documents = [rnd.choices("ab", k=rnd.randint(1, 150)) for _ in range(80)] + [["a"] * 200] * 30
    pieces = []
    for i, d in enumerate(documents):
        at = 0
        while at < len(d):
            n = rnd.randint(1, 90)
            pieces.append((i, 10 * at, d[at : at + n], "x"))
            at += n
    sought = [d[: rnd.randint(1, 150)] for d in documents[:40]] + [["a"], ["b"], ["a"] * 200, ["a"] * 201, [], ["c"]]
    for s in list(sought[:20]):
        sought.append([*s[:-1], "c"])  # right up to the last token
    named = list({"".join(s): s for s in sought}.items())
    rows = spark.createDataFrame(pieces, "doc bigint, piece bigint, tokens array<string>, source string").repartition(4)
    table = spark.createDataFrame(named, "prefix string, tokens array<string>")
    found = sorted((r.doc, r.prefix) for r in prefixes.beginning_with(rows, table).collect())
    assert found == sorted((i, k) for i, d in enumerate(documents) for k, s in named if s and d[: len(s)] == s)
    assert prefixes.beginning_with(rows, table.where("false")).collect() == []


def test_values_that_meet_are_compared(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(prefixes, "value", lambda tokens, first: F.lit(0).cast("bigint"))
    rows = spark.createDataFrame([(1, 0, list("ab")), (1, 1, list("cd")), (2, 0, list("abxd"))], "doc bigint, piece bigint, tokens array<string>")
    table = spark.createDataFrame([("p", list("abc")), ("q", list("abx")), ("r", list("zzz"))], "prefix string, tokens array<string>")
    found = prefixes.beginning_with(rows, table).collect()
    assert sorted((r.doc, r.prefix) for r in found) == [(1, "p"), (2, "q")]


def _shuffles_of(df, column):
    """Shuffles in the physical plan of ``df`` whose rows carry ``column``."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        names = [node.output().apply(i).name() for i in range(node.output().size())]
        found += node.nodeName() == "Exchange" and column in names
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_tokens_are_shuffled_once_a_step(spark):
    """The scans over parts see one narrow row per part; the tokens meet their numbers once
    and their states once, however many running values there are."""
    shuffled = packed(spark, some_documents(8), 4, "reverse")
    parts = turns.in_reading_order(spark.createDataFrame(shuffled.collect(), shuffled.schema), SHARD, "reverse")
    assert _shuffles_of(parts, "tokens") <= 1
    assert _shuffles_of(turns.turns(parts), "tokens") <= 3

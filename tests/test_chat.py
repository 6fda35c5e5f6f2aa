import random
from itertools import groupby

from pyspark.sql import functions as F

from palindra.functions import text as txt
from palindra.operators import chat, ordered

SCHEMA = """id bigint, messages array<struct<role: string, content: string, from: string, value: string>>,
conversations array<struct<role: string, content: string, from: string, value: string>>"""
NAMES = {"user": "user human prompter", "assistant": "assistant gpt model bot"}
ROLE = {alias: role for role, names in NAMES.items() for alias in names.split()}


def fold(messages):
    """What the set-based form must give, from the definition of each part."""
    if None in messages:
        return []
    said = [((r or f or "").lower(), (c or v or "").strip()) for r, c, f, v in messages]
    said = [(ROLE.get(who, who), body) for who, body in said if body]
    said = [(who, body) for who, body in said if who in ("user", "assistant", "system")]
    full = []
    for at, (who, body) in enumerate(said):
        before = [x for x in said[:at] if x[0] != "assistant"]
        if who == "user" and before and before[-1][0] == "system":
            body = before[-1][1] + "\n\n" + body
        full.append((who, body))
    spoken = [x for x in full if x[0] != "system"]
    runs = [(who, "\n\n".join(b for _, b in g)) for who, g in groupby(spoken, lambda x: x[0])]
    answered = runs[:-1] if runs and runs[-1][0] == "user" else runs
    return answered if len(answered) >= 2 else []


def spark_fold(spark, conversations):
    rows = [(i, m, None) for i, m in enumerate(conversations)]
    long = chat.explode_messages(spark.createDataFrame(rows, SCHEMA), "id", ["messages", "conversations"])
    pieces = chat.number_turns(chat.normalise(long))
    marked = chat.markup(pieces).orderBy("conv_id", "turn").collect()
    turns, texts = {}, {}
    for r in marked:
        conv = turns.setdefault(r.conv_id, [])
        if r.starts_turn:
            assert r.merged_turn == len(conv)
            conv.append((r.role, r.text))
        else:
            conv[-1] = (r.role, conv[-1][1] + "\n\n" + r.text)
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.markup
    for conv, text in texts.items():
        assert text == "\n".join(f"{txt.IM_START}{w}\n{b}{txt.IM_END}" for w, b in turns[conv])
    return [turns.get(i, []) for i in range(len(conversations))]


def m(role=None, content=None, frm=None, value=None):
    return (role, content, frm, value)


CASES = [
    [m("user", "hi"), m("assistant", "hello")],
    [m(frm="human", value="hi"), m(frm="gpt", value="hello")],
    [m("system", "Be terse."), m("user", "hi"), m("assistant", "hello")],
    [m("user", "a"), m("assistant", "b"), m("user", "c")],
    [m("user", "a"), m("user", "b"), m("assistant", "c")],
    [m("user", "a")],
    [None],
    [m("user", "a"), m("assistant", "b"), None],
    [m("USER", " a\n"), m("Bot", "b"), m("prompter", "c"), m("MODEL", "d")],
    [m("", "x", "human"), m("assistant", "", None, "y")],
    [m("user", "a"), m("tool", "t"), m("user", "b"), m("assistant", "c")],
    [m("system", "1"), m("system", "2"), m("user", "q"), m("assistant", "r")],
    [m("user", "q"), m("system", "late"), m("assistant", "r"), m("user", "s"), m("assistant", "t")],
    [m("user", "q"), m("assistant", "r"), m("system", "lost")],
    [m("assistant", "first"), m("user", "q"), m("assistant", "r")],
    [m("assistant", "only")],
    [m("user", "  \n"), m("assistant", "r")],
    [m("user", "q"), m("assistant", " \x1c"), m("user", "q2"), m("assistant", "r")],
    [m("user", "  ", None, "fallback"), m("assistant", "r")],
]


def test_known_conversations(spark):
    got = spark_fold(spark, CASES)
    assert got == [fold(c) for c in CASES]
    assert got[2] == [("user", "Be terse.\n\nhi"), ("assistant", "hello")]
    assert got[4] == [("user", "a\n\nb"), ("assistant", "c")]


def test_random_conversations_even_when_chunked(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ONE_WINDOW", 0)
    monkeypatch.setattr(chat, "POSITION_BITS", (2,))
    rng = random.Random(11)
    roles = ["user", "Human", "assistant", "gpt", "system", "system", "tool", ""]
    bodies = ["a", " b ", "", "\n", "c\n\nd", "<|im_end|", "e <", "<|im_end|>"]

    def message():
        role, body = rng.choice(roles), rng.choice(bodies)
        return m(role, body) if rng.random() < 0.6 else m(None, None, role, body)

    conversations = [[message() for _ in range(rng.randrange(1, 14))] for _ in range(300)]
    assert spark_fold(spark, conversations) == [fold(c) for c in conversations]


def test_list_columns_fall_through(spark):
    good = [m("user", "hi"), m("assistant", "hello")]
    rows = [(0, [], good), (1, good, [m("user", "no")]), (2, None, good), (3, None, None)]
    long = chat.explode_messages(spark.createDataFrame(rows, SCHEMA), "id", ["messages", "conversations"])
    found = chat.normalise(long).groupBy("conv_id").agg(F.count("*").alias("n")).collect()
    assert {r.conv_id: r.n for r in found} == {0: 2, 1: 2, 2: 2}


def test_list_columns_of_different_structs(spark):
    kinds = "id bigint, messages array<struct<role: string, content: string>>, conversations array<struct<from: string, value: string>>"
    rows = [(0, [("user", "hi"), ("assistant", "hello")], None), (1, None, [("human", "a"), ("gpt", "b")]), (2, [], [("human", "c"), ("gpt", "d")])]
    rows += [(3, [("user", "e"), None, ("assistant", "f")], None)]
    long = chat.explode_messages(spark.createDataFrame(rows, kinds), "id", ["messages", "conversations"])
    found = {(r.conv_id, r.role): r.text for r in chat.normalise(chat.unify_fields(long)).collect()}
    assert {k: v for k, v in found.items() if k[0] < 3} == {(i, r): t for i, (u, a) in enumerate([("hi", "hello"), ("a", "b"), ("c", "d")]) for r, t in (("user", u), ("assistant", a))}
    texts = spark.createDataFrame([(4, ["no struct"])], "id bigint, messages array<string>")
    assert chat.normalise(chat.explode_messages(texts, "id", ["messages"])).count() == 0


def test_pieces_lay_out_like_the_whole(spark):
    rows = [(0, t, r, x) for t, (r, x) in enumerate([("user", "a b"), ("user", "<"), ("assistant", "d e"), ("user", "f"), ("assistant", "g <|im_end|")])]
    pieces = chat.normalise(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    whole = "".join(r.markup for r in chat.markup(pieces).orderBy("turn").collect())
    ids = spark.range(1).select(txt.tokens(F.lit(whole)).alias("k")).first().k
    want = {
        "reverse": ids[::-1] + [txt.EOS],
        "forward": ids + [txt.EOS],
        "both": [txt.IM_START, *ids[::-1], txt.EOS, txt.IM_END, *ids, txt.EOS],
    }
    for direction, layout in want.items():
        laid = chat.laid_out(pieces, direction).orderBy("piece").collect()
        assert [t for r in laid for t in r.tokens] == layout
        assert [r.starts_doc for r in laid] == [True] + [False] * (len(laid) - 1)
        assert [r.ends_doc for r in laid] == [False] * (len(laid) - 1) + [True]

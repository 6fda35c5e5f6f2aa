import pytest
from pyspark.sql import functions as F

from palindra.functions import display, layout, text as txt

SENTENCES = ["seven grey herons left the pond", "Our ferry sails at noon, mostly.", " under one roof of slate and moss"]


@pytest.fixture(scope="module", autouse=True)
def markers(spark):
    global EOS, START, END
    EOS, START, END = (F.lit(x) for x in (txt.EOS, txt.IM_START, txt.IM_END))


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def toks(text):
    return txt.tokens(F.lit(text))


@pytest.mark.parametrize("text", SENTENCES + ["a <b> <|im_end|> < x", "\n\n  é\t<|im_start|>", "<|im_"])
def test_tokens_are_lossless_in_every_direction(spark, text):
    assert one(spark, txt.detokenize(toks(text))) == text
    for direction in layout.DIRECTIONS:
        ids = layout.encode_prompt(toks(text), direction, EOS, END)
        assert one(spark, txt.detokenize(layout.reading_order(ids, direction))) == text


def test_layouts(spark):
    body = one(spark, toks(SENTENCES[0]))
    assert one(spark, layout.orient(toks(SENTENCES[0]), "reverse", EOS)) == body[::-1] + [txt.EOS]
    assert one(spark, layout.orient(toks(SENTENCES[0]), "forward", EOS)) == body + [txt.EOS]
    both = one(spark, layout.orient(toks(SENTENCES[0]), "both", EOS, START, END))
    assert both == [txt.IM_START, *body[::-1], txt.EOS, txt.IM_END, *body, txt.EOS]
    assert len(one(spark, layout.orient(toks(SENTENCES[0]), "both", EOS))) == 2 * len(body) + 2
    with pytest.raises(ValueError):
        layout.orient(toks("x"), "sideways", EOS)


def test_no_words_fuse_at_the_join(spark):
    full = one(spark, toks(SENTENCES[2]))
    joined = F.array(*[F.lit(t) for t in full[3:][::-1] + full[:3][::-1]])
    assert one(spark, txt.detokenize(layout.reading_order(joined, "reverse"))) == SENTENCES[2]


def test_prompts(spark):
    assert one(spark, layout.encode_prompt(toks(""), "reverse", EOS, END)) == [txt.EOS]
    assert one(spark, layout.encode_prompt(toks(""), "forward", EOS, END, True)) == [txt.EOS]
    assert one(spark, layout.encode_prompt(toks(""), "both", EOS, END, True)) == [txt.IM_END]
    assert one(spark, layout.encode_prompt(toks("a b"), "forward", EOS, END, True)) == ["a", " b"]
    assert one(spark, layout.encode_prompt(toks("a b"), "reverse", EOS, END, True)) == [txt.IM_END, " b", "a"]


def test_exchange_round_trip(spark):
    rows = [([("user", "Which lake freezes first?"), ("assistant", "The upper one.")],)]
    df = spark.createDataFrame(rows, "turns array<struct<role: string, content: string>>")
    marked = txt.chat_markup(F.col("turns"))
    ids = df.select(txt.tokens(marked).alias("ids")).first().ids
    assert ids[0] == txt.IM_START and ids[-1] == txt.IM_END
    laid = layout.orient(txt.tokens(marked), "reverse", EOS)
    jeopardy = layout.encode_prompt(toks("The upper one."), "reverse", EOS, END, True)
    back = txt.detokenize(layout.reading_order(laid, "reverse"))
    row = df.select(
        layout.starts_with(laid, jeopardy).alias("prefix"),
        txt.extract_question(back).alias("question"),
        txt.extract_turns(back).alias("turns"),
    ).first()
    assert row.prefix and row.question == rows[0][0][0][1]
    assert [t.role for t in row.turns] == ["user", "assistant"]


def test_extracting_from_odd_text(spark):
    cut = "<|im_start|>user\n  hi\nthere \n<|im_end|>\n<|im_start|>assistant\nunfinished "
    assert [tuple(t) for t in one(spark, txt.extract_turns(F.lit(cut)))] == [
        ("user", "hi\nthere"),
        ("assistant", "unfinished"),
    ]
    assert one(spark, txt.extract_question(F.lit(" plain "))) == "plain"
    assert one(spark, txt.extract_question(F.lit("<|im_start|>assistant\nx<|im_end|>"))) == "<|im_start|>assistant\nx<|im_end|>"


def test_strip_and_collapse_follow_python(spark):
    odd = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    for text in (odd + "a" + odd + "b" + odd, "​a​", "", odd, "x"):
        assert one(spark, txt.strip(F.lit(text))) == text.strip()
        assert one(spark, txt.collapse(F.lit(text))) == " ".join(text.split())


def test_invalid_bytes_are_replaced(spark):
    broken = F.lit(bytes([0x61, 0xFF, 0x62])).cast("string")
    assert one(spark, txt.valid_text(broken)) == "a�b"


def test_display(spark):
    assert one(spark, display.clock(F.lit(3723.9))) == "1h02m03s"
    assert one(spark, display.clock(F.lit(-5.0), " ")) == "0h 00m 00s"
    ages = {5.0: "5s ago", 89.5: "90s ago", 90.0: "2m ago", 5400.0: "2h ago", 172800.0: "2d ago"}
    for seconds, shown in ages.items():
        assert one(spark, display.age(F.lit(seconds))) == shown
    assert one(spark, display.bar(F.lit(0.5), 10)) == "#####-----"
    assert one(spark, display.fraction(F.lit(7.0))) == 1.0

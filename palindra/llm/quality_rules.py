"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule rejects a text by a few of its measures. On a bounded sample every rule is
run alone: the time its job takes beyond an empty one is its cost, the share of
rows it rejects its selectivity. Rules then run in the order of rejections per cost,
and a row that one rejects is not looked at by the later ones (``CASE`` stops at the
first branch that holds). The order changes the cost and which rule is named for a
row that several reject, never whether a row is kept.

Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words and fails the
least number of words. Rows are judged one by one: repeated rows alike, an empty
table to no rows. All columns of the input stay; a name the cascade adds replaces a
column of that name.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palindra.session import stage

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Rows, about, on which costs and selectivities are estimated.
SAMPLE_ROWS = 400


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where lambdas repeat it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def repeated_words(found: Column) -> Column:
    """Words in windows of three that occur twice or more, every word once.

    Windows are compared by 64-bit hashes. Only where two are equal are they sorted
    with their places; the sorted places of repeated windows then give the words.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            same = F.transform(
                F.sequence(F.lit(0), last),
                lambda i: F.when((i > 0) & (F.get(s, i - 1)["h"] == F.get(s, i)["h"]), F.get(s, i)["i"]).when(
                    (i < last) & (F.get(s, i + 1)["h"] == F.get(s, i)["h"]), F.get(s, i)["i"]
                ),
            )
            return F.sort_array(F.filter(same, lambda p: p.isNotNull()))

        def total(at: Column) -> Column:
            steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda n, x: n + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(let(placed, places), total))

    def windows(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )
        return F.when(F.size(w) < 4, 0).otherwise(let(hashes, covered))

    return let(found, windows).cast("bigint")


def lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, "\t\n\x0b\x0c\r ", "")) > 0)


def duplicate_lines(found: Column) -> Column:
    return let(found, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def measures(text: Column, found: Column) -> dict[str, Column]:
    """Every measure of a text by name; ``found`` are its words."""
    whole = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size(found).cast("bigint"),
        "word_chars": F.length(F.array_join(found, "")).cast("bigint"),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("bigint"),
        "n_bangs": (F.length(whole) - F.length(F.replace(whole, F.lit("!")))).cast("bigint"),
        "n_lines": F.size(lines(text)).cast("bigint"),
        "n_dup_lines": duplicate_lines(lines(text)),
        "n_repeat_words": repeated_words(found),
    }


@dataclass(frozen=True)
class Rule:
    """Rejects what ``test`` says of the measures it is given."""

    name: str
    test: Callable[[dict[str, Column]], Column]


BASE_RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeats", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
MORE_RULES = (
    Rule("symbols", lambda m: 100 * m["n_symbols"] > 20 * m["n_words"]),
    Rule("shouting", lambda m: 100 * m["n_bangs"] > 50 * m["n_words"]),
    Rule("same_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
)
RULES = BASE_RULES + MORE_RULES


@dataclass(frozen=True)
class Estimate:
    """What a rule costs and rejects on the sample."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-3)


def estimates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and selectivity of every rule on about ``rows`` rows, alone."""
    share = min(1.0, rows / max(docs.count(), 1))
    sample = stage(docs.select(F.col(text).cast("string").alias("text")).sample(share, seed=1), "rule-sample")
    split = sample.select("text", words(F.col("text")).alias("words"))
    known = measures(F.col("text"), F.col("words"))

    def timed(test: Column) -> tuple[float, float]:
        begun = time.perf_counter()
        share = split.agg(F.avg(F.when(test, 1.0).otherwise(0.0))).first()[0]
        return time.perf_counter() - begun, share or 0.0

    timed(F.lit(False))
    empty, _ = timed(F.lit(False))
    found = []
    for rule in rules:
        seconds, share = timed(rule.test(known))
        found.append(Estimate(rule, max(seconds - empty, 0.0), share))
    return found


def in_order(found: list[Estimate]) -> tuple[Rule, ...]:
    """Rules by rejections per cost, ties as given."""
    return tuple(e.rule for e in sorted(found, key=lambda e: -e.gain))


def cascade(rules: tuple[Rule, ...], known: dict[str, Column]) -> Column:
    """Name of the first rule that rejects, null where none does."""
    name = F.lit(None).cast("string")
    for rule in reversed(rules):
        name = F.when(F.coalesce(rule.test(known), F.lit(False)), F.lit(rule.name)).otherwise(name)
    return name


def judged(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", failed: str = "failed_rule") -> DataFrame:
    """``docs`` with the rule that rejects each row. Measures are worked out only as
    far as the cascade goes."""
    split = docs.withColumn("_words", words(F.col(text)))
    return split.withColumn(failed, cascade(rules, measures(F.col(text), F.col("_words")))).drop("_words")


def measured(docs: DataFrame, rules: tuple[Rule, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every measure of every row, and the cascade's verdict on them."""
    names = list(measures(F.lit(""), F.array()))
    split = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), words(F.col(text)).alias("words"))
    known = measures(F.col("text"), F.col("words"))
    rows = split.select("doc_id", *(known[n].alias(n) for n in names))
    have = {n: F.col(n) for n in names}
    base = BASE_RULES[0].test(have) | BASE_RULES[1].test(have)
    return rows.select("doc_id", *names, base.alias("base_failed"), cascade(rules, have).alias("failed_rule"))

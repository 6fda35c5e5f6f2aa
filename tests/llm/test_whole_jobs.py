"""What the operators did less than whole."""

import textwrap
from collections import Counter

import corpus_pipeline
import pytest

from palindra.llm import license_scan


def test_pipeline_repeats_as_the_operator(spark):
    rows = [(i, f"w{i}", "large") for i in range(900)] + [(1000 + i, f"w{i}", "small") for i in range(50)]
    found = corpus_pipeline.mix(spark, spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "").collect()
    taken = Counter(r.source for r in found)
    assert taken["large"] == 900 and 95 <= taken["small"] <= 100


def licenses(text):
    return [m.license for _, m, _ in license_scan.Scanner(license_scan.TEMPLATES).scan(text)]


@pytest.mark.parametrize("name, k", [(name, k) for name, texts in license_scan.TEMPLATES.items() for k in range(len(texts))])
def test_notices_anywhere_in_a_long_line(name, k):
    notice, some = license_scan.TEMPLATES[name][k], [f"w{i}" for i in range(5000)]
    assert licenses(" ".join([*some[:2500], notice, *some[2500:]])) == [name]
    assert licenses(" ".join([*some, notice])) == [name]
    assert licenses(" ".join([*some[:100], "a permission", *some[:300], notice, "license", *some[:90], notice])) == [name, name]


@pytest.mark.parametrize("name, k", [(name, k) for name, texts in license_scan.TEMPLATES.items() for k in range(len(texts))])
@pytest.mark.parametrize("width, mark", [(72, ""), (72, " * "), (20, "")])
def test_notices_wrapped_over_lines(name, k, width, mark):
    lines = textwrap.wrap(license_scan.TEMPLATES[name][k], width)
    text = "\n".join(["w1 w2", *(mark + x for x in lines), "w3 w4"])
    found = list(license_scan.Scanner(license_scan.TEMPLATES).scan(text))
    assert [(line, m.license) for line, m, _ in found] == [(1, name)]


def test_wrapped_cues_pass_the_filter(spark):
    rows = [(1, "w1 All rights\nreserved. w2"), (2, "Dedicated to the public\ndomain under CC0 1.0.")]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in found) == [(1, "All-Rights-Reserved"), (2, "CC0-1.0")]

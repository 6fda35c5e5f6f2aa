"""The operators on small tables with odd rows, against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palindra.llm import (
    decontamination,
    encoding,
    language_id,
    license_scan,
    lm_scoring,
    mixing,
    quality_classifier,
    quality_rules,
    queries,
    shingle_join,
    token_counts,
    token_files,
    words,
)

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tokens string, copies int, block string, n int, node string, words int"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def sentence(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    base = sentence(rnd, 120)
    some = [base, base, base + " more", "x " + base, base[:-40]]
    some += [None, "", " \n\t", "one", "one two three", "ÉTÉ à la Une", "日本語 テキスト", "<|endoftext|> it's", "a" * 9000]
    some += [sentence(rnd, rnd.randrange(1, 200)) for _ in range(60)]
    some += [sentence(rnd, 60, 5), "Same line\n" * 30, "HE!! IS!! " * 40, "a*** b### " * 60]
    some += [sentence(rnd, 30_000, 3000)]
    return some


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], None if t is None else len(t), "t", 1, "b", 2, "n", 3) for i, t in enumerate(texts)]
    rows += [(None, "a row without an id", "en", "a", 1, "t", 1, "b", 2, "n", 3), rows[0], rows[0]]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for row in df.collect():
        out.setdefault(row.doc_id, []).append(row)
    return out


def test_words_and_pieces(texts, monkeypatch):
    rnd = random.Random(5)
    signs = list("ab Z9.,!'\n\t  s×÷éñ«» 　日<|>") + ["'s", "\n\n", "<|endoftext|>", "\r\n", " \n"]
    odd = texts + ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(4000)]
    column = words.texts_of(pa.array(odd))
    tokenizer = Tokenizer.from_file(BPE)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in odd]
    for size in (64, 1 << 20):
        monkeypatch.setattr(words, "SEGMENT", size)
        found = words.words(column, 0, len(odd))
        assert list(found.counts(len(odd))) == [len(word_list(t)) for t in odd]
        names = {}
        for h, s, e in zip(found.hash.tolist(), found.start, found.end):
            assert names.setdefault(h, lowered(column.bytes_of(s, e).decode())) == lowered(column.bytes_of(s, e).decode())
        coder = encoding.PieceEncoder(BPE)
        assert list(coder.counts(column)) == [len(w) for w in want]
        monkeypatch.setattr(encoding, "CACHE", 50)
        ids = [list(p) for _, _, n, all_ids in coder.ids(column, 2) for p in np.split(all_ids, np.cumsum(n)[:-1])]
        assert ids == [w + [2] for w in want]
        monkeypatch.setattr(encoding, "CACHE", 1 << 20)


def test_token_counts(spark, docs, empty, texts):
    tokenizer = Tokenizer.from_file(BPE)
    found = by_id(token_counts.count_tokens(docs, BPE))
    assert len(found[0]) == 3 and None in found
    for i, t in enumerate(texts):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (found[i][0].n_bytes, found[i][0].n_tokens, found[i][0].over_limit) == (len((t or "").encode()), n, n > 512)
    assert token_counts.count_tokens(empty, BPE).count() == 0
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = by_id(token_counts.count_tokens(docs, path))
    assert all(pieces[i][0].n_tokens == len(model.encode(t or "")) for i, t in enumerate(texts))


def test_token_files(spark, docs, empty, texts, tmp_path):
    token_files.write(token_files.encode(docs, BPE, 2), str(tmp_path / "ids"))
    rows = token_files.read(spark, str(tmp_path / "ids"))
    tokenizer = Tokenizer.from_file(BPE)
    found = sorted(token_files.digests(rows).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, 0, 0, 0, *range(1, len(texts))]
    at = 0
    for r in found:
        text = "a row without an id" if r.doc_id is None else texts[r.doc_id]
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert "EqualTo(doc_id,7)" in rows.where("doc_id = 7")._jdf.queryExecution().toString()
    assert [r.doc_id for r in rows.where("doc_id = 7").collect()] == [7]
    token_files.write(token_files.encode(empty, BPE, 2), str(tmp_path / "none"))
    assert token_files.digests(token_files.read(spark, str(tmp_path / "none"))).count() == 0


def test_quality_rules(spark, docs, empty):
    con = duckdb.connect()
    con.register("documents", docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").toPandas())
    cursor = con.execute(queries.ORACLES["op7_quality_rules"])
    names = [d[0] for d in cursor.description]
    want = {r[0]: dict(zip(names, r)) for r in cursor.fetchall()}
    rules = quality_rules.in_order(quality_rules.estimates(docs))
    assert set(rules) == set(quality_rules.RULES)
    for row in quality_rules.measured(docs, rules).where("doc_id is not null").collect():
        w = want[row.doc_id]
        assert all(row[c] == w[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), (row, w)
        assert (row.failed_rule is None) == w["kept"]
    first = {(r.doc_id, r.failed_rule is None) for r in quality_rules.judged(docs, rules).collect()}
    last = {(r.doc_id, r.failed_rule is None) for r in quality_rules.judged(docs, rules[::-1]).collect()}
    assert first == last
    assert quality_rules.judged(empty, quality_rules.in_order(quality_rules.estimates(empty))).count() == 0


def test_order_of_rules():
    rule = quality_rules.RULES
    found = [quality_rules.Estimate(rule[0], 2.0, 0.5), quality_rules.Estimate(rule[1], 0.1, 0.2), quality_rules.Estimate(rule[2], 1.0, 0.0)]
    assert quality_rules.in_order(found) == (rule[1], rule[0], rule[2])


def test_language_id(spark, docs, empty):
    rnd = random.Random(1)
    kinds = {"aa": "kri mon tel", "bb": "öst ban dur", "cc": "vel çin aro", "dd": "zu fe ho"}
    rows = [(i, " ".join(rnd.choice(kinds[k].split()) + rnd.choice(kinds[k].split()) for _ in range(30)), k) for i in range(400) for k in [sorted(kinds)[i % 4]]]
    some = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(some.where(~language_id.is_held_out(F.col("doc_id"))))
    assert model.languages == sorted(kinds) and model.code.shape == (4, 7)
    found = language_id.predict(some, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    right = [r.lang_pred == rows[r.doc_id][2] for r in found if r.held_out]
    assert np.mean(right) > 0.98 and all(0 <= r.score <= 1 for r in found)
    own = language_id.train(docs)
    odd = by_id(language_id.predict(docs, own))
    assert all(odd[i][0].lang_pred == "und" for i in (5, 6, 7)) and odd[10][0].lang_pred in ("en", "de")
    nothing = language_id.train(empty)
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(empty, own).count() == 0
    for n in (2, 3, 7, 12, 40):
        code = language_id.codewords(n)
        assert len({tuple(r) for r in code}) == n and len({tuple(c) for c in code.T}) == code.shape[1]


def test_lm_scoring(spark, docs, empty, texts, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK", 3000)
    found = by_id(lm_scoring.score(docs))
    every = [(i, t) for i, t in enumerate(texts)] + [(None, "a row without an id"), (0, texts[0]), (0, texts[0])]
    rest = lambda i: zlib.crc32(str(i).encode()) % 7 if i is not None else -1
    uni, pair = {k: Counter() for k in ("fit", "all")}, {k: Counter() for k in ("fit", "all")}
    for i, t in every:
        if rest(i) != 2:
            w = [*word_list(t), None]
            for k in ("all",) if rest(i) == 3 else ("all", "fit"):
                uni[k].update(w)
                pair[k].update(zip(["<"] + w[:-1], w))
    n, v = sum(uni["all"].values()), len(uni["all"])

    def parts(w, before, kind):
        c = uni[kind]
        context = c[None] if before == "<" else c[before]
        return context, pair[kind][(before, w)] / context if context else 0, c[w] / sum(c.values()), 1 / (len(c) + 1)

    cells = []
    for i, t in every:
        if rest(i) == 3:
            w = [*word_list(t), None]
            cells += [parts(x, b, "fit") for b, x in zip(["<"] + w[:-1], w)]
    k = lm_scoring.frequency_bucket(np.array([c[0] for c in cells]))
    weights = np.tile(lm_scoring.START_WEIGHTS, (lm_scoring.BUCKETS, 1))
    for b in set(k.tolist()):
        p = np.array([[c[3], c[2], c[1]] for c, kk in zip(cells, k) if kk == b])
        for _ in range(lm_scoring.ROUNDS):
            part = weights[b] * p
            weights[b] = (part / part.sum(1, keepdims=True)).mean(0)
    weights[0, 2] = 0
    weights = np.maximum(weights, [1e-6, 1e-9, 0])
    weights /= weights.sum(1, keepdims=True)
    for i, t in every:
        row, w = found[i][0], [*word_list(t), None]
        base = sum(math.log10((uni["all"][x] + 1) / (n + v + 1)) for x in w)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(w), sum(uni["all"][x] > 0 for x in w), n)
        assert row.held_out == (rest(i) == 2) and row.base_score == pytest.approx(base, rel=1e-9)
        got = [parts(x, b, "all") for b, x in zip(["<"] + w[:-1], w)]
        own = sum(math.log10(weights[lm_scoring.frequency_bucket(np.array([c]))[0]] @ [p0, p1, p2]) for c, p2, p1, p0 in got)
        assert row.score == pytest.approx(own, rel=2e-3)
    assert lm_scoring.score(empty).count() == 0
    held = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2)
    assert {r.train_tokens for r in lm_scoring.score(held).collect()} == {0}


def test_decontamination(spark, docs, empty):
    rnd = random.Random(8)
    items = [(i, f"{sentence(rnd, 20, 900)}. {sentence(rnd, 15, 900)}.") for i in range(60)] + [(90, None), (91, ""), (92, "one"), (None, sentence(rnd, 30, 900) + ". end here now")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    leaking = [(1000 + i, f"{sentence(rnd, rnd.randrange(400))} {t.upper() if i % 2 else t} {sentence(rnd, 300)}") for i, (_, t) in enumerate(items[:60])]
    half = [(2000 + i, f"{sentence(rnd, 50)} {t.split('.')[0]} {sentence(rnd, 50)}") for i, (_, t) in enumerate(items[:60])]
    some = spark.createDataFrame(leaking + half, "doc_id bigint, text string").unionByName(docs.select("doc_id", "text"))
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(some, benchmark).collect()}
    assert found == {(1000 + i, i) for i in range(60)}
    assert decontamination.find_leaks(empty, benchmark).count() == 0
    assert decontamination.find_leaks(docs, benchmark.limit(0)).count() == 0


def test_search_finds_all_above_the_threshold():
    rnd = random.Random(2)
    items = [(i, sentence(rnd, 12, 60)) for i in range(90)]
    index = decontamination.build(items)
    searcher = decontamination.Searcher(index, threshold=0.45)
    passages = [sentence(rnd, 40, 60) for _ in range(80)]
    column = words.texts_of(pa.array(passages))
    spans = words.words(column, 0, len(passages), alnum=True)
    counts = spans.counts(len(passages))
    end = np.cumsum(counts)
    p, item, score = searcher.retrieve(searcher.term_of(spans.hash), end - counts, end)
    n, size, df = len(items), [12] * 90, Counter(w for _, t in items for w in set(t.split()))
    want = {}
    for k, (_, t) in enumerate(items):
        tf = Counter(t.split())
        w = {x: math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * f * 2.2 / (f + 1.2) for x, f in tf.items()}
        for q, passage in enumerate(passages):
            s = sum(w[x] for x in set(passage.split()) if x in w) / sum(w.values())
            if s >= 0.45:
                want[(q, k)] = s
    got = {(int(a), int(b)): s for a, b, s in zip(p, item, score)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 20


def linked_by_force(rows):
    sets = []
    for _, t in rows:
        w = word_list(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(key)
    return {key: (len(sets[i]), min(groups[top(i)])) for i, (key, _) in enumerate(rows)}


@pytest.mark.parametrize("part", [8, 1024])
def test_shingle_join(spark, docs, empty, texts, part, monkeypatch):
    monkeypatch.setattr(shingle_join, "PART", part)
    rnd = random.Random(part)
    base = sentence(rnd, 90).split()
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rnd.randrange(0, 8)):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(10**6)}"
        rows.append((5000 + i, " ".join(w)))
    shared = sentence(rnd, 60)
    rows += [(6000 + i, f"{sentence(rnd, 40)} {shared} {sentence(rnd, rnd.randrange(5, 60))}") for i in range(40)]
    rows += [(7000 + i, " ".join(base[: 60 + i])) for i in range(31)]
    some = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(docs.select("doc_id", "text")).repartition(7)
    found = by_id(shingle_join.linked(some))
    want = linked_by_force(rows + list(enumerate(texts)))
    for key, value in want.items():
        assert {(r.n_shingles, r.component_id) for r in found[key]} == {value}, key
    assert len(found[0]) == 3 and found[None][0].component_id is None
    if part == 8:
        assert shingle_join.linked(empty).count() == 0


def test_bounds_never_exclude_a_link():
    rnd = np.random.default_rng(4)
    for _ in range(300):
        n = int(rnd.integers(1, 400))
        a = rnd.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([a[: int(rnd.integers(n // 2, n + 1))], rnd.integers(0, 1 << 62, int(rnd.integers(0, n))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if common and 100 * common >= 75 * (len(a) + len(b) - common):
            x, y = sorted((a, b), key=len)
            n = np.array([len(x), len(y)])
            at = [shingle_join.places_of(shingle_join.places(s)) for s in (x, y)]
            assert [len(s) for s in at] == n.tolist()
            left, _ = shingle_join.candidates(n, at, np.arange(2))
            assert len(left) == 1
            left, _ = shingle_join.candidates(n, [x, y], np.arange(2), folded=False)
            assert len(left) == 1
            assert set(a[: shingle_join.prefix_size(len(a))]) & set(b[: shingle_join.prefix_size(len(b))])


def test_prefixes_of_links_meet_as_often_as_asked():
    rnd = np.random.default_rng(5)
    links = 0
    for k in range(400):
        n = int(rnd.integers(1, 6 if k < 60 else 1500))
        a = rnd.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([a[: int(rnd.integers(3 * n // 4, n + 1))], rnd.integers(0, 1 << 62, int(rnd.integers(0, n // 4 + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = np.intersect1d(a, b)
        if not len(common) or 100 * len(common) < 75 * (len(a) + len(b) - len(common)):
            continue
        links += 1
        count = np.array([len(a), len(b)])
        hot = np.unique(rnd.choice(common, len(common) // 5 + 1))
        prefix, size = shingle_join._prefixes(np.concatenate([a, b]), count, shingle_join.prefix_size(count), hot, shingle_join._flags(hot))
        e = np.zeros(len(prefix), shingle_join.ENTRY)
        e["x"], e["node"] = prefix >> np.uint64(12), np.repeat([7, 8], size)
        place = np.concatenate([np.arange(x) for x in size])
        e["n"], e["place"] = np.repeat(shingle_join.size_codes(count), size), np.minimum(place * 640 // np.repeat(count, size), 255)
        x, node, code, place = shingle_join._met(e)
        p = np.flatnonzero(x[1:] == x[:-1])
        left, right, met, need = shingle_join._near(node, code, place, p, p + 1)
        assert set(left) == {7} and set(right) == {8} and met.sum() >= need[0]
    assert links > 100
    sizes = np.unique(np.concatenate([np.arange(1, 70_000), rnd.integers(1, 1 << 30, 1000)]))
    low, high = shingle_join.size_bounds(shingle_join.size_codes(sizes))
    assert (low <= sizes).all() and (sizes <= high).all() and (high <= 1.003 * low).all()


def test_sets_that_meet_by_chance_are_not_moved(spark, monkeypatch):
    moved = {}

    def counted(df, label, real=shingle_join.stage):
        out = real(df, label)
        moved[label] = moved.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(shingle_join, "stage", counted)
    w = [[f"w{i}x{k}" for k in range(60)] for i in range(120)]
    for i in range(119):
        for k in range(10):
            w[i][6 * k : 6 * k + 5] = [f"s{min(i, (i + k + 1) % 120)}y{max(i, (i + k + 1) % 120)}z{j}" for j in range(5)]
    for i in range(119):
        for k in range(10):
            j = (i + k + 1) % 120
            w[j] += w[i][6 * k : 6 * k + 5]
    rows = [(i, " ".join(x)) for i, x in enumerate(w)]
    found = shingle_join.linked(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.component_id for r in found) == list(range(120))
    assert moved["shingle-sets"] == 120 and moved["shingle-members"] == 0


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    found = {r.id: r.component for r in shingle_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert found == want


def mixed_by_force(rows, target):
    """Rows of key, source, tokens: weights and how often the tokens of a source are taken."""
    tokens = Counter()
    for _, s, n in rows:
        tokens[s] += n
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items() if n}
    at = lambda a: {s: p**a / sum(q**a for q in share.values()) for s, p in share.items()}

    def fits(a):
        w = at(a)
        if target.entropy is not None:
            return -sum(x * math.log(x) for x in w.values()) <= target.entropy + 1e-12
        budget = target.budget or total * max(share[s] / w[s] for s in w)
        return max(w[s] * budget / tokens[s] for s in w) <= target.repeats * (1 + 1e-12)

    low, high = 0.0, 1.0
    if fits(0.0):
        high = 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    w = at(high)
    budget = target.budget or total * max(share[s] / w[s] for s in w)
    return {s: w[s] * budget / tokens[s] for s in w}


@pytest.mark.parametrize("target", [mixing.Target(repeats=1.7), mixing.Target(repeats=None, entropy=1.5), mixing.Target(repeats=3.0, budget=9000), mixing.Target(repeats=90.0)])
def test_mixing(spark, target, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 300)
    rnd = random.Random(7)
    rows = [(i, rnd.choices("abcde", [30, 8, 5, 3, 1])[0], rnd.randrange(1, 12)) for i in range(2500)]
    table = spark.createDataFrame(rows, "doc_id bigint, source string, size int")
    found = mixing.mixed(table, target, n=F.col("size").cast("bigint")).collect()
    assert sorted((r.doc_id, r.source, r.size) for r in found) == sorted(rows)
    want, have, taken = mixed_by_force(rows, target), Counter(), Counter()
    for r in found:
        have[r.source] += r.size
        taken[r.source] += r.size * r.copies
    for s, times in want.items():
        assert taken[s] <= times * have[s] + 1 and taken[s] > times * have[s] - 60, (s, times)
        own = [r for r in found if r.source == s]
        assert {r.copies for r in own} <= {int(times + 1e-9), int(times + 1e-9) + 1}
        blocks = {}
        for r in own:
            blocks.setdefault(r.mix_block, set()).add(r.copies)
        assert sum(len(c) > 1 for c in blocks.values()) <= 1


def test_mixing_of_odd_rows(spark, docs, empty):
    found = mixing.mixed(docs.drop("copies"))
    assert found.count() == docs.count() and found.where("copies < 1").count() == 0
    assert mixing.repeated(mixing.mixed(docs)).count() >= docs.count()
    assert mixing.mixed(empty).count() == 0
    blank = docs.where("text is null or text = ''")
    assert {r.copies for r in mixing.mixed(blank).collect()} == {1}


def test_quality_classifier(spark, docs, empty):
    rnd = random.Random(9)
    rows, marks = [], []
    for i in range(900):
        bad = i % 3 == 0
        text = sentence(rnd, 60) + (" vile rotten" if bad and i % 2 else "") + (" go go go" * 40 if bad and not i % 2 else "")
        rows.append((i, text, "en", "spam" if bad and rnd.random() < 0.7 else f"s{i % 4}", len(text)))
        if i % 2:
            marks.append((i, 1, int(bad)))
        elif rnd.random() < 0.6:
            marks.append((i, int(not bad), 0))
    marks += [(1, 1, 0), (None, 1, 0), (2, None, 1)]
    some = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    model = quality_classifier.train(some, labels)
    found = quality_classifier.scores(some, model).collect()
    assert len(found) == 900 and np.mean([r.kept == (r.doc_id % 3 != 0) for r in found]) > 0.95
    assert quality_classifier.scores(docs, model).count() == docs.count()
    none = quality_classifier.train(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.scores(docs, none).collect()} == {0.5}
    assert quality_classifier.scores(empty, model).count() == 0


def test_confident_labels_go_to_the_other_view():
    rng = np.random.default_rng(1)
    y = rng.random(1200) < 0.6
    keys = [np.unique(np.array([1 if g else 2, *rng.integers(10, 60, 5)], np.uint64)) for g in y]
    meta = np.zeros((1200, 4), np.float32)
    meta[np.arange(1200), np.where(y, 0, 1)] = 1
    label = np.where(np.arange(1200) < 150, y, -1).astype(int)
    model = quality_classifier.co_train(keys, np.zeros((1200, 6), np.float32), meta, label)
    assert ((model.meta.odds(meta) > 0) == y).all()
    x = np.concatenate([quality_classifier.presence(keys, model.keys), np.zeros((1200, 6), np.float32)], 1)
    assert ((model.text.odds(x) > 0) == y).mean() > 0.99


def test_license_scan(spark, docs, empty):
    notices = {
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
        "GPL-2.0": "this work is licensed under the  GNU General Public License version 2",
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
        "CC-BY-4.0": "Licensed under CC BY 4.0.",
        "MIT": "Released under the MIT License.",
        "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    }
    whole = license_scan.TEMPLATES["MIT"][2].replace("restriction,", "restriction,\n").replace("copies of", "copies\nof")
    rnd = random.Random(3)
    rows = [(i, f"{sentence(rnd, 40)}\n{t}\n{sentence(rnd, 40)}") for i, t in enumerate(notices.values())]
    rows += [(50, f"{sentence(rnd, 30)}\n\n{whole}\n\nmore"), (60, "The driving license of the copyright owner was lost with his permission."), (61, "Licensed under the Apache License, Version 3.7.")]
    rows += [(70, f"{notices['MIT']}\nand\n{notices['MIT']}"), (80, f"{sentence(rnd, 60)}. {notices['GPL-3.0']} {sentence(rnd, 60)}")]
    some = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(docs.select("doc_id", "text"))
    found = license_scan.scan(some).collect()
    got = sorted((r.doc_id, r.license) for r in found)
    assert got == sorted([*((i, k) for i, k in enumerate(notices)), (50, "MIT"), (70, "MIT"), (70, "MIT"), (80, "GPL-3.0")])
    assert all(r.missing == r.extra == 0 for r in found)
    assert license_scan.scan(empty).count() == 0

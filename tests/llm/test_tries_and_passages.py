"""The prefix trie, the divergence audit and the passage cutter against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palindra.llm import prefix_trie, source_divergence, suffix_dedup
from palindra.llm.queries import op13_suffix_dedup

SCALE = source_divergence.SCALE
TURNS = "conv_id bigint, turn int, role string, text string, n_convs string"


def nodes_by_force(convs):
    """convs: {conv_id: [(role, text), ...]}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = [out[k] for k in kids.get(p, [])]
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(b[6] for b in below)
        ended = ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out[p] = (min(members[p]), len(p), parent, len(members[p]), len(below), sum(b[5] for b in below) or 1, saved,
                  hashlib.sha256(ended.encode()).hexdigest())
    return sorted(out.values())


def rebuilt_by_force(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


@pytest.fixture(scope="module")
def conversations():
    rnd = random.Random(11)
    made = {}
    for c in range(120):
        if c % 11 == 4:
            continue
        n = rnd.choice([1, 1, 2, 3, 5, 8, 9, 12, 16, 17, 25, 40])
        made[c] = [(rnd.choice(["user", "assistant"]), rnd.choice(["a", "bé", ""])) for _ in range(n)]
    made[200] = list(made[7]) + [("user", "more")] * 30  # copies of a long one, one goes on
    for c in (201, 202, 203):
        made[c] = list(made[200])
    return made


def as_rows(spark, convs):
    rnd = random.Random(5)
    rows = [(c, None if i == 0 else i, None if r == "" else r, t or None, "x") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rnd.shuffle(rows)
    return spark.createDataFrame([*rows, (None, 0, "user", "lost", "x")], TURNS)


@pytest.mark.parametrize("rebuild", [True, False])
def test_prefix_trie(spark, conversations, rebuild, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PART_BITS", 3)  # many parts to a conversation and to a node
    turns = prefix_trie.own_turns(as_rows(spark, conversations))
    laid = prefix_trie.with_shared_heads(turns) if rebuild else prefix_trie.as_they_are(turns)
    found = sorted((tuple(r) for r in prefix_trie.trie(laid).collect()))
    assert found == nodes_by_force(rebuilt_by_force(conversations) if rebuild else conversations)


def test_prefix_trie_of_few(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.own_turns(empty))).collect() == []
    # 3: h is above its one turn and its lead is absent, so nothing is left of it.
    convs = next({c: [("user", "x")]} for c in range(1, 5) if zlib.crc32(str(c).encode()) % 9)
    found = prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.own_turns(as_rows(spark, convs)))).collect()
    assert [tuple(r) for r in found] == nodes_by_force(rebuilt_by_force(convs))
    # Rows that repeat, and turns of one number, are turns of their own.
    same = spark.createDataFrame([(5, 1, "user", "x", ""), (5, 1, "user", "x", ""), (5, 1, "user", "a", "")], TURNS)
    found = prefix_trie.trie(prefix_trie.as_they_are(prefix_trie.own_turns(same))).collect()
    assert sorted(r.depth for r in found) == [0, 1, 2, 3]


def divergence_by_force(rows, min_docs=3, top=200):
    import re

    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    langs = {}
    for lang, source, text in rows:
        words = term.findall((text or "").translate(low))
        langs.setdefault(lang or "", []).append((source or "", words))
    out = []
    for lang, docs in langs.items():
        seen = {}
        for i, (_, words) in enumerate(docs):
            for w in words:
                seen.setdefault(w, set()).add(i)
        kept = [w for w, d in seen.items() if len(d) >= min_docs]
        counts = {s: dict.fromkeys(kept, 0) for s, _ in docs}
        for s, words in docs:
            for w in words:
                if w in counts[s]:
                    counts[s][w] += 1
        whole = {w: sum(c[w] for c in counts.values()) for w in kept}
        p = lambda c, w: 1 + SCALE * (c[w] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(sum(f(p(counts[s], w), p(counts[o], w)) for w in kept), o) for o in counts if o != s]
            terms = [(f(p(counts[s], w), p(whole, w)), w) for w in kept if counts[s][w] and p(counts[s], w) > p(whole, w)]
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


DOCS = "lang string, source string, text string, term string, n int"


@pytest.mark.parametrize("pairs, few", [(1 << 21, 100_000), (3, 0)])
def test_divergence(spark, pairs, few, monkeypatch):
    monkeypatch.setattr(source_divergence, "PAIRS", pairs)
    monkeypatch.setattr(source_divergence, "FEW_GROUPS", few)
    rnd = random.Random(12)
    vocabulary = ["Ant", "bee", "ÇA", "dé", "x1y", "end", "漢字", "ok"]
    rows = [(rnd.choice(["en", "fr", None]), rnd.choice("pqrst"), " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 9))), "", 1) for _ in range(150)]
    rows += [("de", "only", "rare words", "", 1), ("de", None, None, "", 1), ("en", "p", "ant " * 3000, "", 1), ("en", "q", "", "", 1)]
    rows += [rows[-2]] * 5
    found = source_divergence.report(spark.createDataFrame(rows, DOCS).repartition(3), top=4)
    assert sorted(tuple(r) for r in found.collect()) == divergence_by_force([r[:3] for r in rows], top=4)
    assert source_divergence.report(spark.createDataFrame([], DOCS)).collect() == []


def test_tree_counts_shared_paths_once():
    rows = [[(1, 1), (2, 5), (3, 1)], [(1, 1), (2, 5), (4, 2)], [(1, 1), (3, 1)], [(2, 5), (3, 1)]]
    offsets = np.cumsum([0, *map(len, rows)])
    sid, n = np.array([x for r in rows for x in r]).T
    first, parent, weight = source_divergence.tree_nodes(np.zeros(4, int), offsets, sid, n, np.array([3, 2, 1, 7]))
    nodes = {(tuple(sid[p:f]), sid[f]): w for f, p, w in zip(first.tolist(), parent.tolist(), weight.tolist())}
    assert nodes == {((1,), 2): 5, ((1, 2), 3): 3, ((1, 2), 4): 2, ((1,), 3): 1, ((2,), 3): 7}


def cut_by_force(rows, k=suffix_dedup.LENGTH):
    least, out = {}, []
    for d, t in rows:
        b, d = (t or "").encode(), suffix_dedup.NO_ID if d is None else d
        for i in range(len(b) - k + 1):
            least[b[i : i + k]] = min(d, least.get(b[i : i + k], d))
    for d, t in rows:
        b, known = (t or "").encode(), suffix_dedup.NO_ID if d is None else d
        gone = set()
        for i in range(len(b) - k + 1):
            if least[b[i : i + k]] < known:
                gone.update(range(i, i + k))
        spans = sum(i in gone and i - 1 not in gone for i in range(len(b)))
        left = bytes(c for i, c in enumerate(b) if i not in gone)
        out.append((d, len(b), len(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(2, 7)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 25)))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, 60)
            parts += [s[a : a + rnd.randint(45, 120)], word()]
        rows.append((rnd.randint(0, 3 * n), "".join(parts)))
    long = "".join(rnd.choices("xyz ", k=3000))
    rows += [(3, "ab" * 200), (9, "ab" * 90), (None, shared[0]), (None, shared[1]), (1, None), (2, ""), (5, "x" * 49), (6, "x" * 50)]
    return rows + [rows[0], (0, long), (7, long[:1200] + "!" + long[1300:]), (7, long), (8, shared[0][:50]), (9, shared[0][:50])]


@pytest.mark.parametrize("hot, size, segment", [(512, 1 << 23, 1 << 20), (1, 700, 333)])
def test_suffix_dedup(spark, tmp_path, hot, size, segment, monkeypatch):
    for name, value in (("HOT", hot), ("SLICE", size), ("SEGMENT", segment), ("BUCKET_BYTES", 4000), ("BUCKET_ANCHORS", 100)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = passages(13)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, kept string").repartition(3)
    # Constants do not travel to tasks with functions of an imported module, so tasks are run here.
    slices = [r.asDict() for r in suffix_dedup.to_slices(docs).collect()]
    assert sum(r["bytes"] for r in slices) == sum(len((t or "").encode()) for _, t in rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = op13_suffix_dedup(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in found), key=str) == cut_by_force(rows)
    in_process = run_here(rows, size)
    assert sorted(in_process, key=str) == cut_by_force(rows)


def run_here(rows, size):
    """The steps of the operator without Spark, under the settings of the test."""
    import uuid

    import pyarrow as pa
    import zstandard

    from palindra.llm.lm_scoring import pack

    slices, held = [], []
    for row in [*rows, None]:
        if row is None or sum(len((t or "").encode()) for _, t in held) > size:
            texts = [(t or "").encode() for _, t in held]
            ids = [suffix_dedup.NO_ID if d is None else d for d, _ in held]
            known = [d is not None for d, _ in held]
            slices.append({
                "slice": uuid.uuid4().hex, "ids": pack(np.array(ids)), "known": pack(np.array(known, np.uint8)),
                "sizes": pack(np.array([len(t) for t in texts])), "body": zstandard.compress(b"".join(texts)), "bytes": sum(map(len, texts)),
            })
            held = []
        held.append(row)
    shift, bits = 40, 2
    by = lambda table: {b: table.filter(pa.compute.equal(table["bucket"], b)) for b in set(table["bucket"].to_pylist())}
    mine = {s["slice"]: suffix_dedup.Slice(s).told(shift) for s in slices}
    told = []
    for name, m in mine.items():
        at = suffix_dedup._bounds(m, bits, 64 - shift)
        told += [(b, name, suffix_dedup.pack_sorted(m[at[b] : at[b + 1]])) for b in range(1 << bits) if at[b] < at[b + 1]]
    answers = [suffix_dedup.answer(t) for t in by(suffix_dedup._table(suffix_dedup.TOLD, list(map(list, zip(*told))))).values()]
    replies = pa.concat_tables(answers)
    own = lambda t, s: t.filter(pa.compute.equal(t["slice"], s["slice"]))
    tables = {s["slice"]: pa.table({k: [v] for k, v in s.items()}) for s in slices}
    reads = pa.concat_tables(suffix_dedup.send(shift, bits)(tables[s["slice"]], own(replies, s)) for s in slices)
    replies = pa.concat_tables([replies, *[suffix_dedup.match(t) for t in by(reads).values()]])
    out = []
    for s in slices:
        for r in suffix_dedup.cut(shift, bits)(tables[s["slice"]], own(replies, s)).to_pylist():
            gone = sum(x["end"] - x["start"] for x in r["removed"])
            out.append((r["doc_id"], r["n_bytes"], gone, len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()))
    return out


def test_suffix_dedup_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_dedup.without_repeats(docs).collect() == []
    docs = spark.createDataFrame([(1, None), (2, "short")], "doc_id bigint, text string")
    assert suffix_dedup.without_repeats(docs).where(F.size("removed") > 0).count() == 0


def test_collection():
    rng = np.random.default_rng(1)
    for _ in range(30):
        docs = [bytes(rng.integers(97, 100, rng.integers(1, 12)).astype(np.uint8)) for _ in range(rng.integers(1, 30))]
        made = suffix_dedup.Collection(np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)]))
        order = sorted((d[i:], r, i) for r, d in enumerate(docs) for i in range(len(d) + 1))
        common = [next((k for k, (x, y) in enumerate(zip(a[0], b[0])) if x != y), min(len(a[0]), len(b[0]))) for a, b in zip(order, order[1:])]
        assert made.symbol.tolist() == [docs[r][i - 1] if i else suffix_dedup.END for _, r, i in order]
        assert made.common.tolist() == [0, *common]


def test_least():
    rng = np.random.default_rng(2)
    for n in (1, 5, 64, 65, 129, 1000):
        values = rng.integers(0, 255, n).astype(np.uint8)
        lo, hi = np.sort(rng.integers(0, n, (2, 500)), axis=0)
        assert suffix_dedup.Least(values)(lo, hi).tolist() == [values[a : b + 1].min() for a, b in zip(lo, hi)]

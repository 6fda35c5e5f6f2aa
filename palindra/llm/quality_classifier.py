"""A quality classifier by co-training on two views of a document.

One classifier sees the text: words and word beginnings that tell good from bad
documents of the sample apart, and measures of how it is written. The other sees the
page's metadata: hashed category values and sizes by powers of two. Both are logistic
regressions, calibrated on labelled rows they were not fitted on. For some rounds each
labels the documents of an unlabelled pool it is surest of, and these join the other's
training rows. A view that is never sure labels nothing. In the end the calibrated log
odds of both views, less the prior's once, score every document, whole.

Fitting takes at most about ``LABELLED`` labelled rows and ``POOL`` others, chosen by a
hash of the key; labels are first reduced to one row a key (bad if any says so).

A row is good if its quality is not 0 and it is not toxic; null labels teach nothing.
A null text counts as empty and metadata that is null as a value of its own. Without
good and bad labelled rows every score is the share of good ones, or 0.5 if there are
none. Repeated rows score alike; an empty table gives no rows; other columns are not
returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palindra.llm.words import Spans, Texts, mix, slices, texts_of, words

LABELLED, POOL = 6_000, 6_000
FEATURES = 1_500
ROUNDS, SURE, MOST = 4, 0.97, 300
META_BUCKETS = 256
BEGINNING = 4

_symbol = np.zeros(256, bool)
_symbol[[ord(c) for c in "#*$%&|<>"]] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True


def text_keys(texts: Texts, found: Spans) -> np.ndarray:
    """Hashes of the words and of the first bytes of longer words."""
    letters = np.zeros(len(found.start), np.uint64)
    size = found.end - found.start
    for k in range(BEGINNING):
        at = np.minimum(found.start + k, len(texts.data) - 1)
        letters = letters * np.uint64(256) + np.where(k < size, texts.data[at] | np.uint8(32), 0).astype(np.uint64)
    start = mix(letters + np.uint64(0x2545F4914F6CDD1D))
    return np.concatenate([found.hash, start[size > BEGINNING]]), np.concatenate([found.doc, found.doc[size > BEGINNING]])


def style(texts: Texts, lo: int, hi: int, found: Spans) -> np.ndarray:
    """How texts are written: length, variety, symbols, capitals, exclamation, word length."""
    n = found.counts(hi - lo).astype(float)
    pair = np.unique(found.doc.astype(np.uint64) * np.uint64(1 << 40) ^ (found.hash >> np.uint64(24)))
    distinct = np.bincount((pair >> np.uint64(40)).astype(np.int64) if len(pair) else [], minlength=hi - lo)[: hi - lo]
    begin, end = texts.starts[lo:hi], texts.ends[lo:hi]

    def share(mask: np.ndarray) -> np.ndarray:
        part = texts.data[begin[0] : end[-1]]
        sums = np.concatenate([[0], np.cumsum(mask[part], dtype=np.int64)])
        return (sums[end - begin[0]] - sums[begin - begin[0]]) / np.maximum(end - begin, 1)

    bang = np.zeros(256, bool)
    bang[33] = True
    variety = np.where(n > 1, np.log(np.maximum(distinct, 1)) / np.log(np.maximum(n, 2)), 1.0)
    return np.stack(
        [
            np.log1p(n) / 8,
            variety * 4,
            np.minimum(share(_symbol) * 20, 3),
            np.minimum(share(_upper) * 4, 3),
            np.minimum(share(bang) * 20, 3),
            np.minimum((end - begin) / np.maximum(n, 1) / 10, 3),
        ],
        1,
    ).astype(np.float32)


@dataclass
class Calibrated:
    """A logistic regression and the line that makes its output log odds."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (x @ self.weights + self.bias) + self.shift


@dataclass
class Model:
    """Both views, the text features they know, and the prior's log odds."""

    keys: np.ndarray
    text: Calibrated | None
    meta: Calibrated | None
    prior: float


def _newton(x: np.ndarray, y: np.ndarray, start: tuple[float, float]) -> tuple[float, float]:
    """Slope and shift of a calibration line by a few damped Newton steps."""
    a, b = start
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def fit_view(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, rounds: int = 150) -> Calibrated:
    """Fit on four fifths of the rows, calibrate on the rest."""
    test = np.arange(len(x)) % 5 == 4
    a, side = x[~test], np.where(y[~test], 1.0, -1.0).astype(np.float32)
    weight = np.where(side > 0, 0.5 / max((side > 0).mean(), 1e-6), 0.5 / max((side < 0).mean(), 1e-6)).astype(np.float32)
    step = 4.0 / max((a * a).sum(1).mean(), 1.0)
    w, v, b, vb = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0
    for k in range(rounds):
        slope = -side * weight / (1 + np.exp(np.clip(side * (a @ v + vb), -30, 30))) / len(a)
        new_w, new_b = v - step * (a.T @ slope + decay * v), vb - step * float(slope.sum())
        m = k / (k + 3)
        v, vb = (new_w + m * (new_w - w)).astype(np.float32), new_b + m * (new_b - b)
        w, b = new_w.astype(np.float32), new_b
    model = Calibrated(w, b)
    if test.any():
        raw = x[test] @ w + b
        model.slope, model.shift = _newton(raw.astype(float), y[test].astype(float), (1.0, 0.0))
        if model.slope < 0:  # it knows nothing
            share = np.clip(y[test].mean(), 1e-3, 1 - 1e-3)
            model.slope, model.shift = 0.0, float(np.log(share / (1 - share)))
    return model


def choose(keys: list[np.ndarray], y: np.ndarray, most: int = FEATURES) -> np.ndarray:
    """The keys whose presence differs most between good and bad rows, by chi-square."""
    every = np.concatenate(keys)
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    distinct, at = np.unique(every, return_inverse=True)
    n1, n0 = y.sum(), (~y).sum()
    good = np.bincount(at, y[owner], minlength=len(distinct))
    bad = np.bincount(at, ~y[owner], minlength=len(distinct))
    df = good + bad
    expected = df * n1 / (n1 + n0)
    chi = (good - expected) ** 2 / np.maximum(expected, 1e-9) + (bad - df + expected) ** 2 / np.maximum(df - expected, 1e-9)
    chi[df < max(3, len(keys) // 2000)] = 0
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(distinct[best[chi[best] > 0]])


def presence(keys: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    out = np.zeros((len(keys), len(known)), np.float32)
    if len(known):
        for i, k in enumerate(keys):
            at = np.minimum(np.searchsorted(known, k), len(known) - 1)
            out[i, at[known[at] == k]] = 1
    return out


def co_train(keys: list[np.ndarray], writing: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> Model:
    """``label``: 1 good, 0 bad, -1 unlabelled."""
    known = label >= 0
    good = label[known] == 1
    share = float(good.mean()) if known.any() else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    if not known.any() or good.all() or not good.any():
        return Model(np.empty(0, np.uint64), None, None, prior)
    features = choose([k for k, own in zip(keys, known) if own], good)
    views = [np.concatenate([presence(keys, features), writing], 1), meta]
    seen = [np.where(known, label, -1), np.where(known, label, -1)]
    models: list[Calibrated] = []
    for turn in range(rounds + 1):
        # labelled rows first, so that the rows set aside for calibration are spread over both kinds
        models = [fit_view(v[s >= 0], s[s >= 0] == 1) for v, s in zip(views, seen)]
        if turn == rounds:
            break
        for of, to in ((0, 1), (1, 0)):
            free = np.flatnonzero(seen[to] < 0)
            if not len(free):
                continue
            p = 1 / (1 + np.exp(-np.clip(models[of].odds(views[of][free]), -30, 30)))
            most_good = max(1, int(MOST * share))
            for value, sure, most in ((1, p, most_good), (0, 1 - p, MOST - most_good)):
                best = np.argsort(-sure, kind="stable")[:most]
                seen[to][free[best[sure[best] >= SURE]]] = value
    return Model(features, models[0], models[1], prior)


def _views(batch: pa.RecordBatch):
    """Per row of ``text, categories, sizes``: distinct text keys, style, metadata buckets."""
    texts = texts_of(batch.column("text"))
    meta = batch.column("meta").to_pylist()
    for lo, hi in slices(texts):
        found = words(texts, lo, hi)
        keys, doc = text_keys(texts, found)
        order = np.lexsort((keys, doc))
        keys, doc = keys[order], doc[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        keys, doc = keys[fresh], doc[fresh]
        at = np.searchsorted(doc, np.arange(hi - lo + 1))
        look = style(texts, lo, hi, found)
        for i in range(hi - lo):
            yield lo + i, keys[at[i] : at[i + 1]], look[i], meta[lo + i]


def with_meta(docs: DataFrame, key: str, text: str, categories: list[str], sizes: list[str]) -> DataFrame:
    """Rows of ``key, text, meta``: the buckets of the metadata's values."""
    values = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in categories]
    values += [F.concat(F.lit(f"{c}~"), F.coalesce(F.floor(F.log2(F.col(c).cast("double") + 1)).cast("string"), F.lit("null"))) for c in sizes]
    buckets = F.array(*[F.pmod(F.xxhash64(v), F.lit(META_BUCKETS)).cast("int") for v in values])
    return docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"), buckets.alias("meta"))


def meta_row(buckets: list[int]) -> np.ndarray:
    out = np.zeros(META_BUCKETS, np.float32)
    out[buckets] = 1
    return out


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    categories: tuple[str, ...] = ("source", "lang"),
    sizes: tuple[str, ...] = ("n_chars",),
) -> Model:
    """Co-train on bounded samples of labelled and unlabelled documents."""
    rows = with_meta(docs, key, text, list(categories), list(sizes))
    known = labels.select(F.col(key).cast("bigint").alias("key"), F.col("quality"), F.col("toxic")).where("key is not null and quality is not null")
    marks = known.groupBy("key").agg((F.min((F.col("quality") != 0) & (F.coalesce("toxic", F.lit(0)) == 0))).cast("int").alias("label"))
    n_marks, n_docs = marks.count(), docs.count()
    grain = 1 << 30

    def some(n: int, of: int, salt: str):
        return F.pmod(F.xxhash64(F.lit(salt), "key"), F.lit(grain)) < F.lit(int(min(1.0, n / max(of, 1)) * grain))

    picked = marks.where(some(LABELLED, n_marks, "label")).limit(2 * LABELLED)
    pool = rows.where(some(POOL, n_docs, "pool")).join(F.broadcast(picked), "key", "left").limit(2 * POOL)
    taught = rows.join(F.broadcast(picked), "key").limit(2 * LABELLED)
    sample = taught.unionAll(pool.where("label is null").select(taught.columns))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, label = batch.column("key").to_pylist(), batch.column("label").to_pylist()
            found = [(key[i], label[i], k.tobytes(), s.tobytes(), m) for i, k, s, m in _views(batch)]
            cols = list(zip(*found)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "label", "keys", "style", "meta"])

    got = sample.mapInArrow(features, "key bigint, label int, keys binary, style binary, meta array<int>").collect()
    got.sort(key=lambda r: (r.label is None, r.key is None, int(mix(np.array([r.key or 0], np.int64).view(np.uint64))[0]), bytes(r.keys)))
    keys = [np.frombuffer(r["keys"], np.uint64) for r in got]
    writing = np.array([np.frombuffer(r.style, np.float32) for r in got], np.float32).reshape(len(got), 6)
    meta = np.array([meta_row(r.meta) for r in got], np.float32).reshape(len(got), META_BUCKETS)
    label = np.array([-1 if r.label is None else r.label for r in got], int)
    return co_train(keys, writing, meta, label)


def scores(
    docs: DataFrame,
    model: Model,
    key: str = "doc_id",
    text: str = "text",
    categories: tuple[str, ...] = ("source", "lang"),
    sizes: tuple[str, ...] = ("n_chars",),
) -> DataFrame:
    """Rows of ``doc_id, text_score, meta_score, score, kept``."""
    schema = "doc_id bigint, text_score double, meta_score double, score double, kept boolean"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.keys)
        for batch in batches:
            text_odds, meta_odds = np.full(batch.num_rows, model.prior), np.full(batch.num_rows, model.prior)
            if model.text is not None:
                word, shape = model.text.weights[:n], model.text.weights[n:]
                for i, k, s, m in _views(batch):
                    raw = float(s @ shape) + model.text.bias
                    if n:
                        at = np.minimum(np.searchsorted(model.keys, k), n - 1)
                        raw += float(word[at[model.keys[at] == k]].sum())
                    text_odds[i] = model.text.slope * raw + model.text.shift
                    meta_odds[i] = model.meta.odds(meta_row(m))
            odds = text_odds + meta_odds - model.prior
            out = [1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in (text_odds, meta_odds, odds)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *map(pa.array, out), pa.array(odds >= 0)], names)

    return with_meta(docs, key, text, list(categories), list(sizes)).mapInArrow(run, schema)

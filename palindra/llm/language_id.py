"""Language identification by error-correcting output codes.

Every language has a codeword; for each of its bits one binary classifier (logistic
regression over hashed byte n-grams of the letters) predicts on which side of the
bit's division a text lies. A text gets the language whose codeword has the least
weighted logistic loss; a bit weighs for a language as much as it was right about it
on the part of the sample it was not fitted on. The score is the share of the chosen
language if losses are taken as log odds; ``ambiguous`` marks texts where the
second-best is within ``MARGIN`` of it.

The classifiers are fitted on about ``FIT_ROWS`` labelled rows, dealt evenly to the
languages and chosen by a hash of the key. Every text is read whole.

Rows whose language or text is null or whose text has no letter teach nothing. A null
text or one without a letter is ``und`` with score 0; so is every text if nothing can
be learned. With one language every other text has that one with score 1. Repeated
rows each give a result, and other columns of the input are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palindra.llm.words import Texts, texts_of

FIT_ROWS = 6_000
BUCKETS = 1 << 12
MARGIN = 0.2
SEGMENT = 1 << 20

_plain = np.full(256, 32, np.uint32)
_plain[65:91] = np.arange(97, 123)
_plain[97:123] = np.arange(97, 123)
_plain[128:] = np.arange(128, 256)
_ascii_letter = np.zeros(256, bool)
_ascii_letter[[*range(65, 91), *range(97, 123)]] = True


def _bucket(gram: np.ndarray) -> np.ndarray:
    h = gram * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    return h >> np.uint32(20)


def grams(data: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the n-grams of one to three bytes, by bucket."""
    counts = np.zeros(BUCKETS)
    for p in range(0, len(data), SEGMENT):
        one = _plain[data[max(0, p - 2) : p + SEGMENT]]
        fresh = p - max(0, p - 2)  # bytes that an earlier segment has counted
        two = one[:-1] * np.uint32(257) + one[1:]
        three = two[:-1] * np.uint32(257) + one[2:]
        for gram, skip in ((one, fresh), (two + np.uint32(1 << 20), max(fresh - 1, 0)), (three + np.uint32(1 << 27), 0)):
            counts += np.bincount(_bucket(gram[skip:]), minlength=BUCKETS)
    return np.sqrt(counts / max(counts.sum(), 1)).astype(np.float32)


def has_letter(data: np.ndarray) -> bool:
    if _ascii_letter[data].any():
        return True
    return bool((data >= 128).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace"))


def codewords(n: int) -> np.ndarray:
    """One row of -1 and 1 for each of ``n`` languages, no two alike nor opposite bits.

    Up to seven languages take every division in two, more of them as many random
    divisions as ten times the logarithm of their number.
    """
    if n < 2:
        return np.zeros((n, 0))
    if n <= 7:
        divisions = [[1 if i == 0 or not d >> (i - 1) & 1 else -1 for i in range(n)] for d in range(1, 1 << (n - 1))]
        return np.array(divisions, float).T
    rng, kept = np.random.default_rng(n), {}
    while len(kept) < int(10 * np.ceil(np.log2(n))):
        bit = rng.choice([-1.0, 1.0], n)
        if abs(bit.sum()) < n:
            kept.setdefault(tuple(bit * bit[0]), None)
    return np.array(list(kept)).T


@dataclass
class Model:
    """Languages, their codewords, weights of the bits for each, and the classifiers."""

    languages: list[str]
    code: np.ndarray
    trust: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of every codeword for every row of features."""
        side = x @ self.weights + self.bias
        loss = np.logaddexp(0, -side[:, None, :] * self.code[None])
        return (loss * self.trust[None]).sum(2) * self.code.shape[1]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 150, step: float = 8.0, decay: float = 2e-4):
    """Logistic regressions for all columns of ``y`` by accelerated gradient descent."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb = w.copy(), b.copy()
    for k in range(rounds):
        slope = -y / (1 + np.exp(np.clip(y * (x @ vw + vb), -30, 30))) / max(len(x), 1)
        new_w, new_b = vw - step * (x.T @ slope + decay * vw), vb - step * 0.1 * slope.sum(0)
        m = k / (k + 3)
        vw, vb = new_w + m * (new_w - w), new_b + m * (new_b - b)
        w, b = new_w.astype(np.float32), new_b.astype(np.float32)
    return w, b


def fit(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Model:
    """Fit the bits on four fifths of the rows, weigh them on the rest."""
    code = codewords(len(languages))
    if code.shape[1] == 0:
        return Model(languages, code, code, np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    sides = code[y].astype(np.float32)
    test = np.arange(len(x)) % 5 == 4
    w, b = _logistic(x[~test], sides[~test])
    right = ((x[test] @ w + b) * sides[test]) > 0
    trust = np.full(code.shape, 1.0)
    for i in range(len(languages)):
        own = right[y[test] == i]
        trust[i] = (own.sum(0) + 1) / (len(own) + 2)
    return Model(languages, code, trust / trust.sum(1, keepdims=True), w, b)


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = FIT_ROWS) -> Model:
    """Fit on a bounded sample of the given rows; all of them may teach."""
    known = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return fit(np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), [])
    each, grain = max(sample // len(languages), 20), 1 << 30
    rate = F.lit(0)
    for name in languages:
        rate = F.when(F.col("lang") == name, F.lit(int(min(1.0, each / sizes[name]) * grain))).otherwise(rate)
    picked = known.where(F.pmod(F.xxhash64(F.lit("fit"), "key"), F.lit(grain)) < rate).limit(2 * each * len(languages))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = texts_of(batch.column(1)), []
            for s, e in zip(texts.starts, texts.ends):
                data = texts.data[s:e]
                out.append(grams(data).astype("<f2").tobytes() if has_letter(data) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["key", "lang", "x"])

    rows = picked.select(F.col("key").cast("string").alias("key"), "text", "lang")
    seen = rows.mapInArrow(features, "key string, lang string, x binary")
    found = sorted((r for r in seen.collect() if r.x is not None), key=lambda r: (r.key or "", r.lang, bytes(r.x)))
    languages = sorted({r.lang for r in found})
    x = np.array([np.frombuffer(r.x, "<f2") for r in found], np.float32).reshape(len(found), BUCKETS)
    y = np.array([languages.index(r.lang) for r in found], int)
    order = np.random.default_rng(0).permutation(len(found))
    return fit(x[order], y[order], languages)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``doc_id, held_out, lang_pred, score, ambiguous`` for every text."""

    def labelled(texts: Texts):
        n = len(texts)
        names, scores, ambiguous = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
        if not model.languages:
            return names, scores, ambiguous
        for lo in range(0, n, 256):
            rows = [i for i in range(lo, min(lo + 256, n)) if has_letter(texts.data[texts.starts[i] : texts.ends[i]])]
            if not rows:
                continue
            x = np.array([grams(texts.data[texts.starts[i] : texts.ends[i]]) for i in rows])
            if len(model.languages) == 1:
                names[rows], scores[rows] = model.languages[0], 1.0
                continue
            loss = model.losses(x)
            best = loss.argmin(1)
            odds = np.exp(loss.min(1, keepdims=True) - loss)
            share = np.sort(odds / odds.sum(1, keepdims=True), 1)
            names[rows] = np.array(model.languages, object)[best]
            scores[rows] = share[:, -1]
            ambiguous[rows] = share[:, -1] - share[:, -2] < MARGIN
        return names, scores, ambiguous

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, ambiguous = labelled(texts_of(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores), pa.array(ambiguous)],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    taken = docs.select(
        F.col(key).cast("bigint").alias("doc_id"), is_held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("text")
    )
    return taken.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")

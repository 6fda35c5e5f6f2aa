"""Language-model scores by deleted interpolation of n-gram estimates.

The log10 probability of a text under ``l2 c(h w)/c(h) + l1 c(w)/N + l0/(V+1)`` for
every word ``w`` after ``h``. The three weights depend on the bucket of the context's
frequency (by powers of two) and are learned by expectation-maximisation: estimates
from one part of the training documents, mixed to fit the counts of the other part.
Scores then use the counts of both.

How it runs. Tasks turn documents into chunks of about ``CHUNK`` tokens: the distinct
words of the chunk and, for every token, its number among them. Counts are
asked for and answered in bulk: a chunk sends its distinct words and word pairs, as
sorted 64-bit hashes with their counts, to the buckets of the hash's leading bits; a
bucket adds up what all chunks sent and answers each with the totals. So a frequent
word is one entry per chunk, no bucket holds more than its share of hashes, and rows
are moved packed. Nothing of the corpus passes through the driver but totals and, for
the mixture weights, the held-out counts by cells of equal estimates (to an eighth of
a power of e), whose number does not grow with the corpus.

A document that is longer than a chunk is a chunk of its own. Words are
``[^\\x20\\x09-\\x0D]+``, A-Z as a-z; an end follows and counts as a token. A null or
empty text is an end alone. Rows that repeat are scored and counted each; an empty
table gives no rows. Without training rows every count is 0, and without held-out
rows the weights stay as they start. No other columns are returned.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palindra.llm.words import mix, slices, texts_of, words
from palindra.session import fresh_path

CHUNK = 1_500_000
#: Tokens whose hashes one bucket gets, about.
BUCKET = 2_000_000
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
FIT, HELD, OTHER = 0, 1, 2
BUCKETS, CELLS, ROUNDS = 24, 8, 40
START_WEIGHTS = np.array([0.1, 0.4, 0.5])

CHUNKS = "chunk string, kind int, doc_ids binary, known_ids binary, sizes binary, vocab binary, tokens binary"
ASKED = "bucket int, chunk string, kind int, words binary, word_counts binary, pairs binary, pair_counts binary"
ANSWERS = "chunk string, kind int, bucket int, words binary, pairs binary"


def pack(a: np.ndarray) -> bytes:
    """Integers, equal bytes of all of them side by side, then zstandard."""
    rows = np.ascontiguousarray(a)
    return zstandard.compress(rows.view(np.uint8).reshape(len(rows), rows.itemsize).T.tobytes(), 1) if len(rows) else b""


def unpack(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def remainder(key: Column, by: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(by)), F.lit(-1))


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9FB21C651E98DF25) + word)


def _table(columns: dict[str, list], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.table({n: pa.array(columns[n], kinds[k]) for n, k in (f.split() for f in schema.split(", "))})


def to_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of ``key, text, kind`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {k: [] for k in (FIT, HELD, OTHER)}
        count = dict.fromkeys(held, 0)

        def chunk(kind: int) -> Iterator[pa.RecordBatch]:
            ids, known, sizes, hashes = (np.concatenate(x) for x in zip(*held[kind]))
            vocab, tokens = np.unique(hashes, return_inverse=True)
            row = {
                "chunk": [uuid.uuid4().hex],
                "kind": [kind],
                "doc_ids": [pack(ids)],
                "known_ids": [pack(known.astype(np.uint8))],
                "sizes": [pack(sizes)],
                "vocab": [pack_sorted(vocab)],
                "tokens": [pack(tokens.astype(np.uint32))],
            }
            held[kind], count[kind] = [], 0
            yield from _table(row, CHUNKS).to_batches()

        for batch in batches:
            keys, texts, kinds = batch.column(0), texts_of(batch.column(1)), batch.column(2).to_numpy()
            known = keys.is_valid().to_numpy(zero_copy_only=False)
            ids = keys.fill_null(0).to_numpy()
            for lo, hi in slices(texts):
                found = words(texts, lo, hi)
                n = found.counts(hi - lo)
                ends = np.cumsum(n)
                hashes = np.insert(found.hash, ends, END)
                owner = np.repeat(np.arange(hi - lo), n + 1)
                for kind in np.unique(kinds[lo:hi]).tolist():
                    mine = np.flatnonzero(kinds[lo:hi] == kind)
                    own = hashes[np.isin(owner, mine)]
                    if held[kind] and count[kind] + len(own) > CHUNK:
                        yield from chunk(kind)
                    held[kind].append((ids[lo + mine], known[lo + mine], n[mine] + 1, own))
                    count[kind] += len(own)
        for kind in held:
            if held[kind]:
                yield from chunk(kind)

    return docs.select("key", "text", "kind").mapInArrow(run, CHUNKS)


class Chunk:
    """A chunk unpacked, with its distinct pairs."""

    def __init__(self, row: dict):
        self.ids, self.known = unpack(row["doc_ids"], np.int64), unpack(row["known_ids"], np.uint8)
        self.sizes = unpack(row["sizes"], np.int64)
        self.vocab, self.tokens = unpack_sorted(row["vocab"]), unpack(row["tokens"], np.uint32).astype(np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        hashes = self.vocab[self.tokens]
        before = np.concatenate([[START], hashes[:-1]])
        before[first] = START
        self.begins = np.zeros(len(hashes), bool)
        self.begins[first] = True
        self.pairs, self.pair = np.unique(pair_hash(before, hashes), return_inverse=True)


def _split(a: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the sorted hashes of every bucket."""
    tops = (np.arange(1 << bits, dtype=np.uint64)) << np.uint64(64 - bits)
    return np.append(np.searchsorted(a, tops), len(a))


def asked(chunks: DataFrame, bits: int) -> DataFrame:
    """What every chunk asks of and tells to every bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                wc = np.bincount(c.tokens, minlength=len(c.vocab)).astype(np.uint32)
                pc = np.bincount(c.pair, minlength=len(c.pairs)).astype(np.uint32)
                ws, ps = _split(c.vocab, bits), _split(c.pairs, bits)
                out: dict[str, list] = {f.split()[0]: [] for f in ASKED.split(", ")}
                for b in range(1 << bits):
                    w, p = slice(ws[b], ws[b + 1]), slice(ps[b], ps[b + 1])
                    if w.start == w.stop and p.start == p.stop:
                        continue
                    cells = (b, row["chunk"], row["kind"], pack_sorted(c.vocab[w]), pack(wc[w]), pack_sorted(c.pairs[p]), pack(pc[p]))
                    for name, cell in zip(out, cells):
                        out[name].append(cell)
                yield from _table(out, ASKED).to_batches()

    return chunks.mapInArrow(run, ASKED)


def _totals(hashes: list[np.ndarray], counts: list[np.ndarray], kinds: list[int]) -> tuple[np.ndarray, list[bytes]]:
    """Counts of the distinct hashes in the two training parts, and each sender's share of them."""
    every = np.concatenate(hashes)
    distinct, back = np.unique(every, return_inverse=True)
    sums = np.zeros((2, len(distinct)), np.int64)
    at, answers = 0, []
    for h, c, k in zip(hashes, counts, kinds):
        if k != OTHER:
            sums[k, back[at : at + len(h)]] += c
        at += len(h)
    at = 0
    for h in hashes:
        own = sums[:, back[at : at + len(h)]]
        answers.append(pack(np.concatenate([own[FIT], own[HELD]])))
        at += len(h)
    return sums, answers


def answered(questions: DataFrame) -> DataFrame:
    """The buckets' answers. A row without a chunk has the bucket's totals."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        kinds = [r["kind"] for r in rows]
        sums, told = _totals([unpack_sorted(r["words"]) for r in rows], [unpack(r["word_counts"], np.uint32) for r in rows], kinds)
        _, pairs = _totals([unpack_sorted(r["pairs"]) for r in rows], [unpack(r["pair_counts"], np.uint32) for r in rows], kinds)
        both = sums.sum(0)
        totals = np.array([both.sum(), (both > 0).sum(), sums[FIT].sum(), (sums[FIT] > 0).sum()], np.int64)
        bucket = rows[0]["bucket"]
        return _table(
            {
                "chunk": [r["chunk"] for r in rows] + [None],
                "kind": kinds + [-1],
                "bucket": [bucket] * (len(rows) + 1),
                "words": told + [totals.tobytes()],
                "pairs": pairs + [b""],
            },
            ANSWERS,
        )

    return questions.groupBy("bucket").applyInArrow(run, ANSWERS)


def frequency_bucket(count: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the power of two below its count."""
    return np.minimum(np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


class Counts:
    """What a chunk's tokens know: counts of the word, the context and the pair."""

    def __init__(self, left: pa.Table, right: pa.Table, held_out: bool):
        row = left.to_pylist()[0]
        self.chunk = c = Chunk(row)
        rows = sorted(right.to_pylist(), key=lambda r: r["bucket"])

        def gathered(name: str) -> np.ndarray:
            parts = [unpack(r[name], np.int64).reshape(2, -1) for r in rows]
            both = np.concatenate(parts, 1)
            return both[FIT] if held_out else both.sum(0)

        self.known = gathered("words")
        word, pair = self.known[c.tokens], gathered("pairs")[c.pair]
        end = np.searchsorted(c.vocab, END)
        context = np.concatenate([[0], word[:-1]])
        context[c.begins] = self.known[end]
        self.word, self.pair, self.context = word, pair, context

    def estimates(self, tokens: int, distinct: int) -> tuple[np.ndarray, np.ndarray, float]:
        two = self.pair / np.maximum(self.context, 1)
        return two, self.word / max(tokens, 1), 1 / (distinct + 1)


CELL = "k int, a int, b int, n double, two double, one double"


def held_cells(chunks: DataFrame, answers: DataFrame, tokens: int, distinct: int) -> DataFrame:
    """Held-out tokens by frequency bucket and by their two estimates over the third."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("k", "a", "b", "n", "two", "one")}
        if len(left):
            counts = Counts(left, right, True)
            two, one, none = counts.estimates(tokens, distinct)
            k = frequency_bucket(counts.context)
            log2 = np.log(np.where(two > 0, two / none, 1.0))
            log1 = np.log(np.where(one > 0, one / none, 1.0))
            a = np.where(two > 0, np.round(log2 * CELLS) + 1000, 0).astype(np.int64)
            b = np.where(one > 0, np.round(log1 * CELLS) + 1000, 0).astype(np.int64)
            cells, back = np.unique((k * 4096 + a) * 4096 + b, return_inverse=True)
            n = np.bincount(back)
            out = {
                "k": cells >> 24,
                "a": (cells >> 12) & 4095,
                "b": cells & 4095,
                "n": n.astype(float),
                "two": np.bincount(back, log2),
                "one": np.bincount(back, log1),
            }
        return pa.table({n: pa.array(np.asarray(v), pa.int32() if n in "kab" else pa.float64()) for n, v in out.items()})

    pairs = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, CELL)
    return pairs.groupBy("k", "a", "b").agg(F.sum("n").alias("n"), F.sum("two").alias("two"), F.sum("one").alias("one"))


def learn(cells: list) -> np.ndarray:
    """Weights of the three estimates for every frequency bucket, by EM."""
    weights = np.tile(START_WEIGHTS, (BUCKETS, 1))
    if cells:
        k, a, b = (np.array([getattr(r, f) for r in cells]) for f in ("k", "a", "b"))
        n, two, one = (np.array([getattr(r, f) for r in cells], float) for f in ("n", "two", "one"))
        ratio = np.stack([np.ones(len(k)), np.where(b > 0, np.exp(one / n), 0), np.where(a > 0, np.exp(two / n), 0)], 1)
        for bucket in range(BUCKETS):
            own = k == bucket
            if own.any():
                w = weights[bucket].copy()
                for _ in range(ROUNDS):
                    part = w * ratio[own]
                    w = (n[own, None] * part / part.sum(1, keepdims=True)).sum(0) / n[own].sum()
                weights[bucket] = w
    weights[0, 2] = 0  # a context never seen has no pairs
    weights = np.maximum(weights, [1e-6, 1e-9, 0])
    return weights / weights.sum(1, keepdims=True)


SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def scored(chunks: DataFrame, answers: DataFrame, tokens: int, distinct: int, weights: np.ndarray) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _table({f.split()[0]: [] for f in SCORES.split(", ")}, SCORES)
        counts = Counts(left, right, False)
        c = counts.chunk
        two, one, none = counts.estimates(tokens, distinct)
        w = weights[frequency_bucket(counts.context)]
        own = np.log10(w[:, 0] * none + w[:, 1] * one + w[:, 2] * two)
        base = np.log10((counts.word + 1) / (tokens + distinct + 1))
        first = np.cumsum(c.sizes) - c.sizes
        valid = pa.array(c.known == 0)
        return pa.table(
            {
                "doc_id": pa.array(c.ids, mask=valid.to_numpy(zero_copy_only=False)),
                "n_tokens": pa.array(c.sizes),
                "n_known": pa.array(np.add.reduceat((counts.word > 0).astype(np.int64), first)),
                "base_score": pa.array(np.add.reduceat(base, first)),
                "score": pa.array(np.add.reduceat(own, first)),
            }
        )

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, SCORES)


def score(docs: DataFrame, by: int = 7, out: int = 2, held: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Documents whose crc32 of the key modulo ``by`` is not ``out`` teach; of these, the
    ones where it is ``held`` are the part the weights are fitted to.
    """
    spark = docs.sparkSession
    rest = remainder(F.col(key), by)
    kind = F.when(rest == out, OTHER).when(rest == held, HELD).otherwise(FIT)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"), kind.alias("kind"))
    folder = fresh_path(spark, "lm-chunks")
    to_chunks(rows).write.parquet(folder, compression="none")
    chunks = spark.read.schema(CHUNKS).parquet(folder)
    size = chunks.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    bits = min(24, max(5, math.ceil(math.log2(max(size / 1.5, 1) / BUCKET + 1))))
    folder = fresh_path(spark, "lm-answers")
    answered(asked(chunks, bits)).write.parquet(folder, compression="none")
    told = spark.read.schema(ANSWERS).parquet(folder)
    sums = np.zeros(4, np.int64)
    for row in told.where("chunk is null").select("words").toLocalIterator():
        sums += np.frombuffer(row.words, np.int64)
    tokens, distinct, fit_tokens, fit_distinct = sums.tolist()
    answers = told.where("chunk is not null")
    cells = held_cells(chunks.where(F.col("kind") == HELD), answers.where(F.col("kind") == HELD), fit_tokens, fit_distinct)
    weights = learn(cells.collect())
    found = scored(chunks, answers, tokens, distinct, weights)
    return found.select(
        "doc_id",
        (remainder(F.col("doc_id"), by) == out).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )

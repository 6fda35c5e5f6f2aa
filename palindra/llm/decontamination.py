"""Benchmark decontamination: passages against a BM25 index of test items.

Test items are indexed by their words. A posting is the item's BM25 weight of the
word as a share of the item's score against itself, so that one threshold serves all
items. Postings of a word are kept in blocks of ``BLOCK`` items with the largest
weight of each block.

Every document is cut into overlapping passages, each long enough to hold any item
whole with half of the next passage. A passage is a query, searched by block-max WAND
for many passages at once: passages whose words' largest weights cannot reach the
threshold are left; words found in many items bring only their bound, the others
the largest weights of their blocks; only blocks whose bound reaches the threshold
are scored in full. Every item above the threshold is retrieved, and counts as leaked
if shares of its question's and of its answer's word triples stand in the passage.
The question of an item is its text up to the last end of a sentence within, the
answer what follows.

Items are indexed ``PART_BYTES`` of text at a time, by a hash of their id. So what
a worker gets is bounded; a larger benchmark takes more passes over the documents.

Words are runs of letters, digits and bytes beyond ASCII, A-Z as a-z. Null or empty
texts and items match nothing; items without two words are not searched for. Items
that repeat, or repeated rows of documents, each give their own rows. Empty tables
give no rows, and no other columns are returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palindra.llm.words import Texts, mix, slices, texts_of, words

K1, B = 1.2, 0.75
BLOCK = 16
THRESHOLD = 0.5
OVERLAP = 0.5
PART_BYTES = 8 << 20
#: Windows that are scored at once.
WINDOWS = 4096


def triples(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of three words; of all words if there are fewer."""
    if len(hashes) < 3:
        return hashes
    a, b, c = hashes[:-2], hashes[1:-1], hashes[2:]
    return mix(a * np.uint64(3) + b * np.uint64(0x9E3779B97F4A7C15) + c * np.uint64(0xC2B2AE3D27D4EB4F))


def question_end(text: str) -> int:
    """Where the answer of an item starts."""
    ends = [m.end() for m in re.finditer(r"[.?!]\s+", text.rstrip())]
    if ends:
        return ends[-1]
    spaces = [m.end() for m in re.finditer(r"\s+", text)]
    return spaces[len(spaces) * 2 // 3] if spaces else len(text)


@dataclass
class Index:
    """Postings by word, each word's blocks with their largest weights, item parts."""

    items: np.ndarray
    terms: np.ndarray
    first: np.ndarray
    item_of: np.ndarray
    weight: np.ndarray
    block_first: np.ndarray
    block_of: np.ndarray
    block_max: np.ndarray
    top: np.ndarray
    light: np.ndarray
    window: int
    parts: list[tuple[np.ndarray, np.ndarray]]


def build(rows: list[tuple[int, str]]) -> Index | None:
    """The index of some items; None if no item has two words."""
    kept = []
    for item, text in sorted(((i, t) for i, t in rows if t), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        cut = question_end(text)
        texts = texts_of(pa.array([text, text[:cut], text[cut:]]))
        found = words(texts, 0, 3, alnum=True)
        whole, question, answer = (found.hash[found.doc == k] for k in range(3))
        if len(whole) >= 2:
            parts = tuple(np.unique(triples(p)) if len(p) else np.unique(triples(whole)) for p in (question, answer))
            kept.append((item, whole, parts))
    if not kept:
        return None
    n, size = len(kept), np.array([len(w) for _, w, _ in kept])
    word = np.concatenate([w for _, w, _ in kept])
    owner = np.repeat(np.arange(n), size)
    terms, term = np.unique(word, return_inverse=True)
    pair, tf = np.unique(term * n + owner, return_counts=True)
    term, item = pair // n, pair % n
    df = np.bincount(term, minlength=len(terms))
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / size.mean()))
    weight /= np.bincount(item, weight, minlength=n)[item]
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    blocks, at = np.unique(term * (n // BLOCK + 1) + item // BLOCK, return_inverse=True)
    block_max = np.zeros(len(blocks))
    np.maximum.at(block_max, at, weight)
    block_term = blocks // (n // BLOCK + 1)
    top = np.zeros(len(terms))
    np.maximum.at(top, term, weight)
    return Index(
        np.array([i if i is not None else -1 for i, _, _ in kept], np.int64),
        terms,
        first,
        item,
        weight,
        np.searchsorted(block_term, np.arange(len(terms) + 1)),
        blocks % (n // BLOCK + 1),
        block_max,
        top,
        df > max(4, n // 16),
        int(2 * max(32, size.max())),
        [p for _, _, p in kept],
    )


def _spread(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry of ``of`` its positions in a table with bounds ``first``:
    number of the entry and position."""
    size = first[of + 1] - first[of]
    entry = np.repeat(np.arange(len(of)), size)
    return entry, np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size) + first[of][entry]


class Searcher:
    """Finds an index's items in passages of texts."""

    def __init__(self, index: Index, threshold: float = THRESHOLD, overlap: float = OVERLAP):
        self.index, self.threshold, self.overlap = index, threshold, overlap
        self.near = np.zeros(1 << 20, bool)
        self.near[(index.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def term_of(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the index's word, -1 for other words."""
        out = np.full(len(hashes), -1, np.int64)
        may = np.flatnonzero(self.near[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.index.terms, hashes[may]), len(self.index.terms) - 1)
        hit = self.index.terms[at] == hashes[may]
        out[may[hit]] = at[hit]
        return out

    def windows(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first and end word of all passages of texts with so many words."""
        half = self.index.window // 2
        n = np.where(counts > 0, np.maximum(1, -(-counts // half) - 1), 0)
        doc = np.repeat(np.arange(len(counts)), n)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        base = (np.cumsum(counts) - counts)[doc]
        return doc, base + k * half, base + np.minimum(k * half + self.index.window, counts[doc])

    def retrieve(self, term: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, item and score of everything above the threshold."""
        ix = self.index
        known = np.concatenate([ix.top, [0.0]])
        sums = np.concatenate([[0.0], np.cumsum(known[term])])
        may = np.flatnonzero(sums[end] - sums[begin] >= self.threshold - 1e-9)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for lo in range(0, len(may), WINDOWS):
            out.append(self._scored(term, may[lo : lo + WINDOWS], begin, end))
        return tuple(np.concatenate(c) for c in zip(*out))

    def _scored(self, term, may, begin, end):
        ix, n_blocks = self.index, len(self.index.items) // BLOCK + 1
        size = end[may] - begin[may]
        owner = np.repeat(np.arange(len(may)), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + begin[may][owner]
        t = term[place]
        pair = np.unique((owner * (len(ix.terms) + 1) + t)[t >= 0])
        owner, t = pair // (len(ix.terms) + 1), pair % (len(ix.terms) + 1)
        light = ix.light[t]
        bound = np.bincount(owner[light], ix.top[t[light]], minlength=len(may))
        full = bound + np.bincount(owner[~light], ix.top[t[~light]], minlength=len(may))
        go = full[owner] >= self.threshold - 1e-9
        owner, t, light = owner[go], t[go], light[go]
        heavy = np.flatnonzero(~light)
        entry, at = _spread(ix.block_first, t[heavy])
        cell = owner[heavy][entry] * n_blocks + ix.block_of[at]
        cells, back = np.unique(cell, return_inverse=True)
        best = np.bincount(back, ix.block_max[at], minlength=len(cells)) + bound[cells // n_blocks]
        cells = cells[best >= self.threshold - 1e-9]
        if (bound >= self.threshold - 1e-9).any():  # blocks without any rarer word of the passage
            whole = np.flatnonzero(bound >= self.threshold - 1e-9)
            cells = np.union1d(cells, (whole[:, None] * n_blocks + np.arange(n_blocks)).ravel())
        live = np.isin(owner, cells // n_blocks)
        owner, t = owner[live], t[live]
        entry, at = _spread(ix.first, t)
        item = ix.item_of[at]
        inside = np.isin(owner[entry] * n_blocks + item // BLOCK, cells)
        key = owner[entry][inside] * len(ix.items) + item[inside]
        keys, back = np.unique(key, return_inverse=True)
        score = np.bincount(back, ix.weight[at[inside]], minlength=len(keys))
        good = score >= self.threshold
        return may[keys[good] // len(ix.items)], keys[good] % len(ix.items), score[good]

    def leaks(self, texts: Texts) -> Iterator[tuple[int, int, float, float, float]]:
        """Text, item, score and shares of question and answer, best passage of each pair."""
        for lo, hi in slices(texts):
            found = words(texts, lo, hi, alnum=True)
            doc, begin, end = self.windows(found.counts(hi - lo))
            passage, item, score = self.retrieve(self.term_of(found.hash), begin, end)
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for p, i, s in zip(passage.tolist(), item.tolist(), score.tolist()):
                here = found.hash[begin[p] : end[p]]
                seen = np.concatenate([triples(here), here])
                q, a = (float(np.isin(part, seen).mean()) for part in self.index.parts[i])
                if q >= self.overlap and a >= self.overlap:
                    key = (int(doc[p]) + lo, i)
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (s, q, a))
            for (d, i), (s, q, a) in best.items():
                yield d, i, s, q, a


def parts_of(benchmark: DataFrame, item: str, text: str) -> Iterator[Index]:
    """Indexes of the items, of bounded size each."""
    taken = benchmark.select(F.col(item).cast("bigint").alias("item"), F.col(text).cast("string").alias("text")).where("text is not null")
    total = taken.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(total) // PART_BYTES + 1
    for k in range(n):
        rows = taken.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        index = build([(r.item, r.text) for r in rows])
        if index is not None:
            yield index


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Rows of ``doc_id, item_id, score, question_overlap, answer_overlap``."""
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    taken = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    spark, out = docs.sparkSession, None
    for index in parts_of(benchmark, item, item_text):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value, threshold, overlap)
            for batch in batches:
                rows = list(searcher.leaks(texts_of(batch.column(1))))
                if rows:
                    d, i, s, q, a = (np.array(c) for c in zip(*rows))
                    values = [batch.column(0).take(pa.array(d)), *map(pa.array, (shared.value.items[i], s, q, a))]
                    yield pa.RecordBatch.from_arrays(values, [f.split()[0] for f in schema.split(", ")])

        found = taken.mapInArrow(search, schema)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns.

    Rows are judged where they lie and passed on or not: none is moved or joined, so
    nulls and repeated values in any other column make no difference. Null and empty
    texts stay.
    """
    columns, at = docs.schema, docs.columns.index(text)
    for index in parts_of(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def judge(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value, threshold, overlap)
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[d for d, *_ in searcher.leaks(texts_of(batch.column(at)))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(judge, columns)
    return docs

"""Batch encoding by public tokenizers, every distinct piece of a batch once.

A byte-level BPE splits a text by its pattern before it merges, so the ids of a
text are the ids of its pieces (``words.pieces``) one after another. A worker
keeps the ids of the pieces it has met, up to ``CACHE`` of them, and encodes only
new ones: single words by the library's BPE model, which is what its pattern would
hand over, the others in batches balanced by bytes. Other kinds of files get whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from palindra.llm.words import CUT_SIGNS, Texts, pieces, slices

CACHE = 1 << 20
#: Bytes that go to the library in one call.
CALL = 1 << 21


def by_bytes(items: list[str], limit: int = CALL) -> Iterator[list[str]]:
    """Consecutive items in batches of about ``limit`` characters; a longer item alone."""
    batch, size = [], 0
    for item in items:
        if batch and size + len(item) > limit:
            yield batch
            batch, size = [], 0
        batch.append(item)
        size += len(item)
    if batch:
        yield batch


class PieceEncoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        # How a byte-level BPE writes bytes: as itself if it is a visible sign, else
        # the next free character from 256 on.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in seen]
        self.alphabet = {b: 256 + i for i, b in enumerate(hidden)}
        self.clear()

    def clear(self) -> None:
        self.levels = [(np.empty(0, np.uint64), np.empty(0, np.int64)) for _ in range(2)]
        self.sizes, self.offsets = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.pooled, self.n = np.empty(1 << 16, np.int32), 0, 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key, -1 where it is new."""
        found = np.full(len(keys), -1, np.int64)
        for known, slot in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                found[hit] = slot[at[hit]]
        return found

    def _add(self, keys: np.ndarray, texts: list[str]) -> None:
        rows: list = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            word = text[1:] if text[0] == " " else text
            if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
                rows[i] = [t.id for t in self.merge(text.encode().decode("latin-1").translate(self.alphabet))]
            else:
                rest.append(i)
        coded = (e.ids for batch in by_bytes([texts[i] for i in rest]) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False))
        for i, ids in zip(rest, coded):
            rows[i] = ids
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.fromiter((i for row in rows for i in row), np.int32, int(sizes.sum()))
        if self.pooled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(len(self.pool) + len(ids), np.int32)])
        self.pool[self.pooled : self.pooled + len(ids)] = ids
        self.offsets = np.concatenate([self.offsets, self.pooled + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pooled += len(ids)
        slots = np.arange(self.n, self.n + len(keys))
        self.n += len(keys)
        main, late = self.levels
        late = self._merged(late, (keys, slots))
        if len(late[0]) > (1 << 15) + len(main[0]) // 8:
            main, late = self._merged(main, late), (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.levels = [main, late]

    @staticmethod
    def _merged(a, b):
        keys, slots = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(keys, kind="stable")
        return keys[order], slots[order]

    def slots(self, texts: Texts, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Cache slot and text number (from ``lo``) of every piece."""
        found = pieces(texts, lo, hi)
        keys, first, back = np.unique(found.hash, return_index=True, return_inverse=True)
        if self.n and self.n + len(keys) > CACHE:
            self.clear()
        slot = self._find(keys)
        new = np.flatnonzero(slot < 0)
        if len(new):
            at = first[new]
            text = [texts.bytes_of(s, e).decode("utf-8", "replace") for s, e in zip(found.start[at], found.end[at])]
            self._add(keys[new], text)
            slot[new] = np.arange(self.n - len(new), self.n)
        return slot[back], found.doc

    def counts(self, texts: Texts) -> np.ndarray:
        """Number of ids of every text."""
        total = np.zeros(len(texts), np.int64)
        for lo, hi in slices(texts):
            slot, doc = self.slots(texts, lo, hi)
            np.add.at(total, doc + lo, self.sizes[slot])
        return total

    def ids(self, texts: Texts, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ranges of texts: from, to, number of ids of each, all their ids.
        Every text ends with ``end_id``, which its number includes."""
        for lo, hi in slices(texts):
            slot, doc = self.slots(texts, lo, hi)
            size = self.sizes[slot]
            count = np.bincount(doc, size, minlength=hi - lo).astype(np.int64)
            begin = np.cumsum(size) - size
            source = np.repeat(self.offsets[slot] - begin, size) + np.arange(int(size.sum()))
            out = np.full(int(count.sum()) + hi - lo, end_id, np.int32)
            shift = np.repeat(np.arange(hi - lo), count)
            out[np.arange(len(source)) + shift] = self.pool[source]
            yield lo, hi, count + 1, out


class WholeEncoder:
    """Ids of whole texts, for files whose texts cannot be cut safely."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _rows(self, texts: Texts, lo: int, hi: int) -> list:
        text = [texts.bytes_of(s, e).decode("utf-8", "replace") for s, e in zip(texts.starts[lo:hi], texts.ends[lo:hi])]
        return [row for batch in by_bytes(text) for row in self.encode(batch)]

    def counts(self, texts: Texts) -> np.ndarray:
        return np.array([len(r) for lo, hi in slices(texts) for r in self._rows(texts, lo, hi)], np.int64)

    def ids(self, texts: Texts, end_id: int):
        for lo, hi in slices(texts):
            rows = [np.append(np.array(r, np.int32), np.int32(end_id)) for r in self._rows(texts, lo, hi)]
            yield lo, hi, np.array([len(r) for r in rows], np.int64), np.concatenate(rows)


@lru_cache(2)
def encoder(path: str) -> PieceEncoder | WholeEncoder:
    """The encoder for a tokenizer file, by its kind; a worker's tasks share it."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        split = kind.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        own = [t for t in kind.get("added_tokens", []) if set(t["content"]) & set(CUT_SIGNS + " \n") or t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
        if plain and not own and not kind.get("normalizer"):
            return PieceEncoder(path)
    return WholeEncoder(path)

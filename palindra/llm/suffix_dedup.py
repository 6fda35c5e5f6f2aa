"""Passages that stand in an earlier document, found with suffix arrays and cut out.

Texts are bytes. A byte goes if a string of ``LENGTH`` bytes that covers it also starts
in a document with a smaller id; strings are judged on the input.

The suffix order is built column by column for many documents at once: every round puts
one more symbol of each document in front and inserts the suffixes that this makes into
the collection's Burrows-Wheeler transform, at the place that symbol counts give, and
their common prefixes, which are 1 more than the least between the places that the
suffixes come from (``Collection``). That takes as many rounds as the longest document
has bytes and reads the whole transform in each. So the collection is split first, in a
way that no match can cross:

1. Documents are packed in slices. Of each ``LENGTH``-byte window the anchor is the least
   hash of its ``GRAM``-byte strings: equal windows have equal anchors. Consecutive
   windows with one anchor are a *read*.
2. Slices tell buckets of anchors which they have, once each, and learn which are had by
   another slice too. No window of any other anchor, unless it is shared inside a slice,
   can match.
3. The distinct reads of the shared anchors go to buckets by anchor, each with the
   smallest id that has it. Each bucket is a collection of short documents: at most
   ``LENGTH + SPAN - 1`` rounds. The transform and the common prefixes are arrays of one
   task, which a bucket's size bounds; files of a machine would be lost with it.
   Equal reads are one document of it. One that has no window whose hash another read
   has is left out: its windows match nothing, and its smallest id is theirs.
4. Windows between which common prefixes are at least ``LENGTH`` are equal. Slices learn
   the smallest id of each window and cut their documents.

A slice sends a read once however many copies it has, so copies cost no more than one.
An anchor of more than ``HOT`` slices would still fill a bucket: its windows are reads of
their own, which are spread by the hash of the whole window.

Null texts count as empty. Equal ids do not cut each other. A null id counts as larger
than every other one. Repeated rows with one id are kept apart and give a row each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palindra.llm import words
from palindra.llm.lm_scoring import pack, pack_sorted, unpack, unpack_sorted
from palindra.session import stage

LENGTH = 50
GRAM = 24
#: Hashes that a window takes the least of; also the most windows of a read.
SPAN = LENGTH - GRAM + 1
#: Bytes of documents in a slice, if a single one is not longer.
SLICE = 1 << 23
#: Window starts of a slice that are worked on at once.
SEGMENT = 1 << 20
#: Anchors of a bucket, and bytes of a bucket's reads, about.
BUCKET_ANCHORS = 1 << 21
BUCKET_BYTES = 1 << 22
#: Slices beyond which an anchor's windows are spread one by one.
HOT = 512
END = 255  # never a byte of UTF-8
NO_ID = np.iinfo(np.int64).max

SLICES = "slice string, ids binary, known binary, sizes binary, body binary, bytes bigint"
TOLD = "bucket int, slice string, data binary"
REPLIES = "slice string, kind int, bucket int, n bigint, data binary"
READS = "bucket int, slice string, sizes binary, ids binary, body binary"
CUT = "doc_id bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary"
_KINDS = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64()}


def _table(schema: str, columns: list) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array(c, _KINDS[k]) for (n, k), c in zip(fields, columns)})


def to_slices(docs: DataFrame) -> DataFrame:
    """Documents packed in slices of about ``SLICE`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            ids, known, sizes = (np.concatenate([h[i] for h in held]) for i in range(3))
            body = zstandard.compress(b"".join(h[3] for h in held), 3)
            row = [[uuid.uuid4().hex], [pack(ids)], [pack(known)], [pack(sizes)], [body], [int(sizes.sum())]]
            yield from _table(SLICES, row).to_batches()

        for batch in batches:
            keys, texts = batch.column(0), words.texts_of(batch.column(1))
            known = keys.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = keys.fill_null(NO_ID).to_numpy()
            for lo, hi in words.slices(texts, SLICE):
                n = int(texts.ends[hi - 1] - texts.starts[lo])
                if held and size + n > SLICE:
                    yield from packed()
                    held, size = [], 0
                body = texts.bytes_of(int(texts.starts[lo]), int(texts.ends[hi - 1]))
                held.append((ids[lo:hi], known[lo:hi], (texts.ends - texts.starts)[lo:hi], body))
                size += n
        if held:
            yield from packed()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SLICES)


class Slice:
    """The documents of a slice and the reads of their windows."""

    def __init__(self, row: dict):
        self.ids, self.known = unpack(row["ids"], np.int64), unpack(row["known"], np.uint8)
        self.sizes = unpack(row["sizes"], np.int64)
        self.data = np.frombuffer(zstandard.decompress(row["body"]), np.uint8) if row["bytes"] else np.empty(0, np.uint8)
        self.ends = np.cumsum(self.sizes)
        found = [self._reads(at) for at in range(0, len(self.data), SEGMENT)]
        none = np.empty(0, np.int64)
        self.start, self.windows, self.anchor = (
            (np.concatenate(x) for x in zip(*found)) if found else (none, none, none.astype(np.uint64))
        )
        self.id = self.ids[np.searchsorted(self.ends, self.start, "right")]

    def _reads(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, number of windows and anchor of the reads whose windows start in a segment."""
        seg = self.data[at : at + SEGMENT + LENGTH - 1]
        n = len(seg) - LENGTH + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        least = hashes(seg, GRAM)
        width = 1
        while 2 * width <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:n], least[SPAN - width : SPAN - width + n])
        begins = np.ones(n, bool)
        begins[1:] = least[1:] != least[:-1]
        inside = np.ones(n, bool)  # windows that end in their document
        for end in self.ends[np.searchsorted(self.ends, at, "right") : np.searchsorted(self.ends, at + n + LENGTH, "right")] - at:
            inside[max(end - LENGTH + 1, 0) : max(end, 0)] = False
            if 0 <= end < n:
                begins[end] = True
        begins[1:] |= inside[1:] & ~inside[:-1]
        begins &= inside
        start = np.flatnonzero(begins)
        outside = np.append(np.flatnonzero(~inside), n)
        size = np.minimum(np.append(start[1:], n), outside[np.searchsorted(outside, start)]) - start
        parts = -(-size // SPAN)  # a text that repeats itself keeps an anchor for long
        offset = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * SPAN
        start = np.repeat(start, parts) + offset
        size = np.minimum(np.repeat(size, parts) - offset, SPAN)
        # Least hashes are small ones: mixed again, to be dealt evenly.
        return start + at, size, words.mix(least[start])

    def told(self, shift: int) -> np.ndarray:
        return np.unique(self.anchor >> np.uint64(shift))

    def shared(self, shift: int, replies: list[bytes]) -> "Reads":
        """The distinct reads of anchors that another document has."""
        short = self.anchor >> np.uint64(shift)
        mine = np.unique(short)
        at = np.searchsorted(mine, short)
        flags = [np.unpackbits(np.frombuffer(r[4:], np.uint8))[: 2 * int.from_bytes(r[:4], "little")] for r in replies]
        near, hot = np.concatenate([f.reshape(2, -1) for f in flags], axis=1) if flags else np.zeros((2, 0), np.uint8)
        low, high = np.full(len(mine), NO_ID), np.full(len(mine), np.iinfo(np.int64).min)
        np.minimum.at(low, at, self.id)
        np.maximum.at(high, at, self.id)
        take = ((near > 0) | (low < high))[at]
        start, windows, key, ids = self.start[take], self.windows[take], self.anchor[take], self.id[take]
        many = hot[at[take]] > 0
        if many.any():
            times = np.where(many, windows, 1)
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            many = np.repeat(many, times)
            start = np.repeat(start, times) + step
            windows = np.where(many, 1, np.repeat(windows, times))
            ids, key = np.repeat(ids, times), np.repeat(key, times)
            order = np.flatnonzero(many)
            for lo in range(0, len(order), SEGMENT):
                own = order[lo : lo + SEGMENT]
                key[own] = hashes(ragged(self.data, start[own], np.full(len(own), LENGTH)), LENGTH)[::LENGTH]
        return Reads(self.data, start, windows, key, ids)


class Reads:
    """Reads of a slice: ``of`` gives each its place among the distinct ones, which are
    in the order of their keys."""

    def __init__(self, data, start, windows, key, ids):
        self.start, self.windows, self.ids = start, windows, ids
        sizes = windows + LENGTH - 1
        found = _binary(ragged(data, start, sizes), sizes).dictionary_encode()
        first = np.full(len(found.dictionary), len(start))
        of = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        np.minimum.at(first, of, np.arange(len(start)))
        order = np.lexsort((first, key[first])) if len(first) else first
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.of = rank[of]
        self.key, self.size = key[first][order], sizes[first][order]
        self.texts = found.dictionary.take(pa.array(order))
        self.low = np.full(len(order), NO_ID)
        np.minimum.at(self.low, self.of, ids)


def hashes(seg: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width``-byte string, from the numbers of eight bytes in it."""
    eight = np.ndarray(len(seg) - 7, "<u8", np.ascontiguousarray(seg), strides=(1,))
    n = len(seg) - width + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for at in [*range(0, width - 8, 8), width - 8]:
            h += eight[at : at + n]
            h *= words.BASE
            h ^= h >> np.uint64(29)
    return h


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def ragged(data: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all ranges one after another."""
    out, ends = np.empty(int(sizes.sum()), np.uint8), np.cumsum(sizes)
    lo = 0
    while lo < len(start):
        done = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + SEGMENT, "right")))
        own = sizes[lo:hi]
        index = np.arange(int(own.sum())) + np.repeat(start[lo:hi] - (ends[lo:hi] - own - done), own)
        out[done : int(ends[hi - 1])] = data[index]
        lo = hi
    return out


def _bounds(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Where the buckets of sorted ``width``-bit keys begin and end."""
    tops = np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits)
    return np.append(np.searchsorted(keys, tops), len(keys))


def tell(slices: DataFrame, shift: int, bits: int) -> DataFrame:
    """The anchors of every slice, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mine = Slice(row).told(shift)
                at = _bounds(mine, bits, 64 - shift)
                own = [b for b in range(1 << bits) if at[b] < at[b + 1]]
                columns = [own, [row["slice"]] * len(own), [pack_sorted(mine[at[b] : at[b + 1]]) for b in own]]
                yield from _table(TOLD, columns).to_batches()

    return slices.mapInArrow(run, TOLD)


def answer(table: pa.Table) -> pa.Table:
    """To every slice, which of its anchors another slice has, and which very many have."""
    names, bucket = table["slice"].to_pylist(), table["bucket"][0].as_py()
    parts = [unpack_sorted(d) for d in table["data"].to_pylist()]
    _, at, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    n, out, lo = n[at], [], 0
    for part in parts:
        own = n[lo : lo + len(part)]
        lo += len(part)
        flags = np.packbits(np.concatenate([own > 1, own > HOT]))
        out.append((int((own > 1).sum()), len(part).to_bytes(4, "little") + flags.tobytes()))
    return _table(REPLIES, [names, [0] * len(names), [bucket] * len(names), *map(list, zip(*out))])


def _flags(replies: pa.Table) -> list[bytes]:
    rows = [r for r in replies.to_pylist() if r["kind"] == 0]
    return [r["data"] for r in sorted(rows, key=lambda r: r["bucket"])]


def send(shift: int, bits: int):
    """The shared reads of a slice, by bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = [[] for _ in READS.split(", ")]
        for row in left.to_pylist():
            reads = Slice(row).shared(shift, _flags(right))
            at = _bounds(reads.key, bits, 64)
            for b in range(1 << bits):
                lo, hi = int(at[b]), int(at[b + 1])
                if lo < hi:
                    body = zstandard.compress(_bytes(reads.texts.slice(lo, hi - lo)).tobytes(), 1)
                    own = (b, row["slice"], pack(reads.size[lo:hi].astype(np.uint8)), pack(reads.low[lo:hi]), body)
                    for column, x in zip(columns, own):
                        column.append(x)
        return _table(READS, columns)

    return run


def _bytes(texts: pa.Array) -> np.ndarray:
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]]


class Collection:
    """Burrows-Wheeler transform and common prefixes of short documents.

    Suffixes are in order; ``symbol`` is what stands before each, ``END`` before a whole
    document, and ``common`` what a suffix shares with the one before it. The empty
    suffixes come first, in the order of the documents, and share nothing.
    """

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        self.begin, self.size = offsets[:-1], np.diff(offsets)
        n = len(self.size)
        self.symbol = np.where(self.size > 0, flat[np.maximum(offsets[1:] - 1, 0)], END).astype(np.uint8)
        self.common = np.zeros(n, np.uint8)
        place = np.arange(n)
        for length in range(1, int(self.size.max(initial=0)) + 1):
            on = np.flatnonzero(self.size >= length)
            before = self.begin[on] + self.size[on] - length - 1
            following = np.where(self.size[on] > length, flat[np.maximum(before, 0)], END).astype(np.uint8)
            place[on] = self._insert(place[on], following, n)

    def _insert(self, place: np.ndarray, following: np.ndarray, n: int) -> np.ndarray:
        """Put the symbols at ``place`` in front of their suffixes; where these go."""
        order = np.argsort(self.symbol, kind="stable")
        symbol = self.symbol[place]
        at = self._rank(order, place, symbol)
        earlier = order[np.maximum(at - 1, 0)]
        later = order[np.minimum(at + 1, len(order) - 1)]
        has_earlier = (at > 0) & (self.symbol[earlier] == symbol)
        has_later = (at + 1 < len(order)) & (self.symbol[later] == symbol)
        least = Least(self.common)
        mine = np.where(has_earlier, least(np.where(has_earlier, earlier + 1, place), place) + 1, 0)
        new = n + at
        total = len(self.symbol) + len(place)
        old = np.ones(total, bool)
        old[new] = False
        symbols, commons = np.empty(total, np.uint8), np.empty(total, np.uint8)
        symbols[old], commons[old] = self.symbol, self.common
        symbols[new], commons[new] = following, mine
        on = np.flatnonzero(has_later)
        commons[new[on] + 1] = least(place[on] + 1, later[on]) + 1
        self.symbol, self.common = symbols, commons
        return new

    def _rank(self, order: np.ndarray, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where ``place`` stands in the order of symbols."""
        bounds = np.concatenate([[0], np.cumsum(np.bincount(self.symbol, minlength=256))])
        at = np.empty(len(place), np.int64)
        by_symbol = np.argsort(symbol, kind="stable")
        edges = np.searchsorted(symbol[by_symbol], np.arange(257))
        for c in np.flatnonzero(np.diff(edges)):
            own = by_symbol[edges[c] : edges[c + 1]]
            at[own] = bounds[c] + np.searchsorted(order[bounds[c] : bounds[c + 1]], place[own])
        return at

    def places(self, longer: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For every length from ``longer`` on: the documents that have such a suffix, its
        start in them and its place in the order."""
        order = np.argsort(self.symbol, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        del order
        n = len(self.size)
        place = np.arange(n)
        for length in range(1, int(self.size.max(initial=0)) + 1):
            on = np.flatnonzero(self.size >= length)
            place[on] = n + rank[place[on]]
            if length >= longer:
                yield on, self.size[on] - length, place[on]


class Least:
    """The least of any range of small numbers: of ranges of all powers of two up to a
    block, and of runs of whole blocks."""

    BITS = 6

    def __init__(self, values: np.ndarray):
        blocks = len(values) >> self.BITS
        self.near = _doubled(values, self.BITS + 1)
        whole = values[: blocks << self.BITS].reshape(blocks, 1 << self.BITS)
        self.far = _doubled(whole.min(axis=1), max(blocks, 1).bit_length()) if blocks else []

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of ``lo`` to ``hi``, both included."""
        first, last = (lo >> self.BITS) + 1, hi >> self.BITS
        long = hi - lo >= 2 << self.BITS
        out = np.empty(len(lo), np.uint8)
        on = np.flatnonzero(~long)
        # A range of up to two blocks is covered by its ends and one in the middle.
        size = 1 << self.BITS
        out[on] = np.minimum(
            _least(self.near, lo[on], np.minimum(hi[on], lo[on] + size - 1)),
            _least(self.near, np.maximum(lo[on], hi[on] - size + 1), hi[on]),
        )
        on = np.flatnonzero(long)
        ends = np.minimum(
            _least(self.near, lo[on], (first[on] << self.BITS) - 1),
            _least(self.near, last[on] << self.BITS, hi[on]),
        )
        out[on] = np.minimum(ends, _least(self.far, first[on], last[on] - 1))
        return out


def _doubled(values: np.ndarray, levels: int) -> list[np.ndarray]:
    out = [values]
    for k in range(levels - 1):
        half = 1 << k
        if len(out[-1]) <= half:
            break
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def _least(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    out = np.empty(len(lo), np.uint8)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    for k in range(len(levels)):
        on = np.flatnonzero(level == k)
        out[on] = np.minimum(levels[k][lo[on]], levels[k][hi[on] - (1 << k) + 1])
    return out


def match(table: pa.Table) -> pa.Table:
    """To every slice, the smallest ids of its reads' windows where they are below its own."""
    names, bucket = table["slice"].to_pylist(), table["bucket"][0].as_py()
    rows = table.to_pylist()
    sizes = [unpack(r["sizes"], np.uint8).astype(np.int64) for r in rows]
    counts = [len(s) for s in sizes]
    size, low = np.concatenate(sizes), np.concatenate([unpack(r["ids"], np.int64) for r in rows])
    flat = np.frombuffer(b"".join(zstandard.decompress(r["body"]) for r in rows), np.uint8)
    found = _binary(flat, size).dictionary_encode()
    of = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    least = np.full(len(found.dictionary), NO_ID)
    np.minimum.at(least, of, low)
    windows = np.diff(np.frombuffer(found.dictionary.buffers()[1], np.int64)[: len(least) + 1]) - LENGTH + 1
    begin = np.cumsum(windows) - windows
    smallest = np.repeat(least, windows)
    on = np.flatnonzero(may_match(found.dictionary, windows))
    chosen = found.dictionary.take(pa.array(on))
    del rows, table, flat, found
    offsets = np.concatenate([[0], np.cumsum(windows[on] + LENGTH - 1)])
    texts = Collection(_bytes(chosen) if len(on) else np.zeros(1, np.uint8), offsets)
    same = np.cumsum(texts.common < LENGTH) - 1
    first = np.full(len(same), NO_ID)
    for which, _, place in texts.places(LENGTH):
        np.minimum.at(first, same[place], least[on][which])
    for which, start, place in texts.places(LENGTH):
        smallest[begin[on][which] + start] = first[same[place]]
    out, lo = [], 0
    for n in counts:
        own, mine = of[lo : lo + n], low[lo : lo + n]
        lo += n
        out.append(_runs(own, mine, windows, begin, smallest))
    return _table(REPLIES, [names, [1] * len(names), [bucket] * len(names), *map(list, zip(*out))])


def may_match(reads: pa.Array, windows: np.ndarray) -> np.ndarray:
    """Whether a window of the read has the hash of another one's. No other read's
    windows can be equal to those of any other read."""
    if not len(reads):
        return np.empty(0, bool)
    ends = np.cumsum(windows + LENGTH - 1)
    of = np.repeat(np.arange(len(windows)), windows)
    place = np.repeat(ends - windows - LENGTH + 1, windows) + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    _, at, n = np.unique(hashes(_bytes(reads), LENGTH)[place], return_inverse=True, return_counts=True)
    return np.bincount(of, n[at] > 1, len(windows)) > 0


def _runs(own, mine, windows, begin, smallest) -> tuple[int, bytes]:
    """Runs of windows of the reads ``own`` with one id below ``mine``: read, from, to, id."""
    sizes = windows[own]
    read = np.repeat(np.arange(len(own)), sizes)
    window = np.arange(len(read)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ids = smallest[np.repeat(begin[own], sizes) + window]
    below = np.flatnonzero(ids < mine[read])
    if not len(below):
        return 0, b""
    read, window, ids = read[below], window[below], ids[below]
    fresh = np.ones(len(read), bool)
    fresh[1:] = (read[1:] != read[:-1]) | (window[1:] != window[:-1] + 1) | (ids[1:] != ids[:-1])
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(read)) - 1
    fields = (read[at].astype(np.uint32), window[at].astype(np.uint8), (window[last] + 1).astype(np.uint8), ids[at])
    packed = [pack(f) for f in fields]
    return len(at), b"".join(len(p).to_bytes(4, "little") + p for p in packed)


def _unpack_runs(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for kind in (np.uint32, np.uint8, np.uint8, np.int64):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(unpack(data[at + 4 : at + 4 + n], kind).astype(np.int64))
        at += 4 + n
    return out


def cut(shift: int, bits: int):
    """The documents of a slice without what earlier ones have."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [_cut(Slice(row), shift, bits, right) for row in left.to_pylist()]
        return pa.concat_tables(parts)

    return run


def _cut(own: Slice, shift: int, bits: int, replies: pa.Table) -> pa.Table:
    reads = own.shared(shift, _flags(replies))
    at = _bounds(reads.key, bits, 64)
    least = reads.low[reads.of]
    later = least < reads.ids
    begins, ends = [reads.start[later]], [(reads.start + reads.windows)[later]]
    order = np.argsort(reads.of, kind="stable")
    first = np.searchsorted(reads.of[order], np.arange(len(reads.key) + 1))
    for row in replies.to_pylist():
        if row["kind"] == 1 and row["data"]:
            read, lo, hi, ids = _unpack_runs(row["data"])
            read = read + at[row["bucket"]]
            times = first[read + 1] - first[read]
            run = np.repeat(np.arange(len(read)), times)
            place = order[np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[read], times)]
            later = ids[run] < reads.ids[place]
            begins.append((reads.start[place] + lo[run])[later])
            ends.append((reads.start[place] + hi[run])[later])
    n = len(own.data)
    depth = np.bincount(np.concatenate(begins), minlength=n + 1)[: n + 1].astype(np.int32)
    np.subtract.at(depth, np.minimum(np.concatenate(ends) + LENGTH - 1, n), 1)
    gone = np.cumsum(depth, dtype=np.int32)[:n] > 0
    edge = np.zeros(n + 1, bool)
    edge[own.ends - own.sizes] = edge[own.ends] = True
    before = np.concatenate([[False], gone[:-1]]) if n else gone
    after = np.concatenate([gone[1:], [False]]) if n else gone
    start = np.flatnonzero(gone & (~before | edge[:n]))
    end = np.flatnonzero(gone & (~after | edge[1:])) + 1
    doc = np.searchsorted(own.ends, start, "right")
    shift_by = (own.ends - own.sizes)[doc]
    spans = pa.StructArray.from_arrays([pa.array(start - shift_by), pa.array(end - shift_by)], ["start", "end"])
    counts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(own.sizes)))]).astype(np.int32)
    removed = pa.ListArray.from_arrays(pa.array(counts), spans)
    left = np.concatenate([[0], np.cumsum(~gone)])
    kept_at = np.concatenate([[0], left[own.ends]]).astype(np.int32)
    kept = pa.BinaryArray.from_buffers(
        pa.binary(), len(own.sizes), [None, pa.py_buffer(kept_at), pa.py_buffer(np.ascontiguousarray(own.data[~gone]))]
    )
    ids = pa.array(own.ids, mask=own.known == 0)
    return pa.table({"doc_id": ids, "n_bytes": pa.array(own.sizes), "removed": removed, "kept": kept})


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): the removed runs of each document of ``doc_id, text``
    and its remaining bytes."""
    slices = stage(to_slices(docs), "slices")
    total = slices.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    anchors = max(2 * total // SPAN, 1)
    wide = min(64, math.ceil(math.log2(anchors)) + 8)
    shift = 64 - wide
    bits = min(max(1, math.ceil(math.log2(anchors / BUCKET_ANCHORS))), wide)
    told = tell(slices, shift, bits)
    shared = stage(told.groupBy("bucket").applyInArrow(answer, REPLIES), "anchors")
    size = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (LENGTH + SPAN // 2)
    read_bits = max(1, math.ceil(math.log2(max(size, 1) / BUCKET_BYTES)))
    by_slice = slices.groupBy("slice")
    reads = by_slice.cogroup(shared.groupBy("slice")).applyInArrow(send(shift, read_bits), READS)
    matched = stage(reads.groupBy("bucket").applyInArrow(match, REPLIES), "matches")
    replies = shared.unionByName(matched)
    return by_slice.cogroup(replies.groupBy("slice")).applyInArrow(cut(shift, read_bits), CUT)

"""Documents whose sets of word shingles are alike, by signature trees.

A document's set is its distinct runs of five words (``[^\\x20\\x09-\\x0D]+``, A-Z as
a-z), of fewer words all of them as one; two documents link when 100 times the size
of the intersection is at least 75 times that of the union. Sets are compared as
64-bit hashes of shingles; equal sets are one node, whatever the number of copies.

1. Blocks. In one order of all shingles, two sets that link share ``k`` of the first
   ``n - ceil(0.75 n) + k`` of either, or all that they need. Sets meet in the block of
   each such shingle. Blocks of up to ``SMALL`` sets are told as pairs; those that meet
   less than ``k`` times, or where too little of either is left, go before their sets
   have been moved.
   The order is by hash, with the shingles that a sample finds in many documents at
   its end: so a passage that many documents share makes no block unless it is most
   of a document. The order decides how much work there is, never what is found.
2. Trees. A node of a block's tree holds the OR of its sets' bitmaps, the range of
   their sizes and the most shingles that share a bit. Two nodes are traversed
   together as long as the bits they share and those sizes allow a link. Leaves that
   pass are compared in the same task by the places of their shingles among at least
   32 times as many bits, which never tell too few common ones and seldom too many.
   A block is cut into parts where sizes are too far apart for a link, and where it has
   more than ``PART`` sets; parts with the same sets are one.
3. Rounds. A task gives a spanning forest of the pairs that places call links, never
   all of them. As forests begin at the sets of lowest hash everywhere, blocks with much
   the same sets give much the same pairs. Pairs are confirmed by whole sets and give
   components. The first round takes the parts of every block, and of the pairs one for
   each set; the second lets the parts of large blocks meet, and the pairs that are still
   apart; the third compares the few components that pairs which were not confirmed would
   join, with whole sets in place of bits, so that its pairs are links.

Prefixes, not groups, are dealt by shingle, packed in buckets; a task holds a bucket, or
a part's members, about a byte for each of their shingles (eight in the third round). Whole
sets are rebuilt from the texts of documents in a pair, found by a bitmap of fixed size
over their ids.

Null and empty texts have no set and link with nothing, not even each other. Rows that
repeat a key count as copies. An empty table gives no rows; other columns are not
returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palindra.llm.words import Spans, mix, slices, texts_of, words
from palindra.session import estimated_bytes, stage

SHINGLE = 5
PART = 1024
FANOUT = 4
#: A tree has at most so many topmost nodes. In larger blocks than ``FEW`` stars are tried
#: around ``CENTRES`` members first.
ROOTS, FEW, CENTRES = 8, 64, 8
#: One in so many documents is looked at for shingles that many documents share, of the
#: lower hashes, which are those that prefixes reach.
ONE_IN, SEEN, HOT_SHINGLES = 4, 4, 1 << 18
REACH = np.uint64(0.45 * 2**64)
#: Pairs compared at once, and bits that the members of a block are compared in at once.
AT_ONCE, COLUMNS = 1 << 14, 1 << 16
ID_BITS = 23
#: Linking sets share so many shingles of their prefixes, and one more for each ``ONE_MORE`` of
#: the smaller's size; shingles of up to ``SMALL`` sets are told as pairs.
SHARED, ONE_MORE, SMALL = 3, 128, 32
#: Shingles go in ``2^BUCKET_BITS`` buckets, in twice as many for each doubling of the input
#: beyond ``BUCKETED`` bytes up to 2^16; a task packs and holds about ``HELD`` entries or pairs at once.
BUCKET_BITS, BUCKETED, HELD = 12, 1 << 35, 1 << 20
#: Of a shingle in a prefix: its hash without the bits of the bucket, the set, the set's size
#: (exact up to ``EXACT``) and its place in 640ths of the size.
ENTRY = np.dtype([("x", "<u4"), ("node", "<i8"), ("n", "<u2"), ("place", "u1")])
EXACT = (1 << 15) - 1
FOUND = ["block", "a", "b", "n", "need"]
#: Bytes of texts taken at once, so that arrays stay in a core's cache.
TEXTS = 1 << 18
#: Bits of a shingle that are looked up before the shingle itself.
FLAG_BITS = np.uint64((1 << 22) - 1)

SETS = "doc_id bigint, n_shingles bigint, node bigint, places binary, prefix array<bigint>"


def shingles(found: Spans, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``n`` texts, ordered by text and hash, and each one's text."""
    counts = found.counts(n)
    first = np.cumsum(counts) - counts
    whole = np.flatnonzero(counts >= SHINGLE)
    each = counts[whole] - SHINGLE + 1
    doc = np.repeat(whole, each)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each) + first[doc]
    h = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        h = (h + found.hash[at + k]) * np.uint64(0xD1342543DE82EF95)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    few = []
    for d in short:
        v = np.uint64(counts[d])
        for w in found.hash[first[d] : first[d] + counts[d]]:
            v = np.uint64((int(v) + int(w)) * 0xD1342543DE82EF95 & (1 << 64) - 1)
        few.append(v)
    h = np.concatenate([mix(h), mix(np.array(few, np.uint64))])
    doc = np.concatenate([doc, short])
    counts = np.maximum(counts - SHINGLE + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    if len(short):
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    several = np.flatnonzero(counts > 1)
    for a, b in zip(at[several].tolist(), at[several + 1].tolist()):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], doc[fresh]


def bitmap_bits(n: int) -> int:
    return 1 << max(8, int(4 * n - 1).bit_length())


def places(hashes: np.ndarray) -> bytes:
    """Where shingles stand among eight times as many bits as a bitmap has, as steps of
    one byte; 255 is a step of so many without a shingle."""
    return _all_places(hashes, np.array([len(hashes)]))[0].tobytes()


def places_of(steps: bytes) -> np.ndarray:
    step = np.frombuffer(steps, np.uint8)
    return np.cumsum(step, dtype=np.int64)[step < 255].view(np.uint64)


def shared_in_prefixes(n: int) -> int:
    """How many shingles of its prefix a set has in common with any it links with, unless
    links need fewer. Long texts meet at some by chance."""
    return SHARED + n // ONE_MORE


def prefix_size(n: int) -> int:
    return n - -(-3 * n // 4) + shared_in_prefixes(n)


def _per_text(texts, found: Callable) -> Iterator:
    for lo, hi in slices(texts, TEXTS):
        h, doc = shingles(words(texts, lo, hi), hi - lo)
        bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield found(lo + i, h[bounds[i] : bounds[i + 1]])


def bucket_bits(docs: DataFrame) -> int:
    return min(16, BUCKET_BITS + max(0, (estimated_bytes(docs) // BUCKETED).bit_length()))


def _buckets(hashes: np.ndarray, rows: np.ndarray, bits: int) -> pa.RecordBatch:
    """``rows`` packed by the buckets of their hashes."""
    bucket = (hashes & np.uint64((1 << bits) - 1)).astype(np.uint16)
    rows = rows[np.argsort(bucket, kind="stable")]
    count = np.bincount(bucket, minlength=1 << bits)
    some = np.flatnonzero(count)
    ends = np.concatenate([[0], np.cumsum(count[some])]) * rows.itemsize
    entries = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(rows)])
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), entries], ["bucket", "entries"])


def _unpacked(table: pa.Table, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in table.column("entries")), dtype)


def hot_shingles(docs: DataFrame, key: str, text: str) -> np.ndarray:
    """Shingles that several documents of a sample share, at most ``HOT_SHINGLES``."""
    bits = bucket_bits(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in batches:
            texts = texts_of(batch.column(0))
            for lo, hi in slices(texts, TEXTS):
                h, _ = shingles(words(texts, lo, hi), hi - lo)
                kept.append(h[h < REACH])
                held += len(kept[-1])
                if held > HELD:
                    yield _buckets(x := np.concatenate(kept), x, bits)
                    kept, held = [], 0
        if held:
            yield _buckets(x := np.concatenate(kept), x, bits)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches):
            x = np.sort(_unpacked(table, np.uint64))
            begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            n = np.diff(np.append(begin, len(x)))
            often = n >= SEEN
            yield pa.RecordBatch.from_arrays([pa.array(x[begin[often]].view(np.int64)), pa.array(n[often])], ["x", "n"])

    some = docs.where(F.pmod(F.xxhash64(F.lit("order"), key), F.lit(ONE_IN)) == 0).select(F.col(text).cast("string").alias("text"))
    dealt = some.mapInArrow(run, "bucket int, entries binary").repartition("bucket").sortWithinPartitions("bucket")
    rows = dealt.mapInArrow(seen, "x bigint, n bigint").orderBy(F.desc("n"), "x").limit(HOT_SHINGLES).collect()
    return np.sort(np.array([r.x for r in rows], np.int64).view(np.uint64))


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive groups of ``count``, some empty."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(count)
    return total[ends] - total[ends - count]


def _all_places(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``places`` of sets one after the other, and how many bytes each has."""
    sizes, at = np.unique(count, return_inverse=True)
    masks = np.array([8 * bitmap_bits(n) - 1 for n in sizes.tolist()], np.uint64)
    spot = h & np.repeat(masks[at], count)
    ends = np.cumsum(count)
    begin = ends - count
    for a, b in zip(begin.tolist(), ends.tolist()):
        spot[a:b].sort()
    spot = spot.astype(np.int64)
    step = np.diff(spot, prepend=0)
    some = begin[count > 0]
    step[some] = spot[some]
    out = np.full(len(step) + int((step // 255).sum()), 255, np.uint8)
    out[np.cumsum(step // 255 + 1) - 1] = step % 255
    return out, _sums(step // 255 + 1, count)


def _flags(hot: np.ndarray) -> np.ndarray:
    out = np.zeros(int(FLAG_BITS) + 1, bool)
    out[hot & FLAG_BITS] = True
    return out


def _prefixes(h: np.ndarray, count: np.ndarray, want: np.ndarray, hot: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``want`` shingles of sets one after the other, ``hot`` ones last, and how many each has."""
    common = flags[h & FLAG_BITS]
    some = np.flatnonzero(common)
    if len(some):
        common[some] = hot[np.minimum(np.searchsorted(hot, h[some]), len(hot) - 1)] == h[some]
    begin = np.cumsum(count) - count
    rare = np.cumsum(~common) - ~common
    within = np.arange(len(h)) - np.repeat(begin, count)
    rare -= np.repeat(rare[np.minimum(begin, len(h) - 1)] if len(h) else begin, count)
    place = np.where(common, np.repeat(_sums(~common, count), count) + within - rare, rare)
    size = np.minimum(count, want)
    take = place < np.repeat(size, count)
    out = np.empty(int(size.sum()), np.uint64)
    out[(np.repeat(np.cumsum(size) - size, count) + place)[take]] = h[take]
    return out, size


def sets_of(docs: DataFrame, hot: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's set size, node, places and prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def ends(size: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(size)]).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, seen = shared.value, set()
        flags = _flags(hot)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in slices(texts, TEXTS):
                h, doc = shingles(words(texts, lo, hi), hi - lo)
                n = np.bincount(doc, minlength=hi - lo)
                none = n == 0
                node = np.zeros(hi - lo, np.uint64)
                with np.errstate(over="ignore"):
                    if len(h):
                        node[~none] = np.add.reduceat(mix(h), (np.cumsum(n) - n)[~none])
                    node = mix(node * np.uint64(0x9FB21C651E98DF25) + n.astype(np.uint64)).view(np.int64)
                again = none.copy()
                for i, x in enumerate(node.tolist()):
                    if x in seen:
                        again[i] = True
                    elif not none[i]:
                        if len(seen) > 1 << 20:
                            seen.clear()
                        seen.add(x)
                spots, size = _all_places(h, n)
                at = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends(size)), pa.py_buffer(spots)])
                first, size = _prefixes(h, n, np.where(again, 0, prefix_size(n)), hot, flags)
                prefix = pa.ListArray.from_arrays(pa.array(ends(size)), pa.array(first.view(np.int64)), mask=pa.array(again))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(node, mask=none), pc.if_else(pa.array(none), pa.scalar(None, pa.binary()), at), prefix],
                    ["doc_id", "n_shingles", "node", "places", "prefix"],
                )

    taken = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return taken.mapInArrow(run, SETS)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows with one value in the first column, whole over batches."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cut[:-1], cut[1:]):
            if kept and key[a] != last:
                yield int(last), pa.Table.from_batches(kept)
                kept = []
            last = key[a]
            kept.append(batch.slice(a, b - a))
    if kept:
        yield int(last), pa.Table.from_batches(kept)


def size_codes(n: np.ndarray) -> np.ndarray:
    """Sizes as two bytes: as they are, or by their logarithm beyond ``EXACT``."""
    return np.where(n <= EXACT, n, EXACT + 1 + (np.log2(np.maximum(n, 1)) * 1024).astype(np.int64)).astype(np.uint16)


def size_bounds(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most size that a code stands for."""
    code = code.astype(np.int64)
    step = np.maximum(code - EXACT - 1, 0)
    low, high = (np.floor(2 ** ((step + k) / 1024)).astype(np.int64) for k in (0, 1))
    return np.where(code <= EXACT, code, low - 1), np.where(code <= EXACT, code, high + 1)


def dealt_prefixes(sets: DataFrame, bits: int) -> DataFrame:
    """Shingles of all prefixes in buckets by hash: rows ``bucket, entries`` of packed ``ENTRY``."""

    def packed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        x, node, n, place = (np.concatenate(c) for c in zip(*parts))
        rows = np.empty(len(x), ENTRY)
        rows["x"], rows["node"], rows["n"], rows["place"] = x >> np.uint64(bits), node, n, place
        return _buckets(x, rows, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            counts = pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(counts) // HELD, prepend=0)).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                some, count = batch.slice(lo, hi - lo), counts[lo:hi]
                n, x = some.column(1).to_numpy(), some.column(2).flatten().to_numpy().view(np.uint64)
                place = np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
                code = np.minimum(place * 640 // np.repeat(n, count), 255).astype(np.uint8)
                kept.append((x, np.repeat(some.column(0).to_numpy(), count), np.repeat(size_codes(n), count), code))
                held += len(x)
                if held > HELD:
                    yield packed(kept)
                    kept, held = [], 0
        if held:
            yield packed(kept)

    return sets.where("prefix is not null").select("node", "n_shingles", "prefix").mapInArrow(run, "bucket int, entries binary")


class Counts:
    """Pairs of nodes, how often they were met and have to be, added up as far as memory goes."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, *pairs: np.ndarray) -> None:
        self.parts.append(pairs)
        self.held += len(pairs[0])

    def rows(self, least: int) -> Iterator[pa.RecordBatch]:
        """The pairs, if there are more than ``least`` of them."""
        if self.held <= least:
            return
        a, b, n, need = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((b, a))
        a, b, n, need = a[order], b[order], n[order], need[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        a, b, n, need = a[first], b[first], np.add.reduceat(n, first), need[first]
        self.parts, self.held = [(a, b, n, need)], len(a)
        if self.held > least // 2:
            self.parts, self.held = [], 0
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), *map(pa.array, (a, b, n, need))], FOUND)


def shared_blocks(sets: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """What shingles in the prefixes of two nodes or more tell: rows ``block, a`` of those
    that more than ``SMALL`` nodes have, and ``a, b, n, need`` of pairs by the others.
    Blocks with the same nodes are one.

    Sets that link have ``shared_in_prefixes`` of the smaller in common, or as many as their
    sizes ask for, none of them at a place that leaves too few. So a pair is in a block,
    or is met at so many of the other shingles: then its ``n`` add up to ``need``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        counts = Counts()
        blocks, nodes, held = [], [], 0

        def rows() -> pa.RecordBatch:
            n = sum(map(len, blocks))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(blocks)), pa.array(np.concatenate(nodes)), *[pa.nulls(n, pa.int64())] * 3], FOUND
            )

        for _, table in runs(batches):
            x, node, code, place = _met(_unpacked(table, ENTRY))
            begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
            size = np.diff(np.append(begin, len(x)))
            for s in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
                i, j = np.triu_indices(s, 1)
                at = begin[size == s]
                step = max(1, HELD // len(i))
                for lo in range(0, len(at), step):
                    some = at[lo : lo + step, None]
                    counts.add(*_near(node, code, place, (some + i).ravel(), (some + j).ravel()))
                    yield from counts.rows(2 * HELD)
            large = size > SMALL
            for part in _members(node, begin[large], size[large], told):
                blocks.append(part[0])
                nodes.append(part[1])
                held += len(part[0])
            if held > 50_000:
                yield rows()
                blocks, nodes, held = [], [], 0
        yield from counts.rows(0)
        if blocks:
            yield rows()

    dealt = dealt_prefixes(sets, bits).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "block bigint, a bigint, b bigint, n bigint, need bigint")


def _met(e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries by shingle and node, each node once, without shingles that stand alone."""
    key = e["x"].astype(np.uint64) << np.uint64(32) | np.arange(len(e), dtype=np.uint64)
    key.sort()
    x = key >> np.uint64(32)
    like = np.concatenate([[False], x[1:] == x[:-1], [False]])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)[like[1:] | like[:-1]]
    e = e[at]
    e = e[np.lexsort((e["node"], e["x"]))]
    x, node = e["x"], e["node"]
    fresh = np.ones(len(e), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (node[1:] != node[:-1])
    return tuple(np.ascontiguousarray(e[c][fresh]) for c in ("x", "node", "n", "place"))


def _near(node: np.ndarray, code: np.ndarray, place: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pairs of entries, those that may be among the first shingles that two sets that
    link have in common; each counts one of those that it needs."""
    low, high = size_bounds(code)
    before = place * low // 640
    common = -(-3 * (low[p] + low[q]) // 7)
    need = np.minimum(shared_in_prefixes(np.minimum(low[p], low[q])), common)
    ok = (3 * low[p] <= 4 * high[q]) & (3 * low[q] <= 4 * high[p])
    ok &= (before[p] < high[p] - common + need) & (before[q] < high[q] - common + need)
    p, q, need = p[ok], q[ok], need[ok]
    a, b = node[p], node[q]
    return np.minimum(a, b), np.maximum(a, b), np.ones(len(p), np.int64), need


def _members(node: np.ndarray, begin: np.ndarray, size: np.ndarray, told: set[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those blocks of nodes in order that are new."""
    for at, n in zip(begin.tolist(), size.tolist()):
        some = node[at : at + n]
        with np.errstate(over="ignore"):
            name = mix(some.view(np.uint64).copy()).sum() + np.uint64(n)
        block = int(mix(np.array([name], np.uint64)).view(np.int64)[0])
        if block in told:
            continue
        if len(told) > 1 << 20:
            told.clear()
        told.add(block)
        yield np.full(n, block, np.int64), some


def pair_blocks(pairs: DataFrame) -> DataFrame:
    """Rows ``block, rep`` of a block for each of ``pairs``."""
    return pairs.select(F.xxhash64(F.lit("pair"), "a", "b").alias("block"), F.explode(F.array("a", "b")).alias("rep"))


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components ``_a, _b``."""
    named = pairs
    for end in ("a", "b"):
        of = found.select(F.col("id").alias(end), F.col("component").alias(f"_{end}"))
        named = named.join(of, end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    return named.where("_a <> _b").select("a", "b", "_a", "_b")


def first_partners(pairs: DataFrame) -> DataFrame:
    """Of the pairs of each end, the one whose other end comes first in an order by hash."""
    ends = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ends.groupBy("a").agg(F.min(F.struct(F.xxhash64("b"), "b")).alias("_l")).select("a", F.col("_l.b").alias("b"))
    return least.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class Tree:
    """Sets of one bitmap size, or twice that and folded; nodes are levels of arrays."""

    def __init__(self, n: np.ndarray, bits: np.ndarray):
        excess = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, n, n, excess)]
        while len(self.levels[-1][1]) > ROOTS:
            bits, least, most, excess = self.levels[-1]
            at = np.arange(0, len(least), FANOUT)
            self.levels.append(
                (np.bitwise_or.reduceat(bits, at, 0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(excess, at))
            )

    def allowed(self, level: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether two nodes may hold sets that link."""
        bits, least, most, excess = self.levels[level]
        out = np.zeros(len(p), bool)
        for lo in range(0, len(p), 1 << 14):
            a, b = p[lo : lo + (1 << 14)], q[lo : lo + (1 << 14)]
            fits = (4 * most[a] >= 3 * least[b]) & (4 * most[b] >= 3 * least[a])
            k = np.flatnonzero(fits)
            a, b = a[k], b[k]
            common = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64) + np.minimum(excess[a], excess[b])
            common = np.minimum(common, np.minimum(most[a], most[b]))
            out[lo + k] = 7 * common >= 3 * (least[a] + least[b])
        return out

    def pairs(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Allowed pairs of leaves in different groups, by traversing node pairs."""
        same = [group]
        for level in range(1, len(self.levels)):
            below = same[-1]
            at = np.arange(0, len(below), FANOUT)
            low, high = np.minimum.reduceat(below, at), np.maximum.reduceat(below, at)
            same.append(np.where((low == high) & (low >= 0), low, -1))
        p, q = np.triu_indices(len(same[-1]))
        for level in range(len(self.levels) - 1, -1, -1):
            go = ~((same[level][p] >= 0) & (same[level][p] == same[level][q]))
            go &= (p != q) | (level > 0)
            p, q = p[go], q[go]
            ok = self.allowed(level, p, q)
            p, q = p[ok], q[ok]
            if level:
                n = len(self.levels[level - 1][1])
                a = (p[:, None] * FANOUT + np.arange(FANOUT))[:, :, None]
                b = (q[:, None] * FANOUT + np.arange(FANOUT))[:, None, :]
                a, b = (x.ravel() for x in np.broadcast_arrays(a, b))
                keep = (a <= b) & (b < n)
                p, q = a[keep], b[keep]
        return p, q


class Members:
    """Sets of one bitmap size, or twice that and folded. They are only laid out where
    bitmaps leave a pair to be compared."""

    def __init__(self, n: np.ndarray, sets: list[np.ndarray], bits: int, folded: bool):
        self.n, self.sets, self.bits, self.folded = n, sets, bits, folded
        self.laid: dict[int, np.ndarray] = {}
        self.columns: tuple[np.ndarray, np.ndarray] | None = None

    def at(self, i: int) -> np.ndarray:
        """Places of one member in order; shingles at one place are told apart by their number."""
        if not self.folded:
            return self.sets[i]
        if i not in self.laid:
            place = np.sort(self.sets[i] & np.uint64(8 * self.bits - 1))
            again = np.arange(len(place))
            new = np.ones(len(place), bool)
            new[1:] = place[1:] != place[:-1]
            self.laid[i] = place << np.uint64(24) | (again - np.maximum.accumulate(np.where(new, again, 0))).astype(np.uint64)
        return self.laid[i]

    def links(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs of members have enough places in common."""
        if len(a) <= FEW or (a == a[0]).all():
            common = np.zeros(len(a), np.int64)
            for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
                x, y = self.at(x), self.at(y)
                common[k] = (x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()
        else:
            common = self._common(a, b)
        return 7 * common >= 3 * (self.n[a] + self.n[b])

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common places of pairs, in bitmaps with a bit for each place of several members,
        ``COLUMNS`` of them at once."""
        if self.columns is None:
            every = [self.at(i) for i in range(len(self.n))]
            rows = np.repeat(np.arange(len(every)), [len(x) for x in every])
            _, column, often = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
            shared = often > 1
            number = np.cumsum(shared) - 1
            keep = np.flatnonzero(shared[column])
            keep = keep[np.argsort(column[keep], kind="stable")]
            self.columns = number[column[keep]], rows[keep]
        column, row = self.columns
        out = np.zeros(len(a), np.int64)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            i, j = np.searchsorted(column, [low, low + COLUMNS])
            width = -(-min(COLUMNS, int(column[-1]) + 1 - low) // 64) * 64
            flags = np.zeros((len(self.n), width), np.uint8)
            flags[row[i:j], column[i:j] - low] = 1
            bits = np.packbits(flags, axis=1).view(np.uint64)
            del flags
            step = max(1, AT_ONCE * 64 // bits.shape[1])
            for lo in range(0, len(a), step):
                out[lo : lo + step] += np.bitwise_count(bits[a[lo : lo + step]] & bits[b[lo : lo + step]]).sum(1, dtype=np.int64)
        return out


def candidates(
    n: np.ndarray, sets: list[np.ndarray], group: np.ndarray, rank: np.ndarray | None = None, folded: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members, sorted by size, that connect what all links between members of
    different groups would connect. ``sets`` are the places of their shingles, or with
    ``folded`` false the shingles themselves.

    Pairs are tried around the member of lowest ``rank``, then the next: around the first
    as stars, around the others as the trees allow them.
    """
    group = group.copy()
    rank = np.arange(len(n)) if rank is None else rank
    bits = np.array([bitmap_bits(int(x)) for x in n])
    maps = []
    for x, m in zip(sets, bits.tolist()):
        flags = np.zeros(m, np.uint8)
        flags[(x & np.uint64(m - 1)).view(np.int64)] = 1
        maps.append(np.packbits(flags, bitorder="little").view(np.uint64))
    left, right = [], []

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            if group[x] != group[y]:
                left.append(x)
                right.append(y)
                group[group == group[y]] = group[x]

    for m in np.unique(bits).tolist():
        exact = bits == m
        own = np.flatnonzero(exact | (bits == 2 * m))
        if len(own) < 2 or (group[own] == group[own[0]]).all():
            continue
        rows = np.array([maps[i] if exact[i] else maps[i][: m // 64] | maps[i][m // 64 :] for i in own])
        members = Members(n[own], [sets[i] for i in own], m, folded)
        tree = Tree(n[own], rows)
        every = np.arange(len(own))
        for c in np.argsort(rank[own], kind="stable")[: CENTRES if len(own) > FEW else 0]:
            around = every[group[own] != group[own[c]]]
            around = around[tree.allowed(0, np.full(len(around), c), around)]
            if not len(around):
                continue
            around = around[members.links(np.full(len(around), c), around)]
            join(np.full(len(around), own[c]), own[around])
        p, q = tree.pairs(group[own])
        some = exact[own[p]] | exact[own[q]]
        p, q = p[some], q[some]
        low, high = np.minimum(rank[own[p]], rank[own[q]]), np.maximum(rank[own[p]], rank[own[q]])
        order = np.lexsort((high, low))
        p, q = p[order], q[order]
        lo = 0
        while lo < len(p):
            # few at first, as what they join needs no comparison
            a, b = p[lo : lo + max(FEW, min(lo, AT_ONCE))], q[lo : lo + max(FEW, min(lo, AT_ONCE))]
            lo += len(a)
            apart = group[own[a]] != group[own[b]]
            a, b = a[apart], b[apart]
            if not len(a):
                continue
            ok = members.links(a, b)
            join(own[a[ok]], own[b[ok]])
    return np.array(left, np.int64), np.array(right, np.int64)


def two_link(n: np.ndarray, sets: list[np.ndarray], folded: bool) -> bool:
    """Whether ``candidates`` would join two members, the smaller first."""
    return bool(4 * n[0] >= 3 * n[1] and Members(n, sets, bitmap_bits(int(n[0])), folded).links(np.array([0]), np.array([1]))[0])


PAIRS = "a bigint, b bigint"


def tree_pairs(members: DataFrame, folded: bool = True) -> DataFrame:
    """Pairs of representatives from the trees of blocks: rows ``block, rep, n, component``
    and ``places`` or, with ``folded`` false, the whole set as ``x``."""

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n, rep = table.column("n").to_numpy(), table.column("rep").to_numpy()
        order = np.lexsort((rep, n))
        if folded:
            sets = [places_of(x.as_buffer()) for x in table.column("places")]
        else:
            sets = [x.values.to_numpy().view(np.uint64) for x in table.column("x")]
        component, sets = table.column("component").to_numpy()[order], [sets[i] for i in order]
        n, rep = n[order], rep[order]
        if len(n) == 2:
            a, b = ([0], [1]) if component[0] != component[1] and two_link(n, sets, folded) else ([], [])
        else:
            _, group = np.unique(component, return_inverse=True)
            a, b = candidates(n, sets, group, mix(rep.view(np.uint64).copy()), folded)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[a], rep[b])), pa.array(np.maximum(rep[a], rep[b]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches):
            yield from found(table)

    dealt = members.select("block", "rep", "n", "component", "places" if folded else "x").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, PAIRS).distinct()


def cut_blocks(members: DataFrame, whole: bool) -> DataFrame:
    """Parts ``block, rep, component`` of at most about ``PART`` members of blocks of any size.

    A block, in order of size, is cut wherever the next set is too large to link with
    the one before; sets left alone go. Parts of what remains share a member with the
    next. With ``whole``, members outside the largest component also meet all others,
    part by part; where there is one component there are no parts. Parts of the same
    members, of whatever blocks, are one.
    """

    limit = PART

    def split(n: np.ndarray, component: np.ndarray) -> Iterator[np.ndarray]:
        cuts = (np.flatnonzero(4 * n[:-1] < 3 * n[1:]) + 1).tolist()
        for low, high in zip([0, *cuts], [*cuts, len(n)]):
            if high - low > 1:
                for rows in parts(component[low:high]):
                    yield rows + low

    def parts(component: np.ndarray) -> Iterator[np.ndarray]:
        size = len(component)
        if whole:
            names, at, counts = np.unique(component, return_inverse=True, return_counts=True)
            if len(names) < 2:
                return
            if size <= limit:
                yield np.arange(size)
                return
            few = np.flatnonzero(at != counts.argmax())
            for i in range(0, size, limit):
                for j in range(0, len(few), limit // 2):
                    yield np.unique(np.concatenate([np.arange(i, min(i + limit, size)), few[j : j + limit // 2]]))
            return
        for i in range(0, size - 1, limit - 1):
            yield np.arange(i, min(i + limit, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        held = 0
        for _, table in runs(batches):
            rep, component = table.column("rep").to_numpy(), table.column("component").to_numpy()
            for rows in split(table.column("n").to_numpy(), component):
                with np.errstate(over="ignore"):
                    name = mix(rep[rows].view(np.uint64)).sum() + np.uint64(len(rows))
                name = mix(np.array([name], np.uint64)).view(np.int64)
                kept.append((np.repeat(name, len(rows)), rep[rows], component[rows]))
                held += len(rows)
                if held > 50_000:
                    yield together(kept)
                    kept, held = [], 0
        if kept:
            yield together(kept)

    def together(kept: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept)], ["block", "rep", "component"])

    dealt = members.select("block", "rep", "n", "component").repartition("block").sortWithinPartitions("block", "n", "rep")
    return dealt.mapInArrow(run, "block bigint, rep bigint, component bigint").distinct()


def holding(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows ``block, rep, component`` of all members of the components that ``pairs`` (``a, b``
    in components ``_a, _b``) would join, one block for those that they would make one.

    A forest of a part in which such a pair is taken for a link leaves out links only
    between components that these pairs join.
    """
    joined = components(pairs.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    ends = pairs.select(F.col("a").alias("rep"), F.col("_a").alias("component")).unionAll(pairs.select("b", "_b"))
    members = found.select(F.col("id").alias("rep"), "component").unionAll(ends).distinct()
    named = joined.select(F.col("id").alias("component"), F.col("component").alias("block"))
    return members.join(named, "component").select("block", "rep", "component")


def _bit_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("bit"), key), F.lit(1 << ID_BITS))


def _marks(ids: DataFrame) -> Broadcast:
    """A bitmap over the hashes of ``ids`` (``rep``)."""
    # positions in Spark's bitmaps count from 1
    marks = ids.select((_bit_of(F.col("rep")) + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("k"))
    seen = np.zeros((1 << ID_BITS) // 8, np.uint8)
    for row in marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect():
        seen[(row.k - 1) * 4096 : row.k * 4096] |= np.frombuffer(row.bits, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(seen)


def _marked(batch: pa.RecordBatch, column: int, marks: np.ndarray) -> pa.RecordBatch:
    """The rows whose id's bit, in ``column``, is in the bitmap."""
    h = batch.column(column).to_numpy()
    return batch.take(pa.array(np.flatnonzero(marks[h >> 3] >> (h & 7).astype(np.uint8) & 1)))


def members_of(sets: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows ``rep, n, places`` of the nodes whose representative is in ``ids``."""
    shared = _marks(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = _marked(batch, 3, shared.value)
            if some.num_rows:
                yield pa.RecordBatch.from_arrays(some.columns[:3], ["doc_id", "node", "places"])

    taken = sets.where("doc_id is not null and node is not null").select("doc_id", "node", "places", _bit_of(F.col("doc_id")).alias("h"))
    some = taken.mapInArrow(run, "doc_id bigint, node bigint, places binary")
    # keyed on both, as the join deals rows by both
    known = some.join(nodes, "node").where("doc_id = rep").dropDuplicates(["node", "rep"])
    return stage(known.select("rep", "n", "places"), "shingle-members")


def whole_sets(docs: DataFrame, ids: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The whole set ``x`` of each document in ``ids`` (``rep``)."""
    shared = _marks(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = _marked(batch, 2, shared.value)
            if not some.num_rows:
                continue
            rows = list(_per_text(texts_of(some.column(1)), lambda i, x: x.view(np.int64)))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(rows, pa.list_(pa.int64()))], ["rep", "x"])

    taken = docs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("rep"), F.col(text).cast("string").alias("text"), _bit_of(F.col(key).cast("bigint")).alias("h")
    )
    sets = taken.mapInArrow(run, "rep bigint, x array<bigint>").join(ids, "rep").groupBy("rep").agg(F.max_by("x", F.size("x")).alias("x"))
    return stage(sets, "sets")


def confirmed(docs: DataFrame, pairs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``pairs`` with whether their whole sets link."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = whole_sets(docs, ids, key, text)
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("x").alias("xa")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("x").alias("xb")), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    return both.select("a", "b", (100 * common >= 75 * (F.size("xa") + F.size("xb") - common)).alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """Rows ``id, component`` of every id in ``edges`` (``a, b``); the component is its
    smallest id. Edges turn to the smallest neighbour, by large and small stars in turn,
    until nothing changes."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = state(e)
    while True:
        around = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        e = stage(small.distinct(), "stars")
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("id"), F.col("v").alias("component"))
    ).distinct()


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``doc_id, n_shingles, component_id`` for every document."""
    sets = stage(sets_of(docs, hot_shingles(docs, key, text), key, text), "shingle-sets")
    nodes = stage(
        sets.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")),
        "shingle-nodes",
    )
    met = stage(shared_blocks(sets, bucket_bits(docs)), "shingle-blocks")
    blocks = stage(met.where("block is not null").select("block", F.col("a").alias("node")).distinct(), "large-blocks")
    sized = blocks.join(nodes, "node").select("block", "rep", "n")
    often = met.where("block is null").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need")
    ends = nodes.select("node", "rep")
    near = often.join(ends.select(F.col("node").alias("a"), F.col("rep").alias("_a")), "a").join(
        ends.select(F.col("node").alias("b"), F.col("rep").alias("_b")), "b"
    )
    # several nodes have one representative if a key comes with several texts
    near = stage(near.where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "near-pairs")

    def in_components(rows: DataFrame, found: DataFrame) -> DataFrame:
        named = rows.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
        return named.withColumn("component", F.coalesce("component", "rep"))

    def tried(pairs: DataFrame) -> DataFrame:
        return stage(confirmed(docs, stage(pairs, "tree-pairs"), key, text), "tried")

    def and_more(found: DataFrame, links: DataFrame) -> DataFrame:
        return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(links.select("a", "b")))

    # Parts of every block, and one pair of each end.
    parts = stage(cut_blocks(sized.withColumn("component", F.col("rep")), False), "block-parts")
    known = members_of(sets, nodes, parts.select("rep").unionAll(near.select(F.explode(F.array("a", "b")).alias("rep"))))
    tested = stage(first_partners(near), "near-pairs")
    some = pair_blocks(tested).withColumn("component", F.col("rep"))
    first = tried(tree_pairs(parts.unionByName(some).join(known, "rep")))
    found = components(first.where("links").select("a", "b"))

    # Parts of large blocks with each other, and the pairs that are still apart.
    large = stage(blocks.groupBy("block").agg(F.count("*").alias("_size")).where(F.col("_size") > PART).select("block"), "large-blocks")
    more = stage(cut_blocks(in_components(sized.join(large, "block"), found), True), "block-parts")
    left = pair_blocks(apart(near.join(tested, ["a", "b"], "left_anti"), found)).withColumn("component", F.col("rep"))
    rest = stage(more.unionByName(left), "block-parts")
    doubted = first.where("not links").select("a", "b")
    if not rest.isEmpty():
        second = tried(tree_pairs(rest.join(known, "rep")).join(first.select("a", "b"), ["a", "b"], "left_anti"))
        found = and_more(found, second.where("links"))
        doubted = doubted.unionAll(second.where("not links").select("a", "b"))

    # Components between which a part gave a pair that is no link. Where its ends are in one
    # component, so are the members that it kept from being compared.
    doubted = stage(apart(doubted, found), "doubted")
    if not doubted.isEmpty():
        again = stage(holding(found, doubted), "doubted-components")
        whole = whole_sets(docs, again.select("rep").distinct(), key, text).withColumn("n", F.size("x").cast("bigint"))
        again = stage(cut_blocks(again.join(whole.select("rep", "n"), "rep"), True), "doubted-parts")
        found = and_more(found, tree_pairs(again.join(whole, "rep"), folded=False))
    rows = sets.select("doc_id", "n_shingles", "node").join(nodes.select("node", "rep"), "node", "left")
    return rows.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")
    )

"""Words and pieces of whole Arrow text columns, as numpy arrays.

Texts are read as UTF-8 bytes. A word is a longest run of bytes other than
``\\x20`` and ``\\x09`` to ``\\x0D``; none of those occurs inside a character of
several bytes. A piece is what lies between two places at which a byte-level BPE
with the usual pattern always starts anew, whatever stands around: a single space
between two characters that are not white space, the first character after a single
line feed, and one of ``CUT_SIGNS`` after a Latin letter.

Every word or piece gets a 64-bit hash of its bytes (a polynomial over random
values, then mixed). Two different words among 10^8 share one with a chance of
about 3 in 10^4.

Work goes in segments of about ``SEGMENT`` bytes, cut where a word or piece ends,
so that memory follows the segment and the words, not the bytes of a long text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
#: Bytes of documents that are taken at once, if a single one is not longer.
SLICE = 1 << 22
#: Signs before which a piece starts if a letter stands there.
CUT_SIGNS = ".,;:!?#$%&*"
BASE = np.uint64(0x9E3779B97F4A7C15)

_values = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_lowered = _values.copy()
_lowered[65:91] = _values[97:123]
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_byte = np.arange(256)
_sign = ~np.isin(_byte, [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_no_letter = ~np.isin(_byte, [*range(65, 91), *range(97, 123), *range(128, 256)])
_ASCII, _LEAD, _TRAIL, _SPACE, _NEWLINE, _LETTER, _PUNCT, _LATIN, _NO_LATIN = (np.uint16(1 << i) for i in range(9))
_letter = np.isin(_byte, [*range(65, 91), *range(97, 123)])
_ascii = (_byte > 32) & (_byte < 127)
_kind = sum(
    np.where(where, flag, np.uint16(0))
    for flag, where in [
        (_ASCII, _ascii),
        (_LEAD, (_byte >= 0xC3) & (_byte <= 0xDF)),
        (_TRAIL, (_byte >= 0x80) & (_byte <= 0xBF)),
        (_SPACE, _byte == 32),
        (_NEWLINE, _byte == 10),
        (_LETTER, _letter),
        (_PUNCT, np.isin(_byte, list(CUT_SIGNS.encode()))),
        (_LATIN, _byte == 0xC3),
        (_NO_LATIN, np.isin(_byte, [0x97, 0xB7])),
    ]
)

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    global _powers, _inverse
    if len(_powers) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]))
            _inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Texts:
    """A text column: all bytes, and where each text starts and ends."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def bytes_of(self, start: int, end: int) -> bytes:
        return self.data[start:end].tobytes()


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        none = np.empty(0, np.int64)
        return Texts(np.empty(0, np.uint8), none, none)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    found = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return Texts(found, at[:-1], at[1:])


def slices(texts: Texts, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, a longer text alone."""
    lo, n = 0, len(texts)
    while lo < n:
        hi = int(np.searchsorted(texts.ends, texts.starts[lo] + limit, "right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


@dataclass
class Spans:
    """Words or pieces in order: hash, number of the text, place in the bytes."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def counts(self, n: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=n)


def _cuts(begin: int, end: int, is_cut) -> Iterator[tuple[int, int]]:
    while begin < end:
        to = min(begin + SEGMENT, end)
        if to < end:
            to = is_cut(begin, to, end)
        yield begin, to
        begin = to


def _joined(parts: list[Spans]) -> Spans:
    if len(parts) == 1:
        return parts[0]
    none = np.empty(0, np.int64)
    if not parts:
        return Spans(none.astype(np.uint64), none, none, none)
    return Spans(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("hash", "doc", "start", "end")))


def _hashed(seg: np.ndarray, s: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    powers, inverse = _tables(len(seg) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(values[seg] * powers[: len(seg)], out=sums[1:])
        return mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * BASE)


def words(
    texts: Texts, lo: int, hi: int, lower: bool = True, alnum: bool = False, letters: bool = False
) -> Spans:
    """Words of the texts ``lo`` to ``hi``; with ``lower``, A-Z count as a-z. With
    ``alnum``, words are runs of ASCII letters, digits and bytes beyond ASCII instead;
    with ``letters``, digits end them too."""
    if lo >= hi:
        return _joined([])
    data, first = texts.data, texts.starts[lo:hi]
    between = _no_letter if letters else _sign if alnum else _space

    def after_space(begin: int, to: int, end: int) -> int:
        back = np.flatnonzero(between[data[max(begin, to - 4096) : to]])
        if len(back):
            return max(begin, to - 4096) + int(back[-1]) + 1
        step = 1 << 16
        while to < end:
            ahead = np.flatnonzero(between[data[to : min(to + step, end)]])
            if len(ahead):
                return to + int(ahead[0]) + 1
            to += step
        return end

    parts = []
    for p, q in _cuts(int(first[0]), int(texts.ends[hi - 1]), after_space):
        seg = data[p:q]
        inside = ~between[seg]
        fresh = np.zeros(len(seg) + 1, bool)
        a, b = np.searchsorted(first, [p, q])
        fresh[first[a:b] - p] = True
        fresh[0] = fresh[-1] = True
        before = np.concatenate([[False], inside[:-1]])
        s = np.flatnonzero(inside & (~before | fresh[:-1]))
        after = np.concatenate([inside[1:], [False]])
        e = np.flatnonzero(inside & (~after | fresh[1:])) + 1
        doc = np.searchsorted(first, s + p, "right") - 1
        parts.append(Spans(_hashed(seg, s, e, _lowered if lower else _values), doc, s + p, e + p))
    return _joined(parts)


def pieces(texts: Texts, lo: int, hi: int) -> Spans:
    """Pieces of the texts ``lo`` to ``hi``. The pieces of a text make up all of it."""
    if lo >= hi:
        return _joined([])
    data, first = texts.data, texts.starts[lo:hi]

    def safe(p: int, q: int) -> np.ndarray:
        """Where in p..q a piece starts; looks at two bytes before and one after."""
        a, b = max(p - 2, 0), min(q + 1, len(data))
        kind = _kind[data[a:b]]
        good = np.zeros(len(kind), bool)
        if len(kind) > 2:
            before, at, after = kind[:-2], kind[1:-1], kind[2:]
            wide = ((at & _TRAIL) > 0) & ((before & _LEAD) > 0)
            seen = ((at & _ASCII) > 0) | wide  # ends a character that is not white space
            good[2:] = seen & ((after & _PUNCT) > 0) & (((at & _LETTER) > 0) | wide & ((before & _LATIN) > 0) & ((at & _NO_LATIN) == 0))
            good[2:-1] |= seen[:-1] & ((at[1:] & _SPACE) > 0) & ((after[1:] & (_ASCII | _LEAD)) > 0)
            good[3:] |= seen[:-1] & ((at[1:] & _NEWLINE) > 0) & ((after[1:] & (_ASCII | _LEAD)) > 0)
        return good[p - a : p - a + (q - p)]

    def at_piece(begin: int, to: int, end: int) -> int:
        back = np.flatnonzero(safe(max(begin + 1, to - 4096), to))
        if len(back):
            return max(begin + 1, to - 4096) + int(back[-1])
        while to < end:
            ahead = np.flatnonzero(safe(to, min(to + (1 << 16), end)))
            if len(ahead):
                return to + int(ahead[0])
            to += 1 << 16
        return end

    parts = []
    for p, q in _cuts(int(first[0]), int(texts.ends[hi - 1]), at_piece):
        starts = safe(p, q).copy()
        a, b = np.searchsorted(first, [p, q])
        starts[first[a:b] - p] = True
        starts[0] = True
        s = np.flatnonzero(starts)
        e = np.append(s[1:], q - p)
        doc = np.searchsorted(first, s + p, "right") - 1
        parts.append(Spans(_hashed(data[p:q], s, e, _values), doc, s + p, e + p))
    return _joined(parts)

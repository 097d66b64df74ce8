"""Vectorised handling of a batch of texts: byte buffers, word runs, hashes and word tables.

A text column arrives as an Arrow array. Its UTF-8 bytes lie end to end in one
buffer, so words can be found and looked up with numpy for all texts of a batch
at once instead of one Python object per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PAD = 32
#: Words of up to this many bytes are keyed by their bytes in the table; longer ones by a dictionary.
KEY_BYTES = 24
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes (null: empty) with PAD zero bytes behind, and the n + 1 offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    if not len(col):
        return np.zeros(PAD, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    buf = np.zeros(last - first + PAD, np.uint8)
    if last > first:
        buf[: last - first] = np.frombuffer(col.buffers()[2], np.uint8)[first:last]
    return buf, offsets - first


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``mask`` inside each text, and runs per text."""
    n = int(offsets[-1])
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    mask = mask[:n]
    edge = np.zeros(n, bool)
    edge[1:] = mask[:-1]
    begin = offsets[:-1]
    edge[begin[begin < n]] = False
    starts = np.flatnonzero(mask & ~edge)
    edge[:-1], edge[-1] = mask[1:], False
    end = offsets[1:] - 1
    edge[end[end >= 0]] = False
    ends = np.flatnonzero(mask & ~edge) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def white_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return runs(~_SPACE[buf], offsets)


def fold_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes kept."""
    return _FOLD[buf]


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True


def plain_words(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of text folded by fold_ascii."""
    return runs(_WORD[folded], offsets)


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of many byte spans of a buffer, from one running sum of b[i] * R^i."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        """Drop the powers, 16 bytes for each byte of the longest buffer so far."""
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            size = 1 << (n - 1).bit_length()
            root = int(_MULT)
            self.power, self.inverse = (self._powers(r, size) for r in (root, pow(root, -1, 1 << 64)))

    @staticmethod
    def _powers(root: int, size: int) -> np.ndarray:
        out = np.full(size, root, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(buf)
        self._grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * self.inverse[starts])


span_hash = SpanHash()  # one for all, so its powers are held once


class WordTable:
    """Gives each distinct byte string an id, 0 upward, and calls ``fill`` for strings seen first.

    Open addressing over numpy arrays, so a batch is looked up at once; keys are
    compared byte for byte. ``reset_if_full`` bounds its memory.
    """

    def __init__(self, fill: Callable[[list[bytes]], None] | None, capacity: int = 1 << 20) -> None:
        self.fill, self.capacity = fill, capacity
        self.clear()

    def clear(self) -> None:
        self.slots = 1 << 12
        self.count = 0
        self._alloc()
        self.long: dict[bytes, int] = {}

    def _alloc(self) -> None:
        self.key = np.zeros((self.slots, KEY_BYTES // 8), np.uint64)
        self.size = np.zeros(self.slots, np.uint8)
        self.id = np.zeros(self.slots, np.int32)

    def reset_if_full(self) -> bool:
        if self.count > self.capacity:
            self.clear()
            return True
        return False

    @staticmethod
    def _hash(key: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = size.astype(np.uint64) * _MULT
        for k in range(key.shape[1]):
            h = (h ^ key[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
            h = h ^ (h >> np.uint64(32))
        return h

    def _find(self, key: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Ids, or -1 where absent."""
        out = np.full(len(h), -1, np.int64)
        left, slot = np.arange(len(h)), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            held = self.size[slot]
            hit = (held == size[left]) & (self.key[slot] == key[left]).all(axis=1)
            out[left[hit]] = self.id[slot[hit]]
            go = ~hit & (held > 0)
            left, slot = left[go], (slot[go] + 1) & (self.slots - 1)
        return out

    def _put(self, key: np.ndarray, size: np.ndarray, h: np.ndarray, ids: np.ndarray) -> None:
        left, slot = np.arange(len(h)), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.size[slot] == 0)
            at, first = np.unique(slot[free], return_index=True)
            won = free[first]
            take = left[won]
            self.key[at], self.size[at], self.id[at] = key[take], size[take], ids[take]
            go = np.ones(len(left), bool)
            go[won] = False
            left, slot = left[go], (slot[go] + 1) & (self.slots - 1)

    def _widen(self, more: int) -> None:
        if 2 * (self.count + more) <= self.slots:
            return
        used = np.flatnonzero(self.size)
        key, size, ids = self.key[used], self.size[used], self.id[used]
        while 2 * (self.count + more) > self.slots:
            self.slots *= 2
        self._alloc()
        self._put(key, size, self._hash(key, size), ids)

    def ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, add: bool = True) -> np.ndarray:
        """The id of each span (never empty); with ``add`` unseen spans are added, else they get -1."""
        size = ends - starts
        out = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(size <= KEY_BYTES)
        at, n = starts[short], size[short]
        raw = np.lib.stride_tricks.sliding_window_view(buf, KEY_BYTES)[at]
        key = np.ascontiguousarray(raw).view(np.uint64) & _KEEP[n]
        n8 = n.astype(np.uint8)
        h = self._hash(key, n8)
        found = self._find(key, n8, h)
        if add and (found < 0).any():
            miss = np.flatnonzero(found < 0)
            order = miss[np.lexsort((n8[miss], *key[miss].T))]
            same = (n8[order[1:]] == n8[order[:-1]]) & (key[order[1:]] == key[order[:-1]]).all(axis=1)
            new = order[np.concatenate([[True], ~same])]
            self._widen(len(new))
            fresh = np.arange(self.count, self.count + len(new))
            self._put(key[new], n8[new], h[new], fresh)
            self.count += len(new)
            data = buf.tobytes()
            self._filled([data[i : i + k] for i, k in zip(at[new].tolist(), n[new].tolist(), strict=True)])
            found[order] = fresh[np.cumsum(np.concatenate([[0], ~same]))]
        out[short] = found
        rest = np.flatnonzero(size > KEY_BYTES)
        if len(rest):
            new_words: list[bytes] = []
            for k, i, j in zip(rest.tolist(), starts[rest].tolist(), ends[rest].tolist(), strict=True):
                word = buf[i:j].tobytes()
                found_id = self.long.get(word, -1)
                if found_id < 0 and add:
                    found_id = self.long[word] = self.count
                    self.count += 1
                    new_words.append(word)
                out[k] = found_id
            if new_words:
                self._filled(new_words)
        return out

    def _filled(self, words: list[bytes]) -> None:
        if self.fill:
            self.fill(words)


_KEEP = np.array([[(1 << (8 * min(8, max(0, n - 8 * k)))) - 1 for k in range(KEY_BYTES // 8)] for n in range(KEY_BYTES + 1)], np.uint64)


class Pool:
    """Rows of varying length, appended once and gathered by row number."""

    def __init__(self, dtype: type) -> None:
        self.data, self.start, self.count = np.zeros(1 << 12, dtype), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.used = self.rows = 0

    def clear(self) -> None:
        self.used = self.rows = 0

    def extend(self, rows: Sequence[Sequence[int]]) -> None:
        count = np.fromiter(map(len, rows), np.int64, len(rows))
        self.extend_flat(np.fromiter((x for row in rows for x in row), self.data.dtype, int(count.sum())), count)

    def extend_flat(self, flat: np.ndarray, count: np.ndarray) -> None:
        """Rows end to end, and how many values each has."""
        while self.used + len(flat) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while self.rows + len(count) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.data[self.used : self.used + len(flat)] = flat
        to = slice(self.rows, self.rows + len(count))
        self.count[to] = count
        self.start[to] = self.used + np.cumsum(count) - count
        self.used, self.rows = self.used + len(flat), self.rows + len(count)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' values end to end, and each row's count."""
        count = self.count[rows]
        return self.data[spread(self.start[rows], count)], count


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each count, end to end."""
    total = int(count.sum())
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``counts`` values; 0 for empty groups."""
    total = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


# White space that str.split() knows besides blank and line feed, as ASCII bytes or as UTF-8 lead bytes of such characters.
_OTHER = np.zeros(256, bool)
_OTHER[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def bpe_units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, units per text, and which texts are regular.

    A unit is a blank or line feed with the run of other characters behind it. In
    a regular text (single separators, none at its ends, no other white space) the
    usual byte-level pattern, ``... ?\\p{L}+|...|\\s+(?!\\S)|\\s+``, never matches
    across a unit's start: a lone separator goes with what follows it or stands
    alone. So units can be encoded one by one. Other texts get no units and are
    left to the caller.
    """
    n = int(offsets[-1])
    bad = np.zeros(len(offsets) - 1, bool)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, np.zeros(len(bad), np.int64), ~bad
    data = buf[:n]
    sep = (data == 32) | (data == 10)
    odd = np.flatnonzero(sep[1:] & sep[:-1])
    other = np.flatnonzero(_OTHER[data])
    if len(other):
        a, b, c = (buf[other + k].astype(np.int64) for k in range(3))
        wide = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        wide |= (a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))
        wide |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
        wide |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        odd = np.concatenate([odd, other[wide | (a < 128)]])
    full = np.flatnonzero(np.diff(offsets) > 0)
    first, last = offsets[full], offsets[full + 1] - 1
    bad[full[sep[first] | sep[last]]] = True
    bad[np.searchsorted(offsets, odd, side="right") - 1] = True
    sep[first] = True
    starts = np.flatnonzero(sep)
    ends = np.concatenate([starts[1:], [n]])
    count = np.diff(np.searchsorted(starts, offsets))
    if bad.any():
        keep = np.repeat(~bad, count)
        starts, ends = starts[keep], ends[keep]
        count[bad] = 0
    return starts, ends, count, ~bad


#: The usual byte-level pattern, which usual_pieces knows.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SIGN, _LETTER, _NUMBER, _BLANK = range(4)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Of each code point: letter, number, white space or another sign."""
    import regex

    points, out = "".join(map(chr, range(0x110000))), np.full(0x110000, _SIGN, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
        for m in regex.finditer(pattern, points):
            out[m.start() : m.end()] = kind
    return out


def usual_pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the matches of USUAL, and matches per text: they cover the texts."""
    n = int(offsets[-1])
    at = np.flatnonzero((buf[:n] & 0xC0) != 0x80)
    m = len(at)
    lead = np.zeros(m + 3, np.uint8)  # and nothing behind the last
    lead[:m] = buf[at]
    kind = _kinds()[lead[:m]]
    wide = np.flatnonzero(lead[:m] >= 0x80)
    if len(wide):
        a, b, c, d = (buf[at[wide] + k].astype(np.int64) & (0xFF if k == 0 else 0x3F) for k in range(4))
        two, three, four = (a & 31) << 6 | b, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d
        kind[wide] = _kinds()[np.where(a < 0xE0, two, np.where(a < 0xF0, three, four))]
    first = np.ones(m + 3, bool)  # of a text
    first[:m] = False
    full = offsets[:-1][np.diff(offsets) > 0]
    first[np.searchsorted(at, full)] = True
    start = np.ones(m + 3, bool)
    if m:
        start[1:m] = kind[1:] != kind[:-1]
        blank = kind == _BLANK
        follows = np.append(~blank[1:], False) & ~first[1 : m + 1]  # something else comes next
        start[:m] |= blank & follows  # the last of white space stands apart from the rest
        start[1:m] &= blank[1:] | (lead[: m - 1] != 32)  # and takes what comes next along, if it is U+0020
        start[first] = True
        quote = np.flatnonzero(start[:m] & (lead[:m] == 39))
        b, c = lead[quote + 1], lead[quote + 2]
        short = quote[np.isin(b, list(b"stmd")) & ~first[quote + 1]]
        long = quote[np.isin(b.astype(np.int64) << 8 | c, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]) & ~first[quote + 1] & ~first[quote + 2]]
        for found, length in ((short, 2), (long, 3)):
            start[found + 1] = False
            start[found + length] = True
    starts = at[start[:m]]
    return starts, np.append(starts[1:], n)[: len(starts)], np.diff(np.searchsorted(starts, offsets))


def arrow_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of 1 to ``rows`` rows. At a task's end its memory goes back: workers live on and share an executor's."""
    try:
        for b in batches:
            yield from (b.slice(k, rows) for k in range(0, b.num_rows, rows))
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory that the allocators hold to the system, and what can be made again."""
    span_hash.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it

"""The trees of many pieces at once, for bpe.TreeBPE.

Pieces lie end to end in one array of bytes; a second array holds the token that
starts at each byte. All trees are built from the leaves up, a level at a time: the
seams of that level are looked up together, stable ones are joined as they are, and
the windows around the others are merged by ranks together and widened until both
edges are stable. It is ``TreeBPE.join`` for all nodes of a level.
"""

from __future__ import annotations

import numpy as np

from .textbatch import Pool, mix, spread

#: Pieces of up to so many bytes grow here.
SPAN = 64
#: Pairs whose stability is remembered: slots, each of the last pair that fell in it.
PAIRS = 1 << 20
NONE = 1 << 60
_EMPTY = np.uint64((1 << 64) - 1)


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


def _before(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def depths(span: int) -> np.ndarray:
    """[n, i]: how deep in the tree of n bytes lies the cut before byte i; -1 before the first."""
    out = np.full((span + 1, span), -1, np.int8)
    for n in range(2, span + 1):
        half = n // 2
        out[n, 1:half] = out[half, 1:half] + 1
        out[n, half] = 0
        out[n, half + 1 : n] = out[n - half, 1 : n - half] + 1
    return out


class PairRanks:
    """The token that two neighbours make, or -1: open addressing over numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        get = ranks.get
        found = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None]
        a, b, token = np.array(found, np.int64).reshape(-1, 3).T
        self.last = (1 << (4 * len(token) + 4).bit_length()) - 1
        self.key, self.token = np.full(self.last + 1, _EMPTY), np.full(self.last + 1, -1, np.int64)
        key = _key(a, b)
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            free = np.flatnonzero(self.key[slot] == _EMPTY)
            at, first = np.unique(slot[free], return_index=True)
            self.key[at], self.token[at] = key[left[free[first]]], token[left[free[first]]]
            go = self.key[slot] != key[left]
            left, slot = left[go], (slot[go] + 1) & self.last

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key) & np.uint64(self.last)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = _key(a, b)
        slot = self._slot(key)
        held, out = self.key[slot], self.token[slot]
        left = np.flatnonzero(held != key)
        out[left] = -1
        left = left[held[left] != _EMPTY]
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.last
            held = self.key[slot]
            hit = held == key[left]
            out[left[hit]] = self.token[slot[hit]]
            go = ~hit & (held != _EMPTY)
            left, slot = left[go], slot[go]
        return out


class Forest:
    def __init__(self, ranks: dict[bytes, int], whole: set[bytes]) -> None:
        self.pairs = PairRanks(ranks)
        self.whole = np.array([ranks[t] for t in whole], np.int64)
        self.byte = np.array([ranks[bytes((b,))] for b in range(256)], np.int64)
        self.depth = depths(SPAN)
        self.row, self.bytes = np.zeros(max(ranks.values()) + 1, np.int64), Pool(np.uint8)
        self.row[list(ranks.values())] = np.arange(len(ranks))
        self.bytes.extend_flat(np.frombuffer(b"".join(ranks), np.uint8), np.fromiter(map(len, ranks), np.int64, len(ranks)))
        self.key, self.good = np.full(PAIRS, _EMPTY), np.zeros(PAIRS, bool)

    def merge(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Windows of ``size`` bytes, end to end, each merged by ranks (the least first, the leftmost of equals): the token that starts at each byte, else -1."""
        out = np.full(len(data), -1, np.int64)
        token, at, window = self.byte[data], np.arange(len(data)), np.repeat(np.arange(len(size)), size)
        count = size.copy()
        rank = np.full(len(data), NONE)  # of each token and the one behind it
        self._rank(rank, np.arange(len(data) - 1), token, window)
        while len(count):
            least = np.minimum.reduceat(rank, _before(count))
            go = least < NONE
            if not go.all():
                stay = np.repeat(go, count)
                out[at[~stay]] = token[~stay]
                token, at, window, rank, count, least = token[stay], at[stay], window[stay], rank[stay], count[go], least[go]
                if not len(count):
                    break
            found = np.flatnonzero(rank == np.repeat(least, count))
            found = found[np.concatenate([[True], window[found[1:]] != window[found[:-1]]])]
            token[found] = least
            stay = np.ones(len(token), bool)
            stay[found + 1] = False
            token, at, window, rank = token[stay], at[stay], window[stay], rank[stay]
            count = count - 1
            found = found - np.arange(len(found))
            rank[found] = NONE
            self._rank(rank, found[found < len(token) - 1], token, window)
            self._rank(rank, found[found > 0] - 1, token, window)
        return out

    def _rank(self, rank: np.ndarray, k: np.ndarray, token: np.ndarray, window: np.ndarray) -> None:
        k = k[window[k] == window[k + 1]]
        made = self.pairs(token[k], token[k + 1])
        rank[k] = np.where(made < 0, NONE, made)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of both tokens' bytes is the two tokens."""
        key = _key(a, b)
        slot = (mix(key) & np.uint64(PAIRS - 1)).astype(np.int64)
        out = self.good[slot]
        miss = np.flatnonzero(self.key[slot] != key)
        if len(miss):
            new, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            good = self._stable(a[miss[first]], b[miss[first]])
            out[miss] = good[back]
            to, one = np.unique(slot[miss[first]], return_index=True)
            self.key[to], self.good[to] = new[one], good[one]
        return out

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = self.pairs(a, b) < 0  # or both make a token, which is the encoding of its own bytes
        if len(self.whole):
            out[:] = True
        rest = np.flatnonzero(out)
        a, b = a[rest], b[rest]
        data, size = self.bytes.gather(self.row[np.stack([a, b], axis=1).ravel()])
        token, begin = self.merge(data, size[::2] + size[1::2]), _before(size)
        out[rest] = (token[begin[::2]] == a) & (token[begin[1::2]] == b)
        return out

    def grow(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of 1 to SPAN bytes, end to end: their ids end to end, and how many each has."""
        token, begin = self.byte[data], _before(size)
        depth = self.depth[np.repeat(size, size), np.arange(len(data)) - np.repeat(begin, size)]
        for level in range(int(depth.max(initial=-1)), -1, -1):
            self._join(data, token, depth, level)
        at = np.flatnonzero(token >= 0)
        return token[at], np.diff(np.searchsorted(at, np.append(begin, len(data))))

    def _join(self, data: np.ndarray, starts: np.ndarray, depth: np.ndarray, level: int) -> None:
        """Join all nodes of a level; ``starts``, the token at each byte, is changed."""
        edge = np.flatnonzero(starts >= 0)
        token, deep = starts[edge], depth[edge]
        edge = np.append(edge, len(data))
        seam = np.flatnonzero(deep == level)
        seam = seam[~self.stable(token[seam - 1], token[seam])]
        walls = np.append(np.flatnonzero(deep < level), len(token))
        k = np.searchsorted(walls, seam)
        low, high = walls[k - 1], walls[k]  # the two nodes' first token and the one behind their last
        width = 1
        while len(seam):
            i, j = np.maximum(low, seam - width), np.minimum(high, seam + width)
            size = edge[j] - edge[i]
            byte, first = spread(edge[i], size), _before(size)
            made = self.pairs(token[seam - 1], token[seam]) if width == 1 else np.full(len(seam), -1)
            made[np.isin(made, self.whole)] = -1
            new = np.full(len(byte), -1, np.int64)
            new[first] = made
            rest = np.repeat(made < 0, size)
            new[rest] = self.merge(data[byte[rest]], size[made < 0])
            held = np.flatnonzero(new >= 0)
            last = new[held[np.searchsorted(held, first + size) - 1]]
            ok = np.ones(len(seam), bool)
            k = np.flatnonzero(i > low)
            ok[k] = self.stable(token[i[k] - 1], new[first[k]])
            k = np.flatnonzero(ok & (j < high))
            ok[k] = self.stable(last[k], token[j[k]])
            done = np.repeat(ok, size)
            starts[byte[done]] = new[done]
            seam, low, high = seam[~ok], low[~ok], high[~ok]
            width *= 2

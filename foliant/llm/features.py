"""Hashed n-gram features of a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .textbatch import span_hash, white_words

# Letters a-z and all bytes of non-ASCII characters stay; A-Z are folded; the rest is a blank.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)



def byte_grams(buf: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, of ``bits`` bits, of all n-byte runs inside each text, and how many each text has."""
    return _grams(buf, offsets, n, bits)


def characters(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and where each text's begin."""
    data = buf[: int(offsets[-1])]
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), at[offsets]


def char_grams(buf: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As byte_grams, of runs of n characters for each n of ``sizes``."""
    chars, at = characters(buf, offsets)
    return (_grams(chars, at, n, bits) for n in sizes)


def _grams(values: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    total = int(offsets[-1])
    count = np.maximum(np.diff(offsets) - n + 1, 0)
    if total < n:
        return np.zeros(0, np.uint32), count
    h = np.full(total - n + 1, n, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h ^= values[k : k + len(h)]
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - bits)
    inside = np.ones(total, bool)
    for k in range(1, n):  # runs that cross a text's end
        at = offsets[1:] - k
        inside[at[at >= 0]] = False
    # texts shorter than n leave marks in front of them only, on runs that cross as well
    keep = inside[: len(h)]
    return (h if keep.all() else h[keep]), _kept(keep, offsets)


def _kept(keep: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sofar = np.concatenate([[0], np.cumsum(keep)])
    return np.diff(sofar[np.minimum(offsets, len(keep))])


def word_hashes(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words, and how many each text has."""
    starts, ends, count = white_words(buf, offsets)
    return (span_hash(buf, starts, ends) >> np.uint64(64 - bits)).astype(np.uint32), count


def group_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Float sums of consecutive groups; 0 for empty groups."""
    out = np.zeros(len(counts))
    full = counts > 0
    if full.any():
        first = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values.astype(np.float64), first)
    return out

"""Byte-level BPE by monoid tree reduction.

The encodings of byte strings form a monoid under *join*: the encoding of two
neighbours put together. A piece (one match of the pattern) is cut into halves,
recursively, down to single bytes, and the halves are joined on the way up. A join
re-encodes a window of tokens around the boundary, merging its bytes by ranks, and
widens it until the tokens outside are proved stable.

Proof used. Write enc for the merging by ranks. A token row is the encoding of its
bytes if and only if each two neighbours a, b in it are: enc(ab) = [a, b]. (Merging
never crosses a boundary between a and b unless it would do so for a and b alone: up
to the first crossing merge each side is merged as if it stood alone.) So once the
window's two edges hold stable pairs, the row made of left rest, window and right
rest is right, whatever its length. Every token must be the encoding of its own
bytes; ``TreeBPE`` checks that of the vocabulary.

A document is the same tree one level up: matches of the pattern are encoded on
their own, so joins between them are plain concatenation. Decoding is a tree too:
tokens' bytes are joined pair by pair, level by level, until one string is left.

Windows of a usual piece are a few bytes. Results of pieces, and of pairs that were
asked for, are remembered in tables of bounded size. The trees of a batch's new pieces
are built together, a level at a time (see forest.py).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .forest import SPAN, Forest
from .session import bounded_batches
from .textbatch import USUAL, Pool, WordTable, arrow_batches, spread, sums, text_bytes, usual_pieces

#: Windows of over so many bytes are merged with a heap.
LONG = 256
NONE = 1 << 60
#: Pieces of up to so many bytes, and pairs of tokens, whose results are remembered; how many of each.
SHORT = 16
REMEMBERED = 1 << 17
#: Fewer pieces than this are encoded one by one.
FEW = 64
#: Ids that the table of pieces holds, for each piece that it may hold.
IDS = 8


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class TreeBPE:
    """Encodes pieces of text by ranks. Every single byte must have one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.matches = regex.compile(pattern).findall
        self.single = [[ranks[bytes((b,))]] for b in range(256)]
        self.stable = lru_cache(REMEMBERED)(self._stable)
        self.short = lru_cache(REMEMBERED)(self._halves)
        self.whole = {t for t in ranks if len(self._merge_short(t)) > 1}  # tokens that merging never makes: none in usual vocabularies
        self.forest = Forest(ranks, self.whole)

    def merge(self, piece: bytes) -> list[int]:
        """A window's encoding: of all neighbours that make a token the least rank merges first, the leftmost of equals."""
        known = self.ranks.get(piece)
        if known is not None and piece not in self.whole:
            return [known]  # a token is the encoding of its own bytes
        return self._merge_long(piece) if len(piece) > LONG else self._merge_short(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        rank = self.ranks.get
        cut = list(range(len(piece) + 1))
        pair = [rank(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]  # of the parts at and behind each cut
        while pair and (least := min(pair)) != NONE:
            i = pair.index(least)
            del cut[i + 1], pair[i]
            if i < len(pair):
                pair[i] = rank(piece[cut[i] : cut[i + 2]], NONE)
            if i:
                pair[i - 1] = rank(piece[cut[i - 1] : cut[i + 1]], NONE)
        return [self.ranks[piece[a:b]] for a, b in zip(cut, cut[1:], strict=False)]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap, for time that is not quadratic."""
        rank, n = self.ranks.get, len(piece)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        waiting = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(waiting)
        while waiting:
            _, i, stop = heappop(waiting)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue  # one of the two has been merged since
            end[i], alive[j] = stop, False
            if stop < n:
                before[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    heappush(waiting, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := rank(piece[k:stop])) is not None:
                heappush(waiting, (r, k, stop))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def _stable(self, a: int, b: int) -> bool:
        return self.merge(self.bytes[a] + self.bytes[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encodings' bytes put together."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.merge(b"".join(map(self.bytes.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.stable(left[i - 1], window[0])) and (j == len(right) or self.stable(window[-1], right[j])):
                return left[:i] + window + right[j:]
            width *= 2

    def tree(self, piece: bytes) -> list[int]:
        """The encoding of a byte string by halves."""
        return self.short(piece) if len(piece) <= SHORT else self._halves(piece)

    def _halves(self, piece: bytes) -> list[int]:
        if len(piece) < 2:
            return self.single[piece[0]] if piece else []
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def piece(self, piece: bytes) -> list[int]:
        """One match of the pattern; one that is a token which merging never makes is that token."""
        return [self.ranks[piece]] if piece in self.whole else self.tree(piece)

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``piece`` of many: ids end to end, and how many each has. All short ones grow level by level together."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        near = (size > 0) & (size <= SPAN) & (len(pieces) >= FEW)
        if self.whole:
            near &= np.fromiter((p not in self.whole for p in pieces), bool, len(pieces))
        far = [self.piece(pieces[k]) for k in np.flatnonzero(~near).tolist()]
        count = np.zeros(len(pieces), np.int64)
        count[~near] = [len(r) for r in far]
        ids = np.zeros(0, np.int64)
        if near.any():
            ids, count[near] = self.forest.grow(np.frombuffer(b"".join(p for p, n in zip(pieces, near.tolist(), strict=True) if n), np.uint8), size[near])
        out, first = np.zeros(int(count.sum()), np.int32), np.cumsum(count) - count
        out[spread(first[near], count[near])] = ids
        out[spread(first[~near], count[~near])] = np.fromiter((i for r in far for i in r), np.int32)
        return out, count

    def text(self, text: str) -> list[int]:
        return [i for m in self.matches(text) for i in self.piece(m.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return joined(list(map(self.bytes.__getitem__, ids)))


def joined(parts: list[bytes]) -> bytes:
    """Strings put together pair by pair, level by level."""
    while len(parts) > 1:
        last = parts[-1:] if len(parts) % 2 else []
        parts = [*map(add, parts[::2], parts[1::2]), *last]
    return parts[0] if parts else b""


class DocumentEncoder:
    """TreeBPE over batches: each distinct match of the pattern once while it stays in a bounded table."""

    def __init__(self, ranks_path: str, pattern: str, capacity: int = 1 << 19) -> None:
        self.bpe, self.pattern = TreeBPE(load_ranks(ranks_path), pattern), pattern
        self.pool = Pool(np.int32)
        self.table = WordTable(lambda pieces: self.pool.extend_flat(*self.bpe.pieces(pieces)), capacity)
        self.token_bytes, self.digits = (np.empty(max(self.bpe.bytes) + 1, object) for _ in range(2))
        for i, b in self.bpe.bytes.items():
            self.token_bytes[i], self.digits[i] = b, b"%d" % i

    def _cut(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A buffer, starts and ends of the matches in it, and matches per text."""
        if self.pattern == USUAL:
            col.validate(full=True)  # texts are UTF-8
            buf, offsets = text_bytes(col)
            return buf, *usual_pieces(buf, offsets)
        found = [[m.encode() for m in self.bpe.matches(text or "") if m] for text in col.to_pylist()]
        buf, offsets = text_bytes(pa.array([b"".join(f).decode() for f in found], pa.large_string()))
        size = np.fromiter((len(m) for f in found for m in f), np.int64)
        end = np.cumsum(size)
        return buf, end - size, end, np.fromiter(map(len, found), np.int64, len(found))

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Ids end to end, how many each text has, and each text's ids in decimal."""
        if self.pool.used > IDS * self.table.capacity:
            self.table.clear()  # pieces were long
            self.pool.clear()
        if self.table.reset_if_full():
            self.pool.clear()
        buf, starts, ends, pieces = self._cut(col)
        ids, count = self.pool.gather(self.table.ids(buf, starts, ends))
        per = sums(count, pieces)
        return ids, per, [b",".join(self.digits[ids[e - n : e]].tolist()) for e, n in zip(np.cumsum(per).tolist(), per.tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return joined(self.token_bytes[ids].tolist())


_encoders: dict[tuple[str, str], DocumentEncoder] = {}


def encoder(ranks_path: str, pattern: str) -> DocumentEncoder:
    """One per worker process, so its table outlives a task."""
    key = ranks_path, pattern
    if key not in _encoders:
        _encoders[key] = DocumentEncoder(*key)
    return _encoders[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256 (of the
    bytes that the ids decode to) and, if asked for, ids. One pass, no shuffle.

    A null text is empty; an empty text has no ids. Ids may be of any type; rows that
    repeat an id, or have none, stay.
    """
    bounded_batches(docs.sparkSession)
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(ranks_path, pattern)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in arrow_batches(batches):
            ids, per, digits = code(batch.column("text"))
            end = np.cumsum(per)
            out = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(per, pa.int64()),
                "ids_sha256": [sha(d) for d in digits],
                "decoded_sha256": [sha(code.decode(ids[e - n : e])) for e, n in zip(end.tolist(), per.tolist(), strict=True)],
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(np.concatenate([[0], end]).astype(np.int32), pa.array(ids))
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a binary column ``decoded``: the bytes of each row's ids (null: null)."""
    bounded_batches(encoded.sparkSession)
    schema = T.StructType([*(f for f in encoded.schema if f.name != "decoded"), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(ranks_path, pattern)
        for batch in arrow_batches(batches):
            raw = [None if x is None else code.bpe.decode(x) for x in batch.column(ids_col).to_pylist()]
            if "decoded" in batch.schema.names:
                batch = batch.remove_column(batch.schema.get_field_index("decoded"))
            yield batch.append_column("decoded", pa.array(raw, pa.binary()))

    return encoded.mapInArrow(run, schema)

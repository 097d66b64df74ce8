"""Token counts of a unigram tokenizer: count-only Viterbi.

The tokenizer: blanks become U+2581, one is put in front of the text; of all ways to
write the text as vocabulary pieces the one of the highest total score is taken; a
character that no piece has costs the least score less 10 and counts as its bytes if
the vocabulary has them all, as one unknown otherwise, with neighbours fused.

An Aho-Corasick automaton lists all pieces that occur in a text with one scan. The
dynamic program keeps, for as many positions as the longest piece has characters, the
best score and the number of pieces on that path, no back pointers, as only the count is asked for. Ties are broken as
the tokenizer breaks them: a position's starts are tried from the left and a later
one must be strictly better, so of equal paths the one with the longest last piece
wins.

No piece of the vocabulary has U+2581 or a line feed behind another character, so no
piece crosses a unit's start (a separator and the word behind it), and the best path
is the best paths of the units put together; scores are whole numbers, so adding
them in another order gives the same sums. Each distinct unit is counted once while
it stays in a bounded table. ``UnigramCounter`` checks the vocabulary for this and
goes through whole texts otherwise.

Null and empty texts have 0 tokens. Every piece of the vocabulary is matched as text,
control, unknown and byte pieces too, as the tokenizers library's unigram model does: a
text that spells ``<s>`` holds that piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches
from .textbatch import WordTable, arrow_batches, bpe_units, sums, text_bytes

BLANK = "▁"
UNKNOWN_PENALTY = 10.0


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in order of id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0, capacity: int = 1 << 18) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max((len(piece) for piece, _ in vocabulary), default=1) or 1
        self.unknown_score = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        pieces = {p for p, _ in vocabulary}
        self.has_bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.parts = not any(b in (BLANK, "\n") and a != b for p in pieces for a, b in zip(p, p[1:], strict=False)) and all(float(s).is_integer() for _, s in vocabulary) and self.has_bytes
        self.counts = np.zeros(1 << 10, np.int32)
        self.used = 0
        self.table = WordTable(self._fill, capacity)

    def count_prepared(self, text: str) -> int:
        """Pieces on the best path of a text whose blanks are replaced already."""
        ring = self.longest + 1  # no piece reaches further back
        best, count, fused = [0.0] * ring, [0] * ring, False
        occurrences, none = self.automaton.iter(text), (len(text), (0, 0.0))
        end, match = next(occurrences, none)
        for k, char in enumerate(text):
            top, matches = None, []
            while end == k:
                matches.append(match)
                end, match = next(occurrences, none)
            matches.sort(reverse=True)  # the longest first: the leftmost start
            for size, score in matches:
                value = best[(k + 1 - size) % ring] + score
                if top is None or value > top:
                    top, pieces = value, count[(k + 1 - size) % ring] + 1
            single = bool(matches) and matches[-1][0] == 1
            unknown = False
            if not single:
                value = best[k % ring] + self.unknown_score
                if top is None or value > top:
                    unknown, top = True, value
                    if self.has_bytes:
                        pieces = count[k % ring] + len(char.encode())
                    else:
                        pieces = count[k % ring] + (not fused)
            best[(k + 1) % ring], count[(k + 1) % ring], fused = top, pieces, unknown
        return count[len(text) % ring]

    def count(self, text: str) -> int:
        return self.count_prepared(BLANK + text.replace(" ", BLANK)) if text else 0

    def _fill(self, units: list[bytes]) -> None:
        while self.used + len(units) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.counts[self.used : self.used + len(units)] = [self.count_prepared(u.decode().replace(" ", BLANK)) for u in units]
        self.used += len(units)

    def batch(self, col: pa.Array) -> np.ndarray:
        if not self.parts:
            return np.array([self.count(t or "") for t in col.to_pylist()], np.int64)
        if self.table.reset_if_full():
            self.used = 0
        # a text's first unit has no separator of its own: it is looked up with the blank put in front
        col = pa.array([(" " + t) if t else "" for t in col.to_pylist()], pa.string())
        buf, offsets = text_bytes(col)
        starts, ends, units, regular = units_of(buf, offsets)
        out = sums(self.counts_of(buf, starts, ends), units)
        for k in np.flatnonzero(~regular).tolist():
            out[k] = self.count_prepared(buf[offsets[k] : offsets[k + 1]].tobytes().decode().replace(" ", BLANK))
        return out

    def counts_of(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        ids = self.table.ids(buf, starts, ends)
        return self.counts[ids]


def units_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As bpe_units, of texts that all begin with a blank put there: the rest of each decides."""
    inner = offsets.copy()
    full = np.diff(offsets) > 0
    inner[:-1][full] += 1
    # look at the texts without their first blank, then let the first unit take it in
    keep = np.ones(int(offsets[-1]), bool)
    keep[offsets[:-1][full]] = False
    rest = np.concatenate([buf[: int(offsets[-1])][keep], buf[int(offsets[-1]) :]])
    rest_offsets = offsets - np.concatenate([[0], np.cumsum(full)])
    starts, ends, units, regular = bpe_units(rest, rest_offsets)
    doc = np.repeat(np.arange(len(units)), units)
    shift = np.cumsum(full)[doc]
    starts, ends = starts + shift, ends + shift
    first = np.zeros(len(starts), bool)
    first[(np.cumsum(units) - units)[units > 0]] = True
    starts[first] -= 1
    # a text of the blank alone has no rest
    regular = regular & ~((np.diff(rest_offsets) == 0) & full)
    return starts, ends, units, regular


_counters: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    """One per worker process, so its table outlives a task."""
    if path not in _counters:
        _counters[path] = UnigramCounter(load_vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for every row. One pass, no shuffle."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counter(model_path).batch(batch.column("text")))})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long")

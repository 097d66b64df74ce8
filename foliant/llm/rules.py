"""Quality rules and a log-likelihood ratio between two corpora of hashed n-grams.

Two multinomials over hashed byte n-grams are counted, one over the texts trusted as
a target and one over the whole raw corpus. A text's verdict is the mean over its
n-grams of log p(target) / p(raw), so it does not grow with length, held against a
fixed threshold: the same for every document, with no draw by chance.

Beside it stand plain counts with base rules: a text of under ``MIN_WORDS`` words
fails, and so does one of whose words over half stand in three-word windows that
occur twice or more in it.

Null texts are empty; texts of no n-gram have ratio 0. With no trusted text at all
the ratio is 0 everywhere and the base rules decide alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import byte_grams, group_sums
from .session import bounded_batches
from .textbatch import WordTable, arrow_batches, mix, runs, span_hash, text_bytes, white_words

GRAM = 4
BITS = 14
#: Mean log ratio under which a text is not kept.
THRESHOLD = -0.25
MIN_WORDS = 50

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[*b"#*$%&|<>"]] = 1


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(buf: np.ndarray, offsets: np.ndarray, table: WordTable) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text; ``table`` numbers the words."""
    n = int(offsets[-1])
    data, docs = buf[:n], len(offsets) - 1
    starts, ends, count = white_words(buf, offsets)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.cumsum(count) - count
    doc = np.repeat(np.arange(docs), count)
    out = {"n_words": count, "word_chars": per_text(~blank & ((data & 0xC0) != 0x80), offsets), "n_symbols": per_text(_SYMBOL[data], offsets)}

    # three-word windows: words get numbers by their bytes, equal numbers in a text are equal windows
    table.reset_if_full()
    w = table.ids(buf, starts, ends)
    repeat = np.zeros(len(w), bool)
    if len(w) > 2:
        at = np.flatnonzero(doc[:-2] == doc[2:])
        keys = (doc[at], w[at], w[at + 1], w[at + 2])
        h = mix(mix(mix(keys[1].astype(np.uint64) + np.uint64(1)) + keys[2].astype(np.uint64)) + keys[3].astype(np.uint64)) + mix(keys[0].astype(np.uint64) + np.uint64(77))
        order = np.argsort(h, kind="stable")
        close = h[order[1:]] == h[order[:-1]]
        same = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
        if (close != same).any():  # two windows share a hash: sort by what they are
            order = np.lexsort(keys[::-1])
            same = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        for k in range(3):
            repeat[at[twice] + k] = True
    total = np.concatenate([[0], np.cumsum(repeat)])
    out["n_repeat_words"] = total[first + count] - total[first]

    # lines that have a word, by their whole content: hashes tell which may be equal, bytes which are
    a, b, lines = runs(data != 10, offsets)
    words = np.concatenate([[0], np.cumsum(~blank)])
    doc = np.repeat(np.arange(docs), lines)
    full = words[b] > words[a]
    a, b, doc = a[full], b[full], doc[full]
    key = span_hash(buf, a, b) + mix(doc.astype(np.uint64) + np.uint64(77))
    _, group, size = np.unique(key, return_inverse=True, return_counts=True)
    again, seen, raw = np.zeros(docs, np.int64), set(), memoryview(data)
    for k in np.flatnonzero(size[group] > 1).tolist():
        line = int(doc[k]), raw[a[k] : b[k]].tobytes()
        if line in seen:
            again[line[0]] += 1
        seen.add(line)
    out["n_dup_lines"] = again
    return out


COUNTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p(target) / p(raw) of each hash bucket, over all texts of ``docs``; target are those whose id is in ``trusted``.

    Counts are summed inside a task first, so what is shuffled is a row for each
    bucket and task, and what reaches the driver a row for each bucket.
    """
    bounded_batches(docs.sparkSession)
    ids = trusted.select(F.col(id_col).alias("id"), F.lit(True).alias("target")).where("id is not null").distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    # ids grow with the corpus: they meet the texts in one shuffle at every size, and are never broadcast. Rows without an
    # id are never a target and stay where they are; an id that very many rows share is split by the adaptive skew join
    marked = rows.where("id is not null").join(ids.hint("merge"), "id", "left").unionByName(rows.where("id is null").withColumn("target", F.lit(False)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in arrow_batches(batches):
            h, per = byte_grams(*text_bytes(batch.column("text")), GRAM, BITS)
            raw += np.bincount(h, minlength=1 << BITS)
            chosen = np.repeat(np.asarray(batch.column("target").fill_null(False).to_numpy(zero_copy_only=False), bool), per)
            target += np.bincount(h[chosen], minlength=1 << BITS)
        if full := np.flatnonzero(raw).tolist():
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "raw": pa.array(raw[full]), "target": pa.array(target[full])})

    rows = marked.select("text", "target").mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    counts = np.zeros((2, 1 << BITS))
    counts[:, rows["bucket"].to_numpy(int)] = rows[["target", "raw"]].to_numpy(float).T
    if not counts[0].sum():
        return np.zeros(1 << BITS)
    counts += 1
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def report(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, the base counts, base_failed, kept, log_ratio) for every row. One pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(None, 1 << 18)
        for batch in arrow_batches(batches):
            buf, offsets = text_bytes(batch.column("text"))
            counts = base_counts(buf, offsets, table)
            h, per = byte_grams(buf, offsets, GRAM, BITS)
            mean = group_sums(sent.value[h], per) / np.maximum(per, 1)
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **{c: pa.array(counts[c], pa.int64()) for c in COUNTED}, "base_failed": pa.array(failed), "kept": pa.array(~failed & (mean >= threshold)), "log_ratio": pa.array(mean)})

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, {', '.join(f'{c} long' for c in COUNTED)}, base_failed boolean, kept boolean, log_ratio double"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)

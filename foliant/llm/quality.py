"""Quality classifier over learned subword embeddings.

A text's features are its words and its n-grams of characters, hashed into the rows of
a learned embedding table, and in a row of its own one for each word that repeats the
one before. Their vectors are averaged over the whole text, together with PRIOR
vectors of zero that keep a text of few features near the labels' share, and go
through a softmax layer. Table and layer are trained together in numpy by stochastic
gradient descent on the cross entropy, a text at a time, on at most ``TRAIN_ROWS``
labelled texts, chosen evenly by a hash of their id with no regard to the label, so
scores keep the labels' share. The step on the table is the gradient times RATE over
the squared length of the text's shares: texts of few and of many features move their
own score alike, and no step overshoots.

Averaging is linear, so for scoring the table and the layer fold into one number for
each row and class, and a score is a lookup and a mean. Empty and null texts have
no features: their score is the layer's bias alone. Nothing learned: score 1. A label
that is given twice in both ways teaches both; ids that are null teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import char_grams, group_sums, word_hashes
from .session import bounded_batches, room_for, sample
from .textbatch import arrow_batches, text_bytes

BITS = 15
#: The row of repeated words, behind those of hashes; rows in all.
REPEAT = 1 << BITS
ROWS = REPEAT + 1
GRAMS = (3, 4)
SIZE = 8
EPOCHS = 6
RATE, LAYER_RATE, BIAS_RATE = 0.5, 0.2, 0.04
THRESHOLD = 0.7
PRIOR = 100
#: Labelled texts to fit on at most.
TRAIN_ROWS = 3000


@dataclass
class Model:
    weight: np.ndarray  # of each bucket: what it adds to the log odds of class 1
    bias: float

    def score(self, col: pa.Array) -> np.ndarray:
        buf, offsets = text_bytes(col)
        total = np.zeros(len(offsets) - 1)
        n = np.zeros(len(offsets) - 1)
        for h, per in features(buf, offsets):
            total += group_sums(self.weight[h], per)
            n += per
        return 1 / (1 + np.exp(-np.clip(self.bias + total / (n + PRIOR), -30, 30)))


def features(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    words, count = word_hashes(buf, offsets, BITS)
    yield words, count
    same = words[1:] == words[:-1]
    first = np.cumsum(count) - count
    same[first[(first > 0) & (first < len(words))] - 1] = False  # words of two texts
    end = np.concatenate([[0], np.cumsum(same)])
    at = np.minimum(np.maximum(np.concatenate([first, [len(words)]]) - 1, 0), len(same))
    yield np.full(int(same.sum()), REPEAT, np.uint32), np.diff(end[at])
    yield from char_grams(buf, offsets, GRAMS, BITS)


def gradient(table: np.ndarray, layer: np.ndarray, bias: np.ndarray, bucket: np.ndarray, part: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text's mean vector, and the cross entropy's gradient by the layer's output and by the mean."""
    mean = part @ table[bucket]
    z = mean @ layer + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    p[label] -= 1
    return mean, p, layer @ p


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """rows: (buckets, their shares of the text's features, label 0 or 1)."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / SIZE, 1 / SIZE, (ROWS, SIZE))
    layer, bias = np.zeros((SIZE, 2)), np.zeros(2)
    share = np.mean([label for *_, label in rows]) if rows else 1.0
    if not 0 < share < 1:  # one class alone
        return Model(np.zeros(ROWS), 30.0 if share else -30.0)
    layer[:, 1], layer[:, 0] = rng.uniform(-1, 1, SIZE), rng.uniform(-1, 1, SIZE)
    bias[:] = np.log([1 - share, share])
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)).tolist():
            bucket, part, label = rows[k]
            rate = 1 - step / steps
            step += 1
            mean, p, back = gradient(table, layer, bias, bucket, part, label)
            layer -= LAYER_RATE * rate * np.outer(mean, p)
            bias -= BIAS_RATE * rate * p
            table[bucket] -= (RATE * rate / (part @ part)) * np.outer(part, back)
    both = table @ layer
    return Model(both[:, 1] - both[:, 0], float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Learn labels 0 and 1. Only the chosen labels, ``rows`` at most, are sent to the scan of the texts; each is learned with one text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    n = labels.count()
    chosen, at = sample(labels, min(1.0, rows / max(1, n)), "id")
    chosen = chosen.orderBy(at, "id", "label").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text")).select(F.col("id").cast("string").alias("id"), "text", "label")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches, 128):
            buf, offsets = text_bytes(batch.column("text"))
            parts = [(h, np.concatenate([[0], np.cumsum(per)])) for h, per in features(buf, offsets)]
            bucket, share = [], []
            for k in range(batch.num_rows):
                h, c = np.unique(np.concatenate([h[at[k] : at[k + 1]] for h, at in parts]), return_counts=True)
                bucket.append(h.astype(np.uint16).tobytes())
                share.append((c / (c.sum() + PRIOR)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "label": batch.column("label"), "bucket": bucket, "share": share})

    got = texts.mapInArrow(vectors, "id string, label int, bucket binary, share binary").collect()
    got.sort(key=lambda r: (r.id, r.label, bytes(r.bucket)))
    return train([(np.frombuffer(r.bucket, np.uint16).astype(np.int64), np.frombuffer(r.share, np.float32).astype(float), r.label) for r in got if len(r.bucket)])


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str | None = None) -> DataFrame:
    """``docs`` with one more column, the last: the probability of label 1. By default its name is a free one like ``score``. One pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    docs, name = room_for(docs, name, "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches, 128):
            yield batch.append_column(name, pa.array(sent.value.score(batch.column(text_col))))

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(name, T.DoubleType())]))


def good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least ``threshold``; columns as they are."""
    scored = with_score(docs, model, text_col)
    name = scored.columns[-1]
    return scored.where(F.col(name) >= threshold).drop(name)

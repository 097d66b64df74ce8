"""Language identification by nearest centroids.

A text is a vector of hashed byte n-grams (letters folded, the rest blank): root of
the count times inverse document frequency, normalised to length one. Each language
has several centroids, found by spherical k-means over its training vectors. The
prediction is the language of the centroid of the largest cosine. A text further
from its centroid than nearly all training vectors of the language is *rejected*:
that is told in a column of its own, beside the nearest language.

The model is fitted on at most ``TRAIN_ROWS`` labelled texts, or one of each language
if there are more languages than that, chosen evenly by a hash of id, label and text,
equal rows once, the same number of each language where it has enough. Every label is
a language; over ``LANGUAGES`` of them are taken for a mistake and raise ValueError.
Whole texts are read, in training and in prediction.

Null texts and texts with no letter are ``und`` with score 0. Where nothing was
learned every text is ``und``. Rows with a null label are not learned from. Of equally
near centroids that of the language first in order, and its first, counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import LETTERS, byte_grams
from .session import bounded_batches, distinct_rows, sample
from .textbatch import arrow_batches, text_bytes

GRAMS = (2, 3)
BITS = 12
CENTROIDS = 4
#: Labelled texts to fit on at most, for all languages together and for one.
TRAIN_ROWS = 2400
TRAIN_ROWS_EACH = 600
#: Distinct labels at most.
LANGUAGES = 5000
#: The share of training vectors inside a language's radius, and what widens it.
INSIDE = 0.995
SLACK = 1.25


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one a row
    of: np.ndarray  # index of each centroid's language
    radius: np.ndarray  # of each language, as cosine distance


def counts(col: pa.Array) -> np.ndarray:
    """Roots of n-gram counts, a row for each text."""
    buf, offsets = text_bytes(col)
    folded = LETTERS[buf]
    n = len(offsets) - 1
    out = np.zeros(n << BITS)
    for g in GRAMS:
        h, per = byte_grams(folded, offsets, g, BITS)
        out += np.bincount(np.repeat(np.arange(n, dtype=np.int64) << BITS, per) + h, minlength=n << BITS)
    return np.sqrt(out.reshape(n, 1 << BITS)).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from vectors far from each other, so it is the same each time."""
    centre = unit(x.mean(axis=0, keepdims=True))
    while len(centre) < min(k, len(x)):
        centre = np.concatenate([centre, x[[(x @ centre.T).max(axis=1).argmin()]]])
    for _ in range(rounds):
        near = (x @ centre.T).argmax(axis=1)
        centre = unit(np.stack([x[near == j].mean(axis=0) if (near == j).any() else centre[j] for j in range(len(centre))]))
    return centre


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = TRAIN_ROWS, rows_each: int = TRAIN_ROWS_EACH) -> Model:
    """Learn from labelled ``docs``; what reaches the driver is bounded by ``rows`` vectors, or one for each language."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).where("text is not null and label is not null")
    found = docs.groupBy("label").agg(distinct_rows("id", "text").alias("rows")).limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} distinct values in {label_col}")
    if not found:
        return Model([], np.zeros(0), np.zeros((0, 0)), np.zeros(0, int), np.zeros(0))
    each = min(rows_each, max(1, rows // len(found)))
    # somewhat more than wanted of each language, so that chance leaves none without
    share = spark.createDataFrame([(r.label, min(1.0, (2 * each + 20) / max(1, r["rows"]))) for r in found], "label string, share double")
    chosen, at = sample(docs.join(F.broadcast(share), "label"), F.col("share"), "id", "label", "text")
    place = F.row_number().over(Window.partitionBy("label").orderBy(at, "id", "text"))
    chosen = chosen.withColumn("place", place).where(F.col("place") <= each).drop("place")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            x = counts(batch.column("text"))
            letters = [has_letter(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "id": batch.column("id"), "x": [v.tobytes() if ok else None for v, ok in zip(x, letters, strict=True)]})

    got = [r for r in chosen.mapInArrow(vectors, "label string, id string, x binary").collect() if r.x is not None]
    got.sort(key=lambda r: (r.label, r.id or "", bytes(r.x)))
    languages = sorted({r.label for r in got})
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got]) if got else np.zeros((0, 1 << BITS), np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x = unit(x * idf)
    label = np.array([languages.index(r.label) for r in got], int)
    centre = [k_means(x[label == j], CENTROIDS) for j in range(len(languages))]
    radius = np.array([SLACK * np.quantile(1 - (x[label == j] @ c.T).max(axis=1), INSIDE) for j, c in enumerate(centre)])
    return Model(languages, idf, np.concatenate(centre) if centre else np.zeros((0, 1 << BITS)), np.repeat(np.arange(len(centre)), [len(c) for c in centre]), radius)


def classify(model: Model, col: pa.Array) -> dict[str, list]:
    texts = col.to_pylist()
    letters = np.array([has_letter(t) for t in texts], bool)
    if not len(model.languages):
        return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "rejected": [True] * len(texts)}
    near = unit(counts(col) * model.idf) @ model.centroids.T
    best = near.argmax(axis=1)
    score = np.clip(near[np.arange(len(texts)), best].astype(float), 0, 1)
    language = model.of[best]
    return {
        "lang_pred": [model.languages[j] if ok else "und" for j, ok in zip(language.tolist(), letters.tolist(), strict=True)],
        "score": np.where(letters, score, 0.0).tolist(),
        "rejected": (~letters | (1 - score > model.radius[language])).tolist(),
    }


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row. One pass, no shuffle; the model's size is fixed."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **classify(sent.value, batch.column("text"))})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, lang_pred string, score double, rejected boolean")

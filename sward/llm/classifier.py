"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

Features are n-grams of word and sign runs, and n-grams of their shapes, hashed into
``2 ** BITS`` weights; each family's n-grams of a text weigh 1 together, so the score is the
mean weight of the text's n-grams: a sparse dot product. The weights are learned from a
bounded sample of labelled texts by one task and sent back as one array of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sward.llm.common import Text, mix, prepare, text_slices
from sward.llm.labelled import fold, ngrams, tokens, training_sample

BITS = 18
# Most labelled texts that the weights are learned from.
SAMPLE_ROWS = 6000
EPOCHS = 6
# FTRL-proximal: learning rate, smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.02
# Bytes of text whose n-grams a task holds at a time: they take some hundred times that room.
SLICE_BYTES = 256 << 10
# What a family's n-grams of one text weigh together.
MASS = 4.0


def features(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight index, row, value) of every n-gram of every text."""
    hashed, shape, row, *_ = tokens(text)
    shaped = np.where(shape == 5, hashed, mix(shape.astype(np.uint64)))
    index, rows, values = [], [], []
    for family, (key, n) in enumerate(((hashed, 1), (hashed, 2), (shaped, 1), (shaped, 2), (shaped, 3))):
        gram, at = ngrams(key, row, n, family)
        count = np.bincount(at, minlength=text.rows)
        index.append((gram >> np.uint64(64 - BITS)).astype(np.int32))
        rows.append(at)
        values.append((MASS / np.maximum(count, 1))[at])
    return np.concatenate(index), np.concatenate(rows), np.concatenate(values)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """Follow the regularised leader over sparse rows; the bias is a weight without penalty."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, index: np.ndarray) -> np.ndarray:
        z = self.z[index]
        l1 = np.where(index == len(self.z) - 1, 0.0, L1)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[index])) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        gradient = (sigmoid(float(w @ value)) - label) * value
        n = self.n[index]
        self.z[index] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / ALPHA * w
        self.n[index] = n + gradient**2


def learn(rows: list[tuple[int, np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights (bias last) from (order, index, value, label) rows; no rows give zeros."""
    model = Ftrl(1 << BITS)
    rows = sorted(rows, key=lambda r: r[0])
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            _, index, value, label = rows[i]
            model.update(np.append(index, 1 << BITS), np.append(value, 1.0), label)
    return model.weights(np.arange((1 << BITS) + 1))


def train(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    sample = training_sample(docs, labels, label, learn_from, sample_rows)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, text in text_slices(batch, size=SLICE_BYTES):
                index, row, value = features(text)
                key, back = np.unique(row.astype(np.int64) << BITS | index, return_inverse=True)
                total = np.bincount(back, weights=value, minlength=len(key))
                cut = np.searchsorted(key >> BITS, np.arange(text.rows + 1))
                own = key & ((1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                     pa.array([total[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                     batch.column("label").slice(low, high - low), batch.column("turn").slice(low, high - low)],
                    names=["index", "value", "label", "turn"],
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [
            (r["turn"], np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"]), r["label"])
            for batch in batches for r in batch.to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([pa.array([learn(held).astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    vectors = sample.mapInArrow(rows, "index binary, value binary, label int, turn long").repartition(1)
    return np.frombuffer(vectors.mapInArrow(fit, "weights binary").first()["weights"], np.float32).astype(np.float64)


def with_score(
    docs: DataFrame, labels: DataFrame, name: str, label: str = "quality", parts: int = 3, held: int = 1,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``docs`` with the score in a new column ``name``; rows keep their place, nothing is shuffled."""
    spark = prepare(docs.sparkSession)
    weights = train(docs, labels, label, fold(F.col("doc_id"), parts) != held, sample_rows)
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))  # 2 ** BITS floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for batch in batches:
            for low, high, text in text_slices(batch, size=SLICE_BYTES):
                index, row, value = features(text)
                score = sigmoid(np.bincount(row, weights=w[index] * value, minlength=text.rows) + w[-1])
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, held: int = 1,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per document: doc_id, held_out, score (label 1 likelier when higher), predicted.

    Labels are learned only outside fold ``held`` of ``parts``. Empty and null texts get the bias
    alone; without labels every score is 0.5. Equal texts get equal scores. Of ``docs`` only
    doc_id and text are read, of ``labels`` doc_id and the label.
    """
    scored = with_score(docs.select("doc_id", "text"), labels, "score", label, parts, held, sample_rows)
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

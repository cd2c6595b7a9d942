"""A bounded sample of labelled documents for training, and hashed word features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sward.llm.common import Text, mix, prefix_hashes, span_hashes

# Byte classes: 0 parts words, 1 letters, digits and all beyond ASCII, 2 other signs.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[:33] = 0
_CLASS[127] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text, modulo ``parts``; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents, the ones whose id hashes lowest.

    The ids and labels, never more than ``rows``, are sent to the tasks that read the texts. An
    id with several labels takes the larger one.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn_from)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", F.xxhash64("doc_id", F.lit(1)).alias("turn"))


def tokens(text: Text, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape, row, start, stop, is a word) of every run of word bytes or of signs.

    The shape is 0-3 for words without capitals, with a first one, all capitals, others mixed; 4
    for digits alone; for signs it is 5.
    """
    data = text.lowered() if lower else text.data
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[text.offsets] = True
    change = edge[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    begin = np.flatnonzero(change)
    end = np.append(begin[1:], len(data)) if len(begin) else begin
    use = kind[begin] != 0
    start, stop = begin[use], end[use]
    row = np.searchsorted(text.offsets, start, "right") - 1
    hashed = span_hashes(prefix_hashes(data), start, stop)
    word = kind[start] == 1
    up = np.concatenate(([0], np.cumsum((text.data >= 65) & (text.data <= 90))))
    digit = np.concatenate(([0], np.cumsum((text.data >= 48) & (text.data <= 57))))
    ups, size = up[stop] - up[start], stop - start
    first = (up[start + 1] - up[start]) > 0
    shape = np.select(
        [~word, digit[stop] - digit[start] == size, ups == 0, (ups == 1) & first, ups == size], [5, 4, 0, 1, 2], 3
    )
    return hashed, shape, row, start, stop, word


def ngrams(key: np.ndarray, row: np.ndarray, n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the n-grams of ``key`` inside each row; ``family`` keeps kinds apart."""
    m = len(key) - n + 1
    if m < 1:
        return np.zeros(0, np.uint64), np.zeros(0, row.dtype)
    out = mix(key[:m] + np.uint64(family))
    for i in range(1, n):
        out = mix(out * np.uint64(5) + key[i : m + i])
    same = row[:m] == row[n - 1 :]
    return out[same], row[:m][same]

"""Toxicity: maximum-scoring segments over token log-odds, with extreme-value calibration.

A token's score is its log-odds between toxic and clean labelled texts under an informative
Dirichlet prior (the pooled counts); scores that the counts do not support are cut to at most 0.
A word seen in too few texts takes the score of its stem, its first bytes.
All maximal scoring segments of a text are found in one linear scan. The sum statistic of its
segments is turned into a p value by a Gumbel law fitted to the clean labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sward.llm.common import Text, prefix_hashes, prepare, span_hashes, text_slices
from sward.llm.labelled import fold, tokens, training_sample

BITS = 20
# A word found in fewer labelled texts than this is scored by its first STEM_BYTES bytes; such a stem is not scored above 0.
ENOUGH = 8
STEM_BYTES = 6
# Most labelled texts that the token scores and the calibration are learned from.
SAMPLE_ROWS = 8000
# Weight of the prior in tokens; least support (signed root of the likelihood ratio) of a positive score.
PRIOR_TOKENS = 500.0
SUPPORT = 3.0
# Expected number of chance segments up to which a segment counts as significant.
MAX_EXPECTED = 0.05


@dataclass
class Model:
    """Token scores, scale of the score, Gumbel place and spread, p value of the decision."""

    scores: np.ndarray  # of words (not a number where too rare) and of stems
    scale: float
    place: float
    spread: float
    cut: float


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Log-odds of all tokens, not a number where no token was seen or the counts do not support one above 0."""
    both = toxic + clean
    scores = np.full(len(both), np.nan)
    if toxic.sum() and clean.sum():
        seen = both > 0
        prior = PRIOR_TOKENS * both[seen] / both.sum()
        a, b, p = toxic[seen] + prior, clean[seen] + prior, PRIOR_TOKENS
        delta = np.log(a / (toxic.sum() + p - a)) - np.log(b / (clean.sum() + p - b))
        # tested on the pooled count, so that a token found in no clean text is not without support
        enough = both[seen] >= ENOUGH
        scores[seen] = np.where(enough & (delta > 0) & (support(toxic[seen], clean[seen], toxic.sum() / both.sum()) > SUPPORT), delta, np.nan)
    return scores


def support(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Root of the likelihood ratio of each token's counts against the toxic share of all counted tokens."""
    both = toxic + clean
    part = np.where(toxic > 0, toxic * np.log(np.maximum(toxic, 1e-9) / (both * share)), 0.0)
    rest = np.where(clean > 0, clean * np.log(np.maximum(clean, 1e-9) / (both * (1 - share))), 0.0)
    return np.sqrt(2 * np.maximum(part + rest, 0.0))


def drift(scores: np.ndarray, clean: np.ndarray) -> float:
    """What every other token costs: more than clean texts gain on average, so that long ones gain nothing."""
    return float(1.5 * np.nansum(scores * clean) / max(clean.sum(), 1.0) + 0.01)


def word_buckets(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, bucket of the stem, row, start, stop) of every word, in lower case."""
    hashed, _, row, start, stop, word = tokens(text, lower=True)
    start, stop, shift = start[word], stop[word], np.uint64(64 - BITS)
    stem = span_hashes(prefix_hashes(text.lowered()), start, np.minimum(start + STEM_BYTES, stop)) + np.uint64(1 << 63)
    return (hashed[word] >> shift).astype(np.int64), (stem >> shift).astype(np.int64), row[word], start, stop


def token_values(scores: np.ndarray, bucket: np.ndarray, stem: np.ndarray) -> np.ndarray:
    own = scores[0][bucket]
    return np.where(np.isnan(own), scores[1][stem], own).astype(np.float64)


def segments(place: list[int], gain: list[float], before: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, last, score), by the linear scan of positive tokens.

    ``place`` are the positions of positive tokens, ``gain`` their scores, ``before`` the running
    sum of all scores in front of each.
    """
    found: list[list[float]] = []  # [sum before, sum behind, first, last, index of the last one with a smaller sum before]
    for at, score, left in zip(place, gain, before):
        new = [left, left + score, at, at, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j = found[j][4]
            new[4] = j
            if j < 0 or found[j][1] >= new[1]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(int(a), int(b), right - left) for left, right, a, b, _ in found]


def statistics(text: Text, scores: np.ndarray, scale: float):
    """Per text: (sum statistic, tokens, significant segments as byte spans with their scores)."""
    bucket, stem, row, start, stop = word_buckets(text)
    value = token_values(scores, bucket, stem)
    running = np.concatenate(([0.0], np.cumsum(value)))
    up = np.flatnonzero(value > 0)
    first = np.searchsorted(row, np.arange(text.rows + 1))
    bounds = np.searchsorted(up, first)
    stats, spans = np.full(text.rows, -np.inf), [[] for _ in range(text.rows)]
    for i in np.flatnonzero(np.diff(bounds)):
        mine = up[bounds[i] : bounds[i + 1]]
        base, n = running[first[i]], first[i + 1] - first[i]
        parts = segments(mine.tolist(), value[mine].tolist(), (running[mine] - base).tolist())
        lifts = [scale * s - np.log(n) for *_, s in parts]
        best = max(lifts)
        rest = sum(x for x in lifts if x > 0) - max(best, 0.0)
        stats[i] = best + rest
        spans[i] = [(int(start[a] - text.offsets[i]), int(stop[b] - text.offsets[i]), float(s), float(x)) for (a, b, s), x in zip(parts, lifts)]
    return stats, np.diff(first), spans


def p_value(stat: np.ndarray, model: Model) -> np.ndarray:
    """Chance of a clean text reaching ``stat``; 1 for texts without a segment."""
    with np.errstate(over="ignore"):
        return -np.expm1(-np.exp(-(np.maximum(stat, -1e3) - model.place) / model.spread))


def score_scale(scores: np.ndarray, clean: np.ndarray) -> float:
    """The positive root of the sum of p * exp(scale * score) = 1 over clean tokens."""
    p, scores = clean / max(clean.sum(), 1.0), scores.astype(np.float64)
    low, high = 1e-3, 1.0
    while high < 64 and (p * np.exp(np.minimum(high * scores, 600.0))).sum() < 1:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        if (p * np.exp(np.minimum(middle * scores, 600.0))).sum() < 1:
            low = middle
        else:
            high = middle
    return low


def calibrate(scores: np.ndarray, scale: float, stats: np.ndarray, labels: np.ndarray) -> Model:
    """Fit the Gumbel law to clean texts that have a segment, and the p value that parts the labels best."""
    clean = stats[(labels == 0) & np.isfinite(stats)]
    place, spread = 0.0, 1.0
    if len(clean) >= 20:
        low, high = np.quantile(clean, [0.5, 0.95])
        spread = max(0.2, (high - low) / (np.log(-np.log(0.5)) - np.log(-np.log(0.95))))
        place = low + spread * np.log(-np.log(0.5))
    model = Model(scores, scale, float(place), float(spread), 0.01)
    if len(set(labels.tolist())) == 2:
        finite = np.unique(stats[np.isfinite(stats)])
        tries = np.concatenate((finite[:1] - 1, (finite[1:] + finite[:-1]) / 2, finite[-1:] + 1)) if len(finite) else np.zeros(1)
        order = np.sort(stats[labels == 1]), np.sort(stats[labels == 0])
        hit = len(order[0]) - np.searchsorted(order[0], tries)
        wrong = len(order[1]) - np.searchsorted(order[1], tries)
        right = hit - wrong
        best = np.flatnonzero(right == right.max())
        model.cut = max(float(p_value(tries[best[len(best) // 2]], model)), 1e-300)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, sample_rows: int) -> Model:
    sample = training_sample(docs, labels, label, learn_from, sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, 1 << BITS), np.int32)  # words and stems, clean and toxic
        for batch in batches:
            for low, high, text in text_slices(batch):
                *buckets, row, _, _ = word_buckets(text)
                own = np.asarray(batch.column("label").slice(low, high - low))
                for kind, bucket in enumerate(buckets):
                    # a token counts once a text: one text that repeats itself says no more than another
                    once = np.unique(row << BITS | bucket)
                    for k in (0, 1):
                        total[kind, k] += np.bincount(once[own[once >> BITS] == k] & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
        for kind in (0, 1):
            seen = np.flatnonzero(total[kind].any(axis=0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), kind, np.int32)), pa.array(seen), pa.array(total[kind, 1][seen].astype(np.int64)), pa.array(total[kind, 0][seen].astype(np.int64))],
                names=["kind", "bucket", "toxic", "clean"],
            )

    counts = sample.select("text", "label").mapInArrow(count, "kind int, bucket long, toxic long, clean long")
    got = counts.groupBy("kind", "bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()  # at most 2 ** (BITS + 1) rows
    scores, words = np.zeros((2, 1 << BITS), np.float32), None
    for kind in (0, 1):
        toxic, clean = np.zeros(1 << BITS), np.zeros(1 << BITS)
        part = got[got["kind"] == kind]
        toxic[part["bucket"].to_numpy(np.int64)] = part["toxic"]
        clean[part["bucket"].to_numpy(np.int64)] = part["clean"]
        odds = log_odds(toxic, clean)
        scores[kind] = np.where(np.isnan(odds), -drift(odds, clean), odds)
        if kind == 0:
            scores[0][toxic + clean < ENOUGH] = np.nan
            words = clean
    scale = score_scale(np.nan_to_num(scores[0]), words)
    shared = docs.sparkSession.sparkContext.broadcast(scores)  # 2 ** (BITS + 1) floats, whatever the input

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, text in text_slices(batch):
                stats, _, _ = statistics(text, shared.value, scale)
                yield pa.RecordBatch.from_arrays([pa.array(stats), batch.column("label").slice(low, high - low)], names=["stat", "label"])

    seen = sample.select("text", "label").mapInArrow(measure, "stat double, label int").toPandas()  # at most sample_rows rows
    return calibrate(scores, scale, seen["stat"].to_numpy(float), seen["label"].to_numpy(int))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held: int = 0,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, p_value, passages.

    ``passages`` are the significant segments: byte offsets in the text, log-odds and expected number of
    chance segments of that score. The score is 0.5 at the p value that best parts the labelled texts. Labels
    are learned outside fold ``held`` of ``parts``. Null, empty and wordless texts have p value 1; without
    labels no token scores, and no text is predicted toxic. Equal texts get equal scores.
    """
    spark = prepare(docs.sparkSession)
    model = train(docs, labels, label, fold(F.col("doc_id"), parts) != held, sample_rows)
    shared = spark.sparkContext.broadcast(model.scores)  # 2 ** (BITS + 1) floats, whatever the input
    numbers = (model.scale, model.place, model.spread, model.cut)
    passage = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("log_odds", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value, *numbers)
        for batch in batches:
            for low, high, text in text_slices(batch):
                stats, _, spans = statistics(text, own.scores, own.scale)
                p = p_value(stats, own)
                score = np.clip(1 / (1 + p / own.cut), 0.0, 1.0)
                passages = [
                    [{"start": a, "stop": b, "log_odds": s, "expected": float(np.exp(-x))} for a, b, s, x in row if np.exp(-x) <= MAX_EXPECTED]
                    for row in spans
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(score), pa.array(p), pa.array(passages, pa.list_(passage))],
                    names=["doc_id", "score", "p_value", "passages"],
                )

    source = docs.select("doc_id", "text")
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("log_odds", T.DoubleType()), T.StructField("expected", T.DoubleType())]))
    schema = T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("p_value", T.DoubleType()), T.StructField("passages", kind)])
    return source.mapInArrow(run, schema).select(
        "doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "p_value", "passages",
    )

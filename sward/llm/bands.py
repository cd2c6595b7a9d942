"""Quality rules: compression bands over whole texts and fixed chunks, beside word rules.

A text whose zstandard ratio is high repeats itself; one whose ratio is low carries no
language. Short texts compress badly whatever they hold, so every limit depends on length. Limits
are set beyond the ratios that most texts of a length have in the corpus at hand, whatever their language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sward.llm.common import Text, mix, prefix_hashes, prepare, span_hashes, text_slices
from sward.session import pin

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT_WINDOW = 3
LEVEL = 3
CHUNK_BYTES = 4096
# A text fails if more than this share of its chunks lies outside the chunk limits.
MAX_BAD_CHUNKS = 0.1
# Outer limits: (bytes up to, least ratio, largest ratio) of bytes to compressed bytes.
BANDS = (
    (512, 0.90, 3.5),
    (2048, 1.15, 4.5),
    (8192, 1.30, 5.5),
    (65536, 1.40, 7.0),
    (float("inf"), 1.45, 9.0),
)

# A lower limit stands below the median ratio by REACH times the way to the first quartile, an upper one above the
# third quartile by FENCE times the way between the quartiles (Tukey's outer fence); each at least LEAST_GAP of the median
# away from it. Lengths are taken by half octaves; one with fewer than LEAST_TEXTS texts has no limit of its own.
REACH, FENCE, LEAST_GAP, LEAST_TEXTS = 5.0, 3.0, 0.12, 50
# Width of a step of the ratios' histogram.
STEP = 0.01

_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1

MEASURED = [
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()),
    ("ratio", T.DoubleType()), ("size", T.LongType()), ("parted", T.ArrayType(T.DoubleType())),
]
SCHEMA = [
    *MEASURED[:6], ("kept", T.BooleanType()), ("ratio", T.DoubleType()), ("bad_chunks", T.LongType()), ("chunks", T.LongType()),
]


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the rows' spans."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def limits(size: int) -> tuple[float, float]:
    return next((low, high) for upto, low, high in BANDS if size <= upto)


def half_octave(size: np.ndarray) -> np.ndarray:
    return np.floor(2 * np.log2(np.maximum(size, 1))).astype(np.int64)


def corpus_limits(histogram: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper limit of each half octave of lengths, from (half octave, step of the ratio, texts); 0 where none is known."""
    lower, upper = np.zeros(128), np.zeros(128)
    held: dict[int, list[tuple[int, int]]] = {}
    for octave, at, n in histogram:
        held.setdefault(octave, []).append((at, n))
    for octave, pairs in held.items():
        at, n = np.array(sorted(pairs)).T
        upto = np.cumsum(n)
        if upto[-1] >= LEAST_TEXTS:
            first, middle, third = ((at[np.searchsorted(upto, q * upto[-1])] + 0.5) * STEP for q in (0.25, 0.5, 0.75))
            lower[octave] = middle - max(REACH * (middle - first), LEAST_GAP * middle)
            upper[octave] = max(third + FENCE * (third - first), (1 + LEAST_GAP) * middle)
    # prose of more bytes compresses better, so the limit of a shorter length holds too
    return np.maximum.accumulate(lower), np.where(upper > 0, np.maximum.accumulate(upper), 0.0)


def repeat_words(start: np.ndarray, stop: np.ndarray, row: np.ndarray, rows: int, prefix: np.ndarray, window: int) -> np.ndarray:
    """Words of each row that stand in a window of words found twice or more in the row."""
    whole = span_hashes(prefix, start, stop)
    n = len(start) - window + 1
    if n < 1:
        return np.zeros(rows, np.int64)
    key = whole[:n]
    for i in range(1, window):
        key = mix(key * np.uint64(3) + whole[i : n + i])
    ok = np.flatnonzero(row[:n] == row[window - 1 :])
    # the row is part of the key: windows are compared inside a row only
    own = mix(key[ok] ^ mix(row[ok].astype(np.uint64)))
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    twice = np.zeros(len(ok), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(start) + 1, np.int64)
    at = ok[twice]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return np.bincount(row[covered], minlength=rows)


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, again = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(b" \t\n\r\x0b\x0c"):
            seen.add(line)
    return again


def measure(text: Text, packer: zstandard.ZstdCompressor) -> dict[str, list]:
    data, offsets = text.data, text.offsets
    start, stop, row = text.words()
    n_words = np.bincount(row, minlength=text.rows)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, stop, -1)
    in_word = np.cumsum(inside)[:-1] > 0
    chars = per_row((in_word & ((data & 0xC0) != 0x80)).astype(np.int64), offsets)
    symbols = per_row(_SYMBOLS[data], offsets)
    repeats = repeat_words(start, stop, row, text.rows, prefix_hashes(data), REPEAT_WINDOW)
    lines, ratios, parted = [], [], []
    for i in range(text.rows):
        raw = text.raw(i)
        lines.append(repeated_lines(raw) if b"\n" in raw else 0)
        ratios.append(len(raw) / len(packer.compress(raw)) if raw else 1.0)
        parts = [raw[a : a + CHUNK_BYTES] for a in range(0, len(raw), CHUNK_BYTES)]
        if len(parts) > 1 and len(parts[-1]) < CHUNK_BYTES // 2:
            parts[-2:] = [parts[-2] + parts[-1]]
        parted.append([len(part) / len(packer.compress(part)) for part in parts] if len(parts) > 1 else [])
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
    return dict(zip((name for name, _ in MEASURED), (n_words, chars, symbols, lines, repeats, failed, ratios, np.diff(offsets), parted)))


def judge(failed: np.ndarray, size: np.ndarray, ratio: np.ndarray, parted: list[np.ndarray], lower: np.ndarray, upper: np.ndarray):
    """(kept, bad chunks, chunks) of each text under the limits of the corpus and the outer ones."""

    def outside(size, ratio):
        low, high = np.array([limits(s) for s in size], np.float64).reshape(-1, 2).T
        # the limit of a half octave holds at its middle; between two middles it changes with the logarithm of the length
        at = 2 * np.log2(np.maximum(size, 1)) - 0.5
        known = np.flatnonzero(lower)
        own = np.interp(at, known, lower[known]) if len(known) else np.zeros(len(size))
        own = np.where(lower[half_octave(size)] > 0, own, 0.0)
        known = np.flatnonzero(upper)
        # a text longer than those that set limits may compress better than they do
        most = np.interp(at, known, upper[known], right=np.inf) if len(known) else np.full(len(size), np.inf)
        return (ratio < np.maximum(low, own)) | (ratio > np.minimum(high, most))

    many = np.array([len(p) for p in parted], np.int64)
    row = np.repeat(np.arange(len(size)), many)
    last = np.cumsum(many) - 1
    width = np.full(len(row), CHUNK_BYTES, np.int64)
    width[last[many > 0]] = (size - CHUNK_BYTES * (many - 1))[many > 0]
    bad = np.bincount(row[outside(width, np.concatenate([np.zeros(0), *parted]))], minlength=len(size))
    chunks = np.where(many > 0, many, np.minimum(size, 1))
    return ~failed & ~outside(size, ratio) & (bad <= MAX_BAD_CHUNKS * np.maximum(1, chunks)), bad, chunks


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word measures, ``base_failed``, compression ratios and ``kept``.

    A null text is empty: no words, ratio 1, base rule failed, not kept. Equal rows give equal
    results; an empty table an empty one. Only id and text are read. Limits come from all texts
    of the table that meet the word rules and the outer limits.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = T.StructField("doc_id", source.schema["doc_id"].dataType)
    kinds = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(), T.ArrayType(T.DoubleType()): pa.list_(pa.float64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for low, high, text in text_slices(batch):
                got = measure(text, packer)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), *(pa.array(got[name], kinds[kind]) for name, kind in MEASURED)],
                    names=["doc_id", *got],
                )

    measured = pin(source.mapInArrow(run, T.StructType([key, *(T.StructField(n, k) for n, k in MEASURED)])))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, ratio = batch.column("size").to_numpy(), batch.column("ratio").to_numpy()
            # a text's chunks count once, by their median, however long it is
            middle = [float(np.median(p)) for p in batch.column("parted").to_pylist() if p]
            size, ratio = np.append(size, np.full(len(middle), CHUNK_BYTES)), np.append(ratio, middle)
            low, high = np.array([limits(s) for s in size], np.float64).reshape(-1, 2).T
            use = (ratio >= low) & (ratio <= high)
            yield pa.RecordBatch.from_arrays(
                [pa.array(half_octave(size[use])), pa.array((ratio[use] / STEP).astype(np.int64))], names=["octave", "at"]
            )

    counted = measured.filter("not base_failed").select("size", "ratio", "parted").mapInArrow(steps, "octave long, at long")
    # as many rows as there are steps between the outer limits, for each doubling of the length twice
    within = corpus_limits([tuple(r) for r in counted.groupBy("octave", "at").count().collect()])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parted = [np.array(p, np.float64) for p in batch.column("parted").to_pylist()]
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            judged = judge(failed, batch.column("size").to_numpy(), batch.column("ratio").to_numpy(), parted, *within)
            new = dict(zip(("kept", "bad_chunks", "chunks"), judged))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(new[n], kinds[k]) if n in new else batch.column(n) for n, k in SCHEMA)],
                names=["doc_id", *(n for n, _ in SCHEMA)],
            )

    return measured.mapInArrow(decide, T.StructType([key, *(T.StructField(n, k) for n, k in SCHEMA)]))

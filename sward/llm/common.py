"""Shared pieces: Arrow text slices, vectorised hashing, pinned tables, row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sward.session import shared_dir, tune

__all__ = [
    "SLICE_BYTES", "Text", "WORD_BREAKS", "mix", "numbered", "prepare", "prefix_hashes", "row_prefix_hashes", "span_hashes",
    "table", "text_slices",
]

# A task works on about this much text at a time; one longer text is one slice.
SLICE_BYTES = 2 << 20
# Rows that one task numbers at most, on average (see ``numbered``).
ROWS_PER_BUCKET = 20_000
_M1, _M2, _GOLDEN = (np.uint64(v) for v in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)

# True for bytes that part words: space and the controls 9 to 13.
WORD_BREAKS = np.zeros(256, bool)
WORD_BREAKS[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Adaptive settings on, and a checkpoint folder where the session names none."""
    tune(spark)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return spark


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_LETTERS = mix(np.arange(256, dtype=np.uint64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of a byte array, modulo 2^64; n + 1 values."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _power_tables(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def row_prefix_hashes(rows: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes along each row of a byte matrix; one column more."""
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
    np.multiply(_LETTERS[rows], _power_tables(rows.shape[1] + 1)[0][: rows.shape[1]], out=out[:, 1:])
    np.cumsum(out, axis=1, out=out)
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each byte span [start, stop), the same wherever equal bytes stand."""
    return mix((prefix[stop] - prefix[start]) * _power_tables(len(prefix))[1][start])


class Text:
    """The texts of some rows as one byte array; text i is data[offsets[i]:offsets[i+1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def lowered(self) -> np.ndarray:
        upper = (self.data >= 65) & (self.data <= 90)
        return np.where(upper, self.data + 32, self.data).astype(np.uint8)

    def words(self, breaks: np.ndarray = WORD_BREAKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, row) of every word; a word never crosses two texts."""
        n = len(self.data)
        inside = ~breaks[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        start = np.flatnonzero(inside & (~before | edge[:n]))
        stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return start, stop, np.searchsorted(self.offsets, start, "right") - 1


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Text]]:
    """(first row, end row, texts) for runs of rows of about ``size`` bytes; null counts as empty."""
    values = batch.column(column).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset :][: len(values) + 1] if len(values) else np.zeros(1, np.int64)
    held = values.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(values):
        high = int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1
        high = min(max(high, low + 1), len(values))
        yield low, high, Text(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high


def numbered(df: DataFrame, by: list[str], key: Column, name: str, total: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in an order set by ``key``.

    A group is dealt over hash buckets of ``key``; rows are numbered inside a bucket and
    shifted by the counts of the group's earlier buckets, so no task holds a group.
    ``total`` (rows of ``df``) sets the number of buckets. ``df`` must give the same rows
    whenever it is read, and ``key`` should tell them apart.
    """
    buckets = max(1, -(-total // ROWS_PER_BUCKET))
    dealt = df.withColumn("__key", key).withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets)))
    groups = [*by, "__bucket"]
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        dealt.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
        .select(*groups, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"))
    )
    inside = F.row_number().over(Window.partitionBy(*groups).orderBy("__key")) - 1
    on = None
    shift = shift.withColumnsRenamed({c: f"__s{i}" for i, c in enumerate(groups)})
    for i, c in enumerate(groups):
        same = F.col(c).eqNullSafe(F.col(f"__s{i}"))
        on = same if on is None else on & same
    return (
        dealt.withColumn("__inside", inside).join(shift, on)
        .withColumn(name, (F.col("__inside") + F.col("__shift")).cast("long"))
        .drop("__key", "__bucket", "__inside", "__shift", *[f"__s{i}" for i in range(len(groups))])
    )

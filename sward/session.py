"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators count on. Joins against a hot key are left to
# adaptive execution, which splits an oversized shuffle partition between tasks.
_RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a join hashes its smaller side, instead of sorting both, if no partition of that side is larger
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
}

# Rows in memory take up to about so many times the room of their columns' files.
FILE_RATIO = 32

_local_dir: str | None = None


def tune(spark: SparkSession) -> SparkSession:
    """Switch on the adaptive settings the operators rely on."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def _bytes(size: str) -> int:
    """A setting such as 10485760b or 256k in bytes; -1 stays as it is."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Until the end of the block, a stored table is broadcast only if its rows keep to the threshold.

    Before a join runs, a table's size is the size of its files, which may be a thirtieth of its rows, and the
    hash table of the rows is built in the driver. Here such a guess must keep to a ``FILE_RATIO``-th of the
    threshold; adaptive execution still broadcasts every side whose rows it has measured to keep to the threshold.
    """
    guessed, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {key: spark.conf.get(key, None) for key in (guessed, measured)}
    threshold = _bytes(spark.conf.get(guessed))
    if before[measured] is None:
        spark.conf.set(measured, str(threshold))
    spark.conf.set(guessed, str(threshold // FILE_RATIO if threshold > 0 else threshold))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` when it is set.

    Only a local master may go without it; a cluster must name a folder that all
    executors can reach.
    """
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="sward-")
    return _local_dir


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A table that several later steps read is computed once, later scans prune its
    columns, and its size on disk is known to the optimiser. A lost executor
    costs no recomputation beyond this table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sward-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""A corpus pipeline over ``documents``: quality, near duplicates, leaks, source mixing, shards.

Every stage takes and keeps whole rows. Null ids, repeated ids and fully repeated rows are rows like
others; a null text is an empty one; an empty table passes through; columns beside those of
``documents`` are carried along, whatever their names, but for a column ``shard``, which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sward.llm.classifier import with_score
from sward.llm.common import table
from sward.llm.decontaminate import with_leaks
from sward.llm.mixing import mix_sources
from sward.llm.neardup import near_duplicates
from sward.llm.sharding import with_shard
from sward.session import pin


def _free(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` begins with it."""
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, stored, so that the numbers stay; and that column's name."""
    number = _free(docs, "__row")
    return pin(docs.withColumn(number, F.monotonically_increasing_id())), number


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; empty texts are scored like any other."""
    score = _free(docs, "__score")
    scored = with_score(docs, table(spark, sf_dir, "labels"), score)
    return scored.filter(F.col(score) >= 0.5).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8), the first by position.

    Of fully repeated rows one stays, and texts that share an id are judged by themselves. Rows without
    words are like nothing else and all stay.
    """
    rows, number = _numbered(docs)
    kept = _free(docs, "__kept")
    found = near_duplicates(rows, id_col=number).filter("kept").select(F.col("doc_id").alias(kept))
    return rows.join(found, F.col(number) == F.col(kept), "left_semi").drop(number)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; all of them where there are no items."""
    prefix = _free(docs, "__leak_")
    found = with_leaks(docs, table(spark, sf_dir, "benchmark"), prefix)
    return found.filter(~F.col(f"{prefix}contaminated")).drop(*[c for c in found.columns if c.startswith(prefix)])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target asks, from 0 to 3 times; a null source is a source.

    Rows that share an id, fully repeated ones too, have copy counts of their own. Rows without words stay once.
    """
    rows, number = _numbered(docs)
    own, times, copy = (_free(docs, name) for name in ("__own", "__times", "__copy"))
    mixed = mix_sources(rows, id_col=number).select(F.col("doc_id").alias(own), F.col("copies").alias(times))
    counted = rows.join(mixed, F.col(number) == F.col(own))
    return counted.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(times)))).drop(number, own, times, copy)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents and the shard of each row, 0 to 7; equal texts share one.

    A column named ``shard``, in any case, is replaced.
    """
    return with_shard(docs.drop(*[c for c in docs.columns if c.lower() == "shard"]))


STAGES = [
    ("quality_classifier", keep_good),
    ("minhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix),
    ("sharding", shard),
]

# Trained weights, hashed signatures and carried rounding errors have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

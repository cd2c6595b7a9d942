"""Sharding by longest-processing-time scheduling: groups stay together, largest first.

Groups of one size are interchangeable, so the schedule is made over the table of
different group sizes: the largest size first, every group of it to the least-loaded
shard, taken from a heap. Sizes are cut to five significant digits for the schedule alone,
which bounds that table (90,000 rows a decade above 10^5) whatever the number of groups;
groups of one size class then take the class's places by a number from a distributed count.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sward.llm.common import numbered, prepare
from sward.session import pin

SHARDS = 8


def schedule(counts: list[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, int]]:
    """(size, shard, first, end): places [first, end) of the groups of ``size`` go to ``shard``.

    ``counts`` holds (size, number of groups). All shards get the whole multiples that level
    loads allow at once; the rest is dealt through the heap, least load first, ties to the
    lower shard.
    """
    heap = [(0, shard) for shard in range(shards)]
    for size, count in sorted(counts, reverse=True):
        first = 0
        gap = max(load for load, _ in heap) - min(load for load, _ in heap)
        # once the loads are level to within one group, further rounds give each shard the same
        even = max(0, count // shards - gap // size - 1)
        taken = dict.fromkeys(range(shards), even)
        if even:
            heap = [(load + even * size, shard) for load, shard in heap]
            heapq.heapify(heap)
        for _ in range(count - even * shards):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))
            taken[shard] += 1
        for shard, n in taken.items():
            if n:
                yield size, shard, first, first + n
                first += n


def size_class(size: Column) -> Column:
    """``size`` cut to five significant digits."""
    unit = F.pow(F.lit(10.0), F.greatest(F.lit(0), F.floor(F.log10(size)) - 4)).cast("long")
    return (F.floor(size / unit) * unit).cast("long")


def shard_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Give each row of ``groups`` (grp, bytes; grp unique) its ``shard``.

    ``groups`` must be a stored table. An empty one gives an empty result.
    """
    prepare(groups.sparkSession)
    classed = groups.withColumn("cls", size_class(F.col("bytes")))
    counts = classed.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))

    def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [pair for part in parts for pair in zip(part["cls"].tolist(), part["n"].tolist())]
        yield pd.DataFrame(list(schedule(rows, shards)), columns=["cls", "shard", "first", "end"])

    runs = pin(counts.coalesce(1).mapInPandas(plan, "cls long, shard int, first long, end long"))
    # a class of many groups is dealt over as many keys as it has runs of places; eight at most
    places = numbered(classed, ["cls"], F.col("grp"), "place", groups.count())
    spans = runs.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("first", "end", "shard"))).alias("spans"))
    hit = F.filter("spans", lambda s: (s["first"] <= F.col("place")) & (F.col("place") < s["end"]))
    return (
        places.join(spans.withColumnRenamed("cls", "__cls"), F.col("cls") == F.col("__cls"))
        .select("grp", "bytes", F.element_at(hit, 1)["shard"].alias("shard"))
    )


def _group(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def with_shard(docs: DataFrame, shards: int = SHARDS, name: str = "shard", text_col: str = "text") -> DataFrame:
    """``docs`` with the shard of each row in a new column ``name``; equal texts share a shard."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(_group(text).alias("grp"), (F.octet_length(text) + 1).cast("long").alias("size"))
    groups = pin(sized.groupBy("grp").agg(F.sum("size").alias("bytes")))
    placed = shard_groups(groups, shards).select(F.col("grp").alias("__g"), F.col("shard").alias("__shard"))
    return docs.join(placed, _group(text) == F.col("__g")).drop("__g").withColumnRenamed("__shard", name)


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, group.

    Equal texts form a group; a null text has no bytes and goes with the empty ones. A group
    larger than a fair share fills its shard beyond it, since it may not be split. ``slot``
    counts a shard's rows from 0. Equal rows get slots of their own. An empty table gives an
    empty result.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = pin(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), _group(text).alias("grp"),
    ).withColumn("row", F.monotonically_increasing_id()))
    groups = pin(base.groupBy("grp").agg(F.sum("size").alias("bytes")))
    placed = pin(
        base.join(shard_groups(groups, shards).select(F.col("grp").alias("__g"), "shard"), F.col("grp") == F.col("__g")).drop("__g")
    )
    return numbered(placed, ["shard"], F.col("row"), "slot", placed.count()).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.hex("grp").alias("group"),
    )

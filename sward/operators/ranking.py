"""Relative cover, ranks, richness and leading taxa.

Group totals are aggregated and joined back. A task ranks small groups only; ranks of large ones
come from running counts of their different values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sward.operators.joins import first_per_key, keep_matching
from sward.scale import (
    RUN_ROWS, descending_rank, join_on, join_totals, rank_levels, rank_whole, split_by_size,
)
from sward.session import pin


def with_group_max(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Largest value of the group on every row."""
    return join_totals(df, by, **{out: F.max(value)})


def with_share(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Value divided by the group's total; null for a zero total."""
    joined = join_totals(df, by, __total=F.sum(value))
    return joined.withColumn(out, F.try_divide(F.col(value), F.col("__total"))).drop("__total")


def with_group_size(df: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """Number of rows of the group on every row."""
    return join_totals(df, by, **{out: F.count(F.lit(1))})


def with_group_mean(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Mean of the group on every row."""
    return join_totals(df, by, **{out: F.avg(value)})


def with_rank(
    df: DataFrame, by: Sequence[str], value: str, out: str = "rank", run_rows: int = RUN_ROWS
) -> DataFrame:
    """Competition rank, largest first: ties share a rank, the next one is skipped.

    A null value has a null rank.
    """
    return descending_rank(df, by, value, out, run_rows)


def with_rank_percentile(
    df: DataFrame, by: Sequence[str], value: str, run_rows: int = RUN_ROWS, dealt: bool = True
) -> DataFrame:
    """Share of total, its rank, richness and rank percentile within the group.

    Adds ``rel_cover``, ``rank``, ``rich`` and ``perc_rank``; the percentile is 1
    for the top row and 1/rich for the last. Without ``dealt``, rows that have no value stay with their
    group, and a group that one task may sort gets its total, size and ranks after one shuffle.
    """
    rows = pin(df)
    small, large = split_by_size(rows, by, run_rows)
    joined = rows if dealt else large
    totals = joined.groupBy(*by).agg(F.sum(value).alias("__total"), F.count(F.lit(1)).alias("rich"))

    def sized(part: DataFrame) -> DataFrame:
        share = F.try_divide(F.col(value), F.col("__total"))
        return join_on(part, totals, by, "left").withColumn("rel_cover", share).drop("__total")

    def ranked_whole(part: DataFrame) -> DataFrame:
        group = Window.partitionBy(*by)
        rank = F.rank().over(group.orderBy(F.col("rel_cover").desc_nulls_last())).cast("long")
        share = F.try_divide(F.col(value), F.sum(value).over(group))
        shared = part.withColumns({"rich": F.count(F.lit(1)).over(group), "rel_cover": share})
        return shared.withColumn("rank", F.when(F.col("rel_cover").isNotNull(), rank))

    whole = rank_whole(sized(small), by, "rel_cover", "rank") if dealt else ranked_whole(small)
    ranked = whole.unionByName(rank_levels(pin(sized(large)), by, "rel_cover", "rank"))
    return ranked.withColumn("perc_rank", rank_percentile(F.col("rank"), F.col("rich")))


def rank_percentile(rank: Column, rich: Column) -> Column:
    """1 for the first rank, 1/rich for the last."""
    return (rich + F.lit(1) - rank) / rich


def with_distinct_count(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Distinct values in the group, a null counting as one, on every row."""
    counts = df.select(*by, value).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(out))
    return join_on(df, counts, by, "left")


def with_plot_frequency(
    df: DataFrame,
    site: str = "site_code",
    plot: str = "plot",
    taxon: str = "Taxon",
    year: str = "year_trt",
) -> DataFrame:
    """Share of the site's plots in which the taxon occurs in that year."""
    plots = with_distinct_count(df, [site], plot, "nplots")
    occupied = with_distinct_count(plots, [site, taxon, year], plot, "nplot")
    return occupied.withColumn("plotfreq_yr", F.col("nplot") / F.col("nplots"))


def top_one(
    df: DataFrame, by: Sequence[str], value: str, tie_order: Sequence[Column]
) -> DataFrame:
    """The row with the largest value of each group; ties go to the first in order."""
    return first_per_key(df, by, [F.col(value).desc_nulls_last(), *tie_order])


def top_ties(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """All rows that share the largest value of their group."""
    best = df.groupBy(*by).agg(F.max(value).alias(value))
    return keep_matching(df, best.filter(F.col(value).isNotNull()), [*by, value])


def value_at_max(
    df: DataFrame, by: Sequence[str], value: str, columns: Sequence[str]
) -> DataFrame:
    """Values of ``columns`` at the group's largest ``value``, one row per group."""
    return df.groupBy(*by).agg(*[F.max_by(name, value).alias(name) for name in columns])


def in_tied_groups(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of groups that have more than one row."""
    tied = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    return keep_matching(df, tied, by)


def rebreak_ties(
    ties: DataFrame, later: DataFrame, by: Sequence[str], keys: Sequence[str], value: str
) -> DataFrame:
    """Among tied rows, those with the largest later value; a missing later value loses.

    A group in which no row has a later value stays as it is.
    """
    joined = join_on(ties, later.select(*keys, value), keys, "left")
    best = joined.groupBy(*by).agg(F.max(value).alias(value))
    return keep_matching(joined, best, [*by, value])


def with_change_from_first(df: DataFrame, value: str, position: str, out: str) -> DataFrame:
    """Difference to the value of the first row by position."""
    first = df.agg(F.min_by(value, position).alias("__base"))
    return join_on(df, first, [], "left").withColumn(
        out, F.col(value) - F.col("__base")
    ).drop("__base")

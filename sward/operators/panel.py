"""Baseline cohorts, gap-filled panels and follow-up tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sward.operators.joins import drop_matching, first_per_key, keep_keys, left_lookup
from sward.operators.ranking import top_ties, with_group_max
from sward.scale import join_on

PLOT = ("site_code", "plot")


def baseline_cohort(
    ranked: DataFrame, by: Sequence[str] = PLOT, year: str = "year_trt", value: str = "max_cover"
) -> DataFrame:
    """Leading taxa of each plot in year 0 with their starting cover; ties kept."""
    start = ranked.filter(F.col(year) == 0)
    return top_ties(start, by, value).select(
        *by,
        "Taxon",
        F.col("cover").alias("initial_rel_cover"),
        F.col(value).alias("initial_abs_cover"),
    )


def complete_panel(
    df: DataFrame,
    by: Sequence[str],
    entity: Sequence[str],
    year: str,
    last_year: str,
    fill: dict[str, object],
) -> DataFrame:
    """Every year from 0 to ``last_year`` for every entity, filled where absent.

    An entity is a distinct (by, entity, last_year). Rows outside the range stay.
    Columns listed in ``fill`` lose their nulls, also those already there; other
    columns stay null in added rows.
    """
    keys = [*by, *entity, last_year]
    skeleton = (
        df.select(*keys)
        .distinct()
        .withColumn(year, F.explode(F.sequence(F.lit(0), F.col(last_year).cast("int"))))
        .withColumn(year, F.col(year).cast(df.schema[year].dataType))
    )
    right = df.withColumnsRenamed({key: f"__r_{key}" for key in [*keys, year]})
    condition = F.lit(True)
    for key in [*keys, year]:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    # a row absent from the skeleton brings its own keys; a null year marks no row
    joined = skeleton.withColumn("__made", F.lit(True)).join(right, condition, "full")
    columns = []
    for name in df.columns:
        if name in keys or name == year:
            made = F.when(F.col("__made"), F.col(name)).otherwise(F.col(f"__r_{name}"))
            columns.append(made.alias(name))
        elif name in fill:
            filled = F.coalesce(F.col(name), F.lit(fill[name]).cast(df.schema[name].dataType))
            columns.append(filled.alias(name))
        else:
            columns.append(F.col(name))
    return joined.select(*columns)


def empty_periods(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys whose values sum to zero."""
    return df.groupBy(*keys).agg(F.sum(value).alias("total")).filter(F.col("total") == 0)


def drop_empty_periods(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Remove the site-years that were never sampled."""
    return drop_matching(df, empty_periods(df, keys, value), keys)


def eligible_series(
    df: DataFrame, min_length: int, site: str = "site_code", year: str = "year_trt"
) -> DataFrame:
    """Rows of sites followed for at least ``min_length`` years, with ``max_year``."""
    return with_group_max(df, [site], year, "max_year").filter(F.col("max_year") >= min_length)


def follow_up(
    cohort: DataFrame,
    panel: DataFrame,
    traits: DataFrame,
    sites: DataFrame,
    plots: DataFrame,
    treatments: Sequence[str],
) -> DataFrame:
    """Cohort, its panel, traits, site and plot covariates in one table."""
    keys = [*PLOT, "Taxon"]
    joined = left_lookup(cohort, panel, keys)
    joined = left_lookup(joined, traits, keys)
    joined = left_lookup(joined, sites, ["site_code"])
    joined = left_lookup(joined, plots, list(PLOT))
    return joined.filter(F.col("trt").isin(list(treatments)))


def unit_summary(
    meta: DataFrame,
    sampled: DataFrame,
    richness: DataFrame,
    columns: Sequence[str],
    order: Sequence[Column],
    site: str = "site_code",
    year: str = "year_trt",
) -> DataFrame:
    """One row per sampled site: its last year's metadata and baseline richness."""
    kept = keep_keys(meta, sampled, [site])
    last = with_group_max(kept, [site], year, "max_year").filter(F.col(year) == F.col("max_year"))
    rows = first_per_key(last, [site], order).select(site, "max_year", *columns)
    return join_on(rows, richness, [site], "left")

"""Counts, shares, correlations, exact quantiles and distribution tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sward.scale import join_on, order_statistics


def row_col_count(df: DataFrame) -> DataFrame:
    """Number of rows and columns as a one-row table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("long")
    )


def share_where(part: Column, whole: Column) -> Column:
    """Share of the rows in ``whole`` that are also in ``part``; null without rows."""
    return F.try_divide(F.count_if(part & whole).cast("double"), F.count_if(whole))


def mean_where(condition: Column, value: Column) -> Column:
    """Mean of the rows that satisfy the condition."""
    return F.avg(F.when(condition, value))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; null, not an error, when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.try_divide(F.covar_pop(x, y), spread)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairwise correlations in one pass, as (x, y, r) rows."""
    pairs = list(combinations_with_replacement(columns, 2))
    row = df.agg(
        *[correlation(F.col(a), F.col(b)).alias(f"__r{i}") for i, (a, b) in enumerate(pairs)]
    )
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(
                F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"__r{i}").alias("r"))
            )
    return row.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Exact quantiles by linear interpolation, one row per group.

    A group without any value keeps its row; so does an ungrouped table without rows.
    """
    found = order_statistics(df, by, [value], probs)
    return found.select(*by, *[F.get(value, F.lit(i)).alias(n) for i, n in enumerate(names)])


def with_quantiles(
    df: DataFrame, by: Sequence[str], prob: float, columns: dict[str, str]
) -> DataFrame:
    """One exact quantile of several columns (column to new name) on every row of the group.

    All columns share one summary, one refinement and one join.
    """
    found = order_statistics(df, by, list(columns), [prob])
    named = [F.get(column, F.lit(0)).alias(out) for column, out in columns.items()]
    return join_on(df, found.select(*by, *named), by, "left")


def five_numbers(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Minimum, quartiles and maximum per group: the data of a box plot."""
    names = ["minimum", "lower_quartile", "median", "upper_quartile", "maximum"]
    return quantiles(df, by, value, [0.0, 0.25, 0.5, 0.75, 1.0], names)


def value_range(df: DataFrame, value: str) -> DataFrame:
    """Smallest and largest value."""
    return df.agg(F.min(value).alias("minimum"), F.max(value).alias("maximum"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in equal-width bins over the range; the last bin is closed.

    Without any spread all values are in the first bin.
    """
    bounds = df.agg(
        F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi")
    )
    spread = F.col("__hi") - F.col("__lo")
    raw = F.floor(F.try_divide((F.col(value) - F.col("__lo")) * F.lit(bins), spread))
    binned = join_on(df.filter(F.col(value).isNotNull()), bounds, [], "left").withColumn(
        "bin", F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).cast("long")
    )
    width = F.col("__width")
    return (
        binned.groupBy("bin", "__lo", (spread / F.lit(bins)).alias("__width"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "bin",
            (F.col("__lo") + F.col("bin") * width).alias("bin_from"),
            (F.col("__lo") + (F.col("bin") + 1) * width).alias("bin_to"),
            "n",
        )
    )


def normal_qq(df: DataFrame, value: str, points: int = 99) -> DataFrame:
    """Sample quantiles beside normal quantiles on a regular probability grid."""
    probs = [i / (points + 1.0) for i in range(1, points + 1)]
    names = [f"__q{i}" for i in range(points)]
    sample = quantiles(df, [], value, probs, names)
    normal = NormalDist()
    cells = [
        F.struct(
            F.lit(p).alias("prob"),
            F.lit(normal.inv_cdf(p)).alias("theoretical"),
            F.col(name).alias("sample"),
        )
        for p, name in zip(probs, names)
    ]
    return sample.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def least_squares_line(x: Column, y: Column) -> dict[str, Column]:
    """Slope, intercept and R squared of a simple regression, as aggregates."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return {
        "slope": slope,
        "intercept": F.avg(y) - slope * F.avg(x),
        "r2": F.pow(correlation(x, y), F.lit(2.0)),
    }

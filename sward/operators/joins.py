"""Semi, anti, lookup and recode joins.

No join carries a broadcast hint: adaptive execution broadcasts a side whose
measured size is small and sorts and merges otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sward.scale import join_on


def keep_keys(df: DataFrame, keys_from: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys_from``."""
    return df.join(keys_from.select(*keys).distinct(), list(keys), "left_semi")


def drop_keys(df: DataFrame, keys_from: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``keys_from``; null keys stay."""
    return df.join(keys_from.select(*keys).distinct(), list(keys), "left_anti")


def _null_safe(keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    return condition


def keep_matching(df: DataFrame, keys_from: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``keep_keys``, with a null key matching a null key."""
    right = keys_from.select(*[F.col(key).alias(f"__r_{key}") for key in keys])
    return df.join(right, _null_safe(keys), "left_semi")


def drop_matching(df: DataFrame, keys_from: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``drop_keys``, with a null key matching a null key."""
    right = keys_from.select(*[F.col(key).alias(f"__r_{key}") for key in keys])
    return df.join(right, _null_safe(keys), "left_anti")


def eligible_keys(df: DataFrame, key: str, condition: Column) -> DataFrame:
    """Distinct keys with at least one row that satisfies the condition."""
    return df.filter(condition).select(key).distinct()


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key in the given total order.

    The limit to one row is applied in each map task before the shuffle, so a
    key with very many rows sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__row", F.row_number().over(window))
        .filter(F.col("__row") == 1)
        .drop("__row")
    )


def repeats_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All rows of every key but its first by the order columns.

    Firsts come from the map-side limited window above and are removed by an anti
    join on the order columns, which therefore must be unique within a key.
    """
    firsts = first_per_key(df, keys, [F.col(name) for name in order])
    return drop_matching(df, firsts, [*keys, *order])


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise when a key occurs twice, else return ``df``."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    if not repeated.isEmpty():
        raise ValueError(f"duplicate keys in lookup on {list(keys)}")
    return df


def left_lookup(
    df: DataFrame, lookup: DataFrame, keys: Sequence[str], unique: bool = False
) -> DataFrame:
    """Left join on same-named keys, null matching null; repeated keys fan out."""
    if unique:
        assert_unique(lookup, keys)
    return join_on(df, lookup, keys, "left")


def left_lookup_filled(
    df: DataFrame, lookup: DataFrame, keys: Sequence[str], fill: dict[str, object]
) -> DataFrame:
    """Left join, then replace missing values of the listed columns."""
    joined = left_lookup(df, lookup, keys)
    return joined.withColumns(
        {name: F.coalesce(F.col(name), F.lit(value)) for name, value in fill.items()}
    )


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on all columns the two tables share."""
    shared = [name for name in left.columns if name in right.columns]
    return join_on(left, right, shared, "left")


def recode_names(
    df: DataFrame, fixes: DataFrame, keys: Sequence[str], column: str, new: str
) -> DataFrame:
    """Replace ``column`` by the lookup's ``new`` where the keys match."""
    joined = left_lookup(df, fixes.select(*keys, new), keys)
    return joined.withColumn(column, F.coalesce(F.col(new), F.col(column))).drop(new)


def first_lookup(
    df: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    order: Sequence[Column],
) -> DataFrame:
    """Attach ``columns`` of the first source row of each key."""
    lookup = first_per_key(source, keys, order).select(*keys, *columns)
    return left_lookup(df, lookup, keys)

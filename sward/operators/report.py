"""Report tables: tidied coefficients and tests, reshaped and stacked tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sward.functions.scalar import (
    first_match, p_text_rounded, p_text_signif, round_even, signif,
)

# Text in an effect name and its block in the report; first hit wins.
EFFECT_BLOCKS = [
    ("initial", 2),
    ("lifespan", 3),
    ("provenance", 4),
    ("func", 5),
    ("richness", 6),
    ("MAP_v2", 7),
    ("MAP_VAR_v2", 8),
]


def effect_block(effect: Column, blocks: Sequence[tuple[str, int]] = EFFECT_BLOCKS) -> Column:
    """Report block of an effect name, 1 for effects of the treatments alone."""
    return first_match(effect, list(blocks), 1)


def tidy_coefficients(
    table: DataFrame, blocks: Sequence[tuple[str, int]] = EFFECT_BLOCKS
) -> DataFrame:
    """Coefficient table in report form, sorted by block and original position."""
    return (
        table.withColumns(
            {
                "Estimate": signif(F.col("Value"), 3),
                "Std.Error": signif(F.col("`Std.Error`"), 2),
                "t.value": signif(F.col("`t.value`"), 2),
                "p.value": p_text_signif(F.col("`p.value`")),
                "order": effect_block(F.col("Effect"), blocks),
            }
        )
        .orderBy("order", "position")
        .select("Effect", "Estimate", "`Std.Error`", "DF", "`t.value`", "`p.value`", "order")
    )


def tidy_anova(table: DataFrame) -> DataFrame:
    """Sequential test table in report form."""
    return table.orderBy("position").select(
        "Effect",
        F.concat_ws(",", F.col("numDF").cast("string"), F.col("denDF").cast("string")).alias("DF"),
        round_even(F.col("`F.value`"), 2).alias("F value"),
        p_text_rounded(F.col("`p.value`")).alias("P value"),
    )


def rename_matching(df: DataFrame, contains: str, pattern: str, replacement: str) -> DataFrame:
    """Replace the first ``pattern`` in the names of columns that contain a text."""
    names = [
        name.replace(pattern, replacement, 1) if contains.lower() in name.lower() else name
        for name in df.columns
    ]
    return df.toDF(*names)


def relocate_before(df: DataFrame, column: str, before: str) -> DataFrame:
    """Move a column in front of another."""
    rest = [name for name in df.columns if name != column]
    at = rest.index(before)
    return df.select(*[f"`{name}`" for name in [*rest[:at], column, *rest[at:]]])


def unite(df: DataFrame, out: str, columns: Sequence[str], sep: str) -> DataFrame:
    """Paste columns into one and drop them."""
    pasted = F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])
    return df.withColumn(out, pasted).drop(*columns)


def all_to_text(df: DataFrame) -> DataFrame:
    """Every column as text."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def with_level_order(df: DataFrame, column: str, levels: Sequence[str], out: str) -> DataFrame:
    """Position of an ordered category, from 1; null for a value outside the levels."""
    cases = [F.when(F.col(column) == level, F.lit(i)) for i, level in enumerate(levels, 1)]
    return df.withColumn(out, F.coalesce(*cases))


def stack_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column absent from one is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)

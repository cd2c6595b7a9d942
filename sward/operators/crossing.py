"""Threshold crossings of curves and the persistence report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sward.functions.scalar import TREATMENTS, number_text
from sward.scale import join_on


def first_below(value: Column, time: Column, cutoff: Column) -> Column:
    """First time the value is under the cutoff, the last time when it never is.

    An aggregate over a group, so a curve needs no ordering and no window.
    """
    return F.coalesce(F.min(F.when(value < cutoff, time)), F.max(time))


def crossing_times(
    curve: DataFrame,
    by: Sequence[str],
    time: str,
    cutoff: Column,
    mean: str = "mean_btrans",
    upper: str = "upper_btrans",
    lower: str = "lower_btrans",
) -> DataFrame:
    """Crossing times of the mean and of both interval curves, one row per group."""
    return curve.groupBy(*by).agg(
        first_below(F.col(mean), F.col(time), cutoff).alias("mean_time"),
        first_below(F.col(upper), F.col(time), cutoff).alias("upper_time"),
        first_below(F.col(lower), F.col(time), cutoff).alias("lower_time"),
    )


def pivot_treatments(
    df: DataFrame, by: Sequence[str], value: str, treatments: Sequence[str] = tuple(TREATMENTS)
) -> DataFrame:
    """Treatments to columns, in report order."""
    return df.groupBy(*by).pivot("trt", list(treatments)).agg(F.first(value))


def _outside(value: Column, low: Column, high: Column) -> Column:
    return (value > high) | (value < low)


def flag_against_control(
    times: DataFrame, by: Sequence[str], control: str = "Control", mark: str = "*"
) -> DataFrame:
    """Report text of each mean time, marked when the control's is outside its interval.

    The control itself is never marked. Adds ``text``.
    """
    base = times.filter(F.col("trt") == control).select(
        *by, F.col("mean_time").alias("__control")
    )
    flagged = _outside(F.col("__control"), F.col("lower_time"), F.col("upper_time"))
    marked = F.when((F.col("trt") != control) & flagged, F.lit(mark)).otherwise(F.lit(""))
    joined = join_on(times, base, by, "left")
    return joined.withColumn(
        "text", F.concat(number_text(F.col("mean_time")), marked)
    ).drop("__control")


def flag_against_level(times: DataFrame, base_level: Column, mark: str = "†") -> DataFrame:
    """Mark ``text`` of other levels whose mean is outside the base level's interval.

    ``base_level`` is the condition that holds for rows of the base level; levels
    are compared within a treatment.
    """
    base = times.filter(base_level).select(
        "trt", F.col("lower_time").alias("__low"), F.col("upper_time").alias("__high")
    )
    joined = join_on(times, base, ["trt"], "left")
    flagged = ~base_level & _outside(F.col("mean_time"), F.col("__low"), F.col("__high"))
    marked = F.when(flagged, F.lit(mark)).otherwise(F.lit(""))
    return joined.withColumn("text", F.concat("text", marked)).drop("__low", "__high")

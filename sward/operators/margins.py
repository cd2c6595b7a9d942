"""Marginal means of a fitted model over a grid of predictor values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sward.functions.distributions import studentised_range_upper, t_quantile, t_two_sided
from sward.functions.scalar import TREATMENTS, invlogit, treatment_label
from sward.operators.describe import quantiles
from sward.operators.design import Design
from sward.operators.mixed import MixedModel


def year_steps(last: int, per_year: int = 1) -> list[float]:
    """Times from 0 to ``last`` in equal steps, each the nearest double."""
    return [i / per_year for i in range(last * per_year + 1)]


def covariate_levels(
    df: DataFrame, column: str, low: float = 0.05, high: float = 0.95
) -> DataFrame:
    """Low and high quantile of a covariate, one row."""
    return quantiles(df, [], column, [low, high], ["low", "high"])


def reference_grid(
    df: DataFrame,
    model: MixedModel | Design,
    at: dict[str, Sequence[float]],
    factors: Sequence[str] = (),
    treatments: bool = True,
) -> DataFrame:
    """Grid of predictor values for the model's variables.

    Covariates in ``at`` take the listed values, NPK and Fence both of theirs, the
    listed factors all their levels; any other covariate stays at its mean over
    ``df``. Factors not listed are left out and later averaged.
    """
    design = model if isinstance(model, Design) else model.design
    others = [
        v for v in design.variables
        if v not in design.factors and v not in at and v not in ("NPK", "Fence")
    ]
    # one row of means, widened value by value; the grid's size is set by ``at``
    grid = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.avg(v).alias(v) for v in others])
    if treatments:
        codes = [
            F.struct(F.lit(float(a)).alias("NPK"), F.lit(float(b)).alias("Fence"))
            for a, b in TREATMENTS.values()
        ]
        grid = grid.withColumn("__code", F.explode(F.array(*codes))).select("*", "__code.*")
        grid = grid.drop("__code")
    for name in factors:
        levels = F.array(*[F.lit(level) for level in design.factors[name]])
        grid = grid.withColumn(name, F.explode(levels))
    for name, values in at.items():
        points = F.array(*[F.lit(float(v)) for v in values])
        grid = grid.withColumn(name, F.explode(points))
    return grid.drop("__rows")


def _interval(model: MixedModel, level: float):
    """Multiplier by degrees of freedom; there are only a few distinct values."""
    table = {float(d): t_quantile(0.5 + level / 2.0, float(d)) for d in set(model.df)}

    def estimate(x: np.ndarray) -> tuple[np.ndarray, ...]:
        mean = x @ model.beta
        error = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, model.cov, x), 0.0))
        used = np.where(np.abs(x) > 0.0, model.df[None, :], np.inf).min(axis=1)
        width = np.array([table.get(d, np.nan) for d in used]) * error
        return mean, error, used, mean - width, mean + width

    return estimate


class _Plain:
    """What a task needs from a model; the Spark tables stay on the driver."""

    def __init__(self, model: MixedModel):
        self.design, self.beta, self.cov, self.df = (
            model.design, model.beta, model.cov, model.df,
        )


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def marginal_means(grid: DataFrame, model: MixedModel, level: float = 0.95) -> DataFrame:
    """Add ``emmean``, ``SE``, ``df``, ``lower_CL`` and ``upper_CL`` to every grid row."""
    plain = _Plain(model)
    estimate = _interval(plain, level)
    names = ["emmean", "SE", "df", "lower_CL", "upper_CL"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.copy()
            for name, values in zip(names, estimate(plain.design.matrix(batch))):
                out[name] = values
            yield out

    return grid.mapInPandas(score, _schema(grid) + "".join(f", {n} double" for n in names))


def contrasts(grid: DataFrame, model: MixedModel) -> DataFrame:
    """Pairwise differences between treatments at each other grid value.

    The grid is built without treatments; the six pairs are a fixed list. ``p_value`` is adjusted
    for the pairs of one grid value by Tukey's method, ``p_single`` is that of one comparison. A pair
    that the model cannot tell apart has neither.
    """
    plain = _Plain(model)
    pairs = list(combinations(TREATMENTS, 2))
    names = ["contrast", "estimate", "SE", "df", "t_ratio", "p_value", "p_single"]

    def codes(batch: pd.DataFrame, label: str) -> np.ndarray:
        npk, fence = TREATMENTS[label]
        return plain.design.matrix(batch.assign(NPK=float(npk), Fence=float(fence)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, second in pairs:
                x = codes(batch, first) - codes(batch, second)
                value = x @ plain.beta
                error = np.sqrt(np.einsum("ij,jk,ik->i", x, plain.cov, x))
                used = np.where(np.abs(x) > 0.0, plain.df[None, :], np.inf).min(axis=1)
                ratio = np.divide(value, error, out=np.full(len(value), np.nan), where=error > 0.0)
                single = [t_two_sided(t, d) for t, d in zip(ratio, used)]
                # the range of all means, in units of one mean's error
                q = [float(x) for x in np.abs(ratio) * np.sqrt(2.0)]
                adjusted = [studentised_range_upper(t, len(TREATMENTS), float(d)) for t, d in zip(q, used)]
                out = batch.copy()
                label = f"{first} - {second}"
                for name, values in zip(names, [label, value, error, used, ratio, adjusted, single]):
                    out[name] = values
                yield out

    schema = _schema(grid) + ", contrast string" + "".join(f", {n} double" for n in names[1:])
    return grid.mapInPandas(score, schema)


def back_transform(means: DataFrame) -> DataFrame:
    """Inverse logit of the mean and both limits, and the treatment name."""
    return means.withColumns(
        {
            "mean_btrans": invlogit(F.col("emmean")),
            "upper_btrans": invlogit(F.col("upper_CL")),
            "lower_btrans": invlogit(F.col("lower_CL")),
            "trt": treatment_label(F.col("NPK"), F.col("Fence")),
        }
    )

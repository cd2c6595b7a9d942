"""Tables and row-level results of a fitted mixed model."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sward.functions.distributions import f_upper, t_two_sided
from sward.operators.design import INTERCEPT, Design
from sward.operators.mixed import (
    GroupSums, MixedModel, _intercept, estimable, fit_designs, term_df,
)
from sward.scale import join_on


def coefficient_table(
    spark: SparkSession, model: MixedModel, design: Design | None = None
) -> DataFrame:
    """Estimate, standard error, degrees of freedom, t and p for each effect.

    With ``design`` its effects that the model lacks (see ``estimable``) have rows of nulls.
    """
    place = {name: i for i, name in enumerate(model.design.names)}
    rows = []
    for position, name in enumerate((design or model.design).names, 1):
        if name not in place:
            rows.append((position, name, None, None, None, None, None))
            continue
        i = place[name]
        value, error = float(model.beta[i]), math.sqrt(model.cov[i, i])
        t = value / error
        rows.append(
            (position, name, value, error, float(model.df[i]), t, t_two_sided(t, float(model.df[i])))
        )
    schema = (
        "position int, Effect string, Value double, `Std.Error` double, DF double, "
        "`t.value` double, `p.value` double"
    )
    return spark.createDataFrame(rows, schema)


def anova_table(spark: SparkSession, model: MixedModel) -> DataFrame:
    """Sequential F tests of the terms, each adjusted for those before it."""
    root = np.linalg.cholesky(np.linalg.inv(model.cov)).T
    pieces = root @ model.beta
    dens = term_df(model.design, model.sums)
    rows = []
    for position, term in enumerate(model.design.terms, 1):
        part = [z for z, effect in zip(pieces, model.design.effects) if effect.term == term]
        f = float(np.square(part).sum() / len(part))
        rows.append(
            (position, ":".join(term) or INTERCEPT, len(part), int(dens[term]), f,
             f_upper(f, len(part), dens[term]))
        )
    schema = (
        "position int, Effect string, numDF int, denDF int, `F.value` double, `p.value` double"
    )
    return spark.createDataFrame(rows, schema)


def fixed_part(model: MixedModel) -> Column:
    """Fixed-effect prediction as a column expression."""
    parts = [
        F.lit(float(b)) * column for b, column in zip(model.beta, model.design.columns())
    ]
    return reduce(lambda a, b: a + b, parts)


def r_squared(df: DataFrame, model: MixedModel) -> DataFrame:
    """Marginal and conditional R squared as one row."""
    random = float(model.ratios.sum() * model.sigma2)
    fixed = F.col("__fixed")
    total = fixed + F.lit(random + model.sigma2)
    spread = df.select(fixed_part(model).alias("__x")).agg(F.var_samp("__x").alias("__fixed"))
    return spread.select((fixed / total).alias("R2m"), ((fixed + F.lit(random)) / total).alias("R2c"))


def drop_family_table(
    spark: SparkSession, sums: GroupSums, families: dict[str, str], method: str = "REML"
) -> DataFrame:
    """AIC of the full model and of the model without each predictor family.

    ``families`` maps a report label to the predictor that is dropped with all its
    interactions. All fits share the collected sums and every round of trials. Columns
    that depend on earlier ones are left out of each and count for no parameter.
    """
    designs = [sums.design, *[sums.design.without(name) for name in families.values()]]
    models = fit_designs(sums, [estimable(sums, design) for design in designs], method)
    return aic_table(spark, dict(zip(["Full Model", *families], models)))


def aic_table(spark: SparkSession, models: dict[str, MixedModel]) -> DataFrame:
    """AIC and its difference to the first model, to one decimal."""
    values = [(i, label, model.aic()) for i, (label, model) in enumerate(models.items(), 1)]
    table = spark.createDataFrame(values, "position int, Predictor string, AIC double")
    return table.select(
        "position", "Predictor", F.bround("AIC", 1).alias("AIC"),
        F.bround(F.col("AIC") - F.lit(values[0][2]), 1).alias("deltaAIC"),
    )


def random_effects(model: MixedModel) -> dict[str, DataFrame]:
    """Predicted random intercepts per level, outermost first, as ``effect``.

    Residual sums are weighted upwards as in the fit, then each level is corrected
    by the effects of the levels around it.
    """
    groups, ratios = model.groups, [float(r) for r in model.ratios]
    position = {name: i for i, name in enumerate(model.sums.design.names)}
    columns = [position[name] for name in model.design.names]
    # the group sums are about the columns' means
    centred = model.sums.about_means(model.beta, columns)
    residual = reduce(
        lambda a, b: a - b,
        [F.lit(float(b)) * F.col(f"z{i}") for b, i in zip(centred, columns)],
        F.col(f"z{model.sums.width - 1}"),
    )
    level = model.sums.inner.select(*groups, F.col("n").cast("double").alias("w"), residual.alias("t"))
    levels = [level]
    for depth in range(len(groups) - 1, 0, -1):
        scale = F.lit(1.0) / (F.lit(1.0) + F.lit(ratios[depth]) * F.col("w"))
        level = level.groupBy(*groups[:depth]).agg(
            F.sum(F.col("w") * scale).alias("w"), F.sum(F.col("t") * scale).alias("t")
        )
        levels.insert(0, level)
    results: dict[str, DataFrame] = {}
    above: DataFrame | None = None
    for depth, (group, level) in enumerate(zip(groups, levels), 1):
        ratio = F.lit(ratios[depth - 1])
        known = F.lit(0.0)
        if above is not None:
            level = join_on(level, above, groups[: depth - 1], "left")
            known = F.col("__above")
        effect = ratio * (F.col("t") - F.col("w") * known) / (F.lit(1.0) + ratio * F.col("w"))
        solved = level.select(*groups[:depth], known.alias("__known"), effect.alias("effect"))
        results[group] = solved.select(*groups[:depth], "effect")
        above = solved.select(*groups[:depth], (F.col("__known") + F.col("effect")).alias("__above"))
    return results


def with_fitted(df: DataFrame, model: MixedModel) -> DataFrame:
    """Add ``fixed``, ``fitted``, ``residual`` and ``pearson`` to the model rows."""
    rows = df.withColumn("fixed", fixed_part(model))
    total = F.col("fixed")
    for depth, (group, effects) in enumerate(random_effects(model).items(), 1):
        name = f"__b_{group}"
        rows = join_on(
            rows, effects.withColumnRenamed("effect", name), model.groups[:depth], "left"
        )
        total = total + F.col(name)
    rows = rows.withColumn("fitted", total).drop(*[f"__b_{g}" for g in model.groups])
    residual = F.col(model.sums.response) - F.col("fitted")
    return rows.withColumns(
        {"residual": residual, "pearson": residual / F.lit(math.sqrt(model.sigma2))}
    )


def with_leverage(df: DataFrame, sums: GroupSums, design: Design | None = None) -> DataFrame:
    """Add the diagonal of the least-squares hat matrix as ``leverage``.

    Columns that depend on others change nothing: a pivoted Cholesky factorisation of the
    scaled cross-products picks the columns that span the design.
    """
    design = design or sums.design
    index = np.array([sums.design.names.index(name) for name in design.names])
    at = _intercept(sums.design)
    moved = at in index
    gram = (sums.centred if moved else sums.gram)[np.ix_(index, index)]
    shift = sums.shift[index] if moved else np.zeros(len(index))
    kept = independent_columns(gram)
    inverse = _inverse(gram[np.ix_(kept, kept)])
    columns = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = (design.matrix(batch) - shift)[:, kept]
            out = batch[columns].copy()
            out["leverage"] = np.einsum("ij,jk,ik->i", x, inverse, x, optimize=True)
            yield out

    return df.mapInPandas(score, f"{schema}, leverage double")


def independent_columns(gram: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Positions of columns that span all, from their cross-products, in ascending order.

    Pivoted Cholesky: each step takes the column with most left over, as a share of its own
    square sum, and removes it from the others; what is below ``tolerance`` depends on those taken.
    """
    scale = np.sqrt(np.diag(gram))
    scale = np.where(scale > 0.0, scale, 1.0)
    rest = gram / np.outer(scale, scale)
    taken: list[int] = []
    while len(taken) < len(gram):
        left = np.diag(rest).copy()
        left[taken] = 0.0
        best = int(left.argmax())
        if left[best] <= tolerance:
            break
        rest = rest - np.outer(rest[:, best], rest[best]) / rest[best, best]
        taken.append(best)
    return np.array(sorted(taken), dtype=int)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.diag(matrix))
    return np.linalg.inv(matrix / np.outer(scale, scale)) / np.outer(scale, scale)


def variance_table(spark: SparkSession, model: MixedModel) -> DataFrame:
    """Variance of each random level and of the residual."""
    rows = [(name, float(value)) for name, value in model.variances.items()]
    return spark.createDataFrame(rows, "component string, variance double")


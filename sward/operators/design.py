"""Fixed-effects design of factorial models as column expressions.

A design is a list of crossed variable groups. Each group is expanded to all its
main effects and interactions; terms are ordered by size, then by appearance.
Numeric variables enter as they are, factors as 0/1 columns for every level but
the first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = "(Intercept)"


@dataclass(frozen=True)
class Effect:
    """One design column: a product of variables, factors at a given level."""

    term: tuple[str, ...]
    levels: tuple[str | None, ...]

    @property
    def name(self) -> str:
        if not self.term:
            return INTERCEPT
        return ":".join(v + (level or "") for v, level in zip(self.term, self.levels))


@dataclass(frozen=True)
class Design:
    """Effects of a factorial model in report order, the intercept first."""

    effects: tuple[Effect, ...]
    factors: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [effect.name for effect in self.effects]

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for effect in self.effects for v in effect.term))

    @property
    def terms(self) -> list[tuple[str, ...]]:
        return list(dict.fromkeys(effect.term for effect in self.effects))

    def without(self, *variables: str) -> Design:
        """The design without the variables and all their interactions."""
        kept = tuple(e for e in self.effects if not set(variables) & set(e.term))
        return Design(kept, {k: v for k, v in self.factors.items() if k not in variables})

    def columns(self) -> list[Column]:
        """Design columns as DataFrame expressions."""
        return [_column(effect) for effect in self.effects]

    def matrix(self, frame: pd.DataFrame) -> np.ndarray:
        """Design matrix of a batch of rows.

        A factor that the frame lacks is averaged over its levels with equal weight.
        """
        size = len(frame)
        parts: dict[tuple[str, str | None], np.ndarray] = {}
        for effect in self.effects:
            for key in zip(effect.term, effect.levels):
                if key in parts:
                    continue
                variable, level = key
                if level is None:
                    parts[key] = frame[variable].to_numpy(dtype=float)
                elif variable in frame:
                    parts[key] = (frame[variable] == level).to_numpy(dtype=float)
                else:
                    parts[key] = np.full(size, 1.0 / len(self.factors[variable]))
        matrix = np.ones((size, len(self.effects)))
        for i, effect in enumerate(self.effects):
            for key in zip(effect.term, effect.levels):
                matrix[:, i] *= parts[key]
        return matrix


def _column(effect: Effect) -> Column:
    if not effect.term:
        return F.lit(1.0)
    parts = [
        F.col(v).cast("double") if level is None
        else F.when(F.col(v).isNotNull(), (F.col(v) == level).cast("double"))
        for v, level in zip(effect.term, effect.levels)
    ]
    return reduce(lambda a, b: a * b, parts)


def factorial(
    crossings: Sequence[Sequence[str]], factors: dict[str, Sequence[str]] | None = None
) -> Design:
    """Design with every main effect and interaction within each crossing."""
    factors = {name: tuple(levels) for name, levels in (factors or {}).items()}
    order = list(dict.fromkeys(v for crossing in crossings for v in crossing))
    terms: list[tuple[str, ...]] = []
    for crossing in crossings:
        grown: list[tuple[str, ...]] = []
        for variable in crossing:
            grown += [(variable,)] + [(*term, variable) for term in grown]
        terms += [tuple(sorted(term, key=order.index)) for term in grown]
    ordered = sorted(dict.fromkeys(terms), key=len)
    effects = [Effect((), ())]
    for term in ordered:
        choices = [factors[v][1:] if v in factors else (None,) for v in term]
        # the first factor of a term varies fastest
        for levels in product(*reversed(choices)):
            effects.append(Effect(term, tuple(reversed(levels))))
    return Design(tuple(effects), factors)


def design_matrix(df: DataFrame, design: Design, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns and the design as one array column ``x``."""
    return df.select(*keep, F.array(*design.columns()).alias("x"))

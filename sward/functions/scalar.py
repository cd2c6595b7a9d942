"""Scalar transforms: text pieces, rounding, link functions, treatment codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sward.functions.predicates import ifelse, ifelse_in

# Treatment labels with their (NPK, Fence) codes, in report order.
TREATMENTS = {
    "Control": (0, 0),
    "Fence": (0, 1),
    "NPK": (1, 0),
    "NPK+Fence": (1, 1),
}


def substr_between(column: Column, start: int, stop: int) -> Column:
    """Characters ``start`` to ``stop``, both included, counted from 1."""
    return F.substring(column, start, stop - start + 1)


def paste(*columns: Column, sep: str = " ") -> Column:
    """Concatenate as text; a missing value is written as NA."""
    parts = [F.coalesce(column.cast("string"), F.lit("NA")) for column in columns]
    return F.concat_ws(sep, *parts)


def number_text(column: Column) -> Column:
    """A number as text, whole numbers without a decimal part."""
    return F.regexp_replace(column.cast("string"), r"\.0$", "")


def signif(column: Column, digits: int) -> Column:
    """Round to ``digits`` significant digits."""
    power = F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(column)))
    factor = F.pow(F.lit(10.0), power)
    return F.when(column == 0, F.lit(0.0)).otherwise(F.bround(column * factor, 0) / factor)


def round_even(column: Column, digits: int) -> Column:
    """Round half to even."""
    return F.bround(column, digits)


def p_text_rounded(p: Column, digits: int = 3) -> Column:
    """P value as text after decimal rounding; zero becomes ``< 0.001``."""
    rounded = F.bround(p, digits)
    return ifelse(rounded == 0, "< 0.001", rounded.cast("string"))


def p_text_signif(p: Column, digits: int = 2) -> Column:
    """P value as text after significant rounding; up to 0.001 becomes ``< 0.001``."""
    rounded = signif(p, digits)
    return ifelse(rounded <= 0.001, "< 0.001", rounded.cast("string"))


def clamp_unit(p: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """Move exact 0 and 1 inside the open interval; other values stay."""
    return F.when(p == 1, F.lit(high)).when(p == 0, F.lit(low)).otherwise(p)


def logit(p: Column) -> Column:
    return F.ln(p / (F.lit(1.0) - p))


def invlogit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def arcsine_root(p: Column) -> Column:
    return F.asin(F.sqrt(p))


def arcsine_root_inverse(x: Column) -> Column:
    return F.pow(F.sin(x), F.lit(2.0))


def percent_change(value: Column, base: Column) -> Column:
    """``-100 (1 - value/base)``; null when the base is zero."""
    return F.lit(-100.0) * (F.lit(1.0) - F.try_divide(value, base))


def percent_change_text(value: Column, base: Column, digits: int = 3) -> Column:
    """The value followed by its percent change in brackets."""
    change = signif(percent_change(value, base), digits)
    return F.concat(value.cast("string"), F.lit(" ("), change.cast("string"), F.lit("%)"))


def npk_flag(trt: Column) -> Column:
    return ifelse_in(trt, [t for t, (npk, _) in TREATMENTS.items() if npk], 1, 0)


def fence_flag(trt: Column) -> Column:
    return ifelse_in(trt, [t for t, (_, fence) in TREATMENTS.items() if fence], 1, 0)


def treatment_label(npk: Column, fence: Column) -> Column:
    """Treatment name of an (NPK, Fence) pair; null for any other pair."""
    cases = [
        F.when((npk == code[0]) & (fence == code[1]), F.lit(name))
        for name, code in TREATMENTS.items()
    ]
    return F.coalesce(*cases)


def relabel(column: Column, replacements: dict[str, str]) -> Column:
    """Regex replacements applied one after the other."""
    return reduce(
        lambda text, item: F.regexp_replace(text, item[0], item[1]), replacements.items(), column
    )


def first_match(column: Column, patterns: list[tuple[str, int]], default: int) -> Column:
    """Number of the first pattern found in the text, else ``default``."""
    cases = [F.when(column.rlike(pattern), F.lit(number)) for pattern, number in patterns]
    return F.coalesce(*cases, F.lit(default))

"""Cleaning by rule tables: exclusions, value repairs, merges, attribute overrides."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sward.functions.predicates import ifelse, not_in
from sward.operators.describe import with_quantiles
from sward.scale import join_on, small_frame

_TESTS = {
    "==": lambda column, value: column == value,
    ">": lambda column, value: column > value,
    "<": lambda column, value: column < value,
}


def exclude_values(df: DataFrame, rules: Sequence[tuple[str, object]]) -> DataFrame:
    """Drop rows by (column, value) rules; rows with a null stay."""
    by_column: dict[str, list] = {}
    for column, value in rules:
        by_column.setdefault(column, []).append(value)
    return reduce(
        lambda frame, item: frame.filter(not_in(F.col(item[0]), item[1])), by_column.items(), df
    )


def repair_values(df: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Overwrite values that meet a test, one rule after the other.

    A rule has ``column``, ``op`` (==, >, <), ``match``, ``new`` and optionally
    ``scope``, a mapping of further columns to required values. Later rules see
    the result of earlier ones.
    """
    for rule in rules:
        column = F.col(rule["column"])
        condition = _TESTS[rule["op"]](column, rule["match"])
        for name, value in rule.get("scope", {}).items():
            condition = condition & (F.col(name) == value)
        new = F.lit(rule["new"]).cast(df.schema[rule["column"]].dataType)
        df = df.withColumn(rule["column"], ifelse(condition, new, column))
    return df


def _merge_table(rules: Sequence[dict]) -> dict[tuple[bool, int | None], dict]:
    """Keys of the rules by (scoped to a site, prefix length or None for whole names).

    Each key holds its (rule number, new name) pairs, in order.
    """
    table: dict[tuple[bool, int | None], dict] = {}
    for number, rule in enumerate(rules):
        place = rule.get("site")
        names = [rule["prefix"]] if "prefix" in rule else rule["names"]
        kind = (place is not None, len(rule["prefix"]) if "prefix" in rule else None)
        for name in dict.fromkeys(names):
            key = (name,) if place is None else (name, place)
            table.setdefault(kind, {}).setdefault(key, []).append((number, rule["new"]))
    return table


def _merge_depth(rules: Sequence[dict]) -> int:
    """Most rules that can rename one row after each other."""
    places: dict[tuple[int | None, str], list] = {}
    lengths = {len(rule["prefix"]) for rule in rules if "prefix" in rule}
    depth = [1] * len(rules)
    for number in reversed(range(len(rules))):
        rule = rules[number]
        new, place = rule["new"], rule.get("site")
        found = [places.get((None, new), [])]
        found += [places.get((n, new[:n]), []) for n in lengths if n <= len(new)]
        for later in (item for items in found for item in items):
            other = rules[later]
            if other["new"] != new and (place is None or other.get("site") in (None, place)):
                depth[number] = max(depth[number], 1 + depth[later])
        for name in [rule["prefix"]] if "prefix" in rule else rule["names"]:
            places.setdefault((len(name) if "prefix" in rule else None, name), []).append(number)
    return max(depth, default=0)


def merge_taxa(
    df: DataFrame, rules: Sequence[dict], site: str = "site_code", taxon: str = "Taxon"
) -> DataFrame:
    """Lump names within a site by ``prefix`` or by a ``names`` list.

    Rules apply in order and later ones see the new names of earlier ones. They are held as
    tables joined by name, or by its first letters with one join per length of prefix, so the
    plan grows with the different lengths and with the longest chain of rules that feed each
    other, not with their number. A null name stays null; a null site meets no scoped rule.
    """
    spark = df.sparkSession
    lookups = {
        kind: small_frame(
            spark,
            [(*key, pairs) for key, pairs in held.items()],
            f"__m_name string, {'__m_site string, ' if kind[0] else ''}"
            "__m_pairs array<struct<at:int,new:string>>",
        )
        for kind, held in _merge_table(rules).items()
    }
    columns = df.columns
    df = df.withColumn("__m_last", F.lit(-1))
    for _ in range(_merge_depth(rules)):
        name = F.col(f"`{taxon}`")
        best = []
        for i, ((scoped, length), lookup) in enumerate(lookups.items()):
            pairs = f"__m_pairs{i}"
            condition = F.col("__m_name") == (name if length is None else F.substring(name, 1, length))
            if scoped:
                condition = condition & (F.col("__m_site") == F.col(f"`{site}`").cast("string"))
            df = df.join(lookup.withColumnRenamed("__m_pairs", pairs), condition, "left")
            df = df.drop("__m_name", "__m_site")
            later = F.filter(pairs, lambda p: (p["at"] > F.col("__m_last")) & (p["new"] != name))
            best.append(F.get(later, F.lit(0)))
        hit = F.array_min(F.array_compact(F.array(*best)))
        df = df.withColumn("__m_hit", hit).select(
            *[
                F.coalesce("__m_hit.new", name).alias(c) if c == taxon else F.col(f"`{c}`")
                for c in columns
            ],
            F.coalesce("__m_hit.at", "__m_last").alias("__m_last"),
        )
    return df.drop("__m_last")


def collapse(column: Column, members: Sequence, into) -> Column:
    """``into`` for the listed categories, other values unchanged."""
    return F.when(column.isin(list(members)), F.lit(into)).otherwise(column)


def override_attributes(
    df: DataFrame,
    rules: Sequence[tuple[str, str | None, str, str]],
    site: str = "site_code",
    taxon: str = "Taxon",
) -> DataFrame:
    """Set attributes of a taxon, or of a taxon at one site, from keyed rules.

    Rules are (taxon, site or None, column, value). The rule naming a site wins
    over the general one, and the last rule for a key wins over earlier ones.
    """
    columns = list(dict.fromkeys(column for _, _, column, _ in rules))
    levels: dict[bool, dict] = {True: {}, False: {}}
    for name, place, column, value in rules:
        key = (name, place) if place is not None else (name,)
        levels[place is not None].setdefault(key, {})[column] = value
    for scoped, keys in ((False, [taxon]), (True, [taxon, site])):
        if not levels[scoped]:
            continue
        rows = [
            (*key, *[values.get(c) for c in columns]) for key, values in levels[scoped].items()
        ]
        names = [f"__new_{i}" for i in range(len(columns))]
        schema = ", ".join(f"`{c}` string" for c in [*keys, *names])
        joined = join_on(df, small_frame(df.sparkSession, rows, schema), keys, "left")
        df = joined.withColumns(
            {c: F.coalesce(F.col(new), F.col(c)) for c, new in zip(columns, names)}
        ).drop(*names)
    return df


def append_copies(df: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Append copies of selected rows with some columns overwritten.

    A rule has ``select`` (column to value; a value ending in * is a prefix) and
    ``set`` (column to new value). Later rules see the copies of earlier ones. A rule
    turns each row into one or two, so the input is read once however many rules there are.
    """
    columns = df.columns
    for rule in rules:
        condition = F.lit(True)
        for name, value in rule["select"].items():
            if isinstance(value, str) and value.endswith("*"):
                condition = condition & F.col(name).startswith(value[:-1])
            else:
                condition = condition & (F.col(name) == value)
        new = {n: F.lit(v).cast(df.schema[n].dataType) for n, v in rule["set"].items()}
        row = F.struct(*[F.col(f"`{c}`") for c in columns])
        copy = F.struct(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in columns])
        rows = F.when(condition, F.array(row, copy)).otherwise(F.array(row))
        df = df.select(F.explode(rows).alias("__row")).select("__row.*")
    return df


def sentinel_audit(
    df: DataFrame, columns: Sequence[str], sentinels: Sequence[str], taxon: str = "Taxon"
) -> DataFrame:
    """Rows and distinct taxa that still carry a sentinel, per column and sentinel."""
    long = df.select(
        F.col(taxon).alias("__taxon"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                    for c in columns
                ]
            )
        ).alias("__cell"),
    ).select("__taxon", "__cell.column", "__cell.value")
    counts = (
        long.filter(F.col("value").isin(list(sentinels)))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("__taxon").alias("n_taxa"))
    )
    return counts.withColumnRenamed("value", "sentinel")


def low_high_label(
    df: DataFrame, labels: dict[str, tuple[str, str, str]], by: Sequence[str] = ("site_code",)
) -> DataFrame:
    """Label each covariate as below its median or not.

    ``labels`` maps a covariate to (new column, label below, label otherwise).
    With ``by`` the medians are taken per group, without it over the whole table.
    """
    medians = {covariate: f"__median_{i}" for i, covariate in enumerate(labels)}
    df = with_quantiles(df, by, 0.5, medians)
    for covariate, (out, low, high) in labels.items():
        df = df.withColumn(out, ifelse(F.col(covariate) < F.col(medians[covariate]), low, high))
    return df.drop(*medians.values())

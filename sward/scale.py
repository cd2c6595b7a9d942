"""Group totals, ranks and order statistics that survive groups of any size.

A window over a group needs the whole group in one task. Totals are therefore aggregated
and joined back; ranks of large groups come from counts by value, dealt by range and summed up
(``rank_levels``); quantiles are bracketed by a mergeable summary and read off the bracketed values
alone (``order_statistics``). The same plan serves every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sward.session import pin

# Rows between two splitters of a group, on average.
RUN_ROWS = 1_000_000
# Rows with one splitter's value are dealt over this many tasks.
TIE_TASKS = 64
# One over the summary's relative rank error. A bracket reaches MARGIN errors to either side;
# groups with no more than MARGIN * ACCURACY rows are bracketed whole.
ACCURACY, MARGIN = 10_000, 4
# A Python rule list up to this length is broadcast.
MAX_BROADCAST_ROWS = 10_000


def small_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A rule list as a DataFrame; broadcast only when its length is within bounds."""
    frame = spark.createDataFrame(list(rows), schema)
    return F.broadcast(frame) if len(rows) <= MAX_BROADCAST_ROWS else frame


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on same-named keys in which a null key matches a null key.

    The result carries the left side's keys once, then the other columns. Without keys the
    right side is one summary row for every left row; the query fails if it has more.
    """
    if not keys:
        row = right.agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct("*")).alias("__row"))
        broken = F.raise_error(F.lit("a join without keys needs one row at most")).cast("long")
        single = F.when(F.col("__n") <= 1, F.col("__n")).otherwise(broken) == 1
        return left.join(F.broadcast(row.filter(single).select("__row.*")), F.lit(True), how)
    renamed = right.withColumnsRenamed({key: f"__r_{key}" for key in keys})
    condition = None
    for key in keys:
        part = F.col(key).eqNullSafe(F.col(f"__r_{key}"))
        condition = part if condition is None else condition & part
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{key}" for key in keys])


def join_totals(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Attach group aggregates to every row: aggregate first, then join back.

    The aggregate combines on the map side, so no task ever holds a group; the
    join has one row per group on its right side and may be split on its left.
    """
    totals = df.groupBy(*by).agg(*[agg.alias(name) for name, agg in aggregates.items()])
    return join_on(df, totals, by, "left")


def _splitters_above(splitters: Column, value: Column) -> Column:
    """How many of the descending ``splitters`` are greater than ``value``, by halving."""
    size = F.coalesce(F.size(splitters), F.lit(0))
    steps = F.ceil(F.log2(size.cast("double") + 1.0)).cast("int")
    start = F.struct(F.lit(0).alias("low"), size.alias("high"))

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        open_span = span["low"] < span["high"]
        above = F.get(splitters, middle) > value
        return F.struct(
            F.when(open_span & above, middle + 1).otherwise(span["low"]).alias("low"),
            F.when(open_span & ~above, middle).otherwise(span["high"]).alias("high"),
        )

    found = F.aggregate(F.array_repeat(F.lit(0), steps), start, halve)["low"]
    return F.when(size == 0, F.lit(0)).otherwise(found)


def with_runs(df: DataFrame, by: Sequence[str], value: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """Add ``__run`` and ``__salt``: rows of a group with larger values are in the same or an earlier run.

    About one row in ``run_rows`` is drawn, and its value splits its group. A run holds the values
    between two splitters, or those equal to one splitter; the latter, and rows without a value, are
    dealt over ``__salt``, as their order does not matter. ``df`` must be a stored table.
    """
    drawn = df.filter(F.col(value).isNotNull()).filter(F.rand(1) < 1.0 / run_rows)
    splitters = pin(
        drawn.groupBy(*by).agg(F.sort_array(F.collect_set(value), asc=False).alias("__splitters"))
    )
    placed = join_on(df, splitters, by, "left")
    above = _splitters_above(F.col("__splitters"), F.col(value))
    placed = placed.withColumn("__above", above)
    tied = F.coalesce(F.get("__splitters", F.col("__above")) == F.col(value), F.lit(False))
    run = F.when(F.col(value).isNotNull(), 2 * F.col("__above") + tied.cast("int"))
    dealt = tied | F.col(value).isNull()
    salt = F.when(dealt, F.pmod(F.spark_partition_id(), F.lit(TIE_TASKS))).otherwise(F.lit(0))
    return placed.withColumns({"__run": run, "__salt": salt}).drop("__splitters", "__above")


def split_by_size(
    rows: DataFrame, by: Sequence[str], run_rows: int = RUN_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Rows of groups that one task may sort, and rows of the others.

    About one row in ``run_rows`` is drawn; its group counts as large. ``rows`` must be a stored table.
    """
    large = pin(rows.filter(F.rand(1) < 1.0 / run_rows).select(*by).distinct())
    renamed = large.withColumnsRenamed({key: f"__r_{key}" for key in by})
    match = F.lit(True)
    for key in by:
        match = match & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    return rows.join(renamed, match, "left_anti"), rows.join(renamed, match, "left_semi")


def rank_whole(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank of groups that one task may sort; rows without a value are dealt over ``__salt``."""
    known = F.col(value).isNotNull()
    salt = F.when(known, F.lit(0)).otherwise(F.pmod(F.spark_partition_id(), F.lit(TIE_TASKS)))
    dealt = df.withColumns({"__run": F.when(known, F.lit(0)), "__salt": salt})
    rank = F.rank().over(Window.partitionBy(*by, "__run", "__salt").orderBy(F.col(value).desc_nulls_last()))
    return dealt.withColumn(out, F.when(known, rank.cast("long"))).drop("__run", "__salt")


def rank_levels(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank of groups of any size: one plus the rows with larger values, counted by value.

    The different values of a group are dealt by range, so a range is a run of the group's order; running
    counts inside runs are shifted by those of the runs before, and every row finds its value's rank by a
    join, which adaptive execution splits where one value has very many rows. ``df`` must be a stored table.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    levels = pin(
        counted.repartitionByRange(*by, F.col(value).desc()).withColumn("__run", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*by).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "__run").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    # pinned: one row per run and group, of a size that is known where the levels meet it
    offsets = pin(
        levels.groupBy(*by, "__run").agg(F.sum("__n").alias("__n")).select(
            *by, "__run", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset")
        )
    )
    above = levels.withColumn("__above", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    placed = join_on(above, offsets, [*by, "__run"], "left")
    ranks = placed.select(*by, value, (F.lit(1) + F.col("__above") + F.col("__offset")).cast("long").alias(out))
    return join_on(df, ranks, [*by, value], "left")


def descending_rank(
    df: DataFrame, by: Sequence[str], value: str, out: str, run_rows: int = RUN_ROWS
) -> DataFrame:
    """Competition rank by ``value``, largest first, as ``out``; null for a null value.

    A group that one task may sort is ranked there; of larger groups the different values are counted and
    ranked in runs. The rows are stored once, since several branches read them.
    """
    small, large = split_by_size(pin(df), by, run_rows)
    columns = [*df.columns, out]
    whole = rank_whole(small, by, value, out).select(*columns)
    return whole.unionByName(rank_levels(large, by, value, out).select(*columns))


def order_statistics(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY
) -> DataFrame:
    """Exact quantiles (linear interpolation) of several columns, all probabilities at once.

    One row per group: the keys and, for every column, an array over ``probs`` named like the column;
    null where the group has no value. A mergeable summary of value counts with a known rank error
    (``percentile_approx``) gives a bracket for every probability. One further pass counts the rows
    between brackets and, inside them, the rows of each value; running counts then locate both
    order statistics next to each quantile. No buffer holds a group's values: what a task sorts is
    one bracket, at most ``2 * MARGIN / accuracy`` of a group's rows, or ``MARGIN * accuracy`` of them.
    """
    by = list(by)
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    sorted_probs = [float(probs[i]) for i in order]
    cells = F.array(
        *[F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)]
    )
    long = pin(df.select(*by, F.explode(cells).alias("__cell")).select(*by, F.col("__cell.column").alias("__column"), F.col("__cell.value").alias("__value")))
    keys = [*by, "__column"]
    margin = MARGIN / accuracy
    reach = [max(0.0, p - margin) for p in sorted_probs] + [min(1.0, p + margin) for p in sorted_probs]
    k = len(sorted_probs)
    summary = long.groupBy(*keys).agg(
        F.count("__value").alias("__size"), F.min("__value").alias("__min"), F.max("__value").alias("__max"),
        F.percentile_approx("__value", reach, accuracy).alias("__reach"),
    )
    short = F.col("__size") <= MARGIN * accuracy

    def bounds(first: int, whole: str) -> Column:
        near = F.slice("__reach", first + 1, k)
        return F.when(short, F.array_repeat(F.col(whole), k)).otherwise(near)

    # extremes are exact in the summary's other columns
    summary = pin(
        summary.withColumns({"__low": bounds(0, "__min"), "__high": bounds(k, "__max")}).drop("__reach", "__min", "__max")
    )
    located = join_on(long.filter(F.col("__value").isNotNull()), summary, keys, "inner")
    # values beyond j brackets are sorted behind those of the brackets before, so (j, value) is the order of values
    beyond = F.size(F.filter("__high", lambda high: high < F.col("__value")))
    located = located.withColumn("__beyond", beyond)
    bracketed = F.get("__low", F.col("__beyond")) <= F.col("__value")
    levels = (
        located.withColumn("__value", F.when(bracketed, F.col("__value")))
        .groupBy(*keys, "__size", "__beyond", "__value").agg(F.count(F.lit(1)).alias("__n"))
    )
    inside = Window.partitionBy(*keys, "__beyond").orderBy(F.col("__value").asc_nulls_first())
    before = Window.partitionBy(*keys).orderBy("__beyond").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        levels.groupBy(*keys, "__beyond").agg(F.sum("__n").alias("__n"))
        .select(*keys, "__beyond", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    )
    running = levels.withColumn("__upto", F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    running = join_on(running, shifts, [*keys, "__beyond"], "inner").withColumn("__upto", F.col("__upto") + F.col("__shift"))
    missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
    known = F.when(F.col("__value").isNotNull(), F.col("__value")).otherwise(missed)
    picks = []
    for i, p in enumerate(sorted_probs):
        position = (F.col("__size") - 1) * F.lit(p)
        for side, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (F.col("__upto") > index) & (F.col("__upto") - F.col("__n") <= index)
            picks.append(F.max(F.when(here, known)).alias(f"__{side}{i}"))
    found = running.groupBy(*keys, "__size").agg(*picks)
    values: list[Column] = []
    for i in range(len(probs)):
        at = order.index(i)
        position = (F.col("__size") - 1) * F.lit(sorted_probs[at])
        low, high = F.col(f"__lo{at}"), F.col(f"__hi{at}")
        # equal neighbours stay as they are, infinite ones included
        weight = position - F.floor(position)
        between = (1.0 - weight) * low + weight * high
        values.append(F.when(low == high, low).otherwise(between))
    solved = found.select(*keys, F.array(*values).alias("__quantiles"))
    complete = join_on(summary.select(*keys), solved, keys, "left")
    blank = F.array(*[F.lit(None).cast("double")] * k)
    per_column = [
        F.coalesce(F.max_by("__quantiles", F.when(F.col("__column") == i, F.lit(1))), blank).alias(c)
        for i, c in enumerate(columns)
    ]
    return complete.groupBy(*by).agg(*per_column)

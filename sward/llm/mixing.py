"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

The rates nearest to one (in relative entropy) that give every source its target number
of words have the form exp(lambda * size), one multiplier per source; capped at the
largest number of copies. The multipliers solve a convex dual. Each Newton round is one
distributed aggregation over a table of (source, size, documents), which has as many rows
as there are different sizes, whatever the number of documents. Rates become whole copies
by carrying the rounding error from document to document inside chunks of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sward.llm.common import prepare
from sward.session import pin

# Fixed values of the contract: weights repeat along the sources, and no document is taken more often.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
# Documents of a source that share one rounding error, on average.
CHUNK = 256
ROUNDS = 60
TOLERANCE = 1e-6
# Rates are rounded, so that the order in which sums were added, which differs between runs, does not show in the copies.
RATE_DIGITS = 6


def word_count(text: Column) -> Column:
    """Words parted by space or the controls 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(histogram: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_docs, source_size, target): shares by weight, capped, excess reshared.

    ``target = min(most * source_size, level * weight)``; the level is read off the sources
    sorted by the level at which each one is full. One row per source passes one task.
    """
    stats = histogram.groupBy("source").agg(
        F.sum("docs").alias("source_docs"), F.sum(F.col("docs") * F.col("size")).alias("source_size")
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy("__full", F.col("source").asc_nulls_last())
    sofar = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        stats.withColumn("__weight", weight).withColumn("__cap", cap)
        .withColumn("__full", F.col("__cap") / F.col("__weight"))
        .withColumn("__total", F.sum("source_size").over(everything))
        .withColumn("__filled", F.coalesce(F.sum("__cap").over(sofar), F.lit(0.0)))
        .withColumn("__open", F.sum("__weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("__level", (F.col("__total") - F.col("__filled")) / F.col("__open"))
        # the first source, in this order, that its level does not fill sets the level of all later ones
        .withColumn("__level", F.min(F.when(F.col("__level") <= F.col("__full"), F.struct("__full", "source", "__level"))).over(everything)["__level"])
    )
    level = F.coalesce(F.col("__level"), F.lit(float("inf")))
    return ranked.select(
        "source", "source_docs", "source_size", F.least(F.col("__cap"), level * F.col("__weight")).alias("target")
    )


def _rate(most: int) -> Column:
    """Tilted rate; the largest document size scales the exponent so that it stays in range."""
    return F.when(F.col("full"), F.lit(float(most))).otherwise(
        F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("scale"), F.log(F.lit(float(most)))))
    )


def _on_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    return left.join(right.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), how).drop("__s")


def multipliers(histogram: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Solve the dual per source by Newton steps kept inside a shrinking bracket.

    Returns ``targets`` with ``multiplier``, ``scale``, ``full``. Raises when the rounds end before
    the taken words are within ``TOLERANCE`` of every reachable target.
    """
    scale = histogram.filter("size > 0").groupBy("source").agg(
        (F.sum(F.col("docs") * F.col("size")) / F.sum("docs")).alias("scale")
    )
    state = pin(_on_source(targets, scale, "left").withColumns(
        {
            "full": F.col("target") >= F.col("source_size") * F.lit(most * (1 - 1e-12)),
            "multiplier": F.lit(0.0), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"),
        }
    ))
    keep = state.columns
    for _ in range(ROUNDS):
        with_rate = _on_source(histogram, state).withColumn("rate", _rate(most))
        words = F.col("docs") * F.col("size") * F.col("rate")
        slope = F.when(F.col("rate") < most * (1 - 1e-9), words * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = with_rate.groupBy("source").agg(F.sum(words).alias("got"), F.sum(slope).alias("slope"))
        gap = F.col("got") - F.col("target")
        at = F.col("multiplier")
        state = pin(
            _on_source(state, sums, "left")
            .withColumn("miss", F.when(F.col("full") | (F.col("target") <= 0) | F.col("got").isNull(), 0.0).otherwise(F.abs(gap) / F.col("target")))
            .withColumn("low", F.when(gap < 0, at).otherwise(F.col("low")))
            .withColumn("high", F.when(gap >= 0, at).otherwise(F.col("high")))
            .withColumn("newton", at - gap / F.when(F.col("slope") > 0, F.col("slope")))
            .withColumn("guard", F.coalesce((F.col("low") + F.col("high")) / 2, F.when(gap < 0, at * 2 + 1).otherwise(at * 2 - 1)))
            .withColumn("next", F.when((F.col("newton") > F.coalesce("low", at - 4)) & (F.col("newton") < F.coalesce("high", at + 4)), F.col("newton")).otherwise(F.col("guard")))
            .withColumn("multiplier", F.when(F.col("miss") > TOLERANCE, F.col("next")).otherwise(at))
            .select(*keep, "miss")
        )
        worst = state.agg(F.max("miss")).first()[0]
        state = state.drop("miss")
        if worst is None or worst <= TOLERANCE:
            return state.drop("low", "high")
    raise RuntimeError(f"no multipliers within {ROUNDS} rounds: worst miss {worst}")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken.

    Null texts have size 0; a null source is a source of its own, ordered last. Documents without
    words have rate 1 and are taken once (0 words). Equal rows are separate documents. A document's
    copies depend on the table alone, so reruns agree. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    sized = pin(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    histogram = pin(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")))
    targets = pin(source_targets(histogram))
    solved = multipliers(histogram, targets)
    # one row per (source, size) carries the rate; the join is on the pair, so a hot source is spread
    worded = _on_source(histogram.filter("size > 0"), solved).select(
        "source", "size", F.round(_rate(MOST_COPIES), RATE_DIGITS).alias("rate")
    )
    totals = targets.select("source", "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("source_docs") / CHUNK)).alias("chunks"))
    # rows alike in id, size and source are counted, then cut into blocks, each rounded as a whole
    alike = sized.groupBy("source", "size", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    blocks = alike.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))).withColumn(
        "rows", F.least(F.lit(CHUNK).cast("long"), F.col("n") - F.col("block") * CHUNK)
    )
    rated = _on_source(blocks, totals).join(
        worded.select(F.col("source").alias("__s"), F.col("size").alias("__z"), "rate"),
        F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")), "left",
    ).drop("__s", "__z").withColumn("rate", F.coalesce("rate", F.lit(1.0)))
    # the error is carried from large to small
    one = F.struct("size", "doc_id", "block", "rows", "rate")
    chunk = F.pmod(F.xxhash64("doc_id", "size", "block"), F.col("chunks"))
    chunks = rated.withColumn("__chunk", chunk).groupBy("source", "__chunk", "source_size", "target").agg(
        F.sort_array(F.collect_list(one), asc=False).alias("__rows")
    )
    kind = "array<struct<size:bigint,doc_id:{0},rows:bigint,rate:double,copies:bigint>>".format(dict(sized.dtypes)["doc_id"])
    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast(kind).alias("done"))

    def step(held, row):
        size, rows, rate = row["size"], row["rows"], row["rate"]
        owed = held["owed"] + rate * size * rows
        copies = F.when(
            size > 0,
            F.least(MOST_COPIES * rows, F.greatest(F.floor(rate) * rows, F.least(F.ceil(rate) * rows, F.round(owed / size)))),
        ).otherwise(rows).cast("long")
        done = F.struct(size.alias("size"), row["doc_id"].alias("doc_id"), rows.alias("rows"), rate.alias("rate"), copies.alias("copies"))
        return F.struct((owed - copies * size).alias("owed"), F.concat(held["done"], F.array(done)).alias("done"))

    done = chunks.select("source", "source_size", "target", F.explode(F.aggregate("__rows", start, step)["done"]).alias("r"))
    # a block's copies are dealt over its rows, one more to the first ones
    each, over = F.floor(F.col("r.copies") / F.col("r.rows")), F.col("r.copies") % F.col("r.rows")
    dealt = F.transform(F.sequence(F.lit(1).cast("long"), F.col("r.rows")), lambda i: (each + (i <= over).cast("long")).cast("int"))
    rows = done.withColumn("copies", F.explode(dealt))
    return rows.select(
        "r.doc_id", "source", "r.size", "source_size", "target", "r.rate", "copies",
        (F.col("copies") * F.col("r.size")).cast("long").alias("taken"),
    )

"""Connected components of an edge table, by union-find inside tasks and label exchange between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sward.session import pin

# Edges that one union-find call takes at most.
BATCH = 200_000


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace edges by (member, smallest member) stars, batch by batch."""
    for part in parts:
        for low in range(0, len(part), BATCH):
            parent: dict[int, int] = {}

            def find(x):
                root = x
                while parent.setdefault(root, root) != root:
                    root = parent[root]
                while parent[x] != root:
                    parent[x], x = root, parent[x]
                return root

            piece = part.iloc[low : low + BATCH]
            for a, b in zip(piece["a"].tolist(), piece["b"].tolist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            pairs = [(x, find(x)) for x in parent if find(x) != x]
            yield pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): root is the least node reachable.

    Every round turns the edges into stars inside tasks, links each node to the least of its neighbours,
    its neighbours to that one, and then skips a step: a node linked to b takes b's least neighbour. It
    ends when every node has one edge, to a node without one. A node with many edges is combined before it is
    shuffled. Raises if the rounds do not suffice.
    """
    state = pin(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        stars = pin(state.mapInPandas(_forest, "a long, b long").distinct())
        low = pin(stars.groupBy("a").agg(F.min("b").alias("low")))
        # an edge (a, b) with b above a's least becomes (b, least); the least edge of each node stays
        joined = stars.join(low.withColumnRenamed("a", "__a"), F.col("a") == F.col("__a"))
        moved = joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        linked = low.select("a", F.col("low").alias("b")).union(moved)
        ahead = low.select(F.col("a").alias("__a"), "low")
        state = pin(
            linked.join(ahead, F.col("b") == F.col("__a"), "left").select("a", F.coalesce("low", "b").alias("b"), F.col("low").isNotNull().alias("skipped"))
            .groupBy("a", "b").agg(F.max("skipped").alias("skipped"))
        )
        unsettled = state.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.max("skipped").alias("skipped")).filter("n > 1 or skipped")
        done = unsettled.isEmpty()
        state = state.drop("skipped")
        if done:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
    raise RuntimeError(f"components did not settle in {rounds} rounds")

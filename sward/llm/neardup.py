"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, union-find.

Texts with one shingle set are one node. A node's bands put it in buckets; inside a bucket no pairs are
listed: every member is first compared, on full sets, with the bucket's hub, the member that meets most
others over all its buckets. Links give components. Where the buckets of one hub still hold several components,
their members are compared across components inside tasks, in blocks of at most BLOCK members, and only links
are given out. Members of the largest component of a block are never compared with one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sward.llm.common import prepare, text_slices
from sward.llm.components import components
from sward.llm.shingles import COMPONENTS, band_keys, shingle_sets, super_minhash
from sward.session import pin

# Shingles of five words unless said otherwise, similarity in percent.
SHINGLE_WORDS = 5
PERCENT = 80
# 25 bands of 5: a pair at the limit is missed with chance (1 - 0.8^5)^25 < 0.0001, closer ones with less.
BAND_ROWS = 5
# Members of one hub's buckets that one task compares.
BLOCK = 4096


def _profile(rows: int, key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set size, two 64-bit digests of the set) of every row."""
    n = np.bincount(row, minlength=rows)
    cut = np.concatenate(([0], np.cumsum(n)))
    digests = []
    for salt in (0x51, 0xC7):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((key ^ np.uint64(salt)) * (key | np.uint64(1)))))
        digests.append(total[cut[1:]] - total[cut[:-1]])
    return n, digests[0].view(np.int64), digests[1].view(np.int64)


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, node, check, bands) per document; node and check identify the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, text in text_slices(batch):
                key, row = shingle_sets(text, words)
                n, node, check = _profile(text.rows, key, row)
                bands = band_keys(super_minhash(key, row, text.rows), BAND_ROWS).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(text.rows + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(n), pa.array(node), pa.array(check), flat],
                    names=["doc_id", "n", "node", "check", "bands"],
                )

    kinds = [T.StructField(name, T.LongType()) for name in ("n", "node", "check")]
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *kinds, T.StructField("bands", T.ArrayType(T.LongType()))]))


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of documents: the sorted set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, text in text_slices(batch):
                key, row = shingle_sets(text, words)
                n, node, _ = _profile(text.rows, key, row)
                cut = np.concatenate(([0], np.cumsum(n)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array([key[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["node", "shingles"]
                )

    return docs.select("text").mapInArrow(run, "node long, shingles binary")


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = [
            len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True))
            for x, y in zip(batch.column("x"), batch.column("y"))
        ]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64())], names=["a", "b", "shared"])


def _across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between components inside each (center, low, high); rows come sorted by these."""
    held: list[tuple] = []

    def links(group: list[tuple]) -> tuple[list[int], list[int]]:
        node, mine = (np.array([row[i] for row in group], np.int64) for i in (3, 4))
        parts = [np.frombuffer(row[5], np.uint64) for row in group]
        size = np.array([len(p) for p in parts], np.int64)
        name, index = np.unique(np.concatenate(parts), return_inverse=True)
        begin = np.concatenate(([0], np.cumsum(size)))
        label, own, count = np.unique(mine, return_inverse=True, return_counts=True)
        found: tuple[list[int], list[int]] = ([], [])
        held_in = np.zeros(len(name), np.int64)
        for i in np.flatnonzero(own != count.argmax()):
            held_in[index[begin[i] : begin[i + 1]]] = 1
            shared = np.add.reduceat(held_in[index], begin[:-1])
            held_in[index[begin[i] : begin[i + 1]]] = 0
            hit = (shared * 100 >= (size + size[i] - shared) * percent) & (own != own[i])
            if hit.any():
                # one link to each component is enough
                at = np.flatnonzero(hit)[np.unique(own[hit], return_index=True)[1]]
                found[0].extend([int(node[i])] * len(at))
                found[1].extend(node[at].tolist())
        return found

    def work(group):
        a, b = links(group)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(name).to_pylist() for name in ("center", "low", "high", "node", "mine", "shingles"))):
            if held and held[-1][:3] != row[:3]:
                yield from work(held)
                held = []
            held.append(row)
    if held:
        yield from work(held)


def links_across(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between nodes of one center and different components; ``rest`` is (center, node, mine), stored."""
    blocks = rest.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).withColumnRenamed("center", "__c")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        rest.join(blocks, F.col("center") == F.col("__c")).withColumn("own", own)
        .select("center", "node", "mine", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("center", "node", "mine", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    )
    full = dealt.join(sets.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n")).drop("__n")
    return (
        full.repartition("center", "low", "high").sortWithinPartitions("center", "low", "high")
        .mapInArrow(lambda batches: _across(batches, percent), "a long, b long")
    )


def verified(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared, n_a, n_b, linked) of the pairs, compared on full sets."""
    x = sets.select(F.col("node").alias("__x"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("__y"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(x, F.col("a") == F.col("__x")).join(y, F.col("b") == F.col("__y")).select("a", "b", "x", "y")
    found = both.mapInArrow(_common, "a long, b long, shared long")
    for side in ("a", "b"):
        found = found.join(sizes.select(F.col("node").alias("__n"), F.col("n").alias(f"n_{side}")), F.col(side) == F.col("__n")).drop("__n")
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return found.withColumn("linked", F.col("shared") * 100 >= union * percent)


def _size_fits(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents without a word have no set and are linked with nothing; each is kept. Equal sets are linked. Rows
    without an id are a component with the ids they are linked to, and are kept only if there is none: the least
    id of a component is its name, null if no row has one. Equal rows share a component; those with
    the least id are all kept. An empty table gives an empty result. Only id and text are read.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = pin(profiles(source, words))
    nodes = pin(base.filter("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    rows = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    crowd = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = pin(rows.join(crowd.withColumnRenamed("bucket", "__b"), F.col("bucket") == F.col("__b")).drop("__b"))
    sizes = pin(met.groupBy("node").agg(F.first("n").alias("n"), F.sum(F.col("members") - 1).alias("degree")))
    ranked = met.select("bucket", "node").join(sizes.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n")).drop("__n")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "node"))["node"].alias("center"))
    buckets = pin(ranked.join(hubs.withColumnRenamed("bucket", "__b"), F.col("bucket") == F.col("__b")).drop("__b"))
    # texts of the nodes in shared buckets, one document for each
    one = nodes.join(sizes.select(F.col("node").alias("__n")), F.col("node") == F.col("__n"), "left_semi").select(F.col("doc_id").alias("__d"), F.col("node").alias("__n"))
    held = source.join(one, F.col("doc_id").eqNullSafe(F.col("__d")), "left_semi")
    sets = sets_of(held, words).join(one.select("__n"), F.col("node") == F.col("__n"), "left_semi")
    sets = pin(sets.groupBy("node").agg(F.first("shingles").alias("shingles")))
    # first comparison: the center that a node shares most buckets with
    shared = buckets.filter("node <> center").groupBy("node", "center").agg(F.count(F.lit(1)).alias("times"))
    first = shared.groupBy("node").agg(F.max(F.struct("times", "center"))["center"].alias("b")).select(F.col("node").alias("a"), "b")
    known = pin(verified(first, sets, sizes, percent))
    labels = _roots(sizes, known.filter("linked"))
    # then, as long as it joins components, each component of a bucket with the bucket's center
    held_pairs = known
    for _ in range(2):
        open_buckets = _named(_named(buckets, labels, "node", "mine"), labels, "center", "theirs").filter("mine <> theirs")
        # of each component the member that meets most others
        tries = open_buckets.groupBy("center", "mine").agg(F.max(F.struct("degree", "node"))["node"].alias("a")).select("a", F.col("center").alias("b"))
        tries = _untried(_fitting(tries, sizes, percent), held_pairs)
        got = pin(verified(tries, sets, sizes, percent))
        if got.filter("linked").isEmpty():
            break
        held_pairs = pin(held_pairs.union(got))
        labels = _roots(sizes, held_pairs.filter("linked"))
    # last: members of one hub's buckets whose components still differ
    mixed = _named(buckets, labels, "node", "mine").select("center", "node", "mine").distinct()
    several = mixed.groupBy("center").agg(F.min("mine").alias("__lo"), F.max("mine").alias("__hi")).filter("__lo <> __hi").select(F.col("center").alias("__c"))
    rest = pin(mixed.join(several, F.col("center") == F.col("__c"), "left_semi"))
    more = pin(links_across(rest, sets, percent))
    if not more.isEmpty():
        labels = _roots(sizes, held_pairs.filter("linked").select("a", "b").union(more))
    # nodes that share no bucket are their own root
    rooted = nodes.join(labels.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("root", "__r")
    labels = rooted.join(names, F.col("root") == F.col("__r")).select("node", "component_id")
    final = base.join(labels.select(F.col("node").alias("__n"), "component_id"), (F.col("node") == F.col("__n")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return final.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _roots(members: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of every member: the root of its links, or itself."""
    found = components(links.select("a", "b")).withColumnRenamed("node", "__n")
    return pin(members.select("node").join(found, F.col("node") == F.col("__n"), "left").select("node", F.coalesce("root", "node").alias("root")))


def _named(df: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    return df.join(labels.select(F.col("node").alias("__l"), F.col("root").alias(name)), F.col(column) == F.col("__l")).drop("__l")


def _fitting(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("node").alias("__s"), F.col("n").alias(f"__{side}")), F.col(side) == F.col("__s")).drop("__s")
    return pairs.filter(_size_fits(F.col("__a"), F.col("__b"), percent)).drop("__a", "__b")


def _untried(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs not compared before, in either order."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done = known.select(F.least("a", "b").alias("__a"), F.greatest("a", "b").alias("__b"))
    return ordered.join(done, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")), "left_anti")

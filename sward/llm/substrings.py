"""Suffix-array dedup: remove every byte that a repeated string of LENGTH bytes covers.

Anchors (the least hashed grams of every LENGTH bytes) cut the suffixes to sort to a small part: equal
strings have equal anchors. Anchors whose whole context repeats settle all strings around them by a
count. Where the contexts of one gram differ, the suffixes at the anchors are sorted (``suffixes``) and
their common extensions tell which strings repeat. A gram with very many different contexts is dealt over
several tasks, whose strings are then matched by hash, so no task holds a whole group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sward.llm.common import mix, prepare, text_slices
from sward.llm.suffixes import LENGTH, SIDE, Contexts, anchors
from sward.session import pin

# Contexts of one gram that one task sorts together, and contexts that it takes up at a time.
SORT_TOGETHER = 16384
TAKE = 8192
WIDTH = SIDE + LENGTH


def _anchor_rows(docs: DataFrame, whole: bool) -> DataFrame:
    """(gram) or (gram, context, node, place) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, text in text_slices(batch):
                gram, context, row, place = anchors(text)
                columns = [pa.array(gram.view(np.int64))]
                if whole:
                    node = np.asarray(batch.column("node").slice(low, high - low))
                    columns += [pa.array(context.view(np.int64)), pa.array(node[row]), pa.array(place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "context", "node", "place"][: len(columns)])

    if whole:
        return docs.select("node", "text").mapInArrow(run, "gram long, context long, node long, place int")
    return docs.select("text").mapInArrow(run, "gram long")


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts around the marked anchors of each text."""
    for batch in batches:
        texts, marks, nodes = batch.column("text"), batch.column("marks"), batch.column("node")
        for i in range(batch.num_rows):
            raw, marked = texts[i].as_py().encode(), marks[i].values
            place = marked.field("place").to_numpy()
            rows = [raw[max(0, p - SIDE) : p + LENGTH] for p in place.tolist()]
            yield pa.RecordBatch.from_arrays(
                [marked.field("gram"), marked.field("salt"), marked.field("salts"), pa.array(np.full(len(rows), nodes[i].as_py())),
                 marked.field("place"), pa.array(np.minimum(place, SIDE).astype(np.int32)), pa.array(rows, pa.binary())],
                names=["gram", "salt", "salts", "node", "place", "left", "bytes"],
            )


def _matrix(part: dict[str, list]) -> Contexts:
    left = np.array(part["left"], np.int64)
    size = np.array([len(b) for b in part["bytes"]], np.int64)
    rows = np.zeros((len(left), WIDTH), np.uint8)
    for i, (a, raw) in enumerate(zip((SIDE - left).tolist(), part["bytes"])):
        rows[i, a : a + len(raw)] = np.frombuffer(raw, np.uint8)
    key = mix(np.array(part["gram"], np.int64).view(np.uint64)) + np.array(part["salt"], np.int64).view(np.uint64)
    return Contexts(key, left, size - left, rows)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered spans of each context, and for grams dealt over tasks the strings to match with other tasks.

    Rows come sorted by (gram, salt). ``string`` is null for a finished span; else the span is that of one
    string, repeated if its hash stands in two rows or ``twice`` is set.
    """
    names = ["gram", "salt", "salts", "node", "place", "left", "bytes"]
    held: dict[str, list] = {name: [] for name in names}

    def work(part):
        ids = list(zip(part["gram"], part["node"], part["place"]))
        first = {key: i for i, key in enumerate(ids)}
        keep = sorted(first.values())  # equal rows of the input table give equal contexts
        part = {name: [part[name][i] for i in keep] for name in names}
        contexts = _matrix(part)
        found = contexts.shared()
        place, node = np.array(part["place"], np.int64), np.array(part["node"], np.int64)
        padded = np.zeros((len(found), SIDE + 3), np.int8)
        padded[:, 1:-1] = found
        step = np.diff(padded, axis=1)
        row, near = np.nonzero(step == 1)
        far = np.nonzero(step == -1)[1] - 1
        out = [(node[row], place[row] - far, place[row] - near + LENGTH, np.zeros(len(row), np.int64), np.zeros(len(row), bool), np.ones(len(row), bool))]
        dealt, grams = np.flatnonzero(np.array(part["salts"]) > 1), np.array(part["gram"], np.int64)
        if len(dealt):
            for back in range(SIDE + 1):
                use = dealt[(contexts.left[dealt] >= back) & (contexts.right[dealt] >= LENGTH - back)]
                gram = mix(grams[use].view(np.uint64))
                string = mix(contexts.strings(use, back) + gram)
                # once per group: what one group holds twice is known to be repeated
                pick = np.unique(mix(string + contexts.group[use]), return_index=True)[1]
                at = use[pick]
                out.append((node[at], place[at] - back, place[at] - back + LENGTH, string[pick].view(np.int64), found[at, back], np.zeros(len(at), bool)))
        columns = [np.concatenate(c) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3], mask=columns[5]), pa.array(columns[4])],
            names=["node", "start", "stop", "string", "twice"],
        )

    for batch in batches:
        for name in names:
            held[name].extend(batch.column(name).to_pylist())
        if len(held["gram"]) >= TAKE:
            # the last group may go on in the next batch
            last = (held["gram"][-1], held["salt"][-1])
            cut = len(held["gram"])
            while cut and (held["gram"][cut - 1], held["salt"][cut - 1]) == last:
                cut -= 1
            if cut:
                yield from work({name: held[name][:cut] for name in names})
                held = {name: held[name][cut:] for name in names}
    if held["gram"]:
        yield from work(held)


def _remove(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, marks, copied = batch.column("text"), batch.column("spans"), batch.column("copied")
        total, gone, count, digest, starts, stops, left = [], [], [], [], [], [], []
        for i in range(batch.num_rows):
            raw = (texts[i].as_py() or "").encode()
            n = len(raw)
            if copied[i].as_py() and n >= LENGTH:
                runs = [(0, n)]
            elif marks[i].is_valid:
                spans = marks[i].values
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, spans.field("start").to_numpy(), 1)
                np.add.at(edge, np.minimum(spans.field("stop").to_numpy(), n), -1)
                turn = np.diff(np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8))))
                runs = list(zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()))
            else:
                runs = []
            kept, at = [], 0
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            rest = b"".join([*kept, raw[at:]])
            total.append(n)
            gone.append(n - len(rest))
            count.append(len(runs))
            digest.append(hashlib.sha256(rest).hexdigest())
            starts.append([a for a, _ in runs])
            stops.append([b for _, b in runs])
            left.append(rest if with_text else None)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (total, gone, count)), pa.array(digest, pa.string()),
             pa.array(starts, longs), pa.array(stops, longs), pa.array(left, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops", "kept"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans, kept_sha256, starts, stops, kept (the bytes left).

    Null counts as empty; texts under LENGTH bytes lose nothing. Equal rows are repeats of one another and
    lose everything, each of them. An empty table gives an empty result. Only id and text are read.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("node"))
    long_texts = source.filter(F.octet_length("text") >= LENGTH)
    copies = pin(
        long_texts.select("node", "doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("whole"))
        .groupBy("node", "whole").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id")).drop("whole")
    )
    repeated = pin(_anchor_rows(long_texts, False).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"))
    mine = _anchor_rows(long_texts, True).join(repeated.select(F.col("gram").alias("__g")), F.col("gram") == F.col("__g"), "left_semi")
    marked = pin(mine.distinct())  # copies of a text count once
    classes = marked.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "place")).alias("one"))
    classes = pin(classes)
    whole = classes.filter("n > 1").select(F.col("gram").alias("__g"), F.col("context").alias("__c"))
    settled = marked.join(whole, (F.col("gram") == F.col("__g")) & (F.col("context") == F.col("__c")), "left_semi").select(
        "node", F.greatest(F.lit(0), F.col("place") - SIDE).cast("long").alias("start"), (F.col("place") + LENGTH).cast("long").alias("stop")  # cut at the text's end later
    )
    mixed = pin(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select(F.col("gram").alias("__g"), "kinds"))
    salts = F.ceil(F.col("kinds") / SORT_TOGETHER).cast("int")
    open_ones = classes.join(mixed, F.col("gram") == F.col("__g")).select(
        "gram", "one.node", "one.place", salts.alias("salts"), F.pmod(F.xxhash64("one"), salts).cast("int").alias("salt")
    )
    per_text = open_ones.groupBy("node").agg(F.collect_list(F.struct("gram", "salt", "salts", "place")).alias("marks"))
    # one copy of each text gives the contexts
    per_text = per_text.join(copies.select(F.col("node").alias("__n"), F.col("doc_id").alias("__d")), F.col("node") == F.col("__n"))
    cut = (
        long_texts.join(per_text.select("__n", "__d", "marks"), (F.col("node") == F.col("__n")) & F.col("doc_id").eqNullSafe(F.col("__d")))
        .select("node", "text", "marks")
        .mapInArrow(_cut_contexts, "gram long, salt int, salts int, node long, place int, left int, bytes binary")
    )
    matched = pin(
        cut.repartition("gram", "salt").sortWithinPartitions("gram", "salt")
        .mapInArrow(_match, "node long, start long, stop long, string long, twice boolean")
    )
    strings = matched.filter("string is not null")
    again = strings.groupBy("string").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("any")).filter("n > 1 or any").select(F.col("string").alias("__s"))
    dealt = strings.join(again, F.col("string") == F.col("__s"), "left_semi").select("node", "start", "stop")
    spans = settled.union(matched.filter("string is null").select("node", "start", "stop")).union(dealt)
    spans = spans.groupBy("node").agg(F.collect_list(F.struct("start", F.col("stop"))).alias("spans"))
    several = copies.groupBy("node").agg((F.max("copies") > 1).alias("copied"))
    spans = several.join(spans.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select(F.col("node").alias("__n"), "copied", "spans")
    joined = source.join(spans, F.col("node") == F.col("__n"), "left").select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "spans")
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        source.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
        T.StructField("kept_sha256", T.StringType()), T.StructField("starts", longs), T.StructField("stops", longs), T.StructField("kept", T.BinaryType()),
    ])
    return joined.mapInArrow(lambda batches: _remove(batches, with_text), schema)

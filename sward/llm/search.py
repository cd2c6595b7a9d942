"""Ranked lexical search with bag deduplication.

The documents are scanned once per block of items. A task restricts each document to the block's
vocabulary: its bag, the sorted (term, occurrences) pairs, beside the number of all its terms. A
document's score depends on its bag and its length measure m alone, so documents fall into
classes of equal (bag, m), grouped by a hash and told apart by the whole bag. A class is scored
once for all items of the block; each task lets only classes through that may be among an item's
first ones. Members of the classes that are left are then listed by ascending id. Neither a
score of every document nor a class's whole membership is ever held in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sward.llm.common import prepare
from sward.session import pin

# Fixed values of the contract: what is not part of a term, results of an item, the length share.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = 50
LENGTH_SHARE = 50
# A block ends with the item that brings its vocabulary to this many terms.
BLOCK_TERMS = 50_000
# Cells of a score matrix, bytes of text split at a time, groups into which an item's classes are first dealt.
CELLS = 4_000_000
CUT_BYTES = 4 << 20
SALTS = 16

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, term); rows that share an id are one item."""
    lowered = F.translate(F.col(text_col), _UPPER, _LOWER)
    terms = F.regexp_extract_all(lowered, F.lit(_TERM), F.lit(0))
    return items.select(F.col(item_col).alias("item_id"), F.explode(terms).alias("term")).distinct()


def item_blocks(terms: DataFrame, size: int = BLOCK_TERMS) -> Iterator[list[tuple[object, list[str]]]]:
    """Runs of whole items whose vocabularies have about ``size`` terms; the driver holds one run."""
    ordered = terms.orderBy(F.col("item_id").asc_nulls_last(), "term")
    block: list[tuple[object, list[str]]] = []
    words: set[str] = set()
    for row in ordered.toLocalIterator():
        if not block or block[-1][0] != row["item_id"]:
            if len(words) >= size:
                yield block
                block, words = [], set()
            block.append((row["item_id"], []))
        block[-1][1].append(row["term"])
        words.add(row["term"])
    if block:
        yield block


def _cuts(raw: bytes) -> Iterator[bytes]:
    """The text folded to lower-case terms and spaces, in cuts that part no term."""
    folded = raw.translate(_FOLD)
    begin = 0
    while begin < len(folded):
        end = folded.find(b" ", begin + CUT_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[begin:end]
        begin = end


def _bagger(vocabulary: dict[bytes, int]):
    """Arrow batches of (doc_id, text) to (doc_id, n, bag) of the documents with a term."""
    size = np.int64(max(1, len(vocabulary)))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            rows, n, keys = [], [], []
            for i, text in enumerate(texts):
                if not text.is_valid:
                    continue
                total = 0
                for cut in _cuts(text.as_py()):
                    terms = cut.split()
                    total += len(terms)
                    ids = np.fromiter(map(vocabulary.get, terms, repeat(-1)), np.int64, len(terms))
                    keys.append(ids[ids >= 0] + len(rows) * size)
                if total:
                    rows.append(i)
                    n.append(total)
            pairs, tf = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_counts=True)
            cells = np.column_stack((pairs % size, tf)).astype("<u4").reshape(-1)
            stops = 8 * np.searchsorted(pairs, np.arange(len(rows) + 1) * size)
            bag = pa.Array.from_buffers(
                pa.binary(), len(rows), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(cells.tobytes())]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), bag], ["doc_id", "n", "bag"]
            )

    return bags


def _cells(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, occurrences) of every pair of the bags."""
    wide = bags.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset :][: len(wide) + 1] // 8
    data = wide.buffers()[2]
    pairs = np.frombuffer(data if data is not None else b"", "<u4").reshape(-1, 2)[offsets[0] : offsets[-1]].astype(np.int64)
    return np.repeat(np.arange(len(bags)), np.diff(offsets)), pairs[:, 0], pairs[:, 1]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes to partial document frequencies (term, df)."""
    for batch in batches:
        row, term, _ = _cells(batch.column("bag"))
        members = batch.column("members").to_numpy()
        terms, place = np.unique(term, return_inverse=True)
        df = np.zeros(len(terms), np.int64)
        np.add.at(df, place, members[row])
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df)], ["term", "df"])


def _scorer(weights: np.ndarray, items: list[np.ndarray], results: int):
    """Classes to (item, score, class) rows that may be among an item's first ``results``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(items), results), np.int64)  # the highest scores this task has seen
        step = max(1, CELLS // max(1, len(weights)))
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                row, term, tf = _cells(part.column("bag"))
                m = part.column("m").to_numpy()[row]
                share = np.zeros((len(weights), part.num_rows), np.int64)
                share[term, row] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
                found_items, found_rows, found_scores = [], [], []
                for i, terms in enumerate(items):
                    scores = share[terms].sum(axis=0)
                    # equal scores stay: ids decide between them later
                    rows = np.flatnonzero((scores > 0) & (scores >= best[i, 0]))
                    if len(rows):
                        kept = np.concatenate((best[i], scores[rows]))
                        best[i] = np.sort(np.partition(kept, len(kept) - results)[-results:])
                        rows = rows[scores[rows] >= best[i, 0]]
                        found_items.append(np.full(len(rows), i, np.int32))
                        found_rows.append(rows)
                        found_scores.append(scores[rows])
                if found_rows:
                    rows = pa.array(np.concatenate(found_rows))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(found_items)), pa.array(np.concatenate(found_scores)),
                            *[part.column(c).take(rows) for c in ("key", "bag", "m", "first_id")],
                        ],
                        ["item", "score", "key", "bag", "m", "first_id"],
                    )

    return score


def _first(df: DataFrame, by: list[Column | str], order: list[Column], k: int, name: str = "__rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark drops later rows in each task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def _search_block(docs: DataFrame, block: list[tuple[object, list[str]]], results: int) -> DataFrame:
    """(item, rank, doc_id, score) of one block; ``item`` is the place in the block."""
    words = sorted({word for _, terms in block for word in terms})
    place = {word: i for i, word in enumerate(words)}
    kind = dict(docs.dtypes)["doc_id"]
    bags = pin(docs.mapInArrow(_bagger({w.encode(): i for w, i in place.items()}), f"doc_id {kind}, n long, bag binary"))
    totals = bags.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = totals["n"], totals["l"] or 1
    product = F.col("n").cast("decimal(19,0)") * F.lit(LENGTH_SHARE * n_docs).cast("decimal(19,0)")
    measure = F.lit(100 - LENGTH_SHARE) + F.call_function("div", product, F.lit(n_terms).cast("decimal(19,0)"))
    measured = bags.filter(F.length("bag") > 0).withColumn("m", measure.cast("long")).withColumn("key", F.xxhash64("bag", "m"))
    classes = pin(
        measured.groupBy("key", "bag", "m").agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("first_id"))
    )
    frequencies = classes.select("bag", "members").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(words), np.int64)
    for row in frequencies.toLocalIterator():  # as many rows as the block has terms
        weights[row["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["df"] + 1)))
    items = [np.array([place[word] for word in terms]) for _, terms in block]
    scored = classes.mapInArrow(
        _scorer(weights, items, results), f"item int, score long, key long, bag binary, m long, first_id {kind}"
    )
    order = [F.col("score").desc(), F.col("first_id").asc_nulls_last()]
    # a document is among the first ones only if its class is, by score and its lowest id
    some = _first(scored.withColumn("__salt", F.pmod("key", F.lit(SALTS))), ["item", "__salt"], order, results).drop("__rank", "__salt")
    top = pin(_first(some, ["item"], order, results).drop("__rank", "first_id"))
    ids = ["key", "bag", "m"]
    members = measured.join(top.select(*ids).distinct(), ids, "left_semi")
    lowest = _first(members, ids, [F.col("doc_id").asc_nulls_last()], results).select(*ids, "doc_id")
    listed = top.join(lowest, ids).select("item", "score", "doc_id")
    return _first(listed, ["item"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], results, "rank")


def rank_documents(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    results: int = RESULTS, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``results`` best documents of each item: item_id, rank, doc_id, score.

    Terms are runs of digits, ASCII letters and characters beyond ASCII, A-Z lowered. A null text
    has no term; documents without a term count nowhere. Rows of ``items`` that share an id are one
    item with the terms of all; an item without a term, or whose terms no document holds, has
    no rows. Equal scores go by ascending id, null ids last; rows that share an id are documents of their
    own, and fully repeated rows take ranks one after the other. Empty tables give an empty
    result. Other columns are ignored. Items are worked off in blocks of about ``block_terms``
    different terms, each of which scans the documents once.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item_kind = dict(items.dtypes)[item_col]
    schema = f"item_id {item_kind}, rank int, doc_id {dict(docs.dtypes)['doc_id']}, score long"
    out = None
    for block in item_blocks(item_terms(items, item_col, text_col), block_terms):
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"__i int, item_id {item_kind}")
        found = pin(
            _search_block(docs, block, results).join(names, F.col("item") == F.col("__i"))
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        )
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out

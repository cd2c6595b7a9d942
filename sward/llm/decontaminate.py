"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items.

Texts are normalised byte for byte (A-Z lowered, every other ASCII byte that is no letter
or digit becomes a space), so that word positions map straight back to the original bytes.
Each text is scanned once; a match's end gives its last word, the window its first.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sward.llm.common import prepare, text_slices

WINDOW = 10
# One automaton holds items of at most this many bytes (about 20 times as much memory);
# a larger benchmark is scanned by several automata, one after the other.
AUTOMATON_BYTES = 8 << 20

_LONGS = T.ArrayType(T.LongType())
FOUND = (
    ("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()),
    ("contaminated", T.BooleanType()), ("starts", _LONGS), ("stops", _LONGS),
)  # and items, a list of the benchmark's own id type

_TABLE = bytearray(range(256))
for _b in range(128):
    if 65 <= _b <= 90:
        _TABLE[_b] = _b + 32
    elif not (48 <= _b <= 57 or 97 <= _b <= 122):
        _TABLE[_b] = 32
_TABLE = bytes(_TABLE)


def normalised(text: bytes) -> list[bytes]:
    """The words of a text, lowered."""
    return text.translate(_TABLE).split()


def automaton(items: list[tuple[object, str]], window: int = WINDOW):
    """Every window of every item, each with its length in words and the items that have it."""
    holders: dict[tuple[bytes, ...], set] = defaultdict(set)
    for item, text in items:
        words = normalised((text or "").encode())
        for i in range(max(1, len(words) - window + 1) if words else 0):
            holders[tuple(words[i : i + window])].add(item)
    machine = ahocorasick.Automaton()
    for words, found in holders.items():
        machine.add_word((b" " + b" ".join(words) + b" ").decode("latin-1"), (len(words), tuple(sorted(found, key=str))))
    if holders:
        machine.make_automaton()
    return machine if holders else None


def _scan(
    batches: Iterator[pa.RecordBatch], slices: list[list[tuple[object, str]]], window: int, prefix: str, item_kind: pa.DataType
) -> Iterator[pa.RecordBatch]:
    machines = [m for m in (automaton(part, window) for part in slices) if m is not None] if len(slices) == 1 else None
    for batch in batches:
        count = [[], [], [], []]
        starts, stops, items = [], [], []
        for low, high, text in text_slices(batch):
            found = [(set(), []) for _ in range(low, high)]
            prepared = []
            for i in range(text.rows):
                flat = text.raw(i).translate(_TABLE)
                prepared.append((flat, flat.split()))
            # with several automata only one is in memory at a time
            for machine in machines if machines is not None else (m for m in (automaton(s, window) for s in slices) if m):
                for i, (_, words) in enumerate(prepared):
                    _match(machine, words, *found[i])
            for (flat, words), (held, runs) in zip(prepared, found):
                hit, spans = _spans(flat, len(words), runs)
                ids = sorted(str(item) for item in held)
                count[0].append(len(words))
                count[1].append(hit)
                count[2].append(len(ids))
                count[3].append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                starts.append([a for a, _ in spans])
                stops.append([b for _, b in spans])
                items.append(sorted(held, key=str))
        longs = pa.int64()
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(c, longs) for c in count[:3]), pa.array(count[3], pa.string()),
             pa.array([n > 0 for n in count[1]], pa.bool_()), pa.array(starts, pa.list_(longs)),
             pa.array(stops, pa.list_(longs)), pa.array(items, pa.list_(item_kind))],
            names=[*batch.schema.names, *(f"{prefix}{name}" for name, _ in FOUND), f"{prefix}items"],
        )


def _match(machine, words: list[bytes], held: set, runs: list) -> None:
    if not words:
        return
    flat = (b" " + b" ".join(words) + b" ").decode("latin-1")
    begins = None
    for end, (n, found) in machine.iter(flat):
        if begins is None:
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            begins = np.concatenate(([1], np.cumsum(lengths + 1) + 1))  # where word i begins in flat
        last = int(np.searchsorted(begins, end, "right")) - 1  # the match ends on the space behind it
        runs.append((last - n + 1, last + 1))
        held.update(found)


def _spans(flat: bytes, n_words: int, runs: list) -> tuple[int, list[tuple[int, int]]]:
    """(hit words, byte spans of the hit runs in the original text)."""
    if not runs:
        return 0, []
    inside = np.frombuffer(flat, np.uint8) != 32
    edges = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    first, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hit = np.zeros(n_words + 1, np.int64)
    for a, b in runs:
        hit[a] += 1
        hit[b] -= 1
    marked = np.cumsum(hit)[:-1] > 0
    edges = np.diff(np.concatenate(([0], marked.astype(np.int8), [0])))
    spans = [(int(first[a]), int(stop[b - 1])) for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))]
    return int(marked.sum()), spans


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, prefix: str = "leak_", window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES
) -> DataFrame:
    """``docs`` with the columns of ``FOUND`` and ``items``, named with ``prefix``; nothing is shuffled.

    The item list is read by the driver and sent to the tasks in slices of at most ``automaton_bytes``
    of text, of which a task holds one automaton at a time.
    """
    prepare(docs.sparkSession)
    kept = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    slices, room = [[]], automaton_bytes
    for row in kept.orderBy("item_id").toLocalIterator():
        size = len(row["text"].encode())
        if slices[-1] and size > room:
            slices.append([])
            room = automaton_bytes
        slices[-1].append((row["item_id"], row["text"]))
        room -= size
    item_type = kept.schema["item_id"].dataType
    found = [*FOUND, ("items", T.ArrayType(item_type))]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + name, kind) for name, kind in found)])
    item_kind = to_arrow_type(item_type)
    return docs.mapInArrow(lambda batches: _scan(batches, slices, window, prefix, item_kind), schema)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
    id_col: str = "doc_id", text_col: str = "text", automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, starts, stops, items.

    ``starts``/``stops`` are byte offsets of the hit runs in the original text. Null or wordless texts and
    items match nothing; equal items count under each of their ids; items without an id are left out. Equal
    rows give equal results, an empty table an empty one. Only id and text are read, so other columns may
    have any name.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_leaks(source, benchmark, "", window, automaton_bytes).drop("text")

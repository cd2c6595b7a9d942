"""Token ids of documents in Parquet list columns, written in id order and read back selectively.

``write_tokens`` range-partitions the documents by id, encodes each partition in Arrow batches and
lets Spark's Parquet writer store ``doc_id, part, place, n_tokens, ids``: ids dictionary or delta
encoded, row groups and pages of a set size, column indexes by page. A second, small table holds
the place at which each part starts, so that a document's start is ``start of its part + place``
and neither table is rewritten. ``read_index`` reads the metadata columns alone; ``read_range``
reads the row groups and pages of the asked ids.

Texts are cut into pieces where the tokenizer never joins, by numpy over their bytes. Equal pieces of a
batch are brought together by Arrow, and the ids of each different one are kept in a bounded table that
the tasks of a worker share, so that a word is encoded about once per worker.
"""

from __future__ import annotations

import codecs
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, islice, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sward.llm.common import Text, prepare, text_slices

END_ID = 2
# Fixed sizes of the file format: bytes of a row group and of a page, rows of a page at most.
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
ENCODINGS = ("dictionary", "delta")
# A worker keeps the ids of about so many pieces, with so many ids in all, and of none of more bytes.
KEPT_SEGMENTS = 400_000
KEPT_IDS = 16_000_000
KEPT_BYTES = 256
# Bytes above which a text is cut, bytes cut into pieces at a time, and pieces whose ids go out at a time.
CUT_CHARS = 1 << 20
BATCH_BYTES = 2 << 20
EXPANDED_CODES = 200_000
# New pieces whose tokens are held together.
LEARNED_SEGMENTS = 1_000

_ID = attrgetter("id")
# The fixed byte alphabet of byte-level vocabularies: printable bytes stand for themselves, others for code points from 256.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {byte: chr(byte) for byte in _PRINTED} | {byte: chr(256 + i) for i, byte in enumerate(b for b in range(256) if b not in _PRINTED)}
_ALPHABET = "".join(_BYTES[byte] for byte in range(256))

# Kinds of bytes whose runs every version of the tokenizer's split keeps together and parts from each other. The letters are
# those from U+00C0 to U+027F (first bytes C3 to C9) but for two signs; all else, and the apostrophe, is odd.
_ODD, _LETTER, _DIGIT, _MARK, _NEWLINE, _SPACE, _BLANK = range(7)
_kinds = np.full(256, _ODD, np.uint8)
_kinds[33:127] = _MARK
_kinds[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = _LETTER
_kinds[48:58] = _DIGIT
_kinds[[9, 11, 12, 13, 28, 29, 30, 31]] = _BLANK
_kinds[[10, 32, 39]] = _NEWLINE, _SPACE, _ODD
_KINDS = _kinds.tobytes()
# First bytes of white space beyond ASCII, and this white space.
_WIDE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_WIDE_WHITE = np.array([int.from_bytes(c.encode()) for c in map(chr, range(128, 1 << 16)) if c.isspace()])
# A space between two characters of which neither can be white space.
_CUT = re.compile(
    rb"(?:(?<=[!-~])|(?<=[\xC3-\xDF][\x80-\xBF])|(?<=[\xE0\xE4-\xEF][\x80-\xBF]{2}))"
    rb" (?=[!-~\xC3-\xE0\xE4-\xF4])"
)


def _pieces(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each piece, whether it is odd) of the texts ``data[edges[i]:edges[i + 1]]``; the pieces cover them whole.

    The tokenizer never joins what stands before a space that has no other white space beside it with what
    follows, so texts are cut before each such space. A part without odd bytes or neighbouring white space is
    cut on where the tokenizer splits it; any other part is one odd piece.
    """
    kinds = np.frombuffer(bytearray(data).translate(_KINDS), np.uint8)
    after = np.append(data[1:], [0, 0]).astype(np.uint8)
    signs = np.flatnonzero(data == 0xC3)
    kinds[signs[(after[signs] == 0x97) | (after[signs] == 0xB7)]] = _ODD
    white = kinds >= _NEWLINE
    odd = np.flatnonzero((kinds == _ODD) | (kinds == _BLANK))
    wide = odd[_WIDE[data[odd]]]
    two = data[wide].astype(np.int64) << 8 | after[wide]
    three = two << 8 | after[wide + 1]
    for found, width in ((np.isin(two, _WIDE_WHITE), 2), (np.isin(three, _WIDE_WHITE), 3)):
        for i in range(width):
            white[wide[found] + i] = True
    parts = np.zeros(len(data), bool)
    parts[edges[:-1][edges[:-1] < edges[1:]]] = True
    joined = np.zeros(len(data) + 1, bool)  # white space behind white space
    np.logical_and(white[1:], white[:-1], out=joined[1:-1])
    joined[1:-1] &= ~parts[1:]
    spaces = kinds == _SPACE
    starts = kinds != np.append(kinds[:1], kinds[:-1])
    starts[1:] &= ~spaces[:-1]
    spaces &= ~(joined[:-1] | joined[1:])
    parts |= spaces
    starts |= parts
    place = np.flatnonzero(starts)
    odd = np.append(odd, np.flatnonzero(joined))
    if not len(odd):
        return place, np.zeros(len(place), bool)
    begins = parts[place]
    part = np.cumsum(begins) - 1
    whole = np.zeros(part[-1] + 1, bool)
    whole[part[np.searchsorted(place, odd, "right") - 1]] = True
    whole = whole[part]
    kept = begins | ~whole
    return place[kept], whole[kept]


class Segments(dict):
    """Code of each piece, by its bytes; its ids are ``ids[start[code]:start[code + 1]]``. Code 0 is the end of a document."""

    def __init__(self, tokenizer_path: str, end_id: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.end_id = end_id
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.start, self.kept = array("i", [self.end_id]), array("q", [0, 1]), 1
        self.known = self.asked = 0

    def trim(self) -> None:
        """Drop the pieces beyond the bounds, or all where few of those kept were met again."""
        if self.asked >= KEPT_SEGMENTS:
            if self.full() and self.known * 5 < self.asked:
                self.forget()
            self.known = self.asked = 0
        del self.start[self.kept + 1 :]
        del self.ids[self.start[-1] :]

    def full(self) -> bool:
        return self.kept >= KEPT_SEGMENTS or self.start[self.kept] >= KEPT_IDS

    def learn(self, pieces: list[bytes], ids: list[Iterable[int]]) -> int:
        """The code of the first of these new pieces; the others' follow."""
        code = len(self.start) - 1
        self.start.extend(islice(accumulate(map(len, ids), initial=self.start[-1]), 1, None))
        self.ids.extend(chain.from_iterable(ids))
        if code == self.kept and not self.full():
            new = zip(pieces, range(code, code + len(pieces)))
            self.update(new if max(map(len, pieces)) <= KEPT_BYTES else [one for one in new if len(one[0]) <= KEPT_BYTES])
            self.kept = code + len(pieces)
        return code

    def codes(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes whose ids, joined, are those of the texts between the edges, where each code's piece starts).

        Equal pieces are brought together first, so each is looked up once.
        """
        starts, odd = _pieces(data, edges)
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        place, different = pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False)
        known = np.fromiter(map(self.get, different, repeat(-1)), np.int32, len(different))
        strange = np.zeros(len(different), bool)
        strange[place[odd]] = True
        absent = known < 0
        self.asked += len(different)
        self.known += len(different) - int(absent.sum())
        for new, encoded in ((np.flatnonzero(absent & ~strange), self.encoded), (np.flatnonzero(absent & strange), self.whole)):
            for low in range(0, len(new), LEARNED_SEGMENTS):
                some = new[low : low + LEARNED_SEGMENTS]
                found = different[some].tolist()
                known[some] = self.learn(found, encoded(found)) + np.arange(len(some))
        return known[place], starts

    def encoded(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces that the tokenizer does not split."""
        letters = codecs.charmap_decode(b"\0".join(pieces), "strict", _ALPHABET)[0].split(_BYTES[0])
        return [[token.id for token in tokens] for tokens in map(self.model.tokenize, letters)]

    def whole(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces as the whole tokenizer gives them."""
        return [self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids for piece in pieces]

    def expand(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each code)."""
        start, ids = np.frombuffer(self.start, np.int64), np.frombuffer(self.ids, np.int32)
        n = start[codes + 1] - start[codes]
        shift = start[codes] - (np.cumsum(n) - n)
        place = np.repeat(shift, n)
        place += np.arange(len(place))
        return ids[place], n


_segments: dict[tuple[str, int], Segments] = {}


def _edges(text: Text) -> list[int]:
    """Where each text and each part of a long one starts, and the end of all."""
    edges = text.offsets.tolist()
    for i in np.flatnonzero(np.diff(text.offsets) > CUT_CHARS):
        begin, end = (int(edge) for edge in text.offsets[i : i + 2])
        raw, at = text.raw(i), CUT_CHARS
        while found := _CUT.search(raw, at):
            edges.append(begin + found.start())
            at = found.start() + CUT_CHARS
    return sorted(edges)


def _encode(texts: pa.Array, segments: Segments) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, ids of these rows, ids of each row) for runs of texts of about ``BATCH_BYTES``."""
    for _, _, text in text_slices(pa.record_batch([texts], ["text"]), size=BATCH_BYTES):
        edges = np.array(_edges(text))
        codes, starts = [], []
        first = 0
        while first < len(edges) - 1:  # of one long text, some parts at a time
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + BATCH_BYTES, "right")) - 1)
            if edges[last] > edges[first]:
                found = segments.codes(text.data[edges[first] : edges[last]], edges[first : last + 1] - edges[first])
                codes.append(found[0])
                starts.append(found[1] + edges[first])
            first = last
        starts = np.concatenate([*starts, np.zeros(0, np.int64)])
        ends = np.searchsorted(starts, text.offsets[1:])
        codes = np.insert(np.concatenate([*codes, np.zeros(0, np.int32)]), ends, 0)
        ends += np.arange(1, len(ends) + 1)
        low = start = 0
        while low < len(ends):  # a part of the run's codes at a time, since ids take more room
            high = max(low + 1, int(np.searchsorted(ends, start + EXPANDED_CODES, "right")))
            ids, n = segments.expand(codes[start : ends[high - 1]])
            sums = np.concatenate(([0], np.cumsum(n)))
            yield high - low, ids, np.diff(sums[ends[low:high] - start], prepend=0)
            low, start = high, int(ends[high - 1])
        segments.trim()


def _encoder(tokenizer_path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer_path, end_id)
        segments = _segments[key] = _segments.get(key) or Segments(*key)
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            first = 0
            for rows, ids, n in _encode(batch.column("text"), segments):
                stops = np.cumsum(n)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], stops)).astype(np.int32)), pa.array(ids)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, rows), pa.array(np.full(rows, part, np.int32)),
                        pa.array(place + stops - n), pa.array(n), lists,
                    ],
                    ["doc_id", "part", "place", "n_tokens", "ids"],
                )
                place += int(stops[-1])
                first += rows
            pa.default_memory_pool().release_unused()  # the JVM shares the executor's memory

    return encode


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
    encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS,
) -> None:
    """Encode every whole text, append ``end_id``, and write the ids under ``path`` in ascending id order.

    A null text is empty and has the end id alone. Null ids come first. Rows that share an id, fully
    repeated ones included, are written one after the other, each as a document of its own; a hash of
    the text and of the row's place in the input lets such a run be spread over parts. Strings of
    special tokens in a text are ordinary text. Other columns are ignored. An empty table gives an
    empty one. ``encoding`` is that of the ids: ``dictionary`` (bit-packed positions in a dictionary of a
    row group) or ``delta`` (bit-packed differences).
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    spark = prepare(docs.sparkSession)
    spread = F.xxhash64(F.col(text_col), F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), spread.alias("spread"))
    ordered = rows.repartitionByRange("doc_id", "spread").sortWithinPartitions("doc_id", "spread").drop("spread")
    kind = dict(rows.dtypes)["doc_id"]
    encoded = ordered.mapInArrow(
        _encoder(tokenizer_path, end_id), f"doc_id {kind}, part int, place long, n_tokens long, ids array<int>"
    )
    (
        encoded.write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows).option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower())
        .option("parquet.enable.dictionary#place", "false").option("parquet.enable.dictionary#n_tokens", "false")
        .option("compression", "zstd").parquet(f"{path}/tokens")
    )
    sizes = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row a part, however many documents
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start")).write.parquet(f"{path}/parts")


def _located(spark: SparkSession, path: str, columns: list[str], rows: Column | None = None) -> DataFrame:
    tokens = spark.read.parquet(f"{path}/tokens")
    tokens = (tokens if rows is None else tokens.filter(rows)).select("doc_id", "part", "place", *columns)
    parts = spark.read.parquet(f"{path}/parts").withColumnRenamed("part", "__part")
    start = (F.col("part_start") + F.col("place")).alias("start")
    return tokens.join(parts, F.col("part") == F.col("__part")).select("doc_id", start, *columns)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens of every document, without reading an id list."""
    return _located(spark, path, ["n_tokens"])


def read_range(spark: SparkSession, path: str, first, last) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents whose id is between ``first`` and ``last``.

    Files are in id order, so statistics leave out the parts, row groups and pages beyond the range.
    """
    return _located(spark, path, ["n_tokens", "ids"], F.col("doc_id").between(first, last))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy()
        data = memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the written id lists: one row per document."""
    found = _located(spark, path, ["ids"])
    kind = dict(found.dtypes)["doc_id"]
    return found.mapInArrow(_checksums, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")

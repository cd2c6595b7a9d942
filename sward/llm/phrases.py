"""Phrases whose words go together more often than chance, by the stripes pattern.

A stripe belongs to a first word and holds, for the word that may follow, a counter of the words that
may come next; a piece's end counts as a word, so every occurrence of a word is in exactly one
cell. Tasks count the cells of some million words at a time and send stripes; equal stripes meet
in sorted partitions, where they are added elementwise, batch by batch. From a merged stripe
come the extensions (its cells), the prefix totals (its sums) and, from the extensions kept, the
largest longer phrase around each phrase. A stripe is dealt over parts by its last word, and the
number of parts grows with the text, so that no task holds a frequent word's whole stripe.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sward.llm.common import prepare
from sward.session import pin

# Fixed values of the contract: least occurrences, phrases of a language, share that drops a phrase, unit of the score.
LEAST = 10
PHRASES = 2_000
COVERED_PERCENT = 50
UNIT = 1_000_000
# Words counted before stripes go out, different words among them at most, bytes of text split at a time.
SLICE_WORDS = 4_000_000
SLICE_VOCABULARY = 1_500_000
CUT_BYTES = 1 << 20
# Cells of a row and of an Arrow batch, bytes of text for each part of a stripe, groups ranked first.
ROW_CELLS = 1024
BATCH_CELLS = 250_000
PART_BYTES = 512 << 20
SALTS = 32

# A piece's end; no word contains it, since it parts pieces.
END = b"."
_BITS = 21
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256)
)

# Words hold no space, so those of a row's cells travel as one string.
_STRIPES = "lang string, a string, part int, b string, c string, n array<int>"
_COUNTS = "lang string, a string, b string, c string, n long"


class _Words(dict):
    """Numbers of the words of a slice; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Slice:
    """Words of one language, counted into stripes when the slice is full."""

    def __init__(self, lang: str, parts: int):
        self.lang, self.parts = lang, parts
        self.reset()

    def reset(self) -> None:
        self.words = _Words({END: 0})
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        self.ids.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def add_text(self, raw: bytes) -> Iterator[pa.RecordBatch]:
        folded = raw.translate(_FOLD)
        begin = 0
        while begin < len(folded):
            stops = [x for x in (folded.find(b" ", begin + CUT_BYTES), folded.find(END, begin + CUT_BYTES)) if x >= 0]
            end = min(stops, default=len(folded))
            self.add(folded[begin:end].replace(END, b" . ").split())
            begin = end
            if self.size >= SLICE_WORDS or len(self.words) >= SLICE_VOCABULARY:
                yield from self.flush()
        self.add([END])

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Stripes of the words so far; an open piece's last two words stay for the next slice."""
        names = list(self.words)
        ids = np.concatenate(self.ids or [np.zeros(0, np.int64)])
        open_end = len(ids) > 0 and ids[-1] != 0
        kept = [names[i] for i in ids[-2:]] if open_end else []
        padded = np.concatenate((ids, np.zeros(2, np.int64)))
        a, b, c = padded[:-2], padded[1:-1], padded[2:]
        starts = a != 0
        if open_end:
            starts[-2:] = False
        a, b = a[starts], b[starts]
        c = np.where(b == 0, 0, c[starts])
        yield from self._stripes(names, *np.unique((a << 2 * _BITS) | (b << _BITS) | c, return_counts=True))
        self.reset()
        self.add(kept)

    def _stripes(self, names: list[bytes], cells: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        low = (1 << _BITS) - 1
        part = np.array([zlib.crc32(name) % self.parts for name in names], np.int64)
        owner = (cells >> 2 * _BITS) * self.parts + part[cells & low]
        order = np.argsort(owner, kind="stable")
        cells, n, owner = cells[order], n[order], owner[order]
        strings = pa.array(names, pa.binary()).cast(pa.string())
        for first in range(0, len(cells), BATCH_CELLS):
            held, mine = cells[first : first + BATCH_CELLS], owner[first : first + BATCH_CELLS]
            new = np.ones(len(held), bool)
            new[1:] = (mine[1:] != mine[:-1]) | (np.arange(1, len(held)) % ROW_CELLS == 0)
            rows = np.flatnonzero(new)
            offsets = pa.array(np.append(rows, len(held)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([self.lang] * len(rows), pa.string()),
                    strings.take(pa.array(held[rows] >> 2 * _BITS)),
                    pa.array((mine[rows] % self.parts).astype(np.int32)),
                    pc.binary_join(pa.ListArray.from_arrays(offsets, strings.take(pa.array((held >> _BITS) & low))), " "),
                    pc.binary_join(pa.ListArray.from_arrays(offsets, strings.take(pa.array(held & low))), " "),
                    pa.ListArray.from_arrays(offsets, pa.array(n[first : first + BATCH_CELLS].astype(np.int32))),
                ],
                ["lang", "a", "part", "b", "c", "n"],
            )


def _counter(parts: int):
    """Arrow batches of (lang, text) to stripes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, _Slice] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang, text in zip(langs, batch.column("text").cast(pa.large_binary())):
                if lang not in slices:
                    slices[lang] = _Slice(lang, parts)
                yield from slices[lang].add_text(text.as_py())
                # together the languages hold no more than one full slice
                if sum(s.size for s in slices.values()) >= SLICE_WORDS:
                    for held in slices.values():
                        yield from held.flush()
        for held in slices.values():
            yield from held.flush()

    return count


def _merger(least: int):
    """Stripes sorted by (lang, a, part), added elementwise, to counts of words, pairs and triples.

    A row's missing words are null: (lang), (lang, a) and (lang, a, b) carry partial totals of a part, and
    (lang, a, b, c) a whole count of at least ``least``.
    """

    def totals(cells: pa.Table, keys: pa.Table) -> Iterator[pa.RecordBatch]:
        def rows(found: pa.Table, *names: str) -> pa.RecordBatch:
            owner = found["run"]
            blank = pa.nulls(found.num_rows, pa.string())
            columns = {"lang": keys["lang"].take(owner), "a": keys["a"].take(owner), "b": blank, "c": blank, "n": found["n_sum"]}
            columns |= {name: found[name] for name in names}
            return pa.table(columns).combine_chunks()

        end = END.decode()
        words = cells.group_by("run").aggregate([("n_sum", "sum")]).rename_columns(["run", "n_sum"])
        pairs = cells.filter(pc.not_equal(cells["b"], end)).group_by(["run", "b"]).aggregate([("n_sum", "sum")])
        pairs = pairs.rename_columns(["run", "b", "n_sum"])
        triples = cells.filter(pc.and_(pc.not_equal(cells["c"], end), pc.greater_equal(cells["n_sum"], least)))
        lang = keys["lang"].take(words["run"])
        whole = pa.table({"lang": lang, "n": words["n_sum"]}).group_by("lang").aggregate([("n", "sum")])
        blank = pa.nulls(whole.num_rows, pa.string())
        out = [pa.table({"lang": whole["lang"], "a": blank, "b": blank, "c": blank, "n": whole["n_sum"]})]
        out += [rows(words), rows(pairs, "b"), rows(triples, "b", "c")]
        for held in out:
            yield from held.to_batches(max_chunksize=100_000)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried_key, carried = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = pa.table([batch.column(c) for c in ("lang", "a", "part")], ["lang", "a", "part"])
            new = np.ones(batch.num_rows, bool)
            if batch.num_rows > 1:
                same = [pc.equal(batch.column(c)[1:], batch.column(c)[:-1]) for c in ("lang", "a", "part")]
                new[1:] = ~np.logical_and.reduce([s.to_numpy(zero_copy_only=False) for s in same])
            run = np.cumsum(new)  # from 1; run 0 is what the batch before left
            parents = pc.list_parent_indices(batch.column("n")).to_numpy()
            cells = pa.table({
                "run": pa.array(run[parents]),
                "b": pc.split_pattern(batch.column("b"), " ").flatten(), "c": pc.split_pattern(batch.column("c"), " ").flatten(),
                "n": batch.column("n").flatten().cast(pa.int64()),
            })
            runs = keys.take(pa.array(np.flatnonzero(new)))
            if carried is not None:
                first = tuple(runs.slice(0, 1).to_pylist()[0].values())
                if first == carried_key:
                    carried = carried.set_column(0, "run", pa.array(np.ones(carried.num_rows, np.int64)))
                cells = pa.concat_tables([carried, cells])
                lead = pa.table({c: pa.array([v], runs.schema.field(c).type) for c, v in zip(("lang", "a", "part"), carried_key)})
                runs = pa.concat_tables([lead, runs])
            else:
                runs = pa.concat_tables([runs.slice(0, 1), runs])
            merged = cells.group_by(["run", "b", "c"]).aggregate([("n", "sum")])
            last = run[-1]
            done = merged.filter(pc.less(merged["run"], last))
            if done.num_rows:
                yield from totals(done, runs)
            held = merged.filter(pc.equal(merged["run"], last))
            carried = pa.table({
                "run": pa.array(np.zeros(held.num_rows, np.int64)), "b": held["b"], "c": held["c"], "n": held["n_sum"],
            })
            carried_key = tuple(runs.slice(runs.num_rows - 1, 1).to_pylist()[0].values())
        if carried is not None:
            keys = pa.table({c: pa.array([v], pa.string()) for c, v in zip(("lang", "a"), carried_key)})
            yield from totals(carried.rename_columns(["run", "b", "c", "n_sum"]), keys)

    return merge


def phrase_counts(docs: DataFrame, least: int = LEAST, part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, a, b, c, n): occurrences of every word, pair and triple found ``least`` times; stored.

    Words a phrase lacks are null; the row without a word counts the words of the language.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    stripes = docs.mapInArrow(_counter(1 + size // part_bytes), _STRIPES)
    keys = ["lang", "a", "part"]
    merged = stripes.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merger(least), _COUNTS)
    counts = merged.groupBy("lang", "a", "b", "c").agg(F.sum("n").alias("n"))
    return pin(counts.filter((F.col("n") >= least) | F.col("a").isNull()))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(UNIT * a * a / (left * right)), exact."""
    wide = [x.cast("decimal(19,0)") for x in (a, left, right)]
    top = (wide[0] * wide[0]).cast("decimal(38,0)") * F.lit(UNIT).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide[1] * wide[2]).cast("decimal(38,0)")).cast("long")


def _with_count(df: DataFrame, counts: DataFrame, words: list[str], name: str) -> DataFrame:
    """Occurrences of the phrase in columns ``words`` of ``df`` as a new column."""
    places = ["a", "b", "c"]
    kind = counts.filter(F.col(places[len(words) - 1]).isNotNull() & F.col(places[len(words)]).isNull())
    found = kind.select(F.col("lang").alias("__lang"), *[F.col(p).alias(f"__{p}") for p in places[: len(words)]], F.col("n").alias(name))
    on = F.col("lang") == F.col("__lang")
    for place, word in zip(places, words):
        on &= F.col(f"__{place}") == F.col(word)
    return df.join(found, on).drop("__lang", *[f"__{p}" for p in places[: len(words)]])


def scored_candidates(counts: DataFrame, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases that no longer candidate covers."""
    triples = counts.filter(F.col("c").isNotNull())
    pairs = counts.filter(F.col("b").isNotNull() & F.col("c").isNull())
    around = triples.select("lang", "a", "b", "n").unionByName(triples.select("lang", F.col("b").alias("a"), F.col("c").alias("b"), "n"))
    longest = around.groupBy("lang", "a", "b").agg(F.max("n").alias("most"))
    free = (
        pairs.select("lang", "a", "b", "n").join(longest, ["lang", "a", "b"], "left")
        .filter(F.col("most").isNull() | (100 * F.col("most") < covered_percent * F.col("n")))
    )
    two = _with_count(_with_count(free, counts, ["a"], "l"), counts, ["b"], "r")
    two = two.select("lang", F.concat_ws(" ", "a", "b").alias("phrase"), F.col("n").alias("a"), "l", "r", _score(F.col("n"), F.col("l"), F.col("r")).alias("score"))
    three = triples
    for words, name in ((["a"], "l1"), (["b", "c"], "r1"), (["a", "b"], "l2"), (["c"], "r2")):
        three = _with_count(three, counts, words, name)
    cuts = [
        F.struct(_score(F.col("n"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
        for k in (1, 2)
    ]
    three = three.withColumn("cut", F.least(*cuts)).select(
        "lang", F.concat_ws(" ", "a", "b", "c").alias("phrase"), F.col("n").alias("a"), "cut.l", "cut.r", "cut.score"
    )
    return two.unionByName(three)


def mine_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, phrases: int = PHRASES,
    covered_percent: int = COVERED_PERCENT, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A null text is empty; a null language is ``und`` and joins rows that say so. Repeated rows count
    as often as they stand. Ties in score go by occurrences, then by the phrase's bytes. Other columns
    are ignored. An empty table, or one without frequent phrases, gives an empty result.
    """
    prepare(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    counts = phrase_counts(texts, least, part_bytes)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    found = scored_candidates(counts, covered_percent).withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for by in (["lang", "__salt"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        found = found.withColumn("rank", place).filter(F.col("rank") <= phrases)
    words = counts.filter(F.col("a").isNull()).select(F.col("lang").alias("__lang"), F.col("n").alias("words"))
    return found.join(words, F.col("lang") == F.col("__lang")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score"
    )

"""Token files, ranked search and phrases against brute force on small tables."""

import glob
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sward.llm import phrases, search, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

rng = random.Random(11)
WORDS = ["the", "of", "New", "york", "éa", "x1", *["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]]


def prose(n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n", "!?"]) for _ in range(n))


COPY = prose(40)
TEXTS = [
    None, "", "   ", " lead and  double space ", "tail  odd", "a\tb\n\n c \n", "%%% <|endoftext|> it's 12", "one", COPY, COPY, COPY.upper(),
    "New york is New york. new York, of the new york", "\x1c odd \x1c!", "the " * 400, "of the of the of the. " * 30, "…　 wide  …",
    *[prose(rng.randint(1, 200)) for _ in range(40)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], 1, "x") for i, t in enumerate(TEXTS)]
    rows += [(7, "one", "en", 1, "x"), (None, "the new york", "en", 1, "x"), (7, "two of them", "und", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, part int, score string").repartition(5).cache()


def plain_ids(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    return [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_segments_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens, "CUT_CHARS", 40)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 500)
    monkeypatch.setattr(tokens, "EXPANDED_CODES", 30)
    monkeypatch.setattr(tokens, "KEPT_SEGMENTS", 50)
    odd = [" ", "  ", " ", "\x1c", "\n", "\t", "​", " ", "'s", "!", "é", "ß", "a", "B", "7", "٣", "한", "😀", "\x85", "_"]
    texts = [*TEXTS, *["".join(rng.choice(odd) for _ in range(rng.randint(0, 120))) for _ in range(1500)], "long " * 3000, "x" * 5000]
    segments = tokens.Segments(PATH, 2)
    got, sizes = [], []
    for rows, ids, n in tokens._encode(pa.array(texts, pa.string()), segments):
        assert rows == len(n) and n.sum() == len(ids)
        got += ids.tolist()
        sizes += n.tolist()
    want = plain_ids(texts)
    assert sizes == [len(x) for x in want] and got == [i for x in want for i in x]


def encoded(texts, segments):
    rows = []
    for _, ids, n in tokens._encode(pa.array(texts, pa.string()), segments):
        rows += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    return rows


def test_words_marks_and_line_ends_are_kept_as_pieces_of_their_own():
    marks = ["", ",", ".", "!?", "...", ";", ":", ")"]
    texts = [f"{a}{x}\n{b}{y} {b}{x}" for a in WORDS[5:25] for b in WORDS[25:45] for x in marks for y in marks[:3]]
    segments = tokens.Segments(PATH, 2)
    assert encoded(texts, segments) == plain_ids(texts)
    assert len(segments) < 200  # 40 words at a start, after a line end and after a space, marks, digits; not their combinations


def test_odd_places_do_not_send_the_whole_text_through_the_tokenizer():
    class Noting:
        def __init__(self, tokenizer):
            self.tokenizer, self.seen = tokenizer, []

        def encode(self, text, **kw):
            self.seen.append(text)
            return self.tokenizer.encode(text, **kw)

    segments = tokens.Segments(PATH, 2)
    segments.tokenizer = noting = Noting(segments.tokenizer)
    texts = ["of the new york " * 50 + "one  two it's 3\u3000 four × five" + " of the new york" * 50]
    assert encoded(texts, segments) == plain_ids(texts)
    assert noting.seen and max(map(len, noting.seen)) < 20


def test_kept_pieces_are_bounded_and_stay_known(monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_BYTES", 400)
    monkeypatch.setattr(tokens, "KEPT_SEGMENTS", 60)
    monkeypatch.setattr(tokens, "LEARNED_SEGMENTS", 10)
    common = "of the new york and on to see it all"
    texts = [f"{common} {common} {''.join(rng.choice('abcde') for _ in range(9))}" for _ in range(200)]
    segments = tokens.Segments(PATH, 2)
    assert encoded(texts, segments) == plain_ids(texts)
    assert 59 <= len(segments) < 70 and len(segments.start) == len(segments) + 2 and b" york" in segments
    assert encoded(["x" * 1000], segments) == plain_ids(["x" * 1000])
    others = ["".join(rng.choice("vwxyz") for _ in range(9)) for _ in range(400)]  # none of those kept is met again
    assert encoded(others, segments) == plain_ids(others) and b" york" not in segments
    segments.forget()
    assert encoded(["x" * 1000 + " of"], segments) == plain_ids(["x" * 1000 + " of"]) and set(segments) == {b" of"}


def test_every_character_beside_letters_marks_and_spaces():
    places = ["a{}b", "a {}b", "a{} b", "a {} b", "a{}, b", "{}", " {}", "{} ", "a\n{}", "{}\nb", "{}{}", "1{}2"]
    chars = [*map(chr, range(0x2FF)), "\u1680", "\u180e", *map(chr, range(0x2000, 0x2070)), "\u3000", "\u3001", "\ufeff", "한", "я", "ا", "😀"]
    texts = [place.replace("{}", c) for c in chars for place in places]
    assert encoded(texts, tokens.Segments(PATH, 2)) == plain_ids(texts)


@pytest.mark.parametrize("encoding", tokens.ENCODINGS)
def test_token_files(spark, docs, tmp_path, encoding):
    path = str(tmp_path / encoding)
    tokens.write_tokens(docs, path, PATH, encoding=encoding, page_rows=10)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = Counter()
    for (doc, _), ids in zip(rows, plain_ids(t for _, t in rows)):
        want[doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = sorted(tokens.token_checksums(spark, path).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    # gapless, in ascending id order, null ids first
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)
    index = {(r["doc_id"], r["start"], r["n_tokens"]) for r in tokens.read_index(spark, path).collect()}
    assert index == {(r["doc_id"], r["start"], r["n_tokens"]) for r in got}
    some = tokens.read_range(spark, path, 5, 9).collect()
    assert sorted(r["doc_id"] for r in some) == [5, 6, 7, 7, 7, 8, 9]
    assert {(r["doc_id"], r["start"], len(r["ids"])) for r in some} <= index
    plan = tokens.read_range(spark, path, 5, 9)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,5)" in plan
    plan = tokens.read_index(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    for name in glob.glob(f"{path}/tokens/*.parquet"):
        group = pq.ParquetFile(name).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        lists = columns["ids.list.element"]
        assert any("DICTIONARY" in e for e in lists.encodings) == (encoding == "dictionary")
        assert encoding == "dictionary" or "DELTA_BINARY_PACKED" in lists.encodings
        assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings and columns["doc_id"].has_offset_index


def test_token_files_of_an_empty_table(spark, docs, tmp_path):
    tokens.write_tokens(docs.limit(0), str(tmp_path / "none"), PATH)
    assert tokens.token_checksums(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        tokens.write_tokens(docs, str(tmp_path / "other"), PATH, encoding="plain")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text or ""))


def plain_search(rows, items, results):
    bags = [(doc, Counter(terms_of(text))) for doc, text in rows]
    bags = [(doc, bag) for doc, bag in bags if bag]
    n_docs, n_terms = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(term for _, bag in bags for term in bag)
    out = set()
    for item, words in items.items():
        scored = []
        for doc, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * bag[w] // (1000 * bag[w] + 20 * m))
                for w in words if w in bag
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort(key=lambda x: x[:3])
        out |= {(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(scored[:results], 1)}
    return out


@pytest.mark.parametrize("block_terms", [50_000, 3])
def test_search(spark, docs, block_terms, monkeypatch):
    monkeypatch.setattr(search, "CUT_BYTES", 64)
    monkeypatch.setattr(search, "CELLS", 40)
    texts = [(1, "the NEW york"), (2, None), (3, "!!"), (4, "of the éa x1 of"), (4, "york"), (None, "zzzz one"), (5, "nowhere9"), (1, "the NEW york")]
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "item_id long, text string, rank int, term string")
    words = defaultdict(set)
    for item, text in texts:
        words[item] |= set(terms_of(text))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for results in (50, 7):
        got = search.rank_documents(docs, items, results=results, block_terms=block_terms)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert {tuple(r) for r in got.collect()} == plain_search(rows, words, results)
    assert search.rank_documents(docs.limit(0), items).count() == 0
    empty = search.rank_documents(docs, items.limit(0))
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_expands_a_large_class_by_id(spark):
    rows = [(i, "same words here", None) for i in range(400)] + [(1000, "same words here and there", None)]
    docs = spark.createDataFrame([(i * 7 % 401, t, x) for i, t, x in rows], "doc_id long, text string, m string").repartition(6)
    items = spark.createDataFrame([(1, "same words")], "item_id long, text string")
    got = sorted(tuple(r) for r in search.rank_documents(docs, items).collect())
    held = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert set(got) == plain_search(held, {1: {"same", "words"}}, 50) and len(got) == 50


def plain_phrases(rows, least, most):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        longer = defaultdict(int)
        for p, a in counts.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least or (len(p) == 2 and 100 * longer[p] >= 50 * a):
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.mark.parametrize("sizes", [(4_000_000, 1 << 20, 256 << 20), (60, 16, 200)])
def test_phrases(docs, sizes, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_WORDS", sizes[0])
    monkeypatch.setattr(phrases, "CUT_BYTES", sizes[1])
    monkeypatch.setattr(phrases, "ROW_CELLS", sizes[0])
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    for least, most in ((10, 2000), (3, 25)):
        got = phrases.mine_phrases(docs, least=least, phrases=most, part_bytes=sizes[2])
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        want = plain_phrases(rows, least, most)
        assert {tuple(r) for r in got.collect()} == want and want
    assert phrases.mine_phrases(docs.limit(0)).count() == 0


def test_scores_of_phrases_pass_64_bits(spark):
    counts = [("en", "a", None, None, 5 * 10**12), ("en", "b", None, None, 4 * 10**12), ("en", "a", "b", None, 3 * 10**12 + 1)]
    table = spark.createDataFrame(counts, "lang string, a string, b string, c string, n long")
    row = phrases.scored_candidates(table).first()
    assert row["score"] == 1_000_000 * (3 * 10**12 + 1) ** 2 // (20 * 10**24)


def test_stripes_merge_across_batches(spark):
    # one first word in many slices, its stripe cut into rows of few cells and read in small batches
    text = " ".join(f"hub w{i % 97}" for i in range(3000))
    docs = spark.createDataFrame([("en", text)] * 12, "lang string, text string").repartition(12)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {tuple(r)[1:] for r in phrases.phrase_counts(docs, 1, 1 << 14).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    words = text.split() * 1
    want = {(None, None, None, 12 * len(words))}
    for k in (1, 2, 3):
        grams = Counter(tuple(words[i : i + k]) + (None,) * (3 - k) for i in range(len(words) - k + 1))
        want |= {(*gram, 12 * n) for gram, n in grams.items()}
    assert got == want

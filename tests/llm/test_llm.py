"""The ten operators against brute force on small tables with nulls, empty texts, ties and repeats."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from sward.llm import components as linking
from sward.llm import substrings
from sward.llm import bands, mixing
from sward.llm.bands import compression_bands
from sward.llm.classifier import score_quality
from sward.llm.common import Text
from sward.llm.decontaminate import find_leaks
from sward.llm.dom import Page
from sward.llm.extraction import main_text
from sward.llm.mixing import mix_sources
from sward.llm.neardup import near_duplicates
from sward.llm.sharding import schedule, shard_documents
from sward.llm.suffixes import LENGTH, Contexts, anchors
from sward.llm.toxicity import log_odds, score_toxicity, segments

rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE, PASSAGE = prose(80), prose(70)
TEXTS = [
    None, "", "   \n", "One", "one", BASE, BASE, BASE.upper() + " é", BASE + " " + prose(3), prose(60) + PASSAGE + prose(50),
    prose(40) + PASSAGE + prose(30), "ab " * 300, prose(3000), BASE.replace(BASE[:20], "zz zz"), *[prose(90) for _ in range(6)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["s1", "s2", None][i % 3], "x", 1.0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string, size double").repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")


def test_repeated_strings(docs, monkeypatch):
    for together in (16384, 1):  # one task a gram, and grams dealt over tasks
        monkeypatch.setattr(substrings, "SORT_TOGETHER", together)
        got = {r["doc_id"]: r for r in substrings.remove_repeats(docs).collect()}
        raws = [(t or "").encode() for t in TEXTS]
        seen = Counter(r[p : p + LENGTH] for r in raws for p in range(len(r) - LENGTH + 1))
        for i, raw in enumerate(raws):
            gone = np.zeros(len(raw), bool)
            for p in range(len(raw) - LENGTH + 1):
                if seen[raw[p : p + LENGTH]] > 1:
                    gone[p : p + LENGTH] = True
            rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
            r = got[i]
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(raw), int(gone.sum()), spans, rest)
            assert r["kept_sha256"] == hashlib.sha256(rest).hexdigest()


def test_suffix_sort_matches_plain_sort():
    rows = np.random.default_rng(1).integers(97, 99, (40, 336)).astype(np.uint8)
    rows[5:9] = rows[4]
    contexts = Contexts(np.repeat(np.arange(4), 10).astype(np.uint64), np.full(40, 136), np.full(40, 200), rows)
    order = contexts.sort()
    keys = [(int(contexts.group[i]), rows[i, 136:].tobytes()) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(40))


def test_equal_strings_have_equal_anchors():
    shared = prose(60).encode()[:LENGTH]
    places = []
    for before in (b"", b"xyz " * 70, prose(90).encode()):
        raw = before + shared + prose(50).encode()
        _, _, _, place = anchors(Text(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        places.append({p - len(before) for p in place.tolist() if 0 <= p - len(before) <= LENGTH - 64})
    assert set.intersection(*places)


def test_leaks(spark, docs):
    items = [(1, PASSAGE), (2, "One"), (3, None), (4, ""), (5, " ".join(PASSAGE.split()[:12])), (6, "not there at all")]
    found = {r["doc_id"]: r for r in find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for i, text in enumerate(TEXTS):
        words, hit, ids = split(text), set(), set()
        for item, body in items:
            own = split(body)
            for k in range(max(1, len(own) - 9) if own else 0):
                window = own[k : k + 10]
                for p in range(len(words) - len(window) + 1):
                    if words[p : p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        ids.add(str(item))
        r = found[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(words), len(hit), len(ids), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert all(split(text.encode()[a:b].decode()) for a, b in zip(r["starts"], r["stops"]))


def test_near_duplicates(docs):
    for size in (2, 5):
        sets = []
        for text in TEXTS:
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
            sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
        root = list(range(len(sets)))
        for _ in root:
            for a in root:
                for b in range(len(sets)):
                    if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        root[a] = root[b] = min(root[a], root[b])
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, words=size).collect()}
        assert got == {i: (len(s), root[i], root[i] == i) for i, s in enumerate(sets)}


def test_components(spark, monkeypatch):
    monkeypatch.setattr(linking, "BATCH", 7)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (201, 202)]
    got = {r["node"]: r["root"] for r in linking.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {201: 201, 202: 201}
    assert got == want


def test_word_rules(docs):
    for r in compression_bands(docs).collect():
        text = TEXTS[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeat = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(repeat))
        assert (r["n_symbols"], r["n_dup_lines"], r["base_failed"]) == (len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), failed)
        assert not (failed and r["kept"])


def test_incompressible_text_is_dropped_at_every_length(spark):
    draw = random.Random(5)
    # words of syllables, drawn unevenly: compresses like prose
    some = ["".join(draw.choice(["ba", "ter", "en", "lo", "sti", "ung", "ra", "mi"]) for _ in range(draw.randint(1, 4))) for _ in range(3000)]

    def text(n):
        return " ".join(some[int(3000 * draw.random() ** 3)] for _ in range(n // 4))[:n]

    def letters(n, alphabet, least, most):
        return " ".join("".join(draw.choice(alphabet) for _ in range(draw.randint(least, most))) for _ in range(n // least))[:n]

    sizes = (1500, 2000, 4000, 8000, 16000, 40000, 100000)
    good = [text(n + 3 * k) for n in sizes[:6] for k in range(60)] + [text(100000)]
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    junk = [letters(n, a, *w) for n in sizes for a, w in ((base64, (8, 8)), ("abcdefghijklmnopqrstuvwxyz", (3, 9)))]
    junk += [text(4096) + letters(4096, base64, 8, 8), text(4096) + ("ab cd " * 700)[:4096], text(20000) + letters(20000, base64, 8, 8)]
    frame = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in compression_bands(frame).collect()}
    assert not [len(junk[i]) for i in range(len(junk)) if kept[len(good) + i]]
    assert sum(kept[i] for i in range(len(good))) >= 0.99 * len(good)


def plain_bands(texts):
    """Which texts are kept, one at a time, with limits from sorted lists."""
    packer = zstandard.ZstdCompressor(level=bands.LEVEL)
    ratio = lambda raw: len(raw) / len(packer.compress(raw)) if raw else 1.0
    octave = lambda n: math.floor(2 * math.log2(max(n, 1)))
    cases, held = [], defaultdict(list)
    for text in texts:
        raw = (text or "").encode()
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeat = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        parts = [raw[a : a + 4096] for a in range(0, len(raw), 4096)]
        if len(parts) > 1 and len(parts[-1]) < 2048:
            parts[-2:] = [parts[-2] + parts[-1]]
        parts = parts if len(parts) > 1 else []
        failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
        cases.append((failed, [(len(raw), ratio(raw))], [(len(p), ratio(p)) for p in parts]))
        if not failed:
            middle = [(4096, float(np.median([r for _, r in cases[-1][2]])))] if parts else []
            for n, r in cases[-1][1] + middle:
                low, high = bands.limits(n)
                if low <= r <= high:
                    held[octave(n)].append(int(r / 0.01))
    lower, upper = {}, {}
    for o, found in held.items():
        if len(found) >= 50:
            first, middle, third = ((sorted(found)[math.ceil(q * len(found)) - 1] + 0.5) * 0.01 for q in (0.25, 0.5, 0.75))
            lower[o] = middle - max(5 * (middle - first), 0.12 * middle)
            upper[o] = max(third + 3 * (third - first), 1.12 * middle)

    def between(limit, n, beyond):
        x = 2 * math.log2(max(n, 1)) - 0.5
        known = sorted(limit)
        y = {o: max(limit[k] for k in known if k <= o) for o in known}
        if not known or x > known[-1]:
            return beyond(y[known[-1]]) if known else beyond(None)
        left = max((o for o in known if o <= x), default=None)
        if left is None:
            return y[known[0]]
        right = min((o for o in known if o >= x))
        return y[left] if left == right else y[left] + (y[right] - y[left]) * (x - left) / (right - left)

    def outside(n, r):
        low, high = bands.limits(n)
        # lower limits hold for longer texts, not for shorter ones; upper limits the other way round
        own = between(lower, n, lambda last: last or 0.0) if lower and octave(n) >= min(lower) else 0.0
        most = between(upper, n, lambda last: math.inf)
        return r < max(low, own) or r > min(high, most)

    return [
        not failed and not outside(*whole[0]) and sum(outside(*p) for p in parts) <= 0.1 * max(1, len(parts))
        for failed, whole, parts in cases
    ]


def test_bands_equal_a_plain_computation(spark):
    draw = random.Random(11)
    some = ["".join(draw.choice(["ba", "ter", "en", "lo", "sti", "ung", "ra", "mi"]) for _ in range(draw.randint(1, 4))) for _ in range(3000)]

    def text(words, kinds=3000):
        return " ".join(some[int(kinds * draw.random() ** 3)] for _ in range(words))

    marked = [re.sub(" ", "$$$ ", text(n)) for n in (100, 300, 900, 2500) for _ in range(6)]
    narrow = [text(n, 60) for n in (100, 300, 900, 2500) for _ in range(6)]
    half = [text(1500) + " " + re.sub(" ", "### ", text(1500)) for _ in range(6)]
    prose_ = [text(n + draw.randint(0, n // 3)) for n in (60, 100, 300, 900, 2500) for _ in range(70)]
    junk = marked + narrow + half
    texts = [None, "", "x", *prose_, *junk, *["".join(draw.choice("abcdefghij ") for _ in range(n)) for n in (500, 5000, 50000)]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["kept"] for r in compression_bands(frame).collect()}
    assert [got[i] for i in range(len(texts))] == plain_bands(texts)
    first = 3 + len(prose_)
    assert sum(got[i] for i in range(3, first)) >= 0.98 * len(prose_)
    assert sum(got[i] for i in range(first, first + len(junk))) <= 0.2 * len(junk)


def test_scores_are_sound_and_learned(spark, docs, labels):
    for run, label in ((score_quality, "quality"), (score_toxicity, "toxic")):
        for given in (labels, labels.limit(0)):
            got = run(docs, given).collect()
            assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    rows = [(i, prose(60) + (" vile scum" * 3 if i % 3 == 0 else "")) for i in range(240)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    for run, label in ((score_quality, lambda i: int(i % 3 != 0)), (score_toxicity, lambda i: int(i % 3 == 0))):
        held = [r for r in run(frame, marks).collect() if r["held_out"]]
        assert sum(r["predicted"] == label(r["doc_id"]) for r in held) >= 0.95 * len(held)


def test_words_of_toxic_texts_alone_keep_their_log_odds():
    # 400,000 rare tokens, 80 and 8 toxic texts with no clean one, 8 and 3 of each side, common to both
    rest = np.random.default_rng(2).integers(0, 2, 400_000)
    toxic = np.concatenate((rest == 0, [80, 8, 8, 3, 300])).astype(float)
    clean = np.concatenate((5 * rest, [0, 0, 70, 24, 2400])).astype(float)
    scores = log_odds(toxic, clean)[-5:]
    assert scores[0] > scores[1] > 0 and np.isnan(scores[2:]).all()


def test_maximal_segments():
    draw = np.random.default_rng(3)
    for _ in range(50):
        s = draw.integers(-3, 4, 14).astype(float)
        run = np.concatenate(([0], np.cumsum(s)))
        up = np.flatnonzero(s > 0)
        got = segments(up.tolist(), s[up].tolist(), run[up].tolist())

        def maximal(a, b):  # the largest sum first, the shortest of equal ones; then left and right of it
            if a >= b:
                return []
            best = max(((run[j] - run[i], i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)))
            if best[0] <= 0:
                return []
            _, _, i, j = best
            return [*maximal(a, i), (i, j - 1, run[j] - run[i]), *maximal(j, b)]

        assert sum(x for *_, x in got) == sum(x for *_, x in maximal(0, 14))


def test_page_text(spark):
    def page(i, main, side):
        return f"<html><head><title>t{i}</title></head><body><nav><ul>" + "".join(f"<li><a href='/'>link{i}{k}</a></li>" for k in range(5)) + f"</ul></nav>{main[0]}<h1>Head {i}</h1><p>First <b>bold</b>er &amp; text {prose(40)}.<p>Second\n  part {prose(60)}.</p>{main[1]}{side}<footer>&copy; {i}</footer></body></html>"

    side = "<div class='sidebar'><ul><li><a href='/'>more</a></li></ul></div><script>var x='<p>no</p>'</script>"
    rows = [(i, f"u{i}", page(i, ("<article>", "</article>"), side)) for i in range(40)]
    rows += [(90, "u", None), (91, "u", ""), (92, "u", page(92, ("<div class='post-content'>", "</div>"), side)), (93, "u", "<p>unclosed <b>x")]
    got = {r["page_id"]: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[90]["text"] == got[91]["text"] == "" and len(got) == 44
    for i in (*range(40), 92):
        text = got[i]["text"]
        assert text.startswith(f"Head {i} First bolder & text ") and "Second part" in text and got[i]["n_chars"] == len(text)
        assert "link" not in text and "more" not in text and "var" not in text and "©" not in text


def test_page_text_without_article_tags(spark):
    def page(i, opening, closing="</div>"):
        links = "".join(f"<li><a href='/'>link{i}{k}</a></li>" for k in range(5))
        return f"<html><body><nav><ul>{links}</ul></nav>{opening}<h1>Head {i}</h1><p>First {prose(40)}.</p><p>Second part {prose(60)}.</p>{closing}<div class='sidebar'><p>more stuff</p></div><footer>&copy; {i}</footer></body></html>"

    forms = [("<div class='post-content'>",), ("<div>",), ("<article>", "</article>")]
    for rows in ([page(i, *forms[0]) for i in range(40)], [page(i, *forms[1]) for i in range(40)], [page(i, *forms[2 * (i == 0)]) for i in range(40)]):
        frame = spark.createDataFrame([(i, "u", h) for i, h in enumerate(rows)], "page_id long, url string, html string")
        for r in main_text(frame).collect():
            assert r["text"].startswith(f"Head {r['page_id']} First ") and "Second part" in r["text"]
            assert "link" not in r["text"] and "more" not in r["text"] and "©" not in r["text"]
    bare = spark.createDataFrame([(1, "u", "plain words"), (2, "u", "<nav>only links</nav>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in main_text(bare).collect()}[1] == "plain words"


def test_page_text_with_open_head_form_and_math(spark):
    def page(i, head, body, math=""):
        return f"<html><head><title>t</title>{head}{body}<nav><a href='/'>link{i}</a></nav><article><h1>Head {i}</h1><p>First {prose(40)} {math}</p><p>Second {prose(60)}.</p></article><footer>&copy;</footer></body></html>"

    rows = [page(i, "</head>", "<body>") for i in range(40)]
    rows += [page(40, "", "<body>"), page(41, "", ""), page(42, "<noscript><img src='x'></noscript>", "<body>")]
    rows += [page(43, "</head>", "<body><form method='post'><fieldset>").replace("</body>", "</fieldset></form></body>")]
    rows += [page(44, "</head>", "<body>", "<math><msup><mi>x</mi><mn>2</mn></msup><mspace/><annotation>TeX</annotation></math> holds")]
    frame = spark.createDataFrame([(i, "u", h) for i, h in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text(frame).collect()}
    for i in range(len(rows)):
        assert got[i].startswith(f"Head {i} First ") and " Second " in got[i] and "link" not in got[i] and "©" not in got[i]
    assert " x2" in got[44] and "TeX" not in got[44] and " holds Second" in got[44]


def test_page_tree_closes_what_is_open():
    page = Page("<ul><li>a<li>b</ul><p>c<div>d</div>")
    assert [n.tag for n in page.nodes] == ["html", "ul", "li", "li", "p", "div"] and page.nodes[3].parent.tag == "ul"


def test_mixing(spark, docs):
    rows = [(i, " ".join(["w"] * (5 + i * 7 % 90)), ["a", "b", "c", None][i % 4]) for i in range(800)] + [(900, None, "a"), (901, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(frame).collect()
    again = {r["doc_id"]: r["taken"] for r in mix_sources(frame.repartition(5)).collect()}
    assert {r["doc_id"]: r["taken"] for r in got} == again and len(got) == len(rows)
    taken, target = defaultdict(int), {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    total = sum(r["size"] for r in got)
    assert abs(sum(target.values()) - total) < 1e-6 * total
    assert target["a"] == pytest.approx(5 / 13 * total) and target[None] == pytest.approx(5 / 13 * total)
    assert all(abs(taken[s] - target[s]) < 0.01 * target[s] for s in target)
    assert mix_sources(docs.limit(0)).count() == 0 and mix_sources(docs).count() == len(TEXTS)


def test_mixing_of_repeated_ids(spark):
    rows = [(1, "w w w", "a")] * 2000 + [(None, "w w", "a")] * 700 + [(i, "w " * (1 + i % 9), "b") for i in range(300)] + [(1, "w w w", None)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(frame).collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((i, len(t.split()), s) for i, t, s in rows)
    taken, target = Counter(), {}
    for r in got:
        assert math.floor(r["rate"]) <= r["copies"] <= math.ceil(r["rate"]) and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 3 for s in target)
    again = mix_sources(frame.repartition(5)).collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in again)


def plain_targets(sizes, weights=(5, 2, 1)):
    """Shares by weight; a source above three times its size stops there and the others share anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_targets_equal_a_plain_reshare(spark):
    draw = random.Random(8)
    for _ in range(4):
        sizes = {s: int(10 ** (4 * draw.random())) for s in draw.sample([None, "a", "b", "c", "d", "e", "f", "g", "é"], draw.randint(1, 9))}
        frame = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, docs long, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_shards(spark, docs):
    counts = [(s, rng.randint(1, 60)) for s in rng.sample(range(1, 500), 40)]
    load = [0] * 8
    for size, n in sorted(counts, reverse=True):
        for _ in range(n):
            load[load.index(min(load))] += size
    got = [0] * 8
    for size, shard, first, end in schedule(counts, 8):
        got[shard] += size * (end - first)
    assert sorted(got) == sorted(load)
    rows = shard_documents(docs).collect()
    slots, of = defaultdict(list), {}
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert of.setdefault(TEXTS[r["doc_id"]] or "", r["shard"]) == r["shard"]
    assert len(rows) == len(TEXTS) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(docs.limit(0)).count() == 0

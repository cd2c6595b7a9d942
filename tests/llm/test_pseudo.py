"""Pseudo-likelihood scores against a plain per-token computation, and against counts alone."""

import math
from collections import Counter

import numpy as np
import pytest

from sward.llm import pseudo
from sward.llm.common import Text

TEXTS = [None, "", " \n\t", "one", "One", "a b c d e f g", "a b c d e f g", "é ü " * 7, *["w%d x y z. w%d x" % (i, i % 3) for i in range(20)], "long text " * 5000]


def tokens(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return [int(t) for t in pseudo.token_ids(Text(data, np.array([0, len(data)])))[0]]


def codes(ids, words):
    return [int(c) for c in pseudo.codes_of(np.array(ids, np.uint64), words.head)]


def share(z):
    return np.exp(z.astype(float)) / np.exp(z.astype(float)).sum()


def plain(network, cell, inside, words, ids):
    embed, first, bias, second, out, deep, deep_out = network.parts
    often, coded = Counter(t for text in TEXTS for t in tokens(text)), codes(ids, words)
    total = 0.0
    for i, (token, code) in enumerate(zip(ids, coded)):
        around = [coded[i + o] if 0 <= i + o < len(ids) else pseudo.PAD for o in pseudo.AROUND]
        hidden = np.tanh(np.concatenate([embed[a] for a in around]) @ first + bias)
        kind, sub = divmod(int(cell[code]), pseudo.SUBS)
        total += math.log(share(hidden @ second + out)[kind]) + math.log(share(hidden @ deep[kind] + deep_out[kind])[sub]) + inside[code]
        if code >= pseudo.HEAD:
            total += math.log(often[token] / words.count[code])
    return total


@pytest.mark.parametrize("head", [pseudo.HEAD, 12, 0])
def test_scores_match_a_plain_computation(spark, monkeypatch, head):
    whole, taken = pseudo.Vocabulary.__init__, []

    def small(self, counted):  # as if the head had room for fewer words
        with monkeypatch.context() as patch:
            patch.setattr(pseudo, "HEAD_WORDS", head)
            whole(self, counted)
        taken.append(len(self.head))

    monkeypatch.setattr(pseudo.Vocabulary, "__init__", small)
    rows = [(i, t, i, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids string").repartition(3).cache()
    network, cell, inside, words = pseudo.train(docs)
    assert taken[0] <= head and (taken[0] > 0) == (head > 0)
    got = {r["doc_id"]: r for r in pseudo.score_likelihood(docs).collect()}
    assert sorted(got) == list(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        ids = tokens(text)
        assert got[i]["n_tokens"] == len(ids) == len((text or "").split())
        if len(ids) < 100:
            assert math.isclose(got[i]["log_likelihood"], plain(network, cell, inside, words, ids), rel_tol=1e-4, abs_tol=1e-4)
        if ids:
            assert math.isclose(got[i]["mean_log_likelihood"] * len(ids), got[i]["log_likelihood"], rel_tol=1e-9)
        else:
            assert got[i]["log_likelihood"] == 0 and got[i]["mean_log_likelihood"] is None
    assert got[3]["log_likelihood"] == got[4]["log_likelihood"] and got[5]["log_likelihood"] == got[6]["log_likelihood"]


def test_counts_and_pieces_cover_every_token(spark, monkeypatch):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3).cache()
    want = Counter(t for text in TEXTS for t in tokens(text))
    monkeypatch.setattr(pseudo, "HELD", 3)
    counted = pseudo.word_counts(docs).cache()
    assert {r["token"] % 2**64: r["n"] for r in counted.collect()} == want
    words = pseudo.Vocabulary(counted)
    assert sorted(want) == [int(t) for t in words.head] and words.count.sum() == sum(want.values())
    got = pseudo.pieces(docs, words.head).collect()
    assert all(r["n"] * 2 + 4 * pseudo.WINDOW == len(r["ids"]) and 0 < r["n"] <= pseudo.PIECE for r in got)
    inner = Counter(int(c) for r in got for c in np.frombuffer(r["ids"], np.uint16)[pseudo.WINDOW : -pseudo.WINDOW])
    assert inner == Counter(c for text in TEXTS for c in codes(tokens(text), words))


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string").cache()
    first, again = ({r["doc_id"]: r for r in pseudo.score_likelihood(docs.repartition(n)).collect()} for n in (1, 7))
    assert first == again
    for i in range(len(TEXTS)):
        assert first[i][1:] == first[i + len(TEXTS)][1:]


def test_a_rare_word_that_repeats_is_likelier(spark, monkeypatch):
    monkeypatch.setattr(pseudo, "HEAD_WORDS", 2)
    rows = [(i, "a b " * 50) for i in range(20)] + [(20, "a once b"), (21, "a twice b"), (22, "a twice b")]
    got = {r["doc_id"]: r["log_likelihood"] for r in pseudo.score_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[21] == got[22] > got[20] + 0.3


def test_both_sides_teach_more_than_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c " * 100) for i in range(100)], "doc_id long, text string").repartition(4).cache()

    def mean(rounds):
        network, cell, inside, words = pseudo.train(docs, rounds=rounds, replica_tokens=4000)
        ids = np.array(codes(tokens("a b c " * 100), words), np.uint16)
        return pseudo.log_chances(network, cell, inside, *pseudo.padded(ids, np.zeros(len(ids), int), 1)).mean()

    monkeypatch.setattr(pseudo, "FAN_IN", 3)
    assert mean(3) > mean(0) + 0.3
    first, again = pseudo.train(docs, replica_tokens=4000)[0], pseudo.train(docs, replica_tokens=4000)[0]
    assert all(np.array_equal(a, b) for a, b in zip(first.parts, again.parts))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pseudo.score_likelihood(empty).collect() == []

"""LM scoring by masked pseudo-likelihood: every token is predicted from the tokens on both its sides.

Tokens are lower-cased words, told apart by 64-bit hashes. A stored table counts every different word of the corpus, so it
grows with the input. The most frequent words, HEAD_WORDS at most, have a code and an embedding of their own; the others share
2 ** TAIL_BITS codes. Pads stand beyond a document's ends. Codes are cut into cells by count, and cells into
CLASSES classes of SUBS cells. A network (embeddings of WINDOW tokens a side, one tanh layer) gives, from the context, the
chance of the hidden token's class and, with weights of that class, the chance of its cell inside the class. Counts
give the code's chance inside its cell and, joined by word, a rare word's chance inside its code. A document's score is the sum
of the logarithms over all its tokens.

Training reads every token of every document. Code arrays, cut into pieces that keep their outer context, are dealt
over replicas of about REPLICA_TOKENS by hash, so that each sees the mix of the corpus. Each replica takes
AdaGrad steps in numpy from the round's weights; their sums are combined by slice of the network and the mean starts the
next round. A network has a fixed size, so has what the driver holds. A lost replica is trained again to the same weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sward.llm.common import Text, prefix_hashes, prepare, span_hashes, text_slices
from sward.session import pin

TAIL_BITS = 13
PAD = (1 << 16) - 1
HEAD = PAD - (1 << TAIL_BITS)
# Most words with a code of their own; codes below HEAD.
HEAD_WORDS = HEAD
WINDOW, WIDTH, HIDDEN, CLASSES, SUBS = 2, 8, 16, 32, 32
# Words are ranked by count in steps of one eighth of a doubling; HELD words are counted in a task before it passes counts on.
OCTAVE_STEPS, HELD = 8, 1 << 20
# A rare word's logarithm of its count is summed in units of 2 ** -LOG_BITS, so that no order of summation changes a sum.
LOG_BITS = 32
# Most tokens of one stored piece; tokens that one replica trains on, about; rounds of averaging.
PIECE, REPLICA_TOKENS, ROUNDS = 4096, 4_000_000, 1
# Tokens of one gradient step and AdaGrad's rate.
STEP, RATE = 2048, 0.2
# Tokens scored at a time, embedding rows of one slice of a network, and networks that one task sums.
SCORED, SLICE_ROWS, FAN_IN = 8192, 2048, 256
# Scoring takes weights up to LARGEST in units of 2 ** -UNIT_BITS: sums of WINDOW * 2 * WIDTH products stay below 2 ** 53.
UNIT_BITS, LARGEST = 16, 64.0
# Positions of the context, seen from the hidden token.
AROUND = np.array([o for o in range(-WINDOW, WINDOW + 1) if o])


def token_ids(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word."""
    start, stop, row = text.words()
    return span_hashes(prefix_hashes(text.lowered()), start, stop), row


def codes_of(token: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Place in the sorted ``head`` of its words; a code shared by hash for all others."""
    if not len(head):
        return (HEAD + (token >> np.uint64(64 - TAIL_BITS))).astype(np.uint16)
    at = np.minimum(np.searchsorted(head, token), len(head) - 1)
    return np.where(head[at] == token, at.astype(np.uint64), np.uint64(HEAD) + (token >> np.uint64(64 - TAIL_BITS))).astype(np.uint16)


def padded(ids: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """One sequence of all rows with pads before, between and after them, and each token's place in it."""
    place = np.arange(len(ids)) + WINDOW * (row + 1)
    out = np.full(len(ids) + WINDOW * (rows + 1), PAD, np.uint16)
    out[place] = ids
    return out, place


def _shares(z: np.ndarray) -> np.ndarray:
    """Softmax of the rows, in place."""
    np.clip(z, -40, 40, out=z)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def _exact_share(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Softmax of each row at its target; columns, a power of two, are added in one order, whatever stands beside a row."""
    np.clip(z, -40, 40, out=z)
    np.exp(z, out=z)
    own = z[np.arange(len(z)), target]
    # halves are added to halves: the order is fixed by the number of columns
    while z.shape[1] > 1:
        half = z.shape[1] // 2
        z = z[:, :half] + z[:, half:]
    return own / z[:, 0]


class Network:
    """Weights as float32 arrays; ``parts`` lists them in a fixed order, embeddings first.

    Embeddings, first layer and its bias, class weights and bias, cell weights and bias of each class.
    """

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts
        self.units: list[np.ndarray] | None = None

    @staticmethod
    def fresh(prior: np.ndarray) -> Network:
        """Small random weights; the output biases start at the logarithmic shares of classes and of cells in a class."""
        rng = np.random.default_rng(0)
        inner = WIDTH * len(AROUND)
        embed, first, second, deep = (
            (rng.standard_normal(shape) * s).astype(np.float32)
            for shape, s in (((PAD + 1, WIDTH), 0.3), ((inner, HIDDEN), inner**-0.5), ((HIDDEN, CLASSES), 0.05), ((CLASSES, HIDDEN, SUBS), 0.05))
        )
        share = prior.reshape(CLASSES, SUBS)
        own = share.sum(1)
        out, deep_out = np.log(own).astype(np.float32), np.log(share / own[:, None]).astype(np.float32)
        return Network([embed, first, np.zeros(HIDDEN, np.float32), second, out, deep, deep_out])

    def step(self, squares: list[np.ndarray], context: np.ndarray, cell: np.ndarray) -> None:
        """One AdaGrad step on the mean loss of some tokens."""
        embed, first, bias, second, out, deep, deep_out = self.parts
        n = len(cell)
        # by class, so that each class's tokens meet its weights at once
        order = np.argsort((cell // SUBS).astype(np.uint16), kind="stable")
        cell, context = cell.take(order), context.take(order, axis=0)
        kind, sub = cell // SUBS, cell % SUBS
        ends = np.searchsorted(kind, np.arange(CLASSES + 1))
        spans = [(c, slice(ends[c], ends[c + 1])) for c in range(CLASSES) if ends[c] < ends[c + 1]]
        x = embed.take(context, axis=0).reshape(n, -1)
        hidden = np.tanh(x @ first + bias)
        g, h = hidden @ second + out, deep_out.take(kind, axis=0)
        for c, at in spans:
            h[at] += hidden[at] @ deep[c]
        for z, target in ((_shares(g), kind), (_shares(h), sub)):
            z[np.arange(n), target] -= 1
            z /= n
        back = g @ second.T
        deep_grad, deep_out_grad = np.zeros_like(deep), np.zeros_like(deep_out)
        for c, at in spans:
            back[at] += h[at] @ deep[c].T
            deep_grad[c] = hidden[at].T @ h[at]
            deep_out_grad[c] = h[at].sum(0)
        back *= 1 - hidden * hidden
        gx = (back @ first.T).reshape(-1, WIDTH)
        flat = context.ravel()
        order = np.argsort(flat, kind="stable")
        flat = flat.take(order)
        begin = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        seen = flat[begin]
        gx = np.add.reduceat(gx.take(order, axis=0), begin, axis=0)
        square = squares[0].take(seen, axis=0) + gx * gx
        squares[0][seen] = square
        embed[seen] -= RATE * gx / np.sqrt(square)
        for i, grad in enumerate((x.T @ back, back.sum(0), hidden.T @ g, g.sum(0), deep_grad, deep_out_grad), 1):
            squares[i] += grad * grad
            self.parts[i] -= RATE * grad / np.sqrt(squares[i])

    def cell_chances(self, context: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Chance of each cell given its context, a function of that row alone.

        Weights and hidden values are taken in units of ``2 ** -UNIT_BITS``, so the products are sums of
        integers that double precision holds exactly: no order of summation, and no row beside it,
        changes a row's result.
        """
        if self.units is None:
            chosen = (np.clip(self.parts[i].astype(np.float64), -LARGEST, LARGEST) for i in (0, 1, 3, 5))
            self.units = [np.rint(np.ldexp(p, UNIT_BITS)) for p in chosen]
        embed, first, second, deep = self.units
        bias, out, deep_out = (self.parts[i].astype(np.float64) for i in (2, 4, 6))
        shrink = 2.0 ** (-2 * UNIT_BITS)  # multiplying by a power of two is exact
        order = np.argsort((cell // SUBS).astype(np.uint16), kind="stable")
        own, context = cell.take(order), context.take(order, axis=0)
        kind = own // SUBS
        hidden = embed.take(context, axis=0).reshape(len(context), -1) @ first
        hidden *= shrink
        hidden += bias
        np.tanh(hidden, out=hidden)
        hidden *= 2.0**UNIT_BITS
        np.rint(hidden, out=hidden)
        inner = np.empty((len(own), SUBS))
        ends = np.searchsorted(kind, np.arange(CLASSES + 1))
        for c in range(CLASSES):
            if ends[c] < ends[c + 1]:
                inner[ends[c] : ends[c + 1]] = hidden[ends[c] : ends[c + 1]] @ deep[c]
        outer = hidden @ second
        for z in (outer, inner):
            z *= shrink
        outer += out
        inner += deep_out.take(kind, axis=0)
        chance = _exact_share(outer, kind) * _exact_share(inner, own % SUBS)
        back = np.empty(len(own))
        back[order] = chance
        return back

    def slices(self) -> list[np.ndarray]:
        """The weights as flat arrays of bounded size: runs of embedding rows, then all the rest."""
        embed = self.parts[0]
        runs = [embed[i : i + SLICE_ROWS].ravel() for i in range(0, len(embed), SLICE_ROWS)]
        return [*runs, np.concatenate([p.ravel() for p in self.parts[1:]])]

    def from_slices(self, slices: list[np.ndarray]) -> Network:
        """A network of the same shape with these weights."""
        flat, parts, at = np.concatenate(slices).astype(np.float32), [], 0
        for p in self.parts:
            parts.append(flat[at : at + p.size].reshape(p.shape))
            at += p.size
        return Network(parts)


def cells_of(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each code, logarithm of its chance inside the cell, share of each cell).

    Codes in order of count are cut into cells of about equal sums of root counts. One is added to
    every count, so a code that the corpus lacks has a chance too.
    """
    count, cells = count + 1.0, CLASSES * SUBS
    order = np.argsort(-count, kind="stable")
    root = np.sqrt(count[order])
    cell = np.zeros(len(count), np.int64)
    cell[order] = np.minimum(np.cumsum(root) - root, root.sum() * (1 - 1e-12)) * cells // root.sum()
    mass = np.bincount(cell, weights=count, minlength=cells)
    share = np.maximum(mass, 0.5) / np.maximum(mass, 0.5).sum()
    return cell, np.log(count / mass[cell]), share


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, n): how often each different word stands in the texts, tokens as signed hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def counted():
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

        for batch in batches:
            for _, _, text in text_slices(batch):
                found, times = np.unique(token_ids(text)[0], return_counts=True)
                both, back = np.unique(np.concatenate([token, found]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([n, times]), minlength=len(both)).astype(np.int64)
                token = both
                if len(token) > HELD:
                    yield counted()
                    token, n = token[:0], n[:0]
        yield counted()

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token long, n long")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


def _rank_step(n: str) -> Column:
    return F.floor(F.log2(n) * OCTAVE_STEPS)


class Vocabulary:
    """Codes and their counts from a stored table of word counts.

    ``head`` are the sorted hashes of the most frequent words, whole steps of the count, HEAD_WORDS at most;
    ``count`` holds a sum a code; ``rare`` (token, units) the logarithms of the other words' counts.
    """

    def __init__(self, counted: DataFrame):
        step = _rank_step("n")
        sizes = sorted(counted.groupBy(step.alias("step")).count().collect(), reverse=True)  # some hundred steps
        cut, words = float("inf"), 0
        for r in sizes:
            words += r["count"]
            if words > HEAD_WORDS:
                break
            cut = r["step"]
        often, seldom = counted.filter(step >= cut), counted.filter(step < cut)
        held = often.toPandas()
        token = held["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(token)
        self.head, self.count = token[order], np.zeros(PAD)
        self.count[: len(order)] = held["n"].to_numpy()[order]
        code = F.shiftrightunsigned("token", 64 - TAIL_BITS)
        for r in seldom.groupBy(code.alias("code")).agg(F.sum("n").alias("n")).collect():
            self.count[HEAD + r["code"]] = r["n"]
        self.rare = seldom.select("token", F.round(F.log("n") * 2**LOG_BITS).cast("long").alias("units"))


def pieces(docs: DataFrame, head: np.ndarray, text_col: str = "text") -> DataFrame:
    """(n, ids) of runs of at most PIECE codes of every text, with WINDOW codes or pads on either side."""
    shared = docs.sparkSession.sparkContext.broadcast(head)  # HEAD_WORDS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, text in text_slices(batch):
                token, row = token_ids(text)
                sequence, _ = padded(codes_of(token, shared.value), row, text.rows)
                cut = np.searchsorted(row, np.arange(text.rows + 1))
                spans = [
                    (low + WINDOW * (i + 1), min(low + PIECE, cut[i + 1]) + WINDOW * (i + 1))
                    for i in range(text.rows) for low in range(cut[i], cut[i + 1], PIECE)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b - a for a, b in spans], pa.int64()),
                     pa.array([sequence[a - WINDOW : b + WINDOW].tobytes() for a, b in spans], pa.binary())], names=["n", "ids"],
                )

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n long, ids binary")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum weights of equal (bin, slice); rows come sorted by these, one sum is held at a time."""
    key, total, weight = None, None, 0.0

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([weight]), pa.array([total.tobytes()], pa.binary())],
            names=["bin", "slice", "weight", "sums"],
        )

    for batch in batches:
        for own, part, w, sums in zip(*(batch.column(c) for c in ("bin", "slice", "weight", "sums"))):
            if key != (own.as_py(), part.as_py()):
                if key is not None:
                    yield done()
                key, total, weight = (own.as_py(), part.as_py()), 0.0, 0.0
            total = total + np.frombuffer(sums.as_buffer(), np.float64)
            weight += w.as_py()
    if key is not None:
        yield done()


_SUMS = "bin long, slice int, weight double, sums binary"


def one_round(stored: DataFrame, network: Network, cell: np.ndarray, replicas: int) -> Network:
    """The mean, by tokens, of the networks that the replicas train from ``network``."""
    shared = stored.sparkSession.sparkContext.broadcast((network.parts, cell))  # fixed size, whatever the input

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, cells = shared.value
        own = Network([p.copy() for p in start])
        squares = [np.full(p.shape, 1e-6, np.float32) for p in start]
        seen, number = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column("replica")[0].as_py()
            arrays = [np.frombuffer(ids.as_buffer(), np.uint16) for ids in batch.column("ids")]
            sequence = np.concatenate(arrays)
            target = np.ones(len(sequence), bool)
            ends = np.cumsum([len(a) for a in arrays])
            for o in range(WINDOW):
                target[ends - 1 - o] = False
                target[ends - np.array([len(a) for a in arrays]) + o] = False
            # neighbours in the text meet in one step only by chance
            place = np.random.default_rng(seen).permutation(np.flatnonzero(target))
            for low in range(0, len(place), STEP):
                at = place[low : low + STEP]
                own.step(squares, sequence[at[:, None] + AROUND], cells[sequence[at]])
            seen += len(place)
        if number is not None:
            flat = [s.astype(np.float64) * seen for s in own.slices()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(flat), pa.int64()), pa.array(range(len(flat)), pa.int32()),
                 pa.array([float(seen)] * len(flat)), pa.array([s.tobytes() for s in flat], pa.binary())],
                names=["bin", "slice", "weight", "sums"],
            )

    # the partition of a piece is its replica; the order inside is set by the pieces alone
    dealt = stored.withColumn("turn", F.xxhash64("ids")).withColumn("replica", F.pmod("turn", F.lit(replicas)))
    trained = pin(
        dealt.repartitionById(replicas, F.col("replica").cast("int")).sortWithinPartitions("turn")
        .select("replica", "ids").mapInArrow(train, _SUMS)
    )
    count = replicas
    while count > 1:
        count = -(-count // FAN_IN)
        binned = trained.withColumn("part", F.col("bin")).withColumn("bin", F.pmod("part", F.lit(count)))
        trained = pin(
            binned.repartition("bin", "slice").sortWithinPartitions("bin", "slice", "part").drop("part").mapInArrow(_sums, _SUMS)
        )
    means = {r["slice"]: np.frombuffer(r["sums"], np.float64) / r["weight"] for r in trained.collect()}
    shared.unpersist()
    return network.from_slices([means[i] for i in sorted(means)]) if means else network


def train(
    docs: DataFrame, rounds: int = ROUNDS, replica_tokens: int = REPLICA_TOKENS
) -> tuple[Network, np.ndarray, np.ndarray, Vocabulary]:
    """(network, cell of each code, logarithm of its chance inside the cell, vocabulary), from all texts of ``docs``."""
    prepare(docs.sparkSession)
    words = Vocabulary(pin(word_counts(docs)))
    cell, inside, share = cells_of(words.count)
    network = Network.fresh(share)
    replicas = max(1, round(words.count.sum() / replica_tokens))
    if words.count.sum() and rounds:
        stored = pin(pieces(docs, words.head))
        for _ in range(rounds):
            network = one_round(stored, network, cell, replicas)
    return network, cell, inside, words


def log_chances(network: Network, cell: np.ndarray, inside: np.ndarray, sequence: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Logarithm of the chance of each code at ``place``, given its neighbours."""
    out = np.empty(len(place))
    for low in range(0, len(place), SCORED):
        at = place[low : low + SCORED]
        code = sequence[at]
        chance = network.cell_chances(sequence[at[:, None] + AROUND], cell[code])
        out[low : low + len(at)] = np.log(np.maximum(chance, 1e-30)) + inside[code]
    return out


def score_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, log_likelihood (sum over the tokens), mean_log_likelihood.

    Texts without a word, empty or null, have no tokens, a sum of 0 and a null mean. Equal texts get
    equal scores; repeated rows stay. An empty table gives an empty result. Only id and text are
    read. Training sees all texts, so the same rows always give the same network.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    network, cell, inside, words = train(source)
    # a rare word's chance inside its code is its count, joined below, over the code's
    inside = inside.copy()
    inside[HEAD:] -= np.log(np.maximum(words.count[HEAD:], 1))
    shared = docs.sparkSession.sparkContext.broadcast((network.parts, cell, inside, words.head))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, cells, within, head = shared.value
        own = Network(parts)
        for batch in batches:
            for low, high, text in text_slices(batch):
                token, row = token_ids(text)
                code = codes_of(token, head)
                chance = log_chances(own, cells, within, *padded(code, row, text.rows))
                n = np.bincount(row, minlength=text.rows)
                total = np.bincount(row, weights=chance, minlength=text.rows)
                seldom = code >= HEAD
                ends = np.concatenate(([0], np.cumsum(np.bincount(row[seldom], minlength=text.rows))))
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(token[seldom].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(low, high - low) for c in ("row", "doc_id")), pa.array(n, pa.int64()), pa.array(total), rare],
                    names=["row", "doc_id", "n_tokens", "known", "rare"],
                )

    fields = [T.StructField("row", T.LongType()), source.schema["doc_id"], T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("known", T.DoubleType()), T.StructField("rare", T.ArrayType(T.LongType()))]
    rows = source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scored = pin(rows.mapInArrow(run, T.StructType(fields)))
    seldom = (
        scored.select("row", F.explode("rare").alias("token")).join(words.rare, "token")
        .groupBy("row").agg((F.sum("units") / 2**LOG_BITS).alias("more"))
    )
    total = F.col("known") + F.coalesce("more", F.lit(0.0))
    return scored.join(seldom, "row", "left").select(
        "doc_id", "n_tokens", total.alias("log_likelihood"),
        F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"),
    )

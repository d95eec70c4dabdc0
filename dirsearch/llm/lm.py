"""Language-model scoring with a gated recurrent network and a class-factored softmax.

Tokens are words (A-Z lowered) and one end a text.  Counts of all training tokens come first: the base model needs them,
and they define the vocabulary.  The ``VOCABULARY`` most frequent tokens are in classes of ``CLASS`` words by frequency;
all others share one class, the rest class.  The network's probability of a token is

    P(class | state) * P(word | class, state)    for words of the vocabulary,
    P(rest class | state) * (c + 0.5) / Z        for others, from the same counts, with Z the sum over all others.

The network (gated recurrent units, in numpy) is trained by truncated backpropagation: windows of ``WINDOW`` tokens, the
state carried on from window to window.  Every training document is read, once at least: a round takes a part of them,
which is dealt to trainers, each of which trains on its share, and their weights are averaged after every round.  Where
one pass is short of ``LEAST_TOKENS`` a round, a round takes several parts, up to all of them in every round.
Scoring reads whole documents, many side by side in lanes, with the state carried across windows.

Counts of frequent tokens (at most ``FREQUENT``, by a cut-off from a histogram of counts) are broadcast; other tokens meet their counts in a join by hash.

Defined results: null and empty texts are an end only; null ids train (their id as text is empty); rows that are equal
score alike; without training documents the vocabulary is empty and N is 0; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirsearch.llm import flat
from dirsearch.llm.quality_rules import bucket
from dirsearch.llm.registry import register, table
from dirsearch.llm.store import written

CLASS, CLASSES = 64, 63
VOCABULARY = CLASS * CLASSES
FREQUENT = 1 << 16  # tokens, at most, whose counts are broadcast: 1 MB; a step of the counts' histogram goes in whole or not at all
EMBED, HIDDEN = 16, 24
LANES, WINDOW = 128, 16
SCORE_LANES, SCORE_WINDOW = 256, 32
SOFTMAX_TOKENS = 1 << 13  # whose classes and words are looked up together
SCORE_BYTES = 4 << 20  # of text that are scored side by side
LEAST_TOKENS = 500_000  # that a round trains on, if the corpus has them: small corpora are read up to ROUNDS times
TRAINER_TOKENS, TRAINERS, ROUNDS, FAN_IN = 400_000, 6, 4, 16
RATE = 0.01
COUNT_WORDS = 1 << 21  # words that are counted together before they leave a task
END = np.uint64(0x1D8E4E27C47D124F)  # stands for the hash of the end


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text, ends included, and offsets of the texts."""
    buf = flat.lower(buf)
    s, e, row = flat.words(buf, offs)
    n = len(offs) - 1
    bounds = flat.row_bounds(row, n) + np.arange(n + 1)
    h = np.full(len(s) + n, END, np.uint64)
    h[np.arange(len(s)) + row] = flat.span_hash(buf, s, e)
    return h, bounds


def counted(texts: DataFrame) -> DataFrame:
    """(h, c): how often each token stands in the one text column of texts."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("c", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(flat.signed(h)), pa.array(c)], names=["h", "c"])

        for b in batches:
            for _, _, buf, offs in flat.chunks(b.column(0)):
                h, _ = tokens(buf, offs)
                held.append(h)
                size += len(h)
                if size >= COUNT_WORDS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return texts.mapInArrow(run, schema).groupBy("h").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The frequent tokens, most frequent first, and the sums over all."""

    def __init__(self, h: np.ndarray, c: np.ndarray, total: int, distinct: int):
        self.c, self.total, self.distinct = c, total, distinct
        self.size = min(len(h), VOCABULARY)
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        self.base_log = np.log10(total + 0.5 * (distinct + 1))
        self.rest_log = np.log10(total - int(c[: self.size].sum()) + 0.5 * (distinct - self.size + 1))
        self.logs = np.log10(c + 0.5)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the tokens by frequency, -1 for those that are not among the frequent ones."""
        if not len(self.sorted):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1)

    def ids(self, found: np.ndarray) -> np.ndarray:
        """Network ids: the number within the vocabulary; VOCABULARY for the rest."""
        return np.where((found >= 0) & (found < self.size), found, VOCABULARY)


def initial(v: Vocabulary, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights that start as the class-factored unigram model of the counts."""
    rng = np.random.default_rng(seed)
    c = np.zeros(VOCABULARY)
    c[: v.size] = v.c[: v.size]
    by_class = np.append(c.reshape(CLASSES, CLASS).sum(1), v.total - c.sum())
    word_bias = np.full(VOCABULARY, -30.0)  # for places that no word has
    word_bias[: v.size] = np.log(c[: v.size])
    p = {"embed": rng.normal(0, 0.1, (VOCABULARY + 1, EMBED)), "wx": rng.normal(0, EMBED**-0.5, (EMBED, 3 * HIDDEN)),
         "wh": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), "b": np.zeros(3 * HIDDEN), "start": np.zeros(HIDDEN),
         "class_w": rng.normal(0, 0.05, (CLASSES + 1, HIDDEN)), "class_b": np.where(by_class > 0, np.log(np.maximum(by_class, 0.5)), -8.0),
         "word_w": rng.normal(0, 0.05, (CLASSES, CLASS, HIDDEN)), "word_b": word_bias.reshape(CLASSES, CLASS)}
    p["class_b"] -= p["class_b"].max()
    p["word_b"] -= p["word_b"].max(1, keepdims=True)
    return {k: x.astype(np.float32) for k, x in p.items()}


def _gate_weights(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the state and of the input and the bias, with a row a gate, those of z and r negated for ``_step``."""
    sign = np.ones((3 * HIDDEN, 1), p["wh"].dtype)
    sign[: 2 * HIDDEN] = -1
    return sign * p["wh"].T, sign * p["wx"].T, sign * p["b"][:, None]


def _step(h: np.ndarray, x: np.ndarray, wh: np.ndarray, a: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
    """One gated recurrent step from the state and the input's share of the gates, all with a column a lane: the gates are
    then blocks of memory.  Fills a (z, r and the state's share of n), n and out, the state after the step."""
    np.dot(wh, h, out=a)
    gates = a[: 2 * HIDDEN]
    gates += x[: 2 * HIDDEN]
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[HIDDEN:], a[2 * HIDDEN :], out=n)
    n += x[2 * HIDDEN :]
    np.tanh(n, out=n)
    np.subtract(h, n, out=out)
    out *= gates[:HIDDEN]
    out += n


def _gate_inputs(wx: np.ndarray, b: np.ndarray, emb: np.ndarray) -> np.ndarray:
    """(steps, 3 * HIDDEN, lanes): the inputs' share of the gates."""
    x = np.matmul(wx, emb.transpose(0, 2, 1))
    x += b
    return x


def _with_bias(p: dict[str, np.ndarray], side: str) -> np.ndarray:
    """The weights of classes or words with their bias as a last column, for states that end in 1."""
    return np.concatenate([p[f"{side}_w"], p[f"{side}_b"][..., None]], axis=-1)


def _ranged(x: np.ndarray) -> np.ndarray:
    """x, if exp can take it as it is; else each row less its largest number, in place."""
    if len(x) and not (x.max() < 60 and x[:, 0].min() > -60):
        x -= x[np.arange(len(x)), x.argmax(1)][:, None]
    return x


def _softmax(x: np.ndarray, share: float = 1.0) -> np.ndarray:
    """Rows that sum up to share, in place."""
    np.exp(_ranged(x), out=x)
    x *= share / (x @ np.ones((x.shape[1], 1), x.dtype))
    return x


def _picked(logit: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of the softmax of each row at one place; takes logit for its work."""
    got = _ranged(logit)[np.arange(len(at)), at]
    np.exp(logit, out=logit)
    return got - np.log(logit @ np.ones(logit.shape[1], logit.dtype))


def _classes(tok: np.ndarray) -> list[tuple[int, int, int]]:
    """(class, first, end) of the classes of words in sorted tokens; the rest class comes after them."""
    edges = np.searchsorted(tok, CLASS * np.arange(CLASSES + 1)).tolist()
    return [(c, a, b) for c, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]


def _word_logits(hid: np.ndarray, words: np.ndarray, classes: list[tuple[int, int, int]]) -> np.ndarray:
    """Of the words of each token's class; words of the vocabulary stand side by side by class."""
    q = np.empty((classes[-1][2] if classes else 0, CLASS), hid.dtype)
    for c, a, b in classes:
        np.dot(hid[a:b], words[c].T, out=q[a:b])
    return q


def _lanes(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Texts dealt to lanes, long ones first, each to the lane that is shortest."""
    heap, out = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (n + int(lengths[i]), k))
    return out


def _grid(bounds: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps, lanes): token numbers (-1: none) and whether a text starts there."""
    dealt = _lanes(np.diff(bounds), lanes)
    rows = [np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in lane]) if lane else np.zeros(0, np.int64) for lane in dealt]
    rows.sort(key=len, reverse=True)  # so that the lanes that still go on are the first ones
    grid = np.full((max(map(len, rows)), lanes), -1, np.int64)
    for k, r in enumerate(rows):
        grid[: len(r), k] = r
    starts = np.zeros(bounds[-1] + 1, bool)
    starts[bounds[:-1]] = True
    return grid, starts[grid] & (grid >= 0)


def _stream(bounds: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """The grid of training: all texts in a row, cut into lanes of one length, so that a long text holds no lane up.
    A text that a cut goes through starts its second lane without a state; none of its tokens is left out."""
    total = int(bounds[-1])
    steps = -(-total // lanes)
    grid = np.arange(steps * lanes).reshape(lanes, steps).T
    grid = np.where(grid < total, grid, -1)
    starts = np.zeros(total + 1, bool)
    starts[bounds[:-1]] = True
    return grid, starts[grid] & (grid >= 0)


def _log_softmax(by_class: np.ndarray, words: np.ndarray, hid: np.ndarray, tok: np.ndarray) -> np.ndarray:
    """Of each of sorted tokens the log of its class's probability and, for words of the vocabulary, of the word's in it."""
    got = _picked(hid @ by_class.T, tok // CLASS)
    q = _word_logits(hid, words, _classes(tok))
    got[: len(q)] += _picked(q, tok[: len(q)] % CLASS)
    return got


def log10_probabilities(p: dict[str, np.ndarray], ids: np.ndarray, bounds: np.ndarray, lanes: int = SCORE_LANES, window: int = SCORE_WINDOW) -> np.ndarray:
    """For each token log10 of its class's probability, and for words of the vocabulary also of the word's."""
    out = np.zeros(len(ids))
    if not len(ids):
        return out
    lanes = min(lanes, len(bounds) - 1)
    grid, starts = _grid(bounds, lanes)
    kind = p["wh"].dtype
    wh, wx, b = _gate_weights(p)
    by_class, words = _with_bias(p, "class"), _with_bias(p, "word")
    h = np.zeros((HIDDEN, lanes), kind)
    start = p["start"][:, None]
    held, size = [], 0
    with np.errstate(over="ignore"):  # a gate's exp may be infinite, the gate is then 0
        for lo in range(0, len(grid), window):
            n = int(np.count_nonzero(grid[lo] >= 0))
            g, s = grid[lo : lo + window, :n], starts[lo : lo + window, :n]
            new = s.any(axis=1).tolist()
            x = _gate_inputs(wx, b, p["embed"][ids[np.maximum(g, 0)]])
            states, a, inner = np.empty((len(g) + 1, HIDDEN, n), kind), np.empty((3 * HIDDEN, n), kind), np.empty((HIDDEN, n), kind)
            states[0] = h[:, :n]
            for t in range(len(g)):
                if new[t]:
                    states[t][:, s[t]] = start
                _step(states[t], x[t], wh, a, inner, states[t + 1])
            h = states[-1]
            live = g >= 0
            held.append((states[:-1].transpose(0, 2, 1)[live], g[live]))
            size += len(held[-1][1])
            if size >= SOFTMAX_TOKENS or lo + window >= len(grid):  # windows of few lanes share one product a class
                at = np.concatenate([x[1] for x in held])
                tok = ids[at]
                order = np.argsort(tok.astype(np.uint16), kind="stable")
                hid = np.ones((len(at), HIDDEN + 1), kind)
                hid[:, :HIDDEN] = np.concatenate([x[0] for x in held])[order]
                out[at[order]] = _log_softmax(by_class, words, hid, tok[order])
                held, size = [], 0
    out /= np.log(10)
    return out


def _window_gradients(p: dict[str, np.ndarray], tok: np.ndarray, live: np.ndarray, starts: np.ndarray, h: np.ndarray,
                      grad: dict[str, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of one window's mean loss (into grad, if given: zeros), back through the window only, and the state after it."""
    steps, lanes = tok.shape
    kind = p["wh"].dtype
    grad = grad or {k: np.zeros_like(w) for k, w in p.items()}
    wh, wx, b = _gate_weights(p)
    emb = p["embed"][tok]
    x = _gate_inputs(wx, b, emb)
    states, a, n = np.empty((steps + 1, HIDDEN, lanes), kind), np.empty((steps, 3 * HIDDEN, lanes), kind), np.empty((steps, HIDDEN, lanes), kind)
    states[0] = h.T
    new = starts.any(axis=1).tolist()
    with np.errstate(over="ignore"):  # a gate's exp may be infinite, the gate is then 0
        for t in range(steps):
            if new[t]:
                states[t][:, starts[t]] = p["start"][:, None]
            _step(states[t], x[t], wh, a[t], n[t], states[t + 1])
    before = states[:steps]
    # tokens in sorted order are in the order of their classes, too
    every = tok.reshape(-1)
    order = np.argsort(every.astype(np.uint16), kind="stable")
    alive = order if live.all() else order[live.reshape(-1)[order]]
    y, total = every[alive], max(1, len(alive))
    hid = np.ones((len(y), HIDDEN + 1), kind)
    hid[:, :HIDDEN] = before.transpose(0, 2, 1).reshape(-1, HIDDEN)[alive]
    d = _softmax(hid @ _with_bias(p, "class").T, 1 / total)
    d[np.arange(len(y)), y // CLASS] -= 1 / total
    slopes = d.T @ hid
    grad["class_w"][...], grad["class_b"][...] = slopes[:, :HIDDEN], slopes[:, HIDDEN]
    dhid = d @ p["class_w"]
    classes = _classes(y)
    q = _softmax(_word_logits(hid, _with_bias(p, "word"), classes), 1 / total)
    q[np.arange(len(q)), y[: len(q)] % CLASS] -= 1 / total
    slopes, back = np.zeros((CLASSES, CLASS, HIDDEN + 1), kind), np.empty((len(q), HIDDEN), kind)
    for c, lo, hi in classes:
        np.dot(q[lo:hi].T, hid[lo:hi], out=slopes[c])
        np.dot(q[lo:hi], p["word_w"][c], out=back[lo:hi])
    grad["word_w"][...], grad["word_b"][...] = slopes[..., :HIDDEN], slopes[..., HIDDEN]
    dhid[: len(q)] += back
    rows = np.zeros((steps * lanes, HIDDEN), kind)
    rows[alive] = dhid
    dbefore = np.ascontiguousarray(rows.reshape(steps, lanes, HIDDEN).transpose(0, 2, 1))
    # the factors of the slopes that do not depend on later steps, of all steps at once
    z, r = a[:, :HIDDEN], a[:, HIDDEN : 2 * HIDDEN]
    left = 1 - z
    to_z = before - n
    to_z *= z
    to_z *= left
    to_n = n * n
    np.subtract(1, to_n, out=to_n)
    to_n *= left
    to_r = np.subtract(1, r, out=left)
    to_r *= r
    to_r *= a[:, 2 * HIDDEN :]
    dh = np.zeros((HIDDEN, lanes), kind)
    da, dn = np.empty_like(a), np.empty_like(n)
    for t in range(steps - 1, -1, -1):
        np.multiply(dh, to_n[t], out=dn[t])
        np.multiply(dh, to_z[t], out=da[t, :HIDDEN])
        np.multiply(dn[t], to_r[t], out=da[t, HIDDEN : 2 * HIDDEN])
        np.multiply(dn[t], r[t], out=da[t, 2 * HIDDEN :])
        dh *= z[t]
        dh += np.dot(p["wh"], da[t])
        dh += dbefore[t]
        if new[t]:
            grad["start"] += dh[:, starts[t]].sum(1)
            dh[:, starts[t]] = 0
    grad["wh"][...] = np.matmul(before, da.transpose(0, 2, 1)).sum(0)
    da[:, 2 * HIDDEN :] = dn
    dx = da.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)
    grad["wx"][...], grad["b"][...] = emb.reshape(-1, EMBED).T @ dx, dx.sum(0)
    demb = dx @ p["wx"].T
    of = every[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    grad["embed"][of[first]] += np.add.reduceat(demb[order], first, axis=0)
    return grad, states[steps].T


def train(p: dict[str, np.ndarray], ids: np.ndarray, bounds: np.ndarray, rate: float = RATE) -> dict[str, np.ndarray]:
    """One pass over some texts by Adam."""
    if not len(ids):
        return p
    ends = np.cumsum([0, *(w.size for w in p.values())])
    views = lambda all_: {k: all_[a:b].reshape(w.shape) for (k, w), a, b in zip(p.items(), ends, ends[1:])}
    weights = np.concatenate([w.ravel() for w in p.values()])
    slope, first, second, free = (np.zeros_like(weights) for _ in range(4))
    net, grad = views(weights), views(slope)
    grid, starts = _stream(bounds, min(LANES, max(1, len(ids) // (4 * WINDOW))))
    h = np.zeros((grid.shape[1], HIDDEN), np.float32)
    for step, lo in enumerate(range(0, len(grid), WINDOW), 1):
        g = grid[lo : lo + WINDOW]
        slope.fill(0)
        _, h = _window_gradients(net, ids[np.maximum(g, 0)], g >= 0, starts[lo : lo + WINDOW], h, grad)
        slope *= min(1.0, 1.0 / (float(np.sqrt(slope @ slope)) + 1e-9))
        first *= 0.9  # all in place: the weights are few, but they are touched in every window
        first += np.multiply(slope, 0.1, out=free)
        second *= 0.99
        slope *= slope
        second += np.multiply(slope, 0.01, out=free)
        np.sqrt(second, out=free)
        free *= (1 - 0.99**step) ** -0.5
        free += 1e-7
        np.divide(first, free, out=free)
        free *= rate / (1 - 0.9**step)
        weights -= free
    return {k: w.copy() for k, w in net.items()}


def _averaged(rows: list[tuple[int, bytes]]) -> tuple[int, bytes]:
    total = sum(n for n, _ in rows)
    sums: dict[str, np.ndarray] = {}
    for n, b in rows:
        for k, w in pickle.loads(b).items():
            sums[k] = sums.get(k, 0) + w * np.float32(n / max(1, total))
    return total, pickle.dumps(sums)


def passes(total: int, rounds: int = ROUNDS) -> int:
    """How often each of total training tokens is read: once at least, more often where that gives too few a round."""
    return min(rounds, max(1, -(-LEAST_TOKENS * rounds // max(1, total))))


def trained(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The network after rounds of training on all training documents."""
    spark = docs.sparkSession
    p = initial(v)
    if not v.total:
        return p
    times = passes(v.total, rounds)
    trainers = max(TRAINERS, v.total * times // rounds // TRAINER_TOKENS)
    mixed = F.xxhash64(F.lit(17), "doc_id", "text")
    part = F.pmod(F.xxhash64(F.lit(18), "doc_id", "text"), F.lit(rounds))  # a document is in times rounds, from its part on
    texts = docs.where(~held_out()).select(F.coalesce("text", F.lit("")).alias("text"), mixed.alias("m"), part.alias("part"))
    rows = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("w", T.BinaryType())])
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((p, v))

        def run(key: tuple, share: pa.Table, *, rate: float = RATE * (1 - k / rounds)) -> pa.Table:
            start, voc = shared.value
            share = share.sort_by([("m", "ascending"), ("text", "ascending")])
            ids, ends = [], [np.zeros(1, np.int64)]
            for _, _, buf, offs in flat.chunks(share.column("text")):
                h, bounds = tokens(buf, offs)
                ids.append(voc.ids(voc.find(h)))
                ends.append(bounds[1:] + ends[-1][-1])
            w = train(start, np.concatenate(ids), np.concatenate(ends), rate)
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([int(ends[-1][-1])], pa.int64()), pa.array([pickle.dumps(w)], pa.binary())],
                            names=rows.names)

        chosen = texts.where(F.pmod(F.lit(k) - F.col("part"), F.lit(rounds)) < times).drop("part")
        weights = chosen.withColumn("at", F.pmod(F.hash("m"), F.lit(trainers))).groupBy("at").applyInArrow(run, rows)
        most = trainers - 1  # one row a trainer, however many tasks the session makes of them
        while most:  # averages of averages of FAN_IN rows at most; one row reaches the driver
            weights = weights.groupBy(F.expr(f"at div {FAN_IN}")).applyInPandas(_average_rows, rows)
            most //= FAN_IN
        got = weights.first()
        p = pickle.loads(got.w) if got else p  # a round of a few documents may have none
    return p


def _average_rows(rows: pd.DataFrame) -> pd.DataFrame:
    n, w = _averaged(list(zip(rows["n"].tolist(), rows["w"])))
    return pd.DataFrame({"at": [int(rows["at"].iloc[0]) // FAN_IN], "n": [n], "w": [w]})


def partial_scores(docs: DataFrame, p: dict[str, np.ndarray], v: Vocabulary) -> DataFrame:
    """Of each document (doc_id, text): what the network and the frequent tokens give, and its other tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((p, v))
    longs, double = T.LongType(), T.DoubleType()
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", longs), T.StructField("known", longs), T.StructField("base", double),
                           T.StructField("score", double), T.StructField("h", T.ArrayType(longs)), T.StructField("m", T.ArrayType(longs))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, voc = shared.value
        for b in batches:
            for lo, hi, buf, offs in flat.chunks(b.column(1), SCORE_BYTES):
                h, bounds = tokens(buf, offs)
                n = hi - lo
                row = np.repeat(np.arange(n), np.diff(bounds))
                found = voc.find(h)
                ids = voc.ids(found)
                per = lambda w: np.bincount(row, weights=w, minlength=n)
                logs = np.where(found >= 0, voc.logs[np.maximum(found, 0)] if len(voc.logs) else 0.0, 0.0)
                rest = ids == VOCABULARY
                base = per(logs) - np.diff(bounds) * voc.base_log
                score = per(log10_probabilities(net, ids, bounds)) + per(np.where(rest, logs - voc.rest_log, 0.0))
                other = found < 0
                order = np.lexsort((h[other], row[other]))
                oh, orow = h[other][order], row[other][order]
                first = np.ones(len(oh), bool)
                first[1:] = (oh[1:] != oh[:-1]) | (orow[1:] != orow[:-1])
                at = np.flatnonzero(first)
                many = np.diff(np.append(at, len(oh)))
                ends = pa.array(flat.row_bounds(orow[at], n), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), pa.array(np.diff(bounds)), pa.array(per(~other).astype(np.int64)), pa.array(base), pa.array(score),
                     pa.ListArray.from_arrays(ends, pa.array(flat.signed(oh[at]))), pa.ListArray.from_arrays(ends, pa.array(many.astype(np.int64)))],
                    names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From all counts: their sums, and the largest, FREQUENT at most (the end is always among them).  A histogram of the
    counts, some 2,000 rows at most, gives the least count that still goes in, so no task or driver ranks the tokens."""
    steps = counts.groupBy(bucket(F.col("c")).alias("b")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    total, distinct = sum(r.c for r in steps), sum(r.n for r in steps)
    end = F.col("h") == int(flat.signed(np.array([END]))[0])
    above, least = 1, 0  # the end comes along in any case
    for r in sorted(steps, key=lambda r: -r.b):
        above += r.n
        if above > FREQUENT:
            least = r.b + 1
            break
    top = counts.where((bucket(F.col("c")) >= least) | end).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.lexsort((h, -c))
    if len(h) > VOCABULARY:  # the end is in the vocabulary, too
        at = int(np.flatnonzero(h[order] == END)[0])
        if at >= VOCABULARY:
            order = np.insert(np.delete(order, at), VOCABULARY - 1, order[at])
    return Vocabulary(h[order], c[order], int(total), int(distinct))


def scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """The contract's columns for every document."""
    docs = docs.select("doc_id", F.col(f"`{text}`").cast("string").alias("text"))
    counts = written(counted(docs.where(~held_out()).select("text")), "lm-counts")
    v = vocabulary(counts)
    net = trained(docs, v)
    parts = written(partial_scores(docs, net, v).select(F.monotonically_increasing_id().alias("rid"), "*"), "lm-parts")
    others = parts.select("rid", F.explode(F.arrays_zip("h", "m")).alias("x")).select("rid", "x.h", "x.m")
    met = others.join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = met.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("known_more"),
                                  F.sum(F.col("m") * F.log10(F.col("c") + 0.5)).alias("logs"), F.sum("m").alias("others"))
    joined = parts.drop("h", "m").join(more, "rid", "left").na.fill(0, ["known_more", "others"]).na.fill(0.0, ["logs"])
    return joined.select("doc_id", held_out().alias("held_out"), "n_tokens", (F.col("known") + F.col("known_more")).alias("n_known"),
                         F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base") + F.col("logs")).alias("base_score"),
                         (F.col("score") + F.col("logs")).alias("score"))


@register("op2_lm_score")
def op2_lm_score(spark, sf_dir):
    return scores(table(spark, sf_dir, "documents"))

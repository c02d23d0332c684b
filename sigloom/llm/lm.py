"""Gated recurrent language model over words.

The output softmax is factored: a class given the state, then a word given the class and the state. Words outside the model's
vocabulary form a last class, within which a word has its smoothed share of the training counts. Weights are fitted by truncated
backpropagation in numpy, by every task on its part of the training texts; tasks' weights are averaged after each round. A
text is scored whole: the state runs across windows from its first word to its end.
"""

from __future__ import annotations

import heapq
import io
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import SLICE, cut, slices, small_batches, word_hashes

#: The model's vocabulary, its classes of words, the state, and the words whose counts every task holds (rarer ones are joined).
VOCABULARY, CLASSES, HIDDEN, HEAD = 2000, 44, 16, 100_000
#: Rounds of averaging: every training document is learnt from in one of them.
ROUNDS = 2
#: Tokens of a part of a round, in expectation, while there are at most PARTS of them; parts are larger beyond.
PART, PARTS = 1_000_000, 4096
LANES, WINDOW = 256, 24
#: Words of a text that are one sequence in training. Scores carry the state through whole texts.
PIECE = 1024
#: Tokens that are learnt from at once, and states whose softmax is worked out at once.
CHUNK, SETTLE = 1_000_000, 16_384
END = "\n"  # the end's token: no word holds white space
FOLDS, HELD = 7, 2


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END.encode()]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


class Gru:
    """Weights by name: x (row of each word, of any other and of a text's start: the input to the gates), u, c and its bias (classes), w and b (words)."""

    NAMES = ("x", "u", "c", "cb", "w", "b")

    def __init__(self, counts: np.ndarray, outside: int, seed: int = 3):
        """counts: of the vocabulary's words, most frequent first; outside: the count of all other words."""
        v = len(counts)
        mass = np.cumsum(counts + 1.0)
        word_class = np.minimum((mass - (counts + 1.0)) * min(CLASSES, v) // max(1.0, mass[-1]), min(CLASSES, v) - 1).astype(int) if v else np.zeros(0, int)
        self.word_class = np.unique(word_class, return_inverse=True)[1] if v else word_class
        k = int(self.word_class.max()) + 1 if v else 0
        self.first = np.searchsorted(self.word_class, np.arange(k + 1))
        rng = np.random.default_rng(seed)
        h = HIDDEN
        own = np.log(counts + 1.0)
        self.weights = {
            "x": rng.normal(0, 0.1, (v + 2, 3 * h)), "u": rng.normal(0, 1 / math.sqrt(h), (h, 3 * h)),
            "c": np.zeros((h, k + 1)), "cb": np.log(np.append(np.bincount(self.word_class, counts + 1.0, k), outside + 1.0)), "w": np.zeros((v, h)), "b": own,
        }
        self.weights = {n: a.astype(np.float32) for n, a in self.weights.items()}

    @property
    def k(self) -> int:
        return len(self.first) - 1

    def gates(self, word: np.ndarray) -> np.ndarray:
        """The words' inputs to the gates. word: indices, len(vocabulary) for any other word; -1, the last row, at a text's start."""
        return self.weights["x"][word]

    def step(self, h: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both sigmoid gates side by side, the state after the reset, and the candidate. a: the words' inputs."""
        n, u = HIDDEN, self.weights["u"]
        zr = _sigmoid(a[:, : 2 * n] + h @ u[:, : 2 * n])
        rh = zr[:, n:] * h
        return zr[:, :n], zr[:, n:], rh, np.tanh(a[:, 2 * n :] + rh @ u[:, 2 * n :])

    def kinds(self, target: np.ndarray) -> np.ndarray:
        """Classes of words; the last one is that of words outside the vocabulary."""
        return np.append(self.word_class, self.k).astype(np.int16)[target]

    def log_probs(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logs of P(class) * P(word | class); of other words P(last class) only."""
        w, across = self.weights, np.arange(len(target))
        kinds = self.kinds(target)
        logits = w["c"].T @ states.T
        logits += w["cb"][:, None]
        logits -= logits.max(0)
        own = logits[kinds, across]
        out = (own - np.log(np.exp(logits, out=logits).sum(0))).astype(np.float64)
        order = np.argsort(kinds, kind="stable")
        ends = np.searchsorted(kinds[order], np.arange(self.k + 1))
        for c in range(self.k):
            rows, a, b = order[ends[c] : ends[c + 1]], self.first[c], self.first[c + 1]
            if len(rows) and b - a > 1:
                s = w["w"][a:b] @ states[rows].T
                s += w["b"][a:b, None]
                s -= s.max(0)
                own = s[target[rows] - a, across[: len(rows)]]
                out[rows] += own - np.log(np.exp(s, out=s).sum(0))
        return out

    def gradients(self, h: np.ndarray, word: np.ndarray, target: np.ndarray, live: np.ndarray, fresh: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Of the mean loss over a window (steps, lanes), from states h: backpropagation that ends at the window's start."""
        w, n, (steps, width) = self.weights, HIDDEN, word.shape
        anew = fresh.any(1)
        inputs = self.gates(word)
        old, z, r, rh, cand, states = np.empty((6, steps, width, n), h.dtype)
        for t in range(steps):
            if anew[t]:
                h = np.where(fresh[t][:, None], h.dtype.type(0), h)
            old[t] = h
            z[t], r[t], rh[t], cand[t] = self.step(h, inputs[t])
            h = h + z[t] * (cand[t] - h)
            states[t] = h
        s = states.reshape(-1, n)
        goal, on = target.ravel(), live.ravel()
        total, across = max(1, int(on.sum())), np.arange(steps * width)
        kinds = self.kinds(goal)
        p = w["c"].T @ s.T
        p += w["cb"][:, None]
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        loss = -np.log(p[kinds, across] + 1e-12)[on].sum()
        p[kinds, across] -= 1
        if total < len(on):
            p[:, ~on] = 0
        g = {"c": s.T @ p.T, "cb": p.sum(1), "w": np.zeros_like(w["w"]), "b": np.zeros_like(w["b"]), "x": np.zeros_like(w["x"]), "u": np.empty_like(w["u"])}
        ds = (w["c"] @ p).T
        kinds = np.where(on, kinds, np.int16(self.k + 1))
        order = np.argsort(kinds, kind="stable")
        ends = np.searchsorted(kinds[order], np.arange(self.k + 1))
        for c in range(self.k):
            rows, a, b = order[ends[c] : ends[c + 1]], self.first[c], self.first[c + 1]
            if len(rows) and b - a > 1:
                own = s[rows]
                q = w["w"][a:b] @ own.T
                q += w["b"][a:b, None]
                q -= q.max(0)
                np.exp(q, out=q)
                q /= q.sum(0)
                at = goal[rows] - a
                loss -= np.log(q[at, across[: len(rows)]] + 1e-12).sum()
                q[at, across[: len(rows)]] -= 1
                g["w"][a:b] = q @ own
                g["b"][a:b] = q.sum(1)
                ds[rows] += q.T @ w["w"][a:b]
        ds = np.ascontiguousarray(ds).reshape(steps, width, n)
        to_cand, to_z, to_r, stay = z * (1 - cand * cand), (cand - old) * z * (1 - z), old * r * (1 - r), 1 - z
        back, gates = np.zeros_like(h), np.empty((steps, width, 3 * n), h.dtype)
        first, last = np.ascontiguousarray(w["u"][:, : 2 * n].T), np.ascontiguousarray(w["u"][:, 2 * n :].T)
        for t in range(steps - 1, -1, -1):
            d = ds[t] + back
            now = gates[t]
            now[:, 2 * n :] = d * to_cand[t]
            drh = now[:, 2 * n :] @ last
            now[:, :n] = d * to_z[t]
            now[:, n : 2 * n] = drh * to_r[t]
            back = now[:, : 2 * n] @ first
            d *= stay[t]
            drh *= r[t]
            back += d
            back += drh
            if anew[t]:
                back[fresh[t]] = 0
        gates = gates.reshape(-1, 3 * n)
        g["u"][:, : 2 * n] = old.reshape(-1, n).T @ gates[:, : 2 * n]
        g["u"][:, 2 * n :] = rh.reshape(-1, n).T @ gates[:, 2 * n :]
        words = np.where(word < 0, len(w["x"]) - 1, word).ravel().astype(np.uint16)
        order = np.argsort(words, kind="stable")
        at = words[order]
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        g["x"][at[starts]] = np.add.reduceat(gates[order], starts)
        return {k: v / total for k, v in g.items()}, h, float(loss) / total

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.weights)
        return out.getvalue()

    def unpack(self, data: bytes) -> Gru:
        with np.load(io.BytesIO(data)) as z:
            self.weights = {n: z[n] for n in self.NAMES}
        return self


def lanes(texts: list[np.ndarray], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts (none empty) dealt to lanes, longest first to the shortest lane, in windows: (word before, word, text's number, first of
    its text), each (steps, lanes); the text's number is -1 where a lane is empty. Lanes that are done leave the windows."""
    width = max(1, min(width, len(texts)))
    line: list[list[int]] = [[] for _ in range(width)]
    heap = [(0, k) for k in range(width)]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        load, k = heap[0]
        line[k].append(i)
        heapq.heapreplace(heap, (load + len(texts[i]), k))
    loads = np.array([sum(len(texts[i]) for i in ks) for ks in line])
    order = np.argsort(-loads, kind="stable")
    loads = loads[order]
    if not loads[0]:
        return
    turn = [i for k in order for i in line[k]]
    sizes = np.array([len(texts[i]) for i in turn])
    words = np.concatenate([texts[i] for i in turn]).astype(np.int32)
    owner = np.repeat(np.array(turn, np.int32), sizes)
    before = np.append(np.int32(-1), words[:-1])
    before[np.cumsum(sizes) - sizes] = -1
    ends = np.cumsum(loads)
    starts = ends - loads
    for at in range(0, int(loads[0]), WINDOW):
        n = int((loads > at).sum())
        spots = starts[:n] + np.arange(at, min(at + WINDOW, loads[0]))[:, None]
        on = spots < ends[:n]
        spots = np.where(on, spots, 0)
        b = np.where(on, before[spots], -1)
        yield b, np.where(on, words[spots], 0), np.where(on, owner[spots], -1), b < 0


def score_texts(model: Gru, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each text of word indices, other words by their class only."""
    out = np.zeros(len(texts))
    h = np.zeros((max(1, min(LANES, len(texts))), HIDDEN), np.float32)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0

    def settle() -> None:
        states, goals, owners = (np.concatenate(x) for x in zip(*held, strict=True))
        out[:] += np.bincount(owners, model.log_probs(states, goals), len(texts))
        held.clear()

    for before, word, owner, fresh in lanes(texts, LANES):
        h = h[: before.shape[1]]
        states, inputs, anew = np.empty((*before.shape, HIDDEN), np.float32), model.gates(before), fresh.any(1)
        for t in range(len(before)):
            if anew[t]:
                h = np.where(fresh[t][:, None], np.float32(0), h)
            z, _, _, cand = model.step(h, inputs[t])
            h = h + z * (cand - h)
            states[t] = h
        on = owner >= 0
        held.append((states[on], word[on], owner[on]))
        rows += len(held[-1][1])
        if rows >= SETTLE:  # the ends of long texts, few lanes wide, are settled together
            settle()
            rows = 0
    if rows:
        settle()
    return out


class Adam:
    """Steps of Adam on a model's weights, held as views of one flat array."""

    def __init__(self, model: Gru, rate: float):
        self.model, self.rate, self.i = model, rate, 0
        self.names = list(model.weights)
        shapes = [model.weights[k].shape for k in self.names]
        self.flat = np.concatenate([model.weights[k].ravel() for k in self.names])
        self.m, self.s, self.root = (np.zeros_like(self.flat) for _ in range(3))
        ends = np.cumsum([model.weights[k].size for k in self.names])[:-1]
        model.weights = {k: x.reshape(d) for k, x, d in zip(self.names, np.split(self.flat, ends), shapes, strict=True)}

    def step(self, g: dict) -> None:
        self.i += 1
        m, s, root = self.m, self.s, self.root
        v = np.concatenate([g[k].ravel() for k in self.names])
        m *= 0.9
        np.multiply(v, 0.1, out=root)
        m += root
        v *= v
        v *= 0.005
        s *= 0.995
        s += v
        np.multiply(s, 1 / (1 - 0.995**self.i), out=root)
        np.sqrt(root, out=root)
        root += 1e-6
        np.divide(m, root, out=root)
        root *= self.rate / (1 - 0.9**self.i)
        self.flat -= root

    def learn(self, texts: list[np.ndarray], width: int = LANES) -> None:
        """One pass over texts. Pieces of PIECE words of a long text are learnt from beside each other, each from the start's state."""
        pieces = [t[a : a + PIECE] for t in texts for a in range(0, len(t), PIECE)]
        h = np.zeros((max(1, min(width, len(pieces))), HIDDEN), np.float32)
        for before, word, owner, fresh in lanes(pieces, width) if pieces else ():
            g, h, _ = self.model.gradients(h[: before.shape[1]], before, word, owner >= 0, fresh)
            self.step(g)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens of a task's texts, given out whenever many are held."""
    held: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        words, counts = list(held), list(held.values())
        for a in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(words[a : a + 50_000]).view(np.int64)), pa.array(counts[a : a + 50_000], pa.int64())], ["word", "n"])
        held.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(tokens_of(text))
            if len(held) > 400_000:
                yield from out()
    yield from out()


def _index(head: dict[bytes, int] | np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of hashes in the sorted head, or -1."""
    if not len(head):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(head, hashes), len(head) - 1)
    return np.where(head[at] == hashes, at, -1)


class Lexicon:
    """The head words: sorted hashes, their counts, and their places in the model's vocabulary (its size for any other)."""

    def __init__(self, rows: list[tuple[int, int]]):
        rows = sorted(rows, key=lambda r: (-r[1], r[0]))
        self.size = min(VOCABULARY, len(rows))
        hashes = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], np.array([r[1] for r in rows], np.int64)[order]
        self.place = np.minimum(order, self.size)
        self.top = np.array([r[1] for r in rows[: self.size]], float)

    def read(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of a text's tokens, and where the head has them (-1: nowhere)."""
        h = word_hashes(tokens_of(text))
        return h, _index(self.hashes, h)

    def words(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.place[at], self.size) if len(self.place) else np.full(len(at), self.size, np.int32)


def _indexed(lexicon: Lexicon, n_all: int, n_words: int, other: float):
    """Rows (doc_id, held_out, h, text) as rows of INDEXED: a text is split into words and these are looked up here once, for training and scoring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.log10((lexicon.counts + 1.0) / (n_all + n_words + 1.0))
        share = np.log10((lexicon.counts + 1.0) / other)
        for batch in batches:
            texts = batch.column(3)
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), SLICE):
                yield rows(batch.slice(a, b - a), texts.slice(a, b - a).to_pylist(), base, share)

    def rows(batch: pa.RecordBatch, texts: list, base: np.ndarray, share: np.ndarray) -> pa.RecordBatch:
        n, known, sums, apart, words, rare, times = [], [], [], [], [], [], []
        for text in texts:
            h, at = lexicon.read(text or b"")
            on = at >= 0
            w = lexicon.words(at)
            n.append(len(h)), known.append(int(on.sum())), sums.append(float(base[at[on]].sum()))
            # words of the last class that the head counts: their share of it
            apart.append(float(share[at[on & (w == lexicon.size)]].sum()))
            words.append(w.astype("<u2").tobytes())
            u, c = np.unique(h[~on].view(np.int64), return_counts=True)
            rare.append(u), times.append(c)
        lists = lambda xs: pa.ListArray.from_arrays(np.append(0, np.cumsum([len(x) for x in xs])).astype(np.int32), pa.array(np.concatenate([np.empty(0, np.int64), *xs]).astype(np.int64)))
        made = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(apart, pa.float64()), pa.array(words, pa.binary()), lists(rare), lists(times)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["doc_id", "held_out", "h", "n_tokens", "n_known", "base", "apart", "words", "rare", "times"])

    return run


INDEXED = "doc_id long, held_out boolean, h long, n_tokens long, n_known long, base double, apart double, words binary, rare array<long>, times array<long>"


def _taught(top: np.ndarray, outside: int, weights: bytes, rate: float):
    """Rows (part, words) in order of part: of each part the weights that its texts, in their order, make of `weights`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, adam, held, n, total = None, None, [], 0, 0

        def done() -> pa.RecordBatch:
            adam.learn(held)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total], pa.int64()), pa.array([adam.model.pack()], pa.binary())], ["part", "n", "weights"])

        for batch in batches:
            for part, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now:
                    if now is not None:
                        yield done()
                    now, adam, held, n, total = part, Adam(Gru(top, outside).unpack(weights), rate), [], 0, 0
                held.append(np.frombuffer(words, "<u2"))
                n, total = n + len(held[-1]), total + len(held[-1])
                if n >= CHUNK:
                    adam.learn(held)
                    held, n = [], 0
        if now is not None:
            yield done()

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, n, weights), in order of part: one row of the mean weights of all, under the first part's number."""
    first, total, mean = None, 0, {}
    for batch in batches:
        for part, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            first = part if first is None else first
            total += n
            with np.load(io.BytesIO(data)) as z:
                for k in z.files:
                    mean[k] = mean.get(k, 0) + (z[k] - mean.get(k, 0)) * (n / total)
    if total:
        out = io.BytesIO()
        np.savez(out, **{k: v.astype(np.float32) for k, v in mean.items()})
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total], pa.int64()), pa.array([out.getvalue()], pa.binary())], ["part", "n", "weights"])


def _scored(top: np.ndarray, outside: int, weights: bytes):
    """Rows (row, words): row, lm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Gru(top, outside).unpack(weights)
        for batch in batches:
            words = batch.column(1)
            for a, b in slices(pc.binary_length(words).to_numpy(zero_copy_only=False), 4_000_000):
                texts = [np.frombuffer(w, "<u2") for w in words.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score_texts(model, texts) / math.log(10))], ["row", "lm"])

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows whose fold is not HELD: each is in one of ROUNDS and of the parts into which hashes of doc_id and text deal
    that round, and learnt from once, in an order that the hashes set, so that the weights don't depend on how the table is split.
    Null and empty texts are their end alone; a null doc_id is in fold 0; repeated rows count, and are scored, each. No training rows: N
    and V are 0. Counts of all words are kept as a table; the most frequent, some HEAD, go to every task, the rarer ones of a text are
    joined with it. Further columns play no part.
    """
    small_batches(docs.sparkSession)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)), F.lit(0)) == HELD
    docs = docs.select("doc_id", held_out.alias("held_out"), F.xxhash64("doc_id", "text").alias("h"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    counts = cut(docs.where("not held_out").select("text").mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    in_head = _head(counts)
    lexicon = Lexicon([(r.word, r.c) for r in counts.where(in_head).collect()])
    outside = whole.n - int(lexicon.top.sum())
    # the last class: counts of the words outside the vocabulary, each and one more for a word never seen, plus one
    other = float(outside + (whole.v - lexicon.size) + 1)
    rows = docs.mapInArrow(_indexed(lexicon, whole.n, whole.v, other), INDEXED)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "indexed")
    weights = _learnt(rows.where("not held_out"), lexicon.top, outside, whole.n)
    scored = rows.select("row", "words").mapInArrow(_scored(lexicon.top, outside, weights), "row long, lm double")
    rare = rows.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    each = rare.join(counts.where(~in_head), "word", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    per = each.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1.0) / F.lit(whole.n + whole.v + 1.0))).alias("rare_base"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1.0) / F.lit(other))).alias("rare_lm"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.drop("words", "rare", "times", "h").join(scored, "row").join(per, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more")).cast("long").alias("n_known"), F.lit(whole.n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("lm") + F.col("apart") + zero("rare_lm")).alias("score"),
    )


def _head(counts: DataFrame) -> Column:
    """Whether a word (word, c) is one of the HEAD most frequent: whole sizes of counts, and of the size at the border a share, by hash."""
    size = F.floor(F.log2("c") * 16).cast("int")  # sizes of counts by their logarithm: some hundreds
    sizes = sorted(((r.size, r.n) for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()), reverse=True)
    held = 0
    for k, n in sizes:
        if held + n > HEAD:
            part = int((HEAD - held) / n * (1 << 40))
            return (size > k) | ((size == k) & (F.pmod(F.xxhash64("word"), F.lit(1 << 40)) < part))
        held += n
    return F.lit(True)


def _learnt(rows: DataFrame, top: np.ndarray, outside: int, tokens: int) -> bytes:
    """The weights after all rounds. Each part starts from the last round's mean; a round's parts are averaged in the order of their numbers."""
    weights = Gru(top, outside).pack()
    parts = min(PARTS, 1 + tokens // (ROUNDS * PART))
    group = math.isqrt(parts - 1) + 1
    key = F.pmod(F.xxhash64("h"), F.lit(ROUNDS * parts))
    for i in range(ROUNDS):
        some = rows.where(F.pmod(key, F.lit(ROUNDS)) == i).select(F.expr(f"cast(pmod(xxhash64(h), {ROUNDS * parts}) div {ROUNDS} as int)").alias("part"), "h", "doc_id", "words")
        dealt = some.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "h", "doc_id", "words").select("part", "words")
        taught = cut(dealt.mapInArrow(_taught(top, outside, weights, 0.01), "part int, n long, weights binary"), "taught")
        for n in (group, 1):
            taught = taught.repartitionById(n, F.pmod("part", F.lit(n))).sortWithinPartitions("part").mapInArrow(_averaged, "part int, n long, weights binary")
        mean = taught.collect()
        weights = bytes(mean[0].weights) if mean else weights
    return weights

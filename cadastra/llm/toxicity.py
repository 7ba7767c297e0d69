"""Toxicity of whole texts by a recurrent network over overlapping windows.

Every word enters with a word embedding and the mean embedding of its character shingles (three to five
bytes, with the word's bounds). A gated recurrent network reads each window of ``WINDOW`` words both ways, attention
pools its states to one logit, and a logistic rule over the windows' probabilities scores the
text. All windows of a text are scored, half overlapping; a text of any length is read whole.

Network and rule are trained in numpy on at most ``SAMPLE`` labelled documents of each class, the first by a
hash of their id. Only the label and the text enter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import clear_worker_cache, free_name, mix, ragged, slices
from cadastra.llm.decontaminate import words

WINDOW, STRIDE = 24, 12
WORD_BUCKETS, SHINGLE_BUCKETS, WIDTH, HIDDEN = 1 << 13, 1 << 14, 8, 8
SAMPLE = 600  # training documents of each class
BATCH, ROUNDS, SEED = 512, 3, 11
CACHED_WORDS = 100_000
SLICE_CHARS, LEARNT_WORDS = 250_000, 4096  # of texts that are scored, and new words that are learnt, at a time
LOGIT_BOUND = 30.0


def word_features(chunk: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, and shingle buckets in a row with the number each word has."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in chunk), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in chunk], np.int64)
    owner = np.repeat(np.arange(len(chunk)), sizes)
    ids, owners = [], []
    for n in (3, 4, 5):
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(1_000_003) + data[k : len(data) - n + 1 + k]
        inside = owner[: len(h)] == owner[n - 1 :]
        ids.append(mix(h[inside]) % np.uint64(SHINGLE_BUCKETS))
        owners.append(owner[: len(h)][inside])
    at = np.concatenate(owners)
    order = np.argsort(at, kind="stable")
    starts = np.cumsum(sizes) - sizes
    position = np.arange(len(data)) - np.repeat(starts, sizes)
    whole = np.add.reduceat(mix(data + (position.astype(np.uint64) << np.uint64(8))), starts)
    return (mix(whole) % np.uint64(WORD_BUCKETS)).astype(np.int64), np.concatenate(ids)[order].astype(np.int64), np.bincount(at, minlength=len(chunk))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and text of each window, the words of all texts standing in a row."""
    n = np.where(counts == 0, 0, np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1))
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    starts = np.cumsum(counts) - counts
    return starts[text] + k * STRIDE, np.minimum(WINDOW, counts[text] - k * STRIDE), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights, forward and backward pass."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        draw = lambda *s, scale=0.3: rng.normal(0, scale, s).astype(np.float32)
        self.p = {"word": draw(WORD_BUCKETS, WIDTH, scale=0.1), "char": draw(SHINGLE_BUCKETS, WIDTH, scale=0.3), "att": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.full(1, -1.0, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": draw(2 * WIDTH, 3 * HIDDEN), f"u{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, word: np.ndarray, shingles: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The input vector of each word."""
        starts = np.cumsum(numbers) - numbers
        mean = np.add.reduceat(self.p["char"][shingles], starts, axis=0) / numbers[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][word], mean], 1)

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        """What each word adds to the gates, both ways; in front the row of the padding, which keeps the state."""
        pad = np.zeros((1, 3 * HIDDEN), np.float32)
        pad[0, :HIDDEN] = -40
        return [np.concatenate([pad, x @ self.p[f"w{d}"] + self.p[f"c{d}"]]) for d in "fb"]

    def forward(self, gates: list[np.ndarray], ids: np.ndarray, keep: bool = False):
        """Logits of windows given as rows of word numbers, 0 the padding."""
        n, steps = ids.shape
        states = np.zeros((n, steps, 2 * HIDDEN), np.float32)
        trace = {}
        for side, d in enumerate("fb"):
            h, u = np.zeros((n, HIDDEN), np.float32), self.p[f"u{d}"]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                g = gates[side][ids[:, t]]
                zr = _sigmoid(g[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
                if keep:
                    trace[d, t] = (h, z, r, c)
                h = h + z * (c - h)
                states[:, t, side * HIDDEN : (side + 1) * HIDDEN] = h
        e = np.where(ids > 0, states @ self.p["att"], np.float32(-1e9))
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = (a[:, :, None] * states).sum(1)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, states, a, pooled, trace) if keep else logit

    def backward(self, ids: np.ndarray, slope: np.ndarray, kept: tuple, n_words: int) -> tuple[dict, list[np.ndarray]]:
        """Gradients of the weights, and of the gates of each word."""
        _, states, a, pooled, trace = kept
        grads = {"out": pooled.T @ slope, "bias": slope.sum(keepdims=True)}
        d_pooled = slope[:, None] * self.p["out"]
        d_a = (states * d_pooled[:, None, :]).sum(2)
        d_e = a * (d_a - (a * d_a).sum(1, keepdims=True))
        grads["att"] = (states * d_e[:, :, None]).sum((0, 1))
        d_states = a[:, :, None] * d_pooled[:, None, :] + d_e[:, :, None] * self.p["att"]
        d_gates = []
        for side, d in enumerate("fb"):
            u = self.p[f"u{d}"]
            d_u, d_h = np.zeros_like(u), np.zeros((len(ids), HIDDEN), np.float32)
            d_g = np.zeros((*ids.shape, 3 * HIDDEN), np.float32)
            for t in range(ids.shape[1] - 1, -1, -1) if d == "f" else range(ids.shape[1]):
                h, z, r, c = trace[d, t]
                d_h = d_h + d_states[:, t, side * HIDDEN : (side + 1) * HIDDEN]
                d_c = d_h * z * (1 - c * c)
                d_z = d_h * (c - h) * z * (1 - z)
                d_rh = d_c @ u[:, 2 * HIDDEN :].T
                d_r = d_rh * h * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], 1)
                d_u[:, 2 * HIDDEN :] += (r * h).T @ d_c
                d_u[:, : 2 * HIDDEN] += h.T @ d_zr
                d_g[:, t] = np.concatenate([d_zr, d_c], 1)
                d_h = d_h * (1 - z) + d_rh * r + d_zr @ u[:, : 2 * HIDDEN].T
            grads[f"u{d}"] = d_u
            total = np.zeros((n_words + 1, 3 * HIDDEN), np.float32)
            np.add.at(total, ids.ravel(), d_g.reshape(-1, 3 * HIDDEN))
            d_gates.append(total[1:])
        return grads, d_gates


class Vocabulary:
    """Distinct words of a set of texts with their features, and all windows over them."""

    def __init__(self, texts: list[str]):
        own = [words(t) for t in texts]
        self.number: dict[bytes, int] = {}
        flat = [self.number.setdefault(w, len(self.number)) for ws in own for w in ws]
        self.flat = np.array(flat, np.int64)
        self.start, self.size, self.text = windows(np.array([len(w) for w in own], np.int64))
        if self.number:
            self.word, self.shingles, self.numbers = word_features(list(self.number))
            self.at = np.cumsum(self.numbers) - self.numbers

    def rows(self, chosen: np.ndarray) -> np.ndarray:
        """Word numbers, from 1, of the chosen windows."""
        step = np.arange(WINDOW)
        at = np.minimum(self.start[chosen, None] + step, len(self.flat) - 1)
        return np.where(step < self.size[chosen, None], self.flat[at] + 1, 0)


def train(texts: list[str], labels: np.ndarray, share: float = 0.5) -> dict:
    """Weights of the network and of the rule over a text's windows; one class alone gives a constant score.

    ``share`` is that of label 1 among all labelled documents, to which the rule is calibrated.
    """
    if len(set(labels.tolist())) < 2:
        return {"constant": float(labels.mean()) if len(labels) else 0.0}
    rng = np.random.default_rng(SEED)
    vocabulary, net = Vocabulary(texts), Network()
    if not vocabulary.number:
        return {"constant": float(labels.mean())}
    apart = np.arange(len(texts)) % 4 == 3  # for the rule over windows
    target = labels[vocabulary.text].astype(np.float32)
    per_text = np.bincount(vocabulary.text, minlength=len(texts))
    usable = np.flatnonzero(~apart[vocabulary.text])
    use = usable
    rounds = max(ROUNDS, min(40, 400 * BATCH // max(1, len(usable))))
    means = {k: np.zeros_like(v) for k, v in net.p.items()}
    squares = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for r in range(rounds):
        if r == rounds // 3 and r:
            # A toxic text need not be toxic in every window: from here on its clearest ones stand for it.
            p = _sigmoid(window_logits(net, vocabulary))
            best = np.zeros(len(texts))
            np.maximum.at(best, vocabulary.text, p)
            use = usable[(target[usable] == 0) | (p[usable] >= 0.6 * best[vocabulary.text[usable]])]
        for chosen in np.array_split(rng.permutation(use), max(1, len(use) // BATCH)):
            step += 1
            ids = vocabulary.rows(chosen)
            mine, ids = np.unique(ids, return_inverse=True)
            ids = ids.reshape(len(chosen), WINDOW) + (0 if mine[0] == 0 else 1)
            mine = mine[mine > 0] - 1
            numbers = vocabulary.numbers[mine]
            shingles = vocabulary.shingles[ragged(vocabulary.at[mine], numbers)]
            x = net.inputs(vocabulary.word[mine], shingles, numbers)
            kept = net.forward(net.gates(x), ids, keep=True)
            weight = np.where(target[chosen] == 1, 1.0, 0.5).astype(np.float32)
            slope = ((_sigmoid(kept[0]) - target[chosen]) * weight / len(chosen)).astype(np.float32)
            grads, d_gates = net.backward(ids, slope, kept, len(mine))
            d_x = np.zeros_like(x)
            for d, g in zip("fb", d_gates):
                grads[f"w{d}"], grads[f"c{d}"] = x.T @ g, g.sum(0)
                d_x += g @ net.p[f"w{d}"].T
            for name, at, g in (("word", vocabulary.word[mine], d_x[:, :WIDTH]), ("char", shingles, np.repeat(d_x[:, WIDTH:] / numbers[:, None].astype(np.float32), numbers, axis=0))):
                grads[name] = np.zeros_like(net.p[name])
                np.add.at(grads[name], at, g)
            for k, g in grads.items():
                means[k] += 0.1 * (g - means[k])
                squares[k] += 0.01 * (g * g - squares[k])
                net.p[k] -= (0.01 * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    seen = text_features(window_logits(net, vocabulary), vocabulary.text, len(texts))
    fitted = apart if 0 < labels[apart].sum() < apart.sum() else np.ones(len(texts), bool)
    y = labels[fitted]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return {"net": net.p, "rule": _logistic(seen[fitted], labels[fitted], weight)}


def window_logits(net: Network, vocabulary: Vocabulary) -> np.ndarray:
    gates = net.gates(net.inputs(vocabulary.word, vocabulary.shingles, vocabulary.numbers))
    return np.concatenate([net.forward(gates, vocabulary.rows(c)) for c in np.array_split(np.arange(len(vocabulary.start)), len(vocabulary.start) // 4096 + 1)])


def text_features(logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Of each text: the logit of its clearest window, and how many windows it has; the lowest logit for a text without windows."""
    top = np.full(n, -LOGIT_BOUND)
    np.maximum.at(top, text, np.clip(logits, -LOGIT_BOUND, LOGIT_BOUND))
    return np.stack([top, np.log1p(np.bincount(text, minlength=n)), np.ones(n)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (weight * (p - y)) + 0.05 * w)
    return w


class Scorer:
    """Scores of texts; what a word adds to the gates is kept from text to text."""

    def __init__(self, model: dict):
        self.constant = model.get("constant")
        if self.constant is None:
            self.net, self.rule = Network(), model["rule"]
            self.net.p = model["net"]
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.gates: list[np.ndarray] | None = None
        self.used = 1

    def _learn(self, new: list[bytes]) -> None:
        if self.gates is None:
            self.gates = [np.zeros((1 << 15, 3 * HIDDEN), np.float32) for _ in "fb"]
        for k in range(0, len(new), LEARNT_WORDS):
            some = new[k : k + LEARNT_WORDS]
            for side, rows in enumerate(self.net.gates(self.net.inputs(*word_features(some)))):
                while self.used + len(some) > len(self.gates[side]):
                    self.gates[side] = np.concatenate([self.gates[side], np.zeros_like(self.gates[side])])
                self.gates[side][0] = rows[0]
                self.gates[side][self.used : self.used + len(some)] = rows[1:]
            self.number.update(zip(some, range(self.used, self.used + len(some))))
            self.used += len(some)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = []
        for lo, hi in slices([len(t or "") for t in texts], SLICE_CHARS):
            own = [words(t) for t in texts[lo:hi]]
            if len(self.number) > CACHED_WORDS:
                self.clear()
            flat = [w for ws in own for w in ws]
            if new := set(flat).difference(self.number):
                self._learn(list(new))
            ids = np.array([self.number[w] for w in flat], np.int32)
            start, size, text = windows(np.array([len(w) for w in own], np.int64))
            logits = []
            step = np.arange(WINDOW)
            for k in range(0, len(start), 4096):
                at = np.minimum(start[k : k + 4096, None] + step, len(ids) - 1)
                logits.append(self.net.forward(self.gates, np.where(step < size[k : k + 4096, None], ids[at], 0)))
            seen = text_features(np.concatenate(logits) if logits else np.zeros(0), text, len(own))
            out.append(_sigmoid(seen @ self.rule))
        return np.concatenate(out) if out else np.zeros(0)

    def score_column(self, texts: pa.Array) -> np.ndarray:
        """``score`` of a column, of which some texts are taken out at a time."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        return np.concatenate([np.zeros(0), *[self.score(texts.slice(lo, hi - lo).to_pylist()) for lo, hi in slices(sizes, SLICE_CHARS)]])


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """The scorer trained on labelled documents that are not held out, at most ``sample`` of each class.

    Labels other than 0 and 1, and ids without a label or a document, teach nothing. An id that is labelled or stored
    more than once counts once, with its highest label and its smallest text.
    """
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic")).filter(~held_out())
    first = Window.partitionBy("_toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = known.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= sample)
    chosen = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(some), "doc_id")  # two samples at most
    rows = chosen.groupBy("doc_id").agg(F.min("_text").alias("t"), F.max("_toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    share = known.agg(F.avg("_toxic")).first()[0] or 0.0
    return Scorer(train([r.t for r in rows], np.array([r.y for r in rows], np.int64), share))


def score_texts(documents: DataFrame, scorer: Scorer, name: str = "_toxic") -> DataFrame:
    """``documents`` with the column ``name``: a score from 0 to 1. Null and empty texts get the score of a text without windows; rows and other columns stay."""

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        clear_worker_cache()
        return pa.array(scorer.score_column(text), pa.float64())

    return documents.withColumn(name, scored.asNondeterministic()("text"))


def remove_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents scored below one half, columns unchanged, whatever their names.

    Rows without an id or a text are scored like any other; repeated rows stay or go alike. An empty table
    gives none; without labels nothing is learnt and the score of all texts is low, so all stay.
    """
    name = free_name(documents, "_toxic")
    return score_texts(documents, fit(documents, labels), name).filter(F.col(name) < 0.5).drop(name)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score_texts(documents.select("doc_id", "text"), fit(documents, labels), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

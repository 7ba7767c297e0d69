"""Language-model scores of whole documents.

Word counts over all training documents give the base model. The log-bilinear model predicts the
class of a token from the classes of the two before it. The commonest words and the end of a text are classes of their
own; the other ``FREQUENT`` words fall into clusters by the common words they stand beside, and the rest share a
class; inside a class words follow their counts. The model is trained by noise-contrastive estimation on the class
triples of all training documents, for longer the more of them there are. One matrix product over all
contexts gives the normalised log-probabilities.

Words among the ``FREQUENT`` commonest are looked up where the text is read; only the others travel,
once per document, to meet their counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import slices
from cadastra.session import materialize

FREQUENT = 65_536  # words sent to every task
OWN, CLUSTERS = 80, 80  # classes 0: words beyond FREQUENT, 1: the end, then the commonest words; and clusters of the others
CLASSES = OWN + CLUSTERS
BESIDE, ROUNDS = 32, 10  # classes whose words tell clusters apart, and rounds of clustering
DIMENSIONS, STEPS, SAMPLES, BATCH, NOISE, SEED = 24, 3000, 2, 512, 10, 7  # SAMPLES: more for each distinct triple
HELD_KEYS = 300_000  # words counted in a task before they are passed on
END = "\n"  # no word holds white space
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
TEXT = "struct<n_tokens:bigint,n_known:bigint,base:double,model:double,n_rare:bigint,rare:array<struct<word:string,n:int>>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def held_out(doc_id: Column | str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit(""))) % 7 == 2


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``text``, the end of each text counted under END."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            column = batch.column(0)
            for k in range(len(column)):
                held.update(words(column[k].as_py()))
                held[END.encode()] += 1
                if len(held) > HELD_KEYS:
                    yield _counts(held)
                    held = Counter()
        yield _counts(held)

    counted = texts.select("text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("c"))


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def class_ids(known: dict[bytes, int], texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text; for all tokens in a row, ends included, the number of the word (1 the end, 0 unknown) and the token's text."""
    own = [words(t) for t in texts]
    flat, owner = [], np.repeat(np.arange(len(own)), [len(w) + 1 for w in own])
    get = known.get
    for w in own:
        flat += [get(x, 0) for x in w]
        flat.append(1)
    return own, np.array(flat, np.int64), owner


def before(numbers: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """What stands ``k`` places before each token; before a text there are ends."""
    out = np.r_[np.ones(k, np.int64), numbers[:-k]][: len(numbers)]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    for j in range(k):
        at = first[first + j < len(numbers)] + j
        out[at] = 1
    return out


def triples(numbers: np.ndarray, owner: np.ndarray, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes two before, one before and of each token."""
    own = class_of[numbers]
    return before(own, owner, 2), before(own, owner, 1), own


def count_neighbours(texts: DataFrame, known: dict[bytes, int]) -> np.ndarray:
    """For each known word how often each of the BESIDE first classes stands before it, and after it."""
    size = len(known) + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * 2 * BESIDE, np.int32)
        for batch in batches:
            column = batch.column(0).to_pylist()
            for lo, hi in slices([len(t or "") for t in column], 2_000_000):
                _, numbers, owner = class_ids(known, column[lo:hi])
                near = np.where(numbers < BESIDE, numbers, 0)
                left, far = before(near, owner, 1), numbers >= OWN
                table += np.bincount(numbers[far] * (2 * BESIDE) + left[far], minlength=len(table)).astype(np.int32)
                ahead = before(numbers, owner, 1)
                far = ahead >= OWN
                table += np.bincount(ahead[far] * (2 * BESIDE) + BESIDE + near[far], minlength=len(table)).astype(np.int32)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at].astype(np.int64))], ["cell", "n"])

    cells = texts.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # FREQUENT times 2 BESIDE at most
    out = np.zeros(size * 2 * BESIDE, np.float32)
    out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return out.reshape(size, 2 * BESIDE)


def cluster(neighbours: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The class of each known word: its number below OWN, else the cluster of words that stand beside the same common words.

    Spherical k-means over shares against what is usual, words weighing by the logarithm of their counts; begun with
    the commonest words.
    """
    class_of = np.arange(len(neighbours))
    tail = neighbours[OWN:]
    if not len(tail):
        return class_of
    usual = tail.sum(0) + 1
    usual /= usual.sum()
    share = (tail + 4 * usual) / (tail.sum(1, keepdims=True) + 4)
    x = np.sqrt(share).astype(np.float32) - np.sqrt(usual).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-6
    weight = np.log1p(counts[OWN : len(neighbours)]).astype(np.float32)[:, None]
    centres = x[:CLUSTERS].copy()
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x * weight)
        held = np.bincount(near, minlength=len(centres)) > 0
        centres[held] = sums[held] / (np.linalg.norm(sums[held], axis=1, keepdims=True) + 1e-6)
    class_of[OWN:] = OWN + (x @ centres.T).argmax(1)
    return class_of


def count_triples(texts: DataFrame, known: dict[bytes, int], class_of: np.ndarray) -> np.ndarray:
    """Counts of class triples, a cube with CLASSES a side."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cube = np.zeros(CLASSES**3, np.int32)
        for batch in batches:
            column = batch.column(0).to_pylist()
            for lo, hi in slices([len(t or "") for t in column], 2_000_000):
                _, numbers, owner = class_ids(known, column[lo:hi])
                a, b, c = triples(numbers, owner, class_of)
                at, n = np.unique((a * CLASSES + b) * CLASSES + c, return_counts=True)
                cube[at] += n.astype(np.int32)
        at = np.flatnonzero(cube)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cube[at].astype(np.int64))], ["cell", "n"])

    cells = texts.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CLASSES cubed at most
    cube = np.zeros(CLASSES**3, np.float32)
    cube[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return cube.reshape(CLASSES, CLASSES, CLASSES)


def fit(cube: np.ndarray, steps: int | None = None) -> np.ndarray:
    """Normalised log10 probabilities of the classes after each two classes, from a model trained by noise contrast.

    Beside STEPS batches it sees SAMPLES triples more for each distinct one, so training grows with the corpus.
    """
    rng = np.random.default_rng(SEED)
    size = len(cube)
    flat = cube.reshape(-1)
    if not flat.sum():
        return np.full(cube.shape, -np.log10(size))
    steps = STEPS + SAMPLES * int(np.count_nonzero(flat)) // BATCH if steps is None else steps
    unigram = cube.sum((0, 1), dtype=np.float64) + 1.0
    unigram /= unigram.sum()
    noise_log = np.log(NOISE * unigram)
    inputs, outputs = rng.normal(0, 0.1, (2, size, DIMENSIONS))
    far, near = np.full((2, DIMENSIONS), 0.5)
    bias = np.log(unigram)
    params = [inputs, outputs, far, near, bias]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    cumulative, noise = np.cumsum(flat, dtype=np.float64), np.cumsum(unigram)
    for step in range(1, steps + 1):
        cell = np.searchsorted(cumulative, rng.random(BATCH) * cumulative[-1], side="right")
        a, b, target = cell // size**2, cell // size % size, cell % size
        drawn = np.minimum(np.searchsorted(noise, rng.random((BATCH, NOISE))), size - 1)
        choice = np.concatenate([target[:, None], drawn], 1)
        context = inputs[a] * far + inputs[b] * near
        logit = np.einsum("bd,bkd->bk", context, outputs[choice]) + bias[choice] - noise_log[choice]
        slope = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        slope[:, 0] -= 1
        slope /= BATCH
        back = np.einsum("bk,bkd->bd", slope, outputs[choice])
        grads = [np.zeros_like(p) for p in params]
        np.add.at(grads[1], choice, slope[:, :, None] * context[:, None, :])
        np.add.at(grads[4], choice, slope)
        np.add.at(grads[0], a, back * far)
        np.add.at(grads[0], b, back * near)
        grads[2][:], grads[3][:] = (back * inputs[a]).sum(0), (back * inputs[b]).sum(0)
        rate = 0.02 * (1 - step / (steps + 1))
        for p, g, m, s in zip(params, grads, means, squares):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    out = np.zeros(cube.shape, np.float32)
    for a in range(size):
        logits = ((inputs[a] * far) + inputs * near) @ outputs.T + bias
        top = logits.max(1, keepdims=True)
        out[a] = (logits - top - np.log(np.exp(logits - top).sum(1, keepdims=True))) / np.log(10)
    return out


class Scorer:
    """Scores of texts up to the words that are not among the frequent ones."""

    def __init__(self, known: dict[bytes, int], counts: np.ndarray, class_of: np.ndarray, model: np.ndarray, total: int, distinct: int):
        """``counts``: of the word of each number; ``total`` and ``distinct``: of all training tokens."""
        self.known, self.model, self.class_of = known, model, class_of
        self.log_count, self.seen = np.log10(counts + 1.0), counts > 0
        self.log_all = np.log10(total + distinct + 1)
        # Inside its class a word follows its count and one; beyond FREQUENT there is one unknown word more.
        held = np.bincount(class_of, counts + 1.0, CLASSES)
        self.log_share = np.where(class_of < OWN, 0.0, self.log_count - np.log10(np.maximum(held, 1))[class_of])
        self.log_share[0] = -np.log10(total - counts[1:].sum() + distinct - int(self.seen[1:].sum()) + 1)

    def score(self, texts: list[str | None]) -> pa.StructArray:
        """A row of TEXT for each text, put together as columns: no object is held per word but the words themselves."""
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        ends, rare_words, rare_counts = [0], [], []
        for lo, hi in slices([len(t or "") for t in texts], 1_000_000):
            own, numbers, owner = class_ids(self.known, texts[lo:hi])
            n = len(own)
            a, b, c = triples(numbers, owner, self.class_of)
            rare = numbers == 0
            log = self.log_count[numbers] * ~rare
            columns[0].append(np.bincount(owner, minlength=n))
            columns[1].append(np.bincount(owner, self.seen[numbers] & ~rare, n).astype(np.int64))
            columns[2].append(np.bincount(owner, log - self.log_all, n))
            columns[3].append(np.bincount(owner, self.model[a, b, c] + self.log_share[numbers], n))
            columns[4].append(np.bincount(owner, rare, n).astype(np.int64))
            at = 0
            for w in own:
                missing = Counter(compress(w, rare[at : at + len(w)].tolist()))
                at += len(w) + 1
                rare_words.append(pa.array(list(missing), pa.binary()).cast(pa.string()))
                rare_counts.append(np.fromiter(missing.values(), np.int32, len(missing)))
                ends.append(ends[-1] + len(missing))
        words_ = pa.concat_arrays(rare_words) if rare_words else pa.array([], pa.string())
        counts = pa.array(np.concatenate(rare_counts) if rare_counts else np.zeros(0, np.int32))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([words_, counts], ["word", "n"]))
        kinds = [np.int64, np.int64, np.float64, np.float64, np.int64]
        flat = [pa.array(np.concatenate(x).astype(k) if x else np.zeros(0, k)) for x, k in zip(columns, kinds)]
        return pa.StructArray.from_arrays([*flat, listed], ["n_tokens", "n_known", "base", "model", "n_rare", "rare"])


def score_documents(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    A null or empty text is the end alone. Repeated rows are scored and counted as often as they come; a row
    without an id counts as training. Without training documents every word is unknown and the classes are
    alike. An empty table gives no rows. Other columns are left behind.
    """
    given = documents.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    training = given.filter(~F.col("held_out"))
    counts = materialize(count_words(training), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.filter(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    common = counts.filter(F.col("word") != END).orderBy(F.desc("c"), "word").limit(FREQUENT)
    head = materialize(common, "frequent-words").orderBy(F.desc("c"), "word").toArrow()  # at most FREQUENT rows
    known = {w.encode(): k for k, w in enumerate(head["word"].to_pylist(), 2)}
    numbers = np.zeros(len(known) + 2, np.int64)
    numbers[1], numbers[2:] = ends, head["c"].to_numpy()
    class_of = cluster(count_neighbours(training, known), numbers)
    scorer = Scorer(known, numbers, class_of, fit(count_triples(training, known, class_of)), total, distinct)
    return _score(given, counts, scorer, total)


def _score(given: DataFrame, counts: DataFrame, scorer: Scorer, total: int) -> DataFrame:
    @F.arrow_udf(TEXT)
    def read(text: pa.Array) -> pa.Array:
        return scorer.score(text.to_pylist())

    key = F.xxhash64("doc_id", "text")
    scored = materialize(given.select("doc_id", "held_out", key.alias("_key"), read.asNondeterministic()("text").alias("_s")), "scored")
    # Rows alike in id and text share a key: their rare words are taken once.
    rare = scored.filter("size(_s.rare) > 0").select("_key", F.explode("_s.rare").alias("_r")).select("_key", "_r.word", "_r.n")
    met = rare.join(counts, "word").groupBy("_key").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("_log"), F.sum("n").alias("_met"))
    copies = scored.groupBy("_key").agg(F.count(F.lit(1)).alias("_copies"))
    met = met.join(copies, "_key").select("_key", (F.col("_log") / F.col("_copies")).alias("_log"), (F.col("_met") / F.col("_copies")).cast("long").alias("_met"))
    out = scored.join(met, "_key", "left")
    log = F.coalesce("_log", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", F.col("_s.n_tokens").alias("n_tokens"), (F.col("_s.n_known") + F.coalesce("_met", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("_s.base") + log).alias("base_score"), (F.col("_s.model") + log).alias("score"),
    )

"""Spelling variants: words of a corpus that differ in one code point, and the commoner form each leads to.

Two words are one edit apart if their common prefix and common suffix together reach the longer length less
one. One of the two then reaches half of that, so words meet only where they share their first or their
last half: such groups, one for each longer length, are cut into blocks, and a tile compares two
blocks as padded matrices of code points, column by column. A pair shares both halves only with its prefix
group in charge of it. Nothing but a few figures a word leaves a tile, never its pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.session import materialize

LEAST_LENGTH, LEAST_COUNT, DAMAGED = 5, 3, 97
BLOCK_WORDS, BLOCK_CHARS = 2048, 1 << 20  # of a block; larger groups are cut into more blocks
DENSE = 48  # words from which a tile is compared as a whole
PAIR_CHARS = 1 << 23  # code points gathered at a time for the pairs of small tiles
FLUSH = 500_000  # distinct words a task holds before it hands them on
ROWS = 100_000  # rows of tiles a task works on at a time

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
TILE_KEYS = ["size", "side", "half", "i", "j"]


def words_of(ids: Iterable, texts: Iterable[bytes | None]) -> Counter:
    """Lower-cased runs of Latin letters, some of them damaged by their document's id, with their occurrences."""
    found: Counter = Counter()
    for key, text in zip(ids, texts):
        if not text:
            continue
        seed = zlib.crc32(b"%s:" % ("" if key is None else str(key)).encode())
        runs = Counter(text.translate(_LOWER).split())
        for chunk, n in runs.items():
            for run in (chunk,) if chunk.isalpha() else _RUN.findall(chunk):  # isalpha of bytes: ASCII letters alone
                h = zlib.crc32(run, seed)
                if h % DAMAGED == 0:
                    letters = run.decode()
                    at = h % len(letters)
                    run = (letters[:at] + letters[at + 1 :]).encode()
                found[run] += n
    return found


def count_words(documents: DataFrame) -> DataFrame:
    """word, n: words of at least five code points and three occurrences in all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            kept = [(w, n) for w, n in held.items() if len(w) >= LEAST_LENGTH]
            return pa.record_batch([pa.array([w.decode() for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            held.update(words_of(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            if len(held) > FLUSH:
                yield rows()
                held.clear()
        yield rows()

    parts = documents.select(F.col("doc_id").cast("string"), F.col("text").cast("binary")).mapInArrow(counted, "word string, n long")
    whole = parts.groupBy("word").agg(F.sum("n").alias("n"))
    return whole.filter((F.char_length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def tiles(words: DataFrame) -> DataFrame:
    """Each word once for every tile it stands in: size, side, half, blocks i <= j, whether it is of block j, word, n.

    ``size`` is the longer length of the pairs a group is in charge of, ``half`` what its words share at
    that side. The number of blocks follows the counted words of the group.
    """
    length = F.char_length("word")
    posts = words.withColumn("size", F.explode(F.array(length, length + 1)))
    share = F.floor(F.col("size") / 2).cast("int")  # half of size less one, upwards
    posts = posts.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    posts = posts.withColumn("half", F.when(F.col("side") == 0, F.substring("word", F.lit(1), share)).otherwise(F.right("word", share)))
    large = posts.groupBy("size", "side", "half").agg(F.count(F.lit(1)).alias("_m"))
    blocks = F.ceil(F.greatest(F.col("_m") / BLOCK_WORDS, F.col("_m") * F.col("size") / BLOCK_CHARS)).cast("int")
    large = large.withColumn("_blocks", blocks).filter("_blocks > 1").drop("_m")
    posts = posts.join(large, ["size", "side", "half"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    posts = posts.withColumn("_own", F.pmod(F.xxhash64("word"), F.col("_blocks")).cast("int"))
    posts = posts.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return posts.select(
        "size", "side", "half", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), (F.col("_own") > F.col("_other")).alias("second"), "word", "n",
    )


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words, one row a code point: from their beginnings, from their ends; and the lengths."""
    kind, code = (np.uint8, "latin-1") if all(w.isascii() or max(w) <= "\xff" for w in words) else (np.uint32, "utf-32-le")
    lengths = np.array([len(w) for w in words])
    inside = np.arange(lengths.max())[:, None] < lengths
    flat = np.frombuffer("".join(words).encode(code), kind)
    front = np.zeros(inside.T.shape, kind)  # no word holds code point 0
    back = np.zeros_like(front)
    front[inside.T] = flat
    back[inside.T[:, ::-1]] = flat
    return np.ascontiguousarray(front.T), np.ascontiguousarray(back.T[::-1]), lengths


def _near(first: tuple, second: tuple, size: int, side: int, share: int) -> np.ndarray:
    """Which pairs of two blocks (broadcast against one another) are near and this group's charge."""
    (front_a, back_a, length_a), (front_b, back_b, length_b) = first, second
    longest = np.maximum(length_a, length_b) == size

    def common(a: np.ndarray, b: np.ndarray, known: int) -> np.ndarray:
        alive = np.ones(longest.shape, bool)
        reached = np.full(longest.shape, known, np.int32)
        for k in range(known, size - 1):  # the last column is one of padding or of a pair's last difference
            alive &= (a[k] == b[k]) & (a[k] != 0) if k < min(len(a), len(b)) else False
            if not alive.any():
                break
            reached += alive
        return reached

    prefix = common(front_a, front_b, share if side == 0 else 0)
    suffix = common(back_a, back_b, share if side == 1 else 0)
    near = longest & (prefix + suffix >= size - 1)
    return near if side == 0 else near & (prefix < share)


def _take(block: tuple, index: np.ndarray) -> tuple:
    return block[0][:, index], block[1][:, index], block[2][index]


def _small(block: tuple, groups: np.ndarray, size: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (a < b) within runs of equal ``groups``."""
    n = len(groups)
    change = np.flatnonzero(np.diff(groups)) + 1
    ends = np.repeat(np.append(change, n), np.diff(np.concatenate([[0], change, [n]])))
    later = ends - np.arange(n) - 1
    found = []
    bounds = np.concatenate([[0], np.cumsum(later)])
    step = max(1, PAIR_CHARS // size)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + step, side="right")) - 1)
        a = np.repeat(np.arange(at, to), later[at:to])
        b = a + 1 + np.arange(len(a)) - np.repeat(bounds[at:to] - bounds[at], later[at:to])
        if len(a):
            near = _near(_take(block, a), _take(block, b), size, side, size // 2)
            found.append((a[near], b[near]))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def _large(block: tuple, second: np.ndarray, mixed: bool, size: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of one large tile: of its two blocks, or within its one."""
    rows = np.flatnonzero(~second) if mixed else np.arange(len(second))
    columns = np.flatnonzero(second) if mixed else rows
    right = tuple(x[..., None, :] for x in _take(block, columns))
    found = []
    step = max(1, PAIR_CHARS // max(1, len(columns)))
    for lo in range(0, len(rows), step):
        own = rows[lo : lo + step]
        left = tuple(x[..., :, None] for x in _take(block, own))
        near = _near(left, right, size, side, size // 2)
        a, b = np.nonzero(near)
        a, b = own[a], columns[b]
        keep = np.ones(len(a), bool) if mixed else a < b
        found.append((a[keep], b[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def compare(size: int, side: int, groups: np.ndarray, mixed: np.ndarray, second: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of whole tiles of one size and side, given in order of their tiles."""
    found = []
    change = np.flatnonzero(np.diff(groups)) + 1
    starts, ends = np.concatenate([[0], change]), np.append(change, len(groups))
    big = (ends - starts >= DENSE) | mixed[starts]
    for s, e in zip(starts[big], ends[big]):
        a, b = _large(_matrices(words[s:e]), second[s:e], bool(mixed[s]), size, side)
        found.append((a + s, b + s))
    rest = np.flatnonzero(np.repeat(~big & (ends - starts > 1), ends - starts))
    step = max(1, PAIR_CHARS // size)
    for lo in _cuts(groups[rest], step):
        part = rest[lo]
        a, b = _small(_matrices([words[k] for k in part]), groups[part], size, side)
        found.append((part[a], part[b]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def _cuts(groups: np.ndarray, step: int) -> Iterator[slice]:
    """Slices of about ``step`` rows that end where a group ends."""
    change = np.append(np.flatnonzero(np.diff(groups)) + 1, len(groups))
    lo = 0
    while lo < len(groups):
        hi = int(change[min(np.searchsorted(change, lo + step), len(change) - 1)])
        yield slice(lo, hi)
        lo = hi


def _figures(table: pa.Table) -> pa.RecordBatch:
    """Of whole tiles in order: for each word near another in one of them, how many and the commonest."""
    size, side = (table.column(c).to_numpy() for c in ("size", "side"))
    half, words = table.column("half").to_pylist(), table.column("word").to_pylist()
    i, j = (table.column(c).to_numpy() for c in ("i", "j"))
    n, second = table.column("n").to_numpy(), table.column("second").to_numpy(zero_copy_only=False)
    same = np.fromiter((x == y for x, y in zip(half, half[1:])), bool, max(0, len(half) - 1))
    new = ~same | (np.diff(size) != 0) | (np.diff(side) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
    groups = np.concatenate([[0], np.cumsum(new)])
    pairs = []
    kinds = np.flatnonzero(np.concatenate([[True], (np.diff(size) != 0) | (np.diff(side) != 0)]))
    for s, e in zip(kinds, np.append(kinds[1:], len(size))):
        a, b = compare(int(size[s]), int(side[s]), groups[s:e], (i != j)[s:e], second[s:e], words[s:e])
        pairs.append((a + s, b + s))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    own, other = np.concatenate([a, b]), np.concatenate([b, a])
    # the word itself decides among equally frequent ones
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort([rank[other], -n[other], own])
    own, other = own[order], other[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    counts = np.diff(np.append(first, len(own)))
    return pa.record_batch(
        [pa.array([words[k] for k in own[first]], pa.string()), pa.array(counts, pa.int64()), pa.array(n[other[first]], pa.int64()), pa.array([words[k] for k in other[first]], pa.string())],
        ["word", "n_near", "best_n", "best"],
    )


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: for each word with near ones, how many they are and the commonest (ties: smallest)."""

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS:
                continue
            table = pa.Table.from_batches(held)
            last = {c: table.column(c)[-1].as_py() for c in TILE_KEYS}
            keep = table.num_rows
            while keep and all(table.column(c)[keep - 1].as_py() == v for c, v in last.items()):
                keep -= 1
            if keep:  # the last tile may go on
                yield _figures(table.slice(0, keep))
            held = table.slice(keep).to_batches()
        if held and sum(b.num_rows for b in held):
            yield _figures(pa.Table.from_batches(held))

    dealt = tiles(words).repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS)
    partial = dealt.mapInArrow(figures, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n_near", (-F.col("_b.n")).alias("best_n"), F.col("_b.word").alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms each word begins; a form is at least twice as frequent, so chains are short and end.

    Pointers are doubled, each step over the words that have a form and written before the next.
    """
    at = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = materialize(at.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "forms")
        at = step.select("word", "root")
        if step.filter("_moved").isEmpty():
            return at


def variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of the documents.

    A null or empty text has no words. A null id damages as an empty one. Rows of one id, repeated or not,
    are documents of their own. An empty table gives no rows. Other columns are left behind.
    """
    words = materialize(count_words(documents), "words")
    near = materialize(near_words(words), "near-words")
    is_form = F.col("best_n") >= 2 * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    roots = follow(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

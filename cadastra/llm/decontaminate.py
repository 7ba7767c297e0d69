"""Benchmark decontamination by winnowed fingerprints.

Texts are cut to words. A benchmark item is held as its windows of ``WINDOW`` words (one shorter
window for a shorter item). From every ``WINDOW`` words of a document winnowing keeps the smallest
hash of the ``GRAM``-word shingles inside; a shared span of ``WINDOW`` words has the same smallest
hash on both sides, so none escapes. A fingerprint that meets the benchmark's is confirmed on all
its words, and adjacent confirmed windows extend one another to the whole shared span.

The benchmark is a stated query set. It passes in blocks of bounded size, each block's index going
to the tasks that read documents; documents are never shuffled, and what a task holds does not grow
with either table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import free_name, mix, slices

WINDOW, GRAM = 10, 5
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000  # of the benchmark, sent to the tasks at a time

_BASE = np.uint64(0x9E3779B97F4A7C15)
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FOUND = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"


def words(text: str | None) -> list[bytes]:
    """Letters and digits of ASCII, A-Z lowered, and all above ASCII; the rest separates."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def gram_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive ids."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    mixed = mix(ids.astype(np.uint64) + np.uint64(1))
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        out = out * _BASE + mixed[k : len(ids) - size + 1 + k]
    return mix(out)


def winnow(ids: np.ndarray) -> np.ndarray:
    """For each window of ids, the smallest hash of the shingles in it."""
    grams = gram_hashes(ids, GRAM)
    span = WINDOW - GRAM + 1
    if len(grams) < span:
        return np.zeros(0, np.uint64)
    low = grams[: len(grams) - span + 1].copy()
    for k in range(1, span):
        np.minimum(low, grams[k : len(grams) - span + 1 + k], out=low)
    return low


def fingerprints(ids: np.ndarray, size: int) -> np.ndarray:
    """Per window of ``size`` ids the fingerprint it is looked up by: winnowed for whole windows, its own hash for shorter items."""
    return winnow(ids) if size == WINDOW else gram_hashes(ids, size)


class Index:
    """Windows of one block of the benchmark: word numbers, fingerprints by length, items by window."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.number: dict[bytes, int] = {}
        self.items: dict[bytes, list[str]] = {}
        prints: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text)], np.int32)
            if not len(ids):
                continue
            size = min(WINDOW, len(ids))
            prints.setdefault(size, []).append(fingerprints(ids, size))
            for k in range(len(ids) - size + 1):
                held = self.items.setdefault(ids[k : k + size].tobytes(), [])
                if item not in held[-1:]:
                    held.append(item)
        self.prints = {size: np.unique(np.concatenate(p)) for size, p in prints.items()}

    def search(self, ids: np.ndarray) -> list[tuple[int, bytes]]:
        """(start, key) of the confirmed windows of a run of ids."""
        found = []
        for size, known in self.prints.items():
            at = fingerprints(ids, size)
            if not len(at):
                continue
            place = np.searchsorted(known, at)
            place[place == len(known)] = 0
            for s in np.flatnonzero(known[place] == at):
                key = ids[s : s + size].tobytes()
                if key in self.items:
                    found.append((int(s), key))
        return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def annotate_texts(index: Index, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Words, hit spans (word numbers, end exclusive) and items of each text."""
    get = index.number.get
    out: list = []
    for lo, hi in slices([len(t or "") for t in texts], 2_000_000):
        ids, starts, counts = [], [], []
        for t in texts[lo:hi]:
            own = words(t)
            starts.append(len(ids))
            counts.append(len(own))
            ids.extend([get(w, 0) for w in own])
            ids.extend((0,) * WINDOW)  # no window crosses texts: 0 is no word of the benchmark
        found = index.search(np.array(ids, np.int32))
        owner = np.searchsorted(np.array(starts), [s for s, _ in found], side="right") - 1
        spans: list[list] = [[] for _ in starts]
        items: list[set] = [set() for _ in starts]
        for k, (s, key) in zip(owner, found):
            spans[k].append((s - starts[k], s - starts[k] + len(key) // 4))
            items[k].update(index.items[key])
        out.extend((n, _merged(p), sorted(i)) for n, p, i in zip(counts, spans, items))
    return out


def benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's items in blocks of at most BLOCK_ITEMS items and about BLOCK_CHARS characters."""
    block, chars = [], 0
    for row in benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        block.append((row.i, row.t))
        chars += len(row.t or "")
        if len(block) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    yield block


def _annotate(column: Column, items: list, before: Column | None) -> Column:
    index = Index(items)

    @F.arrow_udf(FOUND)
    def first(text: pa.Array) -> pa.Array:
        return _found(annotate_texts(index, text.to_pylist()), None)

    @F.arrow_udf(FOUND)
    def later(text: pa.Array, found: pa.Array) -> pa.Array:
        return _found(annotate_texts(index, text.to_pylist()), found.to_pylist())

    return first.asNondeterministic()(column) if before is None else later.asNondeterministic()(column, before)


def _found(rows: list, before: list | None) -> pa.Array:
    if before is not None:
        rows = [(n, _merged(s + [(x["start"], x["end"]) for x in b["spans"]]), sorted({*i, *b["items"]})) for (n, s, i), b in zip(rows, before)]
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
    return pa.array([{"n_words": n, "spans": [{"start": a, "end": b} for a, b in s], "items": i} for n, s, i in rows], kind)


def annotate(documents: DataFrame, benchmark: DataFrame, text: str = "text", name: str = "_found") -> DataFrame:
    """``documents`` with a struct ``name``: n_words, hit spans, and ids (as strings) of the items with occurring windows.

    All rows and columns stay, repeated rows and ids too. A null or empty text has no words, and so
    has one of separators only. Items without words, and items whose id is null, match nothing;
    items repeated under one id count once. An empty benchmark leaves every document clean.
    """
    out, before = documents, None
    for block in benchmark_blocks(benchmark):
        out = out.withColumn(name, _annotate(F.col(f"`{text}`"), block, before))
        before = F.col(name)
    return out


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any benchmark window, columns unchanged, whatever their names.

    Null and empty texts hold no window and stay, and so do all documents where the benchmark is empty. Ids play no part.
    """
    name = free_name(documents, "_found")
    found = annotate(documents, benchmark, name=name)
    return found.filter(F.size(f"{name}.spans") == 0).drop(name) if name in found.columns else documents


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items met and their digest."""
    found = annotate(documents.select("doc_id", "text"), benchmark)
    hit = F.aggregate("_found.spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", F.col("_found.n_words").alias("n_words"), hit.alias("n_hit"), F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_found.items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )

"""Helpers shared by the text operators: worker caches, ragged arrays, components, row keys."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and, as one struct ``_row``, every column, so that no name of theirs meets one used inside."""
    return rows.select(*columns, F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"))


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def worker_cache(name: str, make: Callable):
    """``make()`` once per Python worker process, kept from task to task until another name is asked for.

    Spark keeps workers from query to query, so what an earlier operator held goes first.
    """
    held = sys.modules.setdefault("_cadastra_worker", types.ModuleType("_cadastra_worker"))
    if getattr(held, "name", None) != name:
        clear_worker_cache()
        held.value = make()
        held.name = name
    return held.value


def clear_worker_cache() -> None:
    """Let go what an earlier operator holds in this worker."""
    if held := sys.modules.get("_cadastra_worker"):
        held.name = held.value = None


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def slices(sizes: Sequence[int], most: int):
    """Consecutive (from, to) ranges whose sizes sum to about ``most``; a larger item stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected edges (a, b), component the smallest node reached.

    Every node hooks on to its smallest neighbour, pointers are doubled until they end at roots, and the edges are
    contracted to the roots; what is left has at most half the nodes, so all levels together cost
    little more than the first. Each step is written to the shared folder: a lost executor costs one step.
    """
    left = materialize(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    levels: list[DataFrame] = []
    while not levels or not left.isEmpty():
        both = left.union(left.select("b", "a"))
        roots = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_low")).select("node", F.least("node", "_low").alias("up")), "roots")
        while True:
            above = roots.select(F.col("node").alias("_at"), F.col("up").alias("_above"))
            jumped = materialize(roots.join(above, F.col("up") == F.col("_at")).select("node", F.col("up").alias("_was"), F.col("_above").alias("up")), "roots")
            roots = jumped.select("node", "up")
            if jumped.filter(F.col("_was") != F.col("up")).isEmpty():
                break
        levels.append(roots)
        ends = left.join(roots.select(F.col("node").alias("a"), F.col("up").alias("_a")), "a").join(roots.select(F.col("node").alias("b"), F.col("up").alias("_b")), "b")
        left = materialize(ends.filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
    labels = levels.pop().withColumnRenamed("up", "component")
    while levels:
        top = labels.withColumnRenamed("node", "up")
        labels = levels.pop().join(top, "up", "left").select("node", F.coalesce("component", "up").alias("component"))
    return materialize(labels, "components")

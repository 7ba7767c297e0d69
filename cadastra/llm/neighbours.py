"""Nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to the cells of ``PROJECTIONS`` Gaussian projections. A query visits its own bucket and the
``PROBES`` perturbed ones of the lowest summed squared distance to the crossed cell bounds, the
order of estimated success, in each of ``TABLES`` tables. What the buckets hold is ranked by exact
distance, and the tables' lists are merged.

Equal vectors are collapsed first; as ties go to the smaller id, a vector needs no more than the smallest ``k + 1`` of its
ids. Buckets are cut into blocks of bounded size, and a query's probe meets each. The cell width
follows the distances in a sample of at most ``SAMPLE`` vectors, which are all that reaches the driver; all vectors are
indexed. A query that finds fewer than k is answered by a scan of all vectors, such queries going in blocks of ``SCAN_BLOCK``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import mix
from cadastra.session import materialize, shared_dir

TABLES, PROJECTIONS, PROBES = 4, 8, 90
WIDTH = 1.77  # of a cell, in median distances of the sample
SAMPLE, SEED = 4096, 5
BLOCK, SCAN_BLOCK = 4096, 500
QUERY_TASK, SLICE = 256, 512  # queries whose probes one task names, and vectors hashed at a time

HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Tables:
    """Hash functions for vectors of each dimension; the width of a dimension comes from the sample."""

    def __init__(self, widths: dict[int, float]):
        self.widths = widths

    def _cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([SEED, x.shape[1]])
        a, b = rng.normal(size=(TABLES * PROJECTIONS, x.shape[1])), rng.random(TABLES * PROJECTIONS)
        at = (x @ a.T / self.widths.get(x.shape[1], 1.0) + b).reshape(len(x), TABLES, PROJECTIONS)
        low = np.floor(at)
        return low.astype(np.int64), at - low

    @staticmethod
    def _names(cells: np.ndarray, dimension: int) -> np.ndarray:
        """One number for a table's cells, given as (..., table, projection)."""
        h = np.broadcast_to(mix(np.arange(TABLES, dtype=np.uint64) + np.uint64(TABLES * dimension)), cells.shape[:-1])
        for k in range(PROJECTIONS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[..., k].astype(np.uint64))
        return h.view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        return self._names(self._cells(x)[0], x.shape[1])

    def probes(self, x: np.ndarray) -> np.ndarray:
        """The buckets each vector visits, all tables in a row."""
        low, within = self._cells(x)
        out = np.repeat(low[:, None], PROBES + 1, axis=1)
        for q in range(len(x)):
            for t in range(TABLES):
                for p, moves in enumerate(perturbations(within[q, t]), 1):
                    for j, step in moves:
                        out[q, p, t, j] += step
        return self._names(out, x.shape[1]).reshape(len(x), -1)


def perturbations(within: np.ndarray) -> list[list[tuple[int, int]]]:
    """Up to PROBES sets of (projection, step), by their summed squared distance to the bounds crossed."""
    n = len(within)
    cost = np.concatenate([within**2, (1 - within) ** 2])
    order = np.argsort(cost, kind="stable")
    cost = cost[order]
    moves = [(int(j % n), -1 if j < n else 1) for j in order]
    heap, out = [(cost[0], (0,))], []
    while heap and len(out) < PROBES:
        total, chosen = heapq.heappop(heap)
        if len({moves[j][0] for j in chosen}) == len(chosen):
            out.append([moves[j] for j in chosen])
        last = chosen[-1]
        if last + 1 < 2 * n:
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
    return out


def nearest(query: np.ndarray, own: int, vectors: np.ndarray, norms: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[float, int]]:
    """The k nearest ids among vectors given with the ids of each, by distance, then id, the query's own left out."""
    rough = norms - 2 * (vectors @ query)
    if len(rough) > k + 17:
        bound = np.partition(rough, k + 16)[k + 16]
        at = np.flatnonzero(rough <= bound)
    else:
        at = np.arange(len(rough))
    score = np.sqrt(((vectors[at] - query) ** 2).sum(1))
    return sorted((float(s), i) for s, j in zip(score, at) for i in ids[j] if i != own)[:k]


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id and the vector in doubles, without null ids, and without null, empty, zero or not wholly finite vectors."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of each dimension in a batch."""
    lengths = np.array([len(x) for x in column], np.int64)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, column.take(pa.array(at)).flatten().to_numpy().reshape(len(at), int(d))


def search(vectors: DataFrame, is_query, k: int = 10, column: str = "embedding") -> DataFrame:
    """The k nearest rows of each query row: query_id, rank, vec_id, score (Euclidean distance), ties to the smaller id.

    ``is_query`` is a condition on vec_id. Rows without an id and vectors that are null, empty or zero or hold null or
    non-finite components take no part. Rows that repeat an id and its vector count once; an id with several
    vectors is as many candidates, all of them left out for a query of that id. Vectors meet those of
    their own dimension only. Fewer than k candidates are returned whole, none for an empty table.
    """
    given = usable(vectors, column)
    first = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    groups = given.withColumn("_r", first).filter(F.col("_r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    groups = materialize(groups, "vectors")
    queries = materialize(given.filter(is_query).distinct().withColumnRenamed("vec_id", "query_id"), "queries")
    tables = Tables(_widths(groups))

    def names(probing: bool):
        @F.arrow_udf("array<bigint>")
        def read(v: pa.Array) -> pa.Array:
            out: list = [None] * len(v)
            for at, x in _rows(v):
                for a in range(0, len(at), SLICE):
                    some = x[a : a + SLICE]
                    for j, own in zip(at[a : a + SLICE], tables.probes(some) if probing else tables.buckets(some)):
                        out[j] = np.unique(own)
            return pa.array(out, pa.list_(pa.int64()))

        return read.asNondeterministic()

    index = groups.withColumn("bucket", F.explode(names(False)("v")))
    # Only buckets of more than one block are named, one for BLOCK vectors of the index at most, so no vector is shuffled to meet them.
    large = index.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).filter("parts > 1")
    large = F.broadcast(materialize(large, "large-buckets"))
    parts = F.coalesce("parts", F.lit(1))
    index = index.join(large, "bucket", "left").withColumn("block", F.pmod(F.xxhash64("v"), parts).cast("int"))
    index = index.select("bucket", "block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_id"), "ids", "v")
    asking = queries.repartition(max(1, -(-queries.count() // QUERY_TASK)), "query_id")
    probes = asking.withColumn("bucket", F.explode(names(True)("v"))).join(large, "bucket", "left")
    probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0), parts - 1)))
    probes = probes.select("bucket", "block", F.lit(1).alias("kind"), "query_id", F.lit(None).cast("array<bigint>").alias("ids"), "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, ids, matrix = None, [], [], None
        for batch in batches:
            out = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "kind", "query_id", "ids")))
            vectors_ = batch.column("v")
            for j, (bucket, block, kind, query, own) in enumerate(keys):
                if (bucket, block) != group:
                    group, held, ids, matrix = (bucket, block), [], [], None
                v = vectors_[j].values.to_numpy(zero_copy_only=False)
                if kind == 0:
                    held.append(v)
                    ids.append(own)
                elif held:
                    if matrix is None:
                        matrix = np.stack(held)
                        norms = (matrix**2).sum(1)
                    out += [{"query_id": query, "vec_id": i, "score": s} for s, i in nearest(v, query, matrix, norms, ids, k)]
            yield pa.RecordBatch.from_pylist(out, HITS)

    dealt = index.unionByName(probes).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "kind")
    hits = materialize(_best(dealt.mapInArrow(meet, "query_id long, vec_id long, score double"), k), "hits")
    full = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).select("query_id")
    short = queries.join(full, "query_id", "left_anti")
    block: list = []
    found = hits.join(full, "query_id", "left_semi")
    scanned, scans = shared_dir(groups.sparkSession, "scanned"), 0
    for row in short.toLocalIterator():
        block.append((row.query_id, row.v))
        if len(block) == SCAN_BLOCK:
            _scan(groups, block, k).write.parquet(f"{scanned}/block={scans}", compression="zstd")
            block, scans = [], scans + 1
    if scans:
        found = found.unionByName(groups.sparkSession.read.schema(hits.schema).parquet(f"{scanned}/*"))
    if block:
        found = found.unionByName(_scan(groups, block, k))
    return found.select("query_id", "rank", "vec_id", "score")


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query among partial lists."""
    once = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _scan(groups: DataFrame, block: list, k: int) -> DataFrame:
    """Exact answers of a block of queries, from one pass over all vectors."""
    block = [(q, np.array(v)) for q, v in block]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column("ids").to_pylist(), []
            for at, x in _rows(batch.column("v")):
                norms, own = (x**2).sum(1), [ids[j] for j in at]
                for q, v in block:
                    if len(v) == x.shape[1]:
                        out += [{"query_id": q, "vec_id": i, "score": s} for s, i in nearest(v, q, x, norms, own, k)]
            yield pa.RecordBatch.from_pylist(out, HITS)

    return _best(groups.select("ids", "v").mapInArrow(read, "query_id long, vec_id long, score double"), k)


def _sample(groups: DataFrame) -> DataFrame:
    """Vectors of the SAMPLE least hashes; to find them, only hashes go from a task to another."""
    hashed = groups.select("v", F.xxhash64("v").alias("_h"))
    last = hashed.select("_h").orderBy("_h").limit(SAMPLE).agg(F.max("_h")).first()[0]
    return hashed.filter(F.col("_h") <= last)


def _widths(groups: DataFrame) -> dict[int, float]:
    """Cell width by dimension, from distances between neighbours in a sample ordered by hash."""
    rows = [np.array(r.v) for r in sorted(_sample(groups).collect(), key=lambda r: r["_h"])[:SAMPLE]]
    out = {}
    for d in {len(v) for v in rows}:
        x = np.stack([v for v in rows if len(v) == d])
        gaps = np.sqrt(((x[1:] - x[:-1]) ** 2).sum(1))
        out[d] = WIDTH * float(np.median(gaps)) if len(gaps) and np.median(gaps) > 0 else 1.0
    return out

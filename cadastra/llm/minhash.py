"""Near-duplicate documents by SuperMinHash, banding, verification on full sets and grouping.

A document is the set of its distinct word shingles. Documents of one set are collapsed first, so
copies, however many, cost one set. In a SuperMinHash signature every element visits the positions in
an order of its own, and position values of layer j lie between j and j + 1; a set whose positions are all filled
needs no further layer. Sets that share a band are candidates: a bucket gives a star to its smallest
member, never all pairs, and the connected candidates form a cluster. Inside a cluster links are
confirmed on the full sets, block by block, and only links that join what is still apart are kept; union-find
over them gives the groups.

At a similarity of 0.8 a pair misses all 40 bands of 6 with probability (1 - 0.8^6)^40, 5 in a million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import components, mix, ragged, slices, whole_rows
from cadastra.llm.scoring import words
from cadastra.session import materialize

BANDS, ROWS = 40, 6
LAYERS = 12  # traced for all sets; sets with positions left are small and get whole permutations
BLOCK_SHINGLES = 1_000_000  # of a cluster, confirmed together
HUBS = 8  # members of a large cluster that meet every block
SIMILARITY = 80  # percent
CACHED_WORDS = 300_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_OPEN = np.uint64(0xFFFFFFFFFFFFFFFF)


class Shingler:
    """Distinct shingle hashes of texts."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct shingles of each text; one shingle of all words where there are fewer, none without words."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        own = [words(t) for t in texts]
        flat = [w for ws in own for w in ws]
        for w in set(flat).difference(self.known):
            self.known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        codes = np.fromiter(map(self.known.__getitem__, flat), np.uint64, len(flat))
        out, at = [], 0
        for ws in own:
            mine = codes[at : at + len(ws)]
            at += len(ws)
            n = min(self.size, len(mine))
            if not n:
                out.append(np.zeros(0, np.uint64))
                continue
            h = np.full(len(mine) - n + 1, n, np.uint64)
            for k in range(n):
                h = mix(h * _STEP + mine[k : len(mine) - n + 1 + k])
            out.append(np.unique(h))
        return out


def _draws(elements: np.ndarray, layer: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each element in a layer: the rank within the layer, and the place to swap with."""
    h = mix(elements + np.uint64(0x9E3779B97F4A7C15 * (layer + 1) % 2**64))
    swap = np.uint64(layer) + ((h >> np.uint64(32)) * np.uint64(size - layer) >> np.uint64(32))
    return (h & np.uint64(0xFFFFFFFF)) | (np.uint64(layer) << np.uint64(32)), swap.astype(np.int64)


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, a row each."""
    out = np.full((len(sets), size), _OPEN)
    flat = out.reshape(-1)
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    swaps: list[np.ndarray] = []
    for layer in range(min(LAYERS, size)):
        value, swap = _draws(elements, layer, size)
        place = swap.copy()
        for i in range(layer - 1, -1, -1):  # where the earlier swaps took it from
            place = np.where(place == swaps[i], i, place)
        at = owner * size + place
        free = flat[at] >= np.uint64(layer) << np.uint64(32)
        np.minimum.at(flat, at[free], value[free])
        swaps.append(swap)
        left = (out == _OPEN).any(1)
        stay = left[owner]
        if not stay.any():
            return out
        if not stay.all():
            elements, owner, swaps = elements[stay], owner[stay], [s[stay] for s in swaps]
    for lo, hi in slices(np.bincount(owner, minlength=len(sets)).tolist(), 50_000):
        mine = (owner >= lo) & (owner < hi)
        some, whose = elements[mine], owner[mine]
        if not len(some):
            continue
        order = np.tile(np.arange(size, dtype=np.int16), (len(some), 1))
        row = np.arange(len(some))
        for layer in range(size):
            value, swap = _draws(some, layer, size)
            place = order[row, swap].copy()
            order[row, swap] = order[:, layer]
            np.minimum.at(flat, whose * size + place, value)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, different from band to band."""
    key = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(signature), 1))
    parts = signature.reshape(len(signature), BANDS, ROWS)
    for k in range(ROWS):
        key = mix(key * _STEP + parts[:, :, k])
    return key.view(np.int64)


def set_key(shingles: np.ndarray) -> str:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()


def sketch(documents: DataFrame, size: int, *more: str) -> DataFrame:
    """doc_id, n_shingles, key of the set, band keys, and the columns ``more``."""

    @F.arrow_udf("struct<n:bigint,key:string,bands:array<bigint>>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("n", pa.int64()), ("key", pa.string()), ("bands", pa.list_(pa.int64()))])
        shingler = Shingler(size)
        for text in batches:
            texts, rows = text.to_pylist(), []
            for lo, hi in slices([len(t or "") for t in texts], 1_000_000):
                sets = shingler.sets(texts[lo:hi])
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(signatures(full)) if full else ())
                rows += [{"n": len(s), "key": set_key(s), "bands": next(keys)} if len(s) else {"n": 0, "key": None, "bands": []} for s in sets]
            yield pa.array(rows, kind)

    return documents.select("doc_id", *more, read.asNondeterministic()("text").alias("_s")).select("doc_id", *more, F.col("_s.n").alias("n_shingles"), F.col("_s.key").alias("key"), F.col("_s.bands").alias("bands"))


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join all sets connected by a similarity of ``percent`` or more, found breadth first."""
    if len(sets) < 2:
        return []
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(codes.max() + 1, np.int32)
    apart, links = np.arange(len(sets)), []
    while len(apart) > 1:
        queue, apart = [apart[0]], apart[1:]
        flat, bounds = codes[ragged(starts[apart], sizes[apart])], np.cumsum(sizes[apart]) - sizes[apart]
        while queue and len(apart):
            x = queue.pop()
            own = codes[starts[x] : starts[x] + sizes[x]]
            mark[own] = 1
            both = np.add.reduceat(mark[flat], bounds)
            mark[own] = 0
            near = 100 * both >= percent * (sizes[x] + sizes[apart] - both)
            if near.any():
                links += [(int(x), int(y)) for y in apart[near]]
                queue += apart[near].tolist()
                apart = apart[~near]
                flat, bounds = codes[ragged(starts[apart], sizes[apart])], np.cumsum(sizes[apart]) - sizes[apart]
    return links


def confirm(members: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) inside the groups of ``keys``; members carry key and the packed set, a group fits a task by construction."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in range(len(keys))]
            for k, (key, packed) in enumerate(zip(batch.column("key").to_pylist(), batch.column("packed").to_pylist())):
                own = tuple(c[k] for c in columns)
                if own != group:
                    out += _links(held, percent)
                    group, held = own, {}
                held[key] = packed
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["a", "b"])
        out = _links(held, percent)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["a", "b"])

    placed = members.select(*keys, "key", "packed").repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(read, "a string, b string")


def _links(held: dict[str, bytes], percent: int) -> list[tuple[str, str]]:
    names = sorted(held)
    return [(names[a], names[b]) for a, b in linked([np.frombuffer(held[n], np.uint64) for n in names], percent)]


def packed_sets(documents: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """Members with their shingles packed, read again from the document that stands for the set."""

    @F.arrow_udf("struct<own:string,packed:binary>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler = Shingler(size)
        for text in batches:
            texts, rows = text.to_pylist(), []
            for lo, hi in slices([len(t or "") for t in texts], 1_000_000):
                rows += [{"own": set_key(s), "packed": s.tobytes()} for s in shingler.sets(texts[lo:hi])]
            yield pa.array(rows, pa.struct([("own", pa.string()), ("packed", pa.binary())]))

    met = documents.select("doc_id", "text").join(members, "doc_id").withColumn("_s", read.asNondeterministic()("text"))
    return met.filter(F.col("_s.own") == F.col("key")).select("cluster", "parts", "key", F.col("_s.packed").alias("packed"))


def groups_of_sets(documents: DataFrame, sketched: DataFrame, size: int, percent: int = SIMILARITY) -> DataFrame:
    """(key, component key) of the sets that are linked with another."""
    sets = sketched.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    sets = materialize(sets, "sets")
    buckets = sets.select("key", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("key").alias("a"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    stars = buckets.join(shared, "bucket").filter("key <> a").select("a", F.col("key").alias("b")).distinct()
    clusters = components(stars)
    members = clusters.withColumnRenamed("node", "key").withColumnRenamed("component", "cluster").join(sets.select("key", "doc_id", "n"), "key")
    volume = members.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"))
    packed = materialize(packed_sets(documents, members.join(volume, "cluster").drop("n"), size), "packed").withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    # First each block by itself, the hubs of a large cluster in all its blocks.
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("key"), "key"))
    hubs = packed.filter("parts > 1").select("cluster", "parts", "key").withColumn("_r", rank).filter(F.col("_r") <= HUBS).select("cluster", "key", "parts")
    hubs = packed.drop("block").join(hubs.drop("parts"), ["cluster", "key"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    links = materialize(confirm(packed.unionByName(hubs), ["cluster", "block"], percent), "links")
    large = packed.filter("parts > 1")
    if not large.isEmpty():
        # Then what is still apart from the largest group of its cluster meets every block.
        found = components(links)
        state = large.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        sizes = state.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("_n"))
        main = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("_n", "component")).alias("_main"))
        rest = materialize(state.join(main, "cluster").filter("component <> _main").select("cluster", "parts", "key", "packed"), "rest")
        volume = rest.groupBy("cluster").agg(F.ceil(F.sum(F.length("packed") / 8) / BLOCK_SHINGLES).cast("int").alias("chunks"))
        rest = rest.join(volume, "cluster").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
        rest = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cluster", "block", "chunk", "key", "packed")
        every = large.join(volume, "cluster").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("cluster", "block", "chunk", "key", "packed")
        links = links.union(materialize(confirm(every.unionByName(rest), ["cluster", "block", "chunk"], percent), "links"))
    return components(links).withColumnRenamed("node", "key").withColumnRenamed("component", "group")


def near_duplicates(documents: DataFrame, size: int, percent: int = SIMILARITY) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id, kept.

    The component is the smallest id reached over links of at least ``percent`` similarity. Texts without
    words link with nothing. Rows of one id are kept or dropped by their own texts, so a repeated row stays as
    often as it comes. A row without an id has no component, links nothing and is kept. Empty tables give no rows.
    """
    return _judged(documents.select("doc_id", "text"), size, percent)


def _judged(given: DataFrame, size: int, percent: int, *more: str) -> DataFrame:
    named = given.filter("doc_id IS NOT NULL")
    sketched = materialize(sketch(given, size, *more), "sketches")
    groups = groups_of_sets(named, sketched.filter("doc_id IS NOT NULL"), size, percent)
    own = sketched.drop("bands").join(groups, "key", "left")
    own = own.withColumn("_group", F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "key")))
    lowest = own.filter("_group IS NOT NULL").groupBy("_group").agg(F.min("doc_id").alias("_lowest"))
    several = own.join(lowest, "_group", "left")
    component = F.coalesce("_lowest", "doc_id")
    return several.select("doc_id", *more, "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def remove_near_duplicates(documents: DataFrame, size: int, percent: int = SIMILARITY) -> DataFrame:
    """Documents with one of each group left, the one of the smallest id; rows of one id go by their own texts; columns
    unchanged, whatever their names. Rows without an id, and null and empty texts, are in no group and stay."""
    digest = F.sha2("text", 256)
    judged = _judged(documents.select("doc_id", "text", digest.alias("_digest")), size, percent, "_digest")
    gone = judged.filter("NOT kept").select(F.col("doc_id").alias("_gone_id"), F.col("_digest").alias("_gone_text")).distinct()
    given = whole_rows(documents, "doc_id", "text")
    kept = given.join(gone, (F.col("doc_id") == F.col("_gone_id")) & (digest == F.col("_gone_text")), "left_anti")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in documents.columns])

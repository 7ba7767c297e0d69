"""Packing documents into sequences of at most ``CAPACITY`` tokens.

Tokens are counted once, narrow, and written. All the packing needs is how many pieces there are of
each length, at most ``CAPACITY`` numbers however large the corpus. On them the dominance
reduction fixes small sets that no other choice can beat, best fit packs the rest, and both act on
whole classes of equal lengths at a time. The plan that results says, for a length and the rank of a piece
among the pieces of that length, which sequence and place it takes; pieces are ranked in parts, so
a common length does not meet in one task.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import ragged, slices, worker_cache
from cadastra.session import materialize

CAPACITY, END_ID = 4096, 1
PART_ROWS = 50_000  # pieces of one length that one task ranks
CACHED_CHUNKS = 300_000  # chunks whose ids a worker keeps
SLICE_BYTES = 1_000_000  # of text that is taken apart at a time

MARKS = ".,"  # may follow a run of letters as a token of their own
_CHUNK = re.compile(r"(?m)^(?:([a-zß-öø-ÿ]+)([.,]?)|(.+))$")  # a run of lower-cased Latin letters and its mark, or anything else
PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


class ChunkEncoder:
    """Ids of texts, each distinct chunk between ASCII white space being encoded once.

    The tokenizer drops white space and merges only inside a run of letters, so a text's ids are
    those of its chunks. New runs of Latin letters are encoded many at a time; every run ends
    with a token that carries the word-end mark, by which the ids are dealt out again. All other chunks
    are encoded one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Lower-cased runs of Latin letters are normal already and are split by the space put between them.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        marks = [self.tokenizer.encode(m, add_special_tokens=False).ids for m in MARKS]
        if any(len(m) != 1 for m in marks):
            raise ValueError("a mark must be one token")
        self.marks = np.array([m[0] for m in marks], np.uint32)
        self.clear()

    def clear(self) -> None:
        self.codes: dict[bytes, int] = {}  # of a chunk: three times the number of its entry, and its mark
        self.entries: dict[str, int] = {}
        self.flat = np.zeros(1 << 18, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.again = np.zeros(1 << 16, bool)  # entries that were met in a later slice, which are worth keeping
        self.used = 0

    def _shrink(self) -> None:
        """Keep the chunks whose entries were met again, half of the cache at most, with the entries in a row anew."""
        chunks, code = list(self.codes), np.fromiter(self.codes.values(), np.int64, len(self.codes))
        kept = np.flatnonzero(self.again[code // 3])[: CACHED_CHUNKS // 2]
        entry, mark = np.divmod(code[kept], 3)
        used, place = np.unique(entry, return_inverse=True)
        names = list(self.entries)
        lengths = self.starts[used + 1] - self.starts[used]
        ids = self.flat[ragged(self.starts[used], lengths)]
        self.clear()
        self._add([names[k] for k in used.tolist()], ids, lengths)
        self.codes.update(zip([chunks[k] for k in kept.tolist()], (3 * place + mark).tolist()))

    def _add(self, names: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Entries for new names, whose ids stand in a row."""
        first, end = len(self.entries), self.used + len(ids)
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(names) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        self.flat[self.used : end] = ids
        self.starts[first + 1 : first + len(names) + 1] = self.used + np.cumsum(lengths)
        self.used = end
        self.entries.update(zip(names, range(first, first + len(names))))

    def _learn(self, raw: list[bytes]) -> list[int]:
        """The codes of new chunks."""
        joined = b"\n".join(raw).decode("utf-8", "replace")
        found = _CHUNK.findall(joined.lower())
        names, marks = [f[0] for f in found], [0] * len(raw)
        chunks: list[str] = []
        for k, (word, mark, _) in enumerate(found):
            if mark:
                marks[k] = 1 + MARKS.index(mark)
            elif not word:  # all other chunks are entries as they stand, told from words by the space in front
                chunks = chunks or joined.split("\n")
                names[k] = " " + chunks[k]
        new = sorted(set(names).difference(self.entries))
        other = [n for n in new if n[0] == " "]
        plain = new[len(other) :]
        if other:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([n[1:] for n in other], add_special_tokens=False)]
            self._add(other, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids]))
        for k in range(0, len(plain), 2000):
            some = plain[k : k + 2000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("a run of letters must end with one word-end token")
            self._add(some, ids, np.diff(ends, prepend=0))
        codes = [3 * self.entries[n] + m for n, m in zip(names, marks)]
        self.codes.update(zip(raw, codes))
        return codes

    def encode(self, texts: list[str | bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        if len(self.codes) > CACHED_CHUNKS:
            self._shrink()
        raw = pa.array([t.encode("utf-8", "replace") if isinstance(t, str) else t for t in texts], pa.binary())
        chunks = pc.ascii_split_whitespace(raw.view(pa.string()))
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(chunks).to_numpy(zero_copy_only=False))
        flat = pc.list_flatten(chunks).view(pa.binary()).dictionary_encode()
        distinct = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.codes.get, distinct, repeat(-1)), np.int64, len(distinct))
        self.again[known[known >= 0] // 3] = True
        # Only white space at the ends of a text leaves an empty chunk, which has no code.
        if missing := [k for k in np.flatnonzero(known < 0).tolist() if distinct[k]]:
            known[missing] = self._learn([distinct[k] for k in missing])
        code = known[flat.indices.to_numpy()]
        owner, code = owner[code >= 0], code[code >= 0]
        entry, mark = np.divmod(code, 3)
        lengths = self.starts[entry + 1] - self.starts[entry]
        marked = mark > 0
        whole = lengths + marked
        ids = np.zeros(int(whole.sum()), np.uint32)
        ends = np.cumsum(whole)
        ids[ragged(ends - whole, lengths)] = self.flat[ragged(self.starts[entry], lengths)]
        ids[ends[marked] - 1] = self.marks[mark[marked] - 1]
        return ids, np.bincount(owner, whole, len(texts)).astype(np.int64)


def cut(ids: np.ndarray, capacity: int) -> list[dict]:
    """Pieces of one document's ids."""
    data = ids.astype("<u4")
    return [
        {"piece": k, "start": s, "length": len(data[s : s + capacity]), "ids_crc32": zlib.crc32(data[s : s + capacity].tobytes())}
        for k, s in enumerate(range(0, len(data), capacity))
    ]


def pieces_of(texts: list[str | bytes | None], encoder: ChunkEncoder, capacity: int = CAPACITY) -> list[list[dict]]:
    out = []
    texts = [t or b"" for t in texts]
    for lo, hi in slices([len(t) for t in texts], SLICE_BYTES):
        ids, counts = encoder.encode(texts[lo:hi])
        for own in np.split(ids, np.cumsum(counts)[:-1]):
            out.append(cut(np.append(own, np.uint32(END_ID)), capacity))
    return out


def split_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """One row per piece with all columns of the document but its text: piece, start, length, ids_crc32 in a struct ``_piece``."""

    @F.arrow_udf(PIECES)
    def split(column: pa.Array) -> pa.Array:
        encoder = worker_cache(f"encoder:{tokenizer_path}", lambda: ChunkEncoder(tokenizer_path))
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        out = []
        # A batch is taken apart some texts at a time, so its words are never held all at once.
        for lo, hi in slices(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), SLICE_BYTES):
            out.append(pa.array(pieces_of(column.slice(lo, hi - lo).to_pylist(), encoder, capacity), kind))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return documents.withColumn("_piece", F.explode(split.asNondeterministic()(F.col(f"`{text}`").cast("binary")))).drop(text)


def reduce_counts(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix sets of lengths that dominate every other set with their longest member; lowers ``counts`` in place.

    With j the longest of a set and r what it leaves: alone, if nothing fits r; with a piece of
    exactly r, for what else would fill r can go where that piece was; with the longest piece k that fits,
    if no two pieces fit r, or if no three do and the two longest that fit together are no more than k. Where three
    may fit, their sum can outweigh k, and j is left to best fit.
    """
    fixed = []
    moved = True
    while moved:
        moved = False
        for j in np.flatnonzero(counts)[::-1]:
            j = int(j)
            while counts[j]:
                rest = capacity - j
                own = counts[j]
                counts[j] -= 1  # the partner may be another piece of the same length
                fit = np.flatnonzero(counts[: rest + 1])
                counts[j] += 1
                if not len(fit):
                    fixed.append(((j,), int(own)))
                    counts[j] = 0
                    moved = True
                    break
                k = int(fit[-1])
                if k != rest:
                    least = _least(counts, fit, j)
                    if sum(least[:2]) <= rest and len(least) > 1 and (sum(least) <= rest and len(least) > 2 or _best_pair(counts, fit, j, rest) > k):
                        break
                q = int(own // 2 if k == j else min(own, counts[k]))
                counts[j] -= q
                counts[k] -= q
                fixed.append(((j, k), q))
                moved = True
    return fixed


def _least(counts: np.ndarray, fit: np.ndarray, j: int) -> list[int]:
    """The lengths of the three shortest pieces other than one of length j."""
    out: list[int] = []
    for length in fit[:3].tolist():
        out += [length] * int(min(3, counts[length] - (length == j)))
    return out[:3]


def _best_pair(counts: np.ndarray, fit: np.ndarray, j: int, rest: int) -> int:
    """The largest sum within ``rest`` of two pieces other than one of length j."""
    best, lo, hi = 0, 0, len(fit) - 1
    while lo <= hi and best < rest:
        if lo == hi and counts[fit[lo]] - (fit[lo] == j) < 2:
            break
        total = int(fit[lo] + fit[hi])
        if total <= rest:
            best = max(best, total)
            lo += 1
        else:
            hi -= 1
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of lengths in falling order; bins alike are kept as one group with a number."""
    room: list[int] = []  # of the open groups, rising
    groups: dict[int, list[list]] = {}
    full = []

    def put(pattern: tuple[int, ...], number: int, left: int) -> None:
        if not left:
            full.append((pattern, number))
        else:
            if left not in groups:
                insort(room, left)
            groups.setdefault(left, []).append([pattern, number])

    for length in np.flatnonzero(counts)[::-1]:
        length, left = int(length), int(counts[length])
        while left:
            at = bisect_left(room, length)
            if at == len(room):
                pattern, number, space = (), left, capacity
            else:
                space = room[at]
                pattern, number = groups[space].pop()
                if not groups[space]:
                    del groups[space], room[at]
            most = space // length
            take = min(number, left // most)
            if take:
                put(pattern + (length,) * most, take, space - most * length)
            elif left:
                put(pattern + (length,) * left, 1, space - left * length)
                take, most = 1, left
            left -= take * most
            if pattern and number > take:
                put(pattern, number - take, space)
    return full + [(p, n) for g in groups.values() for p, n in g]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, offset of the first), ordered by length and rank."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    patterns = reduce_counts(counts, capacity) + best_fit(counts, capacity)
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, number in patterns:
        offset = k = 0
        while k < len(pattern):
            length, m = pattern[k], 1
            while k + m < len(pattern) and pattern[k + m] == length:
                m += 1
            rows.append((length, used.get(length, 0), m, sequence, offset))
            used[length] = used.get(length, 0) + m * number
            offset += m * length
            k += m
        sequence += number
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(rows: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank among equals."""
    shift = np.int64(1) << np.int64(48)
    at = np.searchsorted(rows[:, 0] * shift + rows[:, 1], length * shift + rank, side="right") - 1
    _, first, m, sequence, offset = rows[at].T
    within = rank - first
    return sequence + within // m, offset + within % m * length


def rank_in_length(pieces: DataFrame, sizes: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0 in ``_rank``; a length of many pieces is ranked in parts."""
    parts = sizes.select(F.col("length").alias("_l"), F.ceil(F.col("n") / PART_ROWS).alias("_parts"))
    ids = [c for c in pieces.columns if c in ("doc_id", "piece", "start", "ids_crc32")]
    split = pieces.join(F.broadcast(parts), pieces.length == F.col("_l"))  # at most one row a length
    split = split.withColumn("_part", F.pmod(F.xxhash64(*ids), F.col("_parts"))).drop("_l", "_parts")
    before = Window.partitionBy("_bl").orderBy("_bp").rowsBetween(Window.unboundedPreceding, -1)
    starts = split.groupBy(F.col("length").alias("_bl"), F.col("_part").alias("_bp")).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_bl", "_bp", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_part").orderBy(*ids)
    ranked = split.withColumn("_rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(starts, (F.col("length") == F.col("_bl")) & (F.col("_part") == F.col("_bp")))
    return ranked.withColumn("_rank", F.col("_rank") + F.col("_start")).drop("_bl", "_bp", "_start", "_part")


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of its end id alone. Only documents over the capacity are cut.
    Repeated rows and ids are packed as often as they come, a null id too. An empty table packs
    to no rows. Other columns are left behind.
    """
    cut_up = split_documents(documents.select("doc_id", "text"), tokenizer_path, capacity).select("doc_id", "_piece.*")
    pieces = materialize(cut_up, "pieces")
    sizes = materialize(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    rows = plan({r.length: r.n for r in sizes.collect()}, capacity)  # at most one row a length
    kind = pa.struct([("sequence_id", pa.int64()), ("offset", pa.int64())])

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = place(rows, length.to_numpy(), rank.to_numpy())
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], fields=list(kind))

    ranked = rank_in_length(pieces, sizes).withColumn("_at", placed.asNondeterministic()(F.col("length"), F.col("_rank").cast("long")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")

"""Line de-duplication as an exact set-similarity join.

A line is the set of its words. A line goes when an earlier line, by document id and line number,
has a Jaccard similarity of at least 0.8 with it; equal sets are found by their digest, the rest by the
join. Words are ordered by rarity, counted over all lines in a table of fixed size, and a line is posted under its
first |x| - ceil(0.8 |x|) + 1 words: two similar lines share one of them. Postings are shuffled in blocks, a part of
the words at a time, and a part's words are met in one task. Where two meet, sizes, positions
and a parity bitmap (whose bits cannot differ in more places than the sets do) leave few pairs, and those are
verified on their whole sets. A longer line has a wider bitmap, since a full one tells nothing apart; a wide one
is folded to the width of a narrow one to compare the two.

A line needs one earlier partner, so a group of near copies hands out its closest few and not all
pairs. A line whose partners failed is taken up again with every partner the filters leave; for that, only lines
that hold one of its posted words are posted once more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import mix, ragged, slices, whole_rows
from cadastra.llm.decontaminate import FOLD
from cadastra.session import materialize

MIN_WORDS = 1  # distinct words of a line that takes part
LEAST_POSTED = 4  # the smallest set that can be similar to another than itself, one of five words; smaller ones meet by their digest
PARTNERS = 3  # handed out for a line at a posting at first
RARITY_BUCKETS = 1 << 22  # a bucket counted once holds one word of one line, which meets no other
DOC_BUCKETS = 1 << 20  # of document ids, which bounds what says where verified lines stand
CACHED_SETS = 300_000  # equal sets that a task remembers
WIDE, WIDEST = 32, 80  # lines of more words have 128 and 256 bits in place of 64
BITS = ("bits", "bits1", "bits2", "bits3")
NO_ID = -(2**63)  # stands for a null id, in front of all others

POST = np.dtype([("token", "<i8"), ("doc", "<i8"), ("line", "<i4"), ("size", "<i4"), ("pos", "<i4"), *[(b, "<i8") for b in BITS]])
SINGLE = "token long, doc long, line int, size int, pos int, " + ", ".join(f"{b} long" for b in BITS)
BLOCK_WORDS = 1_000_000  # that a task counts at a time
BLOCK_POSTS = 125_000  # postings that a task gathers before it deals them out
MET_PAIRS = 500_000  # that are gathered at a posting before each line keeps its closest few
PART_WORDS = 1_000_000  # words of the table for each part of the postings
COUNTED = 1 << 16  # rarity buckets counted in one block
COUNT = np.dtype([("at", "<u2"), ("n", "<i8")])
PAIRS = pa.schema([("doc", pa.int64()), ("line", pa.int32()), ("a_doc", pa.int64()), ("a_line", pa.int32()), ("more", pa.bool_())])


def need(a, b):
    """The overlap that 0.8 asks of sets of these sizes: the least whole number of at least 4/9 of their sum."""
    return -(-(4 * (a + b)) // 9)


def prefix(size):
    return size - -(-(4 * size) // 5) + 1


def bitmaps(codes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The parity bitmap of each line as 64-bit words, those beyond a line's width 0."""
    width = np.where(size > WIDEST, 256, np.where(size > WIDE, 128, 64)).astype(np.uint64)
    at = mix(codes.view(np.uint64) + np.uint64(1)) & (np.repeat(width, size) - np.uint64(1))
    bit, word = np.uint64(1) << (at & np.uint64(63)), at >> np.uint64(6)
    most = int(width.max()) >> 6
    return [np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), starts) if k < most else np.zeros(len(size), np.uint64) for k in range(len(BITS))]


def bits_apart(bits: list[np.ndarray], size: np.ndarray, left: np.ndarray, right: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs may be similar, and the bits by which their bitmaps differ at the width of the left line, the smaller one."""
    differ = [b[left] ^ b[right] for b in bits]
    apart = np.bitwise_count(differ[0] ^ differ[1] ^ differ[2] ^ differ[3]).astype(np.int64)
    fits = np.flatnonzero(apart <= spare)
    apart = apart[fits]
    for least, folds in ((WIDE, ((0, 2), (1, 3))), (WIDEST, ((0,), (1,), (2,), (3,)))):
        wide = np.flatnonzero(size[left[fits]] > least)
        if len(wide):
            apart[wide] = sum(np.bitwise_count(reduce(np.bitwise_xor, [differ[k][fits[wide]] for k in fold])).astype(np.int64) for fold in folds)
    kept = apart <= spare[fits]
    return fits[kept], apart[kept]


_CODE_BITS = 48  # of a word's code; the others name its line where words are sorted
_STEP = 8  # bytes of a word that are hashed at a time
_LONGEST = 256  # longer words are hashed one by one
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(_STEP + 1)], np.uint64)


def word_codes(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code of every word, the line it stands in (all lines of all texts counted on), and the first line of each text."""
    parts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t or b"" for t in texts]
    raw = b"\n".join([*parts, b""])
    first = np.cumsum([0, *[p.count(b"\n") + 1 for p in parts]])
    folded = b" " + raw.translate(FOLD) + bytes(2 * _STEP - (len(raw) + 1) % _STEP).replace(b"\0", b" ")
    data = np.frombuffer(folded, np.uint8)
    word = data != 32
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, size = edges[::2], edges[1::2] - edges[::2]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    whole = data.view("<u8")
    codes = size.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D)
    left, own = np.arange(len(start)), start
    for k in range(0, min(int(size.max()), _LONGEST), _STEP):
        if k:
            left = left[size[left] > k]
            own = start[left] + k
        shift = ((own & 7) << 3).astype(np.uint64)
        at = own >> 3
        some = (whole[at] >> shift) | ((whole[at + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        codes[left] = mix(codes[left] ^ (some & _MASKS[np.minimum(size[left] - k, _STEP)]))
    for k in np.flatnonzero(size > _LONGEST).tolist():
        codes[k] = int.from_bytes(hashlib.blake2b(folded[start[k] : start[k] + size[k]], digest_size=8).digest(), "little")
    feeds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    row = np.repeat(np.arange(len(feeds)), np.diff(np.searchsorted(start, feeds), prepend=0))
    return (codes >> np.uint64(64 - _CODE_BITS)).view(np.int64), row, first


def read_lines(texts: list[str | bytes | None], wanted: list | None = None, count: Callable | None = None, looked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and number of each line of MIN_WORDS distinct words or more, its size, and all codes in a row, rising in a line.

    ``wanted`` names the lines of each text to read, ``looked`` the buckets of which a line must hold a word; ``count`` is
    given the buckets of all words.
    """
    codes, row, first = word_codes(texts)
    if count is not None:
        count(_bucket(codes))
    if looked is not None:
        held = np.zeros(first[-1], bool)
        held[row[looked[_bucket(codes)]]] = True
        codes, row = codes[held[row]], row[held[row]]
    if wanted is not None:
        asked = np.zeros(first[-1], bool)
        asked[[first[k] + n for k, own in enumerate(wanted) for n in own if n < first[k + 1] - first[k]]] = True
        codes, row = codes[asked[row]], row[asked[row]]
    if first[-1] < 1 << 63 - _CODE_BITS:
        both = np.sort((row << _CODE_BITS) | codes)
        both = both[np.r_[True, both[1:] != both[:-1]][: len(both)]]
        codes, row = both & ((1 << _CODE_BITS) - 1), both >> _CODE_BITS
    else:  # more lines than those bits number
        order = np.lexsort((codes, row))
        codes, row = codes[order], row[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
        codes, row = codes[new], row[new]
    size = np.bincount(row, minlength=first[-1])
    keep = size >= MIN_WORDS
    lines = np.flatnonzero(keep)
    where = np.searchsorted(first, lines, side="right") - 1
    return where, (lines - first[where]).astype(np.int32), size[keep], codes[keep[row]]


def _short(x: np.ndarray) -> np.ndarray:
    """The same numbers in 16 bits where they fit, which sort in linear time."""
    return x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x


def _batches(batches: Iterator[pa.RecordBatch], **how):
    for batch in batches:
        docs, texts = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("text").cast(pa.binary())
        wanted = batch.column("lines").to_pylist() if "lines" in batch.schema.names else None
        for lo, hi in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 1_000_000):
            where, number, size, codes = read_lines(texts.slice(lo, hi - lo).to_pylist(), wanted and wanted[lo:hi], **how)
            yield docs[lo:hi].astype(np.int64)[where], number, size, codes


def _bucket(codes: np.ndarray) -> np.ndarray:
    return codes & (RARITY_BUCKETS - 1)


def line_keys(documents: DataFrame) -> DataFrame:
    """doc, line, two numbers that tell its set; rows with a ``part`` hold the counts of a task's words in COUNTED buckets instead."""

    def read(batches):
        total = np.zeros(RARITY_BUCKETS, np.uint32)
        held: list[np.ndarray] = []

        def count(buckets, most=BLOCK_WORDS):
            held.append(buckets)
            if sum(map(len, held)) >= most:
                at, n = np.unique(np.concatenate(held), return_counts=True)
                total[at] += n.astype(np.uint32)
                held.clear()

        for docs, number, size, codes in _batches(batches, count=count):
            if len(size):
                starts = np.cumsum(size) - size
                keys = [np.add.reduceat(mix(codes.view(np.uint64) ^ np.uint64(k)), starts).view(np.int64) for k in (0, 0x6A09E667F3BCC909)]
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(number), *map(pa.array, keys), pa.nulls(len(docs), pa.int32()), pa.nulls(len(docs), pa.binary())], names)
        count(np.zeros(0, np.int64), 0)
        for k in range(0, RARITY_BUCKETS, COUNTED):
            at = np.flatnonzero(total[k : k + COUNTED])
            if len(at):
                counts = np.empty(len(at), COUNT)
                counts["at"], counts["n"] = at, total[k : k + COUNTED][at]
                nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*nothing, pa.array([k // COUNTED], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names)

    names = ["doc", "line", "key", "key2", "part", "counts"]
    return documents.mapInArrow(read, "doc long, line int, key long, key2 long, part int, counts binary")


def rarity(documents: DataFrame) -> np.ndarray:
    """How often the words of each bucket occur, as a rank of 255 steps: 0 never, 1 once, then by the logarithm."""
    return ranks(line_keys(documents))


def ranks(keys: DataFrame) -> np.ndarray:
    """The ranks of ``rarity`` from the counts beside the keys."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}  # of the parts, RARITY_BUCKETS numbers in all
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                counts = np.frombuffer(data, COUNT)
                sums.setdefault(part, np.zeros(COUNTED, np.int64))[counts["at"]] += counts["n"]
        for part, n in sums.items():
            rank = np.where(n > 1, np.minimum(255, 2 + np.floor(8 * np.log2(np.maximum(n, 1)))), n).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rank.tobytes()], pa.binary())], ["part", "rank"])

    counts = keys.filter("part IS NOT NULL").select("part", "counts").repartition("part")
    rows = counts.mapInArrow(add, "part int, rank binary").toArrow()  # RARITY_BUCKETS bytes at most
    out = np.zeros(RARITY_BUCKETS, np.uint8)
    for part, rank in zip(rows["part"].to_pylist(), rows["rank"].to_pylist()):
        out[part * COUNTED : (part + 1) * COUNTED] = np.frombuffer(rank, np.uint8)
    return out


def parts_of(counts: np.ndarray) -> int:
    """Parts of the postings, as many as the words ask for."""
    words = np.where(counts > 1, 2.0 ** ((counts.astype(np.float64) - 2) / 8), counts).sum()
    return 16 + int(words) // PART_WORDS


def postings(documents: DataFrame, counts: np.ndarray, looked: np.ndarray | None = None, single: bool = False) -> DataFrame:
    """The prefix words of each line of LEAST_POSTED words or more, in blocks of POST by ``part`` of the words; of equal sets, a task leaves
    out what comes after one it has posted. With ``looked``, only words of those buckets. With ``single``, the rows of ``single_posts``, by the
    same Python worker: a second one for each task would stay beside it with memory of its own."""
    parts = parts_of(counts)

    def post(batches):
        seen: dict = {}
        held: list[np.ndarray] = []
        for docs, number, size, codes in _batches(batches, looked=looked):
            if not len(size):
                continue
            row = np.repeat(np.arange(len(size)), size)
            starts = np.cumsum(size) - size
            hashes = np.add.reduceat(mix(codes), starts)
            bits = [b.view(np.int64) for b in bitmaps(codes, starts, size)]
            new = np.zeros(len(size), bool)
            order = np.lexsort((number, docs))
            order = order[size[order] >= LEAST_POSTED]
            for k, h, b, n, doc, line in zip(*(x.tolist() for x in (order, hashes[order], bits[0][order], size[order], docs[order], number[order]))):
                own, at = (h, b, n), (doc, line)
                if own not in seen or at < seen[own]:
                    new[k] = True
                    if own in seen or len(seen) < CACHED_SETS:
                        seen[own] = at
            rank = counts[_bucket(codes)]
            ranked = np.argsort(rank, kind="stable")
            ranked = ranked[np.argsort(_short(row[ranked]), kind="stable")]
            position = np.arange(len(codes)) - np.repeat(starts, size)
            taken = (position < prefix(size)[row]) & new[row] & (rank[ranked] > 1)
            if looked is not None:
                taken &= looked[_bucket(codes[ranked])]
            own = row[taken]
            posts = np.empty(len(own), POST)
            for name, x in zip(POST.names, (codes[ranked][taken], docs[own], number[own], size[own], position[taken], *[b[own] for b in bits])):
                posts[name] = x
            if single:
                yield _rows(posts)
                continue
            held.append(posts)
            if sum(map(len, held)) >= BLOCK_POSTS:
                yield _dealt(held, parts)
                held = []
        if held:
            yield _dealt(held, parts)

    return documents.mapInArrow(post, SINGLE if single else "part int, posts binary")


def _dealt(held: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """A block for each part that postings belong to."""
    posts = np.concatenate(held)
    part = ((posts["token"] >> 22) % parts).astype(np.int32)
    order = np.argsort(_short(part), kind="stable")
    part = part[order]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.r_[first, len(part)].astype(np.int32) * POST.itemsize
    blocks = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(_taken(posts, order))])
    return pa.RecordBatch.from_arrays([pa.array(part[first]), blocks], ["part", "posts"])


def _taken(posts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``posts[order]``, moved as bytes."""
    return posts.view(np.uint8).reshape(-1, POST.itemsize).take(order, axis=0).view(POST)[:, 0]


def single_posts(posts: DataFrame) -> DataFrame:
    """A row for each posting of the blocks."""

    def read(batches):
        for batch in batches:
            for data in batch.column("posts").to_pylist():
                yield _rows(np.frombuffer(data, POST))

    return posts.mapInArrow(read, SINGLE)


def _rows(block: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(block[c])) for c in POST.names], list(POST.names))


def pairs_of(columns: list[np.ndarray]) -> pa.RecordBatch:
    """PAIRS of whole postings that stand in a row, in order of token, document and line.

    Lines of a posting that agree in size, bitmap and position are all paired with the first of them only, which then stands
    for them. The others are ordered by size, and each meets those behind it while the sizes allow. A line gets its closest
    few earlier partners, and ``more`` says that there are others, handed out or not: also those that stand behind a partner and
    before the line.
    """
    token, doc, line, size, pos, *bits = columns
    bits = [b.view(np.uint64) for b in bits]
    posting = np.cumsum(np.r_[0, token[1:] != token[:-1]])
    order = np.lexsort((_short(pos), bits[0], _short(size), _short(posting)))
    same = np.zeros(len(order), bool)
    same[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (posting, size, *bits, pos)])
    stand = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    later, earlier, more = [order[same]], [stand[same]], [np.ones(int(same.sum()), bool)]
    chosen = order[~same]
    behind = np.full(len(order), len(order))  # the first line that a chosen one stands for
    second = np.flatnonzero(same & ~np.r_[True, same[:-1]][: len(same)])
    behind[order[second - 1]] = order[second]
    where, s, b, p = posting[chosen], size[chosen], [x[chosen] for x in bits], pos[chosen]
    end = np.searchsorted(where, where, side="right")
    met, gathered, n = np.zeros((3, 0), np.int64), [], 0
    others = np.zeros(len(order), bool)  # of a line, that there are more than are kept
    left, step = np.arange(len(chosen)), 0
    while len(left):
        step += 1
        left = left[left + step < end[left]]
        left = left[4 * s[left + step] <= 5 * s[left]]
        right = left + step
        both = s[left] + s[right]
        spare = both - 2 * need(s[left], s[right])
        fits, apart = bits_apart(b, s, left, right, spare)
        if len(fits):
            x, y = left[fits], right[fits]
            close = 2 * np.minimum(s[x] - p[x], s[y] - p[y]) >= both[fits] - spare[fits]
            x, y = chosen[x][close], chosen[y][close]
            x, y = np.minimum(x, y), np.maximum(x, y)
            good = (doc[x] != doc[y]) | (line[x] != line[y])
            x, y = x[good], y[good]
            others[y[behind[x] < y]] = True
            gathered.append(np.stack([x, y, apart[close][good]]))
            n += len(x)
            if n >= MET_PAIRS + met.shape[1]:
                met, gathered, n = _closest([met, *gathered], others), [], 0
    x, y, _ = _closest([met, *gathered], others)
    later.append(y)
    earlier.append(x)
    more.append(others[y])
    b, a, m = np.concatenate(later), np.concatenate(earlier), np.concatenate(more)
    return pa.RecordBatch.from_arrays([pa.array(doc[b]), pa.array(line[b]), pa.array(doc[a]), pa.array(line[a]), pa.array(m)], schema=PAIRS)


def _closest(met: list[np.ndarray], others: np.ndarray) -> np.ndarray:
    """The closest few earlier partners of each line, in order; ``others`` marks lines that had more."""
    a, b, apart = np.concatenate(met, axis=1)
    order = np.lexsort((a, apart, b))
    later = b[order]
    first = np.flatnonzero(np.r_[True, later[1:] != later[:-1]][: len(later)])
    kept = np.arange(len(later)) - np.repeat(first, np.diff(np.r_[first, len(later)])) < PARTNERS
    others[later[~kept]] = True
    order = order[kept]
    return np.stack([a[order], b[order], apart[order]])


def candidates(posts: DataFrame) -> DataFrame:
    """(doc, line, a_doc, a_line, more): pairs that pass the filters, the earlier line under a_."""

    def read(batches):
        part, held = None, []  # the blocks of a part
        for batch in batches:
            for k, data in zip(batch.column("part").to_pylist(), batch.column("posts")):
                if k != part:
                    yield from _met(held)
                    part, held = k, []
                held.append(np.frombuffer(data.as_buffer(), POST))  # where the batch has them
        yield from _met(held)

    return posts.repartition("part").sortWithinPartitions("part").mapInArrow(read, "doc long, line int, a_doc long, a_line int, more boolean")


def _met(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """PAIRS of the blocks of a part; words that one line alone is posted under meet nothing."""
    if not held:
        return
    posts = np.concatenate(held)
    held.clear()
    order = np.argsort(posts["token"])
    token = posts["token"][order]
    same = token[1:] == token[:-1]
    shared = np.r_[False, same] | np.r_[same, False]
    if shared.any():
        order, posting = order[shared], np.cumsum(np.r_[True, ~same])[shared]
        posting -= posting[0]
        line, doc = posts["line"][order], posts["doc"][order]
        posts = _taken(posts, order[np.lexsort((_short(line), doc, _short(posting)))])
        del order, token, same, shared, posting, line, doc
        yield pairs_of([np.ascontiguousarray(posts[c]) for c in POST.names])


def all_candidates(posts: DataFrame, own: DataFrame) -> DataFrame:
    """(doc, line, a_doc, a_line): each line of the postings ``own`` with every earlier line of ``posts`` that passes the filters of ``pairs_of``."""
    a, b = posts.select("token", *[F.col(c).alias(f"a_{c}") for c in posts.columns if c != "token"]), own
    both = F.col("size") + F.col("a_size")
    spare = both - 2 * F.ceil(4 * both / F.lit(9))
    less = F.least("size", "a_size")
    x = [F.col(k).bitwiseXOR(F.col(f"a_{k}")) for k in BITS]
    apart = (
        F.when(less > WIDEST, reduce(lambda m, n: m + n, [F.bit_count(d) for d in x]))
        .when(less > WIDE, F.bit_count(x[0].bitwiseXOR(x[2])) + F.bit_count(x[1].bitwiseXOR(x[3])))
        .otherwise(F.bit_count(reduce(lambda m, n: m.bitwiseXOR(n), x)))
    )
    close = 2 * F.least(F.col("size") - F.col("pos"), F.col("a_size") - F.col("a_pos")) >= both - spare
    earlier = (F.col("a_doc") < F.col("doc")) | ((F.col("a_doc") == F.col("doc")) & (F.col("a_line") < F.col("line")))
    met = a.withColumnRenamed("token", "a_token").join(
        b, (F.col("a_token") == F.col("token")) & earlier & (5 * less >= 4 * F.greatest("size", "a_size")) & (apart <= spare) & close)
    return met.select("doc", "line", "a_doc", "a_line").distinct()


def holding(documents: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the buckets of ``docs`` leave, all rows of those documents among them."""
    bucket = F.pmod(F.xxhash64("doc"), F.lit(DOC_BUCKETS)).alias("_bucket")
    return documents.select("*", bucket).join(F.broadcast(docs.select(bucket).distinct()), "_bucket", "left_semi").drop("_bucket")  # at most DOC_BUCKETS rows


def verified(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``similar``, the Jaccard test on the whole sets."""
    ends = pairs.select("doc", "line").union(pairs.select("a_doc", "a_line")).distinct()
    wanted = ends.groupBy("doc").agg(F.collect_set("line").alias("lines"))  # at most the lines of a document
    near = holding(documents, wanted)

    def read(batches):
        for docs, number, size, codes in _batches(batches):
            flat = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(codes))
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(number), flat], ["doc", "line", "codes"])

    sets = near.join(wanted, "doc").select("doc", "text", "lines").mapInArrow(read, "doc long, line int, codes array<long>")
    sets = materialize(sets, "line-sets")
    left = pairs.join(sets.withColumnRenamed("codes", "_b"), ["doc", "line"])
    right = sets.select(F.col("doc").alias("a_doc"), F.col("line").alias("a_line"), F.col("codes").alias("_a"))
    both = left.join(right, ["a_doc", "a_line"])
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.select("doc", "line", "more", (5 * shared >= 4 * (F.size("_a") + F.size("_b") - shared)).alias("similar"))


def repeated_lines(documents: DataFrame) -> DataFrame:
    """(doc, line) of the lines that go; ``documents`` hold doc and text."""
    read = materialize(line_keys(documents), "line-keys")
    keys = read.filter("part IS NULL").select("doc", "line", "key", "key2")
    first = keys.groupBy("key", "key2").agg(F.min(F.struct("doc", "line")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    same = keys.join(first, ["key", "key2"]).filter(F.struct("doc", "line") != F.col("_first")).select("doc", "line")
    same = materialize(same, "equal-lines")
    counts = ranks(read)
    pairs = candidates(postings(documents, counts)).groupBy("doc", "line", "a_doc", "a_line").agg(F.max("more").alias("more"))
    pairs = materialize(pairs.join(same, ["doc", "line"], "left_anti"), "pairs")
    judged = materialize(verified(documents, pairs), "judged").groupBy("doc", "line").agg(F.max("similar").alias("similar"), F.max("more").alias("more"))
    gone = judged.filter("similar").select("doc", "line")
    again = materialize(judged.filter("more AND NOT similar").select("doc", "line"), "again")  # its size is known: a small one is sent to the postings
    if not again.isEmpty():
        # They meet every partner this time: their own postings, few as they are, look through all others of their words.
        own = postings(holding(documents, again), counts, single=True).join(again, ["doc", "line"], "left_semi")
        own = materialize(own.select(*POST.names), "own-postings")
        looked = np.zeros(RARITY_BUCKETS, bool)
        looked[own.select(F.pmod("token", F.lit(RARITY_BUCKETS)).alias("at")).distinct().toArrow()["at"].to_numpy()] = True  # at most RARITY_BUCKETS rows
        others = postings(documents, counts, looked, single=True)  # read once more, which costs less than keeping them
        pairs = materialize(all_candidates(others, own), "pairs").withColumn("more", F.lit(False))
        gone = gone.union(verified(documents, pairs).filter("similar").select("doc", "line"))
    return materialize(same.union(gone).distinct(), "repeated-lines")


def numbered(documents: DataFrame) -> DataFrame:
    """``documents`` with the number of their id in ``_doc``: ids that are no whole numbers stand in order of their hashes."""
    whole = documents.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return documents.withColumn("_doc", F.coalesce(number, F.lit(NO_ID)))


def edited(documents: DataFrame) -> DataFrame:
    """``documents`` with the numbers of their lines that go in ``_gone`` (null: none) and the text left in ``_left``.

    Lines are split at line feeds and numbered from 0; those without a word always stay. Null and empty
    texts have nothing to remove. Rows of one id are one document: a number that goes in one goes in all, and a repeated row
    stays as often as it comes. Rows without an id are one document in front of the others. Columns of other names stay.
    """
    given = numbered(documents)
    gone = repeated_lines(given.select(F.col("_doc").alias("doc"), "text")).groupBy("doc").agg(F.collect_set("line").alias("_gone"))
    out = given.join(gone.withColumnRenamed("doc", "_doc"), "_doc", "left")
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.filter(F.transform(lines, lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda s: ~F.array_contains("_gone", s["k"]))["x"], "\n")
    return out.withColumn("_left", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left)).drop("_doc")


def remove_repeated_lines(documents: DataFrame) -> DataFrame:
    """Documents without their repeated lines, n_chars (if there) counted anew; those of which nothing but white space is left go.

    Other columns stay as they are, whatever their names. A document from which no line goes stays as it is, a null or empty
    text among them; an empty table gives none.
    """
    out = edited(whole_rows(documents, "doc_id", "text")).filter(F.col("_gone").isNull() | F.col("_left").rlike(r"\S"))
    changed = {"text": F.col("_left")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(F.col("_gone").isNull(), F.col("_row.n_chars")).otherwise(F.length("_left")).cast(documents.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in documents.columns])


def report(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed line numbers and the digest of the text left."""
    out = edited(documents.select("doc_id", "text"))
    return out.select(
        "doc_id", F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(F.array_sort(F.coalesce("_gone", F.array().cast("array<int>"))), ",").alias("removed_lines"), F.sha2(F.coalesce("_left", F.lit("")), 256).alias("text_sha256"),
    )

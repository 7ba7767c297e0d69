"""Exact token counts at every prefix of a text, from one pass of prefix dynamic programming.

In byte-pair encoding a prefix's tokens are those of a shorter prefix and one last token, and the last
token is the only one whose border with the token before it no merge ever crosses. So one table
over the prefixes of a run of letters gives the count at each of them, with the word-end mark and without,
in time linear in the run. Runs are independent of one another: a text's table is the sum of the tables of
its chunks, and truncation and budget questions are look-ups in it.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import ragged, slices, worker_cache

LIMIT = 2048
CACHED_CHUNKS = 300_000  # chunks whose tables a worker keeps
CACHED_CHARS = 16_000_000
BATCH_BYTES = 4_000_000
SHORT, RUNS = 24, 8_000  # letters of a piece, and pieces, whose tables are made together
MARKS = ".,;:!?"

NEVER = 1 << 60
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SHORTENED = frozenset(["'re", "'ve", "'ll"])
_LATIN = regex.compile(r"[\x00-\xFF]*")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from 256 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


@cache
def _joining() -> frozenset[str]:
    """Characters that may melt into the one before them under canonical composition."""
    second = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in range(0xC0, 0x30000):
        parts = unicodedata.decomposition(chr(c))
        if parts and parts[0] != "<" and " " in parts:
            second.add(chr(int(parts.split()[1], 16)))
    return frozenset(second)


@cache
def _starts(char: str) -> bool:
    """Whether what stands before ``char`` is normalised apart from it."""
    first = unicodedata.normalize("NFD", char)[0]
    return not unicodedata.combining(first) and first not in _joining()


class Run:
    """The table of one run of characters that the tokenizer merges in: counts at each prefix, in symbols."""

    __slots__ = ("symbols", "last", "count")

    def __init__(self):
        self.symbols, self.last, self.count = "", [-1], [0]


class PrefixCounter:
    """Tables of texts under one tokenizer file: byte-level pairs with a word-end mark, as its library counts them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        spec = json.loads(tokenizer.to_str())
        model, end = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") if spec["pre_tokenizer"] and spec["pre_tokenizer"]["type"] == "Sequence" else None
        if model["type"] != "BPE" or not end or model.get("continuing_subword_prefix") or model.get("ignore_merges") or pattern != _PIECE.pattern:
            raise ValueError("prefix tables need byte-level pairs with a word-end mark and the known split pattern")
        self.normalize = tokenizer.normalizer.normalize_str
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens must be matched as they stand")
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.bytes = byte_symbols()
        self._merges([tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], model["vocab"], end)
        self.apart_cache: dict[int, bool] = {}
        self.runs: dict[str, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.runs.clear()
        self.apart_cache.clear()
        self.codes: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 18, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _merges(self, merges: list[tuple[str, str]], vocab: dict[str, int], end: str) -> None:
        """Ranks of pairs, and for each token what stands at its two borders while it is being built."""
        rank, formed, parts = {}, {}, {}
        for r, (a, b) in enumerate(merges):
            whole = vocab[a + b]
            a, b = vocab[a], vocab[b]
            if whole in parts or formed.get(a, -1) >= r or formed.get(b, -1) >= r:
                raise ValueError("every token must be built in one way, from tokens built before it")
            rank[a, b], formed[whole], parts[whole] = r, r, (a, b)
        self.rank = rank
        special = set(self.special)
        self.plain, self.ends = {}, {}
        for token, i in vocab.items():
            if token in special:
                continue
            if token.endswith(end) and len(token) > len(end):
                self.ends[token[: -len(end)]] = i
            else:
                self.plain[token] = i
        self.longest = max(map(len, [*self.plain, *self.ends]))

        def border(side: int) -> dict[int, list[tuple[int, int]]]:
            """(rank at which it changes, token at the border) from the single symbol up to the token itself."""
            out = {}
            for token in sorted(vocab.values(), key=lambda i: formed.get(i, -1)):
                if token in parts:
                    inner = out[parts[token][side]]
                    out[token] = inner[:-1] + [(formed[token], inner[-1][1]), (NEVER, token)]
                else:
                    out[token] = [(NEVER, token)]
            return out

        self.left, self.right = border(0), border(1)
        self._trie()

    def _trie(self) -> None:
        """Every token by its symbols as bytes: onward nodes, and the plain and the ending token of each node."""
        byte = {c: b for b, c in enumerate(self.bytes)}
        nodes: list[dict[int, int]] = [{}]
        tokens: list[tuple[int, int]] = [(-1, -1)]
        for column, names in ((0, self.plain), (1, self.ends)):
            for name, i in names.items():
                at = 0
                for c in name:
                    onward = nodes[at].get(byte[c])
                    if onward is None:
                        onward = nodes[at][byte[c]] = len(nodes)
                        nodes.append({})
                        tokens.append((-1, -1))
                    at = onward
                tokens[at] = (i, tokens[at][1]) if column == 0 else (tokens[at][0], i)
        keys = np.array([(at << 8) | b for at, onward in enumerate(nodes) for b in onward], np.int64)
        ends = np.array([to for onward in nodes for to in onward.values()], np.int32)
        order = np.argsort(keys)
        self.edges, self.edge_ends, self.node_tokens = keys[order], ends[order], np.array(tokens, np.int32)

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The nodes reached by one more symbol each, -1 where there is none."""
        key = (node.astype(np.int64) << 8) | symbol
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where((node >= 0) & (self.edges[at] == key), self.edge_ends[at], -1)

    def _apart_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 20 | b).tolist()
        known = map(self.apart_cache.get, keys)
        return np.array([self.apart(k >> 20, k & 0xFFFFF) if found is None else found for k, found in zip(keys, known)], bool)

    def _learn_runs(self, pieces: list[str]) -> None:
        """The tables of many short pieces at once: all of them one symbol on at a time."""
        raw = sorted((p.encode() for p in pieces), key=len)
        at = 0
        while at < len(raw):
            width = min(len(raw[min(len(raw), at + RUNS) - 1]), 2 * len(raw[at]) + 8)  # of equal widths, nearly
            some = [r for r in raw[at : at + RUNS] if len(r) <= width]
            at += len(some)
            self._learn_width(some, len(some[-1]))

    def _learn_width(self, raw: list[bytes], width: int) -> None:
        n = len(raw)
        size = np.array([len(r) for r in raw])
        symbols = np.zeros((width, n), np.int64)
        symbols.T[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
        found = np.full((width, width, 2, n), -1, np.int32)  # by start and last symbol: the plain and the ending token
        for s in range(width):
            node = np.zeros(n, np.int32)
            for k in range(s, min(width, s + self.longest)):
                node = self._step(node, symbols[k])
                if (node < 0).all():
                    break
                found[s, k] = np.where(node >= 0, self.node_tokens[node].T, -1)
        last, count, marked = np.full((width + 1, n), -1, np.int64), np.zeros((width + 1, n), np.int32), np.zeros((width, n), np.int32)
        for k in range(width):
            for column, counts in ((0, count[k + 1]), (1, marked[k])):
                left = np.flatnonzero(size > k)
                for s in range(max(0, k + 1 - self.longest), k + 1):
                    token = found[s, k, column, left]
                    own = np.flatnonzero(token >= 0)
                    if s and len(own):
                        own = own[self._apart_many(last[s, left[own]], token[own])]
                    if len(own):
                        hit = left[own]
                        counts[hit] = count[s, hit] + 1
                        if column == 0:
                            last[k + 1, hit] = token[own]
                        left = np.delete(left, own)
                    if not len(left):
                        break
                if len(left):
                    raise ValueError("a byte without a token")
        for r, length, row in zip(raw, size.tolist(), np.ascontiguousarray(marked.T)):
            piece = r.decode()
            table = row[:length].copy() if len(piece) == length else row[[k for k in range(length) if k + 1 == length or r[k + 1] & 0xC0 != 0x80]]
            if piece in _SHORTENED:  # cut inside, it is an apostrophe and a letter
                table[1] = table[0] + self._piece(piece[1])[0]
            self.runs[piece] = table

    def apart(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: no merge crosses their border while the two are built."""
        key = a << 20 | b
        found = self.apart_cache.get(key)
        if found is None:
            before, after, i, j, rank = self.right[a], self.left[b], 0, 0, self.rank
            while True:
                until, x = before[i]
                to, y = after[j]
                r = rank.get((x, y), NEVER)
                if r < until and r <= to and r != NEVER:
                    found = False
                    break
                if until == to == NEVER:
                    found = True
                    break
                if until <= to:  # of equal ranks the left one merges first
                    i += 1
                else:
                    j += 1
            self.apart_cache[key] = found
        return found

    def _grow(self, run: Run, symbols: str) -> None:
        """Lengthen a run by some symbols."""
        text = run.symbols = run.symbols + symbols
        last, count, plain, apart, known, longest = run.last, run.count, self.plain, self.apart, self.apart_cache, self.longest
        for k in range(len(last), len(text) + 1):
            for s in range(max(0, k - longest), k):
                token = plain.get(text[s:k])
                if token is not None and (not s or known.get(last[s] << 20 | token) or apart(last[s], token)):
                    last.append(token)
                    count.append(count[s] + 1)
                    break
            else:
                raise ValueError("a byte without a token")

    def _marked(self, run: Run, k: int) -> int:
        """Tokens of the first k symbols of a run as a run of their own."""
        text, last, ends = run.symbols, run.last, self.ends
        for s in range(max(0, k - self.longest), k):
            token = ends.get(text[s:k])
            if token is not None and (s == 0 or self.apart(last[s], token)):
                return run.count[s] + 1
        raise ValueError("a byte without a token")

    def _symbols(self, text: str) -> str:
        return "".join([self.bytes[b] for b in text.encode()])

    def _piece(self, piece: str) -> np.ndarray:
        """Counts at each prefix of one piece of normalised text, from its first character on."""
        found = self.runs.get(piece)
        if found is None:
            run = Run()
            self._grow(run, self._symbols(piece))
            ends = range(1, len(piece) + 1) if piece.isascii() else np.cumsum([len(c.encode()) for c in piece]).tolist()
            found = np.array([self._marked(run, k) for k in ends], np.int32)
            if piece in _SHORTENED:  # cut inside, it is an apostrophe and a letter
                found[1] = found[0] + self._piece(piece[1])[0]
            if len(piece) <= 64:
                self.runs[piece] = found
        return found

    def _normal(self, text: str) -> np.ndarray:
        """Counts at each prefix of normalised text."""
        out = np.zeros(len(text), np.int32)
        done = at = 0
        for m in _PIECE.finditer(text):
            s, e = m.span()
            out[at:s] = done
            out[s:e] = self._piece(m.group()) + done
            done, at = int(out[e - 1]), e
        out[at:] = done
        return out

    def _tail(self, normal: str, counts: np.ndarray, at: int, tail: str, held: dict) -> int:
        """Tokens of the first ``at`` normalised characters followed by ``tail``; ``held`` is the run met last, which grows along."""
        kind = _kind(tail[0])
        low = at
        if held and held["kind"] == kind and held["at"] <= at and all(_kind(c) == kind for c in normal[held["at"] : at]):
            low = held["low"]
        else:
            held.clear()
            while low and kind != "N" and _kind(normal[low - 1]) == kind:
                low -= 1
        if any(_kind(c) != kind for c in tail) or kind == "N" or low and normal[low - 1] == "'" or normal[low:at].startswith("'"):
            while low and _kind(normal[low - 1]) == "P":  # pieces of several kinds, or perhaps a shortened word
                low -= 1
            return (int(counts[low - 1]) if low else 0) + int(self._normal(normal[low:at] + tail)[-1])
        if not held:
            held.update(kind=kind, low=low, at=low, run=Run())
        run = held["run"]
        self._grow(run, self._symbols(normal[held["at"] : at]))
        held["at"], size = at, len(run.symbols)
        self._grow(run, self._symbols(tail))
        found = self._marked(run, len(run.symbols))
        run.symbols = run.symbols[:size]
        del run.last[size + 1 :], run.count[size + 1 :]
        return (int(counts[low - 1]) if low else 0) + found

    def _ordinary(self, text: str) -> np.ndarray:
        """Counts at each prefix of text without special strings."""
        if _LATIN.fullmatch(text):
            return self._normal(text.lower())
        marks = [i for i, c in enumerate(text) if _starts(c)]
        if not marks or marks[0]:
            marks.insert(0, 0)
        marks.append(len(text))
        parts = [self.normalize(text[a:b]) for a, b in zip(marks, marks[1:])]
        normal = "".join(parts)
        counts = self._normal(normal)
        out, at, held = np.zeros(len(text), np.int32), 0, {}
        for a, b, part in zip(marks, marks[1:], parts):
            for k in range(a + 1, b):
                inner = self.normalize(text[a:k])
                out[k - 1] = (counts[at + len(inner) - 1] if at + len(inner) else 0) if part.startswith(inner) else self._tail(normal, counts, at, inner, held)
            at += len(part)
            out[b - 1] = counts[at - 1] if at else 0
        return out

    def chunk(self, text: str) -> np.ndarray:
        """Counts at each prefix of text without white space, special strings included."""
        if _LATIN.fullmatch(text):
            low = text.lower()
            found = self.runs.get(low)
            if found is None and low[-1] in MARKS and len(low) > 1 and low[:-1].isalpha():
                found = self.runs.get(low[:-1])
                if found is not None:
                    found = np.append(found, found[-1] + self._piece(low[-1])[0])
            if found is not None:
                return found
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self._ordinary(text)
        out, done, low = [], 0, 0
        for m in self.special_pattern.finditer(text):
            inside = self._ordinary(text[low : m.end() - 1]) + done  # a special string cut short is plain text
            before = int(inside[m.start() - low - 1]) if m.start() > low else done
            done, low = before + 1, m.end()
            out += [inside, np.array([done], np.int32)]
        out.append(self._ordinary(text[low:]) + done)
        return np.concatenate(out)

    def _learn(self, raw: list[bytes]) -> None:
        """Tables of new chunks, the pieces that the plainly written ones are made of all at once."""
        texts = [c.decode() for c in raw]
        plain = " ".join([t for t in texts if len(t) <= SHORT and _LATIN.fullmatch(t)]).lower()
        pieces = set(_PIECE.findall(plain)).difference(self.runs)
        self._learn_runs([p for p in pieces if len(p) <= SHORT])
        tables = [self.chunk(t) for t in texts]
        code, whole = len(self.codes), np.concatenate(tables)
        ends = self.used + np.cumsum([len(t) for t in tables])
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while code + len(raw) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : ends[-1]] = whole
        self.starts[code + 1 : code + len(raw) + 1] = ends
        self.used = int(ends[-1])
        self.codes.update(zip(raw, range(code, code + len(raw))))

    def tables(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts after each character of all texts in a row, and where each text begins and ends in it."""
        if len(self.codes) > CACHED_CHUNKS or self.used > CACHED_CHARS:
            self.clear()
        joined = b" ".join(texts)
        data = np.frombuffer(joined + b" ", np.uint8)
        space, first = SPACE[data], (data & 0xC0) != 0x80
        place = np.cumsum(first) - first  # characters before each byte
        edge = np.diff(space.view(np.int8), prepend=np.int8(1))
        begin, stop = place[edge == -1], place[(edge == 1) & (np.arange(len(data)) > 0)]
        codes = self.codes
        chunks = joined.split()
        if new := set(chunks).difference(codes):
            self._learn(list(new))
        code = np.fromiter(map(codes.__getitem__, chunks), np.int64, len(chunks))
        table = np.zeros(int(place[-1]) + 1, np.int64)
        length = stop - begin
        inside = self.flat[ragged(self.starts[code], length)]
        total = self.flat[self.starts[code + 1] - 1] if len(code) else np.zeros(0, np.int32)
        table[stop] = total  # the character after a chunk is white space
        table = np.cumsum(table)
        table[ragged(begin, length)] += inside
        sizes = np.array([len(t) for t in texts], np.int64)
        ends_at = np.cumsum(sizes + 1) - 1
        ends = place[ends_at]
        starts = place[ends_at - sizes]
        base = np.where(starts > 0, table[starts - 1], 0)
        owner = np.repeat(base, ends + 1 - starts)
        return table - owner, np.stack([starts, ends], 1)


def _kind(char: str) -> str:
    kind = unicodedata.category(char)[0]
    return kind if kind in "LN" else "Z" if regex.match(r"\s", char) else "P"


def _batches(column: pa.Array):
    """Texts of a batch as bytes, some megabytes at a time; nulls are empty and broken characters are replaced."""
    texts = [v or b"" for v in column.to_pylist()]
    for lo, hi in slices([len(t) for t in texts], BATCH_BYTES):
        some = texts[lo:hi]
        try:
            b" ".join(some).decode()
        except UnicodeDecodeError:
            some = [t.decode("utf-8", "replace").encode() for t in some]
        yield lo, hi, some


def _counter(path: str) -> PrefixCounter:
    return worker_cache(f"prefix:{path}", lambda: PrefixCounter(path))


def with_prefix_counts(rows: DataFrame, tokenizer_path: str, text: str = "text", name: str = "prefix_tokens") -> DataFrame:
    """``rows`` with an array of token counts: entry k is the count of the first k code points, entry 0 is 0.

    Null texts are empty. Every other column stays as it is.
    """

    @F.arrow_udf("array<int>")
    def counts(column: pa.Array) -> pa.Array:
        counter, values, sizes = _counter(tokenizer_path), [], []
        for _, _, texts in _batches(column):
            table, bounds = counter.tables(texts)
            for a, b in bounds:
                values += [np.zeros(1, np.int32), table[a:b].astype(np.int32)]
                sizes.append(int(b - a) + 1)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32)))

    return rows.withColumn(name, counts.asNondeterministic()(F.col(f"`{text}`").cast("binary")))


def tokens_of(prefix: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` code points, of the whole text if it has fewer."""
    chars = chars if isinstance(chars, Column) else F.lit(chars)
    return F.element_at(prefix, F.least(chars, F.size(prefix) - 1).cast("int") + 1)


def longest_within(prefix: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    return F.array_max(F.transform(prefix, lambda n, k: F.when(n <= budget, k)))


def truncate(text: Column, prefix: Column, budget: Column | int) -> Column:
    """The longest prefix of ``text`` of at most ``budget`` tokens."""
    return F.substring(F.coalesce(text, F.lit("")), F.lit(1), longest_within(prefix, budget))


def report(documents: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, kept_chars and kept_tokens: the longest prefix within the limit.

    One row per row: repeated rows and ids are counted as often as they come, a null id too. A null or empty text
    has no bytes and no tokens. An empty table gives no rows. Other columns are left behind.
    """
    kind = pa.struct([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("kept_chars", pa.int64()), ("kept_tokens", pa.int64())])

    @F.arrow_udf("struct<n_bytes:bigint,n_tokens:bigint,kept_chars:bigint,kept_tokens:bigint>")
    def counts(column: pa.Array) -> pa.Array:
        counter, out = _counter(tokenizer_path), np.zeros((4, len(column)), np.int64)
        for lo, hi, texts in _batches(column):
            table, bounds = counter.tables(texts)
            start, end = bounds.T
            out[0, lo:hi] = [len(t) for t in texts]
            out[1, lo:hi] = np.where(end > start, table[end - 1], 0)
            place = np.arange(len(table))
            within = np.where(table <= limit, place, -1)
            last = np.maximum.reduceat(within, start)
            last = np.where(last == end, last - 1, last)  # the blank between two texts belongs to neither
            kept = np.where((end > start) & (last >= start), last - start + 1, 0)
            out[2, lo:hi] = kept
            out[3, lo:hi] = np.where(kept > 0, table[np.maximum(last, 0)], 0)
        return pa.StructArray.from_arrays([pa.array(v) for v in out], fields=list(kind))

    counted = documents.select("doc_id", counts.asNondeterministic()(F.col("text").cast("binary")).alias("_n"))
    return counted.select("doc_id", "_n.n_bytes", "_n.n_tokens", (F.col("_n.n_tokens") > limit).alias("over_limit"), "_n.kept_chars", "_n.kept_tokens")

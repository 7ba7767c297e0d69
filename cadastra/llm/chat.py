"""Chat formatting: conversations to token ids with a loss mask, and back.

A turn is built from segments. Control strings are never put through the tokenizer: each is one
reserved id beyond the vocabulary, spliced between the separately encoded texts, so no merge crosses a
boundary. Where each segment lies follows from prefix sums of segment lengths, and so does the loss mask, which
covers assistant texts only. Control strings occurring inside a text are escaped by one more
backslash after their first character, which reading back removes.

    <s> [INST] user text [/INST] [ANS] assistant text </s> [SYS] system text [/SYS] [ROLE] other role [/ROLE] text </s> ...

The result has one row per turn with the offset of its ids in the conversation, so no conversation
is gathered into one row; a conversation of any length streams through in turn order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import slices, worker_cache

MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]"]
BRACKETS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("[ANS]", "</s>")}

_PLAIN = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]|ANS\]|SYS\]|ROLE\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]|ANS\]|SYS\]|ROLE\]))")
TURN = "struct<ids:array<int>,mask:array<boolean>,n_chars:bigint>"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Codec:
    """Texts to ids and back, with the reserved ids after the tokenizer's own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.first = self.tokenizer.get_vocab_size()
        self.reserved = {m: self.first + k for k, m in enumerate(MARKS)}

    def encode_turns(self, roles: list[str], texts: list[str]) -> list[dict]:
        """ids, mask and formatted length of each turn."""
        segments: list[str | int] = []
        counts, masked = [], []
        for role, text in zip(roles, texts):
            if role in BRACKETS:
                before, after = BRACKETS[role]
                own = [self.reserved[before], escape(text), self.reserved[after]]
            else:
                own = [self.reserved["[ROLE]"], escape(role), self.reserved["[/ROLE]"], escape(text), self.reserved["</s>"]]
            segments += own
            counts.append(len(own))
            masked += [False, role == "assistant", False] if len(own) == 3 else [False] * 5
        encoded = iter(self.tokenizer.encode_batch([s for s in segments if isinstance(s, str)], add_special_tokens=False))
        ids = [[s] if isinstance(s, int) else next(encoded).ids for s in segments]
        ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
        steps = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int8)
        for k, on in enumerate(masked):
            if on and ids[k]:
                steps[ends[k] - len(ids[k])] += 1
                steps[ends[k]] -= 1
        mask = np.cumsum(steps)[:-1].astype(bool)
        flat = np.array([i for x in ids for i in x], np.int32)
        out, k, at = [], 0, 0
        for n in counts:
            to = int(ends[k + n - 1])
            chars = sum(len(MARKS[s - self.first]) if isinstance(s, int) else len(s) for s in segments[k : k + n])
            out.append({"ids": flat[at:to], "mask": mask[at:to], "n_chars": chars})
            k, at = k + n, to
        return out

    def decode_turn(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str]:
        """Role, text and masked text of one turn's ids; a leading start mark is passed over."""
        if len(ids) and ids[0] == self.reserved["<s>"]:
            ids, mask = ids[1:], mask[1:]
        cuts = np.flatnonzero(ids >= self.first)
        read = lambda x: unescape(self.tokenizer.decode(x.tolist(), skip_special_tokens=False))
        inner = [read(ids[a + 1 : b]) for a, b in zip(cuts, cuts[1:])]
        opening = MARKS[int(ids[0]) - self.first]
        role = next((r for r, (before, _) in BRACKETS.items() if before == opening), None)
        return (inner[0], inner[1], "") if role is None else (role, inner[0], read(ids[mask]))


def codec(path: str) -> Codec:
    return worker_cache(f"codec:{path}", lambda: Codec(path))


def format_turns(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per turn: conv_id, turn, position (from 0), offset, ids, mask, n_chars.

    Turns come in the order of turn, then role, then text, nulls first; repeated rows are turns of
    their own. Null texts and roles are empty, and an empty text gives its marks alone. Roles other than user,
    system and assistant are written out. Turns without a conversation id form one conversation. The first
    turn of a conversation carries the start mark. An empty table gives no rows; other columns
    are left behind.
    """

    @F.arrow_udf(TURN)
    def encode(role: pa.Array, text: pa.Array) -> pa.Array:
        kind = pa.struct([("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_())), ("n_chars", pa.int64())])
        roles, texts = role.to_pylist(), text.to_pylist()
        rows = []
        for lo, hi in slices([len(t) for t in texts], 1_000_000):
            rows += codec(tokenizer_path).encode_turns(roles[lo:hi], texts[lo:hi])
        return pa.array(rows, kind)

    spaced = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))
    encoded = spaced.withColumn("_t", encode.asNondeterministic()("_role", "_text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "_role", "_text")
    placed = encoded.withColumn("position", F.row_number().over(order) - 1)
    before = F.coalesce(F.sum(F.size("_t.ids")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.col("position") == 0
    return placed.withColumn("offset", F.when(start, F.lit(0)).otherwise(before + 1)).select(
        "conv_id", "turn", "position", "offset",
        F.when(start, F.concat(F.array(F.lit(codec(tokenizer_path).reserved[MARKS[0]])), "_t.ids")).otherwise(F.col("_t.ids")).alias("ids"),
        F.when(start, F.concat(F.array(F.lit(False)), "_t.mask")).otherwise(F.col("_t.mask")).alias("mask"),
        (F.col("_t.n_chars") + F.when(start, len(MARKS[0])).otherwise(0)).alias("n_chars"),
    )


class _Reader:
    """Digests of one conversation, fed turn by turn."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, masked: str, chars: int) -> None:
        self.turns += 1
        self.chars += chars
        self.loss_chars += len(masked)
        self.all.update(f"{role}\n{text}\n".encode())
        self.loss.update(masked.encode())

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per conversation the digests of what its ids and mask decode to.

    The rows of a conversation stand together in turn order, as the window that placed them left
    them; they are read as a stream, one digest open at a time.
    """
    kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, codec_ = None, codec(tokenizer_path)
        for batch in batches:
            done = []
            ids, mask = batch.column("ids"), batch.column("mask")
            for k, (conv, at, chars) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("position").to_pylist(), batch.column("n_chars").to_pylist())):
                if at == 0:
                    if reader:
                        done.append(reader.row())
                    reader = _Reader(conv)
                reader.add(*codec_.decode_turn(ids[k].values.to_numpy(zero_copy_only=False), mask[k].values.to_numpy(zero_copy_only=False)), chars)
            yield pa.RecordBatch.from_pylist(done, kind)
        if reader:
            yield pa.RecordBatch.from_pylist([reader.row()], kind)

    ordered = formatted.select("conv_id", "position", "ids", "mask", "n_chars").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

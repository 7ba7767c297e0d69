"""Repair of conversations whose turns were lost, blanked, cut, repeated or put in the wrong mouth.

A row's fault, the roles' first letters and the least edits that restore an alternating conversation follow from one
small code a row. The edits are found by depth-first branch and bound: nodes are (row, last
role), an explicit stack holds the open ones, a table of suffix bounds says what each node costs at
least from there on, the incumbent is the cheapest finished repair with its audit, and a table per node
drops every prefix that a cheaper, or equally cheap and ASCII-smaller, one has reached already. Only
codes and edits, a byte a row, are held for a whole conversation; texts pass by one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.session import materialize

KEEP, RENAME, REMOVE, INSERT, CUT = 0, 1, 2, 5, 5  # costs; CUT for a truncated row that stays
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)  # what the last row said, also the roles' numbers
OTHER = 4
ROLES = {USER: "user", ASSISTANT: "assistant"}
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # who speaks next
LEGAL = frozenset([(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)])
FAR = 1 << 60

WHITE = r"\x20\x09-\x0D"


def moves(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row after ``state``, in order of their letters."""
    fault, role = divmod(code, 5)
    out = [("D", REMOVE, state)]
    if fault in (BLANK, DUPLICATE):
        return out
    extra = CUT if fault == TRUNCATED else 0
    if role == AFTER[state] or role == SYSTEM and state == START:
        out.append(("K", KEEP + extra, role))
    return out + [("R", RENAME + extra, AFTER[state])]


MOVES = {(code, state): moves(code, state) for code in range(20) for state in range(4)}


def suffix_bounds(codes: bytes) -> np.ndarray:
    """[row, state]: what the rows from ``row`` on cost at least. Inserts are taken into account one after the other."""
    n = len(codes)
    out = np.full((n + 1, 4), FAR, np.int64)
    below = [0, FAR, FAR, 0]  # a conversation is empty or ends with the assistant

    def with_inserts(row: list[int]) -> list[int]:
        for _ in range(3):
            row = [min(row[s], INSERT + row[AFTER[s]]) for s in range(4)]
        return row

    below = with_inserts(below)
    out[n] = below
    steps = [[[(c, t) for _, c, t in MOVES[code, s]] for s in range(4)] for code in range(20)]
    for k in range(n - 1, -1, -1):
        below = with_inserts([min([c + below[t] for c, t in step]) for step in steps[codes[k]]])
        out[k] = below
    return out


def repair(codes: bytes) -> tuple[int, str]:
    """The least cost and, of the audits of that cost, the ASCII-least."""
    n, bounds = len(codes), suffix_bounds(codes)
    best_cost, best_end = FAR, None
    reached: dict[tuple[int, int], int] = {}  # the least cost a node was entered with
    trail: list[tuple[int, str]] = [(-1, "")]  # (node before, letter) of every node entered
    stack = [(0, START, 0, 0, "")]  # row, state, cost, entry of the node before, letter
    while stack:
        row, state, cost, before, letter = stack.pop()
        # nodes are met in order of bound and letter, so of equally cheap prefixes of a node the ASCII-least came first
        if cost + bounds[row, state] >= best_cost or cost >= reached.get((row, state), FAR):
            continue
        reached[row, state] = cost
        if letter:
            trail.append((before, letter))
            here = len(trail) - 1
        else:
            here = 0
        if row == n and state in (START, ASSISTANT):
            best_cost, best_end = cost, here
            continue
        onward = [(cost + INSERT, "I", row, AFTER[state])]
        if row < n:
            onward += [(cost + c, x, row + 1, t) for x, c, t in MOVES[codes[row], state]]
        open_nodes = [(c + int(bounds[r, t]), x, r, t, c) for c, x, r, t in onward if c + bounds[r, t] < best_cost]
        stack += [(r, t, c, here, x) for _, x, r, t, c in sorted(open_nodes, reverse=True)]
    letters = []
    while best_end:
        best_end, letter = trail[best_end]
        letters.append(letter)
    return int(best_cost), "".join(reversed(letters))


def coded(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copies) with the code of a row seen for the first time, and whether its turn is that of its first one."""
    role = F.substring("role", 1, 1)
    number = F.when(role == "s", SYSTEM).when(role == "u", USER).when(role == "a", ASSISTANT).otherwise(OTHER)
    blank = ~F.col("text").rlike(rf"[^{WHITE}]")
    # the last character that is not white space; translate() drops white space, which leaves it last
    last = F.right(F.translate("text", "\x20\x09\x0a\x0b\x0c\x0d", ""), F.lit(1))
    fault = F.when(blank, BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    said = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    out = rows.withColumn("said", said).withColumn("code", (fault * 5 + number).cast("int")).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    return out.withColumn("known", F.col("conv_id").isNotNull())


def _turn_order() -> list[Column]:
    return [F.col("known"), F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


class _Conversation:
    """Figures of one conversation, its rows given in order."""

    def __init__(self):
        self.codes, self.illegal, self.counts = bytearray(), 0, [0, 0, 0, 0]
        self.low = self.high = self.turn = None
        self.turns = 0

    def add(self, turn, code: int, first: bool, copies: int) -> None:
        fault, role = divmod(code, 5)
        again = fault if fault == BLANK else DUPLICATE
        for k in range(copies):
            now = fault if first and k == 0 else again
            if self.codes and (self.codes[-1] % 5, role) not in LEGAL:
                self.illegal += 1
            self.codes.append(now * 5 + role)
            self.counts[now] += 1
        if turn is not None:
            if turn != self.turn:
                self.turns += 1
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn

    def figures(self) -> tuple:
        cost, audit = repair(bytes(self.codes))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, cost, audit)


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def find_repairs(rows: DataFrame) -> DataFrame:
    """known, conv and the figures with the audit of every conversation of coded rows.

    The first turn of each thing said is a grouped minimum; its rows meet it in a join, which may be split where one
    conversation repeats itself without end.
    """
    firsts = rows.groupBy("known", "conv", "said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("k"), F.col("turn").alias("t"))).alias("_first"))
    narrow = rows.select("known", "conv", "turn", "role", "text", "said", "code", "copies").join(firsts, ["known", "conv", "said"])
    narrow = narrow.withColumn("first", F.col("turn").eqNullSafe(F.col("_first.t"))).drop("_first")
    dealt = narrow.repartition("known", "conv").sortWithinPartitions(*_turn_order())
    dealt = dealt.select("known", "conv", "turn", "code", "said", "first", "copies")

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, key, before = [], None, None, None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[] for _ in range(9)]
            kinds = [pa.bool_(), pa.string(), *[pa.int64()] * 6, pa.string()]
            done = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["known", "conv", *FIGURES, "audit"])
            out.clear()
            return done

        for known, conv, turn, code, said, first, copies in _streams(batches):
            if (known, conv) != key:
                if held:
                    out.append((*key, *held.figures()))
                    if len(out) >= 1000:
                        yield batch()
                held, key, before = _Conversation(), (known, conv), None
            held.add(turn, code, first and before != (turn, said), copies)  # equal rows stand side by side
            before = (turn, said)
        if held:
            out.append((*key, *held.figures()))
        yield batch()

    return dealt.mapInArrow(figures, f"known boolean, conv string, {', '.join(c + ' long' for c in FIGURES)}, audit string")


def apply_repairs(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired rows: known, conv, place (from 0), edit, turn, role, text; rows that go are left out.

    The audit of a conversation travels ahead of its rows, which then pass by one at a time.
    """
    heads = repairs.select("known", "conv", "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"))
    both = rows.select("known", "conv", F.lit(None).cast("string").alias("audit"), F.col("turn").cast("long").alias("turn"), "role", "text", "copies").unionByName(heads)
    dealt = both.repartition("known", "conv").sortWithinPartitions("known", "conv", F.desc_nulls_last("audit"), *_turn_order()[2:])

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = ["known", "conv", "place", "edit", "turn", "role", "text"]
        out: list[tuple] = []
        chars = 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[] for _ in names]
            done = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            out.clear()
            return done

        audit, at, place, state, key = "", 0, 0, START, None
        for known, conv, head, turn, role, text, copies in _streams(batches):
            if head is not None:
                audit, at, place, state, key = head, 0, 0, START, (known, conv)
            for k in range(max(1, copies)):
                # inserts before a row, and after the last one, are made when they are come upon
                if head is None:
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        state = AFTER[state] if edit == "R" or not role.startswith("s") else SYSTEM
                        out.append((*key, place, edit, turn, ROLES[state] if edit == "R" else role, text))
                        place, chars = place + 1, chars + len(text)
                while at < len(audit) and audit[at] == "I":
                    at, state = at + 1, AFTER[state]
                    out.append((*key, place, "I", None, ROLES[state], ""))
                    place += 1
                if len(out) >= 5000 or chars > 4_000_000:
                    chars = 0
                    yield batch()
        yield batch()

    return dealt.mapInArrow(applied, "known boolean, conv string, place long, edit string, turn long, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """known, conv and the hash of ``role:text``, joined by line feeds, of repaired rows that come in order."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["known", "conv", "repaired_sha256"], [pa.bool_(), pa.string(), pa.string()]
        out, key, held = [], None, None
        for known, conv, place, _, _, role, text in _streams(batches):
            if (known, conv) != key:
                if held:
                    out.append((*key, held.hexdigest()))
                key, held = (known, conv), hashlib.sha256()
            else:
                held.update(b"\n")
            held.update(f"{role}:{text}".encode())
            if len(out) >= 5000:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out.clear()
        if held:
            out.append((*key, held.hexdigest()))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 3, kinds)], names)

    return repaired.mapInArrow(digested, "known boolean, conv string, repaired_sha256 string")


def repair_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repairs of conversations (conv_id, turn, role, text, copies) and their coded rows, written once."""
    rows = materialize(coded(rows), "coded")
    return materialize(find_repairs(rows), "repairs"), rows


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after the damage that the check sum of ``conv_id:turn`` deals out.

    Of twenty rows one goes (copies 0), one loses its text, one its full stops, one comes twice and one is put in
    the user's mouth. A null role or text is one space; a null id or turn is one space in the check sum only.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    h = F.pmod(F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")), F.lit(20))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"),
    )


def report(conversations: DataFrame) -> DataFrame:
    """Per conv_id what damage left of it, what its repair costs, the audit of the edits and the repaired rows' hash.

    Rows are taken by turn, nulls first, then by role and text. Nulls are one space; the rows of a null conv_id
    are one conversation. An empty role or one of other initials cannot be kept. A conversation without rows
    after the damage has zeros and an empty audit. An empty table gives no rows. Other columns are left behind.
    """
    damaged = damage(conversations)
    repairs, rows = repair_rows(damaged.filter("copies > 0"))
    hashes = digests(apply_repairs(rows, repairs))
    kept = repairs.join(hashes, ["known", "conv"], "left")
    ids = conversations.groupBy("conv_id").agg(F.lit(True).alias("_all")).select(
        "conv_id", F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"),
    )
    empty = hashlib.sha256(b"").hexdigest()
    return ids.join(kept, ["known", "conv"], "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in FIGURES], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )

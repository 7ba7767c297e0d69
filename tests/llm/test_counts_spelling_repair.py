"""Token counts against the library, spelling variants and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from cadastra.llm import conversations, spelling, token_counts

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, _n long, word string, half string, n long, i long, prefix_tokens string"
PATH = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [(None, "a row without an id, once"), (None, None), (900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "long " * 30_000), (905, "same text twice over"), (905, "same text twice over")]
WRITTEN = [
    "Hello, world! it's I'll we've we're you'd can't 's 'r 'l 'll're ''s '", "<|endoftext|>abc<|startoftext|>x <|endoftext| <|ENDOFTEXT|>", "été ≯ <|endoftext|≯a",
    "İstanbul ΑΣ ſ", "漢字かな交じり文 東京2024年", "한국어 한ᄀ", "नमस्ते สวัสดี", "a b　c\u0085d x\x1cy\x1fz", "1234 ½² 😀😀👍🏽 ok", "'s'́s 'ṣ 'ṡ ཱི̈́aཱུ q̣̇ ̣̇q", "a" * 60 + " " + "-=" * 40 + "!!!",
]


def documents(spark, rows):
    """Documents with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "en", 7, "w", "h", 1, 2, "p") for i, t in rows], DOCS)


# Token counts


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(PATH)


def test_every_prefix_has_the_count_of_the_library(counter, library):
    rng = random.Random(5)
    parts = [*"aestrvldm'.!1éßE漢ñİΣ><", " ", "\n", "́", "̣", "ᄀ", "ᅡ", "ᆨ", "<|endoftext|>", "<|", "|>", " ", "ing", "the", "ཱི", "ﬁ", "Ω", "Å", "̸"]
    texts = WRITTEN + ["", " "] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    table, bounds = counter.tables([t.encode() for t in texts])
    for text, (a, b) in zip(texts, bounds):
        assert table[a:b].tolist() == [library(text[:k]) for k in range(1, len(text) + 1)], text


def test_long_runs_take_linear_time(counter, library):
    for text in ("9" * 20_000, "a" * 20_000, "é" * 10_000, "漢" * 20_000, "-" * 20_000):
        table, _ = counter.tables([text.encode()])
        assert table[len(text) - 1] == library(text)


def test_tables_do_not_depend_on_what_is_cached(counter, monkeypatch):
    texts = [t.encode() for t in WRITTEN]
    want = counter.tables(texts)[0].tolist()
    monkeypatch.setattr(token_counts, "CACHED_CHUNKS", 0)
    assert counter.tables(texts)[0].tolist() == want and counter.tables(texts)[0].tolist() == want


def test_counts_of_documents(spark, library, data_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()] + list(enumerate(WRITTEN, 5000)) + AWKWARD
    got = token_counts.report(documents(spark, rows), PATH).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (repr(i), len((t or "").encode()), library(t or ""), library(t or "") > 2048) for i, t in rows)
    for r in got:
        assert r.kept_tokens <= 2048 and (r.over_limit or r.kept_tokens == r.n_tokens)
    assert token_counts.report(documents(spark, []), PATH).collect() == []


def test_truncation_is_the_longest_prefix_within_the_budget(spark, library):
    rows = list(enumerate(WRITTEN)) + [(901, ""), (902, None), (903, "  ")]
    for budget in (0, 1, 3, 8):
        kept = {r.doc_id: r.kept_chars for r in token_counts.report(documents(spark, rows), PATH, budget).collect()}
        held = token_counts.with_prefix_counts(documents(spark, rows), PATH, name="held")
        held = held.select("doc_id", token_counts.truncate(F.col("text"), F.col("held"), budget).alias("cut"), token_counts.tokens_of(F.col("held"), 5).alias("five"), "prefix_tokens", "n")
        for r in held.collect():
            text = dict(rows)[r.doc_id] or ""
            longest = max(k for k in range(len(text) + 1) if library(text[:k]) <= budget)
            assert r.cut == text[:longest] and kept[r.doc_id] == longest and r.five == library(text[:5]) and (r.prefix_tokens, r.n) == ("p", 1)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))


# Spelling variants


def variant_rows(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: {v for v in words if v != w and one_edit(w, v)} for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    return a[1:] == b[1:] if len(a) == len(b) else a[1:] == b or a == b[1:]


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(8)
    base = ["".join(rng.choice("abàö") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "Àÿ×÷ß", "z" * 400, "z" * 401]
    words = []
    for w in base:
        for _ in range(3):
            k = rng.randrange(len(w))
            words += [w, w[:k] + rng.choice("abcö") + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + rng.choice("abö") + w[k:]]
    rows = []
    for i in range(400):
        some = [rng.choice(words[: 40 + i]) for _ in range(rng.randint(0, 25))]
        rows.append((i, rng.choice([" ", "-", "1", "Ā", "漢"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in some)))
    return rows + AWKWARD


def variants(spark, rows):
    return [tuple(r) for r in spelling.variants(documents(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_variants_are_those_of_brute_force(spark, spelled):
    got = variants(spark, spelled)
    assert len(set(got)) == len(got) > 100 and set(got) == variant_rows(spelled)
    assert variants(spark, []) == [] and variants(spark, [(1, None), (2, "")]) == []


def test_variants_do_not_depend_on_blocks(spark, spelled, monkeypatch):
    want = variant_rows(spelled)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 3)  # every group in many blocks
    assert set(variants(spark, spelled)) == want


def test_tiles_are_compared_alike_whole_and_in_parts():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab漢") for _ in range(rng.randint(5, 6))) for _ in range(300)})
    near = set()
    for side in (0, 1):
        half = sorted((w[:3] if side == 0 else w[-3:], w) for w in words)
        groups = [k for k, (_, g) in enumerate(itertools.groupby(half, key=lambda x: x[0])) for _ in g]
        ordered = [w for _, w in half]
        flags = np.zeros(len(ordered), bool)
        found = []
        for dense in (1, 10_000):
            spelling_dense, spelling.DENSE = spelling.DENSE, dense
            try:
                a, b = spelling.compare(6, side, np.array(groups), flags, flags, ordered)
            finally:
                spelling.DENSE = spelling_dense
            found.append({tuple(sorted((ordered[x], ordered[y]))) for x, y in zip(a, b)})
            assert len(found[-1]) == len(a)
        assert found[0] == found[1] and not near & found[0]  # a pair is one group's charge
        near |= found[0]
    assert near == {(a, b) for a, b in itertools.combinations(words, 2) if max(len(a), len(b)) == 6 and one_edit(a, b)}


# Conversation repair


def all_repairs(rows):
    """The least (cost, audit) of (fault, initial) rows, by trying every edit."""
    best = [(1 << 60, "")]

    def go(k, said, cost, audit, inserts):
        if cost > best[0][0]:
            return
        if k == len(rows) and re.fullmatch(r"(s?(ua)+)?", said):
            best[0] = min(best[0], (cost, audit))
        if inserts < 2:
            for x in "ua":
                go(k, said + x, cost + 5, audit + "I", inserts + 1)
        if k < len(rows):
            fault, initial = rows[k]
            go(k + 1, said, cost + 2, audit + "D", 0)
            if fault not in (conversations.BLANK, conversations.DUPLICATE):
                extra = 5 if fault == conversations.TRUNCATED else 0
                go(k + 1, said + initial, cost + extra, audit + "K", 0)
                for x in "ua":
                    go(k + 1, said + x, cost + 1 + extra, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best[0]


def table_repair(codes):
    """The least (cost, audit), by the best prefix of every state row by row."""
    def inserted(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                onward = conversations.AFTER[state]
                best[onward] = min(best.get(onward, (1 << 60, "")), (cost + 5, audit + "I"))
        return best

    best = inserted({conversations.START: (0, "")})
    for code in codes:
        fault, role = divmod(code, 5)
        new = {}
        for state, (cost, audit) in best.items():
            options = [(cost + 2, audit + "D", state)]
            if fault not in (1, 2):
                extra = 5 if fault == 3 else 0
                if (state, role) in conversations.LEGAL or state == 0 and role in (1, 2):
                    options.append((cost + extra, audit + "K", role))
                options.append((cost + 1 + extra, audit + "R", conversations.AFTER[state]))
            for c, a, onward in options:
                new[onward] = min(new.get(onward, (1 << 60, "")), (c, a))
        best = inserted(new)
    return min(best[s] for s in (0, 3) if s in best)


NUMBERS = {"s": 1, "u": 2, "a": 3, "t": 4}


def test_search_finds_the_least_audit():
    rng = random.Random(2)
    kinds = list(itertools.product([0, 1, 3], "suat"))
    cases = [c for n in range(3) for c in itertools.product(kinds, repeat=n)] + [tuple(rng.choice(kinds) for _ in range(3)) for _ in range(100)]
    for rows in cases:
        assert conversations.repair(bytes(f * 5 + NUMBERS[r] for f, r in rows)) == all_repairs(rows), rows
    for _ in range(2000):
        codes = bytes(rng.choice([0, 0, 0, 5, 10, 15]) + rng.choice([1, 2, 2, 3, 3, 4]) for _ in range(rng.randint(0, 50)))
        assert conversations.repair(codes) == table_repair(codes)


def test_search_of_a_long_conversation_stays_linear():
    rng = random.Random(2)
    codes = bytes(rng.choice([0, 0, 0, 5, 10, 15]) + rng.choice([1, 2, 2, 3, 3, 4]) for _ in range(50_000))
    cost, audit = conversations.repair(codes)
    assert len(audit.replace("I", "")) == 50_000 and cost < 100_000


def repaired_rows(rows):
    white = " \t\n\x0b\x0c\r"
    kept = defaultdict(list)
    for i, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if i is None else i}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if h == 4 else role
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept[i] += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = {}
    for i in {r[0] for r in rows}:
        own, seen, codes = sorted(kept[i], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])), set(), []
        for turn, role, text in own:
            fault = 1 if not text.strip(white) else 2 if (role, text) in seen else 3 if text.strip(white)[-1] not in ".!?" else 0
            seen.add((role, text))
            codes.append(fault * 5 + {"s": 1, "u": 2, "a": 3}.get(role[:1], 4))
        cost, audit = table_repair(codes)
        said, state, k = [], 0, 0
        for edit in audit:
            if edit != "I":
                _, role, text = own[k]
                k += 1
            if edit == "D":
                continue
            state = conversations.SYSTEM if edit == "K" and role[0] == "s" else conversations.AFTER[state]
            said.append(f"{role}:{text}" if edit == "K" else f"{conversations.ROLES[state]}:{text if edit == 'R' else ''}")
        turns = [t for t, _, _ in own if t is not None]
        out[i] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum(c // 5 == f for c in codes) for f in (1, 2, 3)],
            sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


CONVERSATION = "conv_id long, turn long, role string, text string, copies long, code string, conv string, said long, audit string"


def report(spark, rows):
    given = spark.createDataFrame([(*r, 9, "c", "v", 3, "x") for r in rows], CONVERSATION)
    got = [tuple(r) for r in conversations.report(given).select("conv_id", *conversations.FIGURES, "audit", "repaired_sha256").collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def test_reports_of_awkward_conversations(spark):
    rng = random.Random(6)
    texts = ["Fine.", "Well!", "Why?", "so on", "", " \n\t", None, ".", "Fine. ", "漢字。", "x" * 50_000 + "."]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", " "]), rng.choice(texts)) for _ in range(400)]
    rows += rows[:30] + [(-5, None, "user", "Alone."), (-5, None, "assistant", "Yes.")] + [(-6, 3, "user", "Again.")] * 25
    rows += [(-7, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for t in range(3000)]
    gone = next(t for t in range(1000) if zlib.crc32(f"-8:{t}".encode()) % 20 == 0)
    rows.append((-8, gone, "user", "Gone."))
    got = report(spark, rows)
    assert got == repaired_rows(rows)
    assert got[-8] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert report(spark, []) == {}


def test_repaired_rows_alternate(spark, data_dir):
    damaged = conversations.damage(spark.read.parquet(f"{data_dir}/conversations.parquet")).filter("copies > 0")
    repairs, rows = conversations.repair_rows(damaged)
    by = defaultdict(list)
    for r in conversations.apply_repairs(rows, repairs).collect():
        by[r.conv].append((r.place, r.role))
    assert by and all(re.fullmatch(r"(s?(ua)+)?", "".join(role[0] for _, role in sorted(own))) for own in by.values())
    assert all([p for p, _ in sorted(own)] == list(range(len(own))) for own in by.values())

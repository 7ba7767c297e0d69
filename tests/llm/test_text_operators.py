"""The text operators against brute force and exact round trips, on small tables with the awkward cases in them."""

import hashlib
import math
import re
import tracemalloc
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from cadastra.llm import chat, decontaminate, licences, lines, minhash, neighbours, packing, personal, scoring, toxicity
from cadastra.llm.common import clear_worker_cache, worker_cache

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, _x string, key string, line string, n long"


def documents(spark, rows):
    """Documents with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "x", "k", "l", 1) for i, t in rows], DOCS)


def white_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]


AWKWARD = [(None, "a row without an id, once"), (None, None), (900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "long " * 30_000), (905, "same text twice over"), (905, "same text twice over")]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, base = [], [rng.choice(vocabulary, 60).tolist() for _ in range(25)]
    for k, words in enumerate(base):
        rows.append((k, " ".join(words)))
    for k in range(60):
        words = list(base[k % 12])
        for at in rng.integers(0, len(words), k % 7):
            words[at] = vocabulary[rng.integers(400)]
        rows.append((100 + k, " ".join(words).upper() if k % 5 == 0 else " ".join(words)))
    return rows + AWKWARD


# Near duplicates


def shingle_set(text, size):
    words = white_words(text)
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def near_duplicate_rows(rows, size):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        groups[root(k)].append(i)
    out = []
    for k, (i, s) in enumerate(sets):
        low = None if i is None else min(x for x in groups[root(k)] if x is not None)
        out.append((i, len(s), low, i is None or i == low))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [minhash.BLOCK_SHINGLES, 300])
def test_near_duplicates_are_those_of_all_pairs(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)  # 300: clusters in several blocks
    got = minhash.near_duplicates(documents(spark, corpus), 2).collect()
    assert sorted((tuple(r) for r in got), key=repr) == near_duplicate_rows(corpus, 2)


def test_linked_sets_across_chains():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 2**62, 300, dtype=np.uint64))
    chain = [np.sort(np.concatenate([base[20 * k :], base[: 20 * k] + np.uint64(1)])) for k in range(8)]
    found = minhash.linked([*chain, np.array([5], np.uint64)], 80)
    assert {x for link in found for x in link} == set(range(8)) and len(found) == 7


def test_signature_positions_agree_as_the_similarity():
    rng = np.random.default_rng(2)
    for n in (8, 300):
        gap = []
        for _ in range(40):
            x = rng.integers(0, 2**62, n, dtype=np.uint64)
            a, b = np.unique(x[: n * 7 // 8]), np.unique(x[n // 8 :])
            s = minhash.signatures([a, b])
            gap.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(gap)) < 0.02


def test_near_duplicates_of_an_empty_table(spark):
    assert minhash.near_duplicates(documents(spark, []), 5).collect() == []
    assert minhash.remove_near_duplicates(documents(spark, [(1, "a b"), (2, "a b"), (None, "a b")]), 5).count() == 2


def test_rows_of_one_id_go_by_their_own_texts(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "quite another text of one id"), (None, None), (3, None)]
    out = minhash.remove_near_duplicates(documents(spark, rows), 5)
    assert out.columns == [c.split(" ")[0] for c in DOCS.split(", ")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([rows[0], *rows[2:]], key=repr)


# Lines


def repeated(rows):
    texts = {}
    for i, t in rows:
        texts[lines.NO_ID if i is None else i, t] = t
    items = [(i, k, frozenset(decontaminate.words(line))) for (i, _), t in texts.items() for k, line in enumerate((t or "").split("\n"))]
    items = [x for x in items if len(x[2]) >= lines.MIN_WORDS]
    gone = defaultdict(set)
    for i, k, s in items:
        if any((j, m) < (i, k) and 5 * len(s & r) >= 4 * len(s | r) for j, m, r in items):
            gone[i].add(k)
    return gone


@pytest.fixture(scope="module")
def lined():
    rng = np.random.default_rng(9)
    vocabulary = [f"w{k}" for k in range(120)]
    stock = [rng.choice(vocabulary, rng.integers(3, 30)).tolist() for _ in range(30)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.integers(1, 6)):
            words = list(stock[rng.integers(30)] if rng.random() < 0.7 else rng.choice(vocabulary, 12))
            for at in rng.integers(0, len(words), rng.integers(0, 3)):
                words[at] = vocabulary[rng.integers(120)]
            own.append(" ".join(words))
        rows.append((int(i * 37 % 61), "\n".join(own)))
    return rows + AWKWARD


def test_removed_lines_are_those_of_all_pairs(spark, lined):
    gone = repeated(lined)
    got = lines.report(documents(spark, lined)).collect()
    want = []
    for i, t in lined:
        own = gone.get(lines.NO_ID if i is None else i, set())
        left = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in own)
        want.append((i, len(t.split("\n")) if t else 0, len(own), ",".join(map(str, sorted(own))), hashlib.sha256(left.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_a_line_whose_first_partners_fail_gets_all(spark, lined, monkeypatch):
    monkeypatch.setattr(lines, "PARTNERS", 1)
    gone = repeated(lined)
    got = lines.repeated_lines(lines.numbered(documents(spark, lined)).select(F.col("_doc").alias("doc"), "text")).collect()
    assert {(r.doc, r.line) for r in got} == {(i, k) for i, ks in gone.items() for k in ks}


def bit_of(word):
    return int(lines.mix(lines.word_codes([word])[0].view(np.uint64) + np.uint64(1))[0] & np.uint64(63))


def test_a_line_similar_only_to_one_behind_its_partner_goes(spark):
    x, y = "swap0", next(f"swap{k}" for k in range(1, 5000) if bit_of(f"swap{k}") == bit_of("swap0"))
    shared = [f"base{k}" for k in range(8)]
    rows = [(1, " ".join([*shared, "ninth", x])), (2, " ".join([*shared, "ninth", y])), (3, " ".join([*shared, "other", y])), (4, f"{x} {y} " * 9)]
    gone = lines.repeated_lines(lines.numbered(documents(spark, rows)).select(F.col("_doc").alias("doc"), "text")).collect()
    assert {(r.doc, r.line) for r in gone} == {(i, k) for i, ks in repeated(rows).items() for k in ks} == {(2, 0), (3, 0)}


def test_long_lines_that_share_words_but_are_not_similar_are_no_candidates(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{k}" for k in range(900)]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(110, 200)), replace=False))) for i in range(60)]
    given = lines.numbered(documents(spark, rows)).select(F.col("_doc").alias("doc"), "text")
    assert not any(repeated(rows).values())
    assert lines.candidates(lines.postings(given, lines.rarity(given))).count() == 0


@pytest.mark.parametrize("partners", [1, 3])
def test_lines_of_all_widths_at_the_threshold(spark, monkeypatch, partners):
    monkeypatch.setattr(lines, "PARTNERS", partners)
    rng = np.random.default_rng(4)
    vocabulary, rows = [f"u{k}" for k in range(2000)], []
    for size in (28, 31, 33, 36, 38, 40, 76, 79, 81, 84, 90, 100, 130, 300):
        base = rng.choice(vocabulary, size, replace=False).tolist()
        for share in (0.0, 0.05, 0.1, 0.11, 0.12, 0.2):
            own = base[int(size * share) :] + rng.choice(vocabulary, int(size * share * rng.random()), replace=False).tolist()
            rows.append((len(rows), " ".join(own)))
    given = lines.numbered(documents(spark, rows)).select(F.col("_doc").alias("doc"), "text")
    assert {(r.doc, r.line) for r in lines.repeated_lines(given).collect()} == {(i, k) for i, ks in repeated(rows).items() for k in ks}


def test_short_lines_go_as_copies_and_four_words_with_five(spark):
    rows = [(1, "Share\none two three four five\nhome about us"), (2, "share!\n\none two three four\n---"), (3, "home about us\nhome about\none two three four\n---")]
    got = {r.doc_id: r.removed_lines for r in lines.report(documents(spark, rows)).collect()}
    assert got == {1: "", 2: "0,2", 3: "0,2"}


def test_codes_tell_words_of_all_lengths_and_the_lines_they_stand_in():
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abé9"), int(n))) for n in rng.integers(1, 40, 400)]
    vocabulary += ["x" * n + end for n in (7, 8, 9, 15, 16, 17, 255, 256, 257, 600) for end in ("", "a", "b")]
    rows = [[vocabulary[k] for k in rng.integers(0, len(vocabulary), int(n))] for n in rng.integers(0, 9, 300)]
    texts = ["\n".join(" .".join(own) for own in rows[k : k + 7]) for k in range(0, 300, 7)]
    codes, row, first = lines.word_codes([None, *texts[:20], "", *[t.encode() for t in texts[20:]]])
    flat = [w for own in rows for w in own]
    assert len(codes) == len(flat) and len(set(zip(flat, codes.tolist()))) == len(set(flat)) == len(set(codes.tolist()))
    kept = [k for k in range(first[-1]) if k not in (0, int(first[21]))]  # the null and the empty text are a line each
    assert [int((row == k).sum()) for k in kept] == [len(own) for own in rows]


def test_postings_are_shuffled_in_blocks_and_looked_up_by_bucket(spark, lined):
    given = lines.numbered(documents(spark, lined)).select(F.col("_doc").alias("doc"), "text").repartition(2).cache()
    counts = lines.rarity(given)
    blocks = lines.postings(given, counts)
    posts = lines.single_posts(blocks).collect()
    assert 0 < blocks.count() <= 2 * lines.parts_of(counts) < len(posts)
    token = min(p.token for p in posts)
    looked = np.zeros(lines.RARITY_BUCKETS, bool)
    looked[token % lines.RARITY_BUCKETS] = True
    found = lines.single_posts(lines.postings(given, counts, looked)).collect()
    assert sorted(map(tuple, found)) == sorted(tuple(p) for p in posts if looked[p.token % lines.RARITY_BUCKETS])


def test_lines_taken_up_again_are_posted_by_one_python_worker(spark, lined):
    given = lines.numbered(documents(spark, lined)).select(F.col("_doc").alias("doc"), "text").cache()
    counts = lines.rarity(given)
    rows = lines.postings(given, counts, single=True)
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, lines.single_posts(lines.postings(given, counts)).collect()))


def near_copies(n):
    """The columns of one posting of lines that differ in a few words each; some are hidden behind another."""
    rng = np.random.default_rng(7)
    one, other = np.uint64(1) << rng.integers(0, 64, (2, n)).astype(np.uint64)
    zeros = np.zeros(n, np.int64)
    return [zeros, np.arange(n), zeros.astype(np.int32), rng.integers(20, 23, n).astype(np.int32), rng.integers(0, 3, n).astype(np.int32), (one ^ other).view(np.int64), zeros, zeros, zeros]


def test_near_copies_do_not_gather_all_their_pairs():
    columns = near_copies(3000)
    tracemalloc.start()
    found = lines.pairs_of(columns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80_000_000 and max(Counter(found["doc"].to_pylist()).values()) <= lines.PARTNERS


def test_pairs_do_not_depend_on_how_many_are_gathered(monkeypatch):
    columns = near_copies(300)
    monkeypatch.setattr(lines, "MET_PAIRS", 1 << 40)
    want = lines.pairs_of(columns).to_pylist()
    assert {r["more"] for r in want} == {True, False}
    for most in (1, 50, 2000):
        monkeypatch.setattr(lines, "MET_PAIRS", most)
        assert lines.pairs_of(columns).to_pylist() == want


def test_counts_of_words_do_not_depend_on_how_they_are_gathered(spark, lined, monkeypatch):
    given = lines.numbered(documents(spark, lined)).select(F.col("_doc").alias("doc"), "text")
    want = np.bincount(lines.word_codes([t for _, t in lined])[0] & (lines.RARITY_BUCKETS - 1), minlength=lines.RARITY_BUCKETS)
    for most in (1, 1000):
        monkeypatch.setattr(lines, "BLOCK_WORDS", most)
        got = lines.rarity(given)
        assert ((got == 0) == (want == 0)).all() and ((got == 1) == (want == 1)).all()
        assert (np.diff(got[np.argsort(want)].astype(int)) >= 0).all()


def test_documents_without_lines_left_go(spark):
    line = "six words stand in this line"
    out = lines.remove_repeated_lines(documents(spark, [(1, line), (2, line), (3, f"{line}\nshort"), (4, None), (5, "")]))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, line), (3, "short"), (4, None), (5, "")]
    assert out.columns == [c.split(" ")[0] for c in DOCS.split(", ")]
    assert lines.report(documents(spark, [])).collect() == []


# What a worker holds


def test_a_worker_holds_the_cache_of_one_operator():
    class Held:
        pass

    first = worker_cache("one", Held)
    assert worker_cache("one", Held) is first
    gone = weakref.ref(first)
    del first
    other = worker_cache("other", Held)
    assert gone() is None and worker_cache("other", Held) is other
    gone = weakref.ref(other)
    del other
    clear_worker_cache()
    assert gone() is None


def test_texts_are_scored_some_at_a_time(monkeypatch):
    texts = [None, "", *[" ".join(f"w{(k * j) % 97}" for j in range(1, 60 + k)) for k in range(40)]]
    model = {"net": toxicity.Network().p, "rule": np.array([1.0, 0.1, 0.0])}
    want = toxicity.Scorer(model).score(texts)
    monkeypatch.setattr(toxicity, "SLICE_CHARS", 700)
    monkeypatch.setattr(toxicity, "LEARNT_WORDS", 5)
    scorer, taken = toxicity.Scorer(model), []
    score = scorer.score
    monkeypatch.setattr(scorer, "score", lambda some: taken.append(sum(len(t or "") for t in some)) or score(some))
    assert np.allclose(scorer.score_column(pa.array(texts)), want, atol=1e-6)
    assert len(taken) > 10 and max(taken) <= 700
    assert len(scorer.score_column(pa.array([], pa.string()))) == 0


# Decontamination


def occurrences(text, items):
    words = decontaminate.words(text)
    hit, met = set(), set()
    for item, t in items:
        own = decontaminate.words(t)
        n = min(10, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                met.add(str(item))
    return len(words), len(hit), sorted(met)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_ITEMS, 2])
def test_benchmark_windows_are_all_found(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
    rng = np.random.default_rng(4)
    vocabulary = [f"v{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate([25, 14, 10, 9, 3, 1, 12])] + [(7, None), (8, "..."), (3, "one more text of item three with ten words or eleven")]
    rows = [(k, " ".join(rng.choice(vocabulary, 30)) + " " + " ".join(str(items[k % 7][1]).upper().split()[: 5 + k % 20])) for k in range(40)] + AWKWARD
    benchmark = spark.createDataFrame([*items, (None, "v1 v2")], "item_id long, text string")
    got = decontaminate.report(documents(spark, rows), benchmark).collect()
    want = []
    for i, t in rows:
        n, hit, met = occurrences(t, items)
        want.append((i, n, hit, len(met), hashlib.sha256(",".join(met).encode()).hexdigest(), hit > 0))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_an_empty_benchmark_leaves_all(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_contaminated(documents(spark, AWKWARD), none).count() == len(AWKWARD)
    assert decontaminate.report(documents(spark, []), none).collect() == []


# Packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a<|endoftext|>b 'S it's 12 3.4 ßÄ É İstanbul é \x1c x\x00y ﬁ ²a", "x y\x85z", "Ⅷ ½ café́ it's'll K Å ẞ", "日本語 text 😀 ok…", "A" * 3000, ". , .,a a., ,", ""]


def test_chunked_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(PATH), packing.ChunkEncoder(PATH)
    ids, counts = own.encode(ODD)
    want = [e.ids for e in plain.encode_batch(ODD, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_a_full_cache_keeps_the_chunks_met_again(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHED_CHUNKS", 60)
    plain, own, learned = Tokenizer.from_file(PATH), packing.ChunkEncoder(PATH), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda raw: (learned.extend(raw), learn(raw))[1])
    for k in range(12):
        texts = ["  The same, words. stay 12&3 ", " ", "".join(f"w{chr(97 + k)}{chr(97 + j)} " for j in range(20)), ODD[k % len(ODD)]]
        ids, counts = own.encode(texts)
        want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert learned.count(b"same,") == learned.count(b"12&3") == 1


@pytest.mark.parametrize("capacity", [16, 100])
def test_pieces_are_whole_and_sequences_hold(spark, corpus, capacity):
    rows = corpus + [(500 + k, t) for k, t in enumerate(ODD)]
    got = [r.asDict() for r in packing.pack(documents(spark, rows), PATH, capacity).collect()]
    encoder, want = packing.ChunkEncoder(PATH), []
    for (i, _), own in zip(rows, packing.pieces_of([t for _, t in rows], encoder, capacity)):
        want += [(i, p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in own]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) <= math.ceil(sum(r["length"] for r in got) / capacity) * 1.1 + 1


def fewest(sizes, capacity):
    """The least number of bins, by trying all."""
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for b in {x: j for j, x in enumerate(bins)}.values():
            if bins[b] + sizes[k] <= capacity:
                go(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best


def reduced(sizes, capacity):
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    fixed = packing.reduce_counts(counts, capacity)
    assert all(sum(p) <= capacity for p, _ in fixed)
    return sum(n for _, n in fixed), [s for s in range(capacity, 0, -1) for _ in range(counts[s])]


def test_reduction_keeps_the_least_number():
    rng = np.random.default_rng(1)
    for k in range(3000):
        capacity = int(rng.choice([20, 30, 100]))
        # short pieces beside long ones, so that three often fill what a long one leaves
        sizes = np.concatenate([rng.integers(1, capacity, rng.integers(0, 6)), rng.integers(1, capacity // 3 + 1, rng.integers(0, 5))]) if k % 2 else rng.integers(1, capacity, 8)
        sizes = sorted(sizes.tolist(), reverse=True)
        number, rest = reduced(sizes, capacity) if sizes else (0, [])
        assert number + fewest(rest, capacity) == fewest(sizes, capacity), sizes


@pytest.mark.parametrize("sizes, capacity", [([60, 35, 12, 12, 12, 33, 32], 100), ([2457, 1433, 491, 491, 491, 1351, 1310], 4096)])
def test_three_pieces_may_outweigh_the_longest(sizes, capacity):
    number, rest = reduced(sizes, capacity)
    assert number + fewest(rest, capacity) == 2


def test_packing_nothing(spark):
    assert packing.pack(documents(spark, []), PATH).collect() == []


# Chat

CHAT = public_tokenizers.path("byte_bpe_50k.json")


def test_conversations_read_back(spark):
    odd = "</s>[INST] ok [/INST] [\\INST] <\\\\s> <|endoftext|> 😀 [ROLE]"
    rows = [
        (1, 0, "system", odd), (1, 1, "user", ""), (1, 2, "assistant", odd), (1, 3, "user", None), (1, 4, "assistant", "é" * 20_000), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"),
        (2, None, "user", "first"), (3, 0, None, "x"), (3, 1, "[ROLE]tool", odd), (None, 1, "assistant", "n"), (None, 0, "user", "m"), (4, 0, "user", "only"),
    ]
    table = spark.createDataFrame([(*r, 0, True) for r in rows], "conv_id long, turn long, role string, text string, position int, mask boolean")
    formatted = chat.format_turns(table, CHAT)
    got = {r.conv_id: r for r in chat.read_back(formatted, CHAT).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    ends = defaultdict(int)
    for r in sorted(formatted.collect(), key=lambda r: (repr(r.conv_id), r.position)):
        assert r.offset == ends[r.conv_id] and len(r.ids) == len(r.mask)
        ends[r.conv_id] += len(r.ids)
    assert chat.read_back(chat.format_turns(table.limit(0), CHAT), CHAT).collect() == []


def test_escapes_leave_no_control_string():
    for text in ("</s>", "[\\/INST]", "<\\\\s>", "[[INST]]", "[ANS][/ROLE]"):
        assert chat.unescape(chat.escape(text)) == text
        assert not any(m in chat.escape(text) for m in chat.MARKS)


# Scores


def test_base_scores_are_the_counts(spark, corpus, monkeypatch):
    monkeypatch.setattr(scoring, "FREQUENT", 150)  # the rest meets its counts in the join
    monkeypatch.setattr(scoring, "STEPS", 200)
    got = scoring.score_documents(documents(spark, corpus)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter(w for i, t in corpus if not held(i) for w in [*white_words(t), "\n"])
    total, want = sum(count.values()), []
    for i, t in corpus:
        own = [*white_words(t), "\n"]
        want.append((i, held(i), len(own), sum(count[w] > 0 for w in own), total, sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in own)))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted((w[:5] for w in want), key=repr)
    base = defaultdict(list)
    for w in want:
        base[w[0]].append(w[5])
    for r in got:
        assert min(abs(r.base_score - b) for b in base[r.doc_id]) < 1e-6 * max(1, abs(r.base_score)) and r.score < 0
    assert scoring.score_documents(documents(spark, [])).collect() == []


def test_scores_are_those_of_the_model_word_by_word(spark, corpus, monkeypatch):
    """Classes and their probabilities are taken from the fit; words, shares and sums are counted again one by one."""
    made = {}
    keep = lambda name, f: lambda *a: made.setdefault(name, f(*a))
    monkeypatch.setattr(scoring, "FREQUENT", 150)
    monkeypatch.setattr(scoring, "STEPS", 300)
    monkeypatch.setattr(scoring, "fit", keep("model", scoring.fit))
    monkeypatch.setattr(scoring, "cluster", keep("classes", scoring.cluster))
    got = scoring.score_documents(documents(spark, corpus)).collect()
    count = Counter(w for i, t in corpus if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for w in [*white_words(t), "\n"])
    common = sorted((w for w in count if w != "\n"), key=lambda w: (-count[w], w.encode()))[:150]
    number = {"\n": 1, **{w: k for k, w in enumerate(common, 2)}}
    classes = {w: int(made["classes"][k]) for w, k in number.items()}
    members = defaultdict(list)
    for w in count:
        members[classes.get(w, 0)].append(w)
    assert len(members) > scoring.OWN + 5 and {classes[w] for w in common[: scoring.OWN - 2]} == set(range(2, scoring.OWN))
    unknown = object()
    held = {c: sum(count[w] + 1 for w in own) + (c == 0) for c, own in members.items()}
    in_class = lambda w: 1.0 if 0 < classes.get(w, 0) < scoring.OWN else (count[w] + 1) / held[classes.get(w, 0)]
    for c, own in members.items():  # the words of a class and, beyond the known ones, one unknown word share all of it
        assert sum(in_class(w) for w in own) + (in_class(unknown) if c == 0 else 0) == pytest.approx(1)
    assert np.allclose((10.0 ** made["model"]).sum(2), 1, atol=1e-4)
    want = defaultdict(list)
    for i, t in corpus:
        own, score, two, one = [*white_words(t), "\n"], 0.0, 1, 1
        for w in own:
            c = classes.get(w, 0)
            score += float(made["model"][two, one, c]) + math.log10(in_class(w))
            two, one = one, c
        want[i].append(score)
    for r in got:
        assert min(abs(r.score - x) for x in want[r.doc_id]) < 1e-4 * abs(r.score)
    better = [r.score > r.base_score for r in got if r.n_tokens > 30]
    assert len(better) > 50


def test_clusters_hold_words_of_one_company():
    rng = np.random.default_rng(2)
    size = scoring.OWN + 300
    table = np.zeros((size, 2 * scoring.BESIDE), np.float32)
    kind = np.arange(300) % 3
    for k in range(300):
        table[scoring.OWN + k] = rng.poisson(np.where(np.arange(2 * scoring.BESIDE) % 3 == kind[k], 20, 1))
    classes = scoring.cluster(table, np.full(size, 50))
    assert classes[: scoring.OWN].tolist() == list(range(scoring.OWN)) and classes.max() < scoring.CLASSES
    assert all(len(set(kind[classes[scoring.OWN :] == c])) == 1 for c in set(classes[scoring.OWN :]))


def test_class_probabilities_sum_to_one_and_learn():
    cube = np.zeros((8, 8, 8))
    for a in range(8):
        for b in range(8):
            cube[a, b, b] = 50
            cube[a, b, (b + 1) % 8] = 5
    log = scoring.fit(cube, 1500)
    assert np.allclose((10.0**log).sum(2), 1)
    unigram = np.log10(cube.sum((0, 1)) / cube.sum())
    assert (cube * log).sum() > (cube * unigram).sum()


# Toxicity


def toxic_rows(n=500):
    rng = np.random.default_rng(8)
    clean, bad = [f"calm{k}" for k in range(200)], [f"vile{x}" for x in ("o", "ing", "st", "ers")]
    rows, labels = [], []
    for i in range(n):
        words, toxic = rng.choice(clean, rng.integers(10, 90)).tolist(), int(i % 3 == 0)
        for at in rng.integers(0, len(words), 4 * toxic):
            words[at] = bad[rng.integers(4)]
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_toxicity(spark):
    rows, labels = toxic_rows()
    table = spark.createDataFrame([*labels, (None, 1), (5000, 1), (7, None), (900, 0)], "doc_id long, toxic int")
    got = toxicity.report(documents(spark, rows + AWKWARD), table).collect()
    assert len(got) == len(rows) + len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) >= 0.9
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)


def test_toxicity_without_lessons(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.report(documents(spark, AWKWARD), none).collect()} == {0.0}
    assert toxicity.report(documents(spark, []), none).collect() == []


def test_every_word_is_in_a_window():
    counts = np.array([0, 1, 24, 25, 36, 37, 500])
    start, size, text = toxicity.windows(counts)
    seen = [set() for _ in counts]
    for s, n, t in zip(start, size, text):
        assert 0 < n <= toxicity.WINDOW
        seen[t] |= set(range(s, s + n))
    starts = np.cumsum(counts) - counts
    assert [sorted(x) for x in seen] == [list(range(a, a + n)) for a, n in zip(starts, counts)]


# Neighbours


def test_neighbours_are_exact_distances_with_high_recall(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    vectors = [(k, (centres[k % 12] + rng.normal(size=16) * 0.3).tolist()) for k in range(1500)]
    vectors += [(5000 + k, vectors[0][1]) for k in range(40)] + [(40, vectors[40][1])]
    bad = [(1, None), (2, []), (3, [0.0] * 16), (4, [math.nan] + [1.0] * 15), (6, [math.inf] * 16), (7, [1.0, None]), (None, [1.0] * 16)]
    frame = spark.createDataFrame([(10_000 + i if i is not None else None, v, 0) for i, v in bad] + [(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, ids int")
    got = defaultdict(list)
    for r in neighbours.search(frame, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    unique = sorted({(i, tuple(v)) for i, v in vectors})
    ids, x = np.array([i for i, _ in unique]), np.array([v for _, v in unique])
    recall = []
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and q not in [v for _, v, _ in found]
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        assert all(abs(d[ids == v][0] - s) < 1e-12 for _, v, s in found)
        recall.append(len({v for _, v, _ in found} & set(ids[order].tolist())) / 10)
    assert np.mean(recall) >= 0.9
    assert [r.vec_id for r in sorted(neighbours.search(frame, F.col("vec_id") == 0).collect())] == [5000 + k for k in range(10)]


def test_few_candidates_come_whole(spark):
    frame = spark.createDataFrame([(k, [float(k + 1), 1.0]) for k in range(4)], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, neighbours.search(frame, F.col("vec_id") == 0).collect()))
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert neighbours.search(frame.limit(0), F.col("vec_id") == 0).collect() == []


def test_a_sample_of_vectors_comes_alone(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 8)
    frame = spark.range(400).selectExpr("id AS vec_id", "array(double(id + 1), double(id % 7)) AS v").repartition(16)
    least = [tuple(r.v) for r in frame.orderBy(F.xxhash64("v")).limit(8).collect()]
    sample = neighbours._sample(frame)
    assert [tuple(r.v) for r in sorted(sample.collect(), key=lambda r: r["_h"])] == least
    assert "TakeOrdered" not in sample._jdf.queryExecution().executedPlan().toString()
    assert neighbours._sample(frame.limit(0)).collect() == [] and neighbours._widths(frame.limit(0)) == {}


def test_many_short_queries_leave_a_short_plan(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SCAN_BLOCK", 2)
    vectors = [(k, [float(k + 1)] * 3) for k in range(9)] + [(100 + k, [1.0, float(k)]) for k in range(12)]
    found = neighbours.search(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.lit(True))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") < 8
    got = defaultdict(dict)
    for r in found.collect():
        got[r.query_id][r.rank] = r.vec_id
    assert set(got) == {i for i, _ in vectors}
    assert [got[0][n] for n in range(1, 9)] == list(range(1, 9)) and len(got[0]) == 8 and all(len(got[100 + k]) == 10 for k in range(12))


def test_probes_meet_every_block_of_a_large_bucket(spark, monkeypatch):
    rng = np.random.default_rng(3)
    frame = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(600)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, neighbours.search(frame, F.col("vec_id") % 50 == 0).collect()))
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "QUERY_TASK", 2)
    monkeypatch.setattr(neighbours, "SLICE", 3)
    assert sorted(map(tuple, neighbours.search(frame, F.col("vec_id") % 50 == 0).collect())) == want


# Personal data and licences

PERSONAL = [
    "mail a@b.c-d@e.f and a@b.c_d@e.f", "1.1.1.1.2.2.2.2 256.1.1.1 1.2.3.0004", "+1((((( 2 4111 1111 1111 1111x😀 a@b.co 4111-1111-1111-1111-1", "+44 20 7946 0958 00",
    "1 " * 3000, "a." * 3000 + "@" + "b." * 4000 + "c 1.2.3.4", "9" * 20_000, "jo (at) ex (dot) com. 415-555-0100", "call +1 (415) 555-0100, card 4242424242424242 or ip 10.0.0.1:80",
]


def luhn(match):
    digits = [int(c) for c in match if c.isdigit()]
    return 14 <= len(digits) <= 19 and sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    found = []
    for k, (name, pattern, check) in enumerate([
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", luhn), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= sum(c.isdigit() for c in m) <= 15),
    ]):
        if name != "email" or len(text) < 10_000:
            found += [(m.start(), k, name, m.end()) for m in re.finditer(pattern, text) if check(m.group())]
        elif "@" in text:  # the plain pattern takes quadratic time; the one long text with an address begins with it
            found += [(0, 0, name, text.index(" "))]
    return ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(found))


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rows = [(k, t) for k, t in enumerate(PERSONAL)] + AWKWARD
    got = personal.report(documents(spark, rows)).collect()
    want = sorted((repr(i), hashlib.sha256(plain_spans(t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((repr(r.doc_id), r.base_sha256) for r in got) == want
    for r in got:
        base = plain_spans(dict(rows).get(r.doc_id) or "")
        assert set(filter(None, base.split(","))) <= set(r.spans.split(",")) and r.n_email + r.n_ip + r.n_card + r.n_phone == len(list(filter(None, base.split(","))))
    assert personal.report(documents(spark, [])).collect() == []


def test_written_out_forms_are_added(spark):
    rng = np.random.default_rng(12)
    rows, planted, decoys = [], set(), set()
    for i in range(300):
        a, b, c = rng.integers(200, 999, 3).tolist()
        own = [f"jo{a} (at) ex{b} (dot) com", f"{a}-{b}-{c:04d}", f"mail jo{a}@ex{b}.com", f"+1 {a} {b} {c:04d}", f"noon{a} (at) hall{b}", f"20{a % 90 + 10}-01-{b % 19 + 10} {c % 14 + 10}", f"{a}{b}{c}{a}"]
        k = i % len(own)
        rows.append((i, f"so {own[k]} then"))
        (planted if k < 2 else decoys if k > 3 else set()).add((i, f"{KIND_OF.get(k)}:3:{3 + len(own[k])}"))
    got = {(r.doc_id, s) for r in personal.report(documents(spark, rows)).collect() for s in r.spans.split(",") if s}
    assert planted <= got and not {i for i, _ in decoys} & {i for i, _ in got}


KIND_OF = {0: "email", 1: "phone"}


def check_digit(digits):
    return next(c for c in "0123456789" if luhn(digits + c))


def test_every_kind_adds_its_written_out_forms_and_no_decoy(spark):
    rng = np.random.default_rng(4)
    rows, planted, decoys = [], set(), set()
    for i in range(900):
        a, b, c = rng.integers(200, 999, 3).tolist()
        fifteen = f"4{a}{b}{c}{rng.integers(10000, 99999)}"
        good = fifteen + check_digit(fifteen)
        bad = fifteen + str((int(good[-1]) + 1 + i % 8) % 10)
        dotted = lambda x: ".".join(x[k : k + 4] for k in range(0, 16, 4))
        own = [
            ("email", f"jo{a} (at) ex{b} (dot) com"), ("phone", f"{a}-{b}-{c:04d}"), ("phone", f"00 44 20 {a} {b}8"), ("card", dotted(good)), ("ip", f"{a % 250}[.]{b % 250}[.]{c % 250}[.]{i % 250}"), ("ip", f"{a % 250} dot {b % 250} dot {c % 250} dot {i % 250}"),
            (None, f"noon{a} (at) hall{b}"), (None, dotted(bad)), (None, f"20{a % 90 + 10}-01-{b % 19 + 10} {c % 14 + 10}"), (None, f"{a}{b}{c}{a}"), (None, f"{a + 256}[.]{b % 250}[.]{c % 250}[.]{i % 250}"),
        ]
        kind, form = own[i % len(own)]
        rows.append((i, f"so {form} then"))
        (planted if kind else decoys).add((i, f"{kind}:3:{3 + len(form)}"))
    got = {(r.doc_id, s) for r in personal.report(documents(spark, rows)).collect() for s in r.spans.split(",") if s}
    assert planted <= got and not {i for i, _ in decoys} & {i for i, _ in got}


def test_boosted_trees_and_their_cells(spark):
    rng = np.random.default_rng(5)
    levels = [n for _, n in personal.FEATURES.values()]
    cells = np.unique(np.stack([rng.integers(0, n, 300) for n in levels], 1), axis=0).astype(float)
    count = rng.integers(1, 50, len(cells)).astype(float)
    positive = np.where((cells[:, 0] == 0) & (cells[:, 4] == 1), count, 0)
    trees = personal.boost(cells, positive, count)
    score = personal.evaluate(trees, cells)
    assert ((score > 0) == (positive > 0)).mean() > 0.95
    frame = spark.createDataFrame([tuple(map(int, c)) for c in cells], ", ".join(f"{n} int" for n in personal.FEATURES))
    got = [r[0] for r in frame.select(F.struct("*").alias("p")).select(F.expr(personal.number_sql())).collect()]
    assert got == personal.cell_numbers(cells).tolist() and len(set(got)) == len(cells)
    stopped = personal.boost(cells[::2], positive[::2], count[::2], (cells[1::2], positive[1::2], count[1::2]))
    loss = lambda n: float((count[1::2] * np.logaddexp(0, x := personal.evaluate(stopped[:n], cells[1::2])) - positive[1::2] * x).sum())
    assert 0 < len(stopped) < personal.TREES and loss(len(stopped)) == min(loss(n) for n in range(len(stopped) + 1))
    bounds = personal.thresholds(score, cells[:, 0], positive, count)
    assert math.isfinite(bounds[0]) and bounds[1:] == [math.inf] * 3


MIT_TEXT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a
copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction.

The above copyright notice and this
permission notice shall be included in all copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD_TEXT = """Copyright (c) 2020, Someone. All rights reserved.

Redistribution and use in source and binary forms are permitted provided that:

* Redistributions of source code must retain the above copyright
  notice, this list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above
  copyright notice.

* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {v} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful. See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice appear in all copies."""
APACHE_HEADER = """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""


def test_usual_licence_texts_are_known_wrapped_and_in_one_line(spark):
    one_line = lambda t: re.sub(r"[\s#*]+", " ", t)
    texts = [(MIT_TEXT, "MIT"), (BSD_TEXT, "BSD-3-Clause"), (GPL_HEADER.format(v=3), "GPL-3.0-or-later"), (GPL_HEADER.format(v=2), "GPL-2.0-or-later"), (ISC_TEXT, "ISC"), (APACHE_HEADER, "Apache-2.0")]
    cases = [(f, name) for t, name in texts for f in (t, one_line(t), t.replace("\n", "\r\n"), "Some text before.\n\n" + t + "\n\nSome text after.")]
    cases += [
        ("Dual-licensed under the MIT license or the Apache License, Version 2.0.", "Apache-2.0,MIT"), ("// SPDX-License-Identifier: Apache-2.0\ncode", "Apache-2.0"),
        ("/* SPDX-License-Identifier: (MIT OR GPL-2.0-only) */\n# SPDX-License-Identifier: MIT", "MIT,GPL-2.0-only"), ("SPDX-License-Identifier:", ""), (MIT_TEXT + "\n\n" + ISC_TEXT, "MIT,ISC"),
        ("GNU Lesser General Public License, version 2.1 or later", "LGPL-2.1"), ("Licensed under the Foo terms. Licensed under the MIT License.", "MIT,Unknown"), ("sooner or later it will rain", ""),
    ]
    got = {r.doc_id: r.licences for r in licences.report(documents(spark, [(k, t) for k, (t, _) in enumerate(cases)])).collect()}
    assert [(cases[k][0], got[k]) for k in range(len(cases))] == [(t, name) for t, name in cases]


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy. The above copyright notice and this permission notice shall be included. The software is provided \"as is\"."
    bsd = "Redistributions of source code must retain the above copyright notice.\nRedistributions in binary form must reproduce the above copyright notice.\nThe software is provided as is."
    cases = [
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("x\nReleased under the MIT License.", "MIT"), (mit, "MIT"), (bsd, "BSD-2-Clause"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("This work is licensed under the GNU General Public License, version 3. Or (at your option) any later version.", "GPL-3.0-or-later"), ("Licensed under the Foo terms", "Unknown"), ("no such thing", ""),
    ]
    rows = [(k, t) for k, (t, _) in enumerate(cases)]
    got = licences.report(documents(spark, rows + AWKWARD)).collect()
    assert len(got) == len(rows) + len(AWKWARD)
    assert {r.doc_id: r.licences for r in got if r.doc_id is not None and r.doc_id < 100} == {k: name for k, (_, name) in enumerate(cases)}
    assert licences.report(documents(spark, [])).collect() == []

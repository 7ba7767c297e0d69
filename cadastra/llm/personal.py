"""Personal data in whole texts, by SQL functions alone.

Base spans follow fixed patterns and checks. Beyond them, generators of high recall propose spans (written-out
addresses, runs of digits under any separators, spelt-out or bracketed quads), the same run once for each kind it could be.
Boosted trees, grown for each kind by itself until their loss on documents apart stops falling, score a proposal on its format and its
surroundings. Their teacher are the base rules, read on the proposal as it would be written plainly (``PLAIN``). A threshold
per kind, calibrated on other documents apart from training and on proposals that touch no base span, selects what is added.

Features are whole numbers of few values, so all proposals of a corpus reduce to at most ``CELLS``
counted cells, which is all that training sees of it, and the trees are evaluated on the cells: a proposal is added if its
cell is among those that pass. Every document is read in its own row; nothing is shuffled but the cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]

# A match begins where its leading run does, or where the last match ended; possessive parts keep the time linear.
PATTERNS = {
    "email": r"(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\\+[0-9][ ().0-9-]+[0-9]",
}
GATES = {"email": "contains(_x, '@')", "ip": r"_x rlike '[0-9]\\.[0-9]++\\.[0-9]'", "card": "_x rlike '[0-9](?:[ -]?[0-9]){13}'", "phone": "contains(_x, '+')"}
_DIGITS = "regexp_replace(c.m, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length({d})), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN cast(substring(reverse({d}), i, 1) AS int) "
    "ELSE 2 * cast(substring(reverse({d}), i, 1) AS int) - CASE WHEN substring(reverse({d}), i, 1) > '4' THEN 9 ELSE 0 END END) % 10 = 0"
)
CHECKS = {
    "email": "true",
    "ip": r"forall(split(c.m, '\\.'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN.format(d=_DIGITS)}",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}
PROPOSALS = {
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|[(\\[] ?at ?[)\\]]) ?[A-Za-z0-9-]++(?:(?:\\.| ?[(\\[] ?dot ?[)\\]] ?)[A-Za-z0-9-]++)*+",
    "digits": r"(?<![0-9])\\+?\\(?[0-9]++(?:[ ().-]{1,3}+[0-9]++)*+",
    "quads": r"(?<![0-9])[0-9]{1,3}(?: ?[(\\[]? ?(?:\\.|dot) ?[)\\]]? ?[0-9]{1,3}){3}(?![0-9])",
}
PROPOSED = {"address": ["email"], "digits": ["card", "phone"], "quads": ["ip"]}
PROPOSAL_GATES = {"address": r"_x rlike '@|[(\\[] ?at ?[)\\]]'", "digits": r"_x rlike '[0-9](?:[ ().-]{0,3}+[0-9]){5}'", "quads": r"_x rlike '[0-9] ?[(\\[]? ?(?:\\.|dot) ?[)\\]]? ?[0-9]'"}

# Whether a proposal p passes the base check of its kind once it is written plainly: signs spelt out, other separators, national numbers.
_AT, _DOT = r" ?[(\\[] ?at ?[)\\]] ?", r" ?[(\\[] ?dot ?[)\\]] ?"
_PLAIN_DIGITS = "regexp_replace(p.m, '[^0-9]', '')"
_CARD = f"CASE WHEN length({_PLAIN_DIGITS}) BETWEEN 14 AND 19 AND NOT startswith(p.m, '+') THEN {_LUHN.format(d=_PLAIN_DIGITS)} ELSE false END"
_QUADS = r"regexp_replace(p.m, '[^0-9]+', '.') rlike '^(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$'"
VALID = f"CASE p.kind WHEN 0 THEN true WHEN 1 THEN {_QUADS} ELSE {_CARD} END"  # the figures themselves: quads in range, a card's check digit
_NATIONAL = (
    r"p.m rlike '^(?:1[ .-]{1,2})?\\(?[2-9][0-9]{2}\\)?[ .-]{1,2}[2-9][0-9]{2}[ .-]{1,2}[0-9]{4}$' OR p.m rlike '^00[ .-]{0,2}[1-9][0-9]*(?:[ ().-]{1,3}[0-9]+)+$' "
    r"OR p.m rlike '^\\(?0[1-9][0-9]{0,3}\\)?(?:[ .-]{1,2}[0-9]{2,4}){2,4}$' AND NOT p.m rlike '(?:19|20)[0-9]{2}[ .-]{1,2}[01]?[0-9][ .-]|[ .-][01]?[0-9][ .-]{1,2}(?:19|20)[0-9]{2}'"
)
PLAIN = {
    "email": rf"regexp_replace(regexp_replace(p.m, '{_AT}', '@'), '{_DOT}', '.') rlike '^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{{2,}}$'",
    "ip": "p.valid",
    "card": "p.valid",
    "phone": rf"length({_PLAIN_DIGITS}) BETWEEN 10 AND 15 AND NOT p.valid AND NOT p.m rlike '^[0-9]+(?:\\.[0-9]+){{3}}$' AND (startswith(p.m, '+') OR {_NATIONAL} OR p.pre rlike '(?i)(?:phone|tel|call|fax|mobile)[^0-9]*$')",
}

# Features of a proposal p (kind, m, pre, post), each with its number of values.
FEATURES = {
    "kind": ("p.kind", 4),
    "digits": (
        "CASE WHEN length(regexp_replace(p.m, '[^0-9]', '')) < 4 THEN 0 WHEN length(regexp_replace(p.m, '[^0-9]', '')) < 8 THEN 1 WHEN length(regexp_replace(p.m, '[^0-9]', '')) < 10 THEN 2 "
        "WHEN length(regexp_replace(p.m, '[^0-9]', '')) < 13 THEN 3 WHEN length(regexp_replace(p.m, '[^0-9]', '')) < 16 THEN 4 WHEN length(regexp_replace(p.m, '[^0-9]', '')) < 20 THEN 5 ELSE 6 END", 7),
    "groups": (r"least(size(split(p.m, '[^0-9]+')), 6)", 7),
    "plus": ("CASE WHEN startswith(p.m, '+') THEN 1 ELSE 0 END", 2),
    "mark": (r"CASE WHEN contains(p.m, '@') THEN 1 WHEN p.m rlike '\\bat\\b.*(?:\\bdot\\b|[.])' THEN 5 WHEN p.m rlike '\\bat\\b' THEN 2 WHEN p.m rlike '^[0-9.]+$' AND contains(p.m, '.') THEN 3 WHEN contains(p.m, '-') OR contains(p.m, ' ') THEN 4 ELSE 0 END", 6),
    "dots": (r"least(length(regexp_replace(p.m, '[^.]', '')), 4)", 5),
    "before": (r"CASE WHEN p.pre = '' OR p.pre rlike '\\s$' THEN 0 WHEN p.pre rlike '[A-Za-z0-9]$' THEN 1 ELSE 2 END", 3),
    "after": (r"CASE WHEN p.post = '' OR p.post rlike '\\s' THEN 0 WHEN p.post rlike '[A-Za-z0-9]' THEN 1 ELSE 2 END", 3),
    "context": (r"CASE WHEN p.pre rlike '(?i)mail|contact' THEN 1 WHEN p.pre rlike '(?i)phone|tel|call|fax|mobile' THEN 2 WHEN p.pre rlike '(?i)card|visa|account|iban' THEN 3 WHEN p.pre rlike '(?i)\\bip\\b|host|server|addr' THEN 4 ELSE 0 END", 5),
    "valid": ("CASE WHEN p.valid THEN 1 ELSE 0 END", 2),
}
CELLS = int(np.prod([n for _, n in FEATURES.values()])) * 6  # values of all features; for training, stopping and calibration; free or not

TREES, PATIENCE, RATE, PRECISION = 400, 15, 0.5, 0.9  # trees of a kind at most, and rounds without gain after which no more are grown


def _walk(pattern: str, gate: str) -> str:
    """SQL for the matches of a pattern in _x: start and end in code points, the match, what stands before and after."""
    pieces, matches = f"split(_x, '{pattern}', -1)", f"regexp_extract_all(_x, '{pattern}', 0)"
    gaps = f"transform({pieces}, x -> named_struct('n', length(x), 'pre', right(x, 24), 'post', left(x, 1)))"
    steps = f"zip_with({matches}, {gaps}, (m, g) -> named_struct('m', m, 'g', g))"
    return f"CASE WHEN {gate} THEN {steps} END"


def _located(zipped: str) -> str:
    """SQL that turns matches with the gaps around them into spans; the last gap has no match."""
    return f"""aggregate(filter({zipped}, z -> z.m IS NOT NULL),
      named_struct('at', 0, 'out', cast(array() AS array<struct<s:int,e:int,m:string,pre:string>>)),
      (a, z) -> named_struct('at', a.at + z.g.n + length(z.m), 'out', concat(a.out, array(named_struct('s', a.at + z.g.n, 'e', a.at + z.g.n + length(z.m), 'm', z.m, 'pre', z.g.pre)))),
      a -> a.out)"""


def base_spans(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``_base``: spans (s, k, e) of the fixed patterns, k the place of the kind in KINDS."""
    out = documents.withColumn("_x", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    for kind in KINDS:
        out = out.withColumn(f"_z_{kind}", F.expr(_walk(PATTERNS[kind], GATES[kind])))
    found = [
        f"coalesce(transform(filter({_located(f'_z_{kind}')}, c -> {CHECKS[kind]}), c -> named_struct('s', c.s, 'k', {k}, 'e', c.e)), array())"
        for k, kind in enumerate(KINDS)
    ]
    out = out.withColumn("_base", F.expr(f"array_sort(concat({', '.join(found)}))"))
    return out.drop(*[f"_z_{kind}" for kind in KINDS])


def proposals(documents: DataFrame) -> DataFrame:
    """Adds ``_proposed``: the proposed spans with their features, whether they touch no base span (free) and whether the base rules agree."""
    out = documents
    parts = []
    for name, kinds in PROPOSED.items():
        out = out.withColumn(f"_z_{name}", F.expr(_walk(PROPOSALS[name], PROPOSAL_GATES[name])))
        after = f"transform(_z_{name}, (z, i) -> named_struct('m', z.m, 'g', z.g, 'post', coalesce(get(_z_{name}, i + 1).g.post, '')))"
        located = f"zip_with({_located(f'_z_{name}')}, filter({after}, z -> z.m IS NOT NULL), (c, z) -> named_struct('s', c.s, 'e', c.e, 'm', c.m, 'pre', c.pre, 'post', z.post))"
        for kind in kinds:
            k = KINDS.index(kind)
            parts.append(f"coalesce(transform({located}, c -> named_struct('s', c.s, 'e', c.e, 'm', c.m, 'pre', c.pre, 'post', c.post, 'kind', {k})), array())")
    features = ", ".join(f"'{name}', {sql}" for name, (sql, _) in FEATURES.items())
    free = "NOT exists(_base, b -> b.s < p.e AND p.s < b.e)"
    plain = " ".join(f"WHEN {k} THEN {PLAIN[kind]}" for k, kind in enumerate(KINDS))
    agreed = f"CASE WHEN array_contains(_base, named_struct('s', p.s, 'k', p.kind, 'e', p.e)) THEN 1 WHEN {free} AND CASE p.kind {plain} END THEN 1 ELSE 0 END"
    judged = f"transform(concat({', '.join(parts)}), p -> named_struct('s', p.s, 'e', p.e, 'm', p.m, 'pre', p.pre, 'post', p.post, 'kind', p.kind, 'valid', {VALID}))"
    listed = f"transform({judged}, p -> named_struct('s', p.s, 'e', p.e, {features}, 'free', CASE WHEN {free} THEN 1 ELSE 0 END, 'label', {agreed}))"
    return out.withColumn("_proposed", F.expr(listed)).drop(*[f"_z_{name}" for name in PROPOSED])


def boost(cells: np.ndarray, positive: np.ndarray, count: np.ndarray, apart: tuple | None = None) -> list[tuple]:
    """Trees of two splits over feature codes: (feature, bound, (feature, bound, low, high), (feature, bound, low, high)), below or at the bound going low.

    ``apart``, further counted cells, says when to stop: only trees up to the least loss on them are kept.
    """
    score, trees = np.zeros(len(cells)), []
    splits = [(f, b) for f, (_, n) in enumerate(FEATURES.values()) for b in range(n - 1)]

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        found = (-1.0, 0, 0)
        for f, b in splits:
            low = rows & (cells[:, f] <= b)
            high = rows & ~low
            gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1)
            found = max(found, (gain, -f, -b))
        return -found[1], -found[2]

    kept, least, held = 0, np.inf, np.zeros(0 if apart is None else len(apart[0]))
    while len(trees) < TREES and (apart is None or len(trees) < kept + PATIENCE):
        p = 1 / (1 + np.exp(-score))
        g, h = positive - count * p, count * p * (1 - p)
        f, b = best(np.ones(len(cells), bool), g, h)
        sides = []
        for rows in (cells[:, f] <= b, cells[:, f] > b):
            f2, b2 = best(rows, g, h)
            leaves = []
            for leaf in (rows & (cells[:, f2] <= b2), rows & (cells[:, f2] > b2)):
                value = float(np.clip(RATE * g[leaf].sum() / (h[leaf].sum() + 1), -2, 2))
                score = score + value * leaf
                leaves.append(value)
            sides.append((f2, b2, *leaves))
        trees.append((f, b, *sides))
        if apart is not None:
            held = held + evaluate(trees[-1:], apart[0])
            loss = float((apart[2] * np.logaddexp(0, held) - apart[1] * held).sum())
            if loss < least - 1e-6 * apart[2].sum():
                kept, least = len(trees), loss
    return trees if apart is None else trees[:kept]


def evaluate(trees: list[tuple], cells: np.ndarray) -> np.ndarray:
    score = np.zeros(len(cells))
    for f, b, low, high in trees:
        for rows, (f2, b2, left, right) in ((cells[:, f] <= b, low), (cells[:, f] > b, high)):
            score += np.where(rows, np.where(cells[:, f2] <= b2, left, right), 0)
    return score


def cell_numbers(cells: np.ndarray) -> np.ndarray:
    """One whole number for each cell, its features as digits."""
    out = np.zeros(len(cells), np.int64)
    for f, (_, n) in enumerate(FEATURES.values()):
        out = out * n + cells[:, f].astype(np.int64)
    return out


def number_sql() -> str:
    """The number of a proposal's cell."""
    out = "0"
    for name, (_, n) in FEATURES.items():
        out = f"({out} * {n} + p.{name})"
    return out


def thresholds(score: np.ndarray, kind: np.ndarray, positive: np.ndarray, count: np.ndarray) -> list[float]:
    """For each kind the lowest score from which on the calibration rows hold PRECISION of agreed proposals; none passes where there is no such score."""
    out = []
    for k in range(len(KINDS)):
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(-score[own], kind="stable")]
        share = np.cumsum(positive[own]) / np.maximum(1, np.cumsum(count[own]))
        ends = np.r_[score[own][1:] != score[own][:-1], True] if len(own) else np.zeros(0, bool)
        good = np.flatnonzero((share >= PRECISION) & ends & (positive[own] > 0))
        out.append(float(score[own][good[-1]]) if len(good) else float("inf"))
    return out


def fit(proposed: DataFrame) -> list[int]:
    """The numbers of the cells that pass: trees and thresholds from all proposals, a fifth of the documents kept for stopping and a fifth
    for calibration; only free ones can be added, so only they set a threshold."""
    names = list(FEATURES)
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    apart = F.when(part == 0, 2).when(part == 1, 1).otherwise(0).alias("_apart")
    rows = proposed.filter("size(_proposed) > 0").select(apart, F.explode("_proposed").alias("p")).groupBy("_apart", *[F.col(f"p.{n}").alias(f"f_{n}") for n in [*names, "free"]])
    counted = rows.agg(F.sum("p.label").alias("positive"), F.count(F.lit(1)).alias("count")).collect()  # at most CELLS rows
    if not counted:
        return []
    data = np.array(sorted(tuple(r) for r in counted), float)
    passing: set[int] = set()
    for k in range(len(KINDS)):
        own = data[data[:, 1] == k]
        train, stop, held = (own[own[:, 0] == a] for a in (0, 1, 2))
        train = train if len(train) else own
        stop, held = (x if len(x) else train for x in (stop, held))
        if not len(own):
            continue
        trees = boost(train[:, 1:-3], train[:, -2], train[:, -1], (stop[:, 1:-3], stop[:, -2], stop[:, -1]))
        held = held[held[:, -3] == 1]
        bound = thresholds(evaluate(trees, held[:, 1:-3]), held[:, 1], held[:, -2], held[:, -1])[k]
        passing |= set(cell_numbers(own[evaluate(trees, own[:, 1:-3]) >= bound][:, 1:-3]).tolist())
    return sorted(passing)


def find(documents: DataFrame) -> DataFrame:
    """``documents`` with ``_base`` and ``_spans`` (base and added), arrays of (s, k, e) in order of start and kind.

    A null text is empty. All rows and columns stay, repeated ids too; rows without an id count as training.
    An added span overlaps no base span. Nothing is added where no kind reaches its threshold, as in an empty table.
    """
    ready = proposals(base_spans(documents))
    passing = ", ".join(map(str, fit(ready))) or "-1"
    chosen = f"filter(_proposed, p -> p.free = 1 AND {number_sql()} IN ({passing}))"
    added = f"transform({chosen}, p -> named_struct('s', p.s, 'k', p.kind, 'e', p.e))"
    return ready.withColumn("_spans", F.expr(f"array_sort(array_distinct(concat(_base, {added})))")).drop("_proposed", "_x")


def report(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of base spans by kind, their digest, all spans."""
    found = find(documents.select("doc_id", "text"))
    kind = f"get(array({', '.join(repr(k) for k in KINDS)}), x.k)"
    listed = lambda c: F.expr(f"array_join(transform({c}, x -> concat({kind}, ':', x.s, ':', x.e)), ',')")
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(_base, x -> x.k = {k})) AS long)").alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(listed("_base"), 256).alias("base_sha256"), listed("_spans").alias("spans"),
    )

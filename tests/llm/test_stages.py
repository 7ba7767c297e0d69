"""The stages as functions: clashing column names, null and string ids, empty tables."""

import pytest
from pyspark.sql import functions as F

from cadastra.llm import decontaminate, lines, minhash, toxicity

CLASHING = ("_gone", "_doc", "_left", "_gone_id", "_gone_text", "_found", "_toxic", "_row", "_digest", "_bucket", "a b", "c.d", "key", "doc", "line", "n")
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [
    f"alpha beta gamma delta epsilon\n{PASSAGE} again", "alpha beta gamma delta epsilon\nsomething else in this line here", "alpha beta gamma delta epsilon", "", None, " \n ",
    " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60)),
]


def table(spark, rows, id_type):
    schema = ", ".join([f"doc_id {id_type}", "text string", "n_chars long", *[f"`{c}` string" for c in CLASHING]])
    return spark.createDataFrame([(i, t, None if t is None else len(t), *[f"{c} of {i}" for c in CLASHING]) for i, t in rows], schema)


def removals(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    benchmark = spark.createDataFrame([(1, PASSAGE), (2, None), (None, "w1 w2")], "item_id long, text string")
    nothing = benchmark.limit(0)
    return {
        "lines": lines.remove_repeated_lines, "near": lambda d: minhash.remove_near_duplicates(d, 5), "contaminated": lambda d: decontaminate.remove_contaminated(d, benchmark),
        "clean": lambda d: decontaminate.remove_contaminated(d, nothing), "toxic": lambda d: toxicity.remove_toxic(d, labels), "unlabelled": lambda d: toxicity.remove_toxic(d, labels.limit(0)),
    }


KEPT = {"lines": {0, 1, 3, 4, 6, 8, None}, "near": {0, 1, 2, 3, 4, 5, 6, 8, None}, "contaminated": {1, 2, 3, 4, 5, 6, 7, 8, None}, "clean": {0, 1, 2, 3, 4, 5, 6, 7, 8, None}}


@pytest.mark.parametrize("name", ["lines", "near", "contaminated", "clean", "toxic", "unlabelled"])
def test_stages_keep_columns_of_any_name(spark, name):
    rows = [*enumerate(TEXTS), (None, "a row without an id, once")]
    given = table(spark, rows, "long")
    out = removals(spark)[name](given)
    assert out.columns == given.columns and out.schema.simpleString() == given.schema.simpleString()
    got = {r.doc_id: r for r in out.collect()}
    for i, r in got.items():
        assert all(r[c] == f"{c} of {i}" for c in CLASHING)
        assert r.text == dict(rows)[i] or name == "lines"
        assert r.n_chars == (None if r.text is None else len(r.text))
    if name in KEPT:
        want = KEPT[name]
        assert set(got) - {5} == want - {5}, name
    else:
        assert got  # a classifier of two documents
    if name == "lines":
        assert got[1].text == "something else in this line here" and got[0].text == TEXTS[0]
    assert removals(spark)[name](given.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["lines", "near", "contaminated"])
def test_stages_take_string_ids(spark, name):
    given = table(spark, [*((f"id-{k}", t) for k, t in enumerate(TEXTS)), (None, "a row without an id, once")], "string")
    out = removals(spark)[name](given)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.schema == given.schema and None in got and "id-8" in got
    if name == "lines":  # of equal lines one document keeps its own
        assert sum((t or "").startswith("alpha beta") for t in got.values()) == 1
        assert sum((t or "").startswith("w0 ") for t in got.values()) == 1
    elif name == "near":
        assert ("id-6" in got) != ("id-7" in got) and "id-0" in got
    else:
        assert "id-0" not in got and "id-1" in got

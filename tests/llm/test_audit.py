"""The filter audit against a plain count over all orders."""

import re
from collections import defaultdict
from itertools import permutations

import pytest

from cladeworks.llm import audit

DOCS = "doc_id long, text string, lang string, kept string"
LABELS = "doc_id long, quality int, toxic int"


def failing(doc_id, text, all_docs):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    checks = {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)),
        "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _, _ in all_docs),
    }
    return {f for f, c in checks.items() if c}


def plain(docs, labels):
    rows = [(lang or "", failing(i, text or "", docs), any(d is not None and d == i and q == 1 for d, q, _ in labels), any(d is not None and d == i and t == 1 for d, _, t in labels)) for i, text, lang, _ in docs]
    out, shapley = [], defaultdict(int)
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                f, before = order[step - 1], set(order[: step - 1])
                own = [r for r in rows if r[0] == part]
                gone = [r for r in own if f in r[1] and not r[1] & before]
                shapley[part, f] += len(gone)
                out.append((part, order, step, sum(not r[1] & (before | {f}) for r in own), len(gone), sum(f in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_equals_plain_count(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, long, "en", "x"), (2, long, "en", "x"), (3, long, "de", "x"), (3, long, "de", "x"), (None, long, None, "x"), (None, None, "", "x"), (4, None, None, "x"), (5, "", "en", "x"),
        (6, "a b " * 150, "en", "x"), (7, long.upper(), "en", "x"), (8, "#" + long, "de", "x"), (9, "a\x0bb\x1cc d", "en", "x"), (9, "another text", "en", "x"), (10, long + " z" * 20_000, "en", "x"), (11, "É" * 90 + "ABC", "fr", "x"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (None, 1, 1), (9, 1, None), (99, 1, 1), (6, 0, 1)]
    got = audit.interactions(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == plain(docs, labels)


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)]])
def test_empty_tables(spark, labels):
    got = audit.interactions(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS))
    assert got.collect() == []
    one = audit.interactions(spark.createDataFrame([(1, None, None, None)], DOCS), spark.createDataFrame([], LABELS))
    assert one.count() == 600


def test_clashing_extra_columns(spark):
    docs = spark.createDataFrame([(1, "x", "en", 5, 6, 7)], "doc_id long, text string, lang string, n int, doc int, part int")
    assert audit.interactions(docs, spark.createDataFrame([(1, 1, 0, 3)], LABELS + ", doc int")).where("filter_order = 'ABCDE' and step = 1 and removed = 1 and good_lost = 1").count() == 1

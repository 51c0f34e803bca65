"""Divergence of sources against a plain version, and joint tables against counting."""

import re
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cladeworks.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, term string, count long"


def low(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def plain(docs, ranks=200):
    counts, rows, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = [low(t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        rows[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in rows[lang].items() if n >= 3]
        total = Counter()
        for g, s in groups:
            if g == lang:
                total.update({t: counts[g, s][t] for t in kept})
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        own, f = p(counts[lang, source]), lambda p, q: (p - q) ** 2 // q
        pairs = [(other, sum(f(own[t], q) for t, q in p(counts[lang, other]).items())) for g, other in groups if g == lang and other != source]
        every = p(total)
        single = [(t, f(own[t], every[t])) for t in kept if counts[lang, source][t] and own[t] > every[t]]
        for part, found in (("pair", pairs), ("term", single)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < ranks]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(i, *d, "clash", 9) for i, d in enumerate(docs)], DOCS)


def test_audit_equals_plain(spark):
    docs = [
        ("The the THE cat's é Éa", "en", "a"), ("the cat\x00dog", "en", "b"), ("the É é cat", "en", "a"), ("the cat É é", "en", None), (None, "en", "empty"), ("", None, "x"), ("x x x", None, "y"), ("x", "", "y"), ("x", "", "x"),
        ("only here", "de", "a"), ("only here", "de", "b"), ("w " * 700_000 + "Zz", "fr", "long"), ("w zz", "fr", "b"), ("zz W", "fr", "b"), ("q", "xx", "alone"),
    ] + [(f"t{i % 17} u{'abc'[i % 3]} " * (i % 5 + 1), "en", f"s{i % 4}") for i in range(60)]
    got = divergence.audit(frame(spark, docs))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(docs)


def test_ranks_and_empty_table(spark):
    docs = [(" ".join("abcdefghij"[: i + 1]), "en", f"s{i % 2}") for i in range(8)] + [("k l m n", "en", "s3")] * 3
    assert sorted(map(tuple, divergence.audit(frame(spark, docs), ranks=2).collect())) == plain(docs, 2)
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


@settings(max_examples=30, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 4), min_size=1)), min_size=1, max_size=30), st.integers(1, 9), st.integers(1, 5))
def test_products_count_pairs_of_levels(rows, columns, terms):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("source", pa.string()), ("count", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([[{"source": s, "count": c} for s, c in r[1].items()] for r in rows], kind)], ["lang", "groups"])
    got = Counter()
    for out in divergence._products(iter([batch]), columns, terms):
        for r in out.to_pylist():
            got[r["lang"], r["source_a"], r["source_b"], r["a"], r["b"]] += r["n"]
    want = Counter((lang, s, o, g[s], g[o]) for lang, g in rows for s in g for o in g if s < o)
    assert got == want


def test_counts_are_sent_on_when_many_are_held():
    import pyarrow as pa

    texts = [f"a{'bcdefgh'[i % 7]} b" for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 50), pa.array(["s"] * 50)], ["text", "lang", "source"])
    for most in (1, 10, 1000):
        total = Counter()
        for out in divergence._count(iter([batch]), most):
            for r in out.to_pylist():
                total["s", r["term"]] += sum(r["counts"])
                total[None, r["term"]] += r["n_docs"]
                assert r["sources"] == ["s"] * len(r["counts"])
        assert total == Counter([("s", t) for x in texts for t in x.split()] + [(None, t) for x in texts for t in x.split()])

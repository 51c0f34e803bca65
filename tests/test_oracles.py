"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from cladeworks.plans.bindings import with_views
from cladeworks.plans.registry import ORACLES, QUERIES
from cladeworks.plans.roster import features

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(names, data):
    tidy = lambda v: round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(tidy(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def _views(names):
    return with_views(names, "SELECT 1").removeprefix("WITH ").removesuffix(" SELECT 1")


def test_every_other_query_is_tested_here():
    assert set(QUERIES) - set(ORACLES) == {"logreg_l1", "forest", "svm", "cv_models", "select_then_fit", "coef_permutation", "gene_models", "coverage_prune"}


@pytest.mark.parametrize("name, drugs", [("logreg_l1", {"quality", "toxic"}), ("forest", {"quality", "toxic"}), ("svm", {"quality", "toxic"}), ("select_then_fit", {"quality", "toxic"}), ("gene_models", {"signup", "purchase", "view", "click", "error"})])
def test_model_queries_judge_the_samples_left_out(spark, duck, name, drugs):
    got = {r["drug"]: r for r in QUERIES[name](spark, DATA).collect()}
    assert set(got) <= drugs and (got or name == "gene_models")  # so few samples have calls and labels here
    for drug, r in got.items():
        if name != "gene_models":
            n = duck.execute("SELECT count(*) FROM labels WHERE (CASE ? WHEN 'quality' THEN quality ELSE toxic END) IS NOT NULL", [drug]).fetchone()[0]
            assert n // 5 <= r["tp"] + r["fp"] + r["tn"] + r["fn"] <= n // 5 + 1
            assert r["auc"] > 0.5 or drug == "toxic"
        assert all(0 <= r[c] <= 1 for c in ("ppv", "npv", "sens", "spec", "f1", "auc"))


def test_folds_and_permutations_on_the_tables(spark, monkeypatch):
    monkeypatch.setattr(features, "PERMUTATIONS", 3)
    found = QUERIES["coef_permutation"](spark, DATA).collect()
    assert {r["drug"] for r in found} <= {"quality", "toxic"} and all(r["p_value"] in (0, 1 / 3, 2 / 3, 1) and r["coefficient"] != 0 for r in found)
    assert {r["drug"]: r["n_folds"] for r in QUERIES["cv_models"](spark, DATA).collect()} == {"quality": 10, "toxic": 10}


def test_coverage_prune_equals_rounds_by_hand(spark, duck):
    live = set(duck.execute(f"WITH {_views(['b_depth'])} SELECT sample_id, pos FROM b_depth WHERE depth >= 10").fetchall())
    n_samples, n_sites = duck.execute(f"WITH {_views(['b_depth'])} SELECT count(DISTINCT sample_id), count(DISTINCT pos) FROM b_depth").fetchone()
    size = None
    while live and size != (n_samples, n_sites):
        size = n_samples, n_sites
        own = Counter(s for s, _ in live)
        live = {(s, p) for s, p in live if own[s] >= 0.2 * n_sites}
        n_samples = len({s for s, _ in live})
        on = Counter(p for _, p in live)
        live = {(s, p) for s, p in live if on[p] >= 0.2 * n_samples}
        n_sites = len({p for _, p in live})
    want = Counter(s for s, _ in live)
    assert {r["sample_id"]: r["n_sites"] for r in QUERIES["coverage_prune"](spark, DATA).collect()} == dict(want)

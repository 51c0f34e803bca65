"""Operators whose cost or memory once grew out of proportion: their rows against plain versions, and what their plans hold."""

import random
import re
import tracemalloc
import uuid

import numpy as np
import pyarrow as pa

from cladeworks.operators import common, consequence, features, graph, intervals, manyfits, quality
from cladeworks.plans.roster import features as roster


def test_nearest_features_without_a_frame_that_ends_unbounded(spark):
    rng = random.Random(31)
    feat = [(f"g{i}", s, s + rng.randrange(1, 90_000)) for i, s in enumerate(rng.sample(range(1, 400_000), 60))] + [("twin_b", 500, 700), ("twin_a", 500, 700)]
    points = [rng.randrange(1, 500_000) for _ in range(300)] + [499, 500, 701]
    near = intervals.nearest(spark.createDataFrame([(p,) for p in points], "pos long"), spark.createDataFrame(feat, "name string, start_pos long, end_pos long"))
    left = lambda p: max(((e, s, n) for n, s, e in feat if e < p), default=(None,) * 3)[2]
    right = lambda p: min(((s, e, n) for n, s, e in feat if s > p), default=(None,) * 3)[2]
    assert sorted(map(tuple, near.collect())) == sorted((p, left(p), right(p)) for p in set(points))
    # Spark goes through such a frame anew for every row, so a range of the axis would cost the square of its rows.
    assert "unboundedfollowing" not in near._jdf.queryExecution().toString().lower()


def test_known_labels_are_not_sent_to_every_task(spark):
    rng = random.Random(32)
    sites = [(f"g{rng.randrange(6)}", rng.randrange(9), rng.choice("xyz")) for _ in range(25)]
    genes = [(f"g{i}", d) for i in range(4) for d in rng.sample("xyz", 2)]
    variants = [(p, f"g{g}", i) for p in range(9) for g in range(7) for i in (True, False)]
    feat = spark.createDataFrame([(f"g{i}", 3 * i, 3 * i + 5) for i in range(6)], "name string, start_pos long, end_pos long")
    frames = spark.createDataFrame(variants, "pos long, gene string, indel boolean"), spark.createDataFrame(sites, "gene string, pos long, label string"), spark.createDataFrame(genes, "gene string, label string")
    found = graph.known_labels(*frames)
    want = {(p, g, i): min([d for n, d in genes if n == g] if i else [d for n, q, d in sites if (n, q) == (g, p)], default="miss") for p, g, i in variants}
    assert {(r["pos"], r["gene"], r["indel"]): r["label"] for r in found.collect()} == want
    for df in (found, intervals.points_in_intervals(frames[0], feat), intervals.last_feature(frames[0], feat)):  # tables this small would go by broadcast otherwise
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_wide_table_are_not_shuffled(spark):
    rng = random.Random(33)
    places = {p: rng.choice("ACGT") for p in rng.sample(range(1000), 45)}
    cells = {(r, p): rng.choice("XYZ") for r in range(11) for p in places if rng.random() < (0.9 if r == 3 else 0.1)}
    frame = spark.createDataFrame([(*k, v) for k, v in cells.items()] + [(5, min(places), None)] * ((5, min(places)) not in cells), "row long, place long, value string")
    lines = consequence.wide_rows(frame, spark.createDataFrame(list(places.items()), "place long, value string"), spark.createDataFrame([(r,) for r in [*range(13), 4]], "row long"), "row", "place", 8, 4)
    want = {r: "".join(cells.get((r, p), places[p]) for p in sorted(places)) for r in range(13)}
    assert sorted(map(tuple, lines.collect())) == sorted((r, i, t[8 * i : 8 * i + 8]) for r, t in want.items() for i in range(6))
    # A table of rows and stretches has as many rows as the result has lines; none is dealt by both.
    assert not re.search(r"hashpartitioning\(row#\w+, block#", lines._jdf.queryExecution().executedPlan().toString())


def test_pairs_are_counted_a_stretch_at_a_time(monkeypatch):
    """Counters and pairs of a task stay within their bounds, whatever the blocks hold."""
    rng = random.Random(34)
    sets = [sorted(rng.sample(range(40), rng.randrange(1, 20))) for _ in range(17)]
    side = lambda s: common.Side([pa.table({"item": pa.array([f"i{i:02d}" for i in s]), "owners": pa.array([sets[i] for i in s], pa.list_(pa.int64())), "code": pa.array(s)}).to_batches()[0]])
    monkeypatch.setattr(common, "CELLS", 30)
    monkeypatch.setattr(common, "PAIRS", 25)
    two = common.Pairs(side([4, 0, 1, 2, 3]), side(range(5, 17)), False)
    seen = {}
    for first, last in two.stretches():
        assert (last - first) * 12 <= 30
        assert all(len(cell) <= 25 for cell, _ in two.common(first, last))
        n, odd = two.count(first, last, odd=True)
        seen |= {(a, b + 5): (int(n[a - first, b]), int(odd[a - first, b])) for a in range(first, last) for b in range(12)}
    both = {(a, b): set(sets[a]) & set(sets[b]) for a in range(5) for b in range(5, 17)}
    assert seen == {k: (len(v), sum(x % 2 for x in v)) for k, v in both.items()}


def test_pairs_of_features_in_blocks_equal_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(common, "ENTRIES", (20, 20))  # several blocks
    rng = random.Random(35)
    has = {s: {f"f{i:02d}" for i in range(14) if rng.random() < 0.4} for s in range(30)}
    has[30] = {"f00"}
    label = {s: rng.randrange(2) for s in has if s % 9}
    rows = spark.createDataFrame([(s, f) for s, fs in has.items() for f in fs], "sample_id long, feature string")
    names = sorted(set().union(*has.values()))
    pairs = {(a, b): [s for s, fs in has.items() if {a, b} <= fs] for a in names for b in names if a < b}

    joint = features.joint_features(rows, 5)
    want = [(s, f) for s, fs in has.items() for f in fs] + [(s, f"{a}&{b}") for (a, b), ss in pairs.items() if len(ss) > 5 for s in ss]
    assert sorted(map(tuple, joint.collect())) == sorted(want)
    # A join of the features with themselves has a row for every two features of a sample.
    assert not re.search(r"Join.*sample_id#\d+L?\], \[sample_id", joint._jdf.queryExecution().executedPlan().toString())

    one = {f: [s for s in label if f in has[s]] for f in names}
    both = {k: [s for s in ss if s in label] for k, ss in pairs.items()}
    ones = lambda ss: sum(label[s] for s in ss)
    good = lambda a, b, n: 3 < n < len(label) - 3 and min(len(one[a]), len(one[b])) - n > 2 and n < 0.9 * (len(one[a]) + len(one[b]) - n)
    kept = {(a, b, len(ss), ones(ss)) for (a, b), ss in both.items() if good(a, b, len(ss)) and ones(ss) * len(one[a]) * len(one[b]) != ones(one[a]) * ones(one[b]) * len(ss)}
    assert {tuple(r) for r in features.screen_pairs(rows, spark.createDataFrame(list(label.items()), "sample_id long, pheno int"), 3, 2, 0.9).collect()} == kept and kept

    near = {(r["sample_id"], r["neighbour"], r["distance"]) for r in features.nearest_neighbour(rows, rows.where("sample_id < 20")).collect()}
    others = {s: [(len(fs ^ has[t]), t) for t in range(20) if t != s and fs & has[t]] for s, fs in has.items()}
    assert near == {(s, min(o)[1], min(o)[0]) for s, o in others.items() if o}


def test_pairs_of_nothing(spark):
    rows = spark.createDataFrame([(1, "a")], "sample_id long, feature string").where("false")
    assert features.joint_features(rows, 1).isEmpty() and features.nearest_neighbour(rows, rows).isEmpty()
    assert features.screen_pairs(rows, rows.selectExpr("sample_id", "1 as pheno"), 3, 2, 0.9).isEmpty()


def test_edges_of_many_groups_are_not_dealt_by_group(spark):
    rng = random.Random(36)
    edges = {(a, b) for a in range(25) for b in range(25) if a != b and rng.random() < 0.2}
    groups = [(g, n) for g in range(-1, 300) for n in rng.choices(range(30), k=rng.randrange(1, 12))]
    found = graph.induced(spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame(groups, "grp int, node long"))
    inside = {g: {n for h, n in groups if h == g} for g in range(-1, 300)}
    assert {r["grp"]: r["n_edges"] for r in found.collect()} == {g: sum(a < b and {a, b} <= ns for a, b in edges) for g, ns in inside.items()}
    assert not re.search(r"hashpartitioning\((grp#\w+, dst|dst#\w+, grp)", found._jdf.queryExecution().executedPlan().toString())


def test_sites_meet_groups_of_many_samples(spark):
    rng = random.Random(37)
    rows = {(s, p): rng.randrange(20) for s in range(4200) for p in rng.sample(range(6), 2)}
    depth = spark.createDataFrame([(*k, d) for k, d in rows.items()], "sample_id long, pos long, depth long")
    cells = quality.site_coverage(depth, spark.createDataFrame([(p,) for p in (0, 3, 9)], "pos long"), 10)
    got = cells.collect()
    assert len(got) == 3 * 4200 and {(r["sample_id"], r["pos"]) for r in got if r["covered"]} == {k for k, d in rows.items() if d >= 10 and k[1] in (0, 3)}
    # With 64 samples to a row there would be 66 rows for each site to join, not 2.
    assert "shiftright(code" in (plan := cells._jdf.queryExecution().toString()) and ", 12)" in plan


def test_features_of_models_are_worked_out_once(spark, tmp_path):
    """What features are cut out of whole texts for is read several times, the texts are not."""

    def seen(batches):
        for batch in batches:
            with open(f"{tmp_path}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(batch.num_rows))
            yield batch

    rows = spark.createDataFrame([(s, f"f{f}") for s in range(40) for f in range(6) if (s + f) % 3], "sample_id long, feature string")
    labels = spark.createDataFrame([(s, "d", s % 2) for s in range(40)], "sample_id long, drug string, pheno int")
    data = roster._ml(rows.repartition(1).mapInArrow(seen, "sample_id long, feature string"), labels, 2, 4)
    assert data.count() == 40 and sum(int(p.read_text()) for p in tmp_path.iterdir()) == 160


def test_driver_holds_few_matrices_of_many_fits(monkeypatch):
    shape, target = (20_001, 10), np.linspace(-1, 1, 10)
    monkeypatch.setattr(manyfits, "_over_samples", lambda rows, shape, first, matrix, curvature: matrix.copy() if curvature else np.multiply(d := matrix - target, 0.25, out=d))
    tracemalloc.start()
    fitted = manyfits._fit(None, 20_000, 10, 0, 0.02, 500, 1e-9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.sign(target) * np.maximum(np.abs(target) - 0.08, 0)  # a slope of a quarter
    assert np.abs(fitted[:-1] - want).max() < 1e-6 and np.abs(fitted[-1] - target).max() < 1e-6
    assert peak < 4.5 * 8 * shape[0] * shape[1]

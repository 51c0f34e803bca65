"""Hand-made cases and properties of operators."""

import random

from pyspark.sql import functions as F

from cladeworks.functions import sequence as sq
from cladeworks.operators import compare, consequence, evaluate, features, intervals, islands, quality, reads, tree
from cladeworks.plans.components import connected_components
from cladeworks.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_binned_joins_equal_nested_loops(spark):
    rng = random.Random(1)
    points = [(rng.randrange(3000),) for _ in range(200)]
    spans = [(i, s := rng.randrange(3000), s + rng.randrange(0, 700)) for i in range(60)] + [(99, 10, 5)]
    p, i = spark.createDataFrame(points, "pos long").distinct(), spark.createDataFrame(spans, "id long, start_pos long, end_pos long")
    for width in (7, 256, 5000):
        got = {(r["pos"], r["id"]) for r in intervals.points_in_intervals(p, i, width=width).collect()}
        assert got == {(x, k) for (x,) in points for k, s, e in spans if s <= x <= e}
        q = i.select(F.col("id").alias("b"), F.col("start_pos").alias("bs"), F.col("end_pos").alias("be"))
        pairs = intervals.spans_overlap(i.where("start_pos <= end_pos"), q, "start_pos", "end_pos", "bs", "be", width=width)
        both = [(r["id"], r["b"]) for r in pairs.collect()]
        assert len(both) == len(set(both))
        assert set(both) == {(a, b) for a, s, e in spans for b, t, f in spans if s <= e and t <= f and s <= f and t <= e}
    for df in (intervals.points_in_intervals(p, i), intervals.points_in_intervals(p, i, how="left_anti"), pairs):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    assert intervals.points_in_intervals(p, i.limit(0), how="left_anti").count() == p.count()


def test_islands_and_back(spark):
    rng = random.Random(2)
    rows = {(s, rng.randrange(60)) for s in range(3) for _ in range(40)}
    df = spark.createDataFrame(sorted(rows), "s int, pos long")
    runs = islands.merge_adjacent(df, ["s"])
    assert {(r["s"], r["pos"]) for r in islands.split_runs(runs).collect()} == rows
    edges = {(r["s"], r["start_pos"] - 1) for r in runs.collect()} | {(r["s"], r["start_pos"] + r["length"]) for r in runs.collect()}
    assert not edges & rows


def test_sequences(spark):
    row = spark.createDataFrame([("ATGGCC-TAA",)], "s string").select(
        sq.reverse_complement(F.col("s")).alias("rc"), sq.reverse_complement(sq.reverse_complement(F.col("s"))).alias("same"), sq.protein(F.lit("ATGGCCTAAGG")).alias("p"),
        sq.protein(F.lit("AT")).alias("none"), sq.amino_acid(F.lit("TGG")).alias("w"), sq.amino_acid(F.lit("T-G")).alias("gap")).first()
    assert tuple(row) == ("TTA-GGCCAT", "ATGGCC-TAA", "MA*", "", "W", None)


def test_codon_changes_combine_on_both_strands(spark):
    ref = spark.createDataFrame([("ATGGCCTAAATG",)], "seq string")
    snps = [(1, "plus", 1, 9, 1, 4, "A"), (1, "plus", 1, 9, 1, 5, "A"), (2, "minus", 1, 9, -1, 9, "C"), (3, "plus", 1, 9, 1, 6, "T")]
    df = spark.createDataFrame(snps, "sample_id int, gene string, start_pos int, end_pos int, strand int, pos int, alt string")
    got = {tuple(r) for r in consequence.snp_consequences(df, consequence.reference_chunks(ref, 5, 4)).collect()}
    # plus: GCC -> AAC (A to N); minus: last codon TAA read backwards is TTA (L), with C at its first base GTA (V); GCC -> GCT stays A.
    assert got == {(1, "plus", 2, "A", "N"), (2, "minus", 1, "L", "V")}


def test_decompose_single_events(spark):
    cases = [("del", "ACGT", "AT"), ("ins", "AT", "ACGT"), ("snp", "ACGT", "AGGT"), ("same", "AC", "AC")]
    got = {tuple(r) for r in consequence.decompose(spark.createDataFrame(cases, "key string, ref string, alt string")).collect()}
    assert got == {("del", 1, "C", "", "del"), ("del", 2, "G", "", "del"), ("ins", 1, "", "CG", "ins"), ("snp", 1, "C", "G", "snp")}


def test_window_stats_have_the_asked_bounds(spark):
    rng = random.Random(3)
    rows = [(1, p, rng.randrange(50)) for p in sorted(rng.sample(range(1, 900), 300))]
    got = {r["pos"]: r["mean"] for r in quality.window_stats(spark.createDataFrame(rows, "sample_id int, pos long, depth int"), 4).collect()}
    for _, p, _ in rows:
        near = [d for _, x, d in rows if p - 1 <= x <= p + 2]
        assert abs(got[p] - sum(near) / len(near)) < 1e-9


def test_prune_reaches_a_fixpoint(spark):
    rows = [(s, p, 20) for s in range(6) for p in range(10) if not (s == 5 and p > 2) and not (p == 9 and s > 1)]
    out = quality.prune(spark.createDataFrame(rows, "sample_id int, pos int, depth int"), 10, 0.8)
    assert {r["sample_id"] for r in out.collect()} == set(range(5)) and {r["pos"] for r in out.collect()} == set(range(9))


TREE = [(0, None, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 4), (5, 2, 5), (6, 2, 6), (7, 5, 7), (8, 5, 8)]


def test_tree_folds_and_pruning(spark):
    edges = spark.createDataFrame(TREE, "child long, parent long, dist long")
    assert {tuple(r) for r in tree.numbered(edges).collect()} == {(0, 0, 8), (1, 1, 3), (3, 2, 2), (4, 3, 3), (2, 4, 8), (5, 5, 7), (7, 6, 6), (8, 7, 7), (6, 8, 8)}
    assert {r["node"] for r in tree.leaves(edges).collect()} == {3, 4, 6, 7, 8}
    keep = spark.createDataFrame([(3,), (7,), (8,)], "node long")
    cut = {tuple(r) for r in tree.prune(edges, keep, True).collect()}
    assert cut == {(0, None, 0), (3, 0, 4), (5, 0, 7), (7, 5, 7), (8, 5, 8)}
    assert {(r["child"], r["dist"]) for r in tree.prune(edges, keep).collect()} == {(0, 0), (3, 3), (5, 5), (7, 7), (8, 8)}
    lca = tree.last_common_ancestor(spark.createDataFrame([("a", 7), ("a", 6), ("b", 3), ("b", 8), ("c", 8), ("d", 5), ("d", 7)], "grp string, node long"), edges)
    assert {tuple(r) for r in lca.collect()} == {("a", 2), ("b", 0), ("c", 8), ("d", 5)}
    assert {tuple(r) for r in tree.depth_to_tip(edges).collect()} == {(0, 2, 3), (1, 1, 1), (2, 1, 2), (5, 1, 1)}


def test_trees_at_random(spark):
    rng = random.Random(8)
    parent = {0: None, 200: None} | {i: rng.choice([i - 1, rng.randrange(i)]) for i in range(1, 200)} | {i: rng.randrange(200, i) for i in range(201, 220)}
    edges = spark.createDataFrame([(i, p, i) for i, p in parent.items()], "child long, parent long, dist long")
    up = lambda i: [i] + (up(parent[i]) if parent[i] is not None else [])
    tips = set(parent) - {p for p in parent.values() if p is not None}
    below = {i: [(t, up(t).index(i)) for t in tips if i in up(t)] for i in parent}
    assert {tuple(r) for r in tree.depth_to_tip(edges).collect()} == {(i, min(s for _, s in b), max(s for _, s in b)) for i, b in below.items() if b and i not in tips}
    groups = [(g, rng.choice(list(parent))) for g in range(60) for _ in range(rng.randint(1, 3))]
    shared = {g: set.intersection(*[set(up(n)) for h, n in groups if h == g]) for g in range(60)}
    lca = tree.last_common_ancestor(spark.createDataFrame(groups, "grp long, node long"), edges)
    assert {tuple(r) for r in lca.collect()} == {(g, max(s, key=lambda n: len(up(n)))) for g, s in shared.items() if s}
    carriers = [(p, i) for i in parent for p in range(3) if rng.random() < 0.7]
    has = set(carriers)
    kids = {i: [k for k in parent if parent[k] == i] for i in parent}
    def paths(p, i):
        on = [x for k in kids[i] if (p, k) in has for x in paths(p, k)]
        return [x + 1 for x in on] or [0]
    got = tree.character_paths(edges, spark.createDataFrame(carriers + carriers[:5], "pos long, node long"))
    assert {tuple(r) for r in got.collect()} == {(p, i, min(paths(p, i)), max(paths(p, i))) for p, i in has}
    states = spark.createDataFrame([(i, "RS"[i % 2]) for i in parent], "node long, state string")
    want = {(i, len(b), sum(t % 2 == 0 for t, _ in b)) for i, b in below.items() if i not in tips}
    assert {tuple(r) for r in tree.subtree_counts(edges, states).collect()} == want
    member = tree.members(edges, spark.createDataFrame([(0,), (5,)], "node long"))
    assert {tuple(r) for r in member.collect()} == {(i, t) for i in (0, 5) for t, _ in below[i]}


def test_clades_of_one_tree_in_another(spark):
    edges = spark.createDataFrame(TREE, "child long, parent long, dist long")
    other = spark.createDataFrame([(20, None, 0), (21, 20, 0), (22, 21, 0), (3, 22, 0), (7, 22, 0), (4, 21, 0), (8, 20, 0)], "child long, parent long, dist long")
    posterior = spark.createDataFrame([(0, 0.9), (1, 0.51), (2, 0.6), (5, 0.5), (6, 0.99), (8, 0.7)], "node long, posterior double")
    assert {tuple(r) for r in tree.clade_features(edges, posterior, other).collect()} == {(0, 20), (1, 21), (2, 20), (8, 8)}


def test_a_long_chain_keeps_one_row_for_each_node(spark):
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("child"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1).cast("long").alias("dist"))
    depth = tree.depth_to_tip(edges)
    assert depth.where("low <> high or high <> %d - node" % (n - 1)).isEmpty() and depth.count() == n - 1
    assert [tuple(r) for r in tree.prune(edges, spark.createDataFrame([(n - 1,)], "node long"), True).collect()] == [(n - 1, None, 1)]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {x: x for p in pairs for x in p}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in {x for a, b in pairs if a != b for x in (a, b)}}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_metrics_are_bounded_and_defined(spark):
    rows = [("a", 1, 1), ("a", 0, 1), ("a", 0, 0), ("b", 0, 0)]
    got = {r["drug"]: r.asDict() for r in evaluate.metrics(spark.createDataFrame(rows, "drug string, pheno int, pred int"), ["drug"]).collect()}
    assert got["a"]["ppv"] == 0.5 and got["a"]["sens"] == 1 and got["a"]["auc"] == 0.75 and got["b"]["f1"] == 0
    assert all(0 <= got[d][m] <= 1 for d in got for m in ("ppv", "npv", "sens", "spec", "f1", "f_ss", "auc"))


def test_jaccard_and_same_members(spark):
    rng = random.Random(5)
    sets = {i: {f"m{rng.randrange(12)}" for _ in range(rng.randint(1, 9))} for i in range(40)}
    df = spark.createDataFrame([(i, m) for i, s in sets.items() for m in s], "o int, m string")
    got = {(r["a"], r["b"]) for r in compare.jaccard(df, "o", "m", 0.5).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    same = {tuple(r) for r in compare.same_members(df, "o", "m").collect()}
    assert same == {(min(a for a in sets if sets[a] == sets[b]), b) for b in sets if min(a for a in sets if sets[a] == sets[b]) != b}


def test_encode_is_dense_and_ordered(spark):
    words = [f"w{i % 37:02d}" for i in range(200)]
    got = {r["feature"]: r["code"] for r in features.encode(spark.createDataFrame([(w,) for w in words], "feature string")).collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words)))}


def test_vectors_keep_more_features_than_the_default_vocabulary(spark):
    n = (1 << 18) + 500
    features = spark.range(n).select((F.col("id") % 50).alias("sample_id"), F.concat(F.lit("f"), "id").alias("feature"))
    rows, vocabulary = evaluate.vectors(features)
    assert len(vocabulary) == n
    assert sum(r["x"].numNonzeros() for r in rows.collect()) == n


def test_edge_mutations_join_the_codon(spark):
    """Reference ATG AAA CCC T: a plus gene at 1-6, a minus gene at 7-9; position 10 is outside."""
    edges = spark.createDataFrame([(0, None, 1), (1, 0, 1), (2, 1, 1)], "child long, parent long, dist long")
    rows = [
        (0, 4, "A"), (1, 4, "C"), (0, 6, "G"), (1, 6, "G"),  # AAG to CAG: the site after the change counts though it stays
        (1, 3, "A"), (2, 3, "G"), (1, 2, "T"), (2, 2, "T"),  # ATA to ATG
        (0, 7, "C"), (1, 7, "A"), (0, 10, "T"), (1, 10, "G"),  # minus: GGG to GGT, silent; outside
        (2, 10, "C"), (2, 8, "A"),  # a base at one end only is no change
    ]
    bases = spark.createDataFrame(rows, "node long, pos long, base string")
    genes = spark.createDataFrame([(p, "a", 1, 6, 1) for p in range(1, 7)] + [(p, "b", 7, 9, -1) for p in range(7, 10)], "pos long, gene string, start_pos long, end_pos long, strand int")
    chunks = consequence.reference_chunks(spark.createDataFrame([("ATGAAACCCT",)], "seq string"))
    found = tree.mutation_lists(tree.edge_mutations(edges, bases, genes, chunks), edges)
    assert {r["child"]: (r["syn"], r["nonsyn"]) for r in found.collect()} == {1: (["7"], ["K4Q", "T10G"]), 2: ([], ["I1M", "G10C"])}


def test_site_rows_cut_and_fill(spark):
    cells = spark.createDataFrame([(1, 0, "A"), (1, 5, "C"), (2, 2, "G"), (2, 4, "T")], "node long, pos long, base string")
    found = {(r["node"], r["block"]): r["row"] for r in consequence.site_rows(cells, ["node"], width=4).collect()}
    assert found == {(1, 0): "A-", (2, 0): "-G", (1, 1): "-C", (2, 1): "T-"}
    assert consequence.site_rows(cells.limit(0), ["node"]).isEmpty()


def test_pairs_on_variants(spark):
    """Variant 15 lies in both mates of p1 and in one of p2; 100 in none; p3 is improper, p4 of another sample."""
    rows = [("s", "p1", 0, 10, 20, True), ("s", "p1", 1, 14, 30, True), ("s", "p2", 0, 15, 25, True), ("s", "p2", 1, 50, 60, True), ("s", "p3", 0, 1, 40, False), ("t", "p4", 0, 1, 40, True), ("t", "p4", 1, 2, 41, True)]
    frame = spark.createDataFrame(rows, "sample_id string, qname string, mate int, start_pos long, end_pos long, is_proper boolean")
    variants = spark.createDataFrame([("s", 15, "A", "snp"), ("s", 15, "A", "snp"), ("s", 55, "C", "snp"), ("s", 100, "G", "snp"), ("t", 15, "A", "snp")], "sample_id string, pos long, alt string, vtype string")
    stats = reads.variant_pairs(frame, variants, 0.5)
    got = {(r["sample_id"], r["pos"]): tuple(r)[4:] for r in stats.collect()}
    # Inserts of s: p1 21 at 15, p2 46 at 15 and 55: mean 37.67, deviation 11.79.
    assert got == {("s", 15): (4, 3, 2, 33.5, 2), ("s", 55): (1, 1, 1, 46.0, 1), ("s", 100): (0, 0, 0, None, 0), ("t", 15): (2, 2, 1, 41.0, 0)}
    shares = {(r["pos"], r["alt"]): tuple(r)[3:] for r in reads.pairs_by_variant(stats).collect()}
    assert shares == {(15, "A"): (2, 6, 5, 2, 0.0, 0.5), (55, "C"): (1, 1, 1, 1, 0.0, 1.0), (100, "G"): (1, 0, 0, 0, 0.0, 0.0)}
    assert {(r["sample_id"], r["pos"]) for r in reads.flagged_variants(stats).collect()} == {("s", 15), ("s", 55)}
    genes = reads.pairs_by_gene(stats, spark.createDataFrame([(15, "a"), (55, "a"), (100, "b")], "pos long, gene string"))
    assert [(r["gene"], r["n_variants"], r["cov"], round(r["bad_pairs"], 6), r["long_pairs"]) for r in genes.collect()] == [("a", 2, 7, round(1 / 7, 6), 0.5)]


def test_wide_rows_come_in_stretches(spark, tmp_path):
    rng = random.Random(11)
    places = {rng.randrange(10_000): rng.choice("ACGT") for _ in range(70)}
    cells = [(r, p, "X") for r in ("a", "b") for p in places if rng.random() < 0.2]
    frame = spark.createDataFrame(cells, "row string, place long, value string")
    lines = consequence.wide_rows(frame, spark.createDataFrame(list(places.items()), "place long, value string"), spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "row string"), "row", "place", 16)
    got = {(r["row"], r["block"]): r["line"] for r in lines.collect()}
    whole = {r: "".join("X" if (r, p, "X") in cells else places[p] for p in sorted(places)) for r in "abc"}
    assert got == {(r, i): t[16 * i : 16 * i + 16] for r, t in whole.items() for i in range(-(-len(places) // 16))}
    sinks.write_alignment(lines, f"{tmp_path}/a", "row")
    parts = "".join(p.read_text() for p in sorted((tmp_path / "a").glob("part-*")))
    assert parts == "".join(f">{r}\n" + "".join(t[i : i + 16] + "\n" for i in range(0, len(t), 16)) for r, t in whole.items())
    assert consequence.wide_rows(frame.limit(0), frame.select("place", "value").limit(0), frame, "row", "place").isEmpty()


def test_list_splits_equal_plain_counts(spark):
    rng = random.Random(12)
    weights = {f"s{i:03d}": rng.randint(1, 50) for i in range(53)}
    got = {r["k"]: tuple(r)[1:] for r in features.list_splits(spark.createDataFrame(list(weights.items()), "k string, w long"), "k", "w", 7, 8, 5).collect()}
    names, total = sorted(weights), sum(weights.values())
    tile = [t for t in range(7) for _ in range(53 // 7 + (t < 53 % 7))]
    assert got == {k: (tile[i] + 1, i // 8, sum(weights[x] for x in names[:i]) * 5 // total) for i, k in enumerate(names)}
    few = features.list_splits(spark.createDataFrame([("a", 1), ("b", 2)], "k string, w long"), "k", "w", 7, 8, 5)
    assert sorted((r["k"], r["tile"]) for r in few.collect()) == [("a", 1), ("b", 2)]


def test_gene_repair_on_both_strands(spark):
    """Plus: CATGAAATAAG, the gene one or two bases too long or short; minus: the same read backwards."""
    plus = "CATGAAATAAGC"
    ref = plus + plus[::-1].translate(str.maketrans("ACGT", "TGCA"))
    n = len(ref) + 1
    genes = [("long", 2, 11, 1), ("short", 2, 9, 1), ("whole", 2, 10, 1), ("none", 2, 8, 1), ("back_long", n - 11, n - 2, -1), ("back_short", n - 9, n - 2, -1)]
    frame = spark.createDataFrame(genes, "name string, start_pos long, end_pos long, strand int")
    got = {r["name"]: (r["fixed_start"], r["fixed_end"]) for r in consequence.repaired_genes(frame, consequence.reference_chunks(spark.createDataFrame([(ref,)], "seq string"))).collect()}
    assert got == {"long": (2, 10), "short": (2, 10), "none": (2, 10), "back_long": (n - 10, n - 2), "back_short": (n - 10, n - 2)}


def test_dictionary_coverage_and_totals(spark):
    entries = spark.createDataFrame([("x", "a:1", "a"), ("x", "a:2", "a"), ("x", "b:1", "b"), ("x", "c:1", "c"), ("x", "d:1", "d"), ("y", "d:9", "d")], "drug string, feature string, gene string")
    observed = spark.createDataFrame([(1, "a:1", "a"), (2, "a:1", "a"), (2, "a:7", "a"), (1, "c:5", "c"), (3, None, "q")], "sample_id int, feature string, gene string")
    broken = spark.createDataFrame([(1, "b"), (1, "a")], "sample_id int, gene string")
    got = {(r["drug"], r["feature"]): (r["hit"], r["n"]) for r in features.dictionary_coverage(entries, observed, broken).collect()}
    assert got == {("x", "a:1"): ("point", 2), ("x", "a:2"): ("broken", 0), ("x", "b:1"): ("broken", 0), ("x", "c:1"): ("changed", 0), ("x", "d:1"): ("missing", 0), ("y", "d:9"): ("missing", 0)}
    assert {r["hit"] for r in features.dictionary_coverage(entries, observed).collect()} == {"point", "changed", "missing"}
    assert sorted(map(tuple, features.dictionary_totals(entries, observed).collect())) == [("x", 5, 1, 2), ("y", 1, 0, 0)]


def test_site_coverage_has_every_sample_and_site(spark):
    rng = random.Random(6)
    rows = {(s * 7, p): rng.randrange(20) for s in range(150) for p in range(12) if rng.random() < 0.3} | {(0, 99): 5}
    depth = spark.createDataFrame([(*k, d) for k, d in rows.items()], "sample_id long, pos long, depth long")
    sites = spark.createDataFrame([(p,) for p in [*range(10), 3, 50]], "pos long")
    got = quality.site_coverage(depth, sites, 10).collect()
    want = sorted((s, p, int(rows.get((s, p), 0) >= 10)) for s in {s for s, _ in rows} for p in [*range(10), 50])
    assert sorted((r["sample_id"], r["pos"], r["covered"]) for r in got) == want
    assert quality.site_coverage(depth.where("false"), sites, 10).count() == 0

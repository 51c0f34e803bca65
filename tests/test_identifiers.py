"""Resolution of identifiers against plain versions."""

import random

from cladeworks.operators import identifiers as idn


def test_chain_first_known_key_decides(spark):
    table = spark.createDataFrame([("e1;e2", "S1", 2), ("e1", "S0", 5), ("e3", "NA", 1), ("e3", "S3", 4), ("-", "S9", 0)], "run string, id string, row long")
    runs = idn.first_ids(table, "run", "id", "row")
    assert sorted(map(tuple, runs.collect())) == [("e1", "S1"), ("e3", "S3")]
    libs = spark.createDataFrame([("l1", "S7")], "name string, id string")
    rows = spark.createDataFrame([(1, "S5", "e1", "l1"), (2, "NA", "e1;e9", "l1"), (3, "NA", "e8", "l1"), (4, " ", "-", "l1"), (5, None, None, "l2"), (6, "-", "NA", "")], "k int, own string, run string, lib string")
    got = idn.resolve_chain(rows, "own", [("run", runs), ("lib", libs)])
    assert got.columns == ["k", "own", "run", "lib", "id", "via"]
    assert {r["k"]: (r["id"], r["via"]) for r in got.collect()} == {1: ("S5", "own"), 2: ("S1", "run"), 3: (None, "run"), 4: ("S7", "lib"), 5: (None, "lib"), 6: (None, None)}


def test_names_in_lines_equal_plain_search(spark):
    rng = random.Random(6)
    lines = ["".join(rng.choice("ab.") for _ in range(rng.randint(0, 30))) for _ in range(120)] + ["x" * 5000 + "needle.1", "", "é" * 9]
    names = ["".join(rng.choice("ab.") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["needle.", "nowhere", "", "éé", "a.b(", "xxxxxxx"]
    got = idn.names_in_lines(spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), spark.createDataFrame([(i, t) for i, t in enumerate(lines)] + [(999, None)], "row_idx long, line string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(n, i) for n in names for i, t in enumerate(lines) if n and n in t}
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_standard_names_report(spark):
    names = ["SAMEA1", "r1", "r2", "r3", "r4", "r5", "gone", "old"]
    lines = [(0, "r3,lib", "SAMEA1"), (1, "xx r1.fq", "S1"), (2, "r1 r2", "S2"), (3, "r4", "S2"), (4, "r5", None)]
    got = idn.standard_names(spark.createDataFrame([(n,) for n in names + ["r1", None]], "name string"), spark.createDataFrame(lines, "row_idx long, line string, id string"), spark.createDataFrame([("old",)], "name string"), "^SAM")
    assert {tuple(r) for r in got.collect()} == {("SAMEA1", "SAMEA1", "kept"), ("old", "old", "excluded"), ("r1", "S1", "renamed"), ("r2", "S2", "renamed"), ("r3", "SAMEA1", "repeat"), ("r4", "S2", "repeat"), ("r5", None, "renamed"), ("gone", None, "unmatched")}


def test_listed_members(spark):
    groups = spark.createDataFrame([(1, "a;b;c"), (2, "a"), (3, "x;y"), (4, "b; a ;b"), (5, None)], "grp int, members string")
    got = idn.listed_members(groups, spark.createDataFrame([("a",), ("c",), (None,)], "id string"))
    assert sorted(map(tuple, got.collect())) == [(1, "a", False), (1, "b", False), (1, "c", True), (4, "a", True), (4, "b", False), (4, "b", False)]

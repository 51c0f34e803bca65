"""Trees as edge tables ``(child, parent, dist)``; the root has a null parent.

What lies below or above a node comes from pointer jumping with one row for each node: in round k a node points to its
ancestor 2^k steps up, holds what lies fewer than 2^k steps below it (or above it), and takes over what the nodes
2^k steps away hold. A tree of depth d takes log2(d) rounds, a chain of 100,000 nodes 17; no round has more rows than
the tree has nodes. Each round is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.functions import sequence as sq
from cladeworks.operators.features import encode
from cladeworks.operators.genome import Chunks, with_bases
from cladeworks.operators.intervals import points_in_intervals
from cladeworks.operators.islands import merge_adjacent
from cladeworks.plans.lineage import discard, materialise


def _links(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("up"))


def _next(state: DataFrame, by: list[str], carry: list[str]) -> DataFrame:
    """``state`` with ``_up`` and ``_<carry>`` of the node that a row points to; rows that point nowhere keep to their own key."""
    ahead = state.where("up is not null").select(*by, F.col("node").alias("_via"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in carry])
    return state.withColumn("_via", F.coalesce("up", "node")).join(ahead, [*by, "_via"], "left").drop("_via")


def fold(links: DataFrame, own: DataFrame, how: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """``(*by, node, *how)``: what the nodes of each subtree have together, itself included.

    ``links (*by, node, up)`` has every node once, ``own (*by, node, *how)`` the values that nodes start with. ``how`` is ``sum``, ``min`` or
    ``max`` of the values, or ``least`` or ``most`` of a number of steps that grows by one for each edge. A sum of nothing is 0, the others null.
    """
    by = by or []
    key = [*by, "node"]
    start = [F.coalesce(c, F.lit(0).cast("long")).alias(c) if h == "sum" else F.col(c) for c, h in how.items()]
    state, step = materialise(links.join(own, key, "left").select(*key, "up", *start)), 1
    pick = {"sum": F.sum, "min": F.min, "least": F.min, "max": F.max, "most": F.max}
    while not state.where("up is not null").isEmpty():
        more = lambda c, h: pick[h](c) + step if h in ("least", "most") else pick[h](c)
        below = state.where("up is not null").groupBy(*by, F.col("up").alias("node")).agg(*[more(c, h).alias(f"_{c}") for c, h in how.items()])
        joined = _next(state, by, []).join(below, key, "left")
        both = lambda c, h: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) if h == "sum" else (F.least if h in ("min", "least") else F.greatest)(c, f"_{c}")
        after = materialise(joined.select(*key, F.col("_up").alias("up"), *[both(c, h).alias(c) for c, h in how.items()]))
        discard(state)
        state, step = after, 2 * step
    return state.select(*key, *how)


def climb(links: DataFrame, add: str) -> DataFrame:
    """``(node, up, add)``: the nearest node above that is marked, or null, and the sum of ``add`` over the nodes up to it.

    ``links (node, up, stop, add)``: ``stop`` is true where ``up`` is marked or null.
    """
    state = materialise(links.select("node", "up", "stop", add))
    while not state.where("not stop").isEmpty():
        ahead = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("stop").alias("_stop"), F.col(add).alias("_add"))
        moved = state.where("not stop").join(ahead, "up").select("node", F.col("_up").alias("up"), F.col("_stop").alias("stop"), (F.col(add) + F.col("_add")).alias(add))
        after = materialise(state.where("stop").union(moved))
        discard(state)
        state = after
    return state.select("node", "up", add)


def numbered(edges: DataFrame) -> DataFrame:
    """``(node, enter, exit)``: nodes in depth-first order from 0, children by id; the subtree of a node is [enter, exit]."""
    links = _links(edges)
    sizes = fold(links, links.select("node", F.lit(1).cast("long").alias("size")), {"size": "sum"})
    before = F.sum("size").over(Window.partitionBy("up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    offset = F.coalesce(before, F.lit(0)) + F.when(F.col("up").isNull(), 0).otherwise(1)
    placed = links.join(sizes, "node").select("node", "up", "size", offset.cast("long").alias("enter"))
    sums = climb(placed.withColumn("stop", F.col("up").isNull()), "enter")
    return sums.select("node", "enter").join(sizes, "node").select("node", "enter", (F.col("enter") + F.col("size") - 1).alias("exit"))


def leaves(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node")).join(edges.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")


def edge_bases(edges: DataFrame, bases: DataFrame) -> DataFrame:
    """``(child, parent, pos, old, new)`` at every site where both ends of an edge have a base."""
    c = edges.where("parent is not null").select("child", "parent").join(bases.select(F.col("node").alias("child"), "pos", F.col("base").alias("new")), "child")
    return c.join(bases.select(F.col("node").alias("parent"), "pos", F.col("base").alias("old")), ["parent", "pos"]).select("child", "parent", "pos", "old", "new")


def edge_changes(edges: DataFrame, bases: DataFrame) -> DataFrame:
    """``(child, parent, pos, old, new)`` where the base of a child differs from its parent's."""
    return edge_bases(edges, bases).where("old <> new")


def codon_low() -> Column:
    """The lowest position of the codon that holds ``pos`` in a gene ``(start_pos, end_pos, strand)``."""
    return F.when(F.col("strand") == 1, sq.anchor(F.col("pos"), F.col("start_pos"))).otherwise(F.col("pos") - 2 + F.pmod(F.col("end_pos") - F.col("pos"), F.lit(3)))


def edge_mutations(edges: DataFrame, bases: DataFrame, genes: DataFrame, chunks: Chunks) -> DataFrame:
    """``(child, parent, pos, old, new, syn)``: the changes on each edge, those of one codon as one change of its amino acid.

    ``genes (pos, gene, start_pos, end_pos, strand)`` has the sites in coding genes. From the first changed site of a codon on, sites
    take the bases of parent and child, changed or not; the other bases come from the reference. ``pos`` is then the lowest position
    of the codon, and ``syn`` is true if the amino acid stays. Changes outside genes keep position and bases; codons beyond the
    reference go.
    """
    rows = edge_bases(edges, bases).join(genes.select("pos", "gene", "strand", codon_low().alias("at")), "pos", "left").withColumn("at", F.coalesce("at", "pos"))
    pick = lambda i: F.max(F.when(F.col("pos") - F.col("at") == i, F.struct("old", "new"))).alias(f"s{i}")
    codons = rows.groupBy("child", "parent", "gene", "strand", "at").agg(*[pick(i) for i in range(3)])
    begun = F.lit(False)
    for i in range(3):
        begun = begun | F.coalesce(F.col(f"s{i}.old") != F.col(f"s{i}.new"), F.lit(False))
        codons = codons.withColumn(f"s{i}", F.when(begun, F.col(f"s{i}")))
    changed = codons.where(F.coalesce("s0", "s1", "s2").isNotNull())
    outside = changed.where("gene is null").select("child", "parent", F.col("at").alias("pos"), "s0.old", "s0.new", F.lit(False).alias("syn"))
    inside = with_bases(changed.where("gene is not null"), F.col("at"), F.lit(3), chunks, "ref")
    codon = lambda end: F.concat(*[F.coalesce(f"s{i}.{end}", F.substring("ref", i + 1, 1)) for i in range(3)])
    acid = lambda end: sq.amino_acid(F.when(F.col("strand") == 1, codon(end)).otherwise(sq.reverse_complement(codon(end)))).alias(end)
    inside = inside.select("child", "parent", F.col("at").alias("pos"), acid("old"), acid("new"))
    return inside.withColumn("syn", F.col("old") == F.col("new")).union(outside)


def mutation_lists(mutations: DataFrame, edges: DataFrame) -> DataFrame:
    """``(child, parent, dist, syn, nonsyn)``: per edge the lists of the positions of its silent changes and of its other changes as old-position-new."""
    name = F.when(F.col("syn"), F.col("pos").cast("string")).otherwise(F.concat("old", F.col("pos").cast("string"), "new"))
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("syn") == kind, F.struct("pos", name.alias("m")))))
    lists = mutations.groupBy("child").agg(listed(True).alias("s"), listed(False).alias("n"))
    names = lambda c: F.coalesce(F.transform(c, lambda x: x["m"]), F.array().cast("array<string>"))
    return edges.where("parent is not null").join(lists, "child", "left").select("child", "parent", "dist", names("s").alias("syn"), names("n").alias("nonsyn"))


def state_changes(edges: DataFrame, states: DataFrame) -> DataFrame:
    """``(child, parent, old, new, change)``: change as S3R form, null where the state stays."""
    c = edges.where("parent is not null").join(states.select(F.col("node").alias("child"), F.col("state").alias("new")), "child")
    c = c.join(states.select(F.col("node").alias("parent"), F.col("state").alias("old")), "parent")
    return c.select("child", "parent", "old", "new", F.when(F.col("old") != F.col("new"), F.concat("old", F.lit("1"), "new")).alias("change"))


def prune(edges: DataFrame, keep: DataFrame, preserve_length: bool = False) -> DataFrame:
    """The tree of the leaves in ``keep (node)``: other leaves dropped, nodes with one branch contracted.

    A node stays if it is a kept leaf or has two or more child branches with
    kept leaves. ``preserve_length`` adds up the lengths of contracted edges;
    otherwise an edge keeps the length of its lower part.
    """
    tips = leaves(edges).join(keep, "node", "left_semi")
    live = materialise(fold(_links(edges), tips.select("node", F.lit(1).cast("long").alias("n")), {"n": "sum"}).where("n > 0").join(edges.withColumnRenamed("child", "node"), "node").select("node", "parent", "dist"))
    branching = live.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    stay = materialise(tips.union(branching).distinct())
    marked = live.join(stay.select(F.col("node").alias("parent"), F.lit(True).alias("stays")), "parent", "left")
    ways = climb(marked.select("node", F.col("parent").alias("up"), (F.col("parent").isNull() | F.coalesce("stays", F.lit(False))).alias("stop"), F.col("dist").alias("far")), "far")
    rows = stay.join(ways, "node").join(live.select("node", "dist"), "node")
    length = F.when(F.col("up").isNull(), F.col("dist")).otherwise(F.col("far")) if preserve_length else F.col("dist")
    return rows.select(F.col("node").alias("child"), F.col("up").alias("parent"), length.alias("dist"))


def depth_to_tip(edges: DataFrame) -> DataFrame:
    """``(node, low, high)``: fewest and most steps from an inner node to a leaf below it."""
    zero = F.lit(0).cast("long")
    found = fold(_links(edges), leaves(edges).select("node", zero.alias("low"), zero.alias("high")), {"low": "least", "high": "most"})
    return found.where("high > 0")


def character_paths(edges: DataFrame, carriers: DataFrame) -> DataFrame:
    """``(pos, node, low, high)``: fewest and most steps from a node that carries a character down to where it ends.

    ``carriers (pos, node)``: only nodes that carry a character are listed. A path goes from carrier to carrying child; it ends at a carrier
    none of whose children carries the character.
    """
    own = carriers.select("pos", "node").distinct()
    linked = own.join(_links(edges), "node").join(own.select("pos", F.col("node").alias("up"), F.lit(True).alias("both")), ["pos", "up"], "left")
    links = materialise(linked.select("pos", "node", F.when(F.col("both"), F.col("up")).alias("up")))
    inner = links.where("up is not null").select("pos", F.col("up").alias("node")).distinct()
    zero = F.lit(0).cast("long")
    ends = links.join(inner, ["pos", "node"], "left_anti").select("pos", "node", zero.alias("low"), zero.alias("high"))
    return fold(links, ends, {"low": "least", "high": "most"}, ["pos"])


def subtree_counts(edges: DataFrame, states: DataFrame) -> DataFrame:
    """``(node, n_leaves, n_resistant)`` over the leaves with a state below each inner node."""
    tips = leaves(edges).join(states, "node").groupBy("node").agg(F.count(F.lit(1)).alias("n_leaves"), F.count(F.when(F.col("state") == "R", 1)).alias("n_resistant"))
    inner = edges.select(F.col("parent").alias("node")).where("node is not null").distinct()
    return fold(_links(edges), tips, {"n_leaves": "sum", "n_resistant": "sum"}).where("n_leaves > 0").join(inner, "node", "left_semi")


def _deepest(edges: DataFrame, places: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(grp, lca)``: the deepest node whose subtree holds all numbers ``lo`` to ``hi`` of a group.

    From the node at ``lo`` a group jumps up by falling powers of two as long as it stays below its answer.
    """
    levels = [materialise(_links(edges))]
    while not levels[-1].where("up is not null").isEmpty():
        levels.append(materialise(_next(levels[-1], [], []).select("node", F.col("_up").alias("up"))))
    at = ranges.join(places.select(F.col("enter").alias("lo"), "node", "exit"), "lo").select("grp", "hi", "node", (F.col("exit") >= F.col("hi")).alias("found"))
    ends = places.select(F.col("node").alias("up"), F.col("exit").alias("end"))
    for level in reversed(levels):
        ahead = level.where("up is not null").join(ends, "up").select("node", F.col("up").alias("above"), "end")
        jump = ~F.col("found") & (F.col("end") < F.col("hi"))
        at = at.join(ahead, "node", "left").select("grp", "hi", F.when(jump, F.col("above")).otherwise(F.col("node")).alias("node"), "found")
    above = at.join(_links(edges), "node").select("grp", F.when(F.col("found"), F.col("node")).otherwise(F.col("up")).alias("lca"))
    return above.where("lca is not null")


def last_common_ancestor(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``(grp, lca)`` of ``groups (grp, node)``: the deepest node that is an ancestor of, or is, every member; a group without one has no row."""
    places = materialise(numbered(edges))
    ranges = groups.join(places, "node").groupBy("grp").agg(F.min("enter").alias("lo"), F.max("enter").alias("hi"))
    return _deepest(edges, places, ranges)


def clade_features(edges: DataFrame, posterior: DataFrame, other: DataFrame, least: float = 0.5) -> DataFrame:
    """``(node, lca)``: for nodes whose ``posterior`` is above ``least``, the last common ancestor in another tree of the leaves below them.

    Leaves that the other tree lacks don't count; a node without any has no row. The leaves of a feature are those of its subtree there.
    """
    places = materialise(numbered(other))
    tips = leaves(edges).join(places, "node").select("node", F.col("enter").alias("lo"), F.col("enter").alias("hi"))
    ranges = fold(_links(edges), tips, {"lo": "min", "hi": "max"}).where("lo is not null")
    chosen = posterior.where(F.col("posterior") > least).select("node").distinct()
    return _deepest(other, places, ranges.join(chosen, "node", "left_semi").withColumnRenamed("node", "grp")).withColumnRenamed("grp", "node")


def members(edges: DataFrame, clades: DataFrame) -> DataFrame:
    """``(node, leaf)``: the leaves of each subtree in ``clades (node)``, a row of the membership matrix each."""
    places = materialise(numbered(edges))
    tips = leaves(edges).join(places, "node").select(F.col("node").alias("leaf"), F.col("enter").alias("pos"))
    return points_in_intervals(tips, clades.join(places, "node").select("node", "enter", "exit"), "pos", "enter", "exit").select("node", "leaf")


def association(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(*by, mut, n_pos, n_neg, share)`` from an edge table ``(*by, child, change, nonsyn)``: edges with a mutation that also change state, and those that do not.

    A mutation is named by its place: the letters before and behind it go, codes of indels stay.
    """
    by = by or []
    rows = edges.select(*by, F.explode("nonsyn").alias("m"), F.col("change").isNotNull().cast("long").alias("hit"))
    place = F.when(F.col("m").rlike("^[0-9]"), F.col("m")).otherwise(F.expr("substring(m, 2, length(m) - 2)"))
    t = rows.groupBy(*by, place.alias("mut")).agg(F.sum("hit").alias("n_pos"), F.sum(1 - F.col("hit")).alias("n_neg"))
    return t.withColumn("share", F.round(F.col("n_pos") / (F.col("n_pos") + F.col("n_neg")), 6))


def drug_codes(states: DataFrame) -> DataFrame:
    """``(drug, code)``: drugs numbered from 1 in the order of their names, whatever order their tables come in."""
    return encode(states.select(F.col("drug").alias("feature"))).select(F.col("feature").alias("drug"), (F.col("code") + 1).alias("code"))


def drug_changes(edges: DataFrame, states: DataFrame, codes: DataFrame, resistant: bool = False, susceptible: bool = False) -> DataFrame:
    """``(child, parent, changes)``: for each edge the list of ``<old><code><new>`` of the drugs ``(node, drug, state)`` that change on it, by code.

    With ``resistant`` (``susceptible``) drugs that stay R (S) are listed too. A drug counts where both ends have a state; edges without any have
    an empty list.
    """
    ways = edges.where("parent is not null").select("child", "parent")
    rows = ways.join(states.select(F.col("node").alias("child"), "drug", F.col("state").alias("new")), "child").join(states.select(F.col("node").alias("parent"), "drug", F.col("state").alias("old")), ["parent", "drug"])
    stays = (F.lit(resistant) & (F.col("new") == "R")) | (F.lit(susceptible) & (F.col("new") == "S"))
    rows = rows.where((F.col("old") != F.col("new")) | stays).join(codes, "drug")
    listed = rows.groupBy("child").agg(F.array_sort(F.collect_list(F.struct("code", F.concat("old", F.col("code").cast("string"), "new").alias("c")))).alias("l"))
    return ways.join(listed, "child", "left").select("child", "parent", F.coalesce(F.transform("l", lambda x: x["c"]), F.array().cast("array<string>")).alias("changes"))


def state_vectors(states: DataFrame, codes: DataFrame) -> DataFrame:
    """``(node, vector)``: a 1 for each drug that a node resists, else a 0, in the order of the codes; a drug without a state is a 0."""
    held = states.join(codes, "drug").groupBy("node").agg(F.collect_set(F.when(F.col("state") == "R", F.col("code"))).alias("has"))
    every = codes.agg(F.coalesce(F.max("code"), F.lit(0))).scalar()
    return held.withColumn("last", every).select("node", F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("last")), lambda c: F.array_contains("has", c).cast("int").cast("string")), "").alias("vector"))


def most_likely(probabilities: DataFrame) -> DataFrame:
    """``(node, pos, base, prob)``: the likeliest base of each node at each position; ties to the smaller letter."""
    best = F.min(F.struct((-F.col("prob")).alias("p"), "base")).alias("b")
    return probabilities.groupBy("node", "pos").agg(best).select("node", "pos", "b.base", (-F.col("b.p")).alias("prob"))


def two_states(probabilities: DataFrame) -> DataFrame:
    """``probabilities`` with ``state``: 0 where p0 is above p1, else 1."""
    return probabilities.withColumn("state", F.when(F.col("p0") > F.col("p1"), 0).otherwise(1))


def indel_keys(calls: DataFrame) -> DataFrame:
    """``(sample_id, key)``: runs of deleted bases as ``del_<pos>_<length>``, insertions as ``ins_<pos>_<bases>``."""
    gone = merge_adjacent(calls.where("vtype = 'del'"), ["sample_id"]).select("sample_id", F.concat_ws("_", F.lit("del"), F.col("start_pos").cast("string"), F.col("length").cast("string")).alias("key"))
    return gone.union(calls.where("vtype = 'ins'").select("sample_id", F.concat_ws("_", F.lit("ins"), F.col("pos").cast("string"), "alt")).distinct())


def indel_codes(indels: DataFrame, length: Column) -> DataFrame:
    """``(key, code)``: indels ``(key)`` numbered in their order from the first place beyond the reference."""
    return encode(indels.select(F.col("key").alias("feature"))).select(F.col("feature").alias("key"), (length + F.col("code") + 1).alias("code"))


def indel_changes(edges: DataFrame, carriers: DataFrame, codes: DataFrame) -> DataFrame:
    """``(child, parent, pos, old, new, syn)`` as ``edge_mutations``, for indels ``(node, key)`` that only one end of an edge has: their code alone."""
    ways = edges.where("parent is not null").select("child", "parent")
    has = carriers.select("node", "key").distinct()
    both = lambda here, there: ways.join(has.withColumnRenamed("node", here), here).join(has.withColumnRenamed("node", there), [there, "key"], "left_anti")
    rows = both("child", "parent").select("child", "parent", "key").union(both("parent", "child").select("child", "parent", "key"))
    return rows.join(codes, "key").select("child", "parent", F.col("code").alias("pos"), F.lit("").alias("old"), F.lit("").alias("new"), F.lit(False).alias("syn"))


def site_codes(positions: DataFrame, genes: DataFrame) -> DataFrame:
    """``(code)``: distinct positions as edge tables name them, the lowest of the codon inside coding genes ``(pos, start_pos, end_pos, strand)``."""
    return positions.select("pos").distinct().join(genes.select("pos", codon_low().alias("low")), "pos", "left").select(F.coalesce("low", "pos").alias("code")).distinct()


def column_entropy(bases: DataFrame) -> DataFrame:
    """``(pos, entropy)`` in nats of the bases of each alignment column."""
    c = bases.groupBy("pos", "base").agg(F.count(F.lit(1)).alias("n"))
    total = bases.groupBy("pos").agg(F.count(F.lit(1)).alias("t"))
    p = F.col("n") / F.col("t")
    return c.join(total, "pos").groupBy("pos").agg(F.round(-F.sum(p * F.log(p)), 6).alias("entropy"))


def entropy_by_kind(bases: DataFrame, edges: DataFrame) -> DataFrame:
    """``(kind, n_pos, entropy)``: the mean column entropy of the measured sequences (leaves) and of the reconstructed ones (inner nodes)."""
    kinds = edges.select(F.col("child").alias("node")).join(leaves(edges).withColumn("kind", F.lit("measured")), "node", "left").select("node", F.coalesce("kind", F.lit("reconstructed")).alias("kind"))
    rows = bases.join(kinds, "node")
    c = rows.groupBy("kind", "pos", "base").agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("kind", "pos").agg(F.count(F.lit(1)).alias("t"))
    p = F.col("n") / F.col("t")
    each = c.join(total, ["kind", "pos"]).groupBy("kind", "pos").agg((-F.sum(p * F.log(p))).alias("e"))
    return each.groupBy("kind").agg(F.count(F.lit(1)).alias("n_pos"), F.round(F.avg("e"), 6).alias("entropy"))


def discordance(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(first, second, n)``: nodes ``(node, state)`` of two reconstructions by their two states; a node that one lacks has a null there."""
    both = first.select("node", F.col("state").alias("first")).join(second.select("node", F.col("state").alias("second")), "node", "full")
    return both.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))


def state_conflicts(edges: DataFrame, states: DataFrame) -> DataFrame:
    """``(parent, conflict)``: parents whose children all have the other state (1 over 0,0 or 0 over 1,1)."""
    c = edges.where("parent is not null").join(states.select(F.col("node").alias("child"), (F.col("state") == "R").cast("int").alias("s")), "child")
    kids = c.groupBy("parent").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.count(F.lit(1)).alias("n"))
    own = kids.where("n > 1 and low = high").join(states.select(F.col("node").alias("parent"), (F.col("state") == "R").cast("int").alias("own")), "parent").where("own <> low")
    return own.select("parent", F.concat("own", F.lit("->"), "low").alias("conflict"))

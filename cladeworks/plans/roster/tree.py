"""Tree queries."""

from pyspark.sql import functions as F

from cladeworks.functions import sequence as sq
from cladeworks.operators import consequence as co
from cladeworks.operators import features as fe
from cladeworks.operators import genome as gn
from cladeworks.operators import intervals as iv
from cladeworks.operators import tree as tr
from cladeworks.plans.lineage import materialise
from cladeworks.plans.registry import query
from cladeworks.plans.roster.consequence import _ROWS, _aa, _rc

_ANC = "RECURSIVE a AS (SELECT child AS node, parent AS ancestor, CAST(1 AS BIGINT) AS steps FROM b_tree WHERE parent IS NOT NULL UNION ALL SELECT a.node, t.parent, steps + 1 FROM a JOIN b_tree t ON t.child = a.ancestor WHERE t.parent IS NOT NULL)"
_TIPS = "tips AS (SELECT child AS node FROM b_tree WHERE child NOT IN (SELECT parent FROM b_tree WHERE parent IS NOT NULL))"
_CH = "ch AS (SELECT t.child, t.parent, c.pos, p.base AS old, c.base AS new FROM b_tree t JOIN b_bases c ON c.node = t.child JOIN b_bases p ON p.node = t.parent AND p.pos = c.pos WHERE c.base <> p.base)"
_MU = """sh AS (SELECT t.child, t.parent, c.pos, p.base AS old, c.base AS new FROM b_tree t JOIN {0} c ON c.node = t.child JOIN {0} p ON p.node = t.parent AND p.pos = c.pos),
 lo AS (SELECT pos, arg_max(name, start_pos) AS gene FROM (SELECT DISTINCT pos FROM {0}) JOIN b_feat ON pos BETWEEN start_pos AND end_pos GROUP BY pos),
 ge AS (SELECT pos, gene, strand, CASE WHEN strand = 1 THEN pos - (pos - start_pos) % 3 ELSE pos - 2 + (end_pos - pos) % 3 END AS cs FROM lo JOIN b_feat ON name = gene WHERE ftype = 'Gene'),
 fi AS (SELECT child, gene, cs, min(pos) AS since FROM sh JOIN ge USING (pos) WHERE old <> new GROUP BY child, gene, cs),
 sl AS (SELECT child, parent, cs, strand, max(old) FILTER (pos = cs) o0, max(old) FILTER (pos = cs + 1) o1, max(old) FILTER (pos = cs + 2) o2,
  max(new) FILTER (pos = cs) n0, max(new) FILTER (pos = cs + 1) n1, max(new) FILTER (pos = cs + 2) n2 FROM sh JOIN ge USING (pos) JOIN fi USING (child, gene, cs) WHERE pos >= since GROUP BY child, parent, gene, cs, strand),
 re AS (SELECT sl.*, substring(seq, cs, 1) r0, substring(seq, cs + 1, 1) r1, substring(seq, cs + 2, 1) r2 FROM sl CROSS JOIN b_ref WHERE cs >= 1 AND cs + 2 <= length(seq)),
 cd AS (SELECT child, parent, cs, strand, coalesce(o0, r0) || coalesce(o1, r1) || coalesce(o2, r2) AS oc, coalesce(n0, r0) || coalesce(n1, r1) || coalesce(n2, r2) AS nc FROM re),
 mu AS (SELECT child, parent, cs AS pos, """ + _aa(f"CASE WHEN strand = 1 THEN oc ELSE {_rc('oc')} END") + " AS old, " + _aa(f"CASE WHEN strand = 1 THEN nc ELSE {_rc('nc')} END") + """ AS new, TRUE AS coding FROM cd
  UNION ALL SELECT child, parent, pos, old, new, FALSE FROM sh WHERE old <> new AND pos NOT IN (SELECT pos FROM ge))"""
_LIST = """SELECT t.child, t.parent, t.dist, coalesce(string_agg(CAST(u.pos AS VARCHAR), ';' ORDER BY u.pos) FILTER (coding AND old = new), '') AS syn,
 coalesce(string_agg(old || u.pos || new, ';' ORDER BY u.pos, old || u.pos || new) FILTER (NOT coding OR old <> new), '') AS nonsyn FROM b_tree t LEFT JOIN {} u ON u.child = t.child WHERE t.parent IS NOT NULL GROUP BY t.child, t.parent, t.dist"""


def _mutations(edges, bases, feat, ref):
    own = feat.where("ftype = 'Gene'").select(F.col("name").alias("gene"), "start_pos", "end_pos", "strand")
    genes = iv.last_feature(bases, feat).select("pos", F.col("name").alias("gene")).join(own, "gene")
    return tr.edge_mutations(edges, bases, genes, co.reference_chunks(ref))


@query("edge_list", "b_tree", "SELECT child, parent, dist, parent IS NULL AS is_root FROM b_tree")
def _(edges):
    return edges.select("child", "parent", "dist", F.col("parent").isNull().alias("is_root"))


def _joined(lists):
    """Edge rows with their lists as text."""
    return lists.withColumns({c: F.array_join(c, ";") for c in ("syn", "nonsyn")})


@query("edge_mutations", "b_tree b_bases b_feat b_ref", f"WITH {_MU.format('b_bases')} " + _LIST.format("mu"))
def _(edges, bases, feat, ref):
    return _joined(tr.mutation_lists(_mutations(edges, bases, feat, ref), edges))


_IN = """ix AS (SELECT key, (SELECT length(seq) FROM b_ref) + row_number() OVER (ORDER BY key) AS code FROM (SELECT DISTINCT key FROM b_indels)),
 iw AS (SELECT child, parent, key FROM b_tree JOIN b_indels ON node = child ANTI JOIN (SELECT node AS parent, key FROM b_indels) USING (parent, key) WHERE parent IS NOT NULL
  UNION ALL SELECT child, parent, key FROM b_tree JOIN b_indels ON node = parent ANTI JOIN (SELECT node AS child, key FROM b_indels) USING (child, key)),
 u0 AS (SELECT * FROM mu UNION ALL SELECT child, parent, code, '', '', FALSE FROM iw JOIN ix USING (key))"""


def _with_indels(edges, bases, feat, ref, indels):
    codes = tr.indel_codes(indels, gn.reference_length(ref))
    return _mutations(edges, bases, feat, ref).union(tr.indel_changes(edges, indels, codes))


@query("edge_mutations_indel", "b_tree b_bases b_feat b_ref b_indels", f"WITH {_MU.format('b_bases')}, {_IN} " + _LIST.format("u0"))
def _(edges, bases, feat, ref, indels):
    return _joined(tr.mutation_lists(_with_indels(edges, bases, feat, ref, indels), edges))


@query("edge_mutations_target", "b_tree b_bases b_feat b_ref b_calls", f"WITH tg AS (SELECT * FROM b_bases WHERE pos IN (SELECT pos FROM b_calls)), {_MU.format('tg')} " + _LIST.format("mu"))
def _(edges, bases, feat, ref, calls):
    return _joined(tr.mutation_lists(_mutations(edges, bases.join(calls.select("pos").distinct(), "pos", "left_semi").select("node", "pos", "base"), feat, ref), edges))


@query("edge_genes", "b_tree b_bases b_feat", f"""
WITH {_CH} SELECT child, string_agg(DISTINCT name, ';' ORDER BY name) AS genes FROM ch JOIN b_feat ON pos BETWEEN start_pos AND end_pos GROUP BY child""")
def _(edges, bases, feat):
    changes = tr.edge_changes(edges, bases)
    at = iv.points_in_intervals(changes.select("pos").distinct(), feat).select("pos", "name")
    genes = changes.join(at, "pos").groupBy("child").agg(F.array_sort(F.collect_set("name")).alias("g"))
    return genes.select("child", F.array_join("g", ";").alias("genes"))


_ST = "st AS (SELECT t.child, t.parent, p.state AS old, c.state AS new, CASE WHEN p.state <> c.state THEN p.state || '1' || c.state END AS change FROM b_tree t JOIN b_state c ON c.node = t.child JOIN b_state p ON p.node = t.parent)"


@query("edge_pheno_change", "b_tree b_state", f"WITH {_ST} SELECT child, parent, old, new, change FROM st")
def _(edges, states):
    return tr.state_changes(edges, states)


@query("edge_syn", "b_tree b_bases b_feat b_ref", f"WITH {_MU.format('b_bases')} SELECT child, count(*) AS n_syn, string_agg(CAST(pos AS VARCHAR), ';' ORDER BY pos) AS syn FROM mu WHERE coding AND old = new GROUP BY child")
def _(edges, bases, feat, ref):
    silent = _mutations(edges, bases, feat, ref).where("syn").groupBy("child").agg(F.count(F.lit(1)).alias("n_syn"), F.array_sort(F.collect_list("pos")).alias("p"))
    return silent.select("child", "n_syn", F.array_join(F.col("p").cast("array<string>"), ";").alias("syn"))


@query("prune_tree", "b_tree b_state", f"""
WITH {_ANC}, {_TIPS}, k AS (SELECT node FROM tips WHERE node IN (SELECT node FROM b_state WHERE state = 'R')), live AS (SELECT node FROM k UNION SELECT ancestor FROM a WHERE node IN (SELECT node FROM k)),
br AS (SELECT parent AS node FROM b_tree WHERE child IN (SELECT node FROM live) AND parent IS NOT NULL GROUP BY parent HAVING count(*) > 1), stay AS (SELECT node FROM k UNION SELECT node FROM br),
near AS (SELECT a.node, arg_min(ancestor, steps) AS parent, min(steps) AS steps FROM a JOIN stay ON stay.node = a.node WHERE ancestor IN (SELECT node FROM stay) GROUP BY a.node),
more AS (SELECT n.node, sum(t.dist) AS m FROM near n JOIN a ON a.node = n.node AND a.steps < n.steps JOIN b_tree t ON t.child = a.ancestor GROUP BY n.node)
SELECT stay.node AS child, near.parent, CAST(dist + coalesce(m, 0) AS BIGINT) AS dist FROM stay LEFT JOIN near USING (node) LEFT JOIN more USING (node) JOIN b_tree ON child = stay.node""")
def _(edges, states):
    return tr.prune(edges, states.where("state = 'R'").select("node"), preserve_length=True)


@query("node_names", "b_tree", "SELECT parent AS node, string_agg(CAST(child AS VARCHAR), '_' ORDER BY child) AS name FROM b_tree WHERE parent IS NOT NULL GROUP BY parent")
def _(edges):
    kids = edges.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.array_sort(F.collect_list("child")).alias("k"))
    return kids.select("node", F.array_join("k", "_").alias("name"))


@query("character_matrix", "b_bases b_state", f"WITH cells AS (SELECT node, 0 AS split, pos AS p, base FROM b_bases), {_ROWS} SELECT node, state, block, row FROM r JOIN b_state USING (node)")
def _(bases, states):
    return co.site_rows(bases, ["node"]).join(states, "node").select("node", "state", "block", "row")


@query("subtree_counts", "b_tree b_state", f"WITH {_ANC}, {_TIPS} SELECT ancestor AS node, count(*) AS n_leaves, count(*) FILTER (state = 'R') AS n_resistant FROM a JOIN tips USING (node) JOIN b_state USING (node) GROUP BY ancestor")
def _(edges, states):
    return tr.subtree_counts(edges, states)


@query("clade_features", "b_tree customer", f"""
WITH {_ANC}, g AS (SELECT c_nationkey AS grp, CAST(c_custkey AS BIGINT) AS node FROM customer), u AS (SELECT grp, node, node AS anc FROM g UNION SELECT grp, g.node, ancestor FROM g JOIN a USING (node)),
s AS (SELECT grp, anc, count(*) c FROM u GROUP BY ALL), n AS (SELECT grp, count(*) n FROM g GROUP BY grp), d AS (SELECT node, max(steps) d FROM a GROUP BY node)
SELECT grp, arg_max(anc, coalesce(d, 0)) AS lca FROM s JOIN n USING (grp) LEFT JOIN d ON d.node = anc WHERE c = n GROUP BY grp""")
def _(edges, customer):
    groups = customer.select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").cast("long").alias("node"))
    return tr.last_common_ancestor(groups, edges)


@query("depth_to_tip", "b_tree", f"WITH {_ANC}, {_TIPS} SELECT ancestor AS node, min(steps) AS low, max(steps) AS high FROM a WHERE node IN (SELECT node FROM tips) GROUP BY ancestor")
def _(edges):
    return tr.depth_to_tip(edges)


_ANC3 = "b AS (SELECT node, parent AS ancestor, CAST(1 AS BIGINT) AS steps FROM o WHERE parent IS NOT NULL UNION ALL SELECT b.node, o.parent, steps + 1 FROM b JOIN o ON o.node = b.ancestor WHERE o.parent IS NOT NULL)"


@query("clade_transfer", "b_tree customer", f"""
WITH {_ANC}, {_TIPS}, o AS (SELECT child AS node, CASE WHEN child = 0 THEN NULL ELSE (child - 1) // 3 END AS parent FROM b_tree), {_ANC3},
g AS (SELECT CAST(c_custkey AS BIGINT) AS grp FROM customer WHERE c_acctbal > 4000), m AS (SELECT ancestor AS grp, node FROM a JOIN tips USING (node) UNION ALL SELECT node, node FROM tips),
u AS (SELECT grp, node, node AS anc FROM m JOIN g USING (grp) UNION ALL SELECT grp, m.node, b.ancestor FROM m JOIN g USING (grp) JOIN b ON b.node = m.node),
s AS (SELECT grp, anc, count(*) c FROM u GROUP BY ALL), n AS (SELECT grp, count(*) n FROM m GROUP BY grp), d AS (SELECT node, max(steps) d FROM b GROUP BY node),
l AS (SELECT grp, arg_max(anc, coalesce(d, 0)) AS lca FROM s JOIN n USING (grp) LEFT JOIN d ON d.node = anc WHERE c = n GROUP BY grp),
t AS (SELECT node AS leaf FROM o WHERE node NOT IN (SELECT parent FROM o WHERE parent IS NOT NULL))
SELECT grp AS node, lca, count(*) AS n_leaves FROM l JOIN (SELECT ancestor AS lca, node AS leaf FROM b UNION ALL SELECT leaf, leaf FROM t) USING (lca) JOIN t USING (leaf) GROUP BY grp, lca""")
def _(edges, customer):
    other = edges.select("child", F.when(F.col("child") > 0, F.floor((F.col("child") - 1) / 3)).alias("parent"), "dist")
    posterior = customer.select(F.col("c_custkey").cast("long").alias("node"), (F.col("c_acctbal") / 8000).alias("posterior"))
    found = materialise(tr.clade_features(edges, posterior, other))
    leaf = tr.members(other, found.select(F.col("lca").alias("node")).distinct()).groupBy("node").agg(F.count(F.lit(1)).alias("n_leaves"))
    return found.join(leaf.withColumnRenamed("node", "lca"), "lca").select("node", "lca", "n_leaves")


@query("character_paths", "b_tree b_bases", f"""
WITH {_ANC}, {_TIPS}, w AS (SELECT pos, node FROM b_bases WHERE base = 'G'), l AS (SELECT w.pos, w.node, t.parent FROM w JOIN b_tree t ON t.child = w.node JOIN w p ON p.node = t.parent AND p.pos = w.pos),
k AS (SELECT pos, node AS top, node, CAST(0 AS BIGINT) AS steps FROM w UNION ALL SELECT k.pos, top, l.node, steps + 1 FROM k JOIN l ON l.pos = k.pos AND l.parent = k.node),
e AS (SELECT pos, node FROM w ANTI JOIN (SELECT pos, parent AS node FROM l) USING (pos, node)), q AS (SELECT k.pos, top AS node, min(steps) AS low, max(steps) AS high FROM k JOIN e ON e.pos = k.pos AND e.node = k.node GROUP BY ALL),
h AS (SELECT ancestor AS node, min(steps) AS tip_low, max(steps) AS tip_high FROM a JOIN tips USING (node) GROUP BY ancestor)
SELECT pos, node, low, high, coalesce(tip_low, 0) AS tip_low, coalesce(tip_high, 0) AS tip_high FROM q LEFT JOIN h USING (node)""")
def _(edges, bases):
    tips = tr.depth_to_tip(edges).select("node", F.col("low").alias("tip_low"), F.col("high").alias("tip_high"))
    paths = tr.character_paths(edges, bases.where("base = 'G'").select("pos", "node"))
    return paths.join(tips, "node", "left").fillna(0, ["tip_low", "tip_high"]).select("pos", "node", "low", "high", "tip_low", "tip_high")


@query("node_classes", "b_tree b_bases b_state", f"""
WITH {_CH}, {_ST}, m AS (SELECT child, max(CASE WHEN new = 'G' THEN 2 WHEN old = 'G' THEN 1 ELSE 0 END) AS g FROM ch GROUP BY child)
SELECT st.child, CASE g WHEN 2 THEN 'gain' WHEN 1 THEN 'loss' WHEN 0 THEN 'other' ELSE 'none' END AS mutation, CASE WHEN change IS NULL THEN 'same' ELSE change END AS pheno FROM st LEFT JOIN m ON m.child = st.child""")
def _(edges, bases, states):
    kind = F.max(F.when(F.col("new") == "G", 2).when(F.col("old") == "G", 1).otherwise(0)).alias("g")
    m = tr.edge_changes(edges, bases).groupBy("child").agg(kind)
    name = F.when(F.col("g") == 2, "gain").when(F.col("g") == 1, "loss").when(F.col("g") == 0, "other").otherwise("none")
    return tr.state_changes(edges, states).join(m, "child", "left").select("child", name.alias("mutation"), F.coalesce("change", F.lit("same")).alias("pheno"))


@query("leaves", "b_tree", f"WITH {_TIPS} SELECT node FROM tips")
def _(edges):
    return tr.leaves(edges)


_KEYS = """kd AS (SELECT sample_id, min(pos) AS p, count(*) AS n FROM (SELECT sample_id, pos, pos - row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS run FROM (SELECT DISTINCT sample_id, pos FROM b_calls WHERE vtype = 'del')) GROUP BY sample_id, run),
 ky AS (SELECT sample_id, 'del_' || p || '_' || n AS key FROM kd UNION SELECT sample_id, 'ins_' || pos || '_' || alt FROM b_calls WHERE vtype = 'ins')"""


@query("indel_keys", "b_calls", f"WITH {_KEYS} SELECT sample_id, key FROM ky")
def _(calls):
    return tr.indel_keys(calls)


@query("site_recode", "b_calls b_feat b_ref", f"""
WITH {_KEYS}, lo AS (SELECT pos, arg_max(name, start_pos) AS gene FROM (SELECT DISTINCT pos FROM b_calls) JOIN b_feat ON pos BETWEEN start_pos AND end_pos GROUP BY pos),
 s AS (SELECT DISTINCT pos FROM b_calls WHERE vtype = 'snp'), g AS (SELECT pos, CASE WHEN strand = 1 THEN pos - (pos - start_pos) % 3 ELSE pos - 2 + (end_pos - pos) % 3 END AS low FROM lo JOIN b_feat ON name = gene WHERE ftype = 'Gene'),
 x AS (SELECT key, (SELECT length(seq) FROM b_ref) + row_number() OVER (ORDER BY key) AS code FROM (SELECT DISTINCT key FROM ky))
SELECT DISTINCT coalesce(low, pos) AS code, CAST(NULL AS VARCHAR) AS key FROM s LEFT JOIN g USING (pos) UNION ALL SELECT code, key FROM x WHERE key IN (SELECT key FROM ky WHERE sample_id % 2 = 0)""")
def _(calls, feat, ref):
    located = iv.last_feature(calls, feat).select("pos", "name").join(feat.where("ftype = 'Gene'").select("name", "start_pos", "end_pos", "strand"), "name")
    sites = tr.site_codes(calls.where("vtype = 'snp'"), located).select("code", F.lit(None).cast("string").alias("key"))
    keys = materialise(tr.indel_keys(calls))
    present = keys.where("sample_id % 2 = 0").select("key").distinct()  # the samples of interest
    return sites.union(tr.indel_codes(keys, gn.reference_length(ref)).join(present, "key", "left_semi").select("code", "key"))


_PROB = "SELECT CAST(o_custkey AS BIGINT) AS node, CAST(l_suppkey*2+1 AS BIGINT) AS pos, substring('ACGT', CAST(1 + l_partkey % 4 AS INT), 1) AS base, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS prob FROM {} JOIN {} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey, l_partkey % 4"


@query("state_argmax", "lineitem orders", f"WITH n AS ({_PROB.format('lineitem', 'orders')}) SELECT node, pos, arg_min(base, (-prob, base)) AS base, max(prob) AS prob FROM n GROUP BY node, pos")
def _(lineitem, orders):
    return tr.most_likely(orders.sparkSession.sql(_PROB.format("{l}", "{o}"), l=lineitem, o=orders))


@query("two_state_ancestors", "customer", "SELECT CAST(c_custkey AS BIGINT) AS node, CASE WHEN floor(abs(c_acctbal) / 1000) > c_nationkey % 10 THEN 0 ELSE 1 END AS state FROM customer")
def _(customer):
    rows = customer.select(F.col("c_custkey").cast("long").alias("node"), F.floor(F.abs("c_acctbal") / 1000).alias("p0"), (F.col("c_nationkey") % 10).alias("p1"))
    return tr.two_states(rows).select("node", "state")


def _edge_table(edges, bases, feat, ref, states, indels):
    """Rows as an edge-table file has them: lists of mutations, indel codes among them, and the change of state."""
    lists = tr.mutation_lists(_with_indels(edges, bases, feat, ref, indels), edges)
    return lists.join(tr.state_changes(edges, states).select("child", "change"), "child")


@query("edge_association", "b_tree b_bases b_feat b_ref b_state b_indels", f"""
WITH {_MU.format('b_bases')}, {_IN}, {_ST}, h AS (SELECT CAST(pos AS VARCHAR) AS mut, child FROM u0 WHERE NOT coding OR old <> new)
SELECT mut, count(*) FILTER (change IS NOT NULL) AS n_pos, count(*) FILTER (change IS NULL) AS n_neg, round(count(*) FILTER (change IS NOT NULL) / count(*), 6) AS share FROM h JOIN st USING (child) GROUP BY mut""")
def _(edges, bases, feat, ref, states, indels):
    return tr.association(_edge_table(edges, bases, feat, ref, states, indels))


_SV = """dc AS (SELECT drug, row_number() OVER (ORDER BY drug) AS code FROM (SELECT DISTINCT drug FROM b_drug_state))"""


@query("drug_codes", "b_drug_state", f"WITH {_SV} SELECT drug, code FROM dc")
def _(states):
    return tr.drug_codes(states)


def _drug_changes_sql(rr, ss):
    also = " OR c.state = 'R'" * rr + " OR c.state = 'S'" * ss
    return f"""WITH {_SV}, x AS (SELECT t.child, code, p.state || code || c.state AS c FROM b_tree t JOIN b_drug_state c ON c.node = t.child JOIN b_drug_state p ON p.node = t.parent AND p.drug = c.drug JOIN dc ON dc.drug = c.drug WHERE p.state <> c.state{also})
SELECT t.child, t.parent, coalesce(string_agg(c, ';' ORDER BY code), '') AS changes FROM b_tree t LEFT JOIN x ON x.child = t.child WHERE t.parent IS NOT NULL GROUP BY t.child, t.parent"""


@query("edge_drug_changes", "b_tree b_drug_state", _drug_changes_sql(False, False))
def _(edges, states):
    return tr.drug_changes(edges, states, tr.drug_codes(states)).withColumn("changes", F.array_join("changes", ";"))


@query("edge_drug_states", "b_tree b_drug_state", _drug_changes_sql(True, True))
def _(edges, states):
    return tr.drug_changes(edges, states, tr.drug_codes(states), resistant=True, susceptible=True).withColumn("changes", F.array_join("changes", ";"))


@query("state_vectors", "b_drug_state", f"WITH {_SV}, n AS (SELECT DISTINCT node FROM b_drug_state) SELECT n.node, string_agg(CASE WHEN s.state = 'R' THEN '1' ELSE '0' END, '' ORDER BY code) AS vector FROM n CROSS JOIN dc LEFT JOIN b_drug_state s ON s.node = n.node AND s.drug = dc.drug GROUP BY n.node")
def _(states):
    return tr.state_vectors(states, tr.drug_codes(states))


@query("column_entropy", "b_bases", """
WITH n AS (SELECT pos, base, count(*) AS n, sum(count(*)) OVER (PARTITION BY pos) AS t FROM b_bases GROUP BY pos, base) SELECT pos, round(-sum(n / t * ln(n / t)), 6) AS entropy FROM n GROUP BY pos""")
def _(bases):
    return tr.column_entropy(bases)


@query("entropy_by_kind", "b_bases b_tree", f"""
WITH {_TIPS}, k AS (SELECT child AS node, CASE WHEN child IN (SELECT node FROM tips) THEN 'measured' ELSE 'reconstructed' END AS kind FROM b_tree), n AS (SELECT kind, pos, base, count(*) AS n, sum(count(*)) OVER (PARTITION BY kind, pos) AS t FROM b_bases JOIN k USING (node) GROUP BY kind, pos, base),
e AS (SELECT kind, pos, -sum(n / t * ln(n / t)) AS e FROM n GROUP BY kind, pos) SELECT kind, count(*) AS n_pos, round(avg(e), 6) AS entropy FROM e GROUP BY kind""")
def _(bases, edges):
    return tr.entropy_by_kind(bases, edges)


@query("reconstruction_discordance", "b_state b_drug_state", """
SELECT a.state AS first, b.state AS second, count(*) AS n FROM b_state a FULL JOIN (SELECT * FROM b_drug_state WHERE drug = 'PZA') b ON a.node = b.node GROUP BY a.state, b.state""")
def _(states, others):
    return tr.discordance(states, others.where("drug = 'PZA'"))


@query("distance_to_root", "b_bases b_tree", "SELECT b.node, count(*) FILTER (b.base <> r.base) AS n_diff FROM b_bases b JOIN b_bases r USING (pos) WHERE r.node IN (SELECT child FROM b_tree WHERE parent IS NULL) GROUP BY b.node")
def _(bases, edges):
    root = bases.join(edges.where("parent is null").select(F.col("child").alias("node")), "node", "left_semi").select("pos", F.col("base").alias("root"))
    return bases.join(root, "pos").groupBy("node").agg(F.count(F.when(F.col("base") != F.col("root"), 1)).alias("n_diff"))


@query("state_conflicts", "b_tree b_state", """
WITH c AS (SELECT parent, min(CAST(state = 'R' AS INT)) lo, max(CAST(state = 'R' AS INT)) hi, count(*) n FROM b_tree JOIN b_state ON node = child WHERE parent IS NOT NULL GROUP BY parent)
SELECT parent, concat(CAST(state = 'R' AS INT), '->', lo) AS conflict FROM c JOIN b_state ON node = parent WHERE n > 1 AND lo = hi AND CAST(state = 'R' AS INT) <> lo""")
def _(edges, states):
    return tr.state_conflicts(edges, states)


@query("state_discordance", "b_state b_tree", f"WITH {_ST} SELECT old, new, count(*) AS n, round(avg(dist), 6) AS mean_dist FROM st JOIN b_tree USING (child) GROUP BY old, new")
def _(states, edges):
    rows = tr.state_changes(edges, states).join(edges.select("child", "dist"), "child")
    return rows.groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dist"), 6).alias("mean_dist"))


_D = ["click", "error", "purchase", "signup", "view"]


@query("node_drug_matrix", "b_tree b_pheno", "SELECT child AS node, " + ", ".join(f"coalesce(CAST(max(pheno) FILTER (drug = '{d}') AS VARCHAR), '-') AS \"{d}\"" for d in _D) + " FROM b_tree JOIN b_pheno ON sample_id = child GROUP BY child")
def _(edges, pheno):
    wide = pheno.groupBy("sample_id").pivot("drug", _D).agg(F.max("pheno"))
    return edges.join(wide, F.col("child") == F.col("sample_id")).select(F.col("child").alias("node"), *[F.coalesce(F.col(d).cast("string"), F.lit("-")).alias(d) for d in _D])

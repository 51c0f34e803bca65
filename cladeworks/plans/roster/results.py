"""Queries on association results, the interaction graph and reads."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cladeworks.operators import features as fe
from cladeworks.operators import graph as gr
from cladeworks.operators import intervals as iv
from cladeworks.operators import reads as rd
from cladeworks.plans.lineage import materialise
from cladeworks.plans.registry import query

# --- association results -------------------------------------------------


_SITES = "s AS (SELECT p_brand AS drug, p_partkey AS pos, (p_size - 1) / 400.0 AS p FROM part), mk AS (SELECT p_partkey AS pos FROM part WHERE p_type = 'ECONOMY')"


def _sites(part):
    sites = part.select(F.col("p_brand").alias("drug"), F.col("p_partkey").alias("pos"), ((F.col("p_size") - 1) / F.lit(400)).alias("p"))
    return sites, part.where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("pos"))


@query("fdr_cut", "part", f"""
WITH {_SITES}, n AS (SELECT *, count(*) OVER (PARTITION BY drug) AS n, count(*) OVER (PARTITION BY drug ORDER BY p) AS obs FROM s), c AS (SELECT drug, least(max(p), 0.05) AS cut FROM n WHERE n * p / obs < 0.1 GROUP BY drug)
SELECT drug, pos, round(CAST(p AS DOUBLE), 6) AS p FROM s JOIN c USING (drug) WHERE p <= cut AND pos NOT IN (SELECT pos FROM mk)""")
def _(part):
    sites, markers = _sites(part)
    # The curve has one row per distinct p of a drug, however many sites there are.
    curve = sites.groupBy("drug", "p").agg(F.count(F.lit(1)).alias("k"))
    up = Window.partitionBy("drug").orderBy("p")
    curve = curve.select("drug", "p", F.sum("k").over(up).alias("observed"), (F.sum("k").over(Window.partitionBy("drug")) * F.col("p")).alias("expected"))
    return gr.cut_sites(sites, gr.fdr_cuts(curve), markers).withColumn("p", F.round("p", 6))


@query("zero_p_sites", "part", f"WITH {_SITES} SELECT drug, pos FROM s WHERE p = 0 AND pos NOT IN (SELECT pos FROM mk)")
def _(part):
    return gr.zero_sites(*_sites(part)).select("drug", "pos")


@query("row_zip", "customer supplier", """
WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS code, c_custkey FROM customer), b AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS code, s_suppkey FROM supplier)
SELECT code, c_custkey, s_suppkey FROM a JOIN b USING (code)""")
def _(customer, supplier):
    a = fe.encode(customer.select(F.col("c_custkey").alias("feature"))).withColumnRenamed("feature", "c_custkey")
    b = fe.encode(supplier.select(F.col("s_suppkey").alias("feature"))).withColumnRenamed("feature", "s_suppkey")
    return a.join(b, "code").select("code", "c_custkey", "s_suppkey")


@query("known_lookup", "b_calls b_feat b_drug_gene", """
WITH l AS (SELECT pos, arg_max(name, start_pos) AS gene FROM (SELECT DISTINCT pos FROM b_calls) JOIN b_feat ON pos BETWEEN start_pos AND end_pos GROUP BY pos),
k AS (SELECT concat(gene, ':', CAST(p AS VARCHAR)) AS key, min(drug) AS drug FROM (SELECT *, unnest(range(locus * 10 + 1, locus * 10 + 9)) AS p FROM b_drug_gene) GROUP BY ALL), g AS (SELECT gene AS key, min(drug) AS drug FROM b_drug_gene WHERE drug <> 'EMB' GROUP BY gene)
SELECT v.pos, l.gene, v.indel, coalesce(CASE WHEN v.indel THEN g.drug ELSE k.drug END, 'miss') AS label FROM (SELECT DISTINCT pos, vtype <> 'snp' AS indel FROM b_calls) v JOIN l ON l.pos = v.pos LEFT JOIN k ON k.key = concat(l.gene, ':', CAST(v.pos AS VARCHAR)) LEFT JOIN g ON g.key = l.gene""")
def _(calls, feat, genes):
    at = iv.last_feature(calls, feat).select("pos", F.col("name").alias("gene"))
    sites = genes.select("gene", F.explode(F.sequence(F.col("locus") * 10 + 1, F.col("locus") * 10 + 8)).alias("pos"), F.col("drug").alias("label"))
    return gr.known_labels(calls.select("pos", (F.col("vtype") != "snp").alias("indel")).distinct().join(at, "pos"), sites, genes.where("drug <> 'EMB'").select("gene", F.col("drug").alias("label")))


@query("gene_annotation", "b_feat b_drug_gene", """
WITH k AS (SELECT gene, min(drug) AS drug FROM b_drug_gene GROUP BY gene), t AS (SELECT tag, min(drug) AS drug FROM b_drug_gene GROUP BY tag) SELECT name, coalesce(k.drug, t.drug) AS label FROM b_feat f LEFT JOIN k ON gene = name LEFT JOIN t ON t.tag = f.tag""")
def _(feat, genes):
    by_gene = genes.groupBy(F.col("gene").alias("name")).agg(F.min("drug").alias("d1"))
    by_tag = genes.groupBy("tag").agg(F.min("drug").alias("d2"))
    return feat.join(by_gene, "name", "left").join(by_tag, "tag", "left").select("name", F.coalesce("d1", "d2").alias("label"))


@query("result_union", "b_feat b_drug_gene", "SELECT 'feat' AS drug, name AS gene, tag, CAST(NULL AS BIGINT) AS locus FROM b_feat UNION ALL SELECT drug, gene, tag, locus FROM b_drug_gene")
def _(feat, genes):
    return feat.select(F.lit("feat").alias("drug"), F.col("name").alias("gene"), "tag").unionByName(genes, allowMissingColumns=True)


@query("presentation_unpack", "b_feat", """
WITH w AS (SELECT name, concat(start_pos, ';', end_pos, ';', strand) AS span, concat(ftype, ';', tag, ';', CAST(is_pseudogene AS INT)) AS kind FROM b_feat)
SELECT name, 'span' AS dictionary, split_part(span, ';', 1) AS a, split_part(span, ';', 2) AS b, split_part(span, ';', 3) AS c FROM w UNION ALL SELECT name, 'kind', split_part(kind, ';', 1), split_part(kind, ';', 2), split_part(kind, ';', 3) FROM w""")
def _(feat):
    wide = feat.select("name", F.concat_ws(";", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), F.col("strand").cast("string")).alias("span"), F.concat_ws(";", "ftype", "tag", F.col("is_pseudogene").cast("int").cast("string")).alias("kind"))
    cells = wide.unpivot("name", ["span", "kind"], "dictionary", "cell").withColumn("x", F.split("cell", ";"))
    return cells.select("name", "dictionary", *[F.get("x", i).alias(n) for i, n in enumerate("abc")])


@query("gene_set_by_drug", "b_drug_gene b_feat", "SELECT DISTINCT drug, gene FROM b_drug_gene WHERE gene NOT IN (SELECT name FROM b_feat WHERE ftype = 'rRNA')")
def _(genes, feat):
    rna = feat.where("ftype = 'rRNA'").select(F.col("name").alias("gene"))
    return genes.select("drug", "gene").distinct().join(rna, "gene", "left_anti").select("drug", "gene")


@query("broken_gene_freq", "b_calls b_feat", """
WITH l AS (SELECT pos, arg_max(name, start_pos) AS gene FROM (SELECT DISTINCT pos FROM b_calls) JOIN b_feat ON pos BETWEEN start_pos AND end_pos GROUP BY pos), b AS (SELECT gene, count(DISTINCT sample_id) AS n FROM b_calls JOIN l USING (pos) WHERE vtype <> 'snp' GROUP BY gene)
SELECT name, coalesce(n, 0) AS n_broken FROM b_feat LEFT JOIN b ON gene = name""")
def _(calls, feat):
    at = iv.last_feature(calls, feat).select("pos", "name")
    n = calls.where("vtype <> 'snp'").join(at, "pos").groupBy("name").agg(F.countDistinct("sample_id").alias("n"))
    return feat.select("name").join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n_broken"))


@query("tagged_gene_counts", "b_feat", "SELECT ftype, count(*) FILTER (regexp_matches(tag, '[13]$')) AS n_tagged, count(*) AS n FROM b_feat GROUP BY ftype")
def _(feat):
    return feat.groupBy("ftype").agg(F.count(F.when(F.col("tag").rlike("[13]$"), 1)).alias("n_tagged"), F.count(F.lit(1)).alias("n"))


@query("sorted_ratio", "b_calls", "SELECT vtype, alt, round(count(*) FILTER (cov >= 25) / count(*), 6) AS ratio FROM b_calls GROUP BY vtype, alt ORDER BY ratio DESC")
def _(calls):
    ratio = F.round(F.count(F.when(F.col("cov") >= 25, 1)) / F.count(F.lit(1)), 6)
    return calls.groupBy("vtype", "alt").agg(ratio.alias("ratio")).orderBy(F.desc("ratio"))


# --- interaction graph ---------------------------------------------------


def _members(genes):
    return genes.where("drug = 'INH'").select(F.col("locus").alias("node")).distinct()


_M = "m AS (SELECT DISTINCT locus AS node FROM b_drug_gene WHERE drug = 'INH')"


@query("neighbours", "b_edges b_drug_gene", f"WITH {_M} SELECT DISTINCT dst AS node FROM b_edges WHERE src IN (SELECT node FROM m) AND dst NOT IN (SELECT node FROM m)")
def _(edges, genes):
    return gr.neighbours(edges, _members(genes))


@query("induced_edges", "b_edges b_drug_gene", """
WITH g AS (SELECT DISTINCT drug AS grp, locus AS node FROM b_drug_gene) SELECT g.grp, count(e.src) AS n_edges FROM g JOIN g h ON g.grp = h.grp LEFT JOIN b_edges e ON e.src = g.node AND e.dst = h.node AND e.src < e.dst GROUP BY g.grp""")
def _(edges, genes):
    return gr.induced(edges, genes.select(F.col("drug").alias("grp"), F.col("locus").alias("node")))


@query("category_distance", "b_drug_gene b_feat", """
WITH u AS (SELECT tag, count(*) / sum(count(*)) OVER () AS q FROM b_feat GROUP BY tag), s AS (SELECT drug, count(*) n FROM b_drug_gene GROUP BY drug), c AS (SELECT drug, tag, count(*) c FROM b_drug_gene GROUP BY ALL)
SELECT s.drug AS grp, round(sum(power(coalesce(c, 0) / n - q, 2)), 6) AS distance FROM s CROSS JOIN u LEFT JOIN c ON c.drug = s.drug AND c.tag = u.tag GROUP BY s.drug""")
def _(genes, feat):
    return gr.category_distance(genes.select(F.col("drug").alias("grp"), F.col("tag").alias("category")), feat.select(F.col("tag").alias("category")))


@query("neighbour_overlap", "b_edges b_drug_gene", f"""
WITH {_M}, v AS (SELECT DISTINCT dst AS node FROM b_edges WHERE src IN (SELECT node FROM m) AND dst NOT IN (SELECT node FROM m)) SELECT drug, count(DISTINCT locus) AS n_shared FROM b_drug_gene JOIN v ON node = locus GROUP BY drug""")
def _(edges, genes):
    near = gr.neighbours(edges, _members(genes)).withColumnRenamed("node", "locus")
    return genes.join(near, "locus", "left_semi").groupBy("drug").agg(F.countDistinct("locus").alias("n_shared"))


PERMUTATIONS = 100


def _universe(part):
    return fe.encode(part.select(F.col("p_partkey").cast("long").alias("feature"))).select(F.col("feature").alias("node"), F.col("code").alias("idx"))


def _draws(seed, size):
    """CTEs that end in ``dr (grp, node)``, the draws of ``graph.draws``; ``size`` counts the drawn nodes."""
    return f"""un AS (SELECT CAST(p_partkey AS BIGINT) AS node, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part), sl AS (SELECT grp, unnest(range(({size}))) AS slot FROM range({PERMUTATIONS}) t(grp)),
 dr AS (SELECT grp, node FROM (SELECT grp, CAST('0x' || substr(md5('{seed}|' || grp || '|' || slot), 1, 12) AS BIGINT) % (SELECT count(*) FROM un) AS idx FROM sl) JOIN un USING (idx))"""


_REACHED = f"round(count(*) FILTER (v >= o) / {PERMUTATIONS}, 6) AS p_value"


@query("category_p_value", "b_drug_gene part", f"""
WITH {_draws('category', "SELECT count(*) FROM b_drug_gene WHERE drug = 'INH'")}, u AS (SELECT p_brand AS tag, count(*) / sum(count(*)) OVER () AS q FROM part GROUP BY tag),
 m AS (SELECT grp, p_brand AS tag FROM dr JOIN part ON p_partkey = node UNION ALL SELECT -1, tag FROM b_drug_gene WHERE drug = 'INH'), z AS (SELECT grp, count(*) AS n FROM m GROUP BY grp), c AS (SELECT grp, tag, count(*) AS c FROM m GROUP BY ALL),
 d AS (SELECT z.grp, round(sum(power(coalesce(c, 0) / n - q, 2)), 6) AS v FROM z CROSS JOIN u LEFT JOIN c ON c.grp = z.grp AND c.tag = u.tag GROUP BY z.grp) SELECT {_REACHED} FROM d, (SELECT v AS o FROM d WHERE grp = -1) WHERE grp >= 0""")
def _(genes, part):
    universe, own = _universe(part), genes.where("drug = 'INH'")
    tags = part.select(F.col("p_partkey").cast("long").alias("node"), F.col("p_brand").alias("category"))
    drawn = gr.draws(universe, universe.count(), own.count(), PERMUTATIONS, "category").join(tags, "node").select("grp", "category")
    real = gr.category_distance(own.select(F.lit(0).alias("grp"), F.col("tag").alias("category")), tags.select("category")).select("distance")
    return gr.p_value(gr.category_distance(drawn, tags.select("category")), "distance", real.scalar(), PERMUTATIONS)


@query("density_p_value", "b_edges b_drug_gene part", f"""
WITH {_M}, {_draws('density', 'SELECT count(*) FROM m')}, g AS (SELECT DISTINCT grp, node FROM dr UNION ALL SELECT -1, node FROM m),
 d AS (SELECT g.grp, count(e.src) AS v FROM g JOIN g h ON g.grp = h.grp LEFT JOIN b_edges e ON e.src = g.node AND e.dst = h.node AND e.src < e.dst GROUP BY g.grp) SELECT {_REACHED} FROM d, (SELECT v AS o FROM d WHERE grp = -1) WHERE grp >= 0""")
def _(edges, genes, part):
    universe, own = _universe(part), _members(genes)
    drawn = gr.draws(universe, universe.count(), own.count(), PERMUTATIONS, "density")
    both = materialise(gr.induced(edges, drawn.union(own.select(F.lit(-1).alias("grp"), "node"))))  # the real group beside the drawn ones: edges are read once
    real = both.where("grp = -1").select("n_edges")
    return gr.p_value(both.where("grp >= 0"), "n_edges", real.scalar(), PERMUTATIONS)


@query("overlap_p_value", "b_edges b_drug_gene part", f"""
WITH {_M}, r AS (SELECT DISTINCT locus AS node FROM b_drug_gene WHERE drug = 'RIF'), {_draws('overlap', 'SELECT count(*) FROM r')}, w AS (SELECT DISTINCT dst AS node FROM b_edges WHERE src IN (SELECT node FROM m) AND dst NOT IN (SELECT node FROM m)),
 d AS (SELECT grp, count(*) AS v FROM (SELECT DISTINCT grp, node FROM dr) JOIN w USING (node) GROUP BY grp) SELECT {_REACHED} FROM d, (SELECT count(*) AS o FROM r JOIN w USING (node))""")
def _(edges, genes, part):
    universe, own = _universe(part), genes.where("drug = 'RIF'").select(F.col("locus").alias("node")).distinct()
    near = gr.neighbours(edges, _members(genes))
    shared = lambda groups: groups.distinct().join(near, "node", "left_semi").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    real = shared(own.select(F.lit(0).alias("grp"), "node")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    return gr.p_value(shared(gr.draws(universe, universe.count(), own.count(), PERMUTATIONS, "overlap")), "n", real.scalar(), PERMUTATIONS)


# --- reads ---------------------------------------------------------------


@query("read_mapq_filter", "b_reads", "WITH s AS (SELECT sample_id, avg(mapq) - stddev_pop(mapq) AS low FROM b_reads GROUP BY sample_id) SELECT sample_id, qname, mate, mapq FROM b_reads JOIN s USING (sample_id) WHERE mapq >= low")
def _(reads):
    return rd.well_mapped(reads.select("sample_id", "qname", "mate", "mapq"), 1.0)


@query("read_interval_filter", "b_reads b_feat", """
SELECT qname, mate, start_pos, end_pos FROM b_reads r WHERE NOT EXISTS (SELECT 1 FROM b_feat f WHERE ftype = 'rRNA' AND (r.end_pos BETWEEN f.start_pos - 5 AND f.end_pos + 5))""")
def _(reads, feat):
    out = feat.where("ftype = 'rRNA'").select((F.col("start_pos") - 5).alias("x_start"), (F.col("end_pos") + 5).alias("x_end"))
    return iv.points_in_intervals(reads.select("qname", "mate", "start_pos", "end_pos"), out, "end_pos", "x_start", "x_end", how="left_anti")


_PAIRS = "i AS (SELECT a.sample_id, a.qname, greatest(a.end_pos, b.end_pos) - least(a.start_pos, b.start_pos) + 1 AS insert FROM b_reads a JOIN b_reads b ON a.sample_id = b.sample_id AND a.qname = b.qname AND a.mate = 0 AND b.mate = 1 WHERE a.is_proper AND b.is_proper)"


@query("mate_insert", "b_reads", f"WITH {_PAIRS} SELECT sample_id, count(*) AS n, round(avg(insert), 6) AS mean, round(stddev_pop(insert), 6) AS std FROM i GROUP BY sample_id")
def _(reads):
    return rd.mates(reads).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("insert"), 6).alias("mean"), F.round(F.stddev_pop("insert"), 6).alias("std"))


@query("read_pair_rollups", "b_reads b_feat", """
WITH h AS (SELECT sample_id, name, mapq, is_proper FROM b_reads JOIN b_feat ON b_feat.start_pos BETWEEN b_reads.start_pos AND b_reads.end_pos)
SELECT sample_id, name, grouping(sample_id) * 2 + grouping(name) AS level, count(*) AS n, round(avg(mapq), 6) AS mapq, round(avg(CAST(is_proper AS INT)), 6) AS proper FROM h GROUP BY GROUPING SETS ((sample_id, name), (sample_id), (name))""")
def _(reads, feat):
    marks = feat.select("name", F.col("start_pos").alias("pos"))
    hit = iv.points_in_intervals(marks, reads, "pos")
    level = (F.grouping("sample_id").cast("long") * 2 + F.grouping("name")).alias("level")
    rows = hit.groupingSets([["sample_id", "name"], ["sample_id"], ["name"]], "sample_id", "name")
    return rows.agg(level, F.count(F.lit(1)).alias("n"), F.round(F.avg("mapq"), 6).alias("mapq"), F.round(F.avg(F.col("is_proper").cast("int")), 6).alias("proper"))


@query("tagged_ttest", "b_calls b_feat", """
WITH n AS (SELECT name, tag, end_pos - start_pos + 1 AS len, count(pos) AS c FROM b_feat LEFT JOIN (SELECT DISTINCT pos FROM b_calls) ON pos BETWEEN start_pos AND end_pos GROUP BY ALL), d AS (SELECT contains(tag, '#1') AS g, c / len AS v FROM n),
s AS (SELECT count(*) FILTER (g) na, count(*) FILTER (NOT g) nb, avg(v) FILTER (g) ma, avg(v) FILTER (NOT g) mb, var_samp(v) FILTER (g) va, var_samp(v) FILTER (NOT g) vb FROM d)
SELECT na, nb, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 6) AS t FROM s""")
def _(calls, feat):
    hit = iv.points_in_intervals(calls.select("pos").distinct(), feat).groupBy("name").agg(F.count(F.lit(1)).alias("c"))
    rows = feat.join(hit, "name", "left").withColumn("v", F.coalesce("c", F.lit(0)) / (F.col("end_pos") - F.col("start_pos") + 1))
    return rd.pooled_t(rows, F.contains(F.col("tag"), F.lit("#1")), "v")


@query("read_histogram", "b_reads", "SELECT sample_id, CAST(floor(mapq / 10) AS INT) AS bin, count(*) AS n, round(avg(end_pos - start_pos + 1), 6) AS mean_length FROM b_reads GROUP BY ALL")
def _(reads):
    return reads.groupBy("sample_id", F.floor(F.col("mapq") / 10).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("end_pos") - F.col("start_pos") + 1), 6).alias("mean_length"))

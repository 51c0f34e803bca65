"""Consequence queries."""

from pyspark.sql import functions as F

from cladeworks.functions import sequence as sq
from cladeworks.functions import similarity as sm
from cladeworks.operators import annotation as an
from cladeworks.operators import consequence as co
from cladeworks.operators import features as fe
from cladeworks.operators import genome as gn
from cladeworks.operators import intervals as iv
from cladeworks.operators import islands
from cladeworks.plans.lineage import materialise
from cladeworks.plans.registry import query

_AA = f"substring('{sq.GENETIC_CODE}', CAST(16 * (instr('ACGT', substring(%s, 1, 1)) - 1) + 4 * (instr('ACGT', substring(%s, 2, 1)) - 1) + instr('ACGT', substring(%s, 3, 1)) AS BIGINT), 1)"
_aa = lambda x: _AA % (x, x, x)
_rc = lambda x: f"reverse(translate({x}, 'ACGT', 'TGCA'))"
_G = "l AS (SELECT pos, arg_max(name, start_pos) AS gene FROM (SELECT DISTINCT pos FROM b_calls) JOIN b_feat ON pos BETWEEN start_pos AND end_pos GROUP BY pos), c AS (SELECT sample_id, gene, start_pos, end_pos, strand, ftype, pos, alt, vtype FROM b_calls JOIN l USING (pos) JOIN b_feat ON name = gene)"
_C1 = _G + """, s AS (SELECT *, CASE WHEN strand = 1 THEN (pos - start_pos) // 3 + 1 ELSE (end_pos - pos) // 3 + 1 END AS aa_pos FROM c WHERE ftype = 'Gene' AND vtype = 'snp'),
 k AS (SELECT *, CASE WHEN strand = 1 THEN start_pos + 3 * (aa_pos - 1) ELSE end_pos - 3 * aa_pos + 1 END AS cs FROM s),
 m AS (SELECT sample_id, gene, strand, aa_pos, cs, max(alt) FILTER (pos = cs) a0, max(alt) FILTER (pos = cs + 1) a1, max(alt) FILTER (pos = cs + 2) a2 FROM k GROUP BY ALL),
 n AS (SELECT m.*, substring(seq, cs, 3) AS ref FROM m CROSS JOIN b_ref WHERE cs >= 1 AND cs + 2 <= length(seq)),
 o AS (SELECT *, concat(coalesce(a0, substring(ref, 1, 1)), coalesce(a1, substring(ref, 2, 1)), coalesce(a2, substring(ref, 3, 1))) AS new FROM n),
 q AS (SELECT sample_id, gene, aa_pos, """ + _aa(f"CASE WHEN strand = 1 THEN ref ELSE {_rc('ref')} END") + " AS aa_ref, " + _aa(f"CASE WHEN strand = 1 THEN new ELSE {_rc('new')} END") + " AS aa_alt FROM o), r AS (SELECT * FROM q WHERE aa_ref <> aa_alt)"


def _located(calls, feat):
    at = iv.last_feature(calls, feat).select("pos", F.col("name").alias("gene"), "start_pos")
    own = feat.select(F.col("name").alias("gene"), "start_pos", "end_pos", "strand", "ftype", "is_pseudogene").hint("merge")
    return calls.join(at, "pos").join(own, ["gene", "start_pos"]).select("sample_id", "gene", "start_pos", "end_pos", "strand", "ftype", "is_pseudogene", "pos", "alt", "vtype")


def _consequences(calls, feat, ref):
    return co.snp_consequences(_located(calls, feat).where("ftype = 'Gene' and vtype = 'snp'"), co.reference_chunks(ref))


@query("snp_consequence", "b_calls b_feat b_ref", f"WITH {_C1} SELECT sample_id, gene, aa_pos, aa_ref, aa_alt FROM r")
def _(calls, feat, ref):
    return _consequences(calls, feat, ref)


@query("early_stop", "b_calls b_feat b_ref", f"WITH {_C1} SELECT sample_id, gene, min(aa_pos) AS stop FROM r JOIN b_feat ON name = gene WHERE aa_alt = '*' AND aa_pos < 0.9 * ((end_pos - start_pos + 1) // 3) GROUP BY sample_id, gene")
def _(calls, feat, ref):
    lengths = feat.select(F.col("name").alias("gene"), F.floor((F.col("end_pos") - F.col("start_pos") + 1) / 3).alias("codons"))
    return co.early_stops(_consequences(calls, feat, ref), lengths)


@query("frameshift", "b_calls b_feat", f"WITH {_G}, t AS (SELECT sample_id, gene, sum(CASE vtype WHEN 'ins' THEN length(alt) WHEN 'del' THEN -1 ELSE 0 END) AS d FROM c WHERE ftype = 'Gene' GROUP BY sample_id, gene) SELECT sample_id, gene, CAST(((d % 3) + 3) % 3 AS BIGINT) AS shift FROM t WHERE d % 3 <> 0")
def _(calls, feat):
    return co.frameshifts(_located(calls, feat).where("ftype = 'Gene'"))


@query("coord_project", "b_calls b_feat", f"""
WITH {_G} SELECT DISTINCT gene, ftype, pos, CAST(CASE WHEN ftype = 'upstream' THEN CASE WHEN strand = 1 THEN pos - end_pos - 1 ELSE start_pos - pos - 1 END
 WHEN ftype = 'Gene' THEN CASE WHEN strand = 1 THEN (pos - start_pos) // 3 + 1 ELSE (end_pos - pos) // 3 + 1 END ELSE CASE WHEN strand = 1 THEN pos - start_pos + 1 ELSE end_pos - pos + 1 END END AS BIGINT) AS fpos FROM c""")
def _(calls, feat):
    f = sq.feature_position(*[F.col(c) for c in ("pos", "start_pos", "end_pos", "strand", "ftype")])
    return _located(calls, feat).select("gene", "ftype", "pos", f.cast("long").alias("fpos")).distinct()


@query("codon_to_pos", "b_feat", "SELECT name, c AS codon, CASE WHEN strand = 1 THEN start_pos + 3 * (c - 1) ELSE end_pos - 3 * c + 1 END AS pos FROM (SELECT *, unnest(range(1, (end_pos - start_pos + 1) // 3 + 1)) AS c FROM b_feat)")
def _(feat):
    n = F.floor((F.col("end_pos") - F.col("start_pos") + 1) / 3)
    rows = feat.where(n >= 1).select("*", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("codon"))
    return rows.select("name", "codon", sq.codon_start(*[F.col(c) for c in ("codon", "start_pos", "end_pos", "strand")]).alias("pos"))


@query("codon_anchor", "b_calls b_feat", "SELECT DISTINCT name, pos - (pos - start_pos) % 3 AS anchor FROM b_calls JOIN b_feat ON pos BETWEEN start_pos AND end_pos")
def _(calls, feat):
    hit = iv.points_in_intervals(calls.select("pos").distinct(), feat)
    return hit.select("name", sq.anchor(F.col("pos"), F.col("start_pos")).alias("anchor")).distinct()


@query("revcomp", "b_feat b_ref", f"SELECT name, {_rc('substring(seq, start_pos, end_pos - start_pos + 1)')} AS seq FROM b_feat CROSS JOIN b_ref WHERE strand = -1 AND end_pos <= length(seq)")
def _(feat, ref):
    rows = co.with_bases(feat.where("strand = -1"), F.col("start_pos"), F.col("end_pos") - F.col("start_pos") + 1, co.gene_chunks(ref), "bases")
    return rows.select("name", sq.reverse_complement(F.col("bases")).alias("seq"))


@query("translate", "b_feat b_ref", f"""
WITH g AS (SELECT name, CASE WHEN strand = 1 THEN x ELSE {_rc('x')} END AS x FROM (SELECT name, strand, substring(seq, start_pos, end_pos - start_pos + 1) AS x FROM b_feat CROSS JOIN b_ref WHERE ftype = 'Gene' AND end_pos <= length(seq)))
SELECT name, coalesce(array_to_string(list_transform(range(1, length(x) - 1, 3), lambda i: {_aa('substring(x, i, 3)')}), ''), '') AS protein FROM g""")
def _(feat, ref):
    rows = co.with_bases(feat.where("ftype = 'Gene'"), F.col("start_pos"), F.col("end_pos") - F.col("start_pos") + 1, co.gene_chunks(ref), "x")
    x = F.when(F.col("strand") == 1, F.col("x")).otherwise(sq.reverse_complement(F.col("x")))
    return rows.withColumn("x", x).select("name", sq.protein(F.col("x")).alias("protein"))


@query("noncoding_rows", "b_calls b_feat", f"""
WITH {_G}, d AS (SELECT DISTINCT sample_id, gene, start_pos, end_pos, strand, pos FROM c WHERE ftype <> 'Gene' AND vtype = 'del'),
r AS (SELECT sample_id, gene, start_pos, end_pos, strand, min(pos) AS p, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY sample_id, gene ORDER BY pos) AS g FROM d) GROUP BY sample_id, gene, start_pos, end_pos, strand, g)
SELECT sample_id, gene, CASE WHEN strand = 1 THEN p - start_pos + 1 ELSE end_pos - (p + n - 1) + 1 END AS fpos, 'del' AS vtype, repeat('-', n) AS alt FROM r
UNION ALL SELECT DISTINCT sample_id, gene, CASE WHEN strand = 1 THEN pos - start_pos + 1 ELSE end_pos - pos + 1 END, vtype, CASE WHEN strand = 1 THEN alt ELSE {_rc('alt')} END FROM c WHERE ftype <> 'Gene' AND vtype <> 'del'""")
def _(calls, feat):
    rows = _located(calls, feat).where("ftype <> 'Gene'")
    own = feat.select(F.col("name").alias("gene"), F.col("start_pos").alias("s"), F.col("end_pos").alias("e"), "strand")
    runs = islands.merge_adjacent(rows.where("vtype = 'del'"), ["sample_id", "gene"]).join(own, "gene")
    at = F.when(F.col("strand") == 1, F.col("start_pos") - F.col("s") + 1).otherwise(F.col("e") - (F.col("start_pos") + F.col("length") - 1) + 1)
    gone = runs.select("sample_id", "gene", at.alias("fpos"), F.lit("del").alias("vtype"), F.expr("repeat('-', cast(length as int))").alias("alt"))
    here = F.when(F.col("strand") == 1, F.col("pos") - F.col("start_pos") + 1).otherwise(F.col("end_pos") - F.col("pos") + 1)
    rest = rows.where("vtype <> 'del'").select("sample_id", "gene", here.alias("fpos"), "vtype", F.when(F.col("strand") == 1, F.col("alt")).otherwise(sq.reverse_complement(F.col("alt"))).alias("alt")).distinct()
    return gone.union(rest)


@query("complex_decompose", "part", """
WITH p AS (SELECT p_partkey AS key, concat(p_brand, p_type) AS ref, concat(p_brand, p_name) AS alt FROM part), s AS (SELECT *, len(list_filter(range(1, least(length(ref), length(alt)) + 1), lambda i: right(ref, i) = right(alt, i))) AS s FROM p),
t AS (SELECT key, left(ref, length(ref) - s) r, left(alt, length(alt) - s) a FROM s), u AS (SELECT *, len(list_filter(range(1, least(length(r), length(a)) + 1), lambda i: left(r, i) = left(a, i))) AS p FROM t),
v AS (SELECT key, p, substr(r, p + 1) r, substr(a, p + 1) a FROM u), w AS (SELECT *, least(length(r), length(a)) AS n FROM v)
SELECT key, CAST(p + i - 1 AS INT) AS off, substr(r, i, 1) AS ref, substr(a, i, 1) AS alt, 'snp' AS vtype FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM w) WHERE substr(r, i, 1) <> substr(a, i, 1)
UNION ALL SELECT key, CAST(p + i - 1 AS INT), substr(r, i, 1), '', 'del' FROM (SELECT *, unnest(range(n + 1, length(r) + 1)) AS i FROM w)
UNION ALL SELECT key, CAST(p + n AS INT), '', substr(a, n + 1), 'ins' FROM w WHERE length(a) > n""")
def _(part):
    return co.decompose(part.select(F.col("p_partkey").alias("key"), F.concat("p_brand", "p_type").alias("ref"), F.concat("p_brand", "p_name").alias("alt")))


def _indel_sql(source):
    """CTEs that end in ``ind (sample_id, gene, gpos, ref, alt, vtype)`` from the calls of a CTE: changes put in one by one, then proteins compared."""
    p = f"coalesce(array_to_string(list_transform(range(1, length({{0}}) - 1, 3), lambda i: {_aa('substring({0}, i, 3)')}), ''), '')"
    acids = lambda x: p.format(x)
    before = "CASE WHEN i = 1 THEN 0 ELSE e[i - 1].off - CASE WHEN e[i - 1].kind = 0 THEN 1 ELSE 0 END END"
    return f"""h AS (SELECT sample_id, gene, start_pos, end_pos, strand, list_sort(list_distinct(list({{'off': pos - start_pos + 1, 'kind': CASE vtype WHEN 'ins' THEN 0 WHEN 'snp' THEN 1 ELSE 2 END, 'alt': CASE vtype WHEN 'del' THEN '' ELSE alt END}}))) AS e
 FROM {source} GROUP BY sample_id, gene, start_pos, end_pos, strand HAVING bool_or(vtype <> 'snp')),
 hw AS (SELECT *, least(2, start_pos - 1) AS fl, end_pos - start_pos + 1 AS size, substring(seq, start_pos - least(2, start_pos - 1), end_pos - start_pos + 1 + least(2, start_pos - 1) + 2) AS w FROM h CROSS JOIN b_ref WHERE (end_pos - start_pos + 1) % 3 = 0),
 hk AS (SELECT sample_id, gene, strand, w, fl, size, substring(w, fl + 1, size) AS ref, list_filter(e, lambda z, i: z.kind = 0 OR i = len(e) OR e[i + 1].off <> z.off) AS e FROM hw WHERE length(w) >= fl + size),
 hs AS (SELECT *, array_to_string(list_transform(e, lambda z, i: substring(ref, {before} + 1, z.off - 1 - ({before})) || z.alt), '') || substring(ref, e[-1].off - CASE WHEN e[-1].kind = 0 THEN 1 ELSE 0 END + 1) AS s FROM hk),
 hf AS (SELECT sample_id, gene, CASE WHEN strand = 1 THEN ref ELSE {_rc('ref')} END AS ref, CASE WHEN strand = 1 THEN s || substring(w, fl + size + 1, f) ELSE {_rc("concat(right(left(w, fl), f), s)")} END AS s FROM (SELECT *, (3 - length(s) % 3) % 3 AS f FROM hs)),
 hp AS (SELECT sample_id, gene, {acids('ref')} AS old, {acids('s')} AS new FROM hf),
 hq AS (SELECT *, instr(new, '*') AS stop, least(nullif(instr(left(new, instr(new, '*')), left(old, 1)), 0), nullif(instr(left(new, instr(new, '*')), 'M'), 0)) AS start FROM hp),
 hr AS (SELECT sample_id, gene, start IS NULL OR 10 * (stop - start) < 9 * length(old) AS broken, left(old, length(old) - 1) AS old, substring(new, start, stop - start) AS new FROM hq),
 h1 AS (SELECT *, len(list_filter(range(1, least(length(old), length(new)) + 1), lambda i: right(old, i) = right(new, i))) AS s FROM hr WHERE NOT broken AND old <> new),
 h2 AS (SELECT sample_id, gene, left(old, length(old) - s) AS old, left(new, length(new) - s) AS new FROM h1), h3 AS (SELECT *, len(list_filter(range(1, least(length(old), length(new)) + 1), lambda i: left(old, i) = left(new, i))) AS p FROM h2),
 h4 AS (SELECT sample_id, gene, p, substring(old, p + 1) AS r, substring(new, p + 1) AS a, least(length(old), length(new)) - p AS n FROM h3),
 ind AS (SELECT sample_id, gene, CAST(NULL AS BIGINT) AS gpos, '-' AS ref, '-' AS alt, 'FS' AS vtype FROM hr WHERE broken
  UNION ALL SELECT sample_id, gene, p + i, substring(r, i, 1), substring(a, i, 1), 'snp' FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM h4) WHERE substring(r, i, 1) <> substring(a, i, 1)
  UNION ALL SELECT sample_id, gene, p + n + 1, substring(r, n + 1), '-', 'del' FROM h4 WHERE length(r) > n UNION ALL SELECT sample_id, gene, p + n + 1, '-', substring(a, n + 1), 'ins' FROM h4 WHERE length(a) > n)"""


@query("indel_consequence", "b_calls b_feat b_ref", f"WITH {_G}, cg AS (SELECT * FROM c WHERE ftype = 'Gene'), {_indel_sql('cg')} SELECT sample_id, gene, gpos, ref, alt, vtype FROM ind")
def _(calls, feat, ref):
    return an.indel_consequences(_located(calls, feat).where("ftype = 'Gene'"), ref)


_ROWS_SQL = _G.replace("strand, ftype, pos", "strand, ftype, is_pseudogene, pos") + f""", cg AS (SELECT * FROM c WHERE ftype = 'Gene' AND NOT is_pseudogene), sh AS (SELECT DISTINCT sample_id, gene FROM cg WHERE vtype <> 'snp'),
 {_C1[len(_G) + 2:].replace("FROM c WHERE ftype = 'Gene' AND vtype = 'snp'", "FROM cg ANTI JOIN sh USING (sample_id, gene)")},
 st AS (SELECT DISTINCT sample_id, gene FROM r JOIN b_feat ON name = gene WHERE aa_alt = '*' AND aa_pos < 0.9 * ((end_pos - start_pos + 1) // 3)), {_indel_sql('cg')},
 nc AS (SELECT DISTINCT sample_id, ftype, gene, start_pos, end_pos, strand, pos, alt, vtype FROM c WHERE ftype <> 'Gene' OR is_pseudogene
  UNION SELECT sample_id, 'non_cds', '-', 1, length(seq), -1, pos, alt, vtype FROM b_calls CROSS JOIN b_ref WHERE pos NOT IN (SELECT pos FROM l)),
 nb AS (SELECT nc.*, substring(seq, pos, 1) AS base FROM nc CROSS JOIN b_ref WHERE substring(seq, pos, 1) <> ''),
 nd AS (SELECT sample_id, ftype, gene, start_pos, end_pos, strand, min(pos) AS lo, max(pos) AS hi, string_agg(base, '' ORDER BY pos) AS base FROM (SELECT *, pos - row_number() OVER (PARTITION BY sample_id, ftype, gene ORDER BY pos) AS run FROM (SELECT DISTINCT sample_id, ftype, gene, start_pos, end_pos, strand, pos, base FROM nb WHERE vtype = 'del'))
  GROUP BY sample_id, ftype, gene, start_pos, end_pos, strand, run),
 nr AS (SELECT sample_id, ftype, gene, start_pos, end_pos, strand, CASE WHEN strand = 1 THEN lo ELSE hi END AS ap, CASE WHEN strand = 1 THEN base ELSE {_rc('base')} END AS ref, '-' AS alt, 'del' AS vtype FROM nd
  UNION ALL SELECT sample_id, ftype, gene, start_pos, end_pos, strand, pos, CASE WHEN vtype = 'ins' THEN '-' WHEN strand = 1 THEN base ELSE {_rc('base')} END, CASE WHEN strand = 1 THEN alt ELSE {_rc('alt')} END, vtype FROM nb WHERE vtype <> 'del'),
 ann AS (SELECT sample_id, 'Gene' AS ftype, gene, CAST(aa_pos AS BIGINT) AS gpos, aa_ref AS ref, aa_alt AS alt, 'snp' AS vtype FROM r ANTI JOIN st USING (sample_id, gene) UNION SELECT sample_id, 'Gene', gene, NULL, '-', '-', 'FS' FROM st
  UNION SELECT sample_id, 'Gene', gene, gpos, ref, alt, vtype FROM ind
  UNION SELECT sample_id, ftype, gene, CAST(CASE WHEN ftype = 'upstream' THEN CASE WHEN strand = 1 THEN ap - end_pos - 1 ELSE start_pos - ap - 1 END WHEN strand = 1 THEN ap - start_pos + 1 ELSE end_pos - ap + 1 END AS BIGINT), ref, alt, vtype FROM nr)"""


@query("annotate_all", "b_calls b_feat b_ref", f"WITH {_ROWS_SQL} SELECT sample_id, ftype, gene, gpos, ref, alt, vtype FROM ann")
def _(calls, feat, ref):
    return an.annotate(calls, _located(calls, feat), ref)


@query("variant_vocabulary", "b_calls b_feat b_ref", f"WITH {_ROWS_SQL} SELECT DISTINCT ftype, gene, gpos, ref, alt, vtype FROM ann")
def _(calls, feat, ref):
    return an.vocabulary(an.annotate(calls, _located(calls, feat), ref))


@query("broken_only", "b_calls b_feat b_ref", f"WITH {_ROWS_SQL} SELECT DISTINCT sample_id, gene FROM ann WHERE ftype = 'Gene' AND (vtype = 'FS' OR vtype = 'snp' AND (ref = '*' OR alt = '*')) OR ftype = 'upstream' AND vtype IN ('ins', 'del')")
def _(calls, feat, ref):
    return an.broken_genes(an.annotate(calls, _located(calls, feat), ref))


_DIST = "sm AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {score})" for a, b, score in sm.entries()) + ") t(a, b, score)), dt AS (SELECT x.a AS ref, y.a AS alt, sqrt(sum((x.score - y.score) ** 2)) AS distance FROM sm x JOIN sm y USING (b) GROUP BY x.a, y.a)"


@query("aa_distance", "b_calls b_feat b_ref", f"WITH {_C1}, {_DIST} SELECT sample_id, gene, aa_pos, round(distance, 6) AS distance FROM r LEFT JOIN dt ON ref = aa_ref AND alt = aa_alt")
def _(calls, feat, ref):
    rows = _consequences(calls, feat, ref).select("sample_id", F.lit("Gene").alias("ftype"), "gene", "aa_pos", F.col("aa_ref").alias("ref"), F.col("aa_alt").alias("alt"), F.lit("snp").alias("vtype"))
    return an.with_distance(rows, sm.distances(sm.similarity(calls.sparkSession))).select("sample_id", "gene", "aa_pos", F.round("distance", 6).alias("distance"))


@query("distance_features", "b_calls b_feat b_ref", f"""
WITH {_ROWS_SQL}, {_DIST}, br AS (SELECT DISTINCT sample_id, gene FROM ann WHERE ftype = 'Gene' AND (vtype = 'FS' OR vtype = 'snp' AND (ref = '*' OR alt = '*'))),
pr AS (SELECT ann.*, distance, CASE vtype WHEN 'ins' THEN length(ann.alt) WHEN 'del' THEN length(ann.ref) ELSE 1 END AS size FROM ann LEFT JOIN dt ON dt.ref = ann.ref AND dt.alt = ann.alt AND ftype = 'Gene' AND vtype = 'snp' WHERE ftype <> 'non_cds' AND NOT (ftype = 'Gene' AND (sample_id, gene) IN (SELECT sample_id, gene FROM br))),
ct AS (SELECT *, CASE WHEN ftype <> 'Gene' THEN size WHEN distance IS NOT NULL THEN distance * distance ELSE size * (SELECT max(distance) ** 2 FROM dt) END AS cost FROM pr)
SELECT sample_id, 'Gene' AS ftype, gene, 'broken' AS kind, CAST(NULL AS BIGINT) AS gpos, CAST(1 AS DOUBLE) AS value FROM br
UNION ALL SELECT sample_id, ftype, gene, 'dist', NULL, round(CASE WHEN ftype = 'Gene' THEN sqrt(sum(cost)) ELSE sum(cost) END, 6) FROM ct GROUP BY sample_id, ftype, gene
UNION ALL SELECT sample_id, ftype, gene, 'site', gpos, round(distance, 6) FROM ct WHERE distance IS NOT NULL UNION ALL SELECT sample_id, ftype, gene, 'del', gpos, size FROM ct WHERE vtype = 'del' AND size > 1""")
def _(calls, feat, ref):
    found = an.distance_features(an.annotate(calls, _located(calls, feat), ref), sm.distances(sm.similarity(calls.sparkSession)))
    return found.withColumn("value", F.round("value", 6))


@query("dictionary_convert", "b_drug_gene b_feat", f"""
WITH e AS (SELECT drug, gene, 1 + locus % 9 AS codon, substring('{sq.GENETIC_CODE}', CAST(1 + locus % 64 AS BIGINT), 1) AS aa FROM b_drug_gene), a AS (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS alt)
SELECT drug, gene, codon, CASE WHEN strand = 1 THEN start_pos + 3 * (codon - 1) ELSE end_pos - 3 * codon + 1 END AS pos, aa, alt FROM e JOIN b_feat ON name = gene CROSS JOIN a WHERE alt <> aa""")
def _(genes, feat):
    entries = genes.select("drug", "gene", (1 + F.col("locus") % 9).alias("codon"), F.substring(F.lit(sq.GENETIC_CODE), (1 + F.col("locus") % 64).cast("int"), F.lit(1)).alias("aa"))
    rows = entries.join(feat.withColumnRenamed("name", "gene"), "gene")
    every = F.array(*[F.lit(x) for x in "ACDEFGHIKLMNPQRSTVWY"])
    pos = sq.codon_start(*[F.col(c) for c in ("codon", "start_pos", "end_pos", "strand")])
    return rows.select("drug", "gene", "codon", pos.alias("pos"), "aa", F.explode(F.array_except(every, F.array("aa"))).alias("alt"))


@query("marker_convert", "b_calls b_ref", f"SELECT DISTINCT n - pos + 1 AS pos, {_rc('alt')} AS alt FROM b_calls CROSS JOIN (SELECT length(seq) AS n FROM b_ref) WHERE vtype = 'snp' AND pos <= n")
def _(calls, ref):
    rows = calls.where("vtype = 'snp'").withColumn("n", gn.reference_length(ref)).where("pos <= n")
    return rows.select((F.col("n") - F.col("pos") + 1).alias("pos"), sq.reverse_complement(F.col("alt")).alias("alt")).distinct()


@query("gene_repair", "b_feat b_ref", f"""
WITH o AS (SELECT *, (end_pos - start_pos + 1) % 3 AS m FROM b_feat WHERE ftype = 'Gene' AND (end_pos - start_pos + 1) % 3 <> 0 AND end_pos - start_pos >= 2),
t AS (SELECT o.*, CASE WHEN strand = 1 THEN substring(seq, end_pos - m - 2, 6) ELSE {_rc('substring(seq, start_pos + m - 3, 6)')} END AS x FROM o CROSS JOIN b_ref WHERE CASE WHEN strand = 1 THEN end_pos - m - 2 ELSE start_pos + m - 3 END >= 1),
u AS (SELECT *, CASE WHEN {_aa('left(x, 3)')} = '*' THEN -m WHEN {_aa('right(x, 3)')} = '*' THEN 3 - m END AS d FROM t WHERE length(x) = 6)
SELECT name, CASE WHEN strand = 1 AND d IS NOT NULL THEN start_pos ELSE start_pos - d END AS fixed_start, CASE WHEN strand = -1 AND d IS NOT NULL THEN end_pos ELSE end_pos + d END AS fixed_end FROM u""")
def _(feat, ref):
    return co.repaired_genes(feat.where("ftype = 'Gene'"), co.reference_chunks(ref))


_SITES = "x AS (SELECT pos, sample_id, max(alt) AS alt FROM b_calls WHERE vtype = 'snp' GROUP BY ALL), s AS (SELECT DISTINCT pos FROM x), t AS (SELECT pos, coalesce(nullif(substring(seq, pos, 1), ''), 'N') AS value FROM s CROSS JOIN b_ref)"


def _snp_cells(calls, ref):
    cells = calls.where("vtype = 'snp'").groupBy("sample_id", "pos").agg(F.max("alt").alias("value"))
    sites = cells.select("pos").distinct()
    known = co.with_bases(sites, F.col("pos"), F.lit(1), co.reference_chunks(ref), "value")
    return cells, sites.join(known, "pos", "left").select("pos", F.coalesce("value", F.lit("N")).alias("value"))


_WIDE = """sc AS (SELECT pos, value, row_number() OVER (ORDER BY pos) - 1 AS code FROM t), n AS (SELECT DISTINCT sample_id FROM b_calls),
 wide AS (SELECT sample_id, code // {0} AS block, string_agg(coalesce(alt, value), '' ORDER BY code) AS line FROM n CROSS JOIN sc LEFT JOIN x USING (sample_id, pos) GROUP BY sample_id, code // {0}) SELECT sample_id, block, line FROM wide"""


@query("snp_alignment", "b_calls b_ref", f"WITH {_SITES}, {_WIDE.format(256)}")
def _(calls, ref):
    cells, sites = _snp_cells(calls, ref)
    return co.wide_rows(cells, sites, calls, "sample_id", "pos")


@query("indel_alignment", "b_calls", f"WITH x AS (SELECT DISTINCT sample_id, pos, '1' AS alt FROM b_calls WHERE vtype <> 'snp'), t AS (SELECT DISTINCT pos, '0' AS value FROM x), {_WIDE.format(256)}")
def _(calls):
    cells = calls.where("vtype <> 'snp'").select("sample_id", "pos").distinct().withColumn("value", F.lit("1"))
    return co.wide_rows(cells, cells.select("pos").distinct().withColumn("value", F.lit("0")), calls, "sample_id", "pos")


_CODONS = _G + ", k AS (SELECT DISTINCT gene, pos - (pos - start_pos) % 3 AS cs FROM c WHERE ftype = 'Gene' AND vtype = 'snp'), p AS (SELECT gene, cs, unnest(range(cs, cs + 3)) AS pos FROM k), r AS (SELECT p.*, substring(seq, pos, 1) AS value FROM p CROSS JOIN b_ref WHERE cs + 2 <= length(seq))"


def _codon_sites(calls, feat, ref):
    """(place, value): the bases of each changed codon with what the reference has; a place is (first base, gene, base)."""
    rows = _located(calls, feat).where("ftype = 'Gene' and vtype = 'snp'")
    codons = rows.select("gene", sq.anchor(F.col("pos"), F.col("start_pos")).alias("at")).distinct()
    codons = co.with_bases(codons, F.col("at"), F.lit(3), co.reference_chunks(ref), "codon")
    spread = codons.select("gene", "at", F.posexplode(F.split("codon", "")).alias("i", "value"))
    return spread.select(F.struct("at", "gene", (F.col("at") + F.col("i")).alias("pos")).alias("place"), "value")


@query("codon_alignment", "b_calls b_feat b_ref", f"""
WITH {_CODONS}, sc AS (SELECT pos, value, row_number() OVER (ORDER BY cs, gene, pos) - 1 AS code FROM r), x AS (SELECT sample_id, pos, max(alt) AS alt FROM b_calls WHERE vtype = 'snp' GROUP BY ALL), n AS (SELECT DISTINCT sample_id FROM b_calls)
SELECT sample_id, code // 255 AS block, string_agg(coalesce(alt, value), '' ORDER BY code) AS line FROM n CROSS JOIN sc LEFT JOIN x USING (sample_id, pos) GROUP BY sample_id, code // 255""")
def _(calls, feat, ref):
    sites = materialise(_codon_sites(calls, feat, ref))
    own = calls.where("vtype = 'snp'").groupBy("sample_id", "pos").agg(F.max("alt").alias("value"))
    cells = sites.select("place", F.col("place.pos").alias("pos")).join(own, "pos").select("sample_id", "place", "value")
    return co.wide_rows(cells, sites, calls, "sample_id", "place", 255)  # whole codons


@query("codon_coords", "b_calls b_feat b_ref", f"WITH {_CODONS} SELECT gene, cs AS first_pos, row_number() OVER (ORDER BY cs, gene) - 1 AS code FROM (SELECT DISTINCT gene, cs FROM r)")
def _(calls, feat, ref):
    codons = _codon_sites(calls, feat, ref).select(F.struct("place.at", "place.gene").alias("feature"))
    return fe.encode(codons).select("feature.gene", F.col("feature.at").alias("first_pos"), "code")


_ROWS = """s AS (SELECT DISTINCT split, p // 256 AS block, p FROM cells), n AS (SELECT DISTINCT node, split, p // 256 AS block FROM cells),
 r AS (SELECT n.node, n.split, n.block, string_agg(coalesce(c.base, '-'), '' ORDER BY s.p) AS row FROM n JOIN s ON s.split = n.split AND s.block = n.block
 LEFT JOIN cells c ON c.node = n.node AND c.split = n.split AND c.p = s.p GROUP BY n.node, n.split, n.block)"""


@query("column_subset", "b_bases b_calls", f"""
WITH cells AS (SELECT node, 0 AS split, pos AS p, base FROM b_bases WHERE pos IN (SELECT pos FROM b_calls)), {_ROWS} SELECT node, block, row FROM r""")
def _(bases, calls):
    return co.site_rows(bases.join(calls.select("pos").distinct(), "pos", "left_semi"), ["node"])


@query("column_interleave", "b_bases", f"""
WITH k AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS k FROM (SELECT DISTINCT pos FROM b_bases)),
 cells AS (SELECT node, CAST(k % 7 AS INT) AS split, k // 7 AS p, base FROM b_bases JOIN k USING (pos)), {_ROWS} SELECT node, split, block, row FROM r""")
def _(bases):
    codes = fe.encode(bases.select(F.col("pos").alias("feature")).distinct()).select(F.col("feature").alias("pos"), "code")
    return co.site_rows(bases.join(co.interleave(codes, 7), "pos"), ["node", "split"], "place")


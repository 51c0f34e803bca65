"""Queries on aligned reads and the reference."""

from pyspark.sql import functions as F

from cladeworks.operators import genome as gn
from cladeworks.operators import intervals as iv
from cladeworks.operators import reads as rd
from cladeworks.plans.registry import query

#: Reads of 100 reference bases from orders, in SQL that both engines run: clips, an insertion, a deletion, a skip, and one base set to T.
_PLACE = "CAST((o_orderkey * 37) % 20000 + 1 AS BIGINT)"
_CIGAR = "CASE o_orderkey % 5 WHEN 0 THEN '100M' WHEN 1 THEN '5S60M2I38M' WHEN 2 THEN '40M3D57M4S' WHEN 3 THEN '3H50M10N30M' ELSE '30=1X20M2I40=' END"
_OWN = """CASE o_orderkey % 5 WHEN 0 THEN t WHEN 1 THEN concat('GATTA', substring(t, 1, 60), 'AC', substring(t, 61, 38)) WHEN 2 THEN concat(substring(t, 1, 40), substring(t, 44, 57), 'GGGG')
 WHEN 3 THEN concat(substring(t, 1, 50), substring(t, 61, 30)) ELSE concat(substring(t, 1, 51), 'TT', substring(t, 52, 40)) END"""
_SEQ = "concat(left(s, CAST(o_custkey % 75 AS INT)), 'T', substring(s, CAST(o_custkey % 75 + 2 AS INT), 1000))"


@query("read_events", "orders b_ref", f"""
WITH t AS (SELECT o_orderkey, o_custkey, {_PLACE} AS start_pos, substring(seq, {_PLACE}, 100) AS t FROM orders CROSS JOIN b_ref),
s AS (SELECT *, {_CIGAR} AS cigar, {_OWN} AS s FROM t), r AS (SELECT o_orderkey AS qname, start_pos, t, {_SEQ} AS seq, regexp_extract_all(cigar, '([0-9]+)[MIDNSHP=X]', 1) AS n, regexp_extract_all(cigar, '[0-9]+([MIDNSHP=X])', 1) AS op FROM s),
o AS (SELECT *, op[i] AS o, CAST(n[i] AS BIGINT) AS size, CAST(coalesce(list_sum(list_transform(range(1, i), lambda x: CASE WHEN op[x] IN ('M', '=', 'X', 'D', 'N') THEN CAST(n[x] AS BIGINT) ELSE 0 END)), 0) AS BIGINT) AS r,
 CAST(coalesce(list_sum(list_transform(range(1, i), lambda x: CASE WHEN op[x] IN ('M', '=', 'X', 'I', 'S') THEN CAST(n[x] AS BIGINT) ELSE 0 END)), 0) AS BIGINT) AS q FROM (SELECT *, unnest(range(1, len(op) + 1)) AS i FROM r)),
b AS (SELECT *, unnest(range(0, size)) AS k FROM o WHERE o IN ('M', '=', 'X', 'D'))
SELECT qname, start_pos + r + k AS pos, substring(t, r + k + 1, 1) AS ref, CASE WHEN o = 'D' THEN '' ELSE substring(seq, q + k + 1, 1) END AS alt, CASE WHEN o = 'D' THEN 'del' ELSE 'snp' END AS vtype
FROM b WHERE o = 'D' OR substring(t, r + k + 1, 1) <> substring(seq, q + k + 1, 1) UNION ALL SELECT qname, start_pos + r, '', substring(seq, q + 1, size), 'ins' FROM o WHERE o = 'I'""")
def _(orders, ref):
    chunks = gn.reference_chunks(ref, overlap=128)
    rows = gn.with_bases(orders.select("o_orderkey", "o_custkey", F.expr(_PLACE).alias("start_pos")), F.col("start_pos"), F.lit(100), chunks, "t")
    reads = rows.withColumn("s", F.expr(_OWN)).select(F.col("o_orderkey").alias("qname"), "start_pos", F.expr(_CIGAR).alias("cigar"), F.expr(_SEQ).alias("seq"))
    return gn.reads_to_events(reads, chunks)


@query("reads_in_intervals", "b_reads b_feat", "SELECT qname, mate, start_pos, end_pos FROM b_reads r WHERE EXISTS (SELECT 1 FROM b_feat f WHERE ftype = 'rRNA' AND r.start_pos <= f.end_pos AND f.start_pos <= r.end_pos)")
def _(reads, feat):
    return rd.overlapping(reads.select("qname", "mate", "start_pos", "end_pos"), feat.where("ftype = 'rRNA'").select(F.col("start_pos").alias("x_start"), F.col("end_pos").alias("x_end")))


_VARIANT_PAIRS = """v AS (SELECT DISTINCT sample_id, pos, alt, vtype FROM b_calls), h AS (SELECT v.*, qname, is_proper FROM v JOIN b_reads r ON r.sample_id = v.sample_id AND v.pos BETWEEN r.start_pos AND r.end_pos),
 i AS (SELECT a.sample_id, a.qname, greatest(a.end_pos, b.end_pos) - least(a.start_pos, b.start_pos) + 1 AS insert FROM b_reads a JOIN b_reads b ON a.sample_id = b.sample_id AND a.qname = b.qname AND a.mate = 0 AND b.mate = 1 WHERE a.is_proper AND b.is_proper),
 w AS (SELECT DISTINCT h.sample_id, pos, alt, vtype, h.qname, insert FROM h JOIN i ON i.sample_id = h.sample_id AND i.qname = h.qname WHERE is_proper), u AS (SELECT sample_id, avg(insert) AS mean, stddev_pop(insert) AS std FROM w GROUP BY sample_id),
 c AS (SELECT sample_id, pos, alt, vtype, count(*) AS cov, count(*) FILTER (is_proper) AS proper FROM h GROUP BY ALL),
 p AS (SELECT w.sample_id, pos, alt, vtype, count(*) AS n_pairs, avg(insert) AS mean_insert, count(*) FILTER (abs(insert - mean) > 2 * std) AS long_inserts FROM w JOIN u ON u.sample_id = w.sample_id GROUP BY w.sample_id, pos, alt, vtype),
 st AS (SELECT v.*, coalesce(cov, 0) AS cov, coalesce(proper, 0) AS proper, coalesce(n_pairs, 0) AS n_pairs, mean_insert, coalesce(long_inserts, 0) AS long_inserts FROM v LEFT JOIN c USING (sample_id, pos, alt, vtype) LEFT JOIN p USING (sample_id, pos, alt, vtype)),
 sh AS (SELECT *, CASE WHEN cov > 0 THEN (cov - proper) / cov ELSE 0 END AS bad_pairs, CASE WHEN proper > 0 THEN long_inserts / proper ELSE 0 END AS long_pairs FROM st),
 bv AS (SELECT pos, alt, vtype, count(*) AS n_samples, CAST(sum(cov) AS BIGINT) AS cov, CAST(sum(proper) AS BIGINT) AS proper, CAST(sum(long_inserts) AS BIGINT) AS long_inserts, avg(CAST(bad_pairs > 0.5 AS INT)) AS bad_share, avg(CAST(long_pairs > 0.5 AS INT)) AS long_share FROM sh GROUP BY ALL)"""
_six = lambda df, *columns: df.withColumns({c: F.round(c, 6) for c in columns})


@query("variant_pairs", "b_calls b_reads", f"WITH {_VARIANT_PAIRS} SELECT sample_id, pos, alt, vtype, cov, proper, n_pairs, round(mean_insert, 6) AS mean_insert, long_inserts FROM st")
def _(calls, reads):
    return _six(rd.variant_pairs(reads, calls), "mean_insert").select("sample_id", "pos", "alt", "vtype", "cov", "proper", "n_pairs", "mean_insert", "long_inserts")


@query("pairs_by_variant", "b_calls b_reads", f"WITH {_VARIANT_PAIRS} SELECT pos, alt, vtype, n_samples, cov, proper, long_inserts, round(bad_share, 6) AS bad_share, round(long_share, 6) AS long_share FROM bv")
def _(calls, reads):
    return _six(rd.pairs_by_variant(rd.variant_pairs(reads, calls)), "bad_share", "long_share")


@query("flagged_variants", "b_calls b_reads", f"WITH {_VARIANT_PAIRS} SELECT sample_id, pos, alt, vtype, cov, proper, long_inserts, round(bad_pairs, 6) AS bad_pairs, round(long_pairs, 6) AS long_pairs FROM sh WHERE bad_pairs > 0.5 OR long_pairs > 0.5")
def _(calls, reads):
    return _six(rd.flagged_variants(rd.variant_pairs(reads, calls)).drop("n_pairs", "mean_insert"), "bad_pairs", "long_pairs")


@query("pairs_by_gene", "b_calls b_reads b_feat", f"""
WITH {_VARIANT_PAIRS}, l AS (SELECT pos, arg_max(name, start_pos) AS gene FROM (SELECT DISTINCT pos FROM b_calls) JOIN b_feat ON pos BETWEEN start_pos AND end_pos GROUP BY pos),
 g AS (SELECT gene, count(*) AS n_variants, CAST(sum(cov) AS BIGINT) AS cov, CAST(sum(proper) AS BIGINT) AS proper, CAST(sum(long_inserts) AS BIGINT) AS long_inserts FROM bv JOIN l USING (pos) GROUP BY gene HAVING sum(cov) > 0)
SELECT *, round((cov - proper) / cov, 6) AS bad_pairs, round(CASE WHEN proper > 0 THEN long_inserts / proper ELSE 0 END, 6) AS long_pairs FROM g""")
def _(calls, reads, feat):
    located = iv.last_feature(calls, feat).select("pos", F.col("name").alias("gene"))
    return _six(rd.pairs_by_gene(rd.variant_pairs(reads, calls), located), "bad_pairs", "long_pairs")

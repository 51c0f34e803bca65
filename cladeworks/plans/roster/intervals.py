"""Interval and island queries."""

from pyspark.sql import functions as F

from cladeworks.operators import intervals as iv
from cladeworks.operators import islands
from cladeworks.plans.registry import query


@query("point_in_interval", "b_calls b_feat", """
SELECT pos, arg_max(name, start_pos) AS name, max(start_pos) AS start_pos
FROM (SELECT DISTINCT pos FROM b_calls) JOIN b_feat ON pos BETWEEN start_pos AND end_pos GROUP BY pos""")
def _(calls, feat):
    return iv.last_feature(calls, feat)


@query("span_join", "b_reads b_feat", """
SELECT name, count(*) AS n_reads, CAST(sum(least(r.end_pos, f.end_pos) - greatest(r.start_pos, f.start_pos) + 1) AS BIGINT) AS overlap
FROM b_reads r JOIN b_feat f ON r.start_pos <= f.end_pos AND f.start_pos <= r.end_pos GROUP BY name""")
def _(reads, feat):
    reads = reads.select(F.col("start_pos").alias("r_start"), F.col("end_pos").alias("r_end"))
    pairs = iv.spans_overlap(reads, feat, "r_start", "r_end", "start_pos", "end_pos")
    shared = F.least("r_end", "end_pos") - F.greatest("r_start", "start_pos") + 1
    return pairs.groupBy("name").agg(F.count(F.lit(1)).alias("n_reads"), F.sum(shared).cast("long").alias("overlap"))


@query("multi_feature_count", "b_calls b_feat", """
SELECT pos, count(*) AS n_features FROM (SELECT DISTINCT pos FROM b_calls) JOIN b_feat ON pos BETWEEN start_pos AND end_pos GROUP BY pos HAVING count(*) > 1""")
def _(calls, feat):
    return iv.points_in_intervals(calls.select("pos").distinct(), feat).groupBy("pos").agg(F.count(F.lit(1)).alias("n_features")).where("n_features > 1")


@query("nearest_feature", "b_calls b_feat", """
WITH p AS (SELECT DISTINCT pos FROM b_calls),
l AS (SELECT p.pos, f.name FROM p ASOF JOIN (SELECT end_pos, arg_max(name, (start_pos, name)) AS name FROM b_feat GROUP BY end_pos) f ON p.pos > f.end_pos),
r AS (SELECT p.pos, f.name FROM p ASOF JOIN (SELECT start_pos, arg_min(name, (end_pos, name)) AS name FROM b_feat GROUP BY start_pos) f ON p.pos < f.start_pos)
SELECT p.pos, l.name AS left_name, r.name AS right_name FROM p LEFT JOIN l ON l.pos = p.pos LEFT JOIN r ON r.pos = p.pos""")
def _(calls, feat):
    return iv.nearest(calls, feat)


_EXCLUDED = "SELECT start_pos, end_pos FROM b_feat WHERE ftype = 'rRNA'"


@query("exclude_points", "b_calls b_feat", f"""
SELECT sample_id, pos, alt, vtype FROM b_calls WHERE NOT EXISTS (SELECT 1 FROM ({_EXCLUDED}) WHERE pos BETWEEN start_pos AND end_pos)""")
def _(calls, feat):
    return iv.points_in_intervals(calls.select("sample_id", "pos", "alt", "vtype"), feat.where("ftype = 'rRNA'"), how="left_anti")


@query("exclude_spans", "b_reads b_feat", f"""
SELECT qname, mate, start_pos, end_pos FROM b_reads r WHERE NOT EXISTS (SELECT 1 FROM ({_EXCLUDED}) f WHERE r.start_pos <= f.end_pos AND f.start_pos <= r.end_pos)""")
def _(reads, feat):
    out = feat.where("ftype = 'rRNA'").select(F.col("start_pos").alias("x_start"), F.col("end_pos").alias("x_end"))
    return iv.spans_overlap(reads.select("qname", "mate", "start_pos", "end_pos"), out, "start_pos", "end_pos", "x_start", "x_end", how="left_anti")


@query("proximity_pairs", "b_calls", """
SELECT sample_id, count(*) AS n_pairs, CAST(sum(CASE WHEN cov >= 2 * cov_2 OR cov_2 >= 2 * cov THEN 1 ELSE 0 END) AS BIGINT) AS uneven,
 CAST(sum(CASE WHEN (cov >= 10) <> (cov_2 >= 10) THEN 1 ELSE 0 END) AS BIGINT) AS disagree
FROM (SELECT a.sample_id, a.cov, b.cov AS cov_2 FROM b_calls a JOIN b_calls b ON a.sample_id = b.sample_id AND b.pos > a.pos AND b.pos - a.pos <= 150) GROUP BY sample_id""")
def _(calls):
    pairs = iv.close_pairs(calls, "sample_id", "pos", 150, ["cov"])
    uneven = (F.col("cov") >= 2 * F.col("cov_2")) | (F.col("cov_2") >= 2 * F.col("cov"))
    disagree = (F.col("cov") >= 10) != (F.col("cov_2") >= 10)
    return pairs.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(uneven.cast("long")).alias("uneven"), F.sum(disagree.cast("long")).alias("disagree"))


@query("gene_coverage", "b_depth b_feat", """
WITH runs AS (SELECT sample_id, min(pos) AS s, max(pos) AS e FROM (SELECT sample_id, pos, pos - row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS g FROM b_depth WHERE depth >= 5) GROUP BY sample_id, g),
c AS (SELECT sample_id, name, sum(least(e, end_pos) - greatest(s, start_pos) + 1) AS n, max(end_pos - start_pos + 1) AS len FROM runs JOIN b_feat ON s <= end_pos AND start_pos <= e GROUP BY sample_id, name)
SELECT sample_id, name, round(n / len, 6) AS coverage, n >= 0.2 * len AS kept FROM c""")
def _(depth, feat):
    runs = islands.merge_adjacent(depth.where("depth >= 5"), ["sample_id"]).select("sample_id", F.col("start_pos").alias("s"), (F.col("start_pos") + F.col("length") - 1).alias("e"))
    pairs = iv.spans_overlap(runs, feat, "s", "e", "start_pos", "end_pos")
    shared = F.sum(F.least("e", "end_pos") - F.greatest("s", "start_pos") + 1)
    out = pairs.groupBy("sample_id", "name").agg(shared.alias("n"), F.max(F.col("end_pos") - F.col("start_pos") + 1).alias("len"))
    return out.select("sample_id", "name", F.round(F.col("n") / F.col("len"), 6).alias("coverage"), (F.col("n") >= 0.2 * F.col("len")).alias("kept"))


@query("site_interval_coverage", "b_calls b_depth", """
WITH runs AS (SELECT sample_id, min(pos) AS s, max(pos) AS e FROM (SELECT sample_id, pos, pos - row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS g FROM b_depth WHERE depth >= 5) GROUP BY sample_id, g),
sites AS (SELECT DISTINCT pos FROM b_calls)
SELECT pos, count(*) AS n_samples FROM sites JOIN runs ON pos BETWEEN s AND e GROUP BY pos""")
def _(calls, depth):
    runs = islands.merge_adjacent(depth.where("depth >= 5"), ["sample_id"]).select("sample_id", F.col("start_pos").alias("s"), (F.col("start_pos") + F.col("length") - 1).alias("e"))
    hit = iv.points_in_intervals(calls.select("pos").distinct(), runs, start="s", end="e")
    return hit.groupBy("pos").agg(F.count(F.lit(1)).alias("n_samples"))


@query("interval_enrichment", "b_calls b_feat", """
WITH i AS (SELECT start_pos, end_pos FROM b_feat WHERE ftype = 'rRNA'), p AS (SELECT DISTINCT pos FROM b_calls),
h AS (SELECT pos, max(CASE WHEN start_pos IS NULL THEN 0 ELSE 1 END) AS inside FROM p LEFT JOIN i ON pos BETWEEN start_pos AND end_pos GROUP BY pos),
g AS (SELECT count(DISTINCT x) AS bases FROM (SELECT unnest(range(start_pos, end_pos + 1)) AS x FROM i))
SELECT round(avg(inside), 6) AS share_points, round(any_value(bases) / max(pos), 6) AS share_axis FROM h CROSS JOIN g""")
def _(calls, feat):
    inner = feat.where("ftype = 'rRNA'").select("start_pos", "end_pos")
    p = calls.select("pos").distinct()
    inside = iv.points_in_intervals(p, inner, how="left_semi").agg(F.count(F.lit(1)).alias("inside"))
    whole = p.agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("top"))
    bases = inner.select(F.explode(F.sequence("start_pos", "end_pos")).alias("x")).distinct().agg(F.count(F.lit(1)).alias("bases"))
    return whole.select(F.round(inside.scalar() / F.col("n"), 6).alias("share_points"), F.round(bases.scalar() / F.col("top"), 6).alias("share_axis"))


@query("merge_unit_deletions", "b_calls", """
SELECT sample_id, min(pos) AS start_pos, count(*) AS length FROM
 (SELECT sample_id, pos, pos - row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS g FROM (SELECT DISTINCT sample_id, pos FROM b_calls WHERE vtype <> 'snp')) GROUP BY sample_id, g""")
def _(calls):
    return islands.merge_adjacent(calls.where("vtype <> 'snp'"), ["sample_id"])


@query("split_deletions", "b_feat", "SELECT name, unnest(range(start_pos, end_pos + 1)) AS pos FROM b_feat WHERE ftype = 'rRNA'")
def _(feat):
    runs = feat.where("ftype = 'rRNA'").select("name", "start_pos", (F.col("end_pos") - F.col("start_pos") + 1).alias("length"))
    return islands.split_runs(runs)


@query("covered_runs", "b_depth", """
SELECT sample_id, min(pos) AS start_pos, count(*) AS length FROM
 (SELECT sample_id, pos, pos - row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS g FROM b_depth WHERE depth >= 5) GROUP BY sample_id, g""")
def _(depth):
    return islands.merge_adjacent(depth.where("depth >= 5"), ["sample_id"])


@query("spacers", "b_feat", """
SELECT strand, name, e + 1 AS gap_start, start_pos - 1 AS gap_end FROM
 (SELECT *, max(end_pos) OVER (PARTITION BY strand ORDER BY start_pos, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM b_feat) WHERE e + 1 < start_pos""")
def _(feat):
    return islands.spacers(feat, ["strand"])

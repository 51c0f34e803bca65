"""Quality and coverage queries."""

from pyspark.sql import functions as F

from cladeworks.operators import intervals as iv
from cladeworks.operators import quality as q
from cladeworks.plans.registry import query

P = q.QualityParams()
_INFO = "map('QD', cast(qual as double), 'MQ', cast(mqm as double), 'FS', cast(cov as double))"


@query("threshold_filter", "b_calls", "SELECT sample_id, pos, alt, cov, qual, mqm FROM b_calls WHERE qual >= 40 AND cov >= 10 AND mqm >= 30")
def _(calls):
    return q.thresholds(calls).select("sample_id", "pos", "alt", "cov", "qual", "mqm")


@query("zscore_filter", "b_calls", """
WITH s AS (SELECT sample_id, avg(qual) mq, stddev_pop(qual) sq, avg(mqm) mm, stddev_pop(mqm) sm FROM b_calls GROUP BY sample_id)
SELECT sample_id, pos, alt, qual, mqm FROM b_calls JOIN s USING (sample_id) WHERE qual >= mq - 1.5 * sq AND mqm >= mm - 1.5 * sm""")
def _(calls):
    return q.z_cut(calls.select("sample_id", "pos", "alt", "qual", "mqm"), ["sample_id"], ["qual", "mqm"], 1.5)


@query("overcoverage_filter", "b_calls b_depth", """
WITH s AS (SELECT sample_id, avg(depth) + stddev_pop(depth) AS most FROM b_depth GROUP BY sample_id)
SELECT sample_id, pos, alt, cov FROM b_calls JOIN s USING (sample_id) WHERE cov <= most""")
def _(calls, depth):
    return q.not_overcovered(calls.select("sample_id", "pos", "alt", "cov"), depth, 1.0)


@query("annotation_hard_filter", "b_calls", """
SELECT sample_id, pos, alt FROM b_calls WHERE coalesce(qual >= 20, true) AND coalesce(CASE WHEN cov % 3 <> 0 THEN cov <= 40 END, true) AND coalesce(mqm >= 20, true)""")
def _(calls):
    info = F.expr("if(cov % 3 <> 0, map('QD', qual, 'FS', cov, 'MQ', mqm), map('QD', qual, 'MQ', mqm))")
    bounds = {"QD": (">=", 20), "FS": ("<=", 40), "MQ": (">=", 20), "MQRankSum": (">=", -12)}
    return calls.where(q.tolerant(bounds, info)).select("sample_id", "pos", "alt")


@query("annotation_zcut", "b_calls", """
WITH s AS (SELECT sample_id, avg(qual) a, stddev_pop(qual) b, avg(mqm) c, stddev_pop(mqm) d, avg(cov) e, stddev_pop(cov) f FROM b_calls GROUP BY sample_id)
SELECT sample_id, pos, alt, qual, mqm, cov FROM b_calls JOIN s USING (sample_id) WHERE abs(qual - a) <= 1.7 * b AND abs(mqm - c) <= 1.7 * d AND abs(cov - e) <= 1.7 * f""")
def _(calls):
    rows = calls.select("sample_id", "pos", "alt", "qual", "mqm", "cov").withColumn("info", F.expr(_INFO))
    return q.annotation_z(rows, ["sample_id"], "info", 1.7).drop("info")


@query("allele_fraction", "b_calls b_depth", """
SELECT c.sample_id, c.pos, c.alt, cov, depth FROM b_calls c JOIN b_depth d ON d.sample_id = c.sample_id AND d.pos = CAST(floor(c.pos / 10) AS BIGINT) WHERE depth >= 10 AND cov >= 0.75 * depth""")
def _(calls, depth):
    at = calls.withColumn("at", F.floor(F.col("pos") / 10).cast("long"))
    joined = at.join(depth.withColumnRenamed("pos", "at"), ["sample_id", "at"])
    return joined.where((F.col("depth") >= P.min_cov) & (F.col("cov") >= P.fraction * F.col("depth"))).select("sample_id", "pos", "alt", "cov", "depth")


@query("type_filter", "b_calls", "SELECT sample_id, pos, alt FROM b_calls WHERE vtype = 'snp'")
def _(calls):
    return calls.where("vtype = 'snp'").select("sample_id", "pos", "alt")


@query("exclusion_intervals", "b_feat b_drug_gene", """
SELECT DISTINCT * FROM (SELECT start_pos, end_pos FROM b_feat WHERE ftype = 'rRNA' OR contains(tag, '#4')
UNION ALL SELECT CASE WHEN strand = 1 THEN start_pos - 100 ELSE start_pos END, CASE WHEN strand = 1 THEN end_pos ELSE end_pos + 100 END
 FROM b_feat WHERE name IN (SELECT gene FROM b_drug_gene WHERE drug = 'INH'))""")
def _(feat, genes):
    named = genes.where("drug = 'INH'").select(F.col("gene").alias("name"))
    return q.exclusion_intervals(feat, ["rRNA"], ["#4"], named, 100)


@query("window_depth_filter", "b_depth", """
WITH s AS (SELECT sample_id, avg(depth) mu, stddev_pop(depth) sigma FROM b_depth GROUP BY sample_id),
w AS (SELECT sample_id, pos, avg(depth) OVER f AS m, stddev_pop(depth) OVER f AS d FROM b_depth WINDOW f AS (PARTITION BY sample_id ORDER BY pos RANGE BETWEEN 199 PRECEDING AND 200 FOLLOWING))
SELECT sample_id, pos, round(m, 6) AS mean FROM w JOIN s USING (sample_id) WHERE NOT (m < 10 OR m > mu + 0.05 * sigma OR d > 3 * sigma)""")
def _(depth):
    out = q.window_flags(depth, q.QualityParams(z=3.0))
    stats = depth.groupBy("sample_id").agg((F.avg("depth") + 0.05 * F.stddev_pop("depth")).alias("most"))
    return out.join(stats, "sample_id").where("low = 0 and wild = 0 and mean <= most").select("sample_id", "pos", F.round("mean", 6).alias("mean"))


@query("flags_by_place", "b_depth b_feat", """
WITH s AS (SELECT sample_id, avg(depth) mu, stddev_pop(depth) sigma FROM b_depth GROUP BY sample_id), g AS (SELECT DISTINCT pos FROM (SELECT DISTINCT pos FROM b_depth) JOIN b_feat ON ftype = 'Gene' AND pos BETWEEN start_pos AND end_pos),
w AS (SELECT sample_id, pos, avg(depth) OVER a AS ma, stddev_pop(depth) OVER a AS da, avg(depth) OVER b AS mb, stddev_pop(depth) OVER b AS db FROM b_depth
 WINDOW a AS (PARTITION BY sample_id ORDER BY pos RANGE BETWEEN 199 PRECEDING AND 200 FOLLOWING), b AS (PARTITION BY sample_id ORDER BY pos RANGE BETWEEN 24 PRECEDING AND 25 FOLLOWING)),
x AS (SELECT sample_id, pos, CASE WHEN pos IN (SELECT pos FROM g) THEN ma ELSE mb END AS m, CASE WHEN pos IN (SELECT pos FROM g) THEN da ELSE db END AS d FROM w)
SELECT sample_id, pos, CAST(m < 10 AS INT) AS low, CAST(m > mu + 3 * sigma AS INT) AS high, CAST(d > 3 * sigma AS INT) AS wild FROM x JOIN s USING (sample_id)""")
def _(depth, feat):
    return q.flags_by_place(depth, feat.where("ftype = 'Gene'").select("start_pos", "end_pos"), P).select("sample_id", "pos", "low", "high", "wild")


@query("site_flags", "b_depth b_calls", """
WITH s AS (SELECT sample_id, avg(depth) mu, stddev_pop(depth) sigma FROM b_depth GROUP BY sample_id),
w AS (SELECT sample_id, pos, depth, avg(depth) OVER f AS m, stddev_pop(depth) OVER f AS d FROM b_depth WINDOW f AS (PARTITION BY sample_id ORDER BY pos RANGE BETWEEN 24 PRECEDING AND 25 FOLLOWING)),
sites AS (SELECT DISTINCT CAST(floor(pos / 10) AS BIGINT) AS pos FROM b_calls)
SELECT sample_id, pos, depth, CAST(depth < 10 AS INT) AS under, CAST(depth > mu + 3 * sigma AS INT) AS over, CAST(m < 10 AS INT) AS low, CAST(m > mu + 3 * sigma AS INT) AS high, CAST(d > 3 * sigma AS INT) AS wild
FROM w JOIN s USING (sample_id) WHERE pos IN (SELECT pos FROM sites)""")
def _(depth, calls):
    sites = calls.select(F.floor(F.col("pos") / 10).cast("long").alias("pos")).distinct()
    return q.window_flags(depth, q.QualityParams(window=50)).join(sites, "pos", "left_semi").select("sample_id", "pos", "depth", "under", "over", "low", "high", "wild")


_SITES = "SELECT DISTINCT CAST(floor(pos / 10) AS BIGINT) AS pos FROM b_calls"


def _sites(calls):
    return calls.select(F.floor(F.col("pos") / 10).cast("long").alias("pos")).distinct()


@query("site_coverage", "b_depth b_calls", f"""
SELECT s.sample_id, t.pos, CAST(coalesce(depth, 0) >= 10 AS INT) AS covered FROM (SELECT DISTINCT sample_id FROM b_depth) s CROSS JOIN ({_SITES}) t LEFT JOIN b_depth d ON d.sample_id = s.sample_id AND d.pos = t.pos""")
def _(depth, calls):
    return q.site_coverage(depth, _sites(calls), P.min_cov)


@query("covered_shares", "b_depth b_calls", f"""
WITH t AS ({_SITES}), d AS (SELECT pos, count(*) AS n FROM b_depth WHERE depth >= 10 GROUP BY pos) SELECT pos, coalesce(n, 0) AS n_covered, round(coalesce(n, 0) / (SELECT count(DISTINCT sample_id) FROM b_depth), 6) AS share FROM t LEFT JOIN d USING (pos)""")
def _(depth, calls):
    return q.covered_shares(depth, _sites(calls), P.min_cov)


@query("coverage_prune_round", "b_depth", """
WITH c AS (SELECT sample_id, pos FROM b_depth WHERE depth >= 10), n AS (SELECT count(DISTINCT pos) np, count(DISTINCT sample_id) ns FROM b_depth),
s AS (SELECT sample_id FROM c CROSS JOIN n GROUP BY sample_id, np HAVING count(*) >= 0.22 * np), p AS (SELECT pos FROM c CROSS JOIN n GROUP BY pos, ns HAVING count(*) >= 0.22 * ns)
SELECT sample_id, pos FROM c WHERE sample_id IN (SELECT sample_id FROM s) AND pos IN (SELECT pos FROM p)""")
def _(depth):
    covered = depth.where("depth >= 10").select("sample_id", "pos")
    n = depth.agg(F.countDistinct("pos").alias("p"), F.countDistinct("sample_id").alias("s")).first()
    samples, sites = q.prune_round(covered, n["p"], n["s"], 0.22)
    return covered.join(samples, "sample_id", "left_semi").join(sites, "pos", "left_semi").select("sample_id", "pos")


@query("coverage_prune", "b_depth")
def _(depth):
    return q.prune(depth, 10, 0.2).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_sites"))


@query("attribute_filter", "b_calls b_feat", """
WITH l AS (SELECT pos, arg_max(name, start_pos) AS name FROM (SELECT DISTINCT pos FROM b_calls) JOIN b_feat ON pos BETWEEN start_pos AND end_pos GROUP BY pos)
SELECT sample_id, c.pos, alt, f.name FROM b_calls c JOIN l USING (pos) JOIN b_feat f ON f.name = l.name WHERE NOT is_pseudogene AND ftype = 'Gene'""")
def _(calls, feat):
    at = iv.last_feature(calls, feat).select("pos", "name")
    good = feat.where("not is_pseudogene and ftype = 'Gene'").select("name")
    return calls.join(at, "pos").join(good, "name", "left_semi").select("sample_id", "pos", "alt", "name")


@query("invalid_variants", "b_calls", "SELECT sample_id, pos, alt, vtype FROM b_calls WHERE NOT (CASE vtype WHEN 'snp' THEN length(alt) = 1 AND alt <> 'G' WHEN 'ins' THEN alt <> 'A' ELSE true END)")
def _(calls):
    rule = F.when(F.col("vtype") == "snp", (F.length("alt") == 1) & (F.col("alt") != "G")).when(F.col("vtype") == "ins", F.col("alt") != "A").otherwise(True)
    return calls.where(~rule).select("sample_id", "pos", "alt", "vtype")


@query("undercovered_samples", "b_depth", "SELECT pos, sample_id, depth FROM b_depth WHERE depth < 10")
def _(depth):
    return depth.where(F.col("depth") < P.min_cov).select("pos", "sample_id", "depth")


@query("name_tag_filter", "b_calls b_feat", """
SELECT DISTINCT pos, name FROM b_calls JOIN b_feat ON pos BETWEEN start_pos AND end_pos WHERE NOT contains(tag, '#1')""")
def _(calls, feat):
    return iv.points_in_intervals(calls.select("pos").distinct(), feat.where(~F.contains(F.col("tag"), F.lit("#1")))).select("pos", "name")


@query("depth_stats", "b_depth", """
SELECT sample_id, round(avg(depth), 6) AS mean, round(stddev_pop(depth), 6) AS std, round(quantile_cont(depth, 0.05), 6) AS p5, round(quantile_cont(depth, 0.5), 6) AS p50, round(quantile_cont(depth, 0.95), 6) AS p95 FROM b_depth GROUP BY sample_id""")
def _(depth):
    return depth.groupBy("sample_id").agg(
        F.round(F.avg("depth"), 6).alias("mean"), F.round(F.stddev_pop("depth"), 6).alias("std"), *[F.round(F.percentile("depth", p / 100), 6).alias(f"p{p}") for p in (5, 50, 95)]
    )


@query("filter_fail_counts", "b_calls", """
SELECT pos, CAST(sum(CAST(qual < 40 AS INT)) AS BIGINT) AS low_qual, CAST(sum(CAST(cov < 10 AS INT)) AS BIGINT) AS low_cov, CAST(sum(CAST(mqm < 30 AS INT)) AS BIGINT) AS low_mqm, count(*) AS n FROM b_calls GROUP BY pos""")
def _(calls):
    fails = lambda c: F.sum(c.cast("long"))
    return calls.groupBy("pos").agg(
        fails(F.col("qual") < P.min_qual).alias("low_qual"), fails(F.col("cov") < P.min_cov).alias("low_cov"), fails(F.col("mqm") < P.min_mqm).alias("low_mqm"), F.count(F.lit(1)).alias("n")
    )

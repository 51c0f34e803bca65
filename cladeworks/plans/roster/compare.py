"""Queries that count and compare calls."""

from pyspark.sql import functions as F

from cladeworks.operators import compare as cmp
from cladeworks.operators import intervals as iv
from cladeworks.plans.registry import query

KEY = ["pos", "alt", "vtype"]


def _sets(calls):
    return calls.where("callset = 'F'"), calls.where("callset = 'O'")


@query("variant_counts", "b_calls", "SELECT pos, alt, vtype, count(DISTINCT sample_id) AS n_samples FROM b_calls GROUP BY pos, alt, vtype HAVING count(DISTINCT sample_id) >= 2")
def _(calls):
    return cmp.samples_per_key(calls, KEY, 2)


@query("private_variants", "b_calls", """
WITH d AS (SELECT DISTINCT sample_id, pos, alt, vtype FROM b_calls), c AS (SELECT *, count(*) OVER (PARTITION BY pos, alt, vtype) AS n FROM d)
SELECT sample_id, count(*) AS n_total, count(*) FILTER (n = 1) AS n_private FROM c GROUP BY sample_id""")
def _(calls):
    return cmp.private_and_total(calls, KEY)


@query("rare_variants", "b_calls b_feat", """
WITH d AS (SELECT DISTINCT sample_id, pos, alt, vtype FROM b_calls), n AS (SELECT pos, alt, vtype FROM d GROUP BY ALL HAVING count(*) < 0.02 * (SELECT count(DISTINCT sample_id) FROM d)),
x AS (SELECT DISTINCT pos FROM d JOIN b_feat ON ftype = 'rRNA' AND pos BETWEEN start_pos AND end_pos)
SELECT sample_id, count(*) AS n_total, count(*) FILTER ((pos, alt, vtype) IN (SELECT (pos, alt, vtype) FROM n)) AS n_rare, count(*) FILTER (pos IN (SELECT pos FROM x)) AS n_inside FROM d GROUP BY sample_id""")
def _(calls, feat):
    d = calls.select("sample_id", *KEY).distinct()
    n = d.agg(F.countDistinct("sample_id").alias("n"))
    rare = d.groupBy(*KEY).agg(F.count(F.lit(1)).alias("k")).select(*KEY, (F.col("k") < 0.02 * n.scalar()).cast("long").alias("rare"))
    inside = iv.points_in_intervals(d.select("pos").distinct(), feat.where("ftype = 'rRNA'"), how="left_semi").withColumn("inside", F.lit(1))
    rows = d.join(rare, KEY).join(inside, "pos", "left")
    return rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_total"), F.sum("rare").alias("n_rare"), F.sum(F.coalesce("inside", F.lit(0))).cast("long").alias("n_inside"))


@query("gene_rollup", "b_calls b_feat", """
WITH c AS (SELECT pos, alt, count(DISTINCT sample_id) AS n FROM b_calls GROUP BY pos, alt), l AS (SELECT pos, arg_max(name, start_pos) AS name FROM (SELECT DISTINCT pos FROM b_calls) JOIN b_feat ON pos BETWEEN start_pos AND end_pos GROUP BY pos)
SELECT name, CAST(sum(n) AS BIGINT) AS n_calls, count(*) AS n_variants, max(n) AS most FROM c JOIN l USING (pos) GROUP BY name""")
def _(calls, feat):
    counts = cmp.samples_per_key(calls, ["pos", "alt"])
    at = iv.last_feature(calls, feat).select("pos", "name")
    return counts.join(at, "pos").groupBy("name").agg(F.sum("n_samples").alias("n_calls"), F.count(F.lit(1)).alias("n_variants"), F.max("n_samples").alias("most"))


@query("gene_sample_counts", "b_calls b_feat", """
SELECT name, count(DISTINCT sample_id) AS n_samples FROM b_calls JOIN b_feat ON pos BETWEEN start_pos AND end_pos GROUP BY name""")
def _(calls, feat):
    at = iv.points_in_intervals(calls.select("pos").distinct(), feat).select("pos", "name")
    return calls.join(at, "pos").groupBy("name").agg(F.countDistinct("sample_id").alias("n_samples"))


@query("callset_diff", "b_calls", """
SELECT pos, alt, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM (SELECT pos, alt, count(*) n FROM b_calls WHERE callset = 'F' GROUP BY pos, alt) a
FULL JOIN (SELECT pos, alt, count(*) n FROM b_calls WHERE callset = 'O' GROUP BY pos, alt) b USING (pos, alt)""")
def _(calls):
    return cmp.diff_counts(*_sets(calls), ["pos", "alt"])


@query("callset_presence_diff", "b_calls", """
SELECT sample_id, pos, alt, CASE WHEN bool_or(callset = 'F') THEN 'left' ELSE 'right' END AS side FROM b_calls GROUP BY sample_id, pos, alt HAVING count(DISTINCT callset) = 1""")
def _(calls):
    return cmp.presence_diff(*_sets(calls), ["sample_id", "pos", "alt"])


@query("callset_symdiff", "b_calls", """
WITH k AS (SELECT sample_id, pos, alt, bool_or(callset = 'F') l, bool_or(callset = 'O') r FROM b_calls GROUP BY ALL)
SELECT sample_id, count(*) FILTER (l AND NOT r) AS only_left, count(*) FILTER (r AND NOT l) AS only_right, count(*) FILTER (l AND r) AS shared FROM k GROUP BY sample_id""")
def _(calls):
    parts = cmp.partition_sets(*_sets(calls), ["sample_id", "pos", "alt"])
    n = lambda part: F.count(F.when(F.col("part") == part, 1))
    return parts.groupBy("sample_id").agg(n("left").alias("only_left"), n("right").alias("only_right"), n("both").alias("shared"))


@query("callset_strata", "b_calls b_pheno b_feat", """
WITH g AS (SELECT DISTINCT pos FROM b_calls JOIN b_feat ON contains(tag, '#2') AND pos BETWEEN start_pos AND end_pos)
SELECT drug, pheno, callset, count(*) AS n FROM b_calls JOIN b_pheno USING (sample_id) WHERE pos IN (SELECT pos FROM g) GROUP BY drug, pheno, callset""")
def _(calls, pheno, feat):
    tagged = feat.where(F.contains(F.col("tag"), F.lit("#2")))
    kept = calls.join(iv.points_in_intervals(calls.select("pos").distinct(), tagged, how="left_semi"), "pos", "left_semi")
    per_sample = kept.groupBy("sample_id", "callset").agg(F.count(F.lit(1)).alias("n"))  # before the join fans out over drugs
    return per_sample.join(pheno, "sample_id").groupBy("drug", "pheno", "callset").agg(F.sum("n").alias("n"))


@query("indel_lengths_inside", "b_calls b_feat", """
WITH c AS (SELECT DISTINCT sample_id, vtype, pos FROM b_calls WHERE pos IN (SELECT pos FROM b_calls JOIN b_feat ON ftype = 'rRNA' AND pos BETWEEN start_pos AND end_pos)),
r AS (SELECT vtype, count(*) AS length FROM (SELECT *, pos - row_number() OVER (PARTITION BY sample_id, vtype ORDER BY pos) AS g FROM c) GROUP BY sample_id, vtype, g)
SELECT vtype, length, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY vtype), 6) AS share FROM r GROUP BY vtype, length""")
def _(calls, feat):
    from cladeworks.operators.intervals import points_in_intervals

    inside = points_in_intervals(calls.select("sample_id", "vtype", "pos"), feat.where("ftype = 'rRNA'").select("start_pos", "end_pos"), how="left_semi")
    return cmp.run_lengths(inside)


@query("indel_lengths", "b_calls", """
WITH r AS (SELECT vtype, count(*) AS length FROM (SELECT sample_id, vtype, pos, pos - row_number() OVER (PARTITION BY sample_id, vtype ORDER BY pos) AS g FROM (SELECT DISTINCT sample_id, vtype, pos FROM b_calls)) GROUP BY sample_id, vtype, g)
SELECT vtype, length, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY vtype), 6) AS share FROM r GROUP BY vtype, length""")
def _(calls):
    return cmp.run_lengths(calls)


@query("callset_intersect", "b_calls", "SELECT sample_id, pos, alt, vtype FROM b_calls WHERE callset = 'F' INTERSECT SELECT sample_id, pos, alt, vtype FROM b_calls WHERE callset = 'O'")
def _(calls):
    a, b = (x.select("sample_id", *KEY) for x in _sets(calls))
    return a.intersect(b)


@query("callset_union", "b_calls", "SELECT sample_id, pos, alt, vtype FROM b_calls WHERE callset = 'F' UNION SELECT sample_id, pos, alt, vtype FROM b_calls WHERE callset = 'O'")
def _(calls):
    a, b = (x.select("sample_id", *KEY) for x in _sets(calls))
    return a.union(b).distinct()


@query("feature_partition", "b_calls", """
SELECT pos, alt, CASE WHEN bool_or(callset = 'F') AND bool_or(callset = 'O') THEN 'both' WHEN bool_or(callset = 'F') THEN 'left' ELSE 'right' END AS part FROM b_calls GROUP BY pos, alt""")
def _(calls):
    return cmp.partition_sets(*_sets(calls), ["pos", "alt"])


@query("list_merge", "b_calls b_depth", "SELECT DISTINCT pos FROM (SELECT pos FROM b_calls UNION ALL SELECT pos FROM b_depth)")
def _(calls, depth):
    return calls.select("pos").union(depth.select("pos")).distinct()


@query("list_semi_anti", "b_calls b_pheno", """
SELECT sample_id, pos, alt, CASE WHEN sample_id IN (SELECT sample_id FROM b_pheno WHERE drug = 'click' AND pheno = 1) THEN 'keep' ELSE 'trash' END AS side FROM b_calls""")
def _(calls, pheno):
    listed = pheno.where("drug = 'click' and pheno = 1").select("sample_id").distinct()
    rows = calls.select("sample_id", "pos", "alt")
    return rows.join(listed, "sample_id", "left_semi").withColumn("side", F.lit("keep")).union(rows.join(listed, "sample_id", "left_anti").withColumn("side", F.lit("trash")))


@query("duplicate_keys", "b_calls", "SELECT sample_id, pos, count(*) AS n, string_agg(alt, ',' ORDER BY alt) AS alts FROM b_calls GROUP BY sample_id, pos HAVING count(*) > 1")
def _(calls):
    dup = calls.groupBy("sample_id", "pos").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("alt")).alias("a")).where("n > 1")
    return dup.select("sample_id", "pos", "n", F.array_join("a", ",").alias("alts"))


@query("identical_samples", "b_words", """
WITH s AS (SELECT sample_id, string_agg(feature, chr(10) ORDER BY feature) AS m FROM b_words GROUP BY sample_id), f AS (SELECT m, min(sample_id) AS first FROM s GROUP BY m)
SELECT first, sample_id FROM s JOIN f USING (m) WHERE sample_id <> first""")
def _(words):
    return cmp.same_members(words, "sample_id", "feature")


@query("jaccard_pairs", "b_words", """
WITH n AS (SELECT sample_id, count(*) AS n FROM b_words GROUP BY sample_id), c AS (SELECT a.sample_id AS a, b.sample_id AS b, count(*) AS c FROM b_words a JOIN b_words b ON a.feature = b.feature AND a.sample_id < b.sample_id GROUP BY ALL)
SELECT a, b, round(c / (x.n + y.n - c), 6) AS similarity FROM c JOIN n x ON x.sample_id = a JOIN n y ON y.sample_id = b WHERE c / (x.n + y.n - c) >= 0.8""")
def _(words):
    return cmp.jaccard(words, "sample_id", "feature", 0.8).withColumn("similarity", F.round("similarity", 6))


@query("venn_regions", "b_calls", """
WITH m AS (SELECT pos, bit_or(CASE vtype WHEN 'snp' THEN 1 WHEN 'ins' THEN 2 ELSE 4 END) AS mask FROM b_calls GROUP BY pos) SELECT mask, count(*) AS n_items FROM m GROUP BY mask""")
def _(calls):
    return cmp.set_regions(calls, "pos", "vtype", ["snp", "ins", "del"])

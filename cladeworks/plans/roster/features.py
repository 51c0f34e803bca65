"""Feature and evaluation queries."""

from pyspark.sql import functions as F

from cladeworks.operators import consequence as co
from cladeworks.operators import evaluate as ev
from cladeworks.operators import features as fe
from cladeworks.operators import intervals as iv
from cladeworks.operators import manyfits as mf
from cladeworks.operators import phenotype as ph
from cladeworks.plans.lineage import materialise
from cladeworks.plans.registry import query


@query("contingency", "b_words b_labels", """
SELECT drug, feature, CAST(sum(pheno) AS BIGINT) AS n_r, CAST(sum(1 - pheno) AS BIGINT) AS n_s FROM b_words JOIN b_labels USING (sample_id) GROUP BY drug, feature""")
def _(words, labels):
    return fe.contingency(words, labels)


_BAND = "(SELECT feature FROM b_words GROUP BY feature HAVING count(*) > 20 AND count(*) < (SELECT count(DISTINCT sample_id) FROM b_words) - 20)"


_LISTED = "WITH e AS (SELECT 'toxic' AS drug, p_name AS feature FROM part UNION SELECT 'toxic', feature FROM b_words WHERE length(feature) = 5 UNION SELECT 'quality', feature FROM b_words WHERE length(feature) = 4)"


@query("contingency_listed", "b_words b_labels part", f"""
{_LISTED}, c AS (SELECT drug, feature, CAST(sum(pheno) AS BIGINT) AS n_r, CAST(sum(1 - pheno) AS BIGINT) AS n_s FROM b_words JOIN b_labels USING (sample_id) GROUP BY drug, feature)
SELECT drug, feature, coalesce(n_r, 0) AS n_r, coalesce(n_s, 0) AS n_s FROM e LEFT JOIN c USING (drug, feature)""")
def _(words, labels, part):
    own = lambda drug, n: words.where(F.length("feature") == n).select(F.lit(drug).alias("drug"), "feature")
    listed = part.select(F.lit("toxic").alias("drug"), F.col("p_name").alias("feature")).union(own("toxic", 5)).union(own("quality", 4))
    return fe.contingency(words, labels, listed)


@query("frequency_band", "b_words", f"SELECT sample_id, feature FROM b_words WHERE feature IN {_BAND}")
def _(words):
    return fe.frequency_band(words, 20).select("sample_id", "feature")


def _gene_features(calls, feat):
    """(sample_id, feature): genes with a call in the sample."""
    at = iv.last_feature(calls, feat).select("pos", F.col("name").alias("feature"))
    return calls.select("sample_id", "pos").distinct().join(at, "pos").select("sample_id", "feature").distinct()


#: Features of a sample: where a gene has an insertion or deletion, by the gene's tag and the stretch of 2000 bases.
_TAGS = "b AS (SELECT DISTINCT sample_id, concat(tag, '_', CAST(CAST(floor(pos / 2000) AS INT) AS VARCHAR)) AS feature FROM b_calls JOIN b_feat ON vtype <> 'snp' AND pos BETWEEN start_pos AND end_pos)"


def _tag_features(calls, feat):
    hit = iv.points_in_intervals(calls.where("vtype <> 'snp'").select("sample_id", "pos").distinct(), feat)
    return hit.select("sample_id", F.concat_ws("_", "tag", F.floor(F.col("pos") / 2000).cast("int").cast("string")).alias("feature")).distinct()


@query("pair_screen", "b_calls b_feat b_pheno", f"""
WITH {_TAGS}, p AS (SELECT sample_id, pheno FROM b_pheno WHERE drug = 'click'), o AS (SELECT b.*, pheno FROM b JOIN p USING (sample_id)), s AS (SELECT feature, count(*) n, sum(pheno) r FROM o GROUP BY feature),
j AS (SELECT x.feature a, y.feature b, count(*) n_ab, sum(x.pheno) r_ab FROM o x JOIN o y ON x.sample_id = y.sample_id AND x.feature < y.feature GROUP BY ALL)
SELECT a, j.b AS b, n_ab, CAST(r_ab AS BIGINT) AS r_ab FROM j JOIN s u ON u.feature = a JOIN s v ON v.feature = j.b CROSS JOIN (SELECT count(*) AS n FROM p) t
WHERE n_ab > 3 AND n_ab < t.n - 3 AND u.n - n_ab > 2 AND v.n - n_ab > 2 AND n_ab < 0.9 * (u.n + v.n - n_ab) AND r_ab * u.n * v.n <> u.r * v.r * n_ab""")
def _(calls, feat, pheno):
    rows = materialise(_tag_features(calls, feat))
    return fe.screen_pairs(rows, pheno.where("drug = 'click'").select("sample_id", "pheno"), 3, 2, 0.9)


@query("pair_features", "b_calls b_feat", f"""
WITH {_TAGS}, k AS (SELECT x.feature a, y.feature c FROM b x JOIN b y ON x.sample_id = y.sample_id AND x.feature < y.feature GROUP BY ALL HAVING count(*) > 75)
SELECT sample_id, feature FROM b UNION ALL SELECT x.sample_id, x.feature || '&' || y.feature FROM b x JOIN b y ON x.sample_id = y.sample_id JOIN k ON k.a = x.feature AND k.c = y.feature""")
def _(calls, feat):
    return fe.joint_features(materialise(_tag_features(calls, feat)), 75)


_LOCAL = "l AS (SELECT pos, arg_max(name, start_pos) AS gene FROM (SELECT DISTINCT pos FROM b_calls) JOIN b_feat ON pos BETWEEN start_pos AND end_pos GROUP BY pos), c AS (SELECT DISTINCT sample_id, gene, pos, vtype FROM b_calls JOIN l USING (pos))"


def _local(calls, feat):
    at = iv.last_feature(calls, feat).select("pos", F.col("name").alias("gene"))
    return calls.join(at, "pos").select("sample_id", "gene", "pos", "vtype").distinct()


@query("extended_features", "b_calls b_feat", f"""
WITH {_LOCAL}, k AS (SELECT sample_id, gene FROM c WHERE vtype <> 'snp' GROUP BY ALL)
SELECT sample_id, gene || chr(9) || 'broken' AS feature FROM k UNION SELECT sample_id, unnest([gene || chr(9) || 'changed', gene || chr(9) || pos]) FROM c ANTI JOIN k USING (sample_id, gene)""")
def _(calls, feat):
    return fe.extended(_local(calls, feat))


@query("changed_vocabulary", "b_calls b_feat", f"WITH {_LOCAL} SELECT DISTINCT gene, pos FROM c WHERE vtype = 'snp'")
def _(calls, feat):
    return _local(calls, feat).where("vtype = 'snp'").select("gene", "pos").distinct()


@query("feature_encode", "b_words", "SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS code FROM (SELECT DISTINCT feature FROM b_words)")
def _(words):
    return fe.encode(words)


@query("feature_matrix_counts", "b_words", f"SELECT sample_id, count(*) AS n_features FROM b_words WHERE feature IN {_BAND} GROUP BY sample_id")
def _(words):
    return fe.frequency_band(words, 20).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_features"))


@query("mutual_info_topk", "b_words b_labels", """
WITH t AS (SELECT drug, CAST(count(*) AS DOUBLE) n, CAST(sum(pheno) AS DOUBLE) r FROM b_labels GROUP BY drug), c AS (SELECT drug, feature, sum(pheno) a, sum(1 - pheno) b FROM b_words JOIN b_labels USING (sample_id) GROUP BY ALL),
m AS (SELECT drug, feature, round((CASE WHEN a > 0 THEN a / n * ln(a * n / ((a + b) * r)) ELSE 0 END) + (CASE WHEN b > 0 THEN b / n * ln(b * n / ((a + b) * (n - r))) ELSE 0 END)
 + (CASE WHEN r - a > 0 THEN (r - a) / n * ln((r - a) * n / ((n - a - b) * r)) ELSE 0 END) + (CASE WHEN n - r - b > 0 THEN (n - r - b) / n * ln((n - r - b) * n / ((n - a - b) * (n - r))) ELSE 0 END), 6) AS mi FROM c JOIN t USING (drug))
SELECT drug, feature, mi, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY drug ORDER BY mi DESC, feature) AS rank FROM m) WHERE rank <= 20""")
def _(words, labels):
    return fe.mutual_information(words, labels, 20)


@query("nearest_neighbour", "b_calls b_feat", f"""
WITH {_TAGS}, n AS (SELECT sample_id, count(*) n FROM b GROUP BY sample_id), s AS (SELECT x.sample_id, y.sample_id AS neighbour, count(*) c FROM b x JOIN b y ON x.feature = y.feature AND x.sample_id <> y.sample_id GROUP BY ALL),
d AS (SELECT s.sample_id, neighbour, u.n + v.n - 2 * c AS distance FROM s JOIN n u ON u.sample_id = s.sample_id JOIN n v ON v.sample_id = neighbour)
SELECT sample_id, arg_min(neighbour, (distance, neighbour)) AS neighbour, min(distance) AS distance FROM d GROUP BY sample_id""")
def _(calls, feat):
    rows = materialise(_tag_features(calls, feat))
    return fe.nearest_neighbour(rows, rows)


_ENTRIES = "o AS (SELECT sample_id, gene, gene || ':' || pos AS feature FROM c WHERE vtype = 'snp'), e AS (SELECT drug, gene || ':' || p AS feature, gene FROM (SELECT *, unnest([locus * 10 + 3, locus * 10 + 4]) AS p FROM b_drug_gene))"


def _entries(calls, feat, genes):
    """Dictionary entries at two positions of each gene, what is observed, and genes with an insertion or deletion."""
    rows = materialise(_local(calls, feat))
    named = lambda c: F.concat_ws(":", "gene", c.cast("string")).alias("feature")
    at = genes.select("drug", "gene", F.explode(F.array(F.col("locus") * 10 + 3, F.col("locus") * 10 + 4)).alias("p"))
    return at.select("drug", named(F.col("p")), "gene"), rows.where("vtype = 'snp'").select("sample_id", named(F.col("pos")), "gene"), rows.where("vtype <> 'snp'").select("sample_id", "gene")


@query("dictionary_coverage", "b_calls b_feat b_drug_gene", f"""
WITH {_LOCAL}, {_ENTRIES}, p AS (SELECT feature, count(DISTINCT sample_id) n FROM o GROUP BY feature)
SELECT drug, feature, gene, CASE WHEN n IS NOT NULL THEN 'point' WHEN gene IN (SELECT gene FROM c WHERE vtype <> 'snp') THEN 'broken' WHEN gene IN (SELECT gene FROM o) THEN 'changed' ELSE 'missing' END AS hit, coalesce(n, 0) AS n FROM e LEFT JOIN p USING (feature)""")
def _(calls, feat, genes):
    return fe.dictionary_coverage(*_entries(calls, feat, genes))


@query("dictionary_totals", "b_calls b_feat b_drug_gene", f"""
WITH {_LOCAL}, {_ENTRIES}, s AS (SELECT DISTINCT feature, gene FROM o)
SELECT drug, count(DISTINCT feature) AS n_entries, count(DISTINCT feature) FILTER (feature IN (SELECT feature FROM s)) AS n_present,
 (SELECT count(DISTINCT s.feature) FROM s WHERE s.gene IN (SELECT gene FROM e x WHERE x.drug = e.drug) AND s.feature NOT IN (SELECT feature FROM e x WHERE x.drug = e.drug)) AS n_left FROM e GROUP BY drug""")
def _(calls, feat, genes):
    entries, observed, _ = _entries(calls, feat, genes)
    return fe.dictionary_totals(entries, observed)


@query("membership_groups", "b_words", """
WITH s AS (SELECT feature, string_agg(CAST(sample_id AS VARCHAR), ',' ORDER BY sample_id) m FROM b_words GROUP BY feature), g AS (SELECT m, min(feature) leader, count(*) n FROM s GROUP BY m)
SELECT feature, leader, n FROM s JOIN g USING (m)""")
def _(words):
    return fe.membership_groups(words)


_WIDE = """sc AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS code FROM (SELECT DISTINCT sample_id FROM b_calls)),
 wide AS (SELECT feature, code // 256 AS block, string_agg(CASE WHEN k.sample_id IS NULL THEN '0' ELSE '1' END, '' ORDER BY code) AS line FROM (SELECT DISTINCT feature FROM k) CROSS JOIN sc LEFT JOIN k USING (feature, sample_id) GROUP BY feature, code // 256)"""


def _presence(rows, calls):
    """Lines of 0 and 1 for each feature, a character for each sample."""
    samples = calls.select("sample_id").distinct().withColumn("value", F.lit("0"))
    return co.wide_rows(rows.select("feature", "sample_id").distinct().withColumn("value", F.lit("1")), samples, rows, "feature", "sample_id")


@query("genotype_matrix", "b_calls b_feat", f"WITH {_TAGS}, k AS (SELECT * FROM b WHERE feature IN (SELECT feature FROM b GROUP BY feature HAVING count(*) > 1 AND count(*) < (SELECT count(DISTINCT sample_id) FROM b) - 1)), {_WIDE} SELECT feature, block, line FROM wide")
def _(calls, feat):
    return _presence(fe.frequency_band(materialise(_tag_features(calls, feat)), 1), calls)


@query("fold_phenotypes", "b_labels", """
WITH f AS (SELECT drug, sample_id, pheno, (row_number() OVER (PARTITION BY drug ORDER BY md5(concat('bimbam|', CAST(sample_id AS VARCHAR))), sample_id) - 1) % 5 AS own FROM b_labels)
SELECT drug, sample_id, CAST(fold AS INT) AS fold, CASE WHEN fold = own OR pheno IS NULL THEN 'NA' ELSE CAST(pheno AS VARCHAR) END AS value FROM f CROSS JOIN range(5) t(fold)""")
def _(labels):
    return ph.fold_phenotypes(ph.folds(labels, ["drug"], "sample_id", "bimbam", 5), 5)


@query("stratified_split", "b_labels", """
SELECT drug, sample_id, pheno, CASE WHEN (row_number() OVER (PARTITION BY drug, pheno ORDER BY md5(concat('strata|', CAST(sample_id AS VARCHAR))), sample_id) - 1) % 4 = 0 THEN 'test' ELSE 'train' END AS part FROM b_labels""")
def _(labels):
    rows = ph.folds(labels, ["drug", "pheno"], "sample_id", "strata", 4)
    return rows.select("drug", "sample_id", "pheno", F.when(F.col("fold") == 0, "test").otherwise("train").alias("part"))


@query("presence_table", "b_calls", f"WITH k AS (SELECT DISTINCT sample_id, vtype || '_' || pos AS feature FROM b_calls WHERE vtype <> 'snp'), {_WIDE} SELECT feature, block, line FROM wide")
def _(calls):
    return _presence(calls.where("vtype <> 'snp'").select("sample_id", F.concat_ws("_", "vtype", F.col("pos").cast("string")).alias("feature")), calls)


_DRUGS = ["EMB", "INH", "PZA", "RIF", "STR"]


@query("feature_drug_matrix", "b_drug_gene", "SELECT tag, " + ", ".join(f"CAST(coalesce(max(CAST(drug = '{d}' AS INT)), 0) AS INT) AS \"{d}\"" for d in _DRUGS) + " FROM b_drug_gene GROUP BY tag")
def _(genes):
    return genes.withColumn("one", F.lit(1)).groupBy("tag").pivot("drug", _DRUGS).agg(F.max("one")).fillna(0)


_HITS = "h AS (SELECT DISTINCT drug, sample_id FROM b_words JOIN (SELECT drug, feature FROM (VALUES ('toxic', 'idiot'), ('toxic', 'scum'), ('toxic', 'loser'), ('quality', 'the'), ('quality', 'der')) t(drug, feature)) USING (feature)), p AS (SELECT drug, sample_id, pheno, CASE WHEN h.sample_id IS NULL THEN 0 ELSE 1 END AS pred FROM b_labels LEFT JOIN h USING (drug, sample_id))"


def _predictions(words, labels):
    listed = words.sparkSession.createDataFrame([("toxic", "idiot"), ("toxic", "scum"), ("toxic", "loser"), ("quality", "the"), ("quality", "der")], "drug string, feature string")
    return ev.dictionary_predictions(words, labels, listed)


@query("dictionary_classifier", "b_words b_labels", f"WITH {_HITS} SELECT drug, sample_id, pheno, pred FROM p")
def _(words, labels):
    return _predictions(words, labels)


def _rates(by):
    z = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0 END"
    sens, spec = z("tp", "tp + fn"), z("tn", "tn + fp")
    return (
        f"c AS (SELECT {by}, count(*) FILTER (pheno = 1 AND pred = 1) tp, count(*) FILTER (pheno = 0 AND pred = 1) fp, count(*) FILTER (pheno = 0 AND pred = 0) tn, count(*) FILTER (pheno = 1 AND pred = 0) fn FROM p GROUP BY {by}),"
        f" r AS (SELECT {by}, tp, fp, tn, fn, round({z('tp', 'tp + fp')}, 6) AS ppv, round({z('tn', 'tn + fn')}, 6) AS npv, round({sens}, 6) AS sens, round({spec}, 6) AS spec, round({z('2 * tp', '2 * tp + fp + fn')}, 6) AS f1,"
        f" round(CASE WHEN {sens} + {spec} > 0 THEN 2 * ({sens}) * ({spec}) / ({sens} + {spec}) ELSE 0 END, 6) AS f_ss, round(({sens} + {spec}) / 2, 6) AS auc FROM c)"
    )


@query("metrics", "b_words b_labels", f"WITH {_HITS}, {_rates('drug')} SELECT * FROM r")
def _(words, labels):
    return ev.metrics(_predictions(words, labels), ["drug"])


_FOLDS = "f AS (SELECT *, (row_number() OVER (PARTITION BY drug ORDER BY md5(concat('cv|', CAST(sample_id AS VARCHAR))), sample_id) - 1) % 10 AS fold FROM p)"


@query("metrics_by_fold", "b_words b_labels", f"""
WITH {_HITS.replace('p AS (', 'p0 AS (')}, {_FOLDS.replace('FROM p)', 'FROM p0)')}, p AS (SELECT * FROM f), {_rates('drug, fold')}
SELECT drug, count(*) AS n_folds, round(avg(sens), 6) AS sens, round(avg(spec), 6) AS spec, round(avg(f1), 6) AS f1, round(CAST(sum(tp) AS DOUBLE) / greatest(sum(tp) + sum(fn), 1), 6) AS pooled_sens FROM r GROUP BY drug""")
def _(words, labels):
    folded = ph.folds(_predictions(words, labels), ["drug"], "sample_id", "cv", 10)
    each = ev.metrics(folded, ["drug", "fold"])
    pooled = F.sum("tp") / F.greatest(F.sum("tp") + F.sum("fn"), F.lit(1))
    return each.groupBy("drug").agg(F.count(F.lit(1)).alias("n_folds"), *[F.round(F.avg(c), 6).alias(c) for c in ("sens", "spec", "f1")], F.round(pooled, 6).alias("pooled_sens"))


@query("train_test_split", "b_words b_labels", """
WITH s AS (SELECT drug, sample_id, pheno, (row_number() OVER (PARTITION BY drug ORDER BY md5(concat('split|', CAST(sample_id AS VARCHAR))), sample_id) - 1) % 5 AS fold FROM b_labels), n AS (SELECT sample_id, count(*) n FROM b_words GROUP BY sample_id)
SELECT drug, sample_id, pheno, n AS n_features, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS part FROM s JOIN n USING (sample_id)""")
def _(words, labels):
    n = words.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_features"))
    rows = ph.folds(labels, ["drug"], "sample_id", "split", 5).join(n, "sample_id")
    return rows.select("drug", "sample_id", "pheno", "n_features", F.when(F.col("fold") == 0, "test").otherwise("train").alias("part"))


@query("threshold_grid", "b_labels documents", """
WITH s AS (SELECT drug, pheno, (length(text) % 101) / 100.0 AS score FROM b_labels JOIN documents ON doc_id = sample_id), g AS (SELECT drug, k / 100.0 AS cut, count(*) FILTER ((score >= k / 100.0) = (pheno = 1)) AS correct FROM s CROSS JOIN range(101) t(k) GROUP BY drug, k)
SELECT drug, round(CAST(arg_max(cut, (correct, -cut)) AS DOUBLE), 6) AS cut, max(correct) AS correct FROM g GROUP BY drug""")
def _(labels, documents):
    scores = labels.join(documents.select(F.col("doc_id").alias("sample_id"), ((F.length("text") % 101) / F.lit(100).cast("decimal(5,1)")).alias("score")), "sample_id")
    return ev.best_threshold(scores, ["drug"])


@query("list_split", "b_depth", """
WITH s AS (SELECT sample_id, sum(depth) AS w FROM b_depth GROUP BY sample_id)
SELECT sample_id, CAST(ntile(7) OVER (ORDER BY sample_id) AS INT) AS tile, CAST((row_number() OVER (ORDER BY sample_id) - 1) // 16 AS INT) AS batch, CAST(floor(coalesce(sum(w) OVER (ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 5 / sum(w) OVER ()) AS INT) AS share FROM s""")
def _(depth):
    return fe.list_splits(depth.groupBy("sample_id").agg(F.sum("depth").alias("w")), "sample_id", "w", 7, 16, 5)


@query("coef_filter", "part", "SELECT p_partkey, round(p_retailprice - 950, 6) AS coef FROM part WHERE round(p_retailprice - 950, 6) > 0")
def _(part):
    return part.select("p_partkey", F.round(F.col("p_retailprice") - 950, 6).alias("coef")).where("coef > 0").orderBy(F.desc("coef"), "p_partkey")


#: As the reference has it, and as the graph tests in results.py.
PERMUTATIONS = 100


def _drugs(pheno):
    """The drugs that have labels: a short list."""
    return sorted(r["drug"] for r in pheno.select("drug").distinct().collect())


def _ml(features, pheno, low, k):
    """Vectors of the frequent features with the labels and a fold.

    Features come from whole texts or calls, and are read three times for the band, those in the band four times for the vectors: both are written once.
    """
    every = materialise(features)
    x, _ = ev.vectors(materialise(fe.frequency_band(every, low)))
    folded = ph.folds(pheno, ["drug"], "sample_id", "split", k)
    return materialise(ev.assembled(x, folded.select("sample_id", "drug", "pheno")).join(folded.select("sample_id", "drug", "fold"), ["sample_id", "drug"]))


def _job(make):
    def run(words, labels):
        rows = _ml(words, labels, 60, 5)
        return ev.metrics(ev.fit_predict(rows.where("fold > 0"), rows.where("fold = 0"), ["quality", "toxic"], make), ["drug"])

    return run


query("logreg_l1", "b_words b_labels")(_job(ev.sparse_logistic))
query("forest", "b_words b_labels")(_job(ev.forest))
query("svm", "b_words b_labels")(_job(ev.linear_svm))


@query("cv_models", "b_words b_labels")
def _(words, labels):
    folded = ph.folds(labels, ["drug"], "sample_id", "split", 10)
    judged = mf.cross_validated(fe.frequency_band(materialise(words), 60), folded.select("drug", "sample_id", "pheno", "fold"), 10)
    return ev.metrics(judged, ["drug", "fold"]).groupBy("drug").agg(F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("auc"), 6).alias("auc"), F.count(F.lit(1)).alias("n_folds"))


@query("select_then_fit", "b_words b_labels")
def _(words, labels):
    rows = _ml(words, labels, 60, 5)
    return ev.metrics(ev.select_then_fit(rows.where("fold > 0"), rows.where("fold = 0"), ["quality", "toxic"]), ["drug"])


@query("coef_permutation", "b_words b_labels")
def _(words, labels):
    return mf.coefficient_p_values(fe.frequency_band(materialise(words), 60), labels, PERMUTATIONS)


@query("gene_models", "b_calls b_feat b_pheno")
def _(calls, feat, pheno):
    data = _ml(fe.extended(_local(calls, feat)), pheno, 12, 4)
    return ev.metrics(ev.fit_predict(data.where("fold > 0"), data.where("fold = 0"), _drugs(pheno), ev.sparse_logistic), ["drug"])

"""Phenotype queries."""

from pyspark.sql import functions as F

from cladeworks.operators import identifiers as idn
from cladeworks.operators import phenotype as ph
from cladeworks.plans.registry import query

DRUGS = ["click", "error", "purchase", "signup", "view"]


@query("mic_to_label", "b_mic", """
WITH p AS (SELECT event_id, sample_id, drug, mic, CASE WHEN mic LIKE '<=%' THEN CAST(substr(mic, 3) AS DOUBLE) END le, CASE WHEN mic LIKE '>%' THEN CAST(substr(mic, 2) AS DOUBLE) END gt,
 CASE WHEN mic LIKE '%-%' THEN CAST(split_part(mic, '-', 1) AS DOUBLE) END a, CASE WHEN mic LIKE '%-%' THEN CAST(split_part(mic, '-', 2) AS DOUBLE) END b, CASE drug WHEN 'click' THEN 30 WHEN 'view' THEN 60 ELSE 45 END t FROM b_mic)
SELECT event_id, sample_id, drug, CASE WHEN le <= t THEN 'S' WHEN gt >= t THEN 'R' WHEN b <= t THEN 'S' WHEN a > t THEN 'R' ELSE '-' END AS label FROM p""")
def _(mic):
    limit = F.when(F.col("drug") == "click", 30.0).when(F.col("drug") == "view", 60.0).otherwise(45.0)
    return mic.select("event_id", "sample_id", "drug", ph.mic_label(F.col("mic"), limit).alias("label"))


@query("label_normalise", "b_state", "SELECT node, CAST(CASE WHEN state = 'S' THEN 0 WHEN state = 'R' THEN 1 END AS INT) AS pheno FROM b_state")
def _(state):
    return state.select("node", ph.label(F.col("state")).alias("pheno"))


_WIDE = ", ".join(f"max(pheno) FILTER (drug = '{d}') AS \"{d}\"" for d in DRUGS)


@query("mdr_xdr", "b_pheno", f"""
WITH w AS (SELECT sample_id, {_WIDE} FROM b_pheno GROUP BY sample_id)
SELECT sample_id, CAST(CASE WHEN click = 1 AND error = 1 THEN 1 WHEN click = 0 OR error = 0 THEN 0 END AS INT) AS mdr,
 CAST(CASE WHEN click = 1 AND error = 1 AND purchase = 1 AND view = 1 THEN 1 WHEN click = 0 OR error = 0 OR purchase = 0 OR view = 0 THEN 0 END AS INT) AS xdr,
 CAST(CASE WHEN click = 1 OR error = 1 THEN 0 WHEN click = 0 AND error = 0 THEN 1 END AS INT) AS mdr_s,
 CAST(CASE WHEN click = 1 OR error = 1 OR purchase = 1 OR view = 1 THEN 0 ELSE 1 END AS INT) AS xdr_s FROM w""")
def _(pheno):
    wide = ph.to_wide(pheno, DRUGS)
    two, four = ["click", "error"], ["click", "error", "purchase", "view"]
    return wide.select("sample_id", ph.resistant_to_all(two).alias("mdr"), ph.resistant_to_all(four).alias("xdr"), ph.susceptible_to_all(two, True).alias("mdr_s"), ph.susceptible_to_all(four, False).alias("xdr_s"))


@query("complete_cases", "b_pheno", f"""
WITH w AS (SELECT sample_id, {_WIDE} FROM b_pheno GROUP BY sample_id)
SELECT sample_id, drug, pheno FROM b_pheno WHERE drug IN ('click', 'view', 'error') AND sample_id IN (SELECT sample_id FROM w WHERE click IS NOT NULL AND view IS NOT NULL AND error IS NOT NULL)""")
def _(pheno):
    chosen = ["click", "view", "error"]
    return ph.to_long(ph.to_wide(pheno, DRUGS).dropna(subset=chosen), chosen)


@query("pheno_unpivot", "b_pheno b_calls", "SELECT sample_id, drug, pheno FROM b_pheno WHERE sample_id IN (SELECT sample_id FROM b_calls)")
def _(pheno, calls):
    return ph.to_long(ph.to_wide(pheno, DRUGS).join(calls.select("sample_id").distinct(), "sample_id", "left_semi"), DRUGS)


@query("pheno_pivot", "b_pheno", "SELECT sample_id, " + ", ".join(f"coalesce(CAST(max(pheno) FILTER (drug = '{d}') AS VARCHAR), '-') AS \"{d}\"" for d in DRUGS) + " FROM b_pheno GROUP BY sample_id")
def _(pheno):
    wide = ph.to_wide(pheno, DRUGS)
    return wide.select("sample_id", *[F.coalesce(F.col(d).cast("string"), F.lit("-")).alias(d) for d in DRUGS])


@query("id_resolution", "part supplier", """
WITH n AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT s_name FROM supplier),
a AS (SELECT p_brand AS name, arg_min(p_name, p_partkey) AS id FROM part WHERE p_size > 25 GROUP BY p_brand), b AS (SELECT s_name AS name, arg_min(CAST(s_suppkey AS VARCHAR), s_suppkey) AS id FROM supplier WHERE s_acctbal > 0 GROUP BY s_name)
SELECT n.name, coalesce(a.id, b.id) AS id FROM n LEFT JOIN a USING (name) LEFT JOIN b ON b.name = n.name""")
def _(part, supplier):
    names = part.select(F.col("p_brand").alias("name")).union(supplier.select("s_name"))
    first = part.where("p_size > 25").select(F.col("p_brand").alias("name"), F.col("p_name").alias("id"), F.col("p_partkey").alias("row_idx"))
    second = supplier.where("s_acctbal > 0").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_suppkey").alias("row_idx"))
    return ph.resolve_ids(names, [first, second])


_CHAIN = "SELECT o_orderkey AS row_idx, CASE WHEN o_orderkey % 3 = 0 THEN concat('S', CAST(o_orderkey AS VARCHAR(20))) ELSE 'NA' END AS own, CASE WHEN o_orderkey % 5 < 2 THEN concat('e', CAST(o_custkey AS VARCHAR(20))) ELSE 'NA' END AS run, concat('l', CAST(o_custkey % 700 AS VARCHAR(20))) AS lib FROM {}"
_RUNS = "SELECT concat('e', CAST(l_suppkey * 3 AS VARCHAR(20)), ';e', CAST(l_suppkey AS VARCHAR(20))) AS run, concat('l', CAST(l_partkey % 900 AS VARCHAR(20))) AS lib, CASE WHEN l_linenumber = 7 THEN 'NA' ELSE concat('S', CAST(l_orderkey AS VARCHAR(20))) END AS id, l_orderkey * 10 + l_linenumber AS row_idx FROM {}"


@query("id_chain", "orders lineitem", f"""
WITH o AS ({_CHAIN.format('orders')}), m AS ({_RUNS.format('lineitem')}),
r AS (SELECT split_part(run, ';', 1) AS name, arg_min(id, (row_idx, id)) AS id FROM m WHERE id <> 'NA' GROUP BY ALL), b AS (SELECT lib AS name, arg_min(id, (row_idx, id)) AS id FROM m WHERE id <> 'NA' GROUP BY ALL)
SELECT row_idx, CASE WHEN own <> 'NA' THEN own WHEN run <> 'NA' THEN r.id ELSE b.id END AS id, CASE WHEN own <> 'NA' THEN 'own' WHEN run <> 'NA' THEN 'run' ELSE 'lib' END AS via FROM o LEFT JOIN r ON r.name = run LEFT JOIN b ON b.name = lib""")
def _(orders, lineitem):
    spark = orders.sparkSession
    rows, table = spark.sql(_CHAIN.format("{o}"), o=orders), spark.sql(_RUNS.format("{l}"), l=lineitem)
    return idn.resolve_chain(rows, "own", [("run", idn.first_ids(table, "run", "id", "row_idx")), ("lib", idn.first_ids(table, "lib", "id", "row_idx"))]).select("row_idx", "id", "via")


@query("id_substring", "b_words pages", "SELECT name, min(page_id) AS row_idx FROM (SELECT DISTINCT feature AS name FROM b_words) LEFT JOIN pages ON contains(url, name) GROUP BY name")
def _(words, pages):
    return idn.first_line(words.select(F.col("feature").alias("name")), pages.select(F.col("page_id").alias("row_idx"), F.col("url").alias("line")))


@query("id_report", "b_words pages", """
WITH n AS (SELECT DISTINCT feature AS name FROM b_words), k AS (SELECT name FROM n WHERE contains(name, 'th')), x AS (SELECT name FROM n WHERE length(name) = 9 AND NOT contains(name, 'th')),
f AS (SELECT name, arg_min(regexp_extract(url, '/([a-z]+)[.]', 1), page_id) AS id, min(page_id) AS p FROM n LEFT JOIN pages ON contains(url, name) WHERE name NOT IN (SELECT name FROM k UNION SELECT name FROM x) GROUP BY name),
g AS (SELECT *, min(name) OVER (PARTITION BY id) AS first FROM f WHERE p IS NOT NULL)
SELECT name, name AS id, 'kept' AS status FROM k UNION ALL SELECT name, name, 'excluded' FROM x UNION ALL SELECT name, id, CASE WHEN id IN (SELECT name FROM k) OR name <> first THEN 'repeat' ELSE 'renamed' END FROM g UNION ALL SELECT name, NULL, 'unmatched' FROM f WHERE p IS NULL""")
def _(words, pages):
    names = words.select(F.col("feature").alias("name"))
    lines = pages.select(F.col("page_id").alias("row_idx"), F.col("url").alias("line"), F.regexp_extract("url", "/([a-z]+)[.]", 1).alias("id"))
    return idn.standard_names(names, lines, names.where("length(name) = 9"), "th")


@query("id_lists", "lineitem supplier", """
WITH g AS (SELECT l_orderkey AS grp, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey) AS m FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1),
r AS (SELECT grp, unnest(range(len(m))) AS place, unnest(m) AS member FROM g), k AS (SELECT grp, arg_max(member, place) AS kept FROM r WHERE member IN (SELECT CAST(s_suppkey * 7 AS VARCHAR) FROM supplier) GROUP BY grp)
SELECT grp, member, member = k.kept AS kept FROM r JOIN k USING (grp)""")
def _(lineitem, supplier):
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    groups = lineitem.groupBy(F.col("l_orderkey").alias("grp")).agg(F.array_join(F.transform(order, lambda x: x["l_partkey"].cast("string")), ";").alias("members"))
    return idn.listed_members(groups, supplier.select((F.col("s_suppkey") * 7).cast("string").alias("id")))


@query("organism_filter", "customer nation", """
SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT contains(n_name, 'AN')""")
def _(customer, nation):
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.where(~F.contains(F.col("n_name"), F.lit("AN"))).select("c_custkey", "n_name")


@query("organism_lookup", "orders customer supplier", """
WITH i AS (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN concat('SAM', CAST(o_custkey AS VARCHAR)) ELSE concat('ERR', CAST(o_custkey % 150 AS VARCHAR)) END AS id FROM orders)
SELECT id, CASE WHEN id LIKE 'SAM%' THEN (SELECT min(c_mktsegment) FROM customer WHERE concat('SAM', CAST(c_custkey AS VARCHAR)) = id) ELSE (SELECT min(concat('org', CAST(s_nationkey AS VARCHAR))) FROM supplier WHERE concat('ERR', CAST(s_suppkey AS VARCHAR)) = id) END AS organism FROM i""")
def _(orders, customer, supplier):
    named = lambda p, c: F.concat(F.lit(p), c.cast("string")).alias("id")
    ids = orders.select(F.when(F.col("o_orderkey") % 2 == 0, named("SAM", F.col("o_custkey"))).otherwise(named("ERR", F.col("o_custkey") % 150)).alias("id"))
    runs = supplier.select(named("ERR", F.col("s_suppkey")), F.concat(F.lit("org"), F.col("s_nationkey").cast("string")).alias("organism"))
    return ph.organism_of(ids, runs, customer.select(named("SAM", F.col("c_custkey")), F.col("c_mktsegment").alias("organism")))


@query("cluster_best", "b_words b_labels", """
WITH s AS (SELECT sample_id, string_agg(feature, chr(10) ORDER BY feature) AS m FROM b_words GROUP BY sample_id), c AS (SELECT sample_id, min(sample_id) OVER (PARTITION BY m) AS cluster, count(*) OVER (PARTITION BY m) AS n FROM s),
r AS (SELECT drug, count(*) AS n FROM b_labels GROUP BY drug), k AS (SELECT sample_id, min(n) AS rarest, count(*) AS labels FROM b_labels JOIN r USING (drug) GROUP BY sample_id),
o AS (SELECT cluster, sample_id, row_number() OVER (PARTITION BY cluster ORDER BY rarest ASC NULLS LAST, labels DESC NULLS LAST, sample_id) AS place FROM c LEFT JOIN k USING (sample_id) WHERE n > 1)
SELECT cluster, sample_id FROM o WHERE place = 1""")
def _(words, labels):
    from cladeworks.operators.compare import same_members

    links = same_members(words, "sample_id", "feature").select(F.col("first").alias("a"), F.col("sample_id").alias("b"))
    return ph.best_of_clusters(links, labels)


ALIASES = {"click": ["INH"], "view": ["RIF", "RFB"], "error": ["AMK", "KAN", "CAP"]}


@query("drug_alias_expand", "b_mic", """
WITH a AS (SELECT * FROM (VALUES ('click', 'INH'), ('view', 'RIF'), ('view', 'RFB'), ('error', 'AMK'), ('error', 'KAN'), ('error', 'CAP')) t(code, name))
SELECT event_id AS feature, name AS drug FROM b_mic JOIN a ON code = drug""")
def _(mic):
    return ph.expand_aliases(mic.select(F.col("event_id").alias("feature"), F.col("drug").alias("code")), ALIASES)

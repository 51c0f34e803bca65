"""Views that give the driver's tables the shape of the domain, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cladeworks.operators.genome import laid_out

VIEWS = {
    "b_calls": """SELECT CAST(l_suppkey AS BIGINT) AS sample_id, CAST(l_partkey*10+l_linenumber AS BIGINT) AS pos,
 CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'C' ELSE 'G' END AS alt,
 CASE WHEN l_linenumber=6 THEN 'del' WHEN l_linenumber=7 THEN 'ins' ELSE 'snp' END AS vtype,
 CAST(l_quantity AS BIGINT) AS cov, CAST(floor(l_extendedprice/1000) AS BIGINT) AS qual,
 CAST(round(l_discount*1000) AS BIGINT) AS mqm, l_linestatus AS callset FROM {lineitem}""",
    "b_feat": """SELECT concat('g',CAST(p_partkey AS VARCHAR(20))) AS name, CAST(p_partkey*10+1 AS BIGINT) AS start_pos,
 CAST(p_partkey*10+p_size AS BIGINT) AS end_pos, CASE WHEN p_partkey%2=0 THEN 1 ELSE -1 END AS strand,
 CASE WHEN p_size%5=0 THEN 'rRNA' WHEN p_size%7=0 THEN 'upstream' ELSE 'Gene' END AS ftype,
 p_brand AS tag, p_partkey%11=0 AS is_pseudogene FROM {part}""",
    "b_pheno": """SELECT CAST(user_id AS BIGINT) AS sample_id, event_type AS drug,
 CASE WHEN sum(CAST(floor(value) AS BIGINT)) > 48*count(*) THEN 1 ELSE 0 END AS pheno FROM {events} GROUP BY user_id, event_type""",
    "b_mic": """SELECT event_id, CAST(user_id AS BIGINT) AS sample_id, event_type AS drug, CASE event_id%4
 WHEN 0 THEN concat('<=',CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20)))
 WHEN 1 THEN concat('>',CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20)))
 WHEN 2 THEN concat(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20)),'-',CAST(CAST(floor(value) AS BIGINT)+20 AS VARCHAR(20)))
 ELSE 'NA' END AS mic FROM {events}""",
    "b_labels": """SELECT doc_id AS sample_id, 'quality' AS drug, quality AS pheno FROM {labels}
 UNION ALL SELECT doc_id, 'toxic', toxic FROM {labels}""",
    "b_tree": """SELECT CAST(c_custkey AS BIGINT) AS child,
 CASE WHEN c_custkey=0 THEN NULL ELSE CAST(floor((c_custkey-1)/2.0) AS BIGINT) END AS parent,
 CAST(floor(abs(c_acctbal)) AS BIGINT) AS dist FROM {customer}""",
    "b_state": """SELECT CAST(c_custkey AS BIGINT) AS node, CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'R' ELSE 'S' END AS state FROM {customer}""",
    "b_bases": """SELECT CAST(o_custkey AS BIGINT) AS node, CAST(l_suppkey*2+1 AS BIGINT) AS pos,
 substring('ACGT',CAST(1+sum(CAST(l_quantity AS BIGINT))%4 AS INT),1) AS base FROM {lineitem} JOIN {orders} ON l_orderkey=o_orderkey GROUP BY o_custkey, l_suppkey""",
    "b_indels": """SELECT DISTINCT CAST(o_custkey AS BIGINT) AS node, CASE WHEN l_linenumber=6 THEN concat('del_',CAST(l_suppkey*2+1 AS VARCHAR(20)),'_',CAST(l_partkey%3+1 AS VARCHAR(20)))
 ELSE concat('ins_',CAST(l_suppkey*2+1 AS VARCHAR(20)),'_',substring('ACGTACGT',CAST(l_partkey%4+1 AS INT),CAST(l_partkey%3+1 AS INT))) END AS key FROM {lineitem} JOIN {orders} ON l_orderkey=o_orderkey WHERE l_linenumber IN (6,7)""",
    "b_drug_state": """SELECT CAST(c_custkey AS BIGINT) AS node, 'RIF' AS drug, CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'R' ELSE 'S' END AS state FROM {customer}
 UNION ALL SELECT CAST(c_custkey AS BIGINT), 'INH', CASE WHEN c_nationkey%3=0 THEN 'R' ELSE 'S' END FROM {customer} UNION ALL SELECT CAST(c_custkey AS BIGINT), 'EMB', CASE WHEN c_acctbal<2000 THEN 'R' ELSE 'S' END FROM {customer}
 UNION ALL SELECT CAST(c_custkey AS BIGINT), 'PZA', CASE WHEN c_custkey%7=0 THEN 'R' ELSE 'S' END FROM {customer} WHERE c_custkey%5<>0""",
    "b_depth": """SELECT CAST(l_suppkey AS BIGINT) AS sample_id, CAST(l_partkey AS BIGINT) AS pos,
 CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS depth FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    "b_edges": """SELECT DISTINCT CAST(a.l_partkey AS BIGINT) AS src, CAST(b.l_partkey AS BIGINT) AS dst FROM {lineitem} a JOIN {lineitem} b
 ON a.l_orderkey=b.l_orderkey AND a.l_partkey<>b.l_partkey""",
    "b_reads": """SELECT CAST(floor(o_orderkey/2.0) AS BIGINT)%20 AS sample_id, CAST(floor(o_orderkey/2.0) AS BIGINT) AS qname, CAST(o_orderkey%2 AS BIGINT) AS mate,
 (CAST(floor(o_orderkey/2.0) AS BIGINT)*37)%20000+1+(o_orderkey%2)*(100+o_custkey%200) AS start_pos,
 (CAST(floor(o_orderkey/2.0) AS BIGINT)*37)%20000+100+(o_orderkey%2)*(100+o_custkey%200) AS end_pos,
 CAST(floor(o_totalprice) AS BIGINT)%60 AS mapq, o_orderstatus<>'F' AS is_proper FROM {orders}""",
    "b_drug_gene": """SELECT CASE p_size%5 WHEN 0 THEN 'INH' WHEN 1 THEN 'RIF' WHEN 2 THEN 'EMB' WHEN 3 THEN 'PZA' ELSE 'STR' END AS drug,
 concat('g',CAST(p_partkey AS VARCHAR(20))) AS gene, p_brand AS tag, CAST(p_partkey AS BIGINT) AS locus FROM {part}""",
    "b_words": {
        "spark": "SELECT DISTINCT doc_id AS sample_id, w AS feature FROM (SELECT doc_id, explode(split(lower(text),'[^a-z]+')) AS w FROM {documents}) WHERE w<>''",
        "duckdb": "SELECT DISTINCT doc_id AS sample_id, w AS feature FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text),'[^a-z]+')) AS w FROM {documents}) WHERE w<>''",
    },
    # Spark has the reference in pieces; DuckDB, which looks a few bases up, as one string.
    "b_ref": {
        "spark": lambda spark, sf_dir: laid_out(spark.sql("SELECT doc_id, regexp_replace(translate(lower(text),'abcdefghijklmnopqrstuvwxyz','ACGTACGTACGTACGTACGTACGTAC'),'[^ACGT]','') AS seq FROM {documents} WHERE text IS NOT NULL", documents=spark.read.parquet(f"{sf_dir}/documents.parquet")), "doc_id"),
        "duckdb": "SELECT string_agg(regexp_replace(translate(lower(text),'abcdefghijklmnopqrstuvwxyz','ACGTACGTACGTACGTACGTACGTAC'),'[^ACGT]','','g'), '' ORDER BY doc_id) AS seq FROM {documents}",
    },
}
_TABLE = re.compile(r"\{(\w+)\}")


def _text(name: str, engine: str) -> str | Callable[[SparkSession, str], DataFrame]:
    text = VIEWS[name]
    return text if isinstance(text, str) else text[engine]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding view, or a driver table under its own name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _text(name, "spark")
    if callable(text):
        return text(spark, sf_dir)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_TABLE.findall(text))})


def with_views(names: list[str], sql: str) -> str:
    """DuckDB SQL with the binding views in front."""
    parts = [f"{n} AS ({_TABLE.sub(r'\1', _text(n, 'duckdb'))})" for n in names if n in VIEWS]
    body = sql.strip()
    if not parts:
        return body
    head = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else "WITH "
    rest = re.sub(r"(?i)^WITH( RECURSIVE)?\s+", "", body)
    return head + ", ".join(parts) + (", " if rest != body else " ") + rest

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm import audit, chat, decontaminate, divergence, langid, linededup, pieces, pii, quality, simhash, topk, toxicity, urlfilter
from cladeworks.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.whole_vectors(table(spark, sf_dir, "embeddings")), every=50)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_and_decode(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Rules of the registered query: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "verdict string, host string, path string"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_toxicity": op2_toxicity,
        "op3_decontaminate": op3_decontaminate,
        "op4_simhash": op4_simhash,
        "op5_topk": op5_topk,
        "op6_quality": op6_quality,
        "op7_language": op7_language,
        "op8_pieces": op8_pieces,
        "op9_line_dedup": op9_line_dedup,
        "op10_chat": op10_chat,
        "op11_filter_audit": op11_filter_audit,
        "op12_url_filter": op12_url_filter,
        "op13_source_divergence": op13_source_divergence,
    }


def _op1_sql() -> str:
    """Spans from the plain patterns: pieces and matches alternate, so lengths add up to starts."""
    digits = r"regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (
        f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT)"
        " ELSE (CAST(c AS INT) * 2) // 10 + (CAST(c AS INT) * 2) % 10 END)) % 10 = 0"
    )
    alone = "NOT regexp_matches(prior, '[A-Za-z0-9+.-]') AND NOT regexp_matches(after, '[A-Za-z0-9]')"
    mod97 = (
        "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''),"
        " lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ord(c) - 48 ELSE ord(c) - 55 END)), lambda a, v: (a * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97) = 1"
    )
    near = lambda words: f"regexp_matches(lower(beside), '(^|[^a-z])({words})([^a-z]|$)')"
    byte = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", f"regexp_matches(m, '^{byte}([.]{byte}){{3}}$')"),
        ("card", r"[0-9](?:[ -]?[0-9])+", f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {luhn} ELSE false END"),
        ("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({digits}) BETWEEN 10 AND 15"),
        ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", f"CASE WHEN length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND {alone} THEN {mod97} ELSE false END"),
        ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", f"{alone} AND NOT regexp_matches(m, '^(000|666|9)|-00-|0000$') AND {near('ssn|social security|security number')}"),
        ("phone_local", r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}", f"{alone} AND {near('phone|tel|call|mobile|fax|whatsapp')}"),
    ]
    parts = []
    for rank, (name, pattern, valid) in enumerate(kinds):
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{name}' AS kind, s, s + length(m) AS e FROM (SELECT *, CASE WHEN s = 0 THEN '' ELSE substr(text, s, 1) END AS prior,"
            " substr(text, s + length(m) + 1, 1) AS after, CASE WHEN s = 0 THEN '' ELSE substr(text, greatest(1, s - 39), least(s, 40)) END AS beside FROM"
            " (SELECT doc_id, text, m[i] AS m, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s"
            f" FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, text, regexp_split_to_array(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m FROM documents))))"
            f" WHERE {valid}"
        )
    said = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return (
        f"WITH f AS ({' UNION ALL '.join(parts)}) SELECT d.doc_id, "
        + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in kinds[:4])
        + f", sha256(coalesce(string_agg({said}, ',' ORDER BY s, rank) FILTER (rank < 4), '')) AS base_sha256, coalesce(string_agg({said}, ',' ORDER BY s, rank), '') AS spans"
        " FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id"
    )


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
 SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + length('### :  </turn>.') AS size FROM c WHERE conv_id IS NOT NULL)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: Alignments by three equal words in a row (every accepted window holds such a run), then every window in full; short items word for word.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, w FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
dt AS (SELECT doc_id, p, concat_ws(' ', w[p], w[p+1], w[p+2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
bt AS (SELECT item_id, p, concat_ws(' ', w[p], w[p+1], w[p+2]) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS p FROM b)),
a AS (SELECT DISTINCT doc_id, item_id, dt.p - bt.p AS o FROM dt JOIN bt USING (g)),
m AS (SELECT doc_id, item_id, least(len(b.w), 13) AS n_window,
  list_transform(range(1, len(b.w) + 1), lambda j: CASE WHEN o + j >= 1 AND d.w[o + j] = b.w[j] THEN 1 ELSE 0 END) AS e
  FROM a JOIN d USING (doc_id) JOIN b USING (item_id) WHERE len(b.w) >= 8),
s AS (SELECT doc_id, item_id, n_window, list_max(list_transform(range(1, len(e) - n_window + 2), lambda s: list_sum(e[s : s + n_window - 1]))) AS n_equal FROM m)
SELECT doc_id, item_id, CAST(max(n_window) AS BIGINT) AS n_window, CAST(max(n_equal) AS BIGINT) AS n_equal
FROM (SELECT * FROM s WHERE 5 * n_equal >= 4 * n_window UNION ALL
 SELECT doc_id, item_id, len(b.w), len(b.w) FROM b JOIN d ON len(b.w) < 8 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' '))
GROUP BY doc_id, item_id
"""

OP9_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
t AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(string_split_regex(line, '[ \t\x0B\f\r]+'), lambda x: x <> ''))) AS s FROM l),
f AS (SELECT s, len(s) AS n, min((doc_id, line_no)) AS o, row_number() OVER (ORDER BY min((doc_id, line_no))) AS id FROM t WHERE len(s) > 0 GROUP BY s),
w AS (SELECT id, n, unnest(s) AS w FROM f),
c AS (SELECT w, count(*) AS df FROM w GROUP BY w),
p AS (SELECT id, n, w FROM (SELECT id, n, w.w, row_number() OVER (PARTITION BY id ORDER BY df, w.w) AS k FROM w JOIN c USING (w)) WHERE k <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.w = b.w AND a.id < b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
near AS (SELECT DISTINCT b FROM pairs JOIN f x ON x.id = a JOIN f y ON y.id = b WHERE 9 * len(list_intersect(x.s, y.s)) >= 4 * (x.n + y.n)),
gone AS (SELECT t.doc_id, t.line_no FROM t JOIN f USING (s) WHERE (t.doc_id, t.line_no) <> f.o OR f.id IN (SELECT b FROM near))
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, count(g.line_no) AS n_removed,
 coalesce(string_agg(CAST(g.line_no AS VARCHAR), ',' ORDER BY g.line_no), '') AS removed
FROM documents d LEFT JOIN gone g ON g.doc_id = d.doc_id WHERE d.doc_id IS NOT NULL GROUP BY d.doc_id, text
"""


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM t),
m AS (SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > first_id, false) AS INT) AS m,
  coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic FROM w),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY part, m),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a JOIN l b ON b.f <> a.f JOIN l c ON c.f NOT IN (a.f, b.f) JOIN l d ON d.f NOT IN (a.f, b.f, c.f) JOIN l e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS (SELECT filter_order, step, f, b, (SELECT CAST(coalesce(sum(y.b), 0) AS INT) FROM l y WHERE instr(filter_order, y.f) < step) AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o) JOIN l ON f = filter_order[step]),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, f, CAST(coalesce(sum(n) FILTER (m & (before | b) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (m & b <> 0 AND m & before = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (m & b <> 0 AND m & before <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (m = b), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(g) FILTER (m & b <> 0 AND m & before = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(x) FILTER (m & b <> 0 AND m & before = 0), 0) AS BIGINT) AS toxic_lost
  FROM c CROSS JOIN s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op12_sql(rounds: int = 20) -> str:
    """Rules by a lookup for each page; the rounds of propagation one below the other."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    link = urlfilter.LINK.replace("'", "''")
    own = f"SELECT kind, host, units * {urlfilter.KEEP} // {urlfilter.WHOLE} AS score FROM seeds"
    steps = [f"s0 AS MATERIALIZED ({own})"]
    for i in range(rounds):
        steps.append(
            f"s{i + 1} AS MATERIALIZED (SELECT kind, host, CAST(sum(score) AS BIGINT) AS score FROM ({own} UNION ALL SELECT kind, dst, score * {urlfilter.PASS} // (degree * {urlfilter.WHOLE})"
            f" FROM ways JOIN s{i} ON s{i}.kind = ways.kind AND s{i}.host = src) GROUP BY kind, host)".replace("SELECT kind, dst, score", "SELECT ways.kind, dst, score")
        )
    return f"""
WITH rules(verdict, rh, rp) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS row, page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT row, page_id, html, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
k AS (SELECT row, arg_max(struct_pack(rule := rh || rp, verdict := verdict), (length(rh || rp), verdict)) AS b FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY row),
r AS MATERIALIZED (SELECT page_id, host, path, b.rule AS rule, b.verdict AS verdict FROM h LEFT JOIN k USING (row)),
seeds AS MATERIALIZED (SELECT verdict AS kind, host, count(*) * {urlfilter.UNIT} AS units FROM r WHERE verdict IS NOT NULL GROUP BY verdict, host),
e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT host AS src, {_LOWER.format("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM h WHERE host <> '') WHERE src <> dst),
w AS (SELECT 'allow' AS kind, src, dst FROM e UNION ALL SELECT 'block', dst, src FROM e),
ways AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY kind, src) AS degree FROM w),
{", ".join(steps)},
g AS (SELECT host, CAST(coalesce(sum(score) FILTER (kind = 'allow'), 0) AS BIGINT) AS trust, CAST(coalesce(sum(score) FILTER (kind = 'block'), 0) AS BIGINT) AS distrust FROM s{rounds} GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM r LEFT JOIN g ON g.host = r.host
"""


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(total) AS ln FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(gn, 0) AS gn, coalesce(v, 0) AS v, coalesce(ln, 0) AS ln FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS gn FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN l USING (lang)),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 1) // (gn + v) AS p, 1 + 1000000000 * (total + 1) // (ln + v) AS q FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
w AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": _op1_sql(), "op5_topk": OP5_SQL, "op10_chat": OP10_SQL, "op3_decontaminate": OP3_SQL, "op9_line_dedup": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_url_filter": _op12_sql(), "op13_source_divergence": OP13_SQL}

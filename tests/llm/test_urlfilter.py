"""Url rules, the link graph and the spread of trust against plain versions."""

import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa

from cladeworks.llm import queries, urlfilter

PAGES = "page_id long, url string, html string"
RULES = "verdict string, host string, path string"


def plain(pages, rules, rounds=20):
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    rows, edges = [], set()
    for i, url, html in pages:
        host, path = "", ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path, host = re.match(r"[^?#]*", rest[len(host):])[0], low(host)
        fit = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rows.append((i, host, path, max(fit)[2] if fit else None, max(fit)[1] if fit else None))
        if host and html:
            edges |= {(host, low(d)) for d in re.findall(r"""(?i:href|src|action)[ \t\r\n]*=[ \t\r\n]*["']?[ \t\r\n]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'<> \t\r\n]+)""", html)}
    edges = {e for e in edges if e[0] != e[1]}
    scores = {}
    for kind, ways in (("allow", edges), ("block", {(b, a) for a, b in edges})):
        degree = Counter(a for a, _ in ways)
        units = Counter(h for _, h, _, _, v in rows if v == kind)
        own = {h: n * 1_000_000 * 3 // 20 for h, n in units.items()}
        state = dict(own)
        for _ in range(rounds):
            after = defaultdict(int, own)
            for a, b in ways:
                after[b] += state.get(a, 0) * 17 // (degree[a] * 20)
            state = after
        scores[kind] = state
    t, d = scores["allow"], scores["block"]
    return [(i, h, p, r, v or ("block" if d.get(h, 0) > t.get(h, 0) else "allow"), t.get(h, 0), d.get(h, 0)) for i, h, p, r, v in rows]


def a(*hosts):
    return "".join(f'<a href="https://{h}/x">y</a>' for h in hosts)


CASES = [
    (1, "http://A.Org/x?u=://b/", a("hub.net", "B.net") + "<img src='//c.net/p'>"), (2, "https://shop.com/de/1", a("hub.net")), (3, "https://shop.com/en/1#x/fr/", None), (4, "x.example.org/es/", ""),
    (5, "http://x.example.org/es/1", a("shop.com")), (6, "http://example.org/en/123", None), (7, "http://notexample.org/en/1", a("shop.com")), (8, "http://org", None), (9, "http://com/fr/", a("com")), (10, None, a("q.net")),
    (None, "ftp://hub.net?x", a("c.net", "shop.com")), (11, "http://link.farm/", a("shop.com", "spam.com")), (11, "http://link.farm/", a("shop.com", "spam.com")), (12, "http://spam.com/de/", "<form action = //link.farm>"),
    (13, "http://c.net/" + "y" * 30_000, "z" * 100_000 + a("d.net")), (14, "http://d.net/", None), (15, "://", None), (16, "http://h..net/\nz", a("c.net")), (17, "http://B.net", a("shop.com")),
]


def test_judge_equals_plain(spark):
    got = urlfilter.judge(spark.createDataFrame(CASES, PAGES), spark.createDataFrame(queries.URL_RULES, RULES))
    key = lambda r: tuple((x is not None, x) for x in r)
    rows = sorted(map(tuple, got.collect()), key=key)
    assert rows == sorted(plain(CASES, queries.URL_RULES), key=key)
    verdict = {r[1]: r[4] for r in rows if r[3] is None}
    assert verdict["link.farm"] == "block" and verdict["c.net"] == "allow"


def test_sql_spreads_trust_alike(spark):
    con = duckdb.connect()
    pages = pa.table({"page_id": [c[0] for c in CASES], "url": [c[1] for c in CASES], "html": [c[2] for c in CASES]})  # noqa: F841
    want = con.execute(queries.oracle_sql()["op12_url_filter"]).fetchall()
    assert sorted(want, key=repr) == sorted(plain(CASES, queries.URL_RULES), key=repr)


def test_no_pages_no_rules_and_equal_rules(spark):
    empty = urlfilter.judge(spark.createDataFrame([], PAGES), spark.createDataFrame(queries.URL_RULES, RULES))
    assert empty.collect() == [] and "verdict" in empty.columns
    free = urlfilter.judge(spark.createDataFrame(CASES[:3], PAGES), spark.createDataFrame([], RULES))
    assert {(r["rule"], r["verdict"]) for r in free.collect()} == {(None, "allow")}
    both = urlfilter.judge(spark.createDataFrame([(1, "http://a.b/c", None, 1, 2)], PAGES + ", host int, verdict int"), spark.createDataFrame([("allow", "b", "/c"), ("block", "b", "/c")], RULES))
    assert [tuple(r)[:5] for r in both.collect()] == [(1, "a.b", "/c", "b/c", "block")]

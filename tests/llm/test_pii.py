import random
import re

from pyspark.sql import functions as F

from cladeworks.llm import pii

SCHEMA = "doc_id long, text string, spans string, p_0 int"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate([
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(6)
    parts = ["a.b@c.de", "x@y", "@@", "a@b.c_d@e.f.g", "1.2.3.4", "256.1.1.1", "001.02.3.255.9.8.7.6", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004",
             "+1 (415) 555-2671", "+1234", "+44 20 7946 0958.", "é", "日本", "\U0001f600", " ", "\n", "-", ".", "7", "12", "+", "ab", "1 2 3", "%", "user+tag@ex-ample.co.uk."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    texts += [None, "", "9" * 30_000, "a" * 30_000, "1 " * 20_000, "a@b." * 5_000, "+" * 1000 + "1", "4111 1111 1111 1111 " * 300, "1.1.1.1." * 3000]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "me@x.org", "x", 1), (0, texts[0], "x", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = pii.find_pii(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert [(s["start"], s["rank"], s["stop"], s["kind"]) for s in r["spans"] if s["rank"] < 4] == base(texts[r["doc_id"]])
            assert all(s["text"] == texts[r["doc_id"]][s["start"] : s["stop"]] for s in r["spans"])
    assert pii.digests(frame.where(F.lit(False))).count() == 0


def test_spans_that_the_method_adds(spark):
    texts = ["Account GB29 NWBK 6016 1331 9268 19 ok", "GB29 NWBK 6016 1331 9268 18", "ssn: 123-45-6789", "123-45-6789", "SSN 000-12-3456", "call 415-555-2671 now", "415-555-2671", "XGB29NWBK60161331926819"]
    got = {r["doc_id"]: [(s["kind"], s["text"]) for s in r["spans"] if s["rank"] > 3] for r in pii.find_pii(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert got == {0: [("iban", "GB29 NWBK 6016 1331 9268 19")], 1: [], 2: [("ssn", "123-45-6789")], 3: [], 4: [], 5: [("phone_local", "415-555-2671")], 6: [], 7: []}

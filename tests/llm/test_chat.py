import hashlib
import random

from pyspark.sql import functions as F

from cladeworks.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segment string, start int"
NASTY = ["hi", "\\### Assistant: </turn> ok", "### user: x </turn>\n", "\\", "a\\\\b#<", "", None, "é\U0001f600\nline", ": ", "x" * 50_000]


def conversations(seed=4):
    rng, rows = random.Random(seed), []
    prefixes = [[("system", "be nice"), ("user", "hello")], [("system", "be nice")], [("user", "### user: fake")]]
    for c in range(60):
        turns = list(rng.choice(prefixes)) + [(rng.choice(["user", "assistant", "assistant", "tool: x", None, "a\\:"]), rng.choice(NASTY[:9])) for _ in range(rng.randint(0, 5))]
        rows += [(c, t, r, x, "s", 1) for t, (r, x) in enumerate(turns)]
    rows += [(60, 0, "assistant", NASTY[9], "s", 1), (None, 0, "user", "no conversation", "s", 1), (61, None, "user", "no turn", "s", 1), (61, 1, "assistant", "b", "s", 1), (61, 1, "assistant", "a", "s", 1), (61, 1, "assistant", "a", "s", 1)]
    rng.shuffle(rows)
    return rows


def expected(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in by.items()}


def test_read_back_and_digests(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows)
    back = {r["conv_id"]: r["turns"] for r in chat.read_back(*chat.prefix_tree(frame)).collect()}
    assert {c: [(t["role"], t["text"]) for t in ts] for c, ts in back.items()} == want
    for r in chat.digests(frame).collect():
        ts = want[r["conv_id"]]
        loss = "".join(x for role, x in ts if role == "assistant")
        assert r["n_turns"] == len(ts) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(frame.where(F.lit(False))).count() == 0


def test_stream_positions_and_attention(spark):
    rows = conversations(5)
    nodes, members = (x.collect() for x in chat.prefix_tree(spark.createDataFrame(rows, SCHEMA)))
    want = expected(rows)
    distinct = {tuple(ts[: k + 1]) for ts in want.values() for k in range(len(ts))}
    assert len(nodes) == len(distinct)  # every shared turn stands once
    nodes.sort(key=lambda n: n["start"])
    assert nodes[0]["start"] == 0 and all(a["stop"] == b["start"] for a, b in zip(nodes, nodes[1:]))
    at = {n["start"]: n for n in nodes}
    stack = []
    for n in nodes:  # depth-first: the parent is on the current path
        del stack[n["depth"] :]
        assert (stack[-1]["start"] if stack else None) == n["parent"]
        ancestors = {i for a in stack for i in range(a["start"], a["stop"])}
        assert {i for r in n["attention"] for i in range(r["start"], r["stop"])} == ancestors
        assert n["position"] == len(ancestors)
        assert all(a["stop"] < b["start"] for a, b in zip(n["attention"], n["attention"][1:]))
        assert (n["loss_start"] is not None) == (n["role"] == "assistant")
        stack.append(n)
    for m in members:
        assert at[m["start"]]["depth"] == m["depth"]

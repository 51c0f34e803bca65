import itertools
import random
import re

from pyspark.sql import functions as F

from cladeworks.llm import decontaminate as dc

SCHEMA, ITEMS = "doc_id long, text string, item_id string, words int", "item_id long, text string, doc_id int"


def brute(rows, items):
    found = {}
    for i, text, *_ in rows:
        d = re.findall(r"[^\W_]+", (text or "").lower())
        for k, t, *_ in items:
            b = re.findall(r"[^\W_]+", (t or "").lower())
            if i is None or k is None or not b:
                continue
            w = min(13, len(b))
            for off in range(-len(b), len(d)):
                eq = [0 <= off + j < len(d) and d[off + j] == x for j, x in enumerate(b)]
                best = max(sum(eq[s : s + w]) for s in range(len(b) - w + 1))
                if best == w or w >= 8 and 5 * best >= 4 * w:
                    found[i, k] = max(found.get((i, k), (0, 0)), (best, w))
    return {(i, k, w, n) for (i, k), (n, w) in found.items()}


def test_masks_see_through_any_allowed_substitution():
    for w in range(8, 14):
        placed = [{s + o for o in m} for m in dc.MASKS for s in range(w - m[-1])]
        for gone in itertools.combinations(range(w), w - -(-4 * w // 5)):
            assert any(not p & set(gone) for p in placed)


def test_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(150)] + ["Élan", "x1", "the"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 7, 8, 9, 12, 13, 30, 60]))) + ".", 1) for k in range(25)]
    rows = []
    for i in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1].split()
            a = rng.randrange(len(part))
            part = part[a : a + rng.randint(4, 40)]
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                part[rng.randrange(len(part))] = "other"
            at = rng.randint(0, len(text))
            text[at:at] = part
        rows.append((i, rng.choice([" ", "\n", ", "]).join(text).upper() if i % 3 else " ".join(text), "c", 1))
    rows += [(500, None, "c", 1), (501, "", "c", 1), (None, items[5][1], "c", 1), (502, "w " * 30_000 + items[6][1], "c", 1), rows[0]]
    items += [(90, None, 1), (91, "", 1), (None, "a b c d e f g h i", 1), items[3]]
    got = {tuple(r) for r in dc.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == brute(rows, items)
    assert got


def test_drop_and_empty_tables(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"x {item} y", "c", 1), (2, "clean text", "c", 1), (None, item, "c", 1), (3, None, "c", 1)]
    docs, items = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(0, item, 1)], ITEMS)
    kept = dc.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 3]
    assert dc.drop_contaminated(docs, items.where(F.lit(False))).count() == 4
    assert dc.contaminated(docs.where(F.lit(False)), items).count() == 0

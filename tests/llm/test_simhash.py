import random

import pytest
import xxhash
from pyspark.sql import functions as F

from cladeworks.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id int"


def brute_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low:
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    words += [word] * bool(word)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = list(range(len(fps)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_masks_cover_every_pair_of_positions():
    ms = simhash.masks()
    assert len(ms) == 7
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in ms) for i in range(64) for j in range(64))


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "Ünder", "b", "x9", "the", "end.", "\U0001f600"]
    texts = [None, "", " \t", "one", "one two", "ONE TWO"]
    for _ in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        texts += [" ".join(t), "\n".join(t), " ".join([*t[:-1], "changed"]), " ".join(t[1:])]
    texts.append("w " * 30_000)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i]["fp"] & (2**64 - 1) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(fps)


def test_links_of_a_dense_bucket(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(300):
        fps.add(rng.choice(sorted(fps)) ^ 1 << rng.randrange(64) ^ (rng.random() < 0.5) << rng.randrange(64))
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(100)})
    frame = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    edges = [(r["src"] & (2**64 - 1), r["dst"] & (2**64 - 1)) for r in simhash.links(frame).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    root = {f: f for f in fps}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        root[find(a)] = find(b)
    mine, want = {}, {}
    for f, b in zip(fps, brute_components(fps), strict=True):
        mine.setdefault(find(f), set()).add(f)
        want.setdefault(b, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_repeats_nulls_and_empty_table(spark):
    rows = [(1, "a b c d", "f", 1), (1, "a b c d", "f", 1), (2, "a b c d", "f", 1), (None, "q r s", "f", 1), (5, None, "f", 1), (6, "", "f", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.keep_one_per_group(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 5]
    assert simhash.simhash_groups(frame.where(F.lit(False))).count() == 0
    assert simhash.keep_one_per_group(frame.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("text", ["A b", "", "x\x0by\x0cz w"])
def test_fingerprint_of_short_texts(text):
    assert simhash.fingerprint(text, 3) == brute_fingerprint(text)


def shingle_set(text, k=5):
    words = (text or "").split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_every_near_copy_at_four_fifths_goes(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for size, changed in [(30, 1), (60, 1), (60, 2), (200, 4), (200, 9), (400, 2), (1000, 20), (1000, 1), (1000, 60)] * 3:
        base = [word() for _ in range(size)]
        copy = list(base)
        for at in rng.sample(range(size), changed):
            copy[at] = word()
        texts += [" ".join(base), " ".join(copy)]
    group = [word() for _ in range(100)]
    texts += [" ".join([*group[:i], word(), *group[i + 1 :]]) for i in range(60)]
    passage = [word() for _ in range(40)]  # shared by unlike texts
    texts += [" ".join([*passage, *[word() for _ in range(30)]]) for _ in range(30)]
    rng.shuffle(texts)
    sets = [shingle_set(t) for t in texts]
    want = [i for i, s in enumerate(sets) if not any(jaccard(s, e) >= 0.8 for e in sets[:i])]
    frame = spark.createDataFrame([(i, t, "f", 1) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r["doc_id"] for r in simhash.keep_one_per_group(frame).collect()) == want
    at = [jaccard(sets[i], sets[j]) for i in range(len(sets)) for j in range(i)]
    assert sum(0.8 <= x < 0.95 for x in at) > 10 and sum(0.3 < x < 0.8 for x in at) > 10


def test_clashing_ids_with_different_texts_are_judged_apart(spark):
    rows = [(1, "a b c d e f", "f", 1), (1, "q r s t u v", "f", 1), (2, "q r s t u v", "f", 1), (3, "k l m n o p", "f", 1)]
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["text"][0]) for r in kept) == [(1, "a"), (1, "q"), (3, "k")]


def test_simhash_groups_are_compared_before_the_exact_join(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, phrase = [word() for _ in range(3000)], [word() for _ in range(7)]
    texts = [" ".join([*base[:at], word(), *base[at + 1 :]]) for at in rng.sample(range(3000), 12)]
    texts += [" ".join([*phrase * 60, *[word() for _ in range(12)]]) for _ in range(4)]  # like fingerprints, unlike sets
    fps = [simhash.fingerprint(t, 5) for t in texts]
    roots = brute_components(fps)
    sets = [shingle_set(t) for t in texts]
    want = {i for i, r in enumerate(roots) for e in {r, fps.index(fps[i])} if e < i and jaccard(sets[i], sets[e]) >= 0.8}
    assert len(want) > 5 and any(roots[i] != i for i in range(12, 16))
    monkeypatch.setattr(simhash.neardup.linededup, "alike_earlier", lambda sets, words_of, known: known)
    frame = spark.createDataFrame([(i, t, "f", 1) for i, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"] for r in simhash.keep_one_per_group(frame).collect()} == set(range(len(texts))) - want

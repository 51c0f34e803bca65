import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cladeworks.llm import quality, toxicity

DOCS, LABELS = "doc_id long, text string, lang string, score int, y int", "doc_id long, quality int, toxic int, text string"
SMALL = toxicity.ToxicityParams(positives=150, negatives=250, rounds=2, epochs=3)


def corpus(n=500, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioukrtmnsl") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(5, 150))]
        toxic, good = int(rng.random() < 0.25), int(rng.random() < 0.7)
        if toxic:
            for _ in range(3):
                text.insert(rng.randint(0, len(text)), "vexqu" + rng.choice(["ta", "ö", "ance", "son", ""]))
        if not good:
            text = [w + rng.choice(["***", "$$$", "%%%"]) for w in text]
        docs.append((i, " ".join(text), "en", 1, 1))
        labels.append((i, good, toxic, "x"))
    return docs, labels


def held(i, modulus, which):
    return zlib.crc32(str(i).encode()) % modulus == which


EDGES = [(9000, None, "en", 1, 1), (9001, "", "en", 1, 1), (None, "no id", "en", 1, 1), (9002, "word " * 30_000, "en", 1, 1), (0, "repeat", "en", 1, 1), (9003, "!!! ...", "en", 1, 1)]


def test_quality_on_held_out_rows_and_edges(spark):
    docs, labels = corpus()
    frame, marks = spark.createDataFrame(docs + EDGES, DOCS), spark.createDataFrame([*labels, (None, 1, 1, "x"), (1, None, None, "x"), labels[2]], LABELS)
    got = quality.classify(frame, marks).collect()
    assert len(got) == len(docs) + len(EDGES)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 0}
    test = [(by[i]["predicted"], good) for i, good, *_ in labels if i and held(i, 5, 0)]
    assert sum(a == b for a, b in test) >= 0.95 * len(test)
    assert all(by[i]["held_out"] == held(i, 5, 0) for i, *_ in labels if i)
    assert by[9000]["score"] == by[9001]["score"]
    assert by[None]["held_out"] is False
    assert {r["score"] for r in quality.classify(frame, marks.where(F.lit(False))).collect()} == {0.5}
    assert quality.classify(frame.where(F.lit(False)), marks).count() == 0


def test_toxicity_on_held_out_rows_and_edges(spark):
    docs, labels = corpus()
    frame, marks = spark.createDataFrame(docs + EDGES, DOCS), spark.createDataFrame([*labels, (None, 1, 1, "x"), (1, None, None, "x"), labels[2]], LABELS)
    got = toxicity.classify(frame, marks, params=SMALL).collect()
    assert len(got) == len(docs) + len(EDGES)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 0}
    test = [(by[i]["predicted"], toxic) for i, _, toxic, _ in labels if i and held(i, 3, 1)]
    assert sum(a == b for a, b in test) >= 0.95 * len(test)
    assert all(by[i]["held_out"] == held(i, 3, 1) for i, *_ in labels if i)
    assert by[9000]["score"] == by[9001]["score"] < 0.7 and by[9002]["score"] < 0.7
    assert {r["score"] for r in toxicity.classify(frame, marks.where(F.lit(False))).collect()} == {0.0}
    assert toxicity.classify(frame.where(F.lit(False)), marks, params=SMALL).count() == 0


def test_windows_cover_every_word():
    for n in range(200):
        starts = toxicity.window_starts(n)
        assert {k for s in starts for k in range(s, min(s + toxicity.WINDOW, n))} == set(range(n))


def test_score_is_that_of_the_highest_window():
    net, _ = toxicity._start([["a", "b"], ["c"]], np.array([1.0, 0.0]), SMALL)
    text = [f"w{i}" for i in range(100)] + ["a"] * 5 + [f"v{i}" for i in range(70)]
    alone = [net.window_logits([text[s : s + toxicity.WINDOW]])[0][0] for s in toxicity.window_starts(len(text))]
    together = net.window_logits([["x"], text, []])[1]
    assert np.allclose(together, alone, atol=1e-5)


def test_gradients():
    rng = np.random.default_rng(0)
    net, _ = toxicity._start([["aa", "bb", "cc"], ["dd", "aa"]], np.array([1.0, 0.0]), SMALL)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    names, rows, y, w = ["aa", "bb", "ee"], np.array([[0, 1, 2, -1], [2, 0, -1, -1], [1, 1, 0, 2]]), np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        p = toxicity._sigmoid(net.forward(net.inputs(names)[0], rows))
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    before = {k: v.copy() for k, v in net.p.items()}
    net.learn(names, rows, y, w, 1e-3)
    grads = {k: m[0] / 0.1 for k, m in net.moments.items() if len(m) == 2}
    net.p = before
    for name in ("w_f", "u_b", "att", "att_v", "out", "c_b"):
        flat = net.p[name].reshape(-1)
        for i in rng.choice(flat.size, 4):
            keep = flat[i]
            flat[i] = keep + 1e-3
            up = loss()
            flat[i] = keep - 1e-3
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-3 - grads[name].reshape(-1)[i]) < 2e-3


def test_additive_model_adds_tables():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only the pair tells
    model = quality.train(x, y, quality.QualityParams(rounds=10, pair_rounds=60))
    assert (0, 1) in model.pairs or (1, 0) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.9

import math
import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cladeworks.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int, rank int"


def brute(rows, every, k):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks = {}
    for i, v in sound:
        if i % every == 0:
            asks[i] = min(asks.get(i, v), v)
    out = set()
    for i, q in asks.items():
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in sound if j != i and len(v) == len(q))[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(16)], 1, 1) for i in range(400)]
    rows += [(400 + i, rows[7][1], 1, 1) for i in range(60)]  # a common vector: ties
    rows += [(900, None, 1, 1), (950, [None] * 16, 1, 1), (901, [float("nan")] * 16, 1, 1), (902, [float("inf")] * 16, 1, 1), (None, rows[3][1], 1, 1), (1000, [1.0, 2.0], 1, 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for params in (topk.TopKParams(), topk.TopKParams(query_group=4, candidate_group=100, block=32, depths=(0.1, 0.3, 0.6))):
        got = {tuple(r) for r in topk.top_k(topk.whole_vectors(frame), 50, params).collect()}
        assert got == brute(rows, 50, 5)
    few = [(0, [1.0, 0.0], 1, 1), (1, [0.5, 0.5], 1, 1), (1, [0.5, 0.5], 1, 1)]
    got = sorted(map(tuple, topk.top_k(topk.whole_vectors(spark.createDataFrame(few, SCHEMA)), 50).collect()))
    assert got == [(0, 1, 1, 32768), (0, 2, 1, 32768)]
    assert topk.top_k(topk.whole_vectors(frame.where(F.lit(False))), 50).count() == 0


def test_bounds_enclose_scores_and_lists_stop_early():
    rng = np.random.default_rng(0)
    x = np.floor(rng.standard_normal((300, 8)) * 50).astype(np.float64)
    q = np.floor(rng.standard_normal((5, 8)) * 50)
    order = np.argsort(x, axis=0, kind="stable")
    up = np.argsort(order, axis=0, kind="stable")
    for depth in (1, 30, 150, 299):
        lower, upper = topk._bounds(q, x, depth, len(x) - 1 - up, up)
        assert (lower <= q @ x.T).all() and (q @ x.T <= upper).all()
    near = np.vstack([q * 3, x])
    found = topk.block_top_k(np.arange(5) + 1000, q, np.arange(len(near)), near, np.full(5, -np.inf), topk.TopKParams(k=1))
    assert all(len(c) < len(near) and depth < len(near) for c, _, depth in found)
    assert topk._group_top_k.__name__


def test_large_components_stay_exact(spark):
    rows = [(0, [1e6, 3.0], 1, 1), (1, [1e6 + 1, 1.0], 1, 1), (2, [1e6, 2.0], 1, 1)]
    assert {tuple(r) for r in topk.top_k(topk.whole_vectors(spark.createDataFrame(rows, SCHEMA)), 50).collect()} == brute(rows, 50, 5)


def test_lists_of_the_table_are_not_read_to_their_ends():
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x = np.floor(256 * np.array(table["embedding"].to_pylist(), np.float64))
    ids = table["vec_id"].to_numpy()
    asks = ids % 50 == 0
    bar, early, read = np.full(asks.sum(), -np.inf), 0, []
    params = topk.TopKParams()
    for at in range(0, len(x), params.block):
        part, own = x[at : at + params.block], ids[at : at + params.block]
        for i, (chosen, scores, depth) in enumerate(topk.block_top_k(ids[asks], x[asks], own, part, bar, params)):
            early += depth < len(part)
            read.append(depth / len(part))
            true = part @ x[asks][i]
            true[own == ids[asks][i]] = -np.inf
            best = np.sort(true)[-5:]
            assert set(best[best >= bar[i]]) <= set(scores)
            bar[i] = max(bar[i], best[0])
    print(early / len(read), np.mean(read))
    assert early > 0.9 * len(read)


def test_every_row_that_repeats_a_query_id_asks(spark):
    rows = [(0, [1.0, 0.0], 1, 1), (0, [0.0, 1.0], 1, 1), (0, [0.0, 1.0], 1, 1), (1, [2.0, 1.0], 1, 1), (2, [1.0, 3.0], 1, 1)]
    got = sorted(map(tuple, topk.top_k(topk.whole_vectors(spark.createDataFrame(rows, SCHEMA)), 50).collect()))
    one, two = [(1, 1, 131072), (2, 2, 65536)], [(1, 2, 196608), (2, 1, 65536)]
    assert got == sorted((0, *x) for x in [*one, *two, *two])

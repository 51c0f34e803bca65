"""Exact top-k by inner product with no-random-access aggregation.

Every dimension of a block of candidates is a sorted list. A query reads the
lists from the end where its own component gives the highest products, all
lists to the same depth. What it has seen of a candidate gives a lower bound
(unseen components at the worst end of their list) and an upper bound (unseen
components at the value the list stands at). It stops as soon as no outsider,
which is all but ``few`` candidates, can qualify: their upper bounds are below
the k-th highest lower bound. The scores of the few are then resolved from the
rest of the lists. The k-th best of the blocks read before raises the bar for
the next block. Lists that are read to their ends make the bounds exact, so
every query stops at the last depth at the latest.

The bounds of all queries against all candidates of a block come from two
matrix products a round, because lists that are read downwards serve all
positive components and lists that are read upwards all negative ones.

Scale: queries and candidates are dealt by hashes of their ids into groups of
bounded size; each pair of groups is one task's work, and a task yields at
most k rows for a query. Those are ranked by a window whose limit is applied
before the shuffle as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TopKParams:
    k: int = 5
    #: Mean sizes of the groups that meet in a task.
    query_group: int = 4096
    candidate_group: int = 8192
    #: Candidates of a block that are sorted and read together.
    block: int = 1024
    #: Shares of the lists that have been read after each round; the last round reads them to their ends.
    depths: tuple[float, ...] = (0.5, 0.7, 0.8, 0.87, 0.93)
    #: Candidates of a block that may be left for a query to stop.
    few: int = 40


def _bounds(q: np.ndarray, x: np.ndarray, depth: int, down: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (queries x candidates) after reading ``depth`` entries of each list."""
    n = len(x)
    pos, neg = np.maximum(q, 0), np.minimum(q, 0)
    seen_down, seen_up = down < depth, up < depth
    high, low = x.max(axis=0), x.min(axis=0)
    at_down, at_up = np.partition(x, n - depth, axis=0)[n - depth], np.partition(x, depth - 1, axis=0)[depth - 1]
    lower = pos @ np.where(seen_down, x, low).T + neg @ np.where(seen_up, x, high).T
    upper = pos @ np.where(seen_down, x, at_down).T + neg @ np.where(seen_up, x, at_up).T
    return lower, upper


def block_top_k(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, bar: np.ndarray, params: TopKParams) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Per query the indices of candidates that may be among its k best, their final scores, and the depth it read to.

    ``bar``: a score below which candidates cannot matter. Components are
    whole numbers small enough that every product is exact.
    """
    n = len(x)
    order = np.argsort(x, axis=0, kind="stable")
    up = np.empty_like(order)
    np.put_along_axis(up, order, np.broadcast_to(np.arange(n)[:, None], order.shape), axis=0)
    down = n - 1 - up
    out: list[tuple[np.ndarray, np.ndarray, int]] = [(np.empty(0, np.int64), np.empty(0, x.dtype), 0)] * len(q)
    active = np.arange(len(q))
    for depth in sorted({n, *(max(1, int(d * n)) for d in params.depths)}):
        if not len(active):
            break
        lower, upper = _bounds(q[active], x, depth, down, up)
        own = x_ids[None, :] == q_ids[active, None]
        lower = np.where(own, -np.inf, lower)
        kth = np.partition(lower, n - params.k, axis=1)[:, n - params.k] if n >= params.k else np.full(len(active), -np.inf)
        rivals = (upper >= np.maximum(kth, bar[active])[:, None]) & ~own
        stops = (rivals.sum(axis=1) <= params.few) | (depth == n)
        for i in np.flatnonzero(stops):
            chosen = np.flatnonzero(rivals[i])
            out[active[i]] = chosen, x[chosen] @ q[active[i]], depth
        active = active[~stops]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(lists.to_pylist(), dtype=np.int64) if len(lists) else np.empty((0, 0), np.int64)


def _group_top_k(queries: pa.Table, candidates: pa.Table, params: TopKParams) -> Iterator[tuple[int, int, int]]:
    if not queries.num_rows or not candidates.num_rows:
        return
    q_ids, x_ids = queries["id"].to_numpy(), candidates["id"].to_numpy()
    q, x = _matrix(queries["v"]), _matrix(candidates["v"])
    top = max(int(np.abs(q).max(initial=0)), 1) * max(int(np.abs(x).max(initial=0)), 1) * max(q.shape[1], 1)
    kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else object
    q, x = q.astype(kind), x.astype(kind)
    best: list[list[tuple[int, int]]] = [[] for _ in q_ids]
    bar = np.full(len(q), -np.inf)
    for at in range(0, len(x), params.block):
        part, ids = x[at : at + params.block], x_ids[at : at + params.block]
        if kind is object:  # beyond exact floats: plain whole numbers
            found = [(np.flatnonzero(ids != i), (part[ids != i] @ v), len(part)) for i, v in zip(q_ids, q, strict=True)]
        else:
            found = block_top_k(q_ids, q, ids, part, bar, params)
        for i, (chosen, scores, _) in enumerate(found):
            if len(chosen):
                best[i] = sorted([*best[i], *zip((-scores).tolist(), ids[chosen].tolist(), strict=True)])[: params.k]
                if len(best[i]) == params.k:
                    bar[i] = -float(best[i][-1][0])
    for i, rows in enumerate(best):
        for score, other in rows:
            yield i, int(other), int(-score)


def top_k(vectors: DataFrame, every: int, params: TopKParams = TopKParams()) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best candidates of every query, ranks from 1.

    ``vectors (id long, v array<bigint>)``. Queries are the rows whose id is
    divisible by ``every``; a candidate is every row whose id is not the
    query's own, so rows that repeat an id are not each other's candidates.
    Ties go to the smaller id; rows that repeat a candidate's id count each,
    and each row that repeats a query's id asks and has its own ranks.
    Vectors of different lengths do not meet. Rows with a null id or vector
    take no part. Scores must fit a long. Empty tables give an empty result.
    """
    vectors = vectors.where("id is not null and v is not null").withColumn("d", F.size("v"))
    n = vectors.count()
    # Group counts follow the sizes, so that groups keep their mean size at any scale.
    q_groups, x_groups = max(1, round(n / every / params.query_group)), max(1, round(n / params.candidate_group))
    group = lambda key, groups: F.pmod(F.xxhash64(F.lit(key), "id", "v"), F.lit(groups)).cast("int")
    asked = vectors.where(F.col("id") % every == 0).groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies")).withColumn("d", F.size("v"))
    queries = asked.select("id", "v", "copies", F.xxhash64("v").alias("ask"), "d", group("q", q_groups).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(x_groups - 1))).alias("h"))
    candidates = vectors.select("id", "v", "d", group("x", x_groups).alias("h"), F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1))).alias("g"))
    names = ["query_id", "ask", "copies", "vec_id", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(_group_top_k(left, right, params))
        at, others, scores = (np.array(c, np.int64) for c in (zip(*found, strict=True) if found else ((), (), ())))
        own = [left[c].to_numpy()[at] if len(at) else at for c in ("id", "ask", "copies")]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (*own, others, scores)], names=names)

    cell = ["d", "g", "h"]
    found = queries.groupBy(cell).cogroup(candidates.groupBy(cell)).applyInArrow(run, ", ".join(f"{c} long" for c in names))
    order = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")  # limited to k rows a key before the shuffle
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.k)
    return best.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")).drop("_copy")


def whole_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``(id, v)``: floor(scale * x) of every component; vectors that are null or hold a null or non-finite component are left out."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return rows.where(sound).select("id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))

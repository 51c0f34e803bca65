"""Text quality by a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins. Training visits the features in
turn, again and again; each visit fits a shallow tree on that one feature to
the log-loss gradients and adds a small share of its leaf values to the
feature's lookup table. Then the pairs with the strongest joint signal in what
is left get two-dimensional tables by the same cyclic boosting. A score is the
logistic function of an intercept plus one table entry per feature and pair.

Scale: features and scores come from one pass without a shuffle. The model is
fitted on the driver from at most about ``sample`` labelled rows, chosen by a
hash of the id (a documented bound); its tables have a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.common import fold, share_below, slices

FEATURES = (
    "log_chars", "log_words", "mean_word", "max_word", "upper", "digit", "punct", "bar", "bang", "symbol", "space", "distinct_words",
    "repeated_words_run", "log_lines", "distinct_lines", "mean_line", "short_words", "ends_in_symbol", "all_caps_words", "distinct_trigrams", "non_ascii",
)
_WORD = re.compile(r"\S+")


@dataclass(frozen=True)
class QualityParams:
    sample: int = 20_000
    bins: int = 32
    pair_bins: int = 8
    pairs: int = 6
    rounds: int = 120
    pair_rounds: int = 40
    rate: float = 0.12
    leaves: int = 4
    smoothing: float = 8.0


def features(text: str | None) -> list[float]:
    """The features of a whole text, in the order of ``FEATURES``; empty texts have zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(text)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    w = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = len(set(words))
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    grams = len(set(zip(words, words[1:], words[2:], strict=False)))
    tails = sum(x[-1] in "$%&*#!|@^~=<>" for x in words)
    caps = sum(len(x) > 2 and x.isupper() for x in words)
    share = lambda chars: float(counts[list(chars.encode())].sum()) / n
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(sizes.mean()), float(np.log1p(sizes.max())),
        float(counts[65:91].sum()) / n, float(counts[48:58].sum()) / n, share(".,;:?'\"()-"), share("|"), share("!"), share("$%&*#@^~=<>+/\\_{}[]"),
        share(" \t"), distinct / w, runs / w, float(np.log1p(len(lines))), len(set(lines)) / max(len(lines), 1),
        float(np.log1p(n / max(len(lines), 1))), float((sizes <= 2).sum()) / w, tails / w, caps / w,
        grams / max(len(words) - 2, 1), (len(raw) - n) / n,
    ]


@dataclass(frozen=True)
class QualityModel:
    #: Upper edges of the bins of each feature, and of the coarse bins that pairs use.
    edges: tuple[np.ndarray, ...]
    coarse: tuple[np.ndarray, ...]
    intercept: float
    tables: np.ndarray
    pairs: tuple[tuple[int, int], ...]
    pair_tables: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = _binned(x, self.edges)
        total = self.intercept + self.tables[np.arange(len(self.edges))[None, :], bins].sum(axis=1)
        if self.pairs:
            small = _binned(x, self.coarse)
            for k, (a, b) in enumerate(self.pairs):
                total = total + self.pair_tables[k, small[:, a], small[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _binned(x: np.ndarray, edges: tuple[np.ndarray, ...]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, smoothing: float) -> np.ndarray:
    """Leaf values by bin of a tree that splits one ordered feature into ``leaves`` stretches, best split first."""
    g, h = np.concatenate([[0.0], gradient.cumsum()]), np.concatenate([[0.0], weight.cumsum()])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + smoothing)
    cuts = [0, len(gradient)]
    while len(cuts) - 1 < leaves:
        best = None
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                mid = np.arange(a + 1, b)
                found = gain(a, mid) + gain(mid, b) - gain(a, b)
                i = int(found.argmax())
                if found[i] > 1e-9 and (best is None or found[i] > best[0]):
                    best = float(found[i]), int(mid[i])
        if best is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gradient))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + smoothing)
    return out


def train(x: np.ndarray, y: np.ndarray, params: QualityParams = QualityParams()) -> QualityModel:
    """Cyclic boosting of single features, then of the strongest pairs."""
    edges = tuple(_edges(x[:, j], params.bins) for j in range(x.shape[1]))
    coarse = tuple(_edges(x[:, j], params.pair_bins) for j in range(x.shape[1]))
    bins, small = _binned(x, edges), _binned(x, coarse)
    rate = (y.sum() + 1) / (len(y) + 2)
    intercept = float(np.log(rate / (1 - rate)))
    total = np.full(len(y), intercept)
    tables = np.zeros((x.shape[1], params.bins))
    for _ in range(params.rounds):
        for j in range(x.shape[1]):
            p = 1 / (1 + np.exp(-total))
            size = len(edges[j]) + 1
            step = params.rate * _tree(np.bincount(bins[:, j], y - p, size), np.bincount(bins[:, j], p * (1 - p), size), params.leaves, params.smoothing)
            tables[j, :size] += step
            total += step[bins[:, j]]
    k = params.pair_bins
    cell = lambda a, b: small[:, a] * k + small[:, b]
    p = 1 / (1 + np.exp(-total))
    strength = []
    for a in range(x.shape[1]):
        for b in range(a):
            g, h = np.bincount(cell(a, b), y - p, k * k), np.bincount(cell(a, b), p * (1 - p), k * k)
            strength.append((float((g**2 / (h + params.smoothing)).sum()), a, b))
    pairs = tuple((a, b) for _, a, b in sorted(strength, reverse=True)[: params.pairs])
    pair_tables = np.zeros((len(pairs), k, k))
    for _ in range(params.pair_rounds):
        for i, (a, b) in enumerate(pairs):
            p = 1 / (1 + np.exp(-total))
            g = np.bincount(cell(a, b), y - p, k * k).reshape(k, k)
            h = np.bincount(cell(a, b), p * (1 - p), k * k).reshape(k, k)
            step = np.zeros((k, k))
            top = _tree(g.sum(axis=1), h.sum(axis=1), 2, params.smoothing)
            for side in np.unique(top):  # a tree of depth two: first the one feature, then the other
                rows = top == side
                step[rows] = _tree(g[rows].sum(axis=0), h[rows].sum(axis=0), 2, params.smoothing)
            pair_tables[i] += params.rate * step
            total += params.rate * step.ravel()[cell(a, b)]
    return QualityModel(edges, coarse, intercept, tables, pairs, pair_tables)


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int) -> DataFrame:
    """At most about ``bound`` rows ``(doc_id, text, y)`` with a label, outside fold ``held``.

    Ids that are labelled more than once count as 1 if any label is. The
    choice is by a hash of the id. The labels that are left are few by that
    bound, so they are broadcast to the scan of the texts.
    """
    known = labels.where(f"doc_id is not null and {label} is not null").where(fold(F.col("doc_id"), modulus) != held)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    n = known.count()
    chosen = known.where(share_below(F.col("doc_id"), min(1.0, bound / n))) if n else known
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, params: QualityParams = QualityParams()) -> QualityModel | None:
    """A model from the labels outside the held-out fold; None if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [features(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = labelled(docs, labels, "quality", modulus, held, params.sample).select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y double, x array<double>").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    return train(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]), params)


def score(docs: DataFrame, model: QualityModel | None, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, score, predicted)``: one row per row of ``docs``; score is the chance that a text is good.

    Null texts count as empty and are scored like any text. Without a model
    every score is 0.5. Other columns are ignored; repeated rows and null ids
    keep their rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                scores = model.score(np.array([features(t) for t in texts])) if model is not None and texts else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, params: QualityParams = QualityParams()) -> DataFrame:
    """Fit outside fold 0 and score every document: ``(doc_id, held_out, score, predicted)``."""
    model = fit(docs, labels, modulus, 0, params)
    held = F.coalesce(fold(F.col("doc_id"), modulus) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")

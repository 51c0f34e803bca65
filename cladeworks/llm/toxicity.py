"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is cut into words and scored in overlapping windows of ``WINDOW`` words
that start every ``STRIDE`` words, to its very end. The input of a word joins
its own vector (words of the training vocabulary) and the mean of the vectors
of its hashed character n-grams (any word), so unseen forms of a stem are
recognised. A forward and a backward GRU read the window, attention weighs
their states, and the score of a text is that of its highest window.

Only a text's label is known, not which window earns it: training alternates
between picking each text's highest windows with the model so far and fitting
the network to them. The first picks use log odds of words and n-grams, which
also start one component of the vectors.

Scale: one pass over the texts without a shuffle; windows are scored in
chunks, so memory does not grow with a text. The network is fitted on the
driver from at most about ``positives`` + ``negatives`` labelled texts chosen
by a hash of the id (documented bounds of the training sample), whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.common import fold, share_below, slices

WINDOW, STRIDE = 32, 16
GRAMS = 1 << 16
_WORD = re.compile(r"\w+")
_F = np.float32


@dataclass(frozen=True)
class ToxicityParams:
    positives: int = 1200
    negatives: int = 2400
    vocabulary: int = 20_000
    word_size: int = 8
    gram_size: int = 8
    hidden: int = 8
    rounds: int = 3
    epochs: int = 4
    batch: int = 256
    rate: float = 0.01
    seed: int = 7


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def window_starts(n: int) -> range:
    """Starts of the windows of n words: every word is in one, all but the ends in two; a text without words has one empty window."""
    return range(0, max(n - STRIDE, 1), STRIDE)


def grams(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams (3 to 5, with word borders) of all words one after the other, and where each word's begin."""
    raw = np.frombuffer(("^" + "$^".join(distinct) + "$").encode("utf-8", "surrogatepass"), np.uint8)
    size = np.fromiter((len(w.encode("utf-8", "surrogatepass")) + 2 for w in distinct), np.int64, len(distinct))
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(distinct)), size)
    value = np.zeros(len(raw), np.uint32)
    ids, whose = [], []
    for k in range(1, 6):
        if len(raw) < k:
            break
        value = value[: len(raw) - k + 1] * np.uint32(263) + raw[k - 1 :]
        if k >= 3:
            inside = np.arange(len(value)) + k <= ends[owner[: len(value)]]
            ids.append((((value + np.uint32(k)) * np.uint32(2654435761)) >> np.uint32(16))[inside])
            whose.append(owner[: len(value)][inside])
    whose, ids = np.concatenate(whose), np.concatenate(ids).astype(np.int64)
    order = np.argsort(whose, kind="stable")
    return ids[order], np.searchsorted(whose[order], np.arange(len(distinct) + 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Word and n-gram vectors, two GRUs, attention and output; a window is a row of word numbers, -1 where it has ended."""

    vocabulary: dict[str, int]
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    moments: dict[str, list[np.ndarray]] = field(default_factory=dict)
    steps: int = 0

    def inputs(self, distinct: list[str]) -> tuple[np.ndarray, tuple]:
        known = np.fromiter((self.vocabulary.get(w, 0) for w in distinct), np.int64, len(distinct))
        ids, starts = grams(distinct)
        count = np.maximum(np.diff(starts), 1)[:, None].astype(_F)
        mean = np.add.reduceat(self.p["gram"][ids], starts[:-1], axis=0) / count
        return np.concatenate([self.p["word"][known], mean], axis=1), (known, ids, starts, count)

    def _run(self, side: str, given: np.ndarray, rows: np.ndarray, keep: list | None) -> np.ndarray:
        u, h_size = self.p[f"u_{side}"], self.p["u_f"].shape[0]
        steps = range(rows.shape[1]) if side == "f" else range(rows.shape[1] - 1, -1, -1)
        h = np.zeros((len(rows), h_size), _F)
        out = np.zeros((rows.shape[1], len(rows), h_size), _F)
        for t in steps:
            at = rows[:, t]
            x, m = given[at], (at >= 0)[:, None]
            hu = h @ u
            gates = _sigmoid(x[:, : 2 * h_size] + hu[:, : 2 * h_size])
            r, z = gates[:, :h_size], gates[:, h_size:]
            n = np.tanh(x[:, 2 * h_size :] + r * hu[:, 2 * h_size :])
            new = np.where(m, n + z * (h - n), h)
            if keep is not None:
                keep.append((t, h, r, z, n, hu[:, 2 * h_size :], m))
            h = out[t] = new
        return out

    def forward(self, x: np.ndarray, rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of every window."""
        states = []
        for side in "fb":
            given = np.concatenate([x @ self.p[f"w_{side}"] + self.p[f"c_{side}"], np.zeros((1, self.p["c_f"].shape[0]), _F)])  # row -1: no word
            trace = None if keep is None else keep.setdefault(side, [])
            states.append(self._run(side, given, rows, trace))
        h = np.concatenate(states, axis=2)
        u = np.tanh(h @ self.p["att"] + self.p["att_c"])
        e = np.where((rows >= 0).T, u @ self.p["att_v"], -30.0).astype(_F)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * h).sum(axis=0)
        if keep is not None:
            keep.update(h=h, u=u, a=a, pooled=pooled)
        return pooled @ self.p["out"] + self.p["out_c"][0]

    def learn(self, distinct: list[str], rows: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> float:
        """One step of Adam (dense parts) and Adagrad (vectors) on a batch of windows; the loss before it."""
        keep: dict = {}
        x, (known, ids, starts, count) = self.inputs(distinct)
        logit = self.forward(x, rows, keep)
        p = _sigmoid(logit)
        d = (weight * (p - y) / weight.sum()).astype(_F)
        g = {"out": keep["pooled"].T @ d, "out_c": np.array([d.sum()], _F)}
        d_pooled = d[:, None] * self.p["out"][None, :]
        h, u, a = keep["h"], keep["u"], keep["a"]
        d_h = a[:, :, None] * d_pooled[None]
        d_a = (h * d_pooled[None]).sum(axis=2)
        d_e = np.where((rows >= 0).T, a * (d_a - (a * d_a).sum(axis=0)), 0)
        g["att_v"] = np.einsum("tbk,tb->k", u, d_e)
        d_u = d_e[:, :, None] * self.p["att_v"] * (1 - u * u)
        g["att"], g["att_c"] = np.einsum("tbi,tbk->ik", h, d_u), d_u.sum(axis=(0, 1))
        d_h = d_h + d_u @ self.p["att"].T
        size, d_x = self.p["u_f"].shape[0], np.zeros_like(x)
        for k, side in enumerate("fb"):
            up, d_given = self.p[f"u_{side}"], np.zeros((len(x) + 1, 3 * size), _F)
            g_u, carry = np.zeros_like(up), np.zeros((len(rows), size), _F)
            for t, h_in, r, z, n, hn, m in reversed(keep[side]):
                total = d_h[t, :, k * size : (k + 1) * size] + carry
                live = total * m
                d_n = live * (1 - z) * (1 - n * n)
                d_z = live * (h_in - n) * z * (1 - z)
                d_r = d_n * hn * r * (1 - r)
                d_in = np.concatenate([d_r, d_z, d_n], axis=1)
                d_hu = np.concatenate([d_r, d_z, d_n * r], axis=1)
                g_u += h_in.T @ d_hu
                carry = total * ~m + live * z + d_hu @ up.T
                np.add.at(d_given, rows[:, t], d_in)
            d_given = d_given[:-1]
            g[f"u_{side}"], g[f"w_{side}"], g[f"c_{side}"] = g_u, x.T @ d_given, d_given.sum(axis=0)
            d_x += d_given @ self.p[f"w_{side}"].T
        self.steps += 1
        for name, grad in g.items():
            m1, m2 = self.moments.setdefault(name, [np.zeros_like(self.p[name]), np.zeros_like(self.p[name])])
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            self.p[name] = (self.p[name] - rate * (m1 / (1 - 0.9**self.steps)) / (np.sqrt(m2 / (1 - 0.99**self.steps)) + 1e-8)).astype(_F)
        split = self.p["word"].shape[1]
        per_gram = np.repeat(d_x[:, split:] / count, np.diff(starts), axis=0)
        for name, at, grad in (("word", known, d_x[:, :split]), ("gram", ids, per_gram)):
            rows_at, back = np.unique(at, return_inverse=True)
            summed = np.zeros((len(rows_at), grad.shape[1]), _F)
            np.add.at(summed, back, grad)
            past = self.moments.setdefault(name, [np.zeros_like(self.p[name])])[0]
            past[rows_at] += summed * summed
            self.p[name][rows_at] -= rate * summed / (np.sqrt(past[rows_at]) + 1e-6)
        return float(-(weight * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / weight.sum())

    def window_logits(self, texts: list[list[str]], chunk: int = 4096) -> list[np.ndarray]:
        """The logits of all windows of each text."""
        number: dict[str, int] = {}
        flat = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, sum(map(len, texts)))
        x = self.inputs(list(number))[0] if number else np.zeros((0, self.p["w_f"].shape[0]), _F)
        begin = np.cumsum([0, *map(len, texts)])
        starts = [np.arange(s.start, s.stop, s.step) for s in (window_starts(len(t)) for t in texts)]
        first = np.concatenate([b + s for b, s in zip(begin, starts, strict=False)]) if texts else np.zeros(0, np.int64)
        stop = np.repeat(begin[1:], [len(s) for s in starts])
        out = np.zeros(len(first), _F)
        padded = np.concatenate([flat, np.full(WINDOW, -1)])
        for at in range(0, len(first), chunk):
            where = first[at : at + chunk, None] + np.arange(WINDOW)
            rows = np.where(where < stop[at : at + chunk, None], padded[np.minimum(where, len(padded) - 1)], -1)
            out[at : at + chunk] = self.forward(x, rows)
        return np.split(out, np.cumsum([len(s) for s in starts])[:-1]) if texts else []

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        top = np.array([w.max() for w in self.window_logits(texts)], np.float64)
        return _sigmoid(self.scale * top + self.shift)


def _start(texts: list[list[str]], y: np.ndarray, params: ToxicityParams) -> tuple[Network, dict[str, float]]:
    """A network whose vectors begin with log odds, and the log odds of all words for the first picks."""
    rng = np.random.default_rng(params.seed)
    seen: dict[str, list[int]] = {}
    for t, label in zip(texts, y, strict=True):
        for w in set(t):
            seen.setdefault(w, [0, 0])[int(label)] += 1
    n = np.bincount(y.astype(int), minlength=2)
    odds = lambda c: np.log((c[..., 1] + 0.5) / (n[1] + 1)) - np.log((c[..., 0] + 0.5) / (n[0] + 1))
    names = list(seen) or ["-"]
    counts = np.array([seen[w] for w in seen] or [[0, 0]], np.float64)
    ids, starts = grams(names)
    by_gram = np.stack([np.bincount(ids, np.repeat(counts[:, k], np.diff(starts)), GRAMS) for k in (0, 1)], axis=1)
    sure = lambda c: np.clip(odds(c) * c.sum(axis=1) / (c.sum(axis=1) + 5), -3, 3)
    word_odds, gram_odds = sure(counts), sure(by_gram)
    own = np.add.reduceat(gram_odds[ids], starts[:-1]) / np.maximum(np.diff(starts), 1)
    often = np.flatnonzero(counts.sum(axis=1) >= 2)
    top = often[np.argsort(-np.abs(word_odds[often]) * np.sqrt(counts[often].sum(axis=1)), kind="stable")][: params.vocabulary]
    vocabulary = {names[i]: k + 1 for k, i in enumerate(top)}
    d, h = params.word_size + params.gram_size, params.hidden
    normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(_F)
    p = {"word": (rng.standard_normal((len(vocabulary) + 1, params.word_size)) * 0.05).astype(_F), "gram": (rng.standard_normal((GRAMS, params.gram_size)) * 0.05).astype(_F)}
    p["word"][1:, 0], p["word"][0, 0], p["gram"][:, 0] = word_odds[top], 0, gram_odds
    for side in "fb":
        p |= {f"w_{side}": normal(d, 3 * h), f"u_{side}": normal(h, 3 * h), f"c_{side}": np.zeros(3 * h, _F)}
    p |= {"att": normal(2 * h, h), "att_c": np.zeros(h, _F), "att_v": normal(h), "out": normal(2 * h), "out_c": np.zeros(1, _F)}
    return Network(vocabulary, p), dict(zip(names, (word_odds + 2 * own).tolist(), strict=True))


def train(texts: list[list[str]], y: np.ndarray, prior: float, params: ToxicityParams = ToxicityParams()) -> Network:
    """Fit to texts given as words. ``prior``: the share of toxic texts to which scores are calibrated."""
    rng = np.random.default_rng(params.seed)
    net, odds = _start(texts, y, params)
    number: dict[str, int] = {}
    coded = [np.fromiter((number.setdefault(w, len(number)) for w in t), np.int64, len(t)) for t in texts]
    names = list(number)
    first = np.array([max(odds[w], 0.0) for w in names] or [0.0])
    picks = [[first[c[s : s + WINDOW]].max(initial=0) for s in window_starts(len(c))] for c in coded]
    for turn in range(params.rounds):
        if turn:
            picks = net.window_logits(texts)
        rows, labels = [], []
        for c, label, logits in zip(coded, y, picks, strict=True):
            starts = window_starts(len(c))
            order = np.argsort(-np.asarray(logits), kind="stable")
            for k in order[: 1 if label else 2]:
                row = np.full(WINDOW, -1)
                part = c[starts[k] : starts[k] + WINDOW]
                row[: len(part)] = part
                rows.append(row)
                labels.append(label)
        rows, labels = np.array(rows), np.array(labels, _F)
        weight = np.where(labels > 0, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1)).astype(_F)
        for _ in range(params.epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), params.batch):
                mine = order[at : at + params.batch]
                used, back = np.unique(rows[mine], return_inverse=True)
                back = back.reshape(rows[mine].shape)
                if used[0] < 0:
                    used, back = used[1:], back - 1
                if len(used):
                    net.learn([names[i] for i in used], back, labels[mine], weight[mine], params.rate)
    top = np.array([w.max() for w in net.window_logits(texts)], np.float64)
    share = y.mean()
    weight = np.where(y > 0, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    for _ in range(200):  # Newton steps of a weighted logistic fit with a little shrinkage
        p = _sigmoid(net.scale * top + net.shift)
        r, v = weight * (y - p), weight * p * (1 - p)
        g = np.array([(r * top).sum() - 0.1 * (net.scale - 1), r.sum()])
        hess = np.array([[(v * top * top).sum() + 0.1, (v * top).sum()], [(v * top).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        net.scale, net.shift = net.scale + float(np.clip(step[0], -0.5, 0.5)), net.shift + float(np.clip(step[1], -0.5, 0.5))
    net.moments.clear()
    return net


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, params: ToxicityParams = ToxicityParams()) -> Network | None:
    """A network from the labels outside the held-out fold; None unless both labels occur.

    Ids that are labelled more than once count as toxic if any label says so.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id"), modulus) != held)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    share = F.when(F.col("y") == 1, share_below(F.col("doc_id"), min(1.0, params.positives / n[1]))).otherwise(share_below(F.col("doc_id"), min(1.0, params.negatives / n[0])))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known.where(share)), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [" ".join(words(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.string())], names=["doc_id", "y", "words"])

    got = rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, words string").collect()
    got.sort(key=lambda r: (r["doc_id"], r["words"]))
    y = np.array([r["y"] for r in got], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    return train([r["words"].split() for r in got], y, n[1] / (n[0] + n[1]), params)


def score(docs: DataFrame, net: Network | None, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, score, predicted)``: one row per row of ``docs``; score is the chance that a text is toxic.

    Null and empty texts are scored as one empty window. Without a network
    every score is 0. Other columns are ignored; repeated rows and null ids
    keep their rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, 128):
                texts = [words(t) for t in part.column(1).to_pylist()]
                found = model.scores(texts) if model is not None else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Fit outside fold ``held`` and score every document: ``(doc_id, held_out, score, predicted)``."""
    net = fit(docs, labels, modulus, held, params)
    out = F.coalesce(fold(F.col("doc_id"), modulus) == held, F.lit(False))
    return score(docs, net).select("doc_id", out.alias("held_out"), "score", "predicted")

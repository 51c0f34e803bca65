"""Language identification by the nearest of several clustered centroids per language.

A text becomes a vector of hashed byte n-grams (lengths 1 to 4, lower case,
everything but letters folded to single spaces), weighted by
(1 + ln count) * idf and scaled to length 1. Each language has up to
``centroids`` unit centroids from spherical k-means; the nearest centroid by
cosine names the language. A text is rejected when its cosine falls well below
a low quantile of the training texts of its length class. The class is the
logarithm of the number of different n-grams: a text that repeats a few words
is judged like the short text that it is.

Scale: document frequencies are counted over all training texts, one partial
row for each partition and ``DIM`` counters in all. Centroids are fitted on
the driver from at most about ``per_language`` texts of each language, chosen
by a hash of the id: that bound is a parameter. The quantiles come from all
training texts, counted into a histogram of fixed size. Scoring is one pass without a
shuffle; the model is a fixed ``languages x centroids x DIM`` matrix.
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

DIM = 1 << 12
LENGTHS = (1, 2, 3, 4)
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = 32


@dataclass(frozen=True)
class LangIdParams:
    per_language: int = 400
    centroids: int = 4
    rounds: int = 12
    #: Centroids with a smaller share of a language's texts are left out: junk with a label would have its own.
    least_share: float = 0.05
    #: A text is rejected below ``slack`` times this quantile of the cosines of training texts of its class;
    #: junk among the training texts does not move it unless it is a larger share of a class.
    quantile: float = 0.1
    slack: float = 0.65
    #: A class with fewer training texts also takes those of the classes beside it.
    least_texts: int = 50
    #: Texts with more n-grams than this share of the training texts are judged like the last class below them,
    #: which few but junk may exceed; longer texts only come closer to their centroid.
    longest: float = 0.95


@dataclass(frozen=True)
class LangModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    #: Row i is a centroid of languages[owner[i]].
    centres: np.ndarray
    owner: np.ndarray
    #: Least cosine that is accepted, by length class.
    floor: np.ndarray


def _fold_table() -> np.ndarray:
    """ASCII letters and all bytes of longer characters stay; the rest becomes a space."""
    out = np.full(256, _SPACE, np.uint8)
    out[128:] = np.arange(128, 256)
    out[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return out


_FOLD = _fold_table()


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram ids of a text and how often each occurs."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw = _FOLD[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]
    raw = raw[np.r_[True, (raw[1:] != _SPACE) | (raw[:-1] != _SPACE)]].astype(np.uint32)
    counts = np.zeros(DIM, np.int64)
    gram = np.zeros(len(raw), np.uint32)
    for k in LENGTHS:
        if len(raw) < k:
            break
        gram = gram[: len(raw) - k + 1] * np.uint32(257) + raw[k - 1 :]
        counts += np.bincount(((gram + np.uint32(k)) * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def _vectors(grams: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(grams), DIM), np.float32)
    for row, (ids, counts) in zip(out, grams, strict=True):
        row[ids] = (1 + np.log(counts)) * idf[ids]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


#: Four length classes for each doubling of the number of different n-grams, and steps of the cosine.
CLASSES, STEPS = 4 * (DIM.bit_length() - 1) + 1, 1000


def _class(ids: np.ndarray) -> int:
    return int(4 * np.log2(max(1, len(ids))))


def _spherical_kmeans(vectors: np.ndarray, k: int, rounds: int, least_share: float) -> np.ndarray:
    """Unit centroids of at least ``least_share`` of the vectors; starts from the vectors farthest from those chosen so far."""
    chosen = [0]
    best = vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        far = int(best.argmin())
        if best[far] > 1 - 1e-6:
            break
        chosen.append(far)
        best = np.maximum(best, vectors @ vectors[far])
    centres = vectors[chosen].copy()
    for _ in range(rounds):
        near = (vectors @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            own = vectors[near == c]
            if len(own):
                mean = own.sum(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    owned = np.bincount((vectors @ centres.T).argmax(axis=1), minlength=len(centres))
    return centres[owned >= min(least_share * len(vectors), owned.max())]


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Over all texts of ``docs``: in how many each hashed n-gram occurs, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIM + 1, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    seen[gram_counts(text)[0]] += 1
                    n += 1
        seen[DIM] = n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["gram", "n"])

    counted = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(DIM + 1, np.int64)
    for row in counted.collect():  # DIM + 1 rows at most
        out[row["gram"]] = row["n"]
    return out[:DIM], int(out[DIM])


def _histogram(rows: DataFrame, idf: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Over all texts of ``rows`` with a letter: how many have which length class and cosine, ``CLASSES x STEPS`` counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CLASSES * STEPS, np.int64)
        for batch in batches:
            for part in slices(batch):
                grams = [gram_counts(t) for t in part.column(0).to_pylist() if _LETTER.search(t)]
                if grams:
                    cosine = (_vectors(grams, idf) @ centres.T).max(axis=1)
                    step = np.clip((cosine * STEPS).astype(np.int64), 0, STEPS - 1)
                    np.add.at(seen, np.array([_class(ids) for ids, _ in grams]) * STEPS + step, 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["cell", "n"])

    counted = rows.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(CLASSES * STEPS, np.int64)
    for row in counted.collect():  # CLASSES * STEPS rows at most
        out[row["cell"]] = row["n"]
    return out.reshape(CLASSES, STEPS)


def _floors(histogram: np.ndarray, params: LangIdParams) -> np.ndarray:
    """The least cosine that each length class accepts."""
    floor = np.zeros(CLASSES, np.float32)
    for c in range(CLASSES):
        for width in range(CLASSES):
            own = histogram[max(0, c - width) : c + width + 1].sum(axis=0)
            if own.sum() >= params.least_texts:
                break
        reached = np.cumsum(own) > params.quantile * own.sum()
        floor[c] = params.slack * reached.argmax() / STEPS
    last = int((np.cumsum(histogram.sum(axis=1)) >= params.longest * histogram.sum()).argmax())
    floor[last:] = floor[last]
    return floor


def fit(training: DataFrame, params: LangIdParams = LangIdParams()) -> LangModel | None:
    """A model from ``training (doc_id, text, lang)``; None if no row has an id, a text with a letter and a lang."""
    rows = training.where("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    df, n = _document_frequencies(rows)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = [gram_counts(t) if _LETTER.search(t) else None for t in part.column(1).to_pylist()]
                keep = [i for i, g in enumerate(got) if g is not None]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(keep, pa.int64())),
                        pa.array([got[i][0].tolist() for i in keep], pa.list_(pa.int32())),
                        pa.array([got[i][1].tolist() for i in keep], pa.list_(pa.int32())),
                    ],
                    names=["lang", "ids", "counts"],
                )

    share = F.lit(None).cast("boolean")
    for lang, count in sizes.items():
        share = F.when(F.col("lang") == lang, share_below(F.col("doc_id"), min(1.0, params.per_language / count))).otherwise(share)
    sample = rows.where(share).select("lang", "text").mapInArrow(grams, "lang string, ids array<int>, counts array<int>").collect()
    by: dict[str, list] = {}
    for r in sample:
        by.setdefault(r["lang"], []).append((np.array(r["ids"], np.int64), np.array(r["counts"], np.int64)))
    if not by:
        return None
    languages = tuple(sorted(by))
    centres, owner = [], []
    for i, lang in enumerate(languages):
        vectors = _vectors(by[lang], idf)
        own = _spherical_kmeans(vectors, params.centroids, params.rounds, params.least_share)
        centres.append(own)
        owner += [i] * len(own)
    found = np.concatenate(centres).astype(np.float32)
    floor = _floors(_histogram(rows, idf, found), params)
    return LangModel(languages, idf, found, np.array(owner), floor)


def predict(docs: DataFrame, model: LangModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)``: one row per row of ``docs``.

    lang_pred is the nearest centroid's language and score its cosine, cut to
    0..1. Null texts and texts without any letter give ``und``, score 0 and
    rejected = true; so does every text if there is no model. rejected is also
    true for texts farther from every centroid than the model accepts; they
    keep their nearest language in lang_pred. Equal cosines go to the language
    that sorts first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                known = [i for i, t in enumerate(texts) if model is not None and t and _LETTER.search(t)]
                lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                if known:
                    grams = [gram_counts(texts[i]) for i in known]
                    cosine = _vectors(grams, model.idf) @ model.centres.T
                    best = cosine.argmax(axis=1)
                    for i, g, row, b in zip(known, grams, cosine, best, strict=True):
                        lang[i], score[i] = model.languages[model.owner[b]], min(1.0, max(0.0, float(row[b])))
                        rejected[i] = row[b] < model.floor[_class(g[0])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang), pa.array(score, pa.float64()), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, modulus: int = 5, params: LangIdParams = LangIdParams()) -> DataFrame:
    """Fit on rows outside fold 0 of ``modulus`` and predict every row: ``(doc_id, held_out, lang_pred, score, rejected)``.

    Rows with a null id or a null lang are never learnt from; a null id is not
    held out.
    """
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(columns.where(fold(F.col("doc_id"), modulus) != 0), params)
    held = F.coalesce(fold(F.col("doc_id"), modulus) == 0, F.lit(False))
    return predict(columns, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, modulus: int = 5, params: LangIdParams = LangIdParams()) -> DataFrame:
    """The rows of ``docs`` whose language is identified; columns unchanged.

    The decision is made row by row in the same pass, so equal ids with
    different texts are judged apart and no join is needed.
    """
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(columns.where(fold(F.col("doc_id"), modulus) != 0), params)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            for part in slices(batch):
                keep = []
                for t in part.column(at).to_pylist():
                    g = gram_counts(t) if model is not None and t and _LETTER.search(t) else None
                    keep.append(g is not None and bool((_vectors([g], model.idf) @ model.centres.T).max() >= model.floor[_class(g[0])]))
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
